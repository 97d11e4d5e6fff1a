"""Column functions on text: language, sentences, style signals, scores, URLs, identities, colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import ABBREVIATIONS, ITALIAN_MARKERS

# ---------------------------------------------------------------- language


_CYRILLIC = "[А-Яа-яЇїІіЄєҐґ]"
#: One range around all of these: most texts have nothing in it, and looking for one range costs a fifth of looking for the class.
_AROUND_CYRILLIC = "[\u0400-\u04ff]"


def guess_language_or_null(text: Column) -> Column:
    """uk by 30 % Cyrillic letters; null under five words; it by a marker word; else en.

    Letters are counted, as lengths of runs, only where there is a Cyrillic one; five words are looked for from the start.
    """
    runs = lambda pattern: F.length(text) - F.length(F.regexp_replace(text, pattern, ""))
    cyrillic = text.rlike(_AROUND_CYRILLIC) & text.rlike(_CYRILLIC) & (runs(f"{_CYRILLIC}+") / F.nullif(runs(r"\p{L}+"), F.lit(0)) >= 0.30)
    five_words = text.rlike(r"^(?U)\s*+(?:\S++\s++){4}\S")
    padded = F.lower(F.concat(F.lit(" "), text, F.lit(" ")))
    marked = padded.rlike(" (" + "|".join(ITALIAN_MARKERS) + ") ")
    return F.when(cyrillic, "uk").when(~five_words, F.lit(None)).when(marked, "it").otherwise("en")


def guess_language(text: Column) -> Column:
    return F.coalesce(guess_language_or_null(text), F.lit("en"))


# ---------------------------------------------------------------- sentences and words


#: Marks a cut inside a text; a private-use character that texts have no use for (one that a text holds counts as a blank).
CUT = "\ue000"


def _abbreviations(language: str | None) -> str:
    """Alternation of what a period may follow, of a language or of all."""
    of = lambda k: {*ABBREVIATIONS[k], *ABBREVIATIONS["latin"]}
    found = of(language) if language else set().union(*map(of, ("en", "it", "uk")))
    return "|".join(sorted(found, key=lambda w: (-len(w), w)))


def sentence_chunks(text: Column, language: Column) -> Column:
    """Array of chunks whose concatenation is the text: cut behind . ! ? … before a blank, tab or line end.

    No cut after an abbreviation of the language (null or another language: of any). Chunks keep their outer blanks.
    """
    marked = F.regexp_replace(F.replace(text, F.lit(CUT), F.lit(" ")), r"([.!?…])(?=[ \t\n])", "$1" + CUT)

    def joined(lang: str | None) -> Column:
        # The mark is looked for first, so the list is tried at marks alone.
        return F.regexp_replace(marked, rf"(?iu){CUT}(?<=(?<![\p{{L}}\p{{N}}'-])(?:{_abbreviations(lang)})\.{CUT})", "")

    out = F.when(language == "en", joined("en")).when(language == "it", joined("it")).when(language == "uk", joined("uk")).otherwise(joined(None))
    return F.split(out, CUT, -1)


def sentences(text: Column, language: Column) -> Column:
    """Array of the sentences, outer white space gone, blank ones left out."""
    trimmed = F.transform(sentence_chunks(text, language), lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))
    return F.filter(trimmed, lambda c: c != "")


_WORD = r"[a-z0-9_'’\p{L}\p{N}-]++"


def words(text: Column) -> Column:
    """Lower-cased runs of letters, digits, _, apostrophes and hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def count_words(text: Column) -> Column:
    """How many words() has, without making them."""
    return F.regexp_count(F.lower(text), F.lit(_WORD))


#: Values that one running sum adds up at most before it is cut.
_RUN = 256


def running_starts(lengths: Column) -> Column:
    """Where each of consecutive pieces of these lengths (int) begins, from 0.

    Sums grow inside runs of _RUN values and over the runs' totals, so no list is copied once for each of its values.
    """
    sums = lambda values: F.aggregate(values, F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(lengths), F.lit(1)) - 1) / _RUN).cast("int")), lambda b: sums(F.slice(lengths, b * _RUN + 1, F.lit(_RUN))))

    def joined(r: Column) -> Column:
        bases = sums(F.transform(r, lambda run: F.element_at(run, -1)))
        return F.flatten(F.zip_with(r, F.slice(bases, F.lit(1), F.size(r)), lambda run, base: F.transform(F.slice(run, F.lit(1), F.size(run) - 1), lambda x: x + base)))

    return _let(runs, joined)


# ---------------------------------------------------------------- style


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def uniformity(sentence_texts: Column) -> Column:
    """1 - variation of sentence lengths / 0.6; null under three sentences with words."""

    def score(n: Column) -> Column:
        # The mean is bound first: written into the sum over lengths, it would be made anew for each of them.
        return _let(F.aggregate(n, F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(n), F.lit(0)), lambda mean: F.when(F.size(n) >= 3, clamp(1.0 - spread(n, mean) / mean / 0.6)))

    def spread(n: Column, mean: Column) -> Column:
        return F.sqrt(F.aggregate(n, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / F.size(n))

    lengths = F.filter(F.transform(sentence_texts, lambda s: count_words(s).cast("double")), lambda n: n > 0)
    return _let(lengths, score)


def repetition(word_array: Column) -> Column:
    """(0.6 - distinct share of words) / 0.35; null under twenty words."""
    return F.when(F.size(word_array) >= 20, clamp((0.6 - F.size(F.array_distinct(word_array)) / F.size(word_array)) / 0.35))


def dashes(text: Column, n_words: Column) -> Column:
    """(dashes per 100 words - 0.3) / 1.7; null under fifteen words."""
    return F.when(n_words >= 15, clamp((F.regexp_count(text, F.lit("[—–]")) / n_words * 100 - 0.3) / 1.7))


def combine_score(u: Column, r: Column, d: Column, structural: Column, cliches: Column) -> Column:
    """Signals averaged by weight over those measured; phrases, words and constructions each take a share of the rest."""
    parts = ((0.40, u), (0.35, r), (0.25, d))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0.0) for w, x in parts[1:]), F.when(parts[0][1].isNotNull(), parts[0][0]).otherwise(0.0))
    value = sum((F.coalesce(x, F.lit(0.0)) * w for w, x in parts[1:]), F.coalesce(parts[0][1], F.lit(0.0)) * parts[0][0])
    base = F.when(weight > 0, value / weight).otherwise(0.0)
    strong = F.size(F.filter(cliches, lambda c: F.contains(c, F.lit(" "))))
    weak = F.size(cliches) - strong
    left = (1.0 - clamp(base)) * F.pow(F.lit(0.7), strong) * F.pow(F.lit(0.9), weak) * F.when(structural, 0.75).otherwise(1.0)
    return clamp(1.0 - left)


def confidence(score: Column) -> Column:
    return F.when(score >= 0.66, "high").when(score >= 0.33, "medium").otherwise("low")


# ---------------------------------------------------------------- pages and URLs

# Marks of client-rendered pages, in order.
FRAMEWORKS = (
    ("next", r"(?i)__NEXT_DATA__|/_next/static"),
    ("nuxt", r"(?i)__NUXT__|/_nuxt/"),
    ("sveltekit", r"(?i)__sveltekit|/_app/immutable"),
    ("angular", r"(?i)<app-root|ng-version="),
    ("vue", r"(?i)data-v-app|id=[\"']app[\"'][^>]*>\s*</div>"),
    ("react", r"(?i)id=[\"'](root|__next)[\"']"),
)


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_ratio(html: Column) -> Column:
    return F.when(F.length(html) > 0, F.length(squeeze(F.regexp_replace(html, "<[^>]+>", " "))) / F.length(html)).otherwise(0.0)


def framework(html: Column) -> Column:
    out = F
    for name, pattern in FRAMEWORKS:
        out = out.when(html.rlike(pattern), name)
    return out.otherwise("")


def normalise_url(url: Column) -> Column:
    """No fragment, no / at the path's end, but / for an empty path; the query stays."""
    bare = F.regexp_replace(url, "#.*$", "")
    head = F.regexp_extract(bare, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)", 1)
    path = F.regexp_extract(bare, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*)?([^?]*)", 1)
    query = F.regexp_extract(bare, r"(\?.*)$", 1)
    path = F.when(path == "", "/").when(path.rlike("^/+$") | ~path.rlike("/$"), path).otherwise(F.regexp_replace(path, "/+$", ""))
    return F.concat(head, path, F.when(query == "?", "").otherwise(query))


def host_key(url: Column) -> Column:
    """Lower-case host without www., and a port that isn't the scheme's own."""
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    authority = F.regexp_extract(url, r"//(?:[^/?#]*@)?([^/?#]*)", 1)
    port = F.regexp_extract(authority, r":(\d+)$", 1)
    host = F.regexp_replace(F.lower(F.regexp_replace(authority, r":\d*$", "")), r"^www\.", "")
    default = ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")) | (port == "")
    return F.when(default, host).otherwise(F.concat(host, F.lit(":"), port))


def host_of(src: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(F.coalesce(src, F.lit(""))), "^(?:https?:)?//([^/?#]+)", 1))


def resolve_url(base: Column, href: Column) -> Column:
    """href against base: absolute, //host, /path, ?query or a relative path with . and .. taken out."""
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    folder = F.regexp_replace(path, "[^/]*$", "")
    tail = F.regexp_extract(href, r"([?#].*)$", 1)
    merged = F.concat(F.when(folder == "", "/").otherwise(folder), F.regexp_replace(href, r"[?#].*$", ""))

    def dots(p: Column) -> Column:
        parts = F.split(p, "/", -1)
        last = F.element_at(parts, -1)
        kept = F.aggregate(
            F.filter(parts, lambda x, i: (i > 0) & (x != ".")),
            F.array().cast("array<string>"),
            lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))),
        )
        return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(last.isin(".", "..") & (F.size(kept) > 0), "/").otherwise(""))

    return (
        F.when(href.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), href)
        .when(F.startswith(href, F.lit("//")), F.concat(scheme, href))
        .when(F.startswith(href, F.lit("/")), F.concat(origin, dots(F.regexp_replace(href, r"[?#].*$", "")), tail))
        .when(F.startswith(href, F.lit("?")), F.concat(origin, path, href))
        .otherwise(F.concat(origin, dots(merged), tail))
    )


# ---------------------------------------------------------------- identities


def fingerprint(kind: Column, source: Column, text: Column) -> Column:
    """Sixteen hex digits that name a finding by kind, source and squeezed text, wherever it stands."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return F.substring(F.sha1(F.concat_ws("␟", some(kind), some(source), squeeze(some(text))).cast("binary")), 1, 16)


def content_hash(text: Column) -> Column:
    return F.substring(F.md5(text.cast("binary")), 1, 16)


def training_half(text: Column) -> Column:
    """A split that never changes: whether the first byte of the text's SHA-1 is even."""
    return F.conv(F.substring(F.sha1(text.cast("binary")), 1, 2), 16, 10).cast("int") % 2 == 0


def binding(value: Column) -> Column:
    """Which kind of template expression an attribute's value is; empty: none."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.startswith(v, F.lit("{{")) & F.endswith(v, F.lit("}}")), "mustache").when(F.startswith(v, F.lit("{")), "expression").when(F.startswith(v, F.lit("<%")) | F.startswith(v, F.lit("${")), "template").otherwise("")


# ---------------------------------------------------------------- colours

# Colours by name.
COLOURS = {
    "white": (255, 255, 255), "black": (0, 0, 0), "red": (255, 0, 0), "green": (0, 128, 0), "blue": (0, 0, 255),
    "gray": (128, 128, 128), "grey": (128, 128, 128), "silver": (192, 192, 192), "yellow": (255, 255, 0),
}


def colour(value: Column) -> Column:
    """Array of red, green, blue of a name, #rgb, #rrggbb, rgb() or rgba(); else null."""
    v = F.lower(F.trim(value))
    digits = F.substring(v, 2, 1000)
    full = F.when(F.length(digits) == 3, F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    hexed = F.when(full.rlike("^[0-9a-f]{6}"), F.array(*[F.conv(F.substring(full, k, 2), 16, 10).cast("int") for k in (1, 3, 5)]))
    numbers = F.regexp_extract_all(F.replace(F.regexp_extract(v, r"^rgba?\(([^)]+)\)", 1), F.lit("/"), F.lit(",")), F.lit(r"(?:^|,)\s*(-?[0-9]+(?:\.[0-9]*)?)\s*(?=,|$)"), 1)
    functional = F.when(F.size(numbers) >= 3, F.transform(F.slice(numbers, 1, 3), lambda x: x.cast("double").cast("int")))
    named = F
    for name, rgb in COLOURS.items():
        named = named.when(v == name, F.array(*[F.lit(c) for c in rgb]))
    return F.coalesce(named.otherwise(None), F.when(F.startswith(v, F.lit("#")), hexed), F.when(v.rlike(r"^rgba?\("), functional))


def luminance(rgb: Column) -> Column:
    linear = F.transform(rgb, lambda x: F.when(x / 255.0 <= 0.04045, x / 255.0 / 12.92).otherwise(F.pow((x / 255.0 + 0.055) / 1.055, F.lit(2.4))))
    return 0.2126 * linear[0] + 0.7152 * linear[1] + 0.0722 * linear[2]


def contrast(a: Column, b: Column) -> Column:
    return (F.greatest(luminance(a), luminance(b)) + 0.05) / (F.least(luminance(a), luminance(b)) + 0.05)
