"""Operator 3, language ID by cross-parsing entropy.

For each language a suffix automaton of a bounded sample of labelled text is built. A text is cut greedily into the
longest phrases that the automaton has read; few phrases per character mean that text and sample share their language.
The language that needs the fewest phrases wins.

The automata are laid out as one dense transition table of at most CELLS entries that is broadcast, whatever the corpus,
the languages and their scripts. A text walks through it in many lanes side by side, one NumPy step per position; where
a lane's last phrase goes on, it is followed into the next lane until both are in one state, so the phrases are those of
one walk from the text's beginning to its end.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import quoted, slices

#: Bound of the labelled sample: passages per language, and code points of each passage.
PASSAGES, PASSAGE_CHARS = 60, 800
#: Bound of the automata's table, in entries of 4 bytes; a language's sample is cut to its share of it.
CELLS = 1 << 26
#: Letters with a symbol of their own; rarer ones are written with up to three of DIGITS symbols.
FREQUENT, DIGITS = 62, 64
#: A text is parsed in lanes of so many symbols, and so many characters of it at a time.
LANE, SEGMENT = 512, 1 << 21
UNKNOWN = "und"


# ---------------------------------------------------------------- learning


def sample(labelled: DataFrame, passages: int = PASSAGES, chars: int = PASSAGE_CHARS) -> dict[str, list[str]]:
    """A bounded sample of labelled (lang, text): about `passages` rows of each language, a passage of each.

    Rows and the place of each passage are drawn by a hash of the text, so that reruns agree. All rows are counted.
    """
    usable = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64(F.lit("sample"), "text").alias("h"))
    # One row per language comes to the driver, so that no text is shuffled to meet its language's count.
    counts = dict(usable.groupBy("lang").count().collect())
    if not counts:
        return {}
    count = F.try_element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.col("lang"))
    share = F.pmod("h", F.lit(1_000_003)) / F.lit(1_000_003.0) * count < passages
    at = F.pmod(F.shiftright("h", 20), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    drawn = usable.filter(share).select("lang", F.substring("text", at, F.lit(chars)).alias("passage"), "h")
    out: dict[str, list[str]] = {}
    for lang, passage, _ in sorted(drawn.distinct().collect(), key=lambda r: (r[0], r[2], r[1])):
        got = out.setdefault(lang, [])
        if len(got) < 2 * passages:
            got.append(passage)
    return out


def suffix_automaton(codes: list[int], letters: int) -> np.ndarray:
    """Transitions (states x letters, 0: none) of the smallest automaton of all substrings; state 0 is its root."""
    moves = np.zeros((2 * len(codes) + 1, letters), np.int32)
    link, length, last = [-1], [0], 0
    for c in codes:
        here, p = len(link), last
        length.append(length[last] + 1)
        link.append(0)
        while p >= 0 and not moves[p, c]:
            moves[p, c] = here
            p = link[p]
        if p >= 0:
            q = int(moves[p, c])
            if length[p] + 1 == length[q]:
                link[here] = q
            else:
                twin = len(link)
                moves[twin] = moves[q]
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p, c] == q:
                    moves[p, c] = twin
                    p = link[p]
                link[q] = link[here] = twin
        last = here
    return moves[: len(link)].copy()


@dataclass
class Alphabet:
    """fold: code point to symbol (0: no letter, last: a letter never read), or to letters + number of a rare letter, which
    is written with `width` symbols from `digit` on."""

    fold: np.ndarray
    letters: int
    digit: int
    width: int


@dataclass
class Model:
    """table: for state and symbol 4 * (place of the next state's row) + phrases that end; roots: the languages' states 0."""

    languages: list[str]
    alphabet: Alphabet
    table: np.ndarray
    roots: np.ndarray


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    """The lower-case letter of each code point; 0 for what is no letter."""
    return np.array([ord(c.lower()[0]) if (c := chr(cp)).isalpha() else 0 for cp in range(0x110000)], np.uint32)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def alphabet_of(texts: list[str]) -> Alphabet:
    letters, counts = np.unique(_lower()[_points("".join(texts))], return_counts=True)
    order = sorted((-n, c) for c, n in zip(letters.tolist(), counts.tolist(), strict=True) if c)
    often, rare = sorted(c for _, c in order[:FREQUENT]), sorted(c for _, c in order[FREQUENT:])
    width = next(w for w in (1, 2, 3) if len(rare) <= DIGITS**w)
    digit = len(often) + 1
    size = digit + (DIGITS if rare else 0) + 1
    known = np.full(0x110000, size - 1, np.uint32)
    known[0] = 0
    known[often] = np.arange(len(often)) + 1
    known[rare] = np.arange(len(rare)) + size
    return Alphabet(known[_lower()], size, digit, width)


def symbols(texts: list[str], alphabet: Alphabet, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts, and where each begins. Runs of non-letters are one separator, none at a text's beginning.

    inside: the (one) text goes on behind letters, so that a separator at its beginning counts.
    """
    raw = alphabet.fold[_points("".join(texts))]
    ends = np.cumsum([len(t) for t in texts])
    keep = np.ones(len(raw), bool)
    keep[1:] = (raw[1:] != 0) | (raw[:-1] != 0)
    if not inside:
        first = np.concatenate([[0], ends[:-1]])
        first = first[first < len(raw)]
        keep[first] = raw[first] != 0
    at = np.concatenate([[0], np.cumsum(keep)])[np.concatenate([[0], ends])]
    raw = raw[keep]
    rare = raw >= alphabet.letters
    if not rare.any():
        return raw.astype(np.int32), at
    n = np.where(rare, alphabet.width, 1)
    place = np.concatenate([[0], np.cumsum(n)])
    out = np.repeat(raw, n).astype(np.int64)
    for k in range(alphabet.width):
        out[place[:-1][rare] + k] = alphabet.digit + ((raw[rare].astype(np.int64) - alphabet.letters) // DIGITS ** (alphabet.width - 1 - k)) % DIGITS
    return out.astype(np.int32), place[at]


def train(samples: dict[str, list[str]]) -> Model:
    """One automaton per language. No language: a model that answers `und`."""
    languages = sorted(samples)
    alphabet = alphabet_of([t for ts in samples.values() for t in ts])
    most = CELLS // (2 * max(1, len(languages)) * alphabet.letters) - 1
    tables, roots, base = [], [], 0
    for lang in languages:
        # Each passage begins behind a separator and ends with one.
        codes = symbols(["".join(t + "\n" for t in samples[lang])], alphabet)[0][:most]
        moves = suffix_automaton(codes.tolist(), alphabet.letters)
        # A step that the state lacks ends its phrase and begins one with this letter; a letter that even the root lacks is
        # a phrase of its own.
        missing, root = moves == 0, moves[0].copy()
        np.copyto(moves, np.broadcast_to(root, moves.shape), where=missing)
        moves *= alphabet.letters
        moves += base
        moves *= 4
        moves[1:] += missing[1:]
        moves += missing & (root == 0)
        tables.append(moves.ravel())
        roots.append(base)
        base += moves.size
    return Model(languages, alphabet, np.concatenate(tables) if tables else np.zeros(0, np.int32), np.array(roots, np.int32))


# ---------------------------------------------------------------- parsing


def _walk(codes: np.ndarray, edges: np.ndarray, model: Model, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end inside each piece, and the states at its end (both languages x pieces), from these states on."""
    table, n_lang, pieces = model.table, len(model.languages), len(edges) - 1
    counts = -(-np.diff(edges) // LANE)
    first = np.cumsum(counts) - counts
    piece = np.repeat(np.arange(pieces), counts)
    nth = np.arange(len(piece)) - first[piece]
    start = edges[piece] + nth * LANE
    size = np.minimum(LANE, edges[piece + 1] - start)
    # 1. All lanes side by side, the longest first: the first of a piece from its state, others from the root.
    order = np.argsort(-size, kind="stable")
    rank = np.argsort(order)
    begin = np.repeat(model.roots[:, None], len(piece), 1)
    begin[:, nth == 0] = state[:, piece[nth == 0]]
    now, found = begin[:, order], np.zeros((n_lang, len(piece)), np.int32)
    longest = int(size.max(initial=0))
    active, from_ = np.searchsorted(-size[order], -np.arange(longest), "left"), start[order]
    steps = np.empty((longest, n_lang, len(piece)), np.int32)
    for i in range(longest):
        n = active[i]
        v = table[now[:, :n] + codes[from_[:n] + i]]
        steps[i, :, :n] = v
        found[:, :n] += v & 3
        now[:, :n] = v >> 2
    found, now = found[:, rank], now[:, rank]
    # 2. Each lane goes on into the next ones until it is in their state: what it finds there, what they had found till then.
    last = np.ones(len(piece), bool)
    last[:-1] = piece[1:] != piece[:-1]
    more, less = np.zeros_like(found), np.zeros_like(found)
    land = np.full(found.shape, -1)
    end = now.copy()
    lang, lane = (x.ravel() for x in np.meshgrid(np.arange(n_lang), np.flatnonzero(~last), indexing="ij"))
    target, at = lane + 1, np.zeros(len(lane), np.int64)
    here, gained, theirs = now[lang, lane], np.zeros(len(lane), np.int32), np.zeros(len(lane), np.int32)
    while len(lane):
        v, w = table[here + codes[start[target] + at]], steps[at, lang, rank[target]]
        here, gained, theirs, at = v >> 2, gained + (v & 3), theirs + (w & 3), at + 1
        met = here == w >> 2
        through = ~met & (at == size[target])
        gone = met | through & last[target]
        if gone.any():
            k, m = lang[gone], lane[gone]
            more[k, m], less[k, m], end[k, m] = gained[gone], np.where(met[gone], theirs[gone], 0), here[gone]
            land[k, m] = np.where(met[gone], target[gone], -1)
        on = through & ~gone
        target, at, theirs = target + on, np.where(on, 0, at), np.where(on, 0, theirs)
        stay = ~gone
        lang, lane, target, at, here, gained, theirs = (x[stay] for x in (lang, lane, target, at, here, gained, theirs))
    # 3. From each piece's first lane along the lanes that it met.
    total, final = np.zeros((n_lang, pieces), np.int64), state.copy()
    k, p = (x.ravel() for x in np.meshgrid(np.arange(n_lang), np.flatnonzero(counts), indexing="ij"))
    m = first[p]
    total[k, p] = found[k, m]
    while len(k):
        to = land[k, m]
        total[k, p] += more[k, m] - less[k, m] + np.where(to >= 0, found[k, to], 0)
        over = to < 0
        final[k[over], p[over]] = end[k[over], m[over]]
        k, p, m = k[~over], p[~over], to[~over]
    return total, final


def phrases(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(documents x languages) phrases, and each document's symbols. A text is walked through SEGMENT characters at a time."""
    out, lengths = np.zeros((len(texts), len(model.languages)), np.int64), np.zeros(len(texts), np.int64)
    short = [i for i, t in enumerate(texts) if len(t) < SEGMENT]
    rooted = lambda n: np.repeat(model.roots[:, None], n, 1)
    if short:
        codes, edges = symbols([texts[i] + "\n" for i in short], model.alphabet)
        total, final = _walk(codes, edges, model, rooted(len(short)))
        out[short], lengths[short] = (total + (final != model.roots[:, None])).T, np.diff(edges)
    for i in sorted(set(range(len(texts))) - set(short)):
        state, inside, text = rooted(1), False, texts[i] + "\n"
        for a in range(0, len(text), SEGMENT):
            codes, edges = symbols([text[a : a + SEGMENT]], model.alphabet, inside)
            total, state = _walk(codes, edges, model, state)
            out[i], lengths[i] = out[i] + total[:, 0], lengths[i] + len(codes)
            inside = bool(codes[-1]) if len(codes) else inside
        out[i] += state[:, 0] != model.roots
    return out, lengths


def predict(texts: list[str | None], model: Model) -> tuple[list[str], list[float]]:
    """lang_pred and score of each text. Ties go to the language first by name.

    Score: by what share the runner-up needs more phrases than the winner (1 if there is but one language; 0 for `und`).
    """
    return judge(texts, [None] * len(texts), model)[:2]


def judge(texts: list[str | None], claims: list[str | None], model: Model) -> tuple[list[str], list[float], list[int | None], list[float | None]]:
    """lang_pred, score, and how many more phrases the claimed language needs than the winner, and their share of its own.

    The last two are null where no language is claimed, or one that the model lacks, and for `und`.
    """
    rows = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))]
    lang, score, more, share = [UNKNOWN] * len(texts), [0.0] * len(texts), [None] * len(texts), [None] * len(texts)
    if not rows or not model.languages:
        return lang, score, more, share
    found, _ = phrases([texts[i] for i in rows], model)
    best = found.argmin(1)
    two = np.sort(found, 1)[:, :2]
    column = {name: k for k, name in enumerate(model.languages)}
    for i, n, b, t in zip(rows, found.tolist(), best.tolist(), two.tolist(), strict=True):
        lang[i] = model.languages[b]
        score[i] = 1.0 if len(t) < 2 else (t[1] - t[0]) / t[1] if t[1] else 0.0
        if claims[i] in column:
            own = n[column[claims[i]]]
            more[i], share[i] = own - n[b], (own - n[b]) / own if own else 0.0
    return lang, score, more, share


def checked(samples: dict[str, list[str]], sure: float, least: int) -> dict[str, list[str]]:
    """The sample without passages that surely aren't in their language: each is judged by the half that it isn't in."""
    halves = [{lang: ts[k::2] for lang, ts in samples.items() if ts[k::2]} for k in (0, 1)]
    good: dict[str, list[str]] = {}
    for k in (0, 1):
        flat = [(lang, t) for lang, ts in halves[k].items() for t in ts]
        _, _, more, share = judge([t for _, t in flat], [lang for lang, _ in flat], train(halves[1 - k]))
        for (lang, t), m, x in zip(flat, more, share, strict=True):
            if m is None or m < least or x < sure:
                good.setdefault(lang, []).append(t)
    return good


def held_out(doc_id: Column) -> Column:
    """Remainder 2 of crc32(doc_id as text) by 4; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def learn(docs: DataFrame, passages: int = PASSAGES, check: tuple[float, int] | None = None) -> Model:
    """A model from the text and non-null lang of rows that are not held out; check: see checked()."""
    drawn = sample(docs.filter(~held_out(F.col("doc_id"))).select("lang", "text"), passages)
    return train(checked(drawn, *check) if check else drawn)


def identify(docs: DataFrame, model: Model, keep: list[str], claim: str | None = None) -> DataFrame:
    """The columns keep of docs, then lang_pred and score, from the whole text alone.

    claim: a column of languages; then more and share of judge() follow.

    Null, empty and letterless texts: `und`, 0. Equal texts, equal results; repeated rows and an empty table pass
    through. A text of any length needs bounded memory beside itself.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    own = [f"_k{i}" for i in range(len(keep))]

    def run(batches):
        for batch in batches:
            text = batch.column(len(own))
            for a, b in slices(text):
                part = batch.slice(a, b - a)
                texts = part.column(len(own)).to_pylist()
                found = judge(texts, part.column(len(own) + 1).to_pylist() if claim else [None] * len(texts), shared.value)
                columns = [pa.array(x, t) for x, t in zip(found, (pa.string(), pa.float64(), pa.int64(), pa.float64()), strict=True)][: len(new)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(own)], *columns], [*own, *new])

    narrow = docs.select(*[quoted(c).alias(o) for c, o in zip(keep, own, strict=True)], F.col("text").alias("_text"), *([quoted(claim).cast("string").alias("_claim")] if claim else []))
    new = {"lang_pred": "string", "score": "double"} | ({"more": "long", "share": "double"} if claim else {})
    fields = [f.simpleString() for f in narrow.schema.fields[: len(own)]]
    out = narrow.mapInArrow(run, ", ".join(f.replace(":", " ", 1) for f in [*fields, *[f"{k}:{t}" for k, t in new.items()]]))
    return out.withColumnsRenamed(dict(zip(own, keep, strict=True)))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = identify(docs, learn(docs), ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op3_language_id": op3_language_id}
SQL: dict[str, str] = {}
