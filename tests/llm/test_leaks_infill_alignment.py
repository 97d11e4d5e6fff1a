"""Decontamination, fill-in-middle and cross-tokenizer alignment against brute force, round trips, and edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import alignment, decontamination, infill, shared

tokenizers = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, k1 string, n long, item_id string"
#: Nulls in every column, empty and long texts, ties, repeated rows, extra columns that clash with inner names.
ODD = [
    (1, None, "en", "a", 5, None), (None, "the cat sat\non the mat\n", None, None, None, "x"), (2, "", "en", "a", 1, "x"), (3, " \n\t ", None, "b", 2, "x"),
    (4, "word of " * 15000, "en", "a", 1, "x"), (5, "one two\nthree Four\n\nfive six seven\neight nine ten eleven twelve", "en", None, 1, "x"),
    (5, "one two\nthree Four\n\nfive six seven\neight nine ten eleven twelve", "en", None, 1, "x"), (6, "one two\nthree Four\n\nfive six seven\neight nine ten eleven twelve", "de", "b", 1, "x"),
    (7, "x", "fr", "b", 1, "x"), (8, "y" * 20_000, "en", "c", 1, "x"), (9, "</s>[INST] <|endoftext|>\n <s> <0x41>", "en", "c", 1, "x"), (10, "Ünïcödé “quotes” 漢字 ✓ İ Σ\r\nÉcole", "xx", "c", 1, "x"),
    (11, "has <P> inside\nand more\n", "en", "c", 1, "x"), (12, "\n" * 50, "en", "c", 1, "x"), (13, "a ▁ mark", "en", "c", 1, "x"), (14, "  two  blanks   and\t tabs \n x ", "en", "c", 1, "x"),
    (15, "nul \x00 and \x1c odd space᠎ x", "en", "c", 1, "x"), (16, "<\n<P\n<S<\n>S>\nP>M>\n<", "en", "c", 1, "x"), (17, "trailing blank ", "en", "c", 1, "x"), (18, "-- the -- cat/sat on THE mat", "en", "c", 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# ---------------------------------------------------------------- 11 decontamination


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contaminated(docs, items, width=10):
    windows = defaultdict(set)
    for item_id, text in items:
        w = words(text)
        size = min(width, len(w))
        for s in range(len(w) - size + 1) if w else ():
            windows[tuple(w[s : s + size])].add(item_id)
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if found := windows.get(tuple(w[s : s + size])):
                    hit |= set(range(s, s + size))
                    ids |= found
        named = sorted(str(i) for i in ids if i is not None)
        out.append((doc_id, len(w), len(hit), len(named), sha(",".join(named)), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_matches_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "straße", "Mixed"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([1, 2, 5, 9, 10, 11, 25])))) for i in range(40)]
    items += [(40, items[3][1]), (41, "w1 " * 14), (None, "only of a null item"), (42, None), (43, "..."), (44, items[7][1].upper()), (44, items[7][1])]
    docs = []
    for i in range(150):
        text = [" ".join(rng.choices(vocabulary, k=rng.randrange(30)))]
        for _ in range(rng.randrange(3)):
            w = rng.choice([t for _, t in items if t]).split()
            a = rng.randrange(len(w))
            text += [rng.choice([", ", " — ", "\n"]).join(w[a:]), " ".join(rng.choices(vocabulary, k=5))]
        docs.append((i, " ".join(text)))
    docs += [(900, docs[0][1]), (900, docs[0][1]), (901, "only OF a null item!"), (902, items[5][1])]
    got = decontamination.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=str) == contaminated(docs, items)


def test_decontamination_odd(spark, odd, none):
    items = [("b", "one two three four five six seven eight nine ten"), ("a", "the cat sat on the mat"), ("c", "y" * 20_000), ("d", "école"), (None, None), ("e", "word of word of word of word of word of word of word")]
    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("doc_id", F.lit(1))
    got = decontamination.decontaminate(odd, bench)
    assert sorted(map(tuple, got.collect()), key=str) == contaminated([r[:2] for r in ODD], items)
    assert decontamination.decontaminate(none, bench).count() == 0
    clean = decontamination.decontaminate(odd, bench.limit(0))
    assert clean.filter("contaminated or n_hit <> 0 or n_items <> 0").count() == 0 and clean.count() == len(ODD)
    assert decontamination.decontaminate(none, bench.limit(0)).columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]


def test_near_matches_are_those_within_reach(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    items = [(i, rng.sample(vocabulary, 4)) for i in range(12)]
    texts = [rng.choices(vocabulary, k=60) for _ in range(40)]
    texts[0][10:14] = items[0][1][::-1]
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    shelf = shared.Shelf(spark)
    asked = decontamination.Items(bench, shelf, 10)
    index = shelf.put(decontamination.postings(docs, asked.distinct, 48))
    found = decontamination.near_matches(index, asked, shelf, 6).join(asked.ids, "item").join(docs.select("text", *decontamination.text_key(F.col("text"))), ["k1", "k2"])
    got = {(r.text, r.item_id, r.anchor) for r in found.collect()}
    shelf.close()
    often = Counter(w for t in texts for w in t)
    want = set()
    for i, w in items:
        for t in texts:
            at = {x: [p for p, y in enumerate(t) if y == x] for x in w}
            for lead in [x for x in w if often[x] == min(often[y] for y in w)]:
                want |= {(" ".join(t), i, p, lead) for p in at[lead] if all(any(abs(p - q) <= 6 for q in at[x]) for x in w)}
    ties = {i for i, w in items if sum(often[x] == min(often[y] for y in w) for x in w) > 1}
    assert {g for g in got if g[1] not in ties} == {x[:3] for x in want if x[1] not in ties}
    assert got <= {x[:3] for x in want} and any(g[1] == 0 for g in got)


# ---------------------------------------------------------------- 12 fill-in-middle


def infilled(doc_id, text, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    u, v = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:u]), "".join(units[u:v]), "".join(units[v:])
    if h4 % 100 < spm:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(("percent", "spm"), [(100, 50), (40, 100), (0, 50)])
def test_infill_matches_brute_force_and_restores(spark, odd, percent, spm):
    rng = random.Random(9)
    rows = [r[:2] for r in ODD] + [(100 + i, "".join(rng.choices("ab<>PSM\né ", k=rng.randrange(40)))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("clash")).withColumn("k2", F.lit(0))
    made = infill.fill_in_middle(docs, percent=percent, suffix_first=spm)
    got = made.withColumn("back", infill.restore(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((infilled(*r, percent, spm) for r in rows), key=str)
    assert sorted((str(r.doc_id), r.back) for r in got) == sorted((str(i), t or "") for i, t in rows)


def test_infill_empty(none):
    assert infill.fill_in_middle(none).count() == 0


# ---------------------------------------------------------------- 13 alignment


def paths():
    return tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model")


def aligned(rows):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a_path, b_path = paths()
    a_tok, b_tok = Tokenizer.from_file(a_path), SentencePieceProcessor(model_file=b_path)
    a_tok.encode_special_tokens = True
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    per_doc, holders = [], Counter()
    for doc_id, text in rows:
        a = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids
        b = b_tok.encode(text or "")
        a_bytes = [bytes(byte_of[c] for c in a_tok.id_to_token(i)) for i in a]
        b_names = [b_tok.id_to_piece(i) for i in b]
        b_bytes = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in b_names]
        data = (" " + (text or "")).encode()
        if not text or b"".join(a_bytes) != data or b"".join(b_bytes) != data:
            per_doc.append((doc_id, None))
            continue
        spans = []
        for ids, parts in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i, part in zip(ids, parts, strict=True):
                out.append((at, at := at + len(part), i))
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]] if len(a) < 400 else swept(*spans)
        ends = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, at = [], 0
        for e in ends:
            groups.append("|".join(",".join(str(x[2]) for x in s if at <= x[0] < e) for s in spans) if len(a) < 400 else None)
            at = e
        per_doc.append((doc_id, (len(a), len(b), len(ends), links, groups)))
        holders.update(set(links))
    best = defaultdict(int)
    for (x, _), n in holders.items():
        best[x] = max(best[x], n)
    out = []
    for doc_id, found in per_doc:
        if found is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n, links, groups = found
        digest = sha(";".join(groups)) if None not in groups else None
        out.append((doc_id, n_a, n_b, n, len(links), sum(holders[x] == best[x[0]] for x in links), sum(holders[x] for x in links), digest))
    return out


def swept(a, b):
    links, j = [], 0
    for lo, hi, i in a:
        while b[j][1] <= lo:
            j += 1
        k = j
        while k < len(b) and b[k][0] < hi:
            links.append((i, b[k][2]))
            k += 1
    return links


def same(got, want):
    by = lambda rows: sorted((r[:7] for r in rows), key=str)
    assert by(got) == by(want)
    digests = {str(r[:7]): r[7] for r in want if r[7] is not None}
    assert all(digests.get(str(r[:7]), r[7]) == r[7] for r in got)


def test_alignment_matches_brute_force(spark):
    rng = random.Random(13)
    letters = "aaabe  \n\t'é漢<|>09.,- ́▁𝄞"
    rows = [r[:2] for r in ODD] + [(100 + i, "".join(rng.choices(letters, k=rng.randrange(60)))) for i in range(200)]
    rows += [(400 + i, " ".join(rng.choices(["aaa", "aaaa", "aaaaa", "hello", "world's", "Straße", "x=1;"], k=30))) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    same([tuple(r) for r in alignment.align(docs, *paths()).collect()], aligned(rows))


def test_stretches_read_like_whole_texts():
    groups = alignment.Groups(*paths())
    slow = alignment.Groups(*paths())
    slow.fast = None
    assert groups.fast and not groups.joins
    rng = random.Random(17)
    for _ in range(600):
        text = "".join(rng.choices(["word", "it's", " ", "  ", "\n", "\n ", " \n", "é", "漢字", "12", "...", "\u3000 ", "\u180e ", "\x1c ", "\xa0", "<s>", "x ", "<|endoftext|>", "\u0301", "Ж"], k=14))
        whole = groups.encode(text, 10**9)
        assert groups.encode(text, 1) == whole == slow.encode(text, 3), repr(text)


def test_alignment_small_segments(spark):
    """Surpluses, dictionaries and counts add up over segments, however small."""
    rows = [(i, t) for i, t in enumerate(["aaa aaaa", "aaaaa aaa", "hello hello", None, "aaa aaaa", "", "hello aaaaaaa"] * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert alignment.cut_corpus(docs, *paths(), segment_docs=2).select("segment").distinct().count() == 11
    same([tuple(r) for r in alignment.align(docs, *paths(), segment_docs=2).collect()], aligned(rows))


def test_alignment_empty(none):
    assert alignment.align(none, *paths()).count() == 0
