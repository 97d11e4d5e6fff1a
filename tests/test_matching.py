"""One-to-one matching, remapping and placing of what comes back from outside."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import matching

BLOCK = "seq long, block_id string, file string, line int, text string"
SAID = "seq long, block_id string, file string, line string, text string, score double, reason string"


def base(path):
    return (path or "").replace("\\", "/").rsplit("/", 1)[-1]


def norm(text):
    return " ".join((text or "").split())


def number(line):
    try:
        return int(line)
    except (TypeError, ValueError):
        return -1


def brute(blocks, said):
    """Tier after tier, both sides in order, each consumed once."""
    out, left, right = {}, list(blocks), list(said)

    def take(tier, key_of, keys_of, ok=lambda b: True, good=lambda j: True):
        nonlocal left, right
        queues = defaultdict(list)
        for j in right:
            if good(j):
                queues[keys_of(j)].append(j)
        for b in left:
            if ok(b) and queues[key_of(b)]:
                out[b[0]] = (queues[key_of(b)].pop(0)[0], tier)
        used = {v[0] for v in out.values()}
        left, right = [b for b in left if b[0] not in out], [j for j in right if j[0] not in used]

    last = {j[1]: j for j in right if j[1] is not None}
    seen = set()
    for b in left:
        if b[1] in last and b[1] not in seen and b[1] is not None:
            seen.add(b[1])
            out[b[0]] = (last[b[1]][0], "id")
    used = {v[0] for v in out.values()}
    left, right = [b for b in left if b[0] not in out], [j for j in right if j[0] not in used]
    take("origin", lambda b: (base(b[2]), b[3], norm(b[4])), lambda j: (base(j[2]), number(j[3]), norm(j[4])), lambda b: norm(b[4]), lambda j: norm(j[4]))
    take("line", lambda b: (base(b[2]), b[3]), lambda j: (base(j[2]), number(j[3])), good=lambda j: not norm(j[4]))
    take("text", lambda b: norm(b[4]), lambda j: norm(j[4]), lambda b: norm(b[4]), lambda j: norm(j[4]))
    return out


@pytest.mark.parametrize("stretch", [3, 100_000])
def test_matching_matches_brute_force(spark, stretch):
    rng = random.Random(stretch)
    texts = ["same words here", "same  words\nhere", "other", "", None, "third text"]
    names = ["/a/x.md", "/b/x.md", "y.md", "c:\\z\\y.md", None]
    blocks = [(i, rng.choice([f"b{i}", f"b{i}", None]), rng.choice(names), rng.choice([1, 2, 3, None]), rng.choice(texts)) for i in range(160)]
    said = [(i, rng.choice([f"b{rng.randrange(200)}", "old", None]), rng.choice(names), rng.choice(["1", "2", "3", "x", None]), rng.choice(texts), 0.5, "r") for i in range(140)]
    got = matching.match_judgments(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(said, SAID), stretch).collect()
    assert len({r.block_seq for r in got}) == len({r.judgment_seq for r in got}) == len(got)
    want = brute(blocks, said)
    assert {r.block_seq: (r.judgment_seq, r.tier) for r in got} == want
    assert {t for _, t in want.values()} == set(matching.TIERS)


def test_equal_texts_in_several_files_get_a_judgment_each(spark):
    blocks = [(0, "n0", "a/one.html", 3, "Same text"), (1, "n1", "a/two.html", 3, "Same text"), (2, "n2", "a/three.html", 9, "Same text")]
    said = [(0, "gone", "two.html", "3", "Same text", 0.9, "two"), (1, "gone", "nowhere.html", "1", "Same  text", 0.4, "any"), (2, "gone", None, None, "Never scanned", 0.8, "new")]
    got = matching.judged_blocks(spark.createDataFrame(blocks, BLOCK), spark.createDataFrame(said, SAID)).collect()
    assert {(r.file, r.reason, r.tier) for r in got} == {("a/two.html", "two", "origin"), ("a/one.html", "any", "text"), ("a/three.html", None, None), (None, "new", "unmatched")}


def test_findings_are_placed_by_id_or_by_line_and_wording(spark):
    blocks = [(0, "a", "d/f.md", 1, "The whole  sentence stands here"), (1, "b", "e/f.md", 1, "Another one"), (2, "c", "f.md", 2, "x")]
    asked = [(0, "c", None, None, "?"), (1, "old", "f.md", "1", "sentence stands"), (2, "old", "f.md", "1", "say Another one more"), (3, "old", "f.md", "1", ""), (4, "old", "f.md", "9", "x"), (5, None, "f.md", "2", None)]
    got = matching.locate_findings(spark.createDataFrame(asked, BLOCK.replace("line int", "line string")), spark.createDataFrame(blocks, BLOCK))
    assert {(r.finding_seq, r.block_seq) for r in got.collect()} == {(0, 2), (1, 0), (2, 1), (3, 0), (5, 2)}


def test_spans_move_to_the_earlier_runs_ids(spark):
    blocks = spark.createDataFrame([(0, "new1", "f", 1, "t"), (1, "new2", "f", 2, "t")], BLOCK)
    pipeline = spark.createDataFrame([(0, "p1", "f", 1, "t"), (1, "p1b", "f", 1, "t"), (2, "p9", "g", 4, "gone"), (3, "", "f", 2, "t"), (4, None, "f", 2, "t")], BLOCK)
    spans = spark.createDataFrame([("new1", 0.5), ("new2", 0.6), ("zzz", 0.7)], "block_id string, score double")
    moved, known = matching.remap_spans(spans, blocks, pipeline)
    assert {tuple(r) for r in moved.collect()} == {("p1b", 0.5), ("new2", 0.6), ("zzz", 0.7)}
    assert {(r.block_id, r.text) for r in known.collect()} == {("new1", "t"), ("new2", "t"), ("p1", "t"), ("p1b", "t"), ("p9", "gone")}


def test_nothing_to_match(spark):
    none, some = spark.createDataFrame([], SAID), spark.createDataFrame([(0, "a", "f", 1, "t")], BLOCK)
    assert matching.match_judgments(some, none).count() == 0
    assert matching.judged_blocks(some, none).filter(F.col("tier").isNull()).count() == 1


def test_agents_get_candidates_and_their_judgments_are_merged(spark):
    import json

    from glyphmill.operators import agents

    blocks = spark.createDataFrame([(0, "a", "f.md", 1, "Text a", None), (1, "b", "f.md", 2, "Text b", "it"), (2, "c", "g.md", 1, "Text c", None)], BLOCK + ", language_hint string")
    spans = spark.createDataFrame([("a", 5, 9, 0.4, "later", None), ("a", 0, 4, 0.26, "first", None), ("b", 0, 4, 0.9, "broken", "boom"), ("c", 0, 4, 0.24, "weak", None)], "block_id string, start int, end int, score double, explanation string, error string")
    found = agents.candidates(blocks, spans)
    assert [tuple(r) for r in found.collect()] == [("a", "f.md", 1, "Text a", "en", 0.26, "first")]
    lines = agents.payload_lines(found, blocks).collect()
    assert sorted(r.kind for r in lines) == ["block"] * 3 + ["candidate"] and {json.loads(r.value)["language"] for r in lines if r.kind == "block"} == {"en", "it"}
    assert tuple(agents.payload_totals(found, blocks).first()) == (3, 1, 0.25)
    said = spark.createDataFrame([(0, "old", "x/f.md", "1", "Text  a", 0.1, "no"), (1, "c", None, None, None, 0.8, "yes"), (2, None, None, None, "Elsewhere", 0.5, None)], SAID)
    got = {(r.seq, r.block_id): (r.score, r.source, r.explanation) for r in agents.merged_report(blocks, spans, said).collect()}
    assert got == {(0, "a"): (0.4, "agent+offline", "agent: no (score=0.10); offline: later"), (2, "c"): (0.8, "agent+offline", "agent: yes (score=0.80); offline: weak"), (None, None): (0.5, "agent", "agent:  (score=0.50)")}


def test_browser_audits_join_their_documents(spark):
    from glyphmill.operators import findings

    schema = "seq long, source string, rule_id string, engine string, severity string, selector string, snippet string"
    own = spark.createDataFrame([(1, "p", "image-alt", "static", "serious", "html > img", '<img src="a">'), (2, "q", "image-alt", "static", "serious", "html > img", '<img src="a">'), (3, "r", "x", "static", "minor", "s", "<p>")], schema)
    found = spark.createDataFrame([(10, "p", "axe:image-alt", "axe", "critical", "img", '<img src="a">'), (11, "q", "axe:image-alt", "axe", "critical", "img", '<img src="a">'), (12, "p", "axe:label", "axe", "minor", "input", "<input>")], schema)
    audits = spark.createDataFrame([("p", None), ("q", "timeout")], "source string, error string")
    merged, failed = findings.with_browser(own, audits, found, spark.createDataFrame([], "source string, key string, n long"))
    got = {(r.source, r.rule_id): (r.severity, r.also_found_by) for r in merged.collect()}
    assert got == {("p", "image-alt"): ("critical", ["axe"]), ("q", "image-alt"): ("serious", []), ("r", "x"): ("minor", []), ("p", "axe:label"): ("minor", [])}
    assert [tuple(r) for r in failed.collect()] == [("q", "timeout")]
