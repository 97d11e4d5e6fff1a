"""Reports on small cases: both offline detectors as one relation, markers, what doesn't print, lists of suppressions."""

from pyspark.sql import functions as F

from glyphmill.operators import reports


def test_offline_findings_place_both_detectors(spark):
    text = "Plain words stand here and say little of note to anyone. Furthermore, it is important to note the seamless a\u200bb integration."
    blocks = spark.createDataFrame([("b", "f.md", 3, 100, text, "en"), ("c", "f.md", 9, 500, "Nothing odd here.", "en"), ("d", "f.md", 9, 600, None, None)], "block_id string, file string, line int, start int, text string, language_hint string")
    found = reports.in_order(reports.offline_findings(blocks)).collect()
    assert {r.source for r in found} == {"style", "characters"} and {r.block_id for r in found} == {"b"}
    assert all(text[r.offset - 100 : r.end_offset - 100] == r.text and r.detector == "offline" for r in found)
    assert [r.offset for r in found] == sorted(r.offset for r in found)
    assert all(r.confidence != "low" for r in found if r.source == "style")


def test_split_marked(spark):
    cases = [
        ("<<<1>>>\na\nb\n <<<2>>> \nc", ["a\nb", "c"]),
        ("lead\n<<<1>>>\nsay <<<2>>> inside\n<<<2>>>\nc\n<<<3>>>", ["say <<<2>>> inside", "c\n<<<3>>>"]),
        ("<<<2>>>\na\n<<<1>>>\nb", None),
        ("<<<1>>>\n\n<<<2>>>\nb", None),
        ("", None),
        (None, None),
    ]
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(cases)], "k int, a string").select("k", reports.split_marked(F.col("a"), 2).alias("p")).collect()
    assert {r.k: r.p for r in rows} == {k: w for k, (_, w) in enumerate(cases)}


def test_visible(spark):
    cases = {"plain": "plain", "a​b\n": "a<U+200B>b<U+000A>", "x\U000e0001😀": "x<U+E0001>😀", "  ": " <U+00A0>"}
    rows = spark.createDataFrame([(c,) for c in cases], "t string").select("t", reports.visible(F.col("t")).alias("v")).collect()
    assert {r.t: r.v for r in rows} == cases


def test_unjudged_without_errors_and_with_many(spark):
    schema = "seq long, error string"
    assert reports.unjudged(spark.createDataFrame([(1, None)], schema)).first().n == 0
    many = reports.unjudged(spark.createDataFrame([(k, f"e{k % 5}") for k in range(10)], schema)).first()
    assert (many.n, many.reasons, many.more) == (10, ["e0", "e1", "e2"], 2)


def test_suppressions_are_added_once_and_written_in_sections(spark):
    known = spark.createDataFrame([("phrase", "in fact"), ("path", "out/")], "kind string, value string")
    more = spark.createDataFrame([("fingerprint", "abc "), ("phrase", "in fact")], "kind string, value string")
    once = reports.add_suppressions(known, more)
    lines = [r.line for r in reports.suppression_lines(reports.add_suppressions(once, more)).collect()]
    assert lines == ["[fingerprints]", "abc", "[paths]", "out/", "[phrases]", "in fact"]


def test_merge_judgments_takes_the_higher_score_and_drops_the_weak(spark):
    offline = spark.createDataFrame([("a", 0.4, "style", "x"), ("b", 0.2, "style", "y"), ("c", 0.1, None, None)], "block_id string, score double, source string, explanation string")
    judged = spark.createDataFrame([("a", 0.1, "human", 1), ("c", 0.9, None, 2), ("c", 0.0, "later", 3)], "block_id string, score double, reason string, seq int")
    found = {r.block_id: (r.score, r.source, r.explanation) for r in reports.merge_judgments(offline, judged).collect()}
    assert found == {"a": (0.4, "agent+offline", "agent: human (score=0.10); offline: x"), "c": (0.9, "agent+offline", "agent:  (score=0.90); offline: ")}


def test_review_candidates(spark):
    from glyphmill.operators.review import review_candidates
    from glyphmill.sources.dom import nodes

    html = (
        '<body><h1>Top</h1><p>First <b>words</b>.</p><div><h3>In</h3><p>inner</p></div>loose<h2>Next</h2><script>no()</script><p>after</p>'
        '<img alt=" a cat " src="c.png"><img src="d.png"><a href="/x">here</a><a>no target</a><button aria-label="Close"></button><button></button><h4></h4></body>'
    )
    docs = spark.createDataFrame([(1, html), (2, ""), (3, None)], "doc_id long, html string")
    found = {(r.kind, r.text): r.context for r in review_candidates(nodes(docs, "doc_id", "html")).collect()}
    assert found == {
        ("heading", "Top"): "First words . In inner", ("heading", "In"): "inner", ("heading", "Next"): "after here no target",
        ("img", "a cat"): "c.png", ("link", "here"): "/x", ("button", "Close"): "",
    }
