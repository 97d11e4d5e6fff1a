"""Text functions and detectors on small texts."""

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.functions.suggestions import SUGGESTIONS
from glyphmill.operators import characters, edits, findings, style


def one(spark, column, **values):
    names = ", ".join(f"{k} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(("text", "language"), [("Привіт, як справи сьогодні", "uk"), ("Save", None), ("questo è un testo che non finisce", "it"), ("this is an ordinary English line", "en"), ("This pаssword has one odd letter", "en")])
def test_language(spark, text, language):
    assert one(spark, T.guess_language_or_null(F.col("t")), t=text) == language


def test_sentences_keep_abbreviations(spark):
    got = one(spark, T.sentences(F.col("t"), F.lit("en")), t="Dr. Smith came. He left!  Then e.g. nothing. End")
    assert got == ["Dr. Smith came.", "He left!", "Then e.g. nothing.", "End"]
    assert one(spark, T.sentences(F.col("t"), F.lit("it")), t="Vedi es. questo. Poi basta.") == ["Vedi es. questo.", "Poi basta."]


@pytest.mark.parametrize(
    ("u", "r", "d", "structural", "cliches", "score"),
    [(0.5, 0.5, 0.5, False, [], 0.5), (0.5, 0.5, 0.5, False, ["in conclusion"], 0.65), (0.5, 0.5, 0.5, False, ["seamless"], 0.55), (0.5, 0.5, 0.5, True, [], 0.625), (None, None, None, False, [], 0.0), (1.0, None, None, False, [], 1.0)],
)
def test_combine_score(spark, u, r, d, structural, cliches, score):
    df = spark.createDataFrame([(u, r, d, cliches)], "u double, r double, d double, c array<string>")
    got = df.select(T.combine_score(F.col("u"), F.col("r"), F.col("d"), F.lit(structural), F.col("c")).alias("s")).first()[0]
    assert got == pytest.approx(score)


def blocks(spark, *texts, language=None):
    return spark.createDataFrame([(i, t, language) for i, t in enumerate(texts)], "block_id int, text string, language_hint string")


def test_signals_are_null_when_too_short(spark):
    row = style.signals(blocks(spark, "One short line. And another.")).first()
    assert (row["uniformity"], row["repetition"], row["dashes"]) == (None, None, None)


def test_style_findings_charge_their_own_sentence(spark):
    text = "It's not just quick, but sturdy. Plain words stand here. In conclusion, we stop."
    rows = style.style_findings(blocks(spark, text, language="en")).orderBy("start").collect()
    assert [text[r["start"] : r["end"]] for r in rows] == ["It's not just quick, but sturdy.", "Plain words stand here.", "In conclusion, we stop."]
    assert rows[0]["structural"] == ["not just quick, but"]
    assert [r["cliches"] for r in rows] == [[], [], ["in conclusion"]]
    assert [r["structural"] for r in rows[1:]] == [[], []]
    assert style.style_findings(blocks(spark, None, "   ")).count() == 0


def test_phrases_need_word_ends(spark):
    assert style.cliches is not None
    df = spark.createDataFrame([("arguably",), ("unarguably",), ("ARGUABLY so",)], "t string")
    assert [r[0] for r in df.select(style.cliches(F.col("t"), F.lit("en"))).collect()] == [["arguably"], [], ["arguably"]]


def found(spark, text, language="en", **options):
    df = spark.createDataFrame([(0, text, language)], "block_id int, text string, language string")
    return [(r["start"], r["end"], r["original"], r["replacement"], r["category"]) for r in characters.anomalies(df, **options).orderBy("start").collect()]


def test_characters(spark):
    assert found(spark, "plain text") == []
    assert found(spark, "a​b c") == [(1, 2, "​", "", "invisible"), (3, 4, " ", " ", "space")]
    assert found(spark, "wait——now…") == [(4, 6, "——", "--", "typography"), (9, 10, "…", "...", "typography")]
    assert found(spark, "«так»", "uk") == []
    assert found(spark, "«so»") == [(0, 1, "«", '"', "typography"), (3, 4, "»", '"', "typography")]
    assert found(spark, "the pаssword") == [(5, 6, "а", "a", "homoglyph")]
    assert found(spark, "this is а test") == [(8, 9, "а", None, "homoglyph")]
    assert found(spark, "Ａ𝐁") == [(0, 2, "Ａ𝐁", "AB", "styled")]
    assert found(spark, "x &mdash; y") == [(2, 9, "&mdash;", "-", "typography")]
    assert found(spark, "x &mdash; — y", categories=("space",)) == [(2, 9, "&mdash;", "-", "typography")]


def test_clean_text_leaves_what_needs_review(spark):
    df = spark.createDataFrame([(0, "a​b — c… this is а test", "en"), (1, "same", "en"), (2, None, "en")], "block_id int, text string, language string")
    assert {r[0]: r[1] for r in characters.clean_text(df).select("block_id", "text").collect()} == {0: "ab - c... this is а test", 1: "same", 2: None}


def test_edits(spark):
    texts = spark.createDataFrame([("a", "hello cruel world"), ("b", "keep")], "path string, text string")
    rows = [("a", 0, 5, "hello", "HELLO", False), ("a", 3, 8, "lo cr", "x", False), ("a", 6, 11, "cruel", "", True), ("a", 12, 17, "WORLD", "w", False), ("a", 12, 17, "world", "", False), ("c", 0, 1, "x", "y", False)]
    table = spark.createDataFrame(rows, "path string, start int, end int, original string, new string, allow_empty boolean")
    status = {(r["path"], r["start"], r["original"]): r["status"] for r in edits.plan_edits(table, texts).collect()}
    assert status == {("a", 0, "hello"): "applied", ("a", 3, "lo cr"): "overlap", ("a", 6, "cruel"): "applied", ("a", 12, "WORLD"): "stale", ("a", 12, "world"): "no-text", ("c", 0, "x"): "missing"}
    assert {r["path"]: r["text"] for r in edits.apply_edits(table, texts).collect()} == {"a": "HELLO  world", "b": "keep"}


def test_suggestions(spark):
    table = {k: {p: r for p, r in t.items() if r is not None} for k, t in SUGGESTIONS.items()}
    df = spark.createDataFrame([("Furthermore, we ship it.",), ("Plain prose here.",), ("We work — hard.",)], "t string")
    got = [r[0] for r in df.select(edits.suggest(F.col("t"), F.lit("en"), {"en": table["en"]})).collect()]
    assert got == ["We ship it.", None, "We work, hard."]


def test_rates(spark):
    df = spark.createDataFrame([("model", 0.5), ("model", 0.2), ("human", 0.4), ("human", 0.1)], "label string, score double")
    row = findings.rates(df, [0.33]).first()
    assert (row["precision"], row["recall"], row["false_alarms"]) == (0.5, 0.5, 1)
    assert findings.rates(df.filter("label = 'none'"), [0.33]).count() == 0
    assert findings.rates(df, [0.9]).first()["precision"] is None


def test_rescoring(spark):
    row = [(0, "a/b.md", "p", "t", "style", None, 0.6, 0.2, None, ["not just x but"], ["in conclusion", "arguably"], 0.7, "high")]
    df = spark.createDataFrame(row, "block_id int, source string, dom_path string, text string, kind string, category string, uniformity double, repetition double, dashes double, structural array<string>, cliches array<string>, score double, confidence string")
    sup = lambda *rows: spark.createDataFrame(list(rows), "kind string, value string")
    less = findings.filter_findings(df, sup(("phrase", "Arguably"))).first()
    assert less["cliches"] == ["in conclusion"] and less["score"] < 0.7 and less["suppressed"]
    assert findings.filter_findings(df, sup(("rule", "structural"), ("phrase", "arguably"), ("phrase", "in conclusion"), ("rule", "uniformity"), ("rule", "repetition"))).count() == 0
    assert findings.filter_findings(df, sup(("path", "a/"))).count() == 0
    assert findings.filter_findings(df, sup(("path", "*.md"))).count() == 0
    same = findings.filter_findings(df, sup(("path", "z/"))).first()
    assert (same["score"], same["suppressed"]) == (0.7, False)


def test_urls(spark):
    pairs = [("https://a.b/x/y", "../z?q#f", "https://a.b/z?q"), ("https://a.b/x/", "c", "https://a.b/x/c"), ("https://a.b", "/k/", "https://a.b/k"), ("https://a.b/x", "//c.d/e", "https://c.d/e"), ("https://a.b/x?y", "?n", "https://a.b/x?n")]
    df = spark.createDataFrame(pairs, "b string, h string, w string")
    for got, want in df.select(T.normalise_url(T.resolve_url(F.col("b"), F.col("h"))), "w").collect():
        assert got == want
    assert one(spark, T.host_key(F.col("u")), u="https://WWW.Example.com:8080/x") == "example.com:8080"
    assert one(spark, T.host_key(F.col("u")), u="http://www.example.com:80/x") == "example.com"


def test_contrast(spark):
    assert one(spark, T.contrast(T.colour(F.col("a")), T.colour(F.col("b"))), a="white", b="#000") == pytest.approx(21.0)
    assert one(spark, T.colour(F.col("a")), a="rgba(1, 2.5, 3, .4)") == [1, 2, 3]
    assert one(spark, T.colour(F.col("a")), a="inherit") is None
