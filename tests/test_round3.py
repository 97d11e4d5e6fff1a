"""Findings of round 3: what failed on larger tables, or differed from SQL there."""

from pyspark.sql import functions as F

from glyphmill.functions import text as T
from glyphmill.operators import characters, style


def _generated(df):
    """Rows that the generators of an executed plan made."""
    df.collect()
    made, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if plan.nodeName() == "Generate":
            made += plan.metrics().apply("numOutputRows").value()
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return made


def test_characters_make_rows_of_matches_not_of_all_characters(spark):
    text = "plain words stand here " * 500 + "a​b pаss а \U0001d49cа and a “quote”" + " more of them" * 500
    blocks = spark.createDataFrame([(1, text, "en")], "block_id int, text string, language string")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = characters.anomalies(blocks)
        assert _generated(found) < 100
        at = text.index("​")
        assert [(r.start, r.original, r.replacement, r.category) for r in found.orderBy("start").collect()] == [
            (at, "​", "", "invisible"), (at + 4, "а", "a", "homoglyph"), (at + 8, "а", None, "homoglyph"), (at + 10, "\U0001d49c", "A", "styled"),
            (at + 19, "“", '"', "typography"), (at + 25, "”", '"', "typography"),
        ]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_suggestions_of_all_languages_go_by_pieces(spark):
    from pyspark.sql import functions as F

    from glyphmill.functions.suggestions import SUGGESTIONS
    from glyphmill.operators import edits

    tables = {lang: {p: r for p, r in t.items() if r is not None} for lang, t in SUGGESTIONS.items()}
    rows = [("In the era of x. ARGUABLY fine: in the era of y\nIn this day and age", "en"), ("nothing here. nor here", "it"), ("In the era of x", None)]
    found = spark.createDataFrame(rows, "t string, l string").select(edits.suggest(F.col("t"), F.col("l"), tables).alias("s"))
    assert [r.s for r in found.collect()] == ["In x. fine: in y\nNow", "Nothing here. nor here", "In x"]


def test_pages_that_share_a_url_are_told_apart(spark, tmp_path):
    import duckdb

    from glyphmill.plans import operation_queries, page_queries

    html = '<html><head></head><body><h1>x</h1></body></html>'
    spark.createDataFrame([(i, f"https://x.example/{i // 3}", html) for i in range(12)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for module, name in ((page_queries, "deduplicated_issues"), (page_queries, "merged_widths"), (operation_queries, "browser_merge")):
        found = module.QUERIES[name](spark, str(tmp_path))
        wanted = con.execute(module.SQL[name])
        names = [d[0] for d in wanted.description]
        assert sorted(found.columns) == sorted(names)
        assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall())), name


def test_sheets_and_trails_wait_for_no_joins(spark):
    """the rows with all that rules ask for were made once for each of four readers."""
    from pyspark.sql import functions as F

    from glyphmill.operators import audit

    html = '<html><head><style>p{width:700px}</style></head><body><div class="breadcrumb x"><p>no item</p></div><div class="breadcrumb"><i><a href="/x">x</a></i></div><li>y</li></body></html>'
    found = audit.audit(spark.createDataFrame([(1, "u", "page", html)], "doc_id long, source string, kind string, html string"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") <= 14
    assert [r.selector.split(" > ")[-1] for r in found.filter("rule_id = 'breadcrumb-markup'").collect()] == ["div:nth-of-type(2)"]
    assert found.filter(F.col("rule_id") == "viewport-fixed-width").count() == 1


def test_findings_carry_their_words_and_lines(spark):
    """texts were shuffled to meet their findings, and read from the start for each."""
    from glyphmill.operators import registry

    text = "Plain\nwords — stand\n\nhere… Furthermore, it is important to note\n"
    blocks = spark.createDataFrame([(1, text, "en"), (2, None, "en")], "block_id int, text string, language_hint string")
    found = registry.default_registry().run(blocks, "phrases", "phrase-load", "odd-characters", placed=True)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    rows = found.collect()
    assert {(r.detector, r.text, r.line) for r in rows if r.detector == "odd-characters"} == {("odd-characters", "—", 2), ("odd-characters", "…", 4)}
    assert {r.line for r in rows if r.detector == "phrases"} == {4} and all(r.text == text[r.start : r.end] for r in rows if r.detector == "phrases")
    assert [(r.text, r.line) for r in rows if r.detector == "phrase-load"] == [("", 1)]


def test_phrases_are_looked_for_by_folded_text():
    """folding is no narrower than matching without regard to case."""
    import regex

    from glyphmill.functions.lexicon import CLICHES
    from glyphmill.operators.registry import Phrases, fold

    every = "".join(chr(i) for i in range(0x20000) if not 0xD800 <= i < 0xE000)
    for p in {c for ps in CLICHES.values() for phrase in ps for c in phrase}:
        assert {fold(m) for m in regex.findall(regex.escape(p, literal_spaces=True), every, regex.I)} == {fold(p)}
    assert {w for *_, w in Phrases().spans("ſeamleSS, İT İS İMPORTANT TO NOTE", "en")} >= {"it is important to note"}


def test_words_of_issues_are_broadcast(spark):
    """F16: issues were dealt by their rule, of which there are few."""
    from glyphmill.operators import reports

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        issues = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "rule_id string")
        templates = spark.createDataFrame([("a", "en", "A"), ("a", "it", "Aa"), ("b", "en", "B")], "key string, language string, template string")
        worded = reports.worded(issues, templates, "it")
        plan = worded._jdf.queryExecution().executedPlan().toString()
        assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan
        assert sorted((r.rule_id, r.message) for r in worded.collect()) == [("a", "Aa"), ("a", "Aa"), ("b", "B"), ("c", "c")]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_starts_of_consecutive_pieces(spark):
    """Running sums of a text's chunk lengths, across the runs that they are made in."""
    rows = [(i, [(k * 7 + i) % 5 for k in range(n)]) for i, n in enumerate((1, 2, 255, 256, 257, 512, 513, 1500))]
    got = {r.i: r.s for r in spark.createDataFrame(rows, "i int, n array<int>").select("i", T.running_starts(F.col("n")).alias("s")).collect()}
    assert got == {i: [sum(n[:k]) for k in range(len(n))] for i, n in rows}


def test_sentences_stay_in_their_texts_row(spark):
    """No shuffle, and a sentence doesn't carry the constructions of its whole text; long texts keep their offsets."""
    text = " ".join(f"It is not just number {k} but  more. Plain words stand here!" for k in range(700))
    found = style.style_findings(spark.createDataFrame([(1, text, "en"), (2, " \n One. ", "en"), (3, "", "en"), (4, None, "en")], "block_id long, text string, language_hint string"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = sorted(found.collect(), key=lambda r: (r.block_id, r.start))
    assert [(r.block_id, text[r.start : r.end]) for r in rows if r.block_id == 1] == [(1, r.text) for r in rows if r.block_id == 1] and len(rows) == 1401
    assert [len(r.structural) for r in rows if r.block_id == 1] == [1, 0] * 700
    assert [(r.block_id, r.start, r.end, r.text) for r in rows if r.block_id > 1] == [(2, 3, 7, "One.")]


def test_mean_length_of_sentences_is_made_once(spark):
    """within the sum over a text's sentences it was made anew for each, so the work grew with the square of their number."""
    texts = F.array(*[F.lit(t) for t in ("one two", "one", "one two three four")])
    assert str(T.uniformity(texts)).count("aggregate(") == 2


def test_tiers_of_judgments_carry_no_texts(spark, monkeypatch):
    """every tier ranked, joined and wrote whole wordings; a digest says whether they are equal."""
    from glyphmill.operators import matching

    kept = []
    monkeypatch.setattr(matching, "settle", lambda df: (kept.append(df), df)[1])
    long = "word " * 10_000
    row = lambda i, text: (i, None, "a/f.md", 1, text)
    blocks = spark.createDataFrame([row(1, long), row(2, f" {long}\n"), row(3, long + "x"), row(4, ""), row(5, None)], "seq long, block_id string, file string, line int, text string")
    judged = spark.createDataFrame([row(7, long), row(8, long.replace(" ", "  ")), row(9, " ")], "seq long, block_id string, file string, line string, text string")
    found = sorted(tuple(r) for r in matching.match_judgments(blocks, judged).collect())
    assert found == [(1, 7, "origin"), (2, 8, "origin"), (3, 9, "line")]
    sizes = [max((len(v) for r in df.collect() for v in r if isinstance(v, (str, bytes, bytearray))), default=0) for df in kept]
    assert max(sizes) == 32


def test_cyrillic_is_looked_for_by_one_range_first(spark):
    """the class of Cyrillic letters was looked for in every character of every text; a range that holds it all rules most out."""
    import re

    every = [chr(i) for i in range(0x20, 0x3000)]
    assert all(re.match(T._AROUND_CYRILLIC, c) for c in every if re.match(T._CYRILLIC, c))
    plan = str(T.guess_language_or_null(F.col("t")))
    assert 0 <= plan.find(T._AROUND_CYRILLIC) < plan.find(T._CYRILLIC)
    texts = ["слово plus four more words", "ґ є і ї а", "Ѐѐ ѝ ҂ Ѳ Ӿ", "one two three four five", "uno che due tre quattro", "a b c", "слово слово слово four more words of some length", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", T.guess_language_or_null(F.col("t")).alias("l")).collect()
    assert [r.l for r in sorted(rows)] == ["en", "uk", "en", "en", "it", None, "uk", "en"]


def test_tags_of_asked_names_alone(spark):
    """all tags of a source were written; those of names that no issue asks for are left out, the others are as they were."""
    from glyphmill.sources import tags

    text = """<div a='>'>\n<img alt="<img>"><p>x</p>\n  <IMG src=q><b\n><img></p><div"""
    every = list(tags.scan(text))
    for names in (frozenset({"img"}), frozenset({"p", "b"}), frozenset()):
        assert list(tags.scan(text, names)) == [r for r in every if r[4] in names]
    rows = spark.createDataFrame([("a", text, ["img"]), ("b", text, []), ("c", None, ["p"]), ("d", text, None)], "path string, text string, names array<string>")
    got = tags.source_tags(rows, names="names").collect()
    assert {(r.path, r.name) for r in got} == {("a", "img")} and len(got) == sum(r[4] == "img" for r in every)


def test_crossing_edits_go_without_a_call_per_source(spark):
    """a Python call per source; now one pass over sources in order, through batches that cut them."""
    import random

    from glyphmill.operators import fixes

    dice, rows = random.Random(3), []
    for p in range(40):
        for s in range(dice.randint(1, 12)):
            start = dice.randint(0, 30)
            rows.append((f"p{p}", s, f"r{s}", start, start + dice.choice([0, 0, 1, 5, 20])))
    want = {}
    for path in {r[0] for r in rows}:
        low = high = -1
        by = None
        for r in sorted((r for r in rows if r[0] == path), key=lambda r: (r[3], r[4], r[1])):
            want[r[:2]] = by if r[3] < high and r[4] > low else None
            if want[r[:2]] is None and r[4] > high:
                low, high, by = r[3], r[4], r[2]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = fixes._first_of_overlapping(spark.createDataFrame(rows, "path string, seq long, rule_id string, start int, end int"))
        assert "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.path, r.seq): r.clash for r in found.collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_plain_tags_are_read_as_they_stand(monkeypatch):
    """quotes and brackets of every text were listed, though only tags with a `<` inside need that."""
    from glyphmill.sources import tags

    odd = "<p><a href='x>y' b=\"<img>\"><b"
    want = [r[1:3] for r in tags.scan(odd)]
    assert want == [(0, 3), (3, 27), (20, 25)]
    monkeypatch.setattr(tags, "tag_ends", lambda text: 1 / 0)
    assert [r[1:3] for r in tags.scan("<p><a href='x>y' b=\"it's\">\n</p>")] == [(0, 3), (3, 26), (27, 31)]
