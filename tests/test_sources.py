"""Files, lists and payloads."""

import pytest
from pyspark.sql import functions as F

from glyphmill.operators.code_blocks import code_blocks, extract, is_content, is_key, is_technical
from glyphmill.sources import files, payloads


def test_scan(spark, tmp_path):
    for path, data in {"a.html": b"<p>x</p>", "node_modules/b.html": b"x", "src/c.py": b"x = 1", "src/d.txt": b"x", "locales/en.json": b"{}", "e.html": b"\xff\xfe", "big.html": b"x" * 3000}.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_bytes(data)
    got = {r["path"]: (r["text"] is not None, r["error"]) for r in files.scan_files(spark, str(tmp_path), files.CONTENT, max_bytes=2000).collect()}
    assert got == {"a.html": (True, None), "src/c.py": (True, None), "locales/en.json": (True, None), "e.html": (False, "not UTF-8"), "big.html": (False, "too large")}
    assert files.scan_files(spark, str(tmp_path), files.CONTENT, max_files=2).count() == 2


def test_suppression_file(spark):
    lines = ["house style", "# note", "[rules]", "seo-canonical", "[nonsense]", "alt", "[ Paths ]", "dist/", "dist/"]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(lines)], "file int, nth int, line string")
    assert sorted(tuple(r) for r in files.parse_suppressions(df).collect()) == [("path", "dist/"), ("phrase", "house style"), ("rule", "alt"), ("rule", "seo-canonical")]


def test_component_gives_only_what_it_renders():
    raw = 'const x = useState<Foo>(null); // <p>commented out text</p>\nreturn <p title="A visible title">Rendered text here {count} and more text</p>\n<T>(x)<b>t("menu.file.open")</b>'
    got = extract(raw, "a.tsx", "content", False)
    assert [t for *_, t, _ in got] == ["A visible title", "Rendered text here", "and more text"]
    assert all(raw[s:e] == t for s, e, t, _ in got)


def test_comments_and_locales(spark):
    raw = '"""A docstring that is clearly longer than forty characters."""\n# TODO something that is longer than forty characters long\nX = "Words of a constant here"'
    assert [k for *_, k in extract(raw, "a.py", "both", False)] == ["technical", "injected"]
    rows = spark.createDataFrame([("locales/en.json", '{"a.b": "Save {count} files", "k": "menu.open", "n": {"x": "Go"}}'), ("x.yml", 'title: "Hello there"\nkey: a.b.c'), ("locales/it.yaml", "t: 'Ciao'"), ("n.html", None)], "path string, text string")
    got = {(r["path"], r["text"]) for r in code_blocks(rows).collect()}
    assert {("locales/en.json", "Save {count} files"), ("locales/en.json", "Go"), ("locales/it.yaml", "Ciao")} <= got
    assert ("locales/en.json", "menu.open") not in got


def test_pathological_tag_is_linear():
    import time

    raw = "<div " + " ".join(f'a{i}="{{x}}"' for i in range(40)) + " <p>text that is long enough</p>" * 200
    began = time.time()
    extract(raw * 4, "a.tsx", "content", False)
    assert time.time() - began < 2


def test_names_lead_to_copy():
    of = lambda raw, path: [t for *_, t, _ in extract(raw, path, "content", False)]
    assert of("<p>Don't stop here, it's fine</p>", "a.html") == ["Don't stop here, it's fine"]
    assert of('<Card style={{a: 1}} :title="bound value here">Shown to readers</Card>', "a.vue") == ["Shown to readers"]
    assert of("x.textContent = 'It\\'s all done now'; y.value = 'not for readers'", "a.js") == ["It\\'s all done now"]
    assert of('i18n.t("Hello dear reader"); i18n.x("Hello other one"); this.$tc("Hello third one")', "a.js") == ["Hello dear reader", "Hello third one"]
    assert of('{"title": `Words of a title`, "other": "Words of no title"}', "a.js") == ["Words of a title"]
    assert of('raise E(detail="Words of a detail")\nx = _("Marked for translation")\n  y = "Not a constant"\n# title="In a comment here"', "a.py") == ["Words of a detail", "Marked for translation"]
    assert of('echo "Words that are echoed"; {{ \'Words of a template\' }}', "a.php") == ["Words that are echoed", "Words of a template"]
    assert of('flash[:notice] = "Saved your changes" <%= "Words in a page" %>', "a.erb") == ["Saved your changes", "Words in a page"]
    assert of("<script>t('Not read in scripts')</script><!-- <p>nor in comments</p> --><T>nor parameters of types</T>", "a.html") == []
    assert of("<p>Words /* with a comment */ inside</p>", "a.tsx") == []  # not as it stands in the file


@pytest.mark.parametrize("text", ["${a} is the name", "https://a.b/c d", "text/x-markdown", "snake_case_name", "src/app/main.ts", "../up/one", ".card > .title", "DD/MM/YYYY", "%Y-%m-%d"])
def test_technical_shapes(text):
    assert is_technical(text) and not is_content(text)


@pytest.mark.parametrize("text", ["a => b and more", "function (x) and more", "return the value", "ends like this;", "let there be x", "CONSTANT_NAME", "short", "12345678 90", "// a comment here"])
def test_what_is_no_copy(text):
    assert not is_content(text)


def test_references_and_words_are_copy():
    assert is_content("Tom &amp; Jerry&nbsp;") and is_content("Exported yesterday, functional again") and not is_key("Hello. There")


@pytest.mark.parametrize("piece", ["<a x= \"", "<a {", "{", "='", "title=\"", "/*", "<!--", "A.-", "<script", '"', "\\'", "  ", "#", "<p '<p \"", "A='x' "])
def test_hostile_files_are_linear(piece):
    import time

    began = time.time()
    for path in ("a.tsx", "a.py", "a.erb"):
        extract(piece * (300_000 // len(piece)), path, "both", False)
    extract(piece * (300_000 // len(piece)), "en.json", "both", True)
    assert time.time() - began < 10


def test_payloads(spark):
    of = lambda s: spark.createDataFrame([("p", s)], "source string, payload string")
    bad = payloads.axe_issues(of("not json")).first()
    assert (bad["rule_id"], bad["details"]["engine_error"]) == ("axe", "engine returned a non-JSON result")
    assert payloads.axe_issues(of('{"error": "timeout"}')).first()["details"]["engine_error"] == "timeout"
    assert payloads.htmlcs_issues(of('{"messages":[{"type":3,"code":"x","msg":"m","tag":"t","html":"h"}]}')).count() == 0
    assert [r["rule_id"] for r in payloads.measurement_issues(of('{"domNodes": 2000, "loadComplete": 1}')).collect()] == ["perf-dom-size"]


def test_judge_quotes(spark):
    df = spark.createDataFrame([("a", "one two three", 'Sure: {"findings":[{"quote":"two","score":1.4,"reason":"r"},{"quote":"zzz","score":0.5}]} ok'), ("b", "x", "no")], "block_id string, text string, reply string")
    got = sorted((r["block_id"], r["start"], r["end"], r["score"], r["error"]) for r in payloads.judge_spans(df).select("block_id", "start", "end", "score", F.coalesce("error", F.lit("")).alias("error")).collect())
    assert got == [("a", 0, 13, 0.5, ""), ("a", 4, 7, 1.0, ""), ("b", 0, 1, 0.0, "reply is not JSON")]
