"""Deep documents, source files as fragments, chosen files, versions, runs, batches and block products."""

import os
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import audit, batching, fragments, runs, similarity, versions
from glyphmill.sources import css, dom, files


def test_a_megabyte_of_nested_elements_is_linear():
    import resource

    before, began = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    rows = dom.parse("<div>" * 200_000)
    assert len(rows) == 200_000 and rows[-1].depth == 199_999 and rows[0].last == 199_999
    assert sum(len(dom.selector(r)) for r in rows[::1000]) < 200 * 1200
    assert time.time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300_000
    began = time.time()
    dom.parse("<div>x</p>" * 100_000)
    dom.parse("<span>x" * 60_000)
    assert time.time() - began < 20


def test_deep_pages_pass_the_audit(spark):
    page = "<html lang=en><body>" + "<div>" * 3000 + '<img src="a.png"><p>deep</p>'
    docs = spark.createDataFrame([(1, "s", "page", page)], "doc_id long, source string, kind string, html string")
    found = {r.rule_id: r for r in audit.audit(docs).collect()}
    assert "image-alt" in found and found["image-alt"].selector.startswith("…") and found["image-alt"].selector.endswith("img:nth-of-type(1)")


def test_selectors_of_usual_pages_are_whole():
    rows = dom.parse("<html><body><p>a</p><p>b<b>c</b></p></body></html>")
    assert [dom.selector(r) for r in rows if r.tag == "b"] == ["html:nth-of-type(1) > body:nth-of-type(1) > p:nth-of-type(2) > b:nth-of-type(1)"]


def test_blocks_for_small_screens_go_at_any_depth():
    deep = "@supports (x){@layer a{@media (max-width: 600px){@supports (y){.a{width:700px}}}p{width:800px}}}"
    assert css.without_small_blocks(deep) == "@supports (x){@layer a{p{width:800px}}}"
    assert css.without_small_blocks("@media (max-width:1200px){a{}}b{}") == "@media (max-width:1200px){a{}}b{}"
    assert css.without_small_blocks("a{}@media (max-width:500px){b{c") == "a{}" and css.without_small_blocks("a{}@media x") == "a{}"
    began = time.time()
    css.without_small_blocks("@media (max-width:1px){" * 100_000)
    assert time.time() - began < 5


def test_a_tag_may_hold_an_arrow_in_braces():
    row = dom.parse('<p>x</p>\n<img title={a > b ? "x" : "y"} alt="">after')[-2]
    assert (row.tag, row.line, row.snippet) == ("img", 2, '<img title={a > b ? "x" : "y"} alt="">')


COMPONENT = 'export function P({ f }) {\n  // the <img> is replaced\n  return <div>\n    <button onClick={f} aria-label="Close">x</button>\n    <label htmlFor="q">S</label>\n    <input id="q" value={q} />\n    <img src={u} />\n  </div>;\n}\n'


def test_fragments_keep_lines_and_pages_keep_their_rules(spark):
    rows = [
        ("src/P.vue", COMPONENT), ("public/index.html", '<html><body><button onclick="go()">Go</button></body></html>'), ("src/P.tsx", COMPONENT), ("src/test_page.html", "<img>"), ("a/x.min.html", "<img>"),
        ("notes.txt", "no markup"), ("none.vue", None), ("t.svelte", '<!-- <img> -->\n<img src="hero.png">\n'),
    ]
    found = fragments.audit_files(spark.createDataFrame(rows, "path string, text string")).collect()
    by = {(r.source, r.rule_id): r for r in found}
    assert {r.source for r in found} == {"src/P.vue", "public/index.html", "t.svelte"}
    assert by["src/P.vue", "image-alt"].line == 7 and by["t.svelte", "image-alt"].line == 2
    assert not {"bp-doctype", "document-title", "html-lang", "page-has-h1", "control-name", "bp-inline-handlers", "seo-image-dimensions"} & {r for s, r in by if s == "src/P.vue"}
    assert {"bp-doctype", "document-title", "bp-inline-handlers"} <= {r for s, r in by if s == "public/index.html"}
    assert sum(r.rule_id == "image-alt" for r in found) == 2
    components = fragments.audit_files(spark.createDataFrame(rows, "path string, text string"), skipped=(".py",))
    assert "src/P.tsx" in {r.source for r in components.collect()}


def test_files_are_chosen_before_they_are_read(spark, tmp_path):
    for name, text in {"a.html": "<p>", "b+c d.html": "ok", "z.html": "last", "node_modules/x.html": "no", "big.html": "x" * 5000, "q.css": "no", "sub/deep.vue": "v"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.html").write_bytes(b"\xff\xfe\xff")
    found = files.scan_files(spark, str(tmp_path), files.CONTENT, max_bytes=1000)
    assert {(r.path, r.text, r.error) for r in found.collect()} == {
        ("a.html", "<p>", None), ("b+c d.html", "ok", None), ("z.html", "last", None), ("sub/deep.vue", "v", None), ("big.html", None, "too large"), ("bad.html", None, "not UTF-8")
    }
    chosen = files.scan_files(spark, str(tmp_path), files.CONTENT, max_bytes=1000).filter("error is null or error <> 'too large'")
    plan = chosen._jdf.queryExecution().executedPlan()
    chosen.collect()
    text = plan.toString()
    assert "file_path" in text and "file_size" in text
    limited = files.scan_files(spark, str(tmp_path), files.CONTENT, max_files=3, max_bytes=1000)
    assert {r.path for r in limited.collect()} == {"a.html", "b+c d.html", "bad.html"}
    both, missing = files.collect_files(spark, [str(tmp_path / "sub"), str(tmp_path / "q.css"), str(tmp_path / "gone")], files.CONTENT)
    assert {(os.path.basename(r.root), r.path, r.text) for r in both.collect()} == {("sub", "deep.vue", "v"), ("q.css", "q.css", "no")} and missing == [str(tmp_path / "gone")]
    none, gone = files.collect_files(spark, [str(tmp_path / "gone")], files.CONTENT)
    assert none.count() == 0 and len(gone) == 1


def test_the_first_copy_comes_back(spark, tmp_path):
    store = versions.Versions(spark, f"file://{tmp_path}/v")
    of = lambda rows: spark.createDataFrame(rows, "path string, text string")
    state = lambda: {r.path: r.text for r in store.files().collect()}
    assert state() == {} and store.restore(of([("a", "")]).select("path")).first().outcome == "missing"
    first = {"a": "one", "b": "two\n", "c": None, "d": ""}
    store.commit(of(list(first.items())))
    store.commit(of([("a", "one more"), ("b", "two\n"), ("e", "new")]))
    store.commit(of([("a", "third"), ("d", "filled")]))
    assert state() == {"a": "third", "b": "two\n", "c": None, "d": "filled", "e": "new"}
    assert {r.path for r in store.changed().collect()} == {"a", "d"}
    said = {r.path: r.outcome for r in store.restore(of([("a", ""), ("b", ""), ("x", "")]).select("path")).collect()}
    assert said == {"a": "restored", "b": "unchanged", "x": "missing"}
    assert state() == {"a": "one", "b": "two\n", "c": None, "d": "filled", "e": "new"}
    assert {r.path: r.text for r in store.files(3).collect()}["a"] == "third"
    os.makedirs(tmp_path / "v" / "manifest" / "99")  # a commit that died: no mark
    assert store.current() == 4 and state()["a"] == "one"


def test_a_run_is_written_and_counted_in_one_pass(spark, tmp_path):
    rows = [("p", "image-alt", "critical", "accessibility"), ("p", "x", "minor", "seo"), ("q", "y", "minor", "seo"), ("q", "z", None, "other")]
    issues = spark.createDataFrame(rows, "source string, rule_id string, severity string, category string")
    folder = f"file://{tmp_path}/r"
    got = runs.write_report(issues, folder, "root", "audit", 1)
    assert got["total"] == 4 and got["by_severity"] == {"critical": 1, "serious": 0, "moderate": 0, "minor": 2} and got["by_category"]["seo"] == 2 and got["by_category"]["performance"] == 0
    runs.write_report(issues.limit(1), folder, "root", "audit", 2)
    runs.write_report(issues.filter("severity = 'minor'"), folder, "root", "audit", 2)  # a retry
    runs.write_report(issues.limit(0), folder, "root", "scan", 3)
    assert [(r.seq, r.total, r.previous) for r in runs.history(spark, folder).orderBy("seq").collect()] == [(1, 4, None), (2, 2, 4), (3, 0, None)]
    assert runs.report_rows(spark, folder, 2).count() == 2


def test_issue_lists_are_whole_and_worst_first(spark):
    import json

    rows = [("p", "b", 3, "seo", "minor"), ("p", "a", 1, "seo", "critical"), ("p", "c", None, "seo", "minor")]
    issues = spark.createDataFrame(rows, "source string, rule_id string, line int, category string, severity string").withColumns({c: F.lit("x") for c in ("confidence", "selector", "snippet", "fix_snippet")})
    docs = spark.createDataFrame([("p",), ("clean",)], "source string")
    got = {r.source: json.loads(r.value) for r in runs.issue_lists(docs, issues).collect()}
    assert [i["rule_id"] for i in got["p"]["issues"]] == ["a", "b", "c"] and got["p"]["severities"] == {"critical": 1, "serious": 0, "moderate": 0, "minor": 2} and got["clean"]["total"] == 0 and got["clean"]["issues"] == []


def test_questions_are_asked_once_and_failures_are_rows(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def judge(questions, path=str(log)):
        import hashlib
        import uuid

        bad = [q for q in questions if "fail" in q]
        if bad:
            raise RuntimeError("model down")
        with open(f"{path}/{uuid.uuid4()}", "w") as f:
            f.write("\n".join(questions))
        return [None if q == "shrug" else hashlib.md5(q.encode()).hexdigest()[:6] for q in questions]

    def asked():
        return sorted(q for p in log.iterdir() for q in p.read_text().split("\n"))

    rows = [(i, f"q{i % 30}") for i in range(90)] + [(100, "fail now"), (101, None), (102, "shrug")]
    given = spark.createDataFrame(rows, "id long, question string").repartition(5)
    folder = f"file://{tmp_path}/store"
    answered, errors = batching.ask_once(given, judge, folder, "one", batch=4)
    first = {r.id: r.answer for r in answered.collect()}
    bad = errors.collect()
    assert len(first) == 93 and len(bad) == 1 and bad[0].error == "RuntimeError: model down" and bad[0].questions <= 4
    assert first[101] is None and first[102] is None and len({q for q in asked()}) == len(asked())
    assert sum(v is None for v in first.values()) <= 2 + 3 * 3 + 1
    calm = given.filter("question is null or question <> 'fail now'")
    before = set(asked())
    answered, errors = batching.ask_once(calm, judge, folder, "two", batch=4)
    second = {r.id: r.answer for r in answered.collect()}
    assert errors.count() == 0 and all(second[i] for i in range(90)) and all(second[k] == v for k, v in first.items() if v and k in second)
    assert len(asked()) == len(set(asked())) + ("shrug" in before)  # what was answered isn't asked again


@pytest.mark.parametrize(("block", "tile"), [(7, 5), (1000, 1000)])
def test_block_products_are_exact(spark, block, tile):
    rng = np.random.default_rng(block)
    v = rng.normal(size=(60, 8)).astype("float32")
    r = np.concatenate([rng.normal(size=(23, 8)), v[:2]]).astype("float32")
    vectors = [(i, [float(x) for x in row]) for i, row in enumerate(v)] + [(900, None), (901, []), (902, [0.0] * 8)]
    refs = [(i, [float(x) for x in row], "model" if i % 3 else "human") for i, row in enumerate(r)] + [(500, [float(x) for x in r[24]], "human"), (501, None, "model"), (502, [0.0] * 8, "human")]
    left, right = spark.createDataFrame(vectors, "vec_id long, embedding array<float>"), spark.createDataFrame(refs, "ref_id long, embedding array<float>, label string")
    got = {x.vec_id: x for x in similarity.scores(left, right, block, tile).collect()}
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    cosine = unit(v.astype(float)) @ unit(r.astype(float)).T
    ai = np.array([i for i in range(len(r)) if i % 3])
    for i in range(60):
        a, h = cosine[i, ai].max(), cosine[i, ::3].max()
        assert abs(got[i].ai_similarity - a) < 1e-9 and abs(got[i].human_similarity - h) < 1e-9 and abs(got[i].score - min(1, max(0, (a - h + 1) / 2))) < 1e-9
        assert got[i].similar_to == ai[cosine[i, ai].argmax()]
    assert got[900].score == got[901].score == got[902].score == 0.5 and got[900].similar_to is None and len(got) == 63


def test_short_texts_and_low_scores_are_no_findings(spark):
    blocks = spark.createDataFrame([(1, "one two three four five", [1.0, 0.0]), (2, "one two three four", [1.0, 0.0]), (3, "a b c d e f", [0.0, 1.0]), (4, None, [1.0, 0.0])], "vec_id long, text string, embedding array<float>")
    refs = spark.createDataFrame([(1, [1.0, 0.1], "model"), (2, [0.1, 1.0], "human")], "ref_id long, embedding array<float>, label string")
    assert [r.vec_id for r in similarity.findings(blocks, refs).collect()] == [1]


def test_random_pages_repeat_and_inherit_as_by_hand():
    """lang_above, repeats, watched ancestors and subtree ends against a walk over all ancestors."""
    rng = random.Random(2)
    for _ in range(60):
        parts = rng.choices(["<p>", "</p>", "<span>", "</span>", "<div lang=en>", "</div>", "<nav>", "</nav>", "word ", "<br>", "<a id=x>", "</a>", "<script>v()</script>"], k=30)
        rows = dom.parse("".join(parts))
        for r in rows:
            chain, at = [], r.up
            while at.pos >= 0:
                chain.append(at)
                at = at.up
            assert r.lang_above == any(k == "lang" for a in chain for k, _ in a.attrs)
            assert set(r.above) == {a.tag for a in chain} & dom.WATCHED
            near = next((a for a in chain if a.tag in dom.COPY), None)
            assert r.copy is near
            assert all(a.pos < r.pos <= a.last for a in chain)


def test_numbers_and_ranks_need_no_single_task(spark):
    from glyphmill.operators.stage import numbered, ranked

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, rng.randrange(50)) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, seq long, v int").repartition(7)
    got = [(r.v, r.seq) for r in numbered(df, "v", "seq", tasks=5).orderBy("number").collect()]
    assert got == sorted((v, s) for _, s, v in rows)
    assert [r.number for r in numbered(df, "v", "seq").orderBy("number").collect()] == list(range(400))
    assert numbered(df.limit(0), "seq").count() == 0
    want = {}
    for k, s, _ in sorted(rows, key=lambda r: r[1]):
        want[s] = sum(1 for k2, s2, _ in rows if k2 == k and s2 < s)
    assert {r.seq: r["rank"] for r in ranked(df, ["k"], "seq", 30).collect()} == want


def test_the_spread_is_exact_with_ties(spark):
    from glyphmill.operators import findings

    rng = random.Random(8)
    rows = [(k, rng.choice([0.32, 0.32, round(rng.random(), 4), 1.0, 0.0])) for k in ("x", "y", None) for _ in range(rng.randrange(40, 90))] + [("z", 0.5), ("w", None)]
    got = {r.k: (r.n, r.low, r.median, r.high) for r in findings.score_spread(spark.createDataFrame(rows, "k string, score double"), "k").collect()}
    want = {}
    for k in {k for k, _ in rows}:
        v = sorted(s for j, s in rows if j == k and s is not None)
        if v:
            want[k] = (len(v), v[0], v[len(v) // 2], v[-1])
    assert got == want
