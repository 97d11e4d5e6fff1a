"""One page that breaks a rule and one that doesn't, for every rule."""

import pytest

from glyphmill.operators import audit, findings, pages

HEAD = '<!doctype html><html lang="en"><head><meta charset="utf-8"><title>A title of a good length</title></head><body>'
#: rule: (markup that breaks it, markup that doesn't, how often it is broken)
BODIES = {
    "image-alt": ('<img src="a.png">', '<img src="a.png" alt="">', 1),
    "image-alt-filename": ('<img alt="photo 1.JPG">', '<img alt="a photo">', 1),
    "control-name": ('<button></button><input type="text"><a href="/x"></a>', '<button>go</button><label for="i">n</label><input id="i"><a href="/x"><img alt="home"></a>', 3),
    "link-text-vague": ('<a href="/x">Click here!</a>', '<a href="/x">Prices</a>', 1),
    "heading-order": ("<h2>a</h2><h4>b</h4>", "<h2>a</h2><h4></h4><h3>b</h3>", 1),
    "tabindex-positive": ('<p tabindex="2">x</p>', '<p tabindex="0">x</p><p tabindex="x">y</p>', 1),
    "duplicate-id": ('<p id="a"></p><p id="a"></p><p id="a"></p>', '<p id="a"></p><p id=""></p><p id=""></p>', 2),
    "aria-reference-broken": ('<p aria-describedby="no yes" ></p><p id="yes"></p>', '<p aria-describedby="yes"></p><p id="yes"></p>', 1),
    "button-type": ("<form><button>x</button></form>", '<button>x</button><form><button type="submit">y</button></form>', 1),
    "media-captions": ("<video></video>", '<video><track kind="captions"></video>', 1),
    "media-autoplay": ("<audio autoplay></audio>", "<video autoplay muted></video><audio autoplay controls></audio>", 1),
    "table-headers": ("<table><tr></tr><tr></tr></table>", "<table><tr><th></th></tr><tr></tr></table><table role=presentation><tr></tr><tr></tr></table>", 1),
    "table-scope": ("<table><tr><th>a</th><th>b</th></tr><tr></tr></table>", "<table><tr><th scope=col>a</th><th>b</th></tr><tr></tr></table>", 1),
    "contrast-inline": ('<p style="color:#777;background:#888">x</p>', '<p style="color:#000;background:#fff">x</p><p style="color:#777">x</p>', 1),
    "viewport-fixed-width": ('<p style="width:700px">x</p>', '<style>@media (max-width: 800px) { p { width: 700px } }</style><p style="max-width:700px"></p>', 1),
    "viewport-tiny-font": ("<style>p{font-size:6pt}</style>", "<style>p{font-size:1em}</style>", 1),
    "viewport-touch-target": ('<button style="width:10px;height:30px">x</button>', '<button style="width:40px">x</button>', 1),
    "form-error-message": ('<input aria-invalid="true">', '<input aria-invalid="true" aria-describedby="e">', 1),
    "breadcrumb-markup": ('<div class="breadcrumb"><a href="/">x</a></div>', '<nav><div class="breadcrumb"><a href="/">x</a></div></nav>', 1),
    "image-modern-format": ('<img src="a.PNG">', '<img src="a.webp"><img src="a.png" srcset="b">', 1),
    "abbreviation-expansion": ("<p>See the FAQ</p>", "<code>FAQ</code><p>plain</p>", 1),
    "seo-image-dimensions": ("<img>", '<img width="1" height="1">', 1),
    "seo-empty-link": ('<a href="/x"></a>', '<a href="/x"><img></a><a href="/y" aria-label="y"></a>', 1),
    "perf-third-party-sync": ('<script src="https://other.example/x.js"></script>', '<script src="https://page.example/x.js"></script><script defer src="https://other.example/x.js"></script>', 1),
    "perf-large-inline": (f"<script>{'x' * 20001}</script>", "<script>x</script>", 1),
    "perf-image-loading": ("<img><img><img><img>", "<img><img><img><img loading=lazy>", 1),
    "perf-layout-shift": ("<iframe></iframe>", '<iframe width="1" height="1"></iframe><img>', 1),
    "bp-mixed-content": ('<img src="http://x.example/a">', '<img src="https://x.example/a">', 1),
    "bp-target-blank": ('<a href="/x" target="_blank">x</a>', '<a href="/x" target="_blank" rel="noopener">x</a>', 1),
    "bp-inline-handlers": ('<p onclick="a()" onload="b()">x</p>', '<p onclick="{go}">x</p>', 1),
    "bp-password-field": ('<input type="password">', '<form><input type="password" autocomplete="off"></form>', 1),
    "bp-deprecated-html": ("<font>x</font><center>y</center>", "<b>x</b>", 2),
    "bp-ai-markup-artifact": ('<div class="claude-panel a" data-gpt-id="1">x</div>', '<div class="claudette" data-updated-by-gpt="1">x</div>', 1),
    "seo-noindex": ('<meta name="robots" content="NOINDEX">', '<meta name="robots" content="all">', 1),
    "viewport-zoom": ('<meta name="viewport" content="user-scalable=no">', '<meta name="viewport" content="maximum-scale=5">', 1),
    "perf-font-display": ('<link rel="stylesheet" href="/fonts.css"><style>@font-face{}</style>', '<link rel="stylesheet" href="/fonts.css?display=swap">', 2),
    "landmark-regions": ("<nav></nav>", "<main></main>", 1),
    "skip-link": ('<a href="#no">x</a>', '<a href="#yes">x</a><p id="yes"></p>', 1),
    "hreflang-links": ('<a href="/en/x">x</a>', '<a href="/en/x" hreflang="en">x</a>', 1),
    "page-has-h1": ("<p>x</p>", "<h1>x</h1>", 1),
    "seo-structured-data": ("<p>x</p>", "<p itemscope>x</p>", 1),
}
#: rule: whole pages
PAGES = {
    "html-lang": ("<html><body></body></html>", '<html lang="en"><body></body></html>'),
    "document-title": ("<html><head><title> </title></head></html>", "<html><head><title>x</title></head></html>"),
    "seo-title-length": ("<html><head><title>short</title></head></html>", "<html><head><title>A title of a good length</title></head></html>"),
    "seo-meta-description": ('<html><head><meta name="description" content="short"></head></html>', f'<html><head><meta name="description" content="{"x" * 80}"></head></html>'),
    "seo-canonical": ('<html><head><link rel="canonical"><link rel="canonical"></head></html>', '<html><head><link rel="canonical"></head></html>'),
    "seo-open-graph": ("<html><head></head></html>", '<html><head><meta property="og:title"><meta property="og:description"><meta property="og:image"></head></html>'),
    "perf-render-blocking": ("<html><head>" + '<script src="a"></script>' * 4 + "</head></html>", "<html><head>" + '<script src="a" async></script>' * 4 + "</head></html>"),
    "perf-preconnect": ('<html><head><script src="https://cdn.example/x"></script></head></html>', '<html><head><link rel="preconnect" href="https://cdn.example"><script src="https://cdn.example/x"></script></head></html>'),
    "bp-charset": ("<html><head></head></html>", '<html><head><meta charset="utf-8"></head></html>'),
    "bp-doctype": ("<html></html>", "<!doctype html><html></html>"),
}


@pytest.fixture(scope="module")
def issues(spark):
    rows = []
    for rule, (bad, good, _) in BODIES.items():
        rows += [(f"{rule}+", "https://page.example/", "page", HEAD + bad), (f"{rule}-", "https://page.example/", "page", HEAD + good)]
    for rule, (bad, good) in PAGES.items():
        rows += [(f"{rule}+", "https://page.example/", "page", bad), (f"{rule}-", "https://page.example/", "page", good)]
    rows += [("fragment", "x", "fragment", "<p>no page</p><img>"), ("null", "x", "page", None), ("empty", "x", "page", ""), ("broken", "x", "page", '<p <a href="x>< />& </div><img')]
    docs = spark.createDataFrame(rows, "doc_id string, source string, kind string, html string")
    return audit.audit(docs).collect()


@pytest.mark.parametrize("rule", sorted({**BODIES, **PAGES}))
def test_rule(issues, rule):
    count = lambda doc: sum(i["doc_id"] == doc and i["rule_id"] == rule for i in issues)
    assert count(f"{rule}+") == BODIES.get(rule, (0, 0, 1))[2]
    assert count(f"{rule}-") == 0


def test_every_rule_is_here():
    assert {r[0] for r in audit.RULES} == {*BODIES, *PAGES} | {"language-change"}
    assert len(audit.RULES) == 52


def test_page_rules_are_silent_on_fragments(issues):
    assert {i["rule_id"] for i in issues if i["doc_id"] == "fragment"} == {"image-alt"}
    assert not [i for i in issues if i["doc_id"] in ("null", "empty")]


def test_severities_and_places(issues):
    first = {(i["doc_id"], i["rule_id"]): i for i in issues}
    assert first["seo-canonical+", "seo-canonical"]["severity"] == "serious"
    assert first["seo-meta-description+", "seo-meta-description"]["severity"] == "minor"
    img = first["image-alt+", "image-alt"]
    assert img["selector"] == "html:nth-of-type(1) > body:nth-of-type(1) > img:nth-of-type(1)"
    assert (img["line"], img["snippet"], img["fix_snippet"]) == (1, '<img src="a.png">', '<img src="a.png" alt="">')
    assert first["heading-order+", "heading-order"]["details"]["to"] == "4"


def test_blocks_and_diagnosis(spark):
    rows = [(1, "https://a.b/", "<body><p>A paragraph that is long enough.</p><li><a>A paragraph inside a list item</a></li><div>Copy right inside a container<p>no</p></div><script>var x = 'twenty characters';</script></body>"), (2, "https://a.b/2", '<div id="root"></div>'), (3, "https://a.b/3", None)]
    p = spark.createDataFrame(rows, "doc_id int, source string, html string")
    blocks, tallies = pages.page_blocks(p)
    assert sorted(r["text"] for r in blocks.collect()) == ["A paragraph inside a list item", "A paragraph that is long enough.", "Copy right inside a container"]
    status = p.selectExpr("*", "200 AS status_code", "source AS final_url")
    reasons = {r["doc_id"]: r["reasons"] for r in pages.diagnose(status, tallies).collect()}
    assert reasons[1] == [] and reasons[2] == ["js-rendered"]


def test_dedup_across_engines(spark):
    img = '<img src="a.png">'
    rows = [(1, "p", "image-alt", "static", "serious", "html > img", img), (2, "p", "axe:image-alt", "axe", "critical", "img", '<img src="a.png"/>'), (3, "p", "htmlcs:1_1_1", "htmlcs", "moderate", "", img), (4, "q", "image-alt", "static", "minor", "html > img", img)]
    df = spark.createDataFrame(rows, "seq int, source string, rule_id string, engine string, severity string, selector string, snippet string")
    counts = spark.createDataFrame([], "source string, key string, n long")
    got = [(r["seq"], r["severity"], r["also_found_by"]) for r in findings.deduplicate(df, counts).orderBy("seq").collect()]
    assert got == [(1, "critical", ["axe", "htmlcs"]), (4, "minor", [])]


def test_crawl(spark):
    edges = spark.createDataFrame([("http://a/", "http://a/1", 0), ("http://a/", "http://a/2", 1), ("http://a/2", "http://a/", 0), ("http://a/1", "http://a/3", 0), ("http://a/1", "http://b/", 1)], "src string, dst string, nth int")
    roots = spark.createDataFrame([("http://a/",)], "url string")
    got = [(r["url"], r["depth"]) for r in pages.crawl(edges, roots).orderBy("place").collect()]
    assert got == [("http://a/", 0), ("http://a/1", 1), ("http://a/2", 1), ("http://a/3", 2)]
    assert pages.crawl(edges, roots, max_pages=2).count() == 2
