"""Fix planning against brute force: the right tag, the right range, nothing guessed, nothing lost at equal offsets."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import audit, fixes
from glyphmill.sources import tags

ISSUE = "path string, seq long, rule_id string, engine string, line int, snippet string, fix_snippet string"


def open_end(text, start):
    quote = ""
    for i in range(start, len(text)):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c == ">":
            return i + 1
    return None


def opening(text, name=None):
    """(start, stop, line, name, attributes) of opening tags, by looking at every place."""
    for m in re.finditer(r"<\s*([a-zA-Z][a-zA-Z0-9-]*)(?=[\s/>])", text):
        stop = open_end(text, m.start())
        if stop is not None and name in (None, m[1].lower()):
            body = text[m.end() : stop - 1]
            yield m.start(), stop, text.count("\n", 0, m.start()) + 1, m[1].lower(), attributes(body)


def attributes(body):
    return {k.lower(): v.strip("\"'") for k, v in re.findall(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", body)}


def test_scan_finds_what_every_place_shows():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(["<p>", "<a href='x>y'", ">", '"', "'", "\n", "</p>", "<img src=a.png>", "<b ", " class=q", "<", "text", "<!-- <i> -->"], k=25))
        want = [(a, b, line, name, attrs) for a, b, line, name, attrs in opening(text)]
        got = [(r[1], r[2], r[3], r[4], {x["k"]: x["v"] for x in r[8]}) for r in tags.scan(text) if not r[5]]
        assert got == want, text


def test_scan_is_linear_in_open_quotes():
    import time

    began = time.time()
    assert all(r[2] > r[1] for r in tags.scan("<a title=\"" * 100_000))
    assert len(list(tags.scan("<div>" * 200_000))) == 200_000
    assert time.time() - began < 10


def brute(issues, texts, strict=True):
    """status, start, end, replacement of each issue, then the overlaps."""
    out, open_ = {}, []
    for path, seq, rule, engine, line, snippet, fix in issues:
        text = texts.get(path)
        if path.startswith("http") or not fix or engine != "static" or not snippet or text is None:
            out[seq] = ("skipped",)
            continue
        if fix.lower().lstrip().startswith("<!doctype"):
            if re.match(r"\s*<!doctype", text, re.I):
                out[seq] = ("skipped",)
            else:
                open_.append((path, 0, 0, seq, rule, fix + "\n", "insert", ""))
            continue
        name = re.search(r"<\s*([a-zA-Z][a-zA-Z0-9-]*)", snippet)[1].lower()
        inner = re.search(r"<\s*[a-zA-Z][a-zA-Z0-9-]*((?:[^\"'>]|\"[^\"]*\"|'[^']*')*)", snippet)[1]
        wanted = attributes(inner)
        fit = [t for t in opening(text, name) if all(k in t[4] and (not v or t[4][k] == v) for k, v in wanted.items())]
        tiers = [[t for t in fit if t[2] == line], [t for t in fit if line and line <= t[2] < line + 4], fit]
        if strict:
            tier = next((t for t in tiers if t), [])
            if len(tier) != 1:
                out[seq] = ("ambiguous",) if tier else ("skipped",)
                continue
        else:
            tier = tiers[1] or tiers[2]
            if not tier:
                out[seq] = ("skipped",)
                continue
        start, stop = tier[0][:2]
        fixed = re.search(r"<\s*([a-zA-Z][a-zA-Z0-9-]*)", fix)[1].lower()
        if fixed != name and name in ("head", "html", "body"):
            row = text[text.rfind("\n", 0, start) + 1 : start]
            open_.append((path, stop, stop, seq, rule, f"\n{row[: len(row) - len(row.lstrip())]}  {fix}", "insert", ""))
            continue
        end = stop
        if f"</{fixed}" in fix.lower() and name not in ("img", "meta", "link", "input", "br"):
            depth, end = 1, None
            for m in re.finditer(rf"<\s*(/?)\s*{name}(?=[\s/>])", text[stop:], re.I):
                depth += -1 if m[1] else 1
                if not depth:
                    end = open_end(text, stop + m.start())
                    break
        if end is None or text[start:end] == fix:
            out[seq] = ("skipped",)
        else:
            open_.append((path, start, end, seq, rule, fix, "replace", text[start:end]))
    kept = []
    for plan in sorted(open_):
        path, start, end, seq, rule, new, kind, old = plan
        if any(k[0] == path and start < k[2] and end > k[1] for k in kept):
            out[seq] = ("skipped",)
            continue
        kept.append(plan)
        need = rule in fixes.DECISIONS or any(m in new and m not in old for m in fixes.PLACEHOLDERS)
        out[seq] = ("needs-input" if need else "ready", start, end, new)
    done = dict(texts)
    for path in texts:
        mine = [k for k in kept if k[0] == path and out[k[3]][0] == "ready"]
        for _, start, end, _, _, new, _, _ in sorted(mine, key=lambda k: (-k[1], k[6] != "replace")):
            done[path] = done[path][:start] + new + done[path][end:]
    return out, done


def made(seed, n=40):
    rng = random.Random(seed)
    parts = ['<img src="a.png">', '<img src="b.png" alt="b">', "<IMG src=a.png>", '<a href="/x" target="_blank">l</a>', "<h3>Jump</h3>", "<h3 class='q'>In <h3>two</h3></h3>", "<td>1</td>", "<td>1", "\n", "\n  ", " words ", '<a title="<img src=a.png>" href=\'/y\'>z</a>']
    texts, issues = {}, []
    for i in range(n):
        path = f"d/{i}.html"
        head = rng.choice(["<html>\n  <head>\n<title>t</title></head>", "<!DOCTYPE html>\n<html lang='en'><head></head>", "\t<html><head>", ""])
        text = head + "".join(rng.choices(parts, k=rng.randrange(14))) + rng.choice(["</body></html>", ""])
        texts[path] = text
        found = list(opening(text))
        for start, stop, line, name, _ in rng.sample(found, min(len(found), 6)):
            snippet = text[start:stop]
            fix = {"img": snippet[:-1] + ' alt="">', "h3": "<h2>Jump</h2>", "a": snippet[:-1] + ' rel="noopener">', "html": '<html lang="en">', "head": rng.choice(['<meta charset="utf-8">', '<meta name="description" content="…">'])}.get(name, f"<{name} scope>")
            rule = {"img": rng.choice(["image-alt", "perf-image-loading"]), "html": "html-lang"}.get(name, "rule-" + name)
            issues.append((path, len(issues), rule, "static", rng.choice([line, line, line, max(1, line - 2), None, 99]), rng.choice([snippet, snippet, f"<{name}>"]), fix))
        issues.append((path, len(issues), "bp-doctype", "static", 1, "<html>", "<!DOCTYPE html>"))
        issues.append((path, len(issues), "bp-charset", "static", 1, "<head>", '<meta charset="utf-8">'))
    issues += [("http://x/y", 9001, "r", "static", 1, "<p>", "<p x>"), ("gone.html", 9002, "r", "static", 1, "<p>", "<p x>"), ("d/0.html", 9003, "r", "axe", 1, "<p>", "<p x>"), ("d/0.html", 9004, "r", "static", 1, "<p>", None), ("d/0.html", 9005, "r", "static", 1, "", "<p x>")]
    return issues, texts


@pytest.mark.parametrize("strict", [True, False])
def test_plans_and_pages_match_brute_force(spark, strict):
    issues, texts = made(7)
    want, pages = brute(issues, texts, strict)
    given = spark.createDataFrame(list(texts.items()), "path string, text string").withColumn("at", F.lit("clash"))
    plans = fixes.plan_fixes(spark.createDataFrame(issues, ISSUE), given, strict=strict)
    got = {r.seq: (r.status, r.start, r.end, r.replacement) if r.status in ("ready", "needs-input") else (r.status,) for r in plans.collect()}
    assert got == want
    assert plans.filter("status <> 'ready' and reason is null").count() == 0
    assert {s[0] for s in want.values()} >= {"ready", "needs-input", "skipped"}
    new, outcomes = fixes.apply_fixes(plans, given)
    assert {r.path: r.text for r in new.collect()} == pages
    assert {r.seq: r.outcome for r in outcomes.collect()} == {k: "applied" if v[0] == "ready" else v[0] for k, v in want.items()}


def test_stale_and_missing_files_are_refused(spark):
    issues, texts = made(11, 6)
    given = spark.createDataFrame(list(texts.items()), "path string, text string")
    plans = fixes.plan_fixes(spark.createDataFrame(issues, ISSUE), given)
    later = given.filter("path <> 'd/1.html'").withColumn("text", F.when(F.col("path") == "d/2.html", "").otherwise(F.col("text")))
    new, outcomes = fixes.apply_fixes(plans, later)
    ready = {(r.path, r.seq): r for r in plans.filter("status = 'ready'").collect()}
    by = {(r.path, r.seq): r.outcome for r in outcomes.collect()}
    assert all(by[k] == "missing" for k in ready if k[0] == "d/1.html")
    assert all(by[k] == ("stale" if r.kind == "replace" or r.start > 0 else "applied") for k, r in ready.items() if k[0] == "d/2.html")
    assert new.count() == later.count()


def test_the_audits_own_fixes_make_their_issues_go(spark):
    page = '<html>\n<head>\n<title>A page that needs a little work</title>\n</head>\n<body>\n<h1>Title</h1>\n<h3>Jumped</h3>\n<a href="http://x.test" target="_blank">l</a>\n</body>\n</html>\n'
    texts = spark.createDataFrame([("p.html", page)], "path string, text string")
    docs = texts.select(F.col("path").alias("doc_id"), F.col("path").alias("source"), F.lit("page").alias("kind"), F.col("text").alias("html"))
    found = audit.audit(docs)
    issues = found.select(F.col("source").alias("path"), F.xxhash64("rule_id", "selector").alias("seq"), "rule_id", "engine", "line", "snippet", "fix_snippet")
    plans = fixes.fill_languages(fixes.plan_fixes(issues, texts), texts.withColumn("page_text", F.lit("English words are here for all")))
    new, _ = fixes.apply_fixes(plans, texts)
    text = new.first().text
    assert text.startswith("<!DOCTYPE html>\n<html lang=\"en\">") and "<h2>Jumped</h2>" in text and 'rel="noopener noreferrer"' in text
    after = audit.audit(new.select(F.col("path").alias("doc_id"), F.col("path").alias("source"), F.lit("page").alias("kind"), F.col("text").alias("html")))
    gone = {r.rule_id for r in found.collect()} - {r.rule_id for r in after.collect()}
    assert {"bp-doctype", "html-lang", "heading-order", "bp-target-blank"} <= gone
    again = fixes.plan_fixes(issues, new)
    assert again.filter("rule_id in ('bp-doctype', 'bp-target-blank') and status = 'ready'").count() == 0


def test_answers_fill_what_they_name(spark):
    rows = [
        ("a", 1, "seo-meta-description", 1, "insert", 10, 10, "", '<meta name="description" content="…">', "needs-input", "x"), ("a", 2, "image-alt", 1, "replace", 20, 30, "<img src=q>", '<img src="q" alt="">', "needs-input", "x"),
        ("a", 3, "image-alt", 1, "replace", 40, 50, "<img src=r>", '<img src="r" alt="">', "needs-input", "x"), ("a", 4, "html-lang", 1, "replace", 0, 5, "<html>", '<html lang="en">', "needs-input", "x"),
        ("a", 5, "bp-doctype", 1, "insert", 0, 0, "", "<!DOCTYPE html>", "ready", None), ("b", 6, "seo-open-graph", 1, "insert", 1, 1, "", '<meta content="…">', "needs-input", "x"), ("c", 7, "seo-open-graph", 1, "insert", 1, 1, "", '<meta content="…">', "needs-input", "x"),
    ]
    plans = spark.createDataFrame(rows, "path string, seq long, rule_id string, line int, kind string, start int, end int, original string, replacement string, status string, reason string")
    texts = spark.createDataFrame([("a", " Some \n words "), ("b", None)], "path string, page_text string")
    asked = {r.path: r for r in fixes.prompts(plans, texts).collect()}
    assert asked["a"].n == 3 and "Some words" in asked["a"].prompt and asked["a"].prompt.index("<<<1>>>") < asked["a"].prompt.index("<img src=q>") < asked["a"].prompt.index("<<<3>>>")
    replies = [("a", 3, 'Sure:\n<<<1>>>\n A "good" page \n<<<2>>>\nskip\n <<<3>>> \nA red\n<<<9>>>\nfox'), ("b", 1, "no marker"), ("c", 1, None)]
    got = {r.seq: (r.status, r.replacement) for r in fixes.with_answers(plans, spark.createDataFrame(replies, "path string, n int, answer string")).collect()}
    assert got[1] == ("ready", '<meta name="description" content="A &quot;good&quot; page">') and got[2][0] == "needs-input"
    assert got[3] == ("ready", '<img src="r" alt="A red\n<<<9>>>\nfox">') and got[4][0] == got[6][0] == got[7][0] == "needs-input" and got[5][0] == "ready"


def test_nothing_to_plan(spark):
    none = spark.createDataFrame([], ISSUE)
    texts = spark.createDataFrame([("a", "<p>"), ("b", None)], "path string, text string")
    plans = fixes.plan_fixes(none, texts)
    assert plans.count() == 0 and plans.columns == fixes.PLAN
    new, outcomes = fixes.apply_fixes(plans, texts)
    assert sorted(map(tuple, new.collect()), key=str) == [("a", "<p>"), ("b", None)] and outcomes.count() == 0
