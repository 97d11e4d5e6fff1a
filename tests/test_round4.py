"""Findings of round 4: what an audit puts on disk, and pages on which its queries differed from their SQL."""

import os

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from glyphmill.operators import audit
from glyphmill.operators.stage import written
from glyphmill.plans import operation_queries, page_queries, report_queries, rule_queries
from glyphmill.sources import asked, dom

DOCS = "doc_id long, source string, kind string, html string"


def test_an_audit_shuffles_no_rows(spark):
    """Elements were dealt by document, checkpointed and shuffled again for each window and look-up."""
    html = '<html lang="en"><head><title>A title of a good length</title></head><body><div><table><tr></tr><tr></tr></table><p aria-controls="no">x</p><h2>a</h2><h4>b</h4></div></body></html>'
    found = audit.audit(spark.createDataFrame([(1, "u", "page", html)], DOCS))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Window", "Join", "Sort", "Aggregate", "RDDScan[checkpoint"))
    assert {"table-headers", "aria-reference-broken", "heading-order"} <= {r.rule_id for r in found.collect()}


def test_rows_of_one_key_are_documents_of_their_own(spark):
    """Rows of one id were read as one document, in which all their rows had the same places."""
    html = "<html><body><h1>x</h1><img></body></html>"
    found = audit.audit(spark.createDataFrame([(1, "u", "page", html), (1, "u", "page", html), (None, None, "page", html)], DOCS))
    counts = {(r.doc_id, r.rule_id): r.n for r in found.groupBy("doc_id", "rule_id").agg(F.count("*").alias("n")).collect()}
    assert counts[1, "image-alt"] == counts[1, "html-lang"] == 2 and counts[None, "image-alt"] == counts[None, "html-lang"] == 1
    assert (1, "page-has-h1") not in counts


def test_what_elements_are_told_of_their_surroundings():
    html = (
        '<p id="a">one</p><div><b id="n">near</b><input id="i" aria-labelledby="a  n" aria-owns="a no x"></div><label for="i">l</label><table><tr><th scope=row></th><th></th></tr><tr></tr></table>'
        '<a href="/x"><i><img alt=" pic "></i></a><a href="/y"></a><p id=" a ">two</p><h2>u</h2><h3></h3><h4>v</h4><video><track kind="CAPTIONS"></video>'
    )
    doc = asked._Document(html, False)
    told = {doc.rows[k].tag + "#" + doc.attr[k].get("id", "") if doc.attr[k].get("id") else (doc.rows[k].tag, k): v for k, v in doc.around().items()}
    assert told["input#i"] == {"n_img": 0, "img_alt": None, "id_rank": 1, "labelled_by": "near", "broken": [("aria-owns", "no x")], "for_label": True}
    assert told["p# a "] == {"id_rank": 2}
    of = lambda tag: [v for k, v in told.items() if k[0] == tag]
    assert of("table") == [{"n_tr": 2, "n_th": 2, "n_scoped": 1}] and of("video") == [{"n_tracks": 1, "n_captions": 1}]
    assert of("a") == [{"n_img": 1, "img_alt": "pic"}, {"n_img": 0, "img_alt": None}] and of("h4") == [{"before": 2}] and not of("h3")


def test_a_written_table_is_packed_and_read_by_column(spark):
    """Issues were kept as a checkpoint, every row whole."""
    df = spark.range(20_000).select("id", F.lit("the same words in every row, over and over").alias("said"), F.create_map(F.lit("k"), F.lit("v")).alias("m"))
    out = written(df)
    assert out.dtypes == df.dtypes and sorted(r.id for r in out.select("id").collect()) == list(range(20_000))
    assert "ReadSchema: struct<id:bigint>" in out.select("id")._jdf.queryExecution().executedPlan().toString()
    files = [f.removeprefix("file://") for f in out.inputFiles()]
    assert sum(os.path.getsize(f) for f in files) < 300_000


def test_squeezing_is_what_it_was():
    import re

    for s in ("", "  a\t b  c \x1c d\x85", "　x\x0b", "plain"):
        assert dom.squeeze(s) == re.sub(r"\s+", " ", s).strip()


PAGE = '<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{}</title></head><body><nav><a href="/x">x</a></nav><h1>{}</h1><p>{}</p></body></html>'
GOOD = "A title of a good length"
#: Pages on which an audit says something else than a pattern over their source does.
ODD = [
    "", " \n ", "words alone", "<div><p>x</p><img></div>", '<html lang="en"><body><h1>x</h1></body></html>', f'<html lang="en"><head><title>{GOOD}</title></head></html>', None,
    PAGE.format("to&amp;&amp;&amp;", "x", "y"), PAGE.format("a" * 58 + "&amp;", "x", "y"), PAGE.format("to&amp;&am", "to&amp;&am", "y"), PAGE.format("&nbsp;", "x", "y"), PAGE.format("　" * 16 + "b", "x", "y"),
    PAGE.format("", "", "y"), PAGE.format(GOOD, " ", "<h3>z</h3>"), PAGE.format(GOOD, "x", "FAQ<br>FAQ"), PAGE.format(GOOD, "x", "FAQ<!-- HTML -->FAQ"), PAGE.format(GOOD, "x", "R&amp;D"),
    PAGE.format(GOOD, "x", '<a href="/q">&quot;here&quot;</a><a href="/r">here.</a><a href="/s">\xabhere\xbb</a>'), PAGE.format(GOOD, "x", "<title>second</title>"), PAGE.format(GOOD, "x", "y") + "<!DOCTYPE html>",
]
AUDITED = ["rule_counts", "rule_pages", "issue_counts_by_severity", "issues_by_rule", "audit_summary", "file_map", "report_order"]


@pytest.fixture(scope="module")
def odd_pages(tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    rows = [(100 * k + j, f"https://h{k}.example/en/{j}", html) for k, html in enumerate(ODD) for j in range(4)]
    pq.write_table(pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": [r[1] for r in rows], "html": pa.array([r[2] for r in rows], pa.string())}), f"{folder}/pages.parquet")
    return str(folder)


@pytest.mark.parametrize("name", AUDITED)
def test_odd_pages_give_what_sql_gives(spark, odd_pages, name):
    """Pages without an html element, titles with references, empty headings, texts of one parent, quoted links, second titles and doctypes."""
    modules = (rule_queries, page_queries, report_queries, operation_queries)
    query, sql = next(m.QUERIES[name] for m in modules if name in m.QUERIES), next(m.SQL[name] for m in modules if name in m.SQL)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{odd_pages}/pages.parquet')")
    wanted = con.execute(sql)
    names = [d[0] for d in wanted.description]
    found = query(spark, odd_pages)
    assert sorted(found.columns) == sorted(names)
    assert sorted(map(repr, map(tuple, found.select(*names).collect()))) == sorted(map(repr, wanted.fetchall()))


def test_the_audit_itself_reads_what_a_reader_sees(spark):
    """Only what is counted as written follows the source."""
    docs = spark.createDataFrame([(k, "u", "page", html) for k, html in enumerate(ODD)], DOCS)
    plain, written_ = ({(r.doc_id, r.rule_id): r.n for r in audit.audit(docs, as_written=w).groupBy("doc_id", "rule_id").agg(F.count("*").alias("n")).collect()} for w in (False, True))
    at = {html: k for k, html in enumerate(ODD)}
    short = at[PAGE.format("to&amp;&amp;&amp;", "x", "y")]
    assert plain[short, "seo-title-length"] == 1 and (short, "seo-title-length") not in written_
    assert not [k for k, _ in plain if k < 3] and sum(k == 0 for k, _ in written_) == 11
    assert not [k for k, _ in written_ if ODD[k] is None]
    two = at[PAGE.format(GOOD, "x", "FAQ<br>FAQ")]
    assert (plain[two, "abbreviation-expansion"], written_[two, "abbreviation-expansion"]) == (1, 2)
