"""Detectors by name and from SQL, errors as rows, and rescans of a stream of files."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from glyphmill.operators import registry, style
from glyphmill.streaming import rescan

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import tests
TEXTS = [
    (1, "Furthermore, it is important to note the seamless integration."), (2, "Plain words — stand\u200b here…"), (3, None), (4, ""), (5, "boom goes the text"),
    (6, "furthermore, FURTHERMORE, and delve into the realm"), (7, "Plain words — stand\u200b here…"),
]


class Picky(registry.BlockDetector):
    name = "picky"

    def spans(self, text, language):
        if "boom" in text:
            raise ValueError("no booms, please")
        yield 0, 1, 0.7, "first"


class Missing(registry.BlockDetector):
    name = "missing"

    @classmethod
    def ready(cls):
        raise registry.Unavailable("no key")


@pytest.fixture
def known():
    out = registry.default_registry()
    out.register("picky", Picky)
    out.register("missing", Missing)
    out.alias("old-picky", "older")
    out.alias("older", "picky")
    out.alias("ring", "gnir")
    out.alias("gnir", "ring")
    return out


def test_names_and_aliases(known):
    assert known.available() == ["missing", "odd-characters", "offline", "phrase-load", "phrases", "picky", "repeats"]
    assert known.create("old-picky") is Picky and known.lookup("ring") is None and known.lookup("heuristic") is known.lookup("offline")
    with pytest.raises(KeyError, match="offline"):
        known.create("nothing")
    with pytest.raises(registry.Unavailable):
        known.create("missing")


def test_an_error_is_a_row_and_the_rest_goes_on(spark, known):
    blocks = spark.createDataFrame(TEXTS, "block_id long, text string").withColumn("detector", F.lit("clash"))
    got = known.run(blocks, "picky").collect()
    assert {(r.block_id, r.error) for r in got} == {(1, None), (2, None), (4, None), (5, "no booms, please"), (6, None), (7, None)}
    bad = next(r for r in got if r.error)
    assert (bad.start, bad.end, bad.score, bad.confidence, bad.detector, bad.explanation) == (0, 18, 0.0, "low", "picky", "detector error: no booms, please")


def test_phrases_agree_with_the_plan(spark, known):
    blocks = spark.createDataFrame(TEXTS, "block_id long, text string").withColumn("language_hint", F.lit("en"))
    mine = {(r.block_id, r.explanation) for r in known.run(blocks, "phrases").collect()}
    plan = blocks.select("block_id", F.explode(style.cliches(F.col("text"), F.lit("en"))).alias("p"))
    assert mine == {tuple(r) for r in plan.collect()} and mine
    for r in known.run(blocks, "phrases").collect():
        assert dict(TEXTS)[r.block_id][r.start : r.end].lower() == r.explanation.lower()


def test_sql_calls_them_on_any_table(spark, known):
    assert "detect_odd_characters" in known.install(spark) and "detect_old_picky" in known.install(spark)
    spark.createDataFrame([(f"k{i}", t, i % 2) for i, t in TEXTS], "block_id string, text string, part int").createOrReplaceTempView("some_blocks")
    odd = spark.sql("SELECT block_id, start, `end`, explanation FROM detect_characters(TABLE(some_blocks))").collect()
    assert {tuple(r) for r in odd} == {(k, *s) for k in ("k2", "k7") for s in ((12, 13, "typography"), (19, 20, "invisible"), (25, 26, "typography"))}
    whole = spark.sql("SELECT block_id FROM detect_repeats(TABLE(some_blocks) WITH SINGLE PARTITION ORDER BY block_id)").collect()
    parts = spark.sql("SELECT block_id FROM detect_repeats(TABLE(some_blocks) PARTITION BY part ORDER BY block_id)").collect()
    assert [r.block_id for r in whole] == ["k7"] and parts == []
    with pytest.raises(Exception, match="no column text"):
        spark.sql("SELECT * FROM detect_picky(TABLE(SELECT 1 AS block_id))").collect()


def test_plans_run_beside_block_detectors(spark, known):
    blocks = spark.createDataFrame(TEXTS, "block_id long, text string")
    got = known.run(blocks, "heuristic", "picky")
    assert {r.detector for r in got.collect()} == {"offline", "picky"}


def test_rescans_add_up_to_a_full_scan(spark, known, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rescan.STATE_STORE)
    folder = tmp_path / "files"
    one = [("a", "It is important to note this.", 1), ("b", "boom it is important to note", 1), ("c", "plain", 1), ("d", "furthermore, yes", 1), (None, "furthermore, no", 1)]
    two = [("a", "It is important to note this.", 2), ("b", "now furthermore, calm", 2), ("d", None, 2), ("e", "moreover, new", 2), ("f", "first", 2), ("f", "additionally, second", 3)]
    schema = "path string, text string, seq long"
    for k, rows in enumerate((one, two)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        files = spark.readStream.schema(schema).parquet(str(folder))
        query = rescan.rescan(files, known, "phrases", "picky").writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "changes")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
        changes = spark.read.parquet(str(tmp_path / "changes"))
        if k == 0:
            assert changes.filter("sign < 0").count() == 0
    assert changes.filter("path = 'a'").count() == 2 and changes.filter("path = 'a' and seq = 2").count() == 0
    last = spark.createDataFrame([("a", one[0][1]), ("b", two[1][1]), ("c", "plain"), ("e", two[3][1]), ("f", two[5][1])], "block_id string, text string")
    full = {(r.block_id, r.detector, r.start, r.end, r.explanation) for r in known.run(last, "phrases", "picky").collect()}
    assert {(r.path, r.detector, r.start, r.end, r.explanation) for r in rescan.present(changes).collect()} == full
