"""Questions to an outside judge in batches of fixed size: each different question once, answers kept by content.

The judge is a function of a list of questions that gives as many answers. It is called inside tasks, one batch at a
time; answers go to a store by the hash of their question, so a question that any earlier run has answered is never
asked again, however often it occurs. A batch that fails is one error row, and its questions stay open for the next run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Questions of one batch, and batches of one task: what a lost executor may have to ask again.
BATCH, TASK_BATCHES = 20, 10
STORE = "digest string, answer string"
_OUT = [("digest", pa.string()), ("answer", pa.string()), ("error", pa.string()), ("questions", pa.int32())]


def digest(question):  # noqa: ANN001, ANN201
    return F.sha2(question, 256)


def open_questions(candidates: DataFrame, store: DataFrame) -> DataFrame:
    """(digest, question) of the different questions in candidates (question) that the store (digest, answer) can't answer."""
    asked = candidates.filter(F.col("question").isNotNull()).select(digest(F.col("question")).alias("digest"), "question").dropDuplicates(["digest"])
    return asked.join(store.select("digest"), "digest", "left_anti")


def ask(questions: DataFrame, judge: Callable[[list[str]], list[str | None]], batch: int = BATCH, task_batches: int = TASK_BATCHES) -> DataFrame:
    """(digest, answer, error, questions): a row per answered question; per failed batch one with the error and how many it held.

    A batch fails if the judge raises or gives another number of answers. A null answer is no answer: no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[str, str]] = []

        def answered() -> pa.RecordBatch:
            try:
                said = list(judge([q for _, q in held]))
                if len(said) != len(held):
                    raise ValueError(f"{len(said)} answers to {len(held)} questions")
                rows = [(d, a, None, 1) for (d, _), a in zip(held, said, strict=True) if a is not None]
            except Exception as problem:  # noqa: BLE001
                rows = [(None, None, f"{type(problem).__name__}: {problem}", len(held))]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(_OUT)], [n for n, _ in _OUT])

        for part in batches:
            for pair in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                held.append(pair)
                if len(held) == batch:
                    yield answered()
                    held = []
        if held:
            yield answered()

    tasks = max(1, -(-questions.count() // (batch * task_batches)))
    return questions.select("digest", "question").repartition(tasks, "digest").mapInArrow(run, "digest string, answer string, error string, questions int")


def ask_once(candidates: DataFrame, judge: Callable[[list[str]], list[str | None]], folder: str, run: str, batch: int = BATCH) -> tuple[DataFrame, DataFrame]:
    """(candidates with answer, errors of this run): asks what the store in folder lacks and adds the answers to it.

    run names the run's own part of the store, which a second run of that name would write anew; errors are in it, too.
    An answer is null where its batch failed.
    """
    spark = candidates.sparkSession
    part = f"{folder}/run={run}"
    try:
        known = spark.read.schema(f"{STORE}, error string, questions int, run string").option("basePath", folder).parquet(folder).filter(F.col("run") != run)
        known.limit(1).count()
    except Exception as problem:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(problem):
            raise
        known = spark.createDataFrame([], f"{STORE}, error string, questions int, run string")
    kept = known.filter("digest is not null").select("digest", "answer").dropDuplicates(["digest"])
    ask(open_questions(candidates, kept), judge, batch).write.mode("overwrite").parquet(part)
    made = spark.read.schema(f"{STORE}, error string, questions int").parquet(part)
    store = kept.unionByName(made.filter("digest is not null").select("digest", "answer"))
    answered = candidates.withColumn("_digest", digest(F.col("question"))).join(store.select(F.col("digest").alias("_digest"), "answer"), "_digest", "left").drop("_digest")
    return answered, made.filter("error is not null").select("error", "questions")
