"""The corpus pipeline: five stages over documents, each calling one operator on all that its predecessor kept.

All stages but the last return the columns of documents, extra ones too, whatever their names. No text is shortened before
it is judged, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import jaccard, language, mixing, packing, quality
from glyphmill.llm.shared import drop_dir, shared_dir, unveil, veil

#: A document goes if the language that it claims needs this share and so many phrases more than the one it reads as: a
#: line of names or numbers proves nothing, a sentence does.
SURE, LEAST_MORE = 0.25, 3


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: documents that the base limits or the adaptive fences reject go; null, empty and short texts are among them.

    A null lang or source is a group of its own; repeated rows go or stay together.
    """
    hidden = veil(docs, "text", "lang", "source")
    return unveil(quality.judge(hidden, hidden.columns[: len(docs.columns)], store=False).filter("kept"), docs)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: texts without a language go (null, empty, no letters), and those that surely aren't in the language they claim (null: any).

    Long texts are read whole; equal texts with equal claims go or stay together.
    """
    model = language.learn(docs, check=(SURE, LEAST_MORE))
    hidden = veil(docs, "lang", "text")
    found = language.identify(hidden, model, hidden.columns, claim="lang")
    wrong = (F.col("share") >= SURE) & (F.col("more") >= LEAST_MORE)
    return unveil(found.filter((F.col("lang_pred") != language.UNKNOWN) & ~F.coalesce(wrong, F.lit(False))), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: one document of each group stays, the row with the least (doc_id, hash of the text), null ids last.

    A null text counts as empty; a row that occurs twice stays once; long texts are compared whole.
    """
    return unveil(jaccard.keep_one(veil(docs, "doc_id", "text")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: of each document the words that the mix's slots take, a row for each pass; a null source is one, texts without words give none."""
    out = mixing.mixed(veil(docs, "doc_id", "source", "text"))
    return unveil(out.withColumn(f"c{docs.columns.index('text')}", F.col("text")), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: pieces of token ids and their places in sequences; null text is empty (an end id), long texts are cut, equal rows packed each."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("near duplicates", near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Quantile sketches, suffix automata, sampled paths and packing are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's result is written and read again as the next one's documents."""
    folder = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            drop_dir(spark, f"{folder}/{k - 1}")
    return docs
