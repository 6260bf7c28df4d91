"""The corpus pipeline: stages over ``documents``, each one of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.llm import decontamination, mixing, quality_rules, secret_scan, simhash
from quillmap.llm.common import dropped, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of quality rules accepts.

    Null, empty and short texts fail for their few words. Each row is judged by
    itself: rows that repeat all stay or all go, null ids are rows like others,
    columns beyond those of documents fall away, no rows give none.
    """
    book = quality_rules.ledger(docs, keep=COLUMNS)
    return quality_rules.applied(book, quality_rules.POLICIES[1]).filter("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8).

    The one with the least doc_id stays, nulls last, ties by all columns. Texts
    without words are a group, rows that repeat are one, no rows give none.
    """
    return simhash.one_of_each(docs.select(*COLUMNS))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts and items match nothing, so such documents stay; each
    row is judged by itself, whatever its id; no rows give none.
    """
    return decontamination.cleaned(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in their texts masked; n_chars follows where one was.

    Null texts stay null; rows that repeat all stay and are masked alike; no
    rows give none.
    """
    docs = docs.select(*COLUMNS)
    rules = secret_scan.MASKED_RULES
    found = secret_scan.with_findings(docs, secret_scan.scanned(docs, rules=rules), rules=rules)
    masked = found.withColumn("text", secret_scan.redacted(F.col("text"), F.col("secrets")))
    length = F.when(F.size("secrets") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return masked.withColumn("n_chars", length).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, copies numbered from 1.

    A null source is a source. Texts without words are never taken. Rows that
    agree in all columns are drawn each by itself, and their copies are
    numbered together; no rows give none.
    """
    keyed = docs.select(*COLUMNS, simhash.whole_key(COLUMNS).alias("key"))
    taken = mixing.mixed(keyed, by="key").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies")).filter("copies > 0")
    rows = keyed.join(taken, "key").dropDuplicates(["key"])
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))


STAGES = [
    ("quality rules", rules),
    ("near duplicates", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", secrets_masked),
    ("mixing", mixed),
]

#: SimHash components, edit distances and seeded rounding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each one's rows are written and read again.

    A stage's table is deleted once the next one is written; the last, which
    the result reads, stays.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
