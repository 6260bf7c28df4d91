"""Quality by importance resampling.

Two generative models of hashed unigrams and bigrams, one of target texts and one
of all texts, give each text the log ratio of its probabilities. Adding Gumbel
noise and taking the k largest samples k texts without replacement in proportion
to that ratio.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_small, written

BUCKETS = 10_000
SMOOTH = 1.0
KEEP = 0.85
#: Words whose hashes a worker remembers.
REMEMBERED = 500_000


class Features:
    """Buckets of a text's words and word pairs."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        w = (text or "").encode().lower().split()
        if not w:
            return np.zeros(0, np.int64)
        known = self.known
        try:
            h = [known[x] for x in w]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for x in set(w):
                if x not in known:
                    known[x] = zlib.crc32(x)
            h = [known[x] for x in w]
        one = np.array(h, np.uint64)
        mix = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:]) * np.uint64(0xBF58476D1CE4E5B9)
        two = mix >> np.uint64(32)
        return (np.concatenate([one, two]) % np.uint64(self.buckets)).astype(np.int64)


def ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | all), over all texts.

    ``target``: doc_ids of target texts. Each task adds up its own counts, so
    what is shuffled and what reaches the driver is bounded by the buckets.
    """
    marks = target.filter("doc_id IS NOT NULL").select("doc_id").distinct().withColumn("__target", F.lit(True))
    rows = joined_small(docs.select("doc_id", "text"), marks, "doc_id", "left", 1_000_000).select("text", F.coalesce("__target", F.lit(False)).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, sums = Features(buckets), np.zeros((2, buckets), np.int64)
        for batch in batches:
            for text, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c = np.bincount(made(text), minlength=buckets)
                sums[1] += c
                if t:
                    sums[0] += c
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(sums[0]), pa.array(sums[1])], ["bucket", "target", "every"])

    got = rows.mapInArrow(count, "bucket long, target long, every long").groupBy("bucket").agg(F.sum("target").alias("target"), F.sum("every").alias("every")).collect()
    counts = np.zeros((2, buckets))
    for r in got:
        counts[:, r["bucket"]] = r["target"], r["every"]
    counts += SMOOTH
    return np.log(counts[0] / counts[0].sum()) - np.log(counts[1] / counts[1].sum())


def weighed(docs: DataFrame, ratio: np.ndarray, seed: int = 42) -> DataFrame:
    """(doc_id, log_weight, key) of every row; key is the weight plus Gumbel noise.

    The noise hangs on doc_id, so reruns agree and rows that repeat tie.
    """
    shared = docs.sparkSession.sparkContext.broadcast(ratio)
    rows = docs.select("doc_id", "text")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, r = Features(len(shared.value)), shared.value
        for batch in batches:
            w = [float(r[made(t)].sum()) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w, pa.float64())], ["doc_id", "log_weight"])

    out = rows.mapInArrow(weigh, f"doc_id {dict(rows.dtypes)['doc_id']}, log_weight double")
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 11) + 0.5) / float(1 << 53)
    return out.withColumn("key", F.col("log_weight") - F.log(-F.log(u)))


def kth_largest(values: DataFrame, column: str, k: int, bins: int = 1024, few: int = 20_000) -> float | None:
    """The k-th largest value, exactly, by narrowing histograms."""
    if k < 1:
        return None
    inside, rank = F.lit(True), k
    while True:
        low, high, n = values.filter(inside).agg(F.min(column), F.max(column), F.count(column)).first()
        if not n:
            return None
        if rank >= n:
            return low
        if low == high:
            return low
        if n <= few:
            return sorted((r[0] for r in values.filter(inside).select(column).collect()), reverse=True)[rank - 1]
        width = (high - low) / bins
        cell = F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width)).cast("int")
        for r in sorted(values.filter(inside).groupBy(cell.alias("c")).count().collect(), key=lambda r: -r["c"]):
            if rank <= r["count"]:
                narrower = F.col(column).between(low, high) & (cell == r["c"])
                inside = inside & narrower
                break
            rank -= r["count"]


def resampled(docs: DataFrame, target: DataFrame, keep: float = KEEP, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_weight, kept) for every row.

    ceil(keep * rows) rows are kept, with all that tie with the last of them.
    Null and empty texts have no features and the weight of an average text (0);
    without a target text all weights are near those of chance; an empty table
    gives an empty table; other columns are not read.
    """
    rows = written(weighed(docs, ratios(docs, target, buckets), seed), "resampling")
    n = rows.count()
    least = kth_largest(rows, "key", -int(-keep * n // 1))
    return rows.select("doc_id", "log_weight", (F.col("key") >= F.lit(least).cast("double")).alias("kept"))
