"""Language-model scores of whole documents.

Words are counted over all training texts. The most frequent make the model's
head, the others are in classes by their first bytes; a gated recurrent network
(see :mod:`.gru`) predicts the class, then the head word. Inside a tail class a
word's own count decides, less a discount that makes room for the class's words
that training has not seen; those are one event, as they are for the base score.

Texts become symbols once, in a table that training and scoring share. Training
rows are dealt by hash into shards of about as many words each and into rounds.
In a round every shard learns from all of its part by itself, and then weights
and the optimizer's moments are averaged. Neither shards nor rounds hang on how
the input is split.
"""

from __future__ import annotations

import itertools
import math
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import text_or_empty, written

#: Stands for the end of a text: no word has a blank in it.
END = b" "
HEAD, TAIL = 1024, 64
#: Words whose counts every worker holds. Counts of the others are joined.
DICTIONARY = 1 << 18
#: The rounds together learn from every text once.
ROUNDS, RATE = 4, 0.015
#: Tokens of a shard, and tokens that are learned from in one go.
SHARD, CHUNK = 1 << 22, 1 << 20
#: Rows of weights that one task adds up, and rows that the driver does.
FAN, LAST = 256, 16
HELD = 200_000


def tokens(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; null has none."""
    return (text or "").encode().lower().split()


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[:2]) % TAIL


def counted(texts: DataFrame) -> DataFrame:
    """(word, n) over all texts, with one end for each text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                held.update(tokens(text.as_py()))
                held[END] += 1
                if len(held) > HELD:
                    yield told()
        yield told()

    return texts.select("text").mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The dictionary's words with counts, and what all words add up to."""

    places: dict[bytes, int]
    counts: np.ndarray
    symbols: np.ndarray
    total: int
    distinct: int
    #: Of each tail class: how often its words occur, and how many there are.
    mass: np.ndarray
    kinds: np.ndarray
    discount: float
    shape: gru.Shape

    @classmethod
    def of(cls, counts: DataFrame) -> Vocabulary:
        times = lambda n: F.count_if(F.col("n") == n)
        total, distinct, once, twice = (int(x or 0) for x in counts.agg(F.sum("n"), F.count(F.lit(1)), times(1), times(2)).first())
        # Words by how frequent they are, in steps of a 64th of a doubling: as
        # many steps as fit are taken whole, so no sort is needed to choose.
        step = F.floor(F.log2("n") * 64).cast("int")
        sizes = sorted(((r["s"], r["count"]) for r in counts.groupBy(step.alias("s")).count().collect()), reverse=True)
        room, least = DICTIONARY, None
        for s, size in sizes:
            room -= size
            if room < 0:
                break
            least = s
        top = counts.filter(step >= F.lit(least)).toArrow() if least is not None else counts.limit(0).toArrow()
        pairs = sorted(((w, n) for w, n in zip(top.column(0).to_pylist(), top.column(1).to_pylist(), strict=True) if w != END), key=lambda x: (-x[1], x[0]))
        ends = counts.filter(F.col("word") == F.lit(END)).first()
        pairs.insert(0, (END, ends["n"] if ends else 0))
        kind = F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(TAIL)).cast("int")
        mass, kinds = np.zeros(TAIL), np.zeros(TAIL)
        for r in counts.filter(F.col("word") != F.lit(END)).groupBy(kind.alias("k")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
            mass[r["k"]], kinds[r["k"]] = r["n"], r["v"]
        n = np.array([c for _, c in pairs], np.int64)
        head = min(HEAD, len(pairs))
        symbols = np.array([k if k < head else head + tail_class(w) for k, (w, _) in enumerate(pairs)], np.int16)
        for w, c in pairs[1:head]:
            mass[tail_class(w)] -= c
            kinds[tail_class(w)] -= 1
        # What words lose that occur once or more, by how many occur once and twice.
        discount = min(0.9, max(0.1, once / max(1, once + 2 * twice)))
        return cls({w: k for k, (w, _) in enumerate(pairs)}, n, symbols, total, distinct, mass, kinds, discount, gru.Shape(head, TAIL))

    def symbol_counts(self) -> np.ndarray:
        return np.concatenate([self.counts[: self.shape.head], self.mass + 0.5])

    @property
    def unseen(self) -> np.ndarray:
        """What a class keeps for words that training has not: never nothing."""
        return self.discount * self.kinds + 0.5

    def encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Places in the dictionary (-1: not there), symbols (with the end's), words not there."""
        at = np.empty(len(words) + 1, np.int64)
        at[:-1] = np.fromiter(map(self.places.get, words, itertools.repeat(-1)), np.int64, len(words))
        at[-1] = 0
        symbols = self.symbols[at]
        missing = np.flatnonzero(at < 0)
        rare = [words[k] for k in missing]
        symbols[missing] = [self.shape.head + tail_class(w) for w in rare]
        return at, symbols, rare


RARE = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))


def encoded(rows: DataFrame, known) -> DataFrame:
    """What scores and training need of each row, with its text as symbols.

    ``inner``: log10 of the probabilities that words of the dictionary have in
    their tail classes, and for the others of what that is divided by. ``rare``:
    the words whose counts are to be joined. ``row`` is drawn, so write the
    table before reading it twice.
    """
    ids = dict(rows.dtypes)["doc_id"]
    schema = f"row binary, doc_id {ids}, train boolean, place long, n_tokens long, n_known long, base double, inner double, symbols binary, rare array<struct<word:binary,n:bigint>>"
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = known.value
        base_room = math.log10(v.total + 0.5 * (v.distinct + 1))
        own = np.log10(v.counts + 0.5)
        tail = v.symbols >= v.shape.head
        inner = np.where(tail, np.log10(np.where(tail, v.counts - v.discount, 1.0)), 0.0)
        room = np.concatenate([np.zeros(v.shape.head), np.log10(v.mass + 0.5)])
        for batch in batches:
            base, inside, n, n_known, symbols, rare = [], [], [], [], [], []
            for t in batch.column(3):
                at, s, missing = v.encoded(tokens(t.as_py()))
                there = at[at >= 0]
                base.append(own[there].sum() - len(at) * base_room)
                inside.append(inner[there].sum() - room[s].sum())
                n.append(len(at))
                n_known.append(int((v.counts[there] > 0).sum()))
                rare.append([{"word": w, "n": c} for w, c in Counter(missing).items()])
                symbols.append(s.astype("<i2").tobytes())
            made = [pa.array([uuid.uuid4().bytes for _ in n], pa.binary()), *batch.columns[:3], pa.array(n, pa.int64()), pa.array(n_known, pa.int64())]
            made += [pa.array(base, pa.float64()), pa.array(inside, pa.float64()), pa.array(symbols, pa.binary()), pa.array(rare, RARE)]
            yield pa.RecordBatch.from_arrays(made, names)

    return rows.select("doc_id", "__train", F.xxhash64(F.lit(42), F.col("doc_id").cast("string"), "text").alias("place"), "text").mapInArrow(encode, schema)


def symbols_of(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), "<i2") for x in column]


class Learner:
    """The weights and the optimizer's moments, as a flat vector and back."""

    def __init__(self, shape: gru.Shape, weights: dict[str, np.ndarray]):
        self.shape, self.names = shape, list(weights)
        self.sizes = {k: x.shape for k, x in weights.items()}

    def flat(self, *parts: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([p[k].ravel() for p in parts for k in self.names])

    def parts(self, flat: np.ndarray) -> list[dict[str, np.ndarray]]:
        out, at = [], 0
        while at < len(flat):
            out.append({})
            for k in self.names:
                n = math.prod(self.sizes[k])
                out[-1][k] = flat[at : at + n].reshape(self.sizes[k]).astype(np.float32)
                at += n
        return out

    def learned(self, flat: np.ndarray, steps: int, chunks: Iterator[list[np.ndarray]]) -> tuple[np.ndarray, int, int]:
        """What texts make of weights and moments; updates so far; tokens."""
        p, m, v = self.parts(flat)
        best = gru.Adam(p, RATE)
        best.m, best.v, best.t = m, v, steps
        n = sum(gru.learned(p, self.shape, best, texts) for texts in chunks)
        return self.flat(p, best.m, best.v), best.t, n


def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (x, n, steps) added up: vectors weighted by n already, the most steps."""
    total, n, steps = None, 0, 0
    for batch in batches:
        for x, k, s in zip(*(batch.column(i) for i in range(3)), strict=True):
            one = np.frombuffer(x.as_py(), np.float64)
            total = one.copy() if total is None else total + one
            n, steps = n + k.as_py(), max(steps, s.as_py())
    if total is not None:
        yield summed(total, n, steps)


def summed(total: np.ndarray, n: int, steps: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n]), pa.array([steps])], ["x", "n", "steps"])


SUMS = "x binary, n long, steps long"


def trained(rows: DataFrame, vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """Weights after the rounds, from ``place`` and ``symbols`` of training rows.

    A shard's part of a round is read in the order of ``place`` and learned from
    in chunks, so no task holds more than a chunk. Rows that share ``place`` are
    alike in id and text, and their order is nothing; they share a shard.
    """
    spark = rows.sparkSession
    weights = gru.initial(vocabulary.shape, vocabulary.symbol_counts())
    learner = Learner(vocabulary.shape, weights)
    zero = {k: np.zeros_like(x) for k, x in weights.items()}
    state, steps = learner.flat(weights, zero, zero), 0
    shards = max(1, -(-vocabulary.total // SHARD))
    # Each task takes the shards that the hash deals to it, one after the other.
    spread = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    for turn in range(ROUNDS):
        begin = spark.sparkContext.broadcast((state, steps))

        def learn(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            flat, so_far = begin.value
            total, n, most = np.zeros(len(flat)), 0, 0
            rows_ = ((s, t) for b in batches for s, t in zip(b.column(0).to_pylist(), symbols_of(b.column(1)), strict=True))
            for _, group in itertools.groupby(rows_, key=lambda x: x[0]):
                made, done, k = learner.learned(flat, so_far, chunks(t for _, t in group))
                total += made.astype(np.float64) * k
                n, most = n + k, max(most, done)
            if n:
                yield summed(total, n, most)

        part = rows.filter(F.pmod("place", F.lit(ROUNDS)) == turn)
        part = part.withColumn("shard", F.pmod(F.xxhash64(F.lit(7), "place"), F.lit(shards)).cast("int"))
        sums = part.repartition(spread, "shard").sortWithinPartitions("shard", "place").select("shard", "symbols").mapInArrow(learn, SUMS)
        n = spread
        while n > LAST:
            n = max(LAST, -(-n // FAN))
            sums = sums.repartition(n).mapInArrow(added, SUMS)
        got = sums.toArrow()
        if got.num_rows:
            last = next(added(iter(got.combine_chunks().to_batches())))
            state, steps = np.frombuffer(last.column(0)[0].as_py(), np.float64) / last.column(1)[0].as_py(), last.column(2)[0].as_py()
            state = state.astype(np.float32)
        begin.unpersist()
    return learner.parts(state)[0]


def chunks(texts: Iterator[np.ndarray]) -> Iterator[list[np.ndarray]]:
    """Whole texts of so many tokens together, or one text that has more."""
    held, n = [], 0
    for t in texts:
        held.append(t)
        n += len(t)
        if n >= CHUNK:
            yield held
            held, n = [], 0
    if held:
        yield held


def scored(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row.

    ``training`` says which rows the model learns from. Scores are log10
    probabilities of whole texts with their end: ``score`` the model's,
    ``base_score`` that of the smoothed word frequencies. Words that training
    has not seen are one event in both (in the model, one of each tail class).
    Null and empty texts have the end alone. Rows that repeat score alike, null
    ids are rows like others, and a table without training rows scores by
    uniform chance.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty(text).alias("text"), F.coalesce(training, F.lit(False)).alias("__train"))
    counts = written(counted(rows.filter("__train")), "lm-counts")
    vocabulary = Vocabulary.of(counts)
    table = written(encoded(rows, spark.sparkContext.broadcast(vocabulary)), "lm-symbols")
    shared = spark.sparkContext.broadcast((vocabulary.shape, trained(table.filter("train").select("place", "symbols"), vocabulary)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape, p = shared.value
        for batch in batches:
            logs = gru.document_log_probs(p, shape, symbols_of(batch.column(batch.num_columns - 1))) / math.log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(logs)], [*batch.schema.names[:-1], "logs"])

    plain = table.select("row", "doc_id", "n_tokens", "n_known", "base", "inner", "symbols")
    made = plain.mapInArrow(score, ", ".join(f"{c} {t}" for c, t in plain.dtypes[:-1]) + ", logs double")
    rare = table.select("row", F.explode("rare").alias("r")).select("row", "r.word", F.col("r.n").alias("times"))
    seen = counts.filter(F.col("n") <= int(vocabulary.counts[1:].min()) if len(vocabulary.counts) > 1 and vocabulary.distinct > len(vocabulary.counts) else F.lit(True))
    kind = F.pmod(F.crc32(F.substring("word", 1, 2)), F.lit(TAIL)).cast("int")
    left = F.get(F.array(*map(F.lit, vocabulary.unseen.tolist())), kind)
    joined = rare.join(seen, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce(F.col("n") - vocabulary.discount, left))).alias("more_inner"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("more_known"),
    )
    none = F.lit(0.0)
    return made.join(joined, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(vocabulary.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", none)).alias("base_score"),
        (F.col("logs") + F.col("inner") + F.coalesce("more_inner", none)).alias("score"),
    )
