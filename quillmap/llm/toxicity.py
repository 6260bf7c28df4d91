"""Toxic passages as maximum-scoring segments of token log-odds.

Tokens' log-odds of toxic against other labelled texts are shrunk by a Dirichlet
prior; those that stand out make a lexicon, all other tokens cost a little. One
linear scan finds every maximal scoring segment of a text. Extreme-value
statistics turn a segment's score into the number of such segments that chance
would make in a text of that length, and a logistic curve over a text's evidence,
fitted on the labelled texts, gives the score.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, joined_small

#: ASCII that is no letter or digit separates tokens.
CLEAN = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(128)) + bytes(range(128, 256))
#: What a token outside the lexicon adds.
COST = -0.02
#: Texts of the prior, toxic and other as all labelled texts are: they draw the
#: log-odds of features in few texts to even.
PRIOR = 3.0
#: Log-odds that put a feature in the lexicon.
STANDS_OUT = 2.5
MOST_ODDS = 8.0
#: A word's beginnings of so many bytes are features too: stems take endings.
STEMS = (4, 5, 6)
#: A passage is significant if chance makes fewer than this many in its text.
CHANCE = 0.01
#: Bins of evidence for the calibration.
BINS, BIN = 64, 0.5
#: Distinct tokens that a task holds before it passes its counts on.
HELD = 200_000
#: Toxic texts that a feature must be in: one alone says nothing of others.
SUPPORT = 2


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().translate(CLEAN).split()


def features(words: set[bytes]) -> set[bytes]:
    """Words and, with a star, the beginnings of longer words."""
    out = set(words)
    for n in STEMS:
        out.update(w[:n] + b"*" for w in words if len(w) > n)
    return out


class Scores(dict):
    """Token scores, looked up in the lexicon once and remembered."""

    def __init__(self, odds: dict[bytes, float]):
        super().__init__()
        self.odds = odds

    def __missing__(self, word: bytes) -> float:
        if len(self) > HELD:
            self.clear()
        self[word] = score = max(self.odds.get(f, 0.0) for f in features({word}))
        return score


def segments(hits: list[tuple[int, float]]) -> list[tuple[int, int, float]]:
    """(first, last, score) of all maximal scoring segments.

    ``hits``: places and positive scores of the tokens in the lexicon, in order;
    tokens between add ``COST`` each. Segments are disjoint, none can grow or
    shrink to gain, and each hit is pushed and popped once.
    """
    found: list[list[float]] = []  # first, last, total before, total through
    total, end = 0.0, 0
    for place, score in hits:
        before = total + COST * (place - end)
        through = before + score
        new = [place, place, before, through]
        total, end = through, place + 1
        while found:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= new[2]:
                k -= 1
            if k < 0 or found[k][3] >= new[3]:
                break
            new = [found[k][0], new[1], found[k][2], new[3]]
            del found[k:]
        found.append(new)
    return [(int(a), int(b), r - left) for a, b, left, r in found]


@dataclass
class Model:
    """Token scores, the extreme-value constants and the logistic curve."""

    odds: dict[bytes, float]
    rate: float = 1.0
    scale: float = 1.0
    intercept: float = -4.0
    slope: float = 1.0

    def __post_init__(self):
        self.scores = Scores(self.odds)

    def passages(self, text: str | None) -> tuple[list[tuple[int, int, float, float]], float]:
        """Significant passages (first and last token, score, expected by chance) and the evidence."""
        t = tokens(text)
        hits = [(i, s) for i, s in enumerate(map(self.scores.__getitem__, t)) if s]
        if not hits:
            return [], 0.0
        out, evidence = [], 0.0
        for first, last, score in segments(hits):
            chance = self.scale * len(t) * math.exp(-self.rate * score)
            if chance < CHANCE:
                out.append((first, last, score, chance))
                evidence -= math.log10(max(chance, 1e-300))
        return out, min(evidence, BINS * BIN)

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.intercept + self.slope * evidence))))


def counted(labelled: DataFrame) -> DataFrame:
    """(word, toxic, other): how many labelled texts have each feature.

    Texts are counted and not tokens, so that one text that repeats itself says
    no more than another. The empty feature is in every text.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter(), Counter()

        def told() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([held[1][k] for k in keys], pa.int64()), pa.array([held[0][k] for k in keys], pa.int64())], ["word", "toxic", "other"])
            for h in held:
                h.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held[toxic].update(features({b"", *tokens(text)}))
                if len(held[0]) + len(held[1]) > HELD:
                    yield told()
        yield told()

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(count, "word binary, toxic long, other long")
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))


def lexicon(counts: DataFrame) -> dict[bytes, float]:
    """Log-odds of all features that stand out in ``SUPPORT`` toxic texts or more.

    They are no more than the labelled texts have, which are what bounds them.
    """
    texts = counts.filter(F.octet_length("word") == 0).first()
    n1, n0 = (texts["toxic"], texts["other"]) if texts else (0, 0)
    if not n1 or not n0:
        return {}
    a1, a0 = PRIOR * n1 / (n1 + n0), PRIOR * n0 / (n1 + n0)
    odds = F.log((F.col("toxic") + a1) / (F.col("other") + a0)) - math.log((n1 + PRIOR) / (n0 + PRIOR))
    rows = counts.filter((F.col("toxic") >= SUPPORT) & (F.octet_length("word") > 0)).select("word", odds.alias("odds"))
    found = rows.filter(F.col("odds") >= STANDS_OUT).toArrow()
    return {w: min(MOST_ODDS, o) for w, o in zip(found.column(0).to_pylist(), found.column(1).to_pylist(), strict=True)}


def decay(moments: list[tuple[float, int]], tokens: int) -> float:
    """The positive root of E[exp(rate * score)] = 1 over clean texts' tokens.

    ``moments``: (score, tokens with it) of the lexicon's tokens in clean texts.
    """
    hit = sum(n for _, n in moments)
    rest = max(0, tokens - hit) + 1

    def moment(r: float) -> float:
        return (rest * math.exp(r * COST) + sum(n * math.exp(r * s) for s, n in moments)) / (rest + hit) - 1

    low, high = 0.0, 1e-3
    while moment(high) < 0 and high < 2:
        low, high = high, high * 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if moment(middle) < 0 else (low, middle)
    return min(1.0, max(high, 0.05))


def measured(labelled: DataFrame, model: Model) -> tuple[list, list]:
    """Texts by class and bin of evidence; clean texts' tokens by score.

    Both are histograms of a fixed number of cells.
    """
    schema = "kind int, toxic int, bin int, n long"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                _, evidence = model.passages(text)
                sums[0, toxic, min(BINS - 1, math.ceil(evidence / BIN))] += 1
                if not toxic:
                    for s in map(model.scores.__getitem__, tokens(text)):
                        sums[1, 0, round(s * 16)] += 1
        rows = [(*k, n) for k, n in sums.items()]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(4)], ["kind", "toxic", "bin", "n"])

    rows = labelled.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(measure, schema).groupBy("kind", "toxic", "bin").agg(F.sum("n").alias("n")).collect()
    return [r for r in rows if r["kind"] == 0], [r for r in rows if r["kind"] == 1]


def curve(bins: list) -> tuple[float, float]:
    """Intercept and slope of the logistic curve, with a weak prior on both."""
    x = np.array([max(0.0, r["bin"] - 0.5) * BIN for r in bins])
    y, w = np.array([float(r["toxic"]) for r in bins]), np.array([float(r["n"]) for r in bins])
    a, b = -3.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        g = w * (y - p)
        h = w * p * (1 - p)
        grad = np.array([g.sum() - 0.1 * (a + 3.0), (g * x).sum() - 0.1 * (b - 1.0)])
        hess = np.array([[h.sum() + 0.1, (h * x).sum()], [(h * x).sum(), (h * x * x).sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(a), float(max(b, 0.0))


def fitted(docs: DataFrame, labels: DataFrame, folds: int = 4, held_out: int = 2) -> Model:
    """A model of the labelled texts outside the held-out fold.

    A text with several labels is toxic if one says so; null labels say nothing.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.filter(fold(folds, F.col("doc_id")) != held_out)
    rows = docs.select("doc_id", "text").filter(fold(folds, F.col("doc_id")) != held_out)
    labelled = joined_small(rows, known, "doc_id", max_rows=1_000_000)
    counts = counted(labelled).persist()
    model = Model(lexicon(counts))
    counts.unpersist()
    if model.odds:
        cells = measured(labelled, model)[1]
        hits = [(r["bin"] / 16, r["n"]) for r in cells if r["bin"] > 0]
        n = sum(r["n"] for r in cells)
        model.rate = decay(hits, n)
        # So that as many single tokens of clean texts reach a score as chance makes.
        model.scale = max([k * math.exp(model.rate * s) for s, k in hits] + [math.exp(model.rate * STANDS_OUT)]) / (n + 1)
    model.intercept, model.slope = curve(measured(labelled, model)[0])
    return model


SCHEMA = "score double, passages array<struct<first:int,last:int,score:double,chance:double>>"


def scored(docs: DataFrame, model: Model, carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """(carried columns, score, passages) for every row, over whole texts.

    Passages are given by their first and last token. Null and empty texts have
    none and get the score of texts without evidence; rows that repeat score
    alike; tables without rows give none.
    """
    rows = docs.select(*carry, F.col(text).alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes[:-1]) + ", " + SCHEMA
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("chance", pa.float64())]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.passages(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            lists = [[dict(zip(("first", "last", "score", "chance"), p, strict=True)) for p in ps] for ps, _ in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([m.score(e) for _, e in found], pa.float64()), pa.array(lists, kind)], names=[*carry, "score", "passages"])

    return rows.mapInArrow(score, schema)
