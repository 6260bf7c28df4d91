"""URL verdicts from Bloom filter cascades.

A rule is a host and a path prefix. A URL's keys are its host's suffixes with
its path's prefixes, as many as the rules' shapes call for. A cascade answers
which keys are listed: its first level encodes the listed keys, the second those
keys of the corpus that the first takes for listed, the third the listed keys
that the second takes for such, and so on until a level errs no more. Over the
corpus's complete key universe its answers are exact, and no join is needed.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, let

#: (rule, verdict)
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
DEFAULT = "allow"


def scrambled(h: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes that differ by level (the finalizer of splitmix64)."""
    with np.errstate(over="ignore"):
        z = h.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


@dataclass
class Bloom:
    """A Bloom filter over 64-bit hashes."""

    salt: int
    bits: np.ndarray
    tries: int

    @classmethod
    def of(cls, hashes: np.ndarray, rate: float, salt: int) -> Bloom:
        n = max(1, len(hashes))
        size = max(64, math.ceil(-n * math.log(rate) / math.log(2) ** 2))
        made = cls(salt, np.zeros(-(-size // 8), np.uint8), max(1, round(size / n * math.log(2))) if len(hashes) else 1)
        at = made.places(hashes).ravel()
        np.bitwise_or.at(made.bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        return made

    def places(self, hashes: np.ndarray) -> np.ndarray:
        z = scrambled(hashes, self.salt)
        a, b = z & np.uint64(0xFFFFFFFF), (z >> np.uint64(32)) | np.uint64(1)
        steps = np.arange(self.tries, dtype=np.uint64)
        return ((a[:, None] + steps * b[:, None]) % np.uint64(8 * len(self.bits))).astype(np.int64)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        if not len(hashes):
            return np.zeros(0, bool)
        at = self.places(hashes)
        return ((self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)


@dataclass
class Cascade:
    """Levels in turn for listed keys and for keys mistaken for them."""

    levels: list[Bloom] = field(default_factory=list)

    @classmethod
    def first(cls, listed: np.ndarray, universe: int, stricter: int = 0) -> Cascade:
        """The first level; its rate lets through about as many as are listed.

        Each step of ``stricter`` lets an eighth as many mistaken keys through.
        """
        rate = min(0.5, max(1e-9, len(listed) / max(1, universe))) / 8**stricter
        return cls([Bloom.of(listed, rate, 0)] if len(listed) else [])

    def completed(self, listed: np.ndarray, mistaken: np.ndarray) -> Cascade:
        """``mistaken``: all hashes of the universe that level one errs on.

        A hash that a listed key shares is no mistake that levels could tell;
        who asks compares the keys.
        """
        inside, outside = listed, np.setdiff1d(mistaken, listed)
        while len(outside):
            level = Bloom.of(outside, 0.25, len(self.levels))
            self.levels.append(level)
            inside, outside = outside, inside[level.has(inside)]
        return self

    def has(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each is listed: by the parity of the level that says no."""
        out = np.zeros(len(hashes), bool)
        alive = np.arange(len(hashes))
        for k, level in enumerate(self.levels):
            yes = level.has(hashes[alive])
            out[alive[~yes]] = k % 2 == 1
            alive = alive[yes]
        out[alive] = len(self.levels) % 2 == 1
        return out

    @property
    def size_bytes(self) -> int:
        return sum(len(x.bits) for x in self.levels)


def split_url(url: str | Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    whole = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    shape = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return F.translate(F.regexp_extract(whole, shape, 1), UPPER, LOWER), F.regexp_extract(whole, shape, 2)


def keys_of(host: Column, path: Column, labels: int, lengths: Iterable[int]) -> Column:
    """A URL's keys, longest first (of equal lengths, the longer host first).

    Only suffixes of ``labels`` labels at most and path prefixes of the given
    lengths: no rule has another shape.
    """
    parts = F.split(host, r"\.")

    def suffixes(p: Column) -> Column:
        n = F.least(F.size(p), F.lit(labels))
        return F.transform(F.sequence(F.lit(1), n), lambda k: F.array_join(F.slice(p, F.size(p) - k + 1, k), "."))

    hosts = let(parts, suffixes)

    def prefixed(n: int) -> Column:
        return F.transform(hosts, lambda s: F.when(F.char_length(path) >= n, F.concat(s, F.substring(path, 1, n))))

    made = [prefixed(n) for n in sorted(lengths)]
    ordered = F.transform(F.filter(F.flatten(F.array(*made)), lambda k: k.isNotNull()), lambda k: F.struct((-F.char_length(k)).alias("n"), (-F.instr(k, "/")).alias("h"), k.alias("key")))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sort_array(ordered), lambda x: x["key"]))


def keyed(pages: DataFrame, rules: tuple[tuple[str, str], ...], seed: int, url: str = "url") -> DataFrame:
    hosts = [r.split("/", 1)[0] for r, _ in rules]
    lengths = {len(r) - len(h) for (r, _), h in zip(rules, hosts, strict=True)}
    host, path = split_url(url)
    rows = pages.withColumn("host", host).withColumn("path", path)
    rows = rows.withColumn("__keys", keys_of(F.col("host"), F.col("path"), max((h.count(".") + 1 for h in hosts), default=1), lengths))
    return rows.withColumn("__hashes", F.transform("__keys", lambda k: F.xxhash64(F.lit(seed), k)))


def built(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, seed: int = 7, url: str = "url") -> dict[str, Cascade]:
    """A cascade for each verdict, exact over every key of ``pages``.

    The universe stays distributed: it is counted, then tested against level
    one, whose rate lets about as many keys through as there are rules; only
    those reach the driver, after a count that holds them to a bound. Where
    chance lets more through, level one is made stricter until it does not.
    """
    spark = pages.sparkSession
    universe = keyed(pages.select(url), rules, seed, url).select(F.explode(F.arrays_zip("__keys", "__hashes")).alias("x")).select(F.col("x.__hashes").alias("h"))
    size = universe.agg(F.approx_count_distinct("h")).first()[0]
    kinds = sorted({v for _, v in rules})
    listed_rows = spark.createDataFrame([(r, v) for r, v in rules] or [("", "")], "rule string, verdict string").select("verdict", F.xxhash64(F.lit(seed), "rule").alias("h")).collect()
    listed = {k: np.array(sorted({x["h"] for x in listed_rows if x["verdict"] == k}), np.int64) for k in kinds}
    bound = 10_000 + 64 * len(rules)
    for stricter in range(64):
        cascades = {k: Cascade.first(listed[k], size, stricter) for k in kinds}

        def hits(batches: Iterator[pa.RecordBatch], cascades=cascades) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h = batch.column(0).to_numpy(zero_copy_only=False)
                kept = np.zeros(len(h), bool)
                for c in cascades.values():
                    kept |= c.has(h)
                yield pa.RecordBatch.from_arrays([pa.array(h[kept])], ["h"])

        got = universe.mapInArrow(hits, "h long").distinct().limit(bound + 1).collect()
        if len(got) <= bound:
            break
    seen = np.array(sorted(x["h"] for x in got), np.int64)
    for k in kinds:
        mistaken = np.setdiff1d(seen[cascades[k].has(seen)], listed[k])
        cascades[k].completed(listed[k], mistaken)
    return cascades


def judged(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES, default: str = DEFAULT, seed: int = 7, url: str = "url") -> DataFrame:
    """Adds host, path, rule and verdict to every row of ``pages``.

    The longest rule that fits decides; where none does, ``rule`` is null and
    the verdict is ``default``. Columns of those names in the input give way.
    Null urls and urls without ``://`` have an empty host and path and no rule;
    repeated rows are judged alike; an empty table gives an empty table.
    """
    rows = pages.drop(*({"host", "path", "rule", "verdict"} - {url}))
    cascades = built(rows, rules, seed, url)
    names = rows.columns
    work = keyed(rows, rules, seed, url)
    schema = ", ".join(f"`{c}` {t}" for c, t in work.drop("__keys", "__hashes").dtypes) + ", rule string, verdict string"
    listed = {kind: pa.array([r for r, v in rules if v == kind], pa.string()) for kind in cascades}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1)
            flat, starts = hashes.flatten().to_numpy(zero_copy_only=False), hashes.offsets.to_numpy() - hashes.offsets[0].as_py()
            texts = keys.flatten()
            rule, verdict = np.full(batch.num_rows, -1, np.int64), np.full(batch.num_rows, default, object)
            for kind, cascade in cascades.items():
                at = np.flatnonzero(cascade.has(flat))
                # The cascade knows hashes; a key that only shares a rule's is none.
                at = at[pc.is_in(texts.take(pa.array(at)), value_set=listed[kind]).to_numpy(zero_copy_only=False)]
                row = np.searchsorted(starts, at, side="right") - 1
                row, first = np.unique(row, return_index=True)
                at = at[first]
                better = (rule[row] < 0) | (at < rule[row])
                rule[row[better]], verdict[row[better]] = at[better], kind
            chosen = texts.take(pa.array(rule, mask=rule < 0))
            columns = [*batch.columns[:-2], chosen, pa.array(verdict, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "host", "path", "rule", "verdict"])

    return work.mapInArrow(judge, schema)
