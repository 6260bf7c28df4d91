"""Quality rules as a ledger of failure bits.

Every rule is evaluated once. The ledger keeps the measurements and one bit for
each rule that a document fails; a policy is no more than a versioned mask over
these bits, so that changing a policy or asking what one rule costs (ablation)
reads the ledger and never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let, text_or_empty, words


@dataclass(frozen=True)
class Rule:
    """A document fails if the SQL condition over the measurements holds."""

    bit: int
    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A version of what is enforced: the names of the rules."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...]) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in self.rules)


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)"),
    Rule(5, "shouting", "n_upper > n_lower"),
    Rule(6, "exclamations", "5 * n_exclaim > n_words"),
)

BASE = ("few_words", "repeated_words")
POLICIES = (
    Policy("base", 1, BASE),
    Policy("corpus", 1, tuple(r.name for r in RULES)),
)


def repeated_window_words(tokens: Column, size: int = 3) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice.

    The windows' 64-bit hashes are sorted together with their positions, so
    that equal windows are neighbours; the positions found are sorted again and
    each adds the words up to the next one, ``size`` at most. All steps take
    n log n at most, whatever the text repeats.
    """

    def windows(w: Column) -> Column:
        at = lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(size)]).alias("h"), i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - size), at))

    def starts(s: Column) -> Column:
        h = lambda i: F.get(s, i)["h"]
        twice = lambda x, i: x["h"].eqNullSafe(h(i - 1)) | x["h"].eqNullSafe(h(i + 1))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: twice(x, i)), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.least(F.lit(size), F.coalesce(F.get(p, i + 1), x + size) - x))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    found = let(tokens, lambda w: F.when(F.size(w) > size, let(let(windows(w), starts), covered)).otherwise(F.lit(0).cast("long")))
    return F.coalesce(found, F.lit(0).cast("long"))


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct ``m`` of the measurements of each whole text.

    Null and empty texts measure zero everywhere.
    """
    whole = text_or_empty(text)

    def count(pattern: str) -> Column:
        return F.regexp_count(whole, F.lit(pattern)).cast("long")

    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(WORD))
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    word_counts = let(
        words(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n"),
            F.char_length(F.array_join(w, "")).cast("long").alias("chars"),
            repeated_window_words(w).alias("rep"),
        ),
    )
    return docs.withColumn("__w", word_counts).withColumn("__l", line_counts).withColumn(
        "m",
        F.struct(
            F.col("__w.n").alias("n_words"),
            F.col("__w.chars").alias("word_chars"),
            count("[#*$%&|<>]").alias("n_symbols"),
            F.col("__l.n").alias("n_lines"),
            F.col("__l.dup").alias("n_dup_lines"),
            F.col("__w.rep").alias("n_repeat_words"),
            count("[A-Z]").alias("n_upper"),
            count("[a-z]").alias("n_lower"),
            count("!").alias("n_exclaim"),
        ),
    ).drop("__w", "__l")


def ledger(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, keep: tuple[str, ...] | None = None) -> DataFrame:
    """One row per document row: kept columns, struct ``m``, long ``fail_bits``.

    ``keep`` names the input's columns to carry (all if None); the input may
    have any extra columns, and null or repeated keys are rows like others.
    Columns of the input named ``m`` or ``fail_bits`` give way to the ledger's.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in ("m", "fail_bits")]
    rows = measured(docs.select(*dict.fromkeys([*names, text])), text)
    bits = F.lit(0).cast("long")
    fields = rows.select("m.*").columns
    for rule in rules:
        condition = rule.fails
        for f in sorted(fields, key=len, reverse=True):
            condition = _field(condition, f)
        bits = bits.bitwiseOR(F.when(F.expr(condition), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return rows.select(*names, "m", bits.alias("fail_bits"))


def _field(condition: str, name: str) -> str:
    import re

    return re.sub(rf"(?<![\w.]){name}\b", f"m.{name}", condition)


def applied(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with a boolean ``kept`` under one policy's version."""
    return book.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) == 0)


def ablation(book: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of a policy: failures, and documents that only it rejects.

    Reads the failure bits alone. One partial aggregation over the distinct bit
    patterns (at most two to the number of rules), no matter how many documents.
    """
    mask = F.lit(policy.mask(rules)).cast("long")
    seen = book.groupBy(F.col("fail_bits").bitwiseAND(mask).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    own = [r for r in rules if r.name in policy.rules]
    kinds = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("long").alias("bit")) for r in own])
    each = seen.select("bits", "n", F.explode(kinds).alias("r"))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        F.sum(F.when(F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only_this"),
        F.sum(F.when(F.col("bits").bitwiseAND(F.lit(-1).cast("long").bitwiseXOR(F.col("r.bit"))) == 0, F.col("n")).otherwise(0)).alias("n_kept_without"),
    )
