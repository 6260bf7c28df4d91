"""Secret scans over a ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text. The ledger
remembers which rule versions a blob has been scanned with; a scan reads only
pairs of blob and rule version that it has not, and findings are joined back to
all paths whose versions share the blob. All of it is DataFrame expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import joined_small, let, text_or_empty, written

MASK = "[SECRET]"
SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


@dataclass(frozen=True)
class Rule:
    """A kind of secret. ``at_least``: characters of ``group`` in a match."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    at_least: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


BASE_RULES = (
    # Upper case is spelled out: what folds to an ASCII letter differs by engine.
    Rule(
        "assign",
        1,
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    # A run that is too short has no longer one inside it, so the least length
    # can stand in the pattern and short runs make no matches to throw away.
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}", 0, 18),
    Rule("hex", 1, r"[0-9a-f]{16,}", 0, 16),
)
RULES = (
    *BASE_RULES,
    Rule("private_key", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    # A run that nothing follows is a match too, which is thrown away: so no run
    # is begun again from its inside.
    Rule("jwt", 2, r"eyJ[A-Za-z0-9_-]{10,}+((?:\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]+)?)", 1, 1),
)
#: Between lines of a key; line ends may be spelled as escapes.
_GAP = r"(?:\s|\\[nr]){1,8}"
#: With a private key's body: up to its END line or, where that is missing, as far
#: as lines of base64 go. ``op9_secret_scan`` and its SQL keep the BEGIN line alone.
MASKED_RULES = tuple(
    r
    if r.kind != "private_key"
    else Rule(
        r.kind,
        2,
        rf"{r.pattern}(?:[^-]*+(?:-{{1,4}}[^-]+){{0,8}}-----END [A-Z ]*PRIVATE KEY-----"
        rf"|(?:{_GAP}(?:Proc-Type|DEK-Info):[^\r\n]*){{0,2}}(?:{_GAP}[A-Za-z0-9+/=]{{16,}}){{0,1000}}(?:{_GAP}[A-Za-z0-9+/]*={{1,2}})?)",
    )
    for r in RULES
)


def running(values: Column, join, zero: Column, chunk: int = 128) -> Column:
    """Running totals of an array, each including its own element.

    Chunks are folded apart and then shifted by the total before them, so that
    growing the result copies a chunk and not the whole array.
    """

    def folded(part: Column, first: Column) -> Column:
        step = lambda a, x: F.concat(a, F.array(join(F.coalesce(F.try_element_at(a, F.lit(-1)), first), x)))
        return F.aggregate(part, F.array().cast("array<bigint>"), step)

    def chunks(v: Column) -> Column:
        n = F.floor((F.size(v) - 1) / chunk).cast("int")
        return F.transform(F.sequence(F.lit(0), n), lambda c: F.slice(v, c * chunk + 1, F.lit(chunk)))

    def shifted(parts: Column) -> Column:
        totals = F.transform(parts, lambda p: F.aggregate(p, zero, join))
        return let(folded(totals, zero), lambda t: F.flatten(F.transform(parts, lambda p, i: folded(p, F.coalesce(F.get(t, i - 1), zero)))))

    nothing = F.array().cast("array<bigint>")
    return let(values, lambda v: F.when(F.size(v) > 0, let(chunks(v), shifted)).otherwise(nothing))


def matched(text: Column, rule: Rule, number: int) -> Column:
    """Spans of a rule in a text: leftmost, not overlapping, in code points.

    Text between matches and the matches alternate, so offsets are running sums
    of their lengths.
    """
    none = F.array().cast(SPANS)

    def spans(found: Column) -> Column:
        gaps = F.transform(F.split(text, rule.pattern), lambda x: F.char_length(x).cast("long"))
        sizes = F.transform(found, lambda x: F.char_length(x).cast("long"))
        own = F.transform(F.regexp_extract_all(text, F.lit(rule.pattern), rule.group), lambda x: F.char_length(x)) if rule.group else sizes

        def placed(ends: Column, lens: Column, groups: Column) -> Column:
            at = lambda e, i: F.struct((e - F.get(lens, i)).alias("start"), F.lit(number).alias("kind"), e.alias("end"), F.get(groups, i).alias("own"))
            kept = F.filter(F.transform(ends, at), lambda x: x["own"] >= rule.at_least)
            return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end"))).cast(SPANS)

        def summed(lens: Column) -> Column:
            steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(lens)), lens, lambda a, b: a + b)
            return let(running(steps, lambda a, b: a + b, F.lit(0).cast("long")), lambda ends: let(own, lambda o: placed(ends, lens, o)))

        return let(sizes, summed)

    return let(F.regexp_extract_all(text, F.lit(rule.pattern), 0), lambda f: F.when(F.size(f) > 0, spans(f)).otherwise(none))


def blob_id(text: Column) -> Column:
    return F.sha2(text_or_empty(text).cast("binary"), 256)


def scanned(docs: DataFrame, ledger: DataFrame | None = None, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """New rows for the ledger: blob_id, rules (scanned now), findings.

    Only pairs of blob and rule version that ``ledger`` lacks are scanned; a
    blob that it has with all rules makes no row. ``findings`` has kind, the
    rule's version and the span of each secret. Null texts count as empty.
    """
    texts = docs.select(blob_id(F.col(text)).alias("blob_id"), text_or_empty(text).alias("blob"))
    keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        blobs = texts.groupBy("blob_id").agg(F.first("blob").alias("blob")).withColumn("todo", keys)
    else:
        # Identifiers alone meet the ledger; texts move only if something is left to scan in them.
        seen = ledger.groupBy("blob_id").agg(F.flatten(F.collect_set("rules")).alias("seen"))
        todo = F.array_except(keys, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
        left = texts.select("blob_id").distinct().join(seen, "blob_id", "left").select("blob_id", todo.alias("todo")).filter(F.size("todo") > 0)
        blobs = joined_small(texts, written(left, "unseen-blobs"), "blob_id").groupBy("blob_id").agg(F.first("blob").alias("blob"), F.first("todo").alias("todo"))
    none = F.array().cast(SPANS)
    each = [F.when(F.array_contains("todo", r.key), matched(F.col("blob"), r, k)).otherwise(none) for k, r in enumerate(rules)]
    names = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
    told = F.transform(F.concat(*each), lambda x: F.struct(F.get(names, x["kind"])["kind"].alias("kind"), F.get(names, x["kind"])["version"].alias("version"), x["start"].alias("start"), x["end"].alias("end")))
    return blobs.select("blob_id", F.col("todo").alias("rules"), told.alias("findings"))


def with_findings(docs: DataFrame, ledger: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows of ``docs`` with ``secrets``: what the ledger has on their blobs.

    ``secrets`` is sorted by start, then kind as ``rules`` list them; it holds
    findings of the current rule versions alone and is empty where there are
    none. A column of that name in the input gives way.
    """
    order = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.key), F.lit(k))])
    hits = ledger.select("blob_id", F.explode("findings").alias("f"))
    hits = hits.withColumn("kind", F.try_element_at(order, F.concat_ws("@", "f.kind", "f.version"))).filter("kind IS NOT NULL")
    by_blob = hits.groupBy("blob_id").agg(F.sort_array(F.collect_set(F.struct("f.start", "kind", "f.end"))).alias("secrets"))
    keyed = docs.drop("secrets").withColumn("__blob", blob_id(F.col(text)))
    # Written, so that both sides of the join are plain exchanges: a blob that a
    # third of all paths share can then be split among tasks.
    joined = keyed.join(written(by_blob.withColumnRenamed("blob_id", "__blob"), "secret-findings"), "__blob", "left").drop("__blob")
    return joined.withColumn("secrets", F.coalesce(F.col("secrets").cast(SPANS), F.array().cast(SPANS)))


def listed(secrets: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(secrets, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(text: Column, secrets: Column, mask: str = MASK) -> Column:
    """The text with a mask in place of every span; null stays null."""

    def rebuilt(reach: Column) -> Column:
        before = lambda i: F.coalesce(F.get(reach, i - 1), F.lit(0).cast("long"))
        piece = lambda x, i: F.when(
            (x["start"] >= before(i)), F.concat(F.substr(text, (before(i) + 1).cast("int"), (x["start"] - before(i)).cast("int")), F.lit(mask))
        ).otherwise(F.lit(""))
        return F.concat(F.array_join(F.transform(secrets, piece), ""), F.substr(text, (F.try_element_at(reach, F.lit(-1)) + 1).cast("int")))

    ends = F.transform(secrets, lambda x: x["end"])
    return F.when(F.size(secrets) > 0, let(running(ends, lambda a, b: F.greatest(a, b), F.lit(0).cast("long")), rebuilt)).otherwise(text)
