"""The queries ``opN_<name>``: each applies one operator to its whole table.

``QUERIES`` maps names to functions of (spark, sf_dir); ``ORACLES`` has DuckDB
SQL for those that SQL can express.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, lm_scoring, mixing, quality_rules, resampling, secret_scan, simhash, toxicity, url_filter, warc
from .common import fold, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------------------- 7

OP7_SQL = r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS ls
  FROM t
), p AS (
  SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w WHERE len(ws) > 3)
), again AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM p) WHERE n > 1
), spots AS (
  SELECT r, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY r
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
         coalesce(spots.n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '[a-z]')) AS n_lower,
         len(regexp_extract_all(text, '!')) AS n_exclaim
  FROM w LEFT JOIN spots USING (r)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
         + 8 * (2 * n_dup_lines > n_lines)::BIGINT
         + 16 * (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))::BIGINT
         + 32 * (n_upper > n_lower)::BIGINT + 64 * (5 * n_exclaim > n_words)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits
FROM f
"""


@query("op7_quality_rules", OP7_SQL)
def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of all documents under the current policy."""
    base, policy = quality_rules.POLICIES
    book = quality_rules.ledger(table(spark, sf_dir, "documents"), keep=("doc_id",))
    failed = F.col("fail_bits").bitwiseAND(F.lit(base.mask(quality_rules.RULES)).cast("long")) != 0
    return quality_rules.applied(book, policy).select(
        "doc_id", *[f"m.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")], failed.alias("base_failed"), "kept", "fail_bits"
    )


_ABLATED = " UNION ALL ".join(
    f"""SELECT '{p.name}' AS policy, '{r.name}' AS rule, count(*) FILTER (fail_bits & {1 << r.bit} <> 0) AS n_failed,
      count(*) FILTER (fail_bits & {p.mask(quality_rules.RULES)} = {1 << r.bit}) AS n_only_this,
      count(*) FILTER (fail_bits & {p.mask(quality_rules.RULES) & ~(1 << r.bit)} = 0) AS n_kept_without FROM book"""
    for p in quality_rules.POLICIES
    for r in quality_rules.RULES
    if r.name in p.rules
)


@query("rule_ablation", f"WITH book AS ({OP7_SQL}) {_ABLATED}")
def rule_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under every policy: what each rule rejects, and rejects alone."""
    book = written(quality_rules.ledger(table(spark, sf_dir, "documents"), keep=("doc_id",)), "rule-ledger")
    each = [quality_rules.ablation(book, p).select(F.lit(p.name).alias("policy"), "*") for p in quality_rules.POLICIES]
    return reduce(DataFrame.unionByName, each)


# --------------------------------------------------------------------------- 9


def _op9_sql() -> str:
    """Pieces between matches and matches alternate; ends are running sums."""

    def kind(k: int, rule: secret_scan.Rule) -> str:
        p = rule.pattern.replace("'", "''").replace("}+", "}")  # there are no possessive quantifiers, nor is there need of them
        return f"""
SELECT r, {k} AS k, '{rule.kind}' AS kind, ends[i] - length(m[i]) AS s, ends[i] AS e FROM (
  SELECT r, m, g, list_transform(range(1, len(m) + 1), lambda j: list_sum(list_transform(p[1:j], lambda x: length(x))) + list_sum(list_transform(m[1:j], lambda x: length(x)))) AS ends, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT r, regexp_extract_all(text, '{p}', 0) AS m, regexp_extract_all(text, '{p}', {rule.group}) AS g, string_split_regex(text, '{p}') AS p FROM t)
  WHERE len(m) > 0
) WHERE length(g[i]) >= {rule.at_least}"""

    spans = "\nUNION ALL".join(kind(k, r) for k, r in enumerate(secret_scan.RULES))
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS ({spans}),
told AS (
  SELECT r, count(*) FILTER (k = 0) AS a, count(*) FILTER (k = 1) AS b, count(*) FILTER (k = 2) AS c,
         coalesce(string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3), '') AS base,
         string_agg(kind || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k) AS spans
  FROM found GROUP BY r
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN told USING (r)
"""


@query("op9_secret_scan", _op9_sql())
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' secrets, by way of a ledger that starts empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secret_scan.with_findings(docs, secret_scan.scanned(docs))
    n = len(secret_scan.BASE_RULES)
    count = lambda k: F.size(F.filter("secrets", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{r.kind}") for k, r in enumerate(secret_scan.BASE_RULES)],
        F.sha2(secret_scan.listed(F.filter("secrets", lambda x: x["kind"] < n)).cast("binary"), 256).alias("base_sha256"),
        secret_scan.listed(F.col("secrets")).alias("spans"),
    )


# --------------------------------------------------------------------------- 8


@query("op8_mixing")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    mix = mixing.mixed(table(spark, sf_dir, "documents"))
    return mix.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


# -------------------------------------------------------------------------- 10

_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP10_SQL = f"""
WITH t AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM t GROUP BY html),
d AS (SELECT page_id, first, strlen(html) AS n, sha1(html) AS h FROM t JOIN f USING (html))
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(range(4), lambda g: list_aggregate(list_transform(range(8), lambda k:
         substr('{_DIGITS}', 1 + ((('0x' || substr(h, 1 + 10 * g, 10))::BIGINT >> (35 - 5 * k)) & 31)::INT, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d
"""


@query("op10_warc", OP10_SQL)
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through the archives and back."""
    return warc.archived_pages(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# --------------------------------------------------------------------------- 5

_RULES = ", ".join(f"('{r}', '{r.split('/', 1)[0]}', '/{r.split('/', 1)[1]}', '{v}')" for r, v in url_filter.RULES)
OP5_SQL = rf"""
WITH rules(rule, h, p, v) AS (VALUES {_RULES}),
t AS (SELECT row_number() OVER () AS r, page_id, coalesce(url, '') AS url FROM pages),
u AS (SELECT r, page_id, translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM t),
m AS (SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v
      FROM u JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r)
SELECT page_id, host, path, rule, coalesce(v, '{url_filter.DEFAULT}') AS verdict FROM u LEFT JOIN m USING (r)
"""


@query("op5_url_filter", OP5_SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    return url_filter.judged(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


# --------------------------------------------------------------------------- 4


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate component."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# --------------------------------------------------------------------------- 2


@query("op2_decontamination")
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# --------------------------------------------------------------------------- 3


@query("op3_toxicity")
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; a quarter of the rows is held out of training."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    held_out = fold(4, F.col("doc_id")) == 2
    return toxicity.scored(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), F.size("passages").alias("n_passages"))


# --------------------------------------------------------------------------- 6


@query("op6_quality_resampling")
def op6_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' weights toward those labelled good, and which are kept."""
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return resampling.resampled(table(spark, sf_dir, "documents").select("doc_id", "text"), good)


# --------------------------------------------------------------------------- 1


@query("op1_lm_scoring")
def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability; a fifth of the rows is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = fold(5, F.col("doc_id")) == 1
    made = lm_scoring.scored(docs, ~held_out)
    return made.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
