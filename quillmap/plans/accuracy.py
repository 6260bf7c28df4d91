"""How much of a corpus is found: the consumer programs as relational queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STATEMENT_TAG = r"<(select|insert|update|delete|procedure|statement)[\s>]"


def recall(docs: DataFrame, stated: DataFrame, content: str = "content") -> DataFrame:
    """(doc_id, n_expected, n_found): statements against a plain count of their tags."""
    expected = docs.select("doc_id", F.regexp_count(F.col(content).cast("string"), F.lit(STATEMENT_TAG)).alias("n_expected"))
    found = stated.filter("id IS NULL OR NOT endswith(id, '!selectKey')").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_found"))
    return expected.join(found, "doc_id", "left").select("doc_id", "n_expected", F.coalesce("n_found", F.lit(0)).alias("n_found"))


def bound_by_namespace(stated: DataFrame, documents: DataFrame, sources: DataFrame, root: str = "/java/") -> DataFrame:
    """Statements with ``bound``: their namespace's Java file has ``id(``.

    Namespaces and files meet in an equality join on the path below ``root``.
    """
    named = stated.join(documents.select("doc_id", "namespace"), "doc_id")
    files = sources.select(F.regexp_extract("path", rf"\Q{root}\E(.*)\.java$", 1).alias("__place"), F.col("text").alias("__java"))
    joined = named.withColumn("__place", F.replace("namespace", F.lit("."), F.lit("/"))).join(files, "__place", "left")
    return joined.withColumn("bound", F.coalesce(F.contains("__java", F.concat("id", F.lit("("))), F.lit(False))).drop("__place", "__java")


def bound_by_mention(ids: DataFrame, texts: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """Distinct ids that some text has in quotes.

    Quoted strings are taken from the texts and joined by equality: no pair of
    id and text is ever made.
    """
    quoted = texts.select(F.explode(F.regexp_extract_all(text, F.lit('"(?=([^"]*)")'), 1)).alias(id_)).distinct()
    return ids.select(id_).distinct().join(quoted, id_, "left_semi")


def mentions(texts: DataFrame, words: DataFrame, key: str, text: str = "text", word: str = "word") -> DataFrame:
    """Distinct (key, word) where the text has the word between white space."""
    said = texts.select(key, F.explode(F.array_distinct(F.split(F.coalesce(text, F.lit("")), r"\s+"))).alias(word)).filter(F.col(word) != "")
    return said.join(words.select(word).distinct(), word, "left_semi")


def presence(stated: DataFrame, dialects: DataFrame, most: int = 100) -> DataFrame:
    """(id, dialect, n): every id against every listed dialect, 0 where absent.

    ``dialects`` lists the dialect folders: a handful, and more than ``most``
    raise. ``stated`` has doc's dialect with each statement.
    """
    names = sorted({r["dialect"] for r in dialects.select("dialect").distinct().limit(most + 1).collect()} - {None})
    if len(names) > most:
        raise ValueError(f"more than {most} dialects")
    have = stated.filter("id IS NOT NULL").groupBy("id", "dialect").agg(F.count(F.lit(1)).alias("n"))
    wanted = have.select("id").distinct().select("id", F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("dialect"))
    return wanted.join(have, ["id", "dialect"], "left").select("id", "dialect", F.coalesce("n", F.lit(0)).alias("n"))


def callers(sources: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, n_lines, n_files): lines of Java that call ``id(``, comments apart."""
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("line", "code"))
    code = lines.filter(~F.ltrim("code").rlike(r"^(//|\*|/\*)"))
    calls = code.select("path", "line", F.explode(F.array_distinct(F.regexp_extract_all("code", F.lit(r"(\w+)\("), 1))).alias("id"))
    return calls.join(ids.select("id").distinct(), "id", "left_semi").groupBy("id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_distinct("path").alias("n_files"))


def percentage(part, whole):
    return F.coalesce(F.try_divide(100.0 * part, whole), F.lit(0.0))


def failures(documents: DataFrame, bound: DataFrame, sources: DataFrame | None = None, root: str = "/java/") -> DataFrame:
    """(doc_id, reason) of what is not bound, and why.

    ``documents`` with has_mapper and namespace, ``bound`` statements with
    doc_id, id and bound. With ``sources`` binding goes by namespace: a document
    without one, or whose namespace has no file, is a reason of its own and its
    statements are none. Statements without an id count nowhere.
    """
    reason = F.when(~F.col("has_mapper"), "no_mapper_parsed")
    docs = documents.select("doc_id", "has_mapper", "namespace")
    if sources is not None:
        places = sources.select(F.regexp_extract("path", rf"\Q{root}\E(.*)\.java$", 1).alias("place"), F.lit(True).alias("there")).distinct()
        docs = docs.withColumn("place", F.replace("namespace", F.lit("."), F.lit("/"))).join(places, "place", "left")
        reason = reason.when(F.col("namespace").isNull(), "missing_namespace").when(F.col("there").isNull(), "no_matching_interface_file")
    docs = docs.select("doc_id", reason.alias("reason"))
    lost = bound.filter("id IS NOT NULL AND NOT bound").join(docs.filter("reason IS NULL").select("doc_id").distinct(), "doc_id", "left_semi")
    return docs.filter("reason IS NOT NULL").unionByName(lost.select("doc_id", F.concat(F.lit("unbound_statement:"), "id").alias("reason")))


def categories(failed: DataFrame) -> DataFrame:
    """(category, n): reasons by what stands before the colon."""
    return failed.groupBy(F.substring_index("reason", ":", 1).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def summary(documents: DataFrame, counted: DataFrame, bound: DataFrame) -> DataFrame:
    """One row: files, parse success, recall and binding in per cent, 0 where there is nothing.

    ``counted``: see :func:`recall`. All three are aggregated before they meet.
    """
    files = documents.agg(F.count(F.lit(1)).alias("files_seen"), F.count_if("has_mapper").alias("parsed_ok"))
    stated = counted.agg(F.coalesce(F.sum("n_expected"), F.lit(0)).alias("n_expected"), F.coalesce(F.sum("n_found"), F.lit(0)).alias("n_found"))
    ids = bound.filter("id IS NOT NULL").agg(F.count(F.lit(1)).alias("n_statements"), F.count_if("bound").alias("n_bound"))
    one = lambda df: df.withColumn("__one", F.lit(1))
    rows = one(files).join(one(stated), "__one").join(one(ids), "__one").drop("__one")
    rates = {"parse_success": ("parsed_ok", "files_seen"), "statement_recall": ("n_found", "n_expected"), "binding_rate": ("n_bound", "n_statements")}
    return rows.withColumns({k: percentage(F.col(a), F.col(b)) for k, (a, b) in rates.items()})
