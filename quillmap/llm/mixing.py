"""Mixing sources to target weights by pivotal dependent rounding.

Each document's share of its source's target is a number of copies: a whole part
and a fraction. Pairs of fractions trade words, one way or the other at random,
until one of the two is integral; expectations and the source's sum of words
both stay. Buckets of documents are folded first, then what each bucket holds
over, in a tree, until one fraction a source is left. All of it is DataFrame
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, joined_small, text_or_empty, written

WEIGHTS = (3, 1, 2)
BRANCH = 32


def sized(docs: DataFrame, text: str = "text", by: str = "doc_id") -> DataFrame:
    """(doc_id, source, size): the words of each whole text; null has none."""
    return docs.select(F.col(by).alias("doc_id"), "source", F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2) -> DataFrame:
    """(source, source_size, n_docs, weight, target), a row per source.

    Sources by code point, null last, take the weights in turn. Targets share
    ``share`` (a fraction) of all words by weight; a source stops at ``most``
    times its size and the others share the excess. Sources are filled in the
    order of size by weight: one is full if it would be with all before it full.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    turn = F.array(*[F.lit(w).cast("long") for w in weights])
    every = Window.partitionBy()
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    by = by.withColumn("rank", rank).withColumn("weight", F.get(turn, F.pmod("rank", F.lit(len(weights)))))
    a, b = share
    by = by.withColumn("pool", a * F.sum("source_size").over(every)).withColumn("all_weight", F.sum("weight").over(every))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    # Everything times b, so that it stays in whole numbers.
    left = F.col("pool") - F.coalesce(F.sum(b * most * F.col("source_size")).over(before), F.lit(0))
    open_weight = F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0))
    by = by.withColumn("full", left * F.col("weight") > b * most * F.col("source_size") * open_weight)
    spent = F.sum(F.when(F.col("full"), b * most * F.col("source_size")).otherwise(0)).over(every)
    closed = F.sum(F.when(F.col("full"), F.col("weight")).otherwise(0)).over(every)
    share_of = (F.col("weight") * (F.col("pool") - spent)).cast("double") / (b * (F.col("all_weight") - closed)).cast("double")
    target = F.when(F.col("full"), (most * F.col("source_size")).cast("double")).otherwise(share_of)
    return by.select("source", "source_size", "n_docs", "weight", target.alias("target"))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that the keys fix."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11) / float(1 << 53)


def folded(items: Column, seed: int, level: int) -> Column:
    """``held`` (the item still fractional) and ``out`` of an array of items.

    An item has h, doc_id, size, whole, p. Moving d words from one to another
    changes their fractions by d over their sizes; the two ways are drawn so
    that no fraction's expectation changes.
    """

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(x["h"].alias("h"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["whole"].alias("whole"), p.cast("double").alias("p"))

    def pair(acc: Column, x: Column) -> Column:
        held = acc["held"]
        up_room, up_have = (1 - held["p"]) * held["size"], x["p"] * x["size"]
        down_room, down_have = (1 - x["p"]) * x["size"], held["p"] * held["size"]
        up, down = F.least(up_room, up_have), F.least(down_room, down_have)
        go_up = uniform(held["h"], x["h"], F.lit(seed), F.lit(level)) * (up + down) < down
        one, zero = F.lit(1.0), F.lit(0.0)
        cases = [
            (go_up & (up_room <= up_have), with_p(held, one), with_p(x, x["p"] - up / x["size"])),
            (go_up, with_p(x, zero), with_p(held, held["p"] + up / held["size"])),
            (down_room <= down_have, with_p(x, one), with_p(held, held["p"] - down / held["size"])),
        ]
        done, stays = with_p(held, zero), with_p(x, x["p"] + down / x["size"])
        for when, d, s in reversed(cases):
            done, stays = F.when(when, d).otherwise(done), F.when(when, s).otherwise(stays)
        grown = F.struct(stays.alias("held"), F.concat(acc["out"], F.array(done)).alias("out"))
        return F.when(held["h"].isNull(), F.struct(x.alias("held"), acc["out"].alias("out"))).otherwise(grown)

    first = F.get(items, F.lit(0))
    start = F.struct(first.alias("held"), F.filter(items, lambda x: F.lit(False)).alias("out"))
    return F.aggregate(F.slice(items, F.lit(2), F.greatest(F.size(items) - 1, F.lit(0))), start, pair)


def mixed(docs: DataFrame, text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = (3, 2), most: int = 2, seed: int = 42, by: str = "doc_id") -> DataFrame:
    """(doc_id, source, size, source_size, target, copies), a row per row of docs.

    Each document is taken ``copies`` times, ``most`` at the outside; a source's
    words taken differ from its target by half of one document's words at most:
    what is left of the tree's root is rounded to the nearer way. Draws hang on
    ids alone, so reruns agree. Null texts and texts without words have
    size 0 and no copies; a null source is a source; repeated rows are rounded
    each on its own; an empty table gives an empty table. Other columns of the
    input are not read. ``by`` names the column that is returned as doc_id.
    """
    sizes = written(sized(docs, text, by), "mix-sizes")
    per_source = written(targets(sizes, weights, share, most), "mix-targets")
    # Rows alike are counted and numbered, which gives each its own draw.
    rows = sizes.groupBy("doc_id", "source", "size").count().withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count")))).drop("count")
    keyed = rows.withColumn("__s", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")))
    info = per_source.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("__s"), "source_size", "n_docs", "target")
    keyed = joined_small(keyed, info, "__s").drop("__s")
    x = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    keyed = keyed.withColumn("whole", F.when(F.col("size") > 0, F.floor(x)).otherwise(0).cast("long")).withColumn("p", F.when(F.col("size") > 0, x - F.floor(x)).otherwise(0.0))
    keyed = keyed.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "copy"))
    same = ["source", "source_size", "target"]
    settled = [keyed.filter("p = 0").select(*same, "doc_id", "size", F.col("whole").alias("copies"))]
    spread = F.pmod(F.xxhash64(F.lit(seed + 1), "h"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("n_docs") / BRANCH)))
    items = keyed.filter("p > 0").select(*same, spread.alias("bucket"), F.struct("h", "doc_id", "size", "whole", "p").alias("item"))
    most_buckets = per_source.agg(F.max(F.ceil(F.col("n_docs") / BRANCH))).first()[0] or 1
    level = 0
    while True:
        groups = items.groupBy(*same, "bucket").agg(F.sort_array(F.collect_list("item")).alias("items"))
        level_rows = written(groups.select(*same, "bucket", folded(F.col("items"), seed, level).alias("f")), f"mix-level{level}")
        out = level_rows.select(*same, F.explode("f.out").alias("i"))
        settled.append(out.select(*same, "i.doc_id", "i.size", (F.col("i.whole") + F.col("i.p").cast("long")).alias("copies")))
        if most_buckets <= 1:
            break
        items = level_rows.select(*same, F.floor(F.col("bucket") / BRANCH).alias("bucket"), F.col("f.held").alias("item"))
        most_buckets, level = -(-most_buckets // BRANCH), level + 1
    last = level_rows.select(*same, F.col("f.held").alias("i"))
    drawn = (F.col("i.p") >= 0.5).cast("long")  # one document a source: the nearer way
    settled.append(last.select(*same, "i.doc_id", "i.size", (F.col("i.whole") + drawn).alias("copies")))
    everything = settled[0]
    for part in settled[1:]:
        everything = everything.unionByName(part)
    return everything.select("doc_id", "source", "size", "source_size", "target", "copies")
