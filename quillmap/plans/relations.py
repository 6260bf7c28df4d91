"""Flat relations over parsed documents.

Every relation is a projection of the same parsed rows; write those once
(``parsed.write.parquet``) and each relation reads only the columns it needs.
``doc_id`` stands for whatever columns identify a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

KEY = ("doc_id",)
BOTH = ("mapper.statements", "mapper.fragments")

#: What of a parsed row each relation needs, for ``parsing.parsed(columns=...)``.
NEEDS = {
    "documents": ("encoding", "dialect", "mapper.namespace"),
    "statements": (*(f"mapper.statements.{x}" for x in ("kind", "id", "database_id.value", "param_class.value.raw", "result_class.value.raw", "result_map_ref.value", "span", "sql.union.branch_count", "sql.variants.conditions")),),
    "fragments": ("mapper.fragments.id", "mapper.fragments.span"),
    "variants": tuple(f"{x}.{y}" for x in BOTH for y in ("id.value", "sql")),
    "texts": tuple(f"{x}.{y}" for x in BOTH for y in ("id.value", "sql.variants.text.text", "sql.variants.conditions", "sql.union.text.text", "sql.union.branch_count")),
    "includes": tuple(f"{x}.{y}" for x in BOTH for y in ("id.value", "includes")),
    "property_paths": ("mapper.statements.property_paths",),
    "result_maps": tuple(f"mapper.result_maps.{x}" for x in ("id", "type_ref.value.raw", "extends.value", "span")),
    "column_mappings": ("mapper.result_maps.id.value", "mapper.result_maps.mappings"),
    "diagnostics": ("diagnostics",),
    "qualified_names": ("mapper.namespace.value", "mapper.statements.id.value", "mapper.statements.database_id.value"),
}


def _named(col: str, prefix: str | None = None) -> list[Column]:
    name = prefix or col.rpartition(".")[2]
    return [F.col(f"{col}.value").alias(name), F.col(f"{col}.span.start").alias(f"{name}_start"), F.col(f"{col}.span.end").alias(f"{name}_end")]


def documents(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per document; rows that repeat stay. No mapper: no namespace."""
    return parsed.select(*key, "encoding", "dialect", F.col("mapper").isNotNull().alias("has_mapper"), *_named("mapper.namespace"))


def _each(parsed: DataFrame, column: str, key: tuple[str, ...], as_: str) -> DataFrame:
    return parsed.select(*key, F.posexplode(column).alias("ord", as_))


def statements(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per statement in document order; documents without a mapper have none."""
    return _each(parsed, "mapper.statements", key, "s").select(
        *key,
        "ord",
        "s.kind",
        *_named("s.id"),
        F.col("s.database_id.value").alias("database_id"),
        F.col("s.param_class.value.raw").alias("param_class"),
        F.col("s.result_class.value.raw").alias("result_class"),
        F.col("s.result_map_ref.value").alias("result_map_ref"),
        F.when(F.col("s.sql.union").isNotNull(), "union").when(F.col("s.sql.variants").isNotNull(), "variants").otherwise("unrecognized").alias("sql_kind"),
        F.col("s.span.start").alias("span_start"),
        F.col("s.span.end").alias("span_end"),
    )


def fragments(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per fragment with an id, in document order."""
    return _each(parsed, "mapper.fragments", key, "f").select(*key, "ord", *_named("f.id"), F.col("f.span.start").alias("span_start"), F.col("f.span.end").alias("span_end"))


def _owners(parsed: DataFrame, key: tuple[str, ...], *fields: str) -> DataFrame:
    """Statements and fragments as owners: one pass, one row each, with those fields."""
    part = lambda kind, column: F.transform(
        F.coalesce(column, F.array()), lambda x, i: F.struct(F.lit(kind).alias("owner"), i.alias("owner_ord"), x["id"]["value"].alias("owner_id"), *[x[f].alias(f) for f in fields])
    )
    both = F.concat(part("statement", F.col("mapper.statements")), part("fragment", F.col("mapper.fragments")))
    return parsed.filter("mapper IS NOT NULL").select(*key, F.explode(both).alias("o")).select(*key, "o.*")


def variants(parsed: DataFrame, key: tuple[str, ...] = KEY, marks: bool = True) -> DataFrame:
    """One row a variant; the union of an owner with too many is one row too.

    Without ``marks`` there is no ``span_map``, and what ``NEEDS["texts"]`` names will do.
    """
    union = F.col("sql.union")
    alone = F.array(F.struct(union["text"].alias("text"), F.array().cast("array<string>").alias("conditions")))
    rows = F.when(union.isNotNull(), alone).otherwise(F.col("sql.variants"))
    kind = F.when(union.isNotNull(), "union").otherwise("variants")
    rows = _owners(parsed, key, "sql").select(*key, "owner", "owner_ord", "owner_id", kind.alias("sql_kind"), union["branch_count"].alias("branch_count"), F.posexplode(rows).alias("variant_ord", "v"))
    last = [F.col("v.text.span_map").alias("span_map")] if marks else []
    return rows.select(*key, "owner", "owner_ord", "owner_id", "variant_ord", "sql_kind", "branch_count", F.col("v.text.text").alias("text"), "v.conditions", *last)


def span_map(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    return variants(parsed, key).select(*key, "owner", "owner_ord", "variant_ord", F.explode("span_map").alias("m")).select(*key, "owner", "owner_ord", "variant_ord", "m.off", "m.raw")


def includes(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per include of a statement or fragment, by place; targets as written there."""
    rows = _owners(parsed, key, "includes").select(*key, "owner", "owner_ord", "owner_id", F.posexplode("includes").alias("ord", "i"))
    aim = "i.value.target"
    return rows.select(
        *key,
        "owner",
        "owner_ord",
        "owner_id",
        "ord",
        F.col("i.value.raw").alias("raw"),
        F.col(f"{aim}.kind").alias("target_kind"),
        F.col(f"{aim}.ns").alias("target_ns"),
        F.col(f"{aim}.id").alias("target_id"),
        F.col("i.span.start").alias("span_start"),
        F.col("i.span.end").alias("span_end"),
    )


def property_paths(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per property path of a statement, in the order they were met."""
    rows = _each(parsed, "mapper.statements", key, "s").select(*key, F.col("ord").alias("owner_ord"), F.posexplode("s.property_paths").alias("ord", "p"))
    return rows.select(*key, "owner_ord", "ord", F.col("p.value").alias("path"), F.col("p.span.start").alias("path_start"), F.col("p.span.end").alias("path_end"))


def result_maps(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per result map with an id."""
    return _each(parsed, "mapper.result_maps", key, "r").select(
        *key, "ord", *_named("r.id"), F.col("r.type_ref.value.raw").alias("type_ref"), F.col("r.extends.value").alias("extends"), F.col("r.span.start").alias("span_start"), F.col("r.span.end").alias("span_end")
    )


def column_mappings(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per column of a result map, nested ones in document order."""
    rows = _each(parsed, "mapper.result_maps", key, "r").select(*key, F.col("ord").alias("map_ord"), F.col("r.id.value").alias("map_id"), F.posexplode("r.mappings").alias("ord", "m"))
    return rows.select(*key, "map_ord", "map_id", "ord", "m.column", "m.property")


def diagnostics(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """A row per diagnostic; some have no place."""
    return _each(parsed, "diagnostics", key, "d").select(*key, "ord", "d.code", F.col("d.span.start").alias("span_start"), F.col("d.span.end").alias("span_end"), "d.message")


# -- questions that join relations; each works across documents too


def duplicate_ids(stated: DataFrame, scope: tuple[str, ...] = KEY) -> DataFrame:
    """Statements whose id and database id an earlier one in the scope has.

    The first of each is a partial aggregate's least row and the others are
    joined to it, so an id that a third of the corpus repeats is no single
    task's. A null database id is one like others.
    """
    order = F.struct(*[c for c in ("doc_id", "ord") if c in stated.columns])
    keys = [*scope, "id", "database_id"]
    rows = stated.filter("id IS NOT NULL").withColumn("__order", order)
    first = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.min("__order").alias("__first"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return rows.join(first, same).filter("__order > __first").select(*stated.columns)


def missing_ids(stated: DataFrame) -> DataFrame:
    """Statements without an id."""
    return stated.filter("id IS NULL")


def dangling_includes(included: DataFrame, fragment: DataFrame, scope: tuple[str, ...] = KEY) -> DataFrame:
    """Local includes without a fragment of that id in the scope."""
    known = fragment.select(*scope, F.col("id").alias("target_id")).distinct()
    return included.filter("target_kind = 'local'").join(known, [*scope, "target_id"], "left_anti")


def include_closure(included: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, owner, owner_ord, owner_id, target_id, depth): fragments that an owner reaches.

    ``depth`` is that of the shortest way. Each step joins what the last one
    reached anew with the fragments' own includes and leaves out what was
    reached before, so a lattice costs its pairs and not its ways, and a cycle
    ends by itself, at whatever depth. Local includes alone lead on.
    """
    keys = ["k", "owner", "owner_ord", "target_id"]
    local = written(included.filter("target_kind = 'local'").select(F.col(scope).alias("k"), "owner", "owner_ord", "owner_id", "target_id").distinct(), "include-edges")
    step = local.filter("owner = 'fragment'").select("k", F.col("owner_id").alias("target_id"), F.col("target_id").alias("next")).distinct()
    reached = written(local.withColumn("depth", F.lit(1)), "include-reach")
    last, depth = reached, 1
    while not last.isEmpty():
        depth += 1
        found = last.join(step, ["k", "target_id"]).select("k", "owner", "owner_ord", "owner_id", F.col("next").alias("target_id")).distinct()
        last = written(found.join(reached.select(*keys), keys, "left_anti").withColumn("depth", F.lit(depth)), "include-step")
        reached = reached.unionByName(last)
    return reached.withColumnRenamed("k", scope)


def include_tree(included: DataFrame, fragment: DataFrame, scope: str = "doc_id") -> DataFrame:
    """(scope, owner, owner_ord, source, raw, target_id, depth, label) of every include that an owner reaches.

    ``source`` is the fragment that it is in, null for the owner's own. Labels:
    ``external`` (qualified) and ``dynamic`` targets, ``unresolved`` (no such
    fragment), ``cycle`` (leads back to where the way came from), else
    ``fragment``.
    """
    reach = written(include_closure(included, scope), "include-closure")
    edges = included.select(scope, "owner", "owner_ord", "owner_id", "raw", "target_kind", "target_id").distinct()
    own = edges.select(scope, "owner", "owner_ord", "owner_id", F.lit(None).cast("string").alias("source"), F.lit(0).alias("before"), "raw", "target_kind", "target_id")
    inner = edges.filter("owner = 'fragment'").select(scope, F.col("owner_id").alias("source"), "raw", "target_kind", F.col("target_id").alias("next"))
    deeper = reach.select(scope, "owner", "owner_ord", "owner_id", F.col("target_id").alias("source"), F.col("depth").alias("before")).join(inner, [scope, "source"])
    every = own.unionByName(deeper.withColumnRenamed("next", "target_id"))
    known = fragment.select(scope, F.col("id").alias("target_id"), F.lit(True).alias("known")).distinct()
    # Back to the source from its target, and the target is no farther from the owner.
    back = reach.filter("owner = 'fragment'").select(scope, F.col("owner_id").alias("target_id"), F.col("target_id").alias("source"), F.lit(True).alias("back")).distinct()
    at = reach.select(scope, "owner", "owner_ord", "target_id", F.col("depth").alias("first"))
    rows = every.join(known, [scope, "target_id"], "left").join(back, [scope, "target_id", "source"], "left").join(at, [scope, "owner", "owner_ord", "target_id"], "left")
    itself = (F.col("owner") == "fragment") & (F.col("owner_id") == F.col("target_id"))
    cycle = itself | (F.col("back") & (F.col("first") <= F.col("before")))
    label = F.when(F.col("target_kind") == "qualified", "external").when(F.col("target_kind") == "dynamic", "dynamic")
    label = label.when(F.col("known").isNull(), "unresolved").when(cycle, "cycle").otherwise("fragment")
    return rows.select(scope, "owner", "owner_ord", "source", "raw", "target_id", (F.col("before") + 1).alias("depth"), label.alias("label"))


def dump(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """Statements with their variants; conditions joined, ``always`` for none."""
    v = variants(parsed, key, False).filter("owner = 'statement'")
    when = F.when(F.size("conditions") > 0, F.array_join("conditions", " && ")).otherwise("always")
    return v.select(*key, F.col("owner_ord").alias("ord"), F.col("owner_id").alias("id"), "variant_ord", "sql_kind", when.alias("condition"), "text")


def first_variants(parsed: DataFrame, most: int = 3, key: tuple[str, ...] = KEY) -> DataFrame:
    """The first variants of each statement, white space collapsed, and how many more there are."""
    union = F.col("s.sql.union.text.text")
    texts = F.when(union.isNotNull(), F.array(union)).otherwise(F.transform("s.sql.variants", lambda v: v["text"]["text"]))
    rows = _each(parsed, "mapper.statements", key, "s").select(*key, "ord", F.col("s.id.value").alias("id"), texts.alias("t"))
    more = F.greatest(F.size("t") - most, F.lit(0))
    rows = rows.select(*key, "ord", "id", more.alias("n_more"), F.posexplode(F.slice("t", 1, most)).alias("variant_ord", "text"))
    return rows.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


def qualified_names(parsed: DataFrame, key: tuple[str, ...] = KEY) -> DataFrame:
    """``namespace.id[@databaseId]`` of statements that have an id."""
    rows = parsed.select(*key, F.col("mapper.namespace.value").alias("ns"), F.posexplode("mapper.statements").alias("ord", "s"))
    at = F.concat(F.lit("@"), F.col("s.database_id.value"))
    return rows.filter("s.id IS NOT NULL").select(*key, "ord", F.concat(F.concat_ws(".", "ns", "s.id.value"), F.coalesce(at, F.lit(""))).alias("qualified"))


#: An include in flattened text; the group is its refid (fixed value: the token's form).
TOKEN = r"/\* batis:include\((.*?)\) \*/"


def _filled(rows: DataFrame, closed: DataFrame, key: str) -> DataFrame:
    """Texts with every token of a closed fragment replaced, one token a step.

    A fragment's variant is taken where conditions that the text's owner knows
    too hold in both or in neither; its other conditions join the text's.
    """
    names = closed.groupBy(key).agg(F.collect_set("owner_id").alias("__names"))
    made, work, spent = None, rows, []
    while True:
        open_ = F.filter(F.regexp_extract_all("text", F.lit(TOKEN), 1), lambda t: F.coalesce(F.array_contains("__names", t), F.lit(False)))
        work = written(work.join(names, key, "left").withColumn("__next", F.get(open_, F.lit(0))).drop("__names"), "substituted")
        spent.append(work)
        done = work.filter("__next IS NULL").drop("__next")
        made = done if made is None else made.unionByName(done)
        work = work.filter("__next IS NOT NULL")
        if work.isEmpty():
            return made
        part = closed.select(F.col(key).alias("__k"), F.col("owner_id").alias("__f"), F.col("text").alias("__text"), F.col("conditions").alias("__c"), F.col("known").alias("__known"))
        shared = F.array_intersect("known", "__known")
        agree = F.size(F.array_except(F.array_intersect("conditions", shared), "__c")) + F.size(F.array_except(F.array_intersect("__c", shared), "conditions")) == 0
        joined = work.join(part, (F.col(key) == F.col("__k")) & (F.col("__next") == F.col("__f")) & agree)
        whole = F.concat(F.lit("/* batis:include("), F.col("__next"), F.lit(") */"))
        more = F.concat("conditions", F.array_except("__c", "conditions"))
        changed = {"text": F.replace("text", whole, F.col("__text")), "conditions": more, "known": F.array_union("known", "__known")}
        work = joined.withColumns(changed).drop("__k", "__f", "__text", "__c", "__known", "__next")


def substituted(owner_variants: DataFrame, key: str = "doc_id") -> DataFrame:
    """Statement texts with include tokens replaced by their fragments' variants.

    Within a document, for all tokens of a text and fragments within fragments:
    fragments that include none are closed, then those that include closed ones
    alone, and so on. Fragments that lead back to themselves never are; their
    tokens stay, as do those without a fragment here. Where a fragment's variants
    go with different states, a text becomes several. Edges of wrappers are not
    trimmed again (see ``include_at_wrapper_boundary``).
    """
    columns = [key, "owner", "owner_ord", "owner_id", "variant_ord", "text", "conditions"]
    owner = [key, "owner", "owner_ord"]
    known = owner_variants.groupBy(*owner).agg(F.array_distinct(F.flatten(F.collect_list("conditions"))).alias("known"))
    rows = written(owner_variants.select(*columns).join(known, owner), "owner-variants")
    left = rows.filter("owner = 'fragment' AND owner_id IS NOT NULL")
    names = left.groupBy(key).agg(F.collect_set("owner_id").alias("__own"))
    tokens = F.regexp_extract_all("text", F.lit(TOKEN), 1)
    inside = left.join(names, key).select(key, "owner_id", F.explode(F.array_intersect(tokens, "__own")).alias("on")).distinct()
    waits = written(inside, "fragment-needs")
    closed = written(left.join(waits.select(key, "owner_id").distinct(), [key, "owner_id"], "left_anti"), "closed-fragments")
    while True:
        have = closed.select(key, F.col("owner_id").alias("on")).distinct()
        stuck = waits.join(have, [key, "on"], "left_anti").select(key, "owner_id").distinct()
        ready = left.join(waits.select(key, "owner_id").distinct(), [key, "owner_id"]).join(stuck, [key, "owner_id"], "left_anti")
        ready = written(ready.join(closed.select(key, "owner_id").distinct(), [key, "owner_id"], "left_anti"), "ready-fragments")
        if ready.isEmpty():
            break
        closed = written(closed.unionByName(_filled(ready, closed, key)), "closed-fragments")
    return _filled(rows.filter("owner = 'statement'"), closed, key).select(key, "owner_ord", "owner_id", "variant_ord", "text", "conditions")
