"""Queries over mapper documents made from table rows, with SQL that predicts them.

Each query writes mapper text from a table's columns, runs the real parser on it
and asks a relation. The SQL beside it computes the same rows in closed form from
the same columns, so the two share no code.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmap.sources import corpus

from . import accuracy, relations
from .parsing import detected, from_json, parsed, parsed_json
from .relations import NEEDS
from .shared import new_path, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def templated(spark: SparkSession, sf_dir: str, name: str, key: str, body: str, root: str = "mapper", columns: tuple[str, ...] = NEEDS["texts"]) -> DataFrame:
    """Parsed documents: one a row of the table, ``body`` a SQL string expression."""
    return parsed(mappers(spark, sf_dir, name, key, body, root), carry=(key,), columns=columns)


def mappers(spark: SparkSession, sf_dir: str, name: str, key: str, body: str, root: str = "mapper") -> DataFrame:
    return table(spark, sf_dir, name).select(key, F.concat(F.lit(f'<{root} namespace="ns">'), F.expr(body), F.lit(f"</{root}>")).alias("content"))


def codes() -> Column:
    """A document's diagnostic codes in order."""
    return F.array_join(F.transform("diagnostics", lambda d: d["code"]), ",")


def texts(rows: DataFrame, key: str) -> DataFrame:
    v = relations.variants(rows, (key,), False)
    return v.select(key, "variant_ord", F.array_join("conditions", " && ").alias("conditions"), "text")


TEXT_AND_PATHS = ("mapper.statements.sql.variants.text.text", "mapper.statements.property_paths.value")

# --------------------------------------------------------- sources and roots


@query("SELECT page_id, ['unknown', 'mybatis', 'ibatis', 'unknown'][1 + (page_id % 4)::INT] AS dialect FROM pages")
def dialect_detect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheap look at every page's root: as it is, and below roots of three kinds."""
    html = "CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN concat('<!-- <sqlMap> --> <m:mapper>', html) WHEN 2 THEN concat('<?xml version=\"1.0\"?><sqlMap a=\"1\">', html) ELSE concat('<mapperx>', html) END"
    return detected(table(spark, sf_dir, "pages").select("page_id", F.expr(html).alias("html")), "html", ("page_id",))


@query(
    """SELECT page_id, 'unknown_element' AS code, strpos(html, '<html') - 1 AS span_start,
    strpos(html, '<html') - 1 + strpos(substr(html, strpos(html, '<html')), '>') AS span_end FROM pages"""
)
def root_diag_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser says of roots that are no mapper."""
    d = relations.diagnostics(parsed(table(spark, sf_dir, "pages"), "html", ("page_id",), ("diagnostics",)), ("page_id",))
    return d.select("page_id", "code", F.col("span_start").cast("long").alias("span_start"), F.col("span_end").cast("long").alias("span_end"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'mybatis' ELSE 'ibatis' END AS dialect, 'UTF-8' AS encoding, 'ns' AS namespace,
    19::BIGINT AS namespace_start FROM orders""")
def documents_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialect, encoding and namespace of both kinds of root."""
    root = "CASE WHEN o_orderkey % 2 = 0 THEN 'mapper' ELSE 'sqlMap' END"
    docs = table(spark, sf_dir, "orders").select("o_orderkey", F.encode(F.expr(f"concat('<', {root}, ' namespace=\"ns\">', '</', {root}, '>')"), "UTF-8").alias("content"))
    d = relations.documents(parsed(docs, carry=("o_orderkey",), columns=NEEDS["documents"]), ("o_orderkey",))
    return d.select("o_orderkey", "dialect", "encoding", "namespace", F.col("namespace_start").cast("long").alias("namespace_start"))


# ------------------------------------------------------------------ headers

KIND = "CASE o_orderstatus WHEN 'O' THEN 'select' WHEN 'F' THEN 'update' ELSE 'insert' END"


@query(f"""SELECT o_orderkey, {KIND} AS kind, 'q' || o_orderkey AS id, 't' || o_custkey AS result_class,
    (23 + length({KIND}) + 6)::BIGINT AS id_start, (23 + length({KIND}) + 6 + length('q' || o_orderkey))::BIGINT AS id_end FROM orders""")
def stmt_headers_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = f"concat('<', {KIND}, ' id=\"q', o_orderkey, '\" resultType=\"t', o_custkey, '\">SELECT 1</', {KIND}, '>')"
    s = relations.statements(templated(spark, sf_dir, "orders", "o_orderkey", body, columns=NEEDS["statements"]), ("o_orderkey",))
    return s.select("o_orderkey", "kind", "id", "result_class", F.col("id_start").cast("long").alias("id_start"), F.col("id_end").cast("long").alias("id_end"))


@query("SELECT n_nationkey, n_regionkey, 'n' || n_regionkey AS id FROM nation QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) > 1")
def dup_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that an earlier statement of the whole corpus has."""
    body = "concat('<select id=\"n', n_regionkey, '\">SELECT 1</select>')"
    docs = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.concat(F.lit("<mapper>"), F.expr(body), F.lit("</mapper>")).alias("content"))
    s = relations.statements(parsed(docs, carry=("n_nationkey", "n_regionkey"), columns=NEEDS["statements"]), ("n_nationkey", "n_regionkey"))
    return relations.duplicate_ids(s.withColumn("doc_id", F.col("n_nationkey")), ()).select("n_nationkey", "n_regionkey", "id")


@query("SELECT o_orderkey, 'duplicate_statement_id' AS code, count(*) AS n FROM orders WHERE o_orderkey % 3 > 0 GROUP BY ALL UNION ALL SELECT o_orderkey, 'missing_statement_id', 1 FROM orders WHERE o_orderkey % 5 = 0")
def id_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and missing ids inside a document."""
    body = """concat('<select id="a">x</select>', CASE WHEN o_orderkey % 3 > 0 THEN '<update id="a">y</update>' ELSE '<update id="a" databaseId="d">y</update>' END,
      CASE WHEN o_orderkey % 5 = 0 THEN '<delete>z</delete>' ELSE '' END)"""
    d = relations.diagnostics(templated(spark, sf_dir, "orders", "o_orderkey", body, columns=("diagnostics.code", "diagnostics.span", "diagnostics.message")), ("o_orderkey",))
    return d.groupBy("o_orderkey", "code").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey, 'ns.' || CASE WHEN n_regionkey = 0 THEN 'a@db' ELSE 'a' END AS qualified FROM nation")
def qualified_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<select id=\"a\"', CASE WHEN n_regionkey = 0 THEN ' databaseId=\"db\"' ELSE '' END, '>x</select><select>y</select>')"
    return relations.qualified_names(templated(spark, sf_dir, "nation", "n_nationkey", body, columns=NEEDS["qualified_names"]), ("n_nationkey",)).select("n_nationkey", "qualified")


# ------------------------------------------------------------- placeholders


@query("SELECT event_id, 'SELECT ? FROM __BATIS_DYN__ WHERE ' || event_type || ' = ?' AS text FROM events")
def placeholder_text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<select id=\"e\">SELECT #{', event_type, ', jdbcType=VARCHAR} FROM ${t', event_id, '} WHERE ', event_type, ' = #{a{b}}</select>')"
    return texts(templated(spark, sf_dir, "events", "event_id", body), "event_id").select("event_id", "text")


@query(
    """SELECT p_partkey, 0 AS ord, 'p' || p_partkey AS path, 46::BIGINT AS path_start, (46 + strlen('p' || p_partkey))::BIGINT AS path_end FROM part
    UNION ALL SELECT p_partkey, 1, 's' || p_size, 46 + strlen('p' || p_partkey) + 7, 46 + strlen('p' || p_partkey) + 7 + strlen('s' || p_size) FROM part"""
)
def placeholder_paths_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property paths with the bytes they stand at."""
    body = "concat('<select id=\"e\">a = é#{p', p_partkey, '} é${ s', p_size, ' , b}</select>')"
    p = relations.property_paths(templated(spark, sf_dir, "part", "p_partkey", body, columns=NEEDS["property_paths"]), ("p_partkey",))
    return p.select("p_partkey", "ord", "path", F.col("path_start").cast("long").alias("path_start"), F.col("path_end").cast("long").alias("path_end"))


@query("SELECT c_custkey, 'WHERE a = ? AND b = __BATIS_DYN__ AND c = #' || c_nationkey || ' $ x' AS text, 'k' || c_custkey || ',m[].x' AS paths FROM customer")
def ibatis_legacy_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<select id=\"e\">WHERE a = #k', c_custkey, ':NUMERIC# AND b = $m[].x$ AND c = ##', c_nationkey, ' $ x</select>')"
    rows = templated(spark, sf_dir, "customer", "c_custkey", body, "sqlMap", TEXT_AND_PATHS)
    paths = F.array_join(F.transform(F.col("mapper.statements")[0]["property_paths"], lambda p: p["value"]), ",")
    return rows.select("c_custkey", F.col("mapper.statements")[0]["sql"]["variants"][0]["text"]["text"].alias("text"), paths.alias("paths"))


# -------------------------------------------------------------- dynamic SQL

IF_SQL = """
WITH t AS (SELECT o_orderkey, (o_orderkey % 4)::INT AS k FROM orders),
v AS (SELECT o_orderkey, k, unnest(generate_series(0, (1 << k) - 1))::INT AS i FROM t)
SELECT o_orderkey, i AS variant_ord,
  coalesce((SELECT string_agg('c' || j, ' && ' ORDER BY j) FROM generate_series(0, 2) g(j) WHERE j < k AND (i >> (k - 1 - j)) & 1 = 1), '') AS conditions,
  's' || coalesce((SELECT string_agg(' t' || j, '' ORDER BY j) FROM generate_series(0, 2) g(j) WHERE j < k AND (i >> (k - 1 - j)) & 1 = 1), '') AS text
FROM v"""


@query(IF_SQL)
def if_variants_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k optional parts: absent before present, the first part varies slowest."""
    ifs = "array_join(transform(slice(array(0, 1, 2), 1, CAST(o_orderkey % 4 AS INT)), j -> concat('<if test=\"c', j, '\"> t', j, '</if>')), '')"
    return texts(templated(spark, sf_dir, "orders", "o_orderkey", f"concat('<select id=\"e\">s', {ifs}, '</select>')"), "o_orderkey")


@query(
    """WITH t AS (SELECT p_partkey, (p_size % 5)::INT AS k, p_partkey % 2 AS other FROM part)
    SELECT p_partkey, i AS variant_ord, CASE WHEN i < k THEN 'w' || i ELSE '' END AS conditions,
      CASE WHEN i < k THEN 'x' || i WHEN other = 1 THEN 'else' ELSE '' END AS text
    FROM (SELECT *, unnest(generate_series(0, k))::INT AS i FROM t)"""
)
def choose_variants_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    whens = "array_join(transform(slice(array(0, 1, 2, 3), 1, CAST(p_size % 5 AS INT)), j -> concat('<when test=\"w', j, '\">x', j, '</when> ')), '')"
    other = "CASE WHEN p_partkey % 2 = 1 THEN '<otherwise>else</otherwise>' ELSE '' END"
    return texts(templated(spark, sf_dir, "part", "p_partkey", f"concat('<select id=\"e\"><choose>', {whens}, {other}, '</choose></select>')"), "p_partkey")


@query(r"""SELECT o_orderkey, 'S WHERE ' || regexp_replace(t, '^\s*(?i:and|or)\s+', '') AS text
    FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '  AND  a' WHEN 1 THEN ' or b' WHEN 2 THEN 'order c' ELSE '  x and' END || o_custkey AS t FROM orders)""")
def where_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = "CASE o_orderkey % 4 WHEN 0 THEN '  AND  a' WHEN 1 THEN ' or b' WHEN 2 THEN 'order c' ELSE '  x and' END"
    return texts(templated(spark, sf_dir, "orders", "o_orderkey", f"concat('<select id=\"e\">S <where>', {inner}, o_custkey, '</where></select>')"), "o_orderkey").select("o_orderkey", "text")


@query(r"""SELECT o_orderkey, 'SET ' || regexp_replace(regexp_replace(t, '^\s*,\s*', ''), ',\s*$', '') AS text
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN ' , a' WHEN 1 THEN ' b' ELSE ',c' END || o_custkey || CASE o_orderkey % 2 WHEN 0 THEN ' , ' ELSE ' ' END AS t FROM orders)""")
def set_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = "CASE o_orderkey % 3 WHEN 0 THEN ' , a' WHEN 1 THEN ' b' ELSE ',c' END, o_custkey, CASE o_orderkey % 2 WHEN 0 THEN ' , ' ELSE ' ' END"
    return texts(templated(spark, sf_dir, "orders", "o_orderkey", f"concat('<update id=\"e\"><set>', {inner}, '</set></update>')"), "o_orderkey").select("o_orderkey", "text")


@query(r"""SELECT o_orderkey, '( ' || CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN ' b' ELSE 'andc' END || o_custkey || CASE o_orderkey % 2 WHEN 0 THEN '' ELSE ' ' END || ' )' AS text FROM orders""")
def trim_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    inner = "CASE o_orderkey % 3 WHEN 0 THEN '  aNd a' WHEN 1 THEN ' b' ELSE 'andc' END, o_custkey, CASE o_orderkey % 2 WHEN 0 THEN '; ' ELSE ' ' END"
    tag = '<trim prefix="(" suffix=")" prefixOverrides="AND |OR " suffixOverrides=",|;">'
    return texts(templated(spark, sf_dir, "orders", "o_orderkey", f"concat('<select id=\"e\">{tag}', {inner}, '</trim></select>')"), "o_orderkey").select("o_orderkey", "text")


@query("SELECT o_orderkey, 'IN (?, ' || o_custkey || ')' AS text, 'item' AS paths FROM orders")
def foreach_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<select id=\"e\">IN <foreach open=\"(\" close=\")\" separator=\",\" collection=\"l\">#{item}, ', o_custkey, '</foreach></select>')"
    rows = templated(spark, sf_dir, "orders", "o_orderkey", body, columns=TEXT_AND_PATHS)
    s = F.col("mapper.statements")[0]
    return rows.select("o_orderkey", s["sql"]["variants"][0]["text"]["text"].alias("text"), s["property_paths"][0]["value"].alias("paths"))


@query("SELECT c_custkey, 'IN (?)' AS text, 'l' || c_nationkey || ',l' || c_nationkey || '[]' AS paths FROM customer")
def iterate_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<select id=\"e\">IN <iterate property=\"l', c_nationkey, '\" open=\"(\" close=\")\" conjunction=\",\">#l', c_nationkey, '[]#</iterate></select>')"
    rows = templated(spark, sf_dir, "customer", "c_custkey", body, "sqlMap", TEXT_AND_PATHS)
    s = F.col("mapper.statements")[0]
    return rows.select("c_custkey", s["sql"]["variants"][0]["text"]["text"].alias("text"), F.array_join(F.transform(s["property_paths"], lambda p: p["value"]), ",").alias("paths"))


@query("SELECT p_partkey, 'v + ' || p_size AS path, 38::BIGINT AS path_start, (38 + strlen('<bind name=\"x\" value=\"v + ' || p_size || '\"/>'))::BIGINT AS path_end FROM part")
def bind_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<select id=\"e\">', '<bind name=\"x\" value=\"v + ', p_size, '\"/>', 'S</select>')"
    p = relations.property_paths(templated(spark, sf_dir, "part", "p_partkey", body, columns=NEEDS["property_paths"]), ("p_partkey",))
    return p.select("p_partkey", "path", F.col("path_start").cast("long").alias("path_start"), F.col("path_end").cast("long").alias("path_end"))


@query(
    """WITH v AS (SELECT c_custkey, unnest([0, 1, 2, 3]) AS i FROM customer)
    SELECT c_custkey, i AS variant_ord,
      array_to_string(list_concat(CASE WHEN i >= 2 THEN ['isNotNull(a)'] ELSE [] END, CASE WHEN i % 2 = 1 THEN ['isEqual(b, ''' || c_custkey || ''')'] ELSE [] END), ' && ') AS conditions,
      'S ' || CASE i WHEN 0 THEN '' WHEN 1 THEN 'WHERE b' WHEN 2 THEN 'WHERE a' ELSE 'WHERE aOR b' END AS text
    FROM v"""
)
def ibatis_dynamic_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first part that is there loses its own prefix to the wrapper's."""
    inner = "'<isNotNull prepend=\"AND\" property=\"a\">a</isNotNull><isEqual prepend=\"OR\" property=\"b\" compareValue=\"', c_custkey, '\">b</isEqual>'"
    return texts(templated(spark, sf_dir, "customer", "c_custkey", f"concat('<select id=\"e\">S <dynamic prepend=\"WHERE\">', {inner}, '</dynamic></select>')", "sqlMap"), "c_custkey")


@query(
    """SELECT p_partkey, CASE WHEN k > 5 THEN 'union' ELSE 'variants' END AS sql_kind, (CASE WHEN k > 5 THEN 1 ELSE 1 << k END)::BIGINT AS n_rows,
      CASE WHEN k > 5 THEN 64 END AS branch_count,
      CASE WHEN k > 5 THEN array_to_string(list_transform(range(1, k + 1), lambda j: 't' || j), '') END AS text, CASE WHEN k > 5 THEN 'branch_limit_exceeded' END AS code
    FROM (SELECT p_partkey, (p_partkey % 4 + 4)::INT AS k FROM part)"""
)
def branch_cap_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ifs = "array_join(transform(sequence(1, CAST(p_partkey % 4 + 4 AS INT)), j -> concat('<if test=\"c', j, '\">t', j, '</if>')), '')"
    rows = templated(spark, sf_dir, "part", "p_partkey", f"concat('<select id=\"e\">', {ifs}, '</select>')", columns=("mapper.statements.sql.variants.conditions", "mapper.statements.sql.union.branch_count", "mapper.statements.sql.union.text.text", "diagnostics.code"))
    s = F.col("mapper.statements")[0]["sql"]
    union = s["union"].isNotNull()
    return rows.select(
        "p_partkey",
        F.when(union, "union").otherwise("variants").alias("sql_kind"),
        F.when(union, 1).otherwise(F.size(s["variants"])).cast("long").alias("n_rows"),
        s["union"]["branch_count"].alias("branch_count"),
        s["union"]["text"]["text"].alias("text"),
        F.get("diagnostics", F.lit(0))["code"].alias("code"),
    )


@query(
    """SELECT o_orderkey, 0 AS off, 38::BIGINT AS raw FROM orders UNION ALL
    SELECT o_orderkey, 5, 38 + 4 + 3 + strlen('k' || o_orderkey) FROM orders"""
)
def span_map_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the text around a placeholder comes from."""
    body = "concat('<select id=\"e\">a = #{k', o_orderkey, '} AND x</select>')"
    m = relations.span_map(templated(spark, sf_dir, "orders", "o_orderkey", body, columns=NEEDS["variants"]), ("o_orderkey",))
    return m.select("o_orderkey", "off", F.col("raw").cast("long").alias("raw"))


# ------------------------------------------------------------------ linking

REF = "CASE o_orderkey % 3 WHEN 0 THEN 'f' || o_custkey WHEN 1 THEN 'a.b' || o_custkey || '.f' ELSE '${x' || o_custkey || '}' END"


@query(f"""SELECT o_orderkey, {REF} AS raw, CASE o_orderkey % 3 WHEN 0 THEN 'local' WHEN 1 THEN 'qualified' ELSE 'dynamic' END AS target_kind,
    CASE WHEN o_orderkey % 3 = 1 THEN 'a.b' || o_custkey END AS target_ns, CASE o_orderkey % 3 WHEN 0 THEN 'f' || o_custkey WHEN 1 THEN 'f' END AS target_id FROM orders""")
def includes_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = f"concat('<select id=\"e\">S <include refid=\"', {REF}, '\"/></select>')"
    i = relations.includes(templated(spark, sf_dir, "orders", "o_orderkey", body, columns=NEEDS["includes"]), ("o_orderkey",))
    return i.select("o_orderkey", "raw", "target_kind", "target_ns", "target_id")


@query("SELECT n_nationkey, 'f' || n_regionkey AS target_id FROM nation WHERE n_regionkey NOT IN (0, 2)")
def dangling_refids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes that no fragment answers: by an anti join, as the parser also notes."""
    body = "concat('<sql id=\"f0\">a</sql><select id=\"e\">S <include refid=\"f', n_regionkey, '\"/></select><sql id=\"f2\">b</sql>')"
    rows = written(templated(spark, sf_dir, "nation", "n_nationkey", body, columns=(*NEEDS["includes"], *NEEDS["fragments"])), "parsed")
    key = ("n_nationkey",)
    return relations.dangling_includes(relations.includes(rows, key), relations.fragments(rows, key), key).select("n_nationkey", "target_id")


@query(
    """WITH RECURSIVE r(n_nationkey, i, depth) AS (
      SELECT n_nationkey, n_regionkey, 1 FROM nation UNION ALL SELECT n_nationkey, i - 1, depth + 1 FROM r WHERE i > 0)
    SELECT n_nationkey, 'f' || i AS target_id, depth FROM r"""
)
def include_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments that a statement reaches through chains of includes."""
    chain = "array_join(transform(sequence(0, 4), j -> concat('<sql id=\"f', j, '\">', CASE WHEN j > 0 THEN concat('<include refid=\"f', j - 1, '\"/>') ELSE 'x' END, '</sql>')), '')"
    rows = templated(spark, sf_dir, "nation", "n_nationkey", f"concat({chain}, '<select id=\"e\"><include refid=\"f', n_regionkey, '\"/></select>')", columns=NEEDS["includes"])
    reach = relations.include_closure(relations.includes(rows, ("n_nationkey",)), "n_nationkey")
    return reach.filter("owner = 'statement'").select("n_nationkey", "target_id", "depth")


@query("SELECT n_nationkey, 'S ' || CASE WHEN n_regionkey = 1 THEN 'one' ELSE '/* batis:include(f' || n_regionkey || ') */' END AS text FROM nation")
def include_substitution(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<sql id=\"f1\">one</sql><select id=\"e\">S <include refid=\"f', n_regionkey, '\"/></select>')"
    rows = relations.variants(templated(spark, sf_dir, "nation", "n_nationkey", body), ("n_nationkey",), False)
    return relations.substituted(rows, "n_nationkey").select("n_nationkey", "text")


@query(
    """SELECT o_orderkey, 0 AS ord, 'insert' AS kind, 'i' || o_orderkey AS id, 'INSERT ' || o_custkey AS text FROM orders
    UNION ALL SELECT o_orderkey, 1, 'select', 'i' || o_orderkey || '!selectKey', 'NEXT ' || o_custkey FROM orders"""
)
def selectkey_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<insert id=\"i', o_orderkey, '\"><selectKey resultType=\"int\">NEXT ', o_custkey, '</selectKey>INSERT ', o_custkey, '</insert>')"
    rows = templated(spark, sf_dir, "orders", "o_orderkey", body, columns=("mapper.statements.kind", "mapper.statements.id.value", "mapper.statements.sql.variants.text.text"))
    return rows.select("o_orderkey", F.posexplode("mapper.statements").alias("ord", "s")).select("o_orderkey", "ord", "s.kind", F.col("s.id.value").alias("id"), F.col("s.sql.variants")[0]["text"]["text"].alias("text"))


@query(
    """SELECT p_partkey, 0 AS ord, 'c' || p_partkey AS column_name, 'id' AS property FROM part
    UNION ALL SELECT p_partkey, 1, 'n' || p_size, 'a.name' FROM part UNION ALL SELECT p_partkey, 2, NULL, 'k' FROM part"""
)
def resultmap_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = """concat('<resultMap id="m" type="T"><id column="c', p_partkey, '" property="id"/><association property="a" column="z"><result property="a.name" column="n', p_size,
      '"/></association><discriminator column="d"><case value="1"><result property="k"/></case></discriminator><constructor><idArg column="q"/></constructor></resultMap>')"""
    return relations.column_mappings(templated(spark, sf_dir, "part", "p_partkey", body, columns=NEEDS["column_mappings"]), ("p_partkey",)).select("p_partkey", "ord", F.col("column").alias("column_name"), "property")


@query("SELECT p_partkey, 'm' AS id, 'T' || p_size AS type_ref, CASE WHEN p_size % 2 = 0 THEN 'base' END AS extends FROM part")
def result_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<resultMap id=\"m\" type=\"T', p_size, '\"', CASE WHEN p_size % 2 = 0 THEN ' extends=\"base\"' ELSE '' END, '/>')"
    return relations.result_maps(templated(spark, sf_dir, "part", "p_partkey", body, columns=NEEDS["result_maps"]), ("p_partkey",)).select("p_partkey", "id", "type_ref", "extends")


# --------------------------------------------------------- consumer programs


@query(
    """SELECT o_orderkey, 'q' || o_orderkey AS id, 0 AS variant_ord, 'always' AS condition, 'SELECT ' || o_custkey AS text FROM orders
    UNION ALL SELECT o_orderkey, 'q' || o_orderkey, 1, 's = ''' || o_orderstatus || '''', 'SELECT ' || o_custkey || ' WHERE x' FROM orders"""
)
def dump_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement's variants with the conditions that make them."""
    body = "concat('<select id=\"q', o_orderkey, '\">SELECT ', o_custkey, '<if test=\"s = ', chr(39), o_orderstatus, chr(39), '\"> WHERE x</if></select>')"
    return relations.dump(templated(spark, sf_dir, "orders", "o_orderkey", body), ("o_orderkey",)).select("o_orderkey", "id", "variant_ord", "condition", "text")


@query(
    """SELECT code, sum(n)::BIGINT AS n FROM (
      SELECT 'unknown_element' AS code, count(*) AS n FROM orders WHERE o_orderkey % 2 = 0 UNION ALL
      SELECT 'invalid_entity', 2 * count(*) FROM orders WHERE o_orderkey % 3 = 0 UNION ALL
      SELECT 'unterminated_placeholder', count(*) FROM orders WHERE o_orderkey % 5 = 0 UNION ALL
      SELECT 'duplicate_attribute', count(*) FROM orders WHERE o_orderkey % 7 = 0 UNION ALL
      SELECT 'include_at_wrapper_boundary', count(*) FROM orders WHERE o_orderkey % 11 = 0 UNION ALL
      SELECT 'dangling_refid', count(*) FROM orders WHERE o_orderkey % 11 = 0) GROUP BY code"""
)
def diag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of a corpus by code."""
    body = """concat('<select id="e"', CASE WHEN o_orderkey % 7 = 0 THEN ' id="f"' ELSE '' END, '>S', CASE WHEN o_orderkey % 2 = 0 THEN '<iff>a</iff>' ELSE '' END,
      CASE WHEN o_orderkey % 3 = 0 THEN ' a && b ' ELSE '' END, CASE WHEN o_orderkey % 11 = 0 THEN '<where> <include refid="g"/> AND x </where>' ELSE '' END,
      CASE WHEN o_orderkey % 5 = 0 THEN ' #{x' ELSE '' END, '</select>')"""
    d = relations.diagnostics(templated(spark, sf_dir, "orders", "o_orderkey", body, columns=("diagnostics.code", "diagnostics.span", "diagnostics.message")), ("o_orderkey",))
    return d.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT p_partkey, i AS variant_ord, ((1 << k) - 3)::INT AS n_more, CASE i WHEN 0 THEN 's' WHEN 1 THEN 's t' || k ELSE 's t' || (k - 1) END AS text
    FROM (SELECT p_partkey, (p_partkey % 3 + 2)::INT AS k, unnest([0, 1, 2]) AS i FROM part)"""
)
def top3_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    ifs = "array_join(transform(sequence(1, CAST(p_partkey % 3 + 2 AS INT)), j -> concat('<if test=\"c', j, '\">\n  t', j, '</if>')), '')"
    rows = relations.first_variants(templated(spark, sf_dir, "part", "p_partkey", f"concat('<select id=\"e\"> s', {ifs}, ' </select>')"), 3, ("p_partkey",))
    return rows.select("p_partkey", "variant_ord", "n_more", "text")


@query(
    r"""WITH d AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\s+')) AS word FROM documents)
    SELECT DISTINCT d.doc_id, d.word FROM d JOIN (SELECT DISTINCT n_name AS word FROM nation UNION SELECT 'the' UNION SELECT 'und') n USING (word)"""
)
def binding_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents mention an id between white space."""
    ids = table(spark, sf_dir, "nation").select(F.col("n_name").alias("word")).union(spark.createDataFrame([("the",), ("und",)], "word string"))
    return accuracy.mentions(table(spark, sf_dir, "documents"), ids, "doc_id")


@query(
    """SELECT 'x' || n_regionkey AS id, d.dialect, count(n.n_nationkey) FILTER (n.n_nationkey % 2 = d.k) AS n
    FROM nation n CROSS JOIN (VALUES ('mybatis', 0), ('ibatis', 1)) d(dialect, k) GROUP BY ALL"""
)
def dialect_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every statement id against both dialects, absent ones with 0."""
    body = "concat(CASE WHEN n_nationkey % 2 = 0 THEN '<mapper>' ELSE '<sqlMap>' END, '<select id=\"x', n_regionkey, '\">S</select>', CASE WHEN n_nationkey % 2 = 0 THEN '</mapper>' ELSE '</sqlMap>' END)"
    rows = parsed(table(spark, sf_dir, "nation").select("n_nationkey", F.expr(body).alias("content")), carry=("n_nationkey",), columns=("dialect", *NEEDS["statements"]))
    rows = written(rows, "parsed")
    s = relations.statements(rows, ("n_nationkey",)).join(rows.select("n_nationkey", "dialect"), "n_nationkey")
    return accuracy.presence(s, spark.createDataFrame([("mybatis",), ("ibatis",)], "dialect string"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS n_expected, (CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END)::BIGINT AS n_found FROM orders")
def statement_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements found against a plain count of their tags."""
    body = "concat('<mapper><insert id=\"a\"><selectKey>k</selectKey>x</insert>', CASE WHEN o_orderkey % 4 = 0 THEN '<delete id=\"b\">y</delete>' ELSE '' END, '</mapper>')"
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.expr(body).alias("content"))
    return accuracy.recall(docs, relations.statements(parsed(docs, columns=NEEDS["statements"]))).withColumnRenamed("doc_id", "o_orderkey")


@query("SELECT o_orderkey, 'S ' || o_custkey AS text, 'unknown_element' AS code FROM orders")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON documents and read again."""
    body = "concat('<select id=\"e\">S ', o_custkey, '</select><slect/>')"
    key = ("o_orderkey",)
    rows = from_json(parsed_json(mappers(spark, sf_dir, "orders", "o_orderkey", body), carry=key), "json", key)
    return rows.select("o_orderkey", F.col("mapper.statements")[0]["sql"]["variants"][0]["text"]["text"].alias("text"), F.col("diagnostics")[0]["code"].alias("code"))


@query()
def hostile_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Broken mappers around every document's text: nothing raises."""
    broken = "concat('<mapper><select id=\"e\">', replace(replace(coalesce(text, ''), ' a', '<a '), ' e', '&e'), CASE WHEN doc_id % 2 = 0 THEN '</select>' ELSE '' END)"
    rows = parsed(table(spark, sf_dir, "documents").select("doc_id", F.expr(broken).alias("content")), columns=("dialect", "diagnostics.code"))
    return rows.select("doc_id", "dialect", F.size("diagnostics").alias("n_diagnostics"))


# ------------------------------------------------------ encodings and limits


@query(
    """SELECT c_custkey, ['UTF-8', 'UTF-8', 'UTF-16LE', 'UTF-16BE', 'EUC-KR', 'EUC-KR'][1 + (c_custkey % 6)::INT] AS encoding,
    CASE WHEN c_custkey % 6 >= 4 THEN chr(44032) ELSE chr(44032) || chr(233) END || c_custkey AS namespace,
    CASE WHEN c_custkey % 6 = 5 THEN 'encoding_mismatch' END AS code FROM customer"""
)
def encodings_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8 with and without its mark, both UTF-16 forms, EUC-KR undeclared and declared wrongly."""
    text = "concat('<mapper namespace=\"', chr_kor, chr_acute, c_custkey, '\"/>')"
    head = "CASE WHEN c_custkey % 6 = 5 THEN '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' ELSE '' END"
    korean = f"concat(encode(concat({head}, '<mapper namespace=\"'), 'UTF-8'), X'B0A1', encode(concat(c_custkey, '\"/>'), 'UTF-8'))"
    content = f"""CASE c_custkey % 6 WHEN 0 THEN encode({text}, 'UTF-8') WHEN 1 THEN concat(X'EFBBBF', encode({text}, 'UTF-8'))
      WHEN 2 THEN concat(X'FFFE', encode({text}, 'UTF-16LE')) WHEN 3 THEN concat(X'FEFF', encode({text}, 'UTF-16BE')) ELSE {korean} END"""
    docs = table(spark, sf_dir, "customer").select("c_custkey", F.lit("가").alias("chr_kor"), F.lit("é").alias("chr_acute")).select("c_custkey", F.expr(content).alias("content"))
    rows = parsed(docs, carry=("c_custkey",), columns=("encoding", "mapper.namespace.value", "diagnostics.code"))
    return rows.select("c_custkey", "encoding", F.col("mapper.namespace.value").alias("namespace"), F.get("diagnostics", F.lit(0))["code"].alias("code"))


@query("SELECT r_regionkey, r_regionkey % 2 = 0 AS has_mapper, CASE WHEN r_regionkey % 2 = 1 THEN 'oversize_input' END AS code, CASE WHEN r_regionkey % 2 = 0 THEN 'mybatis' ELSE 'unknown' END AS dialect FROM region")
def oversize_gate_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of ten megabytes less and more: the larger never reach the parser."""
    content = "concat('<mapper>', repeat(' ', CASE WHEN r_regionkey % 2 = 1 THEN 10485760 ELSE 1000 END), '</mapper>')"
    rows = parsed(table(spark, sf_dir, "region").select("r_regionkey", F.expr(content).alias("content")), carry=("r_regionkey",), columns=("dialect", "mapper.namespace.value", "diagnostics.code"))
    return rows.select("r_regionkey", F.col("mapper").isNotNull().alias("has_mapper"), F.get("diagnostics", F.lit(0))["code"].alias("code"), "dialect")


@query(
    """SELECT n_nationkey, i AS ord, 'f' || i AS id, 'x' || n_regionkey AS text FROM nation, (VALUES (0), (1)) v(i)"""
)
def fragments_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments in document order; one without an id is dropped."""
    body = "concat('<sql id=\"f0\">x', n_regionkey, '</sql><sql>lost</sql><sql id=\"f1\">x', n_regionkey, '</sql>')"
    rows = written(templated(spark, sf_dir, "nation", "n_nationkey", body, columns=(*NEEDS["texts"], *NEEDS["fragments"])), "parsed")
    key = ("n_nationkey",)
    f = relations.fragments(rows, key).select("n_nationkey", "ord", "id")
    v = relations.variants(rows, key, False).select("n_nationkey", F.col("owner_ord").alias("ord"), "text")
    return f.join(v, ["n_nationkey", "ord"])


@query("SELECT n_nationkey, 'select' AS kind FROM nation WHERE n_regionkey = 2")
def missing_ids_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = "concat('<select', CASE WHEN n_regionkey = 2 THEN '' ELSE ' id=\"a\"' END, '>x</select>')"
    return relations.missing_ids(relations.statements(templated(spark, sf_dir, "nation", "n_nationkey", body, columns=NEEDS["statements"]), ("n_nationkey",))).select("n_nationkey", "kind")


# ------------------------------------- what documents of odd shapes come to


@query("SELECT c_custkey, 'WHERE a <= ? AND b = A__BATIS_DYN__ &no; x' AS text, 'p' || c_custkey || ',v' AS paths, 'invalid_entity' AS codes FROM customer")
def merged_runs_customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders across character sections, references and comments."""
    body = "concat('<select id=\"e\">WHERE a &lt;= #<![CDATA[{p', c_custkey, ']]><!-- } -->, x&#125; AND b = &#x41;<?pi }?>${<!-- -->v} &no; x</select>')"
    rows = templated(spark, sf_dir, "customer", "c_custkey", body, columns=(*TEXT_AND_PATHS, "diagnostics.code"))
    s = F.col("mapper.statements")[0]
    return rows.select("c_custkey", s["sql"]["variants"][0]["text"]["text"].alias("text"), F.array_join(F.transform(s["property_paths"], lambda p: p["value"]), ",").alias("paths"), codes().alias("codes"))


@query(
    """SELECT o_orderkey, unnest([0, 2, 8, 8 + n, 8 + n + 1, 8 + n + 3, 8 + n + 3 + n])::INT AS off, unnest([38, 40, 52, 52 + n + 8, 52 + n + 9, 52 + n + 9 + 28, 52 + n + 9])::BIGINT AS raw
    FROM (SELECT o_orderkey, length(o_custkey::VARCHAR) AS n FROM orders)"""
)
def wrapper_marks_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of a clause's own word, of what it cuts, and of what a trim adds at both ends."""
    body = "concat('<select id=\"e\">S <where> AND ', o_custkey, '</where> <trim prefix=\"(\" suffix=\")\">', o_custkey, '</trim></select>')"
    m = relations.span_map(templated(spark, sf_dir, "orders", "o_orderkey", body, columns=NEEDS["variants"]), ("o_orderkey",))
    return m.select("o_orderkey", "off", F.col("raw").cast("long").alias("raw"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'unclosed_tag,unclosed_tag,unclosed_tag,unclosed_tag' WHEN 1 THEN 'unclosed_tag' WHEN 2 THEN 'unclosed_tag,unclosed_tag' ELSE '' END AS codes,
      CASE p_partkey % 4 WHEN 2 THEN 2 ELSE 1 END AS n_statements FROM part"""
)
def recovery_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closing tags that close nothing, tags that never end, and roots that never close."""
    body = """concat('<mapper><select id="a">x', CASE p_partkey % 4 WHEN 0 THEN '</b></select></mapper>' WHEN 1 THEN '</select>' WHEN 2 THEN '</select></b><select id="c">z' ELSE '</select></mapper></z>' END)"""
    rows = parsed(table(spark, sf_dir, "part").select("p_partkey", F.expr(body).alias("content")), carry=("p_partkey",), columns=("diagnostics.code", "mapper.statements.kind"))
    return rows.select("p_partkey", codes().alias("codes"), F.size("mapper.statements").alias("n_statements"))


@query(
    """SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'invalid_entity,invalid_entity' ELSE 'unknown_element' END AS codes,
      CASE WHEN s_suppkey % 2 = 0 THEN 23 + 15 + 9 + 9 + length(s_suppkey::VARCHAR) + 1 END::BIGINT AS first_start FROM supplier"""
)
def trailing_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Behind the root only references count; inside, elements that are ignored say nothing."""
    even = "concat('<mapper namespace=\"ns\"><select id=\"e\"></select></mapper>', s_suppkey, ' & <x> <!-- &y; --> &z;')"
    odd = "concat('<mapper><cache/><cache-ref namespace=\"', s_suppkey, '\"/><parameterMap id=\"p\"><x/></parameterMap><cach/></mapper>')"
    docs = table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(f"CASE WHEN s_suppkey % 2 = 0 THEN {even} ELSE {odd} END").alias("content"))
    rows = parsed(docs, carry=("s_suppkey",), columns=("diagnostics.code", "diagnostics.span"))
    first = F.when(F.col("s_suppkey") % 2 == 0, F.get("diagnostics", F.lit(0))["span"]["start"])
    return rows.select("s_suppkey", codes().alias("codes"), first.cast("long").alias("first_start"))


@query("SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN '' ELSE 'x' || s_suppkey END AS text, CASE s_suppkey % 3 WHEN 0 THEN 0 ELSE 1 END AS n_marks, CASE s_suppkey % 3 WHEN 2 THEN 'duplicate_attribute' ELSE '' END AS codes FROM supplier")
def empty_bodies_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A body that is none has one empty variant; what is noted at one place twice is noted once."""
    body = """CASE s_suppkey % 3 WHEN 0 THEN '<select id="e"/>' WHEN 1 THEN concat('<select id="e">x', s_suppkey, '</select>')
      ELSE concat('<select id="e">x', s_suppkey, '<include refid="f" refid="g"/></select><sql id="f"/>') END"""
    rows = templated(spark, sf_dir, "supplier", "s_suppkey", body, columns=("mapper.statements.sql", "diagnostics.code"))
    t = F.col("mapper.statements")[0]["sql"]["variants"][0]["text"]
    return rows.select("s_suppkey", F.split_part(t["text"], F.lit("/*"), F.lit(1)).alias("text"), F.least(F.size(t["span_map"]), F.lit(1)).alias("n_marks"), codes().alias("codes"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 't' || p_size END AS text, CASE WHEN p_partkey % 2 = 0 THEN 'nesting_limit_exceeded' ELSE '' END AS codes FROM part")
def depth_cap_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is nested beyond the cap has no text."""
    body = "concat('<select id=\"e\">', repeat('<trim>', CASE WHEN p_partkey % 2 = 0 THEN 300 ELSE 200 END), 't', p_size, repeat('</trim>', CASE WHEN p_partkey % 2 = 0 THEN 300 ELSE 200 END), '</select>')"
    rows = templated(spark, sf_dir, "part", "p_partkey", body, columns=("mapper.statements.sql.variants.text.text", "diagnostics.code"))
    return rows.select("p_partkey", F.col("mapper.statements")[0]["sql"]["variants"][0]["text"]["text"].alias("text"), codes().alias("codes"))


@query(
    """SELECT s_suppkey, unnest([0, 1]) AS ord, unnest(['S', 'k' || s_suppkey || ' inner']) AS text, unnest(['i', 'i!selectKey']) AS id, unnest(['db', 'db']) AS database_id,
      'unknown_element,unknown_element' AS codes FROM supplier"""
)
def selectkeys_in_places_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key takes its statement's database; one in a key or in a fragment is no statement."""
    body = """concat('<insert id="i" databaseId="db">S<selectKey>k', s_suppkey, ' <selectKey>inner</selectKey></selectKey></insert><sql id="f">F<selectKey>lost</selectKey></sql>')"""
    columns = ("diagnostics.code", "mapper.statements.id.value", "mapper.statements.database_id.value", "mapper.statements.sql.variants.text.text")
    rows = templated(spark, sf_dir, "supplier", "s_suppkey", body, columns=columns)
    each = rows.select("s_suppkey", codes().alias("codes"), F.posexplode("mapper.statements").alias("ord", "s"))
    return each.select("s_suppkey", "ord", F.col("s.sql.variants")[0]["text"]["text"].alias("text"), F.col("s.id.value").alias("id"), F.col("s.database_id.value").alias("database_id"), "codes")


@query("SELECT o_orderkey, 'a' || o_custkey || ',f,g' AS targets, 4 AS n_dangling FROM orders")
def include_merge_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Includes of all levels in document order; only one right below a statement must have a refid."""
    body = "concat('<select id=\"e\"><include/><if test=\"t\"><include refid=\"a', o_custkey, '\"/><include/></if> <include refid=\"f\"/><where>x <include refid=\"g\"/> y</where></select>')"
    rows = templated(spark, sf_dir, "orders", "o_orderkey", body, columns=("mapper.statements.includes.value.raw", "diagnostics.code"))
    targets = F.array_join(F.transform(F.col("mapper.statements")[0]["includes"], lambda i: i["value"]["raw"]), ",")
    return rows.select("o_orderkey", targets.alias("targets"), F.size(F.filter("diagnostics", lambda d: d["code"] == "dangling_refid")).alias("n_dangling"))


@query(
    """SELECT s_suppkey, unnest(['procedure', 'generic', 'select']) AS kind, unnest(['C' || s_suppkey, 'P' || s_suppkey, NULL]) AS param_class,
      unnest([NULL, 'm' || s_nationkey, 'm']) AS result_map_ref FROM supplier"""
)
def kinds_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of statements that only the older dialect has, and the classes they name."""
    body = "concat('<procedure id=\"a\" parameterClass=\"C', s_suppkey, '\"/><statement id=\"b\" parameterType=\"P', s_suppkey, '\" parameterClass=\"Q\" resultMap=\"m', s_nationkey, '\"/><select id=\"c\" resultMap=\"m\"/>')"
    s = relations.statements(templated(spark, sf_dir, "supplier", "s_suppkey", body, "sqlMap", NEEDS["statements"]), ("s_suppkey",))
    return s.select("s_suppkey", "kind", "param_class", "result_map_ref")


# --------------------------------------------- encodings, sinks and sources


@query(
    """SELECT s_suppkey, ['KOI8-R', 'windows-1252', 'ISO-8859-8', 'macintosh', 'EUC-KR', 'UTF-8'][1 + (s_suppkey % 6)::INT] AS encoding,
      CASE s_suppkey % 6 WHEN 0 THEN chr(1072) WHEN 1 THEN chr(193) WHEN 2 THEN chr(1488) WHEN 3 THEN chr(199) WHEN 4 THEN chr(44032) ELSE chr(65533) END || s_suppkey AS namespace,
      ['', '', '', '', 'encoding_mismatch', 'encoding_undetectable'][1 + (s_suppkey % 6)::INT] AS codes FROM supplier"""
)
def declared_encodings_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that are no UTF-8: as declared, declared wrongly, and of no encoding."""
    said = "element_at(array('KOI8-R', 'latin1', 'hebrew', 'x-mac-roman', 'no-such', 'us-ascii2'), CAST(s_suppkey % 6 + 1 AS INT))"
    byte = "CASE s_suppkey % 6 WHEN 0 THEN X'C1' WHEN 1 THEN X'C1' WHEN 2 THEN X'E0' WHEN 3 THEN X'82' WHEN 4 THEN X'B0A1' ELSE X'FF' END"
    head = f"CASE WHEN s_suppkey % 6 = 5 THEN '' ELSE concat('<?xml version=\"1.0\" encoding=\"', {said}, '\"?>') END"
    content = f"concat(encode(concat({head}, '<mapper namespace=\"'), 'UTF-8'), {byte}, encode(concat(s_suppkey, '\"/>'), 'UTF-8'))"
    rows = parsed(table(spark, sf_dir, "supplier").select("s_suppkey", F.expr(content).alias("content")), carry=("s_suppkey",), columns=("encoding", "mapper.namespace.value", "diagnostics.code"))
    return rows.select("s_suppkey", "encoding", F.col("mapper.namespace.value").alias("namespace"), codes().alias("codes"))


@query("SELECT r_regionkey, 'UTF-16LE' AS encoding, CASE WHEN r_regionkey % 2 = 1 THEN 'oversize_input' ELSE '' END AS codes FROM region")
def oversize_decoded_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight megabytes of UTF-16 that are twelve of UTF-8: the limit holds for these too."""
    text = "concat('<mapper><select id=\"a\">', repeat('가', CASE WHEN r_regionkey % 2 = 1 THEN 4000000 ELSE 10 END), '</select></mapper>')"
    docs = table(spark, sf_dir, "region").select("r_regionkey", F.expr(f"concat(X'FFFE', encode({text}, 'UTF-16LE'))").alias("content"))
    return parsed(docs, carry=("r_regionkey",), columns=("encoding", "diagnostics.code")).select("r_regionkey", "encoding", codes().alias("codes"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN 'other' ELSE 'unclosed_tag' END AS code, 'external' AS target_ns, n_regionkey::INT AS raw FROM nation")
def json_of_later_versions_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the published form by other hands: codes not known here, targets of all shapes."""
    target = '{"qualified":{"ns":"external","id":"f"}}'
    sql = "concat('{\"variants\":[{\"text\":{\"text\":\"x\",\"span_map\":[[0,', n_regionkey, ']]},\"conditions\":[]}]}')"
    statement = f"concat('{{\"kind\":\"select\",\"id\":null,\"database_id\":null,\"sql\":', {sql}, ',\"includes\":[{{\"value\":{{\"raw\":\"external.f\",\"target\":{target}}},\"span\":{{\"start\":1,\"end\":2}}}}],\"property_paths\":[]}}')"
    document = f"""concat('{{"dialect":"mybatis","encoding":"UTF-8","mapper":{{"namespace":null,"statements":[', {statement}, '],"fragments":[],"result_maps":[]}},"diagnostics":[{{"code":"',
      CASE WHEN n_regionkey = 1 THEN 'a_new_code' ELSE 'unclosed_tag' END, '","span":null,"message":"m"}}]}}')"""
    rows = from_json(table(spark, sf_dir, "nation").select("n_nationkey", F.expr(document).alias("json")), carry=("n_nationkey",))
    s = F.col("mapper.statements")[0]
    mark = s["sql"]["variants"][0]["text"]["span_map"][0]["raw"]
    return rows.select("n_nationkey", F.col("diagnostics")[0]["code"].alias("code"), s["includes"][0]["value"]["target"]["ns"].alias("target_ns"), mark.alias("raw"))


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 0 THEN 'ibatis' ELSE 'mybatis' END AS dialect, 'n' || n_regionkey AS namespace, 1 AS n_variants, true AS has_version FROM nation")
def sql_functions_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parser as SQL functions: dialect, JSON, variants, version."""
    from quillmap.functions import registered

    registered.register(spark)
    root = "CASE WHEN n_regionkey = 0 THEN 'sqlMap' ELSE 'mapper' END"
    content = f"encode(concat('<', {root}, ' namespace=\"n', n_regionkey, '\"><select id=\"e\">S</select></', {root}, '>'), 'UTF-8')"
    docs = table(spark, sf_dir, "nation").select("n_nationkey", F.expr(content).alias("content"))
    return spark.sql(
        """SELECT n_nationkey, mapper_dialect(content) AS dialect, get_json_object(mapper_json(content), '$.mapper.namespace.value') AS namespace,
        json_array_length(get_json_object(mapper_json(content), '$.mapper.statements[0].sql.variants')) AS n_variants, length(mapper_version()) > 0 AS has_version FROM {docs}""",
        docs=docs,
    )


@query("SELECT n_nationkey, 'q' || n_regionkey AS id, 'SELECT ' || n_name AS text FROM nation")
def corpus_files_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of folders of documents, written, walked and parsed."""
    folder = new_path(spark, "corpus")
    text = F.expr("concat('<mapper><select id=\"q', n_regionkey, '\">SELECT ', n_name, '</select></mapper>')")
    table(spark, sf_dir, "nation").select("n_nationkey", text.alias("value")).write.partitionBy("n_nationkey").text(folder)
    rows = parsed(corpus.files(spark, folder, "*.txt"), columns=NEEDS["texts"])
    v = relations.variants(rows, marks=False)
    return v.select(F.regexp_extract("doc_id", "n_nationkey=([0-9]+)", 1).cast(table(spark, sf_dir, "nation").schema["n_nationkey"].dataType).alias("n_nationkey"), F.col("owner_id").alias("id"), "text")


# ------------------------------------------------- includes across a document

# A dollar and its brace are apart: Spark would put a variable there.
_TREE = "concat('<sql id=\"a\"><include refid=\"b\"/></sql><sql id=\"b\">x <include refid=\"a\"/><include refid=\"c\"/></sql><sql id=\"c\"><include refid=\"n', n_regionkey, '.z\"/><include refid=\"$', '{d}\"/><include refid=\"lost\"/></sql><select id=\"e\"><include refid=\"a\"/></select>')"


@query(
    """SELECT n_nationkey, raw, source, depth::INT AS depth, label FROM nation, (VALUES ('a', NULL, 1, 'fragment'), ('b', 'a', 2, 'fragment'), ('a', 'b', 3, 'cycle'), ('c', 'b', 3, 'fragment'),
      ('${d}', 'c', 4, 'dynamic'), ('lost', 'c', 4, 'unresolved')) v(raw, source, depth, label)
    UNION ALL SELECT n_nationkey, 'n' || n_regionkey || '.z', 'c', 4, 'external' FROM nation"""
)
def include_tree_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every include that a statement reaches, and what becomes of it."""
    key = ("n_nationkey",)
    rows = written(templated(spark, sf_dir, "nation", "n_nationkey", _TREE, columns=(*NEEDS["includes"], *NEEDS["fragments"])), "parsed")
    tree = relations.include_tree(relations.includes(rows, key), relations.fragments(rows, key), "n_nationkey")
    return tree.filter("owner = 'statement'").select("n_nationkey", "raw", "source", "depth", "label")


@query(
    """SELECT n_nationkey, 'S one' || n_regionkey || ' [two one' || n_regionkey || '] one' || n_regionkey || CASE WHEN i = 1 THEN ' t on' ELSE ' off' END || ' /* batis:include(loop) */' AS text,
      CASE WHEN i = 1 THEN 't' ELSE '' END AS conditions FROM nation, (VALUES (0), (1)) v(i)"""
)
def nested_substitution_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Several includes in a text, fragments in fragments, and variants that go with the text's own conditions."""
    body = """concat('<sql id="f1">one', n_regionkey, '</sql><sql id="f2">[two <include refid="f1"/>]</sql><sql id="f3"><choose><when test="t">on</when><otherwise>off</otherwise></choose></sql>',
      '<sql id="loop">x <include refid="loop"/></sql>',
      '<select id="e">S <include refid="f1"/> <include refid="f2"/> <include refid="f1"/><if test="t"> t</if> <include refid="f3"/> <include refid="loop"/></select>')"""
    rows = relations.variants(templated(spark, sf_dir, "nation", "n_nationkey", body), ("n_nationkey",), False)
    return relations.substituted(rows, "n_nationkey").select("n_nationkey", "text", F.array_join("conditions", ",").alias("conditions"))


# ------------------------------------------------------- accuracy of a corpus


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A class for each nation but those of region 4; it calls the statement of even ones alone."""
    path, text = "concat('/src/java/n', n_regionkey, '/C', n_nationkey, '.java')", "concat('x(); q', CASE WHEN n_nationkey % 2 = 0 THEN CAST(n_nationkey AS STRING) ELSE 'x' END, '(1); s = \"i', n_nationkey * 2, '\";')"
    return table(spark, sf_dir, "nation").filter("n_regionkey <> 4").select(F.expr(path).alias("path"), F.expr(text).alias("text"))


def _corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    body = """CASE n_nationkey % 5 WHEN 3 THEN '<html/>' WHEN 4 THEN concat('<mapper><select id="q', n_nationkey, '">x</select></mapper>')
      ELSE concat('<mapper namespace="n', n_regionkey, '.C', n_nationkey, '"><select id="q', n_nationkey, '">x</select></mapper>') END"""
    docs = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.expr(body).alias("content"))
    rows = written(parsed(docs, columns=("encoding", "dialect", "mapper.namespace", *NEEDS["statements"])), "parsed")
    return docs, relations.documents(rows), relations.statements(rows)


_REASONS = """SELECT CASE WHEN n_nationkey % 5 = 3 THEN 'no_mapper_parsed' WHEN n_nationkey % 5 = 4 THEN 'missing_namespace' WHEN n_regionkey = 4 THEN 'no_matching_interface_file'
    WHEN n_nationkey % 2 = 1 THEN 'unbound_statement' END AS category FROM nation"""


@query(f"SELECT category, count(*) AS n FROM ({_REASONS}) WHERE category IS NOT NULL GROUP BY category")
def failure_buckets_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why statements are not bound, by kind of reason."""
    _, documents, stated = _corpus(spark, sf_dir)
    sources = _sources(spark, sf_dir)
    return accuracy.categories(accuracy.failures(documents, accuracy.bound_by_namespace(stated, documents, sources), sources))


@query(
    """SELECT count(*) AS files_seen, count(*) FILTER (n_nationkey % 5 <> 3) AS parsed_ok, count(*) FILTER (n_nationkey % 5 <> 3) AS n_expected, count(*) FILTER (n_nationkey % 5 <> 3) AS n_found,
      count(*) FILTER (n_nationkey % 5 <> 3) AS n_statements, count(*) FILTER (n_nationkey % 5 < 3 AND n_regionkey <> 4 AND n_nationkey % 2 = 0) AS n_bound,
      100.0 * count(*) FILTER (n_nationkey % 5 <> 3) / count(*) AS parse_success, 100.0::DOUBLE AS statement_recall,
      100.0 * count(*) FILTER (n_nationkey % 5 < 3 AND n_regionkey <> 4 AND n_nationkey % 2 = 0) / count(*) FILTER (n_nationkey % 5 <> 3) AS binding_rate FROM nation"""
)
def accuracy_summary_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, recall and binding of a corpus in per cent."""
    docs, documents, stated = _corpus(spark, sf_dir)
    counted = accuracy.recall(docs, stated).select(F.col("n_expected").cast("long").alias("n_expected"), "n_found")
    return accuracy.summary(documents, counted, accuracy.bound_by_namespace(stated, documents, _sources(spark, sf_dir)))


@query("SELECT 'i' || n_nationkey AS id FROM nation WHERE n_nationkey IN (SELECT n_nationkey * 2 FROM nation WHERE n_regionkey <> 4)")
def bound_by_mention_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements of the older dialect whose id some source has in quotes."""
    body = "concat('<statement id=\"i', n_nationkey, '\">x</statement>')"
    s = relations.statements(templated(spark, sf_dir, "nation", "n_nationkey", body, "sqlMap", NEEDS["statements"]), ("n_nationkey",))
    return accuracy.bound_by_mention(s, _sources(spark, sf_dir))
