"""The parse step and the relations on small corpora."""

import json

import pytest

from quillmap.operators.mapper import MOST_BYTES
from quillmap.plans import accuracy, parsing, relations
from quillmap.sources import corpus
from quillmap.streaming.files import parsed_stream

DOCS = {
    "a.xml": '<mapper namespace="n.A"><sql id="f">F</sql><select id="q">S <include refid="f"/><if test="t"> #{p}</if></select><select id="q">T</select></mapper>',
    "b/b.xml": '<sqlMap><statement id="n.A.q"><include refid="f"/></statement><resultMap id="m" class="C"><result column="c" property="p"/></resultMap></sqlMap>',
    "b/c.xml": "<html/>",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    for name, text in DOCS.items():
        (top / name).parent.mkdir(exist_ok=True)
        (top / name).write_text(text)
    (top / "n").mkdir()
    (top / "n" / "A.java").write_text('class A {\n  // q(1)\n  void x() { q(2); q(3); }\n  String s = "n.A.q"; }\n')
    return str(top)


@pytest.fixture(scope="module")
def rows(spark, folder):
    return parsing.parsed(corpus.files(spark, folder)).cache()


def test_files_and_documents(rows):
    got = {r["doc_id"].rsplit("/", 1)[1]: (r["dialect"], r["has_mapper"], r["namespace"]) for r in relations.documents(rows).collect()}
    assert got == {"a.xml": ("mybatis", True, "n.A"), "b.xml": ("ibatis", True, None), "c.xml": ("unknown", False, None)}


def test_relations(rows):
    s = relations.statements(rows)
    assert s.count() == 3 and s.filter("sql_kind = 'variants'").count() == 3
    assert [r["id"] for r in relations.duplicate_ids(s).collect()] == ["q"]
    assert relations.missing_ids(s).count() == 0
    v = relations.variants(rows)
    assert sorted(r["text"] for r in v.filter("owner = 'statement'").collect()) == ["/* batis:include(f) */", "S /* batis:include(f) */", "S /* batis:include(f) */ ?", "T"]
    assert sorted(r["text"] for r in relations.substituted(v).collect()) == ["/* batis:include(f) */", "S F", "S F ?", "T"]
    i = relations.includes(rows)
    assert i.count() == 2 and relations.dangling_includes(i, relations.fragments(rows)).count() == 1
    assert relations.dangling_includes(i, relations.fragments(rows), ()).count() == 0  # one corpus, one name space
    assert [(r["path"],) for r in relations.property_paths(rows).collect()] == [("p",)]
    assert [(r["map_id"], r["column"], r["property"]) for r in relations.column_mappings(rows).collect()] == [("m", "c", "p")]
    assert [r["code"] for r in relations.diagnostics(rows).orderBy("code").collect()] == ["duplicate_statement_id", "unknown_element"]
    assert sorted(r["qualified"] for r in relations.qualified_names(rows).collect()) == ["n.A.q", "n.A.q", "n.A.q"]


def test_accuracy(spark, folder, rows):
    java = corpus.java_sources(spark, folder)
    s = relations.statements(rows)
    bound = accuracy.bound_by_namespace(s, relations.documents(rows), java.selectExpr("'/java/n/A.java' AS path", "text"))
    assert sorted(r["bound"] for r in bound.collect()) == [False, True, True]
    assert [r["id"] for r in accuracy.bound_by_mention(s, java).collect()] == ["n.A.q"]
    assert [tuple(r) for r in accuracy.callers(java, s).collect()] == [("q", 1, 1)]
    docs = corpus.files(spark, folder)
    assert sorted((r["n_expected"], r["n_found"]) for r in accuracy.recall(docs, s).collect()) == [(0, 0), (1, 1), (2, 2)]


def test_content_of_any_kind(spark):
    data = [(None, None, 1), (1, "", 2), (1, "", 2), (2, "<mapper/>", 3), (3, "x" * (MOST_BYTES + 1), 4)]
    docs = spark.createDataFrame(data, "doc_id long, content string, dialect int")
    got = sorted((str(r["doc_id"]), r["dialect"], r["diagnostics"][0]["code"] if r["diagnostics"] else "") for r in parsing.parsed(docs).collect())
    assert got == [("1", "unknown", "unknown_element")] * 2 + [("2", "mybatis", ""), ("3", "unknown", "oversize_input"), ("None", "unknown", "unknown_element")]
    found = parsing.detected(docs.selectExpr("doc_id", "CAST(content AS BINARY) AS content")).collect()
    assert sorted(r["dialect"] for r in found) == ["mybatis"] + ["unknown"] * 4
    assert parsing.parsed(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        parsing.parsed(docs, "doc_id")


def test_stream_equals_batch(spark, folder, rows):
    q = parsed_stream(spark, folder).writeStream.format("memory").queryName("streamed").start()
    try:
        q.processAllAvailable()
        key = lambda df: sorted((r["doc_id"], r["dialect"], len(r["diagnostics"])) for r in df.collect())
        assert key(spark.table("streamed")) == key(rows)
    finally:
        q.stop()


def test_sql_functions(spark, folder):
    from quillmap.functions import registered

    registered.register(spark)
    corpus.files(spark, folder).createOrReplaceTempView("mapper_files")
    got = spark.sql("SELECT mapper_dialect(content) AS d, get_json_object(mapper_json(content), '$.dialect') AS j, mapper_version() AS v FROM mapper_files").collect()
    assert sorted(r["d"] for r in got) == ["ibatis", "mybatis", "unknown"] and all(r["d"] == r["j"] and r["v"] for r in got)
    rows = spark.sql("SELECT v.id, v.text, v.conditions FROM mapper_files, LATERAL mapper_variants(content) v WHERE v.id = 'q'").collect()
    assert sorted((r["text"], r["conditions"]) for r in rows) == [("S /* batis:include(f) */", []), ("S /* batis:include(f) */ ?", ["t"]), ("T", [])]


def test_a_repeated_id_with_and_without_database(spark):
    data = [(d, o, "a", db) for d in range(3) for o in range(2) for db in (None, "x")] + [(9, 0, None, None)] * 2
    s = spark.createDataFrame(data, "doc_id long, ord int, id string, database_id string")
    assert relations.duplicate_ids(s).count() == 6 and relations.duplicate_ids(s, ()).count() == 10


def test_only_what_is_asked_for_is_made(spark, folder):
    docs = corpus.files(spark, folder)
    some = parsing.parsed(docs, columns=("mapper.statements.id.value", "diagnostics.code"))
    assert some.schema.simpleString() == "struct<doc_id:string,mapper:struct<statements:array<struct<id:struct<value:string>>>>,diagnostics:array<struct<code:string>>>"
    for name, leaves in relations.NEEDS.items():
        rows = parsing.parsed(docs, columns=leaves)
        make = (lambda r: relations.variants(r, marks=False)) if name == "texts" else getattr(relations, name)
        assert make(rows).collect() == make(parsing.parsed(docs)).drop(*([] if name != "texts" else ["span_map"])).collect()
    with pytest.raises(ValueError):
        parsing.parsed(docs, columns=("mapper.nothing",))


def test_json_of_the_parse_equals_json_of_rows(spark, folder, rows):
    docs = corpus.files(spark, folder)
    read = lambda df: {r["doc_id"]: json.loads(r["json"]) for r in df.collect()}
    assert read(parsing.parsed_json(docs)) == read(parsing.as_json(rows))
    again = parsing.from_json(parsing.parsed_json(docs))
    assert again.schema.simpleString() == rows.schema.simpleString()
    assert sorted(map(str, again.collect())) == sorted(map(str, rows.select(*again.columns).collect()))


def test_batches_are_cut_by_rows_and_bytes():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(600))], ["k"])
    assert [g.num_rows for g in parsing.groups(batch, [None, 0] * 300)] == [256, 256, 88]
    sizes = [parsing.BATCH_BYTES // 2, parsing.BATCH_BYTES // 2, 1, 10 * parsing.BATCH_BYTES, 1] + [0] * 595
    assert [g.num_rows for g in parsing.groups(batch, sizes)][:4] == [2, 1, 1, 256]


def test_includes_of_any_shape(spark):
    edges = [(1, "statement", 0, "s", f"f{k}", "local", None, f"f{k}") for k in (0, 1)] + [(1, "fragment", k, f"f{k}", f"f{j}", "local", None, f"f{j}") for k in range(70) for j in (k + 1, k + 2)]
    kind = "doc_id long, owner string, owner_ord int, owner_id string, raw string, target_kind string, target_ns string, target_id string"
    reach = relations.include_closure(spark.createDataFrame(edges + edges, kind)).filter("owner = 'statement'").collect()
    assert {(r["target_id"], r["depth"]) for r in reach} == {(f"f{k}", 1 if k < 2 else (k + 2) // 2 if k % 2 == 0 else (k + 1) // 2) for k in range(72)}
    none = spark.createDataFrame([], kind)
    assert relations.include_closure(none).count() == 0
    assert relations.include_tree(none, spark.createDataFrame([], "doc_id long, id string")).count() == 0


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from quillmap.plans import shared

    assert shared.workspace(spark)

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return {}

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError, match="checkpoint"):
        shared.workspace(Elsewhere)
