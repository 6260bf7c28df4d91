"""Documents to parsed rows: one Arrow pass over the corpus, no shuffle."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from quillmap.operators import mapper
from quillmap.sources.results_json import dumps

from .schema import JSON_RESULT, RESULT, has, pruned

#: Documents, and bytes of documents, whose results are handed back at once. A
#: document's variants repeat its text up to 32 times, with marks beside it.
BATCH, BATCH_BYTES = 256, 1 << 20
COLUMNS = ("dialect", "encoding", "mapper", "diagnostics")


def _bytes(content: Column, type_name: str) -> Column:
    return content if type_name == "binary" else content.cast("binary")


def prepared(docs: DataFrame, content: str, carry: tuple[str, ...]) -> DataFrame:
    """Carried columns, content and size; content over the limit stays in the JVM."""
    kind = dict(docs.dtypes)[content]
    if kind not in ("binary", "string"):
        raise TypeError(f"content must be binary or string, not {kind}")
    body, size = _bytes(F.col(content), kind), F.octet_length(F.col(content))
    return docs.select(*carry, F.when(size <= mapper.MOST_BYTES, body).alias("__content"), size.alias("__size"))


def groups(batch: pa.RecordBatch, sizes: list[int | None]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch: so many rows or bytes, or one row that has more."""
    at = held = 0
    for k, size in enumerate(sizes):
        size = min(size or 0, mapper.MOST_BYTES)
        if k > at and (k - at == BATCH or held + size > BATCH_BYTES):
            yield batch.slice(at, k - at)
            at, held = k, 0
        held += size
    if at < batch.num_rows:
        yield batch.slice(at)


def _results(docs: DataFrame, content: str, carry: tuple[str, ...], schema: StructType, marks: bool, told: Callable[[list[dict]], list[pa.Array]]) -> DataFrame:
    """Carried columns and what ``told`` makes of the results."""
    rows = prepared(docs, content, carry)
    text = dict(docs.dtypes)[content] == "string"

    def result(data: bytes | None, size: int | None) -> dict:
        if data is None and size:
            return mapper.oversize(size, "UTF-8" if text else None)
        return mapper.parse_utf8(data or b"", marks) if text else mapper.parse_bytes(data or b"", marks)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in groups(whole, whole.column(len(carry) + 1).to_pylist()):
                pairs = zip(batch.column(len(carry)).to_pylist(), batch.column(len(carry) + 1).to_pylist(), strict=True)
                with mapper.uncollected():
                    made = told([result(*p) for p in pairs])
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], *made], names=schema.names)

    return rows.mapInArrow(parse, schema)


def _headed(docs: DataFrame, carry: tuple[str, ...], ddl: str) -> StructType:
    kinds = dict(docs.dtypes)
    head = [f"`{c}` {kinds[c]}" for c in carry]
    return StructType.fromDDL(", ".join([*head, ddl]))


def parsed(docs: DataFrame, content: str = "content", carry: tuple[str, ...] = ("doc_id",), columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """(carried columns, dialect, encoding, mapper, diagnostics) of every document.

    The optimizer cannot see into the parse, so what is not asked for in
    ``columns`` is left out here: it is not turned into Arrow data, and marks
    back to the source are not made. A column may be a path to what is wanted
    of it (``mapper.statements.id.value``); relations say what they need.
    Binary content goes through encoding detection; a string is decoded
    already. Null content is an empty document. Rows in, rows out: order and
    repeats of the input do not matter and other columns are not read.
    """
    whole = _headed(docs, carry, RESULT)
    kind = pruned(StructType(whole.fields[len(carry) :]), [tuple(c.split(".")) for c in columns])
    kinds = [to_arrow_type(f.dataType) for f in kind]
    told = lambda results: [pa.array([r[f.name] for r in results], k) for f, k in zip(kind, kinds, strict=True)]
    return _results(docs, content, carry, StructType([*whole.fields[: len(carry)], *kind.fields]), has(kind, "span_map"), told)


def parsed_json(docs: DataFrame, content: str = "content", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, json): results in the published v1 form, straight from the parse."""
    return _results(docs, content, carry, _headed(docs, carry, "json STRING"), True, lambda results: [pa.array(map(dumps, results), pa.string())])


def detected(docs: DataFrame, content: str = "content", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, dialect): reads each document up to its root alone."""
    rows = prepared(docs, content, carry)
    text = dict(docs.dtypes)[content] == "string"

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for data, size in zip(batch.column(len(carry)).to_pylist(), batch.column(len(carry) + 1).to_pylist(), strict=True):
                too_big = data is None and size
                found.append("unknown" if too_big else mapper.dialect_utf8(data or b"") if text else mapper.detect_dialect(data or b""))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(found, pa.string())], names=[*carry, "dialect"])

    return rows.mapInArrow(detect, _headed(docs, carry, "dialect STRING"))


def as_json(parsed_rows: DataFrame, carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(carried columns, json): parsed rows, as from a table of them, in the published v1 form."""
    rows = parsed_rows.select(*carry, *COLUMNS)

    def dump(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            results = batch.select(list(COLUMNS)).to_pylist()
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array([dumps(r) for r in results], pa.string())], names=[*carry, "json"])

    return rows.mapInArrow(dump, _headed(parsed_rows, carry, "json STRING"))


def _text(t: Column) -> Column:
    marks = F.transform(t["span_map"], lambda m: F.struct(F.get(m, F.lit(0)).alias("off"), F.get(m, F.lit(1)).alias("raw")))
    return F.struct(t["text"].alias("text"), marks.alias("span_map"))


def _sql(sql: Column) -> Column:
    variants = F.transform(sql["variants"], lambda v: F.struct(_text(v["text"]).alias("text"), v["conditions"].alias("conditions")))
    union = F.when(sql["union"].isNotNull(), F.struct(_text(sql["union"]["text"]).alias("text"), sql["union"]["branch_count"].alias("branch_count")))
    return F.struct(variants.alias("variants"), union.alias("union"))


def _includes(found: Column) -> Column:
    def one(i: Column) -> Column:
        t = i["value"]["target"]  # a word, or an object of one member
        name, ns, id_ = (F.get_json_object(t, p) for p in ("$.local", "$.qualified.ns", "$.qualified.id"))
        kind = F.when(name.isNotNull(), "local").when(id_.isNotNull(), "qualified").otherwise("dynamic")
        aim = F.struct(kind.alias("kind"), ns.alias("ns"), F.coalesce(name, id_).alias("id"))
        return F.struct(F.struct(i["value"]["raw"].alias("raw"), aim.alias("target")).alias("value"), i["span"].alias("span"))

    return F.transform(found, one)


def from_json(rows: DataFrame, column: str = "json", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Parsed rows again from results in the v1 form, by built-in functions alone.

    Diagnostic codes of later versions are read as ``other``, and a form of SQL
    that is not known has neither variants nor union. What is no JSON raises;
    null gives a row of nulls.
    """
    whole = StructType.fromDDL(RESULT)
    owners = {"statements": whole["mapper"].dataType["statements"].dataType.elementType, "fragments": whole["mapper"].dataType["fragments"].dataType.elementType}
    nowhere = F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"))

    def owner(kind: StructType) -> Callable[[Column], Column]:
        made = {"sql": lambda o: _sql(o["sql"]), "includes": lambda o: _includes(o["includes"]), "span": lambda o: F.coalesce(o["span"], nowhere)}
        return lambda o: F.struct(*[(made[n](o) if n in made else o[n]).alias(n) for n in kind.names])

    r = F.col("__r")
    m = r["mapper"]
    parts = [F.transform(m[k], owner(kind)).alias(k) for k, kind in owners.items()]
    again = F.when(m.isNotNull(), F.struct(m["namespace"].alias("namespace"), *parts, m["result_maps"].alias("result_maps")))
    known = lambda c: F.when(c.isin(mapper.CODES), c).otherwise("other")
    notes = F.transform(r["diagnostics"], lambda d: F.struct(known(d["code"]).alias("code"), d["span"].alias("span"), d["message"].alias("message")))
    rows = rows.select(*carry, F.from_json(column, JSON_RESULT, {"mode": "FAILFAST"}).alias("__r"))
    return rows.select(*carry, r["dialect"].alias("dialect"), r["encoding"].alias("encoding"), again.alias("mapper"), notes.alias("diagnostics"))
