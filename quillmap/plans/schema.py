"""Types of a parsed document, as the parse step returns it."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql.types import ArrayType, DataType, StructField, StructType

SPAN = "STRUCT<start:INT,end:INT>"
NAME = f"STRUCT<value:STRING,span:{SPAN}>"
CLASS = f"STRUCT<value:STRUCT<raw:STRING>,span:{SPAN}>"
TEXT = "STRUCT<text:STRING,span_map:ARRAY<STRUCT<off:INT,raw:INT>>>"
SQL = f"STRUCT<variants:ARRAY<STRUCT<text:{TEXT},conditions:ARRAY<STRING>>>,union:STRUCT<text:{TEXT},branch_count:INT>>"
INCLUDES = f"ARRAY<STRUCT<value:STRUCT<raw:STRING,target:STRUCT<kind:STRING,ns:STRING,id:STRING>>,span:{SPAN}>>"
STATEMENT = (
    f"STRUCT<kind:STRING,span:{SPAN},id:{NAME},database_id:{NAME},sql:{SQL},includes:{INCLUDES},param_class:{CLASS},"
    f"result_class:{CLASS},result_map_ref:{NAME},property_paths:ARRAY<{NAME}>>"
)
FRAGMENT = f"STRUCT<span:{SPAN},id:{NAME},sql:{SQL},includes:{INCLUDES}>"
RESULT_MAP = f"STRUCT<span:{SPAN},id:{NAME},type_ref:{CLASS},extends:{NAME},mappings:ARRAY<STRUCT<column:STRING,property:STRING>>>"
MAPPER = f"STRUCT<namespace:{NAME},statements:ARRAY<{STATEMENT}>,fragments:ARRAY<{FRAGMENT}>,result_maps:ARRAY<{RESULT_MAP}>>"
DIAGNOSTICS = f"ARRAY<STRUCT<code:STRING,span:{SPAN},message:STRING>>"
RESULT = f"dialect STRING, encoding STRING, mapper {MAPPER}, diagnostics {DIAGNOSTICS}"

#: The published JSON form: marks are pairs, and a target is a word or an object.
JSON_RESULT = RESULT.replace("STRUCT<off:INT,raw:INT>", "ARRAY<INT>").replace("target:STRUCT<kind:STRING,ns:STRING,id:STRING>", "target:STRING")


def pruned(kind: DataType, leaves: Iterable[tuple[str, ...]]) -> DataType:
    """A type with only the fields that the paths name or lead to; a path names all below it."""
    leaves = list(leaves)
    if () in leaves:
        return kind
    if isinstance(kind, ArrayType):
        return ArrayType(pruned(kind.elementType, leaves), kind.containsNull)
    if not isinstance(kind, StructType):
        raise ValueError(f"no field below a {kind.simpleString()}: {leaves}")
    unknown = {x[0] for x in leaves} - set(kind.names)
    if unknown:
        raise ValueError(f"no such field: {sorted(unknown)}")
    return StructType([StructField(f.name, pruned(f.dataType, below), f.nullable) for f in kind if (below := [x[1:] for x in leaves if x[0] == f.name])])


def has(kind: DataType, name: str) -> bool:
    """Whether a field of that name is anywhere in a type."""
    if isinstance(kind, ArrayType):
        return has(kind.elementType, name)
    return isinstance(kind, StructType) and any(f.name == name or has(f.dataType, name) for f in kind)
