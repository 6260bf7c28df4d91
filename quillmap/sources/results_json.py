"""Results as JSON documents of the published v1 form, and back."""

from __future__ import annotations

import json


def _target_out(t: dict):
    if t["kind"] == "dynamic":
        return "dynamic"
    return {"local": t["id"]} if t["kind"] == "local" else {"qualified": {"ns": t["ns"], "id": t["id"]}}


def _target_in(t) -> dict:
    if t == "dynamic":
        return {"kind": "dynamic", "ns": None, "id": None}
    if "local" in t:
        return {"kind": "local", "ns": None, "id": t["local"]}
    return {"kind": "qualified", "ns": t["qualified"]["ns"], "id": t["qualified"]["id"]}


def _text_out(t: dict) -> dict:
    return {"text": t["text"], "span_map": [[m["off"], m["raw"]] for m in t["span_map"]]}


def _text_in(t: dict) -> dict:
    return {"text": t["text"], "span_map": [{"off": a, "raw": b} for a, b in t["span_map"]]}


def _sql_out(sql: dict) -> dict:
    if sql["union"] is not None:
        return {"union": {"text": _text_out(sql["union"]["text"]), "branch_count": sql["union"]["branch_count"]}}
    if sql["variants"] is None:
        return {"unrecognized": None}
    return {"variants": [{"text": _text_out(v["text"]), "conditions": v["conditions"]} for v in sql["variants"]]}


def _sql_in(sql: dict) -> dict:
    """A single unknown key is a form of later versions: neither member is set."""
    if len(sql) != 1:
        raise ValueError("sql must have exactly one key")
    out = {"variants": None, "union": None}
    if "variants" in sql:
        out["variants"] = [{"text": _text_in(v["text"]), "conditions": v["conditions"]} for v in sql["variants"]]
    elif "union" in sql:
        out["union"] = {"text": _text_in(sql["union"]["text"]), "branch_count": sql["union"]["branch_count"]}
    return out


def _owner(o: dict, sql, target) -> dict:
    includes = [{"value": {"raw": i["value"]["raw"], "target": target(i["value"]["target"])}, "span": i["span"]} for i in o["includes"]]
    return {"span": {"start": 0, "end": 0}} | o | {"sql": sql(o["sql"]), "includes": includes}


def _converted(result: dict, sql, target, code) -> dict:
    mapper = result["mapper"]
    if mapper is not None:
        mapper = mapper | {k: [_owner(o, sql, target) for o in mapper[k]] for k in ("statements", "fragments")}
    return result | {"mapper": mapper, "diagnostics": [d | {"code": code(d["code"])} for d in result["diagnostics"]]}


def to_document(result: dict) -> dict:
    return _converted(result, _sql_out, _target_out, str)


def from_document(document: dict) -> dict:
    """Diagnostic codes of later versions are read as ``other``."""
    from quillmap.operators.mapper import CODES

    return _converted(document, _sql_in, _target_in, lambda c: c if c in CODES else "other")


def dumps(result: dict) -> str:
    return json.dumps(to_document(result), ensure_ascii=False)


def loads(text: str) -> dict:
    return from_document(json.loads(text))
