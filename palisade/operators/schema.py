"""Requests against an OpenAPI document or a GraphQL schema: violations as detections.

A schema is read once, on the driver, into a literal that the plan holds: requests are
matched against it row by row, without a shuffle. Bodies are not checked against JSON
schemas, and responses not at all."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from palisade.functions.binding import let
from palisade.model import DETECTIONS, detection, only
from palisade.operators import graphql_schema

# Rule id, name and base score of each violation, by its key in the configuration.
VIOLATIONS = {
    "unknown-path": (98300, "Schema: Unknown path", 6),
    "unknown-method": (98301, "Schema: Unknown method", 5),
    "missing-required-parameter": (98302, "Schema: Missing required parameter", 4),
    "invalid-parameter-type": (98303, "Schema: Invalid parameter type", 5),
    "invalid-parameter-format": (98304, "Schema: Invalid parameter format", 4),
    "invalid-request-body": (98305, "Schema: Invalid request body", 7),
    "invalid-content-type": (98306, "Schema: Invalid content type", 3),
    "unknown-response-status": (98307, "Schema: Unknown response status", 2),
    "invalid-response-body": (98308, "Schema: Invalid response body", 3),
    "unknown-type": (98350, "GraphQL: Unknown type", 5),
    "unknown-field": (98351, "GraphQL: Unknown field", 6),
    "invalid-argument": (98352, "GraphQL: Invalid argument", 5),
    "missing-required-argument": (98353, "GraphQL: Missing required argument", 4),
    "invalid-argument-type": (98354, "GraphQL: Invalid argument type", 4),
    "unauthorized-field-access": (98355, "GraphQL: Unauthorized field access", 8),
    "deprecated-field-usage": (98356, "GraphQL: Deprecated field usage", 2),
}
METHODS = ("get", "post", "put", "delete", "patch", "head", "options", "trace")
NUMBER = r"(?i)^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?|inf|infinity|nan)\z"
TEMPLATES = (
    "array<struct<names:array<string>,operations:array<struct<method:string,has_schema:boolean,"
    "parameters:array<struct<location:string,name:string,required:boolean,type:string>>>>>>"
)
#: The trie of templates: edges of fixed segments in buckets by hash, and of each node the child
#: behind a parameter and the template that ends there.
EDGES, NODES = "array<array<struct<key:string,child:int>>>", "array<struct<parameter:int,template:int>>"


def _violation(kind: str, location, actual) -> Column:
    rule_id, name, base = VIOLATIONS[kind]
    shown = F.left(actual, F.lit(100)) if isinstance(actual, Column) else actual
    return detection(rule_id, name, "ProtocolAttack", shown, location, base, ("schema", kind))


def valid_json(text: Column) -> Column:
    """Whether text is one JSON value: parsing stops at its end, so that brackets around it show what follows."""
    within = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.try_parse_json(text).isNotNull() & within.isNotNull() & F.try_variant_get(within, "$[1]", "variant").isNull()


def _parameter(given: Mapping) -> dict | None:
    if "$ref" in given:
        return None
    kind = given.get("schema", {}).get("type")
    return {"location": given["in"], "name": given["name"], "required": bool(given.get("required")), "type": kind}


def _operation(method: str, item: Mapping) -> dict:
    operation = item[method]
    content = operation.get("requestBody", {}).get("content", {}).get("application/json", {})
    given = map(_parameter, [*item.get("parameters", ()), *operation.get("parameters", ())])
    return {"method": method.upper(), "has_schema": "$ref" in content.get("schema", {}), "parameters": [p for p in given if p]}


def compile_openapi(document: str | Mapping) -> list[dict]:
    """The path templates of an OpenAPI document in JSON, those with fixed segments before those
    with parameters at the first place where they differ. Of templates that differ in
    the names of their parameters alone the last gives the operations; a parameter is
    called what the first template with the segments before it calls it."""
    document = json.loads(document) if isinstance(document, str) else document
    found: dict[tuple, list[dict]] = {}
    names: dict[tuple, str] = {}
    for template, item in document.get("paths", {}).items():
        if "$ref" in item:
            raise ValueError(f"references of path items are not supported: {template}")
        operations = [_operation(m, item) for m in METHODS if m in item]
        if not operations:
            continue
        segments: tuple = ()
        for part in filter(None, template.split("/")):
            is_parameter = part.startswith("{") and part.endswith("}")
            segments += (None if is_parameter else part,)
            if is_parameter:
                names.setdefault(segments, part[1:-1])
        found[segments] = operations
    ordered = sorted(found, key=lambda s: [(part is None, part or "") for part in s])
    return [{"segments": list(s), "names": [names.get(s[: k + 1]) if s[k] is None else None for k in range(len(s))], "operations": found[s]} for s in ordered]


def path_trie(schema: list[dict]) -> tuple[list[list[dict]], list[dict]]:
    """(EDGES, NODES) of templates. An edge's bucket is the hash of "node/segment", so that a look-up
    takes as long in a large document as in a small one."""
    nodes: list[dict] = [{}]
    fixed: dict[str, int] = {}
    for number, template in enumerate(schema):
        at = 0
        for segment in template["segments"]:
            known, key = (nodes[at], "parameter") if segment is None else (fixed, f"{at}/{segment}")
            if key not in known:
                known[key] = len(nodes)
                nodes.append({})
            at = known[key]
        nodes[at]["template"] = number
    buckets: list[list[dict]] = [[] for _ in range(1 << (2 * len(fixed)).bit_length())]
    for key, child in fixed.items():
        buckets[zlib.crc32(key.encode()) % len(buckets)].append({"key": key, "child": child})
    return buckets, nodes


def fitting(schema: list[dict], segments: Column) -> Column:
    """The templates (TEMPLATES) that a path's segments fit, in the order in which they are tried: at each
    segment the fixed one before the parameter. One step a segment, from all nodes that the path has reached."""
    buckets, nodes = path_trie(schema)
    literal = lambda value, kind: F.from_json(F.lit(json.dumps(value)), kind)
    edges, known, templates = literal(buckets, EDGES), literal(nodes, NODES), literal([{k: t[k] for k in ("names", "operations")} for t in schema], TEMPLATES)

    def child(key: Column) -> Column:
        bucket = F.get(edges, (F.crc32(key.cast("binary")) % len(buckets)).cast("int"))
        return F.get(F.filter(bucket, lambda e: e["key"] == key), 0)["child"]

    def step(reached: Column, segment: Column) -> Column:
        fixed = lambda n: let(lambda b: child(b["key"]), key=F.concat_ws("/", n.cast("string"), segment))
        return F.flatten(F.transform(reached, lambda n: F.array_compact(F.array(fixed(n), F.get(known, n)["parameter"]))))

    ends = lambda reached: F.array_compact(F.transform(reached, lambda n: F.get(known, n)["template"]))
    numbers = F.aggregate(segments, F.array(F.lit(0)), step, ends)
    return F.coalesce(F.transform(numbers, lambda i: F.get(templates, i)), F.expr(f"cast(array() as {TEMPLATES})"))


def openapi_violations(schema: list[dict], path: Column, method: Column, query: Column, headers: Column, content_type: Column, body: Column) -> Column:
    """array<detection>; query and headers map a name to its values, header names in lower case."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")

    def checked(b: Column) -> Column:
        # The first template that has the method: one with a fixed segment may lack it.
        able = F.flatten(F.transform(b["fit"], lambda t: F.transform(F.filter(t["operations"], lambda o: o["method"] == b["method"]), lambda o: F.struct(o.alias("o"), t["names"].alias("names")))))
        allowed = F.array_join(F.array_sort(F.transform(F.get(b["fit"], 0)["operations"], lambda o: o["method"])), ", ")
        unknown = F.when(F.size(b["fit"]) == 0, _violation("unknown-path", "path", path)).when(F.size(able) == 0, _violation("unknown-method", "method", F.concat(b["method"], F.lit("; allowed: "), allowed)))
        operation = F.get(able, 0)

        def of_parameter(p: Column) -> Column:
            place = F.array_position(operation["names"], p["name"]).cast("int")
            value = (
                F.when(p["location"] == "query", F.get(F.try_element_at(query, p["name"]), 0))
                .when(p["location"] == "path", F.when(place > 0, F.get(b["segments"], place - 1)))
                .when(p["location"] == "header", F.get(F.try_element_at(headers, F.lower(p["name"])), 0))
            )
            whole = value.rlike(r"^[+-]?[0-9]+\z") & value.try_cast("bigint").isNotNull()
            wrong = ((p["type"] == "integer") & ~whole) | ((p["type"] == "number") & ~value.rlike(NUMBER)) | ((p["type"] == "boolean") & ~value.isin("true", "false"))
            at = F.concat_ws(".", p["location"], p["name"])
            return F.when(value.isNull(), F.when(p["required"], _violation("missing-required-parameter", at, "missing"))).when(wrong, _violation("invalid-parameter-type", at, value))

        is_json = F.coalesce(F.contains(content_type, F.lit("application/json")), F.lit(False))
        of_body = F.when(F.coalesce(body, F.lit("")) == "", F.lit(None)).when(
            ~is_json, F.when(operation["o"]["has_schema"], _violation("invalid-content-type", "header.content-type", F.coalesce(content_type, F.lit("none"))))
        ).when(~valid_json(body), _violation("invalid-request-body", "body", "parse error"))
        rest = F.concat(F.array_compact(F.transform(operation["o"]["parameters"], of_parameter)), only(of_body))
        return F.when(unknown.isNotNull(), F.array(unknown)).otherwise(rest)

    located = lambda b: let(checked, segments=b["segments"], fit=fitting(schema, b["segments"]), method=F.upper(method))
    return F.coalesce(let(located, segments=segments), F.expr(f"cast(array() as {DETECTIONS})"))


def is_graphql(path: Column, content_type: Column, body: Column) -> Column:
    """Unlike the inspection of traffic without a schema, by any place in the path, or by the body."""
    low = F.lower(path)
    tests = (
        F.contains(low, F.lit("/graphql")), F.endswith(low, F.lit("/gql")), F.contains(content_type, F.lit("application/graphql")),
        F.contains(body, F.lit('"query"')), F.contains(body, F.lit('"mutation"')),
    )
    return reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests])


def graphql_violations(schema: str, body: Column) -> Column:
    """array<detection> of a body: a query, or JSON with one as "query"."""
    types = graphql_schema.compile_schema(schema)

    @F.arrow_udf("array<struct<kind:string,location:string,actual:string>>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        violations = graphql_schema.validator(types)
        for bodies in batches:
            rows = [violations(b) for b in bodies.to_pylist()]
            fields = zip(*[x for row in rows for x in row]) if any(rows) else ([], [], [])
            flat = pa.StructArray.from_arrays([pa.array(f, pa.string()) for f in fields], ["kind", "location", "actual"])
            yield pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), flat)

    made = lambda x: F.coalesce(*[F.when(x["kind"] == kind, _violation(kind, x["location"], x["actual"])) for kind in VIOLATIONS if VIOLATIONS[kind][0] >= 98350])
    return F.transform(found(body), made)


def enforced(detections: Column, overrides: Mapping[str, str], default: str = "warn") -> Column:
    """Detections less those whose mode is ignore; block and warn leave a detection as it is."""
    ignored = [VIOLATIONS[kind][0] for kind in VIOLATIONS if overrides.get(kind, default) == "ignore"]
    return F.filter(detections, lambda d: ~d["rule_id"].isin(ignored)) if ignored else detections
