"""Chat formatting with tool-call linking.

Messages are rows (conversation, turn, role, text).  An assistant's text that is a JSON object with `tool_calls`
([{"id", "name", "arguments"}], also with the name and arguments under "function") makes calls; a message of role `tool` whose text is a
JSON object with `tool_call_id` is a result; a system message whose text is a JSON object with `tools`
([{"name", "parameters"}], also under "function", and with "input_schema") defines the tools of its conversation.  Results are hash-joined with calls on (conversation, id).  Each message gets
a key that sorts a conversation topologically: messages stand by turn, and a result behind the call that it answers even where its
turn is smaller.  Calls are hash-joined with definitions on (conversation, name) in the same join, their arguments validated against the JSON schemas, and each message is
serialised as canonical JSON: keys sorted by code point, no spaces, UTF-8.

A conversation is never gathered: its order is a key, by which any writer can sort it.
"""

from __future__ import annotations

import functools
import json
import re
from fractions import Fraction
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import cut, table

CALLS = "array<struct<id:string,name:string,arguments:string>>"
PARSED = f"conv_id bigint, turn bigint, role string, text string, calls {CALLS}, answers string, content string, defined array<struct<name:string,schema:string>>"
#: What messages are joined by: the id of a call, the name of a tool, and that a conversation defines tools at all.
ID, TOOL, ANY = range(3)


#: JSON that is nested deeper is not read: RFC 8259 lets readers set such a limit.
DEEPEST = 100
_SURROGATES = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """Canonical JSON: keys by code point, no spaces, a whole float as an integer, NaN and infinities as null, a surrogate without its other half as U+FFFD."""
    return _valid(json.dumps(_plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":")))


def _valid(text: str) -> str:
    return _SURROGATES.sub("\ufffd", text)


def _plain(v):
    if isinstance(v, dict):
        return {str(k): _plain(x) for k, x in v.items()}
    if isinstance(v, list):
        return [_plain(x) for x in v]
    if isinstance(v, float):
        return None if v != v or v in (float("inf"), float("-inf")) else int(v) if v.is_integer() and abs(v) < 2**53 else v
    return v


def _refuse(name: str):
    raise ValueError(f"{name} is not JSON")


def read_json(text: str):
    """The value of a JSON text; ValueError if it isn't JSON, says NaN or Infinity, or is nested deeper than DEEPEST."""
    try:
        value = json.loads(text, parse_constant=_refuse)
    except RecursionError:
        raise ValueError("too deep") from None
    level, todo = 0, [value]
    while todo and text.count("[") + text.count("{") > DEEPEST:
        todo = [x for v in todo if isinstance(v, dict | list) for x in (v.values() if isinstance(v, dict) else v)]
        level += 1
        if level > DEEPEST + 1:
            raise ValueError("too deep")
    return value


_TYPES = {
    "object": lambda v: isinstance(v, dict),
    "array": lambda v: isinstance(v, list),
    "string": lambda v: isinstance(v, str),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
    "number": lambda v: isinstance(v, int | float) and not isinstance(v, bool),
    "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None,
}
_BOUNDS = {
    "minimum": lambda v, b: v >= b,
    "maximum": lambda v, b: v <= b,
    "exclusiveMinimum": lambda v, b: v > b,
    "exclusiveMaximum": lambda v, b: v < b,
    "multipleOf": lambda v, b: Fraction(str(v)) % Fraction(str(b)) == 0,
}
_SIZES = {str: ("minLength", "maxLength"), list: ("minItems", "maxItems"), dict: ("minProperties", "maxProperties")}


def _same(a, b) -> bool:
    """Equal JSON values: 1 and 1.0 are, 1 and true aren't."""
    return canonical(a) == canonical(b)


def _target(root, ref: str):
    """What a reference inside the schema points to."""
    if not ref.startswith("#"):
        raise ValueError(f"no schema {ref}")
    at = root
    for step in ref[1:].split("/")[1:]:
        step = unquote(step).replace("~1", "/").replace("~0", "~")
        at = at[int(step)] if isinstance(at, list) else at[step]
    return at


def violations(value, schema: dict | bool, path: str = "$", root=None) -> list[str]:
    """What a value breaks of a JSON schema.

    Read are type, enum, const, bounds, lengths, pattern, items, prefixItems, contains, uniqueItems, properties, patternProperties, additionalProperties, propertyNames, required,
    dependentRequired, allOf, anyOf, oneOf, not, if, and $ref inside the schema.  Others have no effect.  A schema that can't be used raises an error.
    """
    root = schema if root is None else root
    if isinstance(schema, bool):
        return [] if schema else [f"{path}: not allowed"]
    check = lambda v, part, at=path: violations(v, part, at, root)
    out = check(value, _target(root, schema["$ref"])) if "$ref" in schema else []
    kinds = schema.get("type")
    if kinds is not None:
        kinds = kinds if isinstance(kinds, list) else [kinds]
        if not any(_TYPES[k](value) for k in kinds if k in _TYPES):
            return [*out, f"{path}: not {' or '.join(kinds)}"]
    if "enum" in schema and not any(_same(value, x) for x in schema["enum"]):
        out.append(f"{path}: not in enum")
    if "const" in schema and not _same(value, schema["const"]):
        out.append(f"{path}: not the constant")
    if _TYPES["number"](value):
        out += [f"{path}: {key} {schema[key]}" for key, holds in _BOUNDS.items() if key in schema and not holds(value, schema[key])]
    for key, low in zip(_SIZES.get(type(value), ()), (True, False), strict=False):
        if key in schema and (len(value) < schema[key] if low else len(value) > schema[key]):
            out.append(f"{path}: {key} {schema[key]}")
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        out.append(f"{path}: pattern")
    if isinstance(value, list):
        out += _list_violations(value, schema, path, check)
    if isinstance(value, dict):
        out += _object_violations(value, schema, path, check)
    for part in schema.get("allOf", []):
        out += check(value, part)
    for key, fits in (("anyOf", lambda n: n >= 1), ("oneOf", lambda n: n == 1)):
        if key in schema and not fits(sum(not check(value, part) for part in schema[key])):
            out.append(f"{path}: {key}")
    if "not" in schema and not check(value, schema["not"]):
        out.append(f"{path}: not")
    if "if" in schema:
        out += check(value, schema.get("else" if check(value, schema["if"]) else "then", True))
    return out


def _list_violations(value: list, schema: dict, path: str, check) -> list[str]:
    first = schema.get("prefixItems", [])
    out = [w for k, (x, part) in enumerate(zip(value, first, strict=False)) for w in check(x, part, f"{path}[{k}]")]
    if "items" in schema:
        out += [w for k, x in enumerate(value[len(first) :], len(first)) for w in check(x, schema["items"], f"{path}[{k}]")]
    if "contains" in schema:
        n = sum(not check(x, schema["contains"]) for x in value)
        if not schema.get("minContains", 1) <= n <= schema.get("maxContains", len(value)):
            out.append(f"{path}: contains")
    if schema.get("uniqueItems") and len({canonical(x) for x in value}) < len(value):
        out.append(f"{path}: items repeat")
    return out


def _object_violations(value: dict, schema: dict, path: str, check) -> list[str]:
    known, patterns, more = schema.get("properties", {}), schema.get("patternProperties", {}), schema.get("additionalProperties", True)
    out = [f"{path}.{k}: missing" for k in schema.get("required", []) if k not in value]
    out += [f"{path}.{k}: missing" for given, ks in schema.get("dependentRequired", {}).items() if given in value for k in ks if k not in value]
    for k, x in value.items():
        at = f"{path}.{k}"
        parts = [known[k]] if k in known else []
        parts += [part for p, part in patterns.items() if re.search(p, k)]
        if "propertyNames" in schema:
            out += check(k, schema["propertyNames"], at)
        if parts or more is not False:
            for part in parts or [more]:
                out += check(x, part, at)
        else:
            out.append(f"{at}: unknown")
    return out


def _object(text: str | None) -> dict | None:
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        v = read_json(text)
    except ValueError:
        return None
    return v if isinstance(v, dict) else None


def _name(v) -> str | None:
    """An id or a name as text."""
    return None if v is None else _valid(v if isinstance(v, str) else canonical(v))


def _calls(v: dict | None) -> list[dict]:
    """The calls that an assistant's object makes."""
    out = []
    for c in v["tool_calls"] if v and isinstance(v.get("tool_calls"), list) else []:
        if isinstance(c, dict):
            f = c["function"] if isinstance(c.get("function"), dict) else c
            args = f.get("arguments")
            out.append({"id": _name(c.get("id")), "name": _name(f.get("name")), "arguments": _name(args)})
    return out


def _tools(v: dict | None) -> list[dict] | None:
    """Names and schemas (as JSON) that a system message's object defines; None if it has no list of tools."""
    if not v or not isinstance(v.get("tools"), list):
        return None
    out = []
    for d in v["tools"]:
        f = d["function"] if isinstance(d, dict) and isinstance(d.get("function"), dict) else d
        if isinstance(f, dict) and f.get("name") is not None:
            schema = next((f[k] for k in ("parameters", "input_schema") if f.get(k) is not None), True)
            out.append({"name": _name(f["name"]), "schema": json.dumps(schema)})
    return out


@functools.lru_cache(1000)
def _schema(made: str):
    return json.loads(made)


def _check(call: dict, schemas: dict[str, dict], own: str | None, closed: bool) -> list[str]:
    """What a call breaks; `own` is its conversation's schema of the tool, and `closed` tells that the conversation defines tools."""
    try:
        args = read_json(call["arguments"] or "{}")
    except ValueError:
        return ["$: not JSON"]
    if own is None and call["name"] not in schemas:
        return ["no such tool"] if schemas or closed else []
    try:
        return violations(args, schemas[call["name"]] if own is None else _schema(own))
    except Exception:  # definitions come with the data: any value can stand where a keyword wants another
        return ["$: schema can't be used"]


def format_chat(messages: DataFrame, schemas: dict[str, dict] | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row a message: conv_id, turn, order_key, role, n_calls, n_invalid, links (of a result: the call's turn and place), status, message.

    `message` is canonical JSON of role, content and, where there are any, tool_calls (arguments as JSON values, with what they violate) or
    tool_call_id.  status is 'ok', 'invalid_arguments', 'duplicate_id' (a call whose id an earlier call of the conversation has), or 'orphan' (a result without a call).
    A result belongs to the first call of its id.  A call's schema is the first definition of its tool in its conversation, else that of `schemas`.  Where there
    are definitions or `schemas` but not of its tool, it calls no such tool; where there are none at all, arguments are only checked to be JSON.
    Null texts have null content; a null role stays null; rows without conversation or turn are formatted but link with nothing.  Repeated rows are
    formatted each, and a repeated call counts as a duplicate of itself only if its turn differs.  JSON that is nested deeper than DEEPEST is not read: such a message is plain
    content, such arguments are not JSON.  Very long texts are kept whole.  Other columns are left out.  An empty table gives an empty table.
    """
    schemas = schemas or {}
    own = messages.select(F.col(conv_id).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))

    def parse(batches):
        for batch in batches:
            roles = batch.column("role").to_pylist()
            objects = [_object(t) if r in ("assistant", "tool", "system") else None for r, t in zip(roles, batch.column("text").to_pylist(), strict=True)]
            calls = [_calls(v) if r == "assistant" else [] for r, v in zip(roles, objects, strict=True)]
            answers = [_name((v or {}).get("tool_call_id")) if r == "tool" else None for r, v in zip(roles, objects, strict=True)]
            content = [None if v is None or not (made or answered is not None) else canonical(v.get("content")) for v, made, answered in zip(objects, calls, answers, strict=True)]
            defined = [_tools(v) if r == "system" else None for r, v in zip(roles, objects, strict=True)]
            more = [pa.array(x, arrow.field(c).type) for c, x in (("calls", calls), ("answers", answers), ("content", content), ("defined", defined))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], schema=arrow)

    arrow = to_arrow_schema(T._parse_datatype_string(PARSED))
    # only messages that look like an object can make calls, answer them or define tools; they are read once and written
    told = F.coalesce(F.col("role").isin("assistant", "tool", "system") & F.col("text").rlike(r"^[ \t\r\n]*\{"), F.lit(False))
    parsed = cut(own.where(told).mapInArrow(parse, PARSED).withColumn("row", F.monotonically_increasing_id()))
    others = own.where(~told).select("*", F.array().cast(CALLS).alias("calls"), *[F.lit(None).cast("string").alias(c) for c in ("answers", "content")])
    nothing = F.lit(None).cast("string").alias("schema")
    posted = F.when(
        F.col("defined").isNotNull(),
        F.concat(F.transform("defined", lambda d, k: F.struct(k.alias("k"), F.lit(TOOL).alias("kind"), d["name"].alias("id"), d["schema"].alias("schema"))), F.array(F.struct(F.lit(0).alias("k"), F.lit(ANY).alias("kind"), F.lit("").alias("id"), nothing))),
    ).otherwise(F.transform("calls", lambda c, k: F.struct(k.alias("k"), F.lit(ID).alias("kind"), c["id"].alias("id"), nothing)))
    first = (
        parsed.select("conv_id", "turn", posted.alias("posted"))
        .where(F.size("posted") > 0)
        .select("conv_id", "turn", F.explode("posted").alias("p"))
        .where("conv_id is not null and turn is not null and p.id is not null")
        .groupBy("conv_id", "p.kind", "p.id")
        .agg(F.min(F.struct("turn", "p.k", "p.schema")).alias("first"))
    )
    # a message asks for the first call of its own ids (to find duplicates) and for its tools, or for the first call of the id that it answers; messages with neither, or without conversation or turn, skip the join
    ask = lambda kind, k, name: F.struct(k.alias("k"), F.lit(kind).alias("kind"), name.alias("id"))
    own_asks = F.concat(F.transform("calls", lambda c, k: ask(ID, k, c["id"])), F.transform("calls", lambda c, k: ask(TOOL, k, c["name"])), F.array(ask(ANY, F.lit(0), F.lit(""))))
    asks = parsed.select("*", F.when(F.col("answers").isNotNull(), F.array(ask(ID, F.lit(0), F.col("answers")))).when(F.size("calls") > 0, own_asks).otherwise(F.array().cast("array<struct<k:int,kind:int,id:string>>")).alias("ids"))
    joins = (F.size("ids") > 0) & F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    cols = ["conv_id", "turn", "role", "text", "calls", "answers", "content"]
    nowhere = F.expr("cast(null as array<struct<k:int,kind:int,first:struct<turn:bigint,k:int,schema:string>>>)").alias("found")
    plain = others.select(*cols, nowhere).union(asks.where(~joins).select(*cols, nowhere))
    tools = asks.where(joins)
    keyed = tools.select("row", "conv_id", F.inline("ids")).join(first, ["conv_id", "kind", "id"]).groupBy("row").agg(F.collect_list(F.struct("k", "kind", "first")).alias("found"))
    linked = tools.join(keyed, "row", "left").select(*cols, "found")

    out_schema = T._parse_datatype_string("conv_id bigint, turn bigint, order_key array<bigint>, role string, n_calls int, n_invalid int, links struct<turn:bigint,k:int>, status string, message string")
    out_arrow = to_arrow_schema(out_schema)

    def write(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                found = {x["k"]: {"turn": x["first"]["turn"], "k": x["first"]["k"]} for x in r["found"] or [] if x["kind"] == ID}
                own = {x["k"]: x["first"]["schema"] for x in r["found"] or [] if x["kind"] == TOOL}
                closed = any(x["kind"] == ANY for x in r["found"] or [])
                at = r["turn"]
                order, link, status = [at or 0, 0, 0, at or 0], None, "ok"
                message = {"role": r["role"], "content": r["text"]}
                wrong = []
                if r["answers"] is not None:
                    message |= {"tool_call_id": r["answers"], "content": json.loads(r["content"] or "null")}
                    link = found.get(0)
                    status = "ok" if link else "orphan"
                    if link and at <= link["turn"]:
                        order = [link["turn"], 1, link["k"], at]
                elif r["calls"]:
                    made = []
                    for k, c in enumerate(r["calls"]):
                        bad = _check(c, schemas, own.get(k), closed)
                        wrong += bad[:1]
                        try:
                            args = read_json(c["arguments"] or "{}")
                        except ValueError:
                            args = c["arguments"]
                        made.append({"id": c["id"], "name": c["name"], "arguments": args} | ({"violations": bad} if bad else {}))
                        if found.get(k) and (found[k]["turn"], found[k]["k"]) != (at, k):
                            status = "duplicate_id"
                    message |= {"tool_calls": made, "content": json.loads(r["content"] or "null")}
                    status = "invalid_arguments" if wrong else status
                rows.append({"conv_id": r["conv_id"], "turn": at, "order_key": order, "role": r["role"], "n_calls": len(r["calls"]), "n_invalid": len(wrong), "links": link, "status": status, "message": canonical(message)})
            yield pa.RecordBatch.from_pylist(rows, schema=out_arrow)

    return plain.union(linked).mapInArrow(write, out_schema)


#: What replayed conversations define: their only tool.
DEFINED = '{"tools":[{"name":"reply","parameters":{"additionalProperties":false,"properties":{"limit":{"maximum":6,"minimum":0,"type":"integer"},"text":{"type":["string","null"]}},"required":["limit","text"],"type":"object"}}]}'


def replayed(messages: DataFrame) -> DataFrame:
    """Conversations that replay those of a table through a tool: a user's message becomes a call with its text, an assistant's message a result.

    Conversation c becomes -1 - c, turn t stands at 2 t + 4, and at 0 a system message defines the tool.  Calls have the id of every fourth turn, so longer conversations repeat ids.  By the number of the conversation, results
    answer an unknown id (every fifth), stand before their call (every third), limits are strings (every fourth), or the tool is unknown (every thirteenth).
    """
    conv, turn = F.col("conv_id"), F.col("turn")
    at = 2 * turn + 4
    call_id = F.concat(F.lit("c"), F.floor(turn / 4).cast("string"))
    limit = F.when(conv % 4 == 1, F.concat(F.lit('"'), turn.cast("string"), F.lit('"'))).otherwise(turn.cast("string"))
    text = F.when(F.col("text").isNull(), F.lit("null")).otherwise(F.expr("substring(to_json(named_struct('x', text)), 6, length(to_json(named_struct('x', text))) - 6)"))
    name = F.when(conv % 13 == 0, F.lit("answer")).otherwise(F.lit("reply"))
    call = F.concat(F.lit('{"content":null,"tool_calls":[{"id":"'), call_id, F.lit('","name":"'), name, F.lit('","arguments":{"limit":'), limit, F.lit(',"text":'), text, F.lit("}}]}"))
    answered = F.when(conv % 5 == 0, F.concat(F.lit("x"), turn.cast("string"))).otherwise(F.concat(F.lit("c"), F.floor((turn - 1) / 4).cast("string")))
    result = F.concat(F.lit('{"tool_call_id":"'), answered, F.lit('","content":'), text, F.lit("}"))
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    defined = messages.where(turn == 0).select((-1 - conv).alias("conv_id"), "turn", F.lit("system").alias("role"), F.lit(DEFINED).alias("text"))
    told = messages.select(
        (-1 - conv).alias("conv_id"),
        F.when(reply & (conv % 3 == 0), at - 3).otherwise(at).alias("turn"),
        F.when(user, F.lit("assistant")).when(reply, F.lit("tool")).otherwise(F.col("role")).alias("role"),
        F.when(user, call).when(reply, result).otherwise(F.col("text")).alias("text"),
    )
    return defined.union(told)


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, and those of the replayed conversations, in canonical form with their order and links.

    The parts of order_key are zero-padded, so that it sorts as text.
    """
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = format_chat(messages.union(replayed(messages)))
    key = F.array_join(F.transform("order_key", lambda x: F.lpad(x.cast("string"), 10, "0")), ".")
    return out.select("conv_id", "turn", key.alias("order_key"), "role", "n_calls", "n_invalid", F.col("links.turn").alias("call_turn"), "status", "message")


OP5_SQL = r"""
WITH m AS (
  SELECT conv_id, turn, role, text, coalesce(to_json(text)::VARCHAR, 'null') AS j FROM conversations
), calls AS (
  SELECT -1 - conv_id AS conv_id, 2 * turn + 4 AS turn, 'c' || (turn // 4) AS id, conv_id % 4 = 1 AS bad, conv_id % 13 = 0 AS strange, turn AS told, j FROM m WHERE role = 'user'
), firsts AS (
  SELECT conv_id, id, min(turn) AS first FROM calls GROUP BY conv_id, id
), made AS (
  SELECT conv_id, turn, id, first, told > 6 AS large, bad, strange,
         CASE WHEN strange THEN '["no such tool"]' WHEN bad THEN '["$.limit: not integer"]' WHEN told > 6 THEN '["$.limit: maximum 6"]' END AS broken,
         '"arguments":{"limit":' || CASE WHEN bad THEN '"' || told || '"' ELSE told::VARCHAR END || ',"text":' || j || '},"id":"' || id || '","name":"' || CASE WHEN strange THEN 'answer' ELSE 'reply' END || '"' AS body
  FROM calls JOIN firsts USING (conv_id, id)
), results AS (
  SELECT -1 - m.conv_id AS conv_id, 2 * turn + 4 - CASE WHEN m.conv_id % 3 = 0 THEN 3 ELSE 0 END AS turn, CASE WHEN m.conv_id % 5 = 0 THEN 'x' || turn ELSE 'c' || ((turn - 1) // 4) END AS id, j
  FROM m WHERE role = 'assistant'
)
SELECT conv_id, turn, printf('%010d.0000000000.0000000000.%010d', turn, turn) AS order_key, role, 0::INTEGER AS n_calls, 0::INTEGER AS n_invalid,
       NULL::BIGINT AS call_turn, 'ok' AS status, '{"content":' || j || ',"role":' || to_json(role)::VARCHAR || '}' AS message
FROM m
UNION ALL
SELECT -1 - conv_id, turn, '0000000000.0000000000.0000000000.0000000000', 'system', 0, 0, NULL, 'ok', '{"content":' || to_json('@@DEF@@')::VARCHAR || ',"role":"system"}'
FROM m WHERE turn = 0
UNION ALL
SELECT -1 - conv_id, 2 * turn + 4, printf('%010d.0000000000.0000000000.%010d', 2 * turn + 4, 2 * turn + 4), role, 0, 0, NULL, 'ok', '{"content":' || j || ',"role":' || to_json(role)::VARCHAR || '}'
FROM m WHERE role NOT IN ('user', 'assistant')
UNION ALL
SELECT conv_id, turn, printf('%010d.0000000000.0000000000.%010d', turn, turn), 'assistant', 1, (broken IS NOT NULL)::INTEGER, NULL,
       CASE WHEN broken IS NOT NULL THEN 'invalid_arguments' WHEN first < turn THEN 'duplicate_id' ELSE 'ok' END,
       '{"content":null,"role":"assistant","tool_calls":[{' || body || coalesce(',"violations":' || broken, '') || '}]}'
FROM made
UNION ALL
SELECT conv_id, turn, CASE WHEN turn <= first THEN printf('%010d.0000000001.0000000000.%010d', first, turn) ELSE printf('%010d.0000000000.0000000000.%010d', turn, turn) END, 'tool', 0, 0, first,
       CASE WHEN first IS NULL THEN 'orphan' ELSE 'ok' END, '{"content":' || j || ',"role":"tool","tool_call_id":"' || id || '"}'
FROM results LEFT JOIN firsts USING (conv_id, id)
""".replace("@@DEF@@", DEFINED)
