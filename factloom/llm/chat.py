"""Chat formatting: tool calls linked with their results, ordered, validated and written as canonical JSON.

A message's text may be a JSON object with tool_calls ([{id, name, arguments, after}]) or, of a tool, with
tool_call_id and content; any other text is plain. Arguments may name another call's result as "$id". A plain
user message is a call answered by the assistant message of the next turn: its identifier is its turn.

Calls and results meet in a hash join on (conversation, identifier). A call's level is 0 without
dependencies, else one more than its dependencies' highest. Conversations of up to EDGES dependencies are sorted
topologically whole, each in one task; larger ones round by round over all calls that still wait, a job a level, so that
no task holds a conversation whatever its size.

The canonical conversation is its events in order of `due`, level, calls before results, turn and part. due is an event's
turn, or a later one that it waits for: a result's call, a call's dependencies. So no call stands before a
result that it needs, and a conversation without tool calls keeps its turns. `serialised` writes it in that order.

JSON is strict: NaN, infinities and numbers beyond doubles are none, and what Python cannot parse (too deep, too many
digits) is plain text or, in arguments, an error. Lone surrogates are written as \\u escapes.

Cases: null conversations, turns, roles and texts are kept (a null text is null content; a null
conversation never links); a call without a result is `open`, a result without a call `orphan`, calls of one
identifier all link and are `repeated`, cyclic ones are `cycle` with a null level; text that is not such JSON
is plain; repeated rows stay; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from factloom.llm.common import staged

#: Dependencies of a conversation up to which one task sorts it.
EDGES = 100_000
#: What a plain user message must be: a text that is not empty.
REPLY = {"reply": {"type": "object", "required": ["content"], "properties": {"content": {"type": "string", "minLength": 1}}}}
_SURROGATE = re.compile("[\ud800-\udfff]")
_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}


def equal(a: Any, b: Any) -> bool:
    """Whether two JSON values are one: true is not 1, 1.0 is 1."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(equal, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(equal(a[k], b[k]) for k in a)
    return a == b


def problems(value: Any, schema: dict, at: str = "$") -> list[str]:
    """What of value breaks schema (type, enum, const, properties, required, additionalProperties, items, bounds)."""
    found = []
    kind = schema.get("type")
    if kind:
        kinds = kind if isinstance(kind, list) else [kind]
        number = isinstance(value, int | float) and not isinstance(value, bool)
        fits = [
            number if k == "number" else number and (isinstance(value, int) or value.is_integer()) if k == "integer" else isinstance(value, _TYPES.get(k, object)) for k in kinds
        ]
        if not any(fits):
            return [f"{at}: not {'/'.join(kinds)}"]
    if "enum" in schema and not any(equal(value, x) for x in schema["enum"]):
        found.append(f"{at}: not in enum")
    if "const" in schema and not equal(value, schema["const"]):
        found.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}.{k}: missing" for k in schema.get("required", ()) if k not in value]
        for k in sorted(value):
            if k in known:
                found += problems(value[k], known[k], f"{at}.{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}.{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, x in enumerate(value):
            found += problems(x, schema["items"], f"{at}[{i}]")
    if isinstance(value, int | float) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{at}: below minimum")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at}: above maximum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0):
            found.append(f"{at}: too short")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            found.append(f"{at}: too long")
        if "pattern" in schema and not re.search(schema["pattern"], value):
            found.append(f"{at}: no match")
    return found


def canonical(value: Any) -> str:
    """JSON with sorted keys, no white space, and characters as they are but for lone surrogates."""
    return encodable(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def encodable(text: str) -> str:
    """text with lone surrogates, which no encoding has, as \\u escapes."""
    return _SURROGATE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def _finite(text: str) -> float:
    value = float(text)
    if not math.isfinite(value):
        raise ValueError(f"{text} is no double")
    return value


def loads(text: str) -> Any:
    """Strict JSON; ValueError for anything else, however deep or long."""
    try:
        return json.loads(text, parse_constant=_finite, parse_float=_finite)
    except RecursionError as e:
        raise ValueError("too deep") from e


def references(value: Any) -> set[str]:
    """Identifiers named as "$id" anywhere in value."""
    if isinstance(value, str):
        return {value[1:]} if len(value) > 1 and value[0] == "$" else set()
    if isinstance(value, dict):
        value = list(value.values())
    return set().union(*map(references, value)) if isinstance(value, list) else set()


def parsed(role: str | None, turn: int | None, text: str | None, schemas: dict[str, dict]) -> list[tuple]:
    """(kind, call_id, name, needs, errors, json) of a message: its calls, its result, or itself."""
    loaded = None
    if text and text.lstrip()[:1] == "{":
        try:
            loaded = loads(text)
            if isinstance(loaded, dict):
                if isinstance(loaded.get("tool_calls"), list):
                    return _calls(role, loaded, schemas)
                if loaded.get("tool_call_id") is not None:
                    key = encodable(str(loaded["tool_call_id"]))
                    return [("result", key, None, [], [], canonical({"content": loaded.get("content"), "role": role, "tool_call_id": key}))]
        except (ValueError, RecursionError):  # no JSON, or deeper than can be written again
            pass
    body = canonical({"content": text, "role": role})
    if role == "user" and turn is not None:
        return [("call", f"turn:{turn}", "reply", [], problems({"content": text}, schemas.get("reply", {})), body)]
    if role == "assistant" and turn is not None:
        return [("result", f"turn:{turn - 1}", None, [], [], body)]
    return [("message", None, None, [], [], body)]


def _calls(role: str | None, loaded: dict, schemas: dict[str, dict]) -> list[tuple]:
    out = []
    for call in loaded["tool_calls"]:
        call = call if isinstance(call, dict) else {}
        name, arguments, errors = call.get("name"), call.get("arguments"), []
        if isinstance(arguments, str):
            try:
                read = loads(arguments)
                canonical(read), references(read)
                arguments = read
            except (ValueError, RecursionError):
                errors.append("$: not JSON")
        if not isinstance(name, str) or (schemas and name not in schemas):
            errors.append("unknown tool")
        elif name in schemas and not errors:
            errors += problems(arguments, schemas[name])
        after = call.get("after")
        needs = references(arguments) | {str(x) for x in after if x is not None} if isinstance(after, list) else references(arguments)
        key = None if call.get("id") is None else encodable(str(call["id"]))
        body = {"arguments": arguments, "id": key, "name": name, "role": role}
        shown = encodable(name) if isinstance(name, str) else None
        out.append(("call", key, shown, sorted({encodable(x) for x in needs}), [encodable(e) for e in errors], canonical(body)))
    content = loaded.get("content")
    if content is not None or not out:
        out.append(("message", None, None, [], [], canonical({"content": content, "role": role})))
    return out


_EVENTS = "turn long, role string, part int, kind string, call_id string, name string, needs array<string>, errors array<string>, json string"


def events(messages: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row an event of the messages; conv_id keeps its type."""
    conv = messages.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        kinds = [to_arrow_type(conv), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), strings, strings, pa.string()]
        names = ["conv_id", *(x.split()[0] for x in _EVENTS.split(", "))]
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                rows = zip(*(part.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text")), strict=True)
                out = [(conv, turn, role, i, *e) for conv, turn, role, text in rows for i, e in enumerate(parsed(role, turn, text, schemas))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return messages.select("conv_id", F.col("turn").cast("long"), "role", "text").mapInArrow(run, f"conv_id {conv.simpleString()}, {_EVENTS}")


def _sorted(table: pa.Table) -> pa.Table:
    """Levels of one conversation's calls, from its edges: a row (call_id, need, due) each, due that of the call's own turn."""
    calls, needs, own = (table.column(c).to_pylist() for c in ("call_id", "need", "due"))
    waits: dict[str, set[str]] = {}
    asked: dict[str, list[str]] = {}
    due: dict[str, int | None] = {}
    for call, need, turn in zip(calls, needs, own, strict=True):
        due[call] = turn
        if need is not None:
            waits.setdefault(call, set()).add(need)
            asked.setdefault(need, []).append(call)
    level = {c: 0 for c in due if c not in waits}
    ready = list(level)
    for call in ready:  # grows while it is read
        for one in asked.get(call, ()):
            due[one] = max((d for d in (due[one], due[call]) if d is not None), default=None)
            waits[one].discard(call)
            if not waits[one] and one not in level:
                level[one] = level[call] + 1
                ready.append(one)
    found = list(due)
    conv = table.column("conv_id")[0]
    return pa.table({
        "conv_id": pa.array([conv.as_py()] * len(found), conv.type), "call_id": pa.array(found, pa.string()),
        "level": pa.array([level.get(c) for c in found], pa.int32()), "due": pa.array([due[c] for c in found], pa.int64()),
    })


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, due) of calls (conv_id, call_id, needs, due); level is null on a cycle or behind one.

    due is the first turn that a call of the identifier is due in by itself; the result's is not before those of its needs.
    Needs that no call of the conversation answers to do not count.
    """
    keyed = calls.where("conv_id is not null and call_id is not null")
    nodes = staged(keyed.groupBy("conv_id", "call_id").agg(F.min("due").alias("due")), "calls")
    wanted = keyed.select("conv_id", "call_id", F.explode("needs").alias("need")).distinct()
    edges = staged(wanted.join(nodes.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_semi"), "needs")
    zero = F.lit(0).cast("int")
    if not edges.limit(1).count():
        return nodes.select("conv_id", "call_id", zero.alias("level"), "due")
    sizes = staged(edges.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    free = nodes.join(sizes, "conv_id", "left_anti").select("conv_id", "call_id", zero.alias("level"), "due")
    touched = edges.select("conv_id", "call_id").union(edges.select("conv_id", "need")).distinct()
    # Calls that no edge touches need no sorting, however many a conversation has.
    alone = nodes.join(sizes, "conv_id", "left_semi").join(touched, ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", zero.alias("level"), "due")
    whole = nodes.join(touched, ["conv_id", "call_id"], "left_semi").join(edges, ["conv_id", "call_id"], "left")
    small = whole.join(sizes.where(F.col("n") <= EDGES), "conv_id", "left_semi").select("conv_id", "call_id", "need", "due")
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema.fields}
    out = free.unionByName(alone).unionByName(small.groupBy("conv_id").applyInArrow(_sorted, f"conv_id {kinds['conv_id']}, call_id string, level int, due long"))
    big = sizes.where(F.col("n") > EDGES).select("conv_id")
    if big.limit(1).count():
        out = out.unionByName(_rounds(nodes.join(touched, ["conv_id", "call_id"], "left_semi").join(big, "conv_id", "left_semi"), edges.join(big, "conv_id", "left_semi")))
    return out


def _rounds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """As _sorted, over all conversations at once, a staged round a level: a call's level is the round that frees it."""
    edges = staged(edges, "needs")
    waiting = staged(nodes.join(edges, ["conv_id", "call_id"], "left_semi"), "waiting")
    new = staged(nodes.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(0).cast("int")), "levels")
    done, level = [new], 0
    while new.limit(1).count():
        level += 1
        met = edges.join(new.select("conv_id", F.col("call_id").alias("need"), F.col("due").alias("after")), ["conv_id", "need"])
        after = met.groupBy("conv_id", "call_id").agg(F.max("after").alias("after"))
        waiting = staged(waiting.join(after, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.greatest("due", "after").alias("due")), "waiting")
        edges = staged(edges.join(new.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"], "left_anti"), "needs")
        new = staged(waiting.join(edges, ["conv_id", "call_id"], "left_anti").withColumn("level", F.lit(level).cast("int")), "levels")
        waiting = waiting.join(edges, ["conv_id", "call_id"], "left_semi")
        done.append(new)
    every = waiting.withColumn("level", F.lit(None).cast("int"))
    for part in done:
        every = every.unionByName(part.select("conv_id", "call_id", "due", "level"))
    return every.select("conv_id", "call_id", "level", "due")


def link(messages: DataFrame, schemas: dict[str, dict] | None = None) -> DataFrame:
    """One row an event: conv_id, turn, part, role, kind, call_id, name, status, linked_turn, level, due, valid, errors, json.

    status: linked, open, orphan, repeated, cycle or plain. linked_turn is the first turn of the other side.
    """
    rows = staged(events(messages, schemas or {}), "events")
    calls, results = rows.where("kind = 'call'"), rows.where("kind = 'result'")
    sides = [
        x.where("conv_id is not null and call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias(f"{n}s"), F.min("turn").alias(f"{n}_turn"))
        for x, n in ((calls, "call"), (results, "result"))
    ]
    # What needs a call waits for its result: a call is answered no sooner than its first result's turn.
    answered = calls.join(sides[1].drop("results"), ["conv_id", "call_id"], "left").withColumn("due", F.greatest("turn", "result_turn"))
    both = sides[0].join(sides[1], ["conv_id", "call_id"], "full").join(levels(answered).withColumnRenamed("due", "done"), ["conv_id", "call_id"], "left")
    full = rows.join(both, ["conv_id", "call_id"], "left")
    of_call = F.when(F.col("result_turn").isNull(), "open").when(F.col("level").isNull(), "cycle").when(F.col("calls") > 1, "repeated").otherwise("linked")
    of_result = F.when(F.col("call_turn").isNull(), "orphan").when(F.col("calls") > 1, "repeated").otherwise("linked")
    status = F.when(F.col("kind") == "call", of_call).when(F.col("kind") == "result", of_result).otherwise("plain")
    other = F.when(F.col("kind") == "call", F.col("result_turn")).when(F.col("kind") == "result", F.col("call_turn"))
    # A call without needs is due in its own turn, one with needs when the last of them is done.
    of_event = F.when((F.col("kind") == "call") & (F.col("level") == 0), F.col("turn")).when(F.col("kind") == "message", F.col("turn")).otherwise(F.greatest("turn", "call_turn", "done"))
    return full.select(
        "conv_id", "turn", "part", "role", "kind", "call_id", "name", status.alias("status"), other.alias("linked_turn"),
        F.when(F.col("kind").isin("call", "result"), F.col("level")).alias("level"), of_event.alias("due"),
        (F.size("errors") == 0).alias("valid"), F.array_join("errors", "; ").alias("errors"), "json",
    )


def canonical_order() -> list[F.Column]:
    """Sort keys of a linked conversation's events: a topological order of its calls and results."""
    return [F.col("due").asc_nulls_first(), F.coalesce("level", F.lit(0)), F.col("kind") == "result", F.col("turn").asc_nulls_first(), F.col("part")]


def serialised(linked: DataFrame) -> DataFrame:
    """(conv_id, json) in the canonical order of each conversation: written as text, a line an event.

    Range-partitioned by conversation and order, so a conversation of any size may span tasks.
    """
    return linked.orderBy("conv_id", *canonical_order(), "json").select("conv_id", "json")


def op7_chat(messages: DataFrame) -> DataFrame:
    """link with REPLY: a user message without text is an invalid call."""
    return link(messages, REPLY)


def oracle() -> str:
    """For tables without tool calls: replies linked by turn, and the plain messages' canonical JSON."""
    return """
WITH e AS (SELECT conv_id, turn, 0::INTEGER AS part, role,
  CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
  CASE role WHEN 'user' THEN 'turn:' || turn WHEN 'assistant' THEN 'turn:' || (turn - 1) END AS call_id,
  CASE WHEN role = 'user' THEN 'reply' END AS name,
  CASE WHEN role = 'user' AND text IS NULL THEN '$.content: not string' WHEN role = 'user' AND text = '' THEN '$.content: too short' ELSE '' END AS errors,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}' AS json FROM conversations),
c AS (SELECT conv_id, call_id, count(*) AS calls, min(turn) AS call_turn FROM e WHERE kind = 'call' GROUP BY ALL),
r AS (SELECT conv_id, call_id, min(turn) AS result_turn FROM e WHERE kind = 'result' GROUP BY ALL)
SELECT e.conv_id, e.turn, e.part, e.role, e.kind, e.call_id, e.name,
  CASE kind WHEN 'call' THEN CASE WHEN result_turn IS NULL THEN 'open' WHEN calls > 1 THEN 'repeated' ELSE 'linked' END
    WHEN 'result' THEN CASE WHEN call_turn IS NULL THEN 'orphan' WHEN calls > 1 THEN 'repeated' ELSE 'linked' END ELSE 'plain' END AS status,
  CASE kind WHEN 'call' THEN result_turn WHEN 'result' THEN call_turn END AS linked_turn,
  CASE WHEN kind = 'call' OR (kind = 'result' AND call_turn IS NOT NULL) THEN 0 END::INTEGER AS level,
  CASE kind WHEN 'result' THEN greatest(turn, call_turn, CASE WHEN call_turn IS NOT NULL THEN result_turn END) ELSE turn END AS due, errors = '' AS valid, errors, json
FROM e LEFT JOIN c ON e.conv_id = c.conv_id AND e.call_id = c.call_id LEFT JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id"""
