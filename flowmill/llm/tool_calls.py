"""Tool-call linking: calls and results of conversations joined, ordered, validated, serialised.

Calls and results meet by a hash join on (conversation, call id); a repeated id is
first reduced to its earliest call and earliest result, with counts, so that a repeated
id cannot multiply rows. Calls are then put into an order in which each comes after
the calls it depends on: where all references of a conversation go to earlier turns, turn order is
such an order; in the other conversations calls are taken off level by level (a call's level is
the longest chain of calls below it), one join for each level, and what remains depends on
itself. Positions are ranks over groups of any size. Arguments are parsed, checked
against the tool's schema and written as canonical JSON (keys in UTF-16 order, shortest
numbers, no spaces) in one pass over the linked rows; a conversation is never gathered.

Defined cases: null conversation or call ids link with nothing: such calls are kept as ``no_id`` and such
results as ``orphan_result``; results without a call are ``orphan_result`` rows without position; null
arguments are not JSON; references to unknown calls are reported and do not order; references to
itself are cycles; null turns come first. Empty tables give no rows.
"""

from __future__ import annotations

import json
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.functions.ranking import with_rank
from flowmill.session import save_and_reload

OUT = (
    "conv_id bigint, call_id string, turn bigint, position bigint, level int, name string, result_turn bigint, status string,"
    " problems array<string>, repeats bigint, record string"
)


class NotJson(ValueError):
    pass


def parse_json(text: str | None):
    """The value of a JSON text; raises :class:`NotJson` also for repeated keys and lone surrogates."""

    def unique(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise NotJson("repeated key")
        return dict(pairs)

    def refuse(constant):
        raise NotJson(f"{constant} is no number")

    if text is None:
        raise NotJson("no arguments")
    try:
        value = json.loads(text, object_pairs_hook=unique, parse_constant=refuse)
        canonical(value).encode("utf-8")
    except NotJson:
        raise
    except (ValueError, RecursionError, OverflowError) as error:
        raise NotJson("not JSON" if not isinstance(error, RecursionError) else "nested too deep") from None
    return value


def _number(x: float) -> str:
    """Shortest digits that read back as ``x``, laid out as ECMAScript does."""
    if x != x or x in (float("inf"), float("-inf")):
        raise NotJson("number out of range")
    if x == 0:
        return "0"
    sign, digits, exponent = Decimal(repr(x)).as_tuple()
    figures = "".join(map(str, digits)).rstrip("0")
    point = len(digits) + exponent  # digits before the decimal point
    if len(figures) <= point <= 21:
        body = figures + "0" * (point - len(figures))
    elif 0 < point <= 21:
        body = f"{figures[:point]}.{figures[point:]}"
    elif -6 < point <= 0:
        body = "0." + "0" * -point + figures
    else:
        power = point - 1
        body = figures[0] + ("." + figures[1:] if len(figures) > 1 else "") + f"e{'+' if power > 0 else '-'}{abs(power)}"
    return "-" * sign + body


def canonical(value) -> str:
    """JSON without spaces, keys ordered by UTF-16 code units, numbers in their shortest form."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in keys) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str),
    "boolean": lambda v: isinstance(v, bool), "null": lambda v: v is None,
    "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(),
}


def problems_of(value, schema: dict, at: str = "") -> list[str]:
    """What a value breaks of a schema: type, enum, bounds, lengths, required, properties, items."""
    kinds = schema.get("type")
    if kinds is not None:
        kinds = [kinds] if isinstance(kinds, str) else kinds
        if not any(_KINDS[k](value) for k in kinds):
            return [f"{at or '/'}: not {' or '.join(kinds)}"]
    found = []
    if "enum" in schema and not any(value == x and type(value) is type(x) for x in schema["enum"]):
        found.append(f"{at or '/'}: not one of the values")
    if _KINDS["number"](value):
        if "minimum" in schema and value < schema["minimum"]:
            found.append(f"{at or '/'}: below {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            found.append(f"{at or '/'}: above {schema['maximum']}")
    if isinstance(value, (str, list)):
        low, high = ("minLength", "maxLength") if isinstance(value, str) else ("minItems", "maxItems")
        if len(value) < schema.get(low, 0):
            found.append(f"{at or '/'}: too short")
        if high in schema and len(value) > schema[high]:
            found.append(f"{at or '/'}: too long")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        found += [f"{at}/{k}: missing" for k in schema.get("required", []) if k not in value]
        for k, v in value.items():
            if k in known:
                found += problems_of(v, known[k], f"{at}/{k}")
            elif schema.get("additionalProperties") is False:
                found.append(f"{at}/{k}: unknown")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            found += problems_of(v, schema["items"], f"{at}/{i}")
    return found


def _levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) of calls that do not depend on themselves.

    Only conversations with a reference to the same or a later turn are taken off by level; the
    rest keep level 0 and turn order.
    """
    odd = save_and_reload(edges.filter("not forward").select("conv_id").distinct(), "odd")
    plain = calls.join(odd, "conv_id", "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))
    if odd.isEmpty():
        return plain
    left = save_and_reload(calls.join(odd, "conv_id").select("conv_id", "call_id"), "left")
    open_ = save_and_reload(edges.join(odd, "conv_id").select("conv_id", "call_id", "needs"), "open")
    level, done = 0, plain
    while True:
        waiting = open_.select("conv_id", "call_id").distinct()
        ready = save_and_reload(left.join(waiting, ["conv_id", "call_id"], "left_anti"), "ready")
        if ready.isEmpty():
            return done
        done = done.unionAll(ready.select("conv_id", "call_id", F.lit(level).alias("level")))
        met = ready.withColumnRenamed("call_id", "needs")
        left = save_and_reload(left.join(ready, ["conv_id", "call_id"], "left_anti"), "left")
        open_ = save_and_reload(open_.join(met, ["conv_id", "needs"], "left_anti"), "open")
        level += 1


def _recorded(schemas: dict[str, dict]):
    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                problems, arguments = [], None
                if r["is_call"]:
                    try:
                        arguments = parse_json(r["arguments"])
                        schema = schemas.get(r["name"])
                        problems = ["unknown tool"] if schema is None else problems_of(arguments, schema)
                    except NotJson as error:
                        problems = [str(error)]
                    problems += [f"unknown call {n}" for n in r["unknown"] or []]
                if not r["is_call"]:
                    status = "orphan_result"
                elif r["call_id"] is None or r["conv_id"] is None:
                    status = "no_id"
                elif r["level"] is None:
                    status = "cycle"
                elif problems:
                    status = "invalid"
                else:
                    status = "linked" if r["has_result"] else "no_result"
                record = {
                    "arguments": arguments, "depends_on": sorted(set(r["needs"] or [])), "id": r["call_id"],
                    "name": r["name"], "result": r["content"] if r["has_result"] else None, "status": status}
                out.append((
                    r["conv_id"], r["call_id"], r["turn"], r["position"], r["level"], r["name"], r["result_turn"],
                    status, problems, r["repeats"], canonical(record)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.string(),
                     pa.list_(pa.string()), pa.int64(), pa.string())
            names = [x.strip().split(" ")[0] for x in OUT.split(", ")]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], type=k) for i, k in enumerate(kinds)], names=names)

    return run


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """One row for each call and each orphan result, see OUT.

    ``calls``: conv_id, call_id, turn, name, arguments (JSON text), depends_on (array of call ids).
    ``results``: conv_id, call_id, turn, content.
    """
    keys = ["conv_id", "call_id"]
    calls = calls.select(
        F.col("conv_id").cast("bigint"), F.col("call_id").cast("string"), F.col("turn").cast("bigint"), "name",
        "arguments", F.array_compact(F.coalesce("depends_on", F.array().cast("array<string>"))).alias("needs"))
    has_id = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    one = calls.filter(has_id).groupBy(*keys).agg(
        F.min(F.struct("turn", "name", "arguments", "needs")).alias("c"), F.count(F.lit(1)).alias("repeats"))
    one = save_and_reload(one.select(*keys, "c.*", "repeats"), "calls")
    results = results.select(
        F.col("conv_id").cast("bigint"), F.col("call_id").cast("string"), F.col("turn").cast("bigint").alias("result_turn"), "content")
    first = results.filter(has_id).groupBy(*keys).agg(F.min(F.struct("result_turn", "content")).alias("r"))
    first = first.select(*keys, "r.*", F.lit(True).alias("has_result"))

    wanted = one.select(*keys, "turn", F.explode(F.array_distinct("needs")).alias("needs"))
    there = one.select("conv_id", F.col("call_id").alias("needs"), F.col("turn").alias("needs_turn"), F.lit(True).alias("there"))
    edges = save_and_reload(wanted.join(there, ["conv_id", "needs"], "left").withColumn(
        "forward", F.coalesce(F.col("needs_turn") < F.col("turn"), F.lit(False))), "edges")
    unknown = edges.filter("there is null").groupBy(*keys).agg(F.sort_array(F.collect_set("needs")).alias("unknown"))
    levels = _levels(one, edges.filter("there"))
    ordered = one.join(levels, keys, "left")
    # Cycles come after all levels; buckets of turns keep a long conversation in many parts.
    place = F.coalesce(F.col("level"), F.lit(1 << 30))
    turn = F.coalesce(F.col("turn"), F.lit(-(1 << 40)))
    ranked = with_rank(
        ordered.withColumns({"_place": place, "_turn": turn}), ["conv_id"], [F.col("_place"), F.col("_turn"), F.col("call_id")],
        F.struct(F.col("_place"), F.floor(F.col("_turn") / 64).alias("turns")), rank="position").drop("_place", "_turn")
    linked = ranked.join(first, keys, "left").join(unknown, keys, "left").withColumn("is_call", F.lit(True))
    orphans = results.join(one.select(*keys, F.lit(True).alias("called")), keys, "left").filter("called is null")
    no_id = calls.filter(~has_id)
    rows = linked.unionByName(orphans.select(
        *keys, "result_turn", "content", F.lit(True).alias("has_result"), F.lit(False).alias("is_call")),
        allowMissingColumns=True).unionByName(
        no_id.withColumns({"is_call": F.lit(True), "repeats": F.lit(1).cast("bigint")}), allowMissingColumns=True)
    return rows.select(
        *keys, "turn", "position", "level", "name", "arguments", "needs", "unknown", "result_turn", "content",
        F.coalesce("has_result", F.lit(False)).alias("has_result"), "is_call", "repeats").mapInArrow(_recorded(schemas), OUT)


#: Tools of the derived calls.
SCHEMAS = {
    "search": {
        "type": "object", "required": ["query", "limit"], "additionalProperties": False,
        "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 50}}},
    "translate": {
        "type": "object", "required": ["text", "target"], "additionalProperties": False,
        "properties": {"text": {"type": "string"}, "target": {"enum": ["de", "en", "es", "fr"]}}},
    "measure": {
        "type": "object", "required": ["text"],
        "properties": {"text": {"type": "string"}, "ratio": {"type": "number", "minimum": 0, "maximum": 1}}},
}


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results): every user turn asks a tool with its text, the next turn, if the assistant's, is the result.

    A call depends on an earlier one of its conversation; a few refer to the next one, so that their
    conversation has to be ordered anew; some arguments break their schema.
    """
    size, pick = F.length("text"), F.pmod(F.xxhash64("text"), F.lit(3))
    name = F.element_at(F.array(F.lit("search"), F.lit("translate"), F.lit("measure")), (pick + 1).cast("int"))
    arguments = (
        F.when(pick == 0, F.to_json(F.struct(F.col("text").alias("query"), F.pmod(size, F.lit(60)).alias("limit"))))
        .when(pick == 1, F.to_json(F.struct(
            F.element_at(F.array(*map(F.lit, ("fr", "de", "es", "en", "xx"))), (F.pmod(size, F.lit(5)) + 1).cast("int")).alias("target"),
            "text")))
        .otherwise(F.to_json(F.struct("text", (F.pmod(size, F.lit(110)) / F.lit(100)).alias("ratio")))))
    named = lambda turn: F.concat(F.lit("call_"), turn)
    earlier = F.when(F.col("turn") >= 2, F.array(named(F.expr("turn div 2 div 2 * 2 + turn % 2")))).otherwise(F.array().cast("array<string>"))
    earlier = F.filter(earlier, lambda x: x != named(F.col("turn")))
    later = F.when(F.pmod(size, F.lit(17)) == 0, F.array(named(F.col("turn") + 2))).otherwise(F.array().cast("array<string>"))
    user = turns.filter("role = 'user'")
    calls = user.select(
        "conv_id", named(F.col("turn")).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"),
        F.concat(earlier, later).alias("depends_on"))
    results = turns.filter("role = 'assistant'").select(
        "conv_id", named(F.col("turn") - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
