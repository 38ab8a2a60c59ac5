"""Chat formatting: tool calls joined to results by identifier, ordered topologically, checked and written as canonical JSON."""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.llm.common import Cut, cut, table

#: The tool that a plain turn of a person calls: the reply asked for. Other tools' schemas are a parameter.
SCHEMAS = {"reply": {"type": "object", "properties": {"text": {"type": "string", "minLength": 1}}, "required": ["text"], "additionalProperties": False}}
#: Levels of arrays and objects that a text may nest to be read as JSON; a deeper one is plain text.
MOST_DEPTH = 200
#: Dependencies of one conversation that a task sorts; larger conversations are sorted in rounds of joins.
TASK_EDGES = 100_000

_TYPES = {"string": str, "boolean": bool, "object": dict, "array": list, "null": type(None)}
_LONE = re.compile("[\ud800-\udfff]")


def canonical(value) -> str:
    """JSON with sorted keys, no blanks, plain Unicode; lone surrogates, which no text column can hold, are escaped."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def named(value) -> str | None:
    """An identifier or a name as text: a text itself, null, else its canonical JSON (so 5 and "5" are one)."""
    if value is None:
        return None
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", value) if isinstance(value, str) else canonical(value)


def _no_constant(name: str):
    raise ValueError(f"{name} isn't JSON")


def _finite(text: str) -> float:
    x = float(text)
    if x - x != 0:
        raise ValueError("a number out of range")
    return x


def parsed(text: str):
    """The value of a JSON text; ValueError if it is none, nests more than MOST_DEPTH deep or holds a number out of range."""
    try:
        value = json.loads(text, parse_constant=_no_constant, parse_float=_finite)
    except RecursionError:
        raise ValueError("too deep") from None
    todo = [(value, 1)]
    while todo:
        x, depth = todo.pop()
        if isinstance(x, (dict, list)):
            if depth > MOST_DEPTH:
                raise ValueError("too deep")
            todo += [(y, depth + 1) for y in (x.values() if isinstance(x, dict) else x) if isinstance(y, (dict, list))]
    return value


def faults(value, schema: dict, path: str = "$") -> list[str]:
    """What a value violates of a JSON schema: type, enum, required, properties, additionalProperties, items, bounds."""
    out, kind = [], schema.get("type")
    if kind in ("number", "integer"):
        fits = isinstance(value, (int, float)) and not isinstance(value, bool) and (kind == "number" or isinstance(value, int) or value.is_integer())
    else:
        fits = kind is None or isinstance(value, _TYPES[kind])
    if not fits:
        return [f"{path}: not {kind}"]
    if "enum" in schema and canonical(value) not in map(canonical, schema["enum"]):
        out.append(f"{path}: not in enum")
    if isinstance(value, str):
        if len(value) < schema.get("minLength", 0) or len(value) > schema.get("maxLength", len(value)):
            out.append(f"{path}: length")
    elif isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            out.append(f"{path}: bounds")
    elif isinstance(value, list):
        for i, x in enumerate(value):
            out += faults(x, schema.get("items", {}), f"{path}[{i}]")
    elif isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{path}.{named(k)}: missing" for k in schema.get("required", []) if k not in value]
        for k, x in value.items():
            if k in known:
                out += faults(x, known[k], f"{path}.{named(k)}")
            elif schema.get("additionalProperties") is False:
                out.append(f"{path}.{named(k)}: unknown")
    return out


_ROWS = "kind int, conv_id long, turn long, part int, call_id string, name string, arguments string, depends array<string>, content string"
_KINDS = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())


def _held(text: str | None) -> tuple[str, list[dict]] | None:
    """("tool_calls" or "tool_results", the objects under it) of a text that is a JSON object with such a list; else None."""
    if not text or not text.lstrip().startswith("{"):
        return None
    try:
        found = parsed(text)
    except ValueError:
        return None
    for key in ("tool_calls", "tool_results"):
        if isinstance(found.get(key), list):
            return key, [x for x in found[key] if isinstance(x, dict)]
    return None


def _call(x: dict) -> tuple:
    """Identifier, name, arguments and dependencies of a call. Arguments given as the JSON text of an object count as that object."""
    body = x["function"] if isinstance(x.get("function"), dict) else x
    arguments = body.get("arguments")
    if isinstance(arguments, str):
        try:
            inner = parsed(arguments)
            arguments = inner if isinstance(inner, dict) else arguments
        except ValueError:
            pass
    depends = x.get("depends_on")
    depends = depends if isinstance(depends, list) else [] if depends is None else [depends]
    return named(x.get("id")), named(body.get("name")), canonical(arguments), [d for d in map(named, depends) if d is not None]


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for conv, turn, role, text in zip(*(c.to_pylist() for c in b.columns)):
            held = _held(text)
            if held and held[0] == "tool_calls":
                for i, x in enumerate(held[1]):
                    call, name, arguments, depends = _call(x)
                    rows.append((0, conv, turn, i, call, name, arguments, depends, None))
            elif held:
                for i, x in enumerate(held[1]):
                    content = x.get("content")
                    rows.append((1, conv, turn, i, named(x.get("id", x.get("tool_call_id"))), None, None, None, named(content) if isinstance(content, str) else canonical(content)))
            elif role in ("user", "system"):
                depends = [str(turn - 2)] if turn is not None and turn >= 2 else []
                rows.append((0, conv, turn, 0, None if turn is None else str(turn), "reply", canonical({} if text is None else {"text": text}), depends, None))
            else:
                rows.append((1, conv, turn, 0, None if turn is None else str(turn - 1), None, None, None, text))
        yield _batch(rows, _KINDS, _ROWS)


def extract(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of conversations (conv_id, turn, role, text), written once.

    A text that is {"tool_calls": [{"id", "name", "arguments", "depends_on"?}, ...]} holds calls (or {"function": {"name",
    "arguments"}} in place of the two), one that is {"tool_results": [{"id" or "tool_call_id", "content"}, ...]} results;
    other members are passed over, fields of any JSON type are taken as text where a text is due, a null or missing
    identifier links with nothing. Any other text, malformed, deeper than MOST_DEPTH or however long, is plain: a user or
    system turn calls the tool "reply" with its text under the identifier "turn", and depends on the call that the turn
    before it may answer, "turn - 2"; an assistant turn is the result for the identifier of the turn before.
    """
    picked = messages.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    found = cut(picked.mapInArrow(_extracted, _ROWS))
    calls = found.where("kind = 0").select("conv_id", "turn", "part", "call_id", "name", "arguments", "depends")
    return calls, found.where("kind = 1").select("conv_id", "turn", "part", "call_id", "content")


def _batch(rows: list[tuple], kinds: tuple, schema: str) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in schema.split(", ")])


_LEVELS = "conv_id long, call_id string, level long, cyclic boolean"
_LEVEL_KINDS = (pa.int64(), pa.string(), pa.int64(), pa.bool_())


def _peeled(edges: list[tuple[str, str]]) -> list[tuple[str, int, bool]]:
    """(call, level, cyclic) of the calls of one conversation that depend on others, from its pairs (call, what it depends on)."""
    above, left, level = defaultdict(list), defaultdict(int), {}
    for call, on in edges:
        above[on].append(call)
        left[call] += 1
        level[call] = level[on] = 0
    ready = [c for c in level if not left[c]]
    while ready:
        on = ready.pop()
        for call in above[on]:
            level[call] = max(level[call], level[on] + 1)
            left[call] -= 1
            if not left[call]:
                ready.append(call)
    return [(c, n if not left[c] else None, left[c] > 0) for c, n in level.items() if n or left[c]]


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation, TASK_EDGES of one at most."""
    conv, edges = None, []
    for b in batches:
        rows = []
        for c, call, on in zip(*(x.to_pylist() for x in b.columns)):
            if c != conv:
                rows += [(conv, *r) for r in _peeled(edges)]
                conv, edges = c, []
            edges.append((call, on))
        yield _batch(rows, _LEVEL_KINDS, _LEVELS)
    yield _batch([(conv, *r) for r in _peeled(edges)], _LEVEL_KINDS, _LEVELS)


def _by_rounds(known: DataFrame) -> DataFrame:
    """Levels of conversations of any size. Chains of calls with one dependency shrink by pointer jumping, in as many rounds
    as their length has binary digits; calls with several are then settled once all that they lead to are, a round for each
    such call on the longest chain. What never settles lies on a cycle or beyond one.
    """
    row = ["conv_id", "call_id"]
    counted = cut(known.groupBy(*row).agg(F.count("*").alias("n"), F.min("on").alias("to")))
    now = Cut(counted.where("n = 1").select(*row, "to", F.lit(1).cast("long").alias("d")))
    for _ in range(now.df.count().bit_length() + 1):
        ahead = now.df.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("next"), F.col("d").alias("more"))
        after = Cut(now.df.join(ahead, ["conv_id", "to"], "left").select(*row, F.coalesce("next", "to").alias("to"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d")))
        now.drop()
        now = after
    single = now.df
    leads = known.join(counted.where("n > 1").select(*row), row, "left_semi").join(single.select("conv_id", F.col("call_id").alias("on"), "to", "d"), ["conv_id", "on"], "left")
    leads = leads.select(*row, F.coalesce("to", "on").alias("to"), (F.coalesce("d", F.lit(0)) + 1).alias("w"))
    closed = counted.select("conv_id", F.col("call_id").alias("to"), F.lit(True).alias("waits"))  # roots alone are settled at first
    open_, settled = Cut(leads.join(closed, ["conv_id", "to"], "left").select(*row, "to", "w", F.when(F.col("waits").isNull(), F.lit(0).cast("long")).alias("level"))), []
    while True:
        done = cut(open_.df.groupBy(*row).agg(F.max(F.col("level") + F.col("w")).alias("level"), F.count_if(F.col("level").isNull()).alias("left")).where("left = 0").select(*row, "level"))
        if done.isEmpty():
            break
        settled.append(done)
        ready = done.select("conv_id", F.col("call_id").alias("to"), F.col("level").alias("found"))
        after = Cut(open_.df.join(done, row, "left_anti").join(ready, ["conv_id", "to"], "left").select(*row, "to", "w", F.coalesce("level", "found").alias("level")))
        open_.drop()
        open_ = after
    several = known.sparkSession.createDataFrame([], "conv_id long, call_id string, level long")
    for done in settled:
        several = several.unionByName(done)
    several = cut(several)
    ends = several.select("conv_id", F.col("call_id").alias("to"), "level", F.lit(False).alias("stuck"))
    ends = counted.select("conv_id", F.col("call_id").alias("to")).join(ends, ["conv_id", "to"], "left").select("conv_id", "to", "level", F.coalesce("stuck", F.lit(True)).alias("stuck"))
    ones = single.join(ends, ["conv_id", "to"], "left").select(*row, F.when(~F.coalesce("stuck", F.lit(False)), F.coalesce("level", F.lit(0)) + F.col("d")).alias("level"))
    never = counted.where("n > 1").select(*row).join(several, row, "left_anti").select(*row, F.lit(None).cast("long").alias("level"))
    return ones.unionByName(several).unionByName(never).withColumn("cyclic", F.col("level").isNull())


def levels(calls: DataFrame) -> DataFrame:
    """calls with level (calls on the longest chain of dependencies before it; null if cyclic) and cyclic (on a cycle or beyond one).

    Dependencies are hash-joined to the calls they name; unknown ones count for nothing. A conversation of up to
    TASK_EDGES of them is sorted in one task, others in rounds of joins.
    """
    edges = calls.select("conv_id", "call_id", F.explode("depends").alias("on")).where("call_id is not null").distinct()
    known = cut(edges.join(calls.select("conv_id", F.col("call_id").alias("on")).distinct(), ["conv_id", "on"]).select("conv_id", "call_id", "on"))
    # conversations of over TASK_EDGES dependencies: at most one for so many rows
    large = cut(known.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > TASK_EDGES).select("conv_id"))
    some = not large.isEmpty()
    few = known.join(F.broadcast(large), "conv_id", "left_anti") if some else known
    found = few.repartition("conv_id").sortWithinPartitions("conv_id").mapInArrow(_sorted, _LEVELS)
    if some:
        found = found.unionByName(_by_rounds(known.join(F.broadcast(large), "conv_id", "left_semi")))
    both = calls.join(found, ["conv_id", "call_id"], "left").withColumn("cyclic", F.coalesce("cyclic", F.lit(False)))
    return both.withColumn("level", F.when(~F.col("cyclic"), F.coalesce("level", F.lit(0).cast("long"))))


def link(calls: DataFrame, results: DataFrame, schemas: dict | None = None) -> DataFrame:
    """One row for each call and for each identifier of results without one: conv_id, level, turn, part, call_id, status, n_results, faults, json.

    status: linked, unanswered (no result) or orphan (no call); rows in order of (level, turn, part) are topologically
    ordered, those of a cycle have no level. faults: what the arguments violate of their tool's schema, "unknown tool",
    "cyclic", or null for orphans. json: the call with its first result (by turn, part, content) in canonical form.
    Null identifiers never link; every call of a repeated identifier links to the first result, n_results counts all.
    Null texts: arguments {} or a null content. An empty table gives no rows; other columns are ignored.
    """
    schemas = SCHEMAS if schemas is None else schemas
    first = results.groupBy("conv_id", "call_id").agg(F.count("*").alias("n_results"), F.min(F.struct("turn", "part", "content")).alias("r"))
    both = levels(calls).withColumn("called", F.lit(True)).join(first, ["conv_id", "call_id"], "full_outer")
    flat = both.select("conv_id", "level", F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.coalesce("turn", F.col("r.turn")).alias("turn"), F.coalesce("part", F.col("r.part")).alias("part"), "call_id", F.coalesce("n_results", F.lit(0)).alias("n_results"), "called", "name", "arguments", "depends", F.col("r.content").alias("content"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for conv, level, cyclic, turn, part, call, n, called, name, arguments, depends, content in zip(*(c.to_pylist() for c in b.columns)):
                if not called:
                    rows.append((conv, 0, turn, part, call, "orphan", n, None, canonical({"id": call, "result": content})))
                    continue
                value = json.loads(arguments)
                wrong = faults(value, schemas[name]) if name in schemas else ["unknown tool"]
                wrong += ["cyclic"] if cyclic else []
                whole = {"arguments": value, "id": call, "name": name} | ({"depends_on": depends} if depends else {}) | ({"result": content} if n else {})
                rows.append((conv, level, turn, part, call, "linked" if n else "unanswered", n, "; ".join(wrong), canonical(whole)))
            yield _batch(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()), _LINKED)

    return flat.mapInArrow(write, _LINKED)


_LINKED = "conv_id long, level long, turn long, part int, call_id string, status string, n_results long, faults string, json string"


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = extract(table(spark, sf_dir, "conversations"))
    return link(calls, results)


ORACLE_SQL = r"""
WITH c AS (SELECT conv_id, turn, CAST(turn AS VARCHAR) AS call_id, text FROM conversations WHERE role IN ('user', 'system')),
v AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn - 2 * k ORDER BY turn) - 1 AS level
  FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS k FROM (SELECT DISTINCT conv_id, turn FROM c))),
r AS (SELECT conv_id, CAST(turn - 1 AS VARCHAR) AS call_id, count(*) AS n, min(turn) AS turn, arg_min(text, turn) AS content FROM conversations WHERE role NOT IN ('user', 'system') GROUP BY ALL),
j AS (SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.turn, r.turn) AS turn, coalesce(c.call_id, r.call_id) AS call_id,
  CASE WHEN c.call_id IS NULL THEN 'orphan' WHEN r.call_id IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_results, c.text, r.content, r.call_id AS has FROM c FULL JOIN r ON c.conv_id = r.conv_id AND c.call_id = r.call_id)
SELECT j.conv_id, CAST(coalesce(v.level, 0) AS BIGINT) AS level, j.turn, CAST(0 AS INT) AS part, call_id, status, n_results,
  CASE WHEN status = 'orphan' THEN NULL WHEN text = '' THEN '$.text: length' ELSE '' END AS faults,
  CASE WHEN status = 'orphan' THEN '{"id":"' || call_id || '","result":' || CAST(to_json(content) AS VARCHAR) || '}'
    ELSE '{"arguments":{"text":' || CAST(to_json(text) AS VARCHAR) || '}' || CASE WHEN j.turn >= 2 THEN ',"depends_on":["' || (j.turn - 2) || '"]' ELSE '' END
      || ',"id":"' || call_id || '","name":"reply"' || CASE WHEN has IS NULL THEN '' ELSE ',"result":' || CAST(to_json(content) AS VARCHAR) END || '}' END AS json
FROM j LEFT JOIN v ON j.conv_id = v.conv_id AND j.turn = v.turn AND j.status <> 'orphan'
"""
