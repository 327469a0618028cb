"""Tool-call linking, in DataFrame and SQL functions only.

Calls and results are hash-joined by identifier, calls are ordered so that each comes after those it depends on, arguments
are validated against the schema of their tool, and each call becomes one line of canonical JSON: sorted keys, no white
space, one spelling for each string and one for each number. A number is spelled from its source text, so no digit is lost:
as a plain decimal without needless zeros where that takes at most ``PLAIN`` digits, else as whole digits with an exponent.

Scale: repeated identifiers are merged before the join, so an identifier that many results carry costs one row a task.
Calls with a single dependency are settled by pointer doubling, in rounds that grow with the logarithm of a chain's
length; peeling, a round for each level, is left to the calls with several. Each round is written to the shared folder.
Places in a conversation are counted in blocks with offsets, so a conversation with a third of all rows is no single task's work.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docrec.llm.common import new_folder, stored, table

BLOCK = 256
PLAIN = 64
FIELDS = "array<struct<field:string,types:array<string>,required:boolean,minimum:double,maximum:double,above:double,below:double,min_length:int,max_length:int,choices:array<string>>>"
#: Keywords of JSON schemas that are checked, and those that say nothing about validity.
CHECKED = frozenset("type minimum maximum exclusiveMinimum exclusiveMaximum minLength maxLength enum const".split())
NOTES = frozenset("title description default examples $schema $id $comment deprecated".split())

#: The tools of the registered query, as JSON schemas.
TOOLS = {
    "search": {"properties": {"text": {"type": "string", "maxLength": 300}, "limit": {"type": "integer", "minimum": 1, "maximum": 20}}, "required": ["text", "limit"], "additionalProperties": False},
    "summarize": {"properties": {"text": {"type": "string", "minLength": 100}, "percent": {"type": "integer", "minimum": 10, "maximum": 50}}, "required": ["text"], "additionalProperties": False},
    "translate": {"properties": {"text": {"type": "string"}, "target": {"type": "string", "enum": ["en", "fr"]}}, "required": ["text", "target"], "additionalProperties": False},
}


def schema_table(spark: SparkSession, tools: dict[str, dict]) -> DataFrame:
    """JSON schemas of objects as one row a tool: ``name, fields, closed``. A keyword that is not checked (``pattern``, nested properties and the like) is an error, not passed over."""
    rows = []
    for name, schema in tools.items():
        if odd := set(schema) - {"type", "properties", "required", "additionalProperties"} - NOTES or schema.get("type", "object") != "object" or schema.get("additionalProperties", True) not in (True, False):
            raise ValueError(f"{name}: unsupported schema: {odd}")
        need, fields = set(schema.get("required", ())), []
        for f, s in sorted((dict.fromkeys(need, {}) | schema.get("properties", {})).items()):
            if odd := set(s) - CHECKED - NOTES:
                raise ValueError(f"{name}.{f}: unsupported keywords: {sorted(odd)}")
            types, choices = s.get("type"), [*s.get("enum", ()), *([s["const"]] if "const" in s else ())]
            if "const" in s and "enum" in s:
                choices = [s["const"]] if s["const"] in s["enum"] else []
            own = {"field": f, "types": [types] if isinstance(types, str) else types, "required": f in need, "minimum": s.get("minimum"), "maximum": s.get("maximum"), "above": s.get("exclusiveMinimum"), "below": s.get("exclusiveMaximum")}
            fields.append(own | {"min_length": s.get("minLength"), "max_length": s.get("maxLength"), "choices": [json.dumps(c) for c in choices] if "enum" in s or "const" in s else None})
        rows.append((name, json.dumps(fields), schema.get("additionalProperties", True) is False))
    read = spark.createDataFrame(rows, "name string, fields string, closed boolean").select("name", F.from_json("fields", FIELDS).alias("fields"), "closed")
    spelled = lambda f: f.withField("choices", F.transform(f["choices"], lambda c: untagged(F.to_json(parsed(c)))))
    return read.withColumn("fields", F.transform("fields", spelled))


NUMBER = r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"


def spelled_number(token: Column) -> Column:
    """The one spelling of a JSON number. One whose exponent has more than nine digits stays as it is written."""
    part = lambda k: F.regexp_extract(token, r"^(-?)([0-9]+)(?:\.([0-9]+))?(?:[eE]([-+]?[0-9]+))?$", k)
    digits = F.regexp_replace(F.concat(part(2), part(3)), "^0+", "")
    whole = F.regexp_replace(digits, "0+$", "")
    power = F.coalesce(part(4).try_cast("long"), F.lit(0)) - F.length(part(3)) + F.length(digits) - F.length(whole)
    n = F.length(whole)
    power_, n_ = power.cast("int"), n.cast("int")
    zeros = lambda k: F.repeat(F.lit("0"), k)
    inside = F.concat(F.substring(whole, F.lit(1), n_ + power_), F.lit("."), F.substring(whole, n_ + power_ + 1, n_))
    plain = F.when(power >= 0, F.concat(whole, zeros(power_))).when(n + power > 0, inside).otherwise(F.concat(F.lit("0."), zeros(-power_ - n_), whole))
    size = F.greatest(n, n + power, 1 - power)
    value = F.when(size <= PLAIN, plain).otherwise(F.concat(whole, F.lit("E"), power.cast("string")))
    return F.when(F.regexp_like(part(4), F.lit("[0-9]{10}")), token).when(whole == "", F.lit("0")).otherwise(F.concat(part(1), value))


def tagged(text: Column) -> Column:
    """JSON text with ``$`` before each string's content and each number as a string of ``#`` and its spelling, so that parsing and printing keep both as they are. Text that is no JSON stays none."""
    plain = F.replace(F.replace(text, F.lit("\\\\"), F.lit("\x01")), F.lit('\\"'), F.lit("\x02"))  # no quotes within strings from here on
    tokens = lambda s: F.regexp_extract_all(s, F.lit(f"{NUMBER}|[^0-9-]+|[0-9-]"), F.lit(0))
    number = lambda t: F.when(F.regexp_like(t, F.lit("^-?[0-9]")), F.concat(F.lit('"#'), spelled_number(t), F.lit('"'))).otherwise(t)
    outside = lambda s: F.when(F.regexp_like(s, F.lit("[0-9-]")), F.array_join(F.transform(tokens(s), number), "")).otherwise(s)
    parts = F.transform(F.split(plain, '"'), lambda s, k: F.when(k % 2 == 0, outside(s)).otherwise(F.concat(F.lit("$"), s)))
    whole = F.replace(F.replace(F.array_join(parts, '"'), F.lit("\x02"), F.lit('\\"')), F.lit("\x01"), F.lit("\\\\"))
    return F.when(~F.regexp_like(text, F.lit("[\\x01\\x02]")), whole)  # raw control characters are no JSON


def parsed(text: Column) -> Column:
    """The variant of a whole JSON text with tagged strings and numbers, null if it is none. The parser reads one value and passes over what follows, so the text stands before a mark, an untagged string, that must come next."""
    both = F.try_parse_json(F.concat(F.lit("["), tagged(text), F.lit(',"!"]')))
    return F.when(F.try_variant_get(both, "$[1]", "string") == "!", F.try_variant_get(both, "$[0]", "variant"))


def untagged(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r'(?<!\\)"#([^"]*)"', "$1"), r'(?<!\\)"[$]', '"')


#: What is wrong with one field's value (null: absent), as ``field:rule``; null if nothing is. ``s`` is a string or number with its tag.
CHECK = """
transform(transform(fields, f -> struct(f, args[concat('$', f.field)] AS v)), x -> transform(array(struct(x.f, x.v,
    schema_of_variant(x.v) AS kind, CASE WHEN schema_of_variant(x.v) = 'STRING' THEN try_variant_get(x.v, '$', 'string') ELSE '' END AS s)), y -> CASE
  WHEN y.v IS NULL THEN IF(y.f.required, concat(y.f.field, ':required'), NULL)
  WHEN y.f.types IS NOT NULL AND NOT exists(y.f.types, t -> CASE t
      WHEN 'integer' THEN y.s RLIKE '^#-?[0-9]+(E[0-9]+)?$'
      WHEN 'number' THEN y.s LIKE '#%'
      WHEN 'string' THEN y.s LIKE '$%'
      WHEN 'boolean' THEN y.kind = 'BOOLEAN'
      WHEN 'array' THEN y.kind LIKE 'ARRAY%'
      WHEN 'object' THEN y.kind LIKE 'OBJECT%'
      WHEN 'null' THEN y.kind = 'VOID'
      ELSE false END) THEN concat(y.f.field, ':type')
  WHEN y.s LIKE '#%' AND try_cast(substr(y.s, 2) AS double) < y.f.minimum THEN concat(y.f.field, ':minimum')
  WHEN y.s LIKE '#%' AND try_cast(substr(y.s, 2) AS double) > y.f.maximum THEN concat(y.f.field, ':maximum')
  WHEN y.s LIKE '#%' AND try_cast(substr(y.s, 2) AS double) <= y.f.above THEN concat(y.f.field, ':exclusiveMinimum')
  WHEN y.s LIKE '#%' AND try_cast(substr(y.s, 2) AS double) >= y.f.below THEN concat(y.f.field, ':exclusiveMaximum')
  WHEN y.s LIKE '$%' AND length(y.s) - 1 < y.f.min_length THEN concat(y.f.field, ':minLength')
  WHEN y.s LIKE '$%' AND length(y.s) - 1 > y.f.max_length THEN concat(y.f.field, ':maxLength')
  WHEN y.f.choices IS NOT NULL AND NOT array_contains(y.f.choices, UNTAGGED) THEN concat(y.f.field, ':enum')
  END)[0])
"""


def json_string(c: Column) -> Column:
    """A string as a JSON string."""
    whole = F.to_json(F.array(c))
    return F.when(c.isNull(), F.lit("null")).otherwise(F.substring(whole, F.lit(2), F.length(whole) - 2))


def chains(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``call_id, at, steps`` of the calls with one dependency: the first call on the way back that has none or several, by pointer doubling. On a cycle, or behind one, ``at`` is null."""
    one = edges.groupBy("call_id").agg(F.count("*").alias("n"), F.min("on").alias("at")).where("n = 1")
    ahead = stored(one.select("call_id", "at", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("open")), "calls-chains")
    left = ahead.count()
    reach = 1
    while left and reach <= 2 * left:  # whoever is still on the way after as many steps as there are calls goes round
        on = ahead.where("open").select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("open").alias("goes_on"))
        back = ahead.select(F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), "open")
        moved = ahead.where("open").drop("open").join(back, "at", "left")
        moved = moved.select("call_id", F.coalesce("next", "at").alias("at"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.coalesce("open", F.lit(False)).alias("open"))
        ahead = stored(moved.unionByName(ahead.where("NOT open")), "calls-chains")
        reach *= 2
        if ahead.where("open").isEmpty():
            break
    return ahead.select("call_id", F.when(~F.col("open"), F.col("at")).alias("at"), "steps")


def levels(calls: DataFrame) -> DataFrame:
    """``call_id, depends_on`` -> ``call_id, level``: 0 without dependencies among the calls, else one more than the highest of them. Calls on a cycle, or behind one, get no row."""
    spark = calls.sparkSession
    nodes = stored(calls.select("call_id").distinct(), "calls-nodes")
    edges = calls.select("call_id", F.explode("depends_on").alias("on")).where("on IS NOT NULL").distinct()
    edges = stored(edges.join(nodes.select(F.col("call_id").alias("on")), "on", "left_semi"), "calls-edges")
    alone = stored(chains(nodes, edges), "calls-alone")
    several = stored(edges.groupBy("call_id").count().where("count > 1").select("call_id"), "calls-several")
    roots = nodes.join(edges.select("call_id").distinct(), "call_id", "left_anti").select("call_id", F.lit(0).cast("long").alias("level"))

    # Edges of the calls with several dependencies lead to the ends of the chains behind them.
    ways = edges.join(several, "call_id", "left_semi").join(alone.select(F.col("call_id").alias("on"), "at", "steps", F.lit(True).alias("chained")), "on", "left")
    to = F.when(F.col("chained"), F.col("at")).otherwise(F.col("on"))
    ways = ways.select("call_id", to.alias("on"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps"))
    waiting = stored(ways.join(several.select(F.col("call_id").alias("on"), F.lit(True).alias("waits")), "on", "left").select("call_id", "on", "steps", (F.col("on").isNull() | F.coalesce("waits", F.lit(False))).alias("waits")), "calls-ways")
    reached = stored(several.join(waiting.where("NOT waits").groupBy("call_id").agg(F.max("steps").alias("level")), "call_id", "left"), "calls-reached")
    waiting = stored(waiting.where("waits").drop("waits"), "calls-ways")
    base, turn = new_folder(spark, "calls-levels"), 0
    while True:
        ready = reached.join(waiting.select("call_id").distinct(), "call_id", "left_anti")
        ready.write.parquet(f"{base}/turn={turn}")  # one folder a round, all read at the end
        ready = spark.read.schema(reached.schema).parquet(f"{base}/turn={turn}")
        if ready.isEmpty():
            break
        gone = waiting.join(ready.select(F.col("call_id").alias("on"), "level"), "on").groupBy("call_id").agg(F.max(F.col("level") + F.col("steps")).alias("more"))
        later = reached.join(ready.select("call_id"), "call_id", "left_anti").join(gone, "call_id", "left")
        reached = stored(later.select("call_id", F.greatest("level", "more").alias("level")), "calls-reached")
        waiting = stored(waiting.join(ready.select(F.col("call_id").alias("on")), "on", "left_anti"), "calls-ways")
        turn += 1
    settled = roots.unionByName(spark.read.schema(reached.schema).parquet(f"{base}/turn=*"))
    behind = alone.join(settled.select(F.col("call_id").alias("at"), "level"), "at").select("call_id", (F.col("level") + F.col("steps")).alias("level"))
    return settled.unionByName(behind).select("call_id", F.col("level").cast("int").alias("level"))


def linked(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Link ``calls (conv_id, call_id, turn, name, arguments, depends_on)`` with ``results (call_id, turn, content)`` under ``schemas (name, fields)``.

    Returns one row per call identifier: ``conv_id, call_id, turn, name, level, position, n_calls, n_results, valid, errors,
    line``. ``position`` counts from 0 in each conversation, by level, then turn, then identifier; ``line`` is the call with
    its arguments and result as canonical JSON. ``errors`` lists ``field:rule`` (a rule is tried only on values of its
    own type), ``field:unknown`` where the schema allows no further properties, ``arguments:json`` for text that is no JSON object, ``name:unknown``, ``result:missing`` and ``depends_on:cycle``, sorted and joined by commas.

    * of calls, or of results, that repeat an identifier the one with the smallest (turn, text) is taken; all are counted
    * calls without an identifier cannot be linked and are left out; results without a call are not returned
    * a dependency on a call that is not there is no dependency; calls on a cycle have no level and come last
    * empty tables give an empty result; other columns, whatever their names, are not read
    """
    calls = calls.where("call_id IS NOT NULL").select("conv_id", "call_id", "turn", "name", "arguments", "depends_on")
    first = F.min(F.struct("turn", "arguments", "name", "conv_id", "depends_on"))
    calls = stored(calls.groupBy("call_id").agg(first.alias("c"), F.count("*").alias("n_calls")).select("call_id", "c.*", "n_calls"), "calls")
    answers = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("turn", "content"))["content"].alias("result"), F.count("*").alias("n_results"))
    order = levels(calls.select("call_id", "depends_on"))

    read = calls.join(schemas, "name", "left").withColumn("doc", parsed(F.col("arguments")))
    read = read.withColumn("args", F.expr("try_variant_get(doc, '$', 'map<string,variant>')"))
    unknown = F.expr("IF(closed, transform(array_except(map_keys(args), transform(fields, f -> concat('$', f.field))), k -> concat(substr(k, 2), ':unknown')), array())")
    check = F.expr(CHECK.replace("UNTAGGED", r"""regexp_replace(regexp_replace(to_json(y.v), '(?<!\\\\)"#([^"]*)"', '$1'), '(?<!\\\\)"[$]', '"')"""))
    wrong = F.when(F.col("fields").isNull(), F.array(F.lit("name:unknown"))).when(F.col("args").isNull(), F.array(F.lit("arguments:json"))).otherwise(F.concat(check, unknown))
    checked = read.select("call_id", "conv_id", "turn", "name", "n_calls", F.array_compact(wrong).alias("wrong"), F.coalesce(untagged(F.to_json("doc")), json_string(F.col("arguments"))).alias("canonical"))

    rows = checked.join(answers, "call_id", "left").join(order, "call_id", "left")
    errors = F.concat("wrong", F.when(F.col("n_results").isNull(), F.array(F.lit("result:missing"))).otherwise(F.array()), F.when(F.col("level").isNull(), F.array(F.lit("depends_on:cycle"))).otherwise(F.array()))
    rows = rows.withColumn("errors", F.array_join(F.sort_array(errors), ","))
    parts = (("arguments", F.col("canonical")), ("errors", json_string(F.col("errors"))), ("id", json_string(F.col("call_id"))), ("name", json_string(F.col("name"))), ("result", json_string(F.col("result"))))
    line = F.concat(F.lit("{"), *(F.concat(F.lit(f'{"," if k else ""}"{key}":'), value) for k, (key, value) in enumerate(parts)), F.lit("}"))
    rows = rows.select("conv_id", "call_id", "turn", "name", "level", "n_calls", F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"), (F.col("errors") == "").alias("valid"), "errors", line.alias("line"))
    rows = stored(rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1))), "calls-linked")

    cells = rows.groupBy("conv_id", "level", "block").agg(F.count("*").alias("n"))
    by_level = Window.partitionBy("conv_id").orderBy(F.col("level").asc_nulls_last(), "block")
    cells = stored(cells.withColumn("ahead", F.sum("n").over(by_level) - F.col("n")), "calls-cells")
    own = cells.select(F.col("conv_id").alias("c"), F.col("level").alias("l"), F.col("block").alias("b"), "ahead")
    placed = rows.join(own, rows["conv_id"].eqNullSafe(own["c"]) & rows["level"].eqNullSafe(own["l"]) & (rows["block"] == own["b"]))
    within = Window.partitionBy("conv_id", "level", "block").orderBy("turn", "call_id")
    position = (F.col("ahead") + F.row_number().over(within) - 1).cast("long")
    return placed.select("conv_id", "call_id", "turn", "name", "level", position.alias("position"), "n_calls", "n_results", "valid", "errors", "line")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results from the conversations table, which has none of its own: every user turn asks a tool, and the assistant turn after it is the result.

    The tool follows from conversation and turn, the arguments from the turn's text. A call depends on up to two earlier
    user turns of its conversation, about half and a third of the way to it.
    """
    ident = lambda turn: F.concat_ws(":", F.col("conv_id"), turn)
    t, text = F.col("turn"), json_string(F.coalesce("text", F.lit("")))
    tool = F.pmod(F.col("conv_id") + F.floor(t / 2), F.lit(3))
    name = F.element_at(F.array(*map(F.lit, sorted(TOOLS))), (tool + 1).cast("int"))
    n = F.length(F.coalesce("text", F.lit("")))
    other = (
        F.when(tool == 0, F.concat(F.lit('"limit": '), (n % 25).cast("string")))
        .when(tool == 1, F.concat(F.lit('"percent": '), (t % 8 * 10).cast("string")))
        .otherwise(F.concat(F.lit('"target": "'), F.element_at(F.array(F.lit("en"), F.lit("de"), F.lit("fr")), (t % 3 + 1).cast("int")), F.lit('"')))
    )
    arguments = F.concat(F.lit('{"text": '), text, F.lit(", "), other, F.lit("}"))
    earlier = [F.floor(t / (2 * k)) * 2 + t % 2 for k in (2, 3)]
    depends = F.array_distinct(F.array_compact(F.array(*(F.when(e < t, ident(e)) for e in earlier))))
    calls = turns.where("role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL").select("conv_id", ident(t).alias("call_id"), "turn", name.alias("name"), arguments.alias("arguments"), depends.alias("depends_on"))
    results = turns.where("role = 'assistant' AND conv_id IS NOT NULL AND turn IS NOT NULL").select(ident(t - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def query(spark, sf_dir):
    calls, results = conversation_calls(table(spark, sf_dir, "conversations"))
    return linked(calls, results, schema_table(spark, TOOLS))


ORACLE = """
WITH RECURSIVE u AS (
  SELECT conv_id, turn, min(coalesce(text, '')) AS text, count(*) AS n_calls FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL
), c AS (
  SELECT *, conv_id || ':' || turn AS call_id, (conv_id + turn // 2) % 3 AS tool, length(text) AS n,
    turn // 4 * 2 + turn % 2 AS a, turn // 6 * 2 + turn % 2 AS b FROM u
), e AS (
  SELECT x.call_id, y.call_id AS dep FROM c x JOIN c y ON x.conv_id = y.conv_id AND (y.turn = x.a OR y.turn = x.b) AND y.turn < x.turn
), p(call_id, level) AS (
  SELECT call_id, 0 FROM c UNION SELECT e.call_id, p.level + 1 FROM p JOIN e ON p.call_id = e.dep
), l AS (
  SELECT call_id, max(level)::INT AS level FROM p GROUP BY call_id
), r AS (
  SELECT conv_id, turn - 1 AS turn, min(text) AS result, count(*) AS n_results FROM conversations WHERE role = 'assistant' GROUP BY ALL
), j AS (
  SELECT c.*, level, r.result, coalesce(n_results, 0) AS n_results, ['search', 'summarize', 'translate'][tool + 1] AS name,
    CASE tool WHEN 0 THEN '{"limit":' || (n % 25) || ',"text":' || to_json(text) || '}'
      WHEN 1 THEN '{"percent":' || (c.turn % 8 * 10) || ',"text":' || to_json(text) || '}'
      ELSE '{"target":"' || ['en', 'de', 'fr'][c.turn % 3 + 1] || '","text":' || to_json(text) || '}' END AS canonical,
    list_sort(list_filter([
      CASE WHEN tool = 0 AND n % 25 < 1 THEN 'limit:minimum' WHEN tool = 0 AND n % 25 > 20 THEN 'limit:maximum' END,
      CASE WHEN tool = 0 AND n > 300 THEN 'text:maxLength' WHEN tool = 1 AND n < 100 THEN 'text:minLength' END,
      CASE WHEN tool = 1 AND c.turn % 8 * 10 < 10 THEN 'percent:minimum' WHEN tool = 1 AND c.turn % 8 * 10 > 50 THEN 'percent:maximum' END,
      CASE WHEN tool = 2 AND c.turn % 3 = 1 THEN 'target:enum' END,
      CASE WHEN n_results IS NULL THEN 'result:missing' END], lambda x: x IS NOT NULL)) AS wrong
  FROM c JOIN l ON c.call_id = l.call_id LEFT JOIN r ON c.conv_id = r.conv_id AND c.turn = r.turn
), f AS (
  SELECT *, array_to_string(wrong, ',') AS errors FROM j
)
SELECT conv_id, call_id, turn, name, level, row_number() OVER (PARTITION BY conv_id ORDER BY level, turn, call_id) - 1 AS position, n_calls, n_results,
  errors = '' AS valid, errors,
  '{"arguments":' || canonical || ',"errors":' || to_json(errors) || ',"id":' || to_json(call_id) || ',"name":' || to_json(name) || ',"result":' || coalesce(to_json(result), 'null') || '}' AS line
FROM f
"""
