"""Operator 4 [native]: chat formatting with tool-call linking.

Only DataFrame functions. Messages are rows (conv_id, turn, role, text). A text that is a JSON object with
``tool_calls: [{id, name, arguments, depends_on}]`` holds calls (name and arguments may lie in a ``function`` object), and
its ``content``, if any, is a plain message of its own before them (pos -1); one with ``tool_call_id`` is a result; any other text is
a plain message. The output has one row per item (plain message, call, result); a conversation is never gathered:

* results are hash-joined to calls on (conv_id, call id), so a huge conversation spreads by its identifiers;
* calls are ordered topologically: a call comes after the results of the calls it depends on, a result after its call.
  ``depth`` is the longest chain of dependencies before an item (calls even, results odd) and ``order_turn`` the turn it
  sorts at; ORDER BY order_turn, depth, turn, pos is a topological order that keeps turns otherwise;
* arguments are validated against the tool's schema (JSON Schema: type, enum, properties, required, additionalProperties,
  items, at every depth); ``errors`` lists what fails. Schemas come from a table of tools and from the conversation's own
  system messages that are JSON objects with ``tools: [{name, parameters}]`` or ``tools: [{function: {...}}]``, which go first;
* ``canonical`` is the item as JSON with keys sorted at every depth and no white space.

``status``: ok; unanswered (a call without a result); orphan (a result without a call); duplicate (a later call or result
of an identifier already taken; it is linked to nothing); cycle (a call that depends on itself through others, or on one
that does; its depth is null); unknown_dependency is reported in errors and does not hold a call back.

Edge cases: null texts are plain messages with null content; texts that are not JSON, or JSON without those keys, are
plain; items of a null conv_id are linked to nothing; repeated rows are items each (repeated calls are duplicates); ties go to the smaller
turn, then position, then text; a missing or unknown tool schema is no error but `known_tool` is false; empty tables give
empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

CALLS = "array<struct<id: string, name: string, arguments: variant, depends_on: array<string>, function: struct<name: string, arguments: variant>>>"
OFFERED = "array<struct<name: string, parameters: variant, function: struct<name: string, parameters: variant>>>"
NO_TOOLS = "name string, schema string"


def _kept(df: DataFrame) -> DataFrame:
    """As `common.kept`, with variants written as JSON text: written as such, a file may hold 1 as 1.0 where it meets 1.5."""
    variants = [f.name for f in df.schema if f.dataType.typeName() == "variant"]
    out = c.kept(df.withColumns({x: F.to_json(x) for x in variants}))
    return out.withColumns({x: F.try_parse_json(x) for x in variants})


def items(messages: DataFrame) -> DataFrame:
    """One row per plain message, call or result: kind, call_id, name, args (variant), deps, content."""
    m = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    # only texts that may be such an object are parsed
    may = F.col("text").rlike(r'^\s*\{') & (F.contains("text", F.lit('"tool_calls"')) | F.contains("text", F.lit('"tool_call_id"')))
    m = m.withColumn("v", F.when(may, F.try_parse_json("text")))
    m = m.withColumn("calls", F.expr(f"try_variant_get(v, '$.tool_calls', '{CALLS}')")).withColumn("result_id", F.expr("try_variant_get(v, '$.tool_call_id', 'string')"))
    is_call = F.size(F.coalesce("calls", F.expr(f"cast(array() as {CALLS})"))) > 0
    base = ["conv_id", "turn", "role"]
    calls = m.where(is_call).select(*base, F.posexplode("calls").alias("pos", "call"))
    calls = calls.withColumn("given", F.coalesce("call.arguments", "call.function.arguments"))
    calls = calls.select(
        *base, F.col("pos").cast("long").alias("pos"), F.lit("call").alias("kind"), F.col("call.id").alias("call_id"), F.coalesce("call.name", "call.function.name").alias("name"),
        F.coalesce(F.expr("case when schema_of_variant(given) = 'STRING' then try_parse_json(cast(given as string)) end"), F.col("given")).alias("args"),
        F.coalesce("call.depends_on", F.array().cast("array<string>")).alias("deps"), F.lit(None).cast("string").alias("content"), F.lit(None).cast("string").alias("beside"),
    )
    result = F.col("result_id").isNotNull()
    # what is said beside calls is a message of its own
    said = F.expr("try_variant_get(v, '$.content', 'variant')")
    beside = m.where(is_call & ~result).withColumn("beside", F.to_json(said)).where("beside is not null and beside not in ('null', '\"\"', '[]')")
    beside = beside.select(
        *base, F.lit(-1).cast("long").alias("pos"), F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("variant").alias("args"), F.array().cast("array<string>").alias("deps"), F.lit(None).cast("string").alias("content"), "beside",
    )
    rest = m.where(~is_call | result)
    rest = rest.select(
        *base, F.lit(0).cast("long").alias("pos"), F.when(result, "result").otherwise("message").alias("kind"), F.col("result_id").alias("call_id"),
        F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("args"), F.array().cast("array<string>").alias("deps"),
        F.when(result, F.to_json(F.expr("try_variant_get(v, '$.content', 'variant')"))).otherwise(F.col("text")).alias("content"), F.lit(None).cast("string").alias("beside"),
    )
    return calls.unionByName(beside).unionByName(rest)


def offered_tools(messages: DataFrame) -> DataFrame:
    """(conv_id, name, own_schema): the tools that a conversation's system messages describe; the smallest text of a repeated name."""
    may = F.lower("role").isin("system", "developer") & F.col("text").rlike(r'^\s*\{') & F.contains("text", F.lit('"tools"'))
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).where(may)
    m = m.where("conv_id is not null").select("conv_id", F.explode(F.expr(f"try_variant_get(try_parse_json(text), '$.tools', '{OFFERED}')")).alias("t"))
    m = m.select("conv_id", F.coalesce("t.name", "t.function.name").alias("name"), F.to_json(F.coalesce("t.parameters", "t.function.parameters")).alias("s"))
    m = m.where("name is not null and s is not null").groupBy("conv_id", "name").agg(F.min("s").alias("s"))
    return m.select("conv_id", "name", F.try_parse_json("s").alias("own_schema"))


def _jumps(one: DataFrame) -> DataFrame:
    """Pointers (conv_id, call_id, dep, steps, top) followed to the first call that is not such a pointer itself.

    Every round doubles what a pointer spans; pointers that still find another one when they span more than a
    conversation has run in a circle and are left out.
    """
    most = one.groupBy("conv_id").count().agg(F.max("count")).head()[0] or 0
    span, done = 1, None
    while True:
        one = c.kept(one)
        ahead = one.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("next"), F.col("steps").alias("more"), F.col("top").alias("above"))
        met = one.join(ahead, ["conv_id", "dep"], "left")
        ended = met.where("more is null").select("conv_id", "call_id", "dep", "steps", "top")
        going = met.where("more is not null")
        if span > most or not going.limit(1).count():
            return c.kept(ended)
        one = ended.unionByName(going.select("conv_id", "call_id", F.col("next").alias("dep"), (F.col("steps") + F.col("more")).alias("steps"), F.greatest("top", "above").alias("top")))
        span *= 2


def _depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, after, before_turn) of calls with dependencies: longest chain of calls before each, and the turn that chain needs.

    Chains of calls with one dependency each are jumped by doubling; only calls with several dependencies take a round
    for each level of such calls before them. Calls on a circle, or behind one, have a null `after`.
    """
    spark = calls.sparkSession
    key = ["conv_id", "call_id"]
    own = calls.select("conv_id", F.col("call_id").alias("dep"), F.greatest("turn", F.coalesce("answer_turn", "turn")).alias("top"), F.col("turn").alias("dep_turn"))
    deps = calls.select(*key, F.explode(F.array_distinct("deps")).alias("dep")).join(own, ["conv_id", "dep"])
    if not deps.limit(1).count():
        return spark.createDataFrame([], "conv_id long, call_id string, after long, before_turn long")
    deps = c.kept(deps)
    many = deps.groupBy(key).count()
    several = many.where("count > 1").select(key)
    one = deps.join(many.where("count = 1").select(key), key, "left_semi").select(*key, "dep", F.lit(1).cast("long").alias("steps"), "top")
    jumps = _jumps(one)
    # calls with several dependencies, each followed to a call that has none or several itself; a circle leads nowhere
    edges = deps.join(several, key, "left_semi")
    far = jumps.select("conv_id", F.col("call_id").alias("dep"), F.col("dep").alias("to"), F.col("steps").alias("far"), F.col("top").alias("far_top"))
    circle = one.select("conv_id", F.col("call_id").alias("dep")).join(far.select("conv_id", "dep"), ["conv_id", "dep"], "left_anti").withColumn("lost", F.lit(True))
    edges = edges.join(far, ["conv_id", "dep"], "left").join(circle, ["conv_id", "dep"], "left")
    edges = c.kept(edges.select(*key, F.coalesce("to", "dep").alias("dep"), (F.lit(1) + F.coalesce("far", F.lit(0))).alias("steps"), F.greatest("top", F.coalesce("far_top", "top")).alias("top"), "lost"))
    ends = calls.join(many, key, "left_anti").select(*key, F.lit(0).cast("long").alias("after"), F.col("turn").alias("before_turn"))
    done, waiting = c.kept(ends), calls.join(several, key, "left_semi").select(*key, "turn")
    while True:
        known = done.select("conv_id", F.col("call_id").alias("dep"), "after", "before_turn")
        met = edges.join(known, ["conv_id", "dep"], "left").groupBy(key)
        met = met.agg(F.max(F.col("after") + F.col("steps")).alias("a"), F.max(F.greatest("top", "before_turn")).alias("t"), F.count("*").alias("n"), F.count("after").alias("m"), F.max("lost").alias("lost"))
        new = waiting.join(met.where("n = m and lost is null"), key).join(done, key, "left_anti")
        new = c.kept(new.select(*key, F.col("a").cast("long").alias("after"), F.greatest("turn", "t").alias("before_turn")))
        if not new.limit(1).count():
            break
        done = c.kept(done.unionByName(new))
    anchors = done.select("conv_id", F.col("call_id").alias("dep"), F.col("after").alias("base"), F.col("before_turn").alias("base_turn"))
    chained = calls.select(*key, "turn").join(jumps, key).join(anchors, ["conv_id", "dep"])
    chained = chained.select(*key, (F.col("steps") + F.col("base")).alias("after"), F.greatest("turn", "top", "base_turn").alias("before_turn"))
    out = c.kept(done.join(several, key, "left_semi").unionByName(chained))
    left = calls.join(many, key, "left_semi").join(out, key, "left_anti")
    return out.unionByName(left.select(*key, F.lit(None).cast("long").alias("after"), F.col("turn").alias("before_turn")))


_NONE = "cast(array() as array<string>)"
_KIND = "replace(regexp_extract(schema_of_variant({0}), '^[A-Z]+', 0), 'VOID', 'NULL')"
#: What JSON Schema calls values of each kind.
_TYPES = """case kind when 'STRING' then array('string') when 'BIGINT' then array('integer', 'number') when 'BOOLEAN' then array('boolean')
    when 'OBJECT' then array('object') when 'ARRAY' then array('array') when 'NULL' then array('null') else array('number') end"""


def argument_errors(pairs: DataFrame) -> DataFrame:
    """(pair, errors): what the schema (variant) of each pair refuses of its args (variant); pairs without errors have no row.

    Checked are type (one or several), enum, required, properties, additionalProperties and items, at every depth, one
    round for each level of nesting.
    """
    part = F.col("path")
    level = pairs.select("pair", F.lit("").alias("path"), "schema", F.col("args").alias("value"))
    found = None
    while (level := _kept(level)).limit(1).count():
        level = level.withColumn("kind", F.expr(f"coalesce({_KIND.format('value')}, 'NULL')"))
        level = level.withColumn("props", F.expr("coalesce(try_variant_get(schema, '$.properties', 'map<string, variant>'), cast(map() as map<string, variant>))"))
        level = level.withColumn("given", F.expr("case when kind = 'OBJECT' then try_cast(value as map<string, variant>) end"))
        types = "coalesce(try_variant_get(schema, '$.type', 'array<string>'), array(coalesce(try_variant_get(schema, '$.type', 'string'), case when path = '' then 'object' end)))"
        enum = "try_variant_get(schema, '$.enum', 'array<variant>')"
        at = "concat(path, case when path = '' then '' else '.' end, k)"
        wrong = f"""concat(
            case when path = '' and kind <> 'OBJECT' then array('arguments: not an object')
                 when {types}[0] is not null and not arrays_overlap({types}, {_TYPES}) then array(concat(path, ': wrong type')) else {_NONE} end,
            case when {enum} is not null and not exists({enum}, e -> to_json(e) = coalesce(to_json(value), 'null')) then array(concat(path, ': not one of the allowed')) else {_NONE} end,
            case when given is null then {_NONE} else transform(filter(coalesce(try_variant_get(schema, '$.required', 'array<string>'), {_NONE}), k -> not array_contains(map_keys(given), k)), k -> concat({at}, ': missing')) end,
            case when given is null or coalesce(try_variant_get(schema, '$.additionalProperties', 'boolean'), true) then {_NONE}
                 else transform(filter(map_keys(given), k -> not array_contains(map_keys(props), k)), k -> concat({at}, ': not allowed')) end)"""
        errors = level.select("pair", F.explode(F.expr(wrong)).alias("error"))
        found = errors if found is None else found.unionByName(errors)
        inner = level.where("given is not null").select("pair", "path", "props", F.explode("given").alias("k", "v")).where("array_contains(map_keys(props), k)")
        inner = inner.select("pair", F.concat(part, F.when(part == "", "").otherwise("."), F.col("k")).alias("path"), F.expr("element_at(props, k)").alias("schema"), F.col("v").alias("value"))
        of = level.where("kind = 'ARRAY' and try_variant_get(schema, '$.items', 'variant') is not null")
        of = of.select("pair", "path", F.expr("try_variant_get(schema, '$.items', 'variant')").alias("schema"), F.posexplode(F.expr("try_cast(value as array<variant>)")).alias("i", "value"))
        of = of.select("pair", F.concat(part, F.lit("["), F.col("i").cast("string"), F.lit("]")).alias("path"), "schema", "value")
        level = inner.unionByName(of)
    if found is None:
        return pairs.sparkSession.createDataFrame([], "pair string, errors array<string>")
    return found.groupBy("pair").agg(F.array_sort(F.collect_list("error")).alias("errors"))


def link_tool_calls(messages: DataFrame, tools: DataFrame | None = None) -> DataFrame:
    """One row per item, see above: conv_id, turn, pos, role, kind, call_id, order_turn, depth, status, known_tool, errors, canonical."""
    spark = messages.sparkSession
    tools = spark.createDataFrame([], NO_TOOLS) if tools is None else tools
    tools = tools.where("name is not null").groupBy("name").agg(F.min("schema").alias("schema_text")).withColumn("schema", F.try_parse_json("schema_text")).drop("schema_text")
    every = items(messages)
    plain, linked = every.where("kind = 'message'"), every.where("kind <> 'message'")
    # the first call and the first result of an identifier are linked; ranking is by identifier, never by conversation
    one = Window.partitionBy("conv_id", "call_id", "kind").orderBy("turn", "pos", F.to_json("args"), "content", "name")
    linked = linked.withColumn("first", (F.row_number().over(one) == 1) & F.col("call_id").isNotNull())
    linked = _kept(linked)  # read several times below; plain messages are not
    answers = linked.where("first and kind = 'result'").select("conv_id", "call_id", F.col("turn").alias("answer_turn"))
    calls = _kept(linked.where("first and kind = 'call'").join(answers, ["conv_id", "call_id"], "left"))
    depths = _depths(calls.select("conv_id", "call_id", "turn", "answer_turn", "deps"))
    calls = calls.join(depths, ["conv_id", "call_id"], "left")
    has_depth = F.col("before_turn").isNotNull()
    calls = calls.withColumn("cycle", has_depth & F.col("after").isNull()).withColumn("before_turn", F.coalesce("before_turn", "turn")).withColumn("after", F.when(~F.col("cycle"), F.coalesce("after", F.lit(0))))
    known = calls.select("conv_id", "call_id", F.col("before_turn").alias("call_at"), F.col("after").alias("call_after"), "cycle")
    out = ["conv_id", "turn", "pos", "role", "kind", "call_id", "name", "args", "deps", "content", "order_turn", "depth", "status"]
    calls = calls.withColumn("order_turn", F.col("before_turn")).withColumn("depth", 2 * F.col("after"))
    calls = calls.withColumn("status", F.when(F.col("cycle"), "cycle").when(F.col("answer_turn").isNull(), "unanswered").otherwise("ok"))
    results = linked.where("first and kind = 'result'").join(known, ["conv_id", "call_id"], "left")
    results = results.withColumn("order_turn", F.greatest("turn", F.coalesce("call_at", "turn"))).withColumn("depth", F.when(F.col("call_at").isNull(), 0).otherwise(2 * F.col("call_after") + 1))
    results = results.withColumn("status", F.when(F.col("call_at").isNull(), "orphan").when(F.col("cycle"), "cycle").otherwise("ok"))
    others = linked.where("not first").withColumn("order_turn", F.col("turn")).withColumn("depth", F.lit(0).cast("long")).withColumn("status", F.lit("duplicate"))
    plain = plain.withColumn("order_turn", F.col("turn")).withColumn("depth", F.lit(0).cast("long")).withColumn("status", F.lit("ok"))
    rows = calls.select(out).unionByName(results.select(out)).unionByName(others.select(out))
    rows = rows.join(tools, "name", "left").join(offered_tools(messages), ["conv_id", "name"], "left")
    rows = rows.withColumn("schema", F.when(F.col("kind") == "call", F.coalesce("own_schema", "schema"))).withColumn("known_tool", F.when(F.col("kind") == "call", F.col("schema").isNotNull()))
    rows = _kept(rows).withColumn("pair", F.when(F.col("known_tool"), F.sha2(F.concat_ws("\n", F.to_json("schema"), F.coalesce(F.to_json("args"), F.lit("-"))), 256)))
    # equal arguments under equal schemas are validated once
    pairs = rows.where("known_tool").dropDuplicates(["pair"]).select("pair", "schema", "args")
    none = F.array().cast("array<string>")
    judged = rows.where("known_tool").join(argument_errors(pairs), "pair", "left").withColumn("errors", F.coalesce("errors", none))
    # rows without a schema have no pair; they would all meet at the null key
    rows = judged.unionByName(rows.where("not coalesce(known_tool, false)").withColumn("errors", none))
    body = F.when(
        F.col("kind") == "call",
        F.concat(
            F.lit('{"arguments":'), F.coalesce(F.to_json("args"), F.lit("null")), F.lit(',"depends_on":'), F.to_json("deps"),
            F.lit(',"id":'), _quoted("call_id"), F.lit(',"name":'), _quoted("name"), F.lit(',"role":'), _quoted("role"), F.lit("}"),
        ),
    ).otherwise(F.concat(F.lit('{"content":'), F.coalesce("content", F.lit("null")), F.lit(',"role":'), _quoted("role"), F.lit(',"tool_call_id":'), _quoted("call_id"), F.lit("}")))
    final = ["conv_id", "turn", "pos", "role", "kind", "call_id", "order_turn", "depth", "status", "known_tool", "errors", "canonical"]
    rows = rows.withColumn("canonical", body).select(final)
    spoken = F.to_json(F.struct("content", "role"), {"ignoreNullFields": "false"})
    plain = plain.withColumn("canonical", F.when(F.col("beside").isNull(), spoken).otherwise(F.concat(F.lit('{"content":'), "beside", F.lit(',"role":'), _quoted("role"), F.lit("}"))))
    plain = plain.withColumn("known_tool", F.lit(None).cast("boolean")).withColumn("errors", F.array().cast("array<string>")).select(final)
    return plain.unionByName(rows)


def _quoted(name: str) -> F.Column:
    """A string as JSON, null as null."""
    return F.coalesce(F.substring(F.to_json(F.array(name)), 2, 1 << 30).substr(F.lit(1), F.length(F.to_json(F.array(name))) - 2), F.lit("null"))
