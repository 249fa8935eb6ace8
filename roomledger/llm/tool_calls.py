"""Tool-call linking: calls and their results are joined by identifier, ordered, checked and serialised.

1. Calls and results become one row for each (conversation, identifier), combined in each task first, so that a
   repeated identifier costs nothing in the join. They meet in a hash join.
2. Calls are ordered topologically along what they refer to: level 0 refers to no known call, every other level
   is one more than the highest it refers to. Chains are settled by pointer jumping in a logarithmic number of
   rounds, calls that wait for several others are peeled off. Calls in a circle get no level.
3. Arguments are checked against the parameters of the called tool.
4. Every call comes out as canonical JSON: sorted keys, no white space.

All of it is DataFrame operations, and a result row is one call: conversations of any length are never gathered
in one row or task. Sorting by ``level, turn, call_id`` gives a conversation's calls in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roomledger.session import materialize, scratch_path

#: Types that a parameter may have, by the JSON types (as Spark names them) that fit; integers are numbers too.
TYPES = {
    "string": r"^STRING$",
    "integer": r"^BIGINT$",
    "number": r"^(BIGINT|DOUBLE|DECIMAL.*)$",
    "boolean": r"^BOOLEAN$",
    "object": r"^OBJECT",
    "array": r"^ARRAY",
}
KEY = ["conv_id", "call_id"]


def calls_in(messages: DataFrame) -> DataFrame:
    """Calls in the texts of a chat log: ``conv_id, turn, call_id, name, arguments, refers_to``.

    A message makes calls if its text is a JSON object with an array ``tool_calls`` of objects with ``id``,
    ``name``, ``arguments`` and, if it uses results of other calls, an array ``refers_to`` of their ids. Any other
    text makes none.
    """
    item = "struct<id:string,name:string,arguments:string,refers_to:array<string>>"
    parsed = messages.where(F.col("text").rlike(r"^[\x20\x09\x0A\x0D]*\{")).withColumn("calls", F.from_json("text", f"tool_calls array<{item}>")["tool_calls"])
    each = parsed.select(F.col("conv_id"), F.col("turn"), F.explode("calls").alias("c"))
    return each.select("conv_id", "turn", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.refers_to").alias("refers_to"))


def results_in(messages: DataFrame) -> DataFrame:
    """Results in a chat log: JSON objects with ``tool_call_id`` and ``content`` said by role ``tool``."""
    parsed = messages.where("role = 'tool'").withColumn("r", F.from_json("text", "tool_call_id string, content string"))
    return parsed.select("conv_id", "turn", F.col("r.tool_call_id").alias("call_id"), F.col("r.content").alias("content")).where("call_id is not null")


def dialogue_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A plain dialogue as calls: each user turn calls the tool ``reply``, the assistant's next turn is the result.

    A call refers to the user turn before it (two turns earlier), if there is one.
    """
    turn = F.col("turn").cast("string")
    asked = messages.where("role = 'user'").select(
        "conv_id",
        "turn",
        F.concat(F.lit("turn-"), turn).alias("call_id"),
        F.lit("reply").alias("name"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("text")), {"ignoreNullFields": "false"}).alias("arguments"),
        F.array(F.concat(F.lit("turn-"), (F.col("turn") - 2).cast("string"))).alias("refers_to"),
    )
    answered = messages.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("turn-"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return asked, answered


def linked(calls: DataFrame, results: DataFrame) -> DataFrame:
    """One row for each (conversation, identifier), with what the call and the result say and a ``status``.

    ``linked``; ``unanswered`` (no result); ``orphan`` (no call); ``early`` (the result's turn is not after the
    call's). The first turn counts where an identifier is used more than once (ties: the smaller text); ``n_calls``
    and ``n_results`` count all. Rows without an identifier or conversation are left out: nothing can be linked.
    """
    known = F.expr("conv_id is not null and call_id is not null")
    call = F.struct(F.coalesce("turn", F.lit(2**62)).alias("at"), F.col("turn").alias("turn"), F.col("name").alias("name"), F.col("arguments").alias("arguments"), F.col("refers_to").alias("refers_to"))
    result = F.struct(F.coalesce("turn", F.lit(2**62)).alias("at"), F.col("turn").alias("turn"), F.col("content").alias("content"))
    one_call = calls.where(known).groupBy(*KEY).agg(F.min(call).alias("call"), F.count("*").alias("n_calls"))
    one_result = results.where(known).groupBy(*KEY).agg(F.min(result).alias("result"), F.count("*").alias("n_results"))
    status = (
        F.when(F.col("call").isNull(), "orphan")
        .when(F.col("result").isNull(), "unanswered")
        .when(F.col("result.at") <= F.col("call.at"), "early")
        .otherwise("linked")
    )
    both = one_call.join(one_result.hint("shuffle_hash"), KEY, "full")
    return both.select(
        *KEY,
        F.col("call.turn").alias("turn"),
        F.col("call.name").alias("name"),
        F.col("call.arguments").alias("arguments"),
        F.col("call.refers_to").alias("refers_to"),
        F.col("result.turn").alias("result_turn"),
        F.col("result.content").alias("content"),
        F.coalesce("n_calls", F.lit(0).cast("long")).alias("n_calls"),
        F.coalesce("n_results", F.lit(0).cast("long")).alias("n_results"),
        status.alias("status"),
    )


def levels(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, level`` of every call that is in or behind no circle; ``calls`` has one row a call.

    References to unknown identifiers say nothing. A call that waits for one other is a pointer to it; pointers jump
    over each other, twice as far each round, until they lead to a call that waits for none or for several. So a chain
    of n calls takes log2(n) rounds. Calls that wait for several are then peeled off, one round for each of them that
    lie behind one another. Every round reads stored tables only, so no plan grows with the rounds.
    """
    nodes = calls.select(*KEY, F.array_distinct(F.coalesce("refers_to", F.array().cast("array<string>"))).alias("refers_to"))
    known = nodes.select("conv_id", F.col("call_id").alias("used"))
    uses = materialize(nodes.select(*KEY, F.explode("refers_to").alias("used")).join(known, ["conv_id", "used"]))
    waits = uses.groupBy(*KEY).agg(F.count("*").alias("waits"), F.min("used").alias("used"))
    nodes = materialize(nodes.select(*KEY).join(waits, KEY, "left"))
    free, several = nodes.where("waits is null").select(*KEY, F.lit(0).alias("level")), nodes.where("waits > 1")
    pointers = _jumped(nodes.where("waits = 1").select(*KEY, F.col("used").alias("root"), F.lit(1).alias("steps")))
    settled = _peeled(free, several.select(*KEY, "waits"), uses, pointers)
    behind = pointers.join(settled.withColumnsRenamed({"call_id": "root", "level": "root_level"}), ["conv_id", "root"])
    return settled.unionByName(behind.select(*KEY, (F.col("root_level") + F.col("steps")).cast("int").alias("level")))


def _jumped(pointers: DataFrame) -> DataFrame:
    """Pointers whose ``root`` is no pointer itself, with the ``steps`` to it; those into a circle keep some root."""
    own = pointers.select("conv_id", F.col("call_id").alias("root"), F.lit(True).alias("open"))
    pointers = materialize(pointers.join(own, ["conv_id", "root"], "left").withColumn("open", F.coalesce("open", F.lit(False))))
    longest = pointers.groupBy("conv_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(longest.bit_length()):
        if pointers.where("open").isEmpty():
            break
        at = pointers.select("conv_id", F.col("call_id").alias("root"), F.col("root").alias("next"), F.col("steps").alias("more"), F.col("open").alias("still"))
        moved = pointers.where("open").join(at, ["conv_id", "root"])
        moved = moved.select(*KEY, F.col("next").alias("root"), (F.col("steps") + F.col("more")).alias("steps"), F.col("still").alias("open"))
        pointers = materialize(pointers.where("not open").select(moved.columns).unionByName(moved))
    return pointers


def _peeled(free: DataFrame, several: DataFrame, uses: DataFrame, pointers: DataFrame) -> DataFrame:
    """Levels of the free calls and of those that wait for several, through pointers or directly."""
    spark = free.sparkSession
    if several.isEmpty():
        return free
    path = scratch_path(spark, "call-levels")
    free.write.parquet(path)
    targets = pointers.select("conv_id", F.col("call_id").alias("used"), "root", "steps")
    edges = uses.join(several.select(*KEY), KEY, "left_semi").join(targets, ["conv_id", "used"], "left")
    edges = materialize(edges.select(*KEY, F.coalesce("root", "used").alias("root"), F.coalesce("steps", F.lit(0)).alias("steps")))
    waiting, newest = several.withColumn("level", F.lit(0)), free
    while True:
        freed = newest.withColumnsRenamed({"call_id": "root", "level": "root_level"}).join(edges, ["conv_id", "root"])
        fewer = freed.groupBy(*KEY).agg(F.count("*").alias("freed"), F.max(F.col("root_level") + F.col("steps") + 1).alias("behind"))
        waiting = waiting.join(fewer, KEY, "left").select(
            *KEY, (F.col("waits") - F.coalesce("freed", F.lit(0))).alias("waits"), F.greatest("level", F.coalesce("behind", F.lit(0))).cast("int").alias("level")
        )
        waiting = materialize(waiting)
        newest = waiting.where("waits = 0").select(*KEY, "level")
        if newest.isEmpty():
            return spark.read.schema(free.schema).parquet(path)
        newest.write.mode("append").parquet(path)
        waiting = waiting.where("waits > 0")


def problems(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, problems``: sorted texts on what is wrong with a call's arguments; only calls with some.

    ``schemas``: ``name, parameter, type, required``, a row for each parameter; a tool without parameters has one
    row with NULL in ``parameter``. Parameters that the schema doesn't have, missing ones, values of another type
    (NULL included), unknown tools and arguments that are no JSON object are problems.
    """
    parsed = calls.select(*KEY, "name", F.try_parse_json("arguments").alias("v"))
    kind = F.expr("schema_of_variant(v)")
    tools = schemas.select("name").distinct().withColumn("tool", F.lit(True))
    whole = parsed.join(tools, "name", "left").select(
        *KEY, F.when(F.col("tool").isNull(), "unknown tool").when(F.col("v").isNull() | ~kind.startswith("OBJECT"), "arguments are no JSON object").alias("problem")
    )
    objects = parsed.where(F.col("v").isNotNull() & kind.startswith("OBJECT")).join(tools, "name", "left_semi")
    objects.createOrReplaceTempView("__tool_call_objects")
    given = objects.sparkSession.sql("select o.conv_id, o.call_id, o.name, a.key parameter, schema_of_variant(a.value) found from __tool_call_objects o, lateral variant_explode(o.v) a")
    objects.sparkSession.catalog.dropTempView("__tool_call_objects")
    parameters = schemas.where("parameter is not null").select("name", "parameter", "type", "required")
    fits = F.lit(False)
    for name, pattern in TYPES.items():
        fits = F.when(F.col("type") == name, F.col("found").rlike(pattern)).otherwise(fits)
    checked = given.join(parameters, ["name", "parameter"], "left").select(
        *KEY,
        F.when(F.col("type").isNull(), F.concat(F.lit("unexpected "), "parameter")).when(~fits, F.concat("parameter", F.lit(" is no "), "type")).alias("problem"),
    )
    demanded = objects.select(*KEY, "name").join(parameters.where("required").select("name", "parameter"), "name")
    missing = demanded.join(given, [*KEY, "name", "parameter"], "left_anti").select(*KEY, F.concat(F.lit("missing "), "parameter").alias("problem"))
    every = whole.unionByName(checked).unionByName(missing).where("problem is not null")
    return every.groupBy(*KEY).agg(F.array_sort(F.collect_set("problem")).alias("problems"))


def canonical(value: str):
    """JSON text with sorted keys and no white space; text that is no JSON (duplicate keys included) stays a JSON string."""
    parsed = F.try_parse_json(value)
    return F.when(F.col(value).isNull(), "null").when(parsed.isNull(), _quoted(F.col(value))).otherwise(F.to_json(parsed))


def _quoted(text):
    return F.regexp_extract(F.to_json(F.struct(text.alias("a"))), r"(?s)^\{\"a\":(.*)\}$", 1)


def formatted(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """``conv_id, call_id, turn, level, status, n_calls, n_results, problems, json`` of every call and orphan.

    ``level`` is NULL for orphans and for calls in or behind a circle (``circular``). ``json`` is canonical:
    arguments, call_id, name, problems, result, status. Inputs may hold other columns; empty tables give none.
    """
    links = materialize(linked(calls, results))
    own = links.where("status <> 'orphan'")
    ordered, wrong = levels(own), problems(own, schemas)
    whole = links.join(ordered, KEY, "left").join(wrong, KEY, "left")
    listed = F.coalesce("problems", F.array().cast("array<string>"))
    quoted = F.concat(F.lit("["), F.array_join(F.transform(listed, _quoted), ","), F.lit("]"))
    fields = {
        "arguments": canonical("arguments"),
        "call_id": _quoted(F.col("call_id")),
        "name": F.when(F.col("name").isNull(), "null").otherwise(_quoted(F.col("name"))),
        "problems": quoted,
        "result": F.when(F.col("content").isNull(), "null").otherwise(_quoted(F.col("content"))),
        "status": _quoted(F.col("status")),
    }
    parts = [x for i, (k, v) in enumerate(fields.items()) for x in (F.lit(("," if i else "{") + f'"{k}":'), v)]
    return whole.select(
        *KEY,
        "turn",
        "level",
        "status",
        "n_calls",
        "n_results",
        listed.alias("problems"),
        (F.col("level").isNull() & (F.col("status") != "orphan")).alias("circular"),
        F.concat(*parts, F.lit("}")).alias("json"),
    )


def schema_table(spark, tools: dict[str, dict[str, tuple[str, bool]]]) -> DataFrame:
    """``schemas`` from tool -> parameter -> (type, required)."""
    rows = [(t, p, kind, required) for t, ps in tools.items() for p, (kind, required) in ps.items()]
    rows += [(t, None, None, None) for t, ps in tools.items() if not ps]
    return spark.createDataFrame(rows, "name string, parameter string, type string, required boolean")


#: The tool that plain dialogues call.
REPLY = {"reply": {"turn": ("integer", True), "text": ("string", True)}}

ORACLE = r"""
with calls as (select conv_id, 'turn-' || turn call_id, min(turn) turn, min(text) text, count(*) n_calls from conversations
 where role = 'user' and conv_id is not null and turn is not null group by 1, 2),
results as (select conv_id, 'turn-' || (turn - 1) call_id, min(turn) turn, min(text) content, count(*) n_results from conversations
 where role = 'assistant' and conv_id is not null and turn is not null group by 1, 2),
linked as (select coalesce(c.conv_id, r.conv_id) conv_id, coalesce(c.call_id, r.call_id) call_id, c.turn, c.text, r.content,
 coalesce(n_calls, 0) n_calls, coalesce(n_results, 0) n_results,
 case when c.conv_id is null then 'orphan' when r.conv_id is null then 'unanswered' else 'linked' end status
 from calls c full join results r on c.conv_id = r.conv_id and c.call_id = r.call_id),
runs as (select *, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) run from linked where status <> 'orphan'),
leveled as (select conv_id, call_id, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 level from runs)
select l.conv_id, l.call_id, l.turn, v.level::int level, l.status, l.n_calls::bigint n_calls, l.n_results::bigint n_results,
 []::varchar[] problems, false circular,
 '{"arguments":' || case when l.status = 'orphan' then 'null' else '{"text":' || to_json(l.text) || ',"turn":' || l.turn || '}' end
 || ',"call_id":' || to_json(l.call_id) || ',"name":' || case when l.status = 'orphan' then 'null' else '"reply"' end
 || ',"problems":[],"result":' || coalesce(to_json(l.content)::varchar, 'null') || ',"status":' || to_json(l.status) || '}' json
from linked l left join leveled v on l.conv_id = v.conv_id and l.call_id = v.call_id"""
