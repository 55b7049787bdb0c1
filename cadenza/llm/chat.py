"""Tool-call linking: calls joined to their results, ordered, validated and serialised.

Only DataFrame functions run here. Calls and results meet in a hash join on
conversation and call id. A call that names others in its ``after`` argument
follows them. Levels are handed out stretch by stretch: a stretch of at most
some thousand calls of one conversation is a folded array, forwards and then
backwards, and rounds of an equi-join carry levels from stretch to stretch, so
their number follows the stretches a chain runs through, not its links. What no
round reaches lies on or behind a cycle. Arguments are
parsed once into variants and checked against the function's schema. A call's
JSON has sorted keys, no spaces and shortest numbers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import dropped, new_path, table, written

#: Variant types by the names schemas use.
_TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
    "null": ("VOID",),
}


@dataclass(frozen=True)
class Tools:
    """functions: of each, its fields as ``name: (type, required)`` or ``(type, required, more)``.

    more: of an object, its own fields, of an array, its items as ``(type,
    more)``, of any other type the values it may have. A number without a
    fraction is an integer however it is written. after: the argument that
    lists calls to follow. stretch: calls of a conversation taken as one array.
    """

    functions: dict = field(default_factory=dict)
    after: str = "after"
    stretch: int = 1024


def _fits(got: Column, wanted: str) -> Column:
    kind = F.schema_of_variant(got)
    fits = F.lit(False)
    for t in _TYPES[wanted]:
        fits = fits | kind.startswith(t)
    if wanted == "integer":
        number = F.try_variant_get(got, "$", "double")
        fits = fits | ((kind.startswith("DOUBLE") | kind.startswith("DECIMAL")) & (number == F.floor(number)))
    return fits


def _checked(value: Column, fields: dict, at: str) -> Column:
    """Messages about an object's fields; ``at`` goes before their names."""
    found = []
    for name, (wanted, required, *rest) in fields.items():
        got = F.try_variant_get(value, f"$['{name}']", "variant")
        missing = F.lit(f"missing:{at}{name}" if required else None).cast("string")
        fits = _fits(got, wanted)
        found.append(F.array(F.when(got.isNull(), missing).when(~fits, F.lit(f"type:{at}{name}"))))
        if rest and rest[0]:
            found.append(F.when(fits, _inside(got, wanted, rest[0], f"{at}{name}")).otherwise(_none()))
    keys = F.coalesce(F.json_object_keys(F.to_json(value)), _none())
    extra = F.transform(F.array_except(keys, F.array(*map(F.lit, fields)).cast("array<string>")), lambda k: F.concat(F.lit(f"unknown:{at}"), k))
    return F.array_compact(F.concat(*found, extra))


def _none() -> Column:
    return F.array().cast("array<string>")


def _inside(got: Column, wanted: str, more, at: str) -> Column:
    if wanted == "object":
        return _checked(got, more, f"{at}.")
    if wanted == "array":
        item, *rest = more
        items = F.coalesce(F.try_variant_get(got, "$", "array<variant>"), F.array().cast("array<variant>"))
        wrong = F.when(F.exists(items, lambda x: ~_fits(x, item)), F.array(F.lit(f"type:{at}[]"))).otherwise(_none())
        if not rest or not rest[0]:
            return wrong
        return F.concat(wrong, F.array_distinct(F.flatten(F.transform(items, lambda x: F.when(_fits(x, item), _inside(x, item, rest[0], f"{at}[]")).otherwise(_none())))))
    said = F.try_variant_get(got, "$", "string")
    return F.when(said.isin(*map(str, more)), _none()).otherwise(F.array(F.lit(f"value:{at}")))


def _errors(tools: Tools) -> Column:
    """Sorted messages about one call's arguments."""
    value = F.col("parsed")
    known = F.lit(None).cast("array<string>")
    for name, fields in tools.functions.items():
        known = F.when(F.col("name") == name, _checked(value, fields, "")).otherwise(known)
    one = lambda s: F.array(F.lit(s))
    return F.when(value.isNull(), one("not_json")).when(~F.schema_of_variant(value).startswith("OBJECT"), one("not_object")).otherwise(F.array_sort(F.coalesce(known, one("unknown_function"))))


def _stretches(nodes: DataFrame, stretch: int) -> DataFrame:
    """``k, part, idx``: calls numbered within parts of one conversation, of about ``stretch`` of ``seq`` or of calls, whichever is less."""
    if "seq" not in nodes.columns:
        nodes = nodes.select("k", F.col("k").alias("conv"), F.lit(0).cast("long").alias("seq"))
    rough = nodes.withColumn("r", F.floor(F.coalesce("seq", F.lit(0)) / F.lit(stretch)))
    full = rough.groupBy("conv", "r").agg(F.count("*").alias("n")).where(F.col("n") > 2 * stretch)
    sub = F.coalesce(F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / F.lit(stretch))), F.lit(0)).cast("long")
    parts = rough.join(full, ["conv", "r"], "left").select("k", "seq", F.struct("conv", "r", sub.alias("sub")).alias("part"))
    return parts.select("k", "part", (F.row_number().over(Window.partitionBy("part").orderBy("seq", "k")) - 1).alias("idx"))


def _most(levels: Column, low: Column) -> Column:
    return F.greatest(low, F.coalesce(F.array_max(levels), F.lit(-1).cast("long"))) + 1


def _forwards(calls: Column) -> Column:
    """Levels of a stretch's calls in order, null where one has to wait."""

    def step(got: Column, c: Column) -> Column:
        ready = (c["wait"] == 0) & F.forall(c["near"], lambda i: F.get(got, i).isNotNull())
        level = F.when(ready, _most(F.transform(c["near"], lambda i: F.get(got, i)), c["low"]))
        return F.array_append(got, F.coalesce(c["level"], level))

    return F.aggregate(calls, F.array().cast("array<bigint>"), step)


def _backwards(calls: Column, known: Column) -> Column:
    """The same from the last call to the first, which reaches calls that stand before those they follow."""
    n = F.size(calls)

    def step(got: Column, c: Column) -> Column:
        there = lambda i: F.coalesce(F.get(known, i), F.get(got, n - 1 - i))
        ready = (c["wait"] == 0) & F.forall(c["near"], lambda i: there(i).isNotNull())
        level = F.when(ready, _most(F.transform(c["near"], there), c["low"]))
        return F.array_append(got, F.coalesce(F.get(known, c["idx"]), level))

    return F.reverse(F.aggregate(F.reverse(calls), F.array().cast("array<bigint>"), step))


def levels(nodes: DataFrame, edges: DataFrame, stretch: int = 1024) -> DataFrame:
    """``k, level`` of every node of ``nodes`` (``k`` distinct) that no cycle holds up; ``edges``: ``k`` follows ``parent``.

    A node's level is the length of the longest chain before it. Nodes with
    ``conv`` and ``seq`` are taken in stretches of a conversation, others alone.
    """
    spark = nodes.sparkSession
    base = written(_stretches(nodes, stretch), "stretches")
    above = base.select(F.col("k").alias("parent"), F.col("part").alias("above"), F.col("idx").alias("i"))
    placed = edges.join(base.select("k", "part"), "k").join(above, "parent")
    near = placed.where(F.col("part") == F.col("above")).groupBy("k").agg(F.collect_set("i").alias("near"))
    far = written(placed.where(F.col("part") != F.col("above")).select("k", "parent"), "far")
    flat = base.join(near, "k", "left").join(far.groupBy("k").agg(F.count("*").alias("wait")), "k", "left")
    flat = flat.select("part", "idx", "k", F.coalesce("near", F.array().cast("array<int>")).alias("near"), F.coalesce("wait", F.lit(0)).alias("wait"), F.lit(-1).cast("long").alias("low"), F.lit(None).cast("long").alias("level"))
    path, used, turn = new_path(spark, "levels"), [base, far], 0
    while True:
        calls = flat.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("idx", "k", "near", "wait", "low", "level"))).alias("c")).where(F.exists("c", lambda c: c["level"].isNull()))
        passed = calls.withColumn("known", _forwards(F.col("c"))).withColumn("known", _backwards(F.col("c"), F.col("known")))
        rows = passed.select("part", F.explode(F.arrays_zip("c", "known")).alias("x")).select("part", "x.c.*", F.col("x.known").alias("new"))
        rows = written(rows, "round")
        used.append(rows)
        fresh = rows.where("level IS NULL AND new IS NOT NULL").select("k", F.col("new").alias("level"))
        fresh.write.parquet(f"{path}/round={turn}")
        turn += 1
        if fresh.isEmpty() or rows.where("new IS NULL").isEmpty():
            break
        told = far.join(fresh.select(F.col("k").alias("parent"), F.col("level").alias("from")), "parent").groupBy("k").agg(F.max("from").alias("from"), F.count("*").alias("n"))
        flat = rows.join(told, "k", "left").select("part", "idx", "k", "near", (F.col("wait") - F.coalesce("n", F.lit(0))).alias("wait"), F.greatest("low", F.coalesce("from", F.lit(-1).cast("long"))).alias("low"), F.col("new").alias("level"))
    dropped(*used)
    return spark.read.schema("k string, level long").parquet(*(f"{path}/round={t}" for t in range(turn)))


def link(calls: DataFrame, results: DataFrame, tools: Tools) -> DataFrame:
    """One row per call and one per result without a call.

    ``calls``: ``conv_id long, seq long, call_id, name, arguments`` (JSON text);
    ``results``: ``conv_id long, seq long, call_id, content``; other columns are
    ignored. Returns ``conv_id, call_id, position, level, status, n_errors,
    errors, canonical``.

    status: ``ok``; ``invalid`` (its arguments are no JSON or break the schema,
    or name a call that is not there); ``pending`` (no result); ``cycle`` (it
    waits for itself, directly or not); ``repeated`` (an earlier call of the
    conversation has the id); ``orphan`` (a result without a call). Of several
    that hold, the one named last here. position counts a conversation's calls
    from 1 by level, then seq, then id; calls without a level have none. Of
    results with one id the first by seq, then content, counts; a later one is
    an orphan. A row without conversation or call id is an orphan or pending on
    its own and takes part in no order. Empty tables give an empty result.
    """
    calls = calls.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("call_id").cast("string").alias("call_id"), F.col("name").cast("string").alias("name"), F.col("arguments").cast("string").alias("arguments"))
    results = results.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("seq").cast("long").alias("seq"), F.col("call_id").cast("string").alias("call_id"), F.col("content").cast("string").alias("content"))
    whole = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    key = F.concat_ws("\x00", F.col("conv_id").cast("string"), "call_id")
    keyed = written(calls.withColumn("k", F.when(whole, key)), "calls")
    # The first row of an id, found by a combinable minimum; equal rows share it and are told apart by a count.
    first = written(keyed.where("k IS NOT NULL").groupBy("k").agg(F.min(F.struct("seq", "name", "arguments")).alias("first"), F.count("*").alias("n")), "first-calls")
    keyed = keyed.withColumn("parsed", F.try_parse_json("arguments"))
    heads = first.select("k", "first.*")
    after = F.coalesce(F.try_variant_get(F.try_parse_json("arguments"), f"$['{tools.after}']", "array<string>"), F.array().cast("array<string>"))
    conv = F.substring_index("k", "\x00", 1)
    wanted = heads.select("k", F.explode(F.array_distinct(F.array_compact(after))).alias("p")).select("k", F.concat_ws("\x00", conv, "p").alias("parent"))
    there = written(wanted.join(heads.select(F.col("k").alias("parent"), F.lit(True).alias("there")), "parent", "left"), "waits")
    dangling = there.where("there IS NULL").groupBy("k").agg(F.count("*").alias("dangling"))
    level = levels(heads.select("k", conv.alias("conv"), "seq"), there.where("there").select("k", "parent"), tools.stretch)

    result = written(results.withColumn("k", F.when(whole, key)), "results")
    first_result = written(result.where("k IS NOT NULL").groupBy("k").agg(F.min(F.struct("seq", "content")).alias("r"), F.count("*").alias("n_results")), "first-results")
    base = heads.join(first_result, "k", "left").join(level, "k", "left").join(dangling, "k", "left")
    rows = base.select("k", conv.cast("long").alias("conv_id"), F.expr("substring(k, instr(k, '\x00') + 1)").alias("call_id"), "seq", "name", F.try_parse_json("arguments").alias("parsed"), F.col("r.content").alias("content"), F.col("r").isNotNull().alias("answered"), "level", F.coalesce("dangling", F.lit(0)).alias("dangling"))
    placed = _positions(rows, tools.stretch)
    errors = F.when(F.col("dangling") > 0, F.array_append(_errors(tools), F.lit("dangling"))).otherwise(_errors(tools))
    placed = placed.withColumn("errors", errors)
    status = F.when(F.col("level").isNull(), "cycle").when(~F.col("answered"), "pending").when(F.size("errors") > 0, "invalid").otherwise("ok")
    kept = _said(placed.withColumn("status", status))

    # What is left over: repeated calls, calls without an id, results without a call. Branches for rows that are not there are not planned.
    out = kept
    none = {c: F.lit(None).cast(t) for c, t in (("position", "long"), ("level", "long"), ("content", "string"))}
    twice = not first.where("n > 1").isEmpty()
    row = F.struct("seq", "name", "arguments")
    if twice or not keyed.where("k IS NULL").isEmpty():
        spare = keyed.join(first.select("k", "first"), "k", "left").where(F.col("k").isNull() | ~row.eqNullSafe(F.col("first")))
        spare = spare.select("conv_id", "call_id", "name", "parsed", F.when(F.col("k").isNull(), "pending").otherwise("repeated").alias("status"))
        if twice:
            same = first.where("n > 1").join(keyed, "k").where(row.eqNullSafe(F.col("first")))
            same = same.groupBy("k").agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in ("conv_id", "call_id", "name", "arguments"))).where("c > 1")
            spare = spare.unionByName(same.select("conv_id", "call_id", "name", F.try_parse_json("arguments").alias("parsed"), F.lit("repeated").alias("status"), F.explode(F.sequence(F.lit(2), F.col("c"))).alias("again")).drop("again"))
        out = out.unionByName(_said(spare.withColumns(none).withColumn("errors", _errors(tools))))
    answer = F.struct("seq", "content")
    seen = first_result.join(heads.select("k"), "k", "left_semi")
    lone = result.join(seen.select("k", "r"), "k", "left").where(F.col("r").isNull() | ~answer.eqNullSafe(F.col("r"))).select("conv_id", "call_id", "content")
    if not first_result.where("n_results > 1").isEmpty():
        same = seen.where("n_results > 1").join(result, "k").where(answer.eqNullSafe(F.col("r")))
        same = same.groupBy("k").agg(F.count("*").alias("c"), *(F.first(c).alias(c) for c in ("conv_id", "call_id", "content"))).where("c > 1")
        lone = lone.unionByName(same.select("conv_id", "call_id", "content", F.explode(F.sequence(F.lit(2), F.col("c"))).alias("again")).drop("again"))
    lone = lone.select("*", F.lit(None).cast("string").alias("name"), F.lit(None).cast("variant").alias("parsed"), F.lit("orphan").alias("status"), none["position"].alias("position"), none["level"].alias("level"), F.array().cast("array<string>").alias("errors"))
    return out.unionByName(_said(lone))


def _positions(rows: DataFrame, stretch: int) -> DataFrame:
    """Ranks within conversations by level, seq and id. Stretches of seq are ranked alone and joined up by their counts, so a long conversation is dealt over tasks."""
    rows = rows.withColumn("part", F.floor(F.col("seq") / F.lit(stretch)))
    keys = ["conv_id", "level", "part"]
    counts = rows.where("level IS NOT NULL").groupBy(*keys).agg(F.count("*").alias("n"))
    before = counts.select(*(F.col(k).alias(f"b_{k}") for k in keys), F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("level", "part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "call_id")))
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"b_{k}"))
    return ranked.join(before, same, "left").withColumn("position", F.when(F.col("level").isNotNull(), F.col("before") + F.col("rank")))


def _said(rows: DataFrame) -> DataFrame:
    """The row's canonical JSON: keys in order, nulls written."""
    doc = F.struct(F.col("parsed").alias("arguments"), "call_id", F.col("conv_id"), "errors", "level", "name", "position", F.col("content").alias("result"), "status")
    return rows.select("conv_id", "call_id", "position", "level", "status", F.size("errors").cast("long").alias("n_errors"), F.array_join("errors", ",").alias("errors"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("canonical"))


#: Functions of the registered query.
QUERY_TOOLS = Tools(
    {
        "search": {"text": ("string", True), "limit": ("integer", True), "after": ("array", False)},
        "summarise": {"text": ("string", True), "limit": ("number", False), "after": ("array", True)},
        "translate": {"text": ("string", True), "limit": ("integer", True), "after": ("array", False)},
    }
)


def calls_of(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """User turns as calls and all others as results, some broken on purpose by their lengths; a turn that is not the assistant's answers no call."""
    n = F.length(F.coalesce("text", F.lit("")))
    name = F.element_at(F.array(*map(F.lit, ("search", "summarise", "translate", "lookup"))), (n % 4 + 1).cast("int"))
    call = lambda t: F.concat(F.lit("call_"), F.col("conv_id").cast("string"), F.lit("_"), t.cast("string"))
    turn, text = F.col("turn"), F.col("text")
    quoted = F.to_json(F.array(text))
    after = F.array_compact(F.array(F.when(turn >= 2, call(turn - 2)), F.when((turn > 2) & (n % 3 == 0), call(F.lit(0))), F.when(n % 17 == 0, call(turn))))
    body = F.concat(
        F.lit('{"text":'),
        F.expr("substring(j, 2, length(j) - 2)"),
        F.when(n % 6 == 0, F.lit("")).when(n % 5 == 0, F.lit(',"limit":"many"')).otherwise(F.concat(F.lit(',"limit":'), n.cast("string"))),
        F.when(n % 10 == 3, F.lit(',"x":true')).otherwise(F.lit("")),
        F.concat(F.lit(',"after":'), F.to_json(after)),
        F.when(n % 13 == 0, F.lit("")).otherwise(F.lit("}")),
    )
    calls = conversations.where("role = 'user'").withColumn("j", quoted).select("conv_id", turn.alias("seq"), call(turn).alias("call_id"), name.alias("name"), body.alias("arguments"))
    lost = F.when(n % 11 == 0, F.lit("lost_")).otherwise(F.lit(""))
    answers = F.when(F.col("role") == "assistant", F.concat(lost, call(turn - 1))).otherwise(F.concat(F.lit("note_"), call(turn)))
    results = conversations.where("role IS DISTINCT FROM 'user'").select("conv_id", turn.alias("seq"), answers.alias("call_id"), text.alias("content"))
    return calls, results


def op4_tool_calls(spark, sf_dir: str) -> DataFrame:
    """The whole ``conversations`` table, read as calls and results."""
    return link(*calls_of(table(spark, sf_dir, "conversations")), QUERY_TOOLS)


OP4_SQL = r"""
WITH RECURSIVE u AS (
  SELECT conv_id, turn, text, length(coalesce(text, '')) AS n, 'call_' || conv_id || '_' || turn AS call_id
  FROM conversations WHERE role = 'user'),
b AS (
  SELECT *, ['search', 'summarise', 'translate', 'lookup'][(n % 4 + 1)::INT] AS name, n % 13 = 0 AS broken,
    n % 6 <> 0 AS has_limit, n % 6 <> 0 AND n % 5 = 0 AS text_limit, n % 10 = 3 AS extra,
    list_filter([CASE WHEN turn >= 2 THEN 'call_' || conv_id || '_' || (turn - 2) END,
                 CASE WHEN turn > 2 AND n % 3 = 0 THEN 'call_' || conv_id || '_0' END,
                 CASE WHEN n % 17 = 0 THEN call_id END], lambda x: x IS NOT NULL) AS after
  FROM u),
edges AS (SELECT DISTINCT call_id AS k, p AS parent FROM (SELECT call_id, unnest(after) AS p FROM b WHERE NOT broken) e
          WHERE p IN (SELECT call_id FROM b)),
dangling AS (SELECT DISTINCT call_id AS k FROM (SELECT call_id, unnest(after) AS p FROM b WHERE NOT broken) e
             WHERE p NOT IN (SELECT call_id FROM b)),
stuck AS (SELECT k FROM edges WHERE k = parent UNION SELECT e.k FROM edges e JOIN stuck s ON e.parent = s.k),
walk AS (SELECT call_id AS k, 0::BIGINT AS level FROM b WHERE call_id NOT IN (SELECT k FROM stuck)
         UNION SELECT e.k, w.level + 1 FROM edges e JOIN walk w ON e.parent = w.k WHERE e.k NOT IN (SELECT k FROM stuck)),
lv AS (SELECT k, max(level) AS level FROM walk GROUP BY k),
r AS (SELECT conv_id, CASE WHEN role IS DISTINCT FROM 'assistant' THEN 'note_call_' || conv_id || '_' || turn
             ELSE CASE WHEN length(coalesce(text, '')) % 11 = 0 THEN 'lost_' ELSE '' END || 'call_' || conv_id || '_' || (turn - 1) END AS call_id, text AS content
      FROM conversations WHERE role IS DISTINCT FROM 'user'),
c AS (
  SELECT b.*, lv.level, r.content, r.call_id IS NOT NULL AS answered,
    CASE WHEN broken THEN ['not_json'] WHEN name = 'lookup' THEN ['unknown_function'] ELSE list_sort(list_filter([
      CASE WHEN NOT has_limit AND name <> 'summarise' THEN 'missing:limit' END,
      CASE WHEN text_limit THEN 'type:limit' END,
      CASE WHEN extra THEN 'unknown:x' END], lambda x: x IS NOT NULL)) END
    || CASE WHEN d.k IS NOT NULL THEN ['dangling'] ELSE [] END AS errors
  FROM b LEFT JOIN lv ON lv.k = b.call_id LEFT JOIN r ON r.call_id = b.call_id AND r.conv_id = b.conv_id LEFT JOIN dangling d ON d.k = b.call_id),
p AS (
  SELECT *, CASE WHEN level IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id ORDER BY level NULLS LAST, turn, call_id) END AS position,
    CASE WHEN level IS NULL THEN 'cycle' WHEN NOT answered THEN 'pending' WHEN len(errors) > 0 THEN 'invalid' ELSE 'ok' END AS status,
    CASE WHEN broken THEN 'null' ELSE '{"after":[' || array_to_string(list_transform(after, lambda x: '"' || x || '"'), ',') || ']'
      || CASE WHEN text_limit THEN ',"limit":"many"' WHEN has_limit THEN ',"limit":' || n ELSE '' END
      || ',"text":' || coalesce(to_json(text)::VARCHAR, 'null') || CASE WHEN extra THEN ',"x":true' ELSE '' END || '}' END AS args
  FROM c)
SELECT conv_id, call_id, position, level, status, len(errors) AS n_errors, array_to_string(errors, ',') AS errors,
  '{"arguments":' || args || ',"call_id":"' || call_id || '","conv_id":' || conv_id
  || ',"errors":[' || array_to_string(list_transform(errors, lambda x: '"' || x || '"'), ',') || '],"level":' || coalesce(level::VARCHAR, 'null')
  || ',"name":"' || name || '","position":' || coalesce(position::VARCHAR, 'null')
  || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS canonical
FROM p
UNION ALL
SELECT r.conv_id, r.call_id, NULL, NULL, 'orphan', 0, '',
  '{"arguments":null,"call_id":"' || r.call_id || '","conv_id":' || r.conv_id || ',"errors":[],"level":null,"name":null,"position":null,"result":'
  || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"orphan"}'
FROM r WHERE r.call_id NOT IN (SELECT call_id FROM b)
"""
