"""Queries over run state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import runs as R
from . import views as V
from .catalog import query
from .views import STEPS

_MUST = "(enabled AND (overwrite OR stored_hash IS DISTINCT FROM hash OR status IS DISTINCT FROM 'success'))"


@query("t1_resume_cascade", f"""
WITH {STEPS}, m AS (SELECT *, {_MUST} AS must FROM steps),
b AS (SELECT *, coalesce(bool_or(must) OVER (PARTITION BY video_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS before FROM m)
SELECT video_id, ord, step, CASE WHEN NOT enabled THEN 'disabled' WHEN must OR before THEN 'run' ELSE 'skipped' END AS decision FROM b""")
def t1_resume_cascade(spark, d):
    return R.decisions(V.steps(spark, d)).select("video_id", "ord", "step", "decision")


@query("t1_start_from", f"""
WITH {STEPS}, s AS (SELECT *, bool_or(step = 's3') OVER (PARTITION BY video_id ORDER BY ord) AS started FROM steps),
e AS (SELECT *, coalesce(bool_or(started AND enabled AND step = 's5') OVER (PARTITION BY video_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS ended FROM s)
SELECT video_id, ord, step, CASE WHEN ended OR NOT started THEN 'not_run' WHEN NOT enabled THEN 'disabled' ELSE 'run' END AS decision FROM e""")
def t1_start_from(spark, d):
    return R.decisions(V.steps(spark, d), R.Plan(start_from="s3", stop_after="s5")).select("video_id", "ord", "step", "decision")


@query("p18_only_steps", f"""
WITH {STEPS} SELECT video_id, ord, step, CASE WHEN step NOT IN ('s2', 's4') THEN 'not_run' WHEN NOT enabled THEN 'disabled' WHEN {_MUST} THEN 'run' ELSE 'skipped' END AS decision FROM steps""")
def p18_only_steps(spark, d):
    return R.decisions(V.steps(spark, d), R.Plan(only=("s2", "s4"), cascade=False)).select("video_id", "ord", "step", "decision")


@query("a13_job_status", f"""WITH {STEPS} SELECT video_id, CASE WHEN bool_and(coalesce(status = 'success', FALSE)) THEN 'success' ELSE 'partial' END AS job_status FROM steps GROUP BY video_id""")
def a13_job_status(spark, d):
    s = V.steps(spark, d).withColumn("status", F.coalesce("status", F.lit("pending")))
    return R.job_status(s, partial=True)


_CELL = "coalesce(max(CASE WHEN step = '{0}' THEN CASE status WHEN 'success' THEN 'OK' WHEN 'failed' THEN 'FAILED' END END), 'NOT_RUN') AS {0}"


@query("a11_status_matrix", f"WITH {STEPS} SELECT video_id, {', '.join(_CELL.format(f's{i}') for i in range(1, 7))} FROM steps GROUP BY video_id")
def a11_status_matrix(spark, d):
    return R.matrix(V.steps(spark, d), [f"s{i}" for i in range(1, 7)])


@query("u5_failures", f"""
WITH {STEPS} SELECT video_id, step FROM steps WHERE status = 'failed' AND video_id NOT IN (SELECT video_id FROM steps WHERE ord = 6 AND status = 'success')""")
def u5_failures(spark, d):
    steps = V.steps(spark, d)
    return R.failures(steps, current=steps.where("ord = 6 AND status = 'success'"))


@query("f34_retry_policy", """
WITH p AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CASE WHEN o_custkey % 5 = 0 THEN 3 ELSE o_custkey % 5 END WHEN 1 THEN o_custkey % 4 + 1 WHEN 2 THEN 3
    ELSE CASE o_custkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 1 ELSE 1 END END AS attempts,
  CASE o_orderkey % 4 WHEN 2 THEN 2.0 ELSE (o_orderkey % 7) / 2.0 END::DOUBLE AS seconds FROM orders)
SELECT o_orderkey, attempts::BIGINT AS attempts, k AS retry, seconds * pow(2, k) AS delay FROM p, range(0, 10) t(k) WHERE k < attempts - 1""")
def f34_retry_policy(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    wait = F.struct(F.lit("backoff_seconds").alias("key"), (k % 7 / 2).cast("string").alias("value"))
    entry = lambda name, v: F.map_from_entries(F.array(F.struct(F.lit(name).alias("key"), v.cast("string").alias("value")), wait))
    config = F.when(k % 4 == 0, entry("max_attempts", c % 5)).when(k % 4 == 1, entry("max_retries", c % 4)).when(k % 4 == 3, entry("max_attempts", c % 3 - 4))
    rows = V.table(spark, d, "orders").select("o_orderkey", config.alias("config"))
    return R.delays(R.policies(rows, attempts=3)).select("o_orderkey", F.col("attempts").cast("long").alias("attempts"), F.col("retry").cast("long").alias("retry"), "delay")


@query("t2_functional_hash", """
SELECT o_orderkey, sha256('{"pipeline_version": 2, "prompt_hash": ' || CASE WHEN o_orderkey % 3 = 0 THEN 'null' ELSE '"' || sha256(o_orderpriority) || '"' END
  || ', "provider_config": ' || CASE o_orderkey % 4 WHEN 0 THEN '{"near": {"api_key": "", "limits": {"a": [1, 2], "b": null}}}' WHEN 1 THEN '{"far": {"api_key": "***REDACTED***", "url": "http://x/?a=1,2"}}' WHEN 2 THEN '{"far": {"api_key": "***REDACTED***", "url": "http://x/?a=1,2"}, "near": {"api_key": "", "limits": {"a": [1, 2], "b": null}}}' ELSE 'null' END
  || ', "step": "s' || o_orderkey % 6 || '", "step_config": {' || CASE o_orderkey % 4 WHEN 2 THEN '"fallback_provider": "near", ' ELSE '' END || '"model": {"name": "m: ' || o_custkey || ', x", "sizes": {"a": ' || o_custkey % 7 || ', "z": 1.5}}'
  || CASE o_orderkey % 4 WHEN 0 THEN ', "provider": "near"' WHEN 1 THEN ', "provider": "far"' WHEN 2 THEN ', "provider": "far"' ELSE '' END || '}}') AS hash FROM orders""")
def t2_functional_hash(spark, d):
    """Orders as configurations, their fields in one order or the other; what is forced and how often it is tried does not count, nor does a key."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    sizes = F.concat(F.lit('{"z":1.5,"a":'), (F.col("o_custkey") % 7).cast("string"), F.lit("}"))
    model = F.concat(F.lit('"model": {"sizes": '), sizes, F.lit(', "name": "m: '), c, F.lit(', x"}'))
    provider = F.when(k % 4 == 0, '"provider":"near",').when(k % 4 == 1, '"provider":"far",').when(k % 4 == 2, '"provider":"far","fallback_provider":"near",').otherwise("")
    forced = F.concat(F.lit('"overwrite":'), F.when(k % 5 == 0, "true").otherwise("false"), F.lit(',"retry":{"max_attempts":'), (k % 4).cast("string"), F.lit("}"))
    config = F.when(k % 2 == 0, F.concat(F.lit("{"), provider, model, F.lit(","), forced, F.lit("}"))).otherwise(F.concat(F.lit("{"), forced, F.lit(" , "), provider, model, F.lit("}")))
    providers = F.concat(F.lit('{"far":{"url":"http://x/?a=1,2","api_key":"k'), c, F.lit('"},"other":{"api_key":"x"},"near":{"limits":{"b":null,"a":[1,2]},"api_key":""}}'))
    prompt = F.when(k % 3 != 0, F.col("o_orderpriority").cast("binary"))
    rows = V.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("s"), (k % 6).cast("string")).alias("step"), config.alias("config"), providers.alias("providers"), prompt.alias("prompt"))
    return R.step_hashes(rows).select("o_orderkey", "hash")


def _first(prompt: str, attempt: int) -> str:
    k = int(prompt.rsplit(" ", 1)[1])
    if k % 5 == 0:
        raise ValueError("bad request")
    if attempt <= k % 4:
        raise ValueError(f"timed out: timeout {attempt}")
    return f"one {prompt}"


def _second(prompt: str, attempt: int) -> str:
    if int(prompt.rsplit(" ", 1)[1]) % 15 == 0:
        raise ValueError("no such model")
    return f"two {prompt}"


@query("t4_call_rounds", """
WITH p AS (SELECT o_orderkey, o_custkey AS k, 'about ' || o_custkey AS prompt, CASE WHEN o_custkey % 5 = 0 THEN 1 WHEN o_custkey % 4 = 3 THEN 3 ELSE o_custkey % 4 + 1 END AS tried, o_custkey % 5 = 0 OR o_custkey % 4 = 3 AS failed FROM orders)
SELECT o_orderkey, CASE WHEN NOT failed THEN 'one ' || prompt WHEN k % 15 = 0 THEN 'none' ELSE 'two ' || prompt END AS reply, CASE WHEN NOT failed THEN 0 WHEN k % 15 <> 0 THEN 1 END AS provider, tried + failed::INTEGER AS calls,
  CASE WHEN k % 15 = 0 THEN 'no such model' WHEN k % 5 = 0 THEN 'bad request' WHEN k % 4 > 0 THEN 'timed out: timeout ' || k % 4 END AS error FROM p""")
def t4_call_rounds(spark, d):
    """Customers' prompts, one for each of their orders, to a provider that fails for a while or for good, and to a second one; taken up again after two rounds."""
    from ..operators import calls as C
    from ..sources.files import scratch

    path, policy = scratch(spark, "calls"), R.Retry(attempts=3, seconds=0.0)
    prompts = V.table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("about "), F.col("o_custkey").cast("string")).alias("prompt"))

    class Cut(Exception):
        pass

    def cut(_: float) -> None:
        if C.rounds(spark, path) == 2:
            raise Cut

    try:
        C.answered(prompts, (_first, _second), path, policy, "none", sleep=cut)
    except Cut:
        pass
    out = C.answered(prompts, (_first, _second), path, policy, "none")
    return out.select("o_orderkey", "reply", F.col("provider").cast("long").alias("provider"), "calls", "error")


@query("t3_job_states", f"""
WITH {STEPS}, e AS (SELECT video_id, ord, step, CASE WHEN (video_id + ord) % 17 = 0 THEN 'reset' WHEN (video_id + ord) % 19 = 0 THEN 'done' WHEN status IS NULL THEN 'running' ELSE status END AS status FROM steps),
r AS (SELECT *, max(CASE WHEN status = 'reset' THEN ord END) OVER (PARTITION BY video_id) AS since FROM e),
l AS (SELECT * FROM r WHERE since IS NULL OR ord > since),
f AS (SELECT video_id, max(ord) AS at, arg_max(step, ord) AS failed FROM l WHERE status = 'failed' GROUP BY video_id),
c AS (SELECT DISTINCT l.video_id FROM l JOIN f ON f.video_id = l.video_id WHERE l.ord > f.at AND (l.status IN ('running', 'done') OR (l.status = 'success' AND l.step = f.failed))),
g AS (SELECT video_id, arg_max(status, ord) FILTER (status <> 'success') AS said, arg_max(step, ord) FILTER (status = 'success') AS won FROM l GROUP BY video_id)
SELECT j.video_id, CASE WHEN g.said = 'done' THEN 'success' ELSE coalesce(g.said, 'pending') END AS status, g.won AS last_success_step, CASE WHEN c.video_id IS NULL THEN f.failed END AS failed_step
FROM (SELECT DISTINCT video_id FROM steps) j LEFT JOIN g ON g.video_id = j.video_id LEFT JOIN f ON f.video_id = j.video_id LEFT JOIN c ON c.video_id = j.video_id""")
def t3_job_states(spark, d):
    k = F.col("video_id") + F.col("ord")
    status = F.when(k % 17 == 0, "reset").when(k % 19 == 0, "done").otherwise(F.coalesce("status", F.lit("running")))
    return R.job_states(V.steps(spark, d).select("video_id", F.col("ord").alias("seq"), "step", status.alias("status")))


@query("t3_with_steps", f"""
WITH {STEPS} SELECT j.video_id, 's' || i AS step, coalesce(s.status, 'pending') AS status
FROM (SELECT DISTINCT video_id FROM steps) j CROSS JOIN range(1, 9) t(i) LEFT JOIN (SELECT * FROM steps WHERE video_id % 4 <> 0) s ON s.video_id = j.video_id AND s.step = 's' || i""")
def t3_with_steps(spark, d):
    steps = V.steps(spark, d)
    return R.with_steps(steps.where("video_id % 4 <> 0").select("video_id", "step", "status"), steps, [f"s{i}" for i in range(1, 9)])


@query("t3_state_upsert", f"""
WITH {STEPS}, s AS (SELECT video_id, step, status, stored_hash AS config_hash, CASE WHEN status = 'failed' THEN 'old' END AS error FROM steps),
e AS (SELECT video_id, step, ord AS seq, CASE WHEN ord % 2 = 0 THEN 'success' ELSE 'failed' END AS status, hash AS config_hash, CASE WHEN ord % 2 = 1 THEN 'new' END AS error FROM steps WHERE video_id % 3 = 0
  UNION ALL SELECT video_id, 's9', ord, 'running', NULL, NULL FROM steps WHERE video_id % 5 = 0),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, step ORDER BY seq DESC) AS rn FROM e) WHERE rn = 1)
SELECT coalesce(s.video_id, l.video_id) AS video_id, coalesce(s.step, l.step) AS step, coalesce(l.status, s.status) AS status,
  CASE WHEN l.status = 'success' THEN coalesce(l.config_hash, s.config_hash) ELSE s.config_hash END AS config_hash,
  CASE WHEN l.status = 'success' THEN NULL ELSE coalesce(l.error, s.error) END AS error
FROM s FULL JOIN l ON s.video_id = l.video_id AND s.step = l.step""")
def t3_state_upsert(spark, d):
    steps = V.steps(spark, d)
    state = steps.select("video_id", "step", "status", F.col("stored_hash").alias("config_hash"), F.when(F.col("status") == "failed", "old").alias("error"))
    none = F.lit(None).cast("string")
    odd = F.col("ord") % 2 == 1
    events = steps.where("video_id % 3 = 0").select("video_id", "step", F.col("ord").alias("seq"), F.when(odd, "failed").otherwise("success").alias("status"), F.col("hash").alias("config_hash"), F.when(odd, "new").alias("error"))
    events = events.unionByName(steps.where("video_id % 5 = 0").select("video_id", F.lit("s9").alias("step"), F.col("ord").alias("seq"), F.lit("running").alias("status"), none.alias("config_hash"), none.alias("error")))
    return R.upsert(state, events)


@query("f33_backoff", "SELECT o_orderkey, greatest(0, 1.5::DOUBLE * pow(2, o_orderkey % 6)) AS delay FROM orders")
def f33_backoff(spark, d):
    from ..functions.text import backoff

    return V.table(spark, d, "orders").select("o_orderkey", backoff(F.lit(1.5), F.lit(2.0), F.col("o_orderkey") % 6).alias("delay"))


@query("f35_status_label", """
SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'OK' WHEN 1 THEN 'FAILED' WHEN 2 THEN 'SKIPPED' WHEN 3 THEN 'ODD' ELSE 'NOT_RUN' END AS label FROM orders""")
def f35_status_label(spark, d):
    from ..functions.text import status_label

    raw = F.element_at(F.array(*map(F.lit, ("success", "failed", "skipped", "odd", "not_run"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return V.table(spark, d, "orders").select("o_orderkey", status_label(raw).alias("label"))


@query("l10_better_of_two", """
SELECT o_orderkey, CASE WHEN o_custkey % 7 < o_orderkey % 7 THEN 'second' ELSE 'first' END AS chosen FROM orders""")
def l10_better_of_two(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", R.better_of(F.lit("first"), F.lit("second"), F.col("o_orderkey") % 7, F.col("o_custkey") % 7).alias("chosen"))


_OFF = "CASE WHEN y - 780 BETWEEN 12 AND 28 THEN y ELSE greatest(640, least(1101, y + greatest(-60, least(60, 18 - (y - 780))))) END"


@query("t6_fit_rounds", f"""
WITH p AS (SELECT p_partkey AS ord, 700 + p_partkey % 200 AS y FROM part), one AS (SELECT ord, {_OFF} AS y FROM p), two AS (SELECT ord, {_OFF} AS y FROM one)
SELECT ord, 'Dialogue: {{\\an2\\pos(360,' || y || ')}}x' AS line FROM two""")
def t6_fit_rounds(spark, d):
    """Texts that start off their gap, moved over two rounds against a renderer that shifts by the position's change."""
    from ..operators import fit as T
    from ..sources.files import scratch

    start = V.table(spark, d, "part").select(F.lit("v").alias("video_id"), F.col("p_partkey").alias("ord"), (700 + F.col("p_partkey") % 200).alias("y"))
    events = start.select("video_id", "ord", F.lit(1280).alias("frame_height"), F.concat(F.lit(r"Dialogue: {\an2\pos(360,"), F.col("y").cast("string"), F.lit(")}x")).alias("line"))

    def measure(e):
        y = F.regexp_extract("line", r"\\pos\(\d+,(\d+)\)", 1).cast("long")
        return e.select("video_id", F.col("ord").alias("index"), (y - 780).alias("gap"), F.lit("original").alias("confidence"))

    def cut(df):
        path = scratch(spark, "rounds")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return T.fit(events, measure, cut)[0].select("ord", "line")


# The first recursion fills the anti-diagonals of a pair's matrix, each from the two before it, with the move into each cell; the second goes back along the moves.
# Cells that a diagonal has outside of the matrix meet no element.
@query("f40_warp", """
WITH RECURSIVE p AS (SELECT x.vec_id AS pair_id, len(x.embedding) AS n, len(y.embedding) AS m, list_prepend(NULL, x.embedding) AS a,
    list_concat(list_transform(range(n + 1), lambda i: NULL::FLOAT), y.embedding, list_transform(range(n + 1), lambda i: NULL::FLOAT)) AS b FROM embeddings x JOIN embeddings y ON y.vec_id + 1 = x.vec_id),
d AS (
  SELECT pair_id, 1::BIGINT AS k, list_transform(range(n + 1), lambda i: CASE WHEN i = 0 THEN 0.0::DOUBLE ELSE 'inf'::DOUBLE END) AS two, list_transform(range(n + 1), lambda i: 'inf'::DOUBLE) AS one, []::INTEGER[] AS move FROM p
  UNION ALL
  SELECT pair_id, k + 1, one,
    list_transform(c, lambda x: CASE WHEN x[4] IS NULL OR x[5] IS NULL THEN 'inf'::DOUBLE ELSE abs(x[4] - x[5])::DOUBLE + CASE WHEN x[1] < x[2] AND x[1] < x[3] THEN x[1] WHEN x[2] < x[1] AND x[2] < x[3] THEN x[2] ELSE x[3] END END),
    list_transform(c, lambda x: CASE WHEN x[1] < x[2] AND x[1] < x[3] THEN 0 WHEN x[2] < x[1] AND x[2] < x[3] THEN 1 ELSE 2 END)
  FROM (SELECT d.pair_id, d.k, d.one, list_zip(list_prepend(NULL, d.two[:n]), list_prepend(NULL, d.one[:n]), d.one, p.a, list_reverse(p.b[d.k + 2:d.k + n + 2])) AS c FROM d JOIN p ON p.pair_id = d.pair_id WHERE d.k < n + m)),
g AS MATERIALIZED (SELECT pair_id, list(move ORDER BY k) AS moves FROM d GROUP BY pair_id),
t AS (
  SELECT pair_id, n AS i, m AS j FROM p WHERE n > 0 AND m > 0
  UNION ALL
  SELECT pair_id, i - (how <> 2)::BIGINT, j - (how <> 1)::BIGINT FROM (SELECT t.pair_id, t.i, t.j, g.moves[t.i + t.j][t.i + 1] AS how FROM t JOIN g ON g.pair_id = t.pair_id WHERE t.i > 0 AND t.j > 0))
SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY i + j) - 1 AS step, i - 1 AS i, j - 1 AS j FROM t WHERE i > 0 AND j > 0""")
def f40_warp(spark, d):
    from ..operators.warp import distance, warp

    e = V.table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("a"))
    pairs = e.join(e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("a").alias("b")), "vec_id")
    # Costs as differences of single precision, as the vectors are stored.
    return warp(pairs.select(F.col("vec_id").cast("long").alias("pair_id"), "a", "b"), lambda x, y: distance(x.astype("float32"), y.astype("float32")).astype(float))
