"""Queries over cues: cleaning, quality, alignment and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import timecode as C
from ..operators import align as A
from ..operators import cues as Q
from ..operators import sampling as S
from .. import sinks as K
from ..sources import subtitles as R
from . import views as V
from .catalog import query
from .views import CUES, OTHER


def _join(column: str, *fields: str):
    """A list of structs as text, so that both engines compare it."""
    return F.array_join(F.transform(column, lambda s: F.concat_ws(":", *(s[f].cast("string") for f in fields))), ";")


@query("a1_quality_report", f"""
WITH {CUES},
g AS (SELECT *, start_ms - lag(end_ms) OVER w AS gap, lag("index") OVER w AS before FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY ord))
SELECT video_id, arg_min(start_ms, ord) AS first_start_ms, arg_max(end_ms, ord) AS last_end_ms, count(*) AS subtitle_count,
  count(*) FILTER (WHERE gap > 9000) AS large_gap_count, count(*) FILTER (WHERE end_ms - start_ms < 250) AS short_item_count,
  count(*) FILTER (WHERE end_ms - start_ms > 9000) AS long_item_count,
  coalesce(array_to_string((list(before || ':' || "index" || ':' || gap ORDER BY ord) FILTER (WHERE gap > 9000))[1:50], ';'), '') AS large_gaps,
  coalesce(array_to_string((list("index" || ':' || (end_ms - start_ms) ORDER BY ord) FILTER (WHERE end_ms - start_ms < 250))[1:20], ';'), '') AS short_items,
  coalesce(array_to_string((list("index" || ':' || (end_ms - start_ms) ORDER BY ord) FILTER (WHERE end_ms - start_ms > 9000))[1:20], ';'), '') AS long_items,
  count(*) FILTER (WHERE gap > 9000 OR end_ms - start_ms > 9000) = 0 AS passed
FROM g GROUP BY video_id""")
def a1_quality_report(spark, d):
    out = Q.quality(V.cues(spark, d))
    return out.withColumns({"large_gaps": _join("large_gaps", "after_index", "before_index", "gap_ms"), "short_items": _join("short_items", "index", "duration_ms"), "long_items": _join("long_items", "index", "duration_ms")})


@query("a2_quality_score", f"""
WITH {CUES}, g AS (SELECT *, start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY ord) AS gap FROM cues)
SELECT video_id, 5 * count(*) FILTER (WHERE gap > 9000) + 4 * count(*) FILTER (WHERE end_ms - start_ms > 9000) + count(*) FILTER (WHERE end_ms - start_ms < 250) AS score
FROM g GROUP BY video_id""")
def a2_quality_score(spark, d):
    return Q.quality(V.cues(spark, d)).select("video_id", Q.quality_score().alias("score"))


@query("w1_gaps", f"""
WITH {CUES}, g AS (SELECT video_id, ord, lag("index") OVER w AS after_index, "index" AS before_index, lag(end_ms) OVER w AS gap_start_ms, start_ms AS gap_end_ms
  FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY ord))
SELECT *, gap_end_ms - gap_start_ms AS gap_ms FROM g WHERE gap_end_ms - gap_start_ms > 9000""")
def w1_gaps(spark, d):
    return Q.gaps(V.cues(spark, d))


_CLAMPED = f"""{CUES}, k AS (SELECT video_id, ord, "index", greatest(0, start_ms) AS start_ms, greatest(greatest(0, start_ms) + 800, end_ms) AS end_ms, text FROM cues),
clamped AS (SELECT video_id, ord, "index", start_ms, least(end_ms, start_ms + 7000) AS end_ms, text FROM k)"""


@query("p3_clamp_durations", f"WITH {_CLAMPED} SELECT * FROM clamped")
def p3_clamp_durations(spark, d):
    return Q.clamped(V.cues(spark, d)).select("video_id", "ord", "index", "start_ms", "end_ms", "text")


@query("p4_first_start_guard", f"""
WITH {CUES}, k AS (SELECT *, video_id % 5 * 700 AS seen FROM cues),
c AS (SELECT video_id, ord, greatest(0, start_ms - 40000) AS start_ms, greatest(greatest(0, start_ms - 40000) + 800, end_ms - 40000) AS end_ms, seen FROM k),
m AS (SELECT video_id, ord, CASE WHEN ord = 1 AND start_ms < 500 AND seen > 800 THEN least(seen, greatest(0, end_ms - 800)) ELSE start_ms END AS start_ms, end_ms FROM c)
SELECT video_id, ord, start_ms, least(end_ms, start_ms + 7000) AS end_ms FROM m""")
def p4_first_start_guard(spark, d):
    c = V.cues(spark, d).withColumn("start_ms", F.col("start_ms") - 40000).withColumn("end_ms", F.col("end_ms") - 40000).withColumn("seen", F.col("video_id") % 5 * 700)
    return Q.clamped(c, visual_start="seen").select("video_id", "ord", "start_ms", "end_ms")


_CASCADE = """walk AS (
  SELECT video_id, ord, start_ms, end_ms FROM clamped WHERE ord = 1
  UNION ALL
  SELECT c.video_id, c.ord, CASE WHEN c.start_ms < w.end_ms THEN w.end_ms + 1 ELSE c.start_ms END,
    CASE WHEN c.start_ms < w.end_ms THEN greatest(c.end_ms, w.end_ms + 1 + 800) ELSE c.end_ms END
  FROM walk w JOIN clamped c ON c.video_id = w.video_id AND c.ord = w.ord + 1)"""


@query("w2_deoverlap", f"WITH RECURSIVE {_CLAMPED}, {_CASCADE} SELECT video_id, ord, start_ms, end_ms FROM walk")
def w2_deoverlap(spark, d):
    return Q.separated(Q.clamped(V.cues(spark, d))).select("video_id", "ord", "start_ms", "end_ms")


@query("w3_merge_short", f"""
WITH RECURSIVE {CUES}, clamped AS (SELECT video_id, ord, start_ms, least(greatest(end_ms, start_ms + 800), start_ms + 500 + ord % 4 * 200) AS end_ms, text FROM cues),
walk AS (
  SELECT video_id, ord, 1::BIGINT AS n, start_ms, end_ms, text FROM clamped WHERE ord = 1
  UNION ALL
  SELECT video_id, ord, CASE WHEN short THEN n ELSE n + 1 END, CASE WHEN short THEN ls ELSE s END, CASE WHEN short THEN greatest(le, e) ELSE e END, CASE WHEN short THEN lt || text ELSE text END
  FROM (SELECT *, e - s < 800 AS short FROM (
    SELECT c.video_id, c.ord, w.n, w.start_ms AS ls, w.end_ms AS le, w.text AS lt, c.text,
      CASE WHEN c.start_ms < w.end_ms THEN w.end_ms + 1 ELSE c.start_ms END AS s,
      CASE WHEN c.start_ms < w.end_ms THEN greatest(c.end_ms, w.end_ms + 801) ELSE c.end_ms END AS e
    FROM walk w JOIN clamped c ON c.video_id = w.video_id AND c.ord = w.ord + 1)))
SELECT video_id, n AS ord, arg_max(start_ms, walk.ord) AS start_ms, arg_max(end_ms, walk.ord) AS end_ms, arg_max(text, walk.ord) AS text FROM walk GROUP BY video_id, n""")
def w3_merge_short(spark, d):
    end = F.least(F.greatest(F.col("end_ms"), F.col("start_ms") + 800), F.col("start_ms") + 500 + F.col("ord") % 4 * 200)
    return Q.separated(V.cues(spark, d).withColumn("end_ms", end)).select("video_id", "ord", "start_ms", "end_ms", "text")


@query("w4_renumber", f"""
WITH {CUES} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS ord, start_ms FROM cues WHERE ord % 3 <> 0""")
def w4_renumber(spark, d):
    return Q.renumber(V.cues(spark, d).where("ord % 3 <> 0")).select("video_id", "ord", "start_ms")


_RUNS = f"""{CUES}, k AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER w OR ord = 1 THEN 1 ELSE 0 END AS new FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
r AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY ord) AS run FROM k),
t AS (SELECT *, count(*) OVER (PARTITION BY video_id, run) AS run_count,
  last(end_ms) OVER v - first(start_ms) OVER v AS run_span_ms FROM r WINDOW v AS (PARTITION BY video_id, run ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
f AS (SELECT *, text <> '' AND run_count >= 4 AND run_span_ms >= 20000 AS dropped FROM t)"""


@query("w5_repeated_runs", f"WITH {_RUNS} SELECT video_id, ord, run::BIGINT AS run, run_count, run_span_ms, dropped FROM f")
def w5_repeated_runs(spark, d):
    return Q.repeated_runs(V.cues(spark, d), Q.Clean(repeat_span_ms=20000)).select("video_id", "ord", "run", "run_count", "run_span_ms", "dropped")


@query("w5_without_repeats", f"WITH {_RUNS} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS ord, start_ms, text FROM f WHERE NOT dropped")
def w5_without_repeats(spark, d):
    return Q.without_repeats(V.cues(spark, d), Q.Clean(repeat_span_ms=20000)).select("video_id", "ord", "start_ms", "text")


@query("w6_basic_errors", f"""
WITH {CUES}, {OTHER}, k AS (SELECT *, row_number() OVER w AS n, lag(end_ms, 1, -1) OVER w AS before FROM other WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
e AS (
  SELECT video_id, ord, 1 AS check_no, 'index ' || "index" || ' should be ' || n AS message FROM k WHERE "index" <> n
  UNION ALL SELECT video_id, ord, 2, 'index ' || n || ' has empty text' FROM k WHERE trim(text) = ''
  UNION ALL SELECT video_id, ord, 3, 'index ' || n || ' start time is not before end time' FROM k WHERE start_ms >= end_ms
  UNION ALL SELECT video_id, ord, 4, 'index ' || n || ' overlaps previous subtitle' FROM k WHERE start_ms < before
  UNION ALL SELECT c_custkey, 0, 5, 'subtitle file has no valid items' FROM customer WHERE c_custkey NOT IN (SELECT video_id FROM other))
SELECT * FROM e""")
def w6_basic_errors(spark, d):
    tracks = V.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"))
    return Q.errors(V.other(spark, d), tracks)


@query("w7_bridged_chunks", f"""
WITH {CUES}, k AS (SELECT *, CASE WHEN start_ms - lag(end_ms) OVER w <= 4000 THEN 0 ELSE 1 END AS new FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
r AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY ord) AS run FROM k)
SELECT video_id, run::BIGINT AS run, arg_min(start_ms, ord) AS "start", arg_max(end_ms, ord) AS "end", count(*) AS n_chunks FROM r GROUP BY video_id, run""")
def w7_bridged_chunks(spark, d):
    c = V.cues(spark, d).select("video_id", "ord", F.col("start_ms").alias("start"), F.col("end_ms").alias("end"))
    return Q.bridged(c, 4000)


@query("p1_solid_cues", f"""
WITH {CUES}, k AS (SELECT video_id, ord, CASE WHEN ord % 5 = 0 THEN ' ' || chr(12288) || chr(160) || chr(10) WHEN ord % 7 = 0 THEN '' ELSE ' ' || text END AS text FROM cues)
SELECT * FROM k WHERE regexp_replace(text, '[\\s\\p{{Z}}]', '', 'g') <> ''""")
def p1_solid_cues(spark, d):
    o = F.col("ord")
    text = F.when(o % 5 == 0, " 　 \n").when(o % 7 == 0, "").otherwise(F.concat(F.lit(" "), "text"))
    return Q.solid(V.cues(spark, d).select("video_id", "ord", text.alias("text")))


@query("p2_positive_cues", f"WITH {CUES} SELECT video_id, ord, start_ms, end_ms - 500 AS end_ms FROM cues WHERE end_ms - 500 > start_ms")
def p2_positive_cues(spark, d):
    return Q.positive(V.cues(spark, d).withColumn("end_ms", F.col("end_ms") - 500)).select("video_id", "ord", "start_ms", "end_ms")


@query("p7_visual_filter", f"""
WITH {CUES}, v AS (SELECT video_id, ord, start_ms, end_ms - start_ms >= 700 AS looked, CASE WHEN ord % 9 = 0 THEN NULL ELSE (start_ms + video_id) % (3 + video_id % 9) <> 0 END AS visible FROM cues),
g AS (SELECT *, looked AND NOT coalesce(visible, FALSE) AS gone FROM v),
r AS (SELECT *, coalesce(sum(gone::INT) OVER w / nullif(sum(looked::INT) OVER w, 0), 0) AS ratio FROM g WINDOW w AS (PARTITION BY video_id))
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS ord, start_ms FROM r WHERE ratio > 0.25 OR NOT gone""")
def p7_visual_filter(spark, d):
    c = V.cues(spark, d)
    seen = c.select("video_id", "ord", F.when(F.col("ord") % 9 != 0, (F.col("start_ms") + F.col("video_id")) % (3 + F.col("video_id") % 9) != 0).alias("visible"))
    return Q.visual_filter(c, seen, fail=False).select("video_id", "ord", "start_ms")


@query("a9_drop_ratio", f"""
WITH {CUES}, v AS (SELECT video_id, end_ms - start_ms >= 700 AS looked, (start_ms + video_id) % (3 + video_id % 9) = 0 AS hidden FROM cues)
SELECT video_id, count(*) FILTER (WHERE looked) AS checked, count(*) FILTER (WHERE looked AND hidden) AS dropped,
  round_even(coalesce(count(*) FILTER (WHERE looked AND hidden)::DOUBLE / nullif(count(*) FILTER (WHERE looked), 0), 0), 4) AS drop_ratio FROM v GROUP BY video_id""")
def a9_drop_ratio(spark, d):
    v = V.cues(spark, d).select("video_id", (Q.duration() >= 700).alias("looked"), ((F.col("start_ms") + F.col("video_id")) % (3 + F.col("video_id") % 9) == 0).alias("hidden"))
    out = v.groupBy("video_id").agg(F.count_if("looked").alias("checked"), F.count_if(F.col("looked") & F.col("hidden")).alias("dropped"))
    return out.withColumn("drop_ratio", F.bround(F.coalesce(F.try_divide("dropped", "checked"), F.lit(0.0)), 4))


@query("p8_low_confidence", """
SELECT event_id AS ord, user_id AS video_id FROM events
WHERE event_id % 10 <> 0 AND (coalesce(CASE WHEN event_id % 3 <> 0 THEN -value / 50 END, 0) < -1.0 OR coalesce(CASE WHEN event_id % 4 <> 0 THEN value / 100 END, 0) > 0.85)""")
def p8_low_confidence(spark, d):
    e = V.table(spark, d, "events")
    i, v = F.col("event_id"), F.col("value")
    s = e.select(i.alias("ord"), F.col("user_id").alias("video_id"), F.when(i % 10 == 0, " ").otherwise(F.col("event_type")).alias("text"), F.when(i % 3 != 0, -v / 50).alias("avg_logprob"), F.when(i % 4 != 0, v / 100).alias("no_speech_prob"))
    return Q.low_confidence(s).select("ord", "video_id")


@query("s11_segments_to_cues", f"""
WITH {CUES}, s AS (SELECT video_id, ord, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS "index", start_ms / 1000.0 AS s, end_ms / 1000.0 AS e, CASE WHEN ord % 4 = 0 THEN '  ' ELSE ' ' || text END AS text FROM cues)
SELECT video_id, ord, "index", trunc(s::DOUBLE * 1000)::BIGINT AS start_ms, trunc(e::DOUBLE * 1000)::BIGINT AS end_ms, trim(text) AS text FROM s WHERE trim(text) <> ''""")
def s11_segments_to_cues(spark, d):
    c = V.cues(spark, d)
    s = c.select("video_id", "ord", (F.col("start_ms") / F.lit(1000.0)).alias("start"), (F.col("end_ms") / F.lit(1000.0)).alias("end"), F.when(F.col("ord") % 4 == 0, "  ").otherwise(F.concat(F.lit(" "), "text")).alias("text"))
    return Q.from_segments(s)


@query("a6_mean_confidence", """
SELECT user_id AS video_id, round_even(avg(CASE WHEN event_id % 6 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END), 4) AS mean_confidence FROM events GROUP BY user_id""")
def a6_mean_confidence(spark, d):
    i = F.col("event_id")
    word = F.struct(F.when(i % 6 != 0, (i % 100) / F.lit(100.0)).alias("confidence"))
    s = V.table(spark, d, "events").select(F.col("user_id").alias("video_id"), F.array(word).alias("words"))
    return Q.mean_confidence(s)


@query("a3_timing_report", f"""
WITH {CUES}, {OTHER},
s AS (SELECT video_id, arg_min(start_ms, ord) AS a, arg_max(end_ms, ord) AS b, sum(greatest(0, end_ms - start_ms)) AS t, count(*) AS n FROM cues GROUP BY video_id),
o AS (SELECT video_id, arg_min(start_ms, ord) AS a, arg_max(end_ms, ord) AS b, sum(greatest(0, end_ms - start_ms)) AS t, count(*) AS n FROM other WHERE video_id % 6 <> 0 GROUP BY video_id),
j AS (SELECT coalesce(s.video_id, o.video_id) AS video_id, coalesce(s.a, 0) AS source_start_ms, coalesce(s.b, 0) AS source_end_ms, coalesce(s.t, 0)::BIGINT AS source_total_ms, coalesce(s.n, 0) AS source_count,
  coalesce(o.a, 0) AS en_start_ms, coalesce(o.b, 0) AS en_end_ms, coalesce(o.t, 0)::BIGINT AS en_total_ms, coalesce(o.n, 0) AS en_count FROM s FULL JOIN o ON s.video_id = o.video_id)
SELECT *, greatest(0, source_end_ms - source_start_ms) AS source_span_ms, greatest(0, en_end_ms - en_start_ms) AS en_span_ms,
  source_start_ms = en_start_ms AND source_end_ms = en_end_ms AS span_equal, source_total_ms = en_total_ms AS total_time_equal, source_count = en_count AS count_equal FROM j""")
def a3_timing_report(spark, d):
    return Q.timing(V.cues(spark, d), V.other(spark, d).where("video_id % 6 <> 0"))


@query("a12_track_text", f"""
WITH {CUES}, l AS (SELECT video_id, ord, CASE WHEN ord % 5 = 0 THEN ' ' ELSE text END AS text FROM cues)
SELECT video_id, left(string_agg(text, chr(10) ORDER BY ord), 4500) AS text FROM l WHERE text <> ' ' GROUP BY video_id""")
def a12_track_text(spark, d):
    c = V.cues(spark, d).withColumn("text", F.when(F.col("ord") % 5 == 0, " ").otherwise(F.concat(F.lit(" "), "text", F.lit("\n "))))
    return Q.track_text(c, 4500)


# ---- alignment

_LAST = """lasts AS (SELECT video_id, "index", arg_max(text, ord) AS text FROM other GROUP BY video_id, "index")"""


@query("j1_align_to_source", f"""
WITH {CUES}, {OTHER}, {_LAST},
p AS (SELECT c.*, row_number() OVER (PARTITION BY c.video_id ORDER BY c.ord) AS place FROM cues c)
SELECT p.video_id, p.ord, p."index", p.start_ms, p.end_ms, trim(CASE WHEN l.video_id IS NOT NULL THEN l.text ELSE o.text END, ' ' || chr(10)) AS text,
  CASE WHEN l.video_id IS NOT NULL THEN 'index' WHEN o.video_id IS NOT NULL THEN 'position' END AS matched
FROM p LEFT JOIN lasts l ON l.video_id = p.video_id AND l."index" = p."index" LEFT JOIN other o ON o.video_id = p.video_id AND o.ord = p.place""")
def j1_align_to_source(spark, d):
    return A.aligned(V.cues(spark, d), V.other(spark, d))


@query("u3_missing_keys", f"""WITH {CUES}, {OTHER} SELECT c.* FROM cues c WHERE NOT EXISTS (SELECT 1 FROM other o WHERE o.video_id = c.video_id AND o."index" = c."index")""")
def u3_missing_keys(spark, d):
    return A.missing_keys(V.cues(spark, d), V.other(spark, d)).select("video_id", "ord", "index", "start_ms", "end_ms", "text")


@query("j2_repair_chunks", f"""
WITH {CUES}, {OTHER},
s AS (SELECT *, (row_number() OVER w - 1) // 4 + 1 AS chunk, (row_number() OVER w - 1) % 4 + 1 AS place FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
o AS (SELECT *, (row_number() OVER w - 1) // 4 + 1 AS chunk, (row_number() OVER w - 1) % 4 + 1 AS place FROM other WINDOW w AS (PARTITION BY video_id ORDER BY ord)),
z AS (SELECT a.video_id, a.chunk, a.n = coalesce(b.n, 0) AS whole FROM (SELECT video_id, chunk, count(*) AS n FROM s GROUP BY ALL) a LEFT JOIN (SELECT video_id, chunk, count(*) AS n FROM o GROUP BY ALL) b ON a.video_id = b.video_id AND a.chunk = b.chunk),
l AS (SELECT video_id, chunk, "index", arg_max(text, ord) AS text FROM o GROUP BY ALL)
SELECT o.video_id, o.chunk, o.place, o.text, 'chunk' AS origin FROM o JOIN z ON z.video_id = o.video_id AND z.chunk = o.chunk WHERE whole
UNION ALL
SELECT s.video_id, s.chunk, s.place, CASE WHEN l.video_id IS NOT NULL THEN l.text ELSE s.text || '!' END, CASE WHEN l.video_id IS NOT NULL THEN 'index' ELSE 'single' END
FROM s JOIN z ON z.video_id = s.video_id AND z.chunk = s.chunk LEFT JOIN l ON l.video_id = s.video_id AND l.chunk = s.chunk AND l."index" = s."index" WHERE NOT whole""")
def j2_repair_chunks(spark, d):
    c = V.cues(spark, d)
    single = c.select("video_id", "index", F.concat("text", F.lit("!")).alias("text"))
    return A.repaired_chunks(c, V.other(spark, d), single, chunk=4)


@query("j3_repair_bad", f"""
WITH {CUES}, {OTHER}
SELECT o.video_id, o.ord, o."index", CASE WHEN (trim(o.text) = '' OR contains(o.text, '[Translation unavailable]') OR regexp_matches(o.text, '[\\x{{3400}}-\\x{{9fff}}]')) AND c.video_id IS NOT NULL THEN c.text || '!' ELSE o.text END AS text
FROM other o LEFT JOIN cues c ON c.video_id = o.video_id AND c."index" = o."index" """)
def j3_repair_bad(spark, d):
    c = V.cues(spark, d)
    fixes = c.select("video_id", "index", F.concat("text", F.lit("!")).alias("text")).unionByName(c.select("video_id", (F.col("index") + 100000).alias("index"), "text"))
    return A.repaired(V.other(spark, d), fixes, c).select("video_id", "ord", "index", "text")


_ZIP = """z AS (SELECT s.video_id, s.ord AS place, s.start_ms AS s_start_ms, s.end_ms AS s_end_ms, s.text AS s_text, o.start_ms AS o_start_ms, o.end_ms AS o_end_ms, o.text AS o_text, o.video_id AS there
  FROM cues s LEFT JOIN other o ON o.video_id = s.video_id AND o.ord = s.ord)"""


@query("j4_zip_inner", f"WITH {CUES}, {OTHER}, {_ZIP} SELECT video_id, place, s_start_ms, o_start_ms FROM z WHERE there IS NOT NULL")
def j4_zip_inner(spark, d):
    return A.zipped(V.cues(spark, d), V.other(spark, d)).select("video_id", "place", "s_start_ms", "o_start_ms")


@query("j5_zip_left", f"WITH {CUES}, {OTHER}, {_ZIP} SELECT video_id, place, s_text, o_text FROM z")
def j5_zip_left(spark, d):
    return A.zipped(V.cues(spark, d), V.other(spark, d), "left").select("video_id", "place", "s_text", "o_text")


@query("p9_bad_translations", f"""
WITH {CUES}, {OTHER} SELECT video_id, "index" FROM other WHERE trim(text) = '' OR contains(text, '[Translation unavailable]') OR regexp_matches(text, '[\\x{{3400}}-\\x{{9fff}}]')""")
def p9_bad_translations(spark, d):
    return V.other(spark, d).where(A.is_bad(F.col("text"))).select("video_id", "index")


@query("p10_translation_errors", f"""
WITH {CUES}, {OTHER}
SELECT video_id, ord, 1 AS check_no, 'index ' || "index" || ' has empty translation' AS message FROM other WHERE trim(text) = ''
UNION ALL SELECT video_id, ord, 2, 'index ' || "index" || ' uses placeholder translation' FROM other WHERE contains(text, '[Translation unavailable]')
UNION ALL SELECT video_id, ord, 3, 'index ' || "index" || ' still contains Chinese text' FROM other WHERE regexp_matches(text, '[\\x{{3400}}-\\x{{9fff}}]')""")
def p10_translation_errors(spark, d):
    return A.translation_errors(V.other(spark, d))


@query("w12_chunks", f"WITH {CUES} SELECT video_id, ord, (ord - 1) // 20 + 1 AS chunk, (ord - 1) % 20 + 1 AS place FROM cues")
def w12_chunks(spark, d):
    return A.chunked(V.cues(spark, d)).select("video_id", "ord", "chunk", "place")


@query("t9_accepted_track", f"""
WITH {CUES}, {OTHER}, ok AS (SELECT video_id FROM (SELECT video_id, count(*) AS n FROM cues GROUP BY 1) JOIN (SELECT video_id, count(*) AS m FROM other GROUP BY 1) USING (video_id) WHERE n = m)
SELECT video_id, ord, text FROM other WHERE video_id IN (SELECT * FROM ok) UNION ALL SELECT video_id, ord, text FROM cues WHERE video_id NOT IN (SELECT * FROM ok)""")
def t9_accepted_track(spark, d):
    return A.accepted(V.cues(spark, d), V.other(spark, d)).select("video_id", "ord", "text")


@query("t10_placeholder_track", f"WITH {CUES} SELECT video_id, ord, start_ms, '[Translation unavailable]' AS text FROM cues")
def t10_placeholder_track(spark, d):
    return A.placeholder(V.cues(spark, d)).select("video_id", "ord", "start_ms", "text")


@query("e2_en_check", f"""
WITH {CUES}, {OTHER}, {_ZIP}
SELECT video_id, place AS ord, s_start_ms AS start_ms, s_end_ms AS end_ms,
  o_start_ms <> s_start_ms OR o_end_ms <> s_end_ms AS adjusted, contains(o_text, chr(65533)) AS garbled FROM z WHERE there IS NOT NULL""")
def e2_en_check(spark, d):
    out = A.checked(V.cues(spark, d), V.other(spark, d))
    return out.select("video_id", "ord", "start_ms", "end_ms", F.exists("warnings", lambda w: F.contains(w, F.lit("adjusted"))).alias("adjusted"), "garbled")


# ---- files

@query("s2_srt_parse", f"""
WITH {CUES} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS ord, CASE WHEN ord % 10 = 3 THEN row_number() OVER (PARTITION BY video_id ORDER BY ord) ELSE ord END AS "index", start_ms, end_ms, text FROM cues WHERE ord % 10 <> 7""")
def s2_srt_parse(spark, d):
    c = V.cues(spark, d).where("ord % 10 <> 7").withColumn("head", F.when(F.col("ord") % 10 == 3, "no number").otherwise(F.col("ord").cast("string")))
    block = F.concat("head", F.lit("\r\n"), C.srt_time(F.col("start_ms")), F.lit(" --> "), C.srt_time(F.col("end_ms")), F.lit(" X1:0\r\n"), "text", F.lit(" "))
    files = c.groupBy("video_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", block.alias("b")))), lambda s: s["b"]), "\r\n \t\r\n").alias("t"))
    text = F.concat(F.lit("﻿"), F.col("t"), F.lit("\n\nshort\n\n9\nno time\nx\n"))
    return R.parse_srt(files.select("video_id", text.alias("text")))


def _srt_sql(x):
    return f"format('{{:02d}}:{{:02d}}:{{:02d}},{{:03d}}', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _ass_sql(x):
    return f"format('{{:d}}:{{:02d}}:{{:02d}}.{{:02d}}', {x} // 360000, {x} // 6000 % 60, {x} // 100 % 60, {x} % 100)"


@query("k2_srt_write", f"""
WITH {CUES} SELECT video_id, string_agg(ord || chr(10) || {_srt_sql("start_ms")} || ' --> ' || {_srt_sql("end_ms")} || chr(10) || text, chr(10) || chr(10) ORDER BY ord) || chr(10) AS content FROM cues GROUP BY video_id""")
def k2_srt_write(spark, d):
    return K.srt(V.cues(spark, d).withColumn("text", F.concat(F.lit(" "), "text")))


@query("k4_ass_events", f"""
WITH {CUES}, {OTHER}, {_ZIP}, t AS (SELECT *, round_even(s_start_ms / 10.0, 0)::BIGINT AS a, round_even(s_end_ms / 10.0, 0)::BIGINT AS b, replace(replace(replace(o_text, '{{', '\\{{'), '}}', '\\}}'), chr(10), '\\N') AS above FROM z)
SELECT video_id, place AS ord, 'Dialogue: 0,' || {_ass_sql("a")} || ',' || {_ass_sql("b")} || ',Default,,0,0,0,,' || CASE WHEN above IS NOT NULL THEN above || '\\N' ELSE '' END || '\\{{' || s_text || '\\}}' AS line FROM t""")
def k4_ass_events(spark, d):
    c = V.cues(spark, d).withColumn("text", F.concat(F.lit("{"), "text", F.lit("}")))
    return K.ass_events(c, V.other(spark, d))


@query("j8_positions", f"""
WITH {CUES} SELECT video_id, ord, 'Dialogue: 0,' || {_ass_sql("round_even(start_ms / 10.0, 0)::BIGINT")} || ',' || {_ass_sql("round_even(end_ms / 10.0, 0)::BIGINT")} || ',Default,,0,0,0,,' || CASE WHEN ord % 2 = 0 THEN '{{\\an2\\pos(360,' || (800 + ord) || ')}}' ELSE '' END || text AS line FROM cues""")
def j8_positions(spark, d):
    c = V.cues(spark, d)
    places = c.where("ord % 2 = 0").select("video_id", "ord", F.concat(F.lit(r"{\an2\pos(360,"), (800 + F.col("ord")).cast("string"), F.lit(")}")).alias("override"))
    return K.ass_events(c, None, places)


# ---- sampling

# Every cue of a track in order of its distance: first those that keep apart from what is taken, then, from the nearest on, what is still wanted.
@query("w8_near_centre", f"""
WITH RECURSIVE {CUES},
m AS (SELECT video_id, ord, (start_ms + end_ms) / 2.0::DOUBLE AS mid, greatest(start_ms / 1000.0::DOUBLE + 0.05::DOUBLE, least(end_ms / 1000.0::DOUBLE - 0.05::DOUBLE, (start_ms + end_ms) / 2.0::DOUBLE / 1000)) AS t FROM cues WHERE end_ms > start_ms),
c AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY abs(mid - 300.0::DOUBLE * 500), ord) AS n, t, round_even(greatest(0.0::DOUBLE, least(300.0::DOUBLE, t)), 3) AS s, round_even(greatest(0.0::DOUBLE, least(300.0::DOUBLE, mid / 1000)), 3) AS p FROM m),
one AS (
  SELECT video_id, 0::BIGINT AS n, []::DOUBLE[] AS got FROM c GROUP BY video_id
  UNION ALL
  SELECT c.video_id, c.n, CASE WHEN len(one.got) < 4 AND len(list_filter(one.got, lambda g: abs(c.t - g) < 5.0)) = 0 THEN list_append(one.got, c.s) ELSE one.got END
  FROM one JOIN c ON c.video_id = one.video_id AND c.n = one.n + 1),
two AS (
  SELECT video_id, 0::BIGINT AS n, arg_max(got, n) AS got FROM one GROUP BY video_id
  UNION ALL
  SELECT c.video_id, c.n, CASE WHEN len(two.got) < 4 AND NOT list_contains(two.got, c.p) THEN list_append(two.got, c.p) ELSE two.got END
  FROM two JOIN c ON c.video_id = two.video_id AND c.n = two.n + 1)
SELECT video_id, array_to_string(list_transform(list_sort(arg_max(got, n)), lambda x: x::VARCHAR), ',') AS picked FROM two GROUP BY video_id""")
def w8_near_centre(spark, d):
    c = V.cues(spark, d).withColumn("video_seconds", F.lit(300.0))
    out = S.near_centre(c, "video_seconds", 4, 5.0, clamp=True, fill=True, keys=("video_id", "video_seconds"))
    return out.select("video_id", F.array_join(F.transform("seconds", lambda s: s.cast("string")), ",").alias("picked"))


@query("w9_even_samples", """
SELECT c_custkey AS video_id, i AS sample_no, round(i * (c_acctbal + 1000) / 6.0, 6) AS second, round(greatest(0, least(c_acctbal + 1000, (c_acctbal + 1000) / 2 - 2 + (i - 1) * 1.0)), 6) AS centred
FROM customer, range(1, 6) t(i)""")
def w9_even_samples(spark, d):
    c = V.table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), (F.col("c_acctbal") + 1000).alias("t"))
    e = c.select("video_id", F.posexplode(F.arrays_zip(S.even(F.col("t"), 5).alias("a"), S.centred(F.col("t"), 5).alias("b"))).alias("n", "z"))
    return e.select("video_id", (F.col("n") + 1).cast("long").alias("sample_no"), F.round(F.col("z.a"), 6).alias("second"), F.round(F.col("z.b"), 6).alias("centred"))


@query("w10_strided", f"""
WITH {CUES}, k AS (SELECT video_id, ord, count(*) OVER (PARTITION BY video_id) AS n, row_number() OVER (PARTITION BY video_id ORDER BY ord) - 1 AS i FROM cues)
SELECT video_id, ord FROM k WHERE n <= 6 OR (i % greatest(1, n // 6) = 0 AND i // greatest(1, n // 6) < 6)""")
def w10_strided(spark, d):
    return S.strided(V.cues(spark, d), 6).select("video_id", "ord")


@query("w13_first_seen", """
SELECT user_id AS video_id, CASE WHEN min(s) IS NOT NULL THEN greatest(0, trunc(min(s) * 1000)::BIGINT - 200) END AS first_visual_ms
FROM (SELECT user_id, CASE WHEN event_type = 'click' AND event_id % 49 * 0.25 <= 12 THEN event_id % 49 * 0.25 END AS s FROM events) GROUP BY user_id""")
def w13_first_seen(spark, d):
    h = V.table(spark, d, "events").select(F.col("user_id").alias("video_id"), (F.col("event_id") % 49 * 0.25).cast("double").alias("second"), (F.col("event_type") == "click").alias("visible"))
    return S.first_seen(h)


@query("w14_seen_near", """
WITH h AS (SELECT user_id AS v, event_id % 200 * 0.05 AS s, event_type = 'click' AS visible FROM events),
i AS (SELECT DISTINCT user_id AS v, event_id % 40 * 0.25 AS s FROM events)
SELECT i.v AS video_id, i.s::DOUBLE AS second, bool_or(h.visible) AS visible FROM i LEFT JOIN h ON h.v = i.v AND (h.s = i.s - 0.15 OR h.s = i.s OR h.s = i.s + 0.15) GROUP BY ALL""")
def w14_seen_near(spark, d):
    e = V.table(spark, d, "events")
    h = e.select(F.col("user_id").alias("video_id"), (F.col("event_id") % 200 * 0.05).cast("double").alias("second"), (F.col("event_type") == "click").alias("visible"))
    i = e.select(F.col("user_id").alias("video_id"), (F.col("event_id") % 40 * 0.25).cast("double").alias("second")).distinct()
    return S.seen_near(h, i)


@query("e2_cleaned_tracks", f"""
WITH RECURSIVE {_CLAMPED}, walk AS (
  SELECT video_id, ord, 1::BIGINT AS n, start_ms, end_ms, text FROM clamped WHERE ord = 1
  UNION ALL
  SELECT video_id, ord, CASE WHEN short THEN n ELSE n + 1 END, CASE WHEN short THEN ls ELSE s END, CASE WHEN short THEN greatest(le, e) ELSE e END, CASE WHEN short THEN lt || text ELSE text END
  FROM (SELECT *, e - s < 800 AS short FROM (
    SELECT c.video_id, c.ord, w.n, w.start_ms AS ls, w.end_ms AS le, w.text AS lt, c.text,
      CASE WHEN c.start_ms < w.end_ms THEN w.end_ms + 1 ELSE c.start_ms END AS s, CASE WHEN c.start_ms < w.end_ms THEN greatest(c.end_ms, w.end_ms + 801) ELSE c.end_ms END AS e
    FROM walk w JOIN clamped c ON c.video_id = w.video_id AND c.ord = w.ord + 1))),
one AS (SELECT video_id, n AS ord, arg_max(start_ms, walk.ord) AS start_ms, arg_max(end_ms, walk.ord) AS end_ms, arg_max(text, walk.ord) AS text FROM walk GROUP BY video_id, n),
new AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER (PARTITION BY video_id ORDER BY ord) OR ord = 1 THEN 1 ELSE 0 END AS new FROM one),
run AS (SELECT *, sum(new) OVER (PARTITION BY video_id ORDER BY ord) AS run FROM new),
kept AS (SELECT *, count(*) OVER (PARTITION BY video_id, run) >= 4 AND max(end_ms) OVER (PARTITION BY video_id, run) - min(start_ms) OVER (PARTITION BY video_id, run) >= 4000 AS gone FROM run)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS ord, start_ms, end_ms, text FROM kept WHERE NOT gone""")
def e2_cleaned_tracks(spark, d):
    return Q.cleaned(V.cues(spark, d)).select("video_id", "ord", "start_ms", "end_ms", "text")


@query("u1_suspicious_windows", f"""
WITH {CUES}, g AS (SELECT video_id, ord, "index", start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY ord) AS gap, end_ms - start_ms AS n FROM cues),
u AS (SELECT video_id, 1 AS kind_no, 'gap' AS kind, row_number() OVER (PARTITION BY video_id ORDER BY ord) AS place, 50 AS most, "index", gap AS ms FROM g WHERE gap > 9000
  UNION ALL SELECT video_id, 2, 'long', row_number() OVER (PARTITION BY video_id ORDER BY ord), 20, "index", n FROM g WHERE n > 9000
  UNION ALL SELECT video_id, 3, 'short', row_number() OVER (PARTITION BY video_id ORDER BY ord), 20, "index", n FROM g WHERE n < 250)
SELECT video_id, kind_no, kind, place, "index", ms FROM u WHERE place <= most""")
def u1_suspicious_windows(spark, d):
    return Q.suspicious(V.cues(spark, d))


@query("a14_count_mismatch", f"""
WITH {CUES}, {OTHER} SELECT s.video_id, 'subtitle count mismatch: en=' || coalesce(o.n, 0) || ', source=' || s.n AS message
FROM (SELECT video_id, count(*) AS n FROM cues GROUP BY 1) s LEFT JOIN (SELECT video_id, count(*) AS n FROM other GROUP BY 1) o ON o.video_id = s.video_id WHERE s.n <> coalesce(o.n, 0)""")
def a14_count_mismatch(spark, d):
    t = Q.timing(V.cues(spark, d), V.other(spark, d)).where(~F.col("count_equal"))
    return t.select("video_id", F.concat(F.lit("subtitle count mismatch: en="), F.col("en_count").cast("string"), F.lit(", source="), F.col("source_count").cast("string")).alias("message"))


@query("j6_frame_pairs", """
SELECT a.l_orderkey AS frame_id, a.n AS sample_no, a.l_partkey AS final_id, b.l_suppkey AS original_id
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) a
JOIN (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS n FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.n = b.n
WHERE a.n % 5 <> 0 AND b.n % 3 <> 0""")
def j6_frame_pairs(spark, d):
    """Pairs by the sample's number: a frame that could not be read leaves the others' pairs alone."""
    from pyspark.sql import Window

    from ..operators.pixels import paired

    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")).cast("long")
    f = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame_id"), n.alias("sample_no"), "l_partkey", "l_suppkey")
    final, original = f.where("sample_no % 5 <> 0"), f.where("sample_no % 3 <> 0")
    return paired(final, original, ("frame_id", "sample_no")).select("frame_id", "sample_no", F.col("final_l_partkey").alias("final_id"), F.col("original_l_suppkey").alias("original_id"))


@query("j7_adjustments", r"""
SELECT p_partkey AS ord, CASE WHEN p_partkey % 3 = 0 AND d <> 0 THEN '\pos(360,' || greatest(640, least(1100, 700 + d)) || ')' ELSE '\pos(360,700)' END AS line FROM (SELECT p_partkey, p_partkey % 7 * 20 - 60 AS d FROM part)""")
def j7_adjustments(spark, d):
    from ..operators.fit import moved

    p = V.table(spark, d, "part")
    events = p.select(F.lit("v").alias("video_id"), F.col("p_partkey").alias("ord"), F.lit(1280).alias("frame_height"), F.lit(r"\pos(360,700)").alias("line"))
    moves = p.where("p_partkey % 3 = 0").select(F.lit("v").alias("video_id"), F.col("p_partkey").alias("index"), (F.col("p_partkey") % 7 * 20 - 60).alias("delta"))
    return moved(events, moves).select("ord", "line")


@query("t7_fallback_choice", f"""
WITH {CUES}, q AS (SELECT video_id, 5 * count(*) FILTER (WHERE gap > 9000) + 4 * count(*) FILTER (WHERE n > 9000) + count(*) FILTER (WHERE n < 250) AS score FROM (SELECT video_id, start_ms - lag(end_ms) OVER (PARTITION BY video_id ORDER BY ord) AS gap, end_ms - start_ms AS n FROM cues) GROUP BY 1),
f AS (SELECT video_id, 5 * count(*) FILTER (WHERE gap > 9000) + 4 * count(*) FILTER (WHERE n > 9000) + count(*) FILTER (WHERE n < 250) AS score FROM (SELECT video_id, start_ms - lag(e) OVER (PARTITION BY video_id ORDER BY ord) AS gap, e - start_ms AS n FROM (SELECT *, end_ms - video_id % 5 * 2000 + 4000 AS e FROM cues)) GROUP BY 1)
SELECT q.video_id, CASE WHEN f.score < q.score THEN 'fallback' ELSE 'engine' END AS chosen FROM q JOIN f ON f.video_id = q.video_id""")
def t7_fallback_choice(spark, d):
    from ..operators.runs import better_of

    c = V.cues(spark, d)
    score = lambda x, name: Q.quality(x).select("video_id", Q.quality_score().alias(name))
    both = score(c, "a").join(score(c.withColumn("end_ms", F.col("end_ms") - F.col("video_id") % 5 * 2000 + 4000), "b"), "video_id")
    return both.select("video_id", better_of(F.lit("engine"), F.lit("fallback"), F.col("a"), F.col("b")).alias("chosen"))
