"""The waveform queries, each an operator over a signal view, and the same in DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.functions import bits, sums, verdicts
from wavespark.operators import analog, edges, joins, sequence, stats, timing, views
from wavespark.sources.tables import embedding_trace, event_edges, event_trace, micros, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Edges of lines (by user, by type) and their levels, for the SQL side.
_EDGES = """
WITH e AS (SELECT channel, tick FROM (SELECT CAST({key} AS VARCHAR) AS channel, epoch_us(ts) AS tick FROM events)
           WHERE tick IS NOT NULL GROUP BY channel, tick HAVING count(*) % 2 = 1),
     n0 AS (SELECT channel, tick, row_number() OVER (PARTITION BY channel ORDER BY tick) AS seq FROM e),
     l AS (SELECT channel, tick, seq, CASE WHEN seq % 2 = 1 THEN 1::BIGINT ELSE 0::BIGINT END AS level FROM n0),
     b AS (SELECT min(epoch_us(ts)) - 1 AS a, max(epoch_us(ts)) + 1 AS z FROM events)
"""
_USERS, _TYPES = _EDGES.format(key="user_id"), _EDGES.format(key="event_type")


def query(sql: str | None = None, prefix: str = ""):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            recursive = sql.strip().startswith("WITH RECURSIVE ")
            body = sql.strip().removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
            head = prefix.replace("WITH ", "WITH RECURSIVE ", 1) if recursive else prefix
            SQL[f.__name__] = f"{head}, {body}" if prefix and sql.strip().startswith("WITH ") else head + sql
        return f

    return add


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_edges(spark, sf_dir, "user_id")


def types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_edges(spark, sf_dir, "event_type")


def bounds(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """The capture's span: one row."""
    r = table(spark, sf_dir, "events").agg((F.min(micros("ts")) - 1).alias("a"), (F.max(micros("ts")) + 1).alias("z")).first()
    return (r["a"] or 0), (r["z"] or 1)


# --- lines -----------------------------------------------------------------------------------


@query("SELECT channel, tick, seq, level FROM l", _USERS)
def edge_levels(spark, d):
    return edges.edge_levels(users(spark, d))


@query(
    """WITH n AS (SELECT channel, tick, level, seq, coalesce(lead(tick) OVER (PARTITION BY channel ORDER BY tick), (SELECT z FROM b)) AS nx FROM l)
SELECT channel, tick AS start, nx - tick AS length, level FROM n
UNION ALL SELECT channel, (SELECT a FROM b), tick - (SELECT a FROM b), 0 FROM n WHERE seq = 1""",
    _USERS,
)
def runs(spark, d):
    return edges.runs(users(spark, d), *bounds(spark, d))


@query(
    """WITH n AS (SELECT *, lead(tick) OVER (PARTITION BY channel ORDER BY tick) - tick AS width FROM l)
SELECT channel, tick AS start, width FROM n WHERE level = 1 AND width IS NOT NULL""",
    _USERS,
)
def pulses(spark, d):
    return edges.pulses(users(spark, d), 1)


@query(
    """WITH n AS (SELECT *, lead(tick) OVER w AS fall, lead(tick, 2) OVER w AS again FROM l WINDOW w AS (PARTITION BY channel ORDER BY tick))
SELECT channel, tick AS rise, fall - tick AS high, again - tick AS period FROM n WHERE level = 1 AND again IS NOT NULL""",
    _USERS,
)
def pulse_rows(spark, d):
    return edges.pulse_rows(users(spark, d))


@query(
    """WITH s AS (SELECT a + (z - a) // 4 AS p, a + (z - a) // 2 AS q FROM b),
i AS (SELECT channel, count(*) % 2 AS initial FROM l WHERE tick <= (SELECT p FROM s) GROUP BY channel)
SELECT l.channel, tick - (SELECT p FROM s) AS tick, coalesce(initial, 0) AS initial FROM l LEFT JOIN i USING (channel)
WHERE tick > (SELECT p FROM s) AND tick < (SELECT q FROM s)""",
    _USERS,
)
def window(spark, d):
    a, z = bounds(spark, d)
    return edges.window(users(spark, d), a + (z - a) // 4, a + (z - a) // 2)


@query("SELECT channel, tick FROM l WHERE level = 1 AND channel IN ('click', 'view')", _TYPES)
def rising_only(spark, d):
    return edges.directions(edges.only(types(spark, d), ["click", "view"]), "rise")


@query(
    """WITH o AS (SELECT channel, tick FROM (SELECT channel, tick FROM l UNION ALL SELECT channel, tick FROM l WHERE seq % 3 = 0)
GROUP BY channel, tick HAVING count(*) % 2 = 1) SELECT channel, tick FROM o""",
    _USERS,
)
def edge_xor(spark, d):
    e = users(spark, d)
    return edges.xor(e, edges.edge_levels(e).where("seq % 3 = 0"))


@query(
    """WITH s AS (SELECT channel, seq AS k, CASE WHEN level = 1 THEN 1 ELSE 0 END AS bit FROM (SELECT event_type AS channel,
   row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS seq, CASE WHEN value >= 50 THEN 1 ELSE 0 END AS level FROM events)),
p AS (SELECT *, lag(bit) OVER w AS before, first_value(bit) OVER w AS initial FROM s WINDOW w AS (PARTITION BY channel ORDER BY k))
SELECT channel, k * 4 + 1 AS tick, initial::BIGINT AS initial FROM p WHERE before <> bit""",
)
def change_points(spark, d):
    t = event_trace(spark, d).select("channel", "k", F.when(F.col("value") >= 50, 1).otherwise(0).alias("bit"))
    return edges.change_points(t, 4, 1).withColumn("initial", F.col("initial").cast("long"))


@query(
    """WITH o AS (SELECT tick, max(CASE WHEN channel = 'click' THEN level END) AS c, max(CASE WHEN channel = 'view' THEN level END) AS v
FROM l WHERE channel IN ('click', 'view') GROUP BY tick)
SELECT tick, coalesce(last_value(c IGNORE NULLS) OVER w, 0)::BIGINT AS click, coalesce(last_value(v IGNORE NULLS) OVER w, 0)::BIGINT AS "view"
FROM o WINDOW w AS (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    _TYPES,
)
def joint_states(spark, d):
    return edges.states(types(spark, d), ["click", "view"])


# --- joins in time ---------------------------------------------------------------------------


@query(
    """WITH p AS (SELECT tick FROM l WHERE channel = 'click'), r AS (SELECT tick, level FROM l WHERE channel = 'view')
SELECT p.tick, coalesce(r.level, 0)::BIGINT AS level FROM p ASOF LEFT JOIN r ON p.tick >= r.tick""",
    _TYPES,
)
def level_at(spark, d):
    e = types(spark, d)
    return joins.level_at(timing.line(e, "click"), timing.line(e, "view"), ["pair"]).select("tick", "level")


@query(
    """WITH p AS (SELECT tick FROM l WHERE channel = 'click'), r AS (SELECT tick FROM l WHERE channel = 'view'),
x AS (SELECT p.tick, r.tick AS back FROM p ASOF LEFT JOIN r ON p.tick >= r.tick),
y AS (SELECT p.tick, r.tick AS ahead FROM p ASOF LEFT JOIN r ON p.tick <= r.tick)
SELECT x.tick, least(x.tick - back, ahead - x.tick) AS distance FROM x JOIN y USING (tick)""",
    _TYPES,
)
def asof_nearest(spark, d):
    e = types(spark, d)
    return joins.nearest_distance(timing.line(e, "click"), timing.line(e, "view"), ["pair"]).select("tick", "distance")


@query(
    """WITH p AS (SELECT tick FROM l WHERE channel = 'click' AND level = 1), r AS (SELECT tick FROM l WHERE channel = 'view' AND level = 1),
m AS (SELECT quantile_cont(g, 0.5) AS period FROM (SELECT lead(tick) OVER (ORDER BY tick) - tick AS g FROM p)),
y AS (SELECT p.tick, (SELECT min(r.tick) FROM r WHERE r.tick >= p.tick) AS ahead FROM p)
SELECT tick, ahead - tick AS lag, (SELECT period FROM m) AS period FROM y WHERE ahead - tick < (SELECT period FROM m)""",
    _TYPES,
)
def forward_asof_phase(spark, d):
    return timing.phase(types(spark, d), "click", "view")


_NEAR = """WITH p AS (SELECT tick FROM l WHERE channel = 'click' {rise}), r AS (SELECT tick FROM l WHERE channel = 'view' {rise}),
nx AS (SELECT tick AS a, (SELECT max(r.tick) FROM r WHERE r.tick <= p.tick) AS back, (SELECT min(r.tick) FROM r WHERE r.tick >= p.tick) AS ahead FROM p),
ny AS (SELECT tick AS b, (SELECT max(p.tick) FROM p WHERE p.tick <= r.tick) AS back, (SELECT min(p.tick) FROM p WHERE p.tick >= r.tick) AS ahead FROM r),
ma AS (SELECT a, CASE WHEN ahead IS NULL OR a - back <= ahead - a THEN back ELSE ahead END AS b FROM nx),
mb AS (SELECT b, CASE WHEN ahead IS NULL OR b - back <= ahead - b THEN back ELSE ahead END AS a FROM ny),
mm AS (SELECT a, b FROM ma JOIN mb USING (a, b))"""


@query(
    _NEAR.format(rise="AND level = 1")
    + """, s AS (SELECT min(g) AS least FROM (SELECT lead(tick) OVER (ORDER BY tick) - tick AS g FROM p
UNION ALL SELECT lead(tick) OVER (ORDER BY tick) - tick FROM r))
SELECT a, b, b - a AS skew FROM mm WHERE abs(b - a) * 2 < (SELECT least FROM s)""",
    _TYPES,
)
def mutual_skew(spark, d):
    return timing.skew(types(spark, d), "click", "view")


@query(
    _NEAR.format(rise="")
    + """ SELECT (SELECT count(*) FROM p) AS edges_a, (SELECT count(*) FROM r) AS edges_b,
(SELECT count(*) FROM mm WHERE abs(a - b) <= 5000000) AS together""",
    _TYPES,
)
def same_changes(spark, d):
    return timing.same_changes(types(spark, d), "click", "view", 5_000_000)


_WINDOWS = """WITH w AS (SELECT tick AS start, nx AS "end" FROM (SELECT tick, level, lead(tick) OVER (ORDER BY tick) AS nx FROM l WHERE channel = 'view')
WHERE level = 1 AND nx IS NOT NULL), p AS (SELECT tick FROM l WHERE channel = 'click')"""


def _spans(e: DataFrame) -> DataFrame:
    rows = edges.pulses(edges.only(e, ["view"]), 1)
    return rows.select(F.lit(1).alias("pair"), "start", (F.col("start") + F.col("width")).alias("end"))


@query(
    _WINDOWS + """ SELECT p.tick, coalesce(CASE WHEN p.tick < w."end" THEN w.start END, -1) AS start FROM p ASOF LEFT JOIN w ON p.tick >= w.start""", _TYPES
)
def in_windows(spark, d):
    e = types(spark, d)
    return joins.in_windows(timing.line(e, "click"), _spans(e), ["pair"]).select("tick", F.coalesce("start", F.lit(-1)).alias("start"))


@query(
    _WINDOWS
    + """ SELECT tick FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE p.tick >= w.start - 1000000 AND p.tick < w."end" + 1000000)""",
    _TYPES,
)
def uncovered(spark, d):
    e = types(spark, d)
    return joins.uncovered(timing.line(e, "click"), _spans(e), ["pair"], 1_000_000).select("tick")


@query(
    _WINDOWS
    + """, q AS (SELECT w.start, count(p.tick) AS items FROM w LEFT JOIN p ON p.tick >= w.start AND p.tick < w."end" GROUP BY w.start)
SELECT count(*) AS selections, count(*) FILTER (items = 0) AS empty FROM q""",
    _TYPES,
)
def empty_selections(spark, d):
    e = types(spark, d)
    spans = _spans(e)
    hit = joins.in_windows(timing.line(e, "click"), spans, ["pair"]).where("start IS NOT NULL").select("start").distinct().withColumn("hit", F.lit(1))
    return spans.join(hit, "start", "left").agg(F.count(F.lit(1)).alias("selections"), F.count_if(F.expr("hit IS NULL")).alias("empty"))


@query(
    """WITH u AS (SELECT channel, tick, CASE WHEN tick - lag(tick) OVER (PARTITION BY channel ORDER BY tick) > 3600000000 THEN 1 ELSE 0 END AS f FROM l),
g AS (SELECT *, sum(f) OVER (PARTITION BY channel ORDER BY tick) AS burst FROM u)
SELECT channel, burst::BIGINT AS burst, min(tick) AS start, max(tick) AS "end", count(*) AS edges FROM g GROUP BY channel, burst""",
    _USERS,
)
def fixed_gap_bursts(spark, d):
    return sequence.gap_bursts(users(spark, d), 3_600_000_000)


@query(
    """WITH u AS (SELECT channel, tick, CASE WHEN tick - lag(tick) OVER (PARTITION BY channel ORDER BY tick) > 3600000000 THEN 1 ELSE 0 END AS f FROM l),
g AS (SELECT *, sum(f) OVER (PARTITION BY channel ORDER BY tick) AS burst FROM u),
k AS (SELECT channel, min(tick) AS start, max(tick) + 1 AS "end" FROM g GROUP BY channel, burst),
v AS (SELECT tick FROM l)
SELECT k.channel, start, "end" FROM k WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE e2.tick >= k.start AND e2.tick < k."end")""",
    _USERS + """, e2 AS (SELECT epoch_us(ts) AS tick FROM events WHERE event_type = 'purchase')""",
)
def unread_bursts(spark, d):
    bursts = sequence.gap_bursts(users(spark, d), 3_600_000_000).select(F.lit(1).alias("pair"), "channel", "start", (F.col("end") + 1).alias("end"))
    items = table(spark, d, "events").where("event_type = 'purchase'").select(F.lit(1).alias("pair"), micros("ts").alias("tick"))
    points = bursts.withColumnRenamed("start", "tick")
    first = joins.asof_forward(points, items, ["pair"])
    return first.where("ref IS NULL OR ref >= end").select("channel", F.col("tick").alias("start"), "end")


@query(
    """WITH g AS (SELECT tick AS start, tick + 2000000 AS "end", max(tick + 2000000) OVER (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
FROM (SELECT DISTINCT tick FROM l)) SELECT reach AS start, start AS "end" FROM g WHERE start > reach""",
    _USERS,
)
def quiet_stretches(spark, d):
    return sequence.quiet(users(spark, d), 2_000_000)


@query(
    """WITH t AS (SELECT tick, count(*) AS n FROM l GROUP BY tick),
k AS (SELECT *, CASE WHEN coalesce(tick - lag(tick) OVER (ORDER BY tick) > 60000000, true) THEN 1 ELSE 0 END AS f FROM t),
g AS (SELECT *, sum(f) OVER (ORDER BY tick) AS block FROM k),
c AS (SELECT block, min(tick) AS a, max(tick) AS z, sum(n) AS n FROM g GROUP BY block),
p AS (SELECT *, floor(coalesce(sum(n) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / 1000)::BIGINT AS piece FROM c)
SELECT piece, min(a) AS start, max(z) AS "end", sum(n)::BIGINT AS edges FROM p GROUP BY piece""",
    _USERS,
)
def piece_plan(spark, d):
    return sequence.piece_plan(users(spark, d), 60_000_000, 1000)


@query("SELECT tick FROM l WHERE channel = 'click' AND tick IN (SELECT epoch_us(ts) FROM events WHERE value > 50)", _TYPES)
def semi_join_ticks(spark, d):
    ticks = table(spark, d, "events").where("value > 50").select(micros("ts").alias("tick"))
    return edges.only(types(spark, d), ["click"]).join(ticks, "tick", "left_semi").select("tick")


@query("SELECT DISTINCT tick FROM l", _TYPES)
def distinct_ticks(spark, d):
    return types(spark, d).select("tick").distinct()


@query(
    """WITH w AS (SELECT channel, tick AS start, lead(tick) OVER (PARTITION BY channel ORDER BY tick) AS z, level FROM l WHERE channel IN ('click', 'view')),
c AS (SELECT start, z FROM w WHERE channel = 'click' AND level = 1 AND z IS NOT NULL), v AS (SELECT start, z FROM w WHERE channel = 'view' AND level = 1 AND z IS NOT NULL)
SELECT (SELECT sum(least(c.z, v.z) - greatest(c.start, v.start)) FROM c JOIN v ON c.start < v.z AND v.start < c.z)::BIGINT AS overlap,
(SELECT sum(z - start) FROM c)::BIGINT AS total""",
    _TYPES,
)
def message_overlap(spark, d):
    def spans(c):
        rows = edges.pulses(edges.only(types(spark, d), [c]), 1)
        return rows.select(F.lit(1).alias("pair"), "start", (F.col("start") + F.col("width")).alias("end"))

    return joins.overlap_share(spans("click"), spans("view"), ["pair"]).select("overlap", "total")


# --- views -----------------------------------------------------------------------------------

_ISLANDS = """WITH k AS (SELECT channel, tick, CASE WHEN coalesce(tick - lag(tick) OVER (PARTITION BY channel ORDER BY tick) >= {gap}, true) THEN 1 ELSE 0 END AS f FROM e),
g AS (SELECT channel, tick, sum(f) OVER (PARTITION BY channel ORDER BY tick) AS island FROM k)"""
_GAP = 1_800_000_000


@query(_ISLANDS.format(gap=_GAP) + " SELECT channel, min(tick) AS tick FROM g GROUP BY channel, island HAVING count(*) % 2 = 1", _USERS)
def debounce(spark, d):
    return views.debounce(users(spark, d), _GAP)


@query(_ISLANDS.format(gap=_GAP) + " SELECT channel, max(tick) AS tick FROM g GROUP BY channel, island HAVING count(*) % 2 = 1", _USERS)
def gated(spark, d):
    return views.gated(users(spark, d), _GAP)


@query(
    """WITH RECURSIVE s AS (SELECT channel, seq, [tick] AS stack FROM l WHERE seq = 1
UNION ALL SELECT l.channel, l.seq, CASE WHEN len(s.stack) > 0 AND l.tick - s.stack[-1] < 1800000000 THEN s.stack[:len(s.stack) - 1] ELSE list_append(s.stack, l.tick) END
FROM s JOIN l ON l.channel = s.channel AND l.seq = s.seq + 1),
z AS (SELECT channel, arg_max(stack, seq) AS stack FROM s GROUP BY channel) SELECT channel, unnest(stack) AS tick FROM z""",
    _USERS,
)
def deglitch(spark, d):
    return views.deglitch(users(spark, d), _GAP)


@query()
def shortest_first(spark, d):
    e = users(spark, d).select("channel", F.expr("tick div 600000000").alias("tick"))
    return views.shortest_first(edges.toggles(e), 4)


@query()
def clock_refused(spark, d):
    return views.clock_refused(users(spark, d))


@query()
def clock_followed(spark, d):
    return views.clock_followed(users(spark, d))


@query()
def clock_gridded(spark, d):
    return views.clock_gridded(users(spark, d))


_SHORT = """WITH r AS (SELECT channel, tick, lead(tick) OVER (PARTITION BY channel ORDER BY tick) - tick AS length FROM e),
n AS (SELECT *, lag(length) OVER w AS before, lead(length) OVER w AS after FROM r WHERE length IS NOT NULL WINDOW w AS (PARTITION BY channel ORDER BY tick))"""


@query(
    _SHORT
    + """ SELECT channel, count(*) FILTER (length < 1800000000) AS short_runs,
count(*) FILTER (length < 1800000000 AND (coalesce(before < 1800000000, false) OR coalesce(after < 1800000000, false))) AS paired FROM n GROUP BY channel""",
    _USERS,
)
def bounces_paired(spark, d):
    return views.bounces_paired(users(spark, d), _GAP)


@query(
    _SHORT
    + """ SELECT channel, tick, (sum(CASE WHEN length < 1800000000 AND greatest(coalesce(before, 0), coalesce(after, 0)) >= 3600000000 THEN 1 ELSE 0 END)
OVER (PARTITION BY channel ORDER BY tick))::BIGINT AS noise FROM n""",
    _USERS,
)
def noise_runs(spark, d):
    return views.noise_runs(users(spark, d), _GAP)


@query(
    _SHORT
    + """, p AS (SELECT *, length + before AS period FROM n),
m AS (SELECT *, quantile_cont(period, 0.5) OVER (PARTITION BY channel ORDER BY tick ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS median FROM p)
SELECT channel, tick, (sum(CASE WHEN coalesce(length < 1800000000 AND abs(period - median) > 0.25 * median, false) THEN 1 ELSE 0 END)
OVER (PARTITION BY channel ORDER BY tick))::BIGINT AS broken FROM m""",
    _USERS,
)
def broken_runs(spark, d):
    return views.broken_runs(users(spark, d), _GAP)


# --- statistics ------------------------------------------------------------------------------

_RUNS = """WITH r AS (SELECT channel, tick, level, lead(tick) OVER (PARTITION BY channel ORDER BY tick) - tick AS length FROM l),
i AS (SELECT * FROM r WHERE length IS NOT NULL)"""


def whole_runs(spark, d) -> DataFrame:
    return edges.intervals(users(spark, d))


@query(_RUNS + " SELECT channel, level, quantile_cont(length, 0.5) AS median FROM i GROUP BY channel, level", _USERS)
def segment_medians(spark, d):
    return stats.segment_medians(whole_runs(spark, d), ["channel", "level"], "length")


@query(
    _RUNS
    + " SELECT channel, tick, quantile_cont(length, 0.5) OVER (PARTITION BY channel ORDER BY tick ROWS BETWEEN 16 PRECEDING AND 16 FOLLOWING) AS median FROM i",
    _USERS,
)
def rolling_median(spark, d):
    return stats.rolling_quantile(whole_runs(spark, d), "length", 0.5, -16, 16, "median").select("channel", "tick", "median")


@query(
    _RUNS
    + " SELECT channel, tick, quantile_cont(length, 0.75) OVER (PARTITION BY channel ORDER BY tick ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS quartile FROM i",
    _USERS,
)
def upper_quartiles(spark, d):
    return stats.rolling_quantile(whole_runs(spark, d), "length", 0.75, -4, 4, "quartile").select("channel", "tick", "quartile")


@query(
    _RUNS
    + """ SELECT channel, tick, least(quantile_cont(length, 0.25) OVER (PARTITION BY channel ORDER BY tick ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING),
quantile_cont(length, 0.25) OVER (PARTITION BY channel ORDER BY tick ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)) AS period FROM i""",
    _USERS,
)
def local_period(spark, d):
    return stats.local_period(whole_runs(spark, d)).select("channel", "tick", "period")


@query(_RUNS + " SELECT channel, level, (length(bin(length)) - 1)::BIGINT AS size, count(*) AS n FROM i GROUP BY 1, 2, 3", _USERS)
def run_histogram(spark, d):
    return stats.run_histogram(users(spark, d))


_ALL = """WITH n AS (SELECT channel, tick, level, seq, coalesce(lead(tick) OVER (PARTITION BY channel ORDER BY tick), (SELECT z FROM b)) AS nx FROM l),
r AS (SELECT channel, tick AS start, nx - tick AS length, level FROM n UNION ALL SELECT channel, (SELECT a FROM b), tick - (SELECT a FROM b), 0 FROM n WHERE seq = 1)"""


@query(
    _ALL
    + """, f AS (SELECT *, lag(length) OVER (PARTITION BY channel ORDER BY start) AS before FROM r)
SELECT channel, count(*) - 1 AS edges, sum(CASE WHEN level = 1 THEN length ELSE 0 END)::BIGINT AS high_ticks, min(length) AS shortest, max(length) AS longest,
quantile_cont(length, 0.5) AS median_run, count(*) FILTER (abs(length - before) * 10 <= greatest(length, before)) AS alike FROM f GROUP BY channel""",
    _USERS,
)
def line_features(spark, d):
    return stats.line_features(users(spark, d), *bounds(spark, d))


@query(
    _ALL
    + """, k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY length DESC, start) AS rank FROM r) SELECT channel, start, length, level, rank FROM k WHERE rank <= 10""",
    _USERS,
)
def longest_stills(spark, d):
    return stats.longest_stills(users(spark, d), *bounds(spark, d))


@query(
    """WITH t AS (SELECT DISTINCT tick FROM l), k AS (SELECT tick AS start, coalesce(lead(tick) OVER (ORDER BY tick), (SELECT z FROM b)) - tick AS length FROM t
UNION ALL SELECT (SELECT a FROM b), min(tick) - (SELECT a FROM b) FROM t) SELECT start, length FROM k ORDER BY length DESC, start LIMIT 10""",
    _USERS,
)
def all_still_top(spark, d):
    return stats.all_still(users(spark, d), *bounds(spark, d))


@query("SELECT channel, ((tick - (SELECT a FROM b)) * 1000 // ((SELECT z FROM b) - (SELECT a FROM b)))::BIGINT AS bin, count(*) AS n FROM l GROUP BY 1, 2", _USERS)
def activity_bins(spark, d):
    return stats.activity(users(spark, d), *bounds(spark, d), 1000)


@query(
    _RUNS
    + """, m AS (SELECT channel, quantile_cont(length, 0.5) AS median FROM i GROUP BY channel)
SELECT channel, count(*) AS runs, count(*) FILTER (length * 4 < median) AS short FROM i JOIN m USING (channel) GROUP BY channel""",
    _USERS,
)
def short_share(spark, d):
    return stats.short_share(users(spark, d))


@query(
    """WITH p AS (SELECT channel, level, lead(tick, 2) OVER (PARTITION BY channel ORDER BY tick) - tick AS period FROM l),
q AS (SELECT channel, period FROM p WHERE level = 1 AND period IS NOT NULL), m AS (SELECT channel, quantile_cont(period, 0.5) AS median FROM q GROUP BY channel),
s AS (SELECT channel, count(*) AS periods, max(median) AS median_period, count(*) FILTER (abs(period - median) <= 0.05 * median) AS alike FROM q JOIN m USING (channel) GROUP BY channel)
SELECT *, alike >= 0.9 * periods AS running FROM s""",
    _USERS,
)
def free_running(spark, d):
    return stats.free_running(users(spark, d))


@query(
    _RUNS
    + """, c AS (SELECT channel, length // 60000000 AS length, count(*) AS n FROM i GROUP BY 1, 2),
k AS (SELECT *, row_number() OVER (PARTITION BY channel ORDER BY n DESC, length) AS r FROM c),
u AS (SELECT DISTINCT channel, length / dv AS unit FROM k, (SELECT unnest([1, 2, 3, 4, 5, 8]) AS dv) WHERE r <= 12 AND length / dv >= 1),
f AS (SELECT c.channel, unit, n, c.length / unit AS ratio, greatest(1.0, round_even(c.length / unit, 0)) AS mult FROM c JOIN u USING (channel))
SELECT channel, unit, (sum(CASE WHEN abs(ratio - mult) <= 0.2 AND mult <= 12 THEN n ELSE 0 END)::DOUBLE / sum(n)::DOUBLE) AS fit FROM f GROUP BY channel, unit""",
    _USERS,
)
def unit_candidates(spark, d):
    rows = whole_runs(spark, d).select("channel", F.expr("length div 60000000").alias("length"))
    return stats.unit_fits(rows.groupBy("channel", "length").agg(F.count(F.lit(1)).alias("n")))


@query(
    """WITH o AS (SELECT channel, max(tick) AS last FROM l GROUP BY channel),
g AS (SELECT channel, count(*) FILTER (gp <= 2000000) AS close_edges FROM (SELECT channel, tick - lag(tick) OVER (PARTITION BY channel ORDER BY tick) AS gp FROM l) GROUP BY channel)
SELECT o.channel, last, (SELECT count(*) FROM l WHERE tick > o.last)::BIGINT AS later, close_edges,
(SELECT count(*) FROM l WHERE tick > o.last) >= 16 AS stopped, close_edges >= 1000 AS oscillating FROM o JOIN g USING (channel)""",
    _USERS,
)
def line_faults(spark, d):
    return stats.line_faults(users(spark, d), 0, 16, 2_000_000, 1000)


# --- sequences -------------------------------------------------------------------------------


@query(
    """WITH g AS (SELECT channel, tick, tick - lag(tick) OVER (PARTITION BY channel ORDER BY tick) AS gap FROM l),
n AS (SELECT *, lag(gap) OVER w AS before, lead(gap) OVER w AS after FROM g WINDOW w AS (PARTITION BY channel ORDER BY tick)),
f AS (SELECT *, CASE WHEN coalesce(gap > 3 * coalesce(before, after) AND gap > 3 * coalesce(after, before), false) THEN 1 ELSE 0 END AS f FROM n)
SELECT channel, tick, (sum(f) OVER (PARTITION BY channel ORDER BY tick))::BIGINT AS burst FROM f""",
    _USERS,
)
def burst_split(spark, d):
    return sequence.burst_split(users(spark, d))


@query(
    """WITH RECURSIVE s AS (SELECT channel, tick AS start, tick + 7200000000 AS free FROM l WHERE seq = 1
UNION ALL SELECT s.channel, (SELECT min(l.tick) FROM l WHERE l.channel = s.channel AND l.tick >= s.free), (SELECT min(l.tick) FROM l WHERE l.channel = s.channel AND l.tick >= s.free) + 7200000000
FROM s WHERE s.start IS NOT NULL) SELECT channel, start, start + 7200000000 AS busy_until FROM s WHERE start IS NOT NULL""",
    _USERS,
)
def greedy_chain(spark, d):
    return sequence.chain(users(spark, d).select("channel", F.col("tick").alias("start"), (F.col("tick") + 7_200_000_000).alias("busy_until")))


@query()
def line_states(spark, d):
    return sequence.line_states(users(spark, d), *bounds(spark, d))


@query(
    _RUNS
    + """, c AS (SELECT channel, tick, length, CASE WHEN coalesce(length >= 1.5 * lag(length) OVER w OR lag(length) OVER w >= 1.5 * length, false) THEN 1 ELSE 0 END AS f
FROM i WINDOW w AS (PARTITION BY channel ORDER BY tick)) SELECT channel, tick, length AS period, (sum(f) OVER (PARTITION BY channel ORDER BY tick))::BIGINT AS segment FROM c""",
    _USERS,
)
def rate_segments(spark, d):
    return sequence.rate_segments(whole_runs(spark, d).select("channel", "tick", F.col("length").alias("period")))


# --- analog ----------------------------------------------------------------------------------

_EMB = "WITH t AS (SELECT CAST(vec_id AS VARCHAR) AS channel, k - 1 AS k, embedding[k]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS k FROM embeddings))"
_VAL = "WITH t AS (SELECT event_type AS channel, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS k, value FROM events)"
_SCH = """, s AS (SELECT *, CASE WHEN isnan(value) THEN NULL WHEN value >= {hi} THEN 1 WHEN value <= {lo} THEN 0 END AS sure FROM t),
h AS (SELECT channel, k, value, coalesce(last_value(sure IGNORE NULLS) OVER (PARTITION BY channel ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
 first_value(sure IGNORE NULLS) OVER (PARTITION BY channel ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))::BIGINT AS level FROM s)"""


@query(_VAL + _SCH.format(lo=20, hi=80) + " SELECT channel, k, value, level FROM h")
def schmitt_levels(spark, d):
    return analog.schmitt(event_trace(spark, d), 20, 80)


@query(_EMB + _SCH.format(lo=-0.05, hi=0.05) + """, p AS (SELECT *, lag(level) OVER (PARTITION BY channel ORDER BY k) AS before FROM h)
SELECT channel, k * 3 AS tick FROM p WHERE before <> level""")
def analog_to_logic(spark, d):
    return analog.to_logic(embedding_trace(spark, d), -0.05, 0.05, 3)


@query(_EMB + """, p AS (SELECT *, lag(value) OVER (PARTITION BY channel ORDER BY k) AS before FROM t)
SELECT channel, k, round(k - 1 + greatest(0.0, least(1.0, (0.0 - before) / (value - before))), 9) AS at, value >= 0 AS rising FROM p
WHERE (before < 0 AND value >= 0) OR (before >= 0 AND value < 0)""")
def crossings(spark, d):
    return analog.crossings(embedding_trace(spark, d), 0.0).withColumn("at", F.round("at", 9))


@query(_EMB + """ SELECT channel, count(*) FILTER (value > -0.2 AND value < 0.2) AS n, round(min(value) FILTER (value > -0.2 AND value < 0.2), 9) AS least,
round(max(value) FILTER (value > -0.2 AND value < 0.2), 9) AS greatest, round(max(value) FILTER (value > -0.2 AND value < 0.2) - min(value) FILTER (value > -0.2 AND value < 0.2), 9) AS p2p,
round(avg(value) FILTER (value > -0.2 AND value < 0.2), 7) AS mean, round(stddev_pop(value) FILTER (value > -0.2 AND value < 0.2), 7) AS std,
count(*) FILTER (value <= -0.2 OR value >= 0.2) AS clipped FROM t GROUP BY channel""")
def analog_levels(spark, d):
    rows = analog.levels(embedding_trace(spark, d), -0.2, 0.2)
    rows = rows.withColumns({c: F.round(c, 9) for c in ("least", "greatest", "p2p")})
    return rows.withColumns({c: F.round(c, 7) for c in ("mean", "std")})


# --- two lines -------------------------------------------------------------------------------

_JOINT = """WITH o AS (SELECT tick, max(CASE WHEN channel = 'click' THEN level END) AS c, max(CASE WHEN channel = 'view' THEN level END) AS v
FROM l WHERE channel IN ('click', 'view') GROUP BY tick),
j AS (SELECT tick, coalesce(last_value(c IGNORE NULLS) OVER w, 0) AS c, coalesce(last_value(v IGNORE NULLS) OVER w, 0) AS v
FROM o WINDOW w AS (ORDER BY tick ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    _JOINT
    + """, q AS (SELECT lag(c * 2 + v) OVER (ORDER BY tick) AS pv, c * 2 + v AS st FROM j)
SELECT count(*) FILTER (pv * 4 + st IN (2, 11, 13, 4)) AS forward, count(*) FILTER (pv * 4 + st IN (1, 7, 14, 8)) AS backward,
count(*) FILTER (pv * 4 + st IN (3, 6, 9, 12)) AS errors FROM q WHERE pv <> st""",
    _TYPES,
)
def quadrature_steps(spark, d):
    return timing.quadrature(types(spark, d), "click", "view")


@query(
    _JOINT
    + """, q AS (SELECT tick AS start, lead(tick) OVER (ORDER BY tick) - tick AS length, c + v AS lit FROM j)
SELECT start, length, CASE lit WHEN 0 THEN 'dead' ELSE 'overlap' END AS kind FROM q WHERE lit IN (0, 2) AND length IS NOT NULL""",
    _TYPES,
)
def dead_time(spark, d):
    return timing.dead_times(types(spark, d), "click", "view")


@query(
    """WITH p AS (SELECT tick FROM l WHERE channel = 'click' AND level = 1), r AS (SELECT tick FROM l WHERE channel = 'view')
SELECT p.tick, coalesce(p.tick - x.tick, -1) AS setup, coalesce(y.tick - p.tick, -1) AS hold FROM p ASOF LEFT JOIN r x ON p.tick > x.tick ASOF LEFT JOIN r y ON p.tick <= y.tick""",
    _TYPES,
)
def sampling_margins(spark, d):
    rows = timing.margins(types(spark, d), "click", "view")
    return rows.select("tick", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("setup", "hold")))


@query(
    """WITH p AS (SELECT tick FROM l WHERE channel = 'click'), r AS (SELECT tick FROM l WHERE channel = 'view'),
x AS (SELECT p.tick, x.tick AS back, y.tick AS ahead FROM p ASOF JOIN r x ON p.tick >= x.tick ASOF JOIN r y ON p.tick < y.tick),
f AS (SELECT 6.283185307179586 * (tick - back) / (ahead - back) AS a FROM x)
SELECT count(*) AS n, round(sqrt(avg(cos(a)) ** 2 + avg(sin(a)) ** 2), 6) AS first, round(sqrt(avg(cos(2 * a)) ** 2 + avg(sin(2 * a)) ** 2), 6) AS second FROM f""",
    _TYPES,
)
def phase_concentration(spark, d):
    rows = timing.phase_concentration(types(spark, d), "click", "view")
    return rows.withColumns({c: F.round(c, 6) for c in ("first", "second")})


@query(
    """WITH p AS (SELECT x.channel AS clock, y.channel AS line, y.tick FROM (SELECT DISTINCT channel FROM l) x, l y WHERE x.channel <> y.channel),
q AS (SELECT p.*, r.tick AS back FROM p ASOF LEFT JOIN l r ON p.clock = r.channel AND p.tick >= r.tick),
s AS (SELECT q.*, r.tick AS ahead FROM q ASOF LEFT JOIN l r ON q.clock = r.channel AND q.tick <= r.tick)
SELECT clock, line, count(*) AS edges, count(*) FILTER (least(tick - back, ahead - tick) <= 10000000) AS near FROM s GROUP BY clock, line""",
    _TYPES,
)
def pair_coactivity(spark, d):
    return timing.coactivity(types(spark, d), 10_000_000)


# --- scalars ---------------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, (l_partkey >> 2) & 31 AS field, (bit_count(l_orderkey) % 2)::INTEGER AS parity,
(l_suppkey % 9 = 0 AND l_suppkey >= 9) OR ((l_suppkey - 1) % 9 = 0 AND l_suppkey - 1 >= 9) AS fits FROM lineitem""")
def bitfields(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", edges.field(F.col("l_partkey"), 6, 2).alias("field"), bits.parity(F.col("l_orderkey")).alias("parity"),
        bits.length_ok("9n|9n+1", F.col("l_suppkey")).alias("fits"),
    )


@query("""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(lower(hex(encode(text))), '..')) AS byte FROM documents),
v AS (SELECT doc_id, ('0x' || byte)::BIGINT AS v FROM p), t AS (SELECT doc_id, bit_xor(v) AS xored, sum(v)::BIGINT AS total FROM v GROUP BY doc_id)
SELECT doc_id, coalesce(xored, 0) AS xored, CASE WHEN coalesce(total, 0) = 0 THEN 255 ELSE 255 - ((total - 1) % 255 + 1) END AS lin FROM documents LEFT JOIN t USING (doc_id)""")
def xor_text(spark, d):
    return sums.checksums(table(spark, d, "documents"), ["xored", "lin"])


@query()
def named_checksums(spark, d):
    return sums.checksums(table(spark, d, "documents"), [n for n in sums.NAMES if n != "xored"])


@query("""SELECT doc_id, lower(hex(encode(text))) AS bytes FROM documents""")
def hex_text(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(F.col("text").cast("binary"))).alias("bytes"))


@query("""WITH c AS (SELECT l_returnflag, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_linenumber) AS r FROM c),
s AS (SELECT l_returnflag, sum(n)::BIGINT AS total, max(n) FILTER (r = 1) AS top, coalesce(max(n) FILTER (r = 2), 0) AS second FROM k GROUP BY 1)
SELECT *, round(CASE WHEN top / total <= 0.2 THEN 1.0 ELSE greatest(0.05, 1 - (top / total - 0.2) / 0.8) END, 9) AS penalty FROM s""")
def degenerate_words(spark, d):
    rows = stats.top_share(table(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber")
    return rows.withColumn("penalty", F.round(bits.degenerate(F.col("top"), F.col("total"), 0.2), 9))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity - 2 >= 10 AND l_quantity + 2 <= 40 THEN true WHEN l_quantity + 2 < 10 OR l_quantity - 2 > 40 THEN false END AS ok,
((l_linenumber * 100 - 350 + 180 + 720) % 360 - 180)::BIGINT AS turn FROM lineitem""")
def verdict_3vl(spark, d):
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", verdicts.judge(F.col("l_quantity"), 2.0, 10.0, 40.0).alias("ok"),
        verdicts.circular_difference(F.col("l_linenumber") * 100, F.lit(350)).cast("long").alias("turn"),
    )


@query("""WITH j AS (SELECT l_returnflag, CASE WHEN l_quantity - 2 >= 10 THEN true WHEN l_quantity + 2 < 10 THEN false END AS ok FROM lineitem)
SELECT l_returnflag, CASE WHEN bool_and(ok) = false THEN 'ng' WHEN count(*) FILTER (ok IS NULL) > 0 THEN 'unchecked' ELSE 'ok' END AS status,
count(*) FILTER (ok) AS good, count(*) FILTER (NOT ok) AS bad, count(*) FILTER (ok IS NULL) AS unchecked FROM j GROUP BY 1""")
def report_summary(spark, d):
    ok = verdicts.judge(F.col("l_quantity"), 2.0, 10.0)
    rows = table(spark, d, "lineitem").select("l_returnflag", ok.alias("ok")).groupBy("l_returnflag").agg(
        F.count_if("ok").alias("good"), F.count_if(F.expr("NOT ok")).alias("bad"), F.count_if(F.expr("ok IS NULL")).alias("unchecked")
    )
    whole = F.when(F.col("bad") > 0, False).when(F.col("unchecked") > 0, F.lit(None).cast("boolean")).otherwise(True)
    return rows.withColumn("status", verdicts.status(whole, True))
