"""Queries of records by interval, of two lines' edges, and of addresses, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavespark.operators import quanta as Q
from wavespark.plans.catalog import _TYPES, query, table, types
from wavespark.sources import files

_STEP = 60_000_000

_QUANTA = f"""WITH u AS (SELECT channel, tick // {_STEP} AS q, arg_max(level, tick) AS level, least(count(*), 127) AS count FROM l GROUP BY 1, 2),
w AS (SELECT *, coalesce(lag(level) OVER (PARTITION BY channel ORDER BY q), 0) AS before FROM u) """


@query(_QUANTA + "SELECT channel, q, level, count, before FROM w", _TYPES)
def quanta_levels(spark, d):
    return Q.quanta(types(spark, d), _STEP).withColumn("level", F.col("level").cast("long"))


@query(
    _QUANTA
    + """SELECT channel, sum((count + 1 - before) // 2)::BIGINT AS rises, max(count) < 127 AS exact, CASE WHEN min(q) > 0 THEN arg_min(before, q) ELSE -1 END AS first_level,
arg_max(level, q) AS end_level, true AS moved FROM w GROUP BY channel""",
    _TYPES,
)
def quanta_summary(spark, d):
    return Q.summary(Q.quanta(types(spark, d), _STEP)).fillna(-1, ["first_level"]).withColumn("end_level", F.col("end_level").cast("long"))


@query(_QUANTA + "SELECT channel, q, level, CASE WHEN level <> before THEN 1 ELSE 2 END::BIGINT AS at_least FROM w", _TYPES)
def quanta_latches(spark, d):
    return Q.latches(Q.quanta(types(spark, d), _STEP)).withColumn("level", F.col("level").cast("long"))


@query(
    f"""WITH u AS (SELECT channel, tick // {_STEP} AS q, arg_min(level, tick) AS first, min(tick) % {_STEP} > 0 AS later, max(level) AS hi, min(level) AS lo, count(*) AS changes FROM l GROUP BY 1, 2)
SELECT channel, q AS "interval", CASE WHEN later THEN greatest(hi, 1 - first) ELSE hi END AS any_high, 1 - CASE WHEN later THEN least(lo, 1 - first) ELSE lo END AS any_low, changes FROM u""",
    _TYPES,
)
def reduced_intervals(spark, d):
    rows = files.reduced(types(spark, d), _STEP)
    return rows.select("channel", "interval", F.col("any_high").cast("long").alias("any_high"), F.col("any_low").cast("long").alias("any_low"), "changes")


@query(
    """WITH p AS (SELECT CAST(o_custkey % 7 AS VARCHAR) AS capture_id, o_orderkey AS tick FROM orders WHERE o_orderkey % 100 = 0),
t AS (SELECT DISTINCT CAST(o_custkey % 7 AS VARCHAR) AS capture_id, o_orderkey AS tick FROM orders)
SELECT t.capture_id, t.tick, coalesce(p.tick, -1) AS start, coalesce(t.tick - p.tick, -1) AS part_tick FROM t ASOF LEFT JOIN p ON t.capture_id = p.capture_id AND t.tick >= p.tick"""
)
def parts_located(spark, d):
    ticks = table(spark, d, "orders").select((F.col("o_custkey") % 7).cast("string").alias("capture_id"), F.col("o_orderkey").cast("long").alias("tick")).distinct()
    found = Q.locate(ticks, ticks.where("tick % 100 = 0"))  # every hundredth order opens a part
    return found.fillna(-1, ["start", "part_tick"])


@query(
    """WITH x AS (SELECT tick // 1000000 AS tick, row_number() OVER (ORDER BY tick) AS k FROM l WHERE channel = 'click'),
g AS (SELECT tick, count(*) AS n FROM x GROUP BY tick HAVING count(*) % 2 = 1), f AS (SELECT tick, row_number() OVER (ORDER BY tick) % 2 AS level FROM g),
y AS (SELECT tick // 1000000 AS tick FROM l WHERE channel = 'view' GROUP BY 1 HAVING count(*) % 2 = 1)
SELECT tick, CASE WHEN level = 1 THEN 'rise' ELSE 'fall' END AS edge FROM f JOIN y USING (tick)""",
    _TYPES,
)
def same_sample(spark, d):
    rows = types(spark, d).select("channel", F.expr("tick div 1000000").alias("tick")).groupBy("channel", "tick").agg(F.count(F.lit(1)).alias("n"))
    return Q.same_sample(rows.where("n % 2 = 1").select("channel", "tick"), "click", "view")


@query(
    """WITH s AS (SELECT tick AS start, level FROM l WHERE channel = 'view'), c AS (SELECT tick FROM l WHERE channel = 'click'),
n AS (SELECT s.start, count(*) AS edges FROM c ASOF LEFT JOIN s ON c.tick >= s.start WHERE s.start IS NULL OR s.start < c.tick GROUP BY s.start),
a AS (SELECT start, level FROM s UNION ALL SELECT NULL, 0), j AS (SELECT a.start, a.level, coalesce(n.edges, 0) AS edges FROM a LEFT JOIN n ON a.start IS NOT DISTINCT FROM n.start)
SELECT coalesce(start, -1) AS start, level, CASE WHEN level = 0 THEN edges // 2 ELSE 0 END AS clocks, edges FROM j""",
    _TYPES,
)
def select_windows(spark, d):
    return Q.select_windows(types(spark, d), "click", "view").fillna(-1, ["start"])


_PIDS = ["SETUP", "DATA0", "ACK", "SOF", "IN", "DATA1", "NAK", "OUT"]


@query(
    """WITH p AS (SELECT user_id AS bus, event_id AS s, ['SETUP', 'DATA0', 'ACK', 'SOF', 'IN', 'DATA1', 'NAK', 'OUT'][(event_id * 7 + user_id) % 8 + 1] AS pid, event_id % 11 <> 0 AS ok FROM events),
g AS (SELECT bus, s, CASE WHEN ok THEN pid END AS pid FROM p), x AS (SELECT *, lead(pid) OVER w AS a, lead(pid, 2) OVER w AS b FROM g WINDOW w AS (PARTITION BY bus ORDER BY s))
SELECT bus, s, pid AS token, CASE WHEN pid <> 'SOF' AND a LIKE 'DATA%' THEN a END AS data_pid,
CASE WHEN pid = 'SOF' THEN NULL WHEN a IN ('ACK', 'NAK') THEN a WHEN a LIKE 'DATA%' AND b IN ('ACK', 'NAK') THEN b END AS handshake FROM x WHERE pid IN ('SETUP', 'IN', 'OUT', 'SOF')"""
)
def usb_transactions(spark, d):
    at = ((F.col("event_id") * 7 + F.col("user_id")) % 8 + 1).cast("int")
    rows = table(spark, d, "events").select(F.col("user_id").alias("bus"), F.col("event_id").alias("s"), F.element_at(F.array(*map(F.lit, _PIDS)), at).alias("pid"), (F.col("event_id") % 11 != 0).alias("ok"))
    return Q.usb_transactions(rows)


@query(
    """WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 256 AS a, l_suppkey % 256 AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, CASE WHEN a < 128 THEN 'short' WHEN a >> 5 = 4 THEN 'group' WHEN a >> 1 = 127 THEN 'broadcast' ELSE 'special' END AS dali_to,
CASE WHEN a < 128 THEN a >> 1 WHEN a >> 5 = 4 THEN (a >> 1) & 15 ELSE -1 END AS dali_number, CASE WHEN a % 2 = 1 THEN 'command' ELSE 'arc_power' END AS selector,
CASE WHEN a = 255 THEN 'idle' WHEN a = 0 THEN 'broadcast' WHEN a < 128 THEN 'short' WHEN a BETWEEN 192 AND 231 THEN 'long' WHEN a < 192 THEN 'accessory' ELSE 'other' END AS dcc_kind,
CASE WHEN a BETWEEN 192 AND 231 THEN (a & 63) * 256 + b WHEN a NOT IN (0, 255) THEN a ELSE -1 END AS dcc_number,
CASE WHEN a >= 128 THEN 'in' ELSE 'out' END AS direction, ['standard', 'class', 'vendor', 'reserved'][(a >> 5) % 4 + 1] AS request_type FROM a"""
)
def addresses(spark, d):
    a, b = (F.col("l_partkey") % 256).cast("long"), (F.col("l_suppkey") % 256).cast("long")
    names = ("dali_to", "dali_number", "selector", "dcc_kind", "dcc_number", "direction", "request_type")
    columns = [*Q.dali_address(a), *Q.dcc_address(a, b), *Q.setup_fields(a)]
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *(c.alias(n) for c, n in zip(columns, names, strict=True))).fillna(-1, ["dali_number", "dcc_number"])
