"""Queries of checks, of the bus search, of alignment and of live lines."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from wavespark.operators import edges as E
from wavespark.plans import align, search, verify
from wavespark.plans.catalog import _JOINT, _NEAR, _TYPES, _USERS, bounds, embedding_trace, query, types, users
from wavespark.sources import generate as gen

_SPAN = """WITH s AS (SELECT a + (z - a) // 4 AS p, a + (z - a) // 2 AS q FROM b)"""


def _span(spark, d):
    a, z = bounds(spark, d)
    return a + (z - a) // 4, a + (z - a) // 2


@query(
    _SPAN
    + """, n AS (SELECT c.channel, count(l.tick) AS n FROM (SELECT DISTINCT channel FROM l WHERE channel IN ('1', '2', '3')) c
LEFT JOIN l ON l.channel = c.channel AND l.tick > (SELECT p FROM s) AND l.tick < (SELECT p FROM s) + 40000000000 GROUP BY c.channel)
SELECT 'level' AS "check", channel, n = 0 AS ok, n::VARCHAR AS measured, CASE WHEN n = 0 THEN '' ELSE n::VARCHAR || ' changes' END AS reason FROM n""",
    _USERS,
)
def check_level(spark, d):
    a, _ = _span(spark, d)
    return verify.check_level(users(spark, d), ["1", "2", "3"], a, a + 40_000_000_000)


@query(
    _SPAN
    + """, n AS (SELECT channel, count(*) % 2 AS level FROM l WHERE tick <= (SELECT p FROM s) AND channel IN ('click', 'view') GROUP BY channel)
SELECT 'starts' AS "check", channel, level = 1 AS ok, level::VARCHAR AS measured, CASE WHEN level = 1 THEN '' ELSE 'level is ' || level::VARCHAR END AS reason FROM n""",
    _TYPES,
)
def check_starts(spark, d):
    return verify.check_starts(types(spark, d), {"click": 1, "view": 1}, _span(spark, d)[0])


@query(
    _SPAN
    + """, n AS (SELECT channel, count(*) % 2 AS level FROM l WHERE tick <= (SELECT q FROM s) AND channel IN ('click', 'view') GROUP BY channel)
SELECT 'ends' AS "check", channel, level = 0 AS ok, level::VARCHAR AS measured, CASE WHEN level = 0 THEN '' ELSE 'level is ' || level::VARCHAR END AS reason FROM n""",
    _TYPES,
)
def check_ends(spark, d):
    return verify.check_ends(types(spark, d), {"click": 0, "view": 0}, _span(spark, d)[1])


@query(
    _SPAN
    + """ SELECT 'only_moving' AS "check", channel, false AS ok, count(*)::VARCHAR AS measured, 'moved' AS reason FROM l
WHERE channel NOT IN ('click', 'view') AND tick > (SELECT p FROM s) AND tick < (SELECT q FROM s) GROUP BY channel""",
    _TYPES,
)
def check_only_moving(spark, d):
    return verify.check_only_moving(types(spark, d), ["click", "view"], *_span(spark, d))


_PULSES = """WITH w AS (SELECT *, lead(tick) OVER (PARTITION BY channel ORDER BY tick) - tick AS width FROM l),
p AS (SELECT channel, count(*) AS n, min(width) AS lo, max(width) AS hi FROM w WHERE level = 1 AND width IS NOT NULL GROUP BY channel)"""


@query(
    _PULSES
    + """, j AS (SELECT channel, n, n BETWEEN 20 AND 40 AS a, CASE WHEN lo - 1000000 >= 10000000 THEN true WHEN lo + 1000000 < 10000000 THEN false END AS lo3,
CASE WHEN hi + 1000000 <= 500000000000 THEN true WHEN hi - 1000000 > 500000000000 THEN false END AS hi3 FROM p),
k AS (SELECT channel, n, a AND lo3 AND hi3 AS ok FROM j)
SELECT 'pulses' AS "check", channel, ok, n::VARCHAR AS measured, CASE WHEN ok THEN '' ELSE 'count or width' END AS reason FROM k WHERE ok IS NOT NULL""",
    _USERS,
)
def check_pulses(spark, d):
    return verify.check_pulses(users(spark, d), (20, 40), (10e6, 500e9), 1e6).where("ok IS NOT NULL")


@query(
    """WITH r AS (SELECT channel, tick, lead(tick) OVER w AS fall, lead(tick, 2) OVER w AS nxt, level FROM l WINDOW w AS (PARTITION BY channel ORDER BY tick)),
p AS (SELECT channel, count(*) AS n, min(nxt - tick) AS lo, max(nxt - tick) AS hi, sum(fall - tick)::DOUBLE / sum(nxt - tick)::DOUBLE AS duty FROM r WHERE level = 1 AND nxt IS NOT NULL GROUP BY channel),
c AS (SELECT unnest(['1', '2', '3', 'dead']) AS channel), j AS (SELECT c.channel, coalesce(n, 0) AS n, CASE WHEN lo - 1 >= 18e9 AND lo + 1 <= 54e9 THEN true WHEN lo + 1 < 18e9 OR lo - 1 > 54e9 THEN false END AS a,
CASE WHEN hi - 1 >= 18e9 AND hi + 1 <= 54e9 THEN true WHEN hi + 1 < 18e9 OR hi - 1 > 54e9 THEN false END AS b, duty BETWEEN 0.4 AND 0.6 AS c FROM c LEFT JOIN p USING (channel)),
k AS (SELECT channel, n, CASE WHEN n = 0 THEN false ELSE a AND b AND c END AS ok FROM j)
SELECT 'square' AS "check", channel, ok, n::VARCHAR AS measured, CASE WHEN ok THEN '' WHEN n = 0 THEN 'no period' ELSE 'period or duty' END AS reason FROM k""",
    _USERS,
)
def check_square(spark, d):
    return verify.check_square(users(spark, d), 36e9, 0.5, 0.5, 0.1, lines=["1", "2", "3", "dead"])


@query(
    _PULSES
    + """, c AS (SELECT unnest(['1', '2', 'dead']) AS channel), j AS (SELECT c.channel, coalesce(n, 0) AS n, coalesce(n BETWEEN 1 AND 1000000 AND lo >= 1, false) AS ok FROM c LEFT JOIN p USING (channel))
SELECT 'pulses' AS "check", channel, ok, n::VARCHAR AS measured, CASE WHEN ok THEN '' WHEN n = 0 THEN 'no pulses' ELSE 'count or width' END AS reason FROM j""",
    _USERS,
)
def check_dead_lines(spark, d):
    """Pulses of lines that are asked for by name, one of which the capture doesn't have."""
    return verify.check_pulses(users(spark, d), (1, 1_000_000), (1.0, 1e15), 0.0, ["1", "2", "dead"])


@query(
    """WITH t AS (SELECT CAST(vec_id AS VARCHAR) AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings), m AS (SELECT channel, min(v) AS lo, max(v) AS hi FROM t GROUP BY channel)
SELECT channel, lo >= -0.25 AND hi <= 0.25 AS inside FROM m"""
)
def voltage_inside(spark, d):
    from wavespark.operators import analog

    return analog.levels(embedding_trace(spark, d)).select("channel", ((F.col("least") >= -0.25) & (F.col("greatest") <= 0.25)).alias("inside"))


@query(
    """WITH t AS (SELECT CAST(vec_id AS VARCHAR) AS channel, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT channel, avg(v) FILTER (v > -0.35 AND v < 0.35) AS mean, count(*) FILTER (v <= -0.35 OR v >= 0.35) AS clipped FROM t GROUP BY channel),
k AS (SELECT channel, mean, CASE WHEN mean IS NULL THEN NULL WHEN mean BETWEEN -0.02 AND 0.02 THEN CASE WHEN clipped > 0 THEN NULL ELSE true END ELSE false END AS ok FROM m)
SELECT channel, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'ng' ELSE 'unchecked' END AS verdict FROM k"""
)
def voltage_verdicts(spark, d):
    """check_voltage without the measured text, whose digits two engines write differently."""
    return check_voltage(spark, d).select("channel", F.when(F.col("ok"), "ok").when(~F.col("ok"), "ng").otherwise("unchecked").alias("verdict"))


@query()
def check_voltage(spark, d):
    return verify.check_voltage(embedding_trace(spark, d), -0.02, 0.02, -0.35, 0.35)


@query(
    _JOINT
    + """, q AS (SELECT lead(tick) OVER (ORDER BY tick) - tick AS length, c + v AS lit FROM j),
k AS (SELECT min(length) FILTER (lit = 0) AS least, count(*) FILTER (lit = 2 AND length IS NOT NULL) AS both_on FROM q)
SELECT 'dead_time' AS "check", 'click/view' AS channel, both_on = 0 AND least >= 1000 AS ok, least::VARCHAR AS measured,
CASE WHEN both_on = 0 AND least >= 1000 THEN '' ELSE 'overlap or short' END AS reason FROM k""",
    _TYPES,
)
def check_dead_time(spark, d):
    return verify.check_dead_time(types(spark, d), "click", "view", 1000)


@query(
    _NEAR.format(rise="AND level = 1")
    + """, s AS (SELECT min(g) AS least FROM (SELECT lead(tick) OVER (ORDER BY tick) - tick AS g FROM p
UNION ALL SELECT lead(tick) OVER (ORDER BY tick) - tick FROM r)),
k AS (SELECT count(*) AS n, max(abs(b - a)) AS most FROM mm WHERE abs(b - a) * 2 < (SELECT least FROM s))
SELECT 'skew' AS "check", 'click/view' AS channel, n > 0 AND coalesce(most <= 5000000, false) AS ok, most::VARCHAR AS measured,
CASE WHEN n > 0 AND coalesce(most <= 5000000, false) THEN '' ELSE 'skew' END AS reason FROM k""",
    _TYPES,
)
def check_skew(spark, d):
    return verify.check_skew(types(spark, d), "click", "view", 5_000_000)


@query(
    _SPAN
    + """, want AS (SELECT * FROM (VALUES ('starts', 'click', 1, 0), ('starts', 'view', 1, 0), ('ends', 'click', 0, 1), ('ends', 'view', 0, 1)) AS t(c, channel, want, late)),
n AS (SELECT w.c, w.channel, w.want, count(l.tick) % 2 AS level FROM want w LEFT JOIN l ON l.channel = w.channel AND l.tick <= CASE WHEN w.late = 1 THEN (SELECT q FROM s) ELSE (SELECT p FROM s) END GROUP BY ALL),
r AS (SELECT c AS "check", channel, level = want AS ok, level::VARCHAR AS measured, CASE WHEN level = want THEN '' ELSE 'level is ' || level::VARCHAR END AS reason FROM n
UNION ALL SELECT 'only_moving', channel, false, count(*)::VARCHAR, 'moved' FROM l WHERE channel NOT IN ('click', 'view') AND tick > (SELECT p FROM s) AND tick < (SELECT q FROM s) GROUP BY channel)
SELECT *, CASE WHEN ok THEN 'ok' WHEN NOT ok THEN 'ng' ELSE 'unchecked' END AS status FROM r""",
    _TYPES,
)
def check_report(spark, d):
    return verify.report([check_starts(spark, d), check_ends(spark, d), check_only_moving(spark, d)])


@query(
    """WITH z AS (SELECT min(tick) AS lo, max(tick) AS hi FROM l WHERE channel = 'click'),
p AS (SELECT min(tick) AS tick FROM l, z WHERE channel = 'click' GROUP BY (tick - lo) * 512 // (hi - lo + 1)),
v AS (SELECT s AS scale, floor((x.tick - (y.tick - 7000000) * s) / 1000000)::BIGINT AS bin FROM p x, p y, (SELECT unnest([1.0::DOUBLE, 1.0001::DOUBLE]) AS s))
SELECT scale, bin, count(*) AS votes FROM v GROUP BY scale, bin HAVING count(*) >= 4""",
    _TYPES,
)
def affine_align_vote(spark, d):
    own = E.only(types(spark, d), ["click"])
    moved = own.select((F.col("tick") - 7_000_000).alias("tick"))
    return align.votes(own, moved, 1_000_000, [1.0, 1.0001]).where("votes >= 4")


@query()
def align_offset(spark, d):
    own = E.only(types(spark, d), ["click"])
    found = align.find(own, own.select((F.col("tick") - 7_000_000).alias("tick")), 1_000_000)
    return spark.createDataFrame([(float(found["offset"]), float(found["scale"]), found["ambiguous"])], "offset DOUBLE, scale DOUBLE, ambiguous BOOLEAN")


def mixed_pins() -> gen.Signal:
    """An I2C bus, a UART and a CAN line on four pins."""
    i2c = gen.i2c([(0x44, False, b"\x24\x00", b"")] * 8)
    return {
        "p0": gen.uart(b"The quick brown fox jumps over the lazy dog")["line"],
        "p1": i2c["sda"],
        "p2": i2c["scl"],
        "p3": gen.can([(0x100 + k, bytes([k, 255 - k]), False) for k in range(12)])["line"],
    }


@query()
def explanation_packing(spark, d):
    rows = [(c, t, i) for c, (i, ts) in mixed_pins().items() for t in ts]
    found = search.analyze(spark.createDataFrame(rows, "channel STRING, tick BIGINT, initial INT"))
    flat = [(c["protocol"], json.dumps(c["roles"], sort_keys=True), c["total"], c["margin"], c["verdict"]) for c in found]
    return spark.createDataFrame(flat, "protocol STRING, roles STRING, total DOUBLE, margin DOUBLE, verdict STRING")


def _i2c(spark):
    return gen.edges(spark, {f"bus{k}": gen.i2c([(0x40 + k, False, bytes([k, 2 * k]), b""), (0x40 + k, True, bytes([7, k]), b"")], 50 + k) for k in range(8)})


@query()
def i2c_timing(spark, d):
    from wavespark.operators import bus

    return bus.i2c_times(_i2c(spark))


@query(
    """WITH c AS (SELECT tick, 0 AS side, NULL::BIGINT AS bit FROM l WHERE channel = 'view'), k AS (SELECT tick FROM l WHERE channel = 'click' AND level = 1),
v AS (SELECT k.tick, coalesce(r.level, 0)::INTEGER AS bit FROM k ASOF LEFT JOIN (SELECT tick, level FROM l WHERE channel = 'view') r ON k.tick >= r.tick)
SELECT 'x' AS bus, tick, bit FROM v""",
    _TYPES,
)
def sync_bits(spark, d):
    from wavespark.operators import bus

    e = E.only(types(spark, d), ["click", "view"]).select(F.lit("x").alias("bus"), F.col("channel").alias("role"), "tick", F.lit(0).alias("initial"))
    return bus.sync_bits(e, "click", "view")


@query(
    """WITH k AS (SELECT tick FROM l WHERE channel = 'click' AND level = 1),
v AS (SELECT k.tick, coalesce(r.level, 0)::BIGINT AS bit FROM k ASOF LEFT JOIN (SELECT tick, level FROM l WHERE channel = 'view') r ON k.tick >= r.tick),
g AS (SELECT tick, bit, tick - lag(tick) OVER (ORDER BY tick) AS gap FROM v), m AS (SELECT quantile_cont(gap, 0.5) AS md FROM g),
f AS (SELECT tick, bit, sum(CASE WHEN coalesce(gap > 3 * (SELECT md FROM m), false) THEN 1 ELSE 0 END) OVER (ORDER BY tick) AS frame FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY tick) - 1 AS k FROM f)
SELECT 'x' AS bus, frame::BIGINT AS frame, (k // 8)::BIGINT AS word, min(tick) AS s, sum(bit * (1 << (7 - k % 8)::INTEGER))::BIGINT AS value, count(*) AS bits FROM n GROUP BY frame, k // 8""",
    _TYPES,
)
def words8(spark, d):
    from wavespark.operators import bus

    return bus.words(bus.frames_gap(sync_bits(spark, d)), 8)


@query()
def line_scores(spark, d):
    from wavespark.operators import taxonomy

    return taxonomy.line_scores(users(spark, d))


@query()
def pin_classes(spark, d):
    from wavespark.operators import taxonomy

    return taxonomy.pin_classes(taxonomy.line_scores(users(spark, d)))


@query()
def run_report(spark, d):
    """A whole run's expectations on the pins of a mixed capture."""
    from wavespark.plans import runlog

    rows = [(c, t, i) for c, (i, ts) in mixed_pins().items() for t in ts]
    e = spark.createDataFrame(rows, "channel STRING, tick BIGINT, initial INT")
    wanted = [
        runlog.uart("p0", 1e4, b"The quick brown fox jumps over the lazy dog"),
        runlog.i2c("p2", "p1", [{"addr": 0x44, "rw": "w", "bytes": "2400"}] * 8),
        runlog.can("p3", 1e4, [{"id": 0x100 + k, "data": bytes([k, 255 - k]).hex()} for k in range(12)]),
        runlog.starts({"p0": 0, "p3": 0}),
        runlog.only_moving(["p0", "p1", "p2"]),
        runlog.expectation("no_such_kind"),
    ]
    return runlog.verify_run(e, wanted, 1e6, (0, 1 << 40))


@query(
    """WITH u AS (SELECT channel, tick, CASE WHEN tick - lag(tick) OVER (PARTITION BY channel ORDER BY tick) > 3600000000 THEN 1 ELSE 0 END AS f FROM l),
g AS (SELECT *, sum(f) OVER (PARTITION BY channel ORDER BY tick) AS burst FROM u),
k AS (SELECT channel, min(tick) AS start, max(tick) AS "end", count(*) AS edges FROM g GROUP BY channel, burst),
i AS (SELECT CAST(user_id AS VARCHAR) AS channel, epoch_us(ts) AS s, epoch_us(ts) + 1000 AS e FROM events WHERE event_type = 'purchase')
SELECT channel, start, "end", edges, CASE WHEN edges <= 2 THEN edges::VARCHAR ELSE ((1 << ceil(log2(edges))::INTEGER) // 2 + 1)::VARCHAR || '-' || (1 << ceil(log2(edges))::INTEGER)::VARCHAR END AS size
FROM k WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.channel = k.channel AND i.e >= k.start AND i.s <= k."end")""",
    _USERS,
)
def unread_activity(spark, d):
    from wavespark.plans import reading
    from wavespark.sources.tables import micros, table

    items = table(spark, d, "events").where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("channel"), micros("ts").alias("s"), (micros("ts") + 1000).alias("e"))
    return reading.unread(users(spark, d), items, 3_600_000_000)


@query(
    """WITH p AS (SELECT level, lead(tick, 2) OVER (PARTITION BY channel ORDER BY tick) - tick AS period FROM l),
k AS (SELECT period // 3600000000 + 1 AS period, count(*) AS n FROM p WHERE level = 1 AND period IS NOT NULL GROUP BY 1),
f AS (SELECT *, CASE WHEN coalesce(period > 1.25 * lag(period) OVER (ORDER BY period), false) THEN 1 ELSE 0 END AS f FROM k),
g AS (SELECT *, sum(f) OVER (ORDER BY period) AS speed FROM f) SELECT speed::BIGINT AS speed, sum(n)::BIGINT AS frames, min(period) AS fastest FROM g GROUP BY speed""",
    _USERS,
)
def clock_speeds(spark, d):
    from wavespark.plans import reading

    periods = E.pulse_rows(users(spark, d)).select((F.expr("period div 3600000000") + 1).alias("period"))
    return reading.clock_speeds(periods)


@query()
def annotation_rows(spark, d):
    from wavespark.plans import reading
    from wavespark.plans.protocols_catalog import CASES
    from wavespark.protocols.decode import decode

    out = None
    for name in ("can_frames", "i2c_transactions", "spi_bytes"):
        signals, decoder = CASES[name]
        rows = reading.annotations(decode(gen.edges(spark, signals), decoder))
        out = rows if out is None else out.unionByName(rows)
    return out
