"""Tables of the waveform engine, as Spark DDL. Ticks are integers on one exact clock per capture."""

CAPTURES = "capture_id STRING, tick_hz STRUCT<num: BIGINT, den: BIGINT>, layout STRING, complete BOOLEAN"
PARTS = "capture_id STRING, part INT, ticks BIGINT, tick0 BIGINT"
CHANNELS = "capture_id STRING, part INT, channel STRING, initial INT, step BIGINT, phase BIGINT"
EDGES = "channel STRING, tick BIGINT, seq BIGINT, level INT"
ANALOG = "channel STRING, k BIGINT, value DOUBLE"
