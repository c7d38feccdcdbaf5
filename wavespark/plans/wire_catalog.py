"""A query for each protocol decoder over buses that carry a table: each row of supplier is sent, decoded and compared.

A row's message is x, 32 bits that differ from row to row. Every row is a bus of its own, encoded
and decoded in Arrow tasks, so the queries scale with the table. The SQL says what the table holds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavespark.operators import bus as B
from wavespark.plans.catalog import QUERIES, SQL, query, table
from wavespark.plans.protocols_catalog import CASES
from wavespark.protocols import clocked, serial, upper
from wavespark.protocols.decode import Decoder, decode
from wavespark.sources import generate as gen

EDGES = "bus STRING, role STRING, tick BIGINT, initial INT"

_ROWS = """WITH r AS (SELECT CAST(s_suppkey AS VARCHAR) AS bus, (s_suppkey * 2654435761) % 4294967296 AS x FROM supplier),
m AS (SELECT bus, x, (x >> 24) & 255 AS b0, (x >> 16) & 255 AS b1, (x >> 8) & 255 AS b2, x & 255 AS b3, lpad(lower(hex(x)), 8, '0') AS h FROM r) """


def sent(rows: DataFrame, encode: Callable[[int], gen.Signal]) -> DataFrame:
    """The edges of the signal of each row (bus, x): a row for each edge, one with a null tick for a line without."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bus, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat = [(bus, role, t, initial) for role, (initial, ticks) in encode(x).items() for t in (ticks or [None])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*flat, strict=True), (pa.string(), pa.string(), pa.int64(), pa.int32()), strict=True)],
                    ["bus", "role", "tick", "initial"],
                )

    return rows.mapInArrow(run, EDGES)


def _buses(spark: SparkSession, sf_dir: str, encode: Callable[[int], gen.Signal]) -> DataFrame:
    """The edges of a bus for each row of supplier."""
    x = F.pmod(F.col("s_suppkey").cast("long") * F.lit(2654435761), F.lit(1 << 32))
    return sent(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("bus"), x.alias("x")), encode)


def _wire(name: str, encode: Callable[[int], gen.Signal], columns: str, sql: str, decoder: Decoder | None = None, kind: str | None = None) -> None:
    """Registers a query: columns are fields of the items and their types, n their order in a bus."""
    read = decoder or CASES[name][1]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        items = decode(_buses(spark, sf_dir, encode), read)
        items = items.where(F.col("kind") == kind) if kind else items
        out = [F.col("bus")]
        for column in columns.split(", "):
            field, type_ = column.split()
            if field == "n":
                out.append(F.row_number().over(Window.partitionBy("bus").orderBy("s", "e", "kind")).cast("long").alias("n"))
            elif field == "kind":
                out.append(F.col("kind"))
            else:
                out.append(F.get_json_object("fields", f"$.{field}").cast(type_).alias(field))
        return items.select(*out)

    run.__name__ = name
    QUERIES[name] = run
    SQL[name] = _ROWS + sql


def _bytes(x: int) -> bytes:
    return x.to_bytes(4, "big")


def _can_id(x: int) -> int:
    return (x >> 24) * 8 + (x >> 16 & 7)


_FOUR = "SELECT bus, n, [b0, b1, b2, b3][n] AS value, true AS ok FROM m, (SELECT unnest([1, 2, 3, 4])::BIGINT AS n)"

_wire("uart_chars", lambda x: gen.uart(_bytes(x)), "n long, value long, ok boolean", _FOUR, lambda x: serial.uart(x["line"], 1 << 40, 100))
_wire("ps2_bytes", lambda x: gen.ps2(_bytes(x)), "n long, value long, ok boolean", _FOUR)


def _lin(x: int) -> gen.Signal:
    pid, data = serial.lin_pid((x >> 24) % 60), _bytes(x)[1:]
    return gen.uart(bytes([0x55, pid, *data, serial.lin_sum(data, pid)]), break_bits=14)


_wire("lin_frames", _lin, "id long, sync_ok boolean, pid_ok boolean, data string", "SELECT bus, b0 % 60 AS id, true AS sync_ok, true AS pid_ok, substr(h, 3) AS data FROM m")
_wire("dmx_packets", lambda x: gen.uart(b"\0" + _bytes(x), break_bits=25, stop=2), "start_code long, slots long, data string",
      "SELECT bus, 0::BIGINT AS start_code, 4::BIGINT AS slots, h AS data FROM m")
_wire("can_frames", lambda x: gen.can([(_can_id(x), _bytes(x), False)]), "id long, ide boolean, data string, ack boolean, ok boolean",
      "SELECT bus, b0 * 8 + (b1 & 7) AS id, false AS ide, h AS data, true AS ack, true AS ok FROM m")
_wire("can_fd_frames", lambda x: gen.can_fd([(_can_id(x), _bytes(x) * 3, True)]), "id long, brs long, data string, ack boolean, ok boolean",
      "SELECT bus, b0 * 8 + (b1 & 7) AS id, 1::BIGINT AS brs, h || h || h AS data, true AS ack, true AS ok FROM m")
_wire("i2c_transactions", lambda x: gen.i2c([(x >> 24 & 127, False, _bytes(x)[1:], b"")]), "addr long, rw string, addr_ack boolean, bytes string",
      "SELECT bus, b0 & 127 AS addr, 'w' AS rw, true AS addr_ack, substr(h, 3) AS bytes FROM m")
_wire("spi_bytes", lambda x: gen.spi([(_bytes(x), _bytes(x)[::-1])]), "bits long, mosi string, miso string",
      "SELECT bus, 32::BIGINT AS bits, h AS mosi, substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS miso FROM m",
      lambda x: clocked.spi(x["clk"], x["mosi"], x["miso"], x["cs"], 0))


def _mdio(x: int) -> gen.Signal:
    return gen.mdio("read" if x & 1 else "write", x >> 24 & 31, x >> 16 & 31, x & 0xFFFF)


_wire("mdio_frames", _mdio, "op string, phy long, reg long, value long",
      "SELECT bus, CASE WHEN x & 1 = 1 THEN 'read' ELSE 'write' END AS op, b0 & 31 AS phy, b1 & 31 AS reg, x & 65535 AS value FROM m")
_wire("declared_mdio", lambda x: gen.mdio("read", x >> 24 & 31, x >> 16 & 31, x & 0xFFFF), "pre long, st long, op long, phy long, reg long, value long",
      "SELECT bus, 4294967295 AS pre, 1::BIGINT AS st, 2::BIGINT AS op, b0 & 31 AS phy, b1 & 31 AS reg, x & 65535 AS value FROM m")
_wire("swd_transfers", lambda x: gen.swd(x >> 24 & 1, x >> 25 & 1, (x >> 26 & 3) * 4, x), "port string, op string, addr long, ack string, data long, parity_ok boolean",
      "SELECT bus, CASE WHEN b0 & 1 = 1 THEN 'AP' ELSE 'DP' END AS port, CASE WHEN b0 & 2 = 2 THEN 'read' ELSE 'write' END AS op, ((b0 >> 2) & 3) * 4 AS addr, 'ok' AS ack, x AS data, true AS parity_ok FROM m")
_wire("sd_commands", lambda x: gen.sd(x >> 24 & 63, x), "index long, argument long", "SELECT bus, b0 & 63 AS index, x AS argument FROM m")
_wire("jtag_scans", lambda x: gen.jtag((x >> 24 & 15, 4), (x, 32)), "kind string, bits long, tdi long",
      "SELECT bus, 'jtag_ir' AS kind, 4::BIGINT AS bits, b0 & 15 AS tdi FROM m UNION ALL SELECT bus, 'jtag_dr', 32, x FROM m")
_wire("i2s_samples", lambda x: gen.i2s([(x >> 24, -(x >> 16 & 255)), (x >> 8 & 255, -(x & 255)), (1, -1)]), "n long, channel string, sample long",
      "SELECT bus, n, CASE WHEN n % 2 = 1 THEN 'right' ELSE 'left' END AS channel, [-b1, b2, -b3, 1, -1][n] AS sample FROM m, (SELECT unnest([1, 2, 3, 4, 5])::BIGINT AS n)")
# Zeros alone have pulses of one width, which could be ones as well: each frame begins with both.
_wire("rgb_led_frames", lambda x: gen.rgb_led([b"\x0f" + _bytes(x)[2:], b"\xa0" + _bytes(x)[:2]]), "n long, bytes string, extra_bits long",
      "SELECT bus, n, CASE WHEN n = 1 THEN '0f' || substr(h, 5) ELSE 'a0' || substr(h, 1, 4) END AS bytes, 0::BIGINT AS extra_bits FROM m, (SELECT unnest([1, 2])::BIGINT AS n)")
_wire("wiegand_codes", lambda x: gen.wiegand(x & 0xFFFFFF), "bits long, parity_ok boolean, code long", "SELECT bus, 26::BIGINT AS bits, true AS parity_ok, x & 16777215 AS code FROM m")
_wire("onewire_bytes", lambda x: gen.onewire(b"\xcc" + _bytes(x)), "presence boolean, bytes string, extra_bits long", "SELECT bus, true AS presence, 'cc' || h AS bytes, 0::BIGINT AS extra_bits FROM m")
_wire("nec_frames", lambda x: gen.nec(x >> 24, x >> 16 & 255), "address long, command long, address_ok boolean, command_ok boolean",
      "SELECT bus, b0 AS address, b1 AS command, true AS address_ok, true AS command_ok FROM m", kind="nec")


def _dht(x: int) -> gen.Signal:
    return gen.dht(bytes([x >> 24 & 1, x >> 16 & 255, x >> 8 & 1, x & 255]))


_wire("dht_values", _dht, "bytes string",
      """SELECT bus, '0' || (b0 & 1) || lpad(lower(hex(b1)), 2, '0') || '0' || (b2 & 1) || lpad(lower(hex(b3)), 2, '0')
|| lpad(lower(hex(((b0 & 1) + b1 + (b2 & 1) + b3) & 255)), 2, '0') AS bytes FROM m""")
_wire("sent_messages", lambda x: gen.sent(x >> 24 & 15, [x >> 4 * k & 15 for k in range(6)]), "status long, nibbles string, ok boolean",
      "SELECT bus, b0 & 15 AS status, '[' || list_aggregate(list_transform([0, 4, 8, 12, 16, 20], lambda k: ((x >> k) & 15)::VARCHAR), 'string_agg', ',') || ']' AS nibbles, true AS ok FROM m")
_wire("cec_messages", lambda x: gen.cec(bytes([x >> 24, x >> 16 & 255])), "from long, to long, bytes string",
      "SELECT bus, b0 >> 4 AS \"from\", b0 & 15 AS \"to\", lpad(lower(hex(b1)), 2, '0') AS bytes FROM m")
_wire("dali_frames", lambda x: gen.dali(x & 0xFFFF), "kind string, value long", "SELECT bus, 'dali' AS kind, x & 65535 AS value FROM m")
_wire("dcc_packets", lambda x: gen.dcc(_bytes(x)[:3]), "bytes string, ok boolean",
      "SELECT bus, substr(h, 1, 6) || lpad(lower(hex(xor(xor(b0, b1), b2))), 2, '0') AS bytes, true AS ok FROM m")
_wire("usb_packets", lambda x: gen.usb(13, gen.usb_token(x >> 24 & 127, x >> 16 & 15)), "pid string, address long, endpoint long, ok boolean",
      "SELECT bus, 'SETUP' AS pid, b0 & 127 AS address, b1 & 15 AS endpoint, true AS ok FROM m")
_wire("spdif_subframes", lambda x: gen.spdif([x >> 24, -(x >> 16 & 255), 77]), "n long, sample long, ok boolean",
      "SELECT bus, n, [b0, -b1][n] AS sample, true AS ok FROM m, (SELECT unnest([1, 2])::BIGINT AS n)")
_wire("usb_pd_messages", lambda x: gen.usb_pd(0x1161, [x]), "type long, objects string, ok boolean", "SELECT bus, 1::BIGINT AS type, '[' || x || ']' AS objects, true AS ok FROM m")
_wire("cjtag_cycles", lambda x: gen.cjtag([(b & 1, b >> 1 & 1, b >> 2 & 1) for b in _bytes(x)]), "n long, tdi long, tms long, tdo long",
      """SELECT bus, n, [b0, b1, b2, b3][n] & 1 AS tdi, ([b0, b1, b2, b3][n] >> 1) & 1 AS tms, ([b0, b1, b2, b3][n] >> 2) & 1 AS tdo
FROM m, (SELECT unnest([1, 2, 3, 4])::BIGINT AS n)""", kind="cjtag")
_wire("tdm_slots", lambda x: gen.tdm([[b & 127 for b in _bytes(x)], [-1, 2, -3, 4]]), "n long, slots string",
      "SELECT bus, 1::BIGINT AS n, '[' || (b0 & 127) || ',' || (b1 & 127) || ',' || (b2 & 127) || ',' || (b3 & 127) || ']' AS slots FROM m UNION ALL SELECT bus, 2, '[-1,2,-3,4]' FROM m")
_wire("qspi_transfers", lambda x: gen.qspi(0x6B, _bytes(x)), "command string, data string", "SELECT bus, '6b' AS command, h AS data FROM m")
_wire("sd_spi_commands", lambda x: gen.sd_spi(17, x, 0), "index long, argument long, crc_ok boolean, r1 long",
      "SELECT bus, 17::BIGINT AS index, x AS argument, true AS crc_ok, 0::BIGINT AS r1 FROM m")
_wire("swim_frames", lambda x: gen.swim([1, x >> 16 & 255, x >> 8 & 255]), "n long, host boolean, value long, parity_ok boolean, ack boolean",
      "SELECT bus, n, true AS host, [1, b1, b2][n] AS value, true AS parity_ok, true AS ack FROM m, (SELECT unnest([1, 2, 3])::BIGINT AS n)")
_wire("j1850_frames", lambda x: gen.j1850(_bytes(x)), "bytes string, ok boolean", "SELECT bus, h || lpad(lower(hex(crc)), 2, '0') AS bytes, true AS ok FROM crcs")

#: The frame's check byte: polynomial 0x1D from 0xFF, inverted, a bit at a time.
SQL["j1850_frames"] = _ROWS.replace("WITH r", "WITH RECURSIVE r", 1) + """, c AS (SELECT bus, x, h, 0 AS i, 255::BIGINT AS s FROM m
UNION ALL SELECT bus, x, h, i + 1, CASE WHEN ((s >> 7) & 1) <> ((x >> (31 - i)) & 1) THEN xor((s << 1) & 255, 29) ELSE (s << 1) & 255 END FROM c WHERE i < 32)
SELECT bus, h || lpad(lower(hex(255 - s)), 2, '0') AS bytes, true AS ok FROM c WHERE i = 32"""


def _modbus(x: int) -> gen.Signal:
    frame = bytes([x >> 24, 3, *_bytes(x)[1:]])
    return gen.uart(frame + upper.modbus_crc(frame).to_bytes(2, "little"), gap=0)


_wire("modbus_frames", _modbus, "unit long, function long, data string, junk long",
      "SELECT bus, b0 AS unit, 3::BIGINT AS function, substr(h, 3) AS data, 0::BIGINT AS junk FROM m",
      lambda x: upper.modbus(serial.uart(x["line"], 1 << 40, 100), 1000))
_wire("uart_lines", lambda x: gen.uart(b"v%d\nok\r\n" % x), "n long, text string", "SELECT bus, 1::BIGINT AS n, 'v' || x AS text FROM m UNION ALL SELECT bus, 2, 'ok' FROM m",
      lambda x: upper.text_lines(serial.uart(x["line"], 1 << 40, 100)))


def _register(x: int) -> gen.Signal:
    return gen.i2c([(x >> 24 & 127, False, _bytes(x)[1:], b""), (x >> 24 & 127, False, _bytes(x)[3:], b"")])


@query(_ROWS + """SELECT bus, frame, b0 & 127 AS addr, 'w' AS rw, CASE frame WHEN 1 THEN substr(h, 3) ELSE substr(h, 7) END AS bytes
FROM m, (SELECT unnest([1, 2])::BIGINT AS frame)""")
def i2c_words(spark, d):
    """Without a decoder: bits at clock rises, frames from START to STOP, words of nine, transactions."""
    e = _buses(spark, d, _register)
    frames = B.frames_startstop(B.sync_bits(e, "scl", "sda"), B.startstop(e))
    return B.transactions(B.words(frames, 9)).select("bus", "frame", F.col("addr").cast("long").alias("addr"), "rw", "bytes")


@query(_ROWS + """SELECT bus, frame, word, CASE frame WHEN 1 THEN [b0, b1, b2, b3][word + 1] ELSE [b3, b2, b1, b0][word + 1] END AS value, 8::BIGINT AS bits
FROM m, (SELECT unnest([1, 2])::BIGINT AS frame), (SELECT unnest([0, 1, 2, 3])::BIGINT AS word)""")
def spi_words(spark, d):
    """Without a decoder: bits at clock rises, frames by select, words of eight."""
    e = _buses(spark, d, lambda x: gen.spi([(_bytes(x), b"\0" * 4), (_bytes(x)[::-1], b"\0" * 4)]))
    found = B.words(B.frames_select(B.sync_bits(e, "clk", "mosi"), e, "cs"), 8)
    return found.select("bus", F.col("frame").cast("long").alias("frame"), "word", "value", "bits")
