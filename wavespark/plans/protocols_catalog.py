"""A query for each protocol decoder, over signals encoded from the protocol's rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavespark.plans.catalog import QUERIES, query, table
from wavespark.protocols import canfd, clocked, declare, more, pulse, serial, upper
from wavespark.protocols.decode import decode
from wavespark.sources import generate as gen

_DATA = bytes(range(16))


def _declared(text: str, lines: dict) -> list:
    """A TOML definition over bits read at clock rises."""
    rises = lines["clk"].edges(1)
    return declare.scan(declare.load(text), [int(b) for b in lines["data"].at(rises)], rises.tolist())


#: name -> (signals by bus, decoder over lines by role)
CASES: dict = {
    "uart_chars": ({"a": gen.uart(b"Hello, wave\n"), "b": gen.uart(bytes(range(0, 256, 7)), 64)}, lambda x: serial.uart(x["line"], 1 << 40)),
    "lin_frames": ({"a": gen.uart(bytes([0x55, serial.lin_pid(0x2A), 1, 2, 3, serial.lin_sum(bytes([1, 2, 3]), serial.lin_pid(0x2A))]), break_bits=14)},
                   lambda x: serial.lin(x["line"], 1 << 40, 100)),
    "dmx_packets": ({"a": gen.uart(bytes([0, 10, 20, 30]), break_bits=25, stop=2)}, lambda x: serial.dmx(x["line"], 1 << 40, 100)),
    "can_frames": ({"a": gen.can([(0x123, b"\x01\x02\x03", False), (0x1ABCDEF0, _DATA[:8], True), (0x7FF, b"", False)])}, lambda x: serial.can(x["line"], 1 << 40, 100)),
    "i2c_transactions": ({"a": gen.i2c([(0x44, False, b"\x24\x00", b""), (0x44, True, b"\x66\x77\x93", b"")])}, lambda x: clocked.i2c(x["scl"], x["sda"])),
    "spi_bytes": ({f"mode{m}": gen.spi([(b"\x9f\x00\x00", b"\xff\xef\x40"), (b"\x05\x00", b"\x00\x02")], mode=m) for m in range(4)},
                  lambda x: clocked.spi(x["clk"], x["mosi"], x["miso"], x["cs"], clocked.spi_mode(x["clk"], x["mosi"], x["cs"]) or 0)),
    "ps2_bytes": ({"a": gen.ps2(b"\x1c\xf0\x1c")}, lambda x: clocked.ps2(x["clk"], x["data"])),
    "mdio_frames": ({"r": gen.mdio("read", 1, 2, 0x1234), "w": gen.mdio("write", 3, 31, 0xBEEF)}, lambda x: clocked.mdio(x["clk"], x["data"])),
    "swd_transfers": ({"r": gen.swd(0, 1, 0, 0x2BA01477), "w": gen.swd(1, 0, 4, 0xE000EDF0)}, lambda x: clocked.swd(x["clk"], x["data"])),
    "sd_commands": ({"a": gen.sd(0, 0), "b": gen.sd(8, 0x1AA)}, lambda x: clocked.sd_commands(x["clk"], x["data"])),
    "jtag_scans": ({"a": gen.jtag((0b1110, 4), (0x4BA00477, 32))}, lambda x: clocked.jtag(x["tck"], x["tms"], x["tdi"])),
    "i2s_samples": ({"a": gen.i2s([(100, -100), (32767, -32768), (1, -1)])}, lambda x: clocked.i2s(x["bclk"], x["ws"], x["sd"])),
    "rgb_led_frames": ({"a": gen.rgb_led([b"\x10\x20\x30\xff\x00\x80", b"\x01\x02\x03"])}, lambda x: pulse.rgb_led(x["line"], 100e6)),
    "wiegand_codes": ({"a": gen.wiegand(0x123456), "b": gen.wiegand(0x1234ABCD, 34)}, lambda x: pulse.wiegand(x["d0"], x["d1"], 1e6)),
    "onewire_bytes": ({"a": gen.onewire(b"\xcc\x44")}, lambda x: pulse.onewire(x["line"], 10e6)),
    "nec_frames": ({"a": gen.nec(0x04, 0x08)}, lambda x: pulse.nec(x["line"], 1e6)),
    "dht_values": ({"a": gen.dht(bytes([2, 0x8C, 1, 0x5F])), "b": gen.dht(bytes([45, 0, 22, 5]))}, lambda x: pulse.dht(x["line"], 1e6)),
    "sent_messages": ({"a": gen.sent(3, [1, 2, 3, 4, 5, 6])}, lambda x: pulse.sent(x["line"], 10e6)),
    "j1850_frames": ({"a": gen.j1850(b"\x48\x6b\x10\x41")}, lambda x: pulse.j1850(x["line"], 1e6)),
    "cec_messages": ({"a": gen.cec(b"\x40\x04")}, lambda x: pulse.cec(x["line"], 1e6)),
    "dali_frames": ({"f": gen.dali(0xFF05), "b": gen.dali(0x7F, 8)}, lambda x: pulse.dali(x["line"], 1e6)),
    "dcc_packets": ({"a": gen.dcc(b"\x03\x3f\x90")}, lambda x: pulse.dcc(x["line"], 1e6)),
    "usb_packets": ({"t": gen.usb(13, gen.usb_token(5, 1)), "d": gen.usb(3, gen.usb_data(b"\x80\x06\x00\x01\x00\x00\xff\xff"))}, lambda x: pulse.usb(x["dp"], x["dm"], 120e6)),
    "spdif_subframes": ({"a": gen.spdif([1000, -1000, 77])}, lambda x: pulse.spdif(x["line"], 10e6)),
    "can_fd_frames": ({"a": gen.can_fd([(0x123, bytes(range(12)), True), (0x7F0, b"\x01", False), (0x10, bytes(64), True)])}, lambda x: canfd.read(x["line"], 1 << 40, 160, 4)),
    "usb_pd_messages": ({"a": gen.usb_pd(0x1161, [0x0001912C])}, lambda x: more.usb_pd(x["line"], 30e6)),
    "cjtag_cycles": ({"a": gen.cjtag([(1, 0, 1), (0, 1, 0), (1, 1, 1)])}, lambda x: more.cjtag(x["clk"], x["data"])),
    "tdm_slots": ({"a": gen.tdm([[100, -2, 7, -128], [1, 2, 3, 4]])}, lambda x: more.tdm(x["bclk"], x["fs"], x["sd"], 4, 8)),
    "qspi_transfers": ({"a": gen.qspi(0x6B, b"\xde\xad")}, lambda x: more.qspi(x["clk"], x["cs"], [x[f"io{k}"] for k in range(4)], [("command", 1, 8), ("data", 4, 0)])),
    "sd_spi_commands": ({"a": gen.sd_spi(17, 512, 0)}, lambda x: more.sd_spi(clocked.spi(x["clk"], x["mosi"], x["miso"], x["cs"]))),
    "declared_mdio": ({"a": gen.mdio("read", 1, 2, 0x1234)}, lambda x: _declared(declare.MDIO, x)),
    "swim_frames": ({"a": gen.swim([0x01, 0xA5])}, lambda x: pulse.swim(x["line"], 80e6)),
}


def _add(name: str, signals: dict, decoder) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return decode(gen.edges(spark, signals), decoder)

    run.__name__ = name
    QUERIES[name] = run


for _name, (_signals, _decoder) in CASES.items():
    _add(_name, _signals, _decoder)


def _modbus(lines):
    return upper.modbus(serial.uart(lines["line"], 1 << 40, 100), 1000)


_FRAME = bytes([1, 3, 0, 0, 0, 2])
_add("modbus_frames", {"a": gen.uart(_FRAME + upper.modbus_crc(_FRAME).to_bytes(2, "little"), gap=0)}, _modbus)
_add("uart_lines", {"a": gen.uart(b"CASE_BEGIN one\nok\nCASE_END one\n")}, lambda x: upper.text_lines(serial.uart(x["line"], 1 << 40, 100)))


@query("""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '.')) AS c FROM documents), t AS (SELECT doc_id, bit_xor(ascii(c)::BIGINT) AS x FROM p GROUP BY doc_id)
SELECT doc_id, '$' || hex(encode(coalesce(text, ''))) || '*' || lpad(lower(hex(coalesce(x, 0))), 2, '0') AS sentence, true AS ok FROM documents LEFT JOIN t USING (doc_id)""")
def nmea_xor(spark, d):
    """A sentence of each whole text, its body the text's bytes in hex."""
    body = F.hex(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    codes = F.transform(F.split(F.col("body"), ""), lambda c: F.ascii(c).cast("long"))
    total = F.aggregate(codes, F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    rows = table(spark, d, "documents").select("doc_id", body.alias("body"))
    sentence = F.concat(F.lit("$"), "body", F.lit("*"), F.lower(F.lpad(F.hex(total), 2, "0")))
    return rows.select("doc_id", sentence.alias("sentence")).withColumn("ok", upper.nmea_ok(F.col("sentence")))


@query("""WITH t AS (SELECT conv_id, role, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nx FROM conversations)
SELECT conv_id AS key, count(*) AS requests, count(*) FILTER (nx = 'assistant') AS followed FROM t WHERE role = 'user' GROUP BY conv_id""")
def duplex_follow(spark, d):
    return upper.follow_share(table(spark, d, "conversations").select(F.col("conv_id").alias("key"), "turn", "role"))


@query("""SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents""")
def text_lines(spark, d):
    return table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@query("""SELECT event_type AS bus, event_id AS tick, CASE WHEN event_id % 5 = 0 THEN user_id END AS pointer,
coalesce(last_value(CASE WHEN event_id % 5 = 0 THEN user_id END IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), -1) AS register
FROM (SELECT event_id, event_type, user_id FROM events)""".replace("CASE WHEN event_id % 5 = 0 THEN user_id END AS pointer", "CASE WHEN event_id % 5 = 0 THEN user_id ELSE -1 END AS pointer"))
def register_forward_fill(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("bus"), F.col("event_id").alias("tick"), F.when(F.col("event_id") % 5 == 0, F.col("user_id")).alias("pointer")
    )
    rows = upper.register_fill(rows)
    return rows.select("bus", "tick", F.coalesce("pointer", F.lit(-1)).alias("pointer"), F.coalesce("register", F.lit(-1)).alias("register"))


@query("""WITH c AS (SELECT user_id, event_type <> 'error' AS known, CASE WHEN event_type = 'click' THEN value > 1 END AS crc FROM events),
g AS (SELECT user_id, count(*) FILTER (known) AS known, count(*) AS total, count(*) FILTER (crc) AS crc_ok, count(*) FILTER (NOT crc) AS crc_bad FROM c GROUP BY user_id)
SELECT *, CASE WHEN crc_ok >= 2 AND crc_bad = 0 THEN 'identified' WHEN known >= 3 AND known >= 0.8 * total THEN 'consistent' ELSE 'address_only' END AS level FROM g""")
def device_evidence(spark, d):
    rows = table(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("known"), F.when(F.col("event_type") == "click", F.col("value") > 1).alias("crc"))
    return upper.device_evidence(rows, ["user_id"])
