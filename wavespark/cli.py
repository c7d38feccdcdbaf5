"""Command line: python -m wavespark.cli survey|states|analyze|decode|convert PATH."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import functions as F

from wavespark.operators import sequence, stats
from wavespark.plans import search
from wavespark.protocols.decode import decode
from wavespark.session import session
from wavespark.sources import files


def _captures(path: str):
    rows = files.read_captures(session(), path)
    return rows, rows.where("tick IS NOT NULL").select("channel", "tick")


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="wavespark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("info", "survey", "states", "analyze"):
        sub.add_parser(name).add_argument("path")
    d = sub.add_parser("decode")
    d.add_argument("path")
    d.add_argument("protocol", choices=sorted(search.ANALYZERS))
    d.add_argument("roles", nargs="+", help="role=channel")
    c = sub.add_parser("convert")
    c.add_argument("path")
    c.add_argument("out")
    a = p.parse_args(argv)
    rows, edges = _captures(a.path)
    end = (rows.agg(F.max("tick")).first()[0] or 0) + 1
    if a.command == "info":
        found = rows.groupBy("channel", "tick_hz").agg(F.count("tick").alias("edges"))
    elif a.command == "survey":
        found = stats.line_features(edges, 0, end)
    elif a.command == "states":
        found = sequence.line_states(edges, 0, end)
    elif a.command == "analyze":
        print(json.dumps(search.analyze(rows.select("channel", "tick", "initial")), indent=1))
        return 0
    elif a.command == "decode":
        roles = dict(r.split("=", 1) for r in a.roles)
        named = F.coalesce(*(F.when(F.col("channel") == c, F.lit(r)) for r, c in roles.items()))
        found = decode(rows.select(F.lit("bus").alias("bus"), named.alias("role"), "tick", "initial").where("role IS NOT NULL"), search.ANALYZERS[a.protocol][1])
    else:
        files.write_vcd(edges, a.out, rows.first()["tick_hz"])
        return 0
    for r in found.toJSON().toLocalIterator():
        print(r)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
