"""Command line: ``python -m netweave export|replay|query ...``."""

from __future__ import annotations

import argparse


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("netweave").getOrCreate()


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="netweave", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    export = commands.add_parser("export", help="log files to CSV with a header")
    export.add_argument("source")
    export.add_argument("target")
    export.add_argument("--type", default="CONN", choices=["CONN", "DNS", "HTTP", "SSL", "WEIRD"])
    replay = commands.add_parser("replay", help="append a log to a file line by line")
    replay.add_argument("source")
    replay.add_argument("target")
    replay.add_argument("-d", "--delay", type=float, default=10.0, help="milliseconds between lines")
    query = commands.add_parser("query", help="run a registered query and write or show its rows")
    query.add_argument("name")
    query.add_argument("tables", help="folder of the tables")
    query.add_argument("--out", help="Parquet folder for the result")
    given = parser.parse_args(argv)
    if given.command == "replay":
        from netweave.sources.tail import replay as run

        with open(given.source) as lines:
            run(lines, given.target, given.delay / 1000)
    elif given.command == "export":
        from netweave.sources.logs import read_lines, write_export

        write_export(read_lines(_session(), given.source), given.type, given.target)
    else:
        from netweave.plans.queries import QUERIES

        found = QUERIES[given.name](_session(), given.tables)
        found.write.parquet(given.out) if given.out else found.show(truncate=False)


if __name__ == "__main__":
    main()
