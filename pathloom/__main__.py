"""python -m pathloom play -D folder: statements from the terminal (or a pipe), results as tables."""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator

from pyspark.sql import Row

from pathloom.lang.errors import GraphError
from pathloom.lang.parser import parse


def shown(value: object) -> str:
    """Elements as VERTEX(id) and EDGE(src, dst), null as NULL."""
    if isinstance(value, Row) and "labels" in value.asDict():
        d = value.asDict()
        return f"EDGE({d['src']}, {d['dst']})" if "src" in d else f"VERTEX({d['id']})"
    return "NULL" if value is None else str(value)


def table(names: list[str], rows: list[list[str]]) -> str:
    widths = [max(map(len, column)) for column in zip(names, *rows)]
    line = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    body = ["|" + "|".join(f" {x:<{w}} " for x, w in zip(r, widths)) + "|" for r in [names, *rows]]
    return "\n".join([line, body[0], line, *body[1:], line])


def statements(lines: Iterator[str]) -> Iterator[str]:
    """Texts up to a semicolon at a line's end."""
    held = ""
    for line in lines:
        held += line
        if held.rstrip().endswith(";"):
            yield held
            held = ""
    if held.strip():
        yield held


def main(args: list[str]) -> int:
    parser = argparse.ArgumentParser(prog="pathloom")
    play = parser.add_subparsers(dest="command", required=True).add_parser("play", help="run statements")
    play.add_argument("-D", "--directory", required=True, help="folder of the stored graphs")
    play.add_argument("--limit", type=int, default=1000, help="rows shown of a result")
    options = parser.parse_args(args)
    from pyspark.sql import SparkSession

    from pathloom.session import Session

    spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session = Session(spark, options.directory)
    status = 0
    for text in statements(iter(sys.stdin.readline, "")):
        try:
            for n in parse(text):
                df = session.run(n, [])
                if df.columns != ["result"]:
                    rows = df.limit(options.limit).collect()
                    print(table(df.columns, [[shown(v) for v in r] for r in rows]))
                print("ok")
        except GraphError as e:
            status = 1
            print(f"error: {e}")
    return status


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
