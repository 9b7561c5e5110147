"""A shell: ``python -m quarry FOLDER [-c STATEMENT | -f FILE | --open-only]``, or statements from standard input."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from quarry.session import Session
from quarry.sql.errors import CatalogError, SQLError
from quarry.sql.lexer import split_statements


def run(session: Session, statement: str) -> bool:
    try:
        sys.stdout.write(session.execute(statement))
        sys.stdout.flush()
        return True
    except (SQLError, CatalogError) as e:
        print(e, file=sys.stderr)
        return False


def shell(session: Session) -> None:
    text = ""
    while True:
        if sys.stdin.isatty():
            print("...> " if text else "sql> ", end="", flush=True)
        line = sys.stdin.readline()
        done, text = split_statements(text + line)
        for s in done:
            run(session, s)
        if not line:
            if text:
                run(session, text)
            return
        text += "\n" if text else ""


def main(arguments: list[str] | None = None) -> int:
    """0 if every statement of -c or -f succeeded, 1 at the first that fails."""
    p = argparse.ArgumentParser(prog="quarry", description=__doc__)
    p.add_argument("folder")
    what = p.add_mutually_exclusive_group()
    what.add_argument("-c", "--command")
    what.add_argument("-f", "--file")
    what.add_argument("--open-only", action="store_true")
    a = p.parse_args(arguments)
    spark = SparkSession.builder.appName("quarry").config("spark.ui.enabled", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    with Session(spark, a.folder) as session:
        if a.open_only:
            return 0
        if a.command is None and a.file is None:
            shell(session)
            return 0
        if a.file is not None:
            with open(a.file, encoding="utf-8") as f:
                text = f.read()
        else:
            text = a.command
        done, rest = split_statements(text)
        return 0 if all(run(session, s) for s in [*done, *([rest] if rest else [])]) else 1


if __name__ == "__main__":
    sys.exit(main())
