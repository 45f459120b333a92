"""Command line: ``python -m reagentql list`` and ``python -m reagentql run QUERY --tables DIR``."""

from __future__ import annotations

import argparse

from reagentql.plans import catalog
from reagentql.session import session


def main(arguments: list[str] | None = None) -> None:
    """Names all queries, or runs one over the tables of a folder and shows its rows or writes them."""
    parser = argparse.ArgumentParser(prog="reagentql", description=main.__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list", help="name all queries")
    run = commands.add_parser("run", help="run a query")
    run.add_argument("query", choices=sorted(catalog.queries()), metavar="QUERY")
    run.add_argument("--tables", required=True, help="folder of the Parquet tables")
    run.add_argument("--out", help="folder to write; without it 20 rows are shown")
    run.add_argument("--format", choices=("parquet", "json", "csv"), default="parquet")
    run.add_argument("--master", help="Spark master; the submitter's if not given")
    given = parser.parse_args(arguments)
    if given.command == "list":
        print("\n".join(sorted(catalog.queries())))
        return
    rows = catalog.queries()[given.query](session(given.master), given.tables)
    if given.out:
        rows.write.format(given.format).option("header", True).save(given.out)
    else:
        rows.show(truncate=False)


if __name__ == "__main__":
    main()
