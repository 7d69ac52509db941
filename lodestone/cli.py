"""Command line: init, update, status and search of one project."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession

from lodestone import __version__, render
from lodestone.errors import NavigationError
from lodestone.operators.fusion import rank_results
from lodestone.plans import indexing
from lodestone.plans.search import diagnostics
from lodestone.session import local_session, name_scratch


def search_rows(
    spark: SparkSession, root: str, request: dict, snippets: bool = False, **options
) -> tuple[list[dict], dict]:
    """Results of one request as dictionaries, and its diagnostics."""
    routes = indexing.search_project(spark, root, [request], snippets=snippets, **options)
    if routes is None:
        return [], {}
    results = []
    for row in rank_results(routes.candidates).orderBy("rank").collect():
        entry = row.asDict()
        entry["path"] = entry["display_path"]
        entry["score"] = round(entry["score"], 4)
        results.append(entry)
    found = diagnostics(routes).drop("qid").first()
    return results, found.asDict() if found else {}


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    parser.add_argument("--version", action="version", version=__version__)
    parser.add_argument("--root", default=".")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("init")
    commands.add_parser("update")
    commands.add_parser("status").add_argument("--json", action="store_true")
    search = commands.add_parser("search")
    search.add_argument("terms", nargs="+")
    search.add_argument("--top", type=int)
    search.add_argument("--path")
    for flag in ("--json", "--snippet", "--explain"):
        search.add_argument(flag, action="store_true")
    return parser


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        chosen = _parser().parse_args(arguments)
    except SystemExit as stop:
        return int(stop.code or 0)
    spark = spark or local_session()
    name_scratch(spark)
    try:
        if chosen.command in ("init", "update"):
            step = indexing.initialize if chosen.command == "init" else indexing.update
            print(json.dumps(asdict(step(spark, chosen.root))))
        elif chosen.command == "status":
            found = indexing.status(spark, chosen.root)
            print(json.dumps(found) + "\n" if chosen.json else render.status_text(found), end="")
        else:
            request = {"query": " ".join(chosen.terms), "query_parts": chosen.terms}
            request |= {k: v for k in ("top", "path") if (v := getattr(chosen, k)) is not None}
            results, facts = search_rows(spark, chosen.root, request, chosen.snippet)
            write = render.as_json if chosen.json else render.detailed
            print(write(results, chosen.explain, facts if chosen.explain else None), end="")
    except NavigationError as problem:
        print(f"{problem.code}: {problem}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
