"""Command line: python -m plinth search BASE QUERY [--source vault] [-k 10] [filter=value ...] | status BASE | clean BASE [SOURCE]"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from plinth.api import SOURCES, Engine


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="plinth", description=__doc__)
    p.add_argument("action", choices=("search", "status", "clean"))
    p.add_argument("base")
    p.add_argument("rest", nargs="*")
    p.add_argument("--source", default="combined", choices=(*SOURCES, "combined"))
    p.add_argument("-k", type=int, default=10)
    a = p.parse_args(argv)
    engine = Engine(SparkSession.builder.appName("plinth").getOrCreate(), a.base)
    if a.action == "status":
        print(json.dumps(engine.status()))
    elif a.action == "clean":
        print(json.dumps(engine.clean(*a.rest[:1])))
    else:
        filters = dict(x.split("=", 1) for x in a.rest[1:])
        search = {"vault": engine.search_vault, "codebase": engine.search_codebase, "document": engine.search_documents, "combined": engine.search_combined}[a.source]
        page = search(a.rest[0], a.k, **filters)
        for row in page.orderBy("pos").collect() if page is not None else []:
            print(json.dumps({"id": row["id"], "path": row["path"], "score": row["score"]}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
