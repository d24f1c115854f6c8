"""Command line: index, find, status, reset."""

from __future__ import annotations

import argparse
import json
from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import SparkSession

from .config import load_config
from .engine import Engine


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone")
    out.add_argument("--config")
    kinds = out.add_subparsers(dest="command", required=True)
    index = kinds.add_parser("index", help="index folders")
    index.add_argument("paths", nargs="+")
    index.add_argument("--max-items", type=int, help="index new files only, in slices of so many")
    index.add_argument("--max-tokens", type=int, default=1200)
    index.add_argument("--overlap", type=int, default=80)
    index.add_argument("--max-pdf-pages", type=int, default=50)
    index.add_argument("--allow", help="extensions, comma-separated")
    find = kinds.add_parser("find", help="search")
    find.add_argument("query")
    find.add_argument("--max-results", type=int, default=10)
    find.add_argument("--page", type=int, default=1)
    find.add_argument("--per-page", type=int, default=10)
    find.add_argument("--show-context", action="store_true", help="also print each hit with its snippet")
    find.add_argument("--case-sensitive", action="store_true")
    find.add_argument("--exact", action="store_true")
    kinds.add_parser("status", help="totals of the index")
    kinds.add_parser("reset", help="remove the index")
    return out


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> dict | int:
    said = parser().parse_args(arguments)
    settings = load_config(said.config)
    if said.command == "index":
        own = {"max_tokens": said.max_tokens, "overlap": said.overlap, "max_pdf_pages": said.max_pdf_pages}
        if said.allow:
            own["allow_exts"] = tuple(x.strip() for x in said.allow.split(","))
        settings = replace(settings, index=replace(settings.index, **own))
    engine = Engine(spark or SparkSession.builder.appName("lodestone").getOrCreate(), settings)
    if said.command == "index":
        out = {"slices": sum(engine.index_incremental(p, max_items=said.max_items) for p in said.paths)} if said.max_items else engine.index(said.paths)
    elif said.command == "find":
        out = engine.search(said.query, said.max_results, said.page, said.per_page, exact=said.exact, case_sensitive=said.case_sensitive)
        for at, hit in enumerate(out["items"] if said.show_context else [], (said.page - 1) * said.per_page + 1):
            print(f"{at}. {hit['path']} ({hit['score']:.3f})\n   {hit['snippet']}")
    elif said.command == "status":
        out = engine.status()
    else:
        engine.reset()
        out = {"reset": True}
    print(json.dumps(out, default=str, ensure_ascii=False))
    return out


if __name__ == "__main__":
    main()
