"""Commands: index a catalogue, evaluate labelled queries, search, serve."""

from __future__ import annotations

import argparse
import json
import os
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .operators import evaluate
from .plans import index as index_plan
from .plans.config import Config
from .plans.search import search
from .plans.service import Discovery
from .plans.strategies import clients_for, steps_for
from .server import serve
from .sources.catalogs import FileSource, MultiSource, RegistrySource, RepositorySource, load_golden

SOURCES = {"file": FileSource, "registry": RegistrySource, "github": RepositorySource}


def sources(config: Config, paths: dict[str, str]) -> MultiSource:
    """The sources that the settings name, each with its path or its address; unknown names and missing paths are errors.

    A repository source may have the path of its server descriptions after ``::``.
    """
    unknown = [s for s in config.sources if s not in SOURCES]
    if unknown:
        raise ValueError(f"unknown source: {', '.join(unknown)}")
    missing = [s for s in config.sources if not paths.get(s)]
    if missing:
        raise ValueError(f"no path for source: {', '.join(missing)}")
    return MultiSource([SOURCES[s](*paths[s].split("::", 1)) if s == "github" else SOURCES[s](paths[s]) for s in config.sources])


def run_index(spark: SparkSession, config: Config, paths: dict[str, str], out: str, limit: int = 0, previous: str | None = None, as_of: str | None = None) -> None:
    now = as_of or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    new = index_plan.build(sources(config, paths).fetch(spark, limit), config, now, steps_for(config, clients_for(config)))
    if previous:
        new = index_plan.refresh(index_plan.Index.load(spark, previous, config.embed_dim), new, config.index_prune)
    new.save(out)


def run_eval(spark: SparkSession, config: Config, index: str | None, golden: str, k: int = 5, fails: bool = False, fixtures: str | None = None) -> str:
    """The scorecard; with ``fails`` also the queries without a relevant result.

    With ``fixtures``, a catalogue file, that is indexed first: into ``index`` if
    there is one too, else for this run alone.
    """
    if not (index or fixtures):
        raise ValueError("an index or a catalogue is needed")
    if fixtures and index:
        run_index(spark, replace(config, source="file"), {"file": fixtures}, index)
    if index:
        held = index_plan.Index.load(spark, index, config.embed_dim)
    else:
        held = index_plan.build(FileSource(fixtures).fetch(spark), config, datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ"), steps_for(config, clients_for(config)))
    labelled = load_golden(spark, golden).persist()
    asked = labelled.select("qid", "query", F.lit(k).alias("top_k"), F.lit(0.0).alias("min_score"), F.array().cast("array<string>").alias("categories"), F.lit("").alias("source"))
    ranked = search(asked, held, config, clients=clients_for(config)).select("qid", "rank", "id").persist()
    rows = evaluate.per_query(labelled, ranked, k)
    lines = [evaluate.scorecard(evaluate.report(rows).first(), k)]
    if fails:
        lines += [f"{r['query']}: {', '.join(r['returned'])}" for r in evaluate.misses(labelled, rows, ranked).collect()]
    return "\n".join(lines)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("index")
    one.add_argument("--out", required=True)
    one.add_argument("--limit", type=int, default=0)
    one.add_argument("--previous")
    one.add_argument("--path", action="append", default=[], metavar="SOURCE=PATH")
    two = commands.add_parser("eval")
    two.add_argument("--index")
    two.add_argument("--fixtures", help="a catalogue file to index first")
    two.add_argument("--golden", required=True)
    two.add_argument("-k", type=int, default=5)
    two.add_argument("--fails", action="store_true")
    three = commands.add_parser("search")
    three.add_argument("--index", required=True)
    three.add_argument("query")
    three.add_argument("-k", type=int, default=5)
    four = commands.add_parser("serve")
    four.add_argument("--index", required=True)
    args = parser.parse_args(argv)
    config, spark = Config.read(os.environ), SparkSession.builder.getOrCreate()
    if args.command == "index":
        run_index(spark, config, dict(p.split("=", 1) for p in args.path), args.out, args.limit, args.previous)
    elif args.command == "eval":
        print(run_eval(spark, config, args.index, args.golden, args.k, args.fails, args.fixtures))
    else:
        discovery = Discovery(spark, index_plan.Index.load(spark, args.index, config.embed_dim).persist(), config, clients=clients_for(config))
        if args.command == "search":
            print(json.dumps(discovery.search(args.query, args.k), indent=1, ensure_ascii=False))
            return
        server = serve(discovery, config.http_addr)
        try:
            server.serve_forever()
        except KeyboardInterrupt:
            pass
        finally:
            server.server_close()
            discovery.close()


if __name__ == "__main__":
    main()
