"""python -m quernstone: answer requests over a file of profiles."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from quernstone.config import Config


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="quernstone", description=__doc__)
    p.add_argument("-q", "--query", action="append", default=[], help="a request; may be given several times")
    p.add_argument("--benchmark", action="store_true", help="the twelve benchmark requests")
    p.add_argument("--data", default="data/companies.jsonl")
    p.add_argument("--limit", type=int, default=20, help="rows shown of each request")
    p.add_argument("--shortlist", type=int, help="rows that are adjudicated, whatever the request's class")
    p.add_argument("--explain", action="store_true", help="print the plan of the ranking")
    p.add_argument("--no-escalate", action="store_true")
    p.add_argument("--warm", action="store_true", help="only read, merge and embed")
    p.add_argument("--rebuild", action="store_true", help="embed every profile again")
    p.add_argument("--no-cache", action="store_true", help="neither read nor keep embeddings")
    p.add_argument("--cache", default=".cache/embeddings", help="folder that keeps embeddings")
    p.add_argument("--parallel", type=int, default=2, help="kept for the sake of scripts: all requests are one plan")
    p.add_argument("--save", nargs="?", const="results", help="folder for the results as JSON and Markdown; with --benchmark always, results by default")
    p.add_argument("--markdown", help="file for a report")
    a = p.parse_args(args)
    if not (a.query or a.benchmark or a.warm):
        p.print_usage(sys.stderr)
        return 2

    from pyspark.sql import SparkSession

    from quernstone.plans import benchmark, corpus
    from quernstone.sources import sinks

    spark = SparkSession.builder.appName("quernstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = Config(escalate=not a.no_escalate)
    if a.shortlist:
        config = replace(config, shortlist={k: a.shortlist for k in config.shortlist}, default_shortlist=a.shortlist)
    try:
        engine = corpus.engine(corpus.load(spark, a.data), config=config, store=None if a.no_cache else a.cache, rebuild=a.rebuild)
        if a.warm:
            print(f"{engine.companies.count()} profiles")
            return 0
        a.save = a.save or ("results" if a.benchmark else None)
        rows = [(f"u{k:02d}", q) for k, q in enumerate(a.query, 1)] + [(q, t) for q, _, t in benchmark.QUERIES if a.benchmark]
        ranked = corpus.answer(engine, spark.createDataFrame(rows, "query_id string, text string"))
        if a.explain:
            ranked.explain("formatted")
        print(sinks.console(ranked, a.limit))
        if a.save:
            sinks.write_json(ranked, f"{a.save}/results.json")
            with open(f"{a.save}/results.md", "w") as f:
                f.write(sinks.markdown(ranked))
        if a.markdown:
            with open(a.markdown, "w") as f:
                f.write(sinks.markdown(ranked))
    except KeyboardInterrupt:
        return 130
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
