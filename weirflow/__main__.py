"""``python -m weirflow run CONFIG --zh PATH --en PATH`` runs the stages over raw JSON lines;
``python -m weirflow query NAME FOLDER [--out PATH]`` one registered query over a folder of
Parquet tables."""

from __future__ import annotations

import argparse
import json


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    from weirflow.config import CorpusConfig
    from weirflow.plans import registry
    from weirflow.plans.pipeline import Pipeline
    from weirflow.session import clear_folders, ship
    from weirflow.sources.jsonl import read_raw

    ask = argparse.ArgumentParser(prog="weirflow")
    what = ask.add_subparsers(dest="what", required=True)
    run = what.add_parser("run")
    run.add_argument("config")
    run.add_argument("--zh", required=True)
    run.add_argument("--en", required=True)
    run.add_argument("--first", type=int, default=0)
    run.add_argument("--last", type=int, default=6)
    run.add_argument("--again", action="store_true", help="run complete stages again")
    one = what.add_parser("query")
    one.add_argument("name", choices=sorted(registry.queries()))
    one.add_argument("folder")
    one.add_argument("--out")
    told = ask.parse_args(argv)
    spark = SparkSession.builder.appName("weirflow").getOrCreate()
    ship(spark)
    if told.what == "run":
        pipeline = Pipeline(spark, read_raw(spark, told.zh, "chinese"), read_raw(spark, told.en, "english"), CorpusConfig.load(told.config))
        print(json.dumps(pipeline.run(told.first, told.last, resume=not told.again), ensure_ascii=False))
    else:
        out = registry.queries()[told.name](spark, told.folder)
        out.write.mode("overwrite").parquet(told.out) if told.out else out.show(50, truncate=False)
    clear_folders()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
