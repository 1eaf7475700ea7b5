"""Commands: python -m cinegraph load ROOT FOLDER, python -m cinegraph clean FOLDER TARGET."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from cinegraph.schemas import TABLES
from cinegraph.sources.fetch import fetch_all
from cinegraph.sources.layout import BUCKETS
from cinegraph.sources.load import ASIDE, REFUSE, Store
from cinegraph.sources.tsv import clean, read_tsv, write_tsv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="cinegraph")
    commands = p.add_subparsers(dest="command", required=True)
    load = commands.add_parser("load", help="load or refresh the tables below ROOT from the dumps in FOLDER")
    load.add_argument("root")
    load.add_argument("folder")
    load.add_argument("--from", dest="url", help="where the dumps are published: those that are newer there are fetched to FOLDER first")
    load.add_argument("--buckets", type=int, default=BUCKETS, help="of each table of a new store: a bucket should fit one task")
    load.add_argument("--mode", choices=("init", "update"), default="update")
    load.add_argument("--minimal", action="store_true", help="the dumps that clean --minimal made")
    load.add_argument("--orphans", choices=(REFUSE, ASIDE), default=REFUSE, help="rows without their parents: fail, or set them aside")
    tidy = commands.add_parser("clean", help="clean the dumps in FOLDER and write them below TARGET")
    tidy.add_argument("folder")
    tidy.add_argument("target")
    tidy.add_argument("--minimal", action="store_true", help="movies only")
    tidy.add_argument("--with-tv-episodes", action="store_true")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    spark = spark or SparkSession.builder.appName("cinegraph").getOrCreate()
    if a.command == "load":
        if a.url:
            fetch_all(spark, a.url, a.folder, a.minimal)
        store = Store(spark, a.root, a.buckets)
        done = store.load_all(a.folder, a.mode, a.minimal, a.orphans)
        for row in store.counts().collect():
            print(row["table"], row["n"], "loaded" if done[row["table"]] else "unchanged")
    else:
        tables = clean({t: read_tsv(spark, f"{a.folder}/{t.replace('_', '.')}.tsv.gz", t) for t in TABLES}, a.with_tv_episodes, a.minimal)
        for t, df in tables.items():
            write_tsv(df, f"{a.target}/{t.replace('_', '.')}{'.minimal' if a.minimal else ''}.tsv.gz")


if __name__ == "__main__":
    main()
