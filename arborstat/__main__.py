"""python -m arborstat list|run|table|archive: the registered queries from a command line."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Sequence

from .functions.identity import slug
from .operators.figures import resolve_names, text_table
from .operators.provenance import archive, drive, run_all
from .plans import analysis, catalogue, reporting
from .session import session
from .sources.bundle import write_csv

QUERIES = catalogue.queries() | reporting.queries() | analysis.queries()


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="arborstat", description=__doc__)
    verbs = out.add_subparsers(dest="verb", required=True)
    verbs.add_parser("list", help="the queries' names and what they give").add_argument("names", nargs="*", default=["*"])
    run = verbs.add_parser("run", help="run queries by name or glob and write a folder of CSV each")
    run.add_argument("names", nargs="+")
    run.add_argument("--data", required=True, help="folder of the tables")
    run.add_argument("--out", required=True, help="folder of the results")
    run.add_argument("--again", action="store_true", help="also those that have a result")
    run.add_argument("--budget", type=float, help="seconds after which no further query is begun")
    table = verbs.add_parser("table", help="print one query as text or LaTeX")
    table.add_argument("name")
    table.add_argument("--data", required=True)
    table.add_argument("--latex", action="store_true")
    moved = verbs.add_parser("archive", help="move folders under one date stamp")
    moved.add_argument("folders", nargs="+")
    moved.add_argument("--into", required=True)
    moved.add_argument("--stamp", default=time.strftime("%Y-%m-%d"))
    for verb in (run, table, moved):
        verb.add_argument("--master", help="Spark's master; the cluster's own where it is not given")
    return out


def exists(spark, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def main(words: Sequence[str] | None = None, spark=None) -> int:
    said = arguments().parse_args(words)
    if said.verb == "list":
        for name in resolve_names(said.names, list(QUERIES)):
            print(f"{name}\t{(QUERIES[name].__doc__ or '').strip().splitlines()[0] if QUERIES[name].__doc__ else ''}")
        return 0
    names = resolve_names(said.names, list(QUERIES)) if said.verb == "run" else resolve_names([said.name], list(QUERIES)) if said.verb == "table" else []
    spark = spark or session(said.master)
    if said.verb == "archive":
        print("\n".join(archive(spark, said.folders, said.into, said.stamp)))
        return 0
    if said.verb == "table":
        print(text_table(QUERIES[names[0]](spark, said.data), latex=said.latex))
        return 0
    began, failed = time.monotonic(), []

    def one(name: str) -> None:
        path = f"{said.out.rstrip('/')}/{slug(name)}"
        if not said.again and exists(spark, path):
            print(f"{name}\theld")
            return
        done = drive([{"name": name}], [{}], lambda name: QUERIES[name](spark, said.data), lambda df: {"written": write_csv(df, path, df.columns[:1])}, only_new=False)
        failed.extend(done.failed)
        print(f"{name}\t{done.failed[0][1] if done.failed else 'written' if done.done[0]['written'] else 'empty'}")

    # A query's cost is not known before it has run: what the budget sees is the time that is gone.
    run_all(names, one, said.budget, lambda _: 0.0 if said.budget is None or time.monotonic() - began <= said.budget else said.budget + 1)
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
