"""python -m lexiduct bootstrap --root DIR --source FILE [--csv COLUMN] [--project P]
[--version vN] [--parent vN] [--mode bootstrap|replace|merge|prune] [--stride N]"""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from lexiduct.config import Settings
from lexiduct.sources import readers
from lexiduct.sources.store import Store


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="lexiduct")
    sub = p.add_subparsers(dest="command", required=True)
    b = sub.add_parser("bootstrap", help="build a corpus as a new version")
    b.add_argument("--root", required=True)
    b.add_argument("--source", required=True, help="JSON array of strings, or a CSV file with --csv")
    b.add_argument("--csv", metavar="COLUMN")
    b.add_argument("--project", default="default")
    b.add_argument("--version", help="next available by default; an existing one is refused")
    b.add_argument("--parent", help="the current version by default, if --version isn't given")
    b.add_argument("--mode", default="bootstrap", choices=("bootstrap", "replace", "merge", "prune"), help="recorded in the manifest")
    b.add_argument("--stride", type=int, default=Settings().index_stride, help="an anchor every so many words; 0 for no skip index")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexiduct").getOrCreate()
    values = readers.read_csv_column(spark, a.source, a.csv) if a.csv else readers.read_json_array(spark, a.source)
    store = Store(spark, a.root, a.project)
    m = store.bootstrap(values, a.source, a.version, a.parent, a.mode, max(0, a.stride))
    anchors = store.skip_index(m.version).count() if a.stride > 0 else 0
    print(json.dumps(asdict(m) | {"anchors": anchors}))
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
