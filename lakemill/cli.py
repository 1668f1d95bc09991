"""python -m lakemill compact | table-compact | scan | info"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from lakemill.plans.compact import FileCompactor, compact_table
from lakemill.plans.table import LakeTable


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lakemill")
    sub = p.add_subparsers(dest="command", required=True)
    c = sub.add_parser("compact", help="compact loose files of one prefix")
    c.add_argument("root")
    c.add_argument("prefix")
    c.add_argument("--start", type=int, help="epoch seconds, exclusive")
    c.add_argument("--end", type=int, help="epoch seconds, inclusive")
    c.add_argument("--target-mb", type=int, default=100)
    c.add_argument("--dedup", action="store_true")
    c.add_argument("--delete", action="store_true")
    c.add_argument("--codec", default="snappy")
    c.add_argument("--plan", action="store_true", help="say what would be done")
    t = sub.add_parser("table-compact", help="compact a table's partitions of many files")
    t.add_argument("location")
    t.add_argument("--min-files", type=int, default=5)
    t.add_argument("--target-mb", type=int, default=100)
    t.add_argument("--dedup", action="store_true")
    s = sub.add_parser("scan", help="print rows of a table as JSON lines")
    s.add_argument("location")
    s.add_argument("--filter", action="append", default=[])
    s.add_argument("--columns")
    s.add_argument("--limit", type=int, default=100)
    s.add_argument("--snapshot-id", type=int)
    i = sub.add_parser("info", help="print a table's metadata")
    i.add_argument("location")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "compact":
        if a.start is not None and a.end is not None and a.start >= a.end:
            print("--start must be before --end", file=sys.stderr)
            return 2
        job = FileCompactor(spark, a.root, a.prefix, a.start and a.start * 1000, a.end and a.end * 1000, a.target_mb << 20, a.dedup, a.delete, a.codec)
        r = job.plan() if a.plan else job.run()
        print(json.dumps(vars(r) | {"bytes_saved": r.bytes_saved}))
    elif a.command == "table-compact":
        print(json.dumps(vars(compact_table(LakeTable(spark, a.location), a.min_files, a.target_mb << 20, a.dedup))))
    elif a.command == "scan":
        df = LakeTable(spark, a.location).scan(a.columns.split(",") if a.columns else None, a.filter, snapshot_id=a.snapshot_id, limit=a.limit)
        for line in df.toJSON().toLocalIterator():
            print(line)
    else:
        print(json.dumps(LakeTable(spark, a.location).info(), indent=1))
    return 0
