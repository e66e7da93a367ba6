"""Command line: python -m weft.cli <root> <rule> <ordering> [sink] [-mode 1|0] [-t N]

``root`` is a folder of ingested tables. ``-t`` is the number of local threads where no master is set; ``-mode`` is accepted and
means nothing.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import SparkSession

from .engine import Engine, configure, print_report
from .errors import RuleError
from .sources.catalog import Catalog


def parse_args(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="weft", description=__doc__)
    p.add_argument("root")
    p.add_argument("rule")
    p.add_argument("ordering")
    p.add_argument("sink", nargs="?", default="packed")
    p.add_argument("-mode", type=int, choices=(0, 1), default=1)
    p.add_argument("-t", dest="threads", type=int, default=None)
    out = p.parse_args(args)
    if out.threads is not None and out.threads < 1:
        p.error("-t must be 1 or more")
    return out


def main(args: list[str], spark: SparkSession | None = None) -> int:
    a = parse_args(args)
    if spark is None:
        builder = configure(SparkSession.builder.appName("weft"))
        if a.threads or "MASTER" not in os.environ:
            builder = builder.master(f"local[{a.threads or '*'}]")
        spark = builder.getOrCreate()
    try:
        report = Engine(Catalog(spark).add_ingested(a.root)).run(a.rule, a.ordering, a.sink)
    except RuleError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    print_report(report)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
