"""``python -m cairn``: get, set, delete and measure a store from the command line."""

from __future__ import annotations

import argparse
import sys

from .operators.kv import parse_pair
from .operators.store import Store


def main(argv: list[str] | None = None, spark=None) -> int:
    parser = argparse.ArgumentParser(prog="python -m cairn", description=__doc__)
    parser.add_argument("--store", required=True, help="the store's folder")
    calls = parser.add_subparsers(dest="call", required=True)
    for name, what in (("get", "keys"), ("set", "pairs k=v"), ("del", "keys")):
        calls.add_parser(name).add_argument("items", nargs="+", help=what)
    calls.add_parser("metrics")
    asked = parser.parse_args(argv)
    try:
        pairs = list(map(parse_pair, asked.items)) if asked.call == "set" else []
    except ValueError as e:
        parser.error(str(e))
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.getOrCreate()
    store = Store(spark, asked.store)
    if asked.call == "get":
        for r in sorted(store.get(asked.items).collect()):
            print(f"key={r['key']} value={None if r['value'] is None else bytes(r['value']).decode('utf-8', 'replace')}")
    elif asked.call == "metrics":
        print(store.metrics())
    else:
        store.set(pairs) if asked.call == "set" else store.delete(asked.items)
        print("succ=True")
    return 0


if __name__ == "__main__":
    sys.exit(main())
