"""python -m concord.cli LEFT RIGHT --keys a,b --output DIR, or of two JSON files or folders of them, then without keys.
Exit 0: identical, 1: differences, 2: error."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from .config import CompareConfig, ConfigError, Container, Override, Rule, parse_keys
from .operators import jsondiff
from .operators.compare import Comparison
from .sinks.results import export_html, save, write_csv, write_results
from .sources.documents import document_pairs
from .sources.texts import open_source


def documents(spark: SparkSession, left: str, right: str, rules: list[dict], output: str) -> int:
    """Writes the differences of documents as differences.csv, by name, and returns whether there are any."""
    pairs = document_pairs(spark, left, right)
    found = jsondiff.diff_documents(pairs, "name", "a", "b", [jsondiff.ArrayRule(**r) for r in rules])
    found.write.mode("overwrite").parquet(f"{output}/evidence")
    stored = spark.read.schema(found.schema).parquet(f"{output}/evidence")
    write_csv(stored, f"{output}/differences.csv", "name", "left_path", "right_path")
    return int(not stored.isEmpty())


def _told(e: Exception, c: Comparison | None) -> str:
    """An error as the user sees it; of an empty key part, the record it is in."""
    if c is not None and "a key part is empty" in str(e):
        first = c.first_empty_keys.orderBy("side").first()
        return f"{first.side}: record {first.record}: empty key component"
    return str(e)[:500]


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="concord", description=__doc__)
    p.add_argument("left")
    p.add_argument("right")
    p.add_argument("--keys", default="", help="comma-separated key columns")
    p.add_argument("--output", required=True)
    p.add_argument("--duplicate-policy", choices=("first", "last"), default="first")
    p.add_argument("--allow-empty-keys", action="store_true")
    p.add_argument("--ignore-columns", default="")
    p.add_argument("--ignore-keys", default="", help="keys to leave out, or @file")
    p.add_argument("--value-overrides", default="", help="JSON list of {column, left, right}, or @file")
    p.add_argument("--rules", default="", help="JSON list of {column, trim, ignore_case, tolerance, left_date_format, right_date_format}, or @file")
    p.add_argument("--headers", default="", help="JSON list of two lists of header names, by position, or @file")
    p.add_argument("--arrays", default="", help="JSON documents: JSON list of {path, mode, field}, or @file")
    p.add_argument("--html", action="store_true", help="a page of the results, report.html, beside them")
    p.add_argument("--delimiter", default=",")
    p.add_argument("--encoding", default="UTF-8")
    a = p.parse_args(argv)
    given = lambda x: Path(x[1:]).read_text(encoding="utf-8") if x.startswith("@") else x
    c = None
    try:
        spark = SparkSession.builder.appName("concord").getOrCreate()
        if not a.keys:
            return documents(spark, a.left, a.right, json.loads(given(a.arrays) or "[]"), a.output)
        keys = tuple(a.keys.split(","))
        excluded = parse_keys(given(a.ignore_keys), len(keys))
        overrides = tuple(Override(**o) for o in json.loads(given(a.value_overrides) or "[]"))
        rules = tuple(Rule(**r) for r in json.loads(given(a.rules) or "[]"))
        layout = json.loads(given(a.headers) or "null")
        layout = layout and (tuple(layout[0]), tuple(layout[1]))
        config = CompareConfig(keys, tuple(filter(None, a.ignore_columns.split(","))), a.duplicate_policy, a.allow_empty_keys, rules, overrides, (Container("Manual keys", excluded),) if excluded else (), layout)
        sides = [open_source(spark, x, **({"delimiter": a.delimiter, "encoding": a.encoding} if x.endswith(".csv") else {})) for x in (a.left, a.right)]
        c = Comparison(*sides, config)
        s = write_results(c, a.output)
        if a.html:
            save(f"{a.output if ':' in a.output else Path(a.output).absolute()}/report.html", export_html(c).encode("utf-8", "replace"))
        return int(bool(s["changed_cells"] or s["left_only"] or s["right_only"]))
    except (ConfigError, ValueError, TypeError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2
    except Exception as e:  # Spark's own
        print(f"error: {_told(e, c)}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
