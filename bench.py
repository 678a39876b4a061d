"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

os.environ["PYTHONPATH"] = os.pathsep.join([os.path.dirname(os.path.abspath(__file__)), os.environ.get("PYTHONPATH", "")])

import numpy as np  # noqa: E402
import pyarrow as pa  # noqa: E402
import pyarrow.parquet as pq  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

from concord.config import CompareConfig  # noqa: E402
from concord.operators.compare import Comparison  # noqa: E402
from concord.plans import more  # noqa: E402, F401  registers its queries
from concord.plans.queries import QUERIES  # noqa: E402
from concord.sources.texts import open_source  # noqa: E402

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
HEADLINE = [
    "summary_totals", "column_mismatch_counts", "raw_differences", "dedup_first", "duplicate_audit", "rules_combined_summary", "pattern_classification",
    "value_pair_share", "key_status_index", "samples_top20", "revision_counters", "json_diff_props",
]


def written_pair(folder: str, rows: int, columns: int, share: float, changed, kind: str) -> list[str]:
    """A wide pair as files of text: 97 repeating values, the right side in another order. A share of the columns
    changes in the rows that changed() picks. Written by pyarrow and numpy, so that no engine work is timed here."""
    ids, order, paths = np.arange(rows), np.random.default_rng(1).permutation(rows), []
    for side in ("left", "right"):
        own = ids if side == "left" else ids[order]
        path = f"{folder}/{rows}x{columns}-{side}.{kind}"
        paths.append(path)
        if kind == "csv":  # as long as published: about 2.9 bytes a cell
            lines = [",".join(str((v * 7 + k) % 97) for k in range(columns)) for v in range(97)]
            with open(path, "w", encoding="utf-8") as f:
                f.write("key," + ",".join(f"c{k}" for k in range(columns)) + "\n")
                f.writelines(f"{i},{lines[i % 97]}\n" for i in own.tolist())
            continue
        os.makedirs(path)
        for part, at in enumerate(np.array_split(own, 8)):
            table = {"key": pa.array(at.astype(str))}
            for k in range(columns):
                end = "x" if side == "right" and k < share * columns else ""
                values = pa.array([f"{v * 1000 + k}" for v in range(97)] + [f"{v * 1000 + k}{end}" for v in range(97)])
                table[f"c{k}"] = pa.DictionaryArray.from_arrays(pa.array((at % 97 + 97 * changed(at)).astype(np.int32)), values).cast(pa.string())
            pq.write_table(pa.table(table), f"{path}/part-{part}.parquet")
    return paths


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["summary_totals"](spark, SF).collect()  # starts the JVM's compilers
    times = {}
    for q in HEADLINE:
        began = time.time()
        QUERIES[q](spark, SF).write.format("noop").mode("overwrite").save()
        times[q] = round(time.time() - began, 3)
        print(q, times[q], file=sys.stderr)
    wide = {
        "wide_100000x694": (100_000, 694, 1 / 694, lambda at: at % 10 == 0, "parquet"),
        "dense_2000x1780": (2_000, 1_780, 0.6, lambda at: at >= 0, "parquet"),
        "csv_100000x1780": (100_000, 1_780, 0, lambda at: at < 0, "csv"),
    }
    with tempfile.TemporaryDirectory(prefix="bench-") as folder:
        for name, (rows, columns, share, changed, kind) in wide.items():
            paths = written_pair(folder, rows, columns, share, changed, kind)
            began = time.time()
            s = Comparison(*[open_source(spark, p) for p in paths], CompareConfig(("key",))).summary.first()
            times[name] = round(time.time() - began, 3)
            print(name, times[name], file=sys.stderr)
            cells = {"wide": rows // 10, "dense": int(rows * columns * 0.6), "csv": 0}[name.partition("_")[0]]
            assert (s.matched_keys, s.changed_cells) == (rows, cells), s
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF}))


if __name__ == "__main__":
    main()
