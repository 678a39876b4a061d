"""A comparison judged anew with other rules and exclusions, from its kept evidence instead of its sources."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CompareConfig
from ..functions.texts import shown
from ..sources.source import listed
from ..sources.texts import fingerprint
from .compare import Comparison


@dataclass(frozen=True)
class Evidence:
    """What a comparison leaves behind: unequal cells before acceptance, and which keys it saw."""

    raw_differences: DataFrame
    matched_keys: DataFrame
    left_only: DataFrame
    right_only: DataFrame


def contained(small: DataFrame, large: DataFrame) -> bool:
    """Whether every key_json of one table is in another."""
    return small.select("key_json").join(large.select("key_json"), "key_json", "left_anti").isEmpty()


def excluded_keys(spark: SparkSession, config: CompareConfig, more: DataFrame | None = None) -> DataFrame:
    """(key_json) of a configuration's containers and of a table of further keys, each once."""
    rows = [(list(k),) for x in config.containers for k in x.keys]
    own = listed(spark, rows, k="array<string>").select(F.to_json("k").alias("key_json"))
    return (own if more is None else own.union(more.select("key_json"))).distinct()


def sources_changed(spark: SparkSession, folder: str) -> bool:
    """Whether files of the sources have come, gone or changed in size or time since their evidence was stored below the folder."""
    stored = spark.read.parquet(f"{folder}/sources")
    names = [r.source for r in stored.select("source").distinct().collect()]  # two at most
    now = reduce(DataFrame.union, [fingerprint(spark, p).withColumn("source", F.lit(p)) for p in names])
    return not (now.exceptAll(stored).isEmpty() and stored.exceptAll(now).isEmpty())


def plan(before: CompareConfig, after: CompareConfig, kept: bool = True, tables: tuple[DataFrame | None, DataFrame | None] = (None, None), changed: bool = False) -> tuple[str, str]:
    """('review', '') if the evidence is enough for the new settings, else ('full', why). tables: further excluded keys
    (key_json) before and after, of any number; they are compared by a join. changed: what sources_changed() says."""
    if changed:
        return "full", "a source changed"
    if not kept:
        return "full", "no evidence was kept"
    if before.keys != after.keys:
        return "full", "the keys changed"
    if before.duplicate_policy != after.duplicate_policy:
        return "full", "the duplicate policy changed"
    if not set(before.ignored_columns) <= set(after.ignored_columns):
        return "full", "an ignored column came back"
    keys = [{k for c in config.containers for k in c.keys} for config in (before, after)]
    given = [t for t in tables if t is not None]
    if not (contained(*[excluded_keys(given[0].sparkSession, c, t) for c, t in zip((before, after), tables, strict=True)]) if given else keys[0] <= keys[1]):
        return "full", "an excluded key came back"
    return "review", ""


def keep(c: Comparison, folder: str) -> Evidence:
    """Stores a comparison below the folder: what revise() and reports need, without the sources or comparing again."""
    c.store(folder)
    return Evidence(c.raw_differences, c.matched_keys, c.left_only, c.right_only)


@dataclass(frozen=True)
class Revision:
    """judged: the cells still in question, with what accepts them; excluded: evidence that newly excluded keys took away,
    (key_json, part); counters, rows: one row each. A newly excluded key counts as one excluded row of each side that has it; its
    duplicates stay counted as skipped."""

    judged: DataFrame
    left_only: DataFrame
    right_only: DataFrame
    matched_keys: DataFrame
    excluded: DataFrame
    counters: DataFrame
    rows: DataFrame

    @property
    def accepted(self) -> DataFrame:
        """Cells that an override or a rule accepts, as shown."""
        return self._shown("accepted is not null", "accepted")

    @property
    def differences(self) -> DataFrame:
        return self._shown("accepted is null")

    def _shown(self, which: str, *more: str) -> DataFrame:
        return self.judged.where(which).select("key_json", "column", *[shown(F.col(f"{s}_value")).alias(f"{s}_value") for s in ("left", "right")], *more)


def revise(c: Comparison, evidence: Evidence, config: CompareConfig, exclusions: DataFrame | None = None) -> Revision:
    """Columns newly ignored and keys newly excluded go, those of a table (key_json) as well; the rest is judged by config."""
    gone = excluded_keys(c.spark, config, exclusions)
    left = lambda df: df.join(gone, "key_json", "left_anti")
    raw = left(evidence.raw_differences.where(~F.col("column").isin(list(config.ignored_columns))) if config.ignored_columns else evidence.raw_differences)
    judged = c.judged(raw, config)
    parts = {"matched_keys": evidence.matched_keys, "left_only": evidence.left_only, "right_only": evidence.right_only}
    kept = {name: left(df) for name, df in parts.items()}
    excluded = reduce(DataFrame.union, [df.join(gone, "key_json", "left_semi").select("key_json", F.lit(name).alias("part")) for name, df in parts.items()])
    count = lambda df, name: df.agg(F.count("*").alias(name))
    per = judged.groupBy("key_json").agg(F.count_if(F.col("accepted").isNull()).alias("n"), F.count("*").alias("raw"))
    out = per.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw_cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("changed_cells"), F.count_if(F.col("n") > 0).alias("changed_rows"))
    for df, name in ((evidence.raw_differences, "original_cells"), *((df, name) for name, df in kept.items())):
        out = out.crossJoin(count(df, name))  # one row each
    counters = out.select(
        "original_cells", "raw_cells", (F.col("raw_cells") - F.col("changed_cells")).alias("accepted_cells"), (F.col("original_cells") - F.col("raw_cells")).alias("filtered_cells"),
        "changed_cells", "changed_rows", (F.col("matched_keys") - F.col("changed_rows")).alias("equal_rows"), "matched_keys", "left_only", "right_only",
    )
    before = c.joined.agg(*[F.coalesce(F.sum(F.when(F.col("gone"), F.col(n))), F.lit(0)).alias(f"{s}_before") for s, n in (("left", "ln"), ("right", "rn"))])
    more = excluded.agg(*[F.count_if(F.col("part").isin("matched_keys", f"{s}_only")).alias(f"{s}_more") for s in ("left", "right")])
    compared = kept["matched_keys"].agg(F.count("*").alias("m")).crossJoin(kept["left_only"].agg(F.count("*").alias("l"))).crossJoin(kept["right_only"].agg(F.count("*").alias("r")))
    rows = before.crossJoin(more).crossJoin(compared).select(  # one row each
        *[(F.col(f"{s}_before") + F.col(f"{s}_more")).alias(f"{s}_excluded_rows") for s in ("left", "right")],
        (F.col("m") + F.col("l")).alias("left_compared_rows"), (F.col("m") + F.col("r")).alias("right_compared_rows"),
    )
    return Revision(judged, kept["left_only"], kept["right_only"], kept["matched_keys"], excluded, counters, rows)
