"""Analyses of unequal cells: patterns, pairs, rates, bands, samples, pages, key status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import numeric_difference, pattern, percent, percent_text, shortened  # noqa: F401
from .compare import Comparison


def patterns(differences: DataFrame) -> DataFrame:
    """differences with the kind of change."""
    return differences.withColumn("pattern", pattern(F.col("left_value"), F.col("right_value")))


def pattern_counts(differences: DataFrame) -> DataFrame:
    """(column, pattern, left_value, right_value, occurrences). Each pair of values is classified once."""
    pairs = differences.groupBy("column", "left_value", "right_value").agg(F.count("*").alias("occurrences"))
    return patterns(pairs).select("column", "pattern", "left_value", "right_value", "occurrences")


def pattern_totals(differences: DataFrame) -> DataFrame:
    return pattern_counts(differences).groupBy("pattern").agg(F.sum("occurrences").alias("occurrences"))


def patterns_by_column(differences: DataFrame) -> DataFrame:
    """(column, pattern, occurrences)."""
    return pattern_counts(differences).groupBy("column", "pattern").agg(F.sum("occurrences").alias("occurrences"))


def pattern_page(differences: DataFrame, column: str | None = None, offset: int = 0, rows: int = 50) -> DataFrame:
    """A page of pattern_counts(), the most frequent first, with the number of all (total)."""
    own = differences if column is None else differences.where(F.col("column") == column)
    counts = pattern_counts(own).withColumns({f"{s}_hash": F.sha2(f"{s}_value", 256) for s in ("left", "right")})
    ranked = counts.orderBy(F.desc("occurrences"), "column", "pattern", "left_hash", "right_hash").offset(offset).limit(rows)
    return ranked.crossJoin(F.broadcast(counts.agg(F.count("*").alias("total"))))  # one row


def ranked_examples(differences: DataFrame, n: int = 3) -> DataFrame:
    """examples() with the occurrences of their column and pattern, by which reports order them."""
    return examples(differences, n).join(F.broadcast(patterns_by_column(differences)), ["column", "pattern"])  # seven rows a column at most


def pair_counts(differences: DataFrame) -> DataFrame:
    """(column, left_value, right_value, occurrences, share in percent of the column's)."""
    counts = differences.groupBy("column", "left_value", "right_value").agg(F.count("*").alias("occurrences"))
    totals = differences.groupBy("column").agg(F.count("*").alias("of_column"))
    return counts.join(F.broadcast(totals), "column").select("column", "left_value", "right_value", "occurrences", percent(F.col("occurrences"), F.col("of_column")).alias("share"))


def top_pairs(differences: DataFrame, n: int = 20) -> DataFrame:
    """(column, place, pattern, left_value, right_value, occurrences, share, pairs): each column's n most frequent pairs of values, ties by the
    values' hashes, with its number of distinct pairs."""
    counts = pattern_counts(differences)
    totals = counts.groupBy("column").agg(F.count("*").alias("pairs"), F.sum("occurrences").alias("all"))
    ties = [F.sha2(F.col(f"{s}_value"), 256) for s in ("left", "right")]
    # A rank alone, so that each task keeps n pairs of a column before they are dealt by it.
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("occurrences"), *ties))).where(F.col("place") <= n)
    rows = top.join(F.broadcast(totals), "column")  # a row for each column
    return rows.select("column", "place", "pattern", "left_value", "right_value", "occurrences", percent(F.col("occurrences"), F.col("all")).alias("share"), "pairs")


def changed_cells_per_key(differences: DataFrame) -> DataFrame:
    return differences.groupBy("key_json").agg(F.count("*").alias("changed_cells"))


def key_status(c: Comparison) -> DataFrame:
    """(key_json, status, changed_cells): changed, left_only and right_only keys."""
    changed = changed_cells_per_key(c.differences).select("key_json", F.lit("changed").alias("status"), "changed_cells")
    one_sided = [df.select("key_json", F.lit(s).alias("status"), F.lit(0).cast("long").alias("changed_cells")) for df, s in ((c.left_only, "left_only"), (c.right_only, "right_only"))]
    return changed.unionByName(one_sided[0]).unionByName(one_sided[1])


def match_rates(c: Comparison) -> DataFrame:
    """(column, mismatches, mismatch_percent, match_percent); percentages are null without matched keys."""
    matched = c.matched_keys.agg(F.count("*").alias("matched"))
    rows = c.column_counts.crossJoin(F.broadcast(matched))  # one row
    wrong = percent(F.col("mismatches"), F.col("matched"))
    return rows.select("column", "mismatches", wrong.alias("mismatch_percent"), (100.0 - wrong).alias("match_percent"))


def overall_match(c: Comparison) -> DataFrame:
    """(overall_match_percent, mean_match_percent): of all compared cells, and the mean of the columns' percentages."""
    rates = match_rates(c)
    counts = rates.agg(F.sum("mismatches").alias("changed"), F.count("*").alias("columns"), F.avg("match_percent").alias("mean_match_percent"))
    both = counts.crossJoin(F.broadcast(c.matched_keys.agg(F.count("*").alias("matched"))))  # one row
    cells = F.col("matched") * F.col("columns")
    return both.select(F.when(cells > 0, 100.0 * (1 - F.col("changed") / cells)).alias("overall_match_percent"), "mean_match_percent")


def key_shares(c: Comparison) -> DataFrame:
    """(outcome, keys, share): equal, changed, left_only and right_only keys, in percent of all."""
    s = c.summary
    parts = {"equal": "equal_rows", "changed": "changed_rows", "left_only": "left_only", "right_only": "right_only"}
    rows = s.select(F.explode(F.array(*[F.struct(F.lit(k).alias("outcome"), F.col(v).alias("keys")) for k, v in parts.items()])).alias("r")).select("r.*")
    total = Window.partitionBy(F.lit(0))  # of four rows
    return rows.select("outcome", "keys", percent(F.col("keys"), F.sum("keys").over(total)).alias("share"))


def match_bands(c: Comparison) -> DataFrame:
    """(band, columns): columns by mismatches, in whole numbers so that no rounding decides."""
    matched = c.matched_keys.agg(F.count("*").alias("matched"))
    n, m = F.col("mismatches"), F.col("matched")
    band = F.when(m == 0, "none").when(n == 0, "0").when(n * 100 <= m, "<=1%").when(n * 100 <= m * 5, "<=5%").otherwise(">5%")
    return c.column_counts.crossJoin(F.broadcast(matched)).groupBy(band.alias("band")).agg(F.count("*").alias("columns"))


def samples(differences: DataFrame, n: int = 20, limit: int = 1000) -> DataFrame:
    """The first n cells of each column in key order, long texts cut, with their lengths."""
    first = Window.partitionBy("column").orderBy("key_json")
    top = differences.withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)
    return top.select("column", "place", "key_json", *[x for s in ("left", "right") for x in (shortened(F.col(f"{s}_value"), limit).alias(f"{s}_value"), F.char_length(f"{s}_value").alias(f"{s}_length"))])


def examples(differences: DataFrame, n: int = 3) -> DataFrame:
    """n examples of each column and pattern in key order."""
    first = Window.partitionBy("column", "pattern").orderBy("key_json")
    return patterns(differences).withColumn("place", F.row_number().over(first)).where(F.col("place") <= n)


def page(df: DataFrame, order: list, offset: int = 0, rows: int = 50) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(rows)


def filtered(differences: DataFrame, column: str | None = None, key: str | None = None, left_hash: str | None = None, right_hash: str | None = None) -> DataFrame:
    """Cells of a column, a key, or a pair of values given by their SHA-256."""
    out = differences
    for name, value in (("column", column), ("key_json", key)):
        out = out if value is None else out.where(F.col(name) == value)
    for name, value in (("left_value", left_hash), ("right_value", right_hash)):
        out = out if value is None else out.where(F.sha2(name, 256) == value)
    return out


def comments(differences: DataFrame, annotations: DataFrame) -> DataFrame:
    """differences with the comments on their column, key and cell, in this order, joined by line ends.
    annotations: (column, key_json, comment); a null column or key means any. Small: one for each remark made."""
    scopes = {
        "on_column": annotations.where("key_json is null").groupBy("column").agg(F.array_join(F.sort_array(F.collect_list("comment")), "\n").alias("on_column")),
        "on_key": annotations.where("column is null").groupBy("key_json").agg(F.array_join(F.sort_array(F.collect_list("comment")), "\n").alias("on_key")),
        "on_cell": annotations.where("column is not null and key_json is not null").groupBy("column", "key_json").agg(F.array_join(F.sort_array(F.collect_list("comment")), "\n").alias("on_cell")),
    }
    out = differences.join(scopes["on_column"], "column", "left").join(scopes["on_key"], "key_json", "left").join(scopes["on_cell"], ["column", "key_json"], "left")
    return out.select(*differences.columns, F.concat_ws("\n", "on_column", "on_key", "on_cell").alias("comment"))


def scoped(annotations: DataFrame, differences: DataFrame, columns: list[str]) -> DataFrame:
    """The remarks that belong to chosen columns: on one of them, or on a key that has a difference there."""
    keys = differences.where(F.col("column").isin(columns)).select("key_json").distinct()
    own = annotations.where(F.col("column").isNull() | F.col("column").isin(columns))
    return own.where("key_json is null").unionByName(own.where("key_json is not null").join(keys, "key_json", "left_semi").select(own.columns))


def supporting_fields(source: DataFrame, keys: list[str], sampled: DataFrame, fields: list[str], order: str, policy: str = "first", limit: int = 300) -> DataFrame:
    """(key_json, field, value, is_null, length) of other fields of the sampled keys, by the duplicate policy."""
    from .compare import key_json

    rows = source.select(key_json(keys).alias("key_json"), F.array(*[F.col(f"`{f}`") for f in fields]).alias("v"), F.col(order).alias("ord"))
    own = rows.join(sampled.select("key_json").distinct(), "key_json", "left_semi")
    pick = (F.min_by if policy == "first" else F.max_by)("v", "ord").alias("v")
    names = F.array(*[F.lit(f) for f in fields])
    cells = own.groupBy("key_json").agg(pick).select("key_json", F.posexplode("v").alias("pos", "value"))
    return cells.select("key_json", names[F.col("pos")].alias("field"), F.substring("value", 1, limit).alias("value"), F.col("value").isNull().alias("is_null"), F.char_length("value").alias("length"))
