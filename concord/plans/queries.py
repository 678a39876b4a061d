"""The registered queries of the reconciliation engine, each with its SQL twin."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CompareConfig, Container, Override, Rule
from ..operators import analysis, jsondiff, revision
from ..operators.compare import Comparison
from .pairs import LINES_LEFT, LINES_RIGHT, ORDERS_LEFT, ORDERS_RIGHT, lines_pair, orders_pair

KEY = ("o_orderkey",)
LINE_KEY = ("l_orderkey", "l_linenumber")
COLUMNS = ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINE_COLUMNS = ["l_partkey", "l_quantity", "l_returnflag", "l_linestatus"]
EXCLUDED = tuple((str(k),) for k in range(1, 400, 3))
RULES = (Rule("o_orderstatus", ignore_case=True), Rule("o_totalprice", tolerance="0.05"), Rule("o_orderpriority", trim=True), Rule("o_orderdate", left_date_format="%Y-%m-%d", right_date_format="%Y-%m-%d"))
OVERRIDES = (Override("o_orderstatus", "O", "o"), Override("o_orderpriority", "1-URGENT", "UNKNOWN"))


def orders(spark: SparkSession, sf_dir: str, **settings) -> Comparison:
    return Comparison(*orders_pair(spark, sf_dir), CompareConfig(KEY, **settings))


def lines(spark: SparkSession, sf_dir: str, policy: str = "first") -> Comparison:
    return Comparison(*lines_pair(spark, sf_dir), CompareConfig(LINE_KEY, duplicate_policy=policy))


# SQL parts. Texts of keys and values here need no escapes in JSON.
CELLS = " UNION ALL ".join(f"SELECT k.key_json, '{c}' AS \"column\", l.{c} AS left_value, r.{c} AS right_value FROM k JOIN l ON l.o_orderkey = k.o_orderkey JOIN r ON r.o_orderkey = k.o_orderkey WHERE l.{c} IS DISTINCT FROM r.{c}" for c in COLUMNS)
BASE = f"""WITH l AS ({ORDERS_LEFT}), r AS ({ORDERS_RIGHT}),
k AS (SELECT o_orderkey, concat('["', o_orderkey, '"]') AS key_json FROM l WHERE o_orderkey IN (SELECT o_orderkey FROM r)),
raw AS ({CELLS}),
diff AS (SELECT key_json, "column", coalesce(left_value, '[NULL]') AS left_value, coalesce(right_value, '[NULL]') AS right_value FROM raw),
lo AS (SELECT concat('["', o_orderkey, '"]') AS key_json FROM l WHERE o_orderkey NOT IN (SELECT o_orderkey FROM r)),
ro AS (SELECT concat('["', o_orderkey, '"]') AS key_json FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM l))
"""
NAMES = "(VALUES " + ", ".join(f"('{c}')" for c in COLUMNS) + ") AS names(\"column\")"
TRIM = "trim({}, ' ')"
PATTERN = """CASE WHEN trim(left_value) = '' AND trim(right_value) <> '' THEN 'Blank → value' WHEN trim(left_value) <> '' AND trim(right_value) = '' THEN 'Value → blank'
 WHEN trim(left_value) = trim(right_value) THEN 'Whitespace only' WHEN lower(left_value) = lower(right_value) THEN 'Case only'
 WHEN lower(trim(left_value)) = lower(trim(right_value)) THEN 'Case and whitespace'
 WHEN TRY_CAST(left_value AS DECIMAL(30,6)) = TRY_CAST(right_value AS DECIMAL(30,6)) THEN 'Numeric formatting' ELSE 'Other value change' END"""
RULE = """("column" = 'o_orderstatus' AND lower(left_value) = lower(right_value) OR "column" = 'o_orderpriority' AND trim(left_value) = trim(right_value)
 OR "column" = 'o_totalprice' AND abs(CAST(left_value AS DECIMAL(18,4)) - CAST(right_value AS DECIMAL(18,4))) <= 0.05)"""
OVERRIDE = """("column" = 'o_orderstatus' AND left_value = 'O' AND right_value = 'o' OR "column" = 'o_orderpriority' AND left_value = '1-URGENT' AND right_value = 'UNKNOWN')"""


def rule_if(only: str) -> str:
    typed = "\"column\" = 'o_totalprice'"
    parts = {
        "trim": "\"column\" = 'o_orderpriority' AND trim(left_value) = trim(right_value)",
        "ignore_case": "\"column\" = 'o_orderstatus' AND lower(left_value) = lower(right_value)",
        "tolerance": f"{typed} AND abs(TRY_CAST(CASE WHEN {typed} THEN left_value END AS DECIMAL(18,4)) - TRY_CAST(CASE WHEN {typed} THEN right_value END AS DECIMAL(18,4))) <= 0.05",
        "numeric": f"{typed} AND TRY_CAST(CASE WHEN {typed} THEN left_value END AS DECIMAL(18,4)) = TRY_CAST(CASE WHEN {typed} THEN right_value END AS DECIMAL(18,4))",
    }
    return f"{BASE} SELECT * FROM diff WHERE NOT coalesce({parts[only]}, false)"


RULE_ALL = "(" + " OR ".join(f"coalesce({rule_if(x).rpartition('coalesce(')[2].removesuffix(', false)')}, false)" for x in ("trim", "ignore_case", "tolerance")) + ")"


def deduped(policy: str) -> str:
    pick = "arg_min" if policy == "first" else "arg_max"

    def side(sql: str) -> str:
        own = ", ".join(f"{pick}({c}, ord) AS {c}" for c in LINE_COLUMNS)
        return f"SELECT concat('[\"', l_orderkey, '\",\"', l_linenumber, '\"]') AS key_json, {own}, count(*) AS n FROM ({sql.format(order='ord')}) GROUP BY l_orderkey, l_linenumber"

    cells = " UNION ALL ".join(f"SELECT key_json, '{c}' AS \"column\", l.{c} AS left_value, r.{c} AS right_value FROM l JOIN r USING (key_json) WHERE l.{c} IS DISTINCT FROM r.{c}" for c in LINE_COLUMNS)
    return f"WITH numbered_lines AS (SELECT *, row_number() OVER () AS ord FROM lineitem), l AS ({side(LINES_LEFT)}), r AS ({side(LINES_RIGHT)}), raw AS ({cells}) "


def summary_sql(excluded: bool = False, rules: bool = False) -> str:
    gone = ", ".join(f"'{k}'" for (k,) in EXCLUDED)
    base = BASE
    if excluded:
        base = base.replace(f"WITH l AS ({ORDERS_LEFT}), r AS ({ORDERS_RIGHT})", f"WITH l0 AS ({ORDERS_LEFT}), r0 AS ({ORDERS_RIGHT}), l AS (SELECT * FROM l0 WHERE o_orderkey NOT IN ({gone})), r AS (SELECT * FROM r0 WHERE o_orderkey NOT IN ({gone}))")
    taken = f"coalesce({OVERRIDE}, false)" if rules else "false"
    by_rule = f"(NOT {taken} AND {RULE_ALL})" if rules else "false"
    rows = ("(SELECT count(*) FROM l0)", "(SELECT count(*) FROM r0)") if excluded else ("(SELECT count(*) FROM l)", "(SELECT count(*) FROM r)")
    return f"""{base}, judged AS (SELECT key_json, {taken} AS o, {by_rule} AS u FROM raw), n AS (SELECT count(*) FILTER (WHERE NOT o AND NOT u) AS cells, count(DISTINCT key_json) FILTER (WHERE NOT o AND NOT u) AS changed, count(*) FILTER (WHERE o) AS o, count(*) FILTER (WHERE u) AS u FROM judged)
SELECT {rows[0]} AS left_rows, {rows[1]} AS right_rows, (SELECT count(*) FROM k) AS matched_keys, (SELECT count(*) FROM k) - changed AS equal_rows, changed AS changed_rows, cells AS changed_cells,
 (SELECT count(*) FROM lo) AS left_only, (SELECT count(*) FROM ro) AS right_only, o AS override_equivalent_cells, u AS rule_equivalent_cells,
 CAST(0 AS BIGINT) AS left_duplicate_keys, CAST(0 AS BIGINT) AS right_duplicate_keys, CAST(0 AS BIGINT) AS left_duplicate_rows_skipped, CAST(0 AS BIGINT) AS right_duplicate_rows_skipped,
 {rows[0]} - (SELECT count(*) FROM l) AS left_excluded_rows, {rows[1]} - (SELECT count(*) FROM r) AS right_excluded_rows,
 (SELECT count(*) FROM l) AS left_compared_rows, (SELECT count(*) FROM r) AS right_compared_rows FROM n"""


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def add(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        SQL[name] = sql


BOX = (Container("Old orders", EXCLUDED, "closed"), Container("Again", EXCLUDED[:5], "twice"))
COUNTS = f"{BASE} SELECT \"column\", count(d.key_json) AS mismatches FROM {NAMES} LEFT JOIN diff d USING (\"column\") GROUP BY \"column\""

add("summary_totals", lambda s, d: orders(s, d).summary, summary_sql())
add("column_mismatch_counts", lambda s, d: orders(s, d).column_counts, COUNTS)
add("matched_keys", lambda s, d: orders(s, d).matched_keys, f"{BASE} SELECT key_json FROM k")
add("left_only", lambda s, d: orders(s, d).left_only, f"{BASE} SELECT key_json FROM lo")
add("right_only", lambda s, d: orders(s, d).right_only, f"{BASE} SELECT key_json FROM ro")
add("raw_differences", lambda s, d: orders(s, d).raw_differences, f"{BASE} SELECT * FROM raw")
add("null_display", lambda s, d: orders(s, d).differences, f"{BASE} SELECT * FROM diff")
add("null_vs_empty", lambda s, d: orders(s, d).raw_differences.where("column = 'o_orderdate'").groupBy(F.col("right_value").isNull().alias("is_null")).agg(F.count("*").alias("cells")), f"{BASE} SELECT right_value IS NULL AS is_null, count(*) AS cells FROM raw WHERE \"column\" = 'o_orderdate' GROUP BY 1")
for _policy in ("first", "last"):
    add(f"dedup_{_policy}", lambda s, d, p=_policy: lines(s, d, p).raw_differences, deduped(_policy) + "SELECT * FROM raw")
add("composite_key_compare", lambda s, d: lines(s, d).matched_keys, deduped("first") + "SELECT key_json FROM l JOIN r USING (key_json)")
add("duplicate_audit", lambda s, d: lines(s, d).duplicates, deduped("first") + "SELECT s AS side, key_json, n AS occurrences, n - 1 AS skipped_rows, CAST(1 AS BIGINT) AS kept_occurrence FROM (SELECT 'left' AS s, key_json, n FROM l UNION ALL SELECT 'right', key_json, n FROM r) WHERE n > 1")
add("duplicate_totals", lambda s, d: lines(s, d).duplicates.groupBy("side").agg(F.count("*").alias("keys"), F.sum("skipped_rows").alias("skipped")), deduped("first") + "SELECT s AS side, count(*) AS keys, CAST(sum(n - 1) AS BIGINT) AS skipped FROM (SELECT 'left' AS s, n FROM l UNION ALL SELECT 'right', n FROM r) WHERE n > 1 GROUP BY s")
add("excluded_keys_summary", lambda s, d: orders(s, d, containers=BOX).summary, summary_sql(excluded=True))
add("exclude_columns", lambda s, d: orders(s, d, ignored_columns=("o_orderdate",)).column_counts, f"SELECT * FROM ({COUNTS}) WHERE \"column\" <> 'o_orderdate'")
add("rule_trim", lambda s, d: orders(s, d, rules=(RULES[2],)).differences, rule_if("trim"))
add("rule_ignore_case", lambda s, d: orders(s, d, rules=(RULES[0],)).differences, rule_if("ignore_case"))
add("rule_tolerance", lambda s, d: orders(s, d, rules=(RULES[1],)).differences, rule_if("tolerance"))
add("rule_numeric_format", lambda s, d: orders(s, d, rules=(Rule("o_totalprice", tolerance="0"),)).differences, rule_if("numeric"))
add("rules_combined_summary", lambda s, d: orders(s, d, rules=RULES, overrides=OVERRIDES).summary, summary_sql(rules=True))
add("override_accept", lambda s, d: orders(s, d, overrides=OVERRIDES).judged().where("accepted = 'override'").drop("accepted"), f"{BASE} SELECT * FROM raw WHERE coalesce({OVERRIDE}, false)")
add("pattern_classification", lambda s, d: analysis.pattern_counts(orders(s, d).differences), f"{BASE} SELECT \"column\", {PATTERN} AS pattern, left_value, right_value, count(*) AS occurrences FROM diff GROUP BY ALL")
add("pattern_category_totals", lambda s, d: analysis.pattern_totals(orders(s, d).differences), f"{BASE} SELECT {PATTERN} AS pattern, count(*) AS occurrences FROM diff GROUP BY ALL")
add("value_pair_share", lambda s, d: analysis.pair_counts(orders(s, d).differences).withColumn("share", F.round("share", 6)), f"{BASE}, p AS (SELECT \"column\", left_value, right_value, count(*) AS occurrences FROM diff GROUP BY ALL) SELECT *, round(100.0 * occurrences / sum(occurrences) OVER (PARTITION BY \"column\"), 6) AS share FROM p")
add("changed_cells_per_key", lambda s, d: analysis.changed_cells_per_key(orders(s, d).differences), f"{BASE} SELECT key_json, count(*) AS changed_cells FROM diff GROUP BY 1")
add("key_status_index", lambda s, d: analysis.key_status(orders(s, d)), f"{BASE} SELECT key_json, 'changed' AS status, count(*) AS changed_cells FROM diff GROUP BY 1 UNION ALL SELECT key_json, 'left_only', 0 FROM lo UNION ALL SELECT key_json, 'right_only', 0 FROM ro")
add("column_match_rates", lambda s, d: analysis.match_rates(orders(s, d)).select("column", "mismatches", *[F.round(c, 6).alias(c) for c in ("mismatch_percent", "match_percent")]), f"{COUNTS.replace('SELECT \"column\", count(d.key_json) AS mismatches', 'SELECT \"column\", count(d.key_json) AS mismatches, round(100.0 * count(d.key_json) / (SELECT count(*) FROM k), 6) AS mismatch_percent, round(100.0 - 100.0 * count(d.key_json) / (SELECT count(*) FROM k), 6) AS match_percent')}")
add("match_bands", lambda s, d: analysis.match_bands(orders(s, d)), f"{BASE}, c AS (SELECT \"column\", count(d.key_json) AS n FROM {NAMES} LEFT JOIN diff d USING (\"column\") GROUP BY 1), m AS (SELECT count(*) AS m FROM k) SELECT CASE WHEN m = 0 THEN 'none' WHEN n = 0 THEN '0' WHEN n * 100 <= m THEN '<=1%' WHEN n * 100 <= m * 5 THEN '<=5%' ELSE '>5%' END AS band, count(*) AS columns FROM c, m GROUP BY 1")
add("samples_top20", lambda s, d: analysis.samples(orders(s, d).differences), f"{BASE} SELECT \"column\", row_number() OVER (PARTITION BY \"column\" ORDER BY key_json) AS place, key_json, left_value, length(left_value) AS left_length, right_value, length(right_value) AS right_length FROM diff QUALIFY place <= 20")
add("examples_per_pattern", lambda s, d: analysis.examples(orders(s, d).differences), f"{BASE} SELECT *, {PATTERN} AS pattern, row_number() OVER (PARTITION BY \"column\", {PATTERN} ORDER BY key_json) AS place FROM diff QUALIFY place <= 3")
add("cells_page", lambda s, d: analysis.page(orders(s, d).differences, ["key_json", "column"], 100), f"{BASE} SELECT * FROM diff ORDER BY key_json, \"column\" LIMIT 50 OFFSET 100")
add("pair_hash_filter", lambda s, d: analysis.filtered(orders(s, d).differences, column="o_orderstatus", left_hash="c4694f2e93d5c4e7d51f9c5deb75e6cc8be5e1114178c6a45b6fc2c566a0aa8c"), f"{BASE} SELECT * FROM diff WHERE \"column\" = 'o_orderstatus' AND sha256(left_value) = 'c4694f2e93d5c4e7d51f9c5deb75e6cc8be5e1114178c6a45b6fc2c566a0aa8c'")
add("supporting_fields", lambda s, d: analysis.supporting_fields(lines_pair(s, d)[0], list(LINE_KEY), lines(s, d).duplicates.where("side = 'left'"), ["l_partkey", "l_returnflag"], "__source_order"), deduped("first") + "SELECT key_json, f AS field, v AS value, v IS NULL AS is_null, length(v) AS length FROM (SELECT key_json, 'l_partkey' AS f, l_partkey AS v FROM l WHERE n > 1 UNION ALL SELECT key_json, 'l_returnflag', l_returnflag FROM l WHERE n > 1)")


_GONE = ", ".join(f"'[\"{k}\"]'" for (k,) in EXCLUDED)
#: Without overrides; more.py has the query.
SQL["revision_counters"] = f"""{BASE}, kept AS (SELECT * FROM raw WHERE "column" <> 'o_orderdate' AND key_json NOT IN ({_GONE})), left_over AS (SELECT * FROM kept WHERE NOT {RULE_ALL}),
m AS (SELECT count(*) AS n FROM k WHERE key_json NOT IN ({_GONE}))
SELECT (SELECT count(*) FROM raw) AS original_cells, (SELECT count(*) FROM kept) AS raw_cells, (SELECT count(*) FROM kept) - (SELECT count(*) FROM left_over) AS accepted_cells, (SELECT count(*) FROM raw) - (SELECT count(*) FROM kept) AS filtered_cells,
 (SELECT count(*) FROM left_over) AS changed_cells, (SELECT count(DISTINCT key_json) FROM left_over) AS changed_rows, n - (SELECT count(DISTINCT key_json) FROM left_over) AS equal_rows, n AS matched_keys,
 (SELECT count(*) FROM lo WHERE key_json NOT IN ({_GONE})) AS left_only, (SELECT count(*) FROM ro WHERE key_json NOT IN ({_GONE})) AS right_only FROM m"""


def _comments(s: SparkSession, d: str) -> DataFrame:
    notes = s.createDataFrame([("o_orderdate", None, "dates"), (None, '["19"]', "this key"), ("o_orderdate", '["19"]', "this cell")], "column string, key_json string, comment string")
    return analysis.comments(orders(s, d).differences, notes).where("comment <> ''")


add("annotation_comments", _comments, f"{BASE} SELECT *, concat_ws(chr(10), CASE WHEN \"column\" = 'o_orderdate' THEN 'dates' END, CASE WHEN key_json = '[\"19\"]' THEN 'this key' END, CASE WHEN key_json = '[\"19\"]' AND \"column\" = 'o_orderdate' THEN 'this cell' END) AS comment FROM diff WHERE \"column\" = 'o_orderdate' OR key_json = '[\"19\"]'")


def _events(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("props").alias("a"))
    k = F.get_json_object("a", "$.k").cast("long")
    right = F.when(F.col("event_id") % 10 == 0, F.format_string('{"k": %d}', k + 1)).when(F.col("event_id") % 10 == 1, F.format_string('{ "k":%d.0 }', k)).otherwise(F.col("a"))
    return jsondiff.diff_documents(events.withColumn("b", right), "event_id", "a", "b")


add("json_diff_props", _events, "SELECT event_id, 'changed' AS kind, '$.k' AS left_path, '$.k' AS right_path, json_extract_string(props, '$.k') AS left_value, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) + 1 AS VARCHAR) AS right_value FROM events WHERE event_id % 10 = 0 AND json_extract_string(props, '$.k') IS NOT NULL")
