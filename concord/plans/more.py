"""Registered queries over sources, stored evidence, reports and JSON documents, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CompareConfig, Rule
from ..functions.texts import changed_middle
from ..operators import analysis, jsondiff, revision
from ..operators.compare import Comparison
from ..scratch import shared_folder
from ..sinks.results import save, workbook, write_csv
from ..sources.documents import document_pairs, write_documents
from ..sources.source import PLACE_BITS
from ..sources.texts import ORDER, open_source, parquet_metadata, preview, read, result_preview
from .pairs import LINES_LEFT, LINES_RIGHT, ORDERS_LEFT, ORDERS_RIGHT, lines_pair, orders_pair
from .queries import BASE, BOX, COUNTS, EXCLUDED, KEY, LINE_KEY, OVERRIDE, OVERRIDES, PATTERN, RULE_ALL, RULES, SQL, add, deduped, lines, orders, summary_sql

GONE = ", ".join(f"'[\"{k}\"]'" for (k,) in EXCLUDED)
GONE_KEYS = ", ".join(f"'{k}'" for (k,) in EXCLUDED)


# --- headers ---------------------------------------------------------------------------------------------------------


def _customers(s: SparkSession, d: str) -> Comparison:
    """The right side lacks a column, spells another in capitals, has one more, and other balances."""
    left = s.read.parquet(f"{d}/customer.parquet").select(*[F.col(c).cast("string").alias(c) for c in ("c_custkey", "c_name", "c_nationkey", "c_mktsegment")])
    other = F.when(F.col("c_custkey").cast("long") % 4 == 0, F.upper(F.concat("c_name", F.lit("x")))).otherwise(F.col("c_name"))
    right = left.select(F.col("c_nationkey"), other.alias("C_NAME"), F.col("c_custkey").alias("C_CUSTKEY"), F.lit("1").alias("extra"))
    return Comparison(left, right, CompareConfig(("c_custkey",)))


def header_alignment(s: SparkSession, d: str) -> DataFrame:
    c = _customers(s, d)
    alone = s.createDataFrame([(side, n) for side, names in zip(("left", "right"), c.unmatched, strict=True) for n in names], "side string, column string")
    return c.column_counts.select(F.lit("both").alias("side"), "column", "mismatches").unionByName(alone.withColumn("mismatches", F.lit(None).cast("long")))


add(
    "header_alignment",
    header_alignment,
    """
SELECT 'both' AS side, 'c_name' AS "column", count(*) FILTER (WHERE c_custkey % 4 = 0) AS mismatches FROM customer
UNION ALL SELECT 'both', 'c_nationkey', 0
UNION ALL SELECT 'left', 'c_mktsegment', NULL
UNION ALL SELECT 'right', 'extra', NULL
""",
)

# --- sources ---------------------------------------------------------------------------------------------------------


def csv_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Both sides written as CSV, read strictly, compared: a null has become an empty text."""
    folder, sides = shared_folder(s, "csv"), []
    for name, df in zip(("left.csv", "right.csv"), orders_pair(s, d), strict=True):
        write_csv(df, f"{folder}/{name}")
        sides.append(read(s, f"{folder}/{name}"))
    return Comparison(*sides, CompareConfig(KEY)).column_counts


add("csv_roundtrip", csv_roundtrip, COUNTS.replace("THEN NULL WHEN", "THEN '' WHEN"))


#: A quote, a line end and a delimiter in every value.
_FLAG = "concat(l_returnflag, '\"', chr(10), ',') AS l_returnflag,"


def _lines_with_signs(sql: str) -> str:
    return sql.replace("l_returnflag, l_linestatus, ord", f"{_FLAG} l_linestatus, ord").replace("l_returnflag, CASE", f"{_FLAG} CASE")


#: Files of each side, so many at least, and rows of each at most.
_FILES, _FILE_ROWS = 4, 1 << 19


def csv_duplicates(s: SparkSession, d: str) -> DataFrame:
    """Repeated keys in CSV of several files, records of several lines: the last one in the order of files and bytes counts."""
    table = s.read.parquet(f"{d}/lineitem.parquet")
    lines, rows = table.select("*", (F.col("_metadata.row_index") + 1).alias("ord")), table.count()  # no column is read
    files, folder, sides = max(_FILES, -(-rows // _FILE_ROWS)), shared_folder(s, "csv"), []
    for name, sql, least in (("left.csv", LINES_LEFT, 1), ("right.csv", LINES_RIGHT, -rows)):
        df = s.sql(_lines_with_signs(sql).format(order="place").replace("FROM numbered_lines", "FROM {lines}"), lines=lines)
        file = F.expr(f"cast((place - {least}L) * {files} div {rows - least + 1} as int)")  # places are known without a look at the rows
        write_csv(df.repartitionById(files, file).sortWithinPartitions("place").drop("place"), f"{folder}/{name}")
        sides.append(open_source(s, f"{folder}/{name}"))
    return Comparison(*sides, CompareConfig(LINE_KEY, duplicate_policy="last")).raw_differences


add("csv_duplicates", csv_duplicates, _lines_with_signs(deduped("last")) + "SELECT * FROM raw")


def excel_scan(s: SparkSession, d: str) -> DataFrame:
    """A small table as a worksheet and back."""
    nation = s.read.parquet(f"{d}/nation.parquet").orderBy("n_nationkey")
    path = f"{shared_folder(s, 'excel')}/nation.xlsx"
    save(path, workbook({"Nations": [nation.columns, *nation.collect()]}))  # a worksheet's size bounds the rows
    return read(s, path, sheet="Nations").withColumnRenamed(ORDER, "position")


add(
    "excel_scan",
    excel_scan,
    """
SELECT CAST(n_nationkey AS VARCHAR) AS n_nationkey, n_name, CAST(n_regionkey AS VARCHAR) AS n_regionkey,
  row_number() OVER (ORDER BY n_nationkey) - 1 AS position
FROM nation
""",
)
add(
    "parquet_scan",
    lambda s, d: read(s, f"{d}/orders.parquet").drop(ORDER),
    """
SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
  CAST(o_totalprice AS VARCHAR) AS o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority
FROM orders
""",
)
add(
    "source_preview",
    lambda s, d: preview(read(s, f"{d}/customer.parquet"), rows=20, columns=2, chars=5),
    "SELECT CAST(c_custkey AS VARCHAR)[:5] AS c_custkey, c_name[:5] AS c_name FROM customer LIMIT 20",
)

# --- duplicates, exclusions ------------------------------------------------------------------------------------------

add(
    "duplicate_sample_first_group",
    lambda s, d: lines(s, d).first_duplicates.withColumn("values", F.array_join("values", "|")),
    deduped("first")
    + f"""
, every AS (
  SELECT 'left' AS side, l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, l_linestatus, ord
  FROM ({LINES_LEFT.format(order="ord")})
  UNION ALL SELECT 'right', * FROM (
    SELECT CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),
      CAST(CAST(CAST(l_quantity AS DECIMAL(18,2)) + CASE WHEN l_partkey % 50 = 0 THEN 1 ELSE 0 END AS DECIMAL(18,2)) AS STRING),
      l_returnflag, CASE WHEN l_partkey % 40 = 0 THEN lower(l_linestatus) ELSE l_linestatus END,
      CASE WHEN l_orderkey % 2 = 1 THEN -ord ELSE ord END
    FROM numbered_lines)
), keyed AS (
  SELECT *, concat('["', l_orderkey, '","', l_linenumber, '"]') AS key_json FROM every
), first AS (
  SELECT side, min(key_json) AS key_json
  FROM (SELECT side, key_json FROM keyed GROUP BY side, key_json HAVING count(*) > 1) GROUP BY side
)
SELECT side, key_json, count(*) OVER (PARTITION BY side) AS occurrences,
  row_number() OVER (PARTITION BY side ORDER BY ord) AS place,
  concat_ws('|', l_partkey, l_quantity, l_returnflag, l_linestatus) AS values
FROM keyed JOIN first USING (side, key_json) QUALIFY place <= 3
""",
)
add(
    "exclusion_audit",
    lambda s, d: (
        orders(s, d, containers=BOX)
        .exclusion_audit.groupBy("container", "reason")
        .agg(F.count("*").alias("keys"), F.sum("left_rows").alias("left_rows"), F.sum("right_rows").alias("right_rows"))
    ),
    f"""
WITH l AS ({ORDERS_LEFT}), r AS ({ORDERS_RIGHT}),
box AS (
  SELECT 'Old orders' AS container, 'closed' AS reason, unnest([{GONE_KEYS}]) AS k
  UNION ALL SELECT 'Again', 'twice', unnest([{", ".join(f"'{k}'" for (k,) in EXCLUDED[:5])}])
)
SELECT container, reason, count(*) AS keys, CAST(sum((SELECT count(*) FROM l WHERE o_orderkey = k)) AS BIGINT) AS left_rows,
  CAST(sum((SELECT count(*) FROM r WHERE o_orderkey = k)) AS BIGINT) AS right_rows
FROM box GROUP BY container, reason
""",
)

# --- rules -----------------------------------------------------------------------------------------------------------


def rule_dates(s: SparkSession, d: str) -> DataFrame:
    """The right side writes a third of the dates day first, some of them a day later."""
    left = orders_pair(s, d)[0]
    key, day = F.col("o_orderkey").cast("long"), F.col("o_orderdate").cast("date")
    moved = F.date_format(F.date_add(day, F.when(key % 5 == 0, 1).otherwise(0)), "dd/MM/yyyy")
    right = left.withColumn("o_orderdate", F.when(key % 3 == 0, moved).otherwise(F.col("o_orderdate")))
    rule = Rule("o_orderdate", left_date_format="%Y-%m-%d", right_date_format="%d/%m/%Y")
    return Comparison(left, right, CompareConfig(KEY, rules=(rule,))).differences


add(
    "rule_dates",
    rule_dates,
    f"""
WITH l AS ({ORDERS_LEFT})
SELECT concat('["', o_orderkey, '"]') AS key_json, 'o_orderdate' AS "column", o_orderdate AS left_value,
  strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, '%d/%m/%Y') AS right_value
FROM l WHERE CAST(o_orderkey AS BIGINT) % 3 = 0 AND CAST(o_orderkey AS BIGINT) % 5 = 0
""",
)

# --- analyses --------------------------------------------------------------------------------------------------------

add(
    "value_pair_counts",
    lambda s, d: analysis.pair_counts(orders(s, d).differences).drop("share"),
    f'{BASE} SELECT "column", left_value, right_value, count(*) AS occurrences FROM diff GROUP BY ALL',
)
add(
    "patterns_by_column",
    lambda s, d: analysis.patterns_by_column(orders(s, d).differences),
    f'{BASE} SELECT "column", {PATTERN} AS pattern, count(*) AS occurrences FROM diff GROUP BY ALL',
)
add(
    "pattern_page",
    lambda s, d: analysis.pattern_page(orders(s, d).differences, offset=10, rows=50),
    f"""{BASE}, p AS (
  SELECT "column", {PATTERN} AS pattern, left_value, right_value, count(*) AS occurrences,
    sha256(left_value) AS left_hash, sha256(right_value) AS right_hash
  FROM diff GROUP BY ALL)
SELECT *, (SELECT count(*) FROM p) AS total FROM p
ORDER BY occurrences DESC, "column", pattern, left_hash, right_hash LIMIT 50 OFFSET 10""",
)
add(
    "ranked_examples",
    lambda s, d: analysis.ranked_examples(orders(s, d).differences, 1),
    f"""{BASE}, p AS (SELECT *, {PATTERN} AS pattern FROM diff)
SELECT *, row_number() OVER (PARTITION BY "column", pattern ORDER BY key_json) AS place,
  count(*) OVER (PARTITION BY "column", pattern) AS occurrences
FROM p QUALIFY place = 1""",
)
add(
    "overall_match",
    lambda s, d: analysis.overall_match(orders(s, d)).select(*[F.round(c, 6).alias(c) for c in ("overall_match_percent", "mean_match_percent")]),
    f"""{BASE}, n AS (SELECT (SELECT count(*) FROM diff) AS changed, (SELECT count(*) FROM k) AS matched)
SELECT round(100.0 * (1 - changed / (matched * 5.0)), 6) AS overall_match_percent,
  round(100.0 * (1 - changed / (matched * 5.0)), 6) AS mean_match_percent FROM n""",
)
add(
    "key_outcome_shares",
    lambda s, d: analysis.key_shares(orders(s, d)).withColumn("share", F.round("share", 6)),
    f"""{BASE}, t AS (
  SELECT 'equal' AS outcome, (SELECT count(*) FROM k) - (SELECT count(DISTINCT key_json) FROM diff) AS keys
  UNION ALL SELECT 'changed', (SELECT count(DISTINCT key_json) FROM diff)
  UNION ALL SELECT 'left_only', (SELECT count(*) FROM lo)
  UNION ALL SELECT 'right_only', (SELECT count(*) FROM ro))
SELECT outcome, keys, round(100.0 * keys / sum(keys) OVER (), 6) AS share FROM t""",
)
add(
    "key_filter",
    lambda s, d: analysis.filtered(orders(s, d).differences, key='["19"]'),
    f"{BASE} SELECT * FROM diff WHERE key_json = '[\"19\"]'",
)
add(
    "numeric_differences",
    lambda s, d: (
        orders(s, d).differences.where("column = 'o_totalprice'")
        .select("key_json", analysis.numeric_difference(F.col("left_value"), F.col("right_value")).cast("decimal(18,4)").cast("double").alias("delta"))
    ),
    f"""{BASE} SELECT key_json, CAST(CAST(left_value AS DECIMAL(18,4)) - CAST(right_value AS DECIMAL(18,4)) AS DOUBLE) AS delta
FROM diff WHERE "column" = 'o_totalprice'""",
)
add(
    "match_rate_texts",
    lambda s, d: analysis.match_rates(orders(s, d)).select("column", analysis.percent_text(F.round("match_percent", 4)).alias("match")),
    f"""{BASE}, c AS ({COUNTS.removeprefix(BASE)})
SELECT "column", printf('%.4f%%', round(100.0 - 100.0 * mismatches / (SELECT count(*) FROM k), 4)) AS match FROM c""",
)


def annotation_scope(s: SparkSession, d: str) -> DataFrame:
    notes = s.createDataFrame(
        [("o_orderdate", None, "dates"), ("o_custkey", None, "other column"), (None, '["19"]', "this key"), (None, '["1"]', "no difference"), ("o_orderdate", '["19"]', "this cell")],
        "column string, key_json string, comment string",
    )
    return analysis.scoped(notes, orders(s, d).differences, ["o_orderdate"])


add(
    "annotation_scope",
    annotation_scope,
    f"""{BASE}, notes("column", key_json, comment) AS (VALUES ('o_orderdate', NULL, 'dates'), ('o_custkey', NULL, 'other column'),
  (NULL, '["19"]', 'this key'), (NULL, '["1"]', 'no difference'), ('o_orderdate', '["19"]', 'this cell'))
SELECT * FROM notes WHERE ("column" IS NULL OR "column" = 'o_orderdate')
  AND (key_json IS NULL OR key_json IN (SELECT key_json FROM diff WHERE "column" = 'o_orderdate'))""",
)

# --- revision from stored evidence -----------------------------------------------------------------------------------


def _revised(s: SparkSession, d: str) -> revision.Revision:
    c = orders(s, d)
    after = CompareConfig(KEY, ignored_columns=("o_orderdate",), rules=RULES[:3], overrides=OVERRIDES, containers=BOX)
    return revision.revise(c, revision.keep(c, shared_folder(s, "evidence")), after)


KEPT = f"""{BASE}, kept AS (
  SELECT *, CASE WHEN coalesce({OVERRIDE}, false) THEN 'override' WHEN {RULE_ALL} THEN 'rule' END AS accepted
  FROM raw WHERE "column" <> 'o_orderdate' AND key_json NOT IN ({GONE})),
shown AS (
  SELECT key_json, "column", coalesce(left_value, '[NULL]') AS left_value, coalesce(right_value, '[NULL]') AS right_value, accepted FROM kept)
"""
add("revision_accept", lambda s, d: _revised(s, d).accepted, f"{KEPT} SELECT * FROM shown WHERE accepted IS NOT NULL")
add("revision_differences", lambda s, d: _revised(s, d).differences, f"{KEPT} SELECT * EXCLUDE accepted FROM shown WHERE accepted IS NULL")
add(
    "revision_exclude",
    lambda s, d: _revised(s, d).excluded,
    f"""{BASE} SELECT key_json, 'matched_keys' AS part FROM k WHERE key_json IN ({GONE})
UNION ALL SELECT key_json, 'left_only' FROM lo WHERE key_json IN ({GONE})
UNION ALL SELECT key_json, 'right_only' FROM ro WHERE key_json IN ({GONE})""",
)
add("revision_counters", lambda s, d: _revised(s, d).counters, SQL["revision_counters"].replace(f"NOT {RULE_ALL}", f"NOT coalesce({OVERRIDE}, false) AND NOT {RULE_ALL}"))

add(
    "revision_rows",
    lambda s, d: _revised(s, d).rows,
    f"""{BASE} SELECT (SELECT count(*) FROM l WHERE o_orderkey IN ({GONE_KEYS})) AS left_excluded_rows, (SELECT count(*) FROM r WHERE o_orderkey IN ({GONE_KEYS})) AS right_excluded_rows,
  (SELECT count(*) FROM l WHERE o_orderkey NOT IN ({GONE_KEYS})) AS left_compared_rows, (SELECT count(*) FROM r WHERE o_orderkey NOT IN ({GONE_KEYS})) AS right_compared_rows""",
)

# --- JSON documents --------------------------------------------------------------------------------------------------


def _order_lists(s: SparkSession, d: str) -> DataFrame:
    """(o_custkey, a, b): each customer's orders as JSON arrays, on the right reversed, some missing, some in small letters."""
    orders = s.read.parquet(f"{d}/orders.parquet")
    key = F.col("o_orderkey")
    item = lambda status: F.struct(key.alias("id"), status.alias("s"), F.col("o_totalprice").alias("p"))
    status = F.when(key % 10 == 0, F.lower("o_orderstatus")).otherwise(F.col("o_orderstatus"))
    lists = orders.groupBy("o_custkey").agg(
        F.to_json(F.sort_array(F.collect_list(item(F.col("o_orderstatus"))))).alias("a"),
        F.to_json(F.sort_array(F.collect_list(F.when(key % 17 != 3, item(status))), False)).alias("b"),
    )
    return lists


PAIRS = """WITH l AS (SELECT o_custkey, o_orderkey, o_orderstatus AS s, o_totalprice AS p FROM orders),
r AS (
  SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS s, o_totalprice AS p
  FROM orders WHERE o_orderkey % 17 <> 3)
"""


def json_keyed(s: SparkSession, d: str) -> DataFrame:
    rules = [jsondiff.ArrayRule("$", "keyed", "id")]
    return jsondiff.difference_counts(jsondiff.diff_documents(_order_lists(s, d), "o_custkey", "a", "b", rules), "o_custkey")


add(
    "json_keyed",
    json_keyed,
    f"""{PAIRS}, m AS (SELECT l.o_custkey, r.o_orderkey IS NULL AS gone, l.s <> r.s AS other FROM l LEFT JOIN r USING (o_custkey, o_orderkey))
SELECT o_custkey, CAST(0 AS BIGINT) AS added, count(*) FILTER (WHERE gone) AS removed, count(*) FILTER (WHERE other) AS changed
FROM m GROUP BY o_custkey HAVING count(*) FILTER (WHERE gone OR other) > 0""",
)


def json_unordered(s: SparkSession, d: str) -> DataFrame:
    """The orders' statuses alone, as multisets."""
    pairs = _order_lists(s, d).select("o_custkey", *[F.to_json(F.from_json(c, "array<struct<s:string>>")["s"]).alias(c) for c in ("a", "b")])
    return jsondiff.difference_counts(jsondiff.diff_documents(pairs, "o_custkey", "a", "b", default="unordered"), "o_custkey")


add(
    "json_unordered",
    json_unordered,
    f"""{PAIRS}, gone AS (SELECT o_custkey, s FROM l EXCEPT ALL SELECT o_custkey, s FROM r),
more AS (SELECT o_custkey, s FROM r EXCEPT ALL SELECT o_custkey, s FROM l),
n AS (SELECT o_custkey, 0 AS added, 1 AS removed FROM gone UNION ALL SELECT o_custkey, 1, 0 FROM more)
SELECT o_custkey, CAST(sum(added) AS BIGINT) AS added, CAST(sum(removed) AS BIGINT) AS removed, CAST(0 AS BIGINT) AS changed
FROM n GROUP BY o_custkey""",
)
add(
    "json_discover_arrays",
    lambda s, d: jsondiff.discover_arrays(_order_lists(s, d), "o_custkey", "a", "b").withColumn("fields", F.array_join("fields", ",")),
    f"""{PAIRS}, n AS (
  SELECT l.o_custkey, count(*) AS left_items, count(r.o_orderkey) AS right_items,
    count(*) = count(DISTINCT l.p) AS p, count(*) = count(DISTINCT l.s) AND count(r.s) = count(DISTINCT r.s) AS s
  FROM l LEFT JOIN r USING (o_custkey, o_orderkey) GROUP BY l.o_custkey)
SELECT o_custkey, '$' AS path, left_items, right_items, concat_ws(',', 'id', CASE WHEN p THEN 'p' END, CASE WHEN s THEN 's' END) AS fields FROM n""",
)


def json_view(s: SparkSession, d: str) -> DataFrame:
    events = s.read.parquet(f"{d}/events.parquet").select("event_id", F.col("props").alias("a"))
    k = F.get_json_object("a", "$.k").cast("long")
    right = F.when(F.col("event_id") % 10 == 0, F.format_string('{"k": %d, "more": 1}', k + 1)).otherwise(F.col("a"))
    return jsondiff.aligned_view(events.withColumn("b", right), "event_id", "a", "b").where("kind <> 'equal'")


add(
    "json_view",
    json_view,
    """
WITH e AS (SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE event_id % 10 = 0)
SELECT event_id, 'changed' AS kind, CAST(2 AS BIGINT) AS left_line, concat('$.k = ', k) AS left_text,
  CAST(2 AS BIGINT) AS right_line, concat('$.k = ', CAST(k AS BIGINT) + 1) AS right_text FROM e
UNION ALL SELECT event_id, 'added', NULL, NULL, 3, '$.more = 1' FROM e
""",
)

# --- excluded keys as a table ----------------------------------------------------------------------------------------


def excluded_keys_table(s: SparkSession, d: str) -> DataFrame:
    """Keys to leave out read from a table: joined, never on the driver."""
    gone = s.read.parquet(f"{d}/orders.parquet").where("o_custkey % 3 = 0").selectExpr("to_json(array(string(o_orderkey))) AS key_json", "'third' AS container", "'sample' AS reason")
    return Comparison(*orders_pair(s, d), CompareConfig(KEY), gone).summary


add("excluded_keys_table", excluded_keys_table, summary_sql(excluded=True).replace(f"({GONE_KEYS})", "(SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 3 = 0)"))


def written_in_key_order(s: SparkSession, d: str) -> DataFrame:
    """Matched keys as written to files: each file's rows and their range of keys, in the order of the files."""
    folder = shared_folder(s, "ordered")
    write_csv(orders(s, d).matched_keys, f"{folder}/keys.csv", "key_json")
    keys = read(s, f"{folder}/keys.csv")
    place = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = keys.groupBy(F.shiftright(ORDER, PLACE_BITS).alias("file")).agg(F.count("*").alias("n"), F.min("key_json").alias("low"), F.max("key_json").alias("high"))
    ordered = files.withColumn("before", F.max("high").over(place))  # one row for each file
    return ordered.agg(F.sum("n").alias("keys"), F.bool_and(F.coalesce(F.col("before") < F.col("low"), F.lit(True))).alias("in_order"))


add("written_in_key_order", written_in_key_order, f"{BASE} SELECT CAST(count(*) AS BIGINT) AS keys, true AS in_order FROM k")

# --- views, budgets, footers -----------------------------------------------------------------------------------------


def json_view_context(s: SparkSession, d: str) -> DataFrame:
    """Seven fields of which one differs: it and two lines on either side."""
    fields = ", ".join(f"o_orderkey + {k} AS f{k}" for k in range(7))
    orders = s.read.parquet(f"{d}/orders.parquet").selectExpr("o_orderkey", f"to_json(struct({fields})) AS a")
    other = F.when(F.col("o_orderkey") % 5 == 0, F.regexp_replace("a", '"f3":', '"f3":1')).otherwise(F.col("a"))
    return jsondiff.context(jsondiff.aligned_view(orders.withColumn("b", other), "o_orderkey", "a", "b"), "o_orderkey")


add(
    "json_view_context",
    json_view_context,
    """
WITH n AS (SELECT unnest(range(1, 6)) AS k)
SELECT o_orderkey, CASE WHEN k = 3 THEN 'changed' ELSE 'equal' END AS kind, k + 2 AS left_line, concat('$.f', k, ' = ', o_orderkey + k) AS left_text,
  k + 2 AS right_line, concat('$.f', k, ' = ', CASE WHEN k = 3 THEN '1' ELSE '' END, o_orderkey + k) AS right_text, CAST(k + 2 AS INTEGER) AS place
FROM orders, n WHERE o_orderkey % 5 = 0
""",
)
add(
    "changed_middle",
    lambda s, d: orders(s, d).differences.withColumn("m", changed_middle(F.col("left_value"), F.col("right_value"))).select("key_json", "column", "m.*"),
    f"""{BASE}, m AS (SELECT *, least(length(left_value), length(right_value)) AS most FROM diff),
p AS (SELECT *, list_max(list_filter(range(0, most + 1), lambda k: left(left_value, k) = left(right_value, k))) AS a FROM m),
q AS (SELECT *, list_max(list_filter(range(0, most - a + 1), lambda k: right(left_value, k) = right(right_value, k))) AS b FROM p)
SELECT key_json, "column", left(left_value, a) AS prefix, substring(left_value, a + 1, length(left_value) - a - b) AS "left",
  substring(right_value, a + 1, length(right_value) - a - b) AS "right", right(left_value, b) AS suffix FROM q""",
)
add(
    "preview_budget",
    lambda s, d: result_preview(orders(s, d).differences, ["key_json", "column"], chars=8, most=900),
    f"""{BASE}, f AS (SELECT key_json[:8] AS key_json, "column"[:8] AS "column", left_value[:8] AS left_value, right_value[:8] AS right_value,
  row_number() OVER (ORDER BY key_json, "column") AS n FROM diff),
g AS (SELECT *, coalesce(sum(length(key_json) + length("column") + length(left_value) + length(right_value)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE n <= 100)
SELECT key_json, "column", left_value, right_value FROM g WHERE before <= 900""",
)
add(
    "parquet_metadata",
    lambda s, d: parquet_metadata(s, f"{d}/orders.parquet").select(F.explode("columns").alias("column"), "rows").groupBy("column").agg(F.sum("rows").alias("rows")),
    "SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderstatus', 'o_totalprice', 'o_orderdate', 'o_orderpriority']) AS \"column\", count(*) AS rows FROM orders",
)

# --- documents as files, places of empty keys, frequent pairs ---------------------------------------------------------


def json_files(s: SparkSession, d: str) -> DataFrame:
    """A JSON file for each hundred customers, written by tasks, read back and paired by name: one file is missing on the right, one on the left."""
    rows = s.read.parquet(f"{d}/customer.parquet").withColumn("n", F.expr("c_custkey div 100"))
    folder = shared_folder(s, "documents")
    for side, segment in (("left", "c_mktsegment"), ("right", "if(c_custkey % 10 = 0, lower(c_mktsegment), c_mktsegment)")):
        item = rows.selectExpr("n", f"struct(c_custkey as id, {segment} as segment) as item").where("n <> 1" if side == "left" else "n <> 0")
        docs = item.groupBy(F.concat(F.col("n") % 7, F.lit("/"), "n", F.lit(".json")).alias("name")).agg(F.to_json(F.struct(F.sort_array(F.collect_list("item")).alias("items"))).alias("text"))
        write_documents(docs, f"{folder}/{side}")
    rules = [jsondiff.ArrayRule("$.items", "keyed", "id")]
    return jsondiff.difference_counts(jsondiff.diff_documents(document_pairs(s, f"{folder}/left", f"{folder}/right"), "name", "a", "b", rules), "name")


add(
    "json_files",
    json_files,
    """
WITH c AS (SELECT c_custkey // 100 AS n, count(*) FILTER (WHERE c_custkey % 10 = 0 AND c_mktsegment <> lower(c_mktsegment)) AS other FROM customer GROUP BY 1)
SELECT concat(n % 7, '/', n, '.json') AS name, CAST(n = 1 AS BIGINT) AS added, CAST(n = 0 AS BIGINT) AS removed, CASE WHEN n > 1 THEN other ELSE 0 END AS changed
FROM c WHERE n < 2 OR other > 0
""",
)


def empty_keys(s: SparkSession, d: str) -> DataFrame:
    """Line items in source order, the part empty on the left and the supplier null on the right for some."""
    lines = s.read.parquet(f"{d}/lineitem.parquet").withColumn(ORDER, F.col("_metadata.row_index"))
    part = "if(l_partkey % 50 = 7, '', string(l_partkey)) as part"
    left = lines.selectExpr(part, "string(l_suppkey) as supplier", "l_returnflag", ORDER)
    right = lines.selectExpr("string(l_partkey) as part", "if(l_suppkey % 8 = 3, null, string(l_suppkey)) as supplier", "l_returnflag", ORDER)
    return Comparison(left, right, CompareConfig(("part", "supplier"))).first_empty_keys


add(
    "empty_keys",
    empty_keys,
    """
WITH l AS (SELECT *, file_row_number + 1 AS n FROM (SELECT *, row_number() OVER () - 1 AS file_row_number FROM lineitem))
SELECT * FROM (SELECT 'left' AS side, n AS record, concat('["","', l_suppkey, '"]') AS key_json FROM l WHERE l_partkey % 50 = 7 ORDER BY n LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'right', n, concat('["', l_partkey, '",null]') FROM l WHERE l_suppkey % 8 = 3 ORDER BY n LIMIT 1)
""",
)
add(
    "top_pairs",
    lambda s, d: analysis.top_pairs(orders(s, d).differences).withColumn("share", F.round("share", 6)),
    f"""{BASE}, p AS (SELECT "column", {PATTERN} AS pattern, left_value, right_value, count(*) AS occurrences FROM diff GROUP BY ALL)
SELECT "column", CAST(row_number() OVER (PARTITION BY "column" ORDER BY occurrences DESC, sha256(left_value), sha256(right_value)) AS INTEGER) AS place, pattern, left_value, right_value, occurrences,
  round(100.0 * occurrences / sum(occurrences) OVER (PARTITION BY "column"), 6) AS share, count(*) OVER (PARTITION BY "column") AS pairs
FROM p QUALIFY place <= 20""",
)
