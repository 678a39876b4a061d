"""Keyed comparison of two text tables: exclusion, duplicates, full join, unequal cells, acceptance, totals."""

from __future__ import annotations

import json
from dataclasses import replace
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CompareConfig, align_headers, check, rename
from ..functions.texts import accepted_by, shown
from ..scratch import shared_folder
from ..sources.source import CHUNK, ORDER, PACKED, Source, listed, literal
from ..sources.texts import fingerprint


def key_json(keys: tuple[str, ...] | list[str]) -> Column:
    """A key as one text that is never null: the compact JSON array of its parts."""
    return F.to_json(F.array(*[F.col(f"`{k}`") for k in keys]))


#: Changed keys that are broadcast to the sources when their payloads are fetched (some 100 bytes each); more are joined by shuffle.
BROADCAST_KEYS = 100_000
#: A source of at most so many bytes, by Spark's own estimate, is compared in one pass, whole rows at once.
CARRIED_BYTES = 32 << 20
#: The cells of a row that differ: both arrays are as long.
UNEQUAL = "filter(transform(lv, (x, i) -> struct(i as pos, x as a, rv[i] as b)), c -> not (c.a <=> c.b))"


class Comparison:
    """A comparison as lazy DataFrames. A source is a Source, or any table of text columns with or without ORDER.

    Large sources: keys travel alone first. Each row becomes its key, its source order and 128 bits of hash of each 64 of its compared
    columns, so duplicates, the full join and all totals of keys shuffle narrow rows only. What is known of each key is written to the
    shared folder at the first use. The columns are read again for keys whose hashes differ, of chunks that differ for
    some key, and only their rows are shuffled, compared cell by cell and judged: each source is scanned twice. Small
    sources (CARRIED_BYTES) are compared in one pass that takes the columns along. The results are the same.
    """

    def __init__(self, left: Source | DataFrame, right: Source | DataFrame, config: CompareConfig, exclusions: DataFrame | None = None):
        """exclusions: (key_json, container, reason), keys to leave out beside the containers of config; any number."""
        sides = [x if isinstance(x, Source) else Source.of(x) for x in (left, right)]
        self.config, self.spark, self._more = config, sides[0].rows.sparkSession, exclusions
        names = [list(x.names) for x in sides]
        self.header_changes: list[list[tuple[int, str, str]]] = [[], []]
        if config.header_layout:
            for k, layout in enumerate(config.header_layout):
                names[k], self.header_changes[k] = rename(names[k], layout)
        names[1] = align_headers(*names)
        self.columns = check(config, *names)
        self.carried = all(_bytes(x.rows) <= CARRIED_BYTES for x in sides)
        self.left, self.right = (self._ordered(x).named(n) for x, n in zip(sides, names, strict=True))
        self.unmatched = [[c for c in n if c not in set(names[1 - k])] for k, n in enumerate(names)]
        same = not self.left.fields and not self.right.fields and names[0] == names[1]
        self._unparted = same and len(self.columns) + len(config.keys) == len(names[0])

    def _ordered(self, source: Source) -> Source:
        """Rows without an order get one by their place in the plan. What is read twice is written first: a second run may split otherwise."""
        if ORDER in source.rows.columns:
            return source
        rows = source.rows.withColumn(ORDER, F.monotonically_increasing_id())
        if not self.carried:
            folder = shared_folder(self.spark, "ordered")
            rows.write.parquet(folder)
            rows = self.spark.read.schema(rows.schema).parquet(folder)
        return replace(source, rows=rows)

    @cached_property
    def exclusions(self) -> DataFrame:
        """(key_json, container, reason), every membership kept."""
        rows = [(list(k), c.name, c.reason) for c in self.config.containers for k in c.keys]
        df = listed(self.spark, rows, k="array<string>", container="string", reason="string").select(F.to_json("k").alias("key_json"), "container", "reason")
        return df if self._more is None else df.union(self._more.select("key_json", "container", "reason"))

    @property
    def exclusion_audit(self) -> DataFrame:
        """(container, reason, key_json, left_rows, right_rows): what each membership takes out of either side."""
        rows = self.joined.select("key_json", F.coalesce("ln", F.lit(0)).cast("long").alias("left_rows"), F.coalesce("rn", F.lit(0)).cast("long").alias("right_rows"))
        out = self.exclusions.join(rows, "key_json", "left")
        return out.select("container", "reason", "key_json", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("left_rows", "right_rows")])

    def _keyed(self, source: Source, *columns: str) -> DataFrame:
        """(key_json, ord, columns in SQL) of a source's rows. An excluded key has no empty part, so all rows are asked for theirs."""
        parts = [source.cell(k) for k in source.at(self.config.keys)]
        key = "to_json(array(" + ", ".join(parts) + ")) as key_json"
        if self.config.allow_empty_keys:
            return source.rows.selectExpr(key, f"{ORDER} as ord", *columns)
        whole = " and ".join(f"coalesce({p} <> '', false)" for p in parts)
        rows = source.rows.selectExpr(key, f"{ORDER} as ord", f"{whole} as whole", *columns)
        return rows.where(F.expr("assert_true(whole, concat('a key part is empty, in file ', string(shiftright(ord, 44)), ' at place ', string(ord & 17592186044415L))) is null")).drop("whole")

    @property
    def first_empty_keys(self) -> DataFrame:
        """(side, record, key_json) of each side's first row, if any, with a null or empty key part; record counts its rows from 1 in source
        order. What a failed run asks for: a look for the row, and a count of those before it."""
        out = []
        for side, source in (("left", self.left), ("right", self.right)):
            parts = [source.cell(k) for k in source.at(self.config.keys)]
            keys = source.rows.selectExpr("to_json(array(" + ", ".join(parts) + ")) as key_json", f"{ORDER} as ord", " and ".join(f"coalesce({p} <> '', false)" for p in parts) + " as whole")
            first = keys.where("not whole").agg(F.min("ord").alias("at"), F.min_by("key_json", "ord").alias("key_json")).where("at is not null")
            before = source.rows.select(ORDER).join(F.broadcast(first), F.col(ORDER) <= F.col("at"))  # one row
            out.append(before.groupBy("at", "key_json").agg(F.count("*").alias("record")).select(F.lit(side).alias("side"), "record", "key_json"))
        return out[0].union(out[1])

    def _grouped(self) -> DataFrame:
        """(key_json, ln, lat, ..., rn, rat, ...): a key's occurrences on each side, the order of the row that counts, and its cells as an array (v) or
        the hashes of its chunks (h), two numbers each; of one chunk as two columns, which need no sorting to be grouped. The full join is one
        grouping of both sides' rows, combined before the only shuffle."""
        pick, end = ("min_by", "min") if self.config.duplicate_policy == "first" else ("max_by", "max")
        rows, names = [], ["v"]
        for left, source in ((True, self.left), (False, self.right)):
            places = source.at(self.columns)
            given = [source.cells(places)] if self.carried else source.hashes(places, self._unparted)
            if not self.carried:
                names = ["h1", "h2"] if len(given) == 2 else ["h"]
                given = given if len(given) == 2 else ["array(" + ", ".join(given) + ")"]
            rows.append(self._keyed(source, *[f"{g} as {n}" for g, n in zip(given, names, strict=True)], f"{str(left).lower()} as is_left"))
        kept = []
        for s, of in (("l", "is_left"), ("r", "not is_left")):
            kept += [f"nullif(count_if({of}), 0L) as {s}n", f"{end}(ord) filter (where {of}) as {s}at", *[f"{pick}({c}, ord) filter (where {of}) as {s}{c}" for c in names]]
        return rows[0].union(rows[1]).groupBy("key_json").agg(*map(F.expr, kept))

    @cached_property
    def joined(self) -> DataFrame:
        """(key_json, gone, ln, lat, ..., rn, rat, ...): what is known of a key on each side, null where a side lacks it. gone: it is excluded."""
        both = self._grouped()
        if "lh1" in both.columns:
            both = both.select("key_json", *[c for s in "lr" for c in (f"{s}n", f"{s}at", F.array(f"{s}h1", f"{s}h2").alias(f"{s}h"))])
        if self.config.containers or self._more is not None:
            both = both.join(self.exclusions.select("key_json").distinct().withColumn("gone", F.lit(True)), "key_json", "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
        else:
            both = both.withColumn("gone", F.lit(False))
        if self.carried:
            return both
        folder = shared_folder(self.spark, "keys")
        both.write.parquet(folder)
        return self.spark.read.schema(both.schema).parquet(folder)

    @property
    def _known(self) -> DataFrame:
        return self.joined.where("not gone")

    @property
    def _matched(self) -> DataFrame:
        return self._known.where("ln is not null and rn is not null")

    @property
    def matched_keys(self) -> DataFrame:
        return self._matched.select("key_json")

    @property
    def left_only(self) -> DataFrame:
        return self._known.where("rn is null").select("key_json")

    @property
    def right_only(self) -> DataFrame:
        return self._known.where("ln is null").select("key_json")

    def _payload(self, side: str, wanted: DataFrame, columns: list[str]) -> DataFrame:
        """(key_json, the side's texts in some columns) of wanted keys, from the row that counts."""
        source = self.left if side == "l" else self.right
        cells = f"{source.cells(source.at(columns))} as {side}v"
        if source.fields:
            rows = self._keyed(source, cells)
            return rows.join(wanted, "key_json").where(f"{side}n = 1 or ord = {side}at").select("key_json", f"{side}v")
        at = wanted.select("key_json", F.col(f"{side}at").alias(ORDER))  # a packed row's place is its own
        return source.rows.select(ORDER, PACKED).join(at, ORDER).selectExpr("key_json", cells)

    @cached_property
    def raw_differences(self) -> DataFrame:
        """(key_json, column, left_value, right_value): every unequal cell of a matched key."""
        columns, both = self.columns, None
        if self.carried:
            both = self._matched.where("not (lv <=> rv)").select("key_json", "lv", "rv")
        else:
            changed = self._matched.where("not (lh <=> rh)").select("key_json", "ln", "lat", "rn", "rat", "lh", "rh")
            chunk = "filter(transform(lh, (x, i) -> if(x <> rh[i], int(i div 2), -1)), i -> i >= 0)"
            parts = {r.chunk: r.n for r in changed.selectExpr(f"explode(array_distinct({chunk})) as chunk").groupBy("chunk").agg(F.count("*").alias("n")).collect()}
            if self.left.fields and self.right.fields:  # of one text a column cannot be read alone
                columns = [c for k in sorted(parts) for c in self.columns[k * CHUNK : (k + 1) * CHUNK]]
            wanted = changed.drop("lh", "rh")
            small = sum(parts.values()) <= BROADCAST_KEYS or wanted.count() <= BROADCAST_KEYS
            wanted = F.broadcast(wanted) if small else wanted
            both = self._payload("l", wanted, columns).join(self._payload("r", wanted, columns), "key_json")
        names = F.expr(f"from_json({literal(json.dumps(columns, ensure_ascii=False))}, 'array<string>')")
        cells = both.selectExpr("key_json", f"explode({UNEQUAL}) as c")
        return cells.select("key_json", names[F.col("c.pos")].alias("column"), F.col("c.a").alias("left_value"), F.col("c.b").alias("right_value"))

    def store(self, folder: str) -> None:
        """Writes the joined keys and the unequal cells as Parquet below the folder, once; from then on everything is
        derived from these files instead of the sources."""
        paths = [x.path for x in (self.left, self.right) if x.path]
        if paths:  # before anything is read: a later change shows
            reduce(DataFrame.union, [fingerprint(self.spark, p).withColumn("source", F.lit(p)) for p in paths]).write.mode("overwrite").parquet(f"{folder}/sources")
        keys = self.joined.select("key_json", "gone", "ln", "lat", "rn", "rat")
        for name, df in (("raw_differences", self.raw_differences), ("joined", keys)):
            df.write.mode("overwrite").parquet(f"{folder}/{name}")
        for name, df in (("raw_differences", self.raw_differences), ("joined", keys)):
            setattr(self, name, self.spark.read.schema(df.schema).parquet(f"{folder}/{name}"))

    def judged(self, raw: DataFrame | None = None, config: CompareConfig | None = None) -> DataFrame:
        """raw_differences with accepted: 'override', 'rule' or null. Overrides come first."""
        config, raw = config or self.config, self.raw_differences if raw is None else raw
        names = raw.columns
        a, b, column = F.col("left_value"), F.col("right_value"), F.col("column")
        if config.overrides:
            pairs = listed(self.spark, sorted({(o.column, o.left, o.right) for o in config.overrides}), column="string", left_value="string", right_value="string")
            raw = raw.join(F.broadcast(pairs.withColumn("by_override", F.lit(True))), ["column", "left_value", "right_value"], "left")
        else:
            raw = raw.withColumn("by_override", F.lit(None).cast("boolean"))
        how = F.when(F.col("by_override"), "override").when(accepted_by(config.rules, column, a, b), "rule")
        return raw.select(*names, how.alias("accepted"))

    @property
    def differences(self) -> DataFrame:
        """The unequal cells that nothing accepts, as shown."""
        return self.judged().where("accepted is null").select("key_json", "column", shown(F.col("left_value")).alias("left_value"), shown(F.col("right_value")).alias("right_value"))

    @property
    def duplicates(self) -> DataFrame:
        """(side, key_json, occurrences, skipped_rows, kept_occurrence)."""
        sides = [self._known.where(f"{n} > 1").select(F.lit(s).alias("side"), "key_json", F.col(n).alias("occurrences")) for s, n in (("left", "ln"), ("right", "rn"))]
        every = sides[0].union(sides[1])
        kept = F.lit(1).cast("long") if self.config.duplicate_policy == "first" else F.col("occurrences")
        return every.select("side", "key_json", "occurrences", (F.col("occurrences") - 1).alias("skipped_rows"), kept.alias("kept_occurrence"))

    @property
    def first_duplicates(self) -> DataFrame:
        """(side, key_json, occurrences, place, values): of each side's smallest repeated key the first three rows, of
        20 columns at most, each value shown and cut to 500 characters."""
        out = []
        names = self.columns[:20]
        for side, n, df in (("left", "ln", self.left), ("right", "rn", self.right)):
            first = self._known.where(f"{n} > 1").select("key_json", F.col(n).alias("occurrences")).orderBy("key_json").limit(1)
            rows = self._keyed(df, f"{df.cells(df.at(names))} as v").join(F.broadcast(first), "key_json")  # one row
            top = rows.orderBy("ord").limit(3).withColumn("values", F.transform("v", lambda x: F.substring(shown(x), 1, 500)))
            out.append(top.select(F.lit(side).alias("side"), "key_json", "occurrences", F.row_number().over(Window.orderBy("ord")).alias("place"), "values"))  # of three rows
        return out[0].union(out[1])

    @property
    def column_counts(self) -> DataFrame:
        """(column, mismatches), columns without any included."""
        counts = self.judged().where("accepted is null").groupBy("column").agg(F.count("*").alias("n"))
        every = listed(self.spark, [(c,) for c in self.columns], column="string")
        return every.join(counts, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("mismatches"))

    @property
    def summary(self) -> DataFrame:
        """One row of totals. Carried rows are taken once: each key's row meets its unequal cells in one pass."""
        if self.carried and "lv" in self.joined.columns:
            per_key = self._judged_with_keys()
        else:
            cells = self.judged().groupBy("key_json").agg(*self._counts())
            per_key = self.joined.select("key_json", "gone", "ln", "rn").join(cells, "key_json", "left")
        total = lambda c: F.coalesce(F.sum(c), F.lit(0))
        ln, rn, known = F.col("ln"), F.col("rn"), ~F.col("gone")
        side = lambda c: F.when(known, c)
        s = per_key.agg(
            total("ln").alias("left_rows"), total("rn").alias("right_rows"), F.count_if(known & ln.isNotNull() & rn.isNotNull()).alias("matched_keys"), F.count_if(F.col("cells") > 0).alias("changed_rows"),
            total("cells").alias("changed_cells"), F.count_if(known & rn.isNull()).alias("left_only"), F.count_if(known & ln.isNull()).alias("right_only"), total("o").alias("override_equivalent_cells"), total("r").alias("rule_equivalent_cells"),
            F.count_if(known & (ln > 1)).alias("left_duplicate_keys"), F.count_if(known & (rn > 1)).alias("right_duplicate_keys"), total(side(ln - 1)).alias("left_duplicate_rows_skipped"), total(side(rn - 1)).alias("right_duplicate_rows_skipped"),
            total(F.when(~known, ln)).alias("left_excluded_rows"), total(F.when(~known, rn)).alias("right_excluded_rows"),
        )
        return s.select(
            "left_rows", "right_rows", "matched_keys", (F.col("matched_keys") - F.col("changed_rows")).alias("equal_rows"), "changed_rows", "changed_cells", "left_only", "right_only", "override_equivalent_cells", "rule_equivalent_cells",
            "left_duplicate_keys", "right_duplicate_keys", "left_duplicate_rows_skipped", "right_duplicate_rows_skipped", "left_excluded_rows", "right_excluded_rows",
            *[(F.col(f"{x}_rows") - F.col(f"{x}_excluded_rows") - F.col(f"{x}_duplicate_rows_skipped")).alias(f"{x}_compared_rows") for x in ("left", "right")],
        )

    @staticmethod
    def _counts() -> list[Column]:
        there = F.col("column").isNotNull()
        return [F.count_if(c).alias(n) for n, c in (("cells", there & F.col("accepted").isNull()), ("o", F.col("accepted") == "override"), ("r", F.col("accepted") == "rule"))]

    def _judged_with_keys(self) -> DataFrame:
        """(key_json, gone, ln, rn, cells, o, r): every key with the counts of its cells."""
        names = F.expr(f"from_json({literal(json.dumps(self.columns, ensure_ascii=False))}, 'array<string>')")
        differ = f"if(gone or ln is null or rn is null or lv <=> rv, null, {UNEQUAL})"
        cells = self.joined.selectExpr("key_json", "gone", "ln", "rn", f"explode_outer({differ}) as c")
        raw = cells.select("key_json", "gone", "ln", "rn", names[F.col("c.pos")].alias("column"), F.col("c.a").alias("left_value"), F.col("c.b").alias("right_value"))
        return self.judged(raw).groupBy("key_json").agg(F.first("gone").alias("gone"), F.first("ln").alias("ln"), F.first("rn").alias("rn"), *self._counts())


def _bytes(df: DataFrame) -> int:
    """The size of a table as Spark estimates it, of files by what they hold."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
