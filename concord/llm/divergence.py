"""How far each source's wording lies from the other sources of its language: exact sums over wide term vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: What each byte becomes: letters small ones, bytes of other signs than ASCII's themselves, all others blanks.
SIGNS = bytes(c if c > 127 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
#: Different terms that a task counts before it hands them on.
HELD_TERMS = 200_000
LEAST_DOCS, SMOOTH, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: (lang, source) groups whose totals are broadcast to the terms, some 50 bytes each; more are joined by shuffle.
BROADCAST_GROUPS = 200_000


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, used, docs): occurrences and documents of a source's terms, parted by task. A row without a term says that the source is there.
    On UTF-8 bytes a term is a run of letters and of bytes above 127: other bytes become blanks, and split() does the rest."""
    rows = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")], F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (used, seen) in held.items():
                n = len(used) + 1
                term = pa.array([None, *used], pa.binary()).cast(pa.string())
                counts = [np.fromiter((0, *c), np.int64, n) for c in (used.values(), (seen[t] for t in used))]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), term, *map(pa.array, counts)], names)

        for b in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                terms = text.translate(SIGNS).split()
                used, seen = held.setdefault((lang, source), (Counter(), Counter()))
                used.update(terms)
                seen.update(set(terms))
            if sum(len(u) for u, _ in held.values()) > HELD_TERMS:
                yield from out()
                held.clear()
        yield from out()

    names = ["lang", "source", "term", "used", "docs"]
    return rows.mapInArrow(each, "lang string, source string, term string, used long, docs long")


def term_vectors(docs: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, term, entries): a language's kept terms with the sources that use them and how often. The row without a
    term lists all sources of the language."""
    counts = term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("used").alias("used"), F.sum("docs").alias("docs"))
    wide = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "used")).alias("entries"))
    return wide.where(F.col("term").isNull() | (F.col("docs") >= least_docs)).select("lang", "term", "entries")


def totals(wide: DataFrame) -> DataFrame:
    """(lang, sources, terms, sums, total): a language's sources in order, its number of kept terms, their occurrences by source and in all."""
    sources = wide.where("term is null").select("lang", F.expr("array_sort(transform(entries, e -> e.source)) as sources"))
    used = wide.where("term is not null").select("lang", F.explode("entries").alias("e")).groupBy("lang", "e.source").agg(F.sum("e.used").alias("n"))
    by_source = used.groupBy("lang").agg(F.map_from_entries(F.collect_list(F.struct("source", "n"))).alias("n"), F.sum("n").alias("total"))
    terms = wide.where("term is not null").groupBy("lang").agg(F.count("*").alias("terms"))
    joined = sources.join(terms, "lang", "left").join(by_source, "lang", "left")
    return joined.selectExpr("lang", "sources", "coalesce(terms, 0L) as terms", "transform(sources, s -> coalesce(n[s], 0L)) as sums", "coalesce(total, 0L) as total")


def share(count: str, total: str, smooth: int, scale: int) -> str:
    """1 + floor(scale * (count + smooth) / (total + smooth * terms)), exact: the product is a decimal of 38 digits."""
    return f"1 + (cast({scale} as decimal(18,0)) * cast({count} + {smooth} as decimal(20,0))) div ({total} + {smooth} * terms)"


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, smooth: int = SMOOTH, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): for each source of a language, part `pair` is its distance from every other
    source, part `term` are its `top` terms above the language's share.

    Null text, lang and source count as empty text, which is a language or source like any other. A source without terms has count 0 of each;
    a language without kept terms gives pairs of value 0 and no terms; a language of one source gives no pairs. Repeated documents count
    as often as they are there. No rows: no rows. Only text, lang and source are read.
    A term's vector is as wide as its language has sources; sources of one language must fit in a row, and its pairs are the result.
    """
    wide = written(term_vectors(docs, least_docs))
    stats = written(totals(wide))
    groups = stats.agg(F.sum(F.size("sources"))).first()[0] or 0
    near = F.broadcast(stats) if groups <= BROADCAST_GROUPS else stats
    vectors = wide.where("term is not null").withColumn("used", F.expr("map_from_entries(entries)")).join(near, "lang")
    vectors = vectors.selectExpr("lang", "term", "sources", "terms", "sums", "total", "transform(sources, s -> coalesce(used[s], 0L)) as counts")
    shares = vectors.selectExpr(
        "lang", "term", "sources", "counts", f"transform(counts, (c, k) -> {share('c', 'sums[k]', smooth, scale)}) as p",
        f"{share('aggregate(counts, 0L, (a, c) -> a + c)', 'total', smooth, scale)} as q",
    )
    gaps = shares.where("size(p) > 1").select("lang", F.expr("""explode(flatten(transform(sequence(1, size(p) - 1), i ->
        transform(sequence(0, i - 1), j -> struct(i, j, abs(p[i] - p[j]) as f))))) as g"""))
    sums = gaps.groupBy("lang", "g.i", "g.j").agg(F.sum("g.f").alias("value"))
    named = sums.join(near.select("lang", "sources"), "lang").selectExpr("lang", "explode(array(struct(sources[i] as source, sources[j] as item), struct(sources[j] as source, sources[i] as item))) as n", "value")
    bare = stats.where("terms = 0 and size(sources) > 1").selectExpr("lang", "explode(sources) as source", "sources").selectExpr("lang", "source", "explode(filter(sources, s -> s <> source)) as item", "0L as value")
    pairs = named.selectExpr("lang", "n.source", "n.item", "value").union(bare)
    above = shares.select("lang", "term", F.expr("""explode(filter(transform(p, (x, k) ->
        struct(sources[k] as source, counts[k] as used, x - q as f)), s -> s.used > 0 and s.f > 0)) as s""")).selectExpr("lang", "s.source", "term as item", "s.f as value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", rank)
    return part(pairs, "pair").union(part(above, "term").where(F.col("rank") <= top))
