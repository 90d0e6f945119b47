"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A document's expected copies are its source's target over its source's size. Its source's documents are laid on a number line, each as long as its expected copies; the
line is shifted by one pseudo-random offset of the source, and a document is emitted once for each integer boundary in its stretch. The line's order is that of
size, then a fixed pseudo-random one: as stretches run over sizes in order, gains and losses of neighbours cancel but for the difference of their sizes, and what a source
emits differs from its target by less than its largest document.

Where a source has documents of more than 1/LONG of its target, that is not near enough. These then come first on the line, and the stretches of the others share what the emitted
long ones leave of the target; over offsets the expected copies of each document are still target over size, unless the others can't make up for a long one even
with no or with `most` copies each. So a source differs from its target by a 50th at most where that is possible at all.

Prefix sums are ranks times the expected copies. They come from counts of (source, size, bucket), so that neither a hot source nor a hot size meets in
one task: equal sizes are dealt over about the square root of their number of buckets, and a task ranks one bucket. The window over
counts of one source has a row for each distinct size and bucket, not for each document. Sources may be as many as documents: their places come from ranges, and
the level of their targets from a few sums over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, numbered

_WORD = r"[^\x20\x09-\x0D]+"
#: A document of more than a 50th of its source's target is long.
LONG = 50
#: Sources of which a row each is broadcast; of more sources those that hold more than one in so many rows, which are fewer than that.
MOST_BROADCAST = 10_000
#: Sources whose places one task finds.
RANGE_ROWS = 100_000


def _size() -> Column:
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(_WORD)), F.lit(0)).cast("long")


def _digest(text: Column) -> Column:
    """32 bits of the MD5 of a text."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def _places(totals: DataFrame, range_rows: int) -> DataFrame:
    """totals (source, ...) with place: the number from 0 of a source in code-point order, null last. A task orders one range of sources."""
    spark = totals.sparkSession
    parts = max(1, -(-totals.count() // range_rows))
    ranged = checkpointed(totals.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts, starts, seen = sorted((r.part, r["count"]) for r in ranged.groupBy("part").count().collect()), [], 0
    for part, n in counts:
        starts.append((part, seen))
        seen += n
    own = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    before = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    return ranged.withColumn("own", own).join(before, "part").withColumn("place", F.col("before") + F.col("own") - 1).drop("part", "own", "before")


def source_targets(sizes: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, range_rows: int = RANGE_ROWS) -> DataFrame:
    """sizes (source, size) to a row (source, source_size, n_docs, target) for each source.

    Sources in code-point order, null last, take the weights of `cycle` in turn and share the sum of all sizes; a target stops at `most` times
    its source's size and the excess goes to the others by weight: targets are least(cap, level * weight) for one level. The level rises as
    more sources are found to be capped below it, until no more are; each step is a sum over the sources.
    A source of size 0 has target 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("n_docs"))
    placed = _places(totals, range_rows)
    weight = F.element_at(F.array(*map(F.lit, cycle)), (F.pmod("place", F.lit(len(cycle))) + 1).cast("int")).cast("long")
    placed = checkpointed(placed.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")))
    every, weights = placed.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    capped, light, level = 0, 0, 0.0
    while weights > light:
        level = (every - capped) / (weights - light)
        below = F.col("cap") < F.lit(level) * F.col("weight")
        now = placed.where(below).agg(F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
        if now[1] <= light:
            break
        capped, light = now
    target = F.least(F.col("cap").cast("double"), F.lit(float(level)) * F.col("weight"))
    return placed.select("source", "source_size", "n_docs", target.cast("double").alias("target"))


def _with_sources(rows: DataFrame, few: DataFrame, most_broadcast: int) -> DataFrame:
    """rows (source, ...) with the columns of few (s, n_docs, ...). A hot source's rows stay where they are: its row of few is broadcast, among at most most_broadcast others."""
    same = F.col("source").eqNullSafe(F.col("s"))
    if few.count() <= most_broadcast:
        return rows.join(F.broadcast(few), same).drop("s", "n_docs")
    hot = few.where(F.col("n_docs") * most_broadcast > rows.count())
    met = rows.join(F.broadcast(hot), same, "left")
    rest = met.where("n_docs is null").select(*rows.columns)
    return met.where("n_docs is not null").unionByName(rest.join(few.join(hot.select("s"), "s", "left_anti"), same)).drop("s", "n_docs")


def mix_sources(docs: DataFrame, cycle: tuple[int, ...] = (1, 2, 3), most: int = 3, seed: str = "", row: str | None = None, most_broadcast: int = MOST_BROADCAST, range_rows: int = RANGE_ROWS) -> DataFrame:
    """docs (doc_id, text, source, ...) to a row (doc_id, source, size, source_size, target, copies) for each; with `row`, the name of a column that numbers rows, also that.

    size: words of the text (null or empty: 0). copies: times that the mix emits the document, at most `most`, and its source's target over its source's size on average over
    offsets. Null sources are one source; rows that repeat a doc_id each count. The offset of a source is made from its name and seed and the order of its
    documents from doc_id and seed (rows without one: from their text), so reruns agree. Other columns are not read.
    """
    own = [F.col(row)] if row else []
    known = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("/"), F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    sizes = checkpointed(docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), _digest(F.concat(F.lit(seed), known)).alias("__digest"), *own))
    few = checkpointed(source_targets(sizes, cycle, most, range_rows).withColumnRenamed("source", "s"))
    # counts of (source, size, bucket) give every document its place on its source's line
    group = ["source", "size"]
    same = sizes.groupBy(*group).agg(F.ceil(F.sqrt(F.count("*"))).cast("long").alias("buckets")).withColumnsRenamed({"source": "s", "size": "z"})
    alike = F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z"))
    dealt = sizes.join(same, alike).withColumn("chunk", F.pmod("__digest", "buckets")).drop("s", "z", "buckets")
    counts = _with_sources(dealt.groupBy(*group, "chunk").agg(F.count("*").alias("n")), few, most_broadcast).withColumn("long", F.col("size") * LONG > F.col("target"))
    before = Window.partitionBy("source").orderBy(F.col("long").desc(), "size", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("chunk").alias("c"), "long", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = dealt.withColumn("own", F.row_number().over(Window.partitionBy(*group, "chunk").orderBy("doc_id")))
    placed = ranked.join(offsets, alike & (F.col("chunk") == F.col("c"))).withColumn("rank", F.col("before") + F.col("own"))
    placed = checkpointed(placed.select("doc_id", "source", "size", "long", "rank", *([row] if row else [])))

    shift = _digest(F.concat(F.lit(f"{seed}/"), F.coalesce("source", F.lit("")))) / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    emitted = F.least(F.floor(shift + rate * F.col("rank")) - F.floor(shift + rate * (F.col("rank") - 1)), F.lit(most)).cast("long")
    first = _with_sources(placed.where("long"), few, most_broadcast).withColumn("taken", emitted * F.col("size"))
    first = first.groupBy("source").agg(F.count("*").alias("long_docs"), F.sum("size").alias("long_size"), F.sum("taken").alias("long_taken")).withColumnRenamed("source", "f")
    known = few.join(first, F.col("s").eqNullSafe(F.col("f")), "left").drop("f").fillna(0, ["long_docs", "long_size", "long_taken"])
    left = F.col("source_size") - F.col("long_size")
    others = F.when(F.col("long_docs") == 0, rate).when(left > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), (F.col("target") - F.col("long_taken")) / left))).otherwise(F.lit(0.0))
    known = checkpointed(known.select("s", "n_docs", "source_size", "target", "long_docs", rate.alias("rate"), others.alias("others")))
    drawn = _with_sources(placed, known, most_broadcast)
    end = F.when(F.col("long"), F.col("rate") * F.col("rank")).otherwise(F.col("rate") * F.col("long_docs") + F.col("others") * (F.col("rank") - F.col("long_docs")))
    start = F.when(F.col("long"), F.col("rate") * (F.col("rank") - 1)).otherwise(F.col("rate") * F.col("long_docs") + F.col("others") * (F.col("rank") - 1 - F.col("long_docs")))
    copies = F.least(F.floor(shift + end) - F.floor(shift + start), F.lit(most)).cast("long")
    return drawn.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), *([row] if row else []))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The documents of the mix: each row of docs as often as it is emitted, with its number from 1 in copy_no (which replaces a column of that name)."""
    rows = numbered(docs).drop("copy_no")
    copies = mix_sources(rows, row="__row", **how).where("copies > 0").select("__row", F.col("copies").alias("__copies"))
    every = F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies")))
    return rows.join(copies, "__row").withColumn("copy_no", every).select(*(c for c in docs.columns if c != "copy_no"), "copy_no")
