"""Document fingerprints by invertible Bloom lookup sketches, in DataFrame operations only.

A text is the set of its paragraph digests: each line, cut after the first sentence end past 64 characters, hashed to 64 bits. A sketch is three
tables of cells; a digest goes to one cell of each, which holds a count, the XOR of digests and the XOR of their checks. Two sketches of one size
subtract cell by cell; what both texts have cancels out, and peeling (a cell of count 1 or -1 whose check fits gives a digest, which
then leaves its other cells) recovers the differing digests. Where peeling gets stuck it is retried with larger sketches and other hashes until it doesn't.

The fingerprint is a text's sketch as text. Its tables have a power of two of cells, half as many as digests or more: what an edit of a part of a text changes can be peeled
from them. A larger sketch folds to a smaller one's size, so any two fingerprints can be compared, and the likeness of two texts is
told from what peeling their fingerprints' difference recovers. Texts that differ in more, such as unrelated ones, get stuck and are retried with as many cells in each table as both have
digests, then four times as many, and so on.

Cells are rows and only occupied cells are kept. Texts are shuffled once, by ranges of ids; all cells of a text stay in its task, and rounds of
peeling are aggregations that need no shuffle, the first retry's too. What goes with a text (its id, strings, digests) travels beside its cells as a row with `meta`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, scratch, shuffle_partitions

PIECE = r"[^\n]{64,}?[.!?]+|[^\n]+"
#: Least cells of a table; rounds of peeling, each of which takes the pure cells of one table.
TABLES, LEAST, ROUNDS = 3, 8, 6
#: Retries after the first one before it counts as an error; each has four times the cells.
RETRIES = 12
#: Stuck comparisons that are few enough to broadcast; beyond that they are joined by a shuffle.
FEW = 1000


def paragraph_digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's pieces; null and empty texts have none."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), F.lit(0)), lambda p: F.xxhash64(p)))


def table_cells(digests: Column) -> Column:
    """Cells of each table for so many digests: a power of two, half of them at least."""
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(LEAST), F.ceil(digests / 2))))).cast("int")


def _place(k: Column, table: Column, size: Column, seed: int) -> Column:
    return (F.pmod(F.xxhash64(k, table.cast("int"), F.lit(seed)), size.cast("long")) + table * size).cast("int")


def _folded(at: Column, size: Column, to: Column) -> Column:
    """The cell of a smaller power of two that a cell's digests would be in."""
    return (F.floor(at / size) * to + F.pmod(at % size, to)).cast("int")


def _check(k: Column) -> Column:
    return F.hash(k, F.lit("check"))


#: Cells below 0: digests that were recovered, only in the first text or only in the second, and what goes with a text.
ONLY_FIRST, ONLY_SECOND, META = -1, -2, -3
_KEPT = "n != 0 or k != 0 or h != 0 or at < 0"


def _summed(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by, "kind", "size", "at", "digest", "meta").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("h").alias("h")).where(_KEPT)


def sketch_cells(items: DataFrame, by: list[str], seed: int = 0) -> DataFrame:
    """items (*by, kind, size, k, n, meta) to cells (*by, kind, size, at, digest, meta, n, k, h): digest k goes n times (-1: is subtracted) to a cell of each table.

    Adding the digests of one text with n = 1 and of another with n = -1 under one kind is the subtraction of their sketches. Empty cells aren't kept. An item with meta is
    no digest and goes along as one row.
    """
    tables = F.when(F.col("meta").isNull(), F.array(*map(F.lit, range(TABLES)))).otherwise(F.array(F.lit(META)))
    spread = items.select(*by, "kind", "size", "k", "n", "meta", F.explode(tables).alias("table"))
    at = F.when(F.col("table") < 0, F.col("table")).otherwise(_place(F.col("k"), F.col("table"), F.col("size"), seed))
    return _summed(spread.select(*by, "kind", "size", at.alias("at"), F.lit(0).cast("long").alias("digest"), "meta", "n", "k", _check(F.col("k")).alias("h")), by)


def peel(cells: DataFrame, by: list[str], seed: int = 0, rounds: int = ROUNDS) -> DataFrame:
    """cells after `rounds` rounds of peeling; a round takes the pure cells of one table, so no digest is taken twice.

    Each recovered digest is a row with at ONLY_FIRST or ONLY_SECOND. Cells with at >= 0 that are left mean that peeling got stuck.
    """
    for r in range(rounds):
        t = r % TABLES
        pure = (F.col("at") >= t * F.col("size")) & (F.col("at") < (t + 1) * F.col("size")) & (F.abs("n") == 1) & (F.col("h") == _check(F.col("k")))
        zero = F.lit(0).cast("long")
        cell = lambda at, digest, n, k, h: F.struct(at.cast("int").alias("at"), digest.alias("digest"), n.cast("int").alias("n"), k.alias("k"), h.alias("h"))
        others = [cell(_place(F.col("k"), F.lit(j), F.col("size"), seed), zero, -F.col("n"), F.col("k"), F.col("h")) for j in range(TABLES) if j != t]
        said = cell(F.when(F.col("n") > 0, F.lit(ONLY_FIRST)).otherwise(F.lit(ONLY_SECOND)), F.col("k"), F.lit(1), zero, F.lit(0))
        out = F.when(pure, F.array(*others, said)).otherwise(F.array(cell(F.col("at"), F.col("digest"), F.col("n"), F.col("k"), F.col("h"))))
        cells = _summed(cells.select(*by, "kind", "size", "meta", F.explode(out).alias("c")).select(*by, "kind", "size", "meta", "c.*"), by)
    return cells


def differing_digests(pairs: DataFrame, by: list[str], room: float = 1.0, rounds: int = ROUNDS, first_seed: int = 0) -> DataFrame:
    """pairs (*by, first array<long>, second array<long>), distinct in by, to (*by, only_first, only_second): the digests that only one of two versions has.

    Sketches have `room` cells in each table for each digest of both; what gets stuck is retried with four times as many until nothing does. Null arrays are empty.
    A pair is one shuffle of its digests for each attempt, and its cells are in one task.
    """
    none = F.array().cast("array<bigint>")
    # a null in a key is told apart by the struct around it
    left = checkpointed(pairs.select(F.struct(*by).alias("pair"), F.coalesce("first", none).alias("first"), F.coalesce("second", none).alias("second")))
    found = None
    for attempt in range(RETRIES + 1):
        if found is not None and not left.limit(1).count():
            return found.select("pair.*", "only_first", "only_second")
        size = F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.lit(2.0), F.lit(room * 4.0**attempt) * (F.size("first") + F.size("second")))))).cast("int")
        item = lambda k, n, meta: F.struct(k.alias("k"), F.lit(n).alias("n"), meta.alias("meta"))
        items = F.concat(F.transform("first", lambda k: item(k, 1, F.lit(None).cast("int"))), F.transform("second", lambda k: item(k, -1, F.lit(None).cast("int"))), F.array(item(F.lit(0).cast("long"), 1, F.lit(1))))
        rows = left.repartition("pair").select("pair", F.lit(0).alias("kind"), size.alias("size"), F.explode(items).alias("i")).select("pair", "kind", "size", "i.*")
        peeled = peel(sketch_cells(rows, ["pair"], first_seed + attempt), ["pair"], first_seed + attempt, rounds)
        of = lambda at: F.array_sort(F.collect_list(F.when(F.col("at") == at, F.col("digest"))))
        done = checkpointed(peeled.groupBy("pair").agg(of(ONLY_FIRST).alias("only_first"), of(ONLY_SECOND).alias("only_second"), F.max(F.col("at") >= 0).alias("stuck")))
        good = done.where("not stuck").drop("stuck")
        found = good if found is None else found.unionByName(good)
        left = checkpointed(left.join(done.where("stuck").select("pair"), "pair", "left_semi"))
    raise RuntimeError(f"{left.count()} comparisons are stuck after {RETRIES} retries")


def likeness(different: Column, every: Column) -> Column:
    """1 - differing digests / digests of both; 1 if neither text has any."""
    return F.when(every == 0, F.lit(1.0)).otherwise(1 - different / every).cast("double")


def with_next_text(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with next_text: the text of the next row by descending doc_id (null ids last), after the last that of the first.

    Rows go to ranges of ids of about equal counts, one shuffle of the texts; the first row of a range is also sent, as an extra row, to the
    range above, whose last row it follows. Rows that repeat a doc_id follow each other by text. The ranges' bounds and first ids, a few numbers for each
    shuffle partition, are all that the driver sees. If all ids are null the last row's next text is null.
    """
    spark = docs.sparkSession
    most = min(8192, 4 * shuffle_partitions(spark, 8))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / most for i in range(1, most)], 20_000)).first()[0] or []
    cuts = sorted(set(cuts))
    group = max(1, int(len(cuts) ** 0.5))
    heads = cuts[group - 1 :: group]
    count_in = lambda values: F.size(F.filter(values, lambda c: c <= F.col("doc_id")))
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    bucket = count_in(longs(heads)) * group
    bucket = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(bucket + count_in(F.slice(longs(cuts), bucket + 1, F.lit(group))))
    placed = docs.withColumn("bucket", F.coalesce(bucket.cast("int"), F.lit(0)))
    tops = sorted((b, i) for b, i in placed.groupBy("bucket").agg(F.max("doc_id")).collect() if i is not None)
    targets = [(i, tops[(k + 1) % len(tops)][0]) for k, (_, i) in enumerate(tops)]
    if tops and tops[0][0] != 0 and placed.where("doc_id is null").limit(1).count():
        targets = [(i, 0 if k == len(tops) - 1 else b) for k, (i, b) in enumerate(targets)]
    extra = spark.createDataFrame(targets, "top long, to int")
    ghosts = docs.join(F.broadcast(extra), F.col("doc_id") == F.col("top")).groupBy("to", "top").agg(F.max("text").alias("text"))
    # nulls follow the smallest ids, in range 0, which exists if there are any
    rows = placed.select("bucket", F.lit(False).alias("ghost"), "doc_id", "text").unionByName(ghosts.select(F.col("to").alias("bucket"), F.lit(True).alias("ghost"), F.col("top").alias("doc_id"), "text"))
    order = Window.partitionBy("bucket").orderBy("ghost", F.col("doc_id").desc_nulls_last(), F.col("text").desc_nulls_last())
    rows = rows.repartition(most, "bucket").withColumns({"row": F.row_number().over(order), "next_text": F.lead("text").over(order), "next_id": F.lead("doc_id").over(order)})
    return rows.where("not ghost").select("bucket", "row", "doc_id", "text", "next_id", "next_text")


_OF_TEXT, _OF_EDIT, _OF_NEXT = range(3)
_EDIT, _NEXT = 1, 2
_BY = ["bucket", "row"]


def _edited(text: Column, next_text: Column) -> Column:
    third = F.floor(F.length(text) / 3).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - third), F.substring(F.coalesce(next_text, F.lit("")), F.lit(1), third))


def _exploded(rows: DataFrame, items: Column) -> DataFrame:
    return rows.select(*_BY, F.explode(items).alias("i")).select(*_BY, "i.*")


def _told(cells: DataFrame) -> DataFrame:
    """A row for each text: its meta, and for each comparison how many digests were recovered and whether some are left."""
    count = lambda kind: F.count_if((F.col("kind") == kind) & F.col("at").isin(ONLY_FIRST, ONLY_SECOND)).alias(f"d{kind}")
    stuck = lambda kind: F.max((F.col("kind") == kind) & (F.col("at") >= 0)).alias(f"stuck{kind}")
    return cells.groupBy(*_BY).agg(F.first("meta", ignorenulls=True).alias("meta"), count(_EDIT), count(_NEXT), stuck(_EDIT), stuck(_NEXT))


def _fingerprinted(rows: DataFrame) -> DataFrame:
    """rows (bucket, row, doc_id, text, next_text) to (bucket, row, meta, cells of the fingerprints of text, edited text and next text)."""
    rows = rows.withColumn("edited", _edited(F.col("text"), F.col("next_text")))
    rows = rows.select(*_BY, "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), paragraph_digests(F.col("text")).alias("a"), paragraph_digests(F.col("edited")).alias("b"), paragraph_digests(F.col("next_text")).alias("c"))
    meta = F.struct("doc_id", "n_chars", "sha", "a", "b", "c")
    rows = rows.select(*_BY, "a", "b", "c", meta.alias("meta"), *(table_cells(F.size(x)).alias(f"s{x}") for x in "abc"))
    kind_of = rows.schema["meta"].dataType
    none = F.lit(None).cast(kind_of)
    item = lambda kind, size, k, meta: F.struct(F.lit(kind).alias("kind"), size.alias("size"), k.alias("k"), F.lit(1).alias("n"), meta.alias("meta"))
    named = lambda x, kind: F.transform(x, lambda k: item(kind, F.col(f"s{x}"), k, none))
    items = F.concat(named("a", _OF_TEXT), named("b", _OF_EDIT), named("c", _OF_NEXT), F.array(item(META, F.lit(0), F.lit(0).cast("long"), F.col("meta"))))
    cells = sketch_cells(_exploded(rows, items), _BY)
    listed = F.array_sort(F.collect_list(F.when(F.col("at") >= 0, F.struct("kind", "at", "n", "k", "h"))))
    return cells.groupBy(*_BY).agg(F.first("meta", ignorenulls=True).alias("meta"), listed.alias("cells"))


def _as_text(cells: Column, digests: Column) -> Column:
    """Digests, cells of a table, and the occupied cells: place, count, and both XORs."""
    said = lambda c: F.concat_ws(".", c["at"].cast("string"), c.n.cast("string"), F.hex(c.k), F.hex(c.h.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))))
    return F.concat_ws("/", digests.cast("string"), table_cells(digests).cast("string"), F.array_join(F.transform(cells, said), " "))


def _compared(rows: DataFrame) -> DataFrame:
    """rows of _fingerprinted to (bucket, row, meta, d1, d2, stuck1, stuck2) from their fingerprints, and once more, larger, for what gets stuck; no step shuffles."""
    of = lambda kind: F.filter("cells", lambda c: c.kind == kind)
    sizes = {x: F.size(F.col(f"meta.{x}")) for x in "abc"}
    rows = rows.select(*_BY, of(_OF_TEXT).alias("fa"), of(_OF_EDIT).alias("fb"), of(_OF_NEXT).alias("fc"), "meta", *(table_cells(sizes[x]).alias(f"s{x}") for x in "abc"))
    meta = F.struct("meta.*", _as_text(F.col("fa"), sizes["a"]).alias("fingerprint"), _as_text(F.col("fb"), sizes["b"]).alias("edited_fingerprint"))
    rows = rows.withColumn("meta", meta)
    none = F.lit(None).cast(rows.schema["meta"].dataType)

    def folded(cells: str, own: str, other: str, kind: int, sign: int) -> Column:
        to = F.least(F.col("sa"), F.col(other))
        cell = lambda c: F.struct(F.lit(kind).alias("kind"), to.alias("size"), _folded(c["at"], F.col(own), to).alias("at"), F.lit(0).cast("long").alias("digest"), none.alias("meta"), (c.n * sign).cast("int").alias("n"), c.k.alias("k"), c.h.alias("h"))
        return F.transform(cells, cell)

    along = F.array(F.struct(F.lit(META).alias("kind"), F.lit(0).alias("size"), F.lit(META).alias("at"), F.lit(0).cast("long").alias("digest"), F.col("meta").alias("meta"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("h")))
    parts = F.concat(folded("fa", "sa", "sb", _EDIT, 1), folded("fb", "sb", "sb", _EDIT, -1), folded("fa", "sa", "sc", _NEXT, 1), folded("fc", "sc", "sc", _NEXT, -1), along)
    first = _told(peel(_summed(_exploded(rows, parts), _BY), _BY))

    # the retry: digests of both texts in sketches with as many cells in each table
    solved = lambda kind: F.when(~F.col(f"stuck{kind}"), F.col(f"d{kind}"))
    rows = first.withColumn("meta", F.struct("meta.*", solved(_EDIT).alias("d1"), solved(_NEXT).alias("d2")))
    none = F.lit(None).cast(rows.schema["meta"].dataType)
    item = lambda kind, size, k, n, meta: F.struct(F.lit(kind).alias("kind"), size.alias("size"), k.alias("k"), F.lit(n).alias("n"), meta.alias("meta"))

    def again(x: str, kind: int, n: int) -> Column:
        both = F.size("meta.a") + F.size("meta.b" if kind == _EDIT else "meta.c")
        digests = F.when(F.col(f"stuck{kind}"), F.col(f"meta.{x}")).otherwise(F.array().cast("array<bigint>"))
        return F.transform(digests, lambda k: item(kind, table_cells(2 * both), k, n, none))

    items = F.concat(again("a", _EDIT, 1), again("b", _EDIT, -1), again("a", _NEXT, 1), again("c", _NEXT, -1), F.array(item(META, F.lit(0), F.lit(0).cast("long"), 1, F.col("meta"))))
    second = _told(peel(sketch_cells(_exploded(rows, items), _BY, 1), _BY, 1))
    return second.select(*_BY, "meta", *(F.coalesce(F.col(f"meta.d{k}"), F.col(f"d{k}")).alias(f"d{k}") for k in (_EDIT, _NEXT)), *(F.col(f"meta.d{k}").isNull().alias(f"retried{k}") for k in (_EDIT, _NEXT)), "stuck1", "stuck2")


def compare_with_edit_and_next(docs: DataFrame, retries: bool = False) -> DataFrame:
    """docs (doc_id, text, ...) to (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next); a null text is empty.

    The edited text: the last n_chars div 3 characters replaced by as many first ones of the next document (see with_next_text). near_*: likeness of the fingerprint to the
    edited text's and to the next document's. retries: also retried_edited and retried_next, whether a likeness took larger sketches.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    path = scratch(spark, "fingerprints")
    rows = _compared(_fingerprinted(with_next_text(source)))
    digests = lambda x: F.when(F.col("stuck1") | F.col("stuck2"), F.col(f"meta.{x}")).alias(x)
    sizes = [F.size(f"meta.{x}").cast("long").alias(f"n{x}") for x in "abc"]
    rows.select(*_BY, "meta.doc_id", "meta.n_chars", F.col("meta.sha").alias("edited_sha256"), "meta.fingerprint", "meta.edited_fingerprint", *sizes, "d1", "d2", "stuck1", "stuck2", "retried1", "retried2", *map(digests, "abc")).write.parquet(path)
    done = spark.read.parquet(path)
    stuck = done.where("stuck1 or stuck2")
    if n := stuck.count():  # a few texts in a million
        pairs = None
        for kind, other in ((_EDIT, "b"), (_NEXT, "c")):
            part = stuck.where(f"stuck{kind}").select(*_BY, F.lit(kind).alias("kind"), F.col("a").alias("first"), F.col(other).alias("second"))
            pairs = part if pairs is None else pairs.unionByName(part)
        more = differing_digests(pairs, [*_BY, "kind"], 4.0, first_seed=2).select(*_BY, "kind", (F.size("only_first") + F.size("only_second")).cast("long").alias("d"))
        more = more.groupBy(*_BY).agg(*(F.max(F.when(F.col("kind") == k, F.col("d"))).alias(f"m{k}") for k in (_EDIT, _NEXT)))
        mended = stuck.join(F.broadcast(more) if n <= FEW else more, _BY).withColumns({f"d{k}": F.coalesce(f"m{k}", f"d{k}") for k in (_EDIT, _NEXT)}).drop("m1", "m2")
        done = done.where("not (stuck1 or stuck2)").unionByName(mended)
    near = [likeness(F.col("d1"), F.col("na") + F.col("nb")).alias("near_edited"), likeness(F.col("d2"), F.col("na") + F.col("nc")).alias("near_next")]
    told = [F.col("retried1").alias("retried_edited"), F.col("retried2").alias("retried_next")] if retries else []
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near, *told)
