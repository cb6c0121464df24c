"""Mixing sources to target weights by Pfair scheduling, with built-in functions only.

A source's documents, in a fixed pseudo-random order, are cut into blocks of
``block`` documents.  Target weights are whole ``parts``; a cycle gives each
source as many slots as it has parts.  The k-th of a source's c blocks in a
cycle of P slots is released at slot floor(k P / c) and due by ceil((k+1) P / c).
Earliest deadline first fills the slots, so after any number of slots a source
is less than one block away from its share.

No source is dropped or repeated: when one runs out, the next cycles are planned
for the others.  Cycles with the same counts share a plan, and a source changes
the counts twice at most, so a corpus of S sources needs at most 2 S + 1 plans,
however long it is; each is one row, folded slot by slot.  Blocks find their
slots by a join; no task walks over all blocks.

Positions within a source come from counts per hash bucket and an order within
the bucket, so a source with a third of all rows is spread over many tasks.

Defined results: null source is a source of its own; sources without a given
weight get one part; repeated ids take adjacent positions; an empty table gives
no rows; other columns are read only when asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import saved

BLOCK = 8
PARTS = 100


def source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def numbered(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, key, place`` and ``carry``: the position of each document in its source, from 0."""
    order = F.md5(F.col("doc_id").cast("string"))
    rows = docs.select("doc_id", "source", source_key(F.col("source")).alias("key"), F.coalesce(order, F.lit("")).alias("order"), *carry)
    rows = rows.withColumn("bucket", F.substring("order", 1, 3))
    counts = rows.groupBy("key", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("key", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    own = F.row_number().over(Window.partitionBy("key", "bucket").orderBy("order", "doc_id")) - 1
    placed = rows.withColumn("own", own).join(starts, ["key", "bucket"])
    return placed.select("doc_id", "source", *carry, "key", (F.col("start") + F.col("own")).alias("place"))


def root_parts(sources: DataFrame, total: int = PARTS) -> DataFrame:
    """Target parts of ``sources`` (key, n) that grow with the square root of their size, about ``total`` in all."""
    root = F.floor(F.sqrt(F.col("n").cast("double")))
    whole = F.sum(root).over(Window.partitionBy(F.lit(0)))  # one row per source
    return sources.select("key", "n", F.greatest(F.lit(1), F.floor(F.lit(total) * root / whole)).cast("long").alias("parts"))


def given_parts(sources: DataFrame, weights: dict[str | None, int]) -> DataFrame:
    """Target parts as given by source name; one part where none is given."""
    parts = F.lit(1)
    for name, value in weights.items():
        parts = F.when(F.col("key") == (F.lit("null") if name is None else F.lit(f"={name}")), value).otherwise(parts)
    return sources.select("key", "n", parts.cast("long").alias("parts"))


def earliest_deadline_first(counts: Column, slots: Column) -> Column:
    """The place in ``counts`` that each of ``slots`` slots goes to; the counts add up to ``slots``."""

    def fill(state: Column, now: Column) -> Column:
        done = state["done"]

        def due(c: Column, i: Column) -> Column:
            k = F.get(done, i)
            ready = (k < c) & (F.floor(k * slots / c) <= now)
            return F.when(ready, F.struct(F.ceil((k + 1) * slots / c).alias("deadline"), i.alias("i")))

        pick = F.array_min(F.transform(counts, due))["i"]
        return F.struct(
            F.transform(done, lambda k, i: k + F.when(i == pick, 1).otherwise(0).cast("long")).alias("done"),
            F.concat(state["order"], F.array(pick)).alias("order"),
        )

    start = F.struct(F.transform(counts, lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("order"))
    return F.aggregate(F.sequence(F.lit(0).cast("long"), slots - 1), start, fill, lambda state: state["order"])


def plans(sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per kind of cycle and slot: ``key, k, from_cycle, to_cycle, base, length, n_blocks, slot``.

    ``sources``: key, n (documents), parts.  ``k`` counts the source's blocks
    within a cycle, ``base`` is the first slot of the first cycle of the kind.
    """
    blocks = sources.where("n > 0").withColumn("blocks", F.ceil(F.col("n") / F.lit(block)))
    rows = blocks.select("key", "parts", F.floor(F.col("blocks") / F.col("parts")).alias("full"), (F.col("blocks") % F.col("parts")).alias("rest"))
    # One row that lists the sources; what follows has one row per kind of cycle.
    listed = rows.agg(F.sort_array(F.collect_list(F.struct("key", "parts", "full", "rest"))).alias("s")).where(F.size("s") > 0)
    ends = F.transform("s", lambda x: x["full"] + F.when(x["rest"] > 0, 1).otherwise(0))
    changes = F.array_union(F.array(F.lit(0).cast("long")), F.concat(F.transform("s", lambda x: x["full"]), F.transform("s", lambda x: x["full"] + 1)))
    kinds = listed.withColumn("end", F.array_max(ends)).select("s", "end", F.explode(F.array_distinct(changes)).alias("from_cycle")).where("from_cycle < end")
    at = F.col("from_cycle")
    counts = F.transform("s", lambda x: F.when(at < x["full"], x["parts"]).when(at == x["full"], x["rest"]).otherwise(F.lit(0).cast("long")))
    later = Window.partitionBy(F.lit(0)).orderBy("from_cycle")
    kinds = kinds.select(
        "from_cycle",
        F.coalesce(F.lead("from_cycle").over(later), F.col("end")).alias("to_cycle"),
        F.transform("s", lambda x: x["key"]).alias("keys"),
        counts.alias("counts"),
    ).withColumn("length", F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c))
    before = later.rowsBetween(Window.unboundedPreceding, -1)
    kinds = kinds.withColumn("base", F.coalesce(F.sum((F.col("to_cycle") - F.col("from_cycle")) * F.col("length")).over(before), F.lit(0)))
    filled = kinds.select("*", F.posexplode(earliest_deadline_first(F.col("counts"), F.col("length"))).alias("slot", "i"))
    k = F.row_number().over(Window.partitionBy("from_cycle", "i").orderBy("slot")) - 1
    return filled.select(
        F.get("keys", F.col("i")).alias("key"), k.cast("long").alias("k"), "from_cycle", "to_cycle", "base", "length",
        F.get("counts", F.col("i")).alias("n_blocks"), F.col("slot").cast("long").alias("slot"),
    )


def mix(docs: DataFrame, weights: dict[str | None, int] | None = None, block: int = BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, source, block, slot, release, deadline, place`` of every row of ``docs``, and its columns in ``carry``.

    ``slot`` orders the blocks of all sources, ``place`` the documents in a block.
    """
    placed = saved(numbered(docs, carry), "numbered")
    sizes = placed.groupBy("key").agg(F.count("*").alias("n"))
    sources = saved(root_parts(sizes) if weights is None else given_parts(sizes, weights), "sources")
    slots = saved(plans(sources, block), "slots").withColumnRenamed("key", "slot_key")
    rows = placed.join(sources.select("key", "parts"), "key").withColumn("block", F.floor(F.col("place") / F.lit(block)))
    rows = rows.withColumns({"cycle": F.floor(F.col("block") / F.col("parts")), "turn": F.col("block") % F.col("parts")})
    on = (F.col("key") == F.col("slot_key")) & (F.col("turn") == F.col("k")) & (F.col("cycle") >= F.col("from_cycle")) & (F.col("cycle") < F.col("to_cycle"))
    first = F.col("base") + (F.col("cycle") - F.col("from_cycle")) * F.col("length")
    return rows.join(slots, on).select(
        "doc_id",
        "source",
        *carry,
        "block",
        (first + F.col("slot")).alias("slot"),
        (first + F.floor(F.col("k") * F.col("length") / F.col("n_blocks"))).alias("release"),
        (first + F.ceil((F.col("k") + 1) * F.col("length") / F.col("n_blocks"))).alias("deadline"),
        (F.col("place") % F.lit(block)).alias("place"),
    )
