"""Line dedup with built-in functions only.

A line's key is the line stripped of ASCII white space at both ends, A-Z in
lower case.  Keys of at least ``min_chars`` code points that occur in at least
``min_docs`` documents lose all their lines except in the document with the
largest id.  Keys travel as two 64-bit hashes, never as text:

1. every row gives its long keys with the positions of their lines;
2. these rows are range-partitioned by hash and by a run of ids, so a key that
   a third of all documents share lies in many partitions; within a partition
   they are sorted by hash, descending id and position, and a window streams
   over them and marks the first row of every document;
3. the marked rows are counted per key and run, then per key, combined before
   each shuffle; only keys with enough documents go on, with the document of
   the first occurrence, one row for each run;
4. the other rows of these keys clear bits in a keep bitmap per document,
   stored sparsely: one 64-bit word for each 64 lines that drop any.

Only bitmaps leave the operator.  ``apply`` cuts the lines out of the text.

Defined results: null and empty text are one empty line; rows of one id are one
document for the counts, and each different text of it has a bitmap of its own,
so equal rows lose the same lines and no text loses lines of another; the
largest id that holds a key keeps it in all of its rows; a row without an id
counts for no key and keeps its lines; an empty table gives no rows; extra columns are not read; a
text is never cut, its lines are one array in memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import WHITE, ascii_lower, saved

MIN_CHARS = 40
MIN_DOCS = 5
#: Ids in one run; bounds the rows of one key that are sorted together.
RUN = 1 << 11


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(WHITE.decode())))


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``h1, h2, doc_id, body, pos``: the long keys of every line; ``body`` tells the texts of one id apart."""
    lines = docs.where(F.col("doc_id").isNotNull()).select("doc_id", body().alias("body"), F.posexplode(split_lines(F.col("text"))).alias("pos", "line")).where(F.length("line") >= min_chars)
    keyed = lines.select("doc_id", "body", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "body", "pos")


def body() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, body, n_dropped, keep``: a map from word number to the keep bits of its 64 lines.

    A word that is absent keeps all its lines, and documents that keep every line have no row.
    """
    run = F.floor(F.col("doc_id") / F.lit(RUN)).alias("run")
    # Written first: the range partitioning looks at its input twice, and lines should be split and hashed once.
    seen = saved(occurrences(docs, min_chars).select("h1", "h2", run, "doc_id", "body", "pos"), "line-occurrences")
    # The window needs no exchange of its own: the ranges keep the rows of a run together, and it sorts within them.
    ranged = seen.repartitionByRange("h1", "h2", "run")
    before = F.lag("doc_id").over(Window.partitionBy("h1", "h2", "run").orderBy(F.desc("doc_id"), "pos"))
    streamed = saved(ranged.withColumn("fresh", before.isNull() | (before != F.col("doc_id"))), "line-keys")
    runs = streamed.where("fresh").groupBy("h1", "h2", "run").agg(F.count("*").alias("n"), F.max("doc_id").alias("first_doc"))
    keys = runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("first_doc").alias("first_doc")).where(F.col("n") >= min_docs)
    # One row per key and run, so that a key of very many documents is joined in many tasks.
    often = runs.select("h1", "h2", "run").join(keys.select("h1", "h2", "first_doc"), ["h1", "h2"])
    gone = streamed.join(often, ["h1", "h2", "run"]).where(F.col("doc_id") != F.col("first_doc"))
    bit = F.expr("shiftleft(CAST(1 AS BIGINT), CAST(pos % 64 AS INT))")
    words = gone.groupBy("doc_id", "body", F.expr("CAST(pos DIV 64 AS INT)").alias("word")).agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
    return words.groupBy("doc_id", "body").agg(
        F.sum(64 - F.bit_count("bits")).cast("long").alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("keep"),
    )


def keep_line(keep: Column, position: Column) -> Column:
    """Whether a bitmap keeps the line at ``position``."""
    bits = F.coalesce(F.element_at(keep, F.floor(position / 64).cast("int")), F.lit(-1).cast("long"))
    return F.getbit(bits, (position % 64).cast("int")) == 1


def apply(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``kept`` (the remaining text), ``n_lines`` and ``n_dropped``; texts that lose nothing are not split."""
    names = {c: f"_{c}" for c in ("doc_id", "body", "n_dropped", "keep")}
    maps = bitmaps.withColumnsRenamed(names)
    marked = docs.withColumn("_text_hash", body()).join(maps, (F.col("doc_id") == F.col("_doc_id")) & (F.col("_text_hash") == F.col("_body")), "left")
    kept = F.array_join(F.filter(split_lines(F.col("text")), lambda line, k: keep_line(F.col("_keep"), k)), "\n")
    return marked.select(
        *[F.col(c) for c in docs.columns if c not in ("kept", "n_lines", "n_dropped")],
        F.when(F.col("_n_dropped") > 0, kept).otherwise(F.coalesce("text", F.lit(""))).alias("kept"),
        F.size(split_lines(F.col("text"))).cast("long").alias("n_lines"),
        F.coalesce("_n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
    )
