"""Quality rules whose cutoffs follow the data: mergeable quantile sketches per language and source.

``measure`` counts words, symbols, repeated lines and repeated word windows of
every whole text.  Documents that pass the base rules feed one sketch for each
language, source and metric: a log-linear histogram that keeps the leading
``BITS`` bits of a value (relative error below 1/32).  Sketches merge by adding
counts, so they are partially aggregated before the shuffle, the order of rows
does not matter, and a language's sketch is the sum of its sources'.  A group
with fewer than ``min_group`` documents takes its language's sketch, and a
small language that of all documents.

A metric's upper fence lies beyond an upper quantile of the group's sketch, by
``REACH`` times that quantile's distance from the median; the lower fence
mirrors it.  Only where the quantile and the median are the same cell, so that
the group shows no spread, a given spread takes the distance's place.
Documents are joined with their group's fences and kept when all metrics lie
inside.

Defined results: null, empty and blank texts have no words and fail the base
rules; null language or source is a group of its own; repeated ids are judged
row by row; an empty table gives no rows; extra columns are not read; texts are
read whole, one run of about a megabyte or one longer text at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlespark.llm.common import WHITE, mix, runs, saved, shingles, shipped, tables, words

MIN_WORDS = 50
#: Base rule: more than half of the words lie in repeated windows.
MAX_REPEAT = 50
BITS = 6
REACH = 3
MIN_GROUP = 200
SYMBOLS = b"#*$%&|<>"

#: Metric: (integer expression, percentile of the upper quantile, spread where a group shows none).  All are ratios, per hundred or thousand.
#: Values that a share of bad documents can reach in numbers use the lower percentile.
METRICS = {
    "word_length": ("100 * word_chars DIV n_words", 95, 40),
    "symbols": ("1000 * n_symbols DIV n_words", 90, 20),
    "dup_lines": ("1000 * n_dup_lines DIV greatest(n_lines, 1)", 99, 150),
    "repeats": ("1000 * n_repeat_words DIV n_words", 99, 120),
    "capitals": ("1000 * n_capitals DIV word_chars", 99, 40),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")


def _per_doc(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _again(hashes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every hash: whether its document has it elsewhere too, and whether it had it before."""
    key = hashes ^ mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:]] = equal
    twice[order[1:]] = equal
    twice[order[:-1]] |= equal
    return twice, before


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, lang, source, text) without the text, with the counts of :data:`COUNTS`."""

    def counts(batches):
        by_word, by_line = tables(fold=False), tables(fold=False)
        by_line.apart[:] = False
        by_line.apart[10] = True
        white, symbol, capital = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
        white[list(WHITE)], symbol[list(SYMBOLS)], capital[65:91] = True, True, True
        for batch in batches:
            for a, b, data, bounds in runs(batch.column("text")):
                w = words(data, bounds, by_word)
                n = b - a
                starts = (data & 0xC0) != 0x80
                lines = words(data, bounds, by_line)
                worded = np.searchsorted(w.start, lines.end) > np.searchsorted(w.start, lines.start)
                _, repeated = _again(lines.hash[worded], lines.doc[worded])
                windows, cut = shingles(w, 3)
                doc = np.repeat(np.arange(n), np.diff(cut))
                twice, _ = _again(windows, doc)
                at = np.flatnonzero(twice)
                at = at - cut[doc[at]] + w.first[doc[at]]
                covered = np.zeros(len(w), bool)
                for k in range(3):
                    covered[np.minimum(at + k, len(w) - 1)] = True
                found = (
                    np.diff(w.first),
                    _per_doc(starts, bounds) - _per_doc(white[data], bounds),
                    _per_doc(symbol[data], bounds),
                    np.bincount(lines.doc[worded], repeated, n).astype(np.int64),
                    np.bincount(w.doc, covered, n).astype(np.int64),
                    np.bincount(lines.doc[worded], minlength=n),
                    _per_doc(capital[data], bounds),
                )
                some = batch.slice(a, n)
                own = [some.column("doc_id").cast(pa.int64()), some.column("lang").cast(pa.string()), some.column("source").cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*own, *[pa.array(x, pa.int64()) for x in found]], ["doc_id", "lang", "source", *COUNTS])

    schema = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS)
    return docs.select("doc_id", "lang", "source", "text").mapInArrow(counts, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))


def with_metrics(measured: DataFrame) -> DataFrame:
    failed = measured.withColumn("base_failed", base_failed())
    return failed.withColumns({m: F.when(~F.col("base_failed"), F.expr(how)) for m, (how, *_) in METRICS.items()})


def cell(value: Column) -> Column:
    """The least value that shares the leading bits with ``value``."""
    width = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    unit = F.expr("CAST(1 AS BIGINT)") * F.pow(F.lit(2), width).cast("long")
    return value - value % unit


def sketches(metrics: DataFrame) -> DataFrame:
    """``lang, source, level, metric, cell, n``: level 0 per language and source, 1 per language, 2 for all."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), cell(F.col(m)).alias("cell")) for m in METRICS]))
    own = metrics.where("NOT base_failed").select("lang", "source", pairs.alias("p")).groupBy("lang", "source", "p.metric", "p.cell").agg(F.count("*").alias("n"))
    own = saved(own, "sketches").withColumn("level", F.lit(0))
    per_lang = own.groupBy("lang", "metric", "cell").agg(F.sum("n").alias("n")).withColumns({"source": F.lit(None).cast("string"), "level": F.lit(1)})
    whole = own.groupBy("metric", "cell").agg(F.sum("n").alias("n")).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "level": F.lit(2)})
    return own.unionByName(per_lang).unionByName(whole)


def fences(sketched: DataFrame) -> DataFrame:
    """``lang, source, level, n`` and ``<metric>_low``, ``<metric>_high`` of every sketch, and whether (``_flat``) a fence had no spread to go by."""
    group = ["lang", "source", "level", "metric"]
    run = Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
    total = Window.partitionBy(*group)
    summed = sketched.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(total)})

    def quantile(percent) -> Column:
        return F.min(F.when(100 * F.col("upto") >= percent * F.col("all"), F.col("cell")))

    level = F.coalesce(*[F.when(F.col("metric") == m, F.lit(p)) for m, (_, p, _) in METRICS.items()])
    rows = summed.withColumn("percent", level).groupBy(*group).agg(
        quantile(100 - F.col("percent")).alias("q_low"), quantile(50).alias("q_mid"), quantile(F.col("percent")).alias("q_high"), F.max("all").alias("n")
    )
    out = [F.max("n").alias("n")]
    for m, (_, _, spread) in METRICS.items():
        own = F.col("metric") == m
        for side, sign in (("low", -1), ("high", 1)):
            reached = F.col(f"q_{side}")
            apart = F.abs(reached - F.col("q_mid"))
            fence = reached + sign * REACH * F.when(apart > 0, apart).otherwise(spread)
            out.append(F.max(F.when(own, fence)).alias(f"{m}_{side}"))
            out.append(F.max(F.when(own, (apart == 0).cast("int"))).alias(f"{m}_{side}_flat"))
    return rows.groupBy("lang", "source", "level").agg(*out)


def judge(docs: DataFrame, min_group: int = MIN_GROUP) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of every row of ``docs``."""
    metrics = saved(with_metrics(measure(docs)), "measured")
    found = saved(fences(sketches(metrics)), "fences")
    names = [f"{m}_{side}" for m in METRICS for side in ("low", "high")]

    def level(k: int) -> DataFrame:
        keys = [c for c, most in (("lang", 1), ("source", 0)) if k <= most]
        return found.where(F.col("level") == k).select(*[F.col(c).alias(f"{c}_{k}") for c in keys], F.struct("n", *names).alias(f"at_{k}"))

    # One row per language and source, with the fences of the finest level that has enough documents.
    groups = level(0).withColumnsRenamed({"lang_0": "g_lang", "source_0": "g_source"})
    groups = groups.join(level(1), F.col("g_lang").eqNullSafe(F.col("lang_1")), "left")
    groups = groups.crossJoin(F.broadcast(level(2)))  # one row
    chosen = F.when(F.col("at_0.n") >= min_group, F.col("at_0")).when(F.col("at_1.n") >= min_group, F.col("at_1")).otherwise(F.col("at_2"))
    groups = groups.select("g_lang", "g_source", chosen.alias("fence"))
    joined = metrics.join(groups, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    inside = F.lit(True)
    for m in METRICS:
        inside &= F.col(m).between(F.col(f"fence.{m}_low"), F.col(f"fence.{m}_high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return joined.select("doc_id", "lang", "source", *COUNTS, "base_failed", kept.alias("kept"), *METRICS)


shipped(__name__)
