"""The registered queries of this folder: ``opN_<name>``, their SQL twins, and nothing else."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlespark.llm import align, chat, decontaminate, html_text, kneser_ney, language, licenses, lines, minhash, mixing, neighbours, quality, repair, twins
from candlespark.llm.common import crc_of_id, session, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under its name, with its SQL twin if it has one."""
    if fn is None:
        return lambda f: query(f, sql=sql)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(session(spark), sf_dir)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    QUERIES[fn.__name__] = run
    if sql:
        ORACLE[fn.__name__] = sql.strip()
    return fn


@query
def op2_lm_scores(spark, sf_dir):
    """Kneser-Ney scores of every document; every fifth by id checksum is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (crc_of_id() % 5 != 1).alias("learn"))
    scored = kneser_ney.score(docs, kneser_ney.train(docs))
    return scored.select("doc_id", (~F.col("learn")).alias("held_out"), *[c for c in scored.columns if c not in ("doc_id", "learn")])


@query
def op10_language_id(spark, sf_dir):
    """Language of every document; every third by id checksum is held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_of_id() % 3 != 1).alias("learn"))
    judged = language.predict(docs.select("doc_id", "learn", "text"), language.dictionaries(docs))
    return judged.select("doc_id", (~F.col("learn")).alias("held_out"), "lang_pred", "score", "rejected")


@query(sql=twins.LINES)
def op3_line_dedup(spark, sf_dir):
    """Lines that many documents share are dropped from all but one of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.apply(docs, lines.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


@query(sql=twins.NEAR)
def op5_near_dedup(spark, sf_dir):
    """Classes of documents whose sets of 3-word shingles overlap by 85 in 100 or more."""
    return minhash.classes(table(spark, sf_dir, "documents"), size=3, share=(85, 100))


@query(sql=twins.QUALITY)
def op1_quality_rules(spark, sf_dir):
    """Base counts, and the verdict of fences that follow each language's and source's own sketch."""
    judged = quality.judge(table(spark, sf_dir, "documents"))
    return judged.drop("lang", "source")


@query
def op9_main_text(spark, sf_dir):
    """The article of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


@query
def op8_quality_scores(spark, sf_dir):
    """Quality of every document by votes of labelled neighbours; every fifth by id checksum is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    space = neighbours.fit(docs, labels.where(crc_of_id() % 5 != 0).select("doc_id", F.col("quality").alias("label")))
    scored = neighbours.score(docs, space)
    held_out = (crc_of_id() % 5 == 0).alias("held_out")
    return scored.select("doc_id", held_out, "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query
def op4_benchmark_leaks(spark, sf_dir):
    """Documents that hold a benchmark item, with the item, the similarity and the place."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(sql=twins.MIX)
def op7_source_mix(spark, sf_dir):
    """The slot of every document's block when sources are mixed by the square roots of their sizes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op6_license_spans(spark, sf_dir):
    """License notices in every document, with coverage and spans."""
    return licenses.scan(table(spark, sf_dir, "documents"))


#: Bytes of an Arrow batch for rows that hold whole sequences or batches of documents.
BATCH_BYTES = str(32 << 20)


def _by_bytes(spark):
    """Arrow batches end by their size, too: a thousand long rows would not fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@query(sql=twins.CHAT)
def op11_chat_format(spark, sf_dir):
    """Training sequences of all conversations and of one made of control strings, read back from ids and masks."""
    _by_bytes(spark)
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = chat.END + chat.START + "assistant ok"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    read = chat.read_back(chat.format_chat(rows.unionByName(probe)))
    return read.drop("n_tokens", "loss_tokens")


@query(sql=twins.REPAIR)
def op12_conversation_repair(spark, sf_dir):
    """Faults and cheapest repair of every conversation, damaged by the checksums of its rows."""
    _by_bytes(spark)
    rows = table(spark, sf_dir, "conversations")
    found = repair.repaired(repair.damage(rows))
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    every = rows.select(F.col("conv_id").cast("long").alias("id")).distinct()
    return every.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in counts], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


@query
def op13_token_alignment(spark, sf_dir):
    """Groups and links between the tokens of two vocabularies in every document."""
    _by_bytes(spark)
    return align.align(table(spark, sf_dir, "documents").select("doc_id", "text"))
