"""Language identification by compression with one zstandard dictionary per language.

A language's dictionary is raw content: the starts of a bounded sample of its
training texts.  A text is cut into pieces of a few kilobytes, each compressed
with every dictionary; the language of the smallest total wins.  The margin is
the share by which the runner-up is larger; a text whose margin is narrower
than ``min_margin`` is rejected.

The sample is stratified: of every language and each of ``strata`` hash classes
of ids, the row with the least hash, so partial aggregation keeps one row per
class however many rows a language has.  The dictionaries, at most ``strata *
SAMPLE_BYTES`` per language, are the only thing sent to workers.

Defined results: null text and text without a letter: ``und``, score 0,
rejected.  Equal totals: the alphabetically first language, margin 0, rejected.
With no training text every row is ``und``.  Repeated ids are judged row by
row; extra columns do not matter because only the named ones are read.
"""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from candlespark.llm.common import shipped

STRATA = 64
SAMPLE_BYTES = 2048
#: Piece of a text that is compressed by itself, so that a long text's own words don't take the dictionary's place.
PIECE = 8000
#: Texts of one piece up to this length are measured a second time with shorter matches, for a finer total.
SHORT = 1024
#: The shortest texts are a few bytes whatever the dictionary; they are also measured from each of their first bytes on.
TAILS = 16
#: Goes before a short text: a block that gains too little is stored as it is, whatever the dictionary holds.
FILLER = bytes(256)
MIN_MARGIN = 0.0005

VERDICT = [("lang_pred", StringType()), ("score", DoubleType()), ("rejected", BooleanType())]
LETTER = re.compile(r"[^\W\d_]")


def dictionaries(docs: DataFrame, strata: int = STRATA) -> dict[str, bytes]:
    """Raw dictionary content by language, from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds."""
    known = docs.where("learn AND lang IS NOT NULL AND text IS NOT NULL")
    spot = F.xxhash64(F.lit(41), F.col("doc_id"))
    picks = (
        known.groupBy("lang", F.pmod(spot, F.lit(strata)).alias("stratum"))
        .agg(F.min_by("doc_id", F.struct(spot, "doc_id")).alias("doc_id"))
        .select("lang", "doc_id")
    )
    # At most `strata` short rows per language come to the driver.
    start = F.substring("text", 1, SAMPLE_BYTES)
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(picks), ["doc_id", "lang"]).groupBy("lang", "doc_id").agg(F.min(start).alias("start")).collect()
    out: dict[str, list[bytes]] = {}
    for row in sorted(rows, key=lambda r: (r.lang, r.doc_id)):
        if LETTER.search(row.start):
            out.setdefault(row.lang, []).append(row.start.lower().encode()[:SAMPLE_BYTES])
    return {lang: b"\n".join(texts) for lang, texts in out.items()}


def _coders(content: dict[str, bytes], fine: bool) -> list[zstandard.ZstdCompressor]:
    how = zstandard.ZstdCompressionParameters(
        window_log=18,
        hash_log=16,
        chain_log=16,
        search_log=5 if fine else 3,
        min_match=3 if fine else 4,
        strategy=zstandard.STRATEGY_BTLAZY2 if fine else zstandard.STRATEGY_GREEDY,
        target_length=16,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    out = []
    for raw in content.values():
        shelf = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        shelf.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(dict_data=shelf, compression_params=how))
    return out


def predict(docs: DataFrame, content: dict[str, bytes], min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` (any columns, one of them ``text``) with ``lang_pred``, ``score`` (the margin) and ``rejected``.

    A column of ``docs`` that has one of these names is replaced.
    """
    docs = docs.drop(*[n for n, _ in VERDICT])
    shared = docs.sparkSession.sparkContext.broadcast(dict(sorted(content.items())))

    def judged(batches):
        content = shared.value
        names, coders, fine = list(content), _coders(content, False), _coders(content, True)
        for batch in batches:
            langs, scores, rejected = [], [], []
            for text in batch.column("text"):
                text = text.as_py()
                if not names or text is None or not LETTER.search(text):
                    langs.append("und")
                    scores.append(0.0)
                    rejected.append(True)
                    continue
                raw = text.lower().encode()
                pieces = [raw[a : a + PIECE] for a in range(0, len(raw), PIECE)]
                sizes = [sum(len(c.compress(p)) for p in pieces) for c in coders]
                if len(raw) <= SHORT:
                    tails = range(0, TAILS if len(raw) <= 4 * TAILS else 1)
                    sizes = [s + sum(len(c.compress(FILLER + raw[k:])) for k in tails) for s, c in zip(sizes, fine, strict=True)]
                order = sorted(range(len(names)), key=lambda k: sizes[k])
                margin = 1 - sizes[order[0]] / sizes[order[1]] if len(names) > 1 else 1.0
                langs.append(names[order[0]])
                scores.append(margin)
                rejected.append(margin < min_margin)
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, "lang_pred", "score", "rejected"])

    schema = StructType([*docs.schema.fields, *[StructField(n, t) for n, t in VERDICT]])
    return docs.mapInArrow(judged, schema)


shipped(__name__)
