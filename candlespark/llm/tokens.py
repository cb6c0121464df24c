"""Public tokenizers inside Spark tasks: vocabularies as bytes, and texts cut where no token can span.

A cut before a single space between two characters that are not white space
changes no token: the byte-level pattern starts a new word there, and no piece
of the other vocabulary holds a space after another character (checked when
it is loaded).  Words are therefore encoded once per task and looked up
afterwards, and a text of any length needs only the memory of its tokens.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from candlespark.llm.common import shipped

#: Where the public vocabularies lie; a parameter of every operator that uses one.
FOLDER = "/opt/tokenizers"
#: Bytes of joined new words that one call encodes.
BLOCK = 1 << 16
#: Words that a task remembers before it starts anew; bounds its memory, changes no result.
REMEMBERED = 300_000

CUT = re.compile(r"(?<=\S)(?= \S)")
META = "▁"


def content(spark: SparkSession, path: str) -> bytes:
    """A vocabulary file of some MB, read by the driver and sent along with the tasks; any store Spark reads will do."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").first().content)


def byte_letters() -> dict[str, int]:
    """The letter of each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE vocabulary; strings of special tokens inside texts are plain text."""

    def __init__(self, spec: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_str(spec.decode())
        self.encoder.encode_special_tokens = True
        vocabulary, letter = self.encoder.get_vocab(with_added_tokens=True), byte_letters()
        self.size = max(vocabulary.values()) + 1
        self.bytes = [b""] * self.size
        for entry, i in vocabulary.items():
            self.bytes[i] = bytes([letter[c] for c in entry])
        self.length = np.array([len(x) for x in self.bytes], np.int64)

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.encoder.encode_batch_fast(texts, add_special_tokens=False)]

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and the first and last-but-one character of each token; a character cut in two belongs to both tokens."""
        e = self.encoder.encode(text, add_special_tokens=False)
        flat = np.fromiter(chain.from_iterable(e.offsets), np.int64, 2 * len(e.ids))
        return np.array(e.ids, np.int64), flat[::2], flat[1::2]

    def decode(self, ids) -> str:
        """Exact inverse for the ids of whole texts."""
        return b"".join([self.bytes[i] for i in ids]).decode()


class Pieces:
    """A piece vocabulary with byte fallback, which puts a space before each text."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = self.encoder.vocab_size()
        names = [self.encoder.id_to_piece(i) for i in range(self.size)]
        self.fallback = np.array([self.encoder.is_byte(i) for i in range(self.size)], bool)
        self.bytes = [bytes([int(n[3:5], 16)]) if b else n.replace(META, " ").encode() for n, b in zip(names, self.fallback)]
        self.length = np.array([len(x) for x in self.bytes], np.int64)
        #: False if a piece spans the end of a word: then texts are encoded whole.
        self.separable = not any(re.search(f"[^{META}]{META}", n) for n in names)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the byte of ``text`` each token ends before; of the bytes of one character only the last counts as its end."""
        pieces = self.encoder.encode(text, return_type="proto", num_threads=1).pieces
        flat = np.array([(p.id, p.end) for p in pieces], np.int64).reshape(-1, 2)
        return flat[:, 0], flat[:, 1]


def sequences(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[object, Iterator[dict]]]:
    """Rows in runs of one key, in the order of the batches: ``(key, rows)``; rows are dicts, one batch is held at a time.

    As with ``itertools.groupby``, the rows of a run end when the next run is asked for.
    """
    from itertools import groupby

    rows = (row for batch in batches for row in batch.to_pylist())
    return groupby(rows, key=lambda row: row[key])


shipped(__name__)
