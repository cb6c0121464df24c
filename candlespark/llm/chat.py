"""Chat formatting by token-level assembly.

Role lines and texts are encoded apart, before any row moves; reserved ids are
spliced between them, so a control string inside a text can never become a
control token.  The loss mask of a sequence comes from prefix sums over the
lengths of its parts.

* **Template.** ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn; the two marks
  are the ids that follow the vocabulary.
* **Escapes.** ``<`` followed by any number of backslashes and ``|`` gets one
  backslash more, so no escaped text holds ``<|``; taking one away is the exact
  inverse.  Roles also write backslashes as two and line ends as ``\\n``.
* **Order.** By turn, nulls first, then by the encoded role and text.  Repeated
  rows stay.  A null role or text counts as empty, a null conv_id is a
  conversation of its own, an empty table gives no rows.
* **Size.** The rows of a conversation are sorted by Spark and assembled as they
  stream by.  A sequence of more than ``most`` tokens comes in several pieces,
  cut between turns, so a very long conversation fills neither a row nor a
  worker.  Extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import runs, shipped
from candlespark.llm.tokens import CUT, FOLDER, REMEMBERED, ByteLevel, content, sequences

VOCABULARY = f"{FOLDER}/byte_bpe_50k.json"
LEARNT = ("assistant",)
#: Tokens of a piece; a single longer turn makes a piece of its own.
MOST = 1 << 20
# The marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"

ENCODED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("learn", pa.bool_()), ("head", pa.binary()), ("body", pa.binary())])
PIECE = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("n_turns", pa.int64()), ("ids", pa.list_(pa.int32())), ("loss", pa.list_(pa.int8()))])
READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()),
    ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("loss_tokens", pa.int64()),
])


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def role_line(role: str) -> str:
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n")) + "\n"


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(line))


class Encoder:
    """Ids of texts as bytes, word by word: each word is encoded once per task."""

    def __init__(self, spec: bytes):
        self.vocabulary = ByteLevel(spec)
        self.kind = np.dtype("<u2" if self.vocabulary.size + 2 <= 1 << 16 else "<u4")
        self.known: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [CUT.split(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        fresh = list({w for words in cut for w in words if w not in self.known})
        for k in range(0, len(fresh), 4096):
            part = fresh[k : k + 4096]
            self.known.update(zip(part, (np.array(i, self.kind).tobytes() for i in self.vocabulary.ids(part))))
        return [b"".join([self.known[w] for w in words]) for words in cut]


def encode(conversations: DataFrame, vocabulary: str = VOCABULARY, learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """(conv_id, turn, learn, head, body): role lines and escaped texts as little-endian ids, two bytes each if they fit."""
    spec = content(conversations.sparkSession, vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, heads = Encoder(spec), {}
        for batch in batches:
            for a, b, data, bounds in runs(batch["text"]):
                raw = data.tobytes()
                roles = [r or "" for r in batch["role"].slice(a, b - a).to_pylist()]
                new = list({r for r in roles if r not in heads})
                if len(heads) > 10_000:
                    heads, new = {}, list(set(roles))
                heads.update(zip(new, encoder([role_line(r) for r in new])))
                bodies = encoder([escape(raw[x:y].decode()) for x, y in zip(bounds, bounds[1:])])
                yield pa.RecordBatch.from_arrays([
                    batch["conv_id"].slice(a, b - a).cast(pa.int64()), batch["turn"].slice(a, b - a).cast(pa.int64()),
                    pa.array([r in learnt for r in roles], pa.bool_()), pa.array([heads[r] for r in roles], pa.binary()), pa.array(bodies, pa.binary()),
                ], schema=ENCODED)

    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(encoded, "conv_id long, turn long, learn boolean, head binary, body binary")


def assemble(turns: DataFrame, vocabulary: str = VOCABULARY, most: int = MOST) -> DataFrame:
    """(conv_id, piece, n_turns, ids, loss): sequences of :func:`encode`'s rows, the pieces of one after each other."""
    spec = content(turns.sparkSession, vocabulary)

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(spec)
        kind, size = encoder.kind, encoder.vocabulary.size
        start, end = np.array([size], kind), np.array([size + 1], kind)
        tail = np.frombuffer(encoder(["\n"])[0], kind)

        def piece(conv, number, parts, learn, n):
            ids = np.concatenate(parts)
            # Prefix sums: of the parts' lengths for the edges, of the edges' signs for the mask.
            edge = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
            sign = np.zeros(len(ids) + 1, np.int8)
            at = np.flatnonzero(learn)
            np.add.at(sign, edge[at], 1)
            np.add.at(sign, edge[at + 1], -1)
            loss = np.cumsum(sign[:-1], dtype=np.int8)
            values = [[conv], [number], [n], [ids.astype(np.int32)], [loss]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(values, PIECE)], schema=PIECE)

        for conv, rows in sequences(batches, "conv_id"):
            number, parts, learn, n, held = 0, [], [], 0, 0
            for row in rows:
                head, body = np.frombuffer(row["head"], kind), np.frombuffer(row["body"], kind)
                parts += [start, head, body, end, tail]
                learn += [False, False, row["learn"], False, False]
                n, held = n + 1, held + len(head) + len(body) + 3
                if held >= most:
                    yield piece(conv, number, parts, learn, n)
                    number, parts, learn, n, held = number + 1, [], [], 0, 0
            if parts:
                yield piece(conv, number, parts, learn, n)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "head", "body"]
    return turns.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(assembled, "conv_id long, piece long, n_turns long, ids array<int>, loss array<tinyint>")


def format_chat(conversations: DataFrame, vocabulary: str = VOCABULARY, learnt: tuple[str, ...] = LEARNT, most: int = MOST) -> DataFrame:
    """(conv_id, piece, n_turns, ids, loss): one training sequence per conversation; ``loss`` is 1 on the texts of ``learnt`` roles."""
    return assemble(encode(conversations, vocabulary, learnt), vocabulary, most)


def read_back(formatted: DataFrame, vocabulary: str = VOCABULARY, stored: bool = False) -> DataFrame:
    """What the sequences say: turns and learnt text per conversation as digests and lengths, from ids and masks alone.

    ``stored``: the pieces come from a table and are brought into order first;
    otherwise they follow each other as :func:`format_chat` gives them.
    """
    spec = content(formatted.sparkSession, vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = ByteLevel(spec)
        start, end = v.size, v.size + 1
        for conv, pieces in sequences(batches, "conv_id"):
            turns, learnt = hashlib.sha256(), hashlib.sha256()
            n = learnt_chars = chars = tokens = learnt_tokens = 0
            for p in pieces:
                ids, loss = np.array(p["ids"], np.int64), np.array(p["loss"], bool)
                tokens, learnt_tokens = tokens + len(ids), learnt_tokens + int(loss.sum())
                for a, b in zip(np.flatnonzero(ids == start).tolist(), np.flatnonzero(ids == end).tolist()):
                    line, _, text = v.decode(ids[a + 1 : b].tolist()).partition("\n")
                    turns.update(f"{role_of(line)}\n{unescape(text)}\n".encode())
                    n, chars = n + 1, chars + len(START) + len(line) + 1 + len(text) + len(END) + 1
                edges = np.flatnonzero(np.diff(np.concatenate([[0], loss.astype(np.int8), [0]])))
                for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                    text = unescape(v.decode(ids[a:b].tolist()))
                    learnt.update(text.encode())
                    learnt_chars += len(text)
            values = [conv, n, turns.hexdigest(), learnt_chars, learnt.hexdigest(), chars, tokens, learnt_tokens]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, READ)], schema=READ)

    if stored:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return formatted.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, loss_tokens long"
    )


shipped(__name__)
