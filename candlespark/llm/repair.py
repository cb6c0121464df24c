"""Conversation structure repair: the cheapest edits that give ``(s?(ua)+)?``.

Rows and the four states of that pattern form a lattice whose edges are edits.
A forward and a reverse Dijkstra search run towards each other; they stop only
when no path as cheap as the best can cross any more, so all equal-cost
crossings are known, and the least concatenated audit among them is taken.

* **Faults.** The first that holds: *blank* (no character outside
  ``[\\x20\\x09-\\x0D]``), *duplicate* (role and text seen earlier), *truncated*
  (the last such character is none of ``.!?``).
* **Edits.** Keep, Rerole (to user or assistant), Delete (the only one for blank
  and duplicate rows), Insert (an empty text); a truncated row that stays adds
  ``truncated``.  Inserts must cost more than nothing, the others at least that.
* **Order.** By turn, nulls first, then role, then SHA-256 of the text.
  Repeated rows stay and are duplicates.  A null role or text counts as one
  space; a role is what its first character says.  A null conv_id is a
  conversation of its own; an empty table gives no rows.
* **Size.** No text enters the search: rows come as a role, three flags and a
  digest, sorted by Spark, and take some hundred bytes each while their
  conversation is searched.  Texts meet the finished audit in a stream.
  Equal-cost candidates are compared back to where their paths parted.
  Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlespark.llm.common import WHITE, shipped
from candlespark.llm.tokens import sequences

# States of the pattern (before anything, after s, u, a) and what each role initial leads to.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FINAL = (0, 3)
FOLLOWS = {"su", "ua", "au"}
ROLES = {"u": "user", "a": "assistant"}

PLAN = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())])
TURNS = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


@dataclass(frozen=True)
class Costs:
    keep: int = 0
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


class Half:
    """One of the two searches: settled nodes with their least cost and, among equals, their least audit.

    A node is ``(i, state)``: ``i`` rows are behind it.  Nodes of one cost
    settle in the order of their rows, so that edges that cost nothing come
    after all that lead to their start; a label is final when it settles.
    """

    def __init__(self, edges, starts, ahead: bool):
        self.edges, self.ahead = edges, ahead
        self.cost: dict = {}
        self.link: dict = {s: None for s in starts}  #: node -> (letter, neighbour towards the start)
        self.best = {s: 0 for s in starts}
        self.heap: list = []
        for s in starts:
            self.push(0, s)

    def push(self, cost, node):
        heappush(self.heap, (cost, node[0] if self.ahead else -node[0], node))

    def top(self):
        while self.heap and self.heap[0][2] in self.cost:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self):
        cost, _, node = heappop(self.heap)
        self.cost[node] = cost
        for letter, price, other in self.edges(node):
            total = cost + price
            if other in self.cost:
                continue
            old = self.best.get(other)
            if old is None or total < old:
                self.best[other], self.link[other] = total, (letter, node)
                self.push(total, other)
            elif total == old and self.less((letter, node), self.link[other]):
                self.link[other] = (letter, node)
        return node

    def less(self, a, b) -> bool:
        """Whether the audit that ends (or begins) with link ``a`` is the smaller one."""
        if b is None:
            return False
        if not self.ahead:
            while a != b:
                if a is None or b is None or a[0] != b[0]:
                    return a is None or (b is not None and a[0] < b[0])
                a, b = self.link[a[1]], self.link[b[1]]
            return False
        # Both begin at the source: the letters after the node where they parted decide, so walk back
        # to it; a node further on (more rows, then more inserts) is the one to leave first.
        left, right = [a[0]], [b[0]]
        x, y = a[1], b[1]
        while x != y:
            if (x[0], self.cost[x]) >= (y[0], self.cost[y]):
                letter, x = self.link[x]
                left.append(letter)
            else:
                letter, y = self.link[y]
                right.append(letter)
        return left[::-1] < right[::-1]

    def audit(self, node) -> str:
        letters, link = [], self.link[node]
        while link is not None:
            letters.append(link[0])
            link = self.link[link[1]]
        return "".join(letters[::-1] if self.ahead else letters)


def cheapest(initials: list[str], faults: list[str], costs: Costs = Costs()) -> tuple[int, str]:
    """Least cost and least audit.  ``faults``: ``b``, ``d``, ``t`` or empty, per row."""
    n = len(initials)
    assert costs.insert > 0 and min(costs.keep, costs.rerole, costs.delete, costs.truncated) >= 0
    back: dict[int, list[tuple[str, int]]] = {}
    for (state, c), to in STEP.items():
        back.setdefault(to, []).append((c, state))

    def row_edits(i, c):
        """Edits of row ``i`` that make it a ``c``."""
        if faults[i] in ("b", "d"):
            return
        more = costs.truncated if faults[i] == "t" else 0
        if initials[i] == c:
            yield "K", costs.keep + more
        if c in ROLES:
            yield "R", costs.rerole + more

    def onward(node):
        i, state = node
        for c in "sua":
            to = STEP.get((state, c))
            if to is None:
                continue
            if c in ROLES:
                yield "I", costs.insert, (i, to)
            if i < n:
                for letter, price in row_edits(i, c):
                    yield letter, price, (i + 1, to)
        if i < n:
            yield "D", costs.delete, (i + 1, state)

    def backward(node):
        i, state = node
        for c, origin in back.get(state, ()):
            if c in ROLES:
                yield "I", costs.insert, (i, origin)
            if i:
                for letter, price in row_edits(i - 1, c):
                    yield letter, price, (i - 1, origin)
        if i:
            yield "D", costs.delete, (i - 1, state)

    ahead, behind = Half(onward, [(0, 0)], True), Half(backward, [(n, s) for s in FINAL], False)
    best: int | None = None
    crossings: set[tuple] = set()

    def crossing(total, *where):
        nonlocal best, crossings
        if best is None or total < best:
            best, crossings = total, set()
        if total == best:
            crossings.add(where)

    while True:
        a, b = ahead.top(), behind.top()
        # A path not seen yet costs at least both tops together; equal ones still matter for the audit.
        if a is None and b is None or best is not None and (a or 0) + (b or 0) > best:
            break
        if b is None or (a is not None and a <= b):
            node = ahead.settle()
            if node in behind.cost:
                crossing(ahead.cost[node] + behind.cost[node], node, "", node)
            for letter, price, other in onward(node):
                if other in behind.cost:
                    crossing(ahead.cost[node] + price + behind.cost[other], node, letter, other)
        else:
            node = behind.settle()
            if node in ahead.cost:
                crossing(ahead.cost[node] + behind.cost[node], node, "", node)
            for letter, price, other in backward(node):
                if other in ahead.cost:
                    crossing(ahead.cost[other] + price + behind.cost[node], other, letter, node)
    return best, min(ahead.audit(x) + letter + behind.audit(y) for x, letter, y in crossings)


def _slim(conversations: DataFrame) -> DataFrame:
    """Rows with their place in the order: turn, role, digest of the text; and what their text shows by itself."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    last = F.right(F.rtrim("text", F.lit(WHITE.decode())), F.lit(1))
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), role.alias("role"), text.alias("text")).select(
        "conv_id", "turn", "role", F.unhex(F.sha2("text", 256)).alias("digest"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), "text"
    )


def _in_order(rows: DataFrame, *before) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *before, F.col("turn").asc_nulls_first(), "role", "digest")


def plan(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) per conversation."""

    def planned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in sequences(batches, "conv_id"):
            initials, faults, seen, turns, low, high = [], [], set(), 0, None, None
            for row in rows:
                key = sha256(row["role"].encode() + b"\0" + row["digest"]).digest()
                faults.append("b" if row["blank"] else "d" if key in seen else "t" if row["cut"] else "")
                seen.add(key)
                initials.append(row["role"][:1])
                if row["turn"] is not None:
                    turns += row["turn"] != high
                    low, high = row["turn"] if low is None else low, row["turn"]
            gaps = 0 if low is None else high - low + 1 - turns
            illegal = sum(a + b not in FOLLOWS for a, b in zip(initials, initials[1:]))
            cost, audit = cheapest(initials, faults, costs)
            values = [conv, gaps, *[faults.count(f) for f in "bdt"], illegal, cost, audit]
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, PLAN)], schema=PLAN)

    schema = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    return _in_order(_slim(conversations).drop("text")).mapInArrow(planned, schema)


def apply(conversations: DataFrame, plans: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired turns, conversation by conversation in their order.

    An audit fixes the roles: rows that are kept keep theirs, and all others
    are what the pattern asks for at their place.
    """

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for conv, rows in sequences(batches, "conv_id"):
            audit = next(rows)["text"]
            at = position = state = 0

            def following():
                c = next(c for c in "ua" if (state, c) in STEP)
                return STEP[state, c], ROLES[c]

            def inserts():
                nonlocal at, position, state
                while at < len(audit) and audit[at] == "I":
                    state, role = following()
                    out.append((conv, position, "I", role, ""))
                    at, position = at + 1, position + 1

            for row in rows:
                inserts()
                edit, role, at = audit[at], row["role"], at + 1
                if edit == "D":
                    continue
                if edit == "K":
                    state = STEP[state, role[:1]]
                else:
                    state, role = following()
                out.append((conv, position, edit, role, row["text"]))
                position, held = position + 1, held + len(row["text"])
                if held > 1 << 20 or len(out) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), TURNS)], schema=TURNS)
                    out, held = [], 0
            inserts()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out), TURNS)], schema=TURNS)

    audits = plans.select(
        F.col("conv_id").cast("long"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"),
        F.col("audit").alias("text"), F.lit(0).alias("kind"),
    )
    rows = _slim(conversations).select("conv_id", "turn", "role", "digest", "text", F.lit(1).alias("kind"))
    ordered = _in_order(audits.unionByName(rows), "kind").select("conv_id", "role", "text")
    return ordered.mapInArrow(repaired, "conv_id long, position long, edit string, role string, text string")


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of :func:`apply`'s rows as they stream by: ``role:text`` joined by line ends."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, rows in sequences(batches, "conv_id"):
            total, between = sha256(), ""
            for row in rows:
                total.update(f"{between}{row['role']}:{row['text']}".encode())
                between = "\n"
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([total.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return turns.select("conv_id", "role", "text").mapInArrow(digested, "conv_id long, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """Known faults by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    columns = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat_ws(":", *columns)) % 20
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    changed = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1)
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), changed.alias("text"), F.explode(F.array_repeat(F.lit(1), copies)).alias("_c"))
    return rows.drop("_c")


def repaired(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """:func:`plan` with the digest of the repaired conversation."""
    plans = plan(conversations, costs)
    return plans.alias("p").join(digests(apply(conversations, plans)).alias("d"), F.expr("p.conv_id <=> d.conv_id"), "left").select(
        "p.*", F.coalesce("d.repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256")
    )


shipped(__name__)
