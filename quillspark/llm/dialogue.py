"""Conversation structure repair: the cheapest edits that give a conversation the shape ``(s?(ua)+)?`` of its role initials.

A conversation of n rows is a lattice of nodes (row, state of the shape); arcs keep, rerole or delete the next row or insert
an empty turn, at whole-number costs. The auction algorithm finds the shortest path from the first node: a path grows from the
origin, its last node bids the least of cost + price over its arcs; where its own price is lower it takes that price and
the path contracts, else the path extends along that arc. When the path meets the sink, prices satisfy price(i) <= cost + price(j)
on every arc, with equality (tight arcs) on all arcs of all shortest paths, so the ASCII-least of the cheapest edit strings
is traced along tight arcs that lead to the sink.

Long conversations are cut into windows of rows. From the last window to the first, an auction from each of the four entry states
gives the costs at which the window before may leave; the trace then runs from the first to the last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import bounded_batches, written

# Fixed values of the contract: costs, white space, marks that end a text.
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: Rows of a window of the lattice.
WINDOW = 16
#: Text of a conversation that a task holds until its edits are known; a longer one is hashed in a second, streamed pass.
HELD_BYTES = 8 << 20

# States: nothing yet, after s, after u, after a. Per state: the state that each initial leads to, and the role that comes next.
START, SYSTEM, USER, ASSISTANT = range(4)
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = ((USER, "user"), (USER, "user"), (ASSISTANT, "assistant"), (USER, "user"))
ACCEPTED = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}

# A row of the lattice is one byte: its initial, whether it must go, whether it is cut off.
INITIALS = "sua"
MUST_GO, CUT_OFF = 4, 8

OUT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
KINDS = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                   ("audit", pa.string()), ("repaired_sha256", pa.string())])

Arc = tuple[int, str, int]


def row_code(initial: str, must_go: bool, cut_off: bool) -> int:
    return (INITIALS.find(initial) % 4 if initial else 3) | (MUST_GO if must_go else 0) | (CUT_OFF if cut_off else 0)


def lattice(codes: bytes, leave: tuple[int, ...] | None) -> list[list[Arc]]:
    """Arcs (cost, label, head) of every node 4 * row + state; the last node is the sink. ``leave`` are the costs from each
    state after the last row on; None where the conversation ends there."""
    arcs: list[list[Arc]] = [[] for _ in range(4 * len(codes) + 5)]
    sink = len(arcs) - 1
    for row in range(len(codes) + 1):
        for state in range(4):
            at, mine = 4 * row, arcs[4 * row + state]
            after = NEXT[state][0]
            if row < len(codes):
                code = codes[row]
                if not code & MUST_GO:
                    worse = CUT if code & CUT_OFF else 0
                    to = FOLLOWS[state].get("sua?"[code & 3])
                    if to is not None:
                        mine.append((worse, "K", at + 4 + to))
                    mine.append((REROLE + worse, "R", at + 4 + after))
                mine.append((DELETE, "D", at + 4 + state))
            elif leave is not None:
                mine.append((leave[state], "", sink))
                continue
            elif state in ACCEPTED:
                mine.append((0, "", sink))
            mine.append((INSERT, "I", at + after))
    return arcs


def auction(arcs: list[list[Arc]], price: list[int], origin: int) -> int:
    """Cost of the shortest path from ``origin`` to the sink. ``price`` must satisfy price(i) <= cost + price(j) on every arc, as zeros
    do, and still does so afterwards. Every cycle costs something, so a path never meets itself."""
    sink, path = len(arcs) - 1, [origin]
    while (i := path[-1]) != sink:
        bid, head = min((cost + price[j], j) for cost, _, j in arcs[i])
        if price[i] < bid:
            price[i] = bid
            if len(path) > 1:
                path.pop()
        else:
            path.append(head)
    return price[origin] - price[sink]


def trace(arcs: list[list[Arc]], price: list[int], origin: int) -> tuple[str, int]:
    """ASCII-least labels along tight arcs from ``origin`` to the sink, and the state before the sink. No two arcs of a node
    share a label, so one node at a time is enough."""
    sink, leads = len(arcs) - 1, {len(arcs) - 1: True}

    def tight(i: int) -> list[Arc]:
        return [a for a in arcs[i] if price[i] == a[0] + price[a[2]]]

    def reaches(i: int) -> bool:
        stack = [i]  # tight arcs form no cycle
        while stack:
            i = stack[-1]
            todo = [j for _, _, j in tight(i) if j not in leads] if i not in leads else []
            if todo:
                stack.extend(todo)
            else:
                stack.pop()
                leads.setdefault(i, any(leads[j] for _, _, j in tight(i)))
        return leads[i]

    labels, i = [], origin
    while True:
        _, label, j = min((a for a in tight(i) if reaches(a[2])), key=lambda a: a[1])
        if j == sink:
            return "".join(labels), i % 4
        labels.append(label)
        i = j


def cheapest(codes: bytes, window: int = WINDOW) -> tuple[int, str]:
    """Least cost of the edits of a conversation and the ASCII-least string of their initials."""
    cuts = [codes[at : at + window] for at in range(0, len(codes), window)] or [b""]
    leave, later, exits = None, 0, []
    for part in reversed(cuts[1:]):
        exits.append(leave)
        costs = entry_costs(part, leave)
        least = min(costs)  # only differences matter to a window; prices then stay as small as in a short conversation
        leave, later = tuple(c - least for c in costs), later + least
    audit, state, cost = [], START, None
    for part in cuts:
        total, labels, state = window_path(part, leave, state)
        cost = total + later if cost is None else cost
        audit.append(labels)
        leave = exits.pop() if exits else None
    return cost, "".join(audit)


@lru_cache(maxsize=20_000)
def entry_costs(codes: bytes, leave: tuple[int, ...] | None) -> tuple[int, ...]:
    """Costs from each entry state of a window; the prices of one auction serve the next."""
    arcs = lattice(codes, leave)
    price = [0] * len(arcs)
    return tuple(auction(arcs, price, state) for state in range(4))


@lru_cache(maxsize=20_000)
def window_path(codes: bytes, leave: tuple[int, ...] | None, state: int) -> tuple[int, str, int]:
    arcs = lattice(codes, leave)
    price = [0] * len(arcs)
    cost = auction(arcs, price, state)
    return cost, *trace(arcs, price, state)


def repaired(rows: Iterable[tuple[str, str]], audit: str) -> Iterator[str]:
    """``role:text`` of the repaired conversation, in order."""
    rows, state = iter(rows), START
    for edit in audit:
        role, text = next(rows) if edit != "I" else (None, "")
        if edit == "D":
            continue
        if edit == "K":
            state = FOLLOWS[state][role[0]]
        else:
            state, role = NEXT[state]
        yield f"{role}:{text}"


def hashed(lines: Iterable[str]) -> str:
    """SHA-256 of the lines joined by line ends, one line in memory at a time."""
    sha = hashlib.sha256()
    for i, line in enumerate(lines):
        sha.update(("\n" if i else "").encode() + line.encode())
    return sha.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after damage, (conv_id, turn, role, text, dropped); rows that the damage drops stay with ``dropped``, so that no
    conversation is lost."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(kind == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (kind == 0).alias("dropped"), F.array_repeat(F.lit(0), F.when(kind == 3, 2).otherwise(1)).alias("times"))
    return rows.withColumn("times", F.explode("times")).drop("times")


def faults(rows: DataFrame) -> DataFrame:
    """Damaged rows with ``blank``, ``again`` (role and text seen earlier) and ``cut`` (no end mark), dealt by conversation and in order
    within it. One shuffle: the window over equal rows is dealt by conversation as well."""
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "again"]
    equal = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.repartition("conv_id").withColumn("digest", F.sha2("text", 256)).withColumn("again", F.row_number().over(equal) > 1)
    return rows.select("conv_id", "turn", "role", "text", "dropped", "again", (body == "").alias("blank"),
                       (~F.substring(body, -1, 1).isin(*ENDS)).alias("cut")).sortWithinPartitions(*order)


class _Conversation:
    """What a task keeps of the conversation it reads: counts, a byte per row, and the texts while they are few."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.kept, self.size = conv_id, bytearray(), [], 0
        self.turns = self.blank = self.again = self.cut = self.illegal = 0
        self.least = self.last = self.before = None

    def add(self, r: dict, held_bytes: int) -> None:
        if r["dropped"]:
            return
        turn, initial = r["turn"], r["role"][:1]
        if turn is not None and turn != self.last:
            self.least = turn if self.least is None else self.least
            self.last, self.turns = turn, self.turns + 1
        blank, again = r["blank"], r["again"] and not r["blank"]
        cut = r["cut"] and not blank and not again
        self.blank, self.again, self.cut = self.blank + blank, self.again + again, self.cut + cut
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.codes.append(row_code(initial, blank or again, cut))
        self.size += len(r["role"]) + len(r["text"]) + 100
        if self.kept is not None:
            self.kept.append((r["role"], r["text"]))
            if self.size > held_bytes:
                self.kept = None

    def row(self) -> dict:
        cost, audit = cheapest(bytes(self.codes))
        sha = None if self.kept is None else hashed(repaired(self.kept, audit))
        gaps = self.last - self.least + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": self.blank, "duplicate": self.again, "truncated": self.cut,
                "illegal": self.illegal, "cost": cost, "audit": audit, "repaired_sha256": sha}


def repair(conversations: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """One row per conv_id (``OUT``) of ``conversations`` (conv_id, turn, role, text) after the damage of ``damaged``.

    Null roles and texts are one space, a null conv_id is a conversation, null turns come first; rows of one turn are in the
    order of role and text. Repeated rows are duplicates of the first. Very long texts count whole; of a very long conversation
    a task keeps a byte per row and its edits, and a second pass in the same order hashes its texts as they go by. Conversations without rows
    after damage have zeros and empty strings. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(conversations.sparkSession)
    rows = damaged(conversations)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, out = None, []
        for batch in batches:
            for r in batch.to_pylist():
                if open_ is None or r["conv_id"] != open_.conv_id:
                    if open_ is not None:
                        out.append(open_.row())
                    open_ = _Conversation(r["conv_id"])
                open_.add(r, held_bytes)
            yield pa.RecordBatch.from_pylist(out, schema=KINDS)
            out = []
        if open_ is not None:
            yield pa.RecordBatch.from_pylist([open_.row()], schema=KINDS)

    found = written(faults(rows).mapInArrow(read, OUT), "repairs")
    long_ = found.where("repaired_sha256 is null").select("conv_id", "audit")
    if long_.isEmpty():
        return found
    late = hash_long(rows.where("not dropped"), long_).withColumnRenamed("conv_id", "_id")
    both = found.join(late, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", "sha")).drop("_id", "sha")


def hash_long(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """(conv_id, sha) of the conversations that ``audits`` names: their audit goes first, their rows stream after it."""
    named = audits.select(F.col("conv_id").alias("_id"))
    texts = rows.join(named, F.col("conv_id").eqNullSafe(F.col("_id")), "left_semi").select("conv_id", F.lit(1).alias("part"), "turn", "role", "text")
    heads = audits.select("conv_id", F.lit(0).alias("part"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"))
    order = [F.col("conv_id").asc_nulls_first(), "part", F.col("turn").asc_nulls_first(), "role", "text"]
    kinds = pa.schema([("conv_id", pa.int64()), ("sha", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        rows = (r for batch in batches for r in batch.to_pylist())
        for conv_id, group in groupby(rows, key=lambda r: r["conv_id"]):
            audit = next(group)["text"]
            sha = hashed(repaired(((r["role"], r["text"]) for r in group), audit))
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "sha": sha}], schema=kinds)

    return heads.union(texts).repartition("conv_id").sortWithinPartitions(*order).mapInArrow(read, "conv_id long, sha string")
