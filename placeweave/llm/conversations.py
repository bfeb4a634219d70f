"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate.

``repair`` looks at each conversation's rows in the order of turn (nulls first), role and text. A row's first fault counts:
blank (white space only), duplicate (role and text seen earlier), truncated (its last visible character does not end a
sentence). Edits: K keeps a row (cost 0), R gives it the role that is due (2), D deletes it (3; blank and duplicate rows have
to go), I inserts an empty row of the role that is due (2); a truncated row that stays adds 1. The roles that stay are a
system row or none, then pairs of user and assistant, or nothing at all.

A conversation is a graph of (rows read, role state) with arcs of these costs. Dial's algorithm finds all distances to its end:
arcs cost 3 at most, so four buckets in a ring serve as its queue. Walking from the start along arcs that the distances show
to be tight, by the smallest letter each time, gives the audit: of the cheapest edits' letters the least.

Equal rows of a conversation collapse to a count before they are shuffled, and where a role and text was first seen is an
aggregation and a join. The rest is one stream per conversation over rows sorted by Spark, because the digest of what stays
reads it in order: such a stream holds one byte and the distances (16 bytes) a row in memory; texts wait in a scratch file
without a name once they are more than SPOOL. So one huge conversation takes one task long, but not much memory; its audit
has to fit a cell (2 GB).

Nulls in role and text count as one space. A null conversation id is a conversation like others; repeated rows are duplicates.
Rows with ``copies`` of 0 only name their conversation: one without any row has zeros, no audit and no text. Further columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import tempfile
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import slices

SPOOL = 4 << 20
SPACE = " \t\n\x0b\x0c\r"
#: A row's code: the place of its role's initial in this string, plus TRUNCATED or GONE.
INITIALS, TRUNCATED, GONE = "sua-", 4, 8
LEGAL = {"su", "ua", "au"}
#: States: start, after system, after user, after assistant. What is due in each; where a kept initial leads (-1: nowhere).
DUE = (2, 2, 3, 2)
STEP = ((1, 2, -1, -1), (-1, 2, -1, -1), (-1, -1, 3, -1), (-1, 2, -1, -1))
ROLE = {2: "user", 3: "assistant"}
ENDS = (0, 3)
KEEP, REROLE, DELETE, INSERT = 0, 2, 3, 2
BUCKETS = 4


def distances(codes: bytes) -> array:
    """The cost from each node (4 * rows read + state) to the end, by Dial's algorithm over the arcs backwards."""
    far = 1 << 30
    dist = array("i", [far]) * (4 * len(codes) + 4)
    ring: list[list[int]] = [[4 * len(codes) + s for s in ENDS], [], [], []]
    for node in ring[0]:
        dist[node] = 0
    at = 0
    while any(ring):
        now, ring[at % BUCKETS] = ring[at % BUCKETS], []
        for node in now:
            if dist[node] != at:
                continue
            i, state = node >> 2, node & 3
            back = [(4 * i + s, INSERT) for s in range(4) if DUE[s] == state]
            if i:
                code = codes[i - 1]
                back.append((node - 4, DELETE))
                if code < GONE:
                    extra = code // TRUNCATED
                    back += [(4 * i - 4 + s, KEEP + extra) for s in range(4) if STEP[s][code % TRUNCATED] == state]
                    back += [(4 * i - 4 + s, REROLE + extra) for s in range(4) if DUE[s] == state]
            for before, cost in back:
                if at + cost < dist[before]:
                    dist[before] = at + cost
                    ring[(at + cost) % BUCKETS].append(before)
        if not ring[at % BUCKETS]:
            at += 1
    return dist


def _walk(codes: bytes) -> tuple[int, str]:
    """The least cost and the least audit of that cost."""
    dist, i, state, audit = distances(codes), 0, 0, []
    cost = dist[0]
    while i < len(codes) or state not in ENDS:
        left = dist[4 * i + state]
        code = codes[i] if i < len(codes) else GONE
        extra = code // TRUNCATED
        if i < len(codes) and DELETE + dist[4 * i + 4 + state] == left:
            audit.append("D")
            i += 1
        elif INSERT + dist[4 * i + DUE[state]] == left:
            audit.append("I")
            state = DUE[state]
        elif code < GONE and (to := STEP[state][code % TRUNCATED]) >= 0 and KEEP + extra + dist[4 * i + 4 + to] == left:
            audit.append("K")
            i, state = i + 1, to
        else:
            audit.append("R")
            i, state = i + 1, DUE[state]
    return cost, "".join(audit)


_often = lru_cache(1 << 14)(_walk)


def cheapest(codes: bytes) -> tuple[int, str]:
    return _often(codes) if len(codes) <= 32 else _walk(codes)


class _Stream:
    """One conversation's rows, read once in order."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.codes, self.last, self.turn = conv_id, bytearray(), None, None
        self.first, self.turns = None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.texts = tempfile.SpooledTemporaryFile(SPOOL)  # noqa: SIM115

    def add(self, turn: int | None, role: str, text: str, n: int, fresh: bool) -> None:
        if not n:
            return
        if turn is not None and turn != self.turn:
            self.first = turn if self.first is None else self.first
            self.turn, self.turns = turn, self.turns + 1
        seen = text.rstrip(SPACE)
        initial = INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3
        blank, cut = not seen, not seen.endswith((".", "!", "?"))
        again = n - (1 if fresh else 0)
        if blank:
            self.blank += n
        else:
            self.duplicate += again
            self.truncated += n - again if cut else 0
        self.illegal += (self.last is not None and self.last + role[:1] not in LEGAL) + (n - 1) * (role[:1] * 2 not in LEGAL)
        self.last = role[:1]
        for k in range(n):
            self.codes.append(GONE + initial if blank or k >= n - again else initial + TRUNCATED * cut)
        if not blank and again < n:
            for part in (role, text):
                data = part.encode()
                self.texts.write(len(data).to_bytes(8, "little"))
                self.texts.write(data)

    def _kept(self, audit: str) -> Iterator[tuple[str, bytes]]:
        """Roles and texts of the rows that stay. The scratch file has the rows that may."""
        self.texts.seek(0)
        i = state = 0
        for letter in audit:
            if letter == "I":
                state = DUE[state]
                yield ROLE[state], b""
                continue
            code, i = self.codes[i], i + 1
            if code >= GONE:
                continue
            role, text = (self.texts.read(int.from_bytes(self.texts.read(8), "little")) for _ in range(2))
            if letter == "D":
                continue
            state = STEP[state][code % TRUNCATED] if letter == "K" else DUE[state]
            yield role.decode() if letter == "K" else ROLE[state], text

    def result(self, with_text: bool) -> tuple:
        cost, audit = cheapest(bytes(self.codes))
        digest, whole, first = hashlib.sha256(), [], True
        for role, text in self._kept(audit):
            for part in (b"" if first else b"\n", role.encode(), b":", text):
                digest.update(part)
                if with_text:
                    whole.append(part)
            first = False
        self.texts.close()
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        found = (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, digest.hexdigest())
        return (*found, b"".join(whole).decode()) if with_text else found


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats
    it, 4 makes it the user's. ``copies`` says how often a row is there."""
    name = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(name) % 20).alias("k"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("k") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("k") == 1, "").when(F.col("k") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("k") == 0, 0).when(F.col("k") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame, with_text: bool = False) -> DataFrame:
    """RESULT for each conversation of ``rows`` (conv_id, turn, role, text and, if there, copies: 1); ``with_text`` adds ``repaired``:
    the lines ``role:text`` that stay."""
    copies = F.col("copies") if "copies" in rows.columns else F.lit(1)
    given = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), copies.cast("long").alias("n"))
    there = F.col("n") > 0
    given = given.withColumns({"turn": F.when(there, F.col("turn")), "role": F.when(there, F.col("role")).otherwise(""), "text": F.when(there, F.col("text")).otherwise("")})
    once = given.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    once = once.withColumn("key", F.sha2(F.concat_ws("\0", F.coalesce(F.col("conv_id").cast("string"), F.lit("")), F.length("role").cast("string"), "role", "text"), 256))
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    first = once.where("n > 0").groupBy("key").agg(F.min(turn).alias("first"))
    marked = once.join(first, "key", "left").select("conv_id", "turn", "role", "text", "n", F.coalesce(F.col("first") == turn, F.lit(True)).alias("fresh"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, done, size = None, [], 0
        schema = pa.schema([(name, pa.string() if name in ("audit", "repaired_sha256", "repaired") else pa.int64()) for name in (x.split()[0] for x in full.split(", "))])

        def out() -> pa.RecordBatch:
            nonlocal done, size
            rows, done, size = done, [], 0
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

        def close() -> None:
            nonlocal size
            done.append(stream.result(with_text))
            size += 200 + sum(len(x) for x in done[-1] if isinstance(x, str))

        for batch in slices(batches):
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is None or stream.conv_id != conv_id:
                    if stream is not None:
                        close()
                    stream = _Stream(conv_id)
                stream.add(*row)
            if size > SPOOL:
                yield out()
        if stream is not None:
            close()
            yield out()

    full = RESULT + (", repaired string" if with_text else "")
    return marked.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(run, full)
