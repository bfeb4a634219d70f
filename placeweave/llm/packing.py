"""Best-fit packing: hierarchical residual packing of documents into sequences.

Every task tokenizes its documents, cuts the long ones into full pieces (the first piece is the short one) and packs its
pieces best-fit in order of decreasing length. Bins that are full or nearly so are final. The pieces of underfull bins are
what is left of a task; they go up as counts, one number a length, which a tree of additions brings to the root. There the
counts are packed best-fit, decreasing, whole classes of equal bins at a time, so the root's work depends on the capacity
and not on the table. Its layout says which ranks among the pieces of a length go to which sequences; a piece's rank is its
number within its task plus those of the tasks before. No piece is left out of that round, whatever number of tasks there
is, and no text is ever dropped.

Ids come from the byte-level BPE file's own vocabulary through tiktoken's merge loop, which gives the ids that the
tokenizers library gives for that file (tests hold them equal) in a quarter of its time. That loop takes the merges in the
order of their ids; a file whose merges have another order is refused. The text of an added token (``<|endoftext|>``) is
text like any other, unless ``special`` is set: then it becomes that token, as the tokenizers library has it by default.

Null text counts as empty: its document is the end id alone. Null ids and repeated rows are rows like others. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from placeweave.llm.common import joined_small, saved, slices

CAPACITY = 1024
END_ID = 2
#: A bin with this much room or less is final.
SLACK = 1
#: Items that a task packs at once.
CHUNK = 1 << 18


@lru_cache(1)
def encoding(tokenizer_path: str) -> tiktoken.Encoding:
    """A byte-level BPE file (tokenizers JSON) with its own vocabulary and the pattern of its pre-tokenizer."""
    import public_tokenizers

    with open(tokenizer_path, encoding="utf-8") as f:
        spec = json.load(f)
    # The byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for code points from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
    vocab = spec["model"]["vocab"]
    merged = [vocab["".join(pair.split(" ") if isinstance(pair, str) else pair)] for pair in spec["model"]["merges"]]
    if any(a >= b for a, b in zip(merged, merged[1:], strict=False)):
        raise ValueError(f"{tokenizer_path}: merges are not in the order of their ids")
    ranks = {bytes(back[c] for c in word): i for word, i in vocab.items() if word not in special}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encoder(tokenizer_path: str, special: bool = False) -> Callable[[str], list[int]]:
    """A text's ids; with ``special``, the texts of added tokens are these tokens."""
    found = encoding(tokenizer_path)
    literals = tuple(found.special_tokens_set) if special else ()
    return lambda text: found.encode(text, allowed_special="all") if any(x in text for x in literals) else found.encode_ordinary(text)


def pieces(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first, unless the document fits as it is."""
    first = n % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and offset, and the bins' fills."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, fills = 0, []
    where, offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
        else:
            room, b = capacity, len(fills)
            fills.append(0)
        where[i], offset[i] = b, fills[b]
        fills[b] += size
        rooms[room - size].append(b)
        mask |= 1 << (room - size)
    return where, offset, np.array(fills, np.int64)


def layout(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[tuple[int, int, int, int]]], int]:
    """Best-fit decreasing over counts of items by size: for each size, (first rank, one past the last, first bin, offset), and the bins.

    Bins of equal contents form a class, which takes items (and splits, if these are fewer) as one. A class is its number
    of bins, how far its ranks are shifted, and its items as a chain of (size, first rank, offset, chain before).
    """
    rooms: list[list[tuple]] = [[] for _ in range(capacity + 1)]
    mask = 0

    def put(room: int, group: tuple) -> None:
        nonlocal mask
        rooms[room].append(group)
        mask |= 1 << room

    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            fits = mask >> size
            if not fits:
                put(capacity, (-(-left // (capacity // size)), 0, None))
                continue
            room = size + (fits & -fits).bit_length() - 1
            n, shift, chain = rooms[room].pop()
            if not rooms[room]:
                mask ^= 1 << room
            m = min(n, left)
            if n > m:
                put(room, (n - m, shift + m, chain))
            put(room - size, (m, shift, (size, rank - shift, capacity - room, chain)))
            rank, left = rank + m, left - m
    out: dict[int, list[tuple[int, int, int, int]]] = {size: [] for size in counts}
    bins = 0
    for room in rooms:
        for n, shift, chain in room:
            while chain:
                size, first, offset, chain = chain
                out[size].append((first + shift, first + shift + n, bins, offset))
            bins += n
    return {size: sorted(x) for size, x in out.items()}, bins


#: ``bin`` and ``at``: where a final piece lies; ``nth``: the number of any other among its task's pieces of its length.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, at long, nth long, task long"


def _numbers(values: np.ndarray, so_far: np.ndarray) -> np.ndarray:
    """The number of each value among its equals, counting on from ``so_far`` (by value), which is brought up to date."""
    order = np.argsort(values, kind="stable")
    in_order = values[order]
    nth = np.empty(len(values), np.int64)
    nth[order] = np.arange(len(values)) - np.searchsorted(in_order, in_order) + so_far[in_order]
    so_far += np.bincount(values, minlength=len(so_far))
    return nth


def _tokenize_and_pack(tokenizer_path: str, capacity: int, with_ids: bool, special: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, sent = encoder(tokenizer_path, special), np.zeros(capacity + 1, np.int64)
        task, next_bin = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 40
        rows: list[list] = [[] for _ in range(6)]

        def emit() -> Iterator[pa.RecordBatch]:
            nonlocal next_bin, rows
            doc, piece, start, length, crc, ids = rows
            rows = [[] for _ in range(6)]
            sizes = np.array(length, np.int64)
            where, at, fills = best_fit(sizes, capacity)
            up = (fills < capacity - SLACK)[where]
            nth = np.full(len(sizes), -1)
            nth[up] = _numbers(sizes[up], sent)
            out = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(sizes), pa.array(crc, pa.int64()), pa.array(where + next_bin, mask=up), pa.array(at, mask=up), pa.array(nth, mask=~up), pa.array(np.full(len(sizes), task, np.int64))]
            names = [x.split()[0] for x in PIECES.split(", ")]
            if with_ids:
                out.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            next_bin += len(fills)
            yield from pa.Table.from_arrays(out, names=names).to_batches(1 << 16)

        cached: dict[str, bytes] = {}
        held = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = cached.get(text)
                if data is None:
                    ids = encode(text or "")
                    ids.append(END_ID)
                    data = array("I", ids).tobytes()
                    if len(data) < 1 << 16:  # copies of a text often stand close together
                        if len(cached) >= 512:
                            cached.clear()
                        cached[text] = data
                for i, (start, length) in enumerate(pieces(len(data) // 4, capacity)):
                    part = data[4 * start : 4 * (start + length)]
                    for to, value in zip(rows, (doc_id, i, start, length, zlib.crc32(part), np.frombuffer(part, np.int32) if with_ids else None), strict=True):
                        to.append(value)
                    held += 64 + (8 * length if with_ids else 0)
            if len(rows[0]) >= CHUNK or held >= 32 << 20:
                yield from emit()
                held = 0
        if rows[0]:
            yield from emit()

    return run


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, with_ids: bool = False, special: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32, sequence_id, offset and, if wanted, ids) of every document's pieces."""
    schema = PIECES + (", ids array<int>" if with_ids else "")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_tokenize_and_pack(tokenizer_path, capacity, with_ids, special), schema)
    rows = saved(rows, "pieces")
    loose = rows.where("nth is not null")
    counts = saved(loose.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # ``capacity`` rows at most
    places = {size: np.array(x, np.int64).reshape(-1, 4) for size, x in layout(totals, capacity)[0].items()}
    before = counts.select("task", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")).alias("before"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", *(["ids"] if with_ids else [])]
    ranked = joined_small(loose, saved(before, "before"), ["task", "length"], "inner").withColumns({"sequence_id": F.col("before") + F.col("nth"), "offset": F.lit(0).cast("long")}).select(*columns)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("sequence_id").to_numpy()
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for size in np.unique(length):
                own, ranges = np.flatnonzero(length == size), places[int(size)]
                at = np.searchsorted(ranges[:, 0], rank[own], side="right") - 1
                sequence[own] = -1 - (ranges[at, 2] + rank[own] - ranges[at, 0])
                offset[own] = ranges[at, 3]
            new = {"sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in columns], names=columns)

    final = rows.where("nth is null").withColumns({"sequence_id": F.col("bin"), "offset": F.col("at")}).select(*columns)
    return final.unionByName(ranked.mapInArrow(place, final.schema))
