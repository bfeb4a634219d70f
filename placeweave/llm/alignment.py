"""Cross-tokenizer alignment with a dictionary of groups.

A text is tokenized twice: with a space before it by a byte-level BPE (A), and by a SentencePiece BPE that puts that space there
itself (B). Places where tokens of both end cut the text into groups; inside a group, every A token is linked with the B tokens
whose bytes it overlaps. Few distinct groups make up all texts, so they are interned: tokenized, linked and counted once each.

1. No token of either goes from a visible character to a space or line end after it (A's pattern cuts there; B's pieces are checked),
   so there a text falls into segments that can be tokenized without the rest of it. A task interns segments and, in them, groups: every distinct segment is encoded
   once, every distinct group's links are expanded once. A chunk of documents keeps, for each document, which groups it has how
   often; and how many of its documents hold each linked id pair (distinct documents, whatever groups the pair comes from).
2. Pairs: the chunks' counts are added up; an A id's highest is taken from them (one row an A id: bounded by the vocabulary).
3. Groups: each distinct group's links meet their pairs' counts and are added up by group.
4. Every chunk gets the two sums of its groups, which its documents multiply by their frequencies.

A group is known by its ids themselves; there are no hashes. Texts that are null or empty, or whose B tokens do not spell them
(a text that holds U+2581), have no tokens: zeros and an empty digest. The strings of special tokens are plain text. Null ids
and repeated rows are documents like others, each counted; further columns are ignored. An empty table gives an empty result. A
task holds one chunk (CHUNK bytes of text, or one document where that is longer) and the segments of one (SEGMENTS).
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import joined_small, saved, slices
from placeweave.llm.packed import pack, unpack
from placeweave.llm.packing import encoding

CHUNK, SEGMENTS = 8 << 20, 1 << 19
#: Where a segment ends: before a space or line end that follows a visible character.
CUT = re.compile(r"(?<=\S)(?=[ \n])")
#: Two spaces or line ends together, or one at the beginning or end, or any other white space.
ODD = r"^[ \n]|[ \n]$|[ \n][ \n]|[\t\v\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Characters of segments that are encoded at once; groups of fewer ids are keyed at once.
RUN, WIDE = 1 << 15, 8
SPACE = "▁"
ROWS = "kind string, chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, groups binary, times binary, at int, key binary, a int, b int, n long"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


@lru_cache(1)
def pieces(path: str):
    """The SentencePiece model at ``path`` and the bytes of each of its ids."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    if any(re.search(f"[^{SPACE}]{SPACE}|\n", x) for x in names):
        raise ValueError(f"{path}: pieces go over the beginning of a word")
    for probe in ("a", " a  b ", "Åﬁ①½\t\n", "éé"):
        if "".join(_spelt(names[i]).decode("latin-1") for i in model.encode(probe)) != (" " + probe).encode().decode("latin-1"):
            raise ValueError(f"{path}: texts are changed before they are cut")
    return model, [_spelt(x) for x in names]


def _spelt(piece: str) -> bytes:
    found = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
    return bytes([int(found[1], 16)]) if found else piece.replace(SPACE, " ").encode()


@lru_cache(1)
def byte_lengths(path: str) -> list[int]:
    """Bytes of each id of the byte-level BPE at ``path``."""
    found = encoding(path)
    out = [0] * found.n_vocab
    for i in range(found.n_vocab):
        try:
            out[i] = len(found.decode_single_token_bytes(i))
        except KeyError:
            continue
    return out


def _keys(a: np.ndarray, b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> list[bytes]:
    """The groups' keys: how many ids are of A, then all, as 32-bit numbers, without zero bytes at the end (no B id is 0)."""
    n_a, n_b = np.diff(stop_a, prepend=0), np.diff(stop_b, prepend=0)
    short = n_a + n_b < WIDE
    rows = np.zeros((len(n_a), WIDE), "<u4")
    rows[:, 0] = n_a
    for ids, stop, n, shift in ((a, stop_a, n_a, np.zeros_like(n_a)), (b, stop_b, n_b, n_a)):
        row = np.repeat(np.flatnonzero(short), n[short])
        at = _ranges((stop - n)[short], stop[short])
        rows[row, 1 + shift[row] + at - (stop - n)[row]] = ids[at]
    out = rows.view(f"S{4 * WIDE}").ravel().tolist()
    for i in np.flatnonzero(~short).tolist():
        ids = [n_a[i], *a[stop_a[i] - n_a[i] : stop_a[i]], *b[stop_b[i] - n_b[i] : stop_b[i]]]
        out[i] = np.array(ids, "<u4").tobytes().rstrip(b"\0")
    return out


def group_at(key: bytes) -> tuple[list[int], list[int]]:
    """The A and B ids of a group's key."""
    n, *ids = np.frombuffer(key.ljust(-(-len(key) // 4) * 4, b"\0"), "<u4").tolist()
    return ids[:n], ids[n:]


def links_of(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the links of two token sequences over the same bytes end, and which A and B token each is of: two overlap as far as no
    token of either ends in between."""
    ends = np.union1d(end_a, end_b)
    return ends, np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)


class _Dictionary:
    """Segments and groups of a task's texts; both are forgotten together when they are many."""

    def __init__(self, path_a: str, path_b: str):
        self.encode, (self.model, self.spelt) = encoding(path_a).encode_ordinary, pieces(path_b)
        self.size_a, self.size_b = np.array(byte_lengths(path_a)), np.array([len(x) for x in self.spelt])
        self.forget()

    def forget(self) -> None:
        self.segments: dict[str, int] = {}
        self.number: dict[bytes, int] = {}
        self.keys: list[bytes] = []
        self.texts: list[str] = []  # of the groups
        self.pairs, self.pair_ends = array("q"), array("q", [0])  # the groups' distinct links, one after the other
        self.members, self.member_ends = array("q"), array("q", [0])  # the segments' groups, likewise
        self.sizes = array("q")  # of the segments: how many A and B ids; -1 where B does not spell them

    def learn(self, fresh: list[str]) -> None:
        """Encodes segments that are not known yet: many at once, but each of those that may not stand before another."""
        run, size = [], 0
        for segment in fresh:
            if SPACE in segment or segment[-1].isspace():
                self._add([segment])
                continue
            run.append(segment)
            size += len(segment)
            if size > RUN:
                self._add(run)
                run, size = [], 0
        if run:
            self._add(run)

    def _add(self, run: list[str]) -> None:
        whole = [x if x[0] in " \n" else " " + x for x in run]
        text = "".join(whole)
        data, a, b = text.encode(), np.array(self.encode(text)), self.model.encode("\n" + text)[2:]
        spelt = b"".join([self.spelt[i] for i in b])
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        stop = np.cumsum([len(x.encode()) for x in whole])
        cuts, cut_a, cut_b = np.intersect1d(end_a, end_b, assume_unique=True, return_indices=True)
        if spelt != data or not np.isin(stop, cuts).all():
            if len(run) > 1:
                for segment in run:
                    self._add([segment])
                return
            self.segments[run[0]] = len(self.sizes) // 2
            self.sizes.extend((-1, -1))
            self.member_ends.append(len(self.members))
            return
        ends, of_a, of_b = links_of(end_a, end_b)
        links = (a[of_a] << 32 | np.array(b)[of_b]).tolist()
        last = np.searchsorted(ends, cuts, side="right").tolist()
        keys = _keys(a, np.array(b), cut_a + 1, cut_b + 1)
        numbers = list(map(self.number.get, keys))
        for i in [i for i, n in enumerate(numbers) if n is None]:
            n = numbers[i] = self.number.setdefault(keys[i], len(self.keys))
            if n == len(self.keys):
                self.keys.append(keys[i])
                self.texts.append("|".join(",".join(map(str, ids)) for ids in group_at(keys[i])))
                self.pairs.extend(sorted(set(links[last[i - 1] if i else 0 : last[i]])))
                self.pair_ends.append(len(self.pairs))
        first = len(self.members)
        self.members.extend(numbers)
        self.member_ends.extend((first + np.searchsorted(cuts, stop, side="right")).tolist())
        sizes = [np.diff(np.searchsorted(e, stop, side="right"), prepend=0) for e in (end_a, end_b)]
        self.sizes.extend(np.stack(sizes, axis=1).ravel().tolist())
        at = len(self.segments)
        self.segments.update(zip(run, range(at, at + len(run)), strict=True))


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All integers from each ``first`` to before its ``last``."""
    count = last - first
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _segments(texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct segments of all texts, each text's as numbers of these, one after the other, and the bounds of each text's.

    Texts whose words are parted by single spaces and line ends are cut by Arrow; others by CUT. A segment that is a space and then
    a visible character goes without that space."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    odd = pc.match_substring_regex(texts, ODD).to_numpy(zero_copy_only=False) | (pc.binary_length(texts).to_numpy() == 0)
    plain = pc.split_pattern(pc.replace_substring(texts.filter(pa.array(~odd)), "\n", " \n"), " ")
    cut = [[x[1:] if len(x) > 1 and x[0] == " " and x[1] not in " \n" else x for x in CUT.split(" " + t)] if t else [] for t in texts.filter(pa.array(odd)).to_pylist()]
    count = np.zeros(len(texts), np.int64)
    count[~odd] = np.diff(plain.offsets.to_numpy())
    count[odd] = [len(x) for x in cut]
    bounds = np.append(0, np.cumsum(count))
    every = pa.chunked_array([plain.flatten(), pa.array(list(chain.from_iterable(cut)), pa.large_string())]).combine_chunks().dictionary_encode()
    where = np.concatenate([_ranges(bounds[:-1][x], bounds[1:][x]) for x in (~odd, odd)])
    numbers = np.empty(len(where), np.int64)
    numbers[where] = every.indices.to_numpy()
    return every.dictionary.to_pylist(), numbers, bounds


def _aligned(path_a: str, path_b: str, chunk_size: int):
    names = [x.split() for x in ROWS.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}

    def batch(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[k]) if c in columns else pa.nulls(size, kinds[k]) for c, k in names], names=[c for c, _ in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task, made = _Dictionary(path_a, path_b), TaskContext.get().partitionId() << 32, 0
        docs: list[tuple] = []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal made, docs
            chunk, made, rows, docs = task + made, made + 1, docs, []
            n = len(rows)
            members = [r[5] for r in rows]
            used, at = np.unique(np.concatenate([m for m, _ in members]), return_inverse=True)
            bounds = np.cumsum([0, *(len(m) for m, _ in members)])
            own = [at[x:y] for x, y in zip(bounds[:-1], bounds[1:], strict=True)]
            yield batch(n, kind=["doc"] * n, chunk=[chunk] * n, **{c: [r[i] for r in rows] for i, c in enumerate(("doc_id", "n_a", "n_b", "n_groups", "groups_sha256"))}, groups=[pack(x) for x in own], times=[pack(t) for _, t in members])
            keys = [known.keys[i] for i in used.tolist()]
            for x in range(0, len(keys), 1 << 15):
                part = keys[x : x + (1 << 15)]
                yield batch(len(part), kind=["group"] * len(part), chunk=[chunk] * len(part), at=np.arange(x, x + len(part)), key=part)
            # The links of the chunk's groups once each, then the documents' distinct pairs.
            ends = np.array(known.pair_ends)
            pairs = np.frombuffer(known.pairs, np.int64)[_ranges(ends[used], ends[used + 1])]
            flat, where = np.unique(pairs, return_inverse=True)
            start = np.append(0, np.cumsum(ends[used + 1] - ends[used]))
            held = np.zeros(len(flat), np.int64)
            for groups in own:
                held[np.unique(where[_ranges(start[groups], start[groups + 1])])] += 1
            del ends, pairs
            for x in range(0, len(flat), 1 << 16):
                part = flat[x : x + (1 << 16)]
                yield batch(len(part), kind=["pair"] * len(part), a=(part >> 32).astype(np.int32), b=(part & 0xFFFFFFFF).astype(np.int32), n=held[x : x + (1 << 16)])

        waiting = 0
        none = (np.empty(0, np.int64), np.empty(0, np.int64))
        for given in slices(batches):
            distinct, at, bounds = _segments(given.column(1))
            found = list(map(known.segments.get, distinct))
            if None in found:
                known.learn([s for s, i in zip(distinct, found, strict=True) if i is None])
                found = list(map(known.segments.__getitem__, distinct))
            ends, members, sizes = np.array(known.member_ends), np.array(known.members), np.array(known.sizes).reshape(-1, 2)
            at = np.array(found, np.int64)[at]
            for doc_id, own in zip(given.column(0).to_pylist(), np.split(at, bounds[1:-1]), strict=True):
                if not len(own) or sizes[own].min() < 0:
                    docs.append((doc_id, 0, 0, 0, "", none))
                    continue
                flat = members[_ranges(ends[own], ends[own + 1])]
                n_a, n_b = sizes[own].sum(0).tolist()
                digest = hashlib.sha256(";".join(list(map(known.texts.__getitem__, flat.tolist()))).encode()).hexdigest()
                docs.append((doc_id, n_a, n_b, len(flat), digest, np.unique(flat, return_counts=True)))
            waiting += given.nbytes
            if waiting >= chunk_size or len(known.segments) >= SEGMENTS:
                yield from flush()
                waiting = 0
                if len(known.segments) >= SEGMENTS:
                    known.forget()
        if docs:
            yield from flush()

    return run


def _links(path_a: str, path_b: str):
    """A row for each link of a group, as often as it occurs there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a, size_b = np.array(byte_lengths(path_a)), np.array([len(x) for x in pieces(path_b)[1]])
        for batch in slices(batches, 1 << 18):
            groups = [group_at(key) for key in batch.column(0).to_pylist()]  # as one text
            a, b = (np.fromiter(chain.from_iterable(g[side] for g in groups), np.int64) for side in (0, 1))
            end_a = np.cumsum(size_a[a])
            ends, of_a, of_b = links_of(end_a, np.cumsum(size_b[b]))
            stop = end_a[np.cumsum([len(g[0]) for g in groups]) - 1]
            owner = pa.array(np.searchsorted(stop, ends))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array(a[of_a].astype(np.int32)), pa.array(b[of_b].astype(np.int32))], names=["key", "a", "b"])

    return run


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """A chunk's documents with its groups' sums."""
    at = np.argsort(right["at"].to_numpy())
    best, total = (right[c].to_numpy()[at] for c in ("best", "total"))
    sums: tuple[list[int], list[int]] = ([], [])
    for groups, times in zip(left["groups"].to_pylist(), left["times"].to_pylist(), strict=True):
        own, often = unpack(groups).astype(np.int64), unpack(times).astype(np.int64)
        for to, values in zip(sums, (best, total), strict=True):
            to.append(int(values[own] @ often))
    n_a, n_b, n_groups = (left[c].to_numpy() for c in ("n_a", "n_b", "n_groups"))
    return pa.table([left["doc_id"], left["n_a"], left["n_b"], left["n_groups"], pa.array(n_a + n_b - n_groups), pa.array(sums[0], pa.int64()), pa.array(sums[1], pa.int64()), left["groups_sha256"]], names=[x.split()[0] for x in RESULT.split(", ")])


def align(docs: DataFrame, path_a: str, path_b: str, chunk: int = CHUNK) -> DataFrame:
    """RESULT for every row of ``docs`` (doc_id, text); within a group, tokens are linked one more often than there are boundaries,
    so a document has n_a + n_b - n_groups links."""
    rows = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_aligned(path_a, path_b, chunk), ROWS), "aligned")
    pairs = rows.where("kind = 'pair'").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = saved(pairs, "pairs")
    highest = pairs.groupBy("a").agg(F.max("n").alias("most"))
    pairs = joined_small(pairs, highest, "a", "inner").select("a", "b", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    asked = rows.where("kind = 'group'").select("chunk", "at", "key")
    links = asked.select("key").distinct().mapInArrow(_links(path_a, path_b), "key binary, a int, b int")
    sums = links.join(pairs, ["a", "b"]).groupBy("key").agg(F.sum("best").alias("best"), F.sum("n").alias("total"))
    answers = asked.join(saved(sums, "sums"), "key").select(F.col("chunk").alias("asking"), "at", "best", "total")
    texts = rows.where("kind = 'doc'").select("chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "groups", "times")
    return texts.groupBy("chunk").cogroup(answers.groupBy("asking")).applyInArrow(_summed, RESULT)
