"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark and kept as sorted hash arrays.

A task turns its documents into chunks: the words' hashes, and the texts as numbers of these words. What a chunk has to
know about the corpus it asks for in blocks of distinct keys, cut by key ranges (shards), and gets back in arrays of the
same order, so that a shuffle carries a few bytes for each distinct key of a chunk and no row for a word. The number of
shards follows the counts, so a shard stays small whatever the corpus is; hot words and pairs collapse within their chunk.

1. Words: the shards add up the training counts of the words and number them.
2. Pairs: a pair of word numbers, mixed by a bijection, is its own hash, so pairs never collide and a shard reads both words
   from it. A shard's sorted array of pairs and its counts are the model (``model``: a table to keep it in). They are laid
   into a scratch file without a name, which the worker maps; every chunk's pairs are looked up in it. The arrays go to disk
   and come back page by page, so a worker's memory does not follow its shard.
3. From each training pair its first word learns how many words follow it once, twice, or more often, its last word how many
   words it follows; the word shards add these up for the chunks.

Probabilities: p(w|v) = (c(vw) - D(c(vw))) / c(v) + g(v) p(w), with p(w) from the number of words that w follows, discounted
likewise, and what these discounts free spread evenly over the V words of training and one that stands for all others. The
three discounts of each level come from its counts of counts; where these are too few to give any, they are a half, one and
one and a half. A word's context is the word before it, or the text's start. Each text's end is a token.

Words are compared by 64-bit hashes. Null and empty texts are their end alone. Null ids are learnt from and scored; repeated
rows are documents like others. An empty table gives an empty result; without any training documents every token has the
probability one. One task holds CHUNK tokens, or one document where that is longer.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import saved, slices
from placeweave.llm.packed import pack, pack_sorted, unpack, unpack_sorted
from placeweave.llm.shingles import word_hashes

#: Tokens of a chunk; keys of all chunks' blocks that one shard takes.
CHUNK, SHARD = 1 << 21, 1 << 20
#: Hashes of the text's start and end; words never have them.
START, END = np.uint64(0), np.uint64(1)
CHUNKS = "chunk long, doc_id array<long>, train array<boolean>, length array<int>, words binary, counts binary, order binary, tokens binary, n_words long, n_tokens long"
BLOCKS = "shard long, chunk long, n long, a binary, b binary"
ANSWERS = "kind string, shard long, chunk long, a binary, b binary, c binary, d binary, numbers array<long>"


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<boolean>": pa.list_(pa.bool_())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _answer(kind: str, shard: int, chunk: int | None = None, arrays: tuple = (), numbers: list[int] | None = None) -> tuple:
    return (kind, shard, chunk, *arrays, *[None] * (4 - len(arrays)), numbers)


def _chunked(size: int):
    """Documents (doc_id, text, train) as CHUNKS: distinct words in the order of their hashes with their training counts, ``order``
    of each by falling number of tokens, and the tokens as places in that order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[np.ndarray, np.ndarray, list, list]] = []

        def flush() -> pa.RecordBatch:
            nonlocal made
            parts, ids, train, lengths = [], [], [], []
            for hashes, bounds, doc_ids, trains in held:
                fixed = np.where(hashes <= END, hashes + np.uint64(2), hashes)
                parts.append(np.insert(fixed, bounds[1:], END))
                ids += doc_ids
                train += trains
                lengths.append(np.diff(bounds) + 1)
            held.clear()
            tokens, length = np.concatenate(parts), np.concatenate(lengths)
            words, at = np.unique(np.append(tokens, START), return_inverse=True)
            at = at[:-1]
            often = np.argsort(-np.bincount(at, minlength=len(words)), kind="stable")
            order = np.empty(len(words), np.int64)
            order[often] = np.arange(len(words))
            learnt = np.array(train, bool)
            counts = np.bincount(at[np.repeat(learnt, length)], minlength=len(words))
            counts[0] = learnt.sum()
            row = ((task << 32) + made, ids, train, length.tolist(), pack_sorted(words), pack(counts), pack(order), pack(order[at]), len(words), len(tokens))
            made += 1
            return _batch(CHUNKS, [row])

        waiting = 0
        for batch in slices(batches):
            hashes, bounds = word_hashes(batch.column(1), True)
            held.append((hashes, bounds, batch.column(0).to_pylist(), batch.column(2).to_pylist()))
            waiting += len(hashes) + batch.num_rows
            if waiting >= size:
                yield flush()
                waiting = 0
        if waiting:
            yield flush()

    return run


def _shards(keys: float, each: int) -> int:
    """The exponent of the number of shards."""
    return max(0, int(keys - 1) // each).bit_length()


def _cuts(keys: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """The bounds, in the sorted ``keys`` of so many bits, of the ranges that the 2 ** ``shards`` shards take."""
    edges = np.arange(1, 1 << shards, dtype=np.uint64) << np.uint64(bits - shards)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def _word_blocks(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, words, counts in zip(*(batch.column(i) for i in range(3)), strict=True):
                words, counts = unpack_sorted(words.as_py()), unpack(counts.as_py())
                at = _cuts(words, 64, shards)
                rows = [(s, chunk.as_py(), b - a, pack_sorted(words[a:b]), pack(counts[a:b])) for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if a < b]
                yield _batch(BLOCKS, rows)

    return run


def _number_words(shards: int):
    """Training counts and numbers of a shard's words, for each chunk that has them."""

    def run(table: pa.Table) -> pa.Table:
        shard, rows = table["shard"][0].as_py(), []
        blocks = [(chunk, unpack_sorted(a), unpack(b)) for chunk, a, b in zip(*(table[c].to_pylist() for c in ("chunk", "a", "b")), strict=True)]
        words, at = np.unique(np.concatenate([w for _, w, _ in blocks]), return_inverse=True)
        counts = np.zeros(len(words), np.uint64)
        np.add.at(counts, at, np.concatenate([c for _, _, c in blocks]))
        first = 0
        for chunk, own, _ in blocks:
            places = at[first : first + len(own)]
            first += len(own)
            rows.append(_answer("word", shard, chunk, (pack_sorted((places.astype(np.uint64) << np.uint64(shards)) + np.uint64(shard)), pack(counts[places]))))
        known = counts[words != START]
        rows.append(_answer("total", shard, numbers=[int(known.sum()), int((known > 0).sum()), len(words)]))
        return pa.Table.from_batches([_batch(ANSWERS, rows)])

    return run


def mixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """A bijection of the integers below 2 ** ``bits`` (an even number), which spreads them evenly."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    for odd in (0x9E3779B97F4A7C15, 0xC4CEB9FE1A85EC53):
        keys = (keys * np.uint64(odd)) & mask
        keys = keys ^ (keys >> half)
    return keys


def unmixed(keys: np.ndarray, bits: int) -> np.ndarray:
    """What ``mixed`` made them from."""
    mask, half = np.uint64((1 << bits) - 1), np.uint64(bits // 2)
    for odd in (0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15):
        keys = keys ^ (keys >> half)
        keys = (keys * np.uint64(pow(odd, -1, 1 << 64))) & mask
    return keys


class _Chunk:
    """A chunk with the numbers and training counts of its words: its tokens as pairs."""

    def __init__(self, row: dict, answers: list[dict], width: int):
        words = sorted((x for x in answers if x["kind"] == "word"), key=lambda x: x["shard"])
        self.numbers = np.concatenate([unpack_sorted(x["a"]) for x in words])  # in the order of the words' hashes
        self.counts = np.concatenate([unpack(x["b"]) for x in words]).astype(np.int64)
        self.length, self.train = np.array(row["length"], np.int64), np.array(row["train"], bool)
        places = np.argsort(unpack(row["order"]).astype(np.int64))
        self.token = places[unpack(row["tokens"]).astype(np.int64)]
        self.before = np.append(0, self.token[:-1])
        ends = np.cumsum(self.length)
        self.before[ends[:-1]] = 0  # the start has the smallest hash
        both = (self.numbers[self.before] << np.uint64(width)) | self.numbers[self.token]
        self.pairs, self.pair = np.unique(mixed(both, 2 * width), return_inverse=True)
        self.document = np.repeat(np.arange(len(self.length)), self.length)


def _pair_blocks(width: int, shards: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, rows = right.to_pylist(), []
        for row in left.to_pylist():
            chunk = _Chunk(row, answers, width)
            counts = np.bincount(chunk.pair[chunk.train[chunk.document]], minlength=len(chunk.pairs))
            at = _cuts(chunk.pairs, 2 * width, shards)
            rows += [(s, row["chunk"], b - a, pack_sorted(chunk.pairs[a:b]), pack(counts[a:b])) for s, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)) if a < b]
        return pa.Table.from_batches([_batch(BLOCKS, rows)])

    return run


class _Mapped:
    """Sorted keys and their values in a nameless file, mapped into memory."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.n = len(keys)
        self.file = tempfile.TemporaryFile()  # noqa: SIM115
        self.file.write(np.ascontiguousarray(keys, "<u8").data)
        self.file.write(np.ascontiguousarray(values, "<u8").data)
        self.file.flush()
        self.map = mmap.mmap(self.file.fileno(), 0, access=mmap.ACCESS_READ) if self.n else b""
        self.keys, self.values = np.frombuffer(self.map, "<u8", self.n), np.frombuffer(self.map, "<u8", self.n, 8 * self.n)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of ``keys``; 0 for those that are not there."""
        if not self.n:
            return np.zeros(len(keys), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), self.n - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.uint64(0))

    def close(self) -> None:
        del self.keys, self.values
        if self.n:
            self.map.close()
        self.file.close()


def _class_sums(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words and, for each, how many of its rows count 1, 2, and more."""
    own, at = np.unique(words, return_inverse=True)
    return own, np.bincount(at * 3 + np.minimum(counts.astype(np.int64), 3) - 1, minlength=3 * len(own)).reshape(-1, 3)


def _counted_pairs(width: int, word_shards: int):
    """A shard's training counts for all chunks' pairs, its part of the model, and what its pairs tell about their words."""

    def run(table: pa.Table) -> pa.Table:
        shard, rows = table["shard"][0].as_py(), []
        blocks = list(zip(*(table[c].to_pylist() for c in ("chunk", "a", "b")), strict=True))
        keys, counts = np.concatenate([unpack_sorted(a) for _, a, _ in blocks]), np.concatenate([unpack(b) for *_, b in blocks])
        keys, counts = keys[counts > 0], counts[counts > 0]
        keys, at = np.unique(keys, return_inverse=True)
        total = np.zeros(len(keys), np.uint64)
        np.add.at(total, at, counts)
        del at, counts
        rows.append(_answer("model", shard, arrays=(pack_sorted(keys), pack(total))))
        arrays = _Mapped(keys, total)
        for chunk, a, _ in blocks:
            rows.append(_answer("pair", shard, chunk, (pack(arrays.find(unpack_sorted(a))),)))
        arrays.close()
        rows.append(_answer("total", shard, numbers=[int((total == k).sum()) for k in (1, 2, 3, 4)] + [len(keys)]))
        both = unmixed(keys, 2 * width)
        first, follows = _class_sums(both >> np.uint64(width), total)
        last, led = np.unique(both & np.uint64((1 << width) - 1), return_counts=True)
        mask = np.uint64((1 << word_shards) - 1)
        for s in range(1 << word_shards):
            f, l = (first & mask) == s, (last & mask) == s
            if f.any() or l.any():
                rows.append(_answer("part", s, arrays=(pack_sorted(first[f]), pack(follows[f].ravel()), pack_sorted(last[l]), pack(led[l]))))
        return pa.Table.from_batches([_batch(ANSWERS, rows)])

    return run


def _word_sums(table: pa.Table) -> pa.Table:
    """Adds up the parts of a shard's words: numbers of words that follow once, twice, more often, and of words before, for every chunk."""
    shard, rows = table["shard"][0].as_py(), []
    given = table.select(["kind", "chunk", "a", "b", "c", "d"]).to_pylist()
    parts = [x for x in given if x["kind"] == "part"]
    asked = [(x["chunk"], unpack_sorted(x["a"])) for x in given if x["kind"] == "word"]
    words = np.unique(np.concatenate([w for _, w in asked]))
    sums = np.zeros((len(words), 4), np.int64)
    for x in parts:
        first, last = np.searchsorted(words, unpack_sorted(x["a"])), np.searchsorted(words, unpack_sorted(x["c"]))
        sums[first, :3] += unpack(x["b"]).astype(np.int64).reshape(-1, 3)
        sums[last, 3] += unpack(x["d"]).astype(np.int64)
    for chunk, own in asked:
        rows.append(_answer("sums", shard, chunk, (pack(sums[np.searchsorted(words, own)].ravel()),)))
    rows.append(_answer("total", shard, numbers=[int((sums[:, 3] == k).sum()) for k in (1, 2, 3, 4)] + [int((sums[:, 3] > 2).sum())]))
    return pa.Table.from_batches([_batch(ANSWERS, rows)])


def discounts(n: list[int]) -> np.ndarray:
    """For counts of 0, 1, 2 and more: what is taken off them, from the numbers of keys that count 1 to 4."""
    fixed = np.array([0, 0.5, 1, 1.5])
    if min(n) <= 0:
        return fixed
    y = n[0] / (n[0] + 2 * n[1])
    found = np.array([0, *(k - (k + 1) * y * n[k] / n[k - 1] for k in (1, 2, 3))])
    return found if (found[1:] > 0).all() else fixed


def _scored(width: int, n: int, v: int, pair_level: np.ndarray, word_level: np.ndarray, free: float, types: int):
    """Each document's scores; ``free``: what the discounts of single words sum up to, ``types``: distinct training pairs."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        answers, out = right.to_pylist(), []
        for row in left.to_pylist():
            chunk = _Chunk(row, answers, width)
            seen = np.concatenate([unpack(x["a"]) for x in sorted((x for x in answers if x["kind"] == "pair"), key=lambda x: x["shard"])]).astype(np.int64)
            sums = np.concatenate([unpack(x["a"]) for x in sorted((x for x in answers if x["kind"] == "sums"), key=lambda x: x["shard"])]).astype(np.int64).reshape(-1, 4)
            alone = (sums[:, 3] - word_level[np.minimum(sums[:, 3], 3)]) / max(types, 1) + (free / types if types else 1) / (v + 1)
            spare = (sums[:, :3] @ pair_level[1:]) / np.maximum(chunk.counts, 1)
            some = np.full(len(chunk.pairs), -1)
            some[chunk.pair] = np.arange(len(chunk.pair))  # any token of each pair tells its words
            before, token = chunk.before[some], chunk.token[some]
            total = chunk.counts[before]
            p = np.where(total > 0, (seen - pair_level[np.minimum(seen, 3)]) / np.maximum(total, 1) + spare[before] * alone[token], alone[token])
            base = np.log10((chunk.counts + 0.5) / (n + 0.5 * (v + 1)))
            docs = len(chunk.length)
            sums_of = [np.bincount(chunk.document, weights=x, minlength=docs) for x in (base[chunk.token], np.log10(p)[chunk.pair], chunk.counts[chunk.token] > 0)]
            out.append(
                pa.table(
                    {
                        "doc_id": pa.array(row["doc_id"], pa.int64()),
                        "train": pa.array(row["train"], pa.bool_()),
                        "n_tokens": pa.array(chunk.length),
                        "n_known": pa.array(sums_of[2].astype(np.int64)),
                        "train_tokens": pa.array(np.full(docs, n, np.int64)),
                        "base_score": pa.array(sums_of[0]),
                        "score": pa.array(sums_of[1]),
                    }
                )
            )
        return pa.concat_tables(out)

    return run


SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, train: Column, model: str | None = None, chunk: int = CHUNK, shard: int = SHARD) -> DataFrame:
    """SCORES of every row of ``docs`` (doc_id, text), by what those rows teach where ``train`` holds (null: it does).

    ``score`` is the log10 probability of the text and its end, ``base_score`` that of single words with a half added to each
    count. With ``model``, the sorted arrays stay there as a table (shard, keys, counts)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train, F.lit(True)).alias("train"))
    chunks = saved(rows.mapInArrow(_chunked(chunk), CHUNKS), "chunks")
    size = chunks.agg(F.sum("n_words").alias("words"), F.sum("n_tokens").alias("tokens"), F.max("n_words").alias("most")).first()
    if size["words"] is None:
        return docs.sparkSession.createDataFrame([], SCORES)
    shards, pair_shards = _shards(size["words"], shard), _shards(size["tokens"], shard)
    blocks = chunks.select("chunk", "words", "counts").mapInArrow(_word_blocks(shards), BLOCKS)
    words = saved(blocks.groupBy("shard").applyInArrow(_number_words(shards), ANSWERS), "words")
    n, v, most = words.where("kind = 'total'").agg(*(F.expr(f"{f}(numbers[{i}])") for i, f in enumerate(("sum", "sum", "max")))).first()
    width = max(1, int(most - 1).bit_length() + shards)
    if 2 * width > 64:
        raise ValueError("more than 2^32 word numbers")
    pair_shards = min(pair_shards, 2 * width)
    named = words.where("kind = 'word'")
    texts = chunks.select("chunk", "doc_id", "train", "length", "order", "tokens")
    blocks = texts.groupBy("chunk").cogroup(named.groupBy("chunk")).applyInArrow(_pair_blocks(width, pair_shards), BLOCKS)
    pairs = saved(blocks.groupBy("shard").applyInArrow(_counted_pairs(width, shards), ANSWERS), "pairs")
    if model:
        pairs.where("kind = 'model'").select("shard", F.col("a").alias("keys"), F.col("b").alias("counts")).write.mode("overwrite").parquet(model)
    sums = saved(named.union(pairs.where("kind = 'part'")).groupBy("shard").applyInArrow(_word_sums, ANSWERS), "sums")

    def totals(of: DataFrame) -> list[int]:
        return list(of.where("kind = 'total'").agg(*(F.coalesce(F.expr(f"sum(numbers[{i}])"), F.lit(0)) for i in range(5))).first())

    *of_pairs, types = totals(pairs)
    *of_words, more = totals(sums)
    pair_level, word_level = discounts(of_pairs), discounts(of_words)
    free = float(word_level[1:] @ np.array([*of_words[:2], more]))
    answers = named.union(pairs.where("kind = 'pair'")).union(sums.where("kind = 'sums'"))
    return texts.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_scored(width, n, v, pair_level, word_level, free, types), SCORES)
