"""Token counts that follow edits: a stored segment tree of pre-token runs per document.

A text is cut into leaves at places that are pre-token boundaries whatever surrounds them: after a letter or digit, before
white space, between letters and digits, and, in the scripts of BEFORE_MARK, before punctuation; so texts without spaces
have leaves as well. Leaves encode on their own, and a document's count is the sum over its leaves.

``build_trees`` encodes every text once and keeps its leaves' lengths and token counts in a column; the sums above them
follow from these without encoding. ``apply_edits`` reads that column: an edit finds its leaves by descending the sums,
re-encodes those it touches, with those beside them whose boundary lies within a character of it, and updates the sums on
their paths to the root. What the leaves gain or lose stays in them (a leaf may grow to GROWTH times its size, or become
empty); only a leaf that outgrows that splits, which rebuilds the sums. A run of letters without any boundary is one
pre-token, whose merges may change anywhere, and so one leaf.

Null texts count as empty: no tokens. Edits beyond the text's ends are clipped to it; null edits are none, null inserts
are empty. Edits apply one after another, each to what the last one left. Repeated rows each give their own row; columns
named as the results (and ``token_tree``) are replaced, others kept. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import slices
from placeweave.llm.packing import encoding

LEAF, GROWTH = 512, 4
#: Letters and digits (ASCII, Cyrillic, kana, Han, Hangul; Thai consonants) and what is no letter after them.
BEFORE_MARK = (
    (r"A-Za-z0-9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", r"!-&(-/:-@\[-`{-~\u3001\u3002\u300c\u300d\uff01\uff0c\uff1a\uff1b\uff1f"),
    (r"\u0e01-\u0e2e", r"\u0e31\u0e34-\u0e3a\u0e47-\u0e4e"),
)
SAFE = regex.compile("|".join([r"(?<=[\p{L}\p{N}])(?=[ \t\r\n])", r"(?<=[0-9])(?=\p{L})", r"(?<=\p{L})(?=[0-9])", *(f"(?<=[{a}])(?=[{b}])" for a, b in BEFORE_MARK)]))


def leaves_of(text: str) -> list[str]:
    """The text cut at the first safe place after every LEAF characters."""
    out, at = [], 0
    while len(text) - at > LEAF and (found := SAFE.search(text, at + LEAF)) and found.start() < len(text):
        out.append(text[at : found.start()])
        at = found.start()
    out.append(text[at:])
    return out


class TokenTree:
    """Leaves and, per level of a binary tree over them, sums of characters and tokens."""

    def __init__(self, text: str, count: Callable[[str], int], stored: tuple[list[int], list[int]] | None = None):
        """The tree of a text; from the ``stored`` lengths and token counts of its leaves, if they are given, without encoding."""
        self.count, self.encoded = count, 0
        if stored:
            ends = np.cumsum(stored[0]).tolist()
            self.leaves = [text[e - n : e] for e, n in zip(ends, stored[0], strict=True)]
            self._build(stored[1])
        else:
            self.leaves = leaves_of(text)
            self._build([self._encode(x) for x in self.leaves])

    def _encode(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return self.count(leaf)

    def stored(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths and token counts of the leaves."""
        size = len(self.sums) // 2
        own = self.sums[size : size + len(self.leaves)]
        return own[:, 0], own[:, 1]

    def _build(self, tokens: list[int]) -> None:
        size = 1 << max(0, len(self.leaves) - 1).bit_length()
        self.sums = np.zeros((2 * size, 2), np.int64)
        self.sums[size : size + len(self.leaves), 0] = [len(x) for x in self.leaves]
        self.sums[size : size + len(self.leaves), 1] = tokens
        level = size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level].reshape(-1, 2, 2).sum(1)
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character and the leaf's first character; the last leaf for places at the end."""
        size, node, first = len(self.sums) // 2, 1, 0
        while node < size:
            node *= 2
            if place >= first + self.sums[node, 0]:
                first += int(self.sums[node, 0])
                node += 1
        i = node - size
        if i >= len(self.leaves):
            i = len(self.leaves) - 1
            first = int(self.sums[1, 0]) - len(self.leaves[i])
        return i, first

    def edit(self, start: int, stop: int, insert: str) -> None:
        """Replaces the characters from ``start`` to ``stop`` by ``insert``."""
        n = int(self.sums[1, 0])
        start = min(max(start, 0), n)
        stop = min(max(stop, start), n)
        i, first = self._leaf_at(max(start - 2, 0))
        j, _ = self._leaf_at(min(stop + 1, max(n - 1, 0)))
        region = "".join(self.leaves[i : j + 1])
        fresh = leaves_of(region[: start - first] + insert + region[stop - first :])
        counts = [self._encode(x) for x in fresh]
        size, room = len(self.sums) // 2, j + 1 - i
        while len(fresh) > room and len(fresh[-1]) + len(fresh[-2]) <= GROWTH * LEAF:  # safe places: counts add up
            fresh[-2:], counts[-2:] = ["".join(fresh[-2:])], [sum(counts[-2:])]
        if len(fresh) <= room:
            fresh += [""] * (room - len(fresh))
            counts += [0] * (room - len(counts))
            self.leaves[i : j + 1] = fresh
            for k, (leaf, tokens) in enumerate(zip(fresh, counts, strict=True), size + i):
                change = np.array([len(leaf), tokens]) - self.sums[k]
                while k:
                    self.sums[k] += change
                    k //= 2
        else:
            counts = [*self.sums[size : size + i, 1], *counts, *self.sums[size + j + 1 : size + len(self.leaves), 1]]
            self.leaves[i : j + 1] = fresh
            self._build(counts)


TREE, TREE_DDL = "token_tree", "struct<chars:array<int>,tokens:array<int>>"
TREE_TYPE = pa.struct([("chars", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int32()))])
RESULT = "n_tokens long, n_edits int, n_tokens_edited long, edited_crc32 long, recoded_chars long"


def _fields(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def _tree_column(trees: list[TokenTree]) -> pa.Array:
    kept = [t.stored() for t in trees]
    return pa.array([{"chars": chars, "tokens": tokens} for chars, tokens in kept], TREE_TYPE)


def build_trees(df: DataFrame, tokenizer_path: str, text: str = "text") -> DataFrame:
    """Adds ``token_tree``: the lengths and token counts of each text's leaves. The one step that encodes whole texts."""
    df = df.drop(TREE)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer_path).encode_ordinary
        for batch in slices(batches):
            trees = [TokenTree(value or "", lambda s: len(encode(s))) for value in batch.column(names.index(text)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _tree_column(trees)], names=[*names, TREE])

    return df.mapInArrow(run, f"{_fields(df)}, {TREE} {TREE_DDL}")


def apply_edits(trees: DataFrame, tokenizer_path: str, text: str = "text", edits: str = "edits", keep: bool = True) -> DataFrame:
    """Applies ``edits`` (array of start, stop, insert; code points) to texts with their ``token_tree``; these become those of
    the edited text, so that a second call goes on from there (unless ``keep`` is false: then both stay as they were).
    Adds the token counts before and after, the edited text's CRC-32 and how many characters were encoded.
    """
    added = [x.split() for x in RESULT.split(", ")]
    df = trees.drop(*(c for c, _ in added if c not in (text, edits)))
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(tokenizer_path).encode_ordinary
        for batch in slices(batches):
            rows, done = [], []
            for value, changes, tree in zip(*(batch.column(names.index(c)).to_pylist() for c in (text, edits, TREE)), strict=True):
                own = TokenTree(value or "", lambda s: len(encode(s)), (tree["chars"], tree["tokens"]))
                before, changes = own.tokens, [c for c in changes or () if c is not None]
                for c in changes:
                    start = c["start"] or 0
                    own.edit(start, start if c["stop"] is None else c["stop"], c["insert"] or "")
                whole = own.text
                rows.append((before, len(changes), own.tokens, zlib.crc32(whole.encode("utf-8", "surrogatepass")), own.encoded))
                done.append((whole if changes else value, own))
            kinds = [pa.int32() if t == "int" else pa.int64() for _, t in added]
            new = {} if not keep else {text: pa.array([x for x, _ in done], batch.column(names.index(text)).type), TREE: _tree_column([t for _, t in done])}
            yield pa.RecordBatch.from_arrays([*(new.get(c, batch.column(c)) for c in names), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=[*names, *(c for c, _ in added)])

    return df.mapInArrow(run, f"{_fields(df)}, {RESULT}")


def count_tokens(df: DataFrame, tokenizer_path: str, text: str = "text", edits: str = "edits") -> DataFrame:
    """``build_trees`` and ``apply_edits`` in one pass, for texts that are counted once: no tree is kept, the text stays."""
    return apply_edits(build_trees(df, tokenizer_path, text), tokenizer_path, text, edits, keep=False).drop(TREE)


#: The query's edits: what each puts in, and how many characters it takes out.
EDITS = (("", 40), (" an inserted clause, with 3 numbers: 10, 20, 30 ", 0), ("\n\nreplaced", 25))


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits at places that a hash of the id picks from the whole text."""
    n = F.coalesce(F.length(text), F.lit(0)) + 1
    places = [F.pmod(F.xxhash64(doc_id, F.lit(i)), n).cast("int") for i in range(len(EDITS))]
    return F.array(*(F.struct(p.alias("start"), (p + gone).alias("stop"), F.lit(put).alias("insert")) for p, (put, gone) in zip(places, EDITS, strict=True)))
