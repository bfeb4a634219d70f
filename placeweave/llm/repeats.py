"""Substring dedup: which words stand in a window of WINDOW words that also starts earlier in the corpus.

A compressed FM-index per shard does the matching, and sharding by content keeps every document from meeting every shard:

1. Each window's minimizer is the smallest hash of its five-word runs. Consecutive windows of one minimizer form a span;
   equal windows have equal minimizers, and every window lies in exactly one span. Only minimizers that occur twice go on.
2. Spans of equal content (minimizer and a second 64-bit hash) differ in nothing but where they stand, so they travel as
   one, with the place of the first.
3. All contents of a minimizer that occurs twice are gathered, with their words, in shards by minimizer. Each shard is
   indexed, its contents stream through the index by backward search, and the matching statistics decide: a window whose
   match is WINDOW words long has an interval of occurrences; the earliest of these says whether the content's first
   occurrence repeats something there. Its later occurrences repeat every window that has an interval, as the first one
   is in it. What has no interval is not removed.
4. A minimizer with more than HOT contents would fill a shard, and streaming them through several would grow with the
   square of their number: its contents are cut into single windows, which meet in an aggregation by their words instead.
   This is exact as well, whatever its size.

Shuffled are span records (five numbers), words only for the contents of step 3, once each.

Windows are compared as of the input. Null texts have no words. Null ids come before all others. Rows that share an id
have windows that start at the same places of the same document, so neither comes earlier for that; each such row is
still judged and returned by itself. An empty table gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeweave.llm.common import saved, slices
from placeweave.llm.fm_index import FMIndex, matching_statistics
from placeweave.llm.shingles import PRIME, mixed_bits, rolled, word_hashes

WINDOW, RUN = 20, 5
#: Contents of a shard, and of one minimizer beyond which it is cut into windows.
SHARD, HOT = 4000, 20_000
FIRST_ID = -(1 << 63)


def _minimizers(runs: np.ndarray) -> np.ndarray:
    """The place of the smallest of each WINDOW - RUN + 1 consecutive run hashes, the first of equals."""
    width, step, value, place = WINDOW - RUN + 1, 1, runs, np.arange(len(runs))
    while width > 1:
        step = min(step, width - 1)
        later = value[step:] < value[:-step]
        value, place = np.where(later, value[step:], value[:-step]), np.where(later, place[step:], place[:-step])
        width, step = width - step, step * 2
    return place


def spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the row, first word, number of windows, minimizer and content hash of each span."""
    hashes, bounds = word_hashes(texts, False)
    runs = rolled(hashes, RUN)
    count = len(hashes) - WINDOW + 1
    if count <= 0:
        return tuple(np.empty(0, t) for t in (np.int64, np.int32, np.int32, np.int64, np.int64))
    place = _minimizers(runs)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:count]
    at = np.flatnonzero(np.arange(count) + WINDOW <= bounds[1:][row])  # windows within one text
    place, row = place[at], row[at]
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1])) if len(at) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(at)))
    start, end = at[first], at[first] + n + WINDOW - 1
    power = np.full(len(hashes) + 1, PRIME)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(len(hashes) + 1, np.uint64(pow(int(PRIME), -1, 1 << 64)))
    back[0] = 1
    back = np.multiply.accumulate(back)
    sums = np.append(np.uint64(0), np.add.accumulate(hashes * power[:-1]))
    content = mixed_bits((sums[end] - sums[start]) * back[start] + n.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    return row[first], (start - bounds[:-1][row[first]]).astype(np.int32), n.astype(np.int32), runs[place[first]].view(np.int64), content.view(np.int64)


SPAN = "doc long, th long, start int, n int, h long, ch long"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        row, *rest = spans(batch.column(2))
        at = pa.array(row)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, rest)], names=["doc", "th", "start", "n", "h", "ch"])


def _words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").split()


def repeated_windows(shard: pd.DataFrame) -> pd.DataFrame:
    """(h, ch, mask, found) of a shard's contents (h, ch, doc, start, n, content) by the index's intervals.

    Bit k of ``found`` says that window k was found in the index, bit k of ``mask`` that it starts earlier elsewhere.
    """
    shard = shard.sort_values(["doc", "start"], ignore_index=True)
    docs = [c.split(" ") for c in shard["content"]]
    lengths = np.array([len(d) for d in docs])
    codes = pd.factorize(np.array([w for d in docs for w in d], dtype=object))[0] + 1
    bounds = np.append(0, np.cumsum(lengths))
    own = np.arange(len(docs))
    text = np.zeros(bounds[-1] + len(docs), np.int64)
    text[np.arange(bounds[-1]) + np.repeat(own, lengths)] = codes
    index = FMIndex(text, WINDOW)
    masks, hits = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
    row_of = np.repeat(own, lengths + 1)
    begin = bounds[:-1] + own
    stats = matching_statistics(index, [codes[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
    low = np.concatenate([s[0][s[2] == WINDOW] for s in stats])
    high = np.concatenate([s[1][s[2] == WINDOW] for s in stats])
    row = np.concatenate([np.full(int((s[2] == WINDOW).sum()), i) for i, s in enumerate(stats)])
    k = np.concatenate([np.flatnonzero(s[2] == WINDOW) for s in stats])
    lows, which = np.unique(low, return_inverse=True)
    highs = np.empty(len(lows), np.int64)
    highs[which] = high
    edges = np.stack([lows, highs], 1).reshape(-1)
    padded = np.append(index.suffixes, len(text))
    earliest = np.minimum.reduceat(padded, edges)[::2][which]
    there = row_of[earliest]
    doc, start = shard["doc"].to_numpy(), shard["start"].to_numpy().astype(np.int64)
    place = start[there] + earliest - begin[there]
    repeat = (doc[there] < doc[row]) | (doc[there] == doc[row]) & (place < start[row] + k)
    np.bitwise_or.at(masks, row[repeat], 1 << k[repeat])
    np.bitwise_or.at(hits, row, 1 << k)
    return shard[["h", "ch"]].assign(mask=masks.astype(np.int32), found=hits.astype(np.int32))


def _bounded(df: DataFrame, blob: str, limit: int = 32 << 20) -> DataFrame:
    """``df`` marked for broadcast if its measured size is small."""
    size = df.agg(F.sum(F.length(blob) + 32)).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def _packed(df: DataFrame, fields: list[str], name: str) -> DataFrame:
    """Per (doc, th), the fields (ints and longs) of all rows as one array of structs."""
    return df.groupBy("doc", "th").agg(F.collect_list(F.struct(*fields)).alias(name))


def dedup_substrings(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 and, if wanted, kept) for every row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    doc = F.coalesce("doc_id", F.lit(FIRST_ID))
    shared_ids = docs.groupBy(doc.alias("d")).count().where("count > 1").limit(1).count() > 0
    keyed = docs.select(doc.alias("doc"), (F.xxhash64("text") if shared_ids else F.lit(0).cast("long")).alias("th"), "text", "doc_id")
    found = saved(keyed.select("doc", "th", "text").mapInArrow(_spans, SPAN), "found")
    twice = saved(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"), "minimizers")
    again = saved(found.join(twice, "h", "left_semi").select("doc", "th", "start", "n", "h", "ch"), "spans")
    kinds = saved(again.groupBy("h", "ch").agg(F.min(F.struct("doc", "start", "th", "n")).alias("f"), F.count("*").alias("c")), "contents")
    wanted = kinds.join(kinds.groupBy("h").agg(F.count("*").alias("contents")), "h").select("h", "ch", "contents", "f.doc", "f.start", "f.th", "f.n")
    lists = saved(_packed(wanted, ["h", "ch", "start", "n", "contents"], "want"), "wanted")
    source = keyed.select("doc", "th", "text").join(lists, ["doc", "th"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for d, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _words_of(text)
                for w in want:
                    a = w["start"]
                    rows.append((w["h"], w["ch"], w["contents"], d, a, w["n"], b" ".join(words[a : a + w["n"] + WINDOW - 1]).decode("utf-8", "surrogatepass")))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["h", "ch", "contents", "doc", "start", "n", "content"])

    contents = saved(source.select("doc", "text", "want").mapInArrow(cut, "h long, ch long, contents long, doc long, start int, n int, content string").dropDuplicates(["h", "ch"]), "texts")
    usual = contents.where(F.col("contents") <= HOT)
    shards = max(1, usual.count() // SHARD)
    masks = usual.withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards))).groupBy("shard").applyInPandas(repeated_windows, "h long, ch long, mask int, found int")
    single = contents.where(F.col("contents") > HOT).select("h", "ch", "doc", "start", F.posexplode(F.expr(f"transform(sequence(0, n - 1), k -> array_join(slice(split(content, ' '), k + 1, {WINDOW}), ' '))")).alias("k", "w"))
    single = single.select("h", "ch", "k", "w", F.struct("doc", (F.col("start") + F.col("k")).alias("at")).alias("p"))
    bit = F.expr("shiftleft(1, k)")
    later = single.join(single.groupBy("w").agg(F.min("p").alias("least")), "w").groupBy("h", "ch").agg(F.sum(F.when(F.col("least") < F.col("p"), bit).otherwise(0)).cast("int").alias("mask"), F.sum(bit).cast("int").alias("found"))
    masks = saved(masks.union(later), "masks")
    known = kinds.join(masks, ["h", "ch"]).where("c > 1 or mask <> 0").select("h", "ch", F.col("f.doc").alias("fd"), F.col("f.start").alias("fs"), "mask", "found")
    known = saved(known, "known")  # both sides of the join below are then plain shuffles, which can be split where a span is common
    bits = F.when((F.col("doc") == F.col("fd")) & (F.col("start") == F.col("fs")), F.col("mask")).otherwise(F.col("found"))
    marks = again.join(known, ["h", "ch"]).select("doc", "th", "start", bits.alias("mask")).where("mask <> 0").distinct()
    grouped = marks.groupBy("doc", "th").agg(F.sort_array(F.collect_list(F.struct("start", "mask"))).alias("marks"))

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for marks in batch.column(2):
                found: list[int] = []
                for m in marks.as_py():
                    for k in range(int(m["mask"]).bit_length()):
                        if m["mask"] >> k & 1:
                            a = m["start"] + k
                            if found and a <= found[-1]:
                                found[-1] = a + WINDOW
                            else:
                                found += [a, a + WINDOW]
                out.append(np.array(found, "<i4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["doc", "th", "gone"])

    gone = saved(grouped.mapInArrow(intervals, "doc long, th long, gone binary"), "removed")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[tuple] = []
            for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = _words_of(text)
                kept, at = [], 0
                for a, b in np.frombuffer(gone, "<i4").reshape(-1, 2).tolist() if gone else ():
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                whole = b" ".join(kept)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), whole.decode("utf-8", "surrogatepass") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds[: 3 + with_text]))], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: 4 + with_text])

    judged = keyed.join(_bounded(gone, "gone"), ["doc", "th"], "left").select("doc_id", "text", "gone")
    return judged.mapInArrow(remove, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


ORACLE = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i + 1 : i + 20], ' ') as k from w, lateral (select unnest(range(0, greatest(len(ws) - 19, 0))) as i)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as n from win) where n > 1),
gone as (select distinct doc_id, i + j as p from late, range(20) r(j)),
word as (select doc_id, unnest(ws) as x, unnest(range(0, len(ws))) as p from w),
kept as (select word.doc_id, count(*) as n, string_agg(x, ' ' order by word.p) as t from word anti join gone on word.doc_id = gone.doc_id and word.p = gone.p group by 1)
select w.doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256 from w left join kept using (doc_id)
"""
