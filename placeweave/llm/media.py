"""Media columns: signature sniffing.

Aho-Corasick finds every magic byte sequence of a blob in one pass; a validator of each hit's format then walks the
structure (chunk lengths, checksums, trailers) and says where the object ends. A valid object at offset 0 corrects a
wrong declared type; valid objects further in are carved out.

The time is linear in the blob, whatever it holds: walks that fail mark the places they passed, so that a later walk that
comes to one fails there at once; checksums of ranges come from checksums of prefixes once plain ones have read the blob
a few times over; the chunk walks of many RIFF headers go through the blob together. Only gzip members have no such
memory: after failed members have cost INFLATE times the blob, further gzip headers are not inflated and not objects.

Null or empty blobs have no type and no embedded objects. Blobs of any size are read whole. Repeated rows each give
their own row; other columns are kept, except that columns named as the results are replaced.
"""

from __future__ import annotations

import hashlib
import heapq
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from placeweave.llm.common import slices

#: Magic bytes, how far into the format they stand, and the type they announce.
MAGICS = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png"),
    (b"GIF87a", 0, "image/gif"),
    (b"GIF89a", 0, "image/gif"),
    (b"\xff\xd8\xff", 0, "image/jpeg"),
    (b"BM", 0, "image/bmp"),
    (b"RIFF", 0, "riff"),
    (b"%PDF-", 0, "application/pdf"),
    (b"PK\x03\x04", 0, "application/zip"),
    (b"\x1f\x8b\x08", 0, "application/gzip"),
    (b"OggS", 0, "audio/ogg"),
    (b"ftyp", 4, "video/mp4"),
)
#: Trailers, found in the same pass.
TRAILERS = {b"%%EOF": "pdf_end", b"PK\x05\x06": "zip_end"}
RIFF_FORMS = {b"WAVE": "audio/wav", b"WEBP": "image/webp", b"AVI ": "video/avi"}
UNIT = 576
PAD = 255
WAV_RATE = 8000
#: How often plain checksums and inflating may read a blob over; RIFF headers that are walked one by one.
PLAIN_CRC, INFLATE, FEW_RIFF = 4, 16, 8
CRC_BLOCK = 4096


class Found(NamedTuple):
    """An object: its type, where it starts and ends, and where its payload does (the whole object, if not a wave)."""

    kind: str
    start: int
    end: int
    body: int
    body_end: int


class _Blob:
    """A blob with the hits of one automaton pass."""

    def __init__(self, data: bytes):
        self.data, self.hits = data, []
        self.ends: dict[str, list[int]] = {name: [] for name in TRAILERS.values()}
        self.inflated = 0
        self._next_eoi = (0, -1)
        self._passed: dict[str, bytearray] = {}
        self._checked, self._prefixes = 0, None
        self._riff: dict[int, int] | None = None
        self.png_ends: dict[int, int] = {}
        for end, names in _automaton().iter(data.decode("latin-1")):
            for length, back, kind in names:
                start = end - length + 1
                if kind in self.ends:
                    self.ends[kind].append(start)
                elif start >= back:
                    self.hits.append((start - back, kind))
        self.hits.sort()

    def trailer(self, name: str, after: int) -> int:
        at = bisect_left(self.ends[name], after)
        return self.ends[name][at] if at < len(self.ends[name]) else -1

    def passed(self, kind: str) -> bytearray:
        """A mark for each place that a walk of this kind has come to. Walks only go forward, and a walk that succeeds moves
        the search past its end, so a marked place that is met again lies on a walk that failed."""
        if kind not in self._passed:
            self._passed[kind] = bytearray(len(self.data) + 1)
        return self._passed[kind]

    def forget(self) -> None:
        self._passed.clear()

    def crc(self, start: int, end: int) -> int:
        """The CRC-32 of a range: directly, or, once that has read PLAIN_CRC times the blob, from those of prefixes."""
        if end - start <= 2 * CRC_BLOCK or self._checked + end - start <= PLAIN_CRC * len(self.data):
            self._checked += end - start
            return zlib.crc32(memoryview(self.data)[start:end])
        if self._prefixes is None:
            self._prefixes, value = [0], 0
            for at in range(0, len(self.data), CRC_BLOCK):
                value = zlib.crc32(memoryview(self.data)[at : at + CRC_BLOCK], value)
                self._prefixes.append(value)
        first, last = (zlib.crc32(memoryview(self.data)[x - x % CRC_BLOCK : x], self._prefixes[x // CRC_BLOCK]) for x in (start, end))
        return last ^ _crc_shifted(first, end - start)

    def riff_end(self, at: int) -> int:
        """Where the RIFF form at a hit ends, or -1."""
        heads = [start for start, kind in self.hits if kind == "riff"] if self._riff is None else ()
        if 0 < len(heads) <= FEW_RIFF:
            return _riff_ends(self.data, [at]).get(at, -1)
        if self._riff is None:
            self._riff = _riff_ends(self.data, heads)
        return self._riff.get(at, -1)

    def next_eoi(self, after: int) -> int:
        """The next end-of-image marker; hits come in order, so what one search found serves those before it."""
        asked, found = self._next_eoi
        if not (asked <= after and (found >= after or found < 0 < asked)):
            found = self.data.find(b"\xff\xd9", after)
            self._next_eoi = (max(after, 1), found)
        return found


@lru_cache(1)
def _automaton() -> ahocorasick.Automaton:
    words: dict[str, list[tuple[int, int, str]]] = {}
    for magic, back, kind in MAGICS:
        words.setdefault(magic.decode("latin-1"), []).append((len(magic), back, kind))
    for trailer, name in TRAILERS.items():
        words.setdefault(trailer.decode("latin-1"), []).append((len(trailer), 0, name))
    found = ahocorasick.Automaton()
    for word, names in words.items():
        found.add_word(word, tuple(names))
    found.make_automaton()
    return found


def _times(a: int, b: int) -> int:
    """The product of two polynomials over GF(2) modulo that of CRC-32, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        bit >>= 1
        b = b >> 1 ^ 0xEDB88320 if b & 1 else b >> 1
    return out


@lru_cache(1)
def _byte_powers() -> list[int]:
    """x to the 8 * 2^i, modulo that polynomial."""
    out = [1 << 23]
    while len(out) < 48:
        out.append(_times(out[-1], out[-1]))
    return out


def _crc_shifted(crc: int, n: int) -> int:
    """What a prefix's CRC-32 adds to that of the prefix and n more bytes."""
    for i, power in enumerate(_byte_powers()):
        if n >> i & 1:
            crc = _times(power, crc)
    return crc


def _png(blob: _Blob, at: int) -> int:
    """Chunks up to IEND, then their checksums from the last one back; what follows a chunk is judged once."""
    data, pos, passed, chunks, end = blob.data, at + 8, blob.passed("png"), [], -1
    while pos + 12 <= len(data) and not passed[pos]:
        if pos in blob.png_ends:
            end = blob.png_ends[pos]
            break
        length, kind = struct.unpack_from(">I4s", data, pos)
        stop = pos + 12 + length
        if stop > len(data) or pos == at + 8 and (kind != b"IHDR" or length != 13) or not kind.isalpha():
            break
        chunks.append((pos, stop))
        pos = stop
        if kind == b"IEND":
            end = stop
            break
    for a, b in reversed(chunks):
        if end >= 0 and struct.unpack_from(">I", data, b - 4)[0] == blob.crc(a + 4, b - 4):
            blob.png_ends[a] = end
        else:
            passed[a], end = 1, -1
    return end


def _gif(blob: _Blob, at: int) -> int:
    data = blob.data
    if at + 13 > len(data):
        return -1
    flags = data[at + 10]
    pos = at + 13 + (3 << (flags & 7) + 1 if flags & 128 else 0)
    blocks, sub = blob.passed("gif"), blob.passed("gif sub-blocks")
    while pos < len(data) and not blocks[pos]:
        blocks[pos] = 1
        if data[pos] == 0x3B:
            return pos + 1
        if data[pos] == 0x21:
            pos += 2
        elif data[pos] == 0x2C and pos + 10 < len(data):
            flags = data[pos + 9]
            pos += 11 + (3 << (flags & 7) + 1 if flags & 128 else 0)
        else:
            return -1
        while pos < len(data) and data[pos]:
            if sub[pos]:
                return -1
            sub[pos] = 1
            pos += data[pos] + 1
        pos += 1
    return -1


def _jpeg(blob: _Blob, at: int) -> int:
    data, pos, passed = blob.data, at + 2, blob.passed("jpeg")
    while pos + 4 <= len(data) and data[pos] == 255 and not passed[pos]:
        passed[pos] = 1
        if data[pos + 1] == 0xDA:
            end = blob.next_eoi(pos)
            return end + 2 if end >= 0 else -1
        if data[pos + 1] < 0xC0:
            return -1
        pos += 2 + struct.unpack_from(">H", data, pos + 2)[0]
    return -1


def _bmp(blob: _Blob, at: int) -> int:
    if at + 54 > len(blob.data):
        return -1
    size, spare, offset, header = struct.unpack_from("<IIII", blob.data, at + 2)
    fits = spare == 0 and header in (12, 40, 52, 56, 64, 108, 124) and 14 + header <= offset <= size <= len(blob.data) - at
    return at + size if fits else -1


def _riff_ends(data: bytes, heads: list[int]) -> dict[int, int]:
    """The end of each valid form among ``heads``: its chunks fill it exactly, but for the last one's padding.

    All walks go through the blob together, by place: those that come to one place go on as one, with the ends that they
    still have to meet in a heap, so that every place is passed once.
    """
    out: dict[int, int] = {}
    coming: dict[int, list[tuple[int, int]]] = {}
    places: list[int] = []

    def arrive(at: int, group: list[tuple[int, int]]) -> None:
        """Joins the smaller group to the larger."""
        if at not in coming:
            coming[at] = group
            heapq.heappush(places, at)
            return
        large, small = sorted((coming[at], group), key=len, reverse=True)
        for x in small:
            heapq.heappush(large, x)
        coming[at] = large

    for at in heads:
        if at + 12 <= len(data):
            size, form = struct.unpack_from("<I4s", data, at + 4)
            if form in RIFF_FORMS and at + 20 <= at + 8 + size <= len(data):
                arrive(at + 12, [(at + 8 + size, at)])
    while places:
        pos = heapq.heappop(places)
        group = coming.pop(pos)
        length = struct.unpack_from("<I", data, pos + 4)[0] if pos + 8 <= len(data) else 0
        stop = pos + 8 + length
        after = stop + (length & 1)
        while group and group[0][0] < stop:  # the chunk does not fit
            heapq.heappop(group)
        while group and group[0][0] <= after:
            end, at = heapq.heappop(group)
            out[at] = end
        while group and group[0][0] < after + 8:
            heapq.heappop(group)
        if group:
            arrive(after, group)
    return out


def _riff(blob: _Blob, at: int) -> tuple[int, str, int, int]:
    """End, type, and the data chunk's bounds."""
    data, end = blob.data, blob.riff_end(at)
    if end < 0:
        return -1, "", 0, 0
    pos, body = at + 12, (at, at)
    while pos + 8 <= end:
        name, length = struct.unpack_from("<4sI", data, pos)
        if name == b"data":
            body = (pos + 8, pos + 8 + length)
        pos += 8 + length + (length & 1)
    return end, RIFF_FORMS[data[at + 8 : at + 12]], *body


def _pdf(blob: _Blob, at: int) -> int:
    version = blob.data[at + 5 : at + 8]
    end = blob.trailer("pdf_end", at + 8)
    return end + 5 if end >= 0 and version[:1].isdigit() and version[1:2] == b"." and version[2:3].isdigit() else -1


def _zip(blob: _Blob, at: int) -> int:
    end = blob.trailer("zip_end", at + 4)
    if end < 0 or end + 22 > len(blob.data):
        return -1
    size, offset, comment = struct.unpack_from("<IIH", blob.data, end + 12)
    total = end + 22 + comment
    return total if at + offset + size == end and total <= len(blob.data) else -1


def _gzip(blob: _Blob, at: int) -> int:
    unzip, pos, most, before = zlib.decompressobj(31), at, INFLATE * len(blob.data), blob.inflated
    try:
        while not unzip.eof and (pos < len(blob.data) or unzip.unconsumed_tail):
            if blob.inflated > most:
                return -1
            piece = unzip.unconsumed_tail or blob.data[pos : pos + (65536 if pos > at else 512)]
            pos += 0 if unzip.unconsumed_tail else len(piece)
            made = unzip.decompress(piece, 1 << 20)
            blob.inflated += len(piece) + len(made) // 16
    except zlib.error:
        return -1
    if not unzip.eof:
        return -1
    blob.inflated = before  # a valid member is passed over
    return pos - len(unzip.unused_data)


def _ogg(blob: _Blob, at: int) -> int:
    data, pos, last, passed = blob.data, at, False, blob.passed("ogg")
    if at + 6 > len(data) or not data[at + 5] & 2:
        return -1
    while not last and pos + 27 <= len(data) and data[pos : pos + 5] == b"OggS\0" and not passed[pos]:
        passed[pos] = 1
        last = bool(data[pos + 5] & 4)
        table = data[pos + 27 : pos + 27 + data[pos + 26]]
        pos += 27 + len(table) + sum(table)
    return pos if last and pos <= len(data) else -1


def _mp4(blob: _Blob, at: int) -> int:
    data, pos, boxes = blob.data, at, 0
    while pos + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, pos)
        if size < 8 or pos + size > len(data) or not name.isalnum():
            break
        pos, boxes = pos + size, boxes + 1
    return pos if boxes >= 2 else -1


VALIDATORS: dict[str, Callable[[_Blob, int], int]] = {
    "image/png": _png, "image/gif": _gif, "image/jpeg": _jpeg, "image/bmp": _bmp, "application/pdf": _pdf,
    "application/zip": _zip, "application/gzip": _gzip, "audio/ogg": _ogg, "video/mp4": _mp4,
}


def sniff(data: bytes | None) -> list[Found]:
    """All valid objects by start: the container at 0, if any, and what is embedded; of others that overlap, the first."""
    blob, found, free = _Blob(data or b""), [], 0
    for at, kind in blob.hits:
        if at < free:
            continue
        if kind == "riff":
            end, kind, body, body_end = _riff(blob, at)
        else:
            end = body_end = VALIDATORS[kind](blob, at)
            body = at
        if end > at:
            found.append(Found(kind, at, end, body, body_end))
            free = end if at else 0
            if not at:
                blob.forget()  # the walk through the container did not fail
    return found


def corrected_type(found: list[Found], declared: str | None) -> str | None:
    """The type of the object at 0; without one, what was declared."""
    return found[0].kind if found and found[0].start == 0 else declared


def to_wave(payload: bytes) -> bytes:
    """The payload as the unsigned 8-bit mono samples of a wave file."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload) + (len(payload) & 1), b"WAVE", b"fmt ", 16, 1, 1, WAV_RATE, WAV_RATE, 1, 8, b"data", len(payload))
    return head + payload + b"\0" * (len(payload) & 1)


def padded(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def sniff_column(df: DataFrame, media: str = "media", declared: str = "media_type") -> DataFrame:
    """Adds ``detected_type``, ``type_corrected`` and ``embedded`` (type, start, length, bytes of each carved object)."""
    df = df.drop(*(c for c in ("detected_type", "type_corrected", "embedded") if c not in (media, declared)))
    keep = df.columns
    item = pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("bytes", pa.binary())])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + ["detected_type string, type_corrected boolean, embedded array<struct<type:string,start:bigint,length:bigint,bytes:binary>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            types, wrong, inside = [], [], []
            for data, said in zip(batch.column(keep.index(media)), batch.column(keep.index(declared)), strict=True):
                data, said = data.as_py(), said.as_py()
                found = sniff(data)
                types.append(corrected_type(found, said))
                wrong.append(types[-1] != said)
                inside.append([{"type": f.kind, "start": f.start, "length": f.end - f.start, "bytes": data[f.start : f.end]} for f in found if f.start])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(types, pa.string()), pa.array(wrong, pa.bool_()), pa.array(inside, pa.list_(item))], names=[*keep, "detected_type", "type_corrected", "embedded"])

    return df.mapInArrow(run, schema)


DIGEST = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


#: What the stored texts are declared as, by their checksum; ``sniff`` corrects it.
DECLARED = ("application/octet-stream", "text/plain", "audio/wav", "image/png")


def text_as_media(df: DataFrame, declared: tuple[str, ...] = DECLARED) -> DataFrame:
    """Each whole text (null: empty) stored as a wave, sniffed, carved out again and digested; see ``DIGEST``.

    Everything is computed from the stored bytes: the type and the payload's place come from ``sniff``. The feature
    names the corrected and the declared type, the sample count, the samples' sum and the objects embedded further in.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows: list[list] = [[] for _ in range(7)]
            for text in batch.column(1):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                media = to_wave(padded(data))
                found = sniff(media)
                first = found[0]
                back = media[first.body : first.body_end]
                inside = ";".join(f"{f.kind}@{f.start - first.body}+{f.end - f.start}" for f in found[1:])
                samples = np.frombuffer(back, np.uint8)
                said = declared[zlib.crc32(data) % len(declared)]
                right = corrected_type(found, said)
                feature = f"{right};declared={said};corrected={int(right != said)};samples={len(samples)};sum={int(samples.sum(dtype=np.int64))};embedded={inside}"
                for to, value in zip(rows, (len(data), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                    to.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds, strict=True))], names=[x.split()[0] for x in DIGEST.split(", ")])

    return df.select(df["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(run, DIGEST)
