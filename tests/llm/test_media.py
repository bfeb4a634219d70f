import gzip
import io
import random
import struct
import time
import zipfile
import zlib

from placeweave.llm import media


def png() -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def zipped() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("a.txt", "hello")
    return out.getvalue()


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"


def test_types_and_carving():
    parts = [png(), GIF, gzip.compress(b"x" * 3000), zipped(), b"%PDF-1.4\nbody\n%%EOF", media.to_wave(b"abc")]
    for data in parts:
        assert [(f.start, f.end) for f in media.sniff(data)][:1] == [(0, len(data))]
    blob = b"junk".join([b"", *parts, b""])
    found = media.sniff(blob)
    assert [blob[f.start : f.end] for f in found] == parts
    assert media.corrected_type(media.sniff(png()), "image/gif") == "image/png"
    assert media.corrected_type(media.sniff(b"plain"), "text/plain") == "text/plain"


def test_broken_structures_are_no_objects():
    broken = bytearray(png())
    broken[-20] ^= 1
    for data in (bytes(broken), png()[:-4], GIF[:-1], gzip.compress(b"x" * 300)[:-3], b"RIFF\xff\0\0\0WAVE", b"BM" + b"\0" * 60, b"", None):
        assert media.sniff(data) == []


def test_round_trip(spark):
    texts = [None, "", "a" * 575, "a" * 576, "ü" * 289, "GIF89a BM RIFF %PDF-1.4 x %%EOF", "x" * 2_000_000, "a" * 576]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, feature string")
    rows = {r.doc_id: r for r in media.text_as_media(df).collect()}
    import hashlib

    for i, t in enumerate(texts):
        data = (t or "").encode()
        want = data + b"\xff" * (max(1, -(-len(data) // 576)) * 576 - len(data))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-32:]))
        assert r.media_bytes == len(want) + 44
    assert "application/pdf@" in rows[5].feature and rows[3][1:] == rows[7][1:]
    assert media.text_as_media(df.limit(0)).count() == 0


def test_sniff_column(spark):
    df = spark.createDataFrame([(1, bytearray(png() + GIF), "image/gif", "x"), (2, None, None, "y"), (3, bytearray(b"text"), "text/plain", "z")], "id int, media binary, media_type string, embedded string")
    rows = {r.id: r for r in media.sniff_column(df).collect()}
    assert rows[1].detected_type == "image/png" and rows[1].type_corrected and bytes(rows[1].embedded[0].bytes) == GIF
    assert rows[2].detected_type is None and rows[2].embedded == [] and rows[3].detected_type == "text/plain"


def plain_crc(data, a, b):
    return zlib.crc32(data[a:b])


def test_crc_of_ranges_from_prefixes(monkeypatch):
    monkeypatch.setattr(media, "PLAIN_CRC", 0)
    data = bytes(range(256)) * 300
    blob = media._Blob(data)
    for a, b in ((0, 70_000), (1, 50_001), (4096, 65_536), (5000, 76_800), (3, 9)):
        assert blob.crc(a, b) == plain_crc(data, a, b)


def test_many_riff_forms_equal_single_walks():
    rng = random.Random(4)
    for _ in range(300):
        data = bytearray(b"".join(rng.choice([b"RIFF", b"WAVE", b"data", b"\x04\0\0\0", b"\x08\0\0\0", b"\0\0\0\0", b"\x03\0\0\0", b"\x24\0\0\0", b"\x0d\0\0\0"]) for _ in range(60)))
        for _ in range(4):
            at = rng.randrange(0, len(data) - 30) & ~3
            data[at : at + 12] = struct.pack("<4sI4s", b"RIFF", rng.randrange(8, len(data) - at), b"WAVE")
        data, heads = bytes(data), [i for i in range(len(data)) if data[i : i + 4] == b"RIFF"]

        def plain(at):
            if at + 12 > len(data):
                return -1
            size, form = struct.unpack_from("<I4s", data, at + 4)
            end, pos = at + 8 + size, at + 12
            if form not in media.RIFF_FORMS or end > len(data):
                return -1
            while pos + 8 <= end:
                length = struct.unpack_from("<I", data, pos + 4)[0]
                if pos + 8 + length > end:
                    return -1
                pos += 8 + length + (length & 1)
            return end if pos in (end, end + 1) and pos > at + 12 else -1

        want = {at: plain(at) for at in heads}
        got = media._riff_ends(data, heads)
        assert {at: got.get(at, -1) for at in heads} == want


def test_a_png_inside_a_broken_one_is_found():
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))
    inner = head + chunk(b"IDAT", b"x")
    outer = head + struct.pack(">I", len(inner)) + b"IDAT" + inner + b"\0\0\0\0" + chunk(b"IEND", b"")
    joint = head + struct.pack(">I", len(inner) - 4) + b"IDAT" + inner + chunk(b"IEND", b"")  # the broken chunk ends where a right one does
    assert media.sniff(outer) == []
    assert [(f.start, f.end) for f in media.sniff(joint)] == [(len(head) + 8, len(joint))]


def test_long_hostile_blobs_take_linear_time():
    page = b"OggS\0\2" + b"\0" * 20 + b"\1\4"
    ihdr = struct.pack(">I", 13) + b"IHDR" + bytes(13)
    ihdr += struct.pack(">I", zlib.crc32(ihdr[4:]))
    n = 1 << 21
    blobs = [
        (page + b"aaaa") * (n // 32),
        (b"RIFF" + struct.pack("<I", n // 2) + b"WAVE") * (n // 12),
        b"".join(b"RIFF" + struct.pack("<I", n - 32 * i - 9) + b"WAVEfmt \x0c\0\0\0" + bytes(8) for i in range(n // 32)),
        (b"GIF89a" + bytes(7) + b"!" + b"\1") * (n // 15),
        b"\xff\xd8\xff\xe0\0\2" * (n // 6),
        (b"\0\0\0\x08ftyp" + b"?") * (n // 9),
        (b"%PDF-1.4 PK\3\4BM") * (n // 16),
        (b"\x1f\x8b\x08" + bytes(7) + b"\0\xff\xff\0\0") * (n // 15),
    ]
    tail = struct.pack(">I", 0) + b"IEND" + struct.pack(">I", zlib.crc32(b"IEND"))
    step, count = 8 + len(ihdr) + 8, n // 45
    blobs.append(b"".join(b"\x89PNG\r\n\x1a\n" + ihdr + struct.pack(">I", (count - 1 - i) * step) + b"IDAT" for i in range(count)) + b"\0\0\0\0" + tail)
    for blob in blobs:
        began = time.process_time()
        media.sniff(blob)
        assert time.process_time() - began < 12


def test_declared_types_are_corrected(spark):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    features = [r.feature for r in media.text_as_media(df).collect()]
    assert all(f.startswith("audio/wav;") for f in features)
    assert {f.split(";")[1].split("=")[1] for f in features} == set(media.DECLARED)
    assert all(("corrected=0" in f) == ("declared=audio/wav" in f) for f in features)
