import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from placeweave.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("chunk", [1 << 18, 5])
def test_pack(spark, monkeypatch, chunk):
    monkeypatch.setattr(packing, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    texts = [" ".join("word%d é" % x for x in rng.integers(0, 99, n)) for n in rng.integers(0, 700, 120)] + [None, "", "x" * 50_000, "<|endoftext|>", texts0 := "same text", texts0]
    rows = [(i, t, "a") for i, t in enumerate(texts)] + [(None, "no id", "a"), (3, texts[3], "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, piece string").repartition(19)
    got = packing.pack(df, PATH).toPandas()
    encode = tokenizers.Tokenizer.from_file(PATH)
    encode.encode_special_tokens = True
    want = []
    for i, t, _ in rows:
        ids = encode.encode(t or "", add_special_tokens=False).ids + [2]
        first = len(ids) % 1024 or 1024
        cuts = [0, *range(first, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(-1 if i is None else i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    found = got.assign(doc_id=got.doc_id.fillna(-1).astype(int))[["doc_id", "piece", "start", "length", "ids_crc32"]]
    assert sorted(found.itertuples(index=False, name=None)) == sorted(want)
    for _, own in got.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024
    bound = -(-got.length.sum() // 1024)
    assert got.sequence_id.nunique() <= bound * 1.1 + 3
    assert packing.pack(df.limit(0), PATH).count() == 0


def test_best_fit():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 5000)
    where, at, fills = packing.best_fit(sizes)
    assert fills.max() <= 1024 and fills.sum() == sizes.sum() and len(fills) <= 1.03 * -(-sizes.sum() // 1024)
    for b in np.unique(where)[:200]:
        own = np.flatnonzero(where == b)
        own = own[np.argsort(at[own])]
        assert list(at[own]) == [0, *np.cumsum(sizes[own])[:-1]]


def test_layout_places_every_rank_once():
    rng = np.random.default_rng(2)
    for sizes in (rng.integers(1, 1025, 4000), rng.integers(1, 9, 5000), np.full(3000, 400), np.array([1024, 1, 1]), rng.geometric(0.01, 3000).clip(1, 1024)):
        values, n = np.unique(sizes, return_counts=True)
        where, bins = packing.layout(dict(zip(values.tolist(), n.tolist(), strict=True)))
        held = {}
        for size, ranges in where.items():
            assert [a for a, *_ in ranges] == [0, *(b for _, b, *_ in ranges)][:-1] and ranges[-1][1] == n[values == size][0]
            for a, b, first, offset in ranges:
                for i in range(b - a):
                    held.setdefault(first + i, []).append((offset, size))
        assert sorted(held) == list(range(bins))
        for items in held.values():
            items.sort()
            assert [o for o, _ in items] == [0, *np.cumsum([s for _, s in items])[:-1]] and sum(s for _, s in items) <= 1024
        assert bins <= len(packing.best_fit(sizes)[2]) * 1.01 + 1  # as good as piece by piece


def test_as_few_sequences_for_any_number_of_tasks(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    found = [packing.pack(docs.repartition(n, "doc_id"), PATH).toPandas() for n in (1, 16, 60)]
    bound = -(-found[0].length.sum() // 1024)
    for got in found:
        assert got.sequence_id.nunique() <= bound * 1.005 + 1
        for _, own in got.sort_values("offset").groupby("sequence_id"):
            assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024


def test_ids_equal_those_of_the_library_as_it_is():
    """No setting touched: the added token's text becomes that token."""
    library, own = tokenizers.Tokenizer.from_file(PATH), packing.encoder(PATH, special=True)
    scripts = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", "日本語のテキスト。", "ภาษาไทย", "\x00\x01\x7f\r\n\t \x85", "e\u0301 \u200d", "aaaa" * 400, "0123456789" * 90, "!?" * 500, "it's 'll  we've\n\n x", "\U0001f600 \U0001f468\u200d\U0001f469"]
    for text in scripts:
        assert own(text) == library.encode(text, add_special_tokens=False).ids, text


def test_merges_out_of_order_are_refused(tmp_path):
    import json

    spec = json.load(open(PATH, encoding="utf-8"))
    spec["model"]["merges"][:2] = spec["model"]["merges"][1::-1]
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="order"):
        packing.encoding(str(other))
    packing.encoding.cache_clear()
