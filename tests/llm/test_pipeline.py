import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
import tokenizers
from brute import near_components
from test_secrets import brute as brute_secrets

from placeweave.llm import mixing, secrets, toxicity
from placeweave.llm.common import saved

SF = "/root/testdata/sf0.001"


def test_each_stage(spark):
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = saved(corpus_pipeline.drop_toxic(spark, docs, SF), "t")
    assert clean.columns == names
    rows = docs.toPandas()
    import pyarrow as pa

    score = model.score(pa.array(rows.text), model.tables())
    cut = np.array([model.cuts.get(x, model.cut) for x in rows.lang])
    assert set(clean.toPandas().doc_id) == set(rows.doc_id[score < cut])

    unique = saved(corpus_pipeline.drop_near_duplicates(spark, clean, SF), "t")
    before = [(r.doc_id, r.text) for r in clean.collect()]
    want = near_components(before, 80)
    assert sorted(r.doc_id for r in unique.collect()) == sorted(i for i, (_, root) in want.items() if i == root)

    safe = saved(corpus_pipeline.redact_secrets(spark, unique, SF), "t")
    texts = {r.doc_id: r.text for r in unique.collect()}
    for r in safe.collect():
        left = texts[r.doc_id]
        for _, a, b in sorted(brute_secrets(left), key=lambda s: -s[1]):
            left = left[:a] + left[b:]
        if not brute_secrets(texts[r.doc_id]) and not secrets.find_secrets(texts[r.doc_id]):
            assert r.text == texts[r.doc_id]
        assert brute_secrets(r.text) == [] and r.n_chars == len(r.text) and safe.columns == names

    mixed = saved(corpus_pipeline.mix_sources(spark, safe, SF), "t")
    documents = safe.toPandas()  # noqa: F841  (read by DuckDB)
    taken = {i: (n, s) for i, s, _, _, n in duckdb.sql(mixing.ORACLE).fetchall()}
    got = {}
    for r in mixed.collect():
        got.setdefault(r.doc_id, []).append(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)))
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in safe.collect()}
    times = {i: n // sizes[i] + (2 * (n % sizes[i]) >= sizes[i]) for i, (n, _) in taken.items() if sizes[i]}
    assert {i: len(n) for i, n in got.items()} == {i: n for i, n in times.items() if n}
    assert {tuple(r) for r in mixed.collect()} <= {tuple(r) for r in safe.collect()} and mixed.columns == names

    packed = corpus_pipeline.pack_sequences(spark, mixed, SF).toPandas()
    encode = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode.encode_special_tokens = True
    ids = sorted(tuple(encode.encode(r.text, add_special_tokens=False).ids + [2]) for r in mixed.collect())
    assert packed.length.sum() == sum(map(len, ids))
    crcs = sorted(zlib.crc32(np.array(p, "<u4").tobytes()) for p in packed.ids)
    assert crcs == sorted(packed.ids_crc32)
    short = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids if len(x) <= 1024)
    assert not set(short) - set(crcs)
    for _, own in packed.sort_values("offset").groupby("sequence_id"):
        assert list(own.offset) == [0, *own.length.cumsum()[:-1]] and own.length.sum() <= 1024


def test_registered():
    import __spark_entry__ as entry

    found = entry.queries()
    assert len([x for x in found if re.fullmatch(r"op\d+_\w+", x)]) == 13 and "pipeline" in found
    assert set(entry.oracle_sql()) <= set(found)


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls in any column, empty and long texts, repeated rows, clashing names, an empty table."""
    from placeweave.llm import common

    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text, "en", "a", 5), (1, text, "en", "a", 5), (2, None, None, None, None), (3, "", "de", "b", 0), (None, "no id here at all", "en", "a", 9), (4, "password = hunter2secret and " + text[:60], "en", None, 3), (5, "long " * 60_000, "fr", "b", 1)]
    names = "doc_id long, text string, lang string, source string, n_chars int, size int, score string, cid int, doc string"
    df = spark.createDataFrame([(*r, 9, "s", 7, "d") for r in rows], names)
    for docs in (df, df.limit(0)):
        sf = str(tmp_path / str(docs.count()))
        docs.write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame([(1, 0), (9, 1)], "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
        now, before = spark.read.parquet(f"{sf}/documents.parquet"), common.tables()
        for name, stage in corpus_pipeline.STAGES[:-1]:
            now = common.settled(stage(spark, now, sf), name, before)
            assert now.columns == docs.columns
            assert all((r["size"], r.score, r.cid, r.doc) == (9, "s", 7, "d") for r in now.collect())
        assert len(common.tables() - before) == 1
        found = now.collect()
        packed = corpus_pipeline.pack_sequences(spark, now, sf).collect()
        if not docs.count():
            assert found == packed == []
            continue
        assert {r.doc_id for r in found} == {1, None, 4, 5} and len(packed) >= len(found)
        assert "hunter2secret" not in "".join(r.text for r in found)
        assert max(r.length for r in packed) == 1024 and {r.doc_id for r in packed} == {1, None, 4, 5}
