import hashlib
from collections import defaultdict

import public_tokenizers
import sentencepiece
from tokenizers import Tokenizer

from placeweave.llm import alignment as G
from placeweave.llm import queries

PATHS = [public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model")]


def plain(rows):
    """(doc_id, ...) by tokenizing whole texts and comparing all byte ranges."""
    a_model, b_model = Tokenizer.from_file(PATHS[0]), sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    a_model.encode_special_tokens = True
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    docs, held = [], defaultdict(int)
    for doc_id, text in rows:
        a = a_model.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_model.encode(text) if text else []
        spelt_a = [bytes(back[c] for c in a_model.id_to_token(i)) for i in a]
        spelt_b = [bytes([int(p[3:5], 16)]) if len(p) == 6 and p.startswith("<0x") else p.replace("▁", " ").encode() for p in map(b_model.id_to_piece, b)]
        whole = (" " + text).encode() if text else b""
        if b"".join(spelt_a) != whole or b"".join(spelt_b) != whole:
            a = b = spelt_a = spelt_b = []
        spans = []
        for spelt in (spelt_a, spelt_b):
            at, own = 0, []
            for x in spelt:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        links, j = [], 0
        for (s, e), x in zip(spans[0], a, strict=True):
            while j and spans[1][j][0] > s:
                j -= 1
            while j < len(b) and spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(b) and spans[1][k][0] < e:
                links.append((x, b[k]))
                k += 1
        cuts = {e for _, e in spans[0]} & {e for _, e in spans[1]}
        sides = []
        for ids, own in ((a, spans[0]), (b, spans[1])):
            groups, now = [], []
            for i, (_, e) in zip(ids, own, strict=True):
                now.append(str(i))
                if e in cuts:
                    groups.append(",".join(now))
                    now = []
            sides.append(groups)
        groups = [f"{x}|{y}" for x, y in zip(*sides, strict=True)]
        docs.append((doc_id, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""))
        for pair in set(links):
            held[pair] += 1
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return sorted(((i, x, y, g, len(links), sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), h) for i, x, y, g, links, h in docs), key=str)


def result(frame):
    return sorted((tuple(r) for r in frame.collect()), key=str)


def test_query_equals_plain(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.QUERIES["op13_tokenizer_alignment"](spark, sf)
    assert got.columns == [x.split()[0] for x in G.RESULT.split(", ")]
    assert result(got) == plain(rows)


ODD = ["", None, " ", "  ", "a", " a", "a ", "a  b", " \t a\n\n b ", "▁", "a ▁b", "<s> </s> <unk> <|endoftext|>x", "  x  y", "é é ﬁ ½", "日本語 テスト", "\x00 \x01", "x\x1c y\x85 z", "🙂🙂 👩‍👩‍👧", "don't we'll  I'M", "<0x41> �", "a" * 3000, "ab " * 3000, "\r\n \r\n", "　 x  "]


def test_odd_texts(spark):
    rows = [(i if i % 7 else None, t) for i, t in enumerate(ODD)] + [(3, "a"), (3, "a  b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as chunk", "'x' as key", "2 as n").repartition(3)
    assert result(G.align(docs, *PATHS)) == plain(rows)
    assert result(G.align(docs, *PATHS, chunk=1)) == plain(rows)
    assert G.align(docs.where("false"), *PATHS).collect() == []


def test_forgets_segments(spark, monkeypatch):
    monkeypatch.setattr(G, "SEGMENTS", 2)
    rows = [(i, t) for i, t in enumerate(ODD)]
    run, found = G._aligned(*PATHS, 1 << 20), []
    monkeypatch.setattr(G.TaskContext, "get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    import pyarrow as pa

    for batch in run(iter([pa.RecordBatch.from_pylist([{"doc_id": i, "text": t}]) for i, t in rows])):
        found += [x for x in batch.to_pylist() if x["kind"] == "doc"]
    assert [(x["doc_id"], x["n_a"], x["n_b"], x["n_groups"], x["groups_sha256"]) for x in found] == [(*x[:4], x[7]) for x in sorted(plain(rows))]
