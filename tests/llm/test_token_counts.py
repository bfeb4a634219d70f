import random

import public_tokenizers
import tokenizers
from pyspark.sql import functions as F

from placeweave.llm import token_counts
from placeweave.llm.packing import encoding

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_tree_equals_whole_encoding_after_every_edit(monkeypatch):
    monkeypatch.setattr(token_counts, "LEAF", 12)
    whole = tokenizers.Tokenizer.from_file(PATH)
    whole.encode_special_tokens = True
    fast = encoding(PATH).encode_ordinary
    rng = random.Random(2)
    pieces = ["word", " a b c ", "  ", "\n", "it's ", "don't", "123", " 45 ", "é", "日本", ", ", "_", "'", "<|endoftext|>", "x y", "\t", "!?"]
    for _ in range(60):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(40)))
        tree = token_counts.TokenTree(text, lambda s: len(fast(s)))
        for _ in range(12):
            assert tree.text == text and tree.tokens == len(whole.encode(text, add_special_tokens=False).ids)
            a = rng.randrange(-2, len(text) + 3)
            b, put = a + rng.choice([0, 0, 1, 3, 20]), rng.choice(["", *pieces, "many words put in here at once, all of them"])
            tree.edit(a, b, put)
            a = min(max(a, 0), len(text))
            text = text[:a] + put + text[min(max(b, a), len(text)) :]


def test_only_touched_leaves_are_encoded_again():
    text = "some words " * 20_000
    tree = token_counts.TokenTree(text, lambda s: len(s.split()))
    tree.encoded = 0
    tree.edit(100_000, 100_010, "other")
    assert tree.encoded < 5 * token_counts.LEAF


def test_frame(spark):
    edit = {"start": 3, "stop": 1000, "insert": None}
    rows = [(1, None, [edit]), (2, "", []), (3, "hello world", None), (4, "hello world", [edit, None, {"start": None, "stop": None, "insert": "x "}]), (4, "y" * 300_000, [edit])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,insert:string>>")
    got = token_counts.count_tokens(df.withColumnRenamed("doc_id", "n_edits"), PATH).collect()
    assert [(r.n_tokens, r.n_edits, r.n_tokens_edited) for r in got][:4] == [(0, 1, 0), (0, 0, 0), (2, 0, 2), (2, 2, 2)]
    assert token_counts.count_tokens(df.limit(0), PATH).count() == 0


SCRIPTS = {
    "en": "some words and more of them ",
    "zh": "我们今天去公园散步，天气很好。",
    "th": "ภาษาไทยเป็นภาษาที่มีระดับเสียง",
    "base64": "QWxhZGRpbjpvcGVuIHNlc2FtZQ0KMTIzNDU2Nzg5",
    "code": "for(i=0;i<n;i++){a[i]=b[i]*2;}",
    "lines": "item\n",
}


def test_every_script_has_leaves_and_edits_touch_few():
    whole = tokenizers.Tokenizer.from_file(PATH)
    fast = encoding(PATH).encode_ordinary
    for name, piece in SCRIPTS.items():
        text = piece * 2000
        tree = token_counts.TokenTree(text, lambda s: len(fast(s)))
        assert max(map(len, tree.leaves)) < 2 * token_counts.LEAF, name
        size = len(tree.sums)
        tree.encoded = 0
        for at in range(1000, len(text) - 1000, len(text) // 7):
            tree.edit(at, at + 3, piece[:9])
            text = text[:at] + piece[:9] + text[at + 3 :]
        assert tree.encoded < 8 * 4 * token_counts.LEAF and len(tree.sums) == size, name
        assert tree.text == text and tree.tokens == len(whole.encode(text, add_special_tokens=False).ids), name


def test_stored_trees_are_edited_without_whole_encoding(spark):
    texts = [piece * n for piece in SCRIPTS.values() for n in (0, 1, 700)] + [None]
    edit = lambda a: [{"start": a, "stop": a + 4, "insert": "new 5"}]
    rows = [(i, t, edit(3 * i), "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,insert:string>>, token_tree string")
    trees = token_counts.build_trees(df, PATH)
    once = token_counts.apply_edits(trees, PATH)
    twice = token_counts.apply_edits(once.drop("edits").withColumn("edits", token_counts.sample_edits(F.col("doc_id"), F.col("text"))), PATH)
    whole = tokenizers.Tokenizer.from_file(PATH)
    count = lambda t: len(whole.encode(t or "", add_special_tokens=False).ids)
    first = {r.doc_id: r for r in once.collect()}
    for i, t in enumerate(texts):
        want = (t or "")[: 3 * i] + "new 5" + (t or "")[3 * i + 4 :]
        r = first[i]
        assert (r.text, r.n_tokens, r.n_tokens_edited) == (want, count(t), count(want))
        assert sum(r.token_tree.chars) == len(want) and sum(r.token_tree.tokens) == count(want) and r.recoded_chars <= 4 * token_counts.LEAF
    for r in twice.collect():
        assert r.n_tokens == first[r.doc_id].n_tokens_edited and r.n_tokens_edited == count(r.text) and r.recoded_chars <= 12 * token_counts.LEAF
