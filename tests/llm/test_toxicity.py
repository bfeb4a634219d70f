import random
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from placeweave.llm import toxicity

BAD = ["vilest", "grubby", "rotten", "foul"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    common = [word() for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = [rng.choice(common) if rng.random() < 0.8 else word() for _ in range(rng.randrange(5, 80))]
        if i % 4 == 0:
            for _ in range(rng.randrange(1, 4)):
                w[rng.randrange(len(w))] = rng.choice(BAD).upper() + rng.choice(["", ",", "!"])
        texts.append(" ".join(w))
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


def test_held_out_accuracy():
    texts, labels = corpus(900)
    model = toxicity.train(texts[:600], labels[:600], ["en"] * 600)
    score = model.score(pa.array(texts[600:]), model.tables())
    assert ((score >= 0.5) == labels[600:]).mean() > 0.97
    assert model.cuts["en"] > 0 and (score >= 0).all() and (score <= 1).all()
    whole = model.score(pa.array(["clean " * 20_000 + "rotten"]), model.tables())
    assert whole[0] > 0.5  # the last word of a long text counts


def test_best_cut():
    assert toxicity.best_cut(np.array([0.1, 0.2, 0.8, 0.9]), np.array([0, 0, 1, 1])) == 0.5
    assert toxicity.best_cut(np.array([0.1, 0.2]), np.array([1, 1])) is None


def test_frame(spark):
    texts, labels = corpus(500, 2)
    rows = [(i, t, "en" if i % 3 else None, "x") for i, t in enumerate(texts)] + [(None, None, None, None), (1000, "", "en", None), (0, texts[0], "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    marks = spark.createDataFrame([(i, int(1 - y) if i in held else int(y)) for i, y in enumerate(labels)] + [(None, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)  # labels of held-out rows are wrong here: nothing may be learnt from them
    got = toxicity.score_toxicity(docs, model).collect()
    assert len(got) == len(rows)
    right = [r.predicted == labels[r.doc_id] for r in got if r.doc_id is not None and r.doc_id < 500]
    assert np.mean(right) > 0.95
    empty = [r.score for r in got if not r.text]
    assert len(empty) == 2 and empty[0] == empty[1] and all(r.predicted == (r.score >= 0.5) for r in got)
    none = toxicity.fit(docs, marks.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, none).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0
    held_rows = docs.select("doc_id", toxicity.held_out(docs.doc_id).alias("h")).distinct().collect()
    assert {r.doc_id for r in held_rows if r.h} == {*held, *([1000] if zlib.crc32(b"1000") % 5 == 0 else [])}


def plain_score(model, text):
    """The network by loops: embeddings, filters at every place, the largest response, the logistic output."""
    import math
    import re

    table = {int(b): w for b, w in zip(model.known, model.words, strict=False)}
    none = np.zeros(toxicity.DIM)
    words = [table.get(zlib.crc32(w.encode()) % toxicity.BUCKETS, none) for w in re.findall(r"[^\W_]+", text.lower())] + [none] * toxicity.PADS
    act = []
    for w, bias in zip(model.filters, model.bias, strict=True):
        for f in range(w.shape[2]):
            tops = [sum(float(words[i + j] @ w[j, :, f]) for j in range(len(w)) if i + j < len(words)) for i in range(len(words) - toxicity.PADS)]
            act.append(max(max(tops, default=-1e9) + float(bias[f]), 0.0))
    z = float(np.dot(act, model.out[:-1])) + float(model.out[-1]) - model.shift
    return 1 / (1 + math.exp(-z))


def test_scores_equal_a_plain_convolution():
    texts, labels = corpus(200, 4)
    model = toxicity.train(texts, labels, ["en"] * len(texts))
    asked = [*texts[:40], "", "one", "two words", "ROTTEN, foul!"]
    got = model.score(pa.array(asked), model.tables())
    assert np.allclose(got, [plain_score(model, t) for t in asked], atol=1e-5)


def test_unseen_words_share_buckets():
    texts, labels = corpus(300, 5)
    model = toxicity.train(texts, labels, ["en"] * len(texts))
    word = next(w for i in range(10**7) if zlib.crc32((w := f"n{i}").encode()) % toxicity.BUCKETS == zlib.crc32(b"rotten") % toxicity.BUCKETS)
    a, b = model.score(pa.array(["x " + word, "x rotten"]), model.tables())
    assert a == b


def test_a_language_with_enough_positives_gets_its_cut():
    texts, labels = corpus(800, 6)
    rng = random.Random(1)
    langs = [rng.choice(["en", "de"]) if i % 50 else "fr" for i in range(len(texts))]
    model = toxicity.train(texts, labels, langs)
    own = [i for i in range(len(texts)) if i % 5 == 0]
    for lang in ("en", "de", "fr"):
        enough = sum(labels[i] for i in own if langs[i] == lang) >= toxicity.MIN_POSITIVES
        assert (lang in model.cuts) == enough
    assert {"en", "de"} <= set(model.cuts) and "fr" not in model.cuts


def test_sample_is_bounded(spark, monkeypatch):
    """Repeated ids, contradictory labels and long texts: what comes to the driver stays within its budgets."""
    seen = []
    monkeypatch.setattr(toxicity, "train", lambda texts, labels, langs: seen.append((texts, list(labels))))
    train_ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    rows = [(train_ids[0], f"copy {i}") for i in range(500)] + [(i, "word " * 10) for i in train_ids[1:60]] + [(train_ids[60], "long " * 1000)]
    marks = [(i, k % 2) for k, i in enumerate(train_ids[:61])] + [(train_ids[5], 0), (train_ids[5], 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame(marks, "doc_id long, toxic int")
    toxicity.fit(docs, labels, chars=800)
    texts, found = seen[0]
    assert "long " * 1000 not in texts and sum(t.startswith("copy") for t in texts) <= 1
    assert all(sum(len(t) for t, y in zip(texts, found, strict=True) if y == label) <= 800 for label in (0, 1)) and len(texts) > 25
    toxicity.fit(docs, labels)
    assert sum(t.startswith("copy") for t in seen[1][0]) == 1 and len(seen[1][0]) == 60  # the id that is labelled both ways is left out


def marked(n, seed, words=40):
    """Documents of which every fourth has two of many words that give it away, so that a few documents do not show them all."""
    rng = random.Random(seed)
    texts = []
    for i in range(n):
        w = [f"w{rng.randrange(300)}" for _ in range(rng.randrange(5, 60))]
        if i % 4 == 0:
            for _ in range(2):
                w.insert(rng.randrange(len(w)), f"bad{rng.randrange(words)}")
        texts.append(" ".join(w))
    return texts, [int(i % 4 == 0) for i in range(n)]


def test_documents_beyond_the_sample_are_learnt_from(spark):
    texts, labels = marked(2000, 9)
    docs = spark.createDataFrame([(i, t, "en" if i % 3 else "de") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    marks = spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")
    model = toxicity.fit(docs, marks, per_label=20)
    held = [i for i in range(2000) if zlib.crc32(str(i).encode()) % 5 == 0]
    score = model.score(pa.array([texts[i] for i in held]), model.tables())
    assert np.mean((score >= 0.5) == np.array([labels[i] for i in held])) > 0.97
    long = docs.withColumn("text", F.concat(F.lit("x " * 100), "text"))  # none of these texts fits
    model = toxicity.fit(long, marks, chars=100)
    score = model.score(pa.array([texts[i] for i in held]), model.tables())
    assert np.mean((score >= 0.5) == np.array([labels[i] for i in held])) > 0.97


def test_counts_and_cuts_of_many_shards(spark):
    texts, labels = marked(1500, 11)
    rows = [(i, t, ["en", "de", None][i % 3]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, *rows[:50], (3, "another text of an id", "en"), (5000, "not labelled", "en")], "doc_id long, text string, lang string")
    usable = spark.createDataFrame([*enumerate(labels), (7000, 1)], "id__ long, toxic__ int")
    model = toxicity.refine(docs, usable, None, shard=5000)
    again = toxicity.refine(docs.repartition(7), usable, None, shard=5000)
    assert all((a == b).all() for a, b in zip(model.weights(), again.weights(), strict=True)) and (model.shift, model.cuts) == (again.shift, again.cuts)
    coded = toxicity._encoded(docs, usable)
    own = {r.doc__: r.own__ for r in coded.collect()}
    assert coded.count() == 1500 == len(own)
    seqs = {r.doc__: np.frombuffer(r.seq__, np.int32) for r in coded.collect()}
    assert sum((seqs[i] == toxicity.word_buckets(pa.array([t]))[0]).all() for i, t in enumerate(texts) if i != 3) == 1499
    known, _ = toxicity._vocabulary([s for i, s in seqs.items() if not own[i]], np.array([labels[i] for i in seqs if not own[i]]))
    assert (model.known == known).all()

    ids = np.array([i for i in range(1500) if own[i] and i != 3])
    y, logits = np.array(labels)[ids], model.logits(pa.array([texts[i] for i in ids]), model.tables())

    def f1(z, y, cut):
        return 2 * y[z >= cut].sum() / ((z >= cut).sum() + y.sum())

    assert abs(f1(logits, y, model.shift) - max(f1(logits, y, c) for c in logits)) < 0.01
    assert set(model.cuts) == {"en", "de"}
    for r, lang in enumerate(("en", "de")):
        z, cut = logits[ids % 3 == r] - model.shift, np.log(model.cuts[lang] / (1 - model.cuts[lang]))
        assert abs(f1(z, y[ids % 3 == r], cut) - max(f1(z, y[ids % 3 == r], c) for c in z)) < 0.02
    one = toxicity.refine(docs, usable.where("toxic__ = 1"), None)
    assert one.prior == 1.0 and toxicity.refine(docs, usable.limit(0), None).prior == 0.0
