"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words (runs of letters and digits, lower case) are hashed into buckets, each with an embedding. Filters of several widths
slide over the whole text; each filter's largest response (max pooling) goes to a logistic output. As the convolution is
linear, scoring precomputes every known bucket's response to every filter column and only adds and pools table rows.

Every labelled document outside the held-out fold is learnt from. A fifth of them is kept from training to calibrate: the
logit is shifted so that 0.5 is the best cut over all languages, and each language with MIN_POSITIVES documents of label 1
in that fifth, and some of label 0, gets a cut of its own for the rejection decision; the others take the cut over all. The
score sees nothing but the text. Words that no labelled document holds share buckets with those that one does, by the hash;
buckets of fewer than MIN_DOCS documents have no weight.

Where all labelled documents fit the driver (at most ``per_label`` of each label, their whole texts within ``chars``
characters a label), they are learnt from there. Otherwise those with the smallest hashed ids that fit give the filters to
start from (a text that does not fit is passed over, texts after it may), and Spark goes on with all documents (``refine``):
they are encoded once and dealt by id into shards; buckets and their log odds are counted over all of them; in each of ROUNDS
rounds every shard descends from the same weights, and the changes are averaged over the shards that made any; the cuts are
chosen from counts of all logits of the fifth in steps of 1 / GRID. The weights (2^20 buckets at most) and those counts are
all that comes to the driver.

Ids labelled both ways teach nothing; of rows that share an id, one text is learnt from. Null and empty texts score as
texts without words. Null ids are not held out; null languages take the cut over all. If the documents lack one of the
labels, every score is the share of label 1 among them (0.0 if there is no label at all). Repeated
rows score alike. Texts of any length are scored whole. Columns named as the results are replaced, others kept.
"""

from __future__ import annotations

import copy
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from placeweave.llm.common import aside, joined_small, lean, saved, slices

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 20, 8, 8, (1, 2, 3)
MIN_DOCS, MIN_POSITIVES = 3, 10
PADS = max(WIDTHS) - 1
PER_LABEL, EPOCHS, BATCH, RATE = 2500, 6, 32, 0.05
#: Characters of each label that are learnt from on the driver.
CHARS = 1 << 24
#: Words of a shard, passes over all shards, and the steps to a logit's unit by which cuts are told apart.
SHARD, ROUNDS, GRID = 1 << 20, 6, 1024
#: Documents with the labels' overall shares that are added to each bucket's for its log odds in ``refine``.
PRIOR = 5
SEED = 7
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the fold whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' words as buckets, each text followed by PADS paddings (-1), and where each text starts."""
    clean = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), r"[^\pL\pN]+", " ")
    words = pc.split_pattern(pc.ascii_trim_whitespace(clean), " ")
    flat = words.flatten().dictionary_encode()
    hashed = np.array([zlib.crc32(w.encode()) % BUCKETS if w else -1 for w in flat.dictionary.to_pylist()], np.int32)
    ends = words.offsets.to_numpy().astype(np.int64)
    ends = ends - ends[0]
    lengths = np.diff(ends)
    starts = ends[:-1] + PADS * np.arange(len(lengths))
    out = np.full(int(ends[-1]) + PADS * len(lengths), -1, np.int32)
    if len(hashed):
        out[np.arange(int(ends[-1])) + np.repeat(PADS * np.arange(len(lengths)), lengths)] = hashed[flat.indices.to_numpy()]
    return out, starts


@dataclass
class Model:
    """Weights. ``words`` has a row for each bucket in the sorted ``known``, then one of zeros for all others."""

    known: np.ndarray
    words: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: float = 0.0
    prior: float | None = None
    cuts: dict[str, float] = field(default_factory=dict)
    cut: float = 0.5

    def weights(self) -> list[np.ndarray]:
        return [self.words, *self.filters, *self.bias, self.out]

    def tables(self) -> list[list[np.ndarray]]:
        """For each width and place in the filter, every row's responses."""
        return [[self.words @ w[j] for j in range(len(w))] for w in self.filters]

    def rows(self, seq: np.ndarray) -> np.ndarray:
        """Buckets (or paddings) as rows of ``words``."""
        found = np.full(BUCKETS + 1, len(self.known), np.int32)  # paddings (-1) read the last
        found[self.known] = np.arange(len(self.known), dtype=np.int32)
        return found[seq]

    def logits(self, texts: pa.Array, tables: list[list[np.ndarray]]) -> np.ndarray:
        return self.encoded_logits(*word_buckets(texts), tables)

    def encoded_logits(self, seq: np.ndarray, starts: np.ndarray, tables: list[list[np.ndarray]]) -> np.ndarray:
        if not len(starts):
            return np.empty(0, np.float32)
        rows, pad, n = self.rows(seq), seq < 0, len(seq)
        pooled = []
        for table, bias in zip(tables, self.bias, strict=True):
            response = table[0][rows]
            for j in range(1, len(table)):
                response[: n - j] += table[j][rows[j:]]
            response[pad] = -1e9
            pooled.append(np.maximum(np.maximum.reduceat(response, starts, axis=0) + bias, 0))
        return np.concatenate(pooled, axis=1) @ self.out[:-1] + self.out[-1]

    def score(self, texts: pa.Array, tables: list[list[np.ndarray]]) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(texts), self.prior)
        return 1 / (1 + np.exp(-(self.logits(texts, tables).astype(np.float64) - self.shift)))


def _vocabulary(docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of MIN_DOCS sample documents or more, and how much likelier label 1 is with each (log odds of documents)."""
    once = [np.unique(d[d >= 0]) for d in docs]
    pos = [d for d, y in zip(once, labels, strict=True) if y]
    all_ids, all_n = np.unique(np.concatenate(once), return_counts=True)
    pos_ids, pos_n = np.unique(np.concatenate(pos), return_counts=True)
    known = all_ids[all_n >= MIN_DOCS]
    total, hits = all_n[all_n >= MIN_DOCS], np.zeros(len(known))
    hits[np.isin(known, pos_ids)] = pos_n[np.isin(pos_ids, known)]
    odds = np.log((hits + 0.5) / (total - hits + 0.5)) - np.log(len(pos) / (len(docs) - len(pos)))
    return known, odds.astype(np.float32)


def _network(known: np.ndarray, odds: np.ndarray, rng: np.random.Generator) -> Model:
    """A network to start from: embeddings are small noise and, in their first dimension, the bucket's log odds."""
    words = np.zeros((len(known) + 1, DIM), np.float32)
    words[:-1] = 0.05 * rng.standard_normal((len(known), DIM))
    words[:-1, 0] += 0.2 * odds
    filters = [(0.3 * rng.standard_normal((w, DIM, FILTERS)) / w).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0] = np.abs(f[:, 0]) + 0.5 / len(f)
    return Model(known, words, filters, [np.full(FILTERS, 0.1, np.float32) for _ in WIDTHS], np.full(FILTERS * len(WIDTHS) + 1, 0.1, np.float32))


def _placed(model: Model, buckets: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Documents as rows of ``words``, and where their paddings are."""
    ends = np.cumsum([len(b) for b in buckets])[:-1]
    return np.split(model.rows(np.concatenate(buckets)), ends), [b < 0 for b in buckets]


def _descend(model: Model, squares: list[np.ndarray], placed: tuple[list[np.ndarray], list[np.ndarray]], labels: np.ndarray, weight: np.ndarray, order: np.ndarray, rng: np.random.Generator) -> None:
    """One pass of Adagrad over documents in the given order, which changes the model and ``squares``, its sums, in place."""
    words, rare, (docs, pads) = model.words, len(model.known), placed

    def step(x: np.ndarray, grad: np.ndarray, square: np.ndarray) -> None:
        square += grad * grad
        x -= RATE * grad / np.sqrt(square)

    for at in range(0, len(order), BATCH):
        rows = order[at : at + BATCH]
        seq, pad = np.concatenate([docs[i] for i in rows]), np.concatenate([pads[i] for i in rows])
        starts = np.cumsum([0, *(len(docs[i]) for i in rows)])[:-1]
        lengths = np.diff(np.append(starts, len(seq)))
        kept = np.where(rng.random(len(seq)) < 0.1, rare, seq)  # so that no single word decides
        x = words[kept]
        pooled, places = [], []
        for w, b in zip(model.filters, model.bias, strict=True):
            z = x @ w[0]
            for j in range(1, len(w)):
                z[: len(z) - j] += x[j:] @ w[j]
            z[pad] = -1e9
            top = np.maximum.reduceat(z, starts, axis=0)
            hit, col = np.nonzero(z == np.repeat(top, lengths, axis=0))
            place = np.zeros((len(rows), FILTERS), np.int64)
            place[np.repeat(np.arange(len(rows)), lengths)[hit[::-1]], col[::-1]] = hit[::-1]  # the first of equal places
            pooled.append(top + b)
            places.append(np.minimum(place, len(seq) - len(w)))
        act = np.maximum(np.concatenate(pooled, axis=1), 0)
        p = 1 / (1 + np.exp(-np.clip(act @ model.out[:-1] + model.out[-1], -30, 30)))
        err = (p - labels[rows]) * weight[rows] / len(rows)
        back = (np.outer(err, model.out[:-1]) * (act > 0)).astype(np.float32)
        at_w, grad_w = [], []
        for k, (w, place) in enumerate(zip(model.filters, places, strict=True)):
            g = back[:, k * FILTERS : (k + 1) * FILTERS]
            grad = np.empty_like(w)
            for j in range(len(w)):
                grad[j] = np.einsum("rfd,rf->df", x[place + j], g)
                at_w.append(kept[place + j].ravel())
                grad_w.append((g[:, :, None] * w[j].T[None]).reshape(-1, DIM))
            step(model.bias[k], g.sum(0), squares[1 + len(WIDTHS) + k])
            step(w, grad, squares[1 + k])
        step(model.out, np.append(act.T @ err, err.sum()).astype(np.float32), squares[-1])
        ids, inverse = np.unique(np.concatenate(at_w), return_inverse=True)
        total = np.zeros((len(ids), DIM), np.float32)
        np.add.at(total, inverse, np.concatenate(grad_w))
        squares[0][ids] += total * total
        words[ids] -= RATE * total / np.sqrt(squares[0][ids])
        words[rare] = 0


def _weights(labels: np.ndarray, share: float) -> np.ndarray:
    """Each document's weight, with which both labels count alike; ``share`` is that of label 1."""
    return np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)


def train(texts: list[str], labels: np.ndarray, langs: list[str | None], seed: int = SEED) -> Model:
    """Fits the network by Adagrad on four fifths of the rows and the cuts on the rest. Buckets too rare to learn from have no
    weight, so that no filter learns single documents by heart."""
    labels = np.asarray(labels, np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(np.empty(0, np.int32), np.zeros((1, DIM), np.float32), [], [], np.zeros(1), prior=float(labels.mean()) if len(labels) else 0.0)
    rng = np.random.default_rng(seed)
    folds = np.arange(len(texts)) % 5
    fit = np.flatnonzero(folds > 0)
    if labels[fit].min() == labels[fit].max():  # a handful of rows
        fit = np.arange(len(texts))
    buckets = [word_buckets(pa.array([t], pa.string()))[0] for t in texts]
    known, odds = _vocabulary([buckets[i] for i in fit], labels[fit])
    model = _network(known, odds, rng)
    weight = _weights(labels, labels[fit].mean())
    squares, placed = [np.full_like(x, 1e-2) for x in model.weights()], _placed(model, buckets)
    for _ in range(EPOCHS):
        rng.shuffle(fit)
        _descend(model, squares, placed, labels, weight, fit, rng)
    own = np.flatnonzero(folds == 0)
    _calibrate(model, [texts[i] for i in own], labels[own], [langs[i] for i in own])
    return model


def best_cut(scores: np.ndarray, labels: np.ndarray) -> float | None:
    """The cut with the highest F1, in the middle of the widest gap among equals; None without both labels."""
    order = np.argsort(scores)
    s, y = scores[order], labels[order]
    return _best_cut(s, s, y, np.ones(len(y)))


def _best_cut(low: np.ndarray, high: np.ndarray, hits: np.ndarray, all_: np.ndarray) -> float | None:
    """``best_cut`` of documents counted by score: in ascending order, ``all_`` of them score from low to high, ``hits`` of these have label 1."""
    if not len(all_) or not 0 < hits.sum() < all_.sum():
        return None
    right = hits.sum() - np.concatenate([[0], np.cumsum(hits)])
    above = all_.sum() - np.concatenate([[0], np.cumsum(all_)])
    f1 = 2 * right / (right + above + (hits.sum() - right) + 1e-9)
    gap = np.concatenate([[0], low[1:] - high[:-1], [0]])
    gap[f1 < f1.max() - 1e-12] = -1
    at = int(gap.argmax())
    return float((high[at - 1] + low[at]) / 2) if 0 < at < len(low) else float(low[0] if at == 0 else high[-1])


def _calibrate(model: Model, texts: list[str], labels: np.ndarray, langs: list[str | None]) -> None:
    logits = model.logits(pa.array(texts, pa.string()), model.tables()).astype(np.float64)
    model.shift = best_cut(logits, labels) or 0.0
    scores = 1 / (1 + np.exp(-(logits - model.shift)))
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if labels[own].sum() >= MIN_POSITIVES and (cut := best_cut(scores[own], labels[own])) is not None:
            model.cuts[lang] = cut


def _encoded(docs: DataFrame, usable: DataFrame) -> DataFrame:
    """A row for each id of ``usable`` that has a document: its words as buckets with the paddings, and whether it calibrates."""
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").alias("doc__"), F.coalesce("text", F.lit("")).alias("text__"), lang.alias("lang__"))
    rows = joined_small(rows, usable, F.expr("doc__ = id__"), "inner").select("doc__", "lang__", "toxic__", F.xxhash64("text__", "lang__").alias("h__"), F.monotonically_increasing_id().alias("row__"), "text__")
    names = rows.columns[:-1]
    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names] + ["words__ long", "seq__ binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1 << 20):
            seq, starts = word_buckets(batch.column(len(names)))
            ends = np.append(starts, len(seq))
            coded = pa.array([seq[x:y].tobytes() for x, y in zip(ends, ends[1:], strict=False)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(ends), pa.int64()), coded], names=[*names, "words__", "seq__"])

    rows = saved(rows.mapInArrow(run, schema), "encoded")
    many = rows.groupBy(F.col("doc__").alias("many__")).agg(F.count("*").alias("n__"), F.min(F.struct("h__", "row__")).alias("f")).where("n__ > 1").select("many__", F.col("f.row__").alias("first__"))
    rows = joined_small(rows, many, F.expr("doc__ = many__")).where("first__ is null or first__ = row__")
    return rows.select("doc__", "lang__", "toxic__", (F.pmod(F.xxhash64("doc__", F.lit("own")), F.lit(5)) == 0).alias("own__"), "words__", "seq__")


def _sharded(rows: DataFrame, shards: int) -> DataFrame:
    """The documents of ``_encoded``, dealt by id into shards of a row each."""

    def pack(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc__")
        column = lambda c, kind: group[c].to_numpy().astype(kind).tobytes()
        row = {"shard": group["shard__"][0].as_py(), "seq": b"".join(group["seq__"].to_pylist()), "lengths": column("words__", np.int64)}
        return pa.Table.from_pylist([row | {"toxic": column("toxic__", np.int8), "own": column("own__", np.int8), "langs": group["lang__"].to_pylist()}], schema)

    fields = [("shard", pa.int64()), ("seq", pa.binary()), ("lengths", pa.binary()), ("toxic", pa.binary()), ("own", pa.binary()), ("langs", pa.list_(pa.string()))]
    schema = pa.schema(fields)
    dealt = rows.withColumn("shard__", F.pmod(F.xxhash64("doc__"), F.lit(shards))).repartition(math.ceil(shards / 2), "shard__")
    made = dealt.groupBy("shard__").applyInArrow(pack, "shard long, seq binary, lengths binary, toxic binary, own binary, langs array<string>")
    return saved(made, "shards")


@dataclass
class Shard:
    number: int
    docs: list[np.ndarray]
    labels: np.ndarray
    own: np.ndarray
    langs: list[str | None]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    for batch in slices(batches, 1 << 20):
        for r in batch.to_pylist():
            docs = np.split(np.frombuffer(r["seq"], np.int32), np.cumsum(np.frombuffer(r["lengths"], np.int64))[:-1])
            yield Shard(r["shard"], docs, np.frombuffer(r["toxic"], np.int8), np.frombuffer(r["own"], np.int8) > 0, r["langs"])


def _matrix(arrays: list[np.ndarray]) -> np.ndarray:
    """Weights (or their squares) as rows of DIM numbers: those of the words first."""
    rest = np.concatenate([x.ravel() for x in arrays[1:]])
    return np.concatenate([arrays[0], np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)])


def _add(arrays: list[np.ndarray], at: np.ndarray, change: np.ndarray) -> None:
    """Adds to rows of ``_matrix``, in place."""
    total = _matrix(arrays)
    total[at] += change
    arrays[0][:] = total[: len(arrays[0])]
    rest, done = total[len(arrays[0]) :].ravel(), 0
    for x in arrays[1:]:
        x[...] = rest[done : done + x.size].reshape(x.shape)
        done += x.size


def _counted(shards: DataFrame, every: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of MIN_DOCS documents or more of all that are learnt from, with how many hold them and how many of those have label 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in _shards(batches):
            use = np.flatnonzero(~s.own | every)
            if not len(use):
                continue
            seq, doc = np.concatenate([s.docs[i] for i in use]), np.repeat(use, [len(s.docs[i]) for i in use])
            pairs = np.unique(doc[seq >= 0] * BUCKETS + seq[seq >= 0])  # once a document
            found, at, total = np.unique(pairs % BUCKETS, return_inverse=True, return_counts=True)
            hits = np.bincount(at, s.labels[pairs // BUCKETS], len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(total.astype(np.int64)), pa.array(hits)], names=["bucket", "n", "hits"])

    got = shards.mapInArrow(run, "bucket int, n long, hits long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).where(F.col("n") >= MIN_DOCS).toArrow().sort_by("bucket")
    return tuple(got[c].to_numpy() for c in ("bucket", "n", "hits"))


def _round(shards: DataFrame, model: Model, squares: list[np.ndarray], every: bool, share: float, number: int) -> None:
    """A pass over all shards, each from the weights as they are; the changes are averaged over the shards that made any.

    They are added up as multiples of 2^-30, so that the order of the sums changes nothing."""
    columns = [f"{c}{i}" for c in "wq" for i in range(DIM)]
    sent = shards.sparkSession.sparkContext.broadcast((model, squares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, start_squares = sent.value
        before = np.concatenate([_matrix(start.weights()), _matrix(start_squares)], axis=1)
        for s in _shards(batches):
            order = np.flatnonzero(~s.own | every)
            if not len(order):
                continue
            own, own_squares = copy.deepcopy((start, start_squares))
            rng = np.random.default_rng([SEED, number, s.number])
            rng.shuffle(order)
            _descend(own, own_squares, _placed(own, s.docs), s.labels, _weights(s.labels, share), order, rng)
            change = np.concatenate([_matrix(own.weights()), _matrix(own_squares)], axis=1) - before
            at = np.flatnonzero(change.any(axis=1))
            exact = np.rint(change[at].astype(np.float64) * 2**30).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(c) for c in exact.T.copy())], names=["at", *columns])

    made = shards.mapInArrow(run, "at int, " + ", ".join(f"{c} long" for c in columns))
    mean = made.groupBy("at").agg(*(F.expr(f"cast(sum({c}) / count(1) / {2**30} as float)").alias(c) for c in columns)).toArrow()
    at = mean["at"].to_numpy()
    for arrays, own in ((model.weights(), columns[:DIM]), (squares, columns[DIM:])):
        _add(arrays, at, np.stack([mean[c].to_numpy() for c in own], axis=1))
    sent.destroy()


def _choose_cuts(shards: DataFrame, model: Model) -> None:
    """The cuts from all documents that calibrate, counted by their logit in steps of 1 / GRID."""
    sent = shards.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = sent.value.tables()
        for s in _shards(batches):
            use = np.flatnonzero(s.own)
            lengths = np.array([len(s.docs[i]) for i in use], np.int64)
            logits = sent.value.encoded_logits(np.concatenate([s.docs[i] for i in use]), np.cumsum(lengths) - lengths, tables) if len(use) else np.empty(0)
            step = np.floor(np.clip(logits.astype(np.float64), -64, 64) * GRID).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array([s.langs[i] for i in use], pa.string()), pa.array(step), pa.array(s.labels[use].astype(np.int32))], names=["lang", "step", "toxic"])

    def cut(steps: pa.Table) -> float | None:
        steps = steps.sort_by("step")
        low = steps["step"].to_numpy() / GRID
        return _best_cut(low, low + 1 / GRID, steps["hits"].to_numpy(), steps["n"].to_numpy())

    def of_lang(steps: pa.Table) -> pa.Table:
        return pa.table({"lang": steps["lang"][:1], "cut": pa.array([cut(steps)], pa.float64())})

    added = (F.sum("n").alias("n"), F.sum("hits").alias("hits"))
    steps = saved(shards.mapInArrow(run, "lang string, step int, toxic int").groupBy("lang", "step").agg(F.count("*").alias("n"), F.sum("toxic").alias("hits")), "logits")
    model.shift = cut(steps.groupBy("step").agg(*added).toArrow()) or 0.0
    enough = steps.where("lang is not null").groupBy("lang").agg(*added).where(F.col("hits") >= MIN_POSITIVES).select("lang")
    found = joined_small(steps, enough, "lang", "inner").groupBy("lang").applyInArrow(of_lang, "lang string, cut double").where("cut is not null").collect()
    model.cuts = {r["lang"]: 1 / (1 + math.exp(model.shift - r["cut"])) for r in sorted(found)}
    sent.destroy()


def refine(docs: DataFrame, usable: DataFrame, start: Model | None, shard: int = SHARD) -> Model:
    """Trains on all documents whose id is in ``usable`` (id__, toxic__), with the filters of ``start``, if it has any, to begin with."""
    lean(docs.sparkSession)
    rows = _encoded(docs, usable)
    parts: list[Row] = rows.groupBy("toxic__", "own__").agg(F.count("*").alias("n"), F.sum("words__").alias("words")).collect()  # four at most
    by_label = lambda every: [sum(r["n"] for r in parts if r["toxic__"] == y and (every or not r["own__"])) for y in (0, 1)]
    clean, toxic = by_label(True)
    if not clean or not toxic:
        return Model(np.empty(0, np.int32), np.zeros((1, DIM), np.float32), [], [], np.zeros(1), prior=toxic / max(clean + toxic, 1))
    every = not all(by_label(False))  # a handful of rows
    clean, toxic = by_label(every)
    shards = _sharded(rows, math.ceil(sum(r["words"] for r in parts) / shard))
    known, n, hits = _counted(shards, every)
    share = toxic / (clean + toxic)
    odds = np.log((hits + PRIOR * share) / (n - hits + PRIOR * (1 - share))) - np.log(toxic / clean)
    model = _network(known, odds.astype(np.float32), np.random.default_rng(SEED))
    if start is not None and start.filters:
        model.filters, model.bias, model.out = copy.deepcopy((start.filters, start.bias, start.out))
    squares = [np.full_like(x, 1e-2) for x in model.weights()]
    for number in range(ROUNDS):
        _round(shards, model, squares, every, share, number)
    _choose_cuts(shards, model)
    return model


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, chars: int = CHARS) -> Model:
    """Trains on all labelled, not held-out documents: on the driver, as long as they are at most ``per_label`` of each label
    and their texts fit ``chars`` characters a label; otherwise by ``refine``, and those that fit only give it a start."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("id__")).agg(F.min("toxic").alias("toxic__"), F.max("toxic").alias("most__"))
    usable = saved(usable.where("toxic__ = most__ and toxic__ in (0, 1)").select("id__", F.col("toxic__").cast("int").alias("toxic__")), "usable")
    ids = None
    for label in (0, 1):
        part = usable.where(F.col("toxic__") == label).select("id__", "toxic__").orderBy(F.xxhash64("id__"), "id__").limit(per_label)
        ids = part if ids is None else ids.unionByName(part)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").alias("doc__"), text.alias("text"), lang.alias("lang")).join(F.broadcast(ids), F.expr("doc__ = id__"))
    rows = saved(rows.select("doc__", "text", "lang", "toxic__", F.xxhash64("text", "lang").alias("h__")), "labelled")
    heads = rows.groupBy("doc__", "toxic__").agg(F.min(F.struct("h__", F.length("text").alias("n__"))).alias("f")).select("doc__", "toxic__", "f.*").collect()  # 2 * per_label at most
    left, chosen = {0: chars, 1: chars}, []
    for r in sorted(heads, key=lambda r: (zlib.crc32(str(r["doc__"]).encode()), r["doc__"])):
        if r["n__"] <= left[r["toxic__"]]:
            left[r["toxic__"]] -= r["n__"]
            chosen.append((r["doc__"], r["h__"]))
    whole = len(chosen) == len(heads) and not any(r["count"] > per_label for r in usable.groupBy("toxic__").count().collect())
    if not chosen:
        return train([], np.empty(0), []) if whole else refine(docs, usable, None)
    wanted = docs.sparkSession.createDataFrame(chosen, rows.select("doc__", "h__").schema)
    sample = rows.join(F.broadcast(wanted), ["doc__", "h__"]).dropDuplicates(["doc__"])
    found = sorted(sample.select("doc__", "text", "lang", "toxic__").toArrow().to_pylist(), key=lambda r: (zlib.crc32(str(r["doc__"]).encode()), r["doc__"]))
    start = train([r["text"] for r in found], np.array([r["toxic__"] for r in found]), [r["lang"] for r in found])
    return start if whole else refine(docs, usable, start)


ADDED = (("score", "double"), ("predicted", "int"), ("threshold", "double"), ("rejected", "boolean"))


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """Adds score, predicted (score >= 0.5), the language's threshold and rejected (score >= threshold)."""
    docs = docs.drop(*(c for c, _ in ADDED))
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields] + ["score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = model.tables()
        for batch in slices(batches, 1 << 20):
            score = model.score(batch.column(names.index("text")), tables)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, "score"])

    cut = F.lit(model.cut)
    for lang, own in model.cuts.items() if "lang" in names else ():
        cut = F.when(F.col("lang") == lang, F.lit(own)).otherwise(cut)
    scored = docs.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumn("threshold", cut)
    return scored.withColumn("rejected", F.col("score") >= F.col("threshold"))


def without_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents whose score stays below their language's threshold, with their columns as they are."""
    own = aside(docs, (c for c, _ in ADDED))
    return score_toxicity(own, model).where(~F.coalesce("rejected", F.lit(False))).select(*own.columns).toDF(*docs.columns)
