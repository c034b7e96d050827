"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model sees the earlier
categories' probabilities. In training those are out-of-fold, so that a later
model learns from probabilities as uncertain as the ones it will get. Features
are the presence of hashed words and word beginnings; those most associated with
the labels are kept, and each model is fitted by Newton steps. Training takes a
bounded sample of labelled rows; scoring is one pass over all texts. Categories are
any columns of the labels; where there is one only, kinds of it are found by
clustering its rows, and the chain predicts the kinds first.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BASE_INV, _BYTE_LOWER, _power, map_arrow, mix64, text_chunks, words
from .graph import without_texts

BITS = 18
BEGINNINGS = (4, 5, 6)


def hashed_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, with repeats: each word and its first 4, 5 and 6 bytes where it is longer."""
    starts, ends, first = words(data, offsets)
    n = len(data)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_LOWER[data] * _power(_BASE, n), out=prefix[1:])
    inverse = _power(_BASE_INV, n + 1)[starts]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    # trailing ASCII punctuation is no part of the word
    punct = _PUNCT[data] if n else np.zeros(0, bool)
    stop = ends.copy()
    for _ in range(3):
        cut = (stop - starts > 1) & punct[np.maximum(stop - 1, 0)]
        stop[cut] -= 1
    texts, features = [text], [(prefix[stop] - prefix[starts]) * inverse]
    for k in BEGINNINGS:
        long = np.flatnonzero(stop - starts > k)
        texts.append(text[long])
        features.append((prefix[starts[long] + k] - prefix[starts[long]]) * inverse[long] + np.uint64(k))
    return np.concatenate(texts), (mix64(np.concatenate(features)) >> np.uint64(64 - BITS)).astype(np.int64)


_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in ".,;:!?\"')"]] = True


@dataclass
class Chain:
    """weights: by category and feature; links: by category, for the categories before it; bias: by category."""

    categories: list[str]
    weights: np.ndarray
    links: np.ndarray
    bias: np.ndarray

    def probabilities(self, text: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        used = self.weights.any(0)[feature]
        pairs = np.unique(text[used] << BITS | feature[used])
        rows, cols = pairs >> BITS, pairs & (1 << BITS) - 1
        out = np.zeros((len(self.categories), n))
        for k in range(len(self.categories)):
            out[k] = _sigmoid(self.bias[k] + np.bincount(rows, self.weights[k, cols], n) + self.links[k, :k] @ out[:k])
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit_linear(rows: np.ndarray, cols: np.ndarray, vals: np.ndarray, n: int, d: int, y: np.ndarray, ridge: float, steps: int = 8) -> np.ndarray:
    """Ridge logistic weights (the last is the bias) by Newton steps with conjugate gradients."""
    w = np.zeros(d + 1)
    penalty = np.append(np.full(d, ridge), 1e-3)
    forward = lambda v: np.bincount(rows, vals * v[cols], n) + v[-1]
    back = lambda r: np.append(np.bincount(cols, vals * r[rows], d), r.sum())
    for _ in range(steps):
        p = _sigmoid(forward(w))
        gradient = back(p - y) + penalty * w
        curve = p * (1 - p)
        step, r = np.zeros(d + 1), -gradient
        direction, size = r.copy(), r @ r
        for _ in range(25):
            if size < 1e-8:
                break
            hd = back(curve * forward(direction)) + penalty * direction
            a = size / (direction @ hd)
            step += a * direction
            r -= a * hd
            new = r @ r
            direction, size = r + new / size * direction, new
        w += step * min(1.0, 5 / max(1e-9, np.abs(step).max()))
    return w


def association(rows: np.ndarray, cols: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Signed root of chi-square of each feature's presence against the label; 0 for features of one row."""
    seen, both, rate = np.bincount(cols, minlength=1 << BITS), np.bincount(cols, y[rows], 1 << BITS), y.mean()
    expected = seen * rate
    return np.where(seen < 2, 0.0, (both - expected) / np.sqrt(np.maximum(expected * (1 - rate), 1e-9)))


def found_kinds(features: Sequence[np.ndarray], y: np.ndarray, kinds: int, marks: int = 512, rounds: int = 10) -> np.ndarray:
    """rows x kinds of 0 and 1: the rows labelled ``y``, clustered by those of their features that mark the label most.

    Spherical k-means from the row of most marks and then the rows least like those
    before, so the result depends on the rows alone. A labelled row without any mark
    is of no kind.
    """
    out = np.zeros((len(features), kinds))
    mine = np.flatnonzero(y)
    if not len(mine) or not kinds:
        return out
    rows, cols = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.concatenate(features).astype(np.int64)
    bond = association(rows, cols, y)
    best = np.argsort(-bond, kind="stable")[:marks]
    best = np.sort(best[bond[best] > 0])
    x = np.zeros((len(mine), len(best)))
    for i, r in enumerate(mine):
        at = np.searchsorted(best, features[r])
        inside = at < len(best)
        hit = at[inside][best[at[inside]] == features[r][inside]]
        x[i, hit] = 1.0
    norm = np.sqrt(x.sum(1))
    x /= np.maximum(norm, 1)[:, None]
    centres = [x[int(np.argmax(norm))]]
    while len(centres) < kinds:
        centres.append(x[int(np.argmin(np.where(norm > 0, np.max(x @ np.array(centres).T, axis=1), 2.0)))])
    centre = np.array(centres)
    for _ in range(rounds):
        own = np.argmax(x @ centre.T, axis=1)
        sums = np.array([x[own == k].sum(0) for k in range(kinds)])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centre = np.where(size > 0, sums / np.maximum(size, 1e-12), centre)
    marked = norm > 0
    out[mine[marked], own[marked]] = 1.0
    return out


def train_chain(features: Sequence[np.ndarray], labels: np.ndarray, categories: Sequence[str], kept: int = 2048, folds: int = 5, ridge: float = 1.0) -> Chain:
    """features: distinct hashed features of each row; labels: rows x categories of 0 and 1.

    A category with one class only, or no rows at all, gets its smoothed rate as a
    constant (0 for no rows).
    """
    n, k_all = len(features), len(categories)
    chain = Chain(list(categories), np.zeros((k_all, 1 << BITS)), np.zeros((k_all, k_all)), np.full(k_all, -40.0))
    if not n:
        return chain
    rows = np.repeat(np.arange(n), [len(f) for f in features])
    cols = np.concatenate(features).astype(np.int64)
    gain = np.zeros(1 << BITS)
    for y in labels.T:
        gain = np.maximum(gain, association(rows, cols, y) ** 2)
    best = np.sort(np.argsort(-gain, kind="stable")[:kept])
    best = best[gain[best] > 0]
    place = np.full(1 << BITS, -1)
    place[best] = np.arange(len(best))
    use = place[cols] >= 0
    rows, cols, d = rows[use], place[cols[use]], len(best)
    fold = np.arange(n) % folds
    before = np.zeros((n, 0))
    for k in range(k_all):
        y = labels[:, k].astype(float)

        def design(which, earlier):
            index = np.cumsum(which) - 1
            m = which[rows]
            e = earlier[which]
            r = np.concatenate([index[rows[m]], np.repeat(np.arange(len(e)), k)])
            c = np.concatenate([cols[m], np.tile(np.arange(d, d + k), len(e))])
            return r, c, np.concatenate([np.ones(m.sum()), e.ravel()]), len(e), d + k

        def fit(which):
            part = y[which]
            if part.min(initial=1) == part.max(initial=0):
                rate = (part.sum() + 0.5) / (len(part) + 1)
                return np.append(np.zeros(d + k), np.log(rate / (1 - rate)))
            return fit_linear(*design(which, before), part, ridge)

        held = np.zeros(n)
        for f in range(min(folds, n)):
            train, test = fold != f, fold == f
            if not train.any():
                train = test
            w = fit(train)
            r, c, v, m, _ = design(test, before)
            held[test] = _sigmoid(np.bincount(r, v * w[c], m) + w[-1])
        w = fit(np.ones(n, bool))
        chain.weights[k, best], chain.links[k, :k], chain.bias[k] = w[:d], w[d:-1], w[-1]
        before = np.column_stack([before, held])
    return chain


def _features(batches):
    for batch in batches:
        found = []
        for _, _, data, offsets in text_chunks(batch.column(1)):
            pairs = np.unique(np.bitwise_or(*(lambda t, f: (t << BITS, f))(*hashed_features(data, offsets))))
            cuts = np.searchsorted(pairs, np.arange(1, len(offsets) - 1) << BITS)
            found += [p.astype("<u4").tobytes() for p in np.split(pairs & (1 << BITS) - 1, cuts)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), *batch.columns[2:]], names=["doc_id", "features", *batch.schema.names[2:]])


def train(docs: DataFrame, labels: DataFrame, categories: Sequence[str] = ("toxic",), kinds: int = 2, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 6_000, seed: int = 0) -> Chain:
    """A chain fitted to at most ``max_rows`` labelled rows, drawn by a hash of their ids.

    ``categories`` are columns of ``labels``, in the chain's order; a value of 1 is yes,
    any other and null no. With one category only, ``kinds`` of it are found by
    clustering and come before it. Labels of a null id, and ids with several label
    rows but the first drawn, are left out; of texts that share an id the first by
    digest is fitted.
    """
    drawn = (
        labels.filter(F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("doc_id"))
        .agg(*[F.min(F.coalesce(F.col(c) == 1, F.lit(False)).cast("double")).alias(f"y{i}") for i, c in enumerate(categories)])
        .orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    # at most max_rows ids: a fixed bound
    ys = [f"y{i}" for i in range(len(categories))]
    joined = texts.join(F.broadcast(drawn), "doc_id").select("doc_id", "text", *ys)
    found = map_arrow(joined, _features, "doc_id long, features binary, " + ", ".join(f"{y} double" for y in ys))
    # one row an id, so what the driver gets is bounded in rows, and in bytes by 2**18 features a row
    single = found.groupBy("doc_id").agg(F.min("features").alias("features"), *[F.min(y).alias(y) for y in ys])
    got = sorted(single.collect(), key=lambda r: r["doc_id"])
    features = [np.frombuffer(r["features"], "<u4") for r in got]
    y = np.array([[r[c] for c in ys] for r in got]).reshape(len(got), len(ys))
    names = list(categories)
    if len(names) == 1 and len(got):
        y = np.column_stack([found_kinds(features, y[:, 0], kinds), y])
        names = [f"kind_{i}" for i in range(kinds)] + names
    elif len(names) == 1:
        names = [f"kind_{i}" for i in range(kinds)] + names
        y = np.zeros((0, len(names)))
    return train_chain(features, y, names)


def score(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """doc_id and p_<category> of each row, and its columns ``keep``; a null or empty text has no features."""
    schema = "doc_id long, " + ", ".join(f"p_{c} double" for c in chain.categories)
    schema += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    shared = docs.sparkSession.sparkContext.broadcast(chain)  # 2**18 weights a category at most

    def run(batches):
        model = shared.value
        for batch in batches:
            parts = [np.zeros((len(model.categories), 0))]
            for _, _, data, offsets in text_chunks(batch.column(1)):
                parts.append(model.probabilities(*hashed_features(data, offsets), len(offsets) - 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, np.concatenate(parts, 1)), *batch.columns[2:]], names=["doc_id", *[f"p_{c}" for c in model.categories], *keep])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *keep)
    return map_arrow(rows, run, schema)


def rejected(threshold: float = 0.35) -> Column:
    return F.col("p_toxic") >= threshold


def toxic_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, p_kind_0, p_kind_1, p_toxic, rejected, one row per row of ``docs``.

    An empty table gives no rows; without labels nothing is rejected.
    """
    return score(docs, train(docs, labels)).withColumn("rejected", rejected())


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns.

    Rows are told apart by id and text, so a clean text stays under an id that a
    rejected one shares, and a rejected one goes without an id too; repeated rows
    are judged alike. An empty table gives no rows; without labels all rows stay.
    """
    digest = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary"), 256)
    chain = train(docs, labels, id_col=id_col, text_col=text_col)
    scored = score(docs.withColumn("__of", digest), chain, id_col, text_col, keep=("__of",))
    return without_texts(docs, scored.filter(rejected()).select(F.col("doc_id").alias("__id"), "__of"), id_col, digest)
