"""Toxicity scores by a factorization machine over hashed terms.

A text is the set of its terms: lower-cased (A-Z) runs of letters, digits and non-ASCII characters, hashed into 2**bits
slots. The score is sigmoid(bias + sum of term weights + sum over pairs of terms of the inner product of their factors),
so a pair such as an insult and the mention of a group counts beyond what either adds alone, and a pair of terms that say
nothing alone is found as well: which terms have factors does not depend on their weights.

The model is fitted with numpy on the driver on a bounded sample of labelled texts: at most `max_train` documents, those
with the smallest seeded hashes of their ids, as term numbers and not as texts. Scoring runs in Arrow batches over all
texts, whole. Only terms of at least `min_df` sample documents have weights, so the model sent to the tasks is bounded.

Defined cases: null, empty and wordless texts get the bias alone; without labels of both kinds all scores
are below 1e-12, so nothing is rejected; rows whose label or id is null teach nothing; of several labels for an id the
largest holds, of several texts the one whose sorted terms come first; rows and other columns pass through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, released, slices, word_hashes, word_spans

#: Bytes that stand between terms: ASCII but letters and digits.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = [not chr(i).isalnum() for i in range(128)]


@dataclass
class Model:
    bits: int
    bias: float
    slot: np.ndarray  # hashed term -> row of the tables; the last row is all zero
    weight: np.ndarray
    factors: np.ndarray

    def logits(self, rows: np.ndarray, first: np.ndarray) -> np.ndarray:
        """rows: rows of the tables of all texts, distinct within a text; first: where each text begins."""
        n = len(first) - 1
        doc = np.repeat(np.arange(n), np.diff(first))
        out = self.bias + np.bincount(doc, self.weight[rows], n)
        for f in self.factors.T:
            v = f[rows]
            out += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
        return out


def terms(data: np.ndarray, off: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed terms of each text (sorted) and where each text begins."""
    start, end, first = word_spans(data, off, BETWEEN)
    h = (word_hashes(data, start, end, True) >> np.uint64(64 - bits)).astype(np.int64)
    doc = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(first))
    key = np.unique((doc << bits) | h)
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(off)))


def batches(it, bits):
    """Arrow batches with the terms of their texts."""
    for b in it:
        data, off = buffers(b.column("text"))
        for i, j in slices(off):
            found, first = terms(data[off[i] : off[j]], off[i : j + 1] - off[i], bits)
            yield b.slice(i, j - i), found, first


def log_loss(model: Model, rows: np.ndarray, first: np.ndarray, label: np.ndarray) -> float:
    return float(np.logaddexp(0, np.where(label > 0, -1, 1) * model.logits(rows, first)).sum())


def fit(found: list[np.ndarray], label: np.ndarray, bits: int = 20, factors: int = 8, min_df: int = 5, epochs: int = 8, batch: int = 256, alpha: float = 2.0, l1: float | None = None, l2: float = 0.3, rate: float = 0.25, decay: float = 3e-3, evidence: float = 3.5, seed: int = 7) -> Model:
    """FTRL with an L1 penalty for the weights; Adagrad with decay for the factors, whatever the terms' own weights are.

    l1: the gradient a term must gather to have a weight; by default it grows with the sample, up to 10.
    evidence: the gradients of a term's factors add up against the fixed small factors of all other terms, so a term that
    interacts with another drifts while others wander; it joins the pairs once the squared drift, in units of its spread,
    exceeds what `factors` chance drifts have by so many standard deviations. Every tenth text is left out of the descent
    and decides how long a factor must be to stay in the model."""
    l1 = min(10.0, 0.2 * len(label) ** 0.5) if l1 is None else l1
    sizes = np.array([len(x) for x in found], np.int64)
    flat = np.concatenate(found) if len(found) else np.zeros(0, np.int64)
    df = np.bincount(flat, minlength=1 << bits)
    used = np.flatnonzero(df >= min_df)
    slot = np.full(1 << bits, len(used), np.int32)
    slot[used] = np.arange(len(used))
    n, rng = len(used) + 1, np.random.default_rng(seed)
    model = Model(bits, -30.0, slot, np.zeros(n), np.zeros((n, factors)))
    if not len(label) or label.min() == label.max():
        return model
    rows, first = slot[flat], np.concatenate([[0], np.cumsum(sizes)])

    def texts(pick):
        return np.concatenate([rows[:0], *(rows[first[i] : first[i + 1]] for i in pick)]), np.concatenate([[0], np.cumsum(sizes[pick])])

    order = rng.permutation(len(label))
    aside, taught = (order[: len(order) // 10], order[len(order) // 10 :]) if len(order) >= 100 else (order[:0], order)
    model.bias = float(np.log(label.mean() / (1 - label.mean())))
    z, seen = np.zeros(n), np.zeros(n)
    start = rng.normal(0, 0.05, (n, factors))
    start[-1] = 0
    v, drift, spread, bias_moved = start.copy(), np.zeros((n, factors)), np.full((n, factors), 1e-9), 1e-2
    moved, active = np.full((n, factors), 1e-2), np.zeros(n, bool)
    for epoch in range(epochs):
        order = rng.permutation(taught)
        chance = (factors + evidence * (2 * factors) ** 0.5) * (epoch + 1)  # the same texts wander the same way again
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            own, own_first = texts(pick)
            off = 1 / (1 + np.exp(-np.clip(model.logits(own, own_first), -30, 30))) - label[pick]
            doc = np.repeat(np.arange(len(pick)), sizes[pick])
            g = np.bincount(own, off[doc], n)
            g[-1] = 0
            step = (np.sqrt(seen + g * g) - np.sqrt(seen)) / alpha
            z += g - step * model.weight
            seen += g * g
            model.weight = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((1 + np.sqrt(seen)) / alpha + l2), 0)
            bias_moved += off.sum() ** 2
            model.bias -= 0.1 * off.sum() / np.sqrt(bias_moved)
            if not factors:
                continue
            present, size = np.bincount(own, minlength=n), np.sqrt(sizes[pick] + 1.0)
            for k in range(factors):
                x = v[own, k]
                others = np.bincount(doc, x, len(pick))[doc] - x
                d = np.bincount(own, off[doc] * others, n)
                # what all texts have in common is for the weights; and a term must not drift by its company's length
                usual = np.bincount(own, others, n) / np.maximum(present, 1)
                pull = off[doc] * (others - usual[own]) / size[doc]
                drift[:, k] += np.bincount(own, pull, n)
                spread[:, k] += np.bincount(own, pull * pull, n)
                d = d + decay * present * v[:, k]
                moved[:, k] += active * d * d
                v[:, k] -= rate * d / np.sqrt(moved[:, k]) * active
            active |= (drift * drift / spread).sum(1) > chance
            active[-1] = False
            model.factors = np.where(active[:, None], v, 0)
    if active.any() and len(aside):
        own, own_first = texts(aside)
        whole, length = model.factors, np.sqrt((model.factors**2).sum(1))
        cuts = [0.0, *np.quantile(length[active], [0.5, 0.8, 0.95]), np.inf]
        losses = []
        for cut in cuts:
            model.factors = np.where((length > cut)[:, None], whole, 0)
            losses.append(log_loss(model, own, own_first, label[aside]))
        model.factors = np.where((length > cuts[int(np.argmin(losses))])[:, None], whole, 0)
    keep = np.flatnonzero((model.weight != 0) | (model.factors != 0).any(1))  # the others take no part in scoring
    slot = np.full(1 << bits, len(keep), np.int32)
    slot[used[keep]] = np.arange(len(keep))
    model.slot, model.weight, model.factors = slot, np.append(model.weight[keep], 0.0), np.vstack([model.factors[keep], np.zeros((1, factors))])
    return model


def train(docs: DataFrame, labels: DataFrame, max_train: int = 12000, bits: int = 20, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **more) -> Model:
    """Fit on the labelled documents; `labels` has an id and 0 or 1 in `label_col`."""
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_label"))
    sample = known.orderBy(F.xxhash64(F.lit(seed), F.col("_id")), "_id").limit(max_train)

    def hashed(it):
        for b, found, first in batches(it, bits):
            yield pa.record_batch({"_id": b.column("_id"), "label": b.column("label"), "terms": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(found, pa.int32()))})

    kind = T.StructType([T.StructField("_id", docs.schema[id_col].dataType), T.StructField("label", T.IntegerType()), T.StructField("terms", T.ArrayType(T.IntegerType()))])
    rows = docs.select(F.col(id_col).alias("_d"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("_d") == F.col("_id"))  # at most max_train ids
    rows = rows.select("_id", F.col("_label").alias("label"), "text").mapInArrow(hashed, kind)
    got = rows.groupBy("_id").agg(F.min(F.struct("terms", "label")).alias("_r")).select("_id", "_r.*").toArrow().sort_by("_id")  # one row of an id
    model = fit([np.asarray(x, np.int64) for x in got["terms"].to_numpy()], got["label"].to_numpy().astype(float), bits, seed=seed, **more)
    del got
    released()  # the driver has more to do after this
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The documents with a toxicity score of 0 to 1; a column of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(score_col)
    names = docs.columns

    def scored(it):
        m = sent.value
        for b in it:
            text = b.column(names.index(text_col))
            data, off = buffers(text)
            out = [np.zeros(0)]
            for i, j in slices(off):
                found, first = terms(data[off[i] : off[j]], off[i : j + 1] - off[i], m.bits)
                out.append(1 / (1 + np.exp(-np.clip(m.logits(m.slot[found], first), -30, 30))))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out))], [*names, score_col])

    return docs.mapInArrow(scored, T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())]))


def drop_toxic(docs: DataFrame, model: Model, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents whose score is below the threshold, with their own columns."""
    return score(docs, model, text_col, "_toxicity").filter(F.col("_toxicity") < threshold).drop("_toxicity")
