"""Language-model scores: a causal self-attention model, trained with numpy on subword ids.

Texts are lower-cased (A-Z) words, each written with a space before it and split into the ids of a given public vocabulary,
with one end at the end. The model embeds ids, attends over the ids before in a window with a learned weight for each
distance, and predicts the next id by two softmax layers (class, member of the class); classes of frequent ids are small.
Ids rare in the corpus share one unit, and within it have their smoothed share, so the probabilities of all ids sum to one.

All texts of a batch are one sequence cut into blocks of `STRIDE` positions. A block's queries attend over its own and the
block before, so windows overlap by half and each id is scored once, with at least STRIDE ids of context where there are
any; a mask keeps attention causal and within the text.

Texts are split into ids once and kept in a table. Counts of ids and words come from all training documents. The model
learns on all of Spark's tasks: each descends over its own texts from a common start, and their parameters are averaged,
so that what is learnt from grows with the corpus (`train`). The most frequent words, `top_words` at most, are broadcast;
the other words of a text are joined with the counts, one row for each word of a text.

Defined cases: null, empty and wordless texts hold the end only; a null id's checksum is null, so such rows neither train
nor are held out; repeated rows count each; an empty training set gives the uniform distribution; without the vocabulary
file an error is raised; columns named like an added one are replaced.
"""

from __future__ import annotations

import base64
import copy
import math
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, binary_array, buffers, slices, stored, word_hashes, word_spans

#: The vocabulary file, and the session's setting that names another.
VOCABULARY, VOCABULARY_SETTING = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken", "strandlake.vocabulary"
STRIDE = 16
#: Ids that are learnt from in one piece, and parts in which parameters are averaged.
PIECE, PARTS = 1024, 16
#: How far each position of a window's second block is from those of the window; the last number stands for what comes later.
APART = np.arange(STRIDE, 2 * STRIDE)[:, None] - np.arange(2 * STRIDE)
APART[APART < 0] = 2 * STRIDE
RESULTS = ("_n_tokens", "_n_known", "_train_tokens", "_base_score", "_score")
#: What is known of a text before the model is: `_doc` holds its other columns, `_ids` two bytes for each subword.
PARTIAL = T.StructType([T.StructField("_doc", T.StructType()), *(T.StructField(k, t) for k, t in {"_row": T.LongType(), "_learns": T.BooleanType(), "_n_tokens": T.LongType(), "_n_known": T.LongType(), "_base_score": T.DoubleType(), "_ids": T.BinaryType(), "_others": T.ArrayType(T.StructType([T.StructField("word", T.LongType()), T.StructField("times", T.LongType())]))}.items())])
#: Stands for the end of a text among the word hashes.
END = np.uint64(0xE0D0E0D0E0D0E0D1)
_CODERS: dict[int, object] = {}
#: Words whose ids a worker keeps at most, and what it keeps: sorted hashes, where their ids begin, how many there are, ids.
KEPT_WORDS = 1 << 19
_KEPT: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}


def coder(vocabulary: bytes):
    """The encoder for lines; one for each worker."""
    import tiktoken

    key = hash(vocabulary)
    if key not in _CODERS:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _CODERS[key] = tiktoken.Encoding("lines", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
    return _CODERS[key]


def known_words(distinct: np.ndarray, vocabulary: bytes, spelled) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of these word hashes where its ids begin in the last array returned, and how many there are.

    spelled(numbers): lines with the words of these numbers. It is asked only for words that this worker has not split yet;
    a worker keeps the ids of `KEPT_WORDS` words at most and then starts anew."""
    key, enc = hash(vocabulary), coder(vocabulary)
    none = np.zeros(0, np.int32)
    known, begin, size, pool = _KEPT.get(key, (np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint16)))
    if len(known) + len(distinct) > KEPT_WORDS:
        known, begin, size, pool = np.zeros(0, np.uint64), none, none, np.zeros(0, np.uint16)
    at = np.searchsorted(known, distinct)
    new = np.flatnonzero(known[np.minimum(at, len(known) - 1)] != distinct) if len(known) else np.arange(len(distinct))
    if len(new):
        ids = enc.encode_to_numpy(spelled(new).decode(), disallowed_special=())
        stop = np.flatnonzero(ids == enc.encode_single_token(b"\n"))
        starts = np.concatenate([[0], stop[:-1] + 1])
        known, begin, size = (np.insert(x, at[new], y) for x, y in ((known, distinct[new]), (begin, starts + len(pool)), (size, stop - starts)))
        pool = np.concatenate([pool, ids.astype(np.uint16)])
        _KEPT[key] = known, begin, size, pool
        at = np.searchsorted(known, distinct)
    return begin[at], size[at], pool


def subwords(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, vocabulary: bytes):
    """Distinct word hashes, the place of each word's among them, and for each text its ids with -1 at the end. Also where each text ends."""
    hashes = word_hashes(data, start, end, True)
    if not len(hashes):
        n = len(first) - 1
        return hashes, np.zeros(0, np.int64), np.full(n, -1, np.int64), np.arange(1, n + 1)
    distinct, one, back = np.unique(hashes, return_index=True, return_inverse=True)
    raw = LOWER[data].tobytes()
    begin, size, pool = known_words(distinct, vocabulary, lambda new: b"\n".join([b" " + raw[s:e] for s, e in zip(start[one[new]].tolist(), end[one[new]].tolist())]) + b"\n")
    size = size[back]
    upto = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full(upto[-1] + len(first) - 1, -1, np.int64)
    at = np.arange(upto[-1]) + np.repeat(text, size)  # one place more for the end of each text before
    out[at] = pool[np.arange(upto[-1]) + np.repeat(begin[back] - upto[:-1], size)]
    return distinct, back, out, upto[first[1:]] + np.arange(1, len(first))


@dataclass
class Model:
    """side: the root of the number of units. Units are 0 the end (also before a text), 1 the rare ids, then ids by frequency;
    a class is a run of them, from one of `edges` to the next (`classes`)."""

    side: int = 40
    d: int = 16
    h: int = 32
    unit: np.ndarray = field(default_factory=lambda: np.ones(1 << 16, np.int32))
    rest: np.ndarray = field(default_factory=lambda: np.full(1 << 16, -16 * math.log10(2)))
    edges: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    p: dict[str, np.ndarray] = field(default_factory=dict)
    squares: dict[str, np.ndarray] = field(default_factory=dict)  # of gradients, of the first fit

    @cached_property
    def classes(self) -> np.ndarray:
        """The class of each unit."""
        return np.repeat(np.arange(len(self.edges) - 1, dtype=np.uint16), np.diff(self.edges))

    def start(self, seed: int) -> None:
        """Parameters; the last row of `c` and the last column of `m` are biases."""
        rng, d, h, n = np.random.default_rng(seed), self.d, self.h, self.side**2
        shape = {"e": (n, d), "q": (d, d), "k": (d, d), "v": (d, d), "far": (2 * STRIDE,), "w": (2 * d, h), "b": (h,), "c": (h + 1, len(self.edges) - 1), "m": (n, h + 1)}
        scale = {"e": 0.5, "q": d**-0.5, "k": d**-0.5, "v": d**-0.5, "w": (2 * d) ** -0.5, "c": 0.1, "m": 0.1}
        self.p = {k: (rng.normal(0, scale[k], v) if k in scale else np.zeros(v)).astype(np.float32) for k, v in shape.items()}

    def joined(self) -> tuple:
        """Parameters as `forward` multiplies with them: what a unit's vector and a one give to queries and the hidden layer;
        of distances, -inf to what comes later; what attended vectors give to the hidden layer.

        Keys and values are linear in the units' vectors, so their matrices are multiplied into those of the queries and the
        hidden layer, and attention works on the vectors as they are. The hidden layer has one unit more that is always 1."""
        p, d = self.p, self.d
        dtype = p["w"].dtype
        of_x, of_o = np.zeros((d + 1, d + self.h + 1), dtype), np.zeros((d + 1, self.h + 1), dtype)
        np.matmul(p["q"] * dtype.type(d**-0.5), p["k"].T, out=of_x[:-1, :d])
        of_x[:-1, d:-1], of_x[-1, d:-1], of_x[-1, -1] = p["w"][:d], p["b"], 1
        np.matmul(p["v"], p["w"][d:], out=of_o[:-1, :-1])
        e = np.ones((len(p["e"]), d + 1), dtype)
        e[:, :-1] = p["e"]
        return e, of_x, np.append(p["far"], dtype.type(-np.inf)).take(APART), of_o

    def attend(self, x: np.ndarray, q: np.ndarray, first: np.ndarray, far: np.ndarray, capped: bool):
        """Attention of each position over those before it in its text; first: where the text of each position begins.

        x: vectors with a column of ones, after a block of zeros. The attended sum of the ones is what the weights `a` are
        divided by; it comes back as ones. `both` has room for the weights' gradients before the weights of each block."""
        rows, d = len(x) - STRIDE, self.d
        n, near = rows // STRIDE, self.windows(x)
        both = np.empty((n, 2 * STRIDE, 2 * STRIDE), x.dtype)
        a = both[:, STRIDE:]
        np.matmul(q.reshape(n, STRIDE, d), near[:, :, :-1].transpose(0, 2, 1), out=a)
        a += far
        begin = first.reshape(n, STRIDE) - np.arange(-STRIDE, rows - STRIDE, STRIDE)[:, None]
        cut = np.flatnonzero(begin.max(1) > 0)
        a[cut] = np.where(np.arange(2 * STRIDE) >= begin[cut][:, :, None], a[cut], -np.inf)
        if capped:
            a -= a.max(2, keepdims=True)
        np.exp(a, out=a)
        o = np.matmul(a, near).reshape(rows, -1)
        all_a = o[:, -1:].copy()
        o /= all_a
        return near, both, o, all_a

    @staticmethod
    def windows(x: np.ndarray) -> np.ndarray:
        """A view: each block of rows with the block before, without a copy; the first block of x has no window of its own."""
        row, column = x.strides
        return np.lib.stride_tricks.as_strided(x, (len(x) // STRIDE - 1, 2 * STRIDE, x.shape[1]), (STRIDE * row, row, column), writeable=False)

    @np.errstate(over="ignore", invalid="ignore")
    def forward(self, units: np.ndarray, target: np.ndarray, first: np.ndarray, joined: tuple | None = None, capped: bool = False, table: np.ndarray | None = None):
        """Natural log probability of each target after its unit; and what a training step needs.

        After attention the rows stand in order of the targets' classes, so that the members of a class are one product.
        Classes differ in size, so the members' logits of all rows stand in one line, `soft`, a row after the other.
        capped: logits are taken less the highest of their row. That is asked for only once sums of their powers are so high or
        low that it matters.
        table: what `joined` makes of each unit, where that was made before."""
        joined = joined or self.joined()
        e, of_x, far, of_o = joined
        n, d, edges = len(units), self.d, self.edges
        x = np.empty((n + STRIDE, d + 1), e.dtype)
        x[:STRIDE] = 0  # a block of zeros stands before the first
        e.take(units, 0, x[STRIDE:], "clip")
        y = x[STRIDE:] @ of_x if table is None else table.take(units, 0)
        near, both, o, all_a = self.attend(x, y[:, :d], first, far, capped)
        h = o @ of_o
        h += y[:, d:]
        np.maximum(h, 0, out=h)
        c = self.classes[target]
        order = np.argsort(c, kind="stable")
        c, h = c[order], h.take(order, 0)
        cuts = np.searchsorted(c, np.arange(len(edges), dtype=c.dtype))
        width = np.diff(edges)[c]
        start = np.cumsum(width) - width
        soft = np.empty(start[-1] + width[-1], h.dtype)
        parts, at, cuts, ends, m = [], 0, cuts.tolist(), edges.tolist(), self.p["m"]
        for low, to, begin, end in zip(cuts, cuts[1:], ends, ends[1:]):
            if low < to:
                part = soft[at : at + (to - low) * (end - begin)].reshape(to - low, end - begin)
                np.dot(h[low:to], m[begin:end].T, part)
                parts.append((slice(low, to), slice(begin, end), part))
                at += part.size
        of_c = h @ self.p["c"]
        if capped:
            soft -= np.repeat(np.maximum.reduceat(soft, start), width)
            of_c -= of_c.max(1, keepdims=True)
        hit, row = start + (target[order] - edges[c]), np.arange(n)
        logp = of_c[row, c] + soft[hit]
        np.exp(soft, out=soft)
        np.exp(of_c, out=of_c)
        sums, all_c = np.add.reduceat(soft, start), of_c @ np.ones(of_c.shape[1], h.dtype)
        if not capped and not all(z.max() < math.exp(60) and z.min() > math.exp(-60) for z in (sums, all_c, all_a)):
            return self.forward(units, target, first, joined, True, table)
        logp -= np.log(all_c)
        logp -= np.log(sums)
        out = np.empty(n, h.dtype)
        out[order] = logp
        return out, (x, y, near, both, o, all_a, h, c, width, soft, of_c, sums, all_c, hit, row, order, parts)

    def step(self, units, target, first, live, into: dict | None = None):
        """Gradients of the mean loss over live positions, written to `into` if given."""
        p, d = self.p, self.d
        _, of_x, _, of_o = joined = self.joined()
        logp, (x, y, near, both, o, all_a, h, c, width, soft, of_c, sums, all_c, hit, row, order, parts) = self.forward(units, target, first, joined)
        g = into or {name: np.empty_like(z) for name, z in p.items()}
        share = live[order] * x.dtype.type(1 / max(live.sum(), 1))
        soft *= np.repeat(share / sums, width)
        soft[hit] -= share
        of_c *= (share / all_c)[:, None]
        of_c[row, c] -= share
        back = np.empty((len(h), self.h + 1), h.dtype)
        g["m"][...] = 0
        for s, own, part in parts:
            np.dot(part.T, h[s], g["m"][own])
            np.dot(part, p["m"][own], back[s])
        np.matmul(h.T, of_c, out=g["c"])
        back += of_c @ p["c"].T
        back *= h > 0
        # gradients of all that comes from a unit's vector, side by side as in `of_x`
        of_y = np.empty((len(h), d + self.h + 1), x.dtype)
        of_h = of_y[:, d:]
        of_h[order] = back
        of_a = o[:, :-1].T @ of_h[:, :-1]
        # gradients of what is divided by the sums, with what the sums themselves lose in the column of the ones
        n = len(both)
        q_do = np.empty((n, 2 * STRIDE, d + 1), x.dtype)
        q_do[:, :STRIDE, :-1] = y[:, :d].reshape(n, STRIDE, d)
        do = q_do[:, STRIDE:]
        np.divide((of_h[:, :-1] @ of_o[:-1, :-1].T).reshape(n, STRIDE, d), all_a.reshape(n, STRIDE, 1), out=do[:, :, :-1])
        np.negative(np.einsum("nij,nij->ni", do[:, :, :-1], o.reshape(n, STRIDE, -1)[:, :, :-1]), out=do[:, :, -1])
        ds, a = both[:, :STRIDE], both[:, STRIDE:]
        np.matmul(do, near.transpose(0, 2, 1), out=ds)
        ds *= a
        g["far"][...] = np.bincount(APART.ravel(), ds.sum(0).ravel(), 2 * STRIDE + 1)[:-1]
        np.matmul(ds, near[:, :, :-1], out=of_y.reshape(n, STRIDE, -1)[:, :, :d])
        # vectors get the gradients of keys and values of both windows they are in
        dx = (of_y @ of_x[:-1].T).reshape(n, STRIDE, d)
        of_near = np.matmul(both.transpose(0, 2, 1), q_do[:, :, :-1])
        dx += of_near[:, STRIDE:]
        dx[:-1] += of_near[1:, :STRIDE]
        of_p = x[STRIDE:].T @ of_y
        of_qk = of_p[:-1, :d] * x.dtype.type(d**-0.5)
        g["q"][...], g["k"][...], g["v"][...] = of_qk @ p["k"], of_qk.T @ p["q"], of_a @ p["w"][d:].T
        g["w"][:d], g["w"][d:], g["b"][...] = of_p[:-1, d:-1], p["v"].T @ of_a, of_p[-1, d:-1]
        g["e"][...] = 0
        at = units[:, None] * d
        np.add.at(g["e"].reshape(-1), (at + np.arange(d)).reshape(-1), dx.reshape(-1))
        return logp, g

    def laid_out(self, ids: np.ndarray, ends: np.ndarray):
        """Units before and at each position, the place where its text begins, and what rare ids cost more."""
        target = np.where(ids < 0, 0, self.unit[ids])
        first = np.concatenate([[0], ends[:-1]])
        before = np.concatenate([[0], target[:-1]])
        before[first[first < len(before)]] = 0
        return before, target, np.repeat(first, np.diff(np.append(first, len(ids)))), np.where(target == 1, self.rest[ids], 0.0)

    def score(self, ids: np.ndarray, ends: np.ndarray, batch: int = 1 << 12) -> np.ndarray:
        """log10 probability of each text."""
        before, target, first, more = self.laid_out(ids, ends)
        if not self.p:
            logp = np.full(len(ids), -math.log10(3)) + np.where(target == 1, more, 0)
        else:
            # every text begins a block, so its windows and its score depend on nothing around it
            size = np.diff(np.concatenate([[0], ends]))
            room = -(-size // STRIDE) * STRIDE
            shift = np.cumsum(room) - room - (ends - size)
            place = np.arange(len(ids)) + np.repeat(shift, size)
            n = int(room.sum())
            units, wanted, begin, out = np.zeros(n, before.dtype), np.zeros(n, target.dtype), np.arange(n), np.empty(n)
            units[place], wanted[place], begin[place] = before, target, first + np.repeat(shift, size)
            joined = self.joined()
            table = joined[0] @ joined[1]
            for at in range(0, n, batch - STRIDE):
                low = max(at - STRIDE, 0)  # one block of context; positions are laid out anew from `low`
                to = min(at + batch - STRIDE, n)
                out[at:to] = self.forward(units[low:to], wanted[low:to], np.maximum(begin[low:to] - low, 0), joined, table=table)[0][at - low :]
            logp = out[place] / math.log(10) + more
        total = np.concatenate([[0.0], np.cumsum(logp)])
        return total[ends] - total[np.concatenate([[0], ends[:-1]])] if len(ends) else np.zeros(0)


def prepared(counts: np.ndarray, ends: int, side: int, seed: int) -> Model:
    """A model before training: units by the counts of all ids, shares of the rare ones, biases by the units' shares."""
    model = Model(side)
    common = np.argsort(-counts, kind="stable")[: side * side - 2]
    common = common[counts[common] >= 3]
    model.unit[:] = 1
    model.unit[common] = np.arange(2, 2 + len(common))
    rare = np.where(model.unit == 1, counts + 0.5, 0)
    model.rest = np.log10(np.maximum(rare, 1e-300) / rare.sum())
    share = np.bincount(model.unit, counts, side * side) + 0.5
    share[0] += ends
    share /= share.sum()
    model.edges = runs(share)
    model.start(seed)
    total = np.add.reduceat(share, model.edges[:-1])
    model.p["c"][-1] = np.log(total)
    model.p["m"][:, -1] = np.log(share / total[model.classes])
    return model


def runs(share: np.ndarray) -> np.ndarray:
    """Edges of classes, whole fours: a class ends once its share times its members reaches 1.5.

    A position has a logit for each class, and one for each member of its own class. C classes of one product of share and
    members have C times that product of the latter, which goes down as 1/C, so the sum of both is least where it is 1; it is
    a little more as a class costs its own small products."""
    edges, total = [0], 0.0
    for i, x in enumerate(share.tolist(), 1):
        total += x
        if i % 4 == 0 and total * (i - edges[-1]) >= 1.5:
            edges.append(i)
            total = 0.0
    return np.array(edges if edges[-1] == len(share) else [*edges, len(share)])


def closed(model: Model) -> Model:
    """Units that no id has get no probability."""
    used = np.zeros(model.side**2, bool)
    used[np.append(model.unit, 0)] = True
    model.p["m"][~used, -1] = -200
    model.p["c"][-1, ~np.logical_or.reduceat(used, model.edges[:-1])] = -200
    return model


class Descent:
    """Adam. A batch is made of pieces of `PIECE` ids of the sequence of texts; attention stays within a piece.

    A model that has been fitted brings the mean squares of its gradients, so that the first steps of a task are no larger
    than the last ones before."""

    def __init__(self, model: Model, rate: float):
        self.model, self.rate, self.n, self.seen, self.fresh = model, rate, 0, 0, not model.squares
        size = sum(x.size for x in model.p.values())
        # one array each, of which the model's are views: means, mean squares, gradients and parameters
        self.m, self.v, self.g, self.x = np.zeros((4, size), next(iter(model.p.values())).dtype)
        if self.fresh:
            model.squares = {k: np.zeros_like(x) for k, x in model.p.items()}
        model.squares, model.p = self.views(self.v, model.squares), self.views(self.x, model.p)
        self.grads = self.views(self.g, model.p)

    def views(self, flat: np.ndarray, had: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        """Views of `flat` that hold what `had` holds."""
        out = {k: y.reshape(had[k].shape) for (k, y) in zip(self.model.p, np.split(flat, np.cumsum([x.size for x in self.model.p.values()])[:-1]))}
        for k, y in out.items():
            y[...] = had[k]
        return out

    def learn(self, ids: np.ndarray, ends: np.ndarray, rng, share: float, batch: int, left=lambda n: 1.0) -> None:
        """left(n): the part of the rate that the n-th step has."""
        before, target, first, _ = self.model.laid_out(ids, ends)
        places = np.arange(0, len(ids), PIECE)
        places = rng.permutation(places[rng.random(len(places)) < share])
        for at in range(0, len(places), max(batch // PIECE, 1)):
            some = places[at : at + max(batch // PIECE, 1)]
            size = np.minimum(len(ids) - some, PIECE)
            room = -(-size // STRIDE) * STRIDE
            units, wanted, begin, live = np.zeros(room.sum(), np.int32), np.zeros(room.sum(), np.int32), np.arange(room.sum()), np.zeros(room.sum(), bool)
            for low, n, base in zip(some.tolist(), size.tolist(), (np.cumsum(room) - room).tolist()):
                own, to = slice(low, low + n), slice(base, base + n)
                units[to], wanted[to], live[to] = before[own], target[own], True
                np.maximum(first[own] - low, 0, out=begin[to])
                begin[to] += base
            self.model.step(units, wanted, begin, live, self.grads)
            self.n += 1
            self.seen += int(live.sum())
            self.moved(self.rate * left(self.n) * min(1, self.n / 20))

    def moved(self, lr: float, block: int = 1 << 13) -> None:
        """One step along the gradients, a block at a time, which stays in the cache."""
        young = (1 - 0.9**self.n, 1 - 0.99**self.n) if self.fresh else (1, 1)
        root = math.sqrt(100 * young[1])
        for at in range(0, len(self.x), block):
            m, v, g, x = (y[at : at + block] for y in (self.m, self.v, self.g, self.x))
            m *= 0.9
            m += g  # ten times the mean; v is a hundred times the mean square
            g *= g
            v *= 0.99
            v += g
            # g is the gradient no longer but the divisor
            np.sqrt(v, out=g)
            g += 1e-8 * root
            np.divide(m, g, out=g)
            g *= 0.1 * root * lr / young[0]
            x -= g


def fit(ids: np.ndarray, ends: np.ndarray, side: int = 40, epochs: int = 3, batch: int = 1024, rate: float = 1.5e-2, seed: int = 5, model: Model | None = None) -> Model:
    """A model from one sequence of texts, with a rate that falls to zero; `model`: start from this one."""
    model = model or prepared(np.bincount(ids[ids >= 0], minlength=1 << 16), len(ends), side, seed)
    steps = epochs * -(-len(ids) // max(batch, PIECE))
    descent, rng = Descent(model, rate), np.random.default_rng(seed)
    for _ in range(epochs if len(ids) else 0):
        descent.learn(ids, ends, rng, 1.0, batch, lambda n: max(1 - (n - 1) / steps, 0))
    return closed(model) if len(ids) else Model(side)


def unpacked(col) -> tuple[np.ndarray, np.ndarray]:
    """Ids with -1 at the end of each text, from packed ones."""
    data, off = buffers(col)
    ids, off = data.view("<u2").astype(np.int64), off // 2
    n = len(off) - 1
    out = np.full(len(ids) + n, -1, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(off))] = ids
    return out, off[1:] + np.arange(1, n + 1)


def id_counts(packed: DataFrame) -> tuple[np.ndarray, int]:
    """How often each id occurs in all texts, and the number of texts."""

    def counted(it):
        for b in it:
            counts = np.bincount(buffers(b.column("_ids"))[0].view("<u2"), minlength=1 << 16)
            some = np.flatnonzero(counts)
            yield pa.record_batch([pa.array(np.append(some, -1)), pa.array(np.append(counts[some], b.num_rows))], names=["_i", "_c"])

    out, texts = np.zeros(1 << 16, np.int64), 0
    for r in packed.select("_ids").mapInArrow(counted, "_i long, _c long").groupBy("_i").agg(F.sum("_c").alias("_c")).collect():  # an id each
        if r._i < 0:
            texts = r._c
        else:
            out[r._i] = r._c
    return out, texts


def train(packed: DataFrame, side: int = 40, warm_ids: int = 800_000, warm_epochs: int = 6, rounds: int = 1, share: float = 1.0, batch: int = 2048, rate: float = 1e-2, seed: int = 5) -> Model:
    """Fit on all texts (`_row`, `_ids`: packed ids), in parallel.

    The units, their biases and the shares of rare ids come from the counts of all ids. A first fit on the driver, on about
    `warm_ids` ids in pieces drawn from all texts, only finds a common start. Then in each round every task descends from
    the model of the round before over all of its own texts (with `share` below 1: over that part of their pieces), and the
    tasks' models are averaged, weighted by the ids they have seen. By default each id of each training text is learnt once."""
    spark = packed.sparkSession
    counts, texts = id_counts(packed)
    total = int(counts.sum()) + texts
    if not total:
        return Model(side)
    model = prepared(counts, texts, side, seed)
    part = min(1.0, warm_ids / total)

    def drawn(it):
        """Pieces of texts, each with probability `part`."""
        for b in it:
            data, off = buffers(b.column("_ids"))
            ids = data.view("<u2")
            for r, row in enumerate(b.column("_row").to_pylist()):
                own = ids[off[r] // 2 : off[r + 1] // 2]
                pick = np.random.default_rng((seed, row)).random(len(own) // PIECE + 1) < part
                if pick.any():
                    some = [own[i * PIECE : (i + 1) * PIECE].tobytes() for i in np.flatnonzero(pick)]
                    yield pa.record_batch([pa.array([row] * len(some)), pa.array(np.flatnonzero(pick)), pa.array(some, pa.binary())], names=["_row", "_piece", "_ids"])

    got = packed.select("_row", "_ids").mapInArrow(drawn, "_row long, _piece long, _ids binary").toArrow().sort_by([("_row", "ascending"), ("_piece", "ascending")])
    model = fit(*unpacked(got["_ids"].combine_chunks()), side, warm_epochs, model=model, seed=seed)
    names, sizes = list(model.p), [x.size for x in model.p.values()]
    for turn in range(rounds):
        sent = spark.sparkContext.broadcast(model)

        def descended(it, sent=sent, turn=turn):
            own = copy.deepcopy(sent.value)
            descent, rng = Descent(own, rate * 0.5**turn), np.random.default_rng((seed, turn, TaskContext.get().partitionId()))
            for b in it:
                _, off = buffers(b.column("_ids"))
                for i, j in slices(off):
                    ids, ends = unpacked(b.column("_ids").slice(i, j - i))
                    descent.learn(ids, ends, rng, share, batch)
            if descent.seen:
                flat = np.concatenate([own.p[k].ravel() for k in names]).astype(np.float64) * descent.seen
                yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([descent.seen] * PARTS), pa.array([x.tobytes() for x in np.array_split(flat, PARTS)], pa.binary())], names=["_part", "_weight", "_sum"])

        def averaged(it):
            """One row for each part of the parameters, summed as the rows come in."""
            sums: dict[int, list] = {}
            for b in it:
                for k, w, x in zip(*(b.column(c) for c in ("_part", "_weight", "_sum"))):
                    had = sums.setdefault(k.as_py(), [0, 0.0])
                    had[0] += w.as_py()
                    had[1] = had[1] + np.frombuffer(x.as_buffer())
            if sums:
                yield pa.record_batch([pa.array(list(sums), pa.int32()), pa.array([x[0] for x in sums.values()]), pa.array([x[1].tobytes() for x in sums.values()], pa.binary())], names=["_part", "_weight", "_sum"])

        kind = "_part int, _weight long, _sum binary"
        rows = packed.select("_ids").mapInArrow(descended, kind).repartition(PARTS, "_part").sortWithinPartitions("_part", "_weight", "_sum").mapInArrow(averaged, kind).orderBy("_part").collect()
        if rows:
            flat = np.concatenate([np.frombuffer(r._sum) / r._weight for r in rows]).astype(np.float32)
            model.p = {k: x.reshape(model.p[k].shape) for k, x in zip(names, np.split(flat, np.cumsum(sizes)[:-1]))}
        sent.unpersist()
    return closed(model)


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(_word, _count) over all documents, ends included; words by hash, counted within each chunk first."""

    def counted(it):
        for b in it:
            data, off = buffers(b.column("_text"))
            for i, j in slices(off, 8 << 20):
                own = data[off[i] : off[j]]
                start, end, _ = word_spans(own, off[i : j + 1] - off[i])
                words, counts = np.unique(word_hashes(own, start, end, True), return_counts=True)
                yield pa.record_batch([pa.array(np.append(words, END).view(np.int64)), pa.array(np.append(counts, j - i))], names=["_word", "_count"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(counted, "_word long, _count long").groupBy("_word").agg(F.sum("_count").alias("_count"))


def frequent(counts: DataFrame, most: int) -> tuple[int, np.ndarray, np.ndarray]:
    """The words of at least a count (returned first), `most` at most: by a histogram of some hundred rows."""
    level = F.floor(F.log2("_count") * 8).cast("int")
    have, low = 0, 1 << 62
    for r in counts.groupBy(level.alias("l")).agg(F.count(F.lit(1)).alias("n"), F.min("_count").alias("low")).orderBy(F.desc("l")).collect():
        have += r.n
        if have > most:
            break
        low = r.low
    got = counts.filter(F.col("_count") >= low).toArrow().sort_by("_word")
    return low, got["_word"].to_numpy(), got["_count"].to_numpy()


def score(docs: DataFrame, trains: Column, vocabulary_file: str | None = None, top_words: int = 200_000, text_col: str = "text", **more) -> DataFrame:
    """The documents (without their text) with `_n_tokens`, `_n_known`, `_train_tokens`, `_base_score` and `_score`."""
    spark = docs.sparkSession
    with open(vocabulary_file or spark.conf.get(VOCABULARY_SETTING, VOCABULARY), "rb") as f:
        vocabulary = f.read()
    learns = F.coalesce(trains, F.lit(False))
    counts = stored(word_counts(docs.filter(learns), text_col), "words", release=True)
    total, distinct = counts.agg(F.coalesce(F.sum("_count"), F.lit(0)), F.count(F.lit(1))).first()
    low, top, top_count = frequent(counts, top_words)
    norm = math.log10(total + 0.5 * (distinct + 1))
    words_sent = spark.sparkContext.broadcast((vocabulary, top, top_count))
    docs = docs.drop(*RESULTS)
    names = [c for c in docs.columns if c != text_col]

    def split(it):
        """Each text's packed ids, the sums over its frequent words, and its other words with their numbers."""
        vocabulary, top, top_count = words_sent.value
        gain = np.append(np.log10(top_count + 0.5), 0.0)
        for b in it:
            data, off = buffers(b.column("_text"))
            for i, j in slices(off):
                own, lines = data[off[i] : off[j]], off[i : j + 1] - off[i]
                start, end, first = word_spans(own, lines)
                distinct, back, ids, ends = subwords(own, start, end, first, vocabulary)
                # the ends are words too
                distinct, back = np.append(distinct, END).view(np.int64), np.insert(back, first[1:], len(distinct))
                edges = first + np.arange(len(first))
                at = np.minimum(np.searchsorted(top, distinct), max(len(top) - 1, 0))
                found = top[at] == distinct if len(top) else np.zeros(len(distinct), bool)
                sums = np.concatenate([[0.0], np.cumsum(gain[np.where(found, at, -1)][back])])
                found = found[back]
                hits = np.concatenate([[0], np.cumsum(found)])
                text = np.repeat(np.arange(j - i), np.diff(edges))[~found]
                rest = distinct[back[~found]]
                order = np.lexsort((rest, text))
                text, rest = text[order], rest[order]
                begin = np.flatnonzero(np.concatenate([np.ones(min(len(rest), 1), bool), (rest[1:] != rest[:-1]) | (text[1:] != text[:-1])]))
                others = pa.StructArray.from_arrays([pa.array(rest[begin]), pa.array(np.diff(np.append(begin, len(rest))))], names=["word", "times"])
                others = pa.ListArray.from_arrays(pa.array(np.searchsorted(text[begin], np.arange(j - i + 1)), pa.int32()), others)
                size = np.diff(np.concatenate([[0], ends])) - 1
                packed = binary_array(ids[ids >= 0].astype("<u2").view(np.uint8), 2 * np.concatenate([[0], np.cumsum(size)]), False)
                part = b.slice(i, j - i)
                yield pa.record_batch([part.column("_doc"), part.column("_row"), part.column("_learns"), pa.array(np.diff(edges)), pa.array(np.diff(hits[edges])), pa.array(np.diff(sums[edges])), packed, others], names=PARTIAL.names)

    own = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.struct(F.lit(0))
    rows = docs.select(own.alias("_doc"), F.monotonically_increasing_id().alias("_row"), learns.alias("_learns"), F.col(text_col).alias("_text"))
    rows = stored(rows.mapInArrow(split, T.StructType([rows.schema["_doc"], *PARTIAL.fields[1:]])), "split", release=True)
    model_sent = spark.sparkContext.broadcast(train(rows.filter("_learns"), **more))

    def scored(it):
        model = model_sent.value
        for b in it:
            _, off = buffers(b.column("_ids"))
            out = [np.zeros(0)]
            for i, j in slices(off):
                out.append(model.score(*unpacked(b.column("_ids").slice(i, j - i))))
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(np.concatenate(out))], names=[*kept, "_score"])

    kept = [c for c in PARTIAL.names if c not in ("_ids", "_others", "_learns")]
    done = rows.select(*kept, "_ids").mapInArrow(scored, T.StructType([*(rows.schema[c] for c in kept), T.StructField("_score", T.DoubleType())]))
    # a word's count stays unknown to the join only if no training document has it; a text has one row for each of its words
    others = rows.select("_row", F.explode("_others").alias("_o")).select("_row", F.col("_o.word").alias("_word"), F.col("_o.times").alias("_times"))
    others = others.join(counts.filter(F.col("_count") < low), "_word", "left")
    gain = F.sum(F.col("_times") * F.log10(F.coalesce("_count", F.lit(0)) + 0.5))
    others = others.groupBy(F.col("_row").alias("_r")).agg(gain.alias("_gain"), F.sum(F.when(F.col("_count").isNotNull(), F.col("_times"))).alias("_more"))
    out = done.join(others, F.col("_row") == F.col("_r"), "left")
    base = F.col("_base_score") + F.coalesce("_gain", F.lit(0.0)) - F.col("_n_tokens") * F.lit(norm)
    return out.select(*(F.col("_doc").getField(c).alias(c) for c in names), "_n_tokens", (F.col("_n_known") + F.coalesce("_more", F.lit(0))).alias("_n_known"), F.lit(total).cast("long").alias("_train_tokens"), base.alias("_base_score"), "_score")
