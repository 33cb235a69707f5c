"""Hard-negative mining by dual-tree search.

Vectors are quantised to whole numbers, floor(scale * x); the score of a row is its inner product with the anchor. An anchor's
positives are its best other rows of the same label. For each positive, the negatives are the best rows of another label
whose score lies between two shares of the positive's score.

Anchors and candidates each stand in trees of balls. For a pair of nodes, centres and radii give an interval that holds all
inner products of their rows; where it misses what the anchors below still can use - their k best scores so far, and the
shares of their positives - the whole group of anchors is done with all those candidates at once. Where it doesn't, nodes are
opened, and pairs of leaves are scored exactly.

The top of both trees is one partition of space into cells, fitted on a bounded sample of rows (`sample` of them, least hash
of the id first); every row is then put in its cell. The driver has a centre, a radius, the labels' range and a number of
rows for each cell, at most MOST_CELLS of them, and leaves out pairs of cells by the same intervals. For the others, groups of
anchors meet slices of candidates, each of bounded size, and the rest of both trees is built where they meet. Anchors begin
with the k best scores among the sample as their limit. A cell with more rows than a slice, say of copies of one vector, is
dealt over several by the hash of the id. Nothing is broadcast but the sample and the pairs of cells.

Defined cases: rows with a null id, a null label, a null or empty vector or one with null or non-finite components take no
part; vectors of other lengths than the anchor's score nothing with it; an anchor's other rows are those of other ids;
of several anchor rows with one id the least by label and vector serves; other repeated rows count each (ties to the smaller
id, repeated ids in any order); an anchor without positives has no rows, nor has a positive whose shares hold no negative
(any with a score below 0); fewer rows than asked for are all returned; an empty table gives none; columns besides id, label
and vector are not read. Scores are exact as long as they and the squares' sums are below 2**53.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Rows of a leaf, anchors of a leaf, rows of a slice, anchors of a group, rows of a cell that are aimed at, cells at most.
LEAF, ANCHOR_LEAF, SLICE, GROUP, CELL, MOST_CELLS = 64, 16, 1 << 15, 1 << 11, 1 << 12, 256


def usable(vectors: DataFrame, label: Column, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(_id, _label, _v array<double> of whole numbers), without rows that take no part."""
    v = F.col(vector_col)
    good = F.col(id_col).isNotNull() & label.isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(good).select(F.col(id_col).cast("long").alias("_id"), label.cast("long").alias("_label"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("_v"))


# --- trees ------------------------------------------------------------------------------------------------------------


class Tree:
    """Balls over rows: `order` holds the rows, a node those from `start` to `end`, and two children follow each that is no leaf.

    Nodes part by label first and then by distance."""

    def __init__(self, v: np.ndarray, label: np.ndarray, leaf: int):
        order, nodes, todo = np.arange(len(v)), [], [(0, len(v), -1)] if len(v) else []
        while todo:
            start, end, parent = todo.pop()
            own = order[start:end]
            x, labels = v[own], label[own]
            center = x.mean(0)
            radius = float(np.sqrt(((x - center) ** 2).sum(1).max())) * (1 + 1e-9) + 1e-9
            number = len(nodes)
            nodes.append([start, end, -1, center, radius, labels.min(), labels.max()])
            if parent >= 0:
                nodes[parent][2] = number  # the second child stands last, the first just after its parent
            if end - start <= leaf:
                continue
            if labels.min() != labels.max():
                inside = np.argsort(labels, kind="stable")
                edges = np.flatnonzero(np.diff(labels[inside])) + 1
                middle = int(edges[np.abs(edges - len(own) // 2).argmin()])
            else:
                inside, middle = self.parted(x, center)
            order[start:end] = own[inside]
            todo += [(start + middle, end, number), (start, start + middle, -1)]
        self.order, dim = order, v.shape[1] if v.ndim == 2 else 0
        self.start, self.end, self.second = (np.array([n[k] for n in nodes], np.int64) for k in range(3))
        self.center = np.array([n[3] for n in nodes]).reshape(-1, dim)
        self.norm = np.sqrt((self.center**2).sum(1))
        self.radius = np.array([n[4] for n in nodes])
        self.least, self.most = (np.array([n[k] for n in nodes], np.int64) for k in (5, 6))

    @staticmethod
    def parted(x: np.ndarray, center: np.ndarray) -> tuple[np.ndarray, int]:
        """An order of rows and where to part it: at a wide gap in the distances from a far row, else at the median on the line
        through two far rows. Either part has a few hundredths of the rows at least."""
        one = x[int(((x - center) ** 2).sum(1).argmax())]
        far = np.sqrt(((x - one) ** 2).sum(1))
        by_distance, edge = np.argsort(far, kind="stable"), len(x) // 32
        gaps = np.diff(far[by_distance])[edge : len(x) - 1 - edge]
        if gaps.max() > 0.2 * far.max():
            return by_distance, edge + int(gaps.argmax()) + 1
        return np.argsort(x @ (x[int(far.argmax())] - one), kind="stable"), len(x) // 2

    def children(self, nodes: np.ndarray) -> np.ndarray:
        """The nodes with those that are no leaves replaced by their children."""
        inner = self.second[nodes] >= 0
        return np.concatenate([nodes[~inner], nodes[inner] + 1, self.second[nodes[inner]]])


def interval(center_a, norm_a, radius_a, center_b, norm_b, radius_b) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product of a row in a ball of the first side with one in balls of the second."""
    middle = center_a @ center_b.T
    reach = norm_a * radius_b + radius_a * norm_b + radius_a * radius_b
    slack = 1e-9 * (np.abs(middle) + reach) + 1e-6
    return middle - reach - slack, middle + reach + slack


# --- the search of one group in one slice -------------------------------------------------------------------------------


class Wanted:
    """What anchors look for: for each wish its anchor, the least and the largest score of use, and the k best so far."""

    def __init__(self, anchor: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.anchor, self.low, self.high, self.k, self.same = anchor, low.astype(float), high.astype(float), k, same
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0))] * len(anchor)

    def offer(self, wish: int, ids: np.ndarray, scores: np.ndarray) -> None:
        """Equal scores with the smaller id are kept; the least of k is the new limit."""
        i, s = np.concatenate([self.found[wish][0], ids]), np.concatenate([self.found[wish][1], scores])
        if len(s) > 4 * self.k:
            some = s >= np.partition(s, -self.k)[-self.k]
            i, s = i[some], s[some]
        order = np.lexsort((i, -s))[: self.k]
        self.found[wish] = i[order], s[order]
        if len(order) == self.k:
            self.low[wish] = max(self.low[wish], s[order[-1]])


def search(a_ids, a, a_label, c_ids, c, c_label, wanted: Wanted) -> None:
    """Fill `wanted` with candidates of another id and of the anchor's label (`same`) or another one."""
    left, right = Tree(a, a_label, ANCHOR_LEAF), Tree(c, c_label, LEAF)
    if not len(left.start) or not len(right.start):
        return
    place = np.empty(len(a), np.int64)
    place[left.order] = np.arange(len(a))
    at = place[wanted.anchor]  # of each wish: its anchor's place in the tree
    by_place = np.argsort(at, kind="stable")
    first = np.searchsorted(at[by_place], np.arange(len(a) + 1))
    todo = [(0, np.zeros(1, np.int64))]
    while todo:
        node, others = todo.pop()
        leaf = left.second[node] < 0
        wishes = by_place[first[left.start[node]] : first[left.end[node]]]
        if not len(wishes):
            continue
        while True:
            need, cap = wanted.low[wishes].min(), wanted.high[wishes].max()
            lo, hi = interval(left.center[node], left.norm[node], left.radius[node], right.center[others], right.norm[others], right.radius[others])
            stay = (hi >= need) & (lo <= cap)
            if wanted.same:
                stay &= (right.least[others] <= left.most[node]) & (right.most[others] >= left.least[node])
            else:
                stay &= ~((left.least[node] == left.most[node]) & (right.least[others] == left.least[node]) & (right.most[others] == left.least[node]))
            others, hi = others[stay], hi[stay]
            if not len(others) or not leaf or (right.second[others] < 0).all():
                break
            others = right.children(others)
        if not len(others):
            continue
        if not leaf:  # both sides are opened by a step
            others = right.children(others)
            todo += [(int(left.second[node]), others), (node + 1, others)]
            continue
        scored(left, right, node, others[np.argsort(-hi)], np.sort(-hi) * -1, wishes, at, a_ids, a, a_label, c_ids, c, c_label, wanted)


def scored(left, right, node, leaves, hi, wishes, at, a_ids, a, a_label, c_ids, c, c_label, wanted: Wanted) -> None:
    """Score the rows of a leaf of anchors with leaves of candidates exactly, most promising first, some leaves at a time."""
    anchors = left.order[left.start[node] : left.end[node]]
    mine = at[wishes] - left.start[node]
    step = 0
    while step < len(leaves):
        if hi[step] < wanted.low[wishes].min():
            return
        some = leaves[step : step + 8]
        step += 8
        rows = np.concatenate([right.order[right.start[n] : right.end[n]] for n in some])
        s = (a[anchors] @ c[rows].T)[mine]
        fit = (s >= wanted.low[wishes][:, None]) & (s <= wanted.high[wishes][:, None]) & (c_ids[rows] != a_ids[anchors][mine][:, None])
        alike = c_label[rows] == a_label[anchors][mine][:, None]
        fit &= alike if wanted.same else ~alike
        for w in np.flatnonzero(fit.any(1)).tolist():
            wanted.offer(int(wishes[w]), c_ids[rows[fit[w]]], s[w, fit[w]])


# --- Spark ------------------------------------------------------------------------------------------------------------


def matrix(col) -> tuple[np.ndarray, np.ndarray]:
    """Lengths and numbers of an Arrow column of arrays."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.diff(np.asarray(col.offsets)), np.asarray(col.flatten())


class Cells:
    """The top of the trees: cells for vectors of each length, with a bounded sample of rows."""

    def __init__(self, rows: list, cells: int):
        self.ids, self.label = np.array([r._id for r in rows], np.int64), np.array([r._label for r in rows], np.int64)
        self.dims = sorted({len(r._v) for r in rows})
        self.rows = {d: np.array([n for n, r in enumerate(rows) if len(r._v) == d]) for d in self.dims}
        self.v = {d: np.array([rows[n]._v for n in self.rows[d]], float) for d in self.dims}
        self.center, self.first, n = {}, {}, 0
        for d in self.dims:
            share = max(1, cells * len(self.rows[d]) // max(len(rows), 1))
            tree = Tree(self.v[d], np.zeros(len(self.v[d]), np.int64), max(1, -(-len(self.v[d]) // share)))
            ends = tree.second < 0
            self.center[d], self.first[d] = tree.center[ends], n
            n += int(ends.sum())
        self.n = n

    def of(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centre of each vector of one length, and its distance."""
        c = self.center[v.shape[1]]
        nearest = np.argmin((c * c).sum(1) - 2 * (v @ c.T), 1)
        return nearest + self.first[v.shape[1]], np.sqrt(((v - c[nearest]) ** 2).sum(1))


def indexed(rows: DataFrame, cells: Cells) -> DataFrame:
    """Every row with its cell and its distance from the cell's centre. Vectors of a length that the sample has not seen have
    a cell of their own for each length, after all others."""
    sent = rows.sparkSession.sparkContext.broadcast(cells)

    def put(it):
        top = sent.value
        for b in it:
            size, flat = matrix(b.column("_v"))
            first = np.cumsum(size) - size
            cell, far = np.empty(len(size), np.int32), np.zeros(len(size))
            for d in np.unique(size).tolist():
                own = np.flatnonzero(size == d)
                if d in top.center:
                    cell[own], far[own] = top.of(flat[first[own][:, None] + np.arange(d)])
                else:
                    cell[own], far[own] = top.n + d, np.inf
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "_cell", "_far"])

    return stored(rows.mapInArrow(put, "_id long, _label long, _v array<double>, _cell int, _far double"), "cells")


def limits(top: Cells, a_ids, a_label, v, wanted: Wanted) -> np.ndarray:
    """Of each wish the k-th best score in the sample, or what it had."""
    rows = top.rows.get(v.shape[1], np.zeros(0, np.int64))
    out = wanted.low.copy()
    if not len(rows):
        return out
    s = v @ top.v[v.shape[1]].T
    fit = top.ids[rows] != a_ids[:, None]
    alike = top.label[rows] == a_label[:, None]
    fit &= alike if wanted.same else ~alike
    for w, n in enumerate(wanted.anchor.tolist()):
        x = s[n, fit[n]]
        x = x[(x >= wanted.low[w]) & (x <= wanted.high[w])]
        if len(x) >= wanted.k:
            out[w] = max(out[w], np.partition(x, -wanted.k)[-wanted.k])
    return out


_WISHES = "_low array<double>, _high array<double>"


def with_limits(anchors: DataFrame, top: Cells, k: int, same: bool) -> DataFrame:
    """Anchors whose wishes' least scores have been raised to the k-th best of the sample."""
    sent = anchors.sparkSession.sparkContext.broadcast(top)

    def raised(it):
        for b in it:
            size, flat = matrix(b.column("_v"))
            n, low = matrix(b.column("_low"))
            high = matrix(b.column("_high"))[1]
            ids, label = np.asarray(b.column("_id")), np.asarray(b.column("_label"))
            first, at, out = np.cumsum(size) - size, np.cumsum(n) - n, low.astype(float).copy()
            for d in np.unique(size).tolist():
                for own in np.array_split(np.flatnonzero(size == d), -(-int((size == d).sum()) // 256)):
                    wishes = np.concatenate([at[r] + np.arange(n[r]) for r in own])
                    asked = Wanted(np.repeat(np.arange(len(own)), n[own]), low[wishes], high[wishes], k, same)
                    out[wishes] = limits(sent.value, ids[own], label[own], flat[first[own][:, None] + np.arange(d)], asked)
            col = pa.ListArray.from_arrays(pa.array(np.append(at, len(low)), pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([col if c == "_low" else b.column(c) for c in b.schema.names], b.schema.names)

    return anchors.mapInArrow(raised, anchors.schema)


def cell_pairs(top: Cells, wants: list, holds: list, same: bool) -> list[tuple[int, int]]:
    """Pairs of an anchors' cell and a candidates' cell that intervals do not leave out."""
    center = np.concatenate([top.center[d] @ np.eye(d, max(top.dims)) for d in top.dims]) if top.dims else np.zeros((0, 1))
    dim_of = {n: d for d in top.dims for n in range(top.first[d], top.first[d] + len(top.center[d]))}
    norm, out = np.sqrt((center**2).sum(1)), []
    for w in wants:
        for h in holds:
            known, other = dim_of.get(w._cell), dim_of.get(h._cell)
            if known is None or other is None:
                fit = w._cell == h._cell
            elif known != other:
                fit = False
            else:
                lo, hi = interval(center[w._cell], norm[w._cell], w.far * (1 + 1e-9), center[h._cell : h._cell + 1], norm[h._cell], h.far * (1 + 1e-9))
                fit = hi[0] >= w.low and lo[0] <= w.high
            if fit and same:
                fit = h.least <= w.most and h.most >= w.least
            elif fit:
                fit = not (w.least == w.most == h.least == h.most)
            if fit:
                out.append((w._cell, h._cell))
    return out


def best(anchors: DataFrame, rows: DataFrame, top: Cells, k: int, same: bool) -> DataFrame:
    """(_id, _wish, _found, _score, _rank): the k best rows for each wish of each anchor.

    anchors: _id, _label, _v, _cell, _far, and for each wish its _low and _high; rows: indexed."""
    spark = rows.sparkSession
    anchors = stored(with_limits(anchors, top, k, same), "anchors")
    wants = anchors.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("far"), F.min("_label").alias("least"), F.max("_label").alias("most"), F.min(F.array_min("_low")).alias("low"), F.max(F.array_max("_high")).alias("high")).orderBy("_cell").collect()
    holds = rows.groupBy("_cell").agg(F.count(F.lit(1)).alias("n"), F.max("_far").alias("far"), F.min("_label").alias("least"), F.max("_label").alias("most")).orderBy("_cell").collect()
    # neighbouring cells share a group of anchors up to its size; a larger cell has several
    band, n, bands, deals = 0, 0, {}, {}
    for w in wants:
        if n and n + w.n > GROUP:
            band, n = band + 1, 0
        bands[w._cell] = band
        n += w.n
        deals[band] = max(1, -(-n // GROUP))
    met = sorted({(bands[a], c) for a, c in cell_pairs(top, wants, holds, same)})
    cuts = {h._cell: max(1, -(-h.n // SLICE)) for h in holds}
    schema = "_band int, _cell int, _deals int, _cuts int"
    pairs = spark.createDataFrame([(b, c, deals[b], cuts[c]) for b, c in met], schema)  # at most cells x cells
    group_of = spark.createDataFrame(list(bands.items()), "_cell int, _band int")
    salt = lambda n: F.pmod(F.xxhash64("_id"), F.col(n)).cast("int")
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keys = ["_band", "_deal", "_cell", "_cut"]
    left = anchors.join(F.broadcast(group_of), "_cell").drop("_cell", "_far").join(F.broadcast(pairs), "_band").withColumn("_deal", salt("_deals")).withColumn("_cut", numbers("_cuts")).select(*keys, "_id", "_label", "_v", "_low", "_high")
    right = rows.join(F.broadcast(pairs), "_cell").withColumn("_cut", salt("_cuts")).withColumn("_deal", numbers("_deals")).select(*keys, "_id", "_label", "_v")

    def meet(key, a, c):
        out = []
        (a_size, a_flat), (c_size, c_flat) = matrix(a.column("_v")), matrix(c.column("_v"))
        (n, low), (_, high) = matrix(a.column("_low")), matrix(a.column("_high"))
        a_ids, a_label, c_ids, c_label = (x.column(y).to_numpy() for x in (a, c) for y in ("_id", "_label"))
        a_first, c_first, at = np.cumsum(a_size) - a_size, np.cumsum(c_size) - c_size, np.cumsum(n) - n
        for d in sorted({*a_size.tolist()} & {*c_size.tolist()}):
            own, other = np.flatnonzero(a_size == d), np.flatnonzero(c_size == d)
            wishes = np.concatenate([at[r] + np.arange(n[r]) for r in own])
            asked = Wanted(np.repeat(np.arange(len(own)), n[own]), low[wishes], high[wishes], k, same)
            search(a_ids[own], a_flat[a_first[own][:, None] + np.arange(d)], a_label[own], c_ids[other], c_flat[c_first[other][:, None] + np.arange(d)], c_label[other], asked)
            number = np.concatenate([np.arange(n[r]) for r in own])
            out += [(int(a_ids[own[asked.anchor[w]]]), int(number[w]), *found) for w, found in enumerate(asked.found)]
        sizes = np.array([len(x[2]) for x in out], np.int64)
        flat = lambda k, kind: np.repeat(np.array([x[k] for x in out], kind), sizes)
        joined = lambda k, kind: np.concatenate([np.zeros(0, kind), *(x[k] for x in out)]).astype(kind)
        return pa.table({"_id": flat(0, np.int64), "_wish": flat(1, np.int32), "_found": joined(2, np.int64), "_score": joined(3, np.int64)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "_id long, _wish int, _found long, _score long")
    order = Window.partitionBy("_id", "_wish").orderBy(F.desc("_score"), "_found")
    return found.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)


def mine(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 10, low: tuple[int, int] = (30, 100), high: tuple[int, int] = (90, 100), scale: float = 256.0, sample: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    is_anchor is a condition on the id. A negative's score s fits a positive's p if low[0] * p <= low[1] * s and
    high[1] * s <= high[0] * p, in whole numbers."""
    rows = usable(vectors, label, scale, id_col, vector_col)
    spark = rows.sparkSession
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64(F.lit(5), F.col("_id")), "_id", "_label", "_v").limit(sample).collect()
    least = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // CELL))
    top = Cells(drawn, max(1, min(least, MOST_CELLS, max(1, len(drawn) // 8))))
    index = indexed(rows, top)
    once = index.withColumnRenamed("_id", id_col).filter(is_anchor).withColumnRenamed(id_col, "_id").groupBy("_id").agg(F.min(F.struct("_label", "_v", "_cell", "_far")).alias("_r")).select("_id", "_r.*")
    edge = lambda x: F.array(F.lit(x).cast("double"))
    found = stored(best(once.withColumns({"_low": edge(float("-inf")), "_high": edge(float("inf"))}), index, top, positives, True), "positives")
    per = found.groupBy("_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "_found", "_score"))).alias("_p"))  # at most `positives` of each
    # least and largest whole score that fits; a positive whose shares hold none asks for nothing
    down = lambda x, by: (x - F.pmod(x, F.lit(by))) / F.lit(by)
    ends = F.transform("_p", lambda p: F.struct((-down(-p["_score"] * low[0], low[1])).alias("low"), down(p["_score"] * high[0], high[1]).alias("high")))
    lowest = F.transform(ends, lambda e: F.when(e["low"] <= e["high"], e["low"]).otherwise(F.lit(float("inf"))))
    asked = once.join(per.select("_id", lowest.alias("_low"), F.transform(ends, lambda e: e["high"]).alias("_high")), "_id")
    chosen = best(asked, index, top, negatives, False)
    return chosen.join(found.select("_id", (F.col("_rank") - 1).alias("_wish"), F.col("_found").alias("positive_id"), F.col("_score").alias("positive_score")), ["_id", "_wish"]).select(F.col("_id").alias("anchor_id"), "positive_id", F.col("_rank").alias("rank"), F.col("_found").alias("negative_id"), "positive_score", F.col("_score").alias("negative_score"))
