"""N-gram Jaccard join with adaptive multi-match prefixes.

A document is the set of its distinct shingles of `width` lower-cased (A-Z) words; a shorter one is one shingle, one
without words is empty and linked with nothing. Two documents link when den * |both| >= num * |either|.

1. One exchange tells which shingles occur in one document only. They stand first in the common order of tokens. Links lie
   in the others, so a document with too few of those is out at once. The others follow by the number of sets that hold them,
   in powers of two from `RARE` on, and by hash: what many sets share stands last, so prefixes seldom reach it and lists
   stay short as the collection grows.
2. The l-prefix of a set of n tokens has n - ceil(t * n) + l tokens; linked sets share l tokens of their l-prefixes at
   least. Each document takes the l whose cost is least: the summed lengths of the prefix's lists, and what verifying
   costs, since at most one in l of the rows counted can become a candidate. A pair needs min(l, l') shared tokens.
3. In a first round each list pairs its members with one pivot only. Verified links make components. A second round pairs
   members of different components in all lists, so that no link that joins two components is missed. Lists of more
   than `long_list` members meet block by block as matrices, so a group of thousands of copies does not make its pairs
   as rows. Equal sets are one set throughout.
   Where links are asked for, all pairs of sets of a component are compared the same way, and each document's are counted.
4. Components grow by alternating large-star and small-star steps over DataFrames, each step a written table.

Sets are compared by 60-bit hashes of their shingles, and equal sets found by 128 bits.

Defined cases: null text is empty; rows of equal id and text are copies like others; a null id is nobody's smallest id
unless all are null; an empty table gives an empty result; `drop_near_duplicates` passes all columns, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import buffers, mix, numbers, prefix_hash, repeated, slices, span_hash, stored, with_repeated, word_hashes, word_spans

#: Bytes of sets in a block, about.
BLOCK_BYTES = 4 << 20
#: Pairs of one set that are verified in one task, about.
SHARE = 256
#: A token in this many sets at most is rare; more frequent ones stand behind, the more the later.
RARE = 32
#: Sets in a block of those whose links are counted.
LINK_BLOCK = 512
OTHER = np.uint64(0x2545F4914F6CDD1D)


def shingle_sets(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending, and where each document begins."""
    start, end, first = word_spans(data, off)
    words = word_hashes(data, start, end, True)
    n_words = np.diff(first)
    n = np.maximum(n_words - width + 1, np.minimum(n_words, 1))
    begins = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = np.repeat(first[:-1] - begins[:-1], n) + np.arange(begins[-1])
    keys = span_hash(prefix_hash(words), at, np.minimum(at + width, first[1:][doc]))
    order = np.lexsort((keys, doc))
    keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
    return keys[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))]).astype(np.int64)


def sets(docs: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, _n, _k, _shared): size, 128-bit name and those hashes that other documents have too, null without hope of a link."""

    def keyer(data, off):
        keys, first = shingle_sets(data, off, width)
        return keys, (mix(keys ^ OTHER) >> np.uint64(32)).astype(np.uint32), first

    def made(it):
        for b in it:
            data, off = buffers(b.column("_text"))
            at = b.column("_at")
            for i, j in slices(off):
                keys, first = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], width)
                n = np.diff(first)
                halves = [np.concatenate([[np.uint64(0)], np.cumsum(mix(x), dtype=np.uint64)]) for x in (keys, ~keys)]
                names = np.stack([h[first[1:]] - h[first[:-1]] for h in halves], 1)
                shared = []
                for r in range(j - i):
                    own = numbers(at[i + r]) if at[i + r].is_valid else ()
                    own = np.unique(own) if len(own) else ()
                    shared.append(keys[first[r] + own].tobytes() if len(own) and den * len(own) >= num * n[r] else None)
                yield pa.record_batch([b.column("_id").slice(i, j - i), b.column("_hash").slice(i, j - i), pa.array(n), pa.array([x.tobytes() if m else None for x, m in zip(names, n)], pa.binary()), pa.array(shared, pa.binary())], names=["_id", "_hash", "_n", "_k", "_shared"])

    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text"))
    found = repeated(rows, keyer, False, "_id", "_text")
    rows = with_repeated(rows.withColumn("_hash", F.xxhash64("_text")), found, "_id", "_text")
    return stored(rows.select("_id", "_hash", "_text", "_at").mapInArrow(made, "_id long, _hash long, _n long, _k binary, _shared binary"), "sets", release=True)


def by_frequency(reps: DataFrame) -> DataFrame:
    """`reps` with the tokens of `_shared` named anew: the upper 4 bits say how frequent one is, so frequent ones stand last."""

    def tokens(it):
        for b in it:
            own = [np.frombuffer(x.as_buffer(), np.int64) for x in b.column("_shared")]
            k = b.column("_k").take(pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own])))
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *own])), k], names=["_token", "_k"])

    def named(it):
        for b in it:
            out = []
            for x, found, level in zip(b.column("_shared"), b.column("_found"), b.column("_level")):
                own = np.frombuffer(x.as_buffer(), np.uint64)
                new = own >> np.uint64(4)
                if found.is_valid:
                    which = np.searchsorted(own, np.asarray(found.values).view(np.uint64))
                    new[which] |= np.asarray(level.values).astype(np.uint64) << np.uint64(60)
                new.sort()
                out.append(new.tobytes())
            yield pa.record_batch([*(b.column(c) for c in kept), pa.array(out, pa.binary())], names=[*kept, "_shared"])

    kept = [c for c in reps.columns if c != "_shared"]
    rows = reps.select("_k", "_shared").mapInArrow(tokens, "_token long, _k long")
    # an entry each for the frequent tokens alone is joined back; 15 levels of twice the sets each
    level = F.least(F.ceil(F.log2(F.count(F.lit(1)) / F.lit(float(RARE)))), F.lit(15)).cast("long")
    often = stored(rows.groupBy("_token").agg(level.alias("_level")).filter("_level > 0"), "frequent")
    found = rows.join(often, "_token").groupBy("_k").agg(F.collect_list(F.struct("_token", "_level")).alias("_f"))
    found = found.select("_k", F.col("_f._token").alias("_found"), F.col("_f._level").alias("_level"))
    return reps.join(found, "_k", "left").select(*kept, "_shared", "_found", "_level").mapInArrow(named, reps.select(*kept, "_shared").schema)


def postings(reps: DataFrame, num: int, den: int, most: int) -> DataFrame:
    """(_token, _k, _n, _l): the tokens of each set's adaptive prefix that another prefix of length `most` has too."""

    def prefixes(it):
        for b in it:
            n = np.asarray(b.column("_n"))
            tokens, places = [], []
            for r, x in enumerate(b.column("_shared")):
                own = np.frombuffer(x.as_buffer(), np.int64)
                need = -(-num * int(n[r]) // den)
                longest = len(own) - need + min(most, need)  # of the shared ones: those in one document only stand before
                tokens.append(own[: max(longest, 0)])
                places.append(np.arange(len(tokens[-1])) - (len(own) - need))  # number l of the first prefix that has it, less 1
            size = [len(x) for x in tokens]
            row = np.repeat(np.arange(len(size)), size)
            yield pa.record_batch([pa.array(np.concatenate([np.zeros(0, np.int64), *tokens])), b.column("_k").take(pa.array(row)), pa.array(n[row]), pa.array(np.concatenate([np.zeros(0, np.int64), *places]))], names=["_token", "_k", "_n", "_place"])

    rows = stored(reps.select("_k", "_n", "_shared").mapInArrow(prefixes, "_token long, _k long, _n long, _place long"), "prefixes")
    lists = rows.groupBy("_token").agg((F.count(F.lit(1)) - 1).alias("_others")).filter("_others > 0")
    rows = rows.join(lists, "_token")
    own = Window.partitionBy("_k")
    need = F.ceil(F.col("_n") * num / F.lit(float(den)))
    best = F.lit(None).cast("struct<cost:double,l:int>")
    for n in range(most, 0, -1):
        scanned = F.sum(F.when(F.col("_place") < n, F.col("_others")).otherwise(0)).over(own)
        cost = F.struct((scanned * (1 + (8 + F.col("_n") / 16) / n)).alias("cost"), F.lit(n).alias("l"))
        best = F.when(need >= n, F.least(cost, best)).otherwise(best)
    return rows.withColumn("_l", F.coalesce(best["l"], F.lit(1))).filter(F.col("_place") < F.col("_l")).select("_token", "_k", "_n", "_l")


def verified(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (_a, _b) that link."""

    def exact(it):
        for b in it:
            a_n, b_n, keep = np.asarray(b.column("_a_n")), np.asarray(b.column("_b_n")), []
            for r, (x, y) in enumerate(zip(b.column("_a_shared"), b.column("_b_shared"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                at = np.searchsorted(y, x)
                both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                keep.append(den * both >= num * (int(a_n[r]) + int(b_n[r]) - both))
            yield b.filter(pa.array(keep, pa.bool_())).select(["_a", "_b"])

    side = lambda s: reps.select(F.col("_k").alias(s), F.col("_n").alias(f"{s}_n"), F.col("_shared").alias(f"{s}_shared"))
    # a pivot may have very many pairs: they are dealt over several copies of its set
    pairs = stored(pairs.select("_a", "_b"), "pairs")
    shares = pairs.groupBy("_a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(SHARE))).alias("_shares"))
    copies = shares.join(side("_a"), "_a").withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop("_shares")
    dealt = pairs.join(shares, "_a").withColumn("_share", F.pmod(F.xxhash64("_b"), F.col("_shares"))).drop("_shares")
    return dealt.join(copies, ["_a", "_share"]).join(side("_b"), "_b").mapInArrow(exact, "_a long, _b long")


def in_common(x, y) -> np.ndarray:
    """How many hashes each member of x has in common with each of y."""
    keys, owner = [np.concatenate(v) for v in (x, y)], [np.repeat(np.arange(len(v)), [len(s) for s in v]) for v in (x, y)]
    known = np.intersect1d(keys[0], keys[1])
    at = [np.searchsorted(known, k) for k in keys]
    ok = [known[np.minimum(a, len(known) - 1)] == k if len(known) else np.zeros(len(k), bool) for a, k in zip(at, keys)]
    both = np.zeros((len(x), len(y)), np.float32)
    order = [np.flatnonzero(o)[np.argsort(a[o], kind="stable")] for a, o in zip(at, ok)]
    for low in range(0, len(known), 2048):
        part = []
        for v, (a, own, o) in zip((x, y), zip(at, owner, order)):
            own_at = a[o]
            i, j = np.searchsorted(own_at, [low, low + 2048])
            m = np.zeros((len(v), 2048), np.float32)
            m[own[o[i:j]], own_at[i:j] - low] = 1
            part.append(m)
        both += part[0] @ part[1].T
    return both


def dense_links(lists: DataFrame, reps: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(_a, _b) that join what links within each list, for long ones: blocks of members meet as matrices, no pair is a row.

    A pair of blocks yields each member with the first of its component there, so two rows for each member at most."""

    def met(it):
        for b in it:
            for r in range(b.num_rows):
                side = []
                for c in ("_x", "_y"):
                    m = b.column(c)[r].values
                    side.append(([np.frombuffer(s.as_buffer(), np.uint64) for s in m.field("_shared")], np.asarray(m.field("_n")), m.field("_k").to_pylist()))
                (x, xn, xk), (y, yn, yk) = side
                both = in_common(x, y)
                linked = den * both >= num * (xn[:, None] + yn[None, :] - both)
                label_x, label_y = np.arange(len(x)), np.full(len(y), len(x))
                while True:  # the smallest label of whatever is connected
                    new_y = np.minimum(label_y, np.where(linked, label_x[:, None], len(x)).min(0))
                    new_x = np.minimum(label_x, np.where(linked, new_y[None, :], len(x)).min(1))
                    if (new_x == label_x).all() and (new_y == label_y).all():
                        break
                    label_x, label_y = new_x, new_y
                found = [(xk[i], xk[j]) for i, j in enumerate(label_x) if i != j] + [(yk[i], xk[j]) for i, j in enumerate(label_y) if j < len(x) and yk[i] != xk[j]]
                if found:
                    yield pa.record_batch([pa.array(v, pa.int64()) for v in zip(*found)], names=["_a", "_b"])

    members = lists.select("_token", "_k", "_size").join(reps.select("_k", "_n", "_shared"), "_k")
    volume = members.groupBy("_token").agg(F.sum(F.octet_length("_shared")).alias("_bytes"))
    members = members.join(volume, "_token")
    cut = F.pmod(F.xxhash64("_k"), F.greatest(F.ceil(F.col("_size") / F.lit(float(block))), F.ceil(F.col("_bytes") / F.lit(float(BLOCK_BYTES)))))
    blocks = members.groupBy("_token", cut.alias("_block")).agg(F.collect_list(F.struct("_k", "_n", "_shared")).alias("_x"))
    other = blocks.select("_token", F.col("_block").alias("_other"), F.col("_x").alias("_y"))
    return blocks.join(other, "_token").filter("_block <= _other").select("_x", "_y").mapInArrow(met, "_a long, _b long")


def grouped(links: DataFrame, name: str) -> DataFrame:
    """(_k, _c): for every linked node the smallest of its component, by alternating large-star and small-star steps."""
    edges, before = stored(links.select(F.greatest("_a", "_b").alias("_u"), F.least("_a", "_b").alias("_v")).distinct(), name), None
    while True:
        held = edges
        told = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first()
        if told == before or not told[0]:
            return edges.select(F.col("_u").alias("_k"), F.col("_v").alias("_c"))
        before = told
        both = edges.union(edges.select("_v", "_u")).toDF("_u", "_v")
        low = both.groupBy("_u").agg(F.least(F.min("_v"), F.first("_u")).alias("_m"))
        edges = both.join(low, "_u").filter(F.col("_v") > F.col("_u")).select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).filter("_u <> _v").distinct()
        low = edges.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = edges.join(low, "_u")
        edges = small.select("_v", "_m").union(small.select("_u", "_m")).toDF("_u", "_v").filter("_u <> _v").distinct()
        edges = stored(edges, name, instead_of=held)


def link_counts(groups: DataFrame, reps: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(_k, _links): with how many documents a set's documents link, those of equal sets not counted.

    Links stay within components, so the sets of each are compared there, every pair once. Sets are cut by size, so that
    only neighbouring classes of size can link, and classes into blocks, which meet two by two as matrices. No pair is a row."""
    width = np.log(den / num) * (1 + 1e-6)
    everyone = groups.select("_k", "_c").union(groups.select(F.col("_c").alias("_k"), "_c").distinct())
    members = everyone.join(reps.select("_k", "_n", "_shared", "_copies"), "_k").withColumn("_class", F.floor(F.log("_n") / F.lit(float(width))))
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(float(block))), F.ceil(F.sum(F.octet_length("_shared")) / F.lit(float(BLOCK_BYTES))))
    sizes = stored(members.groupBy("_c", "_class").agg(parts.alias("_parts")), "sizes")
    cells = F.collect_list(F.struct("_k", "_n", "_shared", "_copies"))
    blocks = stored(members.join(sizes, ["_c", "_class"]).groupBy("_c", "_class", F.pmod(F.xxhash64("_k"), "_parts").alias("_block")).agg(cells.alias("_x")), "blocks", release=True)
    index = blocks.select("_c", "_class", "_block")
    other = index.select("_c", F.col("_class").alias("_class2"), F.col("_block").alias("_block2"))
    after = (F.col("_class2") == F.col("_class") + 1) | ((F.col("_class2") == F.col("_class")) & (F.col("_block2") >= F.col("_block")))
    pairs = index.join(other, "_c").filter(after)
    both = pairs.join(blocks, ["_c", "_class", "_block"]).join(blocks.select("_c", F.col("_class").alias("_class2"), F.col("_block").alias("_block2"), F.col("_x").alias("_y")), ["_c", "_class2", "_block2"])
    same = (F.col("_class") == F.col("_class2")) & (F.col("_block") == F.col("_block2"))

    def met(it):
        for b in it:
            for r in range(b.num_rows):
                side = []
                for c in ("_x", "_y"):
                    m = b.column(c)[r].values
                    side.append(([np.frombuffer(s.as_buffer(), np.uint64) for s in m.field("_shared")], *(np.asarray(m.field(f)) for f in ("_n", "_k", "_copies"))))
                (x, xn, xk, xc), (y, yn, yk, yc) = side
                common = in_common(x, y)
                linked = den * common >= num * (xn[:, None] + yn[None, :] - common)
                if b.column("_same")[r].as_py():
                    linked &= xk[:, None] != yk[None, :]
                    k, n = xk, linked @ yc
                else:
                    k, n = np.concatenate([xk, yk]), np.concatenate([linked @ yc, xc @ linked])
                yield pa.record_batch([pa.array(k), pa.array(n.astype(np.int64))], names=["_k", "_links"])

    return both.select("_x", "_y", same.alias("_same")).mapInArrow(met, "_k long, _links long").groupBy("_k").agg(F.sum("_links").alias("_links"))


def labelled(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, most: int = 4, long_list: int = 64, block: int = 512, id_col: str = "doc_id", text_col: str = "text", links: bool = False) -> DataFrame:
    """One row per document: (_id, _hash, _n, _component, _component_id), the last the smallest id of its component.

    _hash is xxhash64 of the text; _component is null for a document that has no partner in sight. Other columns are not
    carried. links: also `_n_links`, the number of other documents that a document links with, copies each counted."""
    rows = sets(docs, width, num, den, id_col, text_col)
    hopeful = rows.filter("_shared is not null")
    reps = hopeful.groupBy(F.col("_k").alias("_name")).agg(F.first("_n").alias("_n"), F.first("_shared").alias("_shared"), F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_copies"))
    reps = stored(reps.withColumn("_k", F.monotonically_increasing_id()), "reps")  # short names, fixed by the table
    reps = stored(by_frequency(reps), "ordered", release=True)
    lists = stored(postings(reps, num, den, most), "postings")

    # first round: every list's pivot with its other members
    pivot = lists.groupBy("_token").agg(F.min(F.struct("_k", "_n", "_l")).alias("_p"))
    fit = lambda a, b: (den * F.least(a, b) >= num * F.greatest(a, b))
    stars = lists.join(pivot, "_token").filter((F.col("_k") != F.col("_p._k")) & fit(F.col("_n"), F.col("_p._n")))
    stars = stars.groupBy(F.col("_p._k").alias("_a"), F.col("_k").alias("_b")).agg(F.count(F.lit(1)).alias("_shares"), F.first(F.least("_l", "_p._l")).alias("_need")).filter("_shares >= _need")
    links = stored(verified(stars, reps, num, den), "links")
    groups = grouped(links, "groups")

    # second round: members of different components, in the lists that have any
    rest = lists.join(groups, "_k", "left").withColumn("_c", F.coalesce("_c", "_k"))
    mixed = rest.groupBy("_token").agg(F.min("_c").alias("_x"), F.max("_c").alias("_y"), F.count(F.lit(1)).alias("_size")).filter("_x <> _y").select("_token", "_size")
    rest = stored(rest.join(mixed, "_token"), "mixed")
    # pairs that meet in a long list are compared there, so the short lists alone decide on the others
    short = rest.filter(F.col("_size") <= long_list)
    a, b = (short.select("_token", *(F.col(c).alias(f"{s}{c}") for c in ("_k", "_n", "_l", "_c"))) for s in ("_a", "_b"))
    pairs = a.join(b, "_token").filter((F.col("_a_c") < F.col("_b_c")) & fit(F.col("_a_n"), F.col("_b_n")))
    pairs = pairs.groupBy(F.col("_a_k").alias("_a"), F.col("_b_k").alias("_b")).agg(F.count(F.lit(1)).alias("_shares"), F.first(F.least("_a_l", "_b_l")).alias("_need")).filter("_shares >= _need")
    more = verified(pairs, reps, num, den).union(dense_links(rest.filter(F.col("_size") > long_list), reps, num, den, block))
    groups = grouped(groups.select(F.col("_k").alias("_a"), F.col("_c").alias("_b")).union(more), "components")

    named = reps.join(groups, "_k", "left").select("_k", "_name", "_least", "_copies", F.coalesce("_c", "_k").alias("_component"))
    least = named.groupBy("_component").agg(F.min("_least").alias("_component_id"))
    named = named.join(least, "_component").select("_k", F.col("_name").alias("_r"), "_component", "_component_id", (F.col("_copies") - 1).alias("_n_links"))
    if links:
        counts = link_counts(groups, reps, num, den, LINK_BLOCK)
        named = named.join(counts, "_k", "left").withColumn("_n_links", F.col("_n_links") + F.coalesce("_links", F.lit(0))).drop("_links")
    named = stored(named.drop("_k"), "named")
    out = rows.withColumn("_k", F.when(F.col("_shared").isNotNull(), F.col("_k"))).join(named, F.col("_k") == F.col("_r"), "left")
    out = out.select("_id", "_hash", "_n", "_component", F.when(F.col("_component").isNull(), F.col("_id")).otherwise(F.col("_component_id")).alias("_component_id"), F.coalesce("_n_links", F.lit(0)).alias("_n_links"))
    return out if links else out.drop("_n_links")


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """One document of each component stays, that of the smallest id (ties: the smallest hash of the text; of equal rows any one)."""
    classes = labelled(docs, width, num, den, id_col=id_col, text_col=text_col, **more).filter("_component is not null")
    kept = classes.groupBy("_component").agg(F.min(F.struct(F.col("_id").isNull().alias("null"), F.col("_id").alias("_id"), F.col("_hash").alias("_hash"))).alias("_w"))
    marks = classes.select("_id", "_hash").distinct().join(kept.select(F.col("_w._id").alias("_wi"), F.col("_w._hash").alias("_wh")), F.col("_id").eqNullSafe(F.col("_wi")) & (F.col("_hash") == F.col("_wh")), "left")
    marks = marks.select(F.col("_id").alias("_mark_id"), F.col("_hash").alias("_mark_hash"), F.col("_wh").isNotNull().alias("_stays"))
    own = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    rows = docs.select(own.alias("_doc"), F.col(id_col).cast("long").alias("_row_id"), F.xxhash64(text_col).alias("_row_hash"))
    rows = rows.join(marks, F.col("_row_id").eqNullSafe(F.col("_mark_id")) & (F.col("_row_hash") == F.col("_mark_hash")), "left").filter(F.coalesce("_stays", F.lit(True)))
    copy = F.row_number().over(Window.partitionBy("_row_id", "_row_hash").orderBy(F.lit(1)))
    return rows.withColumn("_copy", copy).filter(F.col("_stays").isNull() | (F.col("_copy") == 1)).select("_doc.*")
