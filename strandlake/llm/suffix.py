"""Suffix-array dedup: every byte covered by a `length`-byte string that also starts anywhere else goes.

The sorted order of suffixes, its Burrows-Wheeler symbols and the common prefixes of neighbours are built column by column
for many pieces at once: each round puts one more symbol before every piece, right to left, and updates order and common
prefixes from those of the round before, which stand in files that are read and written from front to end.

How the collection is dealt to tasks: among the substrings of `anchor` bytes of a window of `length` bytes the one of the
least hash (ties: the leftmost) is the window's anchor. Equal windows have equal anchors at equal places, so windows
around different anchors never match, and windows around equal anchors match only if they start equally far before it.
Neighbouring windows with one anchor form a piece. Pieces meet by anchor and are aligned at it: a round inserts the same
column of all of them, and suffixes of one column are all that must be sorted together. Before that, one exchange of
anchor hashes finds the anchors that occur twice; other pieces cannot match. Equal pieces within a chunk are sent once.

A passage that very many different documents share gives its anchors more pieces than one task should sort. Of an anchor
with more than HOT pieces, the windows' 128-bit hashes are dealt over all tasks instead and counted there, as exactly and
with one entry for each chunk and window. So no task holds a group that grows with the input.

The bytes decide: hashes only choose what meets, besides equal pieces of one chunk and windows of hot anchors. The files of
a construction are scratch of the task, like a sort's spill: nothing else reads them and they go with it.

Defined cases: null, empty and short texts lose nothing; repeated rows are separate documents and so repeat each other;
null ids are ids like others; a text longer than a chunk is
read in segments that overlap by a window; an empty table gives an empty result; columns named like an added one are replaced. What is
left may be invalid UTF-8, so it is returned as binary.
"""

from __future__ import annotations

import hashlib
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BASE, BASE_INVERSE, BYTE_VALUES, binary_array, buffers, mix, n_buckets, n_tasks, numbers, prefix_hash, repeated, slices, span_hash, stored, with_repeated
from .substring import ROUTE_BASE, ROUTE_INVERSE

#: Pieces whose suffixes are sorted together, and pieces of one anchor beyond which its windows are counted by their hashes.
COLLECTION, HOT = 1 << 14, 1 << 14
#: Text bytes whose anchors are found at once: every byte needs some 64 for that.
CHUNK = 3 << 19
#: Low bits of a hash that give way to the place, so that the least is the leftmost of equal ones.
_PLACE = np.uint64((1 << 22) - 1)
_PIECES = "_key long, _id long, _hash long, _start int, _left int, _bytes binary, _runs binary"
_FOUND = "_id long, _hash long, _runs binary, _start int, _windows binary"


def segments(off: np.ndarray, length: int):
    """(first byte, last byte, text offsets) of what is hashed at once: the whole, or stretches of a text longer than a chunk.

    Stretches share length - 1 bytes, so every window stands in one of them; how a text is cut depends on it alone."""
    if off[-1] <= CHUNK:
        yield 0, int(off[-1]), off
        return
    for x in range(0, int(off[-1]) - length + 1, CHUNK):
        y = min(x + CHUNK + length - 1, int(off[-1]))
        yield x, y, np.array([0, y - x])


def pieces(data: np.ndarray, off: np.ndarray, length: int, anchor: int):
    """Of each document's pieces: anchor hash, first and last window start, anchor place; and each document's first piece."""
    wide = length - anchor + 1
    none = np.zeros(0, np.int64)
    prefix = prefix_hash(BYTE_VALUES[data])
    n = len(data) - anchor + 1
    lens = np.maximum(np.diff(off) - length + 1, 0)
    if not lens.sum():
        return np.zeros(0, np.uint64), none, none, none, np.zeros(len(off), np.int64), prefix
    at = np.arange(n)
    hashes = span_hash(prefix, at, at + anchor)
    low = max(_PLACE, np.uint64((1 << int(n).bit_length()) - 1))
    ranked = np.full(-(-n // wide) * wide, np.iinfo(np.uint64).max)
    ranked[:n] = hashes & ~low | at.astype(np.uint64)
    by = ranked.reshape(-1, wide)
    ahead = np.minimum.accumulate(by, 1).ravel()
    behind = np.minimum.accumulate(by[:, ::-1], 1)[:, ::-1].ravel()
    begins = np.concatenate([[0], np.cumsum(lens)])
    doc = np.repeat(np.arange(len(lens)), lens)
    start = np.arange(begins[-1]) - np.repeat(begins[:-1] - off[:-1], lens)
    place = (np.minimum(behind[start], ahead[start + wide - 1]) & low).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(start)) - 1
    first = np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(lens)))]).astype(np.int64)
    return hashes[place[new]], start[new], start[last], place[new], first, prefix


def columns_sorted(symbols: np.ndarray, length: int, starts: int):
    """Column-wise construction over aligned pieces; symbols: a row for each piece, 0 where it has none, else byte + 1.

    Yields, for each of the first `starts` columns from right to left, the pieces whose string of `length` symbols from that
    column on another piece has too. The Burrows-Wheeler symbols of a round are those that stand before the sorted suffixes."""
    m, width = symbols.shape
    with tempfile.TemporaryFile() as columns, tempfile.TemporaryFile() as state:
        np.ascontiguousarray(symbols[:, ::-1].T).tofile(columns)  # in the order of the rounds
        columns.seek(0)
        np.arange(m, dtype=np.int32).tofile(state)
        np.zeros(m, np.uint8).tofile(state)
        levels = max(1, int(m).bit_length())
        table = np.zeros((levels, m), np.uint8)
        log = np.zeros(m + 1, np.int8)
        for k in range(1, levels + 1):
            log[1 << k :] = k
        for column in range(width - 1, -1, -1):
            state.seek(0)
            order, common = np.fromfile(state, np.int32, m), np.fromfile(state, np.uint8, m)
            before = np.fromfile(columns, np.uint16, m)[order]
            to = np.argsort(before, kind="stable")
            # the common prefix of two suffixes that get the same symbol: one more than the least between them
            table[0] = common
            for k in range(1, levels):
                h = 1 << (k - 1)
                table[k, : m - h] = np.minimum(table[k - 1, : m - h], table[k - 1, h:])
            same = np.flatnonzero((before[to[1:]] == before[to[:-1]]) & (before[to[1:]] > 0)) + 1
            p, q = to[same - 1] + 1, to[same]
            k = log[q - p + 1]
            common = np.zeros(m, np.uint8)
            common[same] = np.minimum(np.minimum(table[k, p], table[k, q - (1 << k.astype(np.int64)) + 1]).astype(np.int64) + 1, length)
            order = order[to]
            state.seek(0)
            order.tofile(state)
            common.tofile(state)
            if column < starts:
                long = common == length
                long[:-1] |= long[1:]
                yield column, order[long]


def find(docs: DataFrame, length: int, anchor: int, id_col: str, text_col: str) -> DataFrame:
    """(_id, _hash, _runs array<binary>): int32 pairs of first and last start of repeated strings."""
    if not 0 < anchor <= length <= 255:
        raise ValueError("0 < anchor <= length <= 255")
    wide = length - anchor + 1
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))

    def keyer(data, off):
        parts = [pieces(data[x:y], lines, length, anchor) for x, y, lines in segments(off, length)]
        keys = np.concatenate([p[0] for p in parts])
        first = parts[0][4] if len(parts) == 1 else np.array([0, len(keys)])
        return keys, (mix(keys ^ ROUTE_BASE) >> np.uint64(32)).astype(np.uint32), first

    def sent(it):
        for b in it:
            data, off = buffers(b.column("_text"))
            for i, j in slices(off, CHUNK):
                told, upto = [np.unique(numbers(b.column("_at")[r])) for r in range(i, j)], 0
                for x, y, lines in segments(off[i : j + 1] - off[i], length):
                    found = pieces(data[off[i] + x : off[i] + y], lines, length, anchor)
                    whole = len(lines) == j - i + 1 and x == 0 and y == off[j] - off[i]
                    mine = told if whole else [told[0][(told[0] >= upto) & (told[0] < upto + len(found[0]))] - upto]
                    upto += len(found[0])
                    yield from packed(b.slice(i, j - i), data[off[i] + x : off[i] + y], lines, x, found, mine)

    def packed(rows, own, lines, before, found, told):
        """One row for each different piece among those told of, and one for each told that has an equal beside it."""
        keys, low, high, place, first, prefix = found
        doc = np.repeat(np.arange(len(told)), [len(x) for x in told])
        pick = np.concatenate([x + first[r] for r, x in enumerate(told)]).astype(np.int64)
        if not len(pick):
            return
        ids, hashes = rows.column("_id"), rows.column("_hash")
        keys, low, high, place = keys[pick], low[pick], high[pick], place[pick]
        left, end = place - low, high + length
        second = prefix_hash(BYTE_VALUES[own], ROUTE_BASE)
        name = np.stack([span_hash(prefix, low, end) ^ mix(left.astype(np.uint64) + np.uint64(1)), span_hash(second, low, end, ROUTE_INVERSE) ^ (end - low).astype(np.uint64)])
        order = np.lexsort(name)
        new = np.concatenate([[True], (name[:, order[1:]] != name[:, order[:-1]]).any(0)])
        count = np.diff(np.append(np.flatnonzero(new), len(order)))
        one, copied = order[new], order[np.repeat(count > 1, count)]
        one.sort()
        base = lines[doc] - before
        size = (end - low)[one]
        ends = np.cumsum(size)
        gather = np.arange(ends[-1]) + np.repeat(low[one] - (ends - size), size)
        yield batch(keys[one].view(np.int64), ids.take(pa.array(doc[one])), hashes.take(pa.array(doc[one])), (low - base)[one], left[one], binary_array(own[gather], np.concatenate([[0], ends]), False), None)
        if len(copied):
            spans = np.stack([(low - base)[copied], (high - base)[copied]], 1).astype("<i4")
            yield batch(None, ids.take(pa.array(doc[copied])), hashes.take(pa.array(doc[copied])), None, None, None, pa.array([x.tobytes() for x in spans], pa.binary()))

    def batch(key, ids, hashes, start, left, raw, runs):
        none = lambda t: pa.nulls(len(ids), t)
        return pa.record_batch([none(pa.int64()) if key is None else pa.array(key), ids, hashes, none(pa.int32()) if start is None else pa.array(start, pa.int32()), none(pa.int32()) if left is None else pa.array(left, pa.int32()), none(pa.binary()) if raw is None else raw, none(pa.binary()) if runs is None else runs], names=[x.split()[0] for x in _PIECES.split(", ")])

    def answers(held):
        t = pa.Table.from_batches(held).combine_chunks()
        take = lambda c, at: t.column(c).combine_chunks().take(pa.array(at))
        raw, off = buffers(t.column("_bytes"))
        start, left = np.asarray(t.column("_start")), np.asarray(t.column("_left"))
        m, size = t.num_rows, np.diff(off)
        symbols = np.zeros((m, wide - 1 + length), np.uint16)  # column wide - 1 is that of the anchor
        row = np.repeat(np.arange(m), size)
        symbols[row, np.arange(off[-1]) + np.repeat(wide - 1 - left - off[:-1], size)] = raw.astype(np.uint16) + 1
        del row
        hit = np.zeros((m, wide + 1), bool)
        for column, found in columns_sorted(symbols, length, wide):
            hit[found, column] = True
        edge = np.diff(hit.astype(np.int8), axis=1, prepend=0)
        edge[:, 0] = hit[:, 0]
        who, x = np.nonzero(edge == 1)
        y = np.nonzero(edge == -1)[1] - 1
        runs = (np.stack([x, y], 1) + (start + left - (wide - 1))[who][:, None]).astype("<i4")
        if len(who):
            yield answer(take("_id", who), take("_hash", who), pa.array([r.tobytes() for r in runs], pa.binary()))

    def answer(ids, hashes, spans=None, start=None, windows=None):
        return pa.record_batch([ids, hashes, pa.nulls(len(ids), pa.binary()) if spans is None else spans, pa.nulls(len(ids), pa.int32()) if start is None else start, pa.nulls(len(ids), pa.binary()) if windows is None else windows], names=[x.split()[0] for x in _FOUND.split(", ")])

    def windows(b):
        """Pieces of a hot anchor as the 128-bit hashes of their windows."""
        data, off = buffers(b.column("_bytes"))
        count = np.diff(off) - length + 1
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(off[:-1] - (ends - count), count)
        names = np.stack([span_hash(prefix_hash(BYTE_VALUES[data]), at, at + length), span_hash(prefix_hash(BYTE_VALUES[data], ROUTE_BASE), at, at + length, ROUTE_INVERSE)], 1)
        return answer(b.column("_id"), b.column("_hash"), None, b.column("_start"), binary_array(names.reshape(-1).view(np.uint8), 16 * np.concatenate([[0], ends]), False))

    def sorted_pieces(it):
        held, n = [], 0  # whole groups that wait for their construction
        group, size, last = [], 0, None  # the group that is being read; a hot one is passed on as it comes
        for b in it:
            told = b.filter(b.column("_key").is_null())
            if told.num_rows:
                yield answer(told.column("_id"), told.column("_hash"), told.column("_runs"))
            b = b.filter(b.column("_key").is_valid())
            if not b.num_rows:
                continue
            keys = np.asarray(b.column("_key"))
            cuts = np.flatnonzero(np.concatenate([[last is None or keys[0] != last], keys[1:] != keys[:-1]]))
            first = int(cuts[0]) if len(cuts) else len(keys)
            if first:
                group.append(b.slice(0, first))
                size += first
                if size > HOT:
                    yield from map(windows, group)
                    group = []
            if len(cuts):
                held += group
                n += size if group else 0
                group, size, last = [b.slice(int(cuts[-1]))], len(keys) - int(cuts[-1]), keys[-1]
                if cuts[-1] > first:
                    held.append(b.slice(first, int(cuts[-1]) - first))
                    n += int(cuts[-1]) - first
                if n >= COLLECTION:
                    yield from answers(held)
                    held, n = [], 0
        if held or group:
            yield from answers(held + group)

    def window_keyer(data, off):
        names = data.view("<u8").reshape(-1, 2)
        return names[:, 0], (names[:, 1] >> np.uint64(32)).astype(np.uint32), off // 16

    def placed(it):
        """Windows that repeat, as runs of one start each."""
        for b in it:
            start = np.asarray(b.column("_start"))
            at = [np.unique(numbers(x)) + s for x, s in zip(b.column("_at"), start)]
            yield pa.record_batch([b.column("_id"), b.column("_hash"), pa.array([np.stack([x, x], 1).astype("<i4").tobytes() for x in at], pa.binary())], names=["_id", "_hash", "_runs"])

    found = repeated(rows, keyer, False, "_id", "_text", CHUNK)
    chosen = with_repeated(rows, found, "_id", "_text", "inner").select("_id", "_hash", "_text", "_at").mapInArrow(sent, _PIECES)
    # answers have no key: they are dealt by document, so that copies do not meet
    dealt = chosen.repartition(n_tasks(n_buckets(docs, text_col)), F.coalesce("_key", F.xxhash64("_id", "_hash"))).sortWithinPartitions("_key")
    found = stored(dealt.mapInArrow(sorted_pieces, _FOUND), "runs", release=True)
    hot = found.filter(F.col("_windows").isNotNull()).select("_id", "_hash", "_start", "_windows")
    counted = with_repeated(hot, repeated(hot, window_keyer, False, "_id", "_windows"), "_id", "_windows", "inner")
    told = found.filter(F.col("_runs").isNotNull()).select("_id", "_hash", "_runs")
    spans = told.unionByName(counted.select("_id", "_hash", "_start", "_at").mapInArrow(placed, "_id long, _hash long, _runs binary"))
    return spans.groupBy("_id", "_hash").agg(F.collect_list("_runs").alias("_at"))


def remove_repeats(docs: DataFrame, length: int = 200, anchor: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with `_n_bytes`, `_n_removed`, `_spans` (first byte and the one after the last of each maximal removed run),
    `_kept` (what is left, binary) and `_kept_sha256`."""
    docs = docs.drop("_n_bytes", "_n_removed", "_spans", "_kept", "_kept_sha256", "_at")
    names = docs.columns

    def apply(it):
        for b in it:
            data, off = buffers(b.column(text_col))
            at = b.column("_at")
            gone, spans, kept, digest = [], [], [], []
            for r in range(b.num_rows):
                own = data[off[r] : off[r + 1]]
                if at[r].is_valid:
                    runs = numbers(at[r]).reshape(-1, 2)
                    runs = runs[np.argsort(runs[:, 0], kind="stable")]
                    upto = np.maximum.accumulate(runs[:, 1]) + length
                    new = np.flatnonzero(np.concatenate([[True], runs[1:, 0] > upto[:-1]]))
                    x, y = runs[new, 0], upto[np.append(new[1:], len(runs)) - 1]
                    spans.append([{"start": int(p), "end": int(q)} for p, q in zip(x, y)])
                    kept.append(b"".join(own[p:q].tobytes() for p, q in zip([0, *y], [*x, len(own)])))
                else:
                    spans.append([])
                    kept.append(own.tobytes())
                gone.append(int(off[r + 1] - off[r]) - len(kept[-1]))
                digest.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.record_batch([*(b.column(c) for c in names), pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))), pa.array(kept, pa.binary()), pa.array(digest, pa.string())], names=[*names, "_n_bytes", "_n_removed", "_spans", "_kept", "_kept_sha256"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_bytes", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_spans", span), T.StructField("_kept", T.BinaryType()), T.StructField("_kept_sha256", T.StringType())])
    return with_repeated(docs, find(docs, length, anchor, id_col, text_col), id_col, text_col).mapInArrow(apply, schema)
