"""Shared helpers: the shared folder, byte buffers of Arrow columns, words and their hashes."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import time
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT = "spark.checkpoint.dir"
SPACES = b" \t\n\x0b\x0c\r"
#: Java and SQL pattern of the separators between words.
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it. Only a local session may go without: it gets a temporary one."""
    where = spark.conf.get(CHECKPOINT, None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT} must name a folder that all machines share")
        where = "file://" + tempfile.mkdtemp(prefix="strandlake-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def released() -> None:
    """Give memory that this process has freed back to the machine: the pools of Arrow and of C keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def stored(df: DataFrame, name: str, release: bool = False, instead_of: DataFrame | None = None) -> DataFrame:
    """Write a DataFrame to the shared folder and read it back: cuts the lineage and survives lost executors.

    release: let Spark's cleaner remove the shuffle files of finished queries now, for those with large ones.
    instead_of: an earlier stored table that nothing else reads; it is removed once this one is written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for _ in range(2 * release):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
    if instead_of is not None:
        old = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(instead_of.stored_at)
        old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(old, True)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_words(text: Column) -> Column:
    """Number of words [^\\x20\\x09-\\x0D]+ of a text as long; null: 0."""
    bare = F.trim(text, F.lit(SPACES.decode()))
    return F.when(text.isNull() | (bare == ""), F.lit(0)).otherwise(F.size(F.split(bare, SPACE_CLASS))).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; lower() does the same, faster, where all characters are ASCII."""
    upper = "".join(map(chr, range(65, 91)))
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, upper, upper.lower()))


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m."""
    return F.crc32(doc_id.cast("string")) % F.lit(m)


# --- byte buffers -----------------------------------------------------------------------------------------------------


def buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
        if isinstance(col, pa.ChunkedArray):
            col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.large_binary())
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = col.fill_null(b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    raw = col.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def slices(off: np.ndarray, most: int = 2 << 20):
    """Ranges of rows of about `most` bytes; a longer row stands alone."""
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield at, min(to, n)
        at = to


def binary_array(data: np.ndarray, off: np.ndarray, as_text: bool) -> pa.Array:
    kind = pa.large_utf8() if as_text else pa.large_binary()
    arr = pa.Array.from_buffers(kind, len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return arr.cast(pa.utf8() if as_text else pa.binary())


# --- words ------------------------------------------------------------------------------------------------------------

_RNG = np.random.default_rng(20240229)
BYTE_VALUES = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_POWERS: dict[int, np.ndarray] = {}


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64."""
    have = _POWERS.get(int(base))
    if have is None or len(have) < n:
        out = np.ones(max(n, 1), np.uint64)
        out[1:] = base
        have = np.cumprod(out, dtype=np.uint64)
        if n <= 5 << 20:
            _POWERS[int(base)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits (one to one)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_hash(values: np.ndarray, base: np.uint64 = BASE) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values), base), out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, inverse: np.uint64 = BASE_INVERSE) -> np.ndarray:
    """Rabin-Karp hashes of spans, from prefix_hash of the whole."""
    return mix((prefix[end] - prefix[start]) * powers(len(prefix), inverse)[start])


def word_spans(data: np.ndarray, off: np.ndarray, separator: np.ndarray = IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and for each row (with one more at the end) its first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    gap = separator[data]
    first, last = np.empty(len(data), bool), np.empty(len(data), bool)
    first[0], first[1:] = True, gap[:-1]
    last[-1], last[:-1] = True, gap[1:]
    full = off[:-1][off[1:] > off[:-1]]
    first[full] = True
    last[full[1:] - 1] = True
    start = np.flatnonzero(first & ~gap)
    end = np.flatnonzero(last & ~gap) + 1
    return start, end, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """A hash of each word, block by block: few bytes at a time need eight bytes each."""
    table, out = BYTE_VALUES[LOWER] if lower else BYTE_VALUES, np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 18), "right")))
        base = start[at]
        out[at:to] = span_hash(prefix_hash(table[data[base : end[to - 1]]]), start[at:to] - base, end[at:to] - base)
        at = to
    return out


# --- keys that occur more than once -----------------------------------------------------------------------------------

#: Text bytes that are hashed together in a task, and text bytes for each bucket of keys (which bounds a task's memory).
#: Where executors have more memory than 3 GB, both may be raised by the session, so that blocks stay large in larger tables.
CHUNK_BYTES, BUCKET_BYTES = 3 << 20, 12 << 20
CHUNK_SETTING, BUCKET_SETTING = "strandlake.chunkBytes", "strandlake.bucketBytes"
#: Tasks that the buckets are dealt to, at most; a task takes its buckets one after the other.
MOST_TASKS = 8192
#: Answers after which those for the chunks read so far are handed on.
MEET_ENTRIES = 1 << 19
_BLOCK = "_home int, _bucket int, _ids binary, _nulls binary, _hashes binary, _counts binary, _keys binary, _at binary, _known boolean"
_NAMES = [x.split()[0] for x in _BLOCK.split(", ")]


def n_buckets(docs: DataFrame, text_col: str) -> int:
    spark = docs.sparkSession
    volume = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-volume // int(spark.conf.get(BUCKET_SETTING, str(BUCKET_BYTES)))))


def n_tasks(buckets: int) -> int:
    return min(buckets, MOST_TASKS)


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where in it each run begins (with one more at the end)."""
    order = np.argsort(keys)
    k = keys[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order, np.append(begin, len(k))


def ranks(ids: np.ndarray, null: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each document by id (null last) and text hash; equal ones share a place."""
    order = np.lexsort((hashes, ids, null))
    a = np.stack([null[order].astype(np.int64), ids[order], hashes[order]])
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], (a[:, 1:] != a[:, :-1]).any(0)])) if len(ids) else 0
    return out


def judged(keys, place, known, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which entries repeat (with `later`: start after the first of their key), and one entry of each key: its first.

    place: document rank and position in one number; known: the key is already known to occur twice."""
    order, begin = runs(keys)
    size = np.diff(begin)
    hit = np.zeros(len(keys), bool)
    if not len(keys):
        return hit, order
    one = order[begin[:-1]].copy()
    many = np.flatnonzero(size > 1)
    inside = np.repeat(size > 1, size)
    own, lens = order[inside], size[many]
    start = np.concatenate([[0], np.cumsum(lens)[:-1]]).astype(np.int64)
    if len(many):
        least = np.minimum.reduceat(place[own], start)
        first = np.lexsort((place[own], np.repeat(np.arange(len(many)), lens)))[start]
        one[many] = own[first]
        hit[own] = place[own] > np.repeat(least, lens) if later else True
    if not later:
        hit |= known
    return hit, one


def chunk_number(part: int, number: int) -> int:
    """31 bits for a task's chunk: the same in a retry, and apart for chunks of equal texts and ids."""
    return int(mix(np.array([part << 32 | number], np.uint64))[0]) & 0x7FFFFFFF


def repeated(docs: DataFrame, keyer, later: bool, id_col: str = "doc_id", text_col: str = "text", chunk: int | None = None) -> DataFrame:
    """Which of a document's keys occur elsewhere: (_id, _hash, _at array<binary>), the last holding int32 key numbers.

    keyer(bytes, offsets) returns (keys, bucket numbers 0..2**32-1, first key of each document). Each chunk of documents
    sends one entry for each of its distinct keys, so a key has as many entries as there are chunks at most. With `later`
    only entries after the first by (id, key number) count; rows of equal id are ordered by their text's hash, and rows
    equal in both count as one. Buckets are read whole by one task and hold about BUCKET_BYTES of text each. The answers
    for a chunk meet in a partition drawn for the chunk, whatever its texts are, and are read chunk by chunk.
    """
    n = n_buckets(docs, text_col)
    tasks = n_tasks(n)
    chunk = chunk or int(docs.sparkSession.conf.get(CHUNK_SETTING, str(CHUNK_BYTES)))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.xxhash64(text_col).alias("_hash"), F.col(text_col).alias("_text"))

    def blocks(it):
        part, number = TaskContext.get().partitionId(), 0
        for b in it:
            data, off = buffers(b.column("_text"))
            ids, null = np.asarray(b.column("_id").fill_null(0)), np.asarray(b.column("_id").is_null())
            hashes = np.asarray(b.column("_hash"))
            for i, j in slices(off, chunk):
                keys, route, first = keyer(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(keys):
                    continue
                own = ids[i:j], null[i:j], hashes[i:j]
                doc = np.repeat(np.arange(j - i), np.diff(first))
                at = np.arange(len(keys)) - first[doc]
                hit, one = judged(keys, (ranks(*own)[doc] << 32) | at, np.zeros(len(keys), bool), later)
                home = chunk_number(part, number)  # where this chunk's answers meet
                number += 1
                if hit.any():
                    yield block(home, home % n, own, doc[hit], at[hit])
                bucket = ((route.astype(np.uint64) * np.uint64(n)) >> np.uint64(32)).astype(np.uint16 if n < 1 << 16 else np.int64)
                sure = hit[one] & (not later)
                for known in (False, True):
                    mine = np.sort(one[sure == known])
                    mine = mine[np.argsort(bucket[mine], kind="stable")]
                    to = bucket[mine]
                    cuts = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1], [True]])) if len(mine) else np.zeros(1, np.int64)
                    for x, y in zip(cuts[:-1], cuts[1:]):
                        yield block(home, int(to[x]), own, doc[mine[x:y]], at[mine[x:y]], keys[mine[x:y]], known)

    def block(home, bucket, own, doc, at, keys=None, known=False):
        """Entries in the order of their documents as one row."""
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        some, counts = doc[first], np.diff(np.append(first, len(doc)))
        delta = np.diff(at, prepend=0)
        delta[first] = at[first]
        planes = np.ascontiguousarray(delta.astype("<u4").view(np.uint8).reshape(-1, 4).T)  # low bytes first: the rest compresses away
        cell = lambda x: pa.array([x], pa.binary())
        return pa.record_batch([pa.array([home], pa.int32()), pa.array([bucket], pa.int32()), *(cell(x[some].tobytes()) for x in own), cell(counts.astype("<u4").tobytes()), cell(None if keys is None else keys.tobytes()), cell(planes.tobytes()), pa.array([known])], names=_NAMES)

    def read(b, r):
        get = lambda c, t: np.frombuffer(b.column(c)[r].as_buffer(), t)
        counts, planes = get("_counts", "<u4").astype(np.int64), get("_at", np.uint8).reshape(4, -1)
        total = np.cumsum(np.ascontiguousarray(planes.T).view("<u4")[:, 0].astype(np.int64))
        starts = np.concatenate([[0], np.cumsum(counts)[:-1]])
        at = total - np.repeat(np.where(starts > 0, total[starts - 1], 0), counts)
        return (get("_ids", np.int64), get("_nulls", bool), get("_hashes", np.int64)), counts, at

    def whole(it):
        """One bucket after the other."""
        parts, last = [], None
        for b in it:
            for r, bucket in enumerate(b.column("_bucket").to_pylist()):
                if not b.column("_keys")[r].is_valid:
                    yield b.slice(r, 1)
                    continue
                if bucket != last and parts:
                    yield from bucketed(parts)
                    parts = []
                own, counts, at = read(b, r)
                parts.append((own, counts, at.astype(np.int32), np.frombuffer(b.column("_keys")[r].as_buffer(), np.uint64), b.column("_known")[r].as_py(), b.column("_home")[r].as_py()))
                last = bucket
        if parts:
            yield from bucketed(parts)

    def bucketed(parts):
        ids, null, hashes = (np.concatenate([p[0][k] for p in parts]) for k in range(3))
        doc = np.repeat(np.arange(len(ids)), np.concatenate([p[1] for p in parts]))
        at, keys = np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])
        known = np.repeat([p[4] for p in parts], [len(p[2]) for p in parts])
        hit, _ = judged(keys, (ranks(ids, null, hashes)[doc] << 32) | at, known, later)
        hit &= ~known  # its chunk has said so already
        answers, upto = [], 0
        for own, counts, at, _, _, home in parts:
            mine = hit[upto : upto + len(at)]
            upto += len(at)
            if mine.any():
                answers.append(block(home, 0, own, np.repeat(np.arange(len(counts)), counts)[mine], at[mine].astype(np.int64)))
                if len(answers) >= 64:
                    yield pa.Table.from_batches(answers).combine_chunks().to_batches()[0]
                    answers = []
        if answers:
            yield pa.Table.from_batches(answers).combine_chunks().to_batches()[0]

    def meet(it):
        """All answers for some chunks, which come one after the other: one row for each document."""
        parts, held, last = [], 0, None
        for b in it:
            for r, home in enumerate(b.column("_home").to_pylist()):
                if home != last and held >= MEET_ENTRIES:
                    yield from met(parts)
                    parts, held = [], 0
                parts.append(read(b, r))
                held, last = held + len(parts[-1][2]), home
        if parts:
            yield from met(parts)

    def met(parts):
        own = [np.concatenate([p[0][k] for p in parts]) for k in range(3)]
        doc, at = np.repeat(ranks(own[0], own[1], own[2]), np.concatenate([p[1] for p in parts])), np.concatenate([p[2] for p in parts])
        order = np.argsort(doc, kind="stable")
        doc, at = doc[order], at[order].astype("<i4")
        source = np.repeat(np.arange(len(own[0])), np.concatenate([p[1] for p in parts]))[order]
        begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        some = source[begin]
        for x in range(0, len(begin), 4096):
            y = min(x + 4096, len(begin))
            edge = np.append(begin, len(doc))[x : y + 1]
            packed = binary_array(at[edge[0] : edge[-1]].view(np.uint8), 4 * (edge - edge[0]), False)
            yield pa.record_batch([pa.array(own[0][some[x:y]], mask=own[1][some[x:y]]), pa.array(own[2][some[x:y]]), packed], names=["_id", "_hash", "_at"])

    sent = rows.mapInArrow(blocks, _BLOCK)
    dealt = sent.repartitionById(tasks, F.pmod("_bucket", F.lit(tasks)))
    found = (dealt.sortWithinPartitions("_bucket") if tasks < n else dealt).mapInArrow(whole, _BLOCK)
    found = found.repartitionById(tasks, F.pmod("_home", F.lit(tasks))).sortWithinPartitions("_home").mapInArrow(meet, "_id long, _hash long, _at binary")
    return stored(found, "repeated", release=True).groupBy("_id", "_hash").agg(F.collect_list("_at").alias("_at"))


def with_repeated(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text", how: str = "left") -> DataFrame:
    """The documents with their `_at`, null where nothing repeats."""
    found = found.select(F.col("_id").alias("_found_id"), F.col("_hash").alias("_found_hash"), "_at")
    rows = docs.drop("_at").withColumn("_text_hash", F.xxhash64(text_col))
    return rows.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("_found_id")) & (F.col("_text_hash") == F.col("_found_hash")), how).drop("_found_id", "_found_hash", "_text_hash")


def numbers(at) -> np.ndarray:
    """The key numbers of one document (an Arrow list scalar of binaries)."""
    if not at.is_valid:
        return np.zeros(0, np.int64)
    return np.concatenate([np.frombuffer(x, "<i4") for x in at.as_py()] or [np.zeros(0, np.int32)]).astype(np.int64)
