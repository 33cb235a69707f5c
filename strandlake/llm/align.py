"""Alignment of two tokenisations of one text, and counts of the linked token ids over the whole collection.

Each text, with a space before it, is encoded by a byte-level vocabulary (A) and by a piece vocabulary with byte fallback
(B). Byte offsets at which tokens of both end cut them into groups; every A token is linked with every B token of its group.
The count of a pair of ids is the number of documents that hold it linked, corpus-wide; a link is best where its count is
the highest of its A id.

Counting uses id-striped dense matrices: A id a belongs to stripe a % stripes, whose task holds a block of counts with a row
for each of its A ids and a column for each B id. Chunks of documents send one entry for each of their different pairs,
np.add.at adds them to the block, and row maxima give the best counts. Scoring is co-partitioned with the links: those of a
stripe meet its block in one partition, one chunk after the other, and each chunk gets sums for its documents back. A stripe
whose links outgrow a task is dealt over several parts, which count by themselves and are added up. A block's size follows
from the vocabularies alone, and all else is read as a stream, so a token that stands in every document costs its stripe an
entry for each chunk, and a task no memory.

Neither vocabulary merges over a space between two words (B's pieces are tested for that), so texts are cut before such
spaces into units, each different one of which is encoded once a chunk; the tokens are those of the whole text.

Defined cases: texts null, empty, or whose joined bytes of A or of B differ from space and text have no tokens, zeros
throughout and empty groups; repeated rows and null ids are rows of their own and count each; an empty table stays empty; a
text longer than a chunk is read in segments; a text without spaces is one unit and encoded whole. Columns besides the id do
not travel.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffers, slices, stored

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
A_SETTING, B_SETTING = "strandlake.byteTokenizer", "strandlake.pieceTokenizer"
STRIPES = 192
#: Bytes of text encoded together, and links of a stripe in one task, about.
CHUNK, PART_LINKS = 3 << 20, 1 << 27
#: Bits of an id in a key of two ids.
ID_BITS = 20
_ID = np.uint64((1 << ID_BITS) - 1)
_FIGURES = ("n_a", "n_b", "n_groups", "n_links")


# --- vocabularies -----------------------------------------------------------------------------------------------------


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies: itself where printable, else one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Bytes:
    """The bytes of every token of a vocabulary: all in a row, and where each begins."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.array([len(x) for x in tokens], np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        return self.data[spread(self.first[ids], self.size[ids])]


class Pair:
    """Both tokenizers of a worker."""

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        import sentencepiece
        import tokenizers

        self.a, self.b = tokenizers.Tokenizer.from_file(a_file), sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.a.encode_special_tokens = True
        alphabet, names = byte_alphabet(), self.a.get_vocab(with_added_tokens=True)
        tokens = [b""] * (max(names.values()) + 1)
        for name, i in names.items():
            known = all(c in alphabet for c in name)
            tokens[i] = bytes(alphabet[c] for c in name) if known else name.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = Bytes(tokens)
        self.b_bytes = Bytes([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])
        #: whether texts may be cut before a space: no piece goes over it
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)
        if max(len(tokens), len(pieces)) > 1 << ID_BITS:
            raise ValueError(f"ids of more than {ID_BITS} bits")

    def encode(self, units: list[str], size: np.ndarray, joins: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """The ids of all units on either side, and how many each has.

        Units begin with a space and have `size` bytes; those that `joins` may stand one after the other in a call of A."""
        together, alone = np.flatnonzero(joins), np.flatnonzero(~joins)
        some = [units[k] for k in together.tolist()]
        ids, _ = flat([x.ids for x in self.a.encode_batch_fast(["".join(some[k : k + 64]) for k in range(0, len(some), 64)], add_special_tokens=False)])
        ends, cuts = np.cumsum(self.a_bytes.size[ids]), np.cumsum(size[together])
        if len(cuts) and (not len(ends) or ends[-1] != cuts[-1]):  # A has changed a text
            together, alone, ids, ends, cuts = together[:0], np.arange(len(units)), ids[:0], ends[:0], cuts[:0]
        rest, n_rest = flat([x.ids for x in self.a.encode_batch_fast([units[k] for k in alone.tolist()], add_special_tokens=False)])
        n = np.zeros(len(units), np.int64)
        n[together] = np.diff(np.searchsorted(ends, cuts, "right"), prepend=0)
        n[alone] = n_rest
        first = np.zeros(len(units), np.int64)
        first[together], first[alone] = np.cumsum(n[together]) - n[together], len(ids) + np.cumsum(n_rest) - n_rest
        return [(np.concatenate([ids, rest])[spread(first, n)], n), flat(self.b.encode([u[1:] for u in units], num_threads=1))]


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a row, and how many each list has."""
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(n.sum())), n


@functools.lru_cache(maxsize=1)
def pair(a_file: str, b_file: str) -> Pair:
    return Pair(a_file, b_file)


def files(spark: SparkSession, a_file: str | None, b_file: str | None) -> tuple[str, str]:
    return a_file or spark.conf.get(A_SETTING, A_FILE), b_file or spark.conf.get(B_SETTING, B_FILE)


# --- one chunk --------------------------------------------------------------------------------------------------------


def spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1 .. (n[0] of them), then those of first[1], and so on."""
    before = np.cumsum(n) - n
    return np.repeat(first - before, n) + np.arange(n.sum())


#: Decimal digits of small numbers, the last one first, and how many each has.
_NUMBERS = np.arange(1 << 17)
_DECIMALS = np.stack([np.where(_NUMBERS >= 10**k, 48 + _NUMBERS // 10**k % 10, 0) for k in range(7)], 1).astype(np.uint8)
_DECIMALS[0, 0] = 48
_N_DECIMALS = (_DECIMALS > 0).sum(1)


def written(ids: np.ndarray, mark: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decimal ids, each with the byte that follows it, and the length of each with that byte."""
    if len(ids) and ids.max() >= len(_DECIMALS):
        text = [str(i).encode() + bytes([m]) for i, m in zip(ids.tolist(), mark.tolist())]
        return np.frombuffer(b"".join(text), np.uint8), np.array([len(x) for x in text], np.int64)
    n = _N_DECIMALS[ids]
    cells = np.zeros((len(ids), 8), np.uint8)
    cells[:, 7] = mark
    cells[:, :7] = _DECIMALS[ids][:, ::-1]
    return cells[cells > 0], n + 1


class Units:
    """What each different unit of a segment holds: figures, groups as text, and its links as keys with their number."""

    def __init__(self, units: list[str], raw: np.ndarray, size: np.ndarray, tools: Pair):
        last = np.cumsum(size)
        # one that goes on with no white space after its space, and ends with none, has the same tokens between others
        joins = (size > 1) & _SAFE[raw[np.minimum(last - size + 1, max(len(raw) - 1, 0))]] & (raw[last - 1] > 32)
        (a, n_a), (b, n_b) = tools.encode(units, size, joins)
        self.good = self.same(a, n_a, tools.a_bytes, raw, size) & self.same(b, n_b, tools.b_bytes, raw, size)
        a, b = a[np.repeat(self.good, n_a)], b[np.repeat(self.good, n_b)]
        n_a, n_b = n_a * self.good, n_b * self.good
        own_a = np.repeat(np.arange(len(units)), n_a)
        # ends of tokens in all good units set side by side
        end_a, end_b = np.cumsum(tools.a_bytes.size[a]), np.cumsum(tools.b_bytes.size[b])
        at = np.searchsorted(end_b, end_a)
        last_a, last_b = end_b[at] == end_a if len(b) else np.zeros(0, bool), np.zeros(len(b), bool)
        last_b[at[last_a]] = True
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        n_groups = int(last_a.sum())
        in_a, in_b = np.bincount(group_a, minlength=n_groups), np.bincount(group_b, minlength=n_groups)
        own_group = own_a[last_a]
        self.figures = [n_a, n_b, np.bincount(own_group, minlength=len(units)), np.bincount(own_group, in_a * in_b, len(units)).astype(np.int64)]
        self.texts = self.rendered(a, b, group_a, group_b, last_a, last_b, in_a, in_b, own_group, len(units))
        n = in_b[group_a]
        keys = np.repeat(a.astype(np.uint64), n) << np.uint64(ID_BITS) | b[spread((np.cumsum(in_b) - in_b)[group_a], n)].astype(np.uint64)
        self.pairs, number = np.unique(keys, return_inverse=True)
        # links of a unit: numbers of pairs, and how often each
        both, self.times = np.unique(np.repeat(own_a, n) * max(len(self.pairs), 1) + number, return_counts=True)
        self.links = both % max(len(self.pairs), 1)
        self.n_pairs = np.bincount(both // max(len(self.pairs), 1), minlength=len(units))
        self.first = np.cumsum(self.n_pairs) - self.n_pairs

    @staticmethod
    def same(ids: np.ndarray, n: np.ndarray, tokens: Bytes, raw: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the joined bytes of a unit's tokens are the unit."""
        own = np.repeat(np.arange(len(n)), n)
        good = np.bincount(own, tokens.size[ids], len(n)).astype(np.int64) == size
        got, want = tokens.joined(ids[good[own]]), raw[np.repeat(good, size)]
        wrong = np.repeat(np.arange(len(n)), size * good)[got != want]
        good[wrong] = False
        return good

    @staticmethod
    def rendered(a, b, group_a, group_b, last_a, last_b, in_a, in_b, own_group, n_units) -> list[bytes]:
        """The groups of each unit, `a1,a2|b1;` one after the other."""
        ids, mark = np.zeros(len(a) + len(b), np.int64), np.full(len(a) + len(b), 44, np.uint8)
        to_a = np.arange(len(a)) + (np.cumsum(in_b) - in_b)[group_a]
        to_b = np.arange(len(b)) + np.cumsum(in_a)[group_b]
        ids[to_a], ids[to_b] = a, b
        mark[to_a[last_a]], mark[to_b[last_b]] = 124, 59
        data, size = written(ids, mark)
        group = np.repeat(np.arange(len(in_a)), in_a + in_b)
        upto = np.concatenate([[0], np.cumsum(np.bincount(own_group[group] if len(group) else [], size, n_units))]).astype(np.int64).tolist()
        data = data.tobytes()
        return [data[i:j] for i, j in itertools.pairwise(upto)]


#: Bytes after which a space may be cut off: visible ASCII, and leads of characters none of which is white space.
_SAFE = np.zeros(256, bool)
_SAFE[0x21:0x7F] = _SAFE[0xC3:0xE0] = _SAFE[0xE4:0xF5] = True


def unit_starts(data: np.ndarray, first: np.ndarray, cuts: bool) -> np.ndarray:
    """Where units begin: at each text, and at each single space before a character that is not white space."""
    cut = np.zeros(len(data), bool)
    if cuts and len(data) > 2:
        cut[1:-1] = (data[1:-1] == 32) & (data[:-2] != 32) & _SAFE[data[2:]]
    cut[first] = True
    return np.flatnonzero(cut)


def segment(data: np.ndarray, first: np.ndarray, tools: Pair):
    """Figures, groups and links of the texts that begin at `first`, each with its space.

    Returns whether each text is good, its figures, its groups as bytes, and (text, key, times) of its links."""
    starts = unit_starts(data, first, tools.cuts)
    raw = np.append(starts, len(data)).astype(np.int64)
    coded = pa.Array.from_buffers(pa.large_utf8(), len(starts), [None, pa.py_buffer(raw), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    unit = np.asarray(coded.indices).astype(np.int64)
    bytes_of, offsets = buffers(coded.dictionary)
    own = Units(coded.dictionary.to_pylist(), bytes_of, np.diff(offsets), tools)
    at = np.searchsorted(starts, first)
    n = np.diff(np.append(at, len(starts)))
    good = np.add.reduceat(~own.good[unit], at) == 0
    figures = [np.add.reduceat(x[unit], at) * good for x in own.figures]
    order = unit.tolist()
    texts = [b"".join(map(own.texts.__getitem__, order[i : i + m])) if g else b"" for i, m, g in zip(at.tolist(), n.tolist(), good.tolist())]
    text = np.repeat(np.arange(len(first)), n)
    inside = good[text]
    held, times = np.unique(text[inside] * len(own.good) + unit[inside], return_counts=True)
    k, u = held // len(own.good), held % len(own.good)
    at_pair = spread(own.first[u], own.n_pairs[u])
    links = merged(np.repeat(k, own.n_pairs[u]), own.links[at_pair], np.repeat(times, own.n_pairs[u]) * own.times[at_pair], len(own.pairs))
    return good, figures, texts, (links[0], own.pairs[links[1]], links[2])


def merged(text: np.ndarray, number: np.ndarray, times: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal (text, number) once each, with the sum of their times."""
    key = text * max(width, 1) + number
    order = np.argsort(key, kind="stable")
    key = key[order]
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(times[order], begin) if len(key) else times
    return key[begin] // max(width, 1), key[begin] % max(width, 1), total


def long_text(data: np.ndarray, tools: Pair, most: int):
    """`segment` of one long text, read in segments of about `most` bytes."""
    starts = unit_starts(data, np.zeros(1, np.int64), tools.cuts)
    ends = [*dict.fromkeys(int(starts[np.searchsorted(starts, x)]) for x in range(most, int(starts[-1]) + 1, most)), len(data)]
    total, parts, keys, times, good = [0] * len(_FIGURES), [], np.zeros(0, np.uint64), np.zeros(0, np.int64), True
    for i, j in itertools.pairwise([0, *ends]):
        fine, figures, texts, links = segment(data[i:j], np.zeros(1, np.int64), tools)
        good &= bool(fine[0])
        if not good:
            break
        total = [x + int(y[0]) for x, y in zip(total, figures)]
        parts.append(texts[0])
        keys, at = np.unique(np.concatenate([keys, links[1]]), return_inverse=True)
        times = np.bincount(at, np.concatenate([times, links[2]]), len(keys)).astype(np.int64)
    if not good:
        return np.array([False]), [np.zeros(1, np.int64) for _ in _FIGURES], [b""], (np.zeros(0, np.int64), keys[:0], times[:0])
    return np.array([True]), [np.array([x]) for x in total], [b"".join(parts)], (np.zeros(len(keys), np.int64), keys, times)


# --- packed columns ---------------------------------------------------------------------------------------------------


def pack(x: np.ndarray) -> bytes:
    """Unsigned numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def unpack(raw, kind: str) -> np.ndarray:
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(data.reshape(np.dtype(kind).itemsize, -1).T).view(kind)[:, 0]


def packed_links(text: np.ndarray, key: np.ndarray, times: np.ndarray, stripes: int):
    """(stripe, A ids, B ids, texts for each pair, those texts, times), packed, for each stripe that has links."""
    pairs, number = np.unique(key, return_inverse=True)
    a = pairs >> np.uint64(ID_BITS)
    by_stripe = np.lexsort((pairs, a % np.uint64(stripes)))
    place = np.empty(len(pairs), np.int64)
    place[by_stripe] = np.arange(len(pairs))
    n_texts = int(text.max()) + 1 if len(text) else 1
    order = np.argsort(place[number] * n_texts + text)
    text, times, n = text[order], times[order], np.bincount(place[number], minlength=len(pairs))
    pairs = pairs[by_stripe]
    a, b = pairs >> np.uint64(ID_BITS), pairs & _ID
    stripe = (a % np.uint64(stripes)).astype(np.int64)
    edge = np.append(np.flatnonzero(np.concatenate([[True], stripe[1:] != stripe[:-1]])), len(pairs)) if len(pairs) else np.zeros(1, np.int64)
    upto = np.concatenate([[0], np.cumsum(n)])
    step = text.astype(np.int64)  # within a pair the texts ascend: their distances are small
    step[1:] -= text[:-1]
    step[upto[:-1]] = text[upto[:-1]]
    for i, j in itertools.pairwise(edge.tolist()):
        p, q = upto[i], upto[j]
        yield (int(stripe[i]), *(pack(x.astype("<u4")) for x in (a[i:j], b[i:j], n[i:j], step[p:q], times[p:q])))


def ascending(step: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The texts of packed_links from their distances."""
    total, first = np.cumsum(step.astype(np.int64)), np.cumsum(n) - n
    return total - np.repeat(np.where(first > 0, total[first - 1], 0), n)


# --- Spark ------------------------------------------------------------------------------------------------------------


def encoded(docs: DataFrame, names: tuple[str, str], stripes: int, chunk: int, groups: bool, id_col: str, text_col: str) -> DataFrame:
    """A row for each document (_kind 0) and one for each chunk and stripe (_kind 1), written to the shared folder."""
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("_home", T.LongType()), T.StructField("_kind", T.IntegerType()), T.StructField("_at", T.IntegerType()), T.StructField("_id", kind), *(T.StructField(f"_{x}", T.LongType()) for x in _FIGURES), T.StructField("_groups", T.StringType()), *(T.StructField(x, T.BinaryType()) for x in ("_a", "_b", "_n", "_text", "_times"))])

    def encode(it):
        tools, part, number = pair(*names), TaskContext.get().partitionId(), 0
        for batch in it:
            data, off = buffers(batch.column("_text"))
            ids = batch.column("_id")
            for i, j in slices(off, chunk):
                home = part << 32 | number
                number += 1
                size = np.diff(off[i : j + 1])
                full = np.flatnonzero(size)
                figures, texts = [np.zeros(j - i, np.int64) for _ in _FIGURES], [b""] * (j - i)
                links = None
                if len(full):
                    own = data[off[i] : off[j]]
                    starts = off[i:j][full] - off[i]
                    spaced = np.insert(own, starts, 32)
                    done = long_text(spaced, tools, chunk) if len(full) == 1 and len(spaced) > 2 * chunk else segment(spaced, starts + np.arange(len(full)), tools)
                    for x, y in zip(figures, done[1]):
                        x[full] = y
                    for k, x in zip(full.tolist(), done[2]):
                        texts[k] = x
                    links = full[done[3][0]], done[3][1], done[3][2]
                yield doc_rows(home, ids.slice(i, j - i), figures, texts)
                if links is not None and len(links[0]):
                    found = list(packed_links(*links, stripes))
                    none = pa.nulls(len(found), ids.type)
                    yield pa.record_batch([pa.array([home] * len(found), pa.int64()), pa.array([1] * len(found), pa.int32()), pa.array([x[0] for x in found], pa.int32()), none, *(pa.nulls(len(found), pa.int64()) for _ in _FIGURES), pa.nulls(len(found), pa.string()), *(pa.array([x[k] for x in found], pa.binary()) for k in range(1, 6))], names=schema.names)

    def doc_rows(home, ids, figures, texts):
        n = len(texts)
        said = [x[:-1].decode() if groups else hashlib.sha256(x[:-1]).hexdigest() if x else "" for x in texts]
        return pa.record_batch([pa.array([home] * n, pa.int64()), pa.array([0] * n, pa.int32()), pa.array(np.arange(n), pa.int32()), ids, *(pa.array(x, pa.int64()) for x in figures), pa.array(said, pa.string()), *(pa.nulls(n, pa.binary()) for _ in range(5))], names=schema.names)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return stored(rows.mapInArrow(encode, schema), "tokens")


def block(names: tuple[str, str], stripes: int) -> np.ndarray:
    tools = pair(*names)
    return np.zeros((-(-len(tools.a_bytes.size) // stripes), len(tools.b_bytes.size)), np.int64)


def tallied(entries: DataFrame, key: str, names: tuple[str, str], stripes: int, tasks: int) -> DataFrame:
    """(key, _stripe, _a, _b, _n) added up in one dense block for each key; entries hold 64-bit counts in _n."""

    def count(it):
        counts, last = None, None

        def done():
            a, b = np.nonzero(counts)
            packed = [pack(x.astype("<u4")) for x in (a * stripes + last[1], b)] + [pack(counts[a, b].astype("<u8"))]
            return pa.record_batch([pa.array([last[0]], pa.int64()), pa.array([last[1]], pa.int32()), *(pa.array([x], pa.binary()) for x in packed)], names=[key, "_stripe", "_a", "_b", "_n"])

        for batch in it:
            for r in range(len(batch)):
                now = batch.column(key)[r].as_py(), batch.column("_stripe")[r].as_py()
                if now != last:
                    if last is not None:
                        yield done()
                    counts, last = block(names, stripes), now
                a, b = (unpack(batch.column(c)[r].as_py(), "<u4") for c in ("_a", "_b"))
                n = batch.column("_n")[r].as_py()
                np.add.at(counts, (a // stripes, b), unpack(n, "<u8" if batch.column("_wide")[r].as_py() else "<u4").astype(np.int64))
        if last is not None:
            yield done()

    dealt = entries.repartitionById(tasks, F.pmod(key, F.lit(tasks)).cast("int")).sortWithinPartitions(key)
    return dealt.mapInArrow(count, f"{key} long, _stripe int, _a binary, _b binary, _n binary")


def n_parts(tokens: DataFrame, stripes: int) -> tuple[int, int]:
    """Parts of each stripe, and tasks that all parts are dealt to."""
    links = tokens.filter("_kind = 0").agg(F.sum("_n_links")).first()[0] or 0
    parts = max(1, -(-links // (stripes * PART_LINKS)))
    return parts, min(stripes * parts, max(int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-links // (1 << 20))))


def counted(tokens: DataFrame, names: tuple[str, str], stripes: int, parts: int, tasks: int) -> DataFrame:
    """(_stripe, _a, _b, _n): all pairs of a stripe with the number of documents that hold each linked, packed."""
    part = F.col("_at") * parts + F.pmod(F.xxhash64("_home"), F.lit(parts))
    links = tokens.filter("_kind = 1").select(part.cast("long").alias("_part"), F.col("_at").alias("_stripe"), "_a", "_b", "_n", F.lit(False).alias("_wide"))
    some = tallied(links, "_part", names, stripes, tasks)
    whole = some.select(F.col("_stripe").cast("long").alias("_key"), "_stripe", "_a", "_b", "_n", F.lit(True).alias("_wide"))
    return tallied(whole, "_key", names, stripes, min(stripes, tasks)).drop("_key")


def summed(tokens: DataFrame, counts: DataFrame, names: tuple[str, str], stripes: int, parts: int, tasks: int) -> DataFrame:
    """(_home, _text, _best, _sum): for each chunk and stripe the sums over the links of its documents, packed."""
    part = F.col("_at") * parts + F.pmod(F.xxhash64("_home"), F.lit(parts))
    links = tokens.filter("_kind = 1").select(part.cast("long").alias("_part"), F.lit(1).alias("_kind"), "_home", "_a", "_b", "_n", "_text", "_times")
    numbers = F.explode(F.sequence(F.col("_stripe").cast("long") * parts, F.col("_stripe").cast("long") * parts + (parts - 1)))
    none = F.lit(None).cast("binary")
    blocks = counts.select(numbers.alias("_part"), F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("_home"), "_a", "_b", "_n", none.alias("_text"), none.alias("_times"))

    def score(it):
        counts = most = None
        for batch in it:
            out = []
            for r in range(len(batch)):
                get = lambda c, t="<u4": unpack(batch.column(c)[r].as_py(), t)  # noqa: B023, E731
                a, b = get("_a").astype(np.int64) // stripes, get("_b")
                if batch.column("_kind")[r].as_py() == 0:
                    counts = block(names, stripes)
                    counts[a, b] = get("_n", "<u8")
                    most = counts.max(1)
                    continue
                n, times = get("_n").astype(np.int64), get("_times").astype(np.int64)
                text = ascending(get("_text"), n)
                c = counts[a, b]
                total, best = np.zeros(int(text.max()) + 1, np.int64), np.zeros(int(text.max()) + 1, np.int64)
                np.add.at(total, text, np.repeat(c, n) * times)
                np.add.at(best, text, np.repeat(c == most[a], n) * times)
                some = np.flatnonzero(total)
                out.append((batch.column("_home")[r].as_py(), pack(np.diff(some, prepend=0).astype("<u4")), pack(best[some].astype("<u8")), pack(total[some].astype("<u8"))))
            if out:
                yield pa.record_batch([pa.array([x[0] for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.binary()) for k in (1, 2, 3))], names=["_home", "_text", "_best", "_sum"])

    dealt = blocks.unionByName(links).repartitionById(tasks, F.pmod("_part", F.lit(tasks)).cast("int")).sortWithinPartitions("_part", "_kind")
    return dealt.mapInArrow(score, "_home long, _text binary, _best binary, _sum binary")


def align(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, stripes: int = STRIPES, chunk: int = CHUNK, groups: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: its id, _n_a, _n_b, _n_groups, _n_links, _n_best, _count_sum and _groups.

    _groups is the SHA-256 of the groups' text, or with `groups` that text."""
    spark = docs.sparkSession
    names = files(spark, a_file, b_file)
    tokens = encoded(docs, names, stripes, chunk, groups, id_col, text_col)
    parts, tasks = n_parts(tokens, stripes)
    sums = summed(tokens, counted(tokens, names, stripes, parts, tasks), names, stripes, parts, tasks)
    kept = ["_home", "_kind", "_at", "_id", *(f"_{x}" for x in _FIGURES), "_groups", "_text", "_best", "_sum"]
    own = tokens.filter("_kind = 0").withColumns({"_kind": F.lit(1), "_text": F.lit(None).cast("binary"), "_best": F.lit(None).cast("binary"), "_sum": F.lit(None).cast("binary")}).select(kept)
    back = sums.select(*((F.col(c) if c in sums.columns else F.lit(0 if c == "_kind" else None).cast(own.schema[c].dataType)).alias(c) for c in kept))
    given = [f"_{x}" for x in ("at", "id", *_FIGURES, "groups")]
    out = T.StructType([*(own.schema[c] for c in given[1:]), T.StructField("_n_best", T.LongType()), T.StructField("_count_sum", T.LongType())])

    def meet(it):
        """For each chunk first the sums of its stripes, then its documents."""
        home, best, total = None, np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in it:
            homes, kinds = np.asarray(batch.column("_home")), np.asarray(batch.column("_kind"))
            edge = np.flatnonzero(np.concatenate([[True], (homes[1:] != homes[:-1]) | (kinds[1:] != kinds[:-1]), [True]]))
            for i, j in itertools.pairwise(edge.tolist()):
                if homes[i] != home:
                    home, best, total = homes[i], np.zeros(0, np.int64), np.zeros(0, np.int64)
                if kinds[i] == 0:
                    for r in range(i, j):
                        at = np.cumsum(unpack(batch.column("_text")[r].as_py(), "<u4").astype(np.int64))
                        if at[-1] >= len(best):
                            more = np.zeros(int(at[-1]) + 1 - len(best), np.int64)
                            best, total = np.append(best, more), np.append(total, more)
                        best[at] += unpack(batch.column("_best")[r].as_py(), "<u8").astype(np.int64)
                        total[at] += unpack(batch.column("_sum")[r].as_py(), "<u8").astype(np.int64)
                    continue
                rows = batch.slice(i, j - i)
                at = np.asarray(rows.column("_at"))
                pick = lambda x: np.where(at < len(x), np.append(x, 0)[np.minimum(at, len(x))], 0)  # noqa: B023, E731
                yield pa.record_batch([*(rows.column(c) for c in given[1:]), pa.array(pick(best)), pa.array(pick(total))], names=out.names)

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = back.unionByName(own).repartitionById(tasks, F.pmod(F.xxhash64("_home"), F.lit(tasks)).cast("int")).sortWithinPartitions("_home", "_kind")
    return met.mapInArrow(meet, out).withColumnRenamed("_id", id_col)


def links(docs: DataFrame, a_file: str | None = None, b_file: str | None = None, stripes: int = STRIPES, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(a_id, b_id, n_docs, best): every linked pair of ids with its count, and whether that is its A id's highest."""
    names = files(docs.sparkSession, a_file, b_file)
    tokens = encoded(docs, names, stripes, chunk, False, id_col, text_col)

    def opened(it):
        for batch in it:
            for r in range(len(batch)):
                a, b = (unpack(batch.column(c)[r].as_py(), "<u4").astype(np.int64) for c in ("_a", "_b"))
                n = unpack(batch.column("_n")[r].as_py(), "<u8").astype(np.int64)
                most = np.zeros(int(a.max()) + 1, np.int64)
                np.maximum.at(most, a, n)
                yield pa.record_batch([pa.array(a), pa.array(b), pa.array(n), pa.array(n == most[a])], names=["a_id", "b_id", "n_docs", "best"])

    return counted(tokens, names, stripes, *n_parts(tokens, stripes)).mapInArrow(opened, "a_id long, b_id long, n_docs long, best boolean")
