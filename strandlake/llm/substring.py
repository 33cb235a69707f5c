"""Substring dedup: Rabin-Karp hashes of every window of `width` words, counted in Spark.

A window that starts later in the collection than an equal one (larger doc_id, or the same document and a later start)
is a repeat. The repeats of a document merge into maximal intervals of words, which are removed. Windows are judged on
the input and do not cross documents. A window is compared by 64 bits of its hash within a bucket that an independent
second hash chooses, so that the bits compared grow with the number of buckets, hence with the data.

Defined cases: null, empty and short texts have no window and stay as they are; null ids come last; rows of equal id are
ordered by their text's hash, and wholly equal rows count as one document (neither repeats the other); an empty table
gives an empty result; other columns pass through; those named like an added column are replaced.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import BASE, BASE_INVERSE, numbers, prefix_hash, repeated, span_hash, with_repeated, word_hashes, word_spans
from .common import buffers as text_buffers

ROUTE_BASE = np.uint64(0xD1342543DE82EF95)
ROUTE_INVERSE = np.uint64(pow(int(ROUTE_BASE), -1, 1 << 64))


def window_keys(data: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows, a second hash that chooses the bucket, and each document's first window."""
    start, end, first = word_spans(data, off)
    words = word_hashes(data, start, end, False)
    n = np.maximum(np.diff(first) - width + 1, 0)
    begins = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat(first[:-1] - begins[:-1], n) + np.arange(begins[-1])
    keys = span_hash(prefix_hash(words, BASE), at, at + width, BASE_INVERSE)
    route = span_hash(prefix_hash(words, ROUTE_BASE), at, at + width, ROUTE_INVERSE) >> np.uint64(32)
    return keys, route.astype(np.uint32), begins


def removed_words(n_words: int, at: np.ndarray, width: int) -> np.ndarray:
    """A flag for each word: whether a window that starts at one of `at` covers it."""
    edge = np.bincount(at, minlength=n_words + 1)[: n_words + 1] - np.bincount(at + width, minlength=n_words + 1)[: n_words + 1]
    return np.cumsum(edge)[:n_words] > 0


def remove_repeats(docs: DataFrame, width: int = 20, id_col: str = "doc_id", text_col: str = "text", rejoin: bool = False) -> DataFrame:
    """The documents without the words of repeated windows, with `_n_words`, `_n_removed`, `_spans` (start and end word of each
    maximal interval) and `_kept_sha256` (of the kept words joined by one space). What is left of a text is joined by single
    spaces; a text that loses nothing stays unchanged, unless `rejoin`."""
    docs = docs.drop("_n_words", "_n_removed", "_spans", "_kept_sha256", "_at")
    names = docs.columns
    found = repeated(docs, lambda data, off: window_keys(data, off, width), True, id_col, text_col)

    def apply(it):
        for b in it:
            texts, at = b.column(text_col), b.column("_at")
            raw, off = text_buffers(texts)
            raw = raw.tobytes()
            text, counts, gone, spans, digest = [], [], [], [], []
            for r in range(b.num_rows):
                words = raw[off[r] : off[r + 1]].split()  # by the same six separators
                hit = removed_words(len(words), numbers(at[r]), width) if at[r].is_valid else None
                kept = words if hit is None else list(compress(words, ~hit))
                joined = b" ".join(kept)
                counts.append(len(words))
                gone.append(len(words) - len(kept))
                edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))) if hit is not None else []
                spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                digest.append(hashlib.sha256(joined).hexdigest())
                text.append(joined if gone[-1] or rejoin and texts[r].is_valid else raw[off[r] : off[r + 1]] if texts[r].is_valid else None)
            out = {c: b.column(c) for c in names} | {text_col: pa.array(text, pa.binary()).cast(texts.type)}
            yield pa.record_batch([*out.values(), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32()}))), pa.array(digest, pa.string())], names=[*names, "_n_words", "_n_removed", "_spans", "_kept_sha256"])

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField("_spans", span), T.StructField("_kept_sha256", T.StringType())])
    return with_repeated(docs, found, id_col, text_col).mapInArrow(apply, schema)
