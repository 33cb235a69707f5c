"""Benchmark decontamination with a broadcast hash set of normalised test n-grams; DataFrame functions only.

Words are lower-cased (A-Z) runs of letters, digits and non-ASCII characters. A window is `width` consecutive words of an
item, or a whole shorter item. The benchmark becomes a table of 64-bit window hashes. Each document yields the hash of
every window of its own of those lengths that occur in the benchmark; hashes are looked up in the table and every hit is
verified word by word against the whole window.

The path is one for any benchmark. Only how Spark joins the hashes depends on their measured number: up to
`broadcast_windows` rows of hash, length and number of the window (some 64 bytes each) are broadcast, more are joined by
shuffling hashes. The windows' texts and items are joined to the hits alone.

Defined cases: null or wordless texts and items match nothing; an empty benchmark leaves every document clean; repeated
rows are judged apart and alike; items with the same windows are all reported; other columns, whatever their names, pass
through, except those named like a result (`_n_words`, `_n_hit`, `_items`, `_spans`, `_contaminated`), which are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, stored

SEPARATOR = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
RAW_UNIT = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Windows, and bytes of their texts and items as measured, that are broadcast at most; more are shuffled by their hashes.
BROADCAST_WINDOWS, BROADCAST_BYTES = 1 << 20, 64 << 20
RESULTS = ("_n_words", "_n_hit", "_items", "_spans", "_contaminated")


def words(text):
    """The words as they are written; splitting a trimmed text is much cheaper than matching each word."""
    bare = F.trim(text, F.lit(SEPARATORS))
    return F.when(text.isNull() | (bare == ""), F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR))


def lowered(text):
    """The words in lower case (A-Z); the text is lowered as a whole, which keeps all word boundaries."""
    return words(lower_ascii(text))


def windows(items: DataFrame, width: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(_gram array<string>, _items array<string>, _len, _key): every distinct window, the items it is in, and its hash."""
    w = items.select(F.col(id_col).cast("string").alias("_item"), lowered(F.col(text_col)).alias("_w")).filter(F.size("_w") > 0)
    last = F.greatest(F.size("_w") - width + 1, F.lit(1))
    grams = w.select("_item", F.explode(F.transform(F.sequence(F.lit(1), last), lambda i: F.slice("_w", i, width))).alias("_gram"))
    grams = grams.groupBy("_gram").agg(F.collect_set("_item").alias("_in"))
    return grams.withColumn("_len", F.size("_gram")).withColumn("_key", F.xxhash64("_gram"))


def hits(docs: DataFrame, items: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per document that any window occurs in: _id, _text_hash, _n_hit, _items (sorted), _spans (start and end word)."""
    grams = stored(windows(items, width, item_id, item_text), "windows")
    keys = grams.groupBy("_key", "_len").agg(F.count(F.lit(1)).alias("_texts"))
    lengths = {r["_len"]: r["n"] for r in keys.groupBy("_len").agg(F.count(F.lit(1)).alias("n")).collect()}  # `width` rows at most
    volume = grams.agg(F.sum(F.octet_length(F.array_join("_gram", " ")) + F.octet_length(F.array_join("_in", " ")) + 64)).first()[0] or 0
    small = sum(lengths.values()) <= broadcast_windows and volume <= BROADCAST_BYTES
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_col).alias("_text_hash"), lowered(F.col(text_col)).alias("_words"))

    if not lengths:
        lengths = {width: 0}
    found = None
    for n in sorted(lengths):
        own = keys.filter(F.col("_len") == n).select(F.col("_key").alias("_gram_key"))
        # exploding places and hashing slices afterwards, instead of in a lambda, lets all this be compiled with the join
        places = F.when(F.size("_words") >= n, F.sequence(F.lit(0), F.size("_words") - n))
        seen = rows.select("_id", "_text_hash", "_words", F.explode(places).alias("start"))
        window = F.slice("_words", F.col("start") + 1, n)
        if small:
            some = seen.join(F.broadcast(own), F.xxhash64(window) == F.col("_gram_key"))
            some = some.select("_id", "_text_hash", "start", (F.col("start") + n).alias("end"), window.alias("_seen"))
        else:  # places and hashes alone are shuffled; the words are fetched once for each document with a hit
            some = seen.select("_id", "_text_hash", "start", F.xxhash64(window).alias("_window")).join(own, F.col("_window") == F.col("_gram_key")).select("_id", "_text_hash", "start")
            starts = some.groupBy(F.col("_id").alias("_hit_id"), F.col("_text_hash").alias("_hit_hash")).agg(F.collect_set("start").alias("_starts"))
            some = rows.join(starts, F.col("_id").eqNullSafe(F.col("_hit_id")) & (F.col("_text_hash") == F.col("_hit_hash"))).select("_id", "_text_hash", "_words", F.explode("_starts").alias("start"))
            some = some.select("_id", "_text_hash", "start", (F.col("start") + n).alias("end"), window.alias("_seen"))
        found = some if found is None else found.unionByName(some)
    texts = grams.select("_key", "_gram", "_in")
    found = found.join(F.broadcast(texts) if small else texts, (F.xxhash64("_seen") == F.col("_key")) & (F.col("_seen") == F.col("_gram")))
    found = found.select("_id", "_text_hash", "start", "end", F.explode("_in").alias("_item"))
    out = found.groupBy("_id", "_text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("_spans"), F.array_sort(F.collect_set("_item")).alias("_items"))
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto"))
    covered = F.aggregate("_spans", empty, lambda s, x: F.struct((s["n"] + F.greatest(x["end"] - F.greatest(x["start"], s["upto"]), F.lit(0))).alias("n"), F.greatest(s["upto"], x["end"]).alias("upto")))["n"]
    return out.withColumn("_n_hit", covered.cast("long"))


def decontaminate(docs: DataFrame, items: DataFrame, width: int = 13, share: int = 20, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """Every document with `_n_words`, `_n_hit`, `_items`, `_spans` and `_contaminated`: one word in `share` is hit, or more."""
    found = hits(docs, items, width, id_col, text_col, **more)
    rows = docs.drop(*RESULTS)
    rows = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("_doc"), F.col(id_col).alias("_doc_id"), F.size(words(F.col(text_col))).cast("long").alias("_n_words"), F.xxhash64(text_col).alias("_doc_hash"))
    out = rows.join(found, F.col("_doc_id").eqNullSafe(F.col("_id")) & (F.col("_doc_hash") == F.col("_text_hash")), "left")
    n_hit = F.coalesce("_n_hit", F.lit(0).cast("long"))
    return out.select("_doc.*", "_n_words", n_hit.alias("_n_hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("_items"), "_spans", ((n_hit > 0) & (share * n_hit >= F.col("_n_words"))).alias("_contaminated"))


def drop_documents(docs: DataFrame, items: DataFrame, **more) -> DataFrame:
    """The documents that are not contaminated, with their own columns."""
    docs = docs.drop(*RESULTS)
    return decontaminate(docs, items, **more).filter(~F.col("_contaminated")).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """Every document without its hit words and the separators before them."""
    docs = docs.drop(*RESULTS)
    out = decontaminate(docs, items, text_col=text_col, **more)
    units = F.regexp_extract_all(F.col(text_col), F.lit(RAW_UNIT), F.lit(0))
    kept = F.filter(units, lambda u, i: ~F.exists("_spans", lambda s: (i >= s["start"]) & (i < s["end"])))
    tail = F.regexp_extract(F.col(text_col), r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    text = F.when(F.col("_n_hit") > 0, F.concat(F.array_join(kept, ""), tail)).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*[F.col(f"`{c}`") for c in docs.columns])
