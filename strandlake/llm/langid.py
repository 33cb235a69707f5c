"""Language identification by compression: the language whose dictionary encodes a text in the fewest bytes.

For each language the words of a bounded sample of labelled texts are counted by document; the most frequent make up a raw
content dictionary for Zstandard, the commonest last, where their offsets are short. A text is reduced to its lower-cased
letter runs and encoded piece by piece with each dictionary, so that every part of a long text speaks for a language and not
its beginning alone. The smallest total wins; ties go to the language with more training rows, then to the smaller name.
A guess is marked rejected where the runner-up needs hardly more bytes.

Only the dictionaries are learned, from `rows` texts of each language at most and `passage` characters of each (a bounded,
documented sample, drawn by the hash of a text, so that copies count once and a rerun draws the same). Scoring reads whole
texts, shuffles nothing, and holds one dictionary a language in each Python worker: `dictionary_bytes` times the number of
languages, which also is what the driver collects.

Defined cases: null texts and texts without a letter are `und` with score 0 and rejected; null labels are not learned; an
empty string is a label like any other; without any learned label all texts are `und`; with one label all texts with a
letter have it; repeated rows are judged alike; an empty table stays empty; other columns pass through, those named like an
added one (_lang, _score, _margin, _rejected) are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A run of anything that is neither letter nor mark.
NO_LETTERS = r"[^\p{L}\p{M}]+"
UNKNOWN = "und"
_ADDED = "struct<lang:string,score:double,margin:double,rejected:boolean>"


def plain(text: Column) -> Column:
    """The lower-cased letter runs of a text with one space around each; null: empty."""
    return F.concat(F.lit(" "), F.trim(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), NO_LETTERS, " "))), F.lit(" "))


def sampled(docs: DataFrame, is_train: Column, rows: int, passage: int, text_col: str, lang_col: str) -> tuple[DataFrame, dict[str, int]]:
    """(_lang, _passage) of about `rows` different texts of each language, and the number of training rows of each.

    A text belongs to the sample by its hash against a share for its language; then the least hashes stay."""
    text, h = F.col(text_col), F.xxhash64(text_col)
    usable = docs.filter(is_train & F.col(lang_col).isNotNull() & text.rlike(r"\p{L}")).select(F.col(lang_col).cast("string").alias("_lang"), text.alias("_text"), h.alias("_hash"))
    sizes = usable.groupBy("_lang").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("_hash", 0.02).alias("different")).collect()
    if not sizes:
        return usable.select("_lang", F.col("_text").alias("_passage")).limit(0), {}
    shares = docs.sparkSession.createDataFrame([(r._lang, min(1.0, 1.5 * rows / max(r.different, 1))) for r in sizes], "_lang string, _share double")
    drawn = F.pmod(F.xxhash64("_hash", F.lit(11)), F.lit(1 << 31)) < F.col("_share") * (1 << 31)
    start = 1 + F.pmod(F.xxhash64("_hash", F.lit(7)), F.greatest(F.length("_text") - passage, F.lit(0)) + 1)
    some = usable.join(F.broadcast(shares), "_lang").filter(drawn).select("_lang", "_hash", F.substr("_text", start.cast("int"), F.lit(passage)).alias("_passage"))
    once = some.groupBy("_lang", "_hash").agg(F.min("_passage").alias("_passage"))
    least = Window.partitionBy("_lang").orderBy(F.xxhash64("_hash", F.lit(13)), "_hash")
    return once.withColumn("_k", F.row_number().over(least)).filter(F.col("_k") <= rows).select("_lang", "_passage"), {r._lang: r.n for r in sizes}


def train(docs: DataFrame, is_train: Column, rows: int = 2000, passage: int = 4000, dictionary_bytes: int = 1 << 16, text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """A language and its dictionary each, languages with more training rows first."""
    sample, sizes = sampled(docs, is_train, rows, passage, text_col, lang_col)
    if not sizes:
        return []
    words = sample.select("_lang", F.explode(F.array_distinct(F.split(F.trim(plain(F.col("_passage"))), " "))).alias("_word")).filter("_word != ''")
    counted = words.groupBy("_lang", "_word").count()
    common = Window.partitionBy("_lang").orderBy(F.desc("count"), "_word")
    upto = F.sum(F.octet_length("_word") + 1).over(common.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    kept = counted.withColumn("_upto", upto).filter(F.col("_upto") <= dictionary_bytes).groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct((-F.col("count")).alias("_c"), "_word"))).alias("w"))
    found = {r._lang: (" " + " ".join(x._word for x in reversed(r.w)) + " ").encode() for r in kept.collect()}
    return [(lang, found.get(lang, b"  ")) for lang in sorted(sizes, key=lambda x: (-sizes[x], x))]


def compressors(dictionaries: list[tuple[str, bytes]]) -> list[zstandard.ZstdCompressor]:
    """Matches of four bytes and more count; frames carry nothing but the data."""
    how = zstandard.ZstdCompressionParameters(window_log=17, chain_log=16, hash_log=16, search_log=2, min_match=4, target_length=16, strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for _, content in dictionaries:
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(compression_params=how)
        out.append(zstandard.ZstdCompressor(compression_params=how, dict_data=d))
    return out


def encoded_sizes(raw: bytes | memoryview, coders: list[zstandard.ZstdCompressor], piece: int) -> np.ndarray:
    """Bytes that a text takes with each dictionary, piece by piece."""
    parts = [raw[i : i + piece] for i in range(0, len(raw), piece)]
    return np.array([sum(len(c.compress(x)) for x in parts) for c in coders], np.int64)


def judged(sizes: np.ndarray, least_margin: float) -> tuple[int, float, float, bool]:
    """The smallest (the first of equal ones), its share among powers of two of the sizes, and its lead over the second."""
    best = int(np.argmin(sizes))
    lead = np.minimum(sizes - sizes[best], 60)
    score = float(1 / np.exp2(-lead.astype(float)).sum())
    second = np.partition(sizes, 1)[1] if len(sizes) > 1 else 0
    margin = float((second - sizes[best]) / second) if len(sizes) > 1 else 1.0
    return best, score, margin, margin < least_margin or margin == 0


def predict(docs: DataFrame, dictionaries: list[tuple[str, bytes]], least_margin: float = 0.01, piece: int = 2048, text_col: str = "text") -> DataFrame:
    """The rows with _lang, _score (0 to 1), _margin (the runner-up's excess) and _rejected (below `least_margin`, or a tie)."""
    names = [x for x, _ in dictionaries]
    own: list = []  # of each worker, made at its first batch

    @F.arrow_udf(_ADDED)
    def guess(letters: pa.Array, has_letter: pa.Array) -> pa.Array:
        if not own:
            own.extend(compressors(dictionaries))
        lang, score, margin, rejected = [], [], [], []
        for text, some in zip(letters, has_letter.to_pylist()):
            best, s, m, r = judged(encoded_sizes(text.as_buffer().to_pybytes(), own, piece), least_margin) if some and own else (-1, 0.0, 0.0, True)
            lang.append(names[best] if best >= 0 else UNKNOWN)
            score.append(s)
            margin.append(m)
            rejected.append(r)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(margin, pa.float64()), pa.array(rejected, pa.bool_())], names=["lang", "score", "margin", "rejected"])

    added = ("lang", "score", "margin", "rejected")
    rows = docs.drop(*(f"_{x}" for x in added))
    found = guess(plain(F.col(text_col)), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)))
    # the rows travel as one column, so that no name of theirs meets one of the answer's
    judgement = rows.select(F.struct(*(F.col(f"`{c}`") for c in rows.columns)).alias("row"), found.alias("found"))
    return judgement.select("row.*", *(F.col(f"found.{x}").alias(f"_{x}") for x in added))


def accepted(docs: DataFrame, langs: list[str]) -> DataFrame:
    """Of predicted rows those of the given languages whose guess is not rejected."""
    return docs.filter(F.col("_lang").isin(langs) & ~F.col("_rejected"))
