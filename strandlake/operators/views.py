"""Training views of strings: masked tokens and dropped spans, drawn from hashes, so every rerun has the same.

A draw is a hash of seed, record, use and place. Spans lie in blocks of their own, so none meets another. Only the training
split is varied; the others have the plain view alone. Everything happens in a record's row.

Defined cases: null strings count as empty and have no token: their views are empty; a null record draws as the empty name;
a string shorter than a span loses nothing; repeated records have the same views each; a null split has the plain view alone;
an empty table stays empty; columns besides those named do not travel.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_hash

#: Bracket atoms, two-letter elements, ring numbers of two digits, and single characters.
TOKEN = r"\[[^\]]*\]|Cl|Br|%[0-9][0-9]|."
MASK = "[MASK]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))


def drawn(seed: str, record: Column, use: str, place: Column) -> Column:
    """A long from 0 to 2^32 - 1."""
    name = F.concat(F.lit(f"{seed}:{use}:"), F.coalesce(record.cast("string"), F.lit("")), F.lit(":"), place.cast("string"))
    return F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")


def _under(share: float) -> int:
    return int(share * 2**32)


def masked(found: Column, record: Column, seed: str, share: float) -> Column:
    return F.transform(found, lambda t, i: F.when(drawn(seed, record, "mask", i) < _under(share), MASK).otherwise(t))


def without_spans(found: Column, record: Column, seed: str, share: float, length: int, block: int) -> Column:
    """Tokens without one span of `length` in each block drawn; the last block may be short."""
    if not 0 < length < block:
        raise ValueError("a span must be shorter than its block")

    def stays(t, i):
        number = F.floor(i / block).cast("long")
        room = F.least(F.lit(block), F.size(found) - number * block) - length
        begin = drawn(seed, record, "start", number) % (F.greatest(room, F.lit(0)) + 1)
        inside = (i % block >= begin) & (i % block < begin + length)
        return ~((room >= 0) & (drawn(seed, record, "span", number) < _under(share)) & inside)

    return F.filter(found, stays)


def views(rows: DataFrame, record: str, text: str, seed: str, epoch: int = 0, share: float = 0.15, span_share: float = 0.3, length: int = 3, block: int = 12, training: str = "train") -> DataFrame:
    """(record_id, canonical_hash, split, view, input, target): a row for each view of a row of (record, text, split)."""
    of, draw = F.col(record), f"{seed}:{epoch}"
    rows = rows.select(of.alias("record_id"), F.coalesce(F.col(text), F.lit("")).alias("target"), "split", tokens(F.col(text)).alias("_tokens"))
    of, found = F.col("record_id"), F.col("_tokens")
    view = lambda name, value: F.struct(F.lit(name).alias("view"), F.array_join(value, "").alias("input"))
    varied = F.array(view("plain", found), view("token_mask", masked(found, of, draw, share)), view("span_dropout", without_spans(found, of, draw, span_share, length, block)))
    all_views = F.when(F.col("split") == training, varied).otherwise(F.array(view("plain", found)))
    return rows.withColumn("canonical_hash", stable_hash(F.col("target"))).select("record_id", "canonical_hash", "split", F.inline(all_views), "target")


# fixed values: the tags of prompts and the end of a target
END = "<|endoftext|>"


def tagged(tag: str, text: Column) -> Column:
    """A text between its opening and closing tag, each on a line of its own; null is empty."""
    return F.concat(F.lit(f"<{tag}>\n"), F.coalesce(text, F.lit("")), F.lit(f"\n</{tag}>"))


def prompts(rows: DataFrame) -> DataFrame:
    """`views` rows with `prompt` (the plain view under its own tag) and `completion`, the target with its end."""
    plain = F.coalesce(F.col("view") == "plain", F.lit(False))
    text = F.when(plain, tagged("polymer_smiles", F.col("input"))).otherwise(tagged("polymer_view_smiles", F.col("input")))
    return rows.withColumns({"prompt": text, "completion": F.concat(F.coalesce("target", F.lit("")), F.lit(END))})


def described(fragment_id: Column, name: Column, category: Column, description: Column) -> Column:
    """The description of a fragment as a prompt has it; null fields are empty."""
    fields = (("id", fragment_id), ("name", name), ("category", category), ("description", description))
    lines = [F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields]
    return tagged("fragment_description", F.concat_ws("\n", *lines))
