"""Column functions over repeat-unit strings and texts; all of them compile into Spark's generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of an attachment point (longest first), characters that rows and reports care about.
ATTACHMENTS = ("[[[*]]]", "[[*]]", "[*:1]", "[*:2]", "[*]")
NUMBERED_ATTACHMENT = r"\[\*:\d+\]"
R_GROUP = r"\[R\d*\]"
INVISIBLE = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}\x{FEFF}]"
CRITICAL_CHARS = ("*", "/", "\\", "[", "]", "%")
BUCKETS = (128, 256, 512, 1024, 2048)


def stripped(c: Column) -> Column:
    """Without white space of any script at both ends; null becomes empty. trim() would take U+0020 only."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def visible(c: Column) -> Column:
    return F.regexp_replace(c, INVISIBLE, "")


def attachments_normalised(c: Column) -> Column:
    """One spelling, `*`, for all attachment points."""
    out = stripped(visible(F.coalesce(c, F.lit(""))))
    for spelling in ATTACHMENTS:
        out = F.replace(out, F.lit(spelling), F.lit("*"))
    return F.regexp_replace(out, NUMBERED_ATTACHMENT, "*")


def occurrences(c: Column, part: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))).cast("long") / F.lit(len(part)).cast("long")


def stars(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("*"), F.lit("")))).cast("long")


def record_type(normalised: Column) -> Column:
    """The class of a record; the first predicate that holds decides."""
    n = stars(normalised)
    return (
        F.when(normalised == "", "parser_failed")
        .when(normalised.rlike(R_GROUP), "unresolved_R_group")
        .when(normalised.contains("."), "ionomer_or_multicomponent_candidate")
        .when(normalised.contains(","), "copolymer_candidate")
        .when(n == 2, "main_repeat_unit")
        .when(n == 0, "monomer_or_descriptor_record")
        .when(n == 1, "incomplete_attachment")
        .otherwise("copolymer_candidate")
    )


def stable_hash(c: Column) -> Column:
    return F.sha2(c, 256)


def padded_id(prefix: str, rank: Column) -> Column:
    return F.format_string(f"{prefix}_%06d", rank)


def length_bucket(n: Column) -> Column:
    """The smallest of the usual sequence lengths that holds n, the largest for all beyond."""
    out = F.lit(BUCKETS[-1])
    for b in reversed(BUCKETS[:-1]):
        out = F.when(n <= b, b).otherwise(out)
    return out


def percent(v: Column, digits: int = 2) -> Column:
    return F.when(v.isNull() | F.isnan(v), "-").otherwise(F.format_string(f"%.{digits}f%%", v * 100))


def grouped_digits(v: Column) -> Column:
    return F.coalesce(F.format_number(v.try_cast("bigint"), 0), F.lit("-"))


def escaped_html(v: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        v = F.replace(v, F.lit(a), F.lit(b))
    return v


def joined_or_none(items: Column) -> Column:
    return F.when(F.size(items) == 0, "none").otherwise(F.array_join(F.array_sort(items), ","))
