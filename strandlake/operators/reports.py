"""Audit of rules, summaries and report sinks: small tables made by aggregates, written by the driver only at the end."""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Which rules of the first vocabulary stand for a core rule.
V1_REFERENCES = {
    "fragment_001": "FG_AMIDE COMP_AROMATIC_AMIDE_N COMP_AROMATIC_AMIDE_C", "fragment_002": "FG_IMIDE RING_IMIDE COMP_AROMATIC_IMIDE",
    "fragment_003": "FG_ESTER", "fragment_004": "FG_ETHER FG_AROMATIC_ETHER SUB_ALKOXY", "fragment_005": "FG_CARBONATE", "fragment_006": "FG_URETHANE",
    "fragment_007": "FG_UREA", "fragment_008": "FG_THIOETHER LINK_AROMATIC_SULFIDE", "fragment_009": "FG_SULFONE LINK_AROMATIC_SULFONE", "fragment_010": "",
    "fragment_011": "FG_NITRILE", "fragment_012": "FG_HYDROXYL", "fragment_013": "FG_SECONDARY_AMINE FG_TERTIARY_AMINE",
    "fragment_014": "FG_CARBONYL FG_KETONE LINK_AROMATIC_CARBONYL", "fragment_015": "FG_CARBOXYLIC_ACID", "fragment_016": "",
    "fragment_017": "RING_HETEROAROMATIC_5", "fragment_018": "", "fragment_019": "RING_AROMATIC_6 RING_HETEROAROMATIC_6 RING_FUSED_AROMATIC_ATOM",
    "fragment_020": "", "fragment_021": "LINK_VINYLENE", "fragment_022": "LINK_ETHYNYLENE", "fragment_023": "FG_SECONDARY_AMINE", "fragment_024": "FG_AZO",
    "fragment_025": "SUB_HALOGEN SUB_FLUORO SUB_CHLORO SUB_BROMO", "fragment_026": "SUB_TRIFLUOROMETHYL COMP_PERFLUOROALKYL", "fragment_027": "FG_THIOCARBONYL",
    "fragment_028": "FG_NITRO", "fragment_029": "", "fragment_030": "FG_SILOXANE FG_SILANE", "fragment_031": "FG_PHOSPHAZENE FG_PHOSPHATE",
}
# Levels of risk and notes of the audit, and the classes of badges.
ATTENTION, WATCH, PASSED = "关注", "观察", "通过"
NOTES = {
    "none_hit": "active core 零命中",
    "rare": "低频 core，建议保留但单独标注 rare",
    "general": "高覆盖泛化规则，适合作 roll-up 或父级特征",
    "raw_drop": "raw->normalized 下降明显，dedup/constraints 生效",
    "suppressed": "resolved suppression 生效",
    "audit_only": "非 active，仅保留审计命中，不进入 resolved 输出",
    "not_downstream": " 不应下游输出",
    "default": "当前口径无明显异常",
}
BADGES = {"core": "ok", "derived_attribute": "info", "deprecated_alias": "muted", "rejected": "warn", ATTENTION: "warn", WATCH: "info", PASSED: "ok"}


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def audited(rows: DataFrame, total: Column) -> DataFrame:
    """Rule rows (fragment_id, status, active, and records and matches at each level) with ratios, risk, notes and a badge.

    Later conditions overrule the risk of earlier ones; notes add up in order. `total`: the number of records."""
    ratio = _share(F.col("resolved_records"), total)
    dropped = F.when(F.col("active"), F.col("normalized_matches") - F.col("resolved_matches")).otherwise(F.col("normalized_matches"))
    drop_ratio, raw_ratio = _share(dropped, F.col("normalized_matches")), _share(F.col("raw_matches") - F.col("normalized_matches"), F.col("raw_matches"))
    none_hit = F.col("active") & (F.col("resolved_records") == 0)
    rare, general = F.col("active") & (ratio > 0) & (ratio < 0.005), F.col("active") & (ratio >= 0.5)
    notes = [
        (none_hit, F.lit(NOTES["none_hit"])),
        (rare, F.lit(NOTES["rare"])),
        (general, F.lit(NOTES["general"])),
        (raw_ratio >= 0.2, F.lit(NOTES["raw_drop"])),
        (F.col("active") & (drop_ratio >= 0.2), F.lit(NOTES["suppressed"])),
        (~F.col("active") & (F.col("normalized_matches") > 0), F.lit(NOTES["audit_only"])),
        (F.col("status").isin("deprecated_alias", "rejected"), F.concat("status", F.lit(NOTES["not_downstream"]))),
    ]
    found = F.filter(F.array(*(F.when(c, n) for c, n in notes)), lambda x: x.isNotNull())
    risk = F.when(general | rare, WATCH).when(none_hit, ATTENTION).otherwise(PASSED)
    return rows.withColumns({"resolved_ratio": ratio, "suppression_drop_ratio": drop_ratio, "raw_drop_ratio": raw_ratio, "risk": risk, "notes": F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(NOTES["default"])))}).withColumn("badge", badge(F.col("risk")))


def badge(label: Column) -> Column:
    """The class of a status or a level of risk; unknown ones are muted."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in BADGES.items() for x in kv)), label), F.lit("muted"))


def groups(rows: DataFrame) -> DataFrame:
    """(report, fragment_id): what an audit lists apart: general and rare active rules, and inactive ones with hits."""
    which = {
        "high_generic": F.col("active") & (F.col("resolved_ratio") >= 0.5),
        "low_core": F.col("active") & (F.col("resolved_ratio") > 0) & (F.col("resolved_ratio") < 0.005),
        "nonactive_with_hits": ~F.col("active") & ((F.col("normalized_records") > 0) | (F.col("normalized_matches") > 0)),
    }
    named = F.filter(F.array(*(F.when(c, F.lit(n)) for n, c in which.items())), lambda x: x.isNotNull())
    return rows.select(F.explode(named).alias("report"), "fragment_id")


def largest(rows: DataFrame, k: int, *by: Column) -> DataFrame:
    """The k first rows of a table in an order, with the identifier as the last tie."""
    return rows.orderBy(*by, "fragment_id").limit(k)


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("status").agg(F.count(F.lit(1)).alias("rules"), F.count(F.when(F.col("active"), 1)).alias("active"))


def references(spark: SparkSession, known: DataFrame, table: dict[str, str] = V1_REFERENCES) -> DataFrame:
    """(fragment_id, refs): each core rule's rules of the first vocabulary with records and share, `ID -` where `known` lacks one."""
    pairs = spark.createDataFrame([(f, i, r) for f, refs in table.items() for i, r in enumerate(refs.split() or [None])], "fragment_id string, place int, ref string")
    told = F.concat_ws(" ", "ref", F.coalesce(F.concat(F.format_number("records", 0), F.lit("/"), F.format_number(F.col("ratio") * 100, 1), F.lit("%")), F.lit("-")))
    out = pairs.join(known.select(F.col("fragment_id").alias("ref"), "records", "ratio"), "ref", "left")
    cell = F.when(F.col("ref").isNotNull(), F.struct("place", told.alias("told")))
    return out.groupBy("fragment_id").agg(F.transform(F.array_sort(F.collect_list(cell)), lambda x: x["told"]).alias("refs"))


def labelled(value: Column, kind: str) -> Column:
    """A value as a label: unknown for null, true or false, the members of a list joined or none, else its text."""
    if kind == "boolean":
        known = F.when(value, "true").otherwise("false")
    elif kind.startswith("array"):
        known = F.when(F.size(value) > 0, F.array_join(value, ",")).otherwise("none")
    else:
        known = value.cast("string")
    return F.when(value.isNull(), "unknown").otherwise(known)


def attribute_distributions(rows: DataFrame, record: str, attributes: list[str]) -> DataFrame:
    """(attribute, label, records, matches) for all attributes in one pass, commonest first."""
    kinds = dict(rows.dtypes)
    cells = F.array(*(F.struct(F.lit(a).alias("attribute"), labelled(F.col(a), kinds[a]).alias("label")) for a in attributes))
    long = rows.select(F.col(record).alias("_r"), F.explode(cells).alias("_c")).select("_r", "_c.*")
    return long.groupBy("attribute", "label").agg(F.count_distinct("_r").alias("records"), F.count(F.lit(1)).alias("matches")).orderBy("attribute", F.desc("matches"), "label")


def summary(rows: DataFrame, value: str) -> DataFrame:
    """One row: mean, median, most and the histogram of a whole number in ascending order; zeros and an empty map of no rows.

    Only the counts of distinct values are gathered."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(F.col(value).cast("long").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return counts.agg(
        zero(F.try_divide(F.sum(F.col("v") * F.col("n")).cast("double"), F.sum("n").cast("double"))).alias("avg"),
        zero(F.expr("percentile(v, 0.5, n)")).alias("median"),
        F.coalesce(F.max("v"), F.lit(0)).alias("max"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n")))).alias("histogram"),
    )


def failures(*streams: DataFrame) -> DataFrame:
    """All failure rows of several streams, columns that one lacks as nulls."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


def failure_counts(rows: DataFrame, examples: str, most: int = 20, by: tuple[str, ...] = ("stage", "reason")) -> DataFrame:
    """Failures by stage and reason with the first `most` distinct examples in order; a group's rows are never gathered."""
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    some = rows.select(*by, examples).distinct().withColumn("_p", F.row_number().over(_in_order(by, examples))).filter(F.col("_p") <= most)
    some = some.groupBy(*by).agg(F.array_sort(F.collect_list(examples)).alias("examples"))
    same = F.lit(True)
    for c in by:
        same = same & counts[c].eqNullSafe(some[c])
    return counts.join(some, same, "left").select(*(counts[c] for c in by), "n", F.coalesce("examples", F.array().cast("array<string>")).alias("examples"))


def _in_order(by, value):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(value)


def validation(errors: DataFrame) -> DataFrame:
    """One row: rules, valid and invalid ones, and the share of valid ones, of rows with a text of errors."""
    good = F.count(F.when(F.col("errors") == "", 1))
    return errors.agg(F.count(F.lit(1)).alias("rules"), good.alias("valid"), (F.count(F.lit(1)) - good).alias("invalid"), _share(good, F.count(F.lit(1))).alias("success_rate"))


def rolled_up(stats: DataFrame) -> DataFrame:
    """One row over all splits: samples, failures and the longest recommendation."""
    return stats.agg(F.coalesce(F.sum("samples"), F.lit(0)).alias("samples"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"), F.coalesce(F.max("recommended"), F.lit(0)).alias("recommended"))


def cell_json(values: Column) -> Column:
    """A list as JSON text for a cell of a CSV file."""
    return F.to_json(values)


def doubled_backslashes(text: Column) -> Column:
    return F.replace(text, F.lit("\\"), F.lit("\\\\"))


# --- sinks for small tables --------------------------------------------------------------------------------------------


def bounded(rows: DataFrame, most: int) -> list[dict]:
    """A table's rows for a report. Reports are small by nature; more than `most` rows are an error, not cut off."""
    got = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"a report holds at most {most} rows; write the table itself instead")
    return got


def write_json(content, path: str) -> str:
    """A JSON document: UTF-8, keys sorted, indented by two, with a line end; returns the text."""
    text = json.dumps(content, ensure_ascii=False, indent=2, sort_keys=True, default=str) + "\n"
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)
    return text


def markdown(title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """A report with a table for each name."""
    cell = lambda x: ("" if x is None else str(x)).replace("|", "\\|").replace("\n", " ")
    out = [f"# {title}", ""]
    for name, rows in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(rows.columns) + " |", "|" + " --- |" * len(rows.columns)]
        out += ["| " + " | ".join(cell(x) for x in r.values()) + " |" for r in bounded(rows, most)] + [""]
    return "\n".join(out)


def page(title: str, tables: dict[str, DataFrame], most: int = 1000) -> str:
    """An HTML report; cells are escaped, columns named status or risk become badges, no line ends in white space."""
    esc = lambda x: html.escape("" if x is None else str(x))
    cell = lambda c, x: f'<span class="badge {BADGES.get(x, "muted")}">{esc(x)}</span>' if c in ("status", "risk") else esc(x)
    out = ["<!doctype html>", f'<html><head><meta charset="utf-8"><title>{esc(title)}</title></head><body>', f"<h1>{esc(title)}</h1>"]
    for name, rows in tables.items():
        out += [f"<h2>{esc(name)}</h2>", "<table>", "<tr>" + "".join(f"<th>{esc(c)}</th>" for c in rows.columns) + "</tr>"]
        out += ["<tr>" + "".join(f"<td>{cell(c, x)}</td>" for c, x in r.items()) + "</tr>" for r in bounded(rows, most)] + ["</table>"]
    return "\n".join(line.rstrip() for line in [*out, "</body></html>"]) + "\n"
