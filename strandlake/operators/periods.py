"""Sliding periods of repeat units: every unit gives the distinct windows of three units in a row; equal periods keep their first source."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import chem

_OUT = "smiles string, trimer_smiles string, sliding_positions_total int, periods array<string>, reason string"


def expanded(strings: DataFrame, column: str = "smiles") -> DataFrame:
    """A row per distinct string: the row of three, the number of windows, the distinct periods in order, or why there are none.

    A null string is one that can't be read. Periods are written as canonical strings, so equal ones are equal texts."""

    def cut(it):
        for b in it:
            trimers, windows, periods, reasons = [], [], [], []
            for text in b.column("smiles").to_pylist():
                found, reason = (None, None, None), None
                graph = chem.parse(text)
                if graph is None:
                    reason = "string can't be read"
                else:
                    try:
                        found = chem.periods(graph)
                    except ValueError as e:
                        reason = str(e)
                for column, value in zip((trimers, windows, periods, reasons), (*found, reason)):
                    column.append(value)
            yield pa.record_batch([b.column("smiles"), pa.array(trimers, pa.string()), pa.array(windows, pa.int32()), pa.array(periods, pa.list_(pa.string())), pa.array(reasons, pa.string())], names=["smiles", "trimer_smiles", "sliding_positions_total", "periods", "reason"])

    return strings.select(F.col(column).alias("smiles")).distinct().mapInArrow(cut, _OUT)


def candidates(found: DataFrame) -> DataFrame:
    """A row for each period of each source."""
    number = F.size("periods").alias("unique_periods_for_source")
    return found.select(F.explode("periods").alias("period_smiles"), F.col("smiles").alias("source_smiles"), "trimer_smiles", "sliding_positions_total", number)


def failures(found: DataFrame) -> DataFrame:
    return found.filter("reason is not null").select(F.lit("period_generation").alias("stage"), "smiles", "reason")


def per_source(found: DataFrame) -> DataFrame:
    """How many sources have how many periods, failed ones as 0."""
    return found.groupBy(F.coalesce(F.size("periods"), F.lit(0)).alias("periods")).agg(F.count(F.lit(1)).alias("sources"))


def usable(period: str = "period_smiles"):
    """Neither empty nor with a comma, an unresolved group or doubled brackets, and with two attachment points."""
    p = F.col(period)
    return F.coalesce((p != "") & ~p.contains(",") & ~p.rlike(r"\[R\d*\]") & ~p.contains("[[") & ~p.contains("]]") & (F.length(p) - F.length(F.replace(p, F.lit("*"), F.lit(""))) == 2), F.lit(False))


def deduplicated(rows: DataFrame) -> DataFrame:
    """(smiles, source_smiles, sources): each usable period once, with the first of its sources in order and their number."""
    return rows.filter(usable()).groupBy(F.col("period_smiles").alias("smiles")).agg(F.min("source_smiles").alias("source_smiles"), F.count(F.lit(1)).alias("sources"))
