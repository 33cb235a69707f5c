"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark contamination, mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import decontam, jaccard, mixing, substring, toxicity
from strandlake.llm.common import stored, table

ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores at 0.5 or more go.

    Null and empty texts have the bias alone and stay where toxic ones are the minority; of repeated rows all stay or all go;
    without labels of both kinds nothing goes; an empty table stays empty; other columns pass through."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more over shingles of five words one stays, that of the smallest id.

    Null and empty texts are linked with nothing and all stay; of repeated rows one stays; a row with a null id stays only
    if its group has no other; an empty table stays empty; other columns pass through."""
    return jaccard.drop_near_duplicates(docs, width=5, num=4, den=5)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows of 20 that have stood earlier in the collection go; texts that lose none stay as they are.

    No row goes: a text may become empty. Null and short texts stay; wholly equal rows count as one document; null ids come
    last; an empty table stays empty; a column n_chars, where there is one, is counted anew; others pass through."""
    out = substring.remove_repeats(docs)
    own = {c: F.col(f"`{c}`") for c in docs.columns}
    if "n_chars" in own:
        own["n_chars"] = F.length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return out.select(*own.values())


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lies in windows of the benchmark go.

    Null and wordless texts stay; repeated rows are judged alike; an empty benchmark rejects nothing; an empty table stays
    empty; other columns pass through."""
    return decontam.drop_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: a row for each reading of a document, with the columns copy, taken, position and target.

    Documents of which nothing is taken (null, empty and wordless ones among them) have no row; repeated rows are read each;
    a null source is one of its own; an empty table stays empty; columns named like an added one are replaced."""
    added = {"_copy": "copy", "_words": "taken", "_position": "position", "_target": "target"}
    docs = docs.drop(*added.values())
    # the document travels as one column, so that no name of its own meets one of the mixture's
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), "doc_id", "text", "source")
    out = mixing.training_order(mixing.mix(rows))
    return out.select("doc.*", *(F.col(a).alias(b) for a, b in added.items()))


STAGES = [("toxicity", toxic), ("near_duplicates", near_duplicates), ("passages", passages), ("benchmark", benchmark), ("mixing", mixture)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return stored(STAGES[-1][1](spark, docs, sf_dir), STAGES[-1][0])
