"""Queries of failures, scans, drift, written outputs, retrieval and prompts, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import attachments_normalised
from ..operators import anchors, dedup, fragments, periodic, rules, validation, views
from ..sources import poly
from .catalog import _MATCH, _UNITS, main_units, query, read
from .checks_catalog import ANCHORS
from .periodic_catalog import _OWNED, _STATED, RULES, chains

#: Rules without rings, and their anchors but for one.
OPEN = tuple(r for r in RULES if r.ring_size is None)
PARTLY = {f: a for f, a in ANCHORS.items() if f not in ("six_ring", "thioether")}
_SULFUR = "contains(normalized, 'S') AND NOT contains(normalized, 'O')"


# every distinct string: of those with a chain, sulfur has no anchor, and plain chains and rings have no rule
@query(f"""{_STATED} SELECT code, count(*) AS records, count(*)::BIGINT AS failures FROM (SELECT CASE WHEN contains(normalized, '[R') OR contains(normalized, ',') THEN 'PARSER_FAILED' WHEN stars <> 2 THEN 'STANDARDIZATION_FAILED'
    WHEN {_SULFUR} THEN 'ANCHOR_NOT_FOUND' WHEN NOT (contains(normalized, 'O') OR contains(normalized, 'C#N')) THEN 'NO_FRAGMENT_MATCHED' END AS code FROM a) WHERE code IS NOT NULL GROUP BY 1""")
def failure_taxonomy(spark, sf_dir):
    text = dedup.by_string(poly.property_records(spark, sf_dir)).select(attachments_normalised(F.col("smiles")).alias("smiles")).distinct()
    rows = periodic.chains(fragments.molecules(text))
    found = validation.failure_codes(rows, anchors.anchored(rows, OPEN, PARTLY))
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("records"), F.sum("failures").alias("failures"))


# what shifted single units find of what the centred expansion owns: a cut can't show more segments than the unit has
@query(f"""{_UNITS}, o AS (SELECT fragment_id, (way = 'internal' OR linker = 'C(=O)O' OR n >= 2) AS seen FROM u JOIN {_OWNED} USING (linker))
    SELECT fragment_id, count_if(seen)::BIGINT AS found, count(*) AS instances, 0.0::DOUBLE AS duplicate_rate, 0.0::DOUBLE AS false_neighbour_rate, count_if(seen) / count(*)::DOUBLE AS ownership_accuracy FROM o GROUP BY 1""")
def scan_quality(spark, sf_dir):
    rows = chains(spark, sf_dir)
    unit = periodic.centred(rows, RULES, 0)
    return validation.scan_quality(periodic.united(unit, periodic.scanned(rows, RULES, unit)), periodic.centred(rows, RULES))


@query(f"""{_MATCH}, i AS (SELECT doc_id, lang = 'en' AS inside FROM documents), k AS (SELECT count_if(inside) AS a, count_if(NOT inside) AS b FROM i),
    c AS (SELECT fragment_id, count(DISTINCT record_id) FILTER (inside) AS x, count(DISTINCT record_id) FILTER (NOT inside) AS y FROM ids LEFT JOIN (SELECT * FROM r JOIN i ON record_id = doc_id) USING (fragment_id) GROUP BY 1)
    SELECT fragment_id, x / a::DOUBLE AS inside_share, y / b::DOUBLE AS outside_share, y / b::DOUBLE - x / a::DOUBLE AS drift FROM c, k""")
def coverage_drift(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    of = lambda rows: rules.coverage(rules.resolved(rules.normalised(rules.matches(rows))), spark)
    inside, outside = docs.filter("lang = 'en'"), docs.filter("lang <> 'en'")
    return validation.drift(of(inside), of(outside), inside.count(), outside.count())


_WRITTEN = """w AS (SELECT normalized AS target, linker, n, CASE n % 4 WHEN 0 THEN normalized WHEN 1 THEN normalized[:length(normalized) - 1] WHEN 2 THEN normalized || ')' ELSE CASE WHEN linker IN ('O', 'S') THEN '*' || linker || repeat('C', n::INT) || '*' ELSE '' END END AS output FROM u),
    x AS (SELECT *, length(target) // 4 AS bucket, n % 4 IN (0, 1) OR n % 4 = 3 AND linker IN ('O', 'S') AS ok FROM w)"""


# equal, cut short, not readable, or the same unit begun at its hetero atom
@query(f"""{_UNITS}, {_WRITTEN} SELECT bucket, count(*) AS outputs, count_if(output = target) / count(*)::DOUBLE AS exact_match, count_if(ok) / count(*)::DOUBLE AS parse_validity, count_if(len(output) - len(replace(output, '*', '')) = 2) / count(*)::DOUBLE AS two_attachment_validity,
    count_if(ok AND (output = target OR n % 4 = 3)) / count(*)::DOUBLE AS canonical_match, count_if(NOT ok) / count(*)::DOUBLE AS invalid_rate, avg(levenshtein(output, target)) AS edit_distance FROM x GROUP BY 1""")
def output_report(spark, sf_dir):
    s, n = F.col("smiles"), F.length(F.regexp_replace("smiles", r"C\(=O\)[ON]|c1ccc\(cc1\)|C\(C#N\)|[OS*]", ""))
    hetero = F.regexp_extract("smiles", r"^\*?C*([OS])C*\*$", 1)
    turned = F.when(hetero != "", F.concat(F.lit("*"), hetero, F.repeat(F.lit("C"), n), F.lit("*"))).otherwise("")
    output = F.when(n % 4 == 0, s).when(n % 4 == 1, F.substring(s, F.lit(1), F.length(s) - 1)).when(n % 4 == 2, F.concat(s, F.lit(")"))).otherwise(turned)
    rows = main_units(spark, sf_dir).select("smiles", output.alias("output"))
    return validation.output_report(rows, "smiles", "output", F.floor(F.length("smiles") / 4))


# each vector is asked for by a view of itself that lacks every fourth component
_VIEWS = """c AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
    q AS (SELECT id, list_transform(v, lambda x, i: CASE WHEN i % 4 = 1 THEN 0 ELSE x END) AS v FROM c WHERE id % 50 = 0),
    s AS (SELECT q.id AS q, c.id AS c, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM q, c),
    p AS (SELECT q, score AS own FROM s WHERE q = c),
    b AS (SELECT s.q, any_value(own) AS own, count_if(c <> s.q AND (score > own OR score = own AND c < s.q)) AS before, sum(score) FILTER (c <> s.q) AS other, count_if(c <> s.q) AS others FROM s JOIN p ON s.q = p.q GROUP BY 1)"""


@query(f"WITH {_VIEWS} SELECT count(*) AS queries, count_if(before < 1) / count(*)::DOUBLE AS top1, count_if(before < 5) / count(*)::DOUBLE AS top5, avg(own) AS mean_positive, sum(other)::DOUBLE / sum(others)::DOUBLE AS mean_negative FROM b")
def view_retrieval(spark, sf_dir):
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 64))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), whole.alias("vector"))
    asked = rows.filter("id % 50 = 0").select("id", F.transform("vector", lambda x, i: F.when(i % 4 == 0, F.lit(0).cast("long")).otherwise(x)).alias("vector"))
    return validation.retrieval(asked, rows)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '<polymer_smiles>' || chr(10) || coalesce(text, '') || chr(10) || '</polymer_smiles>' ELSE '<polymer_view_smiles>' || chr(10) || coalesce(text, '') || chr(10) || '</polymer_view_smiles>' END AS prompt,
    coalesce(text, '') || '<|endoftext|>' AS completion FROM documents""")
def view_prompts(spark, sf_dir):
    view = F.when(F.col("doc_id") % 3 == 0, "plain").otherwise("token_mask")
    rows = read(spark, sf_dir, "documents").select("doc_id", view.alias("view"), F.col("text").alias("input"), F.col("text").alias("target"))
    return views.prompts(rows).select("doc_id", "prompt", "completion")


@query("""SELECT p_partkey, '<fragment_description>' || chr(10) || 'id: ' || p_partkey::VARCHAR || chr(10) || 'name: ' || coalesce(p_name, '') || chr(10) || 'category: ' || coalesce(p_type, '') || chr(10) || 'description: ' || coalesce(p_brand, '') || chr(10) || '</fragment_description>' AS prompt FROM part""")
def fragment_prompts(spark, sf_dir):
    text = views.described(F.col("p_partkey"), F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", text.alias("prompt"))
