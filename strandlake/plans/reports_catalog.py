"""Queries of the audit, summaries and metrics, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import attachments_normalised
from ..operators import dedup, metrics, reports
from ..sources import poly
from .catalog import _POLY, _NORM, _STARS, _STR, brands, query, read

_RULES = """rules AS (SELECT p_brand AS fragment_id, (ARRAY['core', 'core', 'derived_attribute', 'deprecated_alias', 'rejected'])[1 + substr(p_brand, 7, 1)::INT % 5] AS status,
    count(*) * 100 AS raw_matches, count(*) FILTER (p_size < 45) * 100 AS normalized_matches, count(*) FILTER (p_size < 45) AS normalized_records,
    CASE WHEN substr(p_brand, 8, 1) = '1' THEN 0 ELSE count(*) FILTER (p_size < 40) * 100 END AS resolved_matches,
    CASE substr(p_brand, 8, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN count(*) * 20 ELSE count(*) END AS resolved_records FROM part GROUP BY p_brand),
    a AS (SELECT *, status = 'core' AS active, resolved_records / (SELECT count(*) FROM part)::DOUBLE AS ratio,
        CASE WHEN raw_matches > 0 THEN (raw_matches - normalized_matches) / raw_matches::DOUBLE ELSE 0 END AS raw_drop,
        CASE WHEN normalized_matches = 0 THEN 0 WHEN status = 'core' THEN (normalized_matches - resolved_matches) / normalized_matches::DOUBLE ELSE 1 END AS drop FROM rules)"""


def rule_rows(spark, sf_dir):
    """Rows of an audit made from brands: a digit of the name tells the status, another how often a rule is hit."""
    digit = lambda i: F.substring("p_brand", i, 1)
    n, size = F.count(F.lit(1)), F.col("p_size")
    some = lambda c: F.count(F.when(c, 1))
    status = F.element_at(F.array(*map(F.lit, ("core", "core", "derived_attribute", "deprecated_alias", "rejected"))), digit(7).cast("int") % 5 + 1)
    out = read(spark, sf_dir, "part").groupBy("p_brand").agg((n * 100).alias("raw_matches"), (some(size < 45) * 100).alias("normalized_matches"), some(size < 45).alias("normalized_records"), some(size < 40).alias("_less"), n.alias("_n"))
    records = F.when(digit(8) == "1", 0).when(digit(8) == "2", 1).when(digit(8) == "3", F.col("_n") * 20).otherwise(F.col("_n"))
    out = out.select(F.col("p_brand").alias("fragment_id"), status.alias("status"), "raw_matches", "normalized_matches", "normalized_records", F.when(digit(8) == "1", 0).otherwise(F.col("_less") * 100).alias("resolved_matches"), records.alias("resolved_records"))
    total = read(spark, sf_dir, "part").agg(F.count(F.lit(1)).alias("_total"))
    rows = out.withColumn("active", F.col("status") == "core").crossJoin(F.broadcast(total))  # a single row
    return reports.audited(rows, F.col("_total"))


@query(f"""WITH {_RULES} SELECT fragment_id, status, ratio AS resolved_ratio, CASE WHEN active AND (ratio >= 0.5 OR (ratio > 0 AND ratio < 0.005)) THEN '{reports.WATCH}' WHEN active AND resolved_records = 0 THEN '{reports.ATTENTION}' ELSE '{reports.PASSED}' END AS risk,
    CASE WHEN active AND (ratio >= 0.5 OR (ratio > 0 AND ratio < 0.005)) THEN 'info' WHEN active AND resolved_records = 0 THEN 'warn' ELSE 'ok' END AS badge,
    CASE WHEN t = '' THEN '{reports.NOTES['default']}' ELSE t END AS notes FROM (SELECT *, concat_ws(' / ',
        CASE WHEN active AND resolved_records = 0 THEN '{reports.NOTES['none_hit']}' END, CASE WHEN active AND ratio > 0 AND ratio < 0.005 THEN '{reports.NOTES['rare']}' END,
        CASE WHEN active AND ratio >= 0.5 THEN '{reports.NOTES['general']}' END, CASE WHEN raw_drop >= 0.2 THEN '{reports.NOTES['raw_drop']}' END,
        CASE WHEN active AND drop >= 0.2 THEN '{reports.NOTES['suppressed']}' END, CASE WHEN NOT active AND normalized_matches > 0 THEN '{reports.NOTES['audit_only']}' END,
        CASE WHEN status IN ('deprecated_alias', 'rejected') THEN status || '{reports.NOTES['not_downstream']}' END) AS t FROM a)""")
def rule_audit(spark, sf_dir):
    return rule_rows(spark, sf_dir).select("fragment_id", "status", "resolved_ratio", "risk", "badge", F.array_join("notes", " / ").alias("notes"))


@query(f"""WITH {_RULES} SELECT 'high_generic' AS report, fragment_id FROM a WHERE active AND ratio >= 0.5 UNION ALL SELECT 'low_core', fragment_id FROM a WHERE active AND ratio > 0 AND ratio < 0.005
    UNION ALL SELECT 'nonactive_with_hits', fragment_id FROM a WHERE NOT active AND (normalized_records > 0 OR normalized_matches > 0)""")
def rule_audit_groups(spark, sf_dir):
    return reports.groups(rule_rows(spark, sf_dir))


@query(f"WITH {_RULES} SELECT status, count(*) AS rules, count(*) FILTER (active) AS active FROM a GROUP BY 1")
def rule_status_counts(spark, sf_dir):
    return reports.status_counts(rule_rows(spark, sf_dir))


@query(f"WITH {_RULES} SELECT fragment_id, resolved_matches FROM a WHERE active ORDER BY resolved_matches DESC, fragment_id LIMIT 12")
def rule_audit_largest(spark, sf_dir):
    return reports.largest(rule_rows(spark, sf_dir).filter("active"), 12, F.desc("resolved_matches")).select("fragment_id", "resolved_matches")


@query("""SELECT attribute, label, count(DISTINCT doc_id) AS records, count(*) AS matches FROM (SELECT doc_id, 'lang' AS attribute, coalesce(lang, 'unknown') AS label FROM documents
    UNION ALL SELECT doc_id, 'source', coalesce(source, 'unknown') FROM documents UNION ALL SELECT doc_id, 'long', CASE WHEN n_chars > 1000 THEN 'true' ELSE 'false' END FROM documents
    UNION ALL SELECT doc_id, 'tags', CASE WHEN n_chars % 3 = 0 THEN 'none' ELSE 'a,b' END FROM documents) GROUP BY 1, 2""")
def attribute_distribution(spark, sf_dir):
    tags = F.when(F.col("n_chars") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("a"), F.lit("b")))
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", (F.col("n_chars") > 1000).alias("long"), tags.alias("tags"))
    return reports.attribute_distributions(rows, "doc_id", ["lang", "source", "long", "tags"])


@query("SELECT avg(n) AS avg, median(n) AS median, max(n) AS max, (SELECT string_agg(n || ':' || c, ',' ORDER BY n) FROM (SELECT n, count(*) AS c FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY n)) AS histogram FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)")
def distribution_summary(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    cells = F.transform(F.map_entries("histogram"), lambda x: F.concat_ws(":", x["key"], x["value"]))
    return reports.summary(per, "n").withColumn("histogram", F.array_join(cells, ","))


@query(f"""WITH {_STR}, f AS (SELECT 'phase_0_cleaning' AS stage, record_type AS reason, smiles FROM c WHERE record_type NOT IN ('main_repeat_unit', 'monomer_or_descriptor_record', 'copolymer_candidate')),
    d AS (SELECT stage, reason, smiles, row_number() OVER (PARTITION BY stage, reason ORDER BY smiles) AS p FROM (SELECT DISTINCT * FROM f))
    SELECT stage, reason, (SELECT count(*) FROM f WHERE f.stage = d.stage AND f.reason = d.reason) AS n, string_agg(smiles, ' ' ORDER BY smiles) AS examples FROM d WHERE p <= 20 GROUP BY 1, 2""")
def failure_report(spark, sf_dir):
    failed = dedup.failed_cases(dedup.by_string(poly.property_records(spark, sf_dir))).select("stage", F.col("record_type").alias("reason"), "raw_smiles")
    nothing = failed.limit(0).drop("reason")
    return reports.failure_counts(reports.failures(failed, nothing), "raw_smiles").withColumn("examples", F.array_join("examples", " "))


def label_sides(spark, sf_dir):
    labels, docs = read(spark, sf_dir, "labels"), read(spark, sf_dir, "documents")
    truth = labels.filter("toxic = 1").select("doc_id", F.lit("toxic").alias("label")).union(labels.filter("quality = 1").select("doc_id", F.lit("quality").alias("label")))
    found = docs.filter("n_chars % 2 = 0").select("doc_id", F.lit("toxic").alias("label")).union(docs.filter("n_chars > 1500").select("doc_id", F.lit("quality").alias("label")))
    return metrics.multilabel(truth, found, "doc_id", "label")


_LABELS = """t AS (SELECT DISTINCT doc_id, 'toxic' AS label FROM labels WHERE toxic = 1 UNION SELECT DISTINCT doc_id, 'quality' FROM labels WHERE quality = 1),
    f AS (SELECT doc_id, 'toxic' AS label FROM documents WHERE n_chars % 2 = 0 UNION SELECT doc_id, 'quality' FROM documents WHERE n_chars > 1500),
    p AS (SELECT l.label, (SELECT count(*) FROM t JOIN f USING (doc_id, label) WHERE label = l.label) AS hits, (SELECT count(*) FROM t WHERE label = l.label) AS wanted, (SELECT count(*) FROM f WHERE label = l.label) AS given FROM (VALUES ('toxic'), ('quality')) l(label))"""


@query(f"WITH {_LABELS} SELECT label, hits, wanted, given, hits / given::DOUBLE AS precision, hits / wanted::DOUBLE AS recall, 2 * hits / (wanted + given)::DOUBLE AS f1 FROM p")
def multilabel_f1(spark, sf_dir):
    return label_sides(spark, sf_dir)[0]


@query(f"WITH {_LABELS} SELECT sum(hits) / sum(given)::DOUBLE AS micro_precision, sum(hits) / sum(wanted)::DOUBLE AS micro_recall, 2 * sum(hits) / (sum(wanted) + sum(given))::DOUBLE AS micro_f1, avg(2 * hits / (wanted + given)::DOUBLE) AS macro_f1 FROM p")
def multilabel_overall(spark, sf_dir):
    return label_sides(spark, sf_dir)[1]


@query("""WITH a AS (SELECT l_orderkey AS r, l_partkey AS k, count(*) AS a FROM lineitem WHERE l_linenumber <> 3 GROUP BY 1, 2), b AS (SELECT l_orderkey AS r, l_partkey AS k, count(*) AS b FROM lineitem WHERE l_linenumber <> 5 GROUP BY 1, 2),
    j AS (SELECT r, count(*) FILTER (a > 0 AND b > 0) AS shared, count(*) AS either, count(b) AS in_b, bool_and(a IS NOT DISTINCT FROM b) AS same FROM a FULL JOIN b USING (r, k) GROUP BY r)
    SELECT count(*) AS records, count(*) FILTER (shared = either) / count(*)::DOUBLE AS presence_consistency, avg(shared / either::DOUBLE) AS key_jaccard, count(*) FILTER (same) / count(*)::DOUBLE AS count_consistency, sum(in_b - shared) / sum(in_b)::DOUBLE AS new_key_rate FROM j""")
def view_stability(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("r"), F.col("l_partkey").alias("k"), "l_linenumber")
    return metrics.stability(rows.filter("l_linenumber <> 3"), rows.filter("l_linenumber <> 5"), "r", "k")


@query("""WITH m AS (SELECT DISTINCT p_brand, l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey), s AS (SELECT p_brand AS a, count(*) AS records FROM m GROUP BY 1)
    SELECT a, b, shared, records, shared / records::DOUBLE AS share FROM (SELECT x.p_brand AS a, y.p_brand AS b, count(*) AS shared FROM m x JOIN m y USING (l_orderkey) WHERE x.p_brand <> y.p_brand GROUP BY 1, 2) JOIN s USING (a) WHERE shared / records::DOUBLE >= 0.15""")
def label_redundancy(spark, sf_dir):
    return metrics.redundant(brands(spark, sf_dir), "p_brand", "l_orderkey", 0.15).select("a", "b", "shared", "records", "share")


@query("""WITH r AS (SELECT event_id, user_id || '|' || event_type || '|' || coalesce(floor(value)::BIGINT::VARCHAR, '') AS k FROM events) SELECT count(DISTINCT k) AS keys, (SELECT count(*) FROM (SELECT k FROM r GROUP BY k HAVING count(DISTINCT event_id) > 1)) AS collisions,
    count(DISTINCT event_id) AS instances, (SELECT count(*) FROM (SELECT event_id FROM r GROUP BY event_id HAVING count(DISTINCT k) > 1)) AS unstable FROM r""")
def key_collisions(spark, sf_dir):
    key = F.concat_ws("|", "user_id", "event_type", F.coalesce(F.floor("value").cast("long").cast("string"), F.lit("")))
    return metrics.key_quality(read(spark, sf_dir, "events").withColumn("k", key), "event_id", "k")


@query("SELECT l_returnflag || '|' || l_linestatus || '|' || l_linenumber AS instance_key FROM lineitem GROUP BY 1")
def instance_dedup(spark, sf_dir):
    return metrics.instances(read(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"]).select("instance_key")


@query("SELECT l_orderkey, max(l_returnflag = 'A')::INT AS \"A\", max(l_returnflag = 'N')::INT AS \"N\", max(l_returnflag = 'R')::INT AS \"R\" FROM lineitem GROUP BY 1")
def label_presence(spark, sf_dir):
    return metrics.presence(read(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


@query("""SELECT pattern, count(*) AS n FROM (SELECT CASE WHEN lo = 0 AND hi = 0 THEN 'internal' WHEN lo = -1 AND hi = 0 THEN 'cross_left' WHEN lo = 0 AND hi = 1 THEN 'cross_right' WHEN lo < 0 AND hi > 0 THEN 'cross_both' ELSE 'multi_period' END AS pattern
    FROM (SELECT min(l_linenumber - 2) AS lo, max(l_linenumber - 2) AS hi FROM lineitem GROUP BY l_orderkey)) GROUP BY 1""")
def boundary_patterns(spark, sf_dir):
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_linenumber") - 2).alias("offsets"))
    return per.groupBy(metrics.boundary(F.col("offsets")).alias("pattern")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {_POLY} SELECT length(smiles) // 4 AS bucket, count(*) AS outputs, count(*) FILTER (smiles = {_NORM}) / count(*)::DOUBLE AS exact_match, count(*) FILTER ({_STARS.format('smiles')} = 2) / count(*)::DOUBLE AS two_attachments,
    count(*) FILTER (smiles = '') / count(*)::DOUBLE AS empty, avg(levenshtein(smiles, {_NORM})) AS edit_distance FROM poly GROUP BY 1""")
def output_validity(spark, sf_dir):
    rows = poly.poly(spark, sf_dir).withColumn("target", attachments_normalised(F.col("smiles")))
    return metrics.output_validity(rows, "target", "smiles", F.floor(F.length("smiles") / 4))


@query("SELECT stage, attempted, succeeded, succeeded / attempted::DOUBLE AS rate, CASE WHEN succeeded / attempted::DOUBLE >= 0.7 THEN 'Green' WHEN succeeded / attempted::DOUBLE >= 0.66 THEN 'Yellow' ELSE 'Red' END AS grade FROM (SELECT o_orderpriority AS stage, count(*) AS attempted, count(*) FILTER (o_orderstatus <> 'F') AS succeeded FROM orders GROUP BY 1)")
def graded_stages(spark, sf_dir):
    stages = read(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("stage")).agg(F.count(F.lit(1)).alias("attempted"), F.count(F.when(F.col("o_orderstatus") != "F", 1)).alias("succeeded"))
    return metrics.graded(stages, 0.7, 0.66)
