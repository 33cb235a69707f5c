"""The relational queries by name, each with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import attachments_normalised, length_bucket, percent, stable_hash
from ..operators import dedup, fragments, graphs, periods, rules, stats
from ..operators.core_rules import CORE, LADDERS
from ..operators.seed_rules import SEED
from ..sources import poly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = f"WITH {sql}" if sql.lstrip().startswith(("poly", "rec", "m AS", "w AS", "s AS", "h AS")) else sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_PICK = "CASE p_partkey % 5 WHEN 0 THEN '*' WHEN 1 THEN '[*]' WHEN 2 THEN '[[*]]' WHEN 3 THEN '[[[*]]]' ELSE '{}' END"
_OPEN, _CLOSE = _PICK.format("[*:1]"), _PICK.format("[*:2]")
_CHAIN = "repeat('C', p_size % 5 + 1)"
_LINKER = "(CASE split_part(p_type, ' ', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in poly.LINKERS.items()) + " ELSE '' END)"
_UNIT = f"CASE WHEN p_partkey % 7 = 0 AND {_LINKER} IN ('O', 'S') THEN {_LINKER} || {_CHAIN} ELSE {_CHAIN} || {_LINKER} END"
_POLY = f"""poly AS (SELECT p_partkey, CASE WHEN p_partkey % 97 = 0 THEN w || '.[Na+]' WHEN p_partkey % 89 = 0 THEN o || '[R1]' || u || c
    WHEN p_partkey % 83 = 0 THEN w || ',' || w WHEN p_partkey % 79 = 0 THEN o || u WHEN p_partkey % 73 = 0 THEN u
    WHEN p_partkey % 71 = 0 THEN w || w ELSE w END AS smiles
  FROM (SELECT *, o || u || c AS w FROM (SELECT p_partkey, {_OPEN} AS o, {_CLOSE} AS c, {_UNIT} AS u FROM part)))"""
_NORM = "regexp_replace(replace(replace(replace(replace(replace(trim(smiles), '[[[*]]]', '*'), '[[*]]', '*'), '[*:1]', '*'), '[*:2]', '*'), '[*]', '*'), '\\[\\*:\\d+\\]', '*', 'g')"
_STARS = "(length({0}) - length(replace({0}, '*', '')))"
_TYPE = f"""CASE WHEN normalized = '' THEN 'parser_failed' WHEN regexp_matches(normalized, '\\[R\\d*\\]') THEN 'unresolved_R_group'
    WHEN contains(normalized, '.') THEN 'ionomer_or_multicomponent_candidate' WHEN contains(normalized, ',') THEN 'copolymer_candidate'
    WHEN {_STARS.format('normalized')} = 2 THEN 'main_repeat_unit' WHEN {_STARS.format('normalized')} = 0 THEN 'monomer_or_descriptor_record'
    WHEN {_STARS.format('normalized')} = 1 THEN 'incomplete_attachment' ELSE 'copolymer_candidate' END"""
_REC = f"{_POLY}, rec AS (SELECT smiles, l_returnflag AS cat, l_quantity::INT::VARCHAR AS value, l_orderkey * 8 + l_linenumber AS ord FROM lineitem JOIN poly ON l_partkey = p_partkey)"
_STR = f"{_REC}, s AS (SELECT smiles, count(*) AS n FROM rec GROUP BY smiles), c AS (SELECT *, {_TYPE} AS record_type FROM (SELECT *, {_NORM} AS normalized FROM s))"


@query(f"{_REC} SELECT smiles, count(*) AS property_record_count, count(DISTINCT cat) AS categories, min_by(value, ord) AS first_value, max_by(value, ord) AS last_value FROM rec GROUP BY smiles")
def prop_long_scan_group(spark, sf_dir):
    return dedup.by_string(poly.property_records(spark, sf_dir))


@query(f"{_POLY} SELECT p_partkey, smiles, {_NORM} AS normalized FROM poly")
def attachment_normalize(spark, sf_dir):
    return poly.poly(spark, sf_dir).withColumn("normalized", attachments_normalised(F.col("smiles")))


def strings(spark, sf_dir):
    return dedup.by_string(poly.property_records(spark, sf_dir)).select("smiles", "property_record_count")


@query(f"{_STR} SELECT record_type, count(*) AS raw_unique, count(DISTINCT normalized) AS normalized_unique FROM c GROUP BY 1")
def record_classify_counts(spark, sf_dir):
    return dedup.type_counts(strings(spark, sf_dir))


@query(f"{_POLY} SELECT 'row' AS level, {_STARS.format('smiles')}::BIGINT AS stars, count(*) AS n FROM poly GROUP BY 2 UNION ALL SELECT 'distinct', {_STARS.format('smiles')}::BIGINT, count(DISTINCT smiles) FROM poly GROUP BY 2")
def star_distribution(spark, sf_dir):
    return dedup.star_distribution(poly.poly(spark, sf_dir))


@query(f"{_STR} SELECT normalized, count(*) AS raw_unique_count, sum(n)::BIGINT AS property_record_count, array_to_string(list(smiles ORDER BY smiles)[1:5], '|') AS examples FROM c WHERE record_type = 'main_repeat_unit' GROUP BY 1")
def level2_dedup_provenance(spark, sf_dir):
    return dedup.level2(strings(spark, sf_dir))


@query(f"{_STR} SELECT (SELECT count(*) FROM rec) AS input_rows, count(*) AS raw_unique, count(*) FILTER (record_type = 'main_repeat_unit') AS main_unique, count(DISTINCT normalized) FILTER (record_type = 'main_repeat_unit') AS normalized_unique, count(*) FILTER (record_type = 'parser_failed') AS parser_failures FROM c")
def level_funnel(spark, sf_dir):
    return dedup.funnel(poly.property_records(spark, sf_dir))


@query(f"{_STR} SELECT 'phase_0_cleaning' AS stage, record_type, smiles AS raw_smiles, normalized AS attachment_normalized_smiles FROM c WHERE record_type NOT IN ('main_repeat_unit', 'monomer_or_descriptor_record', 'copolymer_candidate')")
def failed_case_routing(spark, sf_dir):
    return dedup.failed_cases(strings(spark, sf_dir))


@query(f"{_STR} SELECT normalized, printf('ru_%06d', row_number() OVER (ORDER BY normalized)) AS record_id FROM (SELECT DISTINCT normalized FROM c WHERE record_type = 'main_repeat_unit')")
def stable_ids(spark, sf_dir):
    main = dedup.classified(strings(spark, sf_dir)).filter("record_type = 'main_repeat_unit'").select("normalized").distinct()
    return dedup.with_ids(main, "normalized", "ru", "record_id")


_MAIN = f"{_STR}, l AS (SELECT normalized, sum(n)::BIGINT AS n FROM c WHERE record_type = 'main_repeat_unit' GROUP BY 1)"


def main_graphs(spark, sf_dir):
    level2 = dedup.level2(strings(spark, sf_dir))
    return level2, graphs.graphs(level2, "normalized")


@query(f"{_MAIN}, k AS (SELECT *, CASE WHEN normalized[2] IN ('O', 'S') THEN '*' || normalized[3:length(normalized) - 1] || normalized[2] || '*' ELSE normalized END AS class FROM l) SELECT count(*) AS source_count, sum(n)::BIGINT AS property_record_count, array_to_string(list(normalized ORDER BY normalized)[1:5], '|') AS examples FROM k GROUP BY class")
def level3_canonical_dedup(spark, sf_dir):
    return graphs.level3(*main_graphs(spark, sf_dir)).drop("class_key")


@query(f"""{_MAIN} SELECT normalized AS smiles, a AS n_atoms, a - 1 + contains(normalized, 'c1')::INT AS n_bonds, CASE WHEN contains(normalized, 'c1') THEN 6 ELSE 0 END AS n_ring_atoms,
    (length(regexp_extract(normalized, '^[*][OS]?(C+)', 1)) + CASE WHEN contains(normalized, 'c1') THEN 4 WHEN contains(normalized, 'C(=O)') THEN 1 WHEN contains(normalized, 'C#N') THEN 0 WHEN normalized LIKE '*CC%' OR normalized LIKE '*C%' OR normalized LIKE '*O%' OR normalized LIKE '*S%' THEN 1 END)::INT AS backbone_length
  FROM (SELECT *, len(regexp_extract_all(normalized, '[A-Za-z*]'))::INT AS a FROM l)""")
def graph_sizes(spark, sf_dir):
    found = main_graphs(spark, sf_dir)[1]
    ring = F.size(F.filter("nodes", lambda x: x["ring_membership"]))
    return found.select("smiles", F.size("nodes").alias("n_atoms"), F.size("edges").alias("n_bonds"), ring.alias("n_ring_atoms"), "backbone_length")


@query(f"{_MAIN} SELECT normalized AS smiles, upper(e) AS element, count(*) AS n FROM (SELECT normalized, unnest(regexp_extract_all(normalized, '[A-Za-z*]')) AS e FROM l) GROUP BY 1, 2")
def graph_elements(spark, sf_dir):
    return graphs.nodes(main_graphs(spark, sf_dir)[1]).groupBy("smiles", "element").agg(F.count(F.lit(1)).alias("n"))


@query(f"{_MAIN} SELECT normalized AS smiles, 2 * (len(regexp_extract_all(normalized, '[A-Za-z*]')) - 1 + contains(normalized, 'c1')::INT)::BIGINT AS degree_sum FROM l")
def graph_degree(spark, sf_dir):
    return graphs.degrees(main_graphs(spark, sf_dir)[1]).groupBy("smiles").agg(F.sum("degree").alias("degree_sum"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", stable_hash(F.col("text")).alias("content_hash"))


@query("SELECT text AS value, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_values(spark, sf_dir):
    return dedup.duplicated(read(spark, sf_dir, "documents").select(F.col("text").alias("value")), "value")


@query("SELECT (SELECT count(*) FROM (SELECT doc_id FROM labels EXCEPT ALL SELECT doc_id FROM documents)) AS only_left, (SELECT count(*) FROM (SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels)) AS only_right, false AS equal")
def set_equality(spark, sf_dir):
    return dedup.same_rows(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents").select("doc_id"))


_PATTERNS = " UNION ALL ".join(f"SELECT doc_id AS record_id, '{r.fragment_id}' AS fragment_id, '{r.category}' AS category, regexp_extract_all(text, '{r.pattern}') AS v FROM documents" for r in rules.RULES)
_MATCH = f"""m AS (SELECT record_id, fragment_id, u.i - 1 AS match_index, v[u.i] AS value FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM ({_PATTERNS})) u),
    a AS (SELECT *, CASE WHEN fragment_id = 'TXT_IPV4' THEN regexp_extract(value, '^[0-9]+') ELSE value END AS anchor FROM m),
    n AS (SELECT record_id, fragment_id, value, min(match_index) AS match_index, min(anchor) AS anchor FROM a GROUP BY 1, 2, 3),
    r AS (SELECT * FROM n WHERE fragment_id <> 'TXT_AT' AND NOT (fragment_id = 'TXT_NUMBER' AND EXISTS (SELECT 1 FROM n x WHERE x.record_id = n.record_id AND x.fragment_id = 'TXT_IPV4' AND x.anchor = n.anchor))),
    ids AS (SELECT * FROM (VALUES {', '.join(f"('{r.fragment_id}', '{r.category}')" for r in rules.RULES)}) t(fragment_id, category)),
    cov AS (SELECT fragment_id, category, count(DISTINCT record_id) AS records, count(record_id) AS matches FROM ids LEFT JOIN r USING (fragment_id) GROUP BY 1, 2)"""


def text_matches(spark, sf_dir):
    return rules.matches(read(spark, sf_dir, "documents"))


@query(f"{_MATCH} SELECT record_id, fragment_id, match_index::INT AS match_index, value, anchor FROM a")
def text_rule_match_raw(spark, sf_dir):
    return text_matches(spark, sf_dir)


@query(f"{_MATCH} SELECT record_id, fragment_id, value, match_index::INT AS match_index, anchor FROM n")
def text_rule_normalized(spark, sf_dir):
    return rules.normalised(text_matches(spark, sf_dir))


@query(f"{_MATCH} SELECT record_id, fragment_id, value, match_index::INT AS match_index, anchor FROM r")
def text_rule_resolved(spark, sf_dir):
    return rules.resolved(rules.normalised(text_matches(spark, sf_dir))).select("record_id", "fragment_id", "value", "match_index", "anchor")


_LEVELS = ", ".join(f"(SELECT count(*) FROM p WHERE level = '{x}' AND p.fragment_id = ids.fragment_id) AS {y}_hits, coalesce((SELECT sum(k) FROM p WHERE level = '{x}' AND p.fragment_id = ids.fragment_id), 0)::BIGINT AS {y}_matches, coalesce((SELECT max(k) FROM p WHERE level = '{x}' AND p.fragment_id = ids.fragment_id), 0)::BIGINT AS {y}_max" for x, y in (("a", "raw"), ("n", "normalized"), ("r", "resolved")))


@query(f"{_MATCH}, p AS ({' UNION ALL '.join(f'''SELECT '{x}' AS level, record_id, fragment_id, count(*) AS k FROM {x} GROUP BY 2, 3''' for x in 'anr')}) SELECT fragment_id, {_LEVELS} FROM ids")
def tri_level_stats(spark, sf_dir):
    return rules.tri_level(text_matches(spark, sf_dir), spark)


@query(f"{_MATCH}, t AS (SELECT doc_id, count(DISTINCT fragment_id) AS types FROM documents LEFT JOIN r ON doc_id = record_id GROUP BY 1) SELECT count(*) AS records, count(*) FILTER (types > 0) AS covered, sum(types)::BIGINT AS type_total, median(types)::DOUBLE AS median_types FROM t")
def coverage_summary(spark, sf_dir):
    found = rules.resolved(rules.normalised(text_matches(spark, sf_dir)))
    return rules.coverage_summary(read(spark, sf_dir, "documents"), found)


@query(f"{_MATCH} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT record_id FROM r)")
def unmatched_records(spark, sf_dir):
    found = rules.resolved(rules.normalised(text_matches(spark, sf_dir)))
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(found.select(F.col("record_id").alias("doc_id")), "doc_id", "left_anti")


@query(f"{_MATCH}, k AS (SELECT count(*) AS total FROM documents) SELECT fragment_id, category, records, matches, (records >= greatest(50, ceil(0.004::DOUBLE * total)) OR records / total::DOUBLE >= 0.004::DOUBLE) AS accepted, CASE WHEN records >= greatest(50, ceil(0.004::DOUBLE * total)) OR records / total::DOUBLE >= 0.004::DOUBLE THEN 'accepted' ELSE 'rejected_low_frequency' END AS status, greatest(50, ceil(0.004::DOUBLE * total))::BIGINT AS threshold_count FROM cov, k")
def core_selection(spark, sf_dir):
    found = rules.resolved(rules.normalised(text_matches(spark, sf_dir)))
    total = read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("_total"))
    counts = rules.coverage(found, spark).crossJoin(F.broadcast(total))  # a single row
    return rules.selected(counts, F.col("_total")).drop("_total")


@query(f"{_MATCH} SELECT fragment_id, category, records, matches, CASE WHEN records >= 100 THEN 'high' WHEN records >= 20 THEN 'medium' WHEN records >= 5 THEN 'low' ELSE 'rare' END AS tier FROM cov")
def coverage_tier(spark, sf_dir):
    found = rules.resolved(rules.normalised(text_matches(spark, sf_dir)))
    return stats.tiers(rules.coverage(found, spark), "records")


def brands(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey").join(read(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


_PAIRS = """m AS (SELECT DISTINCT p_brand AS g, l_orderkey AS r FROM lineitem JOIN part ON l_partkey = p_partkey), z AS (SELECT g, count(*) AS n FROM m GROUP BY 1),
    o AS (SELECT x.g AS a, y.g AS b, count(*) AS shared FROM m x JOIN m y ON x.r = y.r AND x.g < y.g GROUP BY 1, 2),
    q AS (SELECT a, b, p.n AS n_a, s.n AS n_b, shared, shared / (p.n + s.n - shared)::DOUBLE AS jaccard, shared / least(p.n, s.n)::DOUBLE AS containment FROM o JOIN z p ON a = p.g JOIN z s ON b = s.g)"""


@query(f"{_PAIRS} SELECT * FROM q WHERE jaccard >= 0.08::DOUBLE OR containment >= 0.9::DOUBLE")
def overlap_pairs_strict(spark, sf_dir):
    return rules.overlaps(brands(spark, sf_dir), "p_brand", "l_orderkey", 0.08, 0.9)


@query(f"{_PAIRS} SELECT * FROM q WHERE shared >= 25 AND (jaccard >= 0.075::DOUBLE OR containment >= 0.9::DOUBLE)")
def overlap_pairs_audit(spark, sf_dir):
    return rules.overlaps(brands(spark, sf_dir), "p_brand", "l_orderkey", 0.075, 0.9, 25)


@query(f"{_PAIRS} SELECT *, row_number() OVER (ORDER BY jaccard DESC, shared DESC, a, b)::INT AS place FROM q WHERE shared >= 25 AND (jaccard >= 0.075::DOUBLE OR containment >= 0.9::DOUBLE) ORDER BY place LIMIT 30")
def overlap_report(spark, sf_dir):
    return rules.overlap_report(overlap_pairs_audit(spark, sf_dir))


_MOTIF = """w AS (SELECT doc_id, string_split(lower(text), ' ') AS w FROM documents), g AS (SELECT doc_id, array_to_string(w[i:i + 1], ' ') AS motif FROM (SELECT *, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM w)),
    t AS (SELECT motif, count(DISTINCT doc_id) AS records, count(*) AS matches FROM g GROUP BY 1 HAVING count(DISTINCT doc_id) >= 15 ORDER BY 2 DESC, 1 LIMIT 300)"""


@query(f"{_MOTIF} SELECT * FROM t")
def motif_mining(spark, sf_dir):
    return rules.motifs(read(spark, sf_dir, "documents"), 15, 300)


@query(f"{_MOTIF} SELECT length(motif)::INT AS chars, count(*) AS motif_count, array_to_string(list(motif ORDER BY motif)[1:50], '|') AS members FROM t GROUP BY 1")
def motif_clusters(spark, sf_dir):
    found = rules.motifs(read(spark, sf_dir, "documents"), 15, 300)
    return found.groupBy(F.length("motif").alias("chars")).agg(F.count(F.lit(1)).alias("motif_count"), F.array_join(dedup.smallest("motif", 50), "|").alias("members"))


_BYTE = "16 * (instr('0123456789abcdef', substr(d, 1, 1)) - 1) + instr('0123456789abcdef', substr(d, 2, 1)) - 1"
_SPLIT = f"s AS (SELECT doc_id, u, CASE WHEN b < 205 THEN 'train' WHEN b < 230 THEN 'valid' ELSE 'test' END AS split FROM (SELECT *, {_BYTE} AS b FROM (SELECT doc_id, sha256(text) AS u, sha256('v1' || sha256(text)) AS d FROM documents)))"


def split_docs(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", stable_hash(F.col("text")).alias("u"))
    return stats.hash_split(rows, F.col("u"), "v1")


@query(f"{_SPLIT} SELECT * FROM s")
def group_hash_split(spark, sf_dir):
    return split_docs(spark, sf_dir)


@query(f"{_SPLIT} SELECT count(*) AS keys, count(*) FILTER (n > 1) AS leaked FROM (SELECT u, count(DISTINCT split) AS n FROM s GROUP BY 1)")
def split_leakage(spark, sf_dir):
    return stats.leakage(split_docs(spark, sf_dir), "u")


@query(f"{_SPLIT} SELECT split, count(*) AS rows, count(DISTINCT u) AS units FROM s GROUP BY 1")
def split_manifest(spark, sf_dir):
    return split_docs(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("u").alias("units"))


_RANKS = ", ".join(f"min(CASE WHEN k = round_even((c - 1) * {p}::DOUBLE, 0) THEN n_chars END) AS p{round(p * 100)}" for p in stats.PERCENTILES)
_LENGTHS = f"h AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS k, count(*) OVER (PARTITION BY lang) AS c FROM documents), l AS (SELECT lang, count(*) AS n, min(n_chars) AS least, {_RANKS}, max(n_chars) AS most, round_even(sum(n_chars) / count(*)::DOUBLE, 4) AS mean FROM h GROUP BY 1)"


@query(f"{_LENGTHS} SELECT * FROM l")
def length_stats(spark, sf_dir):
    return stats.length_stats(read(spark, sf_dir, "documents"), "lang", "n_chars")


@query("SELECT bucket, count(*) AS n FROM (SELECT CASE WHEN n_chars <= 128 THEN 128 WHEN n_chars <= 256 THEN 256 WHEN n_chars <= 512 THEN 512 WHEN n_chars <= 1024 THEN 1024 ELSE 2048 END AS bucket FROM documents) GROUP BY 1")
def seq_len_bucket(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(length_bucket(F.col("n_chars")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT token, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE token <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50")
def top_tokens(spark, sf_dir):
    return stats.top_tokens(read(spark, sf_dir, "documents"), 50)


@query("SELECT ch, (SELECT count(*) FROM documents WHERE contains(text, ch)) AS n FROM (VALUES ('*'), ('/'), ('\\'), ('['), (']'), ('%')) t(ch)")
def critical_chars(spark, sf_dir):
    return stats.critical_chars(read(spark, sf_dir, "documents"))


@query("SELECT lang, place::INT AS place, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS place FROM documents) WHERE place <= 10")
def longest_examples(spark, sf_dir):
    return stats.longest(read(spark, sf_dir, "documents"), "lang", "n_chars", "doc_id", 10)


@query("SELECT count(*) AS rows, count(*) FILTER (array_to_string(string_split(text, ' '), ' ') <> text) AS failures FROM documents")
def roundtrip_failures(spark, sf_dir):
    back = F.array_join(F.split("text", " "), " ") != F.col("text")
    return read(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(back, 1)).alias("failures"))


@query("SELECT conv_id, count(*) AS turns, string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn) AS rendered FROM conversations GROUP BY 1")
def chat_render(spark, sf_dir):
    return stats.rendered_chat(read(spark, sf_dir, "conversations"))


@query("SELECT bin, n, share, height, printf('%.2f%%', share * 100) AS label FROM (SELECT l_linenumber AS bin, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share, count(*) / max(count(*)) OVER ()::DOUBLE * 100 AS height FROM lineitem GROUP BY 1)")
def histogram_pct(spark, sf_dir):
    return stats.histogram(read(spark, sf_dir, "lineitem"), F.col("l_linenumber")).withColumn("label", percent(F.col("share")))


@query("SELECT source, place::INT AS place, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('a' || doc_id::VARCHAR)) AS place FROM documents) WHERE place <= 3")
def stratified_sample(spark, sf_dir):
    return stats.sampled(read(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 3, "a").select("source", "place", "doc_id")


_FAULTY = """f AS (SELECT 'P' || (p_partkey - (p_partkey % 11 = 0)::INT)::VARCHAR AS fragment_id, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN '' ELSE p_type END AS pattern,
    CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE 'core' END AS status, p_partkey % 17 = 0 AS self FROM part)"""


@query(f"""WITH {_FAULTY} SELECT fragment_id, concat_ws(';', CASE WHEN count(*) OVER (PARTITION BY fragment_id) > 1 THEN 'duplicate_id' END, CASE WHEN coalesce(pattern, '') = '' THEN 'missing_pattern' END,
    CASE WHEN status <> 'core' THEN 'unknown_status' END, CASE WHEN self THEN 'self_cover' END) AS errors FROM f""")
def rule_validate(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.concat(F.lit("P"), (k - (k % 11 == 0).cast("int")).cast("string"))
    rows = read(spark, sf_dir, "part").select(name.alias("fragment_id"), F.when(k % 7 == 0, None).when(k % 13 == 0, "").otherwise(F.col("p_type")).alias("pattern"), F.when(k % 3 == 0, F.col("p_brand")).otherwise("core").alias("status"), F.when(k % 17 == 0, F.array(name)).otherwise(F.array()).alias("covered_by"))
    return rules.rule_errors(rows)


# closed forms of the generated repeat units: what each linker holds, and how long its backbone is
_UNITS = f"""{_STR}, u AS (SELECT *, length(normalized) - 2 - length(linker) AS n FROM (SELECT DISTINCT normalized,
    CASE WHEN contains(normalized, 'C(=O)O') THEN 'C(=O)O' WHEN contains(normalized, 'C(=O)N') THEN 'C(=O)N' WHEN contains(normalized, 'c1') THEN 'c1ccc(cc1)'
    WHEN contains(normalized, 'C(C#N)') THEN 'C(C#N)' WHEN contains(normalized, 'O') THEN 'O' WHEN contains(normalized, 'S') THEN 'S' ELSE '' END AS linker
    FROM c WHERE record_type = 'main_repeat_unit'))"""
_HELD = """h AS (SELECT * FROM (VALUES ('O', 4, 1, 1, 1), ('C(=O)O', 3, 1, 1, 1), ('C(=O)O', 14, 1, 1, 0), ('C(=O)N', 1, 1, 1, 1), ('C(=O)N', 14, 1, 1, 0), ('C(=O)N', 13, 2, 0, 0), ('C(=O)N', 23, 1, 0, 0),
    ('c1ccc(cc1)', 19, 1, 1, 1), ('S', 8, 1, 1, 1), ('C(C#N)', 11, 1, 1, 1)) t(linker, f, a, b, c))"""


def main_units(spark, sf_dir):
    rows = dedup.classified(dedup.by_string(poly.property_records(spark, sf_dir)))
    return rows.filter("record_type = 'main_repeat_unit'").select(F.col("normalized").alias("smiles")).distinct()


@query(f"""{_UNITS}, {_HELD} SELECT 'fragment_' || lpad(i::VARCHAR, 3, '0') AS fragment_id, coalesce(sum(a), 0) AS raw, coalesce(sum(b), 0) AS normalized, coalesce(sum(c), 0) AS resolved
    FROM range(1, 32) r(i) LEFT JOIN (SELECT f, a, b, h.c FROM u JOIN h USING (linker)) ON f = i GROUP BY i""")
def fragment_levels(spark, sf_dir):
    found = fragments.levels(fragments.molecules(main_units(spark, sf_dir)), CORE)
    return fragments.statistics(found, spark, CORE).select("fragment_id", F.col("raw_matches").alias("raw"), F.col("normalized_matches").alias("normalized"), F.col("resolved_matches").alias("resolved"))


@query(f"{_UNITS} SELECT normalized AS smiles FROM u WHERE linker = ''")
def fragment_uncovered(spark, sf_dir):
    return fragments.uncovered(fragments.levels(fragments.molecules(main_units(spark, sf_dir)), CORE))


@query(f"""{_UNITS} SELECT fragment_id, environment, neighbour_signature, count(*) AS n FROM u JOIN (VALUES ('O', 'fragment_004', 'boundary_alkyl_ether', '*,C_aliphatic'), ('S', 'fragment_008', 'boundary_alkyl_thioether', '*,C_aliphatic'),
    ('C(C#N)', 'fragment_011', 'aliphatic_nitrile', 'C_aliphatic,N'), ('C(=O)O', 'fragment_014', 'acyl_heteroatom_residual', 'C_aliphatic,O'), ('C(=O)N', 'fragment_014', 'acyl_heteroatom_residual', 'C_aliphatic,N'),
    ('C(=O)N', 'fragment_013', 'secondary_nonring', '*,C_aliphatic'), ('C(=O)N', 'fragment_013', 'secondary_nonring', '*,C_aliphatic'), ('C(=O)N', 'fragment_023', 'secondary_amine_linker', '*,C_aliphatic')) t(linker, fragment_id, environment, neighbour_signature) USING (linker) GROUP BY 1, 2, 3""")
def fragment_environments(spark, sf_dir):
    found = fragments.attributes(fragments.molecules(main_units(spark, sf_dir)), CORE, LADDERS, "raw")
    return found.groupBy("fragment_id", "environment", "neighbour_signature").agg(F.count(F.lit(1)).alias("n"))


@query(f"""{_UNITS} SELECT normalized AS smiles, 6 AS ring_size, 'carbocycle' AS ring_atom_class, 'none' AS hetero_atom_signature, 'fully_aromatic' AS ring_aromaticity_class, '1,4' AS exocyclic_substituent_topology, 1 AS attachment_count FROM u WHERE linker = 'c1ccc(cc1)'""")
def ring_attributes(spark, sf_dir):
    return fragments.ring_attributes(fragments.molecules(main_units(spark, sf_dir))).select("smiles", "ring_size", "ring_atom_class", "hetero_atom_signature", "ring_aromaticity_class", "exocyclic_substituent_topology", "attachment_count")


_BACK = "(n + CASE linker WHEN '' THEN 0 WHEN 'C(=O)O' THEN 2 WHEN 'C(=O)N' THEN 2 WHEN 'c1ccc(cc1)' THEN 4 ELSE 1 END)"


@query(f"""{_UNITS} SELECT normalized AS source_smiles, 2 * {_BACK} - 1 AS windows, CASE WHEN linker = '' THEN 1 WHEN linker IN ('C(=O)O', 'C(=O)N') THEN n + 2 ELSE (n + 2) // 2 END AS periods FROM u""")
def period_expansion(spark, sf_dir):
    rows = periods.candidates(periods.expanded(main_units(spark, sf_dir)))
    return rows.groupBy("source_smiles").agg(F.first("sliding_positions_total").alias("windows"), F.count(F.lit(1)).alias("periods"))


@query(f"""{_UNITS}, k AS (SELECT DISTINCT linker, n FROM u) SELECT sum(CASE WHEN linker = '' THEN 1 WHEN linker IN ('C(=O)O', 'C(=O)N') THEN n + 2 ELSE (n + 2) // 2 END) AS kept FROM k""")
def period_dedup(spark, sf_dir):
    rows = periods.candidates(periods.expanded(main_units(spark, sf_dir)))
    return periods.deduplicated(rows).agg(F.count(F.lit(1)).alias("kept"))


@query()
def fragment_audit(spark, sf_dir):
    units = main_units(spark, sf_dir)
    kept = periods.deduplicated(periods.candidates(periods.expanded(units)))
    return fragments.audit(fragments.levels(fragments.molecules(units), CORE), fragments.levels(fragments.molecules(kept), CORE), kept, spark, CORE)


@query(f"{_UNITS} SELECT 'six_rings' AS name, count(*) AS records, count(*) AS matches FROM u WHERE linker = 'c1ccc(cc1)' UNION ALL SELECT 'acids', count(*), count(*) FROM u WHERE linker IN ('C(=O)O', 'C(=O)N')")
def fragment_unions(spark, sf_dir):
    found = fragments.levels(fragments.molecules(main_units(spark, sf_dir)), CORE)
    return fragments.together(found, {"six_rings": ("fragment_019", "fragment_020"), "five_rings": ("fragment_017", "fragment_018"), "acids": ("fragment_001", "fragment_003")})


@query()
def seed_rule_coverage(spark, sf_dir):
    found = fragments.levels(fragments.molecules(main_units(spark, sf_dir)), SEED)
    return fragments.statistics(found, spark, SEED).select("fragment_id", "category", F.col("raw_records").alias("records"), F.col("raw_matches").alias("matches"))


@query()
def graph_motifs(spark, sf_dir):
    units = main_units(spark, sf_dir)
    return graphs.mined(graphs.environments(units), units.count(), support=1)
