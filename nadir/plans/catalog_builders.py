"""Registered queries of tiers, inclusion rules, parsers, builders, audits and evaluation blocks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from nadir.functions import columns as C
from nadir.functions import parsers as A
from nadir.operators import builders as B
from nadir.operators import metrics as M
from nadir.operators import quality as Q
from nadir.operators import sampling as S
from nadir.operators import splits as X
from nadir.operators import tiers as K
from nadir.operators.ordering import settled

from .catalog import ANSWERS_SQL, CONSENSUS_SQL, PS_SQL, SUP_SQL, SYN_SQL, TIER_SQL, ZIP_SQL, T, answers, cut_sql, lines, linked_suppliers, md5_sql, pair_partitions, part_supplier, query, supplier_pairs, tier_column, zip_column

KEY = ["l_orderkey", "l_linenumber"]


def line_number():
    return F.col("l_linenumber")


def quantity():
    return F.col("l_quantity")


# --- tiers -------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p IS NOT NULL AND l_returnflag = 'A' THEN 'gold' WHEN p IS NOT NULL OR (u IS NOT NULL AND l_tax > 0.01) THEN 'silver' ELSE 'bronze' END AS tier
 FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_quantity END AS p, CASE WHEN l_linestatus = 'O' THEN 'nM' END AS u FROM lineitem)""")
def tier_bioassay(spark, d):
    tier = K.bioassay_tier(F.when(line_number() % 2 == 0, quantity()), F.col("l_returnflag") == "A", F.when(F.col("l_linestatus") == "O", "nM"), F.when(F.col("l_tax") > 0.01, F.col("l_tax")))
    return lines(spark, d).select(*KEY, tier.alias("tier"))


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'bronze' ELSE 'silver' END AS tier FROM orders")
def tier_comment(spark, d):
    return T(spark, d, "orders").select("o_orderkey", K.comment_tier(F.when(F.col("o_orderpriority") == "5-LOW", "activity_comment").otherwise("p_value")).alias("tier"))


METHOD_SQL = "CASE p_size % 4 WHEN 0 THEN 'MI:0019' WHEN 1 THEN 'MI:0018' WHEN 2 THEN 'MI:0676' END"


@query(f"SELECT p_partkey, CASE WHEN {METHOD_SQL} IN ('MI:0019', 'MI:0676') THEN 'gold' ELSE 'silver' END AS tier FROM part")
def tier_method(spark, d):
    m = F.when(F.col("p_size") % 4 == 0, "MI:0019").when(F.col("p_size") % 4 == 1, "MI:0018").when(F.col("p_size") % 4 == 2, "MI:0676")
    return T(spark, d, "part").select("p_partkey", K.method_tier(m).alias("tier"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_discount * 10 - 1 > -0.5 AND l_returnflag = 'N' THEN 'silver' ELSE 'bronze' END AS tier FROM lineitem WHERE l_discount * 10 - 1 > -0.8")
def tier_knockdown(spark, d):
    score = F.col("l_discount") * 10 - 1
    return lines(spark, d).where(K.effect_included(score)).select(*KEY, K.knockdown_tier(score, F.col("l_returnflag") == "N").alias("tier"))


REVIEW_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'Reviewed by expert panel ' WHEN '2-HIGH' THEN 'criteria provided, multiple submitters, no conflicts' WHEN '3-MEDIUM' THEN 'criteria provided, single submitter' END"


@query("""SELECT o_orderkey, tier, evidence, CASE tier WHEN 'gold' THEN 'review_status' WHEN 'silver' THEN 'submitter_concordance' ELSE 'single_submission' END AS method FROM (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'gold' WHEN '2-HIGH' THEN 'silver' ELSE 'bronze' END AS tier,
 CASE WHEN o_orderpriority = '1-URGENT' THEN 'expert_reviewed' WHEN o_orderpriority = '2-HIGH' OR o_custkey % 5 >= 3 THEN 'multi_submitter_concordant' ELSE 'single_submitter' END AS evidence FROM orders)""")
def tier_review(spark, d):
    p = F.col("o_orderpriority")
    status = F.when(p == "1-URGENT", "Reviewed by expert panel ").when(p == "2-HIGH", "criteria provided, multiple submitters, no conflicts").when(p == "3-MEDIUM", "criteria provided, single submitter")
    out = T(spark, d, "orders").select("o_orderkey", K.review_tier(status).alias("tier"), K.review_evidence(status, F.col("o_custkey") % 5).alias("evidence"))
    return out.withColumn("method", K.review_method(F.col("tier")))


PHASE_SQL = "CASE o_orderpriority WHEN '1-URGENT' THEN 'phase_4' WHEN '2-HIGH' THEN 'phase_3' WHEN '3-MEDIUM' THEN 'phase_2' WHEN '5-LOW' THEN 'phase_1' END"


def phase_column():
    p = F.col("o_orderpriority")
    return F.when(p == "1-URGENT", "phase_4").when(p == "2-HIGH", "phase_3").when(p == "3-MEDIUM", "phase_2").when(p == "5-LOW", "phase_1")


ENDPOINT_SQL = f"CASE WHEN {PHASE_SQL} IN ('phase_3', 'phase_4') AND o_orderstatus = 'F' THEN 'gold' WHEN {PHASE_SQL} IN ('phase_2', 'phase_2_3', 'phase_3') THEN 'silver' ELSE 'bronze' END"


@query(f"""SELECT DISTINCT o_orderkey, l_partkey, l_suppkey, {ENDPOINT_SQL} AS tier FROM orders JOIN (SELECT l_orderkey, l_partkey FROM lineitem) a ON a.l_orderkey = o_orderkey JOIN (SELECT l_orderkey, l_suppkey FROM lineitem) b ON b.l_orderkey = o_orderkey
 WHERE (o_custkey % 150) / 100.0 BETWEEN 0 AND 1 AND (o_custkey % 150) / 100.0 > 0.05""")
def tier_endpoint_per_trial_cross(spark, d):
    """Trials with a missed endpoint, crossed with their interventions and conditions."""
    p = (F.col("o_custkey") % 150) / 100.0
    trials = T(spark, d, "orders").where(K.missed_endpoint(p)).select("o_orderkey", K.endpoint_tier(phase_column(), F.col("o_orderstatus") == "F").alias("tier"))
    arms, conditions = lines(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey").distinct(), lines(spark, d).select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey").distinct()
    return trials.join(arms, "o_orderkey").join(conditions, "o_orderkey").select("o_orderkey", "l_partkey", "l_suppkey", "tier")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' AND l_linenumber >= 3 THEN 'bronze' ELSE 'copper' END AS tier, CASE WHEN l_linestatus = 'O' AND l_linenumber >= 3 THEN 'dose_response_matrix' ELSE 'single_concentration' END AS evidence FROM lineitem")
def tier_dose_matrix(spark, d):
    return lines(spark, d).select(*KEY, K.dose_matrix_tier(line_number(), F.col("l_linestatus") == "O").alias("t")).select(*KEY, "t.tier", "t.evidence")


@query("""WITH a AS (SELECT o_orderkey, 'terminated' AS stage FROM orders WHERE o_orderstatus = 'P'), b AS (SELECT o_orderkey, 'endpoint' AS stage FROM orders WHERE o_custkey % 150 > 5 AND o_custkey % 150 <= 100 AND o_orderpriority = '2-HIGH' AND o_orderkey NOT IN (SELECT o_orderkey FROM a)),
 c AS (SELECT o_orderkey, 'label' AS stage FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM a) AND o_orderkey NOT IN (SELECT o_orderkey FROM b)) SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c""")
def staged_classification(spark, d):
    o = T(spark, d, "orders")
    stages = [("terminated", o.where("o_orderstatus = 'P'")), ("endpoint", o.where(K.missed_endpoint((F.col("o_custkey") % 150) / 100.0) & (F.col("o_orderpriority") == "2-HIGH"))), ("label", o.where("o_orderkey % 3 = 0"))]
    return K.staged_classification([(k, f.select("o_orderkey")) for k, f in stages], ["o_orderkey"])


# --- inclusion ---------------------------------------------------------------


@query("SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def in_configured_list(spark, d):
    return T(spark, d, "orders").where(K.in_list(F.col("o_orderpriority"), ["1-URGENT", "5-LOW"])).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount * 10 - 1.2 > -0.8 OR coalesce(CASE WHEN l_linenumber <> 3 THEN l_tax * 10 END < 0.5, false)")
def effect_threshold(spark, d):
    return lines(spark, d).where(K.effect_included(F.col("l_discount") * 10 - 1.2, F.when(line_number() != 3, F.col("l_tax") * 10))).select(*KEY)


@query("SELECT l_orderkey, l_linenumber FROM lineitem e WHERE l_tax > 0.01 AND NOT EXISTS (SELECT 1 FROM lineitem k WHERE k.l_returnflag = 'R' AND k.l_partkey = e.l_partkey AND k.l_suppkey = e.l_suppkey)")
def common_and_new_sites(spark, d):
    rows = lines(spark, d)
    return K.common_and_new(rows, "l_tax", rows.where("l_returnflag = 'R'"), ["l_partkey", "l_suppkey"]).select(*KEY)


def clinvar_like(spark, d):
    k = F.col("p_partkey")
    pick = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    return T(spark, d, "part").select("p_partkey", pick("GRCh38", "GRCh38", "GRCh37").alias("Assembly"), pick("Deletion", "Indel", "Translocation", "Insertion").alias("Type"), k.cast("string").alias("VariationID"), F.lit("7").alias("Chromosome"), pick("A", "na", "-", "C", "T").alias("ReferenceAlleleVCF"), F.lit("G").alias("AlternateAlleleVCF"), k.cast("string").alias("PositionVCF"), pick("T", "na", "TT").alias("ReferenceAllele"), pick("G", "GG").alias("AlternateAllele"), pick("17", "x", "99").alias("Start"))


@query("""WITH v AS (SELECT p_partkey AS k, CASE p_partkey % 3 WHEN 2 THEN 'GRCh37' ELSE 'GRCh38' END AS a, p_partkey % 4 AS t, CASE p_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'na' WHEN 2 THEN '-' WHEN 3 THEN 'C' ELSE 'T' END AS rv, CASE p_partkey % 3 WHEN 0 THEN 'T' WHEN 1 THEN 'na' ELSE 'TT' END AS r, CASE p_partkey % 2 WHEN 0 THEN 'G' ELSE 'GG' END AS al, CASE p_partkey % 3 WHEN 0 THEN '17' WHEN 1 THEN 'x' ELSE '99' END AS s FROM part),
 l AS (SELECT k, CASE WHEN rv IN ('na', '-') THEN r ELSE rv END AS ref, CASE WHEN rv IN ('na', '-') THEN al ELSE 'G' END AS alt, CASE WHEN rv IN ('na', '-') THEN TRY_CAST(s AS BIGINT) ELSE k END AS position FROM v WHERE a = 'GRCh38' AND t <> 2) SELECT k AS p_partkey, ref, alt, position FROM l WHERE ref <> 'na' AND position IS NOT NULL""")
def sane_alleles(spark, d):
    return K.sane_alleles(clinvar_like(spark, d)).select("p_partkey", "ref", "alt", "position")


@query("SELECT o_orderkey FROM orders WHERE (o_custkey % 150) / 100.0 <= 1 AND (o_custkey % 150) / 100.0 > 0.05")
def missed_endpoints(spark, d):
    return T(spark, d, "orders").where(K.missed_endpoint((F.col("o_custkey") % 150) / 100.0)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'O') AND lower(CASE WHEN o_custkey % 4 = 0 THEN 'Placebo arm' ELSE 'drug ' || o_custkey END) NOT LIKE '%placebo%'")
def drug_filter(spark, d):
    name = F.when(F.col("o_custkey") % 4 == 0, "Placebo arm").otherwise(F.concat(F.lit("drug "), F.col("o_custkey").cast("string")))
    return T(spark, d, "orders").where(K.is_drug(F.col("o_orderstatus"), name, ("F", "O"))).select("o_orderkey")


@query(f"SELECT l_orderkey, l_linenumber, p_brand, s_name, o_orderdate FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON l_orderkey = o_orderkey WHERE {TIER_SQL} IN ('gold', 'silver') AND p_size <= 25")
def candidate_pool(spark, d):
    part, supplier = T(spark, d, "part").withColumnRenamed("p_partkey", "l_partkey"), T(spark, d, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    done = T(spark, d, "orders").where("o_orderstatus = 'F'").withColumnRenamed("o_orderkey", "l_orderkey")
    pool = B.candidate_pool(lines(spark, d), [(part, "l_partkey", "inner"), (supplier, "l_suppkey", "inner"), (done, "l_orderkey", "left")], [tier_column().isin("gold", "silver")], [None, F.col("p_size") <= 25])
    return pool.select(*KEY, "p_brand", "s_name", "o_orderdate")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus IN ('F') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def filtered_results(spark, d):
    return Q.filtered_results(T(spark, d, "orders"), o_orderstatus=["F"], o_orderpriority=["1-URGENT", "2-HIGH"], o_custkey=None).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '1995-01-01 00:00:00')")
def fresh_runs(spark, d):
    return Q.fresh_runs(T(spark, d, "orders"), F.col("o_orderstatus") == "F", "o_orderdate", F.lit("1995-01-01").cast("timestamp")).select("o_orderkey")


# --- parsers -----------------------------------------------------------------

RAW_SQL = "CASE p_partkey % 5 WHEN 0 THEN 'sp|P' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '|NAME' WHEN 1 THEN ' Q' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '; P12345' WHEN 2 THEN 'P' || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '-2' WHEN 3 THEN 'none' ELSE 'x|y z' END"


@query(f"""WITH r AS (SELECT p_partkey, {RAW_SQL} AS raw FROM part), t AS (SELECT *, CASE WHEN lower(trim(raw)) NOT IN ('', 'none', 'nan', 'null') THEN regexp_extract(trim(regexp_replace(CASE WHEN contains(raw, '|') THEN CASE WHEN lower(trim(split_part(raw, '|', 1))) IN ('sp', 'tr', 'uniprotkb') THEN trim(split_part(raw, '|', 2)) ELSE trim(split_part(raw, '|', 1)) END ELSE trim(raw) END, '[;,/].*', '')), '^(\\S*)', 1) END AS token FROM r)
 SELECT p_partkey, token, CASE WHEN regexp_full_match(split_part(token, '-', 1), '[OPQ][0-9][A-Z0-9]{{3}}[0-9]|[A-NR-Z][0-9]([A-Z][A-Z0-9]{{2}}[0-9]){{1,2}}') THEN split_part(token, '-', 1) END AS accession FROM t""")
def accessions(spark, d):
    k = F.col("p_partkey")
    five = F.lpad(k.cast("string"), 5, "0")
    raw = F.when(k % 5 == 0, F.concat(F.lit("sp|P"), five, F.lit("|NAME"))).when(k % 5 == 1, F.concat(F.lit(" Q"), five, F.lit("; P12345"))).when(k % 5 == 2, F.concat(F.lit("P"), five, F.lit("-2"))).when(k % 5 == 3, "none").otherwise("x|y z")
    token = A.accession_token(raw)
    return T(spark, d, "part").select("p_partkey", token.alias("token"), A.uniprot_accession(token).alias("accession"))


@query("""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(raw, '\\s*[\\(\\[]\\s*\\d+\\s*(?:mg|ug|µg|ml|g|mcg|iu|%)\\b[^\\)\\]]*[\\)\\]]', '', 'gi'), '\\s*\\(.*\\)\\s*$', ''), '\\s+(?:hydrochloride|hcl|sodium|potassium|acetate|sulfate)\\s*$', '', 'i'))) AS cleaned
 FROM (SELECT p_partkey, 'Drug' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN ' Hydrochloride (10 mg tablet)' WHEN 1 THEN ' sodium' WHEN 2 THEN ' [5 ML vial] acetate (oral)' ELSE '' END AS raw FROM part)""")
def drug_name_cleaning(spark, d):
    k = F.col("p_partkey")
    tail = F.when(k % 4 == 0, " Hydrochloride (10 mg tablet)").when(k % 4 == 1, " sodium").when(k % 4 == 2, " [5 ML vial] acetate (oral)").otherwise("")
    return T(spark, d, "part").select("p_partkey", A.clean_drug_name(F.concat(F.lit("Drug"), k.cast("string"), tail)).alias("cleaned"))


@query("""SELECT p_partkey, 'ABL' || p_partkey AS gene, CASE WHEN p_partkey % 3 = 0 THEN 'E' || p_partkey || 'K' END AS mutation FROM part""")
def gene_mutation(spark, d):
    k = F.col("p_partkey").cast("string")
    name = F.concat(F.lit("ABL"), k, F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("(E"), k, F.lit("K)-phosphorylated"))).when(F.col("p_partkey") % 3 == 1, "(JH1domain-catalytic)").otherwise("-nonphosphorylated"))
    gene, mutation = A.gene_and_mutation(name)
    return T(spark, d, "part").select("p_partkey", gene.alias("gene"), mutation.alias("mutation"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 <> 3 THEN 'NM_0000' || p_partkey || '.4:c.51C>A' END AS coding, CASE WHEN p_partkey % 2 = 0 THEN 'p.Ala' || p_partkey || 'Asp' END AS protein, CASE WHEN p_partkey % 2 = 0 THEN 'missense' WHEN p_partkey % 4 = 3 THEN 'frameshift' ELSE 'other' END AS consequence,
 CASE WHEN p_partkey % 3 = 0 THEN 'BA1,PM2' WHEN p_partkey % 3 = 1 THEN 'PVS1' ELSE '' END AS acmg, CASE WHEN p_partkey % 2 = 0 THEN 'C' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') ELSE '' END AS cuis, CASE p_partkey % 3 WHEN 0 THEN 'likely_benign' WHEN 1 THEN 'pathogenic' END AS significance FROM part""")
def variant_names(spark, d):
    n = F.col("p_partkey")
    k = n.cast("string")
    name = F.when(n % 4 == 3, "a frameshift variant").otherwise(F.concat(F.lit("NM_0000"), k, F.lit(".4(BRCA2):c.51C>A"), F.when(n % 2 == 0, F.concat(F.lit(" (p.Ala"), k, F.lit("Asp)"))).otherwise("")))
    coding, protein = A.hgvs(name)
    text = F.when(n % 3 == 0, "meets PM2, BA1 and PM2").when(n % 3 == 1, "PVS1 (not BS9)")
    cui = F.when(n % 2 == 0, F.concat(F.lit("C"), F.lpad(k, 7, "0"), F.lit(":disease"))).otherwise("none")
    raw = F.when(n % 3 == 0, " Likely benign").when(n % 3 == 1, "Pathogenic").otherwise("risk factor")
    return T(spark, d, "part").select("p_partkey", coding.alias("coding"), protein.alias("protein"), A.consequence(name).alias("consequence"), F.array_join(A.codes_in(text), ",").alias("acmg"), F.array_join(A.codes_in(cui, A.MEDGEN_CUI), ",").alias("cuis"), A.classification(raw).alias("significance"))


@query("""SELECT p_partkey, 'C' || p_partkey AS medgen_cui, CAST(p_partkey + 1 AS VARCHAR) AS omim_id, 'first' AS name FROM part WHERE p_partkey % 3 <> 2 UNION ALL SELECT p_partkey, NULL, '7', CASE WHEN p_partkey % 3 = 0 THEN 'second' END FROM part WHERE p_partkey % 3 <> 2""")
def phenotype_records(spark, d):
    n = F.col("p_partkey")
    k = n.cast("string")
    ids = F.when(n % 3 == 2, "na").otherwise(F.concat(F.lit("MedGen:C"), k, F.lit(",OMIM:"), (n + 1).cast("string"), F.lit("|Orphanet:5|OMIM:7")))
    found = F.explode(A.phenotypes(ids, F.when(n % 3 == 0, "first| second ").otherwise("first")))
    return T(spark, d, "part").select("p_partkey", found.alias("p")).select("p_partkey", "p.medgen_cui", "p.omim_id", "p.name")


@query("SELECT doc_id, CASE WHEN length(text) <= 100 THEN text ELSE regexp_replace(substr(text, 1, 100), ' [^ ]*\\z', '') || ' [...]' END AS short FROM documents")
def word_truncation(spark, d):
    return T(spark, d, "documents").select("doc_id", A.truncate_words(F.col("text"), 100).alias("short"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'missense_variant' ELSE 'synonymous_variant' END AS consequence, CASE WHEN p_partkey % 2 = 0 THEN 'GENE' || p_partkey END AS symbol FROM part""")
def annotation_split(spark, d):
    k = F.col("p_partkey").cast("string")
    csq = F.concat(F.lit("A|missense_variant|GENE"), k, F.lit(",G|synonymous_variant|"))
    got = A.annotation(csq, ["Allele", "Consequence", "SYMBOL"], F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("G"))
    return T(spark, d, "part").select("p_partkey", got.alias("m")).select("p_partkey", F.col("m")["Consequence"].alias("consequence"), F.col("m")["SYMBOL"].alias("symbol"))


_UP = "upper(p_type)"
_TOTAL = f"length(regexp_replace({_UP}, '[^ACDEFGHIKLMNPQRSTVWY]', '', 'g'))"


@query(f"SELECT p_partkey, round(CASE WHEN {_TOTAL} > 0 THEN length(regexp_replace({_UP}, '[^A]', '', 'g')) / {_TOTAL} ELSE 0.0 END, 6) AS a, round(CASE WHEN {_TOTAL} > 0 THEN length(regexp_replace({_UP}, '[^S]', '', 'g')) / {_TOTAL} ELSE 0.0 END, 6) AS s FROM part")
def amino_acid_shares(spark, d):
    c = A.amino_acid_composition(F.upper("p_type"))
    return T(spark, d, "part").select("p_partkey", F.round(c[0], 6).alias("a"), F.round(c[15], 6).alias("s"))


_HYDRO = "CASE {c} " + " ".join(f"WHEN '{a}' THEN {v}" for a, v in A.HYDROPATHY.items()) + " END"
_REF, _ALT = "substr('ACDEFGHIKLMNPQRSTVWYX', CAST(p_partkey % 21 + 1 AS INTEGER), 1)", "substr('ACDEFGHIKLMNPQRSTVWY', CAST(p_size % 20 + 1 AS INTEGER), 1)"


@query(f"SELECT p_partkey, round({_HYDRO.format(c=_ALT)} - {_HYDRO.format(c=_REF)}, 6) AS hydropathy, CASE WHEN {_REF} = {_ALT} THEN 4.0 WHEN {_REF} || {_ALT} IN ('AC', 'CA') THEN 0.0 END AS matrix FROM part")
def substitution_features(spark, d):
    ref, alt = F.expr(_REF), F.expr(_ALT)
    matrix = {(a, a): 4.0 for a in A.AMINO_ACIDS} | {("A", "C"): 0.0}
    return T(spark, d, "part").select("p_partkey", F.round(A.hydropathy_change(ref, alt), 6).alias("hydropathy"), A.substitution(ref, alt, matrix).alias("matrix"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS s_F, CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS s_O FROM orders")
def dummy_columns(spark, d):
    return T(spark, d, "orders").select("o_orderkey", *A.dummies(F.col("o_orderstatus"), ["F", "O"], "s"))


@query("""SELECT l_orderkey, l_linenumber, 'Compound ' || l_partkey || ' against ' || CASE WHEN l_linenumber = 3 THEN 'unknown' ELSE CAST(l_suppkey AS VARCHAR) END || '?' AS question, 'tier: ' || l_returnflag || CASE WHEN l_linenumber <> 2 THEN chr(10) || 'status: ' || l_linestatus ELSE '' END AS context FROM lineitem""")
def rendered_context(spark, d):
    q = A.template("Compound {part} against {supplier}?", part=F.col("l_partkey"), supplier=F.when(line_number() != 3, F.col("l_suppkey")))
    return lines(spark, d).select(*KEY, q.alias("question"), A.lines_of(("tier", F.col("l_returnflag")), ("status", F.when(line_number() != 2, F.col("l_linestatus")))).alias("context"))


@query("SELECT o_orderkey, o_custkey AS ac, '0.' || (o_orderkey % 10) AS af, o_orderkey % 2 = 0 AS db FROM orders")
def vcf_info_map(spark, d):
    """INFO fields: a number, the second of a Number=A list, and a flag."""
    k = F.col("o_orderkey")
    info = F.concat(F.lit("AF=0.5,0."), (k % 10).cast("string"), F.when(k % 2 == 0, ";DB").otherwise(""), F.lit(";AC="), F.col("o_custkey").cast("string"))
    m = C.info_map(info)
    return T(spark, d, "orders").select("o_orderkey", m["AC"].cast("long").alias("ac"), F.split(m["AF"], ",")[1].alias("af"), F.map_contains_key(m, "DB").alias("db"))


# --- joins, aggregates, orders -----------------------------------------------


@query("""WITH r AS (SELECT n_nationkey AS k, CASE n_nationkey % 4 WHEN 0 THEN lower(n_name) WHEN 1 THEN lower(n_name) WHEN 2 THEN lower(substr(n_name, 1, length(n_name) - 1)) ELSE 'zz' || n_nationkey END AS c FROM nation), f AS (SELECT c, v.n_nationkey + 200 AS id, row_number() OVER (PARTITION BY c ORDER BY jaro_winkler_similarity(c, lower(v.n_name)) DESC, lower(v.n_name)) AS r FROM (SELECT DISTINCT c FROM r) JOIN nation v ON abs(length(c) - length(v.n_name)) <= 5 WHERE jaro_winkler_similarity(c, lower(v.n_name)) >= 0.9)
 SELECT k, coalesce(e.n_nationkey, h.n_nationkey + 100, f.id, CASE WHEN k % 8 = 3 THEN k + 300 END) AS resolved, CASE WHEN e.n_nationkey IS NOT NULL THEN 'exact' WHEN h.n_nationkey IS NOT NULL THEN 'cache' WHEN f.id IS NOT NULL THEN 'fuzzy' WHEN k % 8 = 3 THEN 'override' END AS stage FROM r LEFT JOIN nation e ON lower(e.n_name) = c AND e.n_nationkey < 8 LEFT JOIN nation h ON lower(h.n_name) = c AND h.n_nationkey < 16 LEFT JOIN f ON f.c = r.c AND f.r = 1""")
def name_resolution_cascade(spark, d):
    """Cleaned names by synonyms, a cache, the nearest name, and overrides."""
    from nadir.operators import evidence as E

    n = T(spark, d, "nation").select("n_name", F.col("n_nationkey").cast("long").alias("k"))
    k, name = F.col("k"), F.lower("n_name")
    raw = F.when(k % 4 == 0, F.concat("n_name", F.lit(" Sodium (20 mg)"))).when(k % 4 == 1, F.col("n_name")).when(k % 4 == 2, F.expr("substr(n_name, 1, length(n_name) - 1)")).otherwise(F.concat(F.lit("zz"), k.cast("string")))
    table = lambda rows, plus: rows.select(name.alias("name"), (k + plus).alias("id"))
    overrides = n.where("k % 8 = 3").select(F.concat(F.lit("zz"), k.cast("string")).alias("name"), (k + 300).alias("id"))
    return E.resolve_names(n.select("k", raw.alias("raw")), "raw", table(n.where("k < 8"), 0), table(n.where("k < 16"), 100), table(n, 200), overrides).select("k", "resolved", "stage")


@query("SELECT o_orderkey, c_mktsegment, total FROM orders LEFT JOIN (SELECT c_custkey, min(c_mktsegment) AS c_mktsegment FROM customer WHERE c_acctbal > 0 GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey")
def control_set_merge(spark, d):
    from nadir.operators import evidence as E

    c = T(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    r = lines(spark, d).where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("total"))
    return E.with_controls(T(spark, d, "orders").select("o_orderkey", "o_custkey"), [(c, ["o_custkey"], ["c_mktsegment"]), (r, ["o_orderkey"], ["total"])]).select("o_orderkey", "c_mktsegment", "total")


@query("SELECT count(*) AS n, count(DISTINCT c_custkey) AS n_left FROM customer JOIN supplier ON upper(trim('E' || c_custkey)) = upper(trim('e' || s_suppkey))")
def cross_domain_symbol_join(spark, d):
    a = T(spark, d, "customer").select("c_custkey", F.concat(F.lit("E"), F.col("c_custkey").cast("string")).alias("symbol"))
    b = T(spark, d, "supplier").select(F.concat(F.lit("e"), F.col("s_suppkey").cast("string")).alias("symbol"))
    return a.join(b, F.upper(F.trim(a.symbol)) == F.upper(F.trim(b.symbol))).agg(F.count("*").alias("n"), F.countDistinct("c_custkey").alias("n_left"))


@query("SELECT count(*) AS n_left, (SELECT count(*) FROM supplier) AS n_right, count(s_suppkey) AS n_both, round(100.0 * count(s_suppkey) / greatest(count(*), 1), 6) AS percent FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey")
def domain_overlap(spark, d):
    return Q.domain_overlap(T(spark, d, "customer").select(F.col("c_custkey").alias("k")), T(spark, d, "supplier").select(F.col("s_suppkey").alias("k")), "k").withColumn("percent", F.round("percent", 6))


@query(f"WITH {ANSWERS_SQL}, g AS (SELECT DISTINCT item, min(gold) OVER (PARTITION BY item) AS gold FROM an WHERE item % 3 <> 0), p AS (SELECT model, item, event_type, pred FROM an) SELECT model, count(*) AS n, count_if(pred = gold) AS n_right FROM p JOIN g ON p.item = g.item GROUP BY 1")
def predictions_with_gold(spark, d):
    """Predictions meet the gold answers of a second frame; items without gold are left out."""
    a = answers(spark, d)
    gold = a.where("item % 3 <> 0").groupBy("item").agg(F.min("gold").alias("gold"))
    return a.select("model", "item", "pred").join(gold, "item").groupBy("model").agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col("pred") == F.col("gold"), F.lit(False))).alias("n_right"))


@query(f"WITH {ANSWERS_SQL}, a AS (SELECT item, avg(value) AS x FROM an WHERE model = 0 GROUP BY 1), b AS (SELECT item, avg(value) AS y FROM an WHERE model = 1 GROUP BY 1) SELECT count(*) AS n, round(avg(abs(x - y)), 6) AS mad, round(corr(x, y), 6) AS pearson FROM a JOIN b ON a.item = b.item")
def paired_scores(spark, d):
    """Two raters' scores of the same items."""
    side = lambda m, c: answers(spark, d).where(F.col("model") == m).groupBy("item").agg(F.avg("value").alias(c))
    return M.quadratic_kappa(side(0, "x").join(side(1, "y"), "item"), "x", "y").select("n", F.round("mad", 6).alias("mad"), F.round("pearson", 6).alias("pearson"))


@query("SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS total FROM lineitem GROUP BY 1 HAVING sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) > 0")
def positive_sums(spark, d):
    return lines(spark, d).groupBy("l_orderkey").agg(F.sum(F.when(F.col("l_returnflag") == "R", quantity()).otherwise(0)).alias("total")).where("total > 0")


@query("SELECT l_suppkey, count(*) AS n, round(avg(CASE l_linenumber WHEN 1 THEN 3.0 WHEN 2 THEN 5.0 WHEN 3 THEN 5.0 WHEN 4 THEN 4.0 WHEN 5 THEN 1.0 ELSE 2.0 END), 6) AS severity FROM lineitem GROUP BY 1")
def mean_severity(spark, d):
    kind = F.when(line_number() == 1, "missense").when(line_number() == 2, "nonsense").when(line_number() == 3, "frameshift").when(line_number() == 4, "splice").when(line_number() == 5, "synonymous").otherwise("x")
    return lines(spark, d).groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(K.mean_severity(kind), 6).alias("severity"))


@query(f"""WITH {SUP_SQL}, e AS (SELECT s1, s2, l_orderkey, round((q - 25) / 2, 6) AS z FROM sp), k AS (SELECT *, {SYN_SQL.format(z='z')} AS k FROM e), g AS (SELECT DISTINCT l_suppkey AS e, l_partkey % 50 AS t FROM lineitem), gn AS (SELECT e, count(*) AS n FROM g GROUP BY 1),
 p AS (SELECT s1, s2, count(DISTINCT l_orderkey) AS num_cells, count(*) AS num_measurements, round(avg(z), 6) AS avg_zip, round(avg(CASE WHEN k IN ('antagonistic', 'strongly_antagonistic') THEN 1.0 ELSE 0.0 END), 6) AS antagonism_fraction, {CONSENSUS_SQL} AS consensus_class FROM k GROUP BY 1, 2),
 sh AS (SELECT s1, s2, count(*) AS shared FROM p JOIN g x ON s1 = x.e JOIN g y ON s2 = y.e AND x.t = y.t GROUP BY 1, 2), dg AS (SELECT e, count(*) AS deg FROM (SELECT s1 AS e FROM p UNION ALL SELECT s2 FROM p) GROUP BY 1)
 SELECT p.*, coalesce(shared, 0) AS shared, round(coalesce(shared, 0) / nullif(coalesce(a.n, 0) + coalesce(b.n, 0) - coalesce(shared, 0), 0), 6) AS jaccard, da.deg AS a_degree, db.deg AS b_degree FROM p LEFT JOIN sh ON sh.s1 = p.s1 AND sh.s2 = p.s2 LEFT JOIN gn a ON a.e = p.s1 LEFT JOIN gn b ON b.e = p.s2 JOIN dg da ON da.e = p.s1 JOIN dg db ON db.e = p.s2""")
def pair_rollup_combination(spark, d):
    """The whole table of symmetric combinations: measurements, consensus, shared targets and degrees."""
    from nadir.operators import pairs as P

    k = F.col("k")
    rows = supplier_pairs(spark, d).withColumn("z", F.round((F.col("q") - 25) / 2, 6)).withColumn("k", C.synergy_class(F.col("z")))
    spec = P.PairSpec("s1", "s2", {"num_cells": F.countDistinct("l_orderkey"), "num_measurements": F.count("*"), "avg_zip": F.round(F.avg("z"), 6), "antagonism_fraction": F.round(C.fraction(k.isin("antagonistic", "strongly_antagonistic")), 6), "consensus_class": C.consensus_class(k)}, symmetric=True)
    items = lines(spark, d).select(F.col("l_suppkey").alias("e"), (F.col("l_partkey") % 50).alias("g"))
    return P.partner_jaccard(P.rollup(rows, spec, pair_partitions(spark, d)), items, "s1", "s2", "e", "g").withColumn("jaccard", F.round("jaccard", 6))


@query(f"{PS_SQL} SELECT l_partkey FROM (SELECT l_partkey, max(a_degree) AS d FROM ps GROUP BY 1) ORDER BY d DESC, l_partkey LIMIT 50")
def top_by_degree(spark, d):
    return B.well_known(part_supplier(spark, d), "l_partkey", "a_degree", 50)


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders ORDER BY CASE o_orderpriority WHEN '2-HIGH' THEN 1 WHEN '1-URGENT' THEN 2 ELSE 3 END, o_totalprice DESC, o_orderkey LIMIT 40")
def categorical_order(spark, d):
    rank = F.coalesce(C.rank_of(F.col("o_orderpriority"), ("2-HIGH", "1-URGENT")), F.lit(3))
    return T(spark, d, "orders").orderBy(rank, F.desc("o_totalprice"), "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority", "o_totalprice")


# --- labels and builders -----------------------------------------------------


@query(f"""WITH k AS (SELECT l_partkey, l_suppkey, {CONSENSUS_SQL} AS c FROM (SELECT *, {SYN_SQL.format(z=ZIP_SQL)} AS k FROM lineitem) GROUP BY 1, 2)
 SELECT l_partkey, l_suppkey, CASE c WHEN 'synergistic' THEN 1 ELSE 0 END AS two, CASE c WHEN 'antagonistic' THEN 0 WHEN 'additive' THEN 1 WHEN 'synergistic' THEN 2 END AS three FROM k""")
def consensus_labels(spark, d):
    rows = lines(spark, d).withColumn("k", C.synergy_class(zip_column())).groupBy("l_partkey", "l_suppkey").agg(C.consensus_class(F.col("k")).alias("c"))
    return rows.select("l_partkey", "l_suppkey", K.mapped(F.col("c"), K.BINARY_CONSENSUS).alias("two"), K.mapped(F.col("c"), K.THREE_CONSENSUS).alias("three"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 20 AND (l_linenumber = 2 OR l_discount * 10 > 0.5) THEN 'A' WHEN l_quantity BETWEEN 10 AND 20 THEN 'C' END AS class FROM lineitem WHERE (l_quantity > 20 AND (l_linenumber = 2 OR l_discount * 10 > 0.5)) OR l_quantity BETWEEN 10 AND 20")
def score_window_class(spark, d):
    k = K.pathogenicity_class(quantity(), F.when(line_number() != 2, F.col("l_discount") * 10))
    return lines(spark, d).select(*KEY, k.alias("class")).where("class is not null")


@query(f"""WITH z AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN {ZIP_SQL} > 10 THEN 'A' WHEN {ZIP_SQL} >= -5 THEN 'B' WHEN {ZIP_SQL} >= -10 THEN 'C' ELSE 'D' END AS band FROM lineitem), s AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {md5_sql(42, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS r FROM z), c AS (SELECT * FROM s WHERE r <= 300)
 , m AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {md5_sql(42, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS q FROM c), f AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY {md5_sql(42, 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS p FROM m WHERE q <= 15) SELECT l_orderkey, l_linenumber, band, CASE WHEN p <= 20 THEN 'fewshot' WHEN p <= 40 THEN 'val' ELSE 'test' END AS fold FROM f WHERE p <= 240""")
def banded_items(spark, d):
    """Classes by bands of a score, a number of each, capped for each entity, then folds within classes."""
    rows = lines(spark, d).select(*KEY, "l_suppkey", K.zip_band(zip_column()).alias("band"))
    sampled = B.class_sample(rows, "band", 300, KEY)
    return X.few_shot(S.capped(sampled, "l_suppkey", KEY, 15), KEY, 20, 20, 200, ["band"]).select(*KEY, "band", "fold")


_DIFF = "CASE WHEN l_quantity > 40 THEN 'easy' WHEN l_quantity > 20 THEN 'medium' ELSE 'hard' END"
_H = md5_sql(42, "l_orderkey", "l_linenumber")


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, {_DIFF} AS difficulty FROM lineitem), o AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY CASE difficulty WHEN 'easy' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, {_H}, l_orderkey, l_linenumber) AS o FROM a), b AS (SELECT * FROM o WHERE o = 1),
 c AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY difficulty, l_suppkey ORDER BY {_H}, l_orderkey, l_linenumber) > 1 THEN 1 ELSE 0 END AS again FROM b), r AS (SELECT *, row_number() OVER (PARTITION BY difficulty ORDER BY again, {_H}, l_orderkey, l_linenumber) AS r FROM c)
 SELECT l_orderkey, l_linenumber, difficulty FROM r WHERE r <= CASE difficulty WHEN 'easy' THEN 40 WHEN 'medium' THEN 30 ELSE 20 END""")
def difficulty_selection(spark, d):
    level = F.when(quantity() > 40, "easy").when(quantity() > 20, "medium").otherwise("hard")
    return B.by_difficulty(lines(spark, d), level, {"easy": 40, "medium": 30, "hard": 20}, KEY, "l_suppkey", "l_partkey").select(*KEY, "difficulty")


@query(f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN year(l_shipdate) < 1995 THEN 'early' WHEN year(l_shipdate) >= 1996 THEN 'late' END AS period, CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS p FROM lineitem), c AS (SELECT *, 2 * CASE WHEN row_number() OVER (PARTITION BY period, l_suppkey ORDER BY {_H}, l_orderkey, l_linenumber) > 1 THEN 1 ELSE 0 END + p AS c FROM a WHERE period IS NOT NULL),
 r AS (SELECT *, row_number() OVER (PARTITION BY period ORDER BY c, {_H}, l_orderkey, l_linenumber) AS r FROM c) SELECT l_orderkey, l_linenumber, period, 'tested' AS answer FROM r WHERE r <= CASE period WHEN 'early' THEN 60 ELSE 40 END""")
def tested_items(spark, d):
    rows = lines(spark, d).select(*KEY, "l_suppkey", "l_returnflag", F.year("l_shipdate").alias("y"))
    return B.tested_items(rows, "y", {"early": (None, 1995, 60), "late": (1996, None, 40)}, KEY, "l_suppkey", F.col("l_returnflag") == "R").select(*KEY, "period", "answer")


def untested_sql(a: str, b: str, known: str, n: int, seed: int, keys: tuple[str, str]) -> str:
    """The numbered walk over the product of two one-column tables, in SQL."""
    x, y = keys
    return f"""WITH RECURSIVE a AS (SELECT {x}, row_number() OVER (ORDER BY {md5_sql(seed, x)}, {x}) - 1 AS i FROM (SELECT DISTINCT {x} FROM {a})), b AS (SELECT {y}, row_number() OVER (ORDER BY {md5_sql(seed + 1, y)}, {y}) - 1 AS j FROM (SELECT DISTINCT {y} FROM {b})), kn AS (SELECT DISTINCT {x}, {y} FROM {known}),
 z AS (SELECT (SELECT count(*) FROM a) * (SELECT count(*) FROM b) AS room, (SELECT count(*) FROM b) AS nb, (SELECT count(*) FROM kn) AS k), st AS (SELECT z.*, (SELECT min(s) FROM (SELECT unnest(range(CAST(floor(room * 0.6180339887) AS BIGINT), room * 2 + 3)) AS s) WHERE s % 2 = 1 AND gcd(s, room) = 1) AS step, least(room, {2 * n} + k * {n} // greatest(1, room) + 16) AS w0 FROM z),
 w AS (SELECT w0 AS w FROM st UNION ALL SELECT least(room, w * 2) FROM w, st WHERE w < room), c AS (SELECT id, a.{x}, b.{y} FROM (SELECT id, ((id * step + {seed}) % room) // nb AS i, ((id * step + {seed}) % room) % nb AS j FROM (SELECT unnest(range(room)) AS id, step, room, nb FROM st)) p JOIN a ON a.i = p.i JOIN b ON b.j = p.j WHERE NOT EXISTS (SELECT 1 FROM kn WHERE kn.{x} = a.{x} AND kn.{y} = b.{y})),
 f AS (SELECT min(w) AS w FROM w, st WHERE w >= room OR (SELECT count(*) FROM c WHERE id < w) >= {n}) SELECT {x}, {y} FROM c, f WHERE id < w ORDER BY {md5_sql(seed, x, y)}, {x}, {y} LIMIT {n}"""


@query(untested_sql("(SELECT p_partkey AS l_partkey FROM part)", "(SELECT s_suppkey AS l_suppkey FROM supplier)", "lineitem", 500, 42, ("l_partkey", "l_suppkey")))
def uniform_negatives(spark, d):
    a, b = T(spark, d, "part").select(F.col("p_partkey").alias("l_partkey")), T(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"))
    return S.untested_pairs(a, b, lines(spark, d), 500)


def known_pairs(spark, d):
    """Distinct pairs, written, and those of them without a null end."""
    once = settled(lines(spark, d).select("l_partkey", "l_suppkey").repartition(pair_partitions(spark, d), "l_partkey", "l_suppkey").distinct())
    return once, once.where("l_partkey is not null and l_suppkey is not null")


_TOP = f"(WITH pp AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2) SELECT l_partkey FROM pp GROUP BY 1 ORDER BY count(*) DESC, l_partkey LIMIT 100)"
_TOPS = f"(WITH pp AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2) SELECT l_suppkey FROM pp GROUP BY 1 ORDER BY count(*) DESC, l_suppkey LIMIT 20)"


@query(untested_sql(_TOP, _TOPS, "lineitem", 40, 42, ("l_partkey", "l_suppkey")).replace("SELECT l_partkey, l_suppkey FROM c, f", "SELECT l_partkey, l_suppkey, 'trick' AS kind, 'untested' AS answer FROM c, f"))
def untested_trick_items(spark, d):
    """Untested pairs of two well-known ends (no end is little studied here, so ``obvious`` gives none)."""
    known, pairs = known_pairs(spark, d)
    return B.untested_items(pairs, "l_partkey", "l_suppkey", None, known, 40, 0, (100, 20), -1, known_once=True).select("l_partkey", "l_suppkey", "kind", "answer")


_LITTLE = "(WITH pp AS (SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2) SELECT l_partkey FROM pp GROUP BY 1 HAVING count(*) <= 22)"


@query(untested_sql(_TOPS, _LITTLE, "lineitem", 40, 43, ("l_suppkey", "l_partkey")).replace("SELECT l_suppkey, l_partkey FROM c, f", "SELECT l_suppkey, l_partkey, 'obvious' AS kind, 'untested' AS answer FROM c, f"))
def untested_obvious_items(spark, d):
    """Untested pairs of a well-known supplier and a part of few suppliers."""
    known, pairs = known_pairs(spark, d)
    out = B.untested_items(pairs, "l_suppkey", "l_partkey", None, known, 0, 40, (20, 1), 22, known_once=True)
    return out.select("l_suppkey", "l_partkey", "kind", "answer")


_LINKED = f"(WITH {SUP_SQL}, lk AS (SELECT DISTINCT s1, s2 FROM sp WHERE l_orderkey % 50 = 0) SELECT s1, s2 FROM lk UNION SELECT s2 AS s1, s1 AS s2 FROM lk UNION SELECT s_suppkey, s_suppkey FROM supplier)"
_DRAWN = untested_sql("(SELECT s_suppkey AS s1 FROM supplier)", "(SELECT s_suppkey AS s2 FROM supplier)", _LINKED, 124, 42, ("s1", "s2"))


@query(f"SELECT s1, s2 FROM (SELECT DISTINCT least(s1, s2) AS s1, greatest(s1, s2) AS s2 FROM ({_DRAWN})) ORDER BY {md5_sql(42, 's1', 's2')}, s1, s2 LIMIT 30")
def zero_evidence_pairs(spark, d):
    """Unlinked pairs of one kind of entity."""
    linked = supplier_pairs(spark, d).where("l_orderkey % 50 = 0").select("s1", "s2").distinct()
    return B.zero_evidence_pairs(T(spark, d, "supplier"), "s_suppkey", linked, ("s1", "s2"), 30)


@query("SELECT DISTINCT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45) OR s_suppkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45)")
def viable_entities(spark, d):
    return B.viable(T(spark, d, "supplier"), lines(spark, d).where("l_returnflag = 'A' and l_quantity > 45"), "s_suppkey", ("l_suppkey", "l_partkey"))


@query("""WITH dep AS (SELECT l_partkey, l_suppkey, max(l_discount) * 10 AS dependency FROM lineitem GROUP BY 1, 2), eff AS (SELECT l_partkey, l_suppkey, min(l_tax) AS effect FROM lineitem WHERE l_linenumber > 2 GROUP BY 1, 2)
 SELECT dep.l_partkey, dep.l_suppkey, dependency, effect, CASE WHEN dep.l_partkey % 10 = 0 THEN 'common_essential' ELSE 'selective_essential' END AS essentiality FROM dep LEFT JOIN eff ON dep.l_partkey = eff.l_partkey AND dep.l_suppkey = eff.l_suppkey WHERE dependency >= 0.5""")
def essential_positives(spark, d):
    pair = ["l_partkey", "l_suppkey"]
    dep = lines(spark, d).groupBy(*pair).agg((F.max("l_discount") * 10).alias("value"))
    effect = lines(spark, d).where("l_linenumber > 2").groupBy(*pair).agg(F.min("l_tax").alias("value"))
    return B.essential_positives(dep, effect, pair, lines(spark, d).where("l_partkey % 10 = 0"), "l_partkey").select(*pair, "dependency", "effect", "essentiality")


_HO = md5_sql(42, "o_orderkey")


@query(f"WITH m AS (SELECT o_orderkey, o_orderpriority = '1-URGENT' AS g, row_number() OVER (PARTITION BY o_orderpriority = '1-URGENT' ORDER BY {_HO}, o_orderkey) AS r FROM orders) SELECT o_orderkey FROM m WHERE NOT g OR r <= 100")
def share_cap(spark, d):
    return B.share_capped(T(spark, d, "orders"), F.col("o_orderpriority") == "1-URGENT", 100, ["o_orderkey"]).select("o_orderkey")


@query(f"""WITH k AS (SELECT count(*) FILTER (WHERE o_orderstatus = 'P') AS p, count(*) FILTER (WHERE o_orderstatus = 'F') AS f FROM orders), n AS (SELECT p, f, least(400, p + f) AS n FROM k), a AS (SELECT n, f, p, least(n // 2, p) AS np0 FROM n), b AS (SELECT *, least(n - np0, f) AS nf FROM a), c AS (SELECT least(n - nf, p) AS np, nf FROM b),
 r AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_HO}, o_orderkey) AS r FROM orders) SELECT o_orderkey, o_orderstatus FROM r, c WHERE (o_orderstatus = 'P' AND r <= np) OR (o_orderstatus = 'F' AND r <= nf)""")
def two_class_balance(spark, d):
    return B.two_class_balance(T(spark, d, "orders"), "o_orderstatus", "P", "F", 400, ["o_orderkey"]).select("o_orderkey", "o_orderstatus")


@query(f"""WITH r AS (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY {md5_sql(44, 'n_nationkey')}, n_nationkey) AS r, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), e AS (SELECT unnest([0, 1, 2]) AS j) SELECT n_nationkey, n_regionkey, CAST(j + 1 AS INTEGER) AS example FROM r, e WHERE r = (6 + j) % n + 1""")
def few_shot_examples(spark, d):
    return B.few_shot_examples(T(spark, d, "nation"), "n_regionkey", ["n_nationkey"], 2).select("n_nationkey", "n_regionkey", F.col("example").cast("int").alias("example"))


@query(f"""{PS_SQL}, t AS (SELECT * FROM ps WHERE l_partkey % 10 = 0), e AS (SELECT list_sort(list_distinct(quantile_cont(CAST(a_degree AS DOUBLE), [0.0, 0.2, 0.4, 0.6, 0.8, 1.0]))) AS q FROM t), b AS (SELECT l_partkey, l_suppkey, len(list_filter(list_slice(q, 2, -2), lambda x: x < a_degree)) AS bin FROM ps, e),
 k AS (SELECT bin, count(*) AS n FROM b WHERE l_partkey % 10 = 0 GROUP BY 1), w AS (SELECT bin, CAST(floor(200 * n / sum(n) OVER ()) AS BIGINT) AS q, row_number() OVER (ORDER BY n DESC, bin) AS r FROM k), z AS (SELECT bin, q + CASE WHEN r <= 200 - (SELECT sum(q) FROM w) THEN 1 ELSE 0 END AS q FROM w),
 pl AS (SELECT l_partkey, l_suppkey, bin, row_number() OVER (PARTITION BY bin ORDER BY {md5_sql(42, 'l_partkey', 'l_suppkey')}, l_partkey, l_suppkey) AS r FROM b WHERE l_partkey % 10 <> 0) SELECT l_partkey, l_suppkey, CAST(pl.bin AS INTEGER) AS bin FROM pl JOIN z ON pl.bin = z.bin WHERE r <= q""")
def quantile_matched_negatives(spark, d):
    rows = part_supplier(spark, d)
    return B.matched_by_quantile(rows.where("l_partkey % 10 = 0"), rows.where("l_partkey % 10 <> 0"), "a_degree", 200, ["l_partkey", "l_suppkey"], 5).select("l_partkey", "l_suppkey", F.col("bin").cast("int").alias("bin"))


# --- samplers and splits that follow one another -----------------------------


@query(f"""WITH r AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {_HO}, o_orderkey) AS r FROM orders), m AS (SELECT *, r <= CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN 20 ELSE 0 END AS k FROM r), g AS (SELECT o_orderstatus, count(*) FILTER (WHERE k) AS got FROM m GROUP BY 1),
 s AS (SELECT m.*, row_number() OVER (PARTITION BY m.o_orderstatus ORDER BY {md5_sql(43, 'o_orderkey')}, o_orderkey) AS s FROM m WHERE NOT k) SELECT o_orderkey, o_orderstatus, o_orderpriority FROM m WHERE k UNION ALL SELECT o_orderkey, s.o_orderstatus, o_orderpriority FROM s JOIN g ON s.o_orderstatus = g.o_orderstatus WHERE s <= 60 - got""")
def class_backfill(spark, d):
    return S.backfilled_quota(T(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), "o_orderstatus", "o_orderpriority", {"1-URGENT": 20, "2-HIGH": 20, "3-MEDIUM": 20}, ["o_orderkey"])


@query(f"""WITH n AS (SELECT n_nationkey, n_regionkey, count(*) OVER (PARTITION BY n_regionkey) AS n FROM nation), m AS (SELECT n_nationkey, n_regionkey, unnest(range(1, CAST(ceil(8 / n) AS BIGINT) + 1)) AS c FROM n) SELECT n_nationkey, n_regionkey FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY {md5_sql(42, 'c', 'n_nationkey')}, c, n_nationkey) AS r FROM m) WHERE r <= 8""")
def sample_with_replacement(spark, d):
    return S.with_replacement(T(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", ["n_nationkey"], 8)


@query(f"""WITH RECURSIVE {SUP_SQL}, p AS MATERIALIZED (SELECT s1, s2, row_number() OVER (ORDER BY {md5_sql(42, 's1', 's2')}, s1, s2) AS r FROM (SELECT DISTINCT s1, s2 FROM sp)), w(r, s1, s2, ok, c) AS (SELECT CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, (SELECT list_transform(range(max(s_suppkey) + 1), lambda x: 0) FROM supplier)
 UNION ALL SELECT r, s1, s2, ok, CASE WHEN ok THEN list_transform(c, lambda x, i: CASE WHEN i = s1 + 1 OR i = s2 + 1 THEN x + 1 ELSE x END) ELSE c END FROM (SELECT p.*, c, c[p.s1 + 1] < 10 AND c[p.s2 + 1] < 10 AS ok FROM w JOIN p ON p.r = w.r + 1)) SELECT s1, s2 FROM w WHERE ok""")
def two_sided_cap(spark, d):
    return S.two_sided_cap(linked_suppliers(spark, d), "s1", "s2", ["s1", "s2"], 10)


def family_sql(order: str, pick: str) -> str:
    return f"""WITH RECURSIVE s AS (SELECT p_brand AS f, count(*) AS n FROM part GROUP BY 1), g AS (SELECT f, n, row_number() OVER (ORDER BY {order}) AS r, sum(n) OVER () AS t FROM s), w(r, f, k, a, b, c) AS (SELECT CAST(0 AS BIGINT), '', '', CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT)
 UNION ALL SELECT r, f, k, a + CASE WHEN k = 'train' THEN n ELSE 0 END, b + CASE WHEN k = 'val' THEN n ELSE 0 END, c + CASE WHEN k = 'test' THEN n ELSE 0 END FROM (SELECT g.r, g.f, g.n, a, b, c, {pick} AS k FROM w JOIN g ON g.r = w.r + 1)) SELECT p_partkey, k AS fold FROM part JOIN w ON p_brand = f"""


@query(family_sql("n DESC, f", "CASE WHEN a + n <= t * CAST(0.7 AS DOUBLE) THEN 'train' WHEN b + n <= t * CAST(0.1 AS DOUBLE) THEN 'val' ELSE 'test' END"))
def split_family_greedy(spark, d):
    return X.family_greedy(T(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "fold")


_LACK = "a / t - CAST(0.7 AS DOUBLE)", "b / t - CAST(0.1 AS DOUBLE)", "c / t - CAST(0.2 AS DOUBLE)"
_UNDER = f"CASE WHEN {_LACK[0]} <= {_LACK[1]} AND {_LACK[0]} <= {_LACK[2]} THEN 'train' WHEN {_LACK[1]} <= {_LACK[2]} THEN 'val' ELSE 'test' END"


@query(family_sql(f"{md5_sql(42, 'f')}, f", _UNDER))
def split_most_underfilled(spark, d):
    return X.gene_groups(T(spark, d, "part").select("p_partkey", "p_brand"), "p_brand").select("p_partkey", "fold")


_FOLD = "CASE {f} WHEN 'train' THEN 0 WHEN 'val' THEN 1 ELSE 2 END"


@query(f"""WITH {SUP_SQL}, p AS (SELECT DISTINCT s1, s2 FROM sp), u AS (SELECT s1 AS e FROM p UNION SELECT s2 FROM p), f AS (SELECT e, {cut_sql('r', 'n', (0.8, 0.05, 0.15))} AS fold FROM (SELECT e, row_number() OVER (ORDER BY {md5_sql(42, 'e')}, e) AS r, count(*) OVER () AS n FROM u))
 SELECT s1, s2, CASE greatest({_FOLD.format(f='a.fold')}, {_FOLD.format(f='b.fold')}) WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS fold FROM p JOIN f a ON a.e = s1 JOIN f b ON b.e = s2""")
def split_cold_one_kind(spark, d):
    """Cold for both ends of pairs of one kind: the later of the ends' folds."""
    return X.max_rank(linked_suppliers(spark, d), "s1", "s2", ratios=(0.8, 0.05, 0.15), one_kind=True).select("s1", "s2", "fold")


@query(f"""WITH c AS (SELECT l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_partkey ORDER BY count(*) DESC, l_suppkey) AS q FROM lineitem GROUP BY 1, 2), m AS (SELECT l_partkey, l_suppkey AS prim FROM c WHERE q = 1), f AS (SELECT e, {cut_sql('r', 'n')} AS fold FROM (SELECT e, row_number() OVER (ORDER BY {md5_sql(42, 'e')}, e) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT prim AS e FROM m)))
 SELECT DISTINCT m.l_partkey, prim AS "primary", fold FROM m JOIN f ON e = prim""")
def split_cold_primary(spark, d):
    return X.cold_primary(lines(spark, d).select("l_partkey").distinct(), "l_partkey", lines(spark, d), "l_suppkey").select("l_partkey", "primary", "fold")


@query(f"""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY {md5_sql(42, 'o_orderkey')}, o_orderkey) AS r, count(*) OVER () AS n FROM orders), c AS (SELECT e, {cut_sql('r', 'n')} AS fold FROM (SELECT e, row_number() OVER (ORDER BY {md5_sql(43, 'e')}, e) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey AS e FROM orders)))
 SELECT o.o_orderkey, {cut_sql('r', 'n')} AS split_random, c.fold AS split_cold, CASE WHEN year(o_orderdate) < 1995 THEN 'train' WHEN year(o_orderdate) < 1997 THEN 'val' ELSE 'test' END AS split_temporal FROM orders o JOIN r ON o.o_orderkey = r.o_orderkey JOIN c ON e = o_custkey""")
def split_bundle(spark, d):
    base = T(spark, d, "orders").select("o_orderkey", "o_custkey", F.year("o_orderdate").alias("y"))
    bundle = {"random": ("random", {"keys": ["o_orderkey"]}), "cold": ("cold_entity", {"entity": "o_custkey", "seed": 43}), "temporal": ("temporal", {"year": "y", "train_before": 1995, "val_before": 1997})}
    return X.apply_bundle(base, bundle).select("o_orderkey", "split_random", "split_cold", "split_temporal")


@query("""SELECT 'random_v2' AS split_name, 'random' AS strategy, fold, count(*) AS n FROM (SELECT CASE WHEN year(o_orderdate) < 1995 THEN 'train' ELSE 'test' END AS fold FROM orders) GROUP BY fold""")
def split_registry(spark, d):
    """A name registered twice keeps its last assignments; the latest version of a base name is read back."""
    o = T(spark, d, "orders").select("o_orderkey", F.when(F.year("o_orderdate") < 1995, "train").otherwise("test").alias("fold"))
    table = X.register(None, o.withColumn("fold", F.lit("train")), "random_v1", "random", "o_orderkey", 1)
    table = X.register(table, o.withColumn("fold", F.lit("val")), "random_v2", "random", "o_orderkey", 1)
    table = X.register(table, o, "random_v2", "random", "o_orderkey", 2)
    latest = X.latest_version(table.select("split_name").distinct()).select("split_name")
    return table.join(latest, "split_name").groupBy("split_name", "strategy", "fold").agg(F.count("*").alias("n"))


# --- evaluation and audits ---------------------------------------------------


@query(f"WITH {ANSWERS_SQL} SELECT model, event_type, round(avg(CASE WHEN gold = pred THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM an WHERE pred IS NOT NULL GROUP BY 1, 2")
def per_class_accuracy(spark, d):
    return M.per_class_accuracy(answers(spark, d), "gold", "pred", "event_type", ["model"]).withColumn("accuracy", F.round("accuracy", 6))


_TESTED = "CASE WHEN {c} IN ('A', 'B') THEN 'tested' WHEN {c} IS NOT NULL THEN 'untested' END"


@query(f"""WITH {ANSWERS_SQL}, e AS (SELECT model, {_TESTED.format(c='gold')} AS g, {_TESTED.format(c='pred')} AS p, item, CASE WHEN item % 2 = 0 THEN repeat('see PubChem ', 5) ELSE 'PubChem' END AS ev, CASE WHEN item < 100 THEN 'pre' ELSE 'post' END AS t FROM an),
 c AS (SELECT model, count(*) AS n_total, count(p) AS n_valid, avg(CASE WHEN p IS NOT NULL THEN 1.0 ELSE 0.0 END) AS parse_rate, avg(CASE WHEN p IS NOT NULL THEN CASE WHEN p = g THEN 1.0 ELSE 0.0 END END) AS accuracy, CAST(count_if(g = 'tested' AND p = 'tested') AS DOUBLE) AS tp, CAST(count_if(g = 'untested' AND p = 'untested') AS DOUBLE) AS tn, CAST(count_if(g = 'untested' AND p = 'tested') AS DOUBLE) AS fp, CAST(count_if(g = 'tested' AND p = 'untested') AS DOUBLE) AS fn,
 coalesce(avg(CASE WHEN g = 'tested' AND p = 'tested' THEN CASE WHEN length(ev) > 50 THEN 1.0 ELSE 0.0 END END), 0) AS evidence_rate, avg(CASE WHEN p IS NOT NULL AND t = 'pre' THEN CASE WHEN p = g THEN 1.0 ELSE 0.0 END END) AS ae, avg(CASE WHEN p IS NOT NULL AND t = 'post' THEN CASE WHEN p = g THEN 1.0 ELSE 0.0 END END) AS al FROM e GROUP BY 1)
 SELECT model, n_total, n_valid, round(parse_rate, 6) AS parse_rate, round(accuracy, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round((tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 6) AS mcc, round(evidence_rate, 6) AS evidence_rate, round(ae, 6) AS accuracy_early, round(al, 6) AS accuracy_late, round(ae - al, 6) AS gap, ae - al > 0.15 AS flagged FROM c""")
def tested_block(spark, d):
    """All figures of tested and untested answers."""
    t = lambda c: F.when(F.col(c).isin("A", "B"), "tested").when(F.col(c).isNotNull(), "untested")
    rows = answers(spark, d).withColumns({"g": t("gold"), "p": t("pred"), "ev": F.when(F.col("item") % 2 == 0, F.repeat(F.lit("see PubChem "), 5)).otherwise("PubChem"), "t": F.when(F.col("item") < 100, "pre").otherwise("post")})
    out = M.tested_block(rows, "g", "p", "ev", "t", "pre", "post", ["model"])
    return out.select("model", "n_total", "n_valid", *(F.round(c, 6).alias(c) for c in ("parse_rate", "accuracy", "f1", "mcc", "evidence_rate", "accuracy_early", "accuracy_late", "gap")), "flagged")


@query("""SELECT event_id, round(CASE WHEN event_id % 5 = 0 THEN 0.0 WHEN event_id % 2 = 0 THEN 2.0 * 2 / (3 + 2) ELSE 2.0 * 1 / (3 + 1) END, 6) AS f1 FROM events""")
def key_set_f1(spark, d):
    """Field names of predicted against gold objects, old names folded into new ones."""
    k = F.col("event_id")
    gold = F.lit('{"genes": [], "total": 1, "screen": "x"}')
    predicted = F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 2 == 0, '{"findings": [], "total": 2}').otherwise('{"total": 2}')
    return T(spark, d, "events").select("event_id", F.round(M.key_set_f1(gold, predicted, {"findings": "genes"}), 6).alias("f1"))


@query("""WITH c AS (SELECT user_id % 5 AS source, event_type AS target, avg(value) AS value FROM events GROUP BY 1, 2), b AS (SELECT event_type AS target, avg(value) AS baseline FROM events WHERE event_id % 2 = 0 GROUP BY 1), r AS (SELECT target, source AS best_source, row_number() OVER (PARTITION BY target ORDER BY value DESC, source) AS r FROM c)
 SELECT source, c.target, round(value, 6) AS value, round(value - baseline, 6) AS gain, best_source FROM c LEFT JOIN b ON b.target = c.target JOIN r ON r.target = c.target AND r.r = 1""")
def transfer_gain(spark, d):
    e = T(spark, d, "events").select((F.col("user_id") % 5).alias("source"), F.col("event_type").alias("target"), "value", "event_id")
    baseline = e.where("event_id % 2 = 0").groupBy("target").agg(F.avg("value").alias("baseline"))
    return M.transfer_gain(e, "source", "target", "value", baseline).withColumns({c: F.round(c, 6) for c in ("value", "gain")})


@query(f"""WITH p AS (SELECT l_partkey, l_suppkey, count(DISTINCT l_linestatus) AS ns FROM lineitem GROUP BY 1, 2), e AS (SELECT e, {cut_sql('r', 'n')} AS fold FROM (SELECT e, row_number() OVER (ORDER BY {md5_sql(42, 'e')}, e) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT l_partkey AS e FROM lineitem))), f AS (SELECT p.*, e.fold FROM p JOIN e ON e = l_partkey)
 SELECT 'size' AS section, 'evidence' AS name, NULL AS detail, CAST(count(*) AS DOUBLE) AS value FROM lineitem UNION ALL SELECT 'size', 'pairs', NULL, count(*) FROM p UNION ALL SELECT 'size', 'l_partkey', NULL, count(DISTINCT l_partkey) FROM p UNION ALL SELECT 'size', 'l_suppkey', NULL, count(DISTINCT l_suppkey) FROM p UNION ALL SELECT 'source', l_linestatus, NULL, count(*) FROM lineitem GROUP BY 2 UNION ALL SELECT 'fold', 'fold', fold, count(*) FROM f GROUP BY 3
 UNION ALL SELECT 'leaked', 'fold', 'l_partkey', 0 UNION ALL SELECT 'overlap', 'F', 'O', count(*) FROM p WHERE ns = 2 HAVING count(*) > 0 UNION ALL SELECT 'sources', CAST(ns AS VARCHAR), NULL, count(*) FROM p GROUP BY 2""")
def leakage_report(spark, d):
    from nadir.operators import pairs as P

    pairs = P.rollup(lines(spark, d), P.PairSpec("l_partkey", "l_suppkey", {"ns": F.countDistinct("l_linestatus")}))
    return Q.leakage_report(lines(spark, d), X.cold_entity(pairs, "l_partkey"), ["l_partkey", "l_suppkey"], "l_linestatus", "ns", {"fold": "l_partkey"}, ["fold"])


@query("""WITH o AS (SELECT o_orderkey, o_orderstatus, nullif(o_orderpriority, '5-LOW') AS o_orderpriority, o_totalprice FROM orders) SELECT 'rows' AS section, NULL AS name, NULL AS detail, CAST(count(*) AS DOUBLE) AS value FROM o UNION ALL SELECT 'filled', 'o_orderkey', NULL, count(o_orderkey) FROM o UNION ALL SELECT 'filled', 'o_orderstatus', NULL, count(o_orderstatus) FROM o UNION ALL SELECT 'filled', 'o_orderpriority', NULL, count(o_orderpriority) FROM o
 UNION ALL SELECT 'filled', 'o_totalprice', NULL, count(o_totalprice) FROM o UNION ALL SELECT 'min', 'o_totalprice', NULL, min(o_totalprice) FROM o UNION ALL SELECT 'max', 'o_totalprice', NULL, max(o_totalprice) FROM o UNION ALL SELECT 'flag', 'dear', NULL, count(*) FROM o WHERE o_totalprice > 300000 UNION ALL SELECT 'value', 'o_orderpriority', o_orderpriority, count(*) FROM o GROUP BY 3""")
def dataset_profile(spark, d):
    o = T(spark, d, "orders").select("o_orderkey", "o_orderstatus", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("o_orderpriority"), "o_totalprice")
    return Q.profile(o, ["o_orderpriority"], ["o_totalprice"], {"dear": F.col("o_totalprice") > 300000}).where("section <> 'mean'")


@query(f"""WITH b AS (SELECT o_orderkey, 'price' AS rule FROM orders WHERE o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE o_orderstatus = 'P') SELECT o_orderkey, rule FROM (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY {_HO}, o_orderkey) AS r FROM b) WHERE r <= 25""")
def qc_sample(spark, d):
    return Q.qc_sample(T(spark, d, "orders"), {"price": F.col("o_totalprice") <= 200000, "status": F.col("o_orderstatus") != "P"}, ["o_orderkey"], 25).select("o_orderkey", "rule")


@query(f"""WITH p AS (SELECT l_partkey, l_suppkey, {CONSENSUS_SQL} AS k2, avg({ZIP_SQL}) AS z FROM (SELECT *, {SYN_SQL.format(z=ZIP_SQL)} AS k FROM lineitem) GROUP BY 1, 2) SELECT CASE WHEN l_partkey % 7 = l_suppkey % 7 THEN 'shared' ELSE 'no_shared' END AS overlap, k2 AS class, count(*) AS n, round(avg(z), 5) AS mean_zip FROM p GROUP BY 1, 2""")
def overlap_by_class(spark, d):
    rows = lines(spark, d).withColumn("z", zip_column()).withColumn("k", C.synergy_class(F.col("z"))).groupBy("l_partkey", "l_suppkey").agg(C.consensus_class(F.col("k")).alias("class"), F.avg("z").alias("z"))
    return Q.overlap_by_class(rows, F.col("l_partkey") % 7 == F.col("l_suppkey") % 7, "class", {"mean_zip": F.round(F.avg("z"), 5)})


@query(f"WITH {SUP_SQL} SELECT DISTINCT least(a.s_name, b.s_name) AS low, greatest(a.s_name, b.s_name) AS high FROM sp JOIN supplier a ON s1 = a.s_suppkey JOIN supplier b ON s2 = b.s_suppkey WHERE a.s_name <> b.s_name AND a.s_nationkey < 20 AND b.s_nationkey < 20")
def edge_list(spark, d):
    return Q.edge_list(supplier_pairs(spark, d), "s1", "s2", T(spark, d, "supplier").where("s_nationkey < 20"), "s_suppkey", "s_name", pair_partitions(spark, d))
