"""Registered queries on reports: hits with families, crosswalks, metadata from lists of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports
from . import adapters as A
from .registry import query

R = lambda c: F.round(c, 6)


def _part(spark, sf):
    return A.table(spark, sf, "part").withColumn("name", F.concat("p_brand", F.lit("|"), F.col("p_partkey").cast("string")))


@query("""WITH l AS (SELECT 's' || (l_orderkey % 100) || '|c|' || l_orderkey AS query, p_brand || '|' || p_partkey AS target, p_brand AS accession, l_discount * 100 AS pident, l_quantity AS alnlen, l_extendedprice AS bits, l_quantity + 1 AS qspan, l_quantity AS tspan, p_size FROM lineitem JOIN part ON p_partkey = l_partkey),
n AS (SELECT query, sum(alnlen) AS qlen FROM l GROUP BY 1), f AS (SELECT p_brand AS accession, max(p_type) AS family FROM part WHERE p_brand NOT LIKE '%1' GROUP BY 1),
b AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY bits DESC, pident DESC, alnlen DESC, target DESC) AS r FROM l)
SELECT o_orderkey AS id, target, b.accession, CASE WHEN target IS NOT NULL THEN coalesce(family, '') END AS family, round(pident, 6) AS pident, round(qspan / qlen * 100, 6) AS query_coverage, round(CASE WHEN p_size > 20 THEN tspan / p_size * 100 ELSE tspan * 0 END, 6) AS target_coverage, bits
FROM orders LEFT JOIN b ON b.query = 's' || (o_orderkey % 100) || '|c|' || o_orderkey AND r = 1 LEFT JOIN n ON n.query = b.query LEFT JOIN f ON f.accession = b.accession""")
def hit_report(spark, sf):
    """Orders as features, their lines as hits on parts; brands are accessions, of which some have no family."""
    p = _part(spark, sf)
    li = A.table(spark, sf, "lineitem").join(p.select("p_partkey", "name"), F.col("l_partkey") == F.col("p_partkey"))
    hits = li.select(
        F.concat(F.lit("s"), (F.col("l_orderkey") % 100).cast("string"), F.lit("|c|"), F.col("l_orderkey").cast("string")).alias("query"), F.col("name").alias("target"), F.col("l_discount").alias("fident"), F.col("l_quantity").alias("alnlen"),
        F.col("l_linenumber").alias("qstart"), (F.col("l_linenumber") + F.col("l_quantity")).alias("qend"), F.lit(1).alias("tstart"), F.col("l_quantity").alias("tend"), F.col("l_tax").alias("evalue"), F.col("l_extendedprice").alias("bits"),
    )
    long_ = p.filter("p_size > 20").select(F.col("name").alias("target"), F.col("p_size").alias("length"))
    families = p.filter(~F.col("p_brand").endswith("1")).select(F.col("p_brand").alias("accession"), F.col("p_type").alias("family"))
    report = reports.hit_report(hits, hits.groupBy("query").agg(F.sum("alnlen").alias("length")), long_, families)
    k = F.col("o_orderkey")
    features = A.table(spark, sf, "orders").select(k.alias("id"), F.concat(F.lit("s"), (k % 100).cast("string")).alias("genome_id"), F.lit("c").alias("contig_id"), F.concat(F.lit("f|"), k.cast("string")).alias("gene_id"))
    return reports.features_with_hits(features, report).select("id", "target", "accession", "family", R("pident").alias("pident"), R("query_coverage").alias("query_coverage"), R("target_coverage").alias("target_coverage"), "bits")


CROSSWALK = """h AS (SELECT CASE WHEN l_quantity > 25 THEN 'proteins' ELSE 'genes' END AS search, 'gb|ARO:' || l_suppkey || '|' || l_orderkey AS query, 'ARO:' || l_suppkey AS term, l_suppkey, p_brand || ' ' || p_partkey AS target, p_brand, p_type, p_size, l_discount AS fident, l_quantity AS alnlen, l_extendedprice AS bits FROM lineitem JOIN part ON p_partkey = l_partkey),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY search, query ORDER BY bits DESC, target DESC, fident DESC) AS r FROM h) WHERE r = 1),
g AS (SELECT p_brand, max(p_type) AS kind FROM part WHERE p_brand NOT LIKE '%1' GROUP BY 1),
x AS (SELECT search, query, term, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS family, CASE WHEN s_acctbal > 0 THEN n_name ELSE '' END AS drug_class, target, CASE WHEN search = 'proteins' THEN p_type ELSE '' END AS gene_family,
CASE WHEN search = 'proteins' THEN b.p_brand ELSE coalesce(kind, 'Unclassified') END AS class, CASE WHEN search = 'proteins' THEN p_size::VARCHAR ELSE '' END AS subtype, bits FROM b JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey LEFT JOIN g ON g.p_brand = b.p_brand)"""


def _crosswalk(spark, sf):
    p = A.table(spark, sf, "part").withColumn("target", F.concat("p_brand", F.lit(" "), F.col("p_partkey").cast("string")))
    li = A.table(spark, sf, "lineitem").join(p.select(F.col("p_partkey").alias("l_partkey"), "target"), "l_partkey")
    hits = li.select(F.concat(F.lit("gb|ARO:"), F.col("l_suppkey").cast("string"), F.lit("|"), F.col("l_orderkey").cast("string")).alias("query"), "target", F.col("l_discount").alias("fident"), F.col("l_quantity").alias("alnlen"), F.col("l_extendedprice").alias("bits"))
    s = A.table(spark, sf, "supplier").filter("s_acctbal > 0").join(A.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("s_nationkey"))
    terms = s.select(F.concat(F.lit("ARO:"), F.col("s_suppkey").cast("string")).alias("term"), F.col("s_name").alias("family"), F.col("n_name").alias("drug_class"))
    whole = p.select(F.col("target").alias("name"), F.col("p_type").alias("gene_family"), F.col("p_brand").alias("class"), F.col("p_size").cast("string").alias("subtype"))
    brands = p.filter(~F.col("p_brand").endswith("1")).select(F.col("p_brand").alias("name"), F.lit("").alias("gene_family"), F.col("p_type").alias("class"), F.lit("").alias("subtype"))
    return reports.crosswalk({"proteins": (hits.filter("alnlen > 25"), whole, F.col("target")), "genes": (hits.filter("alnlen <= 25"), brands, F.split_part("target", F.lit(" "), F.lit(1)))}, terms)


@query(f"WITH {CROSSWALK} SELECT search, query, term, family, drug_class, target, gene_family, class, subtype, bits FROM x")
def resistance_crosswalk(spark, sf):
    """Lines as hits of two searches: one names its targets' classes whole, the other by their first word."""
    return _crosswalk(spark, sf).drop("fident", "alnlen")


@query(f"WITH {CROSSWALK} SELECT search, class, count(*) AS queries, count(DISTINCT term) AS terms FROM x GROUP BY 1, 2")
def crosswalk_counts(spark, sf):
    return reports.crosswalk_counts(_crosswalk(spark, sf))


@query("""WITH f AS (SELECT o_custkey, max('fasta/' || year(o_orderdate) || '/' || o_custkey || '.fna') AS path FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT c_custkey::VARCHAR AS genome_id, c_mktsegment AS species_cluster, CASE WHEN c_acctbal > 0 THEN n_name ELSE c_mktsegment END AS taxonomy, coalesce(path, '') AS fasta_path, (path IS NOT NULL)::INTEGER AS is_representative
FROM customer JOIN nation ON n_nationkey = c_nationkey LEFT JOIN f ON o_custkey = c_custkey WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)""")
def series_metadata(spark, sf):
    c, o = A.table(spark, sf, "customer"), A.table(spark, sf, "orders")
    key = F.col("o_custkey").cast("string")
    tax = c.filter("c_acctbal > 0").join(A.table(spark, sf, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).select(F.col("c_custkey").cast("string").alias("accession"), F.col("n_name").alias("taxonomy"))
    fasta = o.filter("o_orderstatus = 'P'").select(F.concat(F.lit("fasta/"), F.year("o_orderdate").cast("string"), F.lit("/"), key, F.lit(".fna")).alias("path"))
    marks = o.filter("o_totalprice > 200000").select(F.concat(F.lit("marks/"), key, F.lit(".tgt")).alias("path"))
    return reports.series_metadata(c.select(F.col("c_custkey").cast("string").alias("genome"), F.col("c_mktsegment").alias("cluster")), tax, fasta, marks)
