"""Registered queries on clusters of items, evaluation and intervals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalar import clean_field, confidence, parse_size, placement_score, strand, token_weight
from ..operators import clusters as C
from ..operators import evaluate as V
from ..session import materialise
from . import adapters as A
from .registry import query

R = lambda c: F.round(c, 6)

ITEMS = """li AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS rn FROM lineitem),
it AS (SELECT 's' || (l_orderkey % 100) || ':o' || l_orderkey AS cluster, l_orderkey AS ok, rn, l_partkey AS pk, p_name, p_brand, p_size, l_orderkey || '_' || rn AS gene_id FROM li JOIN part ON p_partkey = l_partkey),
words AS (SELECT *, list_filter(regexp_split_to_array(lower(p_name), '[^a-z0-9]+'), lambda w: w <> '' AND w NOT IN ('protein', 'hypothetical'))[1:4] AS w FROM it),
tok AS (SELECT *, list_sort(list_distinct(list_filter(['KO:P' || pk, 'PFAM:' || upper(p_brand), 'COG:' || p_size, CASE WHEN len(w) > 0 THEN 'PRODUCT:' || array_to_string(w, '_') END], lambda x: x IS NOT NULL))) AS tokens FROM words)"""
COUNTS = "tc AS (SELECT cluster, token, count(*) AS n FROM (SELECT cluster, unnest(tokens) AS token FROM tok) GROUP BY 1, 2)"
ADJ = """ad AS (SELECT DISTINCT cluster, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT cluster, tokens[1] AS x, lead(tokens[1]) OVER (PARTITION BY cluster ORDER BY rn) AS y FROM tok) WHERE y IS NOT NULL)"""
WEIGHT = "CASE WHEN split_part(token, ':', 1) IN ('KO', 'EGGNOG', 'SMASH') THEN 3.0 WHEN split_part(token, ':', 1) IN ('PFAM', 'COG', 'AMRCLASS') THEN 2.0 ELSE 1.0 END"
XWEIGHT = WEIGHT.replace("token", "x.token")
#: Candidate pairs for the score queries: orders that share at least two parts.
CAND = "cand AS (SELECT x.cluster AS q, y.cluster AS t FROM (SELECT DISTINCT cluster, pk FROM it) x JOIN (SELECT DISTINCT cluster, pk FROM it) y USING (pk) WHERE x.cluster < y.cluster GROUP BY 1, 2 HAVING count(*) >= 2)"


def _named(items):
    return C.with_tokens(items).withColumn("cluster", F.concat_ws(":", "genome_id", "cluster_id"))


def _items(spark, sf):
    return materialise(_named(A.items(spark, sf)), "items")


def _candidates(spark, sf):
    """Pairs of orders that share at least two parts, and the items of those orders alone."""
    keys = A.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").na.drop()
    near = materialise(C.sharing_two(keys, "l_orderkey", "l_partkey"), "near")
    items = materialise(_named(A.items(spark, sf, near.select(F.explode(F.array("q", "t")).alias("l_orderkey")).distinct())), "items")
    p = items.select("cluster", "ko").distinct()
    both = p.withColumnRenamed("cluster", "q").join(p.withColumnRenamed("cluster", "t"), "ko").filter("q < t")
    return items, materialise(both.groupBy("q", "t").count().filter("count >= 2").select("q", "t"), "pairs")


@query(f"WITH {ITEMS} SELECT cluster, gene_id, array_to_string(tokens, '|') AS tokens, tokens[1] AS rep FROM tok")
def feature_tokens(spark, sf):
    return _items(spark, sf).select("cluster", "gene_id", F.array_join("tokens", "|").alias("tokens"), "rep")


@query(f"WITH {ITEMS}, {COUNTS} SELECT split_part(token, ':', 1) AS kind, count(*) AS pairs, sum(n)::BIGINT AS items, sum(n * {WEIGHT}) AS weight FROM tc GROUP BY 1")
def cluster_tokens(spark, sf):
    t = C.token_counts(_items(spark, sf))
    return t.groupBy(F.split_part("token", F.lit(":"), F.lit(1)).alias("kind")).agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("items"), F.sum(F.col("n") * token_weight(F.col("token"))).alias("weight"))


@query(f"WITH {ITEMS}, {ADJ} SELECT a, b, count(*) AS clusters FROM ad GROUP BY 1, 2")
def cluster_adjacency(spark, sf):
    return C.adjacencies(_items(spark, sf)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("clusters"))


@query("""WITH e AS (SELECT event_id::VARCHAR AS gene_id, user_id::VARCHAR AS g, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 60 AS e FROM events), f AS (SELECT *, CASE WHEN s - lag(e) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY g ORDER BY s, e, gene_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY s, e, gene_id) AS run FROM f), k AS (SELECT *, count(*) OVER (PARTITION BY g, run) AS n FROM r), m AS (SELECT * FROM k WHERE n >= 3)
SELECT g || ':c1:' || printf('%09d', min(s)) || '-' || printf('%09d', max_by(e, (s, e, gene_id))) AS cluster, count(*) AS genes, min(s) AS "start", max(e) AS "end" FROM m GROUP BY g, run""")
def cluster_islands(spark, sf):
    b = C.build_clusters(A.event_items(spark, sf), 6 * 3600, 3, merge_runs=False)
    return b.groupBy("cluster").agg(F.count(F.lit(1)).alias("genes"), F.min("start").alias("start"), F.max("end").alias("end"))


@query("""WITH e AS (SELECT event_id::VARCHAR AS gene_id, user_id::VARCHAR AS g, floor(epoch(ts))::BIGINT AS s, floor(epoch(ts))::BIGINT + 60 AS e FROM events), f AS (SELECT *, CASE WHEN s - lag(e) OVER w <= 21600 THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY g ORDER BY s, e, gene_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY g ORDER BY s, e, gene_id) AS run FROM f), k AS (SELECT *, count(*) OVER (PARTITION BY g, run) AS n FROM r), m AS (SELECT * FROM k WHERE n >= 3)
SELECT g || ':c1:' || printf('%09d', min(s)) || '-' || printf('%09d', max_by(e, (s, e, gene_id))) AS cluster, count(*) AS genes, min(s) AS "start", max(e) AS "end" FROM m GROUP BY g""")
def cluster_build(spark, sf):
    b = C.build_clusters(A.event_items(spark, sf), 6 * 3600, 3)
    return b.groupBy("cluster").agg(F.count(F.lit(1)).alias("genes"), F.min("start").alias("start"), F.max("end").alias("end"))


OVERLAP = f"""tt AS (SELECT cluster, count(*) AS kinds, sum(n) AS n, sum(n * {WEIGHT}) AS w FROM tc GROUP BY 1),
ov AS (SELECT q, t, count(*) AS shared, sum({XWEIGHT} * least(x.n, y.n)) AS low, sum({XWEIGHT} * greatest(x.n, y.n)) AS high, sum(abs(x.n - y.n)) AS apart, sum(x.n) AS sx, sum(y.n) AS sy FROM cand JOIN tc x ON x.cluster = q JOIN tc y ON y.cluster = t AND y.token = x.token GROUP BY 1, 2),
al AS (SELECT ov.*, a.kinds AS qk, b.kinds AS tk, a.n AS qn, b.n AS tn, a.w AS qw, b.w AS tw FROM ov JOIN tt a ON a.cluster = q JOIN tt b ON b.cluster = t)"""
PAIRADJ = """na AS (SELECT cluster, count(*) AS n FROM ad GROUP BY 1), ab AS (SELECT q, t, count(*) AS m FROM cand JOIN ad x ON x.cluster = q JOIN ad y ON y.cluster = t AND (y.a, y.b) = (x.a, x.b) GROUP BY 1, 2),
aj AS (SELECT q, t, CASE WHEN coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(m, 0) = 0 THEN 1.0 ELSE coalesce(m, 0) / (coalesce(u.n, 0) + coalesce(v.n, 0) - coalesce(m, 0)) END AS adjacency FROM cand LEFT JOIN ab USING (q, t) LEFT JOIN na u ON u.cluster = q LEFT JOIN na v ON v.cluster = t)"""


def _lcs(a: str, b: str) -> str:
    """Length of the longest common subsequence of two lists of under 60 elements, a row of its table as bits."""
    full = f"((1::BIGINT << len({a})) - 1)"
    hits = f"list_transform({b}, lambda y: coalesce(list_sum(list_transform(range(len({a})), lambda i: CASE WHEN {a}[i + 1] = y THEN 1::BIGINT << i ELSE 0 END)), 0)::BIGINT)"
    return f"(len({a}) - bit_count(list_reduce(list_prepend({full}, {hits}), lambda r, m: ((r + (r & m)) | (r - (r & m))) & {full})))"


#: First tokens in order, of those the other cluster has, for the pairs of ``cand``; then all scores.
ORDER = f"""rp AS (SELECT cluster, rn, tokens[1] AS rep FROM tok WHERE tokens[1] IS NOT NULL),
qr AS (SELECT q, t, list(rep ORDER BY rn) AS a FROM cand JOIN rp ON rp.cluster = q JOIN tc ON tc.cluster = t AND token = rep GROUP BY 1, 2), tr AS (SELECT q, t, list(rep ORDER BY rn) AS b FROM cand JOIN rp ON rp.cluster = t JOIN tc ON tc.cluster = q AND token = rep GROUP BY 1, 2),
od AS (SELECT q, t, coalesce(a, []) AS a, coalesce(b, []) AS b FROM cand LEFT JOIN qr USING (q, t) LEFT JOIN tr USING (q, t)), lc AS (SELECT q, t, a, b, {_lcs('a', 'b')} AS ahead, {_lcs('list_reverse(a)', 'b')} AS back FROM od),
ord AS (SELECT q, t, least(1.0::DOUBLE, greatest(ahead, back) / greatest(1, len(a) - 1, len(b) - 1)) AS order_score, back > ahead AND back >= 2 AS inverted FROM lc)"""
SCORE = "least(greatest(weighted * 0.45::DOUBLE + adjacency * 0.30::DOUBLE + order_score * 0.15::DOUBLE + copies * 0.10::DOUBLE, 0), 1)"


@query(f"""WITH {ITEMS}, {COUNTS}, {ADJ}, {CAND}, {OVERLAP}, {PAIRADJ} SELECT q, t, round(shared / (qk + tk - shared), 6) AS functional, round(low / (high + qw + tw - low - high), 6) AS weighted,
round(1 - (apart + qn - sx + tn - sy) / (2 * greatest(qn + tn, 1)), 6) AS copies, round(adjacency, 6) AS adjacency FROM al JOIN aj USING (q, t)""")
def cluster_pair_jaccard(spark, sf):
    i, p = _candidates(spark, sf)
    t, a = C.token_counts(i), C.adjacencies(i)
    s = C.token_scores(C.token_overlap(p, t, t), False).join(C.pair_scores(p, a, a), ["q", "t"])
    return s.select("q", "t", *(R(c).alias(c) for c in ("functional", "weighted", "copies", "adjacency")))


@query(f"""WITH {ITEMS}, {COUNTS}, {CAND}, {OVERLAP} SELECT q, t, round(2 * shared / (qk + tk), 6) AS functional, round(2 * low / (2 * high + qw + tw - low - high), 6) AS weighted,
round(greatest(1 - (2 * apart + qn - sx + tn - sy) / (2 * greatest(qn, tn, 1)), 0), 6) AS copies, qk - shared AS missing, tk - shared AS extra FROM al""")
def cluster_pair_dice(spark, sf):
    i, p = _candidates(spark, sf)
    t = C.token_counts(i)
    s = C.token_scores(C.token_overlap(p, t, t), True)
    return s.select("q", "t", *(R(c).alias(c) for c in ("functional", "weighted", "copies")), (F.col("q_kinds") - F.col("shared")).alias("missing"), (F.col("t_kinds") - F.col("shared")).alias("extra"))


def _split(items):
    mine = F.pmod(F.regexp_extract("cluster", r"o(\d+)$", 1).cast("long"), F.lit(50)) == 0
    return items.filter(mine), items


@query(f"""WITH {ITEMS}, {COUNTS}, {ADJ}, s AS (SELECT x.cluster AS q, y.cluster AS t FROM tc x JOIN tc y USING (token) WHERE {XWEIGHT} >= 3
UNION SELECT x.cluster, y.cluster FROM ad x JOIN ad y USING (a, b)) SELECT q, count(*) AS targets FROM s GROUP BY 1""")
def cluster_seeds(spark, sf):
    return C.seed_totals(materialise(C.seed_keys(_named(A.items(spark, sf)), 3.0), "seed-keys"))


#: Pairs by seeds of weight 2 or a shared adjacency; those under the functional threshold end here.
FOUND = f"""qs AS (SELECT DISTINCT cluster FROM it WHERE ok % 50 = 0), seeded AS (SELECT x.cluster AS q, y.cluster AS t FROM tc x JOIN tc y USING (token) WHERE x.cluster IN (FROM qs) AND {XWEIGHT} >= 2
UNION SELECT x.cluster, y.cluster FROM ad x JOIN ad y USING (a, b) WHERE x.cluster IN (FROM qs)), kinds AS (SELECT cluster, count(*) AS n FROM tc GROUP BY 1), met AS (SELECT x.cluster AS q, y.cluster AS t, count(*) AS m FROM tc x JOIN tc y USING (token) WHERE x.cluster IN (FROM qs) GROUP BY 1, 2),
cand AS (SELECT q, t FROM seeded JOIN met USING (q, t) JOIN kinds a ON a.cluster = q JOIN kinds b ON b.cluster = t WHERE 2 * m / (a.n + b.n) >= 0.2)"""


@query(f"""WITH {ITEMS}, {COUNTS}, {ADJ}, {FOUND}, {OVERLAP}, {PAIRADJ}, {ORDER}, span AS (SELECT cluster, max(rn) * 1000 + 900 - min(rn) * 1000 + 1 AS n FROM it GROUP BY 1),
sc AS (SELECT q, t, 2 * shared / (qk + tk) AS functional, (2 * low / (2 * high + qw + tw - low - high))::DOUBLE AS weighted, adjacency::DOUBLE AS adjacency, order_score, greatest(1 - (2 * apart + qn - sx + tn - sy) / (2 * greatest(qn, tn, 1)), 0)::DOUBLE AS copies, qk - shared AS missing, tk - shared AS extra, inverted FROM al JOIN aj USING (q, t) JOIN ord USING (q, t)),
rk AS (SELECT *, {SCORE} AS score, row_number() OVER (PARTITION BY q ORDER BY round({SCORE}, 9) DESC, t) AS "rank" FROM sc)
SELECT q, t, "rank", round(functional, 6) AS functional, round(weighted, 6) AS weighted, round(adjacency, 6) AS adjacency, round(order_score, 6) AS order_score, round(copies, 6) AS copies, round(round(score, 9), 6) AS score, missing, extra, inverted, v.n * 2 < u.n AS split
FROM rk JOIN span u ON u.cluster = q JOIN span v ON v.cluster = t WHERE "rank" <= 5""")
def cluster_search(spark, sf):
    mine, all_ = _split(_items(spark, sf))
    out = C.search(mine, all_, 0.2, 0.0, 5)
    out = out.withColumn("score", F.round("score", 9))
    return out.select("q", "t", "rank", *(R(c).alias(c) for c in ("functional", "weighted", "adjacency", "order_score", "copies", "score")), "missing", "extra", "inverted", "split")


@query(f"""WITH {ITEMS}, {COUNTS}, {ADJ}, {CAND}, {OVERLAP}, {PAIRADJ}, {ORDER},
sc AS (SELECT q, t, shared / (qk + tk - shared) AS functional, (low / (qw + tw - low))::DOUBLE AS weighted, adjacency::DOUBLE AS adjacency, order_score, greatest(1 - (apart + qn - sx + tn - sy) / (2 * greatest(qn + tn, 1)), 0)::DOUBLE AS copies, inverted FROM al JOIN aj USING (q, t) JOIN ord USING (q, t))
SELECT q, t, round(functional, 6) AS functional, round(weighted, 6) AS weighted, round(adjacency, 6) AS adjacency, round(order_score, 6) AS order_score, round(copies, 6) AS copies, round({SCORE}, 6) AS score, inverted FROM sc""")
def cluster_score_pair(spark, sf):
    i, p = _candidates(spark, sf)
    out = C.score_pairs(p, i, i)
    return out.select("q", "t", *(R(c).alias(c) for c in ("functional", "weighted", "adjacency", "order_score", "copies", "score")), "inverted")


def _hits(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("query"), F.col("l_partkey").alias("target"), F.col("l_extendedprice").alias("bits"), F.col("l_discount").alias("pident"), F.col("l_quantity").alias("alnlen"), F.col("l_suppkey").alias("sk"), "l_linenumber")


@query("""SELECT query, target, bits, pident, alnlen FROM (SELECT l_orderkey AS query, l_partkey AS target, l_extendedprice AS bits, l_discount AS pident, l_quantity AS alnlen,
row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_discount DESC, l_quantity DESC, l_partkey DESC) AS r FROM lineitem) WHERE r = 1""")
def best_hit(spark, sf):
    return V.best_hits(_hits(spark, sf).select("query", "target", "bits", "pident", "alnlen"), "query", ["bits", "pident", "alnlen", "target"])


@query("""WITH b AS (SELECT l_orderkey, max(l_extendedprice) AS bits FROM lineitem GROUP BY 1) SELECT cut, count(*) AS hits FROM b, (VALUES (20000.0::DOUBLE), (40000.0::DOUBLE), (60000.0::DOUBLE)) c(cut) WHERE bits >= cut GROUP BY 1""")
def threshold_counts(spark, sf):
    best = V.best_hits(_hits(spark, sf).select("query", "bits"), "query", ["bits"])
    return V.threshold_counts(best, "bits", [20000, 40000, 60000])


@query("""WITH h AS (SELECT s_nationkey AS qc, p_brand AS tc, l_suppkey AS q, l_partkey AS t, max(l_extendedprice) AS bits FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY 1, 2, 3, 4)
SELECT qc, tc, round(max(bits), 4) AS top, round(sum(bits), 2) AS total, round(sum(bits) / sqrt(max(nq.n) * max(nt.n)), 6) AS scaled FROM h JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) nq ON s_nationkey = qc
JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) nt ON p_brand = tc GROUP BY 1, 2""")
def cluster_bits(spark, sf):
    """Suppliers are grouped by nation and parts by brand."""
    sized = lambda t, key, group, c, n: t.select(F.col(key), F.col(group).alias(c)).withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(c)))
    q = sized(A.table(spark, sf, "supplier"), "s_suppkey", "s_nationkey", "qc", "nq").withColumnRenamed("s_suppkey", "sk")
    t = sized(A.table(spark, sf, "part"), "p_partkey", "p_brand", "tc", "nt").withColumnRenamed("p_partkey", "target")
    h = _hits(spark, sf).join(q, "sk").join(t, "target").select("qc", "tc", F.col("sk").alias("query"), "target", "bits", "nq", "nt")
    return V.cluster_bits(h).select("qc", "tc", F.round("top", 4).alias("top"), F.round("total", 2).alias("total"), R("scaled").alias("scaled"))


@query("""SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75,
round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, count(value) AS n FROM events GROUP BY 1""")
def percentile_summary(spark, sf):
    p = V.percentiles(A.table(spark, sf, "events"), "value", by=["event_type"])
    return p.select("event_type", *(R(c).alias(c) for c in p.columns if c[0] == "p"), "n")


TERMS = "tm AS (SELECT DISTINCT o_custkey AS doc, l_partkey AS term FROM lineitem JOIN orders ON o_orderkey = l_orderkey)"


def _terms(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("doc"))
    return A.table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("term")).join(o, "l_orderkey").select("doc", "term").distinct()


@query(f"WITH {TERMS} SELECT term, count(*) AS df, round(ln((1 + (SELECT count(DISTINCT doc) FROM tm)) / (1 + count(*))) + 1, 6) AS idf FROM tm GROUP BY 1")
def idf_weights(spark, sf):
    return V.idf(_terms(spark, sf), "doc", "term").withColumn("idf", R("idf"))


@query(f"""WITH {TERMS}, w AS (SELECT term, ln((1 + (SELECT count(DISTINCT doc) FROM tm)) / (1 + count(*))) + 1 AS idf FROM tm GROUP BY 1), v AS (SELECT doc, term, idf FROM tm JOIN w USING (term)), n AS (SELECT doc, sqrt(sum(idf * idf)) AS norm FROM v GROUP BY 1),
d AS (SELECT a.doc AS a, b.doc AS b, sum(a.idf * b.idf) AS dot FROM v a JOIN v b USING (term) WHERE a.doc < b.doc GROUP BY 1, 2) SELECT a, b, round(dot / (x.norm * y.norm), 6) AS cosine FROM d JOIN n x ON x.doc = a JOIN n y ON y.doc = b WHERE dot / (x.norm * y.norm) >= 0.1""")
def idf_cosine(spark, sf):
    return V.cosine_above(_terms(spark, sf), "doc", "term", 0.1).withColumn("cosine", R("cosine"))


@query("""WITH h AS (SELECT l_orderkey AS q, l_returnflag AS flag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey, l_suppkey, l_linenumber) AS rank, l_linenumber = 1 AS good FROM lineitem),
t AS (SELECT q, min(flag) AS lev, min(rank) FILTER (good) AS truth_rank FROM h GROUP BY 1)
SELECT coalesce(lev, 'ALL') AS level, count(*) AS queries, round(avg(CASE WHEN truth_rank <= 1 THEN 1 ELSE 0 END), 6) AS top1, round(avg(CASE WHEN truth_rank <= 5 THEN 1 ELSE 0 END), 6) AS top5 FROM t GROUP BY GROUPING SETS ((lev), ())""")
def topk_accuracy_rollup(spark, sf):
    from pyspark.sql import Window

    li = A.table(spark, sf, "lineitem")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey", "l_suppkey", "l_linenumber"))
    h = li.select(F.col("l_orderkey").alias("q"), F.col("l_returnflag").alias("flag"), rank.alias("rank"), (F.col("l_linenumber") == 1).alias("good"))
    t = h.groupBy("q").agg(F.min("flag").alias("lev"), F.min(F.when(F.col("good"), F.col("rank"))).alias("truth_rank"))
    return V.accuracy(t, "lev").select("level", "queries", R("top1").alias("top1"), R("top5").alias("top5"))


@query("""WITH v AS (SELECT l_orderkey AS src, l_returnflag AS cl, sum(l_quantity * (l_linenumber + 1)) AS votes FROM lineitem GROUP BY 1, 2) SELECT src, max_by(cl, (votes, cl)) AS winner, max(votes) AS votes, count(*) AS clusters FROM v GROUP BY 1""")
def consensus_vote(spark, sf):
    li = A.table(spark, sf, "lineitem").withColumnsRenamed({"l_orderkey": "src", "l_returnflag": "cl"})
    return V.consensus(li, "src", "cl", "l_quantity", "l_linenumber")


@query("WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT round(avg(m), 6) AS mean, count(*) AS groups FROM m")
def mean_of_means(spark, sf):
    return V.mean_of_means(A.table(spark, sf, "events"), "user_id", F.col("value")).withColumn("mean", R("mean"))


@query("""WITH r AS (SELECT event_type = 'purchase' OR event_type = 'click' AS t, value > 50 AS f, value AS e FROM events), l AS (SELECT list_sort(list(e) FILTER (t AND f)) AS e FROM r)
SELECT round(avg(f::INT) FILTER (t), 6) AS sensitivity, round(avg((NOT f)::INT) FILTER (NOT t), 6) AS specificity, round(avg(f::INT) FILTER (NOT t), 6) AS fpr, round((SELECT e[len(e) // 2 + 1] FROM l), 6) AS median_error FROM r""")
def detection_rates(spark, sf):
    r = A.table(spark, sf, "events").select(F.col("event_type").isin("purchase", "click").alias("t"), (F.col("value") > 50).alias("f"), F.col("value").alias("e"))
    return V.detection(r, "t", "f", "e").select(*(R(c).alias(c) for c in ("sensitivity", "specificity", "fpr", "median_error")))


def _spans(spark, sf):
    e = A.table(spark, sf, "events")
    return e.select("user_id", "event_id", "event_type", F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long").alias("s"))


@query("""WITH e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS s FROM events), l AS (SELECT user_id, event_id AS id, s AS s1, s + 7200 AS e1 FROM e WHERE event_type = 'click'), r AS (SELECT user_id, event_id AS gene_id, s - 1800 AS s2, s + 1800 AS e2 FROM e WHERE event_type <> 'click')
SELECT user_id, id, max_by(gene_id, (least(e1, e2) - greatest(s1, s2) + 1, gene_id)) AS gene_id, max(least(e1, e2) - greatest(s1, s2) + 1) AS overlap FROM l JOIN r USING (user_id) WHERE s1 <= e2 AND s2 <= e1 GROUP BY 1, 2""")
def interval_overlap_best(spark, sf):
    e = _spans(spark, sf)
    left = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("s").alias("s1"), (F.col("s") + 7200).alias("e1"))
    right = e.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("gene_id"), (F.col("s") - 1800).alias("s2"), (F.col("s") + 1800).alias("e2"))
    return V.overlap_best(left, right, ["user_id"])


@query("""WITH e AS (SELECT user_id, event_id, event_type, floor(epoch(ts))::BIGINT AS s FROM events), i AS (SELECT user_id, event_id AS id, s, s + 60 AS e FROM e WHERE event_type = 'click'), o AS (SELECT user_id, event_id AS region, s - 3600 AS rs, s + 3600 AS re FROM e WHERE event_type <> 'click')
SELECT user_id, id, min_by(region, (rs, region)) AS region FROM i JOIN o USING (user_id) WHERE s >= rs AND e <= re GROUP BY 1, 2""")
def containment_first(spark, sf):
    e = _spans(spark, sf)
    inner = e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("id"), F.col("s").alias("start"), (F.col("s") + 60).alias("end"))
    outer = e.filter("event_type <> 'click'").select("user_id", F.col("event_id").alias("region"), (F.col("s") - 3600).alias("rs"), (F.col("s") + 3600).alias("re"))
    return V.containment_first(inner, outer, "user_id", 7200)


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS r, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), g AS (SELECT DISTINCT o_custkey, CASE WHEN least(n, 4) <= 1 THEN 0 ELSE floor(i * (n - 1) / (least(n, 4) - 1) + 0.5) END AS r FROM (SELECT DISTINCT o_custkey, n FROM r), unnest(range(0, least(n, 4))) t(i))
SELECT o_custkey, o_orderkey FROM r JOIN g USING (o_custkey, r)""")
def evenly_spaced(spark, sf):
    return V.evenly_spaced(A.table(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], ["o_orderkey"], 4)


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC, o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r = 1""")
def pick_best(spark, sf):
    o = A.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")
    return V.pick_best(o, ["o_custkey"], [F.desc("o_orderpriority"), F.desc("o_totalprice"), F.asc("o_orderkey")]).drop("o_orderpriority")


CONTIGS = f"""contigs AS (SELECT source AS genome, doc_id AS contig_id, regexp_replace(translate(text, '{A.LETTERS}', '{A.BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents)"""


@query(f"""WITH {CONTIGS}, f AS (SELECT genome, contig_id, size, i AS piece, substr(seq, i * size + 1, size) AS s FROM (SELECT *, unnest([1000, 5000]) AS size FROM contigs), unnest(range(0, (length(seq) - 1) // size + 1)) t(i) WHERE length(seq) >= size)
SELECT genome, contig_id, size::INTEGER AS size, piece, length(s)::INTEGER AS n, md5(s) AS digest FROM f WHERE length(s) >= 100""")
def fragments(spark, sf):
    f = V.fragments(A.contigs(spark, sf), [1000, 5000])
    return f.select("genome", "contig_id", "size", F.col("piece").cast("long").alias("piece"), F.length("seq").alias("n"), F.md5(F.col("seq").cast("binary")).alias("digest"))


@query(f"""WITH {CONTIGS}, p AS (SELECT genome, contig_id, seq, coalesce(sum(length(seq)) OVER (PARTITION BY genome ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM contigs),
m AS (SELECT *, off + 50 AS s, off + 450 AS e FROM p) SELECT genome, contig_id, md5(substr(seq, 51, least(400, length(seq) - 50))) AS digest FROM m WHERE length(seq) > 50""")
def recut_fragments(spark, sf):
    from ..operators.series import contig_offsets

    c = A.contigs(spark, sf)
    off = contig_offsets(c.select("genome", "contig_id", "length"))
    whole = c.join(off.select("genome", "contig_id", "offset"), ["genome", "contig_id"]).withColumnRenamed("contig_id", "name")
    manifest = off.select("genome", F.col("contig_id").alias("name"), (F.col("offset") + 50).alias("start"), (F.col("offset") + 450).alias("end"))
    return V.recut(manifest, whole.select("genome", "name", "offset", "seq")).select("genome", F.col("name").alias("contig_id"), F.md5(F.col("fragment").cast("binary")).alias("digest"))


@query("""WITH v AS (SELECT l_orderkey, count(*) AS n, sum((l_returnflag = 'R')::INT) > 1 AS r FROM lineitem GROUP BY 1) SELECT k::INTEGER AS least, count(*) AS anchored, count(*) FILTER (r) AS reversed FROM v, unnest(range(1, 51)) t(k) WHERE n >= k GROUP BY 1""")
def min_tags_sweep(spark, sf):
    v = A.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), (F.count_if(F.col("l_returnflag") == "R") > 1).alias("r"))
    return V.sweep(v, "n", range(1, 51), {"reversed": F.col("r")})


def _two_scores(spark, sf):
    li = A.table(spark, sf, "lineitem")
    a = li.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("t")).agg(F.max("l_quantity").alias("s"))
    b = li.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("t")).agg(F.max("l_tax").alias("s")).filter("s > 0.03")
    return a, b


@query("""WITH a AS (SELECT l_orderkey AS q, l_partkey AS t, max(l_quantity) AS s FROM lineitem GROUP BY 1, 2), b AS (SELECT l_orderkey AS q, l_partkey AS t, max(l_tax) AS s FROM lineitem GROUP BY 1, 2 HAVING max(l_tax) > 0.03),
p AS (SELECT q, t, 0.7 * s / max(s) OVER (PARTITION BY q) AS p FROM a UNION ALL SELECT q, t, 0.3 * s / max(s) OVER (PARTITION BY q) FROM b), e AS (SELECT q, t, sum(p) AS score FROM p GROUP BY 1, 2)
SELECT q, t % 10 AS label, round(max(score), 6) AS score FROM e GROUP BY 1, 2""")
def ensemble_labels(spark, sf):
    a, b = _two_scores(spark, sf)
    e = V.ensemble([(a, 0.7), (b, 0.3)], "q", "t", "s").withColumn("label", F.col("t") % 10)
    return V.collapse_to_label(e, "q", "label").select("q", "label", R("score").alias("score"))


@query("""WITH a AS (SELECT l_orderkey AS q, max(l_partkey) AS t FROM lineitem WHERE l_quantity > 45 GROUP BY 1), b AS (SELECT l_orderkey AS q, min(l_suppkey) AS t FROM lineitem GROUP BY 1)
SELECT q, coalesce(a.t, b.t) AS t, CASE WHEN a.t IS NOT NULL THEN 'tokens' ELSE 'proteins' END AS "by" FROM a FULL JOIN b USING (q)""")
def rescue(spark, sf):
    li = A.table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "q")
    a = li.filter("l_quantity > 45").groupBy("q").agg(F.max("l_partkey").alias("t"))
    return V.rescue(a, li.groupBy("q").agg(F.min("l_suppkey").alias("t")), "q", "t")


@query("""WITH p AS (SELECT l_suppkey AS q, l_partkey % 100 AS t, l_quantity AS bits, l_tax AS tok FROM lineitem) SELECT q, t, sum(bits) AS sum_bits, round(avg(bits), 6) AS mean_bits, max(tok) AS tokens, round(ln(1 + sum(bits)), 6) AS log_bits, round(ln(1 + sum(bits)) + 10 * max(tok), 6) AS fused FROM p GROUP BY 1, 2""")
def score_fusions(spark, sf):
    p = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("q"), (F.col("l_partkey") % 100).alias("t"), F.col("l_quantity").alias("bits"), F.col("l_tax").alias("tokens"))
    return V.fusions(p).select("q", "t", "sum_bits", R("mean_bits").alias("mean_bits"), "tokens", R("log_bits").alias("log_bits"), R("fused").alias("fused"))


@query("""WITH f AS (SELECT sha256(text) AS d, min(doc_id) AS first_id FROM documents GROUP BY 1) SELECT doc_id, first_id FROM documents LEFT JOIN f ON d = sha256(text)""")
def digest_join(spark, sf):
    d = A.table(spark, sf, "documents").select("doc_id", "text")
    return V.by_digest(d, d.withColumnRenamed("doc_id", "first_id"), "text", "first_id").select("doc_id", "first_id")


@query("""SELECT s_suppkey, CASE WHEN s_name LIKE '%3' THEN coalesce(n_name, '') ELSE s_name END AS s_name FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey""")
def fill_blank(spark, sf):
    s = A.table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").alias("k"), F.when(F.col("s_name").endswith("3"), "").otherwise(F.col("s_name")).alias("s_name"))
    n = A.table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("s_name"))
    return V.fill_blank(s, n, "k", ["s_name"]).select("s_suppkey", "s_name")


@query("""SELECT c_custkey FROM customer ORDER BY sha256('s' || c_custkey), c_custkey LIMIT 40""")
def hash_sample(spark, sf):
    return V.hash_sample(A.table(spark, sf, "customer").select("c_custkey"), "c_custkey", 40, "s")


@query("""SELECT o_custkey, count(*) AS orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1""")
def held_out_split(spark, sf):
    held = A.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return V.split_held_out(A.table(spark, sf, "orders").select("o_custkey"), held, "o_custkey")[1].groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"))


@query("""SELECT query, reference, bases, row_number() OVER (PARTITION BY query ORDER BY bases DESC, reference)::INTEGER AS rank FROM (SELECT l_suppkey AS query, substr(l_shipdate::DATE::VARCHAR, 1, 7) AS reference, sum(l_quantity) AS bases FROM lineitem GROUP BY 1, 2)""")
def alignment_totals(spark, sf):
    li = A.table(spark, sf, "lineitem")
    return V.alignment_totals(li.select(F.col("l_suppkey").alias("query"), F.substring(F.col("l_shipdate").cast("date").cast("string"), 1, 7).alias("reference"), F.col("l_quantity").alias("block")))


@query("""SELECT c_custkey, CASE WHEN trim(c_mktsegment) IN ('-', '-1') THEN '-' ELSE '+' END AS strand, regexp_replace(trim(c_name || ', ,,'), ',+$', '') AS name, round(least(greatest(0.15 * 0.5 + 0.30 * 0.25 + 0.30 * (c_custkey % 10) / 10.0 + 0.10 + 0.10 * 0.5 + 0.05, 0), 1), 6) AS score,
CASE WHEN 0.15 * 0.5 + 0.30 * 0.25 + 0.30 * (c_custkey % 10) / 10.0 + 0.10 + 0.10 * 0.5 + 0.05 >= 0.65 THEN 'medium' WHEN 0.15 * 0.5 + 0.30 * 0.25 + 0.30 * (c_custkey % 10) / 10.0 + 0.10 + 0.10 * 0.5 + 0.05 >= 0.5 THEN 'low' ELSE 'exploratory' END AS confidence FROM customer""")
def placement_scores(spark, sf):
    f = lambda x: F.lit(float(x))
    s = placement_score(f(0.5), f(0.25), F.col("c_custkey") % 10 / 10.0, f(1), f(0.5), f(1))
    length = F.lit(parse_size("50kb"))
    return A.table(spark, sf, "customer").select("c_custkey", strand(F.col("c_mktsegment")).alias("strand"), clean_field(F.concat("c_name", F.lit(", ,,"))).alias("name0"), "c_name", s.alias("s")).select(
        "c_custkey", "strand", F.col("name0").alias("name"), R("s").alias("score"), confidence(F.col("s"), F.lit(3), F.lit(1), length).alias("confidence")
    )


@query("""WITH RECURSIVE e AS (SELECT user_id, event_type = 'click' AS found, floor(epoch(ts))::BIGINT AS s, row_number() OVER (PARTITION BY user_id, event_type = 'click' ORDER BY ts) AS n FROM events),
n AS (SELECT user_id, count(*) FILTER (found) AS f, count(*) FILTER (NOT found) AS t FROM e GROUP BY 1),
near AS (SELECT a.user_id, a.n AS x, b.n AS y, abs(a.s - b.s) AS d, row_number() OVER (PARTITION BY a.user_id ORDER BY abs(a.s - b.s), a.n, b.n) AS i FROM e a JOIN e b ON a.user_id = b.user_id AND a.found AND NOT b.found AND abs(a.s - b.s) <= 3600),
m AS (SELECT user_id, 0::BIGINT AS i, []::BIGINT[] AS xs, []::BIGINT[] AS ys, 0::BIGINT AS err FROM n
UNION ALL SELECT m.user_id, near.i, CASE WHEN ok THEN list_append(xs, x) ELSE xs END, CASE WHEN ok THEN list_append(ys, y) ELSE ys END, err + CASE WHEN ok THEN d ELSE 0 END FROM m JOIN near ON near.user_id = m.user_id AND near.i = m.i + 1, LATERAL (SELECT NOT list_contains(xs, x) AND NOT list_contains(ys, y) AS ok)),
done AS (SELECT user_id, max(len(xs)) AS matched, max_by(err, i) AS err FROM m GROUP BY 1)
SELECT user_id, matched::BIGINT AS matched, f - matched AS false_pos, t - matched AS missed, err::DOUBLE AS error FROM n JOIN done USING (user_id)""")
def greedy_matches(spark, sf):
    e = _spans(spark, sf)
    a, b = e.filter("event_type = 'click'"), e.filter("event_type <> 'click'")
    return V.greedy_matches(a.select("user_id", F.col("s").alias("pos")), b.select("user_id", F.col("s").alias("pos")), "user_id", 3600)


@query(f"""WITH {ITEMS}, {CAND}, rp AS (SELECT cluster, list(tokens[1] ORDER BY rn) AS reps FROM tok WHERE tokens[1] IS NOT NULL GROUP BY 1), p AS (SELECT q, t, x.reps AS a, y.reps AS b FROM cand JOIN rp x ON x.cluster = q JOIN rp y ON y.cluster = t)
SELECT q, t, {_lcs('a', 'b')} AS lcs FROM p""")
def lcs_lengths(spark, sf):
    i, p = _candidates(spark, sf)
    reps = materialise(C.cluster_table(i).select("cluster", "reps"), "reps")
    side = lambda c: reps.select(F.col("cluster").alias(c), F.col("reps").alias(f"{c}_reps"))
    return V.lcs_lengths(p.join(side("q"), "q").join(side("t"), "t"), "q_reps", "t_reps").select("q", "t", "lcs")
