"""Registered queries on landmark series."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.scalar import gc_content, is_palindromic, mash_distance, revcomp, stable_hash, valid_dna
from ..operators import graph, placement, series, structure
from ..operators.catalog import ENZYMES
from ..operators.digest import digest_native
from ..operators.sketch import sketch, splitmix64_native
from ..session import exists, fingerprint, materialise, shared_dir
from ..sources import files, streams
from . import adapters as A
from .registry import query

R = lambda c: F.round(c, 6)


#: Each document three times: as it is, with its middle third turned round, and with every 61st base an A.
BUILT = f"""plain AS (SELECT doc_id AS contig_id, regexp_replace(translate(text, '{A.LETTERS}', '{A.BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents),
contigs AS (SELECT 'a_plain' AS genome, contig_id, seq FROM plain UNION ALL SELECT 'b_turned', contig_id, substr(seq, 1, length(seq) // 3) || reverse(translate(substr(seq, length(seq) // 3 + 1, length(seq) // 3), 'ACGT', 'TGCA')) || substr(seq, 2 * (length(seq) // 3) + 1) FROM plain
UNION ALL SELECT 'c_changed', contig_id, regexp_replace(seq, '([ACGT]{{60}})[ACGT]', '\\1A', 'g') FROM plain)"""


def _contigs(genome: str = "source") -> str:
    own = BUILT if genome == A.BUILT else f"""contigs AS (SELECT {genome} AS genome, doc_id AS contig_id,
  regexp_replace(translate(text, '{A.LETTERS}', '{A.BASES}'), '[^ACGT]', '', 'g') AS seq FROM documents)"""
    return f"""{own},
placed AS (SELECT genome, contig_id, length(seq) AS length,
  coalesce(sum(length(seq)) OVER (PARTITION BY genome ORDER BY contig_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM contigs)"""


def marks(enzyme: str = A.DENSE, genome: str = "source") -> str:
    e = ENZYMES[enzyme]
    either = "|".join(f"({p})" for _, p in e.patterns)
    return f"""{_contigs(genome)},
raw AS (SELECT genome, contig_id, p AS pos, substr(seq, p + 1, {e.length}) AS seq FROM contigs, unnest(range(0, greatest(length(seq) - {e.length} + 1, 0))) t(p)),
marks AS (SELECT r.genome, r.contig_id, r.pos::BIGINT AS pos, r.seq, CASE WHEN regexp_full_match(r.seq, '{e.forward}') THEN '+' ELSE '-' END AS strand,
  (r.pos + off)::BIGINT AS gpos, least(r.seq, reverse(translate(r.seq, 'ACGT', 'TGCA'))) AS canon, reverse(translate(r.seq, 'ACGT', 'TGCA')) < r.seq AS rc,
  reverse(translate(r.seq, 'ACGT', 'TGCA')) = r.seq AS pal
  FROM raw r JOIN placed USING (genome, contig_id) WHERE regexp_full_match(r.seq, '{either}'))"""


PAIRS = """nxt AS (SELECT genome, seq, lead(seq) OVER (PARTITION BY genome ORDER BY contig_id, pos) AS n FROM marks),
pairs AS (SELECT DISTINCT genome, least(seq, n) AS k1, greatest(seq, n) AS k2 FROM nxt WHERE n IS NOT NULL)"""
JACCARD = """size AS (SELECT genome, count(*) AS n FROM pairs GROUP BY 1),
meet AS (SELECT a.genome AS ga, b.genome AS gb, count(*) AS m FROM pairs a JOIN pairs b USING (k1, k2) WHERE a.genome < b.genome GROUP BY 1, 2)"""
LAST = """lastp AS (SELECT genome, seq, max(gpos) AS gpos, max_by(strand, gpos) AS strand FROM marks GROUP BY 1, 2)"""
POSITIONS = f"""{LAST}, pp AS (SELECT a.genome AS ga, b.genome AS gb, a.gpos AS pa, b.gpos AS pb FROM marks a JOIN lastp b USING (seq) WHERE a.genome < b.genome)"""
CORR = "coalesce(CASE WHEN isnan(abs(corr(pa, pb))) THEN 0 ELSE abs(corr(pa, pb)) END, 0)"


@query(f"WITH {marks()} SELECT genome, contig_id, pos, seq, strand FROM marks")
def digest_degenerate(spark, sf):
    return A.landmarks(spark, sf).select("genome", "contig_id", "pos", "seq", "strand")


@query(f"WITH {marks(A.SPARSE)} SELECT genome, contig_id, pos, seq, strand FROM marks")
def digest_bcgi(spark, sf):
    return digest_native(A.contigs(spark, sf), ENZYMES[A.SPARSE]).select("genome", "contig_id", "pos", "seq", "strand")


@query(f"""WITH {marks()} SELECT genome, count(*) AS tags, count(DISTINCT canon) AS identities, count(*) FILTER (rc) AS reversed, count(*) FILTER (pal) AS palindromes,
round(avg(CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) END), 6) AS gc FROM marks GROUP BY 1""")
def canonical_stats(spark, sf):
    m = series.oriented(A.landmarks(spark, sf))
    return m.groupBy("genome").agg(
        F.count(F.lit(1)).alias("tags"), F.countDistinct("canon").alias("identities"), F.count_if("rc").alias("reversed"), F.count_if("pal").alias("palindromes"), R(F.avg(gc_content(F.col("seq")))).alias("gc")
    )


@query(f"""WITH {_contigs()} SELECT genome, contig_id, sha256(reverse(translate(seq, 'ACGT', 'TGCA'))) AS rc, round(length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq), 6) AS gc,
reverse(translate(seq, 'ACGT', 'TGCA')) = seq AS pal, true AS valid, ('0x' || substr(sha256(seq), 1, 12))::BIGINT AS h, round(greatest(0, -ln(2 * 0.5 / 1.5) / length(seq)), 6) AS mash FROM contigs WHERE length(seq) >= 4""")
def scalar_functions_whole(spark, sf):
    """The functions on whole sequences, a row for each contig; the reverse complement as its digest."""
    s = F.col("seq")
    k = A.contigs(spark, sf).filter("length >= 4")
    return k.select("genome", "contig_id", F.sha2(revcomp(s).cast("binary"), 256).alias("rc"), R(gc_content(s)).alias("gc"), is_palindromic(s).alias("pal"), valid_dna(s).alias("valid"), stable_hash(s).alias("h"), R(mash_distance(F.lit(0.5), 1) / F.length(s)).alias("mash"))


@query(f"""WITH {marks()}, g AS (SELECT genome, CASE WHEN step IS NOT NULL THEN greatest(step, 0) END AS gap FROM (SELECT genome, gpos - lag(gpos) OVER (PARTITION BY genome ORDER BY contig_id, pos) AS step FROM marks))
SELECT genome, count(*) AS tags, 1::BIGINT AS enzymes, round(coalesce(avg(gap), 0), 6) AS mean_gap, round(coalesce(quantile_cont(gap, 0.5), 0), 6) AS median_gap, coalesce(max(gap), 0)::BIGINT AS max_gap FROM g GROUP BY 1""")
def gap_stats(spark, sf):
    g = series.gap_stats(A.landmarks(spark, sf))
    return g.withColumns({"mean_gap": R("mean_gap"), "median_gap": R("median_gap")})


@query(f"""WITH {marks()}, n AS (SELECT genome, count(*) AS tags FROM marks GROUP BY 1), l AS (SELECT genome, sum(length) AS length FROM placed GROUP BY 1)
SELECT genome, round(32 * coalesce(tags, 0) / length, 6) AS coverage FROM l LEFT JOIN n USING (genome)""")
def coverage_fraction(spark, sf):
    return series.coverage(A.landmarks(spark, sf), A.lengths(spark, sf)).withColumn("coverage", R("coverage"))


@query(f"""WITH {marks()}, s AS (SELECT genome, length, sum(length) OVER (PARTITION BY genome ORDER BY length DESC) AS so_far, sum(length) OVER (PARTITION BY genome) AS total FROM placed),
n AS (SELECT genome, max(length) FILTER (so_far * 2 >= total) AS n50, count(*) AS contigs, max(total)::BIGINT AS length FROM s GROUP BY 1), t AS (SELECT genome, count(*) AS tags, count(DISTINCT canon) AS identities FROM marks GROUP BY 1)
SELECT genome, contigs, length, n50, tags, identities FROM n JOIN t USING (genome)""")
def index_stats(spark, sf):
    return series.index_stats(A.landmarks(spark, sf), A.contigs(spark, sf).select("genome", "contig_id", "length"))


@query(f"""WITH {marks()}, l AS (SELECT genome, sum(length)::BIGINT AS length FROM placed GROUP BY 1), grid AS (SELECT genome, b::INTEGER AS bin, greatest((length + 49) // 50, 1) AS width FROM l, unnest(range(0, 50)) t(b)),
c AS (SELECT m.genome, least(gpos // greatest((length + 49) // 50, 1), 49)::INTEGER AS bin, count(*) AS tags FROM marks m JOIN l USING (genome) GROUP BY 1, 2)
SELECT genome, bin, coalesce(tags, 0) AS tags FROM grid LEFT JOIN c USING (genome, bin)""")
def landmark_density_bins(spark, sf):
    return series.density_bins(A.landmarks(spark, sf), A.lengths(spark, sf), 50)


@query(f"""WITH {marks()}, f AS (SELECT *, CASE WHEN pos - lag(pos) OVER w < 40 THEN 0 ELSE 1 END AS new FROM marks WINDOW w AS (PARTITION BY genome, contig_id ORDER BY pos, canon)),
r AS (SELECT *, sum(new) OVER (PARTITION BY genome, contig_id ORDER BY pos, canon) AS run FROM f)
SELECT genome, contig_id, min_by(pos, (canon, pos)) AS pos, min(canon) AS canon, count(*) AS members FROM r GROUP BY genome, contig_id, run""")
def run_collapse(spark, sf):
    return series.collapse_runs(series.oriented(A.landmarks(spark, sf)), ["genome"]).select("genome", "contig_id", "pos", "canon", "members")


@query(f"""WITH {marks()} SELECT genome, copies, count(*) AS identities FROM (SELECT genome, canon, count(*) AS copies FROM marks GROUP BY 1, 2) GROUP BY 1, 2""")
def multiplicity(spark, sf):
    return series.multiplicity(A.landmarks(spark, sf)).groupBy("genome", "copies").agg(F.count(F.lit(1)).alias("identities"))


@query(f"""WITH {marks()}, u AS (SELECT genome, canon FROM marks GROUP BY 1, 2 HAVING count(*) = 1)
SELECT a.genome AS ga, b.genome AS gb, count(*) AS shared FROM u a JOIN u b USING (canon) WHERE a.genome < b.genome GROUP BY 1, 2 HAVING count(*) >= 2""")
def unique_shared_landmarks(spark, sf):
    s = structure.shared_landmarks(A.landmarks(spark, sf)).filter("side = 'a'")
    return s.groupBy("ga", "gb").agg(F.count(F.lit(1)).alias("shared"))


@query(f"""WITH {marks()}, {PAIRS}, {JACCARD} SELECT ga, gb, m AS "both", x.n AS na, y.n AS nb, round(m / (x.n + y.n - m), 6) AS jaccard FROM meet JOIN size x ON x.genome = ga JOIN size y ON y.genome = gb""")
def adjacency_jaccard(spark, sf):
    return structure.adjacency_jaccard(A.landmarks(spark, sf)).withColumn("jaccard", R("jaccard")).select("ga", "gb", "both", "na", "nb", "jaccard")


@query(f"""WITH {marks()}, {LAST}, nxt AS (SELECT genome, seq, lead(seq) OVER (PARTITION BY genome ORDER BY gpos, seq) AS n FROM lastp), pairs AS (SELECT DISTINCT genome, least(seq, n) AS k1, greatest(seq, n) AS k2 FROM nxt WHERE n IS NOT NULL), {JACCARD}
SELECT ga, gb, round(m / (x.n + y.n - m), 6) AS synteny FROM meet JOIN size x ON x.genome = ga JOIN size y ON y.genome = gb""")
def synteny_matrix(spark, sf):
    return structure.synteny_matrix(A.landmarks(spark, sf)).select("ga", "gb", R("synteny").alias("synteny"))


def _structure(enzyme: str = A.DENSE, genome: str = "source") -> str:
    return f"""WITH {marks(enzyme, genome)},
u AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY genome, canon) AS copies FROM marks) WHERE copies = 1),
met AS (SELECT a.genome AS ga, b.genome AS gb, canon FROM u a JOIN u b USING (canon) WHERE a.genome < b.genome),
few AS (SELECT ga, gb FROM met GROUP BY 1, 2 HAVING count(*) >= 2),
shared AS (SELECT ga, gb, s.side, u.contig_id, u.pos, u.canon, u.rc, u.pal FROM met JOIN few USING (ga, gb), (VALUES ('a'), ('b')) s(side), u WHERE u.genome = CASE WHEN s.side = 'a' THEN ga ELSE gb END AND u.canon = met.canon),
f AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY ga, gb, side, contig_id ORDER BY pos, canon) < 40 THEN 0 ELSE 1 END AS new FROM shared),
r AS (SELECT *, sum(new) OVER (PARTITION BY ga, gb, side, contig_id ORDER BY pos, canon) AS run FROM f),
runs AS (SELECT ga, gb, side, contig_id, unnest(min_by({{'pos': pos, 'canon': canon, 'rc': rc, 'pal': pal}}, canon)) FROM r GROUP BY ga, gb, side, contig_id, run),
k0 AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY ga, gb, canon) AS n FROM runs) WHERE n = 2),
kept AS (SELECT * EXCLUDE (n, m) FROM (SELECT *, count(*) OVER (PARTITION BY ga, gb) AS m FROM k0) WHERE m >= 4),
one AS (SELECT ga, gb, count(DISTINCT contig_id) FILTER (side = 'a') = 1 AND count(DISTINCT contig_id) FILTER (side = 'b') = 1 AS closed FROM kept GROUP BY 1, 2),
linked AS (SELECT k.*, closed, lead(canon) OVER w AS nxt, first_value(canon) OVER w AS fst, count(*) OVER (PARTITION BY ga, gb, side, contig_id) AS many FROM kept k JOIN one USING (ga, gb) WINDOW w AS (PARTITION BY ga, gb, side, contig_id ORDER BY pos, canon)),
ap AS (SELECT *, coalesce(nxt, CASE WHEN closed AND many >= 3 THEN fst END) AS partner FROM linked),
adj AS (SELECT ga, gb, least(canon, partner) AS k1, greatest(canon, partner) AS k2, max(pos) FILTER (side = 'a') AS pos_a, max(pos) FILTER (side = 'b') AS pos_b FROM ap WHERE partner IS NOT NULL GROUP BY 1, 2, 3, 4),
ends AS (SELECT ga, gb, unnest([k1, k2]) AS canon, pos_a IS NOT NULL AS in_a, pos_b IS NOT NULL AS in_b FROM adj),
deg AS (SELECT ga, gb, canon, count(*) FILTER (in_b) >= 2 AS ful, count(*) FILTER (in_a) > 0 AND count(*) FILTER (in_b) > 0 AND count(*) FILTER (in_a AND in_b) = 0 AS alone FROM ends GROUP BY 1, 2, 3),
ina AS (SELECT a.*, x.ful OR y.ful AS obs, x.alone OR y.alone AS lone FROM adj a JOIN deg x ON (x.ga, x.gb, x.canon) = (a.ga, a.gb, a.k1) JOIN deg y ON (y.ga, y.gb, y.canon) = (a.ga, a.gb, a.k2) WHERE pos_a IS NOT NULL),
nb AS (SELECT ga, gb, k1 AS x, k2 AS z FROM adj WHERE pos_b IS NOT NULL UNION ALL SELECT ga, gb, k2, k1 FROM adj WHERE pos_b IS NOT NULL),
lonez AS (SELECT n.* FROM nb n JOIN deg d ON (d.ga, d.gb, d.canon) = (n.ga, n.gb, n.z) WHERE d.alone),
split AS (SELECT DISTINCT p.ga, p.gb, p.x AS k1, q.x AS k2 FROM lonez p JOIN lonez q ON (p.ga, p.gb, p.z) = (q.ga, q.gb, q.z) WHERE p.x < q.x),
junctions AS (SELECT i.ga, i.gb, pos_a AS pos FROM ina i ANTI JOIN split USING (ga, gb, k1, k2) WHERE pos_b IS NULL AND obs AND NOT lone)"""


STRUCTURE = _structure()


@query(f"""{STRUCTURE}, c AS (SELECT ga, gb, count(pos_a) AS na, count(pos_b) AS nb, count(*) FILTER (pos_a IS NOT NULL AND pos_b IS NOT NULL) AS conserved, count(*) AS either FROM adj GROUP BY 1, 2),
o AS (SELECT ga, gb, count(*) FILTER (obs) AS observable FROM ina GROUP BY 1, 2), j AS (SELECT ga, gb, count(*) AS breakpoints FROM junctions GROUP BY 1, 2),
m AS (SELECT ga, gb, canon, bool_or(pal) AS pal, count(*) FILTER (rc) = 1 AS flipped FROM kept GROUP BY 1, 2, 3),
t AS (SELECT ga, gb, count(*) AS shared_tags, count(*) FILTER (pal) AS uninformative, count(*) FILTER (NOT pal AND flipped) AS mismatches FROM m GROUP BY 1, 2),
b AS (SELECT ga, gb, count(*) AS before FROM shared GROUP BY 1, 2), e AS (SELECT ga, gb, count(*) AS after FROM runs GROUP BY 1, 2)
SELECT t.ga, t.gb, shared_tags, coalesce(conserved, 0) AS conserved, coalesce(breakpoints, 0) AS breakpoints, coalesce(na, 0) + coalesce(nb, 0) - 2 * coalesce(conserved, 0) AS scj_distance,
round(CASE WHEN coalesce(either, 0) > 0 THEN conserved / either ELSE 0 END, 6) AS score, coalesce(observable, 0) AS observable, mismatches, uninformative,
round(CASE WHEN shared_tags > uninformative THEN least(mismatches, shared_tags - uninformative - mismatches) / (shared_tags - uninformative) ELSE 0 END, 6) AS inverted_fraction, before - after AS landmarks_collapsed
FROM t LEFT JOIN c USING (ga, gb) LEFT JOIN o USING (ga, gb) LEFT JOIN j USING (ga, gb) JOIN b USING (ga, gb) JOIN e USING (ga, gb)""")
def structural_pairs(spark, sf):
    t = structure.structural_pairs(materialise(A.landmarks(spark, sf), "marks"))[0]
    return t.select("ga", "gb", "shared_tags", "conserved", "breakpoints", "scj_distance", R("score").alias("score"), "observable", "mismatches", "uninformative", R("inverted_fraction").alias("inverted_fraction"), "landmarks_collapsed")


@query(f"{STRUCTURE} SELECT ga, gb, pos FROM junctions")
def junctions(spark, sf):
    return structure.structural_pairs(materialise(A.landmarks(spark, sf), "marks"))[1].select("ga", "gb", "pos")


@query(f"{_structure(A.SYMMETRIC, A.BUILT)} SELECT ga, gb, pos FROM junctions")
def junctions_built(spark, sf):
    """Junctions between series of which one is the other with known stretches turned round."""
    return structure.structural_pairs(materialise(A.landmarks(spark, sf, A.SYMMETRIC, A.BUILT), "marks"))[1].select("ga", "gb", "pos")


@query(f"""WITH {marks()}, {PAIRS}, kinds AS (SELECT DISTINCT genome, seq FROM marks), common AS (SELECT a.genome AS ga, b.genome AS gb, seq FROM kinds a JOIN kinds b USING (seq) WHERE a.genome < b.genome),
sides AS (SELECT DISTINCT c.ga, c.gb, p.genome, k1, k2 FROM pairs p JOIN common c ON c.seq = k1 AND p.genome IN (c.ga, c.gb) JOIN common d ON d.seq = k2 AND d.ga = c.ga AND d.gb = c.gb),
odd AS (SELECT ga, gb, count(*) AS odd FROM (SELECT ga, gb FROM sides GROUP BY ga, gb, k1, k2 HAVING count(*) = 1) GROUP BY 1, 2), n AS (SELECT ga, gb, count(*) AS common FROM common GROUP BY 1, 2)
SELECT ga, gb, common, CASE WHEN common >= 2 THEN coalesce(odd, 0) ELSE 0 END AS breakpoints FROM n LEFT JOIN odd USING (ga, gb)""")
def breakpoints_legacy(spark, sf):
    return structure.legacy_breakpoints(A.landmarks(spark, sf))


@query(f"""WITH {marks()}, k AS (SELECT genome, seq, row_number() OVER (PARTITION BY genome ORDER BY contig_id, pos) AS plc FROM marks), l AS (SELECT genome, seq, max(plc) AS ra FROM k GROUP BY 1, 2),
r AS (SELECT l.genome AS ga, k.genome AS gb, ra, k.plc AS rb FROM l JOIN k USING (seq) WHERE l.genome < k.genome), n AS (SELECT ga, gb, count(*) AS common FROM r GROUP BY 1, 2),
i AS (SELECT x.ga, x.gb, count(*) AS inv FROM r x JOIN r y ON x.ga = y.ga AND x.gb = y.gb AND x.rb < y.rb AND x.ra > y.ra GROUP BY 1, 2)
SELECT ga, gb, common, round(CASE WHEN common >= 2 THEN 1 - 2 * coalesce(inv, 0) / (common * (common - 1) / 2) ELSE 0 END, 6) AS tau FROM n LEFT JOIN i USING (ga, gb)""")
def kendall_tau(spark, sf):
    return structure.kendall_tau(A.landmarks(spark, sf)).withColumn("tau", R("tau"))


@query(f"WITH {marks()}, {POSITIONS} SELECT ga, gb, count(*) AS common, round({CORR}, 6) AS correlation FROM pp GROUP BY 1, 2")
def position_corr(spark, sf):
    return structure.position_correlation(A.landmarks(spark, sf)).withColumn("correlation", R("correlation"))


@query(f"""WITH {marks()}, {POSITIONS}, w AS (SELECT *, count(*) OVER (PARTITION BY ga, gb) AS n, row_number() OVER (PARTITION BY ga, gb ORDER BY pa, pb) - 1 AS k FROM pp),
x AS (SELECT *, CASE WHEN n < 10 THEN 0 ELSE least(k // greatest(n // 5, 1), 4) END AS win FROM w), c AS (SELECT ga, gb, win, {CORR} AS c FROM x GROUP BY 1, 2, 3)
SELECT ga, gb, round(max(c), 6) AS correlation FROM c GROUP BY 1, 2""")
def windowed_position_corr(spark, sf):
    return structure.windowed_position_correlation(A.landmarks(spark, sf), 5).withColumn("correlation", R("correlation"))


@query(f"""WITH {marks()}, l AS (SELECT genome, sum(length)::BIGINT AS length FROM placed GROUP BY 1), grid AS (SELECT genome, b AS bin FROM l, unnest(range(0, 50)) t(b)),
c AS (SELECT m.genome, least(gpos // greatest((length + 49) // 50, 1), 49) AS bin, count(*) AS tags FROM marks m JOIN l USING (genome) GROUP BY 1, 2), d AS (SELECT genome, bin, coalesce(tags, 0) AS tags FROM grid LEFT JOIN c USING (genome, bin)),
q AS (SELECT a.genome AS ga, b.genome AS gb, a.tags AS pa, b.tags AS pb FROM d a JOIN d b USING (bin) WHERE a.genome < b.genome) SELECT ga, gb, round({CORR}, 6) AS correlation FROM q GROUP BY 1, 2""")
def density_corr(spark, sf):
    return structure.density_correlation(series.density_bins(A.landmarks(spark, sf), A.lengths(spark, sf), 50)).withColumn("correlation", R("correlation"))


WINDOWS = "s AS (SELECT DISTINCT genome, gpos // 5000 AS w, seq FROM marks), z AS (SELECT genome, w, count(*) AS n FROM s GROUP BY 1, 2), wc AS (SELECT genome, count(*) AS n FROM z GROUP BY 1), mt AS (SELECT a.genome AS ga, b.genome AS gb, count(*) AS met FROM z a JOIN z b USING (w) WHERE a.genome < b.genome GROUP BY 1, 2)"


@query(f"""WITH {marks()}, {WINDOWS}, b AS (SELECT x.genome AS ga, y.genome AS gb, w, count(*) AS m FROM s x JOIN s y USING (w, seq) WHERE x.genome < y.genome GROUP BY 1, 2, 3),
t AS (SELECT ga, gb, sum(m / (p.n + q.n - m)) AS total FROM b JOIN z p ON p.genome = ga AND p.w = b.w JOIN z q ON q.genome = gb AND q.w = b.w GROUP BY 1, 2)
SELECT ga, gb, round(total / (p.n + q.n - met), 6) AS jaccard FROM t JOIN mt USING (ga, gb) JOIN wc p ON p.genome = ga JOIN wc q ON q.genome = gb""")
def windowed_jaccard(spark, sf):
    return structure.windowed_jaccard(A.landmarks(spark, sf), 5000).withColumn("jaccard", R("jaccard"))


@query(f"""WITH {marks(A.SPARSE, 'lang')}, k AS (SELECT DISTINCT genome, seq FROM marks) SELECT a.genome AS ga, b.genome AS gb, count(DISTINCT a.seq) AS common FROM k a JOIN k b ON a.genome < b.genome AND hamming(a.seq, b.seq) <= 1 GROUP BY 1, 2""")
def hamming1_common(spark, sf):
    return structure.approximate_common(A.letters(spark, sf, A.SPARSE, "lang"), 1)


@query(f"""WITH {marks(A.SPARSE, 'lang')}, k AS (SELECT DISTINCT genome, seq FROM marks) SELECT a.genome AS ga, b.genome AS gb, count(DISTINCT a.seq) AS common FROM k a JOIN k b ON a.genome < b.genome AND hamming(a.seq, b.seq) <= 3 GROUP BY 1, 2""")
def hamming3_common(spark, sf):
    return structure.approximate_common(A.letters(spark, sf, A.SPARSE, "lang"), 3)


@query(f"""WITH {marks(A.SPARSE)}, {WINDOWS}, h AS (SELECT x.genome AS ga, y.genome AS gb, x.w, count(DISTINCT x.seq) AS hit FROM s x JOIN s y ON x.w = y.w AND x.genome < y.genome AND hamming(x.seq, y.seq) <= 1 GROUP BY 1, 2, 3),
t AS (SELECT ga, gb, sum(2 * hit / (p.n + q.n)) AS total FROM h JOIN z p ON p.genome = ga AND p.w = h.w JOIN z q ON q.genome = gb AND q.w = h.w GROUP BY 1, 2)
SELECT ga, gb, round(total / (p.n + q.n - met), 6) AS similarity FROM t JOIN mt USING (ga, gb) JOIN wc p ON p.genome = ga JOIN wc q ON q.genome = gb""")
def windowed_approximate(spark, sf):
    return structure.windowed_approximate(A.landmarks(spark, sf, A.SPARSE), 5000).withColumn("similarity", R("similarity"))


@query("""WITH k AS (SELECT DISTINCT doc_id AS x FROM documents), a AS (SELECT x, ((x::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM k),
b AS (SELECT x, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a), c AS (SELECT x, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM b)
SELECT x, hex(xor(z, z >> 31)) AS h FROM c""")
def splitmix_hash_whole(spark, sf):
    """Hashes of all contig ids as they are."""
    k = A.table(spark, sf, "documents").select(F.col("doc_id").alias("x")).distinct()
    return splitmix64_native(k, "x", "z").select("x", F.hex("z").alias("h"))


_CODE = " + ".join(f"((instr('ACGT', substr(c, {n + 1}, 1)) - 1)::BIGINT << {2 * (20 - n)})" for n in range(21))


@query(f"""WITH {_contigs()}, w AS (SELECT genome, contig_id, p AS pos, substr(seq, p + 1, 21) AS s FROM contigs, unnest(range(0, greatest(length(seq) - 20, 0))) t(p)),
b AS (SELECT *, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS c FROM w), k AS (SELECT *, ({_CODE}) AS x FROM b),
h1 AS (SELECT *, ((x::UHUGEINT + 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM k),
h2 AS (SELECT * REPLACE (((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z) FROM h1),
h3 AS (SELECT * REPLACE (((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z) FROM h2)
SELECT genome, contig_id, pos::BIGINT AS pos, s AS seq, CASE WHEN s = c THEN '+' ELSE '-' END AS strand FROM h3 WHERE xor(z, z >> 31) < 18446744073709551615::UBIGINT // 50""")
def fmh_landmarks(spark, sf):
    return sketch(A.contigs(spark, sf), 21, 50).select("genome", "contig_id", "pos", "seq", "strand")


EDGES = f"""{LAST}, st AS (SELECT DISTINCT genome, seq AS src, tgt FROM (SELECT genome, seq, lead(seq) OVER (PARTITION BY genome ORDER BY contig_id, pos) AS tgt FROM marks) WHERE tgt IS NOT NULL)"""


@query(f"""WITH {marks()}, {EDGES} SELECT src, tgt, count(*) AS weight, sum(y.gpos - x.gpos)::BIGINT AS distance FROM st JOIN lastp x ON (x.genome, x.seq) = (st.genome, src) JOIN lastp y ON (y.genome, y.seq) = (st.genome, tgt) GROUP BY 1, 2 HAVING count(*) >= 2""")
def edge_weights(spark, sf):
    m = A.landmarks(spark, sf)
    e = graph.simplify(graph.edges(m), graph.nodes(m), 2)[0]
    return e.select("src", "tgt", "weight", F.aggregate(F.map_values("distances"), F.lit(0).cast("long"), lambda a, x: a + x).alias("distance"))


@query(f"WITH {marks(genome='lang')} SELECT seq FROM marks GROUP BY 1 HAVING count(DISTINCT genome) = (SELECT count(DISTINCT genome) FROM marks)")
def common_tags_all(spark, sf):
    return graph.common_tags(A.letters(spark, sf, genome="lang"))


@query(f"WITH {marks(genome=A.BUILT)} SELECT seq FROM marks GROUP BY 1 HAVING count(DISTINCT genome) = (SELECT count(DISTINCT genome) FROM marks)")
def common_tags_built(spark, sf):
    return graph.common_tags(A.letters(spark, sf, genome=A.BUILT))


def _tolerance(genome: str) -> str:
    """Tags that differ at one place are equal but for that letter; a tag reaches all of its cluster."""
    return f"""WITH RECURSIVE {marks(genome=genome)}, kinds AS MATERIALIZED (SELECT DISTINCT genome, seq FROM marks), k AS MATERIALIZED (SELECT DISTINCT seq FROM kinds),
mask AS (SELECT seq, left(seq, n - 1) || '*' || substr(seq, n + 1) AS m FROM k, unnest(range(1, length(seq) + 1)) t(n)), near AS MATERIALIZED (SELECT DISTINCT x.seq AS a, y.seq AS b FROM mask x JOIN mask y USING (m) WHERE x.seq <> y.seq),
reach AS (SELECT seq, seq AS other FROM k UNION SELECT r.seq, n.b FROM reach r JOIN near n ON n.a = r.other), named AS (SELECT seq, min(other) AS cluster FROM reach GROUP BY 1)
SELECT cluster, count(DISTINCT seq) AS members FROM kinds JOIN named USING (seq) GROUP BY 1 HAVING count(DISTINCT genome) = (SELECT count(DISTINCT genome) FROM kinds)"""


@query(_tolerance("lang"))
def tolerance_clusters(spark, sf):
    return graph.tolerant_tags(A.letters(spark, sf, genome="lang"), 1)


@query(_tolerance(A.BUILT))
def tolerance_clusters_built(spark, sf):
    return graph.tolerant_tags(A.letters(spark, sf, genome=A.BUILT), 1)


def _graph(spark, sf):
    e = materialise(graph.weights(A.letters(spark, sf), 2), "edges")
    return e, materialise(graph.path_steps(e), "paths")


def _on_paths(spark, sf, paths):
    """Places of the letters that lie on paths."""
    own = A.landmarks(spark, sf).join(paths.select("seq").distinct(), "seq", "left_semi")
    return materialise(graph.nodes(own), "nodes")


#: Unbranched paths by walking from every end, and round every ring, in both directions.
GRAPH = f"""WITH RECURSIVE {marks()}, {EDGES}, ew AS MATERIALIZED (SELECT src, tgt, count(*) AS weight FROM st GROUP BY 1, 2 HAVING count(*) >= 2), nodes AS MATERIALIZED (SELECT l.* FROM lastp l WHERE seq IN (SELECT src FROM ew UNION SELECT tgt FROM ew)),
und AS MATERIALIZED (SELECT DISTINCT least(src, tgt) AS x, greatest(src, tgt) AS y FROM ew WHERE src <> tgt), nb AS MATERIALIZED (SELECT x AS n, y AS m FROM und UNION ALL SELECT y, x FROM und), dg AS MATERIALIZED (SELECT n, count(*) AS d FROM nb GROUP BY 1),
walk AS (SELECT nb.n AS s, nb.n AS prev, m AS here, [nb.n, m] AS path FROM nb JOIN dg USING (n) WHERE d <> 2
UNION ALL SELECT w.s, w.here, nb.m, list_append(w.path, nb.m) FROM walk w JOIN dg ON dg.n = w.here AND dg.d = 2 JOIN nb ON nb.n = w.here AND nb.m <> w.prev),
done AS (SELECT w.* FROM walk w JOIN dg ON dg.n = w.here WHERE d <> 2), covered AS (SELECT DISTINCT unnest(path) AS n FROM done), lone AS (SELECT n FROM dg WHERE d = 2 AND n NOT IN (SELECT n FROM covered)),
spin AS (SELECT nb.n AS s, nb.n AS prev, m AS here, [nb.n, m] AS path FROM nb JOIN lone USING (n) WHERE m > nb.n UNION ALL SELECT w.s, w.here, nb.m, list_append(w.path, nb.m) FROM spin w JOIN nb ON nb.n = w.here AND nb.m <> w.prev WHERE w.here > w.s AND nb.m >= w.s),
closed AS (SELECT path[1:len(path) - 1] AS ring FROM done WHERE s = here UNION ALL SELECT path[1:len(path) - 1] FROM spin WHERE here = s), turned AS (SELECT ring[list_position(ring, list_min(ring)):] || ring[1:list_position(ring, list_min(ring)) - 1] AS ring FROM closed),
paths AS (SELECT path[1] || '>' || path[2] AS path_id, path FROM (SELECT path FROM done WHERE s < here UNION SELECT ring FROM turned WHERE ring[2] < ring[len(ring)])),
steps AS (SELECT path_id, len(path) AS tags, unnest(range(len(path))) AS k, unnest(path) AS seq FROM paths), on_ AS (SELECT path_id, genome, tags, min(gpos) AS "begin", max(gpos) AS "end", min_by(strand, k) AS strand FROM steps JOIN nodes USING (seq) WHERE tags >= 2 GROUP BY 1, 2, 3 HAVING count(*) = tags),
blocks AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY path_id) AS g, min("end" - "begin") OVER (PARTITION BY path_id) AS short FROM on_) WHERE g >= 2)"""


@query(f"{GRAPH} SELECT path_id, array_to_string(path, ',') AS path FROM paths")
def linear_paths(spark, sf):
    return graph.path_lists(_graph(spark, sf)[1]).withColumn("path", F.array_join("path", ","))


@query(f"""{GRAPH}, s AS (SELECT path_id, tags, seq AS x, lead(seq) OVER (PARTITION BY path_id ORDER BY k) AS y FROM steps)
SELECT path_id, round(avg(coalesce(a.weight, b.weight, 0)) / (SELECT count(DISTINCT source) FROM documents) * least(1, sqrt(max(tags) / 10)), 6) AS score FROM s LEFT JOIN ew a ON (a.src, a.tgt) = (x, y) LEFT JOIN ew b ON (b.src, b.tgt) = (y, x) WHERE y IS NOT NULL GROUP BY 1""")
def path_scores(spark, sf):
    e, p = _graph(spark, sf)
    series = A.table(spark, sf, "documents").select("source").distinct().filter("source IS NOT NULL").count()
    return graph.path_scores(p, e, series).withColumn("score", R("score"))


@query(f"""{GRAPH} SELECT path_id, genome, "begin", "end", strand, tags FROM blocks WHERE short >= 1""")
def synteny_blocks(spark, sf):
    _, p = _graph(spark, sf)
    n = _on_paths(spark, sf, p)
    return graph.blocks_of_size(graph.blocks(p, n), 1)


@query(f"""{GRAPH}, g AS (SELECT path_id, k, genome, abs(lead(n.gpos) OVER (PARTITION BY path_id, genome ORDER BY k) - n.gpos) AS d FROM steps JOIN nodes n USING (seq) JOIN (SELECT path_id, genome FROM blocks) USING (path_id, genome))
SELECT path_id, a.genome AS ga, b.genome AS gb, sum(b.d - a.d)::BIGINT AS indel, count(*) AS places FROM g a JOIN g b USING (path_id, k) WHERE a.genome < b.genome AND a.d > 0 AND b.d > 0 AND abs(b.d - a.d) >= greatest(100, (a.d + b.d) / 2 * 0.1) GROUP BY 1, 2, 3""")
def block_indels(spark, sf):
    _, p = _graph(spark, sf)
    n = _on_paths(spark, sf, p)
    b = materialise(graph.blocks(p, n), "blocks")
    return graph.indels(p, b, n)


POST = """po AS (SELECT genome, contig_id, lag(canon) OVER w AS x, canon AS y, gpos - lag(gpos) OVER w AS gap, length(seq) AS n FROM marks WINDOW w AS (PARTITION BY genome, contig_id ORDER BY pos)),
post AS (SELECT genome, contig_id, least(x, y) AS a, greatest(x, y) AS b, x, y FROM po WHERE gap > n)"""


@query(f"WITH {marks()}, {POST} SELECT a, b, count(*) AS postings, count(DISTINCT genome) AS genomes FROM post GROUP BY 1, 2 HAVING count(DISTINCT genome) >= 2")
def pair_postings(spark, sf):
    return placement.pair_postings(A.landmarks(spark, sf)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("postings"), F.countDistinct("genome").alias("genomes")).filter("genomes >= 2")


SEEDS = f"""WITH {marks()}, {POST}, q AS (SELECT *, concat_ws(':', genome, contig_id) AS q FROM marks), qk AS (SELECT DISTINCT q, genome AS own, canon FROM q), tk AS (SELECT DISTINCT genome, canon FROM marks),
bt AS (SELECT q, t.genome, count(*) AS seed_tags FROM qk JOIN tk t USING (canon) WHERE own <> t.genome GROUP BY 1, 2 HAVING count(*) >= 3), qp AS (SELECT DISTINCT concat_ws(':', genome, contig_id) AS q, a, b FROM post), tp AS (SELECT DISTINCT genome, a, b FROM post),
bp AS (SELECT q, t.genome, count(*) AS seed_pairs FROM qp JOIN tp t USING (a, b) GROUP BY 1, 2), chosen AS (SELECT q, genome, seed_tags, coalesce(seed_pairs, 0) AS seed_pairs FROM bt LEFT JOIN bp USING (q, genome) WHERE coalesce(seed_pairs, 0) >= 2)"""


def _placement(spark, sf):
    """Landmarks of the documents and their index, from the shared folder; written there when first asked for
    and again when the table's files change."""
    place = f"{shared_dir(spark)}/placement-{fingerprint(A.table(spark, sf, 'documents'))}"
    if not exists(spark, f"{place}/index/meta/_SUCCESS"):
        series.oriented(A.landmarks(spark, sf)).write.mode("overwrite").parquet(f"{place}/landmarks")
        placement.keep_index(spark.read.parquet(f"{place}/landmarks"), f"{place}/index")
    m = spark.read.parquet(f"{place}/landmarks")
    size = A.contigs(spark, sf).select(F.concat_ws(":", "genome", "contig_id").alias("q"), "length")
    return m, placement.query_landmarks(m), placement.open_index(spark, f"{place}/index"), size


@query(f"{SEEDS} SELECT q, genome, seed_tags, seed_pairs FROM chosen")
def candidate_seeds(spark, sf):
    _, queries, index, _ = _placement(spark, sf)
    mine = placement.query_pairs(queries, index.kinds)
    return placement.candidates(queries, mine, index.kinds, index.pair_kinds, 3, 2, True, True).select("q", "genome", "seed_tags", "seed_pairs")


@query(f"""{SEEDS}, once AS (SELECT q, canon, max(gpos) AS qpos FROM q GROUP BY 1, 2 HAVING count(*) = 1), m AS (SELECT c.q, c.genome, t.contig_id, t.canon, qpos, t.gpos AS rpos FROM chosen c JOIN once USING (q) JOIN marks t ON t.genome = c.genome AND t.canon = once.canon)
SELECT q, genome, contig_id, canon, qpos, rpos FROM (SELECT *, count(*) OVER (PARTITION BY q, genome, contig_id, canon) AS n FROM m) WHERE n = 1""")
def placement_anchors(spark, sf):
    _, queries, index, _ = _placement(spark, sf)
    mine = placement.query_pairs(queries, index.kinds)
    chosen = materialise(placement.candidates(queries, mine, index.kinds, index.pair_kinds, 3, 2, True, True), "chosen")
    return placement.anchors(queries, chosen, index.tags).select("q", "genome", "contig_id", "canon", "qpos", "rpos")


def _ranked(windows: str, own: str, pairs: int) -> str:
    """SQL of a whole search: ``windows`` gives ``qm`` (q, own, canon, gpos, seq: landmarks of the queries)
    and ``ql`` (q, length); candidates of rank up to 5 are in ``ranked``.

    Chains are a dynamic program over lists: ``sc`` and ``pr`` hold the scores and predecessors so far;
    the largest score * 10^6 - place is the earliest of the best predecessors."""
    unit = lambda c: f"least(greatest({c}, 0), 1)"
    score = lambda near: unit(f"shared_fraction * 0.15 + pair_fraction * 0.30 + coverage * 0.30 + consistency * 0.10 + interior * 0.10 + {near} * 0.05")
    best = 'PARTITION BY q ORDER BY round(score, 9) DESC, n_pairs DESC, n_tags DESC, genome, contig_id'
    return f"""WITH RECURSIVE {marks()}, {POST}, {windows}, qk AS (SELECT DISTINCT q, own, canon FROM qm), tk AS (SELECT DISTINCT genome, canon FROM marks), bt AS (SELECT q, t.genome, count(*) AS n FROM qk JOIN tk t USING (canon) WHERE {own} GROUP BY 1, 2 HAVING count(*) >= 3),
qp AS (SELECT DISTINCT q, x, y, least(x, y) AS a, greatest(x, y) AS b FROM (SELECT q, lag(canon) OVER w AS x, canon AS y, gpos - lag(gpos) OVER w AS gap, length(seq) AS n FROM qm WINDOW w AS (PARTITION BY q ORDER BY gpos)) WHERE gap > n),
bp AS (SELECT q, t.genome, count(*) AS n FROM (SELECT DISTINCT q, a, b FROM qp) JOIN (SELECT DISTINCT genome, a, b FROM post) t USING (a, b) GROUP BY 1, 2), chosen AS (SELECT q, bt.genome FROM bt LEFT JOIN bp USING (q, genome) WHERE coalesce(bp.n, 0) >= {pairs}),
once AS (SELECT q, canon, max(gpos) AS qpos FROM qm GROUP BY 1, 2 HAVING count(*) = 1), m AS (SELECT c.q, c.genome, t.contig_id, t.canon, qpos, t.gpos AS rpos FROM chosen c JOIN once USING (q) JOIN marks t ON t.genome = c.genome AND t.canon = once.canon),
ar AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY q, genome ORDER BY qpos, rpos, canon) AS k FROM (SELECT *, count(*) OVER (PARTITION BY q, genome, contig_id, canon) AS n FROM m) WHERE n = 1),
seqs AS MATERIALIZED (SELECT q, genome, ahead, list(CASE WHEN ahead THEN rpos ELSE -rpos END ORDER BY k) AS r FROM ar, (VALUES (true), (false)) o(ahead) GROUP BY 1, 2, 3),
dp AS (SELECT q, genome, ahead, r, 1 AS k, [1::BIGINT] AS sc, [0::BIGINT] AS pr FROM seqs UNION ALL SELECT q, genome, ahead, r, k + 1, list_append(sc, CASE WHEN v < 0 THEN 1 ELSE v // 1000000 + 2 END), list_append(pr, CASE WHEN v < 0 THEN 0 ELSE (v // 1000000 + 1) * 1000000 - v END)
FROM (SELECT *, list_max(list_transform(range(1, k + 1), lambda j: CASE WHEN r[j] < r[k + 1] THEN sc[j] * 1000000 - j ELSE -1 END)) AS v FROM dp WHERE k < len(r))),
bk AS (SELECT q, genome, ahead, pr, list_position(sc, list_max(sc))::BIGINT AS spot FROM dp WHERE k = len(r) UNION ALL SELECT q, genome, ahead, pr, pr[spot] FROM bk WHERE pr[spot] > 0),
pk AS (SELECT b.ahead, ar.* FROM bk b JOIN ar ON (ar.q, ar.genome, ar.k) = (b.q, b.genome, b.spot)), ch AS (SELECT q, genome, ahead, count(*) AS n_tags, min(qpos) AS qs, max(qpos) AS qe FROM pk GROUP BY 1, 2, 3 HAVING count(*) >= 2),
cc AS (SELECT q, genome, ahead, min_by(contig_id, (-n, contig_id)) AS contig_id FROM (SELECT q, genome, ahead, contig_id, count(*) AS n FROM pk GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3), pc AS (SELECT DISTINCT q, genome, ahead, canon FROM pk),
sp AS (SELECT k.q, p.genome, p.a, p.b, p.x, p.y, p.x = k.x AND p.y = k.y AS same FROM qp k JOIN post p USING (a, b) JOIN chosen c ON c.q = k.q AND c.genome = p.genome),
su AS (SELECT u.q, u.genome, u.ahead, count(*) AS n, count(DISTINCT a || b) AS n_pairs, count(*) FILTER (same = u.ahead) AS good FROM sp JOIN pc u ON (u.q, u.genome, u.canon) = (sp.q, sp.genome, sp.x) JOIN pc v ON (v.q, v.genome, v.canon, v.ahead) = (sp.q, sp.genome, sp.y, u.ahead) GROUP BY 1, 2, 3),
both_ AS (SELECT ch.*, contig_id, coalesce(n_pairs, 0) AS n_pairs, coalesce(good / n, 0) AS consistency FROM ch JOIN cc USING (q, genome, ahead) LEFT JOIN su USING (q, genome, ahead)),
sided AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q, genome ORDER BY n_tags DESC, n_pairs DESC, round(consistency * 1000000) DESC, contig_id DESC, ahead DESC) AS o FROM both_) WHERE o = 1),
parts AS (SELECT s.*, l.length, n_tags / nt AS shared_fraction, CASE WHEN coalesce(np, 0) > 0 THEN n_pairs / np ELSE 0 END AS pair_fraction, CASE WHEN l.length > 0 THEN {unit('(qe - qs + 1) / l.length')} ELSE 1 END AS coverage, CASE WHEN nt <= 2 THEN 0 ELSE {unit('(n_tags - 2) / (nt - 2)')} END AS interior
FROM sided s JOIN (SELECT q, count(*) AS nt FROM qm GROUP BY 1) USING (q) LEFT JOIN (SELECT q, count(*) AS np FROM qp GROUP BY 1) USING (q) LEFT JOIN ql l USING (q)),
r1 AS (SELECT *, row_number() OVER w AS o1, lead(score) OVER w AS nxt FROM (SELECT *, {score('0')} AS score FROM parts) WINDOW w AS ({best})),
r2 AS (SELECT * REPLACE ({score('near')} AS score) FROM (SELECT *, CASE WHEN o1 > 1 THEN 0 WHEN nxt IS NULL OR score <= 0 THEN 1 ELSE {unit('1 - (score - nxt) / score')} END AS near FROM r1)),
ranked AS (SELECT * FROM (SELECT *, row_number() OVER ({best}) AS "rank" FROM r2) WHERE "rank" <= 5)"""


_ENOUGH = "CASE WHEN length >= 500000 THEN n_tags >= 25 AND n_pairs >= 15 WHEN length >= 100000 THEN n_tags >= 15 AND n_pairs >= 8 WHEN length >= 50000 THEN n_tags >= 10 AND n_pairs >= 5 WHEN length >= 10000 THEN n_tags >= 5 AND n_pairs >= 2 ELSE true END"
_WHOLE = "qm AS (SELECT concat_ws(':', genome, contig_id) AS q, genome AS own, canon, gpos, seq FROM marks), ql AS (SELECT concat_ws(':', genome, contig_id) AS q, length FROM placed)"


@query(f"""{_ranked(_WHOLE, "own <> t.genome", 2)} SELECT t.q, tags, coalesce(a.genome, '*') AS best_genome, coalesce('s' || substr(a.genome, 4, 1), '*') AS best_species, CASE WHEN coalesce(a.ahead, true) THEN '+' ELSE '-' END AS orientation, coalesce(a.n_tags, 0) AS shared_tags, coalesce(a.n_pairs, 0) AS shared_pairs,
round(coalesce(a.coverage, 0), 6) AS coverage, round(coalesce(a.score, 0), 6) AS score, CASE WHEN a.q IS NULL THEN 'exploratory' WHEN a.score >= 0.80 AND a.sure THEN 'high' WHEN a.score >= 0.65 THEN 'medium' WHEN a.score >= 0.50 AND a.length >= 10000 THEN 'low' ELSE 'exploratory' END AS confidence,
coalesce(b.genome, '*') AS second_genome, round(coalesce(b.score, 0), 6) AS second_score FROM (SELECT q, count(*) AS tags FROM qm GROUP BY 1) t LEFT JOIN (SELECT *, {_ENOUGH} AS sure FROM ranked WHERE "rank" = 1) a ON a.q = t.q LEFT JOIN (SELECT * FROM ranked WHERE "rank" = 2) b ON b.q = t.q""")
def placement_full(spark, sf):
    m, queries, index, size = _placement(spark, sf)
    ranked = materialise(placement.search(queries, index, size, 3, 2, 5, True), "ranked")
    species = m.select("genome").distinct().withColumn("species_cluster", F.concat(F.lit("s"), F.substring("genome", 4, 1)))
    return placement.placements(ranked, queries, species)


@query(f"""WITH {marks()}, l AS (SELECT genome, contig_id, min(gpos) AS low, max(gpos) AS high FROM marks GROUP BY 1, 2), g AS (SELECT genome, contig_id, low, unnest(range(0, (high - low) // 2000 + 1)) AS segment FROM l)
SELECT concat_ws(':', g.genome, g.contig_id) AS contig_q, segment::INTEGER AS segment, low + segment * 2000 AS "begin", low + (segment + 1) * 2000 - 1 AS "end", count(m.pos) AS tags FROM g LEFT JOIN marks m ON m.genome = g.genome AND m.contig_id = g.contig_id AND m.gpos BETWEEN low + segment * 2000 AND low + (segment + 1) * 2000 - 1 GROUP BY 1, 2, 3, 4""")
def chimera_windows(spark, sf):
    inside, grid = placement.chimera_windows(A.landmarks(spark, sf), 2000)
    n = inside.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(n, "q", "left").select("contig_q", "segment", "begin", "end", F.coalesce("n", F.lit(0)).alias("tags"))


_WINDOWS = """lo AS (SELECT genome, contig_id, min(gpos) AS low, max(gpos) AS high FROM marks GROUP BY 1, 2), grid AS (SELECT concat_ws(':', genome, contig_id) AS contig_q, unnest(range(0, (high - low) // 2000 + 1)) AS segment, low FROM lo),
qm AS (SELECT concat_ws(':', genome, contig_id) || '#' || ((gpos - low) // 2000) AS q, genome AS own, canon, gpos, seq FROM marks JOIN lo USING (genome, contig_id)), ql AS (SELECT contig_q || '#' || segment AS q, 2000 AS length FROM grid)"""


@query(f"""{_ranked(_WINDOWS, "true", 0)}, rw AS (SELECT contig_q, segment, low + segment * 2000 AS "begin", low + (segment + 1) * 2000 - 1 AS "end", coalesce(a.genome, '*') AS best_genome, coalesce('s' || substr(a.genome, 4, 1), '*') AS best_species, coalesce(a.score, 0) AS score,
coalesce('s' || substr(b.genome, 4, 1), '*') AS second_species, coalesce(b.score, 0) AS second_score FROM grid LEFT JOIN (SELECT * FROM ranked WHERE "rank" = 1) a ON a.q = contig_q || '#' || segment LEFT JOIN (SELECT * FROM ranked WHERE "rank" = 2) b ON b.q = contig_q || '#' || segment),
mv AS (SELECT *, coalesce(lag(best_species) OVER (PARTITION BY contig_q ORDER BY segment) <> best_species, false) AS moved FROM rw)
SELECT contig_q, segment::INTEGER AS segment, "begin", "end", best_genome, best_species, round(score, 6) AS score, second_species, round(second_score, 6) AS second_score, CASE WHEN moved THEN round(least(score, second_score), 6) ELSE 0 END AS chimera_confidence, moved AS transition FROM mv""")
def chimera_scan(spark, sf):
    m, _, index, _ = _placement(spark, sf)
    species = m.select("genome").distinct().withColumn("species_cluster", F.concat(F.lit("s"), F.substring("genome", 4, 1)))
    out = placement.chimera_scan(m, index, species, 2000)
    return out.withColumns({c: R(c) for c in ("score", "second_score", "chimera_confidence")})


@query()
def scaffold_orientation_all(spark, sf):
    """Every source as a draft against all others."""
    m = materialise(A.landmarks(spark, sf), "marks")
    size = A.contigs(spark, sf).select("genome", "contig_id", "length")
    return placement.scaffold(m, m, size, 2, key="genome").select("genome", "contig_id", "reverse", "shared", "median_ref")


@query(f"WITH {_contigs()} SELECT contig_id::VARCHAR AS contig_name, length(seq) AS length, round(CASE WHEN length(seq) > 0 THEN length(regexp_replace(seq, '[^GC]', '', 'g')) / length(seq) ELSE 0 END, 6) AS gc, md5(seq) AS digest FROM contigs")
def fasta_written_and_read(spark, sf):
    """All contigs written as sequence files in the shared folder and read back by ranges of bytes."""
    place = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    wrapped = F.regexp_replace("seq", "(.{60})", "$1\n")
    A.contigs(spark, sf).select(F.concat(F.lit(">"), F.col("contig_id").cast("string"), F.lit(" source="), "genome", F.lit("\n"), wrapped).alias("value")).write.text(place)
    back = files.read_fasta(spark, place, "all")
    return back.select("contig_name", F.col("length").cast("long").alias("length"), R(F.coalesce(gc_content(F.col("seq")), F.lit(0.0))).alias("gc"), F.md5("seq").alias("digest"))


@query(f"""WITH {marks()} SELECT genome || ':' || contig_id // 1000 AS genome, contig_id % 1000 + 1 AS contig_id, row_number() OVER (PARTITION BY genome, contig_id // 1000 ORDER BY contig_id, pos) - 1 AS ord, pos AS gpos, seq, strand, 'd' || contig_id AS contig_name FROM marks""")
def landmarks_written_and_read(spark, sf):
    """All landmarks written as binary files, a series for a thousand contigs of a source, and read back."""
    m = materialise(A.landmarks(spark, sf), "marks")
    name = F.concat("genome", F.lit(":"), F.expr("cast(contig_id div 1000 as string)"))
    rows = m.select(name.alias("genome"), (F.col("contig_id") % 1000 + 1).alias("contig_id"), (F.col("contig_id") * (1 << 32) + F.col("pos")).alias("ord"), F.col("pos").alias("gpos"), "seq", "enzyme", "strand")
    # names of all thousand contigs, also of those without landmarks
    number = F.expr("cast(split_part(genome, ':', -1) as bigint) * 1000")
    named = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda k: F.struct(F.concat(F.lit("d"), (number + k).cast("string")).alias("name"), F.lit(0).cast("long").alias("length"), F.lit(False).alias("circular")))
    place = f"{shared_dir(spark)}/landmarks-{uuid.uuid4().hex}"
    streams.write_binary(rows, rows.select("genome").distinct().select("genome", F.lit(0).cast("long").alias("length"), named.alias("contigs")), place)
    return streams.read_binary(spark, place)[1].drop("enzyme")
