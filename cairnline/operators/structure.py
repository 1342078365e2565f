"""Structural comparison of all pairs of series at once.

Every step works on rows keyed by the pair; only pairs that share landmarks ever exist. Where most
series share most landmarks the pair rows are the answer's own size, not an intermediate blow-up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hamming
from ..session import materialise, ship
from . import ranges
from .series import collapse_runs, oriented, raw_pairs, share_windows

PAIR = ["ga", "gb"]


def unique_landmarks(landmarks: DataFrame) -> DataFrame:
    once = F.count(F.lit(1)).over(Window.partitionBy("genome", "canon")) == 1
    return oriented(landmarks).withColumn("_once", once).filter("_once").select("genome", "contig_id", "pos", "canon", "rc", "pal")


def shared_landmarks(landmarks: DataFrame) -> DataFrame:
    """Landmarks unique in both series of a pair, a row for each side: ``ga, gb, side, contig_id,
    pos, canon, rc, pal``; pairs that share fewer than two are left out."""
    u = unique_landmarks(landmarks)
    a = u.select(F.col("genome").alias("ga"), "canon", F.struct("contig_id", "pos", "rc", "pal").alias("a"))
    b = u.select(F.col("genome").alias("gb"), "canon", F.struct("contig_id", "pos", "rc", "pal").alias("b"))
    both = a.join(b, "canon").filter("ga < gb")
    both = both.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*PAIR))).filter("_n >= 2")
    sides = F.explode(F.array(F.struct(F.lit("a").alias("side"), "a.*"), F.struct(F.lit("b").alias("side"), "b.*"))).alias("s")
    return both.select(*PAIR, "canon", sides).select(*PAIR, "s.side", "s.contig_id", "s.pos", "canon", "s.rc", "s.pal")


def structural_pairs(landmarks: DataFrame, sketched: bool = False, circular: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Two tables, a row for each pair of series that shares at least two landmarks, and the pairs'
    junctions: ``score, shared_tags, conserved, breakpoints, scj_distance, density, observable,
    mismatches, uninformative, inverted_fraction, raw_mismatch_fraction, circular, landmarks_collapsed,
    repeats_dropped``; and ``ga, gb, pos``.

    ``circular`` (genome, contig_id): contigs declared closed; without it a pair's series are closed
    when each has one contig. ``sketched``: landmarks by hash, whose runs are not collapsed."""
    side = [*PAIR, "side"]
    shared = materialise(shared_landmarks(landmarks), "shared")
    kept = shared if sketched else collapse_runs(shared, side)
    both_sides = F.count(F.lit(1)).over(Window.partitionBy(*PAIR, "canon")) == 2
    enough = F.count(F.lit(1)).over(Window.partitionBy(*PAIR)) >= 4
    kept = kept.withColumn("_b", both_sides).filter("_b").withColumn("_e", enough).filter("_e").select(*side, "contig_id", "pos", "canon", "rc", "pal")
    kept = materialise(kept, "kept")

    contig = Window.partitionBy(*side, "contig_id")
    order = contig.orderBy("pos", "canon")
    if circular is None:
        one = kept.groupBy(*PAIR).agg(*(F.countDistinct(F.when(F.col("side") == s, F.col("contig_id"))).alias(f"n{s}") for s in "ab"))
        closed = kept.join(one.select(*PAIR, ((F.col("na") == 1) & (F.col("nb") == 1)).alias("closed")), PAIR)
    else:
        genome = F.when(F.col("side") == "a", F.col("ga")).otherwise(F.col("gb"))
        flags = circular.select(F.col("genome").alias("_g"), "contig_id", F.lit(True).alias("closed")).distinct()
        closed = kept.withColumn("_g", genome).join(flags, ["_g", "contig_id"], "left").withColumn("closed", F.coalesce("closed", F.lit(False)))
    linked = closed.withColumn("nxt", F.lead("canon").over(order)).withColumn("first", F.first("canon").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    linked = linked.withColumn("many", F.count(F.lit(1)).over(contig))
    partner = F.coalesce("nxt", F.when(F.col("closed") & (F.col("many") >= 3), F.col("first")))
    pairs = linked.withColumn("partner", partner).filter(F.col("partner").isNotNull()).groupBy(
        *side, F.least("canon", "partner").alias("k1"), F.greatest("canon", "partner").alias("k2")
    ).agg(F.max("pos").alias("pos"))
    adj = pairs.groupBy(*PAIR, "k1", "k2").agg(
        F.max(F.when(F.col("side") == "a", F.col("pos"))).alias("pos_a"), F.max(F.when(F.col("side") == "b", F.col("pos"))).alias("pos_b")
    )
    adj = materialise(adj.select(*PAIR, "k1", "k2", "pos_a", F.col("pos_a").isNotNull().alias("in_a"), F.col("pos_b").isNotNull().alias("in_b")), "adjacencies")

    ends = adj.select(*PAIR, F.explode(F.array("k1", "k2")).alias("canon"), "in_a", "in_b")
    degree = ends.groupBy(*PAIR, "canon").agg(
        F.count_if("in_a").alias("deg_a"), F.count_if("in_b").alias("deg_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("kept_deg")
    )
    degree = degree.select(*PAIR, "canon", (F.col("deg_b") >= 2).alias("full"), ((F.col("deg_a") > 0) & (F.col("deg_b") > 0) & (F.col("kept_deg") == 0)).alias("alone"))
    in_a = adj.filter("in_a")
    for k in ("k1", "k2"):
        in_a = in_a.join(degree.select(*PAIR, F.col("canon").alias(k), F.col("full").alias(f"full_{k}"), F.col("alone").alias(f"alone_{k}")), [*PAIR, k], "left")
    in_a = in_a.withColumn("observable", F.coalesce("full_k1", F.lit(False)) | F.coalesce("full_k2", F.lit(False)))
    broken = in_a.filter(~F.col("in_b") & F.col("observable") & ~F.coalesce("alone_k1", F.lit(False)) & ~F.coalesce("alone_k2", F.lit(False)))
    # A pair is not broken where a landmark that moved alone merely stands in between.
    either = adj.filter("in_b").select(*PAIR, F.explode(F.array(F.struct(F.col("k1").alias("x"), F.col("k2").alias("z")), F.struct(F.col("k2").alias("x"), F.col("k1").alias("z")))).alias("e")).select(*PAIR, "e.*")
    lone = degree.filter("alone").select(*PAIR, F.col("canon").alias("z"))
    near = either.join(lone, [*PAIR, "z"], "left_semi")
    split = near.select(*PAIR, F.col("x").alias("k1"), "z").join(near.select(*PAIR, F.col("x").alias("k2"), "z"), [*PAIR, "z"]).filter("k1 < k2")
    broken = broken.join(split, [*PAIR, "k1", "k2"], "left_anti").select(*PAIR, F.col("pos_a").alias("pos"))
    junctions = materialise(broken, "junctions")

    counts = adj.groupBy(*PAIR).agg(
        F.count_if("in_a").alias("n_a"), F.count_if("in_b").alias("n_b"), F.count_if(F.col("in_a") & F.col("in_b")).alias("conserved"), F.count(F.lit(1)).alias("either")
    )
    observed = in_a.groupBy(*PAIR).agg(F.count_if("observable").alias("observable"))
    bends = junctions.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("breakpoints"))
    matched = kept.groupBy(*PAIR, "canon").agg(F.bool_or("pal").alias("pal"), (F.count_if("rc") == 1).alias("flipped"))
    turned = matched.groupBy(*PAIR).agg(
        F.count(F.lit(1)).alias("shared_tags"), F.count_if("pal").alias("uninformative"), F.count_if(~F.col("pal") & F.col("flipped")).alias("mismatches")
    )
    ring = closed.groupBy(*side, "contig_id").agg(F.bool_and("closed").alias("c"), F.count(F.lit(1)).alias("n")).groupBy(*PAIR).agg(F.bool_and(F.col("c") & (F.col("n") >= 3)).alias("circular"))
    before = shared.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("before"))
    runs = (shared if sketched else collapse_runs(shared, side)).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("after"))
    repeats = oriented(landmarks).groupBy("genome", "canon").count().filter("count > 1").groupBy("genome").agg(F.count(F.lit(1)).alias("r"))
    out = turned.join(counts, PAIR, "left").join(observed, PAIR, "left").join(bends, PAIR, "left").join(ring, PAIR).join(before, PAIR).join(runs, PAIR)
    for g in PAIR:
        out = out.join(repeats.select(F.col("genome").alias(g), F.col("r").alias(f"r_{g}")), g, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    ratio = lambda x, y: F.when(zero(y) > 0, zero(x) / y).otherwise(0.0)
    informative = F.col("shared_tags") - F.col("uninformative")
    minority = F.least(F.col("mismatches"), informative - F.col("mismatches"))
    table = out.select(
        *PAIR, ratio("conserved", F.col("either")).alias("score"), "shared_tags", zero("conserved").alias("conserved"), zero("breakpoints").alias("breakpoints"),
        (zero("n_a") + zero("n_b") - 2 * zero("conserved")).alias("scj_distance"), (zero("breakpoints") / F.col("shared_tags")).alias("density"),
        zero("observable").alias("observable"), ratio("observable", F.col("n_a")).alias("observable_fraction"), "mismatches", "uninformative",
        ratio(minority, informative).alias("inverted_fraction"), ratio("mismatches", informative).alias("raw_mismatch_fraction"), "circular",
        (F.col("before") - F.col("after")).alias("landmarks_collapsed"), (zero("r_ga") + zero("r_gb")).alias("repeats_dropped"),
    )
    return table, junctions


def pair_sets(sets: DataFrame, key: list[str]) -> DataFrame:
    """``ga, gb, both, na, nb`` for pairs of series whose ``key`` sets meet."""
    size = sets.groupBy("genome").agg(F.count(F.lit(1)).alias("n"))
    a = sets.select(F.col("genome").alias("ga"), *key)
    b = sets.select(F.col("genome").alias("gb"), *key)
    both = a.join(b, key).filter("ga < gb").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("both"))
    for g, n in (("ga", "na"), ("gb", "nb")):
        both = both.join(size.select(F.col("genome").alias(g), F.col("n").alias(n)), g)
    return both


def jaccard(both: DataFrame, name: str = "jaccard") -> DataFrame:
    return both.withColumn(name, F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))


def adjacency_jaccard(landmarks: DataFrame) -> DataFrame:
    """Similarity of the sets of neighbouring pairs in file order; pairs of series that share some."""
    return jaccard(pair_sets(raw_pairs(landmarks), ["k1", "k2"]))


def last_occurrences(landmarks: DataFrame) -> DataFrame:
    """The last occurrence of each letter sequence in each series."""
    best = F.max_by(F.struct("gpos", "strand"), F.struct("contig_id", "ord")).alias("last")
    return landmarks.groupBy("genome", "seq").agg(best).select("genome", "seq", "last.*")


def synteny_matrix(landmarks: DataFrame) -> DataFrame:
    """Similarity of neighbouring pairs with one place, the last, for each letter sequence."""
    nxt = F.lead("seq").over(Window.partitionBy("genome").orderBy("gpos", "seq"))
    pairs = last_occurrences(landmarks).withColumn("nxt", nxt).filter(F.col("nxt").isNotNull())
    pairs = pairs.select("genome", F.least("seq", "nxt").alias("k1"), F.greatest("seq", "nxt").alias("k2")).distinct()
    return jaccard(pair_sets(pairs, ["k1", "k2"]), "synteny")


def legacy_breakpoints(landmarks: DataFrame) -> DataFrame:
    """Size of the symmetric difference of neighbouring pairs whose letters occur in both series; 0
    where fewer than two are common."""
    kinds = landmarks.select("genome", "seq").distinct()
    a, b = kinds.select(F.col("genome").alias("ga"), "seq"), kinds.select(F.col("genome").alias("gb"), "seq")
    common = materialise(a.join(b, "seq").filter("ga < gb"), "common")
    pairs = raw_pairs(landmarks)
    sides = []
    for g in PAIR:
        inside = common.select(*PAIR, F.col("seq").alias("k1")).join(pairs.select(F.col("genome").alias(g), "k1", "k2"), [g, "k1"])
        sides.append(inside.join(common.withColumnRenamed("seq", "k2"), [*PAIR, "k2"], "left_semi").select(*PAIR, "k1", "k2"))
    odd = sides[0].unionByName(sides[1]).groupBy(*PAIR, "k1", "k2").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    n = odd.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("odd"))
    many = common.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("common"))
    return many.join(n, PAIR, "left").select(*PAIR, "common", F.when(F.col("common") >= 2, F.coalesce("odd", F.lit(0))).otherwise(0).alias("breakpoints"))


def _ranks(landmarks: DataFrame, parts: int | None = None) -> DataFrame:
    """For each pair: ranks in A (last occurrence) in B's file order, which keeps duplicates."""
    # ranks run over a whole series, and one may hold most rows: counted in ranges
    rows = ranges.ranged(materialise(landmarks.select("genome", "seq", "contig_id", "ord"), "marks"), ["genome"], ["contig_id", "ord"], parts)
    rank = materialise(ranges.so_far(rows, ["genome"], ["contig_id", "ord"], F.lit(1), "at").select("genome", "seq", "at"), "ranked")
    last = rank.groupBy("genome", "seq").agg(F.max("at").alias("ra"))
    return last.withColumnRenamed("genome", "ga").join(rank.select(F.col("genome").alias("gb"), "seq", F.col("at").alias("rb")), "seq").filter("ga < gb").select(*PAIR, "ra", "rb")


def _inversions(x: np.ndarray) -> int:
    """Pairs out of order, by counting smaller successors bit by bit in numpy."""
    rank = np.unique(x, return_inverse=True)[1]
    total, width = 0, 1
    order = np.asarray(rank, np.int64)
    n = len(order)
    while width < n:
        for start in range(0, n, 2 * width):
            left, right = order[start: start + width], order[start + width: start + 2 * width]
            if len(right):
                total += int((len(left) - np.searchsorted(left, right, side="right")).sum())
                order[start: start + 2 * width] = np.sort(order[start: start + 2 * width], kind="stable")
        width *= 2
    return total


def _between(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Inversions between rows of different ``i``: rows ``ga, gb, part, i, v, n`` in order of the first
    four; for each (ga, gb, part) the pairs with a smaller i and a larger v. Only counts of the v seen so far are
    held."""
    key, seen, base, total, row, step = None, np.zeros(0, np.int64), 0, 0, None, []
    out: list[tuple] = []

    def settle() -> None:
        nonlocal seen, base, total, step
        if not step:
            return
        v, n = (np.concatenate(c) for c in zip(*step, strict=True))
        low, high = int(v.min()), int(v.max())
        if not len(seen):
            base = low
        if low < base:
            seen, base = np.concatenate([np.zeros(base - low, np.int64), seen]), low
        if high >= base + len(seen):
            seen = np.concatenate([seen, np.zeros(high + 1 - base - len(seen), np.int64)])
        above = np.cumsum(seen[::-1])[::-1] - seen
        total += int((above[v - base] * n).sum())
        np.add.at(seen, v - base, n)
        step = []

    for batch in batches:
        pairs = list(zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True))
        v, n = (batch.column(c).to_numpy() for c in (4, 5))
        at = 0
        while at < len(pairs):
            end = at
            while end < len(pairs) and pairs[end] == pairs[at]:
                end += 1
            if pairs[at] != row:
                settle()
                if pairs[at][:3] != key:
                    if key is not None:
                        out.append((*key[:2], total))
                    key, seen, total = pairs[at][:3], np.zeros(0, np.int64), 0
                row = pairs[at]
            step.append((v[at:end], n[at:end]))
            at = end
    settle()
    if key is not None:
        out.append((*key[:2], total))
    yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["ga", "gb", "inversions"])


def kendall_tau(landmarks: DataFrame, block: int = 50_000) -> DataFrame:
    """1 - 2 * inversions / pairs of the common landmarks' order; 0 where fewer than two.

    Places of both series are cut into blocks, so that a pair of long series is no single task's. Inverted
    landmarks lie in one block of B (counted there), in different blocks of both (from a histogram of blocks), or
    in different blocks of B and one of A (from the places of that block)."""
    ship(landmarks.sparkSession)

    def inside(rows: pd.DataFrame) -> pd.DataFrame:
        x = rows.sort_values("rb")["ra"].to_numpy()
        return pd.DataFrame({"ga": [rows["ga"].iloc[0]], "gb": [rows["gb"].iloc[0]], "inversions": [int(_inversions(x))]})

    blocked = lambda c: F.floor(F.col(c) / block).cast("long")
    ranks = materialise(_ranks(landmarks).select(*PAIR, F.col("ra").cast("long").alias("ra"), F.col("rb").cast("long").alias("rb")), "ranks")
    ranks = ranks.withColumns({"ja": blocked("ra"), "jb": blocked("rb")})
    form = "ga string, gb string, inversions long"

    def between(part: Column, value: str) -> DataFrame:
        cells = ranks.groupBy(*PAIR, part.alias("part"), F.col("jb").alias("i"), F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        order = [*PAIR, "part", "i"]
        return cells.repartition(*PAIR, "part").sortWithinPartitions(*order).select(*order, "v", "n").mapInArrow(_between, form)

    every = ranks.groupBy(*PAIR, "jb").applyInPandas(inside, form).unionByName(between(F.lit(0).cast("long"), "ja")).unionByName(between(F.col("ja"), "ra"))
    common = ranks.groupBy(*PAIR).agg(F.count(F.lit(1)).alias("common"))
    n = F.col("common")
    tau = F.when(n >= 2, 1 - 2 * F.col("inversions") / (n * (n - 1) / 2)).otherwise(0.0)
    return every.groupBy(*PAIR).agg(F.sum("inversions").alias("inversions")).join(common, list(PAIR)).select(*PAIR, "common", tau.alias("tau"))


def _positions(landmarks: DataFrame) -> DataFrame:
    """A's occurrences against B's last occurrence: ``ga, gb, pa, pb``."""
    last = last_occurrences(landmarks).select(F.col("genome").alias("gb"), "seq", F.col("gpos").alias("pb"))
    return landmarks.select(F.col("genome").alias("ga"), "seq", F.col("gpos").alias("pa")).join(last, "seq").filter("ga < gb").select(*PAIR, "pa", "pb")


def _corr(a: str = "pa", b: str = "pb"):
    c = F.corr(F.col(a).cast("double"), F.col(b).cast("double"))
    return F.coalesce(F.nanvl(F.abs(c), F.lit(0.0)), F.lit(0.0))


def position_correlation(landmarks: DataFrame) -> DataFrame:
    return _positions(landmarks).groupBy(*PAIR).agg(F.count(F.lit(1)).alias("common"), _corr().alias("correlation"))


def windowed_position_correlation(landmarks: DataFrame, windows: int) -> DataFrame:
    """The largest correlation over windows of the common landmarks; over all of them where there are
    fewer than two a window."""
    p = _positions(landmarks).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*PAIR)))
    parts = share_windows(p, PAIR, ["pa", "pb"], windows).withColumn("window", F.when(F.col("n") < 2 * windows, 0).otherwise(F.col("window")))
    return parts.groupBy(*PAIR, "window").agg(_corr().alias("c")).groupBy(*PAIR).agg(F.max("c").alias("correlation"))


def density_correlation(bins: DataFrame) -> DataFrame:
    """Correlation of the bin counts (``genome, bin, tags``) of all pairs of series."""
    a = bins.select(F.col("genome").alias("ga"), "bin", F.col("tags").alias("pa"))
    b = bins.select(F.col("genome").alias("gb"), "bin", F.col("tags").alias("pb"))
    return a.join(b, "bin").filter("ga < gb").groupBy(*PAIR).agg(_corr().alias("correlation"))


def windowed_jaccard(landmarks: DataFrame, window: int) -> DataFrame:
    """Mean similarity of the letter sets of equal coordinate windows, over windows with landmarks in
    either series."""
    sets = landmarks.select("genome", F.expr(f"gpos div {window}").alias("w"), "seq").distinct()
    size = materialise(sets.groupBy("genome", "w").agg(F.count(F.lit(1)).alias("n")), "windows")
    a, b = sets.withColumnRenamed("genome", "ga"), sets.withColumnRenamed("genome", "gb")
    both = a.join(b, ["w", "seq"]).filter("ga < gb").groupBy(*PAIR, "w").agg(F.count(F.lit(1)).alias("both"))
    for g, n in (("ga", "na"), ("gb", "nb")):
        both = both.join(size.select(F.col("genome").alias(g), "w", F.col("n").alias(n)), [g, "w"])
    total = jaccard(both).groupBy(*PAIR).agg(F.sum("jaccard").alias("sum"))
    counts = size.groupBy("genome").agg(F.count(F.lit(1)).alias("windows"))
    met = size.select(F.col("genome").alias("ga"), "w").join(size.select(F.col("genome").alias("gb"), "w"), "w").filter("ga < gb").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("met"))
    out = total.join(met, PAIR)
    for g in PAIR:
        out = out.join(counts.select(F.col("genome").alias(g), F.col("windows").alias(f"w_{g}")), g)
    return out.select(*PAIR, (F.col("sum") / (F.col("w_ga") + F.col("w_gb") - F.col("met"))).alias("jaccard"))


def variants(df: DataFrame, column: str = "seq") -> DataFrame:
    """Each letter sequence with itself and all sequences of its length one base away, as ``variant``."""
    s = F.col(column)
    one = F.flatten(F.transform(F.sequence(F.lit(1), F.length(s)), lambda n: F.transform(
        F.array(*(F.lit(c) for c in "ACGT")), lambda c: F.concat(F.substring(s, F.lit(1), n - 1), c, F.substring(s, n + 1, F.length(s))))))
    return df.withColumn("variant", F.explode(F.array_distinct(F.concat(F.array(s), one))))


def approximate_common(landmarks: DataFrame, distance: int = 1) -> DataFrame:
    """``ga, gb, common``: letter sequences of A with one of B within the Hamming distance. One apart by
    exploding variants; beyond, pairs of different letters are found once (``graph.near_pairs``), whatever
    series they are in."""
    from .graph import near_pairs

    kinds = materialise(landmarks.select("genome", "seq").distinct(), "kinds")
    seqs = kinds.select("seq").distinct()
    if distance == 0:
        near = seqs.select("seq", F.col("seq").alias("other"))
    elif distance == 1:
        near = variants(seqs).withColumnRenamed("variant", "other")
    else:
        one = materialise(near_pairs(seqs, distance), "near")
        near = one.toDF("seq", "other").union(one.select("b", "a")).union(seqs.select("seq", "seq"))
    # variants take hundreds of times the bytes they are compressed to, by which a broadcast would be chosen
    reach = near.hint("merge").join(kinds.select(F.col("genome").alias("gb"), F.col("seq").alias("other")), "other").select("seq", "gb").distinct()
    return kinds.join(reach, "seq").filter("genome < gb").groupBy(F.col("genome").alias("ga"), "gb").agg(F.count(F.lit(1)).alias("common"))


def windowed_approximate(landmarks: DataFrame, window: int) -> DataFrame:
    """Mean over windows of 2 * matched A / (|A| + |B|), where a match is within one base."""
    sets = landmarks.select("genome", F.expr(f"gpos div {window}").alias("w"), "seq").distinct()
    sets = materialise(sets.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("genome", "w"))), "sets")
    size = sets.select("genome", "w").distinct()
    b = sets.select(F.col("genome").alias("gb"), "w", F.col("seq").alias("variant"), F.col("n").alias("nb"))
    # variants take hundreds of times the bytes they are compressed to, by which a broadcast would be chosen
    met = variants(sets).hint("merge").join(b, ["w", "variant"]).filter("genome < gb")
    hit = met.select(F.col("genome").alias("ga"), "gb", "w", "seq", F.col("n").alias("na"), "nb").distinct().groupBy(*PAIR, "w", "na", "nb").agg(F.count(F.lit(1)).alias("hit"))
    total = hit.groupBy(*PAIR).agg(F.sum(2 * F.col("hit") / (F.col("na") + F.col("nb"))).alias("sum"))
    counts = size.groupBy("genome").agg(F.count(F.lit(1)).alias("windows"))
    met = size.select(F.col("genome").alias("ga"), "w").join(size.select(F.col("genome").alias("gb"), "w"), "w").filter("ga < gb").groupBy(*PAIR).agg(F.count(F.lit(1)).alias("met"))
    out = total.join(met, PAIR)
    for g in PAIR:
        out = out.join(counts.select(F.col("genome").alias(g), F.col("windows").alias(f"w_{g}")), g)
    return out.select(*PAIR, (F.col("sum") / (F.col("w_ga") + F.col("w_gb") - F.col("met"))).alias("similarity"))
