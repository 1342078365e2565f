"""Evaluation and table-building operators: ranks, votes, best hits, ensembles, intervals, samples."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release, ship
from . import ranges


def truth_rank(hits: DataFrame, keys: list[str], rank: str, match: Column) -> DataFrame:
    """Rank of the first hit that is right, null if none is."""
    return hits.groupBy(*keys).agg(F.min(F.when(match, F.col(rank))).alias("truth_rank"))


def accuracy(rows: DataFrame, level: str, rank: str = "truth_rank", tops: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Shares of queries found among the first k, by level and in all (``ALL``)."""
    level_name = F.when(F.grouping(level) == 1, F.lit("ALL")).otherwise(F.col(level).cast("string"))
    share = [F.avg(F.coalesce((F.col(rank) <= k).cast("int"), F.lit(0))).alias(f"top{k}") for k in tops]
    return rows.rollup(level).agg(level_name.alias("level"), F.count(F.lit(1)).alias("queries"), *share).drop(level)


def consensus(rows: DataFrame, source: str, cluster: str, score: str, shared: str) -> DataFrame:
    """The cluster with most votes of each source, a vote being score * (shared + 1); the larger name
    wins ties."""
    votes = rows.groupBy(source, cluster).agg(F.sum(F.col(score) * (F.col(shared) + 1)).alias("votes"))
    return votes.groupBy(source).agg(F.max_by(cluster, F.struct("votes", cluster)).alias("winner"), F.max("votes").alias("votes"), F.count(F.lit(1)).alias("clusters"))


def mean_of_means(rows: DataFrame, key: str, value: Column) -> DataFrame:
    return rows.groupBy(key).agg(F.avg(value).alias("m")).agg(F.avg("m").alias("mean"), F.count(F.lit(1)).alias("groups"))


def detection(rows: DataFrame, truth: str, found: str, error: str) -> DataFrame:
    """Sensitivity, specificity, false-positive rate, and the upper middle of the errors."""
    t, f = F.col(truth), F.col(found)
    errors = F.array_sort(F.collect_list(F.when(t & f, F.col(error))))
    return rows.agg(
        F.avg(F.when(t, f.cast("int"))).alias("sensitivity"), F.avg(F.when(~t, (~f).cast("int"))).alias("specificity"),
        F.avg(F.when(~t, f.cast("int"))).alias("fpr"), errors.alias("e"),
    ).select("sensitivity", "specificity", "fpr", F.try_element_at("e", F.expr("cast(size(e) div 2 + 1 as int)")).alias("median_error"))


def best_hits(hits: DataFrame, query: str, order: list[str]) -> DataFrame:
    """One hit a query: the largest by the columns of ``order`` in turn. Partial maxima are taken before
    the shuffle, so a query with most of the hits is not one task."""
    rest = [c for c in hits.columns if c != query]
    return hits.groupBy(query).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best")).select(query, "best.*")


def threshold_counts(best: DataFrame, value: str, cuts: list[float]) -> DataFrame:
    grid = F.explode(F.array(*(F.lit(float(c)) for c in cuts))).alias("cut")
    return best.select(value, grid).filter(F.col(value) >= F.col("cut")).groupBy("cut").agg(F.count(F.lit(1)).alias("hits"))


def cluster_bits(hits: DataFrame) -> DataFrame:
    """``qc, tc``: the largest and summed best scores of proteins, and the sum over the root of the
    numbers of proteins. Columns: ``qc, tc, query, target, bits, nq, nt``."""
    best = hits.groupBy("qc", "tc", "query", "target").agg(F.max("bits").alias("bits"), F.max("nq").alias("nq"), F.max("nt").alias("nt"))
    pair = best.groupBy("qc", "tc").agg(F.max("bits").alias("top"), F.sum("bits").alias("total"), F.max("nq").alias("nq"), F.max("nt").alias("nt"))
    return pair.select("qc", "tc", "top", "total", (F.col("total") / F.sqrt(F.col("nq") * F.col("nt"))).alias("scaled"))


def idf(terms: DataFrame, doc: str, term: str) -> DataFrame:
    """Smoothed inverse document frequency ln((1 + n) / (1 + df)) + 1."""
    n = terms.agg(F.countDistinct(doc).alias("n"))
    df = terms.groupBy(term).agg(F.countDistinct(doc).alias("df"))
    return df.join(F.broadcast(n)).select(term, "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def cosine_pairs(terms: DataFrame, doc: str, term: str, common: int | None = None) -> DataFrame:
    """Cosine of idf vectors for pairs of documents that share a term. ``common``: leave out of the
    pairing, not of the norms, terms in more documents than this."""
    w = idf(terms, doc, term)
    v = terms.select(doc, term).distinct().join(w, term)
    norm = v.groupBy(doc).agg(F.sqrt(F.sum(F.col("idf") ** 2)).alias("norm"))
    seed = v if common is None else v.filter(F.col("df") <= common)
    a, b = seed.select(F.col(doc).alias("a"), term, "idf"), seed.select(F.col(doc).alias("b"), term)
    dot = a.join(b, term).filter("a < b").groupBy("a", "b").agg(F.sum(F.col("idf") ** 2).alias("dot"))
    for c in ("a", "b"):
        dot = dot.join(norm.select(F.col(doc).alias(c), F.col("norm").alias(f"n{c}")), c)
    return dot.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine"))


#: Documents of a piece of a frequent term, pairs that a task holds before it packs them, and pairs of a block on average.
PIECE, HELD_PAIRS, BLOCK_PAIRS = 4096, 2_000_000, 3_000_000


def _packed(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> bytes:
    """Pairs in order of ``a, b`` with their weights as compressed bytes, like bytes of all numbers side by side."""
    step = np.diff(a, prepend=0)
    sides = [np.ascontiguousarray(x.astype("<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in (step, b)]
    return len(a).to_bytes(8, "little") + pa.Codec("zstd").compress(b"".join(sides) + w.tobytes(), asbytes=True)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    many = int.from_bytes(raw[:8], "little")
    body = pa.Codec("zstd").decompress(raw[8:], decompressed_size=18 * many, asbytes=True)
    step, b = (np.ascontiguousarray(np.frombuffer(body, np.uint8, 8 * many, 8 * many * n).reshape(8, many).T).view("<i8").ravel() for n in (0, 1))
    return np.cumsum(step), b, np.frombuffer(body, "<f2", many, 16 * many)


def _term_pairs(blocks: int):
    """Pairs of documents of each term, or of two pieces of one, dealt by the smaller document. Weights are rounded upward."""

    def run(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        term = rows["term"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc, w, piece, i, j = (rows[c].to_numpy() for c in ("doc", "w", "piece", "i", "j"))
        order = np.lexsort((doc, j, i, term))
        term, doc, w, piece, i, j = (x[order] for x in (term, doc, w, piece, i, j))
        new = np.append(True, (term[1:] != term[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1]))
        begin = np.flatnonzero(new)
        end = np.repeat(np.append(begin[1:], len(doc)), np.diff(np.append(begin, len(doc))))
        two, held, many = i != j, [], 0

        def flush() -> pa.RecordBatch:
            x, y = (np.concatenate(c) for c in zip(*held, strict=True))
            weight = w[x] * w[y]
            half = weight.astype("<f2")
            half = np.where(half < weight, np.nextafter(half, np.float16(np.inf)), half).astype("<f2")
            block = (((doc[x].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(blocks)).astype(np.int64)
            order = np.lexsort((doc[y], doc[x], block))
            edge = np.searchsorted(block[order], np.arange(blocks + 1)).tolist()
            parts = [(k, order[s:e]) for k, (s, e) in enumerate(zip(edge[:-1], edge[1:], strict=True)) if e > s]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([_packed(doc[x[o]], doc[y[o]], half[o]) for _, o in parts], pa.binary())], ["block", "pairs"])

        live, step = np.arange(len(doc)), 1
        live = live[end - live > 1]
        while len(live):
            for part in np.array_split(live, max(1, -(-len(live) // HELD_PAIRS))):
                x, y = part, part + step
                good = ~two[x] | (piece[x] != piece[y])
                held.append((x[good], y[good]))
                many += int(good.sum())
                if many >= HELD_PAIRS:
                    yield flush()
                    held, many = [], 0
            step += 1
            live = live[end[live] - live > step]
        if many:
            yield flush()

    def each(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.Table.from_batches(list(batches)))
        release()

    return each


def _reaching(least: float):
    """Pairs of one block whose weights, rounded upward, reach the threshold."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, w = (np.concatenate(c) for c in zip(*(_unpacked(raw) for batch in batches for raw in batch.column("pairs").to_pylist()), strict=True))
        order = np.lexsort((b, a))
        a, b, w = a[order], b[order], w[order].astype(np.float64)
        begin = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        kept = begin[np.add.reduceat(w, begin) * (1 + 1e-9) >= least]
        yield pa.RecordBatch.from_arrays([pa.array(a[kept], pa.int64()), pa.array(b[kept], pa.int64())], ["a", "b"])
        release()

    return run


def cosine_above(terms: DataFrame, doc: str, term: str, least: float, most_broadcast: int = 200_000) -> DataFrame:
    """``a, b, cosine`` of idf vectors for all pairs of documents, named by whole numbers, that reach ``least``, which is above 0.

    Pairs that share a term travel once, packed, a few bytes each, with weights rounded upward; those whose weights
    reach the threshold are computed exactly. A frequent term is cut into pieces, and each two of them meet."""
    ship(terms.sparkSession)
    t = materialise(terms.select(F.col(doc).cast("long").alias("doc"), F.col(term).alias("term")).na.drop(subset=["doc"]).distinct(), "terms")
    n = t.agg(F.countDistinct("doc")).first()[0]
    df = t.filter("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf_ = F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1
    v = t.join(df, "term").withColumn("idf", idf_).withColumn("norm", F.sqrt(F.sum(F.col("idf") ** 2).over(Window.partitionBy("doc"))))
    v = materialise(v, "vectors")
    rows, pairs = (int(x or 0) for x in df.agg(F.sum("df"), F.sum(F.col("df") * (F.col("df") - 1) / 2)).first())
    blocks = max(1, -(-pairs // BLOCK_PAIRS))
    tasks = max(blocks, -(-rows // 1_000_000), min(16, rows // 10_000))
    pieces = F.ceil(F.col("df") / PIECE).cast("int")
    piece = F.pmod(F.xxhash64("doc"), pieces).cast("int")
    each = v.filter("df > 1").select("term", "doc", (F.col("idf") / F.col("norm")).alias("w"), piece.alias("piece"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("o"))
    each = each.select("term", "doc", "w", "piece", F.least("piece", "o").alias("i"), F.greatest("piece", "o").alias("j"))
    each = each.withColumn("deal", F.pmod(F.xxhash64("term", "i", "j"), F.lit(tasks)).cast("int")).repartition(tasks, "deal")
    met = each.groupBy("deal").applyInArrow(_term_pairs(blocks), "block int, pairs binary")
    found = materialise(met.repartition(blocks, "block").groupBy("block").applyInArrow(_reaching(least), "a long, b long"), "pairs")
    ids = materialise(found.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "docs")
    ids = F.broadcast(ids) if ids.limit(most_broadcast + 1).count() <= most_broadcast else ids
    some = materialise(v.join(ids, "doc", "left_semi").select("doc", "term", "idf", "norm"), "some")
    a, b = (some.select(F.col("doc").alias(c), "term", *(["idf"] if c == "a" else []), F.col("norm").alias(f"n{c}")) for c in "ab")
    dot = found.join(a, "a").join(b, ["b", "term"]).groupBy("a", "b").agg(F.sum(F.col("idf") ** 2).alias("dot"), F.max("na").alias("na"), F.max("nb").alias("nb"))
    return dot.select("a", "b", (F.col("dot") / (F.col("na") * F.col("nb"))).alias("cosine")).filter(F.col("cosine") >= least)


def ensemble(parts: list[tuple[DataFrame, float]], query: str, target: str, score: str) -> DataFrame:
    """Weighted sum of scores, each over its query's largest; missing scores count as 0."""
    rows = None
    for df, weight in parts:
        top = F.max(score).over(Window.partitionBy(query))
        one = df.select(query, target, F.when(top > 0, weight * F.col(score) / top).otherwise(0.0).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(query, target).agg(F.sum("part").alias("score"))


def collapse_to_label(scored: DataFrame, query: str, label: str, score: str = "score") -> DataFrame:
    best = scored.groupBy(query, label).agg(F.max(score).alias(score))
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), label)))


def fusions(pairs: DataFrame) -> DataFrame:
    """Sum, mean and logarithm of ``bits`` over the pair's hits, plus the token score, as candidates for
    ranking. Columns: ``q, t, bits, tokens``."""
    g = pairs.groupBy("q", "t").agg(F.sum("bits").alias("sum_bits"), F.avg("bits").alias("mean_bits"), F.max("tokens").alias("tokens"))
    return g.withColumns({"log_bits": F.log1p("sum_bits"), "fused": F.log1p("sum_bits") + 10 * F.col("tokens")})


def rescue(tokens: DataFrame, proteins: DataFrame, query: str, target: str) -> DataFrame:
    """The token search's answer where there is one, else the protein search's."""
    a, b = tokens.select(query, F.col(target).alias("_t")), proteins.select(query, F.col(target).alias("_p"))
    return a.join(b, query, "full").select(query, F.coalesce("_t", "_p").alias(target), F.when(F.col("_t").isNotNull(), "tokens").otherwise("proteins").alias("by"))


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99), by: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return df.groupBy(*(by or [])).agg(*(F.percentile(value, F.lit(s)).alias(f"p{round(s * 100):02d}") for s in shares), F.count(value).alias("n"))


def evenly_spaced(df: DataFrame, keys: list[str], order: list[str], most: int) -> DataFrame:
    """At most ``most`` rows of each group, evenly spaced from the first to the last."""
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_r", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    m = F.least(F.col("_n"), F.lit(most))
    at = F.transform(F.sequence(F.lit(0), (m - 1).cast("int")), lambda i: F.when(m <= 1, 0).otherwise(F.floor(i * (F.col("_n") - 1) / (m - 1) + 0.5)))
    return rows.filter(F.array_contains(at, F.col("_r").cast("bigint"))).drop("_r", "_n")


def pick_best(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def fragments(contigs: DataFrame, sizes: list[int], least: int = 100) -> DataFrame:
    """Contigs cut into pieces of each size; contigs shorter than the size, and last pieces under
    ``least``, are left out."""
    cut = contigs.withColumn("size", F.explode(F.array(*(F.lit(s) for s in sizes)))).filter(F.length("seq") >= F.col("size"))
    cut = cut.withColumn("piece", F.explode(F.expr("sequence(0, cast((length(seq) - 1) div size as int))")))
    return cut.withColumn("begin", F.col("piece") * F.col("size")).withColumn("seq", F.expr("substring(seq, begin + 1, size)")).filter(F.length("seq") >= least)


def containment_first(inner: DataFrame, outer: DataFrame, key: str, width: int = 10_000) -> DataFrame:
    """``inner`` (key, id, start, end) with the first ``outer`` (key, region, rs, re) that contains it.
    Joined on coordinate bins, so no nested loop: an interval starts in one bin, a region covers some."""
    bins = outer.withColumn("_b", F.explode(F.expr(f"sequence(rs div {width}, re div {width})")))
    hit = inner.withColumn("_b", F.expr(f"start div {width}")).join(bins, [key, "_b"]).filter((F.col("start") >= F.col("rs")) & (F.col("end") <= F.col("re")))
    return hit.groupBy(key, "id").agg(F.min_by("region", F.struct("rs", "region")).alias("region"))


def overlap_best(left: DataFrame, right: DataFrame, key: list[str], width: int = 10_000) -> DataFrame:
    """For each left interval (id, s1, e1) the right one (gene_id, s2, e2) of its key that overlaps most;
    the larger id wins ties. Joined on the bins both touch; a pair counts in the bin where the later of
    the two begins."""
    binned = lambda t, s, e: t.withColumn("_b", F.explode(F.sequence(F.floor(F.col(s) / width), F.floor(F.greatest(s, e) / width))))
    both = binned(left, "s1", "e1").join(binned(right, "s2", "e2"), [*key, "_b"]).filter((F.col("s1") <= F.col("e2")) & (F.col("s2") <= F.col("e1")))
    both = both.filter(F.col("_b") == F.floor(F.greatest("s1", "s2") / width)).drop("_b")
    both = both.withColumn("overlap", F.least("e1", "e2") - F.greatest("s1", "s2") + 1)
    return both.groupBy(*key, "id").agg(F.max_by("gene_id", F.struct("overlap", "gene_id")).alias("gene_id"), F.max("overlap").alias("overlap"))


def by_digest(left: DataFrame, right: DataFrame, letters: str, name: str) -> DataFrame:
    """Left rows with the first name of an equal letter sequence on the right, by its SHA-256."""
    first = right.select(F.sha2(letters, 256).alias("_d"), name).groupBy("_d").agg(F.min(name).alias(name))
    return left.withColumn("_d", F.sha2(letters, 256)).join(first, "_d", "left").drop("_d")


def fill_blank(df: DataFrame, more: DataFrame, key: str, columns: list[str], overwrite: bool = False) -> DataFrame:
    """Columns of ``df`` filled from ``more`` where blank, or replaced where ``more`` has a value."""
    side = more.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    out = df.join(side, key, "left")
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    pick = lambda c: F.when(~blank(f"_{c}"), F.col(f"_{c}")).otherwise(F.col(c)) if overwrite else F.when(blank(c), F.coalesce(f"_{c}", c)).otherwise(F.col(c))
    return out.withColumns({c: pick(c) for c in columns}).drop(*(f"_{c}" for c in columns))


def split_held_out(rows: DataFrame, held: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    return rows.join(held, key, "left_semi"), rows.join(held, key, "left_anti")


def hash_sample(rows: DataFrame, key: str, most: int, seed: str = "") -> DataFrame:
    """``most`` rows in the order of a digest of the key: the same on every run."""
    return rows.orderBy(F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256), key).limit(most)


def recut(manifest: DataFrame, contigs: DataFrame) -> DataFrame:
    """Fragments ``genome, name, start, end`` (on the series) cut from contigs ``genome, name, offset,
    seq``, clamped to them."""
    both = manifest.join(contigs, ["genome", "name"])
    low = F.greatest(F.col("start") - F.col("offset"), F.lit(0))
    high = F.least(F.col("end") - F.col("offset"), F.length("seq"))
    return both.withColumn("_l", low.cast("int")).withColumn("_h", high.cast("int")).filter("_h > _l").withColumn("fragment", F.expr("substring(seq, _l + 1, _h - _l)")).select("genome", "name", "start", "end", "fragment")


def sweep(values: DataFrame, value: str, cuts: range, flags: dict[str, Column]) -> DataFrame:
    """Counts at every threshold in one pass: rows with at least so much, and of those each flag."""
    grid = values.select(value, *(f.alias(n) for n, f in flags.items()), F.explode(F.sequence(F.lit(cuts.start), F.least(F.col(value), F.lit(cuts.stop - 1)).cast("int"))).alias("least")).filter(F.col(value) >= cuts.start)
    return grid.groupBy("least").agg(F.count(F.lit(1)).alias("anchored"), *(F.count_if(n).alias(n) for n in flags))


def nearest_first(places: list[int], found: list[int], truth: list[int], tolerance: int) -> tuple[int, int]:
    """Matches and their summed errors on one stretch, nearest first, of two as near the one with the smaller
    found place. ``places`` grow; ``found`` and ``truth`` count the copies at each. The nearest pair left is always
    one of neighbours, so a heap of neighbours suffices."""
    f, t = list(found), list(truth)
    matched = error = 0
    for n in range(len(places)):
        same = min(f[n], t[n])
        f[n], t[n], matched = f[n] - same, t[n] - same, matched + same
    left = [n for n in range(len(places)) if f[n] or t[n]]
    ahead = dict(zip(left, left[1:], strict=False))
    behind = {b: a for a, b in ahead.items()}
    heap: list[tuple[int, int, int]] = []

    def meet(a: int | None, b: int | None) -> None:
        if a is None or b is None or places[b] - places[a] > tolerance:
            return
        if f[a] and t[b]:
            heapq.heappush(heap, (places[b] - places[a], a, b))
        elif t[a] and f[b]:
            heapq.heappush(heap, (places[b] - places[a], b, a))

    for a, b in ahead.items():
        meet(a, b)
    while heap:
        d, x, y = heapq.heappop(heap)
        many = min(f[x], t[y])
        if not many:
            continue
        f[x], t[y], matched, error = f[x] - many, t[y] - many, matched + many, error + d * many
        for n in (x, y):
            if not f[n] and not t[n]:
                a, b = behind.pop(n, None), ahead.pop(n, None)
                if a is not None:
                    ahead.pop(a, None)
                if b is not None:
                    behind.pop(b, None)
                if a is not None and b is not None:
                    ahead[a], behind[b] = b, a
                    meet(a, b)
    return matched, error


def greedy_matches(found: DataFrame, truth: DataFrame, key: str, tolerance: int, parts: int | None = None) -> DataFrame:
    """One-to-one matches of found to true places within the tolerance, nearest first, by key: ``matched,
    false_pos, missed, error`` (summed). Rows without a place match nothing.

    No match crosses two neighbouring places further apart than the tolerance, so each key is cut there, in
    ranges, and the stretches are matched on their own, many in a batch. Equal places are one row with its counts;
    a stretch is as long as its places lie near each other."""
    ship(found.sparkSession)
    both = found.select(key, "pos", F.lit(1).alias("f"), F.lit(0).alias("t")).unionByName(truth.select(key, "pos", F.lit(0).alias("f"), F.lit(1).alias("t")))
    places = materialise(both.groupBy(key, "pos").agg(F.sum("f").alias("f"), F.sum("t").alias("t")), "places")
    rows = ranges.before(ranges.ranged(places.filter("pos IS NOT NULL"), [key], ["pos"], parts), [key], ["pos"], {"_last": F.col("pos")})
    # the stretch is named by how many cuts lie before it
    cut = F.when(F.col("pos") - F.col("_last") <= tolerance, 0).otherwise(1)
    rows = ranges.so_far(rows.withColumn("_cut", cut), [key], ["pos"], F.col("_cut"), "_stretch")
    stretch = rows.groupBy(key, "_stretch").agg(F.array_sort(F.collect_list(F.struct("pos", "f", "t"))).alias("s"), F.sum("f").alias("_f"), F.sum("t").alias("_t")).filter("_f > 0 AND _t > 0")

    @F.pandas_udf("matched long, error long")
    def match(pos: pd.Series, f: pd.Series, t: pd.Series) -> pd.DataFrame:
        got = [nearest_first(p.tolist(), a.tolist(), b.tolist(), tolerance) for p, a, b in zip(pos, f, t, strict=True)]
        return pd.DataFrame(got, columns=["matched", "error"], dtype="int64")

    met = stretch.select(key, match("s.pos", "s.f", "s.t").alias("m"), F.lit(0).cast("long").alias("f"), F.lit(0).cast("long").alias("t")).select(key, "f", "t", "m.matched", "m.error")
    zero = F.lit(0).cast("long")
    all_ = places.select(key, "f", "t", zero.alias("matched"), zero.alias("error")).unionByName(met)
    total = all_.groupBy(key).agg(*(F.sum(c).alias(c) for c in ("f", "t", "matched", "error")))
    return total.select(key, "matched", (F.col("f") - F.col("matched")).alias("false_pos"), (F.col("t") - F.col("matched")).alias("missed"), F.col("error").cast("double").alias("error"))


def alignment_totals(rows: DataFrame) -> DataFrame:
    """Aligned bases of each query on each reference, ranked: ``query, reference, bases, rank``."""
    total = rows.groupBy("query", "reference").agg(F.sum("block").alias("bases"))
    return total.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("bases"), "reference")))


def lcs_lengths(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """``lcs``: longest common subsequence of two array columns, in Arrow batches."""
    ship(pairs.sparkSession)
    from .clusters import longest_common

    @F.pandas_udf("long")
    def lcs(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([longest_common(list(p), list(q)) for p, q in zip(x, y, strict=True)])

    return pairs.withColumn("lcs", lcs(F.col(a), F.col(b)))
