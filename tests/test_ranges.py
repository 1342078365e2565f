"""Windows stitched over ranges, and what is built on them, where one key holds nearly everything."""

import random

import pytest
from pyspark.sql import functions as F

from cairnline.operators import evaluate, ranges, series


def test_neighbours_and_sums(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randrange(9)) for k, n in (("hot", 300), ("b", 3), (None, 20)) for p in rng.sample(range(1000), n)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    for parts in (1, 9):
        r = ranges.ranged(df, ["k"], ["p"], parts)
        got = {(x["k"], x["p"]): (x["was"], x["sum"]) for x in ranges.so_far(ranges.before(r, ["k"], ["p"], {"was": F.col("v")}), ["k"], ["p"], F.col("v"), "sum").collect()}
        want, last, total = {}, {}, {}
        for k, p, v in sorted(rows, key=lambda x: x[1]):
            total[k] = total.get(k, 0) + v
            want[k, p] = (last.get(k), total[k])
            last[k] = v
        assert got == want
    assert ranges.before(ranges.ranged(df.limit(0), ["k"], ["p"]), ["k"], ["p"], {"was": F.col("v")}).count() == 0


def test_file_order_crosses_contigs(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for g, contigs in (("hot", 120), ("b", 2)):
        last = None
        for c in sorted(rng.sample(range(500), contigs)):
            for o in range(rng.randrange(3)):
                rows.append((g, c, o, rng.randrange(5000), rng.choice("ACGT") * 4, "E"))
                at = rows[-1][3]
                want[g, c, o] = None if last is None else max(at - last, 0)
                last = at
    rng.shuffle(rows)
    m = spark.createDataFrame(rows, "genome string, contig_id long, ord long, gpos long, seq string, enzyme string")
    for parts in (1, 7):
        assert {(r["genome"], r["contig_id"], r["ord"]): r["gap"] for r in series.gaps(m, parts).collect()} == want
    pairs, last = set(), {}
    for g, _, _, _, s, _ in sorted(rows):
        if g in last:
            pairs.add((g, *sorted((last[g], s))))
        last[g] = s
    assert {tuple(r) for r in series.raw_pairs(m).collect()} == pairs


def test_n50(spark):
    rng = random.Random(4)
    sizes = [rng.randrange(1, 40) for _ in range(60)]
    got = series.n50(spark.createDataFrame([("g", n) for n in sizes], "genome string, length long")).first()
    want = next(n for k, n in enumerate(sorted(sizes, reverse=True), 1) if 2 * sum(sorted(sizes, reverse=True)[:k]) >= sum(sizes))
    assert (got["n50"], got["contigs"], got["length"]) == (want, 60, sum(sizes))


def plain_matches(x, y, tolerance):
    x, y, used_x, used_y, error = sorted(x), sorted(y), set(), set(), 0
    for d, n, m in sorted((abs(p - q), n, m) for n, p in enumerate(x) for m, q in enumerate(y) if abs(p - q) <= tolerance):
        if n not in used_x and m not in used_y:
            used_x.add(n)
            used_y.add(m)
            error += d
    return len(used_x), len(x) - len(used_x), len(y) - len(used_y), float(error)


@pytest.mark.parametrize("parts", [1, 6])
def test_greedy_matches(spark, parts):
    """Equally spaced places tie in a chain; one key holds most rows; places repeat."""
    rng = random.Random(parts)
    found = {"hot": [rng.randrange(4000) for _ in range(250)], "ties": list(range(0, 400, 20)), "one": [7, 7, 7], "lone": [5], None: [1, 9]}
    truth = {"hot": [rng.randrange(4000) for _ in range(250)], "ties": list(range(10, 400, 20)), "one": [7, 8], "missing": [3], None: [2]}
    df = lambda d: spark.createDataFrame([(k, p) for k, v in d.items() for p in v], "k string, pos long")
    for tolerance in (0, 6, 15):
        got = {r["k"]: (r["matched"], r["false_pos"], r["missed"], r["error"]) for r in evaluate.greedy_matches(df(found), df(truth), "k", tolerance, parts).collect()}
        assert got == {k: plain_matches(found.get(k, []), truth.get(k, []), tolerance) for k in {*found, *truth}}
    none = df({"a": [None, 3]})
    assert [tuple(r)[1:4] for r in evaluate.greedy_matches(none, df({"a": [3]}), "k", 1).collect()] == [(1, 1, 0)]
    assert evaluate.greedy_matches(none.limit(0), none.limit(0), "k", 1).count() == 0
