"""Structural comparison on built series: literals and invariants."""

import pytest

from cairnline.operators import structure
from cairnline.operators.digest import LANDMARKS

COLUMNS = LANDMARKS + ", gpos long"


def letters(n):
    """Pseudo-random 32-mers from a linear congruential generator."""
    out = []
    for i in range(n):
        v, s = i + 1, ""
        for _ in range(32):
            v = (v * 6364136223846793005 + 1442695040888963407) % 2**64
            s += "ACGT"[(v >> 33) % 4]
        out.append(s)
    return out


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def rows(genome, seqs, contigs=None, source="BcgI", step=1000):
    out = []
    for n, s in enumerate(seqs):
        pos = (n + 1) * step
        out.append((genome, contigs[n] if contigs else 0, n, pos, s, source, "+", pos))
    return out


def compare(spark, a, b, **how):
    df = spark.createDataFrame(a + b, COLUMNS)
    table, junctions = structure.structural_pairs(df, **how)
    found = table.collect()
    return (found[0] if found else None), sorted(r["pos"] for r in junctions.collect())


def test_letters():
    assert letters(2) == ["GCAGGTGGCGTGAAGAGTACTCGGCAAACATG", "AGAATTAGCGTGGGAGGCGTAGAGCGTGTTGA"]


S = letters(40)


def flip(seqs, i, j):
    return seqs[:i] + [revcomp(s) for s in reversed(seqs[i:j])] + seqs[j:]


@pytest.mark.parametrize(
    "other, breakpoints, scj, inverted, places",
    [
        (S, 0, 0, 0.0, []),
        (flip(S, 10, 30), 2, 4, 0.5, [10000, 30000]),
        ([revcomp(s) for s in reversed(S)], 0, 0, 0.0, []),
        (S[13:] + S[:13], 0, 0, 0.0, []),
        (S[:5] + S[6:30] + [S[5]] + S[30:], 0, 6, 0.0, []),
        (S[:5] + S[7:30] + S[5:7] + S[30:], 3, 6, 0.0, [5000, 7000, 30000]),
    ],
)
def test_events(spark, other, breakpoints, scj, inverted, places):
    r, at = compare(spark, rows("a", S), rows("b", other))
    assert (r["shared_tags"], r["breakpoints"], r["scj_distance"], r["inverted_fraction"]) == (40, breakpoints, scj, inverted)
    assert at == places and r["circular"]


def test_lost_landmarks_and_fragments(spark):
    kept = [s for n, s in enumerate(S) if n % 3]
    r, _ = compare(spark, rows("a", S), rows("b", kept))
    assert (r["shared_tags"], r["breakpoints"], r["score"]) == (26, 0, 1.0)
    r, _ = compare(spark, rows("a", S), rows("b", S, [n // 14 for n in range(40)]))
    assert (r["breakpoints"], r["scj_distance"], r["observable"], r["circular"]) == (0, 2, 37, False)
    assert round(r["score"], 6) == 0.948718


def test_runs_by_source(spark):
    def close(genome, source):
        return [(genome, 0, n, p, s, source, "+", p) for n, (p, s) in enumerate(zip((10000, 10020, 10035, 20000, 21000, 22000), S, strict=False))]

    assert compare(spark, close("a", "BcgI"), close("b", "BcgI"))[0]["shared_tags"] == 4
    assert compare(spark, close("a", "FracMinHash"), close("b", "FracMinHash"), sketched=True)[0]["shared_tags"] == 6


def test_two_closed_contigs(spark):
    where = [1] * 28 + [2] * 12
    turned = S[9:28] + S[:9] + S[32:] + S[28:32]
    declared = spark.createDataFrame([(g, c) for g in "ab" for c in (1, 2)], "genome string, contig_id long")
    r, _ = compare(spark, rows("a", S, where), rows("b", turned, where), circular=declared)
    assert (r["circular"], r["breakpoints"], r["scj_distance"], r["observable_fraction"]) == (True, 0, 0, 1.0)
    assert compare(spark, rows("a", S, where), rows("b", turned, where))[0]["scj_distance"] == 4


def test_nothing_shared(spark):
    assert compare(spark, rows("a", ["A" * 32]), rows("b", ["C" * 32]))[0] is None


def test_tau(spark):
    df = spark.createDataFrame(rows("a", S) + rows("b", S) + rows("c", S[::-1]), COLUMNS)
    tau = {(r["ga"], r["gb"]): r["tau"] for r in structure.kendall_tau(df).collect()}
    assert tau == {("a", "b"): 1.0, ("a", "c"): -1.0, ("b", "c"): -1.0}


def test_approximate_common(spark):
    near = S[0][:5] + ("A" if S[0][5] != "A" else "C") + S[0][6:]
    df = spark.createDataFrame(rows("a", S[:3]) + rows("b", [near, S[1]]), COLUMNS)
    assert [structure.approximate_common(df, d).first()["common"] for d in (0, 1, 2)] == [1, 2, 2]
