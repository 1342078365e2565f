"""Scalar functions on landmarks, features and scores, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def revcomp(s: Column, others: str | None = None) -> Column:
    """Reverse complement. ``others``: what any other letter becomes (unchanged if None)."""
    up = F.upper(s)
    if others is not None:
        up = F.regexp_replace(up, "[^ACGT]", others)
    return F.reverse(F.translate(up, "ACGT", "TGCA"))


def canonical(s: Column) -> Column:
    return F.least(s, revcomp(s))


def is_reverse(s: Column) -> Column:
    """Whether a landmark is stored as the reverse complement of its canonical form."""
    return revcomp(s) < s


def is_palindromic(s: Column) -> Column:
    return revcomp(s) == s


def gc_content(s: Column) -> Column:
    return F.when(F.length(s) == 0, 0.0).otherwise(F.length(F.regexp_replace(s, "[^GCgc]", "")) / F.length(s))


def valid_dna(s: Column, ambiguous: bool = False) -> Column:
    return s.rlike("^[ACGTNacgtn]*$" if ambiguous else "^[ACGTacgt]+$")


def base_filter(s: Column) -> Column:
    """Keep only A, C, G, T and N, in upper case; what is dropped shifts later coordinates."""
    return F.upper(F.regexp_replace(s, "[^ACGTNacgtn]", ""))


def hamming(a: Column, b: Column, width: int = 32) -> Column:
    """Differing places of two strings padded to ``width``."""
    x, y = F.rpad(a, width, "_"), F.rpad(b, width, "_")
    return F.size(F.filter(F.sequence(F.lit(1), F.lit(width)), lambda n: F.substring(x, n, F.lit(1)) != F.substring(y, n, F.lit(1))))


def strand(s: Column) -> Column:
    t = F.trim(s)
    return F.when(t.isin("-", "-1"), "-").otherwise("+")


def clean_field(s: Column) -> Column:
    """Trimmed, without trailing commas; null when nothing is left."""
    t = F.regexp_replace(F.trim(s), ",+$", "")
    return F.when(F.length(t) > 0, t)


TOKEN_COLUMNS = (("ko", "KO"), ("pfam", "PFAM"), ("cog", "COG"), ("eggnog", "EGGNOG"), ("smash_tool", "SMASH"))


def feature_tokens(columns: dict[str, Column], product: Column) -> Column:
    """Distinct functional tokens of a feature: annotations by kind, and the product's first words."""
    def of(name: str, prefix: str) -> Column:
        items = F.transform(F.split(F.coalesce(columns[name], F.lit("")), r"[;,|]"), lambda x: F.upper(F.trim(x)))
        return F.transform(F.filter(items, lambda x: F.length(x) > 0), lambda x: F.concat(F.lit(prefix + ":"), x))

    parts = [of(name, prefix) for name, prefix in TOKEN_COLUMNS if name in columns]
    words = F.filter(F.split(F.lower(F.coalesce(product, F.lit(""))), "[^a-z0-9]+"), lambda w: (F.length(w) > 0) & ~w.isin("protein", "hypothetical"))
    label = F.array_join(F.slice(words, 1, 4), "_")
    parts.append(F.when(F.length(label) > 0, F.array(F.concat(F.lit("PRODUCT:"), label))).otherwise(F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def token_weight(token: Column) -> Column:
    kind = F.split_part(token, F.lit(":"), F.lit(1))
    return F.when(kind.isin("KO", "EGGNOG", "SMASH"), 3.0).when(kind.isin("PFAM", "COG", "AMRCLASS"), 2.0).otherwise(1.0)


def placement_score(shared: Column, adjacency: Column, coverage: Column, consistency: Column, interior: Column, closeness: Column) -> Column:
    s = shared * 0.15 + adjacency * 0.30 + coverage * 0.30 + consistency * 0.10 + interior * 0.10 + closeness * 0.05
    return F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0))


# Query length from, least shared landmarks, least shared adjacencies.
SUPPORT = ((500_000, 25, 15), (100_000, 15, 8), (50_000, 10, 5), (10_000, 5, 2))


def support_thresholds(length: Column) -> tuple[Column, Column]:
    """Least shared landmarks and adjacencies for a query of this length."""
    tags = pairs = F.lit(0)
    for least, t, p in reversed(SUPPORT):
        tags, pairs = F.when(length >= least, t).otherwise(tags), F.when(length >= least, p).otherwise(pairs)
    return tags, pairs


def confidence(score: Column, tags: Column, pairs: Column, length: Column) -> Column:
    t, p = support_thresholds(length)
    return (
        F.when((score >= 0.80) & (tags >= t) & (pairs >= p), "high").when(score >= 0.65, "medium")
        .when((score >= 0.50) & (length >= 10_000), "low").otherwise("exploratory")
    )


def mash_distance(jaccard: Column, k: int) -> Column:
    return F.when(jaccard <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), -F.ln(2 * jaccard / (1 + jaccard)) / k))


def stable_hash(s: Column) -> Column:
    """The first twelve hexadecimal digits of SHA-256 as a number."""
    return F.conv(F.substring(F.sha2(s.cast("string"), 256), 1, 12), 16, 10).cast("long")


def slug(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(s), "[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")


def location_bounds(s: Column) -> tuple[Column, Column]:
    """Smallest and largest coordinate of a feature location such as ``[10:200](+)`` or a join of them."""
    numbers = F.transform(F.regexp_extract_all(s, F.lit(r"(\d+)"), 1), lambda x: x.cast("long"))
    return F.array_min(numbers), F.array_max(numbers)


def pfam_ids(s: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(s, F.lit(r"(PF\d{5})"), 1))


def class_terms(s: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(s, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def parse_size(text: str) -> int:
    """``50kb`` is 50 * 1024, ``2mb`` 2 * 1024 * 1024."""
    t = text.strip().lower()
    for ending, unit in (("kbp", 1024), ("mbp", 1024**2), ("kb", 1024), ("mb", 1024**2), ("bp", 1)):
        if t.endswith(ending):
            return int(float(t[: -len(ending)]) * unit)
    return int(t)


# What a header says of a circular molecule.
CIRCULAR = ("circular=true", "circular=yes", "suggestcircular=yes", "topology=circular", "completeness=complete circular")


def circular_header(header: Column) -> Column:
    """Whether a sequence header declares a circular molecule."""
    h = F.lower(header)
    declared = F.lit(False)
    for key in CIRCULAR:
        declared = declared | F.contains(h, F.lit(key))
    denied = F.contains(h, F.lit("circular=false")) | F.contains(h, F.lit("circular=no"))
    return declared | (F.array_contains(F.split(h, "[^a-z0-9]+"), "circular") & ~denied)
