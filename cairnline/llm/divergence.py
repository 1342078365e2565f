"""Divergence of sources: how far the word use of each source lies from the other sources of its language.

Method: term-block dense matrices. Occurrences are counted in the tasks that read the texts and combined
before they shuffle. The kept terms of a language are dealt into blocks; a block's counts are numpy int64
tiles of groups by terms, in which all pairs of groups are compared by broadcasting. The partial pair
matrices of the blocks are added up, and each group's best terms of every block are merged.

Defined results: null texts, languages and sources are read as empty strings; every row is a document, so
rows that repeat count again, and ids play no part; a group without terms is still a group; a language in
which no term is kept has pairs of value 0 and no terms; an empty table gives no rows; columns other than
``text``, ``lang`` and ``source`` are ignored.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, materialise

#: One letter in, one out: A-Z become a-z, other letters and the bytes of non-ASCII characters stay, all
#: other ASCII characters part the terms.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: p is in parts of this.
UNIT = 1_000_000_000
#: Cells of a tile: groups by terms.
CELLS = 1 << 18
#: Groups of one language that are compared in one tile; more are compared tile by tile.
GROUPS = 256
#: Terms a task holds before it passes its counts on.
HELD = 200_000
#: Bytes of a text that are split at a time.
PIECE = 1 << 20


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; a piece ends where a term does."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            while end < len(text) and PLAIN[text[end]] != 32:
                end += 1
        yield text[at:end].translate(PLAIN).split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
    held: dict[tuple, tuple[Counter, Counter]] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, d) in held.items():
            # the row without a term says that there is such a group
            names = [None, *(t.decode() for t in n)]
            size = len(names)
            cols = [pa.array([lang] * size), pa.array([source] * size), pa.array(names, pa.string()), pa.array([0, *n.values()], pa.int64()), pa.array([0, *(d[t] for t in n)], pa.int64())]
            whole = pa.RecordBatch.from_arrays(cols, schema=schema)
            for at in range(0, size, 20_000):
                yield whole.slice(at, 20_000)
        held.clear()

    size = 0
    for batch in batches:
        langs, sources, texts = (batch.column(k) for k in range(3))
        for k in range(batch.num_rows):
            key = (langs[k].as_py(), sources[k].as_py())
            n, d = held.get(key) or held.setdefault(key, (Counter(), Counter()))
            before, mine = len(n), set()
            for words in terms(texts[k].as_py()):
                n.update(words)
                mine.update(words)
            d.update(mine)
            size += len(n) - before
            if size > HELD:
                yield from rows()
                size = 0
    yield from rows()


def term_counts(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, d``: occurrences of each term in each group, and documents that have it. A
    null term stands for the group itself."""
    text = F.coalesce("text", F.lit("")).cast("binary")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    parts = docs.select(blank("lang"), blank("source"), text.alias("text")).mapInArrow(_count, "lang string, source string, term string, n long, d long")
    # laid out by language and term, so that the term's sum over the sources needs no further shuffle
    return parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def kept_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Cells ``lang, term, source, n, whole`` of the terms kept (``whole``: in the language), and the groups
    ``lang, source, N, at, G, V, all_N`` (``at``: place among the ``G`` sources of the language)."""
    counts = term_counts(docs)
    term = Window.partitionBy("lang", "term")
    counts = counts.withColumns({"whole": F.sum("n").over(term), "df": F.sum("d").over(term)}).filter(F.col("term").isNull() | (F.col("df") >= least))
    counts = materialise(counts.drop("d", "df"), "divergence-counts")
    cells = counts.filter(F.col("term").isNotNull())
    first = cells.groupBy("lang", "term").agg(F.max("whole").alias("whole")).groupBy("lang").agg(F.count(F.lit(1)).alias("V"), F.sum("whole").alias("all_N"))
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("N"))
    lang = Window.partitionBy("lang")
    groups = groups.withColumns({"at": (F.row_number().over(lang.orderBy("source")) - 1).cast("int"), "G": F.count(F.lit(1)).over(lang).cast("int")})
    groups = groups.join(first, "lang", "left").na.fill(0, ["V", "all_N"])
    return cells, materialise(groups, "divergence-groups")


def shares(count: np.ndarray, whole: np.ndarray | int) -> np.ndarray:
    """``floor(UNIT * count / whole)``, exact in int64 for ``whole`` below 9e15: three digits at a time."""
    out, rest = count // whole, count % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def _tile(ranks: int):
    """Compare one tile: groups of two ranges of a language over a block of its terms. Its rows are the
    groups of both ranges (null term, ``n``: N) and the cells; ``left`` counts terms of the block."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        lang, low, high, _ = key
        head = rows["term"].isna().to_numpy()
        top, cells = rows[head].sort_values("at"), rows[~head]
        places, totals = top["at"].to_numpy(np.int64), top["n"].to_numpy(np.int64)
        kinds, all_n, in_block = int(top["V"].iloc[0]), int(top["all_N"].iloc[0]), int(top["left"].iloc[0])
        columns, names = pd.factorize(cells["term"])
        counts = np.zeros((len(places), len(names)), np.int64)
        line = np.searchsorted(places, cells["at"].to_numpy(np.int64))
        counts[line, columns] = cells["n"].to_numpy(np.int64)
        below = np.maximum(totals + 2 * kinds, 1)  # 0 only where no term is kept, and then nothing is summed
        p = 1 + shares(counts + 2, below[:, None])
        # terms of the block that none of these groups has
        p0 = 1 + shares(np.full(len(places), 2, np.int64), below)
        absent = in_block - len(names)
        out = {"lang": [], "a": [], "b": [], "term": [], "value": []}
        mine, theirs = places // GROUPS == low, places // GROUPS == high
        for i in np.flatnonzero(mine):
            other = np.flatnonzero(theirs & (places > places[i]))
            if len(other):
                value = divergence(p[i], p[other]).sum(axis=1) + absent * divergence(p0[i], p0[other])
                out["a"].append(np.full(len(other), places[i]))
                out["b"].append(places[other])
                out["value"].append(value)
        pairs = sum(map(len, out["a"]))
        a, b, value, term = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (out["a"], out["b"], out["value"])] + [[None] * pairs]
        if low == high and len(names):
            q = np.zeros(len(names), np.int64)
            q[columns] = cells["whole"].to_numpy(np.int64)
            q = 1 + shares(q + 2, all_n + 2 * kinds)
            ahead = np.where((counts > 0) & (p > q), divergence(p, q), -1)
            for i in range(len(places)):
                has = np.flatnonzero(ahead[i] >= 0)
                best = heapq.nsmallest(ranks, zip((-ahead[i, has]).tolist(), names[has], strict=True))
                a, b = np.append(a, np.full(len(best), places[i])), np.append(b, np.full(len(best), -1))
                value, term = np.append(value, [-v for v, _ in best]).astype(np.int64), [*term, *(t for _, t in best)]
        return pd.DataFrame({"lang": lang, "a": a, "b": b, "term": pd.Series(term, dtype=object), "value": value})

    return run


def audit(docs: DataFrame, least: int = 10, ranks: int = 10) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has the other sources of the language, all
    ranks; part ``term`` the ``ranks`` terms that set the source most apart from its language.

    ``least``: documents of the language a term must be in to be kept."""
    cells, groups = kept_counts(docs, least)
    langs = groups.groupBy("lang").agg(*(F.max(c).alias(c) for c in ("G", "V", "all_N")))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("V") * F.least("G", F.lit(2 * GROUPS)) / F.lit(CELLS))).cast("int")
    langs = broadcast_if_small(langs.withColumns({"blocks": blocks, "ranges": F.ceil(F.col("G") / GROUPS).cast("int")}))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    own = broadcast_if_small(groups.select("lang", "source", "at"))
    dealt = cells.join(langs.select("lang", "blocks", "ranges"), "lang").join(own, ["lang", "source"])
    dealt = dealt.select("lang", "ranges", block, "at", "term", "n", "whole")
    sizes = cells.join(langs.select("lang", "blocks"), "lang").select("lang", block, "term").distinct().groupBy("lang", "block").agg(F.count(F.lit(1)).alias("left"))
    heads = groups.join(langs.select("lang", "blocks", "ranges"), "lang").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    heads = heads.join(broadcast_if_small(sizes), ["lang", "block"], "left").na.fill(0, ["left"])

    def tiles(df: DataFrame, *cols: str | Column) -> DataFrame:
        """A row for each tile its group is in: its range with every range."""
        mine = F.floor(F.col("at") / GROUPS).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("ranges") - 1)).alias("other")
        return df.select("*", mine.alias("mine"), other).select("lang", F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high"), "block", *cols)

    none = F.lit(None)
    rows = tiles(dealt, "at", "term", "n", "whole", none.cast("long").alias("V"), none.cast("long").alias("all_N"), none.cast("long").alias("left"))
    rows = rows.unionByName(tiles(heads, "at", none.cast("string").alias("term"), F.col("N").alias("n"), none.cast("long").alias("whole"), "V", "all_N", "left"))
    parts = rows.groupBy("lang", "low", "high", "block").applyInPandas(_tile(ranks), "lang string, a int, b int, term string, value long")
    parts = materialise(parts, "divergence-parts")
    name = lambda c, s: broadcast_if_small(groups.select("lang", F.col("at").alias(c), F.col("source").alias(s)))
    half = parts.filter("b >= 0").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    half = half.join(name("a", "source"), ["lang", "a"]).join(name("b", "item"), ["lang", "b"])
    ends = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("e")
    pair = half.select("lang", ends, "value").select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    term = parts.filter("b < 0").join(name("a", "source"), ["lang", "a"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    out = pair.unionByName(term).withColumn("rank", F.row_number().over(order))
    return out.filter((F.col("part") == "pair") | (F.col("rank") <= ranks))
