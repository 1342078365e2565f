"""Motifs that select landmarks, as data."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Name, landmark length, pattern read on the forward strand, pattern read on the reverse
# strand. A number stands for so many arbitrary bases; other letters are IUPAC codes.
PATTERNS = """
BcgI   32 10 CGA 6 TGC 10    | 10 GCA 6 TCG 10
AlfI   32 10 GCA 6 TGC 10    |
AloI   27 7 GAAC 6 TCC 7     | 7 GGA 6 GTTC 7
BaeI   28 10 AC 4 GTAY 8     | 7 GRTAC 16
BplI   27 8 GAG 5 CTC 8      |
BsaXI  27 9 AC 5 CTCC 7      | 7 GGAG 5 GT 9
BslFI  25 6 GGGAC 14         | 14 GTCCC 6
Bsp24I 27 8 GAC 6 TGG 7      | 7 CCA 6 GTC 8
CjeI   28 8 CCA 6 GT 9       | 9 AC 6 TGG 8
CjePI  27 7 CCA 7 TC 8       | 8 GA 7 TGG 7
CspCI  33 11 CAA 5 GTGG 10   | 10 CCAC 5 TTG 11
FalI   27 8 AAG 5 CTT 8      |
HaeIV  27 7 GAY 5 R 11       | 9 GAY 5 R 9
Hin4I  27 8 GAY 5 V 10       | 8 GAB 5 R 10
PpiI   27 7 GAAC 5 CTC 8     | 8 GAG 5 GTTC 7
PsrI   27 7 GAAC 6 TAC 7     | 7 GTA 6 GTTC 7
"""
IUPAC = {"R": "[AG]", "Y": "[CT]", "V": "[ACG]", "B": "[CGT]", "N": "[ACGT]"}
SKETCH = "FracMinHash"


@dataclass(frozen=True)
class Enzyme:
    order: int
    name: str
    length: int
    forward: str
    reverse: str | None

    @property
    def patterns(self) -> list[tuple[str, str]]:
        return [("+", self.forward)] + ([("-", self.reverse)] if self.reverse else [])


def _compile(text: str) -> str | None:
    parts = [f"[ACGT]{{{p}}}" if p.isdigit() else "".join(IUPAC.get(c, c) for c in p) for p in text.split()]
    return "".join(parts) or None


def _catalog() -> dict[str, Enzyme]:
    out = {}
    for n, line in enumerate(PATTERNS.strip().splitlines()):
        head, _, second = line.partition("|")
        name, length, first = head.split(None, 2)
        out[name] = Enzyme(n, name, int(length), _compile(first), _compile(second))
    return out


ENZYMES = _catalog()


def enzyme_list(text: str) -> list[Enzyme]:
    """``all`` or names separated by commas, whatever their case."""
    if text.strip().lower() == "all":
        return list(ENZYMES.values())
    by = {k.lower(): v for k, v in ENZYMES.items()}
    try:
        return [by[n.strip().lower()] for n in text.split(",") if n.strip()]
    except KeyError as e:
        raise ValueError(f"unknown enzyme {e.args[0]}") from None


def landmark_mode(text: str) -> str:
    mode = text.strip().lower()
    if mode in ("2brad", "enzyme", "digest"):
        return "enzyme"
    if mode in ("fracminhash", "fmh", "sketch", "kmer"):
        return "sketch"
    raise ValueError(f"unknown landmark mode {text}")


def catalog_table(spark: SparkSession) -> DataFrame:
    rows = [(e.order, e.name, e.length, s, p) for e in ENZYMES.values() for s, p in e.patterns]
    return spark.createDataFrame(rows, "enzyme_order int, enzyme string, tag_length int, strand string, pattern string")


def overlapping(pattern: str) -> re.Pattern[str]:
    return re.compile(f"(?=({pattern}))")
