"""Personal data in texts: regular expressions propose spans, checks confirm them, words nearby adjust the
score. Native: Spark functions only.

Four kinds are found wherever their form and check hold (``base``): email, ip (four parts up to 255), card
(14 to 19 digits, Luhn), phone (10 to 15 digits after a plus). More are added if their score reaches
``LEAST``: iban (mod-97), ssn and tel (forms that other numbers share, so only beside words that name them) and
mail (spelled-out addresses).

The patterns find what the plain ones in their comments find, leftmost and without overlap, but are possessive
and begin only where a run of their letters does (or where the last match ended): a run that fails from
its start fails from inside as well, so long runs cost no more than their length. No Spark function gives the
places of all matches; they follow from the lengths of the matches and of the pieces between them, added up in
chunks, so that texts with very many matches stay cheap.

Defined results: a null text is empty and has no spans; whole texts are read; every row has its result, rows
that repeat too; spans of different kinds may overlap; places count code points; ids, languages and further
columns play no part and stay as they are, but for a column named ``pii``, which is replaced; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points on each side that are looked at for words.
NEAR = 40
#: Score from which spans that are not ``base`` are kept.
LEAST = 0.5
#: Matches whose places are added up in one go.
CHUNK = 128


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _digit_count(low: int, high: int) -> Callable[[Column], Column]:
    return lambda m: F.length(_digits(m)).between(low, high)


def mod97(code: Column) -> Column:
    """The check number of an account code: its first four characters go last, letters count from 10."""
    code = F.concat(F.substr(code, F.lit(5)), F.substring(code, 1, 4))

    def add(sum_: Column, at: Column) -> Column:
        c = F.ascii(F.substr(code, at, F.lit(1)))
        return F.when(c <= 57, (sum_ * 10 + c - 48) % 97).otherwise((sum_ * 100 + c - 55) % 97).cast("long")

    return F.aggregate(F.sequence(F.lit(1), F.length(code)), F.lit(0).cast("long"), add)


def _iban(m: Column) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    return F.length(bare).between(15, 34) & (mod97(bare) == 1)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    #: A cheap sign that the pattern can match at all.
    sign: Callable[[Column], Column]
    valid: Callable[[Column], Column]
    base: bool
    score: float
    #: Words nearby that raise or lower the score by ``by``.
    up: str
    down: str = ""
    by: float = 0.2


LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
CALL = "tel|phone|telephone|telefon|teléfono|téléphone|mobile|mobil|móvil|cell|fax|call"

#: As listed: their order parts spans that begin at one place.
KINDS = [
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind("email", rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++", lambda t: t.contains("@"), lambda m: F.lit(True), True, 0.9, "e-?mail|mail|contact|write", by=0.1),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]"), lambda m: m.rlike(rf"\A{OCTET}(?:\.{OCTET}){{3}}\z"), True, 0.7, "ip|server|host|address|login|client", "version|release|build|section|chapter"),
    # [0-9]([\x20-]?[0-9])+
    Kind("card", r"[0-9](?:[\x20-]?[0-9])++", lambda t: t.rlike("[0-9][0-9 -]{12}"), lambda m: F.length(_digits(m)).between(14, 19) & F.call_function("luhn_check", _digits(m)), True, 0.8, "card|credit|visa|mastercard|karte|carte|tarjeta|payment", "order|serial|isbn|tracking"),
    # \+[0-9][\x20().0-9-]+[0-9]
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+"), _digit_count(10, 15), True, 0.75, CALL),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}"), _iban, False, 0.8, "iban|account|bank|konto|compte|cuenta"),
    Kind("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", lambda t: t.rlike("[0-9]-[0-9]{2}-[0-9]"), lambda m: ~m.rlike("^(?:000|666|9)|-00-|-0000$"), False, 0.35, "ssn|social security|sozialversicherung|seguridad social|sécurité sociale", by=0.4),
    Kind("tel", r"(?<![0-9A-Za-z+().-])(?<!\+[0-9]{1,3} )\(?[0-9]{2,4}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![0-9A-Za-z-])", lambda t: t.rlike("[0-9]{2}[ )./-]{1,2}[0-9]{3}"), _digit_count(9, 12), False, 0.3, CALL, "order|isbn|invoice", 0.3),
    Kind("mail", rf"(?<!{LOCAL}){LOCAL}{{1,64}}+ ?[\[(] ?(?:at|AT) ?[\])] ?{LABEL}{{1,63}}+(?: ?[\[(] ?(?:dot|DOT) ?[\])] ?{LABEL}{{1,63}}+)++", lambda t: t.rlike(r"[\[(] ?(?:at|AT) ?[\])]"), lambda m: F.lit(True), False, 0.6, "e-?mail|mail|contact"),
]


def _score(kind: Kind, near: Column) -> Column:
    word = lambda words: near.rlike(rf"(?iu)(?<!\p{{L}})(?:{words})(?!\p{{L}})").cast("int")
    score = F.lit(kind.score) + kind.by * word(kind.up) - (kind.by * word(kind.down) if kind.down else F.lit(0.0))
    return F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3)


def _places(cells: Column) -> Column:
    """``cells`` of ``gap`` and ``width`` with the place of each: added up inside chunks of ``CHUNK`` and over
    the chunks, since an array that grows by one is copied each time."""
    long = lambda v: F.lit(v).cast("long")
    starts = F.sequence(long(0), F.floor((F.size(cells) - 1) / CHUNK))
    chunks = F.when(F.size(cells) > 0, F.transform(starts, lambda k: F.slice(cells, (k * CHUNK + 1).cast("int"), F.lit(CHUNK)))).otherwise(F.array())
    total = lambda c: F.aggregate(c, long(0), lambda a, x: a + x["gap"] + x["width"])
    offsets = F.aggregate(
        chunks, F.struct(long(0).alias("at"), F.array().cast("array<bigint>").alias("all")),
        lambda a, c: F.struct((a["at"] + total(c)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"],
    )

    def inside(chunk: Column, offset: Column) -> Column:
        none = F.array().cast("array<bigint>")
        return F.aggregate(
            chunk, F.struct(offset.alias("at"), none.alias("all")),
            lambda a, x: F.struct((a["at"] + x["gap"] + x["width"]).alias("at"), F.concat(a["all"], F.array(a["at"] + x["gap"])).alias("all")), lambda a: a["all"],
        )

    return F.flatten(F.zip_with(chunks, offsets, inside))


SPAN = "struct<start: bigint, k: int, end: bigint, kind: string, text: string, score: double, base: boolean>"


def _spans(k: int, kind: Kind, cells: Column) -> Column:
    """The spans of one kind that hold; none where ``cells`` is null."""

    def span(x: Column, at: Column) -> Column:
        return F.struct(
            at.alias("start"), F.lit(k).alias("k"), (at + x["width"]).alias("end"), F.lit(kind.name).alias("kind"), x["m"].alias("text"), _score(kind, x["near"]).alias("score"),
            F.lit(kind.base).alias("base"), kind.valid(x["m"]).alias("valid"),
        )

    good = F.filter(F.zip_with(cells, _places(cells), span), lambda s: s["valid"] & (s["base"] | (s["score"] >= LEAST)))
    return F.coalesce(F.when(cells.isNotNull(), F.transform(good, lambda s: s.dropFields("valid"))), F.array().cast(f"array<{SPAN}>"))


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``pii``: an array of ``start, k, end, kind, text, score, base`` in order of the start and
    the kind's place in ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    own = [c for c in docs.columns if c != "pii"]
    none = F.array().cast("array<string>")
    p = lambda what, k: f"_pii_{what}_{KINDS[k].name}"
    step = docs.withColumn("_pii_text", text)
    whole = F.col("_pii_text")
    # each step's arrays are read more than once in the next, so that they are computed once and kept
    cut = {}
    for k, kind in enumerate(KINDS):
        sign = kind.sign(whole)
        cut[p("between", k)] = F.when(sign, F.split(whole, kind.pattern, -1)).otherwise(none)
        cut[p("found", k)] = F.when(sign, F.regexp_extract_all(whole, F.lit(kind.pattern), F.lit(0))).otherwise(none)
    step = step.withColumns(cut)
    cells = {}
    for k in range(len(KINDS)):
        between, found = F.col(p("between", k)), F.col(p("found", k))
        after = F.slice(between, F.lit(2), F.greatest(F.size(between) - 1, F.lit(0)))
        zipped = F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("before"), after.alias("after"))
        cell = lambda x: F.struct(
            F.length(x["before"]).cast("long").alias("gap"), F.length(x["m"]).cast("long").alias("width"), x["m"].alias("m"),
            F.concat(F.substring(x["before"], -NEAR, NEAR), F.lit(" "), F.substring(x["after"], 1, NEAR)).alias("near"),
        )
        # an array without matches needs no work; most texts have none
        cells[p("cells", k)] = F.when(F.size(found) > 0, F.transform(zipped, cell))
    step = step.withColumns(cells)
    spans = [_spans(k, kind, F.col(p("cells", k))) for k, kind in enumerate(KINDS)]
    return step.select(*own, F.array_sort(F.flatten(F.array(*spans))).alias("pii"))


def spelled(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts and digest of the base spans, and all spans spelled out."""
    found = find(docs.select("doc_id", "text"))
    base = F.filter("pii", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(count(k.name) for k in KINDS if k.base), F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("pii")).alias("spans"))
