"""Repair of conversations: the cheapest edits that give every conversation a legal order of speakers.

A legal conversation is empty, or an optional system turn and then user and assistant turns in pairs. Turns
may be kept, given another role, deleted, or inserted; blank and repeated turns must be deleted, turns that
break off cost more unless they are.

Method: a forward Viterbi pass over four states of the grammar (nothing yet, system, user, assistant). A
layer carries, for each state, the least (cost, audit string); before the next turn's layer it is closed with
at most two insertions, as more lead back to a state that was cheaper before. Conversations of any length:
turns are range-partitioned by conversation and order, each task runs the pass over its stretches and
yields their transition costs between states, and a conversation's few stretches are joined in order. A
second pass reads the turns in order beside the audit string and gives the repaired turns one by one.

Of two audits of equal cost, order and end state neither is the other's beginning (each ends with the
last turn's edit and has as many edits of turns), so the smaller stays smaller whatever follows: carrying
the least one is exact.

Defined results: null roles and texts, and null ids and turns within the damage's key, read as one space; a
null ``conv_id`` is a conversation of its own; turns are taken in order, null first, ties by role, then by
the SHA-256 of the text; repeated rows are repeated turns; a conversation without turns has zeros, an empty audit and
no repaired turns; an empty table gives no rows; columns other than the four are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a user or assistant turn leads to from each state.
SPEAK = {(START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
STEP = {**SPEAK, (START, "s"): SYSTEM}
NEXT = {state: (after, initial) for (state, initial), after in SPEAK.items()}
ROLE = {"u": "user", "a": "assistant"}
#: Turns of one stretch: a longer conversation is passed over in several.
STRETCH = 50_000

FINE, BLANK, BROKEN, AGAIN = range(4)
ORDER = ["conv_id", "turn", "role", "digest"]


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with known faults: by a checksum of ``conv_id:turn`` a row is dropped (``copies`` 0),
    emptied, stripped of its stops, doubled (``copies`` 2) or given the role of the user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    key = F.concat(space("conv_id"), F.lit(":"), space("turn"))
    kind = F.crc32(key.cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(space("text"), "[.!?]", "")).otherwise(space("text"))
    role = F.when(kind == 4, "user").otherwise(space("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"))


def read_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, digest, copies`` of conversation rows; one copy unless they say so."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    turns = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"), copies.alias("copies"))
    return turns.withColumn("digest", F.unhex(F.sha2("text", 256)))


def faults(turns: DataFrame) -> DataFrame:
    """A row for each different turn with ``fault``, how often it stands there (``n``), and the initial of
    its role; no texts. Turns of 0 copies leave a row for their conversation only (``n`` 0)."""
    word = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    own = F.when(word == "", BLANK).when(~word.rlike("[.!?]"), BROKEN).otherwise(FINE)
    some = F.col("copies") > 0
    flat = turns.select(
        "conv_id", *(F.when(some, F.col(c)).alias(c) for c in ("turn", "role", "digest")), F.when(some, own).alias("own"), F.col("copies").alias("n"),
    )
    flat = materialise(flat.groupBy(*ORDER, "own").agg(F.sum("n").alias("n")), "turns")
    spoken = flat.filter((F.col("n") > 0) & (F.col("own") != BLANK))
    # the same words by the same speaker earlier: known from their first turn, combined before it shuffles
    first = spoken.groupBy("conv_id", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"))
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    again = spoken.join(first, same).withColumn("fault", F.when(F.col("turn").eqNullSafe(F.col("first.turn")), F.col("own")).otherwise(AGAIN))
    rest = flat.filter((F.col("n") == 0) | (F.col("own") == BLANK)).withColumn("fault", F.col("own"))
    cols = [*ORDER, "fault", "n"]
    return again.select(*cols).unionByName(rest.select(*cols)).withColumn("initial", F.substring("role", 1, 1))


class Layer:
    """The least (cost, audit) of each state from one state at the start of the stretch. Audits are
    kept as a byte for each turn and state: the state before, the insertions and the edit."""

    def __init__(self, begin: int):
        # state -> (cost, rank of its audit among the states' audits)
        self.best = {begin: (0, 0)}
        self.path: list[tuple[bytes, int]] = []

    def closed(self) -> dict[int, list[tuple[int, int, int, int]]]:
        """(cost, rank, insertions, state before) that reach each state by at most two insertions."""
        out: dict[int, list] = {s: [] for s in range(4)}
        for state, (cost, rank) in self.best.items():
            at = state
            for times in range(3):
                out[at].append((cost + times * INSERT, rank, times, state))
                at = NEXT[at][0]
        return out

    def turn(self, initial: str, fault: int, n: int) -> None:
        """Take a turn that stands ``n`` times: all but the first are repeats and must go."""
        self.step(initial, fault)
        if n > 1:
            self.best = {s: (c + DELETE * (n - 1), r) for s, (c, r) in self.best.items()}
            self.path[-1] = self.path[-1][0], n - 1

    def step(self, initial: str, fault: int) -> None:
        found: dict[int, list] = {s: [] for s in range(4)}
        broken = TRUNCATED if fault == BROKEN else 0
        for state, ways in self.closed().items():
            for cost, rank, times, before in ways:
                # compared as (cost, audit): audits from one state differ first in what follows it
                lead = "I" * times
                found[state].append((cost + DELETE, rank, lead + "D", before))
                if fault in (FINE, BROKEN):
                    after = STEP.get((state, initial))
                    if after is not None:
                        found[after].append((cost + KEEP + broken, rank, lead + "K", before))
                    found[NEXT[state][0]].append((cost + REROLE + broken, rank, lead + "R", before))
        least = {s: min(ways) for s, ways in found.items() if ways}
        places = {s: k for k, s in enumerate(sorted(least, key=lambda s: least[s][1:3]))}
        self.best = {s: (w[0], places[s]) for s, w in least.items()}
        code = lambda w: w[3] | (len(w[2]) - 1) << 2 | "KRD".index(w[2][-1]) << 4
        self.path.append((bytes(code(least[s]) if s in least else 255 for s in range(4)), 0))

    def audits(self) -> list[tuple[int, int, str]]:
        """(end state, cost, audit) of each state reached."""
        out = []
        for state, (cost, _) in self.best.items():
            parts, at = [], state
            for codes, repeats in reversed(self.path):
                c = codes[at]
                parts.append("I" * (c >> 2 & 3) + "KRD"[c >> 4] + "D" * repeats)
                at = c & 3
            out.append((state, cost, "".join(reversed(parts))))
        return out


STRETCHES = pa.schema([
    ("conv_id", pa.string()), ("task", pa.int32()), ("seq", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()),
    ("distinct", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("first", pa.string()), ("last", pa.string()),
    ("maps", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
])
STRETCHES_DDL = (
    "conv_id string, task int, seq long, blank long, duplicate long, truncated long, illegal long, distinct long, low long, high long, first string, last string, "
    "maps array<struct<begin: int, end: int, cost: long, audit: string>>"
)
#: Of role initials next to each other, those that are legal.
LEGAL = {"su", "ua", "au"}


class Stretch:
    """Turns of one conversation that follow each other in one task."""

    def __init__(self, conv: str | None, seq: int, starts: bool):
        self.conv, self.seq = conv, seq
        self.layers = {b: Layer(b) for b in ((START,) if starts else range(4))}
        self.counts = [0, 0, 0, 0, 0]
        self.low = self.high = self.first = self.last = None
        self.turns = 0

    def take(self, turn: int | None, initial: str, fault: int, n: int) -> None:
        self.turns += 1
        c = self.counts
        c[0] += n if fault == BLANK else 0
        c[1] += n if fault == AGAIN else n - 1 if fault != BLANK else 0
        c[2] += fault == BROKEN
        c[3] += (self.last is not None and self.last + initial not in LEGAL) + n - 1
        if turn is not None and turn != self.high:
            c[4] += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.first, self.last = initial if self.first is None else self.first, initial
        for layer in self.layers.values():
            layer.turn(initial, fault, n)

    def row(self, task: int) -> tuple:
        maps = [{"begin": b, "end": e, "cost": c, "audit": a} for b, layer in self.layers.items() for e, c, a in layer.audits()]
        return (self.conv, task, self.seq, *self.counts, self.low, self.high, self.first, self.last, maps)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _stretches(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq, open_, done, size = TaskContext.get().partitionId(), 0, None, [], 0
        for batch in batches:
            for conv, turn, initial, fault, n in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if open_ is None or conv != open_.conv or open_.turns >= most:
                    # the task's first conversation may have begun elsewhere, and the rest of a long one has
                    starts = open_ is not None and conv != open_.conv
                    if open_ is not None:
                        done.append(open_.row(task))
                        size += sum(len(m["audit"]) for m in done[-1][-1]) + 200
                    open_, seq = Stretch(conv, seq, starts), seq + 1
                    if len(done) >= 2_000 or size > 1 << 22:
                        yield _batch(done, STRETCHES)
                        done, size = [], 0
                if n:
                    open_.take(turn, initial, fault, n)
        if open_ is not None:
            done.append(open_.row(task))
        if done:
            yield _batch(done, STRETCHES)

    return run


def join_maps(best: dict[int, tuple[int, str]], maps: list[dict]) -> dict[int, tuple[int, str]]:
    """The least (cost, audit) of each state after a further stretch."""
    out: dict[int, tuple[int, str]] = {}
    for m in maps:
        if m["begin"] in best:
            cost, audit = best[m["begin"]]
            new = cost + m["cost"], audit + m["audit"]
            if m["end"] not in out or new < out[m["end"]]:
                out[m["end"]] = new
    return out


def close(best: dict[int, tuple[int, str]]) -> tuple[int, str]:
    """The least (cost, audit) that ends a legal conversation."""
    ways = []
    for state, (cost, audit) in best.items():
        at = state
        for times in range(3):
            if at in (START, ASSISTANT):
                ways.append((cost + times * INSERT, audit + "I" * times))
            at = NEXT[at][0]
    return min(ways)


class Conversation:
    """One conversation of the second pass: its stretches come first, then its turns."""

    def __init__(self, conv: str | None):
        self.conv, self.counts, self.best = conv, [0, 0, 0, 0, 0], {START: (0, "")}
        self.low = self.high = self.last = None
        self.cost = self.audit = None
        self.at, self.state, self.lines, self.hash = 0, START, 0, hashlib.sha256()

    def stretch(self, row: dict) -> None:
        if row["first"] is None:
            return
        for k, name in enumerate(("blank", "duplicate", "truncated", "illegal", "distinct")):
            self.counts[k] += row[name]
        self.counts[3] += self.last is not None and self.last + row["first"] not in LEGAL
        self.counts[4] -= row["low"] is not None and row["low"] == self.high
        self.last = row["last"]
        if row["low"] is not None:
            self.low, self.high = row["low"] if self.low is None else self.low, row["high"]
        self.best = join_maps(self.best, row["maps"])

    def settle(self) -> None:
        if self.audit is None:
            self.cost, self.audit = close(self.best)
            self.best = {}

    def _line(self, role: str, text: str, edit: str) -> tuple:
        self.hash.update((("\n" if self.lines else "") + role + ":" + text).encode())
        self.lines += 1
        return self.conv, self.lines - 1, role, text, edit

    def inserted(self) -> Iterator[tuple]:
        while self.audit[self.at : self.at + 1] == "I":
            self.state, initial = NEXT[self.state]
            self.at += 1
            yield self._line(ROLE[initial], "", "I")

    def turn(self, role: str, text: str | None, copies: int) -> Iterator[tuple]:
        """The repaired turns up to this one's copies."""
        self.settle()
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit == "K":
                self.state = STEP[self.state, role[:1]]
                yield self._line(role, text, edit)
            elif edit == "R":
                self.state, initial = NEXT[self.state]
                yield self._line(ROLE[initial], text, edit)

    def end(self) -> Iterator[tuple]:
        self.settle()
        yield from self.inserted()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts[4]
        return (self.conv, gaps, *self.counts[:4], self.cost, self.audit, self.hash.hexdigest())


TURNS = pa.schema([("conv_id", pa.string()), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
REPORT = pa.schema([
    ("conv_id", pa.string()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()),
    ("audit", pa.string()), ("repaired_sha256", pa.string()),
])


def _apply(turns: bool):
    """Second pass over rows sorted by conversation, stretches before turns: repaired turns, or a
    report for each conversation."""
    schema = TURNS if turns else REPORT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, out, size = None, [], 0

        def finish(c: Conversation) -> None:
            lines = list(c.end())
            out.extend(lines if turns else [c.row()])

        for batch in batches:
            convs, kinds, roles, texts, copies, heads = (batch.column(k) for k in range(6))
            for k in range(batch.num_rows):
                name = convs[k].as_py()
                if conv is None or conv.conv != name:
                    if conv is not None:
                        finish(conv)
                    conv = Conversation(name)
                if kinds[k].as_py() == 0:
                    conv.stretch(heads[k].as_py())
                    continue
                for line in conv.turn(roles[k].as_py(), texts[k].as_py(), copies[k].as_py()):
                    if turns:
                        out.append(line)
                        size += len(line[3])
                if len(out) >= 1_000 or size > 1 << 22:
                    yield _batch(out, schema)
                    out, size = [], 0
        if conv is not None:
            finish(conv)
        if out:
            yield _batch(out, schema)

    return run


def _repaired(rows: DataFrame, turns: bool, most: int) -> DataFrame:
    every = read_turns(rows)
    name = F.col("conv_id").cast("string").alias("conv_id")
    marks = faults(every.select(name, "turn", "role", "text", "digest", "copies"))
    ordered = materialise(marks, "marks").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    stretches = materialise(ordered.select("conv_id", "turn", "initial", "fault", "n").mapInArrow(_stretches(most), STRETCHES_DDL), "stretches")
    head = F.struct(*(c for c in stretches.columns if c not in ("conv_id", "task", "seq")))
    null = lambda t: F.lit(None).cast(t)
    kind: Column = F.lit(0)
    heads = stretches.select("conv_id", kind.alias("kind"), F.col("task").alias("task"), "seq", null("long").alias("turn"), null("string").alias("role"), null("binary").alias("digest"), null("string").alias("text"), null("long").alias("copies"), head.alias("head"))
    spoken = every.filter("copies > 0").select(name, F.lit(1).alias("kind"), F.lit(0).alias("task"), F.lit(0).cast("long").alias("seq"), "turn", "role", "digest", "text", "copies", null(heads.schema["head"].dataType).alias("head"))
    both = heads.unionByName(spoken).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "task", "seq", "turn", "role", "digest")
    ddl = "conv_id string, position long, role string, text string, edit string" if turns else "conv_id string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    out = both.select("conv_id", "kind", "role", "text", "copies", "head").mapInArrow(_apply(turns), ddl)
    return out.withColumn("conv_id", F.col("conv_id").cast(rows.schema["conv_id"].dataType))


def repair(rows: DataFrame, most: int = STRETCH) -> DataFrame:
    """The repaired turns ``conv_id, position, role, text, edit`` of ``conv_id, turn, role, text`` (and
    ``copies``, as ``damage`` gives it); ``edit``: K kept, R with a new role, I inserted. ``most``: turns
    that are passed over in one stretch."""
    return _repaired(rows, True, most)


def report(rows: DataFrame, most: int = STRETCH) -> DataFrame:
    """A row for each conversation: faults, the cheapest edits and the digest of what they give."""
    return _repaired(rows, False, most)
