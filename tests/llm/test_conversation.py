"""Conversation repair against a plain search over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from cairnline.llm import conversation

SCHEMA = "conv_id long, turn long, role string, text string, digest string, copies_ long, head string, kind int"
SPACE = " \t\n\v\f\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * {0: 0, 3: 2}.get(k, 1)
    return out


def plain(conv, rows):
    """Every edit of every turn in order, keeping for each end state the least (cost, audit)."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    faults, seen = [], set()
    for _, _, role, text in rows:
        tail = text.rstrip(SPACE)
        faults.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else "")
        seen.add((role, text))
    grammar = {("", "u"): "u", ("", "s"): "s", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
    best = {"": (0, "", ())}

    def put(to, state, new):
        if state not in to or new[:2] < to[state][:2]:
            to[state] = new

    def inserts(layer):
        for _ in range(4):
            for state, (cost, audit, out) in list(layer.items()):
                for role in ("user", "assistant"):
                    if (state, role[0]) in grammar:
                        put(layer, grammar[state, role[0]], (cost + 5, audit + "I", (*out, (role, ""))))
        return layer

    for (_, _, role, text), fault in zip(rows, faults, strict=True):
        after = {}
        # insertions before this turn: from the open layer, each number of them on its own
        opened = [(s, *w) for s, w in best.items()]
        for _ in range(2):
            opened += [(grammar[s, r[0]], c + 5, a + "I", (*o, (r, ""))) for s, c, a, o in opened for r in ("user", "assistant") if (s, r[0]) in grammar]
        for state, cost, audit, out in opened:
            put(after, state, (cost + 2, audit + "D", out))
            if fault in ("", "truncated"):
                more = 5 if fault else 0
                if (state, role[:1]) in grammar:
                    put(after, grammar[state, role[:1]], (cost + more, audit + "K", (*out, (role, text))))
                for new in ("user", "assistant"):
                    if (state, new[0]) in grammar:
                        put(after, grammar[state, new[0]], (cost + more + 1, audit + "R", (*out, (new, text))))
        best = after
    cost, audit, out = min((w for s, w in inserts(best).items() if s in ("", "a")), key=lambda w: w[:2])
    turns = [r[1] for r in rows if r[1] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[2][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return (conv, gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest), out


def by_conv(rows):
    out = {r[0]: [] for r in rows}
    for r in damaged(rows):
        out[r[0]].append(r)
    return {c: plain(c, each) for c, each in out.items()}


def check(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", 3, "h", 1) for r in rows], SCHEMA).repartition(3)
    hurt = conversation.damage(df)
    want = by_conv(rows)
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted((tuple(r) for r in conversation.report(hurt, **more).collect()), key=key) == sorted((w for w, _ in want.values()), key=key)
    turns = {}
    for r in sorted(conversation.repair(hurt, **more).collect(), key=lambda r: r["position"]):
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    assert turns == {c: list(out) for c, (_, out) in want.items() if out}


def random_rows(seed, convs, most, roles=("user", "assistant", "system", "user", "assistant", "x", None, "")):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "why?", "broken off", "  ", "", None, "end. \n", "Ünï…", "a.b"] + [f"t{n}." for n in range(30)]
    rows = []
    for c in range(convs):
        for n in range(rng.randrange(most)):
            rows.append((c, rng.choice([n, n, n, n + 2, None]), rng.choice(roles), rng.choice(texts)))
    return rows


def test_random_conversations(spark):
    rows = random_rows(1, 150, 14)
    check(spark, [*rows, *rows[:40], (None, 0, "user", "Hm."), (None, 1, "assistant", "Well."), (None, None, None, None)])


def test_conversations_of_odd_roles(spark):
    check(spark, random_rows(2, 60, 25, ("assistant", "assistant", "system", "tool")))


def test_long_conversation_in_many_stretches(spark):
    rows = [(1, n, random.Random(n).choice(["user", "assistant", "system"]), f"text {n % 90}{'.' if n % 3 else ''}") for n in range(400)]
    check(spark, rows + [(2, 5, "user", "Hi.")] + [(3, 1, "user", "same.")] * 300, most=7)


def test_stretches_join():
    """Cutting a conversation anywhere changes nothing."""
    rng = random.Random(4)
    for _ in range(200):
        turns = [(rng.choice("usaax"), rng.choice([0, 0, 0, 1, 2, 3]), rng.choice([1, 1, 1, 3])) for _ in range(rng.randrange(1, 12))]
        ends = []
        for cut in ((), (len(turns) // 2,), tuple(range(1, len(turns)))):
            best = {conversation.START: (0, "")}
            for a, z in zip((0, *cut), (*cut, len(turns)), strict=True):
                stretch = conversation.Stretch("c", 0, a == 0)
                for initial, fault, n in turns[a:z]:
                    stretch.take(None, initial, fault, n)
                best = conversation.join_maps(best, stretch.row(0)[-1])
            ends.append(conversation.close(best))
        assert len(set(ends)) == 1


def test_no_conversations(spark):
    empty = conversation.damage(spark.createDataFrame([], SCHEMA))
    assert conversation.report(empty).count() == 0 and conversation.repair(empty).count() == 0


@pytest.mark.parametrize("place", ["/root/testdata/sf0.001"])
def test_whole_table(spark, place):
    from cairnline.llm import queries

    rows = [tuple(r) for r in spark.read.parquet(f"{place}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op12_conversation"](spark, place).collect())
    assert got == sorted(w for w, _ in by_conv(rows).values())
