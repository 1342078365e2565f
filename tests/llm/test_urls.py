"""The path-template tree against a plain walk, level by level."""

import math
import random
import time

import pytest

from cairnline.llm import url_filter

RULES = [("h.com/a/", "block"), ("h.com/b/c/", "allow"), ("s.h.com/", "block"), ("k.net/x/", "allow"), ("k.net/x/y/", "block")]


def said(host, path):
    best = None
    for rule, verdict in RULES:
        h, slash, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith(slash + p) and (best is None or len(rule) > len(best[0])):
            best = rule, verdict
    return best and best[1]


def plain(pages, siblings, critical, strength, neutral):
    """(template, purity) of each (host, steps), from the root down and back up."""
    final = {p: () for p in set(pages)}
    for level in range(max(len(s) for _, s in pages)):
        kids = {}
        for h, s in pages:
            kids.setdefault((h, final[h, s]), []).append(s[level] if level < len(s) else None)
        crowd = {}
        for node, steps in kids.items():
            kinds = set(steps) - {None}
            crowd[node] = {k for k in kinds if len(kinds) > siblings and steps.count(k) * 5 < len(steps)}
        # paths that ended stay at their last node, apart from longer ones
        final = {(h, s): f + (("*" if s[level] in crowd[h, f] else s[level],) if level < len(s) else ()) for (h, s), f in final.items()}
    pool = {}
    for h, s in pages:
        verdict = said(h, "/" + "/".join(s))
        if verdict:
            f = final[h, s]
            for n in range(len(f) + 1):
                b, k = pool.get((h, f[:n]), (0, 0))
                pool[h, f[:n]] = b + (verdict == "block"), k + 1
    kept = {}
    for (h, f), (b, k) in pool.items():
        if not f:
            kept.setdefault((h, None), []).append((b / k, f, b, k))
        else:
            pb, pk = pool[h, f[:-1]]
            pooled = pb / pk
            if abs(b / k - pooled) > critical * math.sqrt(pooled * (1 - pooled) / k):
                kept.setdefault((h, f[:-1]), []).append((b / k, f, b, k))
    joined = {}
    for (h, _), rows in kept.items():
        rows.sort(key=lambda r: (r[0], r[3]))
        groups = [[rows[0]]]
        for last, r in zip(rows, rows[1:], strict=False):
            both = (last[2] + r[2]) / (last[3] + r[3])
            if abs(r[0] - last[0]) <= critical * math.sqrt(both * (1 - both) * (1 / last[3] + 1 / r[3])):
                groups[-1].append(r)
            else:
                groups.append([r])
        for g in groups:
            for r in g:
                joined[h, r[1]] = sum(x[2] for x in g), sum(x[3] for x in g)
    out = {}
    for (h, s), f in final.items():
        ends = [joined[h, f[:n]] for n in range(len(f) + 1) if (h, f[:n]) in joined]
        b, k = ends[-1] if ends else (0, 0)
        out[h, s] = "/" + "/".join(f), round((b + strength * neutral) / (k + strength), 6)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_tree_against_a_plain_walk(spark, seed):
    rng = random.Random(seed)
    words = [f"w{chr(97 + n)}" for n in range(20)]
    pages = []
    for _ in range(500):
        host = rng.choice(["h.com", "h.com", "s.h.com", "k.net"])
        first = rng.choice(["a", "b", "x", rng.choice(words)])
        pages.append((host, (first, *(rng.choice(["c", "y", "z", rng.choice(words)]) for _ in range(rng.randrange(4))))))
    df = spark.createDataFrame([(n, f"http://{h}/{'/'.join(s)}") for n, (h, s) in enumerate(pages)], "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge(df, RULES, siblings=5).collect()}
    want = plain(pages, 5, 1.96, 4.0, 0.25)
    assert {n: (r["template"], r["purity"]) for n, r in got.items()} == {n: want[p] for n, p in enumerate(pages)}
    for n, (h, s) in enumerate(pages):
        rule = said(h, "/" + "/".join(s))
        assert got[n]["verdict"] == (rule or ("block" if want[h, s][1] >= 0.5 else "allow"))
    assert len({r["template"] for r in got.values()}) < len(set(pages))


def test_alike_siblings_are_merged(spark):
    """Two blocked branches beside an allowed one are judged by what both hold."""
    rules = [("h.com/a/", "block"), ("h.com/b/", "block"), ("h.com/c/", "allow")]
    urls = [f"http://h.com/{x}/p" for x in "aaaaaaaabbbbbbbb" + "c" * 30]
    got = {r["path"]: r["purity"] for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), rules).collect()}
    assert got["/a/p"] == got["/b/p"] == round((16 + 1) / (16 + 4), 6) and got["/c/p"] < 0.25


def test_very_long_paths(spark):
    common = "/".join(f"s{'abcdefghij'[n % 10]}" for n in range(1000))
    df = spark.createDataFrame([(1, f"http://h.com/{common}/x"), (2, f"http://h.com/{common}/y"), (3, None), (4, "http://h.com")], "page_id long, url string")
    began = time.time()
    got = {r["page_id"]: (r["verdict"], r["template"]) for r in url_filter.judge(df, RULES).collect()}
    assert got == {1: ("allow", f"/{common}/x"), 2: ("allow", f"/{common}/y"), 3: ("allow", "/"), 4: ("allow", "/")}
    assert time.time() - began < 60
