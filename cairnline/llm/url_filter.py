"""URL filter by a path-template tree.

Explicit rules (host and path prefix) decide first, and what they decide is the labelled evidence.
For the rest, each host's paths form a tree of templates: segments with a variable shape, or too many
different values among their siblings, become wildcards; from the leaves to the host's root, a branch
without evidence, or whose share of blocked evidence does not differ significantly from the pooled
share of its parent, is merged into the parent, and the branches left beside each other are merged where their
shares are alike; and a template is rejected when the share of the branch
that it ends in, smoothed towards a neutral prior, passes a threshold. Templates of a host without any
evidence are allowed.

Rows meet the tree only twice: once when they are counted by template (with partial sums), and once
when verdicts are joined back, an equi-join that adaptive execution may split where one host holds
much of the rows. All between runs on the table of templates.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule and is
judged as a template of its own; repeated rows are judged alike; an empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

MOST_RULES = 1000


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return (
        F.coalesce(F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.lit("")),
        F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit("")),
    )


def first_fit(rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; nulls where none does."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: join them as a table")
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, slash, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, says).otherwise(verdict)
    return name, verdict


def shape(segment: Column) -> Column:
    """A wildcard for numbers, hexadecimal and other codes, whatever their file extension."""
    bare = F.regexp_replace(segment, r"\.[A-Za-z]{1,5}$", "")
    coded = bare.rlike(r"^[0-9]+$") | bare.rlike(r"^[0-9A-Fa-f-]{8,}$") | (bare.rlike(r"[0-9]{3,}") & (F.length(bare) > 2)) | (F.length(bare) > 40)
    return F.when(coded, F.lit("*")).otherwise(segment)


def nodes(steps: Column) -> Column:
    """The nodes on the way through ``steps``, the root first, each with its parent (``px, py``): 128-bit digests,
    so that long paths cost no text."""
    zero, last = F.lit(0).cast("long"), lambda at: F.element_at(at, -1)
    root = F.array(F.struct(zero.alias("x"), zero.alias("y"), zero.alias("px"), zero.alias("py")))
    below = lambda up, s: F.struct(F.xxhash64(up["x"], s).alias("x"), F.xxhash64(s, up["y"]).alias("y"), up["x"].alias("px"), up["y"].alias("py"))
    return F.aggregate(steps, root, lambda at, s: F.concat(at, F.array(below(last(at), s))))


def wildcards(tree: DataFrame, siblings: int) -> DataFrame:
    """``host, template, final`` of templates ``host, template, steps, n``: ``final`` with wildcards for crowds.

    A crowd is told from the node that it hangs on, and nodes change with the wildcards above them. So all
    levels are counted at once with the wildcards found so far, until none changes: a round more than there are
    crowds below one another, however long the paths are. Level by level gives the same."""
    now = materialise(tree.select("host", "template", "steps", "n", F.col("steps").alias("taken"), F.lit(True).alias("moved")), "templates")
    while not now.filter("moved").isEmpty():
        at = F.transform(nodes(F.col("taken")), lambda v, i: F.struct(i.alias("level"), v["x"].alias("x"), v["y"].alias("y"), F.get("steps", i).alias("step")))
        way = now.select("host", "template", "n", F.inline(at))
        child = materialise(way.groupBy("host", "level", "x", "y", "step").agg(F.sum("n").alias("in_child")), "children")
        node = child.groupBy("host", "level", "x", "y").agg(F.sum("in_child").alias("in_node"), F.count("step").alias("kinds")).filter(F.col("kinds") > siblings)
        crowd = child.filter("step IS NOT NULL").join(node, ["host", "level", "x", "y"]).filter(F.col("in_child") * 5 < F.col("in_node")).select("host", "level", "x", "y", "step")
        wild = way.join(crowd, ["host", "level", "x", "y", "step"]).groupBy("host", "template").agg(F.collect_set("level").alias("wild"))
        taken = F.transform("steps", lambda s, i: F.when(F.array_contains(F.coalesce("wild", F.array().cast("array<int>")), i), F.lit("*")).otherwise(s))
        grown = now.join(wild, ["host", "template"], "left").select("host", "template", "steps", "n", F.col("taken").alias("was"), taken.alias("taken"))
        now = materialise(grown.select("host", "template", "steps", "n", "taken", (F.col("was") != F.col("taken")).alias("moved")), "templates")
    return now.select("host", "template", F.concat(F.lit("/"), F.array_join("taken", "/")).alias("final"))


def merged(leaves: DataFrame, critical: float) -> DataFrame:
    """``host, final, b, k``: the blocked and all evidence of the branch that each leaf ends in.

    That is the nearest of the leaf and its ancestors that has evidence and whose share differs from
    its parent's pooled share, or else the host's root. Such branches of one parent, in the order of their
    shares and evidence, are merged with their neighbours in it as long as the two shares don't differ either. A parent has few:
    more than ``siblings`` would be a wildcard, but for those of a fifth of its pages."""
    steps = F.split(F.expr("substring(final, 2)"), "/")
    above = F.transform(nodes(steps), lambda v, i: F.struct(i.alias("at"), v["x"].alias("x"), v["y"].alias("y"), v["px"].alias("px"), v["py"].alias("py")))
    chain = materialise(leaves.select("host", "final", "known", "bad", F.inline(above)), "branches")
    spot = ["host", "at", "x", "y"]
    pool = materialise(chain.filter("known > 0").groupBy(*spot, "px", "py").agg(F.sum("known").alias("k"), F.sum("bad").alias("b")), "branches")
    parent = pool.select("host", (F.col("at") + 1).alias("at"), F.col("x").alias("px"), F.col("y").alias("py"), (F.col("b") / F.col("k")).alias("pooled"))
    spread = F.sqrt(F.col("pooled") * (1 - F.col("pooled")) / F.col("k"))
    apart = (F.col("at") == 0) | (F.abs(F.col("b") / F.col("k") - F.col("pooled")) > critical * spread)
    kept = pool.join(parent, ["host", "at", "px", "py"], "left").filter(apart)
    beside = Window.partitionBy("host", "at", "px", "py").orderBy(F.col("b") / F.col("k"), "k", "x", "y")
    b, k = F.lag("b").over(beside), F.lag("k").over(beside)
    both = (b + F.col("b")) / (k + F.col("k"))
    alike = F.abs(F.col("b") / F.col("k") - b / k) <= critical * F.sqrt(both * (1 - both) * (1 / k + 1 / F.col("k")))
    group = F.sum("_new").over(beside.rowsBetween(Window.unboundedPreceding, 0))
    kept = kept.withColumn("_new", F.when(alike, 0).otherwise(1)).withColumn("_group", group)
    whole = Window.partitionBy("host", "at", "px", "py", "_group")
    kept = kept.select(*spot, F.sum("b").over(whole).alias("b"), F.sum("k").over(whole).alias("k"))
    ends = chain.join(kept, spot).groupBy("host", "final").agg(F.max_by(F.struct("b", "k"), "at").alias("end"))
    return leaves.select("host", "final").join(ends, ["host", "final"], "left").select(
        "host", "final", F.coalesce("end.b", F.lit(0)).alias("b"), F.coalesce("end.k", F.lit(0)).alias("k")
    )


def judge(
    pages: DataFrame, rules: list[tuple[str, str]], depth: int | None = None, siblings: int = 12, strength: float = 4.0,
    neutral: float = 0.25, critical: float = 1.96, reject: float = 0.5,
) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for all rows.

    A node with more than ``siblings`` different child segments, none of which holds a fifth of its
    pages, has its children replaced by a wildcard. ``strength`` is the weight in
    pages of the prior share ``neutral``, ``critical`` the z value at which a branch is kept apart, ``reject`` the share from which
    a template is rejected. Segments beyond ``depth``, if it is given, are pooled under one wildcard."""
    url = pages.select("page_id", F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    rows = url.select("page_id", host.alias("host"), path.alias("path"))
    name, says = first_fit(rules)
    rows = rows.select("page_id", "host", "path", name.alias("rule"), says.alias("said"))
    parts = F.split(F.expr("substring(path, 2)"), "/")
    steps = F.transform(parts, shape)
    if depth is not None:
        steps = F.transform(F.slice(parts, 1, depth + 1), lambda s, n: F.when(n >= depth, F.lit("*")).otherwise(shape(s)))
    rows = rows.withColumn("template", F.array_join(steps, "/"))

    known = F.col("said").isNotNull().cast("long")
    bad = (F.col("said") == "block").cast("long")
    tree = rows.groupBy("host", "template").agg(
        F.count(F.lit(1)).alias("n"), F.sum(known).alias("known"), F.sum(F.coalesce(bad, F.lit(0))).alias("bad")
    ).withColumn("steps", F.split("template", "/"))
    tree = materialise(tree, "templates")
    tree = materialise(tree.drop("steps").join(wildcards(tree, siblings), ["host", "template"]), "templates")

    leaves = merged(tree.groupBy("host", "final").agg(F.sum("known").alias("known"), F.sum("bad").alias("bad")), critical)
    leaves = leaves.withColumn("purity", (F.col("b") + strength * neutral) / (F.col("k") + strength))
    verdicts = tree.join(leaves.select("host", "final", "purity"), ["host", "final"]).select(
        "host", "template", F.col("final").alias("tree_template"), "purity"
    )
    out = rows.join(verdicts, ["host", "template"], "left")
    return out.select(
        "page_id", "host", "path", "rule",
        F.coalesce("said", F.when(F.col("purity") >= reject, "block").otherwise("allow")).alias("verdict"),
        F.coalesce("tree_template", F.lit("")).alias("template"),
        F.round("purity", 6).alias("purity"),
    )
