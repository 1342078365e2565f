"""The landmark graph: neighbours across series, unbranched paths, blocks and length differences."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import hamming
from ..session import materialise
from .components import connected_components
from .series import after_another
from .structure import last_occurrences


def nodes(landmarks: DataFrame) -> DataFrame:
    """``seq, genome, gpos, strand``: one place, the last, of each letter sequence in each series."""
    return last_occurrences(landmarks).select("seq", "genome", "gpos", "strand")


def edges(landmarks: DataFrame) -> DataFrame:
    """Directed neighbours in file order: ``src, tgt, weight`` (series), ``distances`` by series
    (signed, from the places of ``nodes``)."""
    near = after_another(landmarks.select("genome", "contig_id", "ord", "seq"), ["seq"]).filter(F.col("before_seq").isNotNull())
    steps = near.select("genome", F.col("before_seq").alias("src"), F.col("seq").alias("tgt")).distinct()
    at = nodes(landmarks)
    for end in ("src", "tgt"):
        steps = steps.join(at.select("genome", F.col("seq").alias(end), F.col("gpos").alias(f"{end}_pos")), ["genome", end])
    distance = F.map_from_entries(F.array_sort(F.collect_list(F.struct("genome", F.col("tgt_pos") - F.col("src_pos")))))
    return steps.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("weight"), distance.alias("distances"))


def weights(landmarks: DataFrame, least: int = 1) -> DataFrame:
    """``src, tgt, weight`` of ``edges`` of at least the weight, from ``genome, contig_id, ord, seq`` alone: neither
    places nor distances are joined, and rows move once, to their edge."""
    near = after_another(landmarks.select("genome", "contig_id", "ord", "seq"), ["seq"]).filter(F.col("before_seq").isNotNull())
    steps = near.select("genome", F.col("before_seq").alias("src"), F.col("seq").alias("tgt")).repartition("src", "tgt").distinct()
    return steps.groupBy("src", "tgt").agg(F.count(F.lit(1)).alias("weight")).filter(F.col("weight") >= least)


def simplify(edge_table: DataFrame, node_table: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Edges of at least the weight, and the nodes they touch."""
    kept = edge_table.filter(F.col("weight") >= least)
    touched = kept.select(F.explode(F.array("src", "tgt")).alias("seq")).distinct()
    return kept, node_table.join(touched, "seq", "left_semi")


def common_tags(landmarks: DataFrame) -> DataFrame:
    """Letter sequences found in every series."""
    kinds = materialise(landmarks.select("genome", "seq").distinct(), "kinds")
    total = kinds.agg(F.countDistinct("genome").alias("all"))
    return kinds.groupBy("seq").agg(F.count(F.lit(1)).alias("genomes")).join(F.broadcast(total)).filter("genomes = all").select("seq")


def near_pairs(kinds: DataFrame, distance: int) -> DataFrame:
    """Pairs ``a < b`` of letter sequences of one length within a Hamming distance: cut into pieces, they
    agree in all but ``distance`` of them. They are joined on what is left when one piece is taken out
    (distance 1, four pieces), or on three of distance + 3 pieces, and are then compared: long keys, which hardly
    any other pair shares, also where a motif fixes some of the letters."""
    many = 4 if distance == 1 else distance + 3 if distance else 1
    cut = lambda n: f"length(seq) * {n} div {many}"
    piece = lambda n: F.expr(f"substring(seq, {cut(n)} + 1, {cut(n + 1)} - {cut(n)})")
    rest = lambda n: F.expr(f"concat(substring(seq, 1, {cut(n)}), '*', substring(seq, {cut(n + 1)} + 1))")
    key = lambda n: F.struct(F.lit(n).alias("n"), F.length("seq").alias("l"), (rest(n) if distance == 1 else piece(n)).alias("p"))
    if distance > 1:
        three = lambda c: F.struct(F.lit("".join(map(str, c))).alias("n"), F.length("seq").alias("l"), F.concat_ws("-", *map(piece, c)).alias("p"))
        keys = [three(c) for c in combinations(range(many), 3)]
    else:
        keys = [key(n) for n in range(many)]
    keyed = kinds.select("seq", F.explode(F.array(*keys)).alias("key"))
    both = keyed.withColumnRenamed("seq", "a").join(keyed.withColumnRenamed("seq", "b"), "key").filter("a < b").select("a", "b")
    return both.filter(hamming(F.col("a"), F.col("b")) <= distance).distinct()


def near_links(kinds: DataFrame, node: str = "seq") -> DataFrame:
    """Links ``a, b`` between letter sequences one letter apart that connect whatever such pairs connect: all that
    are equal but for one place are linked to the least of them. ``node``: the column that names sequences.

    Sequences meet on a digest of three quarters, and places of the fourth are masked where they have met, so only that
    quarter travels. Digests of 64 bits that collide link only sequences that also agree in the fourth quarter but for one place."""
    quarter = lambda n: F.expr(f"substring(seq, length(seq) * {n} div 4 + 1, length(seq) * {n + 1} div 4 - length(seq) * {n} div 4)")
    rest = lambda n: F.xxhash64(F.lit(n), F.length("seq"), F.expr(f"substring(seq, 1, length(seq) * {n} div 4)"), F.expr(f"substring(seq, length(seq) * {n + 1} div 4 + 1)"))
    each = F.explode(F.array(*(F.struct(rest(n).alias("h"), quarter(n).alias("p")) for n in range(4)))).alias("k")
    keyed = kinds.select(F.col(node).alias("node"), each).select("node", "k.h", "k.p").filter("p <> ''")
    met = keyed.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("h"))).filter("_n > 1")
    masked = met.select("node", "h", "p", F.explode(F.sequence(F.lit(1), F.length("p"))).alias("at"))
    # at most one sequence for each letter of the alphabet
    alike = masked.groupBy("h", F.expr("overlay(p PLACING '*' FROM at FOR 1)").alias("mask"), "at").agg(F.array_sort(F.collect_set("node")).alias("s")).filter("size(s) > 1")
    return alike.select(F.element_at("s", 1).alias("a"), F.explode(F.slice("s", 2, F.size("s"))).alias("b")).distinct()


def tolerant_tags(landmarks: DataFrame, distance: int) -> DataFrame:
    """Clusters of letter sequences linked by the distance that together occur in every series. Links and
    components go by numbers in place of letters."""
    kinds = landmarks.groupBy("seq").agg(F.collect_set("genome").alias("genomes")).withColumn("id", F.monotonically_increasing_id())
    kinds = materialise(kinds, "kinds")  # written, so the numbers stay what they are
    if distance == 1:
        links = near_links(kinds, "id")
    else:
        links = near_pairs(kinds, distance)
        for end in ("a", "b"):
            links = links.withColumnRenamed(end, "seq").join(kinds.select("seq", F.col("id").alias(f"{end}_id")), "seq").drop("seq")
        links = links.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"))
    groups = materialise(connected_components(links), "groups").withColumnRenamed("node", "id")
    total = kinds.select(F.explode("genomes").alias("genome")).agg(F.countDistinct("genome").alias("all"))
    rows = kinds.join(groups, "id", "left")
    # most sequences have none near them and are clusters of their own
    alone = rows.filter("component IS NULL").join(F.broadcast(total)).filter("size(genomes) = all").select(F.col("seq").alias("cluster"), F.lit(1).cast("long").alias("members"))
    # a row for each series of a member, and one for the member
    each = rows.filter("component IS NOT NULL").select("component", "seq", F.explode(F.concat("genomes", F.array(F.lit(None).cast(kinds.schema["genomes"].dataType.elementType)))).alias("genome"))
    named = each.groupBy("component").agg(F.min("seq").alias("cluster"), F.countDistinct("genome").alias("genomes"), F.count_if(F.col("genome").isNull()).alias("members"))
    return named.join(F.broadcast(total)).filter("genomes = all").select("cluster", "members").unionByName(alone)


def _ranked(arcs: DataFrame) -> DataFrame:
    """List ranking by pointer doubling: ``x, y, lx, ly, d, low`` of arcs ``x, y`` whose next arc is
    ``nx, ny`` (null at the end of its list): the list's last arc, the arcs up to it, this one
    included, and the least node they lead to. Arcs of rings, which have no last one, come with null ``lx``. A round
    doubles what each arc looks over, so there are as many rounds as the longest list's length has bits."""
    state = materialise(arcs.select("x", "y", "nx", "ny", F.col("x").alias("lx"), F.col("y").alias("ly"), F.lit(1).cast("long").alias("d"), F.col("y").alias("low")), "arcs")
    before = None
    while True:
        open_ = state.filter("nx IS NOT NULL")
        now = tuple(open_.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("x", "y", "low"))).first())
        if not now[0] or now == before:
            break
        before = now
        further = state.select(F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("nx").alias("nx2"), F.col("ny").alias("ny2"), F.col("lx").alias("lx2"), F.col("ly").alias("ly2"), F.col("d").alias("d2"), F.col("low").alias("low2"))
        stepped = open_.join(further, ["nx", "ny"]).select(
            "x", "y", F.col("nx2").alias("nx"), F.col("ny2").alias("ny"), F.col("lx2").alias("lx"), F.col("ly2").alias("ly"), (F.col("d") + F.col("d2")).alias("d"), F.least("low", "low2").alias("low")
        )
        state = materialise(state.filter("nx IS NULL").unionByName(stepped), "arcs")
    ended = F.col("nx").isNull()
    return state.select("x", "y", *(F.when(ended, F.col(c)).alias(c) for c in ("lx", "ly", "d")), "low")


def path_steps(edge_table: DataFrame) -> DataFrame:
    """``path_id, k, seq, tags`` (nodes of the path): maximal unbranched chains of the undirected simple graph,
    ends included. A path runs from its smaller end; a ring, also one that hangs on one branching node, from its
    smallest node towards the smaller neighbour. A path is named by its first step, which no other path has.

    Every edge is two arcs, and an arc's next one leads on through a node of two neighbours. Ranking the arcs'
    lists gives each node its place, so no chain is gathered anywhere, however long. The rounds work on numbers,
    in the order of the letters they stand for; letters come back at the end."""
    e = edge_table.filter("src <> tgt").select(F.least("src", "tgt").alias("x"), F.greatest("src", "tgt").alias("y")).distinct()
    kinds = e.select(F.explode(F.array("x", "y")).alias("seq")).distinct()
    # ranges of letters, so numbers grow with them from range to range too; written, so they stay what they are
    names = materialise(kinds.repartitionByRange("seq").sortWithinPartitions("seq").withColumn("id", F.monotonically_increasing_id()), "names")
    for end in ("x", "y"):
        e = e.join(names.select(F.col("seq").alias(end), F.col("id").alias(f"{end}_id")), end)
    e = e.select(F.col("x_id").alias("x"), F.col("y_id").alias("y"))
    arcs = materialise(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))), "edges")
    inner = arcs.groupBy(F.col("x").alias("y")).agg(F.min("y").alias("one"), F.max("y").alias("two"), F.count(F.lit(1)).alias("n")).filter("n = 2").drop("n")
    on = arcs.join(inner, "y", "left").withColumn("ny", F.when(F.col("one") == F.col("x"), F.col("two")).otherwise(F.col("one")))
    on = materialise(on.select("x", "y", F.when(F.col("ny").isNotNull(), F.col("y")).alias("nx"), "ny"), "arcs")
    first = materialise(_ranked(on), "ranked")
    # a ring is cut before its smallest node, in both directions
    ring = first.filter("lx IS NULL").select("x", "y", "low")
    cut = F.col("y") == F.col("low")
    opened = on.join(ring, ["x", "y"]).select("x", "y", *(F.when(~cut, F.col(c)).alias(c) for c in ("nx", "ny")))
    ranked = materialise(first.filter("lx IS NOT NULL").unionByName(_ranked(opened)).drop("low"), "ranked")
    # the list of the opposite arc ends where this one begins
    back = ranked.select(F.col("y").alias("x"), F.col("x").alias("y"), F.col("ly").alias("fx"), F.col("lx").alias("fy"), (F.col("d") - 1).alias("k"))
    placed = ranked.join(back, ["x", "y"]).filter("fx <= ly")
    last = (F.col("d") == 1) & (F.col("fx") != F.col("ly"))
    stops = F.when(last, F.array(F.struct("k", F.col("x").alias("seq")), F.struct((F.col("k") + 1).alias("k"), F.col("y").alias("seq")))).otherwise(F.array(F.struct("k", F.col("x").alias("seq"))))
    nodes_ = materialise(placed.select("fx", "fy", (F.col("fx") == F.col("ly")).alias("ring"), (F.col("k") + F.col("d")).alias("size"), F.explode(stops).alias("s")).select("fx", "fy", "ring", "size", "s.k", "s.seq"), "steps")
    line = nodes_.filter("not ring").select("fx", "fy", "k", "seq", (F.col("size") + 1).alias("tags"))
    loop = nodes_.filter("ring")
    turn = loop.groupBy("fx", "fy").agg(F.min_by("k", "seq").alias("at"))
    turned = loop.join(turn, ["fx", "fy"]).withColumn("k", (F.col("k") - F.col("at") + F.col("size")) % F.col("size"))
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("seq")))
    named = turned.groupBy("fx", "fy").agg(at(F.lit(0)).alias("a"), at(F.lit(1)).alias("b"), at(F.col("size") - 1).alias("z")).filter("b < z")
    loops = turned.join(named, ["fx", "fy"]).select(F.col("a").alias("fx"), F.col("b").alias("fy"), "k", "seq", F.col("size").alias("tags"))
    steps = materialise(line.unionByName(loops), "steps")
    first = steps.select("fx", "fy").distinct()
    for end in ("fx", "fy"):
        first = first.join(names.select(F.col("id").alias(end), F.col("seq").alias(f"{end}_name")), end)
    first = first.select("fx", "fy", F.concat_ws(">", "fx_name", "fy_name").alias("path_id"))
    lettered = steps.withColumnRenamed("seq", "id").join(names, "id").join(first, ["fx", "fy"])
    return lettered.select("path_id", "k", "seq", "tags")


def linear_paths(edge_table: DataFrame) -> DataFrame:
    """``path_id, path``: the chains of ``path_steps`` as lists."""
    return path_lists(path_steps(edge_table))


def path_lists(steps: DataFrame) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("k", "seq")))
    return steps.groupBy("path_id").agg(F.transform(ordered, lambda s: s["seq"]).alias("path"))


def _as_steps(paths: DataFrame) -> DataFrame:
    """Paths as rows, from lists or as they are."""
    if "path" not in paths.columns:
        return paths
    return paths.select("path_id", F.size("path").alias("tags"), F.posexplode("path").alias("k", "seq"))


def path_scores(paths: DataFrame, edge_table: DataFrame, series: int) -> DataFrame:
    """Mean edge weight over the number of series, times min(1, sqrt(length / 10))."""
    at = _as_steps(paths)
    after = at.select("path_id", (F.col("k") - 1).alias("k"), F.col("seq").alias("t"))
    steps = at.select("path_id", "k", F.col("tags").alias("length"), F.col("seq").alias("s")).join(after, ["path_id", "k"])
    ahead = edge_table.select(F.col("src").alias("s"), F.col("tgt").alias("t"), F.col("weight").alias("w1"))
    back = edge_table.select(F.col("tgt").alias("s"), F.col("src").alias("t"), F.col("weight").alias("w2"))
    w = steps.join(ahead, ["s", "t"], "left").join(back, ["s", "t"], "left")
    return w.groupBy("path_id").agg((F.avg(F.coalesce("w1", "w2", F.lit(0))) / series * F.least(F.lit(1.0), F.sqrt(F.max("length") / 10))).alias("score"))


def blocks(paths: DataFrame, node_table: DataFrame) -> DataFrame:
    """For each path and series that carries all of it: ``path_id, genome, begin, end, strand, tags``;
    paths carried by at least two series."""
    steps = _as_steps(paths).filter("tags >= 2")
    on = steps.join(node_table, "seq").groupBy("path_id", "genome", "tags").agg(
        F.min("gpos").alias("begin"), F.max("gpos").alias("end"), F.min_by("strand", "k").alias("strand"), F.count(F.lit(1)).alias("n")
    ).filter("n = tags").drop("n")
    return on.withColumn("_g", F.count(F.lit(1)).over(Window.partitionBy("path_id"))).filter("_g >= 2").select("path_id", "genome", "begin", "end", "strand", "tags")


def blocks_of_size(block_table: DataFrame, least: int) -> DataFrame:
    """Blocks whose shortest span over series is at least the size."""
    short = F.min(F.col("end") - F.col("begin")).over(Window.partitionBy("path_id"))
    return block_table.withColumn("_s", short).filter(F.col("_s") >= least).drop("_s")


def indels(paths: DataFrame, block_table: DataFrame, node_table: DataFrame) -> DataFrame:
    """Summed length differences of neighbouring landmarks by block and pair of series (ga < gb), where
    a difference is at least 100 and a tenth of the mean."""
    steps = _as_steps(paths).select("path_id", "k", "seq")
    at = steps.join(block_table.select("path_id"), "path_id", "left_semi").join(node_table, "seq").join(block_table.select("path_id", "genome"), ["path_id", "genome"], "left_semi")
    gap = at.withColumn("d", F.abs(F.lead("gpos").over(Window.partitionBy("path_id", "genome").orderBy("k")) - F.col("gpos"))).filter("d > 0").select("path_id", "k", "genome", "d")
    a, b = gap.withColumnsRenamed({"genome": "ga", "d": "da"}), gap.withColumnsRenamed({"genome": "gb", "d": "db"})
    both = a.join(b, ["path_id", "k"]).filter("ga < gb").withColumn("diff", F.col("db") - F.col("da"))
    real = F.abs("diff") >= F.greatest(F.lit(100.0), (F.col("da") + F.col("db")) / 2 * 0.1)
    return both.filter(real).groupBy("path_id", "ga", "gb").agg(F.sum("diff").alias("indel"), F.count(F.lit(1)).alias("places"))
