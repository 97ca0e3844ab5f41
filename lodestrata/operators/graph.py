"""Property-graph operators over edge and mention tables: expansion, structure, communities, gaps."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import relational as rel
from .relational import cut

# Edge policy.
MIN_CONFIDENCE, GENERIC_MIN, HOP2_MIN = 0.20, 0.35, 0.30
GENERIC = ("related_to", "references", "mentions")
STRONG = ("strong", "repaired")


def undirected(edges: DataFrame, a: str, b: str, weight: str) -> DataFrame:
    """Repeat relations of a pair folded into one edge (u < v) with summed weight."""
    e = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(weight).alias("w"))
    return e.groupBy("u", "v").agg(F.sum("w").alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions; what ``edges`` stands for is evaluated once."""
    one = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("w").alias("w"))
    return edges.select(F.explode(F.array(one("u", "v"), one("v", "u"))).alias("_e")).select("_e.*")


#: Members of a group that are paired in one place, and pairs of small groups that a task makes on average.
GROUP_BLOCK, TASK_PAIRS = 1_000, 1_000_000


def cooccurrence(mentions: DataFrame, group: str, member: str, least: int, block: int = GROUP_BLOCK, survivors: DataFrame | None = None) -> DataFrame:
    """Pairs of members of one group with the number of groups they share, at least ``least``.

    Pairs arise within groups. A group of more than ``block`` members is dealt to blocks by a hash of
    the member, and every two of its blocks meet in a place of their own, so that no task pairs a whole
    large group. Small groups are dealt to as many tasks as their pairs ask for: a pair takes far more
    room than the members that make it, so sizes of shuffled members say little.

    With ``survivors`` (node, survivor) the members that are merged give way to their survivors before
    they are paired, each counting as often as members of the group go into it: what ``redirect`` makes of the edges.
    """
    m = mentions.select(F.col(group).alias("g"), F.col(member).alias("x")).distinct()
    k, w = [], F.count("*")
    if survivors is not None:
        m = m.join(survivors.select(F.col("node").alias("x"), "survivor"), "x", "left").groupBy("g", F.coalesce("survivor", "x").alias("x")).agg(F.count("*").alias("n_x"))
        k, w = ["n_x"], F.sum(F.col("n_u") * F.col("n_v"))
    side = lambda df, x, *more: df.select("g", F.col("x").alias(x), *more, *[F.col(c).alias(f"n_{x}") for c in k])
    made_of = ["u", "v", *[f"n_{x}" for x in "uv" if k]]
    sizes, n = m.groupBy("g").agg(F.count("*").alias("n")), F.col("n")
    made, most = sizes.agg(F.sum(F.when(n <= block, n * (n - 1) / 2)), F.max("n")).first()
    tasks, few = int((made or 0) // TASK_PAIRS) + 1, m
    if (most or 0) > block:
        large = cut(sizes.where(n > block))
        few = m.join(large, "g", "left_anti")
    few = few.repartition(tasks, "g") if tasks > 1 else few
    pairs = side(few, "u").join(side(few, "v"), "g").where("u < v").select(*made_of)
    if (most or 0) > block:
        b = m.join(large, "g").withColumn("k", F.ceil(n / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("x"), F.col("k")).cast("int"))
        b = b.select("g", "x", "i", *k, F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")).select("g", "x", "i", *k, F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"))
        met = side(b, "u", "lo", "hi", F.col("i").alias("iu")).join(side(b, "v", "lo", "hi", F.col("i").alias("iv")), ["g", "lo", "hi"])
        pairs = pairs.union(met.where("u < v and (lo = hi or iu <> iv)").select(*made_of))
    return pairs.groupBy("u", "v").agg(w.alias("w")).where(F.col("w") >= least)


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("w").alias("strength"))


def edge_policy(confidence: Column, predicate: Column, strength: Column, evidence: Column, hop: int = 1) -> Column:
    """Edges that a traversal may use: confidence floors by hop, stricter for generic predicates without support."""
    base = F.coalesce(confidence, F.lit(0.5)) >= (HOP2_MIN if hop >= 2 else MIN_CONFIDENCE)
    generic = predicate.isin(*GENERIC)
    backed = (F.coalesce(confidence, F.lit(0.5)) >= GENERIC_MIN) | F.coalesce(strength.isin(*STRONG), F.lit(False)) | (F.coalesce(evidence, F.lit(0)) > 0)
    return base & (~generic | backed)


def edge_rank(confidence: Column, eligible: Column, strength: Column, predicate: Column, evidence: Column, fallback: Column) -> Column:
    """(conf + .20 eligible + .20 strong / .14 repaired + .12 non-generic + .08 evidence) * (.5 fallback, else 1)."""
    n = lambda c: F.when(c, 1.0).otherwise(0.0)
    s = F.coalesce(confidence, F.lit(0.0)) + 0.20 * n(eligible) + F.when(strength == "strong", 0.20).when(strength == "repaired", 0.14).otherwise(0.0) + 0.12 * n(~predicate.isin(*GENERIC)) + 0.08 * n(evidence > 0)
    return s * F.when(fallback, 0.5).otherwise(1.0)


def expand(edges: DataFrame, seeds: DataFrame, hops: int, cap: int | None = None) -> DataFrame:
    """Nodes within some hops of the seeds: (node, hop, hits), hits being edges from the frontier that reached it.

    Each hop joins the frontier with the edges, drops what was seen and counts; ``cap`` keeps the
    best of a hop by hits, then id.
    """
    directed = cut(both_ways(edges))
    seen = seeds.select(F.col("node"), F.lit(0).cast("long").alias("hop"), F.lit(0).cast("long").alias("hits")).distinct()
    front = seen
    for h in range(1, hops + 1):
        nxt = front.select(F.col("node").alias("src")).join(directed, "src").select(F.col("dst").alias("node")).join(seen.select("node"), "node", "left_anti")
        nxt = nxt.groupBy("node").agg(F.count("*").alias("hits")).select("node", F.lit(h).cast("long").alias("hop"), "hits")
        front = cut(nxt.orderBy(F.desc("hits"), "node").limit(cap) if cap else nxt)
        seen = cut(seen.unionByName(front))
    return seen


#: Nodes in a list that meets other lists, about.
NODE_BLOCK = 1_000


def missing_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Unordered pairs of a node set (a query's seeds) without a direct edge; ``edges`` between other nodes may be left out.

    Nodes lie in lists of about NODE_BLOCK by a hash, and each node meets each list with its neighbours there, so what is
    shuffled is a row for each node and list and the edges, not the pairs.
    """
    some = cut(nodes.select("node").where("node is not null"))
    n = some.count()
    lists, tasks = F.lit(n // NODE_BLOCK + 1), n * n // (8 * TASK_PAIRS) + 1
    of = lambda x: F.pmod(F.xxhash64(x), lists)
    near = induced(edges.withColumn("w", F.lit(1)), some).groupBy("u", of("v").alias("i")).agg(F.collect_set("v").alias("near"))
    each = some.select(F.col("node").alias("u"), F.explode(F.sequence(F.lit(0).cast("long"), lists.cast("long") - 1)).alias("i")).repartition(tasks, "u", "i")
    each = each.join(near, ["u", "i"], "left").join(some.groupBy(of("node").alias("i")).agg(F.collect_list("node").alias("vs")), "i")
    each = each.select("u", "near", F.explode("vs").alias("v"))
    return each.where((F.col("v") > F.col("u")) & (F.col("near").isNull() | ~F.array_contains("near", F.col("v")))).select("u", "v")


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    return edges.join(nodes.select(F.col("node").alias("u")), "u", "left_semi").join(nodes.select(F.col("node").alias("v")), "v", "left_semi").select("u", "v", "w")


def shared_neighbors(edges: DataFrame, seeds: DataFrame, least: int = 2) -> DataFrame:
    """Nodes that are no seeds and touch at least ``least`` of them."""
    d = both_ways(edges).join(seeds.select(F.col("node").alias("src")), "src", "left_semi").join(seeds.select(F.col("node").alias("dst")), "dst", "left_anti")
    return d.groupBy(F.col("dst").alias("node")).agg(F.countDistinct("src").alias("seeds")).where(F.col("seeds") >= least)


def pagerank(edges: DataFrame, rounds: int = 10, alpha: float = 0.85) -> DataFrame:
    """(node, rank): weighted undirected PageRank; nodes have an edge each, so no mass dangles."""
    share = F.col("w") / F.sum("w").over(Window.partitionBy("src"))
    step = cut(both_ways(edges).select("src", "dst", share.alias("p")))
    nodes = step.select(F.col("src").alias("node")).distinct()
    n = nodes.count()
    r = nodes.select("node", F.lit(1.0 / n if n else 0.0).alias("rank"))
    for i in range(rounds):
        r = step.join(r.select(F.col("node").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("node")).agg((F.sum(F.col("rank") * F.col("p")) * alpha + (1 - alpha) / max(n, 1)).alias("rank"))
        if i % 5 == 4:
            r = cut(r)
    return r.select("node", F.round("rank", 9).alias("rank"))


#: Rows that a task joins or sorts in loops over members of groups.
TASK_ROWS = 1_000_000


def _tasks(df: DataFrame) -> int:
    """As many tasks as the rows ask for: what a task holds does not grow with the input.

    Rows that lie in fewer parts than ``spark.sql.shuffle.partitions`` would be dealt anew by each join.
    """
    n = df.count()
    return max(n // TASK_ROWS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))) if n > TASK_ROWS else 1


def members(mentions: DataFrame, group: str, member: str, rows: int | None = None) -> DataFrame:
    """(g, x, n): distinct members of each group of two members or more, with the group's size.

    With ``rows`` the mentions are dealt by group to as many tasks as that asks for, over all steps.
    """
    m = mentions.select(F.col(group).alias("g"), F.col(member).alias("x")).where("g is not null and x is not null")
    m = (m.repartition(m.count() // rows + 1, "g") if rows else m).distinct()
    return m.join(m.groupBy("g").agg(F.count("*").alias("n")).where("n > 1"), "g").select("g", "x", "n")


def stars(mentions: DataFrame, group: str, member: str) -> DataFrame:
    """(u, v): the smallest member of each group with each other one; it joins what all pairs of the group join."""
    m = mentions.select(F.col(group).alias("g"), F.col(member).alias("v")).where("g is not null and v is not null")
    return m.join(m.groupBy("g").agg(F.min("v").alias("u")), "g").where("u <> v").select("u", "v").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): label and pointer jumping to the smallest node of each component."""
    d = cut(both_ways(edges.withColumn("w", F.lit(1))).select("src", "dst").distinct())
    d = cut(d.repartition(_tasks(d), "dst").sortWithinPartitions("dst"))
    label = cut(d.groupBy(F.col("dst").alias("node")).agg(F.least(F.min("src"), F.col("dst")).alias("component")))
    for _ in range(max_rounds):
        near = d.join(label.select(F.col("node").alias("dst"), F.col("component").alias("c")), "dst").groupBy(F.col("src").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", F.least("component", "c").alias("component"))
        jump = low.select(F.col("node").alias("component"), F.col("component").alias("up"))
        nxt = cut(low.join(jump, "component").select("node", F.col("up").alias("component")))
        if not nxt.join(label.withColumnRenamed("component", "was"), "node").where("component <> was").limit(1).count():
            return nxt
        label = nxt
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(node, community): each node takes the label of the greatest weight around it, ties to the smallest."""
    d = cut(both_ways(edges))
    label = d.select(F.col("src").alias("node"), F.col("src").alias("community")).distinct()
    for _ in range(rounds):
        votes = d.join(label.select(F.col("node").alias("dst"), "community"), "dst").groupBy("src", "community").agg(F.sum("w").alias("v"))
        label = cut(votes.groupBy(F.col("src").alias("node")).agg(F.min_by("community", F.struct(-F.col("v"), F.col("community"))).alias("community")))
    return label


def domain_profile(mentions: DataFrame, entity: str, domain: str) -> DataFrame:
    """Each entity's most frequent domain (ties by name) and the number it touches."""
    c = mentions.groupBy(entity, domain).agg(F.count("*").alias("n"))
    return c.groupBy(entity).agg(F.min_by(domain, F.struct(-F.col("n"), F.col(domain))).alias("domain"), F.count("*").alias("n_domains"), F.sum("n").alias("mentions"))


def frontier(edges: DataFrame | None, profile: DataFrame, node: str, most: int = 5, groups: DataFrame | None = None) -> DataFrame:
    """Nodes of small degree that touch two domains or more, by themselves or through neighbours.

    Where edges join all members of ``groups`` (g, x), a node of a group of more than ``most`` + 1 has too
    many neighbours, so pairs are made only for nodes whose groups are all smaller; ``edges`` are not read.
    """
    if groups is not None:
        m, raw = members(groups, "g", "x", TASK_ROWS), groups.select("g", F.col("x").alias("dst"))
        small = lambda df: F.broadcast(df) if df.count() <= 1_000_000 else df
        some = cut(m.groupBy("x").agg(F.max("n").alias("n")).where(F.col("n") <= most + 1).select(F.col("x").alias("dst")))
        mine = cut(raw.join(small(some), "dst", "left_semi").select("g", F.col("dst").alias("node")).distinct())
        d = raw.join(small(mine), "g").where("node <> dst").select("node", "dst").distinct()
        few = d.groupBy("node").agg(F.count("*").alias("degree")).where(F.col("degree") <= most)
        near = d.join(few.select("node"), "node", "left_semi").join(profile.select(F.col(node).alias("dst"), "domain"), "dst").select("node", "domain")
        near = near.union(profile.select(F.col(node).alias("node"), "domain").join(few.select("node"), "node", "left_semi"))
        touched = near.groupBy("node").agg(F.countDistinct("domain").alias("touched"))
        return few.join(touched, "node").where("touched >= 2").select("node", "degree", "touched")
    p = profile.select(F.col(node).alias("dst"), "domain")
    d = both_ways(edges)
    near = d.join(p, "dst").select("src", "domain").union(profile.select(F.col(node), "domain"))
    touched = near.groupBy(F.col("src").alias("node")).agg(F.countDistinct("domain").alias("touched"))
    return degrees(edges).join(touched, "node").where((F.col("degree") <= most) & (F.col("touched") >= 2)).select("node", "degree", "touched")


def domain_edges(edges: DataFrame, profile: DataFrame, node: str) -> DataFrame:
    """Per domain: nodes, internal and external edges (external ones count on both sides), density 2m / (n (n - 1))."""
    p = profile.select(F.col(node).alias("u"), F.col("domain").alias("du"))
    q = profile.select(F.col(node).alias("v"), F.col("domain").alias("dv"))
    e = edges.join(p, "u").join(q, "v")
    side = e.select(F.explode(F.array_distinct(F.array("du", "dv"))).alias("domain"), (F.col("du") == F.col("dv")).alias("inside"))
    c = side.groupBy("domain").agg(F.count_if("inside").alias("internal"), F.count_if(~F.col("inside")).alias("external"))
    n = profile.groupBy("domain").agg(F.count("*").alias("nodes"))
    density = F.when(F.col("nodes") > 1, 2 * F.coalesce("internal", F.lit(0)) / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(0.0)
    return n.join(c, "domain", "left").select("domain", "nodes", F.coalesce("internal", F.lit(0)).alias("internal"), F.coalesce("external", F.lit(0)).alias("external"), F.round(density, 5).alias("density"))


def cluster_gaps(edges: DataFrame | None, cluster: DataFrame, most: int = 3, groups: DataFrame | None = None) -> DataFrame:
    """Pairs of clusters with fewer than ``most`` bridging nodes: 0 is DISCONNECTED, else THIN.

    Where edges join all members of ``groups`` (g, x), and a node is in one cluster, all of two clusters in
    one group are bridging nodes. The ``most`` smallest of a cluster in a group are enough to tell that there are so many;
    ``edges`` are not read.
    """
    if groups is None:
        p = both_ways(edges).join(cluster.select(F.col("node").alias("src"), F.col("c").alias("cs")), "src").join(cluster.select(F.col("node").alias("dst"), F.col("c").alias("cd")), "dst").where("cs <> cd")
        b = p.select("src", F.least("cs", "cd").alias("a"), F.greatest("cs", "cd").alias("b")).distinct().groupBy("a", "b").agg(F.count("*").alias("n"))
    else:
        with rel.rounds(groups.sparkSession) as settle:
            b = _bridging(groups, cluster, most, settle)
    names = cluster.select("c").distinct()
    pairs = names.select(F.col("c").alias("a")).join(names.select(F.col("c").alias("b")), F.col("a") < F.col("b"))  # clusters are few by their definition
    out = pairs.join(b, ["a", "b"], "left").withColumn("n", F.coalesce("n", F.lit(0))).where(F.col("n") < most)
    return out.select("a", "b", "n", F.when(F.col("n") == 0, "DISCONNECTED").otherwise("THIN").alias("gap"))


def _bridging(groups: DataFrame, cluster: DataFrame, most: int, settle: Callable) -> DataFrame:
    """(a, b, n): bridging nodes of two clusters, counted up to ``most``.

    Their smallest nodes are found one after another, each by a minimum that tasks take before the
    shuffle, so no task holds a pair's nodes.
    """
    m = groups.select("g", "x").where("g is not null and x is not null")
    m = m.repartition(m.count() // TASK_ROWS + 1, "x").distinct().join(cluster.select(F.col("node").alias("x"), "c").where("c is not null"), "x")
    m = m.repartition(m.count() // TASK_ROWS + 1, "g")
    held = rel.top_per_key(m, ["g", "c"], ["x"], most, "_r").groupBy("g", "c").agg(F.collect_list("x").alias("xs"))  # at most ``most`` of them
    sets = settle(held.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("c", "xs"))).alias("s")).where(F.size("s") > 1).select("s"))  # as many as there are clusters
    each = sets.select(F.posexplode("s").alias("i", "p"), "s").select("p", F.explode(F.slice("s", F.col("i") + 2, F.size("s"))).alias("q"))
    each = each.select(F.col("p.c").alias("a"), F.col("q.c").alias("b"), F.concat("p.xs", "q.xs").alias("xs"))
    last = cut(each.groupBy("a", "b").agg(F.min(F.array_min("xs")).alias("x"), F.lit(1).cast("long").alias("n")))
    for i in range(1, most):
        seen = F.broadcast(last) if last.count() <= 100_000 else last  # clusters are few by their definition
        above = each.join(seen.where(F.col("n") == i).select("a", "b", F.col("x").alias("_l")), ["a", "b"])
        above = above.groupBy("a", "b").agg(F.min(F.array_min(F.filter("xs", lambda x: x > F.col("_l")))).alias("_x")).where("_x is not null")
        last = cut(last.join(above, ["a", "b"], "left").select("a", "b", F.coalesce("_x", "x").alias("x"), F.when(F.col("_x").isNotNull(), F.col("n") + 1).otherwise(F.col("n")).alias("n")))
    return last.select("a", "b", "n")


def redirect(edges: DataFrame, survivors: DataFrame) -> DataFrame:
    """Edges with merged nodes replaced by their survivors, self-loops dropped, repeats folded."""
    m = lambda c: survivors.select(F.col("node").alias(c), F.col("survivor").alias(f"s{c}"))
    x = edges.join(m("u"), "u", "left").join(m("v"), "v", "left").select(F.coalesce("su", "u").alias("u"), F.coalesce("sv", "v").alias("v"), "w")
    return undirected(x, "u", "v", "w")


def follow_tombstones(stones: DataFrame, hops: int = 3) -> DataFrame:
    """(node, survivor) after up to some hops of node -> survivor, by pointer jumping."""
    cur = stones.select("node", "survivor")
    nxt = stones.select(F.col("node").alias("survivor"), F.col("survivor").alias("up"))
    for _ in range(hops - 1):
        cur = cur.join(nxt, "survivor", "left").select("node", F.coalesce("up", "survivor").alias("survivor"))
    return cur


def co_mentions(mentions: DataFrame, seeds: DataFrame, chunk: str, entity: str, conf: str, k: int) -> DataFrame:
    """Chunks that share entities with the seed chunks: sum of conf * conf (null counts as .5), top k."""
    c = F.coalesce(conf, F.lit(0.5))
    s = mentions.join(seeds, chunk, "left_semi").select(entity, c.alias("cs"))
    s = s.groupBy(entity).agg(F.sum("cs").alias("cs"))
    o = mentions.join(seeds, chunk, "left_anti").select(F.col(chunk), entity, c.alias("co"))
    score = o.join(s, entity).groupBy(chunk).agg(F.round(F.sum(F.col("cs") * F.col("co")), 6).alias("score"), F.countDistinct(entity).alias("shared"))
    return score.orderBy(F.desc("score"), chunk).limit(k)


def hubs(rank: DataFrame, k: int) -> DataFrame:
    return rel.ranked(rank.orderBy(F.desc("rank"), "node").limit(k), [F.lit(0)], [F.desc("rank"), "node"], "place")


def transfers(analogies: DataFrame, rank: DataFrame, profile: DataFrame, node: str, quantile: float = 0.9, domains: int = 2) -> DataFrame:
    """Hubs of the top decile with analogs in two other domains or more: (hub, domain, analog, sim), the best of each domain."""
    cut_at = rank.agg(F.percentile("rank", F.lit(quantile)).alias("q"))
    hubs_ = rank.crossJoin(F.broadcast(cut_at)).where(F.col("rank") >= F.col("q")).select(F.col("node").alias("hub"))  # one row on the right
    both = analogies.select(F.col("u").alias("hub"), F.col("v").alias("analog"), "sim").union(analogies.select("v", "u", "sim"))
    x = both.join(hubs_, "hub", "left_semi").join(profile.select(F.col(node).alias("analog"), "domain"), "analog")
    best = rel.top_per_key(x, ["hub", "domain"], [F.desc("sim"), "analog"], 1, "_r").drop("_r")
    many = best.groupBy("hub").agg(F.count("*").alias("n")).where(F.col("n") >= domains)
    return best.join(many, "hub", "left_semi").select("hub", "domain", "analog", "sim")


#: Neighbours in one row of a list of neighbours, on average at most.
LIST_ROW = 4_096


def weak_links(edges: DataFrame, profile: DataFrame, node: str, most: int = 1, groups: DataFrame | None = None) -> DataFrame:
    """Edges across domains of weight ``most`` or less whose ends share no neighbour: (u, v, du, dv).

    Where edges join all members of ``groups`` (g, x), the ends of an edge in a group of three share the
    third, so only edges of a group of two are looked at further. Lists of neighbours are dealt to rows by a
    hash of the neighbour, and rows of both ends meet; no row grows with a hub.
    """
    p = lambda x, d: profile.select(F.col(node).alias(x), F.col("domain").alias(d))
    with rel.rounds(edges.sparkSession) as settle:
        edges = settle(edges.select("u", "v", "w"))
        e = edges.where(F.col("w") <= most)
        if groups is not None:
            two = groups.select("g", "x").distinct().groupBy("g").agg(F.min("x").alias("u"), F.max("x").alias("v"), F.count("*").alias("n")).where("n = 2")
            e = e.join(two.select("u", "v").distinct(), ["u", "v"], "left_semi")
        e = settle(e.join(p("u", "du"), "u").join(p("v", "dv"), "v").where("du <> dv").select("u", "v", "du", "dv"))
        ends = e.select(F.explode(F.array("u", "v")).alias("src")).distinct()
        d = both_ways(edges).select("src", "dst").join(ends, "src", "left_semi")
        rows = (d.groupBy("src").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) // LIST_ROW + 1
        lists = settle(d.groupBy("src", F.pmod(F.xxhash64("dst"), F.lit(rows)).alias("i")).agg(F.collect_list("dst").alias("l")))
        of = lambda x: lists.select(F.col("src").alias(x), "i", F.col("l").alias(f"l{x}"))
        shared = e.select("u", "v").join(of("u"), "u").join(of("v"), ["v", "i"]).where(F.arrays_overlap("lu", "lv")).select("u", "v").distinct()
        return cut(e.join(shared, ["u", "v"], "left_anti").select("u", "v", "du", "dv"))
