"""Graph operators over edge tables: reachability, ranks, components, neural scores.

Iterative operators keep the frontier or the ranks in a table written to the shared folder now and then,
so that plans stay short and lost executors cost one step. Nothing but counters reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.code import DEPENDENCY_WEIGHT, lookup
from quillspan.session import materialize


def both_ways(edges: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    e = edges.select(F.col(source).alias(source), F.col(target).alias(target))
    return e.union(e.select(F.col(target), F.col(source))).distinct()


def reach(edges: DataFrame, starts: DataFrame, depth: int, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(start, node, distance): nodes within ``depth`` edges of each start (column ``node``), at their least
    distance; a start comes again only through a cycle, at the length of the shortest one."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t")).distinct()
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at")).distinct()
    seen = None
    for step in range(1, depth + 1):
        nxt = front.join(e, front["at"] == e["s"]).select("start", F.col("t").alias("at")).distinct()
        if seen is not None:
            nxt = nxt.join(seen.select("start", F.col("node").alias("at")), ["start", "at"], "left_anti")
        nxt = materialize(nxt, "reach")
        found = nxt.select("start", F.col("at").alias("node"), F.lit(step).cast("long").alias("distance"))
        seen = found if seen is None else seen.unionByName(found)
        front = nxt
        if nxt.isEmpty():
            break
    return seen


def upstream(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    return reach(edges, starts, depth)


def downstream(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    return reach(edges, starts, depth, "target_id", "source_id")


def blast_radius(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """What depends on each start, directly or not, without itself."""
    return downstream(edges, starts, depth).filter("node <> start")


def distance(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Distances without regard to direction, 0 to the start itself."""
    d = reach(both_ways(edges), starts, depth).filter("node <> start")
    return d.unionByName(starts.select(F.col("node").alias("start"), "node", F.lit(0).cast("long").alias("distance")).distinct())


#: Nodes up to which ranks are sent to every executor, so that the edges are never shuffled: some 10 MB.
BROADCAST_NODES = 500_000


def pagerank(edges: DataFrame, damping: float = 0.85, iterations: int = 30, source: str = "source_id", target: str = "target_id", dangling: bool = True, every: int = 5) -> DataFrame:
    """(node, rank). Parallel edges count; the mass of nodes without edges out is spread over all nodes, or
    lost if not ``dangling``. A round is one join of the edges with the ranks and one sum per node: each node has an
    edge of no weight to itself, so that none is missing from the sums."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    out = e.groupBy("s").agg(F.count(F.lit(1)).alias("out"))
    nodes = e.select(F.col("s").alias("node")).union(e.select("t")).distinct().join(out.withColumnRenamed("s", "node"), "node", "left")
    nodes = materialize(nodes.select("node", F.col("out").isNull().alias("end")), "rank-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("node", F.lit(0.0).alias("rank"))
    w = e.groupBy("s", "t").agg(F.count(F.lit(1)).alias("m")).join(out, "s").select("s", "t", (F.col("m") / F.col("out")).alias("w"), F.lit(None).cast("boolean").alias("end"))
    w = materialize(w.unionByName(nodes.select(F.col("node").alias("s"), F.col("node").alias("t"), F.lit(0.0).alias("w"), "end")), "rank-edges")
    small = n <= BROADCAST_NODES
    rank = nodes.select("node", F.lit(1.0 / n).alias("rank"), "end")
    for i in range(iterations):
        have = F.broadcast(rank.select("node", "rank")) if small else rank.select("node", "rank")
        got = w.join(have, F.col("s") == F.col("node")).groupBy("t").agg(F.sum(F.col("rank") * F.col("w")).alias("in"), F.max("end").alias("end"))
        spread = F.lit((1.0 - damping) / n)
        if dangling:
            lost = rank.agg(F.coalesce(F.sum(F.when(F.col("end"), F.col("rank"))), F.lit(0.0)).alias("lost"))
            got = got.join(F.broadcast(lost), how="cross")
            spread = spread + F.lit(damping / n) * F.col("lost")
        rank = got.select(F.col("t").alias("node"), (spread + F.lit(damping) * F.col("in")).alias("rank"), "end")
        if (i + 1) % every == 0 or i == iterations - 1:
            rank = materialize(rank, "rank")
    return rank.select("node", "rank")


def percentile(rows: DataFrame, value: str, node: str = "node") -> DataFrame:
    """(node, percentile): 0-based ascending rank / rows, ties by node. Ranks are by range: a global sort,
    then offsets per partition, so no task holds all rows."""
    total = rows.count()
    ordered = materialize(rows.select(node, value).repartitionByRange(F.col(value).asc_nulls_first(), F.col(node)).sortWithinPartitions(F.col(value).asc_nulls_first(), F.col(node)).withColumn("part", F.spark_partition_id()), "percentile")
    counts = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = counts.withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    w = Window.partitionBy("part").orderBy(F.col(value).asc_nulls_first(), F.col(node))
    ranked = ordered.withColumn("rn", F.row_number().over(w)).join(F.broadcast(before), "part")
    return ranked.select(node, ((F.col("before") + F.col("rn") - 1) / F.lit(float(max(total, 1)))).alias("percentile"))


def components(edges: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """(node, component): least node reachable without regard to direction. Large-star and small-star
    rounds: each halves the depth of the trees, so a few rounds do whatever the diameter. A result that still changes
    after ``limit`` rounds is an error."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    nodes = materialize(edges.select(F.col(a).alias("node")).union(edges.select(F.col(b))).distinct(), "cc-nodes")
    e = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    for _ in range(limit):
        sym = e.union(e.select(F.col("v"), F.col("u")))
        low = sym.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = sym.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.filter("u <> v").distinct(), "cc-large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        small = materialize(small.filter("u <> v").distinct(), "cc-small")
        same = small.count() == e.count() and small.join(e, ["u", "v"], "left_anti").isEmpty()
        e = small
        if same:
            break
    else:
        raise RuntimeError(f"components still change after {limit} rounds")
    return nodes.join(e.select(F.col("u").alias("node"), F.col("v").alias("c")), "node", "left").select("node", F.coalesce("c", "node").alias("component"))


def strong_components(edges: DataFrame, source: str = "source_id", target: str = "target_id", limit: int = 200) -> DataFrame:
    """(node, component) of strongly connected components of two or more nodes, named by their least node.

    Nodes that can lie on no cycle are trimmed; then every node takes the largest node that reaches it as
    its colour, and what the colour's root is reached by within the colour is the root's component; these
    are taken out and the rest is done again. Edges that are left after ``limit`` rounds are an error."""
    e = materialize(edges.select(F.col(source).alias("s"), F.col(target).alias("t")).filter("s <> t").distinct(), "scc")
    found = None
    for _ in range(limit):
        while True:
            trimmed = materialize(e.join(e.select(F.col("t").alias("s")).distinct(), "s", "left_semi").join(e.select(F.col("s").alias("t")).distinct(), "t", "left_semi").select("s", "t"), "scc-trim")
            done = trimmed.count() == e.count()
            e = trimmed
            if done:
                break
        if e.isEmpty():
            break
        colour = materialize(e.select(F.col("s").alias("node")).distinct().withColumn("colour", F.col("node")), "scc-colour")
        while True:
            into = e.join(colour, e["s"] == colour["node"]).groupBy(F.col("t").alias("node")).agg(F.max("colour").alias("c"))
            new = materialize(colour.join(into, "node", "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour")), "scc-colour")
            same = new.join(colour, ["node", "colour"], "left_anti").isEmpty()
            colour = new
            if same:
                break
        within = e.join(colour.select(F.col("node").alias("s"), F.col("colour").alias("cs")), "s").join(colour.select(F.col("node").alias("t"), F.col("colour").alias("ct")), "t").filter("cs = ct").select("s", "t", F.col("cs").alias("colour"))
        within = materialize(within, "scc-within")
        member = materialize(colour.filter("node = colour"), "scc-member")
        front = member
        while True:
            nxt = within.join(front.select(F.col("node").alias("t"), "colour"), ["t", "colour"]).select(F.col("s").alias("node"), "colour").distinct()
            nxt = materialize(nxt.join(member, ["node", "colour"], "left_anti"), "scc-front")
            if nxt.isEmpty():
                break
            member = member.unionByName(nxt)
            front = nxt
        member = materialize(member, "scc-member")
        found = member if found is None else found.unionByName(member)
        gone = member.select("node")
        e = materialize(e.join(gone.withColumnRenamed("node", "s"), "s", "left_anti").join(gone.withColumnRenamed("node", "t"), "t", "left_anti").select("s", "t"), "scc")
    else:
        if not e.isEmpty():
            raise RuntimeError(f"strong components aren't complete after {limit} rounds")
    if found is None:
        return edges.select(F.col(source).alias("node"), F.col(source).alias("component")).limit(0)
    named = found.groupBy("colour").agg(F.min("node").alias("component"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return found.join(named, "colour").select("node", "component")


def communities(edges: DataFrame, rounds: int = 20, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """(node, community) by label propagation: each round a node takes the most frequent community of its
    neighbours in both directions, ties to the least one. Nodes change in turn by the parity of a hash, so
    that two halves don't swap their labels for ever."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    e = materialize(e.union(e.select("t", "s")), "lpa-edges")
    label = materialize(e.select(F.col("s").alias("node")).distinct().withColumn("label", F.col("node")), "lpa")
    for i in range(rounds):
        votes = e.join(label.select(F.col("node").alias("t"), "label"), "t").groupBy("s", "label").agg(F.count(F.lit(1)).alias("c"))
        best = votes.groupBy("s").agg(F.max(F.struct("c", (-F.col("label")).alias("neg"))).alias("m")).select(F.col("s").alias("node"), (-F.col("m.neg")).alias("new"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == i % 2
        new = materialize(label.join(best, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label")), "lpa")
        same = i % 2 == 1 and new.join(label, ["node", "label"], "left_anti").isEmpty() and new.join(best.select("node", F.col("new").alias("label")), ["node", "label"], "left_anti").isEmpty()
        label = new
        if same:
            break
    return label.select("node", F.col("label").alias("community"))


def modularity(edges: DataFrame, community: DataFrame, source: str = "source_id", target: str = "target_id") -> DataFrame:
    """One row: sum over edges within a community of 1 - ki * kj / (2 m m), over m."""
    e = edges.select(F.col(source).alias("s"), F.col(target).alias("t"))
    k = e.select(F.col("s").alias("node")).union(e.select("t")).groupBy("node").agg(F.count(F.lit(1)).alias("k"))
    c = community.join(k, "node")
    a, b = (c.select(F.col("node").alias(x), F.col("community").alias(f"c{x}"), F.col("k").alias(f"k{x}")) for x in "st")
    m = e.agg(F.count(F.lit(1)).cast("double").alias("m"))
    j = e.join(a, "s").join(b, "t").join(F.broadcast(m), how="cross").filter("cs = ct")
    return j.agg(F.coalesce(F.sum((1 - F.col("ks") * F.col("kt") / (2 * F.col("m") * F.col("m"))) / F.col("m")), F.lit(0.0)).alias("modularity"))


#: Weights of the two graph-convolution layers; rows are in-degree, out-degree, importance.
W1 = [[0.6, 0.4, 0.5, 0.3, -0.1, 0.2, 0.4, 0.1], [0.3, 0.6, 0.2, 0.5, 0.1, -0.2, 0.3, 0.4], [0.8, 0.7, 0.9, 0.6, 0.5, 0.8, 0.7, 0.9]]
W2 = [0.5, 0.6, 0.7, 0.4, 0.3, 0.6, 0.5, 0.7]


def attention(edges: DataFrame, importance: DataFrame) -> DataFrame:
    """(node, attention): two graph convolutions over the structural edges (s, t) and ``importance`` (node,
    percentile). Each node gathers from those that point to it and from itself, with weight
    1 / sqrt(deg * deg); then W1 and relu, again, W2 and the logistic function."""
    e = edges.select("s", "t").distinct()
    out = e.groupBy("s").agg(F.count(F.lit(1)).alias("out")).withColumnRenamed("s", "node")
    into = e.groupBy("t").agg(F.count(F.lit(1)).alias("inn")).withColumnRenamed("t", "node")
    x = importance.join(out, "node", "left").join(into, "node", "left").fillna(0, ["out", "inn"])
    top = x.agg(F.greatest(F.max("inn"), F.lit(1)).alias("mi"), F.greatest(F.max("out"), F.lit(1)).alias("mo"))
    x = x.join(F.broadcast(top), how="cross").select("node", (F.col("inn") + F.col("out") + 1).cast("double").alias("deg"), F.array(F.col("inn") / F.col("mi"), F.col("out") / F.col("mo"), F.col("percentile")).alias("x"))
    x = materialize(x, "gcn")
    s, t = x.select(F.col("node").alias("s"), F.col("deg").alias("ds")), x.select(F.col("node").alias("t"), F.col("deg").alias("dt"))
    a = e.join(s, "s").join(t, "t").select("s", "t", (1 / F.sqrt(F.col("ds") * F.col("dt"))).alias("w"))
    own = x.select(F.col("node").alias("s"), F.col("node").alias("t"), (1 / F.col("deg")).alias("w"))
    a = materialize(a.filter("s <> t").unionByName(own), "gcn-edges")

    def gather(h: DataFrame, width: int) -> DataFrame:
        j = a.join(h.select(F.col("node").alias("s"), "h"), "s")
        return j.groupBy(F.col("t").alias("node")).agg(F.array(*(F.sum(F.col("w") * F.col("h")[i]) for i in range(width))).alias("g"))

    g = gather(x.select("node", F.col("x").alias("h")), 3)
    h = g.select("node", F.array(*(F.greatest(F.lit(0.0), sum((F.col("g")[i] * W1[i][j] for i in range(3)), F.lit(0.0))) for j in range(8))).alias("h"))
    g = gather(h, 8)
    z = sum((F.col("g")[j] * W2[j] for j in range(8)), F.lit(0.0))
    return g.select("node", (1 / (1 + F.exp(-z))).alias("attention"))


def reasoning(edges: DataFrame, starts: DataFrame, depth: int = 4, limit: int = 100, decay: float = 0.6, kinds: list[str] | None = None) -> DataFrame:
    """(start, node, score, hops, flow, semantic): neighbourhood by kind weight * decay ^ hop, summed over the
    ways of each level; edges out at full weight, edges in at half and only to nodes not met before. flow
    and semantic tell whether a way has such an edge. The best ``limit`` per start."""
    e = edges if kinds is None else edges.filter(F.col("kind").isin(kinds))
    weight = lookup(F.col("kind"), DEPENDENCY_WEIGHT, 0.3)
    flow, semantic = F.col("kind").isin("data_flow", "error_flow", "type_flow"), F.col("kind").isin("data_flow", "error_flow", "type_flow", "historical_co_change")
    e = e.select(F.col("source_id").alias("s"), F.col("target_id").alias("t"), weight.alias("w"), flow.alias("f"), semantic.alias("m"))
    front = starts.select(F.col("node").alias("start"), F.col("node").alias("at"), F.lit(False).alias("flow"), F.lit(False).alias("sem"))
    met = front.select("start", F.col("at").alias("node"))
    total = None
    for hop in range(1, depth + 1):
        k = decay**hop
        fwd = front.join(e, front["at"] == e["s"]).select("start", F.col("t").alias("node"), (F.col("w") * k).alias("score"), (F.col("flow") | F.col("f")).alias("flow"), (F.col("sem") | F.col("m")).alias("sem"))
        back = front.join(e, front["at"] == e["t"]).select("start", F.col("s").alias("node"), (F.col("w") * k * 0.5).alias("score"), (F.col("flow") | F.col("f")).alias("flow"), (F.col("sem") | F.col("m")).alias("sem"))
        back = back.join(met, ["start", "node"], "left_anti")
        level = materialize(fwd.unionByName(back).groupBy("start", "node").agg(F.sum("score").alias("score"), F.max("flow").alias("flow"), F.max("sem").alias("sem")).withColumn("hop", F.lit(hop)), "reasoning")
        total = level if total is None else total.unionByName(level)
        new = level.join(met, ["start", "node"], "left_anti")
        front = new.select("start", F.col("node").alias("at"), "flow", "sem")
        met = materialize(met.unionByName(new.select("start", "node")), "reasoning-met")
    out = total.groupBy("start", "node").agg(F.sum("score").alias("score"), F.min("hop").alias("hops"), F.max("flow").alias("flow"), F.max("sem").alias("semantic")).filter("node <> start")
    w = Window.partitionBy("start").orderBy(F.col("score").desc(), "node")
    return out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")


def impact(hits: DataFrame) -> DataFrame:
    """Neighbourhood scores times 1.8 for ways with a flow, else 1.4 for semantic ones."""
    return hits.withColumn("score", F.col("score") * F.when(F.col("flow"), 1.8).when(F.col("semantic"), 1.4).otherwise(1.0))


def transitive_flows(edges: DataFrame, starts: DataFrame, decay: float = 0.8, least: float = 0.3, hops: int = 3) -> DataFrame:
    """(source, target, hops, confidence): call chains of two and three hops, confidence decay ^ hops."""
    d = reach(edges.filter("kind = 'calls'"), starts, hops).filter("distance >= 2 and node <> start")
    return d.select(F.col("start").alias("source"), F.col("node").alias("target"), F.col("distance").alias("hops"), F.pow(F.lit(decay), F.col("distance")).alias("confidence")).filter(F.col("confidence") >= least)
