"""Account-graph algorithms over node and edge tables.

Edges of hubs are cut into parts, and a hub's state is repeated once per part, so no task holds all
edges of one node. Loop state is written to the shared checkpoint folder, so a lost executor costs one step, and read
back with its true size, so the planner's estimates stay right however many rounds there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.operators import similarity, vector_index
from riskloom.session import bucketed, written

HUB_EDGES = 1_000_000
#: Cells that the grid of a ranking's arcs may have on few cores, and rows it may have at most.
LEAST_CELLS, MOST_ROWS = 16, 32
#: Edges a node that components are looked for in first.
SAMPLED_EDGES = 3.0
#: Gain of modularity below which a round of moves counts as no gain.
TOLERANCE = 1e-4


def build_edges(interactions: DataFrame, min_interactions: int = 1) -> DataFrame:
    """One weighted edge per (src, dst): weight sum, interaction count, type of the first one.

    Input: src, dst, weight, interaction_type, at.
    """
    edges = interactions.groupBy("src", "dst").agg(
        F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("interactions"),
        F.min_by("interaction_type", "at").alias("relation_type"))
    return edges.filter(F.col("interactions") >= min_interactions) if min_interactions > 1 else edges


def nodes_of(edges: DataFrame, src_type: str = "USER", dst_type: str = "CONTENT") -> DataFrame:
    return edges.select(F.col("src").alias("id"), F.lit(src_type).alias("node_type")).union(
        edges.select(F.col("dst").alias("id"), F.lit(dst_type).alias("node_type"))).distinct()


def both_ways(edges: DataFrame) -> DataFrame:
    weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(1.0)
    return edges.select("src", "dst", weight.alias("weight")).union(
        edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), weight.alias("weight")))


class Adjacency:
    """Directed edges split at hubs, stored once, with a per-node summary."""

    def __init__(self, arcs: DataFrame, hub_edges: int = HUB_EDGES):
        spark = arcs.sparkSession
        self.spark = spark
        stats = arcs.groupBy("src").agg(F.sum("weight").alias("out_weight"), F.count(F.lit(1)).alias("degree"))
        self.nodes = written(stats.select(
            "src", "out_weight", "degree", F.ceil(F.col("degree") / hub_edges).cast("int").alias("parts")), "nodes")
        marked = arcs.join(self.nodes, "src").select(
            "src", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int").alias("part"), "dst",
            "weight", (F.col("weight") / F.col("out_weight")).alias("share"))
        # Bucketed by (src, part): the joins of the loop do not shuffle the edges again.
        self.arcs = bucketed(marked, "arcs", "src", "part")

    def send(self, state: DataFrame, *columns: str) -> DataFrame:
        """Edges with the state of their source: (dst, weight, share, src, columns...).

        The state carries `parts`, the number of pieces its node's edges were cut into.
        """
        repeated = state.filter("parts > 0").select(
            "src", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), *columns)
        return self.arcs.join(repeated, ["src", "part"])


def page_rank(edges: DataFrame, damping: float = 0.85, iterations: int = 20, hub_edges: int = HUB_EDGES,
              every: int = 5, side: int | None = None) -> DataFrame:
    """(id, score) summing to 1. `edges` holds directed arcs (src, dst, weight); rank of nodes
    without outgoing arcs is spread over all nodes.

    Arcs lie in a grid of cells, rows by source and columns by target, one bucket a cell: `side` times `side`, or as many as keep
    all cores at work. A rank goes to a row's cells and a column's sums come back to a node, however many neighbours it has. A
    hub's arcs are dealt over the rows of the grid.
    """
    spark = edges.sparkSession
    height, width = (side, side) if side else grid_for(spark.sparkContext.defaultParallelism)
    n_cells = height * width
    edges = written(edges, "edges")
    stats = edges.groupBy("src").agg(F.sum("weight").alias("out_weight"), F.count(F.lit(1)).alias("degree")).select(
        F.col("src").alias("id"), "out_weight", F.least(F.ceil(F.col("degree") / hub_edges), F.lit(height)).cast("int").alias("parts"))
    ids = bucketed(stats.unionByName(edges.select(F.col("dst").alias("id"), F.lit(None).cast("double").alias("out_weight"), F.lit(0).alias("parts"))).groupBy(
        "id").agg(F.max("out_weight").alias("out_weight"), F.max("parts").alias("parts")), "ids", "id", partitions=n_cells)
    cells = _bucket_labels(spark, n_cells)

    def cell(part: Column, column: Column) -> Column:
        return F.get(cells, (F.pmod(F.xxhash64("src") + part, F.lit(height)) * width + column).cast("int")).alias("cell")

    nodes = ids.select(F.col("id").alias("src"), "out_weight", "parts")
    arcs = bucketed(edges.join(nodes, "src").select(
        cell(F.pmod(F.xxhash64("dst", "src"), F.col("parts")), F.pmod(F.xxhash64("dst"), F.lit(width))), "src", "dst",
        (F.col("weight") / F.col("out_weight")).alias("share")), "arcs", "cell", partitions=n_cells)
    facts = ids.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("parts") == 0).alias("sinks")).first()
    n = facts["n"]
    ids = ids.select("id", "parts")
    ranks = ids.withColumn("score", F.lit(1.0 / n))
    # Arcs stay in their cells, although they are joined by cell and source: no exchange may have more partitions than these.
    settings = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.shuffle.partitions": str(n_cells)}
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        for step in range(1, iterations + 1):
            sent = ranks.where("parts > 0").select(F.col("id").alias("src"), "parts", "score").select(
                "src", "score", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(
                "src", "score", "part", F.explode(F.array(*[F.lit(c) for c in range(width)])).alias("column")).select(
                cell(F.col("part"), F.col("column")), "src", "score")
            inflow = arcs.join(sent.hint("shuffle_hash"), ["cell", "src"]).groupBy(F.col("dst").alias("id")).agg(
                F.sum(F.col("score") * F.col("share")).alias("inflow"))
            lost = F.lit(0.0)
            if facts["sinks"]:
                lost = F.coalesce(ranks.filter("parts = 0").agg(F.sum("score")).scalar(), F.lit(0.0))
            base = F.lit((1 - damping) / n) + F.lit(damping) * lost / n
            ranks = ids.join(inflow, "id", "left").select(
                "id", "parts", (base + F.lit(damping) * F.coalesce("inflow", F.lit(0.0))).alias("score"))
            # With sinks a step reads the ranks twice, so each is written before the next one.
            if facts["sinks"] or step % every == 0 or step == iterations:
                ranks = written(ranks, "ranks")
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return ranks.select("id", "score")


def grid_for(cores: int) -> tuple[int, int]:
    """Rows and columns of the nearly square grid whose cells, a task each, leave the fewest cores idle; of like ones the smallest."""
    grids = [(r, r + more) for r in range(3, MOST_ROWS + 1) for more in range(3) if r * (r + more) <= max(LEAST_CELLS, 2 * cores)]
    return min(grids, key=lambda g: (round(-(-g[0] * g[1] // cores) * cores / (g[0] * g[1]), 1), sum(g)))


def _bucket_labels(spark: SparkSession, n: int) -> Column:
    """An array of n labels that a table of n buckets keeps in one bucket each."""
    found = spark.range(100 * n).select(F.col("id").cast("int").alias("label")).groupBy(
        F.pmod(F.hash("label"), F.lit(n)).alias("bucket")).agg(F.min("label").alias("label")).orderBy("bucket").collect()
    return F.array(*[F.lit(r["label"]) for r in found])


def components(edges: DataFrame, max_rounds: int = 60, sampled: float = SAMPLED_EDGES) -> DataFrame:
    """(id, component): the smallest id reachable from each node. The edges are read several times: give a stored table.

    If there are many edges a node, the components of a sample of them, `sampled` a node, are found first. Edges inside one of
    those tell nothing new; all others join them, so the result is that of all edges, and rounds run on few of them.
    """
    links = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
    n, nodes = links.agg(F.count(F.lit(1)), F.approx_count_distinct("u") + F.approx_count_distinct("v")).first()
    if sampled * nodes * 2 >= n:
        found = _star_roots(links, max_rounds)
    else:
        share = 1 << 20
        some = written(_star_roots(links.where(F.pmod(F.xxhash64("u", "v"), F.lit(share)) < int(share * sampled * nodes / n)), max_rounds), "roots")
        u, v = (some.select(F.col("id").alias(end), F.col("component").alias("of_" + end)) for end in ("u", "v"))
        a, b = F.coalesce("of_u", "u"), F.coalesce("of_v", "v")
        between = links.join(u, "u", "left").join(v, "v", "left").where(a != b)
        rest = written(between.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
        joined = _star_roots(rest, max_rounds)
        # A node outside the sample is joined under its own id.
        found = some.join(joined.select(F.col("id").alias("component"), F.col("component").alias("into")), "component", "left").select(
            "id", F.coalesce("into", "component").alias("component")).unionByName(joined.join(some, "id", "left_anti"))
    alone = edges.where("src = dst").select(F.col("src").alias("id")).distinct().join(found, "id", "left_anti")
    return found.unionByName(alone.select("id", F.col("id").alias("component")))


def _star_roots(links: DataFrame, max_rounds: int) -> DataFrame:
    """(id, component) of the nodes of `links` (u, v), u > v.

    Large and small stars in turn: every node ties its larger neighbours to its smallest one, then itself and its smaller
    neighbours to the smallest of them. No step joins on the component, so one giant component is no hot key.
    """
    stars, before = links, None
    for _ in range(max_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        mark = stars.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("long"))).first()
        if mark == before:
            roots = stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return stars.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
        before = mark
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def communities(edges: DataFrame, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(id, community) by modularity: neighbours become one as long as they gain by it, then single nodes move to the
    community they gain most by, then communities that gain by it are made one, pair by pair.

    Ties go to the smallest community; the result does not depend on partitioning.
    """
    arcs = written(both_ways(edges), "edges")
    moved = _local_moves(arcs, hub_edges, _stars_merged(arcs))
    member = written(moved.select(F.col("src").alias("id"), "community"), "members")
    a, b = (member.select(F.col("id").alias(end), F.col("community").alias("c" + end)) for end in ("src", "dst"))
    between = written(arcs.join(a, "src").join(b, "dst").groupBy(
        F.col("csrc").alias("src"), F.col("cdst").alias("dst")).agg(F.sum("weight").alias("weight")), "arcs")
    return _merged(between, member)


def _stars_merged(arcs: DataFrame, every: int = 4) -> DataFrame:
    """(id, community): neighbours made one, star by star, until no two communities gain by it.

    Each community names the neighbour it gains most by, for the size of both. One that is no centre joins a named one that is;
    of two that name each other the smaller is the centre, of the others a draw per round tells. A share of the communities
    goes in every round, so the rounds grow with the logarithm of the nodes, and a star of any size is one round's work.
    """
    sizes = written(arcs.groupBy(F.col("src").alias("c")).agg(F.sum("weight").alias("tot")), "sizes")
    total = F.lit(sizes.agg(F.sum("tot")).first()[0])
    between = arcs.where("src < dst").groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.sum("weight").alias("weight"))
    member, r = sizes.select(F.col("c").alias("id"), F.col("c").alias("community")), 0
    while True:
        r += 1
        weighed = between.join(sizes.select(F.col("c").alias("a"), F.col("tot").alias("ta")), "a").join(
            sizes.select(F.col("c").alias("b"), F.col("tot").alias("tb")), "b")
        # Gains of all levels are compared as parts of the ends' own weight.
        gain = F.round((F.col("weight") - F.col("ta") * F.col("tb") / total) / F.sqrt(F.col("ta") * F.col("tb")), 12)
        ends = weighed.withColumn("cost", -gain).where("cost < -1e-9").select(F.explode(F.array("a", "b")).alias("c"), "cost", "a", "b")
        other = F.when(F.col("c") == F.col("a"), F.col("b")).otherwise(F.col("a"))
        named = written(ends.groupBy("c").agg(F.min_by(other, F.struct("cost", "a", "b")).alias("to")), "named")
        if named.isEmpty():
            return member
        back = named.select(F.col("c").alias("to"), F.col("to").alias("back"))
        draw = F.pmod(F.xxhash64("c", F.lit(r)), F.lit(2)) == 0
        judged = named.join(back, "to").withColumn("centre", F.when(F.col("back") == F.col("c"), F.col("c") < F.col("to")).otherwise(draw))
        leaves = judged.where("not centre").join(judged.where("centre").select(F.col("c").alias("to")), "to").select("c", F.col("to").alias("into"))
        step = written(sizes.join(leaves, "c", "left").select("c", F.coalesce("into", "c").alias("into"), "tot"), "step")
        sizes = step.groupBy(F.col("into").alias("c")).agg(F.sum("tot").alias("tot"))
        a, b = (step.select(F.col("c").alias(end), F.col("into").alias("into_" + end)) for end in ("a", "b"))
        ia, ib = F.col("into_a"), F.col("into_b")
        between = written(between.join(a, "a").join(b, "b").where(ia != ib).groupBy(
            F.least(ia, ib).alias("a"), F.greatest(ia, ib).alias("b")).agg(F.sum("weight").alias("weight")), "between")
        member = member.join(step.select(F.col("c").alias("community"), "into"), "community").select("id", F.col("into").alias("community"))
        if r % every == 0:
            member = written(member, "members")


def modularity(edges: DataFrame, members: DataFrame) -> DataFrame:
    """One row: the modularity of a labelling (id, community) of the undirected weighted edges."""
    arcs = both_ways(edges)
    ends = arcs.join(members.select(F.col("id").alias("src"), F.col("community").alias("ca")), "src").join(
        members.select(F.col("id").alias("dst"), F.col("community").alias("cb")), "dst")
    sums = ends.groupBy("ca").agg(F.sum("weight").alias("tot"), F.sum(F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0)).alias("inside"))
    total = F.sum("tot")
    return sums.agg((F.sum("inside") / total - F.sum(F.col("tot") * F.col("tot")) / (total * total)).alias("modularity"))


def merge_gains(edges: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, gain): what modularity gains if two communities with an edge between them become one; a < b.

    One row per pair of communities that meet, so as many as the edges at most.
    """
    arcs = both_ways(edges)
    ends = arcs.join(members.select(F.col("id").alias("src"), F.col("community").alias("a")), "src").join(
        members.select(F.col("id").alias("dst"), F.col("community").alias("b")), "dst")
    return _gains(written(ends.groupBy("a", "b").agg(F.sum("weight").alias("weight")), "between"))


def _gains(between: DataFrame) -> DataFrame:
    """(a, b, gain) of the pairs that meet, from the weight between all communities, both ways and inside."""
    weights = between.groupBy("a").agg(F.sum("weight").alias("tot"))
    total = between.agg(F.sum("weight")).scalar()
    pairs = between.where("a < b").join(weights.select("a", F.col("tot").alias("ta")), "a").join(
        weights.select(F.col("a").alias("b"), F.col("tot").alias("tb")), "b")
    return pairs.select("a", "b", (2 * (F.col("weight") / total - F.col("ta") * F.col("tb") / (total * total))).alias("gain"))


def _merged(arcs: DataFrame, member: DataFrame) -> DataFrame:
    """`member` with communities made one as long as two of them gain by it more than the tolerance.

    In a round, pairs merge that are each other's best. The best pair of all is one of them, and each merge raises the
    modularity by the tolerance at least, so the rounds have a bound that does not grow with the graph.
    """
    between = arcs.select(F.col("src").alias("a"), F.col("dst").alias("b"), "weight")
    while True:
        gains = _gains(between).where(F.col("gain") > TOLERANCE)
        ends = gains.select(F.explode(F.array("a", "b")).alias("end"), "a", "b", (-F.round("gain", 12)).alias("cost"))
        best = ends.groupBy("end").agg(F.min(F.struct("cost", "a", "b")).alias("best"))
        pairs = written(best.groupBy("best.a", "best.b").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("a", "b"), "merges")
        if pairs.isEmpty():
            return member
        first, second = (pairs.select(F.col("b").alias(end), F.col("a").alias("into_" + end)) for end in ("a", "b"))
        between = written(between.join(first, "a", "left").join(second, "b", "left").groupBy(
            F.coalesce("into_a", "a").alias("a"), F.coalesce("into_b", "b").alias("b")).agg(F.sum("weight").alias("weight")), "between")
        step = pairs.select(F.col("b").alias("community"), F.col("a").alias("into"))
        member = written(member.join(step, "community", "left").select("id", F.coalesce("into", "community").alias("community")), "members")


def _local_moves(arcs: DataFrame, hub_edges: int, start: DataFrame) -> DataFrame:
    """(src, community), from the communities of `start` (id, community), once no node gains by a move, or once two rounds raise the modularity by less than the tolerance.

    The modularity is bounded, and each pair of rounds must raise it, so the loop ends; the best state is returned. Three
    nodes of four may move in a round, other ones each time: all at once they would chase each other.
    """
    adj = Adjacency(arcs, hub_edges)
    total_weight = adj.nodes.agg(F.sum("out_weight")).first()[0]
    total = F.lit(total_weight)
    state = written(adj.nodes.join(start.withColumnRenamed("id", "src"), "src").select(
        "src", "parts", "community", F.col("out_weight").alias("k")), "moves")
    best, idle, r = None, 0, -1
    while True:
        r += 1
        # Arcs exist both ways, so sending a node's community along them reaches its neighbours.
        links = adj.send(state, "community").filter("src <> dst").groupBy(
            F.col("dst").alias("src"), F.col("community").alias("near")).agg(F.sum("weight").alias("w"))
        sums = state.groupBy(F.col("community").alias("near")).agg(F.sum("k").alias("tot"))
        options = links.join(sums, "near").join(state, "src")
        own = F.when(F.col("near") == F.col("community"), F.col("k")).otherwise(0.0)
        gain = F.col("w") - (F.col("tot") - own) * F.col("k") / total
        judged = options.withColumn("gain", F.round(gain, 9))
        choice = judged.groupBy("src").agg(
            # The largest gain, and among equals the smallest community.
            F.min_by("near", F.struct(-F.col("gain"), F.col("near") != F.col("community"), "near")).alias("best"),
            F.max("gain").alias("top"),
            F.max(F.when(F.col("near") == F.col("community"), F.col("gain"))).alias("stay"),
            F.max(F.when(F.col("near") == F.col("community"), F.col("w"))).alias("own"))
        stays = sums.select(F.col("near").alias("community"), "tot")
        joined = state.join(choice, "src", "left").join(stays, "community", "left")
        base = F.coalesce("stay", -(F.col("tot") - F.col("k")) * F.col("k") / total)
        turn = F.pmod(F.xxhash64("src", F.lit(r // 4)) + F.lit(r), F.lit(4)) != 0
        wish = F.col("best").isNotNull() & (F.col("top") > base + 1e-9) & (F.col("best") != F.col("community"))
        nxt = written(joined.select(
            "src", "parts", F.col("community").alias("was"), F.when(wish & turn, F.col("best")).otherwise(F.col("community")).alias("community"), "k",
            F.coalesce("own", F.lit(0.0)).alias("own"), F.coalesce(wish, F.lit(False)).alias("moved")), "moves")
        # One pass tells the modularity before the moves, and whether any node would move.
        fact = nxt.groupBy("was").agg(F.sum("k").alias("tot"), F.sum("own").alias("own"), F.count_if("moved").alias("moved")).agg(
            F.sum("own").alias("inside"), F.sum(F.col("tot") * F.col("tot")).alias("square"), F.sum("moved").alias("moved")).first()
        value = fact["inside"] / total_weight - fact["square"] / total_weight ** 2
        if best is None or value > best[0] + TOLERANCE:
            best, idle = (value, state), 0
        else:
            idle += 1
            if idle == 2:
                return best[1].select("src", "community")
        if fact["moved"] == 0:
            return (state if value >= best[0] else best[1]).select("src", "community")
        state = nxt.drop("moved", "was", "own")


def k_hop(edges: DataFrame, start: DataFrame, depth: int, hub_edges: int = HUB_EDGES) -> DataFrame:
    """(id, depth): nodes within `depth` undirected steps of the start ids, with their distance.

    Hub edges are cut into parts, as in the other loops, and each reached hub is repeated once per part.
    """
    adj = Adjacency(written(both_ways(edges), "edges"), hub_edges)
    parts = adj.nodes.select(F.col("src").alias("id"), "parts")
    seen = start.select("id", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for d in range(1, depth + 1):
        state = frontier.join(parts, "id").select(F.col("id").alias("src"), "parts")
        reached = adj.send(state).select(F.col("dst").alias("id")).distinct()
        frontier = written(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The nearest `limit` nodes around the start and the edges among them."""
    nodes = k_hop(edges, start, depth).orderBy("depth", "id").limit(limit)
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, inside


def propagation_depth(edges: DataFrame, seeds: DataFrame, heads: DataFrame, max_depth: int) -> DataFrame:
    """Distance of each post from the nearest labelled post over similarity edges, up to a bound.

    `heads` (id, head) names the posts that are one node; edges lie among heads, and every post has its head's depth.
    """
    start = seeds.join(heads, "id").select(F.col("head").alias("id")).distinct()
    depth = k_hop(edges, start, max_depth).select(F.col("id").alias("head"), "depth")
    return heads.join(depth, "head").select("id", "depth")


def similar_depth(vectors: DataFrame, seeds: DataFrame, floor: float, max_depth: int, block: int = 4096) -> DataFrame:
    """(id, depth): distance of each of `vectors` (id, vector) from the nearest seed (id) over pairs at or above the floor, up to a bound.

    No edge is stored: in a round, the vectors not reached yet look for one of the last round's within reach, so disk grows with
    the vectors and not with their pairs. Copies are reached together; a copy of a seed that is none itself is one step away.
    """
    heads = written(similarity.head_of(vectors), "heads")
    marked = heads.join(seeds.select("id").distinct().withColumn("seed", F.lit(True)), "id", "left")
    base = written(vectors.join(heads.where("id = head").select("id"), "id", "left_semi").select("id", "vector"), "vectors")
    frontier = written(marked.where("seed").select(F.col("head").alias("id")).distinct().withColumn("depth", F.lit(0)), "frontier")
    seen = frontier
    for d in range(1, max_depth + 1):
        near, rest = base.join(frontier, "id", "left_semi"), base.join(seen, "id", "left_anti")
        if near.isEmpty() or rest.isEmpty():
            break
        reached = vector_index.one_at_least(rest, near, floor, block).select(F.col("query_id").alias("id")).distinct()
        frontier = written(reached.withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    own = F.when(F.col("seed"), 0).otherwise(F.greatest("depth", F.lit(1)))
    found = marked.join(seen.withColumnRenamed("id", "head"), "head").select("id", own.alias("depth"))
    return found.where(F.col("depth") <= max_depth)


def top_nodes(ranks: DataFrame, n: int) -> DataFrame:
    return ranks.orderBy(F.desc("score"), "id").limit(n)


def influential(ranks: DataFrame, threshold: float = 0.01) -> DataFrame:
    return ranks.filter(F.col("score") > threshold)


def share_among_top(ranks: DataFrame, nodes: DataFrame, node_type: str, n: int = 50) -> DataFrame:
    top = top_nodes(ranks, n).join(nodes, "id")
    hit = F.count_if(F.col("node_type") == node_type)
    return top.agg(F.count(F.lit(1)).alias("n"), hit.alias("hits"), (hit / F.count(F.lit(1))).alias("share"))


def botnet_communities(members: DataFrame, nodes: DataFrame, min_size: int = 10, scammer_share: float = 0.1,
                       victim_share: float = 0.3) -> DataFrame:
    """Communities larger than `min_size` whose scammer or victim share passes its bound."""
    kinds = members.join(nodes, "id").groupBy("community").agg(
        F.count(F.lit(1)).alias("total_nodes"), F.count_if(F.col("node_type") == "SCAMMER").alias("scammers"),
        F.count_if(F.col("node_type") == "VICTIM").alias("victims"))
    s, v = F.col("scammers") / F.col("total_nodes"), F.col("victims") / F.col("total_nodes")
    return kinds.filter(F.col("total_nodes") > min_size).filter((s > scammer_share) | (v > victim_share)).withColumns({
        "scammer_ratio": s, "victim_ratio": v, "botnet_probability": F.greatest(s, v)})


def graph_summary(edges: DataFrame, nodes: DataFrame, members: DataFrame, botnets: DataFrame) -> DataFrame:
    """(metric, value) rows: sizes, classes, communities and high-confidence botnets. Each input is read once."""
    def measured(df: DataFrame, **metrics: Column) -> DataFrame:
        one = df.agg(*[m.cast("double").alias(name) for name, m in metrics.items()])
        return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in metrics])))

    n = F.count(F.lit(1))
    sizes = members.groupBy("community").agg(n.alias("n"))
    return (measured(edges, edges=n)
            .unionByName(measured(nodes, nodes=n, scammers=F.count_if(F.col("node_type") == "SCAMMER"), victims=F.count_if(F.col("node_type") == "VICTIM")))
            .unionByName(measured(sizes, communities=n, avg_community_size=F.avg("n"), largest_community=F.max("n")))
            .unionByName(measured(botnets, botnets=n, high_confidence_botnets=F.count_if(F.col("botnet_probability") > 0.7))))


def update_nodes(nodes: DataFrame, results: DataFrame, columns: list[str]) -> DataFrame:
    """Node attributes replaced by analysis results where there are any."""
    fresh = results.select("id", *[F.col(c).alias(f"_{c}") for c in columns])
    return nodes.join(fresh, "id", "left").select(*[
        F.coalesce(f"_{c}", F.col(c)).alias(c) if c in columns else F.col(c) for c in nodes.columns])


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges left after removing the given ids with all their edges."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_anti").join(
        ids.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node and edge counts and the edges that miss an end."""
    missing = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_anti").select("src", "dst").union(
        edges.join(nodes.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")).distinct()
    return nodes.agg(F.count(F.lit(1)).alias("nodes")).select(
        "nodes", edges.agg(F.count(F.lit(1))).scalar().alias("edges"), missing.agg(F.count(F.lit(1))).scalar().alias("broken_edges"))


def resolved_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose both ends exist, with the node types of the ends."""
    a = nodes.select(F.col("id").alias("src"), F.col("node_type").alias("src_type"))
    b = nodes.select(F.col("id").alias("dst"), F.col("node_type").alias("dst_type"))
    return edges.join(a, "src").join(b, "dst")


def high_risk_users(flagged: DataFrame, posts: DataFrame, least: int = 3, n: int = 50) -> DataFrame:
    """Users with enough flagged contents and all their posts and types, most flagged first.

    `flagged`: user_id, content_id. `posts`: user_id, post_id, scam_type. Only the n users of the
    result have their posts gathered.
    """
    counts = flagged.groupBy("user_id").agg(F.count("content_id").alias("suspicious_count"))
    top = counts.filter(F.col("suspicious_count") >= least).orderBy(F.desc("suspicious_count"), "user_id").limit(n)
    return top.join(posts, "user_id").groupBy("user_id", "suspicious_count").agg(
        F.count("post_id").alias("n_posts"), F.array_sort(F.collect_set("scam_type")).alias("scam_types"),
        F.min("post_id").alias("first_post"), F.max("post_id").alias("last_post"))
