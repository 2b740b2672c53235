"""Account graph: customers and parts joined by purchases, and the algorithms over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import graph
from riskloom.plans.registry import query
from riskloom.session import fresh_path, written

EDGE_SQL = """
i as (select o_custkey * 2 as src, l_partkey * 2 + 1 as dst, l_quantity as weight, l_returnflag as kind, o_orderdate, o_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate from lineitem join orders on l_orderkey = o_orderkey),
e as materialized (select src, dst, sum(weight) as weight, count(*) as interactions from i group by 1, 2)"""
NODE_SQL = """
nodes as (select c_custkey * 2 as id, case when c_acctbal < -500 then 'SCAMMER' when c_acctbal > 8500 then 'VICTIM' else 'USER' end as node_type from customer
  union all select p_partkey * 2 + 1, 'CONTENT' from part)"""


def _interactions(t):
    lines = t("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_suppkey", "l_extendedprice", "l_shipdate")
    orders = t("orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.col("o_custkey") * 2).alias("src"), (F.col("l_partkey") * 2 + 1).alias("dst"), F.col("l_quantity").alias("weight"),
        F.col("l_returnflag").alias("interaction_type"), F.struct("o_orderdate", "o_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag").alias("at"))


def _edges(t, min_interactions=1):
    return graph.build_edges(_interactions(t), min_interactions)


def _nodes(t):
    balance = F.col("c_acctbal")
    users = t("customer").select((F.col("c_custkey") * 2).alias("id"), F.when(balance < -500, "SCAMMER").when(
        balance > 8500, "VICTIM").otherwise("USER").alias("node_type"))
    return users.unionByName(t("part").select((F.col("p_partkey") * 2 + 1).alias("id"), F.lit("CONTENT").alias("node_type")))


@query("interaction_edges", f"with {EDGE_SQL} select src, dst, weight, interactions from e")
def _(t):
    return _edges(t).select("src", "dst", "weight", "interactions")


@query("first_relation_type", f"""with {EDGE_SQL}
select src, dst, arg_min(kind, (o_orderdate, o_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_shipdate, kind)) as relation_type from i group by 1, 2""")
def _(t):
    return _edges(t).select("src", "dst", "relation_type")


@query("graph_nodes", f"""with {EDGE_SQL} select node_type, count(*) as n, min(id) as first_id, max(id) as last_id from (
  select distinct src as id, 'USER' as node_type from e union all select distinct dst, 'CONTENT' from e) group by 1""")
def _(t):
    return graph.nodes_of(_edges(t)).groupBy("node_type").agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("edge_endpoints_resolved", f"""with {EDGE_SQL}, {NODE_SQL}
select a.node_type as src_type, b.node_type as dst_type, count(*) as n, sum(weight)::double as weight from e join nodes a on a.id = src join nodes b on b.id = dst group by 1, 2""")
def _(t):
    return graph.resolved_edges(_edges(t), _nodes(t)).groupBy("src_type", "dst_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("weight").alias("weight"))


@query("graph_export", f"""with {EDGE_SQL}, {NODE_SQL}
select (select count(*) from nodes) as nodes, count(*) as edges, sum(weight)::double as weight from e where src in (select id from nodes) and dst in (select id from nodes)""")
def _(t):
    nodes, edges = _nodes(t), _edges(t).select("src", "dst", "weight")
    valid = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    path = fresh_path(t.spark, "graph")
    nodes.write.parquet(path + "/nodes")
    valid.write.parquet(path + "/edges")
    back = t.spark.read.schema("id long, node_type string").parquet(path + "/nodes")
    edges_back = t.spark.read.schema("dst long, src long, weight double").parquet(path + "/edges")
    return edges_back.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")).select(
        back.agg(F.count(F.lit(1))).scalar().alias("nodes"), "edges", "weight")


# ---- PageRank ----------------------------------------------------------------------------------------

def _rank_sql(rounds: int) -> str:
    ctes = [EDGE_SQL, """
a as materialized (select src, dst, weight from e union all select dst, src, weight from e), ow as (select src, sum(weight) as w from a group by 1),
s as materialized (select a.src, a.dst, a.weight / ow.w as share from a join ow on ow.src = a.src), n as (select count(*)::double as n from ow),
r0 as materialized (select src as id, 1.0::double / n as score from ow, n)"""]
    for k in range(1, rounds + 1):
        ctes.append(f"""r{k} as materialized (select s.dst as id, 0.15::double / any_value(n) + 0.85::double * sum(r.score * s.share) as score
  from s join r{k - 1} r on r.id = s.src, n group by s.dst)""")
    return ", ".join(ctes)


RANKS = f"with {_rank_sql(20)}, ranks as (select id, score from r20)"


def _ranks(t):
    return graph.page_rank(graph.both_ways(_edges(t)), iterations=20)


@query("page_rank", f"{RANKS} select id, round(score, 9) as score from ranks")
def _(t):
    return _ranks(t).select("id", F.round("score", 9).alias("score"))


@query("top_ranked_nodes", f"{RANKS}, r as (select id, round(score, 9) as score from ranks) select id, score from r order by score desc, id limit 100")
def _(t):
    return graph.top_nodes(_ranks(t).withColumn("score", F.round("score", 9)), 100)


@query("influential_nodes", f"{RANKS} select id, round(score, 9) as score from ranks where round(score, 9) > 0.0005")
def _(t):
    return graph.influential(_ranks(t).withColumn("score", F.round("score", 9)), 0.0005)


@query("scammer_share_among_top", f"""{RANKS}, {NODE_SQL}, r as (select id, round(score, 9) as score from ranks order by 2 desc, 1 limit 50)
select count(*) as n, count_if(node_type = 'SCAMMER')::bigint as hits, round(count_if(node_type = 'SCAMMER')::double / count(*), 6) as share from r join nodes using (id)""")
def _(t):
    out = graph.share_among_top(_ranks(t).withColumn("score", F.round("score", 9)), _nodes(t), "SCAMMER", 50)
    return out.withColumn("share", F.round("share", 6))


# ---- components, communities ------------------------------------------------------------------------

def _labels_sql(rounds: int) -> str:
    """Smallest label over all neighbours, round after round; the graph's diameter is far below `rounds`."""
    ctes = [EDGE_SQL, """b as materialized (select src, dst from e union select dst, src from e union select src, src from e union select dst, dst from e),
l0 as materialized (select distinct src as id, src as label from b)"""]
    for k in range(1, rounds + 1):
        ctes.append(f"l{k} as materialized (select b.dst as id, min(label) as label from b join l{k - 1} on l{k - 1}.id = b.src group by 1)")
    return ", ".join([*ctes, f"c as (select id, label as component from l{rounds})"])


LABELS = _labels_sql(12)


@query("connected_components", f"with {LABELS} select id, component from c")
def _(t):
    return graph.components(_pairs(t))


def _pairs(t):
    return written(_edges(t).select("src", "dst"), "edges")


def _members(t):
    return graph.components(_pairs(t)).withColumnRenamed("component", "community")


@query("botnet_communities", f"""with {LABELS}, {NODE_SQL},
k as (select component as community, count(*) as total_nodes, count_if(node_type = 'SCAMMER')::bigint as scammers, count_if(node_type = 'VICTIM')::bigint as victims from c join nodes using (id) group by 1)
select community, total_nodes, scammers, victims, round(scammers / total_nodes::double, 6) as scammer_ratio, round(victims / total_nodes::double, 6) as victim_ratio,
  round(greatest(scammers, victims) / total_nodes::double, 6) as botnet_probability from k where total_nodes > 10 and (scammers / total_nodes::double > 0.05 or victims / total_nodes::double > 0.1)""")
def _(t):
    out = graph.botnet_communities(_members(t), _nodes(t), 10, 0.05, 0.1)
    return out.select("community", "total_nodes", "scammers", "victims",
                      *[F.round(c, 6).alias(c) for c in ("scammer_ratio", "victim_ratio", "botnet_probability")])


@query("graph_summary_report", f"""with {LABELS}, {NODE_SQL},
k as (select component as community, count(*) as n, count_if(node_type = 'SCAMMER') as s, count_if(node_type = 'VICTIM') as v from c join nodes using (id) group by 1),
z as (select greatest(s, v) / n::double as p from k where n > 3 and (s / n::double > 0.1 or v / n::double > 0.3))
select 'edges' as metric, count(*)::double as value from e union all select 'nodes', count(*) from nodes union all select 'scammers', count_if(node_type = 'SCAMMER') from nodes
union all select 'victims', count_if(node_type = 'VICTIM') from nodes union all select 'communities', count(*) from k union all select 'avg_community_size', round(avg(n), 6) from k
union all select 'largest_community', max(n) from k union all select 'botnets', count(*) from z union all select 'high_confidence_botnets', coalesce(count_if(p > 0.7), 0) from z""")
def _(t):
    edges, nodes = _pairs(t), _nodes(t)
    members = written(graph.components(edges).withColumnRenamed("component", "community"), "members")
    out = graph.graph_summary(edges, nodes, members, graph.botnet_communities(members, nodes, 3, 0.1, 0.3))
    return out.withColumn("value", F.round("value", 6))


@query("modularity_communities")
def _(t):
    return graph.communities(_edges(t).select("src", "dst", "weight"))


@query("modularity_settled", f"""with {EDGE_SQL}, n as (select src as id from e union select dst from e)
select (select count(*) from n) as nodes, (select round(sum(weight), 6) from e) as weight, 0::bigint as better_merges, true as beats_components""")
def _(t):
    # Every node has one community, no two of them gain by becoming one, and the labelling is above that of the components.
    edges = written(_edges(t).select("src", "dst", "weight"), "edges")
    members, parts = written(graph.communities(edges), "members"), graph.components(edges).withColumnRenamed("component", "community")
    better = graph.merge_gains(edges, members).where(F.col("gain") > graph.TOLERANCE).agg(F.count(F.lit(1))).scalar()
    above = graph.modularity(edges, members).scalar() >= graph.modularity(edges, parts).scalar()
    labelled = members.agg(F.count(F.lit(1))).scalar()
    return edges.agg(F.round(F.sum("weight"), 6).alias("weight")).select(
        labelled.alias("nodes"), "weight", better.alias("better_merges"), above.alias("beats_components"))


@query("botnets_by_modularity")
def _(t):
    members = graph.communities(_edges(t).select("src", "dst", "weight"))
    return graph.botnet_communities(members, _nodes(t), 10, 0.05, 0.1)


# ---- neighbourhoods ---------------------------------------------------------------------------------

HOP_SQL = f"""{EDGE_SQL}, u as materialized (select src, dst from e union select dst, src from e),
h(id, d) as (select c_custkey * 2, 0 from customer where c_acctbal < -900 union select u.dst, h.d + 1 from h join u on u.src = h.id where h.d < 3),
k as (select id, min(d) as depth from h group by 1)"""


@query("k_hop_neighbourhood", f"with recursive {HOP_SQL} select id, depth from k")
def _(t):
    start = t("customer").filter("c_acctbal < -900").select((F.col("c_custkey") * 2).alias("id"))
    return graph.k_hop(_edges(t).select("src", "dst"), start, 3)


@query("neighbourhood_subgraph", f"""with recursive {HOP_SQL}, n as (select id, depth from k order by depth, id limit 100)
select src, dst, weight from e where src in (select id from n) and dst in (select id from n)""")
def _(t):
    start = t("customer").filter("c_acctbal < -900").select((F.col("c_custkey") * 2).alias("id"))
    _, inside = graph.neighbourhood(_edges(t), start, 3, 100)
    return inside.select("src", "dst", "weight")


@query("propagation_depth", """
with recursive p as (select q.vec_id as src, v.vec_id as dst from embeddings q, embeddings v where q.vec_id <> v.vec_id
   and round(list_cosine_similarity(q.embedding::double[], v.embedding::double[]), 6) >= 0.3),
h(id, d) as (select vec_id, 0 from embeddings where label = 1 union select p.dst, h.d + 1 from h join p on p.src = h.id where h.d < 4)
select id, min(d) as depth from h group by 1""")
def _(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return graph.similar_depth(vectors, t("embeddings").filter("label = 1").select(F.col("vec_id").alias("id")), 0.3, 4)


# ---- node upkeep ------------------------------------------------------------------------------------

@query("node_attributes_updated", f"""with {NODE_SQL}, r as (select o_custkey * 2 as id, avg(o_totalprice) as s from orders where o_orderstatus = 'F' group by 1)
select id, node_type, round(coalesce(s, 0.0::double), 6) as score from nodes left join r using (id)""")
def _(t):
    results = t("orders").filter("o_orderstatus = 'F'").groupBy((F.col("o_custkey") * 2).alias("id")).agg(F.avg("o_totalprice").alias("score"))
    nodes = _nodes(t).withColumn("score", F.lit(0.0))
    return graph.update_nodes(nodes, results, ["score"]).withColumn("score", F.round("score", 6))


@query("nodes_deleted_with_edges", f"""with {EDGE_SQL}, {NODE_SQL}, g as (select c_custkey * 2 as id from customer where c_acctbal < 0 union select p_partkey * 2 + 1 from part where p_size > 40)
select (select count(*) from nodes where id not in (select id from g)) as nodes, count(*) as edges, sum(weight)::double as weight from e where src not in (select id from g) and dst not in (select id from g)""")
def _(t):
    gone = t("customer").filter("c_acctbal < 0").select((F.col("c_custkey") * 2).alias("id")).union(
        t("part").filter("p_size > 40").select((F.col("p_partkey") * 2 + 1).alias("id")))
    nodes, edges = graph.delete_nodes(_nodes(t), _edges(t), gone)
    return edges.agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight")).select(
        nodes.agg(F.count(F.lit(1))).scalar().alias("nodes"), "edges", "weight")


@query("high_probability_users", """
with p as (select c_custkey, abs(c_acctbal) / 10000 as p from customer)
select c_custkey, round(p, 9) as probability, o_orderkey from p join orders on o_custkey = c_custkey where p > 0.8 order by p desc, c_custkey, o_orderkey limit 100""")
def _(t):
    users = t("customer").select("c_custkey", (F.abs("c_acctbal") / 10000).alias("p")).filter("p > 0.8")
    posts = t("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return users.join(posts, "c_custkey").orderBy(F.desc("p"), "c_custkey", "o_orderkey").limit(100).select(
        "c_custkey", F.round("p", 9).alias("probability"), "o_orderkey")


@query("graph_health", f"""with {EDGE_SQL}, x as (select c_custkey * 2 as id from customer where c_acctbal >= 0 union all select p_partkey * 2 + 1 from part)
select (select count(*) from x) as nodes, (select count(*) from e) as edges, (select count(*) from e where src not in (select id from x) or dst not in (select id from x)) as broken_edges""")
def _(t):
    nodes = t("customer").filter("c_acctbal >= 0").select((F.col("c_custkey") * 2).alias("id")).union(
        t("part").select((F.col("p_partkey") * 2 + 1).alias("id")))
    return graph.graph_health(nodes, _edges(t))


HIGH_RISK_SQL = """
with c as (select max(ts) as now from events), f as (select user_id, count(*) as n from events, c where ts >= now - interval 240 hour and event_type = 'error' group by 1 having count(*) >= 3 order by n desc, user_id limit 50)
select user_id, n as suspicious_count, count(*) as n_posts, string_agg(distinct event_type, ',' order by event_type) as scam_types, min(event_id) as first_post, max(event_id) as last_post
from f join events using (user_id) group by 1, 2"""


@query("high_risk_users", HIGH_RISK_SQL)
def _(t):
    events = t("events")
    now = events.agg(F.max("ts")).scalar()
    flagged = events.filter((F.col("ts") >= now - F.expr("interval 240 hours")) & (F.col("event_type") == "error")).select(
        "user_id", F.col("event_id").alias("content_id"))
    posts = events.select("user_id", F.col("event_id").alias("post_id"), F.col("event_type").alias("scam_type"))
    out = graph.high_risk_users(flagged, posts)
    return out.withColumn("scam_types", F.array_join("scam_types", ","))


@query("flagged_user_posts", """
with f as (select o_custkey, count(*) as n from orders where o_orderstatus = 'P' group by 1 having count(*) >= 3)
select o_custkey, n as flagged, count(*) as posts, round(sum(o_totalprice), 2) as total from f join orders using (o_custkey) group by 1, 2""")
def _(t):
    orders = t("orders")
    flagged = orders.filter("o_orderstatus = 'P'").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("flagged")).filter("flagged >= 3")
    return flagged.join(orders, "o_custkey").groupBy("o_custkey", "flagged").agg(
        F.count(F.lit(1)).alias("posts"), F.round(F.sum("o_totalprice"), 2).alias("total"))
