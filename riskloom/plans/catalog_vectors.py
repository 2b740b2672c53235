"""Vector neighbours, thresholds, edges and the pattern index."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import reports, retention, similarity
from riskloom.plans.registry import query

COS = "list_cosine_similarity(q.embedding::double[], v.embedding::double[])"


def _vectors(t):
    return t("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query("cosine_top_k", f"""
with p as (select q.vec_id as query_id, v.vec_id, round({COS}, 6) as similarity from embeddings q, embeddings v where q.vec_id <> v.vec_id)
select *, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank from p qualify rank <= 5""")
def _(t):
    return similarity.neighbours(_vectors(t), _vectors(t), 5, skip_self=True)


@query("cosine_top_k_blocked", f"""
with p as (select q.vec_id as query_id, v.vec_id, round({COS}, 6) as similarity from embeddings q, embeddings v where q.vec_id <> v.vec_id)
select *, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank from p qualify rank <= 3""")
def _(t):
    return similarity.neighbours(_vectors(t), _vectors(t), 3, skip_self=True, block=200)


@query("cosine_threshold_match", f"""
with p as (select q.vec_id as query_id, v.vec_id, round({COS}, 6) as similarity from embeddings q, embeddings v where q.vec_id <> v.vec_id)
select query_id, vec_id, similarity from p where similarity >= 0.35 qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 5""")
def _(t):
    found = similarity.neighbours(_vectors(t), _vectors(t), 5, skip_self=True)
    return found.filter("similarity >= 0.35").select("query_id", "vec_id", "similarity")


@query("hash_pseudo_embedding", """
with h as (select doc_id, md5(text) as m from documents)
select doc_id, array_to_string(list_transform(range(16), lambda i: (strpos('0123456789abcdef', m[(2*i+1)::int])-1) * 16 + strpos('0123456789abcdef', m[(2*i+2)::int]) - 1), ',') as bytes, 768 as dims from h""")
def _(t):
    rows = t("documents").select("doc_id", similarity.pseudo_embedding(F.col("text")).alias("v"))
    head = F.transform(F.slice("v", 1, 16), lambda x: F.round(x * 255).cast("int").cast("string"))
    return rows.select("doc_id", F.array_join(head, ",").alias("bytes"), F.size("v").alias("dims"))


@query("pattern_index_update_delete", """
with u as (select vec_id as id, case when label = 1 then 'changed' else 'pattern ' || vec_id end as document, label from embeddings where label <> 3)
select document, label, count(*) as n, min(id) as first_id from u group by 1, 2""")
def _(t):
    index = similarity.index_rows(
        t("embeddings"), "vec_id", "embedding", F.concat(F.lit("pattern "), F.col("vec_id")), {"label": F.col("label")}).withColumn("version", F.lit(1))
    changed = index.filter("metadata.label = 1").withColumns({"document": F.lit("changed"), "version": F.lit(2)})
    updated = retention.upsert(index, changed, ["id"], ["version"])
    left = similarity.remove_patterns(updated, index.filter("metadata.label = 3"))
    return left.groupBy("document", "metadata.label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("max_similarity_feature", f"""
with p as (select q.vec_id as query_id, max(round({COS}, 6)) as similarity from embeddings q, embeddings v where v.label = 1 group by 1) select * from p""")
def _(t):
    patterns = t("embeddings").filter("label = 1").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    # The pattern side is the small one: it is scanned against every post.
    found = similarity.neighbours(_vectors(t), patterns, 1)
    return found.select("query_id", "similarity")


@query("similar_to_edges", f"""
with p as (select q.vec_id as src, v.vec_id as dst, round({COS}, 6) as similarity from embeddings q, embeddings v where q.vec_id < v.vec_id)
select * from p where similarity >= 0.35""")
def _(t):
    return similarity.similar_edges(_vectors(t), 0.35, stars=False)


@query("pattern_statistics_sample", """
with s as (select * from embeddings order by vec_id limit 1000)
select 'label' as dimension, label::varchar as value, count(*) as n from s group by 2 union all select 'total', 'all', count(*) from s""")
def _(t):
    sample = t("embeddings").select("vec_id", "label").orderBy("vec_id").limit(1000)
    return reports.distributions(sample, {"label": "label", "total": F.lit("all")})
