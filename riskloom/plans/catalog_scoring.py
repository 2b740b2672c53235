"""Lexicon scorers, score ladders, feature encodings and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions import maps, scores
from riskloom.functions.patterns import any_pattern, count_words, matched_words
from riskloom.functions.text import match_form
from riskloom.operators import drift, lexicon, ordered
from riskloom.plans import fixture as fx
from riskloom.plans.fixture import dbl, quoted, sql_count_patterns, sql_count_words
from riskloom.plans.registry import query
from riskloom.sources.reference import literal_table

LOW = "lower(text)"


@query("keyword_profile", f"""
with k as (select doc_id, text, {fx.sql_words(LOW, fx.KEYWORDS)} as keywords from documents)
select doc_id, keywords, round(least(case when keywords = '' then 0 else len(string_split(keywords, ',')) end * 0.1::double, 1.0::double), 6) as keyword_score,
  contains({LOW}, 'tear') or contains({LOW}, 'only') as has_slang,
  case when list_has_any(string_split(keywords, ','), ['worthless', 'pathetic', 'stupid']) then 'insult'
    when list_has_any(string_split(keywords, ','), ['token']) then 'secret'
    when list_has_any(string_split(keywords, ','), ['license', 'rating']) then 'legal' else 'suspicious_content' end as scam_type from k""")
def _(t):
    out = lexicon.keyword_profile(t.wide("documents"), "text", fx.KEYWORDS, fx.SLANG_WORDS, fx.KEYWORD_TYPES)
    return out.select("doc_id", F.array_join("keywords", ",").alias("keywords"),
                      F.round("keyword_score", 6).alias("keyword_score"), "has_slang", "scam_type")


@query("text_densities", f"""
select doc_id, round(least({sql_count_patterns(LOW, fx.URGENCY)} / 5.0::double, 1.0::double), 6) as urgency,
  round(least({sql_count_patterns(LOW, fx.ACTIONS)} / 3.0::double, 1.0::double), 6) as call_to_action,
  round(least({sql_count_patterns(LOW, fx.LINKS)} / 5.0::double, 1.0::double), 6) as links from documents""")
def _(t):
    text = F.col("text")
    return t.wide("documents").select(
        "doc_id", F.round(scores.density(text, fx.URGENCY, 5), 6).alias("urgency"),
        F.round(scores.density(text, fx.ACTIONS, 3), 6).alias("call_to_action"),
        F.round(scores.density(text, fx.LINKS, 5), 6).alias("links"))


INTENT_SQL = "with i as (select doc_id, " + ", ".join(
    f"round(least({sql_count_patterns(LOW, pats)} / {dbl(max(len(pats) * 0.3, 1.0))}, 1.0::double), 3) as s{i}"
    for i, (_, _, pats) in enumerate(fx.INTENTS)) + """ from documents)
select doc_id, s0 as intent_abuse, s1 as intent_credential, s2 as intent_legal, s3 as intent_pressure,
  greatest(s0, s1, s2, s3) as max_intent_score, ((s0 > 0.3)::int + (s1 > 0.3)::int + (s2 > 0.3)::int + (s3 > 0.3)::int) as intent_count,
  case when greatest(s0, s1, s2, s3) = 0 then 'none' when s0 = greatest(s0, s1, s2, s3) then 'abuse' when s1 = greatest(s0, s1, s2, s3) then 'credential'
   when s2 = greatest(s0, s1, s2, s3) then 'legal' else 'pressure' end as primary_intent,
  round(least((s0 * 0.9::double + s1 * 0.95::double + s2 * 0.5::double + s3 * 0.7::double) / 2, 1.0::double), 6) as risk_weighted_score from i"""


@query("intent_scores", INTENT_SQL)
def _(t):
    out = lexicon.intent_scores(t.wide("documents").select("doc_id", "text"), "text", fx.INTENTS).drop("text")
    return out.withColumn("risk_weighted_score", F.round("risk_weighted_score", 6))


MARKERS = {"alpha": "worthless|pathetic", "beta": "license", "gamma": "token", "delta": "mail|example", "eps": "[0-9]{3} [0-9]"}
FLOORS = ((("alpha",), ("beta", "gamma")), 0.62), ((("gamma", "beta"), ("delta",), ("eps", "alpha")), 0.75), ((("eps",),), 0.72)


@query("marker_hits_and_floors", """
with f as (select doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g')) as t from documents),
h as (select doc_id, regexp_matches(t, 'worthless|pathetic') a, regexp_matches(t, 'license') b, regexp_matches(t, 'token') c,
  regexp_matches(t, 'mail|example') d, regexp_matches(t, '[0-9]{3} [0-9]') e from f)
select doc_id, concat_ws(',', case when a then 'alpha' end, case when b then 'beta' end, case when c then 'gamma' end, case when d then 'delta' end, case when e then 'eps' end) as hits,
  round(greatest(least((a::int + b::int + c::int + d::int + e::int) * 0.15::double, 1.0::double), case when a and (b or c) then 0.62 else 0 end,
   case when (c or b) and d and (e or a) then 0.75 else 0 end, case when e then 0.72 else 0 end), 6) as score from h""")
def _(t):
    hits, score = lexicon.marker_scores(F.col("form"), MARKERS, FLOORS)
    return t.wide("documents").select("doc_id", match_form(F.col("text")).alias("form")).select(
        "doc_id", F.array_join(hits, ",").alias("hits"), F.round(score, 6).alias("score"))


@query("additive_text_score", f"""
select doc_id, round(least({sql_count_patterns(LOW, fx.URGENCY)} * 0.15::double + {sql_count_words(LOW, fx.SLANG_WORDS)} * 0.05::double, 1.0::double), 6) as score from documents""")
def _(t):
    return t.wide("documents").select("doc_id", F.round(scores.additive_score(F.col("text"), fx.URGENCY, fx.SLANG_WORDS), 6).alias("score"))


@query("keyword_share_verdict", f"""
with s as (select doc_id, {sql_count_words(LOW, fx.KEYWORDS)} / 10.0::double as b, {sql_count_words(LOW, ['hate', 'tear', 'idiot', 'loser', 'only'])} / 5.0::double as r from documents)
select doc_id, case when b > 0.3::double then 'FAKE_SCAM' when r > 0.2::double then 'SUSPICIOUS' else 'SAFE' end as label,
  round(case when b > 0.3::double then least(b + 0.5, 0.9::double) when r > 0.2::double then least(r + 0.5, 0.9::double) else 0.8::double end, 6) as confidence from s""")
def _(t):
    label, sure = scores.keyword_share_verdict(F.col("text"), fx.KEYWORDS, ["hate", "tear", "idiot", "loser", "only"])
    return t.wide("documents").select("doc_id", label.alias("label"), F.round(sure, 6).alias("confidence"))


@query("lexicon_hit_risk", f"""
select doc_id, {sql_count_words(LOW, fx.KEYWORDS)} as hits, round(least(least({sql_count_words(LOW, ['hate', 'tear'])} * 0.12::double
  + {sql_count_words(LOW, fx.KEYWORDS)} * 0.08::double, 0.75::double), 0.5::double), 6) as risk from documents""")
def _(t):
    low = F.lower("text")
    hits = count_words(low, fx.KEYWORDS)
    risk = F.least(F.least(count_words(low, ["hate", "tear"]) * F.lit(0.12) + hits * F.lit(0.08), F.lit(0.75)), F.lit(0.5))
    return t.wide("documents").select("doc_id", hits.alias("hits"), F.round(risk, 6).alias("risk"))


HIGH, MED, URLW = ["the", "ing", "orre"], ["and", "for", "was"], ["blog", "utm", "org"]


@query("url_text_risk_tier", f"""
with b as (select page_id, url, lower(url || ' ' || regexp_extract(html, '<title>([^<]*)', 1)) as x, lower(url) as u from pages),
h as (select page_id, {sql_count_words('x', ['worth', 'tition', 'anan'])} as h, {sql_count_words('x', MED)} as m, {sql_count_words('u', URLW)} as w,
   contains(u, '/de/') as s from b)
select page_id, round(case when h >= 2 or w >= 2 then least(0.85::double, 0.55::double + h * 0.08::double + w * 0.06::double)
  when h = 1 then least(0.75::double, 0.45::double + m * 0.05::double) when m >= 2 then least(0.60::double, 0.35::double + m * 0.06::double)
  when m = 1 then 0.38::double when s then 0.10::double else 0.20::double end, 6) as risk from h""")
def _(t):
    title = F.regexp_extract("html", "<title>([^<]*)", 1)
    return t.wide("pages").select("page_id", F.round(scores.url_text_risk(
        F.col("url"), title, ["worth", "tition", "anan"], MED, URLW, ["/de/"]), 6).alias("risk"))


@query("lexicon_join_matches", f"""
with x(category, pattern) as (values ('insult', 'worthless'), ('insult', 'pathetic'), ('secret', 'token'), ('legal', 'license'), ('legal', 'rating'))
select doc_id, category, pattern from documents, x where contains({LOW}, pattern)""")
def _(t):
    from riskloom.sources.reference import lexicon_matches, literal_table
    table = literal_table(
        t.spark, [("insult", "worthless"), ("insult", "pathetic"), ("secret", "token"), ("legal", "license"), ("legal", "rating")],
        "category string, pattern string")
    return lexicon_matches(t.wide("documents"), "doc_id", "text", table)


@query("lexicon_word_join", f"""
with l as (select distinct unnest(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1)) as pattern from benchmark)
select doc_id, count(*) as known_words from documents, l where contains({LOW}, pattern) group by 1""")
def _(t):
    from riskloom.sources.reference import lexicon_matches
    words = t("benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?U)(\w+)"), 1)).alias("pattern"))
    table = words.distinct().select(F.lit("known").alias("category"), "pattern")
    hits = lexicon_matches(t.wide("documents"), "doc_id", "text", table)
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("known_words"))


LOOSE = [("number", "[0-9]{16}"), ("number", r"\+1 \([0-9]+\)"), ("mark", "(!!|[|]{2})")]


@query("lexicon_regex_matches", rf"""
with w as (select regexp_extract_all(lower(text), '[\p{{L}}]+') as w from benchmark),
l as (select distinct 'phrase' as category, w[i] as a, w[i + 1] as b, w[i] || 's?\s+(?:the\s+|[a-z]{{2}}\s+)?' || w[i + 1] as pattern from (select w, unnest(range(1, len(w))) as i from w)
  union all select * from (values {', '.join(f"('{c}', '', '', {fx.quoted(p)})" for c, p in LOOSE)})),
d as materialized (select doc_id, {LOW} as low from documents),
near as materialized (select doc_id, low, category, pattern from d, l where contains(low, a) and contains(low, b))
select doc_id, category, pattern from near where regexp_matches(low, pattern)""")
def _(t):
    from riskloom.operators.pattern_lexicon import regex_matches
    words = t("benchmark").select(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)).alias("w")).where(F.size("w") > 1)
    two = words.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(
        F.get("w", i), F.lit(r"s?\s+(?:the\s+|[a-z]{2}\s+)?"), F.get("w", i + 1)))).alias("pattern")).distinct()
    lexicon = two.select(F.lit("phrase").alias("category"), "pattern").unionByName(literal_table(t.spark, LOOSE, "category string, pattern string"))
    return regex_matches(t.wide("documents"), "doc_id", "text", lexicon)


NEW = {"ai": ("worthless", "token"), "tech": ("license", "rating", "free"), "social": ("loser",)}
EMERGING = {"secrets": ("token =", "mail"), "abuse": ("pathetic", "stupid")}


def _drift(t):
    docs = t.wide("documents")
    known = t("benchmark").select(F.explode(matched_words(
        F.lower("text"), [w for ws in NEW.values() for w in ws])).alias("word"))
    words = drift.new_keywords(drift.drift_hits(docs, "doc_id", "text", NEW, "keyword", 20), known)
    patterns = drift.drift_hits(docs, "doc_id", "text", EMERGING, "pattern")
    return docs, words, patterns


DRIFT_SQL = f"""
x(grp, word) as (values ('ai', 'worthless'), ('ai', 'token'), ('tech', 'license'), ('tech', 'rating'), ('tech', 'free'), ('social', 'loser')),
y(grp, word) as (values ('secrets', 'token ='), ('secrets', 'mail'), ('abuse', 'pathetic'), ('abuse', 'stupid')),
k as (select doc_id, grp, word from documents, x where contains({LOW}, word) and not exists (select 1 from benchmark b where contains(lower(b.text), word))),
p as (select doc_id, grp, word from documents, y where contains({LOW}, word))"""


@query("new_keywords_not_known", f"""with {DRIFT_SQL}
select doc_id, grp as "group", word, trim(text[greatest(strpos({LOW}, word) - 20, 1) : strpos({LOW}, word) + length(word) + 19]) as context
from k join documents using (doc_id)""")
def _(t):
    _, words, _ = _drift(t)
    return words.select("doc_id", "group", "word", "context")


@query("drift_profile", f"""with {DRIFT_SQL},
c as (select d.doc_id, (select count(*) from k where k.doc_id = d.doc_id) as nk, (select count(*) from p where p.doc_id = d.doc_id) as np from documents d)
select doc_id, nk as n_new_keywords, np as n_new_patterns, nk + np > 0 as is_new_pattern, round(least(nk * 0.1::double + np * 0.15::double, 1.0::double), 6) as drift_score,
  round(least(least(nk * 0.1::double + np * 0.15::double, 1.0::double) + nk * 0.1::double + np * 0.15::double, 1.0::double), 6) as confidence from c""")
def _(t):
    out = drift.drift_profile(*(lambda d, w, p: (d, "doc_id", w, p))(*_drift(t)))
    return out.withColumns({"drift_score": F.round("drift_score", 6), "confidence": F.round("confidence", 6)})


@query("pattern_severity", f"""with {DRIFT_SQL}
select grp as "group", word, case when contains(word, 'token') or contains(word, 'stupid') then 'high' when contains(word, 'mail') then 'medium' else 'low' end as severity,
  count(*) as n from p group by 1, 2, 3""")
def _(t):
    _, _, patterns = _drift(t)
    return patterns.groupBy("group", "word", drift.severity(F.col("word"), ["token", "stupid"], ["mail"]).alias("severity")).agg(
        F.count(F.lit(1)).alias("n"))


# ---- account metadata ------------------------------------------------------------------------

def _ladder_sql(x, steps, op="<"):
    return "case " + " ".join(f"when {x} {op} {b} then {s}::double" for b, s in steps) + " else 0.0::double end"


@query("account_age_score", f"""
with a as (select c_custkey, case when c_nationkey = 0 then null else abs(c_acctbal) / 20 end as days from customer)
select c_custkey, case when days is null then 0.5::double else {_ladder_sql('days', fixed.ACCOUNT_AGE_STEPS)} end as score from a""")
def _(t):
    days = F.when(F.col("c_nationkey") == 0, None).otherwise(F.abs("c_acctbal") / 20)
    return t("customer").select("c_custkey", scores.account_age_score(days).alias("score"))


@query("follower_ratio_score", f"""
with n as (select user_id, count_if(event_type = 'signup') as followers, count_if(event_type in ('click', 'view', 'error')) * 3 as following from events group by 1),
r as (select user_id, greatest(followers, 1)::double / greatest(following, 1) as r from n)
select user_id, {_ladder_sql('r', fixed.FOLLOWER_RATIO_STEPS)} as score from r""")
def _(t):
    kind = F.col("event_type")
    return t("events").groupBy("user_id").agg(
        F.count_if(kind == "signup").alias("f"), (F.count_if(kind.isin("click", "view", "error")) * 3).alias("g")
    ).select("user_id", scores.follower_ratio_score(F.col("f"), F.col("g")).alias("score"))


@query("post_rate_score", f"""
with n as (select user_id, cast(ts as date) as d, count(*) * 3 as per_day from events group by 1, 2)
select user_id, cast(d as varchar) as day, {_ladder_sql('per_day', fixed.POST_RATE_STEPS, '>')} as score from n""")
def _(t):
    return t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg((F.count(F.lit(1)) * 3).alias("n")).select(
        "user_id", F.col("d").cast("string").alias("day"), scores.post_rate_score(F.col("n")).alias("score"))


@query("engagement_score", """
with n as (select user_id, cast(ts as date) as d, count_if(event_type = 'click') as l, count_if(event_type = 'error') as c, count_if(event_type = 'view') * 40 as v from events group by 1, 2),
r as (select user_id, d, (l + c)::double / greatest(v, 1) as r from n)
select user_id, cast(d as varchar) as day, case when r < 0.001 then 0.8::double when r > 0.5 then 0.7::double when r < 0.01 then 0.4::double else 0.0::double end as score from r""")
def _(t):
    kind = F.col("event_type")
    return t("events").groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count_if(kind == "click").alias("l"), F.count_if(kind == "error").alias("c"), (F.count_if(kind == "view") * 40).alias("v")
    ).select("user_id", F.col("d").cast("string").alias("day"), scores.engagement_score(F.col("l"), F.col("c"), F.col("v")).alias("score"))


@query("modal_conflict_and_product", """
select event_id, round(abs(value / 100 - (event_id % 97) / 97.0::double), 6) as conflict, round(value / 100 * ((event_id % 97) / 97.0::double), 6) as product from events""")
def _(t):
    a, b = F.col("value") / 100, (F.col("event_id") % 97) / 97.0
    return t("events").select("event_id", F.round(F.abs(a - b), 6).alias("conflict"), F.round(a * b, 6).alias("product"))


@query("feature_vector_14", f"""
with m as (select *, (n_chars % 101) / 100.0::double as vision, (doc_id % 7) / 7.0::double as risk, greatest(doc_id % 50, 1)::double / greatest(n_chars % 700, 1) as follow,
  ((doc_id % 9) + (n_chars % 4))::double / greatest(n_chars % 900, 1) as engage from documents)
select d.doc_id, round(vision, 6) as vision_risk, round((doc_id % 5) / 5.0::double, 6) as text_safe, round((doc_id % 3) / 3.0::double, 6) as text_suspicious,
  round((doc_id % 13) / 13.0::double, 6) as similarity, round(case when length(text) > length(regexp_replace(text, '\\p{{L}}', '', 'g')) then least((length(text) - length(translate(text, '{fixed.SUBSTITUTED_OF_LETTERS}', '')))::double
   / (length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g'))) * 5, 1.0::double) else 0 end, 6) as leet,
  round(least({sql_count_patterns(LOW, fx.URGENCY)} / 5.0::double, 1.0::double), 6) as urgency, round(least({sql_count_patterns(LOW, fx.ACTIONS)} / 3.0::double, 1.0::double), 6) as call_to_action,
  round(least({sql_count_patterns(LOW, fx.LINKS)} / 5.0::double, 1.0::double), 6) as suspicious_links, {_ladder_sql('(n_chars % 500)', fixed.ACCOUNT_AGE_STEPS)} as account_age,
  {_ladder_sql('follow', fixed.FOLLOWER_RATIO_STEPS)} as follower_ratio, {_ladder_sql('(doc_id % 60)', fixed.POST_RATE_STEPS, '>')} as post_rate,
  case when engage < 0.001 then 0.8::double when engage > 0.5 then 0.7::double when engage < 0.01 then 0.4::double else 0.0::double end as engagement,
  round(abs(vision - risk), 6) as conflict, round(vision * risk, 6) as product from m d""".replace("\\\\", "\\"))
def _(t):
    from riskloom.plans.features import post_features
    key, size = F.col("doc_id"), F.col("n_chars")
    row = post_features(
        text=F.col("text"), vision_risk=(size % 101) / 100.0, text_risk=(key % 7) / 7.0, similarity=(key % 13) / 13.0, text_safe=(key % 5) / 5.0,
        text_suspicious=(key % 3) / 3.0, account_age_days=size % 500, followers=key % 50, following=size % 700, posts_per_day=key % 60, likes=key % 9,
        comments=size % 4, views=size % 900, urgency=fx.URGENCY, actions=fx.ACTIONS, links=fx.LINKS)
    return t.wide("documents").select("doc_id", *[F.round(column, 6).alias(name) for name, column in row.items()])


@query("recalibrated_vector", """
with p as (select event_id, value / 200 as a, value / 400 as b from events), v as (select event_id, a, b, greatest(1 - a - b, 0) as c from p),
s as (select event_id, 1 / (1 + exp(-2.5::double * ln(least(greatest(a, 1e-10::double), 1 - 1e-10::double)) + 0.3::double)) as a,
  1 / (1 + exp(-2.5::double * ln(least(greatest(b, 1e-10::double), 1 - 1e-10::double)) + 0.3::double)) as b,
  1 / (1 + exp(-2.5::double * ln(least(greatest(c, 1e-10::double), 1 - 1e-10::double)) + 0.3::double)) as c from v)
select event_id, round(a / greatest(a + b + c, 1e-10::double), 6) as p0, round(b / greatest(a + b + c, 1e-10::double), 6) as p1, round(c / greatest(a + b + c, 1e-10::double), 6) as p2 from s""")
def _(t):
    a, b = F.col("value") / 200, F.col("value") / 400
    out = scores.recalibrated_vector([a, b, F.greatest(1 - a - b, F.lit(0.0))])
    return t("events").select("event_id", *[F.round(c, 6).alias(f"p{i}") for i, c in enumerate(out)])


@query("recalibrated_confidence", """
with p as (select event_id, least(value / 100, 1.0::double) as p from events)
select event_id, round(p * 0.4::double + 0.6::double / (1 + exp(-2.5::double * ln(greatest(p, 1e-10::double) / greatest(1 - p, 1e-10::double)) + 0.3::double)), 6) as confidence from p""")
def _(t):
    p = F.least(F.col("value") / 100, F.lit(1.0))
    return t("events").select("event_id", F.round(scores.recalibrated_single(p), 6).alias("confidence"))


@query("risk_level_ladder", """
select event_id, case when event_type = 'view' then 'LOW' when value / 100 >= 0.8 then 'HIGH' when value / 100 >= 0.6 then 'MEDIUM' else 'LOW' end as risk_level from events""")
def _(t):
    label = F.when(F.col("event_type") == "view", "SAFE").otherwise("FAKE_SCAM")
    return t("events").select("event_id", scores.risk_level(label, F.col("value") / 100).alias("risk_level"))


PROMPT_GROUPS = {"safe": ["click", "view"], "suspicious": ["signup"], "high_risk": ["error", "purchase"]}


def _prompt_map(t):
    """Per user: event type -> mean value / 100, a stand-in for prompt probabilities."""
    # Added in the order of the events, as a scan of the file adds them: many means lie on a tie of the sixth digit.
    per = ordered.means_in_order(t("events"), ["user_id", "event_type"], ["event_id", "ts", "value"], "value").select(
        "user_id", "event_type", scores.half_away(F.col("mean") / 100, 6).alias("p"))
    return per.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "p"))).alias("probs"))


PROMPT_SQL = """p as (select user_id, event_type, round(avg(value) / 100, 6) as p from events group by 1, 2)"""


@query("prompt_group_rollup", f"""with {PROMPT_SQL},
g as (select user_id, coalesce(max(p) filter (event_type in ('click', 'view')), 0) as s, coalesce(max(p) filter (event_type = 'signup'), 0) as u,
  coalesce(max(p) filter (event_type in ('error', 'purchase')), 0) as h, max(p) filter (regexp_matches(event_type, 'err|pur')) as sc, max(p) filter (regexp_matches(event_type, 'bank')) as mo from p group by 1),
c as (select *, greatest(h, u * 0.6::double) as c from g)
select user_id, round(c, 6) as combined_risk_score, round(s / (s + c + 1e-8::double), 6) as safety_score, case when c >= 0.7 then 'HIGH' when c >= 0.4 then 'MEDIUM' else 'LOW' end as risk_level,
  c < 0.7 as is_safe, c >= 0.5 as requires_review, round(coalesce(sc, h), 6) as scam_risk, round(coalesce(mo, u), 6) as money_risk from c""")
def _(t):
    row = scores.prompt_rollup(F.col("probs"), PROMPT_GROUPS, {
        "scam_risk": (["err", "pur"], "high_risk"), "money_risk": (["bank"], "suspicious")})
    rounded = ("combined_risk_score", "safety_score", "scam_risk", "money_risk")
    return _prompt_map(t).select("user_id", *[
        (F.round(row[n], 6) if n in rounded else row[n]).alias(n)
        for n in (*rounded, "risk_level", "is_safe", "requires_review")])


@query("top_map_entries", f"""with {PROMPT_SQL},
r as (select *, row_number() over (partition by user_id order by p desc, event_type) rn from p where p >= 0.12 and event_type <> 'view')
select user_id, string_agg(event_type || ':' || p, ',' order by rn) as hits, round(max(p), 6) as score from r where rn <= 3 group by 1""")
def _(t):
    top = maps.top_entries(F.col("probs"), 0.12, 3, lambda k: k != "view")
    return _prompt_map(t).select("user_id", top.alias("top")).filter(F.size("top") > 0).select(
        "user_id", F.array_join(F.transform("top", lambda e: F.concat_ws(":", e["key"], e["score"].cast("string"))), ",").alias("hits"),
        F.round(F.col("top")[0]["score"], 6).alias("score"))


@query("active_intents_sorted", f"""with {PROMPT_SQL},
r as (select *, row_number() over (partition by user_id order by p desc, event_type) rn from p where p > 0.15)
select user_id, string_agg(event_type, ',' order by rn) as active, count(*)::int as n from r group by 1""")
def _(t):
    top = maps.top_entries(F.map_filter("probs", lambda _, v: v > 0.15), 0.0)
    return _prompt_map(t).select("user_id", F.transform(top, lambda e: e["key"]).alias("a")).filter(F.size("a") > 0).select(
        "user_id", F.array_join("a", ",").alias("active"), F.size("a").alias("n"))


CODED = {
    "combined_risk_score": "risk", "safety_score": "1 - risk", "violent_risk": "(doc_id % 7) / 7.0::double", "scam_risk": "(doc_id % 5) / 5.0::double",
    "sexual_risk": "(doc_id % 3) / 3.0::double", "inappropriate_risk": "(doc_id % 11) / 11.0::double", "vision_safe": "(risk < 0.5)::int", "vision_review": "(risk >= 0.5)::int",
    "vision_risk": "case when risk >= 0.7 then 1.0 when risk >= 0.4 then 0.5 else 0 end", "memory": "(doc_id % 9) / 2.0::double / 4",
    "p_safe": "(doc_id % 4) / 4.0::double", "p_suspicious": "(doc_id % 6) / 6.0::double", "p_fake_scam": "(doc_id % 9) / 9.0::double", "confidence": "(n_chars % 53) / 53.0::double",
    "text_safe": "(doc_id % 2 = 0)::int", "text_review": "(doc_id % 3 = 0)::int", "text_risk": "case doc_id % 3 when 0 then 1.0 when 1 then 0.5 else 0 end",
    "length": "length(text) / 500.0::double", "links": "((length(text) - length(replace(text, 'http', ''))) // 4) / 10.0::double",
    "exclaims": "(length(text) - length(replace(text, '!', ''))) / 20.0::double", "age": "case doc_id % 4 when 0 then 0.0 when 1 then 0.5 when 2 then 1.0 else 0.25 end",
    **{f"scenario_{name}": f"(n_chars % 6 = {i})::int" for i, name in enumerate(fixed.SCENARIOS)},
    "realism": "case when doc_id % 17 = 0 then 0 else (doc_id % 17) / 17.0::double end", "turns": "(n_chars % 12) / 10.0::double", "slang": "(doc_id % 5 = 0)::int",
}


@query("feature_encoding_29", f"""
with d as (select doc_id, n_chars, coalesce(text, '') as text, (n_chars % 101) / 100.0::double as risk from documents)
select doc_id, {", ".join(f"round(({sql})::double, 9) as {name}" for name, sql in CODED.items())} from d""")
def _(t):
    key, size, text = F.col("doc_id"), F.col("n_chars"), F.coalesce("text", F.lit(""))
    risk = (size % 101) / 100.0
    row = scores.vision_codes({
        "combined_risk_score": risk, "safety_score": 1 - risk, "violent_risk": (key % 7) / 7.0, "scam_risk": (key % 5) / 5.0, "sexual_risk": (key % 3) / 3.0,
        "inappropriate_risk": (key % 11) / 11.0, "is_safe": risk < 0.5, "requires_review": risk >= 0.5, "vram_usage_gb": (key % 9) / 2.0,
        "risk_level": F.when(risk >= 0.7, "HIGH").when(risk >= 0.4, "MEDIUM").otherwise("LOW")})
    row |= scores.text_codes(
        text, {"SAFE": (key % 4) / 4.0, "SUSPICIOUS": (key % 6) / 6.0, "FAKE_SCAM": (key % 9) / 9.0}, (size % 53) / 53.0, key % 2 == 0, key % 3 == 0,
        F.when(key % 3 == 0, "HIGH").when(key % 3 == 1, "MEDIUM").otherwise("LOW"))
    age = F.when(key % 4 == 0, "8-10").when(key % 4 == 1, "11-13").when(key % 4 == 2, "14-17").otherwise("x")
    scenario = F.element_at(F.array(*[F.lit(x) for x in (*fixed.SCENARIOS, "none")]), (size % 6 + 1).cast("int"))
    row |= scores.metadata_codes(age, scenario, F.when(key % 17 != 0, (key % 17) / 17.0), size % 12, key % 5 == 0)
    return t.wide("documents").select("doc_id", *[F.round(row[name].cast("double"), 9).alias(name) for name in CODED])


# ---- dates, arrays, JSON ----------------------------------------------------------------------

@query("expiry_and_deadline", """
select event_id, epoch_us(ts + interval 30 day) as expires_us, epoch_us(ts + interval 24 hour) as deadline_us from events""")
def _(t):
    return t("events").select(
        "event_id", F.unix_micros(F.col("ts") + F.expr("interval 30 days")).alias("expires_us"),
        F.unix_micros(F.col("ts") + F.expr("interval 24 hours")).alias("deadline_us"))


@query("lookback_windows", """
with c as (select max(ts) as now from events)
select event_type, count_if(ts >= now - interval 24 hour) as last_day, count_if(ts >= now - interval 7 day) as last_week, count_if(ts >= now - interval 20 day) as last_20
from events, c group by 1""")
def _(t):
    events = t("events")
    now = events.agg(F.max("ts")).scalar()

    def since(span):
        return F.count_if(F.col("ts") >= F.col("now") - F.expr(f"interval {span}"))

    return events.withColumn("now", now).groupBy("event_type").agg(
        since("24 hours").alias("last_day"), since("7 days").alias("last_week"), since("20 days").alias("last_20"))


@query("date_truncation", "select cast(cast(ts as date) as varchar) as day, count(*) as n from events group by 1")
def _(t):
    return t("events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query("array_utilities", f"""
with k as (select doc_id, list_filter([{', '.join(quoted(w) for w in fx.KEYWORDS)}], lambda k: contains({LOW}, k)) as k from documents)
select doc_id, array_to_string(k[1:4], ',') as first_four, len(list_filter(k, lambda x: length(x) > 5)) > 0 as any_long,
  len(list_filter(k, lambda x: length(x) <= 5)) = 0 as all_long from k""")
def _(t):
    return t.wide("documents").select("doc_id", matched_words(F.lower("text"), fx.KEYWORDS).alias("k")).select(
        "doc_id", F.array_join(F.slice("k", 1, 4), ",").alias("first_four"),
        F.exists("k", lambda x: F.length(x) > 5).alias("any_long"), F.forall("k", lambda x: F.length(x) > 5).alias("all_long"))


@query("json_field_with_default", """
select event_id, coalesce(cast(json_extract(props, '$.k') as int), 0) as k, coalesce(json_extract_string(props, '$.missing'), 'unknown') as missing from events""")
def _(t):
    doc = F.from_json("props", "k int, missing string")
    return t("events").select("event_id", doc.alias("p")).select(
        "event_id", F.coalesce("p.k", F.lit(0)).alias("k"), F.coalesce("p.missing", F.lit("unknown")).alias("missing"))


@query("record_normalisation", """
select event_id, coalesce(json_extract_string(props, '$.age_group'), json_extract_string(props, '$.k'), 'unknown') as age_group,
  event_type as scenario, coalesce(cast(json_extract(props, '$.k') as int) > 50, false) as asks_for_credentials, 'train' as split from events""")
def _(t):
    from riskloom.sources.files import canonical
    raw = t("events").select("event_id", F.from_json("props", "age_group string, k string").alias("p"), "event_type").select(
        "event_id", F.col("p.age_group").alias("age_group"), F.col("p.k").alias("age_focus"), F.col("event_type").alias("scam_scenario"),
        F.struct((F.col("p.k").cast("int") > 50).alias("asks_for_credentials")).alias("risk_indicators"))
    out = canonical(raw, {"age_group": ["age_group", "age_focus"], "scenario": ["scenario", "scam_scenario"]},
                    {"age_group": "unknown"}, ["asks_for_credentials"], "train")
    return out.select("event_id", "age_group", "scenario", "asks_for_credentials", "split")


@query("keywords_from_flags", f"""
with f as (select doc_id, list_filter([case when contains({LOW}, 'worthless') then 'FINANCIAL_SCAM:pay_first_scheme' end, case when contains({LOW}, 'token') then 'ACCOUNT_TAKEOVER' end,
  case when contains({LOW}, 'license') then 'FAKE_REWARD:giveaway_prize' end], lambda x: x is not null) as flags from documents),
k as (select doc_id, unnest(list_distinct(['robux', 'seed phrase'] || list_transform(list_filter(flags, lambda x: contains(x, ':')), lambda x: replace(split_part(x, ':', 2), '_', ' ')))) as w from f)
select doc_id, string_agg(w, '|' order by length(w) desc, w) as keywords from k group by 1""")
def _(t):
    from riskloom.operators.flags import highlight_keywords
    low = F.lower("text")
    flags = F.array_compact(F.array(
        F.when(F.contains(low, F.lit("worthless")), "FINANCIAL_SCAM:pay_first_scheme"), F.when(F.contains(low, F.lit("token")), "ACCOUNT_TAKEOVER"),
        F.when(F.contains(low, F.lit("license")), "FAKE_REWARD:giveaway_prize")))
    return t.wide("documents").select("doc_id", F.array_join(highlight_keywords(flags, ["robux", "seed phrase"]), "|").alias("keywords"))


@query("runtime_flags", f"""
with f as (select doc_id, list_filter([case when contains({LOW}, 'the') then 'NLP_RULE_BASED_FALLBACK' end, case when contains({LOW}, 'token') then 'ACCOUNT_TAKEOVER' end,
  case when contains({LOW}, 'and') then 'VIDEO_ANALYSIS_DEGRADED' end], lambda x: x is not null) as flags from documents)
select doc_id, array_to_string(list_filter(flags, lambda x: regexp_matches(x, '^(NLP_|VIDEO_)')), ',') as technical,
  len(list_filter(flags, lambda x: not regexp_matches(x, '^(NLP_|VIDEO_)'))) > 0 as has_evidence from f""")
def _(t):
    from riskloom.plans.detector import runtime_flags
    from riskloom.plans.guards import TECHNICAL
    low = F.lower("text")
    flags = F.array_compact(F.array(
        F.when(F.contains(low, F.lit("the")), "NLP_RULE_BASED_FALLBACK"), F.when(F.contains(low, F.lit("token")), "ACCOUNT_TAKEOVER"),
        F.when(F.contains(low, F.lit("and")), "VIDEO_ANALYSIS_DEGRADED")))
    return t.wide("documents").select("doc_id", flags.alias("f")).select(
        "doc_id", F.array_join(runtime_flags(F.col("f"), TECHNICAL), ",").alias("technical"),
        (F.size(F.array_except("f", runtime_flags(F.col("f"), TECHNICAL))) > 0).alias("has_evidence"))


@query("harmful_content_quarantine", f"""
select sha256(text) as digest, case when regexp_matches({LOW}, 'worthless.*the') then 'worthless.*the' when regexp_matches({LOW}, 'token') then 'token' else 'license' end as reason, count(*) as n
from documents where regexp_matches({LOW}, 'worthless.*the|token|license') group by 1, 2""")
def _(t):
    from riskloom.operators.ingest import quarantine
    _, held = quarantine(t.wide("documents"), "doc_id", "text", ["worthless.*the", "token", "license"])
    return held.groupBy("digest", "reason").agg(F.count(F.lit(1)).alias("n"))


@query("post_metadata", f"""
with k as (select doc_id, text, {fx.sql_words(LOW, fx.KEYWORDS)} as keywords from documents where not regexp_matches({LOW}, 'worthless.*the|token'))
select 'meta_' || doc_id as post_id, sha256(text) as content_hash, round(least(case when keywords = '' then 0 else len(string_split(keywords, ',')) end * 0.1::double, 1.0::double), 6) as scam_probability,
  case when list_has_any(string_split(keywords, ','), ['worthless', 'pathetic', 'stupid']) then 'insult'
    when list_has_any(string_split(keywords, ','), ['token']) then 'secret'
    when list_has_any(string_split(keywords, ','), ['license', 'rating']) then 'legal' else 'suspicious_content' end as scam_type,
  round((length(text) - length(translate(lower(text), '013457@$', '')))::double / greatest(length(text), 1), 6) as leetspeak_score, keywords,
  epoch_us(timestamp '2024-03-01 00:00:00' + interval 30 day) as expires_us from k""")
def _(t):
    from riskloom.operators.ingest import post_metadata, quarantine
    passed, _ = quarantine(t.wide("documents"), "doc_id", "text", ["worthless.*the", "token"])
    out = post_metadata(passed, "doc_id", "text", F.lit("2024-03-01 00:00:00").cast("timestamp"), fx.KEYWORDS, fx.SLANG_WORDS, fx.KEYWORD_TYPES)
    return out.select("post_id", "content_hash", F.round("scam_probability", 6).alias("scam_probability"), "scam_type",
                      F.round("leetspeak_score", 6).alias("leetspeak_score"), F.array_join("detected_keywords", ",").alias("keywords"),
                      F.unix_micros("retention_expires").alias("expires_us"))
