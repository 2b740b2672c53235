"""Text normalisation, predicates and lexical measures over whole texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions import text as tx
from riskloom.functions import urls
from riskloom.functions.patterns import any_pattern, any_word
from riskloom.plans import fixture as fx
from riskloom.plans.fixture import quoted
from riskloom.plans.registry import query

WORD = r"[^\p{L}\p{N}_]"
ALONE = r"(^|" + WORD + ")({})(" + WORD + "|$)"


def _slang_sql(col):
    out = col
    for key in sorted(fx.SLANG, key=lambda k: (-len(k), k)):
        pattern, target = quoted("(?i)" + ALONE.replace("{}", key)), quoted(r"\1" + fx.SLANG[key] + r"\3")
        # Two passes: neighbours share the separator that the first pass consumes.
        for _ in range(2):
            out = f"regexp_replace({out}, {pattern}, {target}, 'g')"
    return out


@query("content_hash", "select doc_id, sha256(text) as digest from documents")
def _(t):
    return t.wide("documents").select("doc_id", tx.content_hash(F.col("text")).alias("digest"))


@query("clean_page_text", r"""
select page_id, sha256(trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(html, '&copy;', '©'), '&middot;', '·'),
   '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&#x27;', ''''), '&amp;', '&'), '&nbsp;', ' '), chr(8203), ' '), '\s+', ' ', 'g'))) as digest from pages""")
def _(t):
    return t.wide("pages").select("page_id", F.sha2(tx.clean_text(F.col("html"), closed=True), 256).alias("digest"))


@query("tags_stripped", r"""
select page_id, sha256(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) as digest from pages""")
def _(t):
    return t.wide("pages").select("page_id", F.sha2(tx.strip_tags(F.col("html")), 256).alias("digest"))


@query("matching_form", """
select doc_id, sha256(trim(regexp_replace(strip_accents(lower(text)), '[^a-z0-9]+', ' ', 'g'))) as digest from documents""")
def _(t):
    return t.wide("documents").select("doc_id", F.sha2(tx.match_form(F.col("text")), 256).alias("digest"))


@query("compatibility_form", r"""
select doc_id, sha256(trim(regexp_replace(regexp_replace(lower(text), '[\-–—_/|:;,\.\(\)\[\]\{\}!]+', ' ', 'g'), '\s+', ' ', 'g'))) as digest from documents""")
def _(t):
    return t.wide("documents").select("doc_id", F.sha2(tx.compat_form(F.col("text")), 256).alias("digest"))


@query("slang_expanded", f"select doc_id, sha256({_slang_sql('text')}) as digest from documents")
def _(t):
    return t.wide("documents").select("doc_id", F.sha2(tx.expand_slang(F.col("text"), fx.SLANG, again=True), 256).alias("digest"))


@query("slang_tokens", """
select conv_id, turn, array_to_string(list_transform(string_split(text, ' '), lambda w: case lower(w) when 'the' then 'teh'
   when 'and' then 'n' when 'of' then 'o' when 'nicht' then 'net' when 'que' then 'k' else w end), ' ') as text from conversations""")
def _(t):
    return t.wide("conversations").select("conv_id", "turn", F.array_join(
        tx.expand_tokens(F.split("text", " "), fx.SLANG), " ").alias("text"))


@query("high_risk_slang", f"""
select doc_id, regexp_matches(lower(text), {quoted(ALONE.replace('{}', 'worthless|to be|der sch|pathetic'))}) as flagged from documents""")
def _(t):
    return t.wide("documents").select("doc_id", tx.has_slang(
        F.col("text"), ["worthless", "to be", "der sch", "pathetic"]).alias("flagged"))


@query("leetspeak_densities", """
with c as (select doc_id, text, length(text) as n, length(text) - length(regexp_replace(text, '\\p{L}', '', 'g')) as a from documents)
select doc_id, round((n - length(translate(lower(text), '013457@$', '')))::double / greatest(n, 1), 9) as share,
  round(case when a > 0 then least((n - length(translate(text, '043@$17589™®©', '')))::double / a * 5, 1.0::double) else 0.0::double end, 9) as density,
  round((n - length(translate(lower(text), '013457982', '')))::double / greatest(n, 1), 9) as digit_share from c""".replace("\\\\", "\\"))
def _(t):
    text = F.col("text")
    return t.wide("documents").select(
        "doc_id", F.round(tx.digit_substitution_share(text), 9).alias("share"),
        F.round(tx.substitution_density(text), 9).alias("density"),
        F.round(tx.digit_form_share(text), 9).alias("digit_share"))


@query("emoji_score", r"""
select doc_id, (length(text) - length(regexp_replace(text, '[\x{1F001}-\x{10FFFF}☀-➿]', '', 'g')))::int as emojis,
  round(least((length(text) - length(regexp_replace(text, '[\x{1F001}-\x{10FFFF}☀-➿]', '', 'g'))) * 0.02::double, 0.1::double), 6) as score from documents""")
def _(t):
    n = tx.emoji_count(F.col("text"))
    return t.wide("documents").select("doc_id", n.alias("emojis"), F.round(tx.capped(n, 0.02, 0.1), 6).alias("score"))


@query("upper_case_score", r"""
with c as (select doc_id, (length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::double / greatest(length(text), 1) as r from documents)
select doc_id, round(r, 9) as ratio, round(case when r > 0.3::double then least(r * 0.3::double, 0.15::double) else 0 end, 9) as score from c""")
def _(t):
    ratio = tx.upper_ratio(F.col("text"))
    return t.wide("documents").select(
        "doc_id", F.round(ratio, 9).alias("ratio"),
        F.round(F.when(ratio > 0.3, tx.capped(ratio, 0.3, 0.15)).otherwise(0.0), 9).alias("score"))


@query("garbled_text", r"""
with c as (select doc_id, text, trim(text) as x from documents)
select doc_id, case when text is null or text = '' then true when length(x) < 20 then false else
   (length(x) - length(translate(x, 'ÃÂÐÑ', '')))::double / length(x) > 0.015
   or length(regexp_replace(x, '[\p{L}\p{N} .,;:!?()\[\]{}\-_/\\@#%&*+="''`~|]', '', 'g'))::double / length(x) > 0.08 end as garbled from c""")
def _(t):
    return t.wide("documents").select("doc_id", tx.is_garbled(F.col("text")).alias("garbled"))


@query("noise_fragments", r"""
with f as (select conv_id, turn, unnest(string_split(text, ' ')) as part from conversations)
select part, count(*) as n, (part = '' or regexp_matches(part, '^\d[\d,. ]*[KkMmTỷB]?$')
   or (length(part) <= 8 and regexp_matches(part, '^[a-zA-Z ]+$'))) as noise from f group by part""")
def _(t):
    parts = t.wide("conversations").select(F.explode(F.split("text", " ")).alias("part"))
    return parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).withColumn("noise", tx.is_noise(F.col("part")))


@query("cheap_prefilter", """
select conv_id, turn, length(text) >= 60 or contains(lower(text), 'worthless') or contains(lower(text), 'token') as keep from conversations""")
def _(t):
    return t.wide("conversations").select("conv_id", "turn", tx.worth_scoring(
        F.col("text"), ["worthless", "token"], 60).alias("keep"))


@query("meaningful_transcript", """
select conv_id, turn, length(trim(text)) >= 5 and not (contains(lower(text), 'pathetic') or contains(lower(text), '♪') or contains(lower(text), 'the the'))
   and regexp_matches(text, '[éèêóíüä]') as meaningful from conversations""")
def _(t):
    return t.wide("conversations").select("conv_id", "turn", tx.is_meaningful_transcript(
        F.col("text"), ["pathetic", "♪", "the the"], "[éèêóíüä]").alias("meaningful"))


@query("blank_text_dropped", "select lang, count(*) as n from documents where trim(text) <> '' group by lang")
def _(t):
    return t.wide("documents").filter(F.trim("text") != "").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("trusted_host", r"""
select page_id, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(\.example\.org|\.example\.net)\.*$') as trusted_url,
  false as trusted_link from pages""")
def _(t):
    marks = [".example.org", ".example.net"]
    return t.wide("pages").select(
        "page_id", urls.on_trusted_host(F.col("url"), marks).alias("trusted_url"),
        urls.has_trusted_link(F.col("html"), marks).alias("trusted_link"))


@query("links_inside_text", r"""
with l as (select page_id, regexp_extract_all('see ' || url || ' and (' || replace(url, 'http', 'HTTP') || ') now', '(?i)(https?://[^\s<>"''\)\]]+)', 1) as x from pages)
select page_id, len(x)::int as n_links,
  len(list_filter(x, lambda u: regexp_matches(lower(regexp_extract(u, '(?i)^https?://([^/?#:]+)', 1)), '\.example\.org$'))) > 0 as has_trusted from l""")
def _(t):
    body = F.concat(F.lit("see "), F.col("url"), F.lit(" and ("),
                    F.replace(F.col("url"), F.lit("http"), F.lit("HTTP")), F.lit(") now"))
    return t.wide("pages").select("page_id", F.size(urls.links(body)).alias("n_links"),
                             urls.has_trusted_link(body, [".example.org"]).alias("has_trusted"))


@query("suspicious_url", """
select page_id, contains(lower(url), 'utm_source') or contains(lower(url), '.org') or contains(lower(url), 'blog.') as suspicious from pages""")
def _(t):
    return t.wide("pages").select("page_id", urls.is_suspicious_url(
        F.col("url"), ["utm_source", ".org", "blog."]).alias("suspicious"))


@query("platform_from_url", r"""
with h as (select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) as h from pages)
select page_id, case when regexp_matches(h, '(^|\.)example\.com$') then 'alpha' when regexp_matches(h, '(^|\.)example\.net$') then 'beta'
   else 'unknown' end as platform from h""")
def _(t):
    return t.wide("pages").select("page_id", urls.platform_of(
        F.col("url"), [("alpha", ["example.com"]), ("beta", ["example.net"])]).alias("platform"))


@query("platform_allow_list", """
with p as (select page_id, lower(trim(case when page_id % 3 = 0 then ' X ' else split_part(split_part(url, '://', 2), '.', 1) end)) as p from pages)
select page_id, case when p = 'x' then 'twitter' else p end as platform, (case when p = 'x' then 'twitter' else p end) in ('twitter', 'blog', 'm') as allowed from p""")
def _(t):
    from riskloom.operators.predicates import allowed_platform
    raw = F.when(F.col("page_id") % 3 == 0, " X ").otherwise(
        F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("."), F.lit(1)))
    name, ok = allowed_platform(raw, {"x": "twitter"}, ["twitter", "blog", "m"])
    return t.wide("pages").select("page_id", name.alias("platform"), ok.alias("allowed"))


@query("handle_tokens", r"""
with u as (select page_id, lower(regexp_extract(url, '://(?:[a-z]+\.)?([^./]+)\.example', 1)) as u from pages)
select page_id, array_to_string(list_sort(list_distinct(list_append(list_filter(regexp_split_to_array(u, '[^a-z]'), lambda x: x <> ''), u))), ',') as tokens,
   u <> '' and regexp_matches(u, 'thr|shor|erth') as bait from u where u <> ''""")
def _(t):
    pattern = r"://(?:[a-z]+\.)?([^./]+)\.example"
    tokens = urls.handle_tokens(F.col("url"), pattern)
    return t.wide("pages").filter(F.size(tokens) > 0).select(
        "page_id", F.array_join(F.array_sort(tokens), ",").alias("tokens"),
        urls.handle_is_bait(F.col("url"), pattern, ["thr", "shor", "erth"]).alias("bait"))


@query("tokens_without_stopwords", """
with w as (select doc_id, list_filter(regexp_extract_all(lower(text), '[a-zA-ZÀ-ỹ]{2,}'),
   lambda w: w not in ('the', 'and', 'of', 'to', 'der', 'die', 'la', 'le', 'en')) as w from documents)
select doc_id, len(w)::int as n, sha256(array_to_string(w, ' ')) as digest from w""")
def _(t):
    words = tx.without_stopwords(tx.word_tokens(F.lower("text")), ["the", "and", "of", "to", "der", "die", "la", "le", "en"])
    return t.wide("documents").select("doc_id", words.alias("w")).select(
        "doc_id", F.size("w").alias("n"), F.sha2(F.array_join("w", " "), 256).alias("digest"))


@query("term_risk_class", """
select term, n, case when term in ('worthless', 'pathetic', 'idiot') then 'high' when term in ('token', 'license', 'free') then 'medium' else 'low' end as risk
from (select w as term, count(*) as n from (select unnest(regexp_extract_all(lower(text), '[a-zA-ZÀ-ỹ]{2,}')) as w from documents) group by 1)""")
def _(t):
    from riskloom.operators.reports import group_count
    term = F.col("term")
    risk = F.when(term.isin("worthless", "pathetic", "idiot"), "high").when(
        term.isin("token", "license", "free"), "medium").otherwise("low")
    return group_count(t.wide("documents").select(F.explode(tx.word_tokens(F.lower("text"))).alias("term")), "term").withColumn("risk", risk)


@query("keyword_in_context", """
with p as (select doc_id, text, strpos(lower(text), 'token') as p from documents)
select doc_id, case when p > 0 then trim(text[greatest(p - 20, 1) : p + 24]) else '' end as context from p""")
def _(t):
    return t.wide("documents").select("doc_id", tx.in_context(F.col("text"), "token").alias("context"))


@query("hashtag_tokens", r"""
with h as (select doc_id, unnest(regexp_extract_all(lower(replace(text, ' th', ' #th')), '#([a-zà-ÿ0-9_]+)', 1)) as tag from documents)
select doc_id, tag, count(*) as n, count(*) >= 3 as repeated from h group by 1, 2""")
def _(t):
    tagged = F.replace(F.col("text"), F.lit(" th"), F.lit(" #th"))
    tags = t.wide("documents").select("doc_id", F.explode(tx.hashtags(tagged)).alias("tag"))
    return tags.groupBy("doc_id", "tag").agg(
        F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 3).alias("repeated"))


@query("fused_hashtags", r"""
with h as (select doc_id, regexp_extract_all(lower(replace(text, ' th', ' #th')), '#([a-z0-9_]{4,64})', 1) as tags from documents)
select doc_id, len(list_filter(tags, lambda g: regexp_matches(g, '^th') and regexp_matches(g, '(tion|ble|ing)'))) > 0 as fused,
  len(list_filter(tags, lambda g: contains(replace(g, '_', ''), 'the') and (contains(replace(g, '_', ''), 'rea') or contains(replace(g, '_', ''), 'sti')))) > 0 as laundering from h""")
def _(t):
    from riskloom.plans.detector import fused_hashtags, laundering_hashtag
    text = F.replace(F.col("text"), F.lit(" th"), F.lit(" #th"))
    return t.wide("documents").select(
        "doc_id", fused_hashtags(text, [("^th", "(tion|ble|ing)")]).alias("fused"),
        laundering_hashtag(text, "the", ["rea", "sti"]).alias("laundering"))


@query("language_variant", f"""
select doc_id, case when {fx.sql_count_words('lower(text)', ['worthless', 'pathetic', 'that', 'and', 'ing'])} > 3 then 'teencode_heavy'
   when {fx.sql_count_words('lower(text)', ['token', 'thing', 'free', 'rating', 'only'])} > 2 then 'gaming_focused' else 'mixed' end as variant from documents""")
def _(t):
    from riskloom.operators.conversations import language_variant
    return t.wide("documents").select("doc_id", language_variant(
        F.col("text"), ["worthless", "pathetic", "that", "and", "ing"], ["token", "thing", "free", "rating", "only"]).alias("variant"))


@query("conversation_realism", """
with r as (select conv_id, role, text, row_number() over (partition by conv_id order by turn) rn from conversations),
a as (select conv_id, count(*) as n, bool_and(role = case when rn % 2 = 1 then 'user' else 'assistant' end) as alt,
  sum(case when contains(lower(text), 'the ') or contains(lower(text), 'que') then 1 else 0 end)::double / count(*) as share from r group by 1)
select conv_id, n as turns, ((case when alt then 1.0::double else 0 end) + (case when share >= 0.2 and share <= 0.6 then 1 else 0 end)
  + (case when n >= 3 then 1 else 0 end)) / 4.0::double as realism from a""")
def _(t):
    from riskloom.operators.conversations import realism_score
    return realism_score(t.wide("conversations"), ["user", "assistant"], ["the ", "que"])


@query("personal_data_safety", r"""
select doc_id, case when regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])\d{4}\s*\d{4}\s*\d{4}\s*\d{4}([^\p{L}\p{N}_]|$)')
  or regexp_matches(lower(text), '(^|[^\p{L}\p{N}_])\d{3}-\d{2}-\d{4}([^\p{L}\p{N}_]|$)') or regexp_matches(lower(text), 'child.*abuse')
  then 0.0::double else 1.0::double end as safety from documents""")
def _(t):
    return t.wide("documents").select("doc_id", tx.personal_data_safety(
        F.col("text"), fixed.PERSONAL_DATA_PATTERNS).alias("safety"))


@query("assembled_text", r"""
select d.doc_id, sha256(concat_ws(chr(10), '[Mô tả]: ' || nullif(trim(coalesce(b.text, '')), ''), '[Nội dung]: ' || nullif(trim(d.text), ''),
   '[Tác giả]: ' || nullif(trim(case when source = 'src3' then ' ' else source end), ''))) as digest
from documents d left join benchmark b on b.item_id = d.doc_id""")
def _(t):
    known = t("benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("about"))
    author = F.when(F.col("source") == "src3", " ").otherwise(F.col("source"))
    text = tx.assemble([("[Mô tả]: ", F.coalesce("about", F.lit(""))), ("[Nội dung]: ", F.col("text")), ("[Tác giả]: ", author)])
    return t.wide("documents").join(known, "doc_id", "left").select("doc_id", F.sha2(text, 256).alias("digest"))


@query("ordered_fragment_dedup", """
with w as (select conv_id, turn, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as w from conversations),
u as (select conv_id, turn, unnest(w) as x, generate_subscripts(w, 1) as i from w),
f as (select conv_id, turn, lower(x) as k, min(i) as i, arg_min(x, i) as x from u group by 1, 2, 3)
select conv_id, turn, string_agg(x, ' ' order by i) as text from f group by 1, 2""")
def _(t):
    return tx.distinct_words(t.wide("conversations").select("conv_id", "turn", "text"), "text")


@query("fragment_containment_dedup", """
with l as (select conv_id, turn, string_split(text, chr(10)) as parts from conversations),
u as (select conv_id, turn, unnest(parts) as p, generate_subscripts(parts, 1) as i from l),
n as (select *, regexp_replace(lower(p), '\\s+', ' ', 'g') as k from u),
kept as (select a.* from n a where not exists (select 1 from n b where b.conv_id = a.conv_id and b.turn = a.turn and b.i <> a.i
   and contains(b.k, a.k) and (b.k <> a.k or b.i < a.i)))
select conv_id, turn, string_agg(p, '|' order by i) as parts, count(*)::int as n from kept group by 1, 2""")
def _(t):
    parts = t.wide("conversations").select("conv_id", "turn", F.split("text", "\n").alias("parts"))
    return tx.drop_contained(parts, "parts").select(
        "conv_id", "turn", F.array_join("parts", "|").alias("parts"), F.size("parts").alias("n"))


@query("mixed_separator_numbers", r"""
with r as (select l_orderkey, l_linenumber, l_partkey, case l_orderkey % 6 when 0 then format('{:,.2f}', l_extendedprice)
   when 1 then replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '~'), '.', ','), '~', '.')
   when 2 then replace(format('{:,}', cast(floor(l_extendedprice) as bigint)), ',', '.') when 3 then format('{:,}', cast(floor(l_extendedprice) as bigint))
   when 4 then replace(format('{:.1f}', l_quantity), '.', ',') else format('{:.1f}', l_quantity) end as raw from lineitem),
p as (select *, case when contains(raw, '.') and contains(raw, ',') then
    case when strpos(reverse(raw), '.') < strpos(reverse(raw), ',') then replace(raw, ',', '') else replace(replace(raw, '.', ''), ',', '.') end
  when contains(raw, '.') then case when regexp_full_match(raw, '[^.]*(\.[^.]{3})+') then replace(raw, '.', '') else raw end
  when contains(raw, ',') then case when regexp_full_match(raw, '[^,]*(,[^,]{3})+') then replace(raw, ',', '') else replace(raw, ',', '.') end
  else raw end as s from r)
select raw, try_cast(s as double) as value, count(*) as n from p group by 1, 2""")
def _(t):
    from riskloom.operators.rates import written_amounts
    rows = written_amounts(t("lineitem"))
    return rows.select("raw", tx.parse_number(F.col("raw")).alias("value")).groupBy("raw", "value").agg(
        F.count(F.lit(1)).alias("n"))


@query("lexical_feature_row", r"""
with d as (select doc_id, text, lower(text) as t from documents)
select doc_id, length(text)::int as text_len, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> ''))::int as word_count,
  regexp_matches(t, 'https?://')::int as has_url, regexp_matches(t, 'mail[0-9]')::int as has_shortlink,
  (length(text) - length(replace(text, '!', '')))::int as exclaim_count,
  round((length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::double / greatest(length(text), 1), 9) as caps_ratio,
  regexp_matches(t, 'free|rating')::int as has_free, regexp_matches(t, 'token|\$')::int as has_money,
  regexp_matches(t, 'rest|enter')::int as has_urgency, regexp_matches(t, 'thing')::int as has_click_cta,
  regexp_matches(t, 'token\s*=')::int as has_otp_pass, regexp_matches(t, 'pathetic|loser')::int as has_prize,
  regexp_matches(t, '[0-9]{16}')::int as has_crypto, regexp_matches(t, 'license')::int as has_job_scam,
  (contains(t, 'the ')::int + contains(t, 'of ')::int + contains(t, 'la ')::int) as teen_code_count from d""")
def _(t):
    from riskloom.functions.scores import lexical_features
    row = lexical_features(F.col("text"), {
        "has_url": "https?://", "has_shortlink": "mail[0-9]", "has_free": "free|rating", "has_money": r"token|\$",
        "has_urgency": "rest|enter", "has_click_cta": "thing", "has_otp_pass": r"token\s*=",
        "has_prize": "pathetic|loser", "has_crypto": "[0-9]{16}", "has_job_scam": "license"}, ["the ", "of ", "la "])
    return t.wide("documents").select("doc_id", *[
        (F.round(c, 9) if n == "caps_ratio" else c).alias(n) for n, c in row.items()])


@query("text_domain_first_match", "select doc_id, case " + " ".join(
    f"when regexp_matches(lower(text), {quoted(p)}) then '{n}'" for n, p in fx.DOMAINS) + " else 'other' end as domain from documents")
def _(t):
    from riskloom.operators.lexicon import first_match
    return t.wide("documents").select("doc_id", first_match(F.lower("text"), fx.DOMAINS, "other").alias("domain"))


@query("risk_indicator_flags", """
select doc_id, contains(lower(text), 'token') or contains(lower(text), 'license') as asks_for_credentials,
  contains(lower(text), '@') or contains(lower(text), 'example') as includes_fake_link, contains(lower(text), 'rest') as creates_urgency from documents""")
def _(t):
    low = F.lower("text")
    return t.wide("documents").select(
        "doc_id", any_word(low, ["token", "license"]).alias("asks_for_credentials"),
        any_word(low, ["@", "example"]).alias("includes_fake_link"), any_pattern(low, ["rest"]).alias("creates_urgency"))
