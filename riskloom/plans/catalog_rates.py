"""Quantity mentions, rate anomalies and exchange ratios over offer texts made from sales lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import rates, trusted
from riskloom.plans.registry import query
from riskloom.session import spread

ALIASES = ["robux", "rbx", "quân huy", "qh", "uc", "kim cương", "kc", "vbucks", "v-bucks", "pets"]
KNOWN = [a for _, aliases, *_ in __import__("riskloom.functions.fixed_values", fromlist=["RATE_BANDS"]).RATE_BANDS for a in aliases]

NUM = r"(?:\d{1,3}(?:[\.,]\d{3})+|\d+(?:[\.,]\d+)?)"
ITEMS = "robux card|kim cương|kim cuong|quân huy|quan huy|v-bucks|diamond|vbucks|robux|rbx|kc|qh|rb|uc"

OFFERS_SQL = """
names as (select ['robux', 'rbx', 'quân huy', 'qh', 'uc', 'kim cương', 'kc', 'vbucks', 'v-bucks', 'pets'] as n),
raw as (select *, case l_orderkey % 6 when 0 then format('{:,.2f}', l_extendedprice)
   when 1 then replace(replace(replace(format('{:,.2f}', l_extendedprice), ',', '~'), '.', ','), '~', '.')
   when 2 then replace(format('{:,}', cast(floor(l_extendedprice) as bigint)), ',', '.') when 3 then format('{:,}', cast(floor(l_extendedprice) as bigint))
   when 4 then replace(format('{:.1f}', l_quantity), '.', ',') else format('{:.1f}', l_quantity) end as raw from lineitem),
offers as (select concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) as offer_id, l_orderkey, l_linenumber, l_partkey,
  'Nạp ' || raw || ' VND nhận ' || format('{:.0f}', l_quantity * 7) || ' ' || n[(l_partkey % 10) + 1] || ', thêm ' || format('{:.0f}', l_quantity) || ' '
   || n[(l_suppkey % 10) + 1] || repeat(' -', l_linenumber * 8) || ' chỉ ' || format('{:.0f}', l_discount * 100 + 1) || 'k' as text from raw, names)"""

NUMBER_SQL = r"""case when contains(raw, '.') and contains(raw, ',') then
    case when strpos(reverse(raw), '.') < strpos(reverse(raw), ',') then replace(raw, ',', '') else replace(replace(raw, '.', ''), ',', '.') end
  when contains(raw, '.') then case when regexp_full_match(raw, '[^.]*(\.[^.]{3})+') then replace(raw, '.', '') else raw end
  when contains(raw, ',') then case when regexp_full_match(raw, '[^,]*(,[^,]{3})+') then replace(raw, ',', '') else replace(raw, ',', '.') end
  else raw end"""


def _found(units):
    """Mentions with positions: fenced matches, text before a fence gives its position."""
    return rf"""select offer_id, i - 2 as m, piece, split_part(piece, chr(2), 1) as raw, split_part(split_part(piece, chr(2), 3), chr(3), 1) as unit,
   (list_sum(list_transform(pieces[1:i-1], lambda p: length(p))) - 3 * (i - 2))::int as pos
 from (select offer_id, string_split(regexp_replace(lower(text), '({NUM})(\s*)({units})\b', chr(1) || '\1' || chr(2) || '\2' || chr(2) || '\3' || chr(3), 'g'), chr(1)) as pieces from offers) x,
 lateral (select unnest(pieces) as piece, generate_subscripts(pieces, 1) as i) y where i > 1"""


PAIRS_SQL = rf"""{OFFERS_SQL},
pr as ({_found('vnd|k')}), it as ({_found(ITEMS)}),
pn as (select offer_id, pos, unit, try_cast({NUMBER_SQL} as double) as v from pr), inn as (select offer_id, pos, unit, try_cast({NUMBER_SQL} as double) as v from it),
pairs as (select p.offer_id, p.pos as price_pos, i.pos as item_pos, case when p.unit = 'k' then p.v * 1000 else p.v end as price, i.v as amount, trim(i.unit) as alias
  from pn p join inn i on p.offer_id = i.offer_id and abs(p.pos - i.pos) <= 90 where p.v > 0 and i.v > 0),
bands(alias, currency, safe_max, susp, scam) as (values ('robux', 'robux', 4.4, 6.0, 8.5), ('rbx', 'robux', 4.4, 6.0, 8.5), ('rb', 'robux', 4.4, 6.0, 8.5), ('robux card', 'robux', 4.4, 6.0, 8.5),
  ('quân huy', 'quan_huy', 2.2, 3.2, 4.8), ('quan huy', 'quan_huy', 2.2, 3.2, 4.8), ('qh', 'quan_huy', 2.2, 3.2, 4.8), ('uc', 'uc', 5.0, 6.5, 9.0),
  ('kim cương', 'kim_cuong', 35, 60, 100), ('kim cuong', 'kim_cuong', 35, 60, 100), ('diamond', 'kim_cuong', 35, 60, 100), ('kc', 'kim_cuong', 35, 60, 100),
  ('vbucks', 'vbucks', 20, 35, 60), ('v-bucks', 'vbucks', 20, 35, 60)),
hits as (select p.*, currency, safe_max, amount / (price / 1000.0::double) as ratio, amount / (price / 1000.0::double) / safe_max::double as over_safe,
   case when amount / (price / 1000.0::double) >= scam then 'scam' else 'suspicious' end as severity, case when amount / (price / 1000.0::double) >= scam then 0.6 else 0.24 end::double as risk
   from pairs p join bands using (alias) where amount / (price / 1000.0::double) >= susp)"""


def _offers(t):
    return rates.offer_texts(spread(t("lineitem")), ALIASES)


def _hits(t):
    pairs = rates.rate_pairs(_offers(t), "offer_id", "text", KNOWN)
    return rates.rate_hits(pairs, rates.band_table(t.spark))


@query("quantity_mentions", rf"""with {OFFERS_SQL}, pr as ({_found('vnd|k')}), it as ({_found(ITEMS)})
select offer_id, 'price' as kind, pos, raw, unit, count(*) as n from pr group by all union all select offer_id, 'item', pos, raw, unit, count(*) from it group by all""")
def _(t):
    return rates.mention_counts(_offers(t), "offer_id", "text", {"price": ["vnd", "k"], "item": KNOWN})


@query("mentions_lateral", rf"""with {OFFERS_SQL}, pr as ({_found('vnd|k')})
select unit, count(*) as n, min(pos) as first_pos, max(pos) as last_pos, sum(length(raw))::bigint as digits from pr group by 1""")
def _(t):
    name = rates.register_mentions(t.spark, ["vnd", "k"])
    found = t.spark.sql(f"select unit, pos, raw from {{offers}} o, lateral {name}(lower(o.text))", offers=_offers(t))
    return found.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
                                     F.sum(F.length("raw")).alias("digits"))


@query("mention_pairs_nearby", rf"""with {PAIRS_SQL} select offer_id, price_pos, item_pos, price, amount, alias, count(*) as n from pairs group by all""")
def _(t):
    pairs = rates.rate_pairs(_offers(t), "offer_id", "text", KNOWN, units=("vnd", "k"))
    return pairs.groupBy(*pairs.columns).agg(F.count(F.lit(1)).alias("n"))


@query("alias_rate_bands", rf"""with {PAIRS_SQL}
select alias, currency, safe_max::double as safe_max, count(*) as n, round(avg(amount), 6) as avg_amount from pairs join bands using (alias) group by 1, 2, 3""")
def _(t):
    pairs = rates.rate_pairs(_offers(t), "offer_id", "text", KNOWN)
    return pairs.join(rates.band_table(t.spark), "alias").groupBy("alias", "currency", "safe_max").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("amount"), 6).alias("avg_amount"))


@query("rate_anomalies", rf"""with {PAIRS_SQL}
select offer_id, price_pos, item_pos, currency, severity, risk, round(ratio, 6) as ratio, round(over_safe, 6) as over_safe, count(*) as n from hits group by all""")
def _(t):
    hits = _hits(t).select("offer_id", "price_pos", "item_pos", "currency", "severity", "risk",
                           F.round("ratio", 6).alias("ratio"), F.round("over_safe", 6).alias("over_safe"))
    return hits.groupBy(*hits.columns).agg(F.count(F.lit(1)).alias("n"))


@query("worst_rate_per_text", rf"""with {PAIRS_SQL},
r as (select *, max(risk) over (partition by offer_id) as rate_risk, count(*) over (partition by offer_id) as rate_hits,
  row_number() over (partition by offer_id order by risk desc, over_safe desc, price_pos, item_pos, ratio) as rn from hits)
select offer_id, rate_risk, rate_hits, currency as top_currency, round(ratio, 6) as top_ratio, severity as top_severity from r where rn = 1""")
def _(t):
    out = rates.rate_verdict(_hits(t), "offer_id")
    return out.select("offer_id", "rate_risk", "rate_hits", "top_currency", F.round("top_ratio", 6).alias("top_ratio"), "top_severity")


RATIO_PATTERN = r"nhận (\d{2,7}) [^,]{2,9}, thêm (\d{1,7})"
RATIO2 = r"thêm (\d{1,7}) .{2,80}chỉ (\d{1,7})"


@query("exchange_ratio_flags", rf"""with {OFFERS_SQL},
e as (select offer_id, l_linenumber, regexp_extract(lower(text), '{RATIO_PATTERN}', ['a', 'b']) as x, regexp_extract(lower(text), '{RATIO2}', ['a', 'b']) as y from offers),
r as (select offer_id, l_linenumber, greatest(try_cast(x.a as double), try_cast(x.b as double)) / least(try_cast(x.a as double), try_cast(x.b as double)) as r1,
  greatest(try_cast(y.a as double), try_cast(y.b as double)) / least(try_cast(y.a as double), try_cast(y.b as double)) as r2 from e),
g as (select offer_id, l_linenumber, case when r1 is null then r2 when r2 is null then r1 else greatest(r1, r2) end as r from r)
select offer_id, l_linenumber, round(r, 6) as ratio, case when r >= 30 then 'UNREALISTIC_RATIO' when r >= 15 then 'SUSPICIOUS_RATIO' else 'none' end as flag, count(*) as n from g group by all""")
def _(t):
    rows = _offers(t).select("offer_id", "l_linenumber", rates.exchange_ratio(F.lower("text"), [RATIO_PATTERN, RATIO2]).alias("r"))
    flag = F.when(F.col("r") >= 30, "UNREALISTIC_RATIO").when(F.col("r") >= 15, "SUSPICIOUS_RATIO").otherwise("none")
    return rows.groupBy("offer_id", "l_linenumber", F.round("r", 6).alias("ratio"), flag.alias("flag")).agg(F.count(F.lit(1)).alias("n"))


CHANNELS = [("store", ["the hein", "license"]), ("shop", ["token", "rating", "mail3.example"]), ("help", ["nicht", "que la"])]


#: tf: texts in the form channels are looked for; th: what is found; ts: the verdict on the source.
TRUSTED_SQL = r"""tf as (select doc_id, text, trim(regexp_replace(regexp_replace(lower(text), '[\-–—_/|:;,\.\(\)\[\]\{\}!]+', ' ', 'g'), '\s+', ' ', 'g')) as t from documents),
th as (select doc_id, text, concat_ws(',', case when contains(t, 'the hein') or contains(t, 'license') then 'store' end, case when contains(t, 'token') or contains(t, 'rating') or contains(t, 'mail3 example') then 'shop' end,
   case when contains(t, 'nicht') or contains(t, 'que la') then 'help' end) as channels,
  (contains(t, 'the hein') or contains(t, 'license'))::int + (contains(t, 'token') or contains(t, 'rating') or contains(t, 'mail3 example'))::int + (contains(t, 'nicht') or contains(t, 'que la'))::int as n,
  regexp_matches(t, 'free')::int + regexp_matches(t, 'thing')::int + regexp_matches(t, 'dans')::int >= 2 as promo, regexp_matches(t, 'worthless') as warned,
  regexp_matches(t, 'pathetic') or contains(t, 'idiot') as risky, regexp_matches(t, 'loser') or contains(t, 'secret') as cred from tf),
ts as (select *, risky or (cred and not warned) as prompt from th)"""


def trusted_documents(t):
    """Documents with the source check, channels and patterns that occur in the base tables."""
    return trusted.trusted_source(
        spread(t("documents").select("doc_id", "text")), "text", CHANNELS, ["free", "thing", "dans"], ["worthless"], ["pathetic"], ["loser"],
        ["idiot", "secret"], ["secret"])


@query("trusted_channels", "with " + TRUSTED_SQL + """
select doc_id, channels, n as trusted_hits, promo as official_promo, prompt as risky_prompt, (n > 0 or promo) and not prompt as safe_reference,
  round(case when (n > 0 or promo) and not prompt then least(0.10::double + n * 0.05::double + case when promo then 0.06::double else 0 end, 0.40::double) else 0 end, 6) as safe_discount from ts""")
def _(t):
    out = trusted_documents(t)
    return out.select("doc_id", F.array_join("channels", ",").alias("channels"), "trusted_hits", "official_promo", "risky_prompt",
                      "safe_reference", F.round("safe_discount", 6).alias("safe_discount"))
