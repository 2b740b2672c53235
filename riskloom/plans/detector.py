"""The rule detector: an ordered set of signals folded into one score, then clamps and a verdict."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions import text as tx
from riskloom.functions.patterns import FEW_WORDS, any_pattern, any_word, has_pattern, uni
from riskloom.functions.scores import verdict_of_score
from riskloom.operators.pattern_lexicon import required_literals
from riskloom.operators.rates import exchange_ratio


def fused_hashtags(text: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Any hashtag of 4 to 64 basic characters that matches both patterns of a pair."""
    tags = _basic_tags(text)

    def fused(tag: Column) -> Column:
        test = F.lit(False)
        for a, b in pairs:
            test = test | (tag.rlike(a) & tag.rlike(b))
        return test

    return F.contains(text, F.lit("#")) & F.exists(tags, fused)


def _basic_tags(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("#([a-z0-9_]{4,64})"), 1)


def laundering_hashtag(text: Column, item: str, words: Sequence[str]) -> Column:
    flat = F.transform(_basic_tags(text), lambda g: F.replace(g, F.lit("_"), F.lit("")))
    return F.contains(text, F.lit("#")) & F.exists(flat, lambda g: F.contains(g, F.lit(item)) & g.rlike("|".join(words)))


def repeated_tags(sorted_tags: str, least: int = 3) -> Column:
    """Number of tags used at least `least` times, from a column of sorted tags."""
    def same(x, j):
        return F.get(sorted_tags, j) == x

    return F.size(F.filter(sorted_tags, lambda x, j: (
        (j >= least - 1) & same(x, j - (least - 1)) & ~F.when(j >= least, same(x, j - least)).otherwise(False))))


@dataclass(frozen=True)
class DetectorRules:
    """Lexicon of the detector. `signals` maps a name of fixed_values.SIGNALS to its patterns."""

    signals: Mapping[str, Sequence[str]]
    items: Sequence[str] = ()
    item_codes: Sequence[str] = ()
    #: Where a code stands: `{}` is the code.
    code_form: str = r"(?:\s|^){}(?:\s|$|\W)"
    actions: Sequence[str] = ()
    gives: Sequence[str] = ()
    receives: Sequence[str] = ()
    peer_trade: Sequence[str] = ()
    tag_pairs: Sequence[tuple[str, str]] = ()
    tag_item: str = "robux"
    tag_words: Sequence[str] = ("lau", "giare", "uytin", "sach")
    price_board: Sequence[str] = ()
    ratios: Sequence[str] = ()
    finance: Mapping[str, Sequence[str]] = field(default_factory=dict)
    borderline: Sequence[str] = ()
    questions: Sequence[str] = ()
    rate_talk: Sequence[str] = ()
    execution: Sequence[str] = ()
    payment_ask: Sequence[str] = ()
    benign: Sequence[str] = ()
    tutorial: Sequence[str] = ()
    tutorial_risk: Sequence[str] = ()


def _has(low: Column, pattern: str) -> Column:
    """Does a lower-cased text match. A text without a literal that every match must hold is not searched."""
    test = has_pattern(low, pattern)
    # Under flags a match may hold other letters than the literal's.
    literals = [] if re.search(r"\(\?[a-zA-Z]", pattern) else required_literals(pattern)
    return any_word(low, literals) & test if 0 < len(literals) <= FEW_WORDS else test


def _any(low: Column, patterns: Sequence[str]) -> Column:
    return reduce(or_, [_has(low, p) for p in patterns]) if 0 < len(patterns) <= FEW_WORDS else any_pattern(low, patterns) if patterns else F.lit(False)


def _count(low: Column, patterns: Sequence[str]) -> Column:
    return sum((F.when(_has(low, p), 1).otherwise(0) for p in patterns), F.lit(0))


def _word(text: Column, words: Sequence[str]) -> Column:
    return any_word(text, words) if words else F.lit(False)


def _add(score: Column, condition: Column, amount) -> Column:
    return score + F.when(condition, amount).otherwise(0.0)


def _cap_if(score: Column, condition: Column, limit: float) -> Column:
    return F.least(score, F.when(condition, limit).otherwise(float("inf")))


def detect(df: DataFrame, text: str, rules: DetectorRules) -> DataFrame:
    """Adds score, verdict, flags and the parts of the score.

    Optional input columns take part when present: rate_risk, top_severity (rate anomaly of the
    text) and trusted_hits, official_promo, risky_prompt, safe_reference, safe_discount (trusted
    source check of the text).
    """
    cols = set(df.columns)

    def given(name: str, default) -> Column:
        return F.coalesce(F.col(name), F.lit(default)) if name in cols else F.lit(default)

    low = df.withColumn("_low", F.lower(F.coalesce(F.col(text), F.lit("")))).withColumn(
        "_sorted_tags", F.when(F.contains("_low", F.lit("#")), F.array_sort(tx.hashtags(F.col("_low")))).otherwise(F.array().cast("array<string>")))
    t, raw = F.col("_low"), F.coalesce(F.col(text), F.lit(""))
    # Stage 1: everything that reads the text, each once.
    facts = {f"_n_{name}": _count(t, pats) for name, pats in rules.signals.items()}
    facts.update({f"_f_{name}": _any(t, pats) for name, pats in rules.finance.items()})
    codes = [rules.code_form.replace("{}", c) for c in rules.item_codes]
    facts.update({
        "_item": _word(t, rules.items) | _any(t, codes),
        "_action": _word(t, rules.actions), "_give": _word(t, rules.gives), "_receive": _word(t, rules.receives),
        "_peer": _count(t, rules.peer_trade), "_fused": fused_hashtags(t, rules.tag_pairs),
        "_laundering": laundering_hashtag(t, rules.tag_item, rules.tag_words),
        "_board": _any(t, rules.price_board),
        "_ratio": exchange_ratio(t, rules.ratios) if rules.ratios else F.lit(None).cast("double"),
        "_border": _count(t, rules.borderline),
        "_question": F.contains(t, F.lit("?")) | _any(t, rules.questions),
        "_talk": _any(t, rules.rate_talk), "_execution": _any(t, rules.execution),
        "_ask": _any(t, rules.payment_ask), "_benign": _count(t, rules.benign),
        "_tutorial": _any(t, rules.tutorial), "_tutorial_risk": _word(t, rules.tutorial_risk),
        "_emoji": tx.emoji_count(raw), "_caps": tx.upper_ratio(raw), "_tags": repeated_tags("_sorted_tags"),
        "_rate": given("rate_risk", 0.0), "_severity": given("top_severity", ""),
        "_trusted": given("trusted_hits", 0), "_promo": given("official_promo", False),
        "_prompt": given("risky_prompt", False), "_safe_ref": given("safe_reference", False),
        "_discount": given("safe_discount", 0.0),
    })
    seen = low.withColumns(facts)
    c = F.col
    n = {name: c(f"_n_{name}") for name in rules.signals}
    step = {name: (s, cap) for name, s, cap, _, _ in fixed.SIGNALS}

    def part(name: str) -> Column:
        return tx.capped(n[name], *step[name]) if name in n else F.lit(0.0)

    def present(name: str) -> Column:
        return n[name] > 0 if name in n else F.lit(False)

    doubling = c("_item") & c("_give") & c("_receive")
    unreal = c("_item") & (c("_ratio") >= fixed.RATIO_STEPS[0][0])
    odd = c("_item") & ~F.coalesce(unreal, F.lit(False)) & (c("_ratio") >= fixed.RATIO_STEPS[1][0])
    has_source = (c("_trusted") > 0) | c("_promo")
    # Stage 2: the score fold in signal order.
    score = part("pay_first")
    score = _add(score, doubling, fixed.GIVE_RECEIVE)
    score = _add(score, c("_item") & (c("_peer") > 0), fixed.PEER_TRADE)
    score = _add(score, c("_fused"), fixed.FUSED_TAG)
    score = _add(score, c("_laundering"), fixed.LAUNDERING_TAG)
    score = _add(score, c("_laundering") & c("_board"), fixed.PRICE_BOARD)
    score = score + part("doubling") + c("_rate")
    relief = F.when(has_source & ~c("_prompt") & c("_safe_ref"), c("_discount")).otherwise(0.0)
    score = F.greatest(score - relief, F.lit(0.0)) + part("takeover")
    score = _add(_add(score, unreal, fixed.RATIO_STEPS[0][1]), odd, fixed.RATIO_STEPS[1][1])
    for name in ("crypto", "send_receive", "money_doubling", "giveaway", "shortlink"):
        score = score + part(name)
    groups = sum((c(f"_f_{g}").cast("int") for g in rules.finance), F.lit(0))
    score = score + tx.capped(groups, fixed.FINANCE_STEP, fixed.FINANCE_CAP)
    score = score + part("urgency") + part("slang") + part("trust") + tx.capped(c("_emoji"), 0.02, 0.1)
    caps = F.when(c("_caps") > 0.3, tx.capped(c("_caps"), 0.3, 0.15)).otherwise(0.0)
    score = score + caps + tx.capped(c("_tags"), 0.12, 0.25)
    base = seen.withColumn("_base", score)
    # Stage 3: adjustments that look at the score so far.
    border = F.when((c("_border") > 0) & (c("_base") < 0.20), tx.capped(c("_border"), 0.06, 0.18)).otherwise(0.0)
    theft = (
        present("pay_first") | present("takeover") | doubling | present("doubling") | F.coalesce(unreal, F.lit(False)))
    asked = c("_item") & c("_question") & c("_talk")
    contradiction = has_source & c("_prompt")
    severe = theft | (c("_severity") == "scam") | c("_laundering") | present("shortlink") | contradiction
    adjusted = base.withColumn("_adjusted", c("_base") + border)
    s = _cap_if(c("_adjusted"), asked & ~c("_execution") & ~theft, 0.39)
    s = _cap_if(s, (c("_promo") | c("_safe_ref")) & ~severe & ~c("_prompt"), 0.18)
    s = F.greatest(s, F.when(contradiction & c("_ask"), 0.58).when(contradiction, 0.40).otherwise(0.0))
    game_scam = doubling | present("doubling") | present("takeover") | F.coalesce(unreal, F.lit(False)) | c("_laundering")
    relief = F.when(game_scam, tx.capped(c("_benign"), 0.10, 0.20)).otherwise(tx.capped(c("_benign"), 0.25, 0.6))
    guide = c("_tutorial") & ~c("_tutorial_risk")
    s = F.greatest(F.greatest(s - relief, F.lit(0.0)) - F.when(guide, 0.40).otherwise(0.0), F.lit(0.0))
    money = F.greatest(
        present("pay_first"), present("crypto"), present("send_receive"), present("money_doubling"), groups > 0)
    hard = doubling | present("doubling") | present("takeover") | F.coalesce(unreal, F.lit(False)) \
        | (c("_severity") != "") | money
    s = _cap_if(s, c("_item") & (c("_peer") > 0) & ~hard, 0.39)
    flags = [
        (present("pay_first"), "FINANCIAL_SCAM:pay_first_scheme"),
        (doubling, "GAMING_DOUBLING_SCAM:give_receive_pattern"),
        (~doubling & c("_item") & (c("_action") | c("_receive")), "GAMING_SCAM_CONTEXT"),
        (c("_item") & (c("_peer") > 0), "RISKY_P2P_TRADING"),
        (c("_fused"), "SQUASHED_HASHTAG_SCAM"), (c("_laundering"), "HASHTAG_ROBUX_LAUNDERING"),
        (c("_laundering") & c("_board"), "HASHTAG_PRICEBOARD_SCAM_COMBO"),
        (present("doubling"), "GAMING_DOUBLING_SCAM:explicit"),
        (c("_severity") == "scam", "PRICE_ANOMALY_SCAM"), (c("_severity") == "suspicious", "PRICE_ANOMALY_SUSPICIOUS"),
        (has_source, "SAFE_ROBLOX_SOURCE"), (c("_promo"), "OFFICIAL_ROBLOX_PROMO_CONTEXT"),
        (contradiction, "SAFE_SOURCE_CONTRADICTION:risky_prompt_detected"),
        (present("takeover"), "ACCOUNT_TAKEOVER"), (unreal, "UNREALISTIC_RATIO"), (odd, "SUSPICIOUS_RATIO"),
        *[(present(name), flag) for name, _, _, flag, _ in fixed.SIGNALS
          if name in ("crypto", "send_receive", "money_doubling", "giveaway", "shortlink")],
        *[(c(f"_f_{g}"), f"FINANCIAL_SCAM:{g}") for g in rules.finance],
        (present("urgency"), "URGENCY_PRESSURE"),
        (n["slang"] > 2 if "slang" in n else F.lit(False), "TEENCODE_TARGETING"),
        (present("trust"), "TRUST_MANIPULATION"), (c("_emoji") > 5, "EMOJI_ABUSE"), (caps > 0.05, "EXCESSIVE_CAPS"),
        (c("_tags") > 0, "HASHTAG_SPAM"), (border > 0, "SUSPICIOUS_SIGNALS"), (asked, "CONTEXT_RATE_QUERY"),
        (guide, "SAFE_INSTRUCTIONAL_OVERRIDE"), (c("_benign") > 0, "SAFE_INDICATORS"),
    ]
    scored = adjusted.withColumns({
        "risk_score": F.least(s, F.lit(1.0)),
        "flags": F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in flags])),
    })
    label, level, sure = verdict_of_score(c("risk_score"))
    out = scored.withColumns({"prediction": label, "risk_level": level, "confidence": sure})
    return out.select(*df.columns, "risk_score", "prediction", "risk_level", "confidence", "flags")


RULE_SCHEMA = "section string, name string, ordinal int, pattern string"
#: Sections whose entries are pairs are stored as two rows each, one after the other.
_PAIRS = ("tag_pairs",)


def rule_rows(rules: DetectorRules) -> list[tuple[str, str, int, str]]:
    """The rules as rows of RULE_SCHEMA: what `load_rules` reads."""
    rows = []
    for section, value in vars(rules).items():
        if isinstance(value, Mapping):
            rows += [(section, name, i, p) for name, own in value.items() for i, p in enumerate(own)]
        else:
            flat = [value] if isinstance(value, str) else [p for pair in value for p in pair] if section in _PAIRS else value
            rows += [(section, "", i, p) for i, p in enumerate(flat)]
    return rows


def load_rules(table: DataFrame, limit: int = 20_000) -> DetectorRules:
    """Rules from a (section, name, ordinal, pattern) table. Its size is checked before it is read."""
    rows = table.select("section", "name", "ordinal", "pattern").orderBy("section", "name", "ordinal").take(limit + 1)
    if len(rows) > limit:
        raise ValueError(f"a rule table of more than {limit} patterns does not fit one plan")
    nested: dict[str, dict[str, list[str]]] = {}
    for r in rows:
        nested.setdefault(r["section"], {}).setdefault(r["name"], []).append(r["pattern"])
    lists: dict[str, object] = {s: names[""] for s, names in nested.items() if "" in names}
    for section in _PAIRS:
        if section in lists:
            flat = lists[section]
            lists[section] = list(zip(flat[::2], flat[1::2]))
    for section in ("tag_item", "code_form"):
        if section in lists:
            lists[section] = lists[section][0]
    return DetectorRules(signals=nested.get("signals", {}), finance=nested.get("finance", {}), **lists)


def runtime_flags(flags: Column, technical: Sequence[str]) -> Column:
    """The flags that report a degraded run rather than evidence."""
    pattern = uni("^(?:" + "|".join(technical) + ")")
    return F.filter(flags, lambda f: f.rlike(pattern))


def has_tutorial_sequence(text: Column) -> Column:
    return has_pattern(F.lower(text), r"(?s)(b1|bước\s*1|step\s*1).*(b2|bước\s*2|step\s*2)")
