"""Score ladders, recalibration and feature encodings as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions.patterns import count_patterns, count_words, has_pattern
from riskloom.functions.text import upper_ratio


def half_away(value: Column, digits: int) -> Column:
    """`value` to some digits as engines round that scale, round and scale back: the product meets ties that its decimal form does not."""
    scaled = F.abs(value) * 10.0 ** digits
    return F.when(scaled < 4e15, F.signum(value) * F.floor(scaled + 0.5) / 10.0 ** digits).otherwise(F.round(value, digits))


def below_steps(x: Column, steps: Sequence[tuple[float, float]], otherwise: float = 0.0) -> Column:
    out = None
    for bound, score in steps:
        out = F.when(x < bound, score) if out is None else out.when(x < bound, score)
    return out.otherwise(otherwise)


def above_steps(x: Column, steps: Sequence[tuple[float, float]], otherwise: float = 0.0) -> Column:
    return below_steps(-x, [(-bound, score) for bound, score in steps], otherwise)


def account_age_score(days: Column) -> Column:
    return F.when(days.isNull(), fixed.UNKNOWN_ACCOUNT_AGE).otherwise(below_steps(days, fixed.ACCOUNT_AGE_STEPS))


def follower_ratio_score(followers: Column, following: Column) -> Column:
    def at_least_one(c):
        return F.greatest(F.coalesce(c, F.lit(1)), F.lit(1))
    return below_steps(at_least_one(followers) / at_least_one(following), fixed.FOLLOWER_RATIO_STEPS)


def post_rate_score(per_day: Column) -> Column:
    return F.when(per_day.isNull(), fixed.UNKNOWN_POST_RATE).otherwise(above_steps(per_day, fixed.POST_RATE_STEPS))


def engagement_score(likes: Column, comments: Column, views: Column) -> Column:
    """Near-silent posts and overly busy ones both score."""
    rate = (F.greatest(F.coalesce(likes, F.lit(0)), F.lit(0)) + F.greatest(F.coalesce(comments, F.lit(0)), F.lit(0))) \
        / F.greatest(F.coalesce(views, F.lit(1)), F.lit(1))
    return F.when(rate < 0.001, 0.8).when(rate > 0.5, 0.7).when(rate < 0.01, 0.4).otherwise(0.0)


def density(text: Column, patterns: Sequence[str], full: float) -> Column:
    """Share of `full` reached by the number of matching patterns, at most 1."""
    return F.least(count_patterns(F.lower(text), patterns) / F.lit(full), F.lit(1.0))


def sigmoid(x: Column, slope: float, offset: float) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(slope) * x + F.lit(offset)))


def recalibrated_vector(
    probs: Sequence[Column], slope: float = fixed.SIGMOID_SLOPE, offset: float = fixed.SIGMOID_OFFSET
) -> list[Column]:
    """Sigmoid of each log probability, rescaled to sum 1."""
    raised = [sigmoid(F.log(F.least(F.greatest(p, F.lit(1e-10)), F.lit(1 - 1e-10))), slope, offset) for p in probs]
    total = F.greatest(sum(raised[1:], raised[0]), F.lit(1e-10))
    return [r / total for r in raised]


def recalibrated_single(
    p: Column, ece: float = 0.12, slope: float = fixed.SIGMOID_SLOPE, offset: float = fixed.SIGMOID_OFFSET
) -> Column:
    """Confidence blended with the sigmoid of its log odds; the larger the error, the more."""
    odds = F.log(F.greatest(p, F.lit(1e-10)) / F.greatest(1 - p, F.lit(1e-10)))
    blend = min(ece * 5, 0.8)
    return p * F.lit(1 - blend) + sigmoid(odds, slope, offset) * F.lit(blend)


def risk_level(label: Column, confidence: Column) -> Column:
    return (
        F.when(label == "SAFE", "LOW").when(confidence >= 0.8, "HIGH")
        .when(confidence >= 0.6, "MEDIUM").otherwise("LOW"))


def verdict_of_score(score: Column) -> tuple[Column, Column, Column]:
    """(prediction, risk level, confidence) of a detector score."""
    label = level = None
    for bound, name, risk in fixed.VERDICT_STEPS:
        test = score >= bound
        label = F.when(test, name) if label is None else label.when(test, name)
        level = F.when(test, risk) if level is None else level.when(test, risk)
    return label.otherwise("SAFE"), level.otherwise("LOW"), F.lit(0.5) + score * F.lit(0.45)


def review_priority(
    confidence: Column, is_new: Column, drift: Column, n_new_keywords: Column, threshold: float = 0.7
) -> Column:
    total = (
        F.when(confidence < threshold, 0.4).otherwise(0.0) + F.when(is_new, 0.3).otherwise(0.0)
        + drift * F.lit(0.2) + n_new_keywords * F.lit(0.05))
    return F.least(total, F.lit(1.0))


def prompt_rollup(probs: Column, groups: Mapping[str, Sequence[str]], subscores: Mapping[str, tuple[Sequence[str], str]],
                  threshold: float = 0.7) -> dict[str, Column]:
    """Risk summary of a prompt -> probability map.

    `groups` lists the prompts of safe, suspicious and high_risk; `subscores` maps a name to words
    looked up in the prompt text and to the group whose score stands in when no prompt has one.
    """
    def best(test) -> Column:
        return F.array_max(F.map_values(F.map_filter(probs, lambda k, _: test(k))))

    def in_group(names: Sequence[str]):
        return lambda k: k.isin(list(names))

    def says(words: Sequence[str]):
        return lambda k: F.lower(k).rlike("|".join(words))

    peak = {g: F.coalesce(best(in_group(names)), F.lit(0.0)) for g, names in groups.items()}
    combined = F.greatest(peak["high_risk"], peak["suspicious"] * F.lit(0.6))
    out = {
        "safe_score": peak["safe"], "suspicious_score": peak["suspicious"], "high_risk_score": peak["high_risk"],
        "combined_risk_score": combined,
        "safety_score": peak["safe"] / (peak["safe"] + combined + F.lit(1e-8)),
        "risk_level": F.when(combined >= threshold, "HIGH").when(combined >= 0.4, "MEDIUM").otherwise("LOW"),
        "is_safe": combined < threshold, "requires_review": combined >= 0.5,
    }
    for name, (words, fallback) in subscores.items():
        out[name] = F.coalesce(best(says(words)), peak[fallback] if fallback else F.lit(0.0))
    return out


def risk_code(level: Column) -> Column:
    out = F.lit(0.0)
    for name, code in fixed.RISK_CODES.items():
        out = F.when(level == name, code).otherwise(out)
    return out


def metadata_codes(age_group: Column, scenario: Column, realism: Column, turns: Column, slang: Column) -> dict[str, Column]:
    age = F.lit(fixed.AGE_CODES["unknown"])
    for name, code in fixed.AGE_CODES.items():
        age = F.when(age_group == name, code).otherwise(age)
    return {
        "age": age,
        **{f"scenario_{s}": F.when(scenario == s, 1.0).otherwise(0.0) for s in fixed.SCENARIOS},
        "realism": F.coalesce(realism, F.lit(0.0)), "turns": F.coalesce(turns, F.lit(0)) / 10.0,
        "slang": F.when(slang, 1.0).otherwise(0.0),
    }


def text_codes(text: Column, probs: Mapping[str, Column], confidence: Column, safe: Column, review: Column,
               level: Column) -> dict[str, Column]:
    def times(s):
        return (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)
    return {
        **{f"p_{k.lower()}": v for k, v in probs.items()}, "confidence": confidence,
        "text_safe": F.when(safe, 1.0).otherwise(0.0), "text_review": F.when(review, 1.0).otherwise(0.0),
        "text_risk": risk_code(level), "length": F.length(text) / 500.0, "links": times("http") / 10.0,
        "exclaims": times("!") / 20.0,
    }


def vision_codes(v: Mapping[str, Column]) -> dict[str, Column]:
    """`v` holds the score columns by name; missing ones count as 0."""
    names = ("combined_risk_score", "safety_score", "violent_risk", "scam_risk", "sexual_risk", "inappropriate_risk")
    return {
        **{n: F.coalesce(v.get(n, F.lit(0.0)), F.lit(0.0)) for n in names},
        "vision_safe": F.when(v["is_safe"], 1.0).otherwise(0.0),
        "vision_review": F.when(v["requires_review"], 1.0).otherwise(0.0),
        "vision_risk": risk_code(v["risk_level"]),
        "memory": F.coalesce(v.get("vram_usage_gb", F.lit(0.0)), F.lit(0.0)) / 4.0,
    }


def lexical_features(text: Column, flags: Mapping[str, str], slang: Sequence[str]) -> dict[str, Column]:
    """Length, word and symbol counts plus 0/1 flags, one per pattern."""
    low = F.lower(text)
    row = {
        "text_len": F.length(text),
        "word_count": F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")),
        "exclaim_count": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "caps_ratio": upper_ratio(text),
    }
    row.update({name: has_pattern(low, p).cast("int") for name, p in flags.items()})
    row["teen_code_count"] = count_words(low, slang)
    return row


def additive_score(text: Column, patterns: Sequence[str], words: Sequence[str],
                   pattern_step: float = 0.15, word_step: float = 0.05) -> Column:
    low = F.lower(text)
    total = count_patterns(low, patterns) * F.lit(pattern_step) + count_words(low, words) * F.lit(word_step)
    return F.least(total, F.lit(1.0))


def url_text_risk(url: Column, text: Column, high: Sequence[str], medium: Sequence[str],
                  url_words: Sequence[str], safe_words: Sequence[str]) -> Column:
    """Risk tier from words found in the URL and the text together."""
    both = F.lower(F.concat_ws(" ", url, text))
    h, m, u = count_words(both, high), count_words(both, medium), count_words(F.lower(url), url_words)
    return (
        F.when((h >= 2) | (u >= 2), F.least(F.lit(0.85), F.lit(0.55) + h * F.lit(0.08) + u * F.lit(0.06)))
        .when(h == 1, F.least(F.lit(0.75), F.lit(0.45) + m * F.lit(0.05)))
        .when(m >= 2, F.least(F.lit(0.60), F.lit(0.35) + m * F.lit(0.06)))
        .when(m == 1, 0.38)
        .when(count_words(F.lower(url), safe_words) > 0, 0.10)
        .otherwise(0.20))


def keyword_share_verdict(text: Column, bad: Sequence[str], rude: Sequence[str]) -> tuple[Column, Column]:
    """(label, confidence) from the share of each list that occurs."""
    low = F.lower(text)
    b, r = count_words(low, bad) / len(bad), count_words(low, rude) / len(rude)
    label = F.when(b > 0.3, "FAKE_SCAM").when(r > 0.2, "SUSPICIOUS").otherwise("SAFE")
    sure = (
        F.when(b > 0.3, F.least(b + 0.5, F.lit(0.9)))
        .when(r > 0.2, F.least(r + 0.5, F.lit(0.9))).otherwise(0.8))
    return label, sure
