"""Fusion of text, vision, intent and platform evidence into one verdict."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions.maps import top_entries

SHARES = ("p_safe", "p_susp", "p_scam")


def soft_vote(df: DataFrame) -> DataFrame:
    """Weighted vote with vision and intent overrides.

    Input: text_safe, text_susp, text_scam, vision_risk, intent_score, intent_max, primary_intent,
    platform. Adds prediction, confidence, risk_level, needs_review, method and the three shares.
    """
    c = F.col
    zero = F.lit(0.0)
    bias = F.lit(0.0)
    for name, value in fixed.PLATFORM_BIAS.items():
        bias = F.when(F.lower("platform") == name, value).otherwise(bias)
    intent = F.greatest(c("intent_score"), c("intent_max") * 0.8)
    parts = df.withColumns({
        "_v_susp": F.least(F.lit(0.4), c("vision_risk") * 0.5), "_i_scam": intent,
        "_i_susp": F.least(F.lit(0.3), intent * 0.4), "_bias": bias,
    })
    vectors = {
        "text": (c("text_safe"), c("text_susp"), c("text_scam")),
        "vision": (F.greatest(zero, 1 - c("vision_risk") - c("_v_susp")), c("_v_susp"), c("vision_risk")),
        "intent": (F.greatest(zero, 1 - c("_i_scam") - c("_i_susp")), c("_i_susp"), c("_i_scam")),
        "platform": (F.greatest(zero, 1 - c("_bias") - c("_bias") * 0.5), c("_bias") * 0.5, c("_bias")),
    }
    raw = parts.withColumns({
        f"_{name}": sum((vec[i] * fixed.VOTE_WEIGHTS[k] for k, vec in vectors.items()), zero)
        for i, name in enumerate(SHARES)
    })
    total = c("_p_safe") + c("_p_susp") + c("_p_scam")
    norm = F.when(total == 0, 1.0).otherwise(total)
    voted = raw.withColumns({name: c(f"_{name}") / norm for name in SHARES})
    best = F.greatest(*[c(s) for s in SHARES])
    strong = ((c("intent_score") >= 0.5) | (c("intent_max") >= 0.6)) & ~c("primary_intent").isin("none", "unknown")
    high_vision, mid_vision = c("vision_risk") >= 0.75, c("vision_risk") >= 0.55
    sure_intent = F.greatest(F.lit(0.65), c("intent_score"), c("intent_max"))
    decided = voted.withColumns({
        "prediction": F.when(high_vision, "FAKE_SCAM").when(mid_vision, "SUSPICIOUS").when(strong, "FAKE_SCAM")
        .when((c("p_scam") == best) & (c("p_scam") >= 0.35), "FAKE_SCAM")
        .when((c("p_susp") == best) & (c("p_susp") >= 0.30), "SUSPICIOUS").otherwise("SAFE"),
        "confidence": F.when(mid_vision, c("vision_risk")).when(strong, sure_intent).otherwise(best),
        "method": F.when(mid_vision, "vision_override").when(strong, "intent_override").otherwise("soft_vote"),
    })
    scam = c("prediction") == "FAKE_SCAM"
    level = (
        F.when(high_vision, "HIGH").when(mid_vision, "MEDIUM")
        .when(strong & (c("confidence") >= 0.75), "HIGH").when(strong, "MEDIUM")
        .when(scam & (c("confidence") >= 0.70), "HIGH")
        .when(c("prediction") != "SAFE", "MEDIUM").otherwise("LOW"))
    return decided.withColumns({"risk_level": level, "needs_review": c("prediction") != "SAFE"}).select(
        *df.columns, "prediction", "confidence", "risk_level", "needs_review", "method", *SHARES)


def simple_fusion(vision_safe: Column, text_safe: Column, vision_risk: Column, text_confidence: Column) -> tuple[Column, Column]:
    """(label, confidence) without a model."""
    label = (
        F.when(vision_safe & text_safe, "SAFE").when((vision_risk > 0.7) | ~text_safe, "FAKE_SCAM")
        .otherwise("SUSPICIOUS"))
    sure = (
        F.when(vision_safe & text_safe, 0.8)
        .when((vision_risk > 0.7) | ~text_safe, F.greatest(vision_risk, 1 - text_confidence)).otherwise(0.6))
    return label, sure


def safety_override(df: DataFrame, prediction: str, confidence: str) -> DataFrame:
    """A model scam verdict gives way when text, text risk and intent all say safe.

    Input also: text_prediction, text_risk, intent_score, vision_risk.
    """
    clash = (
        (F.col("text_prediction") == "SAFE") & (F.col("text_risk") < 0.2) & (F.col("intent_score") < 0.2)
        & (F.col(prediction) == "FAKE_SCAM"))
    calm = clash & (F.col("vision_risk") < 0.35)
    return df.withColumns({
        prediction: F.when(calm, "SAFE").when(clash, "SUSPICIOUS").otherwise(F.col(prediction)),
        confidence: F.when(calm, 0.95).when(clash, 0.60).otherwise(F.col(confidence)),
        "override": F.when(calm, "suppressed").when(clash, "downgraded").otherwise("none"),
    })


def arbitrate(rule_label: Column, rule_conf: Column, model_label: Column, model_conf: Column, flags: Column,
              keep: Sequence[str]) -> Column:
    """'rules' or 'model': whose result stands."""
    kept = F.exists(flags, lambda f: f.rlike("|".join(keep)))
    source = F.exists(flags, lambda f: F.contains(f, F.lit("SAFE_ROBLOX_SOURCE")))
    louder = (model_label != "SAFE") & (model_conf > rule_conf)
    return (
        F.when(rule_label != "SAFE", "rules")
        .when(louder & (source | (model_conf < 0.78) | (model_conf - rule_conf < 0.10)), "rules")
        .when(louder, "model")
        .when((model_label == "SAFE") & ~kept & (model_conf > rule_conf), "model").otherwise("rules"))


def intent_text(label: Column, flags: Column, intent: Column) -> Column:
    """Intent wording brought in line with a non-safe verdict."""
    def flagged(pattern):
        return F.exists(flags, lambda f: f.rlike(pattern))

    blank = F.contains(F.lower(intent), F.lit("không phát hiện dấu hiệu lừa đảo")) | (F.trim(intent) == "")
    clash = label.isin("SUSPICIOUS", "FAKE_SCAM") & blank
    return (
        F.when(clash & flagged("PRICE_ANOMALY"), "Bất thường giá thị trường")
        .when(clash & flagged("^(CLIP_GAME_SCAM_MARKERS|OCR_GAME_SCAM_MARKERS|VISION_OCR_RISK)$"),
              "Nghi vấn lừa đảo game qua hình ảnh")
        .when(clash, "Nghi vấn hoạt động lừa đảo").otherwise(intent))


def merge_evidence(df: DataFrame) -> DataFrame:
    """One verdict from text and vision evidence of a video.

    Input: text_label, text_conf, vision_ai, audio_ai, is_ai, intents (scores by name), flags,
    visual_score, visual_hits, transcript, frames, faces. Each intent over the bound is a reason of its own,
    intent:name:percent, the strongest first.
    """
    c = F.col
    active = top_entries(F.map_filter("intents", lambda _, score: score > fixed.ACTIVE_INTENT), 0.0)
    df = df.withColumns({
        "_active": active, "_max_intent": F.coalesce(F.array_max(F.map_values("intents")), F.lit(0.0)),
    }).withColumn("_intent_count", F.size("_active"))

    def flagged(pattern):
        return F.exists("flags", lambda f: f.rlike(pattern))

    direct = "^PRICE_ANOMALY_SCAM|^UNREALISTIC_RATIO|FINANCIAL_SCAM:pay_first_scheme|ACCOUNT_TAKEOVER|GAMING_DOUBLING_SCAM|^HASHTAG_PRICEBOARD_SCAM_COMBO"
    facts = df.withColumns({
        "_critical": flagged(direct + "|^HASHTAG_ROBUX_LAUNDERING|SHORTLINK_SUSPICIOUS|(?i:phish|otp)"),
        "_direct": flagged(direct), "_tags": flagged("^HASHTAG_ROBUX_LAUNDERING|^SQUASHED_HASHTAG_SCAM"),
        "_ai_score": c("vision_ai") * 0.6 + c("audio_ai") * 0.4,
        "_ai_sure": (c("vision_ai") > 0.85) | (c("audio_ai") > 0.85),
        "_label": F.when(c("text_label") == "UNKNOWN", "SUSPICIOUS").otherwise(c("text_label")),
        "_conf": F.when(c("text_label") == "UNKNOWN", 0.55).otherwise(c("text_conf")),
    })
    safe = c("_label") == "SAFE"
    locked = facts.withColumns({
        "_text": F.when(safe & c("_direct"), "FAKE_SCAM").when(safe & c("_tags"), "SUSPICIOUS").otherwise(c("_label")),
        "_sure": F.when(safe & c("_direct"), F.greatest("_conf", F.lit(0.68)))
        .when(safe & c("_tags"), F.greatest("_conf", F.lit(0.60))).otherwise(c("_conf")),
    })
    seen = (c("visual_score") >= 0.65) | (c("visual_hits") >= 5)
    hinted = (c("visual_score") >= 0.35) | (c("visual_hits") >= 3)
    backed = (c("_intent_count") > 0) | (c("audio_ai") > 0.6) | (c("visual_score") >= 0.35)
    ai = c("is_ai") | c("_ai_sure")
    verdict = (
        F.when(c("_text") == "FAKE_SCAM", "FAKE_SCAM")
        .when((c("_text") == "SUSPICIOUS") & (seen | (c("_critical") & (c("_sure") >= 0.60))), "FAKE_SCAM")
        .when(c("_text") == "SUSPICIOUS", "SUSPICIOUS")
        .when(c("_critical") & (c("_sure") >= 0.55), "FAKE_SCAM").when(seen, "FAKE_SCAM").when(hinted, "SUSPICIOUS")
        .when(ai & (c("_ai_score") > 0.6) & backed, "SUSPICIOUS")
        .when(c("_ai_sure") & (c("_ai_score") > 0.7), "SUSPICIOUS").otherwise("SAFE"))
    judged = locked.withColumn("_verdict", verdict)
    bare = (F.length(F.trim(F.coalesce("transcript", F.lit("")))) < 5) & (c("frames") == 0) & (c("faces") == 0)
    clean = (c("_text") == "SAFE") & ~c("_critical") & (c("_max_intent") < 0.20) & (c("visual_score") < 0.20)
    forced = bare & (c("_verdict") == "SAFE") & ~clean
    final = judged.withColumns({
        "verdict": F.when(forced, "SUSPICIOUS").otherwise(c("_verdict")),
        "_final_conf": F.when(forced, F.greatest("_sure", F.lit(0.55))).otherwise(c("_sure")),
        "low_evidence": bare & (c("_verdict") == "SAFE"),
    })
    danger = F.greatest(
        F.when(c("_text") != "SAFE", c("_final_conf")).otherwise(0.0), c("_ai_score"), c("visual_score"), c("_max_intent") * 0.5)
    first = [
        (c("_text") == "FAKE_SCAM", "text_scam"), (c("_text") == "SUSPICIOUS", "text_suspicious"),
        (c("low_evidence") & (c("_text") == "SAFE"), "little_media"),
    ]
    by_intent = F.transform("_active", lambda x: F.concat_ws(":", F.lit("intent"), x["key"], F.round(x["score"] * 100).cast("int").cast("string")))
    rest = [
        (c("audio_ai") > 0.85, "voice_cloned"),
        ((c("audio_ai") > 0.6) & (c("audio_ai") <= 0.85), "voice_odd"),
        ((c("vision_ai") > 0.6) & (c("faces") > 0), "faces_generated"), ((c("vision_ai") > 0.6) & (c("faces") == 0), "image_generated"),
        (hinted, "text_in_image"),
        ((c("verdict") == "SAFE") & (c("_intent_count") == 0) & (c("audio_ai") < 0.4) & (c("vision_ai") < 0.4), "nothing_found"),
        ((c("verdict") == "SAFE") & ~((c("_intent_count") == 0) & (c("audio_ai") < 0.4) & (c("vision_ai") < 0.4)), "not_enough"),
    ]
    return final.withColumns({
        "verdict_confidence": F.when(c("verdict") == "SAFE", F.greatest(F.lit(0.5), 1 - danger))
        .otherwise(F.greatest("_final_conf", "_ai_score", "visual_score", "_max_intent")),
        "verdict_risk": F.when(c("verdict") == "FAKE_SCAM", "HIGH").when(c("verdict") == "SUSPICIOUS", "MEDIUM").otherwise("LOW"),
        "reasons": F.concat(*[F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in first])), by_intent,
                              F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in rest]))]),
    }).select(*[x for x in df.columns if not x.startswith("_")], "verdict", "verdict_confidence", "verdict_risk", "low_evidence", "reasons")
