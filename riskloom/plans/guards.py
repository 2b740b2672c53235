"""Ordered guard rules that may rewrite a verdict. Each step sees the state the one before left."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TECHNICAL = (
    "NLP_RULE_BASED_FALLBACK", "NLP_BASE_MODEL_UNFINETUNED", "VIDEO_ANALYSIS_DEGRADED",
    "LOW_TEXT_QUALITY_REVIEW", "IMAGE_ONLY_CAPABILITY_LIMITED", "IMAGE_PARSE_OR_OCR_FAILED",
)
BENIGN = ("SAFE_INDICATORS", "TEENCODE", "SAFE_ROBLOX_SOURCE", "OFFICIAL_ROBLOX_PROMO_CONTEXT", "CONTEXT_RATE_QUERY")
CRITICAL = (
    "^PRICE_ANOMALY_SCAM|^FINANCIAL_SCAM:pay_first_scheme|ACCOUNT_TAKEOVER|GAMING_DOUBLING_SCAM"
    "|^UNREALISTIC_RATIO|^HASHTAG_ROBUX_LAUNDERING|^HASHTAG_PRICEBOARD_SCAM_COMBO"
)
REAL_SIGNAL = (
    CRITICAL + "|^FINANCIAL_SCAM:|^SQUASHED_HASHTAG_SCAM|SHORTLINK_SUSPICIOUS|(?i:phish|otp)"
    "|^CLIP_GAME_SCAM_MARKERS$|^OCR_GAME_SCAM_MARKERS$"
)


@dataclass(frozen=True)
class Rewrite:
    """What a rule sets when its condition holds; unset parts stay as they are."""

    when: Column
    label: str | None = None
    risk: str | None = None
    confidence: Column | None = None
    review: bool | None = None
    add_flags: Sequence[tuple[Column, str]] = field(default_factory=tuple)


def apply_step(df: DataFrame, alternatives: Sequence[Rewrite]) -> DataFrame:
    """The first alternative whose condition holds rewrites the row."""
    def pick(name: str, value):
        out = None
        for r in alternatives:
            new = value(r)
            new = F.col(name) if new is None else (new if isinstance(new, Column) else F.lit(new))
            out = F.when(r.when, new) if out is None else out.when(r.when, new)
        return out.otherwise(F.col(name))

    def flags(r: Rewrite):
        if not r.add_flags:
            return None
        extra = F.array_compact(F.array(*[F.when(test, F.lit(name)) for test, name in r.add_flags]))
        return F.concat(F.col("flags"), F.array_except(extra, F.col("flags")))

    return df.withColumns({
        "label": pick("label", lambda r: r.label), "risk_level": pick("risk_level", lambda r: r.risk),
        "confidence": pick("confidence", lambda r: r.confidence),
        "needs_review": pick("needs_review", lambda r: r.review), "flags": pick("flags", flags),
    })


def guard_cascade(df: DataFrame) -> DataFrame:
    """Applies the guards in order.

    State: label, risk_level, confidence, needs_review, flags. Evidence: text_is_safe, text_chars,
    is_video, weak_crawl, has_game_context, official_promo, trusted_context, image_only,
    vision_limited, degraded, vision_risk, ocr_risk, ocr_chars, ocr_markers, ocr_score,
    clip_hits, clip_score, image_failed (the image could not be read).
    """
    c, yes = F.col, F.lit(True)

    def flagged(pattern: str) -> Column:
        return F.exists("flags", lambda f: f.rlike(pattern))

    def marker(*names: str) -> Column:
        return F.arrays_overlap("ocr_markers", F.array(*[F.lit(n) for n in names]))

    def at_least(*cols) -> Column:
        return F.greatest(c("confidence"), *[x if isinstance(x, Column) else F.lit(x) for x in cols])

    safe, suspicious, scam = c("label") == "SAFE", c("label") == "SUSPICIOUS", c("label") == "FAKE_SCAM"
    scores = (c("ocr_risk"), c("ocr_score"), c("clip_score"))
    weak_ocr = c("image_only") & (c("ocr_chars") < 12)
    image_signal = c("image_only") & (
        (c("vision_risk") >= 0.35) | (c("ocr_risk") >= 0.30) | (c("ocr_score") >= 0.45) | (c("clip_score") >= 0.22))
    other_flags = F.exists("flags", lambda f: ~f.rlike("^(" + "|".join(BENIGN + TECHNICAL) + ")"))
    df = df.withColumns({
        "_weak_ocr": weak_ocr, "_image_signal": image_signal,
        "_visual": (c("vision_risk") >= 0.50) | (c("ocr_risk") >= 0.45) | (c("ocr_score") >= 0.55) | (c("clip_score") >= 0.28) | image_signal,
        "_game": c("has_game_context") | marker("robux", "game_currency") | (c("clip_score") >= 0.22),
        # Evidence flags of the text stage, before any guard adds its own.
        "_evidence": other_flags,
        "_combo": marker("robux", "roblox_brand") & marker("bang_gia_rate", "nap_topup", "money_vnd"),
        "_ask": marker("pay_first", "credential_or_otp"),
    })
    steps = [
        # Degraded video run
        [Rewrite(c("degraded") & c("is_video") & safe, "SUSPICIOUS", "MEDIUM", at_least(0.58), True, [(yes, "VIDEO_ANALYSIS_DEGRADED")]),
         Rewrite(c("degraded") & c("is_video"), add_flags=[(yes, "VIDEO_ANALYSIS_DEGRADED")])],
        # Weak crawl
        [Rewrite(c("weak_crawl") & safe, "SUSPICIOUS", "MEDIUM", at_least(0.45), True, [(yes, "LOW_TEXT_QUALITY_REVIEW")])],
        # Images only, without working vision
        [Rewrite(c("image_only") & safe & c("vision_limited"), "SUSPICIOUS", "MEDIUM", at_least(0.56), True,
                 [(yes, "IMAGE_ONLY_CAPABILITY_LIMITED")])],
        # Visual flags
        [Rewrite(c("_visual") | c("_weak_ocr"), add_flags=[
            (yes, "VISION_OCR_RISK"), (F.size("ocr_markers") > 0, "OCR_GAME_SCAM_MARKERS"),
            (c("clip_hits") > 0, "CLIP_GAME_SCAM_MARKERS"), (c("_weak_ocr"), "IMAGE_ONLY_LOW_OCR_CONFIDENCE"),
            (c("image_failed"), "IMAGE_PARSE_OR_OCR_FAILED")])],
        # Clean text wins, game talk without evidence is kept under watch
        [Rewrite(~c("_evidence") & c("text_is_safe") & (~c("_game") | c("official_promo")) & ~c("_visual"),
                 "SAFE", "LOW", F.least(c("confidence"), F.lit(0.25)), False),
         Rewrite(c("_game") & ~c("_evidence") & ~c("official_promo"), "SUSPICIOUS", "MEDIUM", at_least(0.45), True)],
        # Images only must not end safe on markers
        [Rewrite(c("image_only") & safe & (c("_combo") | c("_ask") | (c("ocr_score") >= 0.55) | ((c("clip_score") >= 0.28) & c("_weak_ocr"))),
                 "FAKE_SCAM", "HIGH", at_least(0.75, *scores), True),
         Rewrite(c("image_only") & safe & ((F.size("ocr_markers") > 0) | c("_image_signal")), "SUSPICIOUS", "MEDIUM", at_least(0.56, *scores), True),
         Rewrite(c("image_only") & safe & c("_weak_ocr"), "SUSPICIOUS", "MEDIUM", at_least(0.56), True)],
        # Images only, strong visual evidence
        [Rewrite(c("image_only") & suspicious & (
            c("_combo") | c("_ask") | ((c("clip_score") >= 0.20) & c("_weak_ocr")) | (c("ocr_score") >= 0.62)
            | (c("vision_risk") >= 0.62) | (c("ocr_risk") >= 0.58)),
            "FAKE_SCAM", "HIGH", at_least(0.72, *scores, c("vision_risk")), True)],
        # Visual evidence against a safe verdict
        [Rewrite(c("_visual") & safe & ((c("vision_risk") >= 0.75) | (c("ocr_risk") >= 0.65)), "FAKE_SCAM", "HIGH",
                 at_least(c("vision_risk"), c("ocr_risk"), 0.75), True),
         Rewrite(c("_visual") & safe, "SUSPICIOUS", "MEDIUM", at_least(c("vision_risk"), c("ocr_risk"), 0.55), True)],
        # A scam verdict resting on technical or benign flags alone
        [Rewrite(scam & ~flagged(REAL_SIGNAL) & (F.size("flags") > 0) & ~other_flags & c("trusted_context") & (c("text_chars") >= 20),
                 "SAFE", "LOW", F.least(c("confidence"), F.lit(0.35)), False),
         Rewrite(scam & ~flagged(REAL_SIGNAL) & (F.size("flags") > 0) & ~other_flags, "SUSPICIOUS", "MEDIUM",
                 F.least(F.greatest(c("confidence"), F.lit(0.55)), F.lit(0.69)), True)],
        # Critical flag lock
        [Rewrite(suspicious & (flagged(CRITICAL) | (flagged("OCR_GAME_SCAM_MARKERS") & flagged("^(CLIP_GAME_SCAM_MARKERS|VISION_OCR_RISK)$")))
                 & ~flagged("CONTEXT_RATE_QUERY"), "FAKE_SCAM", "HIGH", at_least(0.72, *scores, c("vision_risk")), True)],
        # Grey zone
        [Rewrite(scam & (c("confidence") >= 0.40) & (c("confidence") < 0.70)
                 & ~(c("image_only") & (c("_weak_ocr") | (F.size("ocr_markers") > 0) | (c("clip_score") >= 0.22)))
                 & ~(flagged(CRITICAL) | (flagged("OCR_GAME_SCAM_MARKERS") & flagged("^(CLIP_GAME_SCAM_MARKERS|VISION_OCR_RISK)$"))),
                 "SUSPICIOUS", "MEDIUM", None, True)],
        # Risk level in line with the label
        [Rewrite(scam & (c("risk_level") == "LOW"), risk="MEDIUM"), Rewrite(safe, risk="LOW"),
         Rewrite(suspicious & ~c("risk_level").isin("MEDIUM", "HIGH"), risk="MEDIUM")],
    ]
    keep = [x for x in df.columns if not x.startswith("_")]
    for step in steps:
        df = apply_step(df, step)
    return df.select(*keep)
