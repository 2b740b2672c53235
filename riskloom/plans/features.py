"""The 14 post features: similarity, wording, account metadata and agreement of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from riskloom.functions import fixed_values as fixed
from riskloom.functions import scores
from riskloom.functions.text import substitution_density


def body_of(content: Column, description: Column, title: Column) -> Column:
    """Content, or description and title when there is none."""
    return F.coalesce(F.nullif(content, F.lit("")), F.concat_ws(" ", description, title))


def post_features(
    text: Column, vision_risk: Column, text_risk: Column, similarity: Column,
    text_safe: Column | None = None, text_suspicious: Column | None = None, ocr_risk: Column | None = None,
    account_age_days: Column | None = None, followers: Column | None = None, following: Column | None = None,
    posts_per_day: Column | None = None, likes: Column | None = None, comments: Column | None = None,
    views: Column | None = None,
    urgency: Sequence[str] = fixed.URGENCY_PATTERNS, actions: Sequence[str] = fixed.CALL_TO_ACTION_PATTERNS,
    links: Sequence[str] = fixed.LINK_PATTERNS,
) -> dict[str, Column]:
    """Named feature columns; absent inputs take their neutral value."""
    def known(c, kind="double"):
        return c if c is not None else F.lit(None).cast(kind)

    return {
        "vision_risk": vision_risk,
        "text_safe": F.coalesce(known(text_safe), F.lit(0.0)),
        "text_suspicious": F.coalesce(known(text_suspicious), F.lit(0.0)),
        "similarity": similarity,
        "leet": substitution_density(text),
        "urgency": scores.density(text, urgency, 5),
        "call_to_action": scores.density(text, actions, 3),
        "suspicious_links": scores.density(text, links, 5),
        "account_age": scores.account_age_score(known(account_age_days)),
        "follower_ratio": scores.follower_ratio_score(known(followers), known(following)),
        "post_rate": scores.post_rate_score(known(posts_per_day)),
        "engagement": scores.engagement_score(known(likes), known(comments), known(views)),
        "conflict": F.abs(vision_risk - text_risk),
        "product": vision_risk * text_risk,
    }
