"""Verdict from word lists alone, with probabilities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.functions.patterns import any_word, count_words
from riskloom.functions.text import has_slang


def lexicon_verdict(
    df: DataFrame, text: str, scam: Sequence[str], watch: Sequence[str], items: Sequence[str], triggers: Sequence[str],
    actions: Sequence[str], receives: Sequence[str], benign: Sequence[str], slang: Sequence[str],
    rate_severity: str | None = None,
) -> DataFrame:
    """Adds prediction, p_safe, p_susp, p_scam.

    With no scam word, an item next to trigger words or to give-and-receive wording counts as one
    scam hit, and an item next to action wording as one watch hit. A rate anomaly of the text
    (`rate_severity`, an input column) adds one hit to its list.
    """
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    base = df.withColumn("_low", low)
    t, c = F.col("_low"), F.col
    facts = base.withColumns({
        "_scam0": count_words(t, scam), "_watch0": count_words(t, watch), "_item": any_word(t, items),
        "_trigger": any_word(t, triggers), "_action": any_word(t, actions), "_receive": any_word(t, receives),
        "_benign": any_word(t, benign), "_slang": has_slang(c(text), slang),
        "_severity": F.coalesce(c(rate_severity), F.lit("")) if rate_severity else F.lit(""),
    })
    none = c("_scam0") == 0
    tool = none & c("_item") & c("_trigger")
    swap = none & ~tool & c("_item") & c("_action") & c("_receive") & ~c("_benign")
    offer = none & ~tool & ~swap & c("_item") & c("_action") & ~c("_benign")
    counted = facts.withColumns({
        "_scam": c("_scam0") + (tool | swap).cast("int") + (c("_severity") == "scam").cast("int"),
        "_watch": c("_watch0") + offer.cast("int") + (c("_severity") == "suspicious").cast("int"),
    })
    s = F.least(F.lit(0.97), F.lit(0.35) + c("_scam") * F.lit(0.18) + F.when(c("_slang"), 0.10).otherwise(0.0))
    w = F.least(F.lit(0.85), F.lit(0.30) + c("_watch") * F.lit(0.10))
    scammy, watched = c("_scam") > 0, (c("_watch") > 0) & ~c("_benign")
    p_susp = F.when(scammy, F.least(F.lit(0.3), (1 - s) * 0.4)).when(watched, w).otherwise(0.12)
    p_scam = F.when(scammy, s).when(watched, F.least(F.lit(0.25), w * 0.3)).otherwise(0.06)
    p_safe = (
        F.when(scammy, F.greatest(F.lit(0.03), 1 - p_scam - p_susp))
        .when(watched, F.greatest(F.lit(0.1), 1 - p_scam - p_susp)).otherwise(0.82))
    label = F.when(scammy, "FAKE_SCAM").when(watched, "SUSPICIOUS").otherwise("SAFE")
    return counted.select(*df.columns, label.alias("prediction"), p_safe.alias("p_safe"), p_susp.alias("p_susp"), p_scam.alias("p_scam"))
