"""What each kind of noise must leave as it is."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import noise
from riskloom.plans import catalog_noise

TEXTS = [
    "The gate of the old mill, they say, is closed! thanks  to the straße men", "Bạn vui không? mình sorry sorry vì tháng đẹp",
    "one two two three. Four; five: six seven", "a", "", None, "  spaced   out\ttext\nof several lines and words ",
]


@pytest.mark.parametrize("kind", list(noise.STEP_PROBABILITY))
def test_noise_changes_texts_and_keeps_the_rest(spark, kind):
    kept, _ = catalog_noise._KEPT[kind]
    frame = spark.createDataFrame([(i * 100 + j, t) for i in range(20) for j, t in enumerate(TEXTS)], "doc_id long, text string")
    rows = noise.augment(frame, "doc_id", "text", 42, [kind], {kind: 1.0})
    text = F.coalesce("text", F.lit(""))
    other = F.concat(text, F.lit(" zebra crossing"))
    seen = rows.select(F.col(f"noise_{kind}").alias("changed"), (kept(F.col("perturbed_text")) == kept(text)).alias("same"),
                       (kept(other) == kept(text)).alias("blind")).collect()
    assert all(r.same for r in seen)
    assert not any(r.blind for r in seen)
    assert sum(r.changed for r in seen) > len(seen) / 10
