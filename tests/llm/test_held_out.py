"""Held-out accuracy on the larger tables."""

import os

import pytest
from pyspark.sql import functions as F

from docweave.llm import quality, toxicity

DATA = "/root/testdata/sf0.1"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


@pytest.mark.parametrize(("module", "label", "found", "left"), [(toxicity, "toxic", 0.9, 0.99), (quality, "quality", 0.95, 0.95)])
def test_held_out_rows(spark, module, label, found, left):
    """The shares of label 1 that are predicted so, and of label 0."""
    docs, labels = (spark.read.parquet(f"{DATA}/{n}.parquet") for n in ("documents", "labels"))
    model = module.fit(docs, labels)
    folds, held, threshold = (3, 1, 0.7) if label == "toxic" else (5, 0, 0.3)
    rows = docs.join(labels.where(f"{label} is not null").select("doc_id", label), "doc_id").where(F.crc32(F.col("doc_id").cast("string")) % folds == held)
    counts = {r[0]: (r.hit, r.n) for r in module.score(rows.select("doc_id", "text", label), model).groupBy(label).agg(F.count_if(F.col("score") >= threshold).alias("hit"), F.count(F.lit(1)).alias("n")).collect()}
    assert counts[1][0] >= found * counts[1][1] and counts[0][0] <= (1 - left) * counts[0][1], counts
