"""The probes of the queries are dealt out, not broadcast."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.llm import neighbours


@pytest.mark.parametrize("few", [500_000, 0])
def test_probes_stay_on_executors(spark, monkeypatch, few):
    """Spark takes the probes (thousands a query) for as small as the queries."""
    plans, found = {}, neighbours.stash

    def stash(df, keep="lineage"):
        plans[keep] = df._jdf.queryExecution().executedPlan().toString()
        return found(df, keep)

    monkeypatch.setattr(neighbours, "stash", stash)
    monkeypatch.setattr(neighbours, "FEW_BUCKETS", few, raising=False)
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(k, rng.normal(size=6).tolist()) for k in range(400)], "vec_id long, embedding array<double>")
    got = neighbours.search(df, F.col("vec_id") % 4 == 0)
    assert got.count() == 500
    assert "MapInPandas" in plans["visits"] and "BuildLeft" not in plans["visits"]
