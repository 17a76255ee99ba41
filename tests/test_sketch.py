"""Quantiles from merged sketches stay within their error of the exact ones."""

import random

from pyspark.sql import functions as F

from tapeline.functions import sketch


def test_quantiles_of_merged_parts(spark):
    rng = random.Random(3)
    values = {"a": [rng.lognormvariate(5, 2) for _ in range(4_001)], "b": [7.0] * 50, "c": [0.0, -1.0, 5.0]}
    rows = [(k, i % 5, v) for k, vs in values.items() for i, v in enumerate(vs)] + [("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, part int, v double")
    parts = [sketch.sketch(df.filter(F.col("part") == p), ["k"], F.col("v")) for p in range(5)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    shares = {"p1": 0.01, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    merged = sketch.merge(whole, ["k"])
    assert merged.count() < 800
    got = {r["k"]: r for r in sketch.quantiles(merged, ["k"], shares).collect()}
    assert set(got) == {"a", "b", "c"}
    for k, vs in values.items():
        ordered = sorted(max(v, 0.0) for v in vs)
        for name, share in shares.items():
            exact = ordered[max(-(-int(share * len(vs) * 1000) // 1000), 1) - 1]
            assert abs(got[k][name] - exact) <= sketch.ERROR * exact + 1e-9, (k, name)
    assert sketch.quantiles(sketch.sketch(df.limit(0), ["k"], F.col("v")), ["k"], shares).count() == 0
