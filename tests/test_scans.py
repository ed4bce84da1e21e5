import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from panelforge.plans.scans import blocked_scan


def test_matches_a_plain_scan(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": rng.choice(["hot", "a", "b"], 600, p=[0.8, 0.1, 0.1]), "t": rng.permutation(600), "v": rng.integers(-5, 9, 600).astype(float)})
    pdf.loc[rng.random(600) < 0.4, "v"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).withColumn("block", F.floor(F.col("t") / 37))
    out = blocked_scan(df, ["k"], "block", ["t"], sums={"s": "v"}, lasts={"l": "v"}, befores={"b": "v"}, nexts={"n": "v"}, maxes={"m": "v"}).toPandas().sort_values(["k", "t"])
    for k, g in pdf.sort_values(["k", "t"]).groupby("k"):
        o = out[out.k == k]
        np.testing.assert_allclose(o.l.to_numpy(float), g.v.ffill().to_numpy())
        np.testing.assert_allclose(o.s.to_numpy(float), np.where(g.v.notna().cumsum() > 0, g.v.fillna(0).cumsum(), np.nan))
        np.testing.assert_allclose(o.m.to_numpy(float), g.v.cummax().ffill().to_numpy())
        np.testing.assert_allclose(o.n.to_numpy(float), g.v.bfill().to_numpy())
        np.testing.assert_allclose(o.b.to_numpy(float), g.v.ffill().shift().to_numpy())


def test_empty(spark):
    df = spark.createDataFrame([], "k string, block long, t long, v double")
    assert blocked_scan(df, ["k"], "block", ["t"], sums={"s": "v"}).count() == 0
