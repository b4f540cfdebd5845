import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import mixing
from paperloom.llm.mixing import poisson_mix, source_rates


def test_counts_follow_the_inverse_distribution(spark):
    rows = [(i, f"t{i}", "a" if i % 10 else "b", "clash") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy_no string")
    out = poisson_mix(docs, {"a": 1, "b": 3}, size=2.0)
    assert out.columns == ["doc_id", "text", "source", "copy_no", "n_copies", "shuffle_key"]
    n = dict(out.groupBy("source").count().collect())
    assert abs(n["a"] - 1000) < 5 * math.sqrt(1000) and abs(n["b"] - 3000) < 5 * math.sqrt(3000)
    again = poisson_mix(docs.repartition(5), {"a": 1, "b": 3}, size=2.0)
    assert sorted(out.collect()) == sorted(again.collect())
    per = out.groupBy("doc_id").agg({"copy_no": "max", "*": "count"}).collect()
    assert all(r[1] == r[2] for r in per)


def test_large_rates_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, None), (None, "", "s"), (1, None, None), (2, "x", "huge")], "doc_id long, text string, source string")
    rates = {r["_mix_source"]: r["rate"] for r in source_rates(docs, {"huge": 1}, 2000).collect()}
    assert rates == {"": 0.0, "s": 0.0, "huge": 8000.0}
    n = poisson_mix(docs, {"huge": 1}, 2000).count()
    assert abs(n - 8000) < 500
    assert poisson_mix(docs.limit(0)).count() == 0
    same = [r["n_copies"] for r in poisson_mix(docs, size=8).where("doc_id = 1").collect()]
    assert len(set(same)) <= 1
    assert poisson_mix(docs, {}).count() == 0


def test_high_rates_and_their_copies(spark):
    rows = [(i, "common", "a") for i in range(2000)] + [(10_000 + i, "rare", "b") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    began = time.time()
    out = mixing.poisson_mix(docs, {"b": 1.0}, size=1500.0, shuffle=False)
    rate = 1500.0 * len(rows) / 3
    got = {r["doc_id"]: (r["n"], r["least"], r["most"], r["k"]) for r in out.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("copy_no").alias("least"), F.max("copy_no").alias("most"), F.max("n_copies").alias("k")).collect()}
    assert time.time() - began < 60 and rate > 1_000_000
    assert set(got) == {10_000, 10_001, 10_002}
    for n, least, most, k in got.values():
        assert n == most == k and least == 1 and abs(n - rate) < 6 * rate**0.5


@pytest.mark.parametrize("rate", [0.2, 30.0, 399.0, 401.0, 5000.0, 250_000.0])
def test_distribution_function(spark, rate):
    r = spark.range(1).select(mixing._window(F.lit(rate))[0].alias("first"), mixing._cdf(F.lit(rate)).alias("cdf")).first()
    logs = [k * math.log(rate) - rate - math.lgamma(k + 1) for k in range(r["first"], r["first"] + len(r["cdf"]))]
    want = np.cumsum(np.exp(logs))
    assert np.abs(np.array(r["cdf"]) - want).max() < 1e-7 and abs(r["cdf"][-1] - 1) < 1e-12
