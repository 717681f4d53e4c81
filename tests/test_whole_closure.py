"""Closures of deep hierarchies."""

from __future__ import annotations

from shoal.operators.graph import closure


def test_closure_of_a_deep_chain(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(35)], "parent long, child long")
    assert closure(chain).where("distance > 30").count() == 15
