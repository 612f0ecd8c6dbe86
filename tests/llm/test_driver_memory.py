"""What the driver holds: no texts to learn from, and no plan of all steps of a round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sylvan.llm import components, toxicity


def test_model_is_fitted_off_the_driver(spark, monkeypatch):
    texts = [("vile rotten scum again" if k % 3 == 0 else "a calm walk by the river") + f" word{k % 7}" for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(60)], "doc_id long, toxic int")
    order = [r[0] for r in docs.select("doc_id").orderBy(F.xxhash64("doc_id")).collect()]
    column = lambda ids: pa.array([texts[k].encode() for k in ids], pa.binary())
    want = toxicity.fit(column([k for k in order if k % 3 == 0]), column(order), 1 / 3)

    def refuse(self):  # noqa: ANN001, ANN202
        raise AssertionError("texts came to the driver")

    monkeypatch.setattr(type(docs), "toArrow", refuse)
    got = toxicity.learn(docs, labels, F.lit(True))
    assert np.array_equal(got.features, want.features) and np.array_equal(got.weights, want.weights) and got.bias == want.bias
    assert toxicity.learn(docs.limit(0), labels, F.lit(True)) is None


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    exchanges = []

    def noted(session, df, tag, write=components.stored):  # noqa: ANN001, ANN202
        exchanges.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return write(session, df, tag)

    monkeypatch.setattr(components, "stored", noted)
    edges = spark.createDataFrame([(k + 1, k) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["root"] for r in components.components(spark, edges).collect()}
    assert found == {**dict.fromkeys(range(1, 41), 0), 101: 100}
    assert max(exchanges) <= 6, exchanges
