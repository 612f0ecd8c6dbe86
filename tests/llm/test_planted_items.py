"""op7's operator on items of the benchmark planted whole, edited and stretched at random places of sf0.1's documents."""

import numpy as np
import pytest

from sylvan.llm.decontaminate import LCS_SHARE, contaminated

SF = "/root/testdata/sf0.1"
KINDS = ("whole", "edited", "stretched")


@pytest.fixture(scope="module")
def planted(spark):
    """(documents with an item each, doc_id: (item_id, kind))"""
    rng = np.random.default_rng(5)
    texts = [(r.doc_id, r.text.split()) for r in spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) > 200").select("doc_id", "text").orderBy("doc_id").collect()]
    items = [(r.item_id, r.text.split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    rows, truth = [], {}
    for n, (i, words) in enumerate(texts):
        item_id, item = items[n % len(items)]
        kind = KINDS[n // len(items) % len(KINDS)]
        put = list(item)
        other = [words[k] for k in rng.integers(len(words), size=len(item))]
        if kind == "edited":
            gone = rng.permutation(len(item))[: int((1 - LCS_SHARE) * len(item))]
            for k in gone:
                put[k] = other[k]
        elif kind == "stretched":
            put = [x for k, w in enumerate(item) for x in ([w, other[k]] if rng.random() < 0.3 else [w])]
        at = int(rng.integers(len(words) + 1))
        rows.append((i, " ".join(words[:at] + put + words[at:])))
        truth[i] = (item_id, kind)
    return rows, truth


def test_every_planted_item_is_found(spark, planted):
    rows, truth = planted
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = {(r.doc_id, r.item_id) for r in contaminated(spark, docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    missed = {kind: sum((i, item) not in found for i, (item, k) in truth.items() if k == kind) for kind in KINDS}
    print(len(truth), missed)
    assert not any(missed.values()), missed
