"""Toxicity on small fixtures."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from ledgerline.llm import knmodel, op2_toxicity


def test_a_wide_toxic_lexicon_is_learned(spark):
    """60 toxic words, each in about 3 of 100 toxic texts."""
    rng = random.Random(5)
    rows = []
    for i in range(1800):
        toxic = int(i % 3 == 0)
        words = [f"w{rng.randrange(200)}" for _ in range(20)]
        for _ in range(2 * toxic):
            words[rng.randrange(20)] = f"rude{rng.randrange(60)}"
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = op2_toxicity.train(docs.where("doc_id < 1500"))
    assert model is not None
    out = op2_toxicity.score(docs.where("doc_id >= 1500"), model).groupBy("toxic").agg(F.avg("predicted")).collect()
    share = dict(map(tuple, out))
    assert share[1] > 0.8 and share[0] < 0.05


def test_unpacking_takes_what_stays_and_lets_it_go():
    rng = np.random.default_rng(2)
    arrays = [np.full(1 << bits, fill, np.float16) for bits, fill in ((22, np.nan), (22, 0.0), (23, np.nan))]
    for x in arrays:
        at = rng.integers(0, len(x), 200_000)
        x[at] = rng.normal(size=len(at))
    size = sum(x.nbytes for x in arrays)
    held = knmodel.packed(knmodel.Pair(*arrays, -0.5))
    tracemalloc.start()
    try:
        pair = knmodel.unpacked(held)
        assert tracemalloc.get_traced_memory()[1] < 1.3 * size
        assert all(np.array_equal(a, b, equal_nan=True) for a, b in zip(arrays, pair[:3], strict=True)) and pair.unseen == -0.5
        del pair
        assert tracemalloc.get_traced_memory()[0] < 0.1 * size
    finally:
        tracemalloc.stop()


def test_a_task_unpacks_once_however_many_batches(spark):
    docs = spark.createDataFrame([(i, f"good word w{i % 7}" if i % 2 else f"rude thing r{i % 5}", 1 - i % 2) for i in range(600)], "doc_id long, text string, toxic int")
    model = op2_toxicity.train(docs)
    whole = {r.doc_id: r.score for r in op2_toxicity.score(docs.coalesce(1), model).collect()}
    most = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert whole == {r.doc_id: r.score for r in op2_toxicity.score(docs.coalesce(1), model).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", most)
    assert op2_toxicity.score(docs.where("false"), model).count() == 0
