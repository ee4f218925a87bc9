"""Windows of texts that are longer than the shared ones."""

import numpy as np
import pytest

from actlake.plans.queries import QUERIES
from actlake.sources.model_tables import CONTEXT, ModelTables

NEAR = 1000


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    """Documents 5, with more than 1,000 windows, and 6; labels differ."""
    path = f"file://{tmp_path_factory.mktemp('long')}"
    texts = {5: NEAR * CONTEXT + 70, 6: 100}
    docs = [(d, " ".join(f"w{d}_{i % 50}" for i in range(n))) for d, n in texts.items()]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(5, 1), (6, 0)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    x = np.random.default_rng(6).normal(size=(500, 64)) / 8
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").write.parquet(f"{path}/embeddings.parquet")
    return path, texts


def test_windows_of_long_texts_stay_apart(spark, long_texts):
    path, texts = long_texts
    m = ModelTables(spark, path)
    assert m.token_pos.count() == m.token_pos.select("prompt_idx", "pos").distinct().count() == sum(texts.values())
    sizes = sorted(r["n"] for r in m.prompts.selectExpr("size(token_ids) AS n").collect())
    assert sizes == sorted([CONTEXT] * (NEAR + 2) + [6] + [CONTEXT] * 3 + [4])


def test_labels_of_long_texts(spark, long_texts):
    path, texts = long_texts
    m = ModelTables(spark, path)
    names = {r["token_id"]: r["token"] for r in m.vocab.collect()}
    hits = {}
    at = {(r["prompt_idx"], r["pos"]): names[r["token_id"]] for r in m.token_pos.collect()}
    for r in m.feat_acts.select("feature_id", "prompt_idx", "pos").collect():
        doc = int(at[r["prompt_idx"], r["pos"]][1])
        hits[r["feature_id"], doc] = hits.get((r["feature_id"], doc), 0) + 1
    got = {(r["feature_id"], r["quality"]): r["density"] for r in QUERIES["label_density"](spark, path).collect()}
    assert got == {(f, 6 - d): pytest.approx(n / texts[d], abs=1e-6) for (f, d), n in hits.items()}
