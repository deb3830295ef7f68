"""The quality model is fitted on every labelled row and every pair of them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from pactlens.llm import quality
from pactlens.llm.hashing import slabs


def test_all_rows_and_pairs_count(spark):
    rng = np.random.default_rng(3)
    words = np.array("the of and a to in is was he for it with as his on be at by had not".split())
    texts, good = [], rng.random(7000) > 0.3
    for n in range(7000):
        text = " ".join(rng.choice(words, 5 + n % 40))
        texts.append(text.replace("a", "#!", int(rng.integers(0, 4))) if good[n] == (n % 9 == 0) else text)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame([(n, int(g)) for n, g in enumerate(good)], "doc_id bigint, quality int")
    model = quality.train_quality_model(docs, labels, F.lit(True))
    x = np.concatenate([quality.text_features(d, b) for _, _, d, b in slabs(pa.array(texts))])
    assert np.allclose(model.mean, x.mean(axis=0), atol=1e-12) and np.allclose(model.scale, x.std(axis=0) + 1e-3, atol=1e-9)
    # The slope of the loss over all pairs, one by one, is nought.
    z, raw = model.normal(x), model.raw(x)
    wrong = 1 / (1 + np.exp(raw[good][:, None] - raw[~good][None, :]))
    slope = (wrong.sum(axis=0) @ z[~good] - wrong.sum(axis=1) @ z[good]) / wrong.size + 1e-4 * model.weights
    assert np.abs(slope).max() < 2e-4 and np.abs(model.weights).max() > 0.1
    # The cut stands between the two scores at the share of bad rows.
    ranked = np.sort(raw)
    assert np.isclose(model.cut, (ranked[(~good).sum() - 1] + ranked[(~good).sum()]) / 2, atol=1e-6)
    assert np.isclose(model.spread, raw.std() / 4 + 1e-6)
