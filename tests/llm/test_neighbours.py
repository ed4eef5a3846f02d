"""The descent's parts, and what an audit does about links that it missed."""

import numpy as np
import pytest
from gridsift.llm import embeddings


def vectors(spark, seed=8):
    rng = np.random.default_rng(seed)
    rows = []
    for centre in rng.normal(size=(30, 12)):
        rows += [centre + rng.normal(size=12) * 0.04 for _ in range(6)]
    return rows, spark.createDataFrame([(i, [float(np.float32(x)) for x in v], 1) for i, v in enumerate(rows)], "vec_id long, embedding array<float>, label int")


def expected(rows):
    x = np.array([[float(np.float32(t)) for t in v] for v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= embeddings.THRESHOLD
    np.fill_diagonal(near, False)
    least = np.arange(len(x))
    while True:
        new = np.array([min([least[i], *least[near[i]]]) for i in range(len(x))])
        if (new == least).all():
            return {i: (int(near[i].sum()), int(least[i])) for i in range(len(x))}
        least = new


def test_audits_mend_a_poor_descent(spark, monkeypatch):
    for name in ("CODES", "NEIGHBOURS", "REVERSE", "PASSES"):
        monkeypatch.setattr(embeddings, name, 1)
    monkeypatch.setattr(embeddings, "ALONG", 2)
    monkeypatch.setattr(embeddings, "OWNERS", 2)
    monkeypatch.setattr(embeddings, "LEAST_RECALL", 0.0)
    rows, df = vectors(spark)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link(df).collect()}
    assert got == expected(rows)  # both samples hold all vectors, so no link is left


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "PASSES", 1)
    monkeypatch.setattr(embeddings, "audit", lambda found, roots, threshold: (0.5, roots.selectExpr("node as a", "root as b").limit(0)))
    with pytest.raises(RuntimeError, match="0.500"):
        embeddings.link(vectors(spark)[1])


def test_nearest_keeps_links_beyond_its_lists():
    rng = np.random.default_rng(9)
    x = rng.normal(size=8) + rng.normal(size=(60, 8)) * 0.01
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    out = embeddings.nearest(x, np.arange(60) * 3, 0.98, np.full(60, -1.5)).to_pydict()
    lists = [(u, v) for u, v, link in zip(out["u"], out["v"], out["link"], strict=True) if not link]
    assert len(lists) == 60 * embeddings.NEIGHBOURS and all(u != v for u, v in lists)
    root = np.arange(60)
    for u, v, link in zip(out["u"], out["v"], out["link"], strict=True):
        if link:
            root[root == root[v // 3]] = root[u // 3]
    assert len(set(root.tolist())) == 1 and sum(out["link"]) == 59
    known = [[int(v) for u, v in lists if u == i * 3] for i in range(60)]
    again = embeddings.nearest(x, np.arange(60) * 3, 0.98, np.full(60, -1.5), known).to_pydict()
    assert not set(lists) & {(u, v) for u, v, link in zip(again["u"], again["v"], again["link"], strict=True) if not link}


def test_columns_with_clashing_names_and_copies_only(spark):
    rows = [(i, [1.0, 2.0, 3.0], 1, "x", 5, None) for i in range(20)] + [(None, [1.0, 2.0, 3.0], 1, "y", 6, None)]
    got = embeddings.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, id string, root long, block string")).collect()
    assert len(got) == 21 and all(r["n_links"] == 20 and r["component_id"] == 0 for r in got) and [r["vec_id"] for r in got if r["kept"]] == [0]
