import numpy as np
from gridsift.llm import embeddings


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 16)  # several blocks in a component
    rng = np.random.default_rng(3)
    rows = []
    for label in (0, 1):
        for centre in rng.normal(size=(6, 12)):
            rows += [(centre + rng.normal(size=12) * s, label) for s in np.repeat([0.03, 0.2], [12 if label else 4, 4])]
        rows += [(rng.normal(size=12), label) for _ in range(60)]
    hot = rng.normal(size=12)
    rows += [(hot + rng.normal(size=12) * 0.02, 1) for _ in range(70)]
    data = [(1000 - i, [float(np.float32(x)) for x in v], label) for i, (v, label) in enumerate(rows)]
    data += [(2000, data[0][1], data[0][2]), (2001, data[0][1], None), (2002, None, 1), (2003, [0.0] * 12, 1), (2004, [1.0, None] + [0.0] * 10, 1), (2005, [float("nan")] * 12, 1), (2006, [], 1), (2007, [1.0, 2.0], 0), (2008, [2.0, 4.0], 0)]
    got = {r["vec_id"]: r for r in embeddings.link(spark.createDataFrame([(i, v, x, "c") for i, v, x in data], "vec_id long, embedding array<float>, label int, id string")).collect()}
    assert len(got) == len(data)

    def near(a, b):
        (_, u, x), (_, v, y) = a, b
        if x is None or x != y or not u or not v or len(u) != len(v) or any(t is None or not np.isfinite(t) for t in u + v) or not any(u) or not any(v):
            return False
        return float(np.dot(u, v) / np.linalg.norm(u) / np.linalg.norm(v)) >= embeddings.THRESHOLD

    links = {a[0]: [b[0] for b in data if b[0] != a[0] and near(a, b)] for a in data}
    for i, linked in links.items():
        seen, todo = {i}, [i]
        while todo:
            fresh = set(links[todo.pop()]) - seen
            seen |= fresh
            todo += fresh
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (len(linked), min(seen), i == min(seen))


def test_no_rows(spark):
    assert embeddings.link(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def _expected(rows):
    """vec_id -> (n_links, component_id) of (vec_id, vector) rows of one label, by comparing all."""
    x = np.array([v for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= embeddings.THRESHOLD
    np.fill_diagonal(near, False)
    out, left = {}, set(range(len(rows)))
    while left:
        seen, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            seen.add(i)
            fresh = set(np.flatnonzero(near[i]).tolist()) & left
            left -= fresh
            todo += fresh
        first = min(rows[i][0] for i in seen)
        out |= {rows[i][0]: (int(near[i].sum()), first) for i in seen}
    return out


def _near(rng, centre, cosine, n):
    """n random vectors at that cosine to centre."""
    unit = centre / np.linalg.norm(centre)
    other = rng.normal(size=(n, len(centre)))
    other -= np.outer(other @ unit, unit)
    return cosine * unit + np.sqrt(1 - cosine * cosine) * other / np.linalg.norm(other, axis=1, keepdims=True)


def _check(spark, vectors):
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(vectors)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embeddings.link(spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int")).collect()}
    assert got == _expected(rows)


def test_tight_groups_with_looser_links_between(spark):
    """Members have more than 32 nearer neighbours than the other group's, and a large group fills the table."""
    rng = np.random.default_rng(5)
    parts = [_near(rng, rng.normal(size=64), 0.9985, 1500)]
    a = rng.normal(size=64)
    b = _near(rng, a, 0.986, 1)[0]
    parts += [_near(rng, a, 0.9998, 60), _near(rng, b, 0.9998, 60)]
    _check(spark, np.concatenate(parts))


def test_single_pairs_beside_a_large_group(spark):
    """Pairs hold few of all links, so their loss hardly shows in a share of links."""
    rng = np.random.default_rng(6)
    parts = [_near(rng, rng.normal(size=64), 0.9985, 1500)]
    for a in _near(rng, rng.normal(size=64), 0.95, 1000):
        parts += [a[None], _near(rng, a, 0.981, 1)]
    _check(spark, np.concatenate(parts))
