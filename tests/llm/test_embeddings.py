import numpy as np

from quillspark.llm import hnsw


def test_links_match_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 16))
    clique = rng.normal(size=16) + rng.normal(size=(90, 16)) * 0.05
    near = base[:60] + rng.normal(size=(60, 16)) * 0.1
    x = np.concatenate([base, clique, near, base[:5], 3 * base[5:9]]).astype(np.float32)
    label = [int(i % 3) if i % 11 else None for i in range(len(x))]
    rows = [(i, [float(v) for v in r], y, 5, "c") for i, (r, y) in enumerate(zip(x, label))]
    odd = [(900, None, 1, 0, ""), (901, [0.0] * 16, 1, 0, ""), (902, [float("nan")] * 16, 1, 0, ""), (903, [float("inf")] + [1.0] * 15, 1, 0, ""), (904, [None] + [1.0] * 15, 1, 0, ""), (None, rows[0][1], 1, 0, ""), (905, [1.0, 2.0], 1, 0, "")]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int, n long, id string").repartition(4)
    unit = x.astype(float)
    norm = np.sqrt((unit**2).sum(1))
    y = np.array([-1 - i if v is None else v for i, v in enumerate(label)])
    linked = ((unit @ unit.T) / (norm[:, None] * norm) >= 0.93) & (y[:, None] == y[None, :])
    np.fill_diagonal(linked, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        new = np.array([min([root[i], *root[linked[i]]]) for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    for size in (8192, 60):
        monkeypatch.setattr(hnsw, "SHARD_ROWS", size)
        got = {r["id"]: r for r in hnsw.embedding_links(df).collect()}
        assert len(got) == len(rows) + len(odd)
        wrong = [i for i in range(len(x)) if got[i]["n_links"] != linked[i].sum() or got[i]["component_id"] != root[i]]
        assert len(wrong) <= 0.02 * len(x)
        assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in [900, 901, 902, 903, 904, 905, None])
    assert hnsw.embedding_links(df.limit(0)).count() == 0


def test_graph_recall():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[2000:] = x[:1000] + 0.05 * rng.normal(size=(1000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = hnsw.Graph(x, np.arange(len(x)))
    r, c = g.audited(x, 0.93)
    true = np.argwhere(x @ x.T >= 0.93)
    assert len({*map(tuple, true.tolist())} & set(zip(r.tolist(), c.tolist()))) >= 0.97 * len(true)
