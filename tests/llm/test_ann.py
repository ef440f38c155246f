import numpy as np

from terrapath.llm import ann

SCHEMA = "vec_id long, embedding array<float>, at int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in rows], SCHEMA)


def brute(rows, ids, k):
    out = {}
    usable = [(i, np.float32(v).astype(float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v) and len(v) == 16]
    for q in ids:
        own = [v for i, v in usable if i == q]
        if own:
            s = sorted(((-float(v @ own[0]), i) for i, v in usable if i != q))[:k]
            out[q] = [i for _, i in s]
    return out


def lists(rows):
    found = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    return found


def recall(m, ids, queries, got, k=20):
    hit = n = 0
    for q in queries:
        s = m.astype(float) @ m[q].astype(float)
        s[q] = -np.inf
        true = {int(ids[j]) for j in np.argsort(-s, kind="stable")[:k]}
        hit += len(true & set(got[int(ids[q])]))
        n += len(true)
    return hit / n


def test_rotation_keeps_length_and_is_near_identity_in_products():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20, 48)).astype(np.float32)
    for s in ann.signs(3, 64):
        y = ann.rotate(x, s)
        assert np.allclose((y * y).sum(1), (x * x).sum(1), rtol=1e-4)
        assert np.allclose(y @ y.T, x @ x.T, atol=1e-3)


def test_own_cell_is_the_best_probe():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 64))
    for axes in (1, 2, 3):
        t = ann.Tables(64, axes, tables=4)
        own = t.cell(x) + np.arange(4) * t.cells
        code, score = t.probes(x)
        assert (code.min(), code.max()) >= (0, 0) and code.max() < 4 * t.cells
        for row, c, s in zip(own, code, score, strict=True):
            assert len(set(c.tolist())) == len(c)
            for table in range(4):
                inside = np.flatnonzero(c // t.cells == table)
                assert c[inside[np.argmax(s[inside])]] == row[table]


def test_axes_grow_with_the_rows():
    assert [ann.axes_for(n, 64) for n in (0, 500, 2000, 50_000, 10**6, 10**9)] == [1, 1, 2, 2, 3, 4]


def test_exact_when_all_probes_are_taken(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(120)]
    rows += [(200, rows[0][1]), (201, rows[0][1]), (202, [0] * 16), (203, None), (204, [1.0] * 15 + [None]), (205, [float("nan")] * 16), (206, [float("inf")] + [0.0] * 15), (207, [1.0, 2.0]), (None, rows[1][1])]
    df = frame(spark, rows)
    got = ann.search(df, df.where("vec_id % 20 = 0"), k=7, depth=32 * ann.TABLES).collect()
    assert lists(got) == brute([r for r in rows if r[0] is not None], [i for i, _ in rows if i is not None and i % 20 == 0], 7)


def test_repeated_ids(spark):
    a, b = [1.0, *[0.0] * 15], [0.0, 1.0, *[0.0] * 14]
    df = frame(spark, [(0, b), (0, a), (1, a), (2, a), (2, b), (3, b), (3, b)])
    got = lists(ann.search(df, df.where("vec_id = 0"), k=5, depth=10**6).collect())
    # the smaller of the two vectors under id 0 asks; an id counts once, at its best
    assert got == {0: [2, 3, 1]}


def test_few_candidates_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 3)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(ann, "PAIRS", 5)
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(12)]
    df = frame(spark, rows)
    for depth in (1, 10**6):  # with one probe, queries end short and meet all rows
        got = ann.search(df, df, k=20, depth=depth).collect()
        assert lists(got) == brute(rows, range(12), 20)
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df.limit(1), df.limit(1)).count() == 0


def test_many_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    one = rng.normal(size=16)
    rows = [(i, one.tolist() if i % 3 == 0 else rng.normal(size=16).tolist()) for i in range(300)]
    got = lists(ann.search(frame(spark, rows), frame(spark, rows).where("vec_id % 30 = 0"), k=5).collect())
    assert got == {q: [x for x in (0, 3, 6, 9, 12, 15) if x != q][:5] for q in range(0, 300, 30)}


def test_recall_on_rows_not_used_to_calibrate(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = lists(ann.search(df, df.where("vec_id % 20 = 0")).collect())
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    ids, m = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32)
    assert recall(m, ids, np.flatnonzero(ids % 20 == 0), got) >= 0.9


def test_recall_where_norms_differ(spark):
    rng = np.random.default_rng(6)
    m = (rng.normal(size=(3000, 24)) * rng.lognormal(0, 0.5, (3000, 1))).astype(np.float32)
    df = frame(spark, list(enumerate(m.tolist())))
    queries = np.arange(1, 3000, 31)
    got = lists(ann.search(df, df.where("vec_id % 31 = 1"), k=10).collect())
    assert recall(m, np.arange(3000), queries, got, 10) >= 0.9


def test_scored_pairs_fall_as_a_share(spark, monkeypatch):
    """Share of all rows that a query is compared with, on rows of one law and growing number."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(20_000, 32)).astype(np.float32)
    share = []
    for n in (1000, 20_000):
        v = x[:n]
        t = ann.Tables(32, ann.axes_for(n, 32))
        q = v[:40]
        s = q @ v.T
        s[np.arange(40), np.arange(40)] = -np.inf
        true = np.argsort(-s, 1)[:, :10]
        code, score = t.probes(q)
        own = t.cell(v) + np.arange(t.tables) * t.cells
        need, pairs = [], 0
        for i in range(40):
            order = {c: k for k, c in enumerate(code[i][np.argsort(-score[i])].tolist())}
            need += [min(order.get(c, code.shape[1]) for c in own[j].tolist()) for j in true[i]]
        depth = sorted(need)[int(0.9 * len(need))]
        pairs = np.isin(own, t.deepest(q[:1], depth)).sum()
        share.append(pairs / n)
    assert share[1] < 0.6 * share[0]
