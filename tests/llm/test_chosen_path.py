import random
import re

import numpy as np

from terrapath.llm import chosen_path as cp


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    n = len(rows)
    links = [[j for j in range(n) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])] for i in range(n)]
    group = list(range(n))
    moved = True
    while moved:
        moved = False
        for i in range(n):
            for j in links[i]:
                if group[j] < group[i]:
                    group[i], moved = group[j], True
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[group[i]] = min(least.get(group[i], d), d)
    return sorted([(d, least.get(group[i], d), len(links[i])) for i, (d, _) in enumerate(rows)], key=str)


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id long, text string, row string, sid int")
    return sorted([(r.doc_id, r.class_id, r.n_links) for r in cp.join(df).collect()], key=str)


def near_copies(rng, vocabulary=4000):
    words = [f"w{i}" for i in range(vocabulary)]
    rows, i = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.randrange(3, 300))]
        for _ in range(rng.choice((1, 1, 2, 4, 9))):
            t = list(base)
            for _ in range(rng.randrange(0, max(1, len(t) // 60) + 1)):
                t[rng.randrange(len(t))] = rng.choice(words)
            rows.append((i * 7 % 1009, " ".join(t)))
            i += 1
    return rows


def test_against_brute_force(spark):
    rows = near_copies(random.Random(1))
    assert run(spark, rows) == brute(rows)


def test_large_group_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(cp, "BLOCK", 16)
    rng = random.Random(2)
    base = [f"v{rng.randrange(9000)}" for _ in range(200)]
    rows = [(n, " ".join(base[:k] + [f"n{n}"] + base[k + 1 :])) for n, k in enumerate(rng.randrange(200) for _ in range(130))]
    rows += [(200 + n, " ".join(base)) for n in range(5)] + [(300, "something else entirely in this short text")]
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "..."), (4, "one"), (5, "One!"), (6, "one two"), (7, "a b c d"), (8, "A, B; c d"), (None, "one"), (9, "a b c d e f"), (9, "a b c d e f"), (10, "x " * 5000), (11, "x " * 4000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_keep_one(spark):
    rng = random.Random(3)
    rows = near_copies(rng) + [(5000, None), (5001, "")]
    rows += [rows[0]]
    df = spark.createDataFrame([(d, t, "en") for d, t in rows], "doc_id long, text string, lang string")
    kept = cp.keep_one(df)
    assert kept.columns == df.columns
    want = sorted({(d, t) for (d, t) in rows for (x, c, n) in brute(rows) if x == d and (n == 0 or c == d)}, key=str)
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == want


def test_runs_reach_the_target():
    rng = np.random.default_rng(4)
    runs, n = cp.runs_for(), 400
    a = rng.integers(0, 1 << 32, (n, cp.WIDTH), dtype=np.uint64).astype(np.uint32)
    b = a.copy()
    flip = rng.random((n, cp.WIDTH)) < 0.2
    b[flip] = rng.integers(0, 1 << 32, int(flip.sum()), dtype=np.uint64).astype(np.uint32)
    keys = [set(zip(o.tolist(), k.tolist(), strict=True)) for k, o in (cp.paths(a, runs), cp.paths(b, runs))]
    met = {o for o, _ in keys[0] & keys[1]}
    assert len(met) / n > 0.99


def test_bucket_pairs_join_all_alike():
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 256, (3, 128)).astype(np.uint8)
    sk = np.repeat(centre, 200, 0)
    noise = rng.random(sk.shape) < 0.08
    sk[noise] = rng.integers(0, 256, int(noise.sum()))
    links = np.zeros((600, 600), bool)
    for i, j in cp.bucket_pairs(np.arange(600), sk, 84, 9, cp.DEEPEST):
        links[i, j] = links[j, i] = True
    assert len(set(cp.roots(links).tolist())) == 3


def chain(n, apart=40):
    """Sketches of which only neighbours share 88 of 128 coordinates."""
    rng = np.random.default_rng(6)
    out = [rng.integers(0, 1 << 32, cp.WIDTH, dtype=np.uint64).astype(np.uint32)]
    for k in range(1, n):
        out.append(out[-1].copy())
        out[-1][(np.arange(apart) + k * apart) % cp.WIDTH] = rng.integers(0, 1 << 32, apart, dtype=np.uint64)
    return np.array(out)


def low(sk):
    return np.ascontiguousarray(sk).view(np.uint8).reshape(len(sk), -1, 4)[:, :, 0]


def groups(n, pairs):
    links = np.zeros((n, n), bool)
    for i, j in pairs:
        links[i, j] = links[j, i] = True
    return len(set(cp.roots(links).tolist()))


def test_deepest_bucket_joins_a_chain():
    sk = low(chain(80))
    assert groups(80, cp.bucket_pairs(np.arange(80), sk, 84, 9, cp.DEEPEST)) == 1


def test_sides_meet_only_across():
    sk, side = low(chain(80)), np.arange(80) % 2
    assert groups(80, cp.bucket_pairs(np.arange(80), sk, 84, 9, cp.DEEPEST, side)) == 1
    pairs = list(cp.bucket_pairs(np.arange(80), sk, 84, 9, cp.DEEPEST, np.arange(80) // 40))
    assert [sorted(p) for p in pairs] == [[39, 40]]


def test_bucket_above_what_is_held_loses_no_pair(spark, monkeypatch):
    """All paths end in one bucket, which is dealt to blocks."""
    monkeypatch.setattr(cp, "HELD", 128)
    monkeypatch.setattr(cp, "paths", lambda values, runs: (np.full(len(values), 9, np.uint64), np.arange(len(values))))
    rows = [(i, bytearray(s.tobytes())) for i, s in enumerate(chain(300))]
    df = spark.createDataFrame(rows, "sid long, sketch binary")
    assert groups(300, [(r.a, r.b) for r in cp.candidate_pairs(df, 0.8, cp.TARGET).collect()]) == 1


def test_bucket_of_hundreds_keeps_pairs_at_the_threshold():
    """Pairs at 0.8 among sets that are not alike otherwise."""
    rng = np.random.default_rng(8)
    a = rng.integers(0, 256, (300, cp.WIDTH)).astype(np.uint8)
    a[:, ::3] = a[0, ::3]
    b = a.copy()
    for row in b:
        at = rng.choice(cp.WIDTH, cp.WIDTH // 5, replace=False)
        row[at] = row[at] + rng.integers(1, 256, len(at)).astype(np.uint8)
    met = set(cp.bucket_pairs(np.arange(600), np.concatenate([a, b]), 84, 9))
    assert {(min(p), max(p)) for p in met} == {(i, i + 300) for i in range(300)}
