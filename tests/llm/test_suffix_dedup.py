import hashlib
import random

import numpy as np

from terrapath.llm import suffix_dedup as sd


def brute(rows, width=sd.WIDTH):
    """{row number: (removed spans, kept bytes)} by a dictionary of all strings."""
    least = {}
    for d, t in rows:
        b, d = (t or "").encode(), sd.LAST if d is None else d
        for i in range(len(b) - width + 1):
            least[b[i : i + width]] = min(least.get(b[i : i + width], sd.LAST), d)
    out = []
    for d, t in rows:
        b, d = (t or "").encode(), sd.LAST if d is None else d
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if least[b[i : i + width]] < d:
                gone[i : i + width] = True
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))).reshape(-1, 2)
        out.append((d, len(b), [tuple(e) for e in edge.tolist()], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return sorted(out, key=str)


def run(spark, rows, schema="doc_id long, text string"):
    got = sd.dedup(spark.createDataFrame(rows, schema)).collect()
    return sorted([(sd.LAST if r.doc_id is None else r.doc_id, r.n_bytes, [(s.start, s.stop) for s in r.removed], bytes(r.kept)) for r in got], key=str)


def text(rng, n, alphabet="abcdefgh éß"):
    return "".join(rng.choice(alphabet) for _ in range(n))


def test_sort_matches_plain_sort():
    rng = random.Random(1)
    for n, letters in ((400, "ab"), (3000, "abc"), (300, "a")):
        body = bytes(ord(rng.choice(letters)) for _ in range(n))
        body += body[: n // 2] + body[n // 3 :]
        data = np.frombuffer(body + b"\0" * 8, np.uint8)
        pos = np.arange(len(body) - 50 + 1)
        order, group = sd.deep_shallow(data, pos)
        strings = [body[p : p + 50] for p in pos[order]]
        assert strings == sorted(strings)
        assert sorted(order.tolist()) == pos.tolist()
        assert [a == b for a, b in zip(strings, strings[1:], strict=False)] == (np.diff(group) == 0).tolist()


def test_anchor_of_equal_strings_is_equal():
    rng = random.Random(2)
    shared = text(rng, 50, "abcdxyz").encode()
    a, b = text(rng, 70).encode() + shared + text(rng, 30).encode(), shared + text(rng, 200).encode()
    found = []
    for body in (a, b):
        p = body.index(shared)
        h, at, first, last = sd.anchors(np.frombuffer(body, np.uint8))
        i = int(np.flatnonzero((first <= p) & (p <= last))[0])
        found.append((int(h[i]), int(at[i]) - p))
    assert found[0] == found[1]


def test_against_brute_force(spark):
    rng = random.Random(3)
    passage, long = text(rng, 120), text(rng, 700)
    rows = []
    for d in range(60):
        t = text(rng, rng.randrange(0, 400))
        if d % 3 == 0:
            at = rng.randrange(len(t) + 1)
            t = t[:at] + passage + t[at:]
        if d % 4 == 1:
            i = rng.randrange(700)
            t = long[:i] + "#" + long[i + 1 :]
        if d % 7 == 2:
            t = t + long[100:160] + t
        if d % 10 == 9:
            t = rows[-1][1]
        rows.append((d * 3 % 61, t))
    assert run(spark, rows) == brute(rows)


def test_edges(spark):
    a = "x" * 300
    rows = [(None, a), (None, None), (1, ""), (2, "short"), (3, "short"), (4, a), (4, a), (5, a), (6, "y" + a[:49]), (7, None), (8, "z" * 49), (9, "z" * 49), (4, "other words " * 9)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a" * 60, "k", 1), (2, "a" * 60, "k", 1)], "doc_id long, text string, key string, row long")
    assert sorted((r.doc_id, len(r.kept)) for r in sd.dedup(df).collect()) == [(1, 60), (2, 0)]


def test_small_bounds_change_nothing(spark, monkeypatch):
    rng = random.Random(5)
    long = text(rng, 400, "abc")
    rows = [(i, long[rng.randrange(200) :] + text(rng, 60) + long[: rng.randrange(300)]) for i in range(25)]
    monkeypatch.setattr(sd, "AT_ONCE", 50)
    monkeypatch.setattr(sd, "HELD", 40)
    docs = [(d, 0, t) for d, t in rows]
    held = []
    for d, _, t in docs:
        h, at, first, last = sd.anchors(np.frombuffer(t.encode(), np.uint8))
        held += [(int(g), d, int(a - f), t.encode()[f : z + 50]) for g, a, f, z in zip(h, at, first, last, strict=True)]
    by = {}
    for g, d, o, c in held:
        by.setdefault(g, []).append((d, o, c))
    least = {}
    for _, d, _, c in held:
        for i in range(len(c) - 49):
            least[c[i : i + 50]] = min(least.get(c[i : i + 50], 99), d)
    for group in by.values():
        for (d, _, c), gone in zip(group, sd.sorted_strings(group), strict=True):
            assert gone.tolist() == [least[c[i : i + 50]] < d for i in range(len(c) - 49)]


def test_a_shared_passage_is_sent_once_per_task(spark, monkeypatch):
    rng = random.Random(7)
    passage = text(rng, 300)
    rows = [(i * 7 % 41, text(rng, rng.randrange(0, 90)) + "|" + passage + "|" + text(rng, 70)) for i in range(40)]
    df = spark.createDataFrame([(d, d, t, t) for d, t in rows], "row long, doc long, text string, body string").coalesce(1)
    at = {d: sorted({int(x) for x in sd.anchors(np.frombuffer(t.encode(), np.uint8))[1] if t.index("|") < x < len(t) - 121}) for d, t in rows}
    places = spark.createDataFrame(list(at.items()), "row long, places array<bigint>")
    sent = sd.contexts(df.join(places.coalesce(1), "row").coalesce(1)).collect()
    whole = [bytes(r.context) for r in sent if r.context is not None and bytes(r.context) in passage.encode()]
    assert any(r.context is None for r in sent) and len(whole) < len(sent) / 4
    monkeypatch.setattr(sd, "REMEMBERED", 2)
    assert run(spark, rows) == brute(rows)


def test_query_columns(spark):
    from terrapath.llm.queries import QUERIES

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    want = {d: (n, sum(z - a for a, z in s), len(s), hashlib.sha256(k).hexdigest()) for d, n, s, k in brute([(r.doc_id, r.text) for r in rows])}
    got = QUERIES["op4_suffix_array_dedup"](spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == want
