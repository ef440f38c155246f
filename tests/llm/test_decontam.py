import random
import re
from collections import Counter

from terrapath.llm import decontam as dc


def words(t):
    return [w for w in re.split(r"[^\w]+|_", (t or "").lower()) if w]


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    best = {}
    for d, t in docs:
        w = words(t)
        for i, q in items:
            v = words(q)
            if not v:
                continue
            k, n = min(5, len(v)), len(v)
            m = bag(v, k)
            for s in range(max(1, len(w) - n + 1)):
                x = bag(w[s : s + n], k)
                if not x:
                    continue
                both = sum((x & m).values())
                sim = both / (sum(x.values()) + sum(m.values()) - both)
                if sim >= 0.8 - 1e-12 and sim > best.get((d, i), 0):
                    best[d, i] = sim
    return {(d, i, round(s, 9)) for (d, i), s in best.items()}


def run(spark, docs, items):
    a = spark.createDataFrame([(d, t, 1, "w") for d, t in docs], "doc_id long, text string, item_id int, w string")
    b = spark.createDataFrame([(i, t, 5) for i, t in items], "item_id long, text string, doc_id int")
    return {(r.doc_id, r.item_id, round(r.similarity, 9)) for r in dc.find_leaks(a, b).collect()}


def test_against_brute_force(spark):
    rng = random.Random(1)
    vocabulary = [f"t{i}" for i in range(3000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randrange(14, 60)))) for i in range(25)] + [(100, "two words"), (101, "just four short words"), (102, None), (103, "")]
    items += [(104, "again and again and again and again and again and again and again")]
    docs = []
    for d in range(120):
        w = say(rng.randrange(0, 150))
        if d % 2:
            q = items[rng.randrange(25)][1].split()
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(q))
                q = rng.choice((q[:at] + say(1) + q[at + 1 :], q[:at] + q[at + 1 :], q[:at] + say(1) + q[at:]))
            at = rng.randrange(len(w) + 1)
            w = w[:at] + q + w[at:]
        docs.append((d, " ".join(w).upper() if d % 5 == 0 else ", ".join(w)))
    docs += [(500, items[0][1]), (501, " ".join(items[1][1].split()[:-1])), (502, None), (503, ""), (504, "say two words now"), (505, items[29][1] + " and again"), (500, items[0][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c d e f")]) == set()
    assert run(spark, [(1, "a b c d e f")], []) == set()
    assert run(spark, [(1, "a b c d e f")], [(1, None)]) == set()


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(2)
    base = rng.getrandbits(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    near = [(i, signed(base ^ sum(1 << b for b in rng.sample(range(64), dc.RADIUS)))) for i in range(150)]
    a = dc.block_rows(spark.createDataFrame(near, "id long, fp long"), 0)
    b = dc.block_rows(spark.createDataFrame([(signed(base),)], "fp long"), dc.RADIUS // dc.BLOCKS).select("block", "value")
    assert a.join(b, ["block", "value"]).select("id").distinct().count() == 150


def test_drop_leaks(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, "clean words in this text here now"), (None, item), (None, "also clean words"), (3, None)], "doc_id long, text string")
    kept = dc.drop_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == [(2, "clean words in this text here now"), (3, None), (None, "also clean words")]


def test_long_and_repetitive_items(spark):
    """Items of hundreds of words, many of them repeated, within longer texts."""
    rng = random.Random(3)
    few = [f"r{i}" for i in range(4)]
    many = [f"t{i}" for i in range(5000)]
    items = [(1, " ".join(rng.choice(many) for _ in range(700))), (2, " ".join(rng.choice(few) for _ in range(150))), (3, "one two three four five six " * 30)]
    docs = []
    for d in range(24):
        q = items[d % 3][1].split()
        for _ in range(rng.randrange(0, 12)):
            q[rng.randrange(len(q))] = rng.choice(many)
        w = [rng.choice(many if d % 2 else few) for _ in range(rng.randrange(0, 300))]
        at = rng.randrange(len(w) + 1)
        docs.append((d, " ".join(w[:at] + q + w[at:])))
    assert run(spark, docs, items) == brute(docs, items)


def test_counters_hold_long_windows(spark):
    """Windows of more than 65,536 shingles: fingerprints of equal windows are equal."""
    rows = spark.range(70_000).selectExpr("-1L AS h", "1L AS n")
    sums = rows.agg(*[dc.F.sum(c * dc.F.col("n")).alias(n) for c, n in zip(dc.bit_counts(dc.F.col("h")), dc.COUNTERS, strict=True)], dc.F.count("*").alias("m"))
    assert sums.select(dc.majority([dc.F.col(c) for c in dc.COUNTERS], dc.F.col("m")).alias("fp")).first().fp == -1


def test_plan_is_native(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    for df in (dc.find_leaks(docs, items), dc.drop_leaks(docs, items)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExternalRDD"))
