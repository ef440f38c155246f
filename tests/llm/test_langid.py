import math
import sys
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
import regex

from terrapath.llm import langid
from terrapath.llm.queries import QUERIES


def test_words_first_then_shorter_grams():
    m = langid.Model(["a", "b"], {"known": [-1.0, -9.0]}, {"xyz": [-2.0, -3.0], "q": [-5.0, -4.0], " n": [-1.0, -1.0]}, n_max=3)
    assert m.evidence("known") == [-1.0, -9.0]
    assert m.evidence("xyzq") == [-2.0, -3.0]  # its three-letter gram, not the letter q
    assert m.evidence("q") == [-5.0, -4.0]
    assert m.evidence("w") is None
    s = langid.Scorer(m)
    assert s.predict("Known")[0] == "a"
    assert s.predict("q q q")[0] == "b"
    assert s.predict("w") == ("a", 0.5)
    assert [s.predict(t) for t in (None, "", "123 !?", "\n", "½ ² Ⅷ ① _")] == [("und", 0.0)] * 5


def test_score_equals_plain_sum():
    m = langid.Model(["a", "b"], {"x": [-1.0, -1.001], "y": [-3.0, -3.002]}, {})
    text = "x y x, X! y z " * 50
    s = langid.Scorer(m)
    s.CACHE = 1
    total = [150 * -1.0 + 100 * -3.0, 150 * -1.001 + 100 * -3.002]
    lang, score = s.predict(text)
    assert lang == ("a" if total[0] > total[1] else "b") and 0.5 < score <= 1


def test_nulls_ties_and_other_columns(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "le chat et le chien", "fr"), (3, "the end", None), (3, "the end", None), (None, None, "en"), (5, "", "fr"), (6, "42", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 as lang_pred", "'s' as score")
    m = langid.train(df, min_count=1)
    assert m.langs == ["en", "fr"]
    got = sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(df, m).collect())
    assert got == sorted([("1", "en"), ("2", "fr"), ("3", "en"), ("3", "en"), ("None", "und"), ("5", "und"), ("6", "und")])
    kept = langid.keep_identified(df, m)
    assert kept.columns == df.columns and kept.dtypes == df.dtypes
    assert sorted((r.doc_id, r.lang, r.lang_pred, r.score) for r in kept.collect()) == [(1, "en", 1, "s"), (2, "fr", 1, "s"), (3, "en", 1, "s"), (3, "en", 1, "s")]
    assert langid.predict(df.limit(0), m).count() == 0
    empty = langid.train(df.limit(0))
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}


def test_long_text_in_parts(monkeypatch):
    m = langid.Model(["a", "b"], {"x": [-1.0, -2.0]}, {})
    whole = langid.Scorer(m).predict("x " * 999)
    monkeypatch.setattr(langid, "AT_ONCE", 7)
    assert langid.Scorer(m).predict("x " * 999) == pytest.approx(whole)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang").collect()}
    got = [r for r in QUERIES["op1_language_id"](spark, d).collect()]
    assert len(got) == len(truth) and all(0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in out) / len(out) > 0.97


def test_letters_are_category_l():
    every = [chr(i) for i in range(sys.maxunicode + 1)]
    assert [c for c in every if langid.letters(langid.WORD.findall(c))] == [c for c in every if unicodedata.category(c)[0] == "L"]


def kept(counts, most, least=2):
    """The entries down to the least count at which they are at most `most`."""
    ok = {g: c for g, c in counts.items() if c >= least}
    cut = min((c for c in set(ok.values()) if sum(x >= c for x in ok.values()) <= most), default=math.inf)
    return {g: c for g, c in ok.items() if c >= cut}


def test_query_against_brute_force(spark, monkeypatch):
    """The whole query in plain Python: counts, backing off, sums and softmax."""
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for r in docs:
        if r.lang is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            words[r.lang].update(regex.findall(r"\p{L}+", (r.text or "").lower()))
    langs = sorted(words)
    for x in langs:
        for w, c in words[x].items():
            p = f" {w} "
            for n in range(1, 5):
                for i in range(len(p) - n + 1):
                    grams[x, n][p[i : i + n]] += c
    known = {x: kept(words[x], 20_000) for x in langs}
    cut = {k: kept(c, 5000) for k, c in grams.items()}

    def logs(g, of, total):
        return [math.log((of(x).get(g) or 0.5) / total(x)) for x in langs]

    def evidence(w):
        if any(w in known[x] for x in langs):
            return logs(w, known.get, lambda x: sum(words[x].values()))
        p = f" {w} "
        for n in range(4, 0, -1):
            found = [p[i : i + n] for i in range(len(p) - n + 1) if any(p[i : i + n] in cut[x, n] for x in langs)]
            if found:
                rows = [logs(g, lambda x, n=n: cut[x, n], lambda x, n=n: sum(grams[x, n].values())) for g in found]
                return [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        return None

    seen = {}
    got = {r.doc_id: r for r in QUERIES["op1_language_id"](spark, d).collect()}
    assert len(got) == len(docs)
    for r in docs:
        found = regex.findall(r"\p{L}+", (r.text or "").lower())
        total, any_known = [0.0] * len(langs), False
        for w, c in Counter(found).items():
            e = seen.setdefault(w, evidence(w)) if w not in seen else seen[w]
            if e is not None:
                any_known = True
                total = [t + c * x for t, x in zip(total, e, strict=True)]
        one = got[r.doc_id]
        assert one.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        if not found:
            assert (one.lang_pred, one.score) == ("und", 0.0)
            continue
        assert any_known
        p = [math.exp(t - max(total)) for t in total]
        assert one.lang_pred == langs[p.index(1.0)] and one.score == pytest.approx(1 / sum(p), abs=1e-6)
