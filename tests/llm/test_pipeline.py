import re

import corpus_pipeline as cp
from terrapath.llm import secret_scan
from terrapath.llm.common import written
from tests.llm.test_chosen_path import brute as near
from tests.llm.test_decontam import brute as leaks


def test_stages_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    state = docs
    for name, stage in cp.STAGES:
        before = [(r.doc_id, r.text) for r in state.select("doc_id", "text").collect()] if "text" in state.columns else None
        state = written(stage(spark, state, d), name)
        after = {r.doc_id for r in state.select("doc_id").collect()}
        if name != "tokens":
            assert state.columns == docs.columns
        if name == "language_id":
            assert after == {x for x, _ in before}  # all are prose in some language
        if name == "near_duplicates":
            assert after == {x for x, c, n in near(before) if n == 0 or c == x}
        if name == "decontamination":
            assert after == {x for x, _ in before} - {x for x, _, _ in leaks(before, items)}
        if name == "secrets":
            assert {(r.doc_id, r.text) for r in state.collect()} == {(x, secret_scan.redact(t)) for x, t in before}
        if name == "tokens":
            assert after == {x for x, _ in before}


def test_names_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in cp.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "tokens"]
    found = entry.queries()
    assert "pipeline" in found and {n.split("_")[0] for n in found if re.match(r"op\d", n)} == {f"op{i}" for i in range(1, 11)}
    assert set(entry.oracle_sql()) <= set(found)
