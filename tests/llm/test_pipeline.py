"""The pipeline, stage by stage, against brute force."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import pytest

from candleforge.llm import mixing, quality
from test_native_operators import slow_spans, slow_targets
from test_python_operators import check_packing
from test_simhash import slow_similar

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """The input and every stage's result, written and read again as the pipeline does."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(corpus_pipeline.written(stage(spark, out[-1], SF), name))
    return out


def pairs(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "pack"]
    for x in stages[1:-1]:
        assert x.columns == stages[0].columns


def test_quality_stage(spark, stages):
    verdict = quality.classify(stages[0], spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1")
    assert sorted(r.doc_id for r in stages[1].collect()) == sorted(r.doc_id for r in verdict.collect())
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in stages[1].collect()}
    assert len(good & kept) >= 0.95 * len(good)


def test_duplicate_stage(stages):
    want = sorted({c for _, _, c in slow_similar(pairs(stages[1]))})
    assert sorted(r.doc_id for r in stages[2].collect()) == want


def slow_redaction(text):
    spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in slow_spans(text).split(",") if s))
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += text[at:a] + "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_secret_stage(stages):
    want = sorted((i, slow_redaction(t)) for i, t in pairs(stages[2]))
    assert sorted(pairs(stages[3])) == want
    assert all(r.n_chars == len(r.text) for r in stages[3].collect() if "[SECRET]" in r.text)


def test_mix_stage(stages):
    size, own, text = Counter(), {}, {}
    for r in stages[3].collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        size[r.source] += n
        own[r.doc_id], text[r.doc_id] = n, r
    want, taken, biggest = slow_targets(size), Counter(), Counter()
    copies = Counter()
    for r in stages[4].collect():
        assert r == text[r.doc_id]
        copies[r.doc_id] += 1
        taken[r.source] += own[r.doc_id]
        biggest[r.source] = max(biggest[r.source], own[r.doc_id])
    assert max(copies.values()) <= 2
    for s, t in want.items():
        assert abs(taken[s] - t) <= max(own.values()) + 1e-5 * t
    plan = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect()}
    assert {k: v for k, v in plan.items() if v} == dict(copies)


def test_pack_stage(stages):
    check_packing(stages[5].collect(), pairs(stages[4]))


def test_run_equals_its_stages(spark, stages):
    key = lambda df: sorted(tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(stages[5])


def test_odd_rows_pass_every_stage(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None), (1, "", "en", "a", 0), (2, "Good text here. " * 30, None, None, None), (2, "Good text here. " * 30, "en", "a", 1), (3, "x password=hunter2222 " * 4, "en", "b", 5), (4, "w " * 60_000, "en", "b", 5)]
    for data in (rows, []):
        df = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.written(stage(spark, df, SF), "odd")
        sums = defaultdict(int)
        for r in df.collect():
            sums[r.sequence_id] += r.length
        assert all(n <= 2048 for n in sums.values())
        assert bool(sums) == bool(data)
