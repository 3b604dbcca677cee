import random
import re
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from candleforge.llm import common, queries, suffixes
from candleforge.llm.substrings import Windows
from test_python_operators import passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def slow_spans(rows, window=50):
    texts = [(i, WORD.findall(t or "")) for i, t in rows if i is not None]
    first = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min((i, s), first.get(key, (i, s)))
    cover = {}
    for i, w in texts:
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                cover.setdefault(i, set()).update(range(s, s + window))
    out = []
    for i, c in cover.items():
        at = sorted(c)
        start = at[0]
        for a, b in zip(at, [*at[1:], None]):
            if b != a + 1:
                out.append((i, start, a + 1, a + 1 - start))
                start = b
    return sorted(out)


@pytest.mark.parametrize(("group", "together"), [(1 << 16, 1 << 17), (8, 40)])
def test_spans_equal_brute_force(spark, group, together, monkeypatch):
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    rows = passages(250, 9)
    r = random.Random(2)
    base = rows[10][1] + " " + " ".join(f"q{i}" for i in range(120))
    for i in range(60):  # one passage in many surroundings
        rows.append((3000 + i, " ".join(f"z{r.randrange(99)}" for _ in range(r.randrange(40))) + " " + base + " " + " ".join(f"y{r.randrange(99)}" for _ in range(r.randrange(40)))))
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), (5002, rows[3][1]), (5002, rows[3][1]), (6000, "x " * 3000), (6001, "x y " * 300), (6002, base + " " + base)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"seed": F.lit("x"), "id": F.lit(0), "lo": F.lit(1)}).repartition(5)
    got = sorted(tuple(x) for x in suffixes.repeated_spans(df, 50, 22, group).collect())
    assert got == slow_spans(rows)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(x) for x in queries.op3_sparse_suffixes(spark, sf).collect()) == slow_spans(rows)


def test_empty_table(spark):
    assert suffixes.repeated_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_window_holds_a_minimiser_at_the_same_place():
    words = [f"w{i}".encode() for i in np.random.default_rng(0).integers(0, 30, 500)]
    w = Windows([b" ".join(words), b"x y", b"", b" ".join(words[37:300])], 50)
    at = suffixes.minimisers(w)
    one = set(at[at < 500].tolist())
    assert all(any(p in one for p in range(s, s + 26)) for s in range(451))
    other = set((at[at >= 502] - 502 + 37).tolist())
    assert {p for p in one if 37 + 25 <= p <= 300 - 50} <= other
    assert len(one) < 500 / 4


@pytest.mark.parametrize("collapsed", [1, 7, 10000])
def test_collapsing_in_any_portions_equals_brute_force(spark, collapsed, monkeypatch):
    monkeypatch.setattr(suffixes, "COLLAPSED", collapsed)
    r = random.Random(4)
    long = " ".join(f"v{r.randrange(40)}" for _ in range(600))
    rows = [*passages(60, 3), (900, long), (901, long), (902, f"{long} {long} {long}"), (901, long), (903, "x " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert sorted(tuple(x) for x in suffixes.repeated_spans(df, 50, 22).collect()) == slow_spans(rows)


def test_little_is_held_at_once(spark, monkeypatch):
    """Texts come 1024 at once, one Python process finds and collapses suffixes, and few files are written."""
    batch, seen, found = "spark.sql.execution.arrow.maxRecordsPerBatch", [], []
    before, sketch, suffix_rows = spark.conf.get(batch), suffixes.sketch, suffixes.suffix_rows
    monkeypatch.setattr(suffixes, "sketch", lambda *a: seen.append(int(spark.conf.get(batch))) or sketch(*a))
    monkeypatch.setattr(suffixes, "suffix_rows", lambda *a: seen.append(int(spark.conf.get(batch))) or found.append(suffix_rows(*a)) or found[0])
    most = max(common.LEAST_FILES, common.FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    folder = Path(common.shared_folder(spark).removeprefix("file:"))
    text = " ".join(f"w{i}" for i in range(300))
    df = spark.createDataFrame([(i, text) for i in range(40)], "doc_id long, text string").coalesce(1)
    settings = {"spark.sql.shuffle.partitions": str(most + 9), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    usual = {k: spark.conf.get(k) for k in settings}
    old = set(folder.glob("rdd-*"))
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        spans = suffixes.repeated_spans(df, 50, 22)
        written = [len(list(p.glob("part-*"))) for p in folder.glob("rdd-*") if p not in old]
        assert written and max(written) <= most and spans.rdd.getNumPartitions() <= most
        assert sorted(tuple(x) for x in spans.collect()) == [(i, 0, 300, 300) for i in range(1, 40)]
    finally:
        for k, v in usual.items():
            spark.conf.set(k, v)
    assert seen == [common.TEXT_ROWS] * 2 and spark.conf.get(batch) == before
    assert found[0]._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    seeds = [x.seed for x in found[0].collect()]
    once = [s for s in seeds if s is not None]
    assert len(once) == len(set(once)) and len(seeds) == 40 * len(once)  # 39 of 40 equal contexts travel as what they cover
