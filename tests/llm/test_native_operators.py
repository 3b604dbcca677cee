"""Sharding, mixing and secret scans: all DataFrame expressions."""

import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from candleforge.llm import mixing, queries, secrets, sharding
from oracle import assert_same, duck

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

TRICKY = [
    "", None, "no secrets", "password=hunter22 and TOKEN : 'abc.def-ghi'", "secret=short", "secret=token:abcdef password: x", "api_key=\"ABCDEFGH\" apikey:12345678",
    "AKIA" + "A" * 15, "AKIA" + "Z9" * 8, "xAKIAAKIA" + "B" * 14 + "-AKIAQ", "deadbeef" * 3, "deadbeef" * 2, "Deadbeef" * 4, "é" * 5 + "a1" * 20 + "😀 token=äbc token='a=b/c+d.e_f-g'",
    "password=password=password", "token=AKIA" + "C" * 20 + " x " + "0" * 24, "PassWord\n=nope", "password   =   'spaced1'", "ſecret=abcdefgh", "secret=" + "f" * 50_000, "token=abcdef " * 3000,
]


def slow_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24),
        ]
    ):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return ",".join(s for _, _, s in sorted(out))


def test_secret_spans_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(None, "password=hunter22"), (3, TRICKY[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"blob": F.lit(1), "spans": F.lit("x"), "kind": F.lit(2)})
    found = secrets.document_findings(df)
    got = [(r.doc_id, r.s, r.n_assign, r.n_access, r.n_hex) for r in found.withColumn("s", secrets.span_text(F.col("spans"))).collect()]
    want = []
    for i, t in rows:
        s = slow_spans(t)
        n = Counter(x.split(":")[0] for x in s.split(",") if x)
        want.append((i, s, n["assign"], n["access"], n["hex"]))
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert secrets.document_findings(df.limit(0)).count() == 0


def test_secret_query_equals_sql(spark):
    assert_same(queries.queries()["op9_blob_ledger"](spark, SF), duck(SF), queries.oracle_sql()["op9_blob_ledger"])


def test_secret_plan_is_native(spark):
    plan = queries.op9_blob_ledger(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_ledger_scans_only_unseen_pairs(spark, tmp_path):
    ledger = secrets.BlobLedger(spark, str(tmp_path / "ledger"))
    assert ledger.read().count() == 0
    first = spark.createDataFrame([("a", "password=hunter22"), ("b", "clean"), ("c", "password=hunter22")], "path string, text string")
    assert ledger.update(first).count() == 2
    second = first.unionByName(spark.createDataFrame([("d", "token=abcdefg"), ("e", None)], first.schema))
    fresh, texts = secrets.unseen_blobs(second.withColumn("blob", secrets.blob_of(F.col("text"))).na.fill(""), ledger.read())
    assert fresh.count() == texts.count() == 2
    assert {r.text for r in texts.select("text").collect()} == {"token=abcdefg", ""}
    assert ledger.update(second).count() == 2
    assert ledger.update(second).count() == 0
    assert ledger.update(second, "base-2").count() == 4
    assert ledger.read().count() == 8
    by_id = second.withColumn("doc_id", F.monotonically_increasing_id())
    assert sum(r.n_assign for r in secrets.document_findings(by_id, ledger).collect()) == 3
    third = spark.createDataFrame([(1, "password=hunter22"), (2, "secret=abcdefgh"), (3, "clean")], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_assign) for r in secrets.document_findings(third, ledger).collect()) == [(1, 1), (2, 1), (3, 0)]
    assert ledger.read().count() == 9
    # a batch that was appended twice, as by two runs at once, changes nothing
    ledger.read().write.mode("append").partitionBy("rule_version").parquet(ledger.path)
    assert ledger.read().count() == 9
    assert sorted((r.doc_id, r.n_assign) for r in secrets.document_findings(third, ledger).collect()) == [(1, 1), (2, 1), (3, 0)]


@pytest.mark.parametrize("most", [0, 16 << 20])
def test_findings_with_and_without_broadcasts(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(secrets, "BROADCAST_BYTES", most)
    rows = [(i, t) for i, t in enumerate(TRICKY)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string")
    ledger = secrets.BlobLedger(spark, str(tmp_path / "ledger"))
    ledger.update(df.limit(7))
    got = secrets.document_findings(df, ledger).withColumn("s", secrets.span_text(F.col("spans")))
    assert sorted((r.doc_id, r.s) for r in got.collect()) == sorted((i, slow_spans(t)) for i, t in rows)


def test_second_run_of_the_query_scans_nothing(spark):
    key = lambda df: sorted(map(str, df.collect()))
    first = key(queries.op9_blob_ledger(spark, SF))
    ledger = secrets.BlobLedger.shared(spark)
    held = ledger.read().count()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert secrets.scan(docs, ledger.read()).count() == 0
    assert key(queries.op9_blob_ledger(spark, SF)) == first
    assert ledger.read().count() == held >= docs.select("text").distinct().count()


def test_redaction_with_clashing_names(spark, tmp_path):
    names = ["doc_id", "text", "_spans", "_blob", "blob", "spans", "row", "found", "a.b"]
    df = spark.createDataFrame([(1, "x password=hunter22 y", "s", "b", "c", "d", 5, 6, 7), (2, None, None, None, None, None, None, None, None)], "doc_id long, text string, _spans string, _blob string, blob string, spans string, row int, found int, `a.b` int")
    out = secrets.redact(df, ledger=secrets.BlobLedger(spark, str(tmp_path / "ledger")))
    assert out.columns == names
    assert sorted(map(tuple, out.collect())) == [(1, "x [SECRET] y", "s", "b", "c", "d", 5, 6, 7), (2, None, None, None, None, None, None, None, None)]
    assert secrets.redact(df.limit(0)).count() == 0


def test_redaction(spark):
    rows = [(1, "x password=hunter22 y", "en", "s", 21), (2, "clean", "en", "s", 5), (3, None, None, None, None), (4, "token=AKIA" + "C" * 20 + " ü " + "0" * 24, "en", "s", 50), (4, "clean", "en", "s", 5)]
    df = spark.createDataFrame(rows, DOCS).withColumn("_x", F.lit(1))
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())
    assert [g for g in got if g[0] != 3] == [(1, "x [SECRET] y", 12), (2, "clean", 5), (4, "[SECRET] ü [SECRET]", 19), (4, "clean", 5)]
    assert out.where("doc_id = 3 and text is null and n_chars is null").count() == 1


def documents(spark, n=3000, seed=2):
    r = random.Random(seed)
    rows = [(r.randrange(n), " ".join("wörd" for _ in range(int(r.paretovariate(0.9)) % 2000)), "en", r.choice(["a", "b", "hot", "hot", "hot", None, "B", "é"]), 0) for _ in range(n)]
    return rows + [(None, None, None, None, None), (7, None, "en", "a", 0), (7, None, "en", "a", 0), (1, "x " * 50_000, "en", "big", 0)]


def test_shards(spark):
    rows = documents(spark)
    df = spark.createDataFrame(rows, DOCS).withColumns({"shard": F.lit("x"), "rank": F.lit(0), "virtual_slot": F.lit(1)})
    out, slot_map = sharding.shard(df, 40)
    got = out.collect()
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    places = defaultdict(list)
    loads = Counter()
    for r in got:
        places[r.shard].append(r.slot)
        loads[r.shard] += r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert set(places) == set(range(40))
    assert max(loads.values()) <= max(max(r.size for r in got), sum(loads.values()) / 40 * 1.02)
    again, _ = sharding.shard(df.repartition(7), 40)
    key = lambda rs: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in rs)
    assert key(again.collect()) == key(got)
    empty, m = sharding.shard(df.limit(0))
    assert empty.count() == 0 and m.shards == 40
    one_group, _ = sharding.shard(spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("same").alias("text")))
    assert one_group.select("shard").distinct().count() == 40


def test_slot_maps_are_versioned_and_move_little(spark, tmp_path):
    r = random.Random(1)
    size = {s: r.randrange(1, 1000) for s in range(sharding.SLOTS)}
    m = sharding.SlotMap.balanced(size)
    mean = sum(size.values()) / 40
    assert max(m.loads(size)) - min(m.loads(size)) < 1000
    grown = m.rebalanced(size, 41)
    moved = [s for s in size if m.shard_of[s] != grown.shard_of[s]]
    assert grown.version == 2 and all(grown.shard_of[s] == 40 for s in moved)
    assert max(grown.loads(size)) <= sum(size.values()) / 41 * 1.011
    assert len(moved) < sharding.SLOTS / 41 * 1.3
    shrunk = m.rebalanced(size, 39)
    assert max(shrunk.shard_of) == 38 and max(shrunk.loads(size)) < mean * 40 / 39 * 1.011
    assert m.rebalanced(size).shard_of == m.shard_of
    path = str(tmp_path / "maps")
    for x in (m, grown):
        x.save(spark, path)
    assert sharding.SlotMap.load(spark, path) == grown
    assert sharding.SlotMap.load(spark, path, 1) == m


def test_maps_are_stored_read_back_and_edited(spark, tmp_path):
    path = str(tmp_path / "maps")
    df = spark.createDataFrame(documents(spark), DOCS)
    key = lambda rows: sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.slot) for r in rows.collect())
    rows, first = sharding.shard(df, store=path)
    again, same = sharding.shard(df.repartition(3), store=path)
    assert (first.version, same) == (1, first) and key(rows) == key(again)
    more = df.unionByName(spark.createDataFrame([(10**6 + i, "much more text " * 400, "en", "a", 0) for i in range(300)], DOCS))
    grown, second = sharding.shard(more, store=path)
    assert second.version == 2 and sharding.SlotMap.load(spark, path) == second and sharding.SlotMap.load(spark, path, 1) == first
    loads = Counter()
    for r in grown.collect():
        loads[r.shard] += r.size
    assert max(loads.values()) <= max(10**5 + 16, sum(loads.values()) / 40 * 1.02)
    kept = sum(a == b for a, b in zip(first.shard_of, second.shard_of))
    assert kept > sharding.SLOTS / 2
    _, wider = sharding.shard(more, 41, store=path)
    assert (wider.version, wider.shards) == (3, 41)
    _, other = sharding.shard(more, slots=64, store=path)
    assert (other.version, len(other.shard_of)) == (4, 64)


def test_rows_without_an_id_are_dealt_by_their_text(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"))
    rows, _ = sharding.shard(df)
    assert rows.groupBy("virtual_slot").count().agg(F.max("count")).first()[0] < 20


def slow_targets(size):
    names = sorted((s for s in size if s is not None)) + [s for s in size if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(size.values()) * 1.5
    while True:
        free = [s for s in names if s not in capped]
        unit = (total - sum(2 * size[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * unit > 2 * size[s]}
        if not above:
            return {s: 2.0 * size[s] if s in capped else weight[s] * unit for s in names}
        capped |= above


def test_mix(spark):
    rows = documents(spark)
    df = spark.createDataFrame(rows, DOCS).withColumns({"size": F.lit("x"), "sid": F.lit(0), "target": F.lit(1)})
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = slow_targets(size)
    assert len({s for s in want if abs(want[s] - 2 * size[s]) < 1e-6}) >= 1
    taken, biggest = Counter(), Counter()
    for r in got:
        assert (r.taken, r.source_size) == (r.copies * r.size, size[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
        biggest[r.source] = max(biggest[r.source], r.size)
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1e-5 * t + 2 * biggest[s], s
    assert Counter(r.size for r in got) == Counter(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, *_ in rows)
    again = mixing.mix(df.repartition(5)).collect()
    key = lambda rs: sorted((str(r.doc_id), r.size, r.taken, str(r.source)) for r in rs)
    assert key(again) == key(got)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], DOCS)
    assert mixing.mix(df).count() == 0
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, "  ", "en", None, 0)], DOCS)
    assert sorted((r.doc_id, r.taken) for r in mixing.mix(blank).collect()) == [(1, 0), (2, 0)]
