"""Quality, repeated passages, packing and search against brute force."""

import functools
import hashlib
import json
import random
import re
import zlib
from collections import defaultdict

import hypothesis
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candleforge.llm import common, packing, quality, queries, substrings, topk
from oracle import assert_same, duck

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- portions and checkpoints


def test_texts_are_exchanged_in_small_batches(spark, monkeypatch):
    name, df = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.range(5000).coalesce(1)

    def counted(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    sizes = lambda: [r.n for r in df.mapInArrow(counted, "n long").collect()]
    before = spark.conf.get(name)
    with common.text_batches(spark):
        assert max(sizes()) <= common.TEXT_ROWS and sum(sizes()) == 5000
    assert spark.conf.get(name) == before and max(sizes()) > common.TEXT_ROWS
    seen, docs = [], spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    for operator in (substrings, queries.simhash):
        monkeypatch.setattr(operator, "checkpointed_in_few", lambda d: seen.append(int(spark.conf.get(name))) or common.checkpointed_in_few(d))
    substrings.remove_repeats(docs, 3, 20)
    queries.simhash.simhash_groups(docs)
    assert seen.count(common.TEXT_ROWS) == 3  # stretches, windows, fingerprints


def test_checkpoints_have_few_files(spark):
    most = max(common.LEAST_FILES, common.FILES_PER_CORE * spark.sparkContext.defaultParallelism)
    made = common.checkpointed_in_few(spark.range(3000).repartition(most + 200))
    assert made.rdd.getNumPartitions() == most and sorted(r.id for r in made.collect()) == list(range(3000))
    assert common.checkpointed_in_few(spark.range(9).repartition(3)).rdd.getNumPartitions() == 3


# --- repeated passages


def slow_removal(rows, window):
    owner = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        for s in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[s : s + window])
                owner[key] = min(i, owner.get(key, i))
    out = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for s in range(len(w) - window + 1):
            if i is not None and owner[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        out.append((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out, key=repr)


def passages(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)] + ["é", "ü\x1cx", "A", "a"]
    shared = [[r.choice(vocab) for _ in range(r.choice([49, 50, 51, 80]))] for _ in range(6)]
    rows = []
    for i in range(n):
        words = [r.choice(vocab) for _ in range(r.randrange(0, 160))]
        for _ in range(r.randrange(3)):
            at = r.randrange(len(words) + 1)
            words[at:at] = r.choice(shared)
        if rows and r.random() < 0.1:
            words = WORD.findall(r.choice(rows)[1])
        if r.random() < 0.05:
            words = ["same"] * r.randrange(200)
        rows.append((i * 7 % 1000, r.choice([" ", "\n", " \t "]).join(words)))
    return rows


@pytest.mark.parametrize("cells", [20, 26])
def test_removed_passages_equal_brute_force(spark, cells):
    rows = passages(250, 4)
    rows += [(None, rows[0][1]), (5000, None), (5001, ""), (5002, rows[3][1]), (5002, rows[3][1]), (5002, rows[9][1]), (6000, "x " * 120_000), (6001, "x " * 70)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"h1": F.lit(1), "id": F.lit("x"), "gone": F.lit(0)}).repartition(5)
    got = sorted((tuple(r) for r in substrings.remove_repeats(df, 50, cells).collect()), key=repr)
    assert got == slow_removal(rows, 50)


def test_removal_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, g, hashlib.sha256(t.encode()).hexdigest()) for i, n, g, t in slow_removal(rows, 50)]
    assert sorted((tuple(r) for r in queries.op5_countmin_substrings(spark, SF).collect()), key=repr) == sorted(want, key=repr)


def test_removal_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.remove_repeats(df).count() == 0


def test_marks_are_functions_of_the_window():
    words = [f"w{i}".encode() for i in np.random.default_rng(0).integers(0, 50, 400)]
    w = substrings.Windows([b" ".join(words), b"x", b"", b" ".join(words[37:300])], 50)
    marks = w.marks()
    assert (marks[w.text == 0][37 : 37 + 214] == marks[w.text == 3]).all()
    assert len(marks) == 351 + 214


# --- packing


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


def slow_ids(text):
    return [*library().encode(text or "", add_special_tokens=False).ids, 0]


def check_packing(got, rows, length=2048):
    by = defaultdict(list)
    for r in got:
        by[r.doc_id, r.start == 0].append(r)
    want = defaultdict(int)
    for i, t in rows:
        ids = slow_ids(t)
        for k, at in enumerate(range(0, len(ids), length)):
            part = ids[at : at + length]
            want[i, k, at, len(part), zlib.crc32(np.array(part, dtype="<u4").tobytes())] += 1
    have = defaultdict(int)
    bins = defaultdict(list)
    for r in got:
        have[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert have == want
    for own in bins.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:]))
        assert sum(own[-1]) <= length
    return len(bins)


ODD_TEXTS = [
    "", " ", "Hello  World's  don't 123 ünïcode İΣ ς", "a\x1cb \x1d!\x1e! x", "tab\tnew\nline nbsp\u00a0em\u2003", "e\u0301 \u0301x ﬁ H\u0331 h\u0331", "<|endoftext|> x<|startoftext|>y",
    "<|ENDOFTEXT|> z", "日本語 テスト", "😀👍🏽 x!", "a" * 5000, "!!**### | ||", "it's 'twas dogs' rock'n'roll' we've... ve.'s x'S I'M.", "wait…!! don’t! 12,5% 3.14. ½! ²,", "END. End! \u212aelvin, \u00c5ngström;", "x_y_ _z -- a-b- (c) [d]", "ΑΣ. ΑΣ",
]


def test_tokenizer_equals_the_library():
    t = packing.WordTokenizer(packing.vocabulary_path())
    for _ in range(2):
        assert [x.tolist() for x in t.ids(ODD_TEXTS)] == [slow_ids(x)[:-1] for x in ODD_TEXTS]


@hypothesis.settings(max_examples=300, deadline=None)
@hypothesis.given(st.text(alphabet=st.one_of(st.sampled_from(list("aAbHsStT'’ .,!*|<>_-09\u0301\u0331\x1c\u212aΣİßé…½\n")), st.characters(codec="utf-8")), max_size=40))
def test_tokenizer_equals_the_library_on_any_text(text):
    assert packing.word_tokenizer(packing.vocabulary_path()).ids([text])[0].tolist() == slow_ids(text)[:-1]


def test_full_cache_still_tokenizes(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    t = packing.WordTokenizer(packing.vocabulary_path())
    for text in ("one two three four five", "one six seven five eight", "nine ten"):
        assert t.ids([text])[0].tolist() == slow_ids(text)[:-1]


def test_unknown_words_of_letters_share_a_text():
    t = packing.WordTokenizer(packing.vocabulary_path())
    r, letters = random.Random(5), [chr(c) for c in range(256) if chr(c).isalpha()]
    words = ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(5000)] + letters
    given, encode = [], t._encode
    t._encode = lambda texts: given.extend(texts) or encode(texts)
    assert t.ids([" ".join(words)])[0].tolist() == slow_ids(" ".join(words))[:-1]
    assert not given  # none of them alone
    t._closes[:] = False  # a vocabulary that does not tell where words end
    assert t.ids(["quux corge"])[0].tolist() == slow_ids("quux corge")[:-1] and sorted(given) == ["corge", "quux"]


def test_every_character_before_a_sign():
    """Some end in a mark once the tokenizer has normalised or lowered them, which belongs to the sign that follows."""
    t = packing.word_tokenizer(packing.vocabulary_path())
    points = [chr(c) for c in (*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x30000, 97))]
    for at in range(0, len(points), 4096):
        texts = [f"a{c}!x{c}'s {c}..{c}," for c in points[at : at + 4096]]
        assert [x.tobytes() for x in t.ids(texts)] == t._encode(texts)


def test_unknown_words_ask_only_the_model(tmp_path):
    """What a word of letters costs: no normalizer, no pre-tokenizer, and none at all for a known word before a new sign."""
    t = packing.WordTokenizer(packing.vocabulary_path())
    r, letters = random.Random(6), [chr(c) for c in range(256) if chr(c).isalpha()]
    text = " ".join("".join(r.choices(letters, k=r.randint(1, 9))) + r.choice(["", ",", ".", "..."]) for _ in range(3000))
    whole, given = t.tokenizer, []
    t._encode = lambda texts: given.extend(texts) or [np.array(e.ids, dtype="<u4").tobytes() for e in whole.encode_batch_fast(texts, add_special_tokens=False)]
    t.tokenizer = None
    assert t.ids([text])[0].tolist() == slow_ids(text)[:-1]
    assert sorted(given) == [",", ".", "..."]
    known = len(t.known)
    assert t.ids([text.replace("...", ",")])[0].tolist() == slow_ids(text.replace("...", ","))[:-1] and len(t.known) == known
    other = json.loads(whole.to_str())
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = "[\\p{L}]|[^\\s\\p{L}]+"
    (tmp_path / "other.json").write_text(json.dumps(other))
    t = packing.WordTokenizer(str(tmp_path / "other.json"))  # one letter is one token there
    assert t.ids(["Quux, corge"])[0].tolist() == t.tokenizer.encode("Quux, corge", add_special_tokens=False).ids


def test_packing_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op7_certified_packing(spark, SF).collect()
    bins = check_packing(got, rows)
    assert bins <= packing.lower_bound(np.array([r.length for r in got])) + 1


def test_packing_edge_cases_and_exchange(spark):
    r = random.Random(3)
    rows = [(i, "word " * int(r.paretovariate(0.8) * 5 % 6000)) for i in range(400)] + [(None, None), (None, "x"), (3, "dup dup"), (3, "dup dup"), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"piece": F.lit("x"), "length": F.lit(1)})
    pieces = packing.pieces(df)
    for per in (50, 1 << 16):
        got = packing.pack(pieces, partition_pieces=per).collect()
        bins = check_packing(got, rows)
        assert bins <= packing.lower_bound(np.array([x.length for x in got])) * 1.02 + 2
    proof = packing.certificate(packing.pack(pieces))
    assert proof.bound <= proof.bins <= proof.bound + 1
    assert packing.pack_documents(df.limit(0)).count() == 0
    one = lambda d: sorted(tuple(map(str, x)) for x in packing.pack(packing.pieces(d)).collect())
    assert one(df) == one(df.repartition(9))


def packed_pieces(spark, lengths):
    return spark.createDataFrame([(i, 0, 0, n, i * 7919 % 10**9) for i, n in enumerate(lengths)], packing.PIECE)


def bins_of(rows):
    return len({r.sequence_id for r in rows})


def test_certified_partitions_stay_and_others_exchange(spark):
    """Partitions of halves are certified at once; those with odd lengths have gaps, exchange and need fewer bins."""
    r = random.Random(8)
    lengths = [r.choice((1024, 1024, 683, 683, 682, 700, 690)) for _ in range(2000)]
    pool = packed_pieces(spark, lengths)
    first = {r.doc_id: r for r in packing._packed(pool, 40, 0, 2048).collect()}
    gaps = {r.sequence_id >> 28: r.gap for r in first.values()}
    assert 0 in gaps.values() and max(gaps.values()) > 0
    rest, rounds = packing._exchanged(packing.checkpointed(packing._packed(pool, 40, 0, 2048)), F.col("gap") > 0, 40, 0, 50, 2048)
    rest = {r.doc_id: r for r in rest.collect()}
    assert rest.keys() == first.keys() and rounds > 0
    for i, old in first.items():
        if old.gap == 0 or old.full:
            assert (rest[i].sequence_id, rest[i].offset) == (old.sequence_id, old.offset)
    assert any(rest[i].sequence_id != old.sequence_id for i, old in first.items() if old.gap)
    assert bins_of(rest.values()) < bins_of(first.values())


def test_a_table_that_meets_its_bound_exchanges_nothing(spark):
    pool = packed_pieces(spark, [1024] * 400)
    even = packing._packed(pool, 8, 0, 2048).groupBy("sequence_id").count().where("count = 1").count()
    got = packing.pack(pool, partition_pieces=50).collect()
    assert {r.gap for r in got} == {0}
    assert bins_of(got) == 200
    assert {r.sequence_id >> 52 for r in got} == ({0} if not even else {0, 1})


def test_pieces_without_partners_keep_their_gap_visible(spark):
    """Bounds do not see that these do not fit together, so no exchange can close the gap; it ends, and says so."""
    lengths = [1000, 500, 549] * 300  # three of which never make a whole sequence
    got = packing.pack(packed_pieces(spark, lengths), partition_pieces=100).collect()
    proof = packing.certificate(spark.createDataFrame([(r.sequence_id, r.length) for r in got], "sequence_id long, length long"))
    assert len(got) == 900 and proof.bins == bins_of(got) >= proof.bound
    if proof.bins > proof.bound:
        assert any(r.gap > 0 for r in got)


def test_ids_round_trip(spark):
    df = spark.createDataFrame([(1, "Hello world " * 1500), (2, None)], "doc_id long, text string")
    got = sorted(packing.pieces(df, with_ids=True).collect(), key=lambda r: (r.doc_id, r.piece))
    ids = [np.frombuffer(r.ids, dtype="<u4").tolist() for r in got]
    assert sum(ids[:-1], []) == slow_ids("Hello world " * 1500) and ids[-1] == [0]


def test_lower_bound_is_a_bound():
    rng = np.random.default_rng(5)
    for _ in range(60):
        x = rng.integers(1, 40, rng.integers(1, 9))
        best = optimum(sorted(x.tolist(), reverse=True), 40)
        assert packing.lower_bound(x, 40) <= best
    assert packing.lower_bound(np.array([21] * 7), 40) == 7
    assert packing.lower_bound(np.array([14] * 5), 40) == 3
    assert packing.lower_bound(np.zeros(0), 40) == 0


def optimum(sizes, capacity):
    best = len(sizes)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + sizes[i] <= capacity:
                place(i + 1, bins[:j] + [bins[j] + sizes[i]] + bins[j + 1 :])
        place(i + 1, [*bins, sizes[i]])

    place(0, [])
    return best


# --- quality


def test_quality_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = queries.op4_latent_voting(spark, sf).collect()
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(labels[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    bad = [b for a, b in held if a == 0]
    assert sum(b == 0 for b in bad) / len(bad) > 0.9


def test_quality_never_learns_from_held_out_labels(spark):
    ids = list(range(300))
    docs = spark.createDataFrame([(i, f"text {i} word" * (i % 7)) for i in ids], "doc_id long, text string")
    rows = [(i, i % 2, 0) for i in ids]
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in rows]
    out = [sorted(tuple(r) for r in quality.classify(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (rows, flipped)]
    assert out[0] == out[1]


def test_quality_edge_cases(spark):
    rows = [(1, None), (2, ""), (None, "Some text."), (3, "a " * 800_000), (3, "ok then"), (4, "!!" * 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"score": F.lit("x"), "quality": F.lit(5), "label": F.lit(0)})
    labels = spark.createDataFrame([(1, 1), (2, None), (None, 0), (3, 0), (3, 1), (99, 0), (4, 0)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 6 and all(0 <= r.score <= 1 for r in got)
    assert [r.held_out for r in got if r.doc_id is None] == [True]
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.classify(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).count() == 6
    assert quality.keep_good(docs, labels).columns == docs.columns


# --- search


def slow_search(rows, k=10):
    ok = [(i, [int(np.floor(1024 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in {i: v for i, v in ok if i % 100 == 0}.items():
        s = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q)[:k]
        out += [(q, r + 1, i, -n) for r, (n, i) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize(("blocks", "spread"), [((8192, 1024), 1.0), ((40, 2), 1.0), ((64, 3), 3e5), ((64, 3), 0.002)])
def test_search_equals_brute_force(spark, blocks, spread):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in (rng.normal(size=16) * spread).astype(np.float32)]) for i in range(450)]
    rows += [(1000 + i, rows[i % 5][1]) for i in range(60)] + [(None, rows[0][1]), (2000, None), (2001, [None] * 16), (2002, [float("nan")] * 16), (2003, [float("inf")] + [0.0] * 15), (2100, [0.0] * 16), (2101, [1.0]), (2101, [1.0])]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType()))])
    df = spark.createDataFrame(rows, schema).withColumns({"s": F.lit("x"), "v": F.lit(1), "id": F.lit(2)})
    got = topk.search(df, row_block=blocks[0], query_block=blocks[1]).collect()
    assert sorted(tuple(r) for r in got) == slow_search(rows)


def test_search_query_equals_sql(spark):
    assert_same(queries.op10_maxscore(spark, SF), duck(SF), queries.oracle_sql()["op10_maxscore"])


def test_search_of_little(spark):
    schema = "vec_id long, embedding array<float>"
    assert topk.search(spark.createDataFrame([], schema)).count() == 0
    two = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in topk.search(two).collect()] == [(0, 1, 1, 1024 * 2048)]


def test_huge_scores_saturate(spark):
    df = spark.createDataFrame([(0, [1e38, 0.0]), (1, [1e38, 1.0]), (2, [-1e38, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.vec_id, r.score) for r in topk.search(df).collect()]
    assert sorted(got) == [(1, 2**63 - 1), (2, -(2**63)), (3, 0)]


def test_maxscore_skips_work_but_not_rows():
    rng = np.random.default_rng(2)
    rows = rng.integers(-500, 500, (3000, 64)).astype(float)
    ids = rng.permutation(3000)
    for _ in range(20):
        q = rng.integers(-500, 500, 64) * (rng.random(64) < 0.5)
        s = rows @ q
        want = np.lexsort((ids, -s))[:10]
        got = topk.maxscore(rows, ids, q.astype(float), -1)
        assert got[0].tolist() == ids[want].tolist() and got[1].tolist() == s[want].tolist()


def test_quality_votes_equal_brute_force(spark):
    """Every score of the query from the model by plain loops; tied voters all count, whatever their order."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 100_000))  # every text twice, so labelled vectors tie
    labels = labels.unionByName(labels.withColumns({"doc_id": F.col("doc_id") + 100_000, "quality": 1 - F.col("quality")}))
    model = quality.fitted(docs, labels)
    got = {r.doc_id: r.score for r in quality.classify(docs.repartition(5), labels).collect()}
    usable = [r for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 3 != 1]
    text = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert len(model.labels) == len([r for r in usable if r.doc_id in text])
    assert len(model.labels) > 60
    assert model.prior == pytest.approx(np.mean([r.quality for r in usable if r.doc_id in text]))
    for doc_id, t in text.items():
        z = model.latent(quality.features([t]))[0].astype(float)
        cosine = [round(sum(a * b for a, b in zip(z, v.astype(float).tolist())), 5) for v in model.vectors]
        least = sorted(cosine, reverse=True)[min(len(cosine), quality.VOTERS) - 1]
        voters = [(max(c, 0.0) ** 8, label) for c, label in zip(cosine, model.labels.tolist()) if c >= least]
        total = sum(w for w, _ in voters)
        want = sum(w * label for w, label in voters) / total if total and any(z) else model.prior
        assert got[doc_id] == pytest.approx(want, abs=0.02)
    other = quality.fitted(docs.repartition(9), labels.repartition(3))
    assert np.allclose(other.vectors, model.vectors, atol=1e-4) and (other.labels == model.labels).all()


def test_quality_space_is_that_of_the_decomposition():
    rng = np.random.default_rng(2)
    counts = rng.poisson(rng.random((60, 1)) * rng.random((1, quality.TERMS))).astype(np.float32)
    model = quality.fit(counts, np.ones(60), dimensions=8)
    x = quality._weighted(counts, model.idf)
    values = np.linalg.svd(x, compute_uv=False)
    got = np.linalg.norm(x @ model.projection, axis=0)
    assert np.allclose(got, values[:8], rtol=0.02)
    assert np.allclose(model.projection.T @ model.projection, np.eye(8), atol=1e-4)


def test_quality_knows_words():
    """Texts of one shape that differ in their words only."""
    r = random.Random(3)
    good, bad = ["maple", "river", "stone", "cloud"], ["spamy", "clicx", "cheap", "winnn"]
    texts = [" ".join(r.choice(v) for _ in range(40)).encode() for v in [good, bad] * 40]
    model = quality.fit(quality.features(texts), np.array([1, 0] * 40))
    other = [" ".join(r.choice(v) for _ in range(30)).encode() for v in (good, bad)]
    one, two = model.scores(quality.features(other))
    assert one > 0.9 and two < 0.1
