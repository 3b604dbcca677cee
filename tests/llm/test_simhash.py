import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from candleforge.llm import common, simhash
from candleforge.llm.components import components


def slow_fingerprint(text, shingle=4):
    import re

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64(g.encode(), 42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_wide(text):
    """256 bits: the majority over distinct five-word shingles, derived from the hashes by plain integers."""
    import re

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor % 2**64
        return x ^ x >> 33

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    hashes = {xxhash.xxh64(" ".join(words[i : i + 5]).encode(), 42).intdigest() for i in range(max(1, len(words) - 4))}
    out = 0
    for w in range(4):
        own = [mixed((h + 0x9E3779B97F4A7C15 * (w + 1)) % 2**64) for h in hashes]
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in own) > len(own)) << 64 * w
    return out


def slow_linked(x, y):
    """Wide fingerprints in at most 55 different bits, with one segment decoded alike and a codeword near both next ones."""
    if bin(x ^ y).count("1") > 55:
        return False
    decoding, within = simhash.golay()
    own, other = ([f >> 16 * i & 0xFFFF for i in range(16)] for f in (x, y))
    for i in range(16):
        j = (i + 1) % 16
        if decoding[own[i]] == decoding[other[i]] and {*within[own[j]].tolist()} & {*within[other[j]].tolist()} - {-1}:
            return True
    return False


def slow_shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def jaccard(x, y):
    return len(x & y) / max(1, len(x | y))


def slow_similar(rows):
    """Fingerprints that meet, and texts of an exact similarity of 0.8 or more; equal fingerprints are linked."""
    wide, sets = [slow_wide(t) for _, t in rows], [slow_shingles(t) for _, t in rows]
    every = list(zip(wide, sets))
    linked = grouped(rows, every, lambda x, y: x[0] == y[0] or (jaccard(x[1], y[1]) >= 0.8 and slow_linked(x[0], y[0])))
    return sorted(((d, f, c) for d, (f, _), c in linked), key=repr)


def slow_groups(rows, bits=4, shingle=4):
    return grouped(rows, [slow_fingerprint(t, shingle) for _, t in rows], lambda x, y: bin(x ^ y).count("1") <= bits)


def grouped(rows, fps, linked):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if linked(fps[i], fps[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, fps[i], least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def texts(n, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(500)] + ["Über", "ÀÉ", "naïve"]
    out = []
    for _ in range(n):
        if out and r.random() < 0.5:
            words = r.choice(out).split()
            for _ in range(r.randint(0, 3)):
                if words:
                    words[r.randrange(len(words))] = r.choice(vocab)
            out.append(" ".join(words))
        else:
            out.append(" ".join(r.choice(vocab) for _ in range(r.choice([0, 1, 3, 4, 5, 60, 150]))))
    return out


@pytest.mark.parametrize("text", ["", "  \t\n", "One", "a b c", "A b C d", "é É ss \x0b x\x0cy z\x1cq", "a " * 500, "x" * 100_000, " ".join(map(str, range(70_000)))])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_every_error_pattern_of_four_bits_shares_a_key():
    rng = np.random.default_rng(1)
    for _ in range(4000):
        x = rng.integers(-(2**63), 2**63 - 1, dtype=np.int64)
        flips = rng.choice(64, size=rng.integers(1, 5), replace=False)
        y = np.int64(np.uint64(x) ^ np.bitwise_or.reduce([np.uint64(1) << np.uint64(b) for b in flips]))
        one, _ = simhash.keys_of(np.array([[x]]))
        other, _ = simhash.keys_of(np.array([[y]]))
        assert set(one.tolist()) & set(other.tolist())


def test_golay_tables_are_those_of_the_perfect_code():
    decoding, within = simhash.golay()
    counts = (within >= 0).sum(1)
    assert set(counts) == {1, 6}
    assert (within[:, 0] == decoding).all()


def test_groups_equal_brute_force(spark):
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts(260, 5))] + [(None, "a b c d e"), (2000, None), (2001, ""), (7000, "a b c d e"), (7000, "a b c d e"), (None, "only here once")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"k": F.lit(1), "fp": F.lit("x"), "component_id": F.lit(0)})
    got = [(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash.simhash_groups(df).collect()]
    assert sorted(got, key=repr) == slow_groups(rows)


@pytest.mark.parametrize(("block", "cell"), [(16, 8), (64, 512), (2048, 512)])
def test_hot_keys_are_split_without_losing_links(spark, block, cell):
    """Groups within 4 bits of each other, and one at 5 bits of a member only, whose members share most keys."""
    base = 0x1234_5678_9ABC_DEF0
    far = base ^ 0b11111_00000
    fps = sorted({base ^ (1 << a) ^ (1 << b) for a in range(40, 64) for b in range(40, 64)} | {far ^ (1 << a) for a in range(20, 30)} | {base ^ 0b111111 << 30})
    df = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long").repartition(3)
    names = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    near = [(u, v) for i, u in enumerate(names) for j, v in enumerate(names[:i]) if bin(fps[i] ^ fps[j]).count("1") <= 4]
    want = dict(zip(*(x.tolist() for x in common.forest(*(np.array(x) for x in zip(*near))))))
    got = {r.node: r.root for r in simhash.linked(df, 4, block, cell).collect()}
    assert {k: r for k, r in got.items() if k != r} == want
    assert len(set(want.values())) > 1
    found, split = simhash.links(df, 4, block)
    assert found.count() <= 2 * 70 * len(fps)
    assert (split.count() > 0) == (block < 2048)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.simhash_groups(df).count() == 0
    assert simhash.drop_near_copies(df).count() == 0
    with pytest.raises(ValueError, match="bits"):
        simhash.links(df.select(F.col("doc_id").alias("fp")), 5)
    assert simhash.linked(df.select(F.col("doc_id").alias("fp"))).count() == 0


def test_drop_near_copies_keeps_the_least(spark):
    rows = [(5, "a b c d e f", 1), (3, "A B c d e f", 2), (3, "a b c d e f", 3), (9, "quite another text here now", 4), (None, "a b c d e f", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    out = simhash.drop_near_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id is None, r.doc_id) for r in out.collect()) == [(False, 3), (False, 9), (True, None)]


def random_pairs(similarity, n=20_000, seed=8):
    """Wide fingerprints whose bits differ with the odds of two sets of that similarity."""
    rng = np.random.default_rng(seed)
    odds = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    x = rng.integers(-(2**63), 2**63 - 1, (n, 4), dtype=np.int64)
    flips = np.packbits(rng.random((n, 256)) < odds, axis=1).view(np.int64)
    return x, x ^ flips


def met(x, y):
    """Whether the fingerprints x[i] and y[i] share a key."""
    (k, i), (m, j) = simhash.keys_of(x), simhash.keys_of(y)
    shared = set(zip(k.tolist(), i.tolist())) & set(zip(m.tolist(), j.tolist()))
    out = np.zeros(len(x), dtype=bool)
    out[[i for _, i in shared]] = True
    return out


@pytest.mark.parametrize(("similarity", "least"), [(0.8, 0.93), (0.85, 0.97), (0.9, 0.99), (0.95, 0.999)])
def test_copies_share_a_wide_key(similarity, least):
    assert met(*random_pairs(similarity)).mean() >= least


def edited(r, n, low, high):
    """A random text of n words and an edited one whose similarity lies between low and high."""
    while True:
        own = [f"w{r.randrange(10**6)}" for _ in range(n)]
        copy = own.copy()
        for _ in range(max(1, round(n * (1 - (low + high) / 2) * r.uniform(0.08, 0.25)))):
            at = r.randrange(len(copy))
            copy[at : at + r.choice((0, 1, 1, 2))] = [f"x{r.randrange(10**6)}" for _ in range(r.choice((0, 1, 1, 3)))]
        if low <= jaccard(slow_shingles(" ".join(own)), slow_shingles(" ".join(copy))) <= high:
            return " ".join(own), " ".join(copy)


@pytest.mark.parametrize(("low", "high", "least"), [(0.8, 0.83, 0.92), (0.83, 0.87, 0.96), (0.88, 0.92, 0.985)])
def test_recall_on_edited_texts(low, high, least):
    """Share of pairs that meet and are candidates, over texts beyond the length that is joined exactly."""
    r = random.Random(5)
    pairs = [edited(r, r.randrange(60, 400), low, high) for _ in range(800)]
    x, y = (np.array([simhash.wide_fingerprint(p[i].encode(), 5) for p in pairs]).view(np.int64) for i in (0, 1))
    near = np.bitwise_count((x ^ y).view(np.uint64)).sum(1) <= simhash.most_bits(0.8)
    assert (met(x, y) & near).mean() >= least


def test_most_bits_follows_the_similarity():
    assert [simhash.most_bits(s) for s in (1.0, 0.9, 0.8)] == [0, 41, 55]


@pytest.mark.parametrize("bits", [0, 45, 58, 200])
def test_least_spanning_forests(bits):
    rng = np.random.default_rng(11)
    fps = rng.integers(-(2**63), 2**63 - 1, (5, 1, 2), dtype=np.int64) ^ (np.int64(1) << rng.integers(0, 62, (5, 30, 2))) ^ rng.integers(0, 2**40, (5, 30, 2))
    group, i, j, d, pairs = simhash.spanned(fps, bits)
    for g, own in enumerate(fps):
        far = np.bitwise_count((own[:, None] ^ own[None]).view(np.uint64)).sum(-1).astype(int)
        edges = sorted((far[a, b], a, b) for a in range(30) for b in range(a) if far[a, b] <= bits)
        assert pairs[g] == len(edges)
        parent = list(range(30))
        find = lambda x: x if parent[x] == x else find(parent[x])
        weight = 0
        for w, a, b in edges:
            if find(a) != find(b):
                parent[find(a)] = find(b)
                weight += w
        mine = group == g
        assert d[mine].sum() == weight
        assert (far[i[mine], j[mine]] == d[mine]).all()
        assert mine.sum() == 30 - len({find(x) for x in range(30)})


def test_every_candidate_between_parts_is_tried(spark):
    """Of many candidates between two dense parts only the farthest is similar enough."""
    base = [list(range(1000 * p, 1000 * p + 100)) for p in (1, 2)]
    sets = {i: sorted(base[0]) + [i] for i in range(8)} | {100 + i: sorted(base[1]) + [100 + i] for i in range(8)}
    sets[7] = base[0] + base[1][:20]
    sets[107] = base[0] + base[1][:21]  # like 7, unlike the others of its part
    sets[106] = base[0] + base[1][:22]
    rows = [(u, v, abs(u - v) % 7 + 1) for u in sets for v in sets if u < v and (u < 100) != (v < 100)] + [(0, i, 1) for i in range(1, 8)] + [(100, 100 + i, 1) for i in range(1, 8)]
    edges = spark.createDataFrame(rows, "u long, v long, distance long")
    held = spark.createDataFrame([(k, sorted(x)) for k, x in sets.items()], "label long, hashes array<long>")
    got = {r.node: r.root for r in simhash.confirmed(edges, held, 0.8).collect()}
    want = common.forest(*(np.array(x) for x in zip(*[(u, v) for u, v, _ in rows if jaccard(set(sets[u]), set(sets[v])) >= 0.8])))
    assert {k: r for k, r in got.items() if k != r} == dict(zip(*(x.tolist() for x in want)))
    assert simhash.confirmed(edges.limit(0), held, 0.8).count() == 0


@pytest.mark.parametrize("text", ["", " \n", "One", "a b c d", "A b C d é", "a b c d e f g " * 90, " ".join(map(str, range(20_000)))])
def test_wide_fingerprint(text):
    got = simhash.wide_fingerprint(text.encode(), 5)
    assert sum(int(x) << 64 * i for i, x in enumerate(got)) == slow_wide(text)


def test_similar_groups_equal_brute_force(spark):
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts(260, 6))] + [(None, "a b c d e"), (2000, None), (2001, ""), (7000, "a b c d e"), (7000, "A b c d e"), (None, "only here once")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"a": F.lit(1), "label": F.lit("x"), "component_id": F.lit(0)})
    found = simhash.similar_groups(df).collect()
    got = [(r.doc_id, sum((x & (2**64 - 1)) << 64 * i for i, x in enumerate((r.a, r.b, r.c, r.d))), r.component_id) for r in found]
    want = slow_similar(rows)
    assert sorted(got, key=repr) == want
    assert len({c for _, _, c in want}) < 240


def test_edited_copies_go_and_other_texts_stay(spark):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(3000)]
    originals = [[r.choice(vocab) for _ in range(300)] for _ in range(60)]
    copies = []
    for words in originals:
        own = words.copy()
        for at in (50, 150, 250):  # 15 of 296 shingles: similarity 0.904
            own[at] = "edited"
        copies.append(own)
    rows = [(i, " ".join(w)) for i, w in enumerate(originals + copies)]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    ids = {x.doc_id for x in kept.collect()}
    assert ids >= set(range(60))
    assert len(ids) - 60 <= 3  # odds of a shared key at this similarity: 0.98


def test_texts_below_the_similarity_stay(spark):
    r = random.Random(9)
    vocab = [f"w{i}" for i in range(3000)]
    originals = [[r.choice(vocab) for _ in range(300)] for _ in range(60)]
    copies = [["edited" if at % 40 == 0 else w for at, w in enumerate(words)] for words in originals]
    rows = [(i, " ".join(w)) for i, w in enumerate(originals + copies)]
    assert all(0.7 < jaccard(slow_shingles(rows[i][1]), slow_shingles(rows[60 + i][1])) < 0.8 for i in range(60))
    assert simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).count() == 120


def family(r):
    """Texts of one template whose pairs are mostly just below the similarity, with near copies of some, and a chain."""
    base = [f"t{i}" for i in range(90)]
    out = []
    for k in range(40):
        own = base.copy()
        at = 4 + 9 * r.randrange(9)  # two words: 0.87 alike at one place, 0.76 at two
        own[at : at + 2] = [f"k{k}", f"m{k}"]
        out.append(own)
    for k in range(12):
        copy = out[k].copy()
        copy[r.randrange(90)] = "edit"
        out.append(copy)
    for _ in range(10):
        copy = out[-1].copy()
        copy[r.randrange(90)] = f"c{len(out)}"
        out.append(copy)
    return [" ".join(x) for x in out]


def test_a_family_is_joined_exactly_however_it_is_dealt(spark):
    """Equal to brute force whatever the partitions, the Arrow batches, the block at which keys split, and the cells."""
    rows = list(enumerate(family(random.Random(19))))
    sets = [slow_shingles(t) for _, t in rows]
    every = [jaccard(x, y) for i, x in enumerate(sets) for y in sets[:i]]
    assert 0.03 < np.mean([j >= 0.8 for j in every]) < 0.5
    want = sorted((d, c) for d, _, c in slow_similar(rows))
    assert 5 <= len({c for _, c in want}) < 30
    for parts, batch, block, cell in ((1, 10_000, 2048, 512), (7, 5, 2048, 512), (40, 100, 8, 4), (3, 7, 30, 512)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
            got = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(df, block=block, cell=cell).collect())
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        assert got == want


@pytest.mark.parametrize(("block", "cell", "screen"), [(2048, 2, 16), (8, 3, 4), (30, 512, 5), (2048, 1, 2048)])
def test_screened_cells_lose_nothing(spark, block, cell, screen):
    rows = list(enumerate(family(random.Random(29))))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.component_id) for r in simhash.similar_groups(df, block=block, cell=cell, screen=screen).collect())
    assert got == sorted((d, c) for d, _, c in slow_similar(rows))


@pytest.mark.parametrize("n", [1, 7, 60, 400, 3000, 90_000])
def test_sketches_refuse_unlike_pairs_only(n):
    """No pair of at least that similarity, however long its texts, counts beyond 255 among them; most unlike short ones go."""
    rng = np.random.default_rng(n)
    refused = 0
    for share in np.linspace(0.4, 1, 40):
        common = int(n * share)
        both, a, b = (np.unique(rng.integers(0, 2**63, k).astype(np.uint64) * np.uint64(2)) for k in (common, n - common, rng.integers(0, n - common + 1)))
        x, y = np.union1d(both, a), np.union1d(both, b)
        if not len(x) + len(y):
            continue
        ok = simhash.possible(simhash.sketch(x)[None], simhash.sketch(y)[None], np.array([len(x) + len(y)]), 0.8)[0]
        assert ok or not simhash.alike(x, y, 0.8)
        refused += not ok
    assert refused >= 10 or n > 1000 or n < 60


def test_empty_sets_may_be_alike():
    none = simhash.sketch(np.zeros(0, dtype=np.uint64))[None]
    assert simhash.possible(none, none, np.zeros(1, dtype=np.int64), 0.8).all()


def test_a_large_group_is_contracted_not_listed(spark):
    """Near copies: what a key gives on is in proportion to its rows, and nothing is left to compare in full."""
    r = random.Random(23)
    base = [f"t{i}" for i in range(200)]
    texts = []
    for k in range(300):
        own = base.copy()
        own[r.randrange(200)] = f"k{k}"
        texts.append(" ".join(own))
    fps = np.unique(np.array([simhash.wide_fingerprint(t.encode(), 5) for t in texts]).view(np.int64), axis=0)
    df = spark.createDataFrame([tuple(map(int, x)) for x in fps], ", ".join(f"{c} long" for c in simhash.WIDE))
    for block in (32, 2048):
        found, split = simhash.links(df, 55, block, simhash.WIDE)
        assert found.count() <= 3 * 85 * len(fps)
        assert (split.count() > 0) == (block == 32)
        roots = common.checkpointed(components(found))
        assert roots.select("root").distinct().count() == 1
        assert simhash.open_cells(found, split, roots) is None


def test_clashing_names_and_repeated_rows(spark):
    names = ["doc_id", "text", "_kept_id", "id", "content", "row", "component_id", "label", "a.b"]
    one, two = "some words that repeat here", "quite another text of words"
    rows = [(1, one, i, 2, "x", i, 4, 5, 6) for i in range(4)] + [(2, one, 0, 0, "y", 0, 0, 0, 0), (3, two, 9, 9, None, 9, 9, 9, 9)]
    kept = []
    for parts in (1, 5):
        df = spark.createDataFrame(rows, "doc_id long, text string, _kept_id int, id int, content string, row int, component_id int, label int, `a.b` int").repartition(parts)
        out = simhash.drop_near_copies(df)
        assert out.columns == names
        kept.append(sorted(map(tuple, out.collect())))
    assert kept[0] == kept[1]
    assert [x[0] for x in kept[0]] == [1, 3]


def test_unlike_texts_of_one_id_stay(spark):
    words = [[f"{k}{i}" for i in range(60)] for k in "abc"]
    one, two, three = (" ".join(w) for w in words)
    rows = [(1, one), (5, one), (5, two), (5, two), (5, three), (6, three), (7, two + " more")]
    for seed in range(3):
        df = spark.createDataFrame(random.Random(seed).sample(rows, len(rows)), "doc_id long, text string").withColumn("content", F.lit("x"))
        kept = simhash.drop_near_copies(df)
        assert kept.columns == ["doc_id", "text", "content"]
        assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(1, one), (5, two), (5, three)])


def test_short_near_copies_all_go(spark):
    """A word or more appended to short texts: fingerprints miss many of these pairs."""
    r = random.Random(21)
    rows, wanted = [], set()
    for words, more in ((8, 1), (10, 1), (16, 3), (12, 1)):
        for _ in range(60):
            own = [f"w{r.randrange(10**6)}" for _ in range(words)]
            copy = own + [f"w{r.randrange(10**6)}" for _ in range(more)]
            assert jaccard(slow_shingles(" ".join(own)), slow_shingles(" ".join(copy))) >= 0.8
            wanted.add(len(rows))
            rows += [(len(rows), " ".join(own)), (len(rows) + 1, " ".join(copy))]
    kept = simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x.doc_id for x in kept.collect()} == wanted


@pytest.mark.parametrize("cell", [3, 512])
def test_short_links_equal_brute_force(spark, cell):
    r = random.Random(22)
    bases = [[r.randrange(1, 2**63) for _ in range(n)] for n in (1, 2, 4, 5, 9, 10, 20, 37)]
    sets = [{x + r.choice((0, 0, 0, 0, 0, 0, 0, 1, 2)) for x in b[: r.randint(max(1, len(b) - 2), len(b))]} for b in bases for _ in range(25)] + [set(bases[5])] * 2
    held = [(i, bytearray(np.array(sorted(x), dtype="<u8").tobytes())) for i, x in enumerate(sets)]
    found = simhash.short_links(spark.createDataFrame(held, "label long, short binary"), 0.8, cell).collect()
    assert all(jaccard(sets[u], sets[v]) >= 0.8 for u, v in found)
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8]
    as_sets = lambda links: dict(zip(*(x.tolist() for x in common.forest(*(np.array(x) for x in zip(*links))))))
    assert as_sets([(u, v) for u, v in found]) == as_sets(pairs)


def test_components_of_chains_stars_and_cycles(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(1000, 1000 + i) for i in range(1, 200)] + [(5000, 1100)]
    noise = [(7, 7), (3, 2), (1001, 1000)]
    df = spark.createDataFrame(chain + star + noise, "u long, v long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 1000 for i in range(1000, 1200)} | {5000: 1000}
    assert components(df.limit(0)).count() == 0


def test_forest_spans():
    rng = np.random.default_rng(3)
    u, v = rng.integers(0, 60, 50), rng.integers(0, 60, 50)
    node, root = common.forest(u, v)
    label = {int(n): int(r) for n, r in zip(node, root)}
    assert all(label.get(int(a), int(a)) == label.get(int(b), int(b)) for a, b in zip(u, v))
