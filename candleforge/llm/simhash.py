"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into four 16-bit segments, each read as a 23-bit word of the perfect binary Golay
code (seven high bits zero). Every word is within 3 bits of one codeword, its *decoding*, and has a *list* of one to
six codewords within 4 bits, the decoding among them. Words one error apart share a codeword of their lists: the
decoding of one is within 4 bits of the other. With at most 4 errors over 4 segments, pigeonhole leaves two cases:

- each segment has exactly 1 error: segments 0 and 1 share a codeword each;
- some segment i has none: then for one of the eight pairs (i, j) below, i agrees exactly and j has at most 1
  error. One clean segment leaves errors (1, 1, 1) or (1, 1, 2) on the others, and two j per i avoid the 2; two
  clean segments are one of the six unordered pairs, all of which occur.

A fingerprint thus makes about 70 rows, keys being 24 or 28 bits wide. All rows of a key meet, every pair is verified by
its true distance, and a key gives on only a spanning forest of its verified links, never all pairs.

A key with more than `BLOCK` rows is split into parts, and at first only neighbouring parts meet, so that work stays in
proportion to the rows. Links found so far are contracted; a split key whose rows are not one component by then is
compared in full, cell by cell, what lies outside its largest component against everything in it. So a large group of
copies costs little more than one pass, and nothing is dropped.

Four bits of 64 are far less than what copies of similarity 0.8 differ in. For those, `similar_groups` takes wide
fingerprints: 256 bits of the distinct five-word shingles, whose share of differing bits estimates the similarity
with a standard error of about 0.03. A key names the decoding of one segment and a codeword of the next one's list, so
each of the 16 segment pairs makes one to six rows. Pigeonhole can't cover that many errors: a pair shares a key with
odds of 0.94 at similarity 0.8, 0.98 at 0.85 and 0.995 at 0.9 (the tests measure them, on edited texts too). Rows that
meet are candidates up to three standard errors beyond the expected distance, and a candidate is a link only if the
shingle sets themselves are that similar. A key gives on the least spanning forest of its candidates; what it holds
back is compared after contraction, as above, but once for a whole family of candidates where that makes fewer pairs than
its keys do: first by sketches of 256 bytes, which prove most unlike pairs unlike, and
only rows with a pair that is left fetch their shingle sets. So the links are exactly the pairs that share a key, are within that
distance and are that similar, however rows are dealt and batched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.llm.common import binaries, checkpointed_in_few, mix, portions, text_batches, written
from candleforge.llm.components import components

SHINGLE = 4
MAX_BITS = 4
#: Words of a wide fingerprint, 64 bits each, and their columns.
WIDE = ("a", "b", "c", "d")
#: Distinct shingles up to which texts are joined exactly, and rows of one of their keys that are compared in one cell.
SHORT, CELL = 40, 512
#: Rows of one key, of a fixed size each, that are screened in one cell; counts in a sketch, and pairs of them taken at once.
SCREEN, SKETCH, SCREENED = 2048, 256, 1 << 14
#: Rows of one key that meet at once; keys with more are split.
BLOCK = 2048
#: Rows of a key up to which every verified pair is given on: no more than two for each row.
FEW = 5
#: Pairs of fingerprints compared at once.
PAIRS = 1 << 18
#: Split keys, or classes with candidates (16 bytes each), that are broadcast; more are joined.
BROADCAST_KEYS = 100_000

_PAIRS = tuple((i, (i + step) % 4) for i in range(4) for step in (1, 2))
_GENERATOR = 0xAE3  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


@cache
def golay() -> tuple[np.ndarray, np.ndarray]:
    """For each 16-bit word: the index of its decoding, and the indices of all codewords within 4 bits, padded with -1."""

    def syndrome(words: np.ndarray) -> np.ndarray:
        w = words.astype(np.int64)
        for bit in range(22, 10, -1):
            w = np.where((w >> bit) & 1, w ^ (_GENERATOR << (bit - 11)), w)
        return w

    patterns = [sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(23), weight)]
    near: list[list[int]] = [[] for _ in range(2048)]
    for pattern, s in zip(patterns, syndrome(np.array(patterns)).tolist()):
        near[s].append(pattern)  # by weight, so the coset leader comes first
    table = np.full((2048, 6), -1, dtype=np.int64)
    for s, own in enumerate(near):
        table[s, : len(own)] = own
    words = np.arange(1 << 16)
    errors = table[syndrome(words)]
    index = np.where(errors >= 0, (words[:, None] ^ errors) >> 11, -1)
    return index[:, 0].copy(), index


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; of the whole sequence if it has fewer words."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    h, n = xxhash.xxh64_intdigest, len(words)
    joined = b" ".join(words)
    if n < shingle:
        return np.array([h(joined, 42)], dtype="<u8")
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: n - shingle])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops)), dtype="<u8", count=len(starts))


def majority(hashes: np.ndarray) -> np.ndarray:
    """The bits set in over half of the rows of hashes (n by words), as words."""
    n, words = hashes.shape
    ones = np.zeros(64 * words, dtype=np.int64)
    for at in range(0, n, 1 << 14):
        part = np.ascontiguousarray(hashes[at : at + (1 << 14)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * ones > n).view("<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the XXH64 bits (seed 42) of the word shingles, repeats included; 0 without words."""
    return int(majority(shingle_hashes(text, shingle)[:, None])[0])


def wide_fingerprint(text: bytes, shingle: int) -> np.ndarray:
    """Four words: majority of 256 bits derived from the hash of every distinct word shingle; zeros without words."""
    return wide(np.unique(shingle_hashes(text, shingle)))


def wide(own: np.ndarray) -> np.ndarray:
    """The same of the distinct shingle hashes."""
    return majority(np.stack([mix(own + np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (2**64 - 1))) for i in range(len(WIDE))], axis=1))


def most_bits(similarity: float) -> int:
    """Differing bits of wide fingerprints beyond which shingle sets of that similarity (Jaccard) are only with odds of
    about 0.001: the expected number for equally large sets, which is the most, and three standard errors."""
    share, n = np.arccos(2 * similarity / (1 + similarity)) / np.pi, 64 * len(WIDE)
    return int(n * share + 3 * np.sqrt(n * share * (1 - share)))


def _texts(docs: DataFrame, text_col: str) -> list:
    """The text as bytes (null: empty) and a hash that names it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return [text.cast("binary").alias("t"), F.xxhash64(text).alias("content")]


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, content, short, a, b, c, d long) of every row; null text is empty, content names the text, short (binary)
    holds the sorted distinct shingle hashes where there are 1 to SHORT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            own = [np.unique(shingle_hashes(t, shingle)) for t in binaries(batch.column("t"))]
            fps = np.array([wide(x) for x in own], dtype=np.uint64).reshape(-1, len(WIDE)).view(np.int64)
            short = pa.array([x.tobytes() if 0 < len(x) <= SHORT else None for x in own], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("content"), short, *(pa.array(c) for c in fps.T)], names=["id", "content", "short", *WIDE])

    source = docs.select(F.col(id_col).cast("long").alias("id"), *_texts(docs, text_col))
    return source.mapInArrow(run, "id long, content long, short binary, a long, b long, c long, d long")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp long) of every row; null text is empty. The long holds the 64 bits, signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            fps = np.array([fingerprint(t, shingle) for t in binaries(batch.column("t"))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(fps)], names=["id", "fp"])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return source.mapInArrow(run, "id long, fp long")


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    return [((fps[:, w].view(np.uint64) >> np.uint64(16 * i)) & np.uint64(0xFFFF)).astype(np.int64) for w in range(fps.shape[1]) for i in range(4)]


def keys_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, row): the keys of fingerprints (n by words), and whose they are."""
    decoding, within = golay()
    seg = _segments(fps)
    keys, own = [], []

    def add(kind: int, exact: np.ndarray, lists: np.ndarray) -> None:
        row, col = np.nonzero((exact >= 0) & (lists >= 0))
        keys.append((np.int64(kind) << 32) | np.broadcast_to(exact, lists.shape)[row, col] << 12 | lists[row, col])
        own.append(row)

    if len(seg) > 4:
        for i, word in enumerate(seg):
            add(i, decoding[word][:, None], within[seg[(i + 1) % len(seg)]])
    else:
        for kind, (i, j) in enumerate(_PAIRS):
            add(kind, seg[i][:, None], within[seg[j]])
        second = within[seg[1]]
        add(len(_PAIRS), np.repeat(within[seg[0]], second.shape[1], axis=1), np.tile(second, (1, second.shape[1])))
    return np.concatenate(keys), np.concatenate(own)


def _matrix(batch: pa.RecordBatch, columns: tuple[str, ...]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns], axis=1)


def _key_rows(distinct: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = _matrix(batch, columns)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                key, row = keys_of(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c) for c in part[row].T)], names=["k", *columns])

    return distinct.select(*columns).mapInArrow(run, "k long, " + ", ".join(f"{c} long" for c in columns))


def labels(fps: np.ndarray) -> np.ndarray:
    """One long per fingerprint (n by words): the word itself, or a hash of several."""
    out = fps[:, 0].view(np.uint64)
    for i in range(1, fps.shape[1]):
        out = mix(out) + fps[:, i].view(np.uint64)
    return (out if fps.shape[1] == 1 else mix(out)).view(np.int64)


def _labelled(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """df with the label of its fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(labels(_matrix(batch, columns)))], names=[*batch.schema.names, "label"])

    return df.mapInArrow(run, ", ".join(f"{x.name} {x.dataType.simpleString()}" for x in df.schema) + ", label long")


def _apart(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Differing bits of rows; words are the last axis, the others broadcast."""
    return sum(np.bitwise_count((left[..., w] ^ right[..., w]).view(np.uint64)).astype(np.uint16) for w in range(left.shape[-1]))


def spanned(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For groups of equal size (groups by rows by words): the least spanning forest of the pairs within `bits`, as
    (group, row, row, distance), and for each group how many such pairs there are. Prim's algorithm, all groups in step."""
    g, n, _ = fps.shape
    far, every = np.uint16(0xFFFF), np.arange(g)
    least, parent, out = np.full((g, n), far), np.zeros((g, n), dtype=np.int64), np.zeros((g, n), dtype=bool)
    pick, pairs = np.zeros(g, dtype=np.int64), np.zeros(g, dtype=np.int64)
    found = []
    for step in range(n):
        if step:
            pick = np.where(out, far, least).argmin(axis=1)
            unreached = out[every, pick]  # all others are beyond `bits`: begin a new tree
            pick = np.where(unreached, out.argmin(axis=1), pick)
            d = least[every, pick]
            linked = np.flatnonzero(~unreached & (d < far))
            found.append((linked, parent[linked, pick[linked]], pick[linked], d[linked].astype(np.int64)))
        out[every, pick] = True
        d = _apart(fps[every, pick][:, None], fps)
        d = np.where((d <= bits) & ~out, d, far)
        pairs += (d < far).sum(axis=1)
        nearer = d < least
        least[nearer] = d[nearer]
        parent = np.where(nearer, pick[:, None], parent)
    if not found:
        found = [(every[:0],) * 4]
    return *(np.concatenate(x) for x in zip(*found)), pairs


def _meet(key: np.ndarray, edge: np.ndarray, fp: np.ndarray, bits: int, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, ...]]:
    """(u, v, distance, key, n) of whole groups of n rows, edge[i] to edge[i + 1] each: all verified pairs of small groups, and
    the least spanning forest of others. The key is given, else -1, where pairs are held back; there the roots of trees
    come too, with themselves, so that each row with a verified pair is a v once."""
    start, size = edge[:-1], np.diff(edge)
    for n in np.unique(size[size > 1]).tolist():
        same = start[size == n]
        step = max(1, pairs // (n * n))
        for at in range(0, len(same), step):
            some = same[at : at + step]
            if n <= FEW:
                i, j = np.triu_indices(n, 1)
                left, right = (some[:, None] + i).ravel(), (some[:, None] + j).ravel()
                d = _apart(fp[left], fp[right])
                ok = d <= bits
                left, right, d, held = left[ok], right[ok], d[ok].astype(np.int64), np.full(ok.sum(), -1)
            else:
                group, i, j, d, total = spanned(fp[some[:, None] + np.arange(n)], bits)
                held = np.where(total > np.bincount(group, minlength=len(some)), key[some], -1)
                child = np.zeros((len(some), n), dtype=bool)
                child[group, j] = True
                tops = np.unique(np.stack([group, i])[:, ~child[group, i] & (held[group] >= 0)], axis=1)
                group, i, j, d = (np.concatenate(x) for x in ((group, tops[0]), (i, tops[1]), (j, tops[1]), (d, np.zeros(tops.shape[1], dtype=np.int64))))
                left, right, held = some[group] + i, some[group] + j, held[group]
            if len(left):
                yield labels(fp[left]), labels(fp[right]), d, held, np.full(len(left), n)


def _column(df_key: str, parts: str) -> F.Column:
    return F.pmod(F.xxhash64(df_key), F.col(parts)).cast("int")


def links(distinct: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, columns: tuple[str, ...] = ("fp",)) -> tuple[DataFrame, DataFrame]:
    """(found, split) for one row per fingerprint, checkpointed.

    found: (u, v, distance, bucket, met) links, by `labels`, of fingerprints that share a key and differ in at most `bits`
    bits. For one column of 64 bits, 0 to 4, all such pairs share a key. bucket names a key that held back pairs among
    its rows in found, else it is null; met is the number of rows that met there. split: (bucket, label) of all rows of keys that were split, whose parts have not
    all met; `rest` compares what remains of either.
    """
    if len(columns) == 1 and not 0 <= bits <= MAX_BITS:
        raise ValueError(f"the keys cover at most {MAX_BITS} differing bits")
    rows = _key_rows(distinct, columns)
    hot = rows.groupBy("k").agg(F.count("*").alias("n")).where(F.col("n") > block)
    hot = checkpointed_in_few(hot.select("k", F.ceil(F.col("n") / (block / 2)).cast("int").alias("parts")))
    n_hot = hot.count()
    split = distinct.sparkSession.createDataFrame([], "bucket long, label long")
    if n_hot:
        side = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        split = checkpointed_in_few(_labelled(rows.join(side, "k"), columns).select(F.col("k").alias("bucket"), "label"))
        mine = F.pmod(F.xxhash64(*columns), F.col("parts")).cast("int")
        cells = F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.array(mine, F.pmod(mine + 1, F.col("parts"))))
        rows = rows.join(side, "k", "left").select("k", *columns, F.explode(cells).alias("cell"))
    else:
        rows = rows.withColumn("cell", F.lit(-1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + len(columns)), dtype=np.int64)

        def out(rows: np.ndarray, change: np.ndarray) -> Iterator[pa.RecordBatch]:
            edge = np.r_[0, change, len(rows)] if len(rows) else np.zeros(1, dtype=np.int64)
            for u, v, d, key, n in _meet(rows[:, 0], edge, np.ascontiguousarray(rows[:, 2:]), bits):
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d), pa.array(key, mask=key < 0), pa.array(n)], names=["u", "v", "distance", "bucket", "met"])

        for batch in batches:
            held = np.concatenate([held, _matrix(batch, ("k", "cell", *columns))])
            change = np.flatnonzero((held[1:, :2] != held[:-1, :2]).any(axis=1)) + 1
            if len(change):  # the last group, at most about `block` rows, may go on
                yield from out(held[: change[-1]], change[:-1])
                held = held[change[-1] :]
        yield from out(held, np.zeros(0, dtype=np.int64))

    dealt = rows.repartition("k", "cell").sortWithinPartitions("k", "cell", *columns)  # keys with the same rows choose the same links
    return checkpointed_in_few(dealt.mapInArrow(run, "u long, v long, distance long, bucket long, met long")), split


def open_rows(found: DataFrame, split: DataFrame, roots: DataFrame, cell: int) -> DataFrame | None:
    """(bucket, label, root, main, xs, ys): what is left to compare of keys that held back pairs, None if nothing is.

    Rows of a key that is one component by roots (node, root) go. Of the others, those outside the largest component
    (main) meet all rows as left ones, in xs times ys cells of at most about twice `cell` rows.
    """
    listed = found.where(F.col("bucket").isNotNull()).select("bucket", F.col("v").alias("label")).unionByName(split)
    members = listed.join(roots.select(F.col("node").alias("label"), "root"), "label", "left")
    members = checkpointed_in_few(members.select("bucket", "label", F.coalesce("root", "label").alias("root")))
    facts = checkpointed_in_few(_open(members, cell).drop("left", "n"))
    return None if facts.isEmpty() else members.join(facts, "bucket")


def _open(members: DataFrame, cell: int) -> DataFrame:
    """(bucket, main, left, n, xs, ys) of the buckets of members (bucket, root) that are not one component: the largest
    one's root, the rows outside it, all rows, and the numbers of cells; and the sum of met, if members have it."""
    names = [c for c in members.columns if c == "met"]
    sizes = members.groupBy("bucket", "root").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names))
    facts = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.sum("n").alias("n"), F.max("n").alias("most"), *(F.sum(c).alias(c) for c in names))
    parts = lambda n: F.ceil(n / cell).cast("int")
    left = F.col("n") - F.col("most")
    return facts.where("n > most").select("bucket", "main", left.alias("left"), "n", parts(left).alias("xs"), parts(F.col("n")).alias("ys"), *names)


def open_families(found: DataFrame, candidates: DataFrame, roots: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """(rows, keyed): what is left to compare of keys that held back pairs and were not split.

    Such a pair is connected by candidates (u, v), so it lies in one of their components, a family. A row has some 85
    keys, and in a family of one template it meets the same others in many of them. So the rows of a family meet once,
    whatever their keys, if that makes no more pairs than its keys do: rows are those of open_rows, with the family as
    bucket. The labels of families that their keys hardly connect are keyed, and left to open_rows.
    """
    held = found.where(F.col("bucket").isNotNull()).groupBy(F.col("v").alias("label")).agg(F.sum("met").alias("met"))
    families = components(candidates).select(F.col("node").alias("label"), F.col("root").alias("bucket"))
    named = held.join(families, "label").join(roots.select(F.col("node").alias("label"), "root"), "label", "left")
    members = checkpointed_in_few(named.select("bucket", "label", F.coalesce("root", "label").alias("root"), "met"))
    facts = _open(members, cell).withColumn("whole", F.col("left") * F.col("n") <= F.col("met"))
    rows = checkpointed_in_few(members.drop("met").join(checkpointed_in_few(facts.drop("left", "n", "met")), "bucket"))
    return rows.where("whole").drop("whole"), rows.where("not whole").select("label")


def open_cells(found: DataFrame, split: DataFrame, roots: DataFrame, cell: int = CELL) -> DataFrame | None:
    """open_rows dealt over their cells: (bucket, x, y, label, root, left), or None."""
    rows = open_rows(found, split, roots, cell)
    return None if rows is None else _celled(rows)


def _celled(rows: DataFrame) -> DataFrame:
    """open_rows, with further columns, in every cell of theirs."""
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    one = rows.where(F.col("root") != F.col("main")).withColumn("x", _column("label", "xs")).withColumn("y", every("ys")).withColumn("left", F.lit(True))
    other = rows.withColumn("y", _column("label", "ys")).withColumn("x", every("xs")).withColumn("left", F.lit(False))
    first = ["bucket", "x", "y", "label", "root", "left"]
    columns = first + [c for c in rows.columns if c not in (*first, "main", "xs", "ys")]
    return one.select(*columns).unionByName(other.select(*columns))


def _finer(cells: DataFrame, cell: int) -> DataFrame:
    """The same rows in cells of about `cell` left and `cell` other rows at most: whole shingle sets come with them next."""
    where = ["bucket", "x", "y"]
    parts = lambda side: F.greatest(F.ceil(F.sum(side.cast("int")) / cell), F.lit(1)).cast("int")
    sizes = checkpointed_in_few(cells.groupBy(*where).agg(parts(F.col("left")).alias("xs"), parts(~F.col("left")).alias("ys")))
    rows = cells.join(sizes, where)
    own = F.xxhash64("bucket", "label")  # the label alone chose the cell
    mine = F.pmod(own, F.when(F.col("left"), F.col("xs")).otherwise(F.col("ys"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("left"), F.col("ys")).otherwise(F.col("xs")) - 1))
    rows = rows.withColumn("mine", mine).withColumn("other", other)
    place = {"x": ("mine", "other"), "y": ("other", "mine")}
    finer = {c: F.col(c).cast("long") * (1 << 20) + F.when(F.col("left"), F.col(a)).otherwise(F.col(b)) for c, (a, b) in place.items()}
    return rows.withColumns(finer).select(*cells.columns)


def _shared(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For every kind of key: whether the wide fingerprints a[i] and b[i] share one, and the least codeword in it."""
    decoding, within = golay()
    one, other = _segments(a), _segments(b)
    for i in range(len(one)):
        j = (i + 1) % len(one)
        mine, theirs = within[one[j]][:, :, None], within[other[j]][:, None, :]
        common = np.where((mine == theirs) & (mine >= 0), mine, 1 << 12).min(axis=(1, 2))
        yield (decoding[one[i]] == decoding[other[i]]) & (common < 1 << 12), common


def _least_key(a: np.ndarray, b: np.ndarray, bucket: int) -> np.ndarray:
    """Whether bucket is the least key that the wide fingerprints a[i] and b[i] share."""
    out = np.ones(len(a), dtype=bool)
    for i, (shared, common) in enumerate(_shared(a, b)):
        if i == bucket >> 32:
            return out & shared & (common == bucket & 0xFFF)
        out &= ~shared
    return out


def _any_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the wide fingerprints a[i] and b[i] share a key."""
    return np.logical_or.reduce([shared for shared, _ in _shared(a, b)])


def _by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """(bucket, rows) of whole cells; rows are sorted by cell."""
    now, held = None, []
    for batch in batches:
        keys = _matrix(batch, ("bucket", "x", "y"))
        edge = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(keys)]):
            if a == b:
                continue
            if now is not None and (keys[a] != now).any():
                yield int(now[0]), pa.concat_tables(held)
                held = []
            now = keys[a]
            held.append(pa.Table.from_batches([batch.slice(a, b - a)]))
    if held:
        yield int(now[0]), pa.concat_tables(held)


def sketch(own: np.ndarray) -> np.ndarray:
    """Distinct shingle hashes counted by their highest byte, 255 at most."""
    return np.minimum(np.bincount((own >> np.uint64(56)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8)


def possible(one: np.ndarray, other: np.ndarray, sizes: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets may have that Jaccard similarity, by their sketches (row by row) and the sum of their sizes.

    Counts that differ by d prove d hashes that one set alone has, and so do counts cut at 255. Sets of that similarity
    have at most (1 - similarity) / (1 + similarity) of the summed sizes of such hashes; so no similar pair is refused.
    """
    apart = (np.maximum(one, other) - np.minimum(one, other)).sum(axis=1, dtype=np.int64)
    return apart * (1 + similarity) <= sizes * (1 - similarity) + 1e-6


def _near(rows: pa.Table, columns: tuple[str, ...], bits: int, similarity: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(fingerprints of all rows, i, j) of pairs within `bits` of a left row and another one that has another root; where a
    similarity is given, without those that their sketches prove less alike."""
    left, root = rows.column("left").to_numpy(), rows.column("root").to_numpy()
    if similarity is not None:
        sketches = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, SKETCH)
        size = rows.column("n").to_numpy().astype(np.int64)
    fps = np.ascontiguousarray(np.stack([rows.column(c).to_numpy() for c in columns], axis=1))
    own, other = np.flatnonzero(left), np.flatnonzero(~left)
    for at in range(0, len(own), 64):
        some = own[at : at + 64]
        i, j = np.nonzero((_apart(fps[some][:, None], fps[other][None]) <= bits) & (root[some][:, None] != root[other][None]))
        i, j = some[i], other[j]
        if similarity is not None:
            ok = [possible(sketches[a], sketches[b], size[a] + size[b], similarity) for a, b in ((i[k : k + SCREENED], j[k : k + SCREENED]) for k in range(0, len(i), SCREENED))]
            keep = np.concatenate(ok) if ok else np.zeros(0, dtype=bool)
            i, j = i[keep], j[keep]
        yield fps, i, j


def _dealt(cells: DataFrame) -> DataFrame:
    return cells.repartition("bucket", "x", "y").sortWithinPartitions("bucket", "x", "y")


def involved(cells: DataFrame, bits: int, similarity: float, families: bool) -> DataFrame:
    """The rows of cells, which hold wide fingerprints, sketches and sizes, that have a pair to be compared there: of
    different roots, within `bits`, not proven less alike by their sketches, and sharing a key. Where cells are those of a
    key, it must be the least that both have, so each pair is compared once; a pair whose least key held nothing back was
    compared before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in _by_cell(batches):
            keep = np.zeros(rows.num_rows, dtype=bool)
            for fps, i, j in _near(rows, WIDE, bits, similarity):
                first = _any_key(fps[i], fps[j]) if families else _least_key(fps[i], fps[j], bucket)
                keep[i[first]] = keep[j[first]] = True
            yield from rows.filter(pa.array(keep)).combine_chunks().to_batches()

    return checkpointed_in_few(_dealt(cells).mapInArrow(run, cells.schema))


def rest(cells: DataFrame, columns: tuple[str, ...], bits: int, similarity: float | None = None) -> DataFrame:
    """(u, v) links that connect what all links within the cells connect beyond their roots. Cells hold the fingerprints'
    columns too and, if a similarity is asked for, the shingle hashes, their number n and their sketch."""

    def compared(rows: pa.Table) -> Iterator[tuple[int, int]]:
        name, root = rows.column("label").to_numpy(), rows.column("root").to_numpy()
        sets = rows.column("hashes") if similarity is not None else None
        part: dict[int, int] = {}

        def find(r: int) -> int:
            while r in part:
                r = part[r]
            return r

        for fps, left, right in _near(rows, columns, bits, similarity):
            if len(columns) > 1:  # those of a family need share no key
                shared = _any_key(fps[left], fps[right])
                left, right = left[shared], right[shared]
            for i, j in zip(left.tolist(), right.tolist()):
                p, q = find(int(root[i])), find(int(root[j]))
                if p != q and (sets is None or alike(sets[i].values.to_numpy(), sets[j].values.to_numpy(), similarity)):
                    part[max(p, q)] = min(p, q)
                    yield int(name[i]), int(name[j])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_cell(batches):
            pairs = list(compared(rows))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in pairs], pa.int64()) for i in (0, 1)], names=["u", "v"])

    return checkpointed_in_few(_dealt(cells).mapInArrow(run, "u long, v long"))


def linked(distinct: DataFrame, bits: int = MAX_BITS, block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """(node, root) of the fingerprints (fp) that have others within `bits`; every such link counts."""
    found, split = links(distinct, bits, block)
    roots = components(found)
    cells = open_cells(found.where("false"), split, roots, cell) if not split.isEmpty() else None  # what other keys hold back is connected
    if cells is None:
        return roots
    roots = checkpointed_in_few(roots)
    more = rest(cells.withColumn("fp", F.col("label")), ("fp",), bits)
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def shingle_sets(docs: DataFrame, text_col: str, classes: DataFrame, shingle: int) -> DataFrame:
    """(label, a, b, c, d, hashes array<long>, n int, sketch binary) of classes (label, content, a, b, c, d): the distinct
    shingle hashes of the text so named, their number and their sketch."""
    names = ["label", *WIDE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches):
            sets = [np.unique(shingle_hashes(t, shingle)) for t in binaries(batch.column("t"))]
            own = [pa.array([x.view(np.int64) for x in sets], type=pa.list_(pa.int64())), pa.array([len(x) for x in sets], type=pa.int32())]
            own.append(pa.array([sketch(x).tobytes() for x in sets], type=pa.binary()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *own], names=[*names, "hashes", "n", "sketch"])

    few = classes.count() <= BROADCAST_KEYS
    named = docs.select(*_texts(docs, text_col)).join(F.broadcast(classes) if few else classes, "content")
    once = named.groupBy(*names).agg(F.first("t").alias("t"))
    with text_batches(docs.sparkSession):
        return written(once.mapInArrow(run, ", ".join(f"{c} long" for c in names) + ", hashes array<long>, n int, sketch binary"), "shingles")


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets of distinct shingle hashes have that Jaccard similarity."""
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common >= similarity * (len(a) + len(b) - common)


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those (u, v) whose shingle sets have that similarity; compared where they are joined, row by row in the JVM, so that
    no batch of long sets is held."""
    left = pairs.join(sets.select(F.col("label").alias("u"), F.col("hashes").alias("one")), "u")
    both = left.join(sets.select(F.col("label").alias("v"), F.col("hashes").alias("other")), "v")
    common = F.size(F.array_intersect("one", "other"))
    return both.where(common >= F.lit(similarity) * (F.size("one") + F.size("other") - common)).select("u", "v")


def _alike(own: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (u, v) that connect the rows of one cell (labels, sets) as all exact ones do, by breadth-first search: links
    are final, so what is reached is compared no more."""
    size = np.array([len(x) for x in sets])
    flat = np.concatenate(sets)
    _, token = np.unique(flat, return_inverse=True)
    at = np.concatenate(([0], np.cumsum(size)))
    order = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(sets)), size)[order]
    first = np.concatenate(([0], np.cumsum(np.bincount(token))))
    rest = np.ones(len(sets), dtype=bool)
    us, vs = [], []
    for start in range(len(sets)):
        if not rest[start]:
            continue
        rest[start] = False
        waiting = [start]
        while waiting:
            i = waiting.pop()
            common = np.bincount(np.concatenate([holder[first[t] : first[t + 1]] for t in token[at[i] : at[i + 1]]]), minlength=len(sets))
            new = np.flatnonzero(rest & (common >= similarity * (size[i] + size - common)))
            us.append(np.full(len(new), own[i]))
            vs.append(own[new])
            rest[new] = False
            waiting.extend(new.tolist())
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *us]), np.concatenate([none, *vs])


def short_links(sets: DataFrame, similarity: float, cell: int = CELL) -> DataFrame:
    """(u, v) links that connect what all pairs of sets (label, short) of at least that similarity connect.

    Exact. In one order of all shingles, the rarest first, two similar sets share one of the first n - similarity * n
    (rounded down) + 1 of each, n being the set's size; those are its keys. A key with many rows is dealt over cells, so
    that any two of them meet in one.
    """
    rows = checkpointed_in_few(sets.distinct().withColumn("n", (F.octet_length("short") / 8).cast("int")).withColumn("row", F.monotonically_increasing_id()))
    place = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i")
    tokens = rows.select("row", "n", F.col("short"), place).select("row", "n", F.hex(F.substring("short", F.col("i") * 8 + 1, F.lit(8))).alias("token"))
    often = checkpointed_in_few(tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1"))
    # a shingle that one set alone has comes first and is no key
    ranked = tokens.join(often, "token", "left").groupBy("row", "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("often", F.lit(1)).alias("often"), "token"))).alias("all"))
    length = F.floor(F.col("n") * (1 - similarity) + 1e-9).cast("int") + 1
    keys = ranked.select("row", F.explode(F.slice("all", F.lit(1), length)).alias("key")).where("key.often > 1").select("row", F.col("key.token").alias("token"))
    keys = checkpointed_in_few(keys)
    parts = keys.groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    parts = checkpointed_in_few(parts.select("token", F.ceil(F.col("n") / cell).cast("int").alias("parts")))
    mine = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int")
    dealt = keys.join(parts, "token").withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("row", "token", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    named = dealt.join(rows.select("row", "label", "short"), "row").select("token", "x", "y", "label", "short")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list[tuple]) -> pa.RecordBatch:
            u, v = _alike(np.array([x for x, _ in held], dtype=np.int64), [np.frombuffer(x, dtype="<u8") for _, x in held], similarity)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        now, held = None, []
        for batch in batches:
            for *key, label, short in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if len(held) > 1:
                        yield out(held)
                    now, held = key, []
                held.append((label, short))
        if len(held) > 1:
            yield out(held)

    cells = named.repartition("token", "x", "y").sortWithinPartitions("token", "x", "y")
    return checkpointed_in_few(cells.mapInArrow(run, "u long, v long").where("u <> v").distinct())


def confirmed(candidates: DataFrame, sets: DataFrame, similarity: float, sure: DataFrame | None = None) -> DataFrame:
    """(node, root) over the candidates (u, v, distance) whose sets (label, hashes) have that similarity, and the links
    (u, v) that are sure.

    First every node's nearest candidate is compared; then all others, but for those within a part that is connected
    by now, which could add nothing. So none is dropped untried, and the copies of a large group are compared with
    few others each.
    """
    ends = [candidates.select(F.col(end).alias("node"), F.struct("distance", "u", "v").alias("edge")) for end in ("u", "v")]
    nearest = ends[0].unionByName(ends[1]).groupBy("node").agg(F.min("edge").alias("edge")).select("edge.u", "edge.v").distinct()
    nearest = checkpointed_in_few(nearest)
    first = _similar(nearest, sets, similarity)
    first = checkpointed_in_few(first if sure is None else first.unionByName(sure))
    roots = checkpointed_in_few(components(first))
    rest = candidates.select("u", "v").join(nearest, ["u", "v"], "left_anti")
    for end, root in (("u", "ru"), ("v", "rv")):
        rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(root)), end, "left").withColumn(root, F.coalesce(root, end))
    others = checkpointed_in_few(_similar(checkpointed_in_few(rest.where("ru <> rv").select("u", "v")), sets, similarity))
    return components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(others.select("u", "v")))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp long, component_id) of every row of docs.

    component_id is the least id reachable over fingerprints that differ in at most `bits` bits; equal
    fingerprints are linked. Null and empty texts have fingerprint 0 and are linked like any other; a bit that
    exactly half of the shingles have is 0. Long texts are read whole, a part at a time. A row with a null id keeps
    its row; it counts for reachability, never as least id (a group of null ids only has a null component_id).
    Repeated rows are repeated in the result. An empty table gives an empty result. Other columns of docs are not
    read, whatever their names.
    """
    return _grouped(fingerprints(docs, id_col, text_col, shingle), ("fp",), lambda classes, _: linked(classes, bits))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, block: int = BLOCK, cell: int = CELL, screen: int = SCREEN) -> DataFrame:
    """(doc_id, a, b, c, d long, component_id) of every row of docs, by wide fingerprints.

    Links join texts whose sets of lower-cased word shingles have that Jaccard similarity: all of those with at most
    SHORT distinct shingles each, and others among those whose fingerprints share a key and differ in at most
    `most_bits(similarity)` bits; equal fingerprints are linked unseen. The result does not depend on partitions,
    batches, block, cell or screen. A bit that half of the shingles have is 0. Cases are handled as by simhash_groups.
    """
    return _similar_rows(docs, id_col, text_col, shingle, similarity, block, cell, screen).drop("content", "root")


def _similar_rows(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, block: int = BLOCK, cell: int = CELL, screen: int = SCREEN) -> DataFrame:
    """The same with the content and the group's root of every row."""

    def rooted(classes: DataFrame, labelled: DataFrame) -> DataFrame:
        sure = short_links(labelled.select("label", "short"), similarity)
        bits = most_bits(similarity)
        found, split = links(classes, bits, block, WIDE)
        candidates = found.where("u <> v").groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("distance").alias("distance"))
        candidates = checkpointed_in_few(candidates)
        named = classes.select("label", "content", *WIDE)
        ends = candidates.select(F.col("u").alias("label")).unionByName(candidates.select(F.col("v").alias("label"))).distinct()
        sets = shingle_sets(docs, text_col, checkpointed_in_few(named.join(ends, "label")), shingle)
        roots = checkpointed_in_few(confirmed(candidates, sets, similarity, sure))
        once, keyed = open_families(found, candidates, roots, screen)
        todo = [] if once.isEmpty() else [(once, True)]
        if not (keyed.isEmpty() and split.isEmpty()):
            by_key = open_rows(found.join(keyed.select(F.col("label").alias("v")), "v", "left_semi"), split, roots, screen)
            todo += [] if by_key is None else [(by_key, False)]
        more = roots.select(F.col("node").alias("u"), F.col("root").alias("v"))
        for rows, families in todo:
            # of a key that was split, rows without a candidate may be there too
            sets = shingle_sets(docs, text_col, checkpointed_in_few(named.join(rows.select("label").distinct(), "label")), shingle)
            cells = involved(_celled(rows.join(sets.select("label", *WIDE, "n", "sketch"), "label")), bits, similarity, families)
            more = more.unionByName(rest(_finer(cells, cell).join(sets.select("label", "hashes"), "label"), WIDE, bits, similarity))
        return components(more) if todo else roots

    return _grouped(wide_fingerprints(docs, id_col, text_col, shingle), WIDE, rooted, ("content", "root"))


def _grouped(fingerprinted: DataFrame, columns: tuple[str, ...], rooted: Callable[[DataFrame, DataFrame], DataFrame], more: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, columns, component_id, more); rooted makes (node, root) of the classes (columns, least, content, label) and of
    the fingerprinted rows with their label, only short ones where those are marked."""

    with text_batches(fingerprinted.sparkSession):
        fps = checkpointed_in_few(fingerprinted)
    content = "content" if "content" in fps.columns else F.lit(None).cast("long")
    classes = fps.groupBy(*columns).agg(F.min("id").alias("least"), F.min(content).alias("content"))
    classes = checkpointed_in_few(_labelled(classes, columns))
    short = fps.where("short is not null") if "short" in fps.columns else fps
    roots = rooted(classes, _labelled(short, columns)).select(F.col("node").alias("label"), "root")
    joined = classes.join(roots, "label", "left").select(*columns, "least", F.coalesce("root", "label").alias("root"))
    least = checkpointed_in_few(joined.groupBy("root").agg(F.min("least").alias("component_id")))
    named = checkpointed_in_few(joined.join(least, "root").select(*columns, "component_id", "root"))
    return fps.join(named, list(columns)).select(F.col("id").alias("doc_id"), *columns, "component_id", *more)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one document of each group of similar_groups, the one with the least id, all columns kept.

    Of a group's rows of that id one stays: of several texts the one with the least hash, of rows that differ elsewhere
    the one with the least hash of the row, so reruns agree. Rows of one id whose texts are in several groups are told
    apart by their text; rows with a null id can't be named as copies and stay. Null and empty texts are copies of
    each other. An empty table gives an empty result; columns may have any names.
    """
    groups = _similar_rows(docs, id_col, text_col, shingle, similarity)
    kept = groups.where(F.col("doc_id") == F.col("component_id")).groupBy("root").agg(F.min(F.struct("doc_id", "content")).alias("one"))
    kept = kept.select(F.col("one.doc_id").alias("id"), F.col("one.content").alias("content")).distinct()
    # the row goes as one struct, so that no column's name can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), _texts(docs, text_col)[1])
    named = rows.join(kept, ["id", "content"], "left_semi").groupBy("id", "content").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return named.select("row.*").unionByName(docs.where(F.col(id_col).isNull()))
