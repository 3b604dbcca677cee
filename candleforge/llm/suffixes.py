"""Repeated passages by sparse suffix arrays.

Of all suffixes of all documents only those at minimiser positions are retained: a position is a minimiser if
its seed, a run of `window // 2` words, has the least hash among the seeds of some window. Every window holds
one, at the same place wherever the window occurs. Retained suffixes whose seed repeats (a merged sketch of seed
counts drops most others, and no repeated one) travel with codes of the words that follow and precede the seed.
They are sorted, and neighbours are compared: the length that neighbours share to the right splits the sorted
order into blocks, nested by length; within a block, suffixes that also agree to the left belong to the same
window. So matches are extended to both sides, for all windows around a seed at once. Of those that agree, all
but the first occurrence are repeats.

Equal contexts are collapsed before they travel. A seed with more than `GROUP` contexts is not compared in
memory: its windows are grouped by hash with map-side aggregation instead, which is exact at any count.

A word's code has 32 bits, so a compared pair of different words is taken for equal with odds of 2^-32.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from candleforge.llm.common import binaries, checkpointed_in_few, chunks, in_few, mix, portions, text_batches
from candleforge.llm.substrings import CELLS, WINDOW, Windows, id_and_text, repeats, sketch

#: Contexts of one seed that are compared in memory, and suffixes that are compared together.
GROUP, TOGETHER = 1 << 15, 1 << 15
#: Suffixes of a task among which equal contexts are collapsed before they travel.
COLLAPSED = 10000

#: Retained suffixes; a row without a seed tells what repeats, from pos to hi.
_SENT = "seed long, right binary, left binary, id long, pos int, hi int"
_FOUND = "id long, lo int, hi int, h1 long, h2 long"


def minimisers(w: Windows) -> np.ndarray:
    """Positions, in the joined words, of the seeds that are least in some window of one text."""
    marks = w.marks()
    if not len(marks):
        return np.zeros(0, dtype=np.int64)
    runs = w.runs()
    span = w.window - w.window // 2 + 1
    # a seed is selected if the greatest mark of the windows around it is its own hash
    own = np.zeros(len(runs) + 2 * span, dtype=np.uint64)
    own[w.start + span] = marks
    n = -(-len(own) // span) * span + span
    blocks = np.concatenate([own, np.zeros(n - len(own), dtype=np.uint64)]).reshape(-1, span)
    ahead = np.maximum.accumulate(blocks, axis=1).ravel()
    behind = np.maximum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(len(runs))
    return np.flatnonzero(np.maximum(behind[p + 1], ahead[p + span]) == runs)


def _seed_items(w: Windows) -> np.ndarray:
    return w.runs()[minimisers(w)]


def suffix_rows(docs: DataFrame, bitmaps: Broadcast, window: int, cells: int, id_col: str, text_col: str) -> DataFrame:
    """Retained suffixes with their contexts: big-endian word codes, right ones forwards, left ones backwards.

    Equal contexts are collapsed as they are found, in the same process, so that only what is left goes through the JVM.
    """
    half = window // 2
    side = window - half

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmaps.value
        for batch in portions(batches, 2048):
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), binaries(batch.column("t"))
            for a, b in chunks(texts):
                w = Windows(texts[a:b], window)
                at = minimisers(w)
                if len(at):
                    seeds = w.runs()[at]
                    keep = repeats(bits, seeds, cells)
                    at, seeds = at[keep], seeds[keep]
                if not len(at):
                    continue
                codes = (w.codes >> np.uint64(32)).astype(">u4")
                text = np.searchsorted(w.begin, at, side="right") - 1
                first, last = w.begin[text], w.begin[text + 1]
                raw, back = codes.tobytes(), codes[::-1].tobytes()
                n = len(codes)
                rights = [raw[4 * i : 4 * j] for i, j in zip((at + half).tolist(), np.minimum(at + half + side, last).tolist())]
                lefts = [back[4 * (n - i) : 4 * (n - j)] for i, j in zip(at.tolist(), np.maximum(at - side, first).tolist())]
                own = ids[a:b][text].astype(np.int64)
                pos = (at - first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(seeds.view(np.int64)), pa.array(rights, pa.binary()), pa.array(lefts, pa.binary()), pa.array(own), pa.array(pos)], names=["seed", "right", "left", "id", "pos"])

    def sent(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, other = _collapsed(pa.Table.from_batches(held).combine_chunks(), window, side)
        for x in other:  # ride along as rows without a seed
            yield pa.RecordBatch.from_pydict({"seed": pa.nulls(x.num_rows, pa.int64()), "right": pa.nulls(x.num_rows, pa.binary()), "left": pa.nulls(x.num_rows, pa.binary()), "id": x.column("id"), "pos": x.column("lo"), "hi": x.column("hi")})
        for x in kept.combine_chunks().to_batches():
            yield pa.RecordBatch.from_arrays([*x.columns, pa.nulls(x.num_rows, pa.int32())], names=[*x.schema.names, "hi"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in portions(found(batches), COLLAPSED):
            held.append(batch)
            n += batch.num_rows
            if n >= COLLAPSED:
                yield from sent(held)
                held, n = [], 0
        if held:
            yield from sent(held)

    return id_and_text(docs.where(F.col(id_col).isNotNull()), id_col, text_col).mapInArrow(run, _SENT)


def _matrix(column: pa.Array, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes, padded with 0, and how many there are."""
    raw = column.to_pylist()
    sizes = np.array([len(x) for x in raw], dtype=np.int64) // 4
    return np.frombuffer(b"".join(x.ljust(4 * side, b"\0") for x in raw), dtype=">u4").reshape(-1, side).astype(np.uint32), sizes


def _prefix_hashes(codes: np.ndarray) -> np.ndarray:
    """Hash of the first 0, 1, ... codes of each row."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), dtype=np.uint64)
    for i in range(codes.shape[1]):
        out[:, i + 1] = mix(out[:, i] + codes[:, i].astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return out


class _Suffixes:
    """Suffixes sorted by seed and right context."""

    def __init__(self, table: pa.Table, side: int) -> None:
        self.side = side
        self.seed = table.column("seed").to_numpy()
        self.right, self.n_right = _matrix(table.column("right"), side)
        self.left, self.n_left = _matrix(table.column("left"), side)
        self.id, self.pos = table.column("id").to_numpy(), table.column("pos").to_numpy().astype(np.int64)

    def compare(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which, lo, hi): suffixes around which windows repeat, and the words, lo to hi, that these cover."""
        n, side = len(self.seed), self.side
        order = np.lexsort((self.pos, self.id))
        rank = np.empty(n, dtype=np.int64)  # of (id, pos), equal for equal pairs
        new = np.r_[False, (self.id[order][1:] != self.id[order][:-1]) | (self.pos[order][1:] != self.pos[order][:-1])]
        rank[order] = np.cumsum(new)
        differ = self.right[1:] != self.right[:-1]
        shared = np.where(differ.any(axis=1), differ.argmax(axis=1), side)
        shared = np.minimum(shared, np.minimum(self.n_right[1:], self.n_right[:-1]))
        shared[self.seed[1:] != self.seed[:-1]] = -1
        left = _prefix_hashes(self.left)
        far, near = np.full(n, -1), np.full(n, side + 1)
        for j in range(side + 1):  # windows that begin j words before the seed
            ok = np.flatnonzero((self.n_left >= j) & (self.n_right >= side - j))
            if len(ok) < 2:
                continue
            block = np.concatenate(([0], np.cumsum(shared < side - j)))[ok]
            by = np.lexsort((rank[ok], left[ok, j], block))
            b, h, r = block[by], left[ok, j][by], rank[ok][by]
            first = np.r_[True, (b[1:] != b[:-1]) | (h[1:] != h[:-1])]
            repeated = ok[by[r > r[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]]]
            far[repeated] = j
            near[repeated] = np.minimum(near[repeated], j)
        which = np.flatnonzero(far >= 0)
        return which, self.pos[which] - far[which], self.pos[which] - near[which]

    def windows(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(id, start, h1, h2) of every window around every suffix."""
        left, right = _prefix_hashes(self.left), _prefix_hashes(self.right)
        for j in range(self.side + 1):
            ok = np.flatnonzero((self.n_left >= j) & (self.n_right >= self.side - j))
            h1 = mix(self.seed[ok].view(np.uint64) + np.uint64(j))
            h2 = mix(left[ok, j] * np.uint64(3) + right[ok, self.side - j])
            yield self.id[ok], self.pos[ok] - j, h1.view(np.int64), h2.view(np.int64)


def _collapsed(table: pa.Table, window: int, side: int) -> tuple[pa.Table, list[pa.RecordBatch]]:
    """Distinct contexts, each at its first place, and what the other places cover."""
    seed, ids, pos = (table.column(c).to_numpy() for c in ("seed", "id", "pos"))
    right, left = table.column("right").to_pylist(), table.column("left").to_pylist()
    first: dict[tuple, int] = {}
    again = []
    for i, key in enumerate(zip(seed.tolist(), right, left)):
        k = first.setdefault(key, i)
        if k != i:
            if (ids[i], pos[i]) < (ids[k], pos[k]):
                first[key], k, i = i, i, k
            if (ids[i], pos[i]) != (ids[k], pos[k]):
                again.append(i)
    out = []
    if again:
        which = np.array(again)
        n_right = np.array([len(right[i]) // 4 for i in again])
        n_left = np.array([len(left[i]) // 4 for i in again])
        lo, hi = pos[which] - n_left, pos[which] - (side - n_right)
        fits = lo <= hi
        out.append(_found(ids[which][fits], lo[fits], hi[fits] + window))
    kept = np.zeros(table.num_rows, dtype=bool)
    kept[list(first.values())] = True
    return table.filter(pa.array(kept)), out


def _found(ids: np.ndarray, lo: np.ndarray, hi: np.ndarray, h1: np.ndarray | None = None, h2: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(ids), pa.int64())
    columns = [pa.array(ids, pa.int64()), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), none if h1 is None else pa.array(h1), none if h2 is None else pa.array(h2)]
    return pa.RecordBatch.from_arrays(columns, names=["id", "lo", "hi", "h1", "h2"])


def repeated_spans(docs: DataFrame, window: int = WINDOW, cells: int = CELLS, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, end, n_words): the maximal spans of words, end exclusive, that are covered by windows whose
    words, in order, also begin at an earlier place: in a document with a smaller id, or earlier in the same one.

    Words are runs of characters other than ASCII white space. Null and short texts have no windows. A row with a
    null id takes no part. Rows of one id are one document for the order: equal places do not repeat each other,
    and their spans are united. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    side = window - window // 2

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        n, spilt = 0, None  # spilt: a seed whose contexts are too many

        def flush(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows > 1:
                s = _Suffixes(table, side)
                which, lo, hi = s.compare()
                if len(which):
                    yield _found(s.id[which], lo, hi + window)

        def spill(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for ids, start, h1, h2 in _Suffixes(table, side).windows():
                yield _found(ids, start, start + window, h1, h2)

        for batch in batches:
            table = pa.Table.from_batches([batch])
            given = np.asarray(table.column("hi").is_valid())
            if given.any():
                done = table.filter(pa.array(given))
                yield _found(done.column("id").to_numpy(), done.column("pos").to_numpy(), done.column("hi").to_numpy())
                table = table.filter(pa.array(~given))
            table = table.drop_columns(["hi"])
            while table.num_rows:
                seed = table.column("seed").to_numpy()
                if spilt is not None:
                    stop = int(np.searchsorted(seed, spilt, side="right"))
                    if stop:
                        yield from spill(table.slice(0, stop))
                        table = table.slice(stop)
                    if table.num_rows:
                        spilt = None
                    continue
                held.append(table)
                n += table.num_rows
                table = table.slice(0, 0)
                if n >= TOGETHER:
                    every = pa.concat_tables(held)
                    seeds = every.column("seed").to_numpy()
                    cut = int(np.searchsorted(seeds, seeds[-1], side="left"))  # the last seed may go on
                    yield from flush(every.slice(0, cut))
                    rest = every.slice(cut)
                    if rest.num_rows > group:
                        spilt = seeds[-1]
                        yield from spill(rest)
                        rest = rest.slice(0, 0)
                    held, n = [rest], rest.num_rows
        if n:
            yield from flush(pa.concat_tables(held))
        held = []
        pa.default_memory_pool().release_unused()

    with text_batches(spark):
        bitmaps = spark.sparkContext.broadcast(sketch(docs, window, cells, id_col, text_col, _seed_items))
        rows = suffix_rows(docs, bitmaps, window, cells, id_col, text_col)
        # rows without a seed have their place spread by id
        dealt = rows.repartition(F.coalesce("seed", F.xxhash64("id", "pos"))).sortWithinPartitions("seed", "right")
        found = checkpointed_in_few(dealt.mapInArrow(compare, _FOUND))
    bitmaps.unpersist()
    windows = found.where(F.col("h1").isNotNull())
    # of the windows grouped by hash, all but the first place repeat
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("id", "lo")).alias("first"))
    late = windows.join(first, ["h1", "h2"]).where(F.struct("id", "lo") > F.col("first")).select("id", "lo", "hi")
    spans = found.where(F.col("h1").isNull()).select("id", "lo", "hi").unionByName(late)
    order = Window.partitionBy("id").orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.withColumn("new", F.when(before >= F.col("lo"), 0).otherwise(1)).withColumn("span", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = opened.groupBy("id", "span").agg(F.min("lo").alias("start"), F.max("hi").alias("end"))
    return in_few(merged.select(F.col("id").alias("doc_id"), "start", "end", (F.col("end") - F.col("start")).alias("n_words")))
