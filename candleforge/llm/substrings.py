"""Removal of repeated passages with a count-min prefilter.

A window is `window` consecutive words. Every window has a *mark*: the least hash of the half-windows (runs of
`window // 2` words) in it. Equal windows have equal marks, so in how many documents a mark occurs bounds from
above in how many its window does. One pass counts marks, once per document, in count-min sketches, one per
task, which are merged cell by cell; a cell only needs to tell 0, 1 and "2 or more". A sketch that is too small
for a table lets more windows through and loses none.

The second pass groups, exactly, the windows whose mark is estimated to repeat. Neighbouring windows of one mark
form a *stretch*, and these are grouped first, by mark and content: all windows of a stretch that an earlier
document also has are repeated. Only the first document of each stretch remains, and only where its mark occurs
with several contents; there the windows themselves, with 128-bit hashes, are grouped. Copies of documents thus
end at a few rows for each stretch, and only the edges of what differs are grouped window by window.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.llm.common import Rolling, binaries, checkpointed_in_few, chunks, in_few, mix, portions, text_batches, word_hashes

WINDOW = 50
#: Cells in each of the two rows of the sketch, as a power of two; a merged row is a bitmap of 2^CELLS / 8 bytes.
CELLS = 26
_SLICE = 20  # cells of a slice, the unit in which sketches travel and merge
_ROWS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


_PARTS = "slice int, part int, cells binary"


class Windows:
    """Words of some texts, one after another, and the hashes of runs within a text."""

    _first = Rolling(0x5851F42D4C957F2D)
    _second = Rolling(0x14057B7EF767814F)

    def __init__(self, texts: list[bytes], window: int) -> None:
        self.window = window
        self.words = [t.split() for t in texts]
        self.sizes = np.array([len(w) for w in self.words], dtype=np.int64)
        self.begin = np.concatenate(([0], np.cumsum(self.sizes)))
        n = int(self.begin[-1])
        self.codes = hashes = word_hashes((w for own in self.words for w in own), n)
        self._p, self._q = self._first.prefix(hashes), self._second.prefix(hashes)
        # starts of windows that stay within their text, and the text of each
        counts = np.maximum(self.sizes - window + 1, 0)
        self.text = np.repeat(np.arange(len(texts)), counts)
        self.start = np.repeat(self.begin[:-1], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)

    def marks(self) -> np.ndarray:
        """The mark of each window: a sliding minimum over the half-window hashes, by block-wise running minima."""
        half = self.window // 2
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        runs = self.runs()
        n = len(runs)
        span = self.window - half + 1
        padded = np.full(-(-n // span) * span + span, np.iinfo(np.uint64).max, dtype=np.uint64)
        padded[:n] = runs
        blocks = padded.reshape(-1, span)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        return np.minimum(right[self.start], left[self.start + span - 1])

    def runs(self) -> np.ndarray:
        """The hash of each half-window, those across two texts included."""
        half = self.window // 2
        return self._first.at(self._p, np.arange(max(0, int(self.begin[-1]) - half + 1)), half)

    def stretches(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Neighbouring windows of one mark: (first window, number of windows, mark, content hash) of each."""
        marks = self.marks()
        if not len(marks):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none.view(np.uint64), none.view(np.uint64)
        first = np.flatnonzero(np.r_[True, (marks[1:] != marks[:-1]) | (self.text[1:] != self.text[:-1])])
        many = np.diff(np.r_[first, len(marks)])
        content = self._second.at(self._q, self.start[first], many + self.window - 1)
        return first, many, marks[first], mix(content + many.astype(np.uint64))

    def hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit hashes of some windows."""
        s = self.start[which]
        return self._first.at(self._p, s, self.window), self._second.at(self._q, s, self.window)


def _cells(marks: np.ndarray, cells: int) -> list[np.ndarray]:
    return [(marks * factor) >> np.uint64(64 - cells) for factor in _ROWS]


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))


def _merge(parts: DataFrame) -> DataFrame:
    """Add sketches slice by slice; a task holds one array per slice however many parts arrive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for slice_, raw in zip(batch.column("slice").to_pylist(), batch.column("cells").to_pylist()):
                packed = np.frombuffer(raw, dtype="<u4")
                cell, count = packed >> np.uint32(2), (packed & np.uint32(3)).astype(np.uint8)
                total = held.setdefault(slice_, np.zeros(1 << _SLICE, dtype=np.uint8))
                total[cell] = np.minimum(total[cell] + count, 2)
        for slice_, total in held.items():
            cell = np.flatnonzero(total).astype(np.uint32)
            yield pa.RecordBatch.from_pydict({"slice": pa.array([slice_], pa.int32()), "part": pa.array([0], pa.int32()), "cells": [((cell << np.uint32(2)) | total[cell]).astype("<u4").tobytes()]})

    return parts.mapInArrow(run, _PARTS)


class _Counts:
    """Saturating counts of cells, held as sorted cells: they take room for what a task has seen, not for all cells."""

    def __init__(self, most_pending: int = 1 << 20) -> None:
        self.cell, self.count = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.uint8)
        self._pending: list[np.ndarray] = []
        self._n, self._most = 0, most_pending

    def add(self, cells: np.ndarray) -> None:
        self._pending.append(cells.astype(np.uint32))
        self._n += len(cells)
        if self._n > self._most:
            self.settle()

    def settle(self) -> None:
        new = np.sort(np.concatenate([self.cell, self.cell[self.count > 1], *self._pending]))
        first = np.flatnonzero(np.r_[True, new[1:] != new[:-1]]) if len(new) else np.zeros(0, dtype=np.int64)
        self.cell, self.count = new[first], np.minimum(np.diff(np.r_[first, len(new)]), 2).astype(np.uint8)
        self._pending, self._n = [], 0


def marks_once(w: Windows) -> np.ndarray:
    """The marks of each text, each once per text."""
    marks = w.marks()
    if not len(marks):
        return marks
    order = np.lexsort((marks, w.text))
    m, d = marks[order], w.text[order]
    return m[np.r_[True, (m[1:] != m[:-1]) | (d[1:] != d[:-1])]]


def sketch(docs: DataFrame, window: int = WINDOW, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text", items: Callable[[Windows], np.ndarray] = marks_once) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps: cells that two or more items fall into; items are the marks of documents, unless given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [_Counts() for _ in _ROWS]
        for batch in portions(batches, 2048):
            texts = binaries(batch.column("t"))
            for a, b in chunks(texts):
                for row, cell in zip(counts, _cells(items(Windows(texts[a:b], window)), cells)):
                    row.add(cell)
        yield from _sliced(counts, cells)

    parts = id_and_text(docs.where(F.col(id_col).isNotNull()), id_col, text_col).mapInArrow(run, _PARTS)
    return _bitmaps(parts, cells, 2)


def _sliced(counts: list[_Counts], cells: int) -> Iterator[pa.RecordBatch]:
    """A task's counts, slice by slice."""
    per_row = 1 << (cells - _SLICE)
    part = TaskContext.get().partitionId() % 32
    for r, row in enumerate(counts):
        row.settle()
        edges = np.searchsorted(row.cell, np.arange(per_row + 1, dtype=np.int64) << _SLICE)
        for s, (i, j) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())):
            if i < j:
                raw = (((row.cell[i:j] & np.uint32((1 << _SLICE) - 1)) << np.uint32(2)) | row.count[i:j]).astype("<u4").tobytes()
                yield pa.RecordBatch.from_pydict({"slice": pa.array([r * per_row + s], pa.int32()), "part": pa.array([part], pa.int32()), "cells": [raw]})


def _bitmaps(parts: DataFrame, cells: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge sketches; cells counted `least` times or more, one bitmap for each row of the sketch."""
    merged = _merge(_merge(parts.repartition("slice", "part")).repartition("slice"))

    def bitmap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for raw in batch.column("cells").to_pylist():
                packed = np.frombuffer(raw, dtype="<u4")
                many = np.zeros(1 << _SLICE, dtype=bool)
                many[packed[packed & np.uint32(3) >= least] >> np.uint32(2)] = True
                bits.append(np.packbits(many, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("slice"), pa.array(bits, pa.binary())], names=["slice", "bits"])

    out = np.zeros((len(_ROWS), (1 << cells) >> 3), dtype=np.uint8)
    size = 1 << (_SLICE - 3)
    for r in merged.mapInArrow(bitmap, "slice int, bits binary").toLocalIterator():  # slices of a size fixed by `cells`
        row, s = divmod(r.slice, 1 << (cells - _SLICE))
        out[row, s * size : (s + 1) * size] = np.frombuffer(r.bits, dtype=np.uint8)
    return out[0], out[1]


def membership(keys: DataFrame, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Two bitmaps in which every key (key long) is found, and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [_Counts() for _ in _ROWS]
        for batch in batches:
            for row, cell in zip(counts, _cells(batch.column("key").to_numpy(zero_copy_only=False).view(np.uint64), cells)):
                row.add(cell)
        yield from _sliced(counts, cells)

    return _bitmaps(keys.mapInArrow(run, _PARTS), cells, 1)


def repeats(bitmaps: tuple[np.ndarray, np.ndarray], marks: np.ndarray, cells: int) -> np.ndarray:
    """Whether each mark is estimated to be counted twice or more."""
    ok = np.ones(len(marks), dtype=bool)
    for bits, cell in zip(bitmaps, _cells(marks, cells)):
        ok &= (bits[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return ok


def _key(mark: np.ndarray, content: np.ndarray) -> np.ndarray:
    """One number for a stretch, used within a document."""
    return mix(mark + content * np.uint64(0x9E3779B97F4A7C15))


def _place(key: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number for a stretch of a document."""
    return mix(key + ids.view(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def candidate_stretches(docs: DataFrame, bitmaps: Broadcast, window: int = WINDOW, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(mark, content, id): the distinct stretches of each document whose mark is estimated to repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmaps.value
        for batch in portions(batches, 2048):
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), binaries(batch.column("t"))
            for a, b in chunks(texts):
                w = Windows(texts[a:b], window)
                first, _, mark, content = w.stretches()
                which = np.flatnonzero(repeats(bits, mark, cells)) if len(mark) else np.zeros(0, dtype=np.int64)
                if len(which):
                    own = ids[a:b][w.text[first[which]]].astype(np.int64)
                    rows = np.unique(np.stack([mark[which].view(np.int64), content[which].view(np.int64), own]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], names=["mark", "content", "id"])

    return id_and_text(docs.where(F.col(id_col).isNotNull()), id_col, text_col).mapInArrow(run, "mark long, content long, id long")


def _windows_of(docs: DataFrame, places: Broadcast, window: int, cells: int, id_col: str, text_col: str) -> DataFrame:
    """(h1, h2, id): the distinct windows of the stretches whose place is in the bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = places.value
        for batch in portions(batches, 2048):
            ids, texts = batch.column("id").to_numpy(zero_copy_only=False), binaries(batch.column("t"))
            for a, b in chunks(texts):
                w = Windows(texts[a:b], window)
                first, many, mark, content = w.stretches()
                if not len(first):
                    continue
                own = ids[a:b].astype(np.int64)
                hit = np.flatnonzero(repeats(bits, _place(_key(mark, content), own[w.text[first]]), cells))
                if not len(hit):
                    continue
                n = many[hit]
                which = np.repeat(first[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                h1, h2 = w.hashes(which)
                d = w.text[which]
                order = np.lexsort((h2, h1, d))
                h1, h2, d = h1[order], h2[order], d[order]
                once = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (d[1:] != d[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(h1[once].view(np.int64)), pa.array(h2[once].view(np.int64)), pa.array(own[d[once]])], names=["h1", "h2", "id"])

    return id_and_text(docs.where(F.col(id_col).isNotNull()), id_col, text_col).mapInArrow(run, "h1 long, h2 long, id long")


def _keyed(rows: DataFrame) -> DataFrame:
    """rows (mark, content, id) as (key, place, id): the numbers of _key() and _place()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mark, content, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mark", "content", "id"))
            key = _key(mark.view(np.uint64), content.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(_place(key, ids).view(np.int64)), batch.column("id")], names=["key", "place", "id"])

    return rows.mapInArrow(run, "key long, place long, id long")


def remove_repeats(docs: DataFrame, window: int = WINDOW, cells: int = CELLS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row of docs.

    Words are runs of characters other than ASCII white space. Removed is each word in a window whose words, in
    order, also start in a document with a smaller id; windows are judged on the input. kept_text joins the rest
    by single spaces. Null text has no words. A null id is neither smaller nor larger than another, so its row
    loses nothing and removes nothing; rows of one id do not remove each other's words. An empty table gives an
    empty result; other columns are not read.
    """
    spark = docs.sparkSession
    with text_batches(spark):
        bitmaps = spark.sparkContext.broadcast(sketch(docs, window, cells, id_col, text_col))  # 2^cells / 4 bytes
        stretches = checkpointed_in_few(candidate_stretches(docs, bitmaps, window, cells, id_col, text_col))
    owners = checkpointed_in_few(stretches.groupBy("mark", "content").agg(F.min("id").alias("first"), F.max("id").alias("last")))
    late = stretches.join(owners, ["mark", "content"]).where(F.col("id") > F.col("first"))
    # marks with several contents, in several documents: the first document of each content is judged by windows
    mixed = owners.groupBy("mark").agg(F.count("*").alias("n"), F.min("first").alias("lo"), F.max("last").alias("hi")).where((F.col("n") > 1) & (F.col("lo") < F.col("hi")))
    judged = owners.join(checkpointed_in_few(mixed.select("mark")), "mark").select("mark", "content", F.col("first").alias("id"))
    places = spark.sparkContext.broadcast(membership(_keyed(judged).select(F.col("place").alias("key")), cells))
    with text_batches(spark):
        windows = checkpointed_in_few(_windows_of(docs, places, window, cells, id_col, text_col))
    starts = windows.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    starts = checkpointed_in_few(starts.where(F.col("first") < F.col("last")))
    again = windows.join(starts, ["h1", "h2"]).where(F.col("id") > F.col("first"))
    gone = _keyed(late.select("mark", "content", "id")).select("id", F.col("key").alias("stretch"), F.lit(None).cast("long").alias("h1"))
    gone = gone.unionByName(again.select("id", F.lit(None).cast("long").alias("stretch"), "h1"))
    lists = gone.groupBy("id").agg(F.collect_list("stretch").alias("stretches"), F.collect_list("h1").alias("gone"))  # at most the windows of one document
    rows = id_and_text(docs, id_col, text_col).join(lists, "id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in portions(batches, 2048):
            ids, texts, gone = batch.column("id"), binaries(batch.column("t")), batch.column("gone")
            runs = batch.column("stretches")
            for a, b in chunks(texts):
                w = Windows(texts[a:b], window) if gone.slice(a, b - a).null_count < b - a else None
                sizes, removed, kept = [], [], []
                if w is not None:
                    first = np.searchsorted(w.text, np.arange(b - a + 1))
                    begin, many, mark, content = w.stretches()
                    keys = _key(mark, content)
                for i in range(a, b):
                    words = texts[i].split()
                    n = len(words)
                    if w is not None and gone[i].is_valid:
                        own = np.arange(first[i - a], first[i - a + 1])
                        hit = w.start[own][np.isin(w.hashes(own)[0], gone[i].values.to_numpy(zero_copy_only=False).view(np.uint64))] - w.begin[i - a]
                        k = slice(*np.searchsorted(w.text[begin], [i - a, i - a + 1]))
                        whole = np.flatnonzero(np.isin(keys[k], runs[i].values.to_numpy(zero_copy_only=False).view(np.uint64)))
                        from_ = w.start[begin[k]][whole] - w.begin[i - a]
                        cover = np.zeros(n + 1, dtype=np.int64)
                        np.add.at(cover, hit, 1)
                        np.add.at(cover, hit + window, -1)
                        np.add.at(cover, from_, 1)
                        np.add.at(cover, from_ + many[k][whole] + window - 1, -1)
                        stay = np.cumsum(cover[:-1]) == 0
                        words = [x for x, s in zip(words, stay.tolist()) if s]
                    sizes.append(n)
                    removed.append(n - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return in_few(rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string"))
