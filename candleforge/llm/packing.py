"""Best-fit packing with certified bin counts.

Texts become token pieces of at most one sequence, and pieces are packed by best-fit decreasing, partition by
partition. Dual-feasible functions give each partition a lower bound on its bins: one that meets it is certified, and
final. Partitions with a gap exchange: the pieces of their open bins (filled less than nearly full) are pooled over
fewer partitions and packed again, where bounds are computed anew, until all are certified, one partition holds the
pool, or a round saves no bin. Then the bound of the whole table decides: only if its bins are more than that, what
certified partitions left open is exchanged as well, as parts of bins may add up to whole ones. Each piece tells
the gap of the partition that packed it, so what is not certified can be seen.
"""

from __future__ import annotations

import json
import logging
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candleforge.llm.common import binaries, checkpointed, chunks, portions

log = logging.getLogger(__name__)

LENGTH = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Pieces that one partition packs at first, and at most as pools merge (rows of five numbers).
PARTITION_PIECES, MOST_PIECES = 1 << 16, 1 << 20
#: Bins with at most this share of their length free are not opened again.
NEARLY_FULL = 0.01
#: Distinct words after which a process keeps only what it has met since; it remembers up to twice as many.
CACHE_WORDS = 200_000
#: Words of letters that are encoded as one text.
JOINED = 128
#: The normalizer and pre-tokenizer of VOCABULARY: a word of Latin-1 letters is only lowered and written byte by byte.
STEPS = [
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
]

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_characters() -> np.ndarray:
    """The code point by which byte-level vocabularies write each byte; a space stays one, as it parts words here."""
    table = np.arange(256, dtype="<u4")
    unseen = np.r_[0:33, 127:161, 173]
    table[unseen] = 256 + np.arange(len(unseen))
    table[32] = 32
    return table


class WordTokenizer:
    """Ids of texts under a lower-casing tokenizer whose tokens never span white space, remembered per word.

    Words are split where str.split() does, ASCII letters lowered first, and between a letter or digit (to U+FFFF) and the
    ASCII sign that follows it, as the tokenizer splits there itself. Texts in which one of these steps could
    matter are encoded whole: those with the control characters that only Python takes for white space, with combining
    marks (they may compose with a lowered letter), or with the opening of a special token.

    Words of Latin-1 letters alone are one pre-token each, so many of them are encoded as one text: of a word's tokens
    the last one, and no other, has the suffix that ends words. If the tokenizer's steps before its model are STEPS, they
    are lowered and written as byte characters here, and only the model is asked.
    """

    _WHOLE = re.compile("[\x1c-\x1f\u0300-\u036f]|<\\|")
    _HINTS = (b"\x1c", b"\x1d", b"\x1e", b"\x1f", b"\xcc", b"\xcd", b"<|")  # without any of them in its UTF-8, a text does not match
    _SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
    _IS_SIGN = np.isin(np.arange(256), list(_SIGNS.encode()))
    _IS_CORE = np.array([unicodedata.normalize("NFC", chr(c)).lower()[-1].isalnum() for c in range(1 << 16)])  # some end in a mark once normalised or lowered
    _BYTES = _byte_characters()

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}  # what was known when the cache was last full
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        vocabulary = self.tokenizer.get_vocab() if suffix else {}
        self._closes = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
        self._closes[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        self._bare = None
        steps = [x and json.loads(x.__getstate__()) for x in (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)]
        if steps == STEPS:
            self._bare = Tokenizer(self.tokenizer.model)
            self._bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_letters(self, words: list[str]) -> list[bytes]:
        """_encode() of words that _letters() accepts; one by one if the tokens don't close as many words."""
        joined = [" ".join(words[at : at + JOINED]) for at in range(0, len(words), JOINED)]
        if self._bare:
            joined = [self._BYTES[np.frombuffer(t.lower().encode(), dtype=np.uint8)].tobytes().decode("utf-32-le") for t in joined]
        encoded = (self._bare or self.tokenizer).encode_batch_fast(joined, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, dtype="<u4"), *(np.array(e.ids, dtype="<u4") for e in encoded)])
        ends = (4 * (np.flatnonzero(self._closes[ids]) + 1)).tolist()
        if len(ends) != len(words):
            return self._encode(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *ends], ends)]

    @staticmethod
    def _letters(word: str) -> bool:
        return word.isalpha() and (word.isascii() or max(word) < "\u0100")

    def _learn(self, words: set[str]) -> None:
        letters = [w for w in words if w.isalpha()]
        joined = "".join(letters)
        if len(joined.encode("latin-1", "ignore")) < len(joined):
            letters = [w for w in letters if self._letters(w)]
        self.known.update(zip(letters, self._encode_letters(letters)))
        others = list(words.difference(letters))
        self.known.update(zip(others, self._encode(others)))

    def _split(self, raw: list[bytes]) -> list[list[str]]:
        """The words of texts given as UTF-8."""
        flat = np.frombuffer(b"\n".join(raw).lower(), dtype=np.uint8)
        signs = np.flatnonzero(self._IS_SIGN[flat[1:]]) + 1
        a, b, c = (flat[np.maximum(signs - k, 0)].astype(np.int32) for k in (3, 2, 1))
        point = np.where(c < 0x80, c, np.where(b >= 0xC0, (b & 0x1F) << 6 | c & 0x3F, np.where(a >= 0xE0, (a & 0x0F) << 12 | (b & 0x3F) << 6 | c & 0x3F, 0)))
        signs = signs[self._IS_CORE[point]]
        parted = np.insert(flat, signs, 32).tobytes()
        ends = np.cumsum([len(r) + 1 for r in raw]) - 1
        ends = (ends + np.searchsorted(signs, ends)).tolist()
        return [parted[a:b].decode().split() for a, b in zip([0, *(e + 1 for e in ends)], ends)]

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Token ids of each text, without an end id."""
        if len(self.known) > CACHE_WORDS:
            self.known, self._before = {}, self.known
        raw = [t.encode() for t in texts]
        whole = [i for i, r in enumerate(raw) if any(h in r for h in self._HINTS) and self._WHOLE.search(texts[i])]
        for i in whole:
            raw[i] = b""
        split = self._split(raw)
        found = [list(map(self.known.get, ws)) for ws in split]
        gaps = {i: [k for k, x in enumerate(own) if x is None] for i, own in enumerate(found) if None in own}
        unknown = {split[i][k] for i, places in gaps.items() for k in places}
        if unknown and self._before:
            met = unknown & self._before.keys()
            self.known.update((w, self._before[w]) for w in met)
            unknown -= met
        if unknown:
            self._learn(unknown)
        for i, places in gaps.items():
            for k in places:
                found[i][k] = self.known[split[i][k]]
        out = [np.frombuffer(b"".join(own), dtype="<u4") for own in found]
        for i in whole:
            out[i] = np.frombuffer(self._encode([texts[i]])[0], dtype="<u4")
        return out


@cache
def word_tokenizer(path: str) -> WordTokenizer:
    """One per Python process, so that tasks that follow each other share what is known."""
    return WordTokenizer(path)


def pieces(docs: DataFrame, path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Token pieces of every row of docs: doc_id, piece, start, length, ids_crc32, and the ids as binary if wanted.

    A document's ids end in one end id; null text is empty, so it is a piece of that id alone. Only documents
    longer than `length` are cut. Null ids and repeated rows keep their rows.
    """
    where = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = word_tokenizer(where)
        end = np.array([END_ID], dtype="<u4")
        for batch in portions(batches, 2048):
            keys, texts = batch.column("id").to_pylist(), binaries(batch.column("t"))
            for a, b in chunks(texts):
                rows: list[tuple] = []
                for key, ids in zip(keys[a:b], tokenizer.ids([t.decode("utf-8", "replace") for t in texts[a:b]])):
                    ids = np.concatenate([ids, end])
                    for k, at in enumerate(range(0, len(ids), length)):
                        raw = ids[at : at + length].tobytes()
                        rows.append((key, k, at, len(raw) // 4, zlib.crc32(raw), *([raw] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names[: 6 if with_ids else 5])

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    return source.mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int = LENGTH) -> int:
    """Bins that these lengths need at least: the best of two families of dual-feasible functions.

    One counts items over capacity - k as whole bins, items over half as sharing with small ones only, and
    ignores those under k. The other rounds (k + 1) * x to k parts.
    """
    if not len(lengths):
        return 0
    x = np.asarray(lengths, dtype=np.int64)
    best = -(-int(x.sum()) // capacity)
    count = np.bincount(x, minlength=capacity + 1)
    many, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    half, n = capacity // 2, int(many[-1])
    k = np.arange(1, half + 1)
    big = n - many[capacity - k]
    mid, mid_sum = many[capacity - k] - many[half], total[capacity - k] - total[half]
    small = total[half] - total[k - 1]
    best = max(best, int((big + mid + np.maximum(0, -((mid * capacity - mid_sum - small) // capacity))).max()))
    for k in range(1, 33):
        part = (k + 1) * x
        value = np.where(part % capacity == 0, x * k, (part // capacity) * capacity)  # in units of 1 / (k * capacity)
        best = max(best, -(-int(value.sum()) // (k * capacity)))
    return best


def best_fit(lengths: list[int], capacity: int = LENGTH) -> tuple[list[int], list[int]]:
    """(bin, offset) of each item, taken in the given order: the fullest bin that still has room."""
    free_mask, free_bins = 0, [[] for _ in range(capacity + 1)]
    bins, offsets, n = [], [], 0
    for size in lengths:
        room = free_mask >> size
        if room:
            free = size + (room & -room).bit_length() - 1
            b = free_bins[free].pop()
            if not free_bins[free]:
                free_mask &= ~(1 << free)
        else:
            free, b, n = capacity, n, n + 1
        bins.append(b)
        offsets.append(capacity - free)
        left = free - size
        if left:
            free_bins[left].append(b)
            free_mask |= 1 << left
    return bins, offsets


@dataclass(frozen=True)
class Certificate:
    """Bins used over all, and a proven lower bound."""

    bins: int
    bound: int


def _packed(pool: DataFrame, partitions: int, round_: int, capacity: int) -> DataFrame:
    """Each partition packs its own pieces; the order in which they arrive does not matter. full: whether the bin is
    nearly full; gap: the partition's bins beyond its lower bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [b for b in batches if b.num_rows]  # narrow rows, PARTITION_PIECES to MOST_PIECES on average
        if not own:
            return
        table = pa.Table.from_batches(own)
        order = [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")]
        table = table.sort_by(order)
        lengths = table.column("length").to_numpy()
        bins, offsets = best_fit(lengths.tolist(), capacity)
        bins = np.array(bins, dtype=np.int64)
        fill = np.bincount(bins, weights=lengths)
        bound = lower_bound(lengths, capacity)
        first = (round_ << 52) + (TaskContext.get().partitionId() << 28)
        n = table.num_rows
        yield from table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(np.array(offsets, dtype=np.int64))).append_column(
            "full", pa.array(fill[bins] >= capacity * (1 - NEARLY_FULL))
        ).append_column("gap", pa.array(np.full(n, len(fill) - bound, dtype=np.int64))).combine_chunks().to_batches()

    dealt = pool.repartition(partitions, "doc_id", "piece", "ids_crc32", F.lit(round_)) if partitions > 1 else pool.repartition(1)
    return dealt.mapInArrow(run, PIECE + ", sequence_id long, offset long, full boolean, gap long")


def _bins(packed: DataFrame) -> int:
    return packed.select("sequence_id").distinct().count()


def _exchanged(packed: DataFrame, taking: F.Column, partitions: int, round_: int, width: int, capacity: int) -> tuple[DataFrame, int]:
    """packed with the open bins of the partitions `taking` pooled and packed again, round by round, and the last round."""
    kept, left = packed.where(~(taking & ~F.col("full"))), packed.where(taking & ~F.col("full"))
    before, fell = _bins(left), True
    while before > 1 and partitions > 1:
        width = min(2 * width, max(width, MOST_PIECES))
        fewer = max(1, -(-left.count() // width))
        if fewer >= partitions and not fell:
            log.warning("packing: %d open bins remain in partitions with a gap; another exchange saves none", before)
            break
        partitions, round_ = min(partitions, fewer), round_ + 1
        again = checkpointed(_packed(left, partitions, round_, capacity))
        after = _bins(again)
        fell = after < before
        if after > before:  # as it was, which is better
            continue
        kept = kept.unionByName(again.where(~(taking & ~F.col("full"))))
        left = again.where(taking & ~F.col("full"))
        before = _bins(left)
    return kept.unionByName(left), round_


def pack(rows: DataFrame, capacity: int = LENGTH, partition_pieces: int = PARTITION_PIECES) -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids_crc32) with their sequence_id and offset; no sequence holds more
    than `capacity`. gap: bins of the partition that packed the piece beyond the lower bound, 0 if it is certified.

    The result does not depend on the order of rows; pieces of equal length are taken by id, piece and start. Null ids
    and repeated rows keep their pieces; an empty table gives an empty result; other columns are not read.
    """
    pool = checkpointed(rows.select("doc_id", "piece", "start", "length", "ids_crc32"))
    partitions = max(1, -(-pool.count() // partition_pieces))
    packed = checkpointed(_packed(pool, partitions, 0, capacity))
    if partitions > 1:
        packed, round_ = _exchanged(packed, F.col("gap") > 0, partitions, 0, partition_pieces, capacity)
        proof = certificate(packed, capacity)
        if proof.bins > proof.bound:
            packed, _ = _exchanged(packed, F.lit(True), partitions, round_, partition_pieces, capacity)
    return packed.drop("full")


def certificate(packed: DataFrame, capacity: int = LENGTH) -> Certificate:
    """Bins used and the lower bound for the whole table, from its histogram of at most `capacity` lengths."""
    bins = packed.select("sequence_id").distinct().count()
    histogram = packed.groupBy("length").agg(F.count("*").alias("n")).collect()
    return Certificate(bins, _bound_of({r.length: r.n for r in histogram}, capacity))


def _bound_of(histogram: dict[int, int], capacity: int) -> int:
    """lower_bound() of a histogram; counts too large to expand are scaled down, which only rounds the bound down."""
    total = sum(histogram.values())
    scale = max(1, total // 4_000_000)
    lengths = np.repeat(list(histogram), [n // scale for n in histogram.values()]) if histogram else np.zeros(0, dtype=int)
    exact = -(-sum(k * n for k, n in histogram.items()) // capacity)
    return max(exact, lower_bound(lengths, capacity) * scale if scale == 1 else max(0, lower_bound(lengths, capacity) - 1) * scale)


def pack_documents(docs: DataFrame, path: str | None = None, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenise and pack every row of docs: the rows of pack().

    Null text is empty, and an empty text is a piece of its end id; null ids and repeated rows keep their pieces; texts of
    any length are cut only where they exceed a sequence. An empty table gives an empty result; other columns are not
    read, whatever their names.
    """
    return pack(pieces(docs, path, length, id_col, text_col), length)
