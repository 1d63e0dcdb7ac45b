"""Evaluation texts inside training texts: SimHash of windows, multi-index lookup, exact verification.

Every window of ``window`` words of an item is a leak unit, so windows of that size are fingerprinted in items and
documents alike. A fingerprint has 64 bits; the bit counts of a window come from running sums of packed 4-bit counters,
so a window costs a few additions whatever its size. Fingerprints are cut into ``radius + 1`` blocks; two
fingerprints within the radius agree in at least one block, so a lookup by block misses none. What agrees is
verified by weighted-shingle similarity: the share of equal words, place by place, weighted by
``weights``; a similarity of 1 is the same ten words in the same order.

The items are a held-out set, of fixed size; they are taken in blocks of at most ``block_windows`` windows, each
of which is looked up in one pass over all documents, so nothing that is sent to the executors grows beyond that. A longer item is cut into parts that
share a window less one word, so that no window is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodespark.functions.text import WORD, WordHashes, hashed_words, inside, mix
from lodespark.session import spread

_BITMAP = 1 << 22


def _lanes(word_hash: np.ndarray) -> list[np.ndarray]:
    """Four words of sixteen 4-bit lanes: lane b of part p has bit ``4 * b + p`` of the word's hash."""
    every4 = np.uint64(0x1111111111111111)
    h = mix(word_hash + np.uint64(0xA5A5))
    return [(h >> np.uint64(p)) & every4 for p in range(4)]


def window_fingerprints(flat: np.ndarray, window: int) -> np.ndarray:
    """SimHash of the ``window`` words (at most 15) from each position on."""
    n = len(flat) - window + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # A lane's count is more than half of the window iff the count and ``add`` reach 8.
    add = np.uint64(0x1111111111111111) * np.uint64(8 - (window + 2) // 2)
    top = np.uint64(0x8888888888888888)
    out = np.zeros(n, np.uint64)
    for p, lane in enumerate(_lanes(flat)):
        run = np.concatenate([[np.uint64(0)], np.cumsum(lane, dtype=np.uint64)])
        count = run[window:] - run[:-window]  # exact: lanes never exceed 15, and sums wrap alike
        out |= ((count + add) & top) >> np.uint64(3 - p)
    return out


class ItemIndex:
    """Item windows by fingerprint block."""

    def __init__(self, items: list[tuple[int, str]], window: int, radius: int):
        flat, off = hashed_words([t for _, t in items], WordHashes())
        at, doc = inside(off, window)
        ids = np.array([i for i, _ in items], np.int64)
        self.window, self.radius = window, radius
        self.words = flat[at[:, None] + np.arange(window)[None, :]] if len(at) else np.zeros((0, window), np.uint64)
        self.item = ids[doc] if len(at) else np.zeros(0, np.int64)
        self.fp = window_fingerprints(flat, window)[at] if len(at) else np.zeros(0, np.uint64)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for lo, hi in zip(edges, edges[1:]):
            value = self._block(self.fp, int(lo), int(hi))
            order = np.argsort(value, kind="stable")
            bitmap = np.zeros(_BITMAP, bool)
            bitmap[self._slot(value)] = True
            self.blocks.append((int(lo), int(hi), value[order], order, bitmap))

    @staticmethod
    def _block(fp: np.ndarray, lo: int, hi: int) -> np.ndarray:
        return fp if hi - lo == 64 else (fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1)

    @staticmethod
    def _slot(value: np.ndarray) -> np.ndarray:
        return ((value ^ (value >> np.uint64(22)) ^ (value >> np.uint64(43))) & np.uint64(_BITMAP - 1)).astype(np.int64)

    def near(self, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in ``fp``, item window) within the radius; a pair may come more than once."""
        qs, ws = [], []
        for lo, hi, value, order, bitmap in self.blocks:
            mine = self._block(fp, lo, hi)
            q = np.flatnonzero(bitmap[self._slot(mine)])
            left, right = np.searchsorted(value, mine[q], "left"), np.searchsorted(value, mine[q], "right")
            c = right - left
            q, left, c = q[c > 0], left[c > 0], c[c > 0]
            if not len(q):
                continue
            first = np.concatenate([[0], np.cumsum(c)[:-1]])
            w = order[np.arange(c.sum()) - np.repeat(first, c) + np.repeat(left, c)]
            q = np.repeat(q, c)
            ok = np.bitwise_count(fp[q] ^ self.fp[w]) <= self.radius
            qs.append(q[ok])
            ws.append(w[ok])
        return (np.concatenate(qs), np.concatenate(ws)) if qs else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _search(index: ItemIndex, similarity: float, weights: np.ndarray):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("n_windows", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            flat, off = hashed_words(batch.column(1).to_pylist(), cache)
            fp = window_fingerprints(flat, index.window)
            q, w = index.near(fp)
            if len(q):
                doc = np.searchsorted(off, q, "right") - 1
                whole = q + index.window <= off[doc + 1]
                q, w, doc = q[whole], w[whole], doc[whole]
                same = flat[q[:, None] + np.arange(index.window)[None, :]] == index.words[w]
                ok = same @ weights >= similarity - 1e-9
                hits = np.unique(np.stack([doc[ok], index.item[w[ok]], q[ok]], axis=1), axis=0)
                pairs, n = np.unique(hits[:, :2], axis=0, return_counts=True)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(n.astype(np.int64))], schema=schema)

    return run


def _parts(text: str, window: int, most: int) -> Iterator[tuple[str, int]]:
    """The text, or parts of it, with no more than ``most`` windows each, and how many they have; no window is lost or comes twice."""
    spans = [m.span() for m in WORD.finditer(text)]
    for first in range(0, max(len(spans) - window + 1, 0), most):
        last = min(first + most + window - 1, len(spans))
        yield text[spans[first][0] : spans[last - 1][1]], last - first - window + 1


def leaked_items(
    docs: DataFrame, items: DataFrame, doc_key: str, text: str, item_key: str, item_text: str,
    window: int = 10, radius: int = 1, similarity: float = 1.0, weights: list[float] | None = None, block_windows: int = 200_000,
) -> DataFrame:
    """``doc_id, item_id, n_windows``: each document and the items of which it has at least one window.

    ``doc_key`` and ``item_key`` are integer columns, ``text`` and ``item_text`` strings; other columns are ignored.
    Null keys and texts, and texts shorter than the window, give no rows. An item that comes twice
    counts once. ``n_windows`` is the number of places in the document (of an item of more than ``block_windows`` windows, by parts of it). Empty
    tables give an empty result.
    """
    if not 1 <= window <= 15:
        raise ValueError("a window has 1 to 15 words")
    w = np.array(weights if weights is not None else [1.0] * window)
    w = w / w.sum()
    rows = docs.select(F.col(doc_key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    rows = spread(rows, "doc_id")
    wanted = items.select(F.col(item_key).cast("long").alias("i"), F.col(item_text).alias("t")).filter("i is not null and t is not null").dropDuplicates(["i", "t"])
    found, part, size = [], [], 0
    flush = lambda: found.append(rows.mapInArrow(_search(ItemIndex(part, window, radius), similarity, w), "doc_id long, item_id long, n_windows long"))
    for r in wanted.toLocalIterator():  # the stated query set, block by block
        for text_part, n in _parts(r["t"], window, block_windows):
            if size + n > block_windows:
                flush()
                part, size = [], 0
            part.append((r["i"], text_part))
            size += n
    if part or not found:
        flush()
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("doc_id", "item_id").agg(F.sum("n_windows").alias("n_windows"))
