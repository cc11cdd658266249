"""Benchmark decontamination by fingerprints of item-sized windows.

Every window of a document that has as many words as a benchmark item is a candidate for that item. Windows without
any shingle of an item of their size have similarity zero and are passed over; the others get a 64-bit SimHash of
their word shingles (from running bit counts). A multi-index finds all items of that size whose fingerprints differ
in ``RADIUS`` bits or fewer: 64 bits are cut into ``BLOCKS`` blocks, at least one of which then differs in
RADIUS // BLOCKS bits or fewer; the different values of each block are listed with their items. Candidates are verified by
the exact similarity of weighted shingles (the weight of a shingle is its number): sum of minima over sum of maxima.

A text of fewer words than an item has no such window; all of it is then compared to the item in the same way, if it is
not too short to be as similar.

Items are taken in blocks of ``BLOCK_ITEMS`` and ``BLOCK_BYTES`` at most, each of which is sent to all tasks; every block
meets every document, so a million items of 300 bytes take some 36 passes.

Cases: words are lower-cased (A-Z); texts and items without words never match; an item of fewer words than a shingle
is one shingle; nulls are empty; repeated rows and items each give their own pairs; no items, no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, slices, text_buffer, text_bytes, window_hashes, word_table

SHINGLE_WORDS = 5
MIN_SIMILARITY = 0.8
#: Sets of similarity 0.8 differ in 9.7 of 64 bits on average, with a deviation of 2.9.
RADIUS = 19
BLOCKS = 4
#: Items, and bytes of them, that are sent to all tasks at a time; an index of them takes some 64 bytes a word.
BLOCK_ITEMS = 50_000
BLOCK_BYTES = 8 << 20
#: Pairs of a window and a block value that are compared at a time.
COMPARED = 1 << 22
#: Shingles of windows that are fingerprinted at a time, at 320 bytes each.
WINDOW_WORDS = 1 << 18


def simhashes(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """SimHashes of h[s : s + length]: a bit is 1 if set in over half of them."""
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(bits, axis=0, out=ones[1:], dtype=np.int32)
    return np.packbits(2 * (ones[starts + length] - ones[starts]) > length, axis=1, bitorder="little").view(np.uint64).ravel()


def block_of(fps: np.ndarray, k: int) -> np.ndarray:
    width = 64 // BLOCKS
    return (fps >> np.uint64(k * width) & np.uint64((1 << width) - 1)).astype(np.uint16)


def common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> int:
    """The sum of the lesser weights of two weighted sets (sorted values, weights)."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    return int(np.minimum(a[1], b[1][at])[b[0][at] == a[0]].sum())


class ItemIndex:
    """Items by size, with the multi-index of their fingerprints."""

    def __init__(self, items: list[tuple[int | None, bytes]], shingle: int = SHINGLE_WORDS, radius: int = RADIUS):
        self.shingle, self.radius = shingle, radius
        self.ids, self.sizes, self.shingles, fps = [], [], [], []
        for item_id, text in items:
            row, _, _, h = word_table(np.frombuffer(text, np.uint8), np.array([0, len(text)]), lower=True)
            if len(h):
                _, s = window_hashes(row, h, min(shingle, len(h)))
                self.ids.append(item_id)
                self.sizes.append(len(h))
                self.shingles.append(np.unique(s, return_counts=True))
                fps.append(int(simhashes(s, np.zeros(1, np.int64), len(s))[0]))
        self.fps = np.array(fps, np.uint64)
        self.by_size = {n: np.flatnonzero(np.array(self.sizes) == n) for n in sorted(set(self.sizes))}
        self.of_size = {n: np.unique(np.concatenate([self.shingles[i][0] for i in at])) for n, at in self.by_size.items()}
        self.any = {k: np.unique(np.concatenate(v)) for k in range(1, shingle + 1) if (v := [s for n, s in self.of_size.items() if min(n, shingle) == k])}
        self.seen = {k: self._filter(v) for k, v in self.any.items()}
        self.tables = {n: [self._table(at, k) for k in range(BLOCKS)] for n, at in self.by_size.items()}

    def _table(self, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(values, first, items): the different values of a block, and where the items of each begin."""
        own = block_of(self.fps[at], k)
        order = np.argsort(own, kind="stable")
        values, first = np.unique(own[order], return_index=True)
        return values, np.append(first, len(at)), at[order]

    @staticmethod
    def _filter(hashes: np.ndarray) -> np.ndarray:
        flags = np.zeros(1 << 20, bool)
        flags[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return flags

    def hits(self, h: np.ndarray, k: int) -> np.ndarray:
        """Places of h, hashes of k words, that some item has."""
        at = np.flatnonzero(self.seen[k][(h >> np.uint64(44)).astype(np.int64)])
        return at[np.isin(h[at], self.any[k])]

    def near(self, size: int, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (place in fps, item) of that size within the radius; a block of such a pair differs in radius // BLOCKS bits at most."""
        pairs = []
        for k, (values, first, items) in enumerate(self.tables[size]):
            step = max(1, COMPARED // len(values))
            for at in range(0, len(fps), step):
                own = block_of(fps[at : at + step], k)
                q, v = np.nonzero(np.bitwise_count(own[:, None] ^ values[None, :]) <= self.radius // BLOCKS)
                n = first[v + 1] - first[v]
                i = items[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[v], n)]
                q = np.repeat(q + at, n)
                close = np.bitwise_count(fps[q] ^ self.fps[i]) <= self.radius
                pairs.append(np.stack((q[close], i[close])))
        q, i = np.unique(np.concatenate(pairs, axis=1), axis=1)
        return q, i

    def matches(self, data: np.ndarray, offsets: np.ndarray, min_similarity: float) -> dict[tuple[int, int], tuple[float, int, int]]:
        """(row, item) -> (best similarity, first word of that window, windows)."""
        row, _, _, h = word_table(data, offsets, lower=True)
        row_start = np.searchsorted(row, np.arange(len(offsets)))
        out: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k in self.any:
            at, s = window_hashes(row, h, k)
            found = self.hits(s, k)
            if not len(found):
                continue
            for size, hashes in self.of_size.items():
                if min(size, self.shingle) != k:
                    continue
                n = size - k + 1  # shingles of a window
                own = at[found[np.isin(s[found], hashes)]]
                if not len(own):
                    continue
                self._short(out, row, row_start, h, at, s, own, k, size, min_similarity)
                flag = np.zeros(len(h) + 1, np.int64)
                np.add.at(flag, np.maximum(own - n + 1, row_start[row[own]]), 1)
                np.add.at(flag, own + 1, -1)
                w = np.flatnonzero(np.cumsum(flag) > 0)
                w = w[w + size <= row_start[row[w] + 1]]
                whole = np.zeros(len(h), np.uint64)
                whole[at] = s
                for part in np.array_split(w, max(1, -(-len(w) * n // WINDOW_WORDS))):
                    self._verify(out, row, row_start, whole, part, n, size, min_similarity)
        return out

    def _short(self, out: dict, row: np.ndarray, row_start: np.ndarray, h: np.ndarray, at: np.ndarray, s: np.ndarray, own: np.ndarray, k: int, size: int, min_similarity: float) -> None:
        """Texts of fewer words than the item, each as one window."""
        rows = np.unique(row[own])
        words = row_start[rows + 1] - row_start[rows]
        able = (words < size) & (words - k + 1 >= min_similarity * (size - k + 1) - 1e-9)
        if not able.any():
            return
        whole = np.zeros(len(h), np.uint64)
        whole[at] = s
        for m in np.unique(words[able]).tolist():
            self._verify(out, row, row_start, whole, row_start[rows[able & (words == m)]], m - k + 1, size, min_similarity)

    def _verify(self, out: dict, row: np.ndarray, row_start: np.ndarray, whole: np.ndarray, w: np.ndarray, n: int, size: int, min_similarity: float) -> None:
        if not len(w):
            return
        # the shingles under the windows, each run of windows once
        gap = np.flatnonzero(np.diff(w) >= n) + 1
        lengths = np.diff(np.concatenate(([0], gap, [len(w)])))
        first, last = w[np.concatenate(([0], gap))], w[np.concatenate((gap - 1, [len(w) - 1]))] + n
        spans = last - first
        base = np.concatenate(([0], np.cumsum(spans)))[:-1]
        place = np.arange(spans.sum()) - np.repeat(base, spans) + np.repeat(first, spans)
        local = w - np.repeat(first, lengths) + np.repeat(base, lengths)
        q, item = self.near(size, simhashes(whole[place], local, n))
        for a, i in zip(w[q].tolist(), item.tolist(), strict=True):
            least = common(np.unique(whole[a : a + n], return_counts=True), self.shingles[i])
            similarity = least / (n + size - min(size, self.shingle) + 1 - least)
            if similarity >= min_similarity:
                key = int(row[a]), i
                best, at, n_windows = out.get(key, (0.0, 0, 0))
                start = int(a - row_start[key[0]])
                best, at = (similarity, start) if similarity > best else (best, at)  # ties: the first window
                out[key] = best, at, n_windows + 1


def item_blocks(items: DataFrame, block_items: int = BLOCK_ITEMS) -> Iterator[list[tuple[int | None, bytes]]]:
    """The items, a block of bounded size at a time; only one block is in the driver's memory."""
    block, size = [], 0
    for r in items.select(F.col("item_id").cast("long").alias("item_id"), text_bytes().alias("text")).toLocalIterator():
        if block and (len(block) == block_items or size + len(r["text"]) > BLOCK_BYTES):
            yield block
            block, size = [], 0
        block.append((r["item_id"], bytes(r["text"])))
        size += len(r["text"])
    if block:
        yield block


def contaminations(docs: DataFrame, items: DataFrame, min_similarity: float = MIN_SIMILARITY, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, similarity, start_word, n_windows) of every document and item that a window matches."""
    narrow = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    schema = "doc_id long, item_id long, similarity double, start_word long, n_windows long"
    out = None
    for block in item_blocks(items, block_items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def batches(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, shingle_words, radius)
            for b in it:
                data, offsets = text_buffer(b.column(1))
                for a, e in slices(offsets):
                    found = index.matches(data, offsets[a : e + 1], min_similarity)
                    if found:
                        rows, hit = pa.array([a + r for r, _ in found]), pa.array([index.ids[i] for _, i in found], pa.int64())
                        sim, start, n = zip(*found.values(), strict=True)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(rows), hit, pa.array(sim, pa.float64()), pa.array(start, pa.int64()), pa.array(n, pa.int64())], ["doc_id", "item_id", "similarity", "start_word", "n_windows"])

        part = narrow.mapInArrow(batches, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, items: DataFrame, min_similarity: float = MIN_SIMILARITY, shingle_words: int = SHINGLE_WORDS, radius: int = RADIUS, block_items: int = BLOCK_ITEMS) -> DataFrame:
    """The rows of docs in which no window matches an item; texts are tested where they lie, without a join."""
    text_at, schema = docs.columns.index("text"), docs.schema
    for block in item_blocks(items, block_items):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def batches(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(sent.value, shingle_words, radius)
            for b in it:
                data, offsets = text_buffer(b.column(text_at).fill_null("").cast(pa.binary()))
                clean = np.ones(b.num_rows, bool)
                for a, e in slices(offsets):
                    clean[[a + r for r, _ in index.matches(data, offsets[a : e + 1], min_similarity)]] = False
                yield b.filter(pa.array(clean))
            pa.default_memory_pool().release_unused()  # the worker lives on, and with it what copies of texts took

        docs = bounded(docs).mapInArrow(batches, schema)
    return docs
