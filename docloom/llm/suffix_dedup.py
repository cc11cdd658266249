"""Exact repeated substrings of a corpus, by threshold-bounded interval expansion on Burrows-Wheeler transforms.

A byte is removed if a string of ``min_bytes`` bytes covers it that also starts anywhere else. The corpus is cut
into segments so that equal strings of that length meet: every such string has a minimizer, the least hash of the
``ANCHOR``-byte strings within it, and a segment is a maximal run of strings with one minimizer. Segments that share
a minimizer form a bucket; equal segments are kept once, with a mark that there are several. Buckets of different
segments are indexed: their suffixes are sorted to the depth ``min_bytes``, and breadth-first backward extension over
the Burrows-Wheeler transform derives the common prefixes by increasing value until that depth, where it stops.
What is left undivided there are the repeated strings.

Cases: null and short texts lose nothing; a repeated row repeats all its strings; an empty table gives an empty
result; texts are bytes, so that a cut may fall within a character. Buckets of more than ``HOT_SEGMENTS`` different
segments are split by the hashes of their strings instead of being gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import BYTE_VALUE, bounded, checkpoint, group_starts, grouped, join_few, range_hashes, slices, splitmix, text_buffer, text_bytes

MIN_BYTES = 200
#: Bytes of a minimizer.
ANCHOR = 64
#: Different segments of one minimizer beyond which their strings are compared by hash, spread over all tasks.
HOT_SEGMENTS = 6_000
#: Bytes of segments that one index holds; places and ranks then fit 21 bits each.
INDEX_BYTES = 1 << 21
PIECE = 1 << 15
#: Bytes of text whose equal segments are found before the shuffle.
SEGMENT_BYTES = 1 << 21
KEY = "h long, seg long, doc_id long, th long, place long"


def runs(data: np.ndarray, offsets: np.ndarray, min_bytes: int, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(row, first start, last start, anchor place, anchor hash) of the runs of strings with one minimizer.

    Of equal least hashes the last counts. Places are within ``data``; strings never leave their row.
    """
    span = min_bytes - anchor + 1
    at, end = int(offsets[0]), int(offsets[-1])
    first, last, place, key = [], [], [], []
    up = None
    while end - at >= min_bytes:
        text = data[at : min(end, at + PIECE + min_bytes - 1)]
        n = len(text) - min_bytes + 1  # strings that start in this piece
        grams = len(text) - anchor + 1
        starts = np.arange(grams)
        h = range_hashes(BYTE_VALUE[text], starts, starts + anchor)
        v = (h & ~np.uint64(0xFFFF)) | (np.uint64(0xFFFF) - starts.astype(np.uint64))
        wide = -(-grams // span) * span
        padded = np.full(wide, np.iinfo(np.uint64).max, np.uint64)
        padded[:grams] = v
        block = padded.reshape(-1, span)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(back[:n], ahead[span - 1 : span - 1 + n])
        p = (np.uint64(0xFFFF) - (least & np.uint64(0xFFFF))).astype(np.int64)
        new = np.ones(n, bool)
        new[1:] = p[1:] != p[:-1]
        a = np.flatnonzero(new)
        first.append(a + at)
        last.append(np.append(a[1:], n) - 1 + at)
        place.append(p[a] + at)
        key.append(h[p[a]])
        at += PIECE
    if not first:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    first, last, place, key = (np.concatenate(x) for x in (first, last, place, key))
    # a run that two pieces share is one
    same = np.zeros(len(first), bool)
    same[1:] = (place[1:] == place[:-1]) & (first[1:] == last[:-1] + 1)
    heads = np.flatnonzero(~same)
    first, last, place, key = first[heads], np.append(last[heads[1:] - 1], last[-1:]), place[heads], key[heads]
    # strings that leave their row are dropped
    row = np.searchsorted(offsets, first, "right") - 1
    out = []
    over = last + min_bytes > offsets[row + 1]
    if over.any():
        more = []
        for i in np.flatnonzero(over).tolist():  # a run with strings of several rows
            r, a = int(row[i]), int(first[i])
            while a <= last[i]:
                b = min(int(last[i]), int(offsets[r + 1]) - min_bytes)
                if a <= b:
                    more.append((r, a, b, int(place[i]), key[i]))
                r += 1
                a = int(offsets[r]) if r < len(offsets) - 1 else int(last[i]) + 1
        out = more
    keep = ~over
    if out:
        r, a, b, p, k = zip(*out, strict=True)
        row, first, last, place, key = (np.concatenate((x[keep], np.array(y, x.dtype))) for x, y in ((row, r), (first, a), (last, b), (place, p), (key, k)))
    else:
        row, first, last, place, key = (x[keep] for x in (row, first, last, place, key))
    return row, first, last, place, key


def repeated_strings(data: np.ndarray, starts: np.ndarray, min_bytes: int) -> np.ndarray:
    """Places of ``data`` where a string of ``min_bytes`` starts that starts elsewhere too.

    ``starts`` are those of the segments, with the end; strings that leave their segment do not count.
    """
    n = len(data)
    step = next(k for k in (8, 7, 6, 5, 4, 3, 2, 1) if min_bytes % k == 0)
    symbol = next_bytes(data, step)
    order = np.argsort(symbol)
    new = np.ones(n, bool)
    new[1:] = symbol[order][1:] != symbol[order][:-1]
    rank = np.empty(n, np.uint64)
    rank[order] = np.cumsum(new) - 1
    depth, own = step, np.arange(n, dtype=np.uint64)
    while depth < min_bytes and not new.all():  # suffixes sorted by doubled prefixes
        later = np.zeros(n, np.uint64)
        later[: max(0, n - depth)] = rank[depth:] + np.uint64(1)
        keys = np.sort(rank << np.uint64(43) | later << np.uint64(21) | own)
        order = (keys & np.uint64((1 << 21) - 1)).astype(np.int64)
        keys >>= np.uint64(21)
        new = np.ones(n, bool)
        new[1:] = keys[1:] != keys[:-1]
        rank[order] = np.cumsum(new) - 1
        depth *= 2
    row_of = np.empty(n + step, np.int64)
    row_of[order] = np.arange(n)
    row_of[n:] = np.arange(n - step, n)  # beyond the end: only reached by strings that do not count
    after = row_of[order + step]  # the row that extends backwards, by its preceding symbol, to this one
    symbol = symbol[order]
    apart = np.ones(n, bool)  # rows that differ from the row above within the depth reached
    apart[1:] = symbol[1:] != symbol[:-1]
    undivided = np.flatnonzero(~apart)
    for _ in range(min_bytes // step - 1):  # common prefixes by increasing value
        interval = np.cumsum(apart)
        divided = interval[after[undivided]] != interval[after[undivided - 1]]
        apart[undivided[divided]] = True
        undivided = undivided[~divided]
        if not len(undivided):
            break
    interval = np.cumsum(apart) - 1
    end = starts[np.searchsorted(starts, order, "right")]
    inside = order + min_bytes <= end
    many = np.bincount(interval[inside], minlength=n) > 1
    return np.sort(order[inside & many[interval]])


def next_bytes(data: np.ndarray, step: int) -> np.ndarray:
    """The ``step`` bytes from each place, as a number; zeros stand beyond the end."""
    padded = np.concatenate((data, np.zeros(step, np.uint8))).astype(np.uint64)
    symbol = np.zeros(len(data), np.uint64)
    for k in range(step):
        symbol = symbol << np.uint64(8) | padded[k : k + len(data)]
    return symbol


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, th, text) with compressed texts, for joins by row; th tells rows of one id apart."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for b in it:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([squeeze(x.as_py()) for x in b.column(2)], pa.binary())], ["doc_id", "th", "text"])

    return keyed(docs).mapInArrow(batches, "doc_id long, th long, text binary")


def keyed(docs: DataFrame) -> DataFrame:
    text = text_bytes()
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def unpacked(b: pa.RecordBatch | pa.Array) -> Iterator[bytes]:
    expand = zstandard.ZstdDecompressor().decompress
    return (expand(x.as_py()) for x in b)


def segments(docs: DataFrame, min_bytes: int) -> DataFrame:
    """Rows of KEY with ``dup`` (its segment occurs again) and ``rep`` (stands for its segment in a bucket of several).

    Only segments whose minimizer occurs again are left. Equal segments of one batch are found before the shuffle,
    which one of them enters; the others are dealt anywhere.
    """

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offsets = text_buffer(b.column(2))
            for a, e in slices(offsets, SEGMENT_BYTES):
                o = offsets[a : e + 1]
                row, first, last, place, h = runs(data, o, min_bytes)
                if not len(row):
                    continue
                base = int(o[0])
                seg = range_hashes(BYTE_VALUE[data[base : o[-1]]], first - base, last - base + min_bytes)
                seg = splitmix(seg + ((place - first) * 65536 + (last - first)).astype(np.uint64))
                both = h ^ splitmix(seg)
                _, at, inverse, n = np.unique(both, return_index=True, return_inverse=True, return_counts=True)
                known = np.ones(len(row), bool)
                known[at] = False
                where = ((first - o[row]) << 32) | ((place - first) << 16) | (last - first)
                deal = np.where(known, splitmix(both + where.astype(np.uint64)), h)
                ids = pa.array(row + a)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (deal.view(np.int64), known, h.view(np.int64), seg.view(np.int64))] + [b.column(0).take(ids), b.column(1).take(ids), pa.array(where), pa.array(n[inverse] > 1)], ["deal", "known", "h", "seg", "doc_id", "th", "place", "many"])

    def mark(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        above = None  # (h, seg) of the row above the held one
        for b in _and_none(it):
            t = held if b is None else pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            if t is None or not t.num_rows:
                continue
            m = t.num_rows if b is None else t.num_rows - 1
            h, seg = t.column("h").to_numpy(), t.column("seg").to_numpy()
            known, many = (t.column(c).to_numpy(zero_copy_only=False) for c in ("known", "many"))
            like_h, like = np.zeros(len(h) + 1, bool), np.zeros(len(h) + 1, bool)  # as the row above; one more entry: the end
            like_h[1:-1] = h[1:] == h[:-1]
            like[1:-1] = like_h[1:-1] & (seg[1:] == seg[:-1])
            if above is not None:
                like_h[0] = above[0] == h[0]
                like[0] = like_h[0] and above[1] == seg[0]
            if (k := np.flatnonzero(known)).size:  # they stand after all others
                like_h[k[0] :] = like[k[0] :] = False
            dup = many | known | like[:-1] | like[1:]
            rep = ((like_h & ~like)[:-1] | (like_h & ~like)[1:]) & ~known
            out = np.flatnonzero((dup | rep)[:m])
            if len(out):
                got = t.select(["h", "seg", "doc_id", "th", "place"]).take(pa.array(out))
                yield from got.append_column("dup", pa.array(dup[out])).append_column("rep", pa.array(rep[out])).combine_chunks().to_batches()
            if b is not None:
                if m:
                    above = (h[m - 1], seg[m - 1]) if not known[m - 1] else (None, None)
                held = t.slice(m)

    rows = keyed(docs).where(F.length("text") >= min_bytes).mapInArrow(cut, f"deal long, known boolean, {KEY}, many boolean")
    return rows.repartition("deal").sortWithinPartitions("known", "h", "seg").drop("deal").mapInArrow(mark, f"{KEY}, dup boolean, rep boolean")


def _and_none(it: Iterator) -> Iterator:
    yield from it
    yield None


def resolve(docs: DataFrame, reps: DataFrame, min_bytes: int, hot_segments: int) -> DataFrame:
    """(doc_id, th, first, last): strings of the segments ``reps`` that another segment of their bucket has."""
    size = reps.groupBy("h").agg(F.count(F.lit(1)).alias("size"))
    hot = size.where(F.col("size") > hot_segments).select("h", F.lit(True).alias("hot"))
    wanted = join_few(reps, hot, "h", "left").groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "place", "dup", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("wanted"))
    texts = packed(docs).alias("d").join(wanted.alias("w"), F.expr("d.doc_id <=> w.doc_id and d.th = w.th")).select("d.doc_id", "d.th", "d.text", "w.wanted")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, out = [], []
            for k, (text, wanted) in enumerate(zip(unpacked(b.column(2)), b.column(3), strict=True)):
                for w in wanted.as_py():
                    first, extent = w["place"] >> 32, w["place"] & 65535
                    rows.append(k)
                    out.append((w["h"], first, w["dup"], w["hot"], text[first : first + extent + min_bytes]))
            if rows:
                h, first, dup, is_hot, seg = zip(*out, strict=True)
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), b.column(0).take(at), b.column(1).take(at), pa.array(first, pa.int64()), pa.array(dup), pa.array(is_hot), pa.array(seg, pa.binary())], ["h", "doc_id", "th", "first", "dup", "hot", "seg"])

    def index(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it, ["h"]):
            heads = np.append(group_starts(t, ["h"]), t.num_rows)
            column = t.column("seg").combine_chunks()
            data, offsets = text_buffer(column.chunk(0) if isinstance(column, pa.ChunkedArray) else column)
            open_ = ~t.column("dup").to_numpy(zero_copy_only=False)
            for i, j in slices(offsets[heads], INDEX_BYTES - 1):
                a, e = int(heads[i]), int(heads[j])
                base = int(offsets[a])
                starts = offsets[a : e + 1] - base
                found = repeated_strings(data[base : offsets[e]], starts, min_bytes)
                seg = np.searchsorted(starts, found, "right") - 1
                wanted = open_[a + seg]
                found, seg = found[wanted], seg[wanted]
                if not len(found):
                    continue
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1] + 1) | (seg[1:] != seg[:-1])
                f = np.flatnonzero(new)
                l = np.append(f[1:], len(found)) - 1
                at = pa.array(a + seg[f])
                own = t.column("first").to_numpy()[a + seg[f]] - starts[seg[f]]
                yield pa.RecordBatch.from_arrays([t.column("doc_id").take(at).combine_chunks(), t.column("th").take(at).combine_chunks(), pa.array(own + found[f]), pa.array(own + found[l])], ["doc_id", "th", "first", "last"])

    def strings(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            data, offsets = text_buffer(b.column(6))
            for a, e in slices(offsets, SEGMENT_BYTES):
                o = offsets[a : e + 1] - offsets[a]
                counts = np.diff(o) - min_bytes + 1
                seg = np.repeat(np.arange(e - a), counts)
                s = np.arange(len(seg)) - np.repeat(np.cumsum(counts) - counts, counts) + o[seg]
                key = range_hashes(BYTE_VALUE[data[offsets[a] : offsets[e]]], s, s + min_bytes)
                at = pa.array(seg + a)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(at), b.column(1).take(at), b.column(2).take(at), pa.array(b.column(3).to_numpy()[a:e][seg] + s - o[seg]), b.column(4).take(at)], ["key", "h", "doc_id", "th", "first", "dup"])

    parts = checkpoint(texts.mapInArrow(cut, "h long, doc_id long, th long, first long, dup boolean, hot boolean, seg binary"))
    span = "doc_id long, th long, first long, last long"
    cold = parts.where("not hot").repartition("h").sortWithinPartitions("h").mapInArrow(index, span)
    each = parts.where("hot").mapInArrow(strings, "key long, h long, doc_id long, th long, first long, dup boolean")
    again = each.groupBy("h", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "key")  # 128 bits together
    return cold.unionByName(each.where("not dup").join(again, ["h", "key"]).select("doc_id", "th", "first", F.col("first").alias("last")))


def removed_spans(docs: DataFrame, min_bytes: int = MIN_BYTES, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, th, spans) for rows of docs that lose bytes; spans are (first start, last start) of repeated strings, unordered."""
    if not ANCHOR <= min_bytes <= PIECE:
        raise ValueError(f"min_bytes must be {ANCHOR} to {PIECE}")
    hot_segments = max(1, min(hot_segments, INDEX_BYTES // (2 * min_bytes)))  # a segment has fewer than 2 * min_bytes bytes
    found = checkpoint(segments(docs, min_bytes))
    sure = found.where("dup").select("doc_id", "th", F.shiftright("place", 32).alias("first"), (F.shiftright("place", 32) + F.col("place").bitwiseAND(F.lit(65535))).alias("last"))
    spans = sure.unionByName(resolve(docs, found.where("rep"), min_bytes, hot_segments))
    return spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("first", "last")).alias("spans"))


def merged(spans: list[dict] | None, min_bytes: int) -> list[tuple[int, int]]:
    """Maximal runs of removed bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["last"] + min_bytes) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def drop_repeats(docs: DataFrame, min_bytes: int = MIN_BYTES, hot_segments: int = HOT_SEGMENTS) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept), a row for each row of docs; kept is the remaining bytes."""
    spans = removed_spans(docs, min_bytes, hot_segments)
    rows = packed(docs).alias("d").join(spans.alias("s"), F.expr("d.doc_id <=> s.doc_id and d.th = s.th"), "left").select("d.doc_id", "d.text", "s.spans")

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for text, spans in zip(unpacked(b.column(1)), b.column(2), strict=True):
                gone = merged(spans.as_py(), min_bytes)
                edges = [0, *(x for run in gone for x in run), len(text)]
                kept = b"".join(text[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept))
            n, removed, runs_, sha, kept = zip(*out, strict=True) if out else ((),) * 5
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
