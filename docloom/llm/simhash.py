"""SimHash near-duplicates over a Gray-order hierarchical index.

``fingerprints`` hashes word shingles to 64-bit SimHashes. ``hamming_links`` finds all links within a Hamming radius.
The fingerprints are sorted by Gray rank, once for each of several orders of their bits: any two that differ in r bits or
fewer agree on at least k - r of k bit ranges, and each choice of such ranges is the head of one order, so that
they share an upper node of that order, with all its masked bits. Upper nodes are dealt to the tasks; below them runs of
neighbours are summed up by the bits that all of them share (mask and value), level upon level. A search adds up
differing bits on the way down, each bit once, at the highest node that fixes it, and leaves a whole run as soon as the
sum is over the radius. A few fingerprints are one node. Upper nodes over ``GROUP_ROWS`` are split into cells of two
chunks each. A node returns a spanning forest of its links, never all pairs; ``connected_components`` joins the forests.

Cases: a null or wordless text has fingerprint zero and is linked like any other; fewer words than a shingle make one
shingle; a row that repeats stays a row of its own (``keep_one``: once); rows of one id and different texts are told
apart by their texts; a null id is the last of its group to be kept; an empty table gives an empty result; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, checkpoint, connected_components, few, group_starts, grouped, join_few, join_written, roots, splitmix, text_bytes, unite

#: Rows of a group beyond which it is split into cells; bounds the memory of a task.
GROUP_ROWS = 20_000
#: Rows of a group of candidates beyond which all are compared to one of them first.
HOT_ROWS = 256
#: Rows of each side of a cell in which the rest of such a group is compared.
SKETCH_ROWS = 256
#: Average rows of unrelated fingerprints that an upper node may have; beyond, more bits are factored into it.
GROUP_MEAN = 1024
#: Pairs that a search looks at together, at most but for one row's.
BLOCK_PAIRS = 1 << 20
#: Smallest distinct shingle hashes that a sketch keeps.
SKETCH = 256
#: Pairs whose sketches are less similar than asked by this are not compared by all their shingles: six deviations of a sketch at 0.8, 4.8 at 0.5.
SKETCH_MARGIN = 0.15
BANDS = 5
#: Bits in which SimHashes of near copies may differ: at similarity 0.8 they differ in 9.7 on average, with a deviation of 2.9.
RADIUS = 22
FANOUT = 16


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of lower-cased words, repeats included."""
    words = text.lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - size + 1)
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)), np.uint64, n)


def simhash(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half the hashes; no hash: zero."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little") if len(hashes) else np.zeros(8, np.uint8)
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp) with fp as a signed long, a row for each row of docs."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fps = [simhash(shingle_hashes(t.as_py(), shingle_words)) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(batches, "doc_id long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of a 64-bit word in the reflected Gray sequence."""
    for s in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, s))
    return fp


def gray_ranks(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """The hierarchical index of fingerprints: runs of FANOUT neighbours in Gray order, level upon level.

    The rows are sorted by group, and by Gray rank within it; ``starts`` are the first rows of the groups. A search of a
    row begins at the level where its group's later rows are FANOUT nodes or so, whatever the size of the group.
    """

    def __init__(self, x: np.ndarray, starts: np.ndarray):
        self.x = x
        self.end = np.repeat(np.append(starts[1:], len(x)), np.diff(np.append(starts, len(x))))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # bits all members share; their values
        ones, any_ = x, x
        while True:
            self.levels.append((~(ones ^ any_), ones))
            if len(ones) <= FANOUT:
                break
            at = np.arange(0, len(ones), FANOUT)
            ones, any_ = np.bitwise_and.reduceat(ones, at), np.bitwise_or.reduceat(any_, at)

    def pairs(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (i, j), i < j, of one group within the radius, for a block of rows i at a time."""
        later = self.end - np.arange(len(self.x)) - 1
        top = np.minimum(np.ceil(np.log2(np.maximum(later, 1)) / np.log2(FANOUT) - 1e-9).astype(np.int64) - 1, len(self.levels) - 1).clip(0)
        block = np.cumsum(later + 1) // BLOCK_PAIRS
        for first, last in zip(*(lambda e: (e[:-1], e[1:]))(np.flatnonzero(np.concatenate(([True], np.diff(block) != 0, [True])))), strict=True):
            rows = np.arange(first, last)
            rows = rows[later[rows] > 0]
            i, node, gone, above = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint8), np.empty(0, np.uint64)
            for k in range(int(top[rows].max()) if len(rows) else -1, -1, -1):
                span = FANOUT**k
                i, gone, above = (np.repeat(v, FANOUT) for v in (i, gone, above))
                node = (node[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                q = rows[top[rows] == k]  # searches that begin here
                n = (self.end[q] - 1) // span - (q + 1) // span + 1
                own = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat((q + 1) // span, n)
                i, node = np.concatenate((i, np.repeat(q, n))), np.concatenate((node, own))
                gone, above = np.concatenate((gone, np.zeros(len(own), np.uint8))), np.concatenate((above, np.zeros(len(own), np.uint64)))
                there = ((node + 1) * span > i + 1) & (node * span < self.end[i])  # later rows of the same group
                i, node, gone, above = i[there], node[there], gone[there], above[there]
                mask, value = self.levels[k]
                m = mask[node]
                gone = gone + np.bitwise_count((self.x[i] ^ value[node]) & m & ~above)  # each bit once, where it is fixed first
                near = gone <= radius
                i, node, gone, above = i[near], node[near], gone[near], m[near]
            if len(i):
                yield i, node


def block_orders(n: int, radius: int) -> list[list[tuple[int, int]]]:
    """For each order of n fingerprints the bit ranges that are its upper node, and then the other ranges.

    Fingerprints that differ in ``radius`` bits agree on k - radius of k ranges, so they share the upper node of an order.
    """
    if n <= GROUP_MEAN:
        return [[(0, 64)]]
    k = radius + 1
    while k < 64 and n > GROUP_MEAN << ((k - radius) * (64 // k)):
        k += 1
    edges = [64 * i // k for i in range(k + 1)]
    ranges = list(zip(edges, edges[1:], strict=False))
    return [[*c, *(r for r in ranges if r not in c)] for c in combinations(ranges, k - radius)]


def ordered_bits(fp: Column, ranges: list[tuple[int, int]]) -> Column:
    """fp with its bit ranges put in this order, the first one highest."""
    out, at = F.lit(0).cast("long"), 64
    for a, b in ranges:
        at -= b - a
        part = F.shiftrightunsigned(fp, a) if b - a == 64 else F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(part, at))
    return out


def cells(rows: DataFrame, key: list[str], most: int, of: str) -> DataFrame:
    """Rows of groups over ``most`` rows, dealt to cells of two chunks; any two rows of a group share a cell."""
    big = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > most).select(*key, F.ceil(F.col("size") / most).cast("int").alias("chunks"))
    chunk = F.pmod(F.xxhash64(of), F.col("chunks")).cast("int")
    return (
        rows.join(big, key, "left")
        .withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        .withColumn("chunk", chunk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumn("cell", F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other"))
        .drop("chunks", "chunk", "other")
    )


def hamming_links(nodes: DataFrame, radius: int = 4, group_rows: int = GROUP_ROWS, orders: list[list[tuple[int, int]]] | None = None) -> DataFrame:
    """Edges (u, v) that connect what links within the radius connect; nodes is (fp, node), fp distinct."""
    orders = orders or block_orders(nodes.count(), radius)
    k = len(orders[0])
    tops = [sum(b - a for a, b in o[: k - radius]) if k > 1 else 0 for o in orders]
    each = [F.struct(F.lit(i).alias("t"), ordered_bits(F.col("fp"), o).alias("fp"), F.lit(64 - n).alias("low")) for i, (o, n) in enumerate(zip(orders, tops, strict=True))]
    rows = nodes.select("node", F.explode(F.array(*each)).alias("k")).select("node", "k.t", "k.fp", F.when(F.col("k.low") == 64, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(k.fp, k.low)")).alias("key"))
    keys = ["t", "key", "cell"]

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it, keys):
            x, node = t.column("fp").to_numpy().astype(np.uint64), t.column("node").to_numpy()
            label = np.arange(len(x))
            for i, j in GrayIndex(x, group_starts(t, keys)).pairs(radius):
                label = unite(label, i, j)
            label = roots(label)
            v = np.flatnonzero(label != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[v]]), pa.array(node[v])], ["u", "v"])

    dealt = cells(rows, ["t", "key"], group_rows, "fp").withColumn("gray", gray_rank(F.col("fp")))
    return dealt.repartition(*keys).sortWithinPartitions(*keys, "gray").select("fp", "node", *keys).mapInArrow(links, "u long, v long")


def simhash_groups(docs: DataFrame, shingle_words: int = 4, radius: int = 4, group_rows: int = GROUP_ROWS) -> DataFrame:
    """doc_id, fingerprint (16 lower-case hex digits), component_id, a row for each row of docs."""
    fps = checkpoint(fingerprints(docs, shingle_words))
    nodes = checkpoint(fps.groupBy("fp").agg(F.min("doc_id").alias("node")))
    parts = connected_components(hamming_links(nodes, radius, group_rows))
    labels = nodes.join(parts, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def features(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(doc_id, th, node, fp, bands): what near_duplicates groups by. fp is of distinct shingles, as is the similarity; node names the words."""
    odd = splitmix(np.arange(2 * BANDS, dtype=np.uint64)) | np.uint64(1)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            nodes, fps, bands = [], [], []
            for t in b.column(2):
                text = t.as_py()
                h = np.unique(shingle_hashes(text, shingle_words))
                nodes.append(words_key(text))
                fps.append(simhash(h))
                least = splitmix(h)[:, None] * odd if len(h) else np.zeros((1, 2 * BANDS), np.uint64)
                least = (least ^ (least >> np.uint64(29))).min(axis=0)
                bands.append(splitmix(least[::2] ^ splitmix(least[1::2] + np.arange(BANDS, dtype=np.uint64))).view(np.int64).tolist())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "th", "node", "fp", "bands"])

    return keyed(docs).mapInArrow(batches, "doc_id long, th long, node long, fp long, bands array<long>")


def keyed(docs: DataFrame) -> DataFrame:
    return bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_bytes()).alias("th"), text_bytes().alias("text"))


def words_key(text: bytes) -> int:
    """64 bits of a digest of the words of a text."""
    return int.from_bytes(xxhash.xxh3_64_digest(b" ".join(text.lower().split())), "big", signed=True)


def shingle_sets(texts: DataFrame, shingle_words: int) -> DataFrame:
    """(node, shingles) of texts (node, text): all distinct shingle hashes, sorted, as 64-bit numbers."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle_words)).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "shingles"])
        pa.default_memory_pool().release_unused()  # the worker lives on, and with it what the sets took

    return texts.mapInArrow(batches, "node long, shingles binary")


def alike(sets: list[bytes], sketch: np.ndarray, p: np.ndarray, q: np.ndarray, min_similarity: float) -> np.ndarray:
    """Which pairs of places (p, q) are as similar: by all shingles, where sketches are not far too different."""
    out = np.zeros(len(p), bool)
    for at in range(0, len(p), 2048):
        near = at + np.flatnonzero(sketch_similarity(sketch[p[at : at + 2048]], sketch[q[at : at + 2048]]) >= min_similarity - SKETCH_MARGIN)
        for k in near.tolist():
            a, b = np.frombuffer(sets[p[k]], np.uint64), np.frombuffer(sets[q[k]], np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[k] = both >= min_similarity * max(1, len(a) + len(b) - both)
    return out


def sketch_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches: rows of sorted hashes, filled up with 2**32."""
    both = np.sort(np.concatenate((a, b), axis=1), axis=1)
    there = both < 1 << 32
    twice = (both[:, 1:] == both[:, :-1]) & there[:, 1:]
    rank = np.cumsum(there, axis=1) - np.concatenate((np.zeros((len(a), 1), int), np.cumsum(twice, axis=1)), axis=1)  # of distinct hashes
    within = rank <= SKETCH
    n = np.maximum(1, np.minimum(SKETCH, rank[:, -1]))
    return (twice & within[:, 1:]).sum(axis=1) / n


def against_leaders(rows: DataFrame, min_similarity: float, radius: int) -> DataFrame:
    """rows of hot groups (key, n, node, fp, shingles), with the group's leader and whether it is alike.

    The leader is the row whose SimHash is nearest to the bitwise majority of the group, ties to the smallest node:
    copies of one text that differ from each other in many places are still near to what they have in common.
    """
    bits = [(2 * F.sum(F.shiftright("fp", i).bitwiseAND(F.lit(1))) > F.count(F.lit(1))).cast("long") for i in range(64)]
    middle = bits[0]
    for i in range(1, 64):
        middle = middle.bitwiseOR(F.shiftleft(bits[i], i))
    far = F.bit_count(F.col("fp").bitwiseXOR(F.col("middle")))
    near = join_few(rows.select("key", "node", "fp"), rows.groupBy("key").agg(middle.alias("middle")), "key")
    leaders = near.groupBy("key").agg(F.min(F.struct(far.alias("far"), "node")).alias("x")).select("key", F.col("x.node").alias("node"))
    leaders = join_few(rows.select("key", "node", F.col("fp").alias("leader_fp"), F.col("shingles").alias("leader_shingles")), leaders, ["key", "node"]).select("key", F.col("node").alias("leader"), "leader_fp", "leader_shingles").dropDuplicates(["key"])

    def compare(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            own, leader = (b.column(b.schema.get_field_index(c)) for c in ("shingles", "leader_shingles"))
            parts = [np.zeros(0, bool)]
            for at in range(0, b.num_rows, 2048):
                x, y = own[at : at + 2048].to_pylist(), leader[at : at + 2048].to_pylist()
                parts.append(alike(x + y, sketch_rows(x + y), np.arange(len(x)), len(x) + np.arange(len(x)), min_similarity))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(np.concatenate(parts))], ["key", "n", "node", "fp", "shingles", "leader", "alike"])

    both = join_few(rows, leaders, "key").select("key", "n", "node", "fp", "shingles", "leader", "leader_fp", "leader_shingles")
    led = both.select("key", "n", "node", "fp", "shingles", "leader", F.when(F.bit_count(F.col("fp").bitwiseXOR(F.col("leader_fp"))) <= radius, F.col("leader_shingles")).alias("leader_shingles"))
    near = led.where("leader_shingles is not null").mapInArrow(compare, "key long, n long, node long, fp long, shingles binary, leader long, alike boolean")
    return near.unionByName(led.where("leader_shingles is null").select("key", "n", "node", "fp", "shingles", "leader", F.lit(False).alias("alike")))


def rest_cells(led: DataFrame, most: int) -> DataFrame:
    """Rows (node, fp, shingles, key, i, j, done, side) of cells in which each row that is not like its leader (side 2) meets every row of its group (side 1)."""
    rest = led.groupBy("key").agg(F.sum((~F.col("alike")).cast("long")).alias("r")).where("r > 0").select("key", F.ceil(F.col("r") / most).cast("int").alias("of_rest"))
    rows = join_few(led, rest, "key").withColumn("of_all", F.ceil(F.col("n") / most).cast("int"))
    i, j = (F.pmod(F.xxhash64("node"), F.col(c)).cast("int") for c in ("of_all", "of_rest"))
    members = rows.select("node", "fp", "shingles", "key", i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("of_rest") - 1)).alias("j"), F.col("alike").alias("done"), F.lit(1).alias("side"))
    others = rows.where("not alike").select("node", "fp", "shingles", "key", F.explode(F.sequence(F.lit(0), F.col("of_all") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("done"), F.lit(2).alias("side"))
    return members.unionByName(others)


def sketch_rows(sets: list[bytes]) -> np.ndarray:
    """Sketches of sorted sets as rows of numbers, filled up with 2**32."""
    out = np.full((len(sets), SKETCH), 1 << 32, np.int64)
    for k, x in enumerate(sets):
        least = np.unique(np.frombuffer(x, np.uint64)[: SKETCH + 64] >> np.uint64(32))[:SKETCH]
        out[k, : len(least)] = least
    return out


def near_groups(docs: DataFrame, shingle_words: int = 5, min_similarity: float = 0.8, radius: int = RADIUS, hot_rows: int = HOT_ROWS, cell_rows: int = SKETCH_ROWS) -> DataFrame:
    """(doc_id, th, group) of texts whose word shingles are alike, a row for each row of docs; th is the hash of the text.

    Texts meet in a group if they share the two least shingle hashes of one of BANDS orders; the Gray-order index of the
    groups leaves out pairs whose SimHashes differ in more than ``radius`` bits, sketches of the least shingle hashes those
    that are far from that similarity, and all distinct shingles decide. They are made for texts that share a band only.
    Texts of equal words are one from the start. A group of over ``hot_rows`` texts is never gathered: all of it is
    compared to a leader, wherever the rows lie; those that are alike are then one, and only the rest meets the
    group again, in cells of up to twice ``cell_rows``. Leaders are subject to the same radius.
    """
    feats = checkpoint(features(docs, shingle_words))
    bands = feats.select("node", "fp", F.explode(F.array_distinct("bands")).alias("key")).dropDuplicates(["node", "key"])
    shared = checkpoint(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    rows = checkpoint(join_written(bands, shared, "key").select("key", "n", "node", "fp"))
    wanted = join_few(feats.select("doc_id", "th", "node"), rows.select("node").distinct(), "node").groupBy("node").agg(F.min(F.struct("doc_id", "th")).alias("x"))
    wanted = few(checkpoint(wanted.select("node", F.col("x.doc_id").alias("doc_id"), F.col("x.th").alias("th")))).alias("w")
    texts = keyed(docs).alias("d").join(wanted, F.expr("d.doc_id <=> w.doc_id and d.th = w.th")).select("w.node", "d.text")
    sets = checkpoint(shingle_sets(texts, shingle_words).dropDuplicates(["node"]))
    rows = rows.join(sets, "node").select("key", "n", "node", "fp", "shingles")
    cold = rows.where(F.col("n") <= hot_rows).select("node", "fp", "shingles", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(False).alias("done"), F.lit(0).alias("side"))
    keys = ["key", "i", "j"]

    def links(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in grouped(it, keys):
            x, node = t.column("fp").to_numpy().astype(np.uint64), t.column("node").to_numpy()
            raw, done, side = t.column("shingles").to_pylist(), t.column("done").to_numpy(), t.column("side").to_numpy()
            starts = group_starts(t, keys)
            sketch, label = sketch_rows(raw), np.arange(len(x))
            already = np.flatnonzero(done)  # one with the first such row of their group
            if len(already):
                group = np.searchsorted(starts, already, "right")
                new = np.concatenate(([True], np.diff(group) != 0))
                label[already] = already[np.flatnonzero(new)][np.cumsum(new) - 1]
            for i, j in GrayIndex(x, starts).pairs(radius):
                across = (side[i] != side[j]) | (side[i] == 0)
                i, j = i[across], j[across]
                for at in range(0, len(i), 512):
                    p, q = i[at : at + 512], j[at : at + 512]
                    apart = label[p] != label[q]
                    p, q = p[apart], q[apart]
                    one_text = alike(raw, sketch, p, q, min_similarity)
                    label = unite(label, p[one_text], q[one_text])
            label = roots(label)
            out = np.flatnonzero(label != np.arange(len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(node[label[out]]), pa.array(node[out])], ["u", "v"])

    meet, edges = cold, None
    if shared.where(F.col("n") > hot_rows).limit(1).count():
        led = checkpoint(against_leaders(checkpoint(rows.where(F.col("n") > hot_rows)), min_similarity, radius))
        meet, edges = cold.unionByName(rest_cells(led, cell_rows)), led.where("alike").select(F.col("leader").alias("u"), F.col("node").alias("v"))
    found = meet.withColumn("gray", gray_rank(F.col("fp"))).repartition(*keys).sortWithinPartitions(*keys, "gray").select("node", "fp", "shingles", "done", "side", *keys).mapInArrow(links, "u long, v long")
    parts = connected_components(found if edges is None else found.unionByName(edges))
    return join_few(feats.select("doc_id", "th", "node"), parts, "node", "left").select("doc_id", "th", F.coalesce("component", "node").alias("group"))


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, component_id), a row for each row of docs: the smallest doc_id of the texts that are alike."""
    groups = checkpoint(near_groups(docs, **options))
    least = groups.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    return join_few(groups, least, "group").select("doc_id", "component_id")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, of the smallest hash among its texts."""
    groups = near_groups(docs, **options).groupBy("group", "doc_id", "th").agg(F.count(F.lit(1)).alias("n"))
    first = groups.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th", "n")).alias("x"))
    first = few(checkpoint(first.select(F.col("x.doc_id").alias("id"), F.col("x.th").alias("th"), F.col("x.n").alias("n")))).alias("k")
    names = [f"`{c}`" for c in docs.columns]
    rows = docs.select(F.struct(*names).alias("row")).alias("d")
    kept = rows.join(first, (F.col("d.row.doc_id").cast("long").eqNullSafe(F.col("k.id"))) & (F.xxhash64(F.coalesce(F.col("d.row.text").cast("binary"), F.lit(b""))) == F.col("k.th"))).select("row", "id", "k.th", "n")
    if kept.where("n > 1").limit(1).count():  # rows that repeat
        kept = kept.where("n = 1").unionByName(kept.where("n > 1").dropDuplicates(["id", "th"]))
    return kept.select("row.*")
