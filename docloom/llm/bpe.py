"""Byte-level BPE encoding and decoding of a corpus by a given rank table.

Texts are split into words by the tokenizer's pattern, and the distinct words of batches of texts meet by a shuffle.
Each distinct word (of ``SLICE_BATCHES`` batches) is encoded once, by Spark higher-order functions: a word is an array of bytes over
which ``aggregate`` folds the merges, each step joining all pairs of the least rank, which a map of ranks
gives; the ids are joined back to the words of each batch, and the batch puts them in the order of its texts. Decoding
concatenates the binary pieces of the ids, from a list. Map and list are scalar subqueries.

The rank map holds, for each mergeable pair of ids, the id of the joined piece. Ranks are those of a trained BPE: the
bytes of every piece merge, by lower ranks, into two pieces. Then a pair can only be of those two, joining a pair never
makes one of lower rank, and all pairs of the least rank can be joined in one step. A rank file that is not like this is
refused. Three arrays are the map: a pair (x, y) lies at offset[x] + y, where its entry names x.

Cases: null is empty; an empty text has no ids; very long words take as many steps as they have different merges;
repeated rows and empty tables are no special case. The rank file is a parameter and is read on the driver (about
50,000 rows, a fixed size).
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import batched

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm.common import bounded, bucketed, group_starts, grouped, let, text_buffer, text_bytes

#: Bytes of text whose distinct words are joined together.
BATCH_BYTES = 1 << 25
#: Words of texts that are held, packed and given back at a time, and ids of texts that are put together; bytes beyond which a text is by itself.
BLOCK_WORDS, BLOCK_BYTES = 1 << 16, 1 << 20
#: Batches whose words are encoded together; bounds the places of a frequent word.
SLICE_BATCHES = 1024
#: Ranks are below it; an entry of the map holds a rank, whether it joins twins, and the first id.
MAX_RANK = 1 << 19
NONE = 1 << 40


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merges(ranks: dict[bytes, int]) -> dict[tuple[int, int], int]:
    """The pair of ids that each piece of several bytes is joined from."""
    out = {}
    for piece, rank in ranks.items():
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 2:
            least, at = min((ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if least >= rank:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) > 2 or any(p not in ranks for p in parts) or len(parts) == 2 and rank <= max(ranks[p] for p in parts):
            raise ValueError(f"the ranks are not those of a trained BPE: {piece!r} is not joined from two pieces of lower rank")
        if len(parts) == 2:
            out[ranks[parts[0]], ranks[parts[1]]] = rank
    if len(ranks) and (max(ranks.values()) >= MAX_RANK or any(bytes([b]) not in ranks for b in range(256))):
        raise ValueError(f"ranks must be below {MAX_RANK} and hold every byte")
    return out


def rank_map(ranks: dict[bytes, int]) -> tuple[list[int | None], list[int]]:
    """(entries, offsets): the entry of the pair (x, y), at offsets[x] + y, is x << 20 | rank << 1 | (x == y); None: no pair."""
    ids = max(ranks.values(), default=-1) + 1
    rows: dict[int, list[tuple[int, int]]] = {}
    for (x, y), rank in merges(ranks).items():
        rows.setdefault(x, []).append((y, rank))
    room = 4 * sum(map(len, rows.values())) + 4 * ids
    taken, entries, offsets, low = bytearray(room), {}, [0] * ids, ids
    for x, row in sorted(rows.items(), key=lambda r: -len(r[1])):  # the longest rows first, each at the next place that fits
        others = [y - row[0][0] for y, _ in row[1:]]
        at, tried = taken.find(0, low), 0
        while any(taken[at + d] for d in others):
            at = taken.find(0, at + 1)
            tried += 1
        low += tried // 8  # crowded: later rows begin further on
        offsets[x] = at - row[0][0]
        for y, rank in row:
            place = at + y - row[0][0]
            taken[place] = 1
            entries[place] = x << 20 | rank << 1 | (x == y)
    return [entries.get(i) for i in range(max(taken.rfind(1), 0) + 1)], offsets


@lru_cache(maxsize=1)
def columns(ranks: tuple[tuple[bytes, int], ...]) -> dict[str, pa.Array]:
    of = dict(ranks)
    entries, offsets = rank_map(of)
    pieces = [""] * (max(of.values(), default=-1) + 1)
    for piece, rank in of.items():
        pieces[rank] = piece.hex()
    longs = lambda values: pa.array([values], pa.list_(pa.int64()))
    texts = lambda values: pa.array([values], pa.list_(pa.string()))
    return {"entries": longs(entries), "offsets": longs(offsets), "byte_ids": longs([of[bytes([b])] for b in range(256)]), "pieces": texts(pieces), "words": texts([i.to_bytes(4, "little").hex() for i in range(len(pieces))])}


def with_arrays(df: DataFrame, ranks: dict[bytes, int], *names: str) -> DataFrame:
    """df with arrays that are made from the ranks, as scalar subqueries: literals would be written out in every description of a
    plan, which the driver keeps. A following select that names each of them once takes them in, so that no row holds them."""
    known = columns(tuple(ranks.items()))
    return df.select("*", *[df.sparkSession.createDataFrame(pa.table({name: known[name]})).scalar().alias(name) for name in names])


def fold(word: Column, entries: Column, offsets: Column, byte_ids: Column) -> Column:
    """The ids of a word, an array of bytes, by folding merges over it."""

    def ranked(ids: Column) -> Column:
        """The entry of each neighbouring pair, less its first id; MAX_RANK << 1 and more where there is no pair."""
        return F.transform(ids, lambda x, i: F.get(entries, F.get(offsets, x) + F.get(ids, i + 1)).bitwiseXOR(F.shiftleft(x, 20)))

    def joined(ids: Column, pairs: Column, least: Column) -> Column:
        return F.filter(F.transform(ids, lambda x, i: F.when(F.get(pairs, i) == least, F.shiftright(least, 1)).when(F.get(pairs, i - 1) == least, F.lit(None)).otherwise(x)), lambda x: x.isNotNull())

    def every_other(pairs: Column, least: Column) -> Column:
        """Of a run of overlapping pairs of twins, the first, third and so on."""
        marks = F.array_join(F.transform(pairs, lambda p: F.when(p == least, F.lit("1")).otherwise(F.lit("0"))), "")
        return F.transform(F.split(F.regexp_replace(marks, "11", "10"), ""), lambda c: F.when(c == "1", least))

    def step(state: Column, _: Column) -> Column:
        ids, pairs = state["ids"], state["pairs"]

        def join(least: Column) -> Column:
            new = F.when(least.bitwiseAND(F.lit(1).cast("long")) == 1, let(every_other(pairs, least), lambda p: joined(ids, p, least))).otherwise(joined(ids, pairs, least))
            return F.when(least < 2 * MAX_RANK, let(new, lambda n: F.struct(n.alias("ids"), ranked(n).alias("pairs")))).otherwise(state)

        return let(F.array_min(pairs), join)

    start = let(F.transform(word, lambda b: F.get(byte_ids, b)), lambda ids: F.struct(ids.alias("ids"), ranked(ids).alias("pairs")))
    steps = F.sequence(F.lit(1), F.greatest(F.size(word) - 1, F.lit(1)))
    return F.aggregate(steps, start, step, lambda s: F.transform(s["ids"], lambda x: x.cast("int")))


def planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers, all first bytes before all second ones and so on, which packs better."""
    return numbers.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4").ravel()


class Batch:
    """The texts of a batch as numbers of their words, packed a block at a time, and its different words.

    Words are Python strings in the block that is being filled only; the others lie in one Arrow array.
    """

    def __init__(self, number: int, pattern: regex.Pattern):
        self.number, self.pattern, self.size = number, pattern, 0
        self.known, self.seen = pa.array([], pa.binary()), np.empty(0, np.int64)
        self.blocks: list[tuple[list[int | None], list[int], bytes]] = []  # ids, where texts after the first begin, packed numbers
        self.ids, self.ends, self.words = [], [], []
        self.squeeze, self.expand = zstandard.ZstdCompressor(level=1).compress, zstandard.ZstdDecompressor().decompress

    def add(self, doc_id: int | None, raw: bytes) -> None:
        text = raw.decode("utf-8", "replace")
        self.size += len(raw)
        if len(raw) > BLOCK_BYTES:  # a block by itself; its words are never all there
            self.close()
            self.pack([doc_id], [], (m[0] for m in self.pattern.finditer(text)))
            return
        self.words += self.pattern.findall(text)
        self.ids.append(doc_id)
        self.ends.append(len(self.words))
        if len(self.words) >= BLOCK_WORDS:
            self.close()

    def close(self) -> None:
        if self.ids:
            self.pack(self.ids, self.ends[:-1], self.words)
            self.ids, self.ends, self.words = [], [], []

    def pack(self, ids: list[int | None], stops: list[int], words: Iterable[str]) -> None:
        numbers = [self.numbered(w) for w in batched(words, BLOCK_WORDS)]
        self.blocks.append((ids, stops, self.squeeze(planes(np.concatenate(numbers) if numbers else np.empty(0, np.int32)))))

    def numbered(self, words: tuple[str, ...]) -> np.ndarray:
        """Numbers of words, in the order in which they were first seen."""
        coded = pa.array(words, pa.string()).cast(pa.binary()).dictionary_encode()
        own, n = coded.dictionary, len(self.known)
        found = pc.fill_null(pc.index_in(self.known, value_set=own), -1).to_numpy()
        number, known = np.full(len(own), -1, np.int32), np.flatnonzero(found >= 0)
        number[found[known]] = known
        new = np.flatnonzero(number < 0)
        number[new] = np.arange(n, n + len(new))
        at = coded.indices.to_numpy()
        self.known = pa.concat_arrays([self.known, own.take(pa.array(new))])
        self.seen = np.concatenate((self.seen, np.zeros(len(new), np.int64)))
        self.seen[number] += np.bincount(at, minlength=len(own))
        return number[at]

    def rows(self) -> Iterator[pa.RecordBatch]:
        self.close()
        often = np.argsort(-self.seen, kind="stable")
        number = np.empty(len(often), np.int32)  # frequent words have small numbers, which pack well
        number[often] = np.arange(len(often), dtype=np.int32)
        for ids, stops, packed in self.blocks:
            texts = np.split(number[from_planes(self.expand(packed))], stops)
            yield self.of(ids, None, [self.squeeze(planes(t)) for t in texts])
        data, offsets = text_buffer(self.known.take(pa.array(often)))
        yield self.of([len(often)], self.squeeze(np.diff(offsets).astype(np.int32).tobytes() + data[offsets[0] : offsets[-1]].tobytes()), [None])

    def of(self, ids: list[int | None], words: bytes | None, texts: list[bytes | None]) -> pa.RecordBatch:
        columns = [pa.array([self.number] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array([words] * len(ids), pa.binary()), pa.array(texts, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["batch", "doc_id", "words", "text"])


def cut(docs: DataFrame, pattern: str, batch_bytes: int) -> DataFrame:
    """Rows (batch, doc_id, words, text): the texts of a batch as packed numbers of words, then its packed different words."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        batch = Batch(TaskContext.get().partitionId() << 24, split)
        for b in it:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                raw = text.as_py()
                if batch.size and batch.size + len(raw) > batch_bytes:
                    yield from batch.rows()
                    batch = Batch(batch.number + 1, split)
                batch.add(doc_id, raw)
        if batch.ids or batch.blocks:
            yield from batch.rows()
        del batch
        pa.default_memory_pool().release_unused()  # the worker lives on, and with it what cutting took

    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(batches, "batch long, doc_id long, words binary, text binary")


def words_of(packed: DataFrame) -> DataFrame:
    """(word, batch, at) of the different words of each batch; packed is (batch, n, words)."""

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in it:
            for batch, n, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = expand(words)
                ends = np.concatenate(([0], np.cumsum(np.frombuffer(raw, np.int32, n)))).astype(np.int32)
                column = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(raw[4 * n :])])
                rows = pa.RecordBatch.from_arrays([column, pa.array(np.full(n, batch)), pa.array(np.arange(n, dtype=np.int32))], ["word", "batch", "at"])
                yield from (rows.slice(i, 50_000) for i in range(0, n, 50_000))

    return packed.mapInArrow(unpack, "word binary, batch long, at int")


def gathered(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (part, word, batch, at) that are sorted by part and word, a row (bytes, places) for each different word."""
    for t in grouped(it, ["part", "word"]):
        rows = t.combine_chunks()
        heads = np.append(group_starts(rows, ["part", "word"]), rows.num_rows).astype(np.int32)
        data, offsets = text_buffer(flat(rows.column("word").take(pa.array(heads[:-1]))))
        letters = pa.ListArray.from_arrays(pa.array((offsets - offsets[0]).astype(np.int32)), pa.array(data[offsets[0] : offsets[-1]].astype(np.int16)))
        places = pa.StructArray.from_arrays([flat(rows.column("batch")), flat(rows.column("at"))], ["batch", "at"])
        yield pa.RecordBatch.from_arrays([letters, pa.ListArray.from_arrays(pa.array(heads), places)], ["bytes", "places"])


def flat(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)


def dealt(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (ids, places), rows (batch, packed): the ids of words of a batch, with the words' numbers."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for b in it:
        ids, places = b.column(0), b.column(1)
        if not b.num_rows:
            continue
        word = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))
        batch, at = (places.flatten().field(c).to_numpy() for c in ("batch", "at"))
        order = np.argsort(batch, kind="stable")
        heads = np.flatnonzero(np.append(True, np.diff(batch[order]) != 0))
        of, packed = [], []
        for part in np.split(order, heads[1:]):
            got = ids.take(pa.array(word[part]))
            of.append(int(batch[part[0]]))
            packed.append(squeeze(planes(np.concatenate(([len(part)], at[part], np.diff(got.offsets.to_numpy()), got.flatten().to_numpy())))))
        yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.array(packed, pa.binary())], ["batch", "packed"])


def assembled(texts: pa.Table, words: pa.Table) -> pa.Table:
    """(doc_id, ids) of the texts of a batch."""
    expand = zstandard.ZstdDecompressor().decompress
    at, sizes, ids = [], [], []
    for x in words.column("packed"):
        raw = from_planes(expand(x.as_py()))
        n = int(raw[0])
        at.append(raw[1 : n + 1])
        sizes.append(raw[n + 1 : 2 * n + 1])
        ids.append(raw[2 * n + 1 :])
    at, sizes, ids = (np.concatenate(x) if x else np.empty(0, np.int32) for x in (at, sizes, ids))
    size, start = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    size[at], start[at] = sizes, np.cumsum(sizes) - sizes
    out, ends, parts = [], [0], []
    ids_of = texts.column("doc_id").combine_chunks()

    def part(last: int) -> pa.RecordBatch:
        first = sum(p.num_rows for p in parts)
        own = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(out) if out else [], pa.int32()))
        return pa.RecordBatch.from_arrays([ids_of.slice(first, last - first), own], ["doc_id", "ids"])

    for k, x in enumerate(texts.column("text"), 1):
        own = from_planes(expand(x.as_py()))
        n = size[own]
        stops = np.cumsum(n)
        out.append(ids[np.arange(stops[-1] if len(n) else 0) + np.repeat(start[own] - (stops - n), n)])
        ends.append(ends[-1] + len(out[-1]))
        if ends[-1] >= BLOCK_WORDS:
            parts.append(part(k))
            out, ends = [], [0]
    return pa.Table.from_batches([*parts, part(len(ids_of))])


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, batch_bytes: int = BATCH_BYTES, slice_batches: int = SLICE_BATCHES) -> DataFrame:
    """(doc_id, ids), a row for each row of docs; ids as an array."""
    parts = bucketed(cut(docs, pattern, batch_bytes), "batch")
    packed = parts.where("words is not null").select("batch", F.col("doc_id").alias("n"), "words")
    slices_ = -(-packed.count() // slice_batches)
    rows = words_of(packed).withColumn("part", F.pmod(F.xxhash64("batch"), F.lit(max(1, slices_))).cast("int"))
    words = rows.repartition("part", "word").sortWithinPartitions("part", "word").select("part", "word", "batch", "at").mapInArrow(gathered, "bytes array<smallint>, places array<struct<batch:long,at:int>>")
    folded = let(F.col("entries"), lambda e: let(F.col("offsets"), lambda o: let(F.col("byte_ids"), lambda b: fold(F.col("bytes"), e, o, b))))
    of_batch = with_arrays(words, ranks, "entries", "offsets", "byte_ids").select(folded.alias("ids"), "places").mapInArrow(dealt, "batch long, packed binary")
    return parts.where("text is not null").select("batch", "doc_id", "text").groupBy("batch").cogroup(of_batch.groupBy("batch")).applyInArrow(assembled, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """encoded (doc_id, ids) with ``decoded``, the bytes of the ids."""
    return with_arrays(encoded, ranks, "pieces").select(*encoded.columns, let(F.col("pieces"), lambda p: F.unhex(F.array_join(F.transform("ids", lambda i: F.get(p, i)), ""))).alias("decoded"))


def digests(decoded: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of (doc_id, ids, decoded); ids are hashed as little-endian unsigned 32-bit integers."""
    little = let(F.col("words"), lambda w: F.unhex(F.array_join(F.transform("ids", lambda i: F.get(w, i)), "")))
    return with_arrays(decoded, ranks, "words").select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(little, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
