"""Quality by interpolated modified Kneser-Ney models of bytes, trained on trusted and on toxic text.

``train`` counts the ``ORDER``-grams of the trusted and of the toxic texts (summed per slice before the shuffle) and the
continuation counts of all lower orders, with the totals and interpolation weights of all contexts. Nothing of it is
collected or broadcast but the discounts (six numbers an order): ``score`` cuts the documents into slices, joins the
distinct grams of all slices to the counts, dealt by key, and gives each slice the log probabilities of its own grams,
so that what a task holds is bounded.

A document is rejected if its cross-entropy under the trusted model is above the threshold of its language, or if in
some window of ``WINDOW`` grams the toxic model exceeds the trusted one by more nats than the toxic threshold of its
language. Both are quantiles over trusted documents that were held out of training, plus a margin.

Cases: null, empty and very short texts have no grams and are kept; short texts are drawn towards the mean by
``PRIOR`` bytes, so that chance does not reject them; a language without ``MIN_HELD_OUT`` held-out documents (or a
null one) takes the quantile of all; without trusted text nothing is rejected, without toxic text nothing for
toxicity; repeated rows are scored alike; documents with contradicting labels train neither model; other columns are
never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.llm.common import bounded, bucketed, checkpoint, few, join_few, join_written, slices, text_buffer, text_bytes, written

#: Bytes of a gram; a key holds at most seven and a tag.
ORDER = 5
#: One of so many trusted documents is held out for the thresholds.
HELD_OUT = 5
MIN_HELD_OUT = 30
QUANTILE = 0.99
#: Added to the quantile, in nats a byte.
MARGIN = 0.15
#: Bytes of mean text that every document counts as having besides its own.
PRIOR = 150
#: Grams of a window that is tried for toxicity, and nats added to the quantile of held-out documents.
WINDOW = 16
TOXIC_MARGIN = 3.0
#: Bytes of text whose distinct grams are looked up together, and that are packed together.
SLICE_BYTES, BLOCK_BYTES = 1 << 25, 1 << 20
#: A slice ends at so many distinct grams, whatever its bytes.
SLICE_GRAMS = 1 << 20
#: Bytes of text whose grams are made at a time; a gram takes some 100 bytes of arrays while it is worked on.
GRAM_BYTES = 1 << 18


@dataclass
class Model:
    """Counts of grams and statistics of contexts, for a trusted (a) and a toxic (b) model.

    ``table`` has key, a1, a2, b1, b2: for a gram of k bytes (key(0, k, gram)) its counts a1 and b1; for a context of
    a k-gram (key(1, k, context)) totals a1, b1 and weights of the next lower order a2, b2. ``discounts`` has six
    numbers an order.
    """

    table: DataFrame
    order: int
    discounts: list[list[float]]


def mask(k: int) -> int:
    return (1 << 8 * k) - 1


def key(kind: int, k: Column | int, gram: Column) -> Column:
    """Of a gram (kind 0) or context (kind 1) of order k, from 1 on."""
    tag = F.shiftleft((k if isinstance(k, Column) else F.lit(k)).cast("long"), 57)
    return gram.bitwiseOR(tag).bitwiseOR(F.lit(kind << 56).cast("long"))


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The grams of rows offsets[i]:offsets[i + 1] as numbers, and where each row's begin."""
    base = int(offsets[0])
    text = data[base : offsets[-1]]
    n = max(0, len(text) - order + 1)
    g = np.zeros(n, np.int64)
    for k in range(order):
        g <<= 8
        g |= text[k : k + n]
    ends = np.maximum(offsets[1:] - base - order + 1, offsets[:-1] - base)
    inside = np.zeros(len(text) + 1, np.int32)
    np.add.at(inside, offsets[:-1] - base, 1)
    np.add.at(inside, ends, -1)
    kept = np.cumsum(inside, dtype=np.int32)[:n] > 0
    return g[kept], np.concatenate(([0], np.cumsum(ends - (offsets[:-1] - base))))


def count_grams(texts: DataFrame, order: int) -> DataFrame:
    """(gram, a, b): how often trusted and toxic texts have a gram; texts is (text, toxic)."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for toxic in (False, True):
                rows = b.filter(b.column(1) if toxic else pc.invert(b.column(1)))
                data, offsets = text_buffer(rows.column(0))
                for at, end in slices(offsets, BLOCK_BYTES):
                    made = [grams(data, offsets[at + i : at + j + 1], order)[0] for i, j in slices(offsets[at : end + 1], GRAM_BYTES)]
                    found = pa.chunked_array(made, pa.int64()).value_counts()
                    none = pa.array(np.zeros(len(found), np.int64))
                    counts = [none, found.field("counts")] if toxic else [found.field("counts"), none]
                    yield pa.RecordBatch.from_arrays([found.field("values"), *counts], ["gram", "a", "b"])
        pa.default_memory_pool().release_unused()  # the worker lives on, and with it what counting took

    rows = bounded(texts).select(text_bytes().alias("text"), "toxic").mapInArrow(batches, "gram long, a long, b long")
    return rows.groupBy("gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The discounts of counts 1, 2 and 3 or more, from the numbers of grams of count 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(raw)]


def of_order(values: list[float], k: Column) -> Column:
    return F.get(F.array(*[F.lit(float(v)) for v in values]), k - 1)


def train(texts: DataFrame, order: int = ORDER) -> Model:
    """The model of texts (text, toxic); order is 2 to 7."""
    if not 2 <= order <= 7:
        raise ValueError("order must be 2 to 7")
    top = written(count_grams(texts, order))
    # a lower gram counts the different bytes before it: the different grams one byte longer that end with it
    longer = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("gram").bitwiseAND(F.lit(mask(k + 1))).alias("g")) for k in range(1, order)])).alias("x")
    types = top.select(longer, (F.col("a") > 0).alias("a"), (F.col("b") > 0).alias("b")).groupBy("x.k", "x.g").agg(F.max("a").cast("long").alias("a"), F.max("b").cast("long").alias("b"))
    own = F.lit(0).cast("long")
    for k in range(1, order):
        own = F.when(F.col("k") == k, F.col("g").bitwiseAND(F.lit(mask(k)))).otherwise(own)
    lower = types.select("k", own.alias("gram"), "a", "b").groupBy("k", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    counts = written(lower.unionByName(top.select(F.lit(order).alias("k"), "gram", "a", "b")))
    number = [F.sum((F.col(m) == c).cast("long")).alias(f"{m}{c}") for m in "ab" for c in (1, 2, 3, 4)]
    got = {r["k"]: [*discounts(*r[1:5]), *discounts(*r[5:9])] for r in counts.groupBy("k").agg(*number).collect()}  # a row an order
    found = [got.get(k, [0.5, 1.0, 1.5] * 2) for k in range(1, order + 1)]
    sums = counts.groupBy("k", F.shiftright("gram", 8).alias("context")).agg(*[F.sum(m).alias(m) for m in "ab"], *[F.sum((F.col(m) == c).cast("long") if c < 3 else (F.col(m) > 2).cast("long")).alias(f"{m}{c}") for m in "ab" for c in (1, 2, 3)])
    weight = [sum(F.col(f"{m}{c}") * of_order([d[i * 3 + c - 1] for d in found], F.col("k")) for c in (1, 2, 3)) / F.when(F.col(m) > 0, F.col(m)) for i, m in enumerate("ab")]
    contexts = sums.select(key(1, F.col("k"), F.col("context")).alias("key"), F.col("a").cast("double").alias("a1"), weight[0].alias("a2"), F.col("b").cast("double").alias("b1"), weight[1].alias("b2"))
    none = F.lit(None).cast("double")
    table = counts.select(key(0, F.col("k"), F.col("gram")).alias("key"), F.col("a").cast("double").alias("a1"), none.alias("a2"), F.col("b").cast("double").alias("b1"), none.alias("b2")).unionByName(contexts)
    return Model(written(table), order, found)


def looked_up(rows: DataFrame, model: Model, first: int, last: int) -> DataFrame:
    """rows (gram, below_a, below_b) with the probabilities pa, pb of order ``last``; below are those of the order before ``first``."""
    at = [(kind, k, F.shiftright("gram", 8).bitwiseAND(F.lit(mask(k - 1))) if kind else F.col("gram").bitwiseAND(F.lit(mask(k)))) for k in range(first, last + 1) for kind in (0, 1)]
    found = rows.select("gram", F.explode(F.array(*[key(kind, k, g) for kind, k, g in at])).alias("key")).join(model.table, "key")
    place = F.shiftright("key", 56)
    got = found.groupBy("gram").agg(*[F.max(F.when(place == 2 * k + kind, F.col(c))).alias(f"{c}_{kind}{k}") for kind, k, _ in at for c in (("a1", "a2", "b1", "b2") if kind else ("a1", "b1"))])
    p = []
    for i, m in enumerate("ab"):
        below = F.col(f"below_{m}")
        for k in range(first, last + 1):
            count, total, weight = F.coalesce(F.col(f"{m}1_0{k}"), F.lit(0.0)), F.col(f"{m}1_1{k}"), F.col(f"{m}2_1{k}")
            d1, d2, d3 = model.discounts[k - 1][3 * i : 3 * i + 3]
            own = F.when(count == 0, 0.0).when(count == 1, 1 - d1).when(count == 2, 2 - d2).otherwise(count - d3)
            below = F.when(total > 0, own / total + weight * below).otherwise(below)
        p.append(below.alias(f"p{m}"))
    return rows.join(got, "gram", "left").select("gram", *p)


def log_probabilities(needed: DataFrame, model: Model) -> DataFrame:
    """(gram, a, b): log probability of the last byte of each distinct gram after the others, by both models.

    Many grams end alike: the orders up to ``order`` - 2 are looked up once for all of them.
    """
    low = max(1, model.order - 2)
    ends = needed.select(F.col("gram").bitwiseAND(F.lit(mask(low))).alias("gram")).distinct()
    flat = [F.lit(1 / 256).alias(f"below_{m}") for m in "ab"]
    part = looked_up(ends.select("gram", *flat), model, 1, low)
    if low < model.order:
        rows = needed.withColumn("end", F.col("gram").bitwiseAND(F.lit(mask(low))))
        part = join_few(rows, part.select(F.col("gram").alias("end"), F.col("pa").alias("below_a"), F.col("pb").alias("below_b")), "end")
        part = looked_up(part.select("gram", "below_a", "below_b"), model, low + 1, model.order)
    return part.select("gram", F.log("pa").alias("a"), F.log("pb").alias("b"))


ROW = pa.struct([("doc_id", pa.int64()), ("lang", pa.string()), ("th", pa.int64())])
SCORED = "doc_id long, lang string, th long, n long, loss double, toxicity double"


def summed(data: np.ndarray, offsets: np.ndarray, order: int, gram: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, loss, toxicity) of each row, where a and b are the log probabilities of the sorted grams ``gram``."""
    g, at = grams(data, offsets, order)
    n = np.diff(at)
    if not len(g):
        return n, np.zeros(len(n)), np.zeros(len(n))
    coded = pa.array(g).dictionary_encode()
    own = np.searchsorted(gram, coded.dictionary.to_numpy())[coded.indices.to_numpy()]
    loss = np.concatenate(([0.0], np.cumsum(a[own])))
    ratio = np.concatenate(([0.0], np.cumsum(b[own] - a[own])))
    end = np.minimum(np.arange(len(g)) + WINDOW, np.repeat(at[1:], n))
    window = ratio[end] - ratio[:-1]
    full = n > 0
    toxicity = np.zeros(len(n))
    toxicity[full] = np.maximum.reduceat(window, at[:-1][full])
    return n, loss[at[:-1]] - loss[at[1:]], toxicity


def score(docs: DataFrame, model: Model) -> DataFrame:
    """SCORED, a row for each row of docs: number of grams, their summed negative log probability, the most that the
    toxic model exceeds the trusted one by in a window; th tells texts of one id apart."""
    order = model.order
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("th"), text_bytes().alias("text"))

    def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows with their packed texts and the number of their slice; after a slice, its packed distinct grams."""
        squeeze, number = zstandard.ZstdCompressor(level=5).compress, TaskContext.get().partitionId() << 32
        names, found, size = ["slice", "rows", "sizes", "packed"], [], 0

        def row(rows: pa.Array | None, sizes: np.ndarray, packed: bytes) -> pa.RecordBatch:
            block = pa.nulls(1, pa.list_(ROW)) if rows is None else pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            return pa.RecordBatch.from_arrays([pa.array([number]), block, pa.array([sizes.tolist()], pa.list_(pa.int64())), pa.array([packed], pa.binary())], names)

        def last() -> pa.RecordBatch:
            g = found[0]
            return row(None, np.array([len(g)]), squeeze(np.diff(g, prepend=0).tobytes()))

        for b in it:
            data, offsets = text_buffer(b.column(3))
            for at, end in slices(offsets, BLOCK_BYTES):
                if size and (size + offsets[end] - offsets[at] > SLICE_BYTES or len(found[0]) > SLICE_GRAMS):
                    yield last()
                    number, found, size = number + 1, [], 0
                for i, j in slices(offsets[at : end + 1], GRAM_BYTES):
                    found.append(np.unique(grams(data, offsets[at + i : at + j + 1], order)[0]))
                found = [np.unique(np.concatenate(found))]
                size += int(offsets[end] - offsets[at])
                rows = pa.StructArray.from_arrays([b.column(k)[at:end] for k in range(3)], fields=list(ROW))
                yield row(rows, np.diff(offsets[at : end + 1]), squeeze(data[offsets[at] : offsets[end]].tobytes()))
        if found:
            yield last()

    def unpack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in it:
            for s, packed in zip(b.column(0).to_numpy(), b.column(1), strict=True):
                g = np.cumsum(np.frombuffer(expand(packed.as_py()), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), s)), pa.array(g)], ["slice", "gram"])

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed values of each slice in a batch, all first bytes before all second ones and so on."""
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for b in it:
            s, g, a_, b_ = (c.to_numpy() for c in b.columns)
            by = np.lexsort((g, s))
            for part in np.split(by, np.flatnonzero(np.diff(s[by])) + 1):
                if len(part):
                    values = np.stack([np.diff(g[part], prepend=0), a_[part].view(np.int64), b_[part].view(np.int64)])
                    packed = squeeze(values.view(np.uint8).reshape(3, -1, 8).transpose(0, 2, 1).tobytes())
                    yield pa.RecordBatch.from_arrays([pa.array([s[part[0]]]), pa.array([len(part)], pa.int64()), pa.array([packed], pa.binary())], ["slice", "n", "packed"])

    def add(texts: pa.Table, values: pa.Table) -> pa.Table:
        expand = zstandard.ZstdDecompressor().decompress
        planes = (np.frombuffer(expand(x.as_py()), np.uint8).reshape(3, 8, -1) for x in values.column("packed"))
        known = [np.ascontiguousarray(x.transpose(0, 2, 1)).view(np.int64)[:, :, 0] for x in planes]
        gram = np.concatenate([np.cumsum(x[0]) for x in known] or [np.empty(0, np.int64)])
        a, b = (np.concatenate([np.ascontiguousarray(x[k]).view(np.float64) for x in known] or [np.empty(0)]) for k in (1, 2))
        by = np.argsort(gram)
        gram, a, b = gram[by], a[by], b[by]
        out = []
        for rows, sizes, packed in zip(texts.column("rows"), texts.column("sizes"), texts.column("packed"), strict=True):
            data, offsets = np.frombuffer(expand(packed.as_py()), np.uint8), np.concatenate(([0], np.cumsum(sizes.values.to_numpy()))).astype(np.int64)
            for i, j in slices(offsets, GRAM_BYTES):
                n, loss, toxicity = summed(data, offsets[i : j + 1], order, gram, a, b)
                own = rows.values.slice(i, j - i)
                out.append(pa.table({**{f.name: own.field(f.name) for f in ROW}, "n": pa.array(n), "loss": pa.array(loss), "toxicity": pa.array(toxicity)}))
        return pa.concat_tables(out)

    parts = bucketed(rows.mapInArrow(cut, "slice long, rows array<struct<doc_id:long,lang:string,th:long>>, sizes array<long>, packed binary"), "slice")
    needs = parts.where("rows is null").select("slice", "packed").mapInArrow(unpack, "slice long, gram long")
    values = written(log_probabilities(written(needs.select("gram").distinct()), model))
    of_slice = needs.join(values, "gram").select("slice", "gram", "a", "b").mapInArrow(deal, "slice long, n long, packed binary")
    return parts.where("rows is not null").groupBy("slice").cogroup(of_slice.groupBy("slice")).applyInArrow(add, SCORED)


def roles(labels: DataFrame) -> DataFrame:
    """(doc_id, role): trusted (every label good, none toxic), held out (one trusted in HELD_OUT), or toxic (every label)."""
    of = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"), F.min(F.coalesce("toxic", F.lit(0))).alias("all"))
    held = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    return of.select("doc_id", F.when((F.col("q") == 1) & (F.col("t") == 0), F.when(held, "held out").otherwise("trusted")).when(F.col("all") == 1, "toxic").alias("role")).where("role is not null")


def entropy(mean: Column) -> Column:
    """Cross-entropy in nats a byte, with the prior."""
    return (F.col("loss") + PRIOR * mean) / (F.col("n") + PRIOR)


def verdicts(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE, margin: float = MARGIN, toxic_margin: float = TOXIC_MARGIN) -> DataFrame:
    """(doc_id, lang, n_grams, cross_entropy, perplexity, threshold, toxicity, toxic_threshold, kept), a row for each row of docs."""
    return judged(docs, labels, order, quantile, margin, toxic_margin).drop("th")


def judged(docs: DataFrame, labels: DataFrame, order: int, quantile: float, margin: float, toxic_margin: float) -> DataFrame:
    """The verdicts, with th."""
    of = checkpoint(roles(labels))
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    model = train(join_written(narrow, of.where("role <> 'held out'"), "doc_id").select("text", (F.col("role") == "toxic").alias("toxic")), order)
    scored = checkpoint(score(narrow, model))
    held = join_written(scored, of.where("role = 'held out'"), "doc_id").where("n > 0")
    total = model.table.where(F.col("key") == F.lit(1 << 57 | 1 << 56)).select("a1", "b1").first()  # totals of all bytes
    mean = held.agg((F.sum("loss") / F.sum("n")).alias("m")).first()["m"] if total is not None and total["a1"] else None
    none = F.lit(None).cast("double")
    if mean is None:  # nothing trusted, or nothing held out
        alone = F.col("loss") / F.when(F.col("n") > 0, F.col("n"))
        return scored.select("doc_id", "lang", "th", F.col("n").alias("n_grams"), alone.alias("cross_entropy"), F.exp(alone).alias("perplexity"), none.alias("threshold"), none.alias("toxicity"), none.alias("toxic_threshold"), F.lit(True).alias("kept"))
    e = entropy(F.lit(mean))
    near = [F.percentile_approx(c, quantile, 10_000).alias(n) for c, n in ((e, "q"), (F.col("toxicity"), "tq"))]
    whole = held.agg(*near).first()
    of_lang = held.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"), *near).where((F.col("docs") >= MIN_HELD_OUT) & F.col("lang").isNotNull()).select("lang", "q", "tq")
    threshold = F.coalesce("q", F.lit(whole["q"])) + margin
    toxicity, most = (F.col("toxicity"), F.coalesce("tq", F.lit(whole["tq"])) + toxic_margin) if total["b1"] else (none, none)
    kept = (F.col("n") == 0) | ((e <= threshold) & F.coalesce(toxicity <= most, F.lit(True)))
    return join_few(scored, of_lang, "lang", "left").select("doc_id", "lang", "th", F.col("n").alias("n_grams"), e.alias("cross_entropy"), F.exp(e).alias("perplexity"), threshold.alias("threshold"), toxicity.alias("toxicity"), most.alias("toxic_threshold"), kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of docs that the classifier keeps; a row of a rejected id is kept if its own text passes."""
    settings = {"order": ORDER, "quantile": QUANTILE, "margin": MARGIN, "toxic_margin": TOXIC_MARGIN} | options
    gone = checkpoint(judged(docs, labels, **settings).where("not kept").select("doc_id", "th").distinct())
    rows, gone = docs.alias("d"), few(gone).alias("g")
    return rows.join(gone, F.expr("cast(d.doc_id as long) <=> g.doc_id and xxhash64(d.text) = g.th"), "left_anti")
