"""What a Python task works on and gives back at a time is bounded by bytes, however large its batches and texts are."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
import pytest
import zstandard

from docloom.llm import bpe, common, kneser_ney
from docloom.operators import chunking, postings, tables
from docloom.sources import extract


class Taken:
    """Stands for a DataFrame; keeps the function that is mapped over its batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def mapInArrow(self, f, schema):  # noqa: N802
        self.f = f
        return self

    def __getattr__(self, name):
        return lambda *a, **k: self


def test_pieces():
    b = pa.RecordBatch.from_pydict({"t": ["aaaa", None, "bbb", "c" * 20, "", "dd"]})
    assert [p.column(0).to_pylist() for p in tables.pieces(b, 0, 7)] == [["aaaa", None, "bbb"], ["c" * 20], ["", "dd"]]
    assert list(tables.pieces(b.slice(0, 0), 0)) == []
    assert [p.column(0).to_pylist() for p in tables.pieces(b.slice(2, 2), 0, 7)] == [["bbb"], ["c" * 20]]


TEXT = "The words of a text. " * 100


@pytest.mark.parametrize("texts", [[TEXT, None, ""] * 1000, [TEXT * 1000]])
def test_chunks_come_in_small_batches(spark, texts):
    taken = Taken(spark)
    chunking.chunk_text(taken)
    out = list(taken.f(iter([pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})])))
    assert len(out) > 1 and max(b.nbytes for b in out) < 2 * tables.PIECE_BYTES
    rows = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert rows == [(i, *c) for i, t in enumerate(texts) for c in chunking.text_chunks(t or "")]


def test_postings_are_sorted_in_small_pieces(spark):
    taken, texts = Taken(spark), [TEXT.lower()] * 2000
    postings.post(taken, 1)
    n = len(texts)
    out = list(taken.f(iter([pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array([0] * n, pa.int32()), pa.array(texts), pa.array([len(TEXT) - 2] * n, pa.int32())], ["document_id", "chunk_index", "lowered", "size"])])))
    assert max(sum(len(p) for p in b.column(4).to_pylist()) for b in out) <= tables.PIECE_BYTES
    assert sum(len(p) for b in out for p in b.column(4).to_pylist()) == n * (len(TEXT) - 2)


def test_files_are_read_in_small_pieces(spark):
    taken, files = Taken(spark), [TEXT.encode()] * 1000 + [None]
    extract.extract(taken)
    n = len(files)
    out = list(taken.f(iter([pa.RecordBatch.from_arrays([pa.array([f"{i}.txt" for i in range(n)]), pa.array([".txt"] * n), pa.array(files, pa.binary())], ["path", "ext", "content"])])))
    assert len(out) > 1 and [r["text"] for b in out for r in b.to_pylist()] == [TEXT] * 1000 + [""]


def test_kernels_of_the_classifier_hold_little(spark, monkeypatch):
    """Arrays of grams are those of a quarter of a megabyte of text, and a slice ends at a number of distinct grams."""

    class All(Taken):
        def mapInArrow(self, f, schema):  # noqa: N802
            self.all = [*self.__dict__.get("all", []), f]
            return self

        applyInArrow = mapInArrow  # noqa: N815

    def most(f):
        tracemalloc.start()
        out = f()
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    for name in ("bucketed", "written", "log_probabilities"):
        monkeypatch.setattr(kneser_ney, name, lambda rows, *_: rows)
    monkeypatch.setattr(kneser_ney, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    counted, scored = All(spark), All(spark)
    kneser_ney.count_grams(counted, 5)
    kneser_ney.score(scored, SimpleNamespace(order=5))
    cut, unpack, deal, add = scored.all
    texts = [(TEXT + str(i)).encode() for i in range(2000)]
    n, peak = most(lambda: sum(pc.sum(b.column(1)).as_py() for b in counted.all[0](iter([pa.RecordBatch.from_arrays([pa.array(texts), pa.array([False] * 2000)], ["text", "toxic"])]))))
    assert n == sum(len(t) - 4 for t in texts) and peak < 32 << 20
    of = lambda texts: pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.nulls(len(texts), pa.string()), pa.array(range(len(texts))), pa.array(texts)], ["doc_id", "lang", "th", "text"])
    parts = pa.Table.from_batches(cut(iter([of(texts)])))
    needs = pa.Table.from_batches(unpack(parts.filter(pc.is_null(parts.column("rows"))).select(["slice", "packed"]).to_batches()))
    values = needs.append_column("a", pa.array([-1.0] * len(needs))).append_column("b", pa.array([-2.0] * len(needs)))
    got, peak = most(lambda: add(parts.filter(pc.is_valid(parts.column("rows"))), pa.Table.from_batches(deal(values.to_batches()))))
    assert [(r["doc_id"], r["n"], r["loss"], r["toxicity"]) for r in got.to_pylist()] == [(i, len(t) - 4, len(t) - 4, -1) for i, t in enumerate(texts)] and peak < 32 << 20
    noise = [np.random.default_rng(i).bytes(1 << 14) for i in range(256)]
    assert len(set(pa.Table.from_batches(cut(iter([of(noise)]))).column("slice").to_pylist())) > 1


def test_kernels_of_the_encoder_hold_little(spark, monkeypatch):
    """Different words of a batch are not Python objects, and texts and ids are given back a block at a time."""
    monkeypatch.setattr(bpe, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 1)))
    taken, long_text = Taken(spark), "ä 1b" * 400_000
    bpe.cut(taken, public_tokenizers.PATTERN, bpe.BATCH_BYTES)
    texts = [" ".join(f"w{'abcdefghij'[k % 10]}{'x' * (i % 7)}{i * 300 + k}" for k in range(300)) for i in range(1500)] + ["", "same", "same", long_text]
    rows = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([t.encode() for t in texts])], ["doc_id", "text"])
    tracemalloc.start()
    out = list(taken.f(iter([rows])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    expand, words = zstandard.ZstdDecompressor().decompress, pa.Table.from_batches(out).filter(pc.is_valid(pc.field("words"))).to_pylist()
    assert peak < 48 << 20 and max(b.num_rows for b in out) < 500 and len(words) == 1 and {b for t in out for b in t.column(0).to_pylist()} == {1 << 24}
    raw, n = expand(words[0]["words"]), words[0]["doc_id"]
    ends = 4 * n + np.cumsum(np.frombuffer(raw, np.int32, n))
    known = np.array([raw[a:b].decode() for a, b in zip([4 * n, *ends[:-1]], ends, strict=True)], object)
    packed = pa.Table.from_batches(out).filter(pc.is_valid(pc.field("text"))).select(["doc_id", "text"])
    got = {r["doc_id"]: "".join(known[bpe.from_planes(expand(r["text"]))]) for r in packed.to_pylist()}
    assert got == dict(enumerate(texts)) and len(set(known)) == n
    of_words = zstandard.ZstdCompressor().compress(bpe.planes(np.concatenate(([n], np.arange(n), np.full(n, 2), np.repeat(np.arange(n), 2) * 2 + np.tile([0, 1], n)))))
    ids = bpe.assembled(packed, pa.table({"packed": pa.array([of_words], pa.binary())}))
    assert len(ids.column("ids").chunks) > 2 and ids.column("doc_id").to_pylist() == packed.column("doc_id").to_pylist()
    assert all((np.array(x[::2], int) // 2 == bpe.from_planes(expand(t))).all() and [b - a for a, b in zip(x[::2], x[1::2], strict=True)] == [1] * (len(x) // 2) for x, t in zip(ids.column("ids").to_pylist(), packed.column("text").to_pylist(), strict=True))


def test_kept_powers_are_small(monkeypatch):
    """What every worker keeps for hashes of ranges is 16 MB at most."""
    monkeypatch.setattr(common, "_POWERS", [])
    assert sum(p.nbytes for p in common.powers(1)) <= 16 << 20
