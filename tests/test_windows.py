"""Windows at every boundary, against a plain model."""

import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.functions import tokens as T
from sparkloom.functions.tokens import codepoint_tokens
from sparkloom.operators import packing as P
from sparkloom.operators.windows import WindowSpec, explode_windows, overlap_mask, window_counts, window_lengths


def model(n, length, overlap):
    if n < length:
        return [(0, list(range(n)) + [-1])]
    stride, out = max(length - overlap, length // 2), []
    for k, a in enumerate(range(0, n, stride)):
        body = list(range(a, min(a + length, n)))
        out.append((min(overlap, len(body)) if k else 0, body + [-1] if a + length >= n else body))
    return out


@pytest.mark.parametrize(("length", "overlap"), [(64, 16), (16, 0), (16, 8), (10, 3)])
def test_boundaries(spark, length, overlap):
    sizes = sorted({0, 1, length - 1, length, length + 1, 2 * length, 3 * length - overlap, 200, 5 * length + 3})
    docs = spark.createDataFrame([(n, list(range(n))) for n in sizes], "n int, tokens array<int>")
    spec = WindowSpec(length, overlap)
    got = {}
    for r in explode_windows(docs, spec, eod=F.lit(-1)).collect():
        got.setdefault(r.n, {})[r.window_idx] = (r.overlap_len, list(r.tokens))
    assert 0 not in got
    for n in sizes[1:]:
        assert [got[n][k] for k in sorted(got[n])] == model(n, length, overlap)
    counts = {r.n_tokens: r.n_windows for r in window_counts(docs.select(F.col("n").alias("n_tokens")), spec).collect()}
    assert counts == {n: len(model(n, length, overlap)) if n else 0 for n in sizes}


def test_long_document_ends_twice(spark):
    d = spark.createDataFrame([(list(range(10, 210)),)], "tokens array<int>")
    w = sorted(explode_windows(d, WindowSpec(64, 16), eod=F.lit(0)).collect(), key=lambda r: r.window_idx)
    assert [len(r.tokens) for r in w] == [64, 64, 64, 57, 9]
    assert [r.overlap_len for r in w] == [0, 16, 16, 16, 8]
    assert [r.ends for r in w] == [False, False, False, True, True]


def test_cap_keeps_one_more(spark):
    d = spark.createDataFrame([(list(range(100)),)], "tokens array<int>")
    assert explode_windows(d, WindowSpec(2, 0, cap=5), eod=F.lit(0)).count() == 6


def naive_first_fit(lengths, room):
    free, out = [], []
    for n in lengths:
        for i, f in enumerate(free):
            if f >= n:
                break
        else:
            i = len(free)
            free.append(room)
        free[i] -= n
        out.append(i)
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=80))
def test_first_fit_is_the_naive_one(lengths):
    order = sorted(lengths, reverse=True)
    assert P.first_fit(order, 64) == naive_first_fit(order, 64)


def test_packing_places_every_window_once(spark):
    rows = [("a", 0, i, (i * 37) % 60 + 1) for i in range(700)]
    w = P.with_buffers(spark.createDataFrame(rows, "bucket string, file_idx int, doc_pos long, n_tokens long"))
    placed = P.pack_ffd(w, 128, group=["bucket", "file_idx"])
    out = placed.join(w.drop("n_tokens"), ["bucket", "file_idx", "buffer_idx", "doc_pos"]).collect()
    assert sorted(r.doc_pos for r in out) == list(range(700))
    load = {}
    for r in out:
        load[r.buffer_idx, r.seq_idx] = load.get((r.buffer_idx, r.seq_idx), 0) + r.n_tokens
    assert max(load.values()) <= 128
    assert sum(load.values()) / (128 * len(load)) > 0.85


def test_best_fit_never_places_what_is_too_long(spark):
    rows = [(0, d, 0, 129 if d % 10 == 0 else 20 + d % 90) for d in range(300)]
    w = spark.createDataFrame(rows, "slot int, doc long, window_idx int, n_tokens int")
    placed = P.pack_best_fit(w, 128, group=["slot"], doc="doc").collect()
    n = {r[1]: r[3] for r in rows}
    load = {}
    for r in placed:
        load[r.seq_idx] = load.get(r.seq_idx, 0) + n[r.doc]
    assert all(n[r.doc] <= 128 for r in placed) and max(load.values()) <= 128
    assert len({r.doc for r in placed}) == len(placed) == sum(v <= 128 for v in n.values())


def test_lengths_alone_are_those_of_the_windows(spark):
    d = spark.createDataFrame([(n, list(range(n))) for n in (0, 1, 31, 63, 64, 65, 111, 112, 113, 160, 500, 3000)], "doc int, tokens array<int>")
    for spec in (WindowSpec(64, 16), WindowSpec(64, 0), WindowSpec(64, 50, cap=5)):
        full = explode_windows(d, spec, eod=F.lit(-1)).select("doc", "window_idx", "overlap_len", F.size("tokens").cast("long").alias("n_tokens"))
        slim = window_lengths(d.select("doc", F.size("tokens").alias("n")), spec, "n")
        assert sorted(map(tuple, slim.collect())) == sorted(map(tuple, full.collect()))


def plain_best_fit(docs, length):
    """The packer by its rules alone: every step looks at all that waits."""
    bounds, bins, out, filling = P.bin_bounds(length), {}, [], []

    def fill():
        while length - sum(n for n, _ in filling) >= P.LEAST_ROOM:
            room = length - sum(n for n, _ in filling)
            fits = [(-n, i, b) for b, waiting in bins.items() for i, (n, _) in enumerate(waiting) if n <= room]
            if not fits:
                return
            _, i, b = min(fits)
            filling.append(bins[b].pop(i))
            if not bins[b]:
                del bins[b]

    def leave():
        out.append([x for _, x in filling])
        filling.clear()

    def settle():
        fill()
        if sum(n for n, _ in filling) >= int(length * P.TARGET):
            leave()

    for d, windows in enumerate(docs, 1):
        for x in windows:
            b = next((i for i, (a, z) in enumerate(bounds) if a <= x[0] <= z), len(bounds) - 1)
            if len(bins.get(b, [])) >= P.BIN_CAP:
                settle()
            bins.setdefault(b, []).append(x)
        if d % 100 == 0 and bins:
            settle()
    while bins:
        fill()
        if not filling:
            break
        leave()
    return out


def test_best_fit_by_counts_is_the_plain_packer(spark):
    draw = random.Random(5)
    for length, most, cap in ((128, 129, 512), (512, 513, 512), (300, 90, 5), (1000, 400, 3)):
        docs = [[(draw.randint(1, most), (d, i)) for i in range(draw.choice((1, 1, 2, 7)))] for d in range(350)]
        before, P.BIN_CAP = P.BIN_CAP, cap
        try:
            want = plain_best_fit(docs, length)
            state, named = P.BestFit(length), {}
            for d in docs:
                for n, x in d:
                    named[n, state.add(n)] = x
                state.end_document()
            list(state.finish())
            assert [[named[w] for w in seq] for seq in state.out] == want
        finally:
            P.BIN_CAP = before
    # The same through the operator, with two groups that one task may read, and columns that pass by.
    rows = [(g, f"b{d % 3}" if d % 3 else None, d, i, n) for g in (0, None) for d, ws in enumerate(docs) for i, (n, _) in enumerate(ws)]
    w = spark.createDataFrame(rows, "slot int, bucket string, doc long, window_idx int, n_tokens int")
    got = P.pack_best_fit(w, 1000, group=["slot"], doc="doc", keep=["bucket"]).collect()
    want = plain_best_fit(docs, 1000)
    for g in (0, None):
        own = {(r.seq_idx, r.place): (r.doc, r.window_idx) for r in got if r.slot == g}
        assert own == {(s, k): x for s, seq in enumerate(want) for k, x in enumerate(seq)}
    assert all(r.bucket == (f"b{r.doc % 3}" if r.doc % 3 else None) for r in got)
    assert P.pack_best_fit(w.limit(0), 1000, group=["slot"], doc="doc").count() == 0


def test_best_fit_time_goes_with_the_number_of_windows():
    """A sequence left between half and nine tenths full stays until the end, so all other windows wait; a step must not look at each of them."""
    began, state = time.perf_counter(), P.BestFit(128)
    for i in range(100_000):
        state.add(1 + i * 7919 % 128)
        state.end_document()
    list(state.finish())
    assert sum(map(len, state.out)) == 100_000 and time.perf_counter() - began < 20


def test_code_points_from_texts_are_those_from_arrays(spark):
    texts = [None, "", "a", "x" * 127, "y" * 128, "zé🎉\n" * 70, "日本" * 200, "w" * 1000]
    d = spark.createDataFrame([(i, None if i % 2 else "en", t) for i, t in enumerate(texts)], "doc_id long, bucket string, text string")
    spec = WindowSpec.streaming(128, 32)
    w = explode_windows(d.select("doc_id", "bucket", codepoint_tokens("text").alias("tokens")), spec, eod=F.lit(-1)).withColumn("slot", F.lit(1))
    slim = window_lengths(d.select("doc_id", "bucket", F.length(F.coalesce("text", F.lit(""))).alias("n_tokens")), spec).withColumn("slot", F.lit(1))
    placed = P.pack_best_fit(slim, 128, group=["slot"], keep=["bucket"], doc="doc_id")
    own = w.select("slot", "doc_id", "window_idx", "tokens", overlap_mask().alias("repeated"), F.xxhash64("doc_id", "window_idx").alias("id"))
    want = P.assemble(own, placed.drop("bucket"), ["slot", "doc_id", "window_idx"], ["slot", "seq_idx"], length=128, window_id="id")
    want = want.select("slot", "seq_idx", "ids", "repeated", "n_windows", F.size(F.array_distinct("window_ids")))
    got = P.assemble_code_points(d, placed, spec, doc=["bucket", "doc_id"], seq=["slot", "seq_idx"], length=128, eod=-1)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []


def test_few_characters_are_encoded_at_once(monkeypatch):
    import types

    seen = []

    class Library:
        def encode_batch(self, texts, add_special_tokens):
            seen.append(sum(map(len, texts)))
            return [types.SimpleNamespace(ids=list(range(len(t)))) for t in texts]

    monkeypatch.setattr(T, "load", lambda spec: Library())
    texts = ["a" * 100_000] * 9 + ["", "b" * 500_000, "c"]
    assert list(map(len, T.encode_texts(T.TokenizerSpec("bpe", "x", 1, 0, 0, 0), texts))) == list(map(len, texts))
    assert max(seen) == 500_000 and sorted(seen)[-2] <= T.PORTION


def test_counts_are_those_of_the_ids(spark):
    texts = [None, "", " ", "it's a <|endoftext|> test", "日本語 テキスト 🎉", "word " * 60_000, "x"] * 3
    for name in ("gpt2", "piece_bpe_32k", "word", "codepoint"):
        spec = T.resolve(name)
        rows = spark.createDataFrame([(t,) for t in texts], "text string").select(F.size(T.encode(spec)("text")).alias("want"), T.count(spec)("text").alias("got")).collect()
        assert [r.got for r in rows] == [r.want for r in rows] and max(r.got for r in rows) >= 60_000
