import random

from pyspark.sql import functions as F

from sparkloom.functions import sequences as S


def finished(spark, ids, repeated, length=16, eod=0, pad=1):
    d = spark.createDataFrame([(ids, repeated)], "ids array<int>, repeated array<int>")
    d = S.finalize(d, length, repeated="repeated", eod=eod, pad=pad).withColumn("pairs", S.allowed_pairs(F.col("input_ids"), F.col("content_len"), eod))
    return d.first()


def test_two_documents(spark):
    r = finished(spark, [10, 11, 12, 0, 20, 21, 0], [0] * 7)
    assert r.input_ids == [10, 11, 12, 0, 20, 21, 0] + [1] * 9
    assert r.labels == [10, 11, 12, 0, -100, 21, 0] + [-100] * 9
    assert r.attention_mask == [1] * 7 + [0] * 9
    assert r.position_ids == list(range(7)) + [0] * 9
    assert r.doc_ids == [0] * 4 + [1] * 3 + [0] * 9
    assert r.pairs == 10 + 6


def test_repeated_tokens_are_no_targets(spark):
    r = finished(spark, [50, 51, 52, 53, 60, 61, 62, 0], [1, 1, 1, 1, 0, 0, 0, 0], length=32)
    assert r.labels[:8] == [-100] * 4 + [60, 61, 62, 0]


def test_truncation_loses_the_end_mark(spark):
    r = finished(spark, list(range(10, 26)) + [0], [0] * 17)
    assert r.content_len == 16 and r.labels == list(range(10, 26)) and r.doc_ids == [0] * 16


def test_full_and_empty(spark):
    r = finished(spark, [], [])
    assert r.labels == [-100] * 16 and r.doc_ids == [0] * 16 and r.pairs == 0
    targets = spark.createDataFrame([([1, 2, 3],), ([5],), ([],)], "labels array<int>").select(S.shifted_targets().alias("t")).collect()
    assert [x.t for x in targets] == [[2, 3], [], []]


def test_one_pass_is_the_expressions(spark):
    """Random sequences, some too long, empty or null; all vectors and each alone."""
    rng = random.Random(1)
    rows = [(i, None if i == 3 else [rng.choice([0, 0, 5, 6, 7]) for _ in range(n)], rng.randint(0, n), n) for i in range(60) for n in [rng.choice([0, 1, 5, 15, 16, 17, 30])]]
    d = spark.createDataFrame([(i, x, k, [1] * k + [0] * (n - k)) for i, x, k, n in rows], "i int, ids array<int>, k int, repeated array<int>")
    e = d.withColumn("ids", F.coalesce("ids", F.array().cast("array<int>"))).withColumn("content", S.content_length("ids", 16)).withColumn("input_ids", S.fit_length("ids", 16, 1))
    n, x = F.col("content"), F.col("input_ids")
    want = e.select("i", n.alias("content_len"), "input_ids", S.attention_mask(n, 16).alias("attention_mask"), S.labels(x, n, F.col("repeated"), 0).alias("labels"), S.position_ids(n, 16).alias("position_ids"), S.doc_ids(x, n, 0).alias("doc_ids"))
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, S.finalize(d.drop("k"), 16, repeated="repeated", eod=0, pad=1).collect())) == want
    by_overlap = S.finalize(d.drop("repeated"), 16, overlap="k", eod=0, pad=1).drop("k")
    assert sorted(map(tuple, by_overlap.collect())) == want
    one = S.finalize(d.drop("repeated"), 16, overlap="k", eod=0, pad=1, columns=("labels",))
    assert one.columns == ["i", "k", "content_len", "labels"] and sorted((r.i, r.labels) for r in one.collect()) == [(r[0], r[4]) for r in want]
    assert S.finalize(d.limit(0), 16, eod=0, pad=1).count() == 0
