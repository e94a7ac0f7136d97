"""Mixing, order and progress by their relations: nothing twice, nothing lost, any topology alike."""

import random

from pyspark.sql import functions as F

from sparkloom.operators import curriculum as C
from sparkloom.operators import mixing as M
from sparkloom.operators import order as O
from sparkloom.operators import progress as Pr


def test_counter_random_goldens():
    got = [n for _, n, _ in M.interleave_slot(dict.fromkeys(("web", "code", "math"), 99), {"code": 0.3, "math": 0.2, "web": 0.5}, 0, most=12)]
    assert got == "web web math code web math code code web web math web".split()


def test_legacy_permutation_goldens():
    assert O.legacy_permutation(42, 0, 8) == [2, 0, 3, 6, 5, 1, 4, 7]
    assert O.legacy_permutation(42, 1, 8) == [5, 1, 3, 6, 2, 7, 4, 0]


def test_weighted_shares_and_exhaustion():
    names = [n for _, n, _ in M.interleave_slot({"a": 500, "b": 500, "c": 500}, {"a": 0.7, "b": 0.2, "c": 0.1}, 0, most=250)]
    assert 0.5 < names.count("a") / 250 < 0.9 and 0.05 < names.count("b") / 250 < 0.4
    both = list(M.interleave_slot({"small": 2, "large": 50}, {"small": 0.5, "large": 0.5}, 0, seed=0))
    assert len(both) == 52 and [c for c, _, _ in both] == list(range(52))


def test_round_robin_and_chain(spark):
    sizes = {"a": 4, "b": 1, "c": 3}
    items = spark.createDataFrame([(b, i) for b, n in sizes.items() for i in range(n)], "s string, ord long")
    order = [(r.s, r.ord) for r in sorted(M.round_robin(items, "s", sizes).collect(), key=lambda r: r.place)]
    assert order == [("a", 0), ("b", 0), ("c", 0), ("a", 1), ("c", 1), ("a", 2), ("c", 2), ("a", 3)]
    assert sorted(r.place for r in M.chain(items, "s", sizes).collect()) == list(range(8))


def test_merge_is_an_algebra(spark):
    rng = random.Random(5)
    parts = [[("b", f, rng.choice([-1, 0, 3, 7, 9])) for f in range(6)] for _ in range(3)]
    schema = "bucket string, file_idx int, progress int"

    def merged(*ps):
        rows = [r for p in ps for r in p]
        return {(r.bucket, r.file_idx): r.progress for r in Pr.merge(spark.createDataFrame(rows, schema)).collect()}

    def rows(m):
        return [(b, f, p) for (b, f), p in m.items()]

    a, b, c = parts
    assert merged(a, b) == merged(b, a) and merged(a, a) == merged(a)
    assert merged(rows(merged(a, b)), c) == merged(a, rows(merged(b, c)))


def test_exactly_once_under_other_topologies(spark):
    sizes = [("b", f, 24) for f in range(4)]
    shards = spark.createDataFrame([(b, f, n) for b, f, n in sizes], "bucket string, file_idx int, n int")
    items = shards.select("bucket", "file_idx", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("item_no"))
    everything = {(r.file_idx, r.item_no) for r in items.collect()}
    for (w, k), (w2, k2) in [((1, 1), (1, 2)), ((1, 2), (1, 1)), ((2, 1), (1, 2)), ((1, 4), (2, 2))]:
        slots = O.assign_longest_first(shards.withColumnRenamed("n", "tokens"), w * k)
        seen = items.join(slots, ["bucket", "file_idx"]).where(F.col("item_no") <= 5 + F.col("slot") * 7)
        first = {(r.file_idx, r.item_no) for r in seen.collect()}
        merged = Pr.merge(Pr.cut(seen, shards))
        rest = Pr.resume(items, merged).join(O.assign_longest_first(shards.withColumnRenamed("n", "tokens"), w2 * k2), ["bucket", "file_idx"])
        left = [(r.file_idx, r.item_no) for r in rest.collect()]
        assert len(left) == len(set(left)) and not first & set(left) and first | set(left) == everything


def test_phase_ends_with_the_step_that_reaches_it(spark):
    steps = spark.createDataFrame([(i, 10) for i in range(8)], "step long, tokens long")
    got = [(r.phase_idx, r.phase_tokens) for r in C.phase_of_steps(steps, [25, 20, 99]).orderBy("step").collect()]
    assert got == [(0, 10), (0, 20), (0, 30), (1, 10), (1, 20), (2, 10), (2, 20), (2, 30)]


def test_bad_phases_raise(spark):
    for rows in ([(0, 0, "a", 1.0)], [(0, 5, "a", -1.0), (0, 5, "b", 2.0)], [(0, 5, "a", 0.0)]):
        try:
            C.normalise(spark.createDataFrame(rows, "phase_idx int, duration_tokens int, bucket string, weight double")).collect()
        except Exception as e:
            assert "phase 0" in str(e)
        else:
            raise AssertionError(rows)


def test_longest_first_balances(spark):
    rows = [("a", i, n) for i, n in enumerate([9, 7, 7, 5, 4, 3, 3, 1])]
    got = {r.file_idx: r.slot for r in O.assign_longest_first(spark.createDataFrame(rows, "bucket string, file_idx int, tokens int"), 3).collect()}
    load = [sum(n for _, i, n in rows if got[i] == s) for s in range(3)]
    assert max(load) - min(load) <= 2 and len(got) == 8


def test_shuffle_is_a_permutation_of_each_group(spark):
    rows = [("a", f, i) for f, n in ((0, 300), (1, 5)) for i in range(n)] + [(None, None, i) for i in range(4)]
    d = spark.createDataFrame(rows, "bucket string, file_idx int, i long")
    got = O.shuffled_positions(d, ["bucket", "file_idx"], ["i"]).collect()
    by = {}
    for r in got:
        by.setdefault((r.bucket, r.file_idx), {})[r.i] = r.doc_pos
    assert {k: sorted(v.values()) for k, v in by.items()} == {("a", 0): list(range(300)), ("a", 1): list(range(5)), (None, None): list(range(4))}
    one = O.positions(d.withColumn("k", O.shuffle_key(42, "file_idx", "i")), ["bucket", "file_idx"], ["k", "i"], "p").collect()
    assert all(by[r.bucket, r.file_idx][r.i] == r.p for r in one)
    assert list(by["a", 0].values()) != sorted(by["a", 0].values())
