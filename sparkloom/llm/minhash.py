"""Near-duplicates by bottom-k sketches (operator 5).

One hash function orders all shingles; a document's sketch is its k smallest hashes. Inverted lists of retained values
generate candidates, the sketch of a pair's union estimates its similarity, and exact Jaccard on full sets confirms.

1. Texts with equal sets are a class; only classes are compared.
2. A pair over the threshold t shares most of its k values: fewer than s = k(t - 0.35) shared ones are over five standard
   deviations away (for sets of at most k shingles the bound is the exact one, ceil(t n)). So of each sketch only the k - s + 1
   rarest values need lists, and two linked classes still meet in one: passages that many documents share stay out of
   the lists unless they make up half a document.
3. Each list compares its members with one pivot, the member whose values are the commonest; links are joined to
   components. That settles a large group of near copies with as many pairs as members.
4. Members of a list that are still in different components are compared with each other; the pivot, which has met them all, is not.
   Near copies share many lists and so their pivot: the lists of one pivot are gone through together, and a member's sketch
   travels to a pivot once. That goes on in blocks of a bounded size, tile by tile; only pairs whose estimate can reach t leave
   the block. So no link is lost, and pairs inside a component are never made.

Classes are numbered when they are written, and go by that number from then on. Pairs are verified in a stream: a task holds one
class's set and lets the sets of its partners pass by; a class with many partners is dealt out over many tasks. `NearDup.exact` keeps whole sets in the place of sketches: then nothing is left to chance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import id_filter, is_named, join_hot, marked, materialise, parted
from sparkloom.llm.components import components
from sparkloom.llm.shingles import shingle_sets


@dataclass(frozen=True)
class NearDup:
    """Words of a shingle, similarity in hundredths, retained values for lists and for estimates, members of a block and of a
    tile inside it, partners of a class that are verified in one task, and the standard deviations that an estimate may lie below the threshold."""

    width: int = 5
    percent: int = 80
    k: int = 32
    estimate_k: int = 256
    block: int = 1024
    tile: int = 256
    partners: int = 256
    deviations: float = 4.5

    @property
    def shared(self) -> int:
        return int(self.k * (self.percent / 100 - 0.35))

    @classmethod
    def exact(cls, width: int = 5, percent: int = 80) -> NearDup:
        """Sketches that hold whole sets: lists keep the exact prefix and estimates are the similarity itself."""
        return cls(width, percent, k=2**31 - 1, estimate_k=2**31 - 1)


def _signed(values) -> pa.Array:
    """Unsigned hashes in an order-keeping signed form."""
    import numpy as np

    flat = np.concatenate(values) if values else np.zeros(0, np.uint64)
    at = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype("int32")
    return pa.ListArray.from_arrays(pa.array(at), pa.array((flat ^ np.uint64(1 << 63)).view(np.int64)))


def sketches(df: DataFrame, how: NearDup, *, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, n_shingles, cls, low): size and digest of the set (null without words), and its k smallest hashes; and what `extra` names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                sets = shingle_sets(b.column(1).slice(i, 512).to_pylist(), how.width)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 512), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.string()), _signed([s[: how.k] for s in sets]), *[c.slice(i, 512) for c in b.columns[2:]]], names=["doc_id", "n_shingles", "cls", "low", *more])

    slim = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *[c.alias(k) for k, c in (extra or {}).items()])
    more = slim.columns[2:]
    schema = f"doc_id {slim.dtypes[0][1]}, n_shingles long, cls string, low array<long>" + "".join(f", {k} {t}" for k, t in slim.dtypes[2:])
    return slim.mapInArrow(run, schema)


def full_sets(df: DataFrame, how: NearDup, wanted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", named: str = "cls") -> DataFrame:
    """(cls, set) of the classes in `wanted` (rep, cls), from the texts of their representatives; `named` is the column of `wanted` by which classes go afterwards.
    Texts don't travel: a filter of ids leaves out most rows where the texts are, and the exact join meets sets."""
    texts = df.select(F.col(id_col).alias("rep"), F.xxhash64(id_col).alias("h"), F.col(text_col).alias("text"))
    bits = df.sparkSession.sparkContext.broadcast(id_filter(wanted, "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(marked(b.column(1).to_numpy(), bits.value)))
            for i in range(0, b.num_rows, 512):
                sets = shingle_sets(b.column(2).slice(i, 512).to_pylist(), how.width)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 512), pa.array(digests, pa.string()), _signed(sets)], names=["rep", "cls", "set"])

    made = texts.mapInArrow(run, f"rep {texts.dtypes[0][1]}, cls string, set array<long>")
    # A repeated id may bring the same set twice.
    return made.join(wanted.select(*dict.fromkeys(["rep", "cls", named])).distinct(), ["rep", "cls"]).dropDuplicates(["rep", "cls"]).select(F.col(named).alias("cls"), "set")


def _some(sets: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """The rows of `sets` whose class is in one of the `columns` of `wanted`, and a few others: what nothing meets doesn't go through a shuffle."""
    ids = wanted.select(F.explode(F.array(*columns)).alias("cls"))
    bits = sets.sparkSession.sparkContext.broadcast(id_filter(ids, "cls"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 512):
                part = b.slice(i, 512)
                yield part.select(part.schema.names[:-1]).filter(pa.array(marked(part.column(part.num_columns - 1).to_numpy(), bits.value)))

    return sets.withColumn("_h", F.xxhash64("cls")).mapInArrow(run, ", ".join(f"{k} {t}" for k, t in sets.dtypes))


def numbered(rows: DataFrame) -> DataFrame:
    """(cls, digest, n, rep, copies, low) of each class in `rows` with an id and words, written: number, digest and size of the set, smallest id, rows, sketch."""
    classes = rows.where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("cls").alias("digest"))
    classes = classes.agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("low").alias("low"), F.count("*").alias("copies"))
    return materialise(classes.withColumn("cls", F.monotonically_increasing_id()), "classes")


def inverted_lists(classes: DataFrame, how: NearDup) -> DataFrame:
    """(value, cls, n, size, pivot, pivot_n): the members of each list of two or more, its size, and the member whose values are the commonest."""
    each = classes.select("cls", "n", F.explode("low").alias("value"))
    many = each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    own = each.join(many, "value").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("seen"))
    held = F.least(F.col("n"), F.lit(how.k))
    need = F.when(F.col("n") <= how.k, F.least(F.floor((F.col("n") * how.percent + 99) / 100), F.lit(how.shared))).otherwise(how.shared)
    # The values that no other class holds are the rarest; what they leave of the prefix goes to the rarest others.
    rest = (held - need + 1 - (held - F.size("seen"))).cast("int")
    weight = (F.aggregate("seen", F.lit(0).cast("long"), lambda a, x: a + x["df"]) / held).alias("weight")
    kept = own.where(rest > 0).select("cls", "n", weight, F.explode(F.slice("seen", F.lit(1), rest)).alias("s")).select(F.col("s.value").alias("value"), "cls", "n", "weight")
    sizes = kept.groupBy("value").agg(F.count("*").alias("size"), F.max(F.struct("weight", "cls", "n")).alias("top")).where("size > 1")
    return kept.drop("weight").join(sizes.select("value", "size", F.col("top.cls").alias("pivot"), F.col("top.n").alias("pivot_n")), "value")


def _size_fits(a: Column, b: Column, how: NearDup) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * how.percent


def _room(u, n_ab, how: NearDup):
    """How far below the threshold an estimate from `u` values of the union may lie. The sketch draws them without putting back; at
    similarity t the union of sets with `n_ab` members together has n_ab / (1 + t)."""
    import numpy as np

    t = how.percent / 100
    u = np.maximum(u, 1)
    return how.deviations * np.sqrt(t * (1 - t) / u * np.maximum(1 - u * (1 + t) / n_ab, 0)) + 1e-9


def _counts(head, flat, at):
    """How many of each part's values `head` holds; parts are flat[at[i] : at[i + 1]], all sorted."""
    import numpy as np

    if not len(flat):
        return np.zeros(len(at) - 1, int)
    place = np.minimum(np.searchsorted(head, flat), len(head) - 1)
    return np.diff(np.concatenate([[0], np.cumsum(head[place] == flat)])[at])


def likely(head, n_head: int, flat, at, n, how: NearDup):
    """Which sets can reach the threshold with one of `n_head` values, and for which that is certain. `head` and the parts flat[at[i] : at[i + 1]]
    are the sets' smallest values, all of them or estimate_k; `n` are the sets' sizes. By the sketch of the union, which is the union itself where
    both are whole."""
    import numpy as np

    k, top = how.estimate_k, np.iinfo(np.int64).max
    small, large = np.minimum(n, n_head), np.maximum(n, n_head)
    cut = n > k
    edge = np.minimum(head[-1] if n_head > k else top, np.where(cut, flat[at[1:] - 1], top))
    low = flat <= np.repeat(edge, np.diff(at))
    inside = np.concatenate([[0], np.cumsum(low)])[at]
    i = _counts(head, flat[low], inside)
    union = np.diff(inside) + np.searchsorted(head, edge, side="right") - i
    whole = ~cut & (n_head <= k)
    ok = np.where(whole, i * 100 >= union * how.percent, i >= (how.percent / 100 - _room(union, small + large, how)) * union)
    return ok & (small * 100 >= large * how.percent), whole


def similar(head, flat, at, how: NearDup):
    """Which whole sets flat[at[i] : at[i + 1]] reach the threshold with the whole set `head`."""
    import numpy as np

    i = _counts(head, flat, at)
    return i * 100 >= (len(head) + np.diff(at) - i) * how.percent


def _beside(pairs: DataFrame, values: DataFrame, how: NearDup, judge, out: str) -> DataFrame:
    """What `judge` says of each pair (a, b, size): it gets the row (n, set) of `values` of a class and those of some of its partners, and returns columns
    of arrays and which partners to keep. `size` says how many partners a class may have; those of one with many go to several tasks by their hash. A
    task reads the class's row first and then lets its partners' pass by."""
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("size") / how.partners)).cast("int")
    salted = pairs.select("a", "b", "size", salt.alias("salt"))
    partners = salted.join(values.select(F.col("cls").alias("b"), "n", "set"), "b").select("a", "salt", "b", "size", "n", "set")
    heads = salted.select("a", "salt").distinct().join(values.select(F.col("cls").alias("a"), "n", "set"), "a")
    heads = heads.select("a", "salt", F.lit(None).cast("long").alias("b"), F.lit(None).cast("long").alias("size"), "n", "set")
    dealt = heads.unionByName(partners).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        key = head = n_head = None
        for batch in batches:
            found: list[tuple] = []
            for start in range(0, batch.num_rows, 256):  # sets can be long: few at once
                part = batch.slice(start, 256)
                at, flat = part.column(5).offsets.to_numpy(), part.column(5).values.to_numpy(zero_copy_only=False)
                keys = list(zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True))
                b, size, n = part.column(2).to_pylist(), part.column(3).to_pylist(), part.column(4).to_numpy(zero_copy_only=False)
                i = 0
                while i < len(b):
                    if b[i] is None:
                        key, head, n_head = keys[i], np.array(flat[at[i] : at[i + 1]]), int(n[i])
                        i += 1
                        continue
                    z = i
                    while z < len(b) and b[z] is not None and keys[z] == key:
                        z += 1
                    if z == i:
                        raise ValueError("a partner without its class's row")
                    ok, sure = judge(head, n_head, flat[at[i] : at[z]], at[i : z + 1] - at[i], n[i:z])
                    found += [(key[0], b[i + x], size[i + x], bool(sure[x])) for x in np.flatnonzero(ok)]
                    i = z
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=["a", "b", "size", "sure"])

    return materialise(dealt.mapInArrow(check, "a long, b long, size long, sure boolean"), out)


def confirm(pairs: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Pairs (a, b) of `pairs` (a, b, size) whose exact Jaccard on full sets reaches the threshold. First sketches alone travel, and settle what is clear (unless the
    pairs are estimated already and say whether they are `sure`); full sets travel for what is left."""
    import numpy as np

    k = how.estimate_k
    estimated = "sure" in pairs.columns
    once = materialise(pairs.groupBy("a", "b").agg(F.max("size").alias("size"), *[F.max(c).alias(c) for c in pairs.columns[3:]]), "pairs")
    sized = sets.select("cls", F.size("set").cast("long").alias("n"), "set")
    met = once
    if not estimated:
        low = sized.withColumn("set", F.slice("set", 1, k))
        met = _beside(once, low, how, lambda head, n_head, flat, at, n: likely(head, n_head, flat, at, n, how), "likely")
    sure, left = met.where("sure"), met.where("NOT sure")
    found = _beside(left, _some(sized, left, ["a", "b"]), how, lambda head, n_head, flat, at, n: (similar(head, flat, at, how), np.ones(len(n), bool)), "similar")
    return found.select("a", "b").unionByName(sure.select("a", "b"))


@dataclass
class Members:
    """Some members of a pivot's lists: class, component, set size, and sketches (`cut`: the set has more values)."""

    cls: list[int]
    label: list[int]
    n: object
    low: list
    cut: object

    def part(self, at) -> Members:
        return Members([self.cls[i] for i in at], [self.label[i] for i in at], self.n[at], [self.low[i] for i in at], self.cut[at])


def tile_pairs(x: Members, y: Members, how: NearDup):
    """Pairs (a, b, sure) of a member of `x` and one of `y` in different components whose union-sketch estimate can reach the threshold; sure where both
    sketches are whole sets. Memory goes with the product of the two numbers of members."""
    import numpy as np

    top = np.iinfo(np.int64).max
    values, code = np.unique(np.concatenate([*x.low, *y.low]), return_inverse=True)
    split = sum(map(len, x.low))
    rows = [np.repeat(np.arange(len(m.cls)), [len(v) for v in m.low]) for m in (x, y)]
    codes = [code[:split], code[split:]]
    inter = np.zeros((len(x.cls), len(y.cls)), np.float32)
    for a in range(0, len(values), 2048):
        hot = []
        for m, row, c in zip((x, y), rows, codes, strict=True):
            here = (c >= a) & (c < a + 2048)
            hot.append(np.zeros((len(m.cls), 2048), np.float32))
            hot[-1][row[here], c[here] - a] = 1
        inter += hot[0] @ hot[1].T
    last = [np.array([v[-1] if c else top for v, c in zip(m.low, m.cut, strict=True)]) for m in (x, y)]
    # Values of a member up to the last value of the other, whichever of the two sketches ends first.
    in_x = np.stack([np.searchsorted(v, np.minimum(last[1], e), side="right") for v, e in zip(x.low, last[0], strict=True)])
    in_y = np.stack([np.searchsorted(v, np.minimum(last[0], e), side="right") for v, e in zip(y.low, last[1], strict=True)]).T
    union = in_x + in_y - inter
    small, large = np.minimum(x.n[:, None], y.n[None, :]), np.maximum(x.n[:, None], y.n[None, :])
    whole = ~x.cut[:, None] & ~y.cut[None, :]
    exact = inter.astype(np.int64) * 100 >= union.astype(np.int64) * how.percent
    ok = np.where(whole, exact, inter >= (how.percent / 100 - _room(union, small + large, how)) * union) & (small * 100 >= large * how.percent)
    ok &= np.array(x.label)[:, None] != np.array(y.label)[None, :]
    out = set()
    for i, j in zip(*np.nonzero(ok), strict=True):
        out.add((min(x.cls[i], y.cls[j]), max(x.cls[i], y.cls[j]), bool(whole[i, j])))
    return out


def open_members(lists: DataFrame, labels: DataFrame) -> DataFrame:
    """(pivot, cls, label, n, size): the members of each pivot's lists that hold several components, once for each pivot and without it, and how many
    they are. A pivot has met all members of its lists already, so a list of two has nothing left."""
    named = lists.where("cls <> pivot").join(labels.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    mixed = named.groupBy("value").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("value")
    met = named.join(mixed, "value", "left_semi").select("pivot", "cls", "label", "n").distinct()
    return met.join(met.groupBy("pivot").agg(F.count("*").alias("size")), "pivot")


def _open_pairs(lists: DataFrame, labels: DataFrame, sets: DataFrame, how: NearDup) -> DataFrame:
    """Candidates (a, b, size of the group, sure) among members of one pivot's lists that are in different components, more than those that
    share a list; a pair may leave several groups."""
    blocks = F.ceil(F.col("size") / how.block).cast("int")
    mine = F.pmod(F.xxhash64("cls"), blocks).cast("int")
    # Each pair of blocks is a task of its own; a member goes to those its block takes part in.
    other = F.explode(F.sequence(F.lit(0), blocks - 1))
    members = materialise(open_members(lists, labels), "open")
    dealt = members.withColumn("mine", mine).withColumn("other", other)
    dealt = dealt.select("pivot", "cls", "label", "n", "size", "mine", F.least("mine", "other").alias("p"), F.greatest("mine", "other").alias("q"))
    low = _some(sets.select("cls", F.slice("set", 1, how.estimate_k).alias("low"), (F.size("set") > how.estimate_k).alias("cut")), members, ["cls"])

    def compare(t: pa.Table) -> pa.Table:
        import numpy as np

        p, q, size = (t.column(c)[0].as_py() for c in ("p", "q", "size"))
        mine = t.column("mine").to_numpy()

        def arrays(name):
            lists = t.column(name).combine_chunks()
            at, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            return [flat[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]

        whole = Members(t.column("cls").to_pylist(), t.column("label").to_pylist(), t.column("n").to_numpy(), arrays("low"), t.column("cut").to_numpy(zero_copy_only=False))
        found = set()
        left, right = np.flatnonzero(mine == p), np.flatnonzero(mine == q)
        for i in range(0, len(left), how.tile):
            for j in range(0 if p != q else i, len(right), how.tile):
                found |= tile_pairs(whole.part(left[i : i + how.tile]), whole.part(right[j : j + how.tile]), how)
        return pa.table([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([size] * len(found), pa.int64()), pa.array([x[2] for x in found], pa.bool_())], names=["a", "b", "size", "sure"])

    return dealt.join(low, "cls").groupBy("pivot", "p", "q").applyInArrow(compare, "a long, b long, size long, sure boolean")


def near_duplicates(df: DataFrame, how: NearDup = NearDup(), *, id_col: str = "doc_id", text_col: str = "text", extra: dict[str, Column] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of `df`, and what `extra` names.

    Null texts and texts without words have no shingles and are linked with nothing; a text with fewer words than a
    shingle is one shingle. component_id is the smallest id that links lead to, kept whether that is the row's own;
    a null id is linked with nothing: its component is null and it is kept. Repeated rows give a row each. Other columns
    are not read. An empty table gives an empty one. A very long text is one row with a long set.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = materialise(sketches(df, how, id_col=id_col, text_col=text_col, extra=extra), "sketches")
    classes = numbered(rows)
    lists = materialise(inverted_lists(classes, how), "lists")
    members = materialise(classes.select("rep", F.col("digest").alias("cls"), F.col("cls").alias("number")).join(lists.select(F.col("cls").alias("number")), "number", "left_semi"), "members")
    sets = materialise(full_sets(df, how, members, id_col=id_col, text_col=text_col, named="number"), "sets")

    star = lists.where((F.col("cls") != F.col("pivot")) & _size_fits(F.col("n"), F.col("pivot_n"), how))
    # A pivot is the greatest of its list in one order of all classes, so a pair never turns round.
    star = star.select(F.col("pivot").alias("a"), F.col("cls").alias("b"), "size")
    links = materialise(confirm(star, sets, how), "links")
    labels = components(links)
    more = confirm(_open_pairs(lists, labels, sets, how), sets, how)
    labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))

    least = labels.join(members, labels.node == members.number).groupBy("label").agg(F.min("rep").alias("component_id"))
    found = labels.join(least, "label").select(F.col("node").alias("cls"), "component_id")
    reps = materialise(classes.join(found, "cls", "left").select(F.col("digest").alias("cls"), "copies", F.coalesce("component_id", "rep").cast(kind).alias("component_id")), "components")
    more = list(extra or {})
    out = rows.select("doc_id", "n_shingles", "cls", *more)
    grouped = join_hot(out.where("cls IS NOT NULL AND doc_id IS NOT NULL"), reps, "cls", "copies")
    alone = out.where("cls IS NULL OR doc_id IS NULL").withColumn("component_id", F.col("doc_id"))
    both = grouped.select("doc_id", "n_shingles", *more, "component_id").unionByName(alone.drop("cls"))
    return both.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(df: DataFrame, how: NearDup = NearDup(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with its columns, of each group of near copies: one of those with the smallest id. Rows without words or with a null id stay.

    Rows are judged by id and text, so a row that shares its id with a near copy but not its text stays. Where several rows of a group have the
    smallest id (repeated ids), that with the smallest digest stays, and of rows equal in id and text any one.
    """
    row = F.xxhash64(text_col)
    judged = materialise(near_duplicates(df, how, id_col=id_col, text_col=text_col, extra={"row": row}), "judged")
    kept = judged.where("kept AND doc_id IS NOT NULL AND n_shingles > 0").groupBy("component_id").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.count("*").alias("rows")).where("rows > 1")
    other = judged.where("kept").join(kept.select("component_id", "first"), "component_id").where("row <> first")
    gone = judged.where("NOT kept").select("doc_id", "row").unionByName(other.select("doc_id", "row")).distinct().select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    gone = materialise(gone, "near-duplicates")
    # Equal rows meet only where a group has several rows of the smallest id.
    again = materialise(kept.select(F.col("component_id").alias("_id"), F.col("first").alias("_row")), "repeated")
    apart, perhaps = parted(df, gone.unionByName(again), id_col, text_col)
    named = is_named(id_col, text_col)
    left = perhaps.join(gone, named, "left_anti")
    once = left.join(again, named, "left_semi").withColumn("_row", row).dropDuplicates([id_col, "_row"]).drop("_row")
    return apart.unionByName(left.join(again, named, "left_anti")).unionByName(once)
