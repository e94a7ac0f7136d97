"""Exact top-k by inner product (operator 7): columnar branch and bound.

Vectors are cut into blocks in vertical layout, a row for each dimension, those with the most mass first. For a block of queries,
partial products grow by a few dimensions at a time. What the other dimensions can still add to a score is at most the product of the
two vectors' remaining lengths (Cauchy-Schwarz). After each step a query's candidates that lead so far are scored in full: the k-th best
of these is a floor under its answer, and candidates whose partial product plus that bound is below the floor are out. Dimensions'
rows are compacted to candidates that some query still needs; once few pairs are left, to those that each query needs.
All sums are of integers: in double precision where they stay exact, else in 64-bit integers, else in integers of any size.

Each block of queries meets each block of candidates once, which is the size of the task stated; no side is broadcast.
Every block gives at most k rows for a query, and these are ranked over all blocks.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise

#: Numbers (rows x dimensions) in a block of candidates and of queries, queries scored at once, and dimensions of a step.
CANDIDATES, QUERIES, AT_ONCE, STEP = 4096 * 64, 4096 * 64, 256, 16
#: Share of live pairs below which each query goes on alone.
SPARSE = 0.35
#: Sums below these are exact in double precision, and fit 64 bits.
EXACT, LONG = 2.0**53, 2.0**63


def _best(row, ids, col, score, k: int):
    """The k best of each row: higher score, then smaller id."""
    import numpy as np

    by = np.lexsort((ids[col], -score, row))
    row, col, score = row[by], col[by], score[by]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k], score[place < k]


def _scored(q, c, own, ids, k: int, step: int, worst: float, live: list[float] | None):
    """(query, candidate, score) of the k best of each row of `q`; `c` holds a dimension in each row; `own` marks pairs that take no part."""
    import numpy as np

    n_q, dims = q.shape
    # Squares in units of the largest number, so that none overflows.
    unit = max(float(np.abs(q).max(initial=0)), 1.0), max(float(np.abs(c).max(initial=0)), 1.0)
    q_sq, c_sq = np.square(q / unit[0]), np.square(c / unit[1])
    by = np.argsort(-(q_sq.sum(0) * c_sq.sum(1)), kind="stable")
    q, c, q_sq, c_sq = q[:, by], c[by], q_sq[:, by], c_sq[by]
    slack = 1e-6 + 1e-15 * worst  # for rounding of what is compared in double precision
    q_left, c_left = q_sq.sum(1), c_sq.sum(0)
    col, alive = np.arange(c.shape[1]), ~own
    score = np.zeros((n_q, len(col)), q.dtype)
    floor = np.full(n_q, -np.inf)
    for a in range(0, dims, step):
        z = a + step
        q_left = np.maximum(q_left - q_sq[:, a:z].sum(1), 0)
        c_left = np.maximum(c_left - c_sq[a:z].sum(0), 0)
        reach_q, reach_c = np.sqrt(q_left) * unit[0] * (1 + 1e-9), np.sqrt(c_left) * unit[1]
        score += q[:, a:z] @ c[a:z]
        if z >= dims:
            break
        if len(col) > k:
            lead = np.argpartition(np.where(alive, score, -np.inf), len(col) - k, axis=1)[:, len(col) - k :]
            whole = np.take_along_axis(score, lead, 1) + np.einsum("qd,dqk->qk", q[:, z:], c[z:][:, lead])
            whole = np.where(np.take_along_axis(alive, lead, 1), whole, -np.inf)
            floor = np.maximum(floor, whole.min(1))
        bound = np.multiply.outer(reach_q, reach_c)
        bound += score
        alive &= bound >= (floor - slack)[:, None]
        share = float(alive.sum()) / own.size
        if live is not None:
            live.append(share)
        keep = alive.any(0)
        if keep.mean() < 0.9:
            col, score, alive, c, c_sq, c_left = col[keep], score[:, keep], alive[:, keep], np.ascontiguousarray(c[:, keep]), c_sq[:, keep], c_left[keep]
        if share < SPARSE:
            pairs = _alone(q, c, q_sq, c_sq, score, alive, floor - slack, unit, z, step, own.size, live)
            break
    if z >= dims:
        if len(col) > k:
            edge = np.partition(np.where(alive, score, -np.inf), len(col) - k, axis=1)[:, len(col) - k]
            alive &= score >= edge[:, None] - slack
        i, j = np.nonzero(alive)
        pairs = i, j, score[i, j]
    i, j, s = _best(pairs[0], ids[col], pairs[1], pairs[2], k)
    return i, col[j], s


def _alone(q, c, q_sq, c_sq, score, alive, floor, unit, start: int, step: int, size: int, live: list[float] | None):
    """The rest of the dimensions for each query alone, over a compacted copy of the candidates that it still needs."""
    import numpy as np

    out, left = [], np.zeros(-(-(q.shape[1] - start) // step))
    for i in range(len(q)):
        j = np.flatnonzero(alive[i])
        s = score[i, j]
        for t, a in enumerate(range(start, q.shape[1], step)):
            s = s + q[i, a : a + step] @ c[a : a + step][:, j]
            reach = np.sqrt(q_sq[i, a + step :].sum()) * unit[0] * (1 + 1e-9) * np.sqrt(c_sq[a + step :][:, j].sum(0)) * unit[1]
            keep = s + reach >= floor[i]
            j, s = j[keep], s[keep]
            left[t] += len(j)
        out.append((np.full(len(j), i), j, s))
    if live is not None:
        live.extend((left / size).tolist())
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def block_top(query_rows, queries, cand_rows, cand_ids, cands, k: int, step: int = STEP, live: list[float] | None = None):
    """(query, candidate, score) of each query's k best: higher score, then smaller id. `queries` and `cands` hold a vector of whole numbers
    in each row; rows that share a row number are the same row, which is no candidate of itself. `live` gets the share of pairs
    that are left after each step. Raises if a score that is returned doesn't fit 64 bits."""
    import numpy as np

    dims = queries.shape[1]
    worst = float(np.abs(queries).max(initial=0)) * float(np.abs(cands).max(initial=0)) * max(dims, 1)
    out = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0, "int64"))]
    if worst >= LONG:
        whole = np.vectorize(int, otypes=[object])
        q, c = whole(queries) if queries.size else queries, whole(cands.T) if cands.size else cands.T
    else:
        kind = np.float64 if worst < EXACT else np.int64
        q, c = queries.astype(kind), np.ascontiguousarray(cands.T.astype(kind))
    for a in range(0, len(q) if len(cand_rows) else 0, AT_ONCE):
        own = query_rows[a : a + AT_ONCE, None] == cand_rows[None, :]
        if worst < LONG:
            i, j, s = _scored(q[a : a + AT_ONCE], c, own, cand_ids, k, step, worst, live)
        else:
            # Sums of any size: no bounds, plain integers.
            i, j = np.nonzero(~own)
            s = (q[a : a + AT_ONCE] @ c)[i, j]
            i, j, s = _best(i, cand_ids, j, s, k)
            if any(abs(x) >= 2**63 for x in s.tolist()):
                raise ValueError("a score doesn't fit 64 bits")
        out.append((i + a, j, s.astype("int64")))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def scaled(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, row, v): scale * x of each component as a double, exact for a power of two; `row` numbers the rows. Vectors null, or with null or
    non-finite components, go, as do null ids."""
    x = F.col(vector_col)
    sound = x.isNotNull() & F.col(id_col).isNotNull() & F.coalesce(F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))), F.lit(False))
    return df.where(sound).select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), F.transform(x, lambda e: e.cast("double") * scale).alias("v"))


def top_k(df: DataFrame, k: int = 5, *, id_col: str = "vec_id", vector_col: str = "embedding", query_every: int = 50, candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's k highest integer inner products, ties to the smaller id.

    Queries are rows whose id is divisible by `query_every`; candidates are all rows but the query's own, so rows that repeat an
    id are queries and candidates of their own. Vectors of unequal length are filled up with zeros. Components of any finite size count in full;
    a score beyond 64 bits is an error. Other columns are not read; an empty table gives an empty one; with fewer than k others a query has
    fewer rows.
    """
    # Written, so that row numbers are the same for both sides whatever is computed again.
    rows = materialise(scaled(df, id_col, vector_col), "vectors")
    n, wide = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    wide = max(wide or 0, 1)
    n_cand, n_query = max(1, -(-n * wide // candidates)), max(1, -(-n * wide // (query_every * queries)))
    here = lambda of, to: F.pmod(F.xxhash64("row", F.lit(of)), F.lit(to)).cast("int")
    every = lambda to: F.explode(F.sequence(F.lit(0), F.lit(to - 1)))
    cand = rows.select("id", "row", "v", here("c", n_cand).alias("cb"), every(n_query).alias("qb"))
    query = rows.where(F.col("id") % query_every == 0).select("id", "row", "v", here("q", n_query).alias("qb"), every(n_cand).alias("cb"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        import numpy as np

        def matrix(t):
            v = t.column("v").combine_chunks()
            n = np.diff(v.offsets.to_numpy()) if len(v) else np.zeros(0, int)
            m = np.zeros((len(n), wide))
            m[np.arange(wide)[None, :] < n[:, None]] = np.floor(v.flatten().to_numpy(zero_copy_only=False))
            return t.column("id").to_numpy(), t.column("row").to_numpy(), m

        (q_ids, q_rows, q), (c_ids, c_rows, c) = matrix(right), matrix(left)
        i, j, s = block_top(q_rows, q, c_rows, c_ids, c, k)
        return pa.table([pa.array(x, pa.int64()) for x in (q_ids[i], q_rows[i], c_ids[j], s)], names=["query_id", "query_row", "vec_id", "score"])

    best = cand.groupBy("cb", "qb").cogroup(query.groupBy("cb", "qb")).applyInArrow(meet, "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
