"""A packed sequence's vectors: as array expressions over its concatenated tokens (`ids`, not yet padded), and all at once by `finalize`."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.tokens import IGNORE


def fit_length(ids: Column | str, length: int, pad: int) -> Column:
    """Truncated to `length`, or padded on the right."""
    return F.slice(F.concat(F.col(ids) if isinstance(ids, str) else ids, F.array_repeat(F.lit(pad), length)), 1, length)


def content_length(ids: Column | str, length: int) -> Column:
    return F.least(F.size(ids), F.lit(length))


def attention_mask(content: Column, length: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < content, 1).otherwise(0))


def position_ids(content: Column, length: int) -> Column:
    """0, 1, ... over the whole packed sequence; padding has 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.when(i < content, i).otherwise(0))


def labels(padded: Column, content: Column, repeated: Column, eod: int) -> Column:
    """The ids as targets, but padding, the first token after an end mark and repeated tokens are ignored. `repeated` has a 1
    for each token that is an overlap. The end mark itself stays a target."""
    before = F.concat(F.array(F.lit(IGNORE)), padded)
    flags = F.concat(repeated, F.array_repeat(F.lit(0), F.size(padded)))
    three = F.arrays_zip(F.slice(before, 1, F.size(padded)).alias("b"), padded.alias("x"), F.slice(flags, 1, F.size(padded)).alias("r"))
    return F.transform(three, lambda t, i: F.when((i >= content) | (t["b"] == eod) | (t["r"] == 1), F.lit(IGNORE)).otherwise(t["x"]))


def segments(padded: Column, content: Column, eod: int) -> Column:
    """Lengths of the documents of a sequence: up to and including each end mark, and what follows the last one."""
    body = F.slice(padded, F.lit(1), content)
    ends = F.filter(F.transform(body, lambda x, i: F.when(x == eod, i + 1).otherwise(0)), lambda p: p > 0)
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), ends).alias("a"), F.concat(ends, F.array(content)).alias("z"))
    return F.transform(bounds, lambda b: b["z"] - b["a"])


def doc_ids(padded: Column, content: Column, eod: int) -> Column:
    """How many end marks stand before each token; padding has 0."""
    body = F.flatten(F.transform(segments(padded, content, eod), lambda n, d: F.array_repeat(d, n)))
    return F.concat(body, F.array_repeat(F.lit(0), F.size(padded) - content))


#: What `finalize` can make of a sequence.
FINISHED = ("input_ids", "attention_mask", "labels", "position_ids", "doc_ids")


def finalize(df: DataFrame, length: int, *, ids: str = "ids", repeated: str | None = None, overlap: str | None = None, eod: int, pad: int, columns: tuple[str, ...] = FINISHED) -> DataFrame:
    """`df` with content_len and the vectors named in `columns`, each of `length` numbers, in place of `ids` and `repeated`.

    One pass over Arrow batches makes them as matrices. The rules are those of the expressions above: `repeated` has a 1 for each token that is an overlap, or
    `overlap` says how many of the first are. Null or missing ids make a sequence of padding. Only the named vectors are made and sent back.
    """
    if odd := sorted(set(columns) - set(FINISHED)):
        raise ValueError(f"no such vectors: {odd}")
    gone = [c for c in (ids, repeated) if c]
    kept = [c for c in df.columns if c not in gone]
    slim = df.select(*kept, F.col(ids).cast("array<int>").alias("_ids"), *([F.col(repeated).cast("array<int>").alias("_rep")] if repeated else []))
    schema = ", ".join([*[f"`{n}` {t}" for n, t in df.select(*kept).dtypes], "content_len int", *[f"{c} array<int>" for c in columns]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = np.arange(length)

        def matrix(lists: pa.Array, empty: int) -> tuple[np.ndarray, np.ndarray]:
            lists = lists.fill_null([])
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            n = np.minimum(np.diff(starts), length)
            inside = at < n[:, None]
            out = np.full((len(n), length), empty, np.int32)
            out[inside] = flat[(starts[:-1, None] + at)[inside]]
            return out, n

        for b in batches:
            x, n = matrix(b.column(len(kept)), pad)
            inside = at < n[:, None]
            made = {"input_ids": lambda x=x: x, "attention_mask": lambda m=inside: m, "position_ids": lambda m=inside: np.where(m, at, 0)}
            ends = (x == eod) & inside
            made["doc_ids"] = lambda e=ends, m=inside: np.where(m, np.cumsum(e, 1) - e, 0)

            def labels(b=b, x=x, m=inside):
                skip = ~m
                skip[:, 1:] |= x[:, :-1] == eod
                if repeated:
                    skip |= matrix(b.column(len(kept) + 1), 0)[0] == 1
                if overlap:
                    skip |= at < b.column(kept.index(overlap)).to_numpy(zero_copy_only=False)[:, None]
                return np.where(skip, IGNORE, x)

            made["labels"] = labels
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * length)
            vectors = [pa.ListArray.from_arrays(offsets, pa.array(made[c]().astype(np.int32).ravel())) for c in columns]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], pa.array(n, pa.int32()), *vectors], names=[*kept, "content_len", *columns])

    return slim.mapInArrow(run, schema)


def shifted_targets(label: Column | str = "labels") -> Column:
    """Targets of positions 0 to L-2."""
    return F.slice(label, F.lit(2), F.greatest(F.size(label) - 1, F.lit(0)))


def allowed_pairs(padded: Column, content: Column, eod: int) -> Column:
    """How many (query, key) pairs attention allows: key not after query, same document, neither padding. A document of n tokens
    in a row has n(n+1)/2, so no pair is made."""
    return F.aggregate(segments(padded, content, eod), F.lit(0).cast("long"), lambda a, n: a + F.shiftright(n.cast("long") * (n + 1), 1))
