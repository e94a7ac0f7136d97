"""Documents to overlapping token windows, as array expressions.

A document shorter than a window is one window with the end mark. A longer one is cut every `stride` tokens; from
the second window on, the first tokens repeat the previous window. Each window that reaches the document's end gets the
end mark, so there can be several.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowSpec:
    """length and overlap in tokens; cap: a document keeps one window more than this; keep_share: share of documents that
    keep their overlap, by a draw from their name (None: all)."""

    length: int = 128
    overlap: int = 32
    cap: int = 10_000
    keep_share: float | None = None

    @classmethod
    def streaming(cls, length: int, overlap: int) -> WindowSpec:
        """The streaming path: overlap at most half a window, and a lower cap."""
        return cls(length, min(overlap, length // 2), 1_000)


def stable_draw(*key: Column) -> Column:
    """A number in [0, 1) from the md5 of a name: equal in every process and on every engine."""
    digest = F.md5(F.concat_ws(":", *[k.cast("string") for k in key]).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def explode_windows(df: DataFrame, spec: WindowSpec, *, tokens: str = "tokens", eod: Column, key: list[str] | None = None) -> DataFrame:
    """Replaces `tokens` by (window_idx, overlap_len, ends, tokens) rows; documents without tokens give none.

    `key` names the columns that draw whether a document keeps its overlap.
    """
    n = F.size(tokens)
    overlap = F.lit(spec.overlap) if spec.keep_share is None else F.when(stable_draw(*[F.col(k) for k in key]) > spec.keep_share, 0).otherwise(spec.overlap)
    df = df.where(n > 0).withColumn("_o", overlap.cast("int")).withColumn("_n", n).withColumn("_s", F.greatest(F.lit(spec.length) - F.col("_o"), F.lit(spec.length // 2)))
    last = F.when(F.col("_n") < spec.length, 0).otherwise(F.least(F.floor((F.col("_n") - 1) / F.col("_s")), F.lit(spec.cap))).cast("int")
    rest = [c for c in df.columns if c not in (tokens, "_o", "_n", "_s")]
    out = df.withColumn("window_idx", F.explode(F.sequence(F.lit(0), last)))
    short = F.col("_n") < spec.length
    at = F.col("window_idx") * F.col("_s")
    body = F.when(short, F.col(tokens)).otherwise(F.slice(tokens, (at + 1).cast("int"), F.lit(spec.length)))
    ends = short | (at + spec.length >= F.col("_n"))
    out = out.withColumn("_b", body).withColumn("ends", ends)
    head = F.when(F.col("window_idx") > 0, F.least(F.col("_o"), F.size("_b"))).otherwise(0).cast("int")
    return out.select(*rest, "window_idx", head.alias("overlap_len"), "ends", F.when(F.col("ends"), F.concat("_b", F.array(eod))).otherwise(F.col("_b")).alias(tokens))


def window_counts(df: DataFrame, spec: WindowSpec, n: str = "n_tokens") -> DataFrame:
    """`df` with n_windows, from token counts alone: no text or array is read."""
    stride = max(spec.length - spec.overlap, spec.length // 2)
    long = F.least(F.ceil(F.col(n) / stride), F.lit(spec.cap + 1))
    return df.withColumn("n_windows", F.when(F.col(n) <= 0, 0).when(F.col(n) < spec.length, 1).otherwise(long).cast("long"))


def window_lengths(df: DataFrame, spec: WindowSpec, n: str = "n_tokens") -> DataFrame:
    """The windows of each document by their lengths alone: `df` without `n` and with (window_idx, overlap_len, n_tokens), end marks included. Equal to
    counting the tokens of `explode_windows`, but no array is made."""
    stride = max(spec.length - spec.overlap, spec.length // 2)
    rest = [c for c in df.columns if c != n]
    d = df.where(F.col(n) > 0).withColumn("_n", F.col(n))
    last = F.when(F.col("_n") < spec.length, 0).otherwise(F.least(F.floor((F.col("_n") - 1) / stride), F.lit(spec.cap))).cast("int")
    d = d.withColumn("window_idx", F.explode(F.sequence(F.lit(0), last)))
    left = F.col("_n") - F.col("window_idx") * stride
    body = F.when(F.col("_n") < spec.length, F.col("_n")).otherwise(F.least(left, F.lit(spec.length)))
    ends = (F.col("_n") < spec.length) | (left <= spec.length)
    head = F.when(F.col("window_idx") > 0, F.least(F.lit(spec.overlap), body)).otherwise(0).cast("int")
    return d.select(*rest, "window_idx", head.alias("overlap_len"), (body + ends.cast("int")).cast("long").alias("n_tokens"))


def overlap_mask(tokens: str = "tokens", overlap: str = "overlap_len") -> Column:
    """1 for each repeated token, 0 for the others."""
    return F.concat(F.array_repeat(F.lit(1), F.col(overlap)), F.array_repeat(F.lit(0), F.size(tokens) - F.col(overlap)))
