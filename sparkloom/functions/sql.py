"""The engine's functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from sparkloom.functions.tokens import TokenizerSpec, encode
from sparkloom.operators.packing import first_fit


@udtf(returnType="window_idx int, overlap_len int, tokens array<int>")
class CreateWindows:
    """create_windows(tokens, eod, length, overlap): the windows of one document."""

    def eval(self, tokens: list, eod: int, length: int, overlap: int):
        if not tokens:
            return
        n = len(tokens)
        if n < length:
            yield 0, 0, [*tokens, eod]
            return
        stride = max(length - overlap, length // 2)
        for k, at in enumerate(range(0, n, stride)):
            body = list(tokens[at : at + length])
            yield k, min(overlap, len(body)) if k else 0, [*body, eod] if at + length >= n else body


@udtf(returnType="item int, seq_idx int, place int")
class PackWindows:
    """pack_windows(lengths, length): where first fit decreasing puts each window of one buffer; items count from 0, ties go by item."""

    def eval(self, lengths: list, length: int):
        order = sorted(range(len(lengths or [])), key=lambda i: (-lengths[i], i))
        filled: dict[int, int] = {}
        for item, seq in zip(order, first_fit([min(lengths[i], length) for i in order], length), strict=True):
            yield item, seq, filled.get(seq, 0)
            filled[seq] = filled.get(seq, 0) + 1


def register(spark: SparkSession, tokenizer: TokenizerSpec | None = None) -> None:
    """tokenize(text), if a tokenizer of ids is given, create_windows(...) and pack_windows(...) as table functions, and the data source of token shards."""
    from sparkloom.sources import shards

    spark.udtf.register("create_windows", CreateWindows)
    spark.udtf.register("pack_windows", PackWindows)
    if tokenizer is not None:
        if tokenizer.kind in ("word", "codepoint"):
            raise ValueError("these tokenizers are SQL expressions already")
        spark.udf.register("tokenize", encode(tokenizer))
    shards.register(spark)
