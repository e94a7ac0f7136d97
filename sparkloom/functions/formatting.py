"""Numbers and durations as text, and arithmetic of models and schedules, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _scaled(n: Column, by: float, digits: int, unit: str) -> Column:
    # bround rounds ties to even, as Python's format does for numbers that are exact in binary.
    return F.concat(F.format_string(f"%.{digits}f", F.bround(n / by, digits)), F.lit(unit))


def format_tokens(n: Column | str) -> Column:
    """1.23T, 1.23B, 1.2M, 1.2K or the whole number."""
    n = _col(n).cast("double")
    return F.when(n >= 1e12, _scaled(n, 1e12, 2, "T")).when(n >= 1e9, _scaled(n, 1e9, 2, "B")).when(n >= 1e6, _scaled(n, 1e6, 1, "M")).when(n >= 1e3, _scaled(n, 1e3, 1, "K")).otherwise(n.cast("long").cast("string"))


def format_tokens_short(n: Column | str) -> Column:
    """The status report's form: one digit, up to B."""
    n = _col(n).cast("double")
    return F.when(n >= 1e9, _scaled(n, 1e9, 1, "B")).when(n >= 1e6, _scaled(n, 1e6, 1, "M")).when(n >= 1e3, _scaled(n, 1e3, 1, "K")).otherwise(n.cast("long").cast("string"))


def format_bytes(n: Column | str) -> Column:
    n = _col(n).cast("double")
    out = None
    for power, unit in ((4, " TiB"), (3, " GiB"), (2, " MiB"), (1, " KiB")):
        out = (F if out is None else out).when(n >= 1024.0**power, _scaled(n, 1024.0**power, 1, unit))
    return out.otherwise(F.concat(n.cast("long").cast("string"), F.lit(" B")))


def _whole(c: Column) -> Column:
    return F.floor(c).cast("long").cast("string")


def human_age(seconds: Column | str) -> Column:
    s = _col(seconds).cast("double")
    hours = F.concat(_whole(s / 3600), F.lit("h "), _whole((s % 3600) / 60), F.lit("m ago"))
    days = F.concat(_whole(s / 86400), F.lit("d "), _whole((s % 86400) / 3600), F.lit("h ago"))
    return F.when(s < 60, F.concat(s.cast("long").cast("string"), F.lit("s ago"))).when(s < 3600, F.concat(_whole(s / 60), F.lit("m ago"))).when(s < 86400, hours).otherwise(days)


def human_duration(seconds: Column | str) -> Column:
    s = _col(seconds).cast("double")
    m = s / 60
    hours = F.concat(_whole(m / 60), F.lit("h "), (F.floor(m) % 60).cast("string"), F.lit("m"))
    days = F.concat(F.floor(F.floor(m / 60) / 24).cast("long").cast("string"), F.lit("d "), (F.floor(m / 60) % 24).cast("string"), F.lit("h"))
    plain = lambda x: F.bround(x, 0).cast("long").cast("string")
    return F.when(s < 60, F.concat(plain(s), F.lit("s"))).when(m < 60, F.concat(plain(m), F.lit("m"))).when(m / 60 < 24, hours).otherwise(days)


def ffn_width(width: Column | str, gated: Column | str) -> Column:
    """Gated: 8/3 of the width, up to a multiple of 256; plain: 4 times."""
    n = _col(width)
    return F.when(_col(gated), F.ceil(F.floor(8 * n / 3) / 256) * 256).otherwise(4 * n).cast("long")


def param_count(*, width: str = "width", layers: str = "layers", heads: str = "heads", kv_heads: str = "kv_heads", vocab: str = "vocab", gated: str = "gated", rms: str = "rms", tied: str = "tied", qkv_bias: str = "qkv_bias", out_bias: str = "out_bias", mlp_bias: str = "mlp_bias") -> Column:
    """Parameters of a decoder: embedding, blocks (attention with grouped keys, MLP, two norms), last norm, head unless tied."""
    n, kv = F.col(width).cast("long"), F.col(kv_heads).cast("long") * F.floor(F.col(width) / F.col(heads)).cast("long")
    ff, one = ffn_width(width, gated), lambda c: F.col(c).cast("long")
    norm = F.when(F.col(rms), n).otherwise(2 * n)
    attention = 2 * n * n + 2 * n * kv + one(qkv_bias) * (n + 2 * kv) + one(out_bias) * n
    mlp = F.when(F.col(gated), 3 * n * ff + one(mlp_bias) * (2 * ff + n)).otherwise(2 * n * ff + one(mlp_bias) * (ff + n))
    embedding = F.col(vocab).cast("long") * n
    return embedding + F.col(layers) * (attention + mlp + 2 * norm) + norm + (1 - one(tied)) * embedding


def bytes_per_param(precision: Column | str) -> Column:
    """Weights and master copy."""
    half = F.lower(F.coalesce(_col(precision), F.lit(""))).isin("bf16", "fp16")
    return F.struct(F.when(half, 2).otherwise(4).alias("param"), F.lit(4).alias("master"))


def learning_rate(step: Column | str, peak: float, warmup: int, decay: int, least_ratio: float) -> Column:
    """Linear warm-up, then cosine to a share of the peak, which then stays."""
    s = _col(step).cast("double")
    part = F.least((s - warmup) / max(1, decay), F.lit(1.0))
    cosine = least_ratio + (1 - least_ratio) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * part))
    return F.when(s < warmup, peak * s / max(1, warmup)).otherwise(peak * cosine)


def param_memory(params: Column, precision: Column | str) -> Column:
    """Bytes of all weights as computed with (param_bytes) and as kept (master_bytes)."""
    each = bytes_per_param(precision)
    return F.struct((params * each["param"]).cast("long").alias("param_bytes"), (params * each["master"]).cast("long").alias("master_bytes"))


def attention_flops(layers: Column, length: Column, width: Column) -> Column:
    """Operations a token that attention scores add, which no parameter stands for."""
    return 6 * layers.cast("double") * length * width


def mfu(params: Column, tokens_per_second: Column, devices: Column, peak_flops: Column, per_param: int = 6, attention: Column | float = 0.0) -> Column:
    """Share of peak: 6 operations a parameter and token, or 8 with recomputation, and those of attention if given."""
    return (per_param * params + attention) * tokens_per_second / (devices * peak_flops)
