"""Queries over logits, checkpoints, run states and formatted numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.config import PRESETS
from sparkloom.functions import formatting as Fmt
from sparkloom.operators import runs
from sparkloom.operators import sampling as S
from sparkloom.plans.registry import Registry, literal, table, values

R = Registry()

# --- logits: a vector's components, eight times as steep


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("prompt_id"), F.posexplode("embedding").alias("token_id", "logit"))
    return e.withColumn("logit", F.col("logit").cast("double") * 8)


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logits(spark, sf_dir).where(F.col("token_id") % 7 == F.col("prompt_id") % 7).select("prompt_id", "token_id")


_LOGITS = "lg AS (SELECT vec_id AS prompt_id, (i - 1)::INT AS token_id, embedding[i]::DOUBLE * 8 AS logit FROM (SELECT vec_id, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"
_PEN = f"{_LOGITS}, pn AS (SELECT prompt_id, token_id, CASE WHEN token_id % 7 <> prompt_id % 7 THEN logit WHEN logit < 0 THEN logit * 1.3::DOUBLE ELSE logit / 1.3::DOUBLE END AS logit FROM lg)"
_SOFT = "sm AS (SELECT *, e / sum(e) OVER (PARTITION BY prompt_id) AS prob FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY prompt_id)) AS e FROM {}))"


@R.add(f"WITH {_PEN} SELECT prompt_id, token_id, round(logit, 6) AS logit FROM pn")
def rep_penalty(spark, sf_dir):
    p = S.repetition_penalty(logits(spark, sf_dir), generated(spark, sf_dir), 1.3)
    return p.select("prompt_id", "token_id", F.round("logit", 6).alias("logit"))


@R.add(f"WITH {_LOGITS}, tt AS (SELECT prompt_id, token_id, logit / 0.7::DOUBLE AS logit FROM lg), {_SOFT.format('tt')} SELECT prompt_id, token_id, round(prob, 7) AS prob FROM sm")
def temperature_softmax(spark, sf_dir):
    p = S.softmax(S.temperature(logits(spark, sf_dir), 0.7))
    return p.select("prompt_id", "token_id", F.round("prob", 7).alias("prob"))


@R.add(f"WITH {_LOGITS} SELECT prompt_id, token_id FROM (SELECT *, rank() OVER (PARTITION BY prompt_id ORDER BY logit DESC) AS r FROM lg) WHERE r <= 10")
def topk_filter(spark, sf_dir):
    return S.top_k(logits(spark, sf_dir), 10).select("prompt_id", "token_id")


_TOPP = f"""{_LOGITS}, kk AS (SELECT prompt_id, token_id, logit FROM (SELECT *, rank() OVER (PARTITION BY prompt_id ORDER BY logit DESC) AS r FROM lg) WHERE r <= 50), {_SOFT.format('kk')},
pp AS (SELECT prompt_id, token_id, logit, row_number() OVER w AS r, sum(prob) OVER (PARTITION BY prompt_id ORDER BY logit DESC, token_id ROWS UNBOUNDED PRECEDING) - prob AS before FROM sm WINDOW w AS (PARTITION BY prompt_id ORDER BY logit DESC, token_id))"""


@R.add(f"WITH {_TOPP} SELECT prompt_id, token_id FROM pp WHERE r = 1 OR before <= 0.9")
def topp_filter(spark, sf_dir):
    return S.top_p(S.top_k(logits(spark, sf_dir), 50), 0.9).select("prompt_id", "token_id")


@R.add(f"WITH {_LOGITS} SELECT prompt_id, token_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY logit DESC, token_id) AS r FROM lg) WHERE r = 1")
def argmax_token(spark, sf_dir):
    return S.argmax(logits(spark, sf_dir))


@R.add(f"""WITH {_LOGITS}, {_SOFT.format('lg')}, cc AS (SELECT *, sum(prob) OVER (PARTITION BY prompt_id ORDER BY token_id ROWS UNBOUNDED PRECEDING) AS c, ('0x' || substr(md5('5:' || prompt_id), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM sm)
SELECT prompt_id, coalesce(min(token_id) FILTER (c > u), max(token_id))::INT AS token_id FROM cc GROUP BY prompt_id""")
def draw_token(spark, sf_dir):
    return S.draw(logits(spark, sf_dir), 5)


@R.add(f"""WITH {_LOGITS}, l AS (SELECT prompt_id, max(logit) AS m FROM lg GROUP BY 1), s AS (SELECT prompt_id, m + ln(sum(exp(logit - m))) AS lse FROM lg JOIN l USING (prompt_id) GROUP BY prompt_id, m),
t AS (SELECT vec_id AS prompt_id, label AS target FROM embeddings WHERE label IS NOT NULL)
SELECT count(*)::BIGINT AS targets, round(avg(lse - logit), 6) AS loss FROM s JOIN t USING (prompt_id) JOIN lg ON lg.prompt_id = s.prompt_id AND lg.token_id = t.target""")
def masked_xent(spark, sf_dir):
    targets = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("prompt_id"), F.coalesce("label", F.lit(-100)).alias("target"))
    x = S.masked_cross_entropy(logits(spark, sf_dir), targets)
    return x.select("targets", F.round("loss", 6).alias("loss"))


@R.add(f"WITH {_LOGITS}, {_SOFT.format('lg')} SELECT prompt_id, round(prob, 7) AS prob, (SELECT count(*) FROM lg b WHERE b.prompt_id = a.prompt_id AND b.logit > a.logit)::INT AS rank FROM sm a WHERE token_id = 3")
def eos_rank(spark, sf_dir):
    r = S.token_rank(logits(spark, sf_dir), 3)
    return r.select("prompt_id", F.round("prob", 7).alias("prob"), "rank")


@R.add(f"""WITH {_LOGITS}, {_SOFT.format('lg')}, r AS (SELECT prob, rank() OVER (PARTITION BY prompt_id ORDER BY logit DESC) - 1 AS rank, token_id FROM sm), q AS (SELECT * FROM r WHERE token_id = 3)
SELECT round(avg(prob), 6) AS mean_prob, round(quantile_cont(prob, 0.5), 6) AS median_prob, round(max(prob), 6) AS max_prob, quantile_cont(rank, 0.5)::DOUBLE AS median_rank, avg((rank = 0)::INT)::DOUBLE AS top1_share FROM q""")
def eos_stats(spark, sf_dir):
    s = S.token_rank_stats(S.token_rank(logits(spark, sf_dir), 3))
    return s.select(*[F.round(c, 6).alias(c) for c in ("mean_prob", "median_prob", "max_prob")], "median_rank", "top1_share")


@R.add("""WITH o AS (SELECT conv_id, list_position(list_transform(string_split(text, ''), lambda c: unicode(c)), 46) AS p FROM conversations WHERE text <> ''), q AS (SELECT CASE WHEN p > 0 THEN p END AS p FROM o)
SELECT count(*)::BIGINT AS outputs, count(p)::BIGINT AS stopped, count(p)::DOUBLE / count(*)::DOUBLE AS share, quantile_cont(p, 0.5)::DOUBLE AS median_tokens FROM q""")
def stop_reasons(spark, sf_dir):
    """Outputs are messages as code points, the end mark a full stop."""
    from sparkloom.functions.tokens import codepoint_tokens

    o = table(spark, sf_dir, "conversations").where("text <> ''").select(F.col("conv_id").alias("prompt_id"), codepoint_tokens("text").alias("tokens"))
    return S.stop_stats(o, 46)


_STEPS = [(0, 0, 5), (0, 1, 9), (1, 0, 9), (1, 1, 9), (2, 0, 9), (2, 1, 4)]


@R.add(f"SELECT step, bool_and(token_id = 9) AS stop FROM {values(_STEPS, 'step, prompt_id, token_id')} GROUP BY step")
def all_stopped(spark, sf_dir):
    return S.all_stopped(literal(spark, _STEPS, "step int, prompt_id int, token_id int"), 9)


# --- checkpoints and runs

_CKPTS = [("checkpoint-100", 100, True), ("checkpoint-200", 200, True), ("checkpoint-250-shutdown", 250, True), ("checkpoint-300", 300, True), ("checkpoint-400", 400, False), ("checkpoint-500", 500, True), ("checkpoint-600", 600, True), ("checkpoint-610-shutdown", 610, True), ("checkpoint-700.partial", 700, True), ("final", 650, True), ("notes", None, False)]
_CK = f"ck AS {values(_CKPTS, 'name, step, has_state')}, li AS (SELECT name, step, (row_number() OVER (ORDER BY name = 'final', step, name) - 1)::INT AS place FROM ck WHERE has_state AND name NOT LIKE '%.partial' AND step IS NOT NULL)"


def checkpoints(spark: SparkSession) -> DataFrame:
    return literal(spark, _CKPTS, "name string, step int, has_state boolean")


@R.add(f"WITH {_CK} SELECT name, step, place FROM li")
def ckpt_list(spark, sf_dir):
    return runs.list_checkpoints(checkpoints(spark))


@R.add(f"WITH {_CK} SELECT name, nullif(regexp_extract(name, '^checkpoint-([0-9]+)(-.*)?$', 1), '')::BIGINT AS parsed FROM ck")
def ckpt_parse(spark, sf_dir):
    return runs.parsed_steps(checkpoints(spark).select("name"))


@R.add(f"""WITH {_CK}, k AS (SELECT *, CASE WHEN name = 'final' THEN 'final' WHEN name LIKE '%-shutdown' THEN 'shutdown' ELSE 'regular' END AS kind FROM li), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY place DESC) AS n FROM k)
SELECT name, step, place, kind = 'final' OR (kind = 'regular' AND n <= 2) OR (kind <> 'regular' AND n = 1) OR (kind = 'regular' AND step > 0 AND step % 200 = 0) AS keep FROM n""")
def ckpt_retention(spark, sf_dir):
    return runs.retention(runs.list_checkpoints(checkpoints(spark)), 2, 200)


@R.add(f"WITH {_CK} SELECT arg_max(name, place) AS name FROM li")
def ckpt_resume(spark, sf_dir):
    return runs.resume_from(runs.list_checkpoints(checkpoints(spark)), "auto")


@R.add(f"WITH {_CK} SELECT name, step FROM li ORDER BY place DESC LIMIT 5")
def ckpt_recent(spark, sf_dir):
    """The five newest: a top-k report."""
    return runs.list_checkpoints(checkpoints(spark)).orderBy(F.desc("place")).limit(5).select("name", "step")


_RUNS = [("a", "running", True, 11, True), ("b", "running", False, 12, True), ("c", "error", False, 13, True), ("d", "error", True, 14, False), ("e", "completed", False, 15, True), ("f", "stopped", False, 16, True), ("g", "halted", False, 17, True), ("h", "paused", False, 18, True), ("i", None, False, None, True), ("j", None, False, None, False)]
_RUN_COLS = "run, status, alive, pid, has_checkpoint"


@R.add(f"""SELECT run, CASE WHEN status IS NULL AND has_checkpoint THEN 'NO RUN STATE (checkpoint only)' WHEN status IS NULL THEN 'EMPTY' WHEN status = 'running' AND NOT alive THEN 'CRASHED (PID ' || pid || ', exited)'
  WHEN status = 'running' THEN 'RUNNING (PID ' || pid || ')' WHEN status = 'error' THEN 'ERROR (PID ' || pid || CASE WHEN alive THEN ', still alive)' ELSE ', exited)' END WHEN status = 'completed' THEN 'COMPLETED' WHEN status = 'stopped' THEN 'STOPPED'
  WHEN status = 'halted' THEN 'HALTED (bucket exhausted; needs attention)' ELSE upper(status) END AS status_line FROM {values(_RUNS, _RUN_COLS)}""")
def run_status(spark, sf_dir):
    r = literal(spark, _RUNS, "run string, status string, alive boolean, pid int, has_checkpoint boolean")
    return r.select("run", runs.status_line(*[F.col(c) for c in ("status", "alive", "pid", "has_checkpoint")]).alias("status_line"))


@R.add(f"SELECT run, CASE WHEN status = 'completed' THEN 'done' WHEN status IN ('halted', 'error') THEN 'manual' WHEN status IN ('stopped', 'running') THEN 'resubmit' ELSE 'start' END AS decision FROM {values(_RUNS, _RUN_COLS)}")
def orchestrator_decision(spark, sf_dir):
    r = literal(spark, _RUNS, "run string, status string, alive boolean, pid int, has_checkpoint boolean")
    return r.select("run", runs.orchestrator_decision(F.col("status")).alias("decision"))


_REASONS = [("bucket_exhausted:web",), ("bucket_exhausted",), ("completed",), ("error",), ("signal",), ("walltime",)]


@R.add(f"SELECT reason, CASE WHEN reason LIKE 'bucket_exhausted%' THEN 'halted' WHEN reason IN ('completed', 'error') THEN reason ELSE 'stopped' END AS status FROM {values(_REASONS, 'reason')}")
def shutdown_status(spark, sf_dir):
    return literal(spark, _REASONS, "reason string").withColumn("status", runs.shutdown_status(F.col("reason")))


_STATE = [("a", 50, 200, 2.5, 1000), ("b", 7, 0, 3.25, 500)]
_TRAINER = [("a", 40, 2.75, 900), ("c", 30, 1.5, 700)]


@R.add(f"""WITH s AS {values(_STATE, 'run, step, max_steps, loss, tokens')}, t AS {values(_TRAINER, 'run, step, loss, tokens')}
SELECT coalesce(s.run, t.run) AS run, coalesce(s.step, t.step, 0) AS step, coalesce(s.max_steps, 0) AS max_steps, CASE WHEN s.max_steps > 0 THEN round(s.step / s.max_steps * 100, 1) END AS pct, coalesce(s.loss, t.loss) AS loss, coalesce(s.tokens, t.tokens) AS tokens
FROM s FULL JOIN t ON s.run = t.run""")
def progress_rows(spark, sf_dir):
    return runs.progress_rows(literal(spark, _STATE, "run string, step int, max_steps int, loss double, tokens int"), literal(spark, _TRAINER, "run string, step int, loss double, tokens int"))


#: A configuration's text, and the same with sorted keys and single spaces.
_JSON = [('{"a":1,"b":[2,3]}', '{"a": 1, "b": [2, 3]}'), ('{"n_layer":2, "n_embd":64}', '{"n_embd": 64, "n_layer": 2}'), ('{"b":{"z":null,"a":true},"a":"x"}', '{"a": "x", "b": {"a": true, "z": null}}'), ("{broken", None)]


@R.add(f"SELECT json, 'sha256:' || substr(sha256(sorted), 1, 16) AS hash FROM {values(_JSON, 'json, sorted')}")
def config_hash(spark, sf_dir):
    return literal(spark, [r[:1] for r in _JSON], "json string").withColumn("hash", runs.canonical_hash(F.col("json")))


_HINTS = [("scratch", False, False, "checkpoint-100, checkpoint-200, checkpoint-250-shutdown, checkpoint-300, checkpoint-500"), ("scratch", True, True, None), ("auto", False, True, None)]


@R.add(f"SELECT * FROM {values(_HINTS, 'hint, force, allowed, clobbered')}")
def scratch_guard(spark, sf_dir):
    """Whether a run may begin anew over the listed checkpoints, by hint and force."""
    listed = runs.list_checkpoints(checkpoints(spark))
    parts = [runs.scratch_guard(listed, hint, force).select(F.lit(hint).alias("hint"), F.lit(force).alias("force"), "allowed", "clobbered") for hint, force, _, _ in _HINTS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- formats and arithmetic

_NUMBERS = [(0,), (7,), (999,), (1000,), (1049,), (12345,), (999949,), (1000000,), (25400000,), (999960000,), (1234567890,), (15000000000,), (28800 * 524288,), (3 * 10**12,)]


def _fmt(n: str, top: list[tuple[str, int]], digits: dict[str, int]) -> str:
    parts = " ".join(f"WHEN {n} >= {v} THEN printf('%.{digits[u]}f{u}', {n}::DOUBLE / {v})" for u, v in top)
    return f"CASE {parts} ELSE {n}::BIGINT::VARCHAR END"


_UNITS = [("T", 10**12), ("B", 10**9), ("M", 10**6), ("K", 10**3)]


@R.add(f"SELECT n::BIGINT AS n, {_fmt('n', _UNITS, {'T': 2, 'B': 2, 'M': 1, 'K': 1})} AS tokens, {_fmt('n', _UNITS[1:], {'B': 1, 'M': 1, 'K': 1})} AS short FROM {values(_NUMBERS, 'n')}")
def fmt_tokens(spark, sf_dir):
    return literal(spark, _NUMBERS, "n long").select("n", Fmt.format_tokens("n").alias("tokens"), Fmt.format_tokens_short("n").alias("short"))


@R.add("SELECT n::BIGINT AS n, CASE " + " ".join(f"WHEN n >= {1024**p} THEN printf('%.1f {u}', n::DOUBLE / {1024**p})" for p, u in ((4, "TiB"), (3, "GiB"), (2, "MiB"), (1, "KiB"))) + f" ELSE n::BIGINT || ' B' END AS bytes FROM {values(_NUMBERS, 'n')}")
def fmt_bytes(spark, sf_dir):
    return literal(spark, _NUMBERS, "n long").select("n", Fmt.format_bytes("n").alias("bytes"))


_AGES = [(0,), (59,), (60,), (3599,), (3600,), (5400,), (86399,), (86400,), (200000,), (1000000,)]


@R.add(f"""SELECT s, CASE WHEN s < 60 THEN s || 's ago' WHEN s < 3600 THEN (s // 60) || 'm ago' WHEN s < 86400 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm ago' ELSE (s // 86400) || 'd ' || (s % 86400 // 3600) || 'h ago' END AS age,
  CASE WHEN s < 60 THEN s || 's' WHEN s < 3600 THEN printf('%.0fm', s / 60) WHEN s < 86400 THEN (s // 3600) || 'h ' || (s // 60 % 60) || 'm' ELSE (s // 86400) || 'd ' || (s // 3600 % 24) || 'h' END AS duration FROM {values(_AGES, 's')}""")
def human_age(spark, sf_dir):
    return literal(spark, _AGES, "s int").select("s", Fmt.human_age("s").alias("age"), Fmt.human_duration("s").alias("duration"))


_MODELS = [("small", 768, 12, 12, 4, 50304, True, True, False, False, False, False), ("vanilla", 1024, 24, 16, 16, 50304, False, False, True, True, True, True), ("large", 2560, 32, 32, 8, 50304, True, True, True, True, False, False)]
_MODEL_COLS = "model, width, layers, heads, kv_heads, vocab, gated, rms, tied, qkv_bias, out_bias, mlp_bias"


@R.add(f"""WITH m AS {values(_MODELS, _MODEL_COLS)}, f AS (SELECT *, (CASE WHEN gated THEN ceil((8 * width // 3) / 256) * 256 ELSE 4 * width END)::BIGINT AS ff, (kv_heads * (width // heads))::BIGINT AS kv, width::BIGINT AS n, CASE WHEN rms THEN width ELSE 2 * width END AS nm FROM m)
SELECT model, ff AS ffn, (vocab * n + layers * (2 * n * n + 2 * n * kv + qkv_bias::INT * (n + 2 * kv) + out_bias::INT * n + CASE WHEN gated THEN 3 * n * ff + mlp_bias::INT * (2 * ff + n) ELSE 2 * n * ff + mlp_bias::INT * (ff + n) END + 2 * nm) + nm + (1 - tied::INT) * vocab * n)::BIGINT AS params FROM f""")
def param_count(spark, sf_dir):
    m = literal(spark, _MODELS, "model string, width int, layers int, heads int, kv_heads int, vocab int, gated boolean, rms boolean, tied boolean, qkv_bias boolean, out_bias boolean, mlp_bias boolean")
    return m.select("model", Fmt.ffn_width("width", "gated").alias("ffn"), Fmt.param_count().alias("params"))


_PRECISIONS = [("bf16",), ("FP16",), ("fp32",), (None,)]


@R.add(f"SELECT precision, (CASE WHEN lower(coalesce(precision, '')) IN ('bf16', 'fp16') THEN 2 ELSE 4 END)::INT AS param, 4::INT AS master FROM {values(_PRECISIONS, 'precision')}")
def bytes_per_param(spark, sf_dir):
    return literal(spark, _PRECISIONS, "precision string").select("precision", Fmt.bytes_per_param("precision").alias("b")).select("precision", "b.*")


_WEIGHTS = [("bf16", 124439808), ("fp32", 124439808), (None, 2800000000), ("FP16", 0)]


@R.add(f"SELECT precision, params::BIGINT AS params, (params * CASE WHEN lower(coalesce(precision, '')) IN ('bf16', 'fp16') THEN 2 ELSE 4 END)::BIGINT AS param_bytes, (params * 4)::BIGINT AS master_bytes FROM {values(_WEIGHTS, 'precision, params')}")
def param_memory(spark, sf_dir):
    """Bytes of the weights as computed with and as kept."""
    m = literal(spark, _WEIGHTS, "precision string, params long").withColumn("b", Fmt.param_memory(F.col("params"), F.col("precision")))
    return m.select("precision", "params", "b.param_bytes", "b.master_bytes")


@R.add(f"SELECT preset, n_embd, n_layer, n_head, n_positions FROM {values([(k, *v.values()) for k, v in PRESETS.items()], 'preset, n_embd, n_layer, n_head, n_positions')}")
def presets(spark, sf_dir):
    """Model shapes by name."""
    return literal(spark, [(k, *v.values()) for k, v in PRESETS.items()], "preset string, n_embd int, n_layer int, n_head int, n_positions int")


@R.add("SELECT i AS step, round(CASE WHEN i < 100 THEN 3e-4 * i / 100 ELSE 3e-4 * (0.1 + 0.9 * 0.5 * (1 + cos(3.141592653589793 * least((i - 100) / 900, 1.0)))) END, 12) AS lr FROM range(0, 1200, 10) AS t(i)")
def lr_schedule(spark, sf_dir):
    return spark.range(0, 1200, 10).select(F.col("id").alias("step"), F.round(Fmt.learning_rate("id", 3e-4, 100, 900, 0.1), 12).alias("lr"))


_SPEEDS = [(2.8e9, 65000.0, 8, 3.12e14), (1.25e8, 500000.0, 8, 3.12e14)]


@R.add(f"SELECT params, round((6 * params + 6 * 34 * 2048 * 2560) * speed / (devices * peak), 9) AS mfu FROM {values(_SPEEDS, 'params, speed, devices, peak')}")
def mfu_attention(spark, sf_dir):
    """Utilisation with the attention term of 34 layers, 2,048 positions and 2,560 channels."""
    c = [F.col(x) for x in ("params", "speed", "devices", "peak")]
    s = literal(spark, _SPEEDS, "params double, speed double, devices int, peak double")
    return s.select("params", F.round(Fmt.mfu(*c, attention=Fmt.attention_flops(F.lit(34), F.lit(2048), F.lit(2560))), 9).alias("mfu"))


@R.add(f"SELECT params, round(6 * params * speed / (devices * peak), 9) AS mfu, round(8 * params * speed / (devices * peak), 9) AS hfu FROM {values(_SPEEDS, 'params, speed, devices, peak')}")
def mfu(spark, sf_dir):
    c = [F.col(x) for x in ("params", "speed", "devices", "peak")]
    s = literal(spark, _SPEEDS, "params double, speed double, devices int, peak double")
    return s.select("params", F.round(Fmt.mfu(*c), 9).alias("mfu"), F.round(Fmt.mfu(*c, per_param=8), 9).alias("hfu"))
