"""Queries over inference records and validation findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.operators import records as Rec
from sparkloom.operators import validation as V
from sparkloom.operators.order import positions
from sparkloom.plans.corpus import SHARDS, WIN, shard_sizes
from sparkloom.plans.registry import Registry, literal, table, values
from sparkloom.plans.training import _MIXSQL, mix

R = Registry()

#: What a line holds beside a message of `conversations`, by the remainder of its number; {} is the message as a JSON string.
_LINES = (
    '{"prompt": {}, "id": 7}',
    " ",
    '{"prompt": {}, "model": {"checkpoint": "runs/x", "dtype": "fp16"}, "generation": {"temperature": 0.5, "top_k": null}}',
    '{"prompt": 5, "note": {}}',
    '{"model": {"checkpoint": "a", "output_dir": "b"}, "note": {}}',
    "[1, 2, {}]",
    '{"prompt": {}',
    '{"prompt": {}, "generation": {"greedy": true, "top_k": 9, "seed": 3}}',
    '{"prompt": {}, "generation": {"max_new_tokens": 0, "temperature": true, "top_p": 1.5}}',
    '{"prompt": {}, "model": {"output_dir": "runs/x", "size": 1}}',
    '{"prompt": {}, "model": {"dtype": "int8"}}',
    '{"prompt": {}, "generation": {"repetition_penalty": -1, "seed": 1.5, "beam": 2}}',
    '{"prompt": {}, "model": [], "generation": 3}',
    '{"prompt": null, "note": {}}',
    '{"prompt": {}, "model": {"checkpoint": null, "tokenizer": "t"}, "generation": {"top_k": 0, "top_p": 1}}',
    '{"prompt": {}, "model": {"output_dir": "runs/x"}, "generation": null, "extra": [1.25, {}]}',
)
_N = len(_LINES)


def record_lines(spark, sf_dir):
    """A line for each message, in the order of conversations and turns."""
    t = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", "text")
    t = positions(t, [], ["conv_id", "turn"], "line_num")
    quoted = F.to_json(F.struct("text"))
    quoted = F.substring(quoted, F.lit(9), F.length(quoted) - 9)
    line = F.lit(None).cast("string")
    for i, shape in enumerate(_LINES):
        first, *rest = [F.lit(p) for p in shape.split("{}")]
        line = F.when(F.col("line_num") % _N == i, F.concat(first, *[c for p in rest for c in (quoted, p)])).otherwise(line)
    return t.select("line_num", line.alias("value"))


def _line_sql() -> str:
    cases = " ".join(f"WHEN {i} THEN " + " || to_json(text)::VARCHAR || ".join("'" + p + "'" for p in shape.split("{}")) for i, shape in enumerate(_LINES))
    return f"raw AS (SELECT line_num, CASE line_num % {_N} {cases} END AS value FROM (SELECT text, row_number() OVER (ORDER BY conv_id, turn) - 1 AS line_num FROM conversations WHERE text IS NOT NULL))"


DEFAULTS = Rec.Defaults("runs/base", "bf16", None, {"max_new_tokens": 64, "temperature": 0.8, "top_k": 50, "top_p": 0.95, "greedy": False, "repetition_penalty": 1.0, "seed": None, "return_full_text": False})

_INT = "('BIGINT', 'UBIGINT')"
_NUM = "('BIGINT', 'UBIGINT', 'DOUBLE')"


def _has(block: str, key: str) -> str:
    return f"list_contains(json_keys(j, '$.{block}'), '{key}')"


def _type(key: str) -> str:
    return f"json_type(j, '$.generation.{key}')"


def _bad(key: str, test: str) -> str:
    return f"(g = 'OBJECT' AND coalesce({_has('generation', key)}, FALSE) AND NOT coalesce({test}, FALSE))::INT"


def _value(key: str) -> str:
    return f"(j->>'$.generation.{key}')::DOUBLE"


_CHECKS = " + ".join(
    f"coalesce({c}, 0)"
    for c in [
        "(p IS NULL OR p <> 'VARCHAR')::INT",
        "(m IS NOT NULL AND m NOT IN ('NULL', 'OBJECT'))::INT",
        "(m = 'OBJECT' AND len(list_filter(json_keys(j, '$.model'), lambda k: k NOT IN ('checkpoint', 'dtype', 'output_dir', 'tokenizer'))) > 0)::INT",
        f"(m = 'OBJECT' AND {_has('model', 'checkpoint')} AND {_has('model', 'output_dir')})::INT",
        f"(m = 'OBJECT' AND {_has('model', 'dtype')} AND coalesce(j->>'$.model.dtype', '') NOT IN ({', '.join(repr(d) for d in Rec.DTYPES)}))::INT",
        "(g IS NOT NULL AND g NOT IN ('NULL', 'OBJECT'))::INT",
        f"(g = 'OBJECT' AND len(list_filter(json_keys(j, '$.generation'), lambda k: k NOT IN ({', '.join(repr(d) for d in Rec.SAMPLING_KEYS)}))) > 0)::INT",
        _bad("max_new_tokens", f"{_type('max_new_tokens')} IN {_INT} AND {_value('max_new_tokens')} >= 1"),
        _bad("temperature", f"CASE WHEN {_type('temperature')} IN {_NUM} THEN {_value('temperature')} > 0 END"),
        _bad("top_k", f"{_type('top_k')} = 'NULL' OR CASE WHEN {_type('top_k')} IN {_INT} THEN {_value('top_k')} >= 0 END"),
        _bad("top_p", f"{_type('top_p')} = 'NULL' OR CASE WHEN {_type('top_p')} IN {_NUM} THEN {_value('top_p')} > 0 AND {_value('top_p')} <= 1 END"),
        _bad("repetition_penalty", f"CASE WHEN {_type('repetition_penalty')} IN {_NUM} THEN {_value('repetition_penalty')} > 0 END"),
        _bad("seed", f"{_type('seed')} IN ('NULL', 'BIGINT', 'UBIGINT')"),
        _bad("greedy", f"{_type('greedy')} = 'BOOLEAN'"),
        _bad("return_full_text", f"{_type('return_full_text')} = 'BOOLEAN'"),
    ]
)
_PARSED = f"""{_line_sql()}, js AS (SELECT line_num::BIGINT AS line_num, value, CASE WHEN json_valid(value) THEN value::JSON END AS j FROM raw WHERE trim(value) <> ''),
ty AS (SELECT *, json_type(j) AS t, json_type(j, '$.prompt') AS p, json_type(j, '$.model') AS m, json_type(j, '$.generation') AS g FROM js),
er AS (SELECT *, CASE WHEN j IS NULL OR t <> 'OBJECT' THEN 1 ELSE {_CHECKS} END AS n FROM ty)"""


def parsed(spark, sf_dir):
    return Rec.parse(record_lines(spark, sf_dir), DEFAULTS)


@R.add(f"WITH {_PARSED} SELECT line_num, n::INT AS n_errors FROM er")
def record_errors(spark, sf_dir):
    return parsed(spark, sf_dir).select("line_num", F.size("errors").alias("n_errors"))


_GREEDY = "coalesce((j->>'$.generation.greedy')::BOOLEAN, FALSE)"


def _merged(key: str, kind: str, default: str, neutral: str | None = None) -> str:
    v = f"CASE WHEN coalesce({_has('generation', key)}, FALSE) THEN (j->>'$.generation.{key}')::{kind} ELSE {default} END"
    return f"CASE WHEN {_GREEDY} THEN {neutral} ELSE {v} END" if neutral else v


_RESOLVED = f"""re AS (SELECT line_num, (row_number() OVER (ORDER BY line_num) - 1)::BIGINT AS index, j->>'$.prompt' AS prompt, coalesce(j->>'$.model.checkpoint', j->>'$.model.output_dir', 'runs/base') AS path, coalesce(j->>'$.model.dtype', 'bf16') AS dtype, j->>'$.model.tokenizer' AS tokenizer,
  {_merged('max_new_tokens', 'BIGINT', '64')} AS max_new_tokens, {_merged('temperature', 'DOUBLE', '0.8::DOUBLE', '1.0::DOUBLE')} AS temperature, {_merged('top_k', 'BIGINT', '50', 'NULL')} AS top_k, {_merged('top_p', 'DOUBLE', '0.95::DOUBLE', 'NULL')} AS top_p, NOT {_GREEDY} AS do_sample, {_merged('seed', 'BIGINT', 'NULL')} AS seed FROM er WHERE n = 0)"""


@R.add(f"WITH {_PARSED}, {_RESOLVED} SELECT line_num, index, prompt, path, dtype, tokenizer FROM re")
def record_resolve(spark, sf_dir):
    return Rec.valid(parsed(spark, sf_dir)).select("line_num", "index", "prompt", "path", "dtype", "tokenizer")


@R.add(f"WITH {_PARSED}, {_RESOLVED} SELECT line_num, max_new_tokens, temperature, top_k, top_p, do_sample, seed FROM re")
def record_greedy(spark, sf_dir):
    return Rec.valid(parsed(spark, sf_dir)).select("line_num", "max_new_tokens", "temperature", "top_k", "top_p", "do_sample", "seed")


_CANON = [("runs/x", "runs/x/checkpoint-9"), ("runs/base", "runs/base/final")]


@R.add(f"WITH {_PARSED}, {_RESOLVED}, c AS {values(_CANON, 'path, checkpoint')} SELECT coalesce(c.checkpoint, re.path) AS checkpoint, dtype, tokenizer, count(*)::BIGINT AS records, array_to_string(list_sort(list(DISTINCT re.path)), ',') AS paths FROM re LEFT JOIN c ON c.path = re.path GROUP BY ALL")
def record_groups(spark, sf_dir):
    g = Rec.groups(Rec.canonical(Rec.valid(parsed(spark, sf_dir)), literal(spark, _CANON, "path string, checkpoint string")))
    return g.withColumn("paths", F.array_join("paths", ","))


@R.add(f"WITH {_PARSED} SELECT sum(n)::BIGINT AS problems, 2 AS exit_code FROM er")
def record_refusal(spark, sf_dir):
    """All problems of all lines, and the code with which a command ends that runs nothing because of them."""
    try:
        Rec.plan(parsed(spark, sf_dir), literal(spark, [("runs/x", "runs/x/checkpoint-9"), ("runs/base", "runs/base/final")], "path string, checkpoint string"))
    except Rec.InvalidRecords as e:
        return literal(spark, [(e.count, e.exit_code)], "problems long, exit_code int")
    return literal(spark, [(0, 0)], "problems long, exit_code int")


# --- findings

_FIND = f"""{WIN}, {SHARDS}, {_MIXSQL}, av AS (SELECT bucket, sum(tokens) AS tokens, count(*) AS shards FROM shards GROUP BY bucket),
dm AS (SELECT bucket, sum(weight * duration_tokens) AS demand FROM mix GROUP BY bucket),
un AS (SELECT string_agg(bucket, ',' ORDER BY bucket) AS names FROM (SELECT DISTINCT bucket FROM mix) WHERE bucket NOT IN (SELECT bucket FROM av)),
us AS (SELECT string_agg(bucket, ',' ORDER BY bucket) AS names FROM av WHERE bucket NOT IN (SELECT bucket FROM mix)),
mi AS (SELECT min(shards) AS n FROM av)
SELECT 3 AS rule_order, 'ERROR' AS severity, 'curriculum.unknown_buckets' AS code, names AS subject FROM un WHERE names IS NOT NULL
UNION ALL SELECT 3, 'INFO', 'curriculum.unused_buckets', names FROM us WHERE names IS NOT NULL
UNION ALL SELECT 4, 'ERROR', 'data.shards.fewer_than_world', n || ' < 2' FROM mi WHERE n < 2
UNION ALL SELECT 4, 'WARNING', 'data.num_workers.will_clamp', '16 > ' || (n // 2) FROM mi WHERE n >= 2 AND 16 > n // 2
UNION ALL SELECT 5, 'BUDGET', 'curriculum.shortfall.' || dm.bucket, dm.bucket FROM dm LEFT JOIN av ON av.bucket = dm.bucket WHERE demand > coalesce(tokens, 0)
UNION ALL SELECT 6, 'BUDGET', 'training.budget_mismatch', 'ratio ' || printf('%.2f', 51200 / 1000000) WHERE NOT (51200 / 1000000 BETWEEN 0.95 AND 1.05)"""


@R.add(_FIND)
def validation_findings(spark, sf_dir):
    shards = shard_sizes(spark, sf_dir)
    plan = V.Plan(world=2, workers=16, batch=2, accumulation=1, length=128, steps=100)
    return V.budget_findings(shards, mix(spark), plan).select("rule_order", "severity", "code", "subject")


_SPLITS = [("train", "de"), ("train", "en"), ("train", "es"), ("train", "fr"), ("val", "de"), ("val", "en")]


@R.add(f"""WITH h AS {values(_SPLITS, 'split, bucket')}, b AS (SELECT DISTINCT bucket FROM h WHERE split = 'train'), want AS (SELECT split, bucket FROM b, (VALUES ('train'), ('val')) AS s(split))
SELECT 2 AS rule_order, 'ERROR' AS severity, 'data.' || split || '.' || bucket || '.missing' AS code, bucket AS subject FROM want ANTI JOIN h USING (split, bucket)""")
def validation_missing_splits(spark, sf_dir):
    return V.missing_splits(literal(spark, _SPLITS, "split string, bucket string")).select("rule_order", "severity", "code", "subject")


@R.add(f"WITH f AS ({_FIND}) SELECT (CASE WHEN bool_or(severity IN ('ERROR', 'BUDGET')) THEN 1 WHEN bool_or(severity = 'WARNING') THEN 2 ELSE 0 END)::INT AS exit_code FROM f")
def validation_exit_code(spark, sf_dir):
    return V.exit_code(validation_findings(spark, sf_dir))


@R.add(f"""WITH f AS ({_FIND}), s AS (SELECT CASE WHEN code LIKE 'curriculum.%' THEN 'Curriculum' WHEN code LIKE 'data.%' THEN 'Data' WHEN code LIKE 'training.%' THEN 'Training plan' END AS section, severity FROM f)
SELECT section, severity, count(*)::BIGINT AS findings FROM s GROUP BY ALL""")
def validation_report(spark, sf_dir):
    """Findings of all groups of rules, run in their order, by section of the report."""
    shards = shard_sizes(spark, sf_dir)
    have = shards.groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("shards"))
    plan = V.Plan(world=2, workers=16, batch=2, accumulation=1, length=128, steps=100)
    found = V.run_all(spark, {"buckets": lambda: V.name_findings(have, mix(spark)), "shards": lambda: V.shard_findings(have, plan), "demand": lambda: V.demand_findings(have, mix(spark), plan), "plan": lambda: V.plan_findings(mix(spark), plan)})
    return found.groupBy(V.section(F.col("code")).alias("section"), "severity").agg(F.count("*").alias("findings"))
