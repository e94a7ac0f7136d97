"""Queries over streams: mixing, curricula, progress and training logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.operators import curriculum as C
from sparkloom.operators import mixing as M
from sparkloom.operators import order as O
from sparkloom.operators import profile, progress
from sparkloom.plans.corpus import DOCS, SHARDS, WIN, docs, lines, shard_sizes
from sparkloom.plans.registry import Registry, literal, table, values

R = Registry()

# --- mixing


def bucket_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = docs(spark, sf_dir).select("doc_id", "bucket")
    return O.positions(d, ["bucket"], ["doc_id"], "ord")


_ITEMS = "items AS (SELECT doc_id, lang AS bucket, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ord FROM documents)"


@R.add(f"WITH {_ITEMS} SELECT doc_id, bucket, (row_number() OVER (ORDER BY ord, bucket) - 1)::BIGINT AS place FROM items")
def interleave_roundrobin(spark, sf_dir):
    items = bucket_items(spark, sf_dir)
    return M.round_robin(items, "bucket", M.lengths(items, "bucket")).drop("ord")


@R.add(f"WITH {_ITEMS} SELECT doc_id, bucket, (row_number() OVER (ORDER BY bucket, ord) - 1)::BIGINT AS place FROM items")
def interleave_chain(spark, sf_dir):
    items = bucket_items(spark, sf_dir)
    return M.chain(items, "bucket", M.lengths(items, "bucket")).drop("ord")


_WEIGHTS = {"de": 0.2, "en": 0.5, "es": 0.1, "fr": 0.2}


def slot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lines(docs(spark, sf_dir).drop("text")).withColumn("slot", O.line_slots("line_num", 2, 2))
    return O.positions(d, ["slot", "bucket"], ["doc_id"], "ord").select("slot", "bucket", "ord", "doc_id")


def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many counters for a slot as it has items."""
    d = lines(docs(spark, sf_dir).drop("text")).select("doc_id", O.line_slots("line_num", 2, 2).alias("slot"))
    return O.positions(d, ["slot"], ["doc_id"], "counter").select("slot", "counter")


_SLOT_ITEMS = f"{DOCS}, si AS (SELECT doc_id, bucket, (line_num % 4)::INT AS slot, row_number() OVER (PARTITION BY line_num % 4, bucket ORDER BY doc_id) - 1 AS ord FROM docs)"
_U = "('0x' || substr(md5('42:' || slot || ':' || counter), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE"


def _drawn(bucket: str) -> str:
    return f"""c AS (SELECT slot, (row_number() OVER (PARTITION BY slot ORDER BY doc_id) - 1)::BIGINT AS counter FROM si), u AS (SELECT *, {_U} AS u FROM c),
b AS (SELECT slot, counter, {bucket} AS bucket FROM u), drawn AS (SELECT *, (row_number() OVER (PARTITION BY slot, bucket ORDER BY counter) - 1)::BIGINT AS k FROM b)"""


_WEIGHTED = "CASE WHEN u < 0.2::DOUBLE THEN 'de' WHEN u < (0.2::DOUBLE + 0.5::DOUBLE) THEN 'en' WHEN u < (0.2::DOUBLE + 0.5::DOUBLE + 0.1::DOUBLE) THEN 'es' ELSE 'fr' END"
_EVEN = "CASE WHEN u < 0.25::DOUBLE THEN 'de' WHEN u < 0.5::DOUBLE THEN 'en' WHEN u < 0.75::DOUBLE THEN 'es' ELSE 'fr' END"


@R.add(f"WITH {_SLOT_ITEMS}, {_drawn(_WEIGHTED)} SELECT slot, counter, bucket, k FROM drawn")
def weighted_draws_md5(spark, sf_dir):
    return M.draws(counters(spark, sf_dir), _WEIGHTS).select("slot", "counter", "bucket", "k")


@R.add(f"WITH {_SLOT_ITEMS}, {_drawn(_EVEN)} SELECT slot, counter, bucket, k FROM drawn")
def uniform_draws_md5(spark, sf_dir):
    """A random interleave without preference: the same with equal weights."""
    return M.draws(counters(spark, sf_dir), M.uniform(list(_WEIGHTS))).select("slot", "counter", "bucket", "k")


_ZERO = {"de": 0.5, "en": 0.0, "fr": 0.5}


_HALVES = "CASE WHEN u < 0.5::DOUBLE THEN 'de' ELSE 'fr' END"


@R.add(f"WITH {_SLOT_ITEMS}, {_drawn(_HALVES)} SELECT bucket, count(*)::BIGINT AS draws, max(k)::BIGINT + 1 AS taken FROM drawn GROUP BY bucket")
def zero_weight_draws(spark, sf_dir):
    """A bucket of weight 0 and one without a weight are never drawn."""
    d = M.draws(counters(spark, sf_dir), _ZERO)
    return d.groupBy("bucket").agg(F.count("*").alias("draws"), (F.max("k") + 1).alias("taken"))


@R.add(f"WITH {_SLOT_ITEMS}, {_drawn(_WEIGHTED)} SELECT d.slot, counter, d.bucket, k, doc_id FROM drawn d JOIN si ON si.slot = d.slot AND si.bucket = d.bucket AND si.ord = d.k")
def weighted_join(spark, sf_dir):
    """A slot draws as often as it has items; draws of a bucket that is dry by then find nothing."""
    return M.join_draws(M.draws(counters(spark, sf_dir), _WEIGHTS), slot_items(spark, sf_dir)).select("slot", "counter", "bucket", "k", "doc_id")


@R.add()
def weighted_interleave_mt(spark, sf_dir):
    """With exhaustion and the Mersenne Twister, every document once."""
    items = slot_items(spark, sf_dir)
    queues = items.groupBy("slot", "bucket").agg(F.count("*").alias("n")).withColumn("worker", F.col("slot") % 2)
    return M.join_draws(M.weighted_interleave(queues, _WEIGHTS), items).select("slot", "counter", "bucket", "doc_id")


@R.add("SELECT lang AS bucket, (row_number() OVER (ORDER BY lang) - 1)::INT AS bucket_id, 1.0::DOUBLE / (count(*) OVER ())::DOUBLE AS weight FROM (SELECT DISTINCT lang FROM documents)")
def uniform_mix(spark, sf_dir):
    """The default mix, and each bucket's id by name."""
    ids = O.bucket_ids(table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket")))
    return ids.withColumn("weight", 1 / F.count("*").over(Window.partitionBy()))


# --- curriculum

_MIX = [(0, 300000, "de", 0.2), (0, 300000, "en", 0.5), (0, 300000, "es", 0.1), (0, 300000, "fr", 0.2), (1, 200000, "en", 3.0), (1, 200000, "fr", 1.0), (2, 500000, "en", 0.75), (2, 500000, "zz", 0.25)]
_MIXSQL = f"raw AS {values(_MIX, 'phase_idx, duration_tokens, bucket, weight')}, mix AS (SELECT phase_idx, duration_tokens, bucket, weight / sum(weight) OVER (PARTITION BY phase_idx) AS weight FROM raw)"


def mix(spark: SparkSession) -> DataFrame:
    return C.normalise(literal(spark, _MIX, "phase_idx int, duration_tokens int, bucket string, weight double"))


@R.add(f"WITH {_MIXSQL} SELECT phase_idx, bucket, round(weight, 9) AS weight FROM mix")
def mix_normalise(spark, sf_dir):
    return mix(spark).select("phase_idx", "bucket", F.round("weight", 9).alias("weight"))


@R.add(f"WITH {_MIXSQL} SELECT phase_idx, bucket, round(weight * duration_tokens, 3) AS demand FROM mix")
def curriculum_demand(spark, sf_dir):
    return C.demand(mix(spark)).select("phase_idx", "bucket", F.round("demand", 3).alias("demand"))


@R.add(f"WITH {_MIXSQL} SELECT phase_idx, bucket, round(sum(weight * duration_tokens) OVER (PARTITION BY bucket ORDER BY phase_idx), 3) AS cumulative FROM mix")
def curriculum_cumulative(spark, sf_dir):
    return C.demand(mix(spark)).select("phase_idx", "bucket", F.round("cumulative", 3).alias("cumulative"))


_AVAILABLE = "av AS (SELECT bucket, sum(tokens)::BIGINT AS available FROM shards GROUP BY bucket)"


def available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_sizes(spark, sf_dir).groupBy("bucket").agg(F.sum("tokens").alias("tokens"))


@R.add(f"""{WIN}, {SHARDS}, {_AVAILABLE}, {_MIXSQL}, d AS (SELECT bucket, sum(weight * duration_tokens) AS demand FROM mix GROUP BY bucket)
SELECT d.bucket, round(demand, 3) AS demand, coalesce(available, 0)::BIGINT AS available, round(demand - coalesce(available, 0), 3) AS shortfall, 'BUDGET' AS severity
FROM d LEFT JOIN av ON av.bucket = d.bucket WHERE demand > coalesce(available, 0)""")
def curriculum_shortfall(spark, sf_dir):
    s = C.shortfall(mix(spark), available(spark, sf_dir))
    return s.withColumn("demand", F.round("demand", 3)).withColumn("shortfall", F.round("shortfall", 3))


@R.add(f"""WITH {_MIXSQL}, n AS (SELECT DISTINCT bucket FROM mix), t AS (SELECT DISTINCT lang AS bucket FROM documents)
SELECT bucket, 'unknown' AS finding FROM n WHERE bucket NOT IN (SELECT bucket FROM t) UNION ALL SELECT bucket, 'unused' FROM t WHERE bucket NOT IN (SELECT bucket FROM n)""")
def curriculum_unknown_buckets(spark, sf_dir):
    return C.unknown_buckets(mix(spark), table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket")))


def training_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a training log: one row for each rank's micro step."""
    e = table(spark, sf_dir, "events")
    return e.select(F.floor(F.col("event_id") / 4).cast("long").alias("step"), (F.col("user_id") % 4).cast("int").alias("rank"), F.col("value").alias("loss"), (F.col("value") / 10).alias("grad_norm"), (F.col("event_id") % 97 + 32).alias("trained"), F.lit(128).cast("long").alias("possible"), (F.col("event_id") / 4).alias("clock"))


_LOG = "log AS (SELECT (event_id // 4)::BIGINT AS step, value AS loss, value / 10 AS grad_norm, event_id % 97 + 32 AS trained, 128 AS possible, event_id / 4 AS clock FROM events)"
_DURATIONS = [20000, 35000, 15000, 10**12]


@R.add(f"""WITH RECURSIVE {_LOG}, s AS (SELECT step, sum(trained)::BIGINT AS tokens FROM log GROUP BY step), n AS (SELECT *, row_number() OVER (ORDER BY step) AS r FROM s),
go(r, step, tokens, phase, acc, shown, acc_shown) AS (
  SELECT 0::BIGINT, -1::BIGINT, 0::BIGINT, 0, 0::BIGINT, 0, 0::BIGINT
  UNION ALL
  SELECT n.r, n.step, n.tokens, CASE WHEN g.phase < 3 AND g.acc + n.tokens >= {_DURATIONS}[g.phase + 1] THEN g.phase + 1 ELSE g.phase END,
    CASE WHEN g.phase < 3 AND g.acc + n.tokens >= {_DURATIONS}[g.phase + 1] THEN 0 ELSE g.acc + n.tokens END, g.phase, g.acc + n.tokens
  FROM go g JOIN n ON n.r = g.r + 1)
SELECT step, tokens, shown::INT AS phase_idx, acc_shown::BIGINT AS phase_tokens FROM go WHERE r > 0""")
def phase_switch(spark, sf_dir):
    steps = training_log(spark, sf_dir).groupBy("step").agg(F.sum("trained").alias("tokens"))
    return C.phase_of_steps(steps, _DURATIONS)


_PLANS = [(2, 2, 1, 128, 100, 51200), (4, 8, 8, 2048, 28800, 15000000000), (2, 2, 1, 128, 100, 60000), (2, 2, 2, 128, 100, 60000)]
_PLAN_COLS = "batch, accumulation, world, length, steps, demand"


@R.add(f"""SELECT demand::BIGINT AS demand, (batch * accumulation * world * length)::BIGINT * steps AS loop_tokens, round((batch * accumulation * world * length)::BIGINT * steps / demand, 9) AS ratio,
  NOT ((batch * accumulation * world * length)::BIGINT * steps / demand BETWEEN 0.95 AND 1.05) AS mismatch FROM {values(_PLANS, _PLAN_COLS)}""")
def budget_mismatch(spark, sf_dir):
    p = literal(spark, _PLANS, "batch int, accumulation int, world int, length int, steps int, demand long")
    return C.budget_ratio(p).select("demand", "loop_tokens", F.round("ratio", 9).alias("ratio"), "mismatch")


_DRY = [(0, "en"), (1, "fr"), (2, "de"), (2, "es")]


@R.add(f"WITH ids AS (SELECT lang AS bucket, row_number() OVER (ORDER BY lang) - 1 AS bucket_id FROM (SELECT DISTINCT lang FROM documents)), d AS {values(_DRY, 'slot, bucket')} SELECT coalesce(max(bucket_id) + 1, 0)::INT AS code FROM d JOIN ids USING (bucket) WHERE bucket NOT IN ('fr')")
def exhaustion_code(spark, sf_dir):
    ids = O.bucket_ids(table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket")))
    return C.exhaustion_code(literal(spark, _DRY, "slot int, bucket string"), ids, ["fr"])


@R.add(f"""WITH ids AS (SELECT lang AS bucket, row_number() OVER (ORDER BY lang) - 1 AS bucket_id FROM (SELECT DISTINCT lang FROM documents)), d AS {values(_DRY, 'slot, bucket')},
n AS (SELECT arg_max(bucket, bucket_id) AS bucket FROM d JOIN ids USING (bucket) WHERE bucket NOT IN ('fr'))
SELECT allow, CASE WHEN bucket IS NULL THEN 'continue' WHEN allow THEN 'renormalise' ELSE 'halt' END AS action, CASE WHEN NOT allow THEN 'bucket_exhausted:' || bucket END AS reason FROM n, (VALUES (TRUE), (FALSE)) AS a(allow)""")
def exhaustion_policy(spark, sf_dir):
    """What follows a dry bucket, with and without leave to go on."""
    ids = O.bucket_ids(table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket")))
    dry = literal(spark, _DRY, "slot int, bucket string")
    both = [C.exhaustion_policy(dry, ids, ["fr"], allow).select(F.lit(allow).alias("allow"), "action", "reason") for allow in (True, False)]
    return both[0].unionByName(both[1])


@R.add(f"WITH {_MIXSQL}, l AS (SELECT * FROM mix WHERE bucket NOT IN ('en', 'fr') AND weight > 0) SELECT phase_idx, bucket, round(weight / sum(weight) OVER (PARTITION BY phase_idx), 9) AS weight FROM l")
def mix_renormalised(spark, sf_dir):
    """The mix after two buckets have run dry; a phase of these alone is gone."""
    left = C.renormalise(mix(spark), literal(spark, [("en",), ("fr",)], "bucket string"))
    return left.select("phase_idx", "bucket", F.round("weight", 9).alias("weight"))


# --- progress


def saved_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = docs(spark, sf_dir).select("bucket", "file_idx").distinct()
    f = f.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(3))))
    v = F.col("file_idx") * 7 + F.col("slot") * 13
    return f.withColumn("progress", F.when(v % 11 == 0, -1).otherwise(v % 31).cast("int"))


_PROGRESS = f"{DOCS}, sp AS (SELECT bucket, file_idx, slot, CASE WHEN (file_idx * 7 + slot * 13) % 11 = 0 THEN -1 ELSE (file_idx * 7 + slot * 13) % 31 END AS progress FROM (SELECT DISTINCT bucket, file_idx FROM docs), range(4) AS t(slot)), mp AS (SELECT bucket, file_idx, (CASE WHEN bool_or(progress = -1) THEN -1 ELSE max(progress) END)::INT AS progress FROM sp GROUP BY ALL)"


@R.add(f"WITH {_PROGRESS} SELECT bucket, file_idx, progress FROM mp")
def progress_merge(spark, sf_dir):
    return progress.merge(saved_progress(spark, sf_dir))


@R.add(f"WITH {_PROGRESS} SELECT d.doc_id, d.bucket, d.file_idx, d.line_num + 1 AS item_no FROM docs d LEFT JOIN mp ON mp.bucket = d.bucket AND mp.file_idx = d.file_idx WHERE progress IS NULL OR (progress <> -1 AND line_num + 1 > progress)")
def resume_filter(spark, sf_dir):
    items = lines(docs(spark, sf_dir).select("doc_id", "bucket", "file_idx")).withColumn("item_no", F.col("line_num") + 1).drop("line_num")
    return progress.resume(items, progress.merge(saved_progress(spark, sf_dir))).select("doc_id", "bucket", "file_idx", "item_no")


@R.add(f"WITH {_PROGRESS} SELECT bucket, sum(greatest(progress, 0))::BIGINT AS items FROM sp GROUP BY bucket")
def consumed_items(spark, sf_dir):
    return progress.consumed(saved_progress(spark, sf_dir))


@R.add(f"""WITH {DOCS}, i AS (SELECT *, (line_num % 4)::INT AS slot, row_number() OVER (PARTITION BY line_num % 4 ORDER BY doc_id) - 1 AS ord FROM docs)
SELECT slot, (ord // 8)::BIGINT AS batch_idx, arg_max(bucket, ord) AS bucket, arg_max(file_idx, ord) AS file_idx, arg_max(line_num, ord) AS line_num FROM i GROUP BY ALL""")
def batch_cursor(spark, sf_dir):
    d = lines(docs(spark, sf_dir).drop("text", "split")).withColumn("slot", O.line_slots("line_num", 2, 2))
    d = O.batches(O.positions(d, ["slot"], ["doc_id"], "ord"), ["slot"], "ord", 8, False)
    return progress.batch_cursors(d, ["slot", "batch_idx"], "ord", ["bucket", "file_idx", "line_num"])


@R.add("""WITH c AS (SELECT event_id AS micro, (user_id % 4)::INT AS slot, value FROM events), n AS (SELECT max(micro) + 1 AS n FROM c),
s AS (SELECT slot, CASE WHEN micro < n - n % 48 THEN 'committed' ELSE 'pending' END AS state, micro, value FROM c, n)
SELECT slot, state, max(micro)::BIGINT AS micro, arg_max(value, micro) AS value FROM s GROUP BY slot, state""")
def cursor_commit(spark, sf_dir):
    """Cursors of the last whole optimizer step of 48 micro steps, and those read since."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("micro"), (F.col("user_id") % 4).cast("int").alias("slot"), "value")
    return progress.commit(e, 48, by=["slot"], order="micro")


@R.add(f"""WITH {DOCS}, i AS (SELECT split, (line_num % 4) AS slot, doc_id, row_number() OVER (PARTITION BY split, line_num % 4 ORDER BY doc_id) - 1 AS ord FROM docs),
b AS (SELECT DISTINCT split, slot, ord // 8 AS batch_idx FROM i)
SELECT split, (slot // 2)::INT AS rank, (slot % 2)::INT AS worker, batch_idx::BIGINT AS batch_idx, (row_number() OVER (PARTITION BY split, slot // 2 ORDER BY batch_idx, slot % 2) - 1)::BIGINT AS place FROM b""")
def loader_order(spark, sf_dir):
    """The order in which a rank gets its workers' batches."""
    d = lines(docs(spark, sf_dir).drop("text")).withColumn("slot", O.line_slots("line_num", 2, 2))
    b = O.batches(O.positions(d, ["split", "slot"], ["doc_id"], "ord"), ["split", "slot"], "ord", 8, False)
    b = b.select("split", F.floor(F.col("slot") / 2).cast("int").alias("rank"), (F.col("slot") % 2).alias("worker"), "batch_idx").distinct()
    return O.loader_order(b, ["split", "rank"], "worker", "batch_idx")


_STATES = [(2, 2, 2, 0), (2, 2, 2, 1), (99, 4, 1, 0), (2, 2, 2, 2)]


@R.add(f"SELECT coalesce(bool_and(world_size = 2 AND num_workers = 2), FALSE) AS restore, count(*)::BIGINT AS states FROM {values(_STATES, 'schema_version, world_size, num_workers, slot')} WHERE schema_version = 2")
def topology_match(spark, sf_dir):
    return progress.restore_slots(literal(spark, _STATES, "schema_version int, world_size int, num_workers int, slot int"), 2, 2)


# --- logs


@R.add(f"WITH {_LOG} SELECT (step // 50)::BIGINT AS interval, count(*)::BIGINT AS rows, round(avg(loss), 6) AS mean_loss, round(avg(grad_norm), 6) AS mean_grad_norm, sum(trained)::BIGINT AS tokens, sum(trained)::DOUBLE * 100.0::DOUBLE / sum(possible)::DOUBLE AS packing_pct FROM log GROUP BY 1")
def interval_metrics(spark, sf_dir):
    m = profile.interval_metrics(training_log(spark, sf_dir), 50)
    return m.withColumn("mean_loss", F.round("mean_loss", 6)).withColumn("mean_grad_norm", F.round("mean_grad_norm", 6)).withColumn("packing_pct", F.col("packing_pct").cast("double"))


@R.add(f"""WITH {_LOG}, g AS (SELECT (step // 50)::BIGINT AS interval, sum(trained) AS t, count(DISTINCT step) AS n, min(clock) AS a, max(clock) AS z FROM log GROUP BY 1), s AS (SELECT *, z - coalesce(lag(z) OVER (ORDER BY interval), a) AS seconds FROM g)
SELECT interval, seconds, round(CASE WHEN seconds > 0 THEN t / seconds ELSE 0 END, 6) AS tokens_per_second, round(seconds / n, 6) AS seconds_per_step FROM s""")
def interval_rates(spark, sf_dir):
    """Tokens a second and seconds a step; a micro step takes a quarter of a second."""
    r = profile.interval_rates(training_log(spark, sf_dir), 50)
    return r.select("interval", "seconds", F.round("tokens_per_second", 6).alias("tokens_per_second"), F.round("seconds_per_step", 6).alias("seconds_per_step"))


@R.add(f"WITH {_LOG}, s AS (SELECT step, sum(trained)::BIGINT AS tokens FROM log GROUP BY step) SELECT step, tokens, (sum(tokens) OVER (ORDER BY step))::BIGINT AS total FROM s")
def tokens_running(spark, sf_dir):
    return profile.running_tokens(training_log(spark, sf_dir))


@R.add("SELECT count(*)::BIGINT AS batches, round(avg(value / 100), 6) AS eval_loss, round(exp(least(avg(value / 100), 20)), 6) AS perplexity FROM events WHERE event_id < 100")
def eval_perplexity(spark, sf_dir):
    losses = table(spark, sf_dir, "events").select(F.col("event_id").alias("batch_idx"), (F.col("value") / 100).alias("loss"))
    p = profile.eval_perplexity(losses, None)
    return p.select("batches", F.round("eval_loss", 6).alias("eval_loss"), F.round("perplexity", 6).alias("perplexity"))
