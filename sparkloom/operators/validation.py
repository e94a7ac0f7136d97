"""Rules over small tables whose results are findings: (rule_order, severity, code, subject, message).

Each rule gives the facts (code, subject, numbers) as a DataFrame; what a person reads is put together from the code by one table of sentences.
`run_all` runs the groups of rules in their fixed order, later ones also after an error. ERROR and BUDGET fail, WARNING may, INFO doesn't.
"""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions.formatting import format_tokens
from sparkloom.operators import curriculum

SCHEMA = "rule_order int, severity string, code string, subject string, message string"
SPLITS = ("train", "val")
#: Fixed order of the groups of rules.
GROUPS = ("preflight", "tokenizer", "data", "buckets", "shards", "demand", "plan", "output", "resume", "model", "drift")
#: Sections of a report, by how a code begins.
SECTIONS = (("Model", ("tokenizer.", "model.")), ("Data", ("data.",)), ("Curriculum", ("curriculum.",)), ("Training plan", ("training.",)), ("Output", ("output.",)), ("Resume", ("resume.",)), ("Runtime", ("preflight.", "rule.")))
FALL_BACK_VOCAB = 50304


@dataclass(frozen=True)
class Plan:
    world: int = 1
    workers: int = 0
    batch: int = 1
    accumulation: int = 1
    length: int = 2048
    steps: int = 1
    allow_exhaustion: bool = False
    allow_mismatch: bool = False


#: What a finding says, by the part of its code that doesn't name a bucket or split; {} is its subject.
SAYS = {
    "preflight.world_size": "a run needs one rank at least, not {}",
    "tokenizer.load_failed": "the tokenizer can't be used: {}",
    "data.path.empty": "no data folder is named (data.path)",
    "data.path.missing": "there is no folder {}",
    "data.format.jsonl": "{} holds JSON lines, whose tokens aren't known before they are read, so budgets aren't compared",
    "data.split": "the data lacks the split {}",
    "data.buckets.empty": "no bucket stands under {}",
    "data.bucket.missing": "{} is in the training split but not here",
    "data.bucket.no_shards": "{} holds no shard",
    "data.bucket.idx_error": "an index of {} can't be read",
    "data.shards.fewer_than_world": "the smallest bucket has fewer shards than there are ranks: {}",
    "data.num_workers.will_clamp": "more workers are asked for than a rank has shards: {}; the rest won't start",
    "curriculum.unknown_buckets": "phases draw from buckets that aren't there: {}",
    "curriculum.unused_buckets": "no phase draws from {}",
    "training.budget_mismatch": "the loop and the phases don't agree in tokens: {}",
    "output.not_writable": "nothing can be written to {}",
    "resume.path_missing": "there is nothing to resume from at {}",
    "resume.no_trainer_state": "{} has no trainer_state.json",
    "resume.resolve_failed": "no checkpoint can be told from {}",
    "resume.trainer_state_unreadable": "the training state at {} can't be read",
    "model.vocab_unknown": f"the vocabulary's size isn't known; {FALL_BACK_VOCAB} is taken",
    "rule.failed": "a group of rules could not be run: {}",
}


def finding(spark: SparkSession, rows: list[tuple[int, str, str, str]]) -> DataFrame:
    """Findings (rule_order, severity, code, subject) of the driver."""
    return spark.createDataFrame([(*r, SAYS["data.split" if r[2] in {f"data.{s}.missing" for s in SPLITS} else r[2]].format(r[3])) for r in rows], SCHEMA)


def _facts(df: DataFrame, order: int, severity: Column | str, code: Column | str, subject: Column, says: Column | str) -> DataFrame:
    """`says` is a key of the sentences, or a sentence."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    if isinstance(says, str):
        before, _, after = SAYS[says].partition("{}")
        says = F.concat(F.lit(before), subject, F.lit(after))
    return df.select(F.lit(order).alias("rule_order"), lit(severity).alias("severity"), lit(code).alias("code"), subject.alias("subject"), says.alias("message"))


def _place(kind: str) -> Column:
    return F.concat(F.lit("data."), "split", F.lit("."), "bucket", F.lit(f".{kind}"))


def missing_splits(found: DataFrame) -> DataFrame:
    """Buckets of the training split that a split lacks; `found` has (split, bucket)."""
    want = found.where("split = 'train'").select("bucket").distinct().select(F.explode(F.array(*[F.lit(s) for s in SPLITS])).alias("split"), "bucket")
    gone = want.join(found.select("split", "bucket").distinct(), ["split", "bucket"], "left_anti")
    return _facts(gone, 2, "ERROR", _place("missing"), F.col("bucket"), "data.bucket.missing")


def empty_buckets(stats: DataFrame) -> DataFrame:
    """Buckets (split, bucket, shards, error) whose headers can't be read, or without shards."""
    broken = _facts(stats.where("error IS NOT NULL"), 2, "ERROR", _place("idx_error"), F.col("bucket"), "data.bucket.idx_error")
    return broken.unionByName(_facts(stats.where("error IS NULL AND shards = 0"), 2, "ERROR", _place("no_shards"), F.col("bucket"), "data.bucket.no_shards"))


def name_findings(have: DataFrame, mix: DataFrame) -> DataFrame:
    """Buckets that phases name but that aren't there, and those that no phase names."""
    named = curriculum.unknown_buckets(mix, have).groupBy("finding").agg(F.array_join(F.array_sort(F.collect_set("bucket")), ",").alias("names"))
    pick = lambda kind: named.where(F.col("finding") == kind)
    unknown = _facts(pick("unknown"), 3, "ERROR", "curriculum.unknown_buckets", F.col("names"), "curriculum.unknown_buckets")
    return unknown.unionByName(_facts(pick("unused"), 3, "INFO", "curriculum.unused_buckets", F.col("names"), "curriculum.unused_buckets"))


def shard_findings(have: DataFrame, plan: Plan) -> DataFrame:
    """Whether each rank gets a shard of each bucket, and each worker; `have` has (bucket, shards)."""
    least = have.agg(F.min("shards").alias("n")).where("n IS NOT NULL").withColumn("each", F.floor(F.col("n") / plan.world))
    few = least.where(F.col("n") < plan.world)
    idle = least.where((F.col("n") >= plan.world) & (F.lit(plan.workers) > F.col("each")))
    few = _facts(few, 4, "ERROR", "data.shards.fewer_than_world", F.format_string("%d < %d", F.col("n"), F.lit(plan.world)), "data.shards.fewer_than_world")
    return few.unionByName(_facts(idle, 4, "WARNING", "data.num_workers.will_clamp", F.format_string("%d > %d", F.lit(plan.workers), F.col("each")), "data.num_workers.will_clamp"))


def demand_findings(have: DataFrame, mix: DataFrame, plan: Plan) -> DataFrame:
    """Buckets from which all phases together draw more tokens than there are."""
    short = curriculum.shortfall(mix, have, plan.allow_exhaustion)
    says = F.concat("bucket", F.lit(": phases draw "), format_tokens("demand"), F.lit(" tokens, shards hold "), format_tokens("available"), F.lit("; missing: "), format_tokens("shortfall"))
    return _facts(short, 5, F.col("severity"), F.concat(F.lit("curriculum.shortfall."), "bucket"), F.col("bucket"), says)


def plan_findings(mix: DataFrame, plan: Plan) -> DataFrame:
    """Whether the loop's tokens are those that the phases schedule, to a twentieth."""
    loop = plan.batch * plan.accumulation * plan.world * plan.length * plan.steps
    total = mix.select("phase_idx", "duration_tokens").distinct().agg(F.sum("duration_tokens").alias("demand")).where("demand > 0")
    off = total.withColumn("ratio", F.lit(loop) / F.col("demand")).where(~F.col("ratio").between(0.95, 1.05))
    return _facts(off, 6, "WARNING" if plan.allow_mismatch else "BUDGET", "training.budget_mismatch", F.format_string("ratio %.2f", F.col("ratio")), "training.budget_mismatch")


def budget_findings(shards: DataFrame, mix: DataFrame, plan: Plan) -> DataFrame:
    """Names, shard counts, demand and loop length against what is there; `shards` has (bucket, file_idx, tokens)."""
    have = shards.groupBy("bucket").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("shards"))
    parts = (name_findings(have, mix), shard_findings(have, plan), demand_findings(have, mix, plan), plan_findings(mix, plan))
    return reduce(DataFrame.unionByName, parts)


def driver_findings(spark: SparkSession, *, data: str | None, tokenizer: Callable | None = None, output: str | None = None, resume: str | None = None, pretokenized: bool = True, world: int = 1) -> DataFrame:
    """Checks that only look at paths: data, output, tokenizer, resume point, ranks."""
    facts: list[tuple[int, str, str, str]] = []
    say = lambda order, code, subject="", severity="ERROR": facts.append((order, severity, code, subject))
    if world < 1:
        say(0, "preflight.world_size", str(world))
    if tokenizer is not None:
        try:
            tokenizer()
        except Exception as e:  # noqa: BLE001 - any failure is the finding
            say(1, "tokenizer.load_failed", f"{type(e).__name__}: {e}")
    if not data:
        say(2, "data.path.empty")
    elif not os.path.isdir(data):
        say(2, "data.path.missing", data)
    else:
        if not pretokenized:
            say(2, "data.format.jsonl", data, "INFO")
        there = [s for s in SPLITS if os.path.isdir(os.path.join(data, s))]
        for s in set(SPLITS) - set(there):
            say(2, f"data.{s}.missing", s)
        if len(there) == len(SPLITS) and not any(e.is_dir() for e in os.scandir(os.path.join(data, "train"))):
            say(2, "data.buckets.empty", data)
    if output is not None:
        near = output
        while not os.path.isdir(near):
            near = os.path.dirname(os.path.abspath(near))
        if not os.access(near, os.W_OK):
            say(7, "output.not_writable", output)
    if resume not in (None, "auto", "scratch"):
        if not os.path.isdir(resume):
            say(8, "resume.path_missing", resume)
        elif not os.path.isfile(os.path.join(resume, "trainer_state.json")):
            say(8, "resume.no_trainer_state", resume)
    return finding(spark, facts)


def resume_findings(wanted: DataFrame, readable: DataFrame) -> DataFrame:
    """`wanted` has (path, checkpoint), what a hint led to, null if nowhere; `readable` has (checkpoint) of states that can be read."""
    lost = wanted.where("checkpoint IS NULL")
    broken = wanted.where("checkpoint IS NOT NULL").join(readable.select("checkpoint"), "checkpoint", "left_anti")
    lost = _facts(lost, 8, "ERROR", "resume.resolve_failed", F.col("path"), "resume.resolve_failed")
    return lost.unionByName(_facts(broken, 8, "ERROR", "resume.trainer_state_unreadable", F.col("checkpoint"), "resume.trainer_state_unreadable"))


def drift_findings(saved: DataFrame) -> DataFrame:
    """Hashes (kind, stored, current) that differ; an empty stored one matches anything. A changed architecture is an error."""
    moved = saved.where((F.coalesce("stored", F.lit("")) != "") & (F.col("stored") != F.col("current")))
    severity = F.when(F.col("kind") == "arch", "ERROR").otherwise("INFO")
    says = F.concat("kind", F.lit(" is no longer what was saved: "), "stored", F.lit(" then, "), "current", F.lit(" now"))
    return _facts(moved, 10, severity, F.concat(F.lit("resume."), "kind", F.lit("_drift")), F.col("kind"), says)


def vocab_findings(sizes: DataFrame) -> DataFrame:
    """A warning for each row of `sizes` (known, padded) without either number."""
    return _facts(sizes.where("coalesce(known, 0) = 0 AND coalesce(padded, 0) = 0"), 9, "WARNING", "model.vocab_unknown", F.lit(""), "model.vocab_unknown")


def vocab_size(known: Column, padded: Column) -> Column:
    """The size that counts parameters: known, else padded, else a common one."""
    some = lambda c: F.when(c > 0, c)
    return F.coalesce(some(known), some(padded), F.lit(FALL_BACK_VOCAB))


def run_all(spark: SparkSession, groups: dict[str, Callable[[], DataFrame]]) -> DataFrame:
    """Findings of all groups of rules in their fixed order, whatever earlier ones found; a group that can't be run is a finding itself. A group's
    findings are few and are read at once, so that its failure is known here."""
    if odd := sorted(set(groups) - set(GROUPS)):
        raise ValueError(f"no such groups of rules: {odd}")
    rows: list[tuple] = []
    for order, name in enumerate(GROUPS):
        if name not in groups:
            continue
        try:
            rows += [tuple(r) for r in groups[name]().select("rule_order", "severity", "code", "subject", "message").collect()]
        except Exception as e:  # noqa: BLE001 - later groups must still run
            rows.append((order, "ERROR", "rule.failed", name, SAYS["rule.failed"].format(f"{name}: {type(e).__name__}")))
    return spark.createDataFrame(rows, SCHEMA)


def section(code: Column) -> Column:
    """The report's section of a finding."""
    out = F.lit(None).cast("string")
    for name, heads in SECTIONS:
        out = F.when(reduce(Column.__or__, [code.startswith(h) for h in heads]), name).otherwise(out)
    return out


def exit_code(findings: DataFrame, strict: bool = False) -> DataFrame:
    """1 with errors or broken budgets, 2 with warnings (1 if strict), else 0."""
    has = lambda *s: F.coalesce(F.bool_or(F.col("severity").isin(*s)), F.lit(False))
    return findings.agg(F.when(has("ERROR", "BUDGET"), 1).when(has("WARNING"), 1 if strict else 2).otherwise(0).cast("int").alias("exit_code"))


def render(findings: DataFrame, facts: dict[str, dict[str, str]] | None = None) -> str:
    """A report: each section's facts (label: value) and findings under its name, and a line of counts. A report has few findings."""
    rows = findings.withColumn("section", section(F.col("code"))).orderBy("rule_order", "code", "subject").collect()
    lines = []
    for name, _ in SECTIONS:
        own = [f"  {label}: {value}" for label, value in (facts or {}).get(name, {}).items()]
        own += [f"  [{r.severity}] {r.code}: {r.message}" for r in rows if r.section == name]
        if own:
            lines += [name, *own]
    counts = {s: sum(r.severity == s for r in rows) for s in ("ERROR", "BUDGET", "WARNING", "INFO")}
    return "\n".join([*lines, ", ".join(f"{n} {s.lower()}" for s, n in counts.items())])
