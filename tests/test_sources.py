import gzip
import json
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import config
from sparkloom.functions import sql as Names
from sparkloom.functions import tokens as T
from sparkloom.operators import records as Rec
from sparkloom.operators import validation as V
from sparkloom.sources import jsonl, shards, state


def test_index_round_trip():
    data = shards.pack_index(np.array([100, 150, 150]), np.array([0, 16, 0]), 2)
    assert data[:16] == b"GPTS\x01\0\0\0\x02\0\0\0\x03\0\0\0"
    code, offsets, overlaps = shards.unpack_index(data)
    assert (code, offsets.tolist(), overlaps.tolist()) == (2, [0, 100, 250, 400], [0, 16, 0])
    with pytest.raises(ValueError, match="no shard index"):
        shards.unpack_index(b"NOPE" + data[4:])


def test_shards_round_trip(spark, tmp_path):
    rows = [(i, list(range(i, i + 1 + i % 7)), i % 3) for i in range(40)]
    w = spark.createDataFrame(rows, "i int, tokens array<int>, overlap_len int").repartition(3, "i").sortWithinPartitions("i")
    root = str(tmp_path / "train" / "a")
    shards.write_shards(w, root, 50257)
    back = shards.read_shards(spark, str(tmp_path))
    assert sorted((list(r.tokens), r.overlap_len) for r in back.collect()) == sorted((t, o) for _, t, o in rows)
    heads = shards.read_shards(spark, str(tmp_path), "header").collect()
    assert sum(r.docs for r in heads) == 40 and all(r.error is None and r.dtype_code == 2 for r in heads)
    by_sql = shards.read_headers(spark, str(tmp_path)).collect()
    assert sorted(r.tokens for r in by_sql) == sorted(r.tokens for r in heads)
    assert back.where("bucket = 'a' AND file_idx = 0").count() == next(r.docs for r in heads if r.file_idx == 0)
    with open(os.path.join(root, sorted(f for f in os.listdir(root) if f.endswith(".bin"))[0]), "ab") as f:
        f.write(b"xx")
    heads = shards.read_shards(spark, str(tmp_path), "header")
    assert sum(r.error is not None for r in heads.collect()) == 1
    assert sorted((r.split, r.bucket, r.failed) for r in shards.roll_up(heads).collect() if r.bucket) == [("train", "a", 1)]


def test_shards_add_up_and_are_named_after_inputs(spark, tmp_path):
    root = str(tmp_path / "train" / "a")
    one = lambda t, f="x.jsonl.gz": spark.createDataFrame([([t] * 3, 0, f)], "tokens array<int>, overlap_len int, file string")
    tokens = lambda: sorted(list(r.tokens) for r in shards.read_shards(spark, str(tmp_path)).collect())
    shards.write_shards(one(1), root, 100)
    shards.write_shards(one(2), root, 100)
    assert tokens() == [[1, 1, 1], [2, 2, 2]]
    shards.write_shards(one(3), root, 100, overwrite=True)
    assert tokens() == [[3, 3, 3]]
    files = one(4).unionByName(one(5, "b.jsonl")).unionByName(one(6, "b.jsonl")).coalesce(1)
    shards.write_shards(files, root, 100, file="file")
    assert sorted(f for f in os.listdir(root) if not f.startswith("shard-")) == ["b.bin", "b.idx", "x.bin", "x.idx"] and len(tokens()) == 4
    with pytest.raises(Exception, match="already holds"):
        shards.write_shards(files, root, 100, file="file")
    with pytest.raises(Exception, match="more than one task"):
        shards.write_shards(one(7).unionByName(one(8)).repartition(2, "tokens"), str(tmp_path / "o"), 100, file="file")
    with pytest.raises(Exception, match="does not fit"):
        shards.write_shards(one(70_000), root, 100)
    assert len(tokens()) == 4 and shards.read_shards(spark, str(tmp_path), "header").where("bucket = 'a'").count() == 3


def test_trees(spark, tmp_path):
    for code, made in (("data.split.missing", "train"), ("data.buckets.empty", "val"), ("data.bucket.no_shards", "train/a"), (None, "val/b")):
        (tmp_path / made).mkdir(parents=True)
        if made == "val/b":
            (tmp_path / "train/a/s.idx").write_bytes(b"")
            (tmp_path / "val/b/t.idx").write_bytes(b"")
            assert [(r.split, r.bucket, r.file_idx) for r in shards.scan_tree(spark, str(tmp_path)).collect()] == [("train", "a", 0), ("val", "b", 0)]
            continue
        with pytest.raises(shards.TreeError) as e:
            shards.scan_tree(spark, str(tmp_path))
        assert e.value.code in (code, "data.buckets.empty")


def test_json_lines(spark, tmp_path):
    with gzip.open(tmp_path / "a.jsonl.gz", "wt") as f:
        f.write('{"text": "%s"}\n\n{"text": 5}\n{bad\n{"other": 1}\n' % ("x" * 20))
    (tmp_path / "b.jsonl").write_text('{"text": "  hello  "}\n')
    (tmp_path / "c.txt").write_text("no\n")
    lines = jsonl.read_numbered(spark, str(tmp_path))
    got = {(r.file, r.line_num): r.status for r in jsonl.texts(lines, least_chars=5).collect()}
    assert got == {("a.jsonl.gz", 1): "ok", ("a.jsonl.gz", 3): "short", ("a.jsonl.gz", 4): "bad", ("a.jsonl.gz", 5): "short", ("b.jsonl", 1): "ok"}
    stream = {r.line_num: (r.status, r.text) for r in jsonl.texts(lines, least_chars=5, streaming=True).where("file = 'a.jsonl.gz' OR line_num = 1").collect() if r.file == "a.jsonl.gz"}
    assert stream[5] == ("missing", None)
    with pytest.raises(ValueError, match="a.jsonl.gz:1: missing required key"):
        jsonl.read_strict(spark, str(tmp_path / "a.jsonl.gz"))


def test_numbers_of_split_files(spark, tmp_path):
    (tmp_path / "big.jsonl").write_text("".join(f'{{"n": {i}}}\n' for i in range(5000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        d = jsonl.read_numbered(spark, str(tmp_path))
        rows = d.select("line_num", F.get_json_object("value", "$.n").cast("int").alias("n")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(rows) == 5000 and all(r.line_num == r.n + 1 for r in rows)


def test_states(spark, tmp_path):
    state.replace_state(str(tmp_path / "a.json"), {"status": "running", "loss": float("inf"), "checkpoint": "c", "odd": 1})
    (tmp_path / "b.json").write_text("{broken")
    rows = state.read_runs(spark, str(tmp_path)).collect()
    assert [(r.status, r.loss, r.latest_checkpoint) for r in rows] == [("running", float("inf"), "c")]


def test_tokenizers():
    gpt = T.resolve("gpt2")
    assert (gpt.vocab_size, gpt.eod_id, gpt.pad_id) == (50258, 50256, 50257)
    assert T.encode_texts(gpt, ["Hello world"]) == [[15496, 995]]
    with pytest.raises(ValueError, match="no tokenizer"):
        T.resolve("something-else")


def test_bpe_is_the_other_library(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    spec = T.resolve("gpt2")
    texts = ["It's 12 o'clock,\n\n  né?", "", "日本 🎉", "a" * 300]
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary_batch(texts)
    d = spark.createDataFrame([(t,) for t in [*texts, None]], "text string").select("text", T.encode(spec)("text").alias("ids"))
    rows = d.withColumn("back", T.decode(spec)("ids")).collect()
    assert [list(r.ids) for r in rows] == [*want, []] and [r.back for r in rows] == [*texts, ""]


def test_sql_names(spark):
    Names.register(spark, T.resolve("gpt2"))
    assert spark.sql("SELECT size(tokenize('Hello world')) AS n").first().n == 2
    rows = spark.sql("SELECT w.* FROM create_windows(array(1, 2, 3, 4, 5), 0, 4, 1) w").collect()
    assert [(r.window_idx, r.overlap_len, list(r.tokens)) for r in rows] == [(0, 0, [1, 2, 3, 4]), (1, 1, [4, 5, 0])]
    placed = spark.sql("SELECT p.* FROM pack_windows(array(3, 9, 5, 7, 30), 10) p").collect()
    assert [(r.item, r.seq_idx, r.place) for r in placed] == [(4, 0, 0), (1, 1, 0), (3, 2, 0), (2, 3, 0), (0, 2, 1)]


def test_tokens_with_marks_padding_and_pieces(spark):
    import public_tokenizers as P

    gpt, sp = T.resolve("gpt2"), T.resolve(P.path("piece_bpe_32k.model"))
    assert T.encode_texts(gpt, ["Hello", "a b c d"], 3, padded=True) == [[15496, 50257, 50257], [64, 275, 269]]
    assert [x[0] for x in T.encode_texts(sp, ["Hello"], special=True)] == [sp.bos_id]
    assert T.find_metaspace(gpt) is None
    found = T.find_metaspace(sp)
    assert found is not None and T.load(sp).id_to_piece(found) == "\u2581"
    d = spark.createDataFrame([("Hello world  ",), ("",), (None,), ("   ",)], "text string").withColumn("tokens", T.encode(sp)("text"))
    back = T.piece_ids(sp, T.pieces(sp, d).withColumnRenamed("tokens", "ids")).collect()
    assert all(list(r.ids) == list(r.tokens) for r in back)
    assert d.select(T.decode(sp)("tokens").alias("t")).first().t == "Hello world"


def test_models_of_runs(spark, tmp_path, monkeypatch):
    for name, step in (("checkpoint-10", 10), ("checkpoint-9", 9), ("checkpoint-11.partial", 11)):
        (tmp_path / "run/checkpoints" / name).mkdir(parents=True)
        (tmp_path / "run/checkpoints" / name / "trainer_state.json").write_text(json.dumps({"step": step}))
    (tmp_path / "run/tokenizer").mkdir()
    (tmp_path / "lone/model").mkdir(parents=True)
    (tmp_path / "lone/model/config.json").write_text("{}")
    monkeypatch.setenv("RUNS_HERE", str(tmp_path))
    d = spark.createDataFrame([("$RUNS_HERE/run",), (f"{tmp_path}/lone",), ("nowhere",), (None,)], "path string")
    got = {r.path: (r.checkpoint, r.tokenizer_dir) for r in Rec.resolve_models(d).collect()}
    assert got == {"$RUNS_HERE/run": (f"{tmp_path}/run/checkpoints/checkpoint-10", f"{tmp_path}/run/tokenizer")}
    (tmp_path / "lone/tokenizer").mkdir()
    (tmp_path / "run/checkpoints/final").mkdir()
    (tmp_path / "run/checkpoints/final/trainer_state.json").write_text('{"step": 8}')
    got = {r.path: r.checkpoint.rsplit("/", 1)[1] for r in Rec.resolve_models(d).collect()}
    assert got == {"$RUNS_HERE/run": "final", f"{tmp_path}/lone": "lone"}


def test_streamed_lines_need_a_file(spark, tmp_path):
    with pytest.raises(jsonl.NoInput) as e:
        jsonl.stream_texts(spark, str(tmp_path))
    assert e.value.exit_code == 1
    (tmp_path / "a.jsonl").write_text('{"text": "hello"}\n')
    assert len(jsonl.find_inputs(spark, str(tmp_path))) == 1 and jsonl.stream_texts(spark, str(tmp_path)).isStreaming


def test_config(tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"data": {"curriculum": [{"duration_tokens": 10, "mix": {"a": 3, "b": 1}}]}}))
    c = config.read(str(tmp_path / "c.json"))
    assert c.mix_rows() == [(0, 10, "a", 0.75), (0, 10, "b", 0.25)] and c["optimizer.warmup_steps"] == 100 and c["data.tokenizer"] == "gpt2"
    (tmp_path / "c.yaml").write_text("training:\n  max_steps: 7\n")
    assert config.read(str(tmp_path / "c.yaml"))["training.max_steps"] == 7
    phase = {"duration_tokens": 5, "mix": {"a": 1}}
    wrong = {"data.format": {"data": {"format": "csv"}}, "data.nope": {"data": {"nope": 1}}, "data.overlap_size": {"data": {"max_length": 10, "overlap_size": 6}}, "optimizer.learning_rate": {"optimizer": {"learning_rate": 0}}}
    wrong |= {"data.curriculum": {"data": {"format": "jsonl", "curriculum": [phase]}}, "data.curriculum[1].duration_tokens": {"data": {"curriculum": [phase, {**phase, "duration_tokens": 0}]}}}
    wrong |= {f"data.curriculum[0].{k}": {"data": {"curriculum": [{**phase, k: v}]}} for k, v in {"mix": {"a": 0}}.items()}
    for place, raw in wrong.items():
        assert [p for p, _ in config.problems(raw)] == [place]
        with pytest.raises(config.ConfigError, match=re.escape(place)) as e:
            config.build(raw)
        assert e.value.exit_code == 2
    with pytest.raises(config.ConfigError):
        config.read(str(tmp_path / "none.json"))
    with pytest.warns(UserWarning, match="odd"):
        config.build({"odd": {}})


def test_states_are_replaced_as_a_whole(spark, tmp_path):
    state.replace_state(str(tmp_path / "s" / "a.json"), {"schema_version": 1, "step": 3}, durable=True)
    with pytest.raises(TypeError):
        state.replace_state(str(tmp_path / "s" / "a.json"), {"step": object()})
    (tmp_path / "s" / "b.json").write_text('{"schema_version": 9}')
    assert sorted(os.listdir(tmp_path / "s")) == ["a.json", "b.json"]
    assert [r.step for r in state.read_trainers(spark, str(tmp_path / "s")).collect()] == [3]
    assert [r.path.rsplit("/", 1)[1] for r in state.unreadable(spark, str(tmp_path / "s")).collect()] == ["b.json"]


def test_records_run_by_group(spark):
    lines = spark.createDataFrame([(1, '{"prompt": "a", "id": 7}'), (2, '{"prompt": "é", "model": {"checkpoint": "x"}}'), (3, '{"prompt": "boom"}')], "line_num int, value string")
    good = Rec.valid(Rec.parse(lines, Rec.Defaults("base")))
    ready = Rec.canonical(good, spark.createDataFrame([("x", "x/final")], "path string, checkpoint string"))

    def load(checkpoint, dtype, tokenizer):
        def one(r):
            if r["prompt"] == "boom":
                raise ValueError("no")
            return f"{checkpoint}:{r['prompt']}"

        return one

    out = [json.loads(r.value) for r in Rec.output_lines(ready, Rec.run_groups(ready, load)).collect()]
    assert [o.get("output") for o in out] == ["base:a", "x/final:é", None]
    assert out[0]["id"] == 7 and out[2]["error"] == "ValueError: no"
    assert Rec.problems(Rec.parse(spark.createDataFrame([(4, "[]")], "line_num int, value string"), Rec.Defaults()), "f").first().message == "f:4: line.object, wanted is an object"


def test_nothing_runs_with_problems(spark):
    lines = [(1, '{"prompt": "a"}'), (2, '{"prompt": 7, "generation": {"top_p": 2}}'), (3, "  "), (4, None), (5, '{"prompt": "b", "model": {"checkpoint": "lost"}}')]
    parsed = Rec.parse(spark.createDataFrame(lines, "line_num int, value string"), Rec.Defaults("base"))
    known = spark.createDataFrame([("base", "base/final")], "path string, checkpoint string")
    with pytest.raises(Rec.InvalidRecords) as e:
        Rec.plan(parsed, known, "in")
    assert (e.value.exit_code, e.value.count) == (2, 3)
    assert [m.split(",")[0] for m in e.value.problems] == ["in:2: generation.top_p", "in:2: prompt.text", "model.resolve"]
    ready, models = Rec.plan(parsed.where("line_num = 1"), known)
    assert [(r["index"], r.checkpoint) for r in ready.collect()] == [(0, "base/final")] and models.count() == 1


def test_driver_findings(spark, tmp_path):
    codes = {r.code for r in V.driver_findings(spark, data=str(tmp_path), resume=str(tmp_path), world=0).collect()}
    assert codes == {"preflight.world_size", "data.train.missing", "data.val.missing", "resume.no_trainer_state"}
    (tmp_path / "train").mkdir()
    (tmp_path / "val").mkdir()
    f = V.driver_findings(spark, data=str(tmp_path))
    assert [r.code for r in f.collect()] == ["data.buckets.empty"]
    assert V.exit_code(f).first().exit_code == 1 and "1 error" in V.render(f)
    drift = V.drift_findings(spark.createDataFrame([("arch", "a", "b"), ("config", "", "b"), ("config", "x", "y")], "kind string, stored string, current string"))
    assert sorted((r.code, r.severity) for r in drift.collect()) == [("resume.arch_drift", "ERROR"), ("resume.config_drift", "INFO")]
    lost = V.resume_findings(spark.createDataFrame([("a", None), ("b", "b/1"), ("c", "c/1")], "path string, checkpoint string"), spark.createDataFrame([("c/1",)], "checkpoint string"))
    assert sorted((r.code, r.subject) for r in lost.collect()) == [("resume.resolve_failed", "a"), ("resume.trainer_state_unreadable", "b/1")]
    sizes = spark.createDataFrame([(5, 8), (None, 8), (0, None)], "known int, padded int")
    assert [r.n for r in sizes.select(V.vocab_size(F.col("known"), F.col("padded")).alias("n")).collect()] == [5, 8, 50304] and V.vocab_findings(sizes).count() == 1


def test_all_groups_of_rules_run(spark, tmp_path):
    def broken():
        raise RuntimeError("no")

    found = V.run_all(spark, {"drift": lambda: V.drift_findings(spark.createDataFrame([("arch", "a", "b")], "kind string, stored string, current string")), "tokenizer": broken, "data": lambda: V.driver_findings(spark, data=None)})
    assert [r.code for r in found.collect()] == ["rule.failed", "data.path.empty", "resume.arch_drift"]
    text = V.render(found, {"Model": {"vocabulary": "50304"}})
    assert [x for x in text.split("\n") if not x.startswith(" ")] == ["Model", "Data", "Resume", "Runtime", "3 error, 0 budget, 0 warning, 0 info"]
    with pytest.raises(ValueError, match="nope"):
        V.run_all(spark, {"nope": broken})


def test_estimated_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"text": "abc"}\n' * 3000)
    got = {r.file: (r.bytes, r.lines) for r in jsonl.estimate_lines(spark, str(tmp_path)).collect()}
    assert got == {"a.jsonl": (48000, 3000)}
