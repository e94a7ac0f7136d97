"""Queries over documents: filters, tokens, windows, order, packing, finished sequences and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.functions import sequences as S
from sparkloom.functions import tokens as T
from sparkloom.operators import order as O
from sparkloom.operators import packing as P
from sparkloom.operators import profile
from sparkloom.operators.windows import WindowSpec, explode_windows, overlap_mask, window_counts, window_lengths
from sparkloom.plans.registry import Registry, table

R = Registry()
L, OV = 128, 32
SPEC = WindowSpec(L, OV)


def _digest(column: str):
    return F.md5(F.array_join(F.col(column).cast("array<string>"), " ").cast("binary"))


# --- base frames, and the same in SQL


def docs(spark: SparkSession, sf_dir: str, instead: Column | None = None) -> DataFrame:
    """Documents as lines of files in buckets: a language is a bucket, a source a file. Lines are numbered by id. A column made of the text
    may stand `instead` of it, so that no text travels; then the source stays."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text" if instead is None else instead, F.col("lang").alias("bucket"), "source")
    d = O.file_index(d, "bucket", "source").withColumn("split", F.when(F.col("doc_id") % 20 == 0, "val").otherwise("train"))
    return d.drop("source") if instead is None else d


def lines(df: DataFrame) -> DataFrame:
    return O.positions(df, ["bucket", "file_idx"], ["doc_id"], "line_num")


DOCS = """docs AS (SELECT doc_id, text, lang AS bucket, (dense_rank() OVER (PARTITION BY lang ORDER BY source) - 1)::INT AS file_idx,
  (row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) - 1)::BIGINT AS line_num,
  CASE WHEN doc_id % 20 = 0 THEN 'val' ELSE 'train' END AS split FROM documents)"""


def word_windows(df: DataFrame, spec: WindowSpec = SPEC, key: list[str] | None = None) -> DataFrame:
    keep = [c for c in df.columns if c != "text"]
    tokens = df.select(*keep, T.word_tokens("text").alias("tokens"))
    w = explode_windows(tokens, spec, eod=F.lit(T.WORD_EOD), key=key)
    return w.withColumn("n_tokens", F.size("tokens").cast("long"))


def _window_sql(draw: str = "FALSE", tok: str = "regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')", eod: str = "'<eod>'", source: str = "docs", name: str = "win") -> str:
    return f"""{name}_t AS (SELECT * EXCLUDE (text), {tok} AS tok, {draw} AS dropped FROM {source}),
{name}_n AS (SELECT *, len(tok) AS n, CASE WHEN dropped THEN 0 ELSE {OV} END AS o, greatest({L} - CASE WHEN dropped THEN 0 ELSE {OV} END, {L // 2}) AS s FROM {name}_t WHERE len(tok) > 0),
{name}_w AS (SELECT *, unnest(range(0, CASE WHEN n < {L} THEN 1 ELSE least((n - 1) // s, 10000) + 1 END))::INT AS window_idx FROM {name}_n),
{name}_b AS (SELECT *, CASE WHEN n < {L} THEN tok ELSE tok[window_idx * s + 1 : window_idx * s + {L}] END AS body, n < {L} OR window_idx * s + {L} >= n AS ends FROM {name}_w),
{name} AS (SELECT * EXCLUDE (tok, dropped, n, o, s, body), (CASE WHEN window_idx > 0 THEN least(o, len(body)) ELSE 0 END)::INT AS overlap_len,
  CASE WHEN ends THEN list_append(body, {eod}) ELSE body END AS tokens FROM {name}_b)"""


WIN = f"WITH {DOCS}, {_window_sql()}"
CODE = "list_transform(string_split(text, ''), lambda c: unicode(c)::INT)"


def code_windows(spark: SparkSession, sf_dir: str, spec: WindowSpec = SPEC) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.codepoint_tokens("text").alias("tokens"))
    return explode_windows(d, spec, eod=F.lit(T.EOD))


CODEWIN = "WITH src AS (SELECT doc_id, text FROM documents WHERE coalesce(text, '') <> ''), " + _window_sql(tok=CODE, eod=f"{T.EOD}::INT", source="src")

# --- filters and tokens


@R.add("SELECT doc_id, length(coalesce(text, ''))::INT AS n FROM documents WHERE length(coalesce(text, '')) >= 200")
def doc_filter_minlen(spark, sf_dir):
    """Unstripped code points, as when shards are made."""
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).where("n >= 200")


@R.add(r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::INT AS n FROM documents WHERE text IS NOT NULL AND length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200")
def doc_filter_stripped(spark, sf_dir):
    """Stripped first, as on the streaming path; a missing text goes."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.length(T.strip("text")).alias("n"))
    return d.where("n >= 200")


@R.add(f"SELECT doc_id, len({CODE})::BIGINT AS n_tokens, md5(array_to_string({CODE}, ' ')) AS tokens_md5 FROM documents WHERE text <> ''")
def codepoint_tokens(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.codepoint_tokens("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.col("t").cast("array<string>"), " ").cast("binary")).alias("tokens_md5"))


@R.add("SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+'))::BIGINT AS n_tokens FROM documents")
def word_tokens_count(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(T.word_tokens("text")).cast("long").alias("n_tokens"))


@R.add("SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z]+'))::BIGINT AS n_tokens FROM documents WHERE text IS NOT NULL AND len(regexp_extract_all(text, '[A-Za-z]+')) >= 10")
def short_token_filter(spark, sf_dir):
    """Documents of ten tokens or more, the streaming path's second filter."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(T.word_tokens("text")).cast("long").alias("n_tokens"))
    return d.where("n_tokens >= 10")


@R.add()
def bpe_token_stats(spark, sf_dir):
    """Documents, tokens and their spread by bucket under the byte-level BPE; the length filter stands below the tokenizer."""
    count = T.count(T.resolve("gpt2"))
    d = docs(spark, sf_dir).where(F.length("text") >= 200).select("bucket", count("text").alias("n"))
    return d.groupBy("bucket").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.avg("n").alias("mean"))


@R.add(f"SELECT doc_id, md5(array_to_string(list_transform({CODE}, lambda t: CASE WHEN t = 32 THEN {T.METASPACE_ID} ELSE t END), ' ')) AS tokens_md5 FROM documents WHERE text <> ''")
def metaspace_repair(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("text <> ''").select("doc_id", T.repair_metaspace(T.codepoint_tokens("text"), 32).alias("t"))
    return d.select("doc_id", F.md5(F.array_join(F.col("t").cast("array<string>"), " ").cast("binary")).alias("tokens_md5"))


_VOCABS = "(SELECT * FROM (VALUES (32000), (50257), (50304), (65535), (65536), (128000)) AS t(vocab))"


@R.add(f"SELECT vocab, (ceil(vocab / 128) * 128)::BIGINT AS padded, CASE WHEN vocab < 65536 THEN 'uint16' ELSE 'uint32' END AS dtype FROM {_VOCABS}")
def padded_vocab_dtype(spark, sf_dir):
    v = spark.createDataFrame([(x,) for x in (32000, 50257, 50304, 65535, 65536, 128000)], "vocab int")
    return v.select("vocab", T.padded_vocab("vocab").alias("padded"), T.shard_dtype("vocab").alias("dtype"))


# --- windows


def _shown(w: DataFrame, *keys: str) -> DataFrame:
    return w.select(*keys, "window_idx", "overlap_len", "ends", F.size("tokens").cast("long").alias("n_tokens"), F.md5(F.array_join(F.col("tokens").cast("array<string>"), " ").cast("binary")).alias("tokens_md5"))


_SHOWN = "window_idx, overlap_len, ends, len(tokens)::BIGINT AS n_tokens, md5(array_to_string(tokens, ' ')) AS tokens_md5"


@R.add(f"{WIN} SELECT doc_id, {_SHOWN} FROM win")
def windows(spark, sf_dir):
    return _shown(word_windows(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


@R.add(f"{WIN} SELECT doc_id, {_SHOWN} FROM win WHERE doc_id IN (SELECT doc_id FROM win_n WHERE n < {L})")
def windows_short(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "text").where(F.size(T.word_tokens("text")) < L)
    return _shown(word_windows(d), "doc_id")


@R.add(f"{WIN} SELECT doc_id, count(*)::BIGINT AS windows, sum(ends::INT)::BIGINT AS with_eod FROM win GROUP BY doc_id")
def windows_eod(spark, sf_dir):
    w = word_windows(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return w.groupBy("doc_id").agg(F.count("*").alias("windows"), F.sum(F.col("ends").cast("long")).alias("with_eod"))


_DRAW = "('0x' || substr(md5(file_idx || ':' || line_num), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE > 0.7::DOUBLE"


@R.add(f"WITH {DOCS}, {_window_sql(draw=_DRAW)} SELECT doc_id, {_SHOWN} FROM win")
def windows_prob_overlap(spark, sf_dir):
    w = word_windows(lines(docs(spark, sf_dir)).drop("split"), WindowSpec(L, OV, keep_share=0.7), key=["file_idx", "line_num"])
    return _shown(w, "doc_id")


@R.add(f"{CODEWIN} SELECT doc_id, {_SHOWN} FROM win")
def windows_codepoint(spark, sf_dir):
    return _shown(code_windows(spark, sf_dir), "doc_id")


@R.add("""WITH n AS (SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]+')) AS n_tokens FROM documents)
SELECT doc_id, n_tokens::BIGINT AS n_tokens, (CASE WHEN n_tokens = 0 THEN 0 WHEN n_tokens < 128 THEN 1 ELSE least(ceil(n_tokens / 96), 10001) END)::BIGINT AS n_windows FROM n""")
def window_counts_only(spark, sf_dir):
    return window_counts(word_tokens_count(spark, sf_dir), SPEC)


@R.add(f"""{WIN}, per AS (SELECT doc_id, count(*) AS w, sum(overlap_len) AS o, sum(len(tokens)) AS t FROM win GROUP BY doc_id)
SELECT count(*)::BIGINT AS docs, sum((w > 1)::INT)::BIGINT AS windowed_docs, sum(w)::BIGINT AS windows, avg(w) AS windows_per_doc, (sum(o)::DOUBLE / sum(t)::DOUBLE) AS overlap_fraction FROM per""")
def window_stats(spark, sf_dir):
    return profile.window_stats(word_windows(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id")


# --- order, slots, batches


@R.add(f"WITH {DOCS} SELECT doc_id, bucket, file_idx, (row_number() OVER (PARTITION BY bucket, file_idx ORDER BY md5('42:' || file_idx || ':' || doc_id), doc_id) - 1)::BIGINT AS doc_pos FROM docs")
def doc_shuffle_md5(spark, sf_dir):
    return O.shuffled_positions(docs(spark, sf_dir).select("doc_id", "bucket", "file_idx"), ["bucket", "file_idx"], ["doc_id"])


@R.add()
def doc_shuffle_legacy(spark, sf_dir):
    return O.legacy_positions(docs(spark, sf_dir).select("doc_id", "bucket", "file_idx"), ["bucket", "file_idx"], "file_idx", ["doc_id"])


@R.add(f"""WITH {DOCS}, f AS (SELECT DISTINCT bucket, file_idx FROM docs), n AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS n FROM f),
r AS (SELECT *, CASE WHEN n // 2 = 0 THEN 1 ELSE least(file_idx // greatest(n // 2, 1), 1) END AS rank FROM n)
SELECT bucket, file_idx, rank::INT AS rank FROM r""")
def file_range_shards(spark, sf_dir):
    """Contiguous ranges of files for two ranks, the remainder to the last."""
    f = docs(spark, sf_dir).select("bucket", "file_idx").distinct()
    n = F.count("*").over(Window.partitionBy("bucket"))
    return f.select("bucket", "file_idx", O.range_slot("file_idx", n, 2).alias("rank"))


@R.add(f"WITH {DOCS} SELECT (line_num % 4)::INT AS slot, count(*)::BIGINT AS lines, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM docs GROUP BY 1")
def line_stride_shards(spark, sf_dir):
    d = lines(docs(spark, sf_dir).drop("text")).withColumn("slot", O.line_slots("line_num", 2, 2))
    return d.groupBy("slot").agg(F.count("*").alias("lines"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@R.add(f"WITH {DOCS} SELECT bucket, file_idx, (row_number() OVER (PARTITION BY bucket ORDER BY md5('7:' || bucket || ':' || file_idx), file_idx) - 1)::BIGINT AS file_pos FROM (SELECT DISTINCT bucket, file_idx FROM docs)")
def file_shuffle(spark, sf_dir):
    f = docs(spark, sf_dir).select("bucket", "file_idx").distinct()
    keyed = f.withColumn("k", O.shuffle_key(7, "bucket", "file_idx"))
    return O.positions(keyed, ["bucket"], ["k", "file_idx"], "file_pos").drop("k")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a shard's windows, from counts of words: the windows themselves are not made."""
    d = docs(spark, sf_dir).select("bucket", "file_idx", F.size(T.word_tokens("text")).cast("long").alias("n"))
    return profile.shard_tokens(d, SPEC)


SHARDS = "shards AS (SELECT bucket, file_idx, sum(len(tokens))::BIGINT AS tokens FROM win GROUP BY bucket, file_idx)"


@R.add(f"""WITH RECURSIVE {DOCS}, {_window_sql()}, {SHARDS},
o AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY tokens DESC, file_idx DESC) AS r FROM shards),
go(bucket, r, file_idx, slot, loads) AS (
  SELECT DISTINCT bucket, 0::BIGINT, -1, -1, [0, 0, 0, 0]::BIGINT[] FROM o
  UNION ALL
  SELECT o.bucket, o.r, o.file_idx, list_position(g.loads, list_min(g.loads)) - 1,
    list_transform(g.loads, lambda x, i: CASE WHEN i = list_position(g.loads, list_min(g.loads)) THEN x + o.tokens ELSE x END)
  FROM go g JOIN o ON o.bucket = g.bucket AND o.r = g.r + 1)
SELECT bucket, file_idx, slot::INT AS slot FROM go WHERE r > 0""")
def slot_assignment_lpt(spark, sf_dir):
    return O.assign_longest_first(shard_sizes(spark, sf_dir), 4)


_CLAMPS = [(4, 16, 2), (4, 6, 2), (8, 3, 4), (0, 8, 2), (2, 1, 1), (1, 100, 8)]


@R.add("SELECT requested, least_shards, world, (CASE WHEN least_shards < world THEN NULL WHEN requested = 0 THEN 0 ELSE least(requested, greatest(1, least_shards // world)) END)::INT AS workers FROM (VALUES " + ", ".join(map(str, _CLAMPS)) + ") AS t(requested, least_shards, world)")
def worker_clamp(spark, sf_dir):
    c = spark.createDataFrame(_CLAMPS, "requested int, least_shards int, world int")
    return c.withColumn("workers", O.clamp_workers(F.col("requested"), F.col("least_shards"), F.col("world")))


@R.add(f"""WITH {DOCS}, i AS (SELECT split, (line_num % 4) AS slot, doc_id, row_number() OVER (PARTITION BY split, line_num % 4 ORDER BY doc_id) - 1 AS ord FROM docs),
b AS (SELECT *, ord // 8 AS batch_idx, count(*) OVER (PARTITION BY split, slot, ord // 8) AS c FROM i)
SELECT split, slot::INT AS slot, batch_idx::BIGINT AS batch_idx, count(*)::BIGINT AS items, max(doc_id) AS last_doc FROM b WHERE split = 'val' OR c = 8 GROUP BY ALL""")
def batch_plan(spark, sf_dir):
    """Batches of eight by slot: training drops a part batch, validation keeps it."""
    d = lines(docs(spark, sf_dir).drop("text")).withColumn("slot", O.line_slots("line_num", 2, 2))
    d = O.positions(d, ["split", "slot"], ["doc_id"], "ord")
    train = O.batches(d.where("split = 'train'"), ["split", "slot"], "ord", 8, True)
    both = train.unionByName(O.batches(d.where("split = 'val'"), ["split", "slot"], "ord", 8, False))
    return both.groupBy("split", "slot", "batch_idx").agg(F.count("*").alias("items"), F.max("doc_id").alias("last_doc"))


# --- packing


def ordered_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows by place after the shuffle of their file; lengths only, from counts of words."""
    d = docs(spark, sf_dir).select("bucket", "file_idx", "doc_id", F.size(T.word_tokens("text")).cast("long").alias("n_tokens"))
    w = window_lengths(d, SPEC).drop("overlap_len")
    return P.with_buffers(O.shuffled_positions(w, ["bucket", "file_idx"], ["doc_id", "window_idx"]))


_ORDERED = """ordered AS (SELECT bucket, file_idx, doc_id, window_idx, len(tokens)::BIGINT AS n_tokens,
  row_number() OVER (PARTITION BY bucket, file_idx ORDER BY md5('42:' || file_idx || ':' || doc_id || ':' || window_idx), doc_id, window_idx) - 1 AS doc_pos FROM win),
items AS (SELECT *, doc_pos // 256 AS buffer_idx, row_number() OVER (PARTITION BY bucket, file_idx, doc_pos // 256 ORDER BY n_tokens DESC, doc_pos) AS r FROM ordered)"""
_FFD = f"""ffd(bucket, file_idx, buffer_idx, r, doc_pos, n, seq, free) AS (
  SELECT DISTINCT bucket, file_idx, buffer_idx, 0::BIGINT, -1::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM items
  UNION ALL
  SELECT i.bucket, i.file_idx, i.buffer_idx, i.r, i.doc_pos, least(i.n_tokens, {L}), p.p,
    CASE WHEN p.p > len(g.free) THEN list_append(g.free, {L} - least(i.n_tokens, {L})) ELSE list_transform(g.free, lambda x, k: CASE WHEN k = p.p THEN x - least(i.n_tokens, {L}) ELSE x END) END
  FROM ffd g JOIN items i ON i.bucket = g.bucket AND i.file_idx = g.file_idx AND i.buffer_idx = g.buffer_idx AND i.r = g.r + 1,
  LATERAL (SELECT coalesce(nullif(list_position(list_transform(g.free, lambda x: x >= least(i.n_tokens, {L})), true), 0), len(g.free) + 1) AS p) p)"""
PACKED = f"WITH RECURSIVE {DOCS}, {_window_sql()}, {_ORDERED}, {_FFD}"


@R.add(f"{PACKED} SELECT bucket, file_idx, buffer_idx::BIGINT AS buffer_idx, doc_pos::BIGINT AS doc_pos, (seq - 1)::INT AS seq_idx FROM ffd WHERE r > 0")
def pack_ffd(spark, sf_dir):
    return P.pack_ffd(ordered_windows(spark, sf_dir), L, group=["bucket", "file_idx"]).drop("place", "n_tokens")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pack_ffd(ordered_windows(spark, sf_dir).select("bucket", "file_idx", "doc_pos", "buffer_idx", "n_tokens"), L, group=["bucket", "file_idx"])


@R.add(f"""{PACKED}, s AS (SELECT bucket, file_idx, buffer_idx, seq, sum(n) AS content, count(*) AS w FROM ffd WHERE r > 0 GROUP BY ALL)
SELECT bucket, sum(w)::BIGINT AS windows, count(*)::BIGINT AS sequences, sum(content)::BIGINT AS tokens, sum(content)::DOUBLE / (count(*) * {L})::DOUBLE AS efficiency FROM s GROUP BY bucket""")
def pack_summary(spark, sf_dir):
    """Windows, sequences, tokens and packing efficiency by bucket."""
    p = _packed(spark, sf_dir)
    s = p.groupBy("bucket", "file_idx", "buffer_idx", "seq_idx").agg(F.sum("n_tokens").alias("content_len"), F.count("*").alias("w"))
    return s.groupBy("bucket").agg(F.sum("w").alias("windows"), F.count("*").alias("sequences"), F.sum("content_len").alias("tokens"), P.efficiency(s, L).alias("efficiency"))


@R.add(f"""{PACKED}, s AS (SELECT bucket, file_idx, buffer_idx, seq, sum(n) AS content FROM ffd WHERE r > 0 GROUP BY ALL)
SELECT (sum(content)::DOUBLE / (count(*) * {L})::DOUBLE) AS content_over_slots, (1 - (sum({L} - content)::DOUBLE / (count(*) * {L})::DOUBLE)) AS one_minus_padding,
  min(content)::BIGINT AS emptiest, sum((content = {L})::INT)::BIGINT AS full_sequences FROM s""")
def pack_efficiency(spark, sf_dir):
    p = _packed(spark, sf_dir)
    s = p.groupBy("bucket", "file_idx", "buffer_idx", "seq_idx").agg(F.sum("n_tokens").alias("content_len"))
    return s.agg(P.efficiency(s, L).alias("content_over_slots"), (1 - F.sum(L - F.col("content_len")) / (F.count("*") * L)).alias("one_minus_padding"), F.min("content_len").alias("emptiest"), F.sum((F.col("content_len") == L).cast("long")).alias("full_sequences"))


@R.add(f"{WIN}, {_ORDERED} SELECT bucket, file_idx, doc_pos::BIGINT AS seq_idx, least(n_tokens, {L})::BIGINT AS content FROM ordered")
def nopack_sequences(spark, sf_dir):
    w = P.pack_none(ordered_windows(spark, sf_dir))
    return w.select("bucket", "file_idx", "seq_idx", F.least("n_tokens", F.lit(L)).alias("content"))


@R.add()
def pack_bestfit(spark, sf_dir):
    """The streaming packer over four slots; windows of L + 1 tokens never fit and are counted as dropped."""
    d = docs(spark, sf_dir).select("bucket", "file_idx", "doc_id", F.size(T.word_tokens("text")).cast("long").alias("n_tokens"))
    d = lines(d).select(O.line_slots("line_num", 2, 2).alias("slot"), "doc_id", "n_tokens")
    w = window_lengths(d, WindowSpec.streaming(L, OV)).drop("overlap_len")
    placed = P.pack_best_fit(w, L, group=["slot"], doc="doc_id")
    all_w = w.groupBy("slot").agg(F.count("*").alias("windows"), F.sum((F.col("n_tokens") > L).cast("long")).alias("too_long"))
    seqs = placed.groupBy("slot").agg(F.countDistinct("seq_idx").alias("sequences"), F.count("*").alias("placed"))
    return all_w.join(seqs, "slot", "left")


_BOUNDS = ", ".join(f"({i}, {a}, {z})" for i, (a, z) in enumerate(P.bin_bounds(L)) if a <= z)


@R.add(f"""{WIN}, b AS (SELECT * FROM (VALUES {_BOUNDS}) AS t(bin, a, z)), c AS (SELECT len(tokens) AS n, count(*) AS windows FROM win GROUP BY 1)
SELECT n::BIGINT AS n_tokens, windows::BIGINT AS windows, coalesce((SELECT min(bin) FROM b WHERE n BETWEEN a AND z), 63)::INT AS bin FROM c""")
def length_bins(spark, sf_dir):
    w = word_windows(table(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("n_tokens").agg(F.count("*").alias("windows"))
    return w.withColumn("bin", P.length_bin("n_tokens", L))


# --- finished sequences


@R.add()
def stream_sequences(spark, sf_dir):
    """Sequences of the streaming packer over code points, finished: mask from overlaps, windows numbered for attention, one row a slot and sequence."""
    name, spec = ["bucket", "source", "doc_id"], WindowSpec.streaming(L, OV)
    own = lines(docs(spark, sf_dir, F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_tokens")).drop("split"))
    w = window_lengths(own.select(*name, O.line_slots("line_num", 2, 2).alias("slot"), "n_tokens"), spec).drop("overlap_len")
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("bucket"), "source", "doc_id", "text")
    placed = P.pack_best_fit(w, L, group=["slot"], keep=name[:2], doc="doc_id")
    seqs = P.assemble_code_points(d, placed, spec, doc=name, seq=["slot", "seq_idx"], length=L, eod=T.EOD)
    done = S.finalize(seqs, L, repeated="repeated", eod=T.EOD, pad=T.PAD, columns=("input_ids", "labels"))
    return done.select("slot", "seq_idx", "content_len", "n_windows", "distinct_windows", _digest("input_ids").alias("ids_md5"), _digest("labels").alias("labels_md5"))



def finished(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """No-pack sequences over code points: a window is a sequence."""
    w = code_windows(spark, sf_dir).select("doc_id", "window_idx", "overlap_len", "tokens")
    return S.finalize(w, L, ids="tokens", overlap="overlap_len", eod=T.EOD, pad=T.PAD, columns=columns)


_SEQ = f"""{CODEWIN}, f AS (SELECT doc_id, window_idx, overlap_len, least(len(tokens), {L}) AS content,
  list_concat(tokens, list_transform(range({L}), lambda x: {T.PAD}::INT))[1:{L}] AS ids FROM win),
g AS (SELECT *, list_transform(ids, lambda x, i: CASE WHEN i > content THEN -100 WHEN i > 1 AND ids[i - 1] = {T.EOD} THEN -100 WHEN i <= overlap_len THEN -100 ELSE x END) AS labels,
  list_transform(ids, lambda x, i: (i <= content)::INT) AS mask, list_transform(ids, lambda x, i: CASE WHEN i <= content THEN i - 1 ELSE 0 END) AS pos,
  list_transform(ids, lambda x, i: CASE WHEN i <= content THEN len(list_filter(ids[1:i - 1], lambda y: y = {T.EOD})) ELSE 0 END) AS docs FROM f)"""


def _sequence_query(name: str, column: str, sql_column: str) -> None:
    def run(spark, sf_dir):
        return finished(spark, sf_dir, column).select("doc_id", "window_idx", _digest(column).alias("digest"), F.col("content_len").cast("long").alias("content"))

    R.add(f"{_SEQ} SELECT doc_id, window_idx, md5(array_to_string({sql_column}, ' ')) AS digest, content::BIGINT AS content FROM g", name)(run)


for _name, _column, _sql in (("seq_input_ids", "input_ids", "ids"), ("seq_attention_mask", "attention_mask", "mask"), ("seq_labels", "labels", "labels"), ("seq_position_ids", "position_ids", "pos"), ("seq_doc_ids", "doc_ids", "docs")):
    _sequence_query(_name, _column, _sql)


@R.add(f"{_SEQ} SELECT doc_id, window_idx, sum(c * (c + 1) // 2)::BIGINT AS pairs FROM (SELECT doc_id, window_idx, d, count(*) AS c FROM (SELECT doc_id, window_idx, unnest(docs[1:content]) AS d FROM g) GROUP BY ALL) GROUP BY ALL")
def attention_pairs(spark, sf_dir):
    """Allowed (query, key) pairs of each sequence under causal attention inside documents."""
    return finished(spark, sf_dir, "input_ids").select("doc_id", "window_idx", S.allowed_pairs(F.col("input_ids"), F.col("content_len"), T.EOD).alias("pairs"))


@R.add(f"""{_SEQ} SELECT count(*)::BIGINT AS sequences, sum(len(list_filter(labels[2:], lambda x: x <> -100)))::BIGINT AS trained, sum(len(list_filter(labels[2:], lambda x: x = {T.EOD})))::BIGINT AS eod_trained,
  sum(len(list_filter(ids[2:content], lambda x: x = {T.EOD})) - len(list_filter(labels[2:], lambda x: x = {T.EOD})))::BIGINT AS eod_masked FROM g""")
def shift_targets(spark, sf_dir):
    """End marks as targets after the shift by one, trained and masked."""
    return profile.label_census(finished(spark, sf_dir, "input_ids", "labels"), T.EOD)


@R.add(f"""{PACKED}, x AS (SELECT f.bucket, f.file_idx, f.buffer_idx, f.seq, f.r, w.tokens, w.overlap_len FROM ffd f JOIN ordered o USING (bucket, file_idx, doc_pos) JOIN win w ON w.doc_id = o.doc_id AND w.window_idx = o.window_idx WHERE f.r > 0),
y AS (SELECT *, list_transform(tokens[1:{L}], lambda t, i: CASE WHEN i <= overlap_len THEN 1 ELSE 0 END) AS rep FROM x),
z AS (SELECT bucket, file_idx, buffer_idx, seq, flatten(list(tokens[1:{L}] ORDER BY r)) AS ids, flatten(list(rep ORDER BY r)) AS rep FROM y GROUP BY ALL)
SELECT bucket, file_idx, buffer_idx::BIGINT AS buffer_idx, (seq - 1)::INT AS seq_idx, md5(array_to_string(list_transform(ids, lambda x, i: CASE WHEN i > 1 AND ids[i - 1] = '<eod>' THEN '-' WHEN rep[i] = 1 THEN '-' ELSE x END), ' ')) AS labels_md5, len(ids)::BIGINT AS content FROM z""")
def packed_labels(spark, sf_dir):
    """Labels of first-fit sequences over words, ignored targets shown as a dash."""
    order = ordered_windows(spark, sf_dir)
    placed = P.pack_ffd(order.drop("doc_id", "window_idx"), L, group=["bucket", "file_idx"]).drop("n_tokens")
    # Tokens join once, when all places are known.
    name = ["bucket", "file_idx", "doc_id", "window_idx"]
    placed = placed.join(order.select(*name, "buffer_idx", "doc_pos"), ["bucket", "file_idx", "buffer_idx", "doc_pos"]).drop("doc_pos")
    w = word_windows(docs(spark, sf_dir).drop("split")).select(*name, "tokens", overlap_mask().alias("repeated"))
    seqs = P.assemble(w, placed, name, ["bucket", "file_idx", "buffer_idx", "seq_idx"], length=L)
    zipped = F.arrays_zip(F.concat(F.array(F.lit("")), "ids").alias("b"), F.col("ids").alias("x"), F.col("repeated").alias("r"))
    shown = F.transform(F.slice(zipped, F.lit(1), F.size("ids")), lambda t: F.when((t["b"] == T.WORD_EOD) | (t["r"] == 1), "-").otherwise(t["x"]))
    return seqs.select("bucket", "file_idx", "buffer_idx", "seq_idx", F.md5(F.array_join(shown, " ").cast("binary")).alias("labels_md5"), F.size("ids").cast("long").alias("content"))


# --- profiles


@R.add(f"""{WIN}, r AS (SELECT bucket, file_idx, count(*)::BIGINT AS docs_read, sum((length(coalesce(text, '')) < 200)::INT)::BIGINT AS docs_skipped FROM docs GROUP BY ALL),
k AS (SELECT bucket, file_idx, count(*)::BIGINT AS windows, sum(len(tokens))::BIGINT AS tokens FROM win WHERE doc_id IN (SELECT doc_id FROM docs WHERE length(coalesce(text, '')) >= 200) GROUP BY ALL)
SELECT bucket, file_idx, docs_read, docs_skipped, coalesce(windows, 0)::BIGINT AS windows, coalesce(tokens, 0)::BIGINT AS tokens FROM r LEFT JOIN k USING (bucket, file_idx)""")
def shard_stats(spark, sf_dir):
    d = docs(spark, sf_dir).select("bucket", "file_idx", F.length(F.coalesce("text", F.lit(""))).alias("chars"), F.size(T.word_tokens("text")).cast("long").alias("n"))
    return profile.shard_stats(d, SPEC, 200)


@R.add(f"""{WIN}, t AS (SELECT split, bucket, file_idx, sum(len(tokens)) AS tokens FROM win GROUP BY ALL)
SELECT coalesce(split, 'TOTAL') AS split, coalesce(bucket, 'TOTAL') AS bucket, count(*)::BIGINT AS shards, sum(tokens)::BIGINT AS tokens FROM t GROUP BY ROLLUP (split, bucket)""")
def bucket_rollup(spark, sf_dir):
    d = docs(spark, sf_dir).select("split", "bucket", "file_idx", F.size(T.word_tokens("text")).cast("long").alias("n"))
    return profile.bucket_rollup(profile.shard_tokens(d, SPEC, by=["split", "bucket", "file_idx"]))


@R.add(f"""{WIN}, c AS (SELECT bucket, len(tokens) AS n, len(list_filter(tokens, lambda x: x = '<eod>')) AS e, (tokens[-1] = '<eod>')::INT AS last FROM win)
SELECT bucket, count(*)::BIGINT AS windows, sum(n)::BIGINT AS tokens, sum(e)::BIGINT AS eods, sum(last)::BIGINT AS ending, sum(e - last)::BIGINT AS interior, sum(e)::DOUBLE / sum(n)::DOUBLE AS eod_fraction FROM c GROUP BY bucket""")
def eod_census(spark, sf_dir):
    return profile.eod_census(word_windows(docs(spark, sf_dir).drop("split")), T.WORD_EOD, ["bucket"])


@R.add(f"{WIN} SELECT bucket, count(*)::BIGINT AS windows FROM win WHERE len(tokens) >= 8 AND tokens[-1] = '<eod>' GROUP BY bucket")
def eod_windows(spark, sf_dir):
    """Windows that end in an end mark and have eight tokens or more."""
    w = word_windows(docs(spark, sf_dir).drop("split")).where((F.size("tokens") >= 8) & (F.element_at("tokens", -1) == T.WORD_EOD))
    return w.groupBy("bucket").agg(F.count("*").alias("windows"))


@R.add(f"""{_SEQ}, h AS (SELECT * FROM g ORDER BY doc_id, window_idx LIMIT 500)
SELECT count(*)::BIGINT AS sequences, sum(len(list_filter(labels[2:], lambda x: x <> -100)))::BIGINT AS trained, sum(len(list_filter(labels[2:], lambda x: x = {T.EOD})))::BIGINT AS eod_trained,
  sum(len(list_filter(ids[2:content], lambda x: x = {T.EOD})) - len(list_filter(labels[2:], lambda x: x = {T.EOD})))::BIGINT AS eod_masked FROM h""")
def label_census(spark, sf_dir):
    """The same over the first 500 sequences: a report of the first n items."""
    return profile.label_census(finished(spark, sf_dir, "input_ids", "labels").orderBy("doc_id", "window_idx").limit(500), T.EOD)
