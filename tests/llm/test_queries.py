"""The registered queries on whole small tables: against SQL, the libraries, plain Python, or by held-out accuracy."""

import base64
import hashlib
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers as PT
import pytest

import __spark_entry__ as entry
from sparkloom.llm import langid, queries
from sparkloom.llm.decontam import Settings

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES = queries.queries()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(db):
    return dict(db.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_rows(spark, db, name):
    got = QUERIES[name](spark, SF)
    want = db.sql(queries.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_all_ten_are_registered():
    assert sorted({int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES}) == list(range(1, 11)) and len(QUERIES) == 10
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


def test_language_held_out(spark, db):
    want = dict(db.sql("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op2_language_id"](spark, SF).collect()
    assert len(rows) == len(want)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out]
    assert np.mean([r.lang_pred == want[r.doc_id] for r in held]) > 0.9


@pytest.mark.parametrize(("sf_dir", "recall", "clean_left"), [("/root/testdata/sf0.01", 0.75, 0.98), ("/root/testdata/sf0.1", 0.85, 0.99)])
def test_toxicity_held_out(spark, sf_dir, recall, clean_left):
    """Held-out rows alone: toxic ones found, clean ones left alone. The smaller table has 1 to 4 toxic rows of three of its languages to learn from."""
    want = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf_dir}/labels.parquet'").fetchall())
    held = duckdb.sql(f"SELECT doc_id FROM '{sf_dir}/documents.parquet'").fetchall()
    held = {i for (i,) in held if zlib.crc32(str(i).encode()) % 3 == 1}
    rows = QUERIES["op3_toxicity_neighbours"](spark, sf_dir).drop("evidence").collect()
    for r in rows:
        assert r.held_out == (r.doc_id in held) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1
    own = [(r.predicted, want[r.doc_id]) for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([p for p, y in own if y == 1]) >= recall
    assert np.mean([p == 0 for p, y in own if y == 0]) >= clean_left


def test_tokens_are_the_libraries(spark, docs):
    import sentencepiece
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PT.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sp = sentencepiece.SentencePieceProcessor(model_file=PT.path("piece_bpe_32k.model"))
    for r in QUERIES["op6_byte_bpe_roundtrip"](spark, SF).collect():
        ids = np.array(lib.encode_ordinary(docs[r.doc_id]), "<u4").tobytes()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(docs[r.doc_id].encode()).hexdigest())
    for r in QUERIES["op9_piece_counts"](spark, SF).collect():
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def brute_leaks(docs, items):
    """Documents and items that share enough windows of lower-case words; the test tables have no slots that differ."""
    word, how = re.compile(r"[^\W\d_]+|\d+"), Settings()
    out = set()
    for k, x in items.items():
        w = word.findall(x.lower())
        own = {tuple(w[i : i + how.window]) for i in range(len(w) - how.window + 1)}
        for d, t in docs.items():
            v = word.findall(t.lower())
            hit = {tuple(v[i : i + how.window]) for i in range(len(v) - how.window + 1)} & own
            if len(hit) >= how.coverage * len(own) or len(hit) > how.run - how.window:
                out.add((d, k))
    return out


def test_leaks(spark, db, docs):
    items = dict(db.sql("SELECT item_id, text FROM benchmark").fetchall())
    got = {(r.doc_id, r.item_id) for r in QUERIES["op8_template_decontamination"](spark, SF).collect()}
    assert got == brute_leaks(docs, items)


def test_leaks_with_exchanged_values(spark, tmp_path):
    """The registered query on planted rows: the same question with other numbers and names throughout is found, one whose values contradict each other is not."""
    item = "Every Tuesday the baker Maria sells 40 loaves of bread and 25 rolls so in 3 weeks Maria sells how many loaves and rolls together with 12 cakes"
    other = "The train leaves the old station at noon and reaches the harbour town after 90 minutes so how far is the harbour if it goes 60 km each hour"
    swap = lambda text, pairs: re.sub(r"\w+", lambda m: pairs.get(m[0], m[0]), text)
    talk = "people talk about the weather and the garden while nobody listens to any of it at all "
    planted = {
        1: (talk + item + " " + talk, 1, "exact"),
        2: (talk + swap(item, {"Maria": "Olga", "40": "55", "25": "70", "3": "4", "12": "9"}) + " " + talk, 1, "reparameterised"),
        3: (talk + swap(other, {"90": "80", "60": "45"}), 2, "reparameterised"),
        4: (talk + item.replace("sells 40", "sells 41").replace("Maria sells how", "Olga sells how").replace("in 3 weeks", "in 40 weeks"), None, None),
        5: (talk * 3, None, None),
        6: (None, None, None),
    }
    tables = {"documents": ("doc_id long, text string", [(i, t) for i, (t, _, _) in planted.items()]), "benchmark": ("item_id long, text string", [(1, item), (2, other)])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = {(r.doc_id, r.item_id): r.kind for r in QUERIES["op8_template_decontamination"](spark, str(tmp_path)).collect()}
    assert got == {(i, k): kind for i, (_, k, kind) in planted.items() if k}


def test_secrets_are_those_of_brute_force(spark, docs):
    """The registered query over the whole table, base and entropy spans."""
    from test_operators import brute_base, brute_entropy

    rows = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, SF).collect()}
    assert set(rows) == set(docs)
    kinds = ("assign", "access", "hex", "entropy")
    shown = lambda spans: ",".join(f"{kinds[k]}:{a}:{z}" for a, k, z in sorted(spans))
    for i, text in docs.items():
        base = brute_base(text)
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex] == [sum(x[1] == k for x in base) for k in range(3)]
        assert rows[i].base_sha256 == hashlib.sha256(shown(base).encode()).hexdigest() and rows[i].spans == shown(base + brute_entropy(text))


def brute_shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or ({tuple(words)} if words else set())


def brute_kept(docs, width, percent):
    sets = {i: brute_shingles(t, width) for i, t in docs.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i for i in sets if find(i) == i}


def test_pipeline_stage_by_stage(spark, db, docs):
    """The whole pipeline against plain Python around the same fitted language model."""
    import tiktoken
    from test_operators import brute_base, brute_entropy

    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "MinHash near-dedup", "benchmark decontamination", "secret scans", "byte-level BPE encoding and decoding"]
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(table, learn=langid.learnable("doc_id"))
    ids = sorted(docs)
    pred, score = model.predict([docs[i] for i in ids])
    left = {i: docs[i] for i, p, s in zip(ids, pred, score, strict=True) if p != "und" and s >= model.least}
    kept = brute_kept(left, 5, 80)
    left = {i: t for i, t in left.items() if i in kept}
    leaks = {d for d, _ in brute_leaks(left, dict(db.sql("SELECT item_id, text FROM benchmark").fetchall()))}
    want = {}
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PT.path("byte_bpe_50k.tiktoken"), "rb"))}
    lib = tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in left.items():
        if i in leaks:
            continue
        cover = [False] * len(t)
        for a, _, z in brute_base(t) + brute_entropy(t):
            cover[a:z] = [True] * (z - a)
        clean = "".join("[SECRET]" if c and (k == 0 or not cover[k - 1]) else "" if c else ch for k, (ch, c) in enumerate(zip(t, cover, strict=True)))
        n = np.array(lib.encode_ordinary(clean), "<u4").tobytes()
        want[i] = (len(n) // 4, hashlib.sha256(n).hexdigest(), hashlib.sha256(clean.encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want


def test_pipeline_of_odd_rows(spark):
    """Nulls everywhere, an extra column, repeated rows: all stages run and only the last leaves the columns of documents."""
    import corpus_pipeline

    rows = [(1, "some plain text of words that says little", "en", "s", 41, 9), (1, "some plain text of words that says little", "en", "s", 41, 9), (2, None, None, None, None, None), (3, "", "en", "s", 0, 1), (None, "x y z", None, None, 5, 1), (4, "12 34", "en", "s", 5, 1)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, SF)
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"]
    assert sorted(str(r.doc_id) for r in corpus_pipeline.STAGES[-1][1](spark, d, SF).collect()) == ["1", "None"]


def test_pipeline_of_nothing(spark, tmp_path):
    """Empty documents, empty benchmark: every stage runs and the last has its columns."""
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
