"""Each operator on small tables: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import base64
import collections
import hashlib
import math
import os
import random
import re

import numpy as np
import public_tokenizers as PT
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Row
from pyspark.sql import functions as F

from sparkloom.llm import bpe_codec, chat_tree, decontam, langid, minhash, piece_count, secret_scan, topk, toxicity, warc
from sparkloom.llm.common import drop_rows, materialise, running_total
from sparkloom.llm.components import components
from sparkloom.llm.shingles import shingle_sets

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")
RANKS, PIECES = PT.path("byte_bpe_50k.tiktoken"), PT.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "é", "日本語 テキスト", "a" * 5000, "word " * 3000, "▁▁ x▁y", "<s> </s> <|endoftext|>", "\x00\x1c\x85", "🎉🎉", "it's 'll THE\r\n\ttab"]


def odd_docs(spark):
    """Odd texts, some twice, a null id, and columns whose names the operators use themselves."""
    rows = [(i, t, f"s{i % 2}") for i, t in enumerate(ODD)] + [(3, ODD[3], "s"), (None, "null id", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(1) for c in ("n_tokens", "kept", "ids", "label", "value", "cls", "spans", "score", "_o")})


def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


# --- 1


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"leaf": F.lit(1), "node": F.lit(2)})


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "<|text|>", ""]), st.one_of(st.text(), st.lists(st.sampled_from(["\\", "<|turn|>", "<|end|>", "[INST]", "<", "|", "<|", "x"])).map("".join))), max_size=4))
def test_template_is_reversible(said):
    formatted = "".join(chat_tree.format_turn(r, t)[0] for r, t in said)
    assert chat_tree.parse_turns(formatted) == said
    for r, t in said:
        assert not any(c in chat_tree.escape(t) for c in chat_tree.CONTROL)


def test_forest(spark):
    rows = [(c, k, r, t) for c in range(40) for k, (r, t) in enumerate([("user", "hi"), ("assistant", f"a{c % 4}"), ("user", "</s>[INST] ok [/INST]"), ("assistant", f"b{c % 8}")][: 2 + c % 3])]
    rows += [(100, 0, None, None), (100, 1, "assistant", ""), (None, 0, "user", "x"), (None, 0, "user", "x"), (101, None, "assistant", "z"), (101, 0, "user", "y")]
    f = chat_tree.build(turns(spark, rows))
    nodes = {r.node: r for r in f.nodes.collect()}
    leaves = {r.leaf: r.chain for r in f.leaves.collect()}
    # Every segment once; segments tile the stream; a child's ancestors are exactly its intervals; positions follow the path.
    placed = sorted(nodes.values(), key=lambda n: n.start)
    at = 0
    for n in placed:
        assert n.start == at
        at += n.length
    assert len({(n.parent, n.segment) for n in placed}) == len(placed)
    for chain in leaves.values():
        above = []
        for x in chain:
            n = nodes[x]
            assert n.position == sum(nodes[a].length for a in above)
            want = {p for a in above for p in range(nodes[a].start, nodes[a].start + nodes[a].length)}
            assert {p for s in n.attend for p in range(s["from"], s["to"])} == want
            above.append(x)
    # Depth first: a subtree is one run of the stream.
    for chain in leaves.values():
        for x in chain:
            inside = [n.start for n in placed if any(x in c[: c.index(n.node)] for c in leaves.values() if n.node in c)]
            if inside:
                block = [n.start for n in placed if nodes[x].start < n.start <= max(inside)]
                assert sorted(inside) == block
    got = {r.conv_id: r for r in chat_tree.read_back(f).collect()}
    by = collections.defaultdict(list)
    for c, k, r, t in rows:
        by[c].append(((-1 if k is None else k), r or "", t or ""))
    assert set(got) == set(by)
    for c, said in by.items():
        said.sort()
        trained = "".join(t for _, r, t in said if r == "assistant")
        assert got[c].n_turns == len(said) and got[c].loss_chars == len(trained)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in said).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(trained.encode()).hexdigest()


def test_forest_of_nothing(spark):
    assert chat_tree.read_back(chat_tree.build(turns(spark, []))).count() == 0


# --- 2


def lang_docs(spark, n=400):
    words = {"aa": "lorem ipsum dolor sit amet".split(), "bb": "zwölf boxkämpfer jagen viktor".split(), "cc": "queça você não vão".split()}
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices(words[k], k=12)), k) for i in range(n) for k in [sorted(words)[i % 3]]]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language_id(spark):
    d = lang_docs(spark)
    m = langid.fit(d, learn=langid.learnable("doc_id"))
    again = langid.fit(d, learn=langid.learnable("doc_id"))
    assert np.array_equal(m.table, again.table)
    got = langid.classify(d, m).join(d, "doc_id").collect()
    assert np.mean([r.lang_pred == r.lang for r in got]) > 0.99 and all(0 <= r.score <= 1 for r in got)
    odd = langid.classify(odd_docs(spark), m).collect()
    assert len(odd) == odd_docs(spark).count()
    for r in odd:
        if r.doc_id is not None:
            t = ODD[r.doc_id]
            assert (r.lang_pred == "und") == (not t or not any(c.isalpha() for c in t))
            assert r.rejected or r.lang_pred != "und"


def test_language_id_without_labels(spark):
    m = langid.fit(empty_docs(spark))
    assert m.langs == [] and {r.lang_pred for r in langid.classify(odd_docs(spark), m).collect()} == {"und"}
    assert langid.classify(empty_docs(spark), m).count() == 0


def test_folded_table_is_the_average_and_the_softmax():
    """Prediction by the folded table against embeddings averaged and put through the softmax one text at a time."""
    rng, how = np.random.default_rng(3), langid.Settings(buckets=256, steps=200)
    texts = [" ".join(rng.choice(w, 9)) for w in (["lorem", "ipsum", "dolor"], ["zwölf", "jagen", "viktor"]) for _ in range(30)]
    sparse = []
    for t in texts:
        found, times = np.unique(langid.subwords([t], how.widths, how.buckets)[1], return_counts=True)
        sparse.append((found, times.astype(np.float32)))
    y = np.repeat([0, 1], 30)
    emb, w, bias = langid.train(sparse, y, np.arange(60), 2, how, np.random.default_rng(1))
    seen = np.zeros(how.buckets)
    seen[np.unique(np.concatenate([s[0] for s in sparse[:40]]))] = 1
    heat = 1.7
    model = langid.Model(["a", "b"], emb @ w / heat, bias / heat, 0.0, how, seen)
    pred, score = model.predict([*texts, "unter", "日本 1"])
    for i, t in enumerate([*texts, "unter", "日本 1"]):
        own = langid.subwords([t], how.widths, how.buckets)[1]
        z = (np.mean([emb[b] for b in own], axis=0) @ w + bias) / heat
        p = np.exp(z) / np.exp(z).sum()
        assert pred[i] == "ab"[int(p.argmax())] and abs(score[i] - p.max() * np.mean([seen[b] for b in own])) < 1e-5
    assert np.mean([a == "ab"[b] for a, b in zip(pred, y, strict=False)]) > 0.95


def test_unlearned_text_is_rejected_and_learned_text_stays_with_noisy_labels(spark):
    d = lang_docs(spark)
    other = ["Η γλώσσα αυτή δεν είναι γνωστή και κανείς δεν τη διάβασε ποτέ", "これは学習していない言語の文章です", "этот язык никогда не встречался в обучении", "qxzjk wvqzx jjqkx zzxqv kqxjw"]
    m = langid.fit(d)
    pred, score = m.predict(other)
    assert m.least > 0 and (score < m.least).all()
    rows = d.collect()
    langs = sorted({r.lang for r in rows})
    wrong = F.element_at(F.array(*map(F.lit, langs)), (F.array_position(F.array(*map(F.lit, langs)), F.col("lang")) % len(langs) + 1).cast("int"))
    noisy = d.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 20 == 0, wrong).otherwise(F.col("lang")))
    for model in (m, langid.fit(noisy)):
        assert np.mean(model.predict([r.text for r in rows])[1] >= model.least) > 0.95


def test_held_out_language_does_not_teach(spark):
    d = lang_docs(spark)
    noisy = d.withColumn("lang", F.when(langid.held_out("doc_id"), "zz").otherwise(F.col("lang")))
    assert "zz" not in langid.fit(noisy, learn=langid.learnable("doc_id")).langs


def test_prediction_is_independent_of_company(spark):
    m = langid.fit(lang_docs(spark))
    texts = [t for t in ODD if t] + ["lorem ipsum", "não vão"]
    alone = [m.predict([t]) for t in texts]
    pred, score = m.predict(texts)
    assert pred == [p[0] for p, _ in alone] and np.allclose(score, [s[0] for _, s in alone], atol=1e-9)


# --- 3


def toxic_tables(spark, n=600):
    rng = random.Random(2)
    plain = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=40)
        if i % 5 == 0:
            words += rng.choices(["vile", "rotten", "badword"], k=3)
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity(spark):
    docs, labels = toxic_tables(spark)
    m = toxicity.fit(docs, labels, learn=~toxicity.held_out("doc_id"))
    got = toxicity.classify(docs, m).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in got]) > 0.98
    held = {r.doc_id for r in docs.where(toxicity.held_out("doc_id")).collect()}
    assert not held & {e.doc_id for r in got for e in r.evidence}
    # Every text with known words has neighbours, and both labels are among them.
    assert all(r.evidence for r in got) and {e.toxic for r in got for e in r.evidence} == {0, 1}
    odd = toxicity.classify(odd_docs(spark), m).collect()
    assert len(odd) == odd_docs(spark).count() and all(r.predicted == 0 for r in odd)
    assert toxicity.classify(empty_docs(spark), m).count() == 0


def test_toxicity_with_ids_of_any_type_and_repeated_ids(spark):
    docs, labels = toxic_tables(spark)
    name = lambda d: d.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    more = docs.where("doc_id < 50").withColumn("text", F.concat("text", F.lit(" more")))
    both = name(docs.unionByName(more).unionByName(docs.where("doc_id < 50")))
    m, again = (toxicity.fit(d, name(labels)) for d in (both, both.repartition(5)))
    assert len(m.ids) == 650 and m.ids == again.ids and np.array_equal(m.curve, again.curve)
    got = toxicity.classify(both, m).collect()
    assert len(got) == 700 and all(e.doc_id.startswith("d") for r in got for e in r.evidence)
    assert np.mean([r.predicted == (int(r.doc_id[1:]) % 5 == 0) for r in got]) > 0.98


def test_ranges_and_evidence_without_neighbours(spark):
    start, n = np.array([5, 0, 9, 2]), np.array([2, 0, 1, 3])
    assert toxicity._ranges(start, n).tolist() == toxicity._spread(start, start + n)[0].tolist() == [5, 6, 9, 2, 3, 4]
    assert toxicity._ranges(start[:0], n[:0]).tolist() == []
    # Batches with and without neighbours, and a model without an index, whose ids are text.
    d = spark.createDataFrame([(str(i), t) for i, t in enumerate(["bad nasty word", "fine kind word", "", None, "zzz"] * 3)], "doc_id string, text string").coalesce(1)
    labels = spark.createDataFrame([(str(i), int(i % 5 == 0)) for i in range(15) if i % 5 < 2], "doc_id string, toxic int")
    for marks, held in ((labels, {0, 1}), (labels.limit(0), set())):
        for r in toxicity.classify(d, toxicity.fit(d, marks)).collect():
            assert bool(r.evidence) == (int(r.doc_id) % 5 in held) and all(int(e.doc_id) % 5 == 1 - e.toxic for e in r.evidence)


def test_toxicity_without_examples(spark):
    docs, labels = toxic_tables(spark, 20)
    m = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.predicted for r in toxicity.classify(docs, m).collect()} == {0}
    assert toxicity.fit(docs, labels.limit(0)).index is None


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1))
def test_nearest_are_exact(seed):
    rng = np.random.default_rng(seed)
    n, terms = int(rng.integers(1, 60)), 12
    vectors = []
    for _ in range(n):
        t = np.flatnonzero(rng.random(terms) < 0.3)
        w = rng.integers(1, 4, len(t)).astype(float)
        vectors.append((t, w / np.linalg.norm(w) if len(w) else w))
    ix = toxicity.Index(vectors, rng.random(n) < 0.5, terms, 4, first=1, full=int(rng.integers(1, 9)))
    q = np.flatnonzero(rng.random(terms) < 0.4)
    if not len(q):
        return
    w = np.ones(len(q)) / math.sqrt(len(q))
    rows, sims = ix.nearest(q, w, 5)
    dense = np.zeros(n)
    for row, i in enumerate(ix.origin):
        full = np.zeros(terms)
        full[vectors[i][0]] = vectors[i][1]
        dense[row] = (full[q] * w).sum()
    want = sorted((-round(s, 12), r) for r, s in enumerate(dense) if s > 0)[:5]
    assert [(-round(s, 12), r) for r, s in zip(rows.tolist(), sims, strict=True)] == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40) | st.text(st.characters(max_codepoint=255), max_size=40))
def test_words_by_table_are_those_of_the_pattern(s):
    assert toxicity.words_of(s) == toxicity.WORD.findall(s.lower())


def test_words_of_every_character_of_latin_1():
    for c in map(chr, range(256)):
        assert toxicity.words_of(f"A{c}b {c}") == toxicity.WORD.findall(f"A{c}b {c}".lower()), c
    assert toxicity.words_of(None) == toxicity.words_of("") == []


def test_unpacked_lists_are_read_once_for_many_texts_and_scores_ignore_company(spark, monkeypatch):
    docs, labels = toxic_tables(spark, 300)
    m = toxicity.fit(docs, labels)
    texts = [r.text for r in docs.orderBy("doc_id").collect()] + [None, "", "zzz", "vile", "w1 w1 w2 — w3"]
    alone = [m.score(t) for t in texts]
    sizes, whole = [], toxicity.Index.unpacked_scores
    monkeypatch.setattr(toxicity.Index, "unpacked_scores", lambda self, vectors: (sizes.append(len(vectors)), whole(self, vectors))[1])
    for order in (range(len(texts)), range(len(texts) - 1, -1, -1)):
        sizes.clear()
        got = list(m.scores(texts[i] for i in order))
        assert sizes == [toxicity.AT_ONCE] * (len(texts) // toxicity.AT_ONCE) + [len(texts) % toxicity.AT_ONCE]
        for i, (score, (rows, sims)) in zip(order, got, strict=True):
            assert (score, rows.tolist(), sims.tolist()) == (alone[i][0], alone[i][1][0].tolist(), alone[i][1][1].tolist())


# --- 4


def test_warc(spark, tmp_path):
    long = "x" * 99 + "é"
    pages = [(1, "http://a/é b?q=1#f", "<p>\r\n\r\nWARC/1.1\r\n</p>"), (2, None, None), (3, "http://a", ""), (4, "x\r\ny", long), (5, "http://b", long), (6, "http://c", "short"), (7, "http://d", "short"), (8, "u", "ends with cr\r"), (9, "u", long), (9, "u", long), (None, "n", long), (10, "v", "\r\n" * 300), (11, "w", "z" * 200_000)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"copies": F.lit(1), "_key": F.lit(2)})
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_digests(d).collect()), key=str)
    want = []
    for i, _, h in pages:
        b = (h or "").encode()
        again = h == long and i is not None and i > 4
        want.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", 4 if again else None))
    assert got == sorted(want, key=str)
    warc.write_archives(d, str(tmp_path / "w"))
    whole = warc.assemble(warc.read_archives(spark, str(tmp_path / "w"))).collect()
    by = {r.capture_id.split(":")[3].rsplit("-", 1)[0]: r for r in whole}
    assert by["1"].response.payload == pages[0][2].encode() and by["1"].request.http_head.startswith("GET /")
    assert by["9"].copies == 2 and by["9"].response.type == "revisit" and by["9"].metadata.fields.startswith("page-id: 9")
    assert warc.archive_digests(d.limit(0)).count() == 0


def test_warc_parser_rejects_broken_files():
    good = [("f", x) for x in b"WARC/1.1\r\nContent-Length: 3\r\n\r\na\r\r\n\r\n".split(b"\r\n")[:-1]]
    with pytest.raises(ValueError, match="block"):
        list(warc.parse_records(good))
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.parse_records([("f", b"WARC/1.1"), ("f", b"Content-Length: 9"), ("f", b""), ("f", b"abc")]))
    with pytest.raises(ValueError, match="version"):
        list(warc.parse_records([("f", b"nonsense")]))


# --- 5

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_shingles(text, width):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbB é\t\n\x0b\x1c", max_size=40)), max_size=6), st.integers(1, 5))
def test_shingle_sizes(texts, width):
    got = shingle_sets(texts, width)
    want = [brute_shingles(t, width) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i in range(len(texts)):
        for j in range(i):
            assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def brute_components(docs, width, percent):
    sets = {i: brute_shingles(t, width) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def copies(rng, n):
    words = [f"t{i}" for i in range(400)]
    passage = rng.choices(words, k=40)
    docs = []
    for i in range(n):
        kind = rng.random()
        if docs and kind < 0.5:
            own = rng.choice(docs)[1].split()
            for _ in range(rng.randint(0, 3)):
                own[rng.randrange(len(own))] = rng.choice(words)
        else:
            own = rng.choices(words, k=rng.randint(1, 90))
            if kind > 0.75:
                own = passage + own
        docs.append((i, " ".join(own)))
    return docs


@pytest.mark.parametrize(("seed", "width", "percent", "block"), [(1, 3, 85, 1024), (2, 5, 80, 8)])
def test_near_duplicates_are_those_of_brute_force(spark, seed, width, percent, block):
    docs = copies(random.Random(seed), 250) + [(900, None), (901, ""), (902, "one"), (903, "One"), (904, "A b"), (905, "word " * 4000), (906, "word " * 4001)]
    d = spark.createDataFrame([*docs, (903, "One"), (None, "one")], "doc_id long, text string").withColumns({"rep": F.lit(1), "low": F.lit(2), "component_id": F.lit(3)})
    got = minhash.near_duplicates(d, minhash.NearDup(width, percent, block=block)).collect()
    assert len(got) == len(docs) + 2
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got if r.doc_id is not None} == brute_components(docs, width, percent)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]


def test_exact_mode_and_its_bounds(spark):
    """Sets longer than a sketch, many of them hard at the threshold: the exact mode is brute force, the sketches miss none of them here."""
    rng = random.Random(9)
    words = [f"v{i}" for i in range(3000)]
    docs = []
    for g in range(12):
        base = rng.choices(words, k=300)
        for c in range(6):
            own = list(base)
            for at in rng.sample(range(300), 2 + c + g % 3):
                own[at] = f"x{g}_{c}_{at}"
            docs.append((len(docs), " ".join(own)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components(docs, 3, 85)
    for how in (minhash.NearDup.exact(3, 85), minhash.NearDup(3, 85)):
        assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(d, how).collect()} == want
    assert 12 < sum(kept for _, _, kept in want.values()) < len(docs)


def test_estimates_at_the_threshold_let_pairs_pass():
    """Recall of the two steps that chance takes part in, on pairs of long sets whose similarity is the threshold itself."""
    how, rng = minhash.NearDup(3, 85), np.random.default_rng(5)
    met = passed = 0
    for _ in range(400):
        both = rng.integers(-(2**62), 2**62, 850)
        a, b = (np.sort(np.concatenate([both, rng.integers(-(2**62), 2**62, 75)])) for _ in range(2))
        met += len(np.intersect1d(a[: how.k], b[: how.k])) >= how.shared
        at = np.array([0, len(b), len(a) + len(b), len(a) + len(b) + 3])
        assert minhash.similar(a, np.concatenate([b, a, b[:3]]), at, how).tolist() == [True, True, False]
        k = how.estimate_k
        ok, sure = minhash.likely(a[:k], len(a), np.concatenate([b[:k], a[:k], b[:3]]), np.array([0, k, 2 * k, 2 * k + 3]), np.array([len(b), len(a), 3]), how)
        passed += ok.tolist() == [True, True, False] and not sure[0]
    assert (met, passed) == (400, 400)


def test_large_groups_of_copies(spark):
    """5,000 near copies of one text that differ from each other, 5,000 exact ones, and one passage in 500 further texts."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(2000)]
    base, passage = rng.choices(words, k=200), rng.choices(words, k=40)
    docs = [(i, " ".join([*base[:195], *[f"y{i}_{j}" for j in range(2)], *base[197:]])) for i in range(5000)]
    docs += [(5000 + i, "the same words stand here again and again in every row") for i in range(5000)]
    docs += [(10_000 + i, " ".join([*passage, *rng.choices(words, k=60)])) for i in range(500)]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(d, minhash.NearDup(3, 85)).collect()}
    assert {got[i] for i in range(5000)} == {0} and {got[i] for i in range(5000, 10_000)} == {5000}
    assert all(got[i] == i for i in range(10_000, 10_500))


def test_one_row_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(60)]
    near, other = " ".join([*base[:59], "x"]), "quite another text that shares nothing with those before it"
    rows = [(1, " ".join(base)), (1, " ".join(base)), (2, near), (2, other), (3, near), (None, near), (4, None), (4, ""), (1, near), (5, other)]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "kept": F.lit(2), "_p": F.lit(3)})
    left = minhash.drop_near_duplicates(d)
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    # Id 2 stays with its own text, since that text's group has no smaller id; of id 1 one row stays.
    assert left.columns == d.columns and len(got) == 5
    assert [i for i, _ in got] == [1, 2, 4, 4, None] and got[1][1] == other and got[4][1] == near
    assert minhash.drop_near_duplicates(d.limit(0)).count() == 0


def texts_sent(frame):
    """How many rows with a text the plan of `frame`, which has run, has sent through shuffles."""
    seen, left = 0, [frame._jdf.queryExecution().executedPlan()]
    while left:
        node = left.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec" and any(node.output().apply(i).name() == "text" for i in range(node.output().size())):
                seen += node.metrics().apply("shuffleRecordsWritten").value()
            left += [node.children().apply(i) for i in range(node.children().size())]
    return seen


def test_texts_that_stay_are_not_shuffled(spark):
    """Also when the dropped rows are too many to broadcast; and the rows are the same."""
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{j}" for j in range(5000)], k=40)), "s") for i in range(2000)]
    rows += [(2000 + i, rows[i][1], "copy") for i in range(50)] + [rows[7], rows[7], (None, rows[9][1], "s"), (None, None, "s")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    usual = sorted(minhash.drop_near_duplicates(d).collect(), key=str)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        d = materialise(d, "texts")
        left = minhash.drop_near_duplicates(d)
        got = sorted(left.collect(), key=str)
        fewer = drop_rows(d, materialise(d.where("doc_id >= 2000 OR doc_id IS NULL").select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_row")), "gone"), "doc_id", "text")
        assert fewer.count() == 2002
        fewer.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == usual == sorted([Row(doc_id=i, text=t, source=s) for i, t, s in [*rows[:2000], *rows[-2:]]], key=str)
    assert texts_sent(left) < 400 and texts_sent(fewer) < 200


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(empty_docs(spark)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(40)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


# --- 6 and 9


def test_byte_bpe_is_the_library(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    lib = tiktoken.Encoding("own", pat_str=PT.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = odd_docs(spark)
    rows = bpe_codec.decode(bpe_codec.encode(d, RANKS, PT.PATTERN), RANKS, PT.PATTERN).collect()
    brief = {r.doc_id: r for r in bpe_codec.round_trip(d, RANKS, PT.PATTERN).collect()}
    assert len(rows) == d.count()
    for r in rows:
        text = "null id" if r.doc_id is None else ODD[r.doc_id] or ""
        ids = np.array(lib.encode_ordinary(text), "<u4").tobytes()
        assert bytes(r.ids) == ids and bytes(r.decoded) == text.encode() and r.n_tokens == len(ids) // 4
        assert brief[r.doc_id].ids_sha256 == hashlib.sha256(ids).hexdigest() and brief[r.doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe_codec.encode(empty_docs(spark), RANKS, PT.PATTERN).count() == 0


def test_small_dictionaries_change_nothing():
    codec, big = bpe_codec.ByteBpe(RANKS, PT.PATTERN, max_kept=3), bpe_codec.ByteBpe(RANKS, PT.PATTERN)
    texts = [*ODD, "the quick brown fox", "the quick"] * 2
    assert [codec.encode(t) for t in texts] == [big.encode(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" ▁\nab</s>"))))
def test_counts_are_the_library(text):
    import sentencepiece

    own = test_counts_are_the_library.__dict__.setdefault("own", [piece_count.PieceCounter(PIECES), sentencepiece.SentencePieceProcessor(model_file=PIECES)])
    assert own[0].count(text) == len(own[1].encode(text))


def test_piece_counts(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    for more in ({}, {"common": 2, "max_kept": 3}):  # nearly all by the join; tasks that hold few pre-tokens
        got = piece_count.count_pieces(odd_docs(spark), PIECES, limit=10, **more).collect()
        assert len(got) == odd_docs(spark).count()
        for r in got:
            text = "null id" if r.doc_id is None else ODD[r.doc_id] or ""
            assert (r.n_bytes, r.n_tokens) == (len(text.encode()), len(sp.encode(text))) and r.over_limit == (r.n_tokens > 10)
    assert piece_count.count_pieces(empty_docs(spark), PIECES).count() == 0


def test_each_pre_token_is_counted_once(spark):
    d = spark.createDataFrame([(i, f"the cat {i % 3} sat\non the mat") for i in range(60)], "doc_id long, text string").repartition(4)
    got = {r.pre_token: (r.docs, r.pieces) for r in piece_count.counted(piece_count.distinct_pre_tokens(d, PIECES, max_kept=2), PIECES).collect()}
    assert got[" the"] == (60, 1) and got["\n"][0] == 60 and got[" 1"][0] == 20 and len(got) == 9


def test_long_pre_tokens_are_quick():
    import sentencepiece

    text = "ab" * 50_000 + "日本é" * 2_000
    assert piece_count.PieceCounter(PIECES).count(text) == len(sentencepiece.SentencePieceProcessor(model_file=PIECES).encode(text))


# --- 7


def brute_top(rows, k, every):
    """Every sound row is a candidate of every other, also where ids repeat."""
    sound = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (q, a) in enumerate(sound):
        if q % every == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for n, (i, b) in enumerate(sound) if n != at)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def top(d, k, **more):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(d, k, **more).collect())


@pytest.mark.parametrize(("n", "candidates", "queries"), [(300, 64 * 50, 3 * 50), (3, topk.CANDIDATES, topk.QUERIES)])
def test_top_k(spark, n, candidates, queries):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(0, 0.2, 40).astype("f4").tolist()) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(20)]
    rows += [(1001, None), (1002, [1.0, None]), (1003, [float("nan")] * 40), (1004, [float("inf")] * 40), (1050, []), (1051, [0.5] * 50), (0, rows[0][1]), (2, rows[1][1]), (None, rows[1][1])]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "score": F.lit(3)})
    assert top(d, 5, candidates=candidates, queries=queries) == brute_top(rows, 5, 50)


def test_top_k_of_nothing_and_of_large_values(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    many = [(50 * i, [float(2**20 + i), -1.5]) for i in range(8)]
    huge = [(0, [1.0, 0.0]), (1, [1e8, 0.0]), (2, [2e8, 3.0]), (3, [-2e8, 3.0]), (4, [3e13, 7.0])]
    twice = [(0, [1.0]), (1, [1.0]), (1, [3.0])]
    for rows in (many, huge, twice):
        d = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
        assert top(d, 3) == brute_top(rows, 3, 50)
    beyond = spark.createDataFrame([(0, [1e12]), (1, [1e12])], "vec_id long, embedding array<float>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(beyond).collect()


@settings(max_examples=100, deadline=None)
@given(st.integers(0, 2**32 - 1), st.sampled_from([1, 300, 2**20, 2**27]))
def test_blocks_are_exact(seed, size):
    """Few values, so many ties; numbers of every kind of sum."""
    rng = np.random.default_rng(seed)
    q, c = (np.floor(rng.integers(-3, 4, (int(n), 37)) * float(size)) for n in rng.integers(1, 30, 2))
    ids = rng.integers(0, 20, len(c))
    i, j, s = topk.block_top(np.arange(len(q)), q, np.arange(len(c)), ids, c, 4, step=5)
    got = [sorted((-int(x), int(ids[b])) for a, b, x in zip(i, j, s, strict=True) if a == r) for r in range(len(q))]
    want = [sorted((-sum(int(x) * int(y) for x, y in zip(q[r], c[b], strict=True)), int(ids[b])) for b in range(len(c)) if b != r)[:4] for r in range(len(q))]
    assert got == want


def test_pruning_leaves_few(spark):
    """On the given vectors, fewer than half of the pairs are left before the last step, and fewer still after it."""
    got = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    v = np.floor(np.array([r.embedding for r in got]) * 256)
    at, live = np.arange(len(v)), []
    q = np.array([r.vec_id % 50 == 0 for r in got])
    topk.block_top(at[q], v[q], at, at, v, 5, live=live)
    assert len(live) == 4 and live[-2] < 0.5 and live[-1] < 0.1


# --- 8


def template_tables(spark):
    item = "On Monday morning Alice drove 120 km to Boston in 3 hours and then Alice walked 5 km more before the shop closed at 9"
    changed = item.replace("Alice", "Robert").replace("120", "75").replace("Boston", "Denver")
    broken = item.replace("Alice drove", "Robert drove")
    filler = "nothing here is like the question that stands above at all and so on "
    rows = [(1, filler + item), (2, filler + changed + " " + filler), (3, filler + broken), (4, filler * 3), (5, None), (6, ""), (7, "tiny item"), (8, (filler * 2000) + item), (1, filler + item), (None, item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"hash": F.lit(1), "item_id": F.lit(2), "at": F.lit(3)})
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (5, item)], "item_id long, text string")
    return docs, items


@pytest.mark.parametrize("bits", [decontam.Settings.filter_bits, 1])
def test_decontamination(spark, bits):
    docs, items = template_tables(spark)
    got = {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(docs, items, decontam.Settings(filter_bits=bits)).collect()}
    # Document 3 exchanges one of two equal names: its slots contradict each other.
    assert got == {(d, i): k for d, k in ((1, "exact"), (2, "reparameterised"), (8, "exact"), (None, "exact")) for i in (1, 5)} | {(7, 4): "exact"}
    left = decontam.drop_contaminated(docs, items)
    assert left.columns == docs.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "6"]
    shared = docs.where("doc_id IN (1, 4)").withColumn("doc_id", F.lit(1).cast("long"))  # one id, one leaked text and one clean one
    assert [r.text for r in decontam.drop_contaminated(shared, items).collect()] == [r.text for r in docs.where("doc_id = 4").collect()]
    assert decontam.contaminated(docs.limit(0), items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_template_codes():
    t = decontam.canonical(["On Monday Alice paid 3.5 km, 12 and 1,000.5 dollars. Bob went", "", None, "x1y A B"])
    shown = [{8: "N", 16: "NAME", 24: "UNIT"}.get(int(c), t.joined[a:z].lower()) for c, a, z in zip(t.codes, t.starts, t.ends, strict=True)]
    assert shown == ["on", "NAME", "NAME", "paid", "N", "UNIT", "N", "and", "N", "UNIT", "bob", "went", "x", "N", "y", "a", "b"]
    assert np.diff(t.begins).tolist() == [12, 0, 0, 5]
    same = decontam.canonical(["ÉTÉ été Été"]).codes
    assert len(set(same[:2].tolist())) == 1


LEAK = "On Monday morning Alice drove 120 km to Boston in 3 hours and then Alice walked 5 km more before the shop closed at 9"
FILL = "nothing here is like the question that stands above at all and so on "


def leaks(spark, docs, items):
    tables = [spark.createDataFrame(list(enumerate(x)), f"{c} long, text string") for c, x in (("doc_id", docs), ("item_id", items))]
    return {(r.doc_id, r.item_id): r.kind for r in decontam.contaminated(*tables).collect()}


def test_decontamination_whatever_the_case_and_names_that_begin_sentences(spark):
    item = "Natalia sold 48 clips to friends in April. Natalia then sold half as many clips in May. Natalia now has 72 clips."
    docs = [FILL + LEAK.lower() + " " + FILL, FILL + LEAK.upper(), FILL.strip() + ". " + item.replace("Natalia", "Robert").replace("48", "50")]
    assert leaks(spark, docs, [LEAK, item]) == {(0, 0): "exact", (1, 0): "exact", (2, 1): "reparameterised"}


def test_decontamination_over_moved_parts(spark):
    words = LEAK.split()
    short = "a very short question asks how many of the red apples are still in this old basket today please"
    york = "In the morning Paris is where the old man goes by train and later the same man leaves Paris for good with two friends"
    moved = [" ".join([*words[:12], "just", *words[12:]]), " ".join(short.split()[:9] + ["big"] + short.split()[9:]), " ".join(short.split()[:9] + short.split()[10:]), york.replace("Paris", "New York")]
    apart = " ".join(short.split()[10:] + FILL.split() * 3 + short.split()[:8])
    backward = " ".join(short.split()[10:] + short.split()[:9])
    got = leaks(spark, [*[FILL + m + " " + FILL for m in moved], apart, FILL, backward], [LEAK, short, york])
    assert got == {(0, 0): "exact", (1, 1): "exact", (2, 1): "exact", (3, 2): "reparameterised"}


def test_decontamination_of_items_with_few_words(spark):
    items = ["What is 15 plus 27?", "Alice paid 12 dollars", "3 5 7 11 13 17 19 23 29 31", "Alice Bob Carol Dave Erin Frank", "7"]
    docs = [f"{FILL.strip()}. {x} {FILL}" for x in items[:4]] + ["what is 15 plus 28", "Alice paid 13 dollars", "3 5 8 11 14 17 20 23 30 31"]
    assert leaks(spark, docs, items) == {(i, i): "exact" for i in range(4)} | {(2, 4): "exact"}


def test_alignments_taken_together_agree_in_slots():
    def window(shift, at, item, doc):
        return {"shift": shift, "item_at": at, "item_windows": 17, "tokens": 24, "size": 8, "wide": False, "slots": [f"0 num {doc}"], "item_slots": [f"0 num {item}"], "fixed": []}

    first = [window(0, k, 1, 7) for k in range(5)]
    assert decontam.judge(first + [window(1, k, 1, 7) for k in range(12, 17)], decontam.Settings())[:2] == (True, 10)
    assert decontam.judge(first + [window(1, k, 1, 8) for k in range(12, 17)], decontam.Settings())[:2] == (False, 5)


def test_consistent_slots():
    pairs = lambda *p: ((i, [a], [b]) for i, (a, b) in enumerate(p))
    assert decontam.consistent(pairs(("0 num 1", "0 num 1"))) == (True, True)
    assert decontam.consistent(pairs(("0 num 1", "0 num 7"), ("2 num 1", "2 num 7"))) == (True, False)
    assert decontam.consistent(pairs(("0 num 1", "0 num 7"), ("2 num 1", "2 num 8"))) == (False, False)
    assert decontam.consistent(pairs(("0 num 1", "0 num 7"), ("2 num 2", "2 num 7"))) == (False, False)


# --- 10


def brute_base(text):
    out = []
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
    out += [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


PARTS = ["token", "secret=", "PassWord", "api_key", "APIKEY", ": ", " = ", "'", '"', "abc", "abcdef", "AKIA", "AKIA" + "Z9" * 9, "deadbeef" * 3, "deadbeef" * 2, " ", "é", "Ab3" * 9, "toKen", "K", "ſecret=abcdefg"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=9).map("".join))
def test_base_spans(text):
    assert secret_scan.Scanner().base(text) == brute_base(text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdef0123", min_size=0, max_size=60), st.integers(2, 24))
def test_window_entropy(s, w):
    def plain(x):
        return -sum(c / len(x) * math.log2(c / len(x)) for c in collections.Counter(x).values())

    got = list(secret_scan.window_entropies(s, w))
    assert np.allclose(got, [plain(s[i : i + w]) for i in range(len(s) - w + 1)], atol=1e-9)


def test_a_run_longer_than_a_window_of_one_character():
    key = "a1b2c3d4e5f6a1b2c3d4e5f6"
    for text in (key + "0" * 30, "0" * 100 + key, "a1" + "b" * 60):
        assert secret_scan.Scanner().entropy(text) == brute_entropy(text)


SETS = {"hex": ("0123456789abcdefABCDEF", 24, 3.0), "key": (None, 20, 3.75), "lower": ("abcdefghijklmnopqrstuvwxyz0123456789", 24, 3.6), "upper": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 24, 3.6)}


def brute_entropy(text):
    """Every window of every class, each with its entropy counted anew; windows that touch are one span."""
    def known(part):
        return [m.span() for m in re.finditer(r"(?<![0-9a-f])[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}(?![0-9a-f])|[a-z0-9]*example[a-z0-9]*|abcdefghij[k-z]*|0123456789", part, re.IGNORECASE)]

    marked = [False] * (len(text) + 1)
    joined = set()
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        gone = {m.start() + i for a, z in known(m[0]) for i in range(a, z)}
        for name, (chars, n, least) in SETS.items():
            for i in range(m.start(), m.end() - n + 1):
                w = text[i : i + n]
                if gone & set(range(i, i + n)) or (chars and set(w) - set(chars)):
                    continue
                digits, low, up = (sum(f(c) for c in w) for f in (str.isdigit, str.islower, str.isupper))
                holds = {"hex": digits and digits < n, "key": digits and low and up, "lower": digits >= 3 and low >= 3, "upper": digits >= 3 and up >= 3}[name]
                if holds and -sum(c / n * math.log2(c / n) for c in collections.Counter(w).values()) >= least - 1e-12:
                    joined.add((i, i + n))
    out = []
    for a, z in sorted(joined):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return [(a, 3, z) for a, z in out]


KEYS = ["x9Kq2LmP7vTz4RbW8nYc3", "3ax6xnjp29jd6fds4gc373sgvjxteol0", "Q4ZT7XK2M9B1VN8RW3PY5HJ6", "deadBEEF0123cafe4567f00d", "123e4567-e89b-12d3-a456-426614174000", "wordsjoinedwithoutanydigits", "0123456789", "example", "/", "_", "-", " ", "é", "abcdefghijklm"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(KEYS), max_size=7).map("".join))
def test_entropy_spans(text):
    assert secret_scan.Scanner().entropy(text) == brute_entropy(text)


def test_keys_of_one_case_and_keys_beside_known_words():
    own = secret_scan.Scanner()
    for key in KEYS[:4]:
        for text, at in ((f"key {key} end", 4), (f"example/{key}", 8), (f"{key}_0123456789", 0)):
            (a, _, z), *more = own.entropy(text)
            # A slash, dash or underline beside the key is a key character too.
            assert not more and at - 1 <= a <= at and at + len(key) <= z <= at + len(key) + 1, text
    for text in KEYS[4:7]:
        assert own.entropy(f"is {text} ok") == []


def test_secrets(spark):
    key = "x9Kq2LmP7vTz4RbW8nYc3"
    rows = [(1, f"key {key} end"), (2, "id 123e4567-e89b-12d3-a456-426614174000 ok"), (3, f"token = '{key}'"), (4, None), (5, ""), (6, "thelongestwordthatanyonewouldwrite"), (7, "é" * 50_000 + key), (3, f"token = '{key}'")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"spans": F.lit(1), "n_hex": F.lit(2)})
    got = {r.doc_id: r for r in secret_scan.scan(d).collect()}
    assert got[1].spans == f"entropy:4:{4 + len(key)}" and got[2].spans == "" == got[6].spans == got[4].spans == got[5].spans
    assert got[3].n_assign == 1 and got[3].spans.startswith("assign:0:") and got[7].spans == f"entropy:50000:{50000 + len(key)}"
    assert got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secret_scan.scan(d).count() == 8 and secret_scan.scan(d.limit(0)).count() == 0
    clean = {r.doc_id: r.text for r in secret_scan.redact(d).collect()}
    assert clean[1] == "key [SECRET] end" and clean[3] == "[SECRET]'" and clean[4] is None and clean[6] == rows[5][1]


# --- shared


def test_running_total(spark):
    rows = [(i, (i * 7) % 5) for i in range(500)]
    random.Random(1).shuffle(rows)
    got = {r.k: r.before for r in running_total(spark.createDataFrame(rows, "k long, n long"), ["k"], "n", "before", "t").collect()}
    at = 0
    for k, n in sorted(rows):
        assert got[k] == at
        at += n




def test_very_long_texts(spark):
    """A text of two million characters, whole, beside a short one, through every operator that reads texts."""
    import sentencepiece

    rng = random.Random(8)
    words = [f"{a}{b}" for a in "the and for with from".split() for b in ("", "ing", "er", "ly", "ness")]
    long = " ".join(rng.choices(words, k=280_000)) + " token = 'x9Kq2LmP7vTz4RbW8nYc3' " + LEAK + " tail" * 40_000
    assert len(long) > 1_900_000
    d = spark.createDataFrame([(1, long), (2, "short and plain"), (3, long + " end")], "doc_id long, text string")
    model = langid.fit(lang_docs(spark))
    assert [r.lang_pred for r in langid.classify(d, model).orderBy("doc_id").collect()] == model.predict([long, "short and plain", long + " end"])[0]
    tox = toxicity.fit(*toxic_tables(spark, 100))
    assert [r.score for r in toxicity.classify(d, tox).orderBy("doc_id").collect()][0] == tox.score(long)[0]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(d, minhash.NearDup(3, 85)).collect()}
    assert got == {i: (len(brute_shingles(t, 3)), 1 if i != 2 else 2) for i, t in ((1, long), (2, "short and plain"), (3, long + " end"))}
    assert {r.doc_id: r.decoded_sha256 for r in bpe_codec.round_trip(d, RANKS, PT.PATTERN).collect()}[1] == hashlib.sha256(long.encode()).hexdigest()
    items = spark.createDataFrame([(1, LEAK)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.contaminated(d, items).collect()) == [1, 3]
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert {r.doc_id: r.n_tokens for r in piece_count.count_pieces(d, PIECES).collect()}[1] == len(sp.encode(long))
    spans = {r.doc_id: r.spans for r in secret_scan.scan(d).collect()}
    at = long.index("token = ")
    assert spans[2] == "" and spans[1] == spans[3] == f"assign:{at}:{at + 30},entropy:{at + 9}:{at + 30}"


def test_texts_stay_where_they_are_until_their_sets_are_made(spark):
    rows = [(i % 400, f"word{i % 400} and some more words {i % 400} here") for i in range(800)] + [(None, "a b c d e f"), (7, "another text of the same id as before"), (8, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    how = minhash.NearDup(3, 85)
    classes = minhash.sketches(d, how).where("cls IS NOT NULL AND doc_id IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("rep"))
    wanted = classes.where("rep < 50").select("rep", "cls")
    got = minhash.full_sets(d, how, wanted)
    assert sorted(r.cls for r in got.collect()) == sorted(r.cls for r in wanted.collect()) and got.count() == 51
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.index("Join") < plan.index("MapInArrow")


def test_open_members_go_to_a_pivot_once_and_without_it(spark):
    """Lists 1 and 2 have one pivot and the same members, list 3 nothing but a pair that has met, list 4 members that are all linked."""
    rows = [(v, c, 10, 3, 9, 10) for v in (1, 2) for c in (7, 8, 9)] + [(3, c, 10, 2, 6, 10) for c in (5, 6)] + [(4, c, 10, 3, 6, 10) for c in (1, 2, 6)]
    lists = spark.createDataFrame(rows, "value long, cls long, n long, size long, pivot long, pivot_n long")
    labels = spark.createDataFrame([(1, 1), (2, 1)], "node long, label long")
    got = minhash.open_members(lists, labels).select("pivot", "cls", "label", "n", "size").collect()
    assert sorted(map(tuple, got)) == [(9, 7, 7, 10, 2), (9, 8, 8, 10, 2)]


def test_lists_hold_numbers_of_classes_only(spark):
    d = spark.createDataFrame([(f"id{i}", f"w{i} and some words that all share here {i % 3}") for i in range(9)] + [("id0", "w0 and some words that all share here 0")], "doc_id string, text string")
    how = minhash.NearDup(3, 85)
    classes = minhash.numbered(minhash.sketches(d, how))
    assert sorted((r.rep, r.copies) for r in classes.collect()) == [("id0", 2)] + [(f"id{i}", 1) for i in range(1, 9)]
    lists = minhash.inverted_lists(classes, how)
    assert lists.count() > 0 and {kind for _, kind in lists.dtypes} == {"bigint"}


def test_pairs_of_short_sets_are_settled_in_their_block():
    how, rng = minhash.NearDup(3, 85), np.random.default_rng(2)
    base = np.sort(rng.integers(-(2**62), 2**62, 100))
    near, far = np.sort(np.concatenate([base[:92], base[-8:] + 1])), np.sort(np.concatenate([base[:91], base[-9:] + 1]))
    long = np.sort(rng.integers(-(2**62), 2**62, 400))

    def members(sets, at):
        return minhash.Members([at + i for i in range(len(sets))], [at + i for i in range(len(sets))], np.array([len(s) for s in sets]), [s[: how.estimate_k] for s in sets], np.array([len(s) > how.estimate_k for s in sets]))

    # 92 of 108 is 0.852, 91 of 109 is 0.835; sketches of long sets are not sure.
    assert minhash.tile_pairs(members([base, long], 0), members([near, far, long], 10), how) == {(0, 10, True), (1, 12, False)}


def test_sets_that_no_pair_needs_stay(spark):
    sets = spark.createDataFrame([(i, 3, [i, i + 1, i + 2]) for i in range(2000)], "cls long, n long, set array<long>")
    pairs = spark.createDataFrame([(1, 2), (2, 1999)], "a long, b long")
    got = {r.cls for r in minhash._some(sets, pairs, ["a", "b"]).collect()}
    assert {1, 2, 1999} <= got and len(got) < 10
