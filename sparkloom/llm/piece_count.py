"""Token counts (operator 9): pieces of a sentencepiece BPE model, counted without making ids.

A merge never makes a symbol that is no piece, so a text can be cut wherever no piece has the two neighbouring
characters together. Two cuts hold for every model whose pieces have white space in front only (checked at load):
before a run of spaces that follows another character, and around a line end. Between two cuts lies a pre-token.

1. A pass over the texts gives the distinct pre-tokens of the corpus and how many documents hold each, summed up in the tasks first.
2. The pieces of each distinct pre-token are counted once, by merging its characters; no id is looked up.
3. A second pass makes each document's pre-token frequencies and joins them to the counts. Frequencies of the corpus's commonest pre-tokens, most of
   all, meet a broadcast table of bounded size and are summed on the spot; the rest is shuffled to a join by pre-token. What is left there is not skewed,
   since no pre-token of it is among the commonest.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import materialise

#: Distinct pre-tokens that a task holds at once; beyond it what it has goes out, which changes no sum.
MAX_KEPT = 200_000
#: The broadcast table: at most so many of the commonest pre-tokens, none longer than so many characters (so at most 38 MB).
COMMON, COMMON_CHARS = 300_000, 32
SPACE = "▁"
PRE_TOKEN = re.compile(r"\n| *[^ \n]+| +")


class PieceCounter:
    """Counts the pieces of texts, as many as `SentencePieceProcessor.encode` would make."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        normal = pb.ModelProto.SentencePiece.NORMAL
        self.scores = {p.piece: p.score for p in proto.pieces if p.type == normal}
        plain = proto.trainer_spec.model_type == pb.TrainerSpec.BPE and norm.name == "identity" and not norm.remove_extra_whitespaces and norm.escape_whitespaces
        typed = all(p.type in (1, 2, 3, 6) for p in proto.pieces) and proto.trainer_spec.byte_fallback
        if not plain or not typed or any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p in self.scores):
            raise ValueError("the cuts need a BPE model with byte fallback, identity normalisation and white space in front of pieces only")
        self.prefix = " " if norm.add_dummy_prefix else ""

    def frequencies(self, text: str | None) -> Counter:
        """How often each pre-token stands in the text; a space and its visible form are one character to the model."""
        return Counter(PRE_TOKEN.findall(self.prefix + text.replace(SPACE, " "))) if text else Counter()

    def pieces(self, pre_token: str) -> int:
        """Pieces of a pre-token: neighbours merge, the pair with the best score first, of equal ones the leftmost, until none makes a piece. A character
        that is no piece counts as its bytes."""
        text = pre_token.replace(" ", SPACE)
        scores = self.scores
        if text in scores and len(text) == 1:
            return 1
        part, left, right = list(text), list(range(-1, len(text) - 1)), list(range(1, len(text) + 1))
        right[-1] = -1
        heap = [(-scores[a + b], i, a + b) for i, (a, b) in enumerate(zip(text, text[1:], strict=False)) if a + b in scores]
        heapq.heapify(heap)
        while heap:
            _, i, merged = heapq.heappop(heap)
            j = right[i] if part[i] else -1
            if j < 0 or part[i] + part[j] != merged:
                continue
            part[i], part[j] = merged, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
                longer = merged + part[right[j]]
                if longer in scores:
                    heapq.heappush(heap, (-scores[longer], i, longer))
            if left[i] >= 0:
                longer = part[left[i]] + merged
                if longer in scores:
                    heapq.heappush(heap, (-scores[longer], left[i], longer))
        return sum(1 if p in scores else len(p.encode()) for p in part if p)

    def count(self, text: str | None) -> int:
        return sum(self.pieces(p) * n for p, n in self.frequencies(text).items())


_counters: dict[str, PieceCounter] = {}


def _counter(model_file: str) -> PieceCounter:
    if model_file not in _counters:
        _counters[model_file] = PieceCounter(model_file)
    return _counters[model_file]


def distinct_pre_tokens(texts: DataFrame, model_file: str, max_kept: int = MAX_KEPT) -> DataFrame:
    """(pre_token, docs): each distinct pre-token of the column `text`, and how many rows hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, held = _counter(model_file), Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["pre_token", "docs"])

        for b in batches:
            for text in b.column(0).to_pylist():
                held.update(counter.frequencies(text).keys())
                if len(held) >= max_kept:
                    yield out()
                    held.clear()
        yield out()

    return texts.select("text").mapInArrow(run, "pre_token string, docs long").groupBy("pre_token").agg(F.sum("docs").alias("docs"))


def counted(pre_tokens: DataFrame, model_file: str) -> DataFrame:
    """`pre_tokens` with `pieces`, each counted once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(model_file)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([counter.pieces(p) for p in b.column(0).to_pylist()], pa.int64())], names=["pre_token", "docs", "pieces"])

    return pre_tokens.select("pre_token", "docs").mapInArrow(run, "pre_token string, docs long, pieces long")


def commonest(table: DataFrame, most: int) -> dict[str, int]:
    """Pieces of the commonest pre-tokens of `table`, `most` or fewer: all from that number of documents on at which there are no more. The driver gets how many
    pre-tokens there are by the logarithm of that number, then these pre-tokens."""
    short = table.where(F.length("pre_token") <= COMMON_CHARS).withColumn("scale", F.floor(F.log2("docs") * 16))
    found, least = 0, None
    for scale, n in sorted(map(tuple, short.groupBy("scale").count().collect()), reverse=True):
        found += n
        if found > most:
            break
        least = scale
    if least is None:
        return {}
    best = short.where(F.col("scale") >= least).select("pre_token", "pieces").toArrow()
    return dict(zip(best.column(0).to_pylist(), best.column(1).to_pylist(), strict=True))


def count_pieces(df: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096, common: int = COMMON, max_kept: int = MAX_KEPT) -> DataFrame:
    """A row (id, n_bytes, n_tokens, over_limit) for each row of `df`.

    Null and empty texts have 0 tokens; repeated rows and null ids give a row each; other columns are not read, so
    their names can't clash; an empty table gives an empty one. A very long text is cut in one pass, its pre-tokens
    count once each.
    """
    kind = df.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = df.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    table = materialise(counted(distinct_pre_tokens(slim, model_file, max_kept), model_file), "pre-tokens")
    known = commonest(table, common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, find = _counter(model_file), known.get
        rest = pa.list_(pa.struct([("pre_token", pa.string()), ("n", pa.int64())]))
        for b in batches:
            sums, left = [], []
            for t in b.column(2).to_pylist():
                total, others = 0, []
                for p, n in counter.frequencies(t).items():
                    pieces = find(p)
                    if pieces is None:
                        others.append({"pre_token": p, "n": n})
                    else:
                        total += pieces * n
                sums.append(total)
                left.append(others)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sums, pa.int64()), pa.array(left, rest)], names=["doc_id", "n_bytes", "common", "rest"])

    # Written, so that a row's number is the same on both sides of the join whatever is computed again.
    rows = slim.mapInArrow(run, f"doc_id {kind}, n_bytes long, common long, rest array<struct<pre_token:string,n:long>>")
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    others = rows.select("row", F.explode("rest").alias("r")).select("row", "r.pre_token", "r.n")
    sums = others.join(table.select("pre_token", "pieces"), "pre_token").groupBy("row").agg(F.sum(F.col("pieces") * F.col("n")).alias("others"))
    whole = rows.select("row", "doc_id", "n_bytes", "common").join(sums, "row", "left")
    tokens = F.col("common") + F.coalesce("others", F.lit(0))
    return whole.select("doc_id", "n_bytes", tokens.alias("n_tokens"), (tokens > limit).alias("over_limit"))
