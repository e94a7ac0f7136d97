"""Byte-level BPE encoding and decoding (operator 6) through a sentencepiece model that is serialised here.

The model has no trainer behind it: each rank of a byte-level vocabulary becomes a piece whose bytes are mapped to
the letters U+0100 to U+01FF, scored by its negative rank, so that the merge with the lowest rank goes first;
normalisation is the identity and no white space is added or escaped. A text is cut by the vocabulary's pattern, each
match is mapped to letters and encoded, and ids are turned back by the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct pre-tokens that a worker keeps ids of; beyond it the older half goes, which changes no id.
MAX_KEPT = 200_000
#: Where the byte 0 is mapped to; the others follow.
FIRST_LETTER = 0x100
LETTERS = {b: FIRST_LETTER + b for b in range(256)}


def to_letters(data: bytes) -> str:
    return data.decode("latin-1").translate(LETTERS)


def read_ranks(path: str) -> list[bytes]:
    """The vocabulary's entries in order of their rank."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(entry) for entry, rank in (line.split() for line in f if line.strip())}
    if sorted(found) != list(range(len(found))):
        raise ValueError("ranks must run from 0 without gaps")
    return [found[i] for i in range(len(found))]


def serialise(entries: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose piece i is entry i; the unknown piece, never used, comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    for rank, entry in enumerate(entries):
        m.pieces.add(piece=to_letters(entry), score=-float(rank), type=pb.ModelProto.SentencePiece.NORMAL)
    m.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    t = m.trainer_spec
    t.model_type, t.vocab_size, t.unk_id, t.bos_id, t.eos_id, t.pad_id = pb.TrainerSpec.BPE, len(m.pieces), len(entries), -1, -1, -1
    n = m.normalizer_spec
    n.name, n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "identity", b"", False, False, False
    return m.SerializeToString()


class ByteBpe:
    """Encodes texts to little-endian unsigned 32-bit ids and decodes these to bytes."""

    def __init__(self, ranks_file: str, pattern: str, max_kept: int = MAX_KEPT):
        import regex
        import sentencepiece

        self.entries = read_ranks(ranks_file)
        self.whole = {e: i for i, e in enumerate(self.entries)}
        self.encode_letters = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.entries)).encode
        self.cut = regex.compile(pattern).findall
        self.kept: dict[str, bytes] = {}
        self.max_kept = max_kept

    def _learn(self, pre_tokens: list[str]) -> None:
        import numpy as np

        raw = [p.encode() for p in pre_tokens]
        # A match that is itself an entry is one token, even where merges alone would not lead to it.
        ids = self.encode_letters([to_letters(r) for r in raw], num_threads=1)
        for p, r, own in zip(pre_tokens, raw, ids, strict=True):
            self.kept[p] = np.array([self.whole[r]] if r in self.whole else own, "<u4").tobytes()

    def encode(self, text: str | None) -> bytes:
        matches = self.cut(text or "")
        kept = self.kept
        try:
            return b"".join(map(kept.__getitem__, matches))
        except KeyError:
            new = list({m for m in matches if m not in kept})
            self._learn(new)
            ids = b"".join(map(kept.__getitem__, matches))
            if len(kept) > self.max_kept:
                # Of the older entries the commonest come back at once.
                for p in list(itertools.islice(kept, len(kept) - self.max_kept // 2)):
                    del kept[p]
            return ids

    def decode(self, ids: bytes) -> bytes:
        import numpy as np

        return b"".join(map(self.entries.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[tuple[str, str], ByteBpe] = {}


def _codec(ranks_file: str, pattern: str) -> ByteBpe:
    if (ranks_file, pattern) not in _codecs:
        _codecs[ranks_file, pattern] = ByteBpe(ranks_file, pattern)
    return _codecs[ranks_file, pattern]


def encode(df: DataFrame, ranks_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids) for each row; `ids` holds little-endian unsigned 32-bit ids.

    Null and empty texts give no ids; repeated rows and null ids give a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _codec(ranks_file, pattern)
        for b in batches:
            ids = [own.encode(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids binary")


def decode(df: DataFrame, ranks_file: str, pattern: str, *, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """`df` with `out`, the bytes that the ids stand for (null ids: null)."""

    @F.pandas_udf("binary")
    def back(ids):
        own = _codec(ranks_file, pattern)
        return ids.map(lambda x: None if x is None else own.decode(x))

    return df.withColumn(out, back(ids_col))


def round_trip(df: DataFrame, ranks_file: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes and decodes in one pass, keeping digests only.

    Null and empty texts have no ids and the digests of nothing; a very long text is encoded whole, match by match; repeated rows and null ids give
    a row each; an empty table gives an empty one; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sha = _codec(ranks_file, pattern), hashlib.sha256
        for b in batches:
            n, a, z = [], [], []
            for t in b.column(1).to_pylist():
                ids = own.encode(t)
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                z.append(sha(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(z, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
