"""Tokenizers and token scalars.

`codepoint` and `word` are SQL expressions, so whatever follows can be checked in another engine. `bpe` and `sentencepiece`
run in Arrow batches, one tokenizer for each Python worker.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ids beyond Unicode for the code point tokenizer, and marks for the word tokenizer.
EOD, PAD = 1114112, 1114113
WORD_EOD = "<eod>"
IGNORE = -100
#: Fixed replacement id of the white-space repair.
METASPACE_ID = 71


def codepoint_tokens(text: Column | str) -> Column:
    """Unicode code points; a null text has none."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(F.coalesce(text, F.lit("")) == "", F.expr("cast(array() as array<int>)")).otherwise(F.transform(F.split(text, ""), F.ascii))


def word_tokens(text: Column | str) -> Column:
    """Runs of ASCII letters."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Za-z]+"), F.lit(0))


def repair_metaspace(tokens: Column | str, metaspace: int, put: int = METASPACE_ID) -> Column:
    """The id of an empty white-space piece becomes another one."""
    return F.transform(tokens, lambda t: F.when(t == metaspace, F.lit(put)).otherwise(t))


def padded_vocab(vocab: Column | str, multiple: int = 128) -> Column:
    return (F.ceil(F.col(vocab) / multiple) * multiple if isinstance(vocab, str) else F.ceil(vocab / multiple) * multiple).cast("long")


def shard_dtype(vocab: Column | str) -> Column:
    vocab = F.col(vocab) if isinstance(vocab, str) else vocab
    return F.when(vocab < 65536, "uint16").otherwise("uint32")


@dataclass(frozen=True)
class TokenizerSpec:
    """A tokenizer by kind and file. eod falls back to eos, bos to eos; pad is one more id where the vocabulary has none."""

    kind: str
    path: str | None
    vocab_size: int
    eod_id: int
    pad_id: int
    bos_id: int
    parse_special: bool = True


#: Characters that a library encodes at once: its records of a token take a hundred bytes and more.
PORTION = 1 << 18

#: Names that mean a file of the public tokenizers; nothing is fetched from a network.
KNOWN = {"gpt2": "byte_bpe_50k.json", "byte_bpe_50k": "byte_bpe_50k.json", "piece_bpe_32k": "piece_bpe_32k.model"}


def resolve(name: str, folder: str | None = None) -> TokenizerSpec:
    """A directory with a .model file, a tokenizer.json or vocab.json and merges.txt, such a file itself, or a known name; anything
    else is an error rather than a silent fall-back."""
    if name in ("codepoint", "word"):
        return TokenizerSpec(name, None, PAD + 1, EOD, PAD, EOD)
    path = name
    if os.path.isdir(name):
        files = sorted(os.listdir(name))
        found = [f for f in files if f.endswith(".model")] or [f for f in files if f == "tokenizer.json"]
        if not found and {"vocab.json", "merges.txt"} <= set(files):
            return _spec("pair", name)
        if not found:
            raise ValueError(f"{name} holds no tokenizer file")
        path = os.path.join(name, found[0])
    elif name in KNOWN:
        if folder is None:
            import public_tokenizers

            path = public_tokenizers.path(KNOWN[name])
        else:
            path = os.path.join(folder, KNOWN[name])
    if not os.path.isfile(path):
        raise ValueError(f"no tokenizer named {name!r}; give a file, a directory or one of {sorted(KNOWN)}")
    return _spec("sentencepiece" if path.endswith(".model") else "bpe", path)


def _spec(kind: str, path: str) -> TokenizerSpec:
    t = load(TokenizerSpec(kind, path, 0, 0, 0, 0))
    if kind == "sentencepiece":
        n, eos, pad, bos = t.get_piece_size(), t.eos_id(), t.pad_id(), t.bos_id()
        eos = n - 1 if eos < 0 else eos
        return TokenizerSpec(kind, path, n if pad >= 0 else n + 1, eos, pad if pad >= 0 else n, bos if bos >= 0 else eos)
    eos = t.token_to_id("<|endoftext|>")
    n = t.get_vocab_size()
    eos = n - 1 if eos is None else eos
    pad = t.token_to_id("<|pad|>")
    return TokenizerSpec(kind, path, n if pad is not None else n + 1, eos, pad if pad is not None else n, eos)


_loaded: dict[TokenizerSpec, object] = {}


def load(spec: TokenizerSpec):
    """The library's tokenizer, one for each worker process."""
    if spec not in _loaded:
        if spec.kind == "sentencepiece":
            import sentencepiece

            _loaded[spec] = sentencepiece.SentencePieceProcessor(model_file=spec.path)
        else:
            import tokenizers

            if spec.kind == "pair":
                made = tokenizers.ByteLevelBPETokenizer(os.path.join(spec.path, "vocab.json"), os.path.join(spec.path, "merges.txt"))
            else:
                made = tokenizers.Tokenizer.from_file(spec.path)
                made.encode_special_tokens = not spec.parse_special
            _loaded[spec] = made
    return _loaded[spec]


def encode_texts(spec: TokenizerSpec, texts: list[str], max_length: int | None = None, *, special: bool = False, padded: bool = False) -> list[list[int]]:
    """Ids of each text; `special` adds the tokenizer's marks around it, `padded` fills up to `max_length` with the pad id."""
    t = load(spec)
    ids = []
    for few in portions(texts):
        if spec.kind == "sentencepiece":
            made = t.encode(few, num_threads=1)
            ids += [[spec.bos_id, *x] for x in made] if special else made
        else:
            ids += [e.ids for e in t.encode_batch(few, add_special_tokens=special)]
    if not max_length:
        return ids
    return [x[:max_length] + [spec.pad_id] * (max_length - len(x) if padded else 0) for x in ids]


def portions(texts: list[str], chars: int = PORTION) -> Iterator[list[str]]:
    """The texts in order, a few at a time: no more than `chars` characters at once, or a single longer text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > chars:
            yield texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield texts[at:]


def count_texts(spec: TokenizerSpec, texts: list[str]) -> list[int]:
    """How many ids `encode_texts` gives each text; neither ids nor the library's records of a token are kept."""
    t = load(spec)
    if spec.kind == "sentencepiece":
        return [len(x) for few in portions(texts) for x in t.encode(few, num_threads=1)]
    run = getattr(t, "encode_batch_fast", t.encode_batch)  # without offsets
    return [len(e) for few in portions(texts) for e in run(few, add_special_tokens=False)]


def find_metaspace(spec: TokenizerSpec, first: int = 1000, last: int = 50_000) -> int | None:
    """The id of a piece that is white space alone and decodes to nothing, looked for where such ids are; byte-level vocabularies have none."""
    if spec.kind != "sentencepiece":
        return None
    t = load(spec)
    n = t.get_piece_size()
    return next((i for i in range(min(first, n), min(last, n)) if t.id_to_piece(i) == "\u2581" and not t.decode([i]).strip()), None)


def encode(spec: TokenizerSpec, max_length: int | None = None, *, special: bool = False, padded: bool = False):
    """A column function text -> array<int>; null texts are encoded as empty ones."""
    if spec.kind in ("codepoint", "word"):
        made = codepoint_tokens if spec.kind == "codepoint" else word_tokens
        return lambda c: F.slice(made(c), 1, max_length) if max_length else made(c)
    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(encode_texts(spec, s.fillna("").tolist(), max_length, special=special, padded=padded))

    return run


def count(spec: TokenizerSpec):
    """A column function text -> int, the size of what `encode` gives: only the number comes back."""
    if spec.kind in ("codepoint", "word"):
        return lambda c: F.size(encode(spec)(c))

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(count_texts(spec, s.fillna("").tolist()), dtype="int32")

    return run


def decode(spec: TokenizerSpec):
    """A column function array<int> -> text; no ids give an empty text. A sentencepiece text loses the spaces at its end, unless it is nothing else."""
    @F.pandas_udf("string")
    def run(ids: pd.Series) -> pd.Series:
        t = load(spec)

        def one(x):
            text = "" if x is None or not len(x) else t.decode([int(i) for i in x])
            return text.rstrip(" ") if spec.kind == "sentencepiece" and not text.isspace() else text

        return ids.map(one)

    return run


def pieces(spec: TokenizerSpec, df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """`df` with `pieces`, the vocabulary's strings of the ids."""
    @F.pandas_udf("array<string>")
    def run(ids: pd.Series) -> pd.Series:
        t = load(spec)
        name = t.id_to_piece if spec.kind == "sentencepiece" else t.id_to_token
        return ids.map(lambda x: None if x is None else [name(int(i)) for i in x])

    return df.withColumn("pieces", run(tokens))


def piece_ids(spec: TokenizerSpec, df: DataFrame, pieces_col: str = "pieces") -> DataFrame:
    """`df` with `tokens`, the ids of the vocabulary's strings; a string that is none has the id that the library gives it, or null."""
    @F.pandas_udf("array<int>")
    def run(pieces_: pd.Series) -> pd.Series:
        t = load(spec)
        name = t.piece_to_id if spec.kind == "sentencepiece" else t.token_to_id
        return pieces_.map(lambda x: None if x is None else [name(str(p)) for p in x])

    return df.withColumn("tokens", run(pieces_col))


def strip(text: Column | str) -> Column:
    """Without white space at either end, line ends and Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def step_of_name(name: Column | str) -> Column:
    found = F.regexp_extract(name, r"^checkpoint-(\d+)(-.*)?$", 1)
    return F.when(found != "", found.cast("long"))


