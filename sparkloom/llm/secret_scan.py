"""Secret scans (operator 10): key patterns, and windows of high Shannon entropy inside candidate strings.

Base kinds are patterns of assignments, access keys and long hex strings. The entropy method looks at candidate
strings, runs of key characters without a gap, less the parts that the allow-list knows: for each class of characters a window slides over
the runs of that class, its character counts are kept by adding the entering and taking off the leaving character, and the sum of c*log2(c)
changes by those two terms only. Windows over the class's threshold that hold what its keys hold join to one span.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
#: Fixed patterns and least lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A long hex run after a character that is none; equal to filtering all runs by length, and quicker.
LONG_HEX = re.compile(r"[0-9a-f]{%d,}" % HEX_LEAST)


@dataclass(frozen=True)
class CharClass:
    """A class of key characters: window length, least entropy in bits a character, and sets of characters of which a window holds at least so many."""

    name: str
    chars: str
    window: int
    bits: float
    holds: tuple[tuple[str, int], ...]


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
KEY_CHARS = UPPER + LOWER + DIGITS + "+/_-"
CLASSES = (
    CharClass("hex", DIGITS + "abcdefABCDEF", 24, 3.0, ((DIGITS, 1), ("abcdefABCDEF", 1))),
    CharClass("key", KEY_CHARS, 20, 3.75, ((DIGITS, 1), (LOWER, 1), (UPPER, 1))),
    CharClass("lower", LOWER + DIGITS, 24, 3.6, ((DIGITS, 3), (LOWER, 3))),
    CharClass("upper", UPPER + DIGITS, 24, 3.6, ((DIGITS, 3), (UPPER, 3))),
)
SHORTEST = min(c.window for c in CLASSES)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % SHORTEST)
#: Parts that look random but are known: UUIDs, words of documentation samples, alphabets and counters.
ALLOW = (
    r"(?i)(?<![0-9a-f])[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}(?![0-9a-f])",
    r"(?i)[a-z0-9]*example[a-z0-9]*",
    r"(?i)abcdefghij[k-z]*|0123456789",
)
_CAND_TABLE = bytes(99 if chr(i) in KEY_CHARS else 32 for i in range(256))
_HEX_TABLE = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_CAND_RUN, _HEX_RUN = b"c" * SHORTEST, b"h" * HEX_LEAST


def window_entropies(s: str, window: int) -> Iterator[float]:
    """Shannon entropy in bits of each window of `s`, from counts that change by one character in and one out."""
    if len(s) < window:
        return
    # A window of one character holds window + 1 of it before the oldest leaves.
    f = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += f[c + 1] - f[c]
        counts[ch] = c + 1
        if i >= window:
            old = s[i - window]
            c = counts[old]
            total += f[c - 1] - f[c]
            counts[old] = c - 1
        if i >= window - 1:
            yield math.log2(window) - total / window


class Scanner:
    def __init__(self, classes: tuple[CharClass, ...] = CLASSES, allow: tuple[str, ...] = ALLOW):
        self.classes = classes
        self.runs = [re.compile("[" + re.escape(c.chars) + "]{%d,}" % c.window) for c in classes]
        self.allowed = re.compile("|".join(f"(?:{a.removeprefix('(?i)')})" for a in allow), re.IGNORECASE) if allow else None

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the patterns: all matches from left to right, those too short dropped afterwards."""
        found = []
        low = text.lower()
        if any(k in low for k in KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        if _HEX_RUN in text.encode("utf-8", "replace").translate(_HEX_TABLE):
            found += [(m.start(), 2, m.end()) for m in LONG_HEX.finditer(text)]
        return sorted(found)

    def entropy(self, text: str) -> list[tuple[int, int, int]]:
        """(start, 3, end) of joined windows over a class's threshold, outside allowed parts."""
        if _CAND_RUN not in text.encode("utf-8", "replace").translate(_CAND_TABLE):
            return []
        spans = []
        for cand in CANDIDATE.finditer(text):
            for start, part in self.unknown(cand[0]):
                for cls, runs in zip(self.classes, self.runs, strict=True):
                    for run in runs.finditer(part):
                        at = cand.start() + start + run.start()
                        spans += [(at + i, at + i + cls.window) for i in self.windows(run[0], cls)]
        joined: list[list[int]] = []
        for a, z in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], z)
            else:
                joined.append([a, z])
        return [(a, 3, z) for a, z in joined]


    def unknown(self, candidate: str) -> list[tuple[int, str]]:
        """(start, part) of what the allow-list leaves of a candidate and could hold a window."""
        out, at = [], 0
        for m in self.allowed.finditer(candidate) if self.allowed else ():
            out.append((at, candidate[at : m.start()]))
            at = m.end()
        return [(a, p) for a, p in [*out, (at, candidate[at:])] if len(p) >= SHORTEST]

    @staticmethod
    def windows(run: str, cls: CharClass) -> Iterator[int]:
        """Starts of the windows of a run that pass the class's threshold and hold what its keys hold."""
        need = [(frozenset(chars), least) for chars, least in cls.holds]
        if any(sum(c in chars for c in run) < least for chars, least in need):
            return
        for i, bits in enumerate(window_entropies(run, cls.window)):
            if bits >= cls.bits and all(sum(c in chars for c in run[i : i + cls.window]) >= least for chars, least in need):
                yield i


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in sorted(spans))


def scan(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) for each row; spans in code points, end exclusive.

    Null and empty texts have no spans (an empty string, and its digest); a very long text is scanned whole, with memory
    for its windows' spans; spans of different kinds may overlap and stand by start, then kind; repeated rows give a
    row each; other columns are not read; an empty table gives an empty one.
    """
    scanner = scanner or Scanner()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, shas, spans = ([], [], []), [], []
            for t in b.column(1).to_pylist():
                base = scanner.base(t) if t else []
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                shas.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(base + scanner.entropy(t)) if t else "")
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(shas, pa.string()), pa.array(spans, pa.string())], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, *, text_col: str = "text", mark: str = "[SECRET]", scanner: Scanner | None = None) -> DataFrame:
    """`df` with each found span of the text replaced by `mark`; overlapping spans become one mark, null stays null. Empty and very long texts, repeated
    rows and empty tables need nothing special; other columns are kept as they are."""
    scanner = scanner or Scanner()

    @F.pandas_udf("string")
    def clean(texts):
        def one(t):
            if not t:
                return t
            out, at = [], 0
            for a, _, z in sorted(scanner.base(t) + scanner.entropy(t)):
                if z <= at:
                    continue
                if a >= at:
                    out += [t[at:a], mark]
                at = z
            return "".join([*out, t[at:]])

        return texts.map(one)

    return df.withColumn(text_col, clean(text_col))
