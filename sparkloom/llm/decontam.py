"""Benchmark decontamination (operator 8): template windows, joined by hash and checked for consistent slots.

Texts become sequences of words in lower case in which numbers, names and units are typed placeholders: a number is a run
of digits with inner points or commas; a unit is a unit's word right after a number; a name is a capitalised word inside a
sentence. Each text is read in two more ways: with names as plain words, so that the case of letters doesn't decide, and with capitalised
words that begin a sentence as names. Windows of a fixed number of tokens are hashed and joined with those of the benchmark. Matches of a document and
an item on one diagonal (the same shift of positions) are one alignment; alignments near each other are taken together, since a word more or
less, or a longer name, moves what follows. Names or numbers in a row are also read as one. The slots must be consistent: every value
of the item stands for one value of the document and the other way round, so a question whose numbers or names were
exchanged throughout is caught, and a chance likeness of form is not.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_rows, materialise
from sparkloom.llm.shingles import mix

#: Characters canonicalised at once; a longer text is a chunk of its own.
CHUNK = 250_000
#: Words that are units after a number.
UNITS = frozenset("mm cm m km in ft mi mile miles inch inches foot feet yard yards mg g kg t lb lbs oz ounce ounces pound pounds ton tons ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years mph kmh hz khz mhz ghz w kw mw v a ohm j kj cal kcal pa bar k c f degree degrees percent dollar dollars euro euros cent cents usd eur gbp".split())
NUM, NAME, UNIT = 8, 16, 24
_TYPES = {NUM: "num", NAME: "name", UNIT: "unit"}
_U = np.uint64


@dataclass(frozen=True)
class Settings:
    """window: tokens of a window (a shorter item is one window). literals: tokens of a window that are no placeholder, at least;
    with fewer, only the same values match. An item is found in a
    document if an alignment holds `coverage` of its windows, or `run` tokens in a row. skip: tokens that a run may leave out where
    the alignment changes. filter_bits: the base-2 logarithm of the number of 64-bit words of the filter that each task
    gets; its size is the same for any benchmark."""

    window: int = 8
    literals: int = 4
    coverage: float = 0.5
    run: int = 13
    skip: int = 2
    filter_bits: int = 18


_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
_OTHER, _LETTER, _DIGIT, _BREAK, _POINT = range(5)


def _char_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point: kind, lower-case form, and 1 for upper and 2 for lower case."""
    global _tables
    if _tables is None:
        kind, low, case = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32), np.zeros(0x110000, np.uint8)
        for i in range(0x110000):
            c = chr(i)
            if c.isdecimal():
                kind[i] = _DIGIT
            elif c.isalnum():
                kind[i] = _LETTER
                case[i] = 1 if c.isupper() else 2 if c.islower() else 0
                if case[i] == 1 and len(c.lower()) == 1:
                    low[i] = ord(c.lower())
        kind[[ord(c) for c in "!?\n"]] = _BREAK
        kind[[ord(c) for c in ".,"]] = _POINT
        _tables = kind, low, case
    return _tables


_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        n = max(n, CHUNK + 65_536)
        _powers = tuple(np.cumprod(np.concatenate([[_U(1)], np.full(n - 1, _U(x))]), dtype=np.uint64) for x in (_BASE, _INVERSE))
    return _powers


@dataclass
class Reading:
    """Codes of the tokens of some texts one after the other as one reading has them, where each text's tokens begin, and which tokens of the
    template each one is. `wide` readings take every capitalised word for a name. A reading that is `instead` of other codes has those windows only
    that hold too few literals in them."""

    codes: np.ndarray
    begins: np.ndarray
    first: np.ndarray
    last: np.ndarray
    wide: bool = False
    instead: np.ndarray | None = None

    def windows(self, how: Settings, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the windows that lie in one text and hold enough literals, or of a reading instead of another too few there."""
        n = len(self.codes) - width + 1
        if n <= 0 or not width:
            return np.zeros(0, int), np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            h = np.full(n, width, np.uint64)
            for j in range(width):
                h = (h ^ self.codes[j : j + n]) * _U(0x9E3779B97F4A7C15)
                h ^= h >> _U(29)
        literal = np.concatenate([[0], np.cumsum((self.codes if self.instead is None else self.instead) >= _U(32), dtype=np.int32)])
        ok = (literal[width:] - literal[:-width] >= min(how.literals, width)) == (self.instead is None)
        counts = np.diff(self.begins)
        text = np.repeat(np.arange(len(counts)), counts)
        ok &= text[:n] == text[width - 1 :]
        at = np.flatnonzero(ok)
        return at, mix(h[at])


@dataclass
class Template:
    """Codes of all tokens of some texts one after the other, where each token stands in `joined`, and where each text's tokens begin; the words'
    own codes, and which tokens are capitalised words that begin a sentence."""

    joined: str
    codes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    begins: np.ndarray
    words: np.ndarray
    opening: np.ndarray
    fresh: np.ndarray

    def collapsed(self, codes: np.ndarray, wide: bool = False) -> Reading:
        """Names, or numbers, that follow each other in one sentence become one token."""
        same = (codes[1:] == codes[:-1]) & ((codes[1:] == _U(NAME)) | (codes[1:] == _U(NUM))) & ~self.fresh[1:]
        first = np.flatnonzero(np.concatenate([[True], ~same])[: len(codes)])
        return Reading(codes[first], np.searchsorted(first, self.begins), first, np.append(first[1:], len(codes))[: len(first)], wide)

    def readings(self) -> list[Reading]:
        """The template, the same with names as plain words, all values where that has too few literals, and, with runs of names or numbers as one, the template without and with words that
        begin a sentence as names."""
        own = np.arange(len(self.codes))
        plain = np.where(self.codes == _U(NAME), self.words, self.codes)
        opened = np.where(self.opening, _U(NAME), self.codes)
        return [Reading(self.codes, self.begins, own, own + 1), Reading(plain, self.begins, own, own + 1), Reading(self.words, self.begins, own, own + 1, instead=plain), self.collapsed(self.codes), self.collapsed(opened, wide=True)]

    def value(self, a: int, z: int) -> str:
        return " ".join(self.joined[self.starts[a] : self.ends[z - 1]].lower().split())

    def slots(self, r: Reading, at: int, width: int) -> list[str]:
        """'offset type value' of the placeholders of a window."""
        own = np.flatnonzero(r.codes[at : at + width] < _U(32)) + at
        return [f"{j - at} {_TYPES[int(r.codes[j])]} {self.value(r.first[j], r.last[j])}" for j in own.tolist()]

    def fixed(self, r: Reading, at: int, width: int) -> list[str]:
        """The same of the words of a window that are placeholders in the template, but not in this reading."""
        own = [j for j in range(at, at + width) if r.codes[j] >= _U(32) and self.codes[r.first[j]] < _U(32)]
        return [f"{j - at} {_TYPES[int(self.codes[r.first[j]])]} {self.value(r.first[j], r.last[j])}" for j in own]


def canonical(texts: list[str | None]) -> Template:
    """All tokens of the texts at once: every step is an array operation over their characters."""
    kinds, lower, cases = _char_tables()
    joined = "\n".join(["", *[t or "" for t in texts], ""])
    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = kinds[chars]
    point = np.flatnonzero(kind == _POINT)
    inner = (kind[point - 1] == _DIGIT) & (kind[point + 1] == _DIGIT)
    kind[point[inner]] = _DIGIT
    outer = point[~inner]
    kind[outer] = np.where(chars[outer] == ord("."), _BREAK, _OTHER)
    token = (kind == _LETTER) | (kind == _DIGIT)
    change = np.concatenate([[True], kind[1:] != kind[:-1]])
    starts = np.flatnonzero(token & change)
    ends = np.flatnonzero(token[:-1] & change[1:]) + 1
    powers, inverses = _power_tables(len(chars))
    with np.errstate(over="ignore"):
        total = np.cumsum((lower[chars].astype(np.uint64) + _U(1)) * _U(0x9E3779B97F4A7C15) * powers[: len(chars)], dtype=np.uint64)
        h = mix((total[ends - 1] - total[starts - 1]) * inverses[starts] + (ends - starts).astype(np.uint64) * _U(_BASE))
    codes = (h & ~_U(31)) | _U(32)
    number = kind[starts] == _DIGIT
    stops = np.cumsum(kind == _BREAK, dtype=np.int32)[starts]
    fresh = np.concatenate([[True], stops[1:] != stops[:-1]])[: len(starts)]
    case = cases[chars]
    small = np.cumsum(case == 2, dtype=np.int32)
    capital = (case[starts] == 1) & (ends - starts > 1) & (small[ends - 1] - small[starts] == ends - starts - 1)
    out = np.where(capital & ~fresh, _U(NAME), codes)
    after = np.flatnonzero(np.concatenate([[False], number[:-1]])[: len(starts)] & ~number & ~fresh)
    for i in after.tolist():
        if joined[starts[i] : ends[i]].lower() in UNITS:
            out[i] = _U(UNIT)
    out[number] = _U(NUM)
    begins = np.searchsorted(starts, np.cumsum([1] + [len(t or "") + 1 for t in texts]))
    return Template(joined, out, starts, ends, begins, codes, capital & fresh, fresh)


def chunks(ids: list, texts: list[str | None]) -> Iterator[tuple[list, list[str | None]]]:
    """Parts of a batch of about CHUNK characters, or one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= CHUNK):
            size += len(texts[end] or "")
            end += 1
        yield ids[at:end], texts[at:end]
        at = end


def index_items(benchmark: DataFrame, how: Settings, *, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(hash, item_id, item_at, size, item_windows, tokens, width, item_wide, item_slots, fixed) of each window of each reading; `size` is its tokens in the
    template. Null or empty items have none."""
    names = ["hash", "item_id", "item_at", "size", "item_windows", "tokens", "width", "item_wide", "item_slots", "fixed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for item, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                t = canonical([text])
                own: dict[tuple[int, int], tuple] = {}
                for r in t.readings():
                    width = min(how.window, len(r.codes))
                    at, h = r.windows(how, width)
                    for p, v in zip(at.tolist(), h.view(np.int64).tolist(), strict=True):
                        first = int(r.first[p])
                        own.setdefault((first, v), (int(r.last[p + width - 1]) - first, width, r.wide, t.slots(r, p, width), t.fixed(r, p, width)))
                places = len({p for p, _ in own})
                out += [(v, item, p, size, places, len(t.codes), *rest) for (p, v), (size, *rest) in own.items()]
            cols = list(zip(*out, strict=True)) if out else [[]] * 10
            kinds = [pa.int64(), b.schema.field(0).type, *[pa.int64()] * 5, pa.bool_(), *[pa.list_(pa.string())] * 2]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    kind = benchmark.schema[item_col].dataType.simpleString()
    return benchmark.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("text")).mapInArrow(run, f"hash long, item_id {kind}, item_at long, size long, item_windows long, tokens long, width long, item_wide boolean, item_slots array<string>, fixed array<string>")


def _marks(h: np.ndarray) -> np.ndarray:
    """The two bits of a filter's word that stand for a hash."""
    return (_U(1) << (h & _U(63))) | (_U(1) << ((h >> _U(6)) & _U(63)))


def window_filter(index: DataFrame, bits: int) -> np.ndarray:
    """A Bloom filter of the index's hashes: the upper bits name a word, two marks are set in it. Words are merged on the executors, so
    the driver gets at most 2^bits of them however large the benchmark is. A fuller filter lets more windows through to the exact join, no fewer."""
    mark = lambda by: F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {by}) & 63 as int))")
    merged = index.select(F.shiftrightunsigned("hash", 64 - bits).alias("word"), mark(0).bitwiseOR(mark(6)).alias("m")).groupBy("word").agg(F.bit_or("m").alias("m")).toArrow()
    words = np.zeros(1 << bits, np.uint64)
    words[merged.column("word").to_numpy()] = merged.column("m").to_numpy().astype(np.int64).view(np.uint64)
    return words


def match_windows(docs: DataFrame, index: DataFrame, how: Settings, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Windows of documents joined with those of items: (doc_id, row, at, wide, slots) and the columns of the index but the hash; `row` is a digest of the text.
    What passes the filter of the benchmark's windows is joined by hash."""
    widths = sorted(r.width for r in index.select("width").distinct().collect())
    words, shift = window_filter(index, how.filter_bits), _U(64 - how.filter_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.string())]
            for rows, texts in chunks(list(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)), b.column(1).to_pylist()):
                t = canonical(texts)
                out: dict[tuple[int, int], tuple] = {}
                for r in t.readings():
                    for width in widths:
                        at, h = r.windows(how, width)
                        near = np.flatnonzero((words[(h >> shift).astype(np.int64)] & (bits := _marks(h))) == bits)
                        at, h = at[near], h[near]
                        own = np.searchsorted(r.begins, at, side="right") - 1
                        for d, p, v in zip(own.tolist(), at.tolist(), h.view(np.int64).tolist(), strict=True):
                            first = int(r.first[p])
                            if (first, v) not in out:
                                out[first, v] = (*rows[d], first - int(t.begins[d]), v, r.wide, t.slots(r, p, width))
                cols = list(zip(*out.values(), strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "row", "at", "hash", "wide", "slots"])

    kind = docs.schema[id_col].dataType.simpleString()
    found = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("row")).mapInArrow(run, f"doc_id {kind}, row long, at long, hash long, wide boolean, slots array<string>")
    return found.join(index, "hash").drop("hash")


def consistent(pairs: Iterator[tuple[int, list[str], list[str]]]) -> tuple[bool, bool]:
    """Whether slots map one to one, and whether all are equal; `pairs` are (position, item slots, document slots)."""
    there: dict[tuple[str, str], str] = {}
    back: dict[tuple[str, str], str] = {}
    same = True
    for _, item, doc in pairs:
        for a, b in zip(item, doc, strict=True):
            _, kind, x = a.split(" ", 2)
            y = b.split(" ", 2)[2]
            same &= x == y
            if there.setdefault((kind, x), y) != y or back.setdefault((kind, y), x) != x:
                return False, False
    return True, same


def settle(line: list[dict]) -> tuple[list[dict], bool]:
    """Of one alignment, the windows that may count, and whether all slots are equal. Where slots contradict each other, those count in which only
    surer names are names; where these do as well, windows without slots stand alone."""
    for part in (line, [x for x in line if not x["wide"]]):
        sound, same = consistent((x["item_at"], x["item_slots"] + x["fixed"], x["slots"] + x["fixed"]) for x in part)
        if sound and part:
            return part, same
    return [x for x in line if not x["slots"] and not x["fixed"]], True


def reach(size: int) -> int:
    """How far the shifts of alignments may be apart that are taken together: half of an item's tokens."""
    return max(8, size // 2)


def combine(lines: dict[int, list[dict]], seed: int, apart: int) -> tuple[list[dict], bool, list[int]]:
    """The windows of the alignment `seed` and those of its neighbours, largest first, that stand in the same order in both texts and whose slots do
    not contradict those already there; whether all slots are equal; and the shifts that were used."""

    def pairs(some: list[dict]) -> Iterator[tuple[int, list[str], list[str]]]:
        return ((x["item_at"], x["item_slots"] + x["fixed"], x["slots"] + x["fixed"]) for x in some)

    kept, used = list(lines[seed]), [seed]
    there = {x["item_at"]: x["item_at"] + seed for x in kept}
    order = sorted(there)
    same = consistent(pairs(kept))[1]
    for shift in sorted((s for s in lines if s != seed and abs(s - seed) <= apart), key=lambda s: (-len(lines[s]), abs(s - seed), s)):
        new = []
        for x in lines[shift]:
            k = bisect_left(order, x["item_at"])
            before, after = order[k - 1] if k else None, order[k] if k < len(order) else None
            at = x["item_at"] + shift
            if x["item_at"] not in there and (before is None or there[before] < at) and (after is None or at < there[after]):
                new.append(x)
        sound, equal = consistent(pairs(kept + new))
        if not sound:
            new, equal = [x for x in new if not x["slots"] and not x["fixed"]], same
        if new:
            used.append(shift)
            kept += new
            same = equal
            for x in new:
                if x["item_at"] not in there:
                    there[x["item_at"]] = x["item_at"] + shift
                    insort(order, x["item_at"])
    return kept, same, used


def measure(kept: list[dict], how: Settings) -> tuple[bool, int, int]:
    """Found, windows matched, tokens of the longest run. Where the shift changes, a run goes on over up to `how.skip` tokens of the item."""
    longest = run = end = 0
    shift = None
    for x in sorted(kept, key=lambda x: (x["item_at"], x["shift"])):
        stop = x["item_at"] + x["size"]
        gap = 0 if shift == x["shift"] else how.skip
        run = run + max(0, stop - max(end, x["item_at"])) if run and x["item_at"] <= end + gap else x["size"]
        end, shift = max(end, stop), x["shift"]
        longest = max(longest, run)
    matched = len({x["item_at"] for x in kept})
    return matched >= how.coverage * kept[0]["item_windows"] or longest >= how.run, matched, longest


def judge(windows: list[dict], how: Settings) -> tuple[bool, int, int, bool, int]:
    """Of the windows of neighbouring alignments: found, windows matched, tokens of the longest run, all slots equal, and the first alignment's
    shift. Each alignment is settled alone before those that stand near each other are taken together."""
    lines: dict[int, list[dict]] = {}
    for x in windows:
        lines.setdefault(x["shift"], []).append(x)
    lines = {s: kept for s, line in lines.items() if (kept := settle(line)[0])}
    best, done = (False, 0, 0, False, 0), set()
    for seed in sorted(lines, key=lambda s: (-len(lines[s]), s)):
        if seed in done:
            continue
        kept, same, used = combine(lines, seed, reach(windows[0]["tokens"]))
        done.update(used)
        found, matched, longest = measure(kept, how)
        best = max(best, (found, matched, longest, same, min(used)), key=lambda r: (r[0], r[1], -r[4]))
    return best


def judged(docs: DataFrame, benchmark: DataFrame, how: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, row, item_id, shift, matched, longest_run, same, item_windows) of the alignments in which an item is found; `row` is a digest of the text."""
    index = materialise(index_items(benchmark, how, item_col=item_col, text_col=item_text_col), "items")
    pairs = match_windows(docs, index, how, id_col=id_col, text_col=text_col).withColumns({"shift": F.col("at") - F.col("item_at"), "wide": F.col("wide") | F.col("item_wide")})
    # Shifts within reach of each other share one of the two regions that each alignment goes to as a whole.
    apart = F.greatest(F.lit(8), F.floor(F.col("tokens") / 2)) + 1
    pairs = pairs.withColumn("region", F.floor(F.col("shift") / apart)).withColumn("region", F.explode(F.array("region", F.col("region") - 1)))
    window = F.struct("shift", "item_at", "item_windows", "tokens", "size", "wide", "slots", "item_slots", "fixed")
    lines = pairs.groupBy("doc_id", "row", "item_id", "region").agg(F.array_sort(F.collect_set(window)).alias("line")).select("doc_id", "item_id", "line", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, matched, longest, same, shift, sizes = zip(*[(*judge(line, how), line[0]["item_windows"]) for line in b.column(2).to_pylist()], strict=True) if b.num_rows else [()] * 6
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shift, pa.int64()), pa.array(found, pa.bool_()), pa.array(matched, pa.int64()), pa.array(longest, pa.int64()), pa.array(same, pa.bool_()), pa.array(sizes, pa.int64()), b.column(3)], names=["doc_id", "item_id", "shift", "found", "matched", "longest_run", "same", "item_windows", "row"])

    d, i = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    return lines.mapInArrow(run, f"doc_id {d}, item_id {i}, shift long, found boolean, matched long, longest_run long, same boolean, item_windows long, row long").where("found")


def contaminated(docs: DataFrame, benchmark: DataFrame, how: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, matched, item_windows, coverage, longest_run, kind): a row for each item found in a document; kind is exact or
    reparameterised. The best alignment counts: most windows, then the first.

    Null and empty texts and items match nothing; an item found in any of the documents with one id is found in that id, rows with a null id
    counting as one; equal items are each found; a very long text is compared whole; other columns are not read; empty tables give an empty one.
    """
    found = judged(docs, benchmark, how, id_col=id_col, text_col=text_col, item_col=item_col, item_text_col=item_text_col)
    best = found.groupBy("doc_id", "item_id").agg(F.max_by(F.struct("matched", "item_windows", "longest_run", "same"), F.struct("matched", -F.col("shift"))).alias("b"))
    return best.select("doc_id", "item_id", "b.matched", "b.item_windows", (F.col("b.matched") / F.col("b.item_windows")).alias("coverage"), "b.longest_run", F.when(F.col("b.same"), "exact").otherwise("reparameterised").alias("kind"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, how: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` in whose own text no item is found, with their columns: of rows that share an id, those with other texts stay. A null
    id, an empty text or an extra column changes nothing; empty tables give back `docs`."""
    found = judged(docs, benchmark, how, id_col=id_col, text_col=text_col).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    return drop_rows(docs, materialise(found, "contaminated"), id_col, text_col)
