"""Chat formatting as a prefix tree (operator 1).

Conversations that begin with the same turns share these turns' tokens. A node is a distinct sequence of first turns; its
segment is the last of them, formatted. All trees are emitted as one stream, depth first, each segment once. A node has
the place of its segment in the stream, the position id of its first token (the length of the segments above it) and the
stream intervals of its ancestors, which with its own earlier tokens are all that its tokens may attend to.

Depth-first order comes from sorting distinct conversations by the digests of their prefixes: a node stands where the
first conversation that holds it stands, by depth. Stream places are running totals over that order, so no tree has to
fit into a task. Tokens are code points here; `measure` may count those of a tokenizer.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import join_hot, materialise, running_total

BEGIN, SEP, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings that texts may hold: those of this template and of common others.
CONTROL = (BEGIN, SEP, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
ESCAPE = "\\"
_FIND = re.compile("|".join(re.escape(c) for c in (ESCAPE, *CONTROL)))
_BACK = re.compile(re.escape(ESCAPE) + "(.)", re.DOTALL)
_TURN = re.compile(f"{re.escape(BEGIN)}(.*?){re.escape(SEP)}(.*?){re.escape(END)}", re.DOTALL)


def escape(text: str) -> str:
    """Doubles escape characters and puts one after the first character of each control string."""
    return _FIND.sub(lambda m: ESCAPE * 2 if m[0] == ESCAPE else m[0][0] + ESCAPE + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The segment and where its text begins and ends."""
    head, body = BEGIN + escape(role) + SEP, escape(text)
    return head + body + END, len(head), len(head) + len(body)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts; raises if anything stands between the turns."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError("text outside turns")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("text outside turns")
    return out


@dataclass(frozen=True)
class ChatForest:
    """nodes: the stream, a row for each segment; `paths` counts the distinct conversations that go through it. leaves: node ids from root to leaf of each
    distinct conversation. members: the leaf of each conversation."""

    nodes: DataFrame
    leaves: DataFrame
    members: DataFrame


_NODE = "struct<node:string,parent:string,depth:int,role:string,segment:string,loss_from:int,loss_to:int,length:long,position:long>"


def build(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_roles: tuple[str, ...] = ("assistant",), measure: Callable[[str], int] = len) -> ChatForest:
    """Turns stand by turn number (null first), then role and text. Null texts and roles are empty. Repeated rows are
    turns of their own; rows with a null conversation id form one conversation. Other columns are not read. An empty
    table gives empty tables. A conversation must fit into a task; a tree need not."""
    kind = turns.schema[conv_col].dataType.simpleString()
    empty = F.lit("")
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, empty).alias("role"), F.coalesce(text_col, empty).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                node, nodes, at = "", [], 0
                for depth, t in enumerate(said):
                    segment, a, z = format_turn(t["role"], t["text"])
                    parent, node = node, hashlib.sha256(f"{node}\n{segment}".encode()).hexdigest()[:32]
                    n = measure(segment)
                    if t["role"] not in trained_roles:
                        a = z = 0
                    nodes.append({"node": node, "parent": parent or None, "depth": depth, "role": t["role"], "segment": segment, "loss_from": a, "loss_to": z, "length": n, "position": at})
                    at += n
                out.append((conv, node, "".join(x["node"] for x in nodes), nodes))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            node_type = pa.struct([("node", pa.string()), ("parent", pa.string()), ("depth", pa.int32()), ("role", pa.string()), ("segment", pa.string()), ("loss_from", pa.int32()), ("loss_to", pa.int32()), ("length", pa.int64()), ("position", pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.list_(node_type))], names=["conv_id", "leaf", "path", "nodes"])

    convs = materialise(whole.mapInArrow(paths, f"conv_id {kind}, leaf string, path string, nodes array<{_NODE}>"), "chat-paths")
    once = convs.groupBy("leaf").agg(F.first("path").alias("path"), F.first("nodes").alias("nodes"))
    ranks = running_total(once.select("leaf", "path", F.lit(1).cast("long").alias("one")), ["path"], "one", "rank", "chat-ranks").select("leaf", "rank")
    chained = once.select("leaf", F.explode("nodes").alias("n")).join(ranks, "leaf")
    own = [c for c in ("parent", "depth", "role", "segment", "loss_from", "loss_to", "length", "position")]
    found = chained.groupBy(F.col("n.node").alias("node")).agg(F.min("rank").alias("rank"), F.count("*").alias("paths"), *[F.first(f"n.{c}").alias(c) for c in own])
    found = materialise(found, "chat-nodes")
    starts = running_total(found.select("node", "rank", "depth", "length", "paths"), ["rank", "depth"], "length", "start", "chat-starts").select("node", "rank", "start", "paths")
    # A first turn that many conversations share is a hot key.
    chain = join_hot(chained.select("leaf", F.col("rank").alias("leaf_rank"), "n.node", "n.depth", "n.length"), starts, "node", "paths")
    lines = chain.groupBy("leaf", "leaf_rank").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "start", "length", (F.col("rank") == F.col("leaf_rank")).alias("first")))).alias("line"))

    def intervals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("from", pa.int64()), ("to", pa.int64())])
        for b in batches:
            ids, starts_, attend = [], [], []
            for line in b.column(0).to_pylist():
                above: list[tuple[int, int]] = []
                for x in line:
                    if x["first"]:
                        ids.append(x["node"])
                        starts_.append(x["start"])
                        attend.append([{"from": a, "to": z} for a, z in above])
                    if above and above[-1][1] == x["start"]:
                        above[-1] = (above[-1][0], x["start"] + x["length"])
                    else:
                        above.append((x["start"], x["start"] + x["length"]))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(starts_, pa.int64()), pa.array(attend, pa.list_(span))], names=["node", "start", "attend"])

    placed = lines.select("line").mapInArrow(intervals, "node string, start long, attend array<struct<from:long,to:long>>")
    return ChatForest(found.drop("rank").join(placed, "node"), once.select("leaf", F.transform("nodes", lambda n: n["node"]).alias("chain")), convs.select("conv_id", "leaf"))


def read_back(forest: ChatForest) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from the emitted segments alone."""
    steps = forest.leaves.select("leaf", F.posexplode("chain").alias("depth", "node"))
    steps = join_hot(steps, forest.nodes.select("node", "segment", "loss_from", "loss_to", "paths"), "node", "paths")
    whole = steps.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("depth", "segment", "loss_from", "loss_to"))).alias("line"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for leaf, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                formatted = "".join(x["segment"] for x in line)
                said = parse_turns(formatted)
                trained = unescape_masked(line)
                out.append((leaf, len(said), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest(), len(trained), hashlib.sha256(trained.encode()).hexdigest(), len(formatted)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["leaf", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    read = whole.mapInArrow(digests, "leaf string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return forest.members.join(read, "leaf").drop("leaf")


def unescape_masked(line: list[dict]) -> str:
    return "".join(unescape(x["segment"][x["loss_from"] : x["loss_to"]]) for x in line)
