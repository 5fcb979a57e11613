"""Chat formatting as prefix trees: shared initial turns are emitted once.

A turn is formatted as ``<|turn|>role\\ntext<|end|>``; control strings inside roles
and texts are escaped with a backslash, reversibly. Conversations are sorted by
the path of their turns, so that those which share turns are neighbours and the
order is the tree's depth-first order; a stream over the sorted rows grows packs.
A pack holds one tree (or part of one): its tokens, each turn's once; position ids
that count from the root along a token's own path; the loss mask (assistant texts);
and for each node the intervals of the pack, its ancestors', that its tokens may
attend to besides the tokens before them in their own node. A pack ends with its
root, or beyond ``most_tokens``, or with its task's range of the sorted rows; a
conversation that goes on in a new pack takes its ancestors with it, so turns are
emitted once a pack. Equal conversations are one path with several members, so a
conversation that a third of the rows repeat is one row here.

Defined cases: null texts and roles are empty; rows of one conversation with equal
``turn`` go by role and text, those without one come first; repeated rows are turns of
their own; a row without a ``conv_id`` is a conversation of its own, of one turn; very
long texts are one node, whose pack ends with it; conversations with equal turns are
one path wherever they lie; an empty table gives no packs; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tomolake.llm import scratch
from tomolake.llm.textkit import lean

TURN, END = "<|turn|>", "<|end|>"
_CONTROL = re.compile(r"\\|<(?=\||/?s>)|\[(?=/?INST\])|<(?=/?(?:bos|eos|pad|unk)>)")
_HEAD = re.compile(r"((?:\\.|[^\\\n])*)\n", re.S)


def escape(text: str, role: bool = False) -> str:
    """``text`` without control strings: a backslash goes after their first character, and doubles itself."""
    out = _CONTROL.sub(lambda m: m[0] + "\\", text)
    return out.replace("\n", "\\\n") if role else out


def unescape(text: str) -> str:
    return re.sub(r"\\\\|\\", lambda m: "\\" if len(m[0]) == 2 else "", text)


class Codec:
    """Tokens are UTF-8 bytes, or those of a byte-level vocabulary (the path of its file is the parameter); two ids above are the control strings."""

    def __init__(self, vocabulary: str | None = None):
        self.t = None
        self.base = 256
        if vocabulary:
            from tokenizers import Tokenizer

            self.t = Tokenizer.from_file(vocabulary)
            self.t.encode_special_tokens = True
            self.base = self.t.get_vocab_size()

    def encode(self, text: str) -> np.ndarray:
        if self.t is None:
            return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.int32)
        return np.array(self.t.encode(text, add_special_tokens=False).ids, np.int32)

    def decode(self, ids: np.ndarray) -> str:
        if self.t is None:
            return ids.astype(np.uint8).tobytes().decode("utf-8", "surrogatepass")
        return self.t.decode(ids.tolist(), skip_special_tokens=False)

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray]:
        """(tokens, loss mask) of one formatted turn."""
        head, body = self.encode(escape(role, True) + "\n"), self.encode(escape(text))
        ids = np.concatenate([[self.base], head, body, [self.base + 1]]).astype(np.int32)
        loss = np.zeros(len(ids), bool)
        if role == "assistant":
            loss[1 + len(head) : -1] = True
        return ids, loss


@lru_cache(maxsize=2)
def _codec(vocabulary: str | None) -> Codec:
    return Codec(vocabulary)


class Pack:
    """One prefix tree while it grows, depth first."""

    def __init__(self):
        self.ids: list[np.ndarray] = []
        self.loss: list[np.ndarray] = []
        self.position: list[np.ndarray] = []
        self.start: list[int] = []
        self.end: list[int] = []
        self.parent: list[int] = []
        self.attend: list[list[int]] = []
        self.leaves: list[tuple[str, int]] = []
        self.size = 0

    def add(self, parent: int, depth: int, ids: np.ndarray, loss: np.ndarray) -> int:
        up: list[int] = []
        if parent >= 0:
            up = list(self.attend[parent])
            s, e = self.start[parent], self.end[parent]
            if up and up[-1] == s:
                up[-1] = e  # intervals that touch are one
            else:
                up += [s, e]
        self.ids.append(ids)
        self.loss.append(loss)
        self.position.append(np.arange(depth, depth + len(ids), dtype=np.int32))
        self.start.append(self.size)
        self.size += len(ids)
        self.end.append(self.size)
        self.parent.append(parent)
        self.attend.append(up)
        return len(self.parent) - 1


_PACK = pa.schema(
    [
        ("tokens", pa.list_(pa.int32())), ("positions", pa.list_(pa.int32())), ("loss", pa.list_(pa.bool_())), ("node_start", pa.list_(pa.int32())), ("node_end", pa.list_(pa.int32())),
        ("node_parent", pa.list_(pa.int32())), ("node_attend", pa.list_(pa.list_(pa.int32()))), ("leaf_digest", pa.list_(pa.string())), ("leaf_node", pa.list_(pa.int32())),
    ]
)
PACK_DDL = "tokens array<int>, positions array<int>, loss array<boolean>, node_start array<int>, node_end array<int>, node_parent array<int>, node_attend array<array<int>>, leaf_digest array<string>, leaf_node array<int>"


def _packed(vocabulary: str | None, most_tokens: int):
    def row(p: Pack):
        one = [np.concatenate(p.ids), np.concatenate(p.position), np.concatenate(p.loss), p.start, p.end, p.parent, p.attend, [d for d, _ in p.leaves], [n for _, n in p.leaves]]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(one, _PACK, strict=True)], schema=_PACK)

    @lean
    def run(batches):
        codec = _codec(vocabulary)
        pack: Pack | None = None
        path: list[tuple[tuple[str, str], int, int]] = []  # turn, node, depth after it
        for batch in batches:
            for digest, turns in zip(batch.column("digest").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                keys = [(t["role"], t["text"]) for t in turns]
                same = 0
                while same < min(len(path), len(keys)) and path[same][0] == keys[same]:
                    same += 1
                if pack is not None and (same == 0 or pack.size > most_tokens):
                    yield row(pack)
                    pack, same = None, 0
                if pack is None:
                    pack, path, same = Pack(), [], 0
                del path[same:]
                for role, text in keys[same:]:
                    parent, depth = (path[-1][1], path[-1][2]) if path else (-1, 0)
                    ids, loss = codec.turn(role, text)
                    path.append(((role, text), pack.add(parent, depth, ids, loss), depth + len(ids)))
                pack.leaves.append((digest, path[-1][1]))
        if pack is not None:
            yield row(pack)

    return run


def conversations_of(rows: DataFrame) -> DataFrame:
    """(conv_id, turns, digest): each conversation's turns in order, and a digest of them."""
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    each = rows.select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    whole = each.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("rows"))
    whole = whole.unionByName(each.where("conv_id is null").select("conv_id", F.array("one").alias("rows")))
    turns = whole.select("conv_id", F.transform("rows", lambda r: F.struct(r.role.alias("role"), r.text.alias("text"))).alias("turns"))
    return turns.withColumn("digest", F.sha2(F.to_json("turns"), 256))


def pack(conversations: DataFrame, vocabulary: str | None = None, most_tokens: int = 65_536) -> tuple[DataFrame, DataFrame]:
    """(packs, members): the packs, and (conv_id, digest) of each conversation; ``leaf_digest`` names the paths that end at ``leaf_node``."""
    convs = scratch.written(conversations_of(conversations), "conversations")
    paths = convs.select("digest", "turns").dropDuplicates(["digest"])  # copies go within each task first
    keyed = paths.withColumn("path", F.transform("turns", lambda t: F.xxhash64(t.role, t.text)))
    n = scratch.partitions(convs.sparkSession)
    packs = keyed.repartitionByRange(n, "path", "digest").sortWithinPartitions("path", "digest").select("digest", "turns").mapInArrow(_packed(vocabulary, most_tokens), PACK_DDL)
    return packs, convs.select("conv_id", "digest")


def read_back(row: dict, codec: Codec):
    """Yields (digest, [(role, text)], text under the loss mask, code points) of each path, from a pack's arrays alone."""
    ids, loss = np.asarray(row["tokens"], np.int32), np.asarray(row["loss"], bool)
    start, end, parent = row["node_start"], row["node_end"], row["node_parent"]

    @lru_cache(maxsize=None)
    def node(k: int):
        x, mask = ids[start[k] : end[k]], loss[start[k] : end[k]]
        if x[0] != codec.base or x[-1] != codec.base + 1:
            raise ValueError("a node is no turn")
        body = codec.decode(x[1:-1])
        head = _HEAD.match(body)
        return unescape(head[1]), unescape(body[head.end() :]), unescape(codec.decode(x[mask])), len(TURN) + len(body) + len(END)

    for digest, leaf in zip(row["leaf_digest"], row["leaf_node"], strict=True):
        path = []
        while leaf >= 0:
            path.append(leaf)
            leaf = parent[leaf]
        turns = [node(k) for k in reversed(path)]
        yield digest, [t[:2] for t in turns], "".join(t[2] for t in turns), sum(t[3] for t in turns)


DIGEST_DDL = "digest string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(vocabulary: str | None):
    @lean
    def run(batches):
        codec = _codec(vocabulary)
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k].values.to_numpy(zero_copy_only=False) for n in ("tokens", "loss")}
                row |= {n: batch.column(n)[k].as_py() for n in ("node_start", "node_end", "node_parent", "leaf_digest", "leaf_node")}
                out = []
                for digest, turns, learnt, chars in read_back(row, codec):
                    said = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((digest, len(turns), said, len(learnt), hashlib.sha256(learnt.encode("utf-8", "surrogatepass")).hexdigest(), chars))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["digest", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return run


def digests(packs: DataFrame, members: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Each conversation as read back from the packs."""
    of = packs.mapInArrow(_digests(vocabulary), DIGEST_DDL)
    return members.join(of, "digest").select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")
