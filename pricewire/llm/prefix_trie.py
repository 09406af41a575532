"""Conversation prefix trie by adaptive radix trees over fixed-width turn ids.

A turn's id has 20 bytes: 16 of a SHA-256 of its role and text, and its text's number of code points, big-endian.  A rebuilt conversation is
the string of its turns' ids.

1. Equal conversations are combined to one row (count, smallest id) before anything is grouped further.
2. The distinct strings are range-partitioned; each task inserts its range into an adaptive radix tree: nodes of 4, 16,
   48 or 256 children that grow when full, with compressed paths.  A walk of the tree emits a trie node at each
   byte depth that is a multiple of 20, with its members, children, leaves and saved tokens in that range.
3. Nodes above a range boundary come out of several tasks.  The last string before a range and the first one after it tell
   a task which of its nodes another task has counted and whether its last string is childless; with that all
   numbers are sums, and a grouping by node adds them.  A first turn that a third of all conversations share is
   thus cut over many tasks.
4. The ids that end in a node are sorted by range partitioning, joined to texts of bounded size, and hashed in order.

Defined cases: rows with a null conv_id belong to no conversation and are ignored; null role or text is empty; turns are ordered by
turn (null first), equal turns by their id; repeated rows are turns of their own; c - c % 100 truncates towards
zero; an empty table has no nodes; other columns are ignored.  One conversation is a record of 20 bytes a turn.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricewire.llm.common import saved, small

ID_BYTES = 20
HASH_BYTES = 16
RANGE_BYTES = 32 << 20   # of distinct strings that a task's tree holds
CHUNK_IDS = 4096         # conversation ids joined to one text
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


# ----------------------------------------------------------------- trees
class Node:
    """A radix-tree node: compressed path, children by next byte, and what ends here.

    The layout follows the number of children: 4 or 16 byte/child pairs, 48 children behind an index of 256 bytes, or
    256 children.
    """
    __slots__ = ("path", "layout", "index", "kids", "count", "low")

    def __init__(self, path: bytes) -> None:
        self.path, self.count, self.low = path, 0, None
        self.layout, self.index, self.kids = 4, bytearray(), []

    def child(self, byte: int) -> Node | None:
        if self.layout <= 16:
            at = self.index.find(byte)
            return self.kids[at] if at >= 0 else None
        if self.layout == 48:
            at = self.index[byte]
            return self.kids[at - 1] if at else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds or replaces the child of a byte, growing the layout when it is full."""
        if self.layout <= 16:
            at = self.index.find(byte)
            if at >= 0:
                self.kids[at] = kid
                return
            if len(self.kids) < self.layout or self.layout == 4:
                self.layout = 16 if len(self.kids) == 4 else self.layout
                self.index.append(byte)
                self.kids.append(kid)
                return
            index = bytearray(256)
            for n, b in enumerate(self.index):
                index[b] = n + 1
            self.layout, self.index = 48, index
        if self.layout == 48:
            at = self.index[byte]
            if at:
                self.kids[at - 1] = kid
                return
            if len(self.kids) < 48:
                self.kids.append(kid)
                self.index[byte] = len(self.kids)
                return
            kids: list = [None] * 256
            for b, n in enumerate(self.index):
                if n:
                    kids[b] = self.kids[n - 1]
            self.layout, self.index, self.kids = 256, bytearray(), kids
        self.kids[byte] = kid

    def children(self) -> list[tuple[int, Node]]:
        """(byte, child) in the order of the bytes."""
        if self.layout <= 16:
            return sorted(zip(self.index, self.kids, strict=True), key=lambda x: x[0])
        if self.layout == 48:
            return [(b, self.kids[n - 1]) for b, n in enumerate(self.index) if n]
        return [(b, k) for b, k in enumerate(self.kids) if k is not None]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def insert(root: Node, key: bytes, count: int, low: int) -> None:
    """Adds ``count`` conversations with smallest id ``low`` that end at ``key``."""
    node, at = root, 0
    while True:
        rest = key[at:at + len(node.path)]
        same = _common(rest, node.path)
        if same < len(node.path):  # split the path: the old node hangs below its common part
            old = Node(node.path[same + 1:])
            old.layout, old.index, old.kids, old.count, old.low = node.layout, node.index, node.kids, node.count, node.low
            byte = node.path[same]
            node.path, node.count, node.low = node.path[:same], 0, None
            node.layout, node.index, node.kids = 4, bytearray(), []
            node.put(byte, old)
        at += same
        if at == len(key):
            node.count += count
            node.low = low if node.low is None else min(low, node.low)
            return
        kid = node.child(key[at])
        if kid is None:
            kid = Node(key[at + 1:])
            node.put(key[at], kid)
            kid.count, kid.low = count, low
            return
        node, at = kid, at + 1


def walk(root: Node, before: bytes | None, after: bytes | None, id_bytes: int = ID_BYTES) -> Iterator[tuple]:
    """(node, parent, depth, low, parent_low, count, children, leaves, saved) of each turn-aligned depth, children first.

    ``before`` and ``after`` are the strings next to the tree's range.  parent_low is None where another tree may hold
    members of the parent.  Node ids are SHA-256 prefixes of the path.
    """
    path = bytearray()
    frames: list[list] = []  # [hash, node id, low, count, children, leaves, saved, owned, in another tree]

    def elsewhere(n: int) -> tuple[bool, bool]:
        prefix = bytes(path[:n])
        left = before is not None and before.startswith(prefix)
        return left, left or (after is not None and after.startswith(prefix))

    def open_frame(n: int) -> None:
        h = frames[-1][0].copy() if frames else hashlib.sha256()
        if n:
            h.update(path[n - id_bytes:n])
        near = not frames or frames[-1][8]  # only below a node that other trees share can a node be shared
        left, both = elsewhere(n) if near else (False, False)
        frames.append([h, h.digest()[:HASH_BYTES], None, 0, 0, 0, 0, not left, both])

    def close_frame() -> list:
        depth = len(frames) - 1
        _, node, low, count, children, leaves, gain, owned, _both = frames.pop()
        if depth:
            chars = int.from_bytes(path[depth * id_bytes - (id_bytes - HASH_BYTES):depth * id_bytes], "big")
            gain += (count - owned) * chars
            up = frames[-1]
            up[2] = low if up[2] is None else min(up[2], low)
            up[3] += count
            up[4] += owned
            up[5] += leaves
            up[6] += gain
            return [node, up[1], depth, low, up, count, children, leaves, gain]
        return [node, None, 0, low, None, count, children, leaves, gain]

    waiting: dict[int, list] = {}  # closed nodes whose parent's smallest id is not known yet, by depth of the parent
    stack: list[tuple] = [(root, None, 0)]
    while stack:
        node, byte, kept = stack.pop()
        if node is None:  # leave: ``kept`` frames stay open, ``byte`` bytes of path
            while len(frames) > kept:
                at_depth = len(frames) - 1
                row = close_frame()
                for r in waiting.pop(at_depth, ()):
                    r[4] = None if r[4][8] else row[3]
                    yield tuple(r)
                if at_depth:
                    waiting.setdefault(at_depth - 1, []).append(row)
                else:
                    yield tuple(row)
            del path[byte:]
            continue
        stack.append((None, len(path), len(frames)))
        if byte is not None:
            path.append(byte)
        path += node.path
        while len(frames) * id_bytes <= len(path):
            open_frame(len(frames) * id_bytes)
        if node.count:
            top = frames[-1]
            top[2] = node.low if top[2] is None else min(top[2], node.low)
            top[3] += node.count
            if not node.kids and not (after is not None and after.startswith(bytes(path))):
                top[5] += 1
        for b, kid in reversed(node.children()):
            stack.append((kid, b, 0))


# ---------------------------------------------------------- conversations
def _turn_id(role: Column, text: Column) -> Column:
    """40 hex digits: 16 bytes of a hash of role and text, 4 bytes of the text's length in code points."""
    both = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.upper(F.substring(F.sha2(both, 256), 1, 2 * HASH_BYTES)), F.lpad(F.hex(F.char_length(text)), 8, "0"))


def rebuilt(table: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> (conv_id, key): the turn ids of each rebuilt conversation, joined."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = table.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), F.unhex(_turn_id(role, text)).alias("id")).alias("t"))
    own = turns.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.hex(t["id"])).alias("ids"))
    own = saved(own)
    head = own.filter("conv_id % 100 = 0").select(F.col("conv_id").alias("base"), F.slice("ids", 1, 5).alias("head"))
    none = F.array().cast("array<string>")
    h = (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int")
    d = own.withColumn("base", F.expr("conv_id - conv_id % 100")).join(head, "base", "left").withColumn("h", h)
    first = F.when(F.col("h") > 0, F.slice(F.coalesce("head", none), F.lit(1), F.greatest("h", F.lit(1)))).otherwise(none)
    rest = F.filter("ids", lambda _x, i: i >= F.col("h"))
    return d.select("conv_id", F.unhex(F.array_join(F.concat(first, rest), "")).alias("key"))


def _node_id(key: str) -> Column:
    return F.unhex(F.substring(F.sha2(F.col(key), 256), 1, 2 * HASH_BYTES))


def trie_nodes(convs: DataFrame, ranges: int | None = None) -> DataFrame:
    """(conv_id, key) -> one row per trie node: node, parent, depth, low, parent_low, count, children, leaves, gain."""
    keys = saved(convs.groupBy("key").agg(F.min("conv_id").alias("low"), F.count(F.lit(1)).alias("count")))
    if ranges is None:
        total = keys.agg(F.sum(F.length("key"))).first()[0] or 0
        ranges = max(1, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES))
    cut = saved(keys.repartitionByRange(ranges, "key").withColumn("part", F.spark_partition_id()))
    ends = cut.groupBy("part").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    by = Window.orderBy("part")  # one row per range
    ends = ends.select("part", F.col("first").alias("key"), F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))

    def plant(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root, before, after, empty = Node(b""), None, None, True
        for batch in batches:
            for key, low, count, b, a in batch.itertuples(index=False):
                insert(root, bytes(key), count, low)
                before, after, empty = b if b is not None else before, a if a is not None else after, False
        rows: list = []
        for row in walk(root, before, after) if not empty else ():
            rows.append(row)
            if len(rows) == 10_000:
                yield pd.DataFrame(rows, columns=names, dtype=object)
                rows = []
        yield pd.DataFrame(rows, columns=names, dtype=object)
    names = ["node", "parent", "depth", "low", "parent_low", "count", "children", "leaves", "gain"]
    marked = cut.join(F.broadcast(ends), ["part", "key"], "left").select("key", "low", "count", "before", "after")
    parts = marked.mapInPandas(plant, "node binary, parent binary, depth long, low long, parent_low long, count long, "
                                      "children long, leaves long, gain long")
    merged = saved(parts.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("low").alias("low"),
        F.max("parent_low").alias("parent_low"), *[F.sum(c).alias(c) for c in ("count", "children", "leaves", "gain")]))
    # A parent that several ranges share has its smallest id only now; such nodes lie on the ranges' boundaries.
    open_ = merged.filter("parent_low is null and depth > 0").select(F.col("parent").alias("node")).distinct()
    tops = small(saved(merged.join(open_, "node", "left_semi").select(F.col("node").alias("parent"), F.col("low").alias("top"))))
    return merged.join(tops, "parent", "left").withColumn("parent_low", F.coalesce("parent_low", "top")).drop("top")


def ends_hashes(convs: DataFrame) -> DataFrame:
    """(conv_id, key) -> (node, ends): SHA-256 of the ascending, comma-joined ids of the conversations that end in a node."""
    ids = convs.select(_node_id("key").alias("node"), "conv_id")

    def chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, held = None, []
        for batch in batches:
            done = []
            for n, c in batch.itertuples(index=False):
                if n != node or len(held) == CHUNK_IDS:
                    if held:
                        done.append((node, held[0], ",".join(map(str, held))))
                    node, held = n, []
                held.append(c)
            yield pd.DataFrame(done, columns=["node", "start", "ids"])
        if held:
            yield pd.DataFrame([(node, held[0], ",".join(map(str, held)))], columns=["node", "start", "ids"])

    def hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            done = []
            for n, ids in batch.itertuples(index=False):
                if n != node:
                    if node is not None:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends"])
        if node is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends"])
    texts = (ids.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
             .mapInPandas(chunks, "node binary, start long, ids string"))
    return (texts.repartition("node").sortWithinPartitions("node", "start").select("node", "ids")
            .mapInPandas(hashes, "node binary, ends string"))


def prefix_trie(table: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    convs = saved(rebuilt(table))
    nodes = trie_nodes(convs, ranges)
    d = nodes.join(ends_hashes(convs), "node", "left")
    return d.select(F.col("low").alias("conv_id"), "depth", F.col("parent_low").alias("parent_conv_id"), F.col("count").alias("n_convs"),
                    F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("gain").alias("saved_tokens"),
                    F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))
