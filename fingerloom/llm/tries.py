"""Prefix trie of conversations: a Z-fast trie in tables.

A conversation is a path of turns, and a prefix is known by a chained 128-bit hash (BLAKE2b) of its turns. The trie is compacted: a row
stands for a branching point, or for a place where a path ends, with the whole edge above it. Nodes are found by hash at their handle, the
prefix at the two-fattest depth of their edge. A batch of paths finds the deepest nodes it runs through by fat binary search, one
equality join for each halving, all paths at once; where a path leaves the trie inside an edge, the edge is split, and what is beyond
becomes new nodes, counted over the batch. Edges are expanded to a row for each depth at the very end.

Equal paths enter once, with their number. A path adds its weight to the compacted nodes it runs through, and what is saved below a node is
added up by the paths that own it, so hot prefixes combine before every shuffle, and no group is gathered but a path's own nodes.

Defined results: turns are ordered by turn, NULL first, then by a hash of role and text; NULL role and text are empty; rows without a
conversation id belong to no conversation; repeated rows are turns of their own; an empty table gives no rows; extra columns are
ignored. A conversation is one unit of memory, by 24 bytes a turn; texts never leave the scan. The ids that end at one node are joined in
parallel blocks and hashed one block after the other, as SHA-256 has it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fingerloom.session import materialized

BATCHES = 3
ROOT = bytes(16)
BLOCK_IDS = 100_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
ITEMS = "array<struct<h:binary,n:bigint>>"
_NODE = "name binary, parent binary, p bigint, e bigint, edge array<binary>, sizes array<bigint>"


def sequences(conversations: DataFrame, *, id_column: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, items): each conversation's turns in order, as their hashes and UTF-8 bytes of text."""
    blank = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(blank(role)).cast("string"), F.lit(":"), blank(role), blank(text))
    turns = conversations.where(F.col(f"`{id_column}`").isNotNull()).select(
        F.col(f"`{id_column}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.substring(F.unhex(F.sha2(whole, 256)), 1, 16).alias("h"),
        F.octet_length(blank(text)).cast("bigint").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("turn", "h", "n")))
    return turns.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["h"].alias("h"), t["n"].alias("n"))).alias("items"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The chained hash of every prefix of every path."""
    for batch in batches:
        ends, paths, sizes = [], [], []
        for items in batch.column("items").to_pylist():
            at, path = ROOT, []
            for item in items or ():
                at = hashlib.blake2b(at + item["h"], digest_size=16).digest()
                path.append(at)
            ends.append(at)
            paths.append(path)
            sizes.append([item["n"] for item in items or ()])
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(ends, pa.binary()), pa.array(paths, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int64()))],
                                         names=["conv_id", "seq", "path", "sizes"])


def two_fattest(a: Column, b: Column) -> Column:
    """The number in (a, b] with the most trailing zeros in binary."""
    top = F.length(F.bin(a.bitwiseXOR(b))) - 1
    return b.bitwiseAND(F.call_function("shiftleft", F.lit(-1).cast("bigint"), top))


def _at(path: Column, depth: Column) -> Column:
    """The hash of the prefix of a depth above 0; NULL beyond the path."""
    return F.get(path, (depth - 1).cast("int"))


def _located(strings: DataFrame, nodes: DataFrame, rounds: int) -> DataFrame:
    """``strings`` with ``a``, the depth of the deepest node they run through, and ``lcp``, how far the trie has them; ``child`` is the node
    whose edge they leave, or end in."""
    handle = _at(F.col("edge"), two_fattest(F.col("p"), F.col("e")) - F.col("p"))
    handles = nodes.where("e > 0").select(handle.alias("handle"), F.col("name").alias("v"), F.col("p").alias("vp"), F.col("e").alias("ve"))
    df = strings.withColumns({"a": F.lit(0).cast("bigint"), "b": F.col("len")})
    for _ in range(rounds):
        f = F.when(F.col("a") < F.col("b"), two_fattest(F.col("a"), F.col("b")))
        df = df.withColumn("f", f).withColumn("wanted", _at(F.col("path"), F.col("f")))
        df = df.join(handles, F.col("wanted") == F.col("handle"), "left")
        through = F.coalesce(_at(F.col("path"), F.col("ve")) == F.col("v"), F.lit(False))
        a = F.when(F.col("v").isNull(), F.col("a")).when(through, F.col("ve")).otherwise(F.col("vp"))
        b = F.when(F.col("f").isNull(), F.col("b")).when(F.col("v").isNull(), F.col("f") - 1).when(through, F.col("b")).otherwise(F.col("vp"))
        df = df.withColumns({"a2": a, "b2": b}).drop("a", "b", "f", "wanted", "handle", "v", "vp", "ve").withColumnsRenamed({"a2": "a", "b2": "b"})
    edges = nodes.where("e > 0").select(F.get("edge", F.lit(0)).alias("first"), F.col("name").alias("child"), F.col("edge").alias("child_edge"))
    df = df.withColumn("wanted", _at(F.col("path"), F.col("a") + 1)).join(edges, F.col("wanted") == F.col("first"), "left")
    # Prefix hashes are equal up to the place where the paths part, so counting the equal ones finds it.
    rest = F.slice("path", (F.col("a") + 1).cast("int"), F.size("child_edge"))
    shared = F.size(F.filter(F.zip_with(rest, "child_edge", lambda x, y: F.coalesce(x == y, F.lit(False))), lambda same: same))
    return df.withColumn("lcp", F.when(F.col("child").isNull(), F.col("a")).otherwise(F.col("a") + shared)).drop("wanted", "first", "child_edge", "b")


def _split(nodes: DataFrame, cuts: DataFrame) -> DataFrame:
    """Nodes whose edges are cut at the depths (child, lcp)."""
    depths = cuts.groupBy("child").agg(F.collect_set("lcp").alias("depths"))
    df = nodes.join(depths, F.col("name") == F.col("child"), "left")
    ends = F.sort_array(F.array_distinct(F.concat(F.coalesce("depths", F.array().cast("array<bigint>")), F.array("e"))))
    pieces = df.withColumn("ends", ends).select("*", F.posexplode("ends").alias("i", "end"))
    start = F.when(F.col("i") == 0, F.col("p")).otherwise(F.get("ends", F.col("i") - 1))
    pieces = pieces.withColumn("start", start)
    part = lambda c: F.slice(c, (F.col("start") - F.col("p") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    above = F.when(F.col("i") == 0, F.col("parent")).otherwise(_at(F.col("edge"), F.col("start") - F.col("p")))
    return pieces.select(_at(F.col("edge"), F.col("end") - F.col("p")).alias("name"), above.alias("parent"), F.col("start").alias("p"), F.col("end").alias("e"),
                         part("edge").alias("edge"), part("sizes").alias("sizes"))


def _grown(located: DataFrame) -> DataFrame:
    """The new nodes beyond the trie: where the batch's paths part or end."""
    beyond = located.where("len > lcp")
    depths = F.explode(F.sequence(F.col("lcp") + 1, F.col("len"))).alias("d")
    rows = beyond.select("c", "len", "path", depths).select("c", "d", _at(F.col("path"), F.col("d")).alias("h"), (F.col("d") == F.col("len")).alias("ends"),
                                                            _at(F.col("path"), F.col("d") + 1).alias("following"))
    found = rows.groupBy("h").agg(F.min("c").alias("owner"), F.max("ends").alias("ends"), F.min("following").alias("low"), F.max("following").alias("high"))
    found = found.where("ends or low <> high").select(F.col("h").alias("name"), "owner")
    own = rows.join(found, F.col("h") == F.col("name")).groupBy("c").agg(F.sort_array(F.collect_list(F.struct("d", (F.col("owner") == F.col("c")).alias("own")))).alias("stops"))
    pieces = beyond.join(own, "c").select("path", "sizes", "lcp", "stops", F.posexplode("stops").alias("i", "stop")).where("stop.own")
    start = F.when(F.col("i") == 0, F.col("lcp")).otherwise(F.get("stops", F.col("i") - 1)["d"])
    pieces = pieces.select("path", "sizes", start.alias("p"), F.col("stop.d").alias("e"))
    part = lambda c: F.slice(c, (F.col("p") + 1).cast("int"), (F.col("e") - F.col("p")).cast("int"))
    above = F.when(F.col("p") == 0, F.lit(ROOT)).otherwise(_at(F.col("path"), F.col("p")))
    return pieces.select(_at(F.col("path"), F.col("e")).alias("name"), above.alias("parent"), "p", "e", part("path").alias("edge"), part("sizes").alias("sizes"))


def compacted(strings: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The compacted nodes of distinct paths (c, len, path, sizes, batch): name, parent, the depths (p, e] of the edge, its hashes and sizes."""
    spark = strings.sparkSession
    longest = strings.agg(F.max("len")).first()[0] or 0
    nodes = spark.createDataFrame([(ROOT, None, -1, 0, [ROOT], [0])], _NODE)
    for batch in range(batches):
        own = strings.where(F.col("batch") == batch)
        located = materialized(_located(own, nodes, int(longest).bit_length() if batch else 0), "trie-located")
        cuts = located.where("child is not null").select("child", "lcp")
        nodes = materialized(_split(nodes, cuts).union(_grown(located)), "trie-nodes")
    return nodes


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a path's own nodes add to all nodes it runs through: saved below each, and leaves at or below it."""
    for batch in batches:
        names, below, leaves = [], [], []
        for stops in batch.column("stops").to_pylist():
            saved = np.array([s["w"] if s["own"] else 0 for s in stops], np.int64)
            ends = np.array([s["own"] and s["leaf"] for s in stops], np.int64)
            under = np.append(np.cumsum(saved[::-1])[::-1][1:], 0)
            down = np.cumsum(ends[::-1])[::-1]
            for k in np.flatnonzero((under != 0) | (down != 0)):
                names.append(stops[k]["name"])
                below.append(int(under[k]))
                leaves.append(int(down[k]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.array(below, pa.int64()), pa.array(leaves, pa.int64())], names=["name", "below", "leaves"])


def _id_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one path, comma-joined, numbered in order."""
    part, number = TaskContext.get().partitionId(), 0
    for batch in batches:
        seqs, ids = batch.column("seq").to_pylist(), batch.column("conv_id").to_pylist()
        out, start = [], 0
        for k in range(1, len(seqs) + 1):
            if k == len(seqs) or seqs[k] != seqs[start] or k - start >= BLOCK_IDS:
                out.append((seqs[start], part, number, ",".join(map(str, ids[start:k]))))
                number, start = number + 1, k
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.int32()), pa.array([r[2] for r in out], pa.int64()),
                                              pa.array([r[3] for r in out], pa.large_string()).cast(pa.string())], names=["seq", "part", "number", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over each path's blocks, which come in order."""
    seq, state = None, None
    for batch in batches:
        out = []
        for own, ids in zip(batch.column("seq").to_pylist(), batch.column("ids").to_pylist()):
            if own != seq:
                if state is not None:
                    out.append((seq, state.hexdigest()))
                seq, state = own, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], names=["seq", "ends_sha256"])
    if state is not None:
        yield pa.RecordBatch.from_arrays([pa.array([seq], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["seq", "ends_sha256"])


def _end_digests(paths: DataFrame) -> DataFrame:
    """(seq, ends_sha256) of every distinct path: its conversations' ids in ascending order."""
    runs = paths.select("seq", "conv_id").repartitionByRange("seq", "conv_id").sortWithinPartitions("seq", "conv_id")
    blocks = runs.mapInArrow(_id_blocks, "seq binary, part int, number bigint, ids string")
    return blocks.repartition("seq").sortWithinPartitions("seq", "part", "number").mapInArrow(_hashed, "seq binary, ends_sha256 string")


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each depth of each edge."""
    names = ["node", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    kinds = [pa.binary(), *[pa.int64()] * 7, pa.string()]
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            n = len(r["edge"])
            saved = r["below"] + (r["n"] - 1) * np.cumsum(np.array(r["sizes"], np.int64)[::-1])[::-1]
            for i in range(n):
                last = i == n - 1
                rows.append((r["edge"][i], r["conv"], r["p"] + 1 + i, r["conv"] if i else r["parent_conv"], r["n"], r["children"] if last else 1, r["leaves"], int(saved[i]),
                             (r["ends_sha256"] or NO_ENDS) if last else NO_ENDS))
            if len(rows) >= 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)


def prefix_trie(conversations: DataFrame, *, batches: int = BATCHES) -> DataFrame:
    """The nodes of all prefixes of (conv_id, items) paths, one row each: ``node`` (hash), conv_id (least member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256."""
    kind = "conv_id bigint, seq binary, path array<binary>, sizes array<bigint>"
    paths = materialized(conversations.select("conv_id", "items").mapInArrow(_paths, kind), "trie-paths")
    members = paths.groupBy("seq").agg(F.count(F.lit(1)).alias("m"), F.min("conv_id").alias("c")).drop("seq")
    batch = F.pmod(F.xxhash64("seq"), F.lit(batches)).alias("batch")
    strings = materialized(paths.join(members, F.col("conv_id") == F.col("c")).select("c", "m", "seq", F.size("path").cast("bigint").alias("len"), "path", "sizes", batch), "trie-strings")
    nodes = compacted(strings, batches)
    # The root is everyone's, so it takes no part in the join.
    through = strings.where("len > 0").select("c", "m", F.posexplode("path").alias("i", "h")).join(nodes.select("name"), F.col("h") == F.col("name"))
    through = through.select("c", "m", "name", (F.col("i") + 1).alias("e")).union(strings.select("c", "m", F.lit(ROOT), F.lit(0)))
    through = materialized(through, "trie-through")
    weights = through.groupBy("name").agg(F.sum("m").alias("n"), F.min("c").alias("conv"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("name")).agg(F.count(F.lit(1)).alias("children"))
    saved = (F.col("n") - 1) * F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, s: a + s)
    stats = nodes.join(weights, "name").join(children, "name", "left").withColumn("children", F.coalesce("children", F.lit(0)).cast("bigint"))
    stats = materialized(stats.withColumn("w", saved), "trie-stats")
    stops = through.join(stats.select("name", "w", "conv", (F.col("children") == 0).alias("leaf")), "name").groupBy("c").agg(
        F.sort_array(F.collect_list(F.struct("e", "name", "w", (F.col("conv") == F.col("c")).alias("own"), "leaf"))).alias("stops"))
    sums = stops.where(F.exists("stops", lambda s: s["own"])).mapInArrow(_shares, "name binary, below bigint, leaves bigint").groupBy("name").agg(
        F.sum("below").alias("below"), F.sum("leaves").alias("leaves"))
    above = stats.select(F.col("name").alias("parent"), F.col("conv").alias("parent_conv"))
    whole = stats.join(sums, "name").join(above, "parent", "left").join(_end_digests(paths), F.col("name") == F.col("seq"), "left")
    return whole.select("p", "edge", "sizes", "n", "conv", "children", "below", "leaves", "parent_conv", "ends_sha256").mapInArrow(
        _expanded, "node binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string")
