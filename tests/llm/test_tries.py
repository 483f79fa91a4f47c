from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from fingerloom.llm import tries
from fingerloom.llm.queries import QUERIES, rebuilt

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth string, node string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "d", "n") for r in rows], SCHEMA)


def original(rows):
    out = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            out[c].append((turn is not None, turn, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in out.items()}


def brute_rebuilt(rows):
    own, out = original(rows), {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def brute(paths):
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(set)
    for node in members:
        if node:
            children[node[:-1]].add(node)

    out = []
    for node, ids in members.items():
        leaves = saved = 0
        todo = [node]
        while todo:
            x = todo.pop()
            leaves += not children[x]
            saved += (len(members[x]) - 1) * (len(x[-1][1].encode()) if x else 0)
            todo += children[x]
        ends = ",".join(str(c) for c in sorted(ids) if len(paths[c]) == len(node))
        out.append((min(ids), len(node), min(members[node[:-1]]) if node else None, len(ids), len(children[node]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted([tuple(r[n] for n in names) for r in df.collect()], key=str)


def items(paths, spark):
    rows = [(c, [(hashlib.sha256(repr(t).encode()).digest()[:16], len(t[1].encode())) for t in path]) for c, path in paths.items()]
    return spark.createDataFrame(rows, f"conv_id bigint, items {tries.ITEMS}")


@pytest.mark.parametrize(("batches", "seed"), [(1, 1), (3, 2), (5, 3)])
def test_random_paths(spark, batches, seed):
    """Few kinds of turns, so that paths share, split and end inside each other's edges."""
    rng = random.Random(seed)
    long = [("user", rng.choice("ab") + "é") for _ in range(40)]
    paths = {}
    for c in range(120):
        cut = rng.randint(0, 40)
        paths[3 * c - 50] = long[:cut] + [("user", rng.choice("abc")) for _ in range(rng.randint(0, 6))] if rng.random() < 0.7 else [("x", rng.choice("ab"))] * rng.randint(0, 9)
    assert got(tries.prefix_trie(items(paths, spark), batches=batches)) == brute(paths)


def test_fat_binary_search_joins_log_times(spark):
    """(a, b] has one number with the most trailing zeros."""
    from pyspark.sql import functions as F

    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)]
    df = spark.createDataFrame(pairs, "a bigint, b bigint").select("a", "b", tries.two_fattest(F.col("a"), F.col("b")).alias("f"))
    for r in df.collect():
        assert r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x)


def conversations(seed=7):
    rng = random.Random(seed)
    rows = []
    for c in [*range(40), -7, -10, 1000, 1001, 10**12]:
        for turn in range(rng.randint(1, 14)):
            rows.append((c, rng.choice([turn, turn, None]) if turn == 0 else turn, rng.choice(["user", "assistant", None, ""]), rng.choice(["hello", "Ünïcode", "", None, f"own {c}"])))
    rows += [(None, 0, "user", "nobody's"), (2000, None, None, None)]
    rows += [(3000 + 5 * k, t, "user", f"common {t}") for k in range(50) for t in range(3)]
    rng.shuffle(rows)
    return rows


def test_query_rows(spark):
    rows = conversations()
    assert got(tries.prefix_trie(rebuilt(frame(spark, rows).repartition(5)))) == brute(brute_rebuilt(rows))


def test_query_on_the_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op12_conversation_prefix_trie"](spark, sf)) == brute(brute_rebuilt(rows))


def test_repeats_ties_and_long_paths(spark):
    rows = [(1, 0, "user", "a")] * 3 + [(2, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "b")]
    found = {r.conv_id: len(r["items"]) for r in tries.sequences(frame(spark, rows)).collect()}
    assert found == {1: 3, 2: 3}
    again = [rows[k] for k in (5, 4, 3, 2, 1, 0)]
    assert sorted(map(str, tries.sequences(frame(spark, rows)).collect())) == sorted(map(str, tries.sequences(frame(spark, again)).collect()))
    paths = {1: [("u", str(k % 7)) for k in range(3000)], 2: [("u", str(k % 7)) for k in range(2999)] + [("u", "x")], 3: []}
    assert got(tries.prefix_trie(items(paths, spark))) == brute_long(paths)


def brute_long(paths):
    """Three paths: two of 3,000 turns that part at the last, one without turns."""
    none = hashlib.sha256(b"").hexdigest()
    size = [len(t[1]) for t in paths[1]]
    out = [(1, 0, None, 3, 1, 2, sum(size[:2999]), hashlib.sha256(b"3").hexdigest())]
    for d in range(1, 3000):
        out.append((1, d, 1, 2, 1 if d < 2999 else 2, 2, sum(size[d - 1:2999]), none))
    out += [(c, 3000, 1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest()) for c in (1, 2)]
    return sorted(out, key=str)


def test_empty_table(spark):
    assert tries.prefix_trie(rebuilt(frame(spark, [(1, 0, "u", "t")]).limit(0))).collect() == []
