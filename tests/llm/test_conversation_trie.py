"""The conversations' trie against a plain dictionary of prefixes, over many shards and on odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tests.oracle import assert_same
from tracefold.llm import conversation_trie as trie

FOLDER = "/root/testdata/sf0.001"
KIND = "conv_id long, turn long, role string, text string, path string, node string, shard int, ends string"


def turns(spark, rows):
    """Turns with extra columns that are called like the operator's own."""
    return spark.createDataFrame([(*r, "p", "n", 7, "e") for r in rows], KIND)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, key), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 6 for c in own}
    return {c: own.get(c - c % 100, [])[: h[c]] + v[h[c] :] for c, v in own.items()}


def brute(convs):
    members, ends = {}, {}
    for c, path in convs.items():
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
        ends.setdefault(tuple(path), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(p[-1][1]) if p else 0
        below = [out[k] for k in kids.get(p, [])]
        leaves, saved = sum(x[5] for x in below) or 1, own + sum(x[6] for x in below)
        digest = hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, [])), leaves, saved, digest)
    return sorted(map(str, out.values()))


def got(seqs):
    cols = ["conv", "depth", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    return sorted(str(tuple(r)) for r in trie.prefix_trie(seqs).select(cols).collect())


def test_matches_sql(spark):
    assert_same(trie.QUERIES["op13_conversation_trie"](spark, FOLDER), trie.SQL["op13_conversation_trie"], FOLDER)


@pytest.mark.parametrize("parts", ["1", "13"])
def test_against_brute_force(spark, parts):
    """Hot first turns, deep common prefixes, prefixes that end inside others, a third of all conversations equal; over one shard and many."""
    rng, rows = random.Random(4), []
    deep = [f"deep {i}" for i in range(40)]
    for c in range(300):
        kind = c % 3
        said = ["hello", "same", "end"] if kind == 0 else deep[: rng.randint(0, 40)] + [f"x{rng.randint(0, 3)}"] if kind == 1 else [rng.choice("abé") * rng.randint(1, 3) for _ in range(rng.randint(1, 9))]
        rows += [(c, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(said)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        seqs = trie.sequences(turns(spark, rows))
        assert got(trie.rebuilt(seqs)) == brute(rebuilt(rows))
        plain = {}
        for c, _, role, text in rows:
            plain.setdefault(c, []).append((role, text))
        assert got(seqs) == brute(plain)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_odd_rows(spark):
    """Nulls in every column, repeated rows, ties in turn, absent bases, turnless conversations, a key below zero."""
    rows = [(7, None, None, None), (7, 1, "user", "a"), (7, 1, "user", "a"), (7, 1, "user", "b"), (None, 1, "user", "lost"), (105, 0, "user", "x"), (105, 1, "", ""), (-3, 0, "u", "é" * 1000)]
    rows += [(c, 0, "user", "only") for c in range(300, 330)] + [(500, i, "user", "z" * i) for i in range(300)] + [(501, i, "user", "z" * i) for i in range(299)]
    assert got(trie.rebuilt(trie.sequences(turns(spark, rows)))) == brute(rebuilt(rows))
    assert trie.prefix_trie(trie.sequences(turns(spark, rows).limit(0))).count() == 0
    with pytest.raises(TypeError):
        trie.sequences(turns(spark, rows).withColumn("conv_id", F.lit("a")))


def test_lists_longer_than_a_block(spark):
    """Members of one node fill many blocks and partitions; the hash is that of the whole list."""
    pairs = spark.range(5000).select(F.lit("hot").alias("node"), (F.col("id") * 7 - 9).alias("conv")).unionByName(spark.createDataFrame([("cold", 5), ("cold", -1)], "node string, conv long"))
    want = {"hot": ",".join(str(i * 7 - 9) for i in range(5000)), "cold": "-1,5"}
    assert {r.node: r.ends for r in trie.members_sha256(pairs).collect()} == {k: hashlib.sha256(v.encode()).hexdigest() for k, v in want.items()}
