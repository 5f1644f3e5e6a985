"""The prefix trie of conversations, built from sorted shards that meet in a skeleton of splitter paths.

A conversation is the sequence of its turns, a turn is known by the MD5 of role and text, and a trie node by the MD5 of its turns' hashes. Equal
conversations become one weighted path before anything is sorted. The distinct paths are range-partitioned and sorted, so a node's members are
neighbours: a node lies in one shard, or it is a prefix of the first path ("splitter") of each later shard that it reaches into.

* Skeleton: the trie of the splitter paths. Sorted paths' trie is given by the common prefixes of neighbours, so what is broadcast are three depths a
  shard (shared with the shard before, with the one after, between its own first and last path), whatever the paths' length.
* Shards: one pass over a shard's sorted paths with a stack of open nodes finishes every node that isn't in the skeleton, with its subtree.
* Reduction: a skeleton node gets a partial row from each shard that it lies in. All figures are sums or minima (a node that spans shards is
  counted as a child, and its text subtracted once, in the shard where it begins), so one aggregation by node finishes them.

Lists of members that end at a node are hashed in blocks: pairs (node, conversation) are range-partitioned on both, tasks write the ids of runs
as text, and only these blocks, in order, meet to be hashed, since a SHA-256 is a sequence by nature.

Defined cases: null role and text are empty; rows with a null key belong to no conversation and give nothing; turns of equal place are ordered by
their hash, repeated rows are turns each; an empty table has no nodes, not even a root; keys must be whole numbers. A conversation is one row of some 40
bytes a turn. Input columns that are not named are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracefold.llm.common import stored, table, whole_key

#: Conversation ids in a block of text that is hashed at once; rows of a result batch.
IDS, BATCH = 512, 8192
NODE = "node string, parent string, depth long, conv long, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string, partial boolean"
NO_ENDS = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, items``: a row a conversation, its turns in order (null first) as structs of ``turn, id`` (MD5 of role and text) and ``chars``."""
    said, spoken = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(whole_key(turns, key).alias("conv"), F.col(turn).alias("turn"), F.md5(F.concat_ws(":", F.length(said), F.concat(said, spoken))).alias("id"), F.length(spoken).alias("chars"))
    return rows.where("conv is not null").groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("turn", "id", "chars"))).alias("items"))


def rebuilt(seqs: DataFrame) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % 100; h = crc32(c) % 6."""
    base, h = F.col("conv") - F.col("conv") % 100, (F.crc32(F.col("conv").cast("string")) % 6).cast("int")
    heads = seqs.where(F.col("conv") % 100 == 0).select(F.col("conv").alias("base"), F.slice("items", 1, 5).alias("head"))
    head = F.coalesce(F.slice("head", F.lit(1), h), F.expr("slice(items, 1, 0)"))
    return seqs.withColumn("base", base).join(heads, "base", "left").select("conv", F.concat(head, F.slice("items", h + 1, F.size("items"))).alias("items"))


def common_prefix(a: Column, b: Column) -> Column:
    """Items that two arrays share from their start on; -1 if one is null."""
    place = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(place.isNull(), -1).when(place > 0, place - 1).otherwise(F.size(a)).cast("long")


def _blocks():
    """Of pairs sorted by node and id: the ids of each run as comma-joined text, at most ``IDS`` a row."""
    schema = pa.schema([("node", pa.string()), ("part", pa.int32()), ("seq", pa.int64()), ("ids", pa.string())])

    def run(batches):
        seq = 0
        for batch in batches:
            nodes, convs, parts = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("node", "conv", "part"))
            out, begin = [], 0
            for i in range(1, len(nodes) + 1):
                if i == len(nodes) or nodes[i] != nodes[begin] or i - begin == IDS:
                    out.append((nodes[begin], parts[begin], seq + begin, ",".join(map(str, convs[begin:i]))))
                    begin = i
            seq += len(nodes)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)

    return run


def _hashes():
    """Of blocks sorted by node and place: the SHA-256 of each node's blocks, comma-joined. One hash state is held."""
    schema = pa.schema([("node", pa.string()), ("ends", pa.string())])

    def run(batches):
        node, state = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch.column(batch.schema.get_field_index("node")).to_pylist(), batch.column(batch.schema.get_field_index("ids")).to_pylist(), strict=True):
                if n == node:
                    state.update(b",")
                else:
                    if state:
                        done.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done, strict=True)], schema=schema)
        if state:
            yield pa.RecordBatch.from_arrays([pa.array([node]), pa.array([state.hexdigest()])], schema=schema)

    return run


def members_sha256(pairs: DataFrame) -> DataFrame:
    """``node, ends``: the SHA-256 of each node's ``conv`` in ascending decimals, comma-joined."""
    placed = pairs.select("node", "conv").repartitionByRange("node", "conv").sortWithinPartitions("node", "conv").withColumn("part", F.spark_partition_id())
    blocks = placed.mapInArrow(_blocks(), "node string, part int, seq long, ids string")
    return blocks.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(_hashes(), "node string, ends string")


class _Open:
    """A node on the current path."""

    __slots__ = ("begins", "certain", "chars", "children", "depth", "ends", "hash", "least", "leaves", "n", "pending", "saved", "state")

    def __init__(self, depth, state, chars, begins, certain):
        self.depth, self.state, self.chars, self.begins, self.certain = depth, state, chars, begins, certain
        self.hash, self.n, self.least, self.children, self.leaves, self.saved, self.ends, self.pending = state.hexdigest(), 0, None, 0, 0, 0, None, []


def _shards(bounds: dict[int, tuple[int, int, int]]):
    """Nodes of shards' sorted paths; ``bounds``: depths shared with the shard before and after (-1: none is), and between first and last path."""
    schema = pa.schema([(c, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for c, t in (x.split() for x in NODE.split(", "))])

    def close(stack, out, last, after):
        """Finish the deepest open node; ``last``: the shard ends here."""
        v, up = stack.pop(), stack[-1] if stack else None
        skeleton = v.certain or last and v.depth <= after
        v.leaves += not (v.children or skeleton)
        v.saved += v.n * v.chars - v.chars * v.begins
        row = (v.hash, up.hash if up else None, v.depth, v.least, None, v.n, v.children, v.leaves, v.saved, v.ends, skeleton)
        for x in v.pending:  # children whose parent's figures were still open
            out.append(x if skeleton else (x[0], None, x[2], x[3], v.least, *x[5:]))
        if skeleton or up is None or up.certain:
            out.append(row)
        else:
            up.pending.append(row)
        if up:
            up.n, up.leaves, up.saved = up.n + v.n, up.leaves + v.leaves, up.saved + v.saved
            up.least = v.least if up.least is None else min(up.least, v.least)
            up.children += v.begins

    def run(batches):
        stack, path, shard, out, after = [], [], None, [], -1
        for batch in batches:
            got = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("shard", "path", "chars", "n", "least", "ends")}
            for s, new, chars, n, least, ends in zip(*got.values(), strict=True):
                if s != shard:
                    while stack:
                        close(stack, out, True, after)
                    shard, (before, after, span) = s, bounds[s]
                    first, sure = True, max(before, min(after, span))
                    stack.append(_Open(0, hashlib.md5(), 0, before < 0, sure >= 0))
                    shared = 0
                else:
                    first, shared = False, 0
                    for x, y in zip(path, new, strict=False):
                        if x != y:
                            break
                        shared += 1
                    while len(stack) - 1 > shared:
                        close(stack, out, False, after)
                for d in range(shared + 1, len(new) + 1):
                    state = stack[-1].state.copy()
                    state.update(new[d - 1].encode())
                    stack.append(_Open(d, state, chars[d - 1], not (first and d <= before), first and d <= sure))
                top, path = stack[-1], new
                top.n, top.ends = top.n + n, ends
                top.least = least if top.least is None else min(top.least, least)
                if len(out) >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                    out.clear()
        while stack:
            close(stack, out, True, after)
        for i in range(0, len(out), BATCH):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + BATCH], strict=True), schema.types, strict=True)], schema=schema)

    return run


def prefix_trie(seqs: DataFrame) -> DataFrame:
    """A row a node of the conversations' trie: ``node, depth, conv`` (least member), ``parent_conv, n_convs, n_children, n_leaves, saved, ends``."""
    node = F.md5(F.array_join("path", ""))
    members = stored(seqs.select("conv", F.transform("items", lambda x: x["id"]).alias("path"), F.transform("items", lambda x: x["chars"]).alias("chars")).withColumn("node", node), "members")
    paths = members.groupBy("node", "path", "chars").agg(F.count("*").alias("n"), F.min("conv").alias("least"))
    dealt = paths.join(members_sha256(members), "node").repartitionByRange("path").withColumn("shard", F.spark_partition_id())
    dealt = stored(dealt.drop("node"), "paths")
    edges = dealt.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    beside = Window.orderBy("shard")  # a row a partition
    depths = edges.select(
        "shard", common_prefix(F.col("first"), F.lag("last").over(beside)).alias("before"), common_prefix(F.col("last"), F.lead("first").over(beside)).alias("after"),
        common_prefix(F.col("first"), F.col("last")).alias("span"),
    )
    bounds = {r["shard"]: (r["before"], r["after"], r["span"]) for r in depths.collect()}
    nodes = stored(dealt.repartition("shard").sortWithinPartitions("shard", "path").mapInArrow(_shards(bounds), NODE), "nodes")
    skeleton = nodes.where("partial").groupBy("node", "parent", "depth").agg(
        F.min("conv").alias("conv"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")), F.max("ends").alias("ends")
    )
    skeleton = stored(skeleton, "skeleton")
    parents = skeleton.select(F.col("node").alias("parent"), F.col("conv").alias("parent_conv"))
    out = ["node", "depth", "conv", "parent_conv", "n_convs", "n_children", "n_leaves", "saved", F.coalesce("ends", F.lit(NO_ENDS)).alias("ends")]
    finished = nodes.where("not partial")
    under = finished.where("parent is not null").drop("parent_conv", "partial").unionByName(skeleton.where("parent is not null")).join(parents, "parent")
    roots = skeleton.where("parent is null").withColumn("parent_conv", F.lit(None).cast("long"))
    return finished.where("parent is null").select(out).unionByName(under.select(out)).unionByName(roots.select(out))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = prefix_trie(rebuilt(sequences(table(spark, sf_dir, "conversations"))))
    return nodes.select(F.col("conv").alias("conv_id"), "depth", F.col("parent_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))


#: CRC-32 of the bytes of a text in SQL: the byte table, then one step a byte.
CRC_TABLE = """(SELECT list(v ORDER BY i) AS steps FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END) AS v FROM range(256) t(i)))"""


def crc32_sql(text: str) -> str:
    """DuckDB expression over a text and ``steps`` (from ``CRC_TABLE``)."""
    data = f"list_transform(range(strlen({text})), lambda j: ('0x' || hex({text})[2 * j + 1 : 2 * j + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {data}), lambda a, b: xor(a // 256, steps[xor(a % 256, b) + 1])), 4294967295)"


QUERIES = {"op13_conversation_trie": op13}
SQL = {
    "op13_conversation_trie": f"""
WITH ids AS (SELECT c, {crc32_sql("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id AS c FROM conversations WHERE conv_id IS NOT NULL), {CRC_TABLE}),
items AS (SELECT conv_id AS c, turn, md5(concat_ws(':', length(coalesce(role, '')), coalesce(role, '') || coalesce(text, ''))) AS item, length(coalesce(text, '')) AS n FROM conversations),
turns AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, item) AS place FROM items),
made AS (SELECT i.c, t.place, t.item, t.n FROM ids i JOIN turns t ON t.c = i.c - i.c % 100 AND t.place <= i.h
         UNION ALL SELECT i.c, t.place, t.item, t.n FROM ids i JOIN turns t ON t.c = i.c AND t.place > i.h),
walked AS (SELECT c, row_number() OVER w AS d, n, md5(string_agg(item, '') OVER w) AS node FROM made WINDOW w AS (PARTITION BY c ORDER BY place)),
prefixes AS (SELECT * FROM walked UNION ALL SELECT c, 0, 0, md5('') FROM ids),
nodes AS (SELECT node, d, min(c) AS least, count(*) AS n_convs, any_value(n) AS chars FROM prefixes GROUP BY node, d),
up AS (SELECT a.node, p.node AS over, p.d AS over_d, a.d, a.n_convs, a.chars FROM nodes a JOIN prefixes p ON p.c = a.least AND p.d <= a.d),
kids AS (SELECT over AS node, count(*) AS n FROM up WHERE over_d = d - 1 GROUP BY over),
sums AS (SELECT up.over AS node, sum(CASE WHEN kids.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((up.n_convs - 1) * up.chars) AS saved FROM up LEFT JOIN kids ON kids.node = up.node GROUP BY up.over),
closing AS (SELECT node, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS sha FROM (SELECT c, arg_max(node, d) AS node FROM prefixes GROUP BY c) GROUP BY node)
SELECT a.least AS conv_id, a.d AS depth, b.least AS parent_conv_id, a.n_convs, coalesce(kids.n, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
       coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes a JOIN sums s ON s.node = a.node LEFT JOIN kids ON kids.node = a.node LEFT JOIN closing e ON e.node = a.node
LEFT JOIN up ON up.node = a.node AND up.over_d = a.d - 1 LEFT JOIN nodes b ON b.node = up.over"""
}
