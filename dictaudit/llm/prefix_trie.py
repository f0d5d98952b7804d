"""Prefix trie of conversations by ROLLUP over positional turn-id columns (operator 13).

Conversation c is rebuilt from the first h turns of conversation c - c % 20 and its own turns after its
first h (h = crc32(c) % 4). The trie of rebuilt conversations is built eight turns at a time: the turns of
a block stand in columns t1 to t8, and one ``GROUP BY key, ROLLUP (t1, ..., t8)`` aggregates the members
of all prefixes of the block together; ``grouping_id`` tells the depth. A conversation of more than eight
turns goes on in the next block, whose ``key`` is the node that it reached; a node with one member goes no
further, because the rest of its subtree is a chain, one node a turn. Sums over subtrees are a second
ROLLUP, over the nodes, from the last block to the first.

Members are counted before the shuffle, so a first turn that a third of all conversations share is one row
a task. Turns get their positions from a range partitioning by (conversation, turn) and the number of rows
before each partition, so that a very long conversation is dealt over many tasks. The ids that end in a
node are joined page by page, and the pages of a node are hashed one after the other.

Turn ids are md5 digests of role and text together with the number of words.

Defined cases: rows without conversation id belong to no conversation; null role or text is empty; turns
sort by turn (null first), then role, then text, so repeated turns are turns of their own; a conversation
that keeps no turn is a member of the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dictaudit.session import materialize

WIDTH = 8  # turns of a block
GROUP, SHARED = 20, 4  # conversations of a family, and the bound of the turns that they share
PAGE_BYTES = 64 << 10
COLUMNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def positions(turns: DataFrame) -> DataFrame:
    """``turns`` with pos, from 1 in each conversation: rows are counted per partition of a range
    partitioning; what a conversation has in earlier partitions is added."""
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role_text"]
    ranged = materialize(turns.repartitionByRange(*order).sortWithinPartitions(*order)
                         .select("*", F.monotonically_increasing_id().alias("at")), "turns")
    part = F.shiftright("at", 33)
    local = ranged.groupBy("conv_id", part.alias("part")).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    several = local.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi"))
    # only conversations that cross a border of partitions have rows in earlier ones
    crossing = several.where("lo < hi").select("conv_id")
    before = (local.join(crossing, "conv_id", "left_semi").alias("a")
              .join(local.join(crossing, "conv_id", "left_semi").select("conv_id", F.col("part").alias("p"), F.col("n").alias("m")),
                    "conv_id").where("p < part").groupBy("conv_id", "part").agg(F.sum("m").alias("before")))
    offset = local.join(before, ["conv_id", "part"], "left").select(
        "conv_id", "part", (F.coalesce("before", F.lit(0)) - F.col("first") + 1).alias("shift"))
    return (ranged.withColumn("part", part).join(offset, ["conv_id", "part"])
            .withColumn("pos", F.col("at") + F.col("shift")).drop("part", "shift", "at"))


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (conv_id, pos, id, words) of all rebuilt conversations, and their lengths (conv_id, len)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn_id = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    turns = positions(conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.struct(role.alias("role"), text.alias("text")).alias("role_text"),
        turn_id.alias("id"), words.alias("words"))).select("conv_id", "pos", "id", "words")
    turns = materialize(turns, "turns")
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(SHARED))
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n")).withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % GROUP)
    head = turns.where(F.col("pos") < SHARED).select(F.col("conv_id").alias("base"), "pos", "id", "words")
    sizes = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = materialize(own.join(sizes, "base", "left").select(
        "conv_id", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken"),
        (F.least("h", F.coalesce("base_n", F.lit(0))) + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len")), "convs")
    taken = convs.join(head, "base").where("pos <= h").select("conv_id", "pos", "id", "words")
    kept = turns.join(convs.select("conv_id", "h", "taken"), "conv_id").where("pos > h").select(
        "conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id", "words")
    return materialize(taken.union(kept), "turns"), convs.select("conv_id", "len")


def _path(block: int, columns: list[str]) -> F.Column:
    """Digest of a block's number, key and turn ids: names a prefix."""
    return F.md5(F.concat_ws(",", F.lit(str(block)), F.col("key").cast("string"), *[F.col(f"{c}.id") for c in columns]))


def _rollup(spark, rows: DataFrame, what: str) -> DataFrame:
    """``what`` for every prefix of the rows' columns; depth is the number of columns that count."""
    keys = ", ".join(COLUMNS)
    return spark.sql(f"SELECT key, {keys}, {WIDTH} - bit_count(grouping_id()) AS depth, {what} FROM {{rows}} "
                     f"GROUP BY key, ROLLUP ({keys})", rows=rows)


def _real(rolled: DataFrame) -> DataFrame:
    """Prefixes that end with a turn (a shorter path also makes groups at the depths below it)."""
    return rolled.where(F.expr(f"depth = 0 or {' or '.join(f'(depth = {i} and t{i} is not null)' for i in range(1, WIDTH + 1))}"))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    turns, convs = rebuilt(conversations)
    columns = [F.max(F.when(F.col("i") == i, F.struct("id", "words"))).alias(f"t{i}") for i in range(1, WIDTH + 1)]
    wide = materialize(turns.withColumn("block", F.floor((F.col("pos") - 1) / WIDTH)).withColumn("i", (F.col("pos") - 1) % WIDTH + 1)
                       .groupBy("conv_id", "block").agg(*columns), "trie-blocks")
    reached = convs.select("conv_id", "len", F.lit(0).cast("long").alias("key"))
    blocks, ends, chains = [], [], []
    while True:
        b = len(blocks)
        rows = materialize(reached.join(wide.where(F.col("block") == b).drop("block"), "conv_id", "left"), "trie-rows")
        nodes = _real(_rollup(spark, rows.select("key", *COLUMNS, "conv_id"), "min(conv_id) AS conv_id, count(*) AS n_convs"))
        # within a later block depth 0 is the node that the block hangs from
        nodes = nodes if b == 0 else nodes.where("depth > 0")
        last = F.coalesce(*[F.when(F.col("depth") == i, F.col(f"t{i}.words")) for i in range(1, WIDTH + 1)], F.lit(0))
        up = F.coalesce(*[F.when(F.col("depth") == i, _path(b, COLUMNS[:i - 1])) for i in range(1, WIDTH + 1)])
        blocks.append(materialize(nodes.select("*", last.alias("words"), _path(b, COLUMNS).alias("path"), up.alias("up")), "trie-nodes"))
        rows = rows.withColumn("path", _path(b, COLUMNS))
        ends.append(rows.where(F.col("len") <= WIDTH * (b + 1)).select("path", "conv_id"))
        full = blocks[b].where(F.col("depth") == WIDTH).select("path", F.col("conv_id").alias("node"), "n_convs")
        further = materialize(rows.where(F.col("len") > WIDTH * (b + 1)).select("conv_id", "len", "path").join(full, "path"), "trie-further")
        chains.append(further.where("n_convs = 1").select("conv_id", "len", F.lit(WIDTH * (b + 1)).alias("after")))
        reached = further.where("n_convs > 1").select("conv_id", "len", F.col("node").alias("key"))
        if reached.isEmpty():
            break
    return _nodes(spark, blocks, _ends(ends), _union(chains), turns)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _ends(parts: list[DataFrame]) -> DataFrame:
    """(path, ends_sha256): the hash of the joined ids, in order, that end in each prefix."""
    def pages(batches):
        key, first, held, size = None, None, [], 0
        for batch in batches:
            for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if path != key or size >= PAGE_BYTES:
                    if held:
                        yield pa.RecordBatch.from_pydict({"path": [key], "first": [first], "page": [",".join(held)]})
                    key, first, held, size = path, conv, [], 0
                held.append(str(conv))
                size += len(held[-1]) + 1
        if held:
            yield pa.RecordBatch.from_pydict({"path": [key], "first": [first], "page": [",".join(held)]})

    def digests(batches):
        key, digest = None, None
        for batch in batches:
            for path, page in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if path != key:
                    if digest:
                        yield pa.RecordBatch.from_pydict({"path": [key], "ends_sha256": [digest.hexdigest()]})
                    key, digest = path, hashlib.sha256(page.encode())
                else:
                    digest.update(b"," + page.encode())
        if digest:
            yield pa.RecordBatch.from_pydict({"path": [key], "ends_sha256": [digest.hexdigest()]})

    ranged = _union(parts).repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    paged = ranged.mapInArrow(pages, "path string, first long, page string")
    return paged.repartition("path").sortWithinPartitions("path", "first").mapInArrow(digests, "path string, ends_sha256 string")


def _nodes(spark, blocks: list[DataFrame], ends: DataFrame, chains: DataFrame, turns: DataFrame) -> DataFrame:
    none = F.lit(hashlib.sha256(b"").hexdigest())
    chains = materialize(chains, "trie-chains")
    # what hangs below the last column of a block: (node, children, leaves, saved)
    below = chains.select(F.col("conv_id").alias("node"), "after", F.lit(1).cast("long").alias("children"),
                          F.lit(1).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    deeper = below.limit(0)
    found = []
    for b in reversed(range(len(blocks))):
        nodes = blocks[b]
        hung = below.where(F.col("after") == WIDTH * (b + 1)).drop("after").union(deeper.drop("after"))
        children = nodes.where("depth > 0").groupBy(F.col("up").alias("path")).agg(F.count("*").alias("inside"))
        local = nodes.join(children, "path", "left").join(
            hung.withColumn("depth", F.lit(WIDTH)).withColumnRenamed("node", "conv_id"), ["conv_id", "depth"], "left")
        n_children = F.coalesce("inside", F.lit(0)) + F.coalesce("children", F.lit(0))
        local = materialize(local.withColumn("n_children", n_children).withColumn(
            "leaves", F.when(F.col("n_children") == 0, 1).otherwise(F.coalesce("leaves", F.lit(0)))).withColumn(
            "saved", (F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))), "trie-local")
        sums = materialize(_real(_rollup(spark, local.select("key", *COLUMNS, "leaves", "saved"),
                                         "sum(leaves) AS n_leaves, sum(saved) AS saved_tokens"))
                           .withColumn("path", _path(b, COLUMNS)), "trie-sums")
        parent = nodes.select(F.col("path").alias("up"), F.col("conv_id").alias("parent"))
        sure = local.join(sums.where("depth > 0" if b else "true").select("path", "n_leaves", "saved_tokens"), "path")
        sure = sure.join(ends, "path", "left").join(parent, "up", "left")
        up = F.col("parent") if b == 0 else F.when(F.col("depth") == 1, F.col("key")).otherwise(F.col("parent"))
        found.append(sure.select("conv_id", (F.col("depth") + WIDTH * b).cast("long").alias("depth"), up.alias("parent_conv_id"),
                                 "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256")))
        if b:
            first = nodes.where("depth = 1").groupBy(F.col("key").alias("node")).agg(F.count("*").alias("children"))
            total = sums.where("depth = 0").select(F.col("key").alias("node"), F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
            deeper = materialize(first.join(total, "node").select("node", F.lit(0).alias("after"), "children", "leaves", "saved"), "trie-below")
    one = F.lit(1).cast("long")
    tail = turns.join(chains, "conv_id").where("pos > after").select(
        "conv_id", F.col("pos").cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("pos") == F.col("len"), 0).otherwise(1).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("pos") == F.col("len"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    return _union([*found, tail])
