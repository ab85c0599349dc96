"""The trie of conversations by their first turns, and what sharing prefixes saves.

A node is a distinct sequence of first turns. It belongs to its member with the
smallest conv_id; as members of a deeper node are members of those above, what a
conversation owns is the end of its path, a suffix. So every node is counted once, by its owner, without
building the tree: along each path, running sums from its end count
the words of nodes that others own, the owned nodes, and whether the path
ends in a leaf of its own. One grouping by prefix adds these up: words of all
occurrences below a node less those of owned ones are what sharing saves there.

Texts become a digest and a number of words before the first shuffle. A
prefix is named by the exclusive or of hashes of its turns and their places, a running
aggregate too. Running aggregates go in chunks of turns and over these, and rows get their places from ranges of
(conv_id, turn), so neither one endless conversation nor a prefix that all share is gathered in a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import NOT_SPACE_CLASS, lookup, map_batches, materialise

#: Turns of a conversation that one task adds up.
CHUNK = 4096
#: Ids are joined to texts of so many before they are digested.
IDS_AT_ONCE = 4096


def running(rows: DataFrame, sums: dict[str, Column], backwards: bool = False, xor: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Adds running sums (or exclusive ors) along each conv_id by depth, the row's own included; ``backwards`` from the end.

    Within chunks of depths, and for conversations with several chunks also over these.
    """
    total = F.bit_xor if xor else F.sum
    rows = rows.withColumns({"_chunk": F.floor(F.col("depth") / chunk), **{f"_{n}": c for n, c in sums.items()}})
    order = (lambda c: F.col(c).desc()) if backwards else F.col
    long = rows.where(F.col("depth") >= chunk).select("conv_id").distinct()
    chunks = rows.join(long, "conv_id", "left_semi").groupBy("conv_id", "_chunk").agg(*[total(f"_{n}").alias(f"_{n}") for n in sums])
    before = Window.partitionBy("conv_id").orderBy(order("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(chunks.select("conv_id", "_chunk", *[F.coalesce(total(f"_{n}").over(before), F.lit(0)).alias(f"_{n}_before") for n in sums]), "chunk-offsets")
    within = Window.partitionBy("conv_id", "_chunk").orderBy(order("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({n: total(f"_{n}").over(within) for n in sums}).join(offsets, ["conv_id", "_chunk"], "left")
    both = {n: (F.col(n).bitwiseXOR(F.coalesce(f"_{n}_before", F.lit(0))) if xor else F.col(n) + F.coalesce(f"_{n}_before", F.lit(0))) for n in sums}
    return rows.withColumns(both).drop("_chunk", *[f"_{n}" for n in sums], *[f"_{n}_before" for n in sums])


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words) of each turn, places from 1 in the order of turn (null first), then of the digest."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(NOT_SPACE_CLASS + "+")).cast("bigint").alias("words"))
    rows = materialise(rows.where("conv_id IS NOT NULL"), "turns")
    # rows that are equal in all of these are alike, so that any number may part them
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    dealt = rows.withColumn("_any", F.xxhash64(F.monotonically_increasing_id())).repartitionByRange(*order, F.col("_any")).drop("_any")
    dealt = materialise(dealt.withColumn("part", F.spark_partition_id()), "turns-by-conversation")
    sizes = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("k"))
    parts = Window.partitionBy("conv_id")
    sizes = sizes.withColumns({"before": F.sum("k").over(parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), "many": F.count("*").over(parts)})
    # only conversations that span ranges have one; there are fewer of these than ranges, and a row for each range of theirs
    before = materialise(sizes.where("before IS NOT NULL").select("conv_id", "part", "before"), "turns-before")
    own = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest"))
    placed = dealt.withColumn("own", own).join(before, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).alias("place"), "digest", "words")


def rebuilt_turns(turns: DataFrame, group: int = 20, heads: int = 4) -> DataFrame:
    """(conv_id, depth, digest, words, last): turns of every rebuilt conversation, and for each a row of depth 0; ``last`` is its length.

    The first h turns are those of conversation c - c % group (none if there is none), with h = crc32(c) % heads;
    the conversation's own ones after its first h follow.
    """
    placed = materialise(numbered_turns(turns), "placed")
    sizes = placed.groupBy("conv_id").agg(F.count("*").alias("n"))
    sizes = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % group, "h": F.crc32(F.col("conv_id").cast("string")) % heads})
    of_base = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = sizes.join(of_base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))  # fewer than 2 * group for each base
    convs = materialise(convs.withColumn("last", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "last", "n"), "conversations")
    first = placed.where(F.col("place") < heads).select(F.col("conv_id").alias("base"), "place", "digest", "words")
    borrowed = convs.join(first, "base").where(F.col("place") <= F.col("taken")).select("conv_id", F.col("place").alias("depth"), "digest", "words", "last")
    own = lookup(placed, convs.select("conv_id", "h", "taken", "last", "n"), "conv_id", placed.count()).where(F.col("place") > F.col("h"))
    own = own.select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("depth"), "digest", "words", "last")
    roots = convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("words"), "last")
    return own.unionByName(borrowed).unionByName(roots)


def prefix_trie(turns: DataFrame, group: int = 20, heads: int = 4, chunk: int = CHUNK) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row for each node of the trie of rebuilt conversations.

    ``turns`` has conv_id, turn, role and text. A null role or text is empty, texts
    count whole; null turns come first, and turns of one number are in the order of the md5 of their content. Repeated
    rows are repeated turns. Rows with a null conv_id belong to no conversation. A rebuilt
    conversation may be turnless; it is a member of the root. Other columns are left aside, whatever their names; an empty
    table gives no nodes, not even a root.
    """
    rows = materialise(rebuilt_turns(turns, group, heads), "rebuilt")
    hashes = {"k1": F.when(F.col("depth") > 0, F.xxhash64("depth", "digest")).otherwise(0), "k2": F.when(F.col("depth") > 0, F.xxhash64("digest", F.lit("second"), "depth")).otherwise(0)}
    paths = running(rows, hashes, xor=True, chunk=chunk)
    above = [F.col(n).bitwiseXOR(c) for n, c in hashes.items()]
    # the depth keeps nodes of different depths apart, and a child from its parent
    node = F.struct(F.col("depth").alias("d"), "k1", "k2").alias("node")
    parent = F.when(F.col("depth") > 0, F.struct((F.col("depth") - 1).alias("d"), above[0].alias("k1"), above[1].alias("k2"))).alias("parent")
    paths = materialise(paths.select("conv_id", "depth", "words", "last", node, parent), "paths")
    owners = paths.groupBy("node").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n"), F.bool_or(F.col("depth") < F.col("last")).alias("inner"))
    seen = lookup(paths, materialise(owners, "owners"), "node", paths.count())
    owned = F.col("owner") == F.col("conv_id")
    seen = seen.select("conv_id", "depth", "last", "node", "parent", owned.cast("long").alias("is_owned"), F.when(owned, 0).otherwise(F.col("words")).alias("shared"), (owned & ~F.col("inner")).cast("long").alias("is_leaf"))
    seen = running(seen, {"saved": F.col("shared"), "leaf": F.col("is_leaf"), "owned": F.col("is_owned")}, backwards=True, chunk=chunk)
    # what is owned is a suffix: the next node is owned if all that follow are
    child = (F.col("depth") < F.col("last")) & (F.col("owned") - F.col("is_owned") == F.col("last") - F.col("depth"))
    nodes = seen.groupBy("node").agg(
        F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.count("*").alias("n_convs"), F.sum(child.cast("long")).alias("n_children"),
        F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"),
    )
    nodes = materialise(nodes, "nodes")
    parents = materialise(nodes.where("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "parents")
    under = lookup(nodes.where("parent IS NOT NULL"), parents, "parent", nodes.count())
    top = nodes.where("parent IS NULL").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    ends = digests(paths.where("depth = last").select("node.d", "node.k1", "node.k2", "conv_id"))
    ends = ends.select(F.struct("d", "k1", "k2").alias("node"), "ends_sha256")
    out = under.unionByName(top.select(*under.columns)).join(ends, "node", "left")
    return out.select("conv_id", F.col("node.d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


_NODE = ("d", "k1", "k2")


def digests(ends: DataFrame) -> DataFrame:
    """(d, k1, k2, ends_sha256): SHA-256 of each node's conv_ids, ascending and joined by commas.

    Ranges of (node, conv_id) join ids to texts of at most IDS_AT_ONCE; each node's texts, in
    order, are then read as a stream, so no list of ids is ever whole in memory.
    """
    key = [*_NODE, "conv_id"]
    sorted_ = ends.select(*key).repartitionByRange(*key).sortWithinPartitions(*key)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            node = np.stack([batch.column(i).to_numpy() for i in range(3)], axis=1)
            ids = batch.column(3).to_numpy()
            cuts = np.flatnonzero((node[1:] != node[:-1]).any(axis=1)) + 1
            starts, stops = np.append(0, cuts), np.append(cuts, len(ids))
            texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(starts, stops, strict=True)]
            columns = [pa.array(node[starts, i]) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(ids[starts]), pa.array(texts, pa.string())], names=[*key, "ids"])

    texts = materialise(map_batches(sorted_, join, "d long, k1 long, k2 long, conv_id long, ids string", IDS_AT_ONCE), "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for batch in batches:
            done: list[tuple] = []
            for d, k1, k2, ids in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if (d, k1, k2) == at:
                    state.update(b"," + ids.encode())
                else:
                    if at is not None:
                        done.append((*at, state.hexdigest()))
                    at, state = (d, k1, k2), hashlib.sha256(ids.encode())
            yield _digest_rows(done)
        if at is not None:
            yield _digest_rows([(*at, state.hexdigest())])

    return map_batches(texts.repartition(*_NODE).sortWithinPartitions(*key), digest, "d long, k1 long, k2 long, ends_sha256 string", IDS_AT_ONCE)


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([*[pa.array(list(c), pa.int64()) for c in columns[:3]], pa.array(list(columns[3]), pa.string())], names=[*_NODE, "ends_sha256"])
