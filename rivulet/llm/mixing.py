"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in shuffled order, served once or, if
its target asks for it, twice. A document's virtual finish time is the number
of its source's words served up to and including it, divided by the source's
target. All finish times are range-sorted over the cluster and cut off where
the running sum of words would pass the budget.

Only narrow rows are sorted: the place of a document in its queue is its hash. As
a source is served in the order of hashes, what the budget admits of it is all
up to one hash for each round of serving. So whole documents need no shuffle; each is
compared with the two hashes of its source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rivulet.llm.common import materialise

def word_count(text: str = "text") -> str:
    """SQL for the number of words of a column, 0 for null."""
    return rf"CAST(regexp_count(coalesce(`{text}`, ''), '[^\\x20\\x09-\\x0D]+') AS BIGINT)"


WORD_COUNT = word_count()
#: Up to so many sources, their table (a few numbers each) is broadcast.
BROADCAST_SOURCES = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), max_repeats: int = 2) -> DataFrame:
    """(source, source_size, rank, target) for every source in ``sizes`` (source, size).

    Sources in code-point order, null last, have ``weights`` in turn. The budget
    is share[0] / share[1] of all words. A target stops at ``max_repeats`` times
    its source's size; what is over goes to the other sources by weight. With
    sources sorted by size over weight, those that stop are the first ones, so
    one running sum finds the common level of the rest. One row for each source
    passes through one task here; documents never do.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = by_source.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())).cast("bigint"))
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("bigint")
    ranked = ranked.withColumn("weight", weight).withColumn("stop", F.col("source_size") * max_repeats)
    order = Window.orderBy(F.col("stop") / F.col("weight"), "rank")
    before, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    a, b = share
    budget = F.sum("source_size").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * a
    filled = ranked.withColumn("level", (budget - F.coalesce(F.sum("stop").over(before), F.lit(0)) * b).cast("double") / (F.sum("weight").over(rest) * b))
    filled = filled.withColumn("open", F.col("level") * F.col("weight") <= F.col("stop"))
    first = F.min(F.when(F.col("open"), F.struct(F.col("stop") / F.col("weight"), F.col("rank"), F.col("level")))).over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = first.getField("level")
    return filled.withColumn("at", level).select("source", "source_size", "rank", F.least(F.col("stop").cast("double"), F.col("at") * F.col("weight")).alias("target"))


def _small(sources: DataFrame, n: int) -> DataFrame:
    return F.broadcast(sources) if n <= BROADCAST_SOURCES else sources


def mix_sources(docs: DataFrame, key: str = "doc_id", seed: int = 42, weights: tuple[int, ...] = (5, 2, 1), share: tuple[int, int] = (3, 2), size: str | None = None, text: str = "text", finish: bool = False) -> DataFrame:
    """Every row of ``docs`` with size, source_size, target, copies (0 to 2) and taken, and with finish if asked for.

    ``docs`` has ``key``, ``source`` and ``text``, whose words are the size (null: 0)
    unless ``size`` names a column that holds it. A null source is a source of its own, the
    last one. Rows without words are never taken and have a null finish. Very long
    texts count whole, so one may hold a large part of its source; whole documents
    are taken, and the one that would pass the budget and all after it are not.
    The order within a source comes from a hash of ``seed``, the key and the text
    alone, so reruns agree; rows that are equal in these have one place in the
    queue and are taken alike. Equal finish times are in the order of the sources. ``finish`` (of the
    first serving) costs a join of all rows by their hash. Other columns stay, save
    those with the names of new ones; an empty table gives none.
    """
    new = ["source_size", "target", "copies", "taken", *(["finish"] if finish else []), *(["size"] if size is None else [])]
    keep = [c for c in docs.columns if c not in new]
    content = F.md5(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))) if text in docs.columns else F.lit("")
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null")), content))
    count = F.expr(word_count(text)) if size is None else F.coalesce(F.col(f"`{size}`").cast("bigint"), F.lit(0).cast("bigint"))
    queues = materialise(docs.select("source", place.alias("_h"), count.alias("n")).groupBy("source", "_h").agg(F.sum("n").alias("size")), "queues")
    sources = materialise(source_targets(queues.select("source", "size"), weights, share), "sources")
    n_sources, total = sources.agg(F.count("*"), F.sum("source_size")).first()
    entries = _finish_times(queues, _small(sources, n_sources))
    budget = (total or 0) * share[0] / share[1]  # in Python: a literal below 2^31 is an int, whose product may overflow
    taken = _within_budget(entries, F.lit(budget))
    last = taken.groupBy("_rank").agg(*[F.max(F.when(F.col("round") == r, F.col("_h"))).alias(f"_last{r}") for r in (0, 1)])
    ends = sources.join(last, sources["rank"] == last["_rank"], "left").select(F.col("source").alias("_source"), "source_size", "target", "_last0", "_last1")
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("source").alias("_of"), place.alias("_h"), count.alias("_n"))
    out = rows.join(_small(ends, n_sources), F.col("_of").eqNullSafe(F.col("_source")))
    copies = F.when(F.col("_n") > 0, sum(F.coalesce((F.col("_h") <= F.col(f"_last{r}")).cast("int"), F.lit(0)) for r in (0, 1))).otherwise(0)
    columns = [*[F.col(f"`{c}`") for c in keep], *([F.col("_n").alias("size")] if size is None else []), "source_size", "target", copies.alias("copies"), (copies * F.col("_n")).cast("bigint").alias("taken")]
    if finish:
        first = entries.where("round = 0").select(F.col("source").alias("_queue"), F.col("_h").alias("_place"), F.col("f").alias("finish"))
        out = out.join(first, F.col("_of").eqNullSafe(F.col("_queue")) & (F.col("_h") == F.col("_place")), "left")
        columns.append("finish")
    return out.select(*columns)


def _finish_times(queues: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, _rank, _h, size, round, f) of every place with words, for both rounds of serving.

    Running sums are made within the places whose hashes begin alike, and over
    these beginnings; hashes are even, so none is large.
    """
    rows = queues.withColumn("_b", F.substring("_h", 1, 3)).withColumn("_c", F.substring("_h", 1, 6))
    within = Window.partitionBy("source", "_c").orderBy("_h")
    fine = rows.groupBy("source", "_b", "_c").agg(F.sum("size").alias("n"))
    coarse = fine.groupBy("source", "_b").agg(F.sum("n").alias("m"))
    zero = F.lit(0).cast("bigint")
    coarse = coarse.select(F.col("source").alias("s1"), F.col("_b").alias("b1"), F.coalesce(F.sum("m").over(Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("_before"))
    fine = fine.join(coarse, F.col("source").eqNullSafe(F.col("s1")) & (F.col("_b") == F.col("b1")))
    fine = fine.select(F.col("source").alias("s2"), F.col("_c").alias("c2"), (F.col("_before") + F.coalesce(F.sum("n").over(Window.partitionBy("source", "_b").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), zero)).alias("_offset"))
    placed = rows.withColumn("_in", F.sum("size").over(within)).join(fine, F.col("source").eqNullSafe(F.col("s2")) & (F.col("_c") == F.col("c2")))
    of = sources.select(F.col("source").alias("s3"), "source_size", "target", F.col("rank").alias("_rank"))
    placed = placed.join(of, F.col("source").eqNullSafe(F.col("s3"))).where("size > 0 AND target > 0")
    served = placed.select("source", "_rank", "_h", "size", "source_size", "target", (F.col("_offset") + F.col("_in")).alias("_cum"), F.explode(F.array(F.lit(0), F.lit(1))).alias("round"))
    return materialise(served.select("source", "_rank", "_h", "size", "round", ((F.col("_cum") + F.col("source_size") * F.col("round")).cast("double") / F.col("target")).alias("f")), "finish-times")


def _within_budget(entries: DataFrame, budget: F.Column) -> DataFrame:
    """Entries in the order of their finish times, cut off at the budget.

    A range sort over the cluster; each range learns what the ranges before it hold (one
    row for each range) and sums up its own.
    """
    dealt = entries.select("_rank", "_h", "size", "round", "f").repartitionByRange(F.col("f"), F.col("_rank"), F.col("round")).withColumn("part", F.spark_partition_id())
    dealt = materialise(dealt, "sorted")
    sums = dealt.groupBy("part").agg(F.sum("size").alias("n"))
    before = sums.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = F.sum("size").over(Window.partitionBy("part").orderBy("f", "_rank", "round").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return dealt.withColumn("own", own).join(F.broadcast(before), "part").where(F.col("before") + F.col("own") <= budget)
