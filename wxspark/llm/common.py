"""Helpers that several operators share: table reading, distributed ranks, connected components, worker-side words."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wxspark.session import compact, stored

#: Regular expression of a word: anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheltered(docs: DataFrame, own: Sequence[str], run: Callable[[DataFrame], DataFrame], adds: Sequence[str] = ()) -> DataFrame:
    """``run`` on ``docs`` whose columns other than ``own`` carry neutral names, so that none meets a name that ``run`` uses inside.

    The result has the columns of ``docs`` under their own names and the new columns ``adds``, which replace columns called the same.
    """
    names = {c: c if c in own else f"kept__{i}" for i, c in enumerate(docs.columns)}
    out = run(docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]))
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in adds], *adds)


def word_count(text: str | Column) -> Column:
    """Number of words of a text, 0 for null. Every word becomes one mark, what is left of the text goes."""
    marked = F.regexp_replace(F.col(text) if isinstance(text, str) else text, WORD, "x")
    return F.coalesce(F.length(F.translate(marked, " \t\n\x0b\x0c\r", "")), F.lit(0)).cast("long")


def salted_ranks(df: DataFrame, keys: list[str], order: list, weight: str | None = None, rank: str = "rank", salts: int = 64) -> DataFrame:
    """Number rows within their key from 0 in an arbitrary but repeatable order.

    A key may hold most of the rows: rows of a key are dealt into ``salts`` buckets by a hash of ``order``, numbered within
    each bucket, and moved by the sizes of the key's earlier buckets, of which there is one small row each. With
    ``weight`` the number is the sum of the weights of the rows before. Rows equal in ``order`` are interchangeable.
    """
    size = F.lit(1) if weight is None else F.col(weight)
    salted = stored(df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int")), "ranks")
    by_key = Window.partitionBy(*keys).orderBy("_salt")
    before = salted.groupBy(*keys, "_salt").agg(F.sum(size).cast("long").alias("_n"))
    before = before.withColumn("_before", F.sum("_n").over(by_key.rowsBetween(Window.unboundedPreceding, -1)))
    named = [f"_k{i}" for i in range(len(keys))]
    before = before.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col("_salt").alias("_s"), F.coalesce("_before", F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_salt").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = salted.withColumn("_own", F.sum(size).over(within) - size)
    same = F.col("_salt") == F.col("_s")
    for k, n in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return numbered.join(before, same).withColumn(rank, (F.col("_own") + F.col("_before")).cast("long")).drop("_salt", "_s", "_own", "_before", *named)


def ordered_positions(df: DataFrame, keys: list[str], order: list[str], position: str = "position") -> DataFrame:
    """Number rows within their key from 0 in the given order; a key may hold most of the rows.

    Rows are range-partitioned by key and order, so a large key covers several partitions; rows are numbered within a
    partition and moved by the key's rows in earlier partitions (one small row per key and partition). Rows that
    differ only in their table position are interchangeable.
    """
    dealt = stored(df.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "positions")
    per_part = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    named = [f"_k{i}" for i in range(len(keys))]
    before = per_part.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    before = before.select(*[F.col(k).alias(n) for k, n in zip(keys, named)], F.col("_part").alias("_p"), "_before")
    numbered = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1)
    same = F.col("_part") == F.col("_p")
    for k, n in zip(keys, named):
        same = same & F.col(k).eqNullSafe(F.col(n))
    return numbered.join(before, same).withColumn(position, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_p", "_own", "_before", *named)


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has an edge; ``edges`` has long columns a and b. The root is the smallest node.

    Large-star and small-star steps in turn: every node hands its larger, then its smaller neighbours to the smallest
    node next to it. Each step is an aggregate and a join on the node, so a node with very many neighbours is
    combined before the shuffle and split by the engine in the join. Lineage is cut by writing the links of each step, in as few
    part files as they fill.
    """
    def smallest(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def both(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select(F.col("b"), F.col("a")))

    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    n = current.count()  # steps add no links
    for _ in range(max_rounds):
        pairs = both(current)
        low = smallest(pairs).select("u", F.least("u", "m").alias("m"))
        large = pairs.where("v > u").join(low, "u").where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        low = smallest(large)
        small = large.join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
        small = small.union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
        current = compact(small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), n, "links")
        # Settled when each node is either a root or has one root: members once on the left, roots never.
        sides = current.select(F.col("a").alias("u"), F.lit(1).alias("member")).union(current.select("b", F.lit(0)))
        per_node = sides.groupBy("u").agg(F.sum("member").alias("roots"), F.min("member").alias("least"))
        if per_node.where("roots > 1 or (roots = 1 and least = 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(current.select(F.col("b"), F.col("b")).distinct())


def spaced(text: bytes) -> bytes:
    """A UTF-8 text in lower case (A-Z only) with its words joined by single spaces."""
    return b" ".join(text.lower().split())


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
