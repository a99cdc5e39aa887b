"""Merkle manifest of a dataset: a tree of SHA-256 digests per group, a tree over the groups, and a proof for every row.

All nodes of a level are rows (group, position, digest). A level joins itself on computed positions: the sibling of a node
in a binary tree is its position XOR 1; with a wider fan-out a run has one equi-join row for each slot offset. The
rows in slot zero of a run then emit the parents. Every level is written before the next starts, so a lost executor
costs one level, and each is a fixed fraction of the one below.

Proofs go the other way: a node's path is its own siblings followed by its parent's path. Levels are joined from the
root down, so a row's path is shuffled once with its parent and no row ever waits for more than its run.
Digests are kept as 32 bytes and hashed as lowercase hexadecimal text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wxspark.llm.common import ordered_positions
from wxspark.session import stored

#: Levels of proofs joined in one plan before the paths are written.
STRIDE = 6


def field(value: str | Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = (F.col(value) if isinstance(value, str) else value).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(fields: list[str | Column]) -> Column:
    """Digest of a row (32 bytes)."""
    return F.unhex(F.sha2(F.concat(*map(field, fields)), 256))


def text_of(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def combined(digests: Column) -> Column:
    """Digest of digests that stand one after the other in ``digests``."""
    return F.unhex(F.sha2(text_of(digests), 256))


def parents(nodes: DataFrame, fanout: int) -> DataFrame:
    """One level: ``nodes`` (tree, pos, n, digest) with ``before`` and ``after``, the digests of a node's siblings on either side.

    ``n`` is the number of nodes of the tree on this level.
    """
    slot = F.pmod("pos", F.lit(fanout))
    out = nodes
    for shift in range(1, fanout):
        # Within a run every slot meets every other one once over all shifts.
        to = F.col("pos").bitwiseXOR(F.lit(1).cast("long")) if fanout == 2 else F.col("pos") - slot + F.pmod(slot + shift, F.lit(fanout))
        other = nodes.select(F.col("tree").alias("_t"), F.col("pos").alias("_p"), F.col("digest").alias(f"_d{shift}"))
        out = out.withColumn("_to", to).join(other, (F.col("tree") == F.col("_t")) & (F.col("_to") == F.col("_p")), "left").drop("_t", "_p", "_to")

    def side(first: bool) -> Column:
        # Siblings in slot order: those before a node come from shifts that wrap around.
        parts = []
        for shift in range(1, fanout):
            wraps = slot + shift >= fanout
            parts.append(F.when(wraps if first else ~wraps, F.col(f"_d{shift}")))
        return F.concat(*[F.coalesce(p, F.lit(b"")) for p in parts])

    return out.select(*nodes.columns, side(True).alias("before"), side(False).alias("after"))


def climbed(leaves: DataFrame, fanout: int = 2) -> list[tuple[DataFrame | None, DataFrame]]:
    """All levels of all trees, leaves first: the nodes that have a parent (tree, pos, n, digest, before, after), None on the last level,
    and the roots (tree, pos, n, digest). Further columns of ``leaves`` stay on the first level.
    """
    levels, nodes = [], leaves
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        level = stored(parents(nodes.where("n > 1"), fanout), "merkle")
        levels.append((level, nodes.where("n = 1")))
        first = level.where(F.pmod("pos", F.lit(fanout)) == 0)
        nodes = first.select("tree", F.expr(f"pos div {fanout}").alias("pos"), F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), combined(F.concat("digest", "after")).alias("digest"))
        most = -(-most // fanout)
    return [*levels, (None, nodes)]


def tops(levels: list[tuple[DataFrame | None, DataFrame]]) -> DataFrame:
    """(tree, digest) of the root of every tree."""
    return reduce(DataFrame.unionByName, [roots.select("tree", "digest") for _, roots in levels])


def paths(levels: list[tuple[DataFrame | None, DataFrame]], above: DataFrame, fanout: int = 2) -> DataFrame:
    """The first level's columns but n, before and after, with the tree's root as ``subroot`` and ``path``, an array of (before, after)
    from the leaf up. ``above`` (tree, path) is where the path of each tree's root goes on.
    """
    step = F.array(F.struct("before", "after"))
    below = None
    for height, (level, ended) in enumerate(reversed(levels)):
        own = [c for c in ended.columns if c != "n"]
        roots = ended.join(above, "tree").select(*own, F.col("digest").alias("subroot"), "path")
        if level is None:
            below = roots
            continue
        up = below.select(F.col("tree").alias("_t"), F.col("pos").alias("_p"), "subroot", "path")
        inner = level.withColumn("_up", F.expr(f"pos div {fanout}"))
        inner = inner.join(up, (F.col("tree") == F.col("_t")) & (F.col("_up") == F.col("_p")))
        below = inner.select(*own, "subroot", F.concat(step, "path").alias("path")).unionByName(roots)
        if height % STRIDE == 0:
            below = stored(below, "merkle_paths")
    return below


def folded(digest: Column, path: Column) -> Column:
    """The root that follows from a leaf's digest and its path."""
    return F.aggregate(path, digest, lambda d, p: combined(F.concat(p["before"], d, p["after"])))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, left to right and level by level."""
    return combined(F.aggregate(path, F.lit(b"").cast("binary"), lambda a, p: F.concat(a, p["before"], p["after"])))


def manifest(rows: DataFrame, fields: list[str], key: str, group: str, extra: list[Column] | None = None, fanout: int = 2) -> DataFrame:
    """(key, group, leaf, subroot, root, path) of every row, digests as bytes, and the columns ``extra``.

    Leaves of a group ascend by ``key`` (null first, equal keys by digest); groups ascend in UTF-8 order, null first. A null field
    is ``-``, an empty one ``0:``; other columns are not read. Repeated rows are leaves of their own. A group of one
    row has its leaf as subroot, a single group its subroot as root. An empty table has no rows. A group may hold
    nearly all rows: positions come from range partitions, and tree nodes are spread by group and position.
    """
    names = [f"_extra{i}" for i in range(len(extra or []))]
    picked = rows.select(F.col(key).alias("_key"), F.col(group).cast("string").alias("_group"), leaf(fields).alias("digest"), *[e.alias(n) for e, n in zip(extra or [], names)])
    # Digests go with the key, so that rows that share one are spread too.
    placed = stored(ordered_positions(picked, ["_group"], ["_key", "digest"], "pos"), "merkle_leaves")
    sizes = placed.groupBy("_group").agg(F.count("*").alias("n"))
    # One row per group, in order: trees are known by number from here on.
    trees = stored(ordered_positions(sizes.withColumn("_all", F.lit(0)), ["_all"], ["_group"], "tree").drop("_all"), "merkle_trees")
    same = placed["_group"].eqNullSafe(trees["_group"])
    levels = climbed(placed.join(trees, same).select("tree", "pos", "n", "digest", "_key", placed["_group"], *names), fanout)
    subroots = stored(tops(levels), "merkle_tops")
    over = climbed(subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(subroots.count()).cast("long").alias("n"), "digest"), fanout)
    root = tops(over).first()  # one digest
    end = F.array().cast("array<struct<before: binary, after: binary>>")
    above = stored(paths(over, tops(over).select("tree", end.alias("path")), fanout).select(F.col("pos").alias("tree"), "path"), "merkle_above")
    known = F.lit(None if root is None else bytes(root["digest"])).cast("binary")
    return paths(levels, above, fanout).select(F.col("_key").alias(key), F.col("_group").alias(group), F.col("digest").alias("leaf"), "subroot", known.alias("root"), "path", *names)


def report(docs: DataFrame, fanout: int = 2) -> DataFrame:
    """Leaf, roots and proof of every document, and what a tampered row folds to.

    A row is tampered with where 7 divides the CRC-32 of its decimal doc_id: n_chars grows by one; a null n_chars or doc_id leaves it as it is.
    """
    hit = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0) & F.col("n_chars").isNotNull()
    first, last = ["doc_id", "source", "lang"], ["text"]
    changed = F.when(hit, leaf([*first, F.col("n_chars") + 1, *last]))
    made = manifest(docs, [*first, "n_chars", *last], "doc_id", "lang", [changed], fanout)
    back = folded(F.coalesce("_extra0", "leaf"), F.col("path"))
    out = made.withColumn("_back", back)
    return out.select("doc_id", text_of(F.col("leaf")).alias("leaf"), text_of(F.col("subroot")).alias("subroot"), text_of(F.col("root")).alias("root"),
                      text_of(proof(F.col("path"))).alias("proof_sha256"), text_of(F.col("_back")).alias("folded_root"), (F.col("_back") == F.col("root")).alias("verified"))
