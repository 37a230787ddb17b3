"""A Merkle manifest of the documents: leaves, subroots by language, one root, and a proof per document.

Concatenated levels: a group's leaves are ranked and cut into aligned blocks of ``FANOUT ** LEVELS``
nodes. A block keeps each of its levels as one string of hexadecimal digests (as its bytes, so a
place in it is found without walking the text). Fixed-width substrings of that string are the runs to
hash into parents, and the substrings on both sides of a node are its siblings. The blocks' roots are the
nodes of the next round, until each group has one; the groups' roots are the nodes of one last tree. Then
the rounds are gone through downwards: a block takes over the path above it and hands its own on.

Only digests are shuffled, never texts, and only digests are stored: paths, many times as long, are made
from them while the rows go by. A block is a bounded group whatever the language's share, ranks come from
a range partitioning, and each round has ``FANOUT ** LEVELS`` times fewer rows.

Cases: a null field reads ``-``; a null language is a group of its own and comes first. Leaves of a group
ascend by doc_id (nulls last), then by digest, so repeated rows are neighbouring equal leaves with proofs
of their own. A group of one leaf has that leaf as its subroot, and a table with one language has its
subroot as root; a proof without siblings is the digest of nothing. An empty table gives no rows. A long
text is hashed whole. A missing column reads null and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.shared import kept_columns, settle
from shelfwise.operators.common import global_rank

FANOUT = 8
LEVELS = 2  # of a block; a reader holds 4,096 stored blocks at once, so they are small
WIDTH = 64  # hexadecimal digits of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RUN = FANOUT * WIDTH
_NO_PATH = "cast(array() as array<struct<left:binary,right:binary>>)"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(fields: dict[str, Column]) -> Column:
    """Digest of a document's fields."""
    return F.sha2(F.concat(*[_field(fields[f]) for f in FIELDS]), 256)


def _parents(level: str) -> Column:
    """The string of the next level: each run of up to FANOUT digests becomes its digest."""
    runs = f"sequence(0L, cast((length({level}) - 1) div {_RUN} as bigint))"
    return F.expr(f"cast(array_join(transform({runs}, i -> sha2(substring({level}, cast(i * {_RUN} + 1 as int), {_RUN}), 256)), '') as binary)")


def _segment(k: int) -> str:
    """What stands left and right of member ``i``'s ancestor in its run of level ``k``."""
    node = f"(i div {FANOUT ** k})"
    at = f"({node} % {FANOUT})"
    return (f"struct(substring(level{k}, cast({node} div {FANOUT} * {_RUN} + 1 as int), cast({at} * {WIDTH} as int)) as left, "
            f"substring(level{k}, cast({node} * {WIDTH} + {WIDTH + 1} as int), cast(({FANOUT - 1} - {at}) * {WIDTH} as int)) as right)")


def _levels(blocks: DataFrame) -> DataFrame:
    """Adds the block's levels as strings, and how many of them its group needs."""
    blocks = blocks.withColumn("level0", F.expr("cast(array_join(transform(rows, x -> x.node), '') as binary)"))
    # A group of one block stops as soon as one node is left; the blocks of a larger one all have LEVELS levels.
    depth = F.lit(LEVELS)
    for k in reversed(range(LEVELS)):
        depth = F.when(F.col("n") <= FANOUT ** k, k).otherwise(depth)
    blocks = blocks.withColumn("depth", depth)
    for k in range(LEVELS):
        blocks = blocks.withColumn(f"level{k + 1}", F.when(F.col("depth") > k, _parents(f"level{k}")).otherwise(F.col(f"level{k}")))
    return blocks


def _blocks(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(group, block, n, rows, root) of nodes (group, pos, n, node, carried columns): a row per aligned block."""
    rows = nodes.groupBy("group", F.expr(f"pos div {FANOUT ** LEVELS}").alias("block")).agg(
        F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "node", *carried))).alias("rows"))
    return _levels(rows).select("group", "block", "n", "rows", F.col(f"level{LEVELS}").cast("string").alias("root"))


def _climb(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """The stored blocks of every round, lowest first; in the last one each group has a single block."""
    rounds = []
    while True:
        rounds.append(settle(_blocks(nodes, carried)))
        nodes, carried = rounds[-1].select("group", F.col("block").alias("pos"), F.expr(f"(n - 1) div {FANOUT ** LEVELS} + 1").alias("n"),
                                           F.col("root").alias("node")), ()
        if (nodes.agg(F.max("n")).first()[0] or 0) <= 1:
            return rounds


def _descend(rounds: Sequence[DataFrame], tops: DataFrame) -> DataFrame:
    """One row per node of the lowest round, with its ``path``: ``tops`` has a row per group with the path above
    the group and columns to hand down. Every join is by block, so no group is in one task, and merges, as a
    round's paths are too many to broadcast."""
    more = [c for c in tops.columns if c not in ("group", "path")]
    path = f"slice(array({', '.join(_segment(k) for k in range(LEVELS))}), 1, depth)"
    nodes = tops.withColumn("pos", F.lit(0).cast("long"))
    for blocks in reversed(rounds):
        above = nodes.select("group", F.col("pos").alias("block"), F.col("path").alias("above"), *more)
        own = "".join(f"x.{f} as {f}, " for f in blocks.schema["rows"].dataType.elementType.names)
        inner = _levels(blocks.drop("root").join(above.hint("merge"), ["group", "block"])).select(
            "group", "above", *more, F.expr(f"inline(transform(rows, (x, i) -> struct({own}{path} as path)))"))
        nodes = inner.withColumn("path", F.concat("path", "above")).drop("above")
    return nodes


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """(doc_id, leaf, changed, path, subroot, root) per document: ``path`` lists the siblings on the left and
    the right from the leaf to the root; ``changed`` is the leaf of a document whose text was replaced by the
    given column (null where that column is null)."""
    rows = kept_columns(docs, *FIELDS)
    now = {f: F.col(f) for f in FIELDS}
    text = F.lit(None).cast("string") if changed is None else changed
    leaves = rows.select(F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang").cast("string"))).alias("group"), "doc_id",
                         leaf(now).alias("node"), F.when(text.isNotNull(), leaf({**now, "text": text})).alias("changed"))
    ranked = global_rank(leaves, [F.asc_nulls_last("doc_id"), F.col("node"), F.col("changed")], ["group"])
    rounds = _climb(ranked.withColumnsRenamed({"rank_idx": "pos", "rank_n": "n"}), ["doc_id", "changed"])
    tops = global_rank(rounds[-1].select("group", F.col("root").alias("node")), [F.col("group")])
    groups = _climb(tops.select(F.lit("").alias("group"), F.col("rank_idx").alias("pos"), F.col("rank_n").alias("n"), "node",
                                F.col("group").alias("of")), ["of"])
    roots = _descend(groups, groups[-1].select("group", F.expr(_NO_PATH).alias("path"), "root"))
    whole = _descend(rounds, roots.select(F.col("of").alias("group"), "path", F.col("node").alias("subroot"), "root"))
    return whole.select("doc_id", F.col("node").alias("leaf"), "changed", "path", "subroot", "root")


def folded(leaf_digest: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf_digest, lambda node, s: F.sha2(F.concat(s["left"], node.cast("binary"), s["right"]), 256))


def proof(path: Column) -> Column:
    """One digest of all siblings, level by level, left to right."""
    joined = F.aggregate(path, F.lit("").cast("binary"), lambda all_, s: F.concat(all_, s["left"], s["right"]))
    return F.sha2(joined, 256)


def verified(proofs: DataFrame) -> DataFrame:
    """Adds ``folded_root``, from the changed leaf where there is one, and ``verified``."""
    return (proofs.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
            .withColumn("verified", F.col("folded_root") == F.col("root")))
