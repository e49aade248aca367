"""Merkle manifest of a table: a hash of every row, of every group and of the whole, with proofs.

Rows are the leaves; each group (language) has a tree of its own, and the roots
of the groups are the leaves of one more tree. The leaves of a group are cut into
aligned blocks. A block keeps every level as one string of concatenated hex
digests: fixed-width substrings of a level hash to the level above, and the
substrings that flank a node are its siblings. The roots of full blocks are the
leaves of the next round, until a group has one block. Proofs run downwards
again: what a block needs above itself is joined once for all its rows.

Every row of every table is a block or narrow; texts are read once and never
shuffled. Rounds grow with the logarithm of the largest group, and no group
meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm import common
from tickloom.operators.slices import numbered

WIDTH = 64  # hex digits of a sha256
FANOUT = 2
BLOCK_LEVELS = 6
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEPS = "array<struct<left:string,right:string>>"


def field(column: Column) -> Column:
    """`-` for null, else the number of bytes, a colon and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_hash(columns: list[Column]) -> Column:
    return F.sha2(F.concat(*[field(c) for c in columns]), 256)


def _node(level: Column, first: Column, count: Column) -> Column:
    """`count` digests of a level from number `first` on."""
    return level.substr(first * WIDTH + 1, count * WIDTH)


def _parents(level: Column, fanout: int) -> Column:
    """The level above: every run of `fanout` digests, or what is left of one, becomes its hash."""
    last = F.floor((F.length(level) - 1) / (WIDTH * fanout)).cast("int")
    runs = F.sequence(F.lit(0), last)
    return F.array_join(F.transform(runs, lambda i: F.sha2(_node(level, i * fanout, F.lit(fanout)), 256)), "")


def _blocks(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, block, items, only, level_0 .. level_n, top) of `nodes(tree, pos, hash, ...)`.

    `only` tells that the tree has no other block: its levels end at its root.
    Other blocks have all levels, so that they stay aligned.
    """
    size = fanout**levels
    rest = [c for c in nodes.columns if c not in ("tree", "pos")]
    grouped = (
        nodes.withColumn("block", F.expr(f"pos div {size}"))
        .groupBy("tree", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", *rest))).alias("items"))
    )
    grouped = common.stored(grouped, "merkle-items")
    last = grouped.groupBy("tree").agg(F.max("block").alias("last"))
    out = grouped.join(last, "tree").withColumn("only", F.col("last") == 0).drop("last")
    out = out.withColumn("level_0", F.array_join(F.transform("items", lambda x: x["hash"]), ""))
    for j in range(levels):
        below = F.col(f"level_{j}")
        more = ~F.col("only") | (F.length(below) > WIDTH)
        out = out.withColumn(f"level_{j + 1}", F.when(more, _parents(below, fanout)))
    names = [f"level_{j}" for j in range(levels, -1, -1)]
    return common.stored(out.withColumn("top", F.coalesce(*names)), "merkle-blocks")


def _steps(place: Column, fanout: int, levels: int) -> Column:
    """Siblings left and right of the node at `place` of a block, level by level."""
    found = []
    for j in range(levels):
        level, at = F.col(f"level_{j}"), F.floor(place / fanout**j).cast("int")
        within = at % fanout
        step = F.struct(
            _node(level, at - within, within).alias("left"),
            _node(level, at + 1, fanout - 1 - within).alias("right"),
        )
        found.append(F.when(F.col(f"level_{j + 1}").isNotNull(), step))
    return F.filter(F.array(*found), lambda s: s.isNotNull())


def _below(blocks: DataFrame, fanout: int, levels: int) -> DataFrame:
    """(tree, item, above, root) of every item of `blocks` that know what is `above` them."""
    places = F.sequence(F.lit(0), F.size("items") - 1)
    item = F.transform(
        places,
        lambda i: F.struct(
            F.get("items", i).alias("item"),
            F.concat(_steps(i, fanout, levels), F.col("above")).alias("above"),
        ),
    )
    return blocks.select("tree", "root", F.explode(item).alias("x")).select("tree", "x.item", "x.above", "root")


def forest(nodes: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> tuple[list[DataFrame], DataFrame]:
    """The rounds of blocks of `nodes(tree, pos, hash, ...)`, and (tree, root)."""
    rounds = []
    while True:
        blocks = _blocks(nodes, fanout, levels)
        rounds.append(blocks)
        nodes = blocks.where(~F.col("only")).select("tree", F.col("block").alias("pos"), F.col("top").alias("hash"))
        if nodes.isEmpty():
            break
    roots = [b.where("only").select("tree", F.col("top").alias("root")) for b in rounds]
    found = roots[0]
    for more in roots[1:]:
        found = found.union(more)
    return rounds, found


def proofs(rounds: list[DataFrame], above: DataFrame, fanout: int = FANOUT, levels: int = BLOCK_LEVELS) -> DataFrame:
    """(tree, item, above, root) of every leaf; `above(tree, above)` is what follows a tree's root."""
    known = None
    for number in range(len(rounds) - 1, -1, -1):
        blocks = rounds[number]
        ends = blocks.where("only").join(above, "tree").withColumn("root", F.col("top"))
        if known is None:
            placed = ends
        else:
            inner = blocks.where(~F.col("only")).join(known, ["tree", "block"])
            placed = ends.unionByName(inner)
        below = _below(placed, fanout, levels)
        if number:
            known = common.stored(
                below.select("tree", F.col("item.pos").alias("block"), "above", "root"), "merkle-above"
            )
    return below


def folded(start: Column, steps: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(
        steps,
        start,
        lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256),
    )


def proof_hash(steps: Column) -> Column:
    """One hash over all siblings of a proof, left to right, level by level."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(
    rows: DataFrame,
    id_col: str = "doc_id",
    group_col: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    tampered: dict[str, Column] | None = None,
    fanout: int = FANOUT,
    levels: int = BLOCK_LEVELS,
) -> DataFrame:
    """(id, leaf, subroot, root, proof, claimed) of every row.

    `proof` lists the siblings (left, right) of every level from the leaf to the
    root; `claimed` is the leaf again, or that of the row with the values of
    `tampered` in place of its columns. A level with one node more than full runs
    hashes that node alone.

    Leaves stand in the order of id (null first) and, for one id, of their
    hashes; rows that are equal are leaves of their own. A null group is a group
    and comes first. A null field counts as `-`, an empty text as `0:`. Rows with
    null ids and very long texts are leaves like others; columns that are not
    `fields` are not looked at. An empty table gives no rows.
    """
    spark = rows.sparkSession
    values = {c: F.col(c) for c in fields}
    leaf = row_hash(list(values.values()))
    claimed = row_hash(list({**values, **tampered}.values())) if tampered else leaf
    leaves = rows.select(
        F.col(group_col).alias("grp"), F.col(id_col).alias("id"), leaf.alias("hash"), claimed.alias("claimed")
    )
    # Equal rows differ in `tie` alone: no range of the order is one value.
    leaves = common.stored(leaves.withColumn("tie", F.monotonically_increasing_id()), "merkle-leaves")
    placed = numbered(leaves, ["grp", "id", "hash", "tie"], "number").drop("tie")
    starts = placed.groupBy(F.col("grp").alias("of")).agg(F.min("number").alias("tree"))
    nodes = placed.join(starts, F.col("grp").eqNullSafe(F.col("of"))).select(
        "tree", (F.col("number") - F.col("tree")).alias("pos"), "hash", "id", "claimed"
    )
    rounds, roots = forest(nodes, fanout, levels)

    # A tree's name is the number of its first leaf, so the names are in the order of the groups.
    ends = numbered(roots, ["tree"], "pos").select(
        F.lit(0).cast("long").alias("tree"), "pos", F.col("root").alias("hash"), F.col("tree").alias("group")
    )
    top_rounds, top_roots = forest(ends, fanout, levels)
    root = top_roots.first()
    nothing = spark.createDataFrame([(0, [])], f"tree long, above {_STEPS}")
    above = proofs(top_rounds, nothing, fanout, levels).select(F.col("item.group").alias("tree"), "above")
    return proofs(rounds, common.stored(above, "merkle-groups"), fanout, levels).select(
        F.col("item.id").alias(id_col),
        F.col("item.hash").alias("leaf"),
        F.col("root").alias("subroot"),
        F.lit(root["root"] if root else None).cast("string").alias("root"),
        F.col("above").alias("proof"),
        F.col("item.claimed").alias("claimed"),
    )


def verified(found: DataFrame) -> DataFrame:
    """Adds to a manifest the hash of each proof, the root that the claimed leaf leads to, and the verdict."""
    return (
        found.withColumn("proof_sha256", proof_hash(F.col("proof")))
        .withColumn("folded_root", folded(F.col("claimed"), F.col("proof")))
        .withColumn("verified", F.col("folded_root") == F.col("root"))
        .drop("proof", "claimed")
    )
