"""Prefix trie of conversations by fixed-length block hashing.

A conversation is a sequence of turns, cut into blocks of a few turns. A block
has one digest, and the digests of the blocks so far add up to the key of a
prefix, so keys of long conversations are running sums and need no walk from
block to block. Conversations that are equal as a whole become one class first;
classes are grouped by the keys of their blocks. Where a block is all that
follows the one before it, its turns are nodes with the same members. Only where
sibling blocks diverge are their turns compared one by one.

Sums over subtrees follow from sums over members: a node that is the smallest
member's own is counted with that member, and every other member's own nodes lie
below. So no walk over the levels of the trie is needed either.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tickloom.llm import common
from tickloom.operators.slices import numbered

BLOCK_TURNS = 4
SLICE_BLOCKS = 256  # blocks of one conversation whose keys are summed in one go
CHUNK_BITS = 12  # ids of up to 4096 following numbers are joined to one text first

_KEY = ("block", "p1", "p2")
_PARENT = ("block", "b1", "b2")
_SUMS = ("members", "held", "own", "leaves")


def turn_digest(role: Column, text: Column) -> Column:
    """sha256 of role and text; the length keeps them apart."""
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def _parts(digest: Column) -> list[Column]:
    """Two numbers of 60 bits of a digest, wide enough to be summed."""
    return [F.conv(digest.substr(at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]


def ordered_turns(
    turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str
) -> DataFrame:
    """(conv, place, digest, bytes): the turns of every conversation, numbered from 0.

    Texts become digests first, so that the order is made of narrow rows and one
    conversation may hold most of the table. Turns of one number are ordered by
    role and digest.
    """
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"),
        F.col(turn_col).alias("turn"),
        turn_digest(role, text).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
        role.alias("role"),
    )
    rows = common.stored(rows.withColumn("tie", F.monotonically_increasing_id()), "trie-turns")
    placed = numbered(rows, ["conv", "turn", "role", "digest", "tie"], "number")
    starts = placed.groupBy("conv").agg(F.min("number").alias("start"))
    return common.stored(
        placed.join(starts, "conv").select("conv", (F.col("number") - F.col("start")).alias("place"), "digest", "bytes"),
        "trie-ordered",
    )


def rebuilt(turns: DataFrame, base: Column, heads: Column, most_heads: int) -> tuple[DataFrame, DataFrame]:
    """(conv) of all conversations and (conv, place, digest, bytes) of their rebuilt turns.

    A conversation takes the first `heads` turns of the conversation `base`, all
    if it has fewer, none if there is none, and then its own turns after its
    first `heads`. Both are columns over `conv`; `heads` is `most_heads` at most,
    which bounds what a base hands out.
    """
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own_turns"))
    convs = common.stored(convs.withColumns({"base": base, "heads": heads}), "trie-conversations")
    first = (
        turns.where(F.col("place") < most_heads)
        .groupBy(F.col("conv").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("head"))
    )
    plan = convs.join(first, "base", "left").withColumn(
        "head", F.slice(F.coalesce("head", F.array()), 1, F.col("heads"))
    )
    plan = common.stored(plan.select("conv", "heads", "head", F.size("head").alias("taken")), "trie-heads")
    taken = plan.select("conv", F.explode("head").alias("t")).select("conv", "t.place", "t.digest", "t.bytes")
    kept = (
        turns.join(plan.select("conv", "heads", "taken"), "conv")
        .where(F.col("place") >= F.col("heads"))
        .select("conv", (F.col("place") - F.col("heads") + F.col("taken")).alias("place"), "digest", "bytes")
    )
    return convs.select("conv"), taken.unionByName(kept)


def _cut(turns: DataFrame, block_turns: int) -> DataFrame:
    """(conv, block, turns, bytes, d1, d2): blocks with their share of the prefix key."""
    blocks = (
        turns.groupBy("conv", F.expr(f"place div {block_turns}").alias("block"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "bytes"))).alias("turns"))
        .withColumn("turns", F.transform("turns", lambda t: F.struct(t["digest"].alias("digest"), t["bytes"].alias("bytes"))))
    )
    text = F.concat(F.col("block").cast("string"), F.lit(":"), F.array_join(F.transform("turns", lambda t: t["digest"]), ""))
    blocks = blocks.withColumn("digest", F.sha2(text, 256))
    one, two = _parts(F.col("digest"))
    total = F.aggregate("turns", F.lit(0).cast("long"), lambda s, t: s + t["bytes"])
    return blocks.select("conv", "block", "turns", total.alias("bytes"), one.alias("d1"), two.alias("d2"))


def _classes(convs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, rep, last) of every conversation: the smallest one with equal turns, and its last block;
    (conv, members, total, last) of every such class."""
    whole = blocks.groupBy("conv").agg(
        F.sum("d1").alias("s1"), F.sum("d2").alias("s2"), F.max("block").alias("last"), F.sum("bytes").alias("total")
    )
    none = F.lit(0).cast("decimal(30,0)")
    whole = convs.join(whole, "conv", "left").select(
        "conv",
        F.coalesce("s1", none).alias("s1"),
        F.coalesce("s2", none).alias("s2"),
        F.coalesce("last", F.lit(-1)).alias("last"),
        F.coalesce("total", F.lit(0)).alias("total"),
    )
    whole = common.stored(whole, "trie-whole")
    same = ["s1", "s2", "last"]
    classes = whole.groupBy(*same).agg(
        F.min("conv").alias("rep"), F.count(F.lit(1)).alias("members"), F.min("total").alias("total")
    )
    classes = common.stored(classes, "trie-classes")
    return whole.join(classes.drop("members", "total"), same).select("conv", "rep", "last"), classes.select(
        F.col("rep").alias("conv"), "members", "total", "last"
    )


def _keyed(blocks: DataFrame) -> DataFrame:
    """Adds p1, p2 (key of the prefix up to this block), b1, b2 (before it) and `before` (bytes before it).

    Running sums over slices of a conversation, each with the sum of the slices before it.
    """
    sums = {"d1": "p1", "d2": "p2", "bytes": "upto"}
    rows = blocks.withColumn("slice", F.expr(f"block div {SLICE_BLOCKS}"))
    earlier = Window.partitionBy("conv").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("conv", "slice").agg(*[F.sum(c).alias(c) for c in sums])
    carry = totals.select(
        "conv", "slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"carry_{c}") for c in sums]
    ).where("slice > 0")
    inside = Window.partitionBy("conv", "slice").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumns({name: F.sum(c).over(inside) for c, name in sums.items()})
    out = summed.join(carry, ["conv", "slice"], "left").withColumns(
        {n: (F.col(n) + F.coalesce(f"carry_{c}", F.lit(0))).cast("decimal(30,0)") for c, n in sums.items()}
    )
    return out.select(
        "conv",
        "block",
        "turns",
        "p1",
        "p2",
        (F.col("p1") - F.col("d1")).cast("decimal(30,0)").alias("b1"),
        (F.col("p2") - F.col("d2")).cast("decimal(30,0)").alias("b2"),
        (F.col("upto") - F.col("bytes")).cast("long").alias("before"),
    )


def _turn_nodes(blocks: DataFrame, values: DataFrame, root: tuple[int, int | None], block_turns: int) -> DataFrame:
    """(depth, conv_id, parent_conv_id, members, held, own, leaves, bytes, before, end) of every node but the root.

    `values(conv, members, held, own, leaves, last)` are summed over the classes
    below a node; `end` is the class that ends there. `root` has the number of
    all conversations and the smallest of them.
    """
    grouped = (
        blocks.select("conv", *_KEY, "b1", "b2")
        .join(values, "conv")
        .groupBy(*_KEY, "b1", "b2")
        .agg(
            F.min("conv").alias("conv"),
            *[F.sum(c).alias(c) for c in _SUMS],
            F.max(F.when(F.col("last") == F.col("block"), F.col("conv"))).alias("end"),
        )
    )
    grouped = common.stored(grouped, "trie-blocks")
    above = grouped.select(
        (F.col("block") + 1).alias("block"),
        F.col("p1").alias("b1"),
        F.col("p2").alias("b2"),
        F.col("members").alias("above_members"),
        F.col("conv").alias("above_conv"),
    )
    # A block holds the turns of the smallest class in it; the root is above the first blocks.
    found = (
        grouped.where("block > 0")
        .join(above, list(_PARENT))
        .unionByName(
            grouped.where("block = 0").withColumns(
                {"above_members": F.lit(root[0]).cast("long"), "above_conv": F.lit(root[1]).cast("long")}
            )
        )
        .join(blocks.select("conv", "block", "turns", "before"), ["conv", "block"])
    )
    digests = F.transform("turns", lambda t: t["digest"])
    node = F.transform(
        F.sequence(F.lit(1), F.size("turns")),
        lambda t: F.struct(
            t.alias("t"),
            F.get("turns", t - 1)["bytes"].alias("bytes"),
            F.aggregate(F.slice("turns", 1, t - 1), F.col("before"), lambda s, x: s + x["bytes"]).alias("before"),
            F.sha2(F.array_join(F.slice(F.col("digests"), 1, t), ""), 256).alias("q"),
            F.sha2(F.array_join(F.slice(F.col("digests"), 1, t - 1), ""), 256).alias("up"),
            F.when(t == F.size("turns"), F.col("end")).alias("end"),
        ),
    )
    found = common.stored(
        found.withColumn("digests", digests).select(
            *_PARENT, "conv", *_SUMS, "above_conv", (F.col("members") < F.col("above_members")).alias("parted"), F.explode(node).alias("n")
        )
        .select(*_PARENT, "conv", *_SUMS, "above_conv", "parted", "n.*"),
        "trie-refined",
    )
    depth = (F.col("block") * block_turns + F.col("t")).alias("depth")
    # Nothing parts here: the members are those of the node above.
    whole = found.where(~F.col("parted")).select(
        depth,
        F.col("conv").alias("conv_id"),
        F.when((F.col("block") > 0) | (F.col("t") > 1), F.col("conv")).otherwise(F.col("above_conv")).alias("parent_conv_id"),
        *_SUMS,
        "bytes",
        "before",
        "end",
    )
    parted = (
        found.where("parted")
        .groupBy(*_PARENT, "t", "q", "up")
        .agg(
            F.min("conv").alias("conv"),
            F.min("above_conv").alias("above_conv"),
            *[F.sum(c).alias(c) for c in _SUMS],
            F.min("bytes").alias("bytes"),
            F.min("before").alias("before"),
            F.max("end").alias("end"),
        )
    )
    parted = common.stored(parted, "trie-parted")
    higher = parted.select(
        *_PARENT, (F.col("t") + 1).alias("t"), F.col("q").alias("up"), F.col("conv").alias("parent_conv_id")
    )
    columns = [depth, F.col("conv").alias("conv_id"), "parent_conv_id", *_SUMS, "bytes", "before", "end"]
    inner = parted.where("t > 1").join(higher, [*_PARENT, "t", "up"]).select(*columns)
    first = parted.where("t = 1").withColumn("parent_conv_id", F.col("above_conv")).select(*columns)
    return whole.unionByName(inner).unionByName(first)


def _stream_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes texts that arrive in order of their group, keeping one running hash."""
    held, running = None, None

    def done():
        return pa.RecordBatch.from_pydict(
            {"rep": pa.array([held], pa.int64()), "ends_sha256": pa.array([running.hexdigest()], pa.string())}
        )

    for batch in batches:
        for rep, ids in zip(batch.column("rep").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            if rep != held:
                if running is not None:
                    yield done()
                held, running = rep, hashlib.sha256(ids.encode())
            else:
                running.update(b"," + ids.encode())
    if running is not None:
        yield done()


def _member_hashes(members: DataFrame) -> DataFrame:
    """(rep, ends_sha256): hash of the ids of every class, ascending, joined by commas.

    Ids are joined to texts of bounded length first. A class of one text is
    hashed in place; the texts of a larger one pass through one running hash in
    order, as a sha256 has to, without being held.
    """
    chunks = (
        members.groupBy("rep", F.shiftright("conv", CHUNK_BITS).alias("chunk"))
        .agg(F.sort_array(F.collect_list("conv")).alias("ids"))
        .select("rep", "chunk", F.array_join("ids", ",").alias("ids"))
    )
    chunks = common.stored(chunks, "trie-members")
    many = chunks.groupBy("rep").agg(F.count(F.lit(1)).alias("chunks"), F.min("ids").alias("only"))
    many = common.stored(many, "trie-member-chunks")
    single = many.where("chunks = 1").select("rep", F.sha2("only", 256).alias("ends_sha256"))
    long = (
        chunks.join(many.where("chunks > 1").select("rep"), "rep")
        .repartition("rep")
        .sortWithinPartitions("rep", "chunk")
        .select("rep", "ids")
        .mapInArrow(_stream_hashes, "rep long, ends_sha256 string")
    )
    return single.unionByName(long)


def trie(convs: DataFrame, turns: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The prefix trie of conversations, one row per node, the root included.

    `convs(conv)` are all conversations, those without turns too;
    `turns(conv, place, digest, bytes)` their turns with places from 0 without
    gaps. Columns: conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens and ends_sha256 (conversations that end
    at the node). No conversation, no row.
    """
    blocks = common.stored(_cut(turns, block_turns), "trie-cut")
    members, classes = _classes(convs, blocks)
    mine = blocks.join(classes.select("conv"), "conv", "left_semi")
    mine = common.stored(_keyed(mine), "trie-keyed")
    ends = common.stored(_member_hashes(members), "trie-ends")

    total = classes.agg(F.sum("members").alias("n"), F.sum(F.col("members") * F.col("total")).alias("held"), F.min("conv").alias("least")).first()
    zero = F.lit(0).cast("long")
    held = (F.col("members") * F.col("total")).alias("held")
    first = classes.select("conv", "members", held, zero.alias("own"), zero.alias("leaves"), "last")
    top = (total["n"] or 0, total["least"])
    nodes = _turn_nodes(mine, first, top, block_turns).select("depth", "conv_id", "parent_conv_id", "bytes")
    nodes = common.stored(nodes, "trie-shape")

    children = nodes.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(
        F.count(F.lit(1)).alias("n_children")
    )
    shape = nodes.join(children.where("depth > 0"), ["depth", "conv_id"], "left")
    shape = common.stored(shape.withColumn("n_children", F.coalesce("n_children", zero)), "trie-children")
    # What a conversation has of its own: the nodes of which it is the smallest member.
    own = shape.groupBy(F.col("conv_id").alias("conv")).agg(
        F.sum("bytes").alias("own"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves")
    )
    valued = classes.join(own, "conv", "left").select(
        "conv",
        "members",
        held,
        F.coalesce("own", zero).alias("own"),
        F.coalesce("leaves", zero).alias("leaves"),
        "last",
        "total",
    )
    valued = common.stored(valued, "trie-values")
    summed = _turn_nodes(mine, valued.drop("total"), top, block_turns)
    summed = summed.join(shape.select("depth", "conv_id", "n_children"), ["depth", "conv_id"])
    least = valued.select(F.col("conv").alias("conv_id"), F.col("own").alias("least_own"), F.col("total").alias("least_total"))
    repeated = F.col("held") - F.col("members") * F.col("before")
    distinct = F.col("own") - F.col("least_own") + F.col("least_total") - F.col("before")
    summed = common.stored(
        summed.join(least, "conv_id").select(
            "conv_id",
            "depth",
            "parent_conv_id",
            F.col("members").alias("n_convs"),
            "n_children",
            F.col("leaves").alias("n_leaves"),
            (repeated - distinct).alias("saved_tokens"),
            "end",
        ),
        "trie-nodes",
    )
    nothing = hashlib.sha256(b"").hexdigest()
    through = summed.where(F.col("end").isNull()).withColumn("ends_sha256", F.lit(nothing))
    ending = summed.join(ends.withColumnRenamed("rep", "end"), "end")
    inner = through.drop("end").unionByName(ending.drop("end"))
    if not top[0]:
        return inner
    whole = shape.agg(
        F.coalesce(F.sum("bytes"), zero).alias("bytes"),
        F.coalesce(F.sum((F.col("depth") == 1).cast("long")), zero).alias("n_children"),
        F.coalesce(F.sum((F.col("n_children") == 0).cast("long")), zero).alias("n_leaves"),
    )
    empty = classes.where("last = -1").select(F.col("conv").alias("rep")).join(ends, "rep").select("ends_sha256")
    root = whole.select(
        F.lit(total["least"]).cast("long").alias("conv_id"),
        zero.alias("depth"),
        F.lit(None).cast("long").alias("parent_conv_id"),
        F.lit(top[0]).cast("long").alias("n_convs"),
        "n_children",
        F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        (F.lit(total["held"]).cast("long") - F.col("bytes")).alias("saved_tokens"),
        F.coalesce(empty.scalar(), F.lit(nothing)).alias("ends_sha256"),
    )
    return inner.unionByName(root)


def rebuilt_trie(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    siblings: int = 5,
    most_heads: int = 8,
    block_turns: int = BLOCK_TURNS,
) -> DataFrame:
    """The trie of the conversations after each took over the beginning of another.

    Conversation c takes the first h turns of conversation c - c % `siblings`,
    with h = crc32(c) % (`most_heads` + 1), and keeps its own after its first h.

    Turns are ordered by number, null first, then role and digest; a null role or
    text is empty. Rows without a conversation belong to none and are left out.
    Repeated rows are turns of their own. Very long texts are hashed where they
    are read; extra columns are not looked at; an empty table gives no rows.
    """
    turns = ordered_turns(messages, conv_col, turn_col, role_col, text_col)
    heads = (F.crc32(F.col("conv").cast("string").cast("binary")) % (most_heads + 1)).cast("int")
    convs, new = rebuilt(turns, F.col("conv") - F.col("conv") % siblings, heads, most_heads)
    return trie(convs, new, block_turns)
