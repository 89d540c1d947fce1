"""Chat formatting of reply trees.

Nodes (node, parent, role, text, score) form trees; a tree is a
conversation. Iterative self-joins with doubled steps give every node the
number of nodes and the sum of scores from its root (a reply chain of n
turns takes log2 n joins, each balanced over the nodes). Leaves are ranked
by the mean score of their path, and the nodes of the chosen paths are
gathered by the same steps in reverse, so that no path is walked turn by
turn and nothing but a chosen path meets in one row.

The template of a turn is ``<turn>role<text>text</turn>`` and a line end.
Where a role or text holds one of these three marks, a backslash is put
after its ``<`` (one more, if backslashes stand there already), so marks
never occur in formatted text but as marks, and taking one backslash away
restores it. The loss mask covers the text of assistant turns, as spans of
code points of the formatted text, end exclusive.

Defined results: null role or text is empty; a parent that is null or no
node makes a root; nodes on a circle, or that hang from one, have no root
and belong to no path. Of rows with the same node the smallest counts; a
null node is dropped. Paths of equal score: the longer, then the smaller
leaf. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheetmerge.operators.numbering import number_in_order
from sheetmerge.sources.land import land

TURN, TEXT, END = "<turn>", "<text>", "</turn>"
LINE = END + "\n"
ASSISTANT = "assistant"

_MARKS = "(turn>|text>|/turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<(\\*){_MARKS}", r"<$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"<(\\*)\\{_MARKS}", "<$1$2")


def _clean(nodes: DataFrame) -> DataFrame:
    """One row a node, written; a parent that is no node becomes null.

    Only nodes with a parent are looked up, and without their texts: roots
    all have the same parent, none, and a popular node has many replies.
    """
    spark = nodes.sparkSession
    one = F.min(F.struct("parent", "role", "text", "score")).alias("row")
    rows = nodes.filter("node is not null").groupBy("node").agg(one).select(
        "node",
        "row.parent",
        F.coalesce("row.role", F.lit("")).alias("role"),
        F.coalesce("row.text", F.lit("")).alias("text"),
        F.coalesce(F.col("row.score").cast("double"), F.lit(0.0)).alias("score"),
    )
    rows = land(spark, rows, "reply-nodes")
    replies = rows.filter("parent is not null").select("node", "parent")
    lost = replies.join(rows.select(F.col("node").alias("parent")), "parent", "left_anti").select("node", F.lit(True).alias("lost"))
    lost = land(spark, lost, "reply-lost")
    if lost.limit(1).count() == 0:
        return rows
    found = rows.join(lost, "node", "left").withColumn("parent", F.when(F.col("lost").isNull(), F.col("parent")))
    return land(spark, found.drop("lost"), "reply-nodes")


def _doubled(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """(steps, placed). Step k has (node, up): 2^k nodes above, for nodes that deep.

    placed has (node, root, depth, total) of every node below a root. A node
    takes part in a round only while something is above what it has added
    up, so a few long conversations cost the many short ones nothing.
    """
    spark = nodes.sparkSession
    start = nodes.select("node", F.col("parent").alias("up"), F.coalesce("parent", "node").alias("root"), F.lit(1).cast("long").alias("depth"), F.col("score").alias("total"))
    step = land(spark, start, "reply-steps")
    limit = step.count()
    steps, placed = [], step.where("up is null")
    while True:
        open_ = step.where("up is not null")
        if 1 << len(steps) > limit or open_.limit(1).count() == 0:  # only circles are longer than the table
            return steps, placed.drop("up")
        steps.append(open_.select("node", "up"))
        above = placed.unionByName(open_).select(F.col("node").alias("up"), F.struct("up", "root", "depth", "total").alias("a"))
        joined = open_.join(above, "up").select(
            "node",
            F.col("a.up").alias("up"),
            F.col("a.root").alias("root"),
            (F.col("depth") + F.col("a.depth")).alias("depth"),
            (F.col("total") + F.col("a.total")).alias("total"),
        )
        step = land(spark, joined, "reply-steps")
        placed = placed.unionByName(step.where("up is null"))


def best_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(root, leaf, rank, score, turns): the best root-to-leaf paths of every tree.

    ``nodes`` has node, parent, role, text, score; turns is array<(depth,
    role, text)> in order.
    """
    spark = nodes.sparkSession
    nodes = _clean(nodes)
    steps, placed = _doubled(nodes)
    answered = nodes.select(F.col("parent").alias("node")).filter("node is not null").distinct()
    leaves = placed.join(answered, "node", "left_anti")
    leaves = leaves.withColumn("score", F.col("total") / F.col("depth"))
    order = Window.partitionBy("root").orderBy(F.col("score").desc(), F.col("depth").desc(), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= paths)
    chosen = land(spark, chosen.select("root", F.col("node").alias("leaf"), "rank", "score"), "reply-leaves")
    members = chosen.select("leaf", F.col("leaf").alias("node"))
    for ups in reversed(steps):
        # written each time: a union with its own join would double the plan with every round
        higher = members.join(ups, "node").select("leaf", F.col("up").alias("node"))
        members = members.unionByName(land(spark, higher, "reply-members"))
    turns = members.join(nodes.select("node", "role", "text"), "node").join(placed.select("node", "depth"), "node")
    turns = turns.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("depth", "role", "text"))).alias("turns"))
    return chosen.join(turns, "leaf").select("root", "leaf", "rank", "score", "turns")


def format_turns(turns: Column) -> tuple[Column, Column]:
    """(formatted, loss): the conversation as text, and the spans under the loss mask."""
    written = F.transform(
        turns, lambda t: F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT), escape(t["text"]), F.lit(LINE))
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        start = acc["at"] + F.lit(len(TURN + TEXT)) + F.length(escape(t["role"]))
        end = start + F.length(escape(t["text"]))
        span = F.struct(start.alias("start"), end.alias("end"))
        return F.struct(
            (end + F.lit(len(LINE))).alias("at"),
            F.when(t["role"] == ASSISTANT, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.array_join(written, ""), F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def format_trees(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """(root, leaf, rank, score, formatted, loss) of the best paths."""
    formatted, loss = format_turns(F.col("turns"))
    return best_paths(nodes, paths).select("root", "leaf", "rank", "score", formatted.alias("formatted"), loss.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """array<(role, text)> of a formatted conversation."""
    pieces = F.split(formatted, LINE)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, TEXT, 1)
        text = F.substring(piece, F.length(role) + len(TEXT) + 1, F.length(piece))
        return F.struct(
            unescape(F.substring(role, F.lit(len(TURN) + 1), F.length(role))).alias("role"), unescape(text).alias("text")
        )

    return F.transform(turns, turn)


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(
            loss,
            lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))),
        ),
        "",
    )


def chained(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Conversations kept as numbered rows as reply chains: every turn answers the one before.

    Adds ``conv``. Turns of equal number go by role, then text; rows without
    a conversation id are one conversation. Nodes are global row numbers of
    a range sort, so a conversation may span many tasks.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), "role", "text")
    placed = land(spark, number_in_order(spark, named, [], ["conv", "turn", "role", "text"], "turns"), "turns-numbered")
    before = placed.select((F.col("row_no") + 1).alias("row_no"), F.struct("conv").alias("last"))
    linked = placed.join(before, "row_no", "left")
    follows = F.col("last").isNotNull() & F.col("conv").eqNullSafe(F.col("last.conv"))
    return linked.select(
        F.col("row_no").alias("node"),
        F.when(follows, F.col("row_no") - 1).alias("parent"),
        "role",
        "text",
        F.lit(0.0).alias("score"),
        "conv",
    )
