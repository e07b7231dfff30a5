"""Conversations out of reply trees, in DataFrame operations only.

Self-joins double the reach of every message's link to its ancestors until all
see their root; that gives depth and score of every branch. The best branches are
then laid out from root to leaf through the same links, so the rows made are as
many as the turns that are formatted.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

HEAD, MIDDLE, END = "### ", ": ", "</turn>\n"
#: Control strings in texts get one more backslash after their first character; so have those that have some already.
_CONTROLS = ((r"#(\\*)## ", r"#\\$1## "), (r"<(\\*)/turn>", r"<\\$1/turn>"))
_BACK = ((r"#\\(\\*)## ", r"#$1## "), (r"<\\(\\*)/turn>", r"<$1/turn>"))


def escape(text: Column) -> Column:
    return reduce(lambda t, c: F.regexp_replace(t, *c), _CONTROLS, text)


def unescape(text: Column) -> Column:
    return reduce(lambda t, c: F.regexp_replace(t, *c), _BACK, text)


def _escape_role(role: Column) -> Column:
    return F.regexp_replace(escape(role), r":(\\*) ", r":\\$1 ")


def _unescape_role(role: Column) -> Column:
    return unescape(F.regexp_replace(role, r":\\(\\*) ", r":$1 "))


def _same_tree(other: str) -> Column:
    return F.col("tree").eqNullSafe(F.col(other))


def branches(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Depth and total score of every node, and for each k its ancestor 2**k steps up.

    ``nodes`` has tree, node, parent and score, a node once. A parent that the tree
    doesn't have makes a root. A circle of parents raises ValueError.
    """
    known = nodes.select(F.col("tree").alias("_t"), F.col("node").alias("_n"))
    links = nodes.join(known, _same_tree("_t") & (F.col("parent") == F.col("_n")) & (F.col("parent") != F.col("node")), "left")
    active = links.select("tree", "node", F.col("_n").alias("up"), F.lit(1).cast("bigint").alias("depth"), "score")
    finished, jumps = [], []
    n_nodes = None
    while True:
        # Only links that have not reached a root are joined again.
        active = materialise(active, "branches")
        finished.append(active.where("up is null"))
        going = active.where("up is not null")
        if not going.limit(1).count():
            return reduce(DataFrame.unionByName, finished).drop("up"), jumps
        jumps.append(going.select("tree", "node", "up"))
        n_nodes = n_nodes or active.count()
        if 1 << len(jumps) > 2 * n_nodes:
            raise ValueError("parents go round in a circle")
        above = reduce(DataFrame.unionByName, [*finished, going])
        above = above.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"), F.col("depth").alias("_depth"), F.col("score").alias("_score"))
        more = [(F.col(c) + F.col(f"_{c}")).alias(c) for c in ("depth", "score")]
        active = going.join(above, _same_tree("_t") & (F.col("up") == F.col("_n"))).select("tree", "node", F.col("_up").alias("up"), *more)


def chosen_paths(nodes: DataFrame, paths: int = 1) -> DataFrame:
    """The turns of the best ``paths`` branches of every tree: tree, rank, branch_score, leaf, position, node.

    Branches run from root to leaf and rank by mean score, then length, then leaf.
    """
    reach, jumps = branches(nodes)
    parents = nodes.select(F.col("tree").alias("_t"), F.col("parent").alias("_p"), "node").where("_p is not null and _p != node").drop("node").distinct()
    leaves = reach.join(parents, _same_tree("_t") & (F.col("node") == F.col("_p")), "left_anti")
    mean = F.col("score") / F.col("depth")
    best = Window.partitionBy("tree").orderBy(mean.desc(), F.col("depth").desc(), "node")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), "depth", mean.alias("branch_score"), F.row_number().over(best).alias("rank"))
    turns = leaves.where(F.col("rank") <= paths).select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("depth"))).alias("position"))
    turns = turns.withColumn("node", F.col("leaf")).withColumn("_steps", F.col("depth") - F.col("position")).drop("depth")
    # A turn takes the jumps that the binary digits of its distance to the leaf name, and no others.
    waiting: list[list[DataFrame]] = [[] for _ in jumps]
    arrived = []

    def send(rows: DataFrame) -> None:
        lowest = F.length(F.bin(F.col("_steps").bitwiseAND(-F.col("_steps")))) - 1
        rows = materialise(rows.withColumn("_next", F.when(F.col("_steps") > 0, lowest)), "turns")
        arrived.append(rows.where("_next is null").drop("_next", "_steps"))
        for k in range(len(jumps)):
            waiting[k].append(rows.where(F.col("_next") == k).drop("_next"))

    send(turns)
    for k, jump in enumerate(jumps):
        step = jump.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), F.col("up").alias("_up"))
        rows = reduce(DataFrame.unionByName, waiting[k]).join(step, _same_tree("_t") & (F.col("node") == F.col("_n")))
        rows = rows.withColumn("node", F.col("_up")).withColumn("_steps", F.col("_steps") - (1 << k))
        send(rows.drop("_t", "_n", "_up"))
    return reduce(DataFrame.unionByName, arrived).select("tree", "rank", "branch_score", "leaf", "position", "node")


def format_trees(messages: DataFrame, paths: int = 1) -> DataFrame:
    """One conversation for each chosen branch: tree, rank, branch_score, formatted, loss.

    ``messages`` has tree, node, parent, role, text and score. ``loss`` holds start
    and length, in code points, of each assistant text in ``formatted``. A null
    text or role is empty, a null score 0. Of several rows for one node, the least
    counts. Rows without node are left out; null is a tree like others. A
    conversation is one row by nature, however long it is.
    """
    columns = ("parent", "role", "text", "score")
    filled = messages.select(
        "tree", "node", "parent", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"),
    ).where("node is not null")
    once = filled.groupBy("tree", "node").agg(F.min(F.struct(*columns)).alias("m")).select("tree", "node", *[f"m.{c}" for c in columns])
    once = materialise(once, "messages")
    turns = chosen_paths(once.select("tree", "node", "parent", "score"), paths)
    said = once.select(F.col("tree").alias("_t"), F.col("node").alias("_n"), "role", escape(F.col("text")).alias("_text"))
    turns = turns.join(said, _same_tree("_t") & (F.col("node") == F.col("_n"))).drop("_t", "_n")
    turns = turns.withColumn("_head", F.concat(F.lit(HEAD), _escape_role(F.col("role")), F.lit(MIDDLE)))
    turns = turns.withColumn("_turn", F.concat("_head", "_text", F.lit(END)))
    path = Window.partitionBy("tree", "leaf").orderBy("position")
    start = F.sum(F.char_length("_turn")).over(path) - F.char_length("_text") - len(END)
    span = F.when(F.col("role") == "assistant", F.struct(start.alias("start"), F.char_length("_text").cast("bigint").alias("length")))
    turns = turns.withColumn("_span", span)
    listed = F.sort_array(F.collect_list(F.struct("position", "_turn", "_span")))
    whole = turns.groupBy("tree", "leaf").agg(F.first("rank").alias("rank"), F.first("branch_score").alias("branch_score"), listed.alias("_turns"))
    spans = F.filter(F.transform("_turns", lambda t: t["_span"]), lambda s: s.isNotNull())
    return whole.select("tree", "rank", "branch_score", F.array_join(F.transform("_turns", lambda t: t["_turn"]), "").alias("formatted"), spans.alias("loss"))


def read_back(formatted: str = "formatted") -> Column:
    """Turns as (role, text), read from a formatted conversation."""

    def turn(piece: Column) -> Column:
        role = F.substring_index(F.substr(piece, F.lit(len(HEAD) + 1)), MIDDLE, 1)
        text = F.substr(piece, F.char_length(role) + len(HEAD) + len(MIDDLE) + 1)
        return F.struct(_unescape_role(role).alias("role"), unescape(text).alias("text"))

    pieces = F.split(F.col(formatted), END, -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), turn)


def loss_text(formatted: str = "formatted", loss: str = "loss") -> Column:
    """All text under the loss mask, unescaped, in a row."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substr(F.col(formatted), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: every turn answers the one before.

    Rows go by turn; equal turns by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order)
    return conversations.select(
        F.col("conv_id").alias("tree"), place.alias("node"), F.when(place > 1, place - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
