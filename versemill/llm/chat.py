r"""Chat formatting of reply trees: paths from root to leaf, ranked by score, one formatted conversation for each.

Iterative self-joins double the distance each node looks up: after round r it has summed the scores of its 2^r nearest
ancestors, so a tree of depth d takes log2(d) rounds, however deep. Leaves are ranked by the score of their path; the
chosen leaves' paths are then listed by the same doubling, over the jumps kept from each round.

Template: each turn is ``<turn>`` role ``\n`` text ``</turn>\n``. A control string inside a text (``<turn>``, ``</turn>``,
or either with backslashes before the name) gets one more backslash after its ``<``; reading removes one. In a role,
backslash and newline are escaped too. The output keeps the pieces with a flag for the loss, so the mask is exact.

Defined results: null text or role is empty; null parent or a parent that is not in the tree makes a root; a node on or
below a cycle has no root and is in no path; rows without a node id take no part; of rows that repeat a tree's node id the
first by parent, score, role and text counts; a null score adds nothing; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranged, with_rank
from .staging import Staging

OPEN, CLOSE = "<turn>", "</turn>\n"
_CONTROL, _CONTROL_BACK = r"<(\\*)(/?turn>)", r"<\\(\\*)(/?turn>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL, r"<\\$1$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, _CONTROL_BACK, r"<$1$2")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``: backslash pairs are set aside while ``\\n`` is turned back."""
    plain = unescape(role)
    aside = F.replace(plain, F.lit("\\\\"), F.lit("\\b"))  # every backslash now starts \b or \n
    return F.replace(F.replace(aside, F.lit("\\n"), F.lit("\n")), F.lit("\\b"), F.lit("\\"))


def linear_trees(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Conversations stored as rows by turn, as trees without branches: each row replies to the one before it.

    Rows of equal turn are ordered by role, then text; repeated rows are turns of their own; null turns come last. Turns are
    numbered over range partitions, so a conversation with a large part of all rows is dealt like any other.
    """
    staging = Staging(rows.sparkSession, "linear-trees")
    key = F.coalesce(F.concat(F.lit(":"), F.col(conv).cast("string")), F.lit(""))
    x = rows.select(F.col(conv).alias("tree"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), key.alias("_key"))
    by = [F.col("turn").asc_nulls_last(), F.col("role").asc()]
    dealt = ranged(x, staging, "_key", [*by, F.col("text").asc()], [*by, F.substring("text", 1, 64).asc()])
    staging.keep(dealt)
    node = (F.col("_rank") + 1).cast("long")
    x = with_rank(dealt, "_key").select("tree", node.alias("node"), "role", "text")
    return x.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1)).withColumn("score", F.lit(0.0))


def _same_tree(left: str, right: str) -> Column:
    return F.col(f"{left}.tree").eqNullSafe(F.col(f"{right}.tree"))


def choose_paths(nodes: DataFrame, staging: Staging, paths_per_tree: int = 1) -> DataFrame:
    """(tree, leaf, rank, path_score, node, depth): the nodes of each tree's best paths."""
    ids = nodes.select("tree", "node")
    parents = nodes.select("tree", "node", "parent", "score").alias("c").join(ids.alias("p"), _same_tree("c", "p") & (F.col("c.parent") == F.col("p.node")), "left")
    state = parents.select("c.tree", "c.node", F.col("p.node").alias("jump"), F.col("c.score").cast("double").alias("sum"), F.lit(1).cast("long").alias("depth"))
    state = staging.write(state, "jump")
    # Nodes whose jump is past the root are done; a round joins only the others, with all nodes.
    done, jumps, limit, total = state.filter("jump IS NULL"), [], 1, max(state.count(), 2)
    open_ = state.filter("jump IS NOT NULL")
    while limit < 2 * total and not open_.isEmpty():  # more rounds than a path without a cycle can need are never made
        jumps.append(open_.select("tree", "node", "jump"))
        # sum and depth cover the node itself and the ancestors below its jump; the jump's own cover what follows
        joined = open_.alias("a").join(done.unionByName(open_).alias("b"), _same_tree("a", "b") & (F.col("a.jump") == F.col("b.node")))
        state = joined.select("a.tree", "a.node", F.col("b.jump").alias("jump"), (F.col("a.sum") + F.col("b.sum")).alias("sum"), (F.col("a.depth") + F.col("b.depth")).alias("depth"))
        state = staging.write(state, "jump")
        done, open_ = done.unionByName(state.filter("jump IS NULL")), state.filter("jump IS NOT NULL")
        limit *= 2
    done = done.select("tree", "node", F.col("sum").alias("path_score"), "depth")
    inner = nodes.filter("parent IS NOT NULL").select("tree", F.col("parent").alias("node")).distinct()
    leaves = done.alias("d").join(inner.alias("i"), _same_tree("d", "i") & (F.col("d.node") == F.col("i.node")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.col("path_score").desc(), F.col("node").asc()))
    chosen = leaves.select("d.*").withColumn("rank", rank).filter(F.col("rank") <= paths_per_tree)
    paths = chosen.select("tree", F.col("node").alias("leaf"), "rank", "path_score", "depth", "node")
    for k, jump in enumerate(jumps):
        up = paths.alias("s").join(jump.alias("j"), _same_tree("s", "j") & (F.col("s.node") == F.col("j.node")))
        up = up.select("s.tree", "s.leaf", "s.rank", "s.path_score", (F.col("s.depth") - 2**k).alias("depth"), F.col("j.jump").alias("node"))
        paths = paths.unionByName(up)
        paths = staging.write(paths, "paths")  # each round reads the one before it twice; also, no plan groups a bare union
    return paths if jumps else staging.write(paths, "paths")


def format_paths(nodes: DataFrame, *, paths_per_tree: int = 1, loss_role: str = "assistant") -> DataFrame:
    """(tree, rank, path_score, n_turns, segments, formatted): one row for each chosen path.

    ``segments``: pieces of text with ``loss``; in order they make up ``formatted``, and those with ``loss`` are the mask.
    """
    staging = Staging(nodes.sparkSession, "chat")
    nodes = nodes.select("tree", "node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"), "role", "text")
    named = nodes.filter("node IS NOT NULL").groupBy("tree", "node").agg(F.min(F.struct("parent", "score", "role", "text")).alias("first"))
    nodes = staging.write(named.select("tree", "node", "first.*"), "nodes")
    paths = choose_paths(nodes, staging, paths_per_tree)
    staging.keep(nodes, paths)
    turns = paths.alias("p").join(nodes.alias("n"), _same_tree("p", "n") & (F.col("p.node") == F.col("n.node")))
    role, text = F.coalesce(F.col("n.role"), F.lit("")), F.coalesce(F.col("n.text"), F.lit(""))
    turns = turns.select(
        "p.tree", "p.rank", "p.leaf", "p.path_score",
        F.struct(F.col("p.depth").alias("depth"), escape_role(role).alias("role"), escape(text).alias("text"), (role == loss_role).alias("loss")).alias("turn"),
    )
    gathered = turns.groupBy("tree", "rank", "leaf", "path_score").agg(F.sort_array(F.collect_list("turn")).alias("_turns"))
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    pieces = F.flatten(F.transform("_turns", lambda t: F.array(
        piece(F.concat(F.lit(OPEN), t["role"], F.lit("\n")), F.lit(False)), piece(t["text"], t["loss"]), piece(F.lit(CLOSE), F.lit(False)),
    )))
    out = gathered.select("tree", "rank", "path_score", F.size("_turns").cast("long").alias("n_turns"), pieces.alias("segments"))
    return out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, read back from its text alone: array of (role, text)."""
    parts = F.filter(F.split(formatted, F.lit("</turn>\n")), lambda p: p != "")
    body = lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p))

    def turn(part: Column) -> Column:
        head = F.substring_index(part, "\n", 1)
        return F.struct(unescape_role(body(head)).alias("role"), unescape(F.substring(part, F.length(head) + 2, F.length(part))).alias("text"))

    return F.transform(parts, turn)


def read_loss(segments: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
