"""Reply trees to formatted conversations, in DataFrame and SQL functions alone.

Ancestors are found by pointer doubling: round k joins the table of 2**k-step ancestors with itself, so a path of
depth d takes log2(d) self-joins, each written once.  Joining leaves with those tables enumerates every
root-to-leaf path as rows (leaf, node, distance); branches are ranked in their tree by mean score, and each
chosen path becomes one conversation.

The template writes every turn as ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline.
Inside roles and texts each backslash is doubled and control strings get a backslash after their first
character, so a text can never end its turn and reading back restores it exactly.  The loss mask has the
spans, in code points of the formatted string, of the trained role's escaped texts.

Defined cases: a null text or role is empty; a message whose parent is missing starts a tree of its own;
messages on or below a parent cycle have no root and are left out; equal scores rank by leaf; repeated
message ids in a tree are told apart by their order of text; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.llm import support
from gleaner.llm.pii import running_sums

#: The strings with a meaning in the templates that this one must be safe for.
CONTROL = ["<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]"]
START, END = "<|im_start|>", "<|im_end|>"
_ANGLE, _SQUARE = r"<(\|im_start\|>|\|im_end\|>|/?s>)", r"\[(/?INST\])"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(F.regexp_replace(doubled, _ANGLE, r"<\\$1"), _SQUARE, r"[\\$1")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\s\S])", "$1")


def chain(turns: DataFrame, *, tree: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of a table of turns: each turn answers the one before it in its conversation."""
    w = Window.partitionBy("tree").orderBy("at", "role", "text")
    picked = turns.select(F.col(tree).alias("tree"), F.col(order).alias("at"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    numbered = picked.select("tree", F.row_number().over(w).cast("long").alias("node"), "role", "text")
    parent = F.when(F.col("node") > 1, F.col("node") - 1)
    return numbered.select("tree", "node", parent.alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def reply_paths(messages: DataFrame, *, top: int | None = None) -> DataFrame:
    """``tree, leaf, depth, role, text, branch`` for the turns of the ``top`` branches of each tree (all when None).

    ``messages`` has ``tree, node, parent, role, text, score``.
    """
    rank_in_node = F.row_number().over(Window.partitionBy("tree", "node").orderBy("role", "text"))
    nodes = messages.select(F.struct(F.struct("tree").alias("t"), "node", rank_in_node.alias("copy")).alias("id"), F.struct(F.struct("tree").alias("t"), F.col("parent").alias("node"), F.lit(1).alias("copy")).alias("up"), "role", "text", "score")
    nodes = support.materialize(nodes, "messages")
    ids = nodes.select(F.col("id").alias("up"))
    jump = nodes.select("id", "up").where("up.node is not null").join(ids, "up", "left_semi")
    jumps, limit = [], max(nodes.count(), 2).bit_length() + 1
    while len(jumps) < limit:
        jump = support.materialize(jump.select("id", "up"), f"jump{len(jumps)}")
        if jump.isEmpty():
            break
        jumps.append(jump)
        further = jump.select(F.col("id").alias("up"), F.col("up").alias("next"))
        jump = jump.join(further, "up").select("id", F.col("next").alias("up"))
    leaves = nodes.select("id").join(jumps[0].select(F.col("up").alias("id")), "id", "left_anti") if jumps else nodes.select("id")
    if len(jumps) == limit:  # whoever still has an ancestor after more steps than messages is on or below a cycle
        leaves = leaves.join(jumps[-1], "id", "left_anti")
    paths = leaves.select(F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("distance"))
    for k, jump in enumerate(jumps[: limit - 1]):
        steps = paths.join(jump, "id").select("leaf", F.col("up").alias("id"), F.col("distance") + (1 << k))
        paths = support.materialize(paths.unionByName(steps.toDF("leaf", "id", "distance")), f"paths{k}")
    whole = paths.join(nodes.drop("up"), "id")
    of_path = Window.partitionBy("leaf")
    whole = whole.select("leaf", "role", "text", (F.max("distance").over(of_path) - F.col("distance")).alias("depth"), F.avg("score").over(of_path).alias("score"))
    best = whole.select("leaf", "score").distinct()
    order = Window.partitionBy("leaf.t").orderBy(F.desc_nulls_last("score"), "leaf.node", "leaf.copy")
    ranked = best.select("leaf", F.row_number().over(order).alias("branch"))
    chosen = ranked if top is None else ranked.where(F.col("branch") <= top)
    joined = whole.drop("score").join(chosen, "leaf")
    return joined.select(F.col("leaf.t.tree").alias("tree"), "leaf", "depth", "role", "text", "branch")


def format_paths(paths: DataFrame, *, trained: str = "assistant") -> DataFrame:
    """One row per path: ``tree, branch, formatted, loss`` with ``loss`` an array of ``(turn, start, stop)``."""
    role, text = escape_role(F.coalesce("role", F.lit(""))), escape(F.coalesce("text", F.lit("")))
    turns = paths.select("tree", "leaf", "branch", "depth", role.alias("r"), text.alias("x"), F.coalesce(F.col("role") == trained, F.lit(False)).alias("loss"))
    head = F.length("r") + len(START) + 1
    turns = turns.select("*", F.concat(F.lit(START), "r", F.lit("\n"), "x", F.lit(END + "\n")).alias("seg"), head.alias("head"))
    before = F.sum(F.length("seg").cast("long")).over(Window.partitionBy("leaf").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    turns = turns.select("*", (before - F.length("seg")).alias("at"))
    start = F.col("at") + F.col("head")
    span = F.when(F.col("loss"), F.struct(F.col("depth").alias("turn"), start.alias("start"), (start + F.length("x")).alias("stop")))
    parts = F.array_sort(F.collect_list(F.struct("depth", "seg", span.alias("span"))))
    gathered = turns.groupBy("leaf").agg(F.first("tree").alias("tree"), F.first("branch").alias("branch"), parts.alias("parts"))
    return gathered.select(
        "tree", "branch",
        F.array_join(F.transform("parts", lambda p: p.seg), "").alias("formatted"),
        F.filter(F.transform("parts", lambda p: p.span), lambda s: s.isNotNull()).alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``tree, branch, formatted, turns, masked``: the turns parsed from the string, the unescaped text under the loss mask."""
    cut = F.split("formatted", r"<\|im_end\|>\n", -1)
    pieces = formatted.select("*", F.slice(cut, F.lit(1), F.size(cut) - 1).alias("pieces"))
    with_at = pieces.select("*", F.expr(running_sums(f"transform(pieces, p -> cast(length(p) + {len(END) + 1} as bigint))")).alias("at"))

    def parsed(piece: Column) -> Column:
        role = F.regexp_extract(piece, r"^<\|im_start\|>((?:[^\\\n]|\\[\s\S])*+)\n", 1)
        text = F.substr(piece, F.length(role) + len(START) + 2)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    def under(span: Column) -> Column:
        where = span.turn.cast("int")
        return unescape(F.substr(F.get("pieces", where), (span.start - F.get("at", where) + 1).cast("int"), (span.stop - span.start).cast("int")))

    return with_at.select(
        "tree", "branch", "formatted", F.transform("pieces", parsed).alias("turns"), F.array_join(F.transform("loss", under), "").alias("masked")
    )
