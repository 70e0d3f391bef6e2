"""Chat formatting (operator 1): preference pairs.

A pair is two conversations, the chosen and the rejected one. What they have in
common from the first turn on is rendered once, as the prompt; the rest of each
is its completion, with a mask that says which of its characters are trained on.

DataFrame functions only. A pair is one row of the result, so its turns are
gathered per pair, and nothing larger ever is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the chat format.
OPEN, CLOSE, END = "<|im_start|>", "<|im_end|>", "\n"


def _render(turns: Column) -> Column:
    one = lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + END))
    return F.array_join(F.transform(turns, one), "")


def _mask(turns: Column, learn: str) -> Column:
    """Runs (length in code points, learn) that cover the rendered turns: learned are text and end mark of the role ``learn``."""
    run = lambda n, on: F.struct(n.alias("length"), on.alias("learn"))
    head = lambda t: F.length(F.coalesce(t["role"], F.lit(""))) + F.lit(len(OPEN) + 1)
    body = lambda t: F.length(F.coalesce(t["text"], F.lit(""))) + F.lit(len(CLOSE))
    runs = lambda t: F.array(run(head(t), F.lit(False)), run(body(t), F.coalesce(t["role"] == learn, F.lit(False))), run(F.lit(len(END)), F.lit(False)))
    return F.flatten(F.transform(turns, runs))


def format_preferences(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """A row for each pair of ``turns`` (pair_id, side, turn, role, text), side being ``chosen`` or ``rejected``.

    Columns: pair_id, n_prompt, n_chosen, n_rejected (turns), prompt,
    chosen, rejected (rendered), chosen_mask and rejected_mask (runs of
    (length, learn) that cover the completion). Turns are ordered by turn, then role and text, nulls
    first; repeated rows are turns of their own. Two turns are equal if role and
    text are, null being equal to null; null renders as empty. A pair that lacks
    a side has an empty completion there and no prompt; a null pair_id or
    another side belongs to no pair; no turns give no rows. Other columns are dropped.
    """
    entry = F.struct("turn", "role", "text")
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, entry)))
    known = turns.where(F.col("pair_id").isNotNull() & F.col("side").isin("chosen", "rejected"))
    pairs = known.groupBy("pair_id").agg(side("chosen").alias("c"), side("rejected").alias("r"))
    c, r = F.col("c"), F.col("r")
    shorter = F.least(F.size(c), F.size(r))
    same = lambda i: c[i]["role"].eqNullSafe(r[i]["role"]) & c[i]["text"].eqNullSafe(r[i]["text"])
    each = F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>"))
    differ = F.filter(each, lambda i: ~same(i))
    pairs = pairs.withColumn("n_prompt", F.coalesce(F.try_element_at(differ, F.lit(1)), shorter))
    tail = lambda x: F.slice(x, F.col("n_prompt") + 1, F.greatest(F.size(x) - F.col("n_prompt"), F.lit(0)))
    pairs = pairs.select("pair_id", "n_prompt", F.slice(c, 1, F.col("n_prompt")).alias("p"), tail(c).alias("c"), tail(r).alias("r"))
    return pairs.select(
        "pair_id", F.col("n_prompt").cast("long"), F.size("c").cast("long").alias("n_chosen"), F.size("r").cast("long").alias("n_rejected"),
        _render(F.col("p")).alias("prompt"), _render(c).alias("chosen"), _render(r).alias("rejected"), _mask(c, learn).alias("chosen_mask"), _mask(r, learn).alias("rejected_mask"),
    )


def mate_preferences(conversations: DataFrame, answer: str = "assistant") -> DataFrame:
    """Preference turns from plain conversations: an answer that was given is preferred to another conversation's.

    Conversations 2k and 2k + 1 are mates. Chosen is a conversation up to its
    last answer, rejected the same with that answer replaced by its mate's last
    one. A conversation without an answer, or whose mate has none, makes no pair.
    Of several answers in the last turn all are kept, each is replaced in the
    rejected side, and the least text (null last) is what the mate gets;
    repeated rows are turns of their own. Rows with a null conv_id or turn
    belong to no pair; null texts and roles are passed on. Other columns are
    dropped, and no conversations make no pairs.
    """
    last = conversations.where(F.col("role") == answer).groupBy("conv_id").agg(F.max("turn").alias("last"))
    rows = conversations.select("conv_id", "turn", "role", "text").join(last, "conv_id").where(F.col("turn") <= F.col("last"))
    end = rows.where((F.col("turn") == F.col("last")) & (F.col("role") == answer)).groupBy("conv_id").agg(F.max("turn").alias("turn"), F.min("text").alias("text"))
    mate = end.select(F.expr("conv_id ^ 1L").alias("conv_id"), F.col("text").alias("other"))
    pairs = rows.join(mate, "conv_id")
    final = (F.col("turn") == F.col("last")) & (F.col("role") == answer)
    both = pairs.withColumn("side", F.explode(F.array(F.lit("chosen"), F.lit("rejected"))))
    text = F.when(final & (F.col("side") == "rejected"), F.col("other")).otherwise(F.col("text"))
    return both.select(F.col("conv_id").alias("pair_id"), "side", "turn", "role", text.alias("text"))
