"""Preference formatting: one prompt, two masked completions (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"
_SHOWN = "concat('<|', x.role, '|>\\n', x.text, '<|end|>\\n')"


def conversations_of(turns: DataFrame) -> DataFrame:
    """``conv_id, turns``: the turns of each conversation in order.

    Turns of equal number go by role and text; a null role or text counts as empty, a
    null number comes first. Rows with a null ``conv_id`` form one conversation.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    listed = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"))
    return listed.select("conv_id", F.expr("transform(t, x -> struct(x.role AS role, x.text AS text))").alias("turns"))


def stale_pairs(conversations: DataFrame) -> DataFrame:
    """``conv_id, chosen, rejected`` for every conversation with a reply.

    Chosen: the conversation up to its last ``assistant`` turn. Rejected: the same with
    that reply replaced by the assistant's reply before it (an empty one if there is
    none), as a model that does not follow the talk would give.
    """
    last = "array_max(transform(turns, (x, i) -> IF(x.role = 'assistant', i, -1)))"
    before = "array_max(transform(turns, (x, i) -> IF(x.role = 'assistant' AND i < last, i, -1)))"
    return (
        conversations.withColumn("last", F.expr(last))
        .filter("last >= 0")
        .withColumn("earlier", F.expr(f"coalesce(get(turns, {before}).text, '')"))
        .withColumn("chosen", F.expr("slice(turns, 1, last + 1)"))
        .select(
            "conv_id",
            "chosen",
            F.expr(
                "transform(chosen, (x, i) -> named_struct('role', x.role, 'text', IF(i = last, earlier, x.text)))"
            ).alias("rejected"),
        )
    )


def format_preferences(pairs: DataFrame) -> DataFrame:
    """Other columns of ``pairs``, then ``prompt_turns, prompt`` and, for both sides, completion and mask.

    ``pairs`` holds ``chosen`` and ``rejected``, each a list of (role, text). The
    longest run of leading turns that both share, role and text, is rendered once as
    the prompt; what follows on each side is its completion. A turn is shown as
    ``<|role|>``, a new line, its text, ``<|end|>`` and a new line. A mask lists the
    stretches [start, end) of a completion, in characters, that a loss may count: text
    and end mark of ``assistant`` turns. Equal conversations have two empty
    completions, a conversation that begins the other one has an empty completion, and
    a null list counts as an empty one. Repeated pairs are formatted one by one.
    """
    kept = [
        c for c in pairs.columns
        if c not in ("chosen", "rejected", "prompt_turns", "prompt", "chosen_mask", "rejected_mask")
    ]
    t = pairs.select(*kept, *[F.coalesce(c, F.array().cast(TURNS)).cast(TURNS).alias(f"_{c}") for c in ("chosen", "rejected")])
    t = t.withColumn("_least", F.least(F.size("_chosen"), F.size("_rejected")))
    t = t.withColumn(
        "_apart", F.expr("array_position(transform(slice(_chosen, 1, _least), (x, i) -> x <=> get(_rejected, i)), false)")
    )
    t = t.withColumn("prompt_turns", F.expr("IF(_apart = 0, _least, CAST(_apart - 1 AS INT))"))
    t = t.withColumn("prompt", F.expr(f"array_join(transform(slice(_chosen, 1, prompt_turns), x -> {_SHOWN}), '')"))
    for side in ("chosen", "rejected"):
        t = t.withColumn(f"_{side}", F.expr(f"slice(_{side}, prompt_turns + 1, size(_{side}))"))
        mask = F.expr(
            f"aggregate(_{side}, named_struct('at', 0, 'spans', CAST(array() AS array<struct<start:int,end:int>>)), (a, x) ->"
            f" named_struct('at', a.at + length({_SHOWN}), 'spans', IF(x.role = 'assistant', concat(a.spans, array("
            f"named_struct('start', a.at + length(x.role) + 5, 'end', a.at + length({_SHOWN})))), a.spans)), a -> a.spans)"
        )
        t = t.withColumn(side, F.expr(f"array_join(transform(_{side}, x -> {_SHOWN}), '')")).withColumn(f"{side}_mask", mask)
    return t.select(*kept, "prompt_turns", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")
