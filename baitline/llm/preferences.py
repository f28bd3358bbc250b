"""Preference formatting: one prompt and two masked completions for each pair of conversations.

A pair's longest common prefix of turns is rendered once, as the prompt; what
follows in the chosen and in the rejected conversation is rendered as its
completion, with a mask that trains on the assistant's turns alone.  All of it
is DataFrame expressions on arrays of turns; the only shuffles gather the turns
of a conversation and bring the two conversations of a pair together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import stored

#: How a turn is rendered.
OPEN, CLOSE = "<|{role}|>\n", "<|end|>\n"
TRAINED = "assistant"


def conversations(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Conversation id and its turns (role, text) in order.

    Null roles and texts count as empty.  A repeated row counts once; turns of
    equal number follow role and text; turns without a number come last.  Rows
    without a conversation id belong to none and are left out.
    """
    turn = F.struct(
        F.col(turn_col).isNull().alias("late"), F.col(turn_col).alias("turn"),
        F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"),
    )
    some = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("conv_id"))
    ordered = F.array_sort(F.array_distinct(F.collect_list(turn)))
    return some.agg(F.transform(ordered, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def common_turns(left: Column, right: Column) -> Column:
    """Number of leading turns that agree in role and text."""
    shorter = F.least(F.size(left), F.size(right))
    differs = F.array_position(F.zip_with(left, right, lambda a, b: ~a.eqNullSafe(b)), True)
    return F.when(differs == 0, shorter).otherwise(differs - 1).cast("int")


def _rendered(turn: Column) -> Column:
    before, after = OPEN.split("{role}")
    return F.concat(F.lit(before), turn["role"], F.lit(after), turn["text"], F.lit(CLOSE))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _rendered), "")


def _mask(turns: Column) -> Column:
    """Runs of characters of the rendered turns, trained on or not: opening and content of each turn."""
    def runs(turn):
        opening = F.length(turn["role"]) + len(OPEN) - len("{role}")
        return F.array(
            F.struct(opening.alias("n"), F.lit(False).alias("train")),
            F.struct((F.length(turn["text"]) + len(CLOSE)).alias("n"), (turn["role"] == TRAINED).alias("train")),
        )
    return F.flatten(F.transform(turns, runs))


def format_pairs(pairs: DataFrame) -> DataFrame:
    """Adds n_common, prompt and, for chosen and rejected alike, completion and mask.

    ``pairs`` has ``chosen`` and ``rejected``, arrays of turns (role, text); they
    are replaced by the completions, other columns stay.  Equal conversations
    have empty completions; without a common turn the prompt is empty.
    """
    start = F.col("n_common") + 1
    # the joined length pads the shorter array with nulls, so a longer one differs where the other ends
    counted = pairs.withColumn("n_common", common_turns(F.col("chosen"), F.col("rejected")))
    rest = {side: F.slice(side, start, F.size(side)) for side in ("chosen", "rejected")}
    return counted.withColumns({
        "prompt": _text(F.slice("chosen", F.lit(1), F.col("n_common"))),
        "chosen_mask": _mask(rest["chosen"]), "rejected_mask": _mask(rest["rejected"]),
        "chosen": _text(rest["chosen"]), "rejected": _text(rest["rejected"]),
    })


def _places(turns: Column) -> Column:
    """Places of the assistant's turns, from 1."""
    numbered = F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED, i + 1).otherwise(0))
    return F.filter(numbered, lambda i: i > 0)


def reply_pairs(convs: DataFrame) -> DataFrame:
    """Each conversation up to its last reply, against the same with the reply before it given again.

    A sole reply is set against none.  Conversations without a reply have no pair.
    """
    placed = convs.withColumn("at", _places(F.col("turns"))).where(F.size("at") > 0)
    last, before = F.element_at("at", -1), F.element_at("at", -2)
    stale = F.when(F.size("at") > 1, F.slice("turns", before, 1)).otherwise(F.slice("turns", 1, 0))
    return placed.select(
        F.lit("reply").alias("kind"), F.col("conv_id").alias("chosen_id"), F.col("conv_id").alias("rejected_id"),
        F.slice("turns", F.lit(1), last).alias("chosen"),
        F.concat(F.slice("turns", F.lit(1), last - 1), stale).alias("rejected"),
    )


def opening_pairs(convs: DataFrame) -> DataFrame:
    """Conversations that open with an equal turn: the one of smallest id against each other one.

    A common opening makes as many pairs as it has conversations, less one.  Ids
    are gathered as minima within tasks, and stored, so that each join reads two
    plain shuffles of which one has unique keys: a very common opening is split
    like any skewed side.
    """
    opened = convs.where(F.size("turns") > 0).select("conv_id", F.element_at("turns", 1).alias("opening"))
    marked = opened.select("conv_id", F.sha2(F.to_json("opening"), 256).alias("opening"))
    least = stored(
        marked.groupBy("opening").agg(F.min("conv_id").alias("chosen_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "openings"
    )
    ids = marked.join(least, "opening").where("conv_id != chosen_id").select("conv_id", "chosen_id")
    other = ids.join(convs.withColumnRenamed("turns", "rejected"), "conv_id")
    chosen = convs.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("chosen"))
    return other.join(chosen, "chosen_id").select(
        F.lit("opening").alias("kind"), "chosen_id", F.col("conv_id").alias("rejected_id"), "chosen", "rejected"
    )


def op4_preferences(spark, sf_dir: str) -> DataFrame:
    convs = stored(conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet")), "conversations")
    done = format_pairs(reply_pairs(convs).unionByName(opening_pairs(convs)))
    line = lambda c: F.array_join(F.transform(c, lambda r: F.concat(r["n"].cast("string"), F.when(r["train"], "+").otherwise("-"))), "")
    return done.withColumns({"chosen_mask": line("chosen_mask"), "rejected_mask": line("rejected_mask")})


def _sql() -> str:
    before, after = (x.replace("\n", "' || chr(10) || '") for x in OPEN.split("{role}"))
    close = CLOSE.replace("\n", "' || chr(10) || '")
    text = lambda l: f"array_to_string(list_transform({l}, lambda t: '{before}' || t.role || '{after}' || t.text || '{close}'), '')"
    mask = lambda l: f"array_to_string(list_transform({l}, lambda t: (length(t.role) + {len(OPEN) - 6}) || '-' || (length(t.text) + {len(CLOSE)}) || CASE WHEN t.role = '{TRAINED}' THEN '+' ELSE '-' END), '')"
    return f"""
WITH one AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS LAST, role, text) AS turns FROM one GROUP BY conv_id),
a AS (SELECT conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = '{TRAINED}') AS spots FROM c),
o AS (SELECT *, min(conv_id) OVER (PARTITION BY turns[1]) AS chosen_id FROM c),
p AS (
  SELECT 'reply' AS kind, conv_id AS chosen_id, conv_id AS rejected_id, list_slice(turns, 1, spots[-1]) AS chosen,
         list_concat(list_slice(turns, 1, spots[-1] - 1), CASE WHEN len(spots) > 1 THEN list_slice(turns, spots[-2], spots[-2]) ELSE list_slice(turns, 1, 0) END) AS rejected
  FROM a WHERE len(spots) > 0
  UNION ALL
  SELECT 'opening', o.chosen_id, o.conv_id, c.turns, o.turns FROM o JOIN c ON c.conv_id = o.chosen_id WHERE o.conv_id <> o.chosen_id),
n AS (
  SELECT *, CAST(coalesce(list_min(list_filter(range(1, least(len(chosen), len(rejected)) + 1),
         lambda i: chosen[i].role <> rejected[i].role OR chosen[i].text <> rejected[i].text)) - 1, least(len(chosen), len(rejected))) AS INT) AS n_common
  FROM p)
SELECT kind, chosen_id, rejected_id, n_common, {text('list_slice(chosen, 1, n_common)')} AS prompt,
       {mask('list_slice(chosen, n_common + 1, len(chosen))')} AS chosen_mask, {mask('list_slice(rejected, n_common + 1, len(rejected))')} AS rejected_mask,
       {text('list_slice(chosen, n_common + 1, len(chosen))')} AS chosen, {text('list_slice(rejected, n_common + 1, len(rejected))')} AS rejected
FROM n
"""


OP4_SQL = _sql()
