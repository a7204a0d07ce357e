"""Preference formatting: the longest common turn prefix once as prompt, and paired masked completions.

DataFrame functions only. A conversation is an array of (role, text); two conversations of a pair share their first turns,
up to the first that differs in role or text. The shared turns are rendered once; the rest of each is a completion, with
the character ranges that bear loss: the texts of its assistant turns and their end marks.

Edge cases: null roles and texts are empty; no common turn gives an empty prompt; equal conversations give empty
completions and `degenerate`; a conversation is one row by nature, however long its texts; ties of turns are ordered by role
and text; repeated rows give a pair each; an empty table gives no rows; extra columns are left out, and the id may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(f"{END}\n"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _loss(turns: Column) -> Column:
    """Ranges [start, end) of the rendered turns that bear loss, as start:end, comma-joined."""

    def add(acc: Column, turn: Column) -> Column:
        start = acc["at"] + F.length(turn["role"]) + 5
        end = start + F.length(turn["text"]) + len(END)
        ranges = F.when(turn["role"] == "assistant", F.concat(acc["ranges"], F.array(F.concat_ws(":", start.cast("string"), end.cast("string"))))).otherwise(acc["ranges"])
        return F.struct((end + 1).alias("at"), ranges.alias("ranges"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("ranges"))
    return F.aggregate(turns, first, add, lambda acc: F.array_join(acc["ranges"], ","))


def format_pairs(pairs: DataFrame, id_col: str = "pair_id", chosen: str = "chosen", rejected: str = "rejected") -> DataFrame:
    """(pair id, n_common, prompt, chosen, rejected, chosen_loss, rejected_loss, degenerate) from arrays of (role, text)."""
    plain = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    own = pairs.select(F.struct(id_col).alias("key"), plain(chosen).alias("c"), plain(rejected).alias("r"))
    n = F.least(F.size("c"), F.size("r"))
    same = F.zip_with(F.slice("c", 1, n), F.slice("r", 1, n), lambda a, b: a == b)
    first = F.array_position(same, F.lit(False))
    own = own.withColumn("n_common", F.when(first > 0, first - 1).otherwise(n.cast("long")))
    k = F.col("n_common").cast("int")
    own = own.withColumns({"prompt": _joined(F.slice("c", 1, k)), "cc": F.slice("c", k + 1, F.size("c")), "rr": F.slice("r", k + 1, F.size("r"))})
    return own.select(
        "key.*", "n_common", "prompt", _joined(F.col("cc")).alias("chosen"), _joined(F.col("rr")).alias("rejected"),
        _loss(F.col("cc")).alias("chosen_loss"), _loss(F.col("rr")).alias("rejected_loss"), ((F.size("cc") == 0) & (F.size("rr") == 0)).alias("degenerate"),
    )


def stale_reply_pairs(conversations: DataFrame) -> DataFrame:
    """(conv_id, chosen, rejected) of every conversation with an assistant turn.

    chosen ends with the last assistant turn; rejected has, in its place, the stale reply: the assistant's text before
    it, else the text of the turn before it, else nothing. Turns are ordered by turn, role and text.
    """
    turn = F.struct(F.coalesce("turn", F.lit(-1)).alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = conversations.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    own = own.withColumn("turns", F.transform("turns", lambda t: F.struct(t["role"], t["text"])))
    replies = F.filter(F.transform("turns", lambda t, i: F.when(t["role"] == "assistant", i + 1)), lambda x: x.isNotNull())
    own = own.withColumn("replies", replies).where("size(replies) > 0")
    last = F.element_at("replies", -1)
    before = F.when(F.size("replies") > 1, F.get("turns", F.element_at("replies", -2) - 1)["text"]).otherwise(F.coalesce(F.get("turns", last - 2)["text"], F.lit("")))
    return own.select(
        "conv_id",
        F.slice("turns", 1, last).alias("chosen"),
        F.concat(F.slice("turns", 1, last - 1), F.array(F.struct(F.lit("assistant").alias("role"), before.alias("text")))).alias("rejected"),
    )


_R = "'<|' || {t}.role || '|>\n' || {t}.text || '<|end|>\n'"
ORACLE = f"""
WITH c AS (SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY coalesce(turn, -1), coalesce(role, ''), coalesce(text, '')) AS turns
           FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
a AS (SELECT *, [i for i in range(1, len(turns) + 1) if turns[i].role = 'assistant'] AS replies FROM c),
b AS (SELECT *, replies[-1] AS last, CASE WHEN len(replies) > 1 THEN turns[replies[-2]].text WHEN replies[-1] > 1 THEN turns[replies[-1] - 1].text ELSE '' END AS stale
      FROM a WHERE len(replies) > 0),
p AS (SELECT *, CASE WHEN stale = turns[last].text THEN last ELSE last - 1 END AS n_common FROM b)
SELECT conv_id, n_common::BIGINT AS n_common,
       array_to_string([{_R.format(t="t")} for t in turns[1:n_common]], '') AS prompt,
       CASE WHEN n_common < last THEN {_R.format(t="turns[last]")} ELSE '' END AS chosen,
       CASE WHEN n_common < last THEN '<|assistant|>\n' || stale || '<|end|>\n' ELSE '' END AS rejected,
       CASE WHEN n_common < last THEN '14:' || (14 + length(turns[last].text) + 7) ELSE '' END AS chosen_loss,
       CASE WHEN n_common < last THEN '14:' || (14 + length(stale) + 7) ELSE '' END AS rejected_loss,
       n_common = last AS degenerate
FROM p
"""
