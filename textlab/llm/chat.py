"""Preference formatting of chosen and rejected conversations, in DataFrame functions only.

The longest common prefix of turns (same role and text) is rendered once as the prompt; what
follows on either side is the completion. The mask of a completion lists the spans (code points,
end exclusive) that a loss counts: text and end mark of assistant turns.

All turns of a conversation meet in one row, so a conversation must fit a task's memory; rows without a
conv_id belong to none and are left out. Null roles and texts count as empty. Equal conversations have empty completions and masks; an
empty conversation gives an empty prompt. Repeated pairs give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .quality import let

OPEN, END = "<|im_start|>", "<|im_end|>"
LEARNED = "assistant"


def head(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit("\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(head(t), t["text"], F.lit(END + "\n"))), "")


def mask(turns: Column) -> Column:
    """start:end of what is learned of the rendered turns, comma-joined."""
    size = lambda t: F.length(head(t)) + F.length(t["text"]) + len(END) + 1

    def step(s: Column, t: Column) -> Column:
        begin = s["at"] + F.length(head(t))
        span = F.concat_ws(":", begin.cast("string"), (begin + F.length(t["text"]) + len(END)).cast("string"))
        spans = F.when(t["role"] == LEARNED, F.concat(s["spans"], F.array(span))).otherwise(s["spans"])
        return F.struct((s["at"] + size(t)).alias("at"), spans.alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return F.array_join(F.aggregate(turns, start, step, lambda s: s["spans"]), ",")


def common_turns(a: Column, b: Column) -> Column:
    """Number of leading turns that are the same in both arrays."""
    equal = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.coalesce(F.nullif(F.array_position(equal, False), F.lit(0)) - 1, F.size(a)).cast("int")


def preference(pairs: DataFrame) -> DataFrame:
    """pairs: chosen and rejected as arrays of struct<role, text>; adds n_prompt_turns, prompt, completions and masks in their place."""
    clean = lambda c: F.transform(F.coalesce(c, F.array().cast("array<struct<role:string,text:string>>")), lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    pairs = pairs.withColumns({"chosen": clean(F.col("chosen")), "rejected": clean(F.col("rejected"))})
    pairs = pairs.withColumn("n_prompt_turns", common_turns(F.col("chosen"), F.col("rejected")))
    rest = lambda c: F.slice(F.col(c), F.col("n_prompt_turns") + 1, F.greatest(F.size(c) - F.col("n_prompt_turns"), F.lit(0)))
    return pairs.withColumns({"prompt": render(F.slice("chosen", 1, F.col("n_prompt_turns"))), "chosen": rest("chosen"), "rejected": rest("rejected")}).withColumns({"chosen_mask": mask(F.col("chosen")), "rejected_mask": mask(F.col("rejected")), "chosen": render(F.col("chosen")), "rejected": render(F.col("rejected"))})


def with_swapped_answer(turns: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) from plain conversations.

    The rejected one is the conversation with its last assistant turn taken from the neighbour,
    the conversation whose id differs in the last bit. Those without such a turn or neighbour
    give no pair. Rows of equal conv_id and turn are ordered by role and text.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    convs = convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"))
    answers = F.filter(F.transform("chosen", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == LEARNED)
    convs = convs.withColumn("answer", F.get(F.slice(answers, -1, 1), F.lit(0))).filter("answer IS NOT NULL")
    both = convs.select(F.shiftright("conv_id", 1).alias("pair"), F.struct("conv_id", "chosen", "answer").alias("c")).groupBy("pair").agg(F.sort_array(F.collect_list("c")).alias("c")).filter(F.size("c") == 2)
    each = both.select(F.explode(F.array(F.struct(F.col("c")[0].alias("a"), F.col("c")[1].alias("b")), F.struct(F.col("c")[1].alias("a"), F.col("c")[0].alias("b")))).alias("p"))
    swapped = F.transform("p.a.chosen", lambda t, i: F.when(i == F.col("p.a.answer.i"), F.struct(t["role"].alias("role"), F.col("p.b.answer.text").alias("text"))).otherwise(t))
    return each.select(F.col("p.a.conv_id").alias("conv_id"), F.col("p.a.chosen").alias("chosen"), swapped.alias("rejected"))


def conversations(turns: DataFrame) -> DataFrame:
    """conv_id and its turns as an array, ordered by turn, then role and text."""
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = turns.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("t"))
    return convs.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("chosen"))


def with_next_answer(turns: DataFrame) -> DataFrame:
    """Pairs (conv_id, chosen, rejected) of all conversations.

    The rejected one has an answer of the conversation replaced by the last one of the next
    conversation in the order of ids that has any (after the last: the first): its last answer, so that the sides part
    late, or, where the id is odd, its first, so that equal turns can follow. Without an
    assistant turn both sides are equal. Conversations are numbered range by range.
    """
    spark = turns.sparkSession
    answers = F.filter(F.transform("chosen", lambda t, i: F.struct(i.alias("i"), t["role"].alias("role"), t["text"].alias("text"))), lambda t: t["role"] == LEARNED)
    convs = conversations(turns).withColumn("answers", answers)
    swapped_at = F.when(F.col("conv_id") % 2 == 0, F.get(F.col("answers"), F.size("answers") - 1)["i"]).otherwise(F.get(F.col("answers"), F.lit(0))["i"])
    own = convs.select("conv_id", "chosen", swapped_at.alias("at"), F.get(F.col("answers"), F.size("answers") - 1)["text"].alias("answer"))
    ranged = own.filter("answer IS NOT NULL").select("conv_id", "answer").repartitionByRange(common.partitions(spark), "conv_id").withColumn("part", F.spark_partition_id())
    ranged = common.stored(ranged)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    offset = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    numbered = ranged.join(F.broadcast(offset), "part").select("conv_id", "answer", (F.col("offset") + F.row_number().over(Window.partitionBy("part").orderBy("conv_id"))).alias("n"))
    total = ranged.count()
    givers = numbered.select(F.col("answer").alias("other"), "n")
    given = numbered.select("conv_id", (F.col("n") % max(1, total) + 1).alias("n")).join(givers, "n").select("conv_id", "other")
    rejected = F.transform("chosen", lambda t, i: F.when(i == F.col("at"), F.struct(t["role"].alias("role"), F.col("other").alias("text"))).otherwise(t))
    return own.join(given, "conv_id", "left").select("conv_id", "chosen", F.when(F.col("other").isNull(), F.col("chosen")).otherwise(rejected).alias("rejected"))


def op7_preference_format(spark, sf_dir: str) -> DataFrame:
    """Query: all conversations against themselves with an answer of the next one."""
    out = preference(with_next_answer(common.table(spark, sf_dir, "conversations")))
    return out.select("conv_id", F.col("n_prompt_turns").cast("long").alias("n_prompt_turns"), "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


OP7_SQL = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ends AS (SELECT conv_id, max(i) AS i, CASE WHEN conv_id % 2 = 0 THEN max(i) ELSE min(i) END AS swap FROM t WHERE role = 'assistant' GROUP BY conv_id),
answer AS (SELECT e.conv_id, e.swap, t.text FROM ends e JOIN t ON t.conv_id = e.conv_id AND t.i = e.i),
pairs AS (SELECT conv_id, swap, coalesce(lead(text) OVER (ORDER BY conv_id), first_value(text) OVER (ORDER BY conv_id)) AS other FROM answer),
turns AS (
  SELECT t.conv_id, t.i, t.role, t.text, CASE WHEN t.i = p.swap THEN p.other ELSE t.text END AS changed
  FROM t LEFT JOIN pairs p USING (conv_id)),
cut AS (SELECT conv_id, coalesce(min(CASE WHEN text <> changed THEN i END) - 1, max(i)) AS n FROM turns GROUP BY conv_id),
sized AS (
  SELECT turns.*, cut.n,
         coalesce(sum(length(role) + length(text) + 24) OVER w, 0) AS at_c,
         coalesce(sum(length(role) + length(changed) + 24) OVER w, 0) AS at_r
  FROM turns JOIN cut USING (conv_id)
  WINDOW w AS (PARTITION BY turns.conv_id, turns.i <= cut.n ORDER BY turns.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, CAST(min(n) AS BIGINT) AS n_prompt_turns,
  coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (i <= n), '') AS prompt,
  coalesce(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (i > n), '') AS chosen,
  coalesce(string_agg('<|im_start|>' || role || chr(10) || changed || '<|im_end|>' || chr(10), '' ORDER BY i) FILTER (i > n), '') AS rejected,
  coalesce(string_agg(CAST(at_c + length(role) + 13 AS BIGINT) || ':' || CAST(at_c + length(role) + 23 + length(text) AS BIGINT), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(CAST(at_r + length(role) + 13 AS BIGINT) || ':' || CAST(at_r + length(role) + 23 + length(changed) AS BIGINT), ',' ORDER BY i) FILTER (i > n AND role = 'assistant'), '') AS rejected_mask
FROM sized GROUP BY conv_id
"""
