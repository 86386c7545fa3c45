"""Chat formatting by multi-party perspective rotation, in DataFrame functions alone.

For every participant of a conversation the dialogue is rendered with that speaker as the assistant and all others as named
users; the mask lists where the assistant's own words stand, in code points of the rendered text, ends exclusive. System
messages stay system messages in every view and are nobody's view.

A view is rendered in parts of PART turn numbers (part 0 holds turns 0 to 63, and so on), so that a very long conversation
is spread over tasks; the parts of a view, in order, are the whole rendering, and a mask counts from its part's beginning. With
part=None a view is one row, whatever its length. Messages come in order of turn, then role and
text. A message whose role is null is by a user named "unknown", who has no view; null text is empty; a null turn counts as
0; rows of a null conv_id belong to no conversation. Repeated rows are repeated messages. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PART, SYSTEM, UNKNOWN = 64, "system", "unknown"


def rotate(conversations: DataFrame, part: int | None = PART) -> DataFrame:
    """One row per conversation, participant and part: conv_id, speaker, part, n_messages, n_trained, rendered, mask. part: turn numbers of a part, None for whole views."""
    turns = conversations.where("conv_id is not null").select(
        "conv_id",
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit(UNKNOWN)).alias("role"),
        F.col("role").isNull().alias("nobody"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    views = turns.where((F.col("role") != SYSTEM) & ~F.col("nobody")).select("conv_id", F.col("role").alias("speaker")).distinct()
    seen = turns.join(views, "conv_id")
    own = (F.col("role") == F.col("speaker")) & ~F.col("nobody")
    head = F.when(own, F.lit("assistant")).when(F.col("role") == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), "role"))
    message = F.struct("turn", "role", "text", F.concat(F.lit("<|im_start|>"), head, F.lit("\n")).alias("head"), own.alias("own"))
    of = F.floor(F.col("turn") / part) if part else F.lit(0).cast("long")
    parts = seen.groupBy("conv_id", "speaker", of.alias("part")).agg(F.array_sort(F.collect_list(message)).alias("m"))
    end = "<|im_end|>\n"

    def add(acc, x):
        start = acc.at + F.length(x.head)
        stop = start + F.length(x.text)
        span = F.concat_ws(":", start.cast("string"), stop.cast("string"))
        return F.struct((stop + len(end)).alias("at"), F.when(x.own, F.concat(acc.spans, F.array(span))).otherwise(acc.spans).alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))
    return parts.select(
        "conv_id",
        "speaker",
        "part",
        F.size("m").cast("long").alias("n_messages"),
        F.size(F.filter("m", lambda x: x.own)).cast("long").alias("n_trained"),
        F.array_join(F.transform("m", lambda x: F.concat(x.head, x.text, F.lit(end))), "").alias("rendered"),
        F.array_join(F.aggregate("m", first, add, lambda acc: acc.spans), ",").alias("mask"),
    )
