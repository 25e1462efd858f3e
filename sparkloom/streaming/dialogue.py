"""Keyed conversation state: a batch form as windows, and the same as a stateful stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A user turn that starts a new topic resets the facts. The rule is a parameter of both forms.
STATE = "conv_id long, turns long, epoch long, last_user string, history array<string>"


def resets(text: Column) -> Column:
    """Whether a turn changes the topic: here, whether it opens with a question of one short sentence."""
    return F.length(text) < 60


def fold_conversations(rows: DataFrame, keep: int = 4) -> DataFrame:
    """``(conv_id, turns, epoch, last_user, history)``: turn count, topic epoch, last user text, last ``keep`` user texts of the epoch."""
    user = rows.where("role = 'user'")
    order = Window.partitionBy("conv_id").orderBy("turn")
    marked = user.withColumn("epoch", F.sum(resets(F.col("text")).cast("long")).over(order)).withColumn("place", F.row_number().over(order))
    last = Window.partitionBy("conv_id", "epoch").orderBy(F.desc("turn"))
    recent = marked.withColumn("back", F.row_number().over(last))
    facts = marked.groupBy("conv_id").agg(F.count("*").alias("turns"), F.max("epoch").alias("epoch"), F.max_by("text", "turn").alias("last_user"))
    kept = recent.where(F.col("back") <= keep).groupBy("conv_id", "epoch").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("h"))
    return facts.join(kept, ["conv_id", "epoch"]).select("conv_id", "turns", "epoch", "last_user", F.transform("h", lambda s: s["text"]).alias("history"))


def _update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    turns, epoch, last, history = state.get if state.exists else (0, 0, None, [])
    history = list(history)
    for row in pd.concat(list(batches)).sort_values("turn").itertuples():
        if len(row.text) < 60:
            epoch, history = epoch + 1, []
        turns, last, history = turns + 1, row.text, [*history, row.text][-4:]
    state.update((turns, epoch, last, history))
    yield pd.DataFrame({"conv_id": [key[0]], "turns": [turns], "epoch": [epoch], "last_user": [last], "history": [history]})


def stream_conversations(rows: DataFrame) -> DataFrame:
    """The same state over a stream of rows; each key's last output row equals the batch form once all input is read.

    Turns of a key that arrive in one batch are put in order; a turn that comes a batch late is applied late.
    """
    return rows.where("role = 'user'").groupBy("conv_id").applyInPandasWithState(_update, STATE, "turns long, epoch long, last_user string, history array<string>", "update", "NoTimeout")


def once_per_request(rows: DataFrame, key: str, at: str, delay: str = "10 minutes") -> DataFrame:
    """Requests that were seen before within ``delay`` are dropped; on a batch all repeats are."""
    if rows.isStreaming:
        return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])
    return rows.dropDuplicates([key])
