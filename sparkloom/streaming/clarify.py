"""Questions that ask for a missing fact: counted by conversation, topic and field; as a batch plan and as a stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.shared import settle, ship

ship(__name__)

#: How often a field is asked for, names of fields, characters of a value.
MAX_ASKS, FIELD, VALUE = 2, "^[a-z][a-z0-9_]{0,39}$", 200
#: A turn: whether it changes the topic, whether a bound document was deleted, facts it states, the field its answer would ask for.
EVENT = "conv_id long, turn long, topic_changed boolean, deleted boolean, facts array<struct<field:string,value:string>>, ask string"
ASKED = "conv_id long, turn long, epoch long, field string, asks boolean, attempts int"


def sound(events: DataFrame) -> DataFrame:
    """Turns that can be applied, once each: with keys, and only facts and questions with a proper field and value."""
    proper = F.coalesce(F.forall("facts", lambda f: F.coalesce(F.rlike(f["field"], F.lit(FIELD)) & (F.trim(f["value"]) != "") & (F.length(f["value"]) <= VALUE), F.lit(False))), F.lit(True))
    good = events.where("conv_id is not null and turn is not null").where(proper & F.coalesce(F.rlike("ask", F.lit(FIELD)), F.lit(True)))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    return good.select("conv_id", "turn", flag("topic_changed"), flag("deleted"), F.coalesce("facts", F.array().cast("array<struct<field:string,value:string>>")).alias("facts"), "ask")


def clarifications(events: DataFrame, most: int = MAX_ASKS) -> DataFrame:
    """``(conv_id, turn, epoch, field, asks, attempts)`` for each turn that would ask.

    A field is asked for while the conversation has not stated it and it was
    asked fewer than ``most`` times. A change of topic starts a new epoch without
    facts and counts, before the turn's own facts count; a deleted document does
    so from epoch 0. Of rows of one turn the smallest counts. Resets are summed
    in ranges of turns, so a long conversation is not one task.
    """
    once = sound(events).groupBy("conv_id", "turn").agg(F.min(F.struct("topic_changed", "deleted", "facts", F.coalesce("ask", F.lit("")).alias("ask"))).alias("e"))
    rows = once.select("conv_id", "turn", "e.*")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(rows.repartitionByRange(parts, "conv_id", "turn").withColumn("_range", F.spark_partition_id()), "turns")
    # resets so far, and the last deletion with the changes of topic up to it
    changed, gone = (F.col(c).cast("long") for c in ("topic_changed", "deleted"))
    kinds = {"topics": F.when(F.col("deleted"), 0).otherwise(changed), "deletions": gone}
    sums = dealt.groupBy("conv_id", "_range").agg(*[F.sum(v).alias(f"_{k}") for k, v in kinds.items()])
    before = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("conv_id", "_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in kinds])
    inside = Window.partitionBy("conv_id", "_range").orderBy("turn")
    run = dealt.join(ahead, ["conv_id", "_range"]).select("conv_id", "turn", "deleted", "facts", "ask", *[(F.col(f"_{k}") + F.sum(v).over(inside)).alias(k) for k, v in kinds.items()])
    start = run.groupBy("conv_id", "deletions").agg(F.min("topics").alias("_first"), F.max_by("deleted", -F.col("turn")).alias("_deleted"))
    # a deletion's own turn has epoch 0; the first segment begins with epoch 0 too, so a change in its first turn counts
    base = F.when(F.col("deletions") > 0, F.col("_first")).otherwise(0)
    at = run.join(start.select("conv_id", "deletions", base.alias("_base")), ["conv_id", "deletions"]).withColumn("epoch", F.col("topics") - F.col("_base"))
    told = at.select("conv_id", "deletions", "epoch", "turn", F.explode("facts").alias("f")).groupBy("conv_id", "deletions", "epoch", F.col("f.field").alias("ask")).agg(F.min("turn").alias("told"))
    asks = at.where("ask <> ''").join(told, ["conv_id", "deletions", "epoch", "ask"], "left").withColumn("known", F.coalesce(F.col("told") <= F.col("turn"), F.lit(False)))
    count = F.row_number().over(Window.partitionBy("conv_id", "deletions", "epoch", "ask", "known").orderBy("turn"))
    free = ~F.col("known") & (count <= most)
    return asks.select("conv_id", "turn", "epoch", F.col("ask").alias("field"), free.alias("asks"), F.when(free, count).alias("attempts"))


def empty() -> dict:
    return {"epoch": 0, "facts": [], "counts": {}}


def step(state: dict, turn: dict, most: int = MAX_ASKS) -> tuple[dict, tuple | None]:
    """The state after a turn, and (epoch, field, asks, attempts) if the turn would ask."""
    if turn["deleted"]:
        state = empty()
    elif turn["topic_changed"]:
        state = empty() | {"epoch": state["epoch"] + 1}
    facts = set(state["facts"]) | {f["field"] for f in turn["facts"]}
    state = state | {"facts": sorted(facts), "counts": dict(state["counts"])}
    field = turn["ask"]
    if not field:
        return state, None
    count = state["counts"].get(field, 0)
    asks = field not in facts and count < most
    if asks:
        state["counts"][field] = count + 1
    return state, (state["epoch"], field, asks, count + 1 if asks else None)


class Clarifier(StatefulProcessor):
    """Keeps a conversation's turns by number; a late turn has all later ones judged anew, a repeated one changes nothing if it is no smaller."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getMapState("turns", "turn long", "event string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            for r in frame.itertuples():
                facts = sorted(({"field": f["field"], "value": f["value"]} for f in r.facts), key=lambda f: (f["field"], f["value"]))
                event = json.dumps([bool(r.topic_changed), bool(r.deleted), facts, r.ask or ""])
                at = (int(r.turn),)
                old = self.turns.getValue(at)[0] if self.turns.containsKey(at) else None
                if old is None or _order(event) < _order(old):
                    self.turns.updateValue(at, (event,))
        state, out = empty(), []
        for turn, event in sorted((int(k[0]), v[0]) for k, v in self.turns.iterator()):
            changed, deleted, facts, ask = json.loads(event)
            state, asked = step(state, {"topic_changed": changed, "deleted": deleted, "facts": facts, "ask": ask})
            if asked:
                out.append((key[0], turn, *asked))
        frame = pd.DataFrame(out, columns=["conv_id", "turn", "epoch", "field", "asks", "attempts"])
        yield frame.astype({"attempts": "Int32"})

    def close(self) -> None:
        pass


def _order(event: str) -> tuple:
    changed, deleted, facts, ask = json.loads(event)
    return changed, deleted, [(f["field"], f["value"]) for f in facts], ask


def stream_clarifications(events: DataFrame) -> DataFrame:
    """The same over a stream: the last row of each conversation and turn equals the batch form once all input is read, in any order.

    A conversation's turns are its state. The stream needs the RocksDB state store.
    """
    return sound(events).groupBy("conv_id").transformWithStateInPandas(Clarifier(), ASKED, "Update", "None")


def without_document(state: DataFrame, deleted: DataFrame) -> DataFrame:
    """Conversation states with those emptied whose bound document was deleted: ``conv_id, document_id`` and any state columns.

    ``deleted`` has document_id; the columns of an emptied state are null. A
    state without a document stays.
    """
    gone = deleted.select("document_id", F.lit(True).alias("_gone")).where("document_id is not null").distinct()
    marked = state.join(gone, "document_id", "left")
    return marked.select("conv_id", *[F.when(F.col("_gone").isNull(), F.col(c)).alias(c) for c in state.columns if c != "conv_id"])
