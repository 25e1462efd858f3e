"""Queries: clarifying questions over all turns of all conversations, and states without deleted documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table as t
from ..streaming import clarify
from .registry import query

#: Fields by turn; a short turn changes the topic, some delete a document, those with certain words state a fact.
FIELDS = ("end_date", "deposit", "role")


def events_of(rows):
    field = lambda c: F.element_at(F.array(*[F.lit(f) for f in FIELDS]), (c % 3 + 1).cast("int"))
    fact = F.array(F.struct(field(F.col("turn") + F.col("conv_id")).alias("field"), F.lit("stated").alias("value")))
    none = F.array().cast("array<struct<field:string,value:string>>")
    return rows.select("conv_id", "turn", (F.length("text") < 60).alias("topic_changed"), ((F.col("conv_id") % 5 == 0) & (F.col("turn") % 4 == 3)).alias("deleted"), F.when(F.contains("text", F.lit(" re")), fact).otherwise(none).alias("facts"), field(F.floor(F.col("turn") / 2)).alias("ask"))


_NAMES = "['end_date', 'deposit', 'role']"


@query(
    "stm13_clarifications",
    f"""with e as (select conv_id, turn, length(text) < 60 as t, conv_id % 5 = 0 and turn % 4 = 3 as d, case when contains(text, ' re') then {_NAMES}[((turn + conv_id) % 3 + 1)::int] end as fact, {_NAMES}[(turn // 2 % 3 + 1)::int] as ask from conversations),
s as (select *, sum(d::int) over w as seg from e window w as (partition by conv_id order by turn)),
p as (select *, sum((t and not d)::int) over (partition by conv_id, seg order by turn) as epoch from s),
k as (select *, coalesce(max((fact = ask)::int) over (partition by conv_id, seg, epoch, ask order by turn), 0) as own,
  exists (select 1 from p q where q.conv_id = p.conv_id and q.seg = p.seg and q.epoch = p.epoch and q.turn <= p.turn and q.fact = p.ask) as known from p),
c as (select *, row_number() over (partition by conv_id, seg, epoch, ask, known order by turn) as r from k)
select conv_id, turn, epoch::bigint as epoch, ask as field, not known and r <= 2 as asks, case when not known and r <= 2 then r end::int as attempts from c""",
)
def _(spark, sf):
    """Whether each turn asks for its field, and how often it was asked for by then."""
    return clarify.clarifications(events_of(t(spark, sf, "conversations")))


@query("stm03_invalidated_documents", "select conv_id, case when doc % 7 <> 3 then 'd' || doc end as document_id, case when doc % 7 <> 3 then last end as last_text from (select conv_id, conv_id % 20 as doc, md5(arg_max(text, turn)) as last from conversations group by conv_id)")
def _(spark, sf):
    """States of all conversations, emptied where the document they are bound to was deleted."""
    states = t(spark, sf, "conversations").groupBy("conv_id").agg(F.md5(F.max_by("text", "turn")).alias("last_text")).select("conv_id", F.concat(F.lit("d"), (F.col("conv_id") % 20).cast("string")).alias("document_id"), "last_text")
    deleted = states.where("conv_id % 20 % 7 = 3").select("document_id")
    return clarify.without_document(states, deleted)
