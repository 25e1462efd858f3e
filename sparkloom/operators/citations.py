"""Citations of answers resolved against their evidence: supported mentions, and spans to show with excerpt and link."""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import citations as grammar
from .folds import fold_rows
from .shared import settle, ship

ship(grammar.__name__)

_IDENT = ["kind", "name", "article", "branch", "number"]


def _facts(evidence: DataFrame, key: str) -> DataFrame:
    row = F.when(F.col("doc_type").isNotNull(), F.struct("doc_type", "citation", "text"))
    return fold_rows(evidence.select(key, "rank", "chunk_id", row.alias("row")), [key, "rank", "chunk_id"], "row", grammar.facts, grammar.FACT)


def _found(answers: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """Mentions of each answer; statute names as the longest known name they end with."""
    titled = facts.where("kind = 'law' and title <> ''").groupBy(key).agg(F.collect_set(F.struct("name", "article", "branch", "title")).alias("titles"))
    rows = answers.where(F.col("text").isNotNull()).join(titled, key, "left").select(key, F.struct("text", "titles").alias("row"))
    found = fold_rows(rows, [key], "row", grammar.mentions, grammar.MENTION)
    known = facts.where("kind = 'known'").select(key, F.col("name").alias("known")).distinct()
    fits = (found[key] == known[key]) & (found["kind"] == "law") & F.endswith(found["name"], known["known"])
    own = found.join(known, fits, "left").select(*[found[c] for c in found.columns], "known")
    best = own.groupBy(*found.columns).agg(F.max_by("known", F.length("known")).alias("known"))
    return best.withColumn("name", F.coalesce("known", "name")).drop("known")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    on = F.lit(True)
    for c in names:
        on = on & a[c].eqNullSafe(b[c])
    return on


def citation_mentions(answers: DataFrame, evidence: DataFrame, key: str = "answer_id") -> DataFrame:
    """Statutes, decisions and agencies that an answer names, once each: ``key, start, kind, text, supported, chunk_ids``.

    ``answers`` has key and text; ``evidence`` key, rank, chunk_id, doc_type,
    citation and text. Only evidence of the same key supports a mention: a
    statute by its own article (never by what its text refers to), a decision by
    court and number or, if the answer names no court, by number, an agency by
    the citation of a guide. The first of equal mentions stays. Keys are unique
    in ``answers``; null keys and texts have no mentions.
    """
    facts = _facts(evidence, key)
    found = _found(answers, facts, key).where("kind in ('law', 'case', 'guide')")
    first = Window.partitionBy(key, *_IDENT).orderBy("start")
    once = found.withColumn("_nr", F.row_number().over(first)).where("_nr = 1")
    keyed = facts.where("kind in ('law', 'case', 'guide')").select(key, *_IDENT, "chunk_id")
    joined = once.join(keyed, _same(once, keyed, [key, *_IDENT]), "left").select(*[once[c] for c in (key, "start", "kind", "text")], *[once[c].alias(f"_{c}") for c in _IDENT[1:]], "chunk_id")
    ids = F.array_sort(F.collect_set("chunk_id"))
    out = joined.groupBy(key, "start", "kind", "text", *[f"_{c}" for c in _IDENT[1:]]).agg(ids.alias("chunk_ids"))
    return out.select(key, "start", "kind", "text", (F.size("chunk_ids") > 0).alias("supported"), "chunk_ids")


def spans_within(answers: DataFrame, key: str = "answer_id", decisions: bool = True) -> DataFrame:
    """``citation_spans`` of answers that have their evidence beside them: ``answers`` has key, text and evidence, a list of structs. No shuffle.

    Without ``decisions`` no excerpts are made of decisions; they are null.
    """
    chunk = answers.schema["evidence"].dataType.elementType["chunk_id"].dataType.simpleString()
    rows = answers.where(F.col(key).isNotNull() & F.col("text").isNotNull()).select(key, F.struct("text", "evidence").alias("row"))
    return settle(fold_rows(rows, [key], "row", partial(grammar.spans, decisions=decisions), grammar.SPAN.format(chunk)), "spans")


def citation_spans(answers: DataFrame, evidence: DataFrame, key: str = "answer_id") -> DataFrame:
    """Spans of an answer to show as links: ``key, start_offset, end_offset, citation, chunk_id, doc_type, url, current_url, excerpt``.

    A named statute links to the first evidence (by rank) on its article. An
    article without a name links if one evidence alone has it, and never inside
    a named one, so those spans do not overlap. A docket number links if one
    decision's citation holds it. ``evidence`` also has source_url. Nothing is
    shown without evidence or excerpt. Columns and keys as in ``citation_mentions``.
    An answer is resolved in one piece with all evidence of its key, which is
    shuffled once.
    """
    own = evidence.groupBy(key).agg(F.collect_list(F.struct("rank", "chunk_id", "doc_type", "citation", "text", "source_url")).alias("evidence"))
    return spans_within(answers.select(key, "text").join(own, key), key)
