"""Queries: documents exported as verified releases, activated and promoted, and JSON lines with repeated keys."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.shared import shared_folder
from ..session import table as t
from ..sources import releases, strict_json
from .registry import query

ROW = "doc_id long, lang string, source string, n_chars long, text string"
_SHOWN = "select doc_id, lang, source, n_chars, md5(text) as h from documents"


def _export(spark, docs, folder, version):
    """Documents by language in two streams, in the order of their ids."""
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    rows = docs.select("doc_id", "lang", "source", "n_chars", "text")
    path = f"{folder}/release-{version}-{uuid.uuid4().hex}"
    releases.export_release({"english": (rows.where(english), ["doc_id"]), "other": (rows.where(~english), ["doc_id"])}, path, "base", version)
    return path


def _read(spark, path):
    streams = releases.read_release(spark, path, {"english": ROW, "other": ROW}, "base")
    return streams["english"].union(streams["other"]).select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("h"))


@query("src13_snk06_verified_release", _SHOWN)
def _(spark, sf):
    """All documents written as a release and read again after its files and rows were checked."""
    return _read(spark, _export(spark, t(spark, sf, "documents"), shared_folder(spark), "v1"))


@query("mrg12_active_release", f"{_SHOWN} where n_chars is not null")
def _(spark, sf):
    """Two releases made active one after the other; the pointer leads to the second, without rows that have no length."""
    folder, docs = shared_folder(spark), t(spark, sf, "documents")
    pointer = f"{folder}/active-{uuid.uuid4().hex}.json"
    for version, rows in (("v1", docs), ("v2", docs.where("n_chars is not null"))):
        releases.activate(spark, _export(spark, rows, folder, version), pointer)
    return _read(spark, releases.active_release(spark, pointer))


@query("mrg13_promoted_release", _SHOWN)
def _(spark, sf):
    """An old release replaced by a new one in the same place; a later one that fails its check leaves the new one there."""
    folder, docs = f"{shared_folder(spark)}/promotion-{uuid.uuid4().hex}", t(spark, sf, "documents")

    def staged(rows, name):
        path = _export(spark, rows, f"{folder}/{name}", name)
        releases.Files(spark, path).move(path, f"{folder}/{name}/release")
        return f"{folder}/{name}"

    def check(target):
        if releases.verify_release(spark, f"{target}/release")["version"] == "v3":
            raise ValueError("refused")

    for name, rows in (("v1", docs.where("n_chars > 0")), ("v2", docs), ("v3", docs.where("n_chars > 0"))):
        try:
            releases.promote(spark, staged(rows, name), f"{folder}/live", ["release"], f"{folder}/run-{name}", check)
        except ValueError:
            if name != "v3":
                raise
    return _read(spark, f"{folder}/live/release")


@query(
    "src11_strict_json",
    """select doc_id, case doc_id % 6 when 0 then 'repeated key: source' when 1 then 'repeated key: a' when 2 then 'not an object' when 3 then 'blank line' end as fault from documents where doc_id % 6 < 4""",
)
def _(spark, sf):
    """A JSON line of each document, whole text included; keys repeated on top and inside, no objects and blank lines are refused."""
    body = F.to_json(F.struct("source", "text"))
    nested = F.concat(F.lit('{"x":['), body, F.lit(',{"b":{"a":1,"c":{"a":2},"a":3}}]}'))
    line = (
        F.when(F.col("doc_id") % 6 == 0, F.concat(F.lit('{"source":"first",'), F.substring(body, F.lit(2), F.length(body))))
        .when(F.col("doc_id") % 6 == 1, nested)
        .when(F.col("doc_id") % 6 == 2, F.concat(F.lit("["), body, F.lit("]")))
        .when(F.col("doc_id") % 6 == 3, F.lit("  "))
        .otherwise(body)
    )
    return strict_json.line_faults(t(spark, sf, "documents").where("source is not null").select("doc_id", line.alias("value"))).select("doc_id", "fault")
