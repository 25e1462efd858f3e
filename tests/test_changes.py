"""Change plans: exact messages for bad ones, whole results for good ones, closure deletion with integrity."""

import pytest

from sparkloom.operators import changes

HEADER = {"schema": "change-plan-v1", "parent_snapshot": "p1", "corpus": "base", "version": "v2", "observed_at": "2026-01-02T03:04:05+09:00"}


def test_headers():
    assert changes.check_header(HEADER, {"corpus": "base", "version": "v1"}) == HEADER
    bad = [
        ({"extra": 1}, "wrong keys"),
        ({"schema": "other"}, "wrong keys or schema"),
        ({"corpus": "a b"}, "corpus: use 1 to 64"),
        ({"version": "x" * 65}, "version: use 1 to 64"),
        ({"observed_at": "2026-01-02T03:04:05"}, "time zone"),
    ]
    for change, message in bad:
        with pytest.raises(ValueError, match=message):
            changes.check_header(HEADER | change)
    for parent in ({"corpus": "other", "version": "v1"}, {"corpus": "base", "version": "v2"}):
        with pytest.raises(ValueError, match="new version of its parent's corpus"):
            changes.check_header(HEADER, parent)


def streams(spark):
    rows = [
        ("laws", 0, "c1", "d1", "law", "one", {"title": "A", "note": "n"}, {"topic": "t"}),
        ("laws", 1, "c2", "d1", "law", "two", {"title": "A"}, {}),
        ("laws", 2, "c3", "d2", "law", "three", {"title": "B"}, {}),
        ("cases", 0, "k1", "d3", "case", "case", {}, {}),
        ("laws", 3, "m1", "d4", "law", "both", {}, {}),
        ("cases", 1, "m2", "d4", "law", "both", {}, {}),
    ]
    return spark.createDataFrame(rows, changes.STREAM)


def replace(doc="d1", kind="law", ids=("n1",), **more):
    return {"operation": "replace", "document_id": doc, "doc_type": kind, "chunks": [(i, f"new {i}", {"title": "A"}) for i in ids]} | more


def delete(doc, kind="law", **more):
    return {"operation": "delete", "document_id": doc, "doc_type": kind} | more


GIVEN = {"metadata": {"n1": {"note": "again"}}, "fields": {"n1": {"topic": "u"}}}


@pytest.mark.parametrize(
    "plan, message",
    [
        ([delete("")], ": a change needs a document id"),
        ([delete("d1") | {"operation": "move"}], "d1: the operation is neither replace nor delete"),
        ([delete("d1", "novel")], "d1: the kind of document is not known"),
        ([delete("d1"), delete("d1")], "d1: the document is changed twice"),
        ([delete("d1", metadata={})], "d1: a delete carries no records, metadata or fields"),
        ([replace(ids=())], "d1: a replacement needs all records of the document"),
        ([delete("d1", "case")], "d1: the snapshot has the document as another kind"),
        ([delete("d9")], "d9: the document to delete is not in the parent snapshot"),
        ([replace(metadata={"zz": {"a": "b"}})], "d1: metadata is given for a chunk that the document does not have"),
        ([replace(fields={"zz": {"a": "b"}})], "d1: fields are given for a chunk that the document does not have"),
        ([replace("d4")], "d4: the document's stream is not clear"),
        ([replace(**GIVEN | {"metadata": {"n1": {"note": "x", "title": "Z"}}})], "d1: metadata made from the source can't be overwritten in n1"),
        ([replace()], "d1: give new values of metadata for n1: note"),
        ([replace(metadata=GIVEN["metadata"])], "d1: give new values of fields for n1: topic"),
        ([replace(metadata=GIVEN["metadata"], fields={"n1": {"topic": "u", "text": "x"}})], "d1: fields have names of their own in n1"),
        ([replace(ids=("n1", "n2"), **GIVEN)], "d1: give new values of metadata for n2: note"),
    ],
)
def test_bad_plans(spark, plan, message):
    with pytest.raises(ValueError) as got:
        changes.apply_to_streams(streams(spark), changes.snapshot_changes(spark, plan), ["laws", "cases"])
    assert str(got.value) == message


def test_replace_delete_and_add(spark):
    plan = [replace(**GIVEN), delete("d3", "case"), replace("new", "case", ("x2", "x1"))]
    got = changes.apply_to_streams(streams(spark), changes.snapshot_changes(spark, plan), ["laws", "cases"]).collect()
    assert sorted((r.stream, r.position, r.chunk_id, r.doc_id, r.text) for r in got) == [
        ("cases", 0, "m2", "d4", "both"),
        ("cases", 1, "x2", "new", "new x2"),
        ("cases", 2, "x1", "new", "new x1"),
        ("laws", 0, "c3", "d2", "three"),
        ("laws", 1, "m1", "d4", "both"),
        ("laws", 2, "n1", "d1", "new n1"),
    ]
    new = next(r for r in got if r.chunk_id == "n1")
    assert new.metadata == {"title": "A", "note": "again"} and new.fields == {"topic": "u"}


def test_one_stream_takes_every_new_document(spark):
    one = streams(spark).where("stream = 'laws' and doc_id <> 'd4'")
    got = changes.apply_to_streams(one, changes.snapshot_changes(spark, [replace("case-doc", "case")]), ["laws"])
    assert {(r.stream, r.doc_id) for r in got.where("doc_type = 'case'").collect()} == {("laws", "case-doc")}


def test_closure_goes_with_its_root_and_dangling_rows_are_refused(spark):
    names = lambda *ids: spark.createDataFrame([(i,) for i in ids], "node string")
    links = lambda *pairs: spark.createDataFrame(list(pairs), "parent string, child string")
    nodes, edges = names("a", "b", "c", "d", "e"), links(("a", "b"), ("b", "c"), ("c", "a"), ("d", "e"), (None, "d"))
    assert {r.node for r in changes.closure(edges, names("a", None)).collect()} == {"a", "b", "c"}
    left, own = changes.replace_closure(nodes, edges.where("parent is not null"), names("a"), names("a", "x"), links(("a", "x")))
    assert sorted(r.node for r in left.collect()) == ["a", "d", "e", "x"] and sorted(tuple(r) for r in own.collect()) == [("a", "x"), ("d", "e")]
    with pytest.raises(ValueError, match="d: the row is there already"):
        changes.replace_closure(nodes, edges, names("a"), names("d"), links(("a", "x")).limit(0))
    with pytest.raises(ValueError, match="y: a row refers to it, but it is gone"):
        changes.replace_closure(nodes, edges.where("parent is not null"), names("a"), names("x"), links(("y", "x")))


def tables(spark, lines=(10, 10, 11, 20, 30), orders=((10, 1), (11, 1), (20, 2), (30, 3)), customers=(1, 2, 3)):
    make = lambda rows, ddl: spark.createDataFrame([r if isinstance(r, tuple) else (r,) for r in rows], ddl)
    return {"customer": make(customers, "c long"), "order": make(orders, "o long, o_c long"), "line": make(lines, "l_o long")}


KEYS, REFERS = {"customer": "c", "order": "o"}, {"order": {"o_c": "customer"}, "line": {"l_o": "order"}}


def test_tables_go_with_their_roots_and_dangling_rows_are_refused(spark):
    roots = {"customer": spark.createDataFrame([(1,), (1,), (3,), (9,)], "c long")}
    new = {"customer": spark.createDataFrame([(3,), (7,)], "c long"), "order": spark.createDataFrame([(70, 7), (11, 3)], "o long, o_c long")}
    rows = lambda left: {k: sorted(map(tuple, df.collect())) for k, df in left.items()}
    assert rows(changes.replace_tables(tables(spark), KEYS, REFERS, roots, {})) == {"customer": [(2,)], "order": [(20, 2)], "line": [(20,)]}
    assert rows(changes.replace_tables(tables(spark), KEYS, REFERS, roots, new)) == {"customer": [(2,), (3,), (7,)], "order": [(11, 3), (20, 2), (70, 7)], "line": [(20,)]}
    assert rows(changes.replace_tables(tables(spark, orders=((10, 1), (10, 2), (11, 2), (20, 2), (30, 3))), KEYS, REFERS, roots, {}))["line"] == [(11,), (20,)]
    with pytest.raises(ValueError, match="customer 2: the row is there already"):
        changes.replace_tables(tables(spark), KEYS, REFERS, roots, {"customer": spark.createDataFrame([(2,)], "c long")})
    for bad, message in (({"lines": (10, 99)}, "order 99: a row of line refers to it"), ({"orders": ((10, 1), (20, 5))}, "customer 5: a row of order refers to it"), ({"lines": (None,)}, "order null: a row of line")):
        with pytest.raises(Exception, match=message):
            changes.replace_tables(tables(spark, **bad), KEYS, REFERS, roots, {})["line"].collect()
    with pytest.raises(Exception, match="customer 1: a row of order refers to it, but it is gone"):
        changes.replace_tables(tables(spark), KEYS, REFERS, roots, {"order": spark.createDataFrame([(71, 1)], "o long, o_c long")})["order"].collect()


def test_closure_replacement_writes_no_row_of_lines(spark, monkeypatch):
    import __spark_entry__ as entry
    from sparkloom.operators import shared

    written, settle = [], shared.settle
    monkeypatch.setattr(changes, "settle", lambda df, *a: written.append(df.columns) or settle(df, *a))
    monkeypatch.setattr("sparkloom.plans.changing.settle", changes.settle, raising=False)
    entry.queries()["mrg07_closure_replacement"](spark, "/root/testdata/sf0.001").collect()
    assert written and not any("node" in columns or "l_orderkey" in columns for columns in written)
