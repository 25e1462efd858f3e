"""Merkle manifest: rows ranked by a radix trie of digit histograms, hash trees of fixed fanout over the ranks, a proof for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, release, settle, ship

ship(__name__)

#: Nodes that have one parent; levels of a tree that one step makes; rows of a bucket that are ranked by sorting.
FANOUT, LEVELS, BUCKET = 8, 3, 4096
#: Hexadecimal digits by which a full bucket is split: 256 children at most.
DIGITS = 2
RUN = FANOUT**LEVELS
_PATH = "array<struct<left:string,right:string>>"


def framed(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def digest_of(*values: Column) -> Column:
    """The digest of a row: its framed values in order, in hexadecimal."""
    return F.sha2(F.concat(*[framed(v.cast("string")) for v in values]), 256)


def digits_of(number: Column) -> Column:
    """Hexadecimal digits that sort like a signed 64-bit number, null before all."""
    return F.coalesce(F.concat(F.lit("1"), F.lpad(F.hex(number.cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")), F.lit("0"))


def radix_ranks(rows: DataFrame, tree: str, digits: Column, bucket: int = BUCKET) -> DataFrame:
    """``rows`` with ``rank`` (long, from 0 by ``digits`` within ``tree``) and ``n`` (rows of the tree), without a global sort.

    Counts by digit split each tree's rows into buckets. One with more than
    ``bucket`` rows is split behind the digits that all its rows share, so runs
    of equal digits cost no round. A bucket starts where its parent does, plus
    what its smaller sisters hold. Rows are sorted inside of buckets only.
    ``digits`` is not null and not empty, and differs between rows of a tree;
    ``tree`` is not null. ``rows`` should be a settled table: it is read once a round.
    """
    counts = [F.count("*").alias("held"), F.min("_digits").alias("low"), F.max("_digits").alias("high")]
    shared = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("low"), F.length("high"))), lambda k: F.substring(F.col("low"), F.lit(1), k) == F.substring(F.col("high"), F.lit(1), k)))
    at = rows.withColumn("_digits", digits).withColumn("_bucket", F.lit(""))
    found = settle(at.groupBy(tree, "_bucket").agg(*counts).select("*", F.col("held").alias("n"), F.lit(0).cast("long").alias("start")), "histogram")
    levels, open_ = [found], (F.col("held") > bucket) & (F.col("low") < F.col("high"))
    while full := found.where(open_).count():
        split = found.where(open_).select(tree, "_bucket", (shared + DIGITS).alias("_depth"), "n", "start")
        if full <= BROADCAST_ROWS:
            split = F.broadcast(split)
        at = at.join(split.select(tree, "_bucket", "_depth"), [tree, "_bucket"], "left").withColumn("_child", F.expr("substring(_digits, 1, _depth)"))
        sisters = Window.partitionBy(tree, "_bucket").orderBy("_child").rowsBetween(Window.unboundedPreceding, -1)
        children = at.where("_depth is not null").groupBy(tree, "_bucket", "_child").agg(*counts).join(split, [tree, "_bucket"])
        start = F.col("start") + F.coalesce(F.sum("held").over(sisters), F.lit(0))
        found = settle(children.select(tree, F.col("_child").alias("_bucket"), "held", "low", "high", "n", start.alias("start")), "histogram")
        at = at.withColumn("_bucket", F.coalesce("_child", "_bucket")).drop("_depth", "_child")
        levels.append(found)
    starts = levels[0].where(~open_)
    for more in levels[1:]:
        starts = starts.union(more.where(~open_))
    inside = Window.partitionBy(tree, "_bucket").orderBy("_digits")
    ranked = at.join(starts.select(tree, "_bucket", "n", "start"), [tree, "_bucket"]).withColumn("rank", F.col("start") + F.row_number().over(inside) - 1)
    out = settle(ranked.select(*rows.columns, "rank", "n"), "ranks")
    release(*levels)
    return out


def _parents(nodes: Column) -> Column:
    """Digests of consecutive runs of a level's nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda k: F.sha2(F.array_join(F.slice(nodes, k * FANOUT + 1, F.lit(FANOUT)), ""), 256))


def ascend(nodes: DataFrame, carried: list[str]) -> list[DataFrame]:
    """Steps from ``nodes`` (tree, rank, n, hash) to one node a tree, as settled tables of runs of up to RUN nodes.

    The digits of a rank to the base of the fanout are the path in its tree: a
    step groups nodes by all but the last LEVELS digits and reduces each group
    level by level, longest prefix first. A tree with one node is left as it is.
    Columns: tree, rank and hash of the group's own node, n (groups of the
    tree), high (levels made), kids (structs of rank, hash and ``carried``), and
    the digests ``level0`` to ``level2`` below the node.
    """
    steps: list[DataFrame] = []
    while True:
        high = sum(((F.col("n") > FANOUT**k).cast("int") for k in range(LEVELS)), F.lit(0))
        kids = F.array_sort(F.collect_list(F.struct("rank", "hash", *(carried if not steps else []))))
        run = nodes.groupBy("tree", F.expr(f"rank div {RUN}").alias("up"), "n").agg(kids.alias("kids")).withColumn("high", high)
        run = run.withColumn("level0", F.col("kids.hash"))
        for k in range(LEVELS):
            run = run.withColumn(f"level{k + 1}", F.when(F.col("high") > k, _parents(F.col(f"level{k}"))).otherwise(F.col(f"level{k}")))
        below = [f"level{k}" for k in range(LEVELS)]
        step = settle(run.select("tree", F.col("up").alias("rank"), F.expr(f"(n + {RUN - 1}) div {RUN}").alias("n"), "high", "kids", *below, F.expr(f"level{LEVELS}[0]").alias("hash")), "trie")
        steps.append(step)
        if (step.agg(F.max("n")).first()[0] or 1) <= 1:
            return steps
        nodes = step.select("tree", "rank", "n", "hash")


def _path(kid: Column) -> Column:
    """Siblings left and right of a kid, level by level within its group, then those of the group's node."""
    at = kid["rank"] % RUN
    parts = []
    for k in range(LEVELS):
        place = F.floor(at / FANOUT**k).cast("int")
        first = F.floor(place / FANOUT).cast("int") * FANOUT
        nodes, own = F.col(f"level{k}"), place - first
        sides = F.struct(F.array_join(F.slice(nodes, first + 1, own), "").alias("left"), F.array_join(F.slice(nodes, place + 2, F.lit(FANOUT - 1) - own), "").alias("right"))
        parts.append(F.when(F.col("high") > k, F.array(sides)).otherwise(F.array().cast(_PATH)))
    return F.concat(*parts, F.col("path"))


def descend(steps: list[DataFrame], tops: DataFrame, facts: list[str]) -> DataFrame:
    """The first step's groups with ``path`` (array of siblings left and right) of each group's node, and ``facts`` of its tree.

    ``tops`` has tree, path and facts of each tree's last node.
    """
    above = tops.withColumn("rank", F.lit(0).cast("long"))
    for step in reversed(steps[1:]):
        kids = F.inline(F.transform("kids", lambda kid: F.struct(kid["rank"].alias("rank"), _path(kid).alias("path"))))
        above = step.join(above, ["tree", "rank"]).select("tree", *facts, kids)
    return steps[0].join(above, ["tree", "rank"])


def manifest(docs: DataFrame) -> DataFrame:
    """One row a document: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Leaves of a language ascend by doc_id, null first, then by leaf; equal rows
    take places of their own. Null languages are one language, before all
    others. Null values of a row are framed as ``-``; a row without an id is not
    tampered with, nor is a null text. A lone leaf is its language's subroot, a
    lone subroot the root; a row without any sibling has the digest of the empty
    string as proof. An empty table gives no rows; other columns are ignored.
    No more than BUCKET rows are sorted, and no more than RUN nodes are held,
    in one group, whatever share of the rows a language or an id has.
    """
    own = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    touched = F.when(tampered & F.col("text").isNotNull(), digest_of(*own[:4], F.translate("text", capitals, capitals.lower())))
    leaves = settle(
        docs.select("doc_id", F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), digest_of(*own).alias("hash"), touched.alias("touched"), F.monotonically_increasing_id().alias("tie")),
        "leaves",
    )
    ranked = radix_ranks(leaves, "tree", F.concat(digits_of(F.col("doc_id")), "hash", digits_of(F.col("tie"))))
    release(leaves)
    steps = ascend(ranked, ["doc_id", "touched"])
    release(ranked)

    subroots = steps[-1].select(F.lit("").alias("tree"), F.col("tree").alias("name"), "hash")
    named = radix_ranks(subroots, "tree", F.concat(F.lit("1"), F.hex("name")))
    over = ascend(named, ["name"])
    release(named)
    tops = over[-1].select("tree", F.array().cast(_PATH).alias("path"), F.col("hash").alias("root"))
    langs = descend(over, tops, ["root"]).select("root", F.inline(F.transform("kids", lambda kid: F.struct(kid["name"].alias("tree"), kid["hash"].alias("subroot"), _path(kid).alias("path")))))

    groups = descend(steps, langs, ["subroot", "root"])
    nodes = F.transform("kids", lambda kid: F.struct(kid["doc_id"].alias("doc_id"), kid["hash"].alias("leaf"), kid["touched"].alias("touched"), _path(kid).alias("path")))

    def proven(row: Column) -> Column:
        siblings = F.array_join(F.transform(row["path"], lambda p: F.concat(p["left"], p["right"])), "")
        folded = F.aggregate(row["path"], F.coalesce(row["touched"], row["leaf"]), lambda low, p: F.sha2(F.concat(p["left"], low, p["right"]), 256))
        return F.struct(row["doc_id"].alias("doc_id"), row["leaf"].alias("leaf"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))

    rows = groups.select("subroot", "root", F.inline(F.transform(nodes, proven)))
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
