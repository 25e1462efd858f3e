"""URL filter: prefix rules, and an exact Bloom filter cascade for listed hosts (DataFrame functions only)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, ship

ship(__name__)

#: Rules of the contract: verdict, host, path. Fixed values.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]

#: Listed hosts: a url is blocked by the method if its host is one of these or below one. A parameter.
LISTED = ("ads-track.example.org", "cheap-pills.example.com", "free-bets.example.com", "spam-farm.example.org", "ads-track.example.net", "cheap-pills.example.net", "free-bets.example.net", "spam-farm.example.net")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; nulls if none fits."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1], r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        text, verdict = F.when(fits, F.lit(h + p)).otherwise(text), F.when(fits, F.lit(word)).otherwise(verdict)
    return text, verdict


@dataclass(frozen=True)
class Level:
    """One Bloom filter: ``bits`` bits packed in bytes, ``probes`` probes per key."""

    bits: int
    probes: int
    packed: bytes


def _bit(key: Column, level: int, probe: int | Column, bits: int) -> Column:
    probe = F.lit(probe) if isinstance(probe, int) else probe
    return F.pmod(F.xxhash64(key, F.lit(level), probe), F.lit(bits))


def holds(key: Column, filter_: Level, level: int) -> Column:
    """Whether a key passes a level's filter."""
    out = F.lit(True)
    for probe in range(filter_.probes):
        bit = _bit(key, level, probe, filter_.bits)
        byte = F.conv(F.hex(F.substring(F.lit(filter_.packed), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        out = out & (F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1)
    return out


def member(key: Column, cascade: list[Level]) -> Column:
    """Exact membership of a key of the universe: the parity of the first level that it does not pass."""
    out = F.lit(len(cascade) % 2 == 1)
    for level in reversed(range(len(cascade))):
        out = F.when(~holds(key, cascade[level], level), F.lit(level % 2 == 1)).otherwise(out)
    return out


def _build(keys: DataFrame, n: int, rate: float, level: int, max_bits: int) -> Level:
    bits = max(64, math.ceil(n * math.log2(math.e) * math.log2(1 / rate)))
    probes = max(1, round(math.log2(1 / rate)))
    if bits > max_bits:
        raise ValueError(f"level {level} of the cascade needs {bits} bits; max_bits is {max_bits}")
    marks = keys.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(probes - 1)), lambda j: _bit(F.col("key"), level, j, bits))).alias("bit"))
    chunk = 32768
    maps = marks.groupBy(F.floor(F.col("bit") / chunk).alias("chunk")).agg(F.expr(f"bitmap_construct_agg(bit % {chunk})").alias("map")).collect()
    packed = bytearray(-(-bits // chunk) * chunk // 8)
    for row in maps:
        packed[row["chunk"] * chunk // 8 : (row["chunk"] + 1) * chunk // 8] = row["map"]
    return Level(bits, probes, bytes(packed[: -(-bits // 8)]))


def build_cascade(universe: DataFrame, listed: Column, max_bits: int = 1 << 26) -> list[Level]:
    """The filters over ``universe`` (distinct ``key``), exact for each of its keys.

    Level 0 holds the listed keys; level 1 the other keys that pass level 0;
    level 2 the listed keys that pass level 1; until none passes. Only packed
    bits reach the driver; ``max_bits`` per level (8 MB) is checked first.
    Raises ValueError where a level would need more: raise ``max_bits`` then.
    """
    cur = settle(universe.select("key", F.coalesce(listed, F.lit(False)).alias("listed")), "keys")
    sizes = {r["listed"]: r["count"] for r in cur.groupBy("listed").count().collect()}
    inside, outside = sizes.get(True, 0), sizes.get(False, 0)
    levels: list[Level] = []
    n = inside
    while n:
        level = len(levels)
        side = level % 2 == 0
        rate = min(0.5, inside / (math.sqrt(2) * outside)) if level == 0 and outside else 0.5
        levels.append(_build(cur.where(F.col("listed") == side), n, max(rate, 1e-9), level, max_bits))
        passed = holds(F.col("key"), levels[level], level)
        # the next level holds what passes on the other side; this side stays whole
        cur = cur.where((F.col("listed") == side) | passed)
        n = cur.where(F.col("listed") != side).count()
    return levels


def host_keys(host: Column, most_labels: int) -> Column:
    """The host and its parent domains of up to ``most_labels`` labels."""
    labels = F.split(host, r"\.")
    size = F.size(labels)
    return F.transform(F.sequence(F.lit(1), F.least(size, F.lit(most_labels))), lambda n: F.array_join(F.slice(labels, size - n + 1, n), "."))


def judge_urls(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] | None = None, listed: tuple[str, ...] = LISTED, max_bits: int = 1 << 26) -> DataFrame:
    """``pages`` with host, path, rule and verdict added (columns of these names are replaced).

    A rule decides where one fits, the longest first. Elsewhere the cascade
    does: block if the host or one of its parent domains is listed, else
    allow. The cascade's universe is every host and parent domain of the table
    (of as many labels as listed keys have), so its answers are exact and rows
    are judged in one scan without a join. Null and odd urls have empty host
    and path and are allowed. Empty tables give empty results.
    """
    rules = RULES if rules is None else rules
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = split_url(F.col(url))
    named = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path"))
    rule, word = rule_for(F.col("host"), F.col("path"), rules)
    most = max((len(k.split(".")) for k in listed), default=0)
    if most:
        hosts = pages.select(host.alias("host")).distinct()
        universe = hosts.select(F.explode(host_keys(F.col("host"), most)).alias("key")).distinct()
        cascade = build_cascade(universe, F.col("key").isin(list(listed)), max_bits)
        blocked = F.exists(host_keys(F.col("host"), most), lambda k: member(k, cascade)) if cascade else F.lit(False)
    else:
        blocked = F.lit(False)
    own = F.when(blocked, "block").otherwise("allow")
    return named.select(*[F.col(f"`{c}`") for c in kept], "host", "path", rule.alias("rule"), F.coalesce(word, own).alias("verdict"))
