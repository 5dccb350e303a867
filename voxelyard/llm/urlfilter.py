"""Exact URL verdicts from prefix rules and a Bloom filter cascade, in DataFrame functions only.

A cascade alternates: level 1 holds the listed keys; level 2 the keys of the universe outside the list that level 1 lets through by
mistake; level 3 the listed keys that level 2 lets through; and so on until a level makes no mistake. For any key of the
universe the first level that rejects it tells its membership exactly, without a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelyard.llm._shared import write_table

#: Fixed rules of the URL filter: (verdict, host, path). A rule fits its host and all subdomains.
RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]
#: Fixed list: host labels of listed sites.
LISTED_LABELS = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
#: The levels of a cascade are literals in the plan; together they may have about so many bits (4 MB). More listed keys are cut by hash into several cascades.
MAX_BITS = 1 << 25
#: False positives of the first level and of the later ones.
FIRST_RATE, LATER_RATE = 0.02, 0.2


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; null or no ``://``: empty."""
    host = F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct ``(rule, verdict)`` of the longest rule that fits, null if none does. Rules of equal length: the first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), [-ord(c) for c in r[1] + r[2]])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


@dataclass(frozen=True)
class Level:
    """Words of 64 bits, the number of bits and of hash functions; the seed differs by level."""

    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        one = F.xxhash64(F.lit(self.seed), key)
        two = F.xxhash64(F.lit(self.seed), key, F.lit(1)).bitwiseOR(F.lit(1))
        return [F.pmod(one + F.lit(i) * (two % F.lit(1 << 31)), F.lit(self.bits)) for i in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        """Whether the level may hold key: all its bits are set."""
        table = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")
        seen = F.lit(True)
        for p in self.positions(key):
            word = F.element_at(table, (F.shiftright(p, 6) + 1).cast("int"))
            seen = seen & (F.call_function("getbit", word, p.bitwiseAND(F.lit(63)).cast("int")) == 1)
        return seen


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def member(self, key: Column) -> Column:
        """Exact for every non-null key of the universe that the cascade was built over; false for null."""
        out = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[i].holds(key), out).otherwise(F.lit(i % 2 == 1))
        return F.coalesce(key.isNotNull() & out, F.lit(False))


def _level(keys: DataFrame, count: int, rate: float, seed: int) -> Level:
    hashes = max(1, round(-math.log2(rate)))
    bits = 64 * math.ceil(max(64, count * -math.log(rate) / math.log(2) ** 2) / 64)
    empty = Level((), bits, hashes, seed)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    mask = F.expr("shiftleft(1L, cast(p & 63 as int))")
    words = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(mask).alias("m")).collect()
    held = [0] * (bits // 64)
    for r in words:
        held[r.w] = r.m
    return Level(tuple(held), bits, hashes, seed)


def cascade_bits(count: int, first_rate: float = FIRST_RATE) -> float:
    """Bits that the levels of a cascade over ``count`` listed keys take: the first, and what later levels add at most in the mean."""
    per_key = -math.log(first_rate) / math.log(2) ** 2
    later = -math.log(LATER_RATE) / math.log(2) ** 2
    return count * (per_key + 2 * later)


def build_cascade(universe: DataFrame, first_rate: float = FIRST_RATE) -> Cascade:
    """Cascade for ``universe (key, listed boolean)``, distinct keys.

    What comes to the driver are the words of a level, in proportion to the listed keys: ``judge_urls`` sees to it that they are few enough.
    """
    levels: list[Level] = []
    inside, outside = universe.where("listed").select("key"), universe.where("not listed").select("key")
    count = inside.count()
    while count or not levels:
        level = _level(inside, count, LATER_RATE if levels else first_rate, len(levels) + 1)
        levels.append(level)
        wrong = write_table(outside.where(level.holds(F.col("key"))), f"cascade{len(levels)}")
        inside, outside = wrong, inside
        count = inside.count()
        if len(levels) > 64:
            raise RuntimeError("the cascade does not end: the universe holds a key as listed and as not listed")
    return Cascade(tuple(levels))


def judge_urls(
    pages: DataFrame,
    listed: Column | DataFrame,
    rules: list[tuple[str, str, str]] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, listed)`` per row; ``listed`` is a boolean Column over ``key``, a host, or a table of hosts ``(key)``.

    The longest rule that fits decides; else a host that the list has is blocked and any other is allowed. The universe is
    every distinct host of the table, so membership is exact. Null or empty urls have an empty host, which is a key like any
    other; repeated rows are judged alike; other columns are ignored; an empty table gives an empty result. A list too large for one cascade of ``max_bits`` is cut by
    key hash into as many cascades as it takes, and the table is read once for each: no row is joined or shuffled at any size.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    universe = rows.select(F.col("host").alias("key")).distinct()
    if isinstance(listed, DataFrame):
        universe = universe.join(listed.select("key", F.lit(True).alias("listed")).where("key is not null").distinct(), "key", "left")
        listed = F.col("listed")
    universe = write_table(universe.withColumn("listed", F.coalesce(listed, F.lit(False))), "hosts")
    n = max(1, math.ceil(cascade_bits(universe.where("listed").count()) / max_bits))
    told = None
    for k in range(n):
        own = lambda key: F.pmod(F.xxhash64(F.lit("cascade"), key), F.lit(n)) == k if n > 1 else F.lit(True)  # noqa: B023, E731
        cascade = build_cascade(universe.where(own(F.col("key"))))
        part = rows.where(own(F.col("host"))).withColumn("listed", cascade.member(F.col("host")))
        told = part if told is None else told.union(part)
    ruled = told.withColumn("r", longest_rule(F.col("host"), F.col("path"), rules))
    method = F.when(F.col("listed"), "block").otherwise("allow")
    return ruled.select(
        "page_id", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", method).alias("verdict"), "listed"
    )


def listed_host(labels: list[str] = LISTED_LABELS) -> Column:
    """Whether a host has one of the labels."""
    return F.arrays_overlap(F.split("key", r"\."), F.array(*[F.lit(x) for x in labels]))
