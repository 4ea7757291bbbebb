"""URL filters by a Bloom filter cascade: exact membership without joins.

Level 1 encodes the listed keys; level 2 the keys of the corpus's whole key universe that
level 1 takes for listed; level 3 the listed keys that level 2 takes for such errors; and
so on until a level errs on nothing. A key of the universe is listed exactly if the
first level that rejects it is an even one. Filters are binary literals in the plan, so a
URL is judged by column expressions alone.

A rule is a host and a path prefix. A URL's candidate keys are each suffix of its host
joined with the path's prefixes of the lengths that rules have; the longest listed
candidate decides. Hosts listed on their own give the verdict where no rule fits.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no
rule and is allowed. Rows may repeat; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomic.llm._spark import durable

RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: Hosts that are blocked, with their subdomains, where no rule fits.
HOSTS = ("ads-track.example.com", "casino-win.example.com", "cheap-pills.example.com", "free-bets.example.com")
#: The most bytes that the literals of one level, and of all levels together, may have in the plan; larger lists are refused before any is sent.
MAX_LEVEL_BYTES = 32 << 20


@dataclass(frozen=True)
class Level:
    bits: bytes
    size: int
    hashes: int
    salt: int


def _places(key: Column, size: int, hashes: int, salt: int) -> list[Column]:
    """Bit numbers by double hashing; the salt makes levels independent."""
    a, b = F.xxhash64(key, F.lit(2 * salt)), F.xxhash64(key, F.lit(2 * salt + 1))
    return [F.pmod(F.shiftright(a, 2) + F.lit(i) * F.shiftright(b, 8), F.lit(size).cast("long")) for i in range(hashes)]


def holds(key: Column, level: Level) -> Column:
    """Whether every bit of the key is set in the level's literal."""
    bits = F.lit(bytearray(level.bits))
    found = F.lit(True)
    for place in _places(key, level.size, level.hashes, level.salt):
        byte = F.conv(F.hex(F.substring(bits, F.shiftright(place, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        found = found & (F.call_function("shiftright", byte, F.pmod(place, F.lit(8)).cast("int")).bitwiseAND(F.lit(1)) == 1)
    return found


def build_level(keys: DataFrame, count: int, rate: float, salt: int) -> Level:
    """A Bloom filter of column ``key``: bits are grouped by word on the executors; the driver gets the words."""
    size = max(64, 8 * math.ceil(-count * math.log(rate) / math.log(2) ** 2 / 8))
    if size // 8 > MAX_LEVEL_BYTES:
        raise ValueError(f"a level of {size // 8} bytes is over the bound of {MAX_LEVEL_BYTES}; split the list by key hash and build a cascade for each part")
    hashes = max(1, math.ceil(-math.log2(rate)))
    words = (
        keys.select(F.explode(F.array(*_places(F.col("key"), size, hashes, salt))).alias("p"))
        .groupBy(F.shiftright("p", 5).alias("word"))
        .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("p", F.lit(32)).cast("int"))).alias("bits"))
    )
    raw = bytearray(4 * math.ceil(size / 32))
    # a job a partition: few of them, as all words together are within the bound
    for word, bits in words.coalesce(8).toLocalIterator():
        raw[4 * word : 4 * word + 4] = int(bits).to_bytes(4, "little")
    return Level(bytes(raw), size, hashes, salt)


def build(listed: DataFrame, universe: DataFrame, rate: float = 0.01) -> list[Level]:
    """The cascade's levels for ``listed`` keys over the keys of ``universe`` (column ``key`` each).

    Each level's errors are written once: the next level is built from them and the one
    after that is tested on them.
    """
    yes = durable(listed.select("key").distinct())
    no = universe.select("key").join(yes, "key", "left_anti")
    levels: list[Level] = []
    inside, outside = yes, no
    while True:
        count = inside.count()
        if count == 0:
            return levels
        levels.append(build_level(inside, count, rate if not levels else 0.5, len(levels)))
        if (held := sum(len(x.bits) for x in levels)) > MAX_LEVEL_BYTES:
            raise ValueError(f"a cascade of {held} bytes is over the bound of {MAX_LEVEL_BYTES}; split the list by key hash and build a cascade for each part")
        # what this level errs on is what the next one has to encode
        inside, outside = durable(outside.filter(holds(F.col("key"), levels[-1])).distinct()), inside
        if len(levels) > 60:
            raise RuntimeError("the cascade does not end")


def member(key: Column, levels: list[Level]) -> Column:
    """Exact for keys of the universe: by the number of the first level that rejects the key."""
    out = F.lit(len(levels) % 2 == 1)
    for i in reversed(range(len(levels))):
        out = F.when(~holds(key, levels[i]), F.lit(i % 2 == 1)).otherwise(out)
    return out


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path by the contract's rule."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def _candidates(host: Column, path: Column, lengths: list[int]) -> Column:
    """All keys of a URL: host suffixes by path prefixes of the given lengths."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.array_size(labels)), lambda i: F.array_join(F.slice(labels, i, F.array_size(labels)), "."))
    suffixes = F.when(host != "", suffixes).otherwise(F.array().cast("array<string>"))

    def at(n: int) -> Column:
        return F.transform(suffixes, lambda s: F.when(F.length(path) >= n, F.concat(s, F.substring(path, 1, n))))

    keys = F.flatten(F.array(*[at(n) for n in lengths]))
    return F.filter(F.array_distinct(keys), lambda k: k.isNotNull())


def judge(df: DataFrame, rules: tuple = RULES, hosts: tuple = HOSTS, id_col: str = "page_id", url_col: str = "url", rate: float = 0.01) -> DataFrame:
    """Columns page_id, host, path, rule and verdict of every row.

    The longest fitting rule wins, equal lengths by the greater text.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_path(F.col("url"))
    rows = rows.select("page_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    # one cascade holds every list; a key begins with the list that it is asked of
    listed = spark.createDataFrame([(v[0] + h + p,) for v, h, p in rules] + [("h" + h,) for h in hosts], "key string")
    fitting = _candidates(F.col("host"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")
    alone = _candidates(F.col("host"), F.lit(""), [0])
    asked = F.flatten(F.array(F.transform(fitting, lambda k: F.concat(F.lit("b"), k)), F.transform(fitting, lambda k: F.concat(F.lit("a"), k)), F.transform(alone, lambda k: F.concat(F.lit("h"), k))))
    places = rows.select("host", F.substring("path", 1, max([0, *lengths])).alias("path")).distinct()
    levels = build(listed, places.select(F.explode(asked).alias("key")), rate)

    def on(name: str, key: Column) -> Column:
        return member(F.concat(F.lit(name), key), levels)

    graded = F.transform(fitting, lambda k: F.struct(F.length(k).alias("n"), k.alias("rule"), F.when(on("b", k), "block").when(on("a", k), "allow").alias("verdict")))
    best = F.array_max(F.filter(graded, lambda g: g["verdict"].isNotNull()))
    own = F.exists(alone, lambda k: on("h", k))
    return rows.withColumn("best", best).select(
        "page_id",
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(own, "block").otherwise("allow")).alias("verdict"),
    )
