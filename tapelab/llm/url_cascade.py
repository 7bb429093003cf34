"""URL filters by a cascade of Bloom filters: exact membership of URL keys in rule lists, without a join per URL.

Level 1 encodes the listed keys, level 2 those other keys of the corpus that level 1 lets through, level 3 the listed keys that level 2
lets through, and so on until a level lets nothing wrong through. For every key of the universe the first level that misses tells
exactly whether it is listed.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapelab.llm.common import stage, table

#: Fixed values of the registered query.
RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
DEFAULT = "allow"


@dataclass(frozen=True)
class Level:
    bits: int
    hashes: int
    seed: int
    words: list[int] = field(repr=False)

    def hit(self, key: Column) -> Column:
        """Whether every bit of the key is set."""
        words = F.from_json(F.lit(json.dumps(self.words)), "array<bigint>")
        return reduce(lambda a, b: a & b, (
            F.shiftright(F.get(words, F.shiftright(p, 6).cast("int")), 0).bitwiseAND(_mask(p)) != 0
            for p in positions(key, self.bits, self.hashes, self.seed)))


def positions(key: Column, bits: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * seed + j)), F.lit(bits)) for j in range(hashes)]


def _mask(p: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))


def bloom(keys: DataFrame, n: int, false_rate: float, seed: int) -> Level:
    """A filter over column ``key``. Its words come to the driver: their number depends on the listed keys, not on the corpus."""
    hashes = max(1, round(math.log2(1 / false_rate)))
    bits = max(64, math.ceil(hashes * n / math.log(2)))
    found = (keys.select(F.explode(F.array(*positions(F.col("key"), bits, hashes, seed))).alias("p"))
             .groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(_mask(F.col("p"))).alias("v")))
    words = [0] * (bits // 64 + 1)
    for row in found.collect():
        words[row["w"]] = row["v"]
    return Level(bits, hashes, seed, words)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for every key of the universe the cascade was built over."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in range(len(self.levels), 0, -1):
            answer = F.when(~self.levels[i - 1].hit(key), F.lit(i % 2 == 0)).otherwise(answer)
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame) -> Cascade:
    """Both have one column ``key``; ``universe`` holds every key that will ever be asked for, each once.

    Level 1 has a false-positive rate of about listed / universe, so that as many strangers pass as keys are listed; later levels
    halve what is left. The size of all levels is proportional to the list. An empty list gives a cascade without levels.
    """
    listed = stage(listed.where(F.col("key").isNotNull()).distinct(), "listed")
    n, total = listed.count(), universe.count()
    if n == 0:
        return Cascade(())
    rate = min(0.5, n / max(total, 1))
    levels = [bloom(listed, n, rate, 1)]
    # What is encoded now, and what must not pass it.
    encoded, other = listed, stage(universe.where(levels[0].hit(F.col("key"))).join(listed, "key", "left_anti"), "passed")
    while (left := other.count()) > 0:
        level = bloom(other, left, 0.5, len(levels) + 1)
        levels.append(level)
        encoded, other = other, stage(encoded.where(level.hit(F.col("key"))), "passed")
    return Cascade(tuple(levels))


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` to ``/``, ``?``, ``#`` or the end, ASCII capitals lowered. Path: from there to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def candidate_keys(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """The keys under which any rule could fit: last labels of the host joined to the first characters of the path.

    Only label counts and path lengths that occur in the rules are made; a path shorter than a rule's makes no key.
    """
    shapes = sorted({(h.count(".") + 1, len(p)) for _, h, p in rules})
    keys = [F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -labels), F.substring(path, 1, n)))
            for labels, n in shapes]
    return F.array_distinct(F.array_compact(F.array(*keys)))


def judge_urls(df: DataFrame, rules: list[tuple[str, str, str]] = RULES, url: str = "url", default: str = DEFAULT) -> DataFrame:
    """Adds host, path, rule and verdict to every row; the longest fitting rule wins, then the one with the longer host.

    ``rules``: (verdict, host, path prefix). Null or odd URLs have empty host and path and fit no rule; rows that fit none take
    ``default``. Columns of ``df`` with these four names are replaced; all rows stay, repeated ones too.
    """
    spark = df.sparkSession
    if not rules:
        host, path = host_and_path(F.col(url))
        return df.withColumns({"host": host, "path": path, "rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    host, path = host_and_path(F.col(url))
    keyed = df.select(F.explode(candidate_keys(host, path, rules)).alias("key"))
    universe = stage(keyed.distinct(), "url-keys")
    cascades = {v: build_cascade(spark.createDataFrame([(h + p,) for x, h, p in rules if x == v], "key string"), universe)
                for v in sorted({v for v, _, _ in rules})}
    def fitting(cascade: Cascade, verdict: str) -> Column:
        """Listed keys of a URL, as (length, length of the host, key, verdict)."""
        return F.transform(F.filter(candidate_keys(host, path, rules), cascade.contains), lambda k: F.struct(
            F.length(k).alias("n"), F.instr(F.concat(k, F.lit("/")), "/").alias("h"), k.alias("rule"), F.lit(verdict).alias("verdict")))

    fits = [fitting(c, v) for v, c in cascades.items()]
    best = F.array_max(F.concat(*fits))
    return (df.withColumn("__best", best).withColumns({"host": host, "path": path, "rule": F.col("__best")["rule"],
                                                       "verdict": F.coalesce(F.col("__best")["verdict"], F.lit(default))})
            .drop("__best"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut),
rules(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
                                ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS n
  FROM parts JOIN rules ON (host = h OR suffix(host, '.' || h)) AND starts_with(path, p))
SELECT parts.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM parts LEFT JOIN fit ON fit.page_id = parts.page_id AND n = 1
"""
