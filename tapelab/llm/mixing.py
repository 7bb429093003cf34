"""Mixing sources to target weights: Sainte-Lague quotas of equal blocks per source and shard, then seeded block selection.

Every source is cut into shards; inside a shard its documents lie in an order drawn by the seed and form one stream of words, cut into
blocks of equal length. A source has as many shards as its own rows call for, so that a cell holds many blocks. Blocks are never
written out: the blocks taken are whole rounds through the stream plus one run of blocks from a seeded start, so what a document gives
is arithmetic on its place in the stream, and nearly every document is taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tapelab.llm.common import WORD, stage, table

#: Fixed values of the registered query.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
REPEATS = 2.0
SEED = "mix-1"
BLOCK_WORDS = 16
ROWS_PER_SHARD = 4_000
#: Quotas of a source go to so many groups of shards first, then to the shards of a group, so no list of shards is ever ranked whole.
SHARD_GROUPS = 1_024


def n_words(text: Column) -> Column:
    """Words of a text; null has none. Counted where a word ends, so that no list of words is built."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def number_of(text: Column) -> Column:
    """An integer below 2**32 from a string, the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Sources as a join key in which null is a source of its own."""
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS) -> DataFrame:
    """Adds weight and target to (source, source_size): share * all sizes dealt by weight, none above repeats * its size.

    A source is at its limit exactly if limit / weight is at most the common rate, so sources are scanned once in that order: a source
    is full if the rate that remains after the fuller ones covers it. Weights repeat over the sources by code point, null last. With
    share > repeats every source is at its limit. Scans hold one row per source.
    """
    one = W.orderBy(F.col("source").asc_nulls_last())
    weighed = sizes.withColumn("rank", F.row_number().over(one)).withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(F.col("rank") - 1, F.lit(len(weights))).cast("int") + 1))
    limit = F.lit(float(repeats)) * F.col("source_size")
    by_rate = W.orderBy("rate", "rank")
    before, everyone = by_rate.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    level = (weighed.withColumns({"limit": limit, "rate": limit / F.col("weight")})
             .withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
                         / (F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
             .withColumn("open", F.col("limit") > F.col("level") * F.col("weight")))
    common = F.min(F.when(F.col("open"), F.struct("rate", "rank", "level"))).over(everyone)["level"]
    return (level.withColumn("common", common)
            .withColumn("target", F.when(F.col("limit") > F.col("common") * F.col("weight"), F.col("common") * F.col("weight")).otherwise(F.col("limit")))
            .drop("limit", "rate", "level", "open", "common"))


def apportion(df: DataFrame, value: str, seats: Column, name: str, within: list[str], ties: list[str]) -> DataFrame:
    """Sainte-Lague: ``seats`` (constant within a group) go to the highest quotients value / (2j + 1); equal quotients by ``ties``.

    The divisor that deals all seats moves a row's exact share by at most share-of-value * rows / 2 and rounding by 1/2, so seats below
    that are granted at once and only the few quotients around it are ranked: work is in proportion to the rows, not to the seats.
    A group whose values are all 0 gets no seat.
    """
    group = W.partitionBy(*within) if within else W.partitionBy()
    shared = df.withColumns({"__total": F.sum(value).over(group), "__rows": F.count(F.lit(1)).over(group), "__seats": seats})
    part = F.when(F.col("__total") > 0, F.col(value) / F.col("__total")).otherwise(F.lit(0.0))
    near = shared.withColumns({"__exact": part * F.col("__seats"), "__slack": part * F.col("__rows") / 2 + 1.5})
    near = near.withColumn("__sure", F.greatest(F.lit(0), F.floor(F.col("__exact") - F.col("__slack"))).cast("long"))
    tried = near.where(F.col(value) > 0).withColumn("__j", F.explode(F.sequence(F.col("__sure"), F.ceil(F.col("__exact") + F.col("__slack")).cast("long"))))
    ranked = (tried.withColumn("__q", F.col(value) / (2 * F.col("__j") + 1))
              .withColumn("__place", F.row_number().over(group.orderBy(F.col("__q").desc(), *ties, "__j")))
              .withColumn("__left", F.col("__seats") - F.sum(F.when(F.col("__j") == F.col("__sure"), F.col("__sure"))).over(group)))
    keys = list(dict.fromkeys([*within, *ties]))
    won = (ranked.groupBy(*keys).agg((F.first("__sure") + F.sum((F.col("__place") <= F.col("__left")).cast("long"))).alias(name)))
    return df.join(won, keys, "left").withColumn(name, F.coalesce(F.col(name), F.lit(0)).cast("long"))


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
        share: float = SHARE, repeats: float = REPEATS, seed: str = SEED, block_words: int = BLOCK_WORDS,
        rows_per_shard: int = ROWS_PER_SHARD, shard_groups: int = SHARD_GROUPS, payload: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``df``: id, size, source_size, target, taken, and ``rounds``, ``spans`` that say which words are taken:
    all words ``rounds`` times, and once more those in ``spans`` (two [from, to) ranges, empty ones included).

    ``payload`` columns are carried along as struct ``payload``. Null and empty texts have size 0 and give nothing. Repeated rows count
    each. An empty table gives an empty result. A source has one shard per ``rows_per_shard`` of its own rows with words.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in payload]) if payload else F.lit(None).cast("string")
    rows = stage(df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), source_key(F.col(source_col)).alias("key"),
                           n_words(F.col(text_col)).alias("size"), F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("draw"),
                           carried.alias("payload")), "mix-rows")
    slots = max(1, -(-rows.count() // rows_per_shard))
    rows = rows.withColumn("slot", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), F.lit(slots)))
    # A shard is a run of slots; a source's rows in one slot are few, so rows find their shard by (key, slot) and no source meets in one task.
    fine = stage(rows.groupBy("key", "source", "slot").agg(F.sum("size").alias("words"), F.sum((F.col("size") > 0).cast("long")).alias("rows")), "mix-slots")
    shards = F.greatest(F.lit(1), F.least(F.lit(slots), F.ceil(F.col("rows") / rows_per_shard)))
    shards = fine.groupBy("key").agg(F.sum("rows").alias("rows")).select("key", shards.cast("long").alias("shards"))
    fine = stage(fine.join(shards, "key").withColumn("shard", F.floor(F.col("slot") * F.col("shards") / slots)), "mix-places")
    cells = stage(fine.groupBy("key", "source", "shard").agg(F.sum("words").alias("words")), "mix-cells")
    sources = targets(cells.groupBy("key", "source").agg(F.sum("words").alias("source_size")), weights, share, repeats)
    everyone = W.partitionBy()
    sources = apportion(sources, "target", F.round(F.sum("target").over(everyone) / block_words).cast("long"), "quota", [], ["rank", "key"])
    cells = cells.withColumn("group", F.col("shard") % shard_groups)
    groups = cells.groupBy("key", "group").agg(F.sum("words").alias("group_words")).join(sources.select("key", "source_size", "target", "quota"), "key")
    groups = apportion(groups, "group_words", F.col("quota"), "group_blocks", ["key"], ["group"]).drop("group_words", "quota")
    plan = apportion(cells.join(groups, ["key", "group"]), "words", F.col("group_blocks"), "blocks_taken", ["key", "group"], ["shard"])
    blocks = F.ceil(F.col("words") / block_words).cast("long")
    taken = F.least(F.col("blocks_taken"), (F.lit(float(repeats)) * blocks).cast("long"))
    plan = plan.withColumns({"blocks": blocks, "rounds": F.when(blocks > 0, F.floor(taken / blocks)).otherwise(F.lit(0)).cast("long"),
                             "more": F.when(blocks > 0, taken % blocks).otherwise(F.lit(0)),
                             "first": F.when(blocks > 0, number_of(F.concat_ws(":", F.lit(seed), "key", F.col("shard").cast("string"))) % blocks).otherwise(F.lit(0))})
    plan = stage(plan.select("key", "shard", "source_size", "target", "blocks", "rounds", "more", "first"), "mix-plan")
    # Rows without words take no place in a stream, and a shard may have many: they stay in their slots.
    aside = F.when(F.col("size") == 0, F.col("slot"))
    stream = W.partitionBy("key", "shard", aside).orderBy("draw", F.col("id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.join(fine.select("key", "slot", "shard"), ["key", "slot"])
    placed = rows.withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size")).join(plan, ["key", "shard"])

    def inside(lo: Column, hi: Column) -> Column:
        """The document's own words in stream words [lo, hi)."""
        at = F.least(F.greatest(lo - F.col("begin"), F.lit(0)), F.col("size"))
        return F.struct(at.cast("long").alias("from"), F.greatest(F.least(hi - F.col("begin"), F.col("size")), at).cast("long").alias("to"))

    last = F.col("first") + F.col("more")
    spans = F.array(inside(F.greatest(F.lit(0), last - F.col("blocks")) * 0, F.greatest(F.lit(0), last - F.col("blocks")) * block_words),
                    inside(F.col("first") * block_words, F.least(last, F.col("blocks")) * block_words))
    out = placed.withColumn("spans", spans).withColumn(
        "taken", F.col("rounds") * F.col("size") + sum(F.col("spans")[i]["to"] - F.col("spans")[i]["from"] for i in (0, 1)))
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "rounds", "spans",
                      *(["payload"] if payload else []))


def mixed_documents(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars", **kwargs) -> DataFrame:
    """The mix itself: each row of ``df`` as often as it is taken whole, and cut to the taken words where a run ends inside it.

    Cut texts have single spaces between words, and ``length_col`` follows them. Rows without words are never taken.
    """
    chosen = mix(df, text_col=text_col, payload=tuple(df.columns), **kwargs)
    words = F.regexp_extract_all(F.col("text"), F.lit(f"({WORD})"), 1)
    part = F.filter(words, lambda w, i: ((i >= F.col("spans")[0]["from"]) & (i < F.col("spans")[0]["to"]))
                    | ((i >= F.col("spans")[1]["from"]) & (i < F.col("spans")[1]["to"])))
    extra = F.col("taken") - F.col("rounds") * F.col("size")
    piece = (F.when((extra > 0) & (extra < F.col("size")), F.array(F.array_join(part, " "))).otherwise(F.array().cast("array<string>")))
    whole = F.array_repeat(F.col("text"), (F.col("rounds") + F.when((extra == F.col("size")) & (extra > 0), 1).otherwise(0)).cast("int"))
    out = (chosen.where(F.col("taken") > 0).withColumn("text", F.col("payload")[text_col])
           .withColumn("text", F.explode(F.concat(whole, piece))))
    made = {text_col: F.col("text")} | ({length_col: F.length("text").cast(df.schema[length_col].dataType)} if length_col in df.columns else {})
    return out.select(*[made.get(c, F.col("payload")[c]).alias(c) for c in df.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH RECURSIVE rows AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size, md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS draw
  FROM documents),
-- a source has one shard per 4000 of its own rows with words; a shard is a run of the table's slots
slots AS (SELECT greatest(1, ceil(count(*) / 4000.0)::BIGINT) AS slots FROM rows),
shards AS (SELECT key, greatest(1, ceil(count(*) FILTER (WHERE size > 0) / 4000.0)::BIGINT) AS shards FROM rows GROUP BY key),
dealt AS (
  SELECT rows.*, ('0x' || substr(draw, 1, 8))::BIGINT % slots * shards // slots AS shard, ('0x' || substr(draw, 1, 8))::BIGINT % slots AS slot
  FROM rows JOIN shards ON rows.key = shards.key CROSS JOIN slots),
sizes AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size FROM dealt GROUP BY key),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight,
         row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM sizes),
-- round after round: what full sources cannot take is dealt again to the others
filled AS (
  SELECT 0 AS step, key, source, source_size, weight, rank, false AS full_up FROM weighed
  UNION ALL
  SELECT step + 1, key, source, source_size, weight, rank,
         full_up OR 2.0 * source_size <= weight * (1.5 * sum(source_size) OVER () - sum(CASE WHEN full_up THEN 2.0 * source_size ELSE 0 END) OVER ())
                                         / nullif(sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER (), 0)
  FROM filled WHERE step < 60),
final AS (SELECT * FROM filled WHERE step = 60),
aimed AS (
  SELECT key, source_size, rank, CASE WHEN full_up THEN 2.0 * source_size ELSE
         ((1.5 * sum(source_size) OVER () - sum(CASE WHEN full_up THEN 2.0 * source_size ELSE 0.0 END) OVER ())
          / sum(CASE WHEN full_up THEN 0 ELSE weight END) OVER ()) * weight END::DOUBLE AS target
  FROM final),
seats AS (
  SELECT key, rank, target / (2 * j + 1) AS q FROM aimed, range(0, (SELECT round(sum(target) / 16)::BIGINT + 1 FROM aimed)) t(j)
  WHERE target > 0 AND j <= 2 + target / 16 + (SELECT count(*) FROM aimed)),
quota AS (
  SELECT key, count(*) AS quota FROM (SELECT key, row_number() OVER (ORDER BY q DESC, rank) AS n FROM seats)
  WHERE n <= (SELECT round(sum(target) / 16)::BIGINT FROM aimed) GROUP BY key),
cells AS (SELECT key, shard, sum(size)::BIGINT AS words FROM dealt GROUP BY key, shard),
-- quotas of a source go to 1024 groups of its shards, then to the shards of a group
groups AS (
  SELECT key, shard % 1024 AS grp, sum(words)::BIGINT AS words, sum(sum(words)) OVER (PARTITION BY key)::BIGINT AS total, count(*) OVER (PARTITION BY key) AS n
  FROM cells GROUP BY key, shard % 1024),
group_seats AS (
  SELECT key, grp, quota, words / (2 * j + 1) AS q FROM groups JOIN quota USING (key), range(0, (SELECT max(quota) + 1 FROM quota)) t(j)
  WHERE words > 0 AND j <= 2 + (quota + n) * (words / total)),
group_quota AS (
  SELECT key, grp, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY q DESC, grp) AS place FROM group_seats)
  WHERE place <= quota GROUP BY key, grp),
members AS (
  SELECT key, shard, shard % 1024 AS grp, words, sum(words) OVER (PARTITION BY key, shard % 1024)::BIGINT AS total,
         count(*) OVER (PARTITION BY key, shard % 1024) AS n FROM cells),
shard_seats AS (
  SELECT key, grp, shard, quota, words / (2 * j + 1) AS q FROM members JOIN group_quota USING (key, grp), range(0, (SELECT max(quota) + 1 FROM group_quota)) t(j)
  WHERE words > 0 AND j <= 2 + (quota + n) * (words / total)),
shard_quota AS (
  SELECT key, shard, count(*) AS blocks_taken
  FROM (SELECT *, row_number() OVER (PARTITION BY key, grp ORDER BY q DESC, shard) AS place FROM shard_seats) WHERE place <= quota
  GROUP BY key, shard),
plan AS (
  SELECT key, shard, words, ceil(words / 16.0)::BIGINT AS blocks, least(coalesce(blocks_taken, 0), 2 * ceil(words / 16.0)::BIGINT) AS b
  FROM cells LEFT JOIN shard_quota USING (key, shard)),
run AS (
  SELECT key, shard, blocks, CASE WHEN blocks > 0 THEN b // blocks ELSE 0 END AS rounds, CASE WHEN blocks > 0 THEN b % blocks ELSE 0 END AS more,
         CASE WHEN blocks > 0 THEN ('0x' || substr(md5('mix-1:' || key || ':' || shard::VARCHAR), 1, 8))::BIGINT % blocks ELSE 0 END AS first
  FROM plan),
placed AS (
  SELECT dealt.*, sum(size) OVER (PARTITION BY key, shard, CASE WHEN size = 0 THEN slot END ORDER BY draw, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS b0 FROM dealt),
spanned AS (
  SELECT p.*, r.*, greatest(0, least(b0 + size, 16 * greatest(0, first + more - blocks)) - b0)
         + greatest(0, least(b0 + size, 16 * least(first + more, blocks)) - greatest(b0, 16 * first)) AS part
  FROM placed p JOIN run r ON p.key = r.key AND p.shard = r.shard)
SELECT doc_id, size::BIGINT AS size, source_size, target, (rounds * size + part)::BIGINT AS taken
FROM spanned JOIN aimed ON spanned.key = aimed.key
"""
