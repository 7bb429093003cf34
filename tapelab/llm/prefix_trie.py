"""Conversations as a trie of shared prefixes, with totals of every subtree by parallel tree contraction.

A turn sequence is known by its Zobrist hash, the exclusive or of one 128-bit value per (place, role, text): it is associative, so prefixes
of a conversation of any length are hashed in pieces. A node is a distinct prefix.

Contraction works on the whole tree at once. *Compress* takes every chain of nodes with one child, follows it by pointer doubling to the
node where it ends, and takes the chain out; *rake* takes every leaf out and adds its total to its parent. After compress each inner node
has two children or more, so each pair of steps at least halves the tree. Chains are kept with what they add, and are put back in
reverse order once the totals of their ends are known. All steps are joins and aggregations; only emptiness checks reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tapelab.llm.common import WORD, join_split, stage, table

#: Fixed values of the registered query: conversations that share their base's first turns, and how many turns at most.
FAMILY, HEADS = 20, 4
#: Ids of members in one piece of a digest, as a power of two.
PIECE = 12


def root_key() -> Column:
    """The hash of no turns."""
    return F.struct(F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"))


def in_order(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, part, seq, role, text: turns sorted by conversation and turn over range partitions, so no conversation is one task.

    Null turns come first, equal turns are ordered by the first 32 characters of role and text and then by a hash; null role and text
    count as empty; rows without a conversation are left out. ``seq`` rises in that order, ``part`` is the task that holds the row.
    """
    rows = df.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"), F.monotonically_increasing_id().alias("tag"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.substring("role", 1, 32), F.substring("text", 1, 32), F.xxhash64("role", "text"), F.col("tag")]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return stage(ranged.select("conv", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq"), "role", "text"), "turns")


def places(ordered: DataFrame) -> DataFrame:
    """conv, part, first (its smallest seq), before (turns in earlier parts): a row per conversation and part."""
    return ordered.groupBy("conv", "part").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first")).withColumn(
        "before", F.coalesce(F.sum("n").over(W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))


def rebuilt(ordered: DataFrame, family: int = FAMILY, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) after each conversation c took its first turns from the base of its family, c - c % ``family``.

    The number of turns is crc32(c) % ``heads``; a shorter base gives all it has, an absent one none; c's own turns follow after as many
    of them. turns: conv, part, seq, depth (place from 1), role, text, total; conversations: conv, total (turns, also none).
    """
    at = stage(places(ordered), "places")
    own = at.groupBy("conv").agg(F.sum("n").alias("n"))
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    taken = F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(heads))
    convs = (own.withColumn("base", F.col("conv") - F.col("conv") % family).withColumn("h", taken).join(base, "base", "left")
             .withColumn("given", F.least("h", F.coalesce("base_n", F.lit(0))))
             .withColumn("total", F.col("given") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    convs = stage(convs.select("conv", "base", "h", "given", "total"), "conversations")
    numbered = ordered.join(at.join(convs, "conv"), ["conv", "part"]).withColumn("pos", F.col("before") + F.col("seq") - F.col("first") + 1)
    mine = numbered.where(F.col("pos") > F.col("h")).select(
        "conv", "part", "seq", (F.col("given") + F.col("pos") - F.col("h")).alias("depth"), "role", "text", "total")
    first = numbered.where((F.col("conv") == F.col("base")) & (F.col("pos") < heads)).select("base", "pos", "role", "text")
    lent = convs.select("conv", "base", "h", "total").join(first, "base").where(F.col("pos") <= F.col("h")).select(
        "conv", F.lit(-1).alias("part"), F.col("pos").alias("seq"), F.col("pos").alias("depth"), "role", "text", "total")
    return mine.unionByName(lent), convs.select("conv", "total")


def prefixes(turns: DataFrame) -> DataFrame:
    """conv, depth, key (of its first ``depth`` turns), parent (of one less), words (in the last text), last: a row per turn."""
    z = lambda k: F.xxhash64(F.lit(k), F.col("depth").cast("long"), "role", "text")
    words = F.size(F.regexp_extract_all("text", F.lit(WORD), 0)).cast("long")
    hashed = stage(turns.select("conv", "part", "seq", "depth", z(1).alias("z1"), z(2).alias("z2"), words.alias("words"), (F.col("depth") == F.col("total")).alias("last")), "hashes")
    here = W.partitionBy("conv", "part").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    local = hashed.withColumns({"x1": F.bit_xor("z1").over(here), "x2": F.bit_xor("z2").over(here)})
    sums = hashed.groupBy("conv", "part").agg(F.bit_xor("z1").alias("s1"), F.bit_xor("z2").alias("s2"))
    sums = sums.select("conv", "part", *[F.coalesce(F.bit_xor(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    whole = [F.col(f"x{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)]
    pair = lambda a, b: F.struct(a.alias("k1"), b.alias("k2"))
    return local.join(sums, ["conv", "part"]).select(
        "conv", "depth", pair(*whole).alias("key"), pair(*[w.bitwiseXOR(F.col(f"z{i}")) for i, w in zip((1, 2), whole)]).alias("parent"), "words", "last")


def subtree_sums(tree: DataFrame, values: list[str]) -> DataFrame:
    """key and, for each of ``values``, its sum over the subtree of the key, for a ``tree`` of key, parent (null: root) and long values.

    Parallel tree contraction; see the module. Several roots make several trees; an empty tree gives an empty result. Keys are unique,
    every parent is a key.
    """
    up = [f"up_{v}" for v in values]
    alive = stage(tree.select("key", "parent", *values, *[F.lit(0).cast("long").alias(u) for u in up]), "alive")
    raked: list[DataFrame] = []
    chains: list[DataFrame | None] = []
    while not alive.isEmpty():
        alive, chain = compress(alive, values, up)
        chains.append(chain)
        alive, leaves = rake(alive, values, up)
        raked.append(leaves)
    totals = None
    for leaves, chain in zip(reversed(raked), reversed(chains)):
        totals = leaves if totals is None else totals.unionByName(leaves)
        if chain is not None:
            ends = totals.select(F.col("key").alias("end"), *[F.col(v).alias(f"end_{v}") for v in values])
            put_back = join_split(chain, ends, "end").select("key", *[(F.col(v) + F.col(f"end_{v}")).alias(v) for v in values])
            totals = totals.unionByName(stage(put_back, "expanded"))
    return tree.select("key", *values) if totals is None else totals


def compress(alive: DataFrame, values: list[str], up: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """Takes out every node with one child (roots stay): (what is left, chain rows key, end, values to add to the end's total).

    ``up`` is what a node gives its parent beyond its own total: what the chain between them holds.
    """
    children = alive.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(
        F.count(F.lit(1)).alias("kids"), F.first("key").alias("end"), *[F.first(u).alias(f"child_{u}") for u in up])
    hops = stage(alive.where(F.col("parent").isNotNull()).join(children.where("kids = 1"), "key").select(
        "key", "parent", "end", *[(F.col(v) + F.col(f"child_{u}")).alias(v) for v, u in zip(values, up)], *up), "hops")
    if hops.isEmpty():
        return alive, None
    inner = hops.select("key")
    jump = stage(hops.drop("parent", *up).join(inner.select(F.col("key").alias("end"), F.lit(True).alias("open")), "end", "left")
                 .select("key", "end", *values, F.coalesce("open", F.lit(False)).alias("open")), "jump")
    while not jump.where("open").isEmpty():  # twice as far each time; rows at the end of their chain are not joined again
        far = jump.select(F.col("key").alias("end"), F.col("end").alias("far"), *[F.col(v).alias(f"far_{v}") for v in values], F.col("open").alias("on"))
        further = jump.where("open").join(far, "end").select(
            "key", F.col("far").alias("end"), *[(F.col(v) + F.col(f"far_{v}")).alias(v) for v in values], F.col("on").alias("open"))
        jump = stage(further.unionByName(jump.where("NOT open")), "jump")
    chain = jump.drop("open")
    # A chain's first node has a parent outside of chains; the chain's end takes that parent, and all that the chain and the link above it hold.
    heads = hops.select("key", "parent", *up).join(inner.withColumnRenamed("key", "parent"), "parent", "left_anti").join(chain, "key").select(
        F.col("end").alias("key"), F.col("parent").alias("above"), *[(F.col(v) + F.col(u)).alias(f"more_{v}") for v, u in zip(values, up)])
    left = alive.join(inner, "key", "left_anti").join(heads, "key", "left").select(
        "key", F.coalesce("above", "parent").alias("parent"), *values, *[F.coalesce(f"more_{v}", u).alias(u) for v, u in zip(values, up)])
    return stage(left, "alive"), chain


def rake(alive: DataFrame, values: list[str], up: list[str]) -> tuple[DataFrame, DataFrame]:
    """Takes out every leaf: (what is left, with the leaves' totals added to their parents, and the totals of the leaves)."""
    children = alive.where(F.col("parent").isNotNull()).select(F.col("parent").alias("key")).distinct()
    leaves = stage(alive.join(children, "key", "left_anti"), "leaves")
    gifts = leaves.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(
        *[F.sum(F.col(v) + F.col(u)).alias(f"more_{v}") for v, u in zip(values, up)])
    left = alive.join(leaves.select("key"), "key", "left_anti").join(gifts, "key", "left").select(
        "key", "parent", *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values], *up)
    return stage(left, "alive"), leaves.select("key", *values)


def end_digests(ends: DataFrame) -> DataFrame:
    """key, ends_sha256 over the decimal ids of ``ends`` (key, conv), ascending, joined by commas.

    Ids are sorted over range partitions and joined in pieces; a key's pieces then stream through a hash that holds nothing but its state.
    """
    flat = ends.select("key.k1", "key.k2", "conv").repartitionByRange("k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    numbered = stage(flat.withColumn("piece", F.shiftright(F.monotonically_increasing_id(), PIECE)), "ends")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = numbered.groupBy("k1", "k2", "piece").agg(ids.alias("ids")).repartition("k1", "k2").sortWithinPartitions("k1", "k2", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            out = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if (k1, k2) != key:
                    if key is not None:
                        out.append((*key, state.hexdigest()))
                    key, state = (k1, k2), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
            yield frame(out)
        if key is not None:
            yield frame([(*key, state.hexdigest())])

    def frame(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string()))], ["k1", "k2", "ends_sha256"])

    return pieces.select("k1", "k2", "ids").mapInArrow(run, "k1 long, k2 long, ends_sha256 string").select(F.struct("k1", "k2").alias("key"), "ends_sha256")


def prefix_trie(df: DataFrame, family: int = FAMILY, heads: int = HEADS, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                text: str = "text") -> DataFrame:
    """One row per node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256; see the contract of ``rebuilt`` for how conversations take turns of others.

    Null role and text count as empty, null turns come first, repeated rows are turns of their own, rows without a conversation are left
    out, other columns do not matter. The root has no text and a null parent. An empty table gives an empty result.
    """
    turns, convs = rebuilt(in_order(df, conv, turn, role, text), family, heads)
    rows = stage(prefixes(turns), "prefixes")
    root = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        root_key().alias("key"), F.lit(None).cast("struct<k1:long,k2:long>").alias("parent"), F.lit(0).cast("long").alias("depth"), "conv_id", "n_convs", F.lit(0).cast("long").alias("words"))
    nodes = rows.groupBy("key").agg(F.first("parent").alias("parent"), F.first("depth").cast("long").alias("depth"), F.min("conv").alias("conv_id"),
                                    F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    nodes = stage(nodes.unionByName(root), "nodes")
    children = nodes.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = stage(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    leaf: Column = (F.col("n_children") == 0).cast("long")
    totals = subtree_sums(nodes.select("key", "parent", leaf.alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    below = nodes.where(F.col("parent").isNotNull()).select("key", "parent")
    parents = join_split(below, nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id")), "parent").drop("parent")
    ends = rows.where("last").select("key", "conv").unionByName(convs.where("total = 0").select(root_key().alias("key"), "conv"))
    return (nodes.join(totals, "key").join(parents, "key", "left").join(end_digests(ends), "key", "left")
            .select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a text's bytes in SQL: the table of its polynomial, and the walk over a list of bytes.
CRC_TABLE = """crc_table AS (SELECT list(v ORDER BY i) AS t FROM (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def crc_sql(bytes_list: str) -> str:
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bytes_list}), lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])), 4294967295::BIGINT)"


SQL = rf"""
WITH {CRC_TABLE},
lists AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
sized AS (SELECT lists.*, {crc_sql("list_transform(string_split(c::VARCHAR, ''), lambda x: unicode(x)::BIGINT)")} % 4 AS h FROM lists, crc_table),
rebuilt AS (
  SELECT a.c, list_concat(coalesce(CASE WHEN h > 0 THEN b.turns[1:h] END, []), a.turns[h + 1:]) AS turns
  FROM sized a LEFT JOIN lists b ON b.c = a.c - a.c % 20),
pre AS (SELECT c, d, CASE WHEN d > 0 THEN turns[1:d] ELSE [] END AS p, d = len(turns) AS last FROM rebuilt, LATERAL (SELECT unnest(range(0, len(turns) + 1)) AS d)),
node AS (
  SELECT p, any_value(d) AS depth, min(c) AS conv_id, count(*) AS n_convs,
         (count(*) - 1) * coalesce(len(regexp_extract_all(p[len(p)].t, '[^\x20\x09-\x0D]+')), 0) AS saved,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE last), '')) AS ends
  FROM pre GROUP BY p),
mem AS (SELECT pre.c, pre.d, node.conv_id AS rep FROM pre JOIN node ON pre.p = node.p),
kid AS (SELECT node.conv_id, node.depth, m.rep AS parent FROM node JOIN mem m ON m.c = node.conv_id AND m.d = node.depth - 1),
kids AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n FROM kid GROUP BY ALL),
own AS (SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON kids.conv_id = node.conv_id AND kids.depth = node.depth),
total AS (
  SELECT m.rep, m.d, sum((n_children = 0)::BIGINT) AS n_leaves, sum(saved) AS saved FROM own JOIN mem m ON m.c = own.conv_id AND m.d <= own.depth GROUP BY ALL)
SELECT own.conv_id, own.depth::BIGINT AS depth, kid.parent AS parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves,
       total.saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM own JOIN total ON rep = own.conv_id AND total.d = own.depth LEFT JOIN kid ON kid.conv_id = own.conv_id AND kid.depth = own.depth
"""
