"""Small awkward tables shared by the tests of this folder."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
#: Names that operators use inside.
CLASHING = ["id", "key", "size", "draw", "payload", "shard", "slot", "part", "copy", "n", "bands", "node", "label", "rounds", "spans", "best",
            "text_sha256", "row_tag", "group_size", "tag", "host", "letters", "conv", "chunk", "pos", "vec", "row", "sig", "same", "rank", "target", "taken"]


def words(rng: random.Random, n: int, vocabulary: int = 40) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def messy_rows(seed: int = 1) -> list[tuple]:
    """Nulls in every column, empty, blank and very long texts, equal texts, repeated rows, odd white space and other scripts."""
    rng = random.Random(seed)
    base = words(rng, 120, 4000)
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "  \n\t", "en", "a", 4), (4, "one", None, "b", 3), (5, "one", "en", None, 3),
            (6, base, "en", "a", len(base)), (7, base, "en", "b", len(base)), (8, base + " end", "en", "a", None),
            (9, words(rng, 9000), "en", "c", 1), (10, "日本語 テキスト 'quoted' don't", "ja", "c", 1), (11, "a\u00a0b\x85c\x0bd\x0ce  f", "en", "a", 1),
            (None, "no id here", "en", "a", 1), (12, "<|endoftext|> ### user: </turn> \\", "en", "d", 1)]
    rows += [(13, words(random.Random(3), 60), "en", "a", 1)] * 3
    rows += [(20 + i, words(rng, rng.randrange(1, 80), 4000), "en", rng.choice(["a", "b", None]), 1) for i in range(30)]
    return rows


def messy(spark, rows=None):
    return spark.createDataFrame(messy_rows() if rows is None else rows, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASHING})
