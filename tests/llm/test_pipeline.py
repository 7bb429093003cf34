"""The pipeline's stages over a small table against plain Python."""

import collections
import re

import corpus_pipeline
from tapelab.llm import mixing, packing
from tapelab.llm.tokens import Encoder
from tests.llm.fixtures import messy_rows
from tests.llm.test_duplicates import brute_similar, near_copies


def test_stages(spark, tmp_path):
    from tests.llm.fixtures import messy

    letters = str.maketrans("0123456789", "aeioutnsrl")
    rows = [(i, t and t.translate(letters), *more) for i, t, *more in messy_rows() + near_copies(10, 1)]
    messy(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "ngram_jaccard", "source_mixing", "packing"]
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, step in corpus_pipeline.STAGES:
        out = step(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen.append([tuple(r) for r in docs.collect()])
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    language, exact, near, mixed, packed = seen
    gone = {r[0] for r in rows} - {r[0] for r in language}
    assert {1, 2, 3} <= gone and len(gone) < 12 and not gone & {6, 7, 8, *range(1000, 1010)}
    best = {}
    for r in language:
        best[r[1]] = max(best.get(r[1], -1), -1 if r[0] is None else r[0])
    assert sorted((-1 if r[0] is None else r[0], r[1]) for r in exact) == sorted((i, t) for t, i in best.items())
    assert sorted(str(r[0]) for r in near) == sorted(i for i, c, _ in brute_similar(exact) if i == c)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    total = sum(size(r[1]) for r in near)
    assert abs(sum(size(r[1]) for r in mixed) - 1.5 * total) <= 16 * 8
    copies = collections.Counter((r[0], r[1]) for r in mixed if (r[0], r[1]) in {(x[0], x[1]) for x in near})
    assert max(copies.values()) <= 2
    e = Encoder(packing.tokenizer_path()).tokenizer
    tokens = sum(len(e.encode(r[1], add_special_tokens=False).ids) + 1 for r in mixed)
    assert sum(r[2] for r in packed) == tokens
    whole = [tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert collections.Counter(r[:5] for r in whole) == collections.Counter(r[:5] for r in packed)
