"""Language identification with language-bitmask n-gram filters.

One Bloom filter per language, bit-sliced: a slot of the table holds one bit per language, so two look-ups and an AND give all languages
that contain an n-gram. Per text the bits are counted per language, counts are corrected for each language's rate of false positives,
and the language that contains most of the text's n-grams wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tapelab.llm.common import table
from tapelab.llm.words import Chunk, U, chunks

#: n-grams are N bytes of the lower-cased text with runs of anything but letters as one space.
N = 4
#: Bounds of the training sample and of the model: labelled documents per language, and n-grams per language.
SAMPLE_PER_LANGUAGE = 4_000
GRAMS_PER_LANGUAGE = 30_000
#: An n-gram belongs to every language in which it is at least this share as frequent as where it is most frequent.
SHARED = 0.25
LEAST_COUNT = 3
SLOT_BITS = 19
PROBES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
UNDECIDED = "und"
#: A text with a smaller share of known n-grams is in none of the languages.
LEAST_SCORE = 0.3

IS_LETTER = np.zeros(256, bool)
IS_LETTER[ord("a"): ord("z") + 1] = True
IS_LETTER[0x80:] = True


def held_out(doc_id: Column) -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 modulo 4. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def grams(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of all texts of a chunk as numbers below 2**32, and their first byte. Texts begin and end with a space."""
    data = np.where(IS_LETTER[c.data], c.data, np.uint8(0x20))
    if len(data) < N:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    gram = np.zeros(len(data) - N + 1, np.uint32)
    for k in range(N):
        gram = (gram << np.uint32(8)) | data[k: len(data) - N + 1 + k]
    whole = np.ones(len(gram), bool)
    for k in range(1, N):  # runs over the end of a text
        last = c.end - k
        whole[last[(last >= 0) & (last < len(gram))]] = False
    gap = (data[:-1] == 0x20) & (data[1:] == 0x20)
    for k in range(N - 1):
        whole &= ~gap[k: k + len(gram)]
    at = np.flatnonzero(whole)
    return gram[at], at


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


@dataclass
class LanguageModel:
    languages: list[str]
    #: One unsigned word per slot and 64 languages.
    slots: np.ndarray
    false_rate: np.ndarray

    def masks(self, gram: np.ndarray) -> np.ndarray:
        out = None
        for p in PROBES:
            at = ((gram.astype(U) * U(p)) >> U(64 - SLOT_BITS)).astype(np.int64)
            out = self.slots[:, at] if out is None else out & self.slots[:, at]
        return out

    def judge(self, c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Best language and share of the text's n-grams that it contains, per text; equal shares go to the first language by name."""
        gram, at = grams(c)
        cut = np.searchsorted(at, np.concatenate((c.begin, c.end[-1:])))
        n = np.diff(cut)
        mask = self.masks(gram)
        share = np.zeros((len(self.languages), len(n)))
        for i in range(len(self.languages)):
            bit = (mask[i // 64] >> mask.dtype.type(i % 64)) & mask.dtype.type(1)
            total = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
            hits = total[cut[1:]] - total[cut[:-1]]
            share[i] = np.clip((hits - n * self.false_rate[i]) / np.maximum(n * (1 - self.false_rate[i]), 1e-9), 0, 1)
        best = share.argmax(axis=0)
        return best, share[best, np.arange(len(n))]


def build(per_language: dict[str, np.ndarray]) -> LanguageModel:
    languages = sorted(per_language)
    kind = np.uint8 if len(languages) <= 8 else np.uint64
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << SLOT_BITS), kind)
    rate = np.zeros(len(languages))
    for i, name in enumerate(languages):
        filled = np.zeros(1 << SLOT_BITS, bool)
        for p in PROBES:
            filled[((per_language[name].astype(U) * U(p)) >> U(64 - SLOT_BITS)).astype(np.int64)] = True
        slots[i // 64][filled] |= kind(1 << (i % 64))
        rate[i] = filled.mean() ** len(PROBES)
    return LanguageModel(languages, slots, rate)


def sampled(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, sample: int) -> tuple[DataFrame, list[str]]:
    """About ``sample`` labelled documents per language as (lang, text), drawn by a hash of id and text, and the languages.

    Null or repeated ids are told apart by their texts, so the sample stays near its bound; only rows that repeat id and text are chosen
    or left together.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("draw"))
    share = known.groupBy("lang").agg((F.lit(float(sample)) / F.count(F.lit(1))).alias("share"))
    rates = {r["lang"]: r["share"] for r in share.collect()}  # a row per language
    if not rates:
        return known.limit(0).drop("draw"), []
    rate = F.element_at(F.create_map(*[F.lit(x) for pair in rates.items() for x in pair]), F.col("lang"))
    return known.where(F.pmod(F.col("draw"), F.lit(1_000_000)) < F.lit(1e6) * rate).drop("draw"), list(rates)


def train(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample: int = SAMPLE_PER_LANGUAGE,
          size: int = GRAMS_PER_LANGUAGE) -> LanguageModel:
    """Learns from about ``sample`` documents per language (``sampled``); rows without language or text teach nothing.

    An empty table gives a model without languages. What comes to the driver is at most ``size`` numbers per language.
    """
    chosen, languages = sampled(labelled, text_col, lang_col, id_col, sample)
    if not languages:
        return build({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for c in chunks(batch.column(1)):
                gram, at = grams(c)
                text = np.searchsorted(c.end, at, side="right")
                names = np.array(langs[c.first: c.first + len(c.end)], object)
                for lang in set(names.tolist()):
                    values, n = np.unique(gram[(names == lang)[text]], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(values.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counted = (chosen.select("lang", padded(F.col("text")).alias("text"))
               .mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    rate = counted.withColumn("rate", F.col("n") / F.sum("n").over(W.partitionBy("lang")))
    typical = rate.withColumn("most", F.max("rate").over(W.partitionBy("gram"))).where((F.col("n") >= LEAST_COUNT) & (F.col("rate") >= SHARED * F.col("most")))
    top = typical.withColumn("place", F.row_number().over(W.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).where(F.col("place") <= size)
    got = top.groupBy("lang").agg(F.collect_list("gram").alias("grams")).collect()
    found = {r["lang"]: np.array(r["grams"], np.uint32) for r in got}
    return build({lang: found.get(lang, np.zeros(0, np.uint32)) for lang in languages})


def predict(df: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score per row. Score: share of n-grams that the language contains. Null texts, texts without a letter and
    everything under an empty model are ``und`` with score 0. A text with letters but without an n-gram (one ASCII letter) is in no language
    more than in another: the first by name, score 0. Repeated rows get equal answers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            named = batch.column(2).to_numpy(zero_copy_only=False)
            for c in chunks(batch.column(1)):
                k = len(c.end)
                if model.languages:
                    best, score = model.judge(c)
                    lang = np.array(model.languages, object)[best]
                else:
                    lang, score = np.full(k, UNDECIDED, object), np.zeros(k)
                has = named[c.first: c.first + k].astype(bool)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(c.first, k), pa.array(np.where(has, lang, UNDECIDED), pa.string()),
                                                  pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return df.select(F.col(id_col).cast("long").alias("doc_id"), padded(F.col(text_col)).alias("text"), letters.alias("letters")).mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def keep_identified(df: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` whose text is in one of the model's languages with at least the score ``least``, all columns unchanged.

    Null texts, texts without a letter and everything under an empty model go; ids are not read; repeated rows stay or go together.
    """
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = batch.column(len(names) + 1).to_numpy(zero_copy_only=False).astype(bool)
            keep = np.zeros(batch.num_rows, bool)
            if model.languages:
                for c in chunks(batch.column(len(names))):
                    k = slice(c.first, c.first + len(c.end))
                    keep[k] = has[k] & (model.judge(c)[1] >= least)
            yield pa.RecordBatch.from_arrays(batch.columns[:len(names)], schema=pa.schema([batch.schema.field(i) for i in range(len(names))])).filter(pa.array(keep))

    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return df.select(*[F.col(f"`{c}`") for c in names], padded(F.col(text_col)).alias("__padded"), letters.alias("__letters")).mapInArrow(run, df.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
