"""Spelling variants by finite-state composition: vocabulary acceptor, one-edit transducer, vocabulary acceptor.

The composed machine reads a word with the first acceptor and writes a word that the second accepts, with exactly one inserted, deleted or
replaced code point in between. Its start states are dealt over the cluster. A pair of near words shares all before its first difference
and all after the edit; a *part* is a start state of the machine together with the tail that both words share: the words with one prefix
(the acceptor's state after it), one tail, and an edit that begins in a given interval of places. Minimised, a part's acceptor holds only
what lies between. Parts with many words are dealt again by the halves of their interval, so no part grows with the vocabulary: where the
interval is one place, words differ in one code point.

Inside a part the composition is walked state by state: while nothing is edited both acceptors stand in the same state; an edit is a pair
of arcs (or one arc and none), after which the two states must accept a common string. Pairs are counted in the part; only counts and best
partners leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tapelab.llm.common import stage, table
from tapelab.llm.prefix_trie import CRC_TABLE, crc_sql

#: Fixed values of the registered query.
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO, DAMAGE = 7, 2, 10, 31
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words of a part; larger parts are dealt again.
PART = 2000
#: Places of a part's interval; wider ones that hold several words are halved, so what lies between head and tail stays short.
PLACES = 32


def damaged_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word: every maximal run of at least ``LEAST_LENGTH`` letters of every whole text, A-Z lowered, of some a code point deleted.

    Which code point is decided by the CRC-32 of id and run (a null id counts as empty). Null and empty texts have no runs.
    """
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), 0))
    runs = df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    place = F.pmod(h, F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), place), F.substr("run", place + 2))
    return runs.select(F.when(h % DAMAGE == 0, cut).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word, n of the column ``word``, counted before the shuffle."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


# ---- the machines of one part ---------------------------------------------------------------------------------------
class Acceptor:
    """A minimised acyclic acceptor of sorted distinct strings: per state its arcs (code point to state) and whether a string ends there."""

    def __init__(self, strings: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        known: dict[tuple, int] = {}

        def close(node: list) -> int:
            """The state that accepts what ``node`` accepts; states are told apart by what they accept alone."""
            arcs, ends = node
            key = (ends, *arcs.items())
            state = known.get(key)
            if state is None:
                state = known[key] = len(self.arcs)
                self.arcs.append(arcs)
                self.final.append(ends)
            return state

        path: list[list] = [[{}, False]]
        last = ""
        for s in strings:
            k = 0
            for x, y in zip(s, last):
                if x != y:
                    break
                k += 1
            while len(path) > k + 1:
                node = path.pop()
                path[-1][0][last[len(path) - 1]] = close(node)
            for _ in range(k, len(s)):
                path.append([{}, False])
            path[-1][1] = True
            last = s
        while len(path) > 1:
            node = path.pop()
            path[-1][0][last[len(path) - 1]] = close(node)
        self.start = close(path[0])


class OneEdit:
    """acceptor o one-edit transducer o acceptor: enumerates accepted pairs whose first difference lies before ``places``.

    Each unordered pair comes once, as (common head, first middle, second middle, common rest), where a middle is a code point or empty.
    """

    def __init__(self, acceptor: Acceptor):
        self.arcs, self.final = acceptor.arcs, acceptor.final
        self.start = acceptor.start
        self.shared: dict[tuple[int, int], list[str]] = {}

    def common(self, p: int, q: int) -> list[str]:
        """Strings that both states accept. Kept per pair of states; a state with itself has all it accepts."""
        key = (p, q) if p <= q else (q, p)
        found = self.shared.get(key)
        if found is None:
            found = [""] if self.final[p] and self.final[q] else []
            other = self.arcs[q]
            for c, to in self.arcs[p].items():
                t = other.get(c)
                if t is not None:
                    found += [c + r for r in self.common(to, t)]
            self.shared[key] = found
        return found

    def pairs(self, places: int) -> Iterator[tuple[str, str, str, str]]:
        todo = [(self.start, "")]
        while todo:
            state, head = todo.pop()
            arcs = list(self.arcs[state].items())
            for i, (a, p) in enumerate(arcs):
                for b, q in arcs[i + 1:]:  # replaced: two arcs, then a common string
                    for rest in self.common(p, q):
                        yield head, a, b, rest
                # inserted: one arc against none. What follows must not begin with the same code point, or the pair would differ later.
                if self.final[state] and self.final[p]:
                    yield head, a, "", ""
                beside = self.arcs[p]
                for b, q in arcs:
                    if b != a and b in beside:
                        for rest in self.common(beside[b], q):
                            yield head, a, "", b + rest
                if len(head) + 1 < places:
                    todo.append((p, head + a))


def near_in_part(words: list[str], counts: list[int], m: int, head: int, tail: int, places: int) -> Iterator[tuple[str, int, int, str]]:
    """(word, near words, largest n among them, the first of those) for words that share ``head`` and ``tail`` code points.

    Pairs whose shorter word has ``m`` code points count here; two longer ones meet in another part.
    """
    if len(words) < 2:
        return
    order = sorted(range(len(words)), key=lambda i: words[i][head: len(words[i]) - tail])
    middle = [words[i][head: len(words[i]) - tail] for i in order]
    index = {m: i for m, i in zip(middle, order)}
    best: dict[int, list] = {}
    for front, a, b, rest in OneEdit(Acceptor(middle)).pairs(places):
        i, j = index[front + a + rest], index[front + b + rest]
        if len(words[i]) > m and len(words[j]) > m:
            continue
        for me, other in ((i, j), (j, i)):
            rank = (-counts[other], words[other])
            seen = best.get(me)
            if seen is None:
                best[me] = [1, rank]
            else:
                seen[0] += 1
                if rank < seen[1]:
                    seen[1] = rank
    for i, (n, (count, word)) in best.items():
        yield words[i], n, -count, word


# ---- parts ----------------------------------------------------------------------------------------------------------
def first_parts(vocab: DataFrame) -> DataFrame:
    """word, n, m, lo, hi: every word in the parts of its pairs with words of the same length, one less and one more.

    ``m`` is the smaller length of a pair; its first difference begins in [lo, hi) of the places 0 .. m.
    """
    m = F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("m")
    half = F.floor(F.col("m") / 2).cast("int")
    span = F.explode(F.array(F.struct(F.lit(0).alias("lo"), half.alias("hi")), F.struct(half.alias("lo"), (F.col("m") + 1).alias("hi")))).alias("s")
    return vocab.select("word", "n", m).where(F.col("m") >= 1).select("word", "n", "m", span).select("word", "n", "m", "s.lo", "s.hi")


def start_state(rows: DataFrame) -> DataFrame:
    """Adds head (shared by all words of the part before place lo), tail (shared after the edit) and their hash ``part``.

    A pair that first differs at place p < hi shares its last m - p code points if one was inserted, m - p - 1 if one was replaced.
    """
    tail = F.greatest(F.lit(0), F.col("m") - F.col("hi")).cast("int")
    rows = rows.withColumn("tail_n", tail)
    head_text, tail_text = F.substr("word", F.lit(1), F.col("lo")), F.substr("word", F.length("word") - F.col("tail_n") + 1, F.col("tail_n"))
    return rows.withColumn("part", F.xxhash64("m", "lo", "hi", head_text, F.lit("/"), tail_text))


def halves(rows: DataFrame) -> DataFrame:
    """The same words in the two halves of their intervals."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    span = F.explode(F.array(F.struct(F.col("lo").alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi").alias("hi")))).alias("s")
    return rows.select("word", "n", "m", span).select("word", "n", "m", "s.lo", "s.hi")


def near_words(vocab: DataFrame, most: int = PART) -> DataFrame:
    """word, n_near, best (largest n of a near word, and the smallest such word) for every word with a near word.

    ``vocab``: word, n; staged, since it is read once a round. Every round deals the parts that are still crowded or wide again, without
    those of a single word; an interval halves, so there are about log2(longest word) rounds at most.
    """
    rows = start_state(first_parts(vocab))
    found: DataFrame | None = None
    while True:
        large = rows.groupBy("part").agg(F.count(F.lit(1)).alias("members"), F.first(F.col("hi") - F.col("lo")).alias("width"))
        again = ((F.col("members") > most) & (F.col("width") > 1)) | ((F.col("members") > 1) & (F.col("width") > PLACES))
        large = stage(large.where(again).select("part"), "large-parts")
        done = large.isEmpty()
        part = walked(rows if done else rows.join(large, "part", "left_anti"))
        found = part if found is None else found.unionByName(part)
        if done:
            break
        rows = stage(start_state(halves(rows.join(large, "part"))), "parts")
    best = F.max_by(F.struct("near_n", "near"), F.struct(F.col("near_n"), descending(F.col("near")))).alias("best")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best)


def descending(word: Column) -> Column:
    """Sorts the other way round than the word: code points counted down from above, and an end that is above all of them."""
    return F.concat(F.transform(F.split(word, ""), lambda c: F.lit(1 << 21) - F.ascii(c)), F.array(F.lit(1 << 22)))


def walked(rows: DataFrame) -> DataFrame:
    """Composes the machine of every part: word, n_near, near_n, near. Parts are streamed, sorted, one at a time in memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts, shape = None, [], [], (0, 0, 0, 0)

        def made(rows: list[tuple]) -> pa.RecordBatch:
            types = (pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["word", "n_near", "near_n", "near"])

        for batch in batches:
            out: list[tuple] = []
            for part, word, n, m, lo, hi, tail in zip(*(c.to_pylist() for c in batch.columns)):
                if part != key:
                    out += near_in_part(words, counts, *shape)
                    key, words, counts, shape = part, [], [], (m, lo, tail, hi - lo)
                words.append(word)
                counts.append(n)
            yield made(out)
        yield made(list(near_in_part(words, counts, *shape)))

    dealt = rows.select("part", "word", "n", "m", "lo", "hi", "tail_n").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(run, "word string, n_near long, near_n long, near string")


def roots(forms: DataFrame) -> DataFrame:
    """word, root: the last word reached over ``forms`` (word, form), by doubling. A form is ten times as frequent, so chains are short."""
    jump = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        far = jump.select(F.col("word").alias("root"), F.col("root").alias("far"))
        step = stage(jump.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")), "roots")
        jump = step.select("word", "root")
        if step.where("moved").isEmpty():
            return jump


def variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT,
             ratio: int = FORM_RATIO, most: int = PART) -> DataFrame:
    """One row per word: word, form (null: none), root, n, n_near, form_n. See ``grouped`` for words of another make.

    Null and empty texts give no words, a null id counts as empty, repeated rows count again, other columns do not matter. Ties of n go to
    the smaller word in code-point order. An empty table gives an empty result.
    """
    return grouped(vocabulary(damaged_runs(df, id_col, text_col), least_length, least_count), ratio, most)


def grouped(vocab: DataFrame, ratio: int = FORM_RATIO, most: int = PART) -> DataFrame:
    """Spelling variants of a vocabulary (word, n)."""
    vocab = stage(vocab, "vocabulary")
    near = near_words(vocab, most)
    better = F.col("best.near_n") >= ratio * F.col("n")
    rows = stage(vocab.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.near")).alias("form"), F.when(better, F.col("best.near_n")).alias("form_n")), "near")
    ends = roots(rows.where(F.col("form").isNotNull()).select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


SQL = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (
  SELECT doc_id, translate(r, '{UPPER}', '{LOWER}') AS run
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]{{7,}}')) AS r FROM documents)),
coded AS (
  SELECT run, {crc_sql("flatten(list_transform(string_split(concat(doc_id, ':', run), ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6), 128 + (unicode(x) & 63)]::BIGINT[] END))")} AS h
  FROM runs, crc_table),
damaged AS (
  SELECT CASE WHEN h % 31 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM coded),
vocab AS (SELECT word, count(*) AS n FROM damaged WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
cut AS (
  SELECT DISTINCT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM vocab)),
pairs AS (
  SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN vocab b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN vocab b ON a.rest = b.word),
ranked AS (SELECT word, count(*) AS n_near, min({{'n': -n, 'near': near}}) AS best FROM pairs GROUP BY word),
chosen AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.n >= 10 * v.n THEN best.near END AS form, CASE WHEN -best.n >= 10 * v.n THEN -best.n END AS form_n
  FROM vocab v LEFT JOIN ranked USING (word)),
walk AS (
  SELECT word, word AS root FROM chosen
  UNION ALL SELECT walk.word, c.form FROM walk JOIN chosen c ON c.word = walk.root WHERE c.form IS NOT NULL),
ends AS (SELECT walk.word, root FROM walk JOIN chosen c ON c.word = root WHERE c.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM chosen JOIN ends USING (word)
"""
