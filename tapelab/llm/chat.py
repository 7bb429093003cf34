"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, all earlier turns are its context,
and only that reply is trainable.

Turns are formatted once. ``pieces`` then writes every example out, context and all, in pieces of at most a chunk of turns, so an example
of any length is never one row and the examples of a long conversation spread over its chunks; the text grows with the square of the
turns, what is held and shuffled does not. ``read_back`` parses the pieces, ``example_texts`` joins them up for export.

Template: ``### role: text </turn>`` and a newline. Inside texts and roles ``\\``, ``#`` and ``<`` (in roles ``:`` too) become ``\\b``,
``\\h``, ``\\l`` (``\\c``): neither mark can then occur inside a text, and a backslash always starts a two-character code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tapelab.llm.common import table

#: Characters with a meaning, and their codes.
CODES = [("\\", "\\b"), ("#", "\\h"), ("<", "\\l"), (":", "\\c")]
OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
TARGET = "assistant"
CHUNK = 256
#: Fixed values of the registered query: one more conversation whose texts hold control strings.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def escape(c: Column, codes: list[tuple[str, str]] = CODES[:3]) -> Column:
    return reduce(lambda x, code: F.replace(x, F.lit(code[0]), F.lit(code[1])), codes, c)


def unescape(c: Column, codes: list[tuple[str, str]] = CODES[:3]) -> Column:
    """Codes of the backslash itself are resolved last."""
    return reduce(lambda x, code: F.replace(x, F.lit(code[1]), F.lit(code[0])), reversed(codes), c)


def segments(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Formatted turns in order: key, conv, chunk, pos (in the chunk), formatted, begin, end (in the conversation's stream), is_target.

    Null text and role count as empty, a null conversation is one conversation, null turns come first; equal turns are ordered by role
    and text. Offsets are summed inside chunks of turn numbers and then over the chunks, so a huge conversation is not one task.
    ``key`` is the conversation's id as text that is never null: a number beside a null would reach pandas as a double.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col(conv).cast("string")), F.lit("")).alias("key")
    clean = df.select(key, F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
                      F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = clean.select("key", "conv", "turn", (F.col("role") == TARGET).alias("is_target"), F.floor(F.coalesce("turn", F.lit(-1)) / CHUNK).alias("chunk"), F.concat(
        F.lit(OPEN), escape(F.col("role"), CODES), F.lit(MIDDLE), escape(F.col("text")), F.lit(CLOSE)).alias("formatted"))
    order = W.partitionBy("key", "chunk").orderBy(F.col("turn").asc_nulls_first(), "formatted")
    local = made.withColumns({"pos": F.row_number().over(order), "local_end": F.sum(F.length("formatted")).over(order.rowsBetween(W.unboundedPreceding, 0))})
    before = W.partitionBy("key").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    chunks = (made.groupBy("key", "chunk").agg(F.sum(F.length("formatted")).alias("n"))
              .select("key", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    end = F.col("before") + F.col("local_end")
    return local.join(chunks, ["key", "chunk"]).select("key", "conv", "chunk", "pos", "formatted", (end - F.length("formatted")).alias("begin"), end.alias("end"), "is_target")


def with_loss(parts: DataFrame) -> DataFrame:
    """Segments with loss_start and loss_end, the trainable characters of a target's segment (null elsewhere)."""
    head = F.lit(len(OPEN) + len(MIDDLE)) + F.length(escape(F.lit(TARGET), CODES))
    return parts.withColumns({"loss_start": F.when(F.col("is_target"), head.cast("long")),
                              "loss_end": F.when(F.col("is_target"), (F.length("formatted") - len(CLOSE)).cast("long"))})


def _in_order(order: Column, text: Column) -> Column:
    """Texts of a group joined in order, without nulls."""
    kept = F.collect_list(F.when(text.isNotNull(), F.struct(order.alias("o"), text.alias("t"))))
    return F.array_join(F.transform(F.array_sort(kept), lambda s: s["t"]), "")


def pieces(parts: DataFrame) -> DataFrame:
    """Every example written out: key, conv, chunk, reader, number, text, begin, context_chars, loss_start, loss_end, is_last.

    An example is the reply ``number`` of chunk ``reader`` behind all turns before it. Its text comes in one piece per chunk up to the
    reader; ``begin`` is where the piece begins in it. The piece that ends with the reply has context_chars, where the reply begins, and
    loss_start and loss_end, the trainable characters; all three count in the example's text and are null in other pieces. ``is_last``:
    of the conversation's last example. Turns after the last reply are in no example; they come as pieces without reader and number.
    """
    at = lambda c: (F.col("begin") + F.col(c)).alias(c)
    bodies = with_loss(parts).groupBy("key", "conv", "chunk").agg(
        _in_order(F.col("pos"), F.col("formatted")).alias("body"), F.min("begin").alias("from"),
        F.array_sort(F.collect_list(F.when(F.col("is_target"), F.struct("begin", "end", at("loss_start"), at("loss_end"))))).alias("replies"))
    onward = W.partitionBy("key").orderBy("chunk").rowsBetween(W.currentRow, W.unboundedFollowing)
    counts = parts.groupBy("key", "chunk").agg(F.count(F.when(F.col("is_target"), 1)).alias("n"))
    readers = counts.select("key", "chunk", F.filter(F.collect_list(F.struct(F.col("chunk").alias("reader"), "n")).over(onward), lambda r: r["n"] > 0).alias("readers"))
    later = F.exists("readers", lambda r: r["reader"] > F.col("chunk"))
    none = F.struct(F.lit(None).cast("long").alias("reader"), F.lit(1).cast("long").alias("n"))
    read = F.explode(F.when(later, F.col("readers")).otherwise(F.concat("readers", F.array(none)))).alias("r")
    by_reader = bodies.join(readers, ["key", "chunk"]).select("*", F.try_element_at("readers", F.lit(-1)).alias("last"), read)
    each = by_reader.select("*", F.col("r.reader").alias("reader"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.n"))).alias("number"))
    reply = F.when(F.col("reader") == F.col("chunk"), F.try_element_at("replies", F.col("number").cast("int")))
    tail = F.coalesce(F.try_element_at("replies", F.lit(-1))["end"] - F.col("from"), F.lit(0)).cast("int")
    cut = each.withColumn("reply", reply)
    text = (F.when(F.col("reader").isNull(), F.col("body").substr(tail + 1, F.length("body")))
            .when(F.col("reply").isNotNull(), F.col("body").substr(F.lit(1), (F.col("reply.end") - F.col("from")).cast("int"))).otherwise(F.col("body")))
    return cut.select("key", "conv", "chunk", "reader", F.when(F.col("reader").isNotNull(), F.col("number")).alias("number"), text.alias("text"), F.col("from").alias("begin"),
                      F.col("reply.begin").alias("context_chars"), "reply.loss_start", "reply.loss_end",
                      F.coalesce((F.col("reader") == F.col("last.reader")) & (F.col("number") == F.col("last.n")), F.lit(False)).alias("is_last"))


def example_texts(parts: DataFrame) -> DataFrame:
    """Examples as one text each: conv, context_chars, text, loss_start, loss_end in text. Output grows with turns squared; for export."""
    return pieces(parts).where(F.col("reader").isNotNull()).groupBy("key", "conv", "reader", "number").agg(
        F.max("context_chars").alias("context_chars"), _in_order(F.col("chunk"), F.col("text")).alias("text"),
        F.max("loss_start").alias("loss_start"), F.max("loss_end").alias("loss_end")).drop("key", "reader", "number")


def read_back(parts: DataFrame) -> DataFrame:
    """The examples as their text tells them, by pieces: key, conv, chunk, reader, number, turns, loss, chars.

    ``loss`` is the text under an example's mask, in its piece with the reply; ``chars`` the piece's characters, null outside of examples.
    ``turns`` (role and text) are parsed from the last example, which holds those of all others, and from what follows it; else null.
    """
    def turn(shown: Column) -> Column:
        body = shown.substr(F.lit(len(OPEN) + 1), F.length(shown))
        role_end = F.instr(body, MIDDLE)
        return F.struct(unescape(body.substr(F.lit(1), role_end - 1), CODES).alias("role"), unescape(body.substr(role_end + len(MIDDLE), F.length(body))).alias("text"))

    closed = F.split("text", CLOSE)
    turns = F.transform(F.slice(closed, F.lit(1), F.size(closed) - 1), turn)
    masked = F.col("text").substr((F.col("loss_start") - F.col("begin") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return pieces(parts).select("key", "conv", "chunk", "reader", "number", F.when(F.col("reader").isNull() | F.col("is_last"), turns).alias("turns"),
                                unescape(masked).alias("loss"), F.when(F.col("reader").isNotNull(), F.length("text")).alias("chars"))


def digests(read: DataFrame) -> DataFrame:
    """Per conversation: n_turns, SHA-256 over all turns and over all trained text, and the characters of all its examples.

    A digest runs over a conversation in order. What was read is first joined per chunk; chunks then stream, sorted, through a hash that
    holds nothing but its state, whatever the length of a conversation. No turns give no rows.
    """
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    chunks = read.select("key", "conv", "chunk", "number", F.col("reader").isNull().alias("after"), F.size("turns").alias("n"), told.alias("told"), "loss", "chars").groupBy("key", "conv", "chunk").agg(
        F.sum(F.when(F.col("told").isNotNull(), F.col("n"))).alias("n"), _in_order(F.col("after"), F.col("told")).alias("told"),
        _in_order(F.col("number"), F.col("loss")).alias("loss"), F.sum("chars").alias("chars")).fillna(0, ["n", "chars"])
    sorted_chunks = chunks.repartition("key").sortWithinPartitions("key", "chunk")

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for pdf in batches:
            out = []
            for now, n, said, loss, chars in zip(pdf["key"], pdf["n"], pdf["told"], pdf["loss"], pdf["chars"]):
                if now != key:
                    if key is not None:
                        out.append(_row(key, state))
                    key, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[0] += n
                state[1].update(said.encode("utf-8", "surrogatepass"))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += chars
            yield _frame(out)
        if key is not None:
            yield _frame([_row(key, state)])

    return sorted_chunks.select("key", "n", "told", "loss", "chars").mapInPandas(stream, ", ".join(f"{c} {t}" for c, t in COLUMNS))


#: Result of the registered query.
COLUMNS = [("conv_id", "long"), ("n_turns", "long"), ("turns_sha256", "string"), ("loss_chars", "long"), ("loss_sha256", "string"), ("formatted_chars", "long")]


def _row(key: str, state: list) -> tuple:
    return int(key[1:]) if key else None, int(state[0]), state[1].hexdigest(), int(state[2]), state[3].hexdigest(), int(state[4])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype="Int64" if t == "long" else "object") for i, (c, t) in enumerate(COLUMNS)})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(read_back(segments(given.unionByName(spark.createDataFrame(PROBE, given.schema)))))


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
         4 + length(role) + length(regexp_replace(role, '[^\\#<:]', '', 'g')) + 2 + length(text) + length(regexp_replace(text, '[^\\#<]', '', 'g')) + 9 AS chars
  FROM turns),
placed AS (SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY n) AS upto FROM sized)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       coalesce(sum(upto) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
"""
