"""Seams for language models: a model is a function from a DataFrame to the same rows with its answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Chat = Callable[[DataFrame], DataFrame]
MESSAGE = "struct<role: string, text: string>"
#: The instruction a classifier of questions gets; it answers with one word.
CLASSIFY = "Decide how hard the question is to answer from a knowledge base. Answer SIMPLE if one look-up is enough, COMPLEX if it takes several, a comparison or a whole document. Question: "


def message(role: str, text: str | Column) -> Column:
    return F.struct(F.lit(role).alias("role"), (F.col(text) if isinstance(text, str) else text).cast("string").alias("text"))


def conversation(*parts: Column) -> Column:
    """Messages (structs) and lists of messages one after the other; null ones are left out."""
    return F.filter(F.concat(*parts), lambda m: m["text"].isNotNull())


def echo(rows: DataFrame) -> DataFrame:
    """Stand-in for a chat model: answers with the number of messages it was given and the last user message."""
    last = F.element_at(F.filter("messages", lambda m: m["role"] == "user"), -1)["text"]
    return rows.withColumn("answer", F.concat(F.lit("["), F.size("messages"), F.lit("] "), last))


def chat(rows: DataFrame, model: Chat = echo) -> DataFrame:
    """Adds the model's ``answer`` to rows with ``messages`` (array of role and text): one call a row."""
    return model(rows)


def reply(rows: DataFrame, model: Chat = echo) -> DataFrame:
    """The answer as one more message of the list, to be passed by hand with the next question."""
    done = chat(rows, model)
    return done.withColumn("messages", F.concat("messages", F.array(message("ai", "answer"))))


def stream(rows: DataFrame, key: str, size: int = 8, model: Chat = echo) -> DataFrame:
    """The answer in parts, as a streaming model gives it: key, part, delta."""
    n = F.greatest(F.ceil(F.length("answer") / size).cast("int"), F.lit(1))
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col("answer"), i * size + 1, F.lit(size)))
    return chat(rows, model).select(key, F.posexplode(parts).alias("part", "delta"))


def classifier(model: Chat) -> Chat:
    """A classifier for `routing.decide` from a chat model: answer is what it says to the instruction with the question, failed
    whether the model left the mark of an error (column ``error``)."""

    def ask(rows: DataFrame) -> DataFrame:
        done = model(rows.withColumn("messages", F.array(message("user", F.concat(F.lit(CLASSIFY), F.trim("text"))))))
        failed = F.col("error").isNotNull() if "error" in done.columns else F.lit(False)
        return done.withColumn("failed", failed).drop("messages", "error")

    return ask
