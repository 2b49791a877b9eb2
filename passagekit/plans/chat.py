"""From passages to a model: the client's protocol, answers, analyses."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.bm25 import Bm25Index
from ..operators.prompts import chat_message, lexical_message
from . import retrieval


class Client(Protocol):
    """A language model: a system text and messages to an answer."""

    def chat(self, system: str, messages: list[dict]) -> str: ...


class Extractive:
    """The stand-in where no model is at hand: the context's first reference line."""

    def chat(self, system: str, messages: list[dict]) -> str:
        lines = messages[-1]["content"].split("\n")
        return next((x for x in lines if x.startswith("[1] ")), "")


SYSTEM = "You explain passages. Say so where they don't answer the question."


def answers(df: DataFrame, message: Column, make: Callable[[], Client] = Extractive, system: str = SYSTEM, out: str = "answer", history: Column | None = None) -> DataFrame:
    """df with the model's answer to each message; the client is built once per task.

    history: earlier messages, an array of (role, content), which go before it. A null message gets no answer.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series, before: pd.Series) -> pd.Series:
        client = make()
        past = ([{"role": m["role"], "content": m["content"]} for m in b] if b is not None else [] for b in before)
        said = [None if t is None else client.chat(system, [*p, {"role": "user", "content": t}]) for t, p in zip(texts, past, strict=True)]
        return pd.Series(said, index=texts.index, dtype=object)

    none = F.array().cast("array<struct<role:string,content:string>>")
    return df.withColumn(out, run(message, none if history is None else history))


def chat(questions: DataFrame, passages: DataFrame, qid: str = "qid", order: str = "ord", make: Callable[[], Client] = Extractive, history: DataFrame | None = None, system: str = SYSTEM, **template: str) -> DataFrame:
    """(qid, question, message, answer, sources): each question over its passages in order.

    history: (qid, idx, role, content), the earlier messages of a question's conversation.
    """
    cols = [c for c in passages.columns if c not in (qid, order)]
    got = passages.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct(order, F.struct(*cols).alias("v")))).alias("p"))
    got = got.select(qid, F.transform("p", lambda x: x["v"]).alias("sources"))
    rows = questions.join(got, qid, "left")
    rows = rows.withColumn("message", chat_message(F.col("question"), F.coalesce("sources", F.array().cast(got.schema["sources"].dataType)), **template))
    if history is None:
        return answers(rows, F.col("message"), make, system)
    past = history.groupBy(qid).agg(F.array_sort(F.collect_list(F.struct("idx", "role", "content"))).alias("__h"))
    rows = rows.join(past.select(qid, F.transform("__h", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"))).alias("__h")), qid, "left")
    return answers(rows, F.col("message"), make, system, history=F.col("__h")).drop("__h")


def converse(
    questions: DataFrame,
    records: DataFrame,
    index: Bm25Index,
    dense: retrieval.Dense,
    roots: DataFrame | None = None,
    segments: DataFrame | None = None,
    filters: dict | None = None,
    hypothesis: Column | None = None,
    history: DataFrame | None = None,
    k: int = 5,
    window: int = 1,
    make: Callable[[], Client] = Extractive,
    scorer: Callable[[Column, Column], Column] | None = None,
    keep: Callable[[DataFrame], DataFrame] = lambda t: t,
) -> DataFrame:
    """(qid, question, message, answer, sources, hits): retrieval and answer for a table of questions (qid, question).

    Questions are processed; the retrieval query is the question with its expansion terms and, where there is one
    (null: none), a hypothetical passage. A period that a question names filters its hits, dense ones before their
    limit, unless filters has a period. The hits' neighbours within window are the passages; the model answers the
    question itself, after the history (qid, idx, role, content).
    """
    asked = retrieval.process_queries(questions.select("qid", F.col("question").alias("text")), roots, segments)
    query = retrieval.retrieval_query(F.col("original"), F.col("expanded_terms"), hypothesis)
    asked = keep(asked.select("qid", "period", query.alias("query")))
    hits = keep(retrieval.retrieve(asked, records, index, dense, filters, "period", k, scorer, keep=keep).select("qid", "id", "score", "rank"))
    passages = retrieval.retrieve_with_context(hits, records, window=window)
    out = chat(questions, passages, make=make, history=history)
    listed = hits.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("hits"))
    return out.join(listed, "qid", "left")


def analyse(found: DataFrame, language: Column, most_key: int | None = 12, make: Callable[[], Client] = Extractive) -> DataFrame:
    """Lexical results with message, answer, key_verses (the first most_key; None: all that were sampled) and found.

    A root without places is not found: it gets no message to the model, an empty answer and no verses.
    """
    there = F.coalesce(F.col("occurrences_count"), F.lit(0)) > 0
    message = lexical_message(F.col("root"), F.col("forms"), F.col("occurrences_count"), F.col("verses"), language)
    key = F.col("verses") if most_key is None else F.slice("verses", 1, most_key)
    rows = found.withColumns({"message": F.when(there, message), "key_verses": F.when(there, key), "found": there})
    return answers(rows, F.col("message"), make).withColumn("answer", F.coalesce("answer", F.lit("")))
