"""Models as hooks: made once a task, called with batches, with what failed told a row and not a job.

A model is whatever `make` returns: a function from a list of inputs (tuples, one
value a column) to a list of results. A batch that fails is gone through row by
row, so one bad row costs its own result alone. A model that can't be made, or
`make` that returns None, gives no results and the reason; what then stays is up
to the caller: an order kept, a question left as it is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rerank

Make = Callable[[], Callable[[list[tuple]], list] | None]


def applied(df: DataFrame, inputs: list[Column], make: Make, kind: str, out: str, batch: int = 32) -> DataFrame:
    """df with out: a struct of value (of type kind; null where it failed) and error (null where it didn't).

    Rows of which an input is null get neither: nothing is asked.
    """

    @F.pandas_udf(f"value {kind}, error string")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, why = None, "no model"
        try:
            model = make()
        except Exception as e:  # noqa: BLE001  a hook's own failure, which is told a row
            why = f"{type(e).__name__}: {e}"
        for part in parts:
            rows = list(part.itertuples(index=False, name=None))
            there = [k for k, r in enumerate(rows) if not any(v is None or v != v for v in r)]
            value, error = [None] * len(rows), [None] * len(rows)
            for i in range(0, len(there), batch):
                some = there[i : i + batch]
                if model is None:
                    for k in some:
                        error[k] = why
                    continue
                try:
                    got = list(model([rows[k] for k in some]))
                    if len(got) != len(some):
                        raise ValueError(f"{len(got)} results for {len(some)} rows")
                    for k, v in zip(some, got, strict=True):
                        value[k] = v
                except Exception:  # noqa: BLE001
                    for k in some:
                        try:
                            (value[k],) = model([rows[k]])
                        except Exception as e:  # noqa: BLE001
                            error[k] = f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"value": pd.Series(value, index=part.index, dtype=object), "error": pd.Series(error, index=part.index, dtype=object)})

    return df.withColumn(out, run(F.struct(*(c.alias(f"c{k}") for k, c in enumerate(inputs)))))


def rerank_with(pool: DataFrame, query: Column, passage: Column, make: Make, k: int | None = None, qid: str = "qid", pos: str = "pos", batch: int = 32) -> DataFrame:
    """pool re-ranked by a model of (question, passage) pairs: rerank_score, rerank_rank and rerank_error.

    Questions of which a pair could not be scored keep the pool's order, scores null, so that scored and unscored rows
    are never mixed.
    """
    rows = applied(pool, [query, passage], make, "double", "__hook", batch)
    whole = F.count("__hook.value").over(rerank.Window.partitionBy(qid)) == F.count(F.lit(1)).over(rerank.Window.partitionBy(qid))
    rows = rows.withColumns({"__score": F.when(whole, F.col("__hook.value")), "rerank_error": F.col("__hook.error")}).drop("__hook")
    return rerank.rerank(rows, F.col("__score"), k, qid, pos).drop("__score")


def hypotheses(questions: DataFrame, question: Column, make: Make, out: str = "hypothesis", batch: int = 32) -> DataFrame:
    """questions with a hypothetical passage (null where none could be written, so that the question stands alone) and <out>_error."""
    rows = applied(questions, [question], make, "string", "__hook", batch)
    return rows.withColumns({out: F.nullif(F.trim(F.col("__hook.value")), F.lit("")), f"{out}_error": F.col("__hook.error")}).drop("__hook")


def stems(words: DataFrame, word: str, make: Make, out: str = "stem", batch: int = 1024) -> DataFrame:
    """(word, stem) of the different words of a column, stemmed once each; '' where the stemmer fails."""
    own = applied(words.select(word).filter(F.col(word).isNotNull()).distinct(), [F.col(word)], make, "string", "__hook", batch)
    return own.select(word, F.coalesce("__hook.value", F.lit("")).alias(out))
