"""Language detection from character n-grams: profiles are a table, the scorer is a join and a sum.

A text's letters, lower-cased, words parted by one space, are read in grams of
three. A profile has, for each language, the log of a gram's share in it, for
the grams that are frequent in some language; grams outside say nothing. The
language whose logs sum up highest is the text's. Grams are counted and looked
up where their text is, in arrays: none is a row of its own.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_arabic, with_value

UNKNOWN = "unknown"


def _plain(text: Column | str) -> Column:
    """Letters in lower case, words parted by one space, a space at both ends."""
    t = F.col(text) if isinstance(text, str) else text
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(t, F.lit(""))), r"[^\p{L}]+", " ")), F.lit(" "))


def _pieces(batches: Iterator, n: int, most: int = 1 << 20) -> Iterator[tuple]:
    """(batch, letters, at, row) of some `most` characters each: the texts of the last column one behind the other as
    code points, where grams of n begin, and of which row each is. Grams of spaces alone are left out."""
    import numpy as np

    for whole in batches:
        lengths = np.array([len(t) for t in whole.column(whole.num_columns - 1).to_pylist()], np.int64)
        parts = np.flatnonzero(np.diff(np.cumsum(lengths) // most)) + 1
        for a, b in zip(np.r_[0, parts], np.r_[parts, whole.num_rows], strict=True):
            if a == b:
                continue
            batch, size = whole.slice(int(a), int(b - a)), lengths[a:b]
            letters = np.frombuffer("".join(batch.column(batch.num_columns - 1).to_pylist()).encode("utf-32-le"), "<u4")
            many = np.maximum(size - (n - 1), 0)
            row = np.repeat(np.arange(len(size)), many)
            at = np.arange(many.sum()) + np.repeat(np.cumsum(size) - size - (np.cumsum(many) - many), many)
            said = np.logical_or.reduce([letters[at + k] != 32 for k in range(n)]) if len(at) else np.zeros(0, bool)
            yield batch, letters, at[said], row[said]


def gram_counts(labelled: DataFrame, text: str = "text", lang: str = "lang", n: int = 3, most: int = 300_000) -> DataFrame:
    """(lang, gram, c) over all rows that have a language; a task sends a gram once for each `most` different ones."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), _plain(text).alias("t"))
    kind = T.StructType([T.StructField("lang", rows.schema["lang"].dataType), T.StructField("gram", T.StringType()), T.StructField("c", T.LongType())])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            langs, found = zip(*seen, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(langs, lang_kind), pa.array(found, pa.string()), pa.array(list(seen.values()), pa.int64())], ["lang", "gram", "c"])
            seen.clear()
            return out

        for batch, letters, at, row in _pieces(batches, n):
            if not len(at):
                continue
            lang_kind = batch.schema.field(0).type
            langs = pc.unique(batch.column(0))
            chars, number = np.unique(letters, return_inverse=True)
            code, kinds = np.asarray(pc.index_in(batch.column(0), value_set=langs)).astype(np.int64)[row], len(langs)
            for k in range(n):
                if kinds * len(chars) >= 1 << 62:
                    code = np.unique(code, return_inverse=True)[1]
                    kinds = int(code.max()) + 1
                code, kinds = code * len(chars) + number[at + k], kinds * len(chars)
            _, first, c = np.unique(code, return_index=True, return_counts=True)
            own = batch.column(0).take(pa.array(row[first])).to_pylist()
            gram = np.stack([letters[at[first] + k] for k in range(n)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            seen.update({(x, gram[i * n : i * n + n]): int(many) for i, (x, many) in enumerate(zip(own, c, strict=True))})
            if len(seen) > most:
                yield flush()
        if seen:
            yield flush()

    return rows.mapInArrow(run, kind).groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def grams(text: Column | str, n: int = 3) -> Column:
    """Overlapping grams of n characters, repeats included; a text of fewer letters has none. Linear in the text."""
    plain = _plain(text)
    every = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - (n - 1), F.lit(0))), lambda x, i: F.concat(x, *(F.get(c, i + k) for k in range(1, n))))
    return F.filter(with_value(F.split(plain, ""), lambda c: with_value(F.filter(c, lambda x: x != ""), every)), lambda g: F.trim(g) != "")


def profiles(labelled: DataFrame, text: str = "text", lang: str = "lang", n: int = 3, most: int = 2000) -> DataFrame:
    """(gram, <a column a language>): log shares of the grams that are among the `most` frequent of a language.

    Counts cover all rows that have a language. Languages are columns, so they are meant to be few.
    """
    counts = gram_counts(labelled, text, lang, n)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("c").desc(), "gram"))
    kept = counts.withColumn("r", rank).filter(F.col("r") <= most).select("gram").distinct()
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())  # a row a language
    wide = counts.join(kept, "gram").groupBy("gram").pivot("lang", langs).agg(F.sum("c")) if langs else kept
    whole = wide.agg(F.count(F.lit(1)).alias("__kinds"), *(F.sum(F.coalesce(F.col(f"`{x}`"), F.lit(0))).alias(f"__n{k}") for k, x in enumerate(langs)))
    rows = wide.crossJoin(F.broadcast(whole))  # one row
    share = lambda k, x: F.log((F.coalesce(F.col(f"`{x}`"), F.lit(0)) + 0.5) / (F.col(f"__n{k}") + 0.5 * F.col("__kinds")))
    return rows.select("gram", *(share(k, x).alias(x) for k, x in enumerate(langs)))


def detect(df: DataFrame, known: DataFrame, id_col: str, text: str = "text", n: int = 3, out: str = "language") -> DataFrame:
    """(id, language, grams) of each row: 'ar' for Arabic script, else the likeliest of known's languages, 'unknown' where no gram is known.

    known: profiles(), at most `most` rows a language, which is sent to the tasks. Equal sums go to the language that
    comes first. Grams are looked up and summed up within their row's task; nothing is shuffled.
    """
    langs = [c for c in known.columns if c != "gram"]
    table = known.toArrow()  # at most `most` rows a language
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(is_arabic(text), F.lit(False)).alias("ar"), _plain(text).alias("t"))
    kind = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField(out, T.StringType(), False), T.StructField("grams", T.LongType(), False)])

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        named = [g for g in table.column("gram").to_pylist() if len(g) == n]
        spelt = np.frombuffer("".join(named).encode("utf-32-le"), "<u4").reshape(-1, n)
        chars = np.unique(spelt)
        number_of = lambda x: np.searchsorted(chars, x)
        # a gram is found letter by letter: what is known of its beginning and the next letter give a number, 0 where no gram goes on like that
        beginning, steps = np.zeros(len(spelt), np.int64), []
        for k in range(n):
            pairs, inverse = np.unique(beginning * len(chars) + number_of(spelt[:, k]), return_inverse=True)
            steps.append(pairs)
            beginning = inverse.reshape(-1) + 1
        weights = np.zeros((len(named) + 1, len(langs)))
        if langs and named:
            keep = [i for i, g in enumerate(table.column("gram").to_pylist()) if len(g) == n]
            weights[beginning] = np.stack([np.asarray(table.column(x))[keep] for x in langs], axis=1)
        if not len(chars):
            for batch in batches:
                said = ["ar" if x else UNKNOWN for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said), pa.array([0] * len(said), pa.int64())], [id_col, out, "grams"])
            return
        for batch, letters, at, row in _pieces(batches, n):
            every, own = np.unique(letters, return_inverse=True)
            place = np.minimum(number_of(every), len(chars) - 1)
            number = np.where(chars[place] == every, place, -1)[own]
            found = np.zeros(len(at), np.int64)
            for k, pairs in enumerate(steps):
                letter = number[at + k]
                on = np.flatnonzero((letter >= 0) & ((found > 0) | (k == 0)))
                at, row, found, letter = at[on], row[on], found[on], letter[on]
                pair = found * len(chars) + letter
                if pairs[-1] < 1 << 22:
                    direct = np.zeros(int(pairs[-1]) + 2, np.int64)
                    direct[pairs] = np.arange(1, len(pairs) + 1)
                    found = direct[np.minimum(pair, pairs[-1] + 1)]
                else:
                    near = np.minimum(np.searchsorted(pairs, pair), len(pairs) - 1)
                    found = np.where(pairs[near] == pair, near + 1, 0)
            there = found > 0
            found, row = found[there], row[there]
            count = np.bincount(row, minlength=batch.num_rows)
            sums = np.stack([np.bincount(row, weights[found, k], batch.num_rows) for k in range(len(langs))], axis=1) if langs else np.zeros((batch.num_rows, 0))
            best = sums.argmax(axis=1) if langs else np.zeros(batch.num_rows, int)
            said = ["ar" if ar else langs[b] if c and langs else UNKNOWN for ar, c, b in zip(batch.column(1).to_pylist(), count, best, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(said), pa.array(count, pa.int64())], [id_col, out, "grams"])

    return rows.mapInArrow(run, kind)
