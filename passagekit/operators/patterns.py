"""Many patterns at once: an Aho-Corasick automaton over all forms of a question, against whole texts.

functions.text.match_positions asks every word for every form. Here the forms of
a question make one automaton, a text is read once whatever the number of forms,
and the words that a match lies in are what is marked. Words and forms are
normalised by the same built-in expression as there, so the positions are too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_arabic, normalize_clean

#: Between words in the text that the automaton reads; no word holds it, as it is white space.
GAP = "\n"


def plain_words(text: Column | str, normalizer=normalize_clean) -> Column:  # noqa: ANN001
    """A text's words, in the form that they are compared in."""
    t = F.col(text) if isinstance(text, str) else text
    words = F.filter(F.split(t, r"(?U)\s+"), lambda x: x != "")
    plain = F.transform(words, lambda w: normalizer(w))
    return F.when(is_arabic(t), plain).otherwise(words) if normalizer is normalize_clean else plain


def plain_forms(forms: Column, normalizer=normalize_clean) -> Column:  # noqa: ANN001
    """Forms as they are compared, each once, without empty ones."""
    return F.array_distinct(F.filter(F.transform(forms, lambda f: normalizer(f)), lambda f: f != ""))


def automaton(forms):  # noqa: ANN001, ANN201
    """An automaton of the forms, whose values are their lengths; None of no forms."""
    import ahocorasick

    out = ahocorasick.Automaton()
    for f in forms:
        if GAP not in f:  # which no word holds
            out.add_word(f, len(f))
    if not len(out):
        return None
    out.make_automaton()
    return out


def marked(machine, words: list[str]) -> list[int]:  # noqa: ANN001
    """Positions of the words that hold a form; no match reaches over a gap, as no form holds one."""
    if machine is None or not words:
        return []
    text, at, ends, out = GAP.join(words), 0, [], []
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k, last = 0, -1
    for end, _ in machine.iter(text):
        while ends[k] <= end:
            k += 1
        if k != last:
            out.append(k)
            last = k
    return out


def match_positions(rows: DataFrame, text: str, forms: DataFrame, keys: list[str], out: str = "match_indices", normalizer=normalize_clean, few: int = 200_000) -> DataFrame:  # noqa: ANN001
    """rows with out: positions (from 0) of the words that hold any form of the row's keys.

    forms: (keys..., forms): an array of forms a key, one row each. Rows whose
    key has no forms, and null texts, have none marked. Up to `few` forms in all
    go to the tasks, which make an automaton once a key; more are joined to the
    rows, and a task makes an automaton whenever the forms change.
    """
    wanted = forms.select(F.struct(*keys).alias("__key"), plain_forms(F.col("forms"), normalizer).alias("__forms"))
    met = rows.withColumns({"__words": plain_words(text, normalizer), "__key": F.struct(*keys)})
    if (wanted.agg(F.sum(F.size("__forms"))).first()[0] or 0) <= few:
        known = {tuple(r["__key"]): list(r["__forms"]) for r in wanted.collect()}  # few forms

        @F.pandas_udf("array<int>")
        def find(parts: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
            machines: dict[tuple, object] = {}
            for key_of, words_of in parts:
                got = []
                for key, w in zip(key_of.itertuples(index=False, name=None), words_of, strict=True):
                    if key not in machines:
                        machines[key] = automaton(known.get(key, ()))
                    got.append(marked(machines[key], list(w) if w is not None else []))
                yield pd.Series(got, index=words_of.index, dtype=object)

        return met.withColumn(out, find("__key", "__words")).drop("__words", "__key")

    met = met.join(wanted, "__key", "left").sortWithinPartitions("__key")

    @F.pandas_udf("array<int>")
    def find_joined(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        last, machine = None, None
        for forms_of, words_of in parts:
            got = []
            for f, w in zip(forms_of, words_of, strict=True):
                own = tuple(f) if f is not None else ()
                if own != last:
                    last, machine = own, automaton(own)
                got.append(marked(machine, list(w) if w is not None else []))
            yield pd.Series(got, index=forms_of.index, dtype=object)

    return met.withColumn(out, find_joined("__forms", "__words")).drop("__words", "__forms", "__key")
