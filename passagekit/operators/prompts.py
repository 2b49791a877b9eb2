"""Context blocks and messages for a language model, as Columns over gathered passages."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {"ar": "Arabic", "fr": "French", "en": "English"}
#: What stands for an empty context; the layout of blocks below is fixed too.
NOTHING = "(no verse retrieved)"

#: Messages, to be replaced at will: {names} are filled in.
CHAT = "Passages:\n{context}\n\nRefer to nothing but {ids}.\nQuestion: {question}"
LEXICAL = "Describe how the root {root} is used ({count} places; written {forms}).\n\nPassages:\n{context}\n\nRefer to nothing but {ids}. Answer in {language}."


def reference(v: Column) -> Column:
    name = F.coalesce(F.nullif(v["surah_name_en"], F.lit("")), v["surah_name_ar"], F.lit(""))
    return F.concat(F.lit("Surah "), name, F.lit(" ("), v["surah_number"].cast("string"), F.lit("), Verse "), v["ayah_number"].cast("string"), F.lit(" ["), v["id"], F.lit("]"))


def block(v: Column, i: Column) -> Column:
    line = lambda tag, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"    {tag}: "), c))
    head = F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), reference(v))
    return F.concat_ws("\n", head, F.concat(F.lit("    AR: "), F.coalesce(v["text_ar"], F.lit(""))), line("FR", v["translation_fr"]), line("EN", v["translation_en"]))


def context(passages: Column) -> Column:
    """Numbered blocks of an array of passages, parted by blank lines."""
    return F.when(F.size(passages) > 0, F.array_join(F.transform(passages, block), "\n\n")).otherwise(NOTHING)


def ids_of(passages: Column) -> Column:
    """The ids of an array of passages in brackets."""
    return F.coalesce(F.nullif(F.array_join(F.transform(passages, lambda v: F.concat(F.lit("["), v["id"], F.lit("]"))), " "), F.lit("")), F.lit("no passage"))


def filled(template: str, **values: Column) -> Column:
    """template with each {name} replaced by its value; what is in a value is never taken for a name."""
    parts = re.split(r"\{(\w+)\}", template)
    return F.concat(*(values[p] if k % 2 else F.lit(p) for k, p in enumerate(parts)))


def chat_message(question: Column, passages: Column, template: str = CHAT) -> Column:
    return filled(template, question=question, context=context(passages), ids=ids_of(passages))


def lexical_message(root: Column, forms: Column, count: Column, passages: Column, language: Column, template: str = LEXICAL) -> Column:
    names = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    said = F.coalesce(F.try_element_at(names, language), F.lit("Arabic"))
    listed = F.coalesce(F.nullif(F.array_join(forms, " "), F.lit("")), F.lit("in no form"))
    return filled(template, root=root, forms=listed, count=count.cast("string"), context=context(passages), ids=ids_of(passages), language=said)
