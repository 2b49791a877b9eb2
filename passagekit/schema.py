"""Schemas of the record, its sources and the stores."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()


def _of(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: The fact table: one row per verse; empty strings stand for what is missing.
PASSAGE = _of(
    id=_S, surah_number=_I, surah_name_ar=_S, surah_name_fr=_S, surah_name_en=_S, ayah_number=_I, text_ar=_S, text_ar_clean=_S,
    translation_fr=_S, translation_en=_S, transliteration=_S, period=_S, juz=_I, themes=T.ArrayType(_S), roots=T.ArrayType(_S),
)
RAW_CSV = _of(num_soura=_S, num_aya=_S, aya=_S, name_soura=_S)
SEGMENT = _of(verse_id=_S, form=_S, root=_S, lemma=_S)
ROOT_INDEX = _of(root=_S, forms_found=T.ArrayType(_S), verses=T.ArrayType(_S), count=_L)
RESOLUTION = _of(key=_S, roots=T.ArrayType(_S))
VECTOR = _of(id=_L, vector=T.ArrayType(T.FloatType()))
MESSAGE = _of(session_id=_S, idx=_L, role=_S, content=_S, sources=_S, created_at=_D)
FEEDBACK = _of(session_id=_S, message_index=_L, rating=_S, question=_S, answer=_S, created_at=_D)
#: A source as stored with a message; unknown keys are dropped.
SOURCE = T.ArrayType(_of(id=_S, surah_number=_I, ayah_number=_I, text_ar=_S, relevance_score=_D))

PAYLOAD = ("id", "surah_number", "surah_name_ar", "surah_name_fr", "surah_name_en", "ayah_number", "text_ar", "text_ar_clean", "translation_fr", "translation_en", "period", "juz")
HIT = ("id", "surah_number", "ayah_number", "surah_name_en", "text_ar", "translation_fr", "translation_en", "period")
