"""Text as Columns: normalisation profiles, tokens, stems, detection, ids, highlights.

Every function is built from Spark's own expressions. The profiles compose the
letters and marks of the Arabic block by expression; nfc(), a Pandas UDF, does
so for all of Unicode and is applied once, at ingestion.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values -----------------------------------------------------------
#: Marks stripped by every profile, the stretching sign, annotation marks.
TASHKEEL = r"[ؐ-ًؚ-ٰٟ]"
TATWEEL = "ـ"
ANNOTATION = r"[ۖ-ۭ]"
#: Bytes of texts that a task has as words at once.
_AT_ONCE = 4_000_000
#: White space of any script.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Hamza carriers and what they fold to.
HAMZA_FROM, HAMZA_TO = "أإآٱؤئ", "ااااوي"
#: The folds of the clean text, and of its profile "fold".
CLEAN_FROM, CLEAN_TO = "أإآٱىؤئء", "اااايوي"
FOLD_FROM, FOLD_TO = "أإؤئ", "ءءءء"
#: The last folds of search.
SEARCH_FROM, SEARCH_TO = "ىة", "يه"
ARABIC_LETTERS = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
STEM_PREFIXES = ("وال", "فال", "بال", "كال", "ال", "و", "ف", "ب", "ك", "ل", "س")
STEM_SUFFIXES = ("ون", "ين", "ان", "ات", "ة", "ها", "هم", "هن", "كم", "كن", "نا", "ني", "ه", "ي", "ك", "وا", "ت", "ن")
CLITIC_PREFIXES = ("وال", "فال", "بال", "كال", "ال", "لل", "و", "ف", "ب", "ك", "ل", "س")
CLITIC_SUFFIXES = ("هما", "كما", "هم", "هن", "كم", "كن", "نا", "ني", "ها", "ه", "ك", "ي")
STOP_WORDS = (
    "و", "ف", "ب", "ك", "ل", "ال", "لل", "لما", "ما", "من", "في", "على", "إلى", "عن",
    "إن", "أن", "أنه", "إنه", "لا", "لم", "لن", "قد", "ثم", "أو", "أم", "بل", "لكن", "حتى",
    "إذا", "إذ", "كي", "لكي", "لو", "لولا", "هل", "يا", "إلا", "مع", "كما", "هو", "هي", "هم",
    "هن", "هما", "أنت", "أنا", "نحن", "أنتم", "هذا", "هذه", "ذلك", "تلك", "الذي", "التي", "الذين", "كل",
    "بعض", "غير", "عند", "بين", "لدى", "نحو", "قبل", "بعد", "دون",
)
#: Common words of languages, which tell them apart where no detector is at hand.
COMMON_WORDS = {
    "en": ("the", "of", "and", "to", "in"),
    "fr": ("le", "la", "de", "et", "les"),
    "de": ("der", "die", "und", "in", "den"),
    "es": ("el", "la", "de", "y", "los"),
}
MECCAN, MEDINAN = ("makki", "mecquoise", "meccan", "مكي"), ("madani", "médinoise", "medinan", "مدني")
#: Where each of the thirty parts begins: (chapter, verse).
PART_STARTS = (
    (1, 1), (2, 142), (2, 253), (3, 93), (4, 24), (4, 148), (5, 82), (6, 111), (7, 88), (8, 41),
    (9, 93), (11, 6), (12, 53), (15, 1), (17, 1), (18, 75), (21, 1), (23, 1), (25, 21), (27, 56),
    (29, 46), (33, 31), (36, 28), (39, 32), (41, 47), (46, 1), (51, 31), (58, 1), (67, 1), (78, 1),
)
MEDINAN_CHAPTERS = (2, 3, 4, 5, 8, 9, 13, 22, 24, 33, 47, 48, 49, 55, 57, 58, 59, 60, 61, 62, 63, 64, 65, 66, 76, 98, 99, 110)
# ----------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(T.StringType())
def nfc(texts: pd.Series) -> pd.Series:
    """Unicode composition; null stays null."""
    return texts.map(lambda s: s if s is None or s.isascii() else unicodedata.normalize("NFC", s))


#: Combining classes of the marks of the Arabic block, by rule: what Unicode says of each.
_CLASSES = {chr(k): unicodedata.combining(chr(k)) for k in range(0x600, 0x700) if unicodedata.combining(chr(k))}
#: Its letters that are a letter and a mark: {letter: the two}.
_PARTS = {chr(k): "".join(chr(int(x, 16)) for x in unicodedata.decomposition(chr(k)).split()) for k in range(0x600, 0x700) if unicodedata.decomposition(chr(k))[:1] not in ("", "<")}
_MARKS = "[" + "".join(_CLASSES) + "]"


def composed(c: Column | str) -> Column:
    """Letters and marks of the Arabic block in composed form, as NFC has them; other characters stay as they are.

    Composed letters are taken apart, the marks that follow a letter sorted by their class, and put together again: a
    mark joins its letter where they make one and no mark of its own class stands between.
    """
    t = _col(c)
    apart = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _PARTS.items(), t)
    lookup = lambda table: F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    class_of, whole = lookup(_CLASSES), lookup({v: k for k, v in _PARTS.items()})

    def joined(now: Column, m: Column) -> Column:
        made = F.try_element_at(whole, F.concat(now["letter"], m["mark"]))
        fits = made.isNotNull() & (now["last"] < m["class"])
        return F.struct(F.when(fits, made).otherwise(now["letter"]).alias("letter"), F.when(fits, now["rest"]).otherwise(F.concat(now["rest"], m["mark"])).alias("rest"), F.when(fits, now["last"]).otherwise(m["class"]).alias("last"))

    def cluster(part: Column) -> Column:
        plain = F.regexp_replace(part, f"{_MARKS}+$", "")
        marks = F.filter(F.split(F.substr(part, F.length(plain) + 1), ""), lambda m: m != "")
        order = F.sort_array(F.transform(marks, lambda m, i: F.struct(F.element_at(class_of, m).alias("class"), i.alias("i"), m.alias("mark"))))
        start = F.struct(F.right(plain, F.lit(1)).alias("letter"), F.lit("").alias("rest"), F.lit(0).alias("last"))
        end = F.aggregate(order, start, joined, lambda x: F.concat(x["letter"], x["rest"]))
        return F.when(part == plain, part).otherwise(F.concat(F.left(plain, F.length(plain) - 1), end))

    parts = F.transform(F.regexp_extract_all(apart, F.lit(f"[^{_MARKS[1:-1]}]*{_MARKS}*"), F.lit(0)), cluster)
    return F.when(F.rlike(t, F.lit(_MARKS)), F.array_join(parts, "")).otherwise(t)


def trimmed(c: Column | str) -> Column:
    """White space of any script taken off both ends."""
    return F.regexp_replace(_col(c), r"(?U)^\s+|\s+$", "")


def collapsed(c: Column | str) -> Column:
    return F.regexp_replace(trimmed(c), r"(?U)\s+", " ")


def _bare(c: Column | str) -> Column:
    return F.replace(F.regexp_replace(composed(c), TASHKEEL, ""), F.lit(TATWEEL), F.lit(""))


def normalize_clean(c: Column | str, profile: str = "delete") -> Column:
    """The clean text: marks off, letters folded, white space collapsed.

    profile "delete" drops every hamza that is left; "fold" first turns all
    hamza carriers into the bare hamza, as one of the common libraries does.
    """
    if profile not in ("delete", "fold"):
        raise ValueError(f"unknown profile {profile!r}")
    t = _bare(c)
    if profile == "fold":
        t = F.translate(t, FOLD_FROM, FOLD_TO)
    t = F.translate(t, CLEAN_FROM, CLEAN_TO)
    return collapsed(t)


def normalize_root(c: Column | str) -> Column:
    """The hamza-safe fold of roots and words: carriers fold, the bare hamza stays."""
    return trimmed(F.translate(_bare(c), HAMZA_FROM, HAMZA_TO))


def normalize_search(c: Column | str) -> Column:
    """normalize_root, then annotation marks off and the last folds of search."""
    return F.translate(F.regexp_replace(normalize_root(c), ANNOTATION, ""), SEARCH_FROM, SEARCH_TO)


def tokens(c: Column | str, normalizer=normalize_search) -> Column:  # noqa: ANN001
    """Lower-cased words between white space of any script, empties dropped; null: none.

    The folds of normalize_search touch Arabic script alone, so texts without any are only trimmed.
    """
    t = F.lower(trimmed(_folded(c, normalizer)))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, r"(?U)\s+"))


def _folded(c: Column | str, normalizer) -> Column:  # noqa: ANN001
    text = F.coalesce(_col(c), F.lit(""))
    return F.when(is_arabic(text), normalizer(text)).otherwise(text) if normalizer is normalize_search else normalizer(text)


def words_in_tasks(df: DataFrame, own: list[Column], text: Column, make, columns: dict[str, str], normalizer=normalize_search) -> DataFrame:  # noqa: ANN001
    """Columns of df and more (name: type), which make()(words) gives for tokens(text) of a row as values: for steps that are slow as expressions.

    make is called once a task; rows go to workers with their folded texts and stay where they are.
    """
    like = df.select(*own).schema
    kept = like.names

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        each, split = make(), _splitter()
        for whole in batches:
            some = max(1, _AT_ONCE * whole.num_rows // max(1, whole.column(len(kept)).nbytes))
            for i in range(0, whole.num_rows, some):  # words take many times their texts' memory
                batch = whole.slice(i, some)
                found = each(map(split, batch.column(len(kept)).to_pylist()))
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(kept))), *found], [*kept, *columns])

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in like.fields), *(f"`{n}` {t}" for n, t in columns.items())])
    return df.select(*own, F.lower(_folded(text, normalizer)).alias("__text")).mapInArrow(run, kind)


def _splitter() -> Callable[[str], list[str]]:
    """The words of a lower-case folded text, as tokens() has them."""
    odd, space = re.compile("[\x1c-\x1f]"), re.compile("[\\t-\\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    # str.split() takes four control characters for white space that (?U)\s does not
    return lambda t: t.split() if not odd.search(t) else [w for w in space.split(t) if w]


def different_words(df: DataFrame, text: Column, normalizer=normalize_search, most: int = 200_000) -> DataFrame:  # noqa: ANN001
    """(word): the words of all texts, those that a task meets again within some `most` different ones only once."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        split, seen, new = _splitter(), set(), set()
        give = lambda ws: pa.RecordBatch.from_arrays([pa.array(list(ws), pa.string())], ["word"])
        for batch in batches:
            for t in batch.column(0).to_pylist():
                new.update(split(t))
                if len(new) > most:
                    yield give(new - seen)
                    seen, new = new, set()
        yield give(new - seen)

    return df.select(F.lower(_folded(text, normalizer)).alias("__text")).mapInArrow(run, "word string")


def lister(change: Callable[[str], str], different: bool = True, most: int = 500_000) -> Callable:
    """For words_in_tasks(): change's results for the words of each row; the different ones without empty ones, or one a word in their order.

    change is asked once a word of a task.
    """

    def make() -> Callable:
        import pyarrow as pa

        class Known(dict):
            def __missing__(self, w: str) -> str:
                return self.setdefault(w, change(w))

        known = Known()

        def run(rows: Iterator) -> tuple:
            ends, out = [0], []
            for words in rows:
                own = map(known.__getitem__, set(words) if different else words)
                out += (w for w in set(own) if w) if different else own
                ends.append(len(out))
                if len(known) > most:
                    known.clear()
            return (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, pa.string())),)

        return run

    return make


def index_text(*cols: str) -> Column:
    """The non-empty columns joined by a space."""
    return F.concat_ws(" ", *(F.nullif(F.col(c), F.lit("")) for c in cols))


def passage_text(*cols: str) -> Column:
    return F.concat(F.lit("passage: "), index_text(*cols))


def query_text(c: Column | str) -> Column:
    return F.concat(F.lit("query: "), _col(c))


def first_filled(*cols: str) -> Column:
    return F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in cols), F.lit(""))


def with_value(value: Column, use) -> Column:  # noqa: ANN001
    """use(value), with value worked out once a row however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def without_stop_words(words: Column, stop: tuple[str, ...] | list[str] | None = None) -> Column:
    """Words that are not in the stop list, both normalised for search."""
    stop = STOP_WORDS if stop is None else stop
    folded = F.transform(F.array(*(F.lit(s) for s in stop)).cast("array<string>"), lambda s: normalize_search(s))
    return with_value(folded, lambda st: F.filter(words, lambda w: ~F.array_contains(st, w)))


def heuristic_stem(
    c: Column | str,
    letters: str = ARABIC_LETTERS,
    prefixes: tuple[str, ...] = STEM_PREFIXES,
    suffixes: tuple[str, ...] = STEM_SUFFIXES,
    least: int = 3,
) -> Column:
    """Valid letters only, one prefix and one suffix off, the rest joined by hyphens.

    The first prefix of the list that leaves `least` letters goes; of suffixes
    that end alike, the longest that leaves as many.
    """
    return hyphenated(affixes_off(F.regexp_replace(_col(c), f"[^{letters}]", ""), prefixes, suffixes, least))


def hyphenated(c: Column | str) -> Column:
    """Letters joined by hyphens."""
    return F.regexp_replace(_col(c), "(?<=.)(?=.)", "-")


def prefix_off(w: Column, prefixes: tuple[str, ...] = STEM_PREFIXES, least: int = 3) -> Column:
    """w without the first prefix of the list that leaves `least` letters."""
    fits = lambda p: F.startswith(w, F.lit(p)) & (F.length(w) >= len(p) + least)
    return reduce(lambda out, p: F.when(fits(p), F.substr(w, F.lit(len(p) + 1))).otherwise(out), reversed(prefixes), w)


def suffix_off(w: Column, suffixes: tuple[str, ...] = STEM_SUFFIXES, least: int = 3) -> Column:
    """w without the longest suffix that leaves `least` letters."""
    fits = lambda s: F.endswith(w, F.lit(s)) & (F.length(w) >= len(s) + least)
    return reduce(lambda out, s: F.when(fits(s), F.left(w, F.length(w) - len(s))).otherwise(out), sorted(suffixes, key=len), w)


def affixes_off(c: Column | str, prefixes: tuple[str, ...] = STEM_PREFIXES, suffixes: tuple[str, ...] = STEM_SUFFIXES, least: int = 3) -> Column:
    """heuristic_stem() of a word that is letters alone, not joined by hyphens."""
    return with_value(_col(c), lambda w: with_value(prefix_off(w, prefixes, least), lambda x: suffix_off(x, suffixes, least)))


def stem_steps(letters: str | None = ARABIC_LETTERS, prefixes: tuple[str, ...] = STEM_PREFIXES, suffixes: tuple[str, ...] = STEM_SUFFIXES, least: int = 3) -> tuple:
    """heuristic_stem() without its hyphens as steps for a projection each, which compiles where affixes_off() is interpreted; letters None: words are letters alone."""
    own = () if letters is None else (lambda w: F.regexp_replace(w, f"[^{letters}]", ""),)
    return (*own, lambda w: prefix_off(w, prefixes, least), lambda w: suffix_off(w, suffixes, least))


def in_steps(df: DataFrame, source: str, out: str, steps: tuple) -> DataFrame:
    """df with column `out`: the steps applied to column `source` one after the other."""
    for k, step in enumerate(steps):
        df = df.withColumn(out, step(F.col(source if k == 0 else out)))
    return df


def clitic_candidates(w: Column, prefixes: tuple[str, ...] = CLITIC_PREFIXES, suffixes: tuple[str, ...] = CLITIC_SUFFIXES, least: int = 2) -> Column:
    """Array of (rank, stem) to try in order: the word, then suffixes off, then prefixes off."""
    tries = [F.struct(F.lit(0).alias("rank"), w.alias("stem"))]
    for k, s in enumerate(suffixes, 1):
        fits = F.endswith(w, F.lit(s)) & (F.length(w) - len(s) >= least)
        tries.append(F.struct(F.lit(k).alias("rank"), F.when(fits, F.substr(w, F.lit(1), F.length(w) - len(s))).alias("stem")))
    for k, p in enumerate(prefixes, 1 + len(suffixes)):
        fits = F.startswith(w, F.lit(p)) & (F.length(w) - len(p) >= least)
        tries.append(F.struct(F.lit(k).alias("rank"), F.when(fits, F.substr(w, F.lit(len(p) + 1))).alias("stem")))
    return F.filter(F.array(*tries), lambda x: x["stem"].isNotNull())


def is_arabic(c: Column | str) -> Column:
    return F.rlike(_col(c), F.lit(r"[؀-ۿ]"))


def detect_period(c: Column | str) -> Column:
    """The period a query names, or null; the Meccan words go first."""
    low = F.lower(_col(c))
    said = lambda words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
    return F.when(said(MECCAN), "makkiyya").when(said(MEDINAN), "madani")


def detect_language(c: Column | str, votes: dict[str, tuple[str, ...]] | None = None) -> Column:
    """ar for Arabic script; else the language with most of its common words there, or unknown.

    A stand-in for a statistical detector, which callers may put in its place.
    """
    votes = votes or COMMON_WORDS
    words = F.split(F.lower(_col(c)), r"\s+")
    hits = lambda common: F.size(F.filter(words, lambda w: w.isin(*common)))
    marks = F.array(*(F.struct(hits(v).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("lang")) for k, (name, v) in enumerate(votes.items())))
    best = F.array_max(marks)
    return F.when(is_arabic(c), "ar").when(best["n"] > 0, best["lang"]).otherwise("unknown")


def part_of(chapter: Column | str, verse: Column | str, starts: tuple[tuple[int, int], ...] = PART_STARTS) -> Column:
    """The number of the last start at or before (chapter, verse), 1 at least."""
    key = _col(chapter) * 1000 + _col(verse)
    keys = F.array(*(F.lit(s * 1000 + a) for s, a in starts))
    return F.greatest(F.lit(1), F.size(F.filter(keys, lambda k: k <= key)))


def period_of(chapter: Column | str, medinan: tuple[int, ...] = MEDINAN_CHAPTERS, last: int = 114) -> Column:
    c = _col(chapter)
    return F.when(c.isin(*medinan), "madani").when(c.between(1, last), "makkiyya").otherwise("")


def passage_id(chapter: Column | str, verse: Column | str) -> Column:
    return F.concat_ws(":", _col(chapter).cast("string"), _col(verse).cast("string"))


def point_id(chapter: Column | str, verse: Column | str) -> Column:
    return _col(chapter).cast("long") * 1000 + _col(verse)


def parse_id(c: Column | str) -> tuple[Column, Column]:
    """(chapter, verse); null where the id is malformed."""
    return parsed_id(F.split(_col(c), ":"))


def parsed_id(parts: Column) -> tuple[Column, Column]:
    """parse_id() of an id split at its colons."""
    ok = F.size(parts) == 2
    return F.when(ok, F.try_element_at(parts, F.lit(1)).try_cast("int")), F.when(ok, F.try_element_at(parts, F.lit(2)).try_cast("int"))


def arabic_digits(c: Column | str) -> Column:
    return F.translate(_col(c).cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")


def even_sample(items: Column, k: int) -> Column:
    """Up to k items spread evenly over an array, in order."""
    n = F.size(items)
    picked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.element_at(items, F.floor(i * (n / F.lit(float(k)))).cast("int") + 1))
    return F.when(n <= k, items).otherwise(picked)


def match_positions(text: Column | str, forms: Column, normalizer=normalize_clean) -> Column:  # noqa: ANN001
    """Positions (from 0) of the words whose normal form contains that of any form."""
    words = F.filter(F.split(_col(text), r"(?U)\s+"), lambda x: x != "")
    plain = F.transform(words, lambda w: normalizer(w))
    if normalizer is normalize_clean:  # whose folds touch Arabic script alone
        plain = F.when(is_arabic(text), plain).otherwise(words)
    wanted = F.filter(F.transform(forms, lambda f: normalizer(f)), lambda f: f != "")
    hits = lambda fs: F.transform(plain, lambda w, i: F.when(F.exists(fs, lambda f: F.contains(w, f)), i))
    return F.filter(with_value(wanted, hits), lambda i: i.isNotNull())


def title_of(c: Column | str, most: int = 48) -> Column:
    """White space collapsed, cut at `most` with an ellipsis."""
    t = collapsed(c)
    return F.when(F.length(t) > most, F.concat(trimmed(F.substring(t, 1, most)), F.lit("…"))).otherwise(t)
