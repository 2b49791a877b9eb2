import random

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, copies and near copies."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = prose(200)
    rows = [(k, prose(rng.randint(1, 120)), rng.choice(["aa", "bb"]), f"s{k % 3}", 1) for k in range(60)]
    rows += [(100 + k, base, "aa", "s0", 1) for k in range(25)]
    rows += [(200 + k, base.replace(words[3], words[4]) + f" {words[k]}", "aa", None, 1) for k in range(6)]
    rows += [(300, None, None, None, None), (301, "", "aa", "s1", 0), (302, " \t\n ", "bb", "s1", 3), (303, "  ", None, "s2", 2)]
    rows += [(400, prose(9000), "bb", "s2", 1), (401, "x" * 20000, "bb", "s2", 1), (402, "Ünïcode ß ẞ İ 中文 \x1c end x", "bb", "", 1)]
    rows += [(500, "same row", "aa", "s1", 8)] * 3 + [(501, "same id one", "aa", "s1", 8), (501, "same id two", "aa", "s1", 8)]
    rows += [(None, "no id", "aa", "s1", 5), (None, "no id", "aa", "s1", 5)]
    rows += [(600, "a  b", "aa", "s1", 4), (599, "a b", "aa", "s1", 3), (601, "a\tb", "aa", "s1", 3)]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], KIND)


@pytest.fixture(scope="session")
def clashing(awkward):
    """Columns named like results and like the operators' own."""
    from pyspark.sql import functions as F

    extra = ("size", "shard", "slot", "repeats", "taken", "target", "source_size", "sequence_id", "length", "score", "h", "u", "t", "fp", "key", "doc", "i", "y")
    return awkward.withColumns({c: F.lit("clash") for c in extra})
