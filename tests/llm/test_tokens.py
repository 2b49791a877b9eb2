"""Encoding, token output and packing: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from passagekit.llm.packing import best_fit, improve, pack, pieces
from passagekit.llm.token_output import pack_bin, read_ids, unpack_bin, unpack_block, write_ids
from passagekit.llm.tokens import WordEncoder, default_tokenizer


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_words_encode_like_texts(encode):
    rng = random.Random(1)
    letters = "aAé'\"sStTrRİıß \t\n  ́‍٣½9_-.!@ΣςあÇ<|endoftext|>\x1c\x85ëſƀ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    own = WordEncoder(most_bytes=20_000)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)] == [encode(t) for t in texts]


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_bins_round_trip(planes):
    ids = np.random.default_rng(1).integers(0, 1 << 32, 5003, dtype=np.uint32).astype("<u4").tobytes()
    data = pack_bin([3, None, 9], [5000, 0, 3], ids, planes, block_ids=512)
    assert unpack_bin(data) == ([3, None, 9], [5000, 0, 3], ids)
    assert unpack_block(data, 2) == ids[4 * 1024 : 4 * 1536]
    assert unpack_bin(pack_bin([], [], b"", planes)) == ([], [], b"")
    with pytest.raises(ValueError):
        unpack_bin(b"X" * len(data))


@pytest.mark.parametrize("planes", ["byte", "bit"])
def test_written_ids_come_back(spark, awkward, tmp_path, encode, planes):
    path = f"file://{tmp_path}/ids"
    write_ids(awkward, path, planes=planes, block_ids=256, bin_ids=700)
    got = read_ids(spark, path).collect()
    want = defaultdict(list)
    for r in awkward.collect():
        want[r["doc_id"]].append(np.array([*encode(r["text"]), 1], "<u4").tobytes())
    have, at = defaultdict(list), 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at and r["n_tokens"] == len(r["ids"]) // 4
        at += r["n_tokens"]
        have[r["doc_id"]].append(bytes(r["ids"]))
    ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}


def test_no_documents_no_bins(spark, empty, tmp_path):
    write_ids(empty, f"file://{tmp_path}/ids")
    assert read_ids(spark, f"file://{tmp_path}/ids").count() == 0


def test_local_search_gets_better_and_stays_valid():
    rng = random.Random(3)
    for _ in range(3):
        n = [rng.choice([rng.randint(300, 1100), rng.randint(500, 900)]) for _ in range(800)]
        first = best_fit(n, 2048)
        before, low = len(first), -(-sum(n) // 2048)
        bins = improve([list(b) for b in first], n, 2048)
        assert sorted(i for b in bins for i in b) == list(range(len(n)))
        assert all(sum(n[i] for i in b) <= 2048 for b in bins)
        squares = lambda bs: sum(sum(n[i] for i in b) ** 2 for b in bs)
        assert low <= len(bins) <= before and squares(bins) >= squares(first)


def test_local_search_empties_a_bin():
    n = [6, 3, 5, 4, 2, 4]
    assert len(improve([[0, 1], [2, 3], [4, 5]], n, 12)) == 2


@pytest.mark.parametrize("name", ["awkward", "clashing"])
def test_pieces_and_places(request, encode, name):
    df = request.getfixturevalue(name)
    cut = pieces(df, capacity=64)
    out = pack(cut.withColumn("crc", F.crc32("ids")).drop("ids"), 64, group_rows=50).collect()
    want = defaultdict(int)
    for r in df.collect():
        ids = np.array([*encode(r["text"]), 0], "<u4")
        for p in range(-(-len(ids) // 64)):
            own = ids[64 * p : 64 * p + 64]
            want[r["doc_id"], p, 64 * p, len(own), zlib.crc32(own.tobytes())] += 1
    have, places = defaultdict(int), defaultdict(list)
    for r in out:
        have[r["doc_id"], r["piece"], r["start"], r["length"], r["crc"]] += 1
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    assert have == want
    for x in places.values():
        at = 0
        for off, n in sorted(x):
            assert off == at
            at += n
        assert at <= 64


def test_pack_empty(empty):
    assert pack(pieces(empty).drop("ids")).count() == 0


def test_local_search_beats_best_fit_where_it_leaves_gaps():
    rng = random.Random(1)
    for low, high, least in ((400, 1100, 40), (500, 900, 120)):
        n = [rng.randint(low, high) for _ in range(8192)]
        first = best_fit(n, 2048)
        assert len(first) - len(improve([list(b) for b in first], n, 2048)) >= least


@pytest.mark.parametrize(("low", "high", "at_most"), [(400, 1100, 3115), (500, 900, 2967), (1, 2048, 4200)])
def test_every_exchange_raises_the_sum_of_squares(low, high, at_most):
    import random

    rng = random.Random(1)
    lengths = [rng.randint(low, high) for _ in range(8192)]
    start, trace = best_fit(lengths, 2048), []
    out = improve([list(b) for b in start], lengths, 2048, trace)
    assert trace and all((a + g) ** 2 + (c - g) ** 2 > a * a + c * c and a >= c and g > 0 for a, c, g in trace)
    square = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert square(out) - square(start) == sum((a + g) ** 2 + (c - g) ** 2 - a * a - c * c for a, c, g in trace)
    assert sorted(i for b in out for i in b) == list(range(8192)) and len(out) <= min(len(start), at_most)
