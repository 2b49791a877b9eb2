"""Sharding, mixing and exact dedup against brute force."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from passagekit.llm.common import Scratch
from passagekit.llm.exact_dedup import drop_exact_copies, exact_groups
from passagekit.llm.mixing import mix
from passagekit.llm.sharding import shard, splitters


def no_python(df):
    return not re.search("Python|Pandas|Arrow", df._jdf.queryExecution().executedPlan().toString())


# --- sharding
@pytest.mark.parametrize(("name", "task_bytes"), [("awkward", 256 << 20), ("clashing", 256 << 20), ("awkward", 5000)])
def test_shards_are_even_and_gapless(request, name, task_bytes):
    """task_bytes 5000: the exchange gets more partitions than the session's."""
    df = request.getfixturevalue(name)
    out = shard(df, 4, piece_bytes=2000, task_bytes=task_bytes)
    rows = out.select("doc_id", F.col("size"), "shard", "slot", "text").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in rows)
    sizes, slots = defaultdict(int), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    most = max(r["size"] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 2 * most
    assert no_python(out)


def test_splitters_against_a_sort(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice([5, 5, 5, rng.randint(0, 1 << 62)]), rng.randint(0, 1 << 62), rng.randint(1, 100)) for _ in range(3000)]
    cuts = splitters(spark.createDataFrame(rows, "key long, tie long, size long"), 8)
    total = sum(r[2] for r in rows)
    for k, cut in enumerate(cuts, 1):
        below = sum(s for key, tie, s in rows if (key, tie) < cut)
        assert abs(below - total * k / 8) <= 100  # a hot key is split inside


def test_hot_text_is_spread(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "hot text").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    sizes = [r["s"] for r in shard(df, 6).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 6 and max(sizes) <= 1.02 * min(sizes)


def test_shard_empty(empty):
    assert shard(empty, 4).count() == 0


# --- mixing
def fill(sizes, weights, cap):
    """Targets by repeated clamping."""
    left, out, free = float(sum(sizes.values())), {}, set(sizes)
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > cap * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / w for s in free}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("name", ["awkward", "clashing"])
def test_mix_targets_and_words(request, name):
    df = request.getfixturevalue(name)
    out = mix(df)
    rows = out.select("doc_id", "source", "text", "size", "source_size", "target", "taken", "repeats").collect()
    assert len(rows) == df.count()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        assert r["size"] == words(r["text"]) and r["taken"] == r["size"] * r["repeats"] <= 3 * r["size"]
        sizes[r["source"]] += r["size"]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    want = fill(sizes, {s: 1 + k % 3 for k, s in enumerate(order)}, 3)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] += r["taken"]
    assert no_python(out)
    assert sorted(map(str, rows)) == sorted(map(str, mix(df).select(*rows[0].__fields__).collect()))


def test_mix_meets_targets(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 7).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int") + 1).alias("text"))
    got = mix(df).groupBy("source").agg(F.max("target").alias("t"), F.sum("taken").alias("k")).collect()
    assert all(abs(r["k"] - r["t"]) <= 1 for r in got)


def test_mix_clamps(spark):
    df = spark.createDataFrame([(1, "a", "w " * 900), (2, "b", "w " * 10), (3, None, "w " * 10)], "doc_id long, source string, text string")
    got = {r["source"]: (r["target"], r["taken"]) for r in mix(df).collect()}
    assert got["b"] == (30, 30) and got[None] == (30, 30) and got["a"][0] == 860


def test_mix_takes_documents_without_words_no_more_often(spark):
    """At its cap a source is taken max_epochs times, whatever stands before the first word in the order."""
    rows = [(k, "small", "w " * 3 if k % 4 == 0 else " ") for k in range(200)] + [(1000 + k, "large", "w " * 90) for k in range(40)] + [(2000, "none", "")]
    got = mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    assert {r["repeats"] for r in got if r["source"] == "small"} == {3} and {r["repeats"] for r in got if r["source"] == "none"} == {0}
    assert max(r["repeats"] for r in got) == 3


def test_mix_empty(empty):
    assert mix(empty).count() == 0


# --- exact dedup
def brute(df):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    rows = [(r["doc_id"], norm(r["text"])) for r in df.select("doc_id", "text").collect()]
    size, keep = Counter(t for _, t in rows), {}
    for d, t in rows:
        if d is not None and (keep.get(t) is None or d < keep[t]):
            keep[t] = d
        keep.setdefault(t, None)
    return Counter((d, keep[t], size[t]) for d, t in rows), len(size)


@pytest.mark.parametrize("block", [7, 4096])
def test_exact_groups(awkward, block):
    got = exact_groups(awkward, block_bytes=block).collect()
    want, kinds = brute(awkward)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == kinds


def test_names_do_not_collide_under_a_poor_hash(awkward):
    got = exact_groups(awkward, block_bytes=16, block_hash=lambda b: (F.octet_length(b) % 3).cast("long")).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"]) for r in got) == brute(awkward)[0]


def test_exact_dedup_native_and_clashing(clashing, empty):
    out = exact_groups(clashing)
    assert no_python(out) and out.count() == clashing.count()
    kept = drop_exact_copies(clashing)
    assert kept.columns == clashing.columns and kept.count() == brute(clashing)[1]
    assert exact_groups(empty).count() == 0 and drop_exact_copies(empty).count() == 0


def test_scratch_drops(spark):
    scratch = Scratch(spark, "t")
    df = scratch.put(spark.range(5))
    assert df.count() == 5
    scratch.drop(df)
    with pytest.raises(Exception):
        spark.read.parquet(f"{scratch.root}/0").count()
