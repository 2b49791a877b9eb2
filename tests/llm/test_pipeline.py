"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import re
from collections import Counter

import pytest
from test_native import fill
from test_similarity import least_ids

import corpus_pipeline
from passagekit.llm.toxicity import train, training_labels


def expected(spark, sf, name, rows):
    """Ids that a filtering stage keeps of rows (doc_id, text)."""
    if name == "toxicity":
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        model = train(docs, training_labels(spark.read.parquet(f"{sf}/labels.parquet")))
        return {d for d, t in rows if model.probability(t) < 0.5}
    if name == "near_dedup":  # five-word shingles, similarity of 0.8 or more
        return {c for *_, c in least_ids(rows)}
    key = {d: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for d, t in rows}
    least = {}
    for d in sorted(key):
        least.setdefault(key[d], d)
    return set(least.values())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    had = docs.columns
    seen = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
        docs = spark.createDataFrame(stage(spark, docs, sf).collect(), docs.schema)
        ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == had and ids <= seen, name
        if name != "mixing":
            assert ids == expected(spark, sf, name, rows) and docs.count() == len(ids), name
        seen = ids
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == seen


@pytest.mark.parametrize("name", ["awkward", "clashing", "empty"])
def test_stages_on_odd_tables(spark, sf, request, name):
    """Nulls, repeated rows, long and empty texts and clashing columns; each stage gets what its predecessor kept."""
    docs = request.getfixturevalue(name)
    had, all_rows = docs.schema, Counter(map(str, docs.collect()))
    for stage_name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in had], stage_name
        rows, before = out.collect(), Counter(map(str, docs.collect()))
        assert all(str(r) in all_rows for r in rows), stage_name  # whole rows, unchanged
        if stage_name != "mixing":
            assert not Counter(map(str, rows)) - before, stage_name
        if stage_name == "exact_dedup":
            texts = lambda rs: {re.sub(r"[\x20\x09-\x0D]+", " ", r["text"] or "") for r in rs}
            assert len(rows) == len(texts(rows)) and texts(rows) == texts(docs.collect())
        if stage_name == "mixing":  # brute force: each source's words against its target
            words = lambda r: len((r["text"] or "").split())
            size, got = Counter(), Counter()
            for r in docs.collect():
                size[r["source"]] += words(r)
            for r in rows:
                got[r["source"]] += words(r)
            order = sorted(size, key=lambda s: (s is None, s or ""))
            want, longest = fill(size, {s: 1 + k % 3 for k, s in enumerate(order)}, 3) if size else {}, max(map(words, docs.collect()), default=0)
            assert all(abs(got[s] - want[s]) <= longest for s in size)
        docs = spark.createDataFrame(rows, had)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    places = {}
    for r in packed:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for x in places.values():
        ends = [0]
        for off, n in sorted(x):
            assert off == ends[-1]
            ends.append(off + n)
        assert ends[-1] <= 2048
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
    assert len(places) <= 1.05 * sum(r["length"] for r in packed) / 2048 + 1


def test_run(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 100 and out.selectExpr("max(offset + length) as m").first()["m"] <= 2048


def test_names_and_entry():
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") or n == "pipeline"]
    assert len(names) == 14 and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
