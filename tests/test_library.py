import json

import pytest
from pyspark.sql import functions as F

from passagekit.operators import bm25, coverage, fusion, inverted, lexical, rerank, sampling, store, vectors
from passagekit.plans import chat, ingest, retrieval
from passagekit.sinks import writers
from passagekit.sources import readers
from passagekit.streaming import index_build

LINES = [
    "(1:1:1:1)\tba\tP\tPREF|ROOT:smw|LEM:som",
    "1:1:1:2\tsmi\tN\tSTEM|LEM:som|ROOT:smw",
    "",
    "1:1:2\tx",
    "a:b:1:1\tq\tN\tROOT:qqq",
    "1:2:1:1\tHmd\tN\tROOT:Hmd|LEM:Hmd",
    "2:1:1:1\tsmi\tN\tROOT:smw",
    "2:1:1:2\tHmd\tN\tROOT:hmm",
]


@pytest.fixture
def segments(spark):
    return readers.parse_morphology(spark.createDataFrame([(x,) for x in LINES], "value string"))


def test_csv(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("﻿num_soura,num_aya,aya,name_soura\n1,1, abc ,One\n1,2,def,One\n1,2,ghi,One\n", encoding="utf-8")
    raw = readers.read_raw_csv(spark, f"file://{p}")
    assert [tuple(r) for r in raw.orderBy("num_aya", "aya").collect()] == [(1, 1, "abc", "One"), (1, 2, "def", "One"), (1, 2, "ghi", "One")]
    assert [r["text"] for r in readers.read_vocalized(spark, f"file://{p}").orderBy("ayah_number").collect()] == ["abc", "ghi"]
    rec = readers.canonical_records(raw).first()
    assert (rec["id"], rec["translation_fr"], rec["juz"], rec["roots"]) == ("1:1", "", 0, [])
    bad = tmp_path / "b.csv"
    bad.write_text("num_soura,num_aya,aya\n1,1,x\n")
    with pytest.raises(ValueError, match="name_soura"):
        readers.read_raw_csv(spark, f"file://{bad}")
    bad.write_text("num_soura,num_aya,aya,name_soura\nq,1,x,y\n")
    with pytest.raises(Exception, match="no integer: q"):
        readers.read_raw_csv(spark, f"file://{bad}").collect()


def test_translations_and_edition(spark, tmp_path):
    (tmp_path / "fr.json").write_text(json.dumps({"1:1": "un", "1:2": ""}))
    got = readers.read_translations(spark, {"fr": f"file://{tmp_path}/fr.json", "en": f"file://{tmp_path}/none.json"})
    assert sorted(map(tuple, got.collect())) == [("fr", "1:1", "un"), ("fr", "1:2", "")]
    (tmp_path / "e.json").write_text(json.dumps({"code": 200, "data": {"surahs": [{"number": 2, "ayahs": [{"numberInSurah": 3, "text": " x "}]}]}}))
    assert list(map(tuple, readers.read_edition(spark, f"file://{tmp_path}/e.json").collect())) == [("2:3", "x")]


def test_morphology_and_index(spark, segments):
    index = {r["root"]: r for r in inverted.root_index(segments).collect()}
    assert (index["smw"]["forms_found"], index["smw"]["verses"], index["smw"]["count"]) == (["ba", "smi"], ["1:1", "2:1"], 2)
    forms = {r["key"]: r["roots"] for r in inverted.resolution_map(segments, "form").collect()}
    assert forms["Hmd"] == ["Hmd", "hmm"]


def test_resolution_ladder_and_clitics(spark, segments):
    keys = segments.select("root").distinct()
    forms, lemmas = inverted.resolution_map(segments, "form"), inverted.resolution_map(segments, "lemma")
    words = spark.createDataFrame([("Hmd",), ("smi",), ("som",), ("zzz",), ("",)], "word string")
    got = {r["word"]: r["roots"] for r in inverted.resolve(words, keys, forms, lemmas).collect()}
    assert got == {"Hmd": ["Hmd", "hmm"], "smi": ["smw"], "som": ["smw"], "zzz": [], "": []}
    low = segments.withColumns({c: F.lower(c) for c in ("form", "root", "lemma")})
    asked = spark.createDataFrame([(1, "the alsmi hmdx"), (2, "the")], "qid long, text string")
    args = low.select("root").distinct(), inverted.resolution_map(low, "form"), inverted.resolution_map(low, "lemma")
    rows = inverted.content_roots(asked, *args, stop=["the"], prefixes=("al",), suffixes=("x",)).orderBy("qid", "ord").collect()
    assert [tuple(r) for r in rows] == [(1, "smw", 0), (1, "hmd", 1), (1, "hmm", 2)]


def test_ingest(spark, segments, tmp_path):
    raw = spark.createDataFrame([(1, 1, "أَله", "A"), (2, 142, "b", "B")], "num_soura int, num_aya int, aya string, name_soura string")
    said = spark.createDataFrame([("fr", "1:1", "un"), ("en", "2:142", "")], "lang string, id string, text string")
    names = spark.createDataFrame([(1, "One", "Un")], "surah_number int, name_en string, name_fr string")
    out = ingest.run(raw, segments, said, names, out=f"file://{tmp_path}/out", expected=2)
    a, b = out["records"].orderBy("surah_number").collect()
    assert (a["text_ar_clean"], a["surah_name_en"], a["period"], a["juz"], a["translation_fr"], a["roots"]) == ("اله", "One", "makkiyya", 1, "un", ["smw"])
    assert (b["surah_name_en"], b["period"], b["juz"], b["translation_en"], b["roots"]) == ("", "madani", 2, "", [])
    q = ingest.quality(out["records"]).first()
    assert (q["n"], q["chapters"], q["no_name"], q["no_roots"]) == (2, 2, 1, 1)
    with pytest.raises(ValueError):
        ingest.run(raw, segments, said, expected=3)


def test_bm25_fills_with_zero_scores(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c"), (3, "d"), (4, None)], "id long, text string")
    index = bm25.build(docs, "id", F.col("text"))
    asked = spark.createDataFrame([(1, "d"), (2, "zz")], "qid long, text string")
    got = {}
    for r in bm25.search(index, asked, F.col("text"), 3).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append(r["doc"])
    assert got == {1: [3, 1, 2], 2: [1, 2, 3]}
    assert [r["doc"] for r in bm25.search(index, asked, F.col("text"), 3, fill=False).collect()] == [3]


def test_rrf_and_pool(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "id string, rank int")
    b = spark.createDataFrame([("z", 0), ("w", 1), ("x", 2)], "id string, rank int")
    got = [(r["id"], r["score"]) for r in fusion.rrf(a, b, 4).collect()]
    assert got[0] == ("x", pytest.approx(0.032796)) and [x for x, _ in got] == ["x", "z", "w", "y"]
    one = spark.createDataFrame([("a", 0, 1.0), ("b", 1, 0.5)], "id string, rank int, score double")
    two = spark.createDataFrame([("b", 0, 0.0), ("c", 1, 0.0)], "id string, rank int, score double")
    assert [(r["id"], r["score"]) for r in fusion.keep_first_union(one, two).orderBy("pos").collect()] == [("a", 1.0), ("b", 0.5), ("c", 0.0)]


def test_gates(spark):
    rows = spark.createDataFrame([(1, 0.5, 0), (1, 0.001, 1), (2, 0.005, 0), (2, 0.001, 1)], "qid long, rerank_score double, rerank_rank int")
    got = rerank.threshold(rows).groupBy("qid").count().orderBy("qid").collect()
    assert [r["count"] for r in got] == [1, 2]
    cov = spark.createDataFrame([(1, c, 2) for c in (1.0, 1.0, 1.0, 0.5)] + [(2, 1.0, 2), (2, 0.5, 2)], "qid long, cov double, n_roots int")
    assert [r["count"] for r in rerank.full_coverage_gate(cov).groupBy("qid").count().orderBy("qid").collect()] == [3, 2]


def test_coverage_without_roots_is_one(spark):
    pairs = spark.createDataFrame([(1, 5)], "qid long, doc long")
    weights = spark.createDataFrame([], "qid long, root string, ord int, idf double")
    posts = spark.createDataFrame([], "root string, doc long")
    assert coverage.fractions(pairs, weights, posts).first()["cov"] == 1.0


def test_ranges_and_filters(spark):
    for bad in ({"limit": 0}, {"limit": 51}, {"chapter": 115}, {"part": 0}, {"window": 6}, {"verse": 0}, {"text": " "}):
        with pytest.raises(ValueError):
            retrieval.checked(**bad)
    df = spark.createDataFrame([(1, "a"), (2, "b")], "juz int, period string")
    assert df.filter(vectors.equality_filter({"juz": 1, "period": None, "other": 3})).count() == 1


def test_lookup_and_exhaustive(spark, segments):
    index = inverted.root_index(segments)
    roots = spark.createDataFrame([(1, "smw", 0), (1, "Hmd", 1), (2, "none", 0)], "qid long, root string, ord int")
    rec = spark.createDataFrame([("1:1", "t")], "id string, text string")
    got = {r["qid"]: r for r in lexical.lookup(roots, index, rec).collect()}
    assert got[1]["occurrences_count"] == 2 and [v["id"] for v in got[1]["verses"]] == ["1:1"] and got[2]["verse_ids"] == []
    long = {r["qid"]: r for r in lexical.lookup_long(roots, segments, rec).collect()}
    assert set(long) == set(got) and long[2]["forms"] == [] and long[2]["verses"] is None
    assert [long[1][c] for c in ("root", "forms", "occurrences_count", "verses")] == [got[1][c] for c in ("root", "forms", "occurrences_count", "verses")]
    voc = spark.createDataFrame([(1, 1, "smi q ba", "A"), (1, 2, "Hmd", "A")], "surah_number int, ayah_number int, text string, surah_name string")
    rows = lexical.exhaustive(roots, segments, voc).collect()
    assert [(r["surah_number"], r["ayah_number"], r["match_indices"]) for r in rows] == [(1, 1, [0, 2]), (1, 2, [0])]


def test_rows_at_even_distances(spark):
    """A key with most rows, few rows, exactly as many as asked for, a null key; nothing of an empty table."""
    sizes = {"hot": 5000, "few": 3, "same": 7, None: 40}
    rows = [(k, (i * 7919) % n) for k, n in sizes.items() for i in range(n)]
    got: dict = {}
    for r in sampling.even_rows(spark.createDataFrame(rows, "k string, v long"), "k", ["v"], 7).collect():
        assert r["pos"] == r["v"] and r["n"] == sizes[r["k"]]
        got.setdefault(r["k"], []).append(r["v"])
    assert {k: sorted(v) for k, v in got.items()} == {k: list(range(n)) if n <= 7 else [int(i * (n / 7)) for i in range(7)] for k, n in sizes.items()}
    assert sampling.even_rows(spark.createDataFrame([], "k string, v long"), "k", ["v"], 7).count() == 0


def test_store(spark):
    empty = spark.createDataFrame([], "session_id string, idx long")
    turns = spark.createDataFrame([("s", 0, "q1", "a1", None, 1.0), ("s", 1, "q2", "a2", '[{"id":"1:1","junk":2}]', 2.0)], "session_id string, seq int, question string, answer string, sources string, created_at double")
    rows = store.append_turns(empty, turns)
    got = store.session_messages(rows).collect()
    assert [(r["idx"], r["role"]) for r in got] == [(0, "user"), (1, "assistant"), (2, "user"), (3, "assistant")]
    assert got[3]["sources"][0]["id"] == "1:1"
    assert [r["content"] for r in store.history(rows, "s").collect()] == ["q1", "a1", "q2", "a2"]
    assert store.drop_last_exchange(rows).count() == 2
    votes = spark.createDataFrame([("s", 0, "up", "q", "a", 1.0), ("s", 0, "down", "q2", "a2", 2.0)], "session_id string, message_index long, rating string, question string, answer string, created_at double")
    merged = store.upsert_feedback(votes, ["session_id", "message_index"], F.col("created_at"))
    assert (merged.first()["rating"], merged.first()["question"]) == ("down", "q")
    assert tuple(store.feedback_stats(merged).first()) == (0, 1, 1)
    raw = spark.createDataFrame([('{"version":1,"conversations":[{"id":"x"}]}',), ("broken",), ('{"version":2,"conversations":[{"id":"y"}]}',)], "value string")
    assert [r["id"] for r in store.read_store(raw, 1, "struct<id:string>").collect()] == ["x"]


def test_vectors(spark):
    old = spark.createDataFrame([(1, [1.0])], "id long, vector array<float>")
    new = spark.createDataFrame([(1, [2.0]), (2, [3.0])], "id long, vector array<float>")
    assert {r["id"]: r["vector"] for r in writers.upsert_vectors(old, new).collect()} == {1: [2.0], 2: [3.0]}
    with pytest.raises(Exception, match="components"):
        writers.last_vectors(new, "id", F.col("id"), 5).collect()
    texts = spark.createDataFrame([(1, "alpha beta"), (2, "alpha beta"), (3, None)], "id long, text string")
    emb = vectors.embed(texts, F.col("text")).orderBy("id").collect()
    assert emb[0]["vector"] == emb[1]["vector"] and sum(x * x for x in emb[0]["vector"]) == pytest.approx(1, abs=1e-5)


def test_chat(spark):
    asked = spark.createDataFrame([(1, "why?")], "qid long, question string")
    p = spark.createDataFrame([(1, 0, "1:1", "One", "x", 1, 1, "t", "", "e")], "qid long, ord int, id string, surah_name_en string, surah_name_ar string, surah_number int, ayah_number int, text_ar string, translation_fr string, translation_en string")
    r = chat.chat(asked, p).first()
    assert "[1] Surah One (1), Verse 1 [1:1]\n    AR: t\n    EN: e" in r["message"] and r["message"].endswith("Question: why?")
    assert r["answer"].startswith("[1] Surah One")
    assert "(no verse retrieved)" in chat.chat(asked, p.limit(0)).first()["message"]


def test_chat_takes_history_and_system(spark):
    class Echo:
        def chat(self, system, messages):
            return f"{system}|" + "|".join(f"{m['role']}={m['content'][:4]}" for m in messages)

    asked = spark.createDataFrame([(1, "why?"), (2, "how?")], "qid long, question string")
    p = spark.createDataFrame([(1, 0, "1:1", "One", "x", 1, 1, "t", "", "e")], "qid long, ord int, id string, surah_name_en string, surah_name_ar string, surah_number int, ayah_number int, text_ar string, translation_fr string, translation_en string")
    before = spark.createDataFrame([(1, 1, "assistant", "yes"), (1, 0, "user", "hm")], "qid long, idx int, role string, content string")
    got = {r["qid"]: r["answer"] for r in chat.chat(asked, p, make=Echo, history=before, system="S").collect()}
    assert got == {1: "S|user=hm|assistant=yes|user=Pass", 2: "S|user=Pass"}


def test_converse_retrieves_filters_and_answers(spark):
    kind = "id string, surah_number int, ayah_number int, surah_name_en string, surah_name_ar string, text_ar string, translation_fr string, translation_en string, period string"
    rec = spark.createDataFrame([(f"{s}:{a}", s, a, "N", "n", f"word{s} {a}", "", "", "madani" if s == 2 else "makkiyya") for s in (1, 2) for a in range(1, 6)], kind)
    index = bm25.build(rec, "id", F.col("text_ar"))
    at = rec.filter("id = '1:4'").select("id", "period")
    dense = lambda q, where: q.select("qid").crossJoin(at.filter(where)).select("qid", "id", F.lit(0).alias("rank"))
    asked = spark.createDataFrame([(1, "word2 medinan"), (2, "word1"), (3, "word1 word2")], "qid long, question string")
    got = {r["qid"]: r for r in chat.converse(asked, rec, index, dense, k=2).collect()}
    assert [h["id"][:1] for h in got[1]["hits"]] == ["2", "2"] and {p["period"] for p in got[1]["sources"]} == {"madani"}
    assert "1:4" in [h["id"] for h in got[2]["hits"]] and "[1:3]" in got[2]["message"] and got[2]["message"].endswith("Question: word1")
    only = chat.converse(asked, rec, index, dense, filters={"period": "madani"}, k=2).collect()
    assert all(h["id"].startswith("2") for r in only for h in r["hits"])


def test_analysis_without_occurrences_asks_no_model(spark):
    class Fails:
        def chat(self, system, messages):
            raise AssertionError("asked")

    rows = spark.createDataFrame([(1, "q", [], 0, [])], "qid long, root string, forms array<string>, occurrences_count long, verses array<struct<id:string,surah_name_en:string,surah_name_ar:string,surah_number:int,ayah_number:int,text_ar:string,translation_fr:string,translation_en:string>>")
    r = chat.analyse(rows, F.lit("en"), make=Fails).first()
    assert (r["found"], r["answer"], r["message"]) == (False, "", None)


def test_templates_take_values_as_they_are(spark):
    from passagekit.operators.prompts import filled

    got = spark.range(1).select(filled("a {x} b {y}", x=F.lit("{y}"), y=F.lit("z")).alias("t")).first()["t"]
    assert got == "a {y} b z"


def test_index_is_saved_and_loaded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b b"), (2, "b c"), (3, None)], "id long, text string")
    asked = spark.createDataFrame([(1, "b c")], "qid long, text string")
    index = bm25.build(docs, "id", F.col("text"))
    path = f"file://{tmp_path}/index"
    bm25.save(index, path)
    back = bm25.load(spark, path)
    rows = lambda i: [tuple(r) for r in bm25.search(i, asked, F.col("text"), 3).orderBy("rank").collect()]
    assert rows(back) == rows(index) and len(rows(back)) == 3
    with pytest.raises(FileNotFoundError):
        bm25.load(spark, f"file://{tmp_path}/none")


def test_vector_table_is_created_once(spark, tmp_path):
    kind = spark.createDataFrame([], "id long, vector array<float>, period string").schema
    path = f"file://{tmp_path}/v"
    writers.create_vectors(spark, path, kind, ["period"])
    spark.createDataFrame([(1, [1.0], "a")], kind).write.mode("append").partitionBy("period").parquet(path)
    writers.create_vectors(spark, path, kind, ["period"])
    rows = spark.read.schema(kind).parquet(path)
    assert rows.count() == 1 and "PartitionFilters: [isnotnull(period" in rows.filter("period = 'a'")._jdf.queryExecution().executedPlan().toString()
    writers.create_vectors(spark, path, kind, ["period"], recreate=True)
    assert spark.read.schema(kind).parquet(path).count() == 0


def test_unsound_vectors_are_passed_over(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [1.0]), (6, [1e300, 1e300]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id long, vector array<double>")
    got = vectors.top_k_batch(df, df.withColumnRenamed("id", "qid"), 5).collect()
    assert {(r["qid"], r["id"]) for r in got} == {(1, 1), (1, 6), (6, 1), (6, 6), (5, 5)}
    assert vectors.top_k_batch(df.limit(0), df.withColumnRenamed("id", "qid").limit(0), 5).count() == 0


def test_tables_of_an_application_go(spark):
    from passagekit import session

    made = []
    path = session.stored(spark, "t", lambda p: (made.append(p), spark.range(3).write.parquet(p)))
    assert session.stored(spark, "t", lambda p: made.append(p)) == path and made == [path] and spark.read.parquet(path).count() == 3
    assert session.application_dir(spark).startswith(session.shared_dir(spark))


def test_ingestion_reports_its_stages(spark, segments, tmp_path):
    raw = spark.createDataFrame([(1, 1, "a", "A"), (2, 142, "b", "B")], "num_soura int, num_aya int, aya string, name_soura string")
    said, report = spark.createDataFrame([], "lang string, id string, text string"), []
    ingest.run(raw, segments, said, out=f"file://{tmp_path}/out", report=report)
    assert [(r["stage"], r["rows"]) for r in report][0] == ("records", 2) and len(report) == 4 and all(r["seconds"] > 0 for r in report)


def test_streaming_build_resumes(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("src", "out", "ck"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string")
    rows.write.parquet(f"{src}/p1")
    embed = lambda b: vectors.embed(b, F.col("text"))
    glob = f"{src}/*"
    assert index_build.build_vectors(spark, glob, rows.schema, embed, out, ck) == 2
    assert index_build.build_vectors(spark, glob, rows.schema, embed, out, ck) == 0
    spark.createDataFrame([(2, "c"), (3, "d")], "id long, text string").write.parquet(f"{src}/p2")
    assert index_build.build_vectors(spark, glob, rows.schema, embed, out, ck) == 2
    assert {r["id"]: r["text"] for r in index_build.latest(spark, out).collect()} == {1: "a", 2: "c", 3: "d"}
