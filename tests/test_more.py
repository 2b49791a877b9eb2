"""Composition, line numbers, the streaming session log, language profiles, the key index, hooks and the versioned store."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from passagekit.functions import text as X
from passagekit.operators import hooks, key_index, langdetect, store, vectors
from passagekit.plans import chat
from passagekit.sinks import writers
from passagekit.sources import readers
from passagekit.streaming import session_log


def test_composition_equals_unicode(spark):
    block = [chr(k) for k in range(0x600, 0x700) if unicodedata.category(chr(k)) != "Cn"]
    marks = [c for c in block if unicodedata.combining(c)]
    rng = random.Random(2)
    texts = [a + b for a in block for b in block]
    texts += ["".join(rng.choice(block if rng.random() < 0.4 else marks) for _ in range(rng.randint(3, 9))) for _ in range(4000)]
    texts += ["", "plain text é", "أَ x", "مُعَلِّم"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "k int, t string").repartition(4)
    got = {r["k"]: r["c"] for r in rows.select("k", X.composed("t").alias("c")).collect()}
    assert got.pop(-1) is None
    wrong = [(texts[k], c) for k, c in got.items() if c != unicodedata.normalize("NFC", texts[k])]
    assert not wrong, wrong[:3]


def test_profiles_compose_first(spark):
    rows = spark.createDataFrame([("سؤال", "سؤال"), ("آدم", "آدم"), ("ئ", "ئ")], "apart string, whole string")
    for profile in (X.normalize_clean, X.normalize_root, X.normalize_search):
        assert all(r["a"] == r["b"] for r in rows.select(profile("apart").alias("a"), profile("whole").alias("b")).collect())


def test_lines_are_numbered_across_splits(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("﻿num_soura,num_aya,aya,name_soura\n" + "".join(f'{i},{1 + i % 3},"text, {name} {i}",N\n' + ("\n" if i % 50 == 0 else "") for i in range(1, 2000)), encoding="utf-8")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        path = f"file://{tmp_path}/*.csv"
        assert readers.numbered_lines(spark, path).rdd.getNumPartitions() > 4
        want = {(f"{n}.csv", i + 1, line) for n in ("a", "b") for i, line in enumerate((tmp_path / f"{n}.csv").read_text(encoding="utf-8").split("\n")[:-1])}
        got = {(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in readers.numbered_lines(spark, path).collect()}
        assert {(f, i, v.lstrip("﻿")) for f, i, v in got} == {(f, i, v.lstrip("﻿")) for f, i, v in want}
        rows = readers.read_raw_csv(spark, path)
        assert rows.count() == 2 * 1999 and rows.filter("num_soura = 7").first()["aya"].startswith("text, ")
        (tmp_path / "b.csv").write_text((tmp_path / "b.csv").read_text(encoding="utf-8").replace("1500,", "15x0,"), encoding="utf-8")
        line = (tmp_path / "b.csv").read_text(encoding="utf-8").split("\n").index('15x0,1,"text, b 1500",N') + 1
        with pytest.raises(Exception, match=f"num_soura is no integer: 15x0 in .*b.csv line {line}"):
            readers.read_raw_csv(spark, path).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_last_line_wins_on_any_split(spark, tmp_path):
    for name in ("a", "b"):
        (tmp_path / f"{name}.csv").write_text("num_soura,num_aya,aya,name_soura\n" + "".join(f"{i % 40},1,{name}{i},N\n" for i in range(1000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = {r["surah_number"]: r["text"] for r in readers.read_vocalized(spark, f"file://{tmp_path}/*.csv").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == {k: f"b{960 + k}" for k in range(40)}


def test_session_log_goes_on_after_a_restart(spark, tmp_path):
    src, out, ck = (f"file://{tmp_path}/{x}" for x in ("src", "out", "ck"))
    turns = [(f"s{i % 5}", i, f"q{i}", f"a{i}", None if i % 2 else '[{"id":"1:1"}]', float(i)) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, session_log.TURN)
    assert session_log.read_messages(spark, out).count() == 0
    frame(turns[:13]).repartition(3).write.parquet(f"{src}/p1")
    assert session_log.append_sessions(spark, f"{src}/*", out, ck) == 26
    assert session_log.append_sessions(spark, f"{src}/*", out, ck) == 0
    frame(turns[13:30] + turns[10:13] + [(None, 1, "q", "a", None, 0.0)]).repartition(2).write.parquet(f"{src}/p2")  # some turns come again
    assert session_log.append_sessions(spark, f"{src}/*", out, ck) == 34
    frame(turns[30:]).write.parquet(f"{src}/p3")
    assert session_log.append_sessions(spark, f"{src}/*", out, ck) == 20
    empty = spark.createDataFrame([], "session_id string, idx long")
    batch = store.append_turns(empty, frame(turns))
    cols = ["session_id", "idx", "role", "content", "sources", "created_at"]
    rows = lambda df: sorted(map(tuple, df.select(*cols).collect()))
    assert rows(session_log.read_messages(spark, out)) == rows(batch)
    assert {r["session_id"]: r["messages"] for r in session_log.latest_turn(spark, out).collect()} == {f"s{k}": 16 for k in range(5)}


def test_language_profiles(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("length(text) > 40")
    held = F.substring(F.md5(F.col("doc_id").cast("string")), 1, 1) < "4"
    known = langdetect.profiles(docs.filter(~held)).cache()
    got = langdetect.detect(docs.filter(held), known, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) > 20 and sum(r["language"] == r["lang"] for r in got) >= 0.95 * len(got)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !"), (4, "كتاب"), (5, "of the and that with"), (6, "x" * 20000)], "doc_id long, text string")
    said = {r["doc_id"]: (r["language"], r["grams"]) for r in langdetect.detect(odd, known, "doc_id").collect()}
    assert said[1] == said[2] == said[3] == ("unknown", 0) and said[4][0] == "ar" and said[5][0] == "en" and len(said) == 6
    none = langdetect.profiles(docs.limit(0))
    assert {r["language"] for r in langdetect.detect(odd, none, "doc_id").collect()} == {"unknown", "ar"}
    grams = spark.createDataFrame([("Ab c",)], "t string").select(langdetect.grams("t")).first()[0]
    assert grams == [" ab", "ab ", "b c", " c "]


def test_key_index_reads_one_bucket_and_joins_in_place(spark, tmp_path):
    rows = spark.range(5000).select(F.concat(F.lit("1:"), "id").alias("id"), (F.col("id") * 2).alias("v"))
    records = key_index.write(rows, "records_t", f"file://{tmp_path}/r", "id", 8)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # so that the plan tells the buckets of a scan without a join
    one = key_index.lookup(records, "id", ["1:77"])
    assert one.first()["v"] == 154 and "SelectedBucketsCount: 1 out of 8" in plan(one)
    hits = key_index.write(rows.filter("v % 3 = 0").select("id", F.lit(1.0).alias("score")), "hits_t", f"file://{tmp_path}/h", "id", 8)
    both = key_index.join(records, hits, "id")
    assert both.count() == 1667 and "Exchange" not in plan(both)
    spark.sql("DROP TABLE records_t")
    again = key_index.open(spark, "records_t", f"file://{tmp_path}/r")
    assert key_index.lookup(again, "id", ["1:77"]).first()["v"] == 154 and "SelectedBucketsCount: 1 out of 8" in plan(key_index.lookup(again, "id", ["1:77"]))
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    with pytest.raises(FileNotFoundError):
        key_index.open(spark, "none_t", f"file://{tmp_path}/none")


def test_scorer_hook(spark):
    pool = spark.createDataFrame([(q, d, d, f"text {d}" if (q, d) != (3, 1) else "bad") for q in (1, 2, 3) for d in range(5)], "qid long, doc long, pos long, passage string")

    def make():
        def score(pairs):
            if any(p == "bad" for _, p in pairs):
                raise ValueError("bad text")
            return [float(p.split()[1]) for _, p in pairs]

        return score

    got = hooks.rerank_with(pool, F.lit("q"), F.col("passage"), make, k=3, batch=4).orderBy("qid", "rerank_rank").collect()
    order = {q: [r["doc"] for r in got if r["qid"] == q] for q in (1, 2, 3)}
    assert order == {1: [4, 3, 2], 2: [4, 3, 2], 3: [0, 1, 2]}  # of a question that can't be scored whole the order stays
    assert [r["rerank_error"] for r in got if r["qid"] == 3] == [None, "ValueError: bad text", None]
    for missing in (lambda: None, lambda: 1 / 0):
        rows = hooks.rerank_with(pool, F.lit("q"), F.col("passage"), missing).orderBy("qid", "rerank_rank").collect()
        assert [r["doc"] for r in rows] == [0, 1, 2, 3, 4] * 3 and all(r["rerank_error"] for r in rows)


def test_hypothesis_and_stem_hooks(spark):
    asked = spark.createDataFrame([(1, "why"), (2, "bad"), (3, None), (4, "how")], "qid long, question string")

    def make():
        def write(rows):
            if ("bad",) in rows:
                raise RuntimeError("no answer")
            return [f" a passage on {q} " if q != "how" else "  " for (q,) in rows]

        return write

    rows = hooks.hypotheses(asked, F.col("question"), make)
    got = {r["qid"]: (r["hypothesis"], r["hypothesis_error"]) for r in rows.collect()}
    assert got == {1: ("a passage on why", None), 2: (None, "RuntimeError: no answer"), 3: (None, None), 4: (None, None)}
    from passagekit.plans.retrieval import retrieval_query

    said = {r["qid"]: r["q"] for r in rows.filter("qid < 3").select("qid", retrieval_query(F.col("question"), F.array(F.lit("x")), F.col("hypothesis")).alias("q")).collect()}
    assert said == {1: "why x a passage on why", 2: "bad x"}  # a failed hypothesis leaves its question as it is
    words = spark.createDataFrame([("running",), ("runs",), ("runs",), (None,)], "w string")
    assert {tuple(r) for r in hooks.stems(words, "w", lambda: lambda ws: [w[:3] for (w,) in ws]).collect()} == {("running", "run"), ("runs", "run")}


def test_parted_vectors_are_pruned(spark, tmp_path):
    """The table of create_vectors: a filter on its parts reads their folders alone, a filter on a payload field goes to the scan."""
    kind = spark.createDataFrame([], "id long, vector array<float>, juz int, period string").schema
    path = f"file://{tmp_path}/v"
    writers.create_vectors(spark, path, kind, ["period"])
    rows = [(i, [float(i % 5 + 1), 1.0], i % 30, "a" if i % 2 else "b") for i in range(200)]
    spark.createDataFrame(rows, kind).write.mode("append").partitionBy("period").parquet(path)
    stored = spark.read.schema(kind).parquet(path)
    asked = spark.createDataFrame([(1, [1.0, 1.0])], "qid long, vector array<float>")
    where = vectors.equality_filter({"period": "a", "juz": 3})
    got = vectors.top_k_batch(stored.filter(where), asked, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(period" in plan and "EqualTo(juz,3)" in plan
    assert sorted(r["id"] for r in got.collect()) == sorted(sorted((i for i, *_ in rows if i % 2 and i % 30 == 3), key=lambda i: (-round((i % 5 + 2) / (2**0.5 * ((i % 5 + 1) ** 2 + 1) ** 0.5), 12), i))[:5])


def brute_store(log):
    convs, active = {}, None
    for seq, op, cid, messages, at in sorted(log):
        if op == "create":
            convs[cid] = [[], at, at]
            active = cid
        elif op == "save" and cid in convs:
            convs[cid][0], convs[cid][2] = messages, at
            active = cid
        elif op == "delete":
            convs.pop(cid, None)
            active = None if active == cid else active
        elif op == "activate":
            active = cid
    return {(k, len(m or []), a, b) for k, (m, a, b) in convs.items()}, active


KIND = "seq long, op string, id string, messages array<struct<role:string,content:string>>, at double"


def test_store_is_replayed(spark):
    rng = random.Random(4)
    for n in (0, 1, 5, 60):
        log = []
        for seq in range(n):
            op = rng.choice(["create", "save", "save", "delete", "activate"])
            cid = rng.choice(["a", "b", "c", "d"]) if op != "activate" or rng.random() < 0.7 else None
            log.append((seq, op, cid, [("user", f"m{seq}"), ("assistant", "x")][: 1 + seq % 2] if op == "save" else None, float(seq)))
        # an id is created once while it lives
        live, kept = set(), []
        for row in log:
            if row[1] == "create" and row[2] in live:
                continue
            live = live | {row[2]} if row[1] == "create" else live - {row[2]} if row[1] == "delete" else live
            kept.append(row)
        conversations, active = store.replay(spark.createDataFrame(kept, KIND).repartition(3))
        want, on = brute_store(kept)
        got = {(r["id"], len(r["messages"] or []), r["created_at"], r["updated_at"]) for r in conversations.collect()}
        assert got == want and [r["id"] for r in active.collect()] == [on]
        back = store.read_store(store.snapshot(conversations, active), 1, "struct<id:string,title:string>")
        assert {r["id"] for r in back.collect()} == {k for k, *_ in want} and all(r["title"] for r in back.collect())
        assert store.read_store(store.snapshot(conversations, active, 2), 1, "struct<id:string>").count() == 0


def test_answers_still_take_clients(spark):
    df = spark.createDataFrame([(1, "x")], "id long, m string")
    assert chat.answers(df, F.col("m")).first()["answer"] == ""


def test_stored_indexes_notice_changed_tables(spark, tmp_path):
    from passagekit.session import state_of

    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    before = state_of(spark, path)
    assert state_of(spark, path) == before
    spark.range(5).write.mode("overwrite").parquet(path)
    assert state_of(spark, path) != before


def test_tables_of_a_build_go(spark):
    from passagekit.session import Kept, path_of

    with Kept() as keep:
        table = keep(spark.range(4))
        assert table.count() == 4
        (path,) = [p for _, p in keep.tables]
    p, fs = path_of(spark, path)
    assert not fs.exists(p)


def test_union_of_long_lists_is_numbered_in_parts(spark):
    from passagekit.operators import fusion

    a = spark.range(500).select(F.col("id"), F.col("id").alias("rank"), F.lit(1.0).alias("score"))
    b = spark.range(400, 900).select("id", (F.col("id") - 400).alias("rank"), F.lit(0.0).alias("score"))
    got = sorted((r["pos"], r["id"]) for r in fusion.keep_first_union(a, b).collect())
    assert got == [(i, i) for i in range(900)]
