"""Steps whose cost or memory grew faster than their input."""

from pyspark.sql import functions as F

from passagekit import queries
from passagekit.functions.text import affixes_off, different_words, heuristic_stem, hyphenated, normalize_clean, stem_steps, tokens, words_in_tasks
from passagekit.operators import bm25, coverage, inverted, langdetect
from passagekit.plans import retrieval
from passagekit.queries import _posts
from passagekit.sources import readers


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_resolution_map_of_wanted_keys_shuffles_no_others(spark):
    """Wanted keys alone, those in Arabic script and with white space folded first; the whole map normalises pairs once they are distinct."""
    rows = [("كتابٌ", "ktb"), ("كتاب", "ktb2"), (" walk ", "w"), ("walk", "w"), ("walk", "v"), ("talk", "t"), ("", "e"), (None, "n")]
    seg = spark.createDataFrame(rows, "form string, root string")
    whole = {r["key"]: r["roots"] for r in inverted.resolution_map(seg, "form").collect()}
    assert whole == {"كتاب": ["ktb", "ktb2"], "walk": ["v", "w"], "talk": ["t"]}
    wanted = spark.createDataFrame([("walk",), ("كتاب",), ("none",), ("",)], "key string")
    assert {r["key"]: r["roots"] for r in inverted.resolution_map(seg, "form", wanted=wanted).collect()} == {k: v for k, v in whole.items() if k != "talk"}


def test_root_candidates_are_cut_before_they_are_shuffled(spark):
    weights = spark.createDataFrame([(q, r, k, 1.0 + k) for q in (1, 2) for k, r in enumerate("ab")], "qid long, root string, ord long, idf double")
    posts = spark.createDataFrame([(r, k) for k in range(300) for r in "ab" if k % 3 or r == "a"], "root string, doc long")
    got = coverage.candidates(weights, posts, cap=7)
    assert "WindowGroupLimit" in _plan(got)
    assert sorted((r["qid"], r["rank"], r["doc"], r["score"]) for r in got.collect()) == [(q, k, d, 3.0) for q in (1, 2) for k, d in enumerate((1, 2, 4, 5, 7, 8, 10))]


def test_passages_meet_a_small_pool_where_they_are(spark, sf, monkeypatch):
    """Neither side of the join of pool and passages is shuffled: the pool is sent."""
    seen = []
    old = retrieval.rerank.rerank
    monkeypatch.setattr(retrieval.rerank, "rerank", lambda pool, *a, **k: seen.append(_plan(pool)) or old(pool, *a, **k))
    queries.similar_pipeline(spark, sf)
    physical = seen[0][seen[0].index("== Physical Plan") :]
    assert "SortMergeJoin" not in physical and "Exchange hashpartitioning" not in physical


def test_affixes_without_patterns(spark):
    """The first beginning and the longest ending that leave three letters."""
    rows = [("reunited",), ("undoing",), ("redo",), ("reds",), ("",), (None,), ("inflation",), ("xyzes",), ("unes",), ("innings",)]
    df = spark.createDataFrame(rows, "w string")
    prefixes, suffixes = ("re", "un", "in"), ("tion", "ion", "ing", "ed", "es", "s")
    old = F.regexp_replace(F.regexp_replace("w", "^(?:re|un|in)(?=.{3})", ""), "^(.{3,}?)(?:tion|ion|ing|ed|es|s)$", "$1")
    new = affixes_off("w", prefixes, suffixes)
    assert [r["a"] for r in df.select(old.alias("a")).collect()] == [r["a"] for r in df.select(new.alias("a")).collect()]
    assert "regexp" not in _plan(df.select(new)).lower()


def test_a_documents_postings_stand_in_one_file(spark, sf, monkeypatch):
    monkeypatch.setattr(queries, "_of", lambda spark, name, *at: f"{name}-apart")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = _posts(spark, sf)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    files = rows.select("doc", F.input_file_name().alias("file")).distinct()
    assert files.groupBy("doc").count().filter("count > 1").count() == 0


def test_language_grams_stay_in_their_row(spark):
    """Counts and sums as one row a gram gives them, letters beyond the basic plane too, and no row of a gram in the plan."""
    texts = [("aa", "Straße \U00010400\U00010401 x, o'b"), ("bb", "über den Fluß 12 den"), ("aa", None), (None, "nobody"), ("bb", "a"), ("aa", "dend end den")]
    docs = spark.createDataFrame([(k, *r) for k, r in enumerate(texts)], "doc_id long, lang string, text string")
    by_row = docs.filter("lang is not null").select("lang", F.explode(langdetect.grams("text")).alias("gram")).groupBy("lang", "gram").count()
    assert {tuple(r) for r in langdetect.gram_counts(docs).collect()} == {tuple(r) for r in by_row.collect()}
    known = langdetect.profiles(docs)
    found = langdetect.detect(docs, known, "doc_id")
    assert "Generate" not in _plan(found)
    sums = docs.select("doc_id", F.explode(langdetect.grams("text")).alias("gram")).join(known, "gram").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), (F.sum("aa") >= F.sum("bb")).alias("aa")).collect()
    want = {r["doc_id"]: ("aa" if r["aa"] else "bb", r["n"]) for r in sums}
    assert {r["doc_id"]: (r["language"], r["grams"]) for r in found.collect()} == {k: want.get(k, ("unknown", 0)) for k in range(len(texts))}


def test_stem_index_stems_without_lambdas(spark):
    """Ids in several rows count once, stems are worked out in compiled steps, and documents' lists are shuffled once."""
    docs = spark.createDataFrame([(1, "walking walked, x"), (1, "walks walking"), (2, "walk re-walk"), (3, None), (4, "talked")], "doc_id long, text string").repartition(3)
    old = lambda w: heuristic_stem(w, "a-z", ("re",), ("ing", "ed", "s"))
    want = inverted.stem_index(docs, "doc_id", tokens("text"), old)
    got = inverted.stem_index(docs, "doc_id", tokens("text"), stem_steps("a-z", ("re",), ("ing", "ed", "s")), shown=hyphenated)
    rows = lambda df: sorted((r["root"], r["forms_found"], r["docs"], r["count"]) for r in df.collect())
    assert rows(got) == rows(want) and rows(got)[1] == ("w-a-l-k", ["re-walk", "walk", "walked,", "walking", "walks"], [1, 2], 2)
    plan = _plan(got.select("root", "forms_found", "count")).split("== Physical Plan ==")[1]
    assert "Generate" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_lists_of_an_index_are_shuffled_once(spark):
    """The index of roots and a passage's roots: copies, malformed and missing places, no (root, verse) pair shuffled by itself."""
    rows = [("1:2", "b", "r"), ("1:10", "a", "r"), ("1:2", "b", "r"), ("x", "c", "r"), (None, "c", "r"), ("1:2", "z", None), ("2:1", None, "q")]
    seg = spark.createDataFrame(rows, "verse_id string, form string, root string")
    index, of = inverted.root_index(seg), inverted.passage_roots(seg)
    for df in (index, of):
        plan = _plan(df).split("== Physical Plan ==")[1]
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
    assert {r["root"]: (r["forms_found"], r["verses"], r["count"]) for r in index.collect()} == {"r": (["a", "b", "c"], [None, "x", "1:2", "1:10"], 4), "q": ([], ["2:1"], 1)}
    assert {r["verse_id"]: r["roots"] for r in of.collect()} == {"1:2": ["r"], "1:10": ["r"], "x": ["r"], None: ["r"], "2:1": ["q"]}


def test_words_of_texts_are_counted_in_tasks(spark):
    """Counts as the expressions have them, white space and letters of all kinds included; rows go to workers and stay where they are."""
    texts = ["a b  a\x1cb a\x1fb", "\u2003x\u00a0X\u3000\u0085y\u200b ", "كتابٌ  كتاب", None, "", " \t\n", "İΣΑΣ ß \U00010400 \ufb01 z", "nul\x00 a\u180eb", "ئ\u0654 \u0671 a\u2028b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = bm25.document_terms(docs, "id", F.col("text"))
    want = docs.select(F.col("id").alias("doc"), F.size(tokens("text")).cast("long").alias("dl"), bm25.counted_terms(tokens("text")).alias("terms"))
    key = lambda r: (r["doc"], r["dl"], [tuple(t) for t in r["terms"]])
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))
    assert "MapInArrow" in _plan(got) and "Exchange" not in _plan(got)
    clean = bm25.document_terms(docs, "id", F.col("text"), normalizer=normalize_clean)
    assert sorted((r["doc"], r["dl"]) for r in clean.collect()) == sorted((r[0], r[1]) for r in docs.select("id", F.size(tokens("text", normalize_clean))).collect())


def test_expansion_reads_forms_and_not_places(spark, sf, monkeypatch):
    """which forms a root has is asked of the vocabulary; no segment, a row a document and form, is made."""
    monkeypatch.setattr(queries, "_segs", lambda *_: 1 / 0)
    assert queries.query_expand(spark, sf).filter("terms <> ''").count() > 0


def test_words_come_of_some_texts_at_once(spark):
    """A worker has the words of a few million bytes of texts, not of a whole batch."""

    def make():
        import pyarrow as pa

        def count(rows):
            n = len(list(rows))
            return (pa.array([n] * n, pa.int32()),)

        return count

    docs = spark.range(6).coalesce(1).select("id", F.repeat(F.lit("word "), 300_000).alias("text"))
    got = words_in_tasks(docs, [F.col("id")], F.col("text"), make, {"n": "int"}).collect()
    assert sorted(r["id"] for r in got) == list(range(6)) and max(r["n"] for r in got) <= 2


def test_words_in_tasks_are_tokens(spark):
    """The vocabulary and the segments of odd texts are those of tokens() as an expression."""
    texts = ["The the, THE reation", None, "", "   ", "un\x1cdoing tab\tnew\nline", "İstanbul straße 12 ...", "كِتَاب the", "　reds  reds"]
    docs = spark.createDataFrame([(k, "src3", t) for k, t in enumerate(texts)], "doc_id long, source string, text string")
    words = docs.select("doc_id", F.explode(tokens("text")).alias("w"))
    got = [r["word"] for r in different_words(docs.coalesce(1), F.col("text")).collect()]
    assert sorted(got) == sorted(r["w"] for r in words.select("w").distinct().collect())
    again = [r["word"] for r in different_words(docs.coalesce(1), F.col("text"), most=1).collect()]
    assert set(again) == set(got)  # of small sets none is lost
    forms = words.select("doc_id", F.regexp_replace("w", f"[^{queries.LETTERS}]", "").alias("form")).filter("form <> ''").distinct()
    want = forms.select(F.concat(F.lit("3:"), "doc_id").alias("verse_id"), "form", affixes_off("form", queries.PREFIXES, queries.SUFFIXES).alias("root"))
    seg = queries._segments(docs)
    assert sorted(map(tuple, seg.select("verse_id", "form", "root").collect())) == sorted(map(tuple, want.collect()))
    assert {tuple(r) for r in queries._vocabulary(docs).collect()} == {tuple(r) for r in seg.select("form", "root", "lemma").collect()}


def test_lines_of_a_morphology_file_are_read_in_batches(spark):
    """fields are not taken apart by expressions, whose generated code was too long to be compiled; odd lines are read as before."""
    feats = ["ROOT:a|ROOT:b", "STEM|ROOT:", "ROOT", "STEM|XROOT:q", "LEM:l|ROOT: r　|LEM:m", "|ROOT:k|", "A |ROOT:n", "ROOT:x|ROOT:"]
    lines = [f"(1:{k}:1:1)\t f \tN\t{f}" for k, f in enumerate(feats)] + [None, "", "1:1\tf\tN", "1\tf\tN\tROOT:a", "x:2\tf\tN\tROOT:a", " 7 :+8\t\tN\tROOT:z\tmore"]
    seg = readers.parse_morphology(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert "MapInArrow" in _plan(seg)
    got = sorted((r["verse_id"], r["form"], r["root"], r["lemma"]) for r in seg.collect())
    assert got == [("1:0", "f", "b", ""), ("1:4", "f", "r", "m"), ("1:5", "f", "k", ""), ("1:6", "f", "n", ""), ("7:8", "", "z", "")]


def test_a_roots_lists_are_gathered_within_tasks(spark):
    rows = [("1:2", "b", "r"), ("1:2", "b", "r"), ("1:10", "a", "r"), (None, "c", "r"), ("odd", None, "r"), ("1:1", None, "s"), (None, None, "s"), ("1:1", "x", None)]
    seg = spark.createDataFrame(rows, "verse_id string, form string, root string")
    for most in (1, 1 << 19):
        got = inverted._gathered(seg.filter("root is not null").select("root", "form", "verse_id").coalesce(1), most).collect()
        assert sum(len(r["forms"]) for r in got) >= 3 and {v for r in got for v in r["verses"]} == {"1:2", "1:10", None, "odd", "1:1"}
    index = {r["root"]: (r["forms_found"], r["verses"], r["count"]) for r in inverted.root_index(seg).collect()}
    assert {k: (f, set(v), n) for k, (f, v, n) in index.items()} == {"r": (["a", "b", "c"], {None, "odd", "1:2", "1:10"}, 4), "s": ([], {None, "1:1"}, 2)}
    assert [v for v in index["r"][1] if v and v != "odd"] == ["1:2", "1:10"]
