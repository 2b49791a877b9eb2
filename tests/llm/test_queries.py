"""The registered queries: their contracts' columns, types and values, against plain Python over whole tables."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import rows_of, rows_of_sql
from test_native import fill
from test_similarity import fingerprint, roots_of

from passagekit.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def docs(spark, sf):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def rows(spark, sf, name, types):
    out = QUERIES[name](spark, sf)
    have = dict(out.dtypes)
    assert {c: have.get(c) for c in types} == types
    return out.collect()


def test_op1(spark, sf, docs):
    got = rows(spark, sf, "op1_sharding", {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"})
    assert sorted(r["doc_id"] for r in got) == sorted(docs) and {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}
    slots = defaultdict(list)
    for r in got:
        data = (docs[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data)) and 0 <= r["shard"] < 16
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def ids_of(text, end):
    from tokenizers import Tokenizer

    from passagekit.llm.tokens import default_tokenizer

    return [*Tokenizer.from_file(default_tokenizer()).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3_and_op7(spark, sf, docs):
    some = sorted(docs)[::9]
    ids = {d: ids_of(docs[d]["text"], 0) for d in some}
    got = rows(spark, sf, "op3_packing", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    have = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got}
    for d in some:
        for p in range(-(-len(ids[d]) // 2048)):
            own = ids[d][2048 * p : 2048 * (p + 1)]
            assert have[d, p] == (2048 * p, len(own), crc(own))
    assert {r["doc_id"] for r in got} == set(docs)
    assert len({r["sequence_id"] for r in got}) <= 1.01 * -(-sum(r["length"] for r in got) // 2048) + 1
    got = sorted(rows(spark, sf, "op7_token_output", {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"}), key=lambda r: r["doc_id"])
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    by = {r["doc_id"]: r for r in got}
    assert set(by) == set(docs) and all((by[d]["n_tokens"], by[d]["ids_crc32"]) == (len(ids[d]), crc([*ids[d][:-1], 1])) for d in some)


def test_op5(spark, sf, docs):
    f = {d: fingerprint(r["text"]) for d, r in docs.items()}
    root = roots_of(f.values(), 4)
    least = {}
    for d in sorted(f):
        least.setdefault(root[f[d]], d)
    got = rows(spark, sf, "op5_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in got} == {(d, f"{x:016x}", least[root[x]]) for d, x in f.items()}


def test_op6(spark, sf, docs):
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for d, r in docs.items()}
    of, taken = Counter(), Counter()
    for d, n in size.items():
        of[docs[d]["source"]] += n
    order = sorted(of, key=lambda s: (s is None, s or ""))
    want = fill(of, {s: 1 + k % 3 for k, s in enumerate(order)}, 3)
    for r in rows(spark, sf, "op6_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"}):
        s = docs[r["doc_id"]]["source"]
        assert (r["size"], r["source_size"], r["target"]) == (size[r["doc_id"]], of[s], pytest.approx(want[s])) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= max(size.values()) / 2 for s in of)


def test_op9_sql(spark, sf):
    assert rows_of(QUERIES["op9_exact_dedup"](spark, sf)) == rows_of_sql(ORACLE_SQL["op9_exact_dedup"], sf)


def test_op10(spark, sf):
    vecs = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = defaultdict(dict)
    for r in rows(spark, sf, "op10_graph_ann", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}):
        got[r["query_id"]][r["rank"]] = r["vec_id"], r["score"]
    assert set(got) == {v for v in vecs if v % 20 == 0}
    hit = 0
    for q, found in got.items():
        best = sorted((-float(vecs[q] @ v), k) for k, v in vecs.items() if k != q)[:20]
        assert sorted(found) == list(range(1, len(best) + 1)) and all(s == pytest.approx(float(vecs[q] @ vecs[v])) for v, s in found.values())
        hit += len({k for _, k in best} & {v for v, _ in found.values()})
    assert hit >= 0.95 * sum(map(len, got.values()))


@pytest.mark.parametrize(("name", "n", "k"), [("op2_language_id", 4, 2), ("op4_lm_scoring", 10, 0), ("op8_toxicity", 5, 0)])
def test_folds(spark, sf, docs, name, n, k):
    got = QUERIES[name](spark, sf).select("doc_id", "held_out").collect()
    assert {r["doc_id"]: r["held_out"] for r in got} == {d: zlib.crc32(str(d).encode()) % n == k for d in docs}
