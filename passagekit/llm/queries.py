"""The registered queries of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, shared_dir, text_of


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in one of 16 shards of nearly equal bytes."""
    from .sharding import shard

    rows = shard(_documents(spark, sf_dir), n_shards=16)
    return rows.select(
        "doc_id",
        "size",
        F.crc32(text_of().cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of every whole document under a GRU and under the unigram base."""
    from .common import Scratch
    from .gru_lm import score, train

    docs = _documents(spark, sf_dir)
    scratch = Scratch(spark, "gru-lm")
    model, counts = train(docs.filter(fold("doc_id", 10) != 0), scratch)
    rows = score(docs, model, counts, scratch)
    return rows.select(
        "doc_id",
        (fold("doc_id", 10) == 0).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of 4-word shingles and the components of links at 4 bits or fewer."""
    from .simhash import hex_of, near_duplicates

    rows = near_duplicates(_documents(spark, sf_dir), shingle=4, max_bits=4)
    return rows.select("doc_id", hex_of(F.col("fp")).alias("fingerprint"), "component_id")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that a mix with weights 1, 2, 3 and at most 3 epochs takes of each document."""
    from .mixing import mix

    rows = mix(_documents(spark, sf_dir), weights=(1.0, 2.0, 3.0), max_epochs=3)
    return rows.select("doc_id", "size", "source_size", "target", "taken", "source", "repeats")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from three of four folds."""
    from .language_id import predict_language, train

    docs = _documents(spark, sf_dir)
    held = fold("doc_id", 4) == 2
    model = train(docs.filter(~held), max_rows=4000)
    rows = predict_language(docs.select("doc_id", "text", held.alias("held_out")), model)
    return rows.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces of at most 2048 ids, packed into sequences."""
    from .packing import pack, pieces

    cut = pieces(_documents(spark, sf_dir), capacity=2048, end_id=0)
    return pack(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), capacity=2048)


def op7_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids written in byte planes and read back, by document."""
    from .token_output import read_ids, write_ids

    path = f"{shared_dir(spark)}/token-ids-{uuid.uuid4().hex}"
    write_ids(_documents(spark, sf_dir), path, end_id=1)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely each document is toxic, learnt from four of five folds of the labels."""
    from .toxicity import score_toxicity, train, training_labels

    docs, labels = _documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, training_labels(labels), max_labelled=20_000)
    rows = score_toxicity(docs.select("doc_id", "text"), model)
    score = F.col("toxicity.score")
    return rows.select(
        "doc_id",
        (fold("doc_id", 5) == 0).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
        F.size("toxicity.segments").alias("passages"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose white-space-normalised texts are equal."""
    from .exact_dedup import exact_groups

    return exact_groups(_documents(spark, sf_dir))


def op10_graph_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found to every vector whose id is divisible by 20."""
    from .graph_ann import nearest

    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vecs, vecs.filter("vec_id % 20 = 0"), k=20)


def op11_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.98 or more between vectors of one label, and their components."""
    from .pq_dedup import near_duplicates

    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), cosine=0.98)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the 16 leading components of the covariance, at unit variance."""
    from .whitening import fit, whiten

    vecs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return whiten(vecs, fit(vecs, components=16))


def op13_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's cluster after three rounds from 16 centroids."""
    from .lloyd import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=16, rounds=3)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline over documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_packing": op3_packing,
    "op4_lm_scoring": op4_lm_scoring,
    "op5_simhash": op5_simhash,
    "op6_mixing": op6_mixing,
    "op7_token_output": op7_token_output,
    "op8_toxicity": op8_toxicity,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_graph_ann": op10_graph_ann,
    "op11_pq_dedup": op11_pq_dedup,
    "op12_whitening": op12_whitening,
    "op13_lloyd": op13_lloyd,
    "pipeline": pipeline,
}

_FINITE = "list_count(list_filter(embedding, lambda c: c IS NOT NULL AND isfinite(c))) = len(embedding)"


def _lloyd_sql(rounds: int = 3, k: int = 16) -> str:
    """The rounds of plain Lloyd one after the other; a centroid is a row a component."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = 64 AND {_FINITE})",
        "e AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM v)",
        f"first AS (SELECT vec_id, row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c FROM v QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM first JOIN e USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(f"d{r} AS (SELECT vec_id, c, sum((e.x - c.x) * (e.x - c.x))::BIGINT AS d FROM e JOIN c{r} c USING (i) GROUP BY ALL)")
        steps.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1)")
        if r < rounds:
            steps.append(f"s{r} AS (SELECT c, i, sum(x)::BIGINT AS s, count(*) AS n FROM a{r} JOIN e USING (vec_id) GROUP BY c, i)")
            steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN n IS NULL THEN x ELSE (s - ((s % n) + n) % n) // n END AS x FROM c{r} LEFT JOIN s{r} USING (c, i))")
    steps.append(f"named AS (SELECT c, sha256(string_agg(x::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)")
    return f"""
        WITH {", ".join(steps)}
        SELECT vec_id, c::INTEGER AS cluster, d AS distance,
               (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia, centroid_sha256
        FROM a{rounds} JOIN named USING (c)
    """


ORACLE_SQL: dict[str, str] = {
    "op11_pq_dedup": f"""
        WITH RECURSIVE v AS (
            SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS x FROM embeddings
            WHERE label IS NOT NULL AND {_FINITE} AND len(list_filter(embedding, lambda c: c <> 0)) > 0
        ), links AS MATERIALIZED (
            SELECT a.vec_id AS a, b.vec_id AS b
            FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
            WHERE list_cosine_similarity(a.x, b.x) >= 0.98
        ), reach AS (
            SELECT vec_id AS a, vec_id AS b FROM embeddings
            UNION
            SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
        ), least AS (
            SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
        ), many AS (
            SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a
        )
        SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
        FROM least LEFT JOIN many USING (vec_id)
    """,
    "op13_lloyd": _lloyd_sql(),
    "op9_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY norm) AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept,
               sha256(norm) AS text_sha256
        FROM t
    """,
}
