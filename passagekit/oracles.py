"""DuckDB SQL for the queries of the library, written from the semantics and not from the plans."""

from __future__ import annotations

from .functions.text import COMMON_WORDS, MEDINAN_CHAPTERS, PART_STARTS
from .queries import ARABIC, LADDER, LATIN, LETTERS_FOR, PREFIXES, QUESTION, SPELT, STOP, SUFFIXES

_WS = r"\s+"
_TOK = rf"list_filter(string_split_regex(lower(coalesce(text, '')), '{_WS}'), lambda x: x <> '')"


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _stem(w: str) -> str:
    """SQL for one prefix and one suffix off, three letters left at least."""
    pre = " ".join(f"WHEN starts_with({w}, '{p}') AND length({w}) - {len(p)} >= 3 THEN substr({w}, {len(p) + 1})" for p in PREFIXES)
    return f"(CASE {pre} ELSE {w} END)"


def _stem_end(w: str) -> str:
    suf = " ".join(f"WHEN ends_with({w}, '{s}') AND length({w}) - {len(s)} >= 3 THEN substr({w}, 1, length({w}) - {len(s)})" for s in SUFFIXES)
    return f"(CASE {suf} ELSE {w} END)"


_LETTERS = "[^a-zß-ÿ]"
_SEG = rf"""
seg0 AS (SELECT DISTINCT substr(source, 4) || ':' || doc_id AS verse_id, doc_id AS doc, CAST(substr(source, 4) AS INT) AS s,
                regexp_replace(w, '{_LETTERS}', '', 'g') AS form
         FROM (SELECT doc_id, source, unnest({_TOK}) AS w FROM documents)),
seg1 AS (SELECT *, {_stem('form')} AS f1 FROM seg0 WHERE form <> ''),
seg AS (SELECT DISTINCT verse_id, doc, s, form, {_stem_end('f1')} AS root FROM seg1)"""
_POSTS = "posts AS (SELECT DISTINCT root, doc FROM seg), df AS (SELECT root, count(*) AS df FROM posts GROUP BY root)"
_QROOTS = rf"""
qw AS (SELECT qid, w, pos FROM (SELECT item_id AS qid, list_filter({_TOK}, lambda x: NOT list_contains({_list(STOP)}, x)) AS l FROM benchmark),
       LATERAL (SELECT unnest(l) AS w, generate_subscripts(l, 1) AS pos)),
qf AS (SELECT qid, pos, regexp_replace(w, '{_LETTERS}', '', 'g') AS form FROM qw),
qs AS (SELECT qid, pos, {_stem('form')} AS f1 FROM qf),
qg AS (SELECT qid, {_stem_end('f1')} AS root, min(pos) AS pos FROM qs GROUP BY ALL),
qroots AS (SELECT qid, root, row_number() OVER (PARTITION BY qid ORDER BY pos) - 1 AS ord FROM qg WHERE root <> '')"""
_WEIGHTS = "n AS (SELECT count(*)::DOUBLE AS n FROM documents), weights AS (SELECT qid, root, ord, ln(n / greatest(df, 1)) AS idf FROM qroots JOIN df USING (root), n)"
_CAND = """
cand0 AS (SELECT qid, doc, sum(idf) AS s, min(ord) AS o FROM weights JOIN posts USING (root) GROUP BY qid, doc),
cand AS (SELECT qid, doc, round(s, 4) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, o, doc) - 1 AS rank FROM cand0)"""
_IDX = rf"""
tok AS (SELECT doc_id AS doc, unnest({_TOK}) AS term FROM documents),
dl AS (SELECT doc_id AS doc, len({_TOK}) AS dl FROM documents),
st AS (SELECT count(*)::DOUBLE AS nn, avg(dl) AS avgdl FROM dl),
tf AS (SELECT term, doc, count(*) AS tf FROM tok GROUP BY ALL),
raw AS (SELECT term, count(*) AS df, ln(any_value(nn) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS r FROM tf, st GROUP BY term),
mean AS (SELECT avg(r) AS m FROM raw),
terms AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25e0 * m ELSE r END AS idf FROM raw, mean)"""


def _bm25(asked: str, k: int) -> str:
    """asked: SQL for (qid, term) rows, repeats included."""
    return rf"""{_IDX},
asked AS ({asked}),
sc AS (SELECT qid, doc, sum(idf * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS score
       FROM asked JOIN terms USING (term) JOIN tf USING (term) JOIN dl USING (doc), st GROUP BY qid, doc),
al AS (SELECT q.qid, dl.doc, coalesce(sc.score, 0e0) AS score FROM (SELECT DISTINCT qid FROM asked) q, dl LEFT JOIN sc ON sc.qid = q.qid AND sc.doc = dl.doc),
bm AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc) - 1 AS rank FROM al QUALIFY rank < {k})"""


_ONE = f"SELECT 0 AS qid, unnest(string_split('{QUESTION}', ' ')) AS term"
_BATCH = f"SELECT item_id AS qid, unnest({_TOK}) AS term FROM benchmark"
_CLEANED = rf"SELECT qid, unnest(CASE WHEN len(l) > 0 THEN l ELSE a END) AS term FROM (SELECT item_id AS qid, {_TOK} AS a, list_filter({_TOK}, lambda x: NOT list_contains({_list(STOP)}, x)) AS l FROM benchmark)"
_NEAR = """
q0 AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1),
near AS (SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q0)"""
_DENSE = "dense AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM near QUALIFY rank < 20)"
_RRF = """
f AS (SELECT coalesce(a.id, b.id) AS id, round(coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0), 6) AS score
      FROM dense a FULL JOIN sparse b ON a.id = b.id)
SELECT id, score FROM f ORDER BY score DESC, id LIMIT 10"""
_POOL = rf"""
r20 AS (SELECT qid, doc, score, rank, 0 AS src FROM cand WHERE rank < 20),
b16 AS (SELECT qid, doc, 0e0 AS score, rank, 1 AS src FROM bm),
u AS (SELECT * FROM r20 UNION ALL SELECT * FROM b16),
u1 AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY qid, doc ORDER BY src, rank) = 1),
pool AS (SELECT qid, doc, score, row_number() OVER (PARTITION BY qid ORDER BY src, rank) - 1 AS pos FROM u1 QUALIFY pos < 32)"""
_COV = """
tot AS (SELECT qid, sum(idf) AS t, count(*) AS n_roots FROM weights GROUP BY qid),
got AS (SELECT p.qid, p.doc, sum(w.idf) AS g FROM pairs p JOIN weights w USING (qid) JOIN posts o ON o.root = w.root AND o.doc = p.doc GROUP BY ALL),
cov AS (SELECT p.qid, p.doc, coalesce(coalesce(g, 0e0) / nullif(t, 0e0), 1e0) AS cov, coalesce(n_roots, 0) AS n_roots
        FROM pairs p LEFT JOIN tot USING (qid) LEFT JOIN got ON got.qid = p.qid AND got.doc = p.doc)"""
_MEDINAN = ", ".join(map(str, MEDINAN_CHAPTERS))
_STARTS = ", ".join(f"({k + 1}, {s * 1000 + a})" for k, (s, a) in enumerate(PART_STARTS))
_VOTES = {"en": "'the', 'of', 'and', 'to', 'in'", "fr": "'le', 'la', 'de', 'et', 'les'", "de": "'der', 'die', 'und', 'in', 'den'", "es": "'el', 'la', 'de', 'y', 'los'"}
_PERIOD = "CASE WHEN {t} LIKE '%makki%' OR {t} LIKE '%mecquoise%' OR {t} LIKE '%meccan%' THEN 'makkiyya' WHEN {t} LIKE '%madani%' OR {t} LIKE '%médinoise%' OR {t} LIKE '%medinan%' THEN 'madani' END"
_FEED = """fb AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_type AS message_index, CASE WHEN value >= 50 THEN 'up' ELSE 'down' END AS rating,
       props AS question, CAST(event_id AS VARCHAR) AS answer, {'a': ts, 'b': event_id} AS seq FROM events),
up AS (SELECT session_id, message_index, arg_max(rating, seq) AS rating, arg_min(question, seq) AS question, arg_min(answer, seq) AS answer FROM fb GROUP BY ALL)"""
_BLOCK = """'[' || (rn) || '] Surah ' || role || ' (' || conv_id || '), Verse ' || turn || ' [' || conv_id || ':' || turn || ']' || chr(10) || '    AR: ' || text
 || CASE WHEN turn % 2 = 0 AND text <> '' THEN chr(10) || '    EN: ' || text ELSE '' END"""
_BLOCKS = f"""c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
b AS (SELECT conv_id AS qid, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY turn) AS context,
      string_agg('[' || conv_id || ':' || turn || ']', ' ' ORDER BY turn) AS allowed, arg_min(text, turn) AS question,
      arg_min('[1] Surah ' || role || ' (' || conv_id || '), Verse ' || turn || ' [' || conv_id || ':' || turn || ']', turn) AS answer FROM c GROUP BY conv_id)"""
_VECTOR_BATCH = """SELECT qid, id, round(s, 6) AS score FROM (
        SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND {where})
        QUALIFY row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) <= {k}"""
_SAID = "nullif(lang, 'unknown')"
_CONTEXT = """p AS (SELECT doc_id AS id, CAST(substr(source, 4) AS INT) AS surah_number, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS pos FROM documents),
    around AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY surah_number, id) - 1 AS ord FROM (
        SELECT DISTINCT qid, b.id, b.surah_number FROM fused JOIN p a USING (id) JOIN p b ON a.surah_number = b.surah_number AND abs(a.pos - b.pos) <= 1))"""


def _hybrid(wanted: str, period: str, k: int) -> str:
    """fused (qid, id, score, rank < k): dense filtered before its limit, BM25 after. wanted: of a question's lang; period: of a document's."""
    return f"""{_bm25(_BATCH, 20)},
    said AS (SELECT item_id AS qid, CASE WHEN greatest(en, fr, de, es) = 0 THEN 'unknown' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS lang
             FROM (SELECT item_id, {', '.join(f"len(list_filter(string_split_regex(lower(text), '{_WS}'), lambda x: x IN ({v}))) AS {k_}" for k_, v in _VOTES.items())} FROM benchmark)),
    wish AS (SELECT qid, {wanted} AS w FROM said), kept AS (SELECT doc_id AS id, {period} AS p FROM documents),
    dn AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) - 1 AS rank FROM (
        SELECT wish.qid, kept.id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s
        FROM wish JOIN embeddings a ON a.vec_id = wish.qid, embeddings b JOIN kept ON b.vec_id = kept.id WHERE w IS NULL OR w = p) QUALIFY rank < 20),
    sp AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) - 1 AS rank FROM bm JOIN wish USING (qid) JOIN kept ON id = doc WHERE w IS NULL OR w = p),
    fu AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.id, b.id) AS id, round(coalesce(1e0 / (60 + a.rank), 0) + coalesce(1e0 / (60 + b.rank), 0), 6) AS score FROM dn a FULL JOIN sp b ON a.qid = b.qid AND a.id = b.id),
    fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) - 1 AS rank FROM fu QUALIFY rank < {k})"""


_VALUES = ", ".join(f"({k}, '{t}')" for k, t in enumerate(ARABIC))
_TASH = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{0640}]"

_SPELT = f"translate(lower(w), '{LATIN}', '{LETTERS_FOR}')"
for _old, _new in SPELT:
    _SPELT = f"replace({_SPELT}, '{_old}', '{_new}')"
_CLEAN = "replace(translate({t}, 'أإآٱىؤئ', 'اااايوي'), 'ء', '')"
_GRAMS = r"""list_filter(list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]), lambda g: trim(g) <> '')"""

ORACLES: dict[str, str] = {
    "normalize_search": rf"SELECT doc_id, translate(regexp_replace(regexp_replace(translate(regexp_replace(nfc_normalize(text), '{_TASH}', '', 'g'), 'أإآٱؤئ', 'ااااوي'), '^\s+|\s+$', '', 'g'), '[\x{{06D6}}-\x{{06ED}}]', '', 'g'), 'ىة', 'يه') AS norm FROM documents",
    "normalize_arabic": rf"""WITH v(k, t) AS (VALUES {_VALUES}), b AS (SELECT k, regexp_replace(t, '{_TASH}', '', 'g') AS t FROM v)
        SELECT k, trim(regexp_replace(replace(translate(t, 'أإآٱىؤئ', 'اااايوي'), 'ء', ''), '{_WS}', ' ', 'g')) AS clean,
               trim(translate(t, 'أإآٱؤئ', 'ااااوي')) AS root, translate(trim(translate(t, 'أإآٱؤئ', 'ااااوي')), 'ىة', 'يه') AS search FROM b""",
    "tokenize_counts": f"SELECT doc_id, len(l) AS n_tokens, len(list_distinct(l)) AS n_distinct FROM (SELECT doc_id, {_TOK} AS l FROM documents)",
    "script_and_filter_detect": f"""SELECT doc_id, regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') AS arabic, {_PERIOD.format(t='lower(text)')} AS period,
        CASE WHEN regexp_matches(text, '[\\x{{0600}}-\\x{{06FF}}]') THEN 'ar' WHEN greatest(en, fr, de, es) = 0 THEN 'unknown' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS language
        FROM (SELECT doc_id, text, {', '.join(f"len(list_filter(string_split_regex(lower(text), '{_WS}'), lambda x: x IN ({v}))) AS {k}" for k, v in _VOTES.items())} FROM documents)""",
    "heuristic_stem": f"""WITH w AS (SELECT DISTINCT unnest({_TOK}) AS form FROM documents), l AS (SELECT form, regexp_replace(form, '{_LETTERS}', '', 'g') AS w FROM w),
        p AS (SELECT form, {_stem('w')} AS w FROM l), s AS (SELECT form, {_stem_end('w')} AS w FROM p)
        SELECT form, array_to_string(string_split(w, ''), '-') AS stem FROM s""",
    "inverted_index": f"""WITH {_SEG}, f AS (SELECT root, string_agg(form, '|' ORDER BY form) AS forms FROM (SELECT DISTINCT root, form FROM seg) GROUP BY root),
        v AS (SELECT root, string_agg(verse_id, '|' ORDER BY s, doc) AS verses, count(*) AS count FROM (SELECT DISTINCT root, verse_id, s, doc FROM seg) GROUP BY root)
        SELECT root, forms, verses, count FROM f JOIN v USING (root)""",
    "verse_roots": f"""WITH {_SEG}, r AS (SELECT verse_id AS id, string_agg(root, '|' ORDER BY root) AS roots FROM (SELECT DISTINCT verse_id, root FROM seg) GROUP BY 1)
        SELECT substr(source, 4) || ':' || doc_id AS id, coalesce(roots, '') AS roots FROM documents LEFT JOIN r ON r.id = substr(source, 4) || ':' || doc_id""",
    "resolution_map": f"WITH {_SEG} SELECT form AS key, string_agg(root, '|' ORDER BY root) AS roots FROM (SELECT DISTINCT form, root FROM seg) GROUP BY form",
    "morphology_index": "SELECT * FROM (VALUES ('smw', 'ba|smi', '1:1|2:1', 2::BIGINT), ('Hmd', 'Hmd', '1:2', 1::BIGINT)) t(root, forms, verses, count)",
    "bm25_stats": f"""WITH tok AS (SELECT unnest(list_distinct({_TOK})) AS term FROM documents), n AS (SELECT count(*)::DOUBLE AS n FROM documents),
        raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5e0) - ln(count(*) + 0.5e0) AS r FROM tok, n GROUP BY term), mean AS (SELECT avg(r) AS m FROM raw)
        SELECT term, df, round(CASE WHEN r < 0 THEN 0.25e0 * m ELSE r END, 6) AS idf FROM raw, mean""",
    "bm25_blocks_topk": f"WITH {_bm25(_BATCH, 20)} SELECT qid, doc, round(score, 6) AS score FROM bm",
    "bm25_segments": f"WITH live AS (SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)), {_bm25(_BATCH, 20).replace('FROM documents', 'FROM live')} SELECT qid, doc, round(score, 6) AS score FROM bm",
    "vector_index_topk": _VECTOR_BATCH.format(where="true", k=5),
    "vector_index_filtered": _VECTOR_BATCH.format(where="b.label = 3", k=20).replace("AS score FROM", "AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) - 1 AS rank FROM", 1),
    "retrieve_hits": f"""WITH {_hybrid(_SAID, 'lang', 5)} SELECT qid, id, rank, score, md5(text) AS text FROM fused JOIN documents ON doc_id = id""",
    "retrieve_reranked": f"""WITH {_hybrid(_SAID, 'lang', 20)}, qt AS (SELECT item_id AS qid, list_distinct({_TOK}) AS a FROM benchmark), dt AS (SELECT doc_id AS id, list_distinct({_TOK}) AS b FROM documents),
        j AS (SELECT qid, id, rank AS pos, score, len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0) AS s FROM fused JOIN qt USING (qid) JOIN dt USING (id))
        SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, pos) - 1 AS rank, score, round(s, 6) AS rerank_score FROM j QUALIFY rank < 5""",
    "retrieve_context": f"WITH {_hybrid(_SAID, 'lang', 5)}, {_CONTEXT} SELECT qid, ord, id, surah_number FROM around",
    "converse_hits": f"""WITH {_hybrid("CASE WHEN lang = 'en' THEN 'madani' END", "CASE WHEN lang = 'en' THEN 'madani' ELSE 'makkiyya' END", 5)}, {_CONTEXT},
        h AS (SELECT qid, string_agg(id, '|' ORDER BY rank) AS hits FROM fused GROUP BY qid), c AS (SELECT qid, string_agg(id, '|' ORDER BY ord) AS sources, arg_min(id, ord) AS first FROM around GROUP BY qid)
        SELECT b.item_id AS qid, md5(text || CASE WHEN lang = 'en' THEN ' medinan' ELSE '' END) AS question, hits, sources,
               (SELECT '[1] Surah ' || source || ' (' || substr(source, 4) || '), Verse ' || doc_id || ' [' || doc_id || ']' FROM documents WHERE doc_id = first) AS answer
        FROM benchmark b JOIN said ON said.qid = b.item_id LEFT JOIN h ON h.qid = b.item_id LEFT JOIN c ON c.qid = b.item_id""",
    "match_many_forms": f"""WITH common(lang, ws) AS (VALUES {', '.join(f"('{k}', {_list(v)})" for k, v in COMMON_WORDS.items())}), items AS (SELECT DISTINCT w FROM (SELECT unnest({_TOK}) AS w FROM benchmark) WHERE length(w) >= 6),
        f AS (SELECT lang, w FROM common, items UNION SELECT lang, unnest(ws) FROM common), d AS (SELECT doc_id, lang, {_TOK} AS l FROM documents), dw AS (SELECT doc_id, lang, unnest(l) AS w, generate_subscripts(l, 1) - 1 AS i FROM d),
        hit AS (SELECT DISTINCT v.lang, v.w FROM (SELECT DISTINCT lang, w FROM dw) v JOIN f ON f.lang = v.lang AND contains(v.w, f.w)), m AS (SELECT doc_id, string_agg(i, '|' ORDER BY i) AS x, count(*) AS n FROM dw JOIN hit USING (lang, w) GROUP BY doc_id)
        SELECT doc_id, md5(coalesce(x, '')) AS match_indices, coalesce(n, 0) AS n FROM documents LEFT JOIN m USING (doc_id)""",
    "bm25_topk": f"WITH {_bm25(_ONE, 20)} SELECT doc, round(score, 6) AS score FROM bm",
    "bm25_topk_batch": f"WITH {_bm25(_BATCH, 20)} SELECT qid, doc, round(score, 6) AS score FROM bm",
    "vector_topk": f"WITH {_NEAR} SELECT id, score FROM near ORDER BY score DESC, id LIMIT 20",
    "vector_topk_filtered": f"WITH {_NEAR} SELECT id, score FROM near WHERE label = 3 ORDER BY score DESC, id LIMIT 20",
    "vector_topk_batch": _VECTOR_BATCH.format(where="true", k=5),
    "hybrid_rrf": f"WITH {_NEAR}, {_DENSE}, {_bm25(_ONE, 20)}, sparse AS (SELECT doc AS id, rank FROM bm), {_RRF}",
    "hybrid_rrf_postfilter": f"""WITH {_NEAR}, {_DENSE}, {_bm25(_ONE, 20)},
        sparse AS (SELECT doc AS id, row_number() OVER (ORDER BY rank) - 1 AS rank FROM bm JOIN documents ON doc_id = doc WHERE lang = 'en'), {_RRF}""",
    "root_coverage_topk": f"WITH {_SEG}, {_POSTS}, {_QROOTS}, {_WEIGHTS}, {_CAND} SELECT qid, doc, score FROM cand WHERE rank < 60",
    "coverage_fraction": f"WITH {_SEG}, {_POSTS}, {_QROOTS}, {_WEIGHTS}, {_bm25(_BATCH, 16)}, pairs AS (SELECT qid, doc FROM bm), {_COV} SELECT qid, doc, round(cov, 6) AS cov FROM cov",
    "similar_pipeline": f"""WITH {_SEG}, {_POSTS}, {_QROOTS}, {_WEIGHTS}, {_CAND}, {_bm25(_CLEANED, 16)}, {_POOL}, pairs AS (SELECT qid, doc FROM pool), {_COV},
        qt AS (SELECT item_id AS qid, list_distinct({_TOK}) AS a FROM benchmark), dt AS (SELECT doc_id AS doc, list_distinct({_TOK}) AS b FROM documents),
        j AS (SELECT qid, doc, pos, len(list_intersect(a, b))::DOUBLE / nullif(len(list_distinct(list_concat(a, b))), 0) AS s FROM pool JOIN qt USING (qid) JOIN dt USING (doc)),
        r0 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, pos) AS rk FROM j),
        r1 AS (SELECT r0.qid, r0.doc, cov, n_roots, rk, CASE WHEN n_roots > 0 THEN s * (0.25e0 + 0.75e0 * cov) ELSE s END AS score FROM r0 JOIN cov ON cov.qid = r0.qid AND cov.doc = r0.doc),
        r2 AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, rk) AS rk2, count(*) FILTER (cov >= 0.999e0) OVER (PARTITION BY qid) AS nf FROM r1),
        r3 AS (SELECT * FROM r2 WHERE n_roots < 2 OR nf < 3 OR cov >= 0.999e0),
        r4 AS (SELECT *, bool_or(score >= 0.01e0) OVER (PARTITION BY qid) AS hit, row_number() OVER (PARTITION BY qid ORDER BY rk2) AS rn FROM r3),
        r5 AS (SELECT * FROM r4 WHERE score >= 0.01e0 OR (NOT hit AND rn <= 3) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rk2) <= 10)
        SELECT qid, doc, round(score, 6) AS score, round(cov, 6) AS cov FROM r5""",
    "similar_pipeline_norerank": f"WITH {_SEG}, {_POSTS}, {_QROOTS}, {_WEIGHTS}, {_CAND}, {_bm25(_CLEANED, 16)}, {_POOL} SELECT qid, doc, round(score, 6) AS score, pos AS rank FROM pool WHERE pos < 10",
    "keep_first_union": """WITH d AS (SELECT * FROM documents JOIN labels USING (doc_id)),
        a AS (SELECT lang, doc_id AS id, 1e0 AS score, 0 AS src, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rank FROM d WHERE quality = 0),
        b AS (SELECT lang, doc_id AS id, 0e0 AS score, 1 AS src, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM d),
        u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY lang, id ORDER BY src, rank) = 1)
        SELECT lang, id, score, row_number() OVER (PARTITION BY lang ORDER BY src, rank) - 1 AS pos FROM u QUALIFY pos < 32""",
    "threshold_gate": """WITH r AS (SELECT o_custkey AS qid, o_orderkey AS doc, o_totalprice / 400000 AS s FROM orders),
        k AS (SELECT *, bool_or(s >= 0.9e0) OVER (PARTITION BY qid) AS hit, row_number() OVER (PARTITION BY qid ORDER BY s DESC, doc) AS rn FROM r)
        SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY rn) - 1 AS rank FROM k WHERE s >= 0.9e0 OR (NOT hit AND rn <= 3) QUALIFY rank < 5""",
    "lexical_lookup": f"""WITH {_SEG}, {_QROOTS}, first AS (SELECT qid, arg_min(root, ord) AS root FROM qroots GROUP BY qid),
        f AS (SELECT root, string_agg(form, '|' ORDER BY form) AS forms FROM (SELECT DISTINCT root, form FROM seg) GROUP BY root),
        v AS (SELECT root, list(verse_id ORDER BY s, doc) AS l, count(*) AS n FROM (SELECT DISTINCT root, verse_id, s, doc FROM seg) GROUP BY root)
        SELECT qid, root, coalesce(forms, '') AS forms, coalesce(n, 0) AS occurrences_count,
               array_to_string(CASE WHEN n <= 30 THEN l ELSE list_transform(range(30), lambda i: l[CAST(floor(i * (n / 30e0)) AS INT) + 1]) END, '|') AS sampled
        FROM first LEFT JOIN f USING (root) LEFT JOIN v USING (root)""",
    "even_sample": """SELECT source, array_to_string(CASE WHEN n <= 7 THEN l ELSE list_transform(range(7), lambda i: l[CAST(floor(i * (n / 7e0)) AS INT) + 1]) END, '|') AS ids
        FROM (SELECT source, list(doc_id ORDER BY doc_id) AS l, count(*) AS n FROM documents GROUP BY source)""",
    "exhaustive_lookup_indices": rf"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '{_WS}'), lambda x: x <> '') AS l FROM documents)
        SELECT doc_id, array_to_string(list_filter(range(len(l)), lambda i: contains(l[i + 1], 'reation') OR contains(l[i + 1], 'the') OR contains(l[i + 1], 'lich')), '|') AS match_indices FROM w""",
    "lookup_by_chapter": f"SELECT source AS chapter, count(*) AS n, string_agg(CAST(doc_id AS VARCHAR), '|' ORDER BY doc_id) AS verses FROM documents WHERE list_contains({_TOK}, 'the') GROUP BY source",
    "juz_range_lookup": f"""WITH b(part, k) AS (VALUES {_STARTS}), o AS (SELECT o_orderkey, o_orderkey % 114 + 1 AS s, o_custkey % 286 + 1 AS a FROM orders)
        SELECT o_orderkey, s || ':' || a AS id, s * 1000 + a AS point, CAST(part AS BIGINT) AS part, CASE WHEN s IN ({_MEDINAN}) THEN 'madani' ELSE 'makkiyya' END AS period
        FROM o ASOF JOIN b ON o.s * 1000 + o.a >= b.k""",
    "dimension_enrich": """SELECT c_custkey, coalesce(n_name, '') AS nation, coalesce(r_name, '') AS region
        FROM customer LEFT JOIN (SELECT * FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA') ON c_nationkey = n_nationkey""",
    "translate_join": """SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'fr' AND n_chars % 2 = 0 THEN length(text) ELSE 0 END AS fr,
        CASE WHEN lang = 'en' AND n_chars % 2 = 0 THEN length(text) ELSE 0 END AS en FROM documents""",
    "neighbors": """SELECT conv_id, turn, array_to_string(list(turn) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), '|') AS context FROM conversations""",
    "neighbor_context": """WITH p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM conversations)
        SELECT DISTINCT a.conv_id, a.turn FROM p a JOIN p h ON a.conv_id = h.conv_id AND abs(a.pos - h.pos) <= 1 WHERE len(list_filter(string_split_regex(lower(h.text), '\\s+'), lambda x: x IN ('reation', 'thing', 'ertion'))) > 0""",
    "prev_next": """SELECT conv_id || ':' || turn AS id, lag(conv_id || ':' || turn) OVER w AS prev_id, lead(conv_id || ':' || turn) OVER w AS next_id FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""",
    "chapter_list": "SELECT conv_id, arg_min(role, turn) AS role, md5(arg_min(text, turn)) AS text, count(*) AS verse_count FROM conversations GROUP BY conv_id",
    "chapter_detail": "SELECT conv_id, turn, role, text, count(*) OVER () AS verse_count FROM conversations WHERE conv_id = 3",
    "session_append": """WITH c AS (SELECT conv_id, arg_min(text, turn) AS q, arg_max(text, turn) AS a, coalesce(max(turn) FILTER (role = 'user'), -1) AS last FROM conversations GROUP BY conv_id)
        SELECT CAST(conv_id AS VARCHAR) AS session_id, last + 1 AS idx, 'user' AS role, md5(q) AS content, '[]' AS sources FROM c
        UNION ALL SELECT CAST(conv_id AS VARCHAR), last + 2, 'assistant', md5(a), '[]' FROM c""",
    "session_history": "SELECT CAST(conv_id AS VARCHAR) AS session_id, turn AS idx, role, 1::BIGINT AS n_sources, '1:' || turn AS first_source FROM conversations",
    "feedback_upsert": f"WITH {_FEED} SELECT session_id, message_index, rating, question, answer FROM up",
    "feedback_stats": f"WITH {_FEED} SELECT count(*) FILTER (rating = 'up') AS up, count(*) FILTER (rating = 'down') AS down, count(*) AS total FROM up",
    "conversation_titles": rf"""WITH u AS (SELECT conv_id, turn, trim(regexp_replace(text, '{_WS}', ' ', 'g')) AS t FROM conversations WHERE role = 'user' AND trim(regexp_replace(text, '{_WS}', ' ', 'g')) <> ''),
        f AS (SELECT conv_id, arg_min(t, turn) AS t FROM u GROUP BY conv_id), m AS (SELECT conv_id, max(turn) AS updated_at FROM conversations GROUP BY conv_id)
        SELECT conv_id, coalesce(CASE WHEN length(t) > 48 THEN rtrim(substr(t, 1, 48)) || '…' ELSE t END, 'New conversation') AS title, updated_at FROM m LEFT JOIN f USING (conv_id)""",
    "retry_truncation": """SELECT conv_id, turn, role FROM (SELECT *, max(turn) FILTER (role = 'user') OVER (PARTITION BY conv_id) AS l FROM conversations) WHERE l IS NULL OR turn < l""",
    "json_sources_roundtrip": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '' AS absent, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS again FROM events""",
    "query_expand": f"""WITH {_SEG}, {_QROOTS}, first AS (SELECT qid, arg_min(root, ord) AS root FROM qroots GROUP BY qid),
        f AS (SELECT root, list(form ORDER BY form)[1:8] AS l FROM (SELECT DISTINCT root, form FROM seg) GROUP BY root),
        v AS (SELECT item_id AS qid, text, {', '.join(f"len(list_filter(string_split_regex(lower(text), '{_WS}'), lambda x: x IN ({v}))) AS {k}" for k, v in _VOTES.items())} FROM benchmark)
        SELECT qid, md5(CASE WHEN qid % 2 = 0 THEN trim(regexp_replace(text, '\\s+', ' ', 'g')) || ' كتاب' ELSE regexp_replace(text, '^\\s+|\\s+$', '', 'g') END) AS normalized,
               CASE WHEN qid % 2 = 0 THEN 'ar' WHEN greatest(en, fr, de, es) = 0 THEN 'unknown' WHEN en >= greatest(fr, de, es) THEN 'en' WHEN fr >= greatest(de, es) THEN 'fr' WHEN de >= es THEN 'de' ELSE 'es' END AS language,
               {_PERIOD.format(t='lower(text)')} AS period, CASE WHEN qid % 2 = 0 THEN coalesce(array_to_string(l, '|'), '') ELSE '' END AS terms
        FROM v LEFT JOIN first USING (qid) LEFT JOIN f USING (root)""",
    "merge_filters": "SELECT doc_id, CASE WHEN lang = 'fr' THEN 'madani' WHEN doc_id % 3 = 0 THEN 'makkiyya' END AS period FROM documents",
    "format_context": f"WITH {_BLOCKS} SELECT qid, context FROM b",
    "chat_prompt": f"""WITH {_BLOCKS} SELECT qid, md5('Passages:' || chr(10) || context || chr(10) || chr(10) || 'Refer to nothing but ' || allowed || '.' || chr(10) || 'Question: ' || question) AS message, answer FROM b""",
    "data_quality_counters": f"SELECT count(*) AS n, count(DISTINCT source) AS sources, count(*) FILTER (coalesce(text, '') = '') AS empty, count(*) FILTER (len({_TOK}) < 5) AS short FROM documents",
    "payload_projection": "SELECT vec_id AS id, label, len(embedding) AS dim FROM embeddings",
    "vector_upsert_lastwins": "SELECT vec_id // 10 AS id, max(vec_id) AS vec_id FROM embeddings GROUP BY 1",
    "eval_metrics": f"""WITH {_bm25(_BATCH, 20)}, q AS (SELECT item_id AS qid, ({_TOK})[-1] AS w FROM benchmark),
        rel AS (SELECT DISTINCT qid, doc FROM q JOIN tok ON term = w), e AS (SELECT qid, count(*) AS n, count(rank) AS g, min(rank) AS f FROM rel LEFT JOIN bm USING (qid, doc) GROUP BY qid)
        SELECT round(avg(CASE WHEN g > 0 THEN 1e0 ELSE 0e0 END), 6) AS hit_rate, round(avg(g / n::DOUBLE), 6) AS recall, round(avg(coalesce(1e0 / (f + 1), 0e0)), 6) AS mrr FROM e""",
    "stem_index": f"""WITH w AS (SELECT DISTINCT doc_id, unnest({_TOK}) AS form FROM documents), l AS (SELECT doc_id, form, regexp_replace(form, '{_LETTERS}', '', 'g') AS w FROM w),
        p AS (SELECT doc_id, form, {_stem('w')} AS w FROM l), s AS (SELECT doc_id, form, {_stem_end('w')} AS w FROM p WHERE length(w) >= 2)
        SELECT array_to_string(string_split(w, ''), '-') AS root, md5(string_agg(DISTINCT form, '|' ORDER BY form)) AS forms, count(DISTINCT doc_id) AS count FROM s GROUP BY 1""",
    "content_roots": rf"""WITH {_SEG}, w AS (SELECT item_id AS qid, unnest(l) AS w, generate_subscripts(l, 1) AS pos FROM (SELECT item_id, list_filter({_TOK}, lambda x: NOT list_contains({_list(STOP)}, x)) AS l FROM benchmark)),
        ends AS (SELECT unnest({_list(LADDER)}) AS e, generate_subscripts({_list(LADDER)}, 1) AS k), starts AS (SELECT unnest({_list(PREFIXES)}) AS e, generate_subscripts({_list(PREFIXES)}, 1) + {len(LADDER)} AS k),
        tries AS (SELECT qid, pos, 0 AS k, w AS t FROM w UNION ALL SELECT qid, pos, k, substr(w, 1, length(w) - length(e)) FROM w JOIN ends ON ends_with(w, e) AND length(w) - length(e) >= 2
            UNION ALL SELECT qid, pos, k, substr(w, length(e) + 1) FROM w JOIN starts ON starts_with(w, e) AND length(w) - length(e) >= 2),
        known AS (SELECT DISTINCT root AS t, root, 0 AS n FROM seg UNION ALL SELECT DISTINCT form, root, 1 FROM seg),
        hits AS (SELECT qid, pos, k, root, n FROM tries JOIN known USING (t)), best AS (SELECT * FROM hits QUALIFY k = min(k) OVER (PARTITION BY qid, pos)),
        first AS (SELECT qid, root, min(pos * 1000 + n) AS p FROM best GROUP BY qid, root)
        SELECT qid, root, row_number() OVER (PARTITION BY qid ORDER BY p) - 1 AS ord FROM first""",
    "word_lookup": f"""WITH {_SEG}, {_QROOTS}, q AS (SELECT * FROM qroots WHERE root IN (SELECT root FROM seg)), n AS (SELECT qid, string_agg(root, ' / ' ORDER BY ord) AS root FROM q GROUP BY qid),
        t AS (SELECT qid, count(DISTINCT doc) AS total FROM q JOIN seg USING (root) GROUP BY qid)
        SELECT item_id AS qid, coalesce(root, '') AS root, root IS NOT NULL AS root_found, coalesce(total, 0) AS total FROM benchmark LEFT JOIN n ON item_id = n.qid LEFT JOIN t ON item_id = t.qid""",
    "verse_detail": """WITH v AS (SELECT conv_id, turn, conv_id || ':' || turn AS id FROM conversations),
        x AS (SELECT *, lag(id) OVER w AS prev_id, lead(id) OVER w AS next_id FROM v WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        SELECT id, prev_id, next_id, concat_ws('|', prev_id, id, next_id) AS context FROM x WHERE conv_id = 3 AND turn = 1""",
    "api_projection": """SELECT conv_id || ':' || turn AS id, md5(CASE WHEN role = 'assistant' THEN text ELSE '' END) AS tashkil,
        CASE WHEN role = 'user' THEN length(text) / 4e0 ELSE turn / 2e0 END AS relevance_score FROM conversations""",
    "retrieval_query": rf"""SELECT item_id AS qid, md5(trim(regexp_replace(text || ' ' || array_to_string(list_filter({_TOK}, lambda x: length(x) > 6)[1:6], ' ') || CASE WHEN length(text) > 200 THEN ' a passage' ELSE '' END, '{_WS}', ' ', 'g'))) AS query FROM benchmark""",
    "ingest_quality": f"""WITH r AS (SELECT o_custkey % 120 AS s, o_orderstatus AS st FROM orders)
        SELECT count(*) AS n, count(DISTINCT s) AS chapters, count(*) FILTER (st = 'O') AS empty_clean, count(*) FILTER (NOT (s IN ({_MEDINAN}) OR s BETWEEN 1 AND 114)) AS no_period,
               count(*) FILTER (s NOT IN (SELECT n_nationkey FROM nation)) AS no_name, count(*) FILTER (st = 'P') AS no_roots FROM r""",
    "csv_records": rf"""SELECT conv_id || ':' || turn AS id, conv_id AS surah_number, role AS surah_name_ar, turn AS ayah_number, md5(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS text, 0 AS fr, 0 AS juz, 0 AS n_roots FROM conversations""",
    "vocalized_csv": "SELECT CAST(substr(source, 4) AS INT) AS surah_number, length(lang) AS ayah_number, max(doc_id) AS last, source AS surah_name FROM documents GROUP BY source, length(lang)",
    "json_records": "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(substr(source, 4) AS INT) AS surah_number, CAST(doc_id AS INT) AS ayah_number, lang AS period, md5(text) AS text, true AS no_juz FROM documents",
    "translation_maps": f"""WITH t AS (SELECT doc_id, lang, array_to_string(({_TOK})[1:5], ' ') AS t FROM documents)
        SELECT CAST(doc_id AS VARCHAR) AS id, CASE WHEN lang = 'fr' THEN t ELSE '' END AS translation_fr, CASE WHEN lang = 'en' THEN t ELSE '' END AS translation_en FROM t""",
    "edition_json": "SELECT conv_id || ':' || turn AS id, role AS text FROM conversations",
    "normalize_words": rf"""WITH w AS (SELECT DISTINCT unnest({_TOK}) AS w FROM documents), t AS (SELECT w, {_SPELT} AS t FROM w), b AS (SELECT w, t, regexp_replace(nfc_normalize(t), '{_TASH}', '', 'g') AS b FROM t)
        SELECT w, md5(t) AS t, {_CLEAN.format(t='b')} AS clean, {_CLEAN.format(t="translate(b, 'أإؤئ', 'ءءءء')")} AS fold, translate(b, 'أإآٱؤئ', 'ااااوي') AS root, translate(translate(b, 'أإآٱؤئ', 'ااااوي'), 'ىة', 'يه') AS search FROM b""",
    "morphology_words": f"""WITH {_SEG}, m AS (SELECT verse_id, s, doc, form, CASE WHEN length(form) > 8 THEN substr(form, 2, 3) ELSE substr(form, 1, 3) END AS root FROM seg0 WHERE length(form) > 4 OR length(form) = 1),
        f AS (SELECT root, md5(string_agg(form, '|' ORDER BY form)) AS forms FROM (SELECT DISTINCT root, form FROM m) GROUP BY root),
        v AS (SELECT root, md5(string_agg(verse_id, '|' ORDER BY s, doc)) AS verses, count(*) AS count FROM (SELECT DISTINCT root, verse_id, s, doc FROM m) GROUP BY root)
        SELECT root, forms, verses, count FROM f JOIN v USING (root)""",
    "vector_table": _VECTOR_BATCH.format(where="b.label = 3", k=20).replace("AS score FROM", "AS score, row_number() OVER (PARTITION BY qid ORDER BY s DESC, id) - 1 AS rank FROM", 1),
    "streamed_index": f"WITH {_bm25(_BATCH, 20)} SELECT qid, doc, round(score, 6) AS score FROM bm",
    "streamed_sessions": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS k FROM events)
        SELECT CAST(user_id AS VARCHAR) AS session_id, 2 * k AS idx, 'user' AS role, md5(event_type) AS content, '[]' AS sources, round(value, 6) AS created_at FROM e
        UNION ALL SELECT CAST(user_id AS VARCHAR), 2 * k + 1, 'assistant', md5(props), '[]', round(value, 6) FROM e""",
    "passage_texts": """WITH t AS (SELECT doc_id, CASE WHEN lang = 'en' THEN '' ELSE source END AS a, lang AS b FROM documents)
        SELECT doc_id, concat_ws(' ', nullif(a, ''), nullif(b, '')) AS index_text, 'passage: ' || coalesce(nullif(a, ''), '') AS passage, 'query: ' || b AS query, coalesce(nullif(a, ''), nullif(b, ''), '') AS first FROM t""",
    "detect_language_profiles": rf"""WITH p AS (SELECT doc_id, lang, substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS held_out, string_split(' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) || ' ', '') AS c FROM documents),
        g AS (SELECT doc_id, lang, held_out, unnest({_GRAMS}) AS gram FROM p), n AS (SELECT lang, gram, count(*) AS c FROM g WHERE NOT held_out AND lang IS NOT NULL GROUP BY ALL),
        kept AS (SELECT DISTINCT gram FROM (SELECT lang, gram FROM n QUALIFY row_number() OVER (PARTITION BY lang ORDER BY c DESC, gram) <= 2000)), langs AS (SELECT DISTINCT lang FROM n),
        x AS (SELECT gram, langs.lang, coalesce(n.c, 0) AS c FROM kept CROSS JOIN langs LEFT JOIN n USING (lang, gram)), s AS (SELECT lang, sum(c) AS t, count(*) AS v FROM x GROUP BY lang),
        prof AS (SELECT gram, lang, ln((c + 0.5e0) / (t + 0.5e0 * v)) AS lp FROM x JOIN s USING (lang)), tf AS (SELECT doc_id, gram, count(*) AS tf FROM g GROUP BY ALL),
        sc AS (SELECT doc_id, prof.lang, sum(tf * lp) AS s, sum(tf) AS grams FROM tf JOIN prof USING (gram) GROUP BY ALL), best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, lang) = 1)
        SELECT d.doc_id, substr(md5(CAST(d.doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2', '3') AS held_out, CASE WHEN regexp_matches(d.text, '[\x{{0600}}-\x{{06FF}}]') THEN 'ar' ELSE coalesce(best.lang, 'unknown') END AS language, coalesce(grams, 0)::BIGINT AS grams
        FROM documents d LEFT JOIN best ON best.doc_id = d.doc_id""",
    "stem_branch": f"""WITH {_SEG}, w AS (SELECT DISTINCT unnest({_TOK}) AS word FROM benchmark), k AS (SELECT DISTINCT root FROM seg), fm AS (SELECT DISTINCT form, root FROM seg WHERE length(form) > 5),
        h AS (SELECT word, root, 0 AS o FROM w JOIN k ON root = word UNION ALL SELECT word, root, 1 FROM w JOIN fm ON form = word), h1 AS (SELECT word, root, min(o) AS o FROM h GROUP BY ALL),
        a AS (SELECT word, string_agg(root, '|' ORDER BY o, root) AS roots FROM h1 GROUP BY word),
        l AS (SELECT word, regexp_replace(word, '{_LETTERS}', '', 'g') AS w FROM w), p AS (SELECT word, {_stem('w')} AS w FROM l), s AS (SELECT word, {_stem_end('w')} AS w FROM p)
        SELECT s.word, coalesce(a.roots, k.root, '') AS roots FROM s LEFT JOIN a ON a.word = s.word LEFT JOIN k ON k.root = s.w""",
    "key_lookup": f"WITH {_bm25(_BATCH, 5)} SELECT qid, doc AS id, source, n_chars, rank FROM bm JOIN documents ON doc_id = doc",
    "conversation_store": """WITH ev AS (SELECT event_id AS seq, CAST(user_id AS VARCHAR) AS id, event_type, CASE WHEN event_type IN ('signup', 'view') THEN 'create' WHEN event_type = 'purchase' AND value > 60 THEN 'delete' ELSE 'save' END AS op FROM events),
        c AS (SELECT id, min(seq) AS c FROM ev WHERE op = 'create' GROUP BY id), dd AS (SELECT id, min(seq) AS d FROM ev JOIN c USING (id) WHERE op = 'delete' AND seq > c GROUP BY id),
        s AS (SELECT id, seq, event_type FROM ev JOIN c USING (id) LEFT JOIN dd USING (id) WHERE op = 'save' AND seq > c AND (d IS NULL OR seq < d)),
        l AS (SELECT id, max(seq) AS u, arg_max(event_type, seq) AS t FROM s GROUP BY id), mv AS (SELECT seq, id FROM s UNION ALL SELECT c, id FROM c), lm AS (SELECT arg_max(id, seq) AS id, max(seq) AS seq FROM mv),
        a AS (SELECT CASE WHEN (SELECT count(*) FROM ev, lm WHERE op = 'delete' AND ev.id = lm.id AND ev.seq > lm.seq) > 0 THEN NULL ELSE id END AS active FROM lm)
        SELECT c.id, coalesce(t, 'New conversation') AS title, CASE WHEN t IS NULL THEN 0 ELSE 1 END AS n, c.c::DOUBLE AS created_at, coalesce(u, c.c)::DOUBLE AS updated_at, active
        FROM c LEFT JOIN dd USING (id) LEFT JOIN l USING (id), a WHERE d IS NULL""",
    "history_fallback": "SELECT role, md5(text) AS content FROM conversations WHERE conv_id = 3 ORDER BY turn",
    "analysis": f"""WITH {_SEG}, {_QROOTS}, first AS (SELECT qid, arg_min(root, ord) AS root FROM qroots GROUP BY qid),
        v AS (SELECT root, list(verse_id ORDER BY s, doc) AS l, count(*) AS n FROM (SELECT DISTINCT root, verse_id, s, doc FROM seg) GROUP BY root),
        k AS (SELECT qid, root, n, CASE WHEN n <= 30 THEN l ELSE list_transform(range(30), lambda i: l[CAST(floor(i * (n / 30e0)) AS INT) + 1]) END AS x FROM first LEFT JOIN v USING (root))
        SELECT qid, root, coalesce(n, 0) > 0 AS found, CASE WHEN coalesce(n, 0) > 0 THEN '[1] Surah src' || split_part(x[1], ':', 1) || ' (' || split_part(x[1], ':', 1) || '), Verse ' || split_part(x[1], ':', 2) || ' [' || x[1] || ']' ELSE '' END AS answer,
               CASE WHEN coalesce(n, 0) > 0 THEN array_to_string(x[1:12], '|') END AS key_verses FROM k""",
    "hook_scores": f"""WITH {_bm25(_BATCH, 16)}, j AS (SELECT qid, doc, rank AS pos, n_chars, max(n_chars) OVER (PARTITION BY qid) > 20000 AS bad FROM bm JOIN documents ON doc_id = doc)
        SELECT qid, doc, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN bad THEN 0 ELSE n_chars END, pos) - 1 AS rank, CASE WHEN NOT bad THEN -n_chars::DOUBLE END AS rerank_score, n_chars > 20000 AS failed FROM j QUALIFY rank < 5""",
    "ingest_report": f"""WITH {_SEG}, said AS (SELECT DISTINCT (conv_id % 114 + 1) || ':' || turn AS id FROM conversations WHERE role = 'user' AND role <> ''),
        fr AS (SELECT count(*) FILTER ((conv_id % 114 + 1) || ':' || turn IN (SELECT id FROM said)) AS fr, 0 AS en FROM conversations),
        r AS (SELECT 'records' AS stage, (SELECT count(*) FROM conversations) AS rows UNION ALL SELECT 'root_index', (SELECT count(DISTINCT root) FROM seg) UNION ALL SELECT 'forms', (SELECT count(DISTINCT form) FROM seg) UNION ALL SELECT 'lemmas', (SELECT count(DISTINCT form) FROM seg))
        SELECT stage, rows, fr, en FROM r, fr""",
    "server_events": """SELECT conv_id, turn, 'data: {"type":"' || role || '","n":' || turn || '}' || chr(10) || chr(10) AS line FROM conversations""",
    "hit_projection": f"""WITH {_bm25(_BATCH, 5)}, r AS (SELECT * FROM documents WHERE lang <> 'en' OR doc_id <= 100)
        SELECT qid, doc AS id, round(score, 6) AS score, CAST(substr(source, 4) AS INT) AS surah_number, CAST(doc_id AS INT) AS ayah_number, lang AS period, md5(text) AS text FROM bm LEFT JOIN r ON doc_id = doc""",
    "arabic_numbers": "SELECT o_orderkey, translate(CAST(o_custkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS digits FROM orders",
    "stored_conversations": "SELECT lang || '-' || doc_id AS id, source AS title FROM documents WHERE lang <> 'fr' AND source <> 'src3'",
}
