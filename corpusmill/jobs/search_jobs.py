"""Retrieval queries over the driver's tables: documents are blocks, benchmark items are
questions, one exemplar per label is a vector query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as T
from corpusmill.functions.plans import broadcast_if_small, ranked, top_k
from corpusmill.jobs.indexes import SENT_BITS, index_of, sentence_rows
from corpusmill.jobs.indexes import documents as blocks
from corpusmill.operators import fusion, retrieval, vectors
from corpusmill.operators import lexical_index as L
from corpusmill.sources import tables

TOP = 10


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), "text")


def doc_of(sentence_id):
    return F.shiftright(sentence_id, SENT_BITS)


def index_manifest(spark, sf_dir):
    """Figures of the written indexes of documents; writes them where there are none."""
    index = index_of(spark, sf_dir, "documents")
    n_terms = index.terms().agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"))
    return n_terms.select(F.lit(index.n_blocks).alias("n_blocks"), F.lit(index.manifest["n_tokens"]).alias("n_tokens"), F.lit(index_of(spark, sf_dir, "document_words").manifest["n_words"]).alias("n_words"), "n_terms", "n_postings")


def postings_topk(spark, sf_dir):
    terms = retrieval.query_terms(questions(spark, sf_dir))
    return L.best_tf(index_of(spark, sf_dir, "documents"), terms, TOP).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def strong_postings_topk(spark, sf_dir):
    terms = retrieval.strong_terms(retrieval.query_terms(questions(spark, sf_dir)))
    return L.best_tf(index_of(spark, sf_dir, "documents"), terms, TOP).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def term_df(spark, sf_dir):
    return index_of(spark, sf_dir, "documents").terms().select("term", "df", "cf")


def doc_length_stats(spark, sf_dir):
    n = F.size(T.index_tokens(F.col("text")))
    return blocks(spark, sf_dir).select(n.alias("n")).agg(
        F.count("*").alias("n_docs"), F.sum("n").cast("long").alias("total"), F.round(F.avg("n"), 6).alias("avg_len"), F.min("n").cast("long").alias("min_len"), F.max("n").cast("long").alias("max_len"),
    )


def bm25_topk(spark, sf_dir):
    found = L.best_bm25(index_of(spark, sf_dir, "document_words"), questions(spark, sf_dir), TOP)
    return found.select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def bm25_sentence_topn(spark, sf_dir):
    rows = L.best_bm25(index_of(spark, sf_dir, "sentences"), questions(spark, sf_dir), 5)
    return rows.select(F.col("qid").alias("item_id"), "rank", F.shiftright("id", 31).alias("doc_id"), F.col("id").bitwiseAND((1 << 31) - 1).alias("sent_idx"), "score")


def _exemplars(spark, sf_dir):
    """The vectors, and of each label that of the smallest id as a query."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    first = rows.groupBy("label").agg(F.min(F.struct("vec_id", "embedding")).alias("x"))
    return rows.select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), first.select(F.col("x.vec_id").alias("qid"), F.col("x.embedding").alias("v"))


def cosine_topk(spark, sf_dir):
    rows, queries = _exemplars(spark, sf_dir)
    return vectors.cosine_top_k(rows, queries, TOP).select("qid", "rank", F.col("id").alias("vec_id"), "score")


def _lists(spark, sf_dir, n=40):
    docs, asked = blocks(spark, sf_dir), questions(spark, sf_dir)
    lexical = L.best_bm25(index_of(spark, sf_dir, "document_words"), asked, n)
    return lexical, vectors.hashing_top_k(docs, asked, n)


def hashing_topk(spark, sf_dir):
    rows = vectors.hashing_top_k(blocks(spark, sf_dir), questions(spark, sf_dir), TOP)
    return rows.select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def rrf_topn_outer(spark, sf_dir):
    return retrieval.best(fusion.reciprocal_ranks(*_lists(spark, sf_dir)), TOP).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def rrf_weighted(spark, sf_dir):
    return retrieval.best(fusion.reciprocal_ranks(*_lists(spark, sf_dir), weights=(0.8, 0.2)), TOP).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def rrf_full_topk(spark, sf_dir):
    """The ten best by reciprocal ranks over all blocks, in both orders of all of them."""
    index, asked = index_of(spark, sf_dir, "document_words"), questions(spark, sf_dir)
    rows = fusion.full_reciprocal_ranks(vectors.hashed_scores(index.blocks(), asked), L.bm25_scores(index, asked))
    return retrieval.best(rows, TOP).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "dense_rank", "lexical_rank", "score")


def block_numbers(spark, sf_dir):
    """All documents as files of a path by language and source, cut into numbered blocks."""
    path = F.concat_ws("/", F.coalesce("lang", F.lit("none")), F.coalesce("source", F.lit("none")), F.lpad(F.col("doc_id").cast("string"), 10, "0"))
    texts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(path.alias("path"), F.col("lang").alias("category"), "text")
    return tables.numbered_blocks(tables.blocks(texts)).select("source_file", "chunk_index", "number", "block_id")


def bm25_case_topn(spark, sf_dir):
    """The three best turns of each conversation for its first user turn, against the
    conversation's own turns alone."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.where("role = 'user'").groupBy(F.col("conv_id").alias("case")).agg(F.min_by("text", "turn").alias("text"))
    rows = retrieval.bm25_case_scores(turns.select(F.col("conv_id").alias("case"), F.col("turn").alias("id"), "text"), asked)
    return top_k(rows, ["case"], [F.col("score").desc(), F.col("id")], 3).select(F.col("case").alias("conv_id"), "rank", F.col("id").alias("turn"), "score")


def candidate_union(spark, sf_dir):
    """Dense candidates joined with strong-term and all-term hits, as the rescue
    strategies combine them."""
    docs, asked = blocks(spark, sf_dir), questions(spark, sf_dir)
    terms = retrieval.query_terms(asked)
    dense = vectors.hashing_top_k(docs, asked, 40)
    lists = retrieval.strong_terms(terms).withColumn("list", F.lit("strong")).unionByName(terms.withColumn("list", F.lit("plain")))
    found = L.best_tf(index_of(spark, sf_dir, "documents"), lists, 40, ("list", "qid"))
    strong, plain = (found.where(F.col("list") == name).drop("list") for name in ("strong", "plain"))
    return retrieval.best(fusion.candidate_union(dense, strong, plain), TOP).select(F.col("qid").alias("item_id"), "rank", F.col("id").alias("doc_id"), "score")


def tier_fallback(spark, sf_dir):
    """Blocks with three or more of a question's strong terms; else any strong term, the
    best 200; else any term. One lookup of all terms, strong ones counted apart."""
    terms = retrieval.query_terms(questions(spark, sf_dir))
    strong = retrieval.strong_terms(terms).select("qid", "term", F.lit(True).alias("strong"))
    asked = terms.select("qid", "term").join(strong, ["qid", "term"], "left")
    hits = L.Wanted(asked).joined(index_of(spark, sf_dir, "documents").postings())
    both = hits.groupBy("qid", "id").agg(F.sum("tf").alias("plain"), F.sum(F.when(F.col("strong"), F.col("tf"))).alias("some"), F.count_if("strong").alias("n"))
    tier = F.when(F.col("n") >= 3, 1).when(F.col("n") > 0, 2).otherwise(3)
    first = both.groupBy("qid").agg(F.min(tier).alias("tier"))
    rows = both.join(broadcast_if_small(first), "qid").where(tier <= F.col("tier"))
    scored = rows.select("qid", "tier", "id", F.when(F.col("tier") == 3, F.col("plain")).otherwise(F.col("some")).cast("double").alias("score"))
    kept = top_k(scored.where("tier > 1"), ["qid"], [F.col("score").desc(), F.col("id")], 200).drop("rank").unionByName(scored.where("tier = 1"))
    return kept.groupBy(F.col("qid").alias("item_id"), "tier").agg(F.count("*").alias("n"), F.max("score").alias("best"))


def _document_lists(spark, sf_dir):
    rows = L.best_bm25(index_of(spark, sf_dir, "sentences"), questions(spark, sf_dir), 40)
    rows = rows.withColumn("doc", doc_of(F.col("id")))
    return ranked(rows, ["qid", "doc"], [F.col("score").desc(), F.col("id")], "doc_rank")


def doc_aggregation(spark, sf_dir):
    """The three best documents per question, by each way to sum up sentence scores."""
    scores = fusion.document_scores(_document_lists(spark, sf_dir)).unpivot(["qid", "doc"], ["sum", "max", "top3"], "how", "score")
    best = top_k(scores, ["how", "qid"], [F.col("score").desc(), F.col("doc")], 3)
    return best.select("how", F.col("qid").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


def doc_min_max(spark, sf_dir):
    """Documents by the scaled sum of their best sentence and of their three best."""
    both = fusion.document_scores(_document_lists(spark, sf_dir))
    scaled = both.withColumn("score", F.round(fusion.min_max(both, "max") + fusion.min_max(both, "top3"), 6))
    return top_k(scaled, ["qid"], [F.col("score").desc(), F.col("doc")], 3).select(F.col("qid").alias("item_id"), "rank", F.col("doc").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (
    index_manifest, postings_topk, strong_postings_topk, term_df, doc_length_stats, bm25_topk, bm25_sentence_topn, cosine_topk, hashing_topk, rrf_topn_outer, rrf_weighted, rrf_full_topk, block_numbers, bm25_case_topn,
    candidate_union, tier_fallback, doc_aggregation, doc_min_max,
)}

# r: BM25 of each turn for its conversation's first user turn, q0.
CASE_BM25 = """
w AS (SELECT conv_id AS c, turn AS id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM conversations),
s AS (SELECT c, count(*) AS n, avg(len(coalesce(w, []))) AS avgdl FROM w GROUP BY c), t AS (SELECT c, id, len(w) AS dl, unnest(w) AS term FROM w), f AS (SELECT c, id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT c, term, count(*) AS df FROM f GROUP BY ALL), q0 AS (SELECT conv_id AS c, arg_min(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY c),
q AS (SELECT c, term, count(*) AS qtf FROM (SELECT c, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM q0) GROUP BY ALL),
r AS (SELECT c, id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score FROM f JOIN q USING (c, term) JOIN d USING (c, term) JOIN s USING (c) GROUP BY ALL)
"""
_WEAK = ", ".join(f"'{w}'" for w in T.WEAK_TERMS)
_TERMS = """
docs AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM documents),
post AS (SELECT term, id, count(*) AS tf FROM docs GROUP BY ALL),
q AS (SELECT item_id AS qid, term, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS term FROM benchmark) GROUP BY ALL)
"""
_RANK = "row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank"


def _tf(where: str) -> str:
    return f"SELECT qid, id, sum(tf)::BIGINT AS score FROM post JOIN q USING (term) {where} GROUP BY ALL"


def _word_tables(units: str) -> str:
    """CTEs of the words, lengths, counts and question terms of ``units`` (id, text)."""
    return f"""
u AS ({units}),
uw AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM u),
ul AS (SELECT id, len(w) AS dl FROM uw),
us AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM ul),
ut AS (SELECT term, id, count(*) AS tf FROM (SELECT id, unnest(w) AS term FROM uw) GROUP BY ALL),
uq AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
ud AS (SELECT term, count(*) AS df FROM ut GROUP BY ALL)"""


def _bm25(units: str) -> str:
    """CTEs up to bm(qid, id, score), of ``units`` (id, text)."""
    return f"""
{_word_tables(units)},
bm AS (
  SELECT qid, ut.id, round(sum(qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (1.0::DOUBLE - 0.75::DOUBLE + 0.75::DOUBLE * dl / avgdl))), 6) AS score
  FROM ut JOIN uq USING (term) JOIN ud USING (term) JOIN ul ON ul.id = ut.id CROSS JOIN us GROUP BY ALL
)"""


_DOCS = "SELECT doc_id AS id, text FROM documents"
_SENTS = """
SELECT doc_id * 100000 + i - 1 AS id, s AS text FROM (
  SELECT doc_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS i FROM (
    SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS parts
    FROM documents WHERE text IS NOT NULL
  )
)"""
_HASH = """
hb AS (
  SELECT id, list_transform(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda t: (('0x' || substr(sha256(t), 1, 2))::INT % 128)) AS b FROM {units}
),
hc AS (SELECT id, x AS bucket, count(*)::DOUBLE AS c FROM (SELECT id, unnest(CASE WHEN len(b) > 0 THEN b ELSE [127] END) AS x FROM hb) GROUP BY ALL),
hn AS (SELECT id, sqrt(sum(c * c)) AS n FROM hc GROUP BY ALL),
hv AS (SELECT hc.id, bucket, c / n AS w FROM hc JOIN hn USING (id))
"""


def _hashed() -> str:
    docs = _HASH.format(units="(SELECT doc_id AS id, text FROM documents)")
    asked = _HASH.format(units="(SELECT item_id AS id, text FROM benchmark)").replace("hb", "gb").replace("hc", "gc").replace("hn", "gn").replace("hv", "gv")
    return f"{docs}, {asked}, hd AS (SELECT gv.id AS qid, hv.id AS id, round(sum(gv.w * hv.w) / (1.0::DOUBLE + 1e-8), 6) AS score FROM gv JOIN hv USING (bucket) GROUP BY ALL)"


def _rrf(a: str, b: str) -> str:
    return f"""
WITH {_bm25(_DOCS)}, {_hashed()},
la AS (SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 40),
lb AS (SELECT qid, id, rank FROM (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM hd) WHERE rank <= 40),
f AS (SELECT qid, id, round({a}::DOUBLE / (60 + coalesce(la.rank, 100000)) + {b}::DOUBLE / (60 + coalesce(lb.rank, 100000)), 9) AS score FROM la FULL JOIN lb USING (qid, id))
SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM f) WHERE rank <= 10
"""


_DOC_LISTS = f"""
WITH {_bm25(_SENTS)},
l AS (SELECT qid, id, id // 100000 AS doc, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM bm) WHERE rank <= 40),
r AS (SELECT *, row_number() OVER (PARTITION BY qid, doc ORDER BY score DESC, id) AS doc_rank FROM l),
m AS (SELECT qid, doc, doc_rank, round(score * 1000000)::BIGINT AS s FROM r),
a AS (
  SELECT qid, doc, sum(s)::BIGINT / 1e6::DOUBLE AS s_sum, max(s) / 1e6::DOUBLE AS s_max,
         ((2 * sum(s) FILTER (WHERE doc_rank <= 3) + count(*) FILTER (WHERE doc_rank <= 3)) // (2 * count(*) FILTER (WHERE doc_rank <= 3)))::BIGINT / 1e6::DOUBLE AS s_top3
  FROM m GROUP BY ALL
)
"""

ORACLES = {
    "index_manifest": f"""
        WITH {_TERMS}, w AS (SELECT sum(len(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')))::BIGINT AS n_words FROM documents)
        SELECT (SELECT count(*) FROM documents) AS n_blocks, (SELECT count(*) FROM docs) AS n_tokens, n_words, (SELECT count(DISTINCT term) FROM post) AS n_terms, (SELECT count(*) FROM post) AS n_postings FROM w""",
    "postings_topk": f"WITH {_TERMS}, s AS ({_tf('')}) SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 10",
    "strong_postings_topk": f"WITH {_TERMS}, s AS ({_tf(f'WHERE length(term) >= 5 AND term NOT IN ({_WEAK})')}) SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM s) WHERE rank <= 10",
    "term_df": f"WITH {_TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM post GROUP BY ALL",
    "doc_length_stats": """
        SELECT count(*) AS n_docs, sum(n)::BIGINT AS total, round(avg(n), 6) AS avg_len, min(n)::BIGINT AS min_len, max(n)::BIGINT AS max_len
        FROM (SELECT len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n FROM documents)""",
    "bm25_topk": f"WITH {_bm25(_DOCS)} SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM bm) WHERE rank <= 10",
    "bm25_sentence_topn": f"WITH {_bm25(_SENTS)} SELECT qid AS item_id, rank, id // 100000 AS doc_id, id % 100000 AS sent_idx, score FROM (SELECT *, {_RANK} FROM bm) WHERE rank <= 5",
    "cosine_topk": """
        WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
        q AS (SELECT min(vec_id) AS qid FROM v GROUP BY label),
        s AS (SELECT qid, v.vec_id AS id, round(list_dot_product(qv.e, v.e) / (sqrt(list_dot_product(qv.e, qv.e)) * sqrt(list_dot_product(v.e, v.e)) + 1e-8), 6) AS score FROM q JOIN v qv ON qv.vec_id = qid CROSS JOIN v)
        SELECT qid, rank, id AS vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id)::INT AS rank FROM s) WHERE rank <= 10""",
    "hashing_topk": f"WITH {_hashed()} SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM hd) WHERE rank <= 10",
    "rrf_topn_outer": _rrf("1.0", "1.0"),
    "rrf_weighted": _rrf("0.8", "0.2"),
    "rrf_full_topk": f"""
        WITH {_bm25(_DOCS)}, {_hashed()},
        al AS (SELECT item_id AS qid, doc_id AS id, coalesce(hd.score, 0) AS ds, coalesce(bm.score, 0) AS ls FROM benchmark CROSS JOIN documents LEFT JOIN hd ON hd.qid = item_id AND hd.id = doc_id LEFT JOIN bm ON bm.qid = item_id AND bm.id = doc_id),
        rk AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY ds DESC, id) - 1 AS dense_rank, row_number() OVER (PARTITION BY qid ORDER BY ls DESC, id) - 1 AS lexical_rank FROM al),
        f AS (SELECT *, round(1.0::DOUBLE / (60 + lexical_rank) + 1.0::DOUBLE / (60 + dense_rank), 9) AS score FROM rk)
        SELECT qid AS item_id, rank, id AS doc_id, dense_rank, lexical_rank, score FROM (SELECT *, {_RANK} FROM f) WHERE rank <= 10""",
    "block_numbers": """
        WITH t AS (SELECT coalesce(lang, 'none') || '/' || coalesce(source, 'none') || '/' || lpad(doc_id::VARCHAR, 10, '0') AS source_file, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS w FROM documents),
        c AS (SELECT source_file, unnest(range(0, (len(w) + 127) // 128))::INT AS chunk_index FROM t), n AS (SELECT *, row_number() OVER (ORDER BY source_file, chunk_index) - 1 AS number FROM c)
        SELECT *, 'block_' || CASE WHEN number < 1000 THEN lpad(number::VARCHAR, 4, '0') ELSE number::VARCHAR END AS block_id FROM n""",
    "bm25_case_topn": f"""
        WITH {CASE_BM25}
        SELECT c AS conv_id, rank, id AS turn, score FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY score DESC, id)::INT AS rank FROM r) WHERE rank <= 3""",
    "tier_fallback": f"""
        WITH {_TERMS}, st AS (SELECT * FROM q WHERE length(term) >= 5 AND term NOT IN ({_WEAK})),
        t1 AS (SELECT qid, id, sum(tf) AS score, 1 AS tier FROM post JOIN st USING (term) GROUP BY qid, id HAVING count(*) >= 3),
        t2 AS (SELECT qid, id, score, 2 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM (SELECT qid, id, sum(tf) AS score FROM post JOIN st USING (term) GROUP BY qid, id)) WHERE r <= 200),
        t3 AS (SELECT qid, id, score, 3 AS tier FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM (SELECT qid, id, sum(tf) AS score FROM post JOIN q USING (term) GROUP BY qid, id)) WHERE r <= 200),
        a AS (SELECT * FROM t1 UNION ALL SELECT * FROM t2 UNION ALL SELECT * FROM t3),
        m AS (SELECT *, min(tier) OVER (PARTITION BY qid) AS first FROM a)
        SELECT qid AS item_id, tier::INT AS tier, count(*) AS n, max(score)::DOUBLE AS best FROM m WHERE tier = first GROUP BY ALL""",
    "doc_aggregation": f"""{_DOC_LISTS}, x AS (
        SELECT 'sum' AS how, qid, doc, s_sum AS score FROM a UNION ALL SELECT 'max', qid, doc, s_max FROM a UNION ALL SELECT 'top3', qid, doc, s_top3 FROM a)
        SELECT how, qid AS item_id, rank, doc AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY how, qid ORDER BY score DESC, doc)::INT AS rank FROM x) WHERE rank <= 3""",
    "doc_min_max": f"""{_DOC_LISTS}, w AS (SELECT *, min(s_max) OVER q AS l1, max(s_max) OVER q AS h1, min(s_top3) OVER q AS l2, max(s_top3) OVER q AS h2 FROM a WINDOW q AS (PARTITION BY qid)),
        x AS (SELECT qid, doc, round(CASE WHEN h1 > l1 THEN (s_max - l1) / (h1 - l1 + 1e-9) ELSE 1.0 END + CASE WHEN h2 > l2 THEN (s_top3 - l2) / (h2 - l2 + 1e-9) ELSE 1.0 END, 6) AS score FROM w)
        SELECT qid AS item_id, rank, doc AS doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc)::INT AS rank FROM x) WHERE rank <= 3""",
    "candidate_union": f"""
        WITH {_TERMS}, {_hashed()},
        l1 AS (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM hd) WHERE r <= 40),
        l2 AS (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM ({_tf(f'WHERE length(term) >= 5 AND term NOT IN ({_WEAK})')})) WHERE r <= 40),
        l3 AS (SELECT qid, id, score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS r FROM ({_tf('')})) WHERE r <= 40),
        a AS (SELECT qid, id, score AS ann, 0.0::DOUBLE AS strong, 0.0::DOUBLE AS field FROM l1 UNION ALL SELECT qid, id, 0, least(score, 20), 0 FROM l2 UNION ALL SELECT qid, id, 0, 0, least(score, 20) FROM l3),
        f AS (SELECT qid, id, round(max(ann) + 0.05::DOUBLE * sum(strong) + 0.03::DOUBLE * sum(field), 6) AS score FROM a GROUP BY ALL)
        SELECT qid AS item_id, rank, id AS doc_id, score FROM (SELECT *, {_RANK} FROM f) WHERE rank <= 10""",
}
