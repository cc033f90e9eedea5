"""Lexical retrieval over documents and ranking metrics over order lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from casewright.functions.text import STOPWORDS
from casewright.operators import audits, retrieval
from casewright.operators import results
from casewright.plans.registry import query, table

STOP_SQL = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"

BM25 = rf"""
q AS (SELECT DISTINCT item_id AS query_id, t AS term FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM benchmark) WHERE t NOT IN {STOP_SQL}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ws FROM documents),
dl AS (SELECT doc_id, len(ws) AS dl FROM w),
st AS (SELECT count(*)::DOUBLE AS n, avg(dl)::DOUBLE AS avg_dl FROM dl),
tf AS (SELECT doc_id, term, count(*)::DOUBLE AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM w) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf FROM df, st),
sc AS (SELECT query_id, doc_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl))), 9) AS score
  FROM q JOIN tf USING (term) JOIN idf USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def top_sql(name: str, k: int, scores: str = "sc", barred: str | None = None) -> str:
    """The k best of a score table per query, filled up with the smallest free document ids."""
    free = f" AND NOT EXISTS (SELECT 1 FROM {barred} x WHERE x.query_id = hc.query_id AND x.doc_id = d.doc_id)" if barred else ""
    return f"""
{name}_hit AS (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS pos FROM {scores} QUALIFY pos <= {k}),
{name} AS (SELECT * FROM {name}_hit UNION ALL
  SELECT hc.query_id, d.doc_id, NULL::DOUBLE AS score, h + row_number() OVER (PARTITION BY hc.query_id ORDER BY d.doc_id) AS pos
  FROM (SELECT item_id AS query_id, count(doc_id) AS h FROM benchmark LEFT JOIN {name}_hit ON query_id = item_id GROUP BY item_id) hc
  JOIN documents d ON h < {k} AND NOT EXISTS (SELECT 1 FROM {name}_hit x WHERE x.query_id = hc.query_id AND x.doc_id = d.doc_id){free}
  QUALIFY pos <= {k})"""


BM25 = BM25 + ", " + top_sql("cand", 32)


def searched(spark, d):
    return table(spark, d, "benchmark"), table(spark, d, "documents"), "item_id", "text", "doc_id", "text"


def candidates(spark, d, k=32, index=None):
    return retrieval.lexical_candidates(*searched(spark, d), k, index=index)


@query(f"WITH {BM25} SELECT query_id, doc_id, pos::BIGINT AS pos, round(score, 6) AS score FROM cand")
def bm25_candidates(spark, d):
    return candidates(spark, d).select("query_id", "doc_id", F.col("pos").cast("bigint").alias("pos"), F.round("score", 6).alias("score"))


@query(f"""
WITH {BM25}, ex AS (SELECT query_id, doc_id FROM cand WHERE pos <= 2),
sx AS (SELECT * FROM sc ANTI JOIN ex USING (query_id, doc_id)), {top_sql("c2", 8, "sx", "ex")}
SELECT query_id, doc_id, pos FROM c2""")
def bm25_with_exclusions(spark, d):
    """Each query bars its two best documents, then ranks anew."""
    from casewright.session import cut_lineage

    index = retrieval.lexical_index(*searched(spark, d))
    barred = cut_lineage(candidates(spark, d, index=index).where("pos <= 2").select("query_id", "doc_id"))
    out = retrieval.lexical_candidates(*searched(spark, d), 8, barred, index=index)
    return out.select("query_id", "doc_id", F.col("pos").cast("bigint").alias("pos"))


# Ranking records from order lines: a part is a query, an order that holds it a
# candidate; discounts are probabilities, and large returned quantities judged.
RANKED = """
cd AS (SELECT l_partkey AS query_id, l_orderkey AS doc_id, max(l_discount * 10) AS prob FROM lineitem GROUP BY ALL),
qr AS (SELECT l_partkey AS query_id, l_orderkey AS doc_id, max(CASE WHEN l_quantity > 45 THEN 2 WHEN l_quantity > 35 THEN 1 ELSE 0 END) AS rel FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL),
cj AS (SELECT cd.*, coalesce(rel, 0) AS rel FROM cd LEFT JOIN qr USING (query_id, doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prob DESC, doc_id) AS p FROM cj),
ir AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS p FROM qr),
idl AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(p + 1)) FILTER (p <= 10) AS idcg, count(*) FILTER (rel > 0) AS positives FROM ir GROUP BY query_id)"""


def ranked_candidates(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("doc_id")).agg(
        F.max(F.col("l_discount") * 10).alias("prob")
    )


def judged(spark, d):
    q = F.col("l_quantity")
    rel = F.when(q > 45, 2).when(q > 35, 1).otherwise(0)
    return (
        table(spark, d, "lineitem").where("l_returnflag = 'R'")
        .groupBy(F.col("l_partkey").alias("query_id"), F.col("l_orderkey").alias("doc_id")).agg(F.max(rel).alias("rel"))
    )


SCORES = """
SELECT rk.query_id, count(*) AS candidates_scored,
  round(sum((pow(2, rel) - 1) / log2(p + 1)) FILTER (p <= 10) / nullif(max(idcg), 0), 6) AS ndcg_at_10,
  round(coalesce(1.0 / min(p) FILTER (rel > 0), 0), 6) AS mrr,
  round(count(*) FILTER (rel > 0 AND p <= 10)::DOUBLE / nullif(max(positives), 0), 6) AS recall_at_10,
  round(count(*) FILTER (rel > 0)::DOUBLE / nullif(max(positives), 0), 6) AS scorable_candidate_recall
FROM rk LEFT JOIN idl USING (query_id) GROUP BY rk.query_id"""


def rounded_scores(out):
    names = ("ndcg_at_10", "mrr", "recall_at_10", "scorable_candidate_recall")
    return out.select("query_id", "candidates_scored", *[F.round(c, 6).alias(c) for c in names])


@query(f"WITH {RANKED} {SCORES}")
def ranking_scores(spark, d):
    return rounded_scores(
        retrieval.ranking_scores(ranked_candidates(spark, d), judged(spark, d), "query_id", "doc_id", "prob", "rel")
    )


@query(f"""
WITH {RANKED.replace("l_partkey AS query_id", "l_linestatus AS query_id")} {SCORES}""")
def ranking_scores_two_large_queries(spark, d):
    """Half of all rows belong to one query: nothing is sorted whole."""
    li = table(spark, d, "lineitem").withColumn("query_id", F.col("l_linestatus"))
    q = F.col("l_quantity")
    cands = li.groupBy("query_id", F.col("l_orderkey").alias("doc_id")).agg(F.max(F.col("l_discount") * 10).alias("prob"))
    rel = F.when(q > 45, 2).when(q > 35, 1).otherwise(0)
    rels = li.where("l_returnflag = 'R'").groupBy("query_id", F.col("l_orderkey").alias("doc_id")).agg(F.max(rel).alias("rel"))
    return rounded_scores(retrieval.ranking_scores(cands, rels, "query_id", "doc_id", "prob", "rel"))


@query(f"""
WITH {RANKED}, m AS (SELECT query_id, avg(pow(2, rel) - 1) AS g, count(*) AS n FROM cj GROUP BY query_id)
SELECT query_id, round(coalesce(g * list_sum(list_transform(range(1, least(10, n) + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) / nullif(idcg, 0), 0), 6) AS random_ndcg
FROM m LEFT JOIN idl USING (query_id)""")
def random_ranking_baseline(spark, d):
    out = retrieval.random_ndcg(ranked_candidates(spark, d), judged(spark, d), "query_id", "doc_id", "rel")
    return out.withColumn("random_ndcg", F.round("random_ndcg", 6))


QRELS = """
ql AS (SELECT c.query_id, c.doc_id, CASE WHEN d.source IN ('src1', 'src2') THEN 1 ELSE 0 END AS rel FROM cand c JOIN documents d USING (doc_id) JOIN labels USING (doc_id)
  UNION ALL SELECT item_id, -1, 1 FROM benchmark)"""


def lexical_qrels(spark, d, cands):
    """Judgements for labelled candidates, and one relevant document nothing retrieves."""
    docs = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id")
    rel = F.when(F.col("source").isin("src1", "src2"), 1).otherwise(0)
    known = cands.join(docs, "doc_id").select("query_id", "doc_id", rel.alias("rel"))
    lost = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.lit(-1).cast("bigint").alias("doc_id"), F.lit(1).alias("rel"))
    return known.unionByName(lost)


@query(f"""
WITH {BM25}, {QRELS}, n AS (SELECT query_id, count(*) AS n FROM cand GROUP BY query_id),
pr AS (SELECT cand.query_id, doc_id, 1 - (pos - 1)::DOUBLE / (n + 1) AS prob, coalesce(rel, 0) AS rel FROM cand JOIN n USING (query_id) LEFT JOIN ql USING (query_id, doc_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY prob DESC, doc_id) AS p FROM pr),
ir AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC) AS p FROM ql),
idl AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(p + 1)) FILTER (p <= 10) AS idcg, count(*) FILTER (rel > 0) AS positives FROM ir GROUP BY query_id)
{SCORES}""")
def lexical_baseline_scores(spark, d):
    from casewright.session import cut_lineage

    cands = cut_lineage(candidates(spark, d))
    scored = retrieval.position_score(cands, "query_id", "pos")
    return rounded_scores(
        retrieval.ranking_scores(scored, lexical_qrels(spark, d, cands), "query_id", "doc_id", "prob", "rel")
    )


@query(f"""
WITH {BM25}, {QRELS}
SELECT query_id, count(*) FILTER (rel > 0) AS positives, count(*) FILTER (rel > 0 AND c.doc_id IS NOT NULL) AS retrieved,
  round(count(*) FILTER (rel > 0 AND c.doc_id IS NOT NULL)::DOUBLE / nullif(count(*) FILTER (rel > 0), 0), 6) AS candidate_recall
FROM ql LEFT JOIN cand c USING (query_id, doc_id) GROUP BY query_id""")
def candidate_recall(spark, d):
    from casewright.session import cut_lineage

    cands = cut_lineage(candidates(spark, d))
    out = retrieval.candidate_recall(cands, lexical_qrels(spark, d, cands), "query_id", "doc_id", "rel")
    return out.withColumn("candidate_recall", F.round("candidate_recall", 6))


@query(f"""
WITH {RANKED}, r AS (SELECT query_id, count(*) FILTER (rel > 0) AS pos FROM qr GROUP BY query_id),
g AS (SELECT cj.query_id, count(*) FILTER (rel > 0 AND prob > 0.5) AS got FROM cj GROUP BY cj.query_id)
SELECT p_brand, count(*) AS queries, round(avg(got::DOUBLE / nullif(pos, 0)), 6) AS mean_candidate_recall FROM r JOIN g USING (query_id) JOIN part ON p_partkey = query_id GROUP BY p_brand""")
def recall_by_domain(spark, d):
    from casewright.operators import metrics

    cands = ranked_candidates(spark, d).where("prob > 0.5")
    per = retrieval.candidate_recall(cands, judged(spark, d), "query_id", "doc_id", "rel")
    part = table(spark, d, "part").select(F.col("p_partkey").alias("query_id"), "p_brand")
    out = metrics.recall_by_domain(per.join(part, "query_id"), "p_brand", "candidate_recall")
    return out.withColumn("mean_candidate_recall", F.round("mean_candidate_recall", 6))


@query(f"""
WITH {RANKED} SELECT DISTINCT query_id FROM cj WHERE rel > 0 AND prob > 0.5""")
def answerable_queries(spark, d):
    cands = ranked_candidates(spark, d)
    queries = cands.select("query_id").distinct()
    return retrieval.answerable(queries, cands.where("prob > 0.5"), judged(spark, d), "query_id", "doc_id", "rel")


@query("""
WITH c AS (SELECT CASE WHEN doc_id % 50 = 3 THEN doc_id - 1 WHEN doc_id % 50 <> 7 THEN doc_id END AS id, CASE WHEN doc_id % 30 = 5 THEN ' ' WHEN doc_id % 30 <> 11 THEN text END AS content FROM documents),
g AS (SELECT id, count(*) AS n, count(DISTINCT content) + (count(content) < count(*))::INT AS contents FROM c WHERE id IS NOT NULL GROUP BY id)
SELECT 'documents' AS "check", count(*) AS n FROM c UNION ALL SELECT 'without_id', count(*) FILTER (id IS NULL) FROM c
UNION ALL SELECT 'without_content', count(*) FILTER (content IS NULL OR trim(content) = '') FROM c
UNION ALL SELECT 'repeated_ids', count(*) FILTER (n > 1) FROM g UNION ALL SELECT 'conflicting_ids', count(*) FILTER (contents > 1) FROM g""")
def corpus_uniqueness(spark, d):
    """Documents with some ids repeated or missing and some contents missing."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select(
        F.when(k % 50 == 3, k - 1).when(k % 50 != 7, k).alias("id"), F.when(k % 30 == 5, F.lit(" ")).when(k % 30 != 11, F.col("text")).alias("content")
    )
    return audits.corpus_checks(docs, "id", "content")


CHUNKS = """
sz AS (SELECT query_id, doc_id, pos, greatest(1, length(text) // 4) AS size FROM cand JOIN documents USING (doc_id)),
fit AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS i FROM sz WHERE 50 + size <= 1500),
ck AS (SELECT query_id, doc_id, pos, i, 0 AS chunk, 50 + size AS used FROM fit WHERE i = 1
  UNION ALL SELECT f.query_id, f.doc_id, f.pos, f.i, CASE WHEN ck.used + f.size > 3000 THEN ck.chunk + 1 ELSE ck.chunk END,
    CASE WHEN ck.used + f.size > 3000 THEN 50 + f.size ELSE ck.used + f.size END FROM ck JOIN fit f ON f.query_id = ck.query_id AND f.i = ck.i + 1)"""


def chunked(spark, d):
    from casewright.session import cut_lineage

    cands = cut_lineage(candidates(spark, d))
    size = F.greatest(F.lit(1), F.floor(F.length("text") / 4)).cast("bigint")
    sized = cands.join(table(spark, d, "documents").select("doc_id", size.alias("size")), "doc_id").withColumn("base", F.lit(50).cast("bigint"))
    qrels = lexical_qrels(spark, d, cands)
    return retrieval.project_queries(sized, "query_id", "doc_id", "pos", "size", "base", qrels, "rel", 1500, 3000)


@query(f"""
WITH RECURSIVE {BM25}, {QRELS}, {CHUNKS}
SELECT query_id, doc_id, chunk::BIGINT AS chunk, 'doc_' || (pos - 1)::VARCHAR AS field, CASE WHEN rel > 0 THEN 'yes' END AS gold
FROM ck LEFT JOIN ql USING (query_id, doc_id)""")
def request_chunks(spark, d):
    return chunked(spark, d).select("query_id", "doc_id", F.col("chunk").cast("bigint").alias("chunk"), "field", "gold")


@query("""
SELECT query_id, doc_id, prob FROM (SELECT l_partkey AS query_id, l_suppkey AS doc_id, l_discount AS prob,
  row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY sha256(l_orderkey::VARCHAR || ':' || l_linenumber::VARCHAR) DESC, l_discount DESC) AS rn FROM lineitem)
WHERE rn = 1""")
def merged_probabilities(spark, d):
    from casewright.functions import hashing

    li = table(spark, d, "lineitem").select(
        F.col("l_partkey").alias("query_id"), F.col("l_suppkey").alias("doc_id"), F.col("l_discount").alias("prob"),
        F.struct(hashing.sha(F.col("l_orderkey"), F.col("l_linenumber")), "l_discount").alias("seq"),
    )
    return results.merge_probabilities(li, ["query_id", "doc_id"], "prob", "seq")
