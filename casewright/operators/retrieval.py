"""Lexical candidates and ranking metrics."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import scoring, skew, text
from casewright.functions.skew import small_enough
from casewright.session import cut_lineage

# BM25 parameters and the floor of the term weight.
BM25_K1 = 1.2
BM25_B = 0.75
BM25_MIN_IDF = 1e-6

TERM_SALTS = 32

# Pairs of a query and a document that one task scores and ranks, at most.
TASK_PAIRS = 2_000_000


def term_counts(corpus: DataFrame, doc: str, content: str, terms: DataFrame | None = None) -> DataFrame:
    """Inverted index rows (doc_id, dl, term, tf), and one row with a null term per document.

    A document is one row, so its words are counted in full before the shuffle,
    which moves a row per kept word (counting within the row by array functions was
    measured at one and a half times the time).
    With ``terms`` only those are kept, if they are few enough to broadcast;
    the other words add to the null row. The null rows hold what is needed about
    the corpus as a whole, so the texts are read once.
    """
    lists = corpus.select(F.col(doc).alias("doc_id"), text.words(F.col(content)).alias("_w"))
    every = F.concat("_w", F.array(F.lit(None).cast("string")))
    exploded = lists.select("doc_id", F.size("_w").cast("bigint").alias("dl"), F.explode(every).alias("term"))
    if terms is not None:
        wanted = terms.select("term").distinct()
        if small_enough(wanted):
            known = F.broadcast(wanted.withColumn("_known", F.lit(True)))
            exploded = exploded.join(known, "term", "left").withColumn("term", F.when(F.col("_known"), F.col("term")))
    return exploded.groupBy("doc_id", "term").agg(F.first("dl").alias("dl"), F.count(F.lit(1)).alias("tf"))


@dataclass(frozen=True)
class LexicalIndex:
    """Written index of a corpus for a set of queries; ``few`` tells whether its terms may be broadcast.

    ``rows`` has one row per document (doc_id, dl, terms, tfs) if so, else the rows of
    ``term_counts``. ``weighted`` is (query_id, term, idf); terms are numbers if few.
    """

    rows: DataFrame
    weighted: DataFrame
    documents: int
    avg_dl: float
    few: bool


def document_terms(corpus: DataFrame, doc: str, content: str, numbers: DataFrame) -> DataFrame:
    """(doc_id, dl, terms, tfs): a document's counts of the given terms as two arrays.

    ``numbers(term, number)`` must be few enough to broadcast. Every document has a row.
    """
    lists = corpus.select(F.col(doc).alias("doc_id"), text.words(F.col(content)).alias("_w"))
    every = F.concat("_w", F.array(F.lit(None).cast("string")))
    exploded = lists.select("doc_id", F.size("_w").cast("bigint").alias("dl"), F.explode(every).alias("term"))
    counted = (
        exploded.join(F.broadcast(numbers), "term", "left").groupBy("doc_id", "number")
        .agg(F.first("dl").alias("dl"), F.count(F.lit(1)).cast("int").alias("tf"))
    )
    known = F.when(F.col("number").isNotNull(), F.struct("number", "tf"))
    together = counted.groupBy("doc_id").agg(F.first("dl").alias("dl"), F.collect_list(known).alias("_p"))
    return together.select("doc_id", "dl", F.col("_p.number").alias("terms"), F.col("_p.tf").alias("tfs"))


def lexical_index(queries: DataFrame, corpus: DataFrame, query: str, query_text: str, doc: str, content: str) -> LexicalIndex:
    """Index of a corpus for the terms of the queries; texts are read once, whatever is asked of it later."""
    terms = queries.select(
        F.col(query).alias("query_id"), F.explode(text.query_terms(F.col(query_text))).alias("term")
    )
    few = small_enough(terms)
    if few:
        # At most as many rows as may be broadcast.
        numbers = cut_lineage(
            terms.select("term").distinct().withColumn("number", F.row_number().over(Window.orderBy("term")))
        )
        rows = cut_lineage(document_terms(corpus, doc, content, numbers))
        whole, df = rows, rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        terms = terms.join(F.broadcast(numbers), "term").select("query_id", F.col("number").alias("term"))
    else:
        rows = cut_lineage(term_counts(corpus, doc, content, terms))
        whole = rows.where("term is null")
        df = rows.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # Two numbers about the corpus; everything per term or document stays distributed.
    n, avg_dl = whole.agg(F.count(F.lit(1)), F.avg("dl")).first()
    raw_idf = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(raw_idf <= 0, F.lit(BM25_MIN_IDF)).otherwise(raw_idf)
    weighted = cut_lineage(terms.join(df, "term").withColumn("idf", idf).drop("df"))
    return LexicalIndex(rows, weighted, n, float(avg_dl or 0.0), few)


def _part(index: LexicalIndex) -> Column:
    """What a term adds to the score of a document."""
    tf, dl = F.col("tf").cast("double"), F.col("dl").cast("double")
    return F.col("idf") * tf * (BM25_K1 + 1) / (tf + BM25_K1 * (1 - BM25_B + BM25_B * dl / F.lit(index.avg_dl)))


def bm25_scores(
    queries: DataFrame, corpus: DataFrame, query: str, query_text: str, doc: str, content: str,
    excluded: DataFrame | None = None, digits: int = 9, k: int | None = None, index: LexicalIndex | None = None,
) -> DataFrame:
    """(query_id, doc_id, score) for every document that shares a term with a query.

    Few query terms are broadcast to the documents where they lie. The documents are
    dealt to tasks by id, so a pair's terms are added up in one task: pairs are
    neither shuffled nor written. More terms go to ``_joined_scores``, where ``k``
    limits what is returned. Excluded pairs leave before ranking.
    """
    index = index or lexical_index(queries, corpus, query, query_text, doc, content)
    if not index.documents or not index.few:
        return _joined_scores(index, excluded, digits, k)
    asked = index.weighted.select("query_id").distinct().count()
    tasks = max(1, math.ceil(index.documents * asked / TASK_PAIRS))
    dealt = index.rows.repartition(max(tasks, index.rows.sparkSession.sparkContext.defaultParallelism), "doc_id")
    postings = dealt.select("doc_id", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("_p")).select(
        "doc_id", "dl", F.col("_p.terms").alias("term"), F.col("_p.tfs").alias("tf")
    )
    hits = postings.join(F.broadcast(index.weighted), "term")
    pairs = hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(_part(index)), digits).alias("score"))
    if excluded is None:
        return pairs
    return pairs.join(skew.broadcast_if_small(excluded.select("query_id", "doc_id")), ["query_id", "doc_id"], "left_anti")


def _joined_scores(index: LexicalIndex, excluded: DataFrame | None, digits: int, k: int | None) -> DataFrame:
    """Scores for more query terms than may be broadcast.

    Queries and postings are joined by term, with the postings of a term spread over
    salts so that a frequent term is not one task's work.

    With ``k`` only what the ``k`` best of a query can be is returned. Terms of most
    documents have the least weight, yet would bring nearly the whole corpus to
    every query. Candidates come from the other terms; a query whose k-th candidate
    is beyond all that the least terms could add needs no other documents, and only
    its candidates in reach of the k-th get these terms added. The remaining
    queries are scored over all their terms.
    """
    weighted = index.weighted
    if not index.documents:
        return weighted.select("query_id", F.lit(None).cast("string").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    postings = index.rows.where("term is not null")
    part = _part(index)

    def barred(pairs: DataFrame) -> DataFrame:
        if excluded is None:
            return pairs
        return pairs.join(excluded.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")

    def summed(chosen: DataFrame) -> DataFrame:
        """Unrounded sums over the given query terms."""
        salt = F.pmod(F.xxhash64("doc_id"), F.lit(TERM_SALTS)).cast("int")
        spread = chosen.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(TERM_SALTS - 1))))
        hits = postings.withColumn("_salt", salt).join(spread, ["term", "_salt"])
        return barred(hits.groupBy("query_id", "doc_id").agg(F.sum(part).alias("_s")))

    if k is None:
        return summed(weighted).select("query_id", "doc_id", F.round("_s", digits).alias("score"))

    least = weighted.where(F.col("idf") <= BM25_MIN_IDF)
    # A term adds less than its weight times k1 + 1; the slack covers rounding.
    caps = least.groupBy("query_id").agg((F.count(F.lit(1)) * (BM25_MIN_IDF * (BM25_K1 + 1)) + 10.0**-digits).alias("_cap"))
    first = cut_lineage(summed(weighted.where(F.col("idf") > BM25_MIN_IDF)))
    best = Window.partitionBy("query_id").orderBy(F.desc("_s"))
    kth = (
        first.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k)
        .groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min("_s").alias("_kth"))
    )
    states = weighted.select("query_id").distinct().join(caps, "query_id", "left").join(kth, "query_id", "left")
    cap = F.coalesce("_cap", F.lit(10.0**-digits))
    states = cut_lineage(states.select("query_id", "_kth", cap.alias("_cap"), F.coalesce((F.col("_n") >= k) & (F.col("_kth") > cap), F.lit(False)).alias("_settled")))
    settled = first.join(states.where("_settled"), "query_id").where(F.col("_s") >= F.col("_kth") - F.col("_cap")).select("query_id", "doc_id", "_s")
    wanted = settled.select("query_id", "doc_id").join(least, "query_id")
    added = wanted.join(postings, ["doc_id", "term"]).select("query_id", "doc_id", part.alias("_s"))
    whole = summed(weighted.join(states.where("NOT _settled").select("query_id"), "query_id", "left_semi"))
    together = settled.unionByName(added).groupBy("query_id", "doc_id").agg(F.sum("_s").alias("_s")).unionByName(whole)
    return together.select("query_id", "doc_id", F.round("_s", digits).alias("score"))


def lexical_candidates(
    queries: DataFrame, corpus: DataFrame, query: str, query_text: str, doc: str, content: str, k: int,
    excluded: DataFrame | None = None, top_up: bool = True, index: LexicalIndex | None = None,
) -> DataFrame:
    """Top ``k`` documents per query by BM25, ties by document id, short lists filled up by id.

    Never looks at gold. ``index`` may be given where the same is asked of it more than once. Result: (query_id, doc_id, score, pos); filled-up rows
    have no score.
    """
    scores = bm25_scores(queries, corpus, query, query_text, doc, content, excluded, k=k, index=index)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    # k rows a query, written so that all below them is done once.
    hits = cut_lineage(scores.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= k))
    if not top_up:
        return hits
    counted = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("_hits"))
    short = (
        queries.select(F.col(query).alias("query_id"))
        .join(counted, "query_id", "left")
        .withColumn("_hits", F.coalesce("_hits", F.lit(0)))
        .where(F.col("_hits") < k)
    )
    barred = hits.select("query_id", "doc_id")
    if excluded is not None:
        barred = barred.unionByName(excluded.select("query_id", "doc_id"))
    blocked = barred.groupBy("query_id").agg(F.count(F.lit(1)).alias("_b"))
    # The first k + (barred documents) ids surely hold enough free ones for a query.
    need = short.join(blocked, "query_id", "left").withColumn("_need", F.lit(k) + F.coalesce("_b", F.lit(0)))
    longest = need.agg(F.max("_need")).first()[0]
    if longest is None:
        return hits
    first_ids = (
        corpus.select(F.col(doc).alias("doc_id")).orderBy("doc_id").limit(int(longest))
        .withColumn("_n", F.row_number().over(Window.orderBy("doc_id")))
    )
    fill = (
        need.select("query_id", "_hits", F.explode(F.sequence(F.lit(1), F.col("_need").cast("int"))).alias("_n"))
        .join(first_ids, "_n")
        .join(barred, ["query_id", "doc_id"], "left_anti")
        .withColumn("_i", F.row_number().over(Window.partitionBy("query_id").orderBy("doc_id")))
        .withColumn("pos", (F.col("_hits") + F.col("_i")).cast("int"))
        .where(F.col("pos") <= k)
        .select("query_id", "doc_id", F.lit(None).cast("double").alias("score"), "pos")
    )
    return hits.select("query_id", "doc_id", "score", "pos").unionByName(fill)


def position_score(candidates: DataFrame, query: str, pos: str, out: str = "prob") -> DataFrame:
    """Baseline probability 1 - i/(n+1) from the 1-based retrieval position."""
    n = candidates.groupBy(query).agg(F.count(F.lit(1)).alias("_n"))
    return candidates.join(n, query).withColumn(out, 1 - (F.col(pos) - 1) / (F.col("_n") + 1)).drop("_n")


def _ideal(qrels: DataFrame, query: str, rel: str) -> DataFrame:
    """Ideal DCG over the ten best judged documents, retrieved or not, and the positives."""
    order = Window.partitionBy(query).orderBy(F.desc(rel))
    top = qrels.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= 10)
    idcg = top.groupBy(query).agg(F.sum(scoring.gain(F.col(rel)) * scoring.discount(F.col("_p"))).alias("idcg"))
    positives = qrels.groupBy(query).agg(F.count_if(F.col(rel) > 0).alias("positives"))
    return positives.join(idcg, query)


def ranking_scores(candidates: DataFrame, qrels: DataFrame, query: str, doc: str, prob: str, rel: str) -> DataFrame:
    """nDCG@10, MRR, Recall@10 and scorable candidate recall per query.

    ``candidates`` has one row per scorable document of a query; order is by
    (-prob, doc). A query with a missing or unusable probability is not valid
    and has null scores. Only the ten best rows of a query are ever ordered; the
    rank of the first relevant document is a count of those before it.
    """
    judged = candidates.join(qrels.select(query, doc, rel), [query, doc], "left").withColumn(
        "_rel", F.coalesce(rel, F.lit(0))
    )
    order = Window.partitionBy(query).orderBy(F.desc(prob), doc)
    top = judged.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= 10)
    dcg = top.groupBy(query).agg(
        F.sum(scoring.gain(F.col("_rel")) * scoring.discount(F.col("_p"))).alias("_dcg"),
        F.count_if(F.col("_rel") > 0).alias("_hits10"),
        F.min(F.when(F.col("_rel") > 0, F.col("_p"))).alias("_p10"),
    )
    place = F.struct((-F.col(prob)).alias("p"), F.col(doc).alias("d"))
    whole = judged.groupBy(query).agg(
        F.count(F.lit(1)).alias("candidates_scored"),
        F.count_if(F.col("_rel") > 0).alias("_found"),
        F.bool_and(scoring.usable_probability(F.col(prob))).alias("valid"),
        F.min(F.when(F.col("_rel") > 0, place)).alias("_first"),
    )
    # Only queries whose first relevant document is past the tenth place need the count.
    late = whole.join(dcg, query).where("_first is not null and _p10 is null").select(query, "_first")
    ahead = (
        skew.salted_lookup(judged, late, query, doc)
        .where(place <= F.col("_first"))
        .groupBy(query)
        .agg(F.count(F.lit(1)).alias("_rank"))
    )
    joined = whole.join(dcg, query).join(ahead, query, "left").join(_ideal(qrels, query, rel), query, "left")
    first = F.coalesce("_p10", "_rank")
    return joined.select(
        query,
        "valid",
        "candidates_scored",
        F.when(F.col("valid"), F.try_divide("_dcg", "idcg")).alias("ndcg_at_10"),
        F.when(F.col("valid"), F.coalesce(1.0 / first, F.lit(0.0))).alias("mrr"),
        F.when(F.col("valid"), F.try_divide(F.col("_hits10").cast("double"), "positives")).alias("recall_at_10"),
        F.when(F.col("valid"), F.try_divide(F.col("_found").cast("double"), "positives")).alias("scorable_candidate_recall"),
    )


def random_ndcg(candidates: DataFrame, qrels: DataFrame, query: str, doc: str, rel: str) -> DataFrame:
    """Expected nDCG@10 of a random order: mean gain x sum of discounts / ideal DCG."""
    judged = candidates.join(qrels.select(query, doc, rel), [query, doc], "left")
    mean = judged.groupBy(query).agg(
        F.avg(scoring.gain(F.coalesce(rel, F.lit(0)))).alias("_g"), F.count(F.lit(1)).alias("_n")
    )
    positions = F.sequence(F.lit(1), F.least(F.lit(10), F.col("_n")).cast("int"))
    reach = F.aggregate(positions, F.lit(0.0), lambda a, i: a + scoring.discount(i))
    return mean.join(_ideal(qrels, query, rel), query, "left").select(
        query, F.coalesce(F.try_divide(F.col("_g") * reach, "idcg"), F.lit(0.0)).alias("random_ndcg")
    )


def candidate_recall(candidates: DataFrame, qrels: DataFrame, query: str, doc: str, rel: str) -> DataFrame:
    """Positives retrieved / positives; null for a query without positives."""
    marked = qrels.join(
        candidates.select(query, doc).withColumn("_got", F.lit(True)), [query, doc], "left"
    )
    n = marked.groupBy(query).agg(
        F.count_if(F.col(rel) > 0).alias("positives"),
        F.count_if((F.col(rel) > 0) & F.col("_got")).alias("retrieved"),
    )
    return n.withColumn("candidate_recall", F.try_divide(F.col("retrieved").cast("double"), "positives"))


def answerable(queries: DataFrame, candidates: DataFrame, qrels: DataFrame, query: str, doc: str, rel: str) -> DataFrame:
    """Queries with at least one scorable candidate that is relevant."""
    good = candidates.join(qrels.where(F.col(rel) > 0).select(query, doc), [query, doc], "left_semi").select(query)
    return queries.join(good, query, "left_semi")


def pack(
    items: Column, size: Column, base: Column, item_limit: int, chunk_limit: int
) -> Column:
    """Greedy packing of an ordered array into chunks under a size budget.

    ``items`` is an array of (doc_id, size) structs. The result is a struct of
    ``chunks`` (array of (doc_id, chunk)), and ``oversized`` ids that fit no
    chunk at all.
    """
    fits = F.filter(items, lambda x: base + x["size"] <= item_limit)
    over = F.transform(F.filter(items, lambda x: base + x["size"] > item_limit), lambda x: x["doc_id"])
    empty = F.filter(
        F.transform(items, lambda x: F.struct(x["doc_id"].alias("doc_id"), F.lit(0).alias("chunk"))),
        lambda x: F.lit(False),
    )
    start = F.struct(F.lit(0).alias("chunk"), base.cast("bigint").alias("used"), F.lit(0).alias("held"), empty.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["held"] > 0) & (acc["used"] + x["size"] > chunk_limit)
        chunk = F.when(new, acc["chunk"] + 1).otherwise(acc["chunk"])
        used = (F.when(new, base).otherwise(acc["used"]) + x["size"]).cast("bigint")
        held = F.when(new, 1).otherwise(acc["held"] + 1)
        row = F.array(F.struct(x["doc_id"].alias("doc_id"), chunk.alias("chunk")))
        return F.struct(chunk.alias("chunk"), used.alias("used"), held.alias("held"), F.concat(acc["out"], row).alias("out"))

    walked = F.aggregate(fits, start, step)
    return F.struct(walked["out"].alias("chunks"), over.alias("oversized"))


def project_queries(
    candidates: DataFrame, query: str, doc: str, pos: str, size: str, base: str, qrels: DataFrame, rel: str,
    item_limit: int = 31_000, chunk_limit: int = 60_000,
) -> DataFrame:
    """One row per scorable candidate: its request chunk, field name and gold (yes, or null if unjudged).

    A query has at most the retrieval depth of candidates, so they are packed as
    one array.
    """
    listed = candidates.groupBy(query, base).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(pos).alias("pos"), F.col(doc).alias("doc_id"), F.col(size).alias("size")))
        ).alias("_c")
    )
    items = F.transform("_c", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["size"].alias("size")))
    packed = listed.withColumn("_p", pack(items, F.col(size) if size in listed.columns else F.lit(0), F.col(base), item_limit, chunk_limit))
    rows = packed.select(query, F.posexplode("_p.chunks").alias("_i", "_x")).select(
        query, F.col("_x.doc_id").alias(doc), F.col("_x.chunk").alias("chunk")
    )
    fields = candidates.select(query, doc, F.concat(F.lit("doc_"), (F.col(pos) - 1).cast("string")).alias("field"))
    relevant = qrels.where(F.col(rel) > 0).select(query, doc, F.lit("yes").alias("gold"))
    return rows.join(fields, [query, doc]).join(relevant, [query, doc], "left")
