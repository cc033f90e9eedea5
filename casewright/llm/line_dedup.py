"""Repeated passages of lines, found by winnowing and deleted where they come again.

Lines are hashed. Of every window of ``window`` consecutive lines the smallest
hash (the last of equal ones) is a fingerprint: two documents that share a run of
that many lines share its fingerprint, and far fewer fingerprints than lines are
kept. Fingerprints that occur at one position only are dropped. At the others,
the windows on both sides that hold the fingerprint are compared whole, and runs
longer than a window are found window by window. (Matches are not extended from
the first position of a fingerprint alone: a later window may equal one at its
second position and none at its first.)
A window that stood before, in an earlier document or further up, is deleted.

Thus a line goes exactly when it lies in a run of at least ``window`` lines that
is equal to an earlier one, or when it has more than ``long_words`` words and
stood before on its own: a paragraph in one line is a passage too. Hashes are
taken within rows; only fingerprints, and the windows of repeated ones, are
shuffled, both counted before the shuffle. Everything is built-in DataFrame work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions.skew import broadcast_if_small
from casewright.llm.registry import query, table
from casewright.llm.rows import numbered
from casewright.session import cut_lineage

WINDOW = 2
# A line of more words than this is a passage by itself.
LONG_WORDS = 50


def _long_line(line: Column, long_words: int) -> Column:
    """Whether a line has more words than that; so many words need more than two characters each."""
    words = F.filter(F.split(line, r"\s+"), lambda w: w != "")
    return F.when(F.length(line) > 2 * long_words, F.size(words) > long_words).otherwise(False)


def hashed(docs: DataFrame, id_col: str, text_col: str, window: int, long_words: int | None) -> DataFrame:
    """(row, id, mark, runs): each position of a fingerprint, with the windows (at, long, whole) that it is the fingerprint of.

    A long line is a window by itself. ``whole`` is a hash of all lines of a window.
    """
    lean = numbered(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "row").where("text IS NOT NULL")
    lines = lean.select("row", "id", F.transform(F.split("text", "\n", -1), lambda x: F.trim(x)).alias("lines"))
    hashes = lines.select("row", "id", "lines", F.transform("lines", lambda x: F.xxhash64(x)).alias("h"))

    def run(at: Column, long: int, whole: Column) -> Column:
        return F.struct(at.alias("at"), F.lit(long).alias("long"), whole.alias("whole"))

    def position(own: Column, p: Column) -> Column:
        runs = []
        for k in range(window):
            # The window with k lines before this one, if all are there and this is the last of its smallest hashes.
            inside = [F.get("h", p - k + j) for j in range(window)]
            least = F.lit(True)
            for j, other in enumerate(inside):
                least = least & (other >= own if j < k else other > own) if j != k else least
            runs.append(F.when(least, run(p - k, window, F.xxhash64(*inside))))
        if long_words is not None:
            # The second hash of a long line starts from another seed, so lines are told apart by both.
            line = F.get("lines", p)
            runs.append(F.when(_long_line(line, long_words), run(p, 1, F.xxhash64(F.lit(1), line))))
        return F.struct(own.alias("mark"), F.filter(F.array(*runs), lambda r: r.isNotNull()).alias("runs"))

    found = F.filter(F.transform("h", position), lambda f: F.size(f["runs"]) > 0)
    return hashes.select("row", "id", F.explode(found).alias("f")).select("row", "id", "f.*")


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(row, lines): numbers of the lines that go, from 0, for each row that loses any."""
    prints = cut_lineage(hashed(docs, id_col, text_col, window, long_words))
    # Consecutive windows with one fingerprint hold one position of it.
    marks = prints.groupBy("mark").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("mark")
    likely = prints.join(marks, "mark", "left_semi").select("row", "id", "mark", F.explode("runs").alias("r")).select("row", "id", "mark", "r.*")
    # Windows are compared by their fingerprint and their whole content; a null id comes last.
    place = F.struct(F.col("id").isNull().alias("no_id"), F.col("id").alias("id"), F.col("row").alias("row"), F.col("at").alias("at"))
    first = likely.groupBy("mark", "whole").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = likely.join(first, ["mark", "whole"]).where((F.col("first.row") != F.col("row")) | (F.col("first.at") != F.col("at")))
    return later.groupBy("row").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.sequence(F.col("at"), F.col("at") + F.col("long") - 1))))).alias("lines")
    )


def clean(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
          long_words: int | None = LONG_WORDS) -> DataFrame:
    """(row, id_col, text, n_lines, n_removed): every row of ``docs`` with the lines that stay.

    Lines are split at line feeds and compared without surrounding spaces. Earlier
    means a smaller id (null ids last), then the row's place, then the line's. A
    null text stays null and has no lines; an empty text has one empty line; a
    document with fewer lines than ``window`` loses none but its long ones; of
    repeated rows the later lose whatever is long enough. Without ``long_words``
    a line never goes on its own. Other columns are not read; an empty table
    gives no rows.
    """
    gone = cut_lineage(repeats(docs, id_col, text_col, window, long_words))
    rows = numbered(docs.select(id_col, F.col(text_col).alias("text")), "row")
    marked = rows.join(broadcast_if_small(gone), "row", "left")
    lines = F.split("text", "\n", -1)
    # A difference of sets and one pass over what is left, however many lines a text has.
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("lines"))
    kept = F.get(F.transform(F.array(lines), lambda own: F.transform(left, lambda i: F.get(own, i))), F.lit(0))
    return marked.select(
        "row", id_col, F.when(F.col("lines").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


@query(
    r"""
    WITH lines AS (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL
    ), pairs AS (
        SELECT doc_id, i, trim(line, ' ') AS a, lead(trim(line, ' ')) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM lines
    ), seen AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS nth FROM pairs WHERE b IS NOT NULL
    ), long_lines AS (
        SELECT doc_id, i, row_number() OVER (PARTITION BY a ORDER BY doc_id, i) AS nth FROM pairs
        WHERE len(regexp_extract_all(a, '[^\x20\x09-\x0D]+')) > 50
    ), gone AS (
        SELECT doc_id, i FROM seen WHERE nth > 1 UNION SELECT doc_id, i + 1 FROM seen WHERE nth > 1
        UNION SELECT doc_id, i FROM long_lines WHERE nth > 1
    )
    SELECT d.doc_id, sha256(coalesce(string_agg(line, chr(10) ORDER BY l.i) FILTER (g.doc_id IS NULL), '')) AS text_sha256,
           count(l.doc_id) AS n_lines, count(g.doc_id) AS n_removed
    FROM documents d LEFT JOIN lines l USING (doc_id) LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.i = l.i
    GROUP BY d.doc_id
    """
)
def op7_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document without the runs of two lines or more, and the single lines of more than 50 words, that stood before."""
    cleaned = clean(table(spark, folder, "documents"))
    return cleaned.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "n_lines", "n_removed")
