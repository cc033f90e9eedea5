"""Phrases whose words stand together more often than apart, mined from occurrence relations in the manner of SETM.

Texts are cut into chunks of one language. A chunk holds its occurrences sorted by
piece and position: two words next to each other in a piece have positions that
differ by one, and pieces are kept apart by a gap. For each length:

1. The relation of the frequent phrases of this length is merge-joined with itself
   at adjacent positions: a phrase and the one that starts a word later make an
   occurrence of the next length. The result is written.
2. Distinct phrases of each chunk are counted there, and the counts are summed over
   all chunks by a shuffle on the phrase. A phrase is named by the exact numbers of
   its two parts, never by a hash.
3. Only the phrases that are frequent in the whole language go back to the chunks,
   where the relation is semi-joined with them before it is extended.

Occurrences themselves are not shuffled by phrase: a phrase that stands everywhere
is one entry per chunk. Entries travel in slices of phrases, column by column,
sorted and compressed; the number of slices follows the number of occurrences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import scans
from casewright.llm.registry import query, table
from casewright.session import cut_lineage

LEAST = 30
WORDS = 4
TOP = 2000
# A phrase goes when a longer one has this many percent of its occurrences.
SHARE = 80
# Text bytes of a chunk, and occurrences of a slice of phrases.
CHUNK, SLICE = 12 << 20, 2_000_000

PIECE_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(10 if c in PIECE_ENDS else 32 if c == 9 else c for c in range(256))


def _shut(values: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers, compressed; rising ones as differences."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress((np.diff(values, prepend=values.dtype.type(0)) if rising else values).tobytes())


def _open(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    values = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)
    return np.cumsum(values, dtype=values.dtype) if rising else values


def _words(texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of some texts, and their positions: one apart within a piece, further apart across pieces."""
    data = np.frombuffer(b"\n".join(texts).lower().translate(_FOLD), np.uint8)
    inside = (data != 32) & (data != 10)
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0), append=np.int8(0)))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside].tobytes()))
    pieces = np.searchsorted(np.flatnonzero(data == 10), starts)
    return words.dictionary_encode(), np.arange(len(starts)) + pieces


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def occurrences(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(chunk, lang, words, counts, at, codes): the word relation of each chunk, written."""

    def chunk(number: int, lang: str, texts: list[bytes]) -> Iterator[pa.RecordBatch]:
        words, at = _words(texts)
        if not len(at):
            return
        codes = words.indices.to_numpy().astype("<i4")
        names = words.dictionary.cast(pa.string())
        counts = np.bincount(codes, minlength=len(names)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()), pa.array([lang], pa.string()),
                pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), names),
                pa.ListArray.from_arrays(pa.array([0, len(names)], pa.int32()), pa.array(counts)),
                pa.array([_shut(at.astype("<i8"), True)], pa.binary()), pa.array([_shut(codes)], pa.binary()),
            ],
            ["chunk", "lang", "words", "counts", "at", "codes"],
        )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 20
        for batch in batches:
            for lang, text in zip(batch.column(0), batch.column(1), strict=True):
                lang, data = lang.as_py(), text.as_buffer().to_pybytes()
                held.setdefault(lang, []).append(data)
                sizes[lang] = sizes.get(lang, 0) + len(data) + 1
                # A full language goes, and the largest one when many wait.
                full = lang if sizes[lang] >= CHUNK else max(sizes, key=sizes.get) if sum(sizes.values()) >= 2 * CHUNK else None
                if full is not None:
                    yield from chunk(number, full, held.pop(full))
                    del sizes[full]
                    number += 1
        for lang in list(held):
            yield from chunk(number, lang, held.pop(lang))
            number += 1

    lean = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")).where("text <> ''")
    return cut_lineage(lean.mapInArrow(work, "chunk long, lang string, words array<string>, counts array<long>, at binary, codes binary"))


def frequent_words(chunks: DataFrame, least: int) -> DataFrame:
    """(chunk, code, lang, word, key, id, f): the frequent words of each chunk; the number of a word is the key of its first entry."""
    words = chunks.select("chunk", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("code", "w"))
    # Chunks are read from where they were written, so each entry has the same key in every try.
    keyed = words.select("chunk", "code", "lang", F.col("w.words").alias("word"), F.col("w.counts").alias("n"), F.monotonically_increasing_id().alias("key"))
    same = Window.partitionBy("lang", "word")
    return keyed.withColumns({"f": F.sum("n").over(same), "id": F.min("key").over(same)}).where(F.col("f") >= least).drop("n")


RELATION = pa.schema([
    ("chunk", pa.int64()), ("at", pa.binary()), ("codes", pa.binary()), ("pairs", pa.int64()),
    ("parts", pa.list_(pa.struct([("slice", pa.int64()), ("base", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.binary())]))),
])
RELATION_SQL = "chunk long, at binary, codes binary, pairs long, parts array<struct<slice: long, base: long, left: binary, right: binary, n: binary>>"


def extend(relation: DataFrame, slices: int, last: bool) -> DataFrame:
    """The relation one word longer: adjacent occurrences of frequent phrases, and the distinct pairs of them by slice.

    ``relation`` has chunk, at, codes and ``kept``: which codes are frequent, with
    their numbers. The ``last`` relation is only counted.
    """

    def one(chunk: int, at: np.ndarray, codes: np.ndarray, kept: np.ndarray, ids: np.ndarray) -> dict:
        # Semi-join: only occurrences of frequent phrases stay, with the phrase's place among the sorted numbers.
        names, place = np.unique(ids, return_inverse=True)
        known = np.full(int(codes.max()) + 1, -1, np.int64)
        known[kept] = place
        codes = known[codes]
        at, codes = at[codes >= 0], codes[codes >= 0]
        # Merge-join: both sides are sorted by position, so partners are neighbours.
        beside = np.flatnonzero(at[1:] == at[:-1] + 1)
        pairs, codes, counts = np.unique(codes[beside] * len(names) + codes[beside + 1], return_inverse=True, return_counts=True)
        left, right = names[pairs // max(1, len(names))], names[pairs % max(1, len(names))]
        with np.errstate(over="ignore"):
            mixed = (left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (right.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        slot = ((mixed >> np.uint64(32)) % np.uint64(slices)).astype(np.int64)
        order = np.argsort(slot, kind="stable")
        moved = np.empty(len(order), np.int64)
        moved[order] = np.arange(len(order))
        numbers, bases = np.unique(slot[order], return_index=True)
        parts = [
            {"slice": int(s), "base": int(a), "left": _shut(left[order[a:b]].astype("<i8"), True), "right": _shut(right[order[a:b]].astype("<i8")), "n": _shut(counts[order[a:b]].astype("<i8"))}
            for s, a, b in zip(numbers, bases, [*bases[1:], len(order)][: len(bases)], strict=True)
        ]
        empty = np.zeros(0, "<i8")
        return {
            "chunk": chunk, "pairs": len(pairs), "parts": parts,
            "at": _shut(empty if last else at[beside].astype("<i8"), True), "codes": _shut(empty.astype("<i4") if last else moved[codes].astype("<i4")),
        }

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("chunk", "at", "codes", "kept")}
                codes = _open(row["codes"].as_py(), "<i4")
                if not len(codes) or not len(row["kept"]):
                    continue
                inner = row["kept"].values
                kept, ids = inner.field("codes"), inner.field("ids")
                if pa.types.is_binary(kept.type):
                    kept = np.concatenate([_open(b.as_py(), "<i8", True) for b in kept])
                    ids = np.concatenate([_open(b.as_py(), "<i8") for b in ids])
                else:
                    kept, ids = kept.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)
                if len(kept):
                    yield _rows(RELATION, [one(row["chunk"].as_py(), _open(row["at"].as_py(), "<i8", True), codes, kept, ids)])

    return cut_lineage(relation.select("chunk", "at", "codes", "kept").mapInArrow(work, RELATION_SQL))


def counted(relation: DataFrame, slices: int, least: int) -> DataFrame:
    """Frequent phrases by slice: for each chunk that has some their (codes, ids), and once (chunk null) ids, parts and counts; written."""

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        lefts = [_open(b, "<i8", True) for b in frame["left"]]
        left, right, n = np.concatenate(lefts), np.concatenate([_open(b, "<i8") for b in frame["right"]]), np.concatenate([_open(b, "<i8") for b in frame["n"]])
        order = np.lexsort((right, left))
        new = np.concatenate([[True], (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)])
        heads = np.flatnonzero(new)
        totals = np.add.reduceat(n[order], heads)
        frequent = totals >= least
        # Numbers of frequent phrases, spread so that no two slices share one.
        numbers = np.where(frequent, (np.cumsum(frequent) - 1) * slices + int(frame["slice"].iloc[0]), -1)
        ids = np.empty(len(order), np.int64)
        ids[order] = numbers[np.cumsum(new) - 1]
        out, at = [], 0
        for chunk, base, part in zip(frame["chunk"], frame["base"], lefts, strict=True):
            own = ids[at : at + len(part)]
            at += len(part)
            places = np.flatnonzero(own >= 0)
            if len(places):
                out.append((chunk, _shut((base + places).astype("<i8"), True), _shut(own[places].astype("<i8")), None, None, None))
        first = order[heads[frequent]]
        if len(first):
            out.append((None, None, _shut(numbers[frequent].astype("<i8")), _shut(left[first].astype("<i8")), _shut(right[first].astype("<i8")), _shut(totals[frequent].astype("<i8"))))
        return pd.DataFrame(out, columns=["chunk", "codes", "ids", "left", "right", "f"]).astype({"chunk": "Int64"})

    parts = relation.select("chunk", F.explode("parts").alias("p")).select("chunk", "p.*")
    return cut_lineage(parts.groupBy("slice").applyInPandas(work, "chunk long, codes binary, ids binary, left binary, right binary, f binary"))


def phrases(counts: DataFrame) -> DataFrame:
    """(id, left, right, f) of each frequent phrase."""

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                yield pd.DataFrame({c: _open(getattr(row, c), "<i8") for c in ("id", "left", "right", "f")})

    lean = counts.where("chunk IS NULL").select(F.col("ids").alias("id"), "left", "right", "f")
    return lean.mapInPandas(work, "id long, left long, right long, f long")


def mined(docs: DataFrame, lang_col: str, text_col: str, least: int, words: int) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Words in each language, frequent words (lang, word, id, f), and the frequent phrases of 2, 3, ... words."""
    chunks = occurrences(docs, lang_col, text_col)
    sizes = chunks.groupBy("lang").agg(F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n"))
    single = cut_lineage(frequent_words(chunks, least))
    relation = chunks.select("chunk", "at", "codes")
    kept = single.groupBy("chunk").agg(F.collect_list(F.struct(F.col("code").alias("codes"), F.col("id").alias("ids"))).alias("kept"))
    one = single.where("key = id").select("lang", "word", "id", "f")
    level, found = one, []
    for length in range(2, words + 1):
        total = level.agg(F.coalesce(F.sum("f"), F.lit(0)).alias("n")).first()["n"]
        slices = max(1, -(-total // SLICE))
        relation = extend(relation.join(kept, "chunk"), slices, length == words)
        counts = counted(relation, slices, least)
        level = phrases(counts)
        found.append(level)
        kept = counts.where("chunk IS NOT NULL").groupBy("chunk").agg(F.collect_list(F.struct("codes", "ids")).alias("kept"))
    return sizes, one, found


def described(level: DataFrame, parts: DataFrame) -> DataFrame:
    """Phrases with their words, the counts of all their beginnings and endings, and the shorter phrases inside."""
    left = parts.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("l_phrase"), F.col("heads").alias("l_heads"), F.col("inside").alias("l_inside"), F.col("size").alias("l_size"))
    right = parts.select(F.col("id").alias("right"), F.col("last").alias("r_last"), F.col("tails").alias("r_tails"), F.col("inside").alias("r_inside"))
    own = F.when(F.col("l_size") > 1, F.transform(F.array("left", "right"), lambda i: F.struct(F.col("l_size").alias("size"), i.alias("id"))))
    none = F.array().cast("array<struct<size: int, id: bigint>>")
    return cut_lineage(
        level.join(left, "left").join(right, "right").select(
            "id", "lang", (F.col("l_size") + 1).alias("size"), F.concat_ws(" ", "l_phrase", "r_last").alias("phrase"), F.col("r_last").alias("last"), "f",
            F.concat("l_heads", F.array("f")).alias("heads"), F.concat("r_tails", F.array("f")).alias("tails"),
            F.array_distinct(F.concat(F.coalesce(own, none), "l_inside", "r_inside")).alias("inside"),
        )
    )


def least_cut(size: Column, a: Column, heads: Column, tails: Column) -> Column:
    """(score, k, l, r) of the lowest cut of a phrase, the first of equal ones; exact in decimals."""

    def cut(k: Column) -> Column:
        l, r = F.element_at(heads, k), F.element_at(tails, size - k)
        # Twenty digits hold any count, and thirty-one their product.
        score = F.call_function("div", F.lit(2_000_000).cast("decimal(10,0)") * a.cast("decimal(20,0)"), l.cast("decimal(20,0)") + r.cast("decimal(20,0)"))
        return F.struct(score.alias("score"), k.alias("k"), l.alias("l"), r.alias("r"))

    return F.array_min(F.transform(F.sequence(F.lit(1), size - 1), cut))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, words: int = WORDS, share: int = SHARE, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of 2 to ``words`` words of each language.

    Texts are folded (A-Z only) and cut into pieces and words. A phrase is frequent
    with ``least`` occurrences within pieces; overlapping ones count. Its score is
    that of its worst cut into two parts, ``floor(2000000 * a / (l + r))``. It goes
    when a longer frequent phrase that holds it has ``share`` percent of its
    occurrences. Order: score, count, then the phrase by its bytes.

    A null language is ``und``; null and empty texts, and those of separators
    only, have no words; repeated rows count again; the length of a text has no
    bound; an empty table gives no rows; other columns are not read.
    """
    sizes, single, levels = mined(docs, lang_col, text_col, least, words)
    none = F.array().cast("array<struct<size: int, id: bigint>>")
    parts = single.select("id", "lang", F.lit(1).alias("size"), F.col("word").alias("phrase"), F.col("word").alias("last"), "f", F.array("f").alias("heads"), F.array("f").alias("tails"), none.alias("inside"))
    found = None
    for level in levels:
        parts = described(level, parts)
        found = parts if found is None else found.unionByName(parts)
    longer = found.select(F.explode("inside").alias("i"), "f").groupBy(F.col("i.size").alias("size"), F.col("i.id").alias("id")).agg(F.max("f").alias("longer"))
    left = found.join(longer, ["size", "id"], "left").where(f"longer IS NULL OR 100 * longer < {share} * f")
    scored = left.select("lang", "phrase", F.col("f").alias("a"), least_cut(F.col("size"), F.col("f"), F.col("heads"), F.col("tails")).alias("c"))
    flat = scored.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    # A language may have most of the phrases, so ranks come from ranges of the order.
    order = ["_score", "_a", "phrase"]
    placed = scans.range_segments(flat.withColumns({"_score": -F.col("score"), "_a": -F.col("a")}), ["lang"], order)
    ranked = scans.row_numbers(placed, ["lang"], order, "rank").where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


@query(
    r"""
    WITH d AS (
        SELECT row_number() OVER () AS d, coalesce(lang, 'und') AS lang,
               translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL
    ), p AS (
        SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
    ), w AS (
        SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p
    ), g AS (
        SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase
        FROM w, (SELECT unnest([1, 2, 3, 4]) AS k)
    ), f AS (
        SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL
    ), n AS (
        SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang
    ), c AS (
        SELECT lang, k AS size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND a >= 30
    ), inner_phrases AS (
        SELECT lang, unnest(flatten(list_transform(range(2, size), lambda m: list_transform(range(1, size - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))))) AS phrase, a
        FROM c WHERE size > 2
    ), longer AS (
        SELECT lang, phrase, max(a) AS most FROM inner_phrases GROUP BY ALL
    ), cuts AS (
        SELECT lang, phrase, a, w, unnest(range(1, size)) AS k FROM c
    ), scored AS (
        SELECT x.lang, x.phrase, x.a, l.a AS l, r.a AS r, CAST(CAST(2000000 AS HUGEINT) * x.a // (l.a + r.a) AS BIGINT) AS score, x.k
        FROM cuts x JOIN f l ON l.lang = x.lang AND l.k = x.k AND l.phrase = array_to_string(x.w[1:x.k], ' ')
        JOIN f r ON r.lang = x.lang AND r.k = len(x.w) - x.k AND r.phrase = array_to_string(x.w[x.k + 1:], ' ')
        QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, x.k) = 1
    )
    SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, s.phrase) AS rank, s.phrase, s.a, s.l, s.r, CAST(n.n AS BIGINT) AS n, s.score
    FROM scored s JOIN n USING (lang) LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
    WHERE g.most IS NULL OR 100 * g.most < 80 * s.a
    QUALIFY rank <= 2000
    """
)
def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    """The best phrases of each language over all documents."""
    return collocations(table(spark, folder, "documents"))
