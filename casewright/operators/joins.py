"""Dimension lookups and question inventories used by suite builders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import scans, text
from casewright.functions.skew import broadcast_if_small
from casewright.session import cut_lineage


def dimension(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join to a lookup table, broadcast only when its row count allows it."""
    return left.join(broadcast_if_small(right), keys, how)


def titled_documents(refs: DataFrame, documents: DataFrame, row_id: str, titles: str, doc_title: str, content: str) -> DataFrame:
    """Contents of the referenced titles in reference order; each title must hit exactly once.

    Titles are compared in canonical decomposition. ``hits_ok`` is false when a
    title had no hit or several.
    """
    wanted = refs.select(row_id, F.posexplode(F.array_distinct(titles)).alias("_pos", "_title")).withColumn(
        "_key", text.nfd("_title")
    )
    # Only documents that are asked for are shuffled with their contents.
    asked = wanted.select("_key").distinct()
    kept = documents.select(text.nfd(F.col(doc_title)).alias("_key"), F.col(content).alias("_c")).join(broadcast_if_small(asked), "_key", "left_semi")
    stored = kept.groupBy("_key").agg(F.count(F.lit(1)).alias("_hits"), F.min("_c").alias("_content"))
    met = wanted.join(stored, "_key", "left")
    return met.groupBy(row_id).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("_pos", "_content"))), lambda s: s["_content"]
        ).alias("contents"),
        F.bool_and(F.coalesce(F.col("_hits") == 1, F.lit(False))).alias("hits_ok"),
    )


def by_composite_key(left: DataFrame, right: DataFrame, source: str, id_col: str) -> DataFrame:
    """Left join on (source, id) where the id may be a list: compared as JSON text.

    Fails on a repeated right key, as a question may only be published once.
    """
    def keyed(df: DataFrame) -> DataFrame:
        is_list = df.schema[id_col].dataType.typeName() == "array"
        return df.withColumn("_id", F.to_json(id_col) if is_list else F.col(id_col).cast("string"))

    r = keyed(right).drop(id_col)
    repeated = r.groupBy(source, "_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"key occurs more than once: {repeated[0].asDict()}")
    return keyed(left).join(r.withColumn("matched", F.lit(True)), [source, "_id"], "left").drop("_id").withColumn(
        "matched", F.coalesce("matched", F.lit(False))
    )


def inventory_questions(
    reviews: DataFrame, inventory: DataFrame, row_id: str, domain: str, pairs: str, category: str, sentiments: list[str], block: int = 64
) -> DataFrame:
    """Yes-no questions for every category and sentiment of a review's domain, in blocks of at most 64.

    Categories and sentiments of a domain are numbered in order, by ranges of the
    order, and cut into blocks; a block is all of an inventory that is ever in one
    row. What a review has becomes one bitmap for each block it touches: its pairs
    meet the numbers, and the bits are combined before they are shuffled.
    ``row_id`` tells the reviews apart.
    """
    if not 1 <= block <= 64:
        raise ValueError(f"a block has 1 to 64 entries, not {block}")
    each = F.explode(F.array(*[F.lit(s) for s in sentiments]))
    entries = inventory.select(domain, category).distinct().withColumn("_s", each)
    cut = scans.range_segments(entries, [domain], [category, "_s"])
    placed = scans.row_numbers(cut, [domain], [category, "_s"]).withColumn("_at", F.col("rn") - 1)
    numbered = cut_lineage(placed.select(domain, F.col(category).alias("category"), F.col("_s").alias("sentiment"),
                                         F.expr(f"_at div {block}").alias("_b"), (F.col("_at") % block).cast("int").alias("_bit")))
    blocks = numbered.groupBy(domain, "_b").agg(F.array_sort(F.collect_list(F.struct("_bit", "category", "sentiment"))).alias("_items"))
    has = reviews.select(row_id, domain, F.explode(F.array_distinct(pairs)).alias("_pair"))
    met = has.join(broadcast_if_small(numbered.withColumn("_pair", F.concat_ws("|", "category", "sentiment"))), [domain, "_pair"])
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_bit"))
    present = met.groupBy(row_id, "_b").agg(F.bit_or(bit).alias("_bits"))
    out = reviews.join(broadcast_if_small(blocks), domain).join(present, [row_id, "_b"], "left")
    golds = F.transform(
        "_items",
        lambda x: F.struct(
            F.concat(x["category"], F.lit("__sentiment_"), x["sentiment"]).alias("field"),
            F.when(F.getbit(F.coalesce("_bits", F.lit(0).cast("bigint")), x["_bit"]) == 1, "yes").otherwise("no").alias("gold"),
        ),
    )
    return out.withColumns({"block": (F.col("_b") + 1).cast("int"), "questions": golds}).drop("_b", "_bits", "_items")


def linked(entities: DataFrame, form: str, row_id: str, links: str, label: str) -> DataFrame:
    """Question entities with the answer entities their links point to: (form, id, answer_id)."""
    ends = entities.where(F.col(label) == "question").select(form, row_id, F.explode(links).alias("_to"))
    answers = entities.where(F.col(label) == "answer").select(form, F.col(row_id).alias("_to"))
    return ends.join(answers, [form, "_to"]).select(form, row_id, F.col("_to").alias("answer_id"))


def without_leaks(rows: DataFrame, barred: DataFrame, keys: list[str]) -> DataFrame:
    """Drop rows whose key occurs among the barred ones."""
    return rows.join(barred.select(*keys).distinct(), keys, "left_anti")


def existing_only(splits: list[DataFrame], listing: DataFrame, path: str) -> DataFrame:
    """Union of splits restricted to files that exist."""
    out = splits[0]
    for part in splits[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out.join(listing.select(path).distinct(), path, "left_semi")


def tied_out(rows: DataFrame, label: Column, consistent: Column) -> tuple[DataFrame, DataFrame]:
    """(rows whose sides do not tie, rows among them whose label contradicts the values)."""
    kept = rows.where(label != 0)
    return kept, kept.where(~consistent)


def ordered_distinct(rows: DataFrame, keys: list[str], value: str, order: str, out: str) -> DataFrame:
    """Distinct values of each key as a list, in the order they first appear; counted before the shuffle."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias("_at"))
    listed = first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_at", value))).alias("_l"))
    return listed.select(*keys, F.transform("_l", lambda e: e[value]).alias(out))
