"""From case and result tables to one row per scored field."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright import schema
from casewright.functions import arrays, scoring, text


def requests(cases: DataFrame) -> DataFrame:
    """What a predictor may see: state and questions, never gold."""
    return cases.select(*schema.REQUEST_COLUMNS)


def choice_case(
    df: DataFrame, options: str, gold_index: str, instructions: str, key: str = "q1"
) -> DataFrame:
    """Lettered choice question and gold key from an option array; 2 to 255 options."""
    n = F.size(options)
    keys = arrays.choice_keys(n)
    gold = F.col(gold_index)
    checked = F.when((n >= 2) & (n <= 255) & (gold >= 0) & (gold < n), keys).otherwise(
        F.raise_error(F.concat(F.lit("bad choice case: options="), n.cast("string"), F.lit(" gold="), gold.cast("string")))
    )
    criteria = F.zip_with(F.col("_keys"), F.col(options), lambda k, v: F.struct(k.alias("option"), v.alias("descr")))
    question = F.struct(
        F.lit(key).alias("key"), F.lit("choice").alias("type"), F.col(instructions).alias("instructions"), criteria.alias("criteria")
    )
    return (
        df.withColumn("_keys", checked)
        .withColumn("questions", F.array(question))
        .withColumn("expected", F.create_map(F.lit(key), F.element_at("_keys", gold.cast("int") + 1)))
        .drop("_keys")
    )


# Fixed value: what a request says when the options are printed in the image.
SHOWN_IN_IMAGE = "Answer the multiple-choice question shown in the image (options A-"


def image_choice_case(df: DataFrame, options: str, question: str, options_in_image: str) -> DataFrame:
    """Vision request: image marks renamed; options printed in the image map to themselves."""
    keys = arrays.choice_keys(F.size(options))
    inside = F.col(options_in_image)
    last = F.element_at(keys, -1)
    shown = F.concat(F.lit(SHOWN_IN_IMAGE), last, F.lit(")."))
    return (
        df.withColumn("instructions", F.when(inside, shown).otherwise(text.rename_image_marks(F.col(question))))
        .withColumn("option_keys", keys)
        .withColumn("option_texts", F.when(inside, keys).otherwise(F.col(options)))
    )


def gold_within(df: DataFrame, gold: str, options: str) -> DataFrame:
    """Drop rows whose gold letter is not one of the options."""
    return df.where(F.array_contains(arrays.choice_keys(F.size(options)), F.col(gold)))


def label_questions(df: DataFrame, labels: list[str], gold_labels: str) -> DataFrame:
    """One yes-no row per label of a multi-label gold array."""
    pairs = F.array(
        *[
            F.struct(F.lit(x).alias("field"), F.when(F.array_contains(gold_labels, x), "yes").otherwise("no").alias("gold"))
            for x in labels
        ]
    )
    return df.withColumn("_q", F.explode(pairs)).withColumns({"field": F.col("_q.field"), "gold": F.col("_q.gold")}).drop("_q")


def fields(cases: DataFrame) -> DataFrame:
    """Cases exploded to one row per question, with option list and gold label."""
    q = F.col("_q")
    gold = F.try_element_at("expected", q["key"])
    options = F.when(q["type"] == "noul", F.array(F.lit("true"), F.lit("false"))).otherwise(
        F.transform(q["criteria"], lambda c: c["option"])
    )
    return cases.withColumn("_q", F.explode("questions")).select(
        "run_id", "catalog_id", "group_id", "track",
        q["key"].alias("field"),
        q["type"].alias("qtype"),
        options.alias("options"),
        F.size(options).cast("bigint").alias("n_options"),
        q["criteria"].alias("criteria"),
        gold.alias("gold"),
        scoring.semantic_label(q["type"], q["criteria"], gold).alias("gold_label"),
    )


def scored_fields(fields_df: DataFrame, unscored: DataFrame | None = None, only: DataFrame | None = None) -> DataFrame:
    """Leave out fields listed as unscored; for catalogs with an allow-list keep its fields only.

    ``unscored(run_id, field)`` comes with the cases and may be large;
    ``only(catalog_id, field)`` is one row per allowed field of a benchmark.
    """
    out = fields_df
    if unscored is not None:
        out = out.join(unscored, ["run_id", "field"], "left_anti")
    if only is not None:
        allowed = only.select("catalog_id", "field", F.lit(True).alias("_allowed"))
        limited = only.select("catalog_id").distinct().withColumn("_limited", F.lit(True))
        out = out.join(limited, "catalog_id", "left").join(allowed, ["catalog_id", "field"], "left")
        out = out.where(F.col("_limited").isNull() | F.col("_allowed")).drop("_limited", "_allowed")
    return out


def answers(results: DataFrame) -> DataFrame:
    """Results exploded to one row per answered field."""
    return results.where("status = 'ok'").select(
        "engine", "run_id", F.explode("answers").alias("field", "_a")
    ).select(
        "engine", "run_id", "field",
        F.col("_a.type").alias("atype"),
        F.col("_a.choice").alias("choice"),
        F.col("_a.noul").alias("noul"),
        F.col("_a.probabilities").alias("probabilities"),
    )


def fact(fields_df: DataFrame, latest_results: DataFrame, more: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """Fields left-joined to the latest result: one row per field, unanswered ones included.

    ``more`` adds columns made of the answer to a field, null where there is none.
    """
    res = latest_results.select("run_id", "status", "answers", "total_wall_ms")
    joined = fields_df.join(res, "run_id", "left")
    a = F.try_element_at("answers", F.col("field"))
    ok = F.coalesce(F.col("status") == "ok", F.lit(False))
    pred = F.when(ok, scoring.prediction(F.col("qtype"), a["choice"], a["noul"]))
    return (
        joined.withColumn("status", F.coalesce("status", F.lit("pending")))
        .withColumn("pred", pred)
        .withColumn("pred_label", scoring.semantic_label(F.col("qtype"), F.col("criteria"), pred))
        .withColumn("conf", F.when(ok, scoring.confidence(F.col("qtype"), a["probabilities"], a["noul"])))
        .withColumns({name: F.when(ok, of(a)) for name, of in (more or {}).items()})
        .drop("answers", "criteria")
    )


def validated(fields_df: DataFrame, answers_df: DataFrame) -> DataFrame:
    """Check each answered request: same question keys, valid answers; adds ``reason`` per run."""
    joined = fields_df.join(answers_df, ["run_id", "field"], "full")
    reason = (
        F.when(F.col("qtype").isNull() | F.col("atype").isNull(), "question keys mismatch")
        .when(F.col("qtype") != F.col("atype"), "type mismatch")
        .otherwise(
            scoring.invalid_reason(
                F.col("qtype"), F.col("options"), F.col("choice"), F.col("probabilities"), F.col("noul")
            )
        )
    )
    # The first check that failed, in the order the checks are made, then by question.
    order = F.when(F.col("_r") == "question keys mismatch", 0).when(F.col("_r") == "type mismatch", 1).otherwise(2)
    first = F.min(F.when(F.col("_r").isNotNull(), F.struct(order.alias("o"), F.col("field"), F.col("_r"))))
    checked = joined.withColumn("_r", reason).groupBy("run_id").agg(first.alias("_f"))
    return checked.select("run_id", F.col("_f._r").alias("reason")).withColumn("valid", F.col("reason").isNull())


def prompt(instructions: Column, keys: Column, texts: Column, mark: str = ": ") -> Column:
    """Instructions followed by one ``key: text`` line per option."""
    lines = F.zip_with(keys, texts, lambda k, v: F.concat(k, F.lit(mark), v))
    return F.concat_ws("\n", F.array(instructions), lines)
