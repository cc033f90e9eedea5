"""Row-level scoring expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prediction(qtype: Column, choice: Column, noul: Column) -> Column:
    """Chosen option, or ``true``/``false`` for a yes-no probability."""
    return F.when(qtype == "choice", choice).otherwise((noul >= 0.5).cast("string"))


def semantic_label(qtype: Column, criteria: Column, value: Column) -> Column:
    """Description of an option (so options that say the same are one label).

    ``criteria`` is ``array<struct<option,descr>>``; ``descr`` is kept as text,
    JSON objects in canonical form.
    """
    hit = F.filter(criteria, lambda c: c["option"] == value)
    described = F.coalesce(F.try_element_at(hit, F.lit(1))["descr"], value)
    return F.when(qtype == "choice", described).otherwise(value)


def confidence(qtype: Column, probabilities: Column, noul: Column) -> Column:
    top = F.array_max(F.map_values(probabilities))
    return F.when(qtype == "choice", top).otherwise(F.greatest(noul, 1 - noul))


def clip(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def skill(raw: Column, chance: Column) -> Column:
    """Chance-corrected score in [0,1]."""
    return clip((raw - chance) / (1 - chance))


def share(answered: Column, requests: Column) -> Column:
    return F.coalesce(F.try_divide(answered.cast("double"), requests), F.lit(1.0))


def rounded(x: Column, digits: int = 4) -> Column:
    """Rounded, never -0.0."""
    return F.round(x, digits) + F.lit(0.0)


def usable_probability(p: Column) -> Column:
    return p.isNotNull() & ~F.isnan(p) & p.between(0.0, 1.0)


def brier(p: Column, outcome: Column) -> Column:
    return F.pow(p - outcome.cast("double"), F.lit(2.0))


def log_loss(p: Column, outcome: Column) -> Column:
    y = outcome.cast("double")
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), p))
    return -y * F.log(q) - (1 - y) * F.log1p(-q)


def softmax(scores: Column) -> Column:
    """Option probabilities; uniform when every score is minus infinity."""
    top = F.array_max(scores)
    weights = F.transform(scores, lambda x: F.exp(x - top))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    uniform = F.transform(scores, lambda x: F.lit(1.0) / F.size(scores))
    return F.when(top == float("-inf"), uniform).otherwise(F.transform(weights, lambda x: x / total))


def first_max(scores: Column) -> Column:
    """0-based position of the first largest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def normalized(keys: Column, probabilities: Column, choice: Column) -> Column:
    """Probabilities scaled to 1; all on the choice if they are all zero."""
    total = F.aggregate(probabilities, F.lit(0.0), lambda a, x: a + x)
    onehot = F.transform(keys, lambda k: (k == choice).cast("double"))
    return F.when(total > 0, F.transform(probabilities, lambda p: p / total)).otherwise(onehot)


def gain(rel: Column) -> Column:
    return F.pow(F.lit(2.0), rel) - 1


def discount(position: Column) -> Column:
    """1 / log2(position + 1) for a 1-based position."""
    return 1.0 / F.log2(position + 1.0)


def invalid_reason(qtype: Column, options: Column, choice: Column, probabilities: Column, noul: Column) -> Column:
    """First failed check of one answer; null when the answer is valid."""
    values = F.map_values(probabilities)
    bad = F.exists(values, lambda v: v.isNull() | F.isnan(v) | ~v.between(0.0, 1.0))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    keys_differ = F.array_sort(F.map_keys(probabilities)) != F.array_sort(options)
    choice_reason = F.when(
        choice.isNull() | ~F.array_contains(options, F.coalesce(choice, F.lit(""))), "invalid chosen answer"
    ).when(
        probabilities.isNull() | keys_differ | bad | (F.abs(total - 1) > 0.01),
        "incomplete or invalid probability distribution",
    )
    noul_reason = F.when(~usable_probability(noul), "invalid yes-no probability")
    return (
        F.when(qtype == "choice", choice_reason)
        .when(qtype == "noul", noul_reason)
        .otherwise("unsupported question type")
    )
