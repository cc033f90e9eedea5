"""Array helpers that stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def once(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often the body names it.

    A bound variable is no alias: neither merged projections nor filters that move
    below them copy the value's expression into each place.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def same_set(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))


def subset(needed: Column, available: Column) -> Column:
    return F.size(F.array_except(needed, available)) == 0


def no_repeats(a: Column) -> Column:
    return F.size(a) == F.size(F.array_distinct(a))


def choice_keys(n: Column) -> Column:
    """A..Z up to 26 options, ``option_i`` beyond."""
    positions = F.sequence(F.lit(0), n.cast("int") - 1)
    letters = F.transform(positions, lambda i: F.char(i + 65))
    numbered = F.transform(positions, lambda i: F.concat(F.lit("option_"), i.cast("string")))
    return F.when(n <= 26, letters).otherwise(numbered)


def ring_window(values: Column, gold: Column, shift: Column, width: int) -> Column:
    """``width`` consecutive values on the sorted ring, with the gold at offset ``shift``."""
    ring = F.array_sort(values)
    n = F.size(ring)
    start = F.array_position(ring, gold).cast("int") - 1 - shift
    steps = F.sequence(F.lit(0), F.lit(width - 1))
    return F.transform(steps, lambda t: F.element_at(ring, F.pmod(start + t, n) + 1))


def kept_boxes(boxes: Column, target: Column) -> Column:
    """Walk the boxes in order; keep one if it meets neither the target nor a kept one."""

    def meet(a: Column, b: Column) -> Column:
        return ~((a["x1"] <= b["x0"]) | (b["x1"] <= a["x0"]) | (a["y1"] <= b["y0"]) | (b["y1"] <= a["y0"]))

    empty = F.filter(boxes, lambda b: F.lit(False))
    return F.aggregate(
        boxes,
        empty,
        lambda kept, b: F.when(meet(target, b) | F.exists(kept, lambda k: meet(k, b)), kept).otherwise(
            F.concat(kept, F.array(b))
        ),
    )


def call_names(calls: Column) -> Column:
    """Distinct keys of an array of maps."""
    return F.array_distinct(F.flatten(F.transform(calls, F.map_keys)))


def merged(maps: Column) -> Column:
    """Merge an array of maps; later entries win."""
    entries = F.flatten(F.transform(maps, F.map_entries))
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = F.transform(
        keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    )
    return F.map_from_arrays(keys, last)
