"""Receipt annotations (nested JSON) to amounts and items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casewright.functions import text
from casewright.functions.arrays import once

# Fields of the subtotal and total blocks that carry an amount.
SUBTOTAL_FIELDS = ("subtotal_price", "tax_price", "service_price", "discount_price")
TOTAL_FIELDS = ("total_price", "cashprice", "changeprice", "creditcardprice", "emoneyprice")
MENU_FIELDS = ("price", "unitprice", "itemsubtotal")


def as_list(v: Column) -> Column:
    """A variant that may be missing, a single value or a list, as an array of variants."""

    def listed(x: Column) -> Column:
        alone = F.when(x.isNull() | F.is_variant_null(x), F.array().cast("array<variant>")).otherwise(F.array(x))
        return F.coalesce(F.try_variant_get(x, "$", "array<variant>"), alone)

    return once(v, listed)


def part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def last_with(block: Column, name: str) -> Column:
    """Field of a block, given as its list of objects, where the last one that has it wins."""
    held = F.filter(F.transform(block, lambda o: part(o, name)), lambda x: x.isNotNull() & ~F.is_variant_null(x))
    return F.try_element_at(held, F.lit(-1))


def raw_text(v: Column) -> Column:
    """Text of a value, or of the first entry of a list."""

    def read(x: Column) -> Column:
        listed = F.schema_of_variant(x).startswith("ARRAY")
        return F.when(listed, F.try_variant_get(x, "$[0]", "string")).otherwise(F.try_variant_get(x, "$", "string"))

    return once(v, read)


def _named(block: str, names: tuple[str, ...]) -> list[Column]:
    return [F.struct(F.lit(n).alias("kind"), last_with(F.col(block), n).alias("v")) for n in names]


def _tagged(values: Column, kind: str) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))


def _menu_values(name: str) -> Column:
    return F.flatten(F.transform("_menu", lambda m: _tagged(as_list(part(m, name)), f"menu_{name}")))


def _blocks(df: DataFrame, row_id: str, parsed: str) -> DataFrame:
    """The three blocks of a receipt as lists."""
    root = F.col(parsed)
    menu = F.filter(as_list(part(root, "menu")), lambda m: F.schema_of_variant(m).startswith("OBJECT"))
    blocks = [as_list(part(root, name)).alias(out) for name, out in (("sub_total", "_sub"), ("total", "_tot"))]
    return df.select(row_id, *blocks, menu.alias("_menu"))


def _rows(df: DataFrame, row_id: str, entries: Column) -> DataFrame:
    """One row per struct of an array.

    Rows without entries are dropped after the explosion: the optimizer copies the
    filter it would put before it, with the whole array, into every step below.
    """
    return df.select(row_id, F.explode_outer(entries).alias("_x")).where("_x is not null").select(row_id, "_x.*")


def receipt_amounts(df: DataFrame, row_id: str, parsed: str) -> DataFrame:
    """(row_id, kind, amount) for every readable amount of a receipt.

    ``parsed`` is a variant column with ``menu``, ``sub_total`` and ``total``;
    each block and each price may be a single value or a list. Texts are parsed
    within the receipt's array, each once.
    """
    nested = F.flatten(
        F.transform(
            "_menu",
            lambda m: F.flatten(F.transform(as_list(part(m, "sub")), lambda s: _tagged(as_list(part(s, "price")), "menu_sub_price"))),
        )
    )
    every = F.concat(
        F.array(*_named("_sub", SUBTOTAL_FIELDS), *_named("_tot", TOTAL_FIELDS)),
        _tagged(as_list(last_with(F.col("_sub"), "etc")), "sub_etc"),
        *[_menu_values(name) for name in MENU_FIELDS],
        nested,
    )
    there = F.filter(every, lambda p: p["v"].isNotNull())
    read = F.transform(there, lambda p: F.struct(p["kind"].alias("kind"), text.amount(raw_text(p["v"])).alias("amount")))
    return _rows(_blocks(df, row_id, parsed), row_id, F.filter(read, lambda p: p["amount"].isNotNull()))


def receipt_items(df: DataFrame, row_id: str, parsed: str) -> DataFrame:
    """(row_id, pos, name, price) for menu entries with a name and a readable price."""

    def entry(m: Column, i: Column) -> Column:
        name, price = F.trim(raw_text(part(m, "nm"))), text.amount(raw_text(part(m, "price")))
        return F.struct(i.alias("pos"), name.alias("name"), price.alias("price"))

    kept = F.filter(F.transform("_menu", entry), lambda e: (e["name"] != "") & e["price"].isNotNull())
    return _rows(_blocks(df, row_id, parsed), row_id, kept)


def field_presence(df: DataFrame, row_id: str, parsed: str, fields: list[str]) -> DataFrame:
    """(row_id, field, gold): ``A`` if present with an amount, ``B`` if absent; unreadable ones are left out."""
    named = [x for n in fields for x in _named("_sub" if n in SUBTOTAL_FIELDS else "_tot", (n,))]

    def judged(p: Column) -> Column:
        gold = F.when(p["v"].isNull(), "B").when(text.amount(raw_text(p["v"])).isNotNull(), "A")
        return F.struct(p["kind"].alias("field"), gold.alias("gold"))

    judgements = F.filter(F.transform(F.array(*named), judged), lambda p: p["gold"].isNotNull())
    return _rows(_blocks(df, row_id, parsed), row_id, judgements)
