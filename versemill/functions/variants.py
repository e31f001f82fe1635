"""What a model returns, as VARIANT (X61, X64): parsed once, told apart by type, kept or dropped with a reason; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spans import once

WHOLE = r"^\s*[+-]?\d{1,18}\s*$"
ITEM = "array<struct<id: string, tier: string, reason: string>>"


def kind(v: Column) -> Column:
    """The JSON type of a variant: object, array, string, whole, number, boolean or null; null for SQL's null."""
    name = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), None).when(F.startswith(name, F.lit("OBJECT")), "object").when(F.startswith(name, F.lit("ARRAY")), "array").when(name == "STRING", "string")
        .when(name == "BIGINT", "whole").when(name == "BOOLEAN", "boolean").when(name == "VOID", "null").otherwise("number")
    )


def elements(v: Column) -> Column:
    """The elements of a variant that is an array, else null."""
    return F.when(kind(v) == "array", F.try_variant_get(v, "$", "array<variant>"))


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _unpacked(v: Column) -> Column:
    """A string that holds JSON is that JSON."""
    return F.when(kind(v) == "string", F.coalesce(F.try_parse_json(_text(v)), v)).otherwise(v)


def _item(id_: Column, tier: Column, reason: Column) -> Column:
    return F.array(F.struct(id_.cast("string").alias("id"), tier.alias("tier"), reason.alias("reason")))


def _judged(kept: Column | None, dropped: Column | None, reason: str = "") -> Column:
    """(kept, dropped) of one element."""
    none, lost = F.array().cast(ITEM), F.array().cast("array<struct<item: string, reason: string>>")
    return F.struct((none if kept is None else kept).alias("kept"), (lost if dropped is None else F.array(F.struct(dropped.alias("item"), F.lit(reason).alias("reason")))).alias("dropped"))


def _named(v: Column) -> Column:
    """An object with an id as it is; others are dropped."""
    fields = [F.try_variant_get(v, f"$.{n}", "string") for n in ("id", "tier", "reason")]
    has = (kind(v) == "object") & F.try_variant_get(v, "$.id", "variant").isNotNull()
    return F.when(has, _judged(_item(*fields), None)).otherwise(_judged(None, F.to_json(v), "no id"))


def _flat(parts: Column) -> Column:
    return once(parts, lambda x: F.struct(F.flatten(F.transform(x, lambda p: p["kept"])).alias("kept"), F.flatten(F.transform(x, lambda p: p["dropped"])).alias("dropped")))


def _typed(v: Column) -> Column:
    return F.struct(v.alias("v"), kind(v).alias("k"))


def selected(raw: Column) -> Column:
    """Struct (kept, dropped) of selected ids in any of the shapes that models give: objects with an id, whole numbers,
    numerals, any of these as a JSON string, the list as a JSON string, one list more around.

    ``kept``: (id, tier, reason), bare ids with tier ``publish``. ``dropped``: (item as JSON, reason). In order. A null text has neither.
    """
    default = lambda id_: _judged(_item(id_, F.lit("publish"), F.lit("")), None)

    def one(item: Column) -> Column:
        v, k = item["v"], item["k"]
        number = (k == "string") & _text(v).rlike(WHOLE)  # such as 007, which is no JSON
        nested = _flat(F.transform(F.coalesce(elements(v), F.array().cast("array<variant>")), _named))
        return (
            F.when(k == "object", _named(v)).when(k == "whole", default(_text(v))).when(number, default(F.trim(_text(v)).cast("long"))).when(k == "array", nested)
            .otherwise(_judged(None, F.to_json(v), "no number, no object"))
        )

    def read(text: Column, given: Column) -> Column:
        v, k = given["v"], given["k"]
        items = F.transform(F.transform(F.try_variant_get(v, "$", "array<variant>"), _unpacked), _typed)
        return F.when(text.isNull(), _judged(None, None)).when(v.isNull(), _judged(None, text, "no JSON")).when(k != "array", _judged(None, F.to_json(v), "no list")).otherwise(_flat(F.transform(items, one)))

    return once(raw, lambda text: once(_unpacked(F.try_parse_json(text)), lambda v: once(_typed(v), lambda given: read(text, given))))


def failures(rows: DataFrame, key: str, answer: str) -> DataFrame:
    """(key, item, reason) for the failure log: what was dropped from the ``answer`` struct of each row."""
    return rows.select(key, F.inline(F.col(f"{answer}.dropped")))
