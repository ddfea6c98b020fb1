"""Validation of nested rows: typed fields with error lists, all-or-nothing batches, domains and keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRUE, FALSE = ["true", "t", "yes", "y", "on", "1"], ["false", "f", "no", "n", "off", "0"]


def _field(raw: Column, text: Column, shape: Column, name: str, kind: str, least: int | None, required: bool) -> tuple[Column, Column]:
    """(value or null, error or null) of a field, from its variant, that as text, and its schema (MISSING where there is none).

    Numbers may come as whole numbers, whole decimals, booleans or their text; booleans as 0, 1 or usual words; text
    only as text. A whole number beyond 64 bits is an error.
    """
    is_text, is_bool = shape == "STRING", shape == "BOOLEAN"
    number = shape.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if kind == "string":
        ok, value = is_text, text
    elif kind == "boolean":
        word = F.lower(text)
        ok = (is_bool | is_text | number) & word.isin(TRUE + FALSE) | number & text.isin("1.0", "0.0")
        value = word.isin([*TRUE, "1.0"])
    elif kind == "long":
        exact = F.when(is_bool, F.try_variant_get(raw, "$", "int").cast("decimal(38,6)")).otherwise(F.trim(text).try_cast("decimal(38,6)"))
        whole = F.when(is_text, F.trim(text).rlike(r"^[+-]?\d+(\.0*)?$")).otherwise(number | is_bool)
        ok = whole & (exact == F.floor(exact)) & exact.between(-(2**63), 2**63 - 1)
        value = exact.try_cast("long")
        if least is not None:
            ok = ok & (value >= least)
    else:
        ok, value = shape.startswith("ARRAY"), F.try_variant_get(raw, "$", "array<variant>")
    ok = F.coalesce(ok, F.lit(False))
    if not required:
        ok = ok | (shape == "MISSING")
        value = F.coalesce(value, F.array().cast("array<variant>")) if kind == "array" else value
    why = F.when(shape == "MISSING", F.lit(f"{name}: missing")).when(shape == "VOID", F.lit(f"{name}: null")).otherwise(F.lit(f"{name}: invalid"))
    return F.when(ok, value), F.when(~ok, why)


def validate(rows: DataFrame, fields: dict[str, tuple[str, int | None, bool]], column: str = "value") -> DataFrame:
    """rows with a column per field and errors, an array of text, in place of the variant column; other fields are ignored.

    A field's variant, text and schema are columns first, so that each is read once a row however often it is looked at.
    """
    part = lambda what, name: f"_{what} of {name}"
    picked = rows.withColumns({part("variant", n): F.try_variant_get(column, f"$.{n}", "variant") for n in fields})
    seen = {part("text", n): F.try_variant_get(part("variant", n), "$", "string") for n in fields}
    seen |= {part("schema", n): F.coalesce(F.schema_of_variant(part("variant", n)), F.lit("MISSING")) for n in fields}
    parts = {n: [F.col(f"`{part(what, n)}`") for what in ("variant", "text", "schema")] for n in fields}
    found = {n: _field(*parts[n], n, *spec) for n, spec in fields.items()}
    errors = F.filter(F.array(*(e for _, e in found.values())), lambda e: e.isNotNull())
    checked = picked.withColumns(seen).withColumns({**{n: v for n, (v, _) in found.items()}, "errors": errors})
    return checked.drop(column, *(part(what, n) for n in fields for what in ("variant", "text", "schema")))


def batch_gate(rows: DataFrame, batch: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine): one row with errors rejects its whole batch.

    The verdict per batch is aggregated and joined, so that a large batch is never gathered in one task.
    """
    verdict = rows.groupBy(*batch).agg(F.bool_and(F.size("errors") == 0).alias("_whole"))
    judged = rows.join(verdict, batch)
    return judged.where("_whole").drop("_whole", "errors"), judged.where("not _whole").drop("_whole")


def explode_objects(docs: DataFrame, list_field: str) -> DataFrame:
    """One row per object in a list of each document (column doc); elements of other kinds are dropped. Adds pos, value."""
    docs = docs.withColumn("_list", F.try_variant_get("doc", f"$.{list_field}", "variant"))
    view = docs.where(F.schema_of_variant("_list").startswith("ARRAY"))
    items = view.lateralJoin(view.sparkSession.tvf.variant_explode(F.col("_list").outer()))
    return items.where(F.schema_of_variant("value").startswith("OBJECT")).drop("_list", "doc", "key")


def require_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(reduce(lambda a, b: a & b, (F.coalesce(F.col(c), F.lit("")) != "" for c in keys)))


def domain_check(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    """Adds in_domain; null is outside."""
    return rows.withColumn("in_domain", F.coalesce(F.col(column).isin(values), F.lit(False)))


def optional_filters(rows: DataFrame, **equals: str | None) -> DataFrame:
    """Equality filters for those arguments that have a value."""
    return reduce(lambda df, kv: df.where(F.col(kv[0]) == kv[1]), ((k, v) for k, v in equals.items() if v not in (None, "")), rows)


def ordinal(column: str, values: list[str]) -> Column:
    """The place of a value in its ordered domain, from 0; values outside come last."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, values)), F.col(column)) - 1, F.lit(len(values)))


