"""Small helpers for arrays of structs that stay inside one row."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F


def derive(array: Column, fields: Callable[[Column], dict[str, Column]]) -> Column:
    """Add fields to every struct of an array.

    Chaining calls names intermediate values, so each is computed once per
    element however often later steps read it.
    """

    def extend(item: Column) -> Column:
        for name, value in fields(item).items():
            item = item.withField(name, value)
        return item

    return F.transform(array, extend)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with `value` computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def present(*items: Column) -> Column:
    """The non-NULL items, in order."""
    return F.array_compact(F.array(*items))


def first_of(array: Column, condition: Callable[[Column], Column]) -> Column:
    """The first element that meets a condition, or NULL."""
    return F.get(F.filter(array, condition), F.lit(0))


def rows_of(df: DataFrame, *keys: str, item: Column | str, name: str, pos: str | None = None) -> DataFrame:
    """One row per element of an array: `(keys..., [pos,] name)`.

    The outer form with a filter after it keeps Catalyst from deriving a
    "has elements" filter, which would repeat the whole array expression.
    """
    unnested = F.explode_outer(item).alias(name) if pos is None else F.posexplode_outer(item).alias(pos, name)
    return df.select(*keys, unnested).filter(F.col(name).isNotNull())


# --- constants --------------------------------------------------------------
# Written as SQL text: one call into the JVM instead of one per element.


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def string_array(values: Iterable[str]) -> Column:
    items = ", ".join(map(sql_text, values))
    return F.expr(f"array({items})" if items else "CAST(array() AS array<string>)")


def string_map(pairs: Mapping[str, str]) -> Column:
    items = ", ".join(f"{sql_text(k)}, {sql_text(v)}" for k, v in pairs.items())
    return F.expr(f"map({items})" if items else "CAST(map() AS map<string,string>)")


def list_map(pairs: Mapping[str, Iterable[str]]) -> Column:
    items = ", ".join(
        f"{sql_text(k)}, array({', '.join(map(sql_text, v))})" for k, v in pairs.items()
    )
    return F.expr(f"map({items})")


def join_splittable(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """A left join on `key` for which both sides are dealt out anew.

    Adaptive execution splits a hot key only between two exchanges made for the
    join. A side that is already dealt out by the key, such as the outcome of
    another join or an aggregate, has none; the key's hash as a second key asks
    for one. A NULL key finds nothing.
    """
    mark = "_key_hash"
    return left.withColumn(mark, F.xxhash64(key)).join(
        right.withColumn(mark, F.xxhash64(key)), [key, mark], "left"
    ).drop(mark)
