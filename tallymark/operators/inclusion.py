"""Which columns hold only values of which other columns: foreign keys found on data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType

_WORD = 62


def family(kind: DataType) -> str | None:
    """Columns are compared within a family; other types (fractions, booleans, nested) are left out."""
    if isinstance(kind, IntegralType) or (isinstance(kind, DecimalType) and kind.scale == 0):
        return "number"
    if isinstance(kind, StringType):
        return "text"
    return "time" if isinstance(kind, (DateType, TimestampType, TimestampNTZType)) else None


def _written(column: Column, kind: DataType) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS") if family(kind) == "time" else column.cast("string")


def inclusion_dependencies(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``child, child_column, parent, parent_column, n_values, parent_is_key``: every pair where each non-null child value is a parent value.

    Every table is read once into (value, column) rows, which are counted per value and column; each value then becomes one bit set
    of the columns it stands in. The bit sets that hold a column are intersected for that column, so candidates die early and no
    two columns are ever joined. Equal bit sets are folded first: their number follows the columns, not the rows. Nulls are not
    values; a column without values depends on nothing. ``parent_is_key`` says that the parent's values are unique and never null.
    """
    listed = [
        (table, field.name, field.dataType) for table, df in tables.items() for field in df.schema.fields
        if family(field.dataType) and (columns is None or field.name in columns.get(table, ()))
    ]
    place = {(table, column): k for k, (table, column, _) in enumerate(listed)}
    parts = []
    for table, df in tables.items():
        own = [(column, kind) for owner, column, kind in listed if owner == table]
        if own:
            cells = [
                F.struct(F.lit(place[table, c]).alias("id"), F.lit(family(kind)).alias("family"), _written(F.col(f"`{c}`"), kind).alias("value")) for c, kind in own
            ]
            parts.append(df.select(F.explode(F.array(*cells)).alias("cell")).select("cell.*"))
    if not parts:
        raise ValueError("no column of a comparable type")
    cells = reduce(DataFrame.union, parts).groupBy("family", "value", "id").agg(F.count("*").alias("n"))
    words = range(-(-len(listed) // _WORD))

    def bit(word: int) -> Column:
        return F.when(F.floor(F.col("id") / _WORD) == word, F.expr(f"shiftleft(1L, pmod(id, {_WORD}))")).otherwise(F.lit(0).cast("bigint"))

    # Nulls of a column and repeated values both say that it is no key.
    sets = cells.groupBy("family", "value").agg(
        *[F.bit_or(bit(w)).alias(f"in_{w}") for w in words], *[F.bit_or(F.when(F.col("n") > 1, bit(w)).otherwise(F.lit(0).cast("bigint"))).alias(f"twice_{w}") for w in words]
    )
    there = F.col("value").isNotNull()
    folded = sets.groupBy(there.alias("there"), *[f"in_{w}" for w in words]).agg(
        F.count("*").alias("n"), *[F.bit_or(f"twice_{w}").alias(f"twice_{w}") for w in words]
    )
    numbers = [F.when(F.expr(f"shiftright(in_{k // _WORD}, {k % _WORD}) & 1") == 1, F.lit(k)) for k in range(len(listed))]
    each = folded.withColumn("id", F.explode(F.filter(F.array(*numbers), lambda x: x.isNotNull())))
    own_twice = reduce(lambda a, b: a | b, [(F.floor(F.col("id") / _WORD) == w) & (F.expr(f"shiftright(twice_{w}, pmod(id, {_WORD})) & 1") == 1) for w in words])
    per_column = each.groupBy("id").agg(
        *[F.bit_and(F.when(F.col("there"), F.col(f"in_{w}"))).alias(f"all_{w}") for w in words],
        F.sum(F.when(F.col("there"), F.col("n")).otherwise(0)).alias("n_values"),
        (~F.bool_or(own_twice | ~F.col("there"))).alias("is_key"),
    )
    spark = cells.sparkSession
    names = spark.createDataFrame([(k, t, c) for k, (t, c, _) in enumerate(listed)], "id int, table string, column string")
    parents = [F.when(F.expr(f"shiftright(all_{k // _WORD}, {k % _WORD}) & 1") == 1, F.lit(k)) for k in range(len(listed))]
    pairs = per_column.where("n_values > 0").select("id", "n_values", F.explode(F.filter(F.array(*parents), lambda x: x.isNotNull())).alias("parent_id")).where("id <> parent_id")
    keys = per_column.select(F.col("id").alias("parent_id"), F.col("is_key").alias("parent_is_key"))
    child = names.select("id", F.col("table").alias("child"), F.col("column").alias("child_column"))
    parent = names.select(F.col("id").alias("parent_id"), F.col("table").alias("parent"), F.col("column").alias("parent_column"))
    found = pairs.join(keys, "parent_id").join(child, "id").join(parent, "parent_id")
    return found.select("child", "child_column", "parent", "parent_column", "n_values", "parent_is_key")


def confirm_fks(candidates: DataFrame, inclusions: DataFrame) -> DataFrame:
    """Guessed keys (``infer_fks``) with ``holds``: whether the data agree, that is, the column's values are all unique values of the target."""
    proven = inclusions.where("parent_is_key").select(
        F.lower("child").alias("c"), F.lower("child_column").alias("cc"), F.lower("parent").alias("p"), F.lower("parent_column").alias("pc"), F.lit(True).alias("holds")
    )
    same = (F.lower("model_name") == F.col("c")) & (F.lower("column_name") == F.col("cc")) & (F.lower("to_table") == F.col("p")) & (F.lower("to_column") == F.col("pc"))
    return candidates.join(proven, same, "left").select(*candidates.columns, F.coalesce("holds", F.lit(False)).alias("holds"))
