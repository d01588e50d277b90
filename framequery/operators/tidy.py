"""Looking over a table and cleaning it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from framequery.errors import unknown_columns
from framequery.functions import numbers as N
from framequery.lower import RID, quoted


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row a column: column, datatype, n, n-missing, mean, sd, min, p25, median, p75, max. One pass over the table;
    statistics are null for what isn't a number. NaN counts as missing."""
    names = [c for c in df.columns if c != RID] if columns is None else list(columns)
    unknown_columns(names, df.columns, "describe")
    one = []
    for i, c in enumerate(names):
        kind = df.schema[c].dataType
        x = N.no_nan(quoted(c)) if isinstance(kind, N.FLOATING) else quoted(c)
        d = x.cast("double") if isinstance(kind, N.NUMERIC) else F.lit(None).cast("double")
        q = F.percentile(N.finite(d), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        stats = [F.count(x).alias("n"), F.count_if(x.isNull()).alias("n-missing"), F.avg(d).alias("mean"), F.stddev_samp(d).alias("sd"), F.min(d).alias("min"), F.get(q, F.lit(0)).alias("p25"), F.get(q, F.lit(1)).alias("median"), F.get(q, F.lit(2)).alias("p75"), F.max(d).alias("max")]
        one.append(F.struct(F.lit(c).alias("column"), F.lit(kind.simpleString()).alias("datatype"), *stats).alias(f"c{i}"))
    return df.agg(*one).select(F.inline(F.array(*[f"c{i}" for i in range(len(names))])))


def clean_name(name: str) -> str:
    """Lower case; each run of what is neither letter nor number becomes a hyphen, none at the ends."""
    return re.sub(r"[\W_]+", "-", name.lower()).strip("-")


def clean_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*[c if c == RID else clean_name(c) for c in df.columns])


def mark_duplicates(df: DataFrame, columns: list[str] | None = None, name: str = "duplicate?") -> DataFrame:
    """A flag for every row whose values (in these columns) occur more than once; missing equals missing."""
    keys = [c for c in df.columns if c != RID] if columns is None else list(columns)
    unknown_columns(keys, df.columns, "mark_duplicates")
    return df.withColumn(name, F.count(F.lit(1)).over(W.partitionBy(*map(quoted, keys))) > 1)


def duplicate_rows(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """All members of the groups of equal rows, in the order of the input."""
    own = df.columns
    rows = df if RID in own else df.withColumn(RID, F.monotonically_increasing_id())
    out = mark_duplicates(rows, columns, "__twice").filter("__twice").orderBy(RID)
    return out.select(*map(quoted, own))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without the columns that have one value only (an action: one pass, no distinct count). Tables of fewer than two rows stay."""
    names = [c for c in df.columns if c != RID]
    if not names:
        return df
    facts = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(names):
        x = quoted(c)
        v = x if not isinstance(df.schema[c].dataType, (T.MapType, T.VariantType)) else F.to_json(x)
        facts += [(F.count(v) > 0).alias(f"some{i}"), (F.count(v) < F.count(F.lit(1))).alias(f"gaps{i}"), (~F.min(v).eqNullSafe(F.max(v))).alias(f"vary{i}")]
    r = df.agg(*facts).first()
    if r["n"] < 2:
        return df
    constant = [c for i, c in enumerate(names) if not r[f"vary{i}"] and not (r[f"some{i}"] and r[f"gaps{i}"])]
    return df.drop(*constant)


def coerce_columns(df: DataFrame, types: dict[str, str], strict: bool = False) -> DataFrame:
    """Columns cast to the types; what can't be cast is missing, or raises if ``strict``."""
    unknown_columns(types, df.columns, "coerce_columns")
    return df.withColumns({c: quoted(c).cast(t) if strict else quoted(c).try_cast(t) for c, t in types.items()})


