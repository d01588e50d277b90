"""Handles for repeated look-ups and repeated as-of joins."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequery.errors import DtError, unknown_columns
from framequery.lower import RID, quoted

KINDS = ("hash", "asof")


@dataclass(frozen=True)
class Index:
    """``df`` is the source dealt by its exact keys (and, for as-of, sorted by time within), kept if ``persist``ed."""

    kind: str
    keys: tuple
    source: DataFrame
    df: DataFrame

    def unpersist(self) -> None:
        self.df.unpersist()


def index_by(df: DataFrame, keys: Any, kind: str = "hash", persist: bool = True) -> Index:
    """Shuffle once, look up often. The rows stay in memory, or on disk where that is short."""
    names = [keys] if isinstance(keys, str) else list(keys)
    if not names or any(not isinstance(k, str) for k in names):
        raise DtError("invalid-key-cols", f"{keys!r} is not a name or a list of names", keys=keys)
    unknown_columns(names, df.columns, "index_by")
    kind = str(kind).lstrip(":")
    if kind not in KINDS:
        raise DtError("invalid-index-kind", f"{kind} is not one of {', '.join(KINDS)}", kind=kind)
    rows = df if RID in df.columns else df.withColumn(RID, F.monotonically_increasing_id())
    exact = names if kind == "hash" else names[:-1]
    dealt = rows.repartition(*map(quoted, exact)) if exact else rows.repartitionByRange(quoted(names[-1]))
    dealt = dealt.sortWithinPartitions(*map(quoted, names), quoted(RID))
    return Index(kind, tuple(names), df, dealt.persist() if persist else dealt)


def asof_index(df: DataFrame, keys: Any, persist: bool = True) -> Index:
    return index_by(df, keys, "asof", persist)


def is_index(x: Any) -> bool:
    return isinstance(x, Index)


def asof_groups(index: Any) -> DataFrame:
    """The exact keys of an as-of index, each with its number of rows and its first and last time."""
    if not isinstance(index, Index):
        raise DtError("not-an-index", f"{type(index).__name__} is not an index")
    if index.kind != "asof":
        raise DtError("asof-index-wrong-kind", f"groups by time belong to an as-of index, not to {index.kind}", kind=index.kind)
    *exact, time = index.keys
    rows = index.df.filter(quoted(time).isNotNull())
    return rows.groupBy(*map(quoted, exact)).agg(F.count(F.lit(1)).alias("n"), F.min(quoted(time)).alias("first"), F.max(quoted(time)).alias("last"))


def row_exact_key(row: Any, keys: list[str]) -> tuple:
    """A row's values of all keys but the last."""
    return tuple(row[k] for k in keys[:-1])


def row_asof_val(row: Any, keys: list[str]) -> Any:
    """A row's value of the last key."""
    return row[keys[-1]]


def _found(index: Any, key: Any) -> DataFrame:
    if not isinstance(index, Index):
        raise DtError("not-an-index", f"{type(index).__name__} is not an index")
    if index.kind == "asof":
        raise DtError("asof-index-not-lookable", "an as-of index serves joins only")
    values = list(key) if isinstance(key, (list, tuple)) else [key]
    if len(values) != len(index.keys):
        raise DtError("invalid-lookup-key", f"the index has {len(index.keys)} keys, not {len(values)}", key=key, keys=list(index.keys))
    hit = F.lit(True)
    for k, v in zip(index.keys, values, strict=True):
        hit = hit & (quoted(k).isNull() if v is None else quoted(k) == F.lit(v))
    return index.df.filter(hit)


def lookup(index: Index, key: Any) -> DataFrame:
    """The rows of a key, in the order of the input; none if it is absent. Missing equals missing."""
    return _found(index, key).orderBy(RID).select(*map(quoted, index.source.columns))


def lookup_indices(index: Index, key: Any) -> DataFrame:
    """Their row ids."""
    return _found(index, key).select(quoted(RID).alias("row")).orderBy("row")
