"""One-call tabular queries on Spark: filter, derive, group, window, join, reshape."""

from framequery.errors import DtError
from framequery.expr import agg, coalesce, col, cut, e, form, if_, op, row, stat, to_string, win
from framequery.operators.index import Index, asof_groups, asof_index, index_by, is_index, lookup, lookup_indices, row_asof_val, row_exact_key
from framequery.operators.joins import Report, asof_indices, asof_row_indices, asof_search, join, join_report, window_row_indices
from framequery.operators.query import NOT_NUMERICAL, NUMERICAL, asc, between, desc, dt, pass_nil, prepare_grouping, qtile, rename, reset_notes, row_numbered, typed, without, xbar
from framequery.operators.reshape import cast, melt
from framequery.operators.tidy import clean_column_names, coerce_columns, describe, drop_constant_columns, duplicate_rows, mark_duplicates
from framequery.sources.files import from_rows, read, read_pieces, read_seq, write

N = agg("N")

__all__ = [n for n in dir() if not n.startswith("_")]
