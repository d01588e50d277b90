"""Errors with a machine-readable code, and suggestions for misspelt names."""

from __future__ import annotations

from collections.abc import Iterable


class DtError(ValueError):
    """``code`` names the kind of error; further facts are in ``data``."""

    def __init__(self, code: str, message: str, **data):
        super().__init__(f"{code}: {message}")
        self.code, self.data = code, data


def edit_distance(a: str, b: str) -> int:
    """Damerau-Levenshtein distance (neighbours swapped count once)."""
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            cost = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, before[j - 2] + 1)
            row.append(cost)
        before, last = last, row
    return last[-1]


def closest(name: str, known: Iterable[str], most: int, count: int = 1) -> list[str]:
    near = sorted((d, k) for k in known if (d := edit_distance(name, k)) <= most)
    return [k for _, k in near[:count]]


def unknown_columns(names: Iterable[str], columns: list[str], where: str) -> None:
    """Raise for the first set of names that are not columns, with the closest one for each."""
    missing = [n for n in dict.fromkeys(names) if n not in columns]
    if missing:
        hints = {n: c[0] for n in missing if (c := closest(n, columns, 3))}
        said = "; ".join(f"{n} (did you mean {hints[n]}?)" if n in hints else n for n in missing)
        raise DtError("unknown-column", f"{where} refers to {said}", columns=missing, available=list(columns), suggestions=hints)
