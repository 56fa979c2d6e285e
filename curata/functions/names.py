"""Spelling of names, and the way of a column's name through the cleaning steps."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


def spell(text: str, symbols_part: bool = False) -> str:
    """Lower-case name made of letters, digits and ``_``.

    Blanks and dashes part words: each run of them becomes one ``_``. Other
    symbols vanish, or part words too with ``symbols_part``, and then no ``_``
    is left at either end.
    """
    out: list[str] = []
    in_gap = False
    for ch in str(text).strip().lower():
        if ch == "_" or ch.isalnum():
            out.append(ch)
            in_gap = False
        elif symbols_part or ch == "-" or ch.isspace():
            if not in_gap:
                out.append("_")
            in_gap = True
        else:
            in_gap = False
    name = "".join(out)
    return name.strip("_") if symbols_part else name


def make_unique(names: Sequence[str]) -> list[str]:
    """Give repeated names ``_2``, ``_3`` ... suffixes.

    Spark resolves names case-insensitively by default, so uniqueness is
    checked without case, and a generated name is checked against every name
    in the list, so ``a, a, a_2`` gives ``a, a_3, a_2`` rather than two
    ``a_2``. An empty name becomes ``_``.
    """
    taken = {n.lower() for n in names if n}
    used: set[str] = set()
    counters: dict[str, int] = {}
    result: list[str] = []
    for raw in names:
        name = raw or "_"
        if name.lower() not in used:
            used.add(name.lower())
            result.append(name)
            continue
        k = counters.get(name.lower(), 1)
        while True:
            k += 1
            cand = f"{name}_{k}"
            if cand.lower() not in used and cand.lower() not in taken:
                break
        counters[name.lower()] = k
        used.add(cand.lower())
        result.append(cand)
    return result


def standardize_names(columns: Iterable[str]) -> list[str]:
    return make_unique([spell(c) for c in columns])


class ColumnTrail:
    """Where each column of the loaded table is now: it follows renames and
    drops, and finds the columns that a user names, by either name."""

    def __init__(self, columns: Iterable[str]):
        self.now = {c: c for c in columns}

    def rename(self, new_names: Sequence[str]) -> None:
        self.now = dict(zip(self.now, new_names, strict=True))

    def keep(self, columns: Iterable[str]) -> None:
        left = set(columns)
        self.now = {old: new for old, new in self.now.items() if new in left}

    def find(self, wanted: Iterable[str] | None, columns: Sequence[str]) -> list[str]:
        """Columns of a table that are wanted, each once, in the order asked
        for. A name that is a column means that column, else the column that
        was loaded under it; names of neither kind are passed over."""
        there = dict.fromkeys(columns)
        asked = [w if w in there else self.now.get(w) for w in map(str, wanted or ())]
        return list(dict.fromkeys(c for c in asked if c in there))
