"""Least fixed points of recursive views, by semi-naive rounds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from freshet.shared import dropped, saved

Rules = dict[str, Callable[[dict[str, DataFrame], dict[str, DataFrame]], DataFrame]]


def fixed_point(base: dict[str, DataFrame], rules: Rules, max_rounds: int = 1000) -> dict[str, DataFrame]:
    """The least fixed point of mutually recursive views.

    ``base``: each view's rows that need no recursion. ``rules``: for each view a function of (all rows so far, new rows of the last
    round), both by view name, to candidate rows; a linear rule needs only the new ones. Views are sets, so a round that adds nothing ends it.

    A round writes only what it adds; a view is the union of its rounds. So that the list of rounds stays short, a round that
    has grown to the size of an earlier one is merged with it.
    """
    rounds = {name: [_counted(saved(df.distinct(), "round"))] for name, df in base.items()}
    fresh = {name: parts[0][1] for name, parts in rounds.items()}
    for _ in range(max_rounds):
        total = {name: _union([df for _, df in parts]) for name, parts in rounds.items()}
        added = {}
        for name, rule in rules.items():
            cols = total[name].columns
            found = rule(total, fresh).toDF(*cols).distinct()
            added[name] = _counted(saved(_minus(found, total[name]), "round"))
        if not any(n for n, _ in added.values()):
            return total
        fresh = {name: added[name][1] if name in added else df.limit(0) for name, df in total.items()}
        for name, part in added.items():
            if part[0]:
                rounds[name].append(part)
                _merge(rounds[name])
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")


def _counted(df: DataFrame) -> tuple[int, DataFrame]:
    return df.count(), df


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _merge(parts: list[tuple[int, DataFrame]], most: int = 16) -> None:
    """Beyond ``most`` rounds the smaller half becomes one, so each row is rewritten a logarithmic number of times; the newest stays a table of its own."""
    if len(parts) > most:
        order = sorted(range(len(parts) - 1), key=lambda i: parts[i][0])
        small = order[: most // 2]
        one = _counted(saved(_union([parts[i][1] for i in small]), "round"))
        for i in small:
            dropped(parts[i][1])
        parts[:] = [p for i, p in enumerate(parts) if i not in small]
        parts.insert(0, one)


def _minus(found: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``found`` that ``known`` lacks; nulls are equal."""
    cols = found.columns
    cond = None
    for c in cols:
        same = found[c].eqNullSafe(known[c])
        cond = same if cond is None else cond & same
    return found.join(known, cond, "left_anti")


def transitive_closure(edges: DataFrame) -> DataFrame:
    """All pairs (src, dst) joined by a path; ``edges``: (src, dst)."""
    def rule(total: dict[str, DataFrame], fresh: dict[str, DataFrame]) -> DataFrame:
        a = fresh["reach"].toDF("src", "mid")
        return a.join(edges.toDF("mid", "dst"), "mid").select("src", "dst")

    return fixed_point({"reach": edges.select("src", "dst")}, {"reach": rule})["reach"]
