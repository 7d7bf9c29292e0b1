"""All registered queries of the engine's own operators, with DuckDB SQL."""

from __future__ import annotations

from freshet.workload import nexmark, relational, scalars, timeseries
from freshet.workload.base import Query

MODULES = [relational, scalars, timeseries, nexmark]


def queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.R.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.R.oracles.items()}
