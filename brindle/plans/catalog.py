"""All registered relational queries and their DuckDB SQL."""

from __future__ import annotations

from ..functions import scalar
from ..operators import aggregates, intervals, layouts, ordered, patterns, recursive, relational, sketches, skew, temporal, windows
from ..streaming import state
from ..streaming import windows as streams

_PARTS = (relational, aggregates, windows, temporal, ordered, intervals, skew, sketches, recursive, layouts, patterns, scalar, streams, state)
QUERIES = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
