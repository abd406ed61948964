"""All registered queries and their SQL."""

from __future__ import annotations

from . import analysis, extra, more, series, wider

QUERIES = {**series.QUERIES, **analysis.QUERIES, **more.QUERIES, **extra.QUERIES, **wider.QUERIES}
SQL = {**series.SQL, **analysis.SQL, **more.SQL, **extra.SQL, **wider.SQL}
