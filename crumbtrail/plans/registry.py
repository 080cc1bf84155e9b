"""All queries of the core and their SQL."""

from __future__ import annotations

from crumbtrail.plans import heavy, mining

QUERIES = {**mining.QUERIES, **heavy.QUERIES}
SQL = {**mining.SQL, **heavy.SQL}
