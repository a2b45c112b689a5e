"""Every query by name, with the SQL that tells its result."""

from __future__ import annotations

from storyloom.plans import articles, ingest, runs, scoring, selection

QUERIES: dict = {**ingest.Q, **scoring.Q, **selection.Q, **articles.Q, **runs.Q}
ORACLES: dict[str, str] = {**ingest.SQL, **scoring.SQL, **selection.SQL, **articles.SQL, **runs.SQL}
