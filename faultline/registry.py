"""The named queries over the test tables, and their SQL where it exists."""

from __future__ import annotations

from faultline.plans import decisions, features, origins, records, tracks

QUERIES: dict = features.Q.queries | decisions.Q.queries | tracks.Q.queries | records.Q.queries | origins.Q.queries
ORACLES: dict[str, str] = features.Q.oracles | decisions.Q.oracles | tracks.Q.oracles | records.Q.oracles | origins.Q.oracles
