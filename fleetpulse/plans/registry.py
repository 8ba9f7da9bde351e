"""All registered queries by name."""

from __future__ import annotations

from fleetpulse.plans import alerts, changes, delivery, fleet, intake, rollups, streams
from fleetpulse.plans.common import Entry

AREAS = [rollups, fleet, intake, alerts, delivery, changes, streams]


def entries() -> dict[str, Entry]:
    return {name: entry for area in AREAS for name, entry in area.QUERIES.items()}
