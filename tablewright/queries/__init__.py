"""Registered queries by operator family."""

from tablewright.queries import audits, cleaning, flagship, learning, profiles, properties, repair, search, streams, synthetic, tables  # noqa: F401
from tablewright.queries.registry import ORACLES, QUERIES  # noqa: F401
