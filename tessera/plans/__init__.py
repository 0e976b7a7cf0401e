"""Registered queries of the engine and their SQL; importing this package's modules fills both."""

from tessera.plans import container, frames, queries  # noqa: F401
from tessera.plans.queries import ORACLE_SQL, QUERIES  # noqa: F401
