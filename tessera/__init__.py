"""Tessera: container, sample and sequence analytics as Spark relations."""
