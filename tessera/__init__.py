"""Tessera: attributable-evidence analytics expressed as Spark DataFrame jobs."""
