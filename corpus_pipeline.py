"""Corpus pipeline: quality rules, near-dedup, secret scans, source mixing, packing.

The stages, what each does with nulls, ties and repeated rows, and ``run`` are
in ``rollscan.llm.pipeline``; this module is where jobs find them.
"""

from rollscan.llm.pipeline import COLUMNS, ORACLE_SQL, STAGES, mixing, near_dedup, packing, quality, run, secrets

__all__ = ["COLUMNS", "ORACLE_SQL", "STAGES", "mixing", "near_dedup", "packing", "quality", "run", "secrets"]
