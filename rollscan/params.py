"""Job parameters: one frozen dataclass handed to every operator.

Nothing is read from environment variables or globals inside executors;
a job builds one ``SearchParams`` on the driver and passes it down.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

from rollscan.functions.text import GUARDIAN_LABELS, NAME_LABEL


# Fixed values that must equal the reference defaults.
DEFAULT_THRESHOLD = 82
MAX_PDF_SIZE_MB = 50
MAX_PDF_PAGES = 100
MAX_NAMES_FILE_SIZE_MB = 10
MAX_SEARCH_NAMES = 1000
DEFAULT_MIN_CONFIDENCE = 60.0
WORD_MATCH_THRESHOLD = 70
LEDGER_TTL_DAYS = 30
LEDGER_VERSION = "1.0"

# Parameters that change result rows: a ledger entry is valid for one setting of all of them.
RESULT_PARAMS = (
    "threshold", "box_level", "min_confidence", "max_pdf_size_mb", "max_pdf_pages",
    "word_match_threshold", "layout", "strict_labels", "all_records", "name_label", "guardian_labels",
)


@dataclass(frozen=True)
class SearchParams:
    threshold: int = DEFAULT_THRESHOLD
    box_level: bool = False
    min_confidence: float = DEFAULT_MIN_CONFIDENCE
    max_pdf_size_mb: float = MAX_PDF_SIZE_MB
    # None: no cap.  A cap is reported for every file that it truncates.
    max_pdf_pages: int | None = None
    max_names_file_size_mb: float = MAX_NAMES_FILE_SIZE_MB
    max_search_names: int | None = None
    word_match_threshold: int = WORD_MATCH_THRESHOLD
    ttl_days: int = LEDGER_TTL_DAYS
    ledger_version: str = LEDGER_VERSION
    # "flat": box-mode page text is all words joined by one space (reference
    # behaviour, one block per page); "lines": words are regrouped into lines
    # and blocks from the OCR block/line numbers.
    layout: str = "flat"
    # Extraction options (defaults keep reference behaviour).
    strict_labels: bool = False
    all_records: bool = False
    # Label words of a record's name and guardian fields.
    name_label: str = NAME_LABEL
    guardian_labels: tuple[str, ...] = GUARDIAN_LABELS
    # Fuzzy-join strategy: "auto", "broadcast" or "shuffle".
    strategy: str = "auto"
    # Largest query side (rows) that the broadcast strategy accepts.
    broadcast_max_queries: int = 100_000
    # Largest query side (total characters) that the broadcast strategy accepts.
    broadcast_max_chars: int = 8 * 1024 * 1024
    # Largest estimated size of the broadcast query keys (queries exploded by
    # the name lengths that can reach the threshold).
    broadcast_max_bytes: int = 64 * 1024 * 1024
    # Write extracted records once to the checkpoint folder: the join reads them
    # twice (distinct names, join back), which is cheaper than scanning and
    # regex-matching big page inputs twice.  None = decide by Catalyst's size
    # estimate of the page input against ``materialize_min_bytes``.
    materialize_records: bool | None = None
    materialize_min_bytes: int = 256 * 1024 * 1024

    def __post_init__(self) -> None:
        if not 0 <= int(self.threshold) <= 100:
            raise ValueError(f"threshold must be within 0..100, got {self.threshold}")
        if not 0 <= float(self.min_confidence) <= 100:
            raise ValueError(f"min_confidence must be within 0..100, got {self.min_confidence}")
        if not 0 <= int(self.word_match_threshold) <= 100:
            raise ValueError("word_match_threshold must be within 0..100")
        if self.layout not in ("flat", "lines"):
            raise ValueError(f"layout must be 'flat' or 'lines', got {self.layout!r}")
        if self.strategy not in ("auto", "broadcast", "shuffle"):
            raise ValueError(f"strategy must be auto, broadcast or shuffle, got {self.strategy!r}")
        if not self.name_label or not self.guardian_labels or not all(self.guardian_labels):
            raise ValueError("labels must not be empty")
        for name in ("max_pdf_size_mb", "max_pdf_pages", "max_search_names", "ttl_days"):
            if getattr(self, name) is not None and float(getattr(self, name)) < 0:
                raise ValueError(f"{name} must not be negative")

    def settings(self) -> str:
        """Digest of every parameter that changes result rows (16 hex digits)."""

        def text(v) -> str:
            if isinstance(v, (tuple, list)):
                return ",".join(v)
            return str(v).lower() if v is None or isinstance(v, bool) else f"{v:g}" if isinstance(v, (int, float)) else str(v)

        named = "|".join(f"{k}={text(getattr(self, k))}" for k in RESULT_PARAMS)
        return hashlib.sha256(named.encode()).hexdigest()[:16]

    def with_(self, **changes) -> "SearchParams":
        return replace(self, **changes)
