"""Sources: file readers with declared schemas (S1, S2) and the retail views over the test tables."""

from tillwise.sources.files import read_rfm, read_transactions, write_rfm_csv
from tillwise.sources.testdata import (
    clock_lines, dirty_lines, event_lines, coarse_lines, raw_lines, retail_lines, table,
)

__all__ = [
    "read_transactions", "read_rfm", "write_rfm_csv",
    "table", "retail_lines", "raw_lines", "dirty_lines", "coarse_lines", "clock_lines", "event_lines",
]
