"""Column names and business rules shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

MERCHANT = "anonymous_uu_id"
RAW_MONTH = "transaction_month"  # `yyyyMM`, as it comes in the file
MONTH_DT = "transaction_month_dt"  # the same month as a date, after cleaning
RAW_SALES = "sales_amount"
RAW_COUNT = "transaction_count"
MALFORMED = "malformed_line"  # the text of a line that is no proper row, if reported
SOURCE_FILE = "source_file"

MONTH = "transaction_month"  # first day of the month, in a continuous series
SALES = "sales_amount_actual"
OBSERVED = "has_transactions"  # false on months that were filled in

CODES = ("currency_code", "country_code")
INDEXED = tuple(f"{c}_indexed" for c in CODES)
ENCODED = tuple(f"{c}_encoded" for c in CODES)

PREDICTION = "prediction"
HORIZON_MONTHS = 6


@dataclass(frozen=True)
class AdvancePolicy:
    """Who gets an advance (as-of definition) and how large it is."""

    min_streak_months: int = 12
    min_average_sales: float = 5000.0
    min_recent_to_prior: float = 0.95
    holdback: float = 0.10
    fee: float = 0.15

    @property
    def advance_rate(self) -> float:
        """Share of the forecast sales that is advanced."""
        return self.holdback / (1 + self.fee)


@dataclass(frozen=True)
class WindowedPolicy:
    """Thresholds of the row-window definition of eligibility."""

    min_streak_months: int = 12
    min_average_sales: float = 5000.0
    min_trend: float = -0.05
