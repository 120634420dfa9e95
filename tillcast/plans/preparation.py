"""From raw transactions to typed and encoded ones, and to a series."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame

from tillcast.operators.calendar import require_plain_calendar
from tillcast.operators.cleaning import clean_transactions
from tillcast.operators.encoding import encode_categories
from tillcast.operators.series import continuous_series


def clean_and_encode(
    raw: DataFrame, encoder: PipelineModel | None = None
) -> tuple[DataFrame, PipelineModel]:
    """Typed transactions with indexed and one-hot codes, and the encoder used."""
    return encode_categories(clean_transactions(raw), encoder=encoder)


def series_from_raw(raw: DataFrame, check_calendar: bool = False) -> DataFrame:
    """Raw transactions to a continuous series.

    Without vectors: a trained model brings its own encoder, and codes are
    cheaper to shuffle. With ``check_calendar`` months that should not set the calendar are an error.
    """
    cleaned = clean_transactions(raw)
    if check_calendar:
        require_plain_calendar(cleaned)
    return continuous_series(cleaned)
