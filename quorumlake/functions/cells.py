"""Source text to typed cells: a value and a state for each column, as expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quorumlake.model import PRESENT, UNKNOWN

#: How each datatype is written.
INTEGER = r"^[+-]?\d+(\.0*)?([eE]\+?\d+)?$"
NUMBER = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
DATE = r"^\d{4}-\d{2}-\d{2}$"
DATETIME = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?$"
TRUE_WORDS, FALSE_WORDS = ("true", "yes", "t", "y", "1"), ("false", "no", "f", "n", "0")
MAX_EXACT = 2**53 - 1


def parsed(text: Column, datatype: str, delimiter: str = ";") -> Column:
    """The value of trimmed text, or null where it isn't one of the datatype."""
    t = F.trim(text)
    if datatype == "integer":
        plain = F.when(t.rlike(r"^[+-]?\d+$"), t.try_cast("bigint"))
        wide = t.try_cast("decimal(38,6)")
        whole = F.when(t.rlike(INTEGER) & (wide == F.floor(wide)) & (F.abs(wide) <= MAX_EXACT), wide.try_cast("bigint"))
        return F.coalesce(plain, whole)
    if datatype in ("number", "time_offset"):
        v = F.when(t.rlike(NUMBER), t.try_cast("double"))
        return F.when(F.abs(v) < float("inf"), v + F.lit(0.0))
    if datatype == "boolean":
        low = F.lower(t)
        return F.when(low.isin(*TRUE_WORDS), True).when(low.isin(*FALSE_WORDS), False)
    if datatype == "date":
        return F.when(t.rlike(DATE), t.try_cast("date"))
    if datatype == "datetime":
        return F.when(t.rlike(DATETIME), t.try_cast("timestamp"))
    if datatype == "list<category>":
        json_items = F.from_json(t, "array<string>")
        split = F.transform(F.split(t, F.lit(f"\\Q{delimiter}\\E")), lambda x: F.trim(x))
        return F.when(t.startswith("["), json_items).otherwise(split)
    return text


def typed_column(frame: DataFrame, name: str, datatype: str, missing: Mapping[str, str] | None = None, delimiter: str = ";") -> DataFrame:
    """The frame with a text column typed and its state beside it; missing codes are matched before parsing."""
    text = F.col(name)
    state = F.when(text.isNull() | (F.trim(text) == ""), UNKNOWN)
    for code, named in (missing or {}).items():
        state = state.when(text == code, named)
    value = parsed(text, datatype, delimiter)
    state = state.when(value.isNull(), UNKNOWN).otherwise(PRESENT)
    frame = frame.withColumns({"_value": value, "_state": state})
    return frame.withColumns({name: F.when(F.col("_state") == PRESENT, F.col("_value")), f"{name}__state": F.col("_state")}).drop("_value", "_state")
