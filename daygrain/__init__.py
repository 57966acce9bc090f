"""daygrain: weighted time-use survey and time-diary analytics on PySpark DataFrames."""

from daygrain.api import (
    apply_weights,
    get_SE,
    get_min_per_part,
    get_minutes,
    get_participation,
)
from daygrain.survey import Survey

__all__ = [
    "Survey",
    "apply_weights",
    "get_SE",
    "get_min_per_part",
    "get_minutes",
    "get_participation",
]
