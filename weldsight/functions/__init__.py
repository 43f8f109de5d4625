"""Column helpers that users call by name."""

from weldsight.operators.evaluate import ttf_bucket
from weldsight.sources.files import parse_switch, parse_time

__all__ = ["parse_switch", "parse_time", "ttf_bucket"]
