"""Column expressions that several operators share."""

from __future__ import annotations

import string

from pyspark.sql import Column
from pyspark.sql import functions as F


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z; other letters, which lower() would change too, stay."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
