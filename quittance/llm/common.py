"""Words of texts; the shared folder, stored tables and connected components are those of the library."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quittance.operators.graph import connected_components  # noqa: F401
from quittance.sources.stored import new_path, remove, shared_dir, stored  # noqa: F401

#: ASCII white space, which parts words.
SPACE = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; lower() alone would also change other letters."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    )


def spaced_words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
