"""Row identity and lenient integer cells."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_hash() -> Column:
    """SHA-256 over the fields of one event, one field per line.

    A missing number is an empty line and a missing text a NUL, so that every field has
    its line: ``concat_ws`` on its own would leave the line out, and rows that miss
    different numbers would look alike.
    """
    numbers = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("epoch", "ppid", "salt", "hist_id")]
    texts = [F.coalesce(F.col(c), F.lit("\0")) for c in ("pwd", "cmd")]
    return F.sha2(F.concat_ws("\n", *numbers, *texts), 256)


# The first and the second word of a text, when an integer with optional stars.
FIRST_INTEGER = r"(?U)^\s*([+-]?[0-9]+)\**(?:\s|\z)"
SECOND_INTEGER = r"(?U)^\s*\S+\s+([+-]?[0-9]+)\**(?:\s|\z)"


def coerce_int(text: Column, kind: Column) -> Column:
    """Integer held by a cell of storage class ``kind``, or null.

    Text takes the first of its first two words that is an integer once
    trailing stars are gone. Reals count when whole; ``floor`` stops them at
    the limits of 64 bits.
    """
    real = text.try_cast("double")
    words = [F.regexp_extract(text, p, 1) for p in (FIRST_INTEGER, SECOND_INTEGER)]
    return (
        F.when(kind == "integer", text.try_cast("bigint"))
        .when(kind == "text", F.coalesce(*[w.try_cast("bigint") for w in words]))
        .when((kind == "real") & (real % 1 == 0), F.floor(real))
    )
