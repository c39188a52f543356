"""Epoch seconds to text. Nothing here depends on the session time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from cmdlog_spark.schema import DAY_SECONDS, MAX_EPOCH, MIN_EPOCH


def floor_div(value: Column, by: int) -> Column:
    """Whole-number division that rounds down below zero as well."""
    toward_zero = F.call_function("div", value, F.lit(by))
    return toward_zero - F.when(value % by < 0, 1).otherwise(0)


def day_of(epoch: Column) -> Column:
    """UTC day used for partitioning.

    Epochs outside years 0-9999 fall on the first or last day. The mapping
    never decreases, so ``day >= day_of(n)`` holds for every row with
    ``epoch >= n`` and can prune partitions.
    """
    inside = F.least(F.greatest(epoch, F.lit(MIN_EPOCH)), F.lit(MAX_EPOCH))
    days = floor_div(inside, DAY_SECONDS).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def local_timestamp(epoch: Column, tz: str = "UTC") -> Column:
    """Wall clock of ``tz`` as TIMESTAMP_NTZ; null outside years 0-9999."""
    zero = F.lit(0)
    utc = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(
        floor_div(epoch, DAY_SECONDS).cast("int"),
        zero,
        zero,
        F.pmod(epoch, F.lit(DAY_SECONDS)).cast("decimal(18,6)"),
    )
    local = utc if tz == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(tz), utc)
    return F.when(epoch.between(MIN_EPOCH, MAX_EPOCH), local)


def local_datetime(epoch: Column, tz: str = "UTC") -> Column:
    """``YYYY-MM-DD HH:MM:SS`` in ``tz``."""
    return local_timestamp(epoch, tz).cast("string")


def local_date(epoch: Column, tz: str = "UTC") -> Column:
    """``YYYY-MM-DD`` in ``tz``."""
    return local_timestamp(epoch, tz).cast("date").cast("string")


def relative_time(epoch: Column, now: int) -> Column:
    """Age in the largest fitting unit; the UTC date beyond a week."""
    # Null for an epoch so far back that the difference does not fit.
    age = F.try_subtract(F.lit(now).cast("bigint"), epoch)

    def unit(seconds: int, suffix: str) -> Column:
        return F.concat(floor_div(age, seconds).cast("string"), F.lit(suffix))

    return (
        F.when(age < 0, "in the future")
        .when(age < 60, unit(1, "s ago"))
        .when(age < 3_600, unit(60, "m ago"))
        .when(age < DAY_SECONDS, unit(3_600, "h ago"))
        .when(age < 7 * DAY_SECONDS, unit(DAY_SECONDS, "d ago"))
        .otherwise(F.coalesce(local_date(epoch), epoch.cast("string")))
    )
