"""Instants without a session's time zone, and local times."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND = 1_000_000
#: Seconds beyond this (the year 2100) are taken for another unit.
IMPLAUSIBLE_SECONDS = 4_102_444_800


def micros(ntz: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp that states UTC."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ntz)


def epoch_seconds(value: Column) -> Column:
    """Whole seconds as microseconds; a magnitude that only another unit explains is null."""
    return F.when(F.abs(value) < IMPLAUSIBLE_SECONDS, value.cast("long") * SECOND)


def utc_text(value: Column) -> Column:
    """ISO text to an instant; a text that states no offset is refused (null)."""
    return F.when(value.rlike(r"^\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[+-]\d\d:?\d\d)$"), F.try_to_timestamp(value))


def _sides(local: Column, zone: str) -> tuple[Column, Column, Column, Column, Column]:
    """(earlier reading, later one, whether each fits, whether the zone's offset changes near) of a zone-less local timestamp, in microseconds."""
    micro = micros(local)

    def offset(at: Column) -> Column:
        """Offset of the zone, in microseconds, at an instant."""
        instant = F.timestamp_micros(at)
        return micros(F.convert_timezone(F.lit("UTC"), F.lit(zone), F.timestamp_micros(at).cast("timestamp_ntz"))) - micros(instant.cast("timestamp_ntz"))

    day = 86_400 * SECOND
    before, after = offset(micro - day), offset(micro + day)
    early, late = micro - before, micro - after
    return early, late, offset(early) == before, offset(late) == after, before != after


def local_kind(local: Column, zone: str) -> Column:
    """unique, ambiguous (it occurs twice) or nonexistent (it was skipped) for a zone-less local timestamp."""
    _, _, a, b, changes = _sides(local, zone)
    return F.when(~changes, "unique").when(a & b, "ambiguous").when(a | b, "unique").otherwise("nonexistent")


def local_instant(local: Column, zone: str, fold: int = 0) -> Column:
    """The instant, in microseconds, of a zone-less local timestamp: of an ambiguous one the first (fold 0) or the second (fold 1) reading; one that was skipped
    is null, for no offset makes it an instant."""
    early, late, a, b, changes = _sides(local, zone)
    both = F.least(early, late) if fold == 0 else F.greatest(early, late)
    return F.when(~changes, early).when(a & b, both).when(a, early).when(b, late)


def minute_bucket(ntz: Column, minutes: int) -> Column:
    return F.floor((F.hour(ntz) * 60 + F.minute(ntz)) / minutes).cast("long")


def availability(received: Column, uncertainty_seconds: Column) -> Column:
    """struct(lower, upper) in microseconds; unknown stays unknown. A record is certainly there from the upper end on."""
    return F.struct((received - uncertainty_seconds.cast("long") * SECOND).alias("lower"), received.alias("upper"))
