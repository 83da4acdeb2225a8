"""Scalar expressions of pings, trips and roads. Arguments are columns unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT

#: A decimal number as Python reads it; Java also takes suffixes such as 1d or 1f, so casts are guarded.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: The four levels of congestion, from free to severe. Fixed values.
LEVELS = ("畅通", "轻度拥挤", "拥挤", "严重拥挤")
#: Words that stand for true. Fixed values.
TRUE_WORDS = ("true", "1", "yes", "y", "t")
#: Road classes that cars use, by name. Fixed values.
DRIVABLE = (
    "living_street", "motorway", "motorway_link", "primary", "primary_link", "residential", "secondary", "secondary_link", "service",
    "tertiary", "tertiary_link", "trunk", "trunk_link", "unclassified",
)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = DEFAULT.earth_radius_m) -> Column:
    """Great-circle distance in metres."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * radius) * F.asin(F.sqrt(F.least(F.greatest(a, F.lit(0.0)), F.lit(1.0))))


def heading_delta(a: Column, b: Column) -> Column:
    """The smaller angle between two headings, 0 to 180."""
    return F.abs(F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0)


def speed_kmh(metres: Column, seconds: Column) -> Column:
    """Kilometres an hour to two digits; null unless seconds are positive."""
    return F.when(seconds > 0, F.round(metres / seconds * 3.6, 2))


def parse_number(text: Column) -> Column:
    """A number, or null where the text isn't one."""
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def hour_of_day(ts: Column, offset: int = DEFAULT.utc_offset_sec) -> Column:
    """Local hour of epoch seconds."""
    return F.floor(F.pmod(ts + offset, F.lit(86400)) / 3600).cast("int")


def peak_label(ts: Column, morning: tuple[int, int] = (7, 9), evening: tuple[int, int] = (17, 19)) -> Column:
    """morning_peak, evening_peak, off_peak, or invalid_time for null."""
    h = hour_of_day(ts)
    return (
        F.when(ts.isNull(), "invalid_time")
        .when((h >= morning[0]) & (h < morning[1]), "morning_peak")
        .when((h >= evening[0]) & (h < evening[1]), "evening_peak")
        .otherwise("off_peak")
    )


def density_window(ts: Column) -> Column:
    """morning, off_peak, evening or night; null for hours that no window covers."""
    h = hour_of_day(ts)
    return F.when((h >= 7) & (h < 9), "morning").when((h >= 9) & (h < 17), "off_peak").when((h >= 17) & (h < 19), "evening").when(h < 6, "night")


def parse_time(text: Column, offset: int = DEFAULT.utc_offset_sec) -> Column:
    """Epoch seconds of a number of seconds, a time with a zone, or a local time; null if it is none of these."""
    zoned = text.rlike(r"(Z|[+-]\d{2}:?\d{2})\s*$") & ~text.rlike(NUMBER)
    moment = F.try_to_timestamp(F.trim(text))
    return (
        F.when(text.rlike(NUMBER), F.floor(text.try_cast("double")).cast("long"))
        .when(zoned, F.floor(F.unix_micros(moment) / 1_000_000).cast("long"))
        .otherwise(F.floor(F.unix_micros(moment) / 1_000_000).cast("long") - offset)
    )


def overlaps_daily(start: Column, end: Column, begin_min: int, end_min: int, offset: int = DEFAULT.utc_offset_sec) -> Column:
    """Whether a span of epoch seconds meets a daily local window, half open; the window may pass midnight."""
    span = (end_min - begin_min) * 60 if end_min > begin_min else (end_min - begin_min + 1440) * 60
    first, last = F.floor((start + offset) / 86400).cast("long"), F.floor((end + offset) / 86400).cast("long")
    opens = lambda d: d * 86400 - offset + begin_min * 60
    hit = F.exists(F.sequence(first, last), lambda d: (start < opens(d) + span) & (end > opens(d)))
    return F.when(start.isNull() | end.isNull() | (end <= start), F.lit(False)).otherwise(hit)


def overlaps_hours(start: Column, end: Column, begin: int = 7, finish: int = 9) -> Column:
    """The same by hours of day alone."""
    return (hour_of_day(start) < finish) & (hour_of_day(end) >= begin)


def congestion_level(kmh: Column) -> Column:
    """One of four levels, an empty text for null."""
    return F.when(kmh.isNull(), "").when(kmh > 30, LEVELS[0]).when(kmh > 20, LEVELS[1]).when(kmh > 10, LEVELS[2]).otherwise(LEVELS[3])


def plausible_trip(seconds: Column, km: Column) -> Column:
    """X11: at most a day long and at most 150 km/h as the crow flies."""
    return F.coalesce((seconds > 0) & (seconds <= 86400) & (km <= seconds / 3600.0 * 150.0), F.lit(False))


def plausible_ride(seconds: Column, average_kmh: Column) -> Column:
    """Half a minute to two hours, and at most 120 km/h where the average is known."""
    return seconds.between(30, 7200) & (average_kmh.isNull() | (average_kmh <= 120.0))


def likely_parked(seconds: Column, limit: int = DEFAULT.likely_parked_sec) -> Column:
    """X13."""
    return (seconds > limit).cast("int")


def route_id(day: Column, trip_id: Column) -> Column:
    """YYYYMMDD_<trip>."""
    return F.concat_ws("_", F.regexp_replace(day, "-", ""), trip_id.cast("string"))


def day_of_file(name: Column, year: int = 2017) -> Column:
    """The day of a file whose name holds four digits, month and day, apart from other digits."""
    found = F.regexp_extract(name, r"(?<!\d)(\d{2})(\d{2})(?!\d)", 0)
    return F.when(found != "", F.concat_ws("-", F.lit(str(year)), F.substring(found, 1, 2), F.substring(found, 3, 2)))


def one_way(value: Column) -> Column:
    """B, F or T; anything else is an error."""
    v = F.upper(F.trim(value))
    return F.when(value.isNull() | v.isin("", "NONE", "NAN", "B"), "B").when(v.isin("F", "T"), v).otherwise(F.raise_error(F.concat(F.lit("unknown one-way value: "), value)))


def node_key(x: Column, y: Column) -> Column:
    """A node of the road network: coordinates in whole millimetres."""
    return F.concat_ws(":", F.round(x * 1000).cast("long").cast("string"), F.round(y * 1000).cast("long").cast("string"))


def truthy(value: Column) -> Column:
    """X18."""
    return F.coalesce(F.lower(F.trim(value.cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def no_nan(value: Column) -> Column:
    """0 for null and NaN."""
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(0.0))


def bad_coord(lon: Column, lat: Column, lon_range=DEFAULT.lon_range, lat_range=DEFAULT.lat_range) -> Column:
    """1 outside the country's box, borders being inside."""
    return F.coalesce((~(lon.between(*lon_range) & lat.between(*lat_range))).cast("int"), F.lit(1))


def out_of_day(ts: Column, day_start: int) -> Column:
    """1 outside the day that begins at day_start (epoch seconds)."""
    return F.coalesce((~((ts >= day_start) & (ts < day_start + 86400))).cast("int"), F.lit(1))
