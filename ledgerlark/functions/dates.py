"""Date functions: columns in, columns out."""

from pyspark.sql import Column
from pyspark.sql import functions as F

FORMATS = ["yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy", "MMMM d, yyyy", "dd MMM yyyy HH:mm:ss Z"]
MONTHS = "january february march april may june july august september october november december".split()


def parsed(c: Column, formats: list[str] | None = None) -> Column:
    """The timestamp of the first format that fits, in UTC; null if none does. A weekday before it is passed over."""
    plain = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3,9}, (?=\d)", "")
    return F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in formats or FORMATS])


def month_number(c: Column) -> Column:
    """1 to 12 of an English month name or its first three letters; null otherwise."""
    found = F.array_position(F.array(*[F.lit(m[:3]) for m in MONTHS]), F.lower(F.substring(c, 1, 3)))
    return F.when(found > 0, found.cast("int"))


def in_title(c: Column, fallback: Column) -> Column:
    """The date in a title (Month D, YYYY or M/D/YY or M/D/YYYY), else the fallback."""
    words = r"(?i)\b([A-Z][a-z]{2,8})\.? (\d{1,2}),? (\d{4})\b"
    slashes = r"\b(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})\b"
    part = lambda p, i: F.regexp_extract(c, p, i)
    year = part(slashes, 3).try_cast("int")
    spoken = F.concat_ws("-", part(words, 3), month_number(part(words, 1)).cast("string"), part(words, 2))
    numeric = F.concat_ws("-", F.when(year < 100, year + 2000).otherwise(year).cast("string"), part(slashes, 1), part(slashes, 2))
    to_day = lambda text: F.try_to_timestamp(text, F.lit("yyyy-M-d")).cast("date")
    return F.coalesce(to_day(spoken), to_day(numeric), fallback)


def with_inferred_year(month: Column, day: Column, approved: Column) -> Column:
    """A date without a year that lies before ``approved``: a later month is of the year before."""
    year = F.year(approved) - F.when(month > F.month(approved), 1).otherwise(0)
    return F.try_to_timestamp(F.format_string("%d-%d-%d", year, month, day), F.lit("yyyy-M-d")).cast("date")


def rounded(c: Column, places: int) -> Column:
    """Rounded with halves to even, as a double."""
    return F.bround(c, places)


def age_hours(now: Column, then: Column) -> Column:
    return (F.unix_timestamp(now) - F.unix_timestamp(then)) / 3600.0


def eastern_offset(c: Column) -> Column:
    """The offset of New York at noon UTC of a date, as ``-04:00`` or ``-05:00``."""
    noon = F.to_timestamp(F.date_format(c, "yyyy-MM-dd 12:00:00"))
    hours = F.hour(F.from_utc_timestamp(noon, "America/New_York")) - 12
    return F.when(c.isNotNull(), F.format_string("-%02d:00", -hours))


def long_form(c: Column) -> Column:
    """Weekday, month, day and year in words."""
    return F.date_format(c, "EEEE, MMMM d, yyyy")


def rfc_822(c: Column) -> Column:
    return F.date_format(c, "EEE, dd MMM yyyy HH:mm:ss +0000")


def hours_minutes(seconds: Column) -> Column:
    """``1h 05m``, or ``5m`` under an hour."""
    h, m = F.floor(seconds / 3600).cast("int"), F.floor(seconds % 3600 / 60).cast("int")
    return F.when(h > 0, F.format_string("%dh %02dm", h, m)).otherwise(F.format_string("%dm", m))
