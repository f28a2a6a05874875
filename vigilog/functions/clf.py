"""Common / Combined Log Format as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the line format (host ident user [date] "request" status bytes "referer" "agent").
CLF = (
    r'^(\S+) (\S+) (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\S+)'
    r'(?: "([^"]*)")?(?: "([^"]*)")?'
)
# Groups kept as fields: everything but the ident token.
FIELDS = {"host": 1, "user": 3, "date": 4, "request": 5, "status": 6, "bytes": 7,
          "referer": 8, "agent": 9}
_SEP = "\u0001"
_PACK = _SEP.join(f"${group}" for group in FIELDS.values())
# Fixed value: the characters a Unicode-aware strip removes.
_BLANKS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
           + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000")


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(_BLANKS))


def matches(line: Column) -> Column:
    return line.rlike(CLF)


def fields(line: Column) -> Column:
    """The eight fields of a stripped line as an array; another size means no match.

    One regex run per line: the groups are re-written with a separator and split. A line
    that itself holds the separator character takes the group-by-group route.
    """
    packed = F.split(F.regexp_replace(line, CLF + r"(?s:.*)$", _PACK), _SEP)
    grouped = F.when(matches(line), F.array(
        *[F.regexp_extract(line, CLF, group) for group in FIELDS.values()]))
    return F.when(F.contains(line, F.lit(_SEP)), grouped).otherwise(packed)


def field(parsed: Column, name: str) -> Column:
    return F.get(parsed, F.lit(list(FIELDS).index(name)))


def dash_to_null(value: Column) -> Column:
    return F.when(~value.isin("", "-"), value)


def instant(date: Column) -> Column:
    """The moment named by the bracketed date; NULL when it is no date.

    Offsets `-0700`, `+02:00` and `Z` are understood; anything else in the last token is
    dropped and the rest read as UTC.
    """
    return F.coalesce(
        F.try_to_timestamp(date, F.lit("d/MMM/yyyy:H:m:s Z")),
        F.try_to_timestamp(date, F.lit("d/MMM/yyyy:H:m:s XXX")),
        F.try_to_timestamp(F.regexp_replace(date, " [^ ]*$", ""), F.lit("d/MMM/yyyy:H:m:s")),
    )


def zone(date: Column) -> Column:
    """The UTC offset the bracketed date ends in, empty if it names none."""
    return F.regexp_extract(date, r" ([+-]\d{2}:?\d{2}|Z)$", 1)


def offset(zone_text: Column) -> Column:
    """`+HH:MM` of a date's `zone`, NULL when there is none."""
    digits = F.replace(zone_text, F.lit(":"), F.lit(""))
    return (F.when(zone_text == "Z", F.lit("+00:00"))
            .when(zone_text != "", F.concat(F.substring(digits, 1, 3), F.lit(":"),
                                            F.substring(digits, 4, 2))))
