"""Strict text parsing as column expressions; a bad value gives NULL, never an error."""

from pyspark.sql import functions as F

# Accepted text forms and bounds.
DIGITS = r"^[0-9]+\z"
COMPACT_DATE = r"^[0-9]{8}\z"
CLOCK = r"^[0-9]+:[0-5][0-9]:[0-5][0-9]\z"
BLANKS = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BLANK_CHARACTERS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = (
    rf"^{BLANKS}*[+-]?([0-9](_?[0-9])*\.?([0-9](_?[0-9])*)?|\.[0-9](_?[0-9])*)"
    rf"([eE][+-]?[0-9](_?[0-9])*)?{BLANKS}*\z"
)
PLAIN_NUMBER = r"^[+-]?[0-9]+(\.[0-9]*)?\z"
MAX_HOUR_DIGITS = 16
MAX_LATITUDE = 90
MAX_LONGITUDE = 180


def has_outer_blank(text):
    """Whether the first or the last character is a blank."""
    return F.substring(text, 1, 1).isin(*BLANK_CHARACTERS) | F.substring(text, -1, 1).isin(*BLANK_CHARACTERS)


def is_blank(text):
    return F.trim(text, F.lit(BLANK_CHARACTERS)) == ""


def normalize_id(text):
    """Ids are kept as they are; only the empty text means missing."""
    return F.nullif(text, F.lit(""))


def parse_int(text, default=None):
    """Unsigned integer of plain digits up to 2^63-1.

    A single digit, which most codes are, needs no pattern.
    """
    if default is not None:
        text = F.when(text == "", F.lit(default)).otherwise(text)
    digit = (F.octet_length(text) == 1) & text.between("0", "9")
    return F.when(digit, (F.ascii(text) - 48).cast("long")).when(text.rlike(DIGITS), text.try_cast("long"))


def parse_date(text):
    """A real date written as eight digits."""
    return F.when(text.rlike(COMPACT_DATE), F.try_to_date(text, "yyyyMMdd"))


def parse_number(text):
    """A finite decimal number; special names such as NaN are not numbers.

    Blanks around the number and single underscores between digits are allowed; texts without
    them, nearly all, take the first branch only.
    """
    cleaned = F.regexp_replace(F.regexp_replace(text, BLANKS, ""), "_", "")
    number = F.when(text.rlike(PLAIN_NUMBER), text.try_cast("double")).when(
        text.rlike(NUMBER), cleaned.try_cast("double")
    )
    return F.when(F.abs(number) != F.lit(float("inf")), number)


def parse_seconds(text):
    """H:MM:SS with any hour to seconds of the service day."""
    hours = F.substring(text, F.lit(1), F.length(text) - 6)
    minutes = F.substring(text, -5, 2).try_cast("long")
    seconds = F.right(text, F.lit(2)).try_cast("long")
    short = (F.octet_length(text) <= MAX_HOUR_DIGITS + 6) | (F.length(F.ltrim(hours, F.lit("0"))) <= MAX_HOUR_DIGITS)
    usable = text.rlike(CLOCK) & short
    total = F.try_add(
        F.try_multiply(hours.try_cast("long"), F.lit(3600).cast("long")), minutes * 60 + seconds
    )
    return F.when(usable, total)


# Fixed value: whole numbers as a lenient reader takes them.
WHOLE_NUMBER = rf"^{BLANKS}*[+-]?[0-9](_?[0-9])*{BLANKS}*\z"


def parse_whole_number(text):
    """A signed 64-bit integer, surrounding blanks and digit separators allowed."""
    cleaned = F.regexp_replace(F.regexp_replace(text, BLANKS, ""), "_", "")
    return F.when(text.rlike(WHOLE_NUMBER), cleaned.try_cast("long"))
