"""Value checks for provider fields, as Column expressions.

Every check expects a value that went through :func:`normalize`. All of them stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space that is stripped and that the patterns accept (Unicode white space
# and the four information separators), as a literal string and as a regex class body.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
SPACE_CLASS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

# The accepted shapes.
NPI_PATTERN = r"^\p{Nd}{10}$"
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = (
    rf"^(\+?1[-.{SPACE_CLASS}]?)?\(?[0-9]{{3}}\)?[-.{SPACE_CLASS}]?[0-9]{{3}}[-.{SPACE_CLASS}]?[0-9]{{4}}$"
)
STATE_PATTERN = r"^[A-Z]{2}$"
# In the next two a run of common characters is taken first, since testing the whole white space class
# for every letter costs more than all other checks together.
NAME_PATTERN = rf"^[A-Z](?:[a-zA-Z '\-]++|[{SPACE_CLASS}])++$"
SPECIALTY_PATTERN = rf"^(?:[A-Za-z &\-/,]++|[{SPACE_CLASS}])++$"

# Words that stand for a consent answer.
TRUE_WORDS = ("true", "yes", "y", "1", "on", "enabled", "opt-in", "opted-in")
FALSE_WORDS = ("false", "no", "n", "0", "off", "disabled", "opt-out", "opted-out")

# Fixed value: issuer prefix put before a provider number for its check digit.
NPI_PREFIX = "80840"


def normalize(value: Column) -> Column:
    """NULL becomes the empty string; anything else is text without outer white space."""
    return F.btrim(F.coalesce(value.cast("string"), F.lit("")), F.lit(SPACES))


def is_blank(value: Column) -> Column:
    return normalize(value) == ""


def is_npi(value: Column) -> Column:
    return (F.char_length(value) == 10) & value.rlike(NPI_PATTERN)


def is_email(value: Column) -> Column:
    return value.contains("@") & value.rlike(EMAIL_PATTERN)


def is_phone(value: Column) -> Column:
    return F.char_length(value).between(10, 17) & value.rlike(PHONE_PATTERN)


def is_state(value: Column) -> Column:
    return (F.char_length(value) == 2) & value.rlike(STATE_PATTERN)


def is_name(value: Column) -> Column:
    return value.rlike(NAME_PATTERN)


def is_specialty(value: Column) -> Column:
    return (F.char_length(value) >= 3) & value.rlike(SPECIALTY_PATTERN)


def is_boolean_word(value: Column) -> Column:
    return F.lower(value).isin(*TRUE_WORDS, *FALSE_WORDS)


def consent(value: Column) -> Column:
    """Consent word to boolean; anything that is no consent word is NULL."""
    word = F.lower(normalize(value))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def has_valid_check_digit(npi: Column) -> Column:
    """Luhn check of a ten-digit provider number behind the issuer prefix."""
    value = normalize(npi)
    shape = value.rlike(r"^[0-9]{10}$")
    return F.when(shape, F.call_function("luhn_check", F.concat(F.lit(NPI_PREFIX), value))).otherwise(False)


# The semantic types in the order that decides ties.
CHECKS = {
    "npi": is_npi,
    "email": is_email,
    "phone": is_phone,
    "practiceState": is_state,
    "boolean": is_boolean_word,
    "firstName": is_name,
    "lastName": is_name,
    "specialty": is_specialty,
}
