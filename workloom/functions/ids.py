"""UUID columns."""

import re
import uuid

from pyspark.sql import Column, functions as F

# Fixed patterns: the textual forms an id may take.
DASHED_UUID = r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
BARE_UUID = r"[0-9a-fA-F]{32}"
URN_PREFIX = "urn:uuid:"


def _is(text: Column, form: str) -> Column:
    """Whether the whole text has the form; a line end after it is not passed over."""
    return text.rlike(f"^{form}\\z")


def valid_uuid(text: Column | str) -> Column:
    """The dashed lower-case form of an id, or null when the text is not an id.

    Accepts the dashed form, the dashed form behind a URN prefix or between one character on
    either side (usually braces), and 32 bare hex digits.
    """
    text = F.col(text) if isinstance(text, str) else text
    core = (
        F.when((F.length(text) == 45) & (F.lower(F.substring(text, 1, 9)) == URN_PREFIX),
               F.substring(text, 10, 36))
        .when(F.length(text) == 38, F.substring(text, 2, 36))
        .otherwise(text)
    )
    return (
        F.when(_is(core, DASHED_UUID), F.lower(core))
        .when(_is(text, BARE_UUID), dashed(text))
    )


def parse_uuid(text: str) -> str | None:
    """`valid_uuid` for an argument given in Python."""
    core = text
    if len(text) == 45 and text[:9].lower() == URN_PREFIX:
        core = text[9:]
    elif len(text) == 38:
        core = text[1:-1]
    if re.fullmatch(DASHED_UUID, core) or re.fullmatch(BARE_UUID, text):
        return str(uuid.UUID(core))
    return None


def dashed(hex32: Column) -> Column:
    """32 hex digits in the dashed form."""
    text = F.lower(hex32)
    return F.concat_ws(
        "-",
        F.substring(text, 1, 8), F.substring(text, 9, 4), F.substring(text, 13, 4),
        F.substring(text, 17, 4), F.substring(text, 21, 12),
    )


def stable_uuid(*parts: Column | str) -> Column:
    """An id derived from the row, so a recomputed task yields the same one."""
    return dashed(F.md5(F.concat_ws(":", *[F.col(p).cast("string") if isinstance(p, str)
                                           else p.cast("string") for p in parts])))
