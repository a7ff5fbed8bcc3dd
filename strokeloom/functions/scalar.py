"""Scalar rules as column expressions. All stay in the JVM but for Unicode composition."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space as a browser's regular expressions and trim() know it.
WIDE_SPACE = r"\s\x{00A0}\x{FEFF}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
BASE64_TEXT = rf"^[A-Za-z0-9+/={WIDE_SPACE}]+$"
BASE64_PLAIN = "^[A-Za-z0-9+/=]+$"  # what nearly all payloads are; the wider class is several times slower
BASE64_MARK = ";base64,"


def blank_to_null(value: Column) -> Column:
    """Null for null and empty text; blank text stays."""
    return F.nullif(value, F.lit(""))


def first_given(*values: Column) -> Column:
    """The first value that is neither null nor empty; the last one as it is."""
    return F.coalesce(*(blank_to_null(v) for v in values[:-1]), values[-1])


def round6(value: Column) -> Column:
    """Nearest millionth, ties upward: round() would send negative ties downward."""
    return F.floor(value * 1e6 + 0.5) / F.lit(1e6)


def clamp(value: Column, low, high) -> Column:
    """NaN and null stay what they are."""
    low, high = (F.lit(x) if not isinstance(x, Column) else x for x in (low, high))
    return F.when(value.isNull() | F.isnan(value), value).otherwise(F.greatest(low, F.least(high, value)))


def trim_wide(value: Column) -> Column:
    return F.regexp_replace(value, rf"^[{WIDE_SPACE}]+|[{WIDE_SPACE}]+$", "")


@F.pandas_udf(T.StringType())
def composed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Unicode composition (NFC), for which Spark has no built-in."""
    for s in batches:
        yield s.str.normalize("NFC")


def safe_key(value: Column, compose: bool = False) -> Column:
    """Letters, marks, numbers, `.`, `-` and single inner `_`; anything else becomes `_`; nothing: x.

    compose puts text into NFC first; leave it off for text known to be composed, to stay in the JVM.
    """
    text = composed(value) if compose else value
    cleaned = F.regexp_replace(text, r"[^\p{L}\p{M}\p{N}.-]+", "_")
    return F.coalesce(F.nullif(F.btrim(cleaned, F.lit("_")), F.lit("")), F.lit("x"))


def safe_path_key(value: Column, compose: bool = False) -> Column:
    """safe_key for use as a folder: `.` and `..` would leave it, and are null."""
    key = safe_key(value, compose)
    return F.when(~key.isin(".", ".."), key)


def safe_extension(value: Column) -> Column:
    return F.when(F.lower(safe_key(value)) == "mp4", F.lit("mp4")).otherwise(F.lit("webm"))


def extension_from_mime(mime: Column) -> Column:
    given = blank_to_null(mime)
    return F.when(given.isNull(), F.lit("")).when(F.contains(given, F.lit("mp4")), F.lit("mp4")).otherwise(F.lit("webm"))


def choose_extension(declared: Column, mime: Column) -> Column:
    return safe_extension(first_given(declared, extension_from_mime(mime), F.lit("webm")))


def trim_slashes(value: Column) -> Column:
    return F.btrim(F.coalesce(value, F.lit("")), F.lit("/"))


def join_path(*parts: Column) -> Column:
    """Parts that are neither null nor empty, joined with slashes."""
    return F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull() & (x != "")), "/")


def pad2(value: Column) -> Column:
    """At least two digits; longer numbers stay whole (lpad alone would cut them)."""
    text = value.cast("string")
    return F.when(F.length(text) >= 2, text).otherwise(F.lpad(text, 2, "0"))


def username_or_default(value: Column, default: str = "user1") -> Column:
    return F.coalesce(blank_to_null(trim_wide(value)), F.lit(default))


def label_in_domain(value: Column, labels) -> Column:
    return F.when(value.isin(list(labels)), value).otherwise(F.lit(labels[0]))


def megabytes(size: Column) -> Column:
    return F.floor(size / (1024 * 1024) + 0.5)


def iso_text(ts: Column) -> Column:
    """UTC text with milliseconds; the session's time zone must be UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd_HHmmss")


def base36_suffix(seed: Column, size: int = 6) -> Column:
    """Up to `size` base-36 digits from a hash of seed: an id's suffix that a rerun gives again."""
    return F.lower(F.conv(F.pmod(F.xxhash64(seed), F.lit(36**size)).cast("string"), 10, 36))


def sample_id(ts: Column, seed: Column) -> Column:
    return F.concat_ws("_", stamp(ts), base36_suffix(seed))


def let(value: Column, body) -> Column:
    """body of value, with value computed once: a lambda's variable is bound, an expression repeated."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parse_data_url(url: Column) -> Column:
    """struct(mime, payload): null if url is null or malformed; see data_url_fault.

    A payload holds no `;`, so it starts after the last mark.
    """

    def checked(payload: Column, plain: Column) -> Column:
        mime = F.substr(url, F.lit(6), F.length(url) - F.length(payload) - len(BASE64_MARK) - 5)
        well = F.startswith(url, F.lit("data:")) & F.contains(url, F.lit(BASE64_MARK)) & (F.length(mime) > 0) & ~mime.rlike(r"[\n\r\x{2028}\x{2029}]")
        bare = F.when(plain, payload).otherwise(F.regexp_replace(payload, rf"[{WIDE_SPACE}]", ""))
        return F.when(well & (plain | payload.rlike(BASE64_TEXT)), F.struct(mime.alias("mime"), bare.alias("payload")))

    return let(F.substring_index(url, BASE64_MARK, -1), lambda payload: let(payload.rlike(BASE64_PLAIN), lambda plain: checked(payload, plain)))


def data_url_fault(url: Column, prefix: str, parsed: Column | None = None) -> Column:
    """400 if the text is there but is no data URL, or is of another media type; else null.

    parsed is url's parse_data_url, where that is a column already.
    """
    mime = (parse_data_url(url) if parsed is None else parsed)["mime"]
    return F.when(url.isNotNull() & ~F.coalesce(F.startswith(mime, F.lit(prefix)), F.lit(False)), F.lit(400))


def decoded_length(payload: Column) -> Column:
    """Bytes that base64 text decodes to, by its length alone."""
    pads = F.length(payload) - F.length(F.rtrim(payload, F.lit("=")))
    return F.floor((F.length(payload) - F.least(pads, F.lit(2))) * 3 / 4)


def status_for(status: Column) -> Column:
    return F.when(status < 500, status).otherwise(F.lit(500))


def first_supported(preferences, supported: Column) -> Column:
    choices = F.array(*map(F.lit, preferences))
    return F.coalesce(F.get(F.filter(choices, lambda m: F.array_contains(supported, m)), F.lit(0)), F.lit(""))


def to_data_url(mime: Column, content: Column) -> Column:
    return F.when(content.isNotNull(), F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(content)))
