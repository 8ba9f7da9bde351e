"""Text, identifiers, signatures and JSON bodies, all as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3339 date-time shape and the HMAC-SHA256 block constants.
RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)$"
HMAC_BLOCK_BYTES = 64
HMAC_INNER = 0x36
HMAC_OUTER = 0x5C


def rfc3339(text: Column) -> Column:
    """TIMESTAMP of an RFC 3339 text; NULL for any other shape, such as a bare date.

    The shape is matched once, after that positions are known. The offset is applied here
    because a plain cast refuses offsets beyond 18 hours.
    """
    size = F.length(text)
    zulu = text.endswith("Z")
    local = F.substr(text, F.lit(1), F.when(zulu, size - 1).otherwise(size - 6))
    utc = F.concat(local, F.lit("Z")).try_cast("timestamp")
    minutes = F.substr(text, size - 4, F.lit(2)).cast("int") * 60 + F.substr(text, size - 1, F.lit(2)).cast("int")
    behind = F.substr(text, size - 5, F.lit(1)) == "-"
    shifted = F.timestamp_add("MINUTE", F.when(behind, minutes).otherwise(-minutes), utc)
    return F.when(text.rlike(RFC3339), F.when(zulu, utc).otherwise(shifted))


# White space of all scripts, as Unicode lists it.
SPACES = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def stripped(c: Column) -> Column:
    """Text without white space at its ends."""
    return F.btrim(c, F.lit(SPACES))


def blank(c: Column) -> Column:
    return F.coalesce(stripped(c) == "", F.lit(True))


def empty_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def null_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def one_decimal(c: Column) -> Column:
    """``%.1f`` of a double: exact binary value, ties to even.

    ``format_number`` rounds that way; ``format_string`` rounds ties up.
    """
    return F.replace(F.format_number(c, 1), F.lit(","), F.lit(""))


def alert_message(severity: Column, name: Column, value: Column, op: Column, threshold: Column) -> Column:
    return F.concat(
        F.lit("["), severity, F.lit("] "), name, F.lit(": "),
        one_decimal(value), F.lit(" "), op, F.lit(" "), one_decimal(threshold),
    )


def stable_id(prefix: str | Column, *natural_key: Column) -> Column:
    """Identifier from a row's natural key, so re-runs and retries name the same row alike.

    Each part goes in with its length, NULL as a dash, so different keys are different texts.
    """
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    parts = [c.cast("string") for c in natural_key]
    key = F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
    return F.concat(start, F.lit("-"), F.substring(F.sha2(key, 256), 1, 24))


def _xor_pad(block_hex: Column, constant: int) -> Column:
    """Bytes of a hex block, each combined with one constant byte."""
    byte = lambda i: F.conv(F.substr(block_hex, i * 2 - 1, F.lit(2)), 16, 10).cast("int")
    flipped = F.transform(
        F.sequence(F.lit(1), F.lit(HMAC_BLOCK_BYTES)),
        lambda i: F.lpad(F.hex(byte(i).bitwiseXOR(F.lit(constant))), 2, "0"),
    )
    return F.unhex(F.array_join(flipped, ""))


def hmac_pads(secret: Column) -> Column:
    """STRUCT<inner, outer> key blocks of a secret; made once per channel, not per message."""
    raw = F.encode(secret, "UTF-8")
    short = F.octet_length(raw) <= HMAC_BLOCK_BYTES
    key_hex = F.when(short, F.hex(raw)).otherwise(F.upper(F.sha2(raw, 256)))
    block = F.rpad(key_hex, HMAC_BLOCK_BYTES * 2, "0")
    return F.struct(_xor_pad(block, HMAC_INNER).alias("inner"), _xor_pad(block, HMAC_OUTER).alias("outer"))


def signature(body: Column, pads: Column) -> Column:
    """``sha256=<hex>`` HMAC-SHA256 of a body; NULL where there are no pads."""
    inner = F.unhex(F.sha2(F.concat(pads["inner"], F.encode(body, "UTF-8")), 256))
    return F.concat(F.lit("sha256="), F.sha2(F.concat(pads["outer"], inner), 256))


def rfc3339_text(ts: Column) -> Column:
    """UTC text with microseconds only where there are any."""
    seconds = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.rtrim(F.date_format(ts, "SSSSSS"), F.lit("0"))
    return F.concat(seconds, F.when(fraction != "", F.concat(F.lit("."), fraction)).otherwise(""), F.lit("Z"))


def sse_frame(event_type: Column, data_json: Column) -> Column:
    return F.concat(F.lit("event: "), event_type, F.lit("\ndata: "), data_json, F.lit("\n\n"))
