"""Image payloads kept as ``struct<bytes, path>``: recognised by their signature, never decoded to pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# File signatures (hex prefix of the payload) and the MIME subtype they stand for.
SIGNATURES = (
    ("89504E470D0A1A0A", "png"),
    ("FFD8FF", "jpeg"),
    ("474946383761", "gif"),
    ("474946383961", "gif"),
    ("424D", "bmp"),
    ("49492A00", "tiff"),
    ("4D4D002A", "tiff"),
)


def mime_subtype(payload: Column) -> Column:
    """png, jpeg, … by signature; null for anything else."""
    head = F.hex(F.substring(payload, 1, 12))
    expr = F.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), F.lit("webp"))
    for prefix, name in SIGNATURES:
        expr = expr.when(head.startswith(prefix), F.lit(name))
    return expr


def _base64_only(c: Column) -> Column:
    """Signs outside the alphabet, and padding that is not at the end, are skipped."""
    return F.regexp_replace(F.regexp_replace(c, r"[^\p{Alnum}+/=]", ""), "=+(?=[^=])", "")


def decode_base64(c: Column, pad: bool = False) -> Column:
    """Decoded bytes; null where the length does not fit or the text is not ASCII. ``pad`` adds missing padding."""
    body = _base64_only(c)
    if pad:
        body = F.concat(body, F.repeat(F.lit("="), F.pmod(-F.length(body), F.lit(4))))
    fits = (F.length(body) % 4 == 0) & (F.length(c) == F.octet_length(c))
    return F.when(fits, F.try_to_binary(body, F.lit("base64")))


def is_base64_image(c: Column) -> Column:
    """A data URL, or a long text that decodes to more than 100 bytes."""
    decoded = F.when(F.length(c) > 100, decode_base64(c))
    return F.coalesce(c.startswith("data:image/") | (F.length(decoded) > 100), F.lit(False))


def image_bytes(c: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, T.BinaryType):
        return c
    if isinstance(dtype, T.StructType) and "bytes" in dtype.names:
        return c["bytes"]
    if isinstance(dtype, T.StringType):
        return F.when(
            c.startswith("data:image/"), decode_base64(F.split_part(c, F.lit(","), F.lit(2)))
        ).when(F.length(c) > 100, decode_base64(c))
    raise ValueError(f"an image column must be binary, text or a struct with bytes, not {dtype.simpleString()}")


def image_struct(payload: Column) -> Column:
    """``struct<bytes, path>`` or null where the payload is no known image."""
    return F.when(
        mime_subtype(payload).isNotNull(),
        F.struct(payload.alias("bytes"), F.lit(None).cast("string").alias("path")),
    )


def data_url(payload: Column) -> Column:
    return F.when(
        mime_subtype(payload).isNotNull(),
        F.concat(F.lit("data:image/"), mime_subtype(payload), F.lit(";base64,"), F.translate(F.base64(payload), "\r\n", "")),
    )
