"""Content checks on image bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import (
    DEFAULT_MAX_IMAGE_BYTES,
    DEFAULT_MAX_IMAGE_PIXELS,
    JPEG_SIGNATURE,
    MEDIA_TYPES,
    PNG_SIGNATURE,
)


def _starts_with(content: Column, signature: str, at: int = 1) -> Column:
    return F.hex(F.substring(content, at, len(signature) // 2)) == signature


def sniff_content_type(content: Column) -> Column:
    riff_webp = _starts_with(content, b"RIFF".hex().upper()) & _starts_with(
        content, b"WEBP".hex().upper(), 9
    )
    return (
        F.when(_starts_with(content, PNG_SIGNATURE), "image/png")
        .when(_starts_with(content, JPEG_SIGNATURE), "image/jpeg")
        .when(riff_webp, "image/webp")
    )


def _unsigned(content: Column, at: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("decimal(10,0)")


def png_width(content: Column) -> Column:
    return F.when(F.length(content) >= 24, _unsigned(content, 17))


def png_height(content: Column) -> Column:
    return F.when(F.length(content) >= 24, _unsigned(content, 21))


def payload_gate(
    content: Column,
    max_bytes: int = DEFAULT_MAX_IMAGE_BYTES,
    max_pixels: int = DEFAULT_MAX_IMAGE_PIXELS,
) -> Column:
    """Error code of the first rule an image payload breaks before decoding, or null.

    PNG dimensions stand in the header; the other formats are checked by ``decoded_gate``.
    """
    kind = sniff_content_type(content)
    pixels = png_width(content) * png_height(content)
    png = kind == "image/png"
    return (
        F.when(content.isNull() | (F.length(content) == 0), "invalid_input")
        .when(F.length(content) > max_bytes, "payload_too_large")
        .when(kind.isNull(), "unsupported_media")
        .when(png & (pixels > max_pixels), "payload_too_large")
        .when(png & (pixels.isNull() | (pixels == 0)), "invalid_input")
    )


def decoded_gate(
    width: Column, height: Column, max_pixels: int = DEFAULT_MAX_IMAGE_PIXELS
) -> Column:
    """The rules that need decoded dimensions; a decoder reports failure by a missing width."""
    return F.when(
        width.cast("long") * height.cast("long") > max_pixels, "payload_too_large"
    ).when(F.coalesce(width, F.lit(-1)) <= 0, "invalid_input")


def normalized_content_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(content_type, ";", 1), F.lit(" \t\r\n\x0b\x0c")))


def content_type_gate(content_type: Column) -> Column:
    allowed = normalized_content_type(content_type).isin(*MEDIA_TYPES)
    return F.when(~F.coalesce(allowed, F.lit(False)), "unsupported_media")


def upload_gate(content_type: Column, byte_count: Column, max_bytes: int) -> Column:
    """Uploads are judged by declared type first, then by size, then by emptiness."""
    return (
        F.when(content_type_gate(content_type).isNotNull(), "unsupported_media")
        .when(byte_count > max_bytes, "payload_too_large")
        .when(byte_count == 0, "invalid_input")
    )
