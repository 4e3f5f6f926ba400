"""Limits, names and schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import types as T

# Limits.
TILE = 16
MAX_COMPONENTS = 1000
MAX_REGIONS = 100
MAX_BLOCKS = 500
MAX_BLOCK_CHARS = 4000
MAX_CONTENT_CHARS = 200_000
MAX_POLYGON_VALUES = 32
MAX_WARNINGS = 20
MAX_DETAIL_ENTRIES = 10
MAX_DETAIL_CHARS = 200
MAX_REPORTED_ERRORS = 5

# Defaults.
DEFAULT_THRESHOLD = 0.05
DEFAULT_MAX_REGIONS = 20
DEFAULT_MAX_IMAGE_BYTES = 10 * 1024 * 1024
DEFAULT_MAX_IMAGE_PIXELS = 40_000_000
DEFAULT_LANGUAGE = "en"
DEFAULT_TTL_SECONDS = 3600
DEFAULT_QUOTA_BYTES = 256 * 1024 * 1024
DEFAULT_QUOTA_COUNT = 200

# Media.
PNG_SIGNATURE = "89504E470D0A1A0A"
JPEG_SIGNATURE = "FFD8FF"
MEDIA_TYPES = ("image/png", "image/jpeg", "image/webp")

# HTTP status per error code, and the codes a caller may retry.
STATUS_BY_CODE = {
    "invalid_input": 400,
    "unauthorized": 401,
    "forbidden": 403,
    "not_found": 404,
    "payload_too_large": 413,
    "unsupported_media": 415,
    "quota_exceeded": 429,
    "internal": 500,
    "provider_error": 502,
    "busy": 503,
    "provider_unavailable": 503,
    "timeout": 504,
}
RETRYABLE_CODES = ("busy", "timeout", "provider_unavailable")
FALLBACK_CODES = ("provider_unavailable", "timeout")

# OCR provenance and vocabulary.
MANAGED_PROVIDER = "azure_content_understanding"
MANAGED_MODE = "azure"
MANAGED_MODEL = "prebuilt-documentAnalyzer"
MANAGED_API_VERSION = "2025-11-01"
LOCAL_PROVIDER = "local_paddleocr"
LOCAL_MODE = "local"
LOCAL_MODEL = "PP-OCRv5"
BLOCK_TYPES = ("line", "paragraph", "word")
SUPPORTED_LANGUAGES = ("ch", "en", "fr", "german", "japan", "korean")
CSV_HEADER = "id,text,confidence,x,y,width,height"

# Messages.
MSG_SIZE_DIFFERS = "images differ in size; non-overlapping pixels count as changed"
MSG_NO_DIFF = "diff image was not produced because no pixels changed"
MSG_REGIONS_TRUNCATED = "changed region list truncated to %d entries"
MSG_BLOCKS_TRUNCATED = "block list truncated to %d entries"
MSG_CONTENT_TRUNCATED = "formatted content truncated"
MSG_DOWNSCALED = "crop was downscaled to fit the requested maximum dimensions"
MSG_BOX_OUTSIDE = "Bounding box starts outside the image"
MSG_BOX_EMPTY = "Bounding box has no area"
MSG_BOX_BEYOND = "Bounding box extends beyond the image; boxes are never clamped"
MSG_NO_CONTENT = "provider returned no content"
MSG_NO_BLOCKS = "provider returned no positional blocks"
MSG_FELL_BACK = "fell back to the local provider after a retryable failure: "

_POLYGON = T.ArrayType(T.DoubleType())

ERROR = T.StructType(
    [
        T.StructField("code", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("retryable", T.BooleanType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)

BLOCK = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("block_type", T.StringType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("polygon", _POLYGON),
        T.StructField("confidence", T.DoubleType()),
    ]
)

_CHANNEL = T.ArrayType(T.ShortType(), False)

TILES = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("ty", T.IntegerType()),
        T.StructField("tx", T.IntegerType()),
        T.StructField("tw", T.IntegerType()),
        T.StructField("th", T.IntegerType()),
        T.StructField("r", _CHANNEL),
        T.StructField("g", _CHANNEL),
        T.StructField("b", _CHANNEL),
    ]
)

IMAGES = T.StructType(
    [
        T.StructField("image_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("byte_count", T.LongType()),
        T.StructField("width", T.IntegerType()),
        T.StructField("height", T.IntegerType()),
        T.StructField("source_kind", T.StringType()),
        T.StructField("error_code", T.StringType()),
    ]
)

ASSET_METADATA = T.StructType(
    [
        T.StructField("assetId", T.StringType()),
        T.StructField("principal", T.StringType()),
        T.StructField("contentType", T.StringType()),
        T.StructField("byteCount", T.StringType()),
        T.StructField("createdAt", T.StringType()),
        T.StructField("expiresAt", T.StringType()),
        T.StructField("_corrupt_record", T.StringType()),
    ]
)

ADMISSIONS = T.StructType(
    [
        T.StructField("asset_id", T.StringType()),
        T.StructField("principal", T.StringType()),
        T.StructField("byte_count", T.LongType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("decision", T.StringType()),
    ]
)
