"""Validation rules as columns; a rule yields an error code, a message or a list of both."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..settings import (
    DEFAULT_LANGUAGE,
    MAX_REGIONS,
    MSG_BOX_BEYOND,
    MSG_BOX_EMPTY,
    MSG_BOX_OUTSIDE,
)

# The forms of identifiers and language tags.
ASSET_ID_PATTERN = "^[A-Za-z0-9_-]+\\z"
LANGUAGE_PATTERN = "^[A-Za-z0-9_-]+\\z"
NUL = "\u0000"


def normalized_path(path: Column) -> Column:
    """Absolute path without empty, ``.`` and ``..`` segments."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda kept, part: F.when(part.isin("", "."), kept)
        .when(part == "..", F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))
        .otherwise(F.concat(kept, F.array(part))),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def path_ancestors(path: Column) -> Column:
    """A normalized path itself and every folder above it."""
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts)),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, 1, n), "/")),
    )


def path_form_gate(path: Column, any_roots: bool = True) -> Column:
    """The rules that need only the text of the path."""
    if not any_roots:
        return F.lit("invalid_input")
    return F.when(path.contains(NUL), "invalid_input").when(
        ~F.coalesce(path.startswith("/"), F.lit(False)), "invalid_input"
    )


def inside_roots(path: Column, roots: Sequence[str]) -> Column:
    """True when a normalized path is one of the configured roots or lies below one; roots may be written loosely."""
    clean = [normalized_path(F.lit(r)) for r in roots]
    return F.arrays_overlap(path_ancestors(path), F.array(*clean))


def path_gate(path: Column, roots: Sequence[str], exists: Column | None = None) -> Column:
    gate = F.when(path_form_gate(path, bool(roots)).isNotNull(), "invalid_input")
    if exists is not None:
        gate = gate.when(~exists, "not_found")
    if roots:
        gate = gate.when(~inside_roots(normalized_path(path), roots), "forbidden")
    return gate


def asset_id_valid(asset_id: Column) -> Column:
    return asset_id.rlike(ASSET_ID_PATTERN) & F.length(asset_id).between(8, 128)


def object_id_gate(asset_id: Column) -> Column:
    """What the object store refuses: an id needs a letter or digit, dashes and underscores apart, and nothing else."""
    good = asset_id.rlike("^[\\p{L}\\p{N}_-]+\\z") & asset_id.rlike("[\\p{L}\\p{N}]")
    return F.when(~F.coalesce(good, F.lit(False)), "not_found")


def stored_id_gate(asset_id: Column) -> Column:
    """What a store itself refuses to look up."""
    bad = (
        (asset_id == "")
        | asset_id.contains("/")
        | asset_id.contains("\\")
        | asset_id.startswith(".")
    )
    return F.when(F.coalesce(bad, F.lit(True)), "not_found")


def language_or_default(language: Column, default: str = DEFAULT_LANGUAGE) -> Column:
    return F.when(F.coalesce(language, F.lit("")) == "", default).otherwise(language)


def language_gate(
    language: Column, allowed: Sequence[str], local: Column | bool = True
) -> Column:
    """Only the local provider has an allow-list; the managed one ignores the language."""
    applies = F.lit(local) if isinstance(local, bool) else local
    return F.when(applies & ~language.isin(*allowed), "invalid_input")


def box_error(
    x: Column, y: Column, width: Column, height: Column, image_width: Column, image_height: Column
) -> Column:
    """A box starts inside the image, has an area, and ends inside it."""
    return F.when(
        (x < 0) | (y < 0) | (x >= image_width) | (y >= image_height), MSG_BOX_OUTSIDE
    ).when((width <= 0) | (height <= 0), MSG_BOX_EMPTY).when(
        (x.cast("long") + width > image_width) | (y.cast("long") + height > image_height),
        MSG_BOX_BEYOND,
    )


def _rule(location: str, broken: Column, message: str) -> Column:
    return F.when(
        broken, F.struct(F.lit(location).alias("location"), F.lit(message).alias("message"))
    )


def _at_least(location: str, value: Column, limit: int | float) -> Column:
    return _rule(location, value < limit, f"Input should be greater than or equal to {limit:g}")


def _at_most(location: str, value: Column, limit: int | float) -> Column:
    return _rule(location, value > limit, f"Input should be less than or equal to {limit:g}")


def _above(location: str, value: Column, limit: int | float) -> Column:
    return _rule(location, value <= limit, f"Input should be greater than {limit:g}")


def _broken(*rules: Column) -> Column:
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def compare_param_errors(threshold: Column, max_regions: Column) -> Column:
    return _broken(
        _at_least("threshold", threshold, 0),
        _at_most("threshold", threshold, 1),
        _at_least("maxRegions", max_regions, 1),
        _at_most("maxRegions", max_regions, MAX_REGIONS),
    )


def crop_param_errors(
    x: Column,
    y: Column,
    width: Column,
    height: Column,
    max_width: Column,
    max_height: Column,
    quality: Column,
) -> Column:
    return _broken(
        _at_least("box.x", x, 0),
        _rule("box.x", x > 1_000_000, "Input should be less than or equal to 1000000"),
        _at_least("box.y", y, 0),
        _rule("box.y", y > 1_000_000, "Input should be less than or equal to 1000000"),
        _above("box.width", width, 0),
        _rule("box.width", width > 1_000_000, "Input should be less than or equal to 1000000"),
        _above("box.height", height, 0),
        _rule("box.height", height > 1_000_000, "Input should be less than or equal to 1000000"),
        _at_least("maxWidth", max_width, 16),
        _at_most("maxWidth", max_width, 8192),
        _at_least("maxHeight", max_height, 16),
        _at_most("maxHeight", max_height, 8192),
        _at_least("quality", quality, 1),
        _at_most("quality", quality, 100),
    )


def language_param_errors(language: Column) -> Column:
    """A string breaks one rule at most: too short, too long, or the wrong characters."""
    return _broken(
        F.when(
            F.length(language) < 2,
            _rule("language", F.lit(True), "String should have at least 2 characters"),
        )
        .when(
            F.length(language) > 16,
            _rule("language", F.lit(True), "String should have at most 16 characters"),
        )
        .when(
            ~language.rlike(LANGUAGE_PATTERN),
            _rule(
                "language", F.lit(True), "String should match pattern '^[A-Za-z0-9_-]+$'"
            ),
        )
    )


def parsed_reference(reference: Column) -> Column:
    """``struct(kind, path, asset_id)`` of a JSON image reference, null when it is not acceptable.

    Two forms exist: a local path and an opaque asset id. Other kinds, unknown or extra fields,
    values that are no strings, and texts that are no JSON objects are refused.
    """
    value = F.try_parse_json(reference)
    keys = F.map_keys(F.from_json(reference, "map<string,string>"))

    def text(name: str) -> Column:
        field = F.try_variant_get(value, f"$.{name}", "variant")
        return F.when(
            F.schema_of_variant(field) == "STRING",
            F.try_variant_get(value, f"$.{name}", "string"),
        )

    kind = text("kind")
    path = text("path")
    asset_id = F.coalesce(text("assetId"), text("asset_id"))
    key_text = F.array_join(F.array_sort(keys), ",")
    path_ok = (
        (kind == "local_path") & (key_text == "kind,path") & F.length(path).between(1, 4096)
    )
    asset_ok = (
        (kind == "asset")
        & key_text.isin("assetId,kind", "asset_id,kind")
        & asset_id_valid(asset_id)
    )
    return F.when(
        F.coalesce(path_ok, F.lit(False)) | F.coalesce(asset_ok, F.lit(False)),
        F.struct(
            kind.alias("kind"),
            F.when(kind == "local_path", path).alias("path"),
            F.when(kind == "asset", asset_id).alias("asset_id"),
        ),
    )
