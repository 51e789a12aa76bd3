"""Photo lists and photo names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MAX_PHOTOS = 8
# Endings of photo names, and where the stored id stands in an upload URL.
PHOTO, THUMBNAIL = ".webp", "-thumb.webp"
UPLOAD_ID = r"(?i)/upload/(?:v\d+/)?(.+)\.[a-z0-9]+$"
EXTENSION = r"(?i)\.[a-z0-9]+$"


def thumb_url(src: Column) -> Column:
    return F.regexp_replace(src, PHOTO.replace(".", r"\.") + "$", THUMBNAIL)


def first_photos(images: Column) -> Column:
    return F.slice(F.coalesce(images, F.array().cast("array<string>")), 1, MAX_PHOTOS)


def image_fields(images: Column) -> dict[str, Column]:
    """Cover, alternate view and number of photos."""
    return {
        "cover": F.get(images, F.lit(0)),
        "alternate": F.get(images, F.lit(1)),
        "n_images": F.coalesce(F.size(images), F.lit(0)),
    }


def public_id(url: Column) -> Column:
    """Stored id inside an upload URL (version and extension left out), NULL if there is none."""
    return F.nullif(F.regexp_extract(url, UPLOAD_ID, 1), F.lit(""))


def object_key(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def key_public_id(key: Column, folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), F.regexp_replace(key, EXTENSION, ""))
