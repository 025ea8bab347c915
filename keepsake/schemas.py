"""The record contract: enums, field limits and table shapes."""

from __future__ import annotations

# Every tuple and limit below must equal the published contract.
ITEM_TYPES = ("newspaper_clipping", "photograph", "document", "letter", "certificate",
              "program", "newsletter", "ephemera", "object", "other")
PRESENTATIONS = ("image", "text", "both")
DATE_PRECISIONS = ("day", "month", "year", "decade", "unknown")
DATE_SOURCES = ("printed", "inferred", "unknown")
ORIENTATIONS = ("upright", "rotate_90_cw", "rotate_90_ccw", "rotate_180")
MEDIA = ("newsprint", "glossy_print", "photographic_print", "typescript",
         "manuscript", "card_stock", "other")
TEXT_LIMITS = {"title": 300, "summary": 4000, "alt_text": 600, "visual_description": 4000,
               "review_reason": 600, "date_note": 1000, "condition_notes": 1000,
               "club_context": 2000}
ENTITY_KINDS = {"people": "person", "organizations": "organization",
                "places": "place", "topics": "topic"}
KIND_WEIGHTS = {"person": 5, "organization": 3, "place": 2, "topic": 1}
EDITABLE_FIELDS = ("item_type", "title", "summary", "full_text", "date_value",
                   "date_precision", "date_source", "presentation", "condition_notes",
                   "alt_text", "visual_description", "club_context")
PHOTO_SUFFIXES = (".heic", ".heif", ".jpg", ".jpeg", ".png", ".tif", ".tiff", ".webp")
KEPT_TAGS = ("Make", "Model", "LensModel", "DateTimeOriginal", "DateTimeDigitized", "DateTime",
             "Orientation", "ExifImageWidth", "ExifImageHeight", "FNumber", "ExposureTime",
             "ISOSpeedRatings", "FocalLength")
UNPUBLISHABLE = ("rejected", "detected", "rectified")
DECIDED = ("approved", "rejected")
ALWAYS_EXCLUDED = (".DS_Store", "Thumbs.db", ".git", "archive.db", "archive.db-wal", "archive.db-shm")
MEDIA_TYPES = {".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png",
               ".webp": "image/webp", ".gif": "image/gif", ".tif": "image/tiff",
               ".tiff": "image/tiff", ".heic": "image/heic", ".heif": "image/heif"}
LOW_RESOLUTION_MP = 4.0
MONTHS = ("January", "February", "March", "April", "May", "June", "July",
          "August", "September", "October", "November", "December")

# The wording of warnings about a record, in order.
WARNINGS = {
    "legibility": "low legibility",
    "confidence": "low model confidence (%.2f)",
    "inferred": "date inferred rather than printed",
    "orientation": "may need rotating (%s)",
    "untranscribed": "marked as text but no transcription returned",
    "unprinted": "date claimed as printed but nothing was transcribed",
    "unfindable": "nothing describing the picture, so it cannot be found",
    "untitled": "no title",
}

# The wording of notes about a detected item.
NOTES = {
    "unmatched": "no paper found under this box - the item is real but the crop may be pointing at the wrong part of the photo",
    "clipped": "runs off the edge of the photograph - reshoot to capture all of it",
    "collision": "this crop sits almost entirely inside another item's crop - one of the two is on the wrong piece of paper",
    "link": "model says this %s but is only %.0f%% sure",
    "part_of": "belongs with another item",
    "duplicate_of": "is a duplicate, so would not be published",
    "related_to": "is linked to another item",
    "confidence": "detection confidence %.2f below %.2f",
    "photo": "low-confidence detection",
    "split": "items were touching, so %d rough crops were split out - check and adjust each one",
    "none": "no items detected; using whole frame",
    "single": "single item filling the frame",
}

# The wording of hints given with an item.
HINTS = {
    "task": "Catalogue this item.",
    "captured": "(The photograph of this item was taken on %s. That is when it was digitised, not when the item itself "
                "is from - do not use it as the item's date.)",
    "neighbours": "(It was photographed alongside %s other item%s, so related material may exist.)",
}
