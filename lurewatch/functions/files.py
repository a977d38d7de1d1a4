"""Attachment names: extensions and flags."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from lurewatch.functions.arrays import derive, string_array
from lurewatch.rules.fixed import FLAGGED_EXTENSIONS


def file_facts(files: Column) -> Column:
    """Extension facts for an array of `struct<filename, content_type, size_bytes, sha256>`."""
    files = derive(files, lambda a: {"_labels": F.split(F.lower(a["filename"]), "[.]")})
    files = derive(
        files,
        lambda a: {
            "extension": F.when(
                F.size(a["_labels"]) > 1, F.concat(F.lit("."), F.element_at(a["_labels"], -1))
            ).otherwise(""),
            # from two dots on, every label after the first counts
            "detected_extensions": F.when(
                F.size(a["_labels"]) > 2,
                F.transform(
                    F.slice(a["_labels"], F.lit(2), F.size(a["_labels"])),
                    lambda x: F.concat(F.lit("."), x),
                ),
            ).otherwise(string_array([])),
        },
    )
    flagged = string_array(FLAGGED_EXTENSIONS)

    def facts(a: Column) -> Column:
        return F.struct(
            a["filename"].alias("filename"),
            a["content_type"].alias("content_type"),
            a["size_bytes"].alias("size_bytes"),
            a["sha256"].alias("sha256"),
            a["extension"].alias("extension"),
            a["detected_extensions"].alias("detected_extensions"),
            (F.size(a["detected_extensions"]) > 1).alias("has_double_extension"),
            (
                F.array_contains(flagged, a["extension"])
                | F.arrays_overlap(flagged, a["detected_extensions"])
            ).alias("is_suspicious_type"),
        )

    return F.transform(files, facts)
