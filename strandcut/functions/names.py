"""File names and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed formats and patterns.
SLICE_NAME_FORMAT = "word_seg_%04d_type_%02d"
SLICE_NAME_PATTERN = r"^.*word.*_([0-9]+)_.*_([0-9]+)"


def slice_name(idx: Column, label: Column, ext: str = ".png") -> Column:
    return F.concat(F.format_string(SLICE_NAME_FORMAT, idx, label), F.lit(ext))


def parse_number_pair(name: Column, pattern: str = SLICE_NAME_PATTERN) -> dict[str, Column]:
    """The index and the type carried by a slice file name; null on no match."""
    hit = name.rlike(pattern)
    return {
        "idx": F.when(hit, F.regexp_extract(name, pattern, 1).cast("bigint")),
        "image_type": F.when(hit, F.regexp_extract(name, pattern, 2).cast("int")),
    }


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _local(path: Column) -> Column:
    """A path without scheme, host, and repeated or last slashes."""
    bare = F.regexp_replace(path, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    return F.regexp_replace(F.regexp_replace(bare, "/+", "/"), "/$", "")


def dir_below(path: Column, root: str, *, encoded: bool = False) -> Column:
    """The folder of a file as a path relative to ``root``, empty for the root itself.

    A path elsewhere (as where ``root`` is a pattern) gives its whole folder.
    ``encoded`` tells that the path, not the root, is written as a URI.
    """
    if encoded:
        path = F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
    folder, top = F.regexp_replace(_local(path), "/[^/]*$", ""), _local(F.lit(root))
    below = F.concat(folder, F.lit("/")).startswith(F.concat(top, F.lit("/")))
    return F.when(below, F.substr(folder, F.length(top) + 2)).otherwise(folder)


def split_ext(name: Column) -> dict[str, Column]:
    """Stem and extension; the extension keeps its dot and may be empty."""
    ext = F.regexp_extract(name, r"^\.*[^.].*(\.[^.]*)$", 1)
    return {"stem": F.left(name, F.length(name) - F.length(ext)), "ext": ext}


def overlay_name(path: Column) -> Column:
    return F.replace(path, F.lit(".png"), F.lit("_infer.png"))
