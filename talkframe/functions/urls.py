"""URL and name expressions: H3 (episode URL), H13 (safe directory name), H12 (part names)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def url_path(url) -> Column:
    """Path of a URL (NULL when it cannot be parsed)."""
    return F.try_parse_url(_c(url), F.lit("PATH"))


def episode_from_url(url) -> tuple[Column, Column]:
    """H3: (podcast id, episode title) = (last path segment minus its first two characters,
    the segment before it with '-' as space). A path without two segments gives NULL title."""
    parts = F.split(url_path(url), "/")
    podcast_id = F.substring(F.try_element_at(parts, F.lit(-1)), 3, 1 << 30)
    title = F.replace(F.try_element_at(parts, F.lit(-2)), F.lit("-"), F.lit(" "))
    return podcast_id, title


def safe_dir_name(name) -> Column:
    """Spaces to '_', ':' to '-', dots removed."""
    c = F.replace(_c(name), F.lit(" "), F.lit("_"))
    c = F.replace(c, F.lit(":"), F.lit("-"))
    return F.replace(c, F.lit("."), F.lit(""))


# Fixed value: path = stem + extension, the extension being the last '.x' of the file name.
PATH_SPLIT = r"^(.*?)(\.[^./]*)?$"


def path_stem(path) -> Column:
    return F.regexp_extract(_c(path), PATH_SPLIT, 1)


def path_ext(path) -> Column:
    return F.regexp_extract(_c(path), PATH_SPLIT, 2)


def part_file_name(path, part_index, stem=None, ext=None) -> Column:
    """H12: '{dir}/{base}_part_{i}{ext}' for a 1-based part index. ``stem``/``ext`` may be
    given as columns computed once per file instead of once per part."""
    stem = path_stem(path) if stem is None else _c(stem)
    ext = path_ext(path) if ext is None else _c(ext)
    return F.concat(stem, F.lit("_part_"), _c(part_index).cast("string"), ext)
