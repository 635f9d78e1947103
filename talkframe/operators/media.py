"""Media plans: H11 (equal split ranges, last takes the rest), H12 (part names), A13 (download
manifest). Audio bytes are not decoded here; the plan rows drive the transcription hook."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import part_file_name, path_ext, path_stem, safe_dir_name


def segment_plan(media: DataFrame, n_splits: int, key: str = "media_id",
                 length: str = "length_ms", path: str = "path") -> DataFrame:
    """(key, part, start_ms, end_ms, part_path): part i covers [i*L div n, (i+1)*L div n),
    except the last, which ends at L."""
    n = F.lit(n_splits)
    step = F.floor(F.col(length) / n)
    # the file name is split once per file, before the parts are generated
    m = media.select(key, length, path_stem(F.col(path)).alias("_stem"),
                     path_ext(F.col(path)).alias("_ext"))
    x = m.select(key, length, "_stem", "_ext",
                 F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))).alias("i"))
    return x.select(
        key, (F.col("i") + 1).cast("bigint").alias("part"),
        (F.col("i") * step).cast("bigint").alias("start_ms"),
        F.when(F.col("i") < n - 1, (F.col("i") + 1) * step).otherwise(F.col(length))
         .cast("bigint").alias("end_ms"),
        part_file_name(None, F.col("i") + 1, "_stem", "_ext").alias("part_path"))


def download_manifest(episodes: DataFrame, key: str, podcast_name: str,
                      root: str = "./audio") -> DataFrame:
    """Target file of the episode's audio: '{root}/{safe name}/episode_0.mp3'.

    The reference never checks a download, so the manifest starts as 'planned'."""
    return episodes.select(
        key, F.concat_ws("/", F.lit(root), safe_dir_name(F.col(podcast_name)),
                         F.lit("episode_0.mp3")).alias("path"),
        F.lit("planned").alias("status"))
