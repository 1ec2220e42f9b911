"""Image and mask files paired by their stems, one decision per examination folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names of examination folders, endings of volume files, references in the order of the pairs.
EXAM = r"(?i)^(VS_\d{4})_\d{2}$"
ENDING = r"(?i)\.nii(\.gz)?$"
REFERENCES = ("t1postiac", "t1post")


def volume_files(paths: DataFrame, column: str = "path") -> DataFrame:
    """(folder, exam, stem, path) of volume files inside an examination folder; stems are lower-cased, without ending."""
    parts = F.split(column, "/")
    name, folder = F.element_at(parts, -1), F.try_element_at(parts, F.lit(-2))
    rows = paths.select(F.col(column).alias("path"), folder.alias("__exam"), F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("folder"), name.alias("__name"))
    found = rows.where(F.rlike("__exam", F.lit(EXAM)) & F.rlike("__name", F.lit(ENDING)))
    return found.select("folder", F.upper("__exam").alias("exam"), F.lower(F.regexp_replace("__name", ENDING, "")).alias("stem"), "path")


def pair_stems(paths: DataFrame, column: str = "path", references: tuple[str, ...] = REFERENCES) -> DataFrame:
    """(exam, folder, pairs, status, entity_id, reference, image_path, mask_path): one row per examination folder with files.

    A mask <exam>_seg_<reference> belongs to the image <exam>_<reference> of the same folder. One pair resolves the folder;
    with none or several its status is ambiguous and the paths are null. Of files with one stem the last path in order
    counts. All folders are decided in one aggregation.
    """
    files = volume_files(paths, column)
    exam = F.lower("exam")
    one = lambda stem: F.max(F.when(F.col("stem") == stem, F.col("path")))
    wanted = [c.alias(f"{kind}_{r}") for r in references for kind, c in (("image", one(F.concat(exam, F.lit(f"_{r}")))), ("mask", one(F.concat(exam, F.lit(f"_seg_{r}")))))]
    per = files.groupBy("exam", "folder").agg(*wanted)
    both: list[Column] = [F.when(F.col(f"image_{r}").isNotNull() & F.col(f"mask_{r}").isNotNull(), F.struct(F.lit(r).alias("reference"), F.col(f"image_{r}").alias("image"), F.col(f"mask_{r}").alias("mask"))) for r in references]
    pairs = per.select("exam", "folder", F.array_compact(F.array(*both)).alias("p"))
    first = F.when(F.size("p") == 1, F.get("p", 0))
    return pairs.select("exam", "folder", F.size("p").alias("pairs"), F.when(F.size("p") == 1, "resolved").otherwise("ambiguous").alias("status"), F.upper(F.regexp_extract("exam", EXAM, 1)).alias("entity_id"), first["reference"].alias("reference"), first["image"].alias("image_path"), first["mask"].alias("mask_path"))
