"""The whole flow as a chain of lazy DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.config import ScanConfig
from kinframe.operators import clips as CL
from kinframe.operators import filters, grouping, pairs, ranking, results


class MediaEngine:
    """catalog -> validate -> candidates -> match -> group -> annotate -> report; every step is a temp view too.

    The catalog has id, path, folder, size, duration_s, width, height, lo, hi, frame, file_id, is_image and what
    validity needs (flags, on_disk), and fp if clips are looked for; ids are given in path order by the caller, and pairs are resolved in that order.
    """

    def __init__(self, spark: SparkSession, config: ScanConfig | None = None, side: int = 8):
        self.spark, self.config, self.side = spark, (config or ScanConfig(whole_catalog=True)).validate(), side

    def _view(self, name: str, df: DataFrame) -> DataFrame:
        df.createOrReplaceTempView(f"media_{name}")
        return df

    def validate(self, catalog: DataFrame) -> DataFrame:
        rows = catalog if "flags" in catalog.columns else catalog.withColumns({"flags": F.lit(0), "on_disk": F.lit(True)})
        rows = rows if "file_size" in rows.columns else rows.withColumn("file_size", F.col("size"))
        rows = filters.with_reason(rows, self.config).where("reason is null").drop("reason")
        return self._view("valid", grouping.kept(rows))  # features are made once

    def candidates(self, valid: DataFrame) -> DataFrame:
        return self._view("candidates", pairs.candidates(valid, self.config))

    def match(self, valid: DataFrame) -> DataFrame:
        found = pairs.all_matches(valid, self.config, self.side)
        return self._view("matches", found.select(F.col("a.id").alias("a_id"), F.col("b.id").alias("b_id"), "difference", "flipped"))

    def group(self, valid: DataFrame) -> DataFrame:
        c = self.config
        return self._view("groups", grouping.duplicate_groups(valid, self.match(valid), c))

    def run(self, catalog: DataFrame, frames: DataFrame | None = None) -> DataFrame:
        """Grouped items with their attributes, similarity and best flags.

        With partial_clips, videos that are in no group and have a fingerprint (fp) go through clips(), and what is
        found is added: is_clip tells clips, offset_s where they start.
        """
        valid = self.validate(catalog)
        groups = self.group(valid)
        found = groups.withColumns({"similarity": (1 - F.col("difference")) * 100, "is_clip": F.lit(False), "offset_s": F.lit(0)})
        if self.config.partial_clips and "fp" in valid.columns:
            more = self.clips(valid, groups, frames)
            more = more.withColumns({"difference": 1 - F.col("similarity") / 100, "flipped": F.lit(False)})
            found = found.unionByName(more.select(found.columns))
        found = found.join(valid.drop("lo", "hi", "frame", "fp", "frames", "hashes", "flipped_hashes"), "id")
        for c in ("fps", "bitrate_kbps", "audio_kbps", "audio_rate", "hdr_rank"):
            found = found if c in found.columns else found.withColumn(c, F.lit(0))
        found = found if "frame_size" in found.columns else found.withColumn("frame_size", F.col("width") + F.col("height"))
        return self._view("items", ranking.best_flags(found))

    def clips(self, videos: DataFrame, grouped: DataFrame | None = None, frames: DataFrame | None = None) -> DataFrame:
        """Clips and their sources among the eligible videos; with clip_visual_gate, ``frames`` (see CL.frame_similarities) decide too."""
        c = self.config
        rows = CL.eligible(videos, grouped)
        assigned = CL.assign_clips(CL.clip_matches(CL.by_duration(rows), c.clip_min_ratio, c.clip_similarity))
        if c.clip_visual_gate:
            if frames is None:
                raise ValueError("clip_visual_gate needs frames")
            assigned = CL.visual_gate(assigned, CL.frame_similarities(assigned, rows, frames, c.use_phash), c.clip_visual_similarity)
        return self._view("clips", CL.clip_items(assigned))

    def report(self, items: DataFrame) -> DataFrame:
        return results.group_stats(items)
