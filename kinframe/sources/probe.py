"""Media probe output (JSON) to stream columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kinframe.functions import kernels as K

PROBE_SCHEMA = (
    "streams array<struct<index:int,codec_name:string,codec_long_name:string,codec_type:string,pix_fmt:string,width:int,height:int,sample_rate:string,"
    "channel_layout:string,bit_rate:string,r_frame_rate:string,channels:int,color_transfer:string,side_data_list:array<struct<side_data_type:string>>>>,"
    "format struct<duration:string,bit_rate:string>"
)


def frame_rate(text: Column) -> Column:
    """a/b as a number; 0 where it isn't one."""
    a, b = F.split(text, "/")[0].try_cast("double"), F.get(F.split(text, "/"), F.lit(1)).try_cast("double")
    return F.coalesce(F.when(F.coalesce(b, F.lit(1.0)) == 0, 0.0).otherwise(a / F.coalesce(b, F.lit(1.0))), F.lit(0.0)).cast("float")


def media_info(json: Column) -> Column:
    """struct(streams, duration_s): whole seconds; a first stream without bit rate takes the container's; broken JSON gives nulls."""
    p = F.from_json(json, PROBE_SCHEMA)
    seconds = F.floor(p["format"]["duration"].try_cast("double"))
    whole = p["format"]["bit_rate"].try_cast("long")

    def stream(s: Column, i: Column) -> Column:
        side = F.array_join(F.transform(s["side_data_list"], lambda d: d["side_data_type"]), "|")
        rate = F.coalesce(s["bit_rate"].try_cast("long"), F.when(i == 0, whole), F.lit(0).cast("long"))
        return F.struct(
            s["index"].alias("index"), s["codec_name"].alias("codec_name"), s["codec_long_name"].alias("codec_long_name"), s["codec_type"].alias("codec_type"), s["pix_fmt"].alias("pixel_format"),
            F.coalesce(s["width"], F.lit(0)).alias("width"), F.coalesce(s["height"], F.lit(0)).alias("height"), F.coalesce(s["sample_rate"].try_cast("int"), F.lit(0)).alias("sample_rate"),
            s["channel_layout"].alias("channel_layout"), rate.alias("bit_rate"), frame_rate(s["r_frame_rate"]).alias("frame_rate"), F.coalesce(s["channels"], F.lit(0)).alias("channels"),
            K.hdr_format(s["color_transfer"], side).alias("hdr_format"),
        )

    return F.struct(F.transform(p["streams"], stream).alias("streams"), seconds.cast("double").alias("duration_s"))
