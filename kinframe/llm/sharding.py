"""Contiguous shards of equal bytes, cut by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import prefix_sums


def shard_by_bytes(docs: DataFrame, shards: int = 16, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard: contiguous in key order, near equal in bytes.

    size is the text's UTF-8 bytes plus 1 (null text: 1, crc32 of nothing: 0). A row belongs to the shard in
    which the middle of its bytes falls, so no cut is off its target by more than half a row; a row larger than
    a whole target can leave a shard empty. Copies are ordinary rows. Null keys come first, repeated keys each
    keep their row, other columns are ignored, an empty table gives an empty result. slot counts the shard's
    rows from 0.
    """
    rows = docs.select(
        F.col(key).cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    rows = prefix_sums(rows, ["doc_id", "text_crc32", "size"], {"start": F.col("size"), "place": F.lit(1)}, "shards")
    # (2 start + size) / 2 is the row's middle; long arithmetic holds up to 2^63 / (4 shards) bytes
    shard = F.least(F.lit(shards - 1), F.expr(f"((2 * start + size) * {int(shards)}L) div (2 * _total_start)")).cast("int")
    rows = rows.withColumn("shard", shard)
    first = rows.groupBy("shard").agg(F.min("place").alias("first"))  # one row a shard
    out = rows.join(F.broadcast(first), "shard")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "start"
    )


#: The same into 16 shards in DuckDB's SQL, CRC-32 included (its table by rule, a step a byte).
ORACLE_SQL = """
WITH crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(CAST(3988292384 AS BIGINT), c >> 1) ELSE c >> 1 END, CAST(i AS BIGINT))) AS t),
b AS (SELECT doc_id, CAST(octet_length(encode(coalesce(text, ''))) + 1 AS BIGINT) AS size, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM documents),
d AS (SELECT doc_id, size, CASE WHEN len(bytes) = 0 THEN CAST(0 AS BIGINT) ELSE xor(CAST(4294967295 AS BIGINT), list_reduce(bytes, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT))) END AS text_crc32 FROM b, crc),
p AS (SELECT *, CAST(coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, CAST(sum(size) OVER () AS BIGINT) AS total FROM d),
s AS (SELECT *, CAST(least(15, (2 * start + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY start, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard, start FROM s
"""
