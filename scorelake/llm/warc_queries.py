"""op4: pages through archives: written as one stream, normalised, read back by offset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.warc import normalise, qualified, read_records, with_revisits, write_archives
from scorelake.sources.workspace import new_folder

MIN_BYTES = 0


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, new_folder(spark, "warc"))
    pages = with_revisits(spark.read.parquet(f"{sf_dir}/pages.parquet"), MIN_BYTES)
    index = normalise(write_archives(pages, folder), folder)
    return read_records(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = {
    "op4_warc": f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), h AS (
  SELECT page_id, html, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first_id FROM p
), r AS (
  SELECT *, payload_bytes >= {MIN_BYTES} AND page_id IS DISTINCT FROM first_id AND first_id IS NOT NULL AS again FROM h
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM r"""
}
QUERIES = {"op4_warc": op4_warc}
