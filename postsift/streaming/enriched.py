"""Detail pages joined with cards as two streams.

Cards and raw detail bodies land in streams of their own, in any order. A card waits for its
detail page for a while of event time; state behind the watermarks of both sides is let go,
so what a query keeps grows with the rate of landing and not with history. A card whose page
does not come in time goes on as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.operators.enrich import merged_columns
from postsift.session import ship_package
from postsift.sources.boards import extract_details


def enriched_cards(cards: DataFrame, bodies: DataFrame, wait: str = "30 minutes", late: str = "10 minutes",
                   landed_at: str = "landed_at") -> DataFrame:
    """Every card once, merged with the detail page that landed within ``wait`` of it.

    ``cards`` are listings, ``bodies`` pages ``(id, body)``; both carry ``landed_at``, and
    rows later than ``late`` behind it are dropped. Of several pages of a listing the first
    to arrive counts, and of several cards of one id and landing time each is merged.
    """
    ship_package(cards.sparkSession)
    left = cards.withWatermark(landed_at, late)
    stamped = bodies.select("id", "body", F.col(landed_at).alias("page_at")).withWatermark("page_at", late)
    first = stamped.dropDuplicatesWithinWatermark(["id"])
    page_columns = ["detail_criteria", "detail_description", "detail_applicants", "detail_logo_url"]
    pages = extract_details(first, keep=["page_at"]).select(F.col("id").alias("page_id"), "page_at", *page_columns)
    gap = F.expr(f"INTERVAL {wait}")
    met = left.join(pages, (F.col("id") == F.col("page_id"))
                    & (F.col("page_at") >= F.col(landed_at) - gap)
                    & (F.col("page_at") <= F.col(landed_at) + gap), "left_outer")
    found = met.withColumn("detail_found", F.col("page_id").isNotNull())
    return found.withColumns(merged_columns("detail_found")).select(*cards.columns, "detail_found")
