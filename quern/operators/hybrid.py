"""Vector, place and words together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import geo, search, vector


def vector_and_place(df: DataFrame, embedding: str, query: Sequence[float], lat: str, lon: str, to_lat: float, to_lon: float, metres: float, limit: int | None = None, threshold: float | None = None, tie: Sequence[str] = (), text: tuple[str, list[str]] | None = None) -> DataFrame:
    """Rows within the radius (and with the words, if given) that are most alike.

    The cheap tests come first; similarity is computed for what they leave.
    Adds ``distance`` and ``similarity`` (and ``score`` with words).
    """
    near = df.where(geo.within_radius(lat, lon, to_lat, to_lon, metres)).withColumn("distance", geo.haversine(lat, lon, to_lat, to_lon))
    if text is not None:
        near = search.scan_search(near, *text)
    out = near.withColumn("similarity", vector.cosine(embedding, query))
    if threshold is not None:
        out = out.where(F.col("similarity") >= threshold)
    out = out.orderBy(F.col("similarity").desc(), F.col("distance").asc(), *tie)
    return out if limit is None else out.limit(limit)
