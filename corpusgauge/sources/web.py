"""Website sources: URL policy, origins, sitemaps. No network is used here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir

PRIVATE = r"^(?:10\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(authority(url), r"^.*@", ""), r":[0-9]*$", ""))


def port(url: Column) -> Column:
    written = F.regexp_extract(authority(url), r":([0-9]+)$", 1)
    return F.when(written != "", written).when(scheme(url) == "https", "443").when(scheme(url) == "http", "80").otherwise("")


def origin(url: Column) -> Column:
    """scheme://host:port with the default port written out; '' where there is none."""
    return F.when(host(url) == "", "").otherwise(F.concat(scheme(url), F.lit("://"), host(url), F.lit(":"), port(url)))


def allowed(url: Column) -> Column:
    """HTTPS (HTTP only to this machine), a public host, no user data, no fragment."""
    loopback = (host(url) == "localhost") | host(url).rlike(r"^127\.")
    return scheme(url).isin("http", "https") & (host(url) != "") & ~authority(url).contains("@") & ~url.contains("#") & (loopback | ((scheme(url) == "https") & ~host(url).rlike(PRIVATE)))


def same_origin(a: Column, b: Column) -> Column:
    return (origin(a) == origin(b)) & ~authority(a).contains("@") & ~a.contains("#")


def identity(kind: Column, path: Column, url: Column) -> Column:
    """One spelling of a source: a path without trailing slash, or an origin with its path."""
    return F.when(kind == "filesystem", F.regexp_replace(F.coalesce(path, F.lit("")), "(?<=.)/+$", "")).otherwise(F.concat(origin(url), F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"^[^:]+://[^/?#]*", ""), "/+$", "")))


def locations(xml: Column) -> Column:
    """The URLs of a sitemap in order."""
    return F.regexp_extract_all(xml, F.lit(r"<loc>[ \t\r\n]*([^<]*?)[ \t\r\n]*</loc>"), F.lit(1))


def sitemap_urls(sitemaps: DataFrame, base: str = "base_url", xml: str = "xml", limit: int | None = None) -> DataFrame:
    """(base_url, url, place): same-origin URLs of each sitemap in order, each once."""
    each = sitemaps.select(F.col(base).alias("base_url"), F.posexplode(locations(F.col(xml))).alias("place", "url"))
    kept = _once(each)
    return kept if limit is None else kept.where(F.col("place") < limit)


def sitemap_entry_urls(entries: DataFrame) -> DataFrame:
    """``sitemap_urls`` of a sitemap that comes as one row an entry: (base_url, xml, place)."""
    return _once(entries.select("base_url", F.explode(locations(F.col("xml"))).alias("url"), "place"))


def _once(each: DataFrame) -> DataFrame:
    return each.where(same_origin(F.col("url"), F.col("base_url"))).groupBy("base_url", "url").agg(F.min("place").cast("bigint").alias("place"))


def places(rows: DataFrame, group: str, order: str) -> DataFrame:
    """``rows`` with the place (from 0) of each in its group.

    Ranges of (group, order) are numbered by themselves and shifted by the sizes of the ranges
    before them, one number a range, so no group meets in one task. The ranges are
    checkpointed: the sizes and the rows must come of one cut.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    cut = rows.repartitionByRange(group, order).sortWithinPartitions(group, order).withColumn("_at", F.monotonically_increasing_id()).checkpoint()
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before, shifts = 0, []
    for p, n in sorted(cut.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        shifts.append((p, before))
        before += n
    ranges = spark.createDataFrame(shifts, "_p bigint, _before bigint")
    numbered = cut.withColumn("_p", part).join(F.broadcast(ranges), "_p").withColumn("_n", F.col("_before") + inside)
    firsts = numbered.groupBy(group).agg(F.min("_n").alias("_first"))
    return numbered.join(firsts, group).withColumn("place", F.col("_n") - F.col("_first")).drop("_at", "_p", "_before", "_n", "_first")
