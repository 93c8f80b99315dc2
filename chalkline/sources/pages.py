"""Features of crawled pages: links, URL parts, header fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINK = '<a href="([^"]*)">([^<]*)</a>'


def links(pages: DataFrame) -> DataFrame:
    """page_id, href, title of every anchor."""
    pair = F.arrays_zip(F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("href"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("title"))
    return pages.select("page_id", F.explode(pair).alias("l")).select("page_id", "l.href", "l.title")


def with_hint(found: DataFrame, hints: Sequence[str]) -> DataFrame:
    """Links whose title or address holds a hint word."""
    return found.where(F.lower(F.concat_ws(" ", "title", "href")).rlike("|".join(hints)))


def unique_links(pages: DataFrame) -> DataFrame:
    """href with the first page that has it and how often it stands anywhere."""
    return links(pages).where("href <> ''").groupBy("href").agg(F.min("page_id").alias("page_id"), F.count("*").alias("n"))


def url_features(pages: DataFrame, languages: Sequence[str] = ("en", "fr", "de", "es")) -> DataFrame:
    """host, language (a leading path part), slug (last path part) and a file name made of it."""
    path = F.regexp_extract("url", r"^[a-z]+://[^/?#]+([^?#]*)", 1)
    out = pages.withColumn("_path", path).withColumn("slug", F.regexp_extract(F.rtrim(F.col("_path"), F.lit("/")), "([^/]*)$", 1))
    language = F.regexp_extract("_path", "^/(" + "|".join(languages) + ")(?:/|$)", 1)
    name = F.btrim(F.regexp_replace("slug", "[^A-Za-z0-9._-]+", "_"), F.lit("_"))
    return out.select("*", F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"), F.nullif(language, F.lit("")).alias("language"), name.alias("file_name")).drop("_path")


def header_fields(pages: DataFrame) -> DataFrame:
    """page_id, topic (heading, else title, else untitled), number from the path and page from the query."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    topic = F.coalesce(filled(F.regexp_extract("html", "<h1>([^<]*)</h1>", 1)), filled(F.regexp_extract("html", "<title>([^<]*)</title>", 1)), F.lit("untitled"))
    number = F.nullif(F.regexp_extract("url", "/([0-9]+)(?:[/?#]|$)", 1), F.lit(""))
    page = F.coalesce(F.nullif(F.regexp_extract("url", "[?&]page=([0-9]+)", 1), F.lit("")), F.lit("1"))
    return pages.select("page_id", topic.alias("topic"), number.alias("number"), page.alias("page"))
