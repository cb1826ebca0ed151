"""Click pairs between pages, link edges, top links per page and title lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import requests as rq
from tidemark.operators.ordered import rank_rows


def content_pages(pages: DataFrame) -> DataFrame:
    """Articles that are not redirects."""
    return pages.where((F.col("page_namespace") == 0) & (F.col("page_is_redirect") == 0))


def encoded_pages(pages: DataFrame) -> DataFrame:
    """Content pages with their titles as URLs carry them."""
    return content_pages(pages).select(
        rq.encoded_title("page_title").alias("encoded_page_title"), "page_title", "page_id")


def complete_clicks(clicks: DataFrame) -> DataFrame:
    """Click rows with both pages and a count."""
    return clicks.dropna(subset=["prev", "curr", "n"])


def click_pairs(clicks: DataFrame) -> DataFrame:
    """Clicks per pair of pages."""
    return complete_clicks(clicks).groupBy("curr", "prev").agg(F.sum("n").alias("n"))


def _side(encoded: DataFrame, side: str) -> DataFrame:
    return encoded.select(F.col("encoded_page_title").alias(side),
                          F.col("page_id").alias(f"{side}_id"),
                          F.col("page_title").alias(f"{side}_title"))


def resolve_clicks(pairs: DataFrame, encoded: DataFrame) -> DataFrame:
    """Looks both pages of a pair up; pairs are summed before, so it joins few rows."""
    return (pairs.join(_side(encoded, "curr"), "curr").join(_side(encoded, "prev"), "prev")
            .select("prev_id", "curr_id", "n", "prev_title", "curr_title"))


def top_n_per_group(df: DataFrame, group: Sequence[str], order, n: int,
                    rank: str = "rank") -> DataFrame:
    """First n rows per group in a unique order.

    Up to the limit of the session's window group limit Spark cuts each group to n rows
    before the exchange; for a larger n the rows are ranked in slices. Either way one
    group may hold any share of the rows.
    """
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))
    if n > limit:
        ranked = rank_rows(df, group, order, "_place").where(F.col("_place") <= n)
        return ranked.withColumn(rank, F.col("_place").cast("int")).drop("_place")
    window = W.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_followed(clicks: DataFrame, n: int = 5) -> DataFrame:
    """The n most followed links of each page of a resolved click table."""
    return top_n_per_group(clicks, ["prev_title"], [F.desc("n"), "curr_title"], n).select(
        "prev_title", "curr_title", "n", F.col("rank").cast("int").alias("rank"))


def links_by_rank(top: DataFrame) -> DataFrame:
    """Map from rank to linked title per page."""
    return top.groupBy("prev_title").agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("rank", "curr_title")))).alias("links"))


def widen_links(top: DataFrame, n: int = 5) -> DataFrame:
    """One row per page with columns link1 to linkN, NULL where a rank is missing."""
    return top.groupBy(F.col("prev_title").alias("page")).agg(*[
        F.max(F.when(F.col("rank") == k, F.col("curr_title"))).alias(f"link{k}")
        for k in range(1, n + 1)])


def top_links(clicks: DataFrame, pages: DataFrame, n: int = 5) -> DataFrame:
    """From raw clicks to the wide table of top links.

    Equal to resolving both pages first and ranking then, with less work: only the
    target must be resolved before ranking, and the source is looked up for the at
    most n ranked rows of each page.
    """
    encoded = encoded_pages(pages)
    targets = click_pairs(clicks).join(_side(encoded, "curr"), "curr")
    ranked = top_n_per_group(targets, ["prev"], [F.desc("n"), "curr_title"], n)
    wide = ranked.groupBy("prev").agg(*[
        F.max(F.when(F.col("rank") == k, F.col("curr_title"))).alias(f"link{k}")
        for k in range(1, n + 1)])
    return wide.join(_side(encoded, "prev"), "prev").select(
        F.col("prev_title").alias("page"), *[f"link{k}" for k in range(1, n + 1)])


def table_totals(clicks: DataFrame) -> DataFrame:
    """Rows and clicks of a table."""
    return clicks.agg(F.count(F.lit(1)).alias("pairs"), F.sum("n").alias("clicks"))


def strongest_links(clicks: DataFrame, title: str, k: int) -> DataFrame:
    """The k most followed links of one page."""
    return (clicks.where(F.col("prev_title") == title)
            .orderBy(F.desc("n"), "curr_title").limit(k))


def link_edges(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Page-to-page edges between articles, link targets resolved by title."""
    targets = content_pages(pages).select(
        F.col("page_id").alias("link_id"), F.col("page_title").alias("pl_title"),
        F.col("page_namespace").alias("pl_namespace"))
    sources = links.where((F.col("pl_from_namespace") == 0) & (F.col("pl_namespace") == 0))
    return sources.join(targets, ["pl_title", "pl_namespace"]).select(
        F.col("pl_from").alias("page_id"), "link_id")


def distinct_ids(edges: DataFrame, column: str = "page_id") -> DataFrame:
    """Distinct ids of one column."""
    return edges.select(column).distinct()


def edited_pages(revisions: DataFrame, pages: DataFrame, above: int = 10000,
                 below: int = 12000) -> DataFrame:
    """Distinct (user, article) pairs of users with ids strictly between two bounds."""
    pairs = (revisions.where((F.col("rev_user") > above) & (F.col("rev_user") < below))
             .select(F.col("rev_user").alias("user_id"), F.col("rev_page").alias("page_id"))
             .distinct())
    articles = pages.where(F.col("page_namespace") == 0).select("page_id", "page_title")
    return pairs.join(articles, "page_id").select("user_id", "page_id", "page_title")


def app_page_counts(views: DataFrame, pages: DataFrame, host: str, user: str, page: str) -> DataFrame:
    """Views per (user, page) on one host, with the page resolved after counting."""
    counts = (views.where(F.col("uri_host") == host)
              .groupBy(F.col(user).alias("user_key"), F.col(page).alias("encoded_page_title"))
              .agg(F.count(F.lit(1)).alias("n")))
    return counts.join(encoded_pages(pages), "encoded_page_title").select(
        "user_key", "page_id", "n", "page_title")


def dictionary(df: DataFrame, column: str, name: str = "id") -> DataFrame:
    """Distinct values numbered 1, 2, ... in sort order, for a column of any size.

    Unlike a hash, two values never share a number.
    """
    return rank_rows(df.select(column).where(F.col(column).isNotNull()).distinct(),
                     [], [column], name)


def hashed_id(column: str):
    """64-bit hash as an id that needs no lookup; collisions are possible."""
    return F.xxhash64(column)


def preference_table(df: DataFrame, user: str, item: str, users: DataFrame,
                     items: DataFrame) -> DataFrame:
    """Boolean (user, item) pairs with dictionary ids for both columns."""
    return (df.select(user, item).dropna().distinct()
            .join(users.withColumnRenamed("id", "user_id"), user)
            .join(items.withColumnRenamed("id", "item_id"), item)
            .select("user_id", "item_id"))


def in_links(clicks: DataFrame, titles: DataFrame) -> DataFrame:
    """Click edges by id, target first; rows with a missing part are left out."""
    numbered = titles.select(F.col("title"), F.col("id"))
    return (clicks.dropna(subset=["prev_title", "curr_title", "n"])
            .join(numbered.select(F.col("title").alias("curr_title"), F.col("id").alias("page_id")),
                  "curr_title")
            .join(numbered.select(F.col("title").alias("prev_title"), F.col("id").alias("link_id")),
                  "prev_title")
            .select("page_id", "link_id", "n"))


def with_titles(pairs: DataFrame, pages: DataFrame, first: str = "page_id",
                second: str = "link_id") -> DataFrame:
    """Replaces the two ids of scored pairs by titles."""
    names = pages.select("page_id", "page_title")
    return (pairs
            .join(names.select(F.col("page_id").alias(first), F.col("page_title").alias("page")), first)
            .join(names.select(F.col("page_id").alias(second), F.col("page_title").alias("link")), second)
            .select("page", "link", "score"))


def titles_of(pages: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Titles of a list of ids."""
    return pages.where(F.col("page_id").isin(list(ids))).select("page_id", "page_title")
