"""Checked queries: click pairs, link edges, similarity and recommendations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import links, similarity
from tidemark.plans.views import table, view, with_views
from tidemark.plans.web_queries import tidied
from tidemark.session import scratch_path, written
from tidemark.sources import tables

QUERIES = {}
CHECKS = {}


def checked(name, sql=None, views=("clicks", "page_dim")):
    def register(query):
        QUERIES[name] = query
        if sql is not None:
            CHECKS[name] = with_views(sql, *views)
        return query
    return register


RESOLVED = """
content AS (SELECT * FROM page_dim WHERE page_namespace = 0 AND page_is_redirect = 0),
pairs AS (SELECT curr, prev, CAST(sum(n) AS BIGINT) AS n FROM clicks
  WHERE prev IS NOT NULL AND curr IS NOT NULL AND n IS NOT NULL GROUP BY curr, prev),
resolved AS (SELECT p.page_id AS prev_id, c.page_id AS curr_id, n, p.page_title AS prev_title,
  c.page_title AS curr_title FROM pairs JOIN content p ON prev = p.page_title
  JOIN content c ON curr = c.page_title)
"""
RANKED = f"""
{RESOLVED},
ranked AS (SELECT *, row_number() OVER (PARTITION BY prev_title ORDER BY n DESC, curr_title) AS rank
  FROM resolved),
top5 AS (SELECT * FROM ranked WHERE rank <= 5)
"""
WIDE = """
SELECT prev_title AS page, max(curr_title) FILTER (rank = 1) AS link1,
  max(curr_title) FILTER (rank = 2) AS link2, max(curr_title) FILTER (rank = 3) AS link3,
  max(curr_title) FILTER (rank = 4) AS link4, max(curr_title) FILTER (rank = 5) AS link5
FROM top5 GROUP BY prev_title
"""


def resolved(spark, folder):
    return links.resolve_clicks(links.click_pairs(view(spark, folder, "clicks")),
                                links.encoded_pages(view(spark, folder, "page_dim")))


@checked("encoded_pages", """
SELECT url_encode(page_title) AS encoded_page_title, page_title, page_id FROM page_dim
WHERE page_namespace = 0 AND page_is_redirect = 0""", ("page_dim",))
def encoded_pages(spark, folder):
    return links.encoded_pages(view(spark, folder, "page_dim"))


@checked("click_pairs", """
SELECT curr, prev, CAST(sum(n) AS BIGINT) AS n FROM clicks
WHERE prev IS NOT NULL AND curr IS NOT NULL AND n IS NOT NULL GROUP BY curr, prev""", ("clicks",))
def click_pairs(spark, folder):
    return links.click_pairs(view(spark, folder, "clicks"))


@checked("resolved_clicks", f"WITH {RESOLVED} SELECT * FROM resolved")
def resolved_clicks(spark, folder):
    return resolved(spark, folder)


@checked("click_totals", f"""
WITH {RESOLVED} SELECT count(*) AS pairs, CAST(sum(n) AS BIGINT) AS clicks FROM resolved""")
def click_totals(spark, folder):
    return links.table_totals(resolved(spark, folder))


@checked("strongest_links", f"""
WITH {RESOLVED} SELECT * FROM resolved WHERE prev_title = 'Page_11' ORDER BY n DESC, curr_title LIMIT 100""")
def strongest_links(spark, folder):
    return links.strongest_links(resolved(spark, folder), "Page_11", 100)


@checked("top_followed_links", f"""
WITH {RANKED} SELECT prev_title, curr_title, n, CAST(rank AS INT) AS rank FROM top5""")
def top_followed_links(spark, folder):
    return links.top_followed(resolved(spark, folder))


@checked("top_followed_links_wide", f"WITH {RANKED} {WIDE}")
def top_followed_links_wide(spark, folder):
    return links.top_links(view(spark, folder, "clicks"), view(spark, folder, "page_dim"))


@checked("links_of_page", f"WITH {RANKED}, wide AS ({WIDE}) SELECT * FROM wide WHERE page = 'Page_11'")
def links_of_page(spark, folder):
    return links.widen_links(links.top_followed(resolved(spark, folder))).where("page = 'Page_11'")


@checked("links_by_rank", f"""
WITH {RANKED} SELECT prev_title, max(curr_title) FILTER (rank = 1) AS first_link,
  max(curr_title) FILTER (rank = 5) AS fifth_link, count(*) AS ranks FROM top5 GROUP BY prev_title""")
def links_by_rank(spark, folder):
    by_rank = links.links_by_rank(links.top_followed(resolved(spark, folder)))
    return by_rank.select(
        "prev_title", F.try_element_at("links", F.lit(1)).alias("first_link"),
        F.try_element_at("links", F.lit(5)).alias("fifth_link"),
        F.size("links").cast("long").alias("ranks"))


EDGES = """
edges AS (SELECT pl_from AS page_id, p.page_id AS link_id FROM links
  JOIN page_dim p ON pl_title = p.page_title AND pl_namespace = p.page_namespace
  WHERE p.page_namespace = 0 AND pl_from_namespace = 0 AND pl_namespace = 0 AND page_is_redirect = 0)
"""


def edges(spark, folder):
    return links.link_edges(view(spark, folder, "links"), view(spark, folder, "page_dim"))


@checked("link_edges", f"WITH {EDGES} SELECT * FROM edges", ("links", "page_dim"))
def link_edges(spark, folder):
    return edges(spark, folder)


@checked("link_edges_as_text", f"WITH {EDGES} SELECT * FROM edges", ("links", "page_dim"))
def link_edges_as_text(spark, folder):
    path = scratch_path(spark, "edges")
    tables.write_delimited(edges(spark, folder), path)
    return tables.read_delimited(spark, path, tables.EDGE_SCHEMA)


@checked("linking_page_ids", f"WITH {EDGES} SELECT DISTINCT page_id FROM edges", ("links", "page_dim"))
def linking_page_ids(spark, folder):
    return links.distinct_ids(edges(spark, folder))


@checked("edited_pages", """
SELECT DISTINCT rev_user AS user_id, page_id, page_title FROM revisions
JOIN page_dim ON rev_page = page_id WHERE page_namespace = 0 AND rev_user > 200 AND rev_user < 1200""",
         ("revisions", "page_dim"))
def edited_pages(spark, folder):
    return links.edited_pages(view(spark, folder, "revisions"), view(spark, folder, "page_dim"),
                              200, 1200)


APP = """
app AS (SELECT concat('app-', CAST(user_id % 50 AS STRING)) AS install, uri_host,
  concat('Page_', CAST(k AS STRING)) AS page FROM requests),
counted AS (SELECT install AS user_key, page_id, n, page_title FROM
  (SELECT install, page, count(*) AS n FROM app WHERE uri_host = 'zh.m.wikipedia.org' GROUP BY install, page)
  JOIN page_dim ON page = page_title WHERE page_namespace = 0 AND page_is_redirect = 0)
"""


def app_counts(spark, folder):
    app = view(spark, folder, "requests").select(
        F.concat(F.lit("app-"), (F.col("user_id") % 50).cast("string")).alias("install"),
        "uri_host", F.concat(F.lit("Page_"), F.col("k").cast("string")).alias("page"))
    return links.app_page_counts(app, view(spark, folder, "page_dim"), "zh.m.wikipedia.org",
                                 "install", "page")


@checked("app_page_counts", f"WITH {APP} SELECT * FROM counted", ("requests", "page_dim"))
def app_page_counts(spark, folder):
    return app_counts(spark, folder)


@checked("user_dictionary", f"""
WITH {APP}, users AS (SELECT DISTINCT user_key FROM counted)
SELECT user_key, row_number() OVER (ORDER BY user_key) AS id FROM users""", ("requests", "page_dim"))
def user_dictionary(spark, folder):
    return links.dictionary(app_counts(spark, folder), "user_key")


@checked("app_preferences", f"""
WITH {APP}, users AS (SELECT user_key, row_number() OVER (ORDER BY user_key) AS id
  FROM (SELECT DISTINCT user_key FROM counted)),
items AS (SELECT page_title, row_number() OVER (ORDER BY page_title) AS id
  FROM (SELECT DISTINCT page_title FROM counted))
SELECT DISTINCT users.id AS user_id, items.id AS item_id FROM counted
JOIN users USING (user_key) JOIN items USING (page_title)""", ("requests", "page_dim"))
def app_preferences(spark, folder):
    counts = app_counts(spark, folder)
    return links.preference_table(counts, "user_key", "page_title",
                                  links.dictionary(counts, "user_key"),
                                  links.dictionary(counts, "page_title"))


@checked("in_links", f"""
WITH {RESOLVED}, titles AS (SELECT title, row_number() OVER (ORDER BY title) AS id FROM
  (SELECT prev_title AS title FROM resolved UNION SELECT curr_title FROM resolved))
SELECT c.id AS page_id, p.id AS link_id, n FROM resolved JOIN titles c ON c.title = curr_title
JOIN titles p ON p.title = prev_title""")
def in_links(spark, folder):
    clicks = resolved(spark, folder)
    titles = clicks.select(F.explode(F.array("prev_title", "curr_title")).alias("title"))
    return links.in_links(clicks, links.dictionary(titles, "title"))


# Similarity and recommendations.

def similar_sql(prefs, measure, limit):
    score = {
        "tanimoto": "CAST(shared AS DOUBLE) / (da + db - shared)",
        "loglikelihood": "1 - 1 / (1 + greatest(2 * (cells - margins + xn), 0))",
    }[measure]
    strength = {"tanimoto": score, "loglikelihood": "greatest(2 * (cells - margins + xn), 0)"}[measure]

    def xlx(v):
        return f"(CASE WHEN {v} > 0 THEN {v} * ln(CAST({v} AS DOUBLE)) ELSE 0 END)"

    cells = " + ".join(xlx(f"({v})") for v in (
        "shared", "da - shared", "db - shared", "users - da - db + shared"))
    margins = " + ".join(xlx(f"({v})") for v in ("da", "users - da", "db", "users - db"))
    return f"""
degrees AS (SELECT item_id, count(*) AS d FROM {prefs} GROUP BY item_id),
shared AS (SELECT a.item_id AS item_a, b.item_id AS item_b, count(*) AS shared
  FROM {prefs} a JOIN {prefs} b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL),
tabled AS (SELECT item_a, item_b, shared, least(x.d, y.d) AS da, greatest(x.d, y.d) AS db,
  (SELECT count(DISTINCT user_id) FROM {prefs}) AS users
  FROM shared JOIN degrees x ON x.item_id = item_a JOIN degrees y ON y.item_id = item_b),
parts AS (SELECT *, {cells} AS cells, {margins} AS margins, {xlx('users')} AS xn FROM tabled),
scored AS (SELECT item_a AS item_id, item_b AS other_id, {score} AS raw, {strength} AS strength FROM parts),
similar_items AS (SELECT item_id, other_id, raw, round(raw, 6) AS score FROM scored
  QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY strength DESC, other_id) <= {limit})
"""


def recommended_sql(prefs, k, listed="true"):
    return f"""
sums AS (SELECT p.user_id, s.other_id AS item_id, round(sum(s.raw), 12) AS raw
  FROM {prefs} p JOIN similar_items s ON s.item_id = p.item_id WHERE {listed} GROUP BY ALL),
fresh AS (SELECT * FROM sums WHERE NOT EXISTS (SELECT 1 FROM {prefs} o
  WHERE o.user_id = sums.user_id AND o.item_id = sums.item_id)),
recommended AS (SELECT user_id, item_id, round(raw, 6) AS score, CAST(row_number() OVER (
    PARTITION BY user_id ORDER BY raw DESC, item_id) AS INT) AS rank FROM fresh
  QUALIFY rank <= {k})
"""


LINK_PREFS = f"{EDGES}, link_prefs AS (SELECT DISTINCT page_id AS user_id, link_id AS item_id FROM edges)"


def link_prefs(spark, folder):
    return written(edges(spark, folder).select(
        F.col("page_id").alias("user_id"), F.col("link_id").alias("item_id")).distinct(), "links")


@checked("item_similarity_tanimoto",
         f"WITH {similar_sql('prefs', 'tanimoto', 1000)} SELECT item_id, other_id, score FROM similar_items",
         ("prefs",))
def item_similarity_tanimoto(spark, folder):
    return tidied(similarity.item_similarity(
        written(view(spark, folder, "prefs"), "prefs"), "tanimoto", 1000), "score")


@checked("many_similar_items",
         f"WITH {similar_sql('prefs', 'tanimoto', 1500)} SELECT item_id, other_id, score FROM similar_items",
         ("prefs",))
def many_similar_items(spark, folder):
    """More per item than Spark's own group limit takes."""
    return tidied(similarity.item_similarity(
        written(view(spark, folder, "prefs"), "prefs"), "tanimoto", 1500, chunk=64), "score")


@checked("item_similarity_loglikelihood",
         f"WITH {similar_sql('prefs', 'loglikelihood', 100)} SELECT item_id, other_id, score FROM similar_items",
         ("prefs",))
def item_similarity_loglikelihood(spark, folder):
    return tidied(similarity.item_similarity(
        written(view(spark, folder, "prefs"), "prefs"), "loglikelihood", 100), "score")


@checked("few_similar_pages",
         f"WITH {LINK_PREFS}, {similar_sql('link_prefs', 'tanimoto', 5)} SELECT item_id, other_id, score FROM similar_items",
         ("links", "page_dim"))
def few_similar_pages(spark, folder):
    """The best few only, so pairs of pages of very different degrees are left out early."""
    return tidied(similarity.pruned_similarity(link_prefs(spark, folder), "tanimoto", 5), "score")


@checked("few_related_pages",
         f"WITH {LINK_PREFS}, {similar_sql('link_prefs', 'loglikelihood', 5)} SELECT item_id, other_id, score FROM similar_items",
         ("links", "page_dim"))
def few_related_pages(spark, folder):
    return tidied(similarity.pruned_similarity(link_prefs(spark, folder), "loglikelihood", 5), "score")


@checked("recommended_items", f"""
WITH {similar_sql('prefs', 'tanimoto', 100)}, {recommended_sql('prefs', 10)}
SELECT * FROM recommended""", ("prefs",))
def recommended_items(spark, folder):
    prefs = written(view(spark, folder, "prefs"), "prefs")
    similar = similarity.item_similarity(prefs, "tanimoto", 100)
    return tidied(similarity.recommend_items(prefs, similar, 10), "score")


@checked("recommended_items_of_listed_users", f"""
WITH {similar_sql('prefs', 'tanimoto', 100)},
{recommended_sql('prefs', 10, "p.user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")}
SELECT * FROM recommended""", ("prefs",))
def recommended_items_of_listed_users(spark, folder):
    prefs = written(view(spark, folder, "prefs"), "prefs")
    listed = table(spark, folder, "customer").where("c_mktsegment = 'BUILDING'").select(
        F.col("c_custkey").alias("user_id"))
    similar = similarity.item_similarity(prefs, "tanimoto", 100)
    return tidied(similarity.recommend_items(prefs, similar, 10, listed), "score")


@checked("non_linked_recommendations", f"""
WITH {LINK_PREFS}, {similar_sql('link_prefs', 'loglikelihood', 100)}, {recommended_sql('link_prefs', 50)}
SELECT * FROM recommended""", ("links", "page_dim"))
def non_linked_recommendations(spark, folder):
    prefs = link_prefs(spark, folder)
    similar = similarity.item_similarity(prefs, "loglikelihood", 100)
    return tidied(similarity.recommend_items(prefs, similar, 50, links.distinct_ids(prefs, "user_id")),
                  "score")


@checked("similar_pages_by_title", f"""
WITH {LINK_PREFS}, {similar_sql('link_prefs', 'tanimoto', 1000)}
SELECT a.page_title AS page, b.page_title AS link, score FROM similar_items
JOIN page_dim a ON a.page_id = item_id JOIN page_dim b ON b.page_id = other_id""", ("links", "page_dim"))
def similar_pages_by_title(spark, folder):
    path = scratch_path(spark, "similar")
    tables.write_delimited(
        similarity.item_similarity(link_prefs(spark, folder), "tanimoto", 1000), path)
    return tidied(links.with_titles(tables.read_similarity(spark, path), view(spark, folder, "page_dim")),
                  "score")


@checked("titles_of_pages", """
SELECT page_id, page_title FROM page_dim WHERE page_id IN (3, 14, 159, 265)""", ("page_dim",))
def titles_of_pages(spark, folder):
    return links.titles_of(view(spark, folder, "page_dim"), [3, 14, 159, 265])
