"""Queries on captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.functions import urls as U
from sightline.session import table
from sightline.sources import web as W


def page_edges(spark: SparkSession, sf: str) -> DataFrame:
    return W.page_edges(table(spark, sf, "pages")).select("page_url", "target_url", "edge", "kind", "pos")


def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    url = F.col("url")
    mime = F.when(F.col("page_id") % 3 == 0, "text/html; charset=utf-8").when(F.col("page_id") % 3 == 1, "image/PNG").otherwise("application/octet-stream")
    return table(spark, sf, "pages").select(
        "page_id", U.url_normalise(url).alias("clean"), U.url_origin(url).alias("origin"), U.url_host(url).alias("host"),
        U.url_path(url).alias("path"), U.media_kind(url, mime).alias("kind"))


def media_page_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with pictures, videos and linked files made of the page number, after their own anchors are cut away."""
    n = F.col("page_id").cast("string")
    html = F.concat(F.lit('<html><base href="http://media.example/"><img src="a'), n, F.lit('.jpg" srcset="b'), n, F.lit('.jpg 300w, c'), n,
                    F.lit('.jpg 900w"><img src="tiny'), n, F.lit('.png" width="20"><picture><source srcset="d'), n, F.lit('.webp 2x"><img src="e'), n,
                    F.lit('.png"></picture><video src="f'), n, F.lit('.mp4" poster="g'), n, F.lit('.jpg"></video><img src="icon.svg"><a href="d'), n,
                    F.lit('.webp">seen</a><a href="h'), n, F.lit('.gif">file</a><a href="/p'), n, F.lit('">page</a><meta property="og:image" content="i'), n, F.lit('.jpg">'))
    return W.page_edges(table(spark, sf, "pages").select("url", html.alias("html"))).select("page_url", "target_url", "edge", "kind", "pos")


def _crawl(spark: SparkSession, sf: str, same_host: bool = False, **bounds) -> DataFrame:
    """Every page as the start of a crawl; pages link two others each, anchors serve as media."""
    pages = table(spark, sf, "pages").select("page_id", U.url_normalise(F.col("url")).alias("url"), "html")
    n = pages.agg(F.count("*").alias("n")).withColumn("one", F.lit(1))
    found = W.page_edges(pages)
    media = found.select("page_url", F.concat("target_url", F.lit(".jpg")).alias("target_url"), F.lit("shown").alias("edge"), F.lit("image").alias("kind"), "pos")
    numbered = pages.select("page_id", F.col("url").alias("target_url"))
    to = pages.withColumn("one", F.lit(1)).join(F.broadcast(n), "one").select(F.col("url").alias("page_url"), F.posexplode(F.array(
        (F.col("page_id") * 2 + 1) % F.col("n"), (F.col("page_id") * 3 + 2) % F.col("n"))).alias("pos", "page_id"))
    links = to.join(numbered, "page_id").select("page_url", "target_url", F.lit("page").alias("edge"), F.lit(None).cast("string").alias("kind"), "pos")
    edges = W.cut_lineage(media.unionByName(links))
    return W.crawl_frontier(edges, pages, pages.select(F.col("url").alias("seed")), max_depth=2, same_host=same_host, **bounds)


def crawl_frontier(spark: SparkSession, sf: str) -> DataFrame:
    return _crawl(spark, sf, max_pages=5, max_media=12)


def crawl_unbounded(spark: SparkSession, sf: str) -> DataFrame:
    """No bounds: which media each crawl finds, and how deep."""
    return _crawl(spark, sf).select("seed", "target_url", "kind", "depth")


def crawl_same_host(spark: SparkSession, sf: str) -> DataFrame:
    """As crawl_unbounded, but a crawl never leaves the host it began on."""
    return _crawl(spark, sf, same_host=True).select("seed", "target_url", "kind", "depth")


def url_policy(spark: SparkSession, sf: str) -> DataFrame:
    """Robots rules and addresses derived from the page that first names an origin."""
    pages = table(spark, sf, "pages").select("page_id", "url", U.url_origin(F.col("url")).alias("origin"), U.url_host(F.col("url")).alias("host"))
    first = pages.groupBy("origin").agg(F.min("page_id").alias("p"))
    status = F.element_at(F.array(F.lit(200), F.lit(200), F.lit(404), F.lit(503)), (F.col("p") % 4 + 1).cast("int"))
    robots = first.select("origin", status.alias("status"), F.posexplode(F.array(F.lit("/en/8"), F.lit("/en/"), F.lit("/fr/"))).alias("rule_pos", "path_prefix"),
                          (F.col("p") % 5).cast("double").alias("crawl_delay")).withColumn("allow", F.col("rule_pos") == 0)
    hosts = pages.groupBy("host").agg(F.min("page_id").alias("p"))
    addresses = hosts.select("host", F.when(F.col("p") % 6 == 0, "10.0.0.7").otherwise("93.184.216.34").alias("ip")).withColumn(
        "is_global", W.is_global_address(F.col("ip")))
    return W.url_policy_gate(pages.select("url"), robots, addresses)


QUERIES = {f.__name__: f for f in (page_edges, media_page_edges, url_parts, crawl_frontier, crawl_unbounded, crawl_same_host, url_policy)}

_PARTS = """p AS (SELECT page_id, url, html, regexp_replace(url, '#.*$', '') AS clean, lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) AS origin,
  lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages)"""
ORACLES = {
    "page_edges": f"""WITH {_PARTS}, a AS (SELECT url, origin, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS hrefs FROM p),
      e AS (SELECT url, origin, unnest(hrefs) AS href, unnest(range(len(hrefs)))::INT AS pos FROM a)
      SELECT url AS page_url, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || href AS target_url, 'page' AS edge, NULL::VARCHAR AS kind, pos FROM e""",
    "crawl_frontier": f"""WITH {_PARTS}, n AS (SELECT count(*) AS n FROM pages),
      lk AS (SELECT a.clean AS a, b.clean AS b, pos FROM p a CROSS JOIN n CROSS JOIN (SELECT unnest([0, 1]) AS pos) v
        JOIN p b ON b.page_id = CASE WHEN pos = 0 THEN (a.page_id * 2 + 1) % n ELSE (a.page_id * 3 + 2) % n END),
      d1 AS (SELECT a AS s, b, row_number() OVER (PARTITION BY a ORDER BY pos, b) AS turn FROM (SELECT a, b, min(pos) AS pos FROM lk WHERE a <> b GROUP BY ALL) x),
      d2 AS (SELECT s, b, row_number() OVER (PARTITION BY s ORDER BY m, b) AS turn FROM (SELECT d1.s, l.b, min(d1.turn * 10 + l.pos) AS m FROM d1 JOIN lk l ON l.a = d1.b
        LEFT JOIN d1 e ON e.s = d1.s AND e.b = l.b WHERE l.b <> d1.s AND e.s IS NULL GROUP BY ALL) x),
      queue AS (SELECT s, node, depth, row_number() OVER (PARTITION BY s ORDER BY depth, turn) AS k FROM (SELECT clean AS s, clean AS node, 0 AS depth, 1 AS turn FROM p
        UNION ALL SELECT s, b, 1, turn FROM d1 UNION ALL SELECT s, b, 2, turn FROM d2) x),
      hrefs AS (SELECT clean, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1) AS h FROM p),
      media AS (SELECT clean, site || h[i] || '.jpg' AS target, min(i) AS place FROM (SELECT clean, site, h, unnest(range(1, len(h) + 1)) AS i FROM hrefs) x GROUP BY ALL),
      firsts AS (SELECT s, node, depth, target, k, place, row_number() OVER (PARTITION BY s, target ORDER BY k, place) AS r FROM queue JOIN media ON clean = node WHERE k <= 5),
      counted AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY k, place, target) AS nth FROM firsts WHERE r = 1)
      SELECT s AS seed, node AS found_on, target AS target_url, 'image' AS kind, depth::INT AS depth, nth FROM counted WHERE nth <= 12""",
    "crawl_same_host": f"""WITH {_PARTS}, n AS (SELECT count(*) AS n FROM pages),
      link AS (SELECT p.clean AS a, q.clean AS b FROM p CROSS JOIN n JOIN p q ON q.page_id IN ((p.page_id * 2 + 1) % n, (p.page_id * 3 + 2) % n)
        WHERE lower(regexp_extract(p.url, '^[a-z]+://([^/?#]+)', 1)) = lower(regexp_extract(q.url, '^[a-z]+://([^/?#]+)', 1))),
      reach AS (SELECT clean AS s, clean AS node, 0 AS depth FROM p UNION SELECT a, b, 1 FROM link UNION SELECT x.a, y.b, 2 FROM link x JOIN link y ON x.b = y.a),
      media AS (SELECT clean, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) || '.jpg' AS target FROM p)
      SELECT s AS seed, target AS target_url, 'image' AS kind, min(depth)::INT AS depth FROM reach JOIN media ON media.clean = node GROUP BY ALL""",
    "crawl_unbounded": f"""WITH {_PARTS}, n AS (SELECT count(*) AS n FROM pages),
      link AS (SELECT p.clean AS a, q.clean AS b FROM p CROSS JOIN n JOIN p q ON q.page_id IN ((p.page_id * 2 + 1) % n, (p.page_id * 3 + 2) % n)),
      reach AS (SELECT clean AS s, clean AS node, 0 AS depth FROM p UNION SELECT a, b, 1 FROM link UNION SELECT x.a, y.b, 2 FROM link x JOIN link y ON x.b = y.a),
      media AS (SELECT clean, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) || '.jpg' AS target FROM p)
      SELECT s AS seed, target AS target_url, 'image' AS kind, min(depth)::INT AS depth FROM reach JOIN media ON media.clean = node GROUP BY ALL""",
    "media_page_edges": """WITH t(pos, name, ending, edge, kind) AS (VALUES (0, 'c', '.jpg', 'shown', 'image'), (1, 'd', '.webp', 'shown', 'image'),
      (2, 'f', '.mp4', 'shown', 'video'), (3, 'g', '.jpg', 'shown', 'image'), (6, 'h', '.gif', 'linked', 'image'), (7, 'p', '', 'page', NULL),
      (8, 'i', '.jpg', 'shown', 'image'))
      SELECT url AS page_url, 'http://media.example/' || name || page_id || ending AS target_url, edge, kind, pos::INT AS pos FROM pages, t""",
    "url_parts": f"""WITH {_PARTS} SELECT page_id, clean, origin, host, path,
      CASE WHEN page_id % 3 = 1 THEN 'image' END AS kind FROM p""",
    "url_policy": f"""WITH {_PARTS}, f AS (SELECT origin, min(page_id) AS p FROM p GROUP BY 1), h AS (SELECT host, min(page_id) AS hp FROM p GROUP BY 1),
      k AS (SELECT url, [200, 200, 404, 503][p % 4 + 1] AS status, p, hp, path FROM p JOIN f USING (origin) JOIN h USING (host)),
      r AS (SELECT url, p, CASE WHEN hp % 6 = 0 THEN 'address is not public' WHEN status = 404 THEN NULL
      WHEN status = 503 THEN 'robots file could not be read' WHEN starts_with(path, '/en/8') THEN NULL
      WHEN starts_with(path, '/en/') OR starts_with(path, '/fr/') THEN 'robots file disallows it' END AS reason FROM k)
      SELECT url, reason IS NULL AS allowed, reason, CASE WHEN reason IS NULL THEN greatest(1.0, p % 5)::DOUBLE END AS delay FROM r""",
}
