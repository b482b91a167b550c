"""Documents and pages: text functions, digests, links, file names, sections, search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fx
from ..operators import geometry, search, sections, snapshot
from ..session import table as t
from ..sources import inventory
from .registry import query

_WHITE = "[ \\t\\n\\x0B\\f\\r]+"


@query(rf"SELECT doc_id, substr(sha256(trim(regexp_replace(text, '{_WHITE}', ' ', 'g'))), 1, 16) AS digest FROM documents")
def content_digest(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", snapshot.digest(F.array("text")).alias("digest"))


@query(rf"SELECT doc_id, trim(regexp_replace(text, '{_WHITE}', ' ', 'g')) AS text FROM documents")
def collapse_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", fx.collapse(F.col("text")).alias("text"))


@query("SELECT sha256(text) AS digest, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicate_texts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query(r"""SELECT label, count(*) AS n FROM (SELECT trim(regexp_extract(text, '^([^("''„]*)', 1)) AS label FROM benchmark) GROUP BY 1""")
def refusal_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "benchmark").groupBy(fx.reason_label(F.col("text")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


_KINDS = [("licence", ["license", "rights reserved"]), ("secret", ["token =", "password"]), ("shouting", ["!!"]), ("table", [" | "])]


@query("SELECT kind, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN {' OR '.join(f'contains(lower(text), $${p}$$)' for p in ps)} THEN '{k}'" for k, ps in _KINDS) + " ELSE 'prose' END AS kind FROM documents) GROUP BY 1")
def rule_kind_classifier(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").groupBy(fx.first_match(F.col("text"), _KINDS, "prose").alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) - 1 AS place FROM pages""")
def link_harvest(spark: SparkSession, d: str) -> DataFrame:
    return inventory.links(t(spark, d, "pages"), "page_id", "html").withColumn("place", F.col("place").cast("long"))


@query("""SELECT href, page_id FROM (SELECT page_id, href, row_number() OVER (PARTITION BY href ORDER BY page_id, place) AS k FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href,
 generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS place FROM pages)) WHERE k = 1""")
def link_dedup_first(spark: SparkSession, d: str) -> DataFrame:
    return inventory.first_links(inventory.links(t(spark, d, "pages"), "page_id", "html"), "page_id").select("href", "page_id")


@query(r"""SELECT page_id, regexp_extract(url, '://([^/?#]*)', 1) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^.*/', '') AS last FROM pages""")
def url_host_path(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return t(spark, d, "pages").select("page_id", inventory.host(url).alias("host"), inventory.path(url).alias("path"), inventory.last_segment(url).alias("last"))


@query(r"""SELECT page_id, 'https://' || regexp_replace(regexp_extract(url, '://([^/?#]*)', 1), '^www\.', '') || regexp_extract(url, '://[^/?#]*([^#]*)', 1) AS url FROM pages""")
def url_normal_form(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "pages").select("page_id", inventory.normal_url(F.col("url")).alias("url"))


@query(r"""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[^?#]*', 0), '^.*/', '') AS name, url FROM pages), k AS (SELECT *, regexp_replace(name, '\.[a-z]+$', '') AS stem FROM p)
 SELECT page_id, CASE WHEN starts_with(stem, '1') THEN 'key' WHEN ends_with(stem, '9') THEN 'paper' WHEN contains(url, '/de/') THEN 'report' ELSE 'other' END AS kind,
 CASE WHEN starts_with(stem, '1') THEN 'prefix' WHEN ends_with(stem, '9') THEN 'suffix' WHEN contains(url, '/de/') THEN 'directory' ELSE 'default' END AS kind_source,
 CASE WHEN regexp_matches(stem, '^(1[5-9]|2[0-9]|30)(0[1-9]|1[0-2])$') THEN '20' || substr(stem, 1, 2) || '-' || substr(stem, 3, 2)
 WHEN regexp_matches(stem, '^(1[5-9]|2[0-3])[1-3]$') THEN '20' || substr(stem, 1, 2) || '-' || (['01', '05', '06'])[substr(stem, 3, 1)::INT] ELSE '' END AS session FROM k""")
def filename_taxonomy(spark: SparkSession, d: str) -> DataFrame:
    taxonomy = inventory.Taxonomy(prefixes=[("1", "key")], suffixes=[("9", "paper")], directories=[("/de/", "report")], default="other")
    return t(spark, d, "pages").select("page_id", inventory.classify(F.col("url"), taxonomy).alias("k"), fx.session_date(inventory.stem(F.col("url"))).alias("session")).select("page_id", "k.kind", "k.kind_source", "session")


@query(r"SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, split_part(regexp_extract(url, '://[^/?#]*/([^?#]*)', 1), '/', 1) AS lang, count(*) AS n FROM pages GROUP BY 1, 2")
def inventory_manifest(spark: SparkSession, d: str) -> DataFrame:
    pages = t(spark, d, "pages").select(inventory.host(F.col("url")).alias("host"), F.split_part(inventory.path(F.col("url")), F.lit("/"), F.lit(2)).alias("lang"))
    return pages.groupBy("host", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT lang, count(*) AS listed, count(page_id) AS present, count(*) - count(page_id) AS missing, coalesce(sum(length(html)), 0)::BIGINT AS chars, count(*) FILTER (html NOT LIKE '%</html>%') AS corrupt
 FROM documents LEFT JOIN pages ON page_id = doc_id GROUP BY 1""")
def inventory_completeness(spark: SparkSession, d: str) -> DataFrame:
    return inventory.completeness(t(spark, d, "documents").select("doc_id", "lang"), t(spark, d, "pages"), "doc_id", "page_id", ["lang"], "html", "</html>")


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)', 1) AS title, regexp_extract(html, '<h1>([^<]*)', 1) AS heading,
 length(regexp_replace(html, '<[^>]*>', '', 'g'))::BIGINT AS n_stripped FROM pages""")
def html_sections(spark: SparkSession, d: str) -> DataFrame:
    html = F.col("html")
    return t(spark, d, "pages").select("page_id", F.regexp_extract(html, "<title>([^<]*)", 1).alias("title"), F.regexp_extract(html, "<h1>([^<]*)", 1).alias("heading"), F.length(F.regexp_replace(html, "<[^>]*>", "")).cast("long").alias("n_stripped"))


@query()
def html_heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.of_html(t(spark, d, "pages"), "page_id", "html")


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents)
 SELECT doc_id, h AS section, string_agg(line, chr(10) ORDER BY k) AS body FROM (SELECT doc_id, line, k, sum((length(line) < 40)::INT) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS h FROM l) GROUP BY 1, 2""")
def line_sections(spark: SparkSession, d: str) -> DataFrame:
    return sections.by_lines(t(spark, d, "documents"), "doc_id", "text", lambda line: F.length(line) < 40)


_ASKED = ["idiot", "licensed", "on", "thin"]
_STOP = ", ".join(f"'{w}'" for w in fx.STOP_WORDS)
_TERMS = f"""w AS (SELECT doc_id, unnest(regexp_extract_all(translate(lower(text), '{fx.FOLD_FROM}', '{fx.FOLD_TO}'), '[a-z0-9]+')) AS w FROM documents),
 k AS (SELECT * FROM w WHERE length(w) >= 2 AND w NOT IN ({_STOP})),
 x AS (SELECT doc_id, w AS term FROM k UNION ALL SELECT doc_id, substr(w, 1, 4) FROM k WHERE length(w) > 4 UNION ALL SELECT doc_id, substr(w, 1, 6) FROM k WHERE length(w) > 6)"""


@query(f"WITH {_TERMS} SELECT doc_id, count(*) AS n_terms, count(DISTINCT term) AS n_distinct FROM x GROUP BY 1")
def tokenise_fold(spark: SparkSession, d: str) -> DataFrame:
    terms = t(spark, d, "documents").select("doc_id", fx.search_terms(F.col("text")).alias("x")).where(F.size("x") > 0)
    return terms.select("doc_id", F.size("x").cast("long").alias("n_terms"), F.size(F.array_distinct("x")).cast("long").alias("n_distinct"))


@query(f"""WITH {_TERMS}, tf AS (SELECT doc_id, term, count(*) AS tf FROM x WHERE term IN ('idiot', 'licensed', 'on', 'thin') GROUP BY 1, 2), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)
 SELECT doc_id, round(sum(ln(1 + (SELECT count(*) FROM documents) / (1 + df)) * (1 + ln(tf))), 6) AS score FROM tf JOIN df USING (term) GROUP BY 1""")
def search_scores(spark: SparkSession, d: str) -> DataFrame:
    docs = t(spark, d, "documents")
    return search.scores(search.index(docs, "doc_id", "text", only=_ASKED), "doc_id", docs.count(), _ASKED)


@query("""SELECT doc_id, CASE WHEN pos > 0 THEN (CASE WHEN s > 1 THEN '…' ELSE '' END) || substr(f, s, 300) || (CASE WHEN s + 299 < length(f) THEN '…' ELSE '' END) END AS snippet FROM
 (SELECT doc_id, lower(text) AS f, instr(lower(text), 'thin') AS pos, greatest(1, instr(lower(text), 'thin') - 100) AS s FROM documents)""")
def search_snippet(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").select("doc_id", fx.snippet(F.lower("text"), F.lit("thin")).alias("snippet"))


@query()
def region_cluster(spark: SparkSession, d: str) -> DataFrame:
    """Boxes made of lineitem's numbers, clustered for each order as for a page."""
    x, y = F.col("l_quantity") * 10, (F.col("l_partkey") % 97) * 8.0
    boxes = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), x.alias("x0"), y.alias("top"), (x + 30 + F.col("l_linenumber")).alias("x1"), (y + 90).alias("bottom"))
    return geometry.clusters(boxes, "page")
