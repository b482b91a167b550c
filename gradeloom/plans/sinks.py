"""Sources and sinks: file names, what loads and reports write, nested JSON; the writing itself is in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread
from ..session import table as t
from ..sources import filenames, jsonfiles, keyed
from .registry import query

_INCOMING = """SELECT o_custkey, o_orderkey, CASE WHEN o_custkey % 4 = 1 THEN 'P' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_custkey % 3 > 0 AND (o_custkey % 5 > 0 OR o_orderkey % 2 = 0)"""


@query(f"""WITH incoming AS ({_INCOMING} UNION ALL SELECT -o_custkey, o_orderkey, 'P' FROM orders WHERE o_orderkey % 100 = 0), stored AS (SELECT o_custkey, o_orderkey, o_orderstatus FROM orders),
 a AS (SELECT o_custkey, list_sort(list(o_orderkey || o_orderstatus)) AS l FROM incoming GROUP BY 1), b AS (SELECT o_custkey, list_sort(list(o_orderkey || o_orderstatus)) AS l, bool_or(o_orderstatus = 'F') AS reviewed FROM stored GROUP BY 1)
 SELECT a.o_custkey, CASE WHEN a.l = b.l THEN 'unchanged' WHEN reviewed THEN 'refused' ELSE 'loaded' END AS verdict FROM a LEFT JOIN b USING (o_custkey)""")
def load_verdicts(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    changed = F.when(F.col("o_custkey") % 4 == 1, "P").otherwise(F.col("o_orderstatus"))
    incoming = orders.where("o_custkey % 3 > 0 and (o_custkey % 5 > 0 or o_orderkey % 2 = 0)").withColumn("o_orderstatus", changed)
    new = orders.where("o_orderkey % 100 = 0").select((-F.col("o_custkey")).alias("o_custkey"), "o_orderkey", F.lit("P").alias("o_orderstatus"))
    return keyed.verdicts(orders, incoming.unionByName(new), "o_custkey", F.col("o_orderstatus") == "F")


@query("""WITH s AS (SELECT o_orderpriority AS priority, year(o_orderdate) AS year, count(*) AS n, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE 'a|"' || min(o_orderstatus) || '",' END AS mark FROM orders GROUP BY 1, 2)
 SELECT 'markdown' AS kind, '| priority | year | n | mark |' || chr(10) || '| --- | --- | --- | --- |' AS line UNION ALL SELECT 'markdown', '| ' || priority || ' | ' || year || ' | ' || n || ' | ' || coalesce(replace(mark, '|', '\\|'), '') || ' |' FROM s
 UNION ALL SELECT 'csv', 'priority,year,n,mark' UNION ALL SELECT 'csv', priority || ',' || year || ',' || n || ',' || coalesce('"' || replace(mark, '"', '""') || '"', '') FROM s
 UNION ALL SELECT 'tsv', concat_ws(chr(9), 'priority', 'year', 'n', 'mark') UNION ALL SELECT 'tsv', priority || chr(9) || year || chr(9) || n || chr(9) || coalesce(mark, '') FROM s
 UNION ALL SELECT 'json', '{"priority":"' || priority || '","year":' || year || ',"n":' || n || ',"mark":' || coalesce('"' || replace(mark, '"', '\\"') || '"', 'null') || '}' FROM s""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    orders = t(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("priority"), F.year("o_orderdate").alias("year"))
    n = F.count(F.lit(1))
    rows = orders.agg(n.alias("n"), F.when(n % 3 != 0, F.concat(F.lit('a|"'), F.min("o_orderstatus"), F.lit('",'))).alias("mark"))
    out = None
    for kind in ("markdown", "csv", "tsv", "json"):
        lines = jsonfiles.report(rows, ["priority", "year", "n", "mark"], ["priority", "year"], kind).select(F.lit(kind).alias("kind"), "line")
        out = lines if out is None else out.unionByName(lines)
    return out


_DUMP = """'{"numer": ' || cast(p_size as string) || ', "szerokosc": 595.5, "wysokosc": 842' || case p_partkey % 5 when 0 then ', "znaki": 7' when 1 then ', "znaki": [' else ', "znaki": [["' || substring(p_brand, 1, 1) || '", ' || cast(p_size as string) || '.5, 16, 94.5, 105, 11], ["–", 20, 26, 87, 98, ' || cast(p_size % 9 as string) || ']], "kreski": [], "kreski_kandydujace": [[1, 2, 3]], "tabele": []' end || '}'"""


@query(f"""WITH f AS (SELECT p_partkey, {_DUMP.replace("as string", "as varchar")} AS x FROM part), r AS (SELECT p_partkey, x, CASE WHEN NOT json_valid(x) THEN 'no JSON' WHEN json_type(x, '$.znaki') <> 'ARRAY' THEN 'other shape' END AS reason FROM f),
 c AS (SELECT p_partkey, unnest(CASE WHEN reason IS NULL THEN [0, 1] ELSE [NULL] END) AS n, reason, x FROM r)
 SELECT p_partkey, reason, n::BIGINT AS n, CASE WHEN n IS NOT NULL THEN json_extract_string(x, '$.znaki[' || n || '][0]') END AS c, CASE WHEN n IS NOT NULL THEN json_extract_string(x, '$.znaki[' || n || '][1]')::DOUBLE END AS x0, CASE WHEN n IS NOT NULL THEN json_extract_string(x, '$.znaki[' || n || '][5]')::DOUBLE END AS size FROM c""")
def page_dumps(spark: SparkSession, d: str) -> DataFrame:
    """Characters of dumps, and a row with the reason for each broken one."""
    files = t(spark, d, "part").select("p_partkey", F.expr(_DUMP).alias("text"))
    pages = jsonfiles.parse(files, "text", jsonfiles.PAGE)
    good = jsonfiles.characters(pages, "p_partkey").select("page.p_partkey", F.lit(None).cast("string").alias("reason"), "n", "c", "x0", "size")
    bad = pages.where("reason is not null").select("p_partkey", "reason")
    return good.unionByName(bad, allowMissingColumns=True)


_NAME = """case p_partkey % 6 when 0 then 'OMAP-' || cast(p_size as string) || '0-2105-zasady-oceniania.pdf' when 1 then 'zasady_oceniania_OMAP-' || cast(p_size as string) || '-1904.pdf' when 2 then 'MJA-P1_' || cast(p_size as string) || '-172-A.pdf'
 when 3 then 'MMA-R' || cast(p_size as string) || '-152a.PDF' when 4 then 'EMAP-P0-' || cast(p_size as string) || '.pdf' else p_name || '_mapa' end"""
_FOLDER = "case p_size % 3 when 0 then '/a/Odpowiedzi/' when 1 then '/Nagrania/x' end"


def _cases(rows: list[tuple[str, str]], test: str, then: str) -> str:
    return "CASE " + " ".join(f"WHEN {test.format(p)} THEN {then.format(p=p, k=k)}" for p, k in rows) + " END"


@query(rf"""WITH n AS (SELECT p_partkey, regexp_replace({_NAME.replace("as string", "as varchar")}, '(?i)\.pdf$', '') AS s, lower(coalesce({_FOLDER}, '')) AS f FROM part),
 k AS (SELECT *, {_cases(filenames.PREFIXES, "starts_with(lower(s), '{}')", "'{k}'")} AS begun, {_cases(filenames.PREFIXES, "starts_with(lower(s), '{}')", "length('{p}')")} AS cut, {_cases(filenames.SUFFIXES, "regexp_matches(regexp_extract(s, '" + filenames.END + "', 1), '(?i)^(?:{})$')", "'{k}'")} AS ended, {_cases(filenames.FOLDERS, "contains(f, '{}')", "'{k}'")} AS within_ FROM n),
 r AS (SELECT *, string_split(CASE WHEN begun IS NOT NULL THEN substr(s, cut + 1) WHEN ended IS NOT NULL THEN regexp_replace(s, '{filenames.END}', '') ELSE s END, '-') AS parts FROM k),
 t AS (SELECT p_partkey, unnest(parts) AS tok, generate_subscripts(parts, 1) AS i FROM r),
 x AS (SELECT *, CASE WHEN i = 1 THEN '' WHEN regexp_matches(tok, '^(1[5-9]|2[0-9]|30)(0[1-9]|1[0-2])$') THEN '20' || substr(tok, 1, 2) || '-' || substr(tok, 3, 2) WHEN regexp_matches(tok, '(?i)^(1[5-9]|2[0-3])[1-3][a-z]?$') THEN '20' || substr(tok, 1, 2) || '-' || (['01', '05', '06'])[substr(tok, 3, 1)::INT] ELSE '' END AS ses FROM t),
 a AS (SELECT p_partkey, max(i) FILTER (ses <> '') AS at_, arg_max(ses, i) FILTER (ses <> '') AS ses, max(i) AS n FROM x GROUP BY 1),
 v AS (SELECT p_partkey, coalesce(string_agg(tok, ',' ORDER BY i) FILTER (i > 1 AND i IS DISTINCT FROM at_), '') AS variants FROM x JOIN a USING (p_partkey) GROUP BY 1)
 SELECT p_partkey, coalesce(begun, ended, within_, '{filenames.DEFAULT}') AS kind, CASE WHEN begun IS NOT NULL THEN 'prefix' WHEN ended IS NOT NULL THEN 'suffix' WHEN within_ IS NOT NULL THEN 'directory' ELSE 'default' END AS kind_source,
  CASE WHEN begun IS NOT NULL THEN 'prefix' WHEN ended IS NOT NULL THEN 'since-2023' WHEN at_ IS NOT NULL THEN 'code-variants-session' WHEN n > 1 THEN 'no-session' ELSE 'unknown' END AS pattern, parts[1] AS code, variants, coalesce(ses, '') AS session FROM r JOIN a USING (p_partkey) JOIN v USING (p_partkey)""")
def file_names(spark: SparkSession, d: str) -> DataFrame:
    named = spread(t(spark, d, "part"), "p_partkey").select("p_partkey", filenames.parse(F.expr(_NAME), F.expr(_FOLDER)).alias("m"))
    return named.select("p_partkey", "m.*")
