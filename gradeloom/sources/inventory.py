"""Inventories: TSV lists of documents, links of pages, file names and what they tell."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COLUMNS = ("segment", "year", "year_in_path", "directory", "file", "code", "variants", "session", "kind", "kind_source", "pattern", "url", "local_path")


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """The inventory with its fixed columns; paths have forward slashes."""
    df = spark.read.csv(path, sep="\t", header=True, schema=", ".join(f"{c} string" for c in COLUMNS))
    return df.withColumn("local_path", F.translate("local_path", "\\", "/"))


def select(df: DataFrame, kinds=(), codes=(), segments=(), years=(), variants=()) -> DataFrame:
    """Rows that meet all conditions; an empty one is met by all. A variant is the first of the list."""
    for column, wanted in (("kind", kinds), ("code", codes), ("segment", segments), ("year", years)):
        if wanted:
            df = df.where(F.col(column).isin(*map(str, wanted)))
    return df.where(F.get(F.split("variants", ","), F.lit(0)).isin(*variants)) if variants else df


def links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, place, href of each link in page order."""
    found = F.regexp_extract_all(html, F.lit('<a href="([^"]*)"'), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("place", "href"))


def first_links(found: DataFrame, key: str) -> DataFrame:
    """The first page's occurrence of each link."""
    w = Window.partitionBy("href").orderBy(key, "place")
    return found.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def host(url: Column) -> Column:
    return F.regexp_extract(url, "://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1)


def last_segment(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, "^[^?#]*", 0), "^.*/", "")


def stem(url: Column) -> Column:
    return F.regexp_replace(last_segment(url), "\\.[a-z]+$", "")


def normal_url(url: Column) -> Column:
    """https, no www., query kept, fragment dropped."""
    return F.concat(F.lit("https://"), F.regexp_replace(host(url), "^www\\.", ""), F.regexp_extract(url, "://[^/?#]*([^#]*)", 1))


def local_path(url: Column, noise: str) -> Column:
    """From the first segment that looks like a year, else the last three; one noise segment left out."""
    parts = F.filter(F.split(path(url), "/"), lambda p: (p != "") & (p != noise))
    years = F.filter(parts, lambda p: p.rlike("^(19|20)[0-9]{2}$"))
    at = F.array_position(parts, F.get(years, F.lit(0)))
    kept = F.when(F.size(years) > 0, F.slice(parts, F.greatest(at.cast("int"), F.lit(1)), F.greatest(F.size(parts), F.lit(1)))).otherwise(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)))
    return F.array_join(kept, "/")


@dataclass(frozen=True)
class Taxonomy:
    """What a file's name tells of its kind: beginnings before ends before directories before the default."""

    prefixes: list[tuple[str, str]] = field(default_factory=list)
    suffixes: list[tuple[str, str]] = field(default_factory=list)
    directories: list[tuple[str, str]] = field(default_factory=list)
    default: str = "other"


def classify(url: Column, taxonomy: Taxonomy) -> Column:
    """Struct (kind, kind_source)."""
    name = stem(url)
    out = F.when(F.lit(False), F.struct(F.lit("").alias("kind"), F.lit("").alias("kind_source")))
    tests = [(name.startswith(p), k, "prefix") for p, k in taxonomy.prefixes] + [(name.endswith(p), k, "suffix") for p, k in taxonomy.suffixes] + [(url.contains(p), k, "directory") for p, k in taxonomy.directories]
    for hit, kind, source in tests:
        out = out.when(hit, F.struct(F.lit(kind).alias("kind"), F.lit(source).alias("kind_source")))
    return out.otherwise(F.struct(F.lit(taxonomy.default).alias("kind"), F.lit("default").alias("kind_source")))


def completeness(listed: DataFrame, files: DataFrame, key: str, file_key: str, groups: list[str], content: str, end: str) -> DataFrame:
    """groups, listed, present, missing, chars, corrupt (files that lack the end mark)."""
    both = listed.join(files, listed[key] == files[file_key], "left")
    n = F.count(F.lit(1))
    return both.groupBy(*groups).agg(n.alias("listed"), F.count(file_key).alias("present"), (n - F.count(file_key)).alias("missing"), F.coalesce(F.sum(F.length(content).cast("long")), F.lit(0)).alias("chars"), F.count_if(~F.col(content).contains(end)).alias("corrupt"))


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, length of the files below a folder, read from the listing only."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "length")
