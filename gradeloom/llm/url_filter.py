"""URL filter: rules first, then logistic regression on hashed character n-grams of host and path.

A rule is a host with a path prefix; it fits the host and all its subdomains if the path starts with
the rule's path, and the longest rule wins. A url that no rule fits gets the verdict of a logistic
regression over hashed character n-grams, trained from a small labelled table of urls (a parameter;
the default is the fixed table below). Everything runs as DataFrame and JVM-side ML operations.

Labelled rows without a label are left out; with labels of one kind only every score is that label.

Defined cases: a null url, or one without ://, has an empty host and path, fits no rule and is judged
on its empty n-grams; urls of any length are judged whole; repeated rows are judged each; an empty table gives an empty table; input columns
that clash with an output column are replaced by it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import with_outputs

OUTPUTS = ["host", "path", "rule", "score", "verdict"]
#: Verdict, host, path.
RULES = [
    ("block", "com", "en/"),
    ("allow", "example.com", "en/7"),
    ("allow", "net", "de/"),
    ("block", "example.net", "de/8"),
    ("block", "org", "es/"),
]
#: The labelled urls, 1 to block.
LABELLED = [
    ("https://ads.example.com/click?id=1", 1), ("https://ad-server.example.net/banner/728x90", 1), ("http://track.example.org/pixel.gif", 1),
    ("http://casino-bonus.example.com/free-spins", 1), ("https://best-poker.example.net/bonus/play-now", 1), ("http://win-prize.example.org/claim-now", 1),
    ("http://cheap-pills.example.com/buy-online", 1), ("https://viagra-shop.example.net/order", 1), ("http://replica-watches.example.org/sale/90-off", 1),
    ("http://adult-cams.example.com/live", 1), ("https://xxx-tube.example.net/videos/123", 1), ("http://hot-dating.example.org/signup?aff=9", 1),
    ("http://login-verify.example.com/account/confirm.php", 1), ("https://secure-update.example.net/wp-content/plugins/bank/login.php", 1), ("http://free-gift-cards.example.org/generator", 1),
    ("http://crack-keygen.example.com/download.exe", 1), ("https://torrent-mirror.example.net/get/full-movie-free", 1), ("http://popunder.example.org/redirect.php?to=offer", 1),
    ("http://seo-links.example.com/buy-backlinks", 1), ("https://loan-fast.example.net/payday/apply-now", 1), ("http://crypto-double.example.org/invest/profit", 1),
    ("https://affiliate.example.com/go/offer-77", 1), ("http://spam-blog.example.net/tag/cheap-cheap-cheap", 1), ("https://clickbait.example.org/you-wont-believe", 1),
    ("https://docs.example.com/guide/install", 0), ("https://news.example.net/fr/2021/05/article-204", 0), ("http://www.example.org/en/history/of-science", 0),
    ("https://blog.example.com/fr/1204", 0), ("https://m.example.net/en/77", 0), ("http://library.example.org/de/catalogue/4411.html", 0),
    ("https://wiki.example.com/es/astronomy", 0), ("https://www.example.net/fr/88.html", 0), ("http://university.example.org/courses/algebra", 0),
    ("https://forum.example.com/de/topic/31", 0), ("https://recipes.example.net/es/soup", 0), ("http://museum.example.org/en/exhibits/2", 0),
    ("https://blog.example.org/de/512?page=2", 0), ("https://m.example.com/es/9041#top", 0), ("http://travel.example.net/en/cities/lisbon", 0),
    ("https://code.example.com/project/readme", 0), ("https://weather.example.net/fr/today", 0), ("http://journal.example.org/fr/volume/12/issue/3", 0),
    ("https://school.example.com/fr/lesson/7", 0), ("https://garden.example.net/es/plants/roses", 0), ("http://health.example.org/en/topics/sleep", 0),
    ("https://music.example.com/de/scores/44", 0), ("https://photos.example.net/en/gallery/15", 0), ("http://archive.example.org/de/1998/06/02", 0),
]


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end, with its slash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: (-len(r[1] + "/" + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        value = F.struct(F.lit(f"{h}/{p if p != 'None' else ''}").alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def with_grams(df: DataFrame, lengths: tuple[int, ...] = (3, 4)) -> DataFrame:
    """Adds _grams, the character n-grams of the columns host and path, each marked with its part.

    The characters are a column of their own, so that the work grows with the url's length and not its square."""

    def of(name: str, chars: str, n: int) -> Column:
        starts = F.slice(chars, 1, F.greatest(F.size(chars) - (n - 1), F.lit(0)))
        return F.transform(starts, lambda c, i: F.concat(F.lit(name), c, *[F.get(chars, i + k) for k in range(1, n)]))

    framed = lambda part: F.split(F.concat(F.lit("^"), F.col(part), F.lit("$")), "")
    df = df.withColumn("_h", framed("host")).withColumn("_p", framed("path"))
    return df.withColumn("_grams", F.concat(*[of(name, chars, n) for name, chars in (("h:", "_h"), ("p:", "_p")) for n in lengths])).drop("_h", "_p")


def train(spark: SparkSession, labelled: list[tuple[str, int]] | DataFrame = LABELLED, features: int = 1 << 14, l2: float = 0.02):
    """The regression and its hashing step, fitted to the labelled urls."""
    rows = lambda: F.explode(F.array(*[F.struct(F.lit(u).alias("url"), F.lit(y).alias("label")) for u, y in labelled]))
    table = labelled if isinstance(labelled, DataFrame) else spark.range(1).select(rows().alias("_r")).select("_r.*")
    hashing = HashingTF(inputCol="_grams", outputCol="_x", numFeatures=features, binary=True)
    parts = table.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("label").cast("double").alias("label")).where("label is not null")
    x = hashing.transform(with_grams(parts).select("_grams", "label").coalesce(1))
    return hashing, LogisticRegression(featuresCol="_x", labelCol="label", regParam=l2, maxIter=50, rawPredictionCol="_raw", probabilityCol="_prob", predictionCol="_pred").fit(x)


def judge(pages: DataFrame, url: str = "url", rules: list[tuple[str, str, str]] = RULES, model=None) -> DataFrame:
    """The input's columns with host, path, rule, score (of blocking) and verdict."""
    hashing, regression = model or train(pages.sparkSession)
    df = pages.select(F.struct("*").alias("_row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    df = with_grams(df.withColumn("_best", best_rule(F.col("host"), F.col("path"), rules)))
    df = regression.transform(hashing.transform(df))
    df = df.withColumn("score", vector_to_array("_prob")[1]).withColumn("rule", F.col("_best")["rule"])
    df = df.withColumn("verdict", F.coalesce(F.col("_best")["verdict"], F.when(F.col("score") >= 0.5, "block").otherwise("allow")))
    return df.select(with_outputs("_row", pages.columns, OUTPUTS))
