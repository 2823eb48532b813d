"""URL filter: host and path rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapewright.llm.columns import ascii_lower

# Rules as verdict, host, path.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

# The labelled table of the default model: 1 is a page to block.
LABELLED = [
    ("https://docs.python.example.org/library/index.html", 0),
    ("https://en.encyclopedia.example.org/article/Photosynthesis", 0),
    ("https://www.university.example.edu/courses/algebra/", 0),
    ("https://blog.gardening.example.net/2021/05/tomatoes", 0),
    ("https://news.example.org/world/2020/election", 0),
    ("https://www.library.example.org/catalogue?page=2", 0),
    ("https://health.gov.example.org/advice/sleep.html", 0),
    ("https://forum.cycling.example.net/thread/4512", 0),
    ("https://recipes.example.org/de/12440", 0),
    ("https://m.weather.example.net/en/7198", 0),
    ("https://museum.example.org/fr/25930", 0),
    ("https://journal.physics.example.org/es/26123", 0),
    ("https://travel.example.net/de/39547.html", 0),
    ("https://opensource.example.org/wiki/Compiler", 0),
    ("https://history.example.net/en/35332/", 0),
    ("https://shop.books.example.org/en/12213", 0),
    ("https://best-casino-bonus.example.net/free-spins", 1),
    ("https://www.poker-slots.example.org/win-cash-now.html", 1),
    ("https://xxx-videos.example.net/hot/porn", 1),
    ("https://adult-webcam.example.org/sex-chat/", 1),
    ("https://cheap-viagra-pills.example.net/buy", 1),
    ("https://online-pharmacy-rx.example.org/order/cialis", 1),
    ("https://free-crack-keygen.example.net/download.exe", 1),
    ("https://warez-torrent.example.org/full-movie-download", 1),
    ("https://login-verify-account.example.net/secure/update-password", 1),
    ("https://ad.doubletracker.example.org/click?banner=1", 1),
    ("https://payday-loan-fast.example.net/apply-now", 1),
    ("https://replica-watches.example.org/cheap-rolex", 1),
    ("https://work-from-home-cash.example.net/earn-money-fast", 1),
    ("https://betting-jackpot.example.org/casino/slots", 1),
    ("https://escort-girls.example.net/xxx/adult", 1),
    ("https://miracle-weight-loss.example.org/diet-pills", 1),
]

GRAM_SIZES = (3, 4, 5)
FEATURES = 1 << 14


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _by_rule(rules: list[tuple[str, str, str]], value) -> Column:
    """``value(verdict, host, path)`` of the longest rule that fits, else null. Rules are a parameter of a few rows."""
    out = F.lit(None).cast("string")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == rule_host) | F.col("host").endswith("." + rule_host)) & F.col("path").startswith(rule_path)
        out = F.when(fits, F.lit(value(verdict, rule_host, rule_path))).otherwise(out)
    return out


def _grams_of(framed: Column, mark: str, n: int) -> Column:
    last = F.length(framed) - (n - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.concat(F.lit(mark), F.substring(framed, k, F.lit(n))))


def _grams() -> Column:
    """Character n-grams of host and path with marked ends, told apart by their first character."""
    return F.concat(
        *[_grams_of(F.concat(F.lit("^"), F.lower(column), F.lit("$")), mark, n) for mark, column in (("h", "host"), ("p", "path")) for n in GRAM_SIZES]
    )


def _featured(urls: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features", binary=True).transform(urls.withColumn("grams", _grams()))


def labelled_urls(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LABELLED, "url string, label int")


def train(labelled: DataFrame) -> LogisticRegressionModel:
    """A model from a small table of ``url`` and ``label`` (1: block); rows with a null in either are left out."""
    known = labelled.select("url", F.col("label").cast("double").alias("label")).dropna()
    rows = _featured(known.select(host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), "label"))
    return LogisticRegression(maxIter=50, regParam=0.01, featuresCol="features", labelCol="label").fit(rows)


def judge(
    pages: DataFrame, labelled: DataFrame | None = None, rules: list[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url"
) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, p_block.

    The longest rule (host and path together) that fits decides; a rule fits its host and the hosts below it if the
    path starts with the rule's. Where none fits, ``p_block`` of at least 0.5 blocks. A null URL or one without
    ``://`` has empty host and path and is judged by the model like any other. Repeated rows and null ids each get
    their row; an empty table gives none; further columns play no part.
    """
    model = train(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    urls = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("_url")).select(
        "page_id", host(F.col("_url")).alias("host"), path(F.col("_url")).alias("path")
    )
    scored = model.transform(_featured(urls)).withColumn("p_block", vector_to_array("probability")[1])
    ruled = scored.withColumn("rule", _by_rule(rules, lambda v, h, p: h + p)).withColumn("decided", _by_rule(rules, lambda v, h, p: v))
    learned = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return ruled.select("page_id", "host", "path", "rule", F.coalesce("decided", learned).alias("verdict"), "p_block")
