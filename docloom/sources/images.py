"""Images embedded in markdown as data URIs: taken out, numbered, and stored once each by their content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LINK = r"!\[([^\]]*)\]\(data:image/([^)]+)\)"


def placeholders(text: Column, mark: str = "[IMAGE]") -> Column:
    """``text`` with ``mark`` for each embedded image."""
    return F.regexp_replace(text, _LINK, mark)


def _found(text: Column) -> Column:
    """The embedded images in order: alternative text, format, bytes - null where they are not base64 - and the link as it stands."""
    part = lambda k: F.regexp_extract_all(text, F.lit(_LINK), F.lit(k))
    uri = lambda u: F.substring_index(u, ",", 1)
    data = lambda u: F.when(u.contains(","), F.try_to_binary(F.substr(u, F.instr(u, ",") + 1), F.lit("base64")))
    return F.transform(
        F.arrays_zip(part(0).alias("link"), part(1).alias("alt"), part(2).alias("uri")),
        lambda x: F.struct(x["link"].alias("link"), x["alt"].alias("alt"), F.substring_index(uri(x["uri"]), ";", 1).alias("format"), data(x["uri"]).alias("bytes")),
    )


def extracted(docs: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """(``docs`` with links to image files instead of data URIs, images).

    Images have the columns of ``docs`` but the text, and ``image`` (their number in the text, from 1), ``name``,
    ``alt``, ``format``, ``sha256``, ``n_bytes`` and ``bytes``. A link whose data cannot be decoded stays
    as it is and has no number. All in columns: no Python, no shuffle.
    """
    names = [c for c in docs.columns if c != text]
    found = docs.withColumn("_images", _found(F.col(text)))
    good = F.filter("_images", lambda x: x["bytes"].isNotNull())
    rows = found.select(*names, F.posexplode(good).alias("_pos", "_i"))
    file = lambda n, kind: F.concat(F.lit("image_"), n.cast("string"), F.lit("."), kind)
    number = F.col("_pos") + 1
    images = rows.select(
        *names, number.alias("image"), file(number, F.col("_i.format")).alias("name"), "_i.alt", "_i.format", F.sha2("_i.bytes", 256).alias("sha256"), F.octet_length("_i.bytes").alias("n_bytes"), "_i.bytes"
    )
    before = lambda k: F.size(F.filter(F.slice("_images", F.lit(1), k + 1), lambda y: y["bytes"].isNotNull()))
    link = F.transform("_images", lambda x, k: F.when(x["bytes"].isNull(), x["link"]).otherwise(F.concat(F.lit("!["), x["alt"], F.lit("]("), file(before(k), x["format"]), F.lit(")"))))
    between = F.split(F.col(text), _LINK, -1)
    whole = F.array_join(F.zip_with(between, link, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return found.withColumn(text, whole).drop("_images"), images


def store(images: DataFrame, folder: str, digits: int = 2) -> None:
    """Add images to a content-addressed folder: each SHA-256 is there once, what is there already is not written again.

    A directory holds the images whose digests begin with the same ``digits`` digits, one file of them for each call; with 64 every
    image has a file of its own.
    """
    spark = images.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    once = images.select("sha256", "format", "bytes").groupBy("sha256").agg(F.min(F.struct("format", "bytes")).alias("x")).select("sha256", "x.*")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        once = once.join(stored(spark, folder).select("sha256"), "sha256", "left_anti")
    once.withColumn("prefix", F.substring("sha256", 1, digits)).repartition("prefix").write.partitionBy("prefix").mode("append").parquet(folder)


def stored(spark, folder: str) -> DataFrame:
    """(sha256, format, bytes) of the images in a folder."""
    return spark.read.schema("sha256 string, format string, bytes binary, prefix string").parquet(folder).drop("prefix")
