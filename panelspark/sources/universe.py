"""The ticker dimension: sectors, sector codes and the universe document."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from panelspark.schema import UNIVERSE_DOCUMENT


def from_sector_lists(spark: SparkSession, sectors: dict) -> DataFrame:
    """(ticker, sector, sector_code) from a mapping of sector to tickers."""
    rows = [(sector, list(tickers)) for sector, tickers in sectors.items()]
    lists = spark.createDataFrame(rows, "sector string, tickers array<string>")
    return with_sector_codes(lists.select(F.explode("tickers").alias("ticker"), "sector").distinct())


def with_sector_codes(universe: DataFrame) -> DataFrame:
    """Add ``sector_code``: the 0-based rank of the sector name.

    The rank runs over the distinct sector names, a short list, and is joined back.
    """
    names = universe.select("sector").distinct()
    codes = names.withColumn("sector_code", (F.row_number().over(Window.orderBy("sector")) - 1).cast("int"))
    return universe.join(codes, "sector").select("ticker", "sector", "sector_code")


def read_universe(spark: SparkSession, path) -> DataFrame:
    """A universe JSON document as (ticker, sector, sector_code)."""
    doc = spark.read.schema(UNIVERSE_DOCUMENT).option("multiLine", True).json(path)
    pairs = doc.select(F.explode("sectors").alias("sector", "tickers"))
    return with_sector_codes(pairs.select(F.explode("tickers").alias("ticker"), "sector").distinct())


def all_tickers(universe: DataFrame) -> DataFrame:
    return universe.select("ticker").distinct().orderBy("ticker")


def sector_counts(universe: DataFrame) -> DataFrame:
    """Tickers per sector, largest first."""
    return universe.groupBy("sector").agg(F.countDistinct("ticker").alias("n_tickers")) \
        .orderBy(F.desc("n_tickers"), "sector")


def universe_document(universe: DataFrame, benchmarks, start_date, end_date, description="") -> DataFrame:
    """The universe as one nested row. A ticker list fits a document by its nature (a few thousand names)."""
    lists = universe.groupBy("sector").agg(F.sort_array(F.collect_set("ticker")).alias("tickers"))
    return lists.agg(
        F.sort_array(F.flatten(F.collect_list("tickers"))).alias("tickers"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("sector", "tickers")))).alias("sectors"),
    ).select(
        F.lit(description).alias("description"),
        F.lit(str(start_date)).alias("start_date"), F.lit(str(end_date)).alias("end_date"),
        F.size("tickers").cast("long").alias("n_tickers"), "tickers",
        F.array(*[F.lit(b) for b in benchmarks]).alias("benchmarks"), "sectors",
        F.map_from_entries(F.flatten(F.transform(
            F.map_entries("sectors"),
            lambda e: F.transform(e["value"], lambda t: F.struct(t.alias("key"), e["key"].alias("value"))),
        ))).alias("sector_map"),
    )
