"""Answers of stock-video searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What is read of the answers of the two kinds of providers.
FILES = "struct<videos:array<struct<duration:double,video_files:array<struct<width:int,height:int,link:string>>>>>"
SIZES = "struct<hits:array<struct<duration:double,videos:map<string,struct<width:int,height:int,url:string>>>>>"


def exact_renditions(answers: DataFrame, width: int, height: int, shortest: float, term: str = "term", body: str = "body") -> DataFrame:
    """SRC15: of each video of at least ``shortest`` seconds the first file of exactly the wanted size: (term, place, url, duration).

    Answers are JSON texts; one without ``videos``, or that does not parse, has none.
    """
    each = answers.select(term, F.posexplode(F.from_json(body, FILES)["videos"]).alias("place", "v")).where(F.col("v.duration") >= shortest)
    fits = F.filter("v.video_files", lambda f: (f["width"] == width) & (f["height"] == height))
    return each.withColumn("_f", F.get(fits, F.lit(0))).where("_f is not null").select(term, "place", F.col("_f.link").alias("url"), F.col("v.duration").alias("duration"))


def wide_renditions(answers: DataFrame, width: int, shortest: float, term: str = "term", body: str = "body") -> DataFrame:
    """SRC16: of each video of at least ``shortest`` seconds the first size, as the answer lists them, that is wide enough."""
    each = answers.select(term, F.posexplode(F.from_json(body, SIZES)["hits"]).alias("place", "v")).where(F.col("v.duration") >= shortest)
    fits = F.filter(F.map_values("v.videos"), lambda f: f["width"] >= width)
    return each.withColumn("_f", F.get(fits, F.lit(0))).where("_f is not null").select(term, "place", F.col("_f.url").alias("url"), F.col("v.duration").alias("duration"))


def new_materials(found: DataFrame, term_order: str = "term") -> DataFrame:
    """The found videos of all terms, each address once: where it came first, by term and place."""
    first = found.groupBy("url").agg(F.min_by(F.struct(term_order, "place", "duration"), F.struct(term_order, "place")).alias("_f"))
    return first.select("url", f"_f.{term_order}", "_f.place", "_f.duration")
