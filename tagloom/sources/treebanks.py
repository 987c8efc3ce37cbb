"""Finding treebanks and their splits by file name; contents aren't read."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str, pattern: str = "*-ud-*.conllu") -> DataFrame:
    """file, name, size of all files under ``path`` whose names match ``pattern``."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return f.select(F.col("path").alias("file"), F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.col("length").alias("size"))


def discover_treebanks(spark: SparkSession, path: str, language: str | None = None, limit: int | None = None, pattern: str = "*-ud-*.conllu") -> DataFrame:
    found = list_files(spark, path, pattern)
    if language:
        found = found.filter(F.lower("name").contains(language.lower()))
    return found.orderBy("name").limit(limit) if limit else found


def find_splits(files: DataFrame) -> DataFrame:
    """split, file: of each of train, dev and test the best match: ``*ud-S.conllu``, then
    ``*-S.conllu``, then ``S.conllu``, then XML; ties by name."""
    split = F.regexp_extract("name", r"(?:^|-)(train|dev|test)\.[^.]+$", 1)
    rank = F.when(F.col("name").rlike(r"ud-(train|dev|test)\.conllu$"), 0).when(F.col("name").rlike(r"-(train|dev|test)\.conllu$"), 1).when(F.col("name").rlike(r"^(train|dev|test)\.conllu$"), 2).otherwise(3)
    f = files.withColumns({"split": split, "rank": rank}).filter("split <> ''")
    return f.groupBy("split").agg(F.min_by("file", F.struct("rank", "name", "file")).alias("file"))
