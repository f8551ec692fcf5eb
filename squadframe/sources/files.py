"""Match and metric files as DataFrames, and tables written as JSON lines or CSV."""

from __future__ import annotations

import re
import tempfile
import unicodedata
import uuid
import warnings

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_STATS = "kills assists teamKills damageToPlayer damageToPlayerBasic damageToPlayerSkill damageToPlayerItemSkill damageToPlayerDirect damageToPlayerUniqueSkill damageFromPlayer damageFromPlayerBasic damageFromPlayerSkill ccCount ccTime healAmount protectAbsorb visionScore".split()
_PLAYER = (
    "struct<character: int, weapon: int, gameRank: int, traits: struct<core: string, firstSub: string, secondSub: string, tacticalSkill: string, tacticalSkillLevel: int>, "
    f"stats: struct<{', '.join(f'{x}: double' for x in _STATS)}>>"
)
#: What is read of a match file; fields beyond it are ignored, missing ones are null.
MATCHES = (
    "teams array<struct<gameId: bigint, teamKey: string, rank: int, victory: boolean, tierBucket: string, fineBucket: string, sourceRankMmr: double, "
    f"matchingMode: int, matchingTeamMode: int, seasonId: int, collectedAt: string, players: array<{_PLAYER}>>>"
)
METRICS = ["difficulty", "damage", "defense", "crowdControl", "mobility", "utility"]


def one_or_many(raw: Column) -> Column:
    """A field that holds a value or an array of values, read as text, as an array; empty for null."""
    many = F.from_json(raw, "array<string>")
    return F.when(raw.isNull() | (raw == ""), F.array().cast("array<string>")).when(raw.startswith("["), F.coalesce(many, F.array(raw))).otherwise(F.array(raw))


def match_teams(spark: SparkSession, *paths: str) -> DataFrame:
    """Teams of the match files, the first path's row where several hold a (gameId, teamKey), then the first in its file.

    A path that is not there is left out with a warning; a file that is no JSON and teams without a game or key give no
    row. Only the key and the place are compared.
    """
    if not paths:
        raise ValueError("no match file")
    found = None
    for n, path in enumerate(paths):
        if not exists(spark, path):
            warnings.warn(f"no match file at {path}", stacklevel=2)
            continue
        one = spark.read.schema(MATCHES).option("multiLine", True).json(path).select(F.lit(n).alias("nth"), F.input_file_name().alias("file"), F.posexplode("teams").alias("at", "team"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        return spark.createDataFrame([], MATCHES).select(F.explode("teams").alias("team")).select("team.*")
    kept = found.where("team.gameId is not null and team.teamKey is not null").groupBy("team.gameId", "team.teamKey").agg(F.min_by("team", F.struct("nth", "file", "at")).alias("team"))
    return kept.select("team.*")


def match_players(teams: DataFrame) -> DataFrame:
    """One row for each player of the teams, with traits as arrays."""
    rows = teams.select("gameId", "teamKey", "rank", "tierBucket", F.explode("players").alias("p"))
    sub = lambda x: one_or_many(F.col(f"p.traits.{x}")).alias(x)
    return rows.select("gameId", "teamKey", "rank", "tierBucket", "p.character", "p.weapon", "p.traits.core", sub("firstSub"), sub("secondSub"), "p.traits.tacticalSkill", "p.stats.*")


def metrics_csv(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """id, name and six metrics of a CSV with a header (a byte order mark is skipped); blank rows are left out.

    A header without all columns raises. Rows with a metric other than an integer from 1 to 5 raise when they are read
    (strict), or are left out, as are rows without an id.
    """
    rows = spark.read.option("header", True).option("escape", '"').csv(path)
    rows = rows.toDF(*[c.removeprefix("\ufeff").strip() for c in rows.columns])
    if missing := [c for c in ("id", "name", *METRICS) if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rows = rows.dropna("all")
    good = lambda c: F.coalesce(F.trim(c).rlike("^[1-5]$"), F.lit(False))
    whole = [F.when(good(c), F.trim(c).cast("int")).otherwise(F.raise_error(F.concat(F.lit(f"{c} of "), F.coalesce("id", F.lit("?")), F.lit(" is no number from 1 to 5"))) if strict else F.lit(None)).cast("int").alias(c) for c in METRICS]
    out = rows.select(F.trim("id").alias("id"), F.trim("name").alias("name"), *whole)
    return out if strict else out.where("id <> ''").dropna(subset=METRICS)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something is at a path of any file system that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(at))


def pages(spark: SparkSession, folder: str, rows_column: str, most: int, schema: str) -> DataFrame:
    """Rows of the numbered pages 1.json, 2.json, ... of a folder up to the first empty or missing one, `most` at most."""
    found, n, page = None, 0, 1
    while n < most and exists(spark, f"{folder}/{page}.json"):
        one = spark.read.schema(f"{rows_column} array<struct<{schema}>>").option("multiLine", True).json(f"{folder}/{page}.json").select(F.lit(page).alias("page"), F.posexplode(rows_column).alias("at", "row"))
        if not (size := one.count()):
            break
        found, n, page = one if found is None else found.unionByName(one), n + size, page + 1
    if found is None:
        return spark.createDataFrame([], f"page int, at int, row struct<{schema}>").select("page", "at", "row.*")
    return found.orderBy("page", "at").limit(most).select("page", "at", "row.*")


def stored_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per file as columns; what is no object, or a missing path, gives the schema's nulls or no row."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.text(path, wholetext=True).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("x")).select("x.*")


def swap_table(spark: SparkSession, name: str, path: str) -> None:
    """A table name that from now on reads the Parquet files at path; what was kept of the one before is given up."""
    if spark.catalog.tableExists(name):
        spark.catalog.uncacheTable(name)
    spark.read.parquet(path).createOrReplaceTempView(name)




@F.pandas_udf(StringType())
def nfkc(names: pd.Series) -> pd.Series:
    """Compatibility forms of characters as their plain ones; Spark has no function for it."""
    return names.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the one that the session shares (spark.checkpoint.dir). A session in one process gets a
    temporary folder if the setting is missing; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        at = tempfile.mkdtemp(prefix="squadframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: what builds on it has a short plan, and a lost executor costs
    no recomputation."""
    path = shared_folder(df.sparkSession, f"tables/{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_json_lines(df: DataFrame, path: str, *partitions: str) -> None:
    """One JSON object a row, nulls included."""
    df.write.mode("overwrite").option("ignoreNullFields", False).partitionBy(*partitions).json(path)


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header, which starts with a byte order mark if wanted."""
    if mark:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Replaces the partitions that df has rows of; all others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    """Adds rows to a log; nothing in it is changed."""
    df.write.mode("append").parquet(path)


def newest_rows(spark: SparkSession, path: str, schema: str, keys: list[str], at: str) -> DataFrame:
    """The newest row of each key in a log that append_rows writes: what is stored after inserts and replacements. Equal
    times are decided by the other columns, a null time is the oldest; a log that is not there holds nothing."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(path)
    rest = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(at, *[c for c in rest if c != at])).alias("newest")
    return rows.groupBy(*keys).agg(newest).select(*keys, "newest.*").select(*rows.columns)


def not_stored(wanted: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """The wanted rows whose key is not stored yet: what has to be fetched."""
    return wanted.join(stored.select(*keys), keys, "left_anti")


def write_breakdown(df: DataFrame, path: str, key: str) -> None:
    """Rows as JSON lines, and beside them the number of rows of each value of key."""
    write_json_lines(df, f"{path}/rows")
    write_json_lines(df.groupBy(key).agg(F.count("*").alias("rows")), f"{path}/breakdown")


def json_paths(df: DataFrame, column: str) -> DataFrame:
    """The keys of a column of flat JSON objects: path, rows that have it, rows where it is a number, least and most."""
    each = df.select(F.explode(F.from_json(column, "map<string,string>")).alias("path", "value"))
    number = F.expr("try_cast(value as double)")
    return each.groupBy("path").agg(F.count("*").alias("n"), F.count(number).alias("n_numeric"), F.min(number).alias("least"), F.max(number).alias("most"))
