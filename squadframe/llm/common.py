"""Small helpers shared by the operators: work tables, two-level numbering, components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Everything that counts as white space in the operators: space and the controls 09 to 0D.
BLANKS = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir. A session in one process (tests) gets
    a temporary one where the setting is missing; a cluster must name one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        at = tempfile.mkdtemp(prefix="squadframe-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def work_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/work/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(*tables: DataFrame) -> None:
    """Deletes work tables that nothing reads any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/work/" in path:
                jvm = df.sparkSession._jvm
                at = jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Texts can be long: Python gets them in Arrow batches of a few rows, which bounds a task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n (null id: crc32 of the empty text, 0)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def running_offsets(df: DataFrame, group: str, order: list[str], amount: Column, out: str, buckets: int = 256) -> DataFrame:
    """Adds the exclusive running sum of amount within group, without sorting a whole group in one task.

    Rows are dealt to buckets by a hash of the order columns; each (group, bucket) is summed by a window, and the
    buckets' totals of a group (at most `buckets` numbers) give every bucket its start. The order is the one of
    (bucket, order columns), the same in every run. The group column must not be null.
    """
    b, start = f"{out}_bucket", f"{out}_start"
    within = Window.partitionBy(group, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    totals = (
        rows.groupBy(group, b).agg(F.sum(amount).alias("total"))
        .groupBy(group).agg(F.sort_array(F.collect_list(F.struct(b, "total"))).alias("all"))
        .select(group, F.explode(F.transform("all", lambda x, i: F.struct(x[b].alias(b), F.aggregate(F.slice("all", F.lit(1), i), F.lit(0).cast("long"), lambda s, y: s + y["total"]).alias(start)))).alias("x"))
        .select(group, f"x.{b}", f"x.{start}")
    )
    summed = rows.withColumn(out, F.coalesce(F.sum(amount).over(within), F.lit(0)).cast("long"))
    return summed.join(totals, [group, b]).withColumn(out, F.col(out) + F.col(start)).drop(b, start)


#: Keys of dropped rows up to this number are broadcast (under 100 bytes each), more are joined by a shuffle.
BROADCAST_KEYS = 200_000


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs that a decision table (doc_id, sum, kept) keeps, with all their columns.

    sum is xxhash64 of the text; decided has one row for each row of docs. Where rows repeat an id and a text, as many
    stay as decided has kept, one at most.
    """
    mixed = work_table(
        decided.groupBy("doc_id", "sum").agg(F.count("*").alias("n"), F.sum(F.col("kept").cast("int")).alias("k"))
        .where("k < n").select(F.col("doc_id").alias("_id"), F.col("sum").alias("_of"), "k"), "dropped")
    few = mixed.count() <= BROADCAST_KEYS
    hint = F.broadcast if few else (lambda x: x)
    names = docs.columns
    rows = docs.withColumn("_sum", F.xxhash64(text_col))
    same = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_sum") == F.col("_of"))
    out = rows.join(hint(mixed), same, "left_anti")
    once = mixed.where("k > 0")
    if not once.isEmpty():
        out = out.unionByName(rows.join(hint(once), same, "left_semi").dropDuplicates([id_col, "_sum"]))
    return out.select(*names)


#: Nodes with more links than this, and than one in so many of all links, are joined by a broadcast.
HEAVY, HEAVY_NODES = 100_000, 50_000


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of links (a, b): returns (node, root), root being the smallest node reachable.

    Large-star and small-star steps in turn, each a group minimum and a join on the node; they end when a round changes
    nothing. Nodes with very many links (at most twice HEAVY_NODES of them, so they are broadcast) are joined where
    their rows lie, so neither a hub nor the root of a large component meets in one task. Every round ends in a written
    table, and the one before is deleted. Nodes without a link are not listed.
    """
    spark = links.sparkSession
    pairs = work_table(
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "links")
    kind = pairs.schema["u"].dataType
    if pairs.isEmpty():
        return spark.createDataFrame([], f"node {kind.simpleString()}, root {kind.simpleString()}")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def with_least(rows: DataFrame, least: DataFrame, much: int) -> DataFrame:
        """rows (u, v) with the column m of least (u, n, m)."""
        heavy = F.broadcast(least.where(F.col("n") > much).select("u", F.col("m").alias("hm")))
        told = rows.join(heavy, "u", "left")
        some = told.where("hm is not null").select("u", "v", F.col("hm").alias("m"))
        return some.unionByName(told.where("hm is null").select("u", "v").join(least.where(F.col("n") <= much).select("u", "m"), "u"))

    before = mark(pairs)
    while True:
        much = max(HEAVY, before[0] // HEAVY_NODES)
        # large star: every neighbour above u moves to the least of u and its neighbours
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = work_table(both.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")).select("u", "n", F.least("u", "m").alias("m")), "least")
        large = work_table(with_least(both.where("v > u"), least, much).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        drop_tables(pairs, least)
        # small star: u and its lower neighbours move to the least of them
        least = work_table(large.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("m")), "least")
        near = with_least(large, least, much).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        pairs = work_table(near.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "pairs")
        drop_tables(large, least)
        now = mark(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
