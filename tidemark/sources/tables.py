"""Reading and writing tables: declared schemas, JSON logs, upserts and idempotent appends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def written(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir and read again, which cuts its lineage; without such a folder, kept where it was computed."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df.persist()
    df.write.parquet(path := f"{folder}/written-{uuid.uuid4().hex}")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all machines share; in local mode, where it is unset, one of our own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        spark.conf.set("spark.checkpoint.dir", folder := tempfile.mkdtemp(prefix="spark-shared-"))
    return folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_log(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """An append-only log of JSON lines; strict: a line that doesn't fit the schema fails the read, else it is null."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A folder of whole-file JSON documents, with the file each came from."""
    return spark.read.schema(schema).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())


def tab_separated(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").csv(path)


def content_addressed(spark: SparkSession, path: str) -> DataFrame:
    """Files by the SHA-256 of what they hold."""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("sha256"), F.col("length").alias("byte_size"), "path")


def latest_upsert(base: DataFrame, changes: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The union of both with one row a key, that of the highest version; at equal versions a change wins."""
    both = base.withColumn("__new", F.lit(0)).unionByName(changes.withColumn("__new", F.lit(1)))
    order = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn", "__new")


def append_dedup(existing: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """What of incoming is to be appended: keys that aren't there yet, each once, the first by `order`."""
    first = Window.partitionBy(*keys).orderBy(order)
    once = incoming.withColumn("__rn", F.row_number().over(first)).filter("__rn = 1").drop("__rn")
    return once.join(existing.select(*keys).distinct(), keys, "left_anti")


def replace_children(df: DataFrame, path: str, parent: str) -> None:
    """Overwrite only the partitions of the parents that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(parent).parquet(path)


def put_objects(df: DataFrame, content: str, path: str) -> None:
    """Store the different contents of a column under their SHA-256, in folders by its first two digits; what is stored already stays. Null contents are none."""
    new = df.filter(F.col(content).isNotNull()).select(F.sha2(content, 256).alias("sha256"), F.col(content).alias("content")).dropDuplicates(["sha256"])
    spark = df.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        new = new.join(spark.read.parquet(path).select("sha256"), "sha256", "left_anti")
    new.withColumn("prefix", F.substring("sha256", 1, 2)).repartition("prefix").write.mode("append").partitionBy("prefix").parquet(path)


def rehashed(objects: DataFrame) -> DataFrame:
    """Stored objects with their size and whether their content still has the hash that names them."""
    return objects.withColumns({"byte_size": F.octet_length("content").cast("long"), "intact": F.sha2("content", 256) == F.col("sha256")})


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """df with `problems`, the names of the rules that hold for a row, each a condition of what must not be; a condition that is null doesn't hold."""
    return df.withColumn("problems", F.array_compact(F.array(*(F.when(broken, name) for name, broken in rules.items()))))


def write_banks(df: DataFrame, bank: str, path: str, more: Column | None = None) -> None:
    """Rows as JSON lines in a folder for each bank, led by a line that tells how many follow (plus `more`)."""
    n = df.groupBy(bank).agg(F.count(F.lit(1)).alias("__n"))
    lead = n.select(F.col(bank), F.lit(0).alias("__place"), F.to_json(F.struct(F.col(bank).alias("bank"), (F.col("__n") + (F.lit(0) if more is None else more)).alias("told"))).alias("value"))
    lines = df.select(F.col(bank), F.lit(1).alias("__place"), F.to_json(F.struct(*df.columns)).alias("value"))
    both = lead.unionByName(lines).withColumn("of", F.col(bank)).repartition("of").sortWithinPartitions("of", "__place")
    both.select("of", "value").write.partitionBy("of").text(path)


def read_banks(spark: SparkSession, path: str, bank: str, schema: str) -> DataFrame:
    """The rows of banks with `told`, what the bank's leading line says of their number; a bank with another than one such line raises an error. A line that isn't JSON is a row of nulls."""
    lines = spark.read.text(path)
    told = lines.select(F.from_json("value", "bank string, told long").alias("l"), F.col("of").alias("__of")).filter("l.told IS NOT NULL").select("__of", "l.told")
    counts = lines.select(F.col("of").alias("__of")).distinct().join(told.groupBy("__of").agg(F.count(F.lit(1)).alias("n")), "__of", "left").filter("n IS NULL OR n != 1")
    if not counts.isEmpty():
        raise ValueError(f"bank {counts.first()[0]} isn't led by one line that tells what follows")
    rows = lines.filter(F.get_json_object("value", "$.told").isNull()).select(F.col("of").alias("__of"), F.from_json("value", schema).alias("r"))
    return rows.join(told, "__of").select("r.*", "told")
