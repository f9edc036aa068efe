"""Reading sources, ground truth, prepared tables and id files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from samewise import schema
from samewise.functions.normalize import country, prepare


def _filled(df: DataFrame) -> DataFrame:
    """Text that is missing is ``''``, never NULL."""
    return df.select([F.coalesce(F.col(f.name), F.lit("")).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema])


def read_tsv(spark: SparkSession, path: str | list[str], fields: T.StructType = schema.SOURCE, recursive: bool = False) -> DataFrame:
    """A tab-separated file with a header, all columns text, nothing quoted, nothing inferred.

    ``recursive`` searches the folders below a path. Empty fields are ``''``; words such as ``null`` stay words.
    """
    reader = spark.read.schema(fields).options(sep="\t", header="true", quote="", escape="", nullValue="\0", emptyValue="", enforceSchema="true", encoding="UTF-8")
    return _filled((reader.option("recursiveFileLookup", "true") if recursive else reader).csv(path))


def source_path(root: str, split: str, number: int, nested: bool = True) -> str:
    """Where a source of a split lies: in a folder of the split, or flat."""
    name = f"{split}_source{number}.tsv"
    return f"{root}/{split}/{name}" if nested else f"{root}/{name}"


def find_source(spark: SparkSession, root: str, split: str, number: int) -> str | None:
    """The nested file, else the flat one, else the first found below ``root``; None if there is none."""
    jvm = spark._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    there = lambda p: (h := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(h)
    for nested in (True, False):
        if there(source_path(root, split, number, nested)):
            return source_path(root, split, number, nested)
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(conf)
    if not fs.exists(base):
        return None
    files, found = fs.listFiles(base, True), []
    while files.hasNext():
        p = files.next().getPath()
        if p.getName() == f"{split}_source{number}.tsv":
            found.append(p.toString())
    return min(found, default=None)


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    return read_tsv(spark, path, schema.TRUTH)


def write_prepared(df: DataFrame, path: str, variant: str = "g2") -> None:
    """Prepare and store a source, one folder for each country; a table that is there already stays as it is."""
    prepare(df, variant).withColumn("land", F.col("country")).write.mode("ignore").partitionBy("land").parquet(path)


def load_prepared(spark: SparkSession, path: str, columns: list[str] | None = None, land: str | None = None) -> DataFrame:
    """Some columns of a prepared table, perhaps of one country; only what is asked for is read."""
    df = spark.read.schema(T.StructType([*schema.PREPARED.fields, T.StructField("land", T.StringType())])).parquet(path)
    if land is not None:
        df = df.where(F.col("land") == land)
    return df.select(*(columns or [f.name for f in schema.PREPARED.fields]))


def pool(*sources: DataFrame) -> DataFrame:
    """Several sources as one."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s)
    return out


def source_table(spark: SparkSession, path: str) -> DataFrame:
    """A source stored as Parquet, perhaps with repeated ids and NULLs: one row per id, text never NULL."""
    raw = df = spark.read.parquet(path)
    late = [(-F.unix_micros(F.col("loaded_at").cast("timestamp"))).alias("__late")] if "loaded_at" in df.columns else []
    df = df.where(F.col("entity_id").isNotNull())
    keep = [F.coalesce(c, F.lit("")).alias(c) for c in ("business_name", "business_address", "country")]
    rows = df.select("entity_id", F.struct(*late, *keep).alias("r")).groupBy("entity_id").agg(F.min("r").alias("r"))
    if raw.rdd.getNumPartitions() < (cores := spark.sparkContext.defaultParallelism):
        rows = rows.repartition(cores)  # a small table: what follows is dear for each row and should use all cores
    return rows.select("entity_id", "r.business_name", "r.business_address", country(F.col("r.country")).alias("country"))


def read_id_set(spark: SparkSession, path: str) -> DataFrame:
    """``id``: the distinct first fields of a tab-separated file, without its header, blank lines and white space around."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("n"))
    first = F.trim(F.get(F.split("value", "\t"), F.lit(0)))
    head = lines.where("at = 0").agg(F.min("n").alias("n"))
    return lines.join(F.broadcast(head), "n", "left_anti").where(F.trim("value") != "").select(first.alias("id")).where("id <> ''").distinct()
