"""Files in and out: JSON lines, JSON objects by key, CSV, lists, YAML, partitioned sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def require(spark: SparkSession, *paths: str) -> None:
    """FileNotFoundError that names the paths that don't exist, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    gone = [p for p in paths if not (q := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(q)]
    if gone:
        raise FileNotFoundError(f"missing: {', '.join(gone)}")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_json_map(spark: SparkSession, path: str, value: str, key: str = "key") -> DataFrame:
    """(key, value) of a file that holds one object."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "value"))


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON array of records."""
    return spark.read.schema(schema).json(path, multiLine=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def read_list(spark: SparkSession, path: str, name: str = "value") -> DataFrame:
    """One trimmed value on each line; empty lines go."""
    return spark.read.text(path).select(F.trim("value").alias(name)).where(F.col(name) != "")


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """(name, text): whole files by the stem of their name."""
    text = spark.read.text(path, wholetext=True)
    return text.select(file_stem(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("text"))


def file_stem(path):
    """The file's name without folders and suffix, before an _Eval or _HEEval if it has one."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1), r"_(?:HE)?Eval.*$", "")


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A small config file, as a record on the driver."""
    import yaml

    return yaml.safe_load(spark.read.text(path, wholetext=True).first()[0])


def write_by(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    """JSON lines in a folder for each value; one shuffle puts a value's rows together, split by AQE if they are many."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).json(path)


def write_split(df: DataFrame, path: str, name: str) -> None:
    """name.jsonl and name_val.jsonl, folders of JSON lines, from the column split."""
    val = F.coalesce(F.col("split") == "val", F.lit(False))
    for own, suffix in ((~val, ""), (val, "_val")):
        df.where(own).drop("split").write.mode("overwrite").json(f"{path}/{name}{suffix}.jsonl")


def write_json_object(df: DataFrame, path: str, key: str, *, whole: bool = False) -> None:
    """One JSON object a row and line, {key: rest}; ``whole``: one object of all rows, nested by key, which is for tables that fit one task."""
    rest = [c for c in df.columns if c != key]
    if whole:
        one = df.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string"), F.struct(*rest)))))).alias("value"))
        one.write.mode("overwrite").text(path)
        return
    entry = F.to_json(F.map_from_arrays(F.array(F.col(key).cast("string")), F.array(F.struct(*rest))))
    df.select(entry.alias("value")).write.mode("overwrite").text(path)


def flat_runs(df: DataFrame, run: str, metrics: str) -> DataFrame:
    """A row for each run with its metrics map as columns of one JSON record."""
    return df.select(F.to_json(F.map_concat(F.create_map(F.lit("run_name"), F.col(run)), F.col(metrics))).alias("value"))
