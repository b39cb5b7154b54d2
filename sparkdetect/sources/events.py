"""Event tables in and out; technique catalogues; result tables and the coverage layer."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RAW = "timestamp string, source string, event_type string, host string, user string, fields string, labels map<string,string>, run_id string, scenario_id string, event_id string"
_MAP = "map<string,variant>"


def _typed(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({"ts": F.to_timestamp("timestamp"), "fields": F.coalesce(F.try_parse_json("fields").cast(_MAP), F.map_from_arrays(F.array(), F.array()).cast(_MAP))})
    rows = rows.withColumns({"run_id": F.coalesce("run_id", F.lit("")), "scenario_id": F.coalesce("scenario_id", F.lit(""))}).drop("timestamp")
    return labelled(rows.withColumn("event_id", F.coalesce("event_id", event_id())))


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """JSON lines of events: ISO timestamps, ``fields`` an object of any values, ``labels`` an object of texts. Missing ids are made from the content."""
    reader = spark.readStream if streaming else spark.read
    return _typed(reader.schema(RAW).json(path))


def read_event_table(spark: SparkSession, path: str, streaming: bool = False, schema=None) -> DataFrame:
    """A Parquet table written by ``write_table``, or a flat one."""
    return spark.readStream.schema(schema).parquet(path) if streaming else spark.read.parquet(path)


def event_id(fields: str = "fields") -> Column:
    """16 hex digits from the content, with sorted fields: equal content, equal id."""
    entries = F.array_sort(F.transform(F.map_entries(fields), lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v"))))
    labels = F.array_sort(F.transform(F.map_entries(F.coalesce("labels", F.map_from_arrays(F.array(), F.array()).cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    return F.substring(F.sha2(F.to_json(F.struct(F.col("ts").alias("t"), "source", "event_type", "host", "user", entries.alias("fields"), labels.alias("labels"))), 256), 1, 16)


def with_event_id(events: DataFrame) -> DataFrame:
    return events.withColumn("event_id", event_id())


def labelled(events: DataFrame) -> DataFrame:
    """technique_id and tactic from the labels; an event is malicious if the label map has the key technique_id."""
    has = F.coalesce(F.map_contains_key("labels", "technique_id"), F.lit(False))
    return events.withColumns({"technique_id": F.when(has, F.coalesce(F.try_element_at("labels", F.lit("technique_id")), F.lit(""))), "tactic": F.try_element_at("labels", F.lit("tactic")), "destination": _field("destination.ip"), "domain": _field("destination.domain")})


def _field(name: str) -> Column:
    return F.try_variant_get(F.try_element_at("fields", F.lit(name)), "$", "string")


def technique_columns(techniques: DataFrame, url: str = "") -> DataFrame:
    """Add base_technique (before the dot) and url; ids must start with T."""
    out = techniques.where(F.col("technique_id").startswith("T"))
    return out.withColumns({"base_technique": F.substring_index("technique_id", ".", 1), "url": F.concat(F.lit(url.rstrip("/") + "/"), F.replace("technique_id", F.lit("."), F.lit("/")))})


def write_table(df: DataFrame, path: str, form: str = "parquet", partition_by: tuple[str, ...] = ()) -> None:
    """A result table as Parquet or JSON lines; variants are written as JSON text in JSON."""
    if form == "json":
        df = df.withColumns({f.name: F.transform_values(f.name, lambda k, v: F.to_json(v)) for f in df.schema.fields if f.dataType.simpleString() == _MAP})
    df.write.mode("errorifexists").partitionBy(*partition_by).format(form).save(path)


def commit_batch(df: DataFrame, path: str, batch: str | int) -> bool:
    """Add ``df`` to the table at ``path`` as its batch of that name, once; False if the batch is there already.

    Rows are written aside, in a folder that readers pass over, and take their place by one rename, so a job that is
    repeated, or broke off, neither doubles rows nor leaves half of them. As ``foreachBatch`` of a stream it makes a
    batch that comes again after a restart harmless. Tables are read by ``read_batches``.
    """
    spark = df.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, aside = hadoop.Path(f"{path}/batch={batch}"), hadoop.Path(f"{path}/_aside-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target):
        return False
    df.write.parquet(aside.toString())
    done = not files.exists(target) and files.rename(aside, target)
    if not done or files.exists(hadoop.Path(target, aside.getName())):  # another job was there first
        files.delete(hadoop.Path(target, aside.getName()) if done else aside, True)
        return False
    return True


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All batches that were committed to the table at ``path``."""
    return spark.read.option("recursiveFileLookup", "false").option("basePath", path).parquet(f"{path}/batch=*").drop("batch")


# Score and colour by status.
LAYER = {"full": (100, "#2e7d32"), "partial": (50, "#f9a825"), "none": (0, "#c62828")}


def layer_techniques(cover: DataFrame) -> DataFrame:
    """A row for each technique of merged coverage: score, colour and comment."""
    status = F.col("status")
    score = F.when(status == "full", LAYER["full"][0]).when(status == "partial", LAYER["partial"][0]).otherwise(LAYER["none"][0])
    colour = F.when(status == "full", LAYER["full"][1]).when(status == "partial", LAYER["partial"][1]).otherwise(LAYER["none"][1])
    rules = F.when(F.size("detecting_rules") > 0, F.array_join("detecting_rules", ", ")).otherwise("no detection")
    comment = F.concat(F.upper("status"), F.lit(" | events: "), F.col("events_generated").cast("string"), F.lit(" | true positives: "), F.col("true_positives").cast("string"), F.lit(" | rules: "), rules)
    return cover.select(F.col("technique_id").alias("techniqueID"), "tactic", score.alias("score"), colour.alias("color"), comment.alias("comment"), F.lit(True).alias("enabled"), F.lit(True).alias("showSubtechniques"))


def layer(cover: DataFrame, name: str = "Detection coverage", description: str = "") -> DataFrame:
    """One row, the layer as a struct ready for ``write.json``; a catalogue has some hundreds of techniques."""
    rows = layer_techniques(cover).agg(F.array_sort(F.collect_list(F.struct("techniqueID", "tactic", "score", "color", "comment", "enabled", "showSubtechniques"))).alias("techniques"))
    colours = F.array(*[F.lit(LAYER[s][1]) for s in ("none", "partial", "full")])
    return rows.select(
        F.lit(name).alias("name"), F.struct(F.lit("14").alias("attack"), F.lit("4.9.0").alias("navigator"), F.lit("4.5").alias("layer")).alias("versions"), F.lit("enterprise-attack").alias("domain"), F.lit(description).alias("description"), "techniques",
        F.struct(colours.alias("colors"), F.lit(0).alias("minValue"), F.lit(100).alias("maxValue")).alias("gradient"),
    )


def scenario_listing(steps: DataFrame) -> DataFrame:
    """For each scenario: steps, distinct techniques, tactics in order of appearance."""
    order = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("ord", "tactic"))), lambda s: s["tactic"]))
    return steps.groupBy("scenario_id").agg(F.count("*").alias("steps"), F.countDistinct("technique_id").alias("techniques"), order.alias("tactics"))
