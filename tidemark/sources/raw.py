"""Raw API responses, the parsed observation table, and their files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.times import raw_to_utc
from ..functions.trains import clean_eva, trip_key
from ..operators.asof import latest_version
from ..operators.profile import top_k

PARSER_VERSION = 1
RAW_SCHEMA = "collected_at string, source string, eva string, url string, status int, duration_ms long, body string, _bad string"
_EVENT = "struct<_pt:string,_ct:string,_clt:string,_pp:string,_cp:string,_ps:string,_cs:string,_hi:string,_l:string,_ppth:string,_cpth:string,_fb:string,_wings:string,_tra:string,m:array<struct<_t:string,_c:string>>>"
_XML = f"_station string, s array<struct<_id:string,tl:struct<_f:string,_t:string,_o:string,_c:string,_n:string>,ar:{_EVENT},dp:{_EVENT},m:array<struct<_t:string,_c:string>>>>, _corrupt_record string"
#: Event columns of a parsed observation and the attributes they come from.
_ATTRIBUTES = {"line": "_l", "pt_raw": "_pt", "ct_raw": "_ct", "clt_raw": "_clt", "pp": "_pp", "cp": "_cp", "ps": "_ps", "cs": "_cs", "hidden": "_hi", "ppth": "_ppth", "cpth": "_cpth", "fb": "_fb", "wings": "_wings", "tra": "_tra"}
PARSED = (
    "collected_at", "source", "eva", "station_name", "stop_id", "trip_key", "event", "tl_category", "tl_number", "tl_owner", "tl_type", "tl_filter", "line", "pt_raw", "ct_raw", "clt_raw", "pt", "ct", "clt",
    "pp", "cp", "ps", "cs", "hidden", "ppth", "cpth", "event_msgs", "stop_msgs", "fb", "wings", "tra", "parser_version",
)


class LoadedWindow(NamedTuple):
    plan: DataFrame
    obs: DataFrame
    polls: DataFrame
    span: DataFrame


class OldParser(RuntimeError):
    """Rows of the window were parsed by a version that is too old."""


def read_raw(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Responses of gzip JSON lines under source/date/hour folders; unreadable lines keep their text in `_bad`."""
    reader = (spark.readStream if stream else spark.read).schema(RAW_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("ignoreCorruptFiles", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json*")
    return reader.json(path)


def _messages(of: Column) -> Column:
    tokens = F.transform(of, lambda m: F.concat_ws(":", F.coalesce(m["_t"], F.lit("")), F.coalesce(m["_c"], F.lit(""))))
    return F.when(F.size(of) > 0, F.array_join(tokens, "|"))


def parse_responses(raw: DataFrame) -> DataFrame:
    """One row per stop and event of each response, and one (event `s`) for stops with messages only.

    A body that isn't XML gives no row; count those with parse_errors(). Times are local on the wire.
    """
    return _parsed(_with_xml(raw))


def _with_xml(raw: DataFrame) -> DataFrame:
    return raw.withColumn("_x", F.from_xml("body", _XML, {"rowTag": "timetable"}))


def _parsed(root: DataFrame) -> DataFrame:
    stop = root.select(F.to_timestamp("collected_at").alias("collected_at"), "source", "eva", F.col("_x._station").alias("station_name"), F.posexplode_outer("_x.s").alias("_at", "_s"))
    stop = stop.where("_at IS NOT NULL")  # explode() would have Spark infer a filter on the stops, which parses each body again
    events = F.filter(F.array(F.struct(F.lit("ar").alias("event"), F.col("_s.ar").alias("e")), F.struct(F.lit("dp").alias("event"), F.col("_s.dp").alias("e"))), lambda x: x["e"].isNotNull())
    rows = stop.withColumn("_e", F.explode_outer(events))
    out = {
        "stop_id": F.col("_s._id"), "trip_key": trip_key(F.col("_s._id")), "event": F.coalesce("_e.event", F.lit("s")), "tl_category": F.col("_s.tl._c"), "tl_number": F.col("_s.tl._n"), "tl_owner": F.col("_s.tl._o"),
        "tl_type": F.col("_s.tl._t"), "tl_filter": F.col("_s.tl._f"), "event_msgs": _messages(F.col("_e.e.m")), "stop_msgs": _messages(F.col("_s.m")), "parser_version": F.lit(PARSER_VERSION).cast("smallint"),
    }
    out |= {name: F.col(f"_e.e.{a}") for name, a in _ATTRIBUTES.items()}
    out |= {c: raw_to_utc(F.col(f"_e.e._{c}")) for c in ("pt", "ct", "clt")}
    return rows.select("collected_at", "source", "eva", "station_name", *[c.alias(n) for n, c in out.items()]).select(*PARSED)


def _error_counts() -> list[Column]:
    wrong = F.col("body").isNotNull() & (F.trim("body") != "") & (F.col("_x._corrupt_record").isNotNull() | F.col("_x").isNull())
    return [F.count(F.lit(1)).alias("responses"), F.count_if(F.col("_bad").isNotNull()).alias("bad_lines"), F.count_if(wrong).alias("parse_errors")]


def parse_errors(raw: DataFrame) -> DataFrame:
    """One row: responses, unreadable lines, bodies that are no XML."""
    return _with_xml(raw).agg(*_error_counts())


def write_parsed(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Zstandard Parquet, partitioned by source and UTC date."""
    dated = rows.withColumn("date", F.to_date("collected_at"))
    dated.write.partitionBy("source", "date").option("compression", "zstd").mode(mode).parquet(path)


def rebuild_parsed(spark: SparkSession, raw_path: str, out: str, replace: bool = False) -> DataFrame:
    """Parses all raw files anew; refuses to add to existing output unless it may replace it. Returns the counts.

    Bodies are parsed once: the counts are observed while the rows are written.
    """
    watch = Observation()
    counted = _with_xml(read_raw(spark, raw_path)).observe(watch, *_error_counts())
    write_parsed(_parsed(counted.where("_bad IS NULL")), out, "overwrite" if replace else "errorifexists")
    rows = spark.read.parquet(out).agg(F.count("*").alias("rows"))
    return rows.select(*[F.lit(watch.get[k]).cast("long").alias(k) for k in ("responses", "bad_lines", "parse_errors")], "rows")


def read_parsed(spark: SparkSession, path: str, dates: Sequence[str] | None = None, extra: DataFrame | None = None) -> DataFrame:
    """Parsed rows of the dates only (by partition), columns merged by name, with extra rows if given."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if dates is not None:
        rows = rows.where(F.col("date").isin(*[F.lit(d).cast("date") for d in dates]))
    return rows if extra is None else rows.unionByName(extra, allowMissingColumns=True)


def check_version(rows: DataFrame, least: int = PARSER_VERSION) -> DataFrame:
    """The rows, once none of them is older than the least parser version."""
    if not rows.where(F.col("parser_version").isNull() | (F.col("parser_version") < least)).limit(1).isEmpty():
        raise OldParser(f"rows below parser version {least}; rebuild the parsed table")
    return rows


def merged_tail(flushed: DataFrame, tail: DataFrame, time: str, after: Column, until: Column, key: Sequence[str]) -> DataFrame:
    """Flushed rows and the part of an unflushed tail in (after, until], each observation once."""
    new = tail.where((F.col(time) > after) & (F.col(time) <= until))
    return flushed.unionByName(new, allowMissingColumns=True).dropDuplicates(list(key))


def replace_days(rows: DataFrame, path: str, day: str = "service_day", meta: dict[str, str] | None = None) -> None:
    """Writes whole days, replacing just the days that the rows hold; facts about them go to the table `path`_meta.

    meta: facts that hold for all these days, such as versions; the number of rows is added.
    """
    rows.write.partitionBy(day).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    if meta is not None:
        spark = rows.sparkSession
        facts = F.create_map(*[F.lit(x) for kv in meta.items() for x in kv]) if meta else F.expr("map()").cast("map<string,string>")
        held = rows.select(day).distinct()
        counts = spark.read.parquet(path).join(F.broadcast(held), day, "left_semi").groupBy(day).agg(F.count("*").alias("rows")).withColumn("facts", facts)
        counts.write.partitionBy(day).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{path}_meta")


def read_days(spark: SparkSession, path: str, columns: Sequence[str], days: Sequence[str] | None = None, day: str = "service_day") -> DataFrame:
    """A few columns of many daily files, with the day from their folders; only the asked days and columns are read."""
    rows = spark.read.parquet(path)
    if days is not None:
        rows = rows.where(F.col(day).isin(*days))
    return rows.select(*columns, day)


def collector_status(rows: DataFrame) -> DataFrame:
    """Per source and station: rows, stops, first and last time, rows with a changed time, cancelled rows."""
    return rows.groupBy("source", "eva").agg(
        F.count("*").alias("rows"), F.count_distinct("stop_id").alias("stops"), F.min("collected_at").alias("first_seen"), F.max("collected_at").alias("last_seen"), F.count("ct").alias("with_ct"), F.count_if(F.col("cs") == "c").alias("cancelled")
    )


def schema_census(spark: SparkSession, paths: Sequence[str], months: str = r"(?:^|[/=])(\d{4}-\d{2})(?=[-/.]|$)") -> DataFrame:
    """Parquet files that share a set of column names and types: (signature, files, rows, first_month, last_month).

    Files are listed by Spark and their footers read in parallel, no data. A month is what `months` finds in a
    file's path, the last match; null where it finds none. Types are named as Arrow names them.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(list(paths)).select("path") if paths else spark.createDataFrame([], "path string")

    def footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs, parquet

        for batch in batches:
            signatures, rows = [], []
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
                with store.open_input_file(name) as f:
                    footer = parquet.ParquetFile(f)
                    fields = sorted(footer.schema_arrow, key=lambda x: x.name)
                    signatures.append(",".join(f"{x.name}:{x.type}" for x in fields))
                    rows.append(footer.metadata.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures, pa.string()), pa.array(rows, pa.int64())], ["path", "signature", "rows"])

    found = listed.repartition(spark.sparkContext.defaultParallelism, "path").mapInArrow(footers, "path string, signature string, rows long")
    month = F.try_element_at(F.regexp_extract_all("path", F.lit(months), 1), F.lit(-1))
    return found.groupBy("signature").agg(F.count("*").alias("files"), F.sum("rows").alias("rows"), F.min(month).alias("first_month"), F.max(month).alias("last_month"))


def element_census(raw: DataFrame, k: int = 5) -> DataFrame:
    """(element, attribute, value, n, rank): the most frequent values of each attribute, from names found in the text itself.

    Names may hold digits, marks and prefixes (h1, data-id, xlink:href); values stand in either kind of quotes. Works on
    any markup without knowing its names, which from_xml() would have to.
    """
    tags = raw.select(F.explode(F.regexp_extract_all("body", F.lit(r"(<[A-Za-z][^<>]*>)"), 1)).alias("tag"))
    quoted = r"""([A-Za-z_:][-A-Za-z0-9_:.]*\s*=\s*(?:"[^"]*"|'[^']*'))"""
    pairs = tags.select(F.regexp_extract("tag", r"^<([A-Za-z][-A-Za-z0-9_:.]*)", 1).alias("element"), F.explode(F.regexp_extract_all("tag", F.lit(quoted), 1)).alias("pair"))
    value = F.regexp_extract("pair", r"(?s)=\s*(.*)$", 1)
    values = pairs.withColumn("_v", value).select("element", F.regexp_extract("pair", r"^([-A-Za-z0-9_:.]+)", 1).alias("attribute"), F.expr("substring(_v, 2, length(_v) - 2)").alias("value"))
    return top_k(values, ["element", "attribute"], "value", k).select("element", "attribute", "value", "n", "rank")


def historic_stops(rows: DataFrame) -> DataFrame:
    """A historic stop table with its station numbers cleaned and the keys of runs and stops made from its columns.

    rows: eva, train_id, day, nth, and any others. Adds run_key (train and day) and stop_key (run and number).
    """
    return rows.withColumn("eva", clean_eva(F.col("eva"))).withColumn("run_key", F.concat_ws("-", F.regexp_replace("train_id", "^-+", ""), F.date_format("day", "yyMMdd"))).withColumn("stop_key", F.concat_ws("-", "run_key", "nth"))


def load_window(parsed: DataFrame, t0: Column, t1: Column, stations: Sequence[str] | None = None, extra: DataFrame | None = None, least: int = PARSER_VERSION) -> LoadedWindow:
    """What was collected from t0 to t1 (both included): plan, observations and polls of the stations, and the span of all.

    parsed: the parsed table of all sources, of which only the dates of the window are read; `extra` are parsed rows
    that aren't stored yet. plan has one row per stop, event, station and trip with the latest known value of each
    column by itself, so a later version without a line keeps the one before it, and one moved out of the window
    shows its new time. obs are changes with a time or a state: key, eva, obs, ct, ct_raw, cs. polls (eva, t) are
    all times at which a station was heard of. span is one row (first, last), of all stations. Rows older than
    the least parser version are an error, and so is a window without rows.
    """
    stored = parsed.where((F.col("date") >= F.to_date(t0)) & (F.col("date") <= F.to_date(t1))) if "date" in parsed.columns else parsed
    if extra is not None:
        stored = stored.unionByName(extra, allowMissingColumns=True)
    rows = stored.where((F.col("collected_at") >= t0) & (F.col("collected_at") <= t1))
    if rows.limit(1).isEmpty():
        raise ValueError("no parsed row was collected in the window")
    rows = check_version(rows, least)
    here = rows if stations is None else rows.where(F.col("eva").isin(*stations))
    of_trains = here.where(F.col("event").isin("ar", "dp"))
    planned = of_trains.where((F.col("source") == "plan") & F.col("pt").isNotNull())
    planned = planned.select("stop_id", "event", "eva", F.col("trip_key").alias("trip"), "collected_at", "pt", "pt_raw", "pp", F.coalesce("line", "fb").alias("line"), F.col("ppth").alias("path"), "wings", "tra", F.col("tl_category").alias("cat"), F.col("tl_number").alias("num"))
    columns = ["pt", "pt_raw", "pp", "line", "path", "wings", "tra", "cat", "num"]
    plan = latest_version(planned, ["stop_id", "event", "eva", "trip"], "collected_at", columns)
    changed = of_trains.where(F.col("source").isin("fchg", "rchg") & (F.col("ct").isNotNull() | F.col("cs").isNotNull()))
    obs = changed.select(F.concat_ws("|", "stop_id", "event").alias("key"), "eva", F.col("collected_at").alias("obs"), "ct", "ct_raw", "cs")
    span = rows.agg(F.min("collected_at").alias("first"), F.max("collected_at").alias("last"))
    return LoadedWindow(plan, obs, here.select("eva", F.col("collected_at").alias("t")).distinct(), span)
