"""The span and metric store: Parquet by project and day, and the views over the driver's tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spans made of order lines; runs unchanged in Spark and DuckDB.
SPANS_SQL = """
select 'p' || cast(o.o_custkey % 3 as varchar(4)) project_id,
  't' || cast(l.l_orderkey as varchar(20)) trace_id,
  't' || cast(l.l_orderkey as varchar(20)) || '-s' || cast(l.l_linenumber as varchar(4)) span_id,
  case when l.l_linenumber > 1 then 't' || cast(l.l_orderkey as varchar(20)) || '-s' || cast(cast(floor(l.l_linenumber / 2.0) as int) as varchar(4)) end parent_span_id,
  case when l.l_linenumber = 1 then 'c' || cast(o.o_custkey as varchar(20)) end session_id,
  case when l.l_linenumber = 1 then 'u' || cast(o.o_custkey % 50 as varchar(4)) end user_id,
  o.o_orderpriority environment, 'op-' || cast(l.l_partkey % 20 as varchar(4)) span_name,
  case when l.l_linestatus = 'F' then 'generation' when l.l_returnflag = 'A' then 'span' when l.l_returnflag = 'N' then 'agent' else null end observation_type,
  case when l.l_suppkey % 10 = 0 then 'ERROR' else 'OK' end status_code,
  'model-' || cast(l.l_partkey % 7 as varchar(4)) gen_ai_request_model,
  'fw-' || cast(l.l_suppkey % 5 as varchar(4)) framework,
  l.l_shipdate timestamp_start, case when l.l_quantity > 5 then l.l_shipdate + interval '1' hour end timestamp_end,
  cast(case when l.l_quantity > 45 then 0 else l.l_quantity end as bigint) input_tokens, cast(l.l_linenumber as bigint) * (case when l.l_quantity > 45 then 0 else 1 end) output_tokens,
  cast((l.l_linenumber + case when l.l_quantity > 45 then 0 else l.l_quantity end) as bigint) total_tokens, cast(l.l_linenumber * 2 as bigint) cache_read_tokens, cast(l.l_partkey % 3 as bigint) cache_write_tokens, cast(l.l_suppkey % 4 as bigint) reasoning_tokens,
  cast(floor(l.l_extendedprice) / 1000000 as decimal(18,6)) cost_total, cast(l.l_partkey % 100 / 1000000.0 as decimal(18,6)) cost_input, cast(l.l_suppkey % 100 / 1000000.0 as decimal(18,6)) cost_output,
  split('t' || cast(l.l_partkey % 5 as varchar(4)) || ',' || l.l_returnflag, ',') tags, case when l.l_linenumber = 1 then '{{"part":' || cast(l.l_partkey as varchar(20)) || '}}' end metadata,
  case when l.l_quantity > 10 then 'in ' || cast(l.l_partkey as varchar(20)) end input_preview, case when l.l_quantity > 20 then 'out ' || cast(l.l_suppkey as varchar(20)) end output_preview,
  o.o_orderdate ingested_at, cast(l.l_partkey as bigint) * 1000000 + cast(l.l_suppkey as bigint) * 100 + cast(l.l_quantity as bigint) ingest_seq, l.l_partkey tb1, l.l_suppkey tb2, l.l_extendedprice tb3, l.l_quantity tb4, l.l_shipdate tb5
from {lineitem} l join {orders} o on o.o_orderkey = l.l_orderkey"""

KEYS = ["project_id", "trace_id", "span_id"]
_TEXT = (
    "project_id trace_id span_id parent_span_id trace_state session_id user_id environment span_name span_kind status_code status_message exception_type exception_message exception_stacktrace "
    "span_category observation_type framework gen_ai_system gen_ai_operation_name gen_ai_request_model gen_ai_response_model gen_ai_response_id gen_ai_agent_id gen_ai_agent_name gen_ai_tool_name gen_ai_tool_call_id "
    "usage_details http_method http_url db_system db_name db_operation db_statement storage_system storage_bucket storage_object messaging_system messaging_destination metadata input_preview output_preview "
    "raw_span resource_attributes attributes_json events links messages_json tool_definitions_json tool_names_json"
).split()
_LONG = "gen_ai_top_k gen_ai_max_tokens gen_ai_server_ttft_ms gen_ai_server_request_duration_ms duration_ms ingest_seq".split()
_DOUBLE = "gen_ai_temperature gen_ai_top_p gen_ai_frequency_penalty gen_ai_presence_penalty".split()
TOKENS = "input_tokens output_tokens total_tokens cache_read_tokens cache_write_tokens reasoning_tokens".split()
COSTS = "cost_input cost_output cost_cache_read cost_cache_write cost_reasoning cost_total".split()
_LISTS = "tags gen_ai_finish_reasons gen_ai_stop_sequences".split()
#: The span table: column and type.  Token counts and costs are 0 and lists empty where nothing is known.
SCHEMA = (
    dict.fromkeys(_TEXT, "string") | dict.fromkeys(_LONG, "long") | dict.fromkeys(_DOUBLE, "double") | dict.fromkeys(TOKENS, "long") | dict.fromkeys(COSTS, "decimal(18,6)") | dict.fromkeys(_LISTS, "array<string>")
    | {"http_status_code": "int", "timestamp_start": "timestamp", "timestamp_end": "timestamp", "ingested_at": "timestamp"}
)
#: What decides between rows of one span: first ingested, then the order inside the ingest; a hash of the row settles ties.
ORDER = ["ingested_at", "ingest_seq"]


def conformed(rows: DataFrame) -> DataFrame:
    """``rows`` with every column of ``SCHEMA``: missing ones are null, 0 or empty, null counts and costs 0; extra ones stay."""
    def default(name: str, kind: str) -> Column:
        return F.lit(0).cast(kind) if name in TOKENS + COSTS else F.array().cast(kind) if name in _LISTS else F.lit(None).cast(kind)

    added = {c: default(c, kind) for c, kind in SCHEMA.items() if c not in rows.columns}
    if "total_tokens" in added and {"input_tokens", "output_tokens"} <= set(rows.columns):
        added["total_tokens"] = F.coalesce(F.col("input_tokens") + F.col("output_tokens"), F.lit(0)).cast("long")
    filled = {c: F.coalesce(F.col(c), default(c, SCHEMA[c])) for c in TOKENS + COSTS + _LISTS if c in rows.columns and rows.schema[c].nullable}
    return rows.withColumns(added | filled)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conformed(spark.sql(SPANS_SQL, lineitem=table(spark, sf_dir, "lineitem"), orders=table(spark, sf_dir, "orders")))


def staged(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once below ``spark.checkpoint.dir`` and read back: what reads them has a plan of one scan.

    The files stay until that folder is cleaned.  Without the setting only a local run, which is one process, may stage.
    """
    spark = rows.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="spanloom-")
    path = f"{shared}/spanloom-{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def append(rows: DataFrame, path: str, time: str = "timestamp_start") -> None:
    """Append spans or metrics, partitioned by project and day; point filters find their files by Bloom filter.

    Rows of a project and day are dealt over up to 16 files by trace, so a project with most rows is not one task.
    """
    day = rows.withColumn("day", F.to_date(time))
    spread = [F.pmod(F.xxhash64("trace_id"), F.lit(16))] if "trace_id" in rows.columns else [F.pmod(F.xxhash64(time), F.lit(16))]
    sort = [c for c in ("trace_id", "metric_name") if c in rows.columns]
    writer = day.repartition("project_id", "day", *spread).sortWithinPartitions("project_id", "day", *sort).write.mode("append").partitionBy("project_id", "day")
    if "trace_id" in rows.columns:
        writer = writer.option("parquet.bloom.filter.enabled#trace_id", "true")
    writer.option("compression", "zstd").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The stored spans; filters on project_id and day prune folders."""
    return conformed(spark.read.parquet(path))


def otlp_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """OTLP requests as JSON lines; a line that does not parse is kept in ``_bad`` and skipped by the flattening."""
    return spark.read.schema(f"{schema}, _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path)
