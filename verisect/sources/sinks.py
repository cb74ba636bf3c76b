"""Sinks for outcomes, maps, regions and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_partitioned(df: DataFrame, path: str, by: str = "outcome") -> None:
    """One folder for each outcome."""
    df.write.partitionBy(by).parquet(path)


def map_line() -> Column:
    return F.concat_ws("\t", F.col("size").cast("string"), "src_chr", F.col("src_loc").cast("string"), "dst_chr", F.col("dst_loc").cast("string"), "direction", "feature", F.coalesce("variant_id", F.lit(".")))


def write_map(blocks: DataFrame, path: str) -> None:
    blocks.orderBy("block_no").select(map_line().alias("value")).write.text(path)


def read_map_lines(read_map: DataFrame) -> DataFrame:
    """One line per read: its name, then the blocks of each mate."""
    block = F.concat_ws(",", "chr", *(F.col(c).cast("string") for c in ("start", "end")), "strand", "feature", *(F.col(c).cast("string") for c in ("read_start", "read_end")))
    mates = read_map.groupBy("read_name", "mate").agg(F.array_sort(F.collect_list(F.struct("block_no", block.alias("b")))).alias("bs"))
    text = F.array_join(F.transform("bs", lambda x: x["b"]), ":")
    reads = mates.groupBy("read_name").agg(F.array_sort(F.collect_list(F.struct("mate", text.alias("t")))).alias("ms"))
    return reads.select(F.concat_ws("\t", "read_name", F.array_join(F.transform("ms", lambda x: x["t"]), "\t")).alias("value"))


def write_read_map(read_map: DataFrame, path: str) -> None:
    read_map_lines(read_map).write.text(path)


def write_bed(df: DataFrame, path: str) -> None:
    """chr, start and end (closed) as 0-based half-open lines, with name, score and strand if there."""
    rest = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in ("name", "score", "strand") if c in df.columns]
    line = F.concat_ws("\t", "chr", (F.col("start") - 1).cast("string"), F.col("end").cast("string"), *rest)
    df.orderBy("chr", "start", "end").select(line.alias("value")).write.text(path)


def report_json(records: DataFrame, params: dict[str, str | int | float]) -> DataFrame:
    """One row: the report of records (overall_type, record) of stats.report_records as JSON, types in a map, and
    all together apart."""
    kinds = F.filter(F.sort_array(F.collect_list(F.struct("overall_type", "record"))), lambda x: x["overall_type"] != "All")
    data = F.map_from_entries(kinds)
    total = F.first(F.when(F.col("overall_type") == "All", F.col("record")), True)
    known = F.struct(*(F.lit(v).alias(k) for k, v in params.items())) if params else F.create_map().cast("map<string,string>")
    return records.agg(data.alias("data"), total.alias("all_data")).select(F.to_json(F.struct(known.alias("params"), F.struct("data", "all_data").alias("num_true_correct"))).alias("value"))


def write_report(records: DataFrame, params: dict[str, str | int | float], path: str) -> None:
    report_json(records, params).coalesce(1).write.text(path)
