"""Views that give the TPC-H-like tables the shape of variants, regions, block maps and alignments.

The text is valid both in Spark SQL and in DuckDB; each view may use those before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "src": """
select l_orderkey as ok, l_linenumber as ln, min(l_partkey) as pk, min(l_suppkey) as sk,
       cast(floor(min(l_quantity)) as bigint) as qty
from lineitem group by l_orderkey, l_linenumber""",
    "truth": """
select ok*8+ln as rec_no, 'chr'||cast(1+sk%5 as string) as chr, ok*40+ln*5 as pos,
       case when qty<=20 then 'SNP' when qty<=30 then 'Insertion' when qty<=40 then 'Deletion' else 'TandemDup' end as overall_type,
       case when qty<=20 then 1 when pk%7=0 then (1+pk%40)*10 else 1+pk%40 end as len,
       substr('ACGT', cast(1+pk%4 as int), 1) as alt,
       case when qty%2=0 then '1|1' else '0|1' end as gt
from src""",
    "calls": """
select rec_no, chr, pos + (case when rec_no%11=0 then 3 else 0 end) as pos, overall_type, len,
       case when rec_no%13=0 then 'N' else alt end as alt, gt,
       case when rec_no%17=0 then 'LowQual' else 'PASS' end as filter
from truth where rec_no%9<>0
union all
select 1000000000+o_orderkey, 'chr'||cast(1+o_custkey%5 as string), o_orderkey*40+2, 'SNP', 1, 'A', '0|1', 'PASS'
from orders where o_orderkey%7=0""",
    "regions": """
select 'chr'||cast(1+o_custkey%5 as string) as chr, o_orderkey*40+1 as start_pos, o_orderkey*40+200 as end_pos
from orders where o_orderkey%10=0""",
    "blk": """
select p_partkey as block_no, 'chr'||cast(1+p_partkey%5 as string) as src_chr, cast(50+p_size*4 as bigint) as size,
       case when p_partkey%13=0 then 'INV' when p_partkey%10=3 then 'INS' when p_partkey%10=7 then 'DEL' when p_partkey%10=5 then 'DUP_TANDEM' else 'SEQ' end as feature
from part""",
    "map_blocks": """
select block_no, size, src_chr,
       1 + sum(case when feature='DEL' then 0 else size end) over (partition by src_chr order by block_no) - (case when feature='DEL' then 0 else size end) as src_loc,
       'ref'||substr(src_chr,4) as dst_chr,
       1 + sum(case when feature='INS' then 0 else size end) over (partition by src_chr order by block_no) - (case when feature='INS' then 0 else size end) as dst_loc,
       case when feature='INV' then '-' else '+' end as direction, feature
from blk""",
    "to_lift": """
select event_id as rec_no, 'chr'||cast(1+user_id%5 as string) as chr, (event_id*7)%40000 as start_pos,
       (event_id*7)%40000 + 1 + cast(floor(value) as bigint) as end_pos
from events""",
    "alignments": """
select 'r'||cast(rec_no as string) as read_name, chr as true_chr, pos as true_pos, overall_type as feature,
       case when rec_no%10=0 then null else chr end as chr,
       case when rec_no%10=0 then null when rec_no%19=0 then pos+500 else pos+rec_no%3 end as pos,
       cast(rec_no%61 as int) as mapq, cast(case when rec_no%10=0 then 4 when rec_no%23=0 then 256 else 0 end as int) as flags,
       cast(case when rec_no%29=0 then 1.0 else 0.9 end as double) as identity
from truth""",
}
_NEEDS = {"src": (), "truth": ("src",), "calls": ("truth",), "regions": (), "blk": (), "map_blocks": ("blk",), "to_lift": (), "alignments": ("truth",)}
_TABLES = {"src": "lineitem", "calls": "orders", "regions": "orders", "blk": "part", "to_lift": "events"}


def needed(*names: str) -> list[str]:
    """The views that these build on, themselves included, in order."""
    out: list[str] = []
    for name in names:
        out += [x for x in [*needed(*_NEEDS[name]), name] if x not in out]
    return out


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the views over the tables in sf_dir."""
    frames = {}
    for step in needed(name):
        inputs = {x: frames[x] for x in _NEEDS[step]}
        if base := _TABLES.get(step):
            inputs[base] = spark.read.parquet(f"{sf_dir}/{base}.parquet")
        text = VIEWS[step]
        for table, frame in inputs.items():
            handle = f"{step}_{table}_{abs(hash(sf_dir)) % 10**9}"
            frame.createOrReplaceTempView(handle)
            text = text.replace(f"from {table}", f"from {handle}")
        frames[step] = spark.sql(text)
    return frames[name]


def with_views(names: tuple[str, ...], query: str) -> str:
    """SQL for DuckDB: the views as common table expressions before a query."""
    return "with " + ",\n".join(f"{x} as ({VIEWS[x]})" for x in needed(*names)) + "\n" + query
