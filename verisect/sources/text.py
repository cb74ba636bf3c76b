"""Scans of text files: BED, block maps, read maps, FASTA, SAM, simulated reads, DGV, report JSON.

Lines are numbered in the order of their files' paths and of their places in a file, whatever sizes the files
have and however they are split and read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verisect.functions import columns as C
from verisect.operators.intervals import add_anchor_base
from verisect.operators.scan import scanned
from verisect.operators.storage import if_small, placed, stored

_GZIP = b"\x1f\x8b"


def gzip_without_name(spark: SparkSession, paths: list[str]) -> list[str]:
    """Files under these paths that are gzip by their first two bytes, but not by their names. The driver lists
    them and reads two bytes of each, through the file systems that Spark knows."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(conf)
        for status in fs.globStatus(at) or []:
            files = fs.listFiles(status.getPath(), True)
            while files.hasNext():
                file = files.next()
                name = file.getPath().getName()
                if name.startswith(("_", ".")) or name.endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")) or file.getLen() < 2:
                    continue
                stream = fs.open(file.getPath())
                try:
                    if bytes((stream.read() & 255, stream.read() & 255)) == _GZIP:
                        found.append(file.getPath().toString())
                finally:
                    stream.close()
    return found


def _inflated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of gzip files (path, name, content), of one or several members, a few MB at a time."""
    for batch in batches:
        for path, name, content in zip(*(batch.column(c).to_pylist() for c in ("path", "name", "content")), strict=True):
            rest, tail = content, b""
            while rest:
                engine = zlib.decompressobj(31)
                while not engine.eof:
                    piece = engine.decompress(rest, 1 << 22)
                    rest = engine.unconsumed_tail
                    if not piece and not rest:
                        break
                    *lines, tail = (tail + piece).split(b"\n")
                    if lines:
                        yield _line_batch(path, name, lines)
                rest = engine.unused_data
            if tail:
                yield _line_batch(path, name, [tail])


def _line_batch(path: str, name: str, lines: list[bytes]) -> pa.RecordBatch:
    text = [line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines]
    return pa.RecordBatch.from_pydict({"path": [path] * len(text), "file": [name] * len(text), "block": pa.array([0] * len(text), pa.int64()), "value": text})


def placed_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, rec_no, value of all lines, with their places for scan.scanned(). Gzip is told by content: files that
    are named .gz are read by Spark as they are, others whole, which Spark bounds to 2 GB of compressed bytes. The
    text is read twice: once for the number of lines of each part of a file, once for the lines."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    hidden = gzip_without_name(spark, paths)
    meta = [F.col(f"_metadata.{m}").alias(n) for m, n in (("file_path", "path"), ("file_name", "file"), ("file_block_start", "block"))]
    lines = spark.read.text(paths).select(*meta, "value")
    if hidden:
        bare = lambda p: F.regexp_replace(p, "^file:/+", "file:/")  # noqa: E731  a file's path in two spellings
        lines = lines.filter(~bare(F.col("path")).isin(*(h if not h.startswith("file:") else "file:/" + h.removeprefix("file:").lstrip("/") for h in hidden)))
        whole = spark.read.format("binaryFile").load(hidden).select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "content")
        lines = lines.unionByName(whole.mapInArrow(_inflated, "path string, file string, block long, value string"))
    rows = placed(lines)
    parts = rows.groupBy("path", "block").agg(F.count("*").alias("n"), F.min("__i").alias("first"))
    order = Window.orderBy("path", "block")  # a row for each part of a file
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = stored(parts.select(F.col("path").alias("__path"), F.col("block").alias("__block"), F.col("first").alias("__first"), before.alias("__before"), (F.row_number().over(order) - 1).alias("__no")))
    joined = rows.join(if_small(parts), (F.col("path") == F.col("__path")) & (F.col("block") == F.col("__block")))
    line = F.col("__i") - F.col("__first")
    return joined.select("file", (F.col("__before") + line).alias("rec_no"), "value", F.col("__no").cast("int").alias("__p"), line.alias("__i"))


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, rec_no, value) of all lines, in order of paths; rec_no counts over all files."""
    return placed_lines(spark, paths).select("file", "rec_no", "value")


def _data(lines: DataFrame, comment: str = "#") -> DataFrame:
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith(comment))


def read_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """regions(chr, start, end), closed and 1-based."""
    full = read_bed_full(spark, paths)
    return full.select("chr", "start", "end")


def read_bed_full(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """rec_no, chr, start, end (closed), name, score, strand and the rest as an array."""
    parts = F.split("value", "\t")
    opt = lambda i: F.try_element_at(parts, F.lit(i))
    rows = _data(read_lines(spark, paths)).filter(~F.col("value").rlike("^(track|browser)\\b"))
    return rows.select("rec_no", opt(1).alias("chr"), (opt(2).cast("long") + 1).alias("start"), opt(3).cast("long").alias("end"), opt(4).alias("name"), opt(5).alias("score"), opt(6).alias("strand"), F.filter(parts, lambda x, i: i >= 6).alias("rest"))


def read_map(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Block map; a size that isn't positive is an error."""
    parts = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.element_at(parts, i)
    size = at(1).cast("long")
    checked = F.when(size > 0, size).otherwise(F.raise_error(F.concat(F.lit("block without size: "), F.col("value"))).cast("long"))
    return _data(read_lines(spark, paths)).select(
        F.col("rec_no").alias("block_no"), checked.alias("size"), at(2).alias("src_chr"), at(3).cast("long").alias("src_loc"), at(4).alias("dst_chr"), at(5).cast("long").alias("dst_loc"), at(6).alias("direction"), C.block_type(at(7)).alias("feature"), F.try_element_at(parts, F.lit(8)).alias("variant_id")
    )


def read_read_map(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """read_name, mate (from 0), block_no, chr, start, end, strand, feature, read_start, read_end."""
    parts = F.split("value", "\t")
    mates = _data(read_lines(spark, paths)).select(F.element_at(parts, 1).alias("read_name"), F.posexplode(F.filter(parts, lambda x, i: i >= 1)).alias("mate", "blocks"))
    blocks = mates.filter(F.col("blocks") != "").select("read_name", "mate", F.posexplode(F.split("blocks", ":")).alias("block_no", "block"))
    f = F.split("block", ",")
    at = lambda i: F.element_at(f, i)
    return blocks.select("read_name", "mate", "block_no", at(1).alias("chr"), at(2).cast("long").alias("start"), at(3).cast("long").alias("end"), at(4).alias("strand"), C.block_type(at(5)).alias("feature"), at(6).cast("long").alias("read_start"), at(7).cast("long").alias("read_end"))


def read_map_from_bed(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Read map of long reads: one block as long as the read; the last of repeated names wins."""
    bed = read_bed_full(spark, paths)
    last = bed.groupBy("name").agg(F.max_by(F.struct("chr", "start", "end", "strand"), "rec_no").alias("b"))
    size = F.col("b.end") - F.col("b.start") + 1
    return last.select(F.col("name").alias("read_name"), F.lit(0).alias("mate"), F.lit(0).alias("block_no"), "b.chr", (F.col("b.start") - 1).alias("start"), F.col("b.end").alias("end"), "b.strand", F.lit("SEQ").alias("feature"), F.lit(0).cast("long").alias("read_start"), size.alias("read_end"))


def read_fasta(spark: SparkSession, paths: str | list[str], chunk: int = 1 << 16) -> DataFrame:
    """contig, chunk_no, start (1-based), bases. A line is a row; a line's contig and its place in it are carried
    from part to part of a file, and chunks are cut from the lines that touch them. A contig ends with its file."""
    lines = placed_lines(spark, paths)
    head = F.col("value").startswith(">")
    bases = F.when(~head, F.trim("value")).otherwise("")
    named = scanned(lines, ("file",), last={"contig": F.when(head, F.regexp_extract("value", r"^>(\S+)", 1))}, sums={"before": head.cast("int")})
    # bases before the line since its header: those of the file, less those up to the header
    counted = scanned(named, ("file",), sums={"at": F.length(bases)})
    counted = counted.withColumns({"no": F.col("before") + head.cast("int"), "n": F.length(bases), "bases": bases})
    from_ = counted.filter(head).select(F.col("file").alias("h_file"), F.col("no").alias("h_no"), F.col("at").alias("h_at"))  # a row for each contig
    rows = counted.filter("n > 0 and contig is not null").join(from_, (F.col("file") == F.col("h_file")) & (F.col("no") == F.col("h_no")))
    rows = rows.select("contig", (F.col("at") - F.col("h_at")).alias("at"), "n", "bases")
    cut = rows.withColumn("chunk_no", F.explode(F.sequence(F.floor(F.col("at") / chunk), F.floor((F.col("at") + F.col("n") - 1) / chunk))))
    skip = F.greatest(F.col("chunk_no") * chunk - F.col("at"), F.lit(0))
    end = F.least(F.col("at") + F.col("n"), (F.col("chunk_no") + 1) * chunk)
    part = F.substr("bases", (skip + 1).cast("int"), (end - F.col("at") - skip).cast("int"))
    parts = cut.groupBy("contig", "chunk_no").agg(F.array_sort(F.collect_list(F.struct("at", part.alias("b")))).alias("p"))
    return parts.select("contig", "chunk_no", (F.col("chunk_no") * chunk + 1).alias("start"), F.array_join(F.transform("p", lambda x: x["b"]), "").alias("bases"))


def contig_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("contig").agg(F.sum(F.length("bases")).alias("length"))


def read_sam(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Alignments of SAM text: read_name, mate, flags, chr and pos (null if unmapped), mapq, cigar, bases,
    read_len, start without clipping, identity."""
    parts = F.split("value", "\t")
    at = lambda i: F.element_at(parts, i)
    rows = spark.read.text(paths).filter(~F.col("value").startswith("@") & (F.size(parts) >= 11))
    flags = at(2).cast("int")
    mapped = flags.bitwiseAND(4) == 0
    out = rows.select(at(1).alias("read_name"), F.when(flags.bitwiseAND(0x80) != 0, 1).otherwise(0).alias("mate"), flags.alias("flags"), F.when(mapped, at(3)).alias("chr"), F.when(mapped, at(4).cast("long")).alias("pos"), at(5).cast("int").alias("mapq"), at(6).alias("cigar"), at(10).alias("bases"))
    out = out.withColumn("read_len", F.length("bases"))
    return out.withColumns({"unclipped": C.unclipped_start(F.col("pos"), F.col("cigar")), "identity": C.identity(F.col("cigar"), F.col("read_len"))})


def _records(lines: DataFrame, size: int, keep: Column | None = None) -> DataFrame:
    """Groups of ``size`` lines of placed_lines() as an array, per file; keep: which lines count."""
    counted = scanned(lines, ("file",), sums={"i": F.lit(1) if keep is None else keep.cast("int")})
    rows = counted if keep is None else counted.filter(keep)
    rows = rows.withColumn("record", F.floor(F.col("i") / size))
    lists = rows.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("l")).filter(F.size("l") == size)
    return lists.select("file", "record", F.transform("l", lambda x: x["value"]).alias("lines"))


def read_fastq(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """file, record, name, bases (other than ACGT become N), quality, and the truth in the name."""
    at = lambda i: F.element_at("lines", i)
    named = _records(placed_lines(spark, paths), 4).select("file", "record", F.substr(at(1), F.lit(2)).alias("name"), C.mask_bases(at(2)).alias("bases"), at(4).alias("quality"))
    return named.withColumn("truth", C.parse_read_name(F.col("name")))


#: Name of a simulated dwgsim read: chr_start1_start2_strand1_strand2_random1_random2_errors:snps:indels twice, id.
DWGSIM = r"^@?(.+)_(\d+)_(\d+)_([01])_([01])_([01])_([01])_(\d+):(\d+):(\d+)_(\d+):(\d+):(\d+)_([0-9a-fA-F]+)(?:/([12]))?$"


def read_dwgsim(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads with the fields of their dwgsim names."""
    reads = read_fastq(spark, paths).drop("truth")
    g = lambda i: F.regexp_extract("name", DWGSIM, i)
    strand = lambda i: F.when(g(i) == "1", "-").otherwise("+")
    return reads.filter(F.col("name").rlike(DWGSIM)).select("file", "record", "name", "bases", "quality", g(1).alias("chr"), g(2).cast("long").alias("start1"), g(3).cast("long").alias("start2"), strand(4).alias("strand1"), strand(5).alias("strand2"), *(g(8 + i).cast("int").alias(n) for i, n in enumerate(("errors1", "snps1", "indels1", "errors2", "snps2", "indels2"))), g(14).alias("read_id"))


def read_art_aln(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Reads of an ART .aln file: chr, name, 1-based start on the forward strand, strand, reference bases.
    A reverse read's place counts from the contig's end, whose length is in the @SQ lines."""
    lines = placed_lines(spark, paths)
    sq = lines.filter(F.col("value").startswith("@SQ")).select(F.element_at(F.split("value", "\t"), 2).alias("chr"), F.element_at(F.split("value", "\t"), 3).cast("long").alias("contig_len")).distinct()
    body = ~F.col("value").startswith("@") & ~F.col("value").startswith("#") & (F.col("value") != "")
    head = F.split(F.substr(F.element_at("lines", 1), F.lit(2)), "\t")
    rows = _records(lines, 3, body).select(F.element_at(head, 1).alias("chr"), F.element_at(head, 2).alias("name"), F.element_at(head, 3).cast("long").alias("at"), F.element_at(head, 4).alias("strand"), F.regexp_replace(F.element_at("lines", 2), "-", "").alias("ref_bases"))
    joined = rows.join(sq, "chr", "left")
    forward = F.when(F.col("strand") == "-", F.col("contig_len") - F.col("at") - F.length("ref_bases") + 1).otherwise(F.col("at") + 1)
    return joined.select("chr", "name", forward.alias("start"), "strand", "ref_bases")


# The columns of a DGV file, in order.
DGV_COLUMNS = ("variantaccession", "chr", "start", "end", "varianttype", "variantsubtype", "reference", "pubmedid", "method", "platform", "mergedvariants", "supportingvariants", "mergedorsample", "frequency", "samplesize", "observedgains", "observedlosses", "cohortdescription", "genes", "samples")


def read_dgv(spark: SparkSession, paths: str | list[str], chunks: DataFrame | None = None, chunk_size: int = 1 << 16) -> DataFrame:
    """rec_no, chr, pos, id, allele_type, ref_len, alt_len, cn. Subtypes that aren't known are dropped; a
    gain's copies are observed gains + 1; one base for one base is dropped. With the genome's chunks (all but the
    last of a contig of chunk_size) also anchor, the base before a deletion."""
    parts = F.split("value", "\t")
    col = {n: F.try_element_at(parts, F.lit(i + 1)) for i, n in enumerate(DGV_COLUMNS)}
    rows = _data(read_lines(spark, paths)).filter((col["variantaccession"] != "variantaccession") & (col["varianttype"] != "OTHER"))
    kind = C.alias_of(F.lower(col["variantsubtype"]), C.DGV_TYPES)
    start, end = col["start"].try_cast("long"), col["end"].try_cast("long")
    size = end - start + 1
    out = rows.select("rec_no", C.strip_chr(col["chr"]).alias("chr"), start.alias("pos"), col["variantaccession"].alias("id"), kind.alias("allele_type"), size.alias("__n"), (F.coalesce(col["observedgains"].try_cast("int"), F.lit(0)) + 1).alias("cn"))
    known = out.filter(F.col("allele_type").isNotNull() & F.col("pos").isNotNull())
    ref_len = F.when(F.col("allele_type") == "Insertion", 0).otherwise(F.col("__n"))
    alt_len = F.when(F.col("allele_type") == "Deletion", 0).otherwise(F.col("__n"))
    sized = known.withColumns({"ref_len": ref_len, "alt_len": alt_len}).drop("__n")
    kept = sized.filter(~((F.col("ref_len") == 1) & (F.col("alt_len") == 1)))
    if chunks is None:
        return kept
    return add_anchor_base(kept, chunks, chunk_size).withColumn("anchor", F.when(F.col("allele_type") == "Deletion", F.col("anchor")))


CELL = "struct<lower:int,upper:int,empty:boolean,tp:bigint,fp:bigint,tn:bigint,fn:bigint,t:bigint,_TP:bigint,_FP:bigint,_TN:bigint,_FN:bigint,_T:bigint,tpr:double,fdr:double,ppv:double,spc:double,f1:double>"
RECORD = f"struct<bin_counts:array<{CELL}>,sv_bin_counts:array<{CELL}>,sum_count:{CELL},svSumCount:{CELL},sum_per_base_count:{CELL},bin_breaks:array<int>>"


def read_reports(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, overall_type, record) of variant reports; the total has type All."""
    schema = f"params map<string,string>, num_true_correct struct<data:map<string,{RECORD}>,all_data:{RECORD}>"
    raw = spark.read.schema(schema).option("multiLine", True).json(paths).select(F.col("_metadata.file_name").alias("file"), "num_true_correct")
    each = raw.select("file", F.explode(F.map_concat("num_true_correct.data", F.create_map(F.lit("All"), F.col("num_true_correct.all_data")))).alias("overall_type", "record"))
    return each


def header_columns(line: Column) -> Column:
    return F.split(F.regexp_replace(line, "^#", ""), "\t")
