"""Token counts as rollups that are kept up to date by signed deltas.

A ledger of changes says, for a document, how many tokens a tokenizer version counts in it: an insert adds
a document and its tokens, a delete takes them away, a revision takes the old count away and adds the new
one. A batch of changes is summed by (source, language, tokenizer version) and committed under its id as
one folder of signed sums; totals are the sum over committed batches, so no batch rereads another's
documents. ``compact`` puts the sums of all batches so far into one base, whose folder names the batches that
are in it: these are then not read again. A batch whose folder is complete (Spark's _SUCCESS file is there) is not written again: a
replayed batch changes nothing, and one that failed midway is overwritten by its replay.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verisect.llm.common import over_texts, scratch_dir, stored, table

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
VERSION = "byte-bpe-50k"
#: The tokenizer to which the query's revision goes over.
REVISED_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
REVISED = "byte-bpe-multi-50k"
KEYS = ("source", "lang", "tokenizer")
SUMS = ("docs", "tokens")


def load_ranks(path: str = RANKS) -> tuple[str, dict[bytes, int]]:
    """Pattern and ranks of a byte-level tokenizer; read on the driver (about 50,000 entries)."""
    import public_tokenizers

    with open(path, "rb") as lines:
        return public_tokenizers.PATTERN, {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def count_tokens(docs: DataFrame, ranks: tuple[str, dict[bytes, int]] | None = None) -> DataFrame:
    """docs' doc_id, source and lang with ``tokens``: the tokens of each whole text, 0 for a null or empty one.

    Rows are counted one by one: repeats and null ids, sources and languages stay, other columns are dropped,
    an empty table gives an empty result.
    """
    pattern, merges = ranks or load_ranks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        for b in batches:
            n = pa.array([len(encoding.encode_ordinary(t)) if (t := x.as_py()) else 0 for x in b.column(3)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], n], ["doc_id", "source", "lang", "tokens"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("source", "lang", "text")))
    return over_texts(slim, run, "doc_id long, source string, lang string, tokens long")


def inserts(counted: DataFrame, version: str) -> DataFrame:
    """Changes (source, lang, tokenizer, docs, tokens) that add documents."""
    return counted.select("source", "lang", F.lit(version).alias("tokenizer"), F.lit(1).cast("long").alias("docs"), F.col("tokens").cast("long").alias("tokens"))


def deletes(counted: DataFrame, version: str) -> DataFrame:
    return inserts(counted, version).withColumns({c: -F.col(c) for c in SUMS})


def revisions(before: DataFrame, after: DataFrame, old: str, new: str) -> DataFrame:
    """Takes the old counts away and adds the new ones."""
    return deletes(before, old).unionByName(inserts(after, new))


class Rollup:
    """Additive totals in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _folder(self, batch: str) -> str:
        if not batch or not all(c.isalnum() or c in "-_." for c in batch) or batch[0] in "._":
            raise ValueError(f"a batch id has letters, digits, - _ . only, and doesn't begin with . or _: {batch!r}")
        return f"{self.path}/batch={batch}"

    def committed(self, batch: str) -> bool:
        return self._fs.exists(self._path(self._folder(batch) + "/_SUCCESS"))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch of changes once; False if it was there already.

        changes: (source, lang, tokenizer, docs, tokens) with signed numbers. They are summed before the
        shuffle and after, so a hot source is a row of each task. Null keys are keys like any other; null
        numbers count as 0; an empty batch is committed as such.
        """
        if self.committed(batch):
            return False
        summed = changes.groupBy(*KEYS).agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in SUMS))
        summed.write.mode("overwrite").parquet(self._folder(batch))
        return True

    def each_batch(self, prefix: str = "stream") -> Callable[[DataFrame, int], None]:
        """For foreachBatch of a stream of changes: a replayed epoch changes nothing."""
        return lambda changes, epoch: self.commit(f"{prefix}-{epoch}", changes) and None

    def batches(self) -> list[str]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.path)))
        return [n[6:] for n in names if n.startswith("batch=") and self.committed(n[6:])]

    def _base(self) -> tuple[int, set[str]]:
        """The number of the latest complete base (0: there is none) and the batches that are in it."""
        if not self._fs.exists(self._path(self.path)):
            return 0, set()
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        done = [int(n[5:]) for n in names if n.startswith("base=") and self._fs.exists(self._path(f"{self.path}/{n}/members/_SUCCESS"))]
        if not done:
            return 0, set()
        return max(done), {r.batch for r in self.spark.read.schema("batch string").parquet(f"{self.path}/base={max(done)}/members").collect()}

    def _rows(self) -> tuple[DataFrame, int, set[str], list[str]]:
        """Signed sums of the base and of the batches after it; the base's number and batches; these batches."""
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        base, inside = self._base()
        after = [b for b in self.batches() if b not in inside]
        folders = [self._folder(b) for b in after] + ([f"{self.path}/base={base}/sums"] if base else [])
        rows = self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)
        return rows.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS)).filter("docs <> 0 or tokens <> 0"), base, inside, after

    def compact(self) -> None:
        """Write a new base of all committed batches. It counts once the list of its batches is complete, so
        a compaction that fails midway changes nothing; batch folders stay, so a replay still finds them."""
        sums, base, inside, after = self._rows()
        if after:
            sums.write.mode("overwrite").parquet(f"{self.path}/base={base + 1}/sums")
            self.spark.createDataFrame([(b,) for b in sorted(inside | set(after))], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/base={base + 1}/members")

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, docs, tokens) over all committed batches, without keys at zero."""
        return self._rows()[0]


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    """Query: totals of all documents by source, language and tokenizer version after four batches.

    The first inserts all documents. The second deletes those labelled toxic. The third counts those
    labelled of low quality, and not toxic, anew by another tokenizer: a revision. The fourth is the
    second once more, under the same id, which changes nothing; nor does the compaction before the third. A
    document counts as labelled if any of its labels says so. Documents without id have no label.
    """
    ranks = load_ranks()
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marks = stored(marks.filter("toxic = 1 or quality = 0"))
    counted = stored(count_tokens(docs, ranks))
    marked = counted.join(marks, "doc_id")
    toxic = marked.filter("toxic = 1")
    low = marked.filter("coalesce(toxic, 0) <> 1 and quality = 0")
    low_docs = docs.select("doc_id", "source", "lang", "text").join(marks.filter("coalesce(toxic, 0) <> 1 and quality = 0").select("doc_id"), "doc_id", "left_semi")
    rollup = Rollup(spark, scratch_dir(spark))
    rollup.commit("0001-insert", inserts(counted, VERSION))
    rollup.commit("0002-delete", deletes(toxic, VERSION))
    rollup.compact()
    rollup.commit("0003-revise", revisions(low, count_tokens(low_docs, load_ranks(REVISED_RANKS)), VERSION, REVISED))
    rollup.commit("0002-delete", deletes(toxic, VERSION))
    return rollup.totals()
