"""Lines that several documents share, kept in one of them only.

Documents come in batches of rising ids. The hashes of the line keys seen so far lie in sorted,
bucketed runs; a batch's keys are anti-joined with the runs, bucket by bucket, and what is new
becomes one more run. Runs of a level are merged into one of the next level when there are
``FAN`` of them. A run holds the smallest document of each of its keys, so that a line
stays exactly where its document is found in a run.

Only hashes, ids and positions are shuffled for that, first combined in each task: a line
that a third of all documents hold is one row per task. Texts move once, to meet the positions of
their dropped lines. All of it is DataFrame functions.

Null text is one empty line. Rows with a null id count as one document that comes last. Repeated rows
of one id are one document: they lose the same lines. Result columns replace columns
of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillcast.llm.common import workspace, written

BLANKS = " \t\n\x0b\x0c\r"
MIN_CODE_POINTS = 10
BATCHES = 4
FAN = 2
HASHES = ["key_hash", "key_hash_2"]


def text_lines(text: Column) -> Column:
    """The lines of a text; an empty or null one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(BLANKS)), upper, upper.lower())


def hashed_lines(docs: DataFrame, batches: int) -> DataFrame:
    """Every line with a long enough key: its document, position, batch and key hashes."""
    lines = docs.select(
        F.col("doc_id").alias("doc"),
        F.xxhash64("text").alias("mark"),
        F.posexplode(text_lines(F.col("text"))).alias("pos", "line"),
    ).withColumn("key", line_key(F.col("line")))
    cuts = F.lit(_cuts(docs, batches))
    batch = F.when(F.col("doc").isNull(), F.lit(batches - 1)).otherwise(
        F.size(F.filter(cuts, lambda cut: cut < F.col("doc"))) if batches > 1 else F.lit(0)
    )
    return lines.where(F.char_length("key") >= MIN_CODE_POINTS).select(
        "doc",
        "mark",
        "pos",
        F.xxhash64("key").alias(HASHES[0]),
        F.xxhash64(F.lit(7), "key").alias(HASHES[1]),
        batch.alias("batch"),
    )


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Ids that part the documents into batches of about equal numbers."""
    shares = [k / batches for k in range(1, batches)]
    found = docs.agg(F.percentile_approx("doc_id", shares or [0.5], 1000)).first()[0]
    return sorted(set(found or [0]))


class Runs:
    """Sorted runs of (key hashes, smallest document), by level."""

    def __init__(self, spark, folder: str):
        self.spark, self.folder, self.levels, self.made = spark, folder, [[]], 0
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def tables(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, rows: DataFrame, level: int = 0) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(self._write(rows))
        if len(self.levels[level]) >= FAN:
            old = self.levels[level]
            self.levels[level] = []
            merged = self.spark.table(old[0])
            for name in old[1:]:
                merged = merged.unionByName(self.spark.table(name))
            self.add(merged, level + 1)
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")

    def _write(self, rows: DataFrame) -> str:
        name = "run_" + self.folder.rpartition("-")[2] + f"_{self.made}"
        self.made += 1
        (
            rows.repartition(self.buckets, *HASHES)
            .write.bucketBy(self.buckets, *HASHES)
            .sortBy(*HASHES)
            .option("path", f"{self.folder}/{name}")
            .format("parquet")
            .saveAsTable(name)
        )
        return name

    def forget(self) -> DataFrame:
        """All runs as one table of files; the catalog loses their names."""
        names = [name for level in self.levels for name in level]
        paths = [f"{self.folder}/{name}" for name in names]
        schema = self.spark.table(names[0]).schema
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
        return self.spark.read.schema(schema).parquet(*paths)


def dropped_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``doc``, ``mark`` (hash of the text), ``pos`` of the lines that another document keeps."""
    spark = docs.sparkSession
    folder = workspace(spark, "lines")
    lines = written(hashed_lines(docs, batches), f"{folder}/lines")
    runs = Runs(spark, folder)
    for k in range(batches):
        fresh = lines.where(F.col("batch") == k).groupBy(*HASHES).agg(F.min("doc").alias("doc"))
        for run in runs.tables():
            fresh = fresh.hint("merge").join(run.select(*HASHES), HASHES, "left_anti")
        runs.add(fresh)
    kept = runs.forget().alias("kept")
    same = [F.col(f"lines.{c}") == F.col(f"kept.{c}") for c in HASHES]
    same.append(F.col("lines.doc").eqNullSafe(F.col("kept.doc")))
    return (
        lines.alias("lines")
        .join(kept, same[0] & same[1] & same[2], "left_anti")
        .select("doc", "mark", "pos")
    )


def dedup_lines(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` short of its dropped lines, ``n_lines`` before and ``n_dropped``."""
    gone = (
        dropped_lines(docs.select("doc_id", "text"), batches)
        .groupBy("doc", "mark")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    own = docs.select(F.struct(*docs.columns).alias("row"))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc")) & (
        F.xxhash64(F.col("row.text")) == F.col("mark")
    )
    met = own.join(gone, same, "left").select(
        "row", "gone", text_lines(F.col("row.text")).alias("lines")
    )
    # What lies between one dropped line and the next.
    first = F.concat(F.array(F.lit(0)), F.transform("gone", lambda at: at + 1))
    end = F.concat("gone", F.array(F.size("lines")))
    parts = F.transform(
        F.arrays_zip(first.alias("first"), end.alias("end")),
        lambda gap: F.slice("lines", gap["first"] + 1, gap["end"] - gap["first"]),
    )
    kept = F.when(
        F.col("gone").isNotNull(), F.array_join(F.flatten(parts), "\n")
    ).otherwise(F.coalesce(F.col("row.text"), F.lit("")))
    new = {
        "text": kept,
        "n_lines": F.size("lines").cast("long"),
        "n_dropped": F.coalesce(F.size("gone"), F.lit(0)).cast("long"),
    }
    old = [c for c in docs.columns if c not in new or c == "text"]
    return met.select(
        *[new[c].alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in old],
        new["n_lines"].alias("n_lines"),
        new["n_dropped"].alias("n_dropped"),
    )
