"""Writers of the native text formats. Each has a function that gives its lines, in order, and one that writes them: parts by ranges of the
order first, then one file of the given name."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.scratch import deleted
from scriptorium.operators.evaluation import METRICS

#: Metric names in reports: of one query, and of their means.
NAMES = {"ndcg75": ("NDCG@75", "NDCG@75"), "rr": ("RR", "MRR"), "p15": ("P@15", "P@15"), "r20": ("R@20", "R@20"), "f1_25": ("F1@25", "F1@25"), "ap": ("AP", "MAP")}
BIG = "decimal(38,0)"


def fixed(x: Column, digits: int) -> Column:
    """A finite double with so many digits after the point, rounded half to even on its exact binary value.

    The value's first 88 bits after the point are taken apart in three whole numbers, so that the rest is arithmetic of integers; smaller
    bits only occur in values that round to zero. Up to 6 digits, and values below 2**31.
    """
    whole = lambda c: c.cast("bigint").cast(BIG)
    number = lambda n: F.lit(str(n)).cast(BIG)
    times = lambda a, n: (a * F.lit(str(n)).cast("decimal(20,0)")).cast(BIG)
    add = lambda a, b: (a + b).cast(BIG)

    def apart(v: Column) -> Column:
        size = F.abs(v)
        return F.struct((v < 0).alias("minus"), F.floor(size).cast("bigint").alias("high"), ((size - F.floor(size)) * float(1 << 32)).alias("one"))

    def halved(v: Column) -> Column:
        return F.struct(v.minus.alias("minus"), v.high.alias("high"), F.floor(v.one).alias("mid"), ((v.one - F.floor(v.one)) * float(1 << 32)).alias("two"))

    def scaled(v: Column) -> Column:
        # What is below the point, in units of 2**-88 and times 10**digits; what is above it needs no rounding.
        last = F.floor((v.two - F.floor(v.two)) * float(1 << 24))
        below = times(add(times(add(times(whole(v.mid), 1 << 32), whole(F.floor(v.two))), 1 << 24), whole(last)), 10**digits)
        return F.struct(v.minus.alias("minus"), v.high.alias("high"), below.alias("below"), (below % number(1 << 88)).cast(BIG).alias("rest"))

    def rounded(v: Column) -> Column:
        down = ((v.below - v.rest).cast(BIG) / number(1 << 88)).cast("bigint")
        up = (v.rest > number(1 << 87)) | ((v.rest == number(1 << 87)) & (F.pmod(down, F.lit(2)) == 1))
        return F.struct(v.minus.alias("minus"), (v.high * 10**digits + down + up.cast("bigint")).alias("units"))

    def spelled(v: Column) -> Column:
        sign = F.when(v.minus, F.lit("-")).otherwise(F.lit(""))
        return F.concat(sign, F.floor(v.units / 10**digits).cast("string"), F.lit("."), F.lpad((v.units % 10**digits).cast("string"), digits, "0"))

    # Each step is a pass over an array of one, so that its outcome is worked out once.
    value = F.array(x)
    for step in (apart, halved, scaled, rounded, spelled):
        value = F.transform(value, step)
    return F.get(value, F.lit(0))


def _files(spark: SparkSession, folder: str) -> tuple[object, list[object]]:
    """The file system of a folder, and its files that have anything in them, by name."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f for f in system.listStatus(where) if f.isFile() and f.getPath().getName().startswith("part-") and f.getLen() > 0), key=lambda f: f.getPath().getName())
    return system, [f.getPath() for f in found]


def joined(spark: SparkSession, folder: str, path: str) -> None:
    """Commit the part files of a folder as one file: one alone is renamed, several are put together by their names. The file has another name
    until it is whole, and takes the place of one that is there."""
    jvm = spark.sparkContext._jvm
    system, parts = _files(spark, folder)
    target, made = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{folder}/_joined")
    if len(parts) == 1:
        made = parts[0]
    else:
        out = system.create(made, True)
        try:
            for part in parts:
                source = system.open(part)
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
                finally:
                    source.close()
        finally:
            out.close()
    system.delete(target, True)
    system.mkdirs(target.getParent())
    if not system.rename(made, target):
        raise OSError(f"{made.toString()} cannot be renamed to {path}")


def text(rows: DataFrame, path: str, *order: str, compression: str = "none") -> None:
    """One file, ``path``, of lines in order. Ranges of the order are written by as many tasks, and their files joined when all stand."""
    spark, folder = rows.sparkSession, f"{path}.parts-{uuid.uuid4().hex[:8]}"
    rows.orderBy(*order).select("line").write.option("compression", compression).text(folder)
    joined(spark, folder, path)
    deleted(spark, f"{folder}/x")


def tokens(rows: DataFrame, path: str, token: str = "stem", order: tuple[str, ...] = ("doc_id", "pos")) -> None:
    """One token a line, over as many files as there are partitions; names sort as the tokens do."""
    rows.orderBy(*order).select(F.col(token).alias("line")).write.mode("overwrite").text(path)


def term_count_lines(rows: DataFrame) -> DataFrame:
    """(no, line) of (term, cnt, ord): term and count; equal counts stay in the order of ``top_terms``, by first occurrence."""
    return rows.select(F.col("ord").alias("no"), F.concat_ws(" ", "term", F.col("cnt").cast("string")).alias("line"))


def term_counts(rows: DataFrame, path: str) -> None:
    text(term_count_lines(rows), path, "no")


def boolean_results(rows: DataFrame, path: str) -> None:
    """A file <qname>.txt per query in the folder ``path``, one unit a line; a query without results has none.

    Ranges of all results are written at once, each to the folders of its queries, and a query's files are then joined. Characters of a name
    that no file name can have are written as Spark writes them in names of folders.
    """
    spark, folder = rows.sparkSession, f"{path}/_parts-{uuid.uuid4().hex[:8]}"
    ranges = rows.repartitionByRange("qname", "ord").sortWithinPartitions("qname", "ord")
    ranges.select("qname", F.col("unit_id").alias("line")).write.partitionBy("qname").text(folder)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    for query in where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where):
        name = query.getPath().getName()
        if name.startswith("qname="):
            joined(spark, query.getPath().toString(), f"{path}/{name.removeprefix('qname=')}.txt")
    deleted(spark, f"{folder}/x")


def run_lines(rows: DataFrame, tag: str = "scriptorium") -> DataFrame:
    """(qname, rank, line): qname skip doc rank score tag; a score that rounds to -0 is written as 0."""
    score = fixed(F.when(F.abs("score") < 5e-7, F.lit(0.0)).otherwise(F.col("score")), 6)
    return rows.select("qname", "rank", F.concat_ws(" ", "qname", F.lit("skip"), "unit_id", F.col("rank").cast("string"), score, F.lit(tag)).alias("line"))


def run_file(rows: DataFrame, path: str, tag: str = "scriptorium") -> None:
    text(run_lines(rows, tag), path, "qname", "rank")


def top_page_lines(rows: DataFrame, value: str) -> DataFrame:
    """(no, line): page, rank and value between tabs."""
    return rows.select(F.col("rank").alias("no"), F.concat_ws("\t", "page", F.col("rank").cast("string"), F.col(value).cast("string")).alias("line"))


def top_pages(rows: DataFrame, path: str, value: str) -> None:
    text(top_page_lines(rows, value), path, "no")


def report_lines(metrics: DataFrame, means: DataFrame) -> DataFrame:
    """(part, qid, no, line): six lines per query (part 0), then six of means (part 1); four digits, rounded half to even on the binary value."""
    rows = metrics.select(F.lit(0).alias("part"), F.col("qid").cast("string").alias("qid"), *METRICS).unionByName(means.select(F.lit(1).alias("part"), F.lit("").alias("qid"), *METRICS))
    name = lambda m: F.when(F.col("part") == 0, F.lit(NAMES[m][0])).otherwise(F.lit(NAMES[m][1]))
    of = F.when(F.col("part") == 0, F.col("qid")).otherwise(F.lit(" all"))
    lines = F.array(*[F.struct(F.lit(i).alias("no"), F.concat_ws(" ", name(m), of).alias("head"), F.col(m).alias("value")) for i, m in enumerate(METRICS)])
    return rows.select("part", "qid", F.inline(lines)).select("part", "qid", "no", F.concat_ws(" ", "head", fixed(F.col("value"), 4)).alias("line"))


def report(metrics: DataFrame, means: DataFrame, path: str) -> None:
    text(report_lines(metrics, means), path, "part", "qid", "no")
