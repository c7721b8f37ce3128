"""Readers and writers of the domain's text formats; every reader is a splittable Spark scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def fasta(spark: SparkSession, path: str, *more: Column) -> DataFrame:
    """(more, contig, length, seq): records split at a line that starts with '>', the name up to the first white space."""
    rows = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", "^>", "")
    head = F.substring_index(record, "\n", 1)
    seq = F.regexp_replace(F.when(F.locate("\n", record) > 0, record.substr(F.length(head) + 2, F.length(record))).otherwise(""), r"\s", "")
    return rows.where(F.trim("value") != "").select(*more, F.regexp_extract(head, r"^(\S*)", 1).alias("contig"), F.length(seq).alias("length"), seq.alias("seq"))


def write_fasta(contigs: DataFrame, path: str, by: str | None = None, width: int = 80) -> None:
    """Wrapped at width; a folder for each value of `by`."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    text = F.concat(F.lit(">"), F.col("contig"), F.lit("\n"), body).alias("value")
    (contigs.select(text, by).write.partitionBy(by) if by else contigs.select(text).write).text(path)


def embeddings_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(contig, embedding): a name and float columns; a header line has no number in its second column."""
    parts = F.split("value", "\t")
    values = F.transform(F.slice(parts, F.lit(2), F.greatest(F.lit(1), F.size(parts))), lambda x: x.try_cast("float"))
    return spark.read.text(path).where(F.trim("value") != "").select(parts[0].alias("contig"), values.alias("embedding")).where(F.get("embedding", F.lit(0)).isNotNull())


def seed_list(spark: SparkSession, path: str) -> DataFrame:
    """(contig): one a line, or the first of tab-separated columns; # starts a comment."""
    name = F.trim(F.split("value", "\t")[0])
    return spark.read.text(path).where(~F.col("value").startswith("#")).select(name.alias("contig")).where("contig <> ''")


def domtblout(spark: SparkSession, path: str, coverage: float = 0.4) -> DataFrame:
    """(target, marker, qlen, ali_from, ali_to): hits of at least 17 columns that cover enough of the query."""
    c = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.size(c) >= 17))
    rows = rows.select(c[0].alias("target"), F.get(c, F.lit(3)).alias("marker"), F.get(c, F.lit(5)).try_cast("int").alias("qlen"), F.get(c, F.lit(15)).try_cast("int").alias("ali_from"), F.get(c, F.lit(16)).try_cast("int").alias("ali_to"))
    return rows.where((F.col("qlen") > 0) & ((F.col("ali_to") - F.col("ali_from")) / F.col("qlen") >= coverage))


def marker_sets(spark: SparkSession, path: str, domain: str) -> DataFrame:
    """(domain, set_id, marker) of the first line that is no comment: sets in the notation set(['a', 'b'])."""
    line = spark.read.text(path, wholetext=True).select(F.get(F.filter(F.split("value", "\n"), lambda x: (F.trim(x) != "") & ~x.startswith("#")), F.lit(0)).alias("line"))
    sets = line.select(F.posexplode(F.regexp_extract_all("line", F.lit(r"set\(\[([^\]]*)\]\)"), 1)).alias("set_id", "body"))
    return sets.select(F.lit(domain).alias("domain"), "set_id", F.explode(F.regexp_extract_all("body", F.lit(r"'([^']+)'"), 1)).alias("marker"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a SAM text: pos is 0-based, qual an array of Phred values."""
    c = F.split("value", "\t")
    tags = F.slice(c, F.lit(12), F.size(c))
    tag = lambda name: F.regexp_extract(F.get(F.filter(tags, lambda t: t.startswith(name + ":")), F.lit(0)), r"^[^:]+:[^:]+:(.*)$", 1)
    rows = spark.read.text(path).where(~F.col("value").startswith("@") & (F.size(c) >= 11))
    return rows.select(F.get(c, F.lit(0)).alias("qname"), F.get(c, F.lit(1)).cast("int").alias("flag"), F.get(c, F.lit(2)).alias("contig"), (F.get(c, F.lit(3)).cast("int") - 1).alias("pos"), F.get(c, F.lit(4)).cast("int").alias("mapq"), F.get(c, F.lit(5)).alias("cigar"), F.get(c, F.lit(8)).cast("int").alias("isize"), F.get(c, F.lit(9)).alias("seq"), F.transform(F.split(F.get(c, F.lit(10)), ""), lambda x: F.ascii(x) - 33).alias("qual"), tag("MD").alias("md"), tag("NM").try_cast("int").alias("nm"), tag("AS").try_cast("int").alias("as"))


def aligned_blocks(reads: DataFrame, skip_flags: int = 0x804) -> DataFrame:
    """(contig, start, end): half-open reference blocks of M, = and X operations, without unmapped and supplementary reads."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+)([MIDNSHP=X])"), 0)
    step = F.aggregate(
        ops,
        F.struct(F.col("pos").cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out")),
        lambda s, op: F.struct(
            F.when(F.substring(op, -1, 1).isin("M", "=", "X", "D", "N"), s.at + op.substr(F.lit(1), F.length(op) - 1).cast("long")).otherwise(s.at).alias("at"),
            F.when(F.substring(op, -1, 1).isin("M", "=", "X"), F.concat(s.out, F.array(F.struct(s.at.alias("start"), (s.at + op.substr(F.lit(1), F.length(op) - 1).cast("long")).alias("end"))))).otherwise(s.out).alias("out"),
        ),
    )
    return reads.where(F.col("flag").bitwiseAND(skip_flags) == 0).select("contig", F.explode(step.out).alias("b")).select("contig", "b.start", "b.end")


def write_run(rows: DataFrame, path: str) -> None:
    """A run archive: a Parquet table partitioned by run_id."""
    rows.write.partitionBy("run_id").mode("append").parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if run_id is None else rows.where(F.col("run_id") == run_id)


def write_tsv(rows: DataFrame, path: str) -> None:
    rows.write.option("sep", "\t").option("header", True).csv(path)


def hmm_accessions(spark: SparkSession, path: str) -> DataFrame:
    """(name, accession) of the models of an HMM file that have one; versions of PF accessions are cut off. Records end with //."""
    records = spark.read.option("lineSep", "//\n").text(path)
    field = lambda key: F.regexp_extract("value", rf"(?m)^{key}[ \t]+([^\n]*?)[ \t]*$", 1)
    rows = records.select(field("NAME").alias("name"), field("ACC").alias("accession")).where("name <> '' AND accession <> ''")
    return rows.withColumn("accession", F.when(F.col("accession").startswith("PF"), F.substring_index("accession", ".", 1)).otherwise(F.col("accession")))


def bin_directory(spark: SparkSession, path: str) -> DataFrame:
    """(bin, contig, length, seq) of the FASTA files (.fa, .fasta) in a folder; a bin is named by its file."""
    rows = fasta(spark, f"{path}/*.{{fa,fasta}}", F.regexp_replace(F.col("_metadata.file_name"), r"\.(fa|fasta)$", "").alias("bin"))
    return rows.select("bin", "contig", "length", "seq")


# The columns of the reports.
REPORTS = {
    "bin_stats": "bin completeness contamination contigs length",
    "damage_per_bin": "bin p_ancient lambda5 lambda3 amplitude_5p amplitude_3p ct_1p ga_1p damage_class",
    "contig_flags": "contig length breaks last chimeric",
}


def write_report(rows: DataFrame, path: str, report: str) -> None:
    """rows as TSV under the report's columns, in their order, whatever names they have."""
    names = REPORTS[report].split()
    if len(rows.columns) != len(names):
        raise ValueError(f"{report} has {len(names)} columns, not {len(rows.columns)}")
    write_tsv(rows.toDF(*names), path)
