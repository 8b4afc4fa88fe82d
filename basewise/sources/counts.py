"""Tables of counts as text, and what runs write beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .banks import read_fasta


def write_counts(counts: DataFrame, path: str, sep: str = "\t", at_least: int = 1, ordered: bool = False) -> None:
    """Lines of kmer, separator, n; ordered sorts all of them by kmer."""
    kept = counts.where(F.col("n") >= at_least)
    kept = kept.orderBy("kmer") if ordered else kept
    kept.select(F.concat_ws(sep, "kmer", F.col("n").cast("string")).alias("value")).write.text(path)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """kmer and n of lines separated by a space or a tab."""
    parts = F.split(F.trim("value"), "[ \t]+")
    return spark.read.text(path).where(F.trim("value") != "").select(F.get(parts, F.lit(0)).alias("kmer"), F.get(parts, F.lit(1)).cast("long").alias("n"))


def write_count_fasta(counts: DataFrame, path: str) -> None:
    """Two lines a k-mer: >n and the k-mer."""
    counts.select(F.concat(F.lit(">"), F.col("n").cast("string"), F.lit("\n"), F.col("kmer")).alias("value")).write.text(path)


def read_count_fasta(spark: SparkSession, path: str) -> DataFrame:
    return read_fasta(spark, path).select(F.col("seq").alias("kmer"), F.col("comment").cast("long").alias("n"))


def write_fasta(seqs: DataFrame, path: str, gzip: bool = False, comment: str = "comment") -> None:
    value = F.concat(F.lit(">"), F.coalesce(F.col(comment).cast("string"), F.lit("")), F.lit("\n"), F.col("seq"))
    seqs.select(value.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def write_fastq(seqs: DataFrame, path: str, gzip: bool = False, comment: str = "comment") -> None:
    value = F.concat(F.lit("@"), F.coalesce(F.col(comment).cast("string"), F.lit("")), F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.col("quality"))
    seqs.select(value.alias("value")).write.option("compression", "gzip" if gzip else "none").text(path)


def write_histogram(table: DataFrame, path: str) -> None:
    """Lines of count, tab, n_kmers."""
    table.orderBy("count").select("count", "n_kmers").write.option("sep", "\t").csv(path)


def write_super_kmers(routed: DataFrame, path: str) -> None:
    """Super-k-mers in one folder per part; each task writes a file there."""
    routed.write.partitionBy("part").parquet(path)


def read_super_kmers(spark: SparkSession, path: str) -> DataFrame:
    """What ``write_super_kmers`` wrote; a condition on part reads its folder only."""
    return spark.read.parquet(path)


def write_partition_info(routed: DataFrame, path: str) -> None:
    """Lines of what, its key, n_super_kmers and n_kmers with tabs between: one of the total, one for each part and one for each minimizer. Rows are super-k-mers or ``minimizer_totals``."""
    n = F.sum("n_super_kmers") if "n_super_kmers" in routed.columns else F.count("*")
    sums = routed.groupBy("part", "minimizer").agg(n.alias("s"), F.sum("n_kmers").alias("k"))
    each = [sums.groupBy().agg, sums.groupBy("part").agg, sums.groupBy("minimizer").agg]
    keys = [F.lit(""), F.col("part").cast("string"), F.col("minimizer")]
    zero, lines = F.lit(0).cast("long"), None
    for what, agg, key in zip(("total", "part", "minimizer"), each, keys, strict=True):
        rows = agg(*(F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in "sk")).select(F.concat_ws("\t", F.lit(what), key, F.col("s").cast("string"), F.col("k").cast("string")).alias("value"))
        lines = rows if lines is None else lines.unionByName(rows)
    lines.write.text(path)


def read_partition_info(spark: SparkSession, path: str) -> DataFrame:
    """what, key, n_super_kmers and n_kmers, as ``write_partition_info`` wrote them."""
    parts = F.split("value", "\t")
    columns = [parts[0].alias("what"), parts[1].alias("key"), parts[2].cast("long").alias("n_super_kmers"), parts[3].cast("long").alias("n_kmers")]
    return spark.read.text(path).select(*columns)


def write_bloom(table: DataFrame, path: str, bits: int, hashes: int) -> None:
    """A filter's words, which carry its size and its number of hashes."""
    table.withColumn("bits", F.col("bits").alias("bits", metadata={"bits": bits, "hashes": hashes})).write.parquet(path)


def read_bloom(spark: SparkSession, path: str) -> tuple[DataFrame, int, int]:
    """The words of a filter, its bits and its hashes."""
    table = spark.read.parquet(path)
    about = table.schema["bits"].metadata
    return table, about["bits"], about["hashes"]


def write_solid(counts: DataFrame, path: str, kmer_size: int) -> None:
    """A table of solid k-mers that carries its k."""
    counts.withColumn("kmer", F.col("kmer").alias("kmer", metadata={"kmer_size": kmer_size})).write.parquet(path)


def read_solid(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """A table of solid k-mers and its k."""
    table = spark.read.parquet(path)
    return table, table.schema["kmer"].metadata["kmer_size"]


def write_properties(spark: SparkSession, properties: dict[str, object], path: str) -> None:
    """Run properties as one JSON line."""
    import json

    spark.createDataFrame([(json.dumps(properties, sort_keys=True, default=str),)], "value string").coalesce(1).write.text(path)


def read_properties(spark: SparkSession, path: str) -> dict[str, object]:
    import json

    return json.loads(spark.read.text(path).first()[0])


def convert_bank(bank: DataFrame, path: str, min_length: int = 1) -> DataFrame:
    """Write a bank packed, and return its numbers: n_seqs, bases and bytes packed."""
    from .banks import to_packed

    to_packed(bank, min_length).write.parquet(path)
    back = bank.sparkSession.read.parquet(path)
    return back.agg(F.count("*").alias("n_seqs"), F.sum(F.col("n_bases").cast("long")).alias("bases"), F.sum(F.octet_length("packed").cast("long")).alias("packed_bytes"))
