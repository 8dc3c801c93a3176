"""Delimited exports, sequence files, gene maps, gene sets and result tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from omicspark.functions.expressions import column
from omicspark.operators.psm import InvalidInput


_SOURCE = "__source_file"
#: Above the size of a file, so that each file is one partition.
_ONE_FILE = 1 << 40
#: First lines that one job reads.
_FILES_PER_JOB = 256
#: The columns of result shards that hold numbers; all others are text.
RESULT_NUMBERS = (
    "logFC", "log2FC", "pvalue", "pval", "adj.pvalue", "adjPval", "adj_pvalue", "SE", "se", "Tvalue", "t", "DF", "df",
    "LogIntensities", "Abundance", "ImputationPercentage", "MissingPercentage",
)


def _many(paths: str | Sequence[str]) -> list[str]:
    return [paths] if isinstance(paths, str) else list(paths)


def header_separator(header: str) -> str:
    """Tab when the header has at least as many tabs as commas, else comma."""
    tabs, commas = header.count("\t"), header.count(",")
    if tabs and tabs >= commas:
        return "\t"
    if commas:
        return ","
    raise InvalidInput(f"cannot tell the delimiter of {header[:200]!r}")


def first_lines(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, str]:
    """File -> its first line; files without a line are left out.

    Each file is one partition under a limit of one row, so its task ends after one buffer and the bytes read
    grow with the number of files and not with their size. The files of a job are one union of such reads. The
    settings that keep a file whole belong to a session of its own.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", str(_ONE_FILE))
    session.conf.set("spark.sql.files.openCostInBytes", str(_ONE_FILE))
    files = sorted(unquote(f) for f in session.read.text(_many(paths)).inputFiles())
    found: dict[str, str] = {}
    for at in range(0, len(files), _FILES_PER_JOB):
        group = files[at : at + _FILES_PER_JOB]
        heads = [session.read.text(f).limit(1).select(F.lit(i).alias("file"), "value") for i, f in enumerate(group)]
        found |= {group[i]: line for i, line in reduce(DataFrame.unionAll, heads).collect()}
    return found


def files_by_header(spark: SparkSession, paths: str | Sequence[str]) -> dict[str, list[str]]:
    """First line -> files that begin with it. One row per file reaches the driver, which lists the files anyway."""
    groups: dict[str, list[str]] = {}
    for path, line in sorted(first_lines(spark, paths).items()):
        groups.setdefault(line.lstrip("\ufeff").rstrip("\r"), []).append(path)
    return groups


def _stacked(parts: Sequence[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def read_psm(
    spark: SparkSession, paths: str | Sequence[str], sep: str | None = None, with_filename: bool = False
) -> DataFrame:
    """Delimited files with every column as text, stacked by column name.

    Each file's own header names its columns, in whatever order, and tells its
    delimiter; files with the same header are one scan. A column that a file
    lacks is null there. ``with_filename`` adds ``filename``, the base name.
    """
    groups = files_by_header(spark, paths)
    if not groups:
        raise InvalidInput(f"no lines in {paths}")
    df = _stacked([
        spark.read.csv(files, sep=sep or header_separator(header), header=True, inferSchema=False, escape='"')
        .select("*", *([F.col("_metadata.file_path").alias(_SOURCE)] if with_filename else []))
        for header, files in groups.items()
    ])
    if not with_filename:
        return df
    name = F.url_decode(F.replace(F.col(_SOURCE), F.lit("+"), F.lit("%2B")))
    return df.withColumn("filename", F.regexp_extract(name, r"([^/\\]+)$", 1)).drop(_SOURCE)


def read_result_tsv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Typed tab-separated table in which NA and NaN are null."""
    df = spark.read.csv(_many(path), sep="\t", header=True, inferSchema=True, nullValue="NA")
    cleaned = []
    for name, kind in df.dtypes:
        c = column(name)
        if kind in {"double", "float"}:
            c = F.when(~F.isnan(c), c)
        elif kind == "string":
            c = F.when(c != "NaN", c)
        cleaned.append(c.alias(name))
    return df.select(*cleaned)


def union_result_shards(
    spark: SparkSession, paths: Sequence[str], numbers: Sequence[str] = RESULT_NUMBERS
) -> DataFrame:
    """Result shards stacked by column name; a column a shard lacks is null there.

    The types are given and not guessed: the columns of ``numbers`` are doubles,
    all others text, so ids of digits stay text. NA and NaN are null; text where
    a number belongs is null too. Shards with the same header are one scan.
    """
    if not paths:
        raise InvalidInput("no result shards")
    text = read_psm(spark, paths, sep="\t")
    cleaned = []
    for name in text.columns:
        c = F.when(~column(name).isin("NA", "NaN"), column(name))
        cleaned.append((c.try_cast("double") if name in numbers else c).alias(name))
    return text.select(*cleaned)


def read_artifact(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def parse_fasta(records: DataFrame) -> DataFrame:
    """(accession, gene, sequence) from records in column ``value``, without the '>' of their header."""
    text = F.regexp_replace(F.col("value"), "\r", "")
    header = F.regexp_extract(text, r"^([^\n]*)", 1)
    body = F.regexp_replace(F.expr("substring(t, length(h) + 1)"), r"\s", "")
    framed = records.where(F.trim("value") != "").select(text.alias("t"), header.alias("h"))
    listed = F.regexp_extract("h", r"^(?:sp|tr)\|([^|]+)\|", 1)
    return framed.select(
        F.when(listed != "", listed).otherwise(F.regexp_extract("h", r"^\s*(\S+)", 1)).alias("accession"),
        F.regexp_extract("h", r"\bGN=(\S+)", 1).alias("gene"),
        F.upper(body).alias("sequence"),
    ).where(F.col("accession") != "")


def read_fasta(spark: SparkSession, path: str | Sequence[str], accessions: DataFrame | None = None) -> DataFrame:
    """Sequence file; ``accessions`` keeps only those ids and their isoform-free form.

    A record begins with a line that begins with '>'; the sign may stand inside
    a header. A file begins with its first header.
    """
    records = spark.read.text(_many(path), lineSep="\n>")
    parsed = parse_fasta(records.select(F.regexp_replace("value", "^>", "").alias("value")))
    if accessions is None:
        return parsed
    exact = accessions.select(F.col("accession"))
    wanted = exact.unionByName(exact.select(F.split("accession", "-")[0].alias("accession"))).distinct()
    return parsed.join(wanted, "accession", "left_semi")


GENE_ID_COLUMNS = ("Entry",)
GENE_NAME_COLUMNS = ("Gene Names", "Gene.Names", "Gene_Names", "GeneNames")


def read_gene_map(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """(accession, gene): the first gene name of each entry, the smallest where an entry repeats."""
    df = spark.read.csv(_many(path), sep="\t", header=True, inferSchema=False)
    key = next((c for c in GENE_ID_COLUMNS if c in df.columns), None)
    name = next((c for c in GENE_NAME_COLUMNS if c in df.columns), None)
    if key is None or name is None:
        raise InvalidInput(f"no accession or gene column in {df.columns}")
    gene = F.regexp_extract(column(name), "^([^ ;]*)", 1)
    mapped = df.select(column(key).alias("accession"), gene.alias("gene"))
    mapped = mapped.where(F.col("accession").isNotNull() & (F.coalesce(F.col("gene"), F.lit("")) != ""))
    return mapped.groupBy("accession").agg(F.min("gene").alias("gene"))


def parse_gmt(lines: DataFrame) -> DataFrame:
    """(set, gene) rows from 'name<tab>description<tab>gene...' lines."""
    parts = F.split(F.trim(F.regexp_replace("value", r"[\r\n]+$", "")), "\t")
    rows = lines.select(parts.alias("p")).where(F.size("p") >= 3)
    genes = F.slice(F.col("p"), F.lit(3), F.size("p") - 2)
    exploded = rows.select(F.col("p")[0].alias("set"), F.explode(genes).alias("gene"))
    return exploded.where(F.col("gene") != "").distinct()


def read_gmt(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return parse_gmt(spark.read.text(_many(path)))
