"""Files of a book's folder as tables: texts, images, inventories, ledgers, and the members of archives."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import audit, pages
from ..operators.conservation import stem
from ..session import new_path

# Files that a file system leaves beside others.
SIDECARS = [".DS_Store", "Thumbs.db"]


def _files(spark: SparkSession, folder: str, patterns: str) -> DataFrame:
    """patterns: with commas between. Files of folder and all below, each once, without what file systems leave there."""
    glob = "{" + ",".join(p.strip() for p in patterns.split(",") if p.strip()) + "}"
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return rows.withColumn("name", name).where(~F.startswith(name, F.lit("._")) & ~name.isin(SIDECARS))


def files(spark: SparkSession, folder: str, patterns: str = "*") -> DataFrame:
    """(path, name, size) of files; their content is not read."""
    return _files(spark, folder, patterns).select("path", "name", F.col("length").alias("size"))


def file_digests(spark: SparkSession, folder: str, patterns: str = "*") -> DataFrame:
    """(path, name, size, sha256) of files of less than 2 GB each."""
    return _files(spark, folder, patterns).select("path", "name", F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def pending_files(inputs: DataFrame, outputs: DataFrame, first: int | None = None) -> DataFrame:
    """inputs, outputs: of files. Inputs (path, name, place) for whose stem no output that is not empty exists, in
    natural order; with first, only so many of them."""
    done = outputs.where("size > 0").select(stem("name").alias("stem")).distinct()
    left = inputs.withColumn("stem", stem("name")).join(done, "stem", "left_anti").select("path", "name")
    placed = pages.natural_order(left.withColumn("key", F.lit(0)), ["key"], "name").drop("key")
    return placed if first is None else placed.where(F.col("place") <= first)


def page_texts(spark: SparkSession, folder: str) -> DataFrame:
    """(source_page, text) of the files page_<number>.md of a folder."""
    rows = spark.read.option("wholetext", True).option("pathGlobFilter", "page_*.md").text(folder)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^page_0*(\d+)\.md$", 1)
    return rows.select(F.nullif(number, F.lit("")).cast("int").alias("source_page"), F.col("value").alias("text")).where("source_page is not null")


PAGE_ROW = "source_page int, archive_image string, archive_sha256 string, ocr_image string, ocr_sha256 string, render_mode string, ocr_state string, attempts int, representation string, text_sha256 string, final_text_sha256 string, fallback_reason string"
SOURCE = "filename string, sha256 string, page_count int, included_pages array<int>, excluded_pages array<struct<page:int,reason:string>>, render map<string,string>"
MANIFEST = f"schema_version int, project string, source_pdf struct<{SOURCE}>, pages array<struct<{PAGE_ROW}>>"


def _violations(books: DataFrame, rows: DataFrame) -> list:
    found = pages.volume_violations(books, rows).withColumn("source_page", F.lit(None).cast("int")).unionByName(pages.page_violations(rows))
    return found.limit(20).collect()  # an error names the first ones


def read_manifests(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Inventories, one JSON document a volume in <book>/<volume>.json below path: (books, pages) as tables. A document
    that does not parse or breaks a rule of volume_violations or page_violations is an error."""
    rows = spark.read.schema(MANIFEST).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).json(path)
    place = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+\.json$", 1)
    volume = F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).cast("int")
    keyed = rows.select(place.alias("book_id"), volume.alias("volume"), "*")
    books = keyed.drop("pages")
    listed = keyed.select("book_id", "volume", F.explode("pages").alias("p")).select("book_id", "volume", "p.*")
    if wrong := _violations(books, listed):
        raise ValueError(f"inventories break rules: {wrong}")
    return books, listed


def write_manifests(books: DataFrame, rows: DataFrame, path: str) -> None:
    """Inventories as JSON lines, one a volume. They are checked, written to a new folder and put in place by one
    renaming; a folder that is there already stays as it is, and is an error."""
    if wrong := _violations(books, rows):
        raise ValueError(f"inventories break rules: {wrong}")
    row = F.struct("source_page", *(c for c in rows.columns if c not in ("book_id", "volume", "source_page")))
    listed = rows.groupBy("book_id", "volume").agg(F.sort_array(F.collect_list(row)).alias("pages"))
    spark = books.sparkSession
    staged = new_path(spark, "inventories")
    books.join(listed, ["book_id", "volume"]).write.json(staged)
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, source = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(staged)
    system = target.getFileSystem(conf)
    if system.exists(target) or not system.rename(source, target):
        raise FileExistsError(path)


LEDGER = "schema_version int, timestamp string, event string, stage string, status string, result_status string, billing_status string, ledger_id string, page string, page_sha256 string, model string, http_status int, error_type string, elapsed_s double"


def read_ledger(spark: SparkSession, path: str, refuse: bool = True) -> DataFrame:
    """A ledger of JSON lines. A line that does not parse is an error; with refuse off it is a row of nulls whose text is
    in broken, and billing is unknown for what it stood for."""
    if refuse:
        return spark.read.schema(LEDGER).option("mode", "FAILFAST").json(path)
    return spark.read.schema(f"{LEDGER}, broken string").option("columnNameOfCorruptRecord", "broken").json(path)


# The most members of an archive, the largest member and the most bytes of all.
MOST_MEMBERS, MOST_BYTES, TOTAL_BYTES = 10_000, 64 << 20, 256 << 20
_MEMBER = T.StructType([T.StructField(n, t) for n, t in (("path", T.StringType()), ("ordinal", T.IntegerType()), ("member", T.StringType()), ("is_dir", T.BooleanType()), ("is_link", T.BooleanType()), ("size", T.LongType()), ("content", T.BinaryType()))])


def _members(content: bytes) -> Iterator[tuple]:
    """Of an archive its members (name, is_dir, is_link, size, content), without content for those too large or behind
    the bytes that count; nothing for other files."""
    total = 0
    if zipfile.is_zipfile(io.BytesIO(content)):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            for info in archive.infolist():
                link = (info.external_attr >> 16) & 0o170000 == 0o120000
                total += 0 if info.is_dir() else info.file_size
                read = not info.is_dir() and not link and info.file_size <= MOST_BYTES and total <= TOTAL_BYTES
                yield info.filename, info.is_dir(), link, info.file_size, archive.read(info) if read else None
    elif tarfile.is_tarfile(io.BytesIO(content)):
        with tarfile.open(fileobj=io.BytesIO(content)) as archive:
            for info in archive:
                total += info.size if info.isfile() else 0
                read = info.isfile() and info.size <= MOST_BYTES and total <= TOTAL_BYTES
                yield info.name, info.isdir(), not (info.isfile() or info.isdir()), info.size, archive.extractfile(info).read() if read else None


def archive_members(spark: SparkSession, folder: str, patterns: str = "*") -> DataFrame:
    """(path, ordinal, member, is_dir, is_link, size, content) of the members of zip and tape archives; a file that is
    none, or breaks off, is one row with its own content and no member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows = [(path, i, *m) for i, m in enumerate(_members(content))]
                except (OSError, RuntimeError, zipfile.BadZipFile, tarfile.TarError):
                    rows = []
                rows = rows or [(path, 0, None, False, False, len(content), content)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary()), strict=True)], _MEMBER.names)

    return _files(spark, folder, patterns).select("path", "content").mapInArrow(run, _MEMBER)


def archive_findings(members: DataFrame) -> DataFrame:
    """members: of archive_members. (path, member, rule) of what may not be published: archives with too many or equal
    members, unsafe names, links, denied paths, sizes over the limits, archives within, and secrets in what is read. Of
    a member the first that applies; a secret's value is not told."""
    inner = members.where("member is not null")
    per = inner.groupBy("path").agg(F.count("*").alias("n"), F.count_distinct("member").alias("names"))
    whole = per.where(F.col("n") > MOST_MEMBERS).select("path", F.lit(None).cast("string").alias("member"), F.lit("archive-member-limit").alias("rule"))
    twice = per.where("names < n").select("path", F.lit(None).cast("string").alias("member"), F.lit("duplicate-archive-member").alias("rule"))
    before = F.when(audit.unsafe_member(F.col("member"), F.col("is_dir")), "unsafe-archive-path").when(F.col("is_link"), "archive-link-not-allowed").otherwise(audit.denied_path(F.col("member")))
    own = F.when(F.col("member").isNull(), audit.denied_path(F.regexp_extract("path", r"([^/]*)$", 1)))
    judged = members.withColumn("first", F.coalesce(own, F.when(F.col("member").isNotNull(), before)))
    sized = audit.size_findings(judged.where("first is null and not is_dir and member is not null"), ["path"], ["ordinal"], "size", MOST_BYTES, TOTAL_BYTES)
    nested = sized.withColumn("rule", F.coalesce("rule", F.when(audit.looks_like_archive(F.col("content")), "nested-archive-not-allowed")))
    text = nested.where("rule is null").unionByName(judged.where("first is null and member is null").withColumn("rule", F.lit(None).cast("string")))
    found = audit.secret_findings(text.select(F.struct("path", "member").alias("key"), F.decode("content", "ISO-8859-1").alias("text")), "key", "text").select("key.path", "key.member", "rule")
    return (
        judged.where("first is not null").select("path", "member", F.col("first").alias("rule"))
        .unionByName(nested.where("rule is not null").select("path", "member", "rule"))
        .unionByName(found).unionByName(whole).unionByName(twice)
    )
