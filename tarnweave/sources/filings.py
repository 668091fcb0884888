"""Reading and selecting filings: landed listings, text folders, manifests, and their sinks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Landed filing-history JSON, one file a company; the company number is padded to 10 digits."""
    rows = spark.read.option("multiLine", True).json(path)
    return rows.select(F.lpad(F.ltrim(F.col("cik").cast("string")), 10, "0").alias("cik"), "filings.recent.*")


def zip_history(history: DataFrame, arrays: list[str], keep: list[str]) -> DataFrame:
    """S3: parallel arrays to rows, as many as the shortest has; ``pos`` numbers them."""
    n = F.least(*[F.coalesce(F.size(a), F.lit(0)) for a in arrays])
    zipped = F.slice(F.arrays_zip(*arrays), 1, F.greatest(n, F.lit(0)))
    return history.select(*keep, F.posexplode(zipped).alias("pos", "z")).select(*keep, "pos", *[F.col(f"z.{a}").alias(a) for a in arrays])


def document_url(base: str, cik: Column, accession: Column, document: Column) -> Column:
    """Leading zeros of the company number and the accession's dashes go."""
    return F.concat(F.lit(f"{base}/Archives/edgar/data/"), cik.cast("long").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document)


def index_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, url, kind) of the first archive page that isn't a viewer's, else the first archive text."""
    hrefs = F.regexp_extract_all(html, F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    rows = pages.select(key, F.posexplode_outer(hrefs).alias("pos", "href"))
    ext = F.lower(F.element_at(F.split("href", r"\?"), 1))
    kind = F.when(ext.rlike(r"\.html?$"), "html").when(ext.endswith(".txt"), "txt")
    ok = F.col("href").contains("/Archives/edgar/data/") & ~F.lower("href").contains("/ixviewer") & kind.isNotNull()
    rank = F.struct((kind == "txt").alias("late"), F.col("pos"))
    best = rows.withColumn("kind", F.when(F.coalesce(ok, F.lit(False)), kind)).groupBy(key).agg(F.min_by(F.struct("href", "kind"), F.when(F.col("kind").isNotNull(), rank)).alias("b"))
    return best.select(key, F.when(F.col("b.kind").isNotNull(), F.col("b.href")).alias("url"), F.col("b.kind").alias("kind"))


def select_filings(rows: DataFrame, annual: str, years: Iterable[int], first: dict[str, int]) -> DataFrame:
    """Of (company, form, filed, accession), newest first: one ``annual`` form a fiscal year (the year before it was
    filed) of ``years``, and the first N of the other forms."""
    pos = F.row_number().over(Window.partitionBy("company").orderBy(F.desc("filed"), "accession"))
    rows = rows.withColumn("pos", pos).withColumn("fiscal_year", F.when(F.col("form") == annual, F.year("filed") - 1))
    rank = F.row_number().over(Window.partitionBy("company", "form", "fiscal_year").orderBy("pos"))
    limit = F.when((F.col("form") == annual) & F.col("fiscal_year").isin(list(years)), 1)
    for form, n in first.items():
        limit = limit.when(F.col("form") == form, n)
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank", "pos")


def to_download(selected: DataFrame, landed: DataFrame, label: str) -> DataFrame:
    """What isn't landed yet, one filing a label, the first by position."""
    rank = F.row_number().over(Window.partitionBy(label).orderBy("pos"))
    return selected.join(landed.select(label), label, "left_anti").withColumn("_r", rank).where("_r = 1").drop("_r")


def choose_body(rows: DataFrame, body: str, fallback: str, least: int = 5000) -> Column:
    """The fallback where the body is missing or short."""
    return F.when(F.col(body).isNull() | (F.length(body) < least), F.coalesce(F.col(fallback), F.col(body))).otherwise(F.col(body))


def read_texts(spark: SparkSession, paths: list[str], glob: str = "*.txt") -> DataFrame:
    """(file, folder, text) of whole text files; bytes that aren't UTF-8 are dropped."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(paths)
    parts = F.split("path", "/")
    text = F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit(""))
    return rows.select(F.element_at(parts, -1).alias("file"), F.element_at(parts, -2).alias("folder"), text.alias("text"))


def resolve_file(files: DataFrame, names: DataFrame, folders: list[str]) -> DataFrame:
    """For each ``file`` of ``names`` its text from the first folder that has it, else null."""
    rank = F.array_position(F.array(*map(F.lit, folders)), F.col("folder"))
    best = files.where(rank > 0).groupBy("file").agg(F.min_by("text", rank).alias("text"))
    return names.join(best, "file", "left")


def new_files(files: DataFrame, done: DataFrame) -> DataFrame:
    """Skip what exists."""
    return files.join(done.select("file"), "file", "left_anti")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The upload manifest with every field trimmed."""
    rows = spark.read.csv(path, header=True)
    return rows.select(*[F.trim(F.col(f"`{c}`")).alias(c.strip()) for c in rows.columns])


def manifest_status(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Each row's ``status``: skipped without file, linked_to or title; failed where the file isn't there."""
    missing = F.lit(False)
    for c in ("file", "linked_to", "title"):
        missing = missing | (F.coalesce(F.col(c), F.lit("")) == "")
    rows = manifest.join(files.select("file").distinct().withColumn("_there", F.lit(True)), "file", "left")
    return rows.withColumn("status", F.when(missing, "skipped").when(F.col("_there"), "uploaded").otherwise("failed")).drop("_there")


def write_manifest(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes by type and edges by type, as Parquet folders."""
    nodes.write.mode("overwrite").partitionBy("type").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/nodes"), spark.read.parquet(f"{path}/edges")


def export_json(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The same as JSON lines, non-ASCII kept."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/relationships")


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map from chunk to phrases, to rows (shadow_id, phrase, score)."""
    text = spark.read.text(path, wholetext=True)
    parsed = F.from_json("value", "map<string, array<struct<text: string, score: double>>>")
    rows = text.select(F.explode(parsed).alias("shadow_id", "k")).select("shadow_id", F.explode("k").alias("k"))
    return rows.select("shadow_id", F.col("k.text").alias("phrase"), "k.score")


def write_keywords(keywords: DataFrame, path: str) -> None:
    keywords.write.mode("overwrite").parquet(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a question."""
    results.write.mode("overwrite").json(path)


def render_results(results: DataFrame) -> DataFrame:
    """A text rendering of each answer and its paths."""
    paths = F.array_join(F.transform("supporting_paths", lambda p: F.format_string("  %.4f  %s", p["score"], p["label"])), "\n")
    return results.select("qid", F.concat(F.lit("Q: "), F.col("question"), F.lit("\nA: "), F.col("answer"), F.lit("\n"), paths).alias("rendering"))
