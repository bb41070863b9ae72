"""Reading repositories, playbooks, graphs and pages from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import filters


def scan(spark: SparkSession, root: str, most: int = 1024 * 1024) -> DataFrame:
    """file_path (below root), size_bytes, content, content_hash and modified of the files under root that are to be indexed.

    Names are judged before contents are read into rows; files with a zero byte in their first 8 KiB are
    binary and left out, and Spark gives no rows for files without any byte.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/").removeprefix("file://").removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z0-9]+:/*(?=/)", ""), "^" + "".join("\\" + c if not c.isalnum() and c != "/" else c for c in base) + "/", "")
    rows = raw.withColumn("file_path", path).where(filters.admitted(F.col("file_path"), F.col("length"), most) & filters.admitted_dirs(F.col("file_path")))
    binary = F.instr(F.hex(F.substring("content", 1, 8192)), "00") > 0
    exact = F.exists(F.sequence(F.lit(1), F.least(F.length("content"), F.lit(8192))), lambda i: F.substring(F.col("content"), i, F.lit(1)) == F.unhex(F.lit("00"))) & (F.length("content") > 0)
    kept = rows.where(~(binary & exact))
    return kept.select("file_path", F.col("length").alias("size_bytes"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"), F.col("modificationTime").alias("modified"))


def detect(files: DataFrame, ignore: list[str] | None = None) -> DataFrame:
    """file_path, kind (code, document, paper, image or other), sensitive, ignored and n_words of scanned files."""
    ext = filters.suffix(F.col("file_path"))
    code = F.array(*[F.lit("." + e) for e in filters.LANGUAGES if e not in ("md", "json", "yml", "yaml", "tf")])
    kind = F.when(F.array_contains(code, ext), "code").when(ext.isin(".md", ".txt", ".rst"), F.when(text.paper_signs(F.col("content")) >= 3, "paper").otherwise("document")).when(ext == ".pdf", "paper").when(ext.isin(".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg"), "image").otherwise("other")
    return files.select("file_path", kind.alias("kind"), filters.sensitive(F.col("file_path")).alias("sensitive"), filters.ignored(F.col("file_path"), ignore or []).alias("ignored"), text.word_count(F.col("content")).alias("n_words"))


def playbooks(spark: SparkSession, path: str) -> DataFrame:
    """One row for each Markdown file: its front matter, sections, lists and code blocks."""
    raw = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("markdown"))
    c = F.col("markdown")
    field = lambda k: F.trim(F.regexp_extract(text.front_matter(c), rf"(?m)^{k}:[ \t]*[\"']?(.*?)[\"']?[ \t]*\r?$", 1))
    return raw.select(
        "path", field("name").alias("name"), field("version").alias("version"), field("category").alias("category"), text.section(c, "When to [Uu]se").alias("when_to_use"), text.bullets(text.section(c, "Anti-?[Pp]atterns")).alias("anti_patterns"), text.code_blocks(c).alias("code_blocks")
    )


def graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of graphs in node-link JSON."""
    raw = spark.read.option("multiLine", "true").json(path)
    edges = "links" if "links" in raw.columns else "edges"
    nodes = raw.select(F.explode("nodes").alias("n")).select("n.*")
    return nodes, raw.select(F.explode(edges).alias("e")).select("e.*").withColumnsRenamed({"source": "u", "target": "v"})


def pages(df: DataFrame) -> DataFrame:
    """url, kind, file_name, title and text of fetched pages (url, html); addresses that must not be fetched are left out."""
    kept = df.where(text.allowed_url(F.col("url")))
    return kept.select("url", text.url_type(F.col("url")).alias("kind"), text.file_name(F.col("url")).alias("file_name"), text.html_title(F.col("html"), F.col("url")).alias("title"), text.html_text(F.col("html")).alias("text"))
