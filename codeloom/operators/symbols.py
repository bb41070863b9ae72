"""Symbols, imports, calls and rationale comments, line by line with the JVM's patterns; and where imports and calls lead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The lines that declare symbols, by language; the group is the name.
CLASSES = {"python": r"^\s*class\s+([A-Za-z_]\w*)", "javascript": r"^\s*(?:export\s+)?(?:default\s+)?class\s+([A-Za-z_$][\w$]*)", "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?(?:class|interface|enum)\s+([A-Za-z_$][\w$]*)", "go": r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)", "java": r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum|record)\s+([A-Za-z_]\w*)"}
FUNCTIONS = {"python": r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", "javascript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "typescript": r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)", "go": r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", "java": r"^\s+(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+(?:[\w<>\[\],.]+\s+)*([A-Za-z_]\w*)\s*\("}
IMPORTS = {"python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "javascript": r"^\s*import\s.*?['\"]([^'\"]+)['\"]|require\(['\"]([^'\"]+)['\"]\)", "typescript": r"^\s*import\s.*?['\"]([^'\"]+)['\"]|require\(['\"]([^'\"]+)['\"]\)", "go": r"^\s+(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$|^import\s+\"([\w./-]+)\"", "java": r"^import\s+(?:static\s+)?([\w.]+)\s*(\.\*)?;"}
RATIONALE = r"^\s*(?:#|//)\s*(NOTE|IMPORTANT|HACK|WHY|RATIONALE|TODO|FIXME):\s*(.*?)\s*$"


def _by_language(language: Column, line: Column, patterns: dict[str, str], group: int = 1) -> Column:
    out = F.lit("")
    for name, p in patterns.items():
        out = F.when(language == name, F.regexp_extract(line, p, group)).otherwise(out)
    return out


def lines(files: DataFrame, text: str = "content") -> DataFrame:
    """repo_id, file_path, language, line_no and line; carriage returns are dropped."""
    return files.select("repo_id", "file_path", "language", F.posexplode(F.split(text, "\r?\n")).alias("pos", "line")).select("repo_id", "file_path", "language", (F.col("pos") + 1).alias("line_no"), "line")


def declarations(files: DataFrame) -> DataFrame:
    """repo_id, file_path, symbol_name, symbol_type and start_line of the classes and functions that a line declares."""
    at = lines(files)
    kinds = F.array(F.struct(F.lit("class").alias("symbol_type"), _by_language(F.col("language"), F.col("line"), CLASSES).alias("name")), F.struct(F.lit("function").alias("symbol_type"), _by_language(F.col("language"), F.col("line"), FUNCTIONS).alias("name")))
    found = at.select("repo_id", "file_path", "line_no", F.explode(kinds).alias("k")).where("k.name <> ''")
    return found.select("repo_id", "file_path", F.col("k.name").alias("symbol_name"), "k.symbol_type", F.col("line_no").alias("start_line"))


def visibility(name: Column, language: Column) -> Column:
    """private for __x, protected for _x, and by the first letter in Go."""
    go = F.when(name.rlike("^[A-Z]"), "public").otherwise("private")
    return F.when(language == "go", go).when(name.rlike("^__") & ~name.rlike("__$"), "private").when(name.rlike("^_"), "protected").otherwise("public")


def imports(files: DataFrame) -> DataFrame:
    """repo_id, file_path and module, each once."""
    at = lines(files)
    module = F.coalesce(*[F.when(m != "", m) for m in (_by_language(F.col("language"), F.col("line"), IMPORTS), _by_language(F.col("language"), F.col("line"), {k: p for k, p in IMPORTS.items() if k != "java"}, 2))])
    return at.select("repo_id", "file_path", "language", module.alias("module")).where("module is not null").distinct()


def resolve_imports(imported: DataFrame, files: DataFrame) -> DataFrame:
    """repo_id, file_path, module and target: the file of the repository that an import means, the likeliest if there are several.

    Candidates are spelled out and joined on equality: for Python a module's file or package, for
    JavaScript and TypeScript a path relative to the file with the usual endings, for Java and
    Go a path that ends like the name.
    """
    here = F.regexp_replace("file_path", r"/?[^/]*$", "")
    dotted = F.regexp_replace("module", r"\.", "/")
    stems = F.when(F.col("language") == "python", F.array(dotted, F.concat_ws("/", F.lit("src"), dotted), F.concat_ws("/", F.lit("lib"), dotted))).when(
        F.col("language").isin("javascript", "typescript") & F.col("module").rlike(r"^\.\.?/"), F.array(_joined(here, F.col("module")))
    ).when(F.col("language") == "java", F.array(dotted, F.concat_ws("/", F.lit("src/main/java"), dotted), F.concat_ws("/", F.lit("src"), dotted)))
    endings = F.when(F.col("language") == "python", F.array(F.lit(".py"), F.lit("/__init__.py"))).when(F.col("language") == "java", F.array(F.lit(".java"))).otherwise(F.array(*[F.lit(e) for e in ("", ".js", ".ts", ".mjs", ".tsx", ".jsx", "/index.js", "/index.ts")]))
    tried = imported.withColumn("stems", stems).withColumn("endings", endings).where("stems is not null").select("repo_id", "file_path", "module", F.posexplode(F.flatten(F.transform("stems", lambda s: F.transform("endings", lambda e: F.concat(s, e))))).alias("rank", "target"))
    known = files.select("repo_id", F.col("file_path").alias("target")).distinct()
    return tried.join(known, ["repo_id", "target"]).groupBy("repo_id", "file_path", "module").agg(F.min_by("target", "rank").alias("target"))


def _joined(here: Column, relative: Column) -> Column:
    """A relative path joined to a directory, . and .. resolved."""
    parts = F.filter(F.split(F.concat_ws("/", here, relative), "/"), lambda p: (p != ".") & (p != ""))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.array_join(up, "/")


def call_sites(files: DataFrame) -> DataFrame:
    """repo_id, file_path, caller, callee and line_no of calls, the caller being the last function declared above; declarations themselves are left out."""
    at = lines(files)
    declared = _by_language(F.col("language"), F.col("line"), FUNCTIONS)
    marked = at.withColumn("declared", F.when(declared != "", declared))
    caller = F.last("declared", ignorenulls=True).over(Window.partitionBy("repo_id", "file_path").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    calls = marked.withColumn("caller", caller).where("declared is null").select("repo_id", "file_path", "caller", F.explode(F.regexp_extract_all("line", F.lit(r"([A-Za-z_][A-Za-z0-9_]*)\("), 1)).alias("callee"), "line_no")
    words = ["if", "for", "while", "switch", "catch", "return", "func", "function", "def", "class", "and", "or", "not", "in", "with", "assert"]
    return calls.where(F.col("caller").isNotNull() & ~F.col("callee").isin(words) & (F.col("callee") != F.col("caller")))


def rationale(files: DataFrame) -> DataFrame:
    """repo_id, file_path, line_no, kind and label of comments that give a reason, and of what is left to do."""
    at = lines(files).where(F.col("line").rlike(RATIONALE))
    return at.select("repo_id", "file_path", "line_no", F.regexp_extract("line", RATIONALE, 1).alias("kind"), F.substring(F.regexp_extract("line", RATIONALE, 2), 1, 80).alias("label"))
