"""Predicates over files, symbols and rows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is admitted to an index, and what is not.
EXTENSIONS = [
    ".py", ".pyi", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".vue", ".svelte", ".go", ".rs", ".java", ".kt", ".kts", ".scala", ".groovy", ".gradle", ".c", ".cpp",
    ".cc", ".cxx", ".h", ".hpp", ".hxx", ".cs", ".csx", ".fs", ".fsx", ".vb", ".vbs", ".rb", ".php", ".swift", ".m", ".mm", ".dart", ".ex", ".exs", ".erl", ".hs", ".lua",
    ".pl", ".pm", ".r", ".R", ".zig", ".v", ".clj", ".cljs", ".nim", ".cr", ".jl", ".ml", ".mli", ".html", ".htm", ".jsp", ".jspx", ".aspx", ".cshtml", ".razor", ".css",
    ".scss", ".sass", ".less", ".graphql", ".gql", ".sql", ".proto", ".md", ".rst", ".txt", ".yaml", ".yml", ".json", ".toml", ".xml", ".ini", ".cfg", ".env",
    ".properties", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".tf", ".hcl", ".dockerfile",
]
IGNORED_DIRS = [
    ".git", ".svn", ".hg", ".bzr", "__pycache__", ".venv", "venv", "env", ".env", ".eggs", ".tox", ".nox", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".pytype",
    "site-packages", "node_modules", ".next", ".nuxt", ".output", ".turbo", "bower_components", ".parcel-cache", ".cache", "target", ".gradle", ".mvn", "bin", "obj",
    "packages", ".vs", "vendor", "build", "dist", "out", "output", "_build", "cmake-build-debug", "cmake-build-release", ".idea", ".vscode", ".eclipse", ".settings",
    ".project", "coverage", "htmlcov", ".nyc_output", "_site", "site", ".docusaurus", ".terraform", ".serverless", "generated", "auto-generated", ".generated",
    "migrations", "__snapshots__", "__mocks__", "__fixtures__",
]
IGNORED_PARTS = [
    ".pyc", ".pyo", ".pyd", ".so", ".dll", ".dylib", ".o", ".a", ".lib", ".obj", ".exe", ".class", ".jar", ".war", ".ear", ".nupkg", ".egg-info", ".egg", ".whl", ".map",
    ".js.map", ".css.map", ".min.js", ".min.css", ".bundle.js", "package-lock.json", "yarn.lock", "pnpm-lock.yaml", "Pipfile.lock", "poetry.lock", "Gemfile.lock",
    "composer.lock", "Cargo.lock", "go.sum", "packages.lock.json", ".png", ".jpg", ".jpeg", ".gif", ".svg", ".ico", ".webp", ".mp3", ".mp4", ".woff", ".woff2", ".ttf",
    ".eot", ".zip", ".tar", ".gz", ".bz2", ".rar", ".7z", ".db", ".sqlite", ".sqlite3", ".DS_Store", "Thumbs.db", ".log",
]
FILE_NAMES = [
    "Makefile", "Dockerfile", "Jenkinsfile", "Gemfile", "Rakefile", "Vagrantfile", "Procfile", "Brewfile", ".gitignore", ".dockerignore", ".editorconfig",
]
SENSITIVE = (
    r"(?i)(^|/)\.(env|envrc)(\.|$)", r"(?i)\.(pem|key|p12|pfx|cert|crt|der|p8)$", r"(?i)(credential|secret|passwd|password|token|private_key)",
    r"(id_rsa|id_dsa|id_ecdsa|id_ed25519)(\.pub)?$", r"(?i)(\.netrc|\.pgpass|\.htpasswd)$", r"(?i)(aws_credentials|gcloud_credentials|service.account)",
)
LANGUAGES = {"py": "python", "pyi": "python", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "go": "go", "java": "java", "kt": "kotlin", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cpp": "cpp", "hpp": "cpp", "cc": "cpp", "cs": "csharp", "scala": "scala", "swift": "swift", "sh": "bash", "sql": "sql", "md": "markdown", "json": "json", "yml": "yaml", "yaml": "yaml", "tf": "terraform"}


def any_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """The extension in lower case with its dot, or the empty text; a name that begins with its only dot has none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.element_at(F.create_map(*pairs), F.substring(suffix(path), 2, 20))


def admitted(path: Column, size: Column, most: int = 1024 * 1024) -> Column:
    """Files to index: a known extension or name, no ignored part in the name, not too large."""
    name = base_name(path)
    return (suffix(path).isin(EXTENSIONS) | name.isin(FILE_NAMES)) & ~any_of([F.contains(name, F.lit(p)) for p in IGNORED_PARTS]) & (size <= most)


def admitted_dirs(path: Column) -> Column:
    """No directory of the path is ignored or, but for .github, hidden."""
    dirs = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return ~F.exists(dirs, lambda d: d.isin(IGNORED_DIRS) | (F.startswith(d, F.lit(".")) & (d != ".github")))


def sensitive(path: Column) -> Column:
    return any_of([base_name(path).rlike(p) | path.rlike(p) for p in SENSITIVE])


def glob_regex(glob: str) -> str:
    """The regular expression of a shell pattern, in which * also matches a slash."""
    out = ""
    for part in re.findall(r"\[!?[^\]]+\]|.", glob, re.S):
        out += ".*" if part == "*" else "." if part == "?" else "[^" + part[2:] if part.startswith("[!") else part if part.startswith("[") and len(part) > 1 else re.escape(part)
    return f"^{out}$"


def ignored(path: Column, patterns: Sequence[str]) -> Column:
    """A pattern matches the path, its name, one of its parts or one of its beginnings."""
    parts = F.split(path, "/")
    heads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    spots = F.array_distinct(F.concat(parts, heads))
    regexes = [glob_regex(p.strip("/")) for p in patterns if p.strip("/")]
    return F.exists(spots, lambda s: any_of([s.rlike(r) for r in regexes])) if regexes else F.lit(False)


def overlaps(low: int, high: int, start: str = "start_line", end: str = "end_line") -> Column:
    return (F.col(start) <= high) & (F.col(end) >= low)


def visible(owner: Column, user: str, admin: bool = False, public: Column | None = None) -> Column:
    """A row is seen by its owner, by all if it has none or is public, and by an admin in any case."""
    if admin:
        return F.lit(True)
    seen = owner.isNull() | (owner == user)
    return seen | public if public is not None else seen


def structure(
    symbols: DataFrame, suffixes: Sequence[str] = (), pattern: str | None = None, classes: Sequence[str] = (), functions: Sequence[str] = (), exclude: Sequence[str] = (), mode: str = "union"
) -> DataFrame:
    """repo_id and file_path of the files that structural filters select from symbols.

    union: files that meet any filter. documented: every filter that is given must be met, any value of
    it, and files whose path holds an excluded text are left out.
    """
    kind = F.lower("symbol_type")
    name = F.lower("symbol_name")
    conditions = []
    if suffixes:
        conditions.append(any_of([F.endswith("file_path", F.lit(s)) for s in suffixes]))
    if pattern:
        conditions.append(F.contains("file_path", F.lit(pattern)))
    if classes:
        conditions.append(kind.isin("class", "interface", "struct") & any_of([F.contains(name, F.lit(c.lower())) for c in classes]))
    if functions:
        conditions.append(kind.isin("function", "method") & any_of([F.contains(name, F.lit(c.lower())) for c in functions]))
    files = ["repo_id", "file_path"]
    if mode == "union":
        return symbols.where(any_of([F.coalesce(c, F.lit(False)) for c in conditions])).select(*files).distinct()
    met = symbols.groupBy(*files).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(f"met{i}") for i, c in enumerate(conditions)], F.lit(1).alias("one"))
    for i in range(len(conditions)):
        met = met.where(f"met{i}")
    return met.where(~any_of([F.contains("file_path", F.lit(e)) for e in exclude])).select(*files)


def grep(df: DataFrame, text: str, regex: str, limit: int | None = 500, order: Sequence[str] = ()) -> DataFrame:
    """The lines of a text column that match, with line_no from 1 and line; the first limit of them in the given order."""
    hits = df.where(F.col(text).rlike(regex)).select(*order, F.posexplode(F.split(text, "\n")).alias("pos", "line")).where(F.col("line").rlike(regex))
    out = hits.select(*order, (F.col("pos") + 1).alias("line_no"), "line")
    return out if limit is None else out.orderBy(*order, "line_no").limit(limit)
