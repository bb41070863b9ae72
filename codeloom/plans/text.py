"""Queries over texts, files and symbols."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions import text as T
from codeloom.operators import chunking, filters, metadata
from codeloom.storage import spread, table

TERMS = [["token", "budget"], ["read", "fewer", "blocks"]]


def q_char_windows(spark: SparkSession, d: str) -> DataFrame:
    w = chunking.windows(table(spark, d, "documents").select("doc_id", "text"), "text")
    return w.select("doc_id", "chunk_no", "chunk_hash", F.length("chunk_text").alias("n_chars"))


def q_tiny_chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "code_chunks").where("chunk_text is not null")
    return c.groupBy("repo_id").agg(F.count_if(F.length(T.trim_all(F.col("chunk_text"))) < 50).alias("n_tiny"), F.count(F.lit(1)).alias("n"))


def q_identities(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose stored hash or id is not what their text and repository give."""
    c = table(spark, d, "code_chunks").where("chunk_text is not null")
    out = c.select("row_id", "chunk_hash", "chunk_id", T.short_hash(F.col("chunk_text")).alias("hash"), T.chunk_id(F.col("repo_id"), F.col("chunk_text")).alias("id"))
    return out.groupBy((F.col("hash") == F.col("chunk_hash")).alias("hash_fits"), (F.col("id") == F.col("chunk_id")).alias("id_fits")).agg(F.count(F.lit(1)).alias("n"))


def q_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy("source").agg(F.sum(T.tokens(F.col("text"))).alias("n_tokens"), F.sum(F.greatest(F.lit(1), T.tokens(F.col("text")))).alias("n_at_least"))


def q_lang_counts(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents")
    return t.groupBy(F.lower("lang").alias("lang"), "doc_kind").agg(F.count(F.lit(1)).alias("n"), F.sum(T.word_count(F.col("text"))).alias("n_words"))


def q_corpus_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Size of each repository's files, and whether it is small, fit or large for a graph: 50,000 and 500,000 words, 200 files."""
    one = table(spark, d, "source_files").groupBy("repo_id", "file_path").agg(F.max(T.word_count(F.col("content"))).alias("w"))
    s = one.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_files"), F.sum("w").alias("n_words"))
    return s.withColumn("verdict", F.when((F.col("n_words") >= 500_000) | (F.col("n_files") >= 200), "large").when(F.col("n_words") < 50_000, "small").otherwise("fit"))


def q_budget_pack(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("n_chars > 0")
    return chunking.within_budget(t, ["source"], [F.desc("n_chars"), "doc_id"], "n_chars", 60_000).select("doc_id", "source", "running", "taken")


def q_fixed_batches(spark: SparkSession, d: str) -> DataFrame:
    b = chunking.batches_of(table(spark, d, "documents"), ["source"], ["doc_id"], 32)
    return b.groupBy("source", "batch_no").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


def q_token_batches(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("source", "doc_id", T.tokens(F.col("text")).alias("n_tokens"))
    return chunking.token_batches(t, "source", "doc_id", "n_tokens")


def q_line_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.line_chunks(table(spark, d, "source_files"), ["repo_id", "file_path"], "content")


def q_char_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.char_chunks(table(spark, d, "source_files"), ["repo_id", "file_path"], "content")


def q_paper_signs(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null").select("doc_id", T.paper_signs(F.col("text")).alias("n_signs"))
    return t.withColumn("is_paper", F.col("n_signs") >= 3)


def q_redact(spark: SparkSession, d: str) -> DataFrame:
    t = spread(table(spark, d, "documents").where("text is not null").select("doc_id", "text"))
    return T.redacted(t, "text", bounded=False).select("doc_id", F.sha2("text", 256).alias("digest"))


def q_redact_chunks(spark: SparkSession, d: str) -> DataFrame:
    """How many tags of each kind the redaction of all chunks leaves."""
    t = spread(table(spark, d, "code_chunks").where("chunk_text is not null").select("chunk_text"))
    c = T.redacted(t, "chunk_text", bounded=False).select(F.explode(F.regexp_extract_all("chunk_text", F.lit(r"<([A-Z0-9_]{3,})>"), 1)).alias("tag"))
    return c.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def q_grep(spark: SparkSession, d: str) -> DataFrame:
    return filters.grep(table(spark, d, "code_chunks"), "chunk_text", "TODO|FIXME|XXX", None, ["row_id"])


def q_urls(spark: SparkSession, d: str) -> DataFrame:
    u = table(spark, d, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"(https?://[A-Za-z0-9./_?=&%#-]+)"), 1)).alias("url"))
    return u.select("doc_id", "url", T.url_type(F.col("url")).alias("kind"), T.file_name(F.col("url")).alias("file_name"))


def q_exact_copies(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy(F.sha2("text", 256).alias("digest")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


def q_admission(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("repo_id", "file_path", "size_bytes").distinct()
    p = F.col("file_path")
    return f.groupBy("repo_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(filters.admitted(p, F.col("size_bytes")) & filters.admitted_dirs(p)).alias("n_admitted"), F.count_if(filters.sensitive(p)).alias("n_sensitive"), F.count_if(filters.ignored(p, ["tests", "*.json", "units/*"])).alias("n_ignored")
    )


def q_languages(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").select("repo_id", "file_path").distinct()
    return f.groupBy(filters.language(F.col("file_path")).alias("language"), filters.suffix(F.col("file_path")).alias("extension")).agg(F.count(F.lit(1)).alias("n"))


def q_structure(spark: SparkSession, d: str) -> DataFrame:
    return filters.structure(table(spark, d, "symbols"), suffixes=(".py", ".go"), functions=("load", "store"), exclude=("tests/",), mode="documented")


def q_structure_union(spark: SparkSession, d: str) -> DataFrame:
    return filters.structure(table(spark, d, "symbols"), suffixes=(".ts",), classes=("broker",), functions=("load",), pattern="api/")


def q_outline(spark: SparkSession, d: str) -> DataFrame:
    return chunking.outline(table(spark, d, "symbols"))


def q_uncovered(spark: SparkSession, d: str) -> DataFrame:
    """Ranges of lines of each file that no known symbol covers."""
    files = table(spark, d, "source_files").select("repo_id", "file_path", "content").distinct()
    spans = table(spark, d, "symbols").where("start_line >= 1").select("repo_id", "file_path", "start_line", "end_line").distinct()
    return chunking.gaps(files, "content", spans, ["repo_id", "file_path"]).select("repo_id", "file_path", "start_line", "end_line")


def q_keyword_score(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", F.round(metadata.keyword_score(TERMS, F.col("text")), 6).alias("score"))
    return t.where("score is not null")


def q_symbol_search(spark: SparkSession, d: str) -> DataFrame:
    """Symbols whose name holds a text, in any case, with their lines."""
    return table(spark, d, "symbols").where(F.contains(F.lower("symbol_name"), F.lit("token")) & filters.overlaps(1, 100)).select("symbol_id", "file_path", "symbol_name", "start_line").distinct()


def q_joined_files(spark: SparkSession, d: str) -> DataFrame:
    return chunking.joined(table(spark, d, "code_chunks")).select("repo_id", "file_path", F.sha2("text", 256).alias("digest"))


QUERIES = {
    f.__name__: f
    for f in (
        q_char_windows, q_tiny_chunks, q_identities, q_token_estimate, q_lang_counts, q_corpus_verdict, q_budget_pack, q_fixed_batches, q_token_batches, q_line_chunks, q_char_chunks, q_paper_signs, q_redact,
        q_redact_chunks, q_grep, q_urls, q_exact_copies, q_admission, q_languages, q_structure, q_structure_union, q_outline, q_uncovered, q_keyword_score, q_symbol_search, q_joined_files,
    )
}


def _sql_redact(column: str) -> str:
    """The chain of redaction as nested calls; the other engine's word boundaries are those of ASCII text, and its groups are written \\1."""
    q = lambda p: "'" + p.replace("(?<key>", "(").replace("'", "''") + "'"
    out = f"regexp_replace({column}, {q(T.CONNECTION)}, '\\1<CONNECTION_PASSWORD>\\3', 'g')"
    for tag, pattern in T.TAGGED:
        out = f"regexp_replace({out}, {q(pattern)}, '<{tag}>', 'g')"
    out = f"regexp_replace({out}, {q(T.API_KEYS)}, '\\1<API_KEY>\\4', 'g')"
    return f"regexp_replace(regexp_replace({out}, {q(T.BEARER)}, '\\1<BEARER_TOKEN>', 'g'), {q(T.BASIC)}, '\\1<BASIC_AUTH>', 'g')"


def _sql_in(values: list[str]) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


_WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
_NAME = "regexp_extract(file_path, '[^/]*$')"
_EXT = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]*)$', 1))"
_PAPER = " + ".join(f"regexp_matches(left(text, 3000), '(?i){p}')::int" for p in T.PAPER)
_SENSITIVE = " or ".join(f"regexp_matches({_NAME}, '{p}') or regexp_matches(file_path, '{p}')" for p in filters.SENSITIVE)
_DIRS = "string_split(regexp_replace(file_path, '/?[^/]*$', ''), '/')"
_IGNORED = [filters.glob_regex(p) for p in ("tests", "*.json", "units/*")]
_SPOTS = "list_concat(string_split(file_path, '/'), list_transform(range(1, len(string_split(file_path, '/')) + 1), lambda i: array_to_string(string_split(file_path, '/')[1:i], '/')))"
_LANG = "case {0} " + " ".join(f"when '.{e}' then '{x}'" for e, x in filters.LANGUAGES.items()) + " end"
# Fixed values, stated again so that the SQL does not follow the operators.
_SQL_EXTENSIONS = (
    "('.py', '.pyi', '.js', '.jsx', '.ts', '.tsx', '.mjs', '.cjs', '.vue', '.svelte', '.go', '.rs', '.java', '.kt', '.kts', '.scala', '.groovy', '.gradle', '.c', "
    "'.cpp', '.cc', '.cxx', '.h', '.hpp', '.hxx', '.cs', '.csx', '.fs', '.fsx', '.vb', '.vbs', '.rb', '.php', '.swift', '.m', '.mm', '.dart', '.ex', '.exs', '.erl', "
    "'.hs', '.lua', '.pl', '.pm', '.r', '.R', '.zig', '.v', '.clj', '.cljs', '.nim', '.cr', '.jl', '.ml', '.mli', '.html', '.htm', '.jsp', '.jspx', '.aspx', "
    "'.cshtml', '.razor', '.css', '.scss', '.sass', '.less', '.graphql', '.gql', '.sql', '.proto', '.md', '.rst', '.txt', '.yaml', '.yml', '.json', '.toml', '.xml', "
    "'.ini', '.cfg', '.env', '.properties', '.sh', '.bash', '.zsh', '.ps1', '.bat', '.cmd', '.tf', '.hcl', '.dockerfile')"
)
_SQL_FILE_NAMES = (
    "('Makefile', 'Dockerfile', 'Jenkinsfile', 'Gemfile', 'Rakefile', 'Vagrantfile', 'Procfile', 'Brewfile', '.gitignore', '.dockerignore', '.editorconfig')"
)
_SQL_DIRS = (
    "('.git', '.svn', '.hg', '.bzr', '__pycache__', '.venv', 'venv', 'env', '.env', '.eggs', '.tox', '.nox', '.pytest_cache', '.mypy_cache', '.ruff_cache', "
    "'.pytype', 'site-packages', 'node_modules', '.next', '.nuxt', '.output', '.turbo', 'bower_components', '.parcel-cache', '.cache', 'target', '.gradle', '.mvn', "
    "'bin', 'obj', 'packages', '.vs', 'vendor', 'build', 'dist', 'out', 'output', '_build', 'cmake-build-debug', 'cmake-build-release', '.idea', '.vscode', "
    "'.eclipse', '.settings', '.project', 'coverage', 'htmlcov', '.nyc_output', '_site', 'site', '.docusaurus', '.terraform', '.serverless', 'generated', "
    "'auto-generated', '.generated', 'migrations', '__snapshots__', '__mocks__', '__fixtures__')"
)
_SQL_PARTS = (
    r"\.pyc|\.pyo|\.pyd|\.so|\.dll|\.dylib|\.o|\.a|\.lib|\.obj|\.exe|\.class|\.jar|\.war|\.ear|\.nupkg|\.egg-info|\.egg|\.whl|\.map|\.js\.map|\.css\.map|\.min\.js|"
    r"\.min\.css|\.bundle\.js|package-lock\.json|yarn\.lock|pnpm-lock\.yaml|Pipfile\.lock|poetry\.lock|Gemfile\.lock|composer\.lock|Cargo\.lock|go\.sum|"
    r"packages\.lock\.json|\.png|\.jpg|\.jpeg|\.gif|\.svg|\.ico|\.webp|\.mp3|\.mp4|\.woff|\.woff2|\.ttf|\.eot|\.zip|\.tar|\.gz|\.bz2|\.rar|\.7z|\.db|\.sqlite|"
    r"\.sqlite3|\.DS_Store|Thumbs\.db|\.log"
)
_SHARES = "greatest(" + ", ".join("(" + " + ".join(f"contains(lower(text), '{w}')::int" for w in q) + f") / {len(q)}.0" for q in TERMS) + ")"
ORACLE = {
    "q_char_windows": "with w as (select doc_id, text, unnest(range(0, length(text), 800)) as p from documents where length(text) > 0) select doc_id, (p // 800)::integer as chunk_no, left(sha256(substring(text, p + 1, 1000)), 16) as chunk_hash, length(substring(text, p + 1, 1000))::integer as n_chars from w",
    "q_tiny_chunks": r"select repo_id, count(*) filter (length(regexp_replace(chunk_text, '^\s+|\s+$', '', 'g')) < 50) as n_tiny, count(*) as n from code_chunks where chunk_text is not null group by 1",
    "q_identities": "select left(sha256(chunk_text), 16) = chunk_hash as hash_fits, repo_id || '_' || left(sha256(chunk_text), 16) = chunk_id as id_fits, count(*) as n from code_chunks where chunk_text is not null group by 1, 2",
    "q_token_estimate": "select source, sum(length(text) // 4)::bigint as n_tokens, sum(greatest(1, length(text) // 4))::bigint as n_at_least from documents where text is not null group by 1",
    "q_lang_counts": f"select lower(lang) as lang, doc_kind, count(*) as n, sum(coalesce({_WORDS.format('text')}, 0))::bigint as n_words from documents group by 1, 2",
    "q_corpus_verdict": f"""
        with o as (select repo_id, file_path, max(coalesce({_WORDS.format('content')}, 0)) as w from source_files group by 1, 2), s as (select repo_id, count(*) as n_files, sum(w)::bigint as n_words from o group by 1)
        select *, case when n_words >= 500000 or n_files >= 200 then 'large' when n_words < 50000 then 'small' else 'fit' end as verdict from s""",
    "q_budget_pack": """
        with r as (select doc_id, source, n_chars, sum(n_chars) over (partition by source order by n_chars desc, doc_id rows unbounded preceding)::bigint as running from documents where n_chars > 0),
        t as (select *, case when running <= 60000 then n_chars when running - n_chars <= 60000 and 60000 - (running - n_chars) > 100 then 60000 - (running - n_chars) end as taken from r)
        select doc_id, source, running, taken from t where taken is not null""",
    "q_fixed_batches": "with b as (select source, n_chars, (row_number() over (partition by source order by doc_id) - 1) // 32 as batch_no from documents) select source, batch_no, count(*) as n, sum(n_chars)::bigint as n_chars from b group by 1, 2",
    "q_paper_signs": f"select doc_id, ({_PAPER})::integer as n_signs, ({_PAPER}) >= 3 as is_paper from documents where text is not null",
    "q_redact": f"select doc_id, sha256({_sql_redact('text')}) as digest from documents where text is not null",
    "q_redact_chunks": f"with t as (select unnest(regexp_extract_all({_sql_redact('chunk_text')}, '<([A-Z0-9_]{{3,}})>', 1)) as tag from code_chunks where chunk_text is not null) select tag, count(*) as n from t group by 1",
    "q_grep": "with l as (select row_id, unnest(range(1, len(string_split(chunk_text, chr(10))) + 1)) as line_no, unnest(string_split(chunk_text, chr(10))) as line from code_chunks where regexp_matches(chunk_text, 'TODO|FIXME|XXX')) select row_id, line_no::integer as line_no, line from l where regexp_matches(line, 'TODO|FIXME|XXX')",
    "q_urls": r"""
        with u as (select doc_id, unnest(regexp_extract_all(text, '(https?://[A-Za-z0-9./_?=&%#-]+)', 1)) as url from documents), b as (select *, regexp_replace(lower(url), '[?#].*$', '') as bare from u)
        select doc_id, url, case when regexp_matches(lower(url), 'twitter\.com|x\.com') then 'tweet' when regexp_matches(lower(url), 'arxiv\.org') then 'arxiv' when regexp_matches(lower(url), 'github\.com') then 'github'
            when regexp_matches(lower(url), 'youtube\.com|youtu\.be') then 'youtube' when bare like '%.pdf' then 'pdf' when regexp_matches(bare, '\.(png|jpg|jpeg|webp|gif)$') then 'image' else 'webpage' end as kind,
            left(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://', ''), '[?#].*$', ''), '[^A-Za-z0-9_-]', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g'), 80) as file_name from b""",
    "q_exact_copies": "select sha256(text) as digest, count(*) as n, min(doc_id) as first_id from documents where text is not null group by 1 having count(*) > 1",
    "q_admission": f"""
        with f as (select distinct repo_id, file_path, size_bytes from source_files)
        select repo_id, count(*) as n,
            count(*) filter (({_EXT} in {_SQL_EXTENSIONS} or {_NAME} in {_SQL_FILE_NAMES}) and not regexp_matches({_NAME}, '{_SQL_PARTS}') and size_bytes <= 1048576
                and len(list_filter({_DIRS}, lambda x: x in {_SQL_DIRS} or (x like '.%' and x <> '.github'))) = 0) as n_admitted,
            count(*) filter ({_SENSITIVE}) as n_sensitive,
            count(*) filter (len(list_filter({_SPOTS}, lambda x: {' or '.join(f"regexp_full_match(x, '{p}')" for p in _IGNORED)})) > 0) as n_ignored
        from f group by 1""",
    "q_languages": f"select {_LANG.format(_EXT)} as language, {_EXT} as extension, count(*) as n from (select distinct repo_id, file_path from source_files) group by 1, 2",
    "q_structure": """
        select repo_id, file_path from symbols where not contains(file_path, 'tests/') group by 1, 2
        having bool_or(file_path like '%.py' or file_path like '%.go') and bool_or(coalesce(lower(symbol_type) in ('function', 'method') and (contains(lower(symbol_name), 'load') or contains(lower(symbol_name), 'store')), false))""",
    "q_structure_union": """
        select distinct repo_id, file_path from symbols where file_path like '%.ts' or contains(file_path, 'api/') or (lower(symbol_type) in ('class', 'interface', 'struct') and contains(lower(symbol_name), 'broker'))
        or (lower(symbol_type) in ('function', 'method') and contains(lower(symbol_name), 'load'))""",
    "q_outline": """
        with s as (select distinct repo_id, file_path, start_line, coalesce(symbol_type, 'symbol') as k, symbol_name from symbols where symbol_name is not null)
        select repo_id, file_path, string_agg('L' || start_line || ' ' || k || ' ' || symbol_name, chr(10) order by start_line, symbol_name, k) as outline from s group by 1, 2""",
    "q_uncovered": """
        with f as (select distinct repo_id, file_path, content from source_files), l as (select repo_id, file_path, unnest(range(1, len(string_split(content, chr(10))) + 1)) as line_no from f),
        s as (select distinct repo_id, file_path, start_line, end_line from symbols where start_line >= 1),
        c as (select distinct l.repo_id, l.file_path, l.line_no from l join s on l.repo_id = s.repo_id and l.file_path = s.file_path and l.line_no between s.start_line and s.end_line),
        u as (select *, line_no - row_number() over (partition by repo_id, file_path order by line_no) as g from (select * from l except select * from c))
        select repo_id, file_path, min(line_no)::integer as start_line, max(line_no)::integer as end_line from u group by repo_id, file_path, g""",
    "q_joined_files": "with c as (select distinct repo_id, file_path, start_line, end_line, chunk_text from code_chunks where chunk_text is not null) select repo_id, file_path, sha256(string_agg(chunk_text, chr(10) order by start_line, end_line, chunk_text)) as digest from c group by 1, 2",
    "q_keyword_score": f"select doc_id, round(0.5 * {_SHARES}, 6) as score from documents where text is not null and 0.5 * {_SHARES} >= 0.1",
    "q_symbol_search": "select distinct symbol_id, file_path, symbol_name, start_line from symbols where contains(lower(symbol_name), 'token') and start_line <= 100 and end_line >= 1",
}
