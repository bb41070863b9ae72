"""Queries over source files: declarations, imports, calls, comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.operators import extraction, filters, symbols
from codeloom.storage import table


def _files(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "source_files").where("content is not null")
    return f.select("repo_id", "file_path", filters.language(F.col("file_path")).alias("language"), "content").distinct()


def q_declarations(spark: SparkSession, d: str) -> DataFrame:
    return symbols.declarations(_files(spark, d))


def q_imports(spark: SparkSession, d: str) -> DataFrame:
    return symbols.imports(_files(spark, d)).select("repo_id", "file_path", "module")


def q_call_sites(spark: SparkSession, d: str) -> DataFrame:
    c = symbols.call_sites(_files(spark, d))
    return c.groupBy("repo_id", "file_path", "caller", "callee").agg(F.count(F.lit(1)).alias("n"), F.min("line_no").alias("first_line"))


def q_rationale(spark: SparkSession, d: str) -> DataFrame:
    return symbols.rationale(_files(spark, d))


def q_visibility_of_symbols(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "symbols").where("symbol_name is not null").select("repo_id", "file_path", "symbol_name").distinct()
    return s.groupBy("repo_id", symbols.visibility(F.col("symbol_name"), filters.language(F.col("file_path"))).alias("visibility")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (q_declarations, q_imports, q_call_sites, q_rationale, q_visibility_of_symbols)}

_NAME = "regexp_extract(file_path, '[^/]*$')"
_EXT = f"lower(regexp_extract({_NAME}, '^.+(\\.[^.]*)$', 1))"
_LANG = f"case {_EXT} " + " ".join(f"when '.{e}' then '{x}'" for e, x in filters.LANGUAGES.items()) + " end"
_L = f"""f as (select distinct repo_id, file_path, {_LANG} as language, content from source_files where content is not null),
    l as (select repo_id, file_path, language, unnest(range(1, len(string_split_regex(content, '\\r?\\n')) + 1))::integer as line_no, unnest(string_split_regex(content, '\\r?\\n')) as line from f)"""


def _case(patterns: dict[str, str], group: int = 1) -> str:
    return "case language " + " ".join("when '{}' then regexp_extract(line, '{}', {})".format(k, p.replace("'", "''"), group) for k, p in patterns.items()) + " else '' end"


_SECOND = {k: p for k, p in symbols.IMPORTS.items() if k != "java"}
ORACLE = {
    "q_declarations": f"with {_L} select repo_id, file_path, n as symbol_name, t as symbol_type, line_no as start_line from (select *, 'class' as t, {_case(symbols.CLASSES)} as n from l union all select *, 'function', {_case(symbols.FUNCTIONS)} from l) where n <> ''",
    "q_imports": f"with {_L}, m as (select repo_id, file_path, coalesce(nullif({_case(symbols.IMPORTS)}, ''), nullif({_case(_SECOND, 2)}, '')) as module from l) select distinct repo_id, file_path, module from m where module is not null",
    "q_call_sites": f"""
        with {_L}, d as (select *, nullif({_case(symbols.FUNCTIONS)}, '') as declared from l), c as (select *, last_value(declared ignore nulls) over (partition by repo_id, file_path order by line_no rows unbounded preceding) as caller from d),
        x as (select repo_id, file_path, caller, unnest(regexp_extract_all(line, '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) as callee, line_no from c where declared is null and caller is not null)
        select repo_id, file_path, caller, callee, count(*) as n, min(line_no) as first_line from x
        where callee not in ('if', 'for', 'while', 'switch', 'catch', 'return', 'func', 'function', 'def', 'class', 'and', 'or', 'not', 'in', 'with', 'assert') and callee <> caller group by 1, 2, 3, 4""",
    "q_rationale": f"with {_L} select repo_id, file_path, line_no, regexp_extract(line, '{symbols.RATIONALE}', 1) as kind, left(regexp_extract(line, '{symbols.RATIONALE}', 2), 80) as label from l where regexp_matches(line, '{symbols.RATIONALE}')",
    "q_visibility_of_symbols": f"""
        with s as (select distinct repo_id, file_path, symbol_name from symbols where symbol_name is not null)
        select repo_id, case when {_LANG} = 'go' then case when regexp_matches(symbol_name, '^[A-Z]') then 'public' else 'private' end when symbol_name like '\\_\\_%' escape '\\' and symbol_name not like '%\\_\\_' escape '\\' then 'private'
            when symbol_name like '\\_%' escape '\\' then 'protected' else 'public' end as visibility, count(*) as n from s group by 1, 2""",
}


def _latest_files(spark: SparkSession, d: str) -> DataFrame:
    """Each file once, as it was scanned last."""
    f = table(spark, d, "source_files").where("content is not null")
    return f.groupBy("repo_id", "file_path").agg(F.max_by("content", F.struct("scanned_at", "content_hash")).alias("content"))


def q_extracted(spark: SparkSession, d: str) -> DataFrame:
    s = extraction.symbols(_latest_files(spark, d))
    return s.groupBy("language", "symbol_type").agg(F.count(F.lit(1)).alias("n"), F.count("parent_name").alias("n_inner"), F.sum(F.size("parameters")).alias("n_parameters"), F.sum(F.col("end_line") - F.col("start_line") + 1).alias("n_lines"))


def q_extracted_known(spark: SparkSession, d: str) -> DataFrame:
    """Of the symbols that the table of symbols has for a file: how many are extracted from it, by language of the file."""
    s = extraction.symbols(_latest_files(spark, d)).select("repo_id", "file_path", "symbol_name", F.lit(1).alias("found")).distinct()
    k = table(spark, d, "symbols").where("symbol_name is not null").select("repo_id", "file_path", F.element_at(F.split("symbol_name", r"\."), -1).alias("symbol_name")).distinct()
    ending = F.lower(F.regexp_extract("file_path", r"\.([A-Za-z]+)$", 1))
    return k.join(s, ["repo_id", "file_path", "symbol_name"], "left").groupBy(ending.alias("extension")).agg(F.count(F.lit(1)).alias("n_known"), F.count("found").alias("n_found"))


def q_imported(spark: SparkSession, d: str) -> DataFrame:
    return extraction.imports(_latest_files(spark, d)).groupBy("language", "module").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("repo_id", "file_path").alias("n_files"))


def q_called(spark: SparkSession, d: str) -> DataFrame:
    """Calls of functions by their names: how many, and from how many functions."""
    c = extraction.calls(_latest_files(spark, d))
    return c.groupBy("repo_id", "callee").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("file_path", "caller").alias("n_callers"))


def q_inherits(spark: SparkSession, d: str) -> DataFrame:
    return extraction.inheritance(extraction.symbols(_latest_files(spark, d)))


def q_uses(spark: SparkSession, d: str) -> DataFrame:
    f = _latest_files(spark, d)
    return extraction.uses(extraction.symbols(f), extraction.imports(f))


QUERIES |= {f.__name__: f for f in (q_extracted, q_extracted_known, q_imported, q_called, q_inherits, q_uses)}

# every symbol that is known is extracted
ORACLE |= {
    "q_extracted_known": r"""select regexp_extract(lower(file_path), '\.([a-z]+)$', 1) as extension, count(*) as n_known, count(*) as n_found
        from (select distinct repo_id, file_path, string_split(symbol_name, '.')[-1] as symbol_name from symbols where symbol_name is not null) group by 1"""
}
