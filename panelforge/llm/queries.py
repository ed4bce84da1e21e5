"""Queries and oracle SQL of the operators of this package."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.leakage import find_leaks
from panelforge.llm.packing import pack_documents, packing_facts
from panelforge.llm.percentiles import group_percentiles
from panelforge.llm.quality import text_quality
from panelforge.sources.tables import table

#: Folder of the public vocabularies.
VOCABULARIES = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "mc_path")
    q = group_percentiles(paths, "run_id", "path", {"terminal": [0.5], "max_dd": [0.05]})
    capital = paths.where("run_id is not null").groupBy("run_id").agg(F.max("initial_capital").alias("limit"))
    weak = q.where("metric = 'terminal'").join(capital, "run_id").where("value < limit")
    deep = q.where("metric = 'max_dd' and value < -0.45")
    return weak.select("run_id", "metric").unionByName(deep.select("run_id", "metric"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    fractions = [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]
    q = group_percentiles(table(spark, d, "mc_path"), "run_id", "path", {"terminal": fractions, "max_dd": fractions})
    return q.select("run_id", "metric", "fraction", F.when(F.col("metric") == "terminal", F.round("value", 4)).otherwise(F.round("value", 8)).alias("value"), "n")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents")).where("oversize").select("doc_id").distinct()


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    return pack_documents(table(spark, d, "documents"), vocabulary=f"{VOCABULARIES}/byte_bpe_50k.json")


def p7_diverse(spark: SparkSession, d: str) -> DataFrame:
    """Containers with at most one document of a source."""
    return pack_documents(table(spark, d, "documents"), per_source=1)


def p7_facts(spark: SparkSession, d: str) -> DataFrame:
    return packing_facts(pack_documents(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return text_quality(table(spark, d, "documents"), table(spark, d, "common_words")).where("verdict = 'not_prose'").select("doc_id")


def p9_statistics(spark: SparkSession, d: str) -> DataFrame:
    stats = text_quality(table(spark, d, "documents"), table(spark, d, "common_words"))
    ratios = [F.round(c, 8).alias(c) for c in ("mean_word_length", "symbol_ratio", "punctuated_share", "common_share")]
    return stats.select("doc_id", F.col("n_words").cast("long").alias("n_words"), *ratios, F.col("n_lines").cast("long").alias("n_lines"))


QUERIES = {f.__name__: f for f in (p4_found, p4_percentiles, p7_found, p7_containers, p7_diverse, p7_facts, p8_found, p8_leaks, p9_found, p9_statistics)}

_PATHS = "(select distinct run_id, path, initial_capital, terminal, max_dd from mc_path where run_id is not null and path is not null)"

ORACLE = {
    "p4_found": f"""
with t as (select run_id, quantile_cont(terminal, 0.5) as q, max(initial_capital) as c from {_PATHS} where terminal is not null and not isnan(terminal) group by run_id),
d as (select run_id, quantile_cont(max_dd, 0.05::double) as q from {_PATHS} where max_dd is not null and not isnan(max_dd) group by run_id)
select run_id, 'terminal' as metric from t where q < c
union all select run_id, 'max_dd' as metric from d where q < -0.45""",
    "p4_percentiles": f"""
with v as (select run_id, 'terminal' as metric, path, terminal as x from {_PATHS} union all select run_id, 'max_dd', path, max_dd from {_PATHS}),
k as (select run_id, metric, path, x from v where x is not null and not isnan(x)),
f as (select unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as fraction),
q as (select run_id, metric, count(*) as n, quantile_cont(x, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) as qs from k group by run_id, metric)
select run_id, metric, fraction, case when metric = 'terminal' then round(value, 4) else round(value, 8) end as value, n
from (select run_id, metric, n, unnest(qs) as value, unnest([0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]::double[]) as fraction from q)""",
    "p7_found": r"select doc_id from documents where len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) > 1024",
    "p7_facts": r"""
with t as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')) as n from documents where doc_id is not null)
select count(*) as documents, cast(sum(n) as bigint) as tokens, cast(0 as bigint) as overfull, cast(0 as bigint) as split_needlessly, cast(0 as bigint) as wrong_used, true as tight from t""",
    "p9_statistics": r"""
with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line from documents),
v as (select doc_id, line, length(regexp_replace(line, '\s+', '', 'g')) as visible, regexp_extract_all(lower(line), '[\p{L}\p{N}]+') as words from l),
c as (select doc_id, visible, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
  len(list_filter(words, lambda w: list_contains(ws, w))) as n_common,
  cast(regexp_matches(line, '[.!?]["''»)]*\s*$') as int) as ends, cast(visible > 0 as int) as has from v, (select list(distinct lower(word)) as ws from common_words)),
s as (select doc_id, sum(n_words) as n_words, sum(word_chars) as word_chars, sum(n_common) as n_common, sum(visible) as visible, sum(ends) as ends, sum(has) as lines from c where visible > 0 group by doc_id)
select d.doc_id, coalesce(cast(s.n_words as bigint), 0) as n_words,
  round(s.word_chars / nullif(s.n_words, 0), 8) as mean_word_length, round((s.visible - s.word_chars) / s.visible, 8) as symbol_ratio,
  round(s.ends / s.lines, 8) as punctuated_share, round(s.n_common / nullif(s.n_words, 0), 8) as common_share, coalesce(cast(s.lines as bigint), 0) as n_lines
from (select distinct doc_id from documents) d left join s using (doc_id)""",
}
