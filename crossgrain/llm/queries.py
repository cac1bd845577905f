"""One query per operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import lm_scoring, mixing, packing, pii, quality_crf, quality_rules, simhash, substrings, topk, url_filter
from .common import read_table, with_package_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with_package_path(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select(F.col("page_id").cast("long"), F.col("url").cast("string"))
    return pages.select("page_id", url_filter.judge(F.col("url")).alias("j")).select("page_id", "j.*")


def _like(glob: str) -> str:
    host, _, path = glob.partition("/")
    return f"('.' || host LIKE '.{host.replace('*', '%')}' AND path LIKE '/{path.replace('*', '%')}')"


def _op1_sql() -> str:
    fits, rank = [], []
    for verdict, name in url_filter.BASE_RULES:
        host, _, path = name.partition("/")
        fits.append(f"WHEN (host = '{host}' OR suffix(host, '.{host}')) AND prefix(path, '/{path}') THEN '{name}'")
        rank.append((-len(name), verdict, fits.pop()))
    longest = " ".join(x[2] for x in sorted(rank))
    verdicts = " ".join(f"WHEN rule = '{name}' THEN '{verdict}'" for verdict, name in url_filter.BASE_RULES)
    globs = " ".join(f"WHEN {_like(g)} THEN '{g}'" for g in sorted(url_filter.BLOCK_GLOBS, key=lambda g: (-len(g), "block")))
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
WITH cut AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS authority FROM cut),
parts AS (SELECT page_id, translate(authority, '{upper}', '{lower}') AS host, regexp_extract(substr(rest, length(authority) + 1), '^[^?#]*') AS path FROM split),
ruled AS (SELECT *, CASE {longest} END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE {verdicts} WHEN (CASE {globs} END) IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict,
  CASE WHEN rule IS NULL THEN CASE {globs} END END AS "glob" FROM ruled"""


ORACLE_SQL["op1_url_filter"] = _op1_sql()


@query
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, F.col("vec_id") % 100 == 0)


ORACLE_SQL["op2_top_k"] = """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) AS k, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings WHERE vec_id IS NOT NULL),
ok AS (SELECT vec_id FROM x GROUP BY vec_id HAVING count(*) = count(CASE WHEN isfinite(x) THEN 1 END)),
v AS (SELECT vec_id, k, CAST(floor(1024 * x) AS BIGINT) AS e FROM x JOIN ok USING (vec_id)),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.e * c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.k = c.k AND q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10"""


@query
def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicate(read_table(spark, sf_dir, "documents"), text=False)


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


@query
def op9_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_crf.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query
def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.calibrated(read_table(spark, sf_dir, "documents"))


@query
def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(read_table(spark, sf_dir, "documents"))


@query
def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(read_table(spark, sf_dir, "documents"))
