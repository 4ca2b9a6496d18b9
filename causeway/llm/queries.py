"""The queries p8 to p10 over documents, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm import encode, mixing, spans
from causeway.tables import load


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(load(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p9_mixture(spark, d), load(spark, d, "mix_targets"))


def p9_marginals(spark: SparkSession, d: str) -> DataFrame:
    return mixing.marginals(load(spark, d, "documents"), load(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_chars(spans.passages(load(spark, d, "documents"))).withColumnRenamed("doc", "doc_id")


def p10_passages(spark: SparkSession, d: str) -> DataFrame:
    return spans.passages(load(spark, d, "documents")).select(
        F.col("doc").alias("doc_id"), F.col("partner").alias("other_doc_id"), "chain", "a_start", "a_end", "b_start", "b_end", "edits", "identity", F.size("blocks").alias("verbatim_blocks")
    )


def p10_members(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_members(load(spark, d, "documents")).withColumnRenamed("doc", "doc_id")


def queries() -> dict:
    return {"p8_ids": p8_ids, "p9_mixture": p9_mixture, "p9_shares": p9_shares, "p9_marginals": p9_marginals, "p10_found": p10_found, "p10_members": p10_members, "p10_passages": p10_passages}


P10_FOUND = """
with w as (select doc_id, i, substr(text, i, 160) s from (select doc_id, text, unnest(range(1, length(text) - 158)) i from documents where length(text) >= 160)),
shared as (select s from w group by s having count(distinct doc_id) > 1),
hit as (select doc_id, i, lead(i) over (partition by doc_id order by i) - i step from w semi join shared using (s))
select doc_id, cast(sum(least(160, coalesce(step, 160))) as bigint) shared_chars from hit group by doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"p10_found": P10_FOUND}
