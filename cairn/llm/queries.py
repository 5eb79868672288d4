"""The registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import warc
from cairn.llm.chat import format_chats
from cairn.llm.decontaminate import contaminated
from cairn.llm.jobs import read
from cairn.llm.mixing import mix
from cairn.llm.neardup import NearDup, near_duplicates
from cairn.llm.outliers import outliers
from cairn.llm.ranked import search
from cairn.llm.repair import repaired
from cairn.llm.resample import resample
from cairn.llm.scoring import score
from cairn.llm.secrets import scan
from cairn.llm.urls import judge, rule_table
from cairn.llm.wrappers import main_texts


def op1_mixing_curriculum(spark: SparkSession, folder: str) -> DataFrame:
    found = mix(read(spark, folder, "documents"))
    return found.select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("positions", F.lit(1)).alias("first_position"))


def op2_robust_outliers(spark: SparkSession, folder: str) -> DataFrame:
    return outliers(read(spark, folder, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(read(spark, folder, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(read(spark, folder, "documents"), NearDup(words=4))


def op6_log_bilinear_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return score(read(spark, folder, "documents"))


def op7_snapshot_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return format_chats(read(spark, folder, "conversations"))


def op8_merkle_fixity(spark: SparkSession, folder: str) -> DataFrame:
    """The archive of all pages against a replica in which one byte of every 41st page's record has changed."""
    records = warc.archive(read(spark, folder, "pages"))
    worn = F.concat(F.expr("substring(payload, 1, octet_length(payload) - 7)"), F.lit(b"\x00"), F.expr("substring(payload, octet_length(payload) - 5)"))
    replica = records.withColumn("payload", F.when((F.col("page_id") % 41 == 5), worn).otherwise(F.col("payload")))
    return warc.audit(warc.leaves(records), warc.leaves(replica))


def op9_html_wrappers(spark: SparkSession, folder: str) -> DataFrame:
    return main_texts(read(spark, folder, "pages"))


def op10_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resample(read(spark, folder, "documents"), read(spark, folder, "labels"))


#: The rules of the query, as (host, path, verdict).
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_link_graph_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judge(read(spark, folder, "pages"), rule_table(spark, URL_RULES))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired(read(spark, folder, "conversations"))


def op13_pair_bound_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


QUERIES = {
    "op1_mixing_curriculum": op1_mixing_curriculum,
    "op2_robust_outliers": op2_robust_outliers,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_secret_scan": op4_secret_scan,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_log_bilinear_scoring": op6_log_bilinear_scoring,
    "op7_snapshot_collapse": op7_snapshot_collapse,
    "op8_merkle_fixity": op8_merkle_fixity,
    "op9_html_wrappers": op9_html_wrappers,
    "op10_importance_resampling": op10_importance_resampling,
    "op11_link_graph_filter": op11_link_graph_filter,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_pair_bound_maxscore": op13_pair_bound_maxscore,
}
