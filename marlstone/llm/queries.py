"""The queries of the operators for training data; each is run over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.encoding import TOKENIZERS, encode_corpus
from marlstone.llm.garbled import find_garbled
from marlstone.llm.group_split import Related, targets_of
from marlstone.llm.mixing import Mix, budgets_of
from marlstone.llm.ngram_hits import contained_classes
from marlstone.llm.overlap import Overlap
from marlstone.llm.packing import oversize, pack_corpus, utilisation
from marlstone.llm.quota_sample import QuotaSample
from marlstone.llm.stable_sample import bucket_list, first_seen, shortfall, stable_sample
from marlstone.plans.lineage import cut
from marlstone.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
VOCABULARY = f"{TOKENIZERS}/byte_bpe_50k.json"


def _plans(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "rlcd_72k").select("plan_id", "seed", F.col("total_root_questions").alias("size"))


def p1_stable_sample(s: SparkSession, d: str) -> DataFrame:
    return stable_sample(table(s, d, "example"), _plans(s, d))


def p1_bucket_list(s: SparkSession, d: str) -> DataFrame:
    return bucket_list(first_seen(table(s, d, "example"), "sample_id", "ingest_batch"), _plans(s, d))


def p1_report(s: SparkSession, d: str) -> DataFrame:
    return shortfall(cut(first_seen(table(s, d, "example"), "sample_id", "ingest_batch")), _plans(s, d))


def _quota(s: SparkSession, d: str) -> QuotaSample:
    return QuotaSample(table(s, d, "example"), table(s, d, "sft_117k"))


def p2_found(s: SparkSession, d: str) -> DataFrame:
    return _quota(s, d).report.where("quota > available and task_type is not null").select("mixture_id", "source", "task_type")


def p2_report(s: SparkSession, d: str) -> DataFrame:
    return _quota(s, d).report


def p2_sample(s: SparkSession, d: str) -> DataFrame:
    return _quota(s, d).drawn


def _mix(s: SparkSession, d: str) -> Mix:
    return Mix(table(s, d, "example"), budgets_of(table(s, d, "public_extension_pilot")))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    return _mix(s, d).report.where("short").select("mixture_id", "source")


def p3_report(s: SparkSession, d: str) -> DataFrame:
    return _mix(s, d).report


def p3_mix(s: SparkSession, d: str) -> DataFrame:
    return _mix(s, d).records


def _overlap(s: SparkSession, d: str) -> Overlap:
    return Overlap(table(s, d, "example"), search=contained_classes)


def p4_found(s: SparkSession, d: str) -> DataFrame:
    return _overlap(s, d).pairs()


def p4_report(s: SparkSession, d: str) -> DataFrame:
    return _overlap(s, d).report()


def p5_found(s: SparkSession, d: str) -> DataFrame:
    return Related(table(s, d, "example")).split_groups()


def _assigned(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return Related(table(s, d, "example")).assign(targets_of(table(s, d, "rlcd_72k")))


def p5_assign(s: SparkSession, d: str) -> DataFrame:
    return _assigned(s, d)[0].withColumnRenamed("key", "sample_id")


def p5_report(s: SparkSession, d: str) -> DataFrame:
    return _assigned(s, d)[1]


def p6_ids(s: SparkSession, d: str) -> DataFrame:
    return encode_corpus(table(s, d, "documents"), VOCABULARY)


def _packed(s: SparkSession, d: str) -> DataFrame:
    sizes = cut(encode_corpus(table(s, d, "documents"), VOCABULARY, counts_only=True))
    return pack_corpus(sizes, table(s, d, "context_budget"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    return oversize(_packed(s, d))


def p7_packing(s: SparkSession, d: str) -> DataFrame:
    return _packed(s, d)


def p7_utilisation(s: SparkSession, d: str) -> DataFrame:
    return utilisation(_packed(s, d), table(s, d, "context_budget"))


def p8_found(s: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(s, d, "documents")).select("doc_id").distinct()


def p8_restored(s: SparkSession, d: str) -> DataFrame:
    return find_garbled(table(s, d, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p1_stable_sample, p1_bucket_list, p1_report, p2_found, p2_report, p2_sample, p3_found, p3_report, p3_mix, p4_found, p4_report, p5_found, p5_assign, p5_report, p6_ids, p7_found, p7_packing, p7_utilisation, p8_found, p8_restored)
}
