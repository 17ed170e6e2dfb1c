"""The registered queries op1 to op13, each over its whole table, and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardframe.llm import binary, bpe, collocation, counts, decontaminate, html, jaccard, licenses, periodic, quality, simhash, urls, warc
from hazardframe.llm.common import keep, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return register


@query("op1_benchmark_leaks", decontaminate.oracle())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))


@query("op2_bpe_round_trip")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(load(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op3_main_text")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return html.extract(pages, html.learn(pages))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op5_warc_round_trip")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read(warc.write(load(spark, sf_dir, "pages")))
    small = keep(records.select("page_id", F.octet_length("payload").cast("long").alias("bytes"),
                                "payload_digest", "record_type", "refers_to"), "records")
    # A revisit has no payload of its own: its size is read from the response it refers to.
    full = small.filter("record_type = 'response' and page_id is not null").groupBy(F.col("page_id").alias("refers_to"), "payload_digest")
    sizes = keep(full.agg(F.max("bytes").alias("full")), "sizes")
    return small.join(sizes, ["refers_to", "payload_digest"], "left").select(
        "page_id", F.coalesce("bytes", "full").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


@query("op6_quality_ratio")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, load(spark, sf_dir, "labels")))


@query("op7_license_spans")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(load(spark, sf_dir, "documents"))


@query("op8_url_verdicts", urls.oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = load(spark, sf_dir, "pages")
    return urls.judge(pages, urls.edges(pages))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = binary.write(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return binary.read_documents(spark, manifest)


@query("op10_token_counts")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.token_counts(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op11_jaccard_join")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(load(spark, sf_dir, "documents"))


@query("op12_periodic_runs")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digests(load(spark, sf_dir, "documents"))


@query("op13_collocations")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocation.collocations(load(spark, sf_dir, "documents"))
