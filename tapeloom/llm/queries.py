"""The registered queries of the thirteen operators; each reads its whole tables and returns all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import classifier, decontamination, fill_in_middle, importance, jaccard, licenses, packing, pii, quality_rules, sharding, substrings, url_filters, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES = {
    "op1_best_fit_packing": lambda spark, d: packing.pack_documents(table(spark, d, "documents")),
    "op2_quality_rules": lambda spark, d: quality_rules.quality_measures(table(spark, d, "documents")),
    "op3_ngram_jaccard": lambda spark, d: jaccard.jaccard_components(table(spark, d, "documents")),
    "op4_url_filters": lambda spark, d: url_filters.judge_captures(url_filters.demo_captures(table(spark, d, "pages")), url_filters.demo_events(table(spark, d, "pages"))),
    "op5_license_scan": lambda spark, d: licenses.scan_licenses(licenses.demo_files(table(spark, d, "documents"))).withColumnRenamed("file_id", "doc_id"),
    "op6_decontamination": lambda spark, d: decontamination.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op7_sharding": lambda spark, d: sharding.assign_shards(table(spark, d, "documents")),
    "op8_warc": lambda spark, d: warc.page_records(table(spark, d, "pages")),
    "op9_pii": lambda spark, d: pii.span_digest(table(spark, d, "documents")),
    "op10_quality_classifier": lambda spark, d: classifier.score(table(spark, d, "documents"), classifier.train(table(spark, d, "documents"), table(spark, d, "labels"))),
    "op11_importance_resampling": lambda spark, d: importance.resample(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op12_fill_in_middle": lambda spark, d: fill_in_middle.digest(table(spark, d, "documents")),
    "op13_substring_dedup": lambda spark, d: substrings.digest(table(spark, d, "documents")),
}

ORACLES = {
    "op3_ngram_jaccard": None,  # recursive closure over all pairs: too slow in SQL on whole tables; brute force in tests
    "op4_url_filters": url_filters.ORACLE,
    "op8_warc": """
        with p as (select page_id, coalesce(html, '') as t from pages),
        q as (select page_id, cast(strlen(t) as bigint) as payload_bytes, sha256(t) as payload_digest from p),
        r as (select *, min(page_id) over (partition by payload_digest) as first from q)
        select page_id, payload_bytes, payload_digest,
            case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
            case when payload_bytes >= 100 and page_id <> first then first end as refers_to
        from r""",
    "op9_pii": pii.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
