"""The queries of this subpackage: one per operator over its whole table, and the pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seclog.llm.mixing import ORACLE as MIXING


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf, "documents"), k=3, percent=85)


def op2_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.packing import pack

    return pack(table(spark, sf, "documents"))


def op3_kmeans_tree_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.neighbours import nearest

    return nearest(table(spark, sf, "embeddings"))


def op4_repeated_passages(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.repeats import report

    return report(table(spark, sf, "documents"))


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.toxicity import score

    return score(table(spark, sf, "documents"), table(spark, sf, "labels")).drop("passages")


def op6_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.secrets import report

    return report(table(spark, sf, "documents"))


def op7_bounded_ring_sharding(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.sharding import shard

    return (shard(table(spark, sf, "documents"), shards=24)
            .withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")}))


def op8_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.contamination import report

    found = report(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    named = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(named, "UTF-8"), 256).alias("items_sha256"), "contaminated")


def op9_html_main_text(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.pages import extract

    return extract(table(spark, sf, "pages"))


def op10_range_coded_ids(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm import idfile
    from seclog.llm.store import Scratch

    path = Scratch(spark, "idfile").path("ids")
    idfile.write(table(spark, sf, "documents"), path)
    return idfile.digest(spark, path)


def op11_pareto_mixing(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.mixing import report

    return report(table(spark, sf, "documents"))


def op12_qdwh_whitening(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.whitening import report

    return report(table(spark, sf, "embeddings"), components=4)


def op13_token_alignment(spark: SparkSession, sf: str) -> DataFrame:
    from seclog.llm.alignment import report

    return report(table(spark, sf, "documents"))


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_kmeans_tree_neighbours": op3_kmeans_tree_neighbours,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_toxicity": op5_toxicity,
    "op6_secret_scan": op6_secret_scan,
    "op7_bounded_ring_sharding": op7_bounded_ring_sharding,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_html_main_text": op9_html_main_text,
    "op10_range_coded_ids": op10_range_coded_ids,
    "op11_pareto_mixing": op11_pareto_mixing,
    "op12_qdwh_whitening": op12_qdwh_whitening,
    "op13_token_alignment": op13_token_alignment,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op11_pareto_mixing": MIXING}
