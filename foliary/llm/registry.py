"""Registered queries of the corpus operators: opN_<name> over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.llm import class_ngrams, dialogue_repair, disclosure, language_filters, length_histogram, line_templates, packing, rule_ensemble, set_join, source_mix, spaced_seeds, trie_variants, vector_dedup
from foliary.llm.common import read, remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op5_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return set_join.join_sets(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op3_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return spaced_seeds.contaminated(read(spark, folder, "documents"), read(spark, folder, "benchmark"))


@query
def op6_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents"))


@query
def op7_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = read(spark, folder, "documents"), read(spark, folder, "labels")
    model = rule_ensemble.fit(docs, labels.where(remainder(4) != 2))
    out = model.scored(docs.select("doc_id", "text")).select("all.doc_id", "score")
    return out.select("doc_id", (remainder(4) == 2).alias("held_out"), "score", rule_ensemble.predicted(F.col("score")).alias("predicted"))


@query
def op9_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its new text, the number of its lines and of those dropped."""
    out = line_templates.dropped(read(spark, folder, "documents").select("doc_id", "text"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    return out.select("all.doc_id", "text", count(F.split("all.text", "\n", -1)).alias("n_lines"), count(F.col("lines")).alias("n_dropped"))


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return length_histogram.context_report(read(spark, folder, "documents"))


@query
def op1_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.link(read(spark, folder, "embeddings"))


@query
def op8_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    model = language_filters.fit(docs.where(remainder(3) != 1).select("text", "lang"))
    return model.predict(docs.select("doc_id", (remainder(3) == 1).alias("held_out"), "text"))


@query
def op2_class_ngram_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents")
    return class_ngrams.score(docs.select("doc_id", "text", (remainder(5) == 1).alias("held_out")))


@query
def op4_disclosure_pii(spark: SparkSession, folder: str) -> DataFrame:
    return disclosure.report(read(spark, folder, "documents"))


@query
def op11_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return trie_variants.variants(read(spark, folder, "documents"))


@query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return dialogue_repair.Repair(dialogue_repair.damaged(read(spark, folder, "conversations"))).summary()


@query
def op13_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    return source_mix.plan(read(spark, folder, "documents"))


ORACLES["op13_source_mix"] = r"""
with sizes as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5(coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')) as key
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, 1 + (row_number() over (order by source nulls last) - 1) % 3 as weight
  from sizes group by source),
shares as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as share
  from sources
  window before as (order by 3 * source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)),
targets as (
  select source, source_size, least(weight * max(case when share * weight <= 3 * source_size then share end) over (), 3 * source_size)::double as target
  from shares),
cuts as (
  select doc_id, size, source_size, target, round(target)::bigint as budget,
         coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as start
  from sizes s join targets t on s.source is not distinct from t.source)
select doc_id, size::bigint as size, source_size, target,
       (case when source_size > 0 then budget // source_size * size + greatest(0, least(size, budget % source_size - start)) else 0 end)::bigint as taken
from cuts"""
