"""One query per operator, over its whole table, and its SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.convert import let
from logloom.llm import (bpe_rounds, chat_windows, chosen_path, dimension_scan, fim_fenwick, mixing_tree, periodic_runs, pii_boost, resample, robust_rules, secret_index, segment_lang,
                         suffix_dedup)
from logloom.llm.tables import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    told = "</s>[INST] ok [/INST]"
    chats = chats.unionByName(spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text")))
    back = chat_windows.read_back(chat_windows.windows(chats))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    per = back.select("conv_id", F.struct("window", told.alias("told"), F.array_join("loss", "").alias("loss")).alias("w"), F.size("turns").alias("n"), F.length("formatted").alias("chars"), "over_budget")
    per = per.groupBy("conv_id").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"),
                                     F.count(F.lit(1)).alias("n_windows"), F.count_if("over_budget").alias("n_over_budget"))  # one digest is one value
    joined = lambda field: F.array_join(F.transform("w", lambda w: w[field]), "")
    return per.select("conv_id", "n_turns", F.sha2(joined("told"), 256).alias("turns_sha256"), F.length(joined("loss")).cast("bigint").alias("loss_chars"),
                      F.sha2(joined("loss"), 256).alias("loss_sha256"), "formatted_chars", "n_windows", "n_over_budget")


@query
def op2_pii_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii_boost.find(docs, pii_boost.train(docs)).drop("text")
    base = F.filter("pii_spans", lambda s: s["base"])
    count = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("bigint")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(pii_boost.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii_boost.joined(base), 256).alias("base_sha256"), pii_boost.joined(F.col("pii_spans")).alias("spans"))


@query
def op3_bpe_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_rounds.digests(docs).drop("text")


@query
def op4_dimension_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dimension_scan.search(table(spark, sf_dir, "embeddings"), every=50)


@query
def op5_segment_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = segment_lang.train(docs.filter(~held_out))
    return segment_lang.identify(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model).drop("text")


@query
def op6_secret_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_index.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("secret_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = [r.kind for r in secret_index.RULES if r.base]
    only = F.filter("secret_spans", lambda s: s["ord"] < len(base))
    return found.select("doc_id", *map(of, base), F.sha2(secret_index.joined(only), 256).alias("base_sha256"), secret_index.joined(F.col("secret_spans")).alias("spans"))


@query
def op7_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op8_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.classes(table(spark, sf_dir, "documents"))


@query
def op9_mixing_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stored(mixing_tree.sized(table(spark, sf_dir, "documents"), "doc_id"), "op9-sizes")
    draws, goal, shards = mixing_tree.plan(sizes)
    rows = mixing_tree.copies(sizes, draws, shards)
    taken = F.col("mix_size") * F.size("mix_shards")
    return rows.join(goal, rows["source"].eqNullSafe(goal["source"])).select("doc_id", F.col("mix_size").alias("size"), "source_size", "target", taken.alias("taken"), F.col("mix_shards").alias("shards"))


@query
def op10_robust_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = robust_rules.judge(table(spark, sf_dir, "documents"))
    stats = [F.col(f"rule_stats.{s}").alias(s) for s in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return found.select("doc_id", *stats, F.col("rule_failed").alias("base_failed"), F.col("rule_kept").alias("kept"), F.col("rule_distance").alias("distance"))


@query
def op11_fim_fenwick(spark: SparkSession, sf_dir: str) -> DataFrame:
    formed = fim_fenwick.restore(fim_fenwick.transform(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return formed.select("doc_id", F.col("fim_units").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
                         F.sha2("fim_text", 256).alias("output_sha256"), F.sha2("fim_restored", 256).alias("restored_sha256"))


ORACLE["op11_fim_fenwick"] = """
with hashed as (
    select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents
), numbers as (
    select *, cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2, cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4 from hashed
), cuts as (
    select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
        case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from numbers
), parts as (
    select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from cuts
)
select doc_id, cast(n as bigint) as n, form, cast(case when form <> 'plain' then a end as bigint) as prefix_chars, cast(case when form <> 'plain' then b - a end as bigint) as middle_chars,
    sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
    sha256(t) as restored_sha256
from parts
"""


def _told_again(doc_id: Column, text: Column) -> Column:
    """Every tenth document's words repeat themselves from word a on, with period p, as the query's contract says."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), lambda s: F.array_join(F.transform(w, lambda t, i: F.when(i < s["a"], t).otherwise(F.get(w, s["a"] + (i - s["a"]) % s["p"]))), " ")))

    return F.coalesce(F.when(h % 10 == 0, let(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1)), repeated)), text)


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", _told_again(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs.collapse(docs)
    best = F.array_min(F.transform("run_spans", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("start"), r["period"].alias("period"))))
    listed = F.array_join(F.transform("run_spans", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))), "")
    found = found.withColumn("best", best)
    return found.select("doc_id", F.size("run_spans").cast("bigint").alias("n_runs"), F.col("best.start").alias("start"), (-F.col("best.l")).alias("length"), F.col("best.period").alias("period"),
                        F.floor(-1000 * F.col("best.l") / F.col("best.period")).cast("bigint").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
                        F.col("run_words").alias("n_words"))


@query
def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("dup_bytes").alias("n_bytes"), F.col("dup_removed").alias("n_removed"), F.size("dup_spans").cast("bigint").alias("n_spans"), F.sha2("dup_kept", 256).alias("kept_sha256"))
