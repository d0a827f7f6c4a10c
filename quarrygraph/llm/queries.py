"""The registered queries of this subpackage: each applies one operator to its whole table and derives the columns of
its contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrygraph.llm import ann, conversation_repair, decontaminate, fill_middle, jaccard_join, langid, license_scan, minhash_dedup, packing, secret_scan, suffix_dedup, toxicity, url_filter
from quarrygraph.llm.common import crc_mod, materialize, streamed_sha256

#: The tokenizer file of the packing query.
TOKENIZER = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_read(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_read(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = langid.fit_languages(langid.training_rows(docs))
    return langid.identify(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "accepted")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_read(spark, sf_dir, "documents"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(_read(spark, sf_dir, "pages"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    model = toxicity.fit_toxicity(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return toxicity.score_toxicity(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_read(spark, sf_dir, "embeddings"), k=20, every=20)


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan_secrets(_read(spark, sf_dir, "documents"))
    kinds = tuple(r.kind for r in secret_scan.BASE)
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *(count(k) for k in kinds),
        F.sha2(secret_scan.joined(F.col("findings"), kinds).cast("binary"), 256).alias("base_sha256"),
        secret_scan.joined(F.col("findings")).alias("spans"),
    )


def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(_read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"), F.array_max("places.start").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("places.label")), ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), "score",
    )


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    short, long = fill_middle.fill_in_middle(_read(spark, sf_dir, "documents"))
    columns = ("doc_id", "n", "form", "prefix_chars", "middle_chars")
    digest = lambda text, name: F.sha2(text.cast("binary"), 256).alias(name)
    one = short.select(*columns, digest(F.col("output"), "output_sha256"), digest(fill_middle.restored(F.col("form"), F.col("output")), "restored_sha256"))
    # parts of a long text, in the order of the output and in that of the text, without the sentinels
    long = materialize(long, "parts")
    text = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.regexp_replace("output", "^<[PSM]>", ""))
    out = streamed_sha256(long, [*columns, "row"], ["part"], "output", "output_sha256")
    back = streamed_sha256(long.withColumn("text", text), ["row"], ["span", "part"], "text", "restored_sha256")
    return one.unionByName(out.join(back, "row").select(*one.columns))


def op12_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = minhash_dedup.near_duplicates(_read(spark, sf_dir, "documents"), k=4, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "conversations")
    found = conversation_repair.repair_conversations(conversation_repair.damage_conversations(rows))
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    lines = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    whole = found.select("conv_id", "segment", "segments", *counts, "audit", lines.alias("lines"), (F.size("messages") > 0).alias("any"))
    one = whole.where("segments = 1").select("conv_id", *counts, "audit", F.sha2(F.col("lines").cast("binary"), 256).alias("repaired_sha256"))
    many = whole.where("segments > 1")
    # segments that keep no turn add no line
    digests = streamed_sha256(many.withColumn("lines", F.when(F.col("any"), F.col("lines"))), ["conv_id"], ["segment"], "lines", "repaired_sha256", "\n")
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "audit"))), lambda s: s["audit"]), "")
    sums = many.groupBy("conv_id").agg(*(F.sum(c).alias(c) for c in counts), audit.alias("audit"))
    same = sums["conv_id"].eqNullSafe(digests["conv_id"])
    several = sums.join(digests, same).select(sums["conv_id"], *counts, "audit", "repaired_sha256")
    done = one.unionByName(several).withColumnRenamed("conv_id", "_conv")
    every = rows.select("conv_id").distinct()
    none = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in counts]
    return every.join(done, F.col("conv_id").eqNullSafe(F.col("_conv")), "left").select("conv_id", *none, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_decontamination": op3_decontamination,
        "op4_language_id": op4_language_id,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_url_filters": op6_url_filters,
        "op7_toxicity": op7_toxicity,
        "op8_nearest_neighbours": op8_nearest_neighbours,
        "op9_secret_scans": op9_secret_scans,
        "op10_license_scans": op10_license_scans,
        "op11_fill_middle": op11_fill_middle,
        "op12_minhash_dedup": op12_minhash_dedup,
        "op13_conversation_repair": op13_conversation_repair,
    }


_WORDS_SQL = r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents)"""
_LINKS_SQL = """e as (select doc_id, len(s) as n, unnest(s) as g from s),
 linked as (select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
 reach as (select doc_id, doc_id as c from documents union select r.doc_id, l.b from reach r join linked l on l.a = r.c)"""
_JACCARD_SQL = f"""{_WORDS_SQL},
 s as (select doc_id, case when len(w) < 3 then list_filter([array_to_string(w, ' ')], lambda x: x <> '') else list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) end as s from w),
 {_LINKS_SQL.format(percent=90)}
 select s.doc_id, len(s.s)::bigint as n_shingles, min(r.c) as component_id from s join reach r using (doc_id) group by s.doc_id, s.s"""
_MINHASH_SQL = f"""{_WORDS_SQL},
 s as (select doc_id, case when len(w) < 4 then list_filter([array_to_string(w, ' ')], lambda x: x <> '') else list_distinct(list_transform(range(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3])) end as s from w),
 {_LINKS_SQL.format(percent=80)}
 select s.doc_id, len(s.s)::bigint as n_shingles, min(r.c) as component_id, s.doc_id = min(r.c) as kept from s join reach r using (doc_id) group by s.doc_id, s.s"""
_FILL_SQL = """with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id) as h, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u from documents),
 n as (select *, len(u)::bigint as n, ('0x' || h[1:8])::bigint as h1, ('0x' || h[9:16])::bigint as h2, ('0x' || h[17:24])::bigint as h3, ('0x' || h[25:32])::bigint as h4 from d),
 c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as low, greatest(h1 % (n + 1), h2 % (n + 1)) as high,
  case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from n),
 p as (select *, coalesce(array_to_string(u[1:low], ''), '') as prefix, coalesce(array_to_string(u[low + 1:high], ''), '') as middle, coalesce(array_to_string(u[high + 1:n], ''), '') as suffix from c)
 select doc_id, n, form, case when form <> 'plain' then length(prefix)::bigint end as prefix_chars, case when form <> 'plain' then length(middle)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(t) as restored_sha256 from p"""
_NEAREST_SQL = """with v as (select vec_id, embedding::double[] as e from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_sum(list_transform(embedding, lambda x: abs(x))) > 0)
 select query_id, rank::int as rank, vec_id, score from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from
 (select q.vec_id as query_id, v.vec_id, list_inner_product(v.e, q.e) as score from v q join v on q.vec_id % 20 = 0 and q.vec_id <> v.vec_id)) where rank <= 20"""


def oracle_sql() -> dict[str, str]:
    """Of the queries whose whole results SQL can give; the nearest neighbours are those of an exact search, which the index finds at
    the size of the comparison."""
    return {"op5_jaccard_join": _JACCARD_SQL, "op8_nearest_neighbours": _NEAREST_SQL, "op11_fill_middle": _FILL_SQL, "op12_minhash_dedup": _MINHASH_SQL}
