"""Registered queries of the operators: the operator runs, the query derives the digest columns."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgecast.llm import decontaminate as decontamination
from ridgecast.llm import chat_format, chat_repair, language_id, license_scan, line_dedup, merkle, ngram_join, packing, quality, suffix_dedup, token_files, warc
from ridgecast.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def tokenizer_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


@query
def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(documents(spark, sf_dir))


@query
def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.suffix_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Text that looks like marks of a template; a conversation of it is added to the table.
MARKS = "\\### Assistant: </turn> ok"


@query
def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    record = F.to_json(F.struct("role", "text"), {"ignoreNullFields": "false"}).alias("record")
    messages = json.dumps({"messages": [{"role": r, "content": MARKS} for r in ("user", "assistant")]})
    extra = spark.range(1).select(F.lit(-7).cast("bigint").alias("conv_id"), F.lit(0).cast("bigint").alias("turn"), F.lit(messages).alias("record"))
    records = turns.select("conv_id", "turn", record).union(extra)
    return chat_format.read_back(chat_format.format_chats(records))


@query
def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.decontaminate(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    items = F.array_sort("hit_items")
    return found.select("doc_id", "n_words", "n_hit", F.size(items).cast("bigint").alias("n_items"),
                        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), "contaminated")


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(documents(spark, sf_dir), *tokenizer_files())


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.line_dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language_id.identify(docs, language_id.fitted(docs))
    held_out = (language_id.fold() == 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "accepted")


@query
def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).select("doc_id", "n_paragraphs", "n_licensed", "families")


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(documents(spark, sf_dir))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")


@query
def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read_pages(warc.convert(warc.arc_archives(pages)))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with one fault in four rows, dealt by a checksum of the row's place; nulls are one space."""
    whole = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")}
    kind = F.crc32(F.concat(whole["conv_id"], F.lit(":"), whole["turn"])) % 20
    role = F.when(kind == 4, "user").otherwise(whole["role"]).alias("role")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(whole["text"], "[.!?]", "")).otherwise(whole["text"]).alias("text")
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")
    return turns.filter(kind != 0).select("conv_id", "turn", role, text, copies).drop("copy")


@query
def op11_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = chat_repair.repair(damaged(turns)).withColumnRenamed("conv_id", "id")
    whole = turns.select("conv_id").distinct()
    joined = whole.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left").drop("id")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*merkle.FIELDS)
    claimed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in merkle.FIELDS]
    chosen = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    docs = docs.withColumn("claim", F.when(chosen, merkle.leaf(*claimed)))
    rows = merkle.manifest(docs, carried=("claim",)).withColumn("claim", F.coalesce("claim", "leaf"))
    checked = merkle.folded(rows, "claim")
    proof = F.sha2(F.lower(F.hex("siblings")), 256).alias("proof_sha256")
    return checked.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(documents(spark, sf_dir), *tokenizer_files()))


ORACLES["op12_merkle_manifest"] = r"""
with recursive docs as (
  select doc_id, lang, n_chars, coalesce('1' || lang, '0') as grp,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    list_reduce([4294967295] || range(8 * strlen(coalesce(doc_id::varchar, ''))), lambda c, k: case when k % 8 = 0
      then xor(xor(c, ascii(substr(cast(doc_id as varchar), k // 8 + 1, 1))) >> 1, 3988292384 * (xor(c, ascii(substr(cast(doc_id as varchar), k // 8 + 1, 1))) & 1))
      else xor(c >> 1, 3988292384 * (c & 1)) end) as crc
  from documents
), leaves as (
  select doc_id, grp, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
    case when doc_id is not null and xor(crc, 4294967295) % 7 = 0
      then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as claim
  from docs
), placed as (
  select *, row_number() over (partition by grp order by doc_id nulls first, leaf) - 1 as i from leaves
), tree as (
  select grp, 0 as level, list(leaf order by i) as nodes from placed group by grp
  union all
  select grp, level + 1, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')))
  from tree where len(nodes) > 1
), subroots as (
  select grp, nodes[1] as subroot, row_number() over (order by grp) - 1 as g from tree where len(nodes) = 1
), top as (
  select 0 as level, list(subroot order by g) as nodes from subroots
  union all
  select level + 1, list_transform(range((len(nodes) + 1) // 2), lambda k: sha256(nodes[2 * k + 1] || coalesce(nodes[2 * k + 2], '')))
  from top where len(nodes) > 1
), steps as (
  select p.grp, p.i, t.level as k, case when (p.i >> t.level) % 2 = 1 then 'L' || t.nodes[(p.i >> t.level)::bigint] else 'R' || coalesce(t.nodes[((p.i >> t.level) + 2)::bigint], '') end as step
  from placed p join tree t on p.grp = t.grp where len(t.nodes) > 1
  union all
  select p.grp, p.i, 1000 + t.level, case when (s.g >> t.level) % 2 = 1 then 'L' || t.nodes[(s.g >> t.level)::bigint] else 'R' || coalesce(t.nodes[((s.g >> t.level) + 2)::bigint], '') end
  from placed p join subroots s on p.grp = s.grp cross join top t where len(t.nodes) > 1
), paths as (
  select grp, i, list(step order by k) as steps from steps group by grp, i
), folded as (
  select p.doc_id, p.leaf, s.subroot, (select nodes[1] from top where len(nodes) = 1) as root, coalesce(q.steps, []) as steps,
    list_reduce([coalesce(p.claim, p.leaf)] || coalesce(q.steps, []), lambda h, x: sha256(case when x[1] = 'L' then x[2:] || h else h || x[2:] end)) as folded_root
  from placed p join subroots s on p.grp = s.grp left join paths q on p.grp = q.grp and p.i = q.i
)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(steps, lambda x: x[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified
from folded
"""

ORACLES["op3_chat_formatting"] = r"""
with turns as (
  select conv_id, turn, 0 as part, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 0, 1, 'assistant', '\### Assistant: </turn> ok'
), sized as (
  select *, length('### : ' || ' </turn>' || chr(10)) + length(role) + length(text)
    + length(regexp_replace(role || text, '[^\\#<:]', '', 'g')) as size from turns
)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, part)) as turns_sha256,
  cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, part), '')) as loss_sha256,
  cast(sum(size) as bigint) as formatted_chars
from sized group by conv_id
"""