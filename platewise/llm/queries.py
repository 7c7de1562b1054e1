"""The dealt queries: thin wrappers that derive the contract's columns from the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.llm import bpe_chunks, conversation_repair, cotraining, fingerprints, hard_negatives, license_scan, line_dedup, mixing, near_dedup, quality_rules, suffix_dedup, toxicity, warc
from platewise.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@_register
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_pages(table(spark, sf_dir, "pages"), min_bytes=0)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op2_warc"] = """
with p as (
  select page_id, coalesce(html, '') as body, sha1(coalesce(html, '')) as hex,
         max(page_id) over (partition by coalesce(html, '')) as original
  from pages
), g as (
  select *, list_transform([1, 11, 21, 31], lambda a: cast('0x' || substr(hex, a, 10) as bigint)) as parts from p
)
select page_id, cast(strlen(body) as bigint) as payload_bytes,
       list_aggregate(list_transform(range(32),
         lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                     cast(((parts[i // 8 + 1] >> cast(35 - 5 * (i % 8) as int)) & 31) + 1 as int), 1)), 'string_agg', '') as payload_digest,
       case when page_id is distinct from original then 'revisit' else 'response' end as record_type,
       case when page_id is distinct from original then original end as refers_to
from g
"""


@_register
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup_lines(docs, min_chars=20, min_docs=3)
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_dropped").alias("n_dropped"), F.sha2("ld_text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = """
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (
  select doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from s
), k as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l
), c as (
  select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3
), j as (
  select k.*, c.key is not null and k.doc_id <> c.last as dropped from k left join c on k.key = c.key
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from j group by doc_id
"""


@_register
def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality_rules.judge(docs, table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


@_register
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    out = cotraining.classify_quality(docs, table(spark, sf_dir, "labels"), labelled=3000, unlabelled=2000)
    return out.select("doc_id", F.col("ct_text_score").alias("text_score"), F.col("ct_meta_score").alias("meta_score"), F.col("ct_score").alias("score"), F.col("ct_kept").alias("kept"))


@_register
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    mix = mixing.mix_to_targets(docs, weights=(3, 1, 2), most=2, seed=42)
    return mix.select(
        F.col("mx_id").alias("doc_id"),
        F.col("mx_size").alias("size"),
        F.col("mx_source_size").alias("source_size"),
        F.col("mx_target").alias("target"),
        (F.col("mx_size") * F.col("mx_copies")).alias("taken"),
    )


@_register
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    out = toxicity.score_toxicity(docs, table(spark, sf_dir, "labels"), sample=12000, only=~held_out)
    return out.select(
        "doc_id",
        held_out.alias("held_out"),
        F.col("tx_score").alias("score"),
        (F.col("tx_score") >= 0.5).cast("int").alias("predicted"),
        F.col("tx_threshold").alias("lang_threshold"),
        F.col("tx_flagged").alias("lang_flagged"),
    )


def word_bpe_path() -> str:
    """The public vocabulary file that the queries use; the operator takes any path."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_register
def op10_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe_chunks.encode_documents(docs, word_bpe_path())
    return out.select("doc_id", F.col("bp_n_tokens").alias("n_tokens"), F.col("bp_ids_sha256").alias("ids_sha256"), F.col("bp_decoded_sha256").alias("decoded_sha256"))


@_register
def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_dedup.near_duplicates(docs, least=0.8)


@_register
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_neighbours(table(spark, sf_dir, "documents").select("doc_id", "text"))


@_register
def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@_register
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = license_scan.scan_licenses(docs, least=0.9, width=64)
    return out.select(
        "doc_id",
        F.col("ls_words").alias("n_words"),
        F.col("ls_places").alias("n_base"),
        F.col("ls_first").alias("first_word"),
        F.col("ls_last").alias("last_word"),
        F.array_join("ls_phrases", ",").alias("base_labels"),
        F.array_join("ls_labels", ",").alias("labels"),
        F.col("ls_score").alias("score"),
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)


_PASSAGES = list(enumerate(license_scan.passages(license_scan.TEMPLATES, 64)))
ORACLES["op11_license_scan"] = f"""
with w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from documents
), u as (
  select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) - 1 as pos from w
), n as (
  select *, lead(word) over o as next1, lead(word, 2) over o as next2 from u window o as (partition by doc_id order by pos)
), p as (
  select doc_id, pos, case when word = 'mit' then 'mit' when word = 'apache' then 'apache' else 'gpl' end as label from n
  where (word in ('mit', 'apache') and next1 = 'license') or (word = 'general' and next1 = 'public' and next2 = 'license')
), base as (
  select doc_id, count(*) as n_base, min(pos) as first_word, max(pos) as last_word, string_agg(distinct label, ',' order by label) as base_labels from p group by doc_id
), t(template, label, size, token) as (
  values {_values([(i, label, len(set(ws)), x) for i, (label, ws) in _PASSAGES for x in sorted(set(ws))])}
), b as (
  select doc_id, pos // 32 as block, word from u union all select doc_id, pos // 32 - 1, word from u where pos >= 32
), m as (
  select doc_id, label, count(distinct token) / size as containment from b join t on word = token
  group by doc_id, block, template, label, size having 10 * count(distinct token) >= 9 * size
), l as (
  select doc_id, string_agg(distinct label, ',' order by label) as labels, max(containment) as containment
  from (select doc_id, label, containment from m union all select doc_id, label, 1.0 from p) group by doc_id
)
select w.doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word,
       coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, cast(coalesce(containment, 0) as double) as score
from w left join base using (doc_id) left join l using (doc_id)
"""


@_register
def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("hn_id") % 50 == 0, scale=256, positives=5, negatives=3, low=50, high=95)


ORACLES["op12_hard_negatives"] = """
with e as (
  select row_number() over () as row, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select a.row as a_row, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_dot_product(a.v, b.v) as bigint) as score
  from e a join e b on a.row <> b.row where a.vec_id % 50 = 0
), p as (
  select * from s where same qualify row_number() over (partition by a_row order by score desc, vec_id) <= 5
), n as (
  select p.anchor_id, p.vec_id as positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
         row_number() over (partition by p.a_row, p.vec_id order by s.score desc, s.vec_id) as rank
  from p join s on p.a_row = s.a_row and not s.same and 100 * s.score between 50 * p.score and 95 * p.score
)
select anchor_id, positive_id, cast(rank as int) as rank, negative_id, positive_score, negative_score from n where rank <= 3
"""


@_register
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.translate(part("text"), ".!?", "")).otherwise(part("text"))
    damaged = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(part("role")).alias("role"), text.alias("text"), (kind != 0).alias("present"), kind.alias("kind"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    out = conversation_repair.repair(damaged.select("conv_id", "turn", "role", "text", "present", F.explode(copies)), present=F.col("present"))
    return out.toDF("conv_id", "rows", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").drop("rows")


#: The repair as a shortest path, row by row: for each automaton state (nothing, s, u, a) the cheapest cost, the least edits and the rows so far.
def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _stepped(q: int) -> str:
    """The cheapest way into state q by the next row: deleted, kept, or given another role; infinite where there is none."""
    move = lambda s, cost, letter, row: f"{{'c': p.b{s}.c + {cost}, 'e': p.b{s}.e || '{letter}', 't': {row}}}"
    kept = f"p.b{{s}}.t || [r.role || ':' || r.text]"
    options = [move(q, 4, "D", f"p.b{q}.t")]
    for s, to, initial, name in ((0, 1, "s", None), (0, 2, "u", "user"), (1, 2, "u", "user"), (3, 2, "u", "user"), (2, 3, "a", "assistant")):
        if to == q:
            options.append(move(s, f"case when r.fault in ('blank', 'duplicate') or r.role[1] <> '{initial}' then 1e9 else r.late end", "K", kept.format(s=s)))
            if name:
                options.append(move(s, "case when r.fault in ('blank', 'duplicate') then 1e9 else 3 + r.late end", "R", f"p.b{s}.t || ['{name}:' || r.text]"))
    return _least(*options)


def _inserted(frame: str) -> str:
    """Empty rows put in after any row: user after nothing, s or a, assistant after u; two at most, then costs only grow."""
    put = lambda s, name: f"{{'c': {s}.c + 3, 'e': {s}.e || 'I', 't': {s}.t || ['{name}:']}}"
    x2 = _least("a2", put("a0", "user"), put("a1", "user"), put("a3", "user"))
    x3 = _least("a3", put("a2", "assistant"))
    once = f"select * replace ({x2} as a2, {x3} as a3) from ({frame})"
    twice = f"select * replace ({x2} as a2, {x3} as a3) from ({once})"
    return f"select conv, i, a0 as b0, a1 as b1, a2 as b2, a3 as b3 from ({twice})"


_NOTHING = "{'c': 0::double, 'e': '', 't': cast([] as varchar[])}"
_NEVER = "{'c': 1e9::double, 'e': '', 't': cast([] as varchar[])}"
ORACLES["op13_conversation_repair"] = f"""
with recursive s as materialized (
  select *, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations
), h as materialized (
  select s.*, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda ch: ascii(ch)::bigint)),
    lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1))))) % 20 as kind from s
), d as (
  select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
         case kind when 1 then '' when 2 then translate(coalesce(text, ' '), '.!?', '') else coalesce(text, ' ') end as text,
         unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copy from h
), o as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as seen,
         lag(role[1]) over (partition by conv_id order by turn nulls first, role, text, copy) as before,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as bare from d
), f as (
  select *, case when bare = '' then 'blank' when seen > 1 then 'duplicate' when bare[-1] not in ('.', '!', '?') then 'truncated' else '' end as fault from o
), r as materialized (
  select *, case when fault = 'truncated' then 3 else 0 end as late, coalesce(cast(conv_id as varchar), '-') as conv from f
), w as (
  select conv, 0::bigint as i, b0, b1, b2, b3 from (
    {_inserted(f"select distinct conv, 0 as i, {_NOTHING} as a0, {_NEVER} as a1, {_NEVER} as a2, {_NEVER} as a3 from r")})
  union all
  {_inserted(f"select p.conv, r.i, {_stepped(0)} as a0, {_stepped(1)} as a1, {_stepped(2)} as a2, {_stepped(3)} as a3 from w p join r on p.conv = r.conv and r.i = p.i + 1")}
), e as (
  select w.conv, {_least("w.b0", "w.b3")} as best from w join (select conv, max(i) as i from r group by conv) m on w.conv = m.conv and w.i = m.i
), a as (
  select conv, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
         count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
         count(*) filter (where before || role[1] not in ('su', 'ua', 'au')) as illegal from r group by conv
)
select c.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated,
       coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.e, '') as audit,
       sha256(coalesce(array_to_string(best.t, chr(10)), '')) as repaired_sha256
from (select distinct conv_id, coalesce(cast(conv_id as varchar), '-') as conv from conversations) c left join a using (conv) left join e using (conv)
"""


def _pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = _pipeline
