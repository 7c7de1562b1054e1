"""Normalisers, line features and predicates, overlap measures, and label sources over text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.functions import lexicon as L
from platewise.functions.dialect import DUCK, SPARK
from platewise.operators.overlap import best_overlap
from platewise.operators.words import bucket_counts, least_codes
from platewise.plans.base import any_of, sql_query, statement, views

#: The digits and letters of a line; the documents' accented letters count as letters in both engines.
UPPER, LETTER = "[A-ZÀ-ÖØ-Þ]", "[A-Za-zÀ-ÖØ-öø-ÿ]"


def norm(d, x: str) -> str:
    return f"trim({d.rr(f'coalesce({x}, chr(32))', '[ \\t\\n\\r\\x0b\\x0c\\x{00A0}]+', ' ')})"


def ratio(d, x: str) -> str:
    return f"coalesce(cast({d.count(x, UPPER)} as double) / nullif({d.chars(x, LETTER)}, 0), 0e0)"


def title(d, x: str) -> str:
    return f"coalesce(cast({d.count(x, r'(?:^|[^A-Za-z])[A-Z]')} as double) / nullif({d.count(x, '[A-Za-z]+')}, 0), 0e0)"


sql_query("scan_normalize_text", lambda d: f"select doc_id, md5({norm(d, 'text')}) as plain, md5(lower({norm(d, 'text')})) as folded, md5(trim({d.rr('lower(text)', '[^a-z0-9&+ ]+', ' ')})) as key from documents")
sql_query("eval_normalizers", lambda d: f"""
select p_partkey, trim({d.rr("replace(translate(concat(p_name, '@', p_brand), '@', 'a'), '%', '.')", ' +', ' ')}) as v3, trim({d.rr('lower(p_brand)', '[^a-z0-9 ]+', ' ')}) as key,
  case when lower(trim(p_type)) in ('', 'nan') then '' else trim(p_type) end as clean,
  case when cast(p_size % 3 as varchar(5)) in ('1') then true when cast(p_size % 3 as varchar(5)) in ('0') then false else true end as flag,
  {d.rx("concat('p', cast(p_size as varchar(9)))", '^p([0-9]+)$', 1)} as page from part""")
sql_query("parse_list_values", lambda d: f"""
select event_id, {d.json('props', 'k')} as k, {d.size(d.split("concat(event_type, '|', cast(user_id as varchar(20)))", '|'))} as n,
  {d.join(d.distinct(d.split("concat(event_type, ';', event_type)", ';')), ',')} as parts from events""")
sql_query("list_parsers_lenient", lambda d: f"""
select event_id, {d.join(d.keep(d.map(d.split("case when event_id % 3 = 0 then concat('[', event_type, ', x]') when event_id % 3 = 1 then concat(event_type, ', ', 'y') else '' end", ','), 'v', f"trim({d.rr('v', '[^a-z]+', '')})"), 'w', "length(w) > 0"), '|')} as parts from events""")
sql_query("cache_fingerprint", lambda d: f"""
select event_id, concat('menu:', event_type, ':', {d.sha256("concat('{\"context\":{\"engine\":\"tfidf\"},\"payload\":{\"k\":', " + d.json('props', 'k') + ", ',\"user\":', cast(user_id as varchar(20)), '}}')")}) as cache_key from events""")
sql_query("line_features", lambda d: f"""
select doc_id, line_order, {d.count('text', r'[^ \t\r\x0b\x0c]+')} as word_count, n as char_count, {d.count('text', '[0-9]')} as digit_count, {d.count('text', ',')} as comma_count,
  round({ratio(d, 'text')}, 6) as uppercase_ratio, round({title(d, 'text')}, 6) as title_ratio, {d.rlike('text', L.PRICE_ONLY)} as price_only,
  greatest(0, n * 7 - line_order) as bbox_width, round((line_order * 20e0 + 9) / 2, 4) as center_y from lines""")
#: The digits of the price at the end of a line. What ``PRICE`` and ``TRAILING_PRICE`` let stand before them is optional, so the same digits are found without trying it at every character.
_DIGITS = "([0-9]{1,5}(?:[.,][0-9]{1,2})?)"
_LAST_DIGITS = rf"(?i){_DIGITS}\s*(?:rub|usd|eur|inr|€|\$|£|₹|₽)?\s*$"


def _prices(d) -> str:
    if d.name == "spark":
        # each pattern runs once a line
        return f"""
with f as (select doc_id, line_order, {d.rx('text', _DIGITS, 1)} as first_price, {d.rx('text', _LAST_DIGITS, 1)} as trailing_price from lines)
select doc_id, line_order, first_price, trailing_price, case when contains(trailing_price, '.') or contains(trailing_price, ',') then null
  when try_cast(nullif(trailing_price, '') as double) >= 1000 and try_cast(nullif(trailing_price, '') as double) < 10000 then round(try_cast(trailing_price as double) / 100, 2) end as repaired from f"""
    return f"""
select doc_id, line_order, {d.rx('text', L.PRICE, 2)} as first_price, {d.rx('text', L.TRAILING_PRICE, 2)} as trailing_price,
  case when {d.try_double("nullif(replace(" + d.rx('text', L.TRAILING_PRICE, 2) + ", ',', '.'), '')")} >= 1000 and not contains({d.rx('text', L.TRAILING_PRICE, 2)}, '.') and not contains({d.rx('text', L.TRAILING_PRICE, 2)}, ',')
    and {d.try_double("nullif(" + d.rx('text', L.TRAILING_PRICE, 2) + ", '')")} < 10000 then round({d.try_double("nullif(" + d.rx('text', L.TRAILING_PRICE, 2) + ", '')")} / 100, 2) end as repaired from lines"""


sql_query("price_extraction", _prices)
sql_query("section_predicates", lambda d: f"""
with f as (select doc_id, line_order, text, lower(text) as low, {d.count('text', r'[^ \t]+')} as wc, {d.rlike('text', '[0-9]')} as priced, {ratio(d, 'text')} as up, {d.chars('text', LETTER)} as letters,
  {d.count('text', '[0-9]')} as digits, lead({d.rlike('text', L.PRICE_ONLY)}) over (partition by doc_id order by line_order) as next_price from lines)
select doc_id, line_order, low in ({', '.join(repr(w) for w in L.SECTION_WORDS)}) as section_v1,
  not priced and (low in ({', '.join(repr(w) for w in L.SECTION_WORDS)}) or (wc <= 4 and up > 0.65e0 and letters > 0) or (wc <= 4 and low like '%menu')) as section_v2,
  not priced and (contains(text, ',') or wc >= 5 or {' or '.join(f"low like '{w}%'" for w in L.DESCRIPTION_STARTERS)}) as description_v2,
  low not in ({', '.join(repr(w) for w in L.BAD_NAMES)}) and letters > 0 and digits <= letters and (wc <= 8 or priced) and not (not priced and wc <= 4 and up > 0.65e0) as name_v2,
  wc = 1 and coalesce(next_price, false) as name_before_price, wc <= 6 and not priced and not contains(text, ',') and up >= 0.55e0 as section_like from f""")
sql_query("noise_predicates", lambda d: f"""
select doc_id, line_order, lower(trim(text)) in ({', '.join(repr(w) for w in L.WEEKDAYS)}) as weekday, contains(lower(text), 'foodborne illness') or contains(lower(text), 'consuming raw') or contains(lower(text), 'risk of') as footer,
  line_order < 0.11e0 * max(line_order) over (partition by doc_id) and {d.count('text', '[^ ]+')} <= 4 as header,
  n > 1.25e0 * avg(n) over (partition by doc_id) and {ratio(d, 'text')} > 0.6e0 as tall_section, {d.count('lower(text)', '[a-z][a-z-]*')} as tokens from lines""")
sql_query("token_overlap", lambda d: f"""
with q as (select item_id, {d.distinct(d.every('lower(text)', '[a-z0-9][a-z0-9]+'))} as qt from benchmark where item_id % 20 = 0),
t as (select doc_id, {d.distinct(d.every('lower(text)', '[a-z0-9][a-z0-9]+'))} as tt from documents)
select doc_id, item_id, round(cast({d.size(d.both('tt', 'qt'))} as double) / nullif({d.size(d.either('tt', 'qt'))}, 0), 6) as jaccard, round(cast({d.size(d.both('tt', 'qt'))} as double) / nullif({d.size('qt')}, 0), 6) as coverage from t cross join q""")
_DICE = lambda d: f"""
with q as (select item_id, trim({d.rr('lower(text)', '[^a-z0-9 ]+', ' ')}) as q from benchmark),
t as (select doc_id, line_order, trim({d.rr('lower(text)', '[^a-z0-9 ]+', ' ')}) as t from lines), p as (
  select doc_id, line_order, item_id, t, q, {d.distinct(d.every('t', '[a-z0-9]+'))} as a, {d.distinct(d.every('q', '[a-z0-9]+'))} as b from t cross join q where length(t) > 0)
select item_id, round(max(case when contains(q, t) then cast(length(t) as double) / length(q) when contains(t, q) then cast(length(q) as double) / length(t) else 2e0 * {d.size(d.both('a', 'b'))} / ({d.size('a')} + {d.size('b')}) end), 6) as best from p group by item_id"""


@query("dice_similarity", statement(DUCK, _DICE))
def _dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    key = f"trim({SPARK.rr('lower(text)', '[^a-z0-9 ]+', ' ')})"
    asked = spark.sql(f"select item_id, coalesce({key}, '') as q from benchmark")  # a null text is as unlike as an empty one
    lines = spark.sql(statement(SPARK, lambda d: "select lower(text) as low from lines"))
    return best_overlap(asked, lines).withColumn("best", F.round("best", 6))


_WEAK = lambda d: f"""
with src as (select 1 as prio, lower(l_returnflag) as w from lineitem group by l_returnflag union all select 2, w from (select distinct w from (select {d.explode(d.distinct(d.every('lower(p_name)', '[a-z]+')), 'w')} from part) n) i union all select 3, 'the' union all select 3, 'de'),
t as (select doc_id, line_order, {d.explode(d.distinct(d.every('lower(text)', '[a-z]+')), 'w')} from lines),
m as (select doc_id, line_order, min(prio) as prio from t join src on t.w = src.w group by doc_id, line_order)
select l.doc_id, l.line_order, case prio when 1 then 'section' when 2 then 'item_name' when 3 then 'description' else 'noise' end as label from lines l left join m on l.doc_id = m.doc_id and l.line_order = m.line_order"""  # noqa: E731
#: Words that travel to every task; more of them meet the words of the lines by a join.
SOURCE_WORDS = 100_000


@query("weak_labels", statement(DUCK, _WEAK))
def _weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    sources = spark.sql(f"""
select w, min(prio) as prio from (
  select 1 as prio, lower(l_returnflag) as w from lineitem group by l_returnflag
  union all select 2, {SPARK.explode(SPARK.every('name', '[a-z]+'), 'w')} from (select distinct lower(p_name) as name from part) n
  union all select 3, {SPARK.explode("array('the', 'de')", 'w')}) s where w is not null group by w""")
    codes = {r.w: r.prio for r in sources.limit(SOURCE_WORDS + 1).collect()}
    if len(codes) > SOURCE_WORDS:
        return spark.sql(statement(SPARK, _WEAK))
    found = least_codes(spark.sql("select doc_id, lower(coalesce(text, '')) as low from documents"), "doc_id", "low", codes, 4)
    # lines of one id and place count together; without an id they meet none, and are dealt to all tasks
    together = Window.partitionBy("doc_id", "line_order", "alone")
    best = found.withColumn("alone", F.when(F.isnull("doc_id"), F.rand(0))).withColumn("code", F.min("code").over(together))
    label = F.when(F.isnull("doc_id"), "noise")
    for code, name in enumerate(("section", "item_name", "description"), 1):
        label = label.when(F.col("code") == code, name)
    return best.select("doc_id", "line_order", label.otherwise("noise").alias("label"))


sql_query("carry_forward_section", lambda d: """
select doc_id, line_order, coalesce(max(case when n < 40 then line_order end) over (partition by doc_id order by line_order rows between unbounded preceding and current row), -1) as section_line from lines""")
sql_query("reading_order", lambda d: f"""
with b as (select doc_id, line_order, (line_order * 37) % 500 as x1, (line_order * 37) % 500 + n as x2, line_order * 20 as y1, line_order * 20 + 9 + n % 5 as y2 from lines),
p as (select *, max(x2) over (partition by doc_id) as pw, min(x1) over (partition by doc_id) as mn, max(x1) over (partition by doc_id) as mx from b),
c as (select *, case when x2 - x1 >= 0.58e0 * pw or (x1 <= 0.22e0 * pw and x2 >= 0.78e0 * pw) then 'full' when (x1 + x2) / 2e0 < pw / 2e0 then 'left' else 'right' end as col, floor((x1 - mn) / least(260e0, greatest(80e0, 0.18e0 * (mx - mn))) + 0.5e0) as cluster from p)
select doc_id, line_order, col, cast(cluster as int) as cluster, cast(row_number() over (partition by doc_id order by cluster, y1, x1, line_order) as int) as reading from c""")
sql_query("neighbour_merge", lambda d: f"""
select doc_id, line_order, coalesce(lower({d.rx('text', '[A-Za-z]+')}) in ('and', 'with', 'the', 'of') and lag(n) over (partition by doc_id order by line_order) < 60, false) as joins_previous, coalesce(lead(n) over (partition by doc_id order by line_order), 0) as next_length from lines""")
sql_query("array_set_ops", lambda d: f"""
select doc_id, {d.size(d.either('a', 'b'))} as n_union, {d.size(d.both('a', 'b'))} as n_both, {d.size(d.minus('a', 'b'))} as n_minus from (
  select doc_id, {d.distinct(d.every('lower(text)', '[a-z]+'))} as a, {d.array("'the'", "'and'", "'of'", "'de'", "'la'", "'und'")} as b from documents) t""")
sql_query("llm_output_clean", lambda d: f"""
select conv_id, turn, md5(trim({d.rr(d.rr("text", ' +([.,;!?])', r'\1' if d.name == 'duck' else '$1'), '^[-. ]+|[- ]+$', '')})) as cleaned, substr(text, 1, 280) as preview, {d.rx("concat('```json ', role, ' ```')", '^```json (.*) ```$', 1)} as unfenced,
  coalesce(nullif(trim(case when turn = 0 then ' ' else role end), ''), 'none') as field from conversations""")
sql_query("formatted_ids", lambda d: f"""
select p_partkey, concat('batch_', {d.format_int('p_partkey % 1000', 3)}) as menu_id, concat('item_', {d.format_int('p_partkey % 10000', 4)}) as item_id, concat('wave_', {d.format_int('p_size', 2)}) as wave_id, {d.rr("concat('http://host/', p_brand, '//')", '/+$', '')} as url,
  concat('bucket=', p_type, '; size=', cast(p_size as varchar(9))) as reason, {d.join(d.keep(d.map(d.split("'en, fr,, de'", ','), 'v', 'trim(v)'), 'w', 'length(w) > 0'), '+')} as langs from part""")
sql_query("llm_parse_prompt", lambda d: f"select doc_id, md5(concat('Parse these menu lines into dishes. Lines: ', {d.gather('text', 'line_order', ' / ')})) as prompt from lines group by doc_id")
_HASHED = lambda d: f"""
with w as (select p_partkey as id, {d.posexplode(d.every("lower(concat(p_name, ' ', p_brand))", '[a-z0-9]+'), 'pos', 'term')} from part), g as (select id, term from w union all select a.id, concat(a.term, ' ', b.term) from w a join w b on a.id = b.id and a.pos + 1 = b.pos),
c as (select id, {d.hexint('substr(md5(term), 1, 8)')} % 256 as bucket, count(*) as n from g group by id, {d.hexint('substr(md5(term), 1, 8)')} % 256), l as (select id, sqrt(cast(sum(n * n) as double)) as len from c group by id)
select c.id, cast(bucket as int) as bucket, round(n / len, 6) as weight from c join l on c.id = l.id"""  # noqa: E731


@query("hashing_embeddings", statement(DUCK, _HASHED))
def _hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    views(spark, sf_dir)
    words = spark.sql(f"select p_partkey as id, {SPARK.every("lower(concat(coalesce(p_name, ''), ' ', coalesce(p_brand, '')))", '[a-z0-9]+')} as words from part where p_partkey is not null")
    # a small file may hold many rows: they are dealt to all tasks first
    names = words.repartition("id").groupBy("id").agg(F.collect_list("words").alias("names"))
    return bucket_counts(names, "id", "names").select("id", "bucket", F.round(F.col("n") / F.col("len"), 6).alias("weight"))


sql_query("cosine_pairs", lambda d: f"select a.vec_id as a, b.vec_id as b, round({d.cosine('a.embedding', 'b.embedding')}, 4) + 0e0 as cosine from embeddings b join (select * from embeddings where vec_id % 20 = 0) a on a.vec_id <> b.vec_id")
KNN = "s as (select a.vec_id as q, b.vec_id as v, b.label as label, round({cos}, 4) as cosine from embeddings b join (select * from embeddings where vec_id % 20 = 0) a on a.vec_id <> b.vec_id)"
sql_query("vector_knn", lambda d: f"with {KNN.format(cos=d.cosine('a.embedding', 'b.embedding'))} select q, v, cosine, rn from (select *, cast(row_number() over (partition by q order by cosine desc, v) as int) as rn from s) t where rn <= 5")
sql_query("duplicate_groups", lambda d: f"select md5(text) as hash, count(*) as n, {d.gather_set('source', ',')} as sources, min(doc_id) as first_doc from documents group by md5(text) having count(*) > 1")
