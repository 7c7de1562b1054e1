"""Joins, aggregates, windows and set operations of the storage, dataset, evaluation and monitoring parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from platewise.catalog import ORACLES, QUERIES
from platewise.functions.dialect import DUCK, SPARK
from platewise.operators import evaluation, lists
from platewise.plans.base import sql_query, statement, views

ROLE = "case when quality = 1 then 'item' else 'noise' end"
PRED = "case when n_chars % 5 = 0 then 'noise' when n_chars % 7 = 0 then 'price' else 'item' end"

sql_query("left_join_coalesce", lambda d: "select o_orderkey, coalesce(c_name, 'unknown') as name from orders left join customer on o_custkey = c_custkey and c_acctbal >= 0")
sql_query("semi_join_composite", lambda d: f"select l_orderkey, l_linenumber, l_quantity from lineitem l {'left semi' if d.name == 'spark' else 'semi'} join (select l_partkey as pk, l_suppkey as sk from lineitem where l_returnflag = 'R') r on l.l_partkey = r.pk and l.l_suppkey = r.sk")
sql_query("anti_join_unused", lambda d: f"select p_partkey, p_name from part p {'left anti' if d.name == 'spark' else 'anti'} join (select l_partkey from lineitem where l_quantity > 45) l on p.p_partkey = l.l_partkey")
sql_query("group_nested_lines", lambda d: f"select o_orderkey, {d.gather('item', 'l_linenumber', ';')} as lines, count(*) as n from (select o_orderkey, l_linenumber, concat(cast(l_partkey as varchar(20)), ':', l_returnflag) as item from orders join lineitem on o_orderkey = l_orderkey) t group by o_orderkey")
sql_query("best_role_lookup", lambda d: "with r as (select event_type as text, user_id, value, event_id, row_number() over (partition by event_type, user_id order by coalesce(value, 0) desc, event_id desc) as rn from events) select text, user_id, value, event_id from r where rn = 1")
sql_query("classification_report", lambda d: f"""
with x as (select {ROLE} as label, {PRED} as pred from labels join documents using (doc_id)), c as (select distinct label as k from x union select distinct pred from x),
s as (select k, count(case when label = k and pred = k then 1 end) as tp, count(case when label <> k and pred = k then 1 end) as fp, count(case when label = k and pred <> k then 1 end) as fn from c cross join x group by k)
select k as label, tp, fp, fn, tp + fn as support, round(coalesce(cast(tp as double) / nullif(tp + fp, 0), 0e0), 4) as prec, round(coalesce(cast(tp as double) / nullif(tp + fn, 0), 0e0), 4) as rec, round(coalesce(2e0 * tp / nullif(2 * tp + fp + fn, 0), 0e0), 4) as f1 from s""")
sql_query("table_counts", lambda d: " union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("part", "orders", "lineitem", "events", "documents", "labels")))
sql_query("kind_counts", lambda d: "select coalesce(nullif(event_type, 'view'), 'no_reason') as kind, count(*) as n from events group by coalesce(nullif(event_type, 'view'), 'no_reason')")
sql_query("request_stats", lambda d: "select concat('GET /', event_type) as path, count(*) as n, count(case when value > 9 then 1 end) as errors, round(avg(value), 4) as avg_ms, max(value) as max_ms, max_by(value, ts) as last_ms, max(event_id) as last_id from events group by event_type")
sql_query("stage_stats", lambda d: "select concat('worker', cast(user_id % 3 as varchar(3)), ':', event_type) as stage, count(*) as n, round(sum(value), 3) as total_ms, max(value) as max_ms from events group by concat('worker', cast(user_id % 3 as varchar(3)), ':', event_type)")
sql_query("recent_errors", lambda d: "select event_id, user_id, value from events where event_type = 'error' order by ts desc, event_id desc limit 20")
sql_query("cache_counters", lambda d: f"""
with e as (select event_id, {d.json('props', 'k')} as k, {d.epoch('ts')} as t from events), g as (select *, lag(t) over (partition by k order by t, event_id) as stored from e)
select count(*) as gets, count(case when stored is not null and t < stored + 1800 then 1 end) as hits, count(case when stored is null or t >= stored + 1800 then 1 end) as misses, count(distinct k) as n_keys from g""")
sql_query("dataset_summary", lambda d: "select source, count(*) as n, count(case when text is null or length(text) = 0 then 1 end) as empty, count(case when n_chars < 150 then 1 end) as tiny, round(avg(n_chars), 3) as mean_chars, max(n_chars) as max_chars from documents group by source")
EVENT_TYPES = ("click", "view", "error", "signup", "purchase")
sql_query("pivot_counts", lambda d: f"select {d.day('ts')} as d, {', '.join(f"count(case when event_type = '{t}' then 1 end) as {t}" for t in EVENT_TYPES)} from events group by {d.day('ts')}")
# Spark keeps 40 rows a brand in each task before it shuffles, then 40 in all, and numbers these: no task meets a whole brand
sql_query("round_robin_select", lambda d: f"""
with h as (select *, row_number() over (partition by p_name order by p_retailprice desc, p_partkey) as dup from part), u as (select * from h where dup = 1),
g as (select p_brand as brand, count(*) as size, max(p_retailprice) as top from u group by p_brand),
b as (select * from (select *, row_number() over (partition by p_brand order by p_retailprice desc, p_partkey) as rnd from u) r join g on brand = p_brand where rnd <= 40)
select p_partkey, p_brand, cast(row_number() over (order by rnd, size, top desc, p_brand) as int) as pick from {"(select * from b order by rnd, size, top desc, p_brand limit 40) b" if d.name == "spark" else "b"} order by rnd, size, top desc, p_brand limit 40""")
sql_query("latest_per_key", lambda d: "select l_partkey, l_orderkey, l_linenumber from (select *, row_number() over (partition by l_partkey order by l_shipdate desc, l_orderkey desc, l_linenumber desc) as rn from lineitem) t where rn = 1")
sql_query("item_ids", lambda d: f"select l_orderkey, l_linenumber, concat('menu_', cast(l_orderkey as varchar(20)), '_i', {d.format_int('row_number() over (partition by l_orderkey order by l_linenumber)', 3)}) as item_id from lineitem")
sql_query("merge_keep_first", lambda d: "select doc_id, origin, lang from (select *, row_number() over (partition by doc_id order by origin) as rn from (select doc_id, lang, 'a' as origin from documents where doc_id % 3 < 2 union all select doc_id, lang, 'b' as origin from documents where doc_id % 3 > 0) u) t where rn = 1")
sql_query("coverage_check", lambda d: "select (select count(*) from (select doc_id from documents except select doc_id from labels) a) as missing, (select count(*) from (select doc_id from labels except select doc_id from documents) b) as extra, (select count(*) from (select doc_id from documents intersect select doc_id from labels) c) as covered, (select count(distinct doc_id) from documents) as expected")
sql_query("offset_page", lambda d: "select p_partkey, p_name from part order by p_retailprice desc, p_partkey limit 25 offset 50")
sql_query("histogram_bins", lambda d: "select b as bin, count(*) as n from (select least(49, cast(floor((n_chars - lo) * 50e0 / (hi - lo)) as int)) as b from documents cross join (select min(n_chars) as lo, max(n_chars) as hi from documents) m) t group by b")
sql_query("report_comparison", lambda d: "with r as (select 'base' as model, source as split, avg(n_chars) as f1, false as is_active from documents group by source union all select 'cascade', source, avg(n_chars) * 1.1e0, true from documents where n_chars > 500 group by source) select split, max_by(model, f1) as best, round(max(f1), 3) as f1, max(case when is_active then round(f1, 3) end) as active_f1 from r group by split")
sql_query("positional_align", lambda d: """
with a as (select conv_id, turn, role, row_number() over (partition by conv_id order by turn) as pos from conversations), b as (select conv_id, turn + case when conv_id % 2 = 0 then 100 else 0 end as turn, length(text) as score, row_number() over (partition by conv_id order by turn) as pos from conversations)
select a.conv_id, a.turn, coalesce(x.score, y.score, 0) as score from a left join b x on a.conv_id = x.conv_id and a.turn = x.turn left join b y on a.conv_id = y.conv_id and a.pos = y.pos""")
sql_query("image_profile", lambda d: "with i as (select p_partkey, p_size * 20 as w, cast(p_retailprice as int) as h from part) select p_partkey, round(cast(w as double) / nullif(h, 0), 4) as aspect, w * h as area, least(w, h) < 150 as tiny, case when b.p is null then 'no_label' when w * h > 900000 then 'full' else 'ok' end as state from i left join (select distinct l_partkey as p from lineitem where l_quantity > 30) b on p_partkey = b.p".replace("cast(p_retailprice as int)", "cast(floor(p_retailprice) as int)"))
sql_query("import_mapping", lambda d: "with f as (select l_orderkey, l_suppkey, min(l_linenumber) as first_seen, count(*) as n from lineitem group by l_orderkey, l_suppkey) select l_orderkey, l_suppkey, cast(row_number() over (partition by l_orderkey order by first_seen, l_suppkey) as int) as page, n from f")
sql_query("missing_detail_join", lambda d: "select d.doc_id, d.lang, coalesce(cast(l.quality as varchar(5)), 'missing') as quality from documents d left join labels l on d.doc_id = l.doc_id")
sql_query("distinct_counts", lambda d: "select l_returnflag, count(distinct l_orderkey) as orders, count(distinct l_partkey) as parts from lineitem group by l_returnflag")
sql_query("box_envelope", lambda d: "select l_orderkey, min(l_quantity) as x1, min(l_discount) as y1, max(l_quantity + l_linenumber) as x2, max(l_tax) as y2, least(min(l_tax), min(l_discount)) as conf from lineitem group by l_orderkey")
sql_query("ocr_backend_summary", lambda d: "select case when doc_id % 2 = 0 then 'easy' else 'paddle' end as backend, round(avg(n), 4) as mean_lines, round(avg(c), 4) as mean_conf from (select doc_id, count(*) as n, avg(cast(n % 50 as double) / 50) as c from lines group by doc_id) p group by case when doc_id % 2 = 0 then 'easy' else 'paddle' end")
sql_query("review_auto_accept", lambda d: f"with r as (select event_id, case when event_id % 4 = 0 then 'minor;typo' when event_id % 4 = 1 then 'minor;unsafe' when event_id % 4 = 2 then '' else event_type end as reason from events) select event_id, reason <> '' and {d.size(d.keep(d.split('reason', ';'), 'v', chr(39).join(['v not in (', 'minor', ', ', 'typo', ', ', 'click', ')'])))} = 0 as accepted from r")


def by_operator(name: str, source, run, twin: str) -> None:
    """Run a query by an operator over ``source`` (SQL by dialect); the twin, written apart, is SQL over ``src``."""

    def query(spark, sf_dir):
        views(spark, sf_dir)
        return run(spark.sql(statement(SPARK, source)))

    query.__name__ = name
    QUERIES[name] = query
    ORACLES[name] = f"with src as ({statement(DUCK, source)}){twin}"


ROLES = lambda d: f"select {ROLE} as label, {PRED} as pred from labels join documents using (doc_id)"
by_operator("confusion_matrix", ROLES, evaluation.confusion_matrix, " select label, pred, count(*) as n from src group by label, pred")
by_operator("classification_summary", ROLES, lambda rows: evaluation.summary(evaluation.class_metrics(evaluation.confusion_matrix(rows))).select("n", *(F.round(c, 6).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1"))), """
, k as (select distinct label as k from src union select distinct pred from src), s as (select k, (select count(*) from src where label = k and pred = k) as tp, (select count(*) from src where label = k) as gold, (select count(*) from src where pred = k) as said from k)
select (select count(*) from src) as n, round((select avg(case when label = pred then 1e0 else 0e0 end) from src), 6) as accuracy, round(avg(coalesce(2e0 * tp / nullif(gold + said, 0), 0e0)), 6) as macro_f1,
  round(sum(coalesce(2e0 * tp / nullif(gold + said, 0), 0e0) * gold) / sum(gold), 6) as weighted_f1 from s""")
QUERIES["classification_report"] = lambda spark, sf_dir: evaluation.class_metrics(QUERIES["confusion_matrix"](spark, sf_dir)).select("label", "tp", "fp", "fn", "support", *(F.round(c, 4).alias(c) for c in ("prec", "rec", "f1")))

ANNOTATIONS = lambda d: """
select p_partkey as item_id, case p_size % 9 when 0 then '  ' when 1 then substr(p_name, 1, 2) when 2 then null else p_name end as dish_name, case p_size % 4 when 0 then null when 1 then '' else '12,50' end as price_text,
  case when p_size % 5 < 2 then null else p_retailprice end as price_value, case when p_size = 50 then null else (p_size - 3) / 40e0 end as confidence, p_size % 6 = 0 as needs_review, case when p_size % 12 = 0 then ' ' else 'blurred' end as review_reason from part"""  # noqa: E731
by_operator("validation_issues", ANNOTATIONS, lambda rows: evaluation.validation_issues(rows).select("item_id", "issue"), """
select item_id, 'missing dish_name' as issue from src where dish_name is null or trim(dish_name) = ''
union all select item_id, 'confidence out of range' from src where confidence < 0 or confidence > 1
union all select item_id, 'needs_review without review_reason' from src where needs_review and nullif(trim(review_reason), '') is null
union all select item_id, 'price_value without price_text' from src where nullif(trim(price_text), '') is null and price_value is not null
union all select item_id, 'price_text without price_value and no review flag' from src where trim(price_text) <> '' and price_value is null and not needs_review
union all select item_id, 'dish_name too short' from src where length(trim(dish_name)) between 1 and 2""")

#: List fields as annotators write them: JSON, a literal in single quotes, signs, one word, a number, blank, null.
LISTS = lambda d: f"""
select event_id, case user_id % 9 when 0 then concat('["', event_type, '", " b c ", "", 7]') when 1 then concat('[', chr(39), event_type, chr(39), ', ', chr(39), 'x', chr(39), ']') when 2 then concat(event_type, ' | b;c,') when 3 then concat(event_type, '; b, c;;')
  when 4 then concat(event_type, ', ,b') when 5 then event_type when 6 then {d.json('props', 'k')} when 7 then ' nan ' else case when event_id % 2 = 0 then '  ' end end as x from events"""  # noqa: E731
FLAVOURS = {"storage": lists.storage_list, "import": lists.import_list, "validation": lists.validation_list, "gold": lists.gold_list}
by_operator("list_flavours", LISTS, lambda rows: rows.select("event_id", *(F.array_join(f("x"), "~").alias(f"{n}_list") for n, f in ((n, lambda c, f=f: f(F.col(c))) for n, f in FLAVOURS.items()))), """
, t as (select event_id, trim(coalesce(x, '')) as x, case when json_valid(x) and json_type(x) = 'ARRAY' then json_extract_string(x, '$[*]') end as js, case when json_valid(replace(x, chr(39), '"')) and starts_with(x, '[') then json_extract_string(replace(x, chr(39), '"'), '$[*]') end as lit from src),
p as (select *, list_filter(list_transform(js, lambda v: trim(v)), lambda v: v <> '') as j, list_filter(list_transform(string_split(x, '|'), lambda v: trim(v)), lambda v: v <> '') as bar,
  list_filter(list_transform(string_split(x, ';'), lambda v: trim(v)), lambda v: v <> '') as semis, list_filter(list_transform(string_split(x, ','), lambda v: trim(v)), lambda v: v <> '') as comma from t)
select event_id, coalesce(array_to_string(case when x in ('', 'nan') then [] when js is not null then j else [x] end, '~'), '') as storage_list,
  coalesce(array_to_string(case when x = '' then [] when js is not null then j when contains(x, '|') then bar when contains(x, ';') then semis when contains(x, ',') then comma else [x] end, '~'), '') as import_list,
  coalesce(array_to_string(case when x = '' then [] when js is not null then j when lit is not null then lit else bar end, '~'), '') as validation_list,
  coalesce(array_to_string(case when x = '' then [] when lit is not null then lit when contains(x, ';') then semis when contains(x, ',') then comma else [x] end, '~'), '') as gold_list from p""")
sql_query("request_status", lambda d: f"""
with r as (select concat('GET /', event_type) as path, case when value > 9 then 500 when value > 8 then 404 else 200 end as status from events), c as (select path, status, count(*) as n from r group by path, status),
h as (select path, sum(n) as n, sum(case when status >= 400 then n else 0 end) as errors, {d.gather("concat(cast(status as varchar(9)), ':', cast(n as varchar(20)))", 'status', '|')} as histogram from c group by path)
select path, cast(n as bigint) as n, cast(errors as bigint) as errors, histogram, cast(row_number() over (order by n desc, path) as int) as place from h""")
sql_query("cache_categories", lambda d: f"""
with k as (select distinct concat('menu:', event_type, ':', {d.json('props', 'k')}) as cache_key from events)
select {d.rx('cache_key', '^[^:]*:([^:]*)', 1)} as category, count(*) as n_keys from k group by {d.rx('cache_key', '^[^:]*:([^:]*)', 1)}""")
sql_query("cascade_accept", lambda d: f"""
with x as (select doc_id, n, cast(n % 100 as double) / 100 as score, n % 3 = 0 as priced, line_order % 2 = 0 as sectioned, {d.size(d.split('trim(text)', ' '))} <= 2 as short from lines),
k as (select doc_id, priced, score >= 0.5e0 or (score >= 0.34e0 and priced) or (score >= 0.28e0 and short and sectioned) as kept from x),
g as (select doc_id, count(*) as n, count(case when kept then 1 end) as k, count(case when priced then 1 end) as p, count(case when priced and kept then 1 end) as kp from k group by doc_id)
select doc_id, n, case when k = 0 then n when n < 6 then k when k < greatest(4, cast({d.half_even('0.65e0 * n')} as bigint)) then n when p >= 6 and kp < greatest(4, cast({d.half_even('0.60e0 * p')} as bigint)) then n else k end as chosen from g""")
sql_query("group_split", lambda d: f"with g as (select lang, source, row_number() over (order by md5(concat(lang, '|', source)), lang, source) as rn, count(*) over () as n from (select distinct lang, source from documents) t) select doc_id, case when rn <= 0.8e0 * n then 'train' else 'test' end as split from documents join g using (lang, source)")
