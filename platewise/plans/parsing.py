"""What the layout parser knows of each line before its folds, held against SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from platewise.catalog import query
from platewise.functions import lexicon as L
from platewise.operators import parse
from platewise.plans.jobs import _lines


def _list(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _has(x: str, words: list[str]) -> str:
    return "(" + " or ".join(f"contains({x}, '{w}')" for w in words) + ")"


_BARE = "trim(regexp_replace(trim(regexp_replace(trim(regexp_replace({x}, '{p}', '', 'g'), ' -–|:'), '[.]{{2,}}', ' ', 'g'), ' -–|:'), ' +', ' ', 'g'))"
_KEY = "trim(regexp_replace(regexp_replace(lower({x}), '[^a-z0-9&+ ]+', ' ', 'g'), ' +', ' ', 'g'))"
_TITLES = """coalesce(len(list_filter(string_split({x}, ' '), lambda t: regexp_matches(t, '\\p{{L}}') and regexp_matches(t, '^[^A-Za-z]*[A-Z]')))
    / nullif(len(list_filter(string_split({x}, ' '), lambda t: regexp_matches(t, '\\p{{L}}'))), 0), 0)"""
_CAPITALS = "coalesce(length(regexp_replace({x}, '[^\\p{{Lu}}]', '', 'g')) / nullif(length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')), 0), 0)"
_P = L.TRAILING_PRICE_V3
_CODES = " ".join(f"when '{sign}' then '{code}'" for sign, code in L.CURRENCY_CODES.items())
_FOUND = ", ".join(f"case when {_has('lower(line)', words)} then '{name}' end" for name, words in sorted(L.PARSED_ALLERGENS["v3"].items()))

ORACLE = f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
a as (select doc_id, unnest(parts) as text, generate_subscripts(parts, 1) - 1 as line_order from s),
b as (select *, trim(regexp_replace(replace(translate(text, '@°%', 'a..'), '|', ' | '), '\\s+', ' ', 'g')) as line, cast(line_order * 37 % 500 as double) as x1, line_order * 20.0::double as y1 from a),
c as (select *, x1 + length(text) as x2, y1 + 12 as y2 from b where line <> ''),
p as (select doc_id, max(x2) as page_w, max(y2) as page_h, median(y2 - y1) as median_h from c group by doc_id),
d as (select *, x2 - x1 as w, (x1 + x2) / 2 as mid, (y1 + y2) / 2 as y from c join p using (doc_id)),
e as (
  select *, case when page_w <= 0 or w <= 0 or w >= 0.58 * page_w or (x1 <= 0.22 * page_w and x2 >= 0.78 * page_w) then 'full' when mid < page_w / 2 then 'left' else 'right' end as lane,
         {_BARE.format(x='line', p=_P)} as name, {_KEY.format(x='line')} as k, len(string_split(line, ' ')) as words, regexp_matches(line, '{_P}') as priced,
         {_TITLES.format(x='line')} as titles, {_CAPITALS.format(x='line')} as capitals, regexp_extract(line, '{_P}', 2) as digits from d
), f as (
  select *, {_KEY.format(x='name')} as nk, case when name = '' then 0 else len(string_split(name, ' ')) end as nw, {_TITLES.format(x='name')} as nt, {_CAPITALS.format(x='name')} as nc,
         k in ({_list(L.WEEKDAYS)}) as weekday, {_has('k', L.WARNINGS)} as warning, k in ({_list(L.HEADER_NOISE)}) as header, replace(digits, ',', '.') as value,
         lower(coalesce(nullif(regexp_extract(line, '{_P}', 1), ''), nullif(regexp_extract(line, '{_P}', 3), ''))) as sign from e
), g as (
  select *, name <> '' and nk not in ({_list(L.BAD_NAMES)}) and not weekday and not warning as able, nw = 1 and nk not in ({_list(L.SINGLE_FOODS)}) as alone,
         nw > 8 or (regexp_matches(name, '[0-9]') and nw <= 2) or (nt < 0.45 and nc < 0.35 and nw >= 3) as unlike,
         page_w > 0 and w > 0 and (abs(mid - page_w / 2) <= 0.18 * page_w or lane <> 'full') as centred from f
)
select cast(doc_id as varchar) as menu_id, cast(line_order as int) as line_order, line, lane, priced and name = '' as is_price, weekday as is_weekday,
  not weekday and not warning and not header and (k in ({_list(L.SECTION_WORDS_V3)}) or (not priced and k like '%menu')
    or (not priced and words <= 4 and centred and (12 >= 1.25 * median_h or (words <= 3 and (titles >= 0.75 or capitals > 0.6))))) as is_section,
  warning or header or (y <> 0 and page_h > 0 and y < 0.11 * page_h and words <= 4 and not priced) as is_noise,
  not priced and not weekday and (words >= 7 or regexp_matches(line, '[,;]') or (regexp_matches(lower(line), '^\\p{{Ll}}') and words >= 3)
    or {' or '.join(f"starts_with(lower(line), '{w} ')" for w in sorted(set(L.DESCRIPTION_STARTERS_V3)))}) as is_desc,
  able and (priced or (not unlike and not alone)) as is_name, able and not priced and not unlike and alone as is_single,
  case when not priced then null when not contains(value, '.') and cast(value as double) >= 1000 and cast(value as double) < 10000 and (contains(line, '|') or ends_with(line, value))
    then round(cast(value as double) / 100, 2) else cast(value as double) end as price_value,
  case sign {_CODES} else sign end as price_currency, array_to_string(list_filter([{_FOUND}], lambda x: x is not null), ',') as allergens
from g
"""


@query("layout_line_classes", ORACLE)
def _classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = parse.with_price(parse.classify(parse.laid_out(_lines(spark, sf_dir)), "v3"), "line", "line", "v3")
    flags = ["is_price", "is_weekday", "is_section", "is_noise", "is_desc", "is_name", "is_single"]
    return rows.select(
        "menu_id", "line_order", "line", F.col("col").alias("lane"), *flags, "price_value", "price_currency",
        F.array_join(parse.allergens(F.col("line"), "v3"), ",").alias("allergens"),
    )
