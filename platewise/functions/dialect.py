"""One query text for two engines: Spark SQL and the SQL that checks it.

A query is written once as a function of a dialect; only the spelling of functions differs.
"""

from __future__ import annotations


class Spark:
    name = "spark"

    def rr(self, x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, r'{pattern}', '{to}')"

    def rx(self, x: str, pattern: str, group: int = 0) -> str:
        return f"regexp_extract({x}, r'{pattern}', {group})"

    def rlike(self, x: str, pattern: str) -> str:
        return f"({x} rlike r'{pattern}')"

    def every(self, x: str, pattern: str) -> str:
        return f"regexp_extract_all({x}, r'{pattern}', 0)"

    def count(self, x: str, pattern: str) -> str:
        """Matches of the pattern, 0 for null."""
        return f"coalesce(regexp_count({x}, r'{pattern}'), 0)"

    def chars(self, x: str, group: str) -> str:
        """Characters of a class, 0 for null; taking whole runs out is quicker than one match a character."""
        return f"coalesce(length({x}) - length(regexp_replace({x}, r'{group}+', '')), 0)"

    def split(self, x: str, by: str) -> str:
        return f"split({x}, r'[{by}]', -1)" if by != "\n" else f"split({x}, '[\\n]', -1)"

    def size(self, x: str) -> str:
        return f"coalesce(size({x}), 0)"

    def compact(self, *parts: str) -> str:
        return f"array_compact(array({', '.join(parts)}))"

    def join(self, x: str, by: str) -> str:
        return f"array_join({x}, '{by}')"

    def distinct(self, x: str) -> str:
        return f"array_sort(array_distinct({x}))"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def either(self, a: str, b: str) -> str:
        return f"array_distinct(concat({a}, {b}))"

    def minus(self, a: str, b: str) -> str:
        return f"array_except({a}, {b})"

    def array(self, *parts: str) -> str:
        return f"array({', '.join(parts)})"

    def has(self, a: str, x: str) -> str:
        return f"array_contains({a}, {x})"

    def explode(self, x: str, name: str) -> str:
        return f"explode({x}) as {name}"

    def posexplode(self, x: str, pos: str, name: str) -> str:
        return f"posexplode({x}) as ({pos}, {name})"

    def keep(self, x: str, v: str, cond: str) -> str:
        return f"filter({x}, {v} -> {cond})"

    def map(self, x: str, v: str, expr: str) -> str:
        return f"transform({x}, {v} -> {expr})"

    def sha256(self, x: str) -> str:
        return f"sha2({x}, 256)"

    def hexint(self, x: str) -> str:
        return f"cast(conv({x}, 16, 10) as bigint)"

    def try_double(self, x: str) -> str:
        return f"try_cast({x} as double)"

    def gather(self, x: str, order: str, by: str) -> str:
        """Values joined in the order of ``order``."""
        return f"array_join(transform(array_sort(collect_list(named_struct('o', {order}, 'v', {x}))), e -> e.v), '{by}')"

    def gather_set(self, x: str, by: str) -> str:
        return f"array_join(array_sort(collect_set({x})), '{by}')"

    def idiv(self, a: str, b: str) -> str:
        return f"({a} div {b})"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def half_even(self, x: str) -> str:
        return f"bround({x}, 0)"

    def json(self, x: str, key: str) -> str:
        return f"get_json_object({x}, '$.{key}')"

    def format_int(self, x: str, width: int) -> str:
        # padded, never cut
        return f"lpad(cast({x} as string), greatest({width}, length(cast({x} as string))), '0')"

    def cosine(self, a: str, b: str) -> str:
        dot = lambda p, q: f"aggregate(zip_with({p}, {q}, (x, y) -> cast(x as double) * cast(y as double)), cast(0 as double), (s, v) -> s + v)"
        return f"coalesce(try_divide({dot(a, b)}, sqrt({dot(a, a)}) * sqrt({dot(b, b)})), 0D)"

    def day(self, x: str) -> str:
        return f"date_format({x}, 'yyyy-MM-dd')"

    # the other engine casts seconds with a fraction, which rounds halves to even
    epoch = staticmethod(lambda x: f"cast(bround(unix_micros(cast({x} as timestamp)) / 1e6D, 0) as bigint)")


class Duck(Spark):
    name = "duck"

    def rr(self, x, pattern, to):
        return f"regexp_replace({x}, '{pattern}', '{to}', 'g')"

    def rx(self, x, pattern, group=0):
        return f"regexp_extract({x}, '{pattern}', {group})"

    def rlike(self, x, pattern):
        return f"regexp_matches({x}, '{pattern}')"

    def every(self, x, pattern):
        return f"regexp_extract_all({x}, '{pattern}')"

    def count(self, x, pattern):
        return f"coalesce(len(regexp_extract_all({x}, '{pattern}')), 0)"

    def chars(self, x, group):
        return self.count(x, group)

    def split(self, x, by):
        return f"string_split({x}, chr({ord(by)}))"

    def size(self, x):
        return f"coalesce(len({x}), 0)"

    def compact(self, *parts):
        return f"list_filter([{', '.join(parts)}], lambda q: q is not null)"

    def join(self, x, by):
        return f"coalesce(array_to_string({x}, '{by}'), '')"

    def distinct(self, x):
        return f"list_sort(list_distinct({x}))"

    def both(self, a, b):
        return f"list_intersect({a}, {b})"

    def either(self, a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def minus(self, a, b):
        return f"list_filter({a}, lambda q: not list_contains({b}, q))"

    def array(self, *parts):
        return f"[{', '.join(parts)}]"

    def has(self, a, x):
        return f"list_contains({a}, {x})"

    def explode(self, x, name):
        return f"unnest({x}) as {name}"

    def posexplode(self, x, pos, name):
        return f"unnest({x}) as {name}, cast(generate_subscripts({x}, 1) - 1 as int) as {pos}"

    def keep(self, x, v, cond):
        return f"list_filter({x}, lambda {v}: {cond})"

    def map(self, x, v, expr):
        return f"list_transform({x}, lambda {v}: {expr})"

    def sha256(self, x):
        return f"sha256({x})"

    def hexint(self, x):
        return f"cast('0x' || {x} as bigint)"

    def gather(self, x, order, by):
        return f"string_agg({x}, '{by}' order by {order}, {x})"

    def gather_set(self, x, by):
        return f"array_to_string(list_sort(list(distinct {x})), '{by}')"

    def idiv(self, a, b):
        return f"({a} // {b})"

    def quantile(self, x, p):
        return f"quantile_cont({x}, {p})"

    def half_even(self, x):
        return f"round_even({x}, 0)"

    def json(self, x, key):
        return f"json_extract_string({x}, '$.{key}')"

    def format_int(self, x, width):
        return f"lpad(cast({x} as varchar), cast(greatest({width}, length(cast({x} as varchar))) as int), '0')"

    def cosine(self, a, b):
        return f"coalesce(list_dot_product({a}::double[], {b}::double[]) / nullif(sqrt(list_dot_product({a}::double[], {a}::double[])) * sqrt(list_dot_product({b}::double[], {b}::double[])), 0), 0)"

    def day(self, x):
        return f"strftime({x}, '%Y-%m-%d')"

    epoch = staticmethod(lambda x: f"cast(epoch({x}) as bigint)")


SPARK, DUCK = Spark(), Duck()


def _pick_spark(self, values, at):
    return f"element_at(array({', '.join(repr(v) for v in values)}), cast({at} as int) + 1)"


def _pick_duck(self, values, at):
    return f"list_extract([{', '.join(repr(v) for v in values)}], cast({at} as int) + 1)"


Spark.pick, Duck.pick = _pick_spark, _pick_duck
