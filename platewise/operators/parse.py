"""Line parsers: a page's lines become dishes.

What a line is (section, price only, name, description) is computed by column expressions, and so are the dish's name, price,
allergens and confidence from the lines that belong to it. Only what depends on the lines before runs as a fold: the merging of
continuation lines and the choice of each dish's lines. Lines are brought together by page and sorted once; both folds and the expressions
between them stream over that order (:mod:`platewise.operators.runs`), so a page of any length needs the memory of its open dishes only.

Digits and white space in patterns are ASCII digits and Unicode white space. A dish whose lines have no price has none; in ``v1`` and ``v2`` the
first number anywhere in the dish's text is its price, in ``v3`` only one at the end of the name line, or else of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from platewise.functions import lexicon as L
from platewise.operators.cleanup import bound
from platewise.operators.quantiles import exact_quantiles
from platewise.operators.runs import fold_runs, sorted_runs

KEY = ["menu_id", "page_id"]
EDGES = " -–|:"
LANES = ("full", "left", "right")


#: White space but the plain space, for a class.
_WHITE = r"\t-\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: No price at the end of a normal text is longer.
TAIL = 24
#: No word that a description begins with is longer.
HEAD = 16


def normal(text: Column, version: str = "v2") -> Column:
    """White space as single spaces; the layout parser also repairs signs that readers of images confuse."""
    text = F.coalesce(text, F.lit(""))
    if version == "v3":
        text = F.replace(F.translate(text, "@°%", "a.."), F.lit("|"), F.lit(" | "))
    # single plain spaces, which are most, match nothing
    return F.trim(F.regexp_replace(text, f" *[{_WHITE}][ {_WHITE}]*|  +", " "))


def key(text: Column) -> Column:
    """Lower-cased letters a-z, digits, & and + in words."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9&+]+", " "))


#: No key of the word lists has more signs; the warnings and ``menu`` are sought in longer ones too.
_LISTED = 24


def listed_key(text: Column) -> Column:
    """The key of a text that may be on a list, end in ``menu`` or hold a warning; empty for all others, whose keys nobody asks for."""
    low = F.lower(text)
    many = low.rlike(f"^(?:[^a-z0-9&+]*+[a-z0-9&+]){{{_LISTED + 1}}}")
    return F.when(~many | _any(low, ["menu", "foodborne", "consuming", "risk"]), key(text)).otherwise("")


PRICES = {"v1": L.PRICE_V1, "v2": L.PRICE, "v3": L.TRAILING_PRICE_V3}


def has_price(text: Column, version: str) -> Column:
    """Whether a price stands in a normal text; the costly pattern is tried only where a digit stands, in ``v3`` only on the end of the text."""
    if version != "v3":
        return text.rlike("[0-9]")
    return F.when(F.right(text, F.lit(1)).rlike("(?i)[0-9bdr€$£₹₽]"), F.right(text, F.lit(TAIL)).rlike(PRICES["v3"])).otherwise(False)


def without_price(text: Column, version: str) -> Column:
    if version != "v3":
        return F.when(has_price(text, version), F.regexp_replace(text, PRICES[version], "")).otherwise(text)
    head = F.substring(text, F.lit(1), F.length(text) - TAIL)
    return F.when(has_price(text, version), F.concat(head, F.regexp_replace(F.right(text, F.lit(TAIL)), PRICES["v3"], ""))).otherwise(text)


def clean(text: Column, version: str = "v2") -> Column:
    """A name without prices, dotted leaders and edge signs; text is normal."""
    bare = F.btrim(without_price(text, version), F.lit(EDGES))
    if version == "v1":
        return bare
    dotted = F.trim(F.regexp_replace(F.btrim(F.regexp_replace(bare, r"[.]{2,}", " "), F.lit(EDGES)), "  +", " "))
    return F.when(F.contains(bare, F.lit("..")) | F.contains(bare, F.lit("  ")), dotted).otherwise(F.trim(bare))


def word_count(text: Column) -> Column:
    return F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def upper_ratio(text: Column) -> Column:
    """Capitals among the letters."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\p{Lu}")) / F.nullif(F.regexp_count(text, F.lit(r"\p{L}")), F.lit(0)), F.lit(0.0))


def title_ratio(text: Column) -> Column:
    """Among the words with a letter, those whose first letter A-Z a-z is a capital."""
    tokens = F.filter(F.split(text, " "), lambda t: t.rlike(r"\p{L}"))
    titled = F.filter(tokens, lambda t: t.rlike("^[^A-Za-z]*[A-Z]"))
    return F.coalesce(F.size(titled) / F.nullif(F.size(tokens), F.lit(0)), F.lit(0.0))


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _starts(text: Column, words: list[str], tail: str = "") -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.startswith(w + tail)
    return out


# --- what a line is
FLAGS = ["is_section", "is_price", "is_priced", "is_desc", "is_name", "is_single", "is_weekday", "is_noise", "names_weekday", "heading"]


def _flags_v1(rows: DataFrame) -> DataFrame:
    t = F.col("line")
    named = has_price(t, "v1") | (word_count(t) <= 8)
    # a line in capitals was meant to be a section too, but the rule looks at the lower-cased text, which never is
    return _flagged(rows, is_section=F.lower(t).isin(*L.SECTION_WORDS_V1), is_name=named, heading=t)


def _flags_v2(rows: DataFrame) -> DataFrame:
    t, name = F.col("line"), clean(F.col("line"), "v2")
    rows = rows.withColumns({"w_low": F.lower("line"), "w_head": F.lower(F.left("line", F.lit(HEAD))), "w_priced": has_price(t, "v2"), "w_words": word_count(t), "w_name": name, "w_letters": F.regexp_count(name, F.lit(r"\p{L}"))})
    low, head, priced, words, name, letters = (F.col(f"w_{c}") for c in ("low", "head", "priced", "words", "name", "letters"))
    capitals = F.when(words <= 4, upper_ratio(t) > 0.65).otherwise(False)
    section = ~priced & (low.isin(*L.SECTION_WORDS) | ((words <= 4) & low.endswith("menu")) | capitals)
    describes = ~priced & ((words >= 5) | t.contains(",") | _starts(head, L.DESCRIPTION_STARTERS))
    named = ~F.lower(name).isin(*L.BAD_NAMES) & ~section & (F.length(name) >= 2) & (priced | (word_count(name) <= 8)) & (letters > 0) & (F.regexp_count(name, F.lit("[0-9]")) <= letters)
    heading = F.when(name == "", t).otherwise(name)
    return _flagged(rows, is_section=section, is_price=priced & (name == ""), is_priced=priced, is_desc=describes, is_name=named, heading=heading)


def _flags_v3(rows: DataFrame) -> DataFrame:
    t, head = F.col("line"), F.col("w_head")
    rows = rows.withColumns({"w_head": F.lower(F.left("line", F.lit(HEAD))), "w_priced": has_price(t, "v3"), "w_words": word_count(t), "w_key": listed_key(t), "w_name": clean(t, "v3")})
    other = F.col("w_name") != t
    rows = rows.withColumns({"w_name_key": F.when(other, listed_key(F.col("w_name"))).otherwise(F.col("w_key")), "w_name_words": F.when(other, word_count(F.col("w_name"))).otherwise(F.col("w_words"))})
    priced, words, k, name, name_key, name_words = (F.col(f"w_{c}") for c in ("priced", "words", "key", "name", "name_key", "name_words"))
    weekday, warning, header = k.isin(*L.WEEKDAYS), _any(k, L.WARNINGS), k.isin(*L.HEADER_NOISE)
    height = _extent("bbox_y1", "bbox_y2")
    tall = (F.col("median_h") > 0) & (height >= 1.25 * F.col("median_h"))
    middle = F.abs(_centre("bbox_x1", "bbox_x2") - F.col("page_w") / 2) <= 0.18 * F.col("page_w")
    centred = (F.col("page_w") > 0) & (_extent("bbox_x1", "bbox_x2") > 0) & (middle | (F.col("col") != "full"))
    # what costs a scan of the text is asked for short lines only
    styled = F.when(words <= 3, (title_ratio(t) >= 0.75) | (upper_ratio(t) > 0.6)).otherwise(False)
    by_shape = ~priced & (words <= 4) & centred & (tall | styled)
    section = ~weekday & ~warning & ~header & (k.isin(*L.SECTION_WORDS_V3) | (~priced & k.endswith("menu")) | by_shape)
    y = _centre("bbox_y1", "bbox_y2")
    on_top = (y != 0) & (F.col("page_h") > 0) & (y < 0.11 * F.col("page_h")) & (words <= 4) & ~priced
    describes = ~priced & ~weekday & ((words >= 7) | t.contains(",") | t.contains(";") | _starts(head, L.DESCRIPTION_STARTERS_V3, " ") | (F.left(head, F.lit(1)).rlike(r"\p{IsLowercase}") & (words >= 3)))
    able = (name != "") & ~name_key.isin(*L.BAD_NAMES) & ~weekday & ~warning
    # plain words: too many, a number, or mostly in small letters
    plain_words = F.when(name_words.between(3, 8), (title_ratio(name) < 0.45) & (upper_ratio(name) < 0.35)).otherwise(False)
    unlike = (name_words > 8) | ((name_words <= 2) & name.rlike("[0-9]")) | plain_words
    alone = (name_words == 1) & ~name_key.isin(*L.SINGLE_FOODS)
    return _flagged(
        rows, is_section=section, is_price=priced & (name == ""), is_priced=priced, is_desc=describes, is_name=able & (priced | (~unlike & ~alone)), is_single=able & ~priced & ~unlike & alone, is_weekday=weekday,
        is_noise=warning | header | on_top, names_weekday=name_key.isin(*L.WEEKDAYS), heading=F.when(name == "", t).otherwise(name),
    )


def _flagged(rows: DataFrame, **flags: Column) -> DataFrame:
    # inside a lambda: spelled out as code, so many tests make a method too large for the JVM to compile
    listed = [(F.coalesce(flags[f], F.lit(False)) if f in flags and f != "heading" else flags.get(f, F.lit(False))).alias(f) for f in FLAGS]
    return rows.withColumn("w_flags", bound(F.col("line"), lambda _: F.struct(*listed))).select("*", "w_flags.*").drop("w_flags")


def _extent(low: str, high: str) -> Column:
    """Length along one axis, 0 where an end is missing."""
    return F.when(F.col(low).isNull() | F.col(high).isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col(high) - F.col(low)))


def _centre(low: str, high: str) -> Column:
    return F.coalesce((F.col(low) + F.col(high)) / 2, F.lit(0.0))


CLASSES = {"v1": _flags_v1, "v2": _flags_v2, "v3": _flags_v3}


def classify(lines: DataFrame, version: str) -> DataFrame:
    """Add what each line is: the columns of ``FLAGS``. Lines have ``line`` (normal), for ``v3`` also boxes, ``col`` and the page's measures."""
    return CLASSES[version](lines)


# --- folds
_CHOSEN = "number int, name_text string, details array<string>, section string, lane string"


class _Dishes:
    """The dishes of one page; a dish is open in its lane from its name line until another line closes it."""

    lanes: tuple[str, ...] = ("full",)

    def __init__(self) -> None:
        self.number, self.section = 0, None
        self.names: dict[str, str] = {}
        self.details: dict[str, list[str]] = {}
        self.sections: dict[str, str] = {}
        self.unnamed: set[str] = set()  # lanes whose dish would be called like a day

    def start(self, lane: str, text: str, unnamed: bool = False) -> None:
        self.names[lane], self.details[lane] = text, []
        if unnamed:
            self.unnamed.add(lane)

    def close(self, lane: str) -> Iterator[tuple]:
        text, details = self.names.pop(lane, None), self.details.pop(lane, [])
        dropped = lane in self.unnamed
        self.unnamed.discard(lane)
        if text is not None and not dropped:
            self.number += 1
            yield self.number, text, details, self.sections.get(lane) or self.section, lane

    def end(self) -> Iterator[tuple]:
        for lane in self.lanes:
            yield from self.close(lane)


class _FoldV1(_Dishes):
    def add(self, row: tuple) -> Iterator[tuple]:
        text, lane, is_section, is_name, heading = row[0], "full", row[2], row[6], row[11]
        if is_section:
            yield from self.close(lane)
            self.section = heading
        elif lane not in self.names:
            self.start(lane, text)
        elif is_name and self.details[lane]:
            yield from self.close(lane)
            self.start(lane, text)
        else:
            self.details[lane].append(text)


class _FoldV2(_Dishes):
    def add(self, row: tuple) -> Iterator[tuple]:
        text, _, is_section, is_price, is_priced, is_desc, is_name, *_, heading = row
        lane, waiting = "full", "full" in self.names
        if is_section:
            yield from self.close(lane)
            self.section = heading
        elif is_price:
            if waiting:
                self.names[lane] += " " + text
        elif is_name and (is_priced or not waiting or not is_desc):
            yield from self.close(lane)
            self.start(lane, text)
        elif waiting and is_desc:
            self.details[lane].append(text)


class _FoldV3(_Dishes):
    """Whether a single word is a name depends on the line after it, so one line waits."""

    lanes = LANES

    def __init__(self) -> None:
        super().__init__()
        self.held: tuple | None = None

    def add(self, row: tuple) -> Iterator[tuple]:
        if self.held is not None:
            yield from self.settle(self.held, row[3])
        self.held = row

    def end(self) -> Iterator[tuple]:
        if self.held is not None:
            yield from self.settle(self.held, False)
        yield from super().end()

    def settle(self, row: tuple, price_follows: bool) -> Iterator[tuple]:
        text, lane, is_section, is_price, _, is_desc, is_name, is_single, is_weekday, is_noise, names_weekday, heading = row
        if is_noise:
            return
        if is_section and lane == "full":
            for each in self.lanes:
                yield from self.close(each)
            self.section = heading
        elif is_section:
            yield from self.close(lane)
            self.sections[lane] = heading
        elif is_weekday:
            yield from self.close(lane)
        elif is_price:
            if lane in self.names:
                self.names[lane] += " | " + text
                self.unnamed.discard(lane)
        elif lane in self.names and is_desc:
            self.details[lane].append(text)
        elif is_name or (is_single and price_follows):
            yield from self.close(lane)
            self.start(lane, text, names_weekday)
        elif lane in self.names:
            self.details[lane].append(text)


FOLDS = {"v1": _FoldV1, "v2": _FoldV2, "v3": _FoldV3}

_BOX = ["bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"]
_MEASURES = ["page_w", "page_h", "median_h"]
_MERGED = "line string, col string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double, page_w double, page_h double, median_h double"


def _span(low: float | None, high: float | None) -> tuple[float, float]:
    """Length and centre along one axis; both 0 where an end is missing."""
    return (0.0, 0.0) if low is None or high is None else (max(0.0, high - low), (low + high) / 2)


class _Merge:
    """A short, unpriced line (``bridges``) goes on with the line before it, as merged so far, in its row or close below; that becomes one line."""

    def __init__(self) -> None:
        self.open: list | None = None

    def continues(self, row: tuple) -> bool:
        (_, lane, _, y1, _, y2, *_), (_, own_lane, x1, own_y1, x2, own_y2, page_w, _, _, bridges) = self.open, row
        if not bridges or (own_lane != lane and "full" not in (own_lane, lane)):
            return False
        (tall, middle), (height, centre) = _span(y1, y2), _span(own_y1, own_y2)
        gap = 0.0 if y2 is None or own_y1 is None else own_y1 - y2
        if abs(centre - middle) > 0.7 * max(tall, height, 10.0) and gap > max(8.0, 0.45 * tall):
            return False
        aside = page_w > 0 and lane == "full" and own_lane != "full"
        return not (aside and _span(x1, x2)[1] < 0.65 * page_w)

    def add(self, row: tuple) -> Iterator[tuple]:
        if self.open is not None and self.continues(row):
            self.parts.append(row[0])
            for i, pick in zip(range(2, 6), (min, min, max, max), strict=True):
                self.open[i] = pick((x for x in (self.open[i], row[i]) if x is not None), default=None)
            return
        yield from self.end()
        self.open, self.parts = list(row[:-1]), [row[0]]

    def end(self) -> Iterator[tuple]:
        if self.open is not None:
            self.open[0] = " ".join(self.parts)
            yield tuple(self.open)
        self.open = None


# --- pages
def page_measures(rows: DataFrame) -> DataFrame:
    """Width, height and median positive line height (24 where none is known) of each page."""
    measures = rows.groupBy(*KEY).agg(F.coalesce(F.max("bbox_x2"), F.lit(0.0)).alias("page_w"), F.coalesce(F.max("bbox_y2"), F.lit(0.0)).alias("page_h"))
    height = _extent("bbox_y1", "bbox_y2")
    medians = exact_quantiles(rows.where(height > 0), KEY, height, (0.5,)).select(*KEY, F.col("quantiles")[0].alias("median_h"))
    on = [F.col(k).eqNullSafe(F.col(f"m_{k}")) for k in KEY]
    return measures.join(medians.withColumnsRenamed({k: f"m_{k}" for k in KEY}), on, "left").select(*KEY, "page_w", "page_h", F.coalesce("median_h", F.lit(24.0)).alias("median_h"))


def laid_out(lines: DataFrame) -> DataFrame:
    """Non-empty lines with the measures of their page and their column: full, left or right."""
    boxes = {c: (F.col(c) if c in lines.columns else F.lit(None)).cast("double") for c in _BOX}
    rows = lines.withColumns({**boxes, "text": F.coalesce("text", F.lit(""))}).where(F.col("text").rlike(f"[^ {_WHITE}]"))
    measures = page_measures(rows).withColumnsRenamed({k: f"p_{k}" for k in KEY})
    rows = rows.join(measures, [F.col(k).eqNullSafe(F.col(f"p_{k}")) for k in KEY])
    width, page_w = _extent("bbox_x1", "bbox_x2"), F.col("page_w")
    broad = (width >= 0.58 * page_w) | ((F.col("bbox_x1") <= 0.22 * page_w) & (F.col("bbox_x2") >= 0.78 * page_w))
    lane = F.when((page_w <= 0) | (width <= 0) | broad, "full").when(_centre("bbox_x1", "bbox_x2") < page_w / 2, "left").otherwise("right")
    return rows.select(*KEY, "line_order", normal(F.col("text"), "v3").alias("line"), lane.alias("col"), *_BOX, *_MEASURES)


def merge_continuations(lines: DataFrame) -> DataFrame:
    """Lines in reading order; a line that goes on with the one before it is part of it. The result is sorted by page, in that order."""
    t = F.col("line")
    bridges = ~has_price(t, "v3") & ((word_count(t) <= 3) | _starts(F.lower(F.left(t, F.lit(HEAD))), ["or ", "with ", "and ", "of "]))
    order = [F.coalesce("bbox_y1", F.col("line_order") * 100.0), F.coalesce("bbox_x1", F.lit(0.0)), "line_order", "line"]
    runs = sorted_runs(lines.withColumn("bridges", bridges), KEY, order)
    return fold_runs(runs, KEY, ["line", "col", *_BOX, *_MEASURES, "bridges"], _Merge, _MERGED)


def prepared(lines: DataFrame, version: str) -> DataFrame:
    """The lines as the parser sees them, sorted by page and in reading order."""
    if version == "v3":
        return merge_continuations(laid_out(lines))
    rows = lines.withColumn("line", normal(F.col("text"))).where("line <> ''").select(*KEY, "line_order", "line", F.lit("full").alias("col"))
    return sorted_runs(rows, KEY, ["line_order", "line"])


def chosen_lines(lines: DataFrame, version: str) -> DataFrame:
    """(keys, number, name_text, details, section, lane): which lines make each dish."""
    return fold_runs(classify(prepared(lines, version), version), KEY, ["line", "col", *FLAGS], FOLDS[version], _CHOSEN)


# --- dishes
def with_price(rows: DataFrame, name: str, whole: str, version: str) -> DataFrame:
    """Add value, currency and text of the price: the first number of ``whole``, in ``v3`` the last of the name line or else of ``whole``."""
    pattern, text = PRICES[version], F.col(whole)
    if version == "v3":
        text = F.when(has_price(F.col(name), version), F.col(name)).otherwise(text)
    rows = rows.withColumn("w_source", text)
    # a price at the end is sought there only
    rows = rows.withColumn("w_spot", F.when(has_price(F.col("w_source"), version), F.right("w_source", F.lit(TAIL)) if version == "v3" else F.col("w_source")))
    part = lambda i: F.nullif(F.regexp_extract("w_spot", pattern, i), F.lit(""))
    rows = rows.withColumns({"w_digits": F.replace(part(2), F.lit(","), F.lit(".")), "w_sign": F.lower(F.coalesce(part(1), part(3))), "price_text": F.trim(part(0)) if version == "v3" else part(0)})
    digits, sign, value = F.col("w_digits"), F.col("w_sign"), F.col("w_digits").cast("double")
    if version == "v3":
        # four digits without a point, last on the line or after a bar: the point was lost
        lost = ~F.contains(digits, F.lit(".")) & (value >= 1000) & (value < 10000) & (F.contains("w_source", F.lit("|")) | F.endswith("w_source", digits))
        value = F.when(lost, F.round(value / 100, 2)).otherwise(value)
        codes = F.create_map(*(F.lit(x) for pair in L.CURRENCY_CODES.items() for x in pair))
        sign = F.coalesce(codes[sign], sign)
    return rows.withColumns({"price_value": value, "price_currency": sign}).drop("w_source", "w_spot", "w_digits", "w_sign")


def allergens(text: Column, version: str) -> Column:
    """Sorted names of the allergens of which a word stands in the text."""
    listed = sorted(L.PARSED_ALLERGENS[version].items())
    return bound(F.lower(text), lambda low: F.filter(F.array(*(F.when(_any(low, words), F.lit(name)) for name, words in listed)), lambda x: x.isNotNull()))


def confidence(version: str) -> Column:
    """What is known of a dish, in steps."""
    priced, placed, described = F.col("price_value").isNotNull(), F.col("section").isNotNull(), F.col("description").isNotNull()
    if version == "v1":
        return F.when(priced, 0.62).otherwise(0.45)
    base, *steps = (0.52, 0.18, 0.12, 0.08, 0.03) if version == "v3" else (0.5, 0.2, 0.1, 0.1, 0.0)
    total = F.lit(base)
    for step, known in zip(steps, (priced, placed, described, F.col("lane") != "full"), strict=True):
        total = total + F.when(known, step).otherwise(0.0)
    return F.round(F.least(total, F.lit(0.95)), 3)


ITEM_COLUMNS = ["local_id", "dish_name", "description", "section", "price_value", "price_currency", "price_text", "explicit_allergens", "parser_confidence"]


def parse_pages(lines: DataFrame, version: str = "v2") -> DataFrame:
    """Dishes of every page by the parser ``v1``, ``v2`` or ``v3``.

    lines: menu_id, page_id, line_order, text; for ``v3`` also boxes (missing or null ones are unknown). Lines of one order stand by their text.
    """
    dishes = chosen_lines(lines, version)
    details = F.filter(F.transform("details", lambda d: clean(d, version) if version != "v3" else F.trim(F.btrim(without_price(d, "v3"), F.lit(EDGES)))), lambda d: d != "")
    described = F.nullif(F.trim(F.array_join(details, " ")), F.lit(""))
    whole = F.concat_ws(" ", F.array("name_text"), F.col("details"))
    digits = F.greatest(F.lit(4), F.length(F.col("number").cast("string")))
    dishes = dishes.withColumns({"local_id": F.concat(F.lit("item_"), F.lpad(F.col("number").cast("string"), digits, F.lit("0"))), "dish_name": clean(F.col("name_text"), version), "description": described, "whole": whole})
    dishes = with_price(dishes, "name_text", "whole", version).withColumn("explicit_allergens", allergens(F.col("whole"), version))
    return dishes.withColumn("parser_confidence", confidence(version)).select(*KEY, *ITEM_COLUMNS)


def _key(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def _similarity(a: Column, b: Column) -> Column:
    """Share of the longer key if one holds the other, else Dice of their words."""
    one, two = F.array_distinct(F.split(a, " ")), F.array_distinct(F.split(b, " "))
    dice = 2.0 * F.size(F.array_intersect(one, two)) / (F.size(one) + F.size(two))
    return F.when((a == "") | (b == ""), 0.0).when(F.contains(a, b) | F.contains(b, a), F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))).otherwise(dice)


def cascade(lines: DataFrame, roles: DataFrame) -> DataFrame:
    """Parser v2, then only dishes whose name is near a line that the role model calls a name.

    A page keeps the unfiltered dishes where filtering would lose all or too much of them, and where it has no layout.
    """
    items = parse_pages(lines, "v2").withColumn("k", _key(F.col("dish_name")))
    boxed = F.lit(False)
    for c in ("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"):
        boxed = boxed | F.col(c).isNotNull() if c in lines.columns else boxed
    layout = lines.groupBy(*(F.col(k).alias(f"l_{k}") for k in KEY)).agg(F.max(boxed).alias("layout"))
    names = roles.where("label = 'item_name' and score >= 0.35").groupBy(*(F.col(k).alias(f"n_{k}") for k in KEY)).agg(F.collect_set(_key(F.col("text"))).alias("cands"))
    same = lambda side: F.col("menu_id").eqNullSafe(F.col(f"{side}_menu_id")) & F.col("page_id").eqNullSafe(F.col(f"{side}_page_id"))
    best = F.coalesce(F.array_max(F.transform("cands", lambda c: _similarity(F.col("k"), c))), F.lit(0.0))
    scored = items.join(names, same("n"), "left").join(layout, same("l"), "left").select(items["*"], "layout", best.alias("score"))
    has_price, words = F.col("price_value").isNotNull(), F.split("k", " ")
    noise = (F.col("k") == "") | ((F.size(F.array_distinct(words)) <= 2) & F.arrays_overlap(words, F.array(*map(F.lit, L.NOISE_TOKENS))))
    kept = ~noise & ((F.col("score") >= 0.5) | ((F.col("score") >= 0.34) & has_price) | ((F.col("score") >= 0.28) & (F.size(words) <= 2) & F.col("section").isNotNull()))
    page = W.partitionBy(*KEY)
    count = lambda cond: F.sum(cond.cast("int")).over(page)
    total, left, priced, left_priced = F.count(F.lit(1)).over(page), count(kept), count(has_price), count(kept & has_price)
    few = (total >= 6) & ((left < F.greatest(F.lit(4.0), F.rint(0.65 * total))) | ((priced >= 6) & (left_priced < F.greatest(F.lit(4.0), F.rint(0.6 * priced)))))
    marked = scored.withColumns({"keep": kept, "revert": ~F.col("layout") | (left == 0) | few})
    raised = F.round(F.greatest("parser_confidence", F.least(F.col("score") + 0.2, F.lit(0.95))), 3)
    return marked.where("keep or revert").withColumn("parser_confidence", F.when(F.col("revert"), F.col("parser_confidence")).otherwise(raised)).drop("k", "layout", "score", "keep", "revert")
