"""The streamed parsers against one that reads a page from first to last line, on random pages."""

from __future__ import annotations

import random
import re
import statistics

import pytest

from platewise.functions import lexicon as L
from platewise.operators import parse

LINE = "menu_id string, page_id string, line_order int, text string, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double"
PATTERN = {v: re.compile(p) for v, p in parse.PRICES.items()}


def plain(text, version):
    text = text or ""
    if version == "v3":
        text = text.replace("@", "a").replace("°", ".").replace("%", ".").replace("|", " | ")
    return " ".join(text.split())


def bare(text, version):
    text = PATTERN[version].sub("", text).strip(parse.EDGES)
    return text if version == "v1" else " ".join(re.sub(r"[.]{2,}", " ", text).strip(parse.EDGES).split())


def key(text):
    return " ".join(re.sub(r"[^a-z0-9&+ ]+", " ", text.lower()).split())


def capitals(text):
    letters = [c for c in text if c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0.0


def titles(text):
    tokens = [re.sub("[^A-Za-z]", "", t) for t in text.split() if any(c.isalpha() for c in t)]
    return sum(t[:1].isupper() for t in tokens) / len(tokens) if tokens else 0.0


def price(name, whole, version):
    match = (PATTERN[version].search(name) if version == "v3" else None) or PATTERN[version].search(whole)
    if not match:
        return None, None
    digits, sign = match.group(2).replace(",", "."), (match.group(1) or match.group(3) or "").lower() or None
    source = name if PATTERN[version].search(name) else whole
    value = float(digits)
    if version == "v3":
        sign = L.CURRENCY_CODES.get(sign, sign)
        if "." not in digits and 1000 <= value < 10000 and ("|" in source or source.endswith(digits)):
            value = round(value / 100, 2)
    return value, sign


def dish(number, name, details, section, lane, version):
    whole = " ".join([name, *details])
    value, sign = price(name, whole, version)
    cleaned = [re.sub(r"\s+$", "", PATTERN["v3"].sub("", d).strip(parse.EDGES)) if version == "v3" else bare(d, version) for d in details]
    text = " ".join(c for c in cleaned if c).strip() or None
    low = whole.lower()
    found = sorted(a for a, words in L.PARSED_ALLERGENS[version].items() if any(w in low for w in words))
    if version == "v1":
        sure = 0.62 if value is not None else 0.45
    else:
        base, steps = (0.52, (0.18, 0.12, 0.08, 0.03)) if version == "v3" else (0.5, (0.2, 0.1, 0.1, 0))
        sure = min(0.95, base + sum(s for s, k in zip(steps, (value is not None, section is not None, text is not None, lane != "full"), strict=True) if k))
    return f"item_{number:04d}", bare(name, version), text, section, value, sign, found, round(sure, 3)


def read_v1(texts):
    section, name, details, out = None, None, [], []
    for t in texts:
        if t.lower() in L.SECTION_WORDS_V1:
            if name is not None:
                out.append((name, details, section, "full"))
            section, name, details = t, None, []
        elif name is None:
            name = t
        elif details and (PATTERN["v1"].search(t) or len(t.split()) <= 8):
            out.append((name, details, section, "full"))
            name, details = t, []
        else:
            details.append(t)
    return out + [(name, details, section, "full")] * (name is not None)


def read_v2(texts):
    section, name, details, out = None, None, [], []

    def is_section(t):
        return not PATTERN["v2"].search(t) and (t.lower() in L.SECTION_WORDS or (len(t.split()) <= 4 and (capitals(t) > 0.65 or t.lower().endswith("menu"))))

    for t in texts:
        priced, own = bool(PATTERN["v2"].search(t)), bare(t, "v2")
        describes = not priced and ("," in t or len(t.split()) >= 5 or t.lower().startswith(tuple(L.DESCRIPTION_STARTERS)))
        letters, digits = sum(c.isalpha() for c in own), sum(c.isdigit() for c in own)
        named = len(own) >= 2 and own.lower() not in L.BAD_NAMES and not is_section(t) and (priced or len(own.split()) <= 8) and letters > 0 and digits <= letters
        if is_section(t):
            if name is not None:
                out.append((name, details, section, "full"))
            section, name, details = own or t, None, []
        elif priced and not own:
            name = None if name is None else f"{name} {t}"
        elif named and (priced or name is None or not describes):
            if name is not None:
                out.append((name, details, section, "full"))
            name, details = t, []
        elif name is not None and describes:
            details.append(t)
    return out + [(name, details, section, "full")] * (name is not None)


def read_v3(rows):
    """rows: text, (x1, y1, x2, y2)."""
    priced = lambda t: bool(PATTERN["v3"].search(t))
    length = lambda a, b: 0.0 if a is None or b is None else max(0.0, b - a)
    centre = lambda a, b: 0.0 if a is None or b is None else (a + b) / 2
    rows = sorted(((t, *b, i) for i, (t, b) in enumerate(rows) if t), key=lambda r: (100.0 * r[5] if r[2] is None else r[2], r[1] or 0.0, r[5]))
    width, height = max((r[3] for r in rows if r[3] is not None), default=0.0), max((r[4] for r in rows if r[4] is not None), default=0.0)
    usual = statistics.median([length(r[2], r[4]) for r in rows if length(r[2], r[4]) > 0] or [24.0])
    lines = []
    for t, x1, y1, x2, y2, _ in rows:
        w = length(x1, x2)
        lane = "full" if width <= 0 or w <= 0 or w >= 0.58 * width or (x1 <= 0.22 * width and x2 >= 0.78 * width) else "left" if centre(x1, x2) < width / 2 else "right"
        if lines and not priced(t) and (len(t.split()) <= 3 or t.lower().startswith(("or ", "with ", "and ", "of "))):
            p = lines[-1]
            near = abs(centre(y1, y2) - centre(p[2], p[4])) <= 0.7 * max(length(p[2], p[4]), length(y1, y2), 10.0)
            gap = 0.0 if p[4] is None or y1 is None else y1 - p[4]
            if (lane == p[5] or "full" in (lane, p[5])) and (near or gap <= max(8.0, 0.45 * length(p[2], p[4]))) and not (width > 0 and p[5] == "full" and lane != "full" and centre(x1, x2) < 0.65 * width):
                both = lambda a, b, f: f((v for v in (a, b) if v is not None), default=None)
                lines[-1] = (f"{p[0]} {t}", both(p[1], x1, min), both(p[2], y1, min), both(p[3], x2, max), both(p[4], y2, max), p[5])
                continue
        lines.append((t, x1, y1, x2, y2, lane))
    out, whole_section, sections, open_ = [], None, {}, {}

    def close(lane):
        if lane in open_:
            name, details = open_.pop(lane)
            if key(bare(name, "v3")) not in L.WEEKDAYS and bare(name, "v3"):
                out.append((name, details, sections.get(lane) or whole_section, lane))

    for n, (t, x1, y1, x2, y2, lane) in enumerate(lines):
        k, words, own = key(t), len(t.split()), bare(t, "v3")
        low, y = own.lower(), centre(y1, y2)
        if k in L.HEADER_NOISE or any(w in k for w in L.WARNINGS) or (y and height > 0 and y < 0.11 * height and words <= 4 and not priced(t)):
            continue
        day = k in L.WEEKDAYS
        centred = width > 0 and length(x1, x2) > 0 and (abs(centre(x1, x2) - width / 2) <= 0.18 * width or lane != "full")
        shaped = not priced(t) and words <= 4 and centred and (length(y1, y2) >= 1.25 * usual or (words <= 3 and (titles(t) >= 0.75 or capitals(t) > 0.6)))
        if not day and (k in L.SECTION_WORDS_V3 or (k.endswith("menu") and not priced(t)) or shaped):
            for each in ("full", "left", "right") if lane == "full" else (lane,):
                close(each)
            if lane == "full":
                whole_section = own or t
            else:
                sections[lane] = own or t
            continue
        if day:
            close(lane)
            continue
        if priced(t) and not own:
            if lane in open_:
                open_[lane] = (f"{open_[lane][0]} | {t}", open_[lane][1])
            continue
        describes = not priced(t) and (words >= 7 or "," in t or ";" in t or t.lower().startswith(tuple(w + " " for w in L.DESCRIPTION_STARTERS_V3)) or (t.lower()[0].islower() and words >= 3))
        if lane in open_ and describes:
            open_[lane][1].append(t)
            continue
        size = len(own.split())
        if not own or key(own) in L.BAD_NAMES:
            named = False
        elif priced(t):
            named = True
        elif size > 8 or (size <= 2 and re.search(r"\d", own)) or (size >= 3 and titles(own) < 0.45 and capitals(own) < 0.35):
            named = False
        elif size == 1:
            after = lines[n + 1][0] if n + 1 < len(lines) else ""
            named = key(low) in L.SINGLE_FOODS or (priced(after) and not bare(after, "v3"))
        else:
            named = True
        if named:
            close(lane)
            open_[lane] = (t, [])
        elif lane in open_:
            open_[lane][1].append(t)
    for lane in ("full", "left", "right"):
        close(lane)
    return out


def expected(page, version):
    rows = [(plain(t, version), b) for t, b in page]
    chosen = read_v3(rows) if version == "v3" else (read_v1 if version == "v1" else read_v2)([t for t, _ in rows if t])
    return [dish(i + 1, *c, version) for i, c in enumerate(chosen)]


def parsed(spark, pages, version):
    rows = [(f"m{m}", f"p{m % 3}", i, t, *b) for m, page in enumerate(pages) for i, (t, b) in enumerate(page)]
    got = {}
    for r in sorted(parse.parse_pages(spark.createDataFrame(rows, LINE).repartition(5), version).collect(), key=lambda r: r.local_id):
        got.setdefault(r.menu_id, []).append((r.local_id, r.dish_name, r.description, r.section, r.price_value, r.price_currency, list(r.explicit_allergens), r.parser_confidence))
    return got


PIECES = [
    "Tomato Soup", "GRILLED", "chicken", "with cream", "and rice", "Friday", "Sunday:", "sides", "STARTERS", "Lunch Menu", "menu", "Primo", "12.50", "1250", "₹ 90", "28 usd", "€9,5", "served", "smoked tomatoes", "gelato", "Brownie",
    "Total", "page 3", "consuming raw", "risk of", "Gre@n", "25°", "|", "...", "cod, lemon; butter", "Café", "éclair", "pine nuts", "Wings", "of the day", "100000", "-", "Soups:", "main course", "Main Course", "x", "7",
]


def random_page(rng):
    page = []
    for i in range(rng.randint(0, 25)):
        text = rng.choice([None, "", " "]) if rng.random() < 0.05 else " ".join(rng.choices(PIECES, k=rng.choice([1, 1, 1, 2, 2, 3, 4])))
        x, y, w, h = rng.uniform(0, 600), 22.0 * i + rng.uniform(-3, 3), rng.choice([40, 200, 500, 900]), rng.choice([10, 12, 14, 20])
        box = (None,) * 4 if rng.random() < 0.1 else (x, y, x + w, y + h)
        page.append((text, box))
    return page


@pytest.mark.parametrize("version", ["v1", "v2", "v3"])
def test_random_pages(spark, version):
    rng = random.Random(version)
    pages = [random_page(rng) for _ in range(250)]
    got = parsed(spark, pages, version)
    for m, page in enumerate(pages):
        assert got.get(f"m{m}", []) == expected(page, version), page


def lines(*texts):
    return [(t, (10.0, 200.0 + 30 * i, 800.0, 212.0 + 30 * i)) for i, t in enumerate(texts)]


def test_words_prices_and_signs_of_the_layout_parser(spark):
    got = parsed(spark, [
        lines("sides", "Green Salad 120"), lines("Green Salad 120", "smoked tomatoes"), lines("Green Salad 1250"), lines("Green Salad ₹ 90"), lines("Gre@n Salad 9"), lines("Soups:", "Leek and Potato 7", "Consuming raw leek is a risk of yours"),
        lines("Creamy Cod Pasta 14", "topped with pine nuts, mayo"),
    ], "v3")
    first = {m: rows[0] for m, rows in got.items()}
    assert {m: len(r) for m, r in got.items()} == dict.fromkeys([f"m{i}" for i in range(7)], 1)
    assert first["m0"][1:5] == ("Green Salad", None, "sides", 120.0)
    assert first["m1"][1:3] == ("Green Salad", "smoked tomatoes")
    assert first["m2"][4] == 12.5 and first["m3"][4:6] == (90.0, "inr") and first["m4"][1] == "Grean Salad"
    assert first["m5"][3] == "Soups" and first["m6"][6] == ["egg", "fish", "milk", "tree_nuts", "wheat"]


def test_one_page_of_many_lines(spark):
    texts = [f"Dish Number {'abcdefgh'[i % 8]} {i % 90 + 10}.50" if i % 3 == 0 else "with cream, butter and bread" for i in range(60_000)]
    rows = spark.createDataFrame([("m", "p", i, t) for i, t in enumerate(texts)], "menu_id string, page_id string, line_order int, text string")
    out = parse.parse_pages(rows.repartition(8), "v2")
    assert out.count() == 20_000
    assert out.where("local_id = 'item_20000' and price_value is not null and description is not null").count() == 1
