"""Fixed values of the menu domain: they must equal the published ones for right results."""

from __future__ import annotations

# Ingredients and the keywords that give them away, tested as raw substrings.
INGREDIENT_KEYWORDS = {
    "chicken": ["chicken"],
    "beef": ["beef", "steak", "burger patty"],
    "pork": ["pork", "bacon", "ham", "salami"],
    "lamb": ["lamb", "mutton"],
    "fish": ["fish", "salmon", "tuna", "cod", "grouper", "trout", "snapper"],
    "shellfish": ["shrimp", "prawn", "crab", "lobster", "calamari", "mussels", "oyster"],
    "egg": ["egg", "eggs", "omelet", "omelette", "mayo", "mayonnaise", "aioli"],
    "milk": ["milk", "cream", "cheese", "cheddar", "mozzarella", "parmesan", "butter", "paneer", "yogurt", "curd"],
    "wheat": ["wheat", "bread", "bun", "toast", "pasta", "noodles", "pizza", "naan", "roti", "flour", "crouton", "sandwich", "wrap", "burger"],
    "rice": ["rice", "biryani", "pilaf", "pulao"],
    "potato": ["potato", "fries", "chips"],
    "tomato": ["tomato", "marinara", "arrabbiata"],
    "mushroom": ["mushroom"],
    "spinach": ["spinach"],
    "corn": ["corn"],
    "peanut": ["peanut", "groundnut"],
    "tree_nuts": ["almond", "walnut", "cashew", "hazelnut", "pistachio", "pecan"],
    "soy": ["soy", "soy sauce", "tofu", "teriyaki"],
    "sesame": ["sesame", "tahini"],
    "chocolate": ["chocolate", "cocoa", "brownie"],
    "sugar": ["sugar", "caramel", "dessert", "ice cream", "cake", "pastry"],
}
# Ingredients that are allergens of the same name, and the groups behind diet flags.
ALLERGENS = ["milk", "egg", "fish", "shellfish", "peanut", "tree_nuts", "soy", "sesame", "wheat"]
MEAT = ["chicken", "beef", "pork", "lamb"]
SEAFOOD = ["fish", "shellfish"]
ANIMAL = ["chicken", "beef", "pork", "lamb", "fish", "shellfish", "egg", "milk"]
GLUTEN = ["wheat"]
# Calorie ranges (low, mid, high) by keyword, the first match counts.
CATEGORY_RULES = [
    (("salad",), (180, 300, 460)),
    (("soup",), (120, 210, 330)),
    (("sandwich", "burger", "wrap"), (340, 520, 760)),
    (("pizza",), (480, 720, 980)),
    (("pasta", "noodles"), (360, 540, 780)),
    (("rice", "biryani", "pulao", "pilaf"), (340, 520, 760)),
    (("dessert", "cake", "brownie", "ice cream", "gelato"), (240, 380, 620)),
    (("coffee", "tea", "juice", "shake", "smoothie", "drink", "cocktail"), (40, 120, 260)),
    (("seafood", "fish", "steak", "grill"), (260, 430, 700)),
]
# Ranges by the section alone, where no keyword stands in the text, and what words of the text add.
SECTION_RANGES = [(("dessert",), (240, 380, 620)), (("drink", "coffee", "tea"), (40, 120, 260))]
TEXT_MODIFIERS = [(("fried", "crispy"), (60, 100, 160)), (("double", "loaded"), (80, 130, 200)), (("mini", "small"), (-40, -50, -60))]
DEFAULT_RANGE = (220, 360, 560)
# What an ingredient adds to (low, mid, high).
CALORIE_ADJUSTMENTS = {
    "milk": (40, 70, 110),
    "egg": (45, 75, 110),
    "wheat": (60, 100, 140),
    "rice": (70, 120, 170),
    "potato": (60, 100, 140),
    "peanut": (60, 95, 140),
    "tree_nuts": (60, 95, 140),
    "beef": (85, 130, 200),
    "pork": (85, 125, 190),
    "lamb": (85, 135, 200),
    "chicken": (70, 110, 165),
    "fish": (60, 100, 150),
    "shellfish": (60, 95, 145),
    "chocolate": (70, 110, 170),
    "sugar": (60, 100, 170),
}
# Markers and risk tokens of the diet flags.
DIET_MARKERS = {
    "vegetarian": ["vegetarian", "veggie"],
    "vegan": ["vegan", "plant-based", "plant based"],
    "gluten_free": ["gluten free", "gluten-free", "gf"],
    "dairy_free": ["dairy free", "dairy-free", "lactose free", "lactose-free"],
}
GLUTEN_RISK = ["bread", "bun", "toast", "pasta", "noodles", "pizza", "naan", "roti", "flour", "crouton", "sandwich", "wrap", "burger", "cake", "brownie", "pastry"]
DAIRY_RISK = ["milk", "cream", "cheese", "cheddar", "mozzarella", "parmesan", "butter", "paneer", "yogurt", "curd"]
# Kcal in 100 g and grams in a serving.
NUTRITION = {
    "chicken": (165.0, 90.0), "beef": (250.0, 100.0), "pork": (242.0, 90.0), "lamb": (294.0, 90.0), "fish": (208.0, 110.0),
    "shellfish": (99.0, 80.0), "egg": (155.0, 50.0), "milk": (260.0, 35.0), "wheat": (320.0, 70.0), "rice": (130.0, 120.0),
    "potato": (77.0, 100.0), "tomato": (18.0, 40.0), "mushroom": (22.0, 50.0), "spinach": (23.0, 40.0), "corn": (96.0, 50.0),
    "peanut": (567.0, 20.0), "tree_nuts": (607.0, 20.0), "soy": (144.0, 45.0), "sesame": (573.0, 12.0), "chocolate": (546.0, 35.0), "sugar": (387.0, 25.0),
}
# Words of section lines and words that are no dish names.
SECTION_WORDS = [
    "appetizers", "starters", "salads", "soups", "mains", "main course", "desserts", "drinks", "beverages", "cocktails", "mocktails", "pizza",
    "pasta", "rice", "biryani", "whisky", "whiskey", "rum", "vodka", "gin", "beer", "wine", "brandy", "tequila", "liqueur", "shakes",
    "falooda", "coffee", "tea", "juices", "continental", "indian", "punjabi", "chinese", "south indian", "veg", "non veg",
]
BAD_NAMES = ["page", "total", "rate", "price", "menu", "restaurant", "hotel", "tax", "gst", "service charge", "mrp"]
NOISE_TOKENS = ["tax", "taxes", "menu", "total", "gst", "service", "charge", "hotel", "restaurant", "mrp"]
HEADER_NOISE = ["primo", "steak & seafood", "steak and seafood", "menu"]
WEEKDAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
# How a description starts.
DESCRIPTION_STARTERS = ["with", "served", "fresh", "crispy", "grilled", "roasted", "topped", "mixed"]
# The price pattern of text lines and the price-only pattern of the role features.
PRICE = r"(?i)([€$£₹₽])?\s*(\d{1,5}(?:[.,]\d{1,2})?)\s*(rub|usd|eur|inr|€|\$|£|₹|₽)?"
PRICE_ONLY = r"(?i)^\s*[€$£₹₽]?\s*\d{1,5}(?:[.,]\d{1,2})?\s*(?:rub|usd|eur|inr|€|\$|£|₹|₽)?\s*$"
TRAILING_PRICE = r"(?i)([€$£₹₽])?\s*(\d{1,5}(?:[.,]\d{1,2})?)\s*(rub|usd|eur|inr|€|\$|£|₹|₽)?\s*$"
# The first parser's section words, price pattern and allergens.
SECTION_WORDS_V1 = ["salads", "soups", "desserts", "pizza", "pasta", "drinks", "tea", "coffee", "starters", "mains", "burgers", "rolls", "sushi", "breakfast", "main course"]
PRICE_V1 = r"(?i)([€$₽₹£])?\s?(\d{1,5}(?:[.,]\d{1,2})?)\s?(rub|usd|eur|inr)?"
# What the layout parser adds to the lists above, and names of one word that are dishes.
SECTION_WORDS_V3 = [*SECTION_WORDS, "sides", "sandwiches", "specials", "entrees", "burgers", "steaks", "seafood", "dessert", "classic sandwiches", "primo specials"]
DESCRIPTION_STARTERS_V3 = [*DESCRIPTION_STARTERS, "includes", "choice", "slow", "juicy", "tender", "field", "baked", "hand", "crunchy", "creamy", "maple", "house", "smoked"]
SINGLE_FOODS = ["gelato", "cheesecake", "brownie", "spinach", "asparagus", "corn", "pilaf", "fries", "salad"]
WARNINGS = ["foodborne illness", "consuming raw", "risk of"]
TRAILING_PRICE_V3 = r"(?i)(?:\||:)?\s*([€$£₹₽])?\s*(\d{1,5}(?:[.,]\d{1,2})?)\s*(rub|usd|eur|inr|€|\$|£|₹|₽)?\s*$"
CURRENCY_CODES = {"$": "usd", "€": "eur", "£": "gbp", "₹": "inr", "₽": "rub"}
# Words in a dish's text that name an allergen, for each of the three parsers.
PARSED_ALLERGENS = {
    "v1": {
        "milk": ["milk", "cream", "cheese", "butter"], "egg": ["egg", "eggs"], "fish": ["fish", "salmon", "tuna"], "shellfish": ["shrimp", "prawn", "crab", "lobster"],
        "tree_nuts": ["almond", "walnut", "cashew", "hazelnut"], "peanut": ["peanut"], "wheat": ["wheat", "flour", "bread"], "soy": ["soy", "soybean"], "sesame": ["sesame", "tahini"],
    },
    "v2": {
        "milk": ["milk", "cream", "cheese", "butter", "mozzarella", "parmesan", "cheddar"], "egg": ["egg", "eggs", "aioli", "mayonnaise"], "fish": ["fish", "salmon", "tuna", "cod"],
        "shellfish": ["shrimp", "prawn", "crab", "lobster", "mussels", "calamari"], "tree_nuts": ["almond", "walnut", "cashew", "hazelnut", "pistachio", "pine nuts"], "peanut": ["peanut", "peanuts"],
        "wheat": ["wheat", "flour", "bread", "bun", "pasta", "pizza dough"], "soy": ["soy", "soybean", "soy sauce", "teriyaki"], "sesame": ["sesame", "tahini"],
    },
    "v3": {
        "milk": ["milk", "cream", "cheese", "butter", "mozzarella", "parmesan", "cheddar", "gouda", "bechamel", "fudge", "gelato"], "egg": ["egg", "eggs", "aioli", "mayonnaise", "mayo", "meringue", "brulee"],
        "fish": ["fish", "salmon", "tuna", "cod", "grouper", "walleye", "snapper", "trout", "tilapia"], "shellfish": ["shrimp", "prawn", "crab", "lobster", "mussels", "calamari", "scallop", "oyster"],
        "tree_nuts": ["almond", "walnut", "cashew", "hazelnut", "pistachio", "pine nuts", "pecan"], "peanut": ["peanut", "peanuts"], "wheat": ["wheat", "flour", "bread", "bun", "pasta", "pizza dough", "croutons", "fries"],
        "soy": ["soy", "soybean", "soy sauce", "teriyaki"], "sesame": ["sesame", "tahini"],
    },
}
