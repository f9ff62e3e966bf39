"""Small rule sets of our own, for the registered queries and tests. Real ones are passed in as data."""

#: Ordered keyword rules on part names: (class, keywords).
RULES = [
    ("c1", ["red plate", "blue bolt"]),
    ("c2", ["plate", "widget"]),
    ("c3", ["bolt", "gear", "c+"]),
    ("c2", ["blue"]),
    ("c4", ["red", "green"]),
]
HINTS = {"promo": "c5", "economy": "c6", "standard": "c7"}
DEFAULT = "c9"
LEVEL1 = {"c1": "t1", "c2": "t2", "c3": "t3", "c4": "t2"}
TOP_FIRST = [("t5", ["large", "big plate"]), ("t6", ["small red"])]
TOP_DEFAULT = "t4"
TOP_ORDER = ["t1", "t2", "t3", "t4", "t5", "t6", "t7"]
BRAND_TOP = {"Brand#1": "t1", "Brand#3": "t6", "Brand#12": "t7"}
#: Ordered brand prefixes of part names: (prefix, slug).
BRANDS = [("red ", "reds"), ("red plate", "never"), ("BLUE", "shout"), ("blue b", "bluebolt"), ("small", "small"), ("green", "green")]
TIER1, DEMOTED, PINNED = ["s1", "s2"], "s9", {"p7": "s3", "p20": "s5"}
PSEUDO = ("_misc", "_custom")
