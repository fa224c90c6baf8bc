"""Word lists, tables and thresholds that results depend on."""

# Latin forms by offset in a script block of 128 code points; the nine blocks begin at U+0900, U+0980, .. U+0D00.
INDIC_FIRST, INDIC_LAST, INDIC_BLOCK = 0x0900, 0x0D7F, 0x80
INDIC_LATIN = {
    0x02: "n", 0x03: "h", 0x05: "a", 0x06: "aa", 0x07: "i", 0x08: "ii", 0x09: "u", 0x0A: "uu", 0x0B: "r", 0x0E: "e", 0x0F: "e",
    0x10: "ai", 0x12: "o", 0x13: "o", 0x14: "au", 0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh",
    0x1C: "j", 0x1D: "jh", 0x1E: "ny", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d",
    0x27: "dh", 0x28: "n", 0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l",
    0x33: "l", 0x35: "v", 0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x3E: "aa", 0x3F: "i", 0x40: "ii", 0x41: "u", 0x42: "uu",
    0x43: "r", 0x46: "e", 0x47: "e", 0x48: "ai", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x4D: "",
}

# Abbreviations in names.
NAME_ABBREVIATIONS = {
    "corp": "corporation", "ltd": "limited", "pvt": "private", "inc": "incorporated", "llp": "llp", "llc": "llc", "co": "company",
    "cos": "companies", "bros": "brothers", "assoc": "associates", "assocs": "associates", "intl": "international", "natl": "national",
    "mfg": "manufacturing", "mgmt": "management", "mgt": "management", "svcs": "services", "svc": "service", "grp": "group",
    "dept": "department", "assn": "association", "soln": "solutions", "solns": "solutions", "tech": "technologies", "sys": "systems",
    "dev": "development", "ent": "enterprises", "ind": "industries", "prop": "properties", "props": "properties",
    "comm": "communications", "comms": "communications", "hldg": "holdings", "hldgs": "holdings", "inv": "investments",
    "invst": "investments", "ctr": "center", "cntr": "center", "soc": "society", "mkt": "marketing", "univ": "university",
    "hosp": "hospital", "ins": "insurance", "fin": "financial", "bldg": "building", "mgr": "manager", "govt": "government",
    "engg": "engineering",
}

# Abbreviations in addresses.
ADDRESS_ABBREVIATIONS = {
    "rd": "road", "st": "street", "ave": "avenue", "blvd": "boulevard", "dr": "drive", "ct": "court", "pl": "place", "ln": "lane",
    "hwy": "highway", "pkwy": "parkway", "apt": "apartment", "ste": "suite", "fl": "floor", "flr": "floor", "bldg": "building",
    "n": "north", "s": "south", "e": "east", "w": "west", "nw": "northwest", "ne": "northeast", "sw": "southwest", "se": "southeast",
    "sq": "square", "cir": "circle", "snt": "saint", "hts": "heights", "vlg": "village", "twp": "township", "blk": "block",
    "no": "number", "num": "number", "opp": "opposite",
}

# Words left out of name features, of the pooled token index, and of the multi-channel index.
FEATURE_STOPWORDS = "the a an of and or in at for to by with is are was be near no po box".split()
TOKEN_STOPWORDS = (
    "inc incorporated llc ltd limited corp corporation co company services dba center the and india usa road street avenue boulevard "
    "drive lane floor suite unit"
).split()
CHANNEL_STOPWORDS = [*TOKEN_STOPWORDS, "pmb", "pvt", "private"]

# Spellings by sound and what they stand for.
PHONETIC = {
    "praaivet": "private", "praaibhet": "private", "prvt": "private", "phaainyaans": "finance", "phaainans": "finance",
    "knstrkshn": "construction", "aannd": "anand", "sevn": "seven", "blu": "blue", "trdg": "trading", "pshchimbngg": "west bengal",
    "krnaatk": "karnataka", "mhaaraashtr": "maharashtra", "hriyaanaa": "haryana",
}

# Weights, thresholds and sizes.
COMPACT_WEIGHT, NUMBER_WEIGHT, NAME_WEIGHT, ADDRESS_WEIGHT = 30.0, 15.0, 2.5, 1.2
COMPACT_LEAST, MATCH_THRESHOLD, BOOST, BASELINE_THRESHOLD = 5, 74.0, 85.0, 80.0
