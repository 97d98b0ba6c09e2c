"""Word lists of the normalizer. All entries are fixed values: results depend on each of them."""

# Words dropped from names.
LEGAL_WORDS = (
    "llc inc incorporated corp corporation co company ltd limited plc llp lp pc pllc pa lc ltda gmbh ag bv nv "
    "pvt private pvtltd opc public "
    "sarl sas sasu sa sci eurl snc selarl scp scm sca "
    "the ms messrs sri shri shree dr mr mrs and of et le la les de du des"
).split()

# Legal form -> class.
LEGAL_CLASSES = {
    "llc": "llc", "lc": "llc", "inc": "inc", "incorporated": "inc", "corp": "inc", "corporation": "inc",
    "co": "co", "company": "co", "ltd": "ltd", "limited": "ltd", "pvt": "pvt", "private": "pvt", "pvtltd": "pvt",
    "llp": "llp", "lp": "lp", "pc": "pc", "pllc": "pc", "pa": "pc", "plc": "plc", "public": "plc", "opc": "opc",
    "sarl": "sarl", "sas": "sas", "sasu": "sas", "sa": "sa", "sci": "sci", "eurl": "eurl", "snc": "snc",
    "selarl": "selarl", "gmbh": "gmbh",
}

# Words whose skeleton names a legal class when a long token has it.
SPOKEN_LEGAL = {"private": "pvt", "limited": "ltd", "corporation": "inc", "company": "co", "incorporated": "inc", "limitad": "ltd"}

# Digits read as letters inside words.
OCR_DIGITS, OCR_LETTERS = "0134568", "oleasgb"

# The rewrites of the phonetic skeleton, in order, then characters that map to others or go.
SKELETON_REWRITES = (
    ("x", "ks"), ("ph", "f"), ("qu", "k"), ("q", "k"), ("ck", "k"), ("sc?h", "s"), ("c(?=[eiy])", "s"), ("ch", "k"), ("c", "k"), ("([tkgbdjw])h", "$1"),
)
SKELETON_FROM, SKELETON_TO = "jgzwvdmyhaeiou", "kksbbtn"

# Address abbreviations; an empty expansion drops the token.
ADDRESS_WORDS = {
    "st": "street", "str": "street", "rd": "road", "roda": "road", "ave": "avenue", "av": "avenue", "dr": "drive",
    "ln": "lane", "ct": "court", "cir": "circle", "blvd": "boulevard", "bd": "boulevard", "hwy": "highway",
    "pkwy": "parkway", "pl": "place", "sq": "square", "trl": "trail", "ter": "terrace", "cres": "crescent",
    "mkt": "market", "ext": "extension", "north": "n", "south": "s", "east": "e", "west": "w", "northeast": "ne",
    "northwest": "nw", "southeast": "se", "southwest": "sw", "no": "", "nos": "", "apt": "", "apartment": "", "ste": "",
    "suite": "", "unit": "", "pmb": "", "fl": "floor", "flr": "floor", "bldg": "building", "nr": "near",
    "opp": "opposite", "stn": "station", "hno": "", "h": "", "plot": "", "flat": "", "shop": "", "door": "",
    "block": "blk", "blk": "blk", "po": "", "box": "", "ward": "ward",
}
FRENCH_WORDS = {
    "r": "rue", "st": "saint", "ste": "sainte", "imp": "impasse", "che": "chemin", "ch": "chemin", "rte": "route",
    "all": "allee", "fbg": "faubourg", "pl": "place", "av": "avenue", "bd": "boulevard", "sq": "square", "qu": "quai",
    "crs": "cours",
}
ADDRESS_DROPS = "null na city of cdp the de du des la le les d l et and".split()

# US states and their codes.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co",
    "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id",
    "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me",
    "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj", "new mexico": "nm",
    "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
    "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn",
    "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv",
    "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
