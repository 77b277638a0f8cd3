"""Word lists, lookup tables and constants of the linkage rules.

Fixed values: results depend on each of them.
"""

# Tokens that say what a firm is in law or trade and not which one it is.
LEGAL_TOKENS = (
    "agencies agency associates bros cie co com company consulting corp corporation enterprise enterprises etablissements ets eurl fr france gie "
    "group holdings inc incorporated industries international limirrd limite limited limitet limitid limrd llc llp ltd net org partners plc praibhet "
    "praim praivat praivet private pvt sa sarl sas sasu sci scop service services snc societe solutions sons store stores tech technologies traders "
    "trading www"
).split()
# The same for the first generation, which also drops filler words.
LEGAL_TOKENS_G1 = (
    "agencies agency and associates cie co company consulting corp corporation cos enterprise enterprises etablissements ets eurl for fr france gie "
    "group holdings inc incorporated india industries international internationl intl limited llc llp ltd of plc private pvt sa sarl sas sasu sci "
    "scop services snc societe solutions sons store stores tech technologies the traders trading us usa"
).split()
# Words of an address that tell nothing.
ADDR_STOP = (
    "adj adjacent allee at au aux ave avenue behind beside bldg block bp building cedex chemin chez city code colony complex cross de des dist "
    "district du enclave et flat floor france gala highway house india la lane layout le les ln main nagar near opp opposite phase pin po post quai rd "
    "road room route rue sec sector shop st state street sur taluk tehsil us usa vihar zip"
).split()
# The same for the first generation.
ADDR_STOP_G1 = (
    "adj adjacent allee and area at ave avenue behind beside bldg block bp building cedex chemin city code colony complex cross dist district "
    "enclave flat floor flr flt france gala highway house india lane layout ln main nagar near next no opp opposite phase pin po post quai rd road "
    "room route rue sec sector shop st state street taluk tehsil the to us usa vihar zip"
).split()
# What the final step drops from street names.
STREET_STOP = (
    "adj adjacent allee alpes apt aquitaine at au auvergne aux ave avenue bat batiment bd behind beside bldg block blvd bordeaux boulevard bp bretagne "
    "building cedex chemin chez city code colony complex cote cours court cross crs ct d dazur de des dist district dr drive du enclave est et flat floor "
    "france gala grand hauts highway house ile imp impasse india l la lane layout le les lille ln lyon main marseille nagar nantes near normandie nouvelle "
    "occitanie opp opposite paris passage phase pin pl place po post provence quai rd residence rhone road room route rue sec sector shop sq square st "
    "state ste strasbourg street suite sur taluk tehsil toulouse us usa vihar zip"
).split()
# Abbreviations in addresses, applied once to each token.
ADDR_ABBREV = {
    "all": "allee", "apt": "apartment", "av": "avenue", "ave": "avenue", "avenu": "avenue", "bd": "boulevard", "bldg": "building", "blvd": "boulevard",
    "br": "branch", "chem": "chemin", "chowk": "chowk", "ct": "court", "dr": "drive", "flt": "flat", "gde": "grande", "gnd": "ground", "hse": "house",
    "hwy": "highway", "imp": "impasse", "mgr": "marg", "no": "number", "num": "number", "ph": "phase", "pl": "place", "quai": "quay", "r": "rue",
    "rd": "road", "rte": "route", "rue": "street", "sec": "sector", "sect": "sector", "soc": "society", "sq": "square", "st": "street", "ste": "suite",
    "ter": "terrace", "xing": "crossing",
}
# The same for the first generation.
ADDR_ABBREV_G1 = {
    "all": "allee", "apt": "apartment", "av": "avenue", "ave": "avenue", "avenu": "avenue", "bd": "boulevard", "bldg": "building", "blvd": "boulevard",
    "br": "branch", "chem": "chemin", "chowk": "chowk", "ct": "court", "dr": "drive", "flt": "flat", "gnd": "ground", "hse": "house", "hwy": "highway",
    "imp": "impasse", "mgr": "marg", "no": "number", "num": "number", "ph": "phase", "pl": "place", "quai": "quay", "rd": "road", "rte": "route",
    "rue": "street", "sec": "sector", "sect": "sector", "soc": "society", "sq": "square", "st": "street", "ste": "suite", "ter": "terrace",
    "xing": "crossing", "blv": "boulevard", "cir": "circle", "drv": "drive", "ln": "lane", "pkwy": "parkway", "plz": "plaza",
}

# Latin letters for signs at these places of each Brahmic block.
BRAHMIC_OFFSETS = {
    0x01: "n", 0x02: "n", 0x03: "h", 0x05: "a", 0x06: "a", 0x07: "i", 0x08: "i", 0x09: "u", 0x0A: "u", 0x0B: "ri", 0x0E: "e", 0x0F: "e", 0x10: "ai",
    0x11: "o", 0x12: "o", 0x13: "o", 0x14: "au", 0x15: "k", 0x16: "kh", 0x17: "g", 0x18: "gh", 0x19: "ng", 0x1A: "ch", 0x1B: "chh", 0x1C: "j",
    0x1D: "jh", 0x1E: "ny", 0x1F: "t", 0x20: "th", 0x21: "d", 0x22: "dh", 0x23: "n", 0x24: "t", 0x25: "th", 0x26: "d", 0x27: "dh", 0x28: "n",
    0x2A: "p", 0x2B: "ph", 0x2C: "b", 0x2D: "bh", 0x2E: "m", 0x2F: "y", 0x30: "r", 0x31: "r", 0x32: "l", 0x33: "l", 0x34: "l", 0x35: "v",
    0x36: "sh", 0x37: "sh", 0x38: "s", 0x39: "h", 0x3E: "a", 0x3F: "i", 0x40: "i", 0x41: "u", 0x42: "u", 0x43: "ri", 0x46: "e", 0x47: "e",
    0x48: "ai", 0x49: "o", 0x4A: "o", 0x4B: "o", 0x4C: "au", 0x4D: "", 0x58: "q", 0x59: "kh", 0x5A: "gh", 0x5B: "z", 0x5C: "d", 0x5D: "dh",
    0x5E: "f", 0x5F: "y",
}
#: First and last block, and where each block's own digits begin.
BRAHMIC_BLOCKS, BRAHMIC_DIGITS = (0x0900, 0x0D00), 0x66

# Weight of a shared key by type, and the most postings a key may have; 3000 where none is named.
KEY_WEIGHTS = {"nn": 1.6, "n": 1.0, "s": 1.5, "nf": 1.3, "p": 1.2, "pf": 1.2, "a": 0.9, "c8": 1.3, "cs8": 1.2, "g4n": 0.7, "g4a": 0.6, "mh": 0.8}
KEY_CAPS = {"a": 600, "g4a": 600}
MOST_POSTINGS = 3000

# Retrieval variants: candidates by key score, weights of name, address and key score, score of an empty address, candidates kept.
VARIANTS = {
    "v4base": (600, 0.35, 0.45, 0.20, None, 40),
    "n1": (600, 0.35, 0.45, 0.20, 0.55, 40),
    "n2": (600, 0.45, 0.35, 0.20, 0.55, 40),
    "n3": (600, 0.55, 0.25, 0.20, 0.55, 40),
    "n4": (600, 0.35, 0.55, 0.10, 0.55, 40),
    "n5": (600, 0.45, 0.45, 0.10, 0.55, 40),
    "x1": (1200, 0.35, 0.55, 0.10, 0.55, 50),
    "x2": (1200, 0.35, 0.55, 0.10, 0.55, 40),
}
# The decision rules in use: country, variant, model, threshold, least best probability.
RULES = (("france", "x2", "m1", 0.62, 0.78), ("india", "x1", "m1", 0.62, 0.62), ("us", "x2", "m1", 0.62, 0.78))
#: The rule for any other country.
DEFAULT_RULE = ("x2", "m1", 0.62, 0.78)
# The side of a record's holdout split, and the thresholds that calibration tries.
HOLDOUT = (960, 1000)
GRID = tuple(round(0.30 + 0.04 * i, 2) for i in range(16))
