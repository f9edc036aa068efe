"""Word lists of the normaliser. Results depend on them."""

from __future__ import annotations

#: Trade forms and their short form.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co", "llc": "llc", "llp": "llp", "ltd": "ltd",
    "limited": "ltd", "pvt": "pvt", "private": "pvt", "plc": "plc", "sarl": "sarl", "sas": "sas", "sa": "sa", "eurl": "eurl", "sci": "sci",
}
LEGAL_G1 = LEGAL | {"gmbh": "gmbh", "ag": "ag", "prop": "prop", "proprietorship": "prop"}

#: Address words and their short form.
ADDRESS = {
    "road": "rd", "street": "st", "avenue": "ave", "av": "ave", "drive": "dr", "place": "pl", "terrace": "ter", "boulevard": "blvd", "bd": "blvd", "lane": "ln",
    "court": "ct", "highway": "hwy", "township": "twp", "apartment": "apt", "suite": "ste", "building": "bldg", "floor": "fl", "sector": "sec", "near": "nr",
    "opposite": "opp", "north": "n", "south": "s", "east": "e", "west": "w", "rue": "rue", "chemin": "ch", "allee": "all", "ali": "all", "impasse": "imp",
    "impase": "imp", "cours": "crs", "quai": "qua",
}
ADDRESS_G1 = {k: v for k, v in ADDRESS.items() if k not in ("chemin", "allee", "ali", "impasse", "impase", "cours", "quai")}

#: Words that mean a missing value.
MISSING = ("null", "none", "nan", "na")
MISSING_G1 = (*MISSING, "nil")

#: Regions and their codes by country.
STATES = {
    "us": {
        "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de",
        "district of columbia": "dc", "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia",
        "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn",
        "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
        "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or",
        "pennsylvania": "pa", "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut",
        "vermont": "vt", "virginia": "va", "washington": "wa", "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy",
    },
    "india": {
        "andhra pradesh": "ap", "arunachal pradesh": "ar", "assam": "as", "bihar": "br", "chhattisgarh": "cg", "chattisgarh": "cg", "goa": "ga",
        "gujarat": "gj", "haryana": "hr", "himachal pradesh": "hp", "jharkhand": "jh", "karnataka": "ka", "kerala": "kl", "madhya pradesh": "mp",
        "maharashtra": "mh", "manipur": "mn", "meghalaya": "ml", "mizoram": "mz", "nagaland": "nl", "odisha": "od", "orissa": "od", "punjab": "pb",
        "rajasthan": "rj", "sikkim": "sk", "tamil nadu": "tn", "tamilnadu": "tn", "telangana": "ts", "tripura": "tr", "uttar pradesh": "up",
        "uttarakhand": "uk", "uttaranchal": "uk", "west bengal": "wb", "andaman and nicobar islands": "an", "chandigarh": "ch",
        "dadra and nagar haveli and daman and diu": "dd", "delhi": "dl", "jammu and kashmir": "jk", "ladakh": "la", "lakshadweep": "ld",
        "puducherry": "py", "pondicherry": "py",
    },
    "france": {
        "ile de france": "idf", "auvergne rhone alpes": "ara", "nouvelle aquitaine": "naq", "occitanie": "occ", "provence alpes cote d azur": "pac",
        "hauts de france": "hdf", "pays de la loire": "pdl", "bretagne": "bre", "grand est": "ges", "normandie": "nor", "bourgogne franche comte": "bfc",
        "centre val de loire": "cvl", "corse": "cor",
    },
}

#: Spellings of one sound, applied in this order; then doubled letters become one.
PHONETIC = (("ph", "f"), ("bh", "b"), ("chh", "ch"), ("shri", "sri"), ("ee", "i"), ("oo", "u"), ("aa", "a"))
#: A web address that is nothing but a name.
DOMAIN = r"^(?:https?://)?(?:www\.)?([a-z0-9-]+)\.(?:com|net|org|biz|in|co\.in|fr)$"
ORDINAL = r"([0-9]+)(st|nd|rd|th)\b"


def fold_word(word: str) -> str:
    """The phonetic folding of one dictionary word."""
    for a, b in PHONETIC:
        word = word.replace(a, b)
    out, k = [], 0
    while k < len(word):  # one pass from left to right, as a regex replacement makes it
        out.append(word[k])
        k += 2 if word[k].isalpha() and word[k : k + 2] == word[k] * 2 else 1
    return "".join(out)


def folded(words: dict[str, str]) -> dict[str, str]:
    """A dictionary that also has the folded forms of its keys, so folded text can reach them."""
    return {fold_word(k): v for k, v in words.items()} | words
