"""Word lists and codes of the normaliser."""

from __future__ import annotations

import unicodedata

# Results depend on them as they stand.
LEGAL = {
    "pvt": "pvt", "private": "pvt", "pvtltd": "pvt", "prvt": "pvt", "praivet": "pvt", "praivett": "pvt", "piraivet": "pvt", "prv": "pvt", "pra": "pvt",
    "ltd": "ltd", "limited": "ltd", "limitd": "ltd", "limitet": "ltd", "lmtd": "ltd", "limittedd": "ltd", "li": "ltd",
    "llp": "llp", "llc": "llc", "lc": "llc", "lp": "llp",
    "inc": "inc", "incorporated": "inc", "incorp": "inc",
    "corp": "corp", "corporation": "corp", "corporated": "corp",
    "co": "co", "company": "co", "cie": "co",
    "sa": "sa", "sas": "sas", "sarl": "sarl", "sasu": "sas", "eurl": "sarl", "sci": "sci",
    "gmbh": "gmbh", "bv": "bv", "nv": "nv", "plc": "plc", "ag": "ag",
}
STOP_NAME = ["the", "ms", "mr", "mrs", "smt", "shri", "sri", "sh", "la", "le", "les", "de", "du", "des", "et", "and", "of", "for"]
ADDRESS = {
    "road": "rd", "rd": "rd", "street": "st", "st": "st", "avenue": "ave", "av": "ave", "ave": "ave", "drive": "dr", "dr": "dr", "lane": "ln", "ln": "ln",
    "court": "ct", "ct": "ct", "circle": "cir", "cir": "cir", "boulevard": "blvd", "blvd": "blvd", "highway": "hwy", "hwy": "hwy", "place": "pl", "pl": "pl",
    "parkway": "pkwy", "pkwy": "pkwy", "terrace": "ter", "ter": "ter", "square": "sq", "sq": "sq", "trail": "trl", "trl": "trl", "way": "way",
    "suite": "ste", "ste": "ste", "apartment": "apt", "apt": "apt", "unit": "unit", "floor": "flr", "flr": "flr", "building": "bldg", "bldg": "bldg",
    "block": "blk", "blk": "blk", "sector": "sec", "sec": "sec", "village": "vil", "vil": "vil", "vill": "vil", "township": "twp", "twp": "twp",
    "north": "n", "south": "s", "east": "e", "west": "w",
}
STATES = {
    "maharashtra": "mh", "mhaarastr": "mh", "mh": "mh", "karnataka": "ka", "krnaatk": "ka", "ka": "ka", "krnatk": "ka",
    "tamilnadu": "tn", "tmilnaadu": "tn", "tn": "tn", "tamiznaatu": "tn", "telangana": "tg", "telnganaa": "tg", "tg": "tg", "telngaana": "tg",
    "andhrapradesh": "ap", "ap": "ap", "aandhrprdes": "ap", "gujarat": "gj", "gujraat": "gj", "gj": "gj",
    "westbengal": "wb", "wb": "wb", "pshcimbng": "wb", "pscimbng": "wb", "delhi": "dl", "dl": "dl", "newdelhi": "dl", "dili": "dl",
    "uttarpradesh": "up", "up": "up", "utrprdes": "up", "rajasthan": "rj", "rj": "rj", "raajsthaan": "rj",
    "madhyapradesh": "mp", "mp": "mp", "mdhyprdes": "mp", "kerala": "kl", "kl": "kl", "kerl": "kl",
    "punjab": "pb", "pb": "pb", "haryana": "hr", "hr": "hr", "bihar": "br", "br": "br", "odisha": "od", "od": "od", "orissa": "od",
    "assam": "as", "as": "as", "jharkhand": "jh", "jh": "jh", "chhattisgarh": "cg", "cg": "cg", "uttarakhand": "uk", "uk": "uk",
    "himachalpradesh": "hp", "hp": "hp", "jammu": "jk", "jk": "jk", "chandigarh": "ch", "puducherry": "py", "py": "py",
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct_us", "delaware": "de",
    "florida": "fl", "georgia": "ga", "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky",
    "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma", "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo",
    "montana": "mt", "nebraska": "ne", "nevada": "nv", "newhampshire": "nh", "newjersey": "nj", "newmexico": "nm", "newyork": "ny", "northcarolina": "nc",
    "northdakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa", "rhodeisland": "ri", "southcarolina": "sc",
    "southdakota": "sd", "tennessee": "tn_us", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa", "westvirginia": "wv",
    "wisconsin": "wi", "wyoming": "wy",
}
LANDMARKS = ["near", "opp", "opposite", "behind", "beside", "next", "above", "below", "infront"]
COUNTRY_ID = {"US": 0, "India": 1, "France": 2}
US_CODES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
INDIA_STATES = [
    "andhra pradesh", "arunachal pradesh", "assam", "bihar", "chhattisgarh", "goa", "gujarat", "haryana", "himachal pradesh", "jharkhand", "karnataka",
    "kerala", "madhya pradesh", "maharashtra", "manipur", "meghalaya", "mizoram", "nagaland", "odisha", "orissa", "punjab", "rajasthan", "sikkim",
    "tamil nadu", "telangana", "tripura", "uttar pradesh", "uttarakhand", "west bengal", "delhi", "jammu & kashmir", "jammu and kashmir", "ladakh",
    "puducherry", "pondicherry", "chandigarh", "andaman & nicobar islands", "lakshadweep", "dadra & nagar haveli", "daman & diu",
    "dadra and nagar haveli and daman and diu",
]
INDIC_SCRIPTS = ["Devanagari", "Tamil", "Telugu", "Kannada", "Gujarati", "Bengali", "Gurmukhi", "Malayalam", "Oriya"]

LEGAL_BIT = {v: 1 << i for i, v in enumerate(sorted(set(LEGAL.values())))}
#: Letters that NFKD does not take apart, and their usual spellings.
EXPANSIONS = {"ß": "ss", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
_SINGLE = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "ħ": "h", "Ħ": "H", "ŧ": "t", "Ŧ": "T"}


def latin_pairs() -> tuple[str, str]:
    """Accented Latin letters of U+00C0-U+024F and the ASCII letters they are built on, in two equal strings."""
    out = dict(_SINGLE)
    for code in range(0xC0, 0x250):
        base = unicodedata.normalize("NFKD", chr(code))[0]
        if base.isascii() and base.isalpha():
            out[chr(code)] = base
    return "".join(out), "".join(out.values())


#: The Brahmic blocks from U+0900 on share one layout: consonants, vowels, vowel signs and digits by their place in it.
BRAHMIC = [0x900 + 0x80 * i for i in range(9)]
CONSONANTS = dict(enumerate("k kh g gh n c ch j jh n t th d dh n t th d dh n n p ph b bh m y r r l l l v s s s h".split(), 0x15))
VOWELS = dict(enumerate("a a i i u u r l e e e ai o o o au".split(), 0x05))
VOWEL_SIGNS = dict(enumerate("a i i u u r r e e e ai o o o au".split(), 0x3E))
NASALS = {0x01: "n", 0x02: "n", 0x03: "h"}
BRAHMIC_DIGITS = {0x66 + i: str(i) for i in range(10)}


def first_block() -> tuple[str, str]:
    """The characters of all later blocks and those of the first block in their places, in two equal strings."""
    pairs = [(chr(block + i), chr(BRAHMIC[0] + i)) for block in BRAHMIC[1:] for i in range(0x80)]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def brahmic_letters() -> dict[str, str]:
    """What each character of the first block is spelt as; most marks are dropped."""
    spelt = {**CONSONANTS, **VOWELS, **VOWEL_SIGNS, **NASALS, **BRAHMIC_DIGITS}
    return {chr(BRAHMIC[0] + i): spelt.get(i, "") for i in range(0x80)}
