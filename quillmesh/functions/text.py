"""Text normalisation as column expressions; all of it stays in the JVM.

Nulls count as empty strings. Runs of a repeated character collapse before any lookup, so that keys with a doubled
letter never match; that is kept as it is.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L


def _text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def mapping(values: Mapping) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def fold(c: Column | str) -> Column:
    """Accented Latin letters to ASCII."""
    c = F.translate(_text(c), *L.latin_pairs())
    for letter, spelt in L.EXPANSIONS.items():
        c = F.replace(c, F.lit(letter), F.lit(spelt))
    return c


def romanize(c: Column) -> Column:
    """Romanises the Brahmic blocks: a consonant before another, a vowel or a nasal has its inherent a; the last of a
    word has none."""
    c = F.translate(c, *L.first_block())
    at = lambda places: "[" + "".join(chr(L.BRAHMIC[0] + i) for i in places) + "]"
    consonant, after = at(L.CONSONANTS), at([*L.NASALS, *L.VOWELS, *L.CONSONANTS])
    c = F.regexp_replace(c, f"({consonant})(?={after})", "$1a")
    spelt = L.brahmic_letters()
    for second in sorted({x[1] for x in spelt.values() if len(x) > 1}):  # kh, ai, au and the like
        longer = "".join(k for k, x in spelt.items() if x[1:] == second)
        c = F.regexp_replace(c, f"([{longer}])", f"$1{second}")
    kept = {k: x[0] for k, x in spelt.items() if x}
    dropped = "".join(k for k, x in spelt.items() if not x)
    return F.translate(c, "".join(kept) + dropped, "".join(kept.values()))


def fold_scripts(c: Column | str) -> Column:
    """``fold`` and a romanisation of Indic scripts."""
    c = _text(c)
    return fold(F.when(has_indic(c), romanize(c)).otherwise(c))


def has_indic(c: Column | str) -> Column:
    return _text(c).rlike("[" + "".join(f"\\p{{Is{x}}}" for x in L.INDIC_SCRIPTS) + "]")


def norm_text(c: Column | str) -> Column:
    """Lower-case ASCII words with single spaces, runs of one character as one; Indic scripts are romanised."""
    c = F.lower(fold_scripts(c))
    c = F.regexp_replace(c, "[^a-z0-9]+", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(.)\1+", "$1"), r"\s+", " "))


def words(c: Column | str) -> Column:
    return F.filter(F.split(_text(c), " "), lambda x: x != "")


def core_tokens(toks: str) -> Column:
    """Tokens of a normalised name (a column) without legal forms and stop words; if none is left, without stop
    words; else all."""
    stop = F.array(*map(F.lit, L.STOP_NAME))
    drop = F.array(*[F.lit(x) for x in [*L.LEGAL, *L.STOP_NAME]])
    core = F.filter(toks, lambda x: ~F.array_contains(drop, x))
    rest = F.filter(toks, lambda x: ~F.array_contains(stop, x))
    return F.when(F.size(core) > 0, core).when(F.size(rest) > 0, rest).otherwise(F.col(toks))


def legal_mask(name: Column | str) -> Column:
    """Bit mask of the legal forms in a normalised name, runs of single letters glued first."""
    glued = F.regexp_replace(_text(name), r"(?<=\b[a-z]) (?=[a-z]\b)", "")
    bits = mapping({k: L.LEGAL_BIT[v] for k, v in L.LEGAL.items()})
    found = F.filter(F.transform(words(glued), lambda w: F.element_at(bits, w)), lambda x: x.isNotNull())
    return F.aggregate(found, F.lit(0), lambda a, x: a.bitwiseOR(x))


def address_tokens(norm: Column | str) -> Column:
    table = mapping(L.ADDRESS)
    return F.transform(words(norm), lambda x: F.coalesce(F.element_at(table, x), x))


def state_of_tokens(toks: Column) -> Column:
    """The state code of the last of the four last address tokens that has one."""
    table = mapping(L.STATES)
    size = F.size(toks)
    last = F.slice(toks, F.greatest(size - 3, F.lit(1)), F.lit(4))
    codes = F.filter(F.transform(F.reverse(last), lambda x: F.element_at(table, x)), lambda x: x.isNotNull())
    return F.when(size > 0, F.coalesce(F.get(codes, F.lit(0)), F.lit(""))).otherwise("")


def digits(c: Column | str) -> Column:
    return F.array_join(F.regexp_extract_all(_text(c), F.lit(r"(\d+)"), F.lit(1)), "")


def raw_state(country: Column, address: Column | str) -> Column:
    """State named by a comma part of a raw address, the last first: US codes, names of Indian states."""
    pieces = F.reverse(F.transform(F.split(_text(address), ","), lambda x: F.trim(x)))
    us = F.filter(F.transform(pieces, F.upper), lambda x: x.isin(L.US_CODES))
    india = F.filter(F.transform(pieces, F.lower), lambda x: x.isin(L.INDIA_STATES))
    own = F.when(country == "US", us).when(country == "India", india)
    return F.coalesce(F.get(own, F.lit(0)), F.lit(""))


def encoder_text(name: Column, address: Column) -> Column:
    """The text that an encoder gets for a record."""
    address = F.trim(_text(address))
    return F.concat(F.lit("query: "), F.trim(_text(name)), F.when(address != "", F.concat(F.lit(", "), address)).otherwise(""))


def id_code(entity_id: Column) -> Column:
    return F.substring(entity_id, 2, 1).cast("long") * 100_000_000_000 + F.substring(entity_id, 4, 40).cast("long")


def parse_ids(cell: Column | str) -> Column:
    """Distinct trimmed ids of a comma-joined cell."""
    return F.array_distinct(F.filter(F.transform(F.split(_text(cell), ","), lambda x: F.trim(x)), lambda x: x != ""))


def match_count(cell: Column | str) -> Column:
    c = _text(cell)
    return F.when(c == "", 0).otherwise(F.size(F.split(c, ",")))


def cardinality_bucket(n: Column) -> Column:
    return F.when(n >= 3, "3+").otherwise(n.cast("string"))


def rank_bucket(rank: Column) -> Column:
    """Label of a 0-based rank; null is no rank."""
    out = F.when(rank.isNull(), "none")
    for top in (0, 4, 9, 24, 49, 99, 199):
        out = out.when(rank <= top, f"<={top}")
    return out.otherwise(">199")


def normalize(df):
    """Records with name, core, addr, digits, state and legal beside their own columns."""
    name = norm_text("business_name")
    df = df.withColumn("name", name).withColumn("__toks", words("name"))
    df = df.withColumn("core", F.array_join(core_tokens("__toks"), " "))
    df = df.withColumn("__addr", address_tokens(norm_text("business_address")))
    return df.withColumn("addr", F.array_join("__addr", " ")).withColumn("digits", digits("addr")).withColumn("state", state_of_tokens(F.col("__addr"))).withColumn("legal", legal_mask("name")).drop("__toks", "__addr")
