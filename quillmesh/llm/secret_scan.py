"""Secret scans: three patterns, and the Shannon entropy of windows sliding over candidate strings.

Candidates are runs of CANDIDATE characters. Over each, a window of WINDOW characters slides. The counts of the
window's characters are carried along, less the one that leaves and plus the one that enters, and with them the sum
of c * log2(c) over the counts, which gives the window's entropy log2(WINDOW) - sum / WINDOW. A candidate whose
greatest window entropy is above the threshold of its character class (hex digits; letters and digits; with symbols)
is a secret, unless it lacks letters or digits, matches the allow-list or overlaps a pattern's span. Everything is
columns and higher-order functions; places come from running sums of the lengths of matches and of the text between
them, in blocks, so that a text with very many matches takes little more than time in proportion to them.

Defined cases: an empty table gives no rows; a null or empty text has no secrets; texts may be as long as Spark holds
in a row; spans that tie in their start are in the order of KINDS; repeated rows are scanned alike; extra columns
pass through, those with the names of the results are replaced. Places are code points, ends exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A greedy run of 12 and 32 or more is what is left of the contract's runs after its length test.
ACCESS = "AKIA[A-Z0-9]{12,}"
HEX = "[0-9a-f]{32,}"
CANDIDATE = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "entropy"]
WINDOW = 20
#: Greatest window entropy in bits that is still taken for text, by character class; log2(20) is 4.32.
THRESHOLDS = [("^[0-9a-fA-F]+$", 3.0), ("^[A-Za-z0-9]+$", 3.7), (".", 3.8)]
#: Candidates that are no secrets: UUIDs, placeholders, alphabets and counts, words joined by - _ / or =.
ALLOW = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|(?i:example|sample|placeholder|changeme|xxxx|abcdefgh|01234567)|^([A-Za-z]+|[0-9]+)([-_/=]+([A-Za-z]+|[0-9]+))*[-_/=]*$"
MARK = "<secret>"
RESULTS = ["n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"]
_LAST = (1 << 31) - 1
_SPAN = "array<struct<s:int,k:int,e:int>>"
#: Running sums and maxima go block by block; texts are cut into pieces of so many code points.
BLOCK = 256
PIECE = 4096


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often a lambda in it names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, op: Callable[[Column, Column], Column], start: int) -> Column:
    """For each of values (ints) the result of op over it and all before."""
    none = F.array().cast("array<int>")

    def along(items: Column) -> Column:
        first = F.struct(F.lit(start).alias("at"), none.alias("out"))

        def step(acc: Column, x: Column) -> Column:
            return _let(op(acc["at"], x), lambda now: F.struct(now.alias("at"), F.array_append(acc["out"], now).alias("out")))

        return F.aggregate(items, first, step, lambda acc: acc["out"])

    def joined(blocks: Column) -> Column:
        ends = along(F.transform(blocks, lambda x: F.element_at(x, -1)))
        before = F.concat(F.array(F.lit(start)), F.slice(ends, 1, F.size(blocks) - 1))
        return F.flatten(F.zip_with(blocks, before, lambda x, b: F.transform(x, lambda y: op(y, b))))

    def by_blocks(items: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        return _let(F.transform(numbers, lambda b: along(F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))), joined)

    return _let(values, lambda v: F.when(F.size(v) <= BLOCK, along(v)).otherwise(by_blocks(v)))


def _places(found: str, gaps: str, kind: int) -> Column:
    """Spans of the strings of ``found``, from the lengths of the texts ``gaps`` before each."""
    ends = _running(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda x, g: F.length(x) + F.length(g)), lambda a, x: a + x, 0)
    spans = F.zip_with(ends, found, lambda e, x: F.struct((e - F.length(x)).alias("s"), F.lit(kind).alias("k"), e.alias("e")))
    return F.when(F.size(found) > 0, spans).otherwise(F.array().cast(_SPAN))


def _find(df: DataFrame, name: str, pattern: str, kind: int, hint: Column) -> DataFrame:
    """Adds ``name`` (spans) and, before it is dropped by the caller, name_m (the matches)."""
    empty = F.array().cast("array<string>")
    df = df.withColumn(f"{name}_m", F.when(hint, F.regexp_extract_all("__t", F.lit(pattern), F.lit(0))).otherwise(empty))
    df = df.withColumn(f"{name}_g", F.when(F.size(f"{name}_m") > 0, F.split("__t", pattern, -1)).otherwise(empty))
    return df.withColumn(name, _places(f"{name}_m", f"{name}_g", kind)).drop(f"{name}_g")


def _bits(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(0.0)


def window_entropy(chars: Column) -> Column:
    """The greatest entropy in bits of WINDOW consecutive characters, by incremental counts."""

    def slide(codes: Column, kinds: Column) -> Column:
        head = F.slice(codes, 1, WINDOW)
        counts = F.transform(kinds, lambda _, k: F.size(F.filter(head, lambda c: c == k)))
        # each character from WINDOW on enters as the one WINDOW places before it leaves
        rest = F.greatest(F.size(codes) - WINDOW, F.lit(0))
        moves = F.zip_with(F.slice(codes, WINDOW + 1, rest), F.slice(codes, 1, rest), lambda e, x: F.struct(e.alias("enters"), x.alias("leaves")))

        def step(acc: Column, x: Column) -> Column:
            out, put = F.get(acc["c"], x["leaves"]), F.get(acc["c"], x["enters"])
            moved = F.transform(acc["c"], lambda c, k: c + F.when(k == x["enters"], 1).when(k == x["leaves"], -1).otherwise(0))
            total = acc["t"] - _bits(out) + _bits(out - 1) + _bits(put + 1) - _bits(put)
            now = _let(total, lambda t: F.struct(moved.alias("c"), t.alias("t"), F.least(acc["low"], t).alias("low")))
            return F.when(x["leaves"] == x["enters"], acc).otherwise(now)

        def walk(c: Column) -> Column:
            first = F.aggregate(c, F.lit(0.0), lambda a, x: a + _bits(x))
            return F.aggregate(moves, F.struct(c.alias("c"), first.alias("t"), first.alias("low")), step, lambda acc: acc["low"])

        return F.log2(F.lit(float(WINDOW))) - _let(counts, walk) / WINDOW

    return _let(F.array_distinct(chars), lambda kinds: _let(F.transform(chars, lambda c: (F.array_position(kinds, c) - 1).cast("int")), lambda codes: slide(codes, kinds)))


def _is_secret(x: Column) -> Column:
    high = F.lit(False)
    for pattern, bits in reversed(THRESHOLDS):
        high = F.when(x["m"].rlike(pattern), window_entropy(x["c"]) > bits).otherwise(high)
    plain = ~x["m"].rlike("[0-9]") | ~x["m"].rlike("[A-Za-z]") | x["m"].rlike(ALLOW)
    return F.when(plain, F.lit(False)).otherwise(high)


def _free(spans: Column) -> Column:
    """The candidates among spans that no base span overlaps: in order of starts none before ends, and none after
    starts, within them."""

    def judge(order: Column) -> Column:
        ends = _running(F.transform(order, lambda x: F.when(x["k"] < 3, x["e"]).otherwise(0)), F.greatest, 0)
        starts = _running(F.transform(F.reverse(order), lambda x: F.when(x["k"] < 3, x["s"]).otherwise(_LAST)), F.least, _LAST)
        limits = F.zip_with(ends, F.reverse(starts), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        marked = F.zip_with(order, limits, lambda x, y: F.struct(x.alias("x"), ((x["k"] == 3) & (y["a"] <= x["s"]) & (y["b"] >= x["e"])).alias("ok")))
        return F.transform(F.filter(marked, lambda z: z["ok"]), lambda z: z["x"])

    return _let(F.sort_array(spans), judge)


def _scan(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __t, __base and __all (sorted spans) and the counts."""
    df = docs.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = _find(df, "__assign", ASSIGN, 0, F.col("__t").rlike(ASSIGN))
    values = F.when(F.size("__assign") > 0, F.regexp_extract_all("__t", F.lit(ASSIGN), F.lit(2))).otherwise(F.array().cast("array<string>"))
    long = F.zip_with("__assign", values, lambda x, v: F.when(F.length(v) >= 8, x))
    df = df.withColumn("__assign", F.filter(long, lambda x: x.isNotNull())).drop("__assign_m")
    df = _find(df, "__access", ACCESS, 1, F.col("__t").contains("AKIA")).drop("__access_m")
    df = _find(df, "__hex", HEX, 2, F.lit(True)).drop("__hex_m")
    df = df.withColumn("__base", F.sort_array(F.concat("__assign", "__access", "__hex")))
    df = _find(df, "__cand", CANDIDATE, 3, F.lit(True))
    wide = lambda x, m: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), m.alias("m"))
    df = df.withColumn("__cand", F.zip_with("__cand", "__cand_m", wide)).drop("__cand_m")
    both = (F.size("__base") > 0) & (F.size("__cand") > 0)
    df = df.withColumn("__free", F.when(both, _free(F.concat(F.transform("__base", lambda x: wide(x, F.lit(None).cast("string"))), "__cand"))).otherwise(F.col("__cand"))).drop("__cand")
    df = df.withColumn("__free", F.transform("__free", lambda x: F.struct(F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e")).alias("p"), x["m"].alias("m"), F.split(x["m"], "").alias("c"))))
    df = df.withColumn("__extra", F.transform(F.filter("__free", _is_secret), lambda x: x["p"])).drop("__free")
    df = df.withColumn("__all", F.sort_array(F.concat("__base", "__extra")))
    counts = {"n_assign": "__assign", "n_access": "__access", "n_hex": "__hex", "n_entropy": "__extra"}
    for name, column in counts.items():
        df = df.withColumn(name, F.size(column).cast("long"))
    return df.drop(*counts.values())


def _written(spans: str) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["k"]), x["s"].cast("string"), x["e"].cast("string"))), ",")


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with RESULTS: counts, base_sha256 and spans (kind:start:end, all kinds, by start, then kind)."""
    columns = [c for c in docs.columns if c not in RESULTS]
    df = _scan(docs.select(*columns), text)
    df = df.withColumn("base_sha256", F.sha2(_written("__base"), 256)).withColumn("spans", _written("__all"))
    return df.select(*columns, *RESULTS)


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every secret in the text replaced by MARK (overlapping spans as one); n_chars, if there, follows."""
    columns = docs.columns
    df = _scan(docs, text)
    some = F.size("__all") > 0

    def rewrite(pieces: Column, ends: Column) -> Column:
        def cut(a: Column, b: Column) -> Column:
            """The characters a .. b - 1."""
            first = F.floor(a / PIECE).cast("int")
            held = F.array_join(F.slice(pieces, first + 1, F.floor(b / PIECE).cast("int") - first + 1), "")
            return F.when(b > a, F.substring(held, a - first * PIECE + 1, b - a)).otherwise("")

        before = F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size(ends) - 1))
        parts = F.zip_with("__all", before, lambda x, a: F.when(x["s"] >= a, F.concat(cut(a, x["s"]), F.lit(MARK))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(F.element_at(ends, -1), F.length("__t")))

    # substring walks from the start of a string, so that it works on pieces
    pieces = F.regexp_extract_all("__t", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    ends = _running(F.transform("__all", lambda x: x["e"]), F.greatest, 0)
    whole = _let(pieces, lambda p: _let(ends, lambda e: rewrite(p, e)))
    df = df.withColumn("__new", F.when(some, whole).otherwise(F.col(text)))
    out = {text: F.col("__new").alias(text)}
    if "n_chars" in columns:
        out["n_chars"] = F.when(some, F.length("__new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")).alias("n_chars")
    return df.select(*[out.get(c, F.col(c)) for c in columns])


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns."""
    return annotate(docs.select("doc_id", "text")).drop("text", "n_entropy")


def brute_force(text: str | None) -> tuple[int, int, int, str, str]:
    """(n_assign, n_access, n_hex, base spans, all spans) of one text, in Python (for small fixtures)."""
    import math
    import re
    from collections import Counter

    text, base = text or "", []
    for kind, (pattern, least, group) in enumerate([(ASSIGN, 8, 2), ("AKIA[A-Z0-9]+", 16, 0), ("[0-9a-f]+", 32, 0)]):
        base += [(m.start(), kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    extra = []
    for m in re.finditer(CANDIDATE, text):
        s = m[0]
        if any(a < m.end() and e > m.start() for a, _, e in base) or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s) or re.search(ALLOW, s):
            continue
        best = max(-sum(c / WINDOW * math.log2(c / WINDOW) for c in Counter(s[i : i + WINDOW]).values()) for i in range(len(s) - WINDOW + 1))
        if best > next(bits for pattern, bits in THRESHOLDS if re.search(pattern, s)):
            extra.append((m.start(), 3, m.end()))
    write = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))
    count = Counter(k for _, k, _ in base)
    return count[0], count[1], count[2], write(base), write(base + extra)
