"""Quality rules: base counts, and the divergence of a text's histograms from those of its language.

For each language of LANGUAGES (all other texts are one more group) the references are two histograms summed over
all texts of the language that pass the base rule: characters by class, and the language's common words against all
others. A text whose Jensen-Shannon distance (base 2, square root) from the reference of its language is above
MAX_CHAR_DISTANCE or MAX_WORD_DISTANCE is rejected; texts below MIN_CHARS or MIN_WORDS are too short to be judged by
that histogram and pass it. Everything is columns and higher-order functions. Counts and histograms are computed
once and written to the shared folder; the references are one row per language of them (5 at most), so that the
second step reads a few numbers a text.

Defined cases: an empty table gives no rows; a null or empty text has no words and fails the base rule; a null or
unknown language is the group of others; a group without texts that pass has a flat reference (none of its texts is
judged by it); texts may be as long as Spark holds in a row; a distance equal to its limit passes; repeated rows are
judged alike; extra columns pass through, those with the names of the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

WORD = r"[^\x20\x09-\x0D]+"
WINDOW = 8
MIN_CHARS = 200
MIN_WORDS = 60
MAX_CHAR_DISTANCE = 0.30
MAX_WORD_DISTANCE = 0.25

#: Common words of each language; "" is for all other languages.
LANGUAGES = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be"],
    "fr": ["le", "la", "les", "de", "des", "et", "un", "une", "du", "que", "est", "en"],
    "de": ["der", "die", "das", "und", "nicht", "mit", "ein", "eine", "den", "von", "ist", "zu"],
    "es": ["el", "la", "los", "de", "del", "en", "y", "que", "un", "una", "con", "por"],
    "": ["the", "of", "and", "la", "de", "et", "der", "die", "und", "el", "en", "que"],
}
N_COMMON = 12
#: Character classes, each taken from what the ones before have left: the rest is the last class.
CLASSES = ["[a-z]+", r"[\x20\x09-\x0D]+", "[A-Z]+", r"[^\x00-\x7F]+", "[0-9]+", r"[.,;:!?'\"()-]+", "[#*$%&|<>]+"]
SYMBOLS = 6
RESULTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", "kept"]


def _histograms(df: DataFrame, text: str) -> DataFrame:
    """``df`` with __t (text), __w (words), __lang, __chars (counts by class) and __common (counts, others last)."""
    df = df.withColumn("__t", F.coalesce(F.col(text).cast("string"), F.lit("")))
    df = df.withColumn("__w", F.regexp_extract_all("__t", F.lit(WORD), F.lit(0)))
    df = df.withColumn("__lang", F.when(F.col("lang").isin([x for x in LANGUAGES if x]), F.col("lang")).otherwise("") if "lang" in df.columns else F.lit(""))
    left = "__t"
    counts: list[Column] = []
    for i, pattern in enumerate(CLASSES):
        df = df.withColumn(f"__l{i}", F.regexp_replace(left, pattern, ""))
        counts.append(F.length(left) - F.length(f"__l{i}"))
        left = f"__l{i}"
    counts.append(F.length(left))
    df = df.withColumn("__chars", F.array(*[c.cast("long") for c in counts])).drop(*[f"__l{i}" for i in range(len(CLASSES))])
    own = F.lit(None)
    for lang, words in LANGUAGES.items():
        own = F.when(F.col("__lang") == lang, F.array(*map(F.lit, words))).otherwise(own)
    df = df.withColumn("__list", own)
    df = df.withColumn("__hits", F.filter(F.transform("__w", F.lower), lambda w: F.array_contains("__list", w)))
    return df.withColumn(
        "__common",
        F.concat(F.transform("__list", lambda k: F.size(F.filter("__hits", lambda x: x == k)).cast("long")), F.array((F.size("__w") - F.size("__hits")).cast("long"))),
    ).drop("__list", "__hits")


def references(measured: DataFrame) -> dict[str, tuple[list[float], list[float]]]:
    """For each language its two histograms as shares, over all texts of ``measure`` that pass the base rule."""
    n = len(CLASSES) + 1
    sums = [F.sum(F.get("__chars", F.lit(i))).alias(f"c{i}") for i in range(n)] + [F.sum(F.get("__common", F.lit(i))).alias(f"w{i}") for i in range(N_COMMON + 1)]
    out = {lang: tuple([1 / k] * k for k in (n, N_COMMON + 1)) for lang in LANGUAGES}
    for row in measured.where("not base_failed").groupBy("__lang").agg(*sums).collect():  # one row for each of LANGUAGES
        shares = []
        for values in ([row[f"c{i}"] for i in range(n)], [row[f"w{i}"] for i in range(N_COMMON + 1)]):
            total = sum(values)
            shares.append([v / total if total else 1 / len(values) for v in values])
        out[row["__lang"]] = tuple(shares)
    return out


def _distance(counts: str, shares: dict[str, list[float]]) -> tuple[Column, Column]:
    """The total of a histogram of counts, and its Jensen-Shannon distance from its language's shares (from the
    column with the total; 0 if that is 0)."""
    own = F.lit(None).cast("array<double>")
    for lang, values in shares.items():
        own = F.when(F.col("__lang") == lang, F.array(*[F.lit(float(v)) for v in values])).otherwise(own)
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    p = F.transform(F.col(counts), lambda c: c / F.greatest(F.col(f"{counts}_n"), F.lit(1)))
    terms = F.zip_with(p, own, lambda a, b: part(a, (a + b) / 2) + part(b, (a + b) / 2))
    value = F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))
    return total, F.when(F.col(f"{counts}_n") > 0, value).otherwise(0.0)


def _base(df: DataFrame) -> DataFrame:
    """The base counts of __t and __w."""
    df = df.withColumn("n_words", F.size("__w").cast("long")).withColumn("word_chars", F.length(F.array_join("__w", "")).cast("long"))
    df = df.withColumn("__lines", F.filter(F.split("__t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    df = df.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    windows = F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("__w", i, F.lit(WINDOW))))
    df = df.withColumn("__h", F.when(F.size("__w") >= WINDOW, windows).otherwise(F.array().cast("array<long>")))
    # only texts with a repeated window sort them: (hash, place), then the places of equal neighbours
    placed = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed)).drop("__h")
    again = F.filter("__s", lambda x, i: F.coalesce((F.get("__s", i - 1)["h"] == x["h"]) | (F.get("__s", i + 1)["h"] == x["h"]), F.get("__s", i - 1)["h"] == x["h"], F.get("__s", i + 1)["h"] == x["h"], F.lit(False)))
    df = df.withColumn("__p", F.when(F.col("__s").isNotNull(), F.sort_array(F.transform(again, lambda x: x["i"]))))
    covered = F.transform("__p", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__p", i + 1) - p, F.lit(WINDOW))))
    repeated = F.when(F.size("__p") > 0, F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    df = df.withColumn("n_repeat_words", repeated).drop("__s", "__p")
    return df.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base counts and the two histograms."""
    columns = [c for c in docs.columns if c not in RESULTS]
    df = _base(_histograms(docs.select(*columns), text)).withColumn("n_symbols", F.get("__chars", F.lit(SYMBOLS)))
    return df.drop("__t", "__w")


def judge(measured: DataFrame) -> DataFrame:
    """A table of ``measure`` with RESULTS in place of the histograms."""
    refs = references(measured)
    chars, char_distance = _distance("__chars", {k: v[0] for k, v in refs.items()})
    words, word_distance = _distance("__common", {k: v[1] for k, v in refs.items()})
    df = measured.withColumn("__chars_n", chars).withColumn("__common_n", words)
    df = df.withColumn("char_distance", char_distance).withColumn("word_distance", word_distance)
    odd_chars = (F.col("__chars_n") >= MIN_CHARS) & (F.col("char_distance") > MAX_CHAR_DISTANCE)
    odd_words = (F.col("n_words") >= MIN_WORDS) & (F.col("word_distance") > MAX_WORD_DISTANCE)
    df = df.withColumn("kept", ~F.col("base_failed") & ~odd_chars & ~odd_words)
    return df.drop("__lang", "__chars", "__common", "__chars_n", "__common_n")


def annotate(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with RESULTS."""
    columns = [c for c in docs.columns if c not in RESULTS]
    return judge(materialize(measure(docs, text), "measured")).select(*columns, *RESULTS)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; the texts are not written."""
    measured = materialize(measure(docs.select("doc_id", "text", "lang")).drop("text", "lang"), "measured")
    return judge(measured).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they had (those with the names of results too)."""
    own = {c: f"__own_{c}" for c in docs.columns if c in RESULTS}
    kept = annotate(docs.withColumnsRenamed(own)).where("kept").drop(*RESULTS)
    return kept.withColumnsRenamed({v: k for k, v in own.items()}).select(*docs.columns)


def brute_force(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """The base counts of one text, in Python (for small fixtures)."""
    import re
    from collections import Counter

    text = text or ""
    words = re.findall(WORD, text)
    lines = [x for x in text.split("\n") if re.search(WORD, x)]
    grams = [tuple(words[i : i + WINDOW]) for i in range(len(words) - WINDOW + 1)]
    seen = Counter(grams)
    repeated = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + WINDOW)}
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 20 or 100 * len(repeated) > 30 * n)
