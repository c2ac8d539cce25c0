"""Quality rules by distribution divergence, in DataFrame functions only.

Each document has two histograms: its characters over a few classes, and its words over groups of
common words of some languages. Both are compared with the mean histogram of the document's
language by Jensen-Shannon distance (0 to 1). A short text has a ragged histogram, so each
distance counts only from a least length on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from varve.llm.common import ensure_checkpoints

# Common words of four languages, in three groups each.
COMMON_WORDS = {
    "en": (
        ("the", "a", "an", "this", "that", "it", "he", "she", "they", "we", "you"),
        ("of", "to", "in", "for", "on", "with", "as", "by", "at", "from", "and", "or", "but"),
        ("is", "was", "be", "are", "were", "have", "has", "not", "will", "can"),
    ),
    "de": (
        ("der", "die", "das", "den", "dem", "des", "ein", "eine", "einen", "sie", "es", "ich"),
        ("und", "oder", "in", "im", "zu", "von", "mit", "auf", "für", "an", "als", "bei"),
        ("ist", "war", "sind", "sich", "nicht", "auch", "hat", "wird", "werden", "haben"),
    ),
    "fr": (
        ("le", "la", "les", "un", "une", "des", "du", "il", "elle", "ce", "qui", "que"),
        ("de", "et", "ou", "en", "dans", "par", "pour", "sur", "avec", "au", "aux"),
        ("est", "sont", "était", "a", "ont", "pas", "ne", "plus", "se", "être"),
    ),
    "es": (
        ("el", "la", "los", "las", "un", "una", "lo", "su", "que", "ella", "este"),
        ("de", "y", "o", "en", "a", "por", "para", "con", "del", "al", "como"),
        ("es", "son", "era", "está", "ha", "no", "más", "se", "ser", "fue"),
    ),
}
GROUPS = [(f"{lang}{k}", words) for lang, lists in COMMON_WORDS.items() for k, words in enumerate(lists)]

#: Character classes as regular expressions; what is in none is "rest".
CLASSES = {
    "upper": r"\p{Lu}+", "lower": r"\p{Ll}+", "digit": "[0-9]+", "space": r"[\x20\x09-\x0D]+",
    "stop": "[.,;:?'\"()]+", "symbol": "[#*$%&|<>]+",
}

CHARS = [f"c_{name}" for name in (*CLASSES, "rest")]
WORDS = [f"w_{name}" for name, _ in GROUPS] + ["w_rest"]

#: Distances beyond which a document is rejected, and the words from which each counts. The limit
#: for characters is wider for short texts, by CHAR_SLACK over the number of words.
CHAR_LIMIT, CHAR_SLACK, CHAR_LEAST = 0.16, 4.0, 20
WORD_LIMIT, WORD_LEAST = 0.45, 60
OTHER = "other"


def features(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of the base rules and of both histograms, one row per row of ``docs``."""
    of_language = F.col(lang).cast("string")
    whole = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.when(of_language.isin(list(COMMON_WORDS)), of_language).otherwise(OTHER).alias("lang"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    split = whole.select(
        "*",
        F.expr(r"regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)").alias("words"),
        F.expr(r"filter(split(text, '\\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
    )
    # Five-word windows by hash: a text of a million words has a false pair once in 10^7.
    hashed = split.select(
        "*",
        F.expr(
            "if(size(words) < 5, cast(array() as array<bigint>),"
            " transform(sequence(1, size(words) - 4), i -> xxhash64(slice(words, i, 5))))"
        ).alias("windows"),
        _group_codes().alias("codes"),
    )
    length = F.char_length("text")
    classes = {
        f"c_{name}": (length - F.char_length(F.regexp_replace("text", pattern, ""))).cast("long")
        for name, pattern in CLASSES.items()
    }
    groups = {
        f"w_{name}": F.size(F.filter("codes", lambda c, k=k: c == F.lit(k))).cast("long")
        for k, (name, _) in enumerate(GROUPS)
    }
    counted = hashed.select(
        "doc_id", "lang", length.cast("long").alias("n_chars"),
        F.size("words").cast("long").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        *[c.alias(name) for name, c in classes.items()], *[c.alias(name) for name, c in groups.items()],
        F.size("codes").cast("long").alias("n_common"),
        F.expr(
            "if(size(windows) = size(array_distinct(windows)), cast(array() as array<struct<h: bigint, i: int>>),"
            " sort_array(transform(windows, (h, i) -> named_struct('h', h, 'i', i))))"
        ).alias("ordered"),
    )
    placed = counted.select("*", F.expr(
        "sort_array(transform(filter(ordered, (x, i) -> (i > 0 and get(ordered, i - 1).h = x.h)"
        " or (i + 1 < size(ordered) and get(ordered, i + 1).h = x.h)), x -> x.i))"
    ).alias("places"))
    return placed.select(
        "doc_id", "lang", "n_words", "word_chars", F.col("c_symbol").alias("n_symbols"), "n_dup_lines",
        F.expr(
            "aggregate(places, named_struct('n', 0L, 'last', -5),"
            " (a, p) -> named_struct('n', a.n + least(5, p - a.last), 'last', p), a -> a.n)"
        ).alias("n_repeat_words"),
        *list(classes), (F.col("n_chars") - reduce(Column.__add__, map(F.col, classes))).alias("c_rest"),
        *list(groups), (F.col("n_words") - F.col("n_common")).alias("w_rest"),
    )


def _group_codes() -> Column:
    """The group number of each common word of a text, others left out.

    A word in several groups counts in the first, in every text alike.
    """
    taken: set[str] = set()
    code, every = None, []
    for k, (_, words) in enumerate(GROUPS):
        new = [w for w in words if w not in taken]
        taken.update(new)
        every += new
        quoted = ", ".join(f"'{w}'" for w in new)
        code = f"{code or 'case'} when w in ({quoted}) then {k}" if new else code
    quoted = ", ".join(f"'{w}'" for w in every)
    return F.expr(f"transform(filter(transform(words, x -> lower(x)), w -> w in ({quoted})), w -> {code} end)")


def _shares(names: list[str]) -> dict[str, Column]:
    total = reduce(Column.__add__, map(F.col, names))
    return {n: F.when(total > 0, F.col(n) / total).otherwise(0.0) for n in names}


def references(fit: DataFrame) -> dict[str, dict[str, float]]:
    """Mean shares by language.

    At most one row for each language with a word list and one for the others reaches the driver.
    """
    shares = {**_shares(CHARS), **_shares(WORDS)}
    # exact sums, so that a reference does not depend on the order of rows
    means = [F.avg(F.round(c, 6).cast("decimal(20,6)")).cast("double").alias(n) for n, c in shares.items()]
    return {row["lang"]: {n: row[n] for n in shares} for row in fit.groupBy("lang").agg(*means).collect()}


def trimmed_references(counted: DataFrame, rounds: int = 3) -> dict[str, dict[str, float]]:
    """References over documents that pass the base rules, have both least lengths and, after the
    first round, lie no farther from the last references than the limits: junk moves a mean."""
    fit = counted.where(~F.col("base_failed") & (F.col("n_words") >= max(CHAR_LEAST, WORD_LEAST)))
    known = references(fit)
    for _ in range(rounds - 1):
        near = (js_distance(CHARS, known) <= _char_limit(CHAR_LIMIT)) & (js_distance(WORDS, known) <= WORD_LIMIT)
        known = {**known, **references(fit.where(near))}
    return known


def js_distance(names: list[str], reference: dict[str, dict[str, float]]) -> Column:
    """Jensen-Shannon distance (base 2) of a row's shares to its language's; null without one."""
    known = F.lit(None).cast("array<double>")
    for lang, language in reference.items():
        known = F.when(F.col("lang") == lang, F.array(*[F.lit(float(language[n])) for n in names])).otherwise(known)
    counts = F.array(*[F.col(n).cast("double") for n in names])
    total = reduce(Column.__add__, map(F.col, names)).cast("double")

    def term(x: Column, y: Column) -> Column:
        p = F.when(total > 0, x / total).otherwise(0.0)
        m = (p + y) / 2
        return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(y > 0, y * F.log2(y / m)).otherwise(0.0)

    terms = F.zip_with(counts, known, term)
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def _char_limit(limit: float) -> Column:
    return F.lit(limit) + CHAR_SLACK / F.greatest(F.col("n_words"), F.lit(1))


def quality(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    char_limit: float = CHAR_LIMIT, word_limit: float = WORD_LIMIT,
) -> DataFrame:
    """Per row: doc_id, the base counts, base_failed, both distances, and kept.

    ``base_failed``: under 10 words, or over 20 % of them in five-word windows that the text holds
    twice. ``kept`` is false if that holds or a distance is over its limit. A distance is null, and
    rejects nothing, below its least length (``CHAR_LEAST``, ``WORD_LEAST`` words) or where the
    language has no reference. A null text has no words and fails the base rules; an unknown or
    null language shares one reference; a null id stays null; repeated rows are judged each and
    all count in the references; an empty table gives no rows; other columns are not read.
    """
    ensure_checkpoints(docs.sparkSession)
    counted = features(docs, doc_id, text, lang).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    ).checkpoint()  # counts of whole texts, made once: references need all before the first verdict
    known = trimmed_references(counted)
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.when(F.col("n_words") >= CHAR_LEAST, js_distance(CHARS, known)).alias("char_distance"),
        F.when(F.col("n_words") >= WORD_LEAST, js_distance(WORDS, known)).alias("word_distance"),
    ).withColumn(
        "kept",
        ~F.col("base_failed") & (F.coalesce(F.col("char_distance"), F.lit(0.0)) <= _char_limit(char_limit))
        & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= word_limit),
    )
