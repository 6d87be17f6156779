"""Quality rules: a threshold table compiled into one Spark projection.

Every figure (lengths, symbols, stop words, repeated lines and word windows) is
a built-in Spark expression over the row's own text.  The plan is a scan and a
projection: no shuffle, no user function, nothing that depends on other rows,
so a row costs the same in 1 GB and in 100 TB.

Defined results: null or empty text has no words, all counts 0, and fails the
base rule; repeated documents are judged alike, one by one; ids may be null.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"

#: Frequent function words of the languages the rules are meant for.
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "in", "is", "that", "it", "for", "was", "with", "be", "as", "on", "by", "have", "this", "are",
    # French
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "que", "qui", "en", "dans", "pour", "sur", "est", "pas", "par",
    # German
    "der", "die", "das", "und", "den", "dem", "ein", "eine", "mit", "von", "zu", "im", "nicht", "sich", "auf", "ist", "für",
    # Spanish
    "el", "los", "las", "y", "una", "con", "se", "del", "por", "su", "al", "es", "lo", "como", "más", "para",
)


@dataclass(frozen=True)
class Rule:
    """A document passes when ``low <= metric <= high`` (None: no bound)."""

    name: str
    metric: str
    low: Optional[float] = None
    high: Optional[float] = None


#: The base rule fixes min_words and max_repeat_ratio; the others are ours.
BASE_MIN_WORDS = 50
BASE_MAX_REPEAT_PERCENT = 50
RULES: tuple[Rule, ...] = (
    Rule("word_length", "mean_word_chars", 2.0, 15.0),
    Rule("symbols", "symbol_ratio", None, 0.25),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.5),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is named."""
    return F.transform(F.array(value), body)[0]


PLACE_BITS = 20


def _repeated_words(words: Column) -> Column:
    """Words covered by three-word windows that occur twice or more.

    Windows are compared by a 64-bit hash.  Only texts in which some window
    repeats go further: sorting brings equal windows
    together: the upper 44 bits of the hash and the window's place share one
    long, so that Spark sorts a plain array of longs, and neighbours that agree
    there are compared by their whole hash.  A text of 2^20 words or more has
    no room for the place and is sorted as (hash, place) pairs.
    """
    n = F.size(words)
    place = F.lit((1 << PLACE_BITS) - 1)

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda x, j: F.least(
            F.lit(3), F.coalesce(F.get(places, j + 1) - x, F.lit(3))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def beside(s: Column, j: Column, same) -> Column:
        return F.coalesce(same(F.get(s, j - 1)), F.lit(False)) | F.coalesce(same(F.get(s, j + 1)), F.lit(False))

    def from_longs(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(
            F.lit(-1 << PLACE_BITS)).bitwiseOR(i.cast("long"))))

        def alike(s: Column) -> Column:
            return F.filter(s, lambda x, j: beside(s, j, lambda y: x.bitwiseXOR(y).between(F.lit(0), place)))

        def same(s: Column) -> Column:
            places = F.transform(s, lambda x: x.bitwiseAND(place).cast("int"))
            return _let(places, lambda q: F.filter(q, lambda x, j: beside(
                q, j, lambda y: F.get(h, x) == F.get(h, y))))

        return _let(packed, lambda s: _let(alike(s), lambda t: F.when(F.size(t) == 0, F.lit(0)).otherwise(
            _let(F.sort_array(same(t)), covered))))

    def from_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return _let(pairs, lambda s: _let(F.sort_array(F.transform(
            F.filter(s, lambda x, j: beside(s, j, lambda y: y["h"] == x["h"])), lambda x: x["i"])), covered))

    windows = F.slice(F.transform(words, lambda w, i: F.xxhash64(
        w, F.get(words, i + 1), F.get(words, i + 2))), F.lit(1), n - 2)
    return F.when(n < 4, F.lit(0)).otherwise(_let(windows, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).when(
        n >= 1 << PLACE_BITS, from_pairs(h)).otherwise(from_longs(h))))


def text_figures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """All figures of one text as a struct, from one pass over its words."""
    body = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(body, SPACE), "")
    plain = body
    for symbol in SYMBOLS:
        plain = F.replace(plain, F.lit(symbol))
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stops = F.array(*[F.lit(w) for w in stop_words])

    def count(*of: Column) -> Column:
        w, ln = of
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            (F.length(body) - F.length(plain)).cast("long").alias("n_symbols"),
            (F.size(ln) - F.size(F.array_distinct(ln))).cast("long").alias("n_dup_lines"),
            _repeated_words(w).cast("long").alias("n_repeat_words"),
            F.size(ln).cast("long").alias("n_lines"),
            F.size(F.array_intersect(w, stops)).cast("long").alias("n_stop_words"),
        )

    return _let(words, lambda w: _let(lines, lambda ln: count(w, ln)))


def score_quality(docs: DataFrame, rules: Sequence[Rule] = RULES, text_col: str = "text",
                  keep: Sequence[str] = ("doc_id",), stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """The ``keep`` columns of ``docs``, every figure, one boolean column
    ``rule_<name>`` for each rule, ``base_failed`` and ``kept``.

    n_stop_words counts the different stop words in the text.  Ratios of a text
    without words are 0, and such a text fails the base rule anyway.
    """
    got = docs.select(*[F.col(c) for c in keep], text_figures(F.col(text_col), stop_words).alias("_figures"))
    got = got.select(*keep, "_figures.*")

    def ratio(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))

    metrics = {
        "n_words": F.col("n_words"), "word_chars": F.col("word_chars"), "n_stop_words": F.col("n_stop_words"),
        "mean_word_chars": ratio("word_chars", "n_words"), "symbol_ratio": ratio("n_symbols", "n_words"),
        "dup_line_ratio": ratio("n_dup_lines", "n_lines"), "repeat_ratio": ratio("n_repeat_words", "n_words"),
    }
    checks = {}
    for r in rules:
        m, ok = metrics[r.metric], F.lit(True)
        if r.low is not None:
            ok = ok & (m >= F.lit(r.low))
        if r.high is not None:
            ok = ok & (m <= F.lit(r.high))
        checks[f"rule_{r.name}"] = ok
    base_failed = (F.col("n_words") < BASE_MIN_WORDS) | (
        100 * F.col("n_repeat_words") > BASE_MAX_REPEAT_PERCENT * F.col("n_words"))
    verdict = ~base_failed
    for ok in checks.values():
        verdict = verdict & ok
    return got.select(*got.columns, base_failed.alias("base_failed"),
                      *[ok.alias(name) for name, ok in checks.items()], verdict.alias("kept"))


def filter_quality(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and every other rule, with
    all their columns; a column named like one of the figures is left alone."""
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("text").alias("_text"))
    scored = score_quality(packed, rules, text_col="_text", keep=("_row",))
    return scored.where("kept").select("_row.*")
