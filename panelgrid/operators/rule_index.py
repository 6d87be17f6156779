"""Ordered pattern rules of any number (J5): an inverted index instead of a
``CASE`` with a branch for each rule.

A pattern that spells out letters can match only texts which hold them.  Each
rule is filed under one three-letter gram that every text it matches must hold
(one for each alternative of the pattern), the one that fewest rules share.  The
distinct texts are cut into their grams and joined with the index; only the rules
met there are tried on a text, and the smallest ordinal wins.  Rules that spell
out nothing are dealt into blocks, and each text meets every block.

Letters are compared after a fold of single characters that never separates what
the case-blind match holds equal; only ASCII letters are filed.  The finder of
required letters may miss some (the rule is then tried on more texts), it never
claims too many.

Nothing is collected: rules and texts stay DataFrames, texts are distinct before
they are cut, and a text that a third of all rows bear is one text here.  Rules are
dealt over the shuffle partitions before their grams are found, so that a task has
its share of them however few files hold the table.  A rule's gram is the least of
whole numbers (rules that share it, then its letters), which needs no sorting; the
counts they are taken from have at most one row for each gram of ASCII letters
(69 cubed) and are broadcast.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import ustrip
from ..session import kept

GRAM = 3
#: Bits of a letter of a gram; grams are whole numbers, rules without letters have this one.
LETTER_BITS = 7
GRAM_BITS = GRAM * LETTER_BITS
NO_GRAM = -1
#: Alternatives of a pattern that are told apart; with more its letters count as unknown.
ALTERNATIVES = 64
#: Rules of a block, and parts of the texts, of the rules without letters.
BLOCK = 128
SALTS = 32

# Characters that match an ASCII letter where case is ignored, beside the letters themselves.
_FOLDED_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZKſİı"
_FOLDED_TO = "abcdefghijklmnopqrstuvwxyzksii"


def folded(text: Column) -> Column:
    return F.translate(text, _FOLDED_FROM, _FOLDED_TO)


def required_letters(pattern: str) -> list[list[str]] | None:
    """For each alternative of ``pattern`` the runs of letters that a match holds;
    None where some alternative needs none, or the pattern is not understood."""
    parser, code = re._parser, re._constants
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = parser.parse(pattern)
    except (re.error, OverflowError, RecursionError):
        return None
    if tree.state.flags & ~re.UNICODE.value:
        return None

    def walk(items) -> list[list[str]]:
        found: list[list[str]] = [[]]
        run = ""

        def also(more: list[list[str]]) -> None:
            nonlocal found
            if len(found) * len(more) <= ALTERNATIVES:
                found = [a + b for a in found for b in more]

        def close() -> None:
            nonlocal run
            if len(run) >= GRAM:
                also([[run]])
            run = ""

        for op, value in items:
            if op is code.LITERAL and 32 <= value < 127:
                run += chr(value).lower()
                continue
            close()
            if op is code.SUBPATTERN and not value[1] and not value[2]:
                also(walk(value[3]))
            elif op is code.BRANCH:
                also([a for branch in value[1] for a in walk(branch)])
            elif op in (code.MAX_REPEAT, code.MIN_REPEAT, code.POSSESSIVE_REPEAT) and value[0] >= 1:
                also(walk(value[2]))
            elif op is code.ATOMIC_GROUP:
                also(walk(value))
        close()
        return found

    found = walk(tree)
    return found if all(found) else None


def gram_number(gram: str) -> int:
    """Grams of ASCII letters as numbers in the same order."""
    n = 0
    for letter in gram:
        n = n << LETTER_BITS | ord(letter)
    return n


def gram_letters(number: Column) -> Column:
    """The gram of a :func:`gram_number`."""
    return F.concat(*[F.char(F.shiftright(number, LETTER_BITS * k).bitwiseAND(F.lit((1 << LETTER_BITS) - 1))) for k in reversed(range(GRAM))])


def _filed(rules: DataFrame) -> DataFrame:
    """(ordinal, alternative, gram) of every gram a rule's alternatives need; gram
    is NO_GRAM for rules without letters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for ordinal, pattern in zip(batch["ordinal"], batch["pattern"], strict=True):
                for k, runs in enumerate(required_letters(pattern) or [[]]):
                    grams = {gram_number(r[i:i + GRAM]) for r in runs for i in range(len(r) - GRAM + 1)}
                    out += [(ordinal, k, g) for g in grams or [NO_GRAM]]
            yield pd.DataFrame(out, columns=["ordinal", "alternative", "gram"])

    tasks = int(rules.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rules.select("ordinal", "pattern").repartition(tasks, "ordinal").mapInPandas(run, "ordinal bigint, alternative int, gram bigint")


def _rarest(filed: DataFrame) -> DataFrame:
    """(ordinal, gram): for each alternative of a rule with letters, the gram that fewest share, of those the first."""
    lettered = filed.where(F.col("gram") != NO_GRAM)
    sharing = F.broadcast(lettered.groupBy("gram").count())
    rarity = F.shiftleft("count", GRAM_BITS).bitwiseOR(F.col("gram"))
    least = lettered.join(sharing, "gram").groupBy("ordinal", "alternative").agg(F.min(rarity).alias("least"))
    return least.select("ordinal", gram_letters(F.col("least").bitwiseAND(F.lit((1 << GRAM_BITS) - 1))).alias("gram")).distinct()


def _matches(text: Column, pattern: Column) -> Column:
    return F.rlike(text, F.concat(F.lit("(?iu)"), pattern))


def first_rule(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """(text, subgroup): for every distinct non-null ``text`` that some rule of
    (ordinal, pattern, subgroup) matches, the subgroup of the first of them.
    Ordinals must be unique."""
    rules = rules.select(F.col("ordinal").cast("bigint").alias("ordinal"), "pattern", "subgroup").where(
        "pattern IS NOT NULL AND ordinal IS NOT NULL")
    filed = kept(_filed(rules))
    index = _rarest(filed).join(rules, "ordinal")

    own = texts.select("text").where("text IS NOT NULL").distinct().withColumn("_stripped", ustrip("text"))
    letters = folded(F.col("_stripped"))
    places = F.sequence(F.lit(1), F.length(letters) - (GRAM - 1))
    grams = F.when(F.length(letters) >= GRAM, F.array_distinct(F.transform(places, lambda i: F.substring(letters, i, F.lit(GRAM)))))
    met = own.withColumn("gram", F.explode(grams)).join(index, "gram").where(_matches(F.col("_stripped"), F.col("pattern"))).select(
        "text", "ordinal", "subgroup")

    open_rules = filed.where(F.col("gram") == NO_GRAM).select("ordinal").distinct().join(rules, "ordinal")
    n_blocks = open_rules.select(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int")).scalar()
    blocks = open_rules.withColumn("_n", n_blocks).groupBy(F.pmod(F.xxhash64("ordinal"), F.col("_n")).cast("int").alias("_block")).agg(
        F.collect_list(F.struct("ordinal", "pattern", "subgroup")).alias("_rules"))
    blocks = blocks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = own.withColumn("_n", n_blocks).where("_n > 0").withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).withColumn(
        "_salt", F.pmod(F.xxhash64("text"), F.lit(SALTS)).cast("int"))
    tried = dealt.join(blocks, ["_block", "_salt"]).select("text", "_stripped", F.inline("_rules"))
    late = tried.where(_matches(F.col("_stripped"), F.col("pattern"))).select("text", "ordinal", "subgroup")
    return met.unionByName(late).groupBy("text").agg(F.min_by("subgroup", "ordinal").alias("subgroup"))
