"""Rule tables of any size against the generated expression and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from panelgrid.config import Rules
from panelgrid.operators import classify as K
from panelgrid.operators import rule_index as R
from panelgrid.operators.rule_index import first_rule, folded, required_letters


@pytest.mark.parametrize(("pattern", "want"), [
    ("widget", [["widget"]]), ("Widget.*GEAR", [["widget", "gear"]]), ("widget|gear", [["widget"], ["gear"]]), (r"^(hot|cold)\b", [["hot"], ["cold"]]),
    ("ab|cold", None), ("(widget)?", None), ("(widget)*x", None), ("(widget)+x", [["widget"]]), ("[wW]idget", [["idget"]]), (r"\n.*\+", None),
    ("(?!widget)", None), ("(?=widget)", None), ("(?x) wid get", None), ("(?-i:widget)", None), ("(?:gizmo|gear) ring", [["ear", " ring"], ["izmo", " ring"]]),
    (r"\Qwidget\E", None), ("widget(", None), ("wid.get", [["wid", "get"]]), ("Δ4widgetΔ", [["4widget"]]), ("", None), ("a{3}bcd", [["bcd"]]),
    ("|".join(f"name{k}" for k in range(70)), [["name"]]),
])
def test_required_letters(pattern, want):
    got = required_letters(pattern)
    assert (got and sorted(got)) == (want and sorted(want))


def test_required_letters_never_claim_too_many():
    rng = random.Random(7)
    bits = ["widget", "gear", "(?:hot|cold)", "[ab]", ".*", "x?", "(ring)?", "(plate)+", "|", "^", "$", r"\b", "a{0,2}", "(?=g)", "ſet", r"\d", "(?:wid|widge)t"]
    texts = ["".join(rng.choice(["widget", "gear", "hot", "cold", "a", "ring", "plate", " ", "x", "SET", "7", "W", "wid"]) for _ in range(5)) for _ in range(300)]
    for _ in range(400):
        pattern = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 6)))
        found = required_letters(pattern)
        for t in texts if found else []:
            if re.search(pattern, t, re.IGNORECASE):
                assert any(all(run in t.lower() for run in runs) for runs in found), (pattern, t)


def texts_of(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "Construct_Description string")


def rule_table(spark, rules):
    return spark.createDataFrame([(i, p, s) for i, (p, s) in enumerate(rules)], "ordinal long, pattern string, subgroup string")


def test_index_equals_the_expression(spark):
    rng = random.Random(5)
    words = ["hot", "cold", "widget", "gear", "gizmo", "plate", "ring", "nation", "Δ4", "STRASSE", "ſilver", "Kelvin", "İstanbul", "ı"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) for _ in range(250)] + ["", " ", "a", "ab", None, "hot\n+ cold", " ring ", "x" * 500]
    kinds = [lambda a, b: f"^{a} {b}", lambda a, b: f"{a}.*{b}$", lambda a, b: f"{a}|{b}", lambda a, b: f"({a}|{b}) {a}$", lambda a, b: f"^.{{{rng.randrange(1, 40)}}}$",
             lambda a, b: f"[{a[0]}]{b[1:]}z", lambda a, b: rf"\n.*\+ {b}", lambda a, b: a[:2], lambda a, b: f"{a}{rng.randrange(9)}"]
    rules = [(rng.choice(kinds)(rng.choice(words).lower(), rng.choice(words).upper()), f"s{k}") for k in range(1000)]
    df = texts_of(spark, texts)
    by_expression = df.withColumn("s", K.rule_subgroup(F.col("Construct_Description"), Rules(pattern_rules=rules)))
    found = {r["text"]: r["subgroup"] for r in first_rule(df.select(F.col("Construct_Description").alias("text")), rule_table(spark, rules)).collect()}
    want = {r[0]: r["s"] for r in by_expression.collect()}
    assert {t: found.get(t, "Uncategorized") for t in want} == want and None not in found
    assert len(set(want.values())) > 10


def test_classify_with_long_lists_and_tables(spark):
    rules = [(f"^name{k} ", f"s{k}") for k in range(900)] + [("gear", "last")]
    exact = (("Old GEAR", "exact"),)
    df = texts_of(spark, ["name7 gear", "old  gear", "name70 x", "GEAR", None, "none"] * 30)
    want = {"name7 gear": "s7", "old  gear": "exact", "name70 x": "s70", "GEAR": "last", None: "Uncategorized", "none": "Uncategorized"}
    for table in (rules, rule_table(spark, rules)):
        got = K.classify(df, Rules(pattern_rules=table, exact_map=exact)).collect()
        assert len(got) == 180 and {(r[0], r["Subgroup"]) for r in got} == set(want.items())
    assert K.classify(df, Rules(pattern_rules=rule_table(spark, []))).where("Subgroup <> 'Uncategorized'").count() == 0


def test_a_million_rules(spark):
    n = 1_000_000
    word = F.concat(F.lit("lot"), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 12))
    rules = spark.range(n).select(F.col("id").alias("ordinal"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("^"), word, F.lit(r"\b.*x$"))).when(
        F.col("id") % 3 == 1, F.concat(word, F.lit("|"), F.reverse(word))).otherwise(F.concat(F.lit("(?:hot|cold) "), word)).alias("pattern"), F.concat(F.lit("s"), "id").alias("subgroup"))
    ids = [3, 4, 5, 999_996, 999_997, 999_998, 500_001]
    words = {r["id"]: r["w"] for r in spark.range(n).where(F.col("id").isin(ids)).select("id", word.alias("w")).collect()}
    texts = {f"{words[3]} and x": "s3", f"a {words[3]} x": None, f"see {words[4]}": "s4", words[4][::-1]: "s4", f"cold {words[5].upper()}": "s5", words[5]: None,
             f"{words[999_996]} x": "s999996", f"hot {words[999_998]} {words[999_997]}": "s999997", f"{words[500_001]} x {words[4]} x": "s4", "nothing at all": None}
    found = {r["text"]: r["subgroup"] for r in first_rule(spark.createDataFrame([(t,) for t in texts], "text string"), rules).collect()}
    assert found == {t: s for t, s in texts.items() if s}


def test_fold_keeps_what_matching_holds_equal(spark):
    got = spark.createDataFrame([("KSſIİiı",)], "t string").select(folded(F.col("t")).alias("f"), F.col("t").rlike("(?iu)^kssiiii$").alias("m")).first()
    assert got["f"] == "kssiiii" and got["m"]


def test_rules_of_one_file_are_dealt_over_tasks(spark):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rule_table(spark, [(f"widget{k}|gear{k % 3}", f"s{k}") for k in range(400)]).coalesce(1)
    filed = R._filed(rules)
    per_task = filed.groupBy(F.spark_partition_id()).agg(F.countDistinct("ordinal").alias("n")).collect()
    assert len(per_task) == n and max(r["n"] for r in per_task) < 100


def test_rarest_gram(spark):
    rules = rule_table(spark, [("hot ring", "a"), ("hot gear", "b"), ("hot", "c"), ("ring|gear", "d"), ("^.{4}$", "e")])
    got = sorted(tuple(r) for r in R._rarest(R._filed(rules)).collect())
    # least shared, then first by letters: hot, ' ge' and ' ri' stand in 3, 1 and 1 of the alternatives
    assert got == [(0, " ri"), (1, " ge"), (2, "hot"), (3, "ear"), (3, "ing")]
