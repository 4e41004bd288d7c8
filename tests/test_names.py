"""Names against an alias table by words; brute force over all pairs."""

import itertools
import random

from panel_rows import rows
from panelyard.operators.names import match_names, resolve_matched

ALIASES = [
    ("Bolivia", "BOL"), ("Republic of Korea", "KOR"), ("Democratic People's Republic of Korea", "PRK"), ("Viet Nam", "VNM"),
    ("Guinea", "GIN"), ("Guinea-Bissau", "GNB"), ("Congo, Dem. Rep.", "COD"), ("Congo, Rep.", "COG"), (None, "ZZZ"), ("Nowhere", None),
]
RULES = {"words": {"rep": "republic", "dem": "democratic"}, "ignore": ["of", "the", "state", "plurinational", "s"]}


def matched(spark, names, aliases=ALIASES, **rules):
    df = spark.createDataFrame([(n,) for n in names], "name string")
    known = spark.createDataFrame(aliases, "alias string, countrycode string")
    return df, match_names(df, "name", known, **rules)


def test_user_rules_resolve_and_report(spark):
    names = ["Bolivia (Plurinational State of)", "Korea, Rep.", "Korea, Dem. People's Rep.", "viet nam", "Guinea", "Bissau",
             "Congo", "Atlantis", "Nowhere", "", None, "Atlantis", "of the"]
    df, got = matched(spark, names, **RULES)
    table = {r["name"]: (r["rows"], r["status"], r["code"]) for r in got.collect()}
    assert table == {
        "Bolivia (Plurinational State of)": (1, "words", "BOL"), "Korea, Rep.": (1, "words", "KOR"),
        "Korea, Dem. People's Rep.": (1, "words", "PRK"), "viet nam": (1, "exact", "VNM"), "Guinea": (1, "exact", "GIN"),
        "Bissau": (1, "contained", "GNB"), "Congo": (1, "contained", "COG"), "Atlantis": (2, "unknown", None),
        "Nowhere": (1, "unknown", None), "": (1, "unknown", None), None: (1, "unknown", None), "of the": (1, "unknown", None),
    }
    assert resolve_matched(df, "name", got).count() == len(names)


def test_ambiguous_names_keep_their_candidates(spark):
    _, got = matched(spark, ["United"], [("United States", "USA"), ("United Kingdom", "GBR"), ("Arab", "X")])
    assert rows(got) == [("United", 1, "ambiguous", None, ["GBR", "USA"])]
    _, got = matched(spark, ["a b"], [("a b", "A"), ("A-B", "B")])
    assert rows(got) == [("a b", 1, "ambiguous", None, ["A", "B"])]
    assert matched(spark, ["x"], [])[1].collect()[0]["status"] == "unknown"
    assert matched(spark, [])[1].count() == 0


def test_patterns_come_before_words(spark):
    _, got = matched(spark, ["Korea South"], patterns=[("^korea south$", "republic of korea")], **RULES)
    assert rows(got) == [("Korea South", 1, "words", "KOR", ["KOR"])]


def test_against_all_pairs(spark):
    draw = random.Random(5)
    text = lambda: " ".join(draw.choice("abcdefg") for _ in range(draw.randrange(1, 5)))
    aliases = [(text(), f"C{i % 9}") for i in range(25)]
    names = sorted({text() for _ in range(120)})
    want = {}
    for n in names:
        own, ranked = set(n.split()), []
        for a, c in aliases:
            words = set(a.split())
            if a == n:
                ranked.append((0, 0, c))
            elif own <= words or words <= own:
                ranked.append((1 if own == words else 2, len(own ^ words), c))
        first = min(ranked)[:2] if ranked else None
        want[n] = sorted({c for *r, c in ranked if tuple(r) == first}) if ranked else None
    _, got = matched(spark, names, aliases)
    assert {r["name"]: r["candidates"] for r in got.collect()} == want
    assert len(set(itertools.chain(*(c or [] for c in want.values())))) > 3
