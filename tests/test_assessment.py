"""Three-valued assessment: conflicts with their place, open questions, and origins of the bases of formations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lemmaweave.dictionary import TableDictionary, assess
from lemmaweave.operators.assessment import identities, judged
from lemmaweave.operators.attachment import conflict_of
from lemmaweave.operators.predicates import LEMMA, MORPH
from lemmaweave.rules import attachment as T

from .test_classes import random_analysis

SCHEMA = f"n int, lemmas array<{LEMMA}>, morphemes array<{MORPH}>, i int, class string, entry_id string"


def test_rules_as_columns_and_by_hand_agree(spark):
    rng = random.Random(23)
    rows = []
    for _ in range(4000):
        lemmas, morphemes, _ = random_analysis(rng)
        rows.append((lemmas, morphemes, rng.randrange(len(lemmas)), rng.choice(["V", "A", None]), rng.choice(["krdict:29738", "krdict:15980", "x"])))
    for rule, forms, *_ in T.RULES:
        for form in forms.split():
            for text in ("먹다", "맛있다", "아니다", "있다"):
                for marks in ([], [("었", "Prefinal")], [("시", "Prefinal")]):
                    rows += [([(text, "Predicate")], [*marks, (form, "Ending")], 0, kind, "x") for kind in "VA"]
    rows += [([("아니다", "Predicate")], [(form, "Ending")], 0, kind, "x") for form in T.NEGATIVE_COPULA.split() for kind in "VA"]
    got = {r.n: r.conflict for r in judged(spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA)).select("n", "conflict").collect()}
    wrong = [(r, conflict_of(*r), got[n]) for n, r in enumerate(rows) if conflict_of(*r) != (got[n] and got[n].rule)]
    assert wrong == []
    found = [(rows[n], c) for n, c in got.items() if c]
    assert len(found) > 500 and {c.rule for _, c in found} >= {r[0] for r in T.RULES} | {"ShortStemEnding", "AuxiliaryClass", "NegativeCopulaCommand"}
    # Only an auxiliary behind what has no ending is refused without a place.
    assert all(c.rule == "AuxiliaryClass" if c.morpheme is None else 0 <= c.morpheme < len(r[1]) for r, c in found)


@pytest.fixture(scope="module")
def openings(spark):
    """Whether a reading of one verb or adjective with these parts is open."""
    cases = [
        ("V", "거라", [], False), ("V", "거라", ["시"], True), ("A", "거라", [], True), ("V", "음세", [], False), ("V", "음세", ["었"], True), ("V", "으랴", ["었"], False), ("V", "으랴", ["더"], True),
        ("A", "구나", ["었"], False), ("A", "구나", ["더"], True), ("V", "더구나", [], True), ("V", "더구나", ["었"], False), ("V", "는구나", ["시"], False), ("V", "는구나", ["었"], True), ("V", "라던", ["시"], True), ("A", "라던", ["시"], False),
        ("A", "읍시다", [], True), ("V", "읍시다", [], False), ("V", "다", ["더"], False), (None, "다", [], False), ("V", "게나", ["시"], False), ("A", "게나", ["시"], True),
    ]
    rows = [(n, [("먹다", "Predicate")], [*[(m, "Prefinal") for m in marks], (form, "Ending")], 0, kind, "x") for n, (kind, form, marks, _) in enumerate(cases)]
    follow = [("으련", "요", True), ("으려니와", "도", True), ("다", "요", False)]
    rows += [(100 + n, [("먹다", "Predicate")], [(form, "Ending"), (particle, "Particle")], 0, "V", "x") for n, (form, particle, _) in enumerate(follow)]
    heads = [("있다", "단다", True), ("먹다", "느니라", False), ("있다", "구나", True), ("없다", "구나", False)]
    rows += [(200 + n, [(text, "Predicate")], [(form, "Ending")], 0, "V", "x") for n, (text, form, _) in enumerate(heads)]
    chains = [("먹다", None, "고", [], True), ("먹다", "V", "고", [], False), ("먹다", "V", "고", ["었"], False)]
    rows += [(300 + n, [(text, "Predicate"), ("나다", "Auxiliary")], [(c, "Ending"), *[(m, "Prefinal") for m in marks], ("더니", "Ending")], 0, kind, "x") for n, (text, kind, c, marks, _) in enumerate(chains)]
    rows.append((310, [("먹다", "Predicate"), ("나다", "Auxiliary")], [("고", "Ending"), ("었", "Prefinal"), ("더니", "Ending")], 1, "V", "x"))
    want = {n: c[-1] for n, c in enumerate(cases)} | {100 + n: c[-1] for n, c in enumerate(follow)} | {200 + n: c[-1] for n, c in enumerate(heads)} | {300 + n: c[-1] for n, c in enumerate(chains)} | {310: True}
    return rows, want


def test_what_notes_leave_open(spark, openings):
    rows, want = openings
    got = {r.n: r.open for r in judged(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {n: (rows[k][1:5], got[n]) for k, n in enumerate([r[0] for r in rows]) if got[n] != want[n]} == {}


def reading(word: str, lemmas: list, morphemes: list) -> tuple:
    return word, lemmas, morphemes, ["ending"], False, []


def test_assessment_is_three_valued(spark):
    schema = f"word string, lemmas array<{LEMMA}>, morphemes array<{MORPH}>, rules array<string>, unchanged boolean, spelling_paths array<array<string>>"
    readings = [
        reading("예쁜다", [("예쁘다", "Predicate")], [("는다", "Ending")]),
        reading("먹는다", [("먹다", "Predicate")], [("는다", "Ending")]),
        reading("먹시거라", [("먹다", "Predicate")], [("시", "Prefinal"), ("거라", "Ending")]),
        reading("싶다", [("싶다", "Predicate")], [("다", "Ending")]),
        reading("밝은다", [("밝다", "Predicate")], [("는다", "Ending")]),
        reading("집다", [("집다", "Predicate")], [("다", "Ending")]),
    ]
    entries = [("1", "예쁘다", "0", "형용사"), ("2", "먹다", "0", "동사"), ("3", "싶다", "0", "보조 형용사"), ("4", "밝다", "0", "형용사"), ("5", "밝다", "0", "동사"), ("6", "집다", "0", "명사")]
    d = TableDictionary(spark.createDataFrame(entries, "id string, headword string, homonym string, pos string"))
    got = {r.word: (r.status, [(c.entry_id, c.rule, c.morpheme) for c in r.conflicts]) for r in assess(spark.createDataFrame(readings, schema), d).collect()}
    assert got == {
        "예쁜다": ("incompatible", [("1", "PresentDeclarativeVerb", 0)]),
        "먹는다": ("compatible", []),
        "먹시거라": ("unknown", []),
        "싶다": ("unknown", []),  # what an auxiliary depends on stands outside of the word
        "밝은다": ("compatible", [("4", "PresentDeclarativeVerb", 0)]),  # of two entries one is enough; the other's conflict stays told
        "집다": ("incompatible", [("6", "LexicalRole", None)]),
    }


def test_origins_tell_homonyms_apart(spark):
    schema = f"word string, lemmas array<{LEMMA}>, morphemes array<{MORPH}>, rules array<string>, unchanged boolean, spelling_paths array<array<string>>"
    two = [("되다", "Suffix"), ("다", "Ending")]
    readings = [reading("가설되다", [("가설", "Nominal")], two), reading("가설", [("가설", "Nominal")], []), reading("각색되다", [("각색", "Nominal")], two), reading("모름되다", [("모름", "Nominal")], two)]
    rows = [("1", "가설", "1", "명사", ["假設"]), ("2", "가설", "2", "명사", ["加設"]), ("3", "가설", "3", "명사", None), ("4", "각색", "1", "명사", ["各色"]), ("5", "각색", "2", "의존 명사", ["脚色"]), ("6", "모름", "0", "명사", ["x"])]
    d = TableDictionary(spark.createDataFrame(rows, "id string, headword string, homonym string, pos string, origins array<string>"))
    origins = spark.createDataFrame([("가설", "되다", ["假設"], True), ("가설", "되다", ["架設"], True), ("각색", "되다", ["脚色"], False), ("가설", "하다", ["加設"], True)], "base string, suffix string, expected array<string>, complete boolean")
    out = assess(spark.createDataFrame(readings, schema), d, origins=origins)
    got = {r.word: {(x.entry_id, x.relation, x.morpheme, tuple(x.expected)) for x in r.identities} for r in out.collect()}
    both = ("假設", "架設")
    assert got == {
        "가설되다": {("1", "recorded_match", 0, both), ("2", "recorded_difference", 0, both), ("3", "unknown", 0, both)},
        "가설": set(),
        "각색되다": {("4", "unknown", 0, ("脚色",))},  # not all origins are known, and the other entry is no noun
        "모름되다": set(),
    }
    assert {r.status for r in out.where("word = '가설되다'").collect()} == {"compatible"}  # an identity decides nothing
    empty = identities(spark.createDataFrame([], SCHEMA).withColumn("recorded", F.lit(None).cast("array<string>")), origins)
    assert empty.count() == 0
