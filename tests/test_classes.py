"""The class scan over columns against the scan of single analyses."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lemmaweave.operators.classes import _DERIVED, checked, class_scan, classes_allow
from lemmaweave.operators.predicates import LEMMA, MORPH
from lemmaweave.rules import auxiliaries as A
from lemmaweave.rules import endings as E

SCHEMA = f"n int, lemmas array<{LEMMA}>, morphemes array<{MORPH}>, rules array<string>"
FORMS = [*A.LINKS, *(f for row in A.REFUSED for f in row[0].split()), *E.PRESENT_DECLARATIVE.split(), "다", "어요", "요"]
STEMS = [*A.auxiliary_stems(), *"않 아니하 못하 있 계시".split()]


def random_analysis(rng: random.Random) -> tuple:
    lemmas, morphemes, rules = [], [], rng.sample([*_DERIVED, "lexical.doeda.complement", "lexical.doeda.extended", "compound.predicate.well_doeda", "doeda.negative_bridge", "auxiliary", "ending"], rng.randrange(4))
    for _ in range(rng.randrange(1, 5)):
        role = rng.choice(["Predicate", "Auxiliary", "Auxiliary", "Copula", "Nominal", "Adverbial"])
        text = {"Auxiliary": lambda: rng.choice(STEMS) + "다", "Copula": lambda: "이다", "Nominal": lambda: rng.choice(["집", "사회적", "학생"]), "Adverbial": lambda: rng.choice(["잘", "안"])}.get(role, lambda: rng.choice(["되다", "가다", "있다", "재미있다"]))()
        lemmas.append((text, role))
        if rng.random() < 0.3:
            morphemes += [(rng.choice(["화", "시", "적", "답다", "되다", "하다"]), rng.choice(["Suffix", "Suffix", "Prefix"])) for _ in range(rng.randrange(1, 3))]
        if role != "Nominal" and rng.random() < 0.9:
            morphemes += [(rng.choice(["었", "시", "겠", "더"]), "Prefinal") for _ in range(rng.choice([0, 0, 1, 2]))]
            morphemes.append((rng.choice(rng.choice(FORMS).split()), "Ending"))
        if rng.random() < 0.2:
            morphemes.append((rng.choice(["요", "도", "는"]), "Particle"))
    return lemmas, morphemes, rules


def test_columns_and_single_analyses_agree(spark):
    rng = random.Random(17)
    rows = [random_analysis(rng) for _ in range(6000)]
    # Every refusal with every class, bare and marked.
    for forms, *_ in A.REFUSED:
        for form in forms.split():
            for stem, role in (("보", "Auxiliary"), ("듯하", "Auxiliary"), ("이", "Copula"), ("않", "Auxiliary"), ("있", "Auxiliary")):
                for marks in ([], [("었", "Prefinal")]):
                    rows.append(([("가다", "Predicate"), (stem + "다", role)], [(rng.choice(["어", "을", "지"]), "Ending"), *marks, (form, "Ending")], ["auxiliary"]))
    for noun, ending in (("사회", "는다"), ("사회", "으면"), ("집", "는다")):  # a relational copula with an intention
        rows.append(([(noun, "Nominal"), ("이다", "Copula"), ("하다", "Auxiliary")], [*([("적", "Suffix")] if noun == "사회" else []), ("으려고", "Ending"), (ending, "Ending")], []))
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA)
    got = {r.n: (r.scan.ok, r.scan.intends) for r in df.select("n", class_scan().alias("scan")).collect()}
    verdicts = [classes_allow(*r) for r in rows]
    wrong = [(rows[n], v, got[n]) for n, v in enumerate(verdicts) if got[n][0] != (v is not None) or (v is not None and got[n][1] != bool(v))]
    assert wrong == []
    assert 500 < sum(v is None for v in verdicts) < len(rows) - 500 and any(verdicts)


def test_no_python_in_checked(spark):
    rows = [([("가다", "Predicate"), ("있다", "Auxiliary")], [("고", "Ending"), ("는", "Ending")], ["auxiliary"]), ([("집", "Nominal")], [], ["identity"])]
    df = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], SCHEMA)
    out = checked(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and out.columns == df.columns
    assert out.where(F.size("lemmas") > 0).count() == 2


def test_expressions_are_built_once(spark):
    """The class scan and the columns of a level cost seconds to build; each is built once an application, by its arguments."""
    from lemmaweave.operators import classes, nominals, predicates

    assert classes.class_scan() is classes.class_scan() and nominals._level_columns() is nominals._level_columns()
    assert nominals._nominal_ways("text") is nominals._nominal_ways("text") and nominals._nominal_ways("text") is not nominals._nominal_ways("base")
    assert predicates._own_conditions("text") is predicates._own_conditions("text")
