"""Particles: form, class (the slot in a chain) and what the base must end in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import table

# Fixed values. Condition: 0 any base, 1 closed, 2 open, 3 closed but not by ㄹ, 4 open or ㄹ.
# Class: 1 case, 2 adnominal or role, 3 restrictive or extent, 4 topic, additive or choice, 5 distributive, 6 polite.
PARTICLES = {
    (1, 0): "에 에야 에다 에다가 에서 서 에게 에게다 에게다가 에게서 게 게서 한테 한테다 한테다가 보고 더러 한테서 께 께서 보다 처럼 같이 하고",
    (1, 1): "이 을 과 이라고 이랑 이나 이든지 이든가 이야 아 이여 이시여",
    (1, 2): "가 를 와 라고 랑 나 든지 든가 야 여 시여",
    (2, 0): "의 게로 에게로 한테로",
    (2, 3): "으로 으로서 으로써 으로다가",
    (2, 4): "로 로서 로써 로다가",
    (3, 0): "설랑 에설랑 만 마는 그려 그래 까지 부터 에서부터 서부터 마다 만큼 만치 마냥 토록 대로 조차 마저 깨나 밖에 치고 치고는 치고서",
    (3, 1): "을랑 일랑",
    (3, 2): "다 다가",
    (3, 3): "으로부터",
    (3, 4): "로부터",
    (4, 0): "도 커녕 인들 설랑은",
    (4, 1): "은 이나 이라도 이라야 이라야만 이든지 이든가 이라든가 이라든지 이야 이야말로 이나마 은커녕 이란 을랑은 일랑은 이다",
    (4, 2): "는 나 라도 라야 라야만 든지 든가 라든가 라든지 야 야말로 나마 는커녕 란 다",
    (5, 0): "들",
    (6, 0): "요",
}
#: Pairs (inner, outer) that the order of classes alone would refuse.
LINKS = [
    ("까지", "가"), ("까지", "를"), ("까지", "에"), ("까지", "로"), ("까지", "로부터"), ("부터", "가"), ("으로부터", "가"), ("로부터", "가"), ("에서부터", "가"), ("서부터", "가"),
    ("까지", "만"), ("부터", "만"), ("으로부터", "만"), ("로부터", "만"), ("에서부터", "만"), ("서부터", "만"),
    ("마다", "에"), ("까지", "조차"), ("까지", "마저"), ("조차", "가"), ("조차", "를"), ("마저", "가"), ("마저", "를"), ("에", "처럼"), ("에서", "처럼"), ("서", "처럼"),
]
#: The class of the case that a source particle starts with: it decides what may stand before it.
SOURCES = {"으로부터": 2, "로부터": 2, "에서부터": 1, "서부터": 1}
#: Particles before which no other may stand.
FIRST_ONLY = "커녕 란 이란 이라든가 이라든지 치고 치고는 치고서 토록 마냥 깨나 게로 에게로 한테로 을랑 을랑은 일랑 일랑은 에설랑"
#: Particles before which only these may stand.
AFTER = {"ㄹ랑 ㄹ랑은": "에 에서 서", "설랑 설랑은": "에", "다 다가": "에 에서 서 에게 게 한테 께 로 으로"}
#: Particles of focus, which also follow adverbs; and more before which no subject or object stands.
FOCUS = "이야말로 야말로 이나마 나마 은커녕 는커녕 라든가 라든지 이라야 라야 ㄴ들 인들"
NO_SUBJECT = f"{FOCUS} 든가 이든가 이라야만 라야만"
#: Particles of choice by family; a chain has one of each.
CHOICE = {"이나": 0, "나": 0, "이라도": 1, "라도": 1, "이든지": 2, "든지": 2, "이든가": 2, "든가": 2, "이야": 3, "야": 3, "이라든가": 4, "라든가": 4, "이라든지": 4, "라든지": 4}
#: Particles that follow an adverb as they follow a noun.
ADVERBIAL = "도 은 는 만 까지 부터"
EMPHATIC_ADVERBS = {"도대체": "가", "맘껏": "을", "매번": "을", "매일": "을", "빨리": "를", "곧이": "를"}
ADDITIVE_ADVERBS = "잠깐 조금 천천히"
#: Bases of emphatic 다 and 다가.
PLACES = {"여기": "Nominal", "거기": "Nominal", "저기": "Nominal", "어디": "Nominal", "이리": "Adverbial", "그리": "Adverbial", "저리": "Adverbial"}
#: Particles that end a clause, not a noun.
CLAUSE_ONLY = "마는 그려 그래"
#: Particles that are written as one and may also be read as two.
BUNDLES = {"에야": ("에", "야"), "이라야만": ("이라야", "만"), "라야만": ("라야", "만")}
#: Shortened particles: what is left of them (a coda of the base, and a tail), the particle, its class, the rule.
SHORTENED = [
    (4, "", "는", 4, "particle.contraction.n"), (8, "", "를", 1, "particle.contraction.l"), (8, "", "를", 4, "particle.contraction.l"), (4, "커녕", "는커녕", 4, "particle.contraction.nkeonyeong"),
    (4, "들", "ㄴ들", 4, "particle.coda"), (8, "랑", "ㄹ랑", 3, "particle.coda"), (8, "랑은", "ㄹ랑은", 4, "particle.coda"),
]

# Whole pronoun and 것 forms: surface, lemma, particle, class, rule.
PRONOUNS = [
    ("내가", "나", "가", 1, "pronoun"), ("네가", "너", "가", 1, "pronoun"), ("제가", "저", "가", 1, "pronoun"), ("누가", "누구", "가", 1, "pronoun"), ("내", "나", "의", 2, "pronoun"), ("네", "너", "의", 2, "pronoun"), ("제", "저", "의", 2, "pronoun"),
    ("뭘", "뭐", "를", 1, "pronoun.contraction"), ("뭘", "무엇", "을", 1, "pronoun.contraction"),
]
GEOT = [("게", "이", "가", 1), ("건", "는", "는", 4), ("걸", "를", "를", 1)]


def particle_rows() -> list[tuple[str, int, int]]:
    return [(f, c, k) for (c, k), forms in PARTICLES.items() for f in forms.split()]


def particles(spark: SparkSession) -> DataFrame:
    return table(spark, "particles", particle_rows(), "particle string, class int, condition int")


def recoveries(spark: SparkSession) -> DataFrame:
    """key (the suffix that is taken off, after the coda that the base gives back and a colon), chars, coda, particle, class, condition, contraction, before (the class that decides what may stand before)."""
    rows = [(f, len(f), None, f, c, k, None, SOURCES.get(f, c)) for f, c, k in particle_rows()]
    rows += [(f"{coda}:{tail}", len(tail), coda, f, c, 0, rule, c) for coda, tail, f, c, rule in SHORTENED]
    return table(spark, "particle_recoveries", rows, "key string, chars int, coda int, particle string, class int, condition int, contraction string, before int")


def links(spark: SparkSession) -> DataFrame:
    return table(spark, "particle_links", LINKS, "inner string, outer string")


def pronouns(spark: SparkSession) -> DataFrame:
    """surface, lemma, particle, class and rule; 것 and 거 forms included."""
    rows = list(PRONOUNS) + [(s, lemma, p, k, "nominal.contraction") for s, p, _, k in GEOT for lemma in ("거", "것")]
    for a in "이그저":
        for s, p, short, k in GEOT:
            rows += [(a + s, a + "거", short, k, "pronoun.contraction"), (a + s, a + "것", {"이": "이", "는": "은", "를": "을"}[p], k, "pronoun.contraction")]
    return table(spark, "pronouns", rows, "surface string, lemma string, particle string, class int, rule string")
