"""Auxiliary predicates: which connective ending may join which auxiliary stem, their classes, and what classes endings refuse."""

from __future__ import annotations

from . import endings as E

# Connective ending, auxiliary stems.
LINKS = {
    "어": "보 주 드리 들 버리 놓 두 가 오 지 있 내 대 계시 나가 나 가지 갖 달 마지아니하 마지않 먹 버릇하 빠지 쌓 재끼 젖히 죽 치우 터지 하",
    "고": "있 싶 말 계시 나 들 보 자빠지 하",
    "지": "않 못하 말 아니하",
    "게": "되 하 생기",
    "게끔": "되 하",
    "어야": "하",
    "은 는": "듯하 듯싶 양하 척하 체하",
    "을": "듯하 듯싶 만하 법하 뻔하 성싶",
    "음": "직하",
    "으려 으려고": "들 하",
    "기로 자고": "들",
    "다 다가": "보 못하",
    "다": "싶",
    "으려다 으려다가": "보",
    "어다 어다가": "주 드리 놓 두 달",
    "으려나": "보",
    "으려니": "하 싶",
    "는가 은가 던가 나 을까": "보 싶",
    "으면": "하 싶",
    "기도 기는 기만 고자": "하",
}
#: Endings of 달다 as an auxiliary.
REQUESTS = """
으라 으라고 으라는 으란 으래 으란다 으라지 으라죠 으라지만 으라니까 으라면 으랍니다 으라네 으라는데 으라더니 으랍니까 으랍디까 으랍디다 으라던 으라던데 으라며 으라면서 으라니 으라느니 으라거나
으라는구나 으라는군 으라더군 으라더군요 오
"""

# The class of an auxiliary, by stem, or by stem and connector.
ADJECTIVES = "듯싶 듯하 만하 법하 뻔하 성싶 싶 직하"
VERBS = "가 가지 갖 계시 나가 나 내 놓 달 대 두 드리 들 마지아니하 마지않 말 먹 버릇하 버리 빠지 생기 쌓 오 있 자빠지 재끼 젖히 주 죽 지 척하 체하 치우 터지"
BY_CONNECTOR = {
    "보": {"V": "어 다가 으려다 으려다가", "A": "는가 은가 던가 나 을까 으려나"},
    "되": {"V": "어야 으면 어도 어서 어서는 어"},
    "하": {"V": "어 게 게끔 어야 으려 으려고 고자 으면"},
    "못하": {"A": "다 다가"},
}
INHERITING = "않 아니하 못하"

# Endings that a class refuses. Classes: V verb, A adjective, C copula. bare: right after the stem only.
# but: lemmas to which it does not apply (* stands for any beginning); unless: stative, see Owner.
NEGATIVE, EXISTENTIAL = "않다 아니하다 못하다", "*있다 *없다 계시다"
REFUSED: list[tuple[str, str, bool, str, bool]] = [
    ("은감 은고", "V", True, NEGATIVE, False),
    ("는감 는고", "C", True, NEGATIVE, False),
    ("는감 는고", "A", True, f"{NEGATIVE} 있다 없다 계시다", False),
    ("느니라", "AC", True, NEGATIVE, False),
    ("으니라", "V", True, f"{NEGATIVE} 있다 계시다", False),
    ("느냐지만 느냐니까 느냬", "A", True, f"{NEGATIVE} *있다 *없다", False),
    (E.FACTUAL_EXCLAMATION, "VA", True, "아니다", False),
    (E.VERBAL_QUESTION, "AC", True, f"{NEGATIVE} {EXISTENTIAL}", False),
    ("음세 으련 으렴 으려무나 게나 세나", "AC", True, "", False),
    (f"{E.NEUNI} 는걸 는바", "AC", True, EXISTENTIAL, False),
    (E.PRESENT_EXCLAMATION, "AC", True, "", False),
    ("구먼", "V", True, NEGATIVE, True),
    ("다마는 다만 답시고", "V", True, "", True),
    ("니만", "V", True, "", False),
    ("나이다 나이까", "AC", True, f"{NEGATIVE} 있다 없다 계시다", False),
    (f"{E.VERBAL_INTENTION} 어다 어다가 느라 느라고 {E.PRESENT_DECLARATIVE}", "AC", False, "", False),
    (E.VERBAL_REPORTS, "A", False, "", False),
    ("는 는데 는데요 는데도 는데다가 는지 는가 는가요 느냐 느냐느니 느냐고 느냐는 느냐며 느냐면서 느냐니 느냔 느냔다", "A", True, "", False),
    (" ".join(f for f in E.ADJECTIVAL_QUESTION.split() if f != "으냐면"), "V", True, "", False),
    ("으냐면 다거나 다든가 다네 다는데 다던 다던데 다며 다면서 단다 다지 다죠 다지만 다니까 다느니 다는구나 다는군 다더군 다더군요 대", "V", True, "", True),
]


def link_rows() -> list[tuple[str, str]]:
    return sorted({(c, s) for cs, stems in LINKS.items() for c in cs.split() for s in stems.split()})


def auxiliary_stems() -> list[str]:
    return sorted({s for _, s in link_rows()})
