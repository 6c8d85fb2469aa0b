"""Terminal endings, prefinal markers and their licences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.hangul import split_char, with_initial
from . import table

# ---- fixed values: canonical forms of endings by the boundary they need --------------------------

QUOTED = """
단 다간 다가는 답니다 단다 대 다지 다죠 다지만 다니까 다느니 다네 다는데 다던 다더니 다나 다오 답니까 답디까 답디다 담 다더니만 다더니마는 다던데 다며 다면서 다거나 다든가 다가 다는구나 다는군 다더군 다더군요 다마는 다만 답시고 다마다 다고 다는 다니 다면 잔
자느니 자는구나 자는군 자더군 자더군요 자지만 자니까 잔다 재 자던 자던데 자니 자며 자면서 자고 자는 자거나 자면 자마자 냔 냐느니 냐지만 냐니까 냔다 냬 냐던데 냐니 냐며 냐면서 냐는구나 냐는군 냐더군 냐더군요 냐면 냐고 냐는 느냔 느냐느니 느냐지만 느냐니까
느냔다 느냬 느냐던데 느냐니 느냐며 느냐면서 느냐는구나 느냐는군 느냐더군 느냐더군요 느냐면 느냐고 느냐는 더래 더라느니 더라지만 더라니까 더란다 더라네 더라는데 더라며 더라면서 더라니 더라는구나 더라는군 더라도 더라고 더라는 라는구나 라는군 라더군 라더군요
"""
LITERAL = """
다 자 냐 느냐 더라 남 고자 건대 구나 구려 구먼 는구나 는구려 는구먼 는군 는군요 더구나 더구려 더구먼 로구나 로구려 로구먼 로군 군 군요 는가 는가요 는감 는고 는데도 는데다가 느니라 느니 느니만 느니만큼 느니보다 느니보다는 나이다 나이까 느라고 느라 고 고말고
고서 고요 지만 지마는 건만 건마는 지만요 지 지요 죠 게 게끔 게요 도록 듯 듯이 기에 길래 든지 든가 든 더니 더니만 더니마는 더군요 더군 던 는바 는걸 던걸 던바 던데 던데요 던가 던감 던고 던지 던들 나 나요 네 네요 는 는데 는데요 는지 니 기 기로 기로서
기로서니 기가 기는 기도 기만 기를 기보다 거든 거든요 건 거나 거니 거니와 소 오 잖아 잖아요
"""
#: Forms whose first syllable is the 어 of the boundary.
AEO = """
어 어요 어서 어서야 어도 어야 어야지 어야죠 어라 어다 어다가 어서는 어서도
"""
#: Forms whose first syllable is the 으 of the boundary.
EU = """
으면 으니까 으니 으니만큼 으니라 으며 으면서 으므로 으러 으려고 으려면 으려 으렵니까 으렵니다 으련 으렴 으려무나 으려는 으려는가 으려는지 으려나 으려니 으려니까 으려더라 으려던 으려면서 으려든지 으려거든 으려기에 으려는데 으려다 으려다가 으려더니 으려도 으려야
으라 으라고 으라는 으란 으란다 으래 으라지 으라죠 으라지만 으라니까 으라면 으랍니다 으라네 으라는데 으라던 으라더니 으랍니까 으랍디까 으랍디다 으라던데 으라며 으라면서 으라니 으라느니 으라는구나 으라는군 으라더군 으라더군요 으라거나 으세요 으십시오 으소서 으옵소서
으냐 으냐고 으냐면 으냐던데 으냐지만 으냐니까 으냔다 으냬 으냐는 으냐며 으냐면서 으냐니 으냐느니 으냐는구나 으냐는군 으냐더군 으냐더군요 으냔 으나 으나마 으리라 으리라고 으리다 으리까 으랴 으리만큼 으련마는 으련만 으려니와
"""
EU_ATTACHED = """
은 은데 은바 은걸 은지 은가 은감 은고 은가요 은데도 은데다가 은들 을 을걸 을까 을까요 을꼬 을세 을세라 을거나 을뿐더러 을게 을게요 을래 을래요 을지 을는지 을라 을라고 을라고요 을지라도 을밖에 을라치면 을망정 을지언정 을수록 음 음세 읍시다
"""
CONSONANT_ATTACHED = """
습니다 습니까 습디다 습디까 습지요 습죠 습네 는다 는다마는 는다만 는답시고 는다고 는다는 는다면 는답니다 는다네 는다는데 는다던 는다더니 는다나 는다오 는답니까 는답디까 는답디다 는담 는다더니만 는다더니마는 는다던데 는다며 는다면서 는다니 는다느니 는다는구나
는다는군 는다더군 는다더군요 는단 는단다 는대 는다지 는다죠 는다지만 는다니까 는다거나 는다든가
"""
SHORT_HADA = """
기 기로 기가 기는 기도 기만 기를 기보다 게 게요 지 지요 지만 지마는 지만요 다 다고 다는 다니 다느니 다면 도록 고자 건대
"""
COPULAR = """
라 라도 라야 라야만 라서 라고 라는 라면 랍니다 란다 래 라지 라죠 라지만 라니까 라든가 라네 라는데 라더니 랍니까 랍디까 랍디다 라던 라던데 라며 라면서 라니 라느니 라는구나 라는군 라더군 라더군요 냐면
"""
#: After an open nominal whose copula is left out: separate endings, those that start with 으, and those whose coda the nominal takes.
OMITTED = """
지 지요 죠 냐 냐고 니 고 지만 지마는 건만 건마는 지만요 거든 거든요 네 네요 더라 더라고 더군 더군요 더니 더니만 더니마는 더라도 던데 던데요 던가 던지 더라네 더라는데 더라며 더라면서 더라니 더라느니 냐느니 더란다 더래 냬 더라지만 더라니까 냐지만 냐니까 냔다
냔 던걸 구나 군 군요 구려 구먼 더구나 더라는구나 더라는군 냐더군요 더구려 더구먼 로구나 로구려 로구먼 로군 냐던데 냐는구나 냐는군 냐더군
"""
OMITTED_EU = """
으면 으니 으니라 으니까 으세요 으리만큼 으련만 으련마는 으려니 으리까 으랴 으려니와
"""
OMITTED_ATTACHED = """
은데 은지 은가 은고 은가요 은걸 을까 을까요 을꼬 을거나 을뿐더러 을지 을걸 습니다 습니까 습디다 습디까 습지요 습죠 습네
"""
VARIANTS = {"구만": "구먼", "는구만": "는구먼", "더구만": "더구먼", "로구만": "로구먼"}
CONNECTORS = """
어 고 지 게 게끔 어야 도록 어도 어서 어서는 은 는 을 음 으려 으려고 기로 자고 다 다가 으려다 으려다가 으려나 으려니 어다 어다가 는가 은가 던가 나 을까 으면 기 기도 기는 기만 고자 거나 거니 건 든지 든 을지
"""
#: Endings that the conjectural 으리 may precede.
CONJECTURAL = """
니 니라 란 라 라도 라서 라고 라면 랍니다 랍니까 랍디까 랍디다 란다 래 라지 라죠 라지만 라니까 라든가 라네 라는데 라던 라던데 라며 라면서 라니 라느니 라는구나 라는군
라더군 라더군요
"""
#: Short imperatives of 말다.
SHORT_MAL = {"마": "어", "마라": "어라", "마요": "어요"}

_CODA = {"은": 4, "는": 4, "을": 8, "음": 16, "읍": 17, "습": 17}
_ASPIRATED = {0: 15, 3: 16, 12: 14}  # ㄱ ㄷ ㅈ to ㅋ ㅌ ㅊ


def ending_rows() -> list[tuple[str, str, str, int | None, bool]]:
    """(suffix, form, boundary, coda, connector) of every ending."""
    rows: set[tuple[str, str, str, int | None]] = set()
    rows |= {(f, f, "Literal", None) for f in LITERAL.split() + QUOTED.split()}
    rows |= {(v, f, "Literal", None) for v, f in VARIANTS.items()}
    rows |= {("네", "습네", "Literal", None), ("게나", "게나", "Literal", None), ("세나", "세나", "Literal", None), ("거라", "거라", "Literal", None), ("너라", "너라", "ComeStem", None), ("", "ㄴ", "Attached", 4)}
    rows |= {("되", "으되", "Literal", None), ("으되", "으되", "Literal", None), ("니만", "니만", "EuZero", None), ("요", "요", "Copular", None), ("요", "요", "OmittedCopula", 0), ("란", "란", "Literal", None), ("란", "란", "ZeroCopula", None), ("세", "을세", "OmittedCopula", 8)}
    rows |= {(f[1:], f, "Aeo", None) for f in AEO.split()}
    rows |= {(f, f, "EuFull", None) for f in EU.split()} | {(f[1:], f, "EuZero", None) for f in EU.split()}
    for f in EU_ATTACHED.split():
        rows |= {(f, f, "EuFull", None), (f[1:], f, "Attached", _CODA[f[0]])}
    for f in CONSONANT_ATTACHED.split():
        rows |= {(f, f, "Consonant", None), (f[1:], f, "Attached", _CODA[f[0]])}
    for f in SHORT_HADA.split():
        rows |= {(f, f, "HaDeletion", None), (with_initial(f, _ASPIRATED[split_char(f[0])[0]]), f, "HaAspiration", None)}
    for f in COPULAR.split():
        rows |= {(f, f, b, None) for b in ("Copular", "ZeroCopula", "Literal")}
    rows |= {("라거나", "라거나", b, None) for b in ("Copular", "ZeroCopula")}
    rows |= {(f, f, "OmittedCopula", 0) for f in OMITTED.split()} | {(f[1:], f, "OmittedCopula", 0) for f in OMITTED_EU.split()}
    rows |= {(f[1:], f, "OmittedCopula", _CODA[f[0]]) for f in OMITTED_ATTACHED.split()}
    rows |= {(v, f, "OmittedCopula", 0) for v, f in VARIANTS.items() if v != "는구만"}
    connect = set(CONNECTORS.split())
    return sorted(((s, f, b, c, f in connect) for s, f, b, c in rows), key=str)


def conjectural_rows() -> list[tuple[str, str, str, int | None, bool]]:
    """Rows like those of ending_rows, whose suffix starts with the conjectural marker."""
    forms = [(f, "으니라" if f == "니라" else f) for f in CONJECTURAL.split()]
    return [(m + f, form, b, None, False) for f, form in forms for m, b in (("으리", "EuFull"), ("리", "EuZero"))]


def endings(spark: SparkSession) -> DataFrame:
    """suffix, form, boundary, attached, connector, whether the conjectural marker stands in the suffix, and why (rules)."""
    from .provenance import rules_of

    rows = [(*r, False) for r in ending_rows()] + [(*r, True) for r in conjectural_rows()]
    rows = [(*r, rules_of(*r[:3], r[-1])) for r in rows]
    return table(spark, "endings", rows, "suffix string, form string, boundary string, attached int, connector boolean, conjectural boolean, why array<string>")


# ---- prefinal markers ----------------------------------------------------------------------------

# Marker, surface suffix, boundary, coda, least stage, next stage, polite slot, rule, what must follow.
# open / closed: the form that the following ending selects; consonant: no vowel of any kind; any: no demand.
MARKERS = [
    ("더", "더", "Literal", None, 5, 4, False, "prefinal.retrospective", "any"),
    ("더", "더", "OmittedCopula", 0, 5, 4, False, "prefinal.retrospective", "any"),
    ("으옵", "으오", "EuFull", None, 4, 3, True, "prefinal.polite", "open"),
    ("으옵", "오", "EuZero", None, 4, 3, True, "prefinal.polite", "open"),
    ("으옵", "오", "OmittedCopula", 0, 4, 3, True, "prefinal.polite", "open"),
    ("으옵", "으옵", "EuFull", None, 4, 3, True, "prefinal.polite", "closed"),
    ("으옵", "옵", "EuZero", None, 4, 3, True, "prefinal.polite", "closed"),
    ("사옵", "사오", "ClosedStem", None, 4, 3, True, "prefinal.humble_saop", "open"),
    ("사옵", "사옵", "ClosedStem", None, 4, 3, True, "prefinal.humble_saop", "closed"),
    ("삽", "삽", "ClosedStem", None, 4, 3, True, "prefinal.humble_sap", "consonant"),
    ("자옵", "자오", "Literal", None, 0, 0, True, "prefinal.lexical_jaop", "open"),
    ("자옵", "자옵", "Literal", None, 0, 0, True, "prefinal.lexical_jaop", "closed"),
    ("잡", "잡", "Literal", None, 0, 0, True, "prefinal.lexical_jap", "consonant"),
    ("자옵시", "자옵시", "Literal", None, 1, 0, True, "prefinal.lexical_jaopsi", "any"),
    ("으옵시", "으옵시", "EuFull", None, 1, 3, True, "prefinal.honorific_polite", "any"),
    ("으옵시", "옵시", "EuZero", None, 1, 3, True, "prefinal.honorific_polite", "any"),
    ("사옵시", "사옵시", "ClosedStem", None, 1, 3, True, "prefinal.honorific_polite", "any"),
    ("겠", "겠", "Literal", None, 3, 2, False, "prefinal.modal", "any"),
    ("겠", "겠", "OmittedCopula", 0, 3, 2, False, "prefinal.modal", "any"),
    ("어야겠", "야겠", "Aeo", None, 3, 2, False, "prefinal.obligation", "any"),
    ("시", "으시", "EuFull", None, 1, 0, False, "prefinal.honorific", "any"),
    ("시", "시", "EuZero", None, 1, 0, False, "prefinal.honorific", "any"),
    ("시", "시", "OmittedCopula", 0, 1, 0, False, "prefinal.honorific", "any"),
]
#: Stems that take 자옵, 잡 and 자옵시.
JAOP_STEMS = ("듣", "묻", "받", "좇")


def markers(spark: SparkSession) -> DataFrame:
    return table(spark, "markers", MARKERS, "marker string, suffix string, boundary string, attached int, least int, next int, polite boolean, rule string, follow string")


# ---- licences: which prefinal markers an ending admits -------------------------------------------

# Fixed values. HONORIFIC and TENSE are sets of markers; each family of endings has its own.
HONORIFIC = ("시", "으옵시", "사옵시", "자옵시")
TENSE = ("었", "겠", "어야겠")
PRESENT_DECLARATIVE = """
는다 는다마는 는다만 는답시고 는다고 는다는 는다면 는답니다 는다거나 는다든가 는다네 는다는데 는다던 는다더니 는다나 는다오 는답니까 는답디까 는답디다 는담 는다더니만 는다더니마는
는다던데 는다며 는다면서 는다니 는단 는단다 는대 는다지 는다죠 는다지만 는다니까 는다느니 는다는구나 는다는군 는다더군 는다더군요
"""
PRESENT_EXCLAMATION = "는구나 는구려 는구먼 는군 는군요"
COPULAR_EXCLAMATION = "로구나 로구려 로구먼 로군"
COMMAND_EXCLAMATION = "으라는구나 으라는군 으라더군 으라더군요"
PROPOSAL_EXCLAMATION = "자는구나 자는군 자더군 자더군요"
FACTUAL_EXCLAMATION = "라는구나 라는군 라더군 라더군요"
PLAIN_EXCLAMATION = "다는구나 다는군 다더군 다더군요"
ADJECTIVAL_QUESTION = "으냐 으냐고 으냐는 으냐며 으냐면서 으냐니 으냔 으냔다 으냬 으냐지만 으냐니까 으냐느니 으냐면 으냐던데 으냐는구나 으냐는군 으냐더군 으냐더군요"
VERBAL_QUESTION = "느냐는구나 느냐는군 느냐더군 느냐더군요 느냐면 느냐던데"
QUESTION_REPORT = "냐는구나 냐는군 냐더군 냐더군요 냐면 냐던데"
VERBAL_INTENTION = "으려거든 으려기에 으려는데 으려다 으려다가 으려더니 으려도 으려야 으려는 으려는가 으려는지 으렵니까 으렵니다"
COMMANDS = "으라 으라고 으라는 으라면 으란 으래 으랍니다 으란다 으라지 으라죠 으라지만 으라니까 으라네 으라는데 으라거나 으세요 으십시오 으소서 으옵소서 읍시다"
VERBAL_REPORTS = """
으라더니 으랍니까 으랍디까 으랍디다 으라던 으라던데 자던 자던데 으라며 으라면서 으라니 으라느니 자느니 자니 잔 자며 자면서 자면 으랍니다 으란다 으라지 으라죠 으라지만 으라니까
자지만 자니까 으래 재 잔다 으라네 으라는데 으라거나 자거나 고서 을라치면
"""
NEUNI = "느니 느니만 느니만큼 느니보다 느니보다는"
FACTUAL = """
라 라도 라야 라야만 라서 라고 라는 라면 랍니다 란다 래 라지 라죠 라지만 라니까 라든가 라네 라는데 라더니 랍니까 랍디까 랍디다 라던 라던데 라며 라면서 라니 라느니
라는구나 라는군 라더군 라더군요
"""
#: Markers that may stand before an ending, by what is allowed; no other may.
ONLY = {
    (): f"자던 자던데 자며 자면서 자니 자느니 잔 자지만 자니까 재 잔다 어다 어다가 자는 자거나 ㄴ 요 {ADJECTIVAL_QUESTION}",
    ("시",): "은바",
    ("시", "었"): "을세라",
    ("시", "었", "겠"): "는바 던바",
    HONORIFIC: f"""으라던 으라던데 으라더니 으랍니까 으랍디까 으랍디다 라던 라더니 으라며 으라면서 으라니 으라느니 은걸 느라 느라고 으니라 자면 을라치면 은들 고서 으려니까
        {PRESENT_EXCLAMATION} {COPULAR_EXCLAMATION} {COMMAND_EXCLAMATION} {PRESENT_DECLARATIVE} {VERBAL_INTENTION} {COMMANDS}""",
    (*HONORIFIC, "었"): "을걸 길래 을지라도 다가 을밖에 을망정 을지언정 을는지 을라고 든가 던들",
    (*HONORIFIC, *TENSE): f"""습디다 습디까 습지요 습죠 습네 다나 다오 답니까 답디까 답디다 담 남 구려 구먼 더구나 더구려 더구먼 {PLAIN_EXCLAMATION} 더라는구나 더라는군
        {VERBAL_QUESTION} {QUESTION_REPORT} 다던 다던데 대 냬 느냬 더래 느니라 기에 으려나 다마는 다만 답시고 는걸 던걸 을라고요 으려니 으려더라 으려던 으려면서 으려든지""",
}
#: Markers that may not stand before an ending.
NEVER = {
    ("더",): """
        나이다 나이까 으리까 다 다고 다는 다니 다면 어 어요 지 지요 죠 습니다 습니까 네 네요 나요 고 고요 지만 지마는 지만요 거든 거든요 거나 건 더라 더라고 더라는 더니 더라도 더군 더군요 던
        던데 던데요 나 으나 기 기로 기가 기는 기도 기만 기를 기보다 음 게 게요 도록 듯 듯이 으면 으며 으면서 으므로 어서 어서야 어도 어야 어야지 어야죠 어서는 어서도 고자 건대 소 오 는 는데
        는데요 는데도 는데다가 는가 는가요 는지 을 을까 을까요 을게 을게요 을래 을래요 을지 을수록 던가 던지 더라네 더라는데 다며 다면서 더라며 더라면서 느냐며 느냐면서 느냐니 더라니 다느니
        느냐느니 더라느니 단 다간 다가는 느냔 다지만 냐지만 느냐지만 더라지만 다니까 냐니까 느냐니까 더라니까 단다 다지 다죠 냔다 느냔다 더란다 느냐고 답니다 다거나 다든가 다네 다는데
        으리라고 으리다 으나마 느냐는 잖아 잖아요 어라""",
    ("더", "으리"): "기로서 기로서니",
    ("시", *TENSE): PROPOSAL_EXCLAMATION,
}
#: Endings whose copular reading is no nominal with 이다, if they are the first morpheme; or the first ending.
NO_COPULA_FIRST = f"""
나이다 나이까 {NEUNI} {PRESENT_EXCLAMATION} 음세 으련 으렴 으려무나 게나 세나 는바 는걸 는감 는고 {PLAIN_EXCLAMATION} {VERBAL_QUESTION} 으냐는구나 으냐는군 으냐더군 으냐더군요 으냐면
다며 다느니 느냐느니 으냐느니 다면서 느냐 느냐고 으냐고 느냔다 으냔다 단다 대 느냬 으냬 다지 다죠 다지만 다니까 느냐지만 느냐니까 으냐지만 으냐니까 느니라 느냐며 느냐면서 느냐니 으냐니
으냔 느냔 으냐며 으냐면서 느냐는 으냐는 답니다 는답니다 다네 는다네 다는데 는다는데 다던 다던데 으냐던데 다거나 는다거나 다든가 는다든가
"""
NO_COPULA_ENDING = f"{COMMAND_EXCLAMATION} {PROPOSAL_EXCLAMATION} {PRESENT_DECLARATIVE} {VERBAL_INTENTION} 어다 어다가 느라 느라고 {VERBAL_REPORTS} 으라 으라고 으라는 으라면 으란 으십시오 으소서 으옵소서 읍시다"
#: First morphemes after 답다: those before which its ㅂ is lost, and others.
DAP_VOWEL = f"""
었 시 으면 으니까 으니 니만 으니만큼 으니라 으소서 으옵소서 으옵 으옵시 으며 으면서 으므로 으나 으나마 으냐느니 으려나 으려니 으려니까 으려더라 으려던 으려면서 으려든지 으려고 으리라 으리만큼
으련만 으련마는 으려니와 으리 으리라고 으리까 을 을걸 을까 을꼬 을세라 을거나 을뿐더러 을까요 을지 을는지 을라 을라고 을라고요 을지라도 을밖에 을망정 을지언정 을수록 음
{ADJECTIVAL_QUESTION} {COMMAND_EXCLAMATION}
"""
DAP_OTHER = f"""
{PROPOSAL_EXCLAMATION} 겠 더 사옵 사옵시 삽 다 다가 단 다간 다가는 냔 다고 다는 다니 다느니 냐느니 냐면 더라느니 다면 답니다 단다 다지 다죠 다지만 다니까 냐지만 냐니까 더라지만 더라니까 냔다
더란다 대 냬 더래 다며 다면서 더라며 더라면서 더라니 냐니 냐며 냐면서 다는구나 냐는구나 냐는군 냐더군 냐더군요 다는군 다더군 다더군요 더라는구나 더라는군 다네 다는데 다던 다더니 다나 다오 담
남 다더니만 다더니마는 다던데 냐던데 으되 더라네 더라는데 다거나 다든가 고 고말고 다마다 고요 지 지요 죠 게 게요 게끔 지만 지마는 지만요 군 군요 구나 구려 구먼 더구나 더구려 더구먼
네 네요 나 나요 냐 냐고 냐는 니 기 기에 길래 기로 기로서 기로서니 기가 기는 기도 기만 기를 기보다 던 던데 던데요 던가 던지 더라 더라고 더라는 더니 더니만 더니마는 더군 더군요 더라도
거든 거든요 거나 건 거니 거니와 든 든지 든가 도록 습니다 습니까 소 오
"""
NO_DAP = f"{PRESENT_DECLARATIVE} {VERBAL_INTENTION} 어다 어다가 느라 느라고 {VERBAL_REPORTS}"


def licences(spark: SparkSession) -> DataFrame:
    """form, and the markers that it admits (only, null for all) and refuses (never)."""
    only = {f: list(m) for m, forms in ONLY.items() for f in forms.split()}
    never = {f: list(m) for m, forms in NEVER.items() for f in forms.split()}
    rows = [(f, only.get(f), never.get(f, [])) for f in sorted({*only, *never})]
    return table(spark, "licences", rows, "form string, only array<string>, never array<string>")
