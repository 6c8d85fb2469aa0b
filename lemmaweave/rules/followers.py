"""Which endings may stand before which particles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Families of endings, and the particles that may follow them.
NOMINALIZED = "기 음 는가 은가 는지 은지 던가 던지 을지 을는지 으려는가 으려는지"
CONNECTIVE = """
으려거든 으려기에 으려는데 으려다 으려다가 으려더니 으려도 으려야 어다 어다가 어 어서 어도 어야 고 고서 게 지 지만 는데 은데 던데 거든 으면 으니 으니까 으며 으면서 으므로 으려고 으려면 으려니
으려니까 으려면서 으려든지 으려 고자 느라고 도록 더라도 더니 거나 든지 자마자 라고 으라고 다고 는다고 냐고 자고 라서 라면 다면
"""
CONCESSIVE = "다 는다 습니다 냐 느냐 으냐 으리까 으랴 자 지 더니"
REPORTING_GO = "다고 는다고 라고 으라고 냐고 느냐고 으냐고 자고"
REPORTING_NIKKA = "다니까 는다니까 라니까 으라니까 냐니까 느냐니까 으냐니까 자니까 더라니까"
REPORTING_NI = "다니 는다니 라니 으라니 더라니 자니 냐니 느냐니 으냐니"
REPORTING_MYEON = "다면서 는다면서 라면서 으라면서 더라면서 자면서 냐면서 느냐면서 으냐면서"
REPORTING_MYEO = "다며 는다며 라며 으라며 더라며 자며 냐며 느냐며 으냐며"
SHORT_REPORT = "대 는대 래 으래 재 냬 느냬 으냬 더래"
POLITE = f"""
{CONNECTIVE} {SHORT_REPORT} {REPORTING_GO} {REPORTING_MYEO} {REPORTING_MYEON} {REPORTING_NI} 느라 느라고 냐면 느냐면 으냐면 다던데 는다던데 라던데 으라던데 자던데 냐던데 느냐던데 으냐던데
은들 을망정 을지언정 던들 을라치면 을밖에 군 구나 는다는군 다는군 더라는군 구먼 는구먼 는군 더구먼 다더군 는다더군 라더군 으라더군 라는군 으라는군 자더군 자는군 냐더군 느냐더군 으냐더군
냐는군 느냐는군 으냐는군 로구먼 로군 은걸 는걸 던걸 을걸 으려나 고말고 네 나 니 냐 으냐 더라 으려더라 더라고 더군 을까 을게 을래 다니 으되 지마는 다지만 다니까 는다지만 는다니까 라지만
라니까 으라지만 으라니까 냐지만 냐니까 느냐지만 느냐니까 으냐지만 으냐니까 자지만 자니까 더라지만 더라니까 다지 는다지 라지 으라지 다네 는다네 라네 으라네 다는데 는다는데 라는데 으라는데
더라네 더라는데
"""
BEFORE = {
    "밖에": REPORTING_GO,
    "요": POLITE,
    "들": "어 게 지 고 라고 으라고 다고 는다고 냐고 자고 다 는다 어라 자 어요 습니다 으세요",
    "은": f"{CONNECTIVE} {REPORTING_NIKKA}",
    "는": f"{CONNECTIVE} {REPORTING_NIKKA}",
    "도": f"{CONNECTIVE} {REPORTING_MYEON} 라 다는데 는다는데 라는데 으라는데 더라는데",
    "라도": "어 게 지 고",
    "나마": "게",
    "나": "어 게 지 고 다 는다 라 으라 어라",
    "든지": "다 는다 라 으라 어라",
    "든가": "다 는다 라 으라 어라",
    "야": "어 어서 게 지 고 고서",
    "부터": "어서 고 으면서",
    "보다": "어서",
    "만치": "어서",
    "만큼": "어서",
    "조차": "어서 으려고 다가 게",
    "마저": "어서",
    "만": f"{CONCESSIVE} 어 어서 어야 라야 게 고 고서",
    "마는": CONCESSIVE,
    "그려": "네 소 게 읍시다 오 습니다 을세",
    "그래": "구먼 는구먼 더구먼 로구먼 군 는군 로군 지",
    "를": "어 게 지 고",
    "가": "지",
    "ㄹ랑": "고서 어서 지",
    "ㄹ랑은": "고서 어서 지",
    "설랑": "고 어",
    "설랑은": "고 어",
}
#: Question endings that take a particle like a nominal.
QUESTIONS, QUESTION_PARTICLES = "냐 느냐 으냐", "에 의 와 가 를 보다 는 도"

_PAIRS = {(f, p) for p, forms in BEFORE.items() for f in forms.split()} | {(f, p) for f in QUESTIONS.split() for p in QUESTION_PARTICLES.split()}


def before_particle(ending: str, particle: str) -> bool:
    return (ending, particle) in _PAIRS


def before_particle_column(ending: Column, particle: Column) -> Column:
    """Whether an ending may stand before a particle."""
    return F.concat_ws(" ", ending, particle).isin(*sorted(f"{f} {p}" for f, p in _PAIRS))


def clause_accepts(ending: Column, particle: Column, flexible: Column) -> Column:
    """Whether a clause with an ending may be what a particle attaches to. Nominalised clauses may stand before any but three."""
    listed = flexible | particle.isin(*BEFORE, *QUESTION_PARTICLES.split())
    pair = before_particle_column(ending, particle)
    own = particle.isin("마는", "그려", "그래")
    return F.when(own, pair).otherwise(ending.isin(*NOMINALIZED.split()) | (listed & pair))

