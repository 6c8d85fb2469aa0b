"""What the entry of a predicate says of the endings and auxiliaries that its reading gives it."""

from __future__ import annotations

from . import endings as E

# Rule, endings, the classes that it refuses (V verb, A adjective, C copula), whether it holds right after
# the stem only, lemmas to which it does not apply (* stands for any beginning).
EXISTENTIAL = "*있다 *없다 계시다"
RULES: list[tuple[str, str, str, bool, str]] = [
    ("PresentDeclarativeVerb", E.PRESENT_DECLARATIVE, "A", False, ""),
    ("BareAdjectivalQuestion", E.ADJECTIVAL_QUESTION, "VC", True, EXISTENTIAL),
    ("ReportedCommandVerb", "으랍니까 으랍디까 으랍디다", "AC", False, ""),
    ("IntentionVerb", E.VERBAL_INTENTION, "A", False, ""),
    ("ResultTransferVerb", "어다 어다가", "A", False, ""),
    ("NeuraVerb", "느라 느라고", "A", False, ""),
    ("BarePresentAdnominalClass", "는", "AC", True, EXISTENTIAL),
    ("LiteraryAssertionClass", "으니라", "V", True, EXISTENTIAL),
    ("LiteraryAssertionClass", "느니라", "A", True, EXISTENTIAL),
    ("BareLiteraryDeclarative", "나이다", "A", True, EXISTENTIAL),
    ("BareLiteraryQuestion", "나이까", "A", True, EXISTENTIAL),
    ("VolitionalPromiseVerb", "음세", "A", True, ""),
    ("WillingnessQuestionVerb", "으련", "A", True, ""),
    ("GentleCommandVerb", "으렴", "A", True, ""),
    ("GentleCommandLongVerb", "으려무나", "A", True, ""),
    ("FriendlyCommandGenaVerb", "게나", "A", True, ""),
    ("FriendlyHortativeSenaVerb", "세나", "A", True, ""),
    ("BareBackgroundVerb", "는바", "A", True, EXISTENTIAL),
    ("BareNeuniVerb", E.NEUNI, "A", True, EXISTENTIAL),
    ("BareGeolVerb", "는걸", "A", True, EXISTENTIAL),
    ("BareExclamationVerb", E.PRESENT_EXCLAMATION, "A", True, EXISTENTIAL),
    ("BareExclamationAdjective", "구나 군 군요 구먼", "V", True, EXISTENTIAL),
    ("BareNimanAdjective", "니만", "V", True, ""),
    ("HabitualConditionVerb", "을라치면", "A", False, "있다"),
    ("BareCopularEnding", f"{E.FACTUAL} {E.COPULAR_EXCLAMATION}", "VA", True, "아니다"),
    ("BareAdjectivalReport", "단다 다지 다죠 다지만 다니까 대 다던 다던데 다더니 다나 다오 담 답니까 답디까 답디다 다더니만 다더니마는 다네 다는데 다거나 다든가 다며 다면서 다느니 다는구나 다는군 다더군 다더군요", "V", True, EXISTENTIAL),
    ("BareAdjectivalContrast", "다마는 다만", "V", True, EXISTENTIAL),
    ("BareAdjectivalOstensibleReason", "답시고", "V", True, EXISTENTIAL),
    ("BareVerbalQuestion", f"느냐 느냐고 느냐는 느냐며 느냐면서 느냐니 느냔 느냔다 느냐느니 느냐지만 느냐니까 느냬 {E.VERBAL_QUESTION}", "AC", True, EXISTENTIAL),
    ("BareVerbalQuestion", "남", "A", True, EXISTENTIAL),
    ("BareRefutingAdjective", "은감", "V", True, EXISTENTIAL),
    ("BareRefutingVerb", "는감", "AC", True, EXISTENTIAL),
    ("BareLiteraryGoAdjective", "은고", "V", True, EXISTENTIAL),
    ("BareLiteraryGoVerb", "는고", "AC", True, EXISTENTIAL),
]
#: Commands that 아니다 does not give.
NEGATIVE_COPULA = f"으라니 으라느니 으라던 으라던데 으라더니 {E.COMMANDS}"
#: Rule, connective, auxiliaries behind it, and the classes that may not stand before them.
JOINS: list[tuple[str, str, str, str]] = [
    ("RepetitiveVerb", "어", "대다", "A"),
    ("ContinuationVerb", "어", "내다 나다 나가다 버리다 치우다", "AC"),
    ("ContinuationVerb", "고", "나다", "AC"),
    ("ConjecturalAdnominalClass", "는", "듯하다 듯싶다", "AC"),
    ("PretenceAdnominalClass", "는", "양하다 척하다 체하다", "AC"),
]
#: Entries of shortened stems: those that take consonants only, and those in ㄹ that 아/어 may not follow.
SHORT_CONSONANT = "krdict:29738 krdict:73401 krdict:54454 krdict:41863 krdict:73124 krdict:62815 krdict:83942"
SHORT_RIEUL = "krdict:23620 krdict:38390 krdict:15980 krdict:601166 krdict:29045"

# What notes on endings leave open. Endings; the markers that their notes list (* where markers do not matter); whether a
# particle behind them is beyond the notes; classes that the notes leave out, right after the stem only if bare, and then only for the
# lemmas named (* stands for any beginning; none named: all); classes whose forms with nothing but 시 are beyond the notes.
HEADS = "있다 없다 계시다"
REPORTS = next(forms for rule, forms, *_ in RULES if rule == "BareAdjectivalReport")
OPEN: list[tuple[str, str, bool, str, str, str, bool]] = [
    ("거라 너라", "", False, "AC", "", "", False),
    ("음세", "", False, "", "", "", False),
    ("으련 으렴 으려무나", "", True, "", "", "", False),
    ("게나 세나", "시", True, "", "AC", "", False),
    ("으랴", "시 었 겠", False, "", "", "", False),
    ("을라", "시 었", False, "", "", "", False),
    ("으련만 으련마는", "시 으옵시 사옵시 자옵시 었", True, "", "", "", False),
    ("으려니와", "시 었 겠", True, "", "", "", False),
    (f"{E.PRESENT_EXCLAMATION} {E.COPULAR_EXCLAMATION}", "시", False, "", "", "", False),
    ("구나 군 군요 구려 구먼 더구나 더구려 더구먼 더군 더군요 건만 건마는", "시 었 겠", False, "", "", "", False),
    ("더구나", "*", False, "V", "", "", True),
    (REPORTS, "시 었 겠", False, "", "V", "", False),
    (REPORTS, "*", False, "V", "", HEADS, True),
    ("으니라 느니라", "*", False, "V", "", HEADS, True),
    ("구나 군 군요 구먼", "*", False, "V", "", "있다 계시다", True),
    (E.ADJECTIVAL_QUESTION, "*", False, "V", "", HEADS, True),
    (f"{E.ADJECTIVAL_QUESTION} {E.VERBAL_QUESTION}", "시 었 겠", False, "", "", "", False),
    (E.VERBAL_QUESTION, "*", False, "", "AC", "", False),
    ("라던 라더니", "시", False, "", "V", "", False),
    ("라던데", "시 더 으리 었 겠", False, "", "V", "", False),
    ("읍시다", "*", False, "A", "", "", False),
    ("자는구나 자는군 자더군 자더군요", "", False, "A", "", "", False),
]
