"""What kind of ending a form is: rule, explanation and the forms that it names."""

from __future__ import annotations

from . import endings as E
from . import followers as W

# Rule, explanation, forms.
FAMILIES: list[tuple[str, str, str]] = [
    ("ending.friendly_command.n", "the friendly command ㄴ after 오다", "ㄴ"),
    ("ending.direct_command", "거라 and 너라", "거라 너라"),
    ("ending.declarative_contrast", "a statement that is granted", "다마는 다만 는다마는 는다만"),
    ("ending.additive_ppundeoreo", "not only that", "을뿐더러"),
    ("ending.literary_question_geona", "a literary question in 을거나", "을거나"),
    ("ending.literary_future_question_kko", "a literary question in 을꼬", "을꼬"),
    ("ending.literary_question_go", "a literary question in 고", "은고 는고 던고"),
    ("ending.ostensible_reason", "a reason that is claimed", "답시고 는답시고"),
    ("ending.literary_ri", "a literary will or guess", "으리다"),
    ("ending.quoted_exclamation", "surprise at a quoted statement", f"는다는구나 는다는군 는다더군 는다더군요 {E.PLAIN_EXCLAMATION} 더라는구나 더라는군"),
    ("ending.quoted_ra_exclamation", "surprise at a quoted command or fact", f"{E.COMMAND_EXCLAMATION} {E.FACTUAL_EXCLAMATION}"),
    ("ending.quoted_proposal_exclamation", "surprise at a quoted proposal", E.PROPOSAL_EXCLAMATION),
    ("ending.quoted_conditional_question", "if one asks", "냐면 느냐면 으냐면"),
    ("ending.quoted_question_exclamation", "surprise at a quoted question", "느냐는구나 느냐는군 느냐더군 느냐더군요 냐는구나 냐는군 냐더군 냐더군요 으냐는구나 으냐는군 으냐더군 으냐더군요"),
    ("ending.exclamation", "surprise", f"{E.PRESENT_EXCLAMATION} {E.COPULAR_EXCLAMATION} 구려 구먼 더구나 더구려 더구먼"),
    ("ending.geol", "걸 endings", "은걸 는걸 던걸 을걸"),
    ("ending.quoted_neuni", "quoted alternatives in 느니", "다느니 는다느니 라느니 으라느니 자느니 냐느니 느냐느니 으냐느니 더라느니"),
    ("ending.neuni", "rather than, and its like", f"{E.NEUNI} 니만 으니만큼"),
    ("ending.background_ba", "background in 바", "은바 는바 던바"),
    ("ending.volitional_promise", "a promise", "음세"),
    ("ending.formal_volitional", "a formal will", "으렵니까 으렵니다"),
    ("ending.willingness_question", "whether one will", "으련"),
    ("ending.gentle_command_long", "a gentle command", "으려무나"),
    ("ending.friendly_command.gena", "a friendly command", "게나"),
    ("ending.friendly_hortative.sena", "a friendly proposal", "세나"),
    ("ending.gentle_command", "a gentle command", "으렴"),
    ("ending.counterfactual_ryeon", "what would be", "으련만 으련마는"),
    ("ending.conjectural_additive", "a guess, and more", "으려니와"),
    ("ending.reported_command_deoni", "a command that was heard", "라더니 으라더니"),
    ("ending.formal_b", "formal endings in 습", "습디다 습디까 습지요 습죠 습네"),
    ("ending.self_question", "a question to oneself", "담 는담 남"),
    ("ending.reported_experience", "what one has heard", "답디까 답디다 는답디까 는답디다 랍디까 랍디다 으랍디까 으랍디다"),
    ("ending.concessive_giroseo", "even if", "기로서 기로서니"),
    ("ending.question_dapnikka", "a question about a report", "답니까 는답니까 랍니까 으랍니까"),
    ("ending.declarative_dao", "a statement in 오", "다오 는다오"),
    ("ending.reported_dana", "a report that is held in doubt", "다나 는다나"),
    ("ending.reported_deoni", "a report that was heard", "다더니 는다더니"),
    ("ending.deoniman", "더니 with emphasis", "더니만 더니마는 다더니만 다더니마는 는다더니만 는다더니마는"),
    ("ending.degree_rimankeum", "to a degree", "으리만큼"),
    ("ending.literary_question_ri", "a literary question in 리", "으리까"),
    ("ending.rya", "a rhetorical question", "으랴"),
    ("ending.caution", "a warning", "을라"),
    ("ending.apprehensive_lsera", "a fear", "을세라"),
    ("ending.contrast_doe", "a contrast in 되", "으되"),
    ("ending.enumerative_yo", "a list of copulas", "요"),
    ("ending.explanatory_se", "an explanation in 을세", "을세"),
    ("ending.causal", "a cause", "기에 길래"),
    ("ending.choice", "a choice", "든가"),
    ("ending.quoted_alternative", "quoted alternatives", "다거나 는다거나 라거나 으라거나 자거나 다든가 는다든가 라든가"),
    ("ending.reporting_familiar", "a familiar report", "단다 는단다 란다 으란다 잔다 냔다 느냔다 으냔다 더란다"),
    ("ending.reporting_confirmation", "a report to be confirmed", "다지 는다지 라지 으라지 다죠 는다죠 라죠 으라죠"),
    ("ending.reporting_contrast", "a report with a contrast", "다지만 는다지만 라지만 으라지만 냐지만 느냐지만 으냐지만 자지만 더라지만"),
    ("ending.ryeo_expression", "shortened expressions with 려", "으려니 으려니까 으려더라 으려던 으려면서 으려든지"),
    ("ending.activity_reason", "because of an activity", "느라 느라고"),
    ("ending.rhetorical_llago", "a rhetorical question in 을라고", "을라고 을라고요"),
    ("ending.reporting_short", "a short report", W.SHORT_REPORT),
    ("ending.reporting_reason", "a report as a reason", W.REPORTING_NIKKA),
    ("ending.reporting_polite", "a polite report", "답니다 는답니다 랍니다 으랍니다"),
    ("ending.reporting_retrospective", "a report of the past", "다던 다던데 는다던 는다던데 라던 라던데 으라던 으라던데 자던 자던데 냐던데 느냐던데 으냐던데"),
    ("ending.reporting_ne", "a report in 네 or 는데", "다네 는다네 라네 으라네 다는데 는다는데 라는데 으라는데 더라네 더라는데"),
    ("ending.short_clause", "a shortened clause", "단 는단 다간 다가는 잔 냔 느냔 으냔"),
    ("ending.reporting_ni", "a report in 니", W.REPORTING_NI),
    ("ending.reporting_myeo", "a report in 며", f"{W.REPORTING_MYEO} {W.REPORTING_MYEON}"),
    ("ending.uncertainty", "an uncertain clause", "을는지 으려는가 으려는지"),
    ("ending.intention_connective", "a connective of intention", "으려거든 으려기에 으려는데 으려다 으려다가 으려더니 으려도 으려야"),
    ("ending.result_connective", "어다", "어다 어다가"),
    ("ending.expectation_question", "a question about what is expected", "으려나"),
    ("ending.refuting_question", "a question that refutes", "은감 는감 던감"),
    ("ending.emphatic_purpose", "게끔", "게끔"),
    ("ending.emphatic_affirmation", "an emphatic yes", "고말고 다마다"),
    ("ending.literary_assertion", "a literary assertion", "으니라 느니라"),
    ("ending.necessity", "no choice but", "을밖에"),
    ("ending.habitual_condition", "whenever", "을라치면"),
    ("ending.concessive", "even though", "은들 을망정 을지언정 던들"),
    ("ending.expectation_contrast", "against what was expected", "건만 건마는"),
    ("ending.confirmation", "잖아", "잖아 잖아요"),
    ("ending.adnominal_expression", "a shortened adnominal", "으려는 자는 냐는 느냐는 으냐는 더라는 란 으란"),
]
#: By rule, what an omitted copula before a form adds.
OMITTED = {"을뿐더러": "copula.omitted_ppundeoreo", "을거나": "copula.omitted_geona", "을꼬": "copula.omitted_kko", "으랴": "copula.omitted_rya"}

_BY_FORM: dict[str, list[str]] = {}
for _rule, _, _forms in FAMILIES:
    for _f in _forms.split():
        _BY_FORM.setdefault(_f, []).append(_rule)


def rules_of(suffix: str, form: str, boundary: str, conjectural: bool = False) -> list[str]:
    """The rules of an ending row, but for those of its boundary."""
    out = list(_BY_FORM.get(form, []))
    if boundary == "OmittedCopula":
        out += [OMITTED[form]] if form in OMITTED else []
        out += ["ending.exclamation"] if form in ("구나", "군", "군요") else []
    if suffix.endswith("구만"):
        out.append("ending.exclamation_variant")
    if suffix == "네" and form == "습네":
        out.append("formal_b.attested_stem_b")
    if conjectural:
        out.append("prefinal.conjectural_ni" if form in ("니", "으니라") else "prefinal.conjectural_quotation" if form == "란" else "prefinal.conjectural_ra")
        out += ["ending.factual_ra"] if form not in ("니", "으니라", "란") else []
    elif boundary == "Literal" and form in E.FACTUAL.split():
        out.append("ending.factual_ra")
    return sorted(set(out))
