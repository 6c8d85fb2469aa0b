"""Conflicts between a reading and the entry of one of its predicates."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..rules import attachment as T
from .classes import Pair, auxiliary_class
from .projections import reading_order

_BY_FORM: dict[str, list[tuple[str, str, bool, list[str]]]] = {}
for _rule, _forms, _kinds, _bare, _but in T.RULES:
    for _f in _forms.split():
        _BY_FORM.setdefault(_f, []).append((_rule, _kinds, _bare, _but.split()))


@dataclass
class Owner:
    """A lemma with what stands behind it before the next one."""

    lemma: Pair
    markers: list[str] = field(default_factory=list)
    ending: str | None = None
    suffixes: list[str] = field(default_factory=list)
    particles: list[str] = field(default_factory=list)
    marker_at: list[int] = field(default_factory=list)
    ending_at: int | None = None
    suffix_at: list[int] = field(default_factory=list)


def owners(lemmas: list[Pair], morphemes: list[Pair]) -> list[Owner] | None:
    order = reading_order(lemmas, morphemes)
    if order is None:
        return None
    out: list[Owner] = []
    for what, k in order:
        if what == "lemma":
            out.append(Owner(lemmas[k]))
        elif out:
            form, kind = morphemes[k]
            if kind == "Prefinal":
                out[-1].markers.append(form)
                out[-1].marker_at.append(k)
            elif kind == "Ending":
                if out[-1].ending is None:
                    out[-1].ending, out[-1].ending_at = form, k
            elif kind == "Particle":
                out[-1].particles.append(form)
            else:
                out[-1].suffixes.append(form)
                out[-1].suffix_at.append(k)
    return out


def _excepted(text: str, but: list[str]) -> bool:
    return any(text.endswith(x[1:]) if x[0] == "*" else text == x for x in but)


def _short(entry: str, first: str | None) -> bool:
    """Whether a shortened stem refuses what follows it."""
    if first is None:
        return False
    if entry in T.SHORT_CONSONANT.split():
        code = ord(first[0]) - 0xAC00
        return first == "시" or (0 <= code < 11172 and code // 588 == 11)
    return entry in T.SHORT_RIEUL.split() and first[0] in "어었"


def conflict_of(lemmas: list[Pair], morphemes: list[Pair], i: int, kind: str | None, entry: str = "") -> str | None:
    """The rule by which an entry of class kind cannot be lemma i of a reading, if any."""
    read = owners(lemmas, morphemes)
    if read is None:
        return None
    own, after, before = read[i], read[i + 1] if i + 1 < len(read) else None, read[i - 1] if i else None
    text, role = own.lemma
    bare = not own.markers and not own.suffixes
    if role in ("Predicate", "Auxiliary") and _short(entry, (own.markers or [own.ending])[0]):
        return "ShortStemEnding"
    if kind is None:
        return None
    if own.ending is not None and not own.suffixes:
        if text == "아니다" and own.ending in T.NEGATIVE_COPULA.split():
            return "NegativeCopulaCommand"
        for rule, kinds, only_bare, but in _BY_FORM.get(own.ending, ()):
            if kind in kinds and (bare or not only_bare) and not _excepted(text, but):
                return "AuxiliaryAdjectiveAdnominalClass" if role == "Auxiliary" and rule == "BarePresentAdnominalClass" else rule
    if after is not None and after.lemma[1] == "Auxiliary":
        for rule, connective, auxiliaries, kinds in T.JOINS:
            if own.ending == connective and after.lemma[0] in auxiliaries.split() and kind in kinds and (bare or connective != "는"):
                return rule
    if role == "Auxiliary" and before is not None:
        meant = auxiliary_class(text.removesuffix("다"), before.ending, None)
        if meant in ("V", "A") and meant != kind:
            return "AuxiliaryClass"
        go_nada = text == "나다" and before.ending == "고"
        if (go_nada or (text == "버리다" and before.ending == "어")) and {"었", "겠"} & set(before.markers):
            return "ContinuationLeftTense"
        if go_nada and "시" in own.markers:
            return "GoNadaHonorific"
        if go_nada and "겠" in own.markers:
            return "GoNadaFuture"
        if go_nada and (own.ending in ("는다", "어요", "으세요") or (own.ending == "어" and own.particles[:1] == ["요"])):
            return "GoNadaFinalEnding"
    return None
