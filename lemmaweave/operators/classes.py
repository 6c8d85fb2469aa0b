"""The class of each predicate in an analysis, followed from left to right, and the endings that a class refuses.

Lexical predicates have no known class without a dictionary; auxiliaries have one by their stem and the connective
before them, negative auxiliaries have that of what they negate, 이다 is a copula, and formations in 답다, 되다 and 하다
have their own."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..rules import auxiliaries as A
from ..rules import endings as E
from ..rules import once_each

Pair = tuple[str, str]

_CLASS = {s: "A" for s in A.ADJECTIVES.split()} | {s: "V" for s in A.VERBS.split()}
_BY_CONNECTOR = {(s, c): k for s, by in A.BY_CONNECTOR.items() for k, cs in by.items() for c in cs.split()}
_INHERITING = set(A.INHERITING.split())
_NEGATIVE = set(A.NEGATIVE.split())
_REFUSED: dict[str, list[tuple[str, bool, list[str], bool]]] = {}
for _forms, _kinds, _bare, _but, _stative in A.REFUSED:
    for _f in _forms.split():
        _REFUSED.setdefault(_f, []).append((_kinds, _bare, _but.split(), _stative))
_PRESENT = set(E.PRESENT_DECLARATIVE.split())
_EXCLAIM = set(E.PRESENT_EXCLAMATION.split())
_DERIVED = {"suffix.verb.doeda": ("되다", "V"), "suffix.adjective.doeda": ("되다", "A"), "suffix.verb.hada": ("하다", "V"), "suffix.adjective.hada": ("하다", "A"), "suffix.auxiliary.verb.hada": ("하다", "V"), "suffix.auxiliary.adjective.hada": ("하다", "A")}


def auxiliary_class(stem: str, connector: str | None, before: str | None) -> str | None:
    by = _BY_CONNECTOR.get((stem, connector or ""))
    return by or (before if stem in _INHERITING else _CLASS.get(stem))


@dataclass
class Owner:
    """What is known of a predicate once its ending is reached. stative: auxiliary 있다 or 계시다, also when negated;
    relational: a nominal in 적, or the copula on one; marked: a marker that is not honorific; past: 었."""

    kind: str | None = None
    connector: str | None = None
    stative: bool = False
    relational_nominal: bool = False
    relational_copula: bool = False
    marked: bool = False
    past: bool = False
    extra: list[str] = field(default_factory=list)


def _excepted(lemma: str, but: list[str]) -> bool:
    return any(lemma.endswith(x[1:]) if x[0] == "*" else lemma == x for x in but)


def _finite_intention(stem: str, rest: list[Pair]) -> bool:
    ends = [k for k, (_, kind) in enumerate(rest) if kind == "Ending"]
    if stem not in ("하", "들") or not ends:
        return False
    form = rest[ends[0]][0]
    return form in ("는다", "다", "어요", "습니다") or (form == "어" and rest[ends[0] + 1 : ends[0] + 2] == [("요", "Particle")])


def _joins(lemma: Pair, before: Owner, rest: list[Pair], extra: list[str]) -> bool:
    """Whether an auxiliary may follow what stands before it."""
    text, kind = lemma
    if kind != "Auxiliary":
        return True
    stem, connector = text.removesuffix("다"), before.connector
    if text == "하다" and connector == "게끔" and before.past:
        return False
    if connector == "으려고" and _finite_intention(stem, rest):
        if before.marked:
            return False
        if before.kind == "C":
            if not before.relational_copula:
                return False
            extra.append("copula.intention_relational")
    if text in ("있다", "계시다") and connector in ("어", "고") and before.kind in ("A", "C"):
        return False
    if text == "대다" and connector == "어" and before.kind in ("A", "C"):
        return False
    return not (text == "하다" and connector == "어" and before.kind in ("V", "C"))


def _refuses(text: str, kind: str | None, form: str, bare: bool, stative: bool, bare_iss: bool) -> bool:
    if bare_iss and (form in _PRESENT or form in _EXCLAIM):
        return True
    for kinds, only_bare, but, unless_stative in _REFUSED.get(form, ()):
        if kind and kind in kinds and (bare or not only_bare) and not _excepted(text, but):
            if unless_stative and (bare_iss if form == "구먼" else stative):
                continue
            return True
    return False


def classes_allow(lemmas: list[Pair], morphemes: list[Pair], rules: list[str], forced: tuple[int, str] | None = None, known: dict[int, str] | None = None) -> list[str] | None:
    """Rules to add to an analysis, or None if some ending or auxiliary conflicts with a known class. forced: a formation under test; known: classes of lexical predicates; both by lemma."""
    held = set(rules)
    derived = {_DERIVED[r] for r in held & _DERIVED.keys()}
    known = known or {}
    if not known and not derived and not any(k == "Auxiliary" for _, k in lemmas) and not held & {"lexical.doeda.complement", "lexical.doeda.extended", "compound.predicate.well_doeda"}:
        return []
    at, before, extra = 0, Owner(), []
    for i, (text, role) in enumerate(lemmas):
        following = lemmas[i + 1] if i + 1 < len(lemmas) else ("", "")
        if role == "Adverbial" and following[0] == "되다" and ((text == "잘" and "compound.predicate.well_doeda" in held) or (text == "안" and "doeda.negative_bridge" in held)):
            continue
        if not _joins((text, role), before, morphemes[at:], extra):
            return None
        own = Owner(extra=extra)
        kind = forced[1] if forced and forced[0] == i else None
        suffix = morphemes[at][0] if at < len(morphemes) and morphemes[at][1] == "Suffix" else None
        by_suffix = {k for s, k in derived if s == suffix or (suffix in ("화", "시") and morphemes[at + 1 : at + 2] == [(s, "Suffix")])}
        formation = kind or (min(by_suffix) if len(by_suffix) == 1 else None)
        extended = role == "Predicate" and text == "되다" and ((before.connector in ("게", "게끔") and "lexical.doeda.complement" in held) or (before.connector in ("도록", "기", "어야", "으면", "어도", "어", "어서", "어서는") and "lexical.doeda.extended" in held))
        well = i > 0 and lemmas[i - 1] == ("잘", "Adverbial") and "compound.predicate.well_doeda" in held
        kind = formation or (auxiliary_class(text.removesuffix("다"), before.connector, before.kind) if role == "Auxiliary" else "C" if role == "Copula" else "V" if extended or well else known.get(i))
        own.relational_copula = kind == "C" and ((role == "Copula" and before.relational_nominal) or (role == "Auxiliary" and before.relational_copula))
        own.relational_nominal = role == "Nominal" and len(text) > 1 and text.endswith("적")
        own.stative = role == "Auxiliary" and (text in ("있다", "계시다") or (text in _NEGATIVE and before.stative))
        inflected = role in ("Predicate", "Auxiliary", "Copula")
        while at < len(morphemes) and morphemes[at][1] in ("Suffix", "Prefix"):
            form = morphemes[at][0]
            own.relational_nominal = role == "Nominal" and form == "적"
            if form == "답다":
                kind, inflected = "A", True
            inflected |= form in ("되다", "하다") and formation is not None
            at += 1
        bare = inflected and at < len(morphemes) and morphemes[at][1] == "Ending"
        while inflected and at < len(morphemes) and morphemes[at][1] == "Prefinal":
            own.marked |= morphemes[at][0] not in E.HONORIFIC
            own.past |= morphemes[at][0] == "었"
            at += 1
        if inflected and at < len(morphemes) and morphemes[at][1] == "Ending":
            form = morphemes[at][0]
            if (bare and form == "는" and formation == "A") or _refuses(text, kind, form, bare, own.stative, bare and role == "Auxiliary" and text == "있다"):
                return None
            own.connector = form
            at += 1
        while at < len(morphemes) and morphemes[at][1] == "Particle":
            own.relational_nominal = False
            at += 1
        own.kind = kind
        before = own
    return extra


# ---- the same scan over columns ------------------------------------------------------------------


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


@once_each
def _tables() -> dict[str, Column]:
    """The transition tables as constants: classes by stem, by stem and connector, and what endings refuse."""
    refused = {form: [{"kinds": k, "bare": b, "whole": [x for x in but if x[0] != "*"], "tails": [x[1:] for x in but if x[0] == "*"], "stative": s} for k, b, but, s in rows] for form, rows in _REFUSED.items()}
    constant = lambda x, kind: F.from_json(F.lit(json.dumps(x, ensure_ascii=False)), kind)
    return {
        "class": constant(_CLASS, "map<string,string>"),
        "joined": constant({f"{s} {c}": k for (s, c), k in _BY_CONNECTOR.items()}, "map<string,string>"),
        "refused": constant(refused, "map<string,array<struct<kinds:string,bare:boolean,whole:array<string>,tails:array<string>,stative:boolean>>>"),
        "derived": constant({r: {"suffix": s, "kind": k} for r, (s, k) in _DERIVED.items()}, "map<string,struct<suffix:string,kind:string>>"),
    }


_STATE = {"at": "int", "run": "int", "kind": "string", "connector": "string", "stative": "boolean", "nominal": "boolean", "copula": "boolean", "marked": "boolean", "past": "boolean", "ok": "boolean", "intends": "boolean"}


def _state(**values: Column) -> Column:
    return F.struct(*[values[k].cast(t).alias(k) for k, t in _STATE.items()])


@once_each
def class_scan() -> Column:
    """classes_allow() without further knowledge, over the columns lemmas, morphemes and rules: a fold over the lemmas whose state is what is
    known of the last predicate and the morphemes that are used up. Its fields ok and intends say whether the analysis stands, and whether it
    gains the rule of a relational copula with an intention."""
    t, morphs, held = _tables(), F.col("morphemes"), F.col("rules")
    has = lambda rule: F.array_contains(held, rule)
    yes, no = F.lit(True), F.lit(False)
    sure = lambda c: F.coalesce(c, no)
    form_at = lambda k: F.get(morphs, k)["form"]
    kind_at = lambda k: F.get(morphs, k)["kind"]
    letters = F.array_join(F.transform(morphs, lambda m: F.when(m["kind"] == "Ending", "E").when(m["kind"] == "Prefinal", "P").when(m["kind"] == "Particle", "Q").otherwise("S")), "")
    items = F.transform("lemmas", lambda x, i: F.struct(x["text"].alias("text"), x["kind"].alias("role"), F.get("lemmas", i + 1)["text"].alias("next"), sure((F.get("lemmas", i - 1)["text"] == "잘") & (F.get("lemmas", i - 1)["kind"] == "Adverbial")).alias("well")))
    row = F.struct(
        letters.alias("letters"), F.regexp_extract_all(letters, F.lit("S+|P+|E|Q+"), F.lit(0)).alias("runs"), F.array_distinct(F.filter(F.transform(held, lambda r: F.try_element_at(t["derived"], r)), lambda d: d.isNotNull())).alias("derived"),
        has("compound.predicate.well_doeda").alias("well"), has("doeda.negative_bridge").alias("bridge"), has("lexical.doeda.complement").alias("complement"), has("lexical.doeda.extended").alias("extended"),
    )

    def step(const: Column, s: Column, x: Column) -> Column:
        # Runs of suffixes, markers and particles are used up whole, and endings one by one, so a place is found by the number of its run.
        run = lambda k, letter: F.when(F.get(const["runs"], k).startswith(letter), F.length(F.get(const["runs"], k))).otherwise(0)
        used = lambda n: F.when(n > 0, 1).otherwise(0)
        auxiliary, text, connector, kind = x["role"] == "Auxiliary", x["text"], F.coalesce(s["connector"], F.lit("")), F.coalesce(s["kind"], F.lit(""))
        stem = F.regexp_replace(text, "다$", "")
        first = F.instr(F.substring(const["letters"], s["at"] + 1, F.length(const["letters"])), "E") + s["at"]  # of the next ending, from 1
        finite = stem.isin("하", "들") & (first > s["at"]) & sure(form_at(first - 1).isin("는다", "다", "어요", "습니다") | ((form_at(first - 1) == "어") & (form_at(first) == "요") & (kind_at(first) == "Particle")))
        intends = auxiliary & (connector == "으려고") & finite
        barred = (
            ((text == "하다") & (connector == "게끔") & s["past"])
            | (intends & (s["marked"] | ((kind == "C") & ~s["copula"])))
            | (text.isin("있다", "계시다") & connector.isin("어", "고") & kind.isin("A", "C"))
            | ((text == "대다") & (connector == "어") & kind.isin("A", "C"))
            | ((text == "하다") & (connector == "어") & kind.isin("V", "C"))
        )
        suffix = F.when(kind_at(s["at"]) == "Suffix", form_at(s["at"]))
        fits = lambda d: sure((d["suffix"] == suffix) | (suffix.isin("화", "시") & (form_at(s["at"] + 1) == d["suffix"]) & (kind_at(s["at"] + 1) == "Suffix")))
        formed = F.array_distinct(F.transform(F.filter(const["derived"], fits), lambda d: d["kind"]))
        doeda = (x["role"] == "Predicate") & (text == "되다") & ((connector.isin("게", "게끔") & const["complement"]) | (connector.isin("도록", "기", "어야", "으면", "어도", "어", "어서", "어서는") & const["extended"]))
        by_stem = F.coalesce(F.try_element_at(t["joined"], F.concat(stem, F.lit(" "), connector)), F.when(stem.isin(*_INHERITING), s["kind"]).otherwise(F.try_element_at(t["class"], stem)))
        own = F.when(auxiliary, by_stem).when(x["role"] == "Copula", "C").when(doeda | (x["well"] & const["well"]), "V")
        before = F.struct(F.when(F.size(formed) == 1, F.get(formed, F.lit(0))).alias("formation"), own.alias("own"), run(s["run"], "S").alias("n"), (auxiliary & barred).alias("barred"), (intends & (kind == "C")).alias("intends"))

        def suffixed(b: Column) -> Column:
            inside = F.slice(morphs, s["at"] + 1, b["n"])
            dap = F.exists(inside, lambda m: m["form"] == "답다")
            kind = F.coalesce(b["formation"], b["own"])
            inflected = x["role"].isin("Predicate", "Auxiliary", "Copula") | dap | (b["formation"].isNotNull() & F.exists(inside, lambda m: m["form"].isin("되다", "하다")))
            nominal = (x["role"] == "Nominal") & F.when(b["n"] > 0, form_at(s["at"] + b["n"] - 1) == "적").otherwise((F.char_length(text) > 1) & text.endswith("적"))
            found = F.struct(
                b["formation"].alias("formation"), b["barred"].alias("barred"), b["intends"].alias("intends"), F.when(dap, "A").otherwise(kind).alias("kind"), inflected.alias("inflected"), sure(nominal).alias("nominal"),
                sure((kind == "C") & (((x["role"] == "Copula") & s["nominal"]) | (auxiliary & s["copula"]))).alias("copula"),
                (auxiliary & (text.isin("있다", "계시다") | (text.isin(*_NEGATIVE) & s["stative"]))).alias("stative"),
                (s["at"] + b["n"]).alias("at"), (s["run"] + used(b["n"])).alias("run"), F.when(inflected, run(s["run"] + used(b["n"]), "P")).otherwise(0).alias("n"),
            )
            return _let(found, ended)

        def ended(b: Column) -> Column:
            markers, end = F.slice(morphs, b["at"] + 1, b["n"]), b["at"] + b["n"]
            closes = b["inflected"] & sure(kind_at(end) == "Ending")
            form, bare = form_at(end), b["inflected"] & (b["n"] == 0)
            iss = bare & auxiliary & (text == "있다")
            excepted = lambda r: F.array_contains(r["whole"], text) | F.exists(r["tails"], lambda x: text.endswith(x))
            refuses = lambda r: sure((F.instr(r["kinds"], b["kind"]) > 0) & (bare | ~r["bare"]) & ~excepted(r) & ~(r["stative"] & F.when(form == "구먼", iss).otherwise(b["stative"])))
            refused = (iss & form.isin(*_PRESENT, *_EXCLAIM)) | (bare & (form == "는") & sure(b["formation"] == "A")) | sure(F.exists(F.try_element_at(t["refused"], form), refuses))
            closed = F.when(closes, 1).otherwise(0)
            past, behind = end + closed, b["run"] + used(b["n"]) + closed
            particles = run(behind, "Q")
            return _state(
                at=past + particles, run=behind + used(particles), kind=b["kind"], connector=F.when(closes, form), stative=b["stative"], nominal=b["nominal"] & (particles == 0), copula=b["copula"], marked=F.exists(markers, lambda m: ~m["form"].isin(*E.HONORIFIC)),
                past=F.exists(markers, lambda m: m["form"] == "었"), ok=s["ok"] & ~b["barred"] & ~sure(closes & refused), intends=s["intends"] | b["intends"],
            )

        passes = (x["role"] == "Adverbial") & sure(x["next"] == "되다") & (((text == "잘") & const["well"]) | ((text == "안") & const["bridge"]))
        return F.when(passes | ~s["ok"], s).otherwise(_let(before, suffixed))

    none = F.lit(None)
    start = _state(at=F.lit(0), run=F.lit(0), kind=none, connector=none, stative=no, nominal=no, copula=no, marked=no, past=no, ok=yes, intends=no)
    return _let(row, lambda const: F.when((F.size(const["derived"]) > 0) | F.exists("lemmas", lambda x: x["kind"] == "Auxiliary") | const["complement"] | const["extended"] | const["well"], F.aggregate(items, start, lambda s, x: step(const, s, x))).otherwise(start))


def checked(df: DataFrame) -> DataFrame:
    """Analyses (lemmas, morphemes, rules) without those in which an ending or auxiliary conflicts with a known class."""
    looked = F.exists("lemmas", lambda x: x["kind"] == "Auxiliary") | F.exists("rules", lambda r: r.startswith("suffix.") | (r == "compound.predicate.well_doeda"))
    scan = df.where(looked).withColumn("__scan", class_scan()).where("__scan.ok")
    rules = F.array_sort(F.array_distinct(F.when(F.col("__scan.intends"), F.array_append("rules", F.lit("copula.intention_relational"))).otherwise(F.col("rules"))))
    return df.where(~looked).unionByName(scan.withColumn("rules", rules).drop("__scan"))
