"""Second readings of whole analyses: parts of a listed formation in the place of its head, and roles of 되다.

Each analysis is read by itself; every owner in it may be replaced or not, whatever the number of owners."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..rules import derivations as D
from .classes import Pair, classes_allow

Analysis = tuple[list[Pair], list[Pair], list[str]]
INFLECTED = ("Predicate", "Copula", "Auxiliary")
VERBAL_SUFFIXES = ("답다", "되다", "하다")


def reading_order(lemmas: list[Pair], morphemes: list[Pair]) -> list[tuple[str, int]] | None:
    """The parts of an analysis as they stand in the word: ("lemma" or "morpheme", place) of each, or None if they do not fit together.

    A suffix belongs to the lemma before it, or, if that leaves a later one without what it needs, to the compound that both make."""

    def run_of(at: int, *kinds: str) -> int:
        while at < len(morphemes) and morphemes[at][1] in kinds:
            at += 1
        return at

    def endings_of(i: int, start: int, end: int) -> list[int]:
        """Where the markers and the ending behind the suffixes of lemma i may stop."""
        forms = [f for f, _ in morphemes[start:end]]
        verbal = any(f in VERBAL_SUFFIXES for f in forms)
        if not verbal and lemmas[i][1] not in INFLECTED:
            return [end]
        stop = run_of(end, "Prefinal")
        ended = [run_of(stop + 1, "Suffix")] if stop < len(morphemes) and morphemes[stop][1] == "Ending" else []
        compound = i + 1 < len(lemmas) and lemmas[i + 1][1] in ("Predicate", "Root", "Nominal")
        return ended + ([end] if (forms and not verbal) or compound else [])

    def place(i: int, at: int) -> list[tuple[str, int]] | None:
        if i == len(lemmas):
            return [] if at == len(morphemes) else None
        start = run_of(at, "Prefix")
        most = run_of(start, "Suffix")
        for end in (most, start) if most > start else (start,):
            for stop in endings_of(i, start, end):
                stop = run_of(stop, "Particle")
                if (rest := place(i + 1, stop)) is not None:
                    return [*[("morpheme", k) for k in range(at, start)], ("lemma", i), *[("morpheme", k) for k in range(start, stop)], *rest]
        return None

    return place(0, 0)


def _owners(a: Analysis, of: Callable[[Pair], tuple | None]) -> list[tuple[int, int, tuple]]:
    """(lemma, place of the first morpheme after it, what of() says) of each lemma that of() knows, and that has an ending of its own."""
    lemmas, morphemes, _ = a
    order = reading_order(lemmas, morphemes)
    if order is None:
        return []
    found = []
    for k, (what, i) in enumerate(order):
        if what != "lemma" or (said := of(lemmas[i])) is None:
            continue
        rest = order[k + 1 :]
        own = rest[: next((j for j, (w, _) in enumerate(rest) if w == "lemma"), len(rest))]
        at = next((j for w, j in rest if w == "morpheme"), len(morphemes))
        found.append((i, at, (*said, any(morphemes[j][1] == "Ending" for _, j in own), bool(own) and morphemes[own[0][1]][1] in ("Prefinal", "Ending"))))
    return found


def _branches(a: Analysis, owners: list[tuple[int, int, tuple]], change: Callable[[Analysis, int, int, tuple], Analysis | None]) -> list[Analysis]:
    """All ways to change some of the owners, from right to left, so that places stay right."""
    out = [a]
    for i, at, said in reversed(owners):
        out += [b for x in out if (b := change(x, i, at, said)) is not None]
    return out[1:]


def _suffixed(forms: dict[tuple[str, str], tuple[str, str, str]], suffix: str) -> Callable[[Analysis], list[Analysis]]:
    """forms: (head, kind of the head) to base, kind of the base and rule."""

    def of(x: Pair) -> tuple | None:
        return forms.get(x)

    def change(a: Analysis, i: int, at: int, said: tuple) -> Analysis | None:
        base, kind, rule, ended, first = said
        if not (ended and first):
            return None
        lemmas, morphemes, rules = list(a[0]), list(a[1]), [*a[2], rule]
        lemmas[i] = (base, kind)
        morphemes.insert(at, (suffix, "Suffix"))
        ok = classes_allow(lemmas, morphemes, rules, (i, "A" if "adjective" in rule else "V"))
        return None if ok is None else (lemmas, morphemes, rules)

    return lambda a: _branches(a, _owners(a, of), change) if any(x in forms for x in a[0]) else []


def _nominal(suffix: str, rule: str, bases: set[str], passives: set[str]) -> Callable[[Analysis], list[Analysis]]:
    def of(x: Pair) -> tuple | None:
        text, kind = x
        if kind == "Nominal" and text.endswith(suffix) and text[:-1] in bases:
            return text[:-1], False
        if kind == "Predicate" and text.endswith(suffix + "되다") and text[:-3] in passives:
            return text[:-3], True
        return None

    def change(a: Analysis, i: int, at: int, said: tuple) -> Analysis | None:
        base, passive, ended, _ = said
        if passive and not ended:
            return None
        lemmas, morphemes, rules = list(a[0]), list(a[1]), [*a[2], rule]
        lemmas[i] = (base, "Nominal")
        if passive:
            morphemes.insert(at, ("되다", "Suffix"))
            rules.append("suffix.verb.doeda")
        morphemes.insert(at, (suffix, "Suffix"))
        return lemmas, morphemes, rules

    return lambda a: _branches(a, _owners(a, of), change) if any(of(x) for x in a[0]) else []


def _well(a: Analysis) -> list[Analysis]:
    """잘되다 as 잘 and 되다."""
    out = [a]
    for i in reversed([k for k, x in enumerate(a[0]) if x == ("잘되다", "Predicate")]):
        out += [([*b[0][:i], ("잘", "Adverbial"), ("되다", "Predicate"), *b[0][i + 1 :]], b[1], [*b[2], "compound.predicate.well_doeda"]) for b in out]
    return out[1:] if reading_order(a[0], a[1]) is not None else []


def _roles(a: Analysis) -> list[Analysis]:
    """Auxiliary 되다 as a predicate of its own, where its connective allows both."""
    lemmas, morphemes, rules = a
    order = reading_order(lemmas, morphemes)
    if order is None or ("되다", "Auxiliary") not in lemmas:
        return []
    slots, connector = [], None
    for what, k in order:
        if what == "morpheme":
            connector = morphemes[k][0] if morphemes[k][1] == "Ending" else connector
            continue
        if lemmas[k] == ("되다", "Auxiliary"):
            if connector in ("게", "게끔"):
                slots.append((k, "lexical.doeda.complement"))
            elif connector in ("어야", "으면", "어도", "어", "어서", "어서는") and "auxiliary.doeda.extended" in rules:
                slots.append((k, "lexical.doeda.extended"))
        if lemmas[k] != ("안", "Adverbial"):
            connector = None
    out: list[tuple[list[Pair], list[str]]] = [(list(lemmas), [])]
    for k, rule in slots:
        out += [([*ls[:k], ("되다", "Predicate"), *ls[k + 1 :]], [*rs, rule]) for ls, rs in out]
    made = []
    for ls, rs in out[1:]:
        kept = [r for r in rules if (r != "auxiliary" or any(k == "Auxiliary" for _, k in ls)) and (r != "auxiliary.doeda.extended" or any(rule.endswith("extended") and ls[k][1] == "Auxiliary" for k, rule in slots))]
        made.append((ls, morphemes, kept + rs))
    return made


def projector(formations: list[tuple[str, str, str, str, str, str]]) -> Callable[[Analysis], list[Analysis]]:
    """All second readings of an analysis. formations: (head, kind of the head, base, kind of the base, suffix, rule)."""
    steps: list[Callable[[Analysis], list[Analysis]]] = [_roles]
    for suffix in sorted({f[4] for f in formations}, key=lambda s: (s != "되다", s)):
        steps.append(_suffixed({(h, k): (b, bk, r) for h, k, b, bk, s, r in formations if s == suffix}, suffix))
    steps += [_nominal("시", "suffix.nominal.si", set(D.SI.split()), set(D.SI_PASSIVE.split())), _nominal("화", "suffix.nominal.hwa", set(D.HWA.split()), set(D.HWA_PASSIVE.split())), _well]

    def all_of(a: Analysis) -> list[Analysis]:
        out = [a]
        for step in steps:
            for x in list(out):
                for b in step(x):
                    if reading_order(b[0], b[1]) is not None and (more := classes_allow(*b)) is not None:
                        out.append((b[0], b[1], [*b[2], *more]))
        return out[1:]

    return all_of


def _pairs(items: list[dict], name: str) -> list[Pair]:
    return [(x[name], x["kind"]) for x in items]


def _batch(rows: list[tuple[dict, Analysis]], schema: pa.Schema) -> pa.RecordBatch:
    out = []
    for r, (lemmas, morphemes, rules) in rows:
        new = {"lemmas": [{"text": t, "kind": k} for t, k in lemmas], "morphemes": [{"form": f, "kind": k} for f, k in morphemes], "rules": sorted(set(rules))}
        out.append({**r, **new})
    return pa.RecordBatch.from_pylist(out, schema=schema)


#: The columns of a formation in a table.
FORMATION = ("head", "head_kind", "base", "base_kind", "suffix", "rule")


def _with_formations(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with __formations: the formations of a table whose head is a lemma of the row, or null. Heads are joined as they are met, so the table may be of any size."""
    keyed = df.withColumn("__key", F.xxhash64(*[F.col(c) for c in df.columns]))
    rows = keyed.select("__key", F.explode(F.array_distinct(F.transform("lemmas", lambda x: x["text"]))).alias("head")).join(table.select(*FORMATION), "head")
    own = rows.groupBy("__key").agg(F.array_sort(F.collect_set(F.struct(*FORMATION))).alias("__formations"))
    return keyed.join(own, "__key", "left").drop("__key")


def projected(df: DataFrame, formations: list[tuple[str, str, str, str, str, str]], table: DataFrame | None = None) -> DataFrame:
    """df and the second readings of its analyses. table: further formations (FORMATION), such as those of a dictionary."""
    schema = df.schema
    heads = sorted({f[0] for f in formations} | {b + s for s, bs in (("시", D.SI), ("화", D.HWA)) for b in bs.split()} | {b + s + "되다" for s, bs in (("시", D.SI_PASSIVE), ("화", D.HWA_PASSIVE)) for b in bs.split()} | {"되다", "잘되다"})
    looked = F.exists("lemmas", lambda x: x["text"].isin(heads))
    rows = df if table is None else _with_formations(df, table)
    if table is not None:
        looked |= F.col("__formations").isNotNull()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        second = lru_cache(maxsize=4096)(lambda own: projector([*formations, *own]))
        for b in batches:
            found = []
            for r in b.to_pylist():
                own = tuple(tuple(x[c] for c in FORMATION) for x in r.pop("__formations", None) or ())
                found += [(r, x) for x in second(own)((_pairs(r["lemmas"], "text"), _pairs(r["morphemes"], "form"), r["rules"]))]
            if found:
                yield _batch(found, to_arrow_schema(schema))

    return df.unionByName(rows.where(looked).mapInArrow(run, schema))
