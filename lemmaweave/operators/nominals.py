"""Particle chains, nominal suffixes, pronouns and listed formations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..rules import derivations as D
from ..rules import once_each
from ..rules import particles as P
from ..storage import cut
from .predicates import LEMMA, MORPH, lemma, morph

#: Particles that are peeled in one plan; a longer chain takes another.
LEVELS = 3
RULES = "array<string>"
#: Nominal suffixes: the inner ones, and one outer.
INNER = {"님": "suffix.honorific", "적": "suffix.relational", "들": "suffix.plural"}
OUTER = {"씩": "suffix.distributive.ssik", "쯤": "suffix.approximation"}


def empty(kind: str) -> Column:
    return F.expr(f"cast(array() as {kind})")


def fits(base: Column, condition: Column) -> Column:
    """Whether a base ends as a particle demands. What is no syllable has no known coda, so it fits any (an assumption, see assumed)."""
    t = H.text_coda(base)
    return (t == -1) | (condition == 0) | ((condition == 1) & (t > 0)) | ((condition == 2) & (t == 0)) | ((condition == 3) & ~t.isin(0, 8)) | ((condition == 4) & t.isin(0, 8))


def assumed(base: Column, condition: Column) -> Column:
    """The pronunciation that a foreign base is assumed to have."""
    unknown = (H.text_coda(base) == -1) & base.rlike(r"[\p{L}\p{N}]\p{M}*$")
    names = ("assumed_consonant", "assumed_vowel", "assumed_non_rieul_consonant", "assumed_vowel_or_rieul")
    out = F.when(~unknown, None)
    for k, name in enumerate(names, 1):
        out = out.when(condition == k, f"pronunciation.{name}")
    return out


def _in(c: Column, words: str) -> Column:
    return F.coalesce(c.isin(*words.split()), F.lit(False))


@once_each
def _allowed() -> Column:
    """Whether a particle (class, particle) may stand before a chain (chain, stage, after_case)."""
    form, outer, chain = F.col("particle"), F.get("chain", F.lit(0)), F.col("chain")
    ok = ~_in(outer, P.FIRST_ONLY)
    for outers, inners in P.AFTER.items():
        ok &= ~_in(outer, outers) | _in(form, inners)
    ok &= ~form.isin("이", "가", "을", "를") | ~F.arrays_overlap(chain, F.array(*map(F.lit, P.NO_SUBJECT.split())))
    family = F.create_map(*[F.lit(x) for kv in P.CHOICE.items() for x in kv])
    own = F.try_element_at(family, form)
    ok &= own.isNull() | ~F.exists(chain, lambda x: F.coalesce(F.try_element_at(family, x) == own, F.lit(False)))
    link = F.concat_ws(" ", form, outer).isin(*[f"{a} {b}" for a, b in P.LINKS])
    order = (F.col("class") < F.col("stage")) | (F.col("after_case") & (form == "만")) | ((F.coalesce(outer == "의", F.lit(False))) & F.col("class").isin(2, 3) & (form != "의")) | (F.size(chain).cast("boolean") & link)
    return ok & order


def _provenance() -> Column:
    """The rules of a particle as such."""
    p = F.col("particle")
    enumerative = F.col("class") == 4
    out = F.when(p == "요", "particle.polite").when(p == "그려", "particle.familiar_gryeo").when(p == "그래", "particle.familiar_geurae").when(p.isin("치고", "치고는", "치고서"), "particle.chigo")
    out = out.when(p.isin("만치", "마냥", "토록"), "particle.comparison_extent").when(p == "들", "particle.distributive").when(p.isin("다", "이다") & enumerative, "particle.enumerative_da").when(p.isin("다", "다가"), "particle.emphatic_adverbial")
    out = out.when(p.isin("에다", "에다가", "로다가", "으로다가"), "particle.emphatic_destination").when(p.isin("이든가", "든가", "이라든가", "라든가", "이라든지", "라든지"), "particle.enumerative")
    return out.when(p.isin("보고", "더러", "게", "게서", "에게다", "에게다가", "한테다", "한테다가"), "particle.recipient")


def peel_particles(words: DataFrame, text: str = "text", *, stage: int = 7) -> DataFrame:
    """words with each base and the particles after it (chain, left to right, at least one), rules, and of the first particle
    its class and whether it is shortened. From the right: what stands further left has a lower class, or the pair is a listed link."""
    own = words.columns
    start = words.withColumns({"base": F.col(text), "chain": empty(RULES), "stage": F.lit(stage), "after_case": F.lit(False), "rules": empty(RULES), "class": F.lit(0), "contraction": F.lit(None).cast("string"), "closed": F.lit(False), "depth": F.lit(0)})
    done: DataFrame | None = None
    level = 0
    while True:
        grown = start
        for _ in range(LEVELS):
            grown = _peel_level(grown, own, level)
            level += 1
        grown = cut(grown, "particles")
        done = grown if done is None else done.unionByName(grown)
        start = grown.where((F.col("depth") == level) & ~F.col("closed") & (F.char_length("base") > 1) & _may_go_on())
        if start.isEmpty():
            break
    return cut(done.where(F.size("chain") > 0).drop("stage", "after_case", "closed", "depth").distinct(), "particle-chains")


@once_each
def _may_go_on() -> Column:
    """Whether some particle ends the base at all, and the order of classes or a link could let it."""
    ends = F.transform(F.sequence(F.lit(1), F.least(F.char_length("base") - 1, F.lit(5))), lambda k: F.right(F.col("base"), k))
    some = F.exists(ends, lambda x: x.isin(*sorted({f for f, _, _ in P.particle_rows()}))) | H.text_coda(F.col("base")).isin(4, 8)
    outer = F.get("chain", F.lit(0))
    return some & ((F.col("stage") > 1) | F.col("after_case") | outer.isin("의", *sorted({b for _, b in P.LINKS})))


@once_each
def _level_columns() -> dict[str, Column]:
    """The expressions of a level, built once."""
    n = F.char_length("base")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(n - 1, F.lit(5))), lambda k: F.right(F.col("base"), k))
    inner = F.transform(F.sequence(F.lit(0), F.least(n - 1, F.lit(2))), lambda k: F.concat(H.text_coda(F.left(F.col("base"), n - k)).cast("string"), F.lit(":"), F.right(F.col("base"), k)))
    new = F.col("key") != "\u0000"
    rest = F.left("base", n - F.col("chars"))
    ok = ~new | (_allowed() & (F.col("rest") != "") & (F.col("coda").isNotNull() | fits(F.col("rest"), F.col("condition"))))
    rule = F.array_compact(F.array(F.lit("particle"), F.when(F.col("coda").isNull(), assumed(F.col("rest"), F.col("condition"))), F.col("new_contraction"), _provenance()))
    closed = _in(F.col("particle"), P.CLAUSE_ONLY) | (F.col("particle").isin("다", "이다") & (F.col("new_class") == 4))
    keep = lambda fresh, old: F.when(new, fresh).otherwise(F.col(old))
    return {
        "keys": F.concat(F.when(n > 1, suffixes).otherwise(empty(RULES)), inner),
        "rest": F.when(F.col("coda").isNull(), rest).otherwise(H.replace_last(rest, H.vowel(H.index(H.last_char(rest))), F.lit(0))),
        "ok": F.coalesce(ok, F.lit(False)),
        "new": new,
        "base": keep(F.col("rest"), "base"),
        "chain": keep(F.concat(F.array("particle"), "chain"), "chain"),
        "stage": keep(F.when(F.col("after_case") & (F.col("particle") == "만"), 1).otherwise(F.col("before")), "stage"),
        "after_case": keep(F.col("before").isin(1, 2), "after_case"),
        "rules": keep(F.concat("rules", rule), "rules"),
        "class": keep(F.col("new_class"), "was"),
        "contraction": keep(F.col("new_contraction"), "contraction"),
        "closed": keep(F.coalesce(closed, F.lit(False)), "closed"),
    }


def _peel_level(df: DataFrame, own: list[str], level: int) -> DataFrame:
    """Rows of the last level with one more particle, and all rows as they are."""
    spark, steps = df.sparkSession, _level_columns()
    rules = P.recoveries(spark).union(spark.createDataFrame([("\u0000", 0, None, None, 0, 0, None, 0)], P.recoveries(spark).schema)).withColumnsRenamed({"class": "new_class", "contraction": "new_contraction"})
    open_ = (F.col("depth") == level) & ~F.col("closed")
    keys = F.when(open_, steps["keys"]).otherwise(empty(RULES))
    df = df.withColumn("key", F.explode(F.array_append(keys, F.lit("\u0000")))).join(F.broadcast(rules), "key")
    df = df.withColumns({"rest": steps["rest"], "was": F.col("class"), "class": F.col("new_class")}).where(steps["ok"])
    changed = ("base", "chain", "stage", "after_case", "rules", "class", "contraction", "closed")
    return df.select(*own, *[steps[c].alias(c) for c in changed], F.when(steps["new"], F.lit(level + 1)).otherwise(F.col("depth")).alias("depth"))


def _splitter(bundle: str, pair: tuple[str, str]):  # noqa: ANN202
    two = F.array(*map(F.lit, pair))
    return lambda chain: F.flatten(F.transform(chain, lambda x: F.when(x == bundle, two).otherwise(F.array(x))))


def split_bundles(df: DataFrame) -> DataFrame:
    """Rows with a chain, and each way to read its bundled particles as two."""
    ways = F.array(F.col("chain"))
    for bundle, pair in P.BUNDLES.items():
        ways = F.concat(ways, F.transform(ways, _splitter(bundle, pair)))
    return df.withColumn("chain", F.explode(F.array_distinct(ways)))


@once_each
def _nominal_ways(base: str) -> Column:
    """The roots of a nominal with suffixes, with the suffixes and their rules."""
    b = F.col(base)
    shorter = lambda c, k: F.left(c, F.char_length(c) - k)
    way = lambda when, root, forms, rules: F.when(when & (root != ""), F.struct(root.alias("root"), F.array(*[morph(F.lit(f), "Suffix") for f in forms]).cast(f"array<{MORPH}>").alias("morphs"), F.array(*map(F.lit, rules)).cast(RULES).alias("why")))

    def simple(c: Column, when: Column, forms: tuple, rules: tuple) -> list[Column]:
        out = [way(when & c.endswith(s), shorter(c, 1), (s, *forms), (r, *rules)) for s, r in INNER.items()]
        return [*out, way(when & c.endswith("님들"), shorter(c, 2), ("님", "들", *forms), (INNER["님"], INNER["들"], *rules))]

    ways = [way(F.lit(True), b, (), ())] + simple(b, F.lit(True), (), ())
    for s, r in OUTER.items():
        has, inner = b.endswith(s), shorter(b, 1)
        ways += [way(has, inner, (s,), (r,)), *simple(inner, has, (s,), (r,))]
    return F.filter(F.array(*ways), lambda x: x.isNotNull())


def nominal_bases(df: DataFrame, base: str, *, bare: bool = True) -> DataFrame:
    """df with lemmas, morphs and why (rules) of each reading of base as a nominal: as it is (bare), with suffixes, or listed."""
    df = df.withColumn("__w", F.explode(_nominal_ways(base)))
    first = F.get("__w.morphs", F.lit(0))["form"]
    listed = F.broadcast(D.listed_nouns(df.sparkSession).select(F.col("surface").alias("__s"), F.col("lemmas").alias("__l"), F.col("morphemes").alias("__m"), F.col("rules").alias("__r")))
    # A listed noun may carry 들 and an outer suffix, not 님 or 적.
    of_list = df.where(first.isNull() | ~first.isin("님", "적")).join(listed, F.col("__w.root") == F.col("__s"))
    plain = df if bare else df.where(F.size("__w.morphs") > 0)
    own = [c for c in df.columns if c != "__w"]
    return plain.select(*own, F.array(lemma(F.col("__w.root"), "Nominal")).alias("lemmas"), F.col("__w.morphs").alias("morphs"), F.col("__w.why").alias("why")).unionByName(
        of_list.select(*own, F.col("__l").alias("lemmas"), F.concat("__m", "__w.morphs").alias("morphs"), F.concat("__r", "__w.why").alias("why"))
    )


def adverb_bases(df: DataFrame, base: str) -> DataFrame:
    """df with lemmas, morphs and why of each listed derivation of base as an adverb."""
    listed = F.broadcast(D.listed_adverbs(df.sparkSession).select(F.col("surface").alias("__s"), F.col("lemmas"), F.col("morphemes").alias("morphs"), F.col("rules").alias("why")))
    out = df.join(listed, F.col(base) == F.col("__s")).drop("__s")
    # Every stem in 같 and 없 takes 이.
    open_ = df.where(F.col(base).rlike("[같없]이$"))
    return out.unionByName(open_.select(*df.columns, F.array(lemma(F.concat(H.but_last(F.col(base)), F.lit("다")), "Predicate")).alias("lemmas"), F.array(morph(F.lit("이"), "Suffix")).alias("morphs"), F.array(F.lit("suffix.adverbial.i")).alias("why")))


def particle_morphs(chain: Column) -> Column:
    return F.transform(chain, lambda x: morph(x, "Particle"))


def phrases(chain: DataFrame) -> DataFrame:
    """lemmas, morphemes and rules of rows (text, base, chain, rules, class, contraction) whose base is a noun or an adverb."""
    first = F.get("chain", F.lit(0))
    emphatic = first.isin("다", "다가") & (F.col("class") != 4)
    chain_is = lambda words: F.forall("chain", lambda x: x.isin(*words.split()))
    choice = [p for p, k in P.CHOICE.items() if k != 4]
    adverbial_chain = chain_is(f"{P.ADVERBIAL} 요 들 {' '.join(choice)} {P.FOCUS}")
    rest_adverbial = F.forall(F.slice("chain", 2, 99), lambda x: x.isin(*f"{P.ADVERBIAL} 요 들 {' '.join(choice)} {P.FOCUS}".split()))
    emphatic_case = F.concat_ws(" ", "base", first).isin(*[f"{b} {p}" for b, p in P.EMPHATIC_ADVERBS.items()]) & rest_adverbial
    additive = (first == "조차") & F.col("base").isin(*P.ADDITIVE_ADVERBS.split()) & rest_adverbial
    flexible = F.coalesce(F.col("contraction") != "particle.coda", F.lit(False)) | first.isin("요", "들")

    nominal = nominal_bases(chain.where(~_in(first, P.CLAUSE_ONLY) & ~emphatic), "base")
    derived = adverb_bases(chain.where(adverbial_chain | emphatic_case), "base").withColumn("why", F.concat("why", F.when(emphatic_case, F.array(F.lit("particle.adverbial_case"))).otherwise(empty(RULES))))
    free = flexible | _in(first, " ".join([*choice, P.FOCUS]))
    listed = F.when(additive, "particle.additive_adverb").when(emphatic_case, "particle.adverbial_case").when(_in(first, P.ADVERBIAL) & adverbial_chain, "particle.adverbial_focus")
    adverb = chain.where(free | listed.isNotNull()).select("*", F.array(lemma(F.col("base"), "Adverbial")).alias("lemmas"), empty(f"array<{MORPH}>").alias("morphs"), F.when(free, empty(RULES)).otherwise(F.array(listed)).alias("why"))
    kinds = F.create_map(*[F.lit(x) for kv in P.PLACES.items() for x in kv])
    place = chain.where(emphatic & F.col("base").isin(*P.PLACES)).select("*", F.array(F.struct(F.col("base").alias("text"), F.try_element_at(kinds, F.col("base")).alias("kind"))).alias("lemmas"), empty(f"array<{MORPH}>").alias("morphs"), empty(RULES).alias("why"))
    all_ = nominal.unionByName(derived).unionByName(adverb).unionByName(place)
    out = all_.select("text", "lemmas", "morphs", F.concat("rules", "why").alias("rules"), "chain")
    return split_bundles(out).select("text", "lemmas", F.concat("morphs", particle_morphs(F.col("chain"))).alias("morphemes"), "rules")


def pronoun_readings(words: DataFrame, chain: DataFrame) -> DataFrame:
    """text, lemmas, morphemes and rules of pronoun and 것 forms, alone or before more particles (chain)."""
    forms = P.pronouns(words.sparkSession)
    alone = words.join(F.broadcast(forms), words["text"] == forms["surface"]).select("text", "lemma", F.array("particle").alias("chain"), F.array("rule").alias("rules"))
    before = F.create_map(*[F.lit(x) for kv in P.SOURCES.items() for x in kv])
    more = chain.withColumnsRenamed({"class": "outer_class", "rules": "outer"}).join(F.broadcast(forms), F.col("base") == F.col("surface"))
    more = more.withColumn("stage", F.coalesce(F.try_element_at(before, F.get("chain", F.lit(0))), F.col("outer_class"))).withColumn("after_case", F.col("stage").isin(1, 2)).where(_allowed())
    more = more.select("text", "lemma", F.concat(F.array("particle"), "chain").alias("chain"), F.concat("outer", F.array("rule")).alias("rules"))
    return alone.unionByName(more).select("text", F.array(lemma(F.col("lemma"), "Nominal")).alias("lemmas"), particle_morphs(F.col("chain")).alias("morphemes"), "rules")


__all__ = ["LEMMA", "adverb_bases", "assumed", "empty", "fits", "nominal_bases", "peel_particles", "phrases", "pronoun_readings", "split_bundles"]
