"""Single predicates of a text: ending, prefinal markers, licence. All rule tables are broadcast; rows stay in their task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..rules import endings as E
from ..rules import once_each
from ..storage import cut
from .recovery import SONORANTS, match_suffixes, recover

#: Markers that are peeled in one plan; a longer stack takes another.
LEVELS = 3
JAOP = ("자옵", "잡", "자옵시")
#: Markers with which a vowel stands before what they follow.
VOWEL_MARKERS = ("시", "었", "어야겠")
MORPH = "struct<form:string,kind:string>"
LEMMA = "struct<text:string,kind:string>"


def match_endings(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with form, stem and the other columns of a recovered ending."""
    found = recover(match_suffixes(texts, text, E.endings(texts.sparkSession)))
    rules = F.concat(F.col("found"), F.col("why"), F.array(F.lit("ending")))
    n = H.index(F.left("suffix", F.lit(1)))
    vowel = F.col("boundary").isin("Aeo", "EuFull", "EuZero", "Attached")
    literary = F.col("form").isin("나이다", "나이까")
    return found.select(
        *texts.columns, "form", "connector", "stem", rules.alias("rules"), (F.col("boundary") == "OmittedCopula").alias("copula_only"),
        F.when(F.col("spelling").isNotNull(), F.array("spelling")).otherwise(F.expr("cast(array() as array<string>)")).alias("spellings"),
        F.struct(F.col("suffix").alias("suffix"), F.col("boundary").alias("boundary"), F.col("attached").alias("attached"), F.col("conjectural").alias("conjectural")).alias("end"),
        (F.col("conjectural") | (~literary & (vowel | H.initial(n).isin(2, 5, 6, 11)))).alias("open"),
        (~F.col("conjectural") & (literary | (~vowel & (n >= 0) & (H.initial(n) != 11)))).alias("consonant"),
        F.col("boundary").isin("HaDeletion", "HaAspiration").alias("ha"),
    )


@once_each
def _level_columns() -> dict[str, Column]:
    """The expressions of a level, built once."""
    self_, past = F.col("boundary") == "Keep", F.col("boundary") == "Past"
    n = H.index(H.last_char(F.col("stem")))
    next_ = F.get(F.col("pre"), F.lit(0))
    bundle = F.coalesce(next_.isin("으옵시", "사옵시"), F.lit(False))
    follow = (F.col("follow") == "any") | ((F.col("follow") == "open") & F.col("open")) | ((F.col("follow") == "closed") & ~F.col("open")) | ((F.col("follow") == "consonant") & F.col("consonant"))
    fits = (F.col("stage") >= F.col("least")) & (~F.col("takes_polite") | ~F.col("polite")) & (~past | ((H.coda(n) == 20) & (F.col("pasts") < 2))) & follow & (~bundle | F.col("marker").isin(*E.TENSE))
    base = F.when(past, H.replace_last(F.col("stem"), H.vowel(n), F.lit(0))).otherwise(F.left("stem", F.char_length("stem") - F.when(self_, 0).otherwise(F.char_length("suffix"))))
    new = F.col("boundary") != "Self"
    omitted = F.array_contains("found", "copula.omitted_ending")
    why = F.when(F.col("marker") == "시", "copula.omitted_honorific").when(F.col("marker") == "으옵", "copula.omitted_polite").otherwise("copula.omitted_prefinal")
    vowel = F.col("marker").isin(*VOWEL_MARKERS)
    return {
        "fits": self_ | fits,
        "base": base,
        "boundary": F.when(past, "Aeo").when(self_, "Self").otherwise(F.col("boundary")),
        "new": new,
        "owner": ~new | ~F.col("marker").isin(*JAOP) | F.col("stem").isin(*E.JAOP_STEMS),
        "rules": F.when(new, F.concat("rules", "found", F.array("rule"), F.when(omitted, F.array(why)).otherwise(F.expr("cast(array() as array<string>)")))).otherwise(F.col("rules")),
        "copula_only": F.col("copula_only") | (new & omitted),
        "spellings": F.when(new & F.col("spelling").isNotNull(), F.concat("spellings", F.array("spelling"))).otherwise(F.col("spellings")),
        "pre": F.when(new, F.concat(F.array("marker"), "pre")).otherwise(F.col("pre")),
        "stage": F.when(new, F.col("next")).otherwise(F.col("stage")),
        "pasts": F.col("pasts") + F.when(new & (F.col("marker") == "었"), 1).otherwise(0),
        "polite": F.col("polite") | (new & F.col("takes_polite")),
        "open": F.when(new, vowel).otherwise(F.col("open")),
        "consonant": F.when(new, ~vowel).otherwise(F.col("consonant")),
    }


def peel_prefinals(states: DataFrame) -> DataFrame:
    """Each state itself, and each way to read its stem as another stem and markers (pre, left to right).

    Stages fall from 5, so that markers come in their order; 었 may stand twice. A row that takes no further
    marker passes through by a rule with an impossible suffix, so one explode and one join serve a level. Rows
    with as many markers as one plan has levels go on in another."""
    spark, own = states.sparkSession, states.columns
    conjectural = F.col("end.conjectural")
    df = states.withColumns({"pre": F.when(conjectural, F.array(F.lit("으리"))).otherwise(F.expr("cast(array() as array<string>)")), "stage": F.when(conjectural, 3).otherwise(5), "pasts": F.lit(0), "polite": F.lit(False), "depth": F.lit(0)})
    keep = "\u0000"
    rules = E.markers(spark).union(spark.createDataFrame([("었", "", "Past", None, 2, 2, False, "prefinal.past", "any"), (None, keep, "Keep", None, -9, 0, False, None, "any")], E.markers(spark).schema))
    rules = F.broadcast(rules.withColumnRenamed("polite", "takes_polite"))
    done, level = None, 0
    while True:
        for _ in range(LEVELS):
            df = _peel_marker(df, rules, own, level, keep)
            level += 1
        df = cut(df, "markers")
        done = df if done is None else done.unionByName(df)
        df = df.where(F.col("depth") == level)
        if df.isEmpty():
            return done.drop("stage", "pasts", "polite", "depth", "open", "consonant").distinct()


def _peel_marker(df: DataFrame, rules: DataFrame, own: list[str], level: int, keep: str) -> DataFrame:
    """Rows of the last level with one more marker, and all rows as they are."""
    steps = _level_columns()
    changed = ("rules", "copula_only", "spellings", "pre", "stage", "pasts", "polite", "open", "consonant")
    k = F.least(F.char_length("stem") - 1, F.lit(3))
    ends = F.when(F.col("depth") == level, F.transform(F.sequence(F.lit(0), k), lambda x: F.right(F.col("stem"), x))).otherwise(F.expr("cast(array() as array<string>)"))
    df = df.withColumn("suffix", F.explode(F.array_append(ends, F.lit(keep)))).join(rules, "suffix").where(steps["fits"])
    df = df.withColumns({"base": steps["base"], "__was": F.col("stem"), "boundary": steps["boundary"]})
    df = recover_or_keep(df).where(steps["owner"])
    return df.select(*[c for c in own if c not in ("stem", *changed)], "stem", *[steps[c].alias(c) for c in changed], F.when(steps["new"], F.lit(level + 1)).otherwise(F.col("depth")).alias("depth"))


def recover_or_keep(df: DataFrame) -> DataFrame:
    """recover(), but rows with the boundary Self keep their stem (__was); they pass as a stem that any rule keeps."""
    self_ = F.col("boundary") == "Self"
    out = recover(df.withColumns({"__keep": self_, "boundary": F.when(self_, "ComeStem").otherwise(F.col("boundary")), "base": F.when(self_, "오").otherwise(F.col("base"))}))
    keep = F.col("__keep")
    return out.withColumns({"stem": F.when(keep, F.col("__was")).otherwise(F.col("stem")), "boundary": F.when(keep, "Self").otherwise(F.col("boundary")), "spelling": F.when(~keep, F.col("spelling"))}).drop("__keep", "__was")


@once_each
def _own_conditions(text: str) -> Column:
    """What single endings demand beyond a set of markers."""
    form, stem, pre, suffix, boundary = F.col("form"), F.col("stem"), F.col("pre"), F.col("end.suffix"), F.col("end.boundary")
    none, last = F.size(pre) == 0, F.try_element_at(pre, F.lit(-1))
    last_in = lambda *m: F.coalesce(last.isin(*m), F.lit(False))
    honorific = F.forall(pre, lambda x: x.isin(*E.HONORIFIC))
    copular = stem.endswith("이") | (stem == "아니")
    exists = none & (stem.endswith("있") | stem.endswith("없"))
    polite = F.array_contains("rules", "copula.omitted_polite")
    return (
        (~form.isin("너라", "ㄴ") | stem.endswith("오"))
        & (~polite | ((form == "으리까") & (F.size(pre) == 1) & (F.get(pre, F.lit(0)) == "으옵")))
        & ((form != "으리까") | none | last_in(*E.HONORIFIC, "었", "으옵", "사옵", "자옵"))
        & ((form != "으되") | ((suffix == "으되") & (last_in(*E.TENSE) | exists)) | ((suffix == "되") & honorific))
        & ((form != "습네") | (boundary != "Literal") | ((F.col(text) == "아름답네") & (stem == "아름답") & none))
        & (~form.isin("으라더니", "으랍니까", "으랍디까", "으랍디다") | (stem != "아니"))
        & (~form.isin(*E.COPULAR_EXCLAMATION.split()) | ~none | copular)
        & ((form != "던들") | last_in("었"))
        & (~form.isin(*E.ADJECTIVAL_QUESTION.split()) | ~H.text_coda(stem).isin(0, 8))
        & ((boundary != "Literal") | ~form.isin(*E.FACTUAL.split()) | last_in(*E.HONORIFIC) | (last_in("더") & ~form.isin("라는", "라야", "라야만", "라던", "라더니")))
        & ((form != "란") | (copular & honorific) | last_in(*E.HONORIFIC, "더"))
    )


def licensed(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows whose markers the ending admits."""
    df = df.join(F.broadcast(E.licences(df.sparkSession)), "form", "left")
    pre = F.col("pre")
    within = F.col("only").isNull() | (F.size(F.array_except(pre, "only")) == 0)
    without = F.col("never").isNull() | ~F.arrays_overlap(pre, "never")
    df = df.where(F.col("end.conjectural") | (within & without & _own_conditions(text))).drop("only", "never")
    # 을세 and 요 belong to the copula but for 아니다.
    copular = ((F.col("form") == "을세") & (F.col("end.attached") == 8)) | ((F.col("form") == "요") & ~F.col("end.conjectural"))
    return df.withColumn("copula_only", F.when(copular, F.col("stem") != "아니").otherwise(F.col("copula_only")))


def morph(form: Column, kind: str) -> Column:
    return F.struct(form.alias("form"), F.lit(kind).alias("kind"))


def lemma(text: Column, kind: str) -> Column:
    return F.struct(text.alias("text"), F.lit(kind).alias("kind"))


@once_each
def takes_dap() -> Column:
    """Whether a stem in 답 may be the suffix 답다 by what follows it (pre, form, rules)."""
    first = F.coalesce(F.get("pre", F.lit(0)), F.col("form"))
    vowel = first.rlike("^[어은]") | first.isin(*E.DAP_VOWEL.split())
    other = first.isin(*E.DAP_OTHER.split())
    return F.col("stem").endswith("답") & ~F.col("form").isin(*E.NO_DAP.split()) & F.when(vowel, F.array_contains("rules", "irregular.bieup")).otherwise(other)


def short_imperatives(texts: DataFrame, text: str = "text") -> DataFrame:
    """마, 마라 and 마요 as 말다, with the columns of licensed endings."""
    forms = F.create_map(*[F.lit(x) for kv in E.SHORT_MAL.items() for x in kv])
    df = texts.withColumn("form", F.try_element_at(forms, F.col(text))).where("form is not null")
    none = F.expr("cast(array() as array<string>)")
    return df.select(*texts.columns, "form", F.lit(False).alias("connector"), F.lit("말").alias("stem"), F.array(F.lit("ending"), F.lit("irregular.mal")).alias("rules"), F.lit(False).alias("copula_only"), none.alias("spellings"), F.lit(False).alias("ha"), none.alias("pre"))


def negated(texts: DataFrame, text: str = "text") -> DataFrame:
    """The clauses before 않다 that a text with 잖 or 찮 may have shortened."""
    w = F.col(text)
    at = F.filter(F.sequence(F.lit(2), F.char_length(w)), lambda k: F.substring(w, k, F.lit(1)).isin("잖", "찮"))
    left = F.transform(at, lambda k: F.concat(F.substring(w, F.lit(1), k - 1), F.when(F.substring(w, k, F.lit(1)) == "찮", "하지").otherwise("지")))
    return texts.where(w.rlike(".[잖찮]")).select(F.explode(left).alias(text))


def predicates(texts: DataFrame, text: str = "text") -> DataFrame:
    """texts with each licensed predicate reading: stem, form, connector, morphemes, following (lemmas), rules, copula_only, ha, dap, spellings.

    A stem in 잖 or 찮 is also a clause in 지 with 않다."""
    texts = texts.select(text)
    clauses = negated(texts, text)
    depth = texts.agg(F.max(F.regexp_count(text, F.lit("[잖찮]")))).first()[0] or 0
    if depth:
        texts = texts.union(clauses).distinct()
    df = licensed(peel_prefinals(match_endings(texts, text)), text)
    df = df.select(text, "form", "connector", "stem", "rules", "copula_only", "spellings", "ha", "pre").unionByName(short_imperatives(texts, text))
    df = df.where(F.col("stem").rlike("[가-힣]$"))
    morphs = F.concat(F.transform("pre", lambda x: morph(x, "Prefinal")), F.array(morph(F.col("form"), "Ending")))
    no_lemmas = F.expr(f"cast(array() as array<{LEMMA}>)")
    df = df.select(text, "stem", "form", "connector", "copula_only", "ha", takes_dap().alias("dap"), morphs.alias("morphemes"), no_lemmas.alias("following"), F.array_sort(F.array_distinct("rules")).alias("rules"), "spellings")
    out, heads = df, df
    for _ in range(depth):
        heads = _shortened(df, heads, text)
        out = out.unionByName(heads)
    return out


def _shortened(df: DataFrame, heads: DataFrame, text: str) -> DataFrame:
    """Readings of df whose stem ends in 잖 or 찮, behind the heads that end in 지."""
    base = H.but_last(F.col("stem"))
    cha = F.col("stem").endswith("찮")
    ok = F.col("stem").endswith("잖") | (cha & H.text_coda(base).isin(*SONORANTS))
    tail = df.where(ok & (base != "")).select(F.col(text), F.concat(base, F.when(cha, "하지").otherwise("지")).alias("clause"), cha.alias("cha"), "form", "connector", F.col("morphemes").alias("m"), F.col("rules").alias("r"), F.col("spellings").alias("s"))
    left = heads.where("form = '지'").select(F.col(text).alias("clause"), "stem", "copula_only", "ha", "morphemes", "following", "rules", "spellings")
    joined = tail.join(left, "clause")
    return joined.select(
        text, "stem", "form", "connector", "copula_only", (F.col("ha") | F.col("cha")).alias("ha"), F.lit(False).alias("dap"), F.concat("morphemes", "m").alias("morphemes"),
        F.concat("following", F.array(lemma(F.lit("않다"), "Auxiliary"))).alias("following"),
        F.array_sort(F.array_distinct(F.concat("rules", "r", F.array(F.lit("auxiliary"), F.lit("contraction.negative"))))).alias("rules"), F.concat("spellings", "s").alias("spellings"),
    )
