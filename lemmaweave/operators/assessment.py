"""What the entry of a lemma says of the reading that the lemma stands in: a conflict with its place, an open question, or nothing.

The owners of a reading (each lemma with the markers, ending, suffixes and particles behind it) are told once a reading and exploded with
its entries. Rules are tables by ending, joined as broadcasts: one row an ending, so that no join multiplies the rows. The first conflict in
the order of the sources decides; a reading without one is open where its markers, followers or class go beyond what the
notes on the ending list, and stands otherwise. Statuses are words, never null."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.pandas.types import to_arrow_type

from ..rules import attachment as T
from ..rules import auxiliaries as A
from ..rules import table
from .attachment import owners

_WORDS, _PLACES = S.ArrayType(S.StringType()), S.ArrayType(S.IntegerType())
_FIELDS = {"text": S.StringType(), "role": S.StringType(), "markers": _WORDS, "marker_at": _PLACES, "ending": S.StringType(), "ending_at": S.IntegerType(), "suffixes": _WORDS, "suffix_at": _PLACES, "particles": _WORDS}
OWNERS = S.ArrayType(S.StructType([S.StructField(n, t) for n, t in _FIELDS.items()]))


@F.arrow_udf(OWNERS)
def owners_of(lemmas: pa.Array, morphemes: pa.Array) -> pa.Array:
    """The owners of each reading, or null where its parts do not fit together."""
    out = []
    for ls, ms in zip(lemmas.to_pylist(), morphemes.to_pylist(), strict=True):
        read = owners([(x["text"], x["kind"]) for x in ls], [(x["form"], x["kind"]) for x in ms])
        out.append(None if read is None else [{"text": o.lemma[0], "role": o.lemma[1]} | {n: getattr(o, n) for n in list(_FIELDS)[2:]} for o in read])
    return pa.array(out, to_arrow_type(OWNERS))


def _by_ending(df: DataFrame) -> DataFrame:
    """df with conflict_rules and open_rules, those of the owner's ending."""
    spark = df.sparkSession
    split = lambda but: ([x for x in but.split() if x[0] != "*"], [x[1:] for x in but.split() if x[0] == "*"])
    conflicts: dict[str, list] = {}
    for rule, forms, kinds, bare, but in T.RULES:
        for form in forms.split():
            conflicts.setdefault(form, []).append((rule, kinds, bare, *split(but)))
    opens: dict[str, list] = {}
    for forms, listed, followers, kinds, honorific, lemmas, bare in T.OPEN:
        for form in forms.split():
            opens.setdefault(form, []).append((listed.split() if listed != "*" else None, followers, kinds, honorific, *split(lemmas), bare))
    rules = "array<struct<rule:string,kinds:string,bare:boolean,whole:array<string>,tails:array<string>>>"
    doubts = "array<struct<listed:array<string>,followers:boolean,kinds:string,honorific:string,whole:array<string>,tails:array<string>,bare:boolean>>"
    c = table(spark, "attachment conflicts", sorted(conflicts.items()), f"form string, conflict_rules {rules}")
    o = table(spark, "attachment doubts", sorted(opens.items()), f"form string, open_rules {doubts}")
    ending = F.col("own.ending")
    return df.join(F.broadcast(c), ending == c["form"], "left").drop("form").join(F.broadcast(o), ending == o["form"], "left").drop("form")


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _excepted(r: Column, text: Column) -> Column:
    return F.array_contains(r["whole"], text) | F.exists(r["tails"], lambda x: text.endswith(x))


def _at(rule: Column | str, place: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule") if isinstance(rule, str) else rule.alias("rule"), place.cast("int").alias("morpheme"))


def _place(items: str, places: str, wanted: list[str]) -> Column:
    """The place of the first of some forms among an owner's parts."""
    k = F.filter(F.arrays_zip(F.col(items).alias("form"), F.col(places).alias("at")), lambda x: x["form"].isin(wanted))
    return F.get(k, F.lit(0))["at"]


def conflict() -> Column:
    """The first conflict as (rule, morpheme), or null. Columns: own, before and after (owners), class (V, A or null), entry_id, conflict_rules."""
    own, before, after, kind = F.col("own"), F.col("before"), F.col("after"), F.col("class")
    text, role, ending, place = own["text"], own["role"], own["ending"], own["ending_at"]
    bare = (F.size(own["markers"]) == 0) & (F.size(own["suffixes"]) == 0)
    plain = F.size(own["suffixes"]) == 0
    first = F.coalesce(F.get(own["markers"], F.lit(0)), ending)
    first_at = F.coalesce(F.get(own["marker_at"], F.lit(0)), place)
    closed = F.col("entry_id").isin(*T.SHORT_CONSONANT.split()) & ((first == "시") | first.rlike("^[아-잏]"))
    liquid = F.col("entry_id").isin(*T.SHORT_RIEUL.split()) & first.rlike("^[어었]")
    short = F.when(role.isin("Predicate", "Auxiliary") & _sure(closed | liquid), _at("ShortStemEnding", first_at))
    fits = lambda r: (F.instr(r["kinds"], kind) > 0) & (bare | ~r["bare"]) & ~_excepted(r, text)
    listed = F.get(F.filter(F.col("conflict_rules"), fits), F.lit(0))["rule"]
    listed = F.when((role == "Auxiliary") & (listed == "BarePresentAdnominalClass"), "AuxiliaryAdjectiveAdnominalClass").otherwise(listed)
    out = [F.when(plain & (text == "아니다") & ending.isin(*T.NEGATIVE_COPULA.split()), _at("NegativeCopulaCommand", place)), F.when(plain & listed.isNotNull(), _at(listed, place))]
    for rule, connective, auxiliaries, kinds in T.JOINS:
        meets = (after["role"] == "Auxiliary") & (ending == connective) & after["text"].isin(*auxiliaries.split()) & F.lit(kinds).contains(kind)
        out.append(F.when(meets & bare if connective == "는" else meets, _at(rule, place)))
    auxiliary = (role == "Auxiliary") & before.isNotNull()
    stem, link = F.regexp_replace(text, "다$", ""), F.coalesce(before["ending"], F.lit(""))
    pairs = {f"{s} {c}": k for s, by in A.BY_CONNECTOR.items() for k, cs in by.items() for c in cs.split()}
    alone = {s: "A" for s in A.ADJECTIVES.split()} | {s: "V" for s in A.VERBS.split()}
    lookup = lambda d, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), key)
    meant = F.coalesce(lookup(pairs, F.concat(stem, F.lit(" "), link)), F.when(~stem.isin(*A.INHERITING.split()), lookup(alone, stem)))
    go = (text == "나다") & (link == "고")
    tense = F.coalesce(_place("before.markers", "before.marker_at", ["었", "겠"]))
    final = ending.isin("는다", "어요", "으세요") | ((ending == "어") & _sure(F.get(own["particles"], F.lit(0)) == "요"))
    out += [
        F.when(auxiliary & meant.isin("V", "A") & (meant != kind), _at("AuxiliaryClass", before["ending_at"])),
        F.when(auxiliary & (go | ((text == "버리다") & (link == "어"))) & tense.isNotNull(), _at("ContinuationLeftTense", tense)),
        F.when(auxiliary & go & F.array_contains(own["markers"], "시"), _at("GoNadaHonorific", _place("own.markers", "own.marker_at", ["시"]))),
        F.when(auxiliary & go & F.array_contains(own["markers"], "겠"), _at("GoNadaFuture", _place("own.markers", "own.marker_at", ["겠"]))),
        F.when(auxiliary & go & final, _at("GoNadaFinalEnding", place)),
    ]
    return F.coalesce(short, F.when(kind.isNotNull(), F.coalesce(*out)))


def open_question() -> Column:
    """Whether a reading without a conflict goes beyond what notes list: markers that they do not name, followers, a class or a lemma that they leave out."""
    own, kind, text = F.col("own"), F.coalesce("class", F.lit("")), F.col("own.text")
    markers, particles = own["markers"], own["particles"]
    bare = (F.size(markers) == 0) & (F.size(own["suffixes"]) == 0)
    honorific = (F.size(markers) > 0) & F.forall(markers, lambda m: m == "시")

    def opens(r: Column) -> Column:
        beyond = r["listed"].isNotNull() & (F.size(F.array_except(markers, r["listed"])) > 0)
        follows = r["followers"] & (F.size(particles) > 0)
        named = (F.size(r["whole"]) + F.size(r["tails"])) > 0
        by_class = (kind != "") & (F.instr(r["kinds"], kind) > 0) & (bare | ~r["bare"]) & (~named | _excepted(r, text))
        return beyond | follows | by_class | ((kind != "") & (F.instr(r["honorific"], kind) > 0) & honorific)

    go = (F.col("own.role") == "Auxiliary") & (text == "나다") & (F.col("before.ending") == "고") & F.array_contains(markers, "었")
    continues = (F.col("after.role") == "Auxiliary") & (((own["ending"] == "고") & (F.col("after.text") == "나다")) | ((own["ending"] == "어") & F.col("after.text").isin("내다", "나다", "나가다", "버리다", "치우다")))
    unclassed = continues & (kind != "V") & own["role"].isin("Predicate", "Auxiliary")
    return _sure(own.isNotNull() & own["role"].isin("Predicate", "Auxiliary", "Copula") & (_sure(F.exists("open_rules", opens)) | _sure(go) | _sure(unclassed)))


def judged(rows: DataFrame) -> DataFrame:
    """rows (lemmas, morphemes, i, class, entry_id) with conflict (rule, morpheme) and open."""
    told = rows.withColumn("owners", owners_of("lemmas", "morphemes"))
    i = F.col("i")
    told = told.withColumns({"own": F.get("owners", i), "before": F.when(i > 0, F.get("owners", i - 1)), "after": F.get("owners", i + 1)})
    told = _by_ending(told).withColumns({"conflict": conflict(), "open": open_question()})
    return told.drop("owners", "own", "before", "after", "conflict_rules", "open_rules")


def identities(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """rows (as for judged, with recorded: the origins of the entry) with identity (relation, morpheme, expected), or null.

    origins: base, suffix, expected (origins of the base of a formation), complete (whether they are all). A nominal that owns the suffix is
    compared: an expected origin among the recorded ones is a recorded_match; another one is a recorded_difference only if all are
    known; else it is unknown. It says which homonym a base is and never decides a status."""
    i = F.col("i")
    told = rows.withColumn("own", F.get(owners_of("lemmas", "morphemes"), i))
    # The last suffix of an owner closes its chain (시 and 되다); a base without one takes no part.
    told = told.withColumn("__suffix", F.try_element_at("own.suffixes", F.lit(-1))).withColumn("__at", F.try_element_at("own.suffix_at", F.lit(-1)))
    o = origins.select(F.col("base").alias("__base"), F.col("suffix").alias("__of"), "expected", "complete").groupBy("__base", "__of").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("expected")))).alias("__expected"), F.bool_and("complete").alias("__complete"))
    joined = told.join(o, (F.col("own.role") == "Nominal") & (F.col("own.text") == F.col("__base")) & (F.col("__suffix") == F.col("__of")), "left")
    recorded = F.coalesce("recorded", F.expr("cast(array() as array<string>)"))
    relation = F.when(F.arrays_overlap("__expected", recorded), "recorded_match").when(F.col("__complete") & (F.size(recorded) > 0), "recorded_difference").otherwise("unknown")
    identity = F.when(F.col("__expected").isNotNull(), F.struct(relation.alias("relation"), F.col("__at").alias("morpheme"), F.col("__expected").alias("expected")))
    return joined.withColumn("identity", identity).drop("own", "__suffix", "__at", "__base", "__of", "__expected", "__complete")
