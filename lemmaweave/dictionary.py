"""Dictionary look-up, annotation of analyses, three-valued compatibility and filters.

A dictionary is a DataFrame with id, headword, homonym, pos and lookup (the NFC headword); other columns are optional. Joins are on lookup."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of speech of the dictionary, by the lemma kinds that they fit.
ACCEPTED = {
    "Nominal": ("명사", "대명사", "수사", "의존 명사", "PROPN"),
    "Predicate": ("동사", "형용사"),
    "Auxiliary": ("보조 동사", "보조 형용사"),
    "Adverbial": ("부사",),
}
NOUNS = ("명사", "대명사", "수사", "의존 명사")
#: The class that a part of speech gives a predicate, and entries whose part of speech another source corrects.
CLASSES = {"동사": "V", "보조 동사": "V", "형용사": "A", "보조 형용사": "A"}
POS_OVERRIDES = {"krdict:600930": "형용사"}
KNOWN = ("명사", "대명사", "수사", "의존 명사", "동사", "형용사", "보조 동사", "보조 형용사", "조사", "관형사", "부사", "감탄사", "접사", "어미", "PROPN")


class Dictionary(Protocol):
    """What annotation needs of a dictionary."""

    def entries(self) -> DataFrame: ...


class TableDictionary:
    """A dictionary table; `overlay` unions further lexicons into it."""

    def __init__(self, table: DataFrame) -> None:
        self._table = table if "lookup" in table.columns else table.withColumn("lookup", F.col("headword"))

    def entries(self) -> DataFrame:
        return self._table

    def overlay(self, other: TableDictionary) -> TableDictionary:
        return TableDictionary(self._table.unionByName(other.entries(), allowMissingColumns=True))

    def lookup(self, headwords: DataFrame, column: str = "headword") -> DataFrame:
        """Entries of each headword, by id."""
        return headwords.select(F.col(column).alias("lookup")).distinct().join(self._table, "lookup").orderBy("id")

    def entry(self, id_: str) -> DataFrame:
        return self._table.where(F.col("id") == id_)

    def fingerprint(self) -> DataFrame:
        """One row: entries and an order-independent digest of ids and headwords."""
        return self._table.agg(F.count(F.lit(1)).alias("entries"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_set(F.substring(F.sha2(F.concat_ws("|", "id", "headword", "pos"), 256), 1, 2)))), 256).alias("digest"), F.sum(F.xxhash64("id", "headword", "pos").cast("decimal(38,0)")).alias("sum"))


def pos_compatibility(kind: Column, headword: Column, pos: Column) -> Column:
    """compatible, incompatible or unknown for a lemma's kind and an entry."""
    out = F.when(kind.isin("Unclassified", "Root") | ~pos.isin(*KNOWN), "unknown")
    for k, fits in ACCEPTED.items():
        out = out.when((kind == k) & pos.isin(*fits), "compatible")
    copula = ((headword == "이다") & (pos == "조사")) | ((headword == "아니다") & (pos == "형용사"))
    return out.when((kind == "Copula") & copula, "compatible").otherwise("incompatible")


def any_status(statuses: Column) -> Column:
    """Alternatives: one compatible is enough; an unknown one or none leaves it open."""
    return F.when(F.array_contains(statuses, "compatible"), "compatible").when(F.array_contains(statuses, "unknown") | (F.size(statuses) == 0), "unknown").otherwise("incompatible")


def all_status(statuses: Column) -> Column:
    """Parts of one reading: one incompatible decides, then one unknown."""
    return F.when(F.array_contains(statuses, "incompatible"), "incompatible").when(F.array_contains(statuses, "unknown"), "unknown").otherwise("compatible")


def lemma_matches(analyses: DataFrame, dictionary: Dictionary) -> DataFrame:
    """word, lemma_text, lemma_kind and the matching entries with their compatibility, once for each distinct lemma of a word."""
    lemmas = analyses.select("word", F.explode("lemmas").alias("l")).select("word", F.col("l.text").alias("lemma_text"), F.col("l.kind").alias("lemma_kind")).distinct()
    override = F.create_map(*[F.lit(x) for kv in POS_OVERRIDES.items() for x in kv])
    e = dictionary.entries().select("id", "headword", "homonym", F.coalesce(F.try_element_at(override, F.col("id")), F.col("pos")).alias("pos"), "lookup")
    df = lemmas.join(e, lemmas["lemma_text"] == e["lookup"])
    return df.select("word", "lemma_text", "lemma_kind", F.col("id").alias("entry_id"), "headword", "homonym", "pos", pos_compatibility(F.col("lemma_kind"), F.col("headword"), F.col("pos")).alias("pos_compatibility"))


def annotate(analyses: DataFrame, dictionary: Dictionary) -> DataFrame:
    """analyses with lemma_status (by lemma), all_listed and status of each reading."""
    found = lemma_matches(analyses, dictionary).groupBy("lemma_text", "lemma_kind").agg(F.collect_set("pos_compatibility").alias("s"))
    keyed = analyses.withColumn("__a", F.xxhash64("word", F.col("lemmas").cast("string"), F.col("morphemes").cast("string"), "unchanged"))
    parts = keyed.select("word", "__a", F.posexplode("lemmas").alias("i", "l")).select("word", "__a", "i", F.col("l.text").alias("lemma_text"), F.col("l.kind").alias("lemma_kind"))
    none = F.expr("cast(array() as array<string>)")
    judged = parts.join(found, ["lemma_text", "lemma_kind"], "left").select("word", "__a", "i", any_status(F.coalesce("s", none)).alias("status"), F.col("s").isNotNull().alias("listed"))
    by = judged.groupBy("word", "__a").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "status"))), lambda x: x["status"]).alias("lemma_status"), F.bool_and("listed").alias("all_listed"))
    return keyed.join(by, ["word", "__a"], "left").drop("__a").withColumn("status", all_status(F.coalesce("lemma_status", none)))


def assess(analyses: DataFrame, dictionary: Dictionary, evidence: DataFrame | None = None, origins: DataFrame | None = None) -> DataFrame:
    """annotate(), with a status that also asks what each entry says of the reading, conflicts: (lemma, entry_id, rule, morpheme), the place of the
    part that an entry refuses, and, with origins, identities: (lemma, entry_id, relation, morpheme, expected).

    An entry's part of speech gives its predicate a class, with which the endings and auxiliaries of the reading must
    agree (see operators.assessment). In order: an auxiliary entry of the first predicate of a word is open, as what it depends on stands outside; roles;
    conflicts of the sources; spelling; and what goes beyond the sources is open. evidence (stem and class, see spelling_evidence): paradigms that
    written forms show; a reading that needs another one is refused, and one without evidence is left open. origins (base, suffix, expected, complete): see
    operators.assessment.identities. Alternatives are folded by entry, then parts by reading."""
    from .operators.assessment import identities, judged

    known = annotate(analyses, dictionary)
    key = F.xxhash64("word", F.col("lemmas").cast("string"), F.col("morphemes").cast("string"), "unchanged")
    keyed = known.withColumn("__a", key)
    parts = keyed.where("all_listed and not unchanged").select("word", "__a", "lemmas", "morphemes", "rules", "spelling_paths", F.posexplode("lemmas").alias("i", "l"))
    m = lemma_matches(analyses.where("not unchanged"), dictionary).select("word", F.col("lemma_text"), F.col("lemma_kind"), "entry_id", "pos", "pos_compatibility")
    rows = parts.join(m, (parts["word"] == m["word"]) & (F.col("l.text") == F.col("lemma_text")) & (F.col("l.kind") == F.col("lemma_kind"))).drop(m["word"])
    classes = F.create_map(*[F.lit(x) for kv in CLASSES.items() for x in kv])
    inflected = F.col("lemma_kind").isin("Predicate", "Auxiliary", "Copula")
    rows = rows.withColumn("class", F.when(F.col("lemma_kind") == "Copula", "C").when(inflected, F.try_element_at(classes, F.col("pos"))))
    apart = (F.col("i") == 0) & (F.col("lemma_kind") == "Predicate") & F.col("pos").startswith("보조")
    rows = judged(rows).withColumn("pos_compatibility", F.when(apart, "unknown").otherwise(F.col("pos_compatibility")))
    if origins is not None:
        entries = dictionary.entries()
        recorded = entries.select(F.col("id").alias("entry_id"), F.col("origins") if "origins" in entries.columns else F.lit(None).cast("array<string>").alias("origins")).withColumnRenamed("origins", "recorded")
        rows = identities(rows.join(recorded, "entry_id", "left"), origins).withColumn("identity", F.when(F.col("pos") == "명사", F.col("identity")))
    if evidence is None:
        rows = rows.withColumn("spelled", F.lit("compatible"))
    else:
        shown = evidence.groupBy(F.concat("stem", F.lit("다")).alias("lemma_text")).agg(F.collect_set("class").alias("shown"))
        rows = rows.join(shown, "lemma_text", "left")
        meets = lambda path: F.when(F.forall(path, lambda x: F.array_contains("shown", x)), "compatible").otherwise("incompatible")
        own = F.when((F.col("i") > 0) | (F.size("spelling_paths") == 0), "compatible").when(F.col("shown").isNull(), "unknown").otherwise(any_status(F.transform("spelling_paths", meets)))
        rows = rows.withColumn("spelled", own)
    refused = F.col("conflict").isNotNull()
    status = all_status(F.array("pos_compatibility", F.when(refused, "incompatible").when(F.col("open"), "unknown").otherwise("compatible"), "spelled"))
    of = lambda rule, place: F.struct(F.col("i").alias("lemma"), F.col("entry_id").alias("entry_id"), rule.alias("rule"), place.cast("int").alias("morpheme"))
    none = F.lit(None)
    reason = F.when(F.col("pos_compatibility") == "incompatible", of(F.lit("LexicalRole"), none)).when(refused, of(F.col("conflict.rule"), F.col("conflict.morpheme"))).when(F.col("spelled") == "incompatible", of(F.lit("LexicalSpelling"), none))
    told = [F.collect_set(reason).alias("c")]
    if origins is not None:
        told.append(F.collect_set(F.when(F.col("identity").isNotNull(), F.struct(F.col("i").alias("lemma"), F.col("entry_id").alias("entry_id"), F.col("identity.relation").alias("relation"), F.col("identity.morpheme").alias("morpheme"), F.col("identity.expected").alias("expected")))).alias("d"))
    by_lemma = rows.groupBy("word", "__a", "i").agg(any_status(F.collect_set(status)).alias("s"), *told)
    by = by_lemma.groupBy("word", "__a").agg(F.collect_list("s").alias("s"), F.array_sort(F.flatten(F.collect_list("c"))).alias("conflicts"), *([F.array_sort(F.flatten(F.collect_list("d"))).alias("identities")] if origins is not None else []))
    out = keyed.join(by, ["word", "__a"], "left").drop("__a")
    return out.withColumn("status", F.when(F.col("s").isNull(), F.col("status")).otherwise(all_status(F.col("s")))).drop("s")


def headword_filter(annotated: DataFrame) -> DataFrame:
    """Readings whose every lemma has an entry, whatever its part of speech."""
    return annotated.where("all_listed")


def compatible_filter(annotated: DataFrame) -> DataFrame:
    """Those that no entry contradicts; an open question survives."""
    return annotated.where("all_listed and status <> 'incompatible'")


def filtered(analyses: DataFrame, keep) -> DataFrame:  # noqa: ANN001
    """Readings whose every lemma satisfies keep (a function of the lemma struct)."""
    return analyses.where(F.forall("lemmas", keep))


def has_match(analyses: DataFrame, dictionary: Dictionary, *, require_pos: bool = False) -> DataFrame:
    """word and lemma_text of lemmas with an entry, or with one that may fit."""
    m = lemma_matches(analyses, dictionary)
    return (m.where("pos_compatibility <> 'incompatible'") if require_pos else m).select("word", "lemma_text").distinct()


def spelling_evidence(dictionary: DataFrame) -> DataFrame:
    """id, stem and class: what written conjugated forms (forms.kind 활용) show of the ㅂ, ㄷ, ㅅ, ㅎ and 르 paradigms, and of stems in ㅡ and ㅑ."""
    from .functions import hangul as H

    df = dictionary.select("id", F.col("headword"), F.explode("forms").alias("f")).where(F.col("f.kind") == "활용").select("id", H.but_last(F.col("headword")).alias("stem"), F.col("f.written").alias("written"))
    t = H.text_coda(F.col("stem"))
    name = F.when(t == 17, "Bieup").when(t == 7, "Digeut").when(t == 19, "Siot").when(t == 27, "Hieut")
    # 르 stems and stems in other ㅡ or ㅑ show theirs in 아/어 forms.
    vowel = df.where(F.col("stem").rlike("[가-힣]$") & H.vowel(H.index(H.last_char(F.col("stem")))).isin(2, 18) & (t == 0))
    reu, w, head = F.col("stem").endswith("르"), F.col("written"), H.but_last(F.col("stem"))
    lead = F.substring(w, F.char_length("stem"), F.lit(1))  # the syllable in the place of the stem's last
    shown = F.when(reu & w.startswith(F.concat("stem", F.lit("러"))), "ReoAddition").when(reu & lead.isin("라", "러") & ~w.startswith(head), "ReuDoubling").when(reu & lead.isin("라", "러"), "ReuEuDeletion")
    shown = shown.when(~reu & w.startswith(F.concat("stem", F.lit("어"))), "WrittenUncontracted").when(~reu & (H.vowel(H.index(lead)) == 4), "WrittenEo").when(~reu & (H.vowel(H.index(lead)) == 0), "WrittenA")
    vowels = vowel.select("id", "stem", shown.alias("class")).where("class is not null").distinct()
    plain = F.col("written").startswith(F.col("stem")) & F.col("written").endswith("으니")
    return df.where(name.isNotNull() & F.col("written").rlike("니$")).select("id", "stem", F.concat(name, F.when(plain, "Regular").otherwise("Irregular")).alias("class")).distinct().unionByName(vowels)


def coverage(tokens: DataFrame, annotated: DataFrame) -> DataFrame:
    """tokens, words (types), and those with a listed lemma and with a listed reading."""
    by = annotated.groupBy("word").agg(F.bool_or(F.exists("lemma_status", lambda s: s == "compatible")).alias("any"), F.bool_or("all_listed").alias("whole"))
    df = tokens.where("kind = 'word'").select(F.col("surface").alias("word")).groupBy("word").count().join(by, "word", "left")
    return df.agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("types"), F.sum(F.when(F.col("any"), F.col("count")).otherwise(0)).alias("tokens_any"), F.sum(F.when(F.col("whole"), F.col("count")).otherwise(0)).alias("tokens_whole"), F.count_if("any").alias("types_any"), F.count_if("whole").alias("types_whole"))


def unmatched(tokens: DataFrame, annotated: DataFrame, top: int = 50) -> DataFrame:
    """The most frequent words without a listed lemma, with their counts (a report)."""
    some = annotated.where(F.exists("lemma_status", lambda s: s == "compatible")).select("word").distinct()
    counts = tokens.where("kind = 'word'").groupBy(F.col("surface").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return counts.join(some, "word", "left_anti").orderBy(F.desc("n"), "word").limit(top)
