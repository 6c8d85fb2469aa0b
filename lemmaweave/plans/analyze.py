"""Words and texts to analyses. Distinct words are analysed once and joined back to their tokens."""

from __future__ import annotations

from dataclasses import dataclass
from threading import Lock
from time import time_ns
from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..functions.tokens import nfc, normalized, tokenize, word_errors
from ..operators.chart import COLUMNS, chains, inner_variants, segments, with_particles
from ..operators.classes import checked
from ..operators.merge import merge
from ..operators.nominals import adverb_bases, assumed, empty, nominal_bases, particle_morphs, peel_particles, phrases, pronoun_readings, split_bundles
from ..operators.predicates import LEMMA, MORPH, lemma, morph, predicates
from ..operators.projections import projected
from ..rules import derivations as D
from ..rules import endings as E
from ..rules import particles as P
from ..rules.followers import NOMINALIZED, clause_accepts
from ..storage import cut, fresh_path

RULES = "array<string>"
#: Analyses while they are put together: of a text, with the form of the last ending (null behind a particle).
FIELDS = ["text", "end", "lemmas", "morphemes", "rules", "spellings"]
# Adverbs that 이다 follows, spoken forms of 것, and polite endings of 이다.
COPULA_ADVERBS = "고만 그만 그럭저럭 그대로 그만큼 딱 들쑥날쑥 들쭉날쭉 먼저 물론 별로 왜 제법"
SPOKEN = {"거": "것", "이거": "이것", "그거": "그것", "저거": "저것"}
POLITE = (("이에요", "에요", False), ("예요", "에요", True), ("이야", "야", False), ("야", "야", True))
MAL_OBJECTS = "걱정 염려 주저 지체 생각 상관"


def identity(words: DataFrame, text: str = "text") -> DataFrame:
    """Every word unchanged, as an unclassified lemma."""
    return _final(words.select(F.col(text).alias("text"), F.array(lemma(F.col(text), "Unclassified")).alias("lemmas"), empty(f"array<{MORPH}>").alias("morphemes"), F.array(F.lit("identity")).alias("rules")), unchanged=True)


def _final(df: DataFrame, unchanged: bool = False) -> DataFrame:
    """Rows of an analysis under their final names."""
    spellings = F.col("spellings") if "spellings" in df.columns else empty(RULES)
    return df.select(F.col("text").alias("word"), "lemmas", "morphemes", F.array_sort(F.array_distinct("rules")).alias("rules"), F.lit(unchanged).alias("unchanged"), spellings.alias("spellings"))


def readings_of(targets: DataFrame) -> DataFrame:
    """Predicate readings (see operators.chart.READING) of texts, single and in chains. Each distinct text that any of them needs is analysed once."""
    parts = cut(segments(targets), "segments")
    variants = cut(inner_variants(parts), "variants")
    an = parts.where(F.col("segment").startswith("안")).select(F.expr("substring(segment, 2)").alias("text"))
    texts = targets.select("text").union(parts.select("segment")).union(variants.select("base")).union(an).where("text <> ''").distinct()
    single = cut(predicates(cut(texts, "texts")).select(*COLUMNS), "predicates")
    inside = single.unionByName(with_particles(variants, single))
    linked = cut(chains(parts, inside), "chains")
    return single.join(targets.select("text"), "text", "left_semi").unionByName(linked)


def _copular(r: DataFrame) -> DataFrame:
    """Readings that may be 이다 on what stands before it, with that as nominal and whether 이 itself is left out."""
    first, ending = F.get("morphemes", F.lit(0))["form"], F.get(F.filter("morphemes", lambda m: m["kind"] == "Ending"), F.lit(0))["form"]
    marked = F.exists("morphemes", lambda m: m["form"].isin(*E.TENSE) & (m["kind"] == "Prefinal"))
    ok = ~F.col("ha") & ~first.isin(*E.NO_COPULA_FIRST.split()) & ~ending.isin(*E.NO_COPULA_ENDING.split()) & ((ending != "으려더라") | marked)
    zero = (F.size("morphemes") == 1) & (first == "다") & (H.text_coda(F.col("stem")) == 0)
    ways = F.filter(F.array(F.when(F.col("stem").endswith("이"), F.struct(H.but_last(F.col("stem")).alias("nominal"), F.lit(False).alias("zero"))), F.when(zero, F.struct(F.col("stem").alias("nominal"), F.lit(True).alias("zero")))), lambda x: x.isNotNull())
    return r.where(ok).select("*", F.inline(ways)).where("nominal <> ''")


def _direct(r: DataFrame) -> DataFrame:
    """Readings as predicates, as nominals in 답다, and 이다 standing alone."""
    end = _end()
    lexical = r.where(~F.col("copula_only")).select("text", end, F.concat(F.array(lemma(F.concat("stem", F.lit("다")), "Predicate")), "following").alias("lemmas"), "morphemes", "rules", "spellings")
    ending = F.get(F.filter("morphemes", lambda m: m["kind"] == "Ending"), F.lit(0))["form"]
    alone = r.where((F.col("stem") == "이") & ending.isin("란", "라는", "요") & ~F.col("ha")).select("text", end, F.concat(F.array(lemma(F.lit("이다"), "Copula")), "following").alias("lemmas"), "morphemes", F.array_append("rules", F.lit("copula.fragment")).alias("rules"), "spellings")
    dap = nominal_bases(r.where("dap").withColumn("base", H.but_last(F.col("stem"))).where("base <> ''"), "base")
    dap = dap.where(~F.array_contains("why", "suffix.nominal.i") & ~F.exists("morphs", lambda m: m["form"].isin("적", "쯤", "씩")))
    spelled = F.filter("spellings", lambda x: ~x.isin("BieupRegular", "BieupIrregular"))
    dap = dap.select("text", end, F.concat("lemmas", "following").alias("lemmas"), F.concat("morphs", F.array(morph(F.lit("답다"), "Suffix")), "morphemes").alias("morphemes"), F.concat("rules", "why", F.array(F.lit("suffix.adjectival.dap"))).alias("rules"), spelled.alias("spellings"))
    return lexical.unionByName(alone).unionByName(dap)


def _end() -> Column:
    last = F.try_element_at("morphemes", F.lit(-1))
    return F.when(last["kind"] == "Ending", last["form"]).alias("end")


def _clauses(chain: DataFrame, expanded: DataFrame) -> DataFrame:
    """Clauses before particles, from what is known of the base of each chain."""
    first = F.get("chain", F.lit(0))
    emphatic = first.isin("다", "다가") & (F.col("class") != 4)
    flexible = F.coalesce(F.col("contraction") != "particle.coda", F.lit(False)) | first.isin("요", "들")
    c = chain.where(~emphatic).select("text", "base", "chain", F.col("rules").alias("outer"), flexible.alias("flexible"))
    df = c.join(expanded.withColumnRenamed("text", "base"), "base").where(clause_accepts(F.col("end"), F.get("chain", F.lit(0)), F.col("flexible")))
    why = F.when(F.col("end").isin(*NOMINALIZED.split()), F.array(F.lit("nominalization"))).otherwise(empty(RULES))
    df = split_bundles(df)
    return df.select("text", F.lit(None).cast("string").alias("end"), "lemmas", F.concat("morphemes", particle_morphs(F.col("chain"))).alias("morphemes"), F.concat("rules", "outer", why).alias("rules"), "spellings")


def _copula_bases(bases: DataFrame, expanded: DataFrame) -> DataFrame:
    """What may stand before 이다 (text), with lemmas, morphemes, rules and spellings: nominals, listed adverbs, spoken 것, and clauses in 기, 음 and 어서."""
    none = empty(f"array<{MORPH}>")
    plain = nominal_bases(bases.select("text"), "text").select("text", "lemmas", F.col("morphs").alias("morphemes"), F.col("why").alias("rules"))
    adverb = bases.where(F.col("text").isin(*COPULA_ADVERBS.split())).select("text", F.array(lemma(F.col("text"), "Adverbial")).alias("lemmas"), none.alias("morphemes"), F.array(F.lit("copula.adverbial_base")).alias("rules"))
    full = F.create_map(*[F.lit(x) for kv in SPOKEN.items() for x in kv])
    spoken = bases.where(F.col("text").isin(*SPOKEN)).select("text", F.array(lemma(F.try_element_at(full, F.col("text")), "Nominal")).alias("lemmas"), none.alias("morphemes"), F.array(F.lit("nominal.colloquial_geot")).alias("rules"))
    clause = expanded.join(bases.select("text"), "text", "left_semi").where(F.col("end").isin("기", "음", "어서"))
    clause = clause.select("text", "lemmas", "morphemes", F.array_append("rules", F.when(F.col("end") == "어서", "copula.connective_seo").otherwise("nominalization")).alias("rules"), "spellings")
    return plain.unionByName(adverb).unionByName(spoken).withColumn("spellings", empty(RULES)).unionByName(clause)


def _with_copula(copular: DataFrame, bases: DataFrame, phrased: DataFrame) -> DataFrame:
    """Copular readings on their bases; phrased ones stand before a written 이다 only."""
    own = copular.select("text", "nominal", "zero", _end(), "following", F.col("morphemes").alias("after"), F.col("rules").alias("outer"), F.col("spellings").alias("more"))
    before = bases.withColumn("phrase", F.lit(False)).unionByName(phrased.withColumn("phrase", F.lit(True))).withColumnRenamed("text", "nominal")
    df = own.join(before, "nominal").where(~F.col("zero") | ~F.col("phrase"))
    why = F.when(F.col("zero"), "copula.zero").otherwise("copula")
    return df.select("text", "end", F.concat("lemmas", F.array(lemma(F.lit("이다"), "Copula")), "following").alias("lemmas"), F.concat("morphemes", "after").alias("morphemes"), F.concat("outer", "rules", F.array(why)).alias("rules"), F.concat("spellings", "more").alias("spellings"))


@dataclass
class Known:
    """All that one call finds out: readings of texts, copular readings, and chains over the bases of 이다."""

    readings: DataFrame
    bases: DataFrame
    chains: DataFrame
    rounds: int


def _close(targets: DataFrame, bases: DataFrame) -> Known:
    """Readings of the targets and of whatever their copular readings stand on, until nothing new comes up."""
    seen, seen_bases = targets.select("text"), bases.select("text").distinct()
    readings = chain = None
    fresh, fresh_bases, rounds = targets.select("text"), seen_bases, 0
    while True:
        rounds += 1
        r = readings_of(fresh)
        readings = r if readings is None else readings.unionByName(r)
        nominals = _copular(r).select(F.col("nominal").alias("text")).union(fresh_bases if rounds == 1 else fresh_bases.limit(0)).distinct()
        new = nominals if rounds == 1 else nominals.join(seen_bases, "text", "left_anti")
        fresh_bases = cut(new, "bases")
        seen_bases = fresh_bases if rounds == 1 else seen_bases.union(fresh_bases)
        c = peel_particles(fresh_bases.where(H.has_hangul(F.col("text"))), stage=5)
        chain = c if chain is None else chain.unionByName(c)
        nominalized = (H.text_coda(F.col("text")) == 16) | F.col("text").rlike("[기키서]$")
        more = fresh_bases.where(nominalized).union(c.select("base")).distinct().join(seen, "text", "left_anti").where(H.has_hangul(F.col("text")))
        fresh = cut(more, "targets")
        if fresh.isEmpty():
            return Known(cut(readings, "readings"), seen_bases, chain, rounds)
        seen = seen.union(fresh)


def _expand(known: Known) -> tuple[DataFrame, DataFrame]:
    """All analyses of the texts that have readings, by FIELDS, and those of the bases of 이다.

    A copular reading needs those of shorter texts, so that as many rounds as led to the readings lead back."""
    direct = cut(checked(_direct(known.readings)), "direct")
    copular = cut(_copular(known.readings), "copular")
    named = phrases(known.chains).unionByName(pronoun_readings(known.bases, known.chains)).withColumn("spellings", empty(RULES))
    named = cut(named.join(known.bases, "text", "left_semi"), "named")
    expanded = direct
    for _ in range(known.rounds):
        bases = _copula_bases(known.bases, expanded)
        phrased = named.unionByName(_clauses(known.chains, expanded).drop("end"))
        expanded = cut(direct.unionByName(checked(_with_copula(copular, bases, phrased))), "expanded")
    return expanded, _copula_bases(known.bases, expanded)


def _mal(words: DataFrame, readings: DataFrame) -> DataFrame:
    """말다 with its object, a listed noun, or 말고 in contrast, written as one word."""
    places = _mal_places(words)
    right = readings.where((F.col("stem") == "말") & (F.size("following") == 0)).select(F.col("text").alias("right"), "morphemes", "rules", "spellings")
    df = places.join(right, "right")
    short = F.array_contains("rules", "irregular.mal")
    contrast = (F.size("morphemes") == 1) & (F.get("morphemes", F.lit(0))["form"] == "고")
    case = (F.col("left").endswith("을") & (H.text_coda(H.but_last(F.col("left"))) > 0)) | (F.col("left").endswith("를") & (H.text_coda(H.but_last(F.col("left"))) == 0))
    with_case = nominal_bases(df.where(case & ~short).withColumn("root", H.but_last(F.col("left"))), "root").withColumn("morphs", F.array_append("morphs", morph(F.lit("를"), "Particle"))).withColumn("why", F.array_append("why", F.lit("particle"))).drop("root")
    bare = nominal_bases(df.where(contrast | F.col("left").isin(*MAL_OBJECTS.split())), "left")
    fixed = df.where(F.col("left") == "꼼짝").select("*", F.array(lemma(F.col("left"), "Adverbial")).alias("lemmas"), empty(f"array<{MORPH}>").alias("morphs"), F.array(F.lit("lexical.mal.fixed_adverb")).alias("why"))
    all_ = with_case.unionByName(bare).unionByName(fixed)
    return all_.select("text", _end(), F.array_append("lemmas", lemma(F.lit("말다"), "Predicate")).alias("lemmas"), F.concat("morphs", "morphemes").alias("morphemes"), F.concat("rules", "why", F.array(F.lit("lexical.mal.nominal"))).alias("rules"), "spellings")


def _mal_places(words: DataFrame) -> DataFrame:
    """text, left and right at each 말 or 마 behind the first syllable."""
    w = F.col("text")
    at = F.filter(F.sequence(F.lit(2), F.char_length(w)), lambda k: F.substring(w, k, F.lit(1)).isin("말", "마"))
    df = words.where(F.char_length(w) > 1).select("text", F.explode(at).alias("k"))
    return df.select("text", F.left(w, F.col("k") - 1).alias("left"), F.expr("substring(text, k)").alias("right"))


def _polite_bases(words: DataFrame) -> DataFrame:
    """text, base and ending of words in 이에요, 예요, 이야 and 야."""
    w = F.col("text")
    ways = []
    for suffix, ending, vowel in POLITE:
        base = F.left(w, F.char_length(w) - len(suffix))
        ok = w.endswith(suffix) & (F.char_length(w) > len(suffix))
        if vowel:
            ok &= (H.text_coda(base) == 0) | assumed(base, F.lit(2)).isNotNull()
        ways.append(F.when(ok, F.struct(base.alias("base"), F.lit(ending).alias("ending"), (assumed(base, F.lit(2)) if vowel else F.lit(None).cast("string")).alias("why"))))
    return words.select("text", F.inline(F.filter(F.array(*ways), lambda x: x.isNotNull())))


def _fragments(words: DataFrame) -> DataFrame:
    """라는 without a nominal, 아니에요, and a foreign nominal with 다."""
    w = F.col("text")
    one = lambda text, lemmas, ending, *rules: words.where(w == text).select("text", lemmas.alias("lemmas"), F.array(morph(F.lit(ending), "Ending")).alias("morphemes"), F.array(*map(F.lit, rules)).alias("rules"))
    out = one("라는", F.array(lemma(F.lit("이다"), "Copula")), "라는", "copula.omitted_fragment", "ending")
    out = out.unionByName(one("아니에요", F.array(lemma(F.lit("아니다"), "Predicate")), "에요", "negative_copula.polite"))
    base = H.but_last(w)
    foreign = words.where(w.endswith("다")).withColumn("why", assumed(base, F.lit(2))).where("why is not null")
    return out.unionByName(foreign.select("text", F.array(lemma(base, "Nominal"), lemma(F.lit("이다"), "Copula")).alias("lemmas"), F.array(morph(F.lit("다"), "Ending")).alias("morphemes"), F.array(F.lit("copula.zero"), F.col("why"), F.lit("ending")).alias("rules")))


def analyze_words(words: DataFrame, text: str = "text", *, formations: list[D.Formation] | DataFrame | None = None) -> DataFrame:
    """word, lemmas, morphemes, unchanged, rules and spelling_paths for each distinct non-empty word of a text column.

    Words are normalised to NFC. A word without a Hangul syllable is only itself. formations: further heads in 되다 and
    하다 that are a base and a suffix (see rules.derivations): a list, or a table of any size with the columns operators.projections.FORMATION."""
    w = normalized(words.select(F.col(text).alias("text")), "text").where(word_errors(F.col("text")).isNull()).distinct()
    w = cut(w, "words")
    korean = w.where(H.has_hangul(F.col("text")))
    if korean.isEmpty():
        return merge(identity(w))
    chain = peel_particles(korean)
    polite = cut(_polite_bases(korean), "polite")
    mal = _mal_places(korean).select(F.col("right").alias("text"))
    targets = cut(korean.select("text").union(chain.where(H.has_hangul(F.col("base"))).select("base")).union(mal).distinct(), "targets")
    known = _close(targets, polite.select(F.col("base").alias("text")))
    expanded, bases = _expand(known)

    whole = expanded.where("end is not null").join(korean, "text", "left_semi").drop("end")
    clause = _clauses(chain, expanded).drop("end")
    with_mal = checked(_mal(korean, known.readings)).drop("end")
    spoken = polite.join(bases.withColumnRenamed("text", "base"), "base")
    spoken = spoken.select("text", F.array_append("lemmas", lemma(F.lit("이다"), "Copula")).alias("lemmas"), F.array_append("morphemes", morph(F.col("ending"), "Ending")).alias("morphemes"), F.concat("rules", F.array_compact(F.array(F.lit("copula.polite"), "why"))).alias("rules"), "spellings")
    listed = nominal_bases(korean, "text", bare=False).unionByName(adverb_bases(korean, "text")).select("text", "lemmas", F.col("morphs").alias("morphemes"), F.col("why").alias("rules"))
    plain = listed.unionByName(phrases(chain)).unionByName(pronoun_readings(korean, chain)).unionByName(_fragments(korean)).withColumn("spellings", empty(RULES))
    found = cut(whole.unionByName(clause).unionByName(with_mal).unionByName(spoken), "found")
    # 어 and 요 may complete a finite intention only now.
    intended = F.exists("morphemes", lambda m: m["form"] == "으려고")
    found = found.where(~intended).unionByName(checked(found.where(intended)))
    listed = formations if isinstance(formations, list) else None
    all_ = projected(cut(found.unionByName(plain), "analyses"), D.formations(listed), None if listed is not None else formations)
    return merge(identity(w).unionByName(_final(all_)))


class Session:
    """A word cache: each distinct word is analysed once, by the first call that brings it; later calls join.

    The cache is a folder of batches, Parquet tables that count from when they are written whole, so a failed call leaves nothing
    behind. Several sessions, of several applications, may share a folder (path): each adds batches of its own, and of a word that two of them
    analysed at once the older batch speaks. max_bytes bounds the files: the oldest batches go first, and a batch that is larger by
    itself is not kept. More than max_batches batches are rewritten as one. With a bound, results are written apart from the
    cache, so that they stay readable whatever leaves it. forget() drops all batches. Calls from several threads wait for each other."""

    def __init__(self, spark, path: str | None = None, *, max_bytes: int | None = None, max_batches: int = 64) -> None:  # noqa: ANN001
        self.spark, self.path, self.max_bytes, self.max_batches, self.lock = spark, path or fresh_path(spark, "analyses"), max_bytes, max_batches, Lock()

    def _fs(self, path: str):  # noqa: ANN202
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def manifest(self) -> list[tuple[str, int]]:
        """The whole batches, oldest first, with their bytes."""
        fs, root = self._fs(self.path)
        if not fs.exists(root):
            return []
        found = []
        for s in fs.listStatus(root):
            if fs.exists(self._fs(f"{s.getPath()}/_SUCCESS")[1]):
                found.append((s.getPath().toString(), fs.getContentSummary(s.getPath()).getLength()))
        return sorted(found, key=lambda x: x[0].rsplit("/", 1)[-1])

    @property
    def batches(self) -> int:
        return len(self.manifest())

    def _read(self, batches: list[str]) -> DataFrame | None:
        """The analyses of the batches, each word's from the oldest that has it."""
        if not batches:
            return None
        rows = self.spark.read.parquet(*batches)
        if len(batches) == 1:
            return rows
        rows = rows.withColumn("__batch", F.regexp_extract(F.col("_metadata.file_path"), "/([^/]+)/[^/]+$", 1))
        first = rows.groupBy("word").agg(F.min("__batch").alias("__batch"))
        return rows.join(first, ["word", "__batch"], "left_semi").drop("__batch")

    def cached(self) -> DataFrame | None:
        return self._read([p for p, _ in self.manifest()])

    def _add(self, rows: DataFrame) -> str:
        path = f"{self.path}/{time_ns():020d}-{uuid4().hex}"
        rows.write.parquet(path)
        return path

    def _drop(self, batch: str) -> None:
        fs, p = self._fs(batch)
        fs.delete(self._fs(f"{batch}/_SUCCESS")[1], False)  # no longer a batch, even if the rest takes time
        fs.delete(p, True)

    def _bound(self) -> None:
        """Rewrites many batches as one, and drops the oldest beyond the bound."""
        held = self.manifest()
        if len(held) > self.max_batches:
            self._add(self._read([p for p, _ in held]))
            for p, _ in held:
                self._drop(p)
            held = self.manifest()
        total = sum(n for _, n in held)
        for p, n in held:
            if self.max_bytes is None or total <= self.max_bytes:
                break
            self._drop(p)
            total -= n

    def analyze(self, words: DataFrame, text: str = "text") -> DataFrame:
        """Analyses of the words, most from the cache."""
        w = normalized(words.select(F.col(text).alias("text")).distinct(), "text").distinct()
        with self.lock:
            known = self.cached()
            new = w if known is None else w.join(known.select(F.col("word").alias("text")).distinct(), "text", "left_anti")
            new = cut(new, "new-words")
            if known is None or not new.isEmpty():
                self._add(analyze_words(new))
            found = self.cached().join(w.withColumnRenamed("text", "word"), "word", "left_semi")
            if self.max_bytes is not None:
                found = cut(found, "analyses")
            self._bound()
            return found if self.max_bytes is not None else self.cached().join(w.withColumnRenamed("text", "word"), "word", "left_semi")

    def forget(self) -> None:
        with self.lock:
            fs, p = self._fs(self.path)
            fs.delete(p, True)


def analyze_text(docs: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Tokens with the analyses of words (null for others): keys, ordinal, surface, start, end, kind, lemmas, morphemes, rules, unchanged."""
    tokens = tokenize(docs, text, keys).withColumn("word", F.when(F.col("kind") == "word", nfc(F.col("surface"))))
    found = analyze_words(tokens.where("kind = 'word'").select(F.col("surface").alias("text")).distinct())
    return tokens.join(found, "word", "left").drop("word")
