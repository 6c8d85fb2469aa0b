"""Recall against gold groups, regressions against a baseline, and a ledger of judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionary import Dictionary

# Tags of the two treebanks by their part in a gold group.
TAGS = {
    "lexical": "nbn nbu ncn ncpa ncps nnc nno npd npp nq mad mag maj mma mmd f ii xp NNG NNP NNB NNC NP NR SN SL SH MAG MAJ MM IC XR XPN",
    "root": "pvg pvd paa pad px VV VA VX VCN",
    "derived": "xsv xsm XSV XSA",
    "copula": "jp VCP",
    "nominal_suffix": "xsn xsa XSN",
    "function": "ecc ecs ecx ef ep etm etn jca jcc jcj jcm jco jcr jcs jct jcv jxc jxf jxt EC EF EP ETM ETN JC JKB JKC JKG JKO JKQ JKS JKV JX",
}


def gold_groups(rows: DataFrame) -> DataFrame:
    """rows of read_conllu with kind (converted, excluded or why not) and gold, the lemmas in order.

    Predicates and derived predicates end in 다; the copula is 이다; a suffix extends the word before it."""
    parts, tags = F.split("lemma", r"\+"), F.split("xpos", r"\+")
    part_of = F.create_map(*[F.lit(x) for name, tags_ in TAGS.items() for t in tags_.split() for x in (t, name)])
    pairs = F.arrays_zip(parts.alias("p"), F.transform(tags, lambda t: F.coalesce(F.try_element_at(part_of, t), F.lit("other"))).alias("t"))
    no_text = F.lit(None).cast("string")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit("").alias("open"), F.lit(False).alias("predicate"), no_text.alias("error"))

    def closed(a):  # noqa: ANN001, ANN202
        return F.when(a["open"] == "", a["out"]).otherwise(F.array_append(a["out"], F.concat(a["open"], F.when(a["predicate"], "다").otherwise(""))))

    def step(a, x):  # noqa: ANN001, ANN202
        p, t = x["p"], x["t"]
        opens, ends = t.isin("root", "copula"), t.isin("root", "copula", "function")
        orphan = (a["open"] == "") | a["predicate"]
        error = F.when((t == "lexical") & a["predicate"], "unsegmented_predicate_nominal").when((t == "derived") & orphan, "orphan_derivational_suffix").when((t == "nominal_suffix") & orphan, "orphan_nominal_suffix").when(t == "other", "unsupported_tag")
        text = F.when(t == "copula", "이").when(t == "root", p).when(t == "function", "").otherwise(F.concat(a["open"], p))
        return F.struct(F.when(ends, closed(a)).otherwise(a["out"]).alias("out"), text.alias("open"), (opens | (t == "derived") | (a["predicate"] & ~ends)).alias("predicate"), F.coalesce(a["error"], error).alias("error"))

    read = F.aggregate(pairs, start, step, lambda a: F.struct(closed(a).alias("gold"), a["error"].alias("error")))
    df = rows.withColumn("__r", read)
    kind = (
        F.when(~F.col("well_formed"), "column_count").when(F.col("upos").isin("PUNCT", "SYM") | ~F.col("form").rlike("[가-힣]"), "excluded")
        .when((F.col("lemma") == "_") | (F.col("xpos") == "_"), "missing_morphology").when(F.size(parts) != F.size(tags), "morpheme_tag_alignment").when(F.array_contains(parts, ""), "empty_morpheme")
        .when(F.col("__r.error").isNotNull(), F.col("__r.error")).when(F.size("__r.gold") == 0, "no_lexical_component").otherwise("converted")
    )
    return df.withColumn("kind", kind).withColumn("gold", F.when(F.col("kind") == "converted", F.col("__r.gold"))).drop("__r")


def recall_report(gold: DataFrame, analyses: DataFrame) -> DataFrame:
    """One row: rows, conversions, grouped and single-lemma recall, and candidate counts (mean, p95 by rank, max)."""
    groups = analyses.groupBy("word").agg(F.collect_set(F.transform("lemmas", lambda x: x["text"])).alias("groups"), F.count(F.lit(1)).alias("n"))
    df = gold.join(groups, gold["form"] == groups["word"], "left").withColumn("on", F.col("kind") == "converted")
    hit = F.col("on") & F.coalesce(F.array_contains("groups", F.col("gold")), F.lit(False))
    best = F.coalesce(F.array_max(F.transform("groups", lambda g: F.size(F.array_intersect(g, "gold")))), F.lit(0))
    changed = F.col("on") & (F.array_join("gold", "+") != F.col("form"))
    # A row for each number of candidates there is, not for each word.
    tally = df.where("on").groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    upto = tally.select("n", F.sum("k").over(Window.orderBy("n")).alias("upto"), F.sum("k").over(Window.partitionBy(F.lit(0))).alias("all"))
    ranked = upto.where(F.col("upto") > F.floor(F.col("all") * 95 / 100)).agg(F.min("n").alias("p95_candidates"))
    total = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("kind") == "excluded").alias("excluded_rows"), F.count_if("on").alias("converted_rows"), F.count_if(hit).alias("grouped_matches"), F.sum(F.when(F.col("on"), F.size("gold"))).alias("gold_lemmas"), F.sum(F.when(F.col("on"), best)).alias("recovered_gold_lemmas"), F.count_if(changed).alias("transformed_rows"), F.count_if(changed & hit).alias("transformed_matches"), F.avg(F.when(F.col("on"), F.col("n"))).alias("mean_candidates"), F.max(F.when(F.col("on"), F.col("n"))).alias("max_candidates"))
    return total.withColumn("grouped_lemma_recall", F.col("grouped_matches") / F.col("converted_rows")).join(F.broadcast(ranked))


def common_misses(gold: DataFrame, analyses: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent converted forms without their gold group."""
    groups = analyses.select("word", F.transform("lemmas", lambda x: x["text"]).alias("gold")).distinct()
    df = gold.where("kind = 'converted'").join(groups, (gold["form"] == groups["word"]) & (gold["gold"] == groups["gold"]), "left_anti")
    return df.groupBy("form", "gold").count().orderBy(F.desc("count"), "form", "gold").limit(top)


def maximal_sets(cases: DataFrame) -> DataFrame:
    """case and sets (arrays of sorted indices) that no larger set of the case covers."""
    s = F.array_distinct("sets")
    return cases.withColumn("sets", F.filter(s, lambda x: ~F.exists(s, lambda y: (F.size(y) > F.size(x)) & (F.size(F.array_except(x, y)) == 0))))


def baseline_regressions(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cases (id, sets) of which an old set is covered by no new one, or that are gone."""
    j = old.alias("o").join(new.alias("n"), "id", "left")
    covered = F.forall("o.sets", lambda x: F.exists(F.coalesce("n.sets", F.expr("cast(array() as array<array<int>>)")), lambda y: F.size(F.array_except(x, y)) == 0))
    return j.where(~covered).select("id", F.col("o.sets").alias("old_sets"), F.col("n.sets").alias("new_sets"))


def judge_ledger(judgments: DataFrame, analyses: DataFrame) -> DataFrame:
    """judgments (id, surface, lemmas, verdict) with met: a required group is there, a forbidden one is not."""
    groups = analyses.select(F.col("word").alias("surface"), F.transform("lemmas", lambda x: x["text"]).alias("lemmas"), F.lit(True).alias("__there")).distinct()
    j = judgments.join(groups, ["surface", "lemmas"], "left").withColumn("there", F.coalesce("__there", F.lit(False))).drop("__there")
    return j.withColumn("met", F.when(F.col("verdict") == "required", F.col("there")).when(F.col("verdict") == "forbidden", ~F.col("there")))


def review_queue(judgments: DataFrame, analyses: DataFrame) -> DataFrame:
    """Analyses of judged surfaces that no judgment speaks of."""
    a = analyses.select(F.col("word").alias("surface"), F.transform("lemmas", lambda x: x["text"]).alias("lemmas")).distinct()
    return a.join(judgments.select("surface").distinct(), "surface", "left_semi").join(judgments.select("surface", "lemmas"), ["surface", "lemmas"], "left_anti")


def preferred_readings(annotated: DataFrame) -> DataFrame:
    """Of the compatible readings of a word, the one with the fewest morphemes, then the first in order."""
    w = Window.partitionBy("word").orderBy((F.col("status") != "compatible").cast("int"), F.size("morphemes"), F.col("lemmas").cast("string"), F.col("morphemes").cast("string"))
    return annotated.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


# ---- what a viewer of analyses asks for ----------------------------------------------------------

#: Written shape of an affix headword, and the parts of speech it has, by kind of morpheme.
AFFIX = {"Ending": ("-{}", "어미"), "Prefinal": ("-{}-", "어미"), "Suffix": ("-{}", "접사"), "Prefix": ("{}-", "접사"), "Particle": ("{}", "조사")}
#: Pairs of neighbouring morphemes that a dictionary lists as one.
BUNDLED_LABELS = {("었", "었"): "-었었-", ("으리", "으니라"): "-으리니라"}


@F.udf(T.ArrayType(T.StructType([T.StructField("part", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("text", T.StringType())])))
def _breakdown(lemmas, morphemes):  # noqa: ANN001, ANN202
    from .operators.projections import reading_order

    order = reading_order([(x.text, x.kind) for x in lemmas], [(x.form, x.kind) for x in morphemes])
    return None if order is None else [(what, k, lemmas[k].text if what == "lemma" else morphemes[k].form) for what, k in order]


def breakdown(analyses: DataFrame) -> DataFrame:
    """analyses with breakdown: lemmas and morphemes as they stand in the word (part, place, text), or null if they do not fit together."""
    return analyses.withColumn("breakdown", _breakdown("lemmas", "morphemes"))


def grammar_labels(analyses: DataFrame, dictionary: Dictionary) -> DataFrame:
    """word, kind, form, headword and entry_id of the dictionary entries for each morpheme, and for pairs that are listed as one."""
    m = analyses.select("word", "morphemes")
    one = m.select("word", F.explode("morphemes").alias("m")).select("word", F.col("m.kind").alias("kind"), F.col("m.form").alias("form"))
    shapes = [F.when(F.col("kind") == k, F.format_string(shape.replace("{}", "%s"), F.col("form"))) for k, (shape, _) in AFFIX.items()]
    one = one.withColumn("headword", F.coalesce(*shapes))
    pairs = F.transform(F.filter(F.sequence(F.lit(0), F.size("morphemes") - 2), lambda i: i >= 0), lambda i: F.struct(F.get("morphemes", i)["form"].alias("a"), F.get("morphemes", i + 1)["form"].alias("b")))
    both = m.where(F.size("morphemes") > 1).select("word", F.explode(pairs).alias("p"))
    listed = F.coalesce(*[F.when((F.col("p.a") == a) & (F.col("p.b") == b), F.lit(h)) for (a, b), h in BUNDLED_LABELS.items()])
    both = both.select("word", F.lit("Prefinal").alias("kind"), F.concat("p.a", "p.b").alias("form"), listed.alias("headword")).where("headword is not null")
    want = one.unionByName(both).distinct()
    pos = F.coalesce(*[F.when(F.col("kind") == k, F.lit(p)) for k, (_, p) in AFFIX.items()])
    e = dictionary.entries().select(F.col("headword").alias("head"), F.col("id").alias("entry_id"), "pos")
    return want.withColumn("want", pos).join(e, (F.col("headword") == F.col("head")) & (F.col("pos") == F.col("want"))).select("word", "kind", "form", "headword", "entry_id")


def glosses(entries: DataFrame, language: str = "영어") -> DataFrame:
    """id and gloss: the first non-empty translation of an entry (senses with translations) in a language, or null."""
    all_ = F.flatten(F.transform("senses", lambda s: s["translations"]))
    found = F.filter(all_, lambda t: (t["language"] == language) & (t["lemma"] != ""))
    return entries.select("id", F.get(found, F.lit(0))["lemma"].alias("gloss"))


def combinations(parts: DataFrame, choices: str = "choices", limit: int = 20) -> DataFrame:
    """parts with n_combinations (the exact product of the sizes of an array of arrays) and, where that is 1 to limit, all combinations."""
    sizes = F.transform(choices, F.size)
    n = F.when(F.size(choices) == 0, F.lit(0).cast("decimal(38,0)")).otherwise(F.aggregate(sizes, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)")))
    kind = parts.schema[choices].dataType.elementType.simpleString()
    grow = F.aggregate(choices, F.array(F.expr(f"cast(array() as {kind})")), lambda a, xs: F.flatten(F.transform(a, lambda y: F.transform(xs, lambda x: F.array_append(y, x)))))
    return parts.withColumn("n_combinations", n).withColumn("combinations", F.when(F.col("n_combinations").between(1, limit), grow))
