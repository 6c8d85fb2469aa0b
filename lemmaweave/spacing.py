"""Missing spaces: places where a word may be two or more, each part judged by the dictionary.

Set-based: every part of a word is a span; the distinct texts of spans are analysed and annotated once, and each pass
joins the spans that fit its template. There is no probe budget, so the search of a word is complete unless the word
itself is longer than MAX_CHARS; such a word yields one row that says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dictionary import NOUNS, Dictionary, annotate, compatible_filter
from .functions import hangul as H
from .operators.projections import reading_order
from .plans.analyze import analyze_words
from .storage import cut

MAX_CHARS = 64
# Case particles that may close a nominal part.
CASES = ("이", "가", "을", "를", "에", "에서", "에게", "으로", "로", "와", "과", "의", "도", "은", "는")
#: A noun and the verb that it stands before without a particle.
BARE_PAIRS = [("신경질", "내다"), ("용기", "내다"), ("짜증", "내다"), ("기분", "내키다")]
#: Nouns before 나다 with their entries, and the entry of 나다.
NADA = [
    ("경사", "krdict:30554"), ("구멍", "krdict:34923"), ("구역질", "krdict:35687"), ("몸살", "krdict:54741"), ("물난리", "krdict:56191"), ("발표", "krdict:62470"), ("배탈", "krdict:58720"),
    ("산사태", "krdict:61775"), ("상처", "krdict:62979"), ("소리", "krdict:62379"), ("수염", "krdict:64609"), ("시간", "krdict:62841"), ("식은땀", "krdict:90744"), ("신경질", "krdict:66150"),
    ("신명", "krdict:65770"), ("실감", "krdict:14080"), ("싸움", "krdict:24286"), ("여드름", "krdict:67696"), ("연기", "krdict:67478"), ("윤기", "krdict:71077"), ("전쟁", "krdict:29551"),
    ("짜증", "krdict:71579"), ("큰일", "krdict:72174"), ("탄로", "krdict:80290"), ("탈", "krdict:81494"), ("털", "krdict:71477"), ("토막", "krdict:80558"), ("폼", "krdict:83727"),
    ("감칠맛", "krdict:22602"), ("코피", "krdict:72169"), ("멀미", "krdict:54969"), ("사고", "krdict:66370"), ("교통사고", "krdict:35968"), ("생각", "krdict:58162"), ("냄새", "krdict:58180"),
    ("집", "krdict:71358"), ("사람", "krdict:58161"), ("돈", "krdict:17204"), ("피", "krdict:73269"),
]
MAIN_NADA = "krdict:62210"
#: Bound nouns with their entries and the endings that may stand before them.
BOUND = [
    ("것", "krdict:62835", "은 는 을 던"), ("수", "krdict:15615", "은 는 을"), ("줄", "krdict:91870", "은 는 을"), ("바", "krdict:56324", "은 는 을"), ("적", "krdict:71232", "은 을"), ("지", "krdict:91881", "은"),
    ("듯", "krdict:49981", "은 는 을"), ("뿐", "krdict:66641", "을"), ("대로", "krdict:48415", "은 는 을"), ("만큼", "krdict:53008", "은 는 을"), ("때문", "krdict:64555", "기"), ("따름", "krdict:49675", "을"),
]
#: Words that own a 것 without 의, with their entries.
POSSESSORS = [("우리", "krdict:17182"), ("누구", "krdict:62078"), ("언니", "krdict:31971"), ("친구", "krdict:29742"), ("동생", "krdict:70748"), ("할머니", "krdict:27375"), ("선생님", "krdict:62818")]
#: A surname and a title, with their entries.
SURNAME, TITLE = ("박", "ud-ko-kaist:proper-name:park"), ("선생님", "krdict:62818")


def spans(words: DataFrame, text: str = "text") -> DataFrame:
    """word, n, start, stop and text of each part of each word that is searched, the word itself excluded."""
    w = F.col(text)
    ok = words.where(H.has_hangul(w) & F.char_length(w).between(2, MAX_CHARS)).select(w.alias("word"), F.char_length(w).alias("n")).distinct()
    df = ok.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    df = df.withColumn("stop", F.explode(F.sequence(F.col("start") + 1, F.col("n")))).where("start > 0 or stop < n")
    return df.withColumn("text", F.substring("word", F.col("start") + 1, F.col("stop") - F.col("start")))


def _roles(read: DataFrame, nouns: DataFrame) -> DataFrame:
    """text, role, head and form (of the last morpheme) of each supported reading; nouns: text and id of listed nouns.

    Roles: case, predicate, modifier, bound (a nominal with particles or 들 alone), noun (a listed noun as it is)."""
    first, last = F.get("lemmas", F.lit(0)), F.try_element_at("morphemes", F.lit(-1))
    before = F.try_element_at("morphemes", F.lit(-2))
    one = F.size("lemmas") == 1
    nominal = one & (first["kind"] == "Nominal")
    ending = F.coalesce(last["kind"] == "Ending", F.lit(False))
    form = F.when(ending & (last["form"] == "은") & F.coalesce((before["form"] == "더") & (before["kind"] == "Prefinal"), F.lit(False)), "던").otherwise(last["form"])
    case = nominal & F.coalesce(last["kind"] == "Particle", F.lit(False)) & last["form"].isin(*CASES)
    bound = nominal & F.forall("morphemes", lambda m: (m["kind"] == "Particle") | ((m["kind"] == "Suffix") & (m["form"] == "들")))
    role = lambda when, name: F.when(when, F.lit(name))
    roles = F.array_compact(F.array(role(case, "case"), role((first["kind"] == "Predicate") & ending, "predicate"), role((first["kind"] == "Predicate") & ending & form.isin("은", "는", "을", "던", "기"), "modifier"), role(bound, "bound")))
    out = read.select(F.col("word").alias("text"), F.explode(roles).alias("role"), first["text"].alias("head"), form.alias("form")).distinct()
    plain = nouns.select("text", F.lit("noun").alias("role"), F.col("text").alias("head"), F.lit(None).cast("string").alias("form")).distinct()
    # A bare noun may also be what a bound noun or a title is.
    return out.unionByName(plain).unionByName(plain.withColumn("role", F.lit("bound"))).distinct()


def _hypothesis(df: DataFrame, rule: str, cuts: Column) -> DataFrame:
    return df.select("word", F.lit(rule).alias("rule"), cuts.alias("cuts"))


def _two(left: DataFrame, right: DataFrame) -> DataFrame:
    """Words that are a part of left and a part of right, cut between them (at)."""
    a = left.where("start = 0").select("word", F.col("stop").alias("at"), F.col("head").alias("left_head"), F.col("form").alias("left_form"))
    b = right.where("stop = n").select("word", F.col("start").alias("at"), F.col("head").alias("right_head"), F.col("form").alias("right_form"))
    return a.join(b, ["word", "at"])


def _cases(parts: DataFrame) -> DataFrame:
    """One or more nominals with case, and a predicate."""
    case = parts.where("role = 'case'").select("word", "start", F.col("stop").alias("at")).distinct()
    path = parts.where("role = 'predicate' and stop = n and start > 0").select("word", F.col("start").alias("at"), F.array("start").alias("cuts")).distinct()
    done = None
    while True:
        grown = cut(case.join(path, ["word", "at"]).select("word", F.col("start").alias("at"), F.when(F.col("start") > 0, F.concat(F.array("start"), "cuts")).otherwise(F.col("cuts")).alias("cuts")).distinct(), "cases")
        whole = grown.where("at = 0")
        done = whole if done is None else done.unionByName(whole)
        path = grown.where("at > 0")
        if path.isEmpty():
            return _hypothesis(done, "spacing.nominal_case_predicate", F.col("cuts"))


@F.udf(T.ArrayType(T.IntegerType()))
def _auxiliary_points(lemmas, morphemes):  # noqa: ANN001, ANN202
    """For each lemma, the number of morphemes before it; a null if the parts do not fit together."""
    order = reading_order([(x.text, x.kind) for x in lemmas], [(x.form, x.kind) for x in morphemes])
    if order is None:
        return None
    out, seen = [], 0
    for what, _ in order:
        if what == "lemma":
            out.append(seen)
        else:
            seen += 1
    return out


def _auxiliaries(parts: DataFrame, whole: DataFrame, read: DataFrame) -> DataFrame:
    """Chains of auxiliaries, spaced at one or more of them. Each part must itself have the reading that it has in the chain."""
    chain = whole.where(F.exists("lemmas", lambda x: x["kind"] == "Auxiliary")).select("word", "lemmas", "morphemes", F.monotonically_increasing_id().alias("a"))
    chain = cut(chain.withColumn("points", _auxiliary_points("lemmas", "morphemes")).where("points is not null"), "chains")
    k = F.filter(F.sequence(F.lit(0), F.size("lemmas")), lambda i: (i == 0) | (i == F.size("lemmas")) | (F.get("lemmas", i)["kind"] == "Auxiliary"))
    pairs = F.flatten(F.transform(k, lambda i: F.transform(F.filter(k, lambda j: j > i), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    piece = chain.withColumn("p", F.explode(pairs)).where("p.j - p.i < size(lemmas)")
    at = lambda i: F.when(i == F.size("lemmas"), F.size("morphemes")).otherwise(F.get("points", i))
    lemmas = F.slice("lemmas", F.col("p.i") + 1, F.col("p.j") - F.col("p.i"))
    lemmas = F.transform(lemmas, lambda x, n: F.struct(x["text"].alias("text"), F.when((n == 0) & (x["kind"] == "Auxiliary"), "Predicate").otherwise(x["kind"]).alias("kind")))
    morphemes = F.slice("morphemes", at(F.col("p.i")) + 1, at(F.col("p.j")) - at(F.col("p.i")))
    key = lambda ls, ms: F.concat_ws(" ", ls.cast("string"), ms.cast("string"))
    piece = piece.select("word", "a", F.col("p.i").alias("i"), F.col("p.j").alias("j"), F.size("lemmas").alias("k"), key(lemmas, morphemes).alias("key"))
    known = read.select(F.col("word").alias("text"), key(F.col("lemmas"), F.col("morphemes")).alias("key")).distinct()
    edge = piece.join(parts.select("word", "n", "start", "stop", "text"), "word").join(known, ["text", "key"]).select("word", "a", "i", "j", "k", "n", "start", "stop").distinct()
    edge = cut(edge, "edges")
    path = edge.where("i = 0 and start = 0").select("word", "a", "k", "n", F.col("j").alias("i"), F.col("stop").alias("start"), F.array("stop").alias("cuts"))
    done = None
    while not path.isEmpty():
        grown = cut(path.join(edge.drop("k", "n"), ["word", "a", "i", "start"]).select("word", "a", "k", "n", F.col("j").alias("i"), F.col("stop").alias("start"), F.when(F.col("stop") < F.col("n"), F.array_append("cuts", F.col("stop"))).otherwise(F.col("cuts")).alias("cuts")), "paths")
        whole_ = grown.where("i = k and start = n").select("word", "cuts")
        done = whole_ if done is None else done.unionByName(whole_)
        path = grown.where("i < k and start < n")
    if done is None:
        return _hypothesis(path, "spacing.predicate_auxiliary", F.col("cuts")).limit(0)
    return _hypothesis(done, "spacing.predicate_auxiliary", F.col("cuts"))


def suggest(words: DataFrame, dictionary: Dictionary, text: str = "text") -> DataFrame:
    """word, rule, spaced, inserted_at (byte offsets), complete and limited_by of each hypothesis; place: its order for the word, by the number of spaces and where they are."""
    places = cut(spans(words, text), "spans")
    whole = analyze_words(words, text)
    read = cut(compatible_filter(annotate(analyze_words(places.select("text")).where("not unchanged"), dictionary)), "readings")
    entries = dictionary.entries().select(F.col("lookup").alias("text"), "id", "pos")
    listed = cut(entries.join(places.select("text").distinct(), "text", "left_semi"), "listed")
    roles = cut(_roles(read, listed.where(F.col("pos").isin(*NOUNS))), "roles")
    parts = cut(places.join(roles, "text"), "parts")
    spark = words.sparkSession
    has = lambda df, head, id_: df.join(F.broadcast(listed.select(F.col("text").alias(head), F.col("id").alias(id_)).distinct()), [head, id_], "left_semi")
    of = lambda name: parts.where(F.col("role") == name)

    out = [_cases(parts), _auxiliaries(places, whole, read)]
    at = F.array("at")
    pairs = spark.createDataFrame(BARE_PAIRS, "left_head string, right_head string")
    verbs = _two(of("noun"), of("predicate"))
    out.append(_hypothesis(verbs.join(F.broadcast(pairs), ["left_head", "right_head"]), "spacing.bare_noun_lexical_verb", at))
    nada = spark.createDataFrame(NADA, "left_head string, left_id string")
    main = entries.where((F.col("id") == MAIN_NADA) & (F.col("text") == "나다")).select(F.col("text").alias("right_head")).distinct()
    out.append(_hypothesis(has(verbs.join(F.broadcast(nada), "left_head"), "left_head", "left_id").join(F.broadcast(main), "right_head", "left_semi"), "spacing.bare_noun_main_nada", at))
    bound = spark.createDataFrame([(h, i, f) for h, i, fs in BOUND for f in fs.split()], "right_head string, right_id string, left_form string")
    out.append(_hypothesis(has(_two(of("modifier"), of("bound")).join(F.broadcast(bound), ["right_head", "left_form"]), "right_head", "right_id"), "spacing.modifier_bound_noun", at))
    things = spark.createDataFrame([(h, i) for h, i, _ in BOUND if h in ("것", "때문")], "right_head string, right_id string")
    owners = of("case").where("form = '의'").unionByName(of("noun"))
    owned = has(_two(owners, of("bound")).join(F.broadcast(things), "right_head"), "right_head", "right_id")
    possessors = spark.createDataFrame(POSSESSORS, "left_head string, left_id string")
    bare = has(owned.where("right_head = '것' and left_form is null").join(F.broadcast(possessors), "left_head"), "left_head", "left_id").select(*owned.columns)
    out.append(_hypothesis(owned.where("right_head = '때문' or left_form = '의'").unionByName(bare), "spacing.nominal_bound_noun", at))
    # A surname before a title, and what both own.
    name = listed.where((F.col("text") == SURNAME[0]) & (F.col("id") == SURNAME[1])).select("text").distinct()
    title = listed.where((F.col("text") == TITLE[0]) & (F.col("id") == TITLE[1])).select("text").distinct()
    there = name.crossJoin(title).limit(1).select(F.lit(True).alias("there"))  # one row or none
    park = of("bound").where((F.col("head") == TITLE[0]) & (F.col("start") == 1) & F.col("word").startswith(SURNAME[0])).join(F.broadcast(there))
    out.append(_hypothesis(park.where("stop = n"), "spacing.proper_name_title", F.array("start")))
    thing = has(of("bound").where("head = '것' and stop = n").withColumn("right_head", F.lit("것")).withColumn("right_id", F.lit(BOUND[0][1])), "right_head", "right_id").select("word", F.col("start").alias("stop"))
    out.append(_hypothesis(park.where("form is null or form = '의'").select("word", "start", "stop").distinct().join(thing, ["word", "stop"]), "spacing.proper_name_title_possession", F.array("start", "stop")))

    found = out[0]
    for df in out[1:]:
        found = found.unionByName(df)
    found = found.distinct()
    pieces = F.transform(F.concat(F.array(F.lit(0)), "cuts"), lambda a, i: F.substring("word", a + 1, F.coalesce(F.get("cuts", i), F.char_length("word")) - a))
    none = F.expr("cast(array() as array<string>)")
    offsets = F.transform("cuts", lambda c: F.octet_length(F.left(F.col("word"), c)).cast("long"))
    done = found.select("word", "rule", F.array_join(pieces, " ").alias("spaced"), offsets.alias("inserted_at"), F.lit(True).alias("complete"), none.alias("limited_by"))
    long = words.where(F.char_length(text) > MAX_CHARS).select(F.col(text).alias("word")).distinct()
    unsearched = long.select("word", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("spaced"), F.expr("cast(array() as array<bigint>)").alias("inserted_at"), F.lit(False).alias("complete"), F.array(F.lit("token_chars")).alias("limited_by"))
    from pyspark.sql import Window

    order = Window.partitionBy("word").orderBy(F.size("inserted_at"), "inserted_at", "rule")
    return done.unionByName(unsearched).withColumn("place", F.row_number().over(order))
