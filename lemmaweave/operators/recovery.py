"""From a surface and a rule's suffix and boundary to the stems that could have met there.

Suffixes are matched by one broadcast join; each boundary is a set of guarded expressions over the last two
syllables. No row leaves its task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hangul as H
from ..rules import once_each

# Whole surfaces and their stems.
FINITE = {"가냘파": "가냘프", "크나커": "크나크", "동터": "동트", "못써": "못쓰", "받아써": "받아쓰", "본떠": "본뜨", "손써": "손쓰", "싹터": "싹트", "악써": "악쓰", "약아": "약", "얇아": "얇", "얕아": "얕", "어째": "어쩌"}
DEICTIC_VERB = {"그래": "그러", "이래": "이러", "저래": "저러", "고래": "고러", "요래": "요러", "조래": "조러"}
DEICTIC_ADJECTIVE = {"그래": "그렇", "이래": "이렇", "저래": "저렇", "어때": "어떻", "고래": "고렇", "요래": "요렇", "조래": "조렇", "아무래": "아무렇"}
BIEUP_O = ("도", "고", "곱디고", "듣자", "받자")
STOPS = (1, 2, 3, 7, 9, 14, 17, 18, 19, 20, 22, 23, 24, 25, 26)
SONORANTS = (0, 4, 5, 8, 10, 12, 13, 16, 21)
#: Reports of statements, after whose attached ㄴ no irregular stem is restored.
REPORTS = "다 다고 다니 다느니 단 다는 다면 답니다 다거나 다든가 단다 다지 다죠 다지만 다니까 대 다네 다는데 다던 다더니 다나 다오 답니까 담 다마는 다만 답시고 다더니만 다더니마는 다던데 다며 다면서".split()
MAX_SUFFIX = 6


def match_suffixes(df: DataFrame, text: str, rules: DataFrame, *, longest: int = MAX_SUFFIX) -> DataFrame:
    """df joined to each rule whose suffix ends the text; base is what stands before it."""
    ends = df.withColumn("__k", F.explode(F.sequence(F.lit(0), F.least(F.char_length(text) - 1, F.lit(longest)))))
    ends = ends.withColumn("suffix", F.right(F.col(text), F.col("__k"))).withColumn("base", F.left(F.col(text), F.char_length(text) - F.col("__k")))
    return ends.drop("__k").join(F.broadcast(rules), "suffix")


def _map(m: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), key)


def _to(v: Column, pairs: dict[int, int]) -> Column:
    out = F.when(v == -2, -2)
    for a, b in pairs.items():
        out = out.when(v == a, b)
    return out


@once_each
def _hypotheses() -> Column:
    """All hypotheses over the columns base, suffix, boundary, attached and the syllables __n, __h, __p; built once, as a Column names its inputs."""
    base, n, head, p = F.col("base"), F.col("__n"), F.col("__h"), F.col("__p")
    v, t, pv, pt = H.vowel(n), H.coda(n), H.vowel(p), H.coda(p)
    last, bright = H.last_char(base), H.is_bright(p)
    boundary, attached, suffix = F.col("boundary"), F.col("attached"), F.col("suffix")
    first = H.initial(H.index(F.left(suffix, F.lit(1))))
    drops = suffix.startswith("오") | suffix.startswith("옵") | first.isin(2, 7, 9)
    at = lambda name: boundary == name
    ba, ta = lambda vv, tt: H.replace_last(base, vv, F.lit(tt)), lambda tt: H.replace_last(head, pv, F.lit(tt))

    out: list[Column] = []

    def row(when: Column, stem: Column, rule: str) -> None:
        out.append(F.when(when & F.coalesce(stem != "", F.lit(False)), F.struct(stem.alias("stem"), F.array(F.lit(rule)).alias("rules"), F.lit(None).cast("string").alias("spelling"))))

    # 아/어: separate vowel
    aeo, a, eo = at("Aeo"), last == "아", last == "어"
    separate = aeo & (p >= 0)
    not_ha = H.last_char(head) != "하"
    row(separate & not_ha & ((a & bright & (pt != 20)) | (eo & (~bright | (pt == 20)))), head, "boundary.regular")
    row(separate & (last == "여") & ~not_ha, head, "irregular.ha")
    harmony = (a & bright) | (eo & ~bright)
    row(separate & harmony & (pt == 8), ta(7), "irregular.digeut")
    row(separate & harmony & (pt == 0), ta(19), "irregular.siot")
    # 아/어: contracted into an open syllable
    open_ = aeo & (t == 0)
    row(open_ & v.isin(0, 4, 1, 5) & (last != "하"), base, "contraction.identical")
    row(open_ & (v == 6), base, "contraction.yeo_absorption")
    row(open_, _map(FINITE, base), "inflection.written_vowel")
    row(open_ & v.isin(9, 14, 10, 6), ba(_to(v, {9: 8, 14: 13, 10: 11, 6: 20}), 0), "contraction.vowel")
    row(open_ & (((v == 0) & bright) | ((v == 4) & ~bright)), ba(F.lit(18), 0), "deletion.eu")
    row(open_ & (last == "해"), F.concat(head, F.lit("하")), "irregular.ha")
    row(open_ & (last == "놔"), F.concat(head, F.lit("놓")), "contraction.noh")
    row(open_ & (base == "퍼"), F.lit("푸"), "irregular.pu")
    row(open_ & (pt == 8) & (((last == "라") & bright) | ((last == "러") & ~bright)), F.concat(ta(0), F.lit("르")), "irregular.reu")
    row(open_ & base.endswith("르러"), head, "irregular.reo")
    row(open_ & v.isin(1, 3, 5, 7), ba(v - 1, 27), "irregular.hieut")
    row(open_, _map(DEICTIC_VERB, base), "contraction.deictic_verb")
    row(open_, _map(DEICTIC_ADJECTIVE, base), "irregular.hieut")
    # Endings that start with a consonant
    literal = at("Literal") & (n >= 0)
    row(literal & (~drops | (t != 8)), base, "boundary.regular")
    zero = at("EuZero")
    row((literal | zero) & drops & (t == 0), ba(v, 8), "deletion.rieul")
    row(at("ComeStem") & (last == "오"), base, "boundary.regular")
    row((at("Consonant") & ~t.isin(-1, 0, 8)) | (at("ClosedStem") & (t > 0)), base, "boundary.consonant")
    # 으
    full = at("EuFull")
    row((full & ~t.isin(-1, 0, 8)) | (zero & ((t == 0) | (~drops & (t == 8)))), base, "boundary.eu")
    row(full & (t == 8), ba(v, 7), "irregular.digeut")
    row(full & (t == 0), ba(v, 19), "irregular.siot")
    # A coda that belongs to the ending
    taken = at("Attached") & (t == attached)
    row(taken, ba(v, 0), "boundary.attached")
    row(taken & (attached != 16), ba(v, 8), "deletion.rieul")
    row(at("Attached") & (attached == 16) & (t == 10), ba(v, 8), "boundary.attached")
    # ㅂ and ㅎ before 으 that is left out
    cut = F.when(zero, base).otherwise(ba(v, 0))
    loose = (zero & (t == 0)) | (taken & ((attached != 17) | (suffix == "시다")) & ~suffix.isin(*REPORTS))
    lone = H.last_char(cut)
    special = head.isin("듣자", "받자")
    row(loose & pt.isin(0, 8) & (((lone == "우") & ~special) | ((lone == "오") & special & (pt == 0))), H.replace_last(head, pv, F.when(pt == 8, 11).otherwise(17)), "irregular.bieup")
    row(loose, ba(v, 27), "irregular.hieut")
    # Copula
    row(at("Copular") & ((last == "이") | (base == "아니")), base, "boundary.copular")
    row(at("ZeroCopula") & (t == 0), F.concat(base, F.lit("이")), "copula.zero")
    row(at("OmittedCopula") & (attached == 0) & (t == 0), F.concat(base, F.lit("이")), "copula.omitted_ending")
    row(at("OmittedCopula") & (attached > 0) & (t == attached), F.concat(ba(v, 0), F.lit("이")), "copula.omitted_ending")
    # Shortened 하다
    row(at("HaDeletion") & t.isin(*STOPS), F.concat(base, F.lit("하")), "deletion.ha")
    row(at("HaAspiration") & t.isin(*SONORANTS), F.concat(base, F.lit("하")), "contraction.ha_aspiration")
    return F.filter(F.array(*out), lambda x: x.isNotNull())


@once_each
def _with_bieup() -> Column:
    """A hypothesis __r, and the one with ㅂ behind an 우/오 that 아/어 left."""
    stem = F.col("__r.stem")
    front = H.but_last(stem)
    m = H.index(H.last_char(front))
    end = H.last_char(stem)
    again = (F.col("boundary") == "Aeo") & H.coda(m).isin(0, 8) & (((end == "우") & ~front.isin(*BIEUP_O)) | ((end == "오") & front.isin(*BIEUP_O) & (H.coda(m) == 0)))
    bieup = F.struct(H.replace_last(front, H.vowel(m), F.when(H.coda(m) == 8, 11).otherwise(17)).alias("stem"), F.array(F.lit("irregular.bieup")).alias("rules"), F.lit(None).cast("string").alias("spelling"))
    return F.filter(F.array(F.col("__r"), F.when(again, bieup)), lambda x: x.isNotNull())


@once_each
def _syllables() -> dict[str, Column]:
    head = H.but_last(F.col("base"))
    return {"__n": H.index(H.last_char(F.col("base"))), "__h": head, "__p": H.index(H.last_char(head))}


@once_each
def _spelling() -> Column:
    return spelling_class(F.col("__r.stem"), F.element_at("__r.rules", 1), F.col("boundary"))


def recover(df: DataFrame) -> DataFrame:
    """df (base, suffix, boundary, attached) with stem, the rules of the recovery (found) and its spelling class, a row a hypothesis."""
    kept = [c for c in df.columns if c != "stem"]
    df = df.select(*kept, *[c.alias(k) for k, c in _syllables().items()])
    df = df.select(*kept, F.explode(_hypotheses()).alias("__r"))
    df = df.select(*kept, F.explode(_with_bieup()).alias("__r"))
    return df.select(*kept, F.col("__r.stem").alias("stem"), F.col("__r.rules").alias("found"), _spelling().alias("spelling"))


def spelling_class(stem: Column, rule: Column, boundary: Column) -> Column:
    """The spelling paradigm that a recovery before a vowel presumes."""
    t = H.text_coda(stem)
    out = F.when(rule == "irregular.reu", "ReuDoubling").when(rule == "irregular.reo", "ReoAddition").when((rule == "deletion.eu") & stem.endswith("르"), "ReuEuDeletion")
    for code, name in ((27, "Hieut"), (7, "Digeut"), (19, "Siot"), (17, "Bieup")):
        out = out.when(rule == f"irregular.{name.lower()}", f"{name}Irregular").when((t == code) & boundary.isin("Aeo", "EuFull"), f"{name}Regular")
    return out
