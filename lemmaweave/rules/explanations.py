"""What each provenance rule of an analysis means."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import table
from .provenance import FAMILIES

EXPLANATIONS = {
    "identity": "the word as it stands, unclassified",
    "ending": "a terminal ending of a predicate",
    "boundary.regular": "stem and ending meet unchanged",
    "boundary.consonant": "the ending needs a closed stem",
    "boundary.eu": "으 stands after a closed stem and is left out after an open one or ㄹ",
    "boundary.attached": "the ending's first consonant closes the last syllable",
    "boundary.copular": "an ending of the copula or of 아니다",
    "irregular.digeut": "ㄷ becomes ㄹ before a vowel",
    "irregular.siot": "ㅅ drops before a vowel",
    "irregular.bieup": "ㅂ becomes 우 or 오 before a vowel",
    "irregular.hieut": "ㅎ drops or merges before a vowel",
    "irregular.reu": "르 doubles its ㄹ before 아/어",
    "irregular.reo": "르 takes 러 for 어",
    "irregular.ha": "하 takes 여, together 해",
    "irregular.pu": "푸 loses its vowel",
    "contraction.identical": "아/어 is absorbed by the same vowel",
    "contraction.yeo_absorption": "ㅕ absorbs 어",
    "contraction.vowel": "two vowels are written as one",
    "contraction.noh": "놓아 is written 놔",
    "contraction.deictic_verb": "a whole form of 그러다 and its like",
    "contraction.ha_aspiration": "하 leaves its ㅎ to the next consonant",
    "deletion.eu": "ㅡ drops before 아/어",
    "deletion.rieul": "ㄹ drops before ㄴ, ㅂ, ㅅ or 오",
    "deletion.ha": "하 drops after a stop",
    "inflection.written_vowel": "a whole form with its own vowel",
    "copula": "a nominal with 이다",
    "copula.zero": "이 is left out after an open nominal",
    "copula.omitted_ending": "이 is left out before a fuller ending",
    "copula.polite": "이에요, 예요 and their like",
    "negative_copula.polite": "아니에요",
    "nominalization": "기 or 음 makes the clause a nominal",
    "auxiliary": "an auxiliary predicate after a connective ending",
    "pronoun": "a pronoun's own form before a particle",
    "pronoun.contraction": "a pronoun joined with a particle",
    "nominal.contraction": "것 joined with a particle",
    "particle": "a particle after a nominal or clause",
    "particle.polite": "요",
    "particle.distributive": "들 as a particle",
    "particle.contraction.n": "는 shortened to ㄴ",
    "particle.contraction.l": "를 shortened to ㄹ",
    "suffix.plural": "들 as a suffix",
    "suffix.honorific": "님",
    "suffix.relational": "적",
    "suffix.approximation": "쯤",
    "suffix.distributive.ssik": "씩",
    "prefinal.past": "었",
    "prefinal.honorific": "시",
    "prefinal.modal": "겠",
    "prefinal.obligation": "어야겠",
    "prefinal.retrospective": "더",
    "prefinal.polite": "으옵",
    "prefinal.humble_saop": "사옵",
    "prefinal.humble_sap": "삽",
    "prefinal.honorific_polite": "으옵시, 사옵시",
    "pronunciation.assumed_consonant": "the foreign base is taken to end in a consonant",
    "pronunciation.assumed_vowel": "the foreign base is taken to end in a vowel",
    "pronunciation.assumed_non_rieul_consonant": "the foreign base is taken to end in a consonant other than ㄹ",
    "pronunciation.assumed_vowel_or_rieul": "the foreign base is taken to end in a vowel or ㄹ",
    "spacing.nominal_case_predicate": "a space between a nominal with its case and a predicate",
    "spacing.predicate_auxiliary": "a space before an auxiliary",
    "irregular.mal": "the short imperatives 마, 마라 and 마요 of 말다",
    "contraction.negative": "지 않 written as 잖, or 하지 않 as 찮",
    "copula.omitted_honorific": "이 is left out before 시",
    "copula.omitted_polite": "이 is left out before 오",
    "copula.omitted_prefinal": "이 is left out before 더 or 겠",
    "copula.omitted_fragment": "라는 whose nominal stands elsewhere",
    "copula.fragment": "the copula written apart from its nominal",
    "copula.adverbial_base": "이다 on a listed adverb",
    "copula.connective_seo": "이다 on a clause in 어서",
    "copula.intention_relational": "a copula on 적 before an intention",
    "nominal.colloquial_geot": "거 for 것",
    "prefinal.conjectural_ni": "으리 before 니",
    "prefinal.conjectural_quotation": "으리 before 란",
    "prefinal.conjectural_ra": "으리 before the endings of a fact",
    "ending.factual_ra": "an ending of a fact",
    "ending.exclamation_variant": "구만 for 구먼",
    "formal_b.attested_stem_b": "아름답네, whose stem keeps its ㅂ",
    "copula.omitted_ppundeoreo": "이 is left out before 을뿐더러",
    "copula.omitted_geona": "이 is left out before 을거나",
    "copula.omitted_kko": "이 is left out before 을꼬",
    "copula.omitted_rya": "이 is left out before 으랴",
    "prefinal.lexical_jaop": "자옵 after four stems",
    "prefinal.lexical_jap": "잡 after four stems",
    "prefinal.lexical_jaopsi": "자옵시 after four stems",
    "particle.adverbial_focus": "a particle of focus after an adverb",
    "particle.adverbial_case": "a case form that stresses a listed adverb",
    "particle.additive_adverb": "조차 after a listed adverb",
    "particle.coda": "a particle whose first consonant closes the base",
    "particle.contraction.nkeonyeong": "는커녕 shortened to ㄴ커녕",
    "particle.familiar_gryeo": "그려 after an ending",
    "particle.familiar_geurae": "그래 after an ending",
    "particle.chigo": "치고 and its like",
    "particle.comparison_extent": "만치, 마냥 and 토록",
    "particle.enumerative_da": "이다 or 다 in a list of nouns",
    "particle.emphatic_adverbial": "다 or 다가 that stresses a place",
    "particle.emphatic_destination": "에다, 로다가 and their like",
    "particle.enumerative": "이든가, 라든지 and their like",
    "particle.recipient": "보고, 더러, 게 and their like",
    "auxiliary.internal_particle": "a particle between a connective and the next predicate",
    "auxiliary.doeda.extended": "되다 after 어야, 으면, 어도 and their like",
    "lexical.doeda.complement": "되다 as a predicate of its own after 게",
    "lexical.doeda.extended": "되다 as a predicate of its own after 도록, 기로 and their like",
    "doeda.negative_bridge": "안 between a clause and 되다",
    "lexical.mal.complement": "말다 that breaks off or offers the alternative",
    "lexical.mal.paired_branch": "an alternative that a later predicate closes",
    "lexical.mal.nominal": "말다 with its object or a noun in contrast",
    "lexical.mal.fixed_adverb": "꼼짝 before 말다",
    "suffix.nominal.i": "이 that makes a noun",
    "suffix.nominal.dungi": "둥이",
    "suffix.nominal.bagi": "박이",
    "suffix.nominal.hwa": "화",
    "suffix.nominal.si": "시 that makes a noun",
    "suffix.adverbial.i": "이 that makes an adverb",
    "suffix.adverbial.hi": "히 that makes an adverb",
    "suffix.adjectival.dap": "답다 on a nominal",
    "suffix.verb.doeda": "되다 that makes a verb",
    "suffix.adjective.doeda": "되다 that makes an adjective",
    "suffix.verb.hada": "하다 that makes a verb",
    "suffix.adjective.hada": "하다 that makes an adjective",
    "suffix.auxiliary.verb.hada": "하다 on a bound noun, as an auxiliary verb",
    "suffix.auxiliary.adjective.hada": "하다 on a bound noun, as an auxiliary adjective",
    "suffix.distributive.ssik.adverbial_base": "씩 on an adverb",
    "compound.predicate.well_doeda": "잘 and 되다",
    "derivation.adverbial.adverb": "an adverb that takes a suffix",
    "derivation.adverbial.nominal": "a repeated nominal that becomes an adverb",
    "derivation.adverbial.hada": "the root of a 하다 adjective becomes an adverb",
    "derivation.adverbial.bieup": "a ㅂ stem that has lost its ㅂ before 이",
    "derivation.adverbial.shortened": "a shortened root before 히",
    "derivation.adverbial.lexical": "an adverb with a spelling of its own",
    "derivation.adverbial.opaque": "a root that stands in the adverb only",
    "derivation.adverbial.related_opaque": "the adjective that such a root is related to",
    "derivation.nominal.adnominal": "a noun on an adnominal form",
    "derivation.nominal.bound_i": "the bound noun 이 after an adnominal form",
    "derivation.nominal.related_root": "the predicate that a noun's root is related to",
    "derivation.nominal.root_compound": "a noun of a nominal and a bound root",
    "derivation.nominal.prefix_wang": "the prefix 왕",
    "derivation.nominal.prefix_eol": "the prefix 얼",
    "derivation.nominal.compound": "a noun of two parts and 이",
    "derivation.nominal.compound_l_loss": "such a noun whose first part has lost its ㄹ",
    "spacing.bare_noun_lexical_verb": "a space between a noun and its listed verb",
    "spacing.bare_noun_main_nada": "a space between a noun and 나다",
    "spacing.modifier_bound_noun": "a space before a bound noun",
    "spacing.nominal_bound_noun": "a space between a noun and 것 or 때문",
    "spacing.proper_name_title": "a space between a name and a title",
    "spacing.proper_name_title_possession": "spaces in a name with a title that owns something",
}


def explanations(spark: SparkSession) -> DataFrame:
    rows = EXPLANATIONS | {rule: said for rule, said, _ in FAMILIES}
    return table(spark, "explanations", sorted(rows.items()), "rule string, explanation string")


def explain(analyses: DataFrame) -> DataFrame:
    """word, rule and explanation of each rule that an analysis names."""
    from pyspark.sql import functions as F

    rules = analyses.select("word", F.explode("rules").alias("rule")).distinct()
    return rules.join(F.broadcast(explanations(analyses.sparkSession)), "rule", "left")
