"""Words that are listed as derived: nouns and adverbs as whole surfaces with the parts that they were made of.

Two kinds of formations are open tables, which a caller may extend: heads in 되다 and 하다 with their base
(formations), and nominals in 화 and 시."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import table

ANALYSIS = "surface string, lemmas array<struct<text:string,kind:string>>, morphemes array<struct<form:string,kind:string>>, rules array<string>"
Row = tuple[str, list[tuple[str, str]], list[tuple[str, str]], list[str]]

# ---- fixed values: adverbs -----------------------------------------------------------------------

#: Adverbs before 씩.
SSIK_BASES = "가끔 살짝 이따금 이만큼 잠깐 조금 하나하나 한바탕 한발"
#: Roots of 하다 adjectives with 히, and with 이.
HADA_HI = """
익숙 특별 가득 가뿐 가지런 나란 날렵 냉랭 냉정 냉철 냉혹 너끈 넉넉 느슨 능 다급 다분 다정 다행 단단 단순 단정 단호 담담 마땅 막연 만만 말끔 망연 맹렬 멀뚱 멀쩡 멍청 멍 무사 부단
부지런 분명 분분 분주 안녕 영원 조용 엄격 과감 급급 꼼꼼 도저 무단 열심 상당
"""
HADA_I = "기웃 버젓 번듯 반듯 지긋 산뜻 깨끗 깊숙"
#: Adverbs and repeated nominals that take a suffix.
ADVERB_I = "곰곰 더욱 일찍 오뚝 히죽 생긋"
ADVERB_HI = "가만 단연"
NOMINAL_I = "겹겹 곳곳 낱낱 몫몫 샅샅 앞앞 집집 누누 다달 번번 올올 일일 점점 줄줄 짬짬 첩첩 층층 켜켜 칸칸 틈틈 푼푼"
#: Stems before 이, and those whose last syllable has lost a ㅂ.
STEM_I = "굳 길 깊 높 많 헛되 적잖"
BIEUP_I = {"가까이": "가깝", "가벼이": "가볍", "고이": "곱", "새로이": "새롭", "외로이": "외롭", "즐거이": "즐겁"}
LEXICAL_ADVERBS = {"익히": ("익숙하", "히", "shortened"), "특히": ("특별하", "히", "shortened"), "달리": ("다르", "이", "lexical"), "빨리": ("빠르", "이", "lexical")}

# ---- fixed values: nouns -------------------------------------------------------------------------

NOUN_I = {"굽이": "굽다", "깊이": "깊다", "넓이": "넓다", "길이": "길다", "놀이": "놀다", "높이": "높다", "먹이": "먹다", "벌이": "벌다", "떠돌이": "떠돌다", "까불이": "까불다"}
NOUN_I_NOMINAL = {"까막눈이": "까막눈", "노랑이": "노랑", "동강이": "동강", "바둑이": "바둑", "얼간이": "얼간", "허풍선이": "허풍선"}
NOUN_I_SOUND = "깜빡 깡깡 깽깽 꿀꿀 덜렁 딸랑 오뚝 짝짝"
NOUN_I_ROOT = {"끈끈이": ("끈끈", ["끈끈하다"]), "누렁이": ("누렁", []), "뚱뚱이": ("뚱뚱", ["뚱뚱하다"]), "멍청이": ("멍청", ["멍청하다"]), "미치광이": ("미치광", []), "합죽이": ("합죽", ["합죽하다", "합죽거리다"]), "홀쭉이": ("홀쭉", ["홀쭉하다"]), "왕눈이": ("왕눈", []), "됨됨이": ("됨됨", []), "쭉정이": ("쭉정", [])}
NOUN_PREFIX = {"왕눈이": ("왕", "눈", "wang"), "얼간이": ("얼", "간", "eol")}
NOUN_COMPOUND = {"점박이": ("점", "Nominal", "박다"), "길잡이": ("길", "Nominal", "잡다"), "목걸이": ("목", "Nominal", "걸다"), "옷걸이": ("옷", "Nominal", "걸다"), "젖먹이": ("젖", "Nominal", "먹다"), "미닫이": ("밀다", "Predicate", "닫다")}
NOUN_ADNOMINAL = {"못난이": ("못나다", "못난", "이", "i"), "흰둥이": ("희다", "흰둥", "둥이", "dungi")}
HWA = "가속 가시 개념 개방 개별 객관 격식 내면 내실 노령 민영 민주 보편 상품 생활 온난 이론 이상 일반 일상 제도 조직 최소 토착 특수 표준 합리 황폐"
HWA_PASSIVE = "가속 가시 개방 객관 내면 민영 민주 보편 상품 생활 이론 이상 일반 일상 제도 조직 토착 특수 표준 합리 황폐"
SI = "동일 문제 야만 의문 적대 죄악 중요"
SI_PASSIVE = "동일 문제 의문 죄악 중요"


def adverb_rows() -> list[Row]:
    out: list[Row] = []

    def row(surface: str, text: str, kind: str, suffix: str, *rules: str) -> None:
        out.append((surface, [(text, kind)], [(suffix, "Suffix")], sorted(rules)))

    name = {"이": "suffix.adverbial.i", "히": "suffix.adverbial.hi"}
    for suffix, roots in (("이", ADVERB_I), ("히", ADVERB_HI)):
        for r in roots.split():
            row(r + suffix, r, "Adverbial", suffix, "derivation.adverbial.adverb", name[suffix])
    for r in NOMINAL_I.split():
        row(r + "이", r, "Nominal", "이", "derivation.adverbial.nominal", name["이"])
    for suffix, roots in (("히", HADA_HI), ("이", HADA_I)):
        for r in roots.split():
            row(r + suffix, r + "하다", "Predicate", suffix, "derivation.adverbial.hada", name[suffix])
    for r in STEM_I.split():
        row(r + "이", r + "다", "Predicate", "이", name["이"])
    for surface, stem in BIEUP_I.items():
        row(surface, stem + "다", "Predicate", "이", "derivation.adverbial.bieup", name["이"])
    for surface, (stem, suffix, why) in LEXICAL_ADVERBS.items():
        more = ("derivation.adverbial.hada",) if why == "shortened" else ()
        row(surface, stem + "다", "Predicate", suffix, f"derivation.adverbial.{why}", name[suffix], *more)
    for r in SSIK_BASES.split():
        row(r + "씩", r, "Adverbial", "씩", "suffix.distributive.ssik", "suffix.distributive.ssik.adverbial_base")
    for r, related in (("천천", "천천하다"), ("분연", None)):
        row(r + "히", r, "Root", "히", "derivation.adverbial.opaque", name["히"])
        if related:
            row(r + "히", related, "Predicate", "히", "derivation.adverbial.related_opaque", "derivation.adverbial.hada", name["히"])
    return out


def noun_rows() -> list[Row]:
    out: list[Row] = []

    def row(surface: str, lemmas: list[tuple[str, str]], morphs: list[tuple[str, str]], *rules: str) -> None:
        out.append((surface, lemmas, morphs, sorted(rules)))

    i, noun = [("이", "Suffix")], "suffix.nominal.i"
    for b in HWA.split():
        row(b + "화", [(b, "Nominal")], [("화", "Suffix")], "suffix.nominal.hwa")
    for b in SI.split():
        row(b + "시", [(b, "Nominal")], [("시", "Suffix")], "suffix.nominal.si")
    for s, (head, root, suffix, why) in NOUN_ADNOMINAL.items():
        row(s, [(root, "Root")], i, noun)
        row(s, [(head, "Predicate")], [("ㄴ", "Ending"), (suffix, "Suffix")], "ending", "boundary.regular", "derivation.nominal.adnominal", f"suffix.nominal.{why}")
    row("못난이", [("못나다", "Predicate"), ("이", "Nominal")], [("ㄴ", "Ending")], "ending", "boundary.regular", "derivation.nominal.bound_i")
    for s, (root, related) in NOUN_I_ROOT.items():
        row(s, [(root, "Root")], i, noun)
        for head in related:
            row(s, [(head, "Predicate")], i, noun, "derivation.nominal.related_root")
    for b in NOUN_I_SOUND.split():
        row(b + "이", [(b, "Adverbial")], i, noun)
    row("뺑뺑이", [("뺑뺑", "Root")], i, noun)
    for s, b in NOUN_I_NOMINAL.items():
        row(s, [(b, "Nominal")], i, noun)
    row("허풍선이", [("허풍", "Nominal"), ("선", "Root")], i, noun, "derivation.nominal.root_compound")
    for s, (prefix, base, why) in NOUN_PREFIX.items():
        row(s, [(base, "Nominal")], [(prefix, "Prefix"), *i], noun, f"derivation.nominal.prefix_{why}")
    for s, (left, kind, right) in NOUN_COMPOUND.items():
        more = ("derivation.nominal.compound_l_loss",) if s == "미닫이" else ()
        row(s, [(left, kind), (right, "Predicate")], i, noun, "derivation.nominal.compound", *more)
    row("점박이", [("점", "Nominal")], [("박이", "Suffix")], "suffix.nominal.bagi")
    for s, head in NOUN_I.items():
        row(s, [(head, "Predicate")], i, noun)
    return out


def listed_adverbs(spark: SparkSession) -> DataFrame:
    return table(spark, "listed_adverbs", adverb_rows(), ANALYSIS)


def listed_nouns(spark: SparkSession) -> DataFrame:
    return table(spark, "listed_nouns", noun_rows(), ANALYSIS)


# ---- fixed values: heads that are a base and a suffix ---------------------------------------------

DOEDA_VERBS = """
가결 가공 가석방 가열 감금 감염 개봉 개선 개편 거래 거론 건조 결정 결제 계획 공개 관찰 구조 구출 규정 규제 금지 기대 기록 낙오 당선 당첨 마련 마비 매각 면제 밀폐 반감 반복 발견 발굴 발급
발효 방영 방해 배출 변형 보관 복제 부담 비교 사용 생각 생산 선출 설립 세습 소각 소개 소유 소장 습득 시작 실시 악화 애용 연결 연상 운행 유배 의심 이룩 이송 이식 이용 인수 임명 입양 잘못
장착 재건 저장 적용 전개 전달 전멸 전수 전승 전시 전염 전파 정리 제외 조정 종료 준비 중계 중시 지배 지불 진압 진열 진전 진행 진화 징용 차단 채택 첨가 출제 취소 취직 타도 투입 파견 파손
파악 평가 폐기 폐지 포함 폭로 함락 함몰 함유 해방 해산 해임 해제 해직 허가 허락 형성 혼동 확대 확립 확보 확산 휴전
"""
DOEDA_ADJECTIVES = {"Nominal": "거짓 망령 보람 복 세련 영광 욕 유감 참 충만", "Root": "고 속 앳 외람 편벽 허황 헛 호", "Adverbial": "덜 막 못 안 오래 한갓"}
HADA_VERBS = {"Nominal": "공부 밥 빨래 사랑 생각 절", "Adverbial": "반짝반짝 소곤소곤 덜컹덜컹 달리 빨리 잘", "Root": "망 흥"}
HADA_ADJECTIVES = {"Nominal": "건강 순수 정직 진실 행복", "Adverbial": "반짝반짝 돌연", "Root": "따뜻 착"}
HADA_AUXILIARY_VERBS = "양 척 체"
HADA_AUXILIARY_ADJECTIVES = "듯 법 뻔 양"
#: Nominals in 화 and 시 before 하다.
HADA_NOMINALS = """
가속화 가시화 간소화 개방화 객관화 내면화 다변화 다양화 다원화 민영화 민주화 보편화 상품화 생활화 의인화 이론화 이상화 일반화 일상화 제도화 조직화 최소화 토착화 특수화 표준화 합리화
황폐화 획일화 동일시 등한시 문제시 야만시 의문시 적대시 죄악시 중요시
"""
Formation = tuple[str, str, str, str, str, str]


def formations(more: list[Formation] | None = None) -> list[Formation]:
    """(head, kind of the head, base, kind of the base, suffix, rule). more: further ones, such as all native heads in 되다 of a dictionary."""
    out: list[Formation] = [(b + "되다", "Predicate", b, "Nominal", "되다", "suffix.verb.doeda") for b in DOEDA_VERBS.split()]
    out += [(b + "되다", "Predicate", b, k, "되다", "suffix.adjective.doeda") for k, bs in DOEDA_ADJECTIVES.items() for b in bs.split()]
    out += [(b + "하다", "Predicate", b, k, "하다", "suffix.verb.hada") for k, bs in HADA_VERBS.items() for b in bs.split()]
    out += [(b + "하다", "Predicate", b, "Nominal", "하다", "suffix.verb.hada") for b in HADA_NOMINALS.split()]
    out += [(b + "하다", "Predicate", b, k, "하다", "suffix.adjective.hada") for k, bs in HADA_ADJECTIVES.items() for b in bs.split()]
    out += [(b + "하다", "Auxiliary", b, "Nominal", "하다", "suffix.auxiliary.verb.hada") for b in HADA_AUXILIARY_VERBS.split()]
    out += [(b + "하다", "Auxiliary", b, "Nominal", "하다", "suffix.auxiliary.adjective.hada") for b in HADA_AUXILIARY_ADJECTIVES.split()]
    return out + (more or [])
