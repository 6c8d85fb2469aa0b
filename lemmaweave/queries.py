"""Queries over the driver's tables, each with its DuckDB counterpart.

The tables hold no Hangul. One family works on their texts; the other spells Korean words from integer keys,
runs the grammar on them, and expects the lemma groups that the word list states."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dictionary import TableDictionary, assess, compatible_filter, pos_compatibility
from .evaluate import breakdown, combinations, grammar_labels
from .functions import hangul as H
from .functions.tokens import spread, tokenize
from .operators.merge import lemma_strings
from .operators.nominals import assumed
from .plans.analyze import Session, analyze_words
from .rules import endings as E
from .rules import particles as P
from .spacing import suggest

# ---- words, their lemma groups (parts by +) and the number of all their readings; words by | ----

WORDS = {
    "regular_vowel": "잡아 잡다|막아요 막다|웃어서 웃다|씻었다 씻다|받아라 받다|먹어야 먹다",
    "contracted_vowel": "와요 오다|배워서 배우다|기다려 기다리다|됐다 되다|섰어요 서다|세워야 세우다|나눠요 나누다",
    "eu_deletion": "바빠서 바쁘다|기뻐요 기쁘다|담가 담그다|떠서 뜨다|모아서 모으다",
    "irregular_digeut": "걸어요 걷다|깨달아 깨닫다|물었다 묻다|실으면 싣다|일컬어 일컫다",
    "irregular_siot": "그어 긋다|나아요 낫다|부으면 붓다|이은 잇다",
    "irregular_bieup": "더워요 덥다|가까운 가깝다|무서워서 무섭다|아름다우면 아름답다|도와서 돕다",
    "irregular_hieut": "하얘서 하얗다|노란 노랗다|까만 까맣다|어떤 어떻다",
    "irregular_reu": "빨라요 빠르다|흘러서 흐르다|골랐다 고르다|푸르러 푸르다",
    "rieul_deletion": "아는 알다|만드세요 만들다|우니 울다|노는 놀다|엽니다 열다",
    "attached_coda": "뛴다 뛰다|본 보다|잘 자다|배움 배우다|큽니다 크다|갑시다 가다",
    "prefinal_stack": "오셨습니다 오다|읽으셨겠지요 읽다|잡혔었다 잡히다|보시겠어요 보다|찾았더라 찾다|듣자옵고 듣다",
    "quoted": "간다고 가다|먹느냐고 먹다|가자고 가다|읽으라고 읽다|좋다는 좋다|왔대 오다|가리라고 가다",
    "short_hada": "생각건대 생각하다|간단치 간단하다|흔치 흔하다|편안케 편안하다",
    "particle": "나무를 나무|하늘은 하늘|바다에서 바다|부산으로 부산|물과 물|친구에게 친구|오늘부터 오늘",
    "particle_chain": "집에서는 집|회사까지만 회사|동생에게도 동생|마을로부터는 마을|선생님께서만 선생님|학교에서까지만은들요 학교",
    "nominal_suffix": "사람들 사람|선생님들이 선생|하나씩만 하나|세시쯤에 세시",
    "pronoun": "내가 나|네가 너|누가 누구|뭘 무엇|이건 이것",
    "copula": "학교입니다 학교+이다|바보였어 바보+이다|책이라면 책+이다|의사니까 의사+이다|봄인데 봄+이다|친구냐고 친구+이다|연구키이다 연구하다+이다",
    "polite_copula": "선생이에요 선생+이다|바다예요 바다+이다|아니에요 아니다",
    "nominalized": "읽기를 읽다|만나기는 만나다|슬픔을 슬프다|보기만 보다",
    "auxiliary": "읽어보았다 읽다+보다|놀고있어요 놀다+있다|가고싶다 가다+싶다|잊지못했다 잊다+못하다|먹어버렸다 먹다+버리다|가야만한다 가다+하다",
    "auxiliary_chain": "읽어보고싶다 읽다+보다+싶다|도와주고있다 돕다+주다+있다|먹어보지않았다 먹다+보다+않다|가가가가 가다+가다+가다+가다",
    "mal": "마라 말다|걱정말고 걱정+말다|할까말까 하다+말다|가다말고 가다+말다|꼼짝마라 꼼짝마다",
    "doeda": "해도안된다 하다+안+되다|가게된다 가다+되다|사용되었다 사용|가도록되었다 가다+되다",
    "negation": "적잖아 적하다+않다|간단찮다 간단하다+않다|그렇잖아요 그렇다+않다",
    "derivation": "빨리 빠르다|깨끗이 깨끗하다|목걸이를 목+걸다|학생답다 학생|민주화를 민주|새로이 새롭다",
}
#: Readings that the grammar must not give.
FORBIDDEN = {
    "regular_vowel": "막어 막다|벗아 벗다|잡어 잡다|먹아 먹다",
    "irregular_bieup": "도워서 돕다|추와 춥다|더웁니다 덥다|아름다와 아름답다",
    "attached_coda": "잡니다 잡다|보습니다 보다|간 오다|가습니다 가다",
    "rieul_deletion": "만들습니다 만들다|울세요 울다|감 갈다",
    "prefinal_stack": "먹겠었다 먹다|보자옵고 보다|가시더다 가다",
    "quoted": "먹네 먹습다|갔자면 가다|먹었느라고 먹다|예뻤자 예쁘었다",
    "particle": "집는 집|나무은 나무|물으로 물|밥로 밥",
    "particle_chain": "학교는은 학교|학교는를 학교",
    "nominal_suffix": "들을 이|지식인들를 지식인",
    "copula": "생각다 생각하+이다|학교입시다 학교+이다",
    "auxiliary_chain": "먹어야겠고있다 먹다+있다|먹으면싶다 먹다+싶다",
    "doeda": "안되겠지만 안+되다",
    "negation": "거북찮다 거북하다+않다",
}
#: How many readings a word has, its identity included.
COUNTS = (
    "잡아 5|막아요 12|웃어서 7|씻었다 7|받아라 11|먹어야 10|막어 2|벗아 3|잡어 2|먹아 3|와요 6|배워서 6|기다려 5|됐다 5|섰어요 14|세워야 8|나눠요 6|바빠서 5|기뻐요 8|담가 3|떠서 6|모아서 7|걸어요 12|깨달아 6|물었다 8|"
    "실으면 15|일컬어 5|그어 5|나아요 12|부으면 15|이은 7|더워요 8|가까운 7|무서워서 6|아름다우면 17|도와서 9|도워서 5|추와 6|더웁니다 8|아름다와 7|하얘서 5|노란 13|까만 11|어떤 8|빨라요 10|흘러서 7|골랐다 8|푸르러 6|아는 11|"
    "만드세요 12|우니 8|노는 10|엽니다 8|만들습니다 8|울세요 8|감 3|뛴다 5|본 6|잘 7|배움 4|큽니다 8|갑시다 8|잡니다 8|보습니다 8|간 7|가습니다 8|오셨습니다 15|읽으셨겠지요 28|잡혔었다 9|보시겠어요 26|찾았더라 15|듣자옵고 6|"
    "먹겠었다 9|보자옵고 5|가시더다 7|간다고 6|먹느냐고 8|가자고 4|읽으라고 9|좋다는 13|왔대 5|가리라고 12|먹네 4|갔자면 14|먹었느라고 9|예뻤자 5|생각건대 9|간단치 2|흔치 2|편안케 4|나무를 7|하늘은 11|바다에서 7|부산으로 3|물과 3|"
    "친구에게 6|오늘부터 7|집는 7|나무은 7|물으로 2|밥로 1|집에서는 18|회사까지만 19|동생에게도 10|마을로부터는 20|선생님께서만 18|학교에서까지만은들요 28|학교는은 9|학교는를 6|사람들 11|선생님들이 4|하나씩만 10|세시쯤에 7|들을 8|"
    "지식인들를 6|내가 6|네가 6|누가 4|뭘 8|이건 10|학교입니다 9|바보였어 7|책이라면 20|의사니까 6|봄인데 13|친구냐고 7|연구키이다 7|생각다 6|학교입시다 8|선생이에요 11|바다예요 7|아니에요 11|읽기를 11|만나기는 12|슬픔을 10|보기만 11|"
    "읽어보았다 12|놀고있어요 12|가고싶다 6|잊지못했다 9|먹어버렸다 9|가야만한다 7|읽어보고싶다 9|도와주고있다 10|먹어보지않았다 13|가가가가 9|먹어야겠고있다 8|먹으면싶다 4|마라 9|걱정말고 3|할까말까 11|가다말고 4|꼼짝마라 10|해도안된다 17|"
    "가게된다 7|사용되었다 9|가도록되었다 9|안되겠지만 37|적잖아 8|간단찮다 5|그렇잖아요 15|거북찮다 4|빨리 2|깨끗이 3|목걸이를 8|학생답다 6|민주화를 9|새로이 2"
)

#: Where each family takes its keys from.
TABLES = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey", "orders": "o_orderkey"}
_CYCLE = ("part", "customer", "orders")


def family(name: str) -> tuple[str, str, list[tuple[str, str]]]:
    """(table, key, (surface, group)) of a family."""
    table = _CYCLE[sorted(WORDS).index(name) % len(_CYCLE)]
    return table, TABLES[table], _pairs(WORDS[name])


def _pairs(listed: str) -> list[tuple[str, str]]:
    return [tuple(x.rsplit(" ", 1)) for x in listed.split("|") if x]


def judgments(name: str) -> list[tuple[str, str, bool]]:
    """surface, group, and whether the group is a reading of it."""
    return [(s, g, True) for s, g in family(name)[2]] + [(s, g, False) for s, g in _pairs(FORBIDDEN.get(name, ""))]


def counts() -> dict[str, int]:
    return {s: int(n) for s, n in _pairs(COUNTS)}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spelled(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """key, surface and lemma_group of a family's judgments, dealt to the rows of its table."""
    table, key, _ = family(name)
    of = judgments(name)
    row = F.get(F.array(*[F.struct(F.lit(s).alias("surface"), F.lit(g).alias("lemma_group")) for s, g, _ in of]), F.pmod(F.col(key), F.lit(len(of))).cast("int"))
    return read(spark, sf_dir, table).select(F.col(key).alias("key"), row.alias("r")).select("key", "r.*")


def _values(rows: list[tuple]) -> str:
    quote = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + str(v).replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows)


_SESSIONS: dict[str, Session] = {}


def all_words() -> list[str]:
    return sorted({s for n in WORDS for s, _, _ in judgments(n)} | {*COMPATIBLE, *ORDERS, *(w for w, _, _ in ASSESSED + LABELS), *(w for w, *_ in ATTACHED + HOMONYMS)})


def session(spark: SparkSession) -> Session:
    """The word cache of a Spark application, filled with the words of all families at first: one analysis for all of them."""
    key = spark.sparkContext.applicationId
    if key not in _SESSIONS:
        _SESSIONS[key] = Session(spark)
        _SESSIONS[key].analyze(spark.createDataFrame([(w,) for w in all_words()], "text string"))
    return _SESSIONS[key]


def recovered(name: str) -> Callable[[SparkSession, str], DataFrame]:
    """key, surface, lemma_group, whether that is a reading of the surface, and the number of all its readings; no dictionary filters them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = spelled(spark, sf_dir, name)
        found = session(spark).analyze(rows.select(F.col("surface").alias("text")).distinct())
        group = F.when(~F.col("unchanged"), F.array_join(F.transform("lemmas", lambda x: x["text"]), "+"))
        by = found.groupBy(F.col("word").alias("surface")).agg(F.count(F.lit(1)).alias("n_readings"), F.collect_set(group).alias("groups"))
        return rows.join(F.broadcast(by), "surface").select("key", "surface", "lemma_group", F.array_contains("groups", F.col("lemma_group")).alias("is_reading"), "n_readings")

    run.__name__ = f"recover_{name}"
    return run


def recovered_sql(name: str) -> str:
    table, key, _ = family(name)
    of, n = judgments(name), counts()
    return f"SELECT {key} AS key, surface, lemma_group, is_reading, CAST(n_readings AS BIGINT) AS n_readings FROM {table} JOIN (VALUES {_values([(i, s, g, y, n.get(s, 0)) for i, (s, g, y) in enumerate(of)])}) v(i, surface, lemma_group, is_reading, n_readings) ON {key} % {len(of)} = i"


# ---- queries on the tables' texts ----------------------------------------------------------------

TOKEN_SQL = r"'[\t-\r\x{85}\p{Z}]+|[\p{P}\p{S}\p{Cc}\p{Cf}]|[^\t-\r\x{85}\p{Z}\p{P}\p{S}\p{Cc}\p{Cf}]+'"
KIND_SQL = r"CASE WHEN regexp_matches(t, '^[\t-\r\x{85}\p{Z}]') THEN 'whitespace' WHEN regexp_matches(t, '^[\p{P}\p{S}\p{Cc}\p{Cf}]') THEN 'punctuation' ELSE 'word' END"
TOKENS_CTE = f"WITH tok AS (SELECT *, {KIND_SQL} AS kind FROM (SELECT doc_id, lang, unnest(regexp_extract_all(text, {TOKEN_SQL})) AS t FROM documents))"


def tokens_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(spread(read(spark, sf_dir, "documents")), keys=("doc_id", "lang"), spans=False)
    return t.groupBy("lang", "kind").agg(F.count(F.lit(1)).alias("n_tokens"), F.sum(F.octet_length("surface")).cast("long").alias("n_bytes"))


def token_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(spread(read(spark, sf_dir, "documents")))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_tokens"), F.max("end").cast("long").alias("n_bytes"), F.sum(F.col("start") % 1009 * (F.col("ordinal") % 97)).cast("long").alias("position_sum"))


TOKEN_SPANS_SQL = f"""WITH a AS (SELECT doc_id, regexp_extract_all(text, {TOKEN_SQL}) AS l FROM documents),
t AS (SELECT doc_id, i - 1 AS ordinal, octet_length(encode(l[i])) AS n FROM a, unnest(range(1, len(l) + 1)) u(i)),
s AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY ordinal) AS e FROM t)
SELECT doc_id, count(*) AS n_tokens, CAST(max(e) AS BIGINT) AS n_bytes, CAST(sum((e - n) % 1009 * (ordinal % 97)) AS BIGINT) AS position_sum FROM s GROUP BY doc_id"""


def lossless_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against its tokens put together again."""
    docs = spread(read(spark, sf_dir, "documents").select("doc_id", "text"))
    t = tokenize(docs, spans=False).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "surface"))), lambda x: x["surface"]), "").alias("again"))
    return docs.join(t, "doc_id").select("doc_id", (F.col("text") == F.col("again")).alias("lossless"), F.md5("again").alias("digest"))


def top_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 most frequent words of each language (a report)."""
    from pyspark.sql import Window

    t = tokenize(spread(read(spark, sf_dir, "documents")), keys=("doc_id", "lang"), spans=False).where("kind = 'word'")
    n = t.groupBy("lang", F.col("surface").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return n.withColumn("place", rank.cast("long")).where("place <= 20")


def word_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(spread(read(spark, sf_dir, "documents")), keys=("doc_id", "lang"), spans=False).where("kind = 'word'")
    return t.groupBy("lang").agg(F.countDistinct("surface").alias("n_types"), F.count(F.lit(1)).alias("n_tokens"))


def identity_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents through the whole analysis: without Hangul only the identity remains."""
    t = tokenize(spread(read(spark, sf_dir, "documents")), spans=False).where("kind = 'word'")
    a = analyze_words(t.select(F.col("surface").alias("text"))).select(F.col("word"), F.get("lemmas", F.lit(0))["text"].alias("lemma"), F.size("morphemes").cast("long").alias("n_morphemes"), F.array_join("rules", "+").alias("rules"), "unchanged")
    return a


def turn_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tokenize(spread(read(spark, sf_dir, "conversations")), keys=("conv_id", "turn", "role"), spans=False)
    return t.groupBy("role").agg(F.count_if(F.col("kind") == "word").alias("n_words"), F.count_if(F.col("kind") == "punctuation").alias("n_marks"), F.countDistinct("conv_id").alias("n_conversations"))


def pronunciation_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nation names as bases of particles: which pronunciation each condition presumes."""
    n = read(spark, sf_dir, "nation").select("n_name", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("condition"))
    return n.select("n_name", "condition", assumed(F.col("n_name"), F.col("condition")).alias("assumption"))


PRONUNCIATION_SQL = r"""SELECT n_name, CAST(c AS INT) AS condition, CASE WHEN regexp_matches(n_name, '[\p{L}\p{N}]\p{M}*$') THEN 'pronunciation.assumed_' || ['consonant', 'vowel', 'non_rieul_consonant', 'vowel_or_rieul'][c] END AS assumption FROM nation, unnest(range(1, 5)) u(c)"""

# ---- queries on syllables and rule tables --------------------------------------------------------

_SYLLABLE = "44032 + (o_orderkey * 7919) % 11172"


def syllable_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("o_orderkey") * 7919 % H.COUNT).cast("long")
    s = read(spark, sf_dir, "orders").select(F.col("o_orderkey"), H.char(n).alias("syllable"))
    i = H.index(F.col("syllable"))
    return s.select("o_orderkey", "syllable", H.initial(i).alias("initial"), H.vowel(i).alias("vowel"), H.coda(i).alias("coda"), H.is_bright(i).alias("bright"))


SYLLABLE_SQL = f"SELECT o_orderkey, chr(CAST(n AS INT)) AS syllable, CAST((n - 44032) // 588 AS INT) AS initial, CAST((n - 44032) // 28 % 21 AS INT) AS vowel, CAST((n - 44032) % 28 AS INT) AS coda, (n - 44032) // 28 % 21 IN (0, 8) AS bright FROM (SELECT o_orderkey, {_SYLLABLE} AS n FROM orders)"


def syllable_compose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last syllable of a spelled name with its coda replaced by each of ㄴ, ㄹ, ㅁ, ㅂ."""
    n = (F.col("p_partkey") * 7919 % H.COUNT).cast("long")
    s = read(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("가"), H.char(n)).alias("w"))
    s = s.select("p_partkey", "w", F.explode(F.array(*map(F.lit, (4, 8, 16, 17)))).alias("coda"))
    return s.select("p_partkey", "coda", H.replace_last(F.col("w"), H.vowel(H.index(H.last_char(F.col("w")))), F.col("coda")).alias("word"))


COMPOSE_SQL = "SELECT p_partkey, CAST(c AS INT) AS coda, '가' || chr(CAST(44032 + n - n % 28 + c AS INT)) AS word FROM (SELECT p_partkey, (p_partkey * 7919) % 11172 AS n FROM part), unnest([4, 8, 16, 17]) u(c)"


def particle_allomorphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Particles whose demand each customer's syllable meets, counted by class."""
    from .operators.nominals import fits

    n = (F.col("c_custkey") * 7919 % H.COUNT).cast("long")
    s = read(spark, sf_dir, "customer").select("c_custkey", H.char(n).alias("w"))
    p = P.particles(spark)
    by = s.select("c_custkey", "w").join(F.broadcast(p.groupBy("class", "condition").agg(F.count(F.lit(1)).alias("k"))), fits(F.col("w"), F.col("condition")))
    return by.groupBy("c_custkey").agg(F.sum("k").alias("n_particles"), F.sum(F.when(F.col("class") == 1, F.col("k")).otherwise(0)).alias("n_case"))


def _particle_sql() -> str:
    return f"""WITH p(class, condition, k) AS (SELECT class, condition, count(*) FROM (VALUES {_values([(c, k) for _, c, k in P.particle_rows()])}) v(class, condition) GROUP BY ALL),
c AS (SELECT c_custkey, (c_custkey * 7919) % 11172 % 28 AS t FROM customer)
SELECT c_custkey, CAST(sum(k) AS BIGINT) AS n_particles, CAST(sum(CASE WHEN class = 1 THEN k ELSE 0 END) AS BIGINT) AS n_case FROM c, p
WHERE condition = 0 OR (condition = 1 AND t > 0) OR (condition = 2 AND t = 0) OR (condition = 3 AND t NOT IN (0, 8)) OR (condition = 4 AND t IN (0, 8)) GROUP BY c_custkey"""


KINDS = ("Nominal", "Predicate", "Copula", "Auxiliary", "Adverbial", "Root")
POS = ("명사", "대명사", "동사", "형용사", "보조 동사", "조사", "부사", "어미", "기타")


def pos_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, pos = (F.get(F.array(*map(F.lit, v)), F.pmod(F.col("c_custkey") + d, F.lit(len(v))).cast("int")) for v, d in ((KINDS, 0), (POS, 3)))
    c = read(spark, sf_dir, "customer").select(kind.alias("kind"), pos.alias("pos"))
    return c.select("kind", "pos", pos_compatibility(F.col("kind"), F.lit("이다"), F.col("pos")).alias("status")).groupBy("kind", "pos", "status").agg(F.count(F.lit(1)).alias("n"))


POS_SQL = f"""SELECT kind, pos, CASE WHEN kind = 'Root' OR pos = '기타' THEN 'unknown' WHEN (kind, pos) IN (('Nominal', '명사'), ('Nominal', '대명사'), ('Predicate', '동사'), ('Predicate', '형용사'), ('Auxiliary', '보조 동사'), ('Adverbial', '부사'), ('Copula', '조사')) THEN 'compatible' ELSE 'incompatible' END AS status, count(*) AS n
FROM (SELECT {list(KINDS)}[c_custkey % 6 + 1] AS kind, {list(POS)}[(c_custkey + 3) % 9 + 1] AS pos FROM customer) GROUP BY ALL"""


#: Rows and distinct forms of endings by boundary, as counted in the published inventory.
INVENTORY = [("Aeo", 13, 13), ("Attached", 85, 85), ("ComeStem", 1, 1), ("Consonant", 45, 45), ("Copular", 35, 35), ("EuFull", 136, 136), ("EuZero", 98, 98), ("HaAspiration", 24, 24), ("HaDeletion", 24, 24), ("Literal", 263, 258), ("OmittedCopula", 101, 98), ("ZeroCopula", 35, 35)]


def ending_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation, the numbers of ending rows of the boundaries that it is dealt."""
    e = E.endings(spark).where("not conjectural").groupBy("boundary").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("form").alias("n_forms"))
    return read(spark, sf_dir, "nation").select("n_nationkey").join(F.broadcast(e), F.length("boundary") % 5 == F.col("n_nationkey") % 5).select("n_nationkey", "boundary", "n_rows", "n_forms")


def _ending_sql() -> str:
    return f"SELECT n_nationkey, boundary, CAST(n_rows AS BIGINT) AS n_rows, CAST(n_forms AS BIGINT) AS n_forms FROM nation JOIN (VALUES {_values(INVENTORY)}) v(boundary, n_rows, n_forms) ON length(boundary) % 5 = n_nationkey % 5"


def lemma_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of two families, dealt to parts, and whether the judged lemma is among the sorted distinct lemma texts of each."""
    rows = spelled(spark, sf_dir, "regular_vowel").unionByName(spelled(spark, sf_dir, "particle"))
    found = lemma_strings(session(spark).analyze(rows.select(F.col("surface").alias("text")).distinct()))
    return rows.join(F.broadcast(found), F.col("surface") == F.col("word")).select("key", "word", F.col("lemma_group").alias("lemma"), F.array_contains("lemma_strings", F.col("lemma_group")).alias("listed"))


def _lists_sql() -> str:
    both = [f"SELECT key, surface AS word, lemma_group AS lemma, is_reading AS listed FROM ({recovered_sql(n)})" for n in ("regular_vowel", "particle")]
    return " UNION ALL ".join(both)


#: Entries of a small dictionary, and words with the readings that it lists and does not contradict.
LEXICON = [
    ("e1", "나다", "동사"), ("e2", "날다", "동사"), ("e3", "나", "대명사"), ("e4", "나느다", "명사"), ("e5", "예쁘다", "형용사"), ("e6", "먹다", "동사"), ("e7", "밥", "명사"), ("e8", "학교", "명사"), ("e9", "가다", "동사"), ("e10", "책", "명사"),
    ("e11", "읽다", "동사"), ("e12", "보다", "보조 동사"), ("e13", "보다", "동사"), ("e14", "싶다", "보조 형용사"), ("e15", "싶다", "형용사"), ("e16", "짜증", "명사"), ("e17", "내다", "동사"), ("e18", "친구", "명사"), ("e19", "만나다", "동사"),
    ("krdict:62835", "것", "의존 명사"), ("krdict:62210", "나다", "동사"), ("krdict:62379", "소리", "명사"), ("krdict:17182", "우리", "대명사"), ("krdict:64555", "때문", "의존 명사"), ("ud-ko-kaist:proper-name:park", "박", "PROPN"), ("krdict:62818", "선생님", "명사"),
    ("k1", "-는다", "어미"), ("k2", "-었-", "어미"), ("k3", "은", "조사"), ("k4", "-었었-", "어미"), ("k5", "-다", "어미"), ("k6", "는", "조사"),
]
COMPATIBLE = {"나는": ["나", "나다", "날다"], "먹는다": ["먹다"], "예쁜다": [], "예쁘다": ["예쁘다"], "먹었었다": ["먹다"]}
#: Readings by the status that an entry's class gives them.
ASSESSED = [("먹는다", "먹다", "compatible"), ("예쁜다", "예쁘다", "incompatible"), ("예쁘다", "예쁘다", "compatible")]
LABELS = [("먹는다", "는다", "k1"), ("먹었었다", "었", "k2"), ("먹었었다", "었었", "k4"), ("먹었었다", "다", "k5")]


def lexicon(spark: SparkSession) -> TableDictionary:
    return TableDictionary(spark.createDataFrame([(i, h, "0", p) for i, h, p in LEXICON], "id string, headword string, homonym string, pos string"))


def _dealt(spark: SparkSession, sf_dir: str, words: list[str]) -> DataFrame:
    """c_custkey and a word of a list for each customer."""
    w = F.get(F.array(*map(F.lit, words)), F.pmod(F.col("c_custkey"), F.lit(len(words))).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", w.alias("word"))


def _dealt_sql(words: list[str], rows: list[tuple], columns: str) -> str:
    """Rows that start with a word, for each customer that has it."""
    return f"SELECT c_custkey, v.* FROM customer JOIN (VALUES {_values(rows)}) v({columns}) ON v.{columns.split(',')[0]} = {words}[c_custkey % {len(words)} + 1]"


def compatible_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lemmas of each customer's word that a dictionary lists and does not contradict."""
    rows = _dealt(spark, sf_dir, list(COMPATIBLE))
    a = compatible_filter(assess(session(spark).analyze(rows.select(F.col("word").alias("text")).distinct()), lexicon(spark))).where("not unchanged")
    return rows.join(F.broadcast(a.select("word", F.get("lemmas", F.lit(0))["text"].alias("lemma")).distinct()), "word").select("c_custkey", "word", "lemma")


def assessed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of judged readings by the class of their entry."""
    words = [w for w, _, _ in ASSESSED]
    rows = _dealt(spark, sf_dir, words)
    a = assess(session(spark).analyze(rows.select(F.col("word").alias("text")).distinct()), lexicon(spark)).where("all_listed and not unchanged")
    return rows.join(F.broadcast(a.select("word", F.get("lemmas", F.lit(0))["text"].alias("lemma"), "status").distinct()), "word").select("c_custkey", "word", "lemma", "status")


def morpheme_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dictionary entries of the morphemes of compatible readings."""
    words = sorted({w for w, _, _ in LABELS})
    rows = _dealt(spark, sf_dir, words)
    a = compatible_filter(assess(session(spark).analyze(rows.select(F.col("word").alias("text")).distinct()), lexicon(spark))).where("not unchanged")
    return rows.join(F.broadcast(grammar_labels(a, lexicon(spark)).select("word", "form", "entry_id").distinct()), "word").select("c_custkey", "word", "form", "entry_id")


#: Readings (word, lemma, markers and ending) with their status, and the rule and place of an entry's conflict.
ATTACHED = [
    ("먹는다", "먹다", "는다", "compatible", None, None), ("예쁜다", "예쁘다", "는다", "incompatible", "PresentDeclarativeVerb", 0), ("먹더구나", "먹다", "더구나", "unknown", None, None), ("먹었더구나", "먹다", "었 더구나", "compatible", None, None),
    ("예쁩시다", "예쁘다", "읍시다", "unknown", None, None), ("먹읍시다", "먹다", "읍시다", "compatible", None, None), ("예쁘더구나", "예쁘다", "더구나", "compatible", None, None),
]
#: Homonyms of the bases of formations, with the origins that they record, and what these say of the base that the formation presumes.
HOMONYMS = [("가공되다", "h1", "加工", "recorded_match"), ("가공되다", "h2", "架空", "recorded_difference"), ("가공되다", "h3", None, "unknown"), ("감염되다", "h4", "感染", "recorded_match"), ("가열되다", "h5", "佳熱", "unknown")]
#: Base, origins, and whether these are all that the base of the formation has.
ORIGINS = [("가공", ["加工"], True), ("감염", ["感染"], True), ("가열", ["加熱"], False)]


def assessed_attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the entries say of the readings of each customer's word with one lemma: status, and the rule and the place of a conflict."""
    rows = _dealt(spark, sf_dir, sorted({w for w, *_ in ATTACHED}))
    d = TableDictionary(spark.createDataFrame([("a1", "먹다", "0", "동사"), ("a2", "예쁘다", "0", "형용사")], "id string, headword string, homonym string, pos string"))
    a = assess(session(spark).analyze(rows.select(F.col("word").alias("text")).distinct()), d).where("all_listed and not unchanged and size(lemmas) = 1")
    parts = F.array_join(F.transform("morphemes", lambda m: m["form"]), " ")
    first = F.get("conflicts", F.lit(0))
    a = a.select("word", F.get("lemmas", F.lit(0))["text"].alias("lemma"), parts.alias("ending"), "status", first["rule"].alias("rule"), first["morpheme"].alias("morpheme"))
    return rows.join(F.broadcast(a.where(F.concat_ws(" ", "word", "lemma", "ending").isin([f"{w} {x} {e}" for w, x, e, *_ in ATTACHED])).distinct()), "word").select("c_custkey", "word", "lemma", "ending", "status", "rule", "morpheme")


def origin_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which homonym the base of each customer's formation is, by the origins that entries record."""
    rows = _dealt(spark, sf_dir, sorted({w for w, *_ in HOMONYMS}))
    entries = [(i, w.removesuffix("되다"), "0", "명사", o and [o]) for w, i, o, _ in HOMONYMS]
    d = TableDictionary(spark.createDataFrame(entries, "id string, headword string, homonym string, pos string, origins array<string>"))
    origins = spark.createDataFrame([(b, "되다", o, whole) for b, o, whole in ORIGINS], "base string, suffix string, expected array<string>, complete boolean")
    a = assess(session(spark).analyze(rows.select(F.col("word").alias("text")).distinct()), d, origins=origins)
    found = a.select("word", F.explode("identities").alias("x")).select("word", F.col("x.entry_id").alias("entry_id"), F.col("x.relation").alias("relation")).distinct()
    return rows.join(F.broadcast(found), "word").select("c_custkey", "word", "entry_id", "relation")


#: Words and how their parts stand in them: lemmas and morphemes in turn.
ORDERS = {"걱정말고": "걱정 말다 고", "읽어보고싶다": "읽다 어 보다 고 싶다 다", "학교입니다": "학교 이다 습니다", "목걸이를": "목 걸다 이 를"}


def reading_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each customer's word has a reading whose parts stand in the expected order, and whether all its readings have an order at all."""
    rows = _dealt(spark, sf_dir, list(ORDERS))
    a = breakdown(session(spark).analyze(rows.select(F.col("word").alias("text")).distinct()))
    line = F.array_join(F.transform("breakdown", lambda x: x["text"]), " ")
    by = a.groupBy("word").agg(F.collect_set(line).alias("lines"), F.bool_and(F.col("breakdown").isNotNull()).alias("all_ordered"))
    want = spark.createDataFrame(list(ORDERS.items()), "word string, line string")
    by = by.join(want, "word").select("word", "line", F.array_contains("lines", F.col("line")).alias("found"), "all_ordered")
    return rows.join(F.broadcast(by), "word").select("c_custkey", "word", "line", "found", "all_ordered")


def choice_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many ways there are to choose one of each of a nation's three groups of letters, and the ways where they are few."""
    n = read(spark, sf_dir, "nation").select("n_nationkey", F.array(*[F.slice(F.split("n_name", ""), k + 1, F.pmod(F.col("n_nationkey") + k, F.lit(4)).cast("int")) for k in range(3)]).alias("choices"))
    c = combinations(n)
    return c.select("n_nationkey", F.col("n_combinations").cast("long").alias("n_combinations"), F.coalesce(F.array_join(F.transform("combinations", lambda x: F.array_join(x, "")), " "), F.lit("")).alias("ways"))


CHOICE_SQL = """WITH c AS (SELECT n_nationkey, list_transform([0, 1, 2], lambda k: list_transform(range(k + 1, k + 1 + (n_nationkey + k) % 4), lambda i: n_name[i])) AS c FROM nation),
n AS (SELECT *, len(c[1]) * len(c[2]) * len(c[3]) AS n FROM c)
SELECT n_nationkey, CAST(n AS BIGINT) AS n_combinations, CASE WHEN n BETWEEN 1 AND 20 THEN array_to_string(flatten(list_transform(c[1], lambda x: flatten(list_transform(c[2], lambda y: list_transform(c[3], lambda z: x || y || z))))), ' ') ELSE '' END AS ways FROM n"""

SPACED = [
    ("밥을먹었다", "밥을 먹었다", "spacing.nominal_case_predicate"), ("학교에갔어요", "학교에 갔어요", "spacing.nominal_case_predicate"), ("읽어보고싶다", "읽어 보고 싶다", "spacing.predicate_auxiliary"),
    ("읽어보고싶다", "읽어 보고싶다", "spacing.predicate_auxiliary"), ("읽어보고싶다", "읽어보고 싶다", "spacing.predicate_auxiliary"), ("소리난다", "소리 난다", "spacing.bare_noun_main_nada"), ("짜증냈다", "짜증 냈다", "spacing.bare_noun_lexical_verb"),
    ("먹을것", "먹을 것", "spacing.modifier_bound_noun"), ("우리것", "우리 것", "spacing.nominal_bound_noun"), ("밥때문에", "밥 때문에", "spacing.nominal_bound_noun"), ("박선생님은", "박 선생님은", "spacing.proper_name_title"),
    ("박선생님의것", "박 선생님의 것", "spacing.proper_name_title_possession"), ("학교에서친구를만났다", "학교에서 친구를 만났다", "spacing.nominal_case_predicate"),
]


def spacing_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All places where spaces may be missing in each customer's word."""
    rows = _dealt(spark, sf_dir, sorted({w for w, _, _ in SPACED}))
    out = suggest(rows.select(F.col("word").alias("text")).distinct(), lexicon(spark)).select("word", "rule", "spaced", F.array_join(F.col("inserted_at").cast("array<string>"), ",").alias("inserted_at"), "complete")
    return rows.join(F.broadcast(out), "word").select("c_custkey", "word", "rule", "spaced", "inserted_at", "complete")


def _spacing_sql() -> str:
    at = lambda s: ",".join(str(len("".join(s.split(" ")[: k + 1]).encode())) for k in range(s.count(" ")))
    return _dealt_sql(sorted({w for w, _, _ in SPACED}), [(w, r, s, at(s), True) for w, s, r in SPACED], "word, rule, spaced, inserted_at, complete")


PLAIN = {
    tokens_by_kind: TOKENS_CTE + " SELECT lang, kind, count(*) AS n_tokens, CAST(sum(octet_length(encode(t))) AS BIGINT) AS n_bytes FROM tok GROUP BY lang, kind",
    token_spans: TOKEN_SPANS_SQL,
    lossless_tokens: "SELECT doc_id, TRUE AS lossless, md5(text) AS digest FROM documents",
    top_words: TOKENS_CTE + " SELECT * FROM (SELECT lang, t AS word, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, t) AS place FROM tok WHERE kind = 'word' GROUP BY lang, t) WHERE place <= 20",
    word_types: TOKENS_CTE + " SELECT lang, count(DISTINCT t) AS n_types, count(*) AS n_tokens FROM tok WHERE kind = 'word' GROUP BY lang",
    identity_analyses: f"SELECT DISTINCT t AS word, t AS lemma, CAST(0 AS BIGINT) AS n_morphemes, 'identity' AS rules, TRUE AS unchanged FROM (SELECT unnest(regexp_extract_all(text, {TOKEN_SQL})) AS t FROM documents) WHERE {KIND_SQL} = 'word'",
    turn_tokens: f"SELECT role, count(*) FILTER (k = 'word') AS n_words, count(*) FILTER (k = 'punctuation') AS n_marks, count(DISTINCT conv_id) AS n_conversations FROM (SELECT role, conv_id, {KIND_SQL} AS k FROM (SELECT role, conv_id, unnest(regexp_extract_all(text, {TOKEN_SQL})) AS t FROM conversations)) GROUP BY role",
    pronunciation_classes: PRONUNCIATION_SQL,
    syllable_split: SYLLABLE_SQL,
    syllable_compose: COMPOSE_SQL,
    particle_allomorphs: _particle_sql(),
    pos_fold: POS_SQL,
    ending_inventory: _ending_sql(),
    lemma_lists: _lists_sql(),
    compatible_readings: _dealt_sql(list(COMPATIBLE), [(w, x) for w, xs in COMPATIBLE.items() for x in xs], "word, lemma"),
    assessed_readings: _dealt_sql([w for w, _, _ in ASSESSED], ASSESSED, "word, lemma, status"),
    assessed_attachments: _dealt_sql(sorted({w for w, *_ in ATTACHED}), ATTACHED, "word, lemma, ending, status, rule, morpheme"),
    origin_identities: _dealt_sql(sorted({w for w, *_ in HOMONYMS}), [(w, i, r) for w, i, _, r in HOMONYMS], "word, entry_id, relation"),
    morpheme_labels: _dealt_sql(sorted({w for w, _, _ in LABELS}), LABELS, "word, form, entry_id"),
    reading_orders: _dealt_sql(list(ORDERS), [(w, x, True, True) for w, x in ORDERS.items()], "word, line, found, all_ordered"),
    choice_products: CHOICE_SQL,
    spacing_case: _spacing_sql(),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in PLAIN} | {f"recover_{n}": recovered(n) for n in WORDS}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in PLAIN.items()} | {f"recover_{n}": recovered_sql(n) for n in WORDS}
