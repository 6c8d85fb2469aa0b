from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lemmaweave import evaluate as V
from lemmaweave.dictionary import TableDictionary, all_status, annotate, any_status, compatible_filter, coverage, filtered, has_match, headword_filter, unmatched
from lemmaweave.plans.analyze import Session, analyze_text, identity
from lemmaweave.queries import WORDS, family
from lemmaweave.sources.conllu import read_conllu
from lemmaweave.sources.lmf import import_lmf, read_lmf

#: Surfaces that must not yield the lemma: boundaries that the grammar forbids.
FORBIDDEN = [("잡니다", "잡다"), ("보습니다", "보다"), ("읽면", "읽다"), ("막어", "막다"), ("벗아", "벗다"), ("만들습니다", "만들다"), ("울세요", "울다"), ("더웁니다", "덥다"), ("먹겠었다", "먹다"), ("집는", "집"), ("나무은", "나무"), ("물으로", "물"), ("밥로", "밥")]


@pytest.fixture(scope="module")
def analyses(spark):
    words = {s for n in WORDS for s, _ in family(n)[2]} | {s for s, _ in FORBIDDEN} | {"나는", "hello", "가가"}
    s = Session(spark)
    out = s.analyze(spark.createDataFrame([(w,) for w in sorted(words)] + [("",), (None,)], "text string"))
    out.lw_session = s
    return out


@pytest.fixture(scope="module")
def groups(analyses):
    out: dict[str, set[str]] = {}
    for r in analyses.select("word", F.array_join(F.transform("lemmas", lambda x: x["text"]), "+").alias("g"), F.get("lemmas", F.lit(0))["kind"].alias("k"), "unchanged").collect():
        if not r.unchanged:
            out.setdefault(r.word, set()).add((r.g, r.k))
    return out


@pytest.mark.parametrize("name", sorted(WORDS))
def test_families(groups, name):
    for surface, group in family(name)[2]:
        assert group in {g for g, _ in groups[surface]}, surface


def test_forbidden_boundaries(groups):
    for surface, lemma in FORBIDDEN:
        kind = "Predicate" if lemma.endswith("다") else "Nominal"
        assert (lemma, kind) not in groups.get(surface, set()), surface


def test_identity_once(analyses):
    n = analyses.where("unchanged").groupBy("word").count()
    assert n.where("count <> 1").count() == 0
    assert analyses.where("word = 'hello'").count() == 1 and analyses.where("word = '' or word is null").count() == 0


def test_rules_are_sorted_sets(analyses):
    assert analyses.where(F.array_sort(F.array_distinct("rules")) != F.col("rules")).count() == 0
    assert analyses.groupBy("word", F.col("lemmas").cast("string"), F.col("morphemes").cast("string"), "unchanged").count().where("count > 1").count() == 0


def test_cache_analyses_once(analyses, spark):
    s = analyses.lw_session
    before = s.batches
    assert s.analyze(spark.createDataFrame([("나는",)], "text string")).where("word <> '나는'").count() == 0
    assert s.batches == before


def test_dictionary_annotation_and_filters(spark, analyses):
    rows = [("1", "나다", "0", "동사"), ("2", "날다", "0", "동사"), ("3", "나", "0", "대명사"), ("4", "나느다", "0", "명사")]
    d = TableDictionary(spark.createDataFrame(rows[:2], "id string, headword string, homonym string, pos string")).overlay(TableDictionary(spark.createDataFrame(rows[2:], "id string, headword string, homonym string, pos string")))
    a = annotate(analyses.where("word = '나는'"), d).cache()
    text = lambda df: {r[0] for r in df.where("not unchanged").select(F.get("lemmas", F.lit(0))["text"]).collect()}
    assert {"나다", "날다", "나"} <= text(headword_filter(a)) and "나는다" not in text(headword_filter(a))
    assert "나느다" not in text(compatible_filter(a))
    assert text(filtered(a, lambda x: x["text"] == "날다")) == {"날다"}
    assert has_match(a, d).where("lemma_text = '나다'").count() == 1 and d.lookup(spark.createDataFrame([("나",)], "headword string")).count() == 1
    assert d.entry("2").first().headword == "날다" and d.fingerprint().first().entries == 4
    tokens = spark.createDataFrame([("나는", "word"), ("나는", "word"), ("x", "word"), (".", "punctuation")], "surface string, kind string")
    assert coverage(tokens, a).first().asDict() == {"tokens": 3, "types": 2, "tokens_any": 2, "tokens_whole": 2, "types_any": 1, "types_whole": 1}
    assert [(r.word, r.n) for r in unmatched(tokens, a).collect()] == [("x", 1)]


def test_status_folds(spark):
    cases = [([], "unknown", "compatible"), (["compatible", "incompatible"], "compatible", "incompatible"), (["unknown", "incompatible"], "unknown", "incompatible"), (["incompatible"], "incompatible", "incompatible"), (["compatible", "unknown"], "compatible", "unknown")]
    df = spark.createDataFrame([(c[0],) for c in cases], "s array<string>").select("s", any_status(F.col("s")).alias("a"), all_status(F.col("s")).alias("b"))
    assert [(r.s, r.a, r.b) for r in df.collect()] == cases


def test_texts(spark):
    df = spark.createDataFrame([(1, "hello, world")], "doc_id int, text string")
    assert identity(df.select(F.lit("x").alias("text"))).first().rules == ["identity"]
    r = analyze_text(df).orderBy("ordinal").collect()
    assert [x.surface for x in r] == ["hello", ",", " ", "world"] and r[0].lemmas[0].text == "hello" and r[1].lemmas is None


def test_lmf_import(spark, tmp_path):
    import json

    feat = lambda **kw: [{"att": k, "val": v} for k, v in kw.items()]
    one = {"att": "id", "val": "12", "feat": feat(partOfSpeech="동사", homonym_number="0"), "Lemma": {"feat": {"att": "writtenForm", "val": "돕다"}}, "WordForm": [{"feat": feat(type="활용", writtenForm="도우니")}], "Sense": {"att": "id", "val": "1", "feat": feat(definition="A &lt;&amp;lt; &#44032; B")}}
    two = {"att": "id", "val": "13", "Lemma": [{"feat": feat(writtenForm="입다")}], "WordForm": {"feat": feat(type="활용", writtenForm="입으니")}, "Sense": [{"att": "id", "val": "1", "feat": feat(definition="x")}]}
    (tmp_path / "d.json").write_text(json.dumps({"LexicalResource": {"Lexicon": {"LexicalEntry": [one, two]}}}), encoding="utf-8")
    d = import_lmf(spark, f"{tmp_path}/d.json", f"{tmp_path}/dict")
    r = {x.headword: x for x in d.collect()}
    assert r["돕다"].id == "krdict:12" and r["돕다"].senses[0].definition == "A <&lt; 가 B" and r["입다"].pos == ""
    from lemmaweave.dictionary import spelling_evidence

    assert {(x.stem, x["class"]) for x in spelling_evidence(d).collect()} == {("돕", "BieupIrregular"), ("입", "BieupRegular")}
    with pytest.raises(Exception, match="(?i)exist"):
        import_lmf(spark, f"{tmp_path}/d.json", f"{tmp_path}/dict")
    bad = dict(one, Sense=[])
    (tmp_path / "e.json").write_text(json.dumps({"LexicalResource": {"Lexicon": {"LexicalEntry": bad}}}), encoding="utf-8")
    assert read_lmf(spark, f"{tmp_path}/e.json").first().error == "missing senses"


def test_corpus_evaluation(spark, tmp_path, analyses):
    line = lambda *f: "\t".join([*f, *["_"] * (10 - len(f))])
    rows = ["# sent_id = s1", line("1", "나무를", "나무+를", "NOUN", "ncn+jco"), line("2-3", "x"), line("2", "읽어보았다", "읽+어+보+았+다", "VERB", "pvg+ecx+px+ep+ef"), line("3", ".", ".", "PUNCT", "sf"), "", "# sent_id = s2", line("1", "잡아", "_", "VERB", "pvg+ecs"), ""]
    (tmp_path / "c.conllu").write_text("\n".join(rows), encoding="utf-8")
    gold = V.gold_groups(read_conllu(spark, f"{tmp_path}/c.conllu")).cache()
    assert {(r.form, tuple(r.gold)) for r in gold.where("gold is not null").collect()} == {("나무를", ("나무",)), ("읽어보았다", ("읽다", "보다"))}
    r = V.recall_report(gold, analyses).first()
    assert (r["rows"], r.excluded_rows, r.converted_rows, r.grouped_matches, r.gold_lemmas, r.recovered_gold_lemmas) == (4, 1, 2, 2, 3, 3)
    assert V.common_misses(gold, analyses.where("unchanged")).count() == 2
    sets = spark.createDataFrame([("a", [[0], [0, 1], [2]])], "id string, sets array<array<int>>")
    assert sorted(V.maximal_sets(sets).first().sets) == [[0, 1], [2]]
    new = spark.createDataFrame([("a", [[0, 1]])], "id string, sets array<array<int>>")
    assert V.baseline_regressions(sets, new).count() == 1 and V.baseline_regressions(new, sets).count() == 0
    j = spark.createDataFrame([("1", "나무를", ["나무"], "required"), ("2", "나무를", ["나물"], "forbidden")], "id string, surface string, lemmas array<string>, verdict string")
    assert V.judge_ledger(j, analyses).where("not met").count() == 0 and V.review_queue(j, analyses).count() > 0


def test_every_rule_is_explained(analyses):
    from lemmaweave.rules.explanations import explain

    assert [r.rule for r in explain(analyses).where("explanation is null").collect()] == []


def test_counts_of_repeated_syllables(spark):
    from lemmaweave.plans.analyze import analyze_words

    words = spark.createDataFrame([("가" * n,) for n in (2, 8, 64, 1024)], "text string")
    got = {r.word: r["count"] for r in analyze_words(words).groupBy("word").count().collect()}
    assert got == {"가" * n: 2 * n + 1 for n in (2, 8, 64, 1024)}


def test_forbidden_readings(groups):
    from lemmaweave.queries import WORDS as ALL
    from lemmaweave.queries import judgments

    for n in ALL:
        for surface, group, is_reading in judgments(n):
            if surface in groups:
                assert (group in {g for g, _ in groups[surface]}) == is_reading, (surface, group)


def test_glosses_and_http(spark):
    entries = spark.createDataFrame([("1", [([("영어", ""), ("영어", "eat")],)]), ("2", [([("일본어", "x")],)])], "id string, senses array<struct<translations:array<struct<language:string,lemma:string>>>>")
    assert {r.id: r.gloss for r in V.glosses(entries).collect()} == {"1": "eat", "2": None}
    from lemmaweave.sources.text import register_http

    register_http(spark)
    r = spark.read.format("lemmaweave_http").option("urls", "http://127.0.0.1:9/x\nnot a url").load().collect()
    assert len(r) == 2 and all(x.text is None and x.error for x in r)


def test_formations_of_a_caller(spark):
    from lemmaweave.plans.analyze import analyze_words

    words = spark.createDataFrame([("연구되었다",)], "text string")
    more = [("연구되다", "Predicate", "연구", "Nominal", "되다", "suffix.verb.doeda")]
    group = lambda df: {(tuple(x.text for x in r.lemmas), tuple(m.form for m in r.morphemes)) for r in df.collect()}
    assert group(analyze_words(words, formations=more)) - group(analyze_words(words)) == {(("연구",), ("되다", "었", "다"))}


def test_attachment_rules():
    from lemmaweave.operators.attachment import conflict_of

    p = lambda *forms: [(f, "Prefinal" if f in ("시", "었", "겠") else "Particle" if f == "요" else "Ending") for f in forms]
    verb, aux = (lambda x: (x, "Predicate")), (lambda x: (x, "Auxiliary"))
    cases = [
        ([verb("예쁘다")], p("는다"), 0, "A", "PresentDeclarativeVerb"), ([verb("먹다")], p("는다"), 0, "V", None), ([verb("예쁘다")], p("는"), 0, "A", "BarePresentAdnominalClass"), ([verb("맛있다")], p("는"), 0, "A", None),
        ([verb("예쁘다")], p("었", "는"), 0, "A", None), ([verb("먹다")], p("으냐"), 0, "V", "BareAdjectivalQuestion"), ([verb("먹다")], p("군"), 0, "V", "BareExclamationAdjective"), ([verb("아니다")], p("으라"), 0, "A", "NegativeCopulaCommand"),
        ([verb("예쁘다"), aux("대다")], p("어", "다"), 0, "A", "RepetitiveVerb"), ([verb("예쁘다"), aux("나다")], p("고", "다"), 0, "A", "ContinuationVerb"), ([verb("먹다"), aux("나다")], p("었", "고", "다"), 1, "V", "ContinuationLeftTense"),
        ([verb("먹다"), aux("나다")], p("고", "시", "다"), 1, "V", "GoNadaHonorific"), ([verb("먹다"), aux("나다")], p("고", "는다"), 1, "V", "GoNadaFinalEnding"), ([verb("먹다"), aux("싶다")], p("고", "다"), 1, "V", "AuxiliaryClass"),
        ([verb("예쁘다"), aux("듯하다")], p("는", "다"), 0, "A", "BarePresentAdnominalClass"),
    ]
    assert [conflict_of(ls, ms, i, k) for ls, ms, i, k, _ in cases] == [x for *_, x in cases]
    assert conflict_of([verb("머물다")], p("어"), 0, "V", "krdict:15980") == "ShortStemEnding" and conflict_of([verb("머물다")], p("으니"), 0, "V", "krdict:15980") is None


def test_assessment_by_spelling(spark):
    from lemmaweave.dictionary import assess
    from lemmaweave.plans.analyze import analyze_words

    d = TableDictionary(spark.createDataFrame([("1", "돕다", "0", "동사"), ("2", "입다", "0", "동사")], "id string, headword string, homonym string, pos string"))
    shown = spark.createDataFrame([("1", "돕", "BieupIrregular"), ("2", "입", "BieupRegular")], "id string, stem string, class string")
    a = analyze_words(spark.createDataFrame([("도와서",), ("이워서",), ("입어서",)], "text string"))
    got = {(r.word, r.lemmas[0].text): r.status for r in assess(a, d, shown).where("all_listed and not unchanged").collect()}
    assert got == {("도와서", "돕다"): "compatible", ("이워서", "입다"): "incompatible", ("입어서", "입다"): "compatible"}


def test_forest_counts_and_writes_every_chain():
    """Counts agree with the chains that are written, and dead ends are not walked."""
    from lemmaweave.operators.chart import Forest, Piece, joined

    piece = lambda stem, form, connector: Piece(stem, connector, False, False, False, [(form, "Ending")], [], frozenset([stem]), [])
    n = 40
    edges = [(0, k, piece("막", "어", True)) for k in range(1, n, 3)]
    edges += [(a, b, piece("보", "어", True)) for a in range(1, n) for b in (a + 1, a + 2) if b <= n]
    edges += [(a, a + 5, piece("보", "자고", True)) for a in range(1, n - 5)]  # nothing may follow it
    forest = Forest(n, edges)

    ways = {k: int(k % 3 == 1 and k < n) for k in range(n + 1)}  # chains up to a place, by hand
    for k in range(2, n + 1):
        ways[k] += sum(ways[k - d] for d in (1, 2) if k - d >= 1)
    assert forest.size() == ways[n]
    small = Forest(12, [e for e in edges if e[1] <= 12])
    out = [joined(pieces, links) for pieces, links in small.chains()]
    assert len(out) == small.size() and all(r[0] == "막" and {x["text"] for x in r[7]} == {"보다"} for r in out)


def test_segments_of_any_length(spark):
    """A later predicate with more than 64 characters of markers is a segment, one of other syllables is not."""
    from lemmaweave.operators.chart import segments

    long, other = "가" + "보" + "시었겠더" * 25 + "다", "가" + "보" + "나무구름" * 25 + "다"
    got = {(r.text, r.start, r.stop) for r in segments(spark.createDataFrame([(long,), (other,)], "text string")).collect()}
    assert (long, 1, len(long)) in got and (other, 1, len(other)) not in got and (other, 0, 1) in got
