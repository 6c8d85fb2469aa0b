from __future__ import annotations

import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lemmaweave.functions import hangul as H
from lemmaweave.functions.tokens import tokenize
from lemmaweave.rules.endings import ending_rows
from lemmaweave.sources.text import read_bytes, read_text, text_lines, write_jsonl


def test_all_syllables_split_and_compose(spark):
    s = spark.createDataFrame([(chr(0xAC00 + n), n) for n in range(11172)], "c string, n int")
    i = H.index(F.col("c"))
    bad = s.where((i != F.col("n")) | (H.compose(H.initial(i), H.vowel(i), H.coda(i)) != F.col("c")))
    assert bad.count() == 0


def test_what_is_no_syllable(spark):
    r = spark.createDataFrame([("a",), ("ㄱ",), ("",), ("가a",)], "c string").select(H.text_coda(F.col("c"))).collect()
    assert [x[0] for x in r] == [-1, -1, -1, -1]


def test_tokens_are_lossless_with_byte_spans(spark):
    rng = random.Random(4)
    alphabet = ["가", "먹", "a", "é", " ", "\n", "\t", "!", "“", "😀", "́", unicodedata.normalize("NFD", "각"), "1", " ", "\r\n", "+"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(60)] + ["", None, "  ", "가" * 500]
    rows = tokenize(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")).collect()
    by: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.ordinal)):
        by.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(texts):
        got = by.get(k, [])
        assert "".join(r.surface for r in got) == (t or "")
        at = 0
        for r in got:
            assert (r.start, r.end) == (at, at + len(r.surface.encode()))
            at = r.end
        assert all(a.kind != b.kind or a.kind == "punctuation" for a, b in zip(got, got[1:], strict=False))


@settings(max_examples=30, deadline=None)
@given(st.text(alphabet="가나다 .a\n", max_size=30))
def test_kinds_by_category(text):
    import re

    from lemmaweave.functions.tokens import TOKEN  # noqa: F401

    assert "".join(re.findall(r"\s+|[.]|[^\s.]+", text)) == text


def test_ending_rows():
    rows = ending_rows()
    assert len(rows) == len(set(rows)) and len({(s, f, b, c) for s, f, b, c, _ in rows}) == len(rows)
    have = {(s, f, b, c) for s, f, b, c, _ in rows}
    for want in (("요", "어요", "Aeo", None), ("면", "으면", "EuZero", None), ("니다", "습니다", "Attached", 17), ("케", "게", "HaAspiration", None), ("", "을", "Attached", 8), ("단다", "단다", "Literal", None), ("까", "을까", "OmittedCopula", 8)):
        assert want in have
    assert {"단다", "더래", "잔", "느냬"} <= {f for _, f, _, _, _ in rows}


def test_licences_name_endings():
    from lemmaweave.rules import endings as E

    forms = {f for _, f, _, _, _ in ending_rows()}
    lists = [*E.ONLY.values(), *E.NEVER.values(), E.NO_COPULA_ENDING, E.ADJECTIVAL_QUESTION, E.FACTUAL]
    assert all(set(x.split()) <= forms for x in lists)
    only = [f for x in E.ONLY.values() for f in x.split()]
    assert len(only) == len(set(only))


def test_text_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.txt").write_text("한국어\ntext", encoding="utf-8")
    (tmp_path / "b.txt").write_bytes("가 ".encode() + b"\xff\xfe bad")
    assert [r.text for r in read_text(spark, f"{tmp_path}/a.txt").collect()] == ["한국어\ntext"]
    read = {r.doc_id.rsplit("/", 1)[-1]: (r.text, r.error) for r in read_bytes(spark, str(tmp_path)).collect()}
    assert read == {"a.txt": ("한국어\ntext", None), "b.txt": ("가 ", "invalid UTF-8 at byte 4")}
    df = spark.createDataFrame([("w", [("먹다", "Predicate")], [("고", "Ending")], ["ending"])], "word string, lemmas array<struct<text:string,kind:string>>, morphemes array<struct<form:string,kind:string>>, rules array<string>")
    assert text_lines(df).first().value == "먹다\t고\tending"
    write_jsonl(df, f"{tmp_path}/out")
    assert spark.read.json(f"{tmp_path}/out").first().word == "w"
    try:
        write_jsonl(df, f"{tmp_path}/out")
    except Exception:
        return
    raise AssertionError("an existing output was overwritten")


def test_token_stream(spark, tmp_path):
    from lemmaweave.streaming import read_stream, token_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.txt").write_text("학교에 간다.\n네!", encoding="utf-8")
    q = token_stream(read_stream(spark, f"{tmp_path}/in")).writeStream.format("memory").queryName("toks").option("checkpointLocation", f"{tmp_path}/cp").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.surface for r in spark.table("toks").where("kind = 'word'").collect()) == sorted(["학교에", "간다", "네"])
