"""The word cache: transactions, bound, compaction and two writers. Analyses are stood in for, as only their keeping is looked at."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lemmaweave.plans import analyze


@pytest.fixture
def calls(monkeypatch):
    """Every word has two analyses; the words of each call are kept."""
    seen: list[set[str]] = []

    def stand_in(words):
        seen.append({r.text for r in words.collect()})
        return words.select(F.col("text").alias("word"), F.explode(F.array(F.lit("a"), F.lit(f"call {len(seen)}"))).alias("reading"), F.repeat("text", F.lit(50)).alias("filler"))

    monkeypatch.setattr(analyze, "analyze_words", stand_in)
    return seen


def words(spark, text: str):
    return spark.createDataFrame([(w,) for w in text.split()], "text string")


def test_once_each_and_failures(spark, calls, monkeypatch):
    s = analyze.Session(spark)
    assert s.analyze(words(spark, "가 나 가")).count() == 4 and s.analyze(words(spark, "나 다")).count() == 4 and s.analyze(words(spark, "다 가")).count() == 4
    assert calls == [{"가", "나"}, {"다"}] and s.batches == 2

    def failing(new):
        return new.select(F.raise_error(F.lit("broken")).cast("string").alias("word"), F.lit("x").alias("reading"), F.lit("y").alias("filler"))

    good = analyze.analyze_words
    monkeypatch.setattr(analyze, "analyze_words", failing)
    with pytest.raises(Exception, match="broken"):
        s.analyze(words(spark, "라"))
    monkeypatch.setattr(analyze, "analyze_words", good)
    assert s.batches == 2 and s.analyze(words(spark, "라 가")).count() == 4 and calls[-1] == {"라"}
    s.forget()
    assert s.batches == 0 and s.cached() is None and s.analyze(words(spark, "가")).count() == 2


def test_bound(spark, calls):
    s = analyze.Session(spark)
    s.analyze(words(spark, "가"))
    one = s.manifest()[0][1]
    s = analyze.Session(spark, max_bytes=int(2.5 * one))
    kept = [s.analyze(words(spark, w)) for w in "가 나 다 라".split()]
    assert s.batches == 2 and sum(n for _, n in s.manifest()) <= 2.5 * one
    assert {r.word for r in s.cached().collect()} == {"다", "라"}  # the oldest went first
    assert [{r.word for r in k.collect()} for k in kept] == [{"가"}, {"나"}, {"다"}, {"라"}]  # results outlive the cache
    small = analyze.Session(spark, max_bytes=10)
    assert small.analyze(words(spark, "가 나")).count() == 4 and small.batches == 0


def test_compaction_and_two_writers(spark, calls, monkeypatch):
    a = analyze.Session(spark, max_batches=3)
    b = analyze.Session(spark, a.path, max_batches=3)
    a.analyze(words(spark, "가"))
    assert b.analyze(words(spark, "가 나")).count() == 4 and calls[-1] == {"나"}  # what the other has is not analysed again
    # Both analyse a word at once: the older batch speaks, in reads and after compaction.
    monkeypatch.setattr(b, "cached", lambda: None)
    b._add(analyze.analyze_words(words(spark, "가 다")))
    assert {r.reading for r in a.cached().where("word = '가'").collect()} == {"a", "call 1"}
    assert a.analyze(words(spark, "라 다")).count() == 4 and a.batches == 1
    assert a.cached().count() == 8 and {r.reading for r in a.cached().where("word = '가'").collect()} == {"a", "call 1"}
