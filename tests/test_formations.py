"""Formations of a table give the second readings that the same formations of a list give."""

from __future__ import annotations

from pyspark.sql import functions as F

from lemmaweave.operators.predicates import LEMMA, MORPH
from lemmaweave.operators.projections import FORMATION, projected
from lemmaweave.rules import derivations as D

SCHEMA = f"text string, lemmas array<{LEMMA}>, morphemes array<{MORPH}>, rules array<string>"


def test_table_and_list_agree(spark):
    bases = [f"말{chr(0xAC00 + 28 * k)}" for k in range(300)]
    more = [(f"{b}되다", "Predicate", b, "Nominal", "되다", "suffix.verb.doeda") for b in bases]
    plain = lambda head: (head, [(head, "Predicate")], [("었", "Prefinal"), ("다", "Ending")], ["ending"])
    rows = [plain(f"{b}되다") for b in bases[:40]] + [plain("가공되다"), plain("먹다"), plain(f"{bases[1]}되다")]
    # Two heads in one analysis.
    rows.append(("둘", [(f"{bases[2]}되다", "Predicate"), (f"{bases[3]}되다", "Predicate")], [("고", "Ending"), ("다", "Ending")], ["ending"]))
    df = spark.createDataFrame(rows, SCHEMA)
    table = spark.createDataFrame(more, ", ".join(f"{c} string" for c in FORMATION)).withColumn("noted", F.lit(1))
    seen = lambda out: sorted(str(tuple(r)) for r in out.collect())
    by_list, by_table = seen(projected(df, D.formations(more))), seen(projected(df, D.formations(), table))
    assert by_list == by_table and len(by_table) > len(rows) + 40
    assert sum(r.startswith("('둘'") for r in by_table) > 1
    assert seen(projected(df, D.formations(), table.where("false"))) == seen(projected(df, D.formations()))
    assert projected(df.where("false"), D.formations(), table).count() == 0
