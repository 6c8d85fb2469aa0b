"""The pipeline against brute-force stages, the queries against SQL, and the entry without the subpackage."""

from __future__ import annotations

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from lemmaweave.llm import queries as Q

from ..conftest import SF, same
from .test_operators import brute_hits, brute_quality, brute_similar, brute_substring

ROOT = Path(__file__).resolve().parents[2]


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert same(Q.queries()[name](spark, SF), duck.sql(Q.oracle_sql()[name]))


def test_pipeline(spark, duck):
    import corpus_pipeline as P

    rows = duck.sql("SELECT doc_id, text FROM documents ORDER BY doc_id").fetchall()
    good = {r[0] for r in duck.sql("SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0").fetchall()}
    kept = {q[0] for q in brute_quality(rows, good) if q[-1]}
    rows = [r for r in rows if r[0] in kept]
    # Near-duplicates of a stage are five-word shingles of similarity 0.8 or more; op3's own query links by 4 bits.
    rows = [(i, t) for (i, t), c in zip(rows, brute_similar(rows), strict=True) if c == i]
    rows = [(i, t if not w[2] else w[4]) for (i, t), w in zip(rows, brute_substring(rows), strict=True)]
    items = duck.sql("SELECT CAST(item_id AS VARCHAR), text FROM benchmark").fetchall()
    rows = [r for r, h in zip(rows, brute_hits([t for _, t in rows], items), strict=True) if not h[4]]
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(Q.tokenizer_path("byte_bpe_50k.json"))
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) + 1 for i, t in rows}
    got = Counter()
    for r in P.run(spark, SF).collect():
        got[r.doc_id] += r.length
    assert dict(got) == want
    assert [n for n, _ in P.STAGES] and P.ORACLE_SQL is None


def test_entry_without_the_subpackage(tmp_path):
    for p in ("__spark_entry__.py", "lemmaweave"):
        subprocess.run(["cp", "-r", str(ROOT / p), str(tmp_path)], check=True)
    subprocess.run(["rm", "-r", str(tmp_path / "lemmaweave/llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()))"], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin:/usr/local/bin", "PYTHONPATH": str(tmp_path)})
    assert said.stdout.split()[-1] == "False", said.stderr


def test_pipeline_of_odd_tables(spark, tmp_path):
    """Null texts and ids, repeated rows, shared ids, a very long text and columns whose names the operators use; and no documents at all."""
    import corpus_pipeline as P

    text = lambda k, n=60: " ".join(f"w{k}x{j}" for j in range(n))
    rows = [(1, text(1)), (2, text(2)), (2, text(3)), (3, text(2)), (4, None), (5, ""), (6, text(6, 20)), (None, text(7)), (None, text(1)), (8, text(8, 40_000)), (9, text(9)), (9, text(9))]
    schema = "doc_id long, text string, lang string, source string, n_chars long, c0 int, block string, digest double, q_w string, bucket int"
    table = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "b", 0.5, "q", 3) for i, t in rows], schema)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([], "item_id long, text string")
    for name, docs in (("some", table), ("none", table.where("false"))):
        at = f"{tmp_path}/{name}"
        docs.repartition(3).write.parquet(f"{at}/documents.parquet")
        labels.write.parquet(f"{at}/labels.parquet")
        benchmark.write.parquet(f"{at}/benchmark.parquet")
    got = P.run(spark, f"file://{tmp_path}/some").select("doc_id", "piece").collect()
    whole = Counter(r.doc_id for r in got if r.piece == 0)
    assert whole == {1: 1, 2: 2, None: 2, 8: 1, 9: 2}  # equal rows of one id stay together
    assert 3 not in whole and sum(r.doc_id == 8 for r in got) > 50
    assert P.run(spark, f"file://{tmp_path}/none").count() == 0
