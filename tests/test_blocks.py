"""Texts that arrive as byte blocks, against the texts as a whole."""

from __future__ import annotations

import random
from collections import defaultdict

from lemmaweave.functions.tokens import tokenize
from lemmaweave.streaming import _boundary, join_blocks, token_stream


def test_blocks(spark, tmp_path):
    rng = random.Random(9)
    letters = ["가", "먹다", "a", "é", " ", "\n", "　", "!", "😀", "  ", "긴단어" * 9]
    whole = {f"t{k}": "".join(rng.choice(letters) for _ in range(rng.randrange(1, 120))).encode() for k in range(8)} | {"empty": b"", "bad": "좋은 글 ".encode() + b"\xff rest", "cut": "끝 가".encode()[:-1], "open": "아직 안 끝난".encode()}
    rows = []
    for name, body in whole.items():
        cuts = sorted({0, len(body), *(rng.randrange(len(body) + 1) for _ in range(8))})
        parts = [body[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] or [b""]
        rows += [(name, n, p, n == len(parts) - 1 and name != "open") for n, p in enumerate(parts)]
    rng.shuffle(rows)  # out of order, and some twice
    rows += rng.sample(rows, 12)
    schema = "doc_id string, seq int, block binary, last boolean"
    for n in range(0, len(rows), 30):  # batches of a few blocks
        spark.createDataFrame(rows[n : n + 30], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = join_blocks(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    texts, errors = defaultdict(bytes), {}
    for r in sorted(out.collect(), key=lambda r: (r.doc_id, r.base)):
        assert r.base == len(texts[r.doc_id])
        texts[r.doc_id] += r.text.encode()
        if r.error:
            errors[r.doc_id] = r.error
    assert errors == {"bad": f"invalid UTF-8 at byte {len('좋은 글 '.encode())}", "cut": f"invalid UTF-8 at byte {len('끝 '.encode())}"}
    good = {k: v for k, v in whole.items() if k not in ("bad", "cut", "open", "empty")}
    assert {k: texts[k] for k in good} == good and texts["bad"] == "좋은 글 ".encode() and texts["cut"] == "끝 ".encode() and texts["open"] == "아직 안".encode()
    # Tokens of the pieces are those of the whole texts.
    got = {(r.doc_id, r.base + r.start, r.base + r.end, r.surface, r.kind) for r in token_stream(out, keys=("doc_id", "base")).collect() if r.doc_id in good}
    want = {(r.doc_id, r.start, r.end, r.surface, r.kind) for r in tokenize(spark.createDataFrame([(k, v.decode()) for k, v in good.items()], "doc_id string, text string")).collect()}
    assert got == want


def test_boundary():
    assert [_boundary(t) for t in ("", "가", "가 ", "가 나", "가  나", " 가", "　 가", "a\nb c")] == [0, 0, 1, 1, 1, 0, 0, 3]
