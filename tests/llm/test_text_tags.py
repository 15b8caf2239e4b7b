"""Different texts under one id whose 32-bit hashes are equal stay different documents."""

import hashlib
import os.path

from tesselle.llm import lines, suffix

from .data import frame


def twins(spark, expression, n=300_000):
    """Two texts of the expression over id with the same hash()."""
    made = spark.range(n).selectExpr(f"{expression} AS text")
    pair = made.selectExpr("text", "hash(text) AS h").groupBy("h").agg({"text": "collect_list"}).toDF("h", "texts")
    return sorted(pair.where("size(texts) > 1").orderBy("h").first().texts[:2])


def test_lines_of_texts_with_equal_hashes(spark):
    a, b = twins(spark, "concat('same\\nlines\\n', id)")
    got = lines.removal_digests(frame(spark, [(None, a, None, None, 0), (None, b, None, None, 0)])).collect()
    assert a != b and sorted(r.n_removed for r in got) == [0, 2]


def test_spans_of_texts_with_equal_hashes(spark):
    passage = "".join(hashlib.sha256(bytes([i])).hexdigest() for i in range(5))
    a, b = twins(spark, f"concat(repeat(concat(id, '-'), CAST(1 + id % 9 AS INT)), '{passage}')")
    shared = os.path.commonprefix([a[::-1], b[::-1]])[::-1]
    got = suffix.removal_digests(frame(spark, [(None, a, None, None, 0), (None, b, None, None, 0)])).collect()
    want = [(len(x), len(shared), 1, hashlib.sha256(x[: -len(shared)].encode()).hexdigest()) for x in (a, b)]
    assert a != b and sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted(want)
