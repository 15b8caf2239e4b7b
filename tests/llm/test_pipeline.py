import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tesselle.llm import toxicity

from .data import SCHEMA
from .test_classifiers import corpus
from .test_simhash import fingerprint, groups


def tables(spark, tmp_path):
    r = random.Random(9)
    rows, labels = corpus(5, 260)
    passage = " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    for i in range(0, 200, 9):
        d, t, *rest = rows[i]
        rows[i] = (d, f"{t} {passage} {t[::-1]}", *rest)
    rows += [(300 + i, re.sub(" ", "  ", rows[i * 3][1] or ""), "en", "s", 0) for i in range(25)]
    rows += [(400 + i, (rows[i * 4][1] or "") + " end" * (i % 3), "en", "s", 0) for i in range(25)]
    rows = [x for x in rows if x[0] is not None and x[1] != "another under a used id"]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows


def plain(spark, path, rows):
    model = toxicity.train(spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet"))
    docs = {d: t for d, t, *_ in rows}
    scores = model.scores([t or "" for t in docs.values()])
    docs = {d: t for (d, t), s in zip(docs.items(), scores) if s < 0.5}
    seen, kept = set(), {}
    for d in sorted(docs):
        key = re.sub(r"[\x20\x09-\x0d]+", " ", docs[d] or "")
        if key not in seen:
            seen.add(key)
            kept[d] = docs[d]
    fps = {d: fingerprint(t) for d, t in kept.items()}
    root = groups(set(fps.values()))
    least = {}
    for d, f in fps.items():
        least[root[f]] = min(d, least.get(root[f], d))
    kept = {d: t for d, t in kept.items() if least[root[fps[d]]] == d}
    texts = {d: (t or "").encode() for d, t in kept.items()}
    seen = Counter(t[i : i + 200] for t in texts.values() for i in range(len(t) - 199))
    out = {}
    for d, t in texts.items():
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 199):
            if seen[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        out[d] = bytes(b for b, g in zip(t, gone) if not g).decode("utf-8", "ignore")
    return out, len(docs), len(kept)


def test_pipeline_against_plain_stages(spark, tmp_path):
    rows = tables(spark, tmp_path)
    want, clean, kept = plain(spark, tmp_path, rows)
    assert kept < clean < len(rows) and any(len(t) < len(dict((d, x) for d, x, *_ in rows)[d] or "") for d, t in want.items())
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    full = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = set()
    for d, t in want.items():
        ids = full.encode(t, add_special_tokens=False).ids + [0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        pieces |= {(d, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))}
    assert {tuple(r)[:5] for r in got} == pieces and len(got) == len(pieces)


def test_stages_keep_the_columns(spark, tmp_path):
    tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "suffix_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).collect() == []
