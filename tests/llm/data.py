"""Small documents with what goes wrong: nulls, empty and long texts, ties, repeats, odd columns."""

import hashlib
import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(seed=0, n=60, words=("lorem", "ipsum", "dolor", "Sit", "amet", "né", "über", "中文", "x"), longest=60):
    r = random.Random(seed)
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, longest))) for _ in range(n)]
    passage = " ".join(r.choice(words) for _ in range(30))
    for i in range(0, n, 5):
        texts[i] = texts[i][: len(texts[i]) // 2] + " " + passage + texts[i][len(texts[i]) // 2 :]
    for i in range(3, n, 7):
        texts[i] = texts[i - 1]
    texts += [None, "", " ", "\n\t ", "a", "😀" * 5, "word " * 400, "abcdefg" * 100, None, ""]
    rows = [(i * 3, t, r.choice(["en", "de", None]), r.choice(["s0", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [(6, texts[2], "en", "s0", 1), (6, texts[2], "en", "s0", 1), (9, "another text under a used id", None, None, None), (None, "no id at all", None, None, None), (None, texts[4], None, None, None)]
    r.shuffle(rows)
    return rows


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def odd_columns(df):
    """Columns whose names the operators use inside."""
    from pyspark.sql import functions as F

    return df.select("*", *(F.lit(7).alias(c) for c in ("tag", "fp", "row", "length", "piece", "n", "t0", "lo", "first", "bucket", "score", "anchor", "text_sha256", "key", "k0", "_k1", "_digest", "kept_text", "n_lines", "_lines", "_slot", "_nth", "_los", "h", "near")))


def row_key(doc, text):
    """The key that orders rows of one id."""
    digest = hashlib.sha256((("-" if doc is None else f"+{doc}\0") + (text or "")).encode()).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)
