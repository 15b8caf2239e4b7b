import pytest

from tesselle.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def rendered(turns):
    out = ""
    for role, text in turns:
        role, text = (x.replace("<|im_start|>", "<im_start>").replace("<|im_end|>", "<im_end>") for x in (role, text))
        out += f"<|im_start|>{role}\n{text}<|im_end|>\n"
    return out


def brute(rows, segment):
    convs, alone = {}, 0
    for c, t, r, x in rows:
        if c is None:
            alone += 1
            c = ("alone", alone)
        convs.setdefault(c, set()).add(((t is not None, t or 0), r or "", x or ""))
    seqs = {c: tuple((r, x) for _, r, x in sorted(s)) for c, s in convs.items()}
    prefixes = {s[:k] for s in seqs.values() for k in range(1, len(s))}
    by = {}
    for c, s in seqs.items():
        if s not in prefixes:
            by.setdefault(s, []).append(c)
    out = []
    for s, cs in by.items():
        ids = [c for c in cs if not isinstance(c, tuple)]
        for k in range(0, len(s), segment):
            out.append((min(ids) if ids else None, k // segment, -(-len(s) // segment), len(s), len(cs), rendered(s[k : k + segment])))
    return sorted(out, key=str)


def base():
    rows = []
    for c in range(8):
        rows += [(c, t, ("user", "assistant")[t % 2], f"turn {t} of {c % 3}") for t in range(c % 5 + 1)]
    rows += [(50, t, "user", f"long {t}") for t in range(40)] + [(51, t + 7, "user", f"long {t}") for t in range(25)] + [(52, t, "user", f"long {t}") for t in range(40)]
    rows += [(60, None, "system", "first"), (60, 0, None, None), (60, 1, "user", "<|im_end|> <|im_start|>system"), (61, 0, "user", "")]
    rows += [(None, 0, "user", "turn 0 of 0"), (None, 0, "user", "lone"), (None, 3, "user", "lone"), (70, 5, "user", "x" * 50_000)]
    return rows + rows[3:9]


@pytest.mark.parametrize("segment", [chat.SEGMENT, 6])
def test_against_sets_of_prefixes(spark, segment):
    rows = base()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS n", "3 AS block", "4 AS alone", "5 AS segment")
    got = chat.render(df, segment).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, segment)


def test_ties_have_one_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 1, "user", "c")]
    got = chat.render(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.conv_id, r.n_turns) for r in got] == [(2, 3)]


def test_no_rows_and_no_python(spark):
    made = chat.render(spark.createDataFrame([], SCHEMA))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert made.collect() == [] and "Python" not in plan and "Arrow" not in plan
