import hashlib
import re

import pytest

from tesselle.llm import exact, lines

from .data import documents, frame, odd_columns, row_key


def normal(t):
    return re.sub(r"[\x20\x09-\x0d]+", " ", t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("winners,tracked", [(exact.MAX_WINNERS, exact.TRACKED), (1, 64)])
def test_copies_against_a_dictionary(spark, winners, tracked):
    rows = documents(11, n=80) + [(500 + i, "the  hot\ttext" if i % 2 else "the hot text", None, None, 0) for i in range(90)]
    got = exact.group_copies(odd_columns(frame(spark, rows)), max_winners=winners, tracked=tracked).collect()
    groups = {}
    for d, t, *_ in rows:
        groups.setdefault(normal(t), []).append(d)
    want = []
    for d, t, *_ in rows:
        own = groups[normal(t)]
        ids = [x for x in own if x is not None]
        want.append((d, min(ids) if ids else None, len(own), sha(normal(t))))
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == sorted(want, key=str)
    kept = [r for r in got if r.kept]
    assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_rows_that_stay(spark):
    rows = documents(12)
    df = odd_columns(frame(spark, rows))
    out = exact.drop_copies(df)
    assert out.columns == df.columns
    left = out.collect()
    assert len(left) == len({normal(t) for _, t, *_ in rows}) == len({normal(r.text) for r in left})
    assert exact.group_copies(frame(spark, [])).collect() == [] and exact.drop_copies(frame(spark, [])).collect() == []


def brute_lines(rows, run):
    """First occurrences stay, in the order of id and key; equal rows are one document."""
    docs = sorted({(d is None, d or 0, row_key(d, t), t or "") for d, t, *_ in rows})
    seen, cut = set(), {}
    for key in docs:
        found = key[3].split("\n")
        gone = set()
        for i in range(len(found) - run + 1):
            window = tuple(found[i : i + run])
            if window in seen:
                gone |= set(range(i, i + run))
            seen.add(window)
        cut[key] = (found, gone)
    out = []
    for d, t, *_ in rows:
        found, gone = cut[(d is None, d or 0, row_key(d, t), t or "")]
        kept = "\n".join(x for i, x in enumerate(found) if i not in gone)
        out.append((d, len(found), len(gone), sum(i in gone and i - 1 not in gone for i in range(len(found))), sha(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("run", [1, 2, 3, 8])
def test_lines_against_a_set(spark, run):
    rows = [(d, t and re.sub(" (Sit|x|dolor)", "\n", t), a, b, c) for d, t, a, b, c in documents(13, n=70, words=("a", "b", "Sit", "x", "dolor"))]
    rows += [(900 + i, "head\nsame\nsame\nsame\n" + str(i) + "\ncommon\nlines\nhere\n\n\n", None, None, 0) for i in range(20)]
    df = odd_columns(frame(spark, rows))
    got = lines.removal_digests(df, run=run).collect()
    assert sorted(map(tuple, got), key=str) == brute_lines(rows, run)


def test_lines_of_no_rows_and_kept_columns(spark):
    assert lines.removal_digests(frame(spark, [])).collect() == []
    df = odd_columns(frame(spark, documents(14)))
    out = lines.remove_runs(df)
    assert out.columns == [*df.columns, "kept_text_", "n_lines_", "n_removed", "n_runs"]
    assert {r.kept_text for r in out.select("kept_text").collect()} == {7}


def test_a_very_long_line_and_very_many_lines(spark):
    rows = [(1, "x" * 1_000_000, None, None, 0), (2, "x" * 1_000_000 + "\nand\nmore", None, None, 0), (3, "a\nb\n" * 100_000, None, None, 0), (4, "and\nmore", None, None, 0)]
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in lines.removal_digests(frame(spark, rows)).collect()}
    # of a, b, a, b the first three lines are the first a b and b a; the last line is empty
    assert got == {1: (1, 0), 2: (3, 0), 3: (200_001, 199_997 + 1), 4: (2, 2)}
    kept = {r.doc_id: r.group_size for r in exact.group_copies(frame(spark, rows + [(9, "x" * 1_000_000, None, None, 0)])).collect()}
    assert kept == {1: 2, 2: 1, 3: 1, 4: 1, 9: 2}


def test_a_hot_fingerprint_with_many_neighbours(spark):
    """One line everywhere, with the same and with other lines around it."""
    rows = [(i, f"{i % 7}\nthe line\n{i % 5}\n{i}\nthe line", None, None, 0) for i in range(200)]
    for run in (1, 2, 3):
        got = lines.removal_digests(frame(spark, rows).repartition(5), run=run).collect()
        assert sorted(map(tuple, got), key=str) == brute_lines(rows, run)


def test_native_plans_run_no_python(spark):
    df = frame(spark, documents(15))
    for made in (exact.group_copies(df), lines.removal_digests(df)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
