"""A megabyte without a space, and one of very short words, through the operators that score or fingerprint."""

import hashlib
import random

import pytest
import xxhash

from tesselle.llm import chat, langid, omh, simhash, toxicity

from .data import frame

R = random.Random(12)
SOLID = "".join(R.choice("abcdefghijklmnop") for _ in range(1_000_000))
SHORT = "a b " * 250_000
ROWS = [(1, SOLID, "en", None, 0), (2, SOLID[:999_999], "en", None, 0), (3, SHORT, "de", None, 0), (4, "few words here", "de", None, 0), (5, "", None, None, 0)]


def test_fingerprints(spark):
    got = {r.doc_id: r for r in simhash.near_groups(frame(spark, ROWS)).collect()}
    assert got[1].fingerprint == f"{xxhash.xxh64_intdigest(SOLID.encode(), 42):016x}" and got[5].fingerprint == "0" * 16
    assert len({r.component_id for r in got.values()}) == 5


def test_order_minhash(spark):
    got = {r.doc_id: r for r in omh.neighbour_fingerprints(frame(spark, ROWS)).collect()}
    assert got[1].n_chars == 1_000_000 and got[1].near_next > 0.95
    edited = SOLID[:500_000] + SOLID[:500_000]
    assert got[1].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 < got[1].near_edited < 0.9
    assert got[3].near_next == 0.0 and all(0 <= r.near_edited <= 1 for r in got.values())


def test_classifiers(spark):
    docs = frame(spark, ROWS)
    scored = toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([(d, 1, d % 2) for d in (1, 2, 3, 4, 5, 6)], "doc_id long, quality int, toxic int"))).collect()
    assert len(scored) == 5 and all(0 <= r.score <= 1 for r in scored)
    named = {r.doc_id: r for r in langid.identify(docs, langid.train(docs)).collect()}
    assert named[5].lang_pred == "und" and {named[d].lang_pred for d in (1, 2, 3, 4)} <= {"en", "de"}


@pytest.mark.parametrize("copies", [1, 2000])
def test_a_turn_that_is_logged_very_often(spark, copies):
    rows = [(1, 1, "user", SOLID[:1000]), (1, 2, "assistant", "yes")] + [(2, 1, "user", SOLID[:1000])] * copies + [(2, 2, "assistant", "yes"), (2, 3, "user", "no")]
    got = chat.render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)).collect()
    assert [(r.conv_id, r.n_turns, r.n_copies, r.text.count(SOLID[:1000])) for r in got] == [(2, 3, 1, 1)]
