import random
import zlib

import numpy as np

from tesselle.llm import langid, toxicity

from .data import frame, odd_columns

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "é eau oui le que ç ai ou è la".split(), "de": "sch ung ö ein ü ch ß der lich ver".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def corpus(seed=0, n=600):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        lang = r.choice(list(SYLLABLES))
        words = prose(r, lang, r.randint(3, 80)).split(" ")
        toxic = r.random() < 0.3
        if toxic:
            for _ in range(2):
                words.insert(r.randint(0, len(words)), r.choice(["Blockhead", "numbskull"]))
        rows.append((i, " ".join(words), lang, "s", 0))
        labels.append((i, 1, int(toxic)))
    rows += [(n, None, "en", None, 0), (n + 1, "", "en", None, 0), (n + 2, "123 ?!", "en", None, 0), (None, "the her", "en", None, 0), (n + 3, "thon " * 30_000, None, None, 0), (5, "another under a used id", None, None, 0)]
    labels += [(n, 1, None), (None, 1, 1), (3, None, 0), (99_999, 1, 1)]
    return rows, labels


def held_out(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


def test_toxicity_on_held_out_rows(spark):
    rows, labels = corpus()
    docs, known = odd_columns(frame(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, known)
    got = toxicity.score(docs, model).collect()
    assert len(got) == len(rows)
    truth = dict((d, t) for d, _, t in labels[:600])
    seen = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert len(seen) > 60
    assert np.mean([r.predicted == truth[r.doc_id] for r in seen]) > 0.97
    for r in got:
        assert r.held_out == held_out(r.doc_id, 5, 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in got)


def test_held_out_labels_change_nothing(spark):
    rows, labels = corpus(1, 300)
    turned = [(d, q, 1 - t if held_out(d, 5, 0) and t is not None else t) for d, q, t in labels]
    docs = frame(spark, rows)
    one, two = (toxicity.train(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert (one.places == two.places).all() and np.allclose(one.weights, two.weights)


def test_toxicity_without_labels_or_rows(spark):
    docs = frame(spark, corpus(2, 10)[0])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.score(docs, toxicity.train(docs, none)).collect()} == {0.0}
    assert toxicity.score(frame(spark, []), toxicity.train(docs, none)).collect() == []


def test_features_are_those_of_single_texts():
    texts = ["", "abc", "Abcdefg", "idiot", "abcd" * 50]
    doc, place = toxicity.features(texts)
    for i, t in enumerate(texts):
        _, own = toxicity.features([t])
        assert place[doc == i].tolist() == own.tolist()
        t = t.lower()
        assert len(own) == len({t[j : j + n] for n in toxicity.ORDERS for j in range(len(t) - n + 1)})


def test_language_on_held_out_rows(spark):
    rows, _ = corpus(3)
    docs = odd_columns(frame(spark, rows))
    got = langid.identify(docs, langid.train(docs, sample=80, landmarks=20)).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows[:600]}
    seen = [r for r in got if r.held_out and r.doc_id in truth and r.doc_id != 5]
    assert np.mean([r.lang_pred == truth[r.doc_id] for r in seen]) > 0.97
    by = {r.doc_id: r for r in got}
    for i in (600, 601, 602):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert by[603].lang_pred == "en"
    for r in got:
        assert r.held_out == held_out(r.doc_id, 4, 2) and 0 <= r.score <= 1


def test_kernel_against_sets():
    r = random.Random(0)
    texts = [prose(r, lang, 15) for lang in SYLLABLES for _ in range(6)]
    langs = [lang for lang in SYLLABLES for _ in range(6)]
    model = langid.fit(texts, langs, [True] * len(texts))

    def grams(t):
        t = t.lower()
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    own = [grams(t) for t in texts]
    space = {g for g in set().union(*own) if sum(g in o for o in own) >= 2}
    probe = prose(r, "fr", 20)
    p = grams(probe) & space
    want = [len(p & o) / (len(p) * len(o & space)) ** 0.5 for o in own]
    assert np.allclose(model.kernel([probe])[0], want, atol=1e-5)


def test_toxicity_against_a_plain_fit(spark):
    """Counts in dictionaries, the choice of places by sorting, steps in doubles, scores as sums."""
    rows, labels = corpus(7, 400)
    labels = [x for x in labels if x[2] is not None]
    model = toxicity.train(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    toxic, texts = {}, {}
    for d, _, t in labels:
        if d is not None and not held_out(d, 5, 0):
            toxic[d] = max(t, toxic.get(d, 0))
    for d, t, *_ in rows:
        if d in toxic:
            texts[d] = min(t or "", texts.get(d, t or ""))
    ids = sorted(texts)
    own = {d: set(toxicity.features([texts[d]])[1].tolist()) for d in ids}
    n1 = sum(toxic[d] for d in ids)
    n0 = len(ids) - n1
    counts = {}
    for d in ids:
        for place in own[d]:
            counts.setdefault(place, [0, 0])[toxic[d]] += 1
    ratio, apart = {}, {}
    for place, (q, p) in counts.items():
        ratio[place] = np.log((p + 1) / (n1 + 2)) - np.log((q + 1) / (n0 + 2))
        share = (p + q + 1) / (n1 + n0 + 2)
        apart[place] = abs(p / n1 - q / n0) / np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0)) if p + q >= 5 else 0
    chosen = sorted(p for p in apart if apart[p] > 2)
    assert len(chosen) < toxicity.FEATURES and chosen == model.places.tolist()
    x = np.array([[ratio[p] * (p in own[d]) for p in chosen] for d in ids])
    y = np.array([toxic[d] for d in ids], float)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    step = 1 / (0.25 * weight.max() * (np.linalg.norm(x.T @ x, 2) + len(y)) + 1)
    now, before = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for k in range(150):  # as many accelerated steps; that they are few keeps the weights small
        at = now + k / (k + 3) * (now - before)
        wrong = weight * (1 / (1 + np.exp(-(x @ at[:-1] + at[-1]))) - y)
        before, now = now, at - step * np.append(x.T @ wrong + at[:-1], wrong.sum())
    w = now
    probes = [t or "" for _, t, *_ in rows[:120]]
    found = model.scores(probes)
    for text, score in zip(probes, found):
        places = set(toxicity.features([text])[1].tolist())
        want = 1 / (1 + np.exp(-(w[-1] + sum(w[i] * ratio[p] for i, p in enumerate(chosen) if p in places))))
        assert abs(want - score) < 0.03
        total = model.intercept + sum(weight for p, weight in zip(model.places.tolist(), model.weights) if p in places)
        assert abs(1 / (1 + np.exp(-total)) - score) < 1e-9


def test_training_rows_are_bounded_under_repeats(spark):
    rows, labels = corpus(8, 200)
    rows += [(1, f"toxic text number {i}", "en", None, 0) for i in range(3000)] + [(2, "the very same", "de", None, 0)] * 3000
    docs = frame(spark, rows)
    known = spark.createDataFrame(labels + [(1, 1, 1)] * 50, "doc_id long, quality int, toxic int")
    got = toxicity.training_rows(docs, known, sample=20).collect()
    assert len(got) <= 40 and len({r.doc_id for r in got}) == len(got)
    assert {r.label for r in got} == {0, 1} and max(sum(r.label == k for r in got) for k in (0, 1)) <= 20
    got = langid.training_rows(docs, sample=25, landmarks=4)
    by = {lang: [r for r in got if r.lang == lang] for lang in ("en", "de", "fr")}
    assert sum(map(len, by.values())) == len(got) and all(len(x) == 25 and sum(r.landmark for r in x) == 4 for x in by.values())
    assert sum(r.text == "the very same" for r in got) <= 1
    again = langid.training_rows(docs.repartition(7), sample=25, landmarks=4)
    assert again == got
    assert sum(len(r.text.encode()) for r in langid.training_rows(docs, sample=25, landmarks=4, limit=900)) <= 900
    many = frame(spark, [(i, f"text {i}", f"l{i % 150}", None, 0) for i in range(900)] + [(i, f"text {i}", "often", None, 0) for i in range(900, 1000)])
    got = langid.training_rows(many, languages=8)
    assert len({r.lang for r in got}) == 8 and "often" in {r.lang for r in got}


def test_language_against_a_plain_fit():
    """The kernel from sets, one system of equations, the largest of the scores."""
    r = random.Random(1)
    texts, langs = zip(*[(prose(r, lang, r.randint(4, 25)), lang) for lang in SYLLABLES for _ in range(14)])
    landmark = [i % 3 == 0 for i in range(len(texts))]
    model = langid.fit(list(texts), list(langs), landmark)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    marks = [grams(t.lower()) for t, m in zip(texts, landmark) if m]
    space = {g for g in set().union(*marks) if sum(g in m for m in marks) >= 2}
    kernel = lambda x: [len(x & m & space) / (max(1, len(x & space)) * max(1, len(m & space))) ** 0.5 for m in marks]
    names = sorted(SYLLABLES)
    k_nm, k_mm = np.array([kernel(grams(t.lower())) for t in texts]), np.array([kernel(m) for m in marks])
    y = np.array([[float(lang == n) for n in names] for lang in langs])
    weight = np.diag([1 / langs.count(lang) for lang in langs])
    alpha = np.linalg.solve(k_nm.T @ weight @ k_nm + langid.RIDGE * len(names) * k_mm + 1e-8 * np.eye(len(marks)), k_nm.T @ weight @ y)
    probes = [prose(r, lang, n) for lang in SYLLABLES for n in (1, 3, 20)]
    want = np.array([kernel(grams(t.lower())) for t in probes]) @ alpha
    got, scores = model.predict(probes)
    assert got == [names[i] for i in want.argmax(axis=1)]
    assert np.allclose(scores, np.clip(want.max(axis=1), 0, 1), atol=0.02)


def test_many_scripts(monkeypatch):
    r = random.Random(2)
    scripts = {"zh": range(0x4E00, 0x4F40), "ja": range(0x3041, 0x3097), "ko": range(0xAC00, 0xAD00), "xx": range(0x1F600, 0x1F640), "ru": range(0x430, 0x450)}
    made = lambda lang: "".join(chr(r.choice(scripts[lang])) for _ in range(60))
    texts, langs = zip(*[(made(lang), lang) for lang in scripts for _ in range(12)])
    model = langid.fit(list(texts), list(langs), [True] * len(texts))
    assert int(model.letters.max()) > 161 and model.slots[2].table is None
    probes = [made(lang) for lang in scripts for _ in range(5)]
    assert model.predict(probes)[0] == [lang for lang in scripts for _ in range(5)]
    few = [prose(r, lang, 12) for lang in SYLLABLES for _ in range(5)]
    table = langid.fit(few, ["a"] * len(few), [True] * len(few))
    assert table.slots[2].table is not None
    want = table.presence(few + probes)
    monkeypatch.setattr(langid, "TABLE", 0)
    search = langid.fit(few, ["a"] * len(few), [True] * len(few))
    assert search.slots[2].table is None and (search.presence(few + probes) == want).all()


def test_language_without_training(spark):
    docs = frame(spark, [(1, "the", None, None, 0)])
    assert [r.lang_pred for r in langid.identify(docs, langid.train(docs)).collect()] == ["und"]
    empty = frame(spark, [])
    assert langid.identify(empty, langid.train(empty)).collect() == []
