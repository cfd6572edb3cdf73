import numpy as np
from brindle.llm import quality_classifier as q
from brindle.llm import toxicity as t

GOOD = [f"the quick river{k} flows past a quiet village and the people there talk softly about weather number {k}" for k in range(60)]
BAD = [f"BUY!!! NOW!!! CHEAP{k}!!! $$$ CLICK### " * 4 for k in range(30)]
VILE = [f"you are a moron{k % 3} and the muslim idiot said number {k}" for k in range(40)]
CALM = [f"you are a friend{k % 3} and the teacher said number {k}" for k in range(80)]


def frames(spark, pairs, label):
    docs = spark.createDataFrame([(k, x, "clash") for k, (x, _) in enumerate(pairs)], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(k, y) for k, (_, y) in enumerate(pairs)] + [(None, 1), (0, None)], f"doc_id long, {label} int")


def test_quality_votes(spark):
    docs, labels = frames(spark, [(x, 1) for x in GOOD] + [(x, 0) for x in BAD], "quality")
    scores = {r.doc_id: r.score for r in q.score_documents(docs, q.fit(docs, labels)).collect()}
    assert min(scores[k] for k in range(60)) > 0.7 > max(scores[k] for k in range(60, 90))


def test_quality_block_size_changes_nothing():
    raw = q.features(GOOD + BAD)
    model = q.Model(np.ones(q.WIDTH, np.float32), np.eye(q.WIDTH, dtype=np.float32), raw[:0], np.array([1.0] * 60 + [0.0] * 30), 5)
    model.vectors = model.latent(raw)
    a, b = (model.score([*GOOD[:7], None, "", "x" * 3_000_000], n) for n in (1, 64))
    assert np.allclose(a, b) and ((a >= 0) & (a <= 1)).all()
    # Exact cosine against brute force.
    v = model.vectors
    near = np.argsort(-(v[3] @ v.T))[:5]
    w = (v[3] @ v[near].T).astype(float) ** 8
    assert np.isclose(model.score([GOOD[3]])[0], (w * model.labels[near]).sum() / w.sum())


def test_grams_do_not_depend_on_slices(monkeypatch):
    data = np.frombuffer(b"abcdefg hij" * 50, np.uint8)
    whole = q._grams(data)
    monkeypatch.setattr(q, "SLICE", 7)
    assert (q._grams(data) == whole).all()


def test_toxicity_and_counterfactuals(spark):
    docs, labels = frames(spark, [(x, 1) for x in VILE] + [(x, 0) for x in CALM], "toxic")
    model = t.fit(docs, labels)
    scores = {r.doc_id: r.score for r in t.score_documents(docs, model).collect()}
    assert min(scores[k] for k in range(40)) > 0.5 > max(scores[k] for k in range(40, 120))
    # The group named in every vile text is not what makes a text vile.
    assert model.score("the muslim teacher said number 3") < 0.5
    free = t.train([t.feature_array(t.words(x)) for x in VILE + CALM], [], np.array([1] * 40 + [0] * 80), counterfactual=0.0)
    assert model.word_weight("muslim") < 0.5 * free.word_weight("muslim") and model.pairs == len(VILE)
    # Twins score alike, and a mention alone flags nothing, in any of the languages.
    for text in ("the {} teacher said number 3", "you are a friend and {}", "{}"):
        for group in t.IDENTITY_TERMS:
            scores = [model.score(text.format(x)) for x in group]
            assert max(scores) - min(scores) < 0.1 and max(scores) < 0.5, (text, group)


def test_mentions_of_unseen_terms_stay_neutral():
    # No labelled text has an identity term, but vile words begin like some.
    vile, calm = [f"black blackness blackened{k % 3} number" for k in range(40)], [f"friend{k % 3} teacher number" for k in range(80)]
    vile = [x.replace("black ", "blackish ") for x in vile]
    rows, y = [t.feature_array(t.words(x)) for x in vile + calm], np.array([1] * 40 + [0] * 80)
    kept, free = t.train(rows, [], y), t.train(rows, [], y, counterfactual=0.0)
    assert kept.score("black teacher") < 0.5 < kept.score(vile[0]) and kept.word_weight("black") < 0.5 * free.word_weight("black")
    assert abs(kept.score("black teacher") - kept.score("white teacher")) < 0.15


def test_sentences_make_pairs():
    pairs = t.counterfactuals("The women sang. Nobody heard!\nThree muslims and two jews met? no")
    assert len(pairs) == 2 and len(t.counterfactuals(None)) == len(t.counterfactuals("no one")) == 0
    given = [(a.tolist(), b.tolist()) for a, b in pairs]
    assert [(a.tolist(), b.tolist()) for a, b in t.unpack_pairs(t.pack_pairs(pairs))] == given
    assert set(given[0][0]) <= set(t.word_features("women")) and all(f not in t.word_features("women") for f in given[0][1])


def test_gradient_is_that_of_the_objective():
    rng = np.random.default_rng(0)
    m, n, k = 6, 20, 7
    texts = np.nonzero(rng.random((n, m)) < 0.4)
    pair, of = np.nonzero(rng.random((k, m)) < 0.4)
    o = t.Objective(texts, (rng.random(n) < 0.4).astype(float), (pair, of, rng.choice([-1.0, 1.0], len(pair))), rng.random(k), m, 2.0)
    w, b = rng.normal(size=m), 0.3
    _, grad, grad_b = o(w, b)
    # Brute force: differences along each axis.
    for j in range(m):
        step = np.eye(m)[j] * 1e-6
        assert np.isclose((o(w + step, b)[0] - o(w - step, b)[0]) / 2e-6, grad[j], atol=1e-6)
    assert np.isclose((o(w, b + 1e-6)[0] - o(w, b - 1e-6)[0]) / 2e-6, grad_b, atol=1e-6)


def test_equal_cosines_go_by_place(spark):
    model = q.Model(np.ones(q.WIDTH, np.float32), np.eye(q.WIDTH, dtype=np.float32), np.zeros((0, q.WIDTH), np.float32), np.array([0.0] * 3 + [1.0] * 30), 4)
    model.vectors = np.repeat(model.latent(q.features([GOOD[0]])), 33, 0)
    assert np.allclose(model.score([GOOD[0], GOOD[0]]), 0.25, atol=1e-12)


def test_without_labels(spark):
    docs, _ = frames(spark, [("a", 1)], "quality")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.score_documents(docs, q.fit(docs, none)).first().score == 0.5
    assert 0 <= t.score_documents(docs, t.fit(docs, none)).first().score <= 1


def test_no_documents_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert q.score_documents(docs, q.fit(docs, none)).count() == 0 and t.score_documents(docs, t.fit(docs, none)).count() == 0


def test_nulls_repeats_and_empty(spark):
    docs, labels = frames(spark, [(x, 1) for x in GOOD] + [(x, 0) for x in BAD], "quality")
    model = q.fit(docs, labels)
    odd = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "x" * 1_000_000)], "doc_id long, text string")
    assert len([r for r in q.score_documents(odd, model).collect() if 0 <= r.score <= 1]) == 4
    assert len(t.score_documents(odd, t.Model({}, -1.0)).collect()) == 4
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert q.score_documents(empty, model).count() == 0 and q.score_documents(empty, q.fit(empty, labels)).count() == 0


def test_long_texts_teach_all_their_words(spark, monkeypatch):
    # More distinct words than any bound on them; the features that training gets are those of the whole texts.
    def word(k):
        return "x" + "".join(chr(97 + k // 26**j % 26) for j in range(4))

    long = [" ".join(word(k * 7 + j) for j in range(n)) for k, n in enumerate((3, 4_000, 20_000))]
    docs, labels = frames(spark, [(x, k % 2) for k, x in enumerate(long)], "toxic")
    seen = {}
    monkeypatch.setattr(t, "train", lambda rows, swapped, y: seen.update(rows=rows))
    t.fit(docs, labels)
    assert [r.tolist() for r in seen["rows"]] == [t.feature_array(t.words(x)).tolist() for x in long]
    assert len(t.packed(t.feature_array(t.words(long[2])))) == t.WIDTH // 8 + 1
