"""The training sample of the toxicity model: long texts and repeated keys."""

import numpy as np

from llm import toxicity


def labelled(n=600):
    toxic = (np.arange(n) % 4 == 0).astype(int)
    rng = np.random.default_rng(1)
    return [" ".join(f"w{k}" for k in rng.integers(0, 300, 20)) + (" vexorab vexorac vexorab w1" if y else "") for y in toxic], toxic


def test_one_long_text_does_not_end_the_sample(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 20_000)
    texts, toxic = labelled()
    assert toxicity._trained(["long " * 500_000, *texts], np.append(0, toxic), (0.5, 0.5)).chain is not None


def test_words_are_dealt_by_class(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 1_000)
    size, toxic = np.full(200, 10), np.arange(200) >= 150  # 1,500 clean words come before 500 toxic ones
    kept = toxicity._within(size, toxic.astype(int))
    assert (kept & toxic).sum() == 50 and (kept & ~toxic).sum() == 50
    kept = toxicity._within(size[:160], toxic[:160].astype(int))
    assert (kept & toxic[:160]).sum() == 10 and (kept & ~toxic[:160]).sum() == 90


def test_a_class_of_long_texts_only(monkeypatch):
    """Pieces of the long texts are learned from: the model tells the classes apart."""
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 10_000)
    texts, toxic = labelled()
    texts = [x + (" " + x) * 40 if y else x for x, y in zip(texts, toxic)]
    model = toxicity._trained(texts, toxic, (0.75, 0.25))
    assert model.chain is not None
    for x, y in zip(texts[:40], toxic[:40]):
        data = np.frombuffer(x.encode(), np.uint8)
        found, first, _, _ = toxicity.features(data, np.array([0, len(data)]))
        assert (model.score(model.chain.marginals(found, first), first)[0] > 0.5) == bool(y)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_WORDS", 1_000)
    texts = [" ".join(f"{k}w{i}" for i in range(300)) for k in range(30)]
    pieces = [toxicity._piece(x) for x in texts]
    assert all(p in x and len(p.split()) == 20 for p, x in zip(pieces, texts))
    assert len({x.index(p) for p, x in zip(pieces, texts)}) > 10 and pieces == [toxicity._piece(x) for x in texts]
    assert toxicity._piece("a b") == "a b" and toxicity._piece("") == ""
    toxicity._trained(["a b c", "long " * 500], np.array([0, 1]), (0.5, 0.5))  # nothing to tell apart, but a model


def test_slope_of_the_chain_against_differences(monkeypatch):
    """The slope that training follows is that of the log likelihood of the labels."""
    monkeypatch.setattr(toxicity, "SEGMENT", 4)
    rng = np.random.default_rng(3)
    size, first = 7, np.array([0, 5, 5, 6, 17])
    found, label = rng.integers(0, size, (17, 2)).astype(np.uint32), rng.integers(0, 2, 17)
    chain = toxicity.Chain(rng.normal(size=size), -0.3, rng.normal(size=(2, 2)))

    def likelihood(params):
        weights, bias, moves = params[:size], params[size], params[size + 1:].reshape(2, 2)
        total = 0.0
        for s, e in zip(first[:-1], first[1:]):
            if s == e:
                continue
            score = np.stack([np.zeros(e - s), weights[found[s:e]].sum(axis=1) + bias], axis=1)
            start = np.logaddexp.reduce(moves, axis=0)  # from either state
            path, all_paths = start[label[s]] + score[0, label[s]], start + score[0]
            for k in range(1, e - s):
                path += moves[label[s + k - 1], label[s + k]] + score[k, label[s + k]]
                all_paths = np.logaddexp.reduce(all_paths[:, None] + moves, axis=0) + score[k]
            total += path - np.logaddexp.reduce(all_paths)
        return total

    params = chain.params()
    steps = np.eye(len(params)) * 1e-5
    want = [(likelihood(params + d) - likelihood(params - d)) / 2e-5 for d in steps]
    assert np.allclose(chain.slope(found, first, label), want, atol=1e-6)


def test_one_row_of_a_key(spark):
    texts, toxic = labelled()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(toxic)], "doc_id long, toxic int")
    again = docs.where("doc_id = 0").selectExpr("doc_id", "text || ' zz vexorab zz' AS text").crossJoin(spark.range(50)).drop("id")
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs.unionByName(again), labels)
    assert np.array_equal(a.curve, b.curve) and np.array_equal(a.chain.weights, b.chain.weights)
