from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash

from tidewatch.llm import pseudo_lm as lm


def test_log_probs_match_brute_force():
    net = lm.Network.start(3)
    docs = [np.array([1, 5, 200, 7], np.uint8), np.zeros(0, np.uint8), np.array([9], np.uint8)]
    padded, at, owner = lm.padded_tokens(docs)
    found = net.log_probs(padded, at)
    expected = []
    for d in docs:
        wide = [lm.EDGE] * lm.SIDE + d.tolist() + [lm.EDGE] * lm.SIDE
        for i in range(len(d)):
            hidden = net.bias.astype(float)
            for o, w in zip(lm.OFFSETS, net.layer, strict=True):
                hidden = hidden + net.embed[wide[i + lm.SIDE + o]].astype(float) @ w
            active, (branch, leaf) = np.tanh(hidden), divmod(int(d[i]), lm.TOKENS // lm.BRANCHES)
            top, inner = active @ net.top + net.top_bias, active @ net.leaf[branch] + net.leaf_bias[branch]
            expected.append(top[branch] - np.log(np.exp(top).sum()) + inner[leaf] - np.log(np.exp(inner).sum()))
    assert owner.tolist() == [0, 0, 0, 0, 2] and np.allclose(found, expected, atol=1e-4)


def test_gradient_steps_raise_the_likelihood():
    rng = np.random.default_rng(0)
    text = np.tile(np.array([3, 8, 100, 8, 40], np.uint8), 200)
    net = lm.Network.start()
    padded, at, _ = lm.padded_tokens([text])
    memory = [np.full_like(p, 1e-4) for p in net.parts]
    before = net.log_probs(padded, at).mean()
    for _ in range(40):
        net.learn(padded, rng.permutation(at)[:256], memory, 0.1)
    assert net.log_probs(padded, at).mean() > before + 3


def test_scores_tell_order_from_disorder(spark):
    """Documents of a fixed phrase score higher than the same words in another order."""
    rng = np.random.default_rng(1)
    phrase = "the cat sat on a mat and the dog ran to it".split()
    rows = [(i, " ".join(phrase * 40)) for i in range(40)]
    mixed = [(100 + i, " ".join(rng.permutation(phrase * 40))) for i in range(3)]
    scored = {r.doc_id: r for r in lm.score(spark.createDataFrame(rows + mixed, "doc_id long, text string").repartition(2), rounds=3).collect()}
    assert min(scored[i].mean_log_prob for i in range(40)) > max(scored[100 + i].mean_log_prob for i in range(3))
    assert all(abs(r.log_prob - r.n_tokens * r.mean_log_prob) < 1e-6 for r in scored.values())


def test_words_and_vocabulary(spark, table):
    assert lm.words_of(None) == [] and lm.words_of("The, (cat)  *** Ünd!") == ["the", "cat", "ünd"]
    docs = table("documents")
    counts = {}
    for r in docs.collect():
        for w in lm.words_of(r.text):
            counts[w] = counts.get(w, 0) + 1
    expected = sorted(counts, key=lambda w: (-counts[w], w))[:lm.WORDS]
    assert lm.vocabulary(docs) == expected
    known = lm.Vocabulary(expected)
    assert known.encode(f"{expected[3]} zzzunseen").tolist()[0] == 3 and known["zzzunseen"] >= lm.WORDS


def test_odd_rows(odd):
    rows = lm.score(odd, rounds=1).collect()
    assert len(rows) == odd.count()
    assert sorted(r.n_tokens for r in rows) == sorted(len(lm.words_of(r.text)) for r in odd.collect())
    for r in rows:
        assert (r.mean_log_prob is None) == (r.n_tokens == 0) and r.log_prob <= 0
    assert lm.score(odd.limit(0)).count() == 0


def test_words_outside_the_most_frequent_have_scores_of_their_own(spark):
    """The list grows with the corpus; a junk word scores below a listed one of its class in the same place."""
    texts = [" ".join(f"w{i:03d}tion" for i in range(300))] * 6 + ["the w250tion end", "the w299tion end", "the qqxztion end"] + ["the w250tion end"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known, gains = lm.lexicon(docs)
    assert gains is None
    counts = {}
    for t in texts:
        for w in lm.words_of(t):
            counts[w] = counts.get(w, 0) + 1
    listed = [w for w in counts if counts[w] >= lm.LEAST and w not in known.words]
    assert len(known.keys) == len(listed) > 100
    vocabulary = lm.Vocabulary(known.words, known.keys)
    ids = [vocabulary[w] for w in listed]
    assert vocabulary[listed[0].upper() + "!,"] == ids[0] and vocabulary["(*)"] == -1
    assert len(set(ids)) == len(ids) and min(ids) > lm.EDGE
    assert lm.Vocabulary(known.words, known.keys).encode(" ".join(listed)).tolist() == ids
    # the words of a class share its whole mass
    mass = np.zeros(lm.TOKENS)
    for w in counts:
        mass[known.classes[vocabulary[w]]] += np.exp(known.shares[vocabulary[w]])
    assert np.allclose(mass[mass > 0], 1)
    tail = [w for w in ("w298tion", "w299tion") if w not in known.words]
    assert tail and all(lm.ending(w) == lm.ending("qqxztion") for w in tail)
    scored = {r.doc_id: r.log_prob for r in lm.score(docs, rounds=1).collect()}
    assert scored[7] > scored[8]


def test_rounds_hide_every_token_once():
    owner = np.repeat([0, 2, 3, 4], [1, 9, 2, 17])
    for rounds in (1, 2, 3):
        turns = [lm.hidden(owner, t, rounds) for t in range(rounds)]
        assert (np.sum(turns, axis=0) == 1).all()
        assert all(turns[0][owner == d][0] for d in set(owner))
    assert not lm.hidden(np.zeros(0, int), 0, 2).size


def test_late_tokens_of_short_documents_are_learnt(spark):
    """Tokens that stand only from the third place on are predicted in training too."""
    docs = spark.createDataFrame([(i, "one two three four five six seven eight") for i in range(3000)], "doc_id long, text string")
    scored = lm.score(docs.coalesce(1)).limit(1).collect()
    assert scored[0].mean_log_prob > -0.5


def test_probabilities_of_all_classes_add_up_to_one():
    net = lm.Network.start(4)
    net.leaf_bias += np.random.default_rng(0).normal(size=net.leaf_bias.shape).astype(np.float32)
    padded = np.concatenate([np.array([lm.EDGE, 3, c, 250, lm.EDGE]) for c in range(lm.TOKENS)])
    assert np.isclose(np.exp(net.log_probs(padded, np.arange(lm.TOKENS) * 5 + 2)).sum(), 1, atol=1e-5)


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(1)
    net = lm.Network.start(2)
    padded, at, _ = lm.padded_tokens([rng.integers(0, lm.TOKENS, 40)])
    before = [p.astype(float).copy() for p in net.parts]
    memory = [np.full_like(p, 1.0) for p in net.parts]
    moved = lm.Network(*[p.copy() for p in net.parts])
    moved.learn(padded, at, memory, 1.0)  # the step is g / sqrt(1 + g * g)
    for k, old in enumerate(before):
        step = (old - moved.parts[k]).ravel()
        for i in np.argsort(-abs(step))[:4]:
            sides = []
            for sign in (1, -1):
                other = lm.Network(*[p.copy() for p in net.parts])
                other.parts[k].ravel()[i] += sign * 1e-2
                sides.append(-other.log_probs(padded, at).mean())
            g = (sides[0] - sides[1]) / 2e-2
            assert np.isclose(step[i], g / np.sqrt(1 + g * g), rtol=0.05, atol=2e-4), (k, i)


def test_words_that_are_not_broadcast_have_the_same_shares(spark, table):
    docs = table("documents").coalesce(1)
    whole = {r.doc_id: r.log_prob for r in lm.score(docs, rounds=1).collect()}
    for most in (400, 0):
        known, gains = lm.lexicon(docs, shared_words=most)
        assert known.least > lm.LEAST and len(known.keys) <= most and gains.count() > 0
        for r in lm.score(docs, rounds=1, shared_words=most).collect():
            assert np.isclose(r.log_prob, whole[r.doc_id], rtol=1e-4, atol=1e-2)


def test_words_and_classes_of_a_batch_are_those_of_each_word():
    """Arrow splits, lowers and trims as Python does, also beyond ASCII and at unusual blanks; a text's tokens do not hang on its neighbours."""
    blanks = [" ", "\n", "\t", "\x0b", "\x1c", "\x1f", "\x85", "\xa0", " ", " ", " ", "　"]
    texts = ["".join(f"Straße,{b}İSTANBUL!{b}(ΟΔΟΣ){b}*{b}Ab\U0001f600{b}the THE \"the\"" for b in blanks), None, "", " \n", "... !", "the Ab", "​x\x00y z"]
    known = lm.Vocabulary(["the", "straße"])
    read = known.read(pa.array(texts, pa.string()))
    for text, (ids, rare) in zip(texts, read, strict=True):
        words = lm.words_of(text)
        expected = [{"the": 0, "straße": 1}.get(w, lm.ending(w)) for w in words]
        assert ids.tolist() == expected == known.encode(text).tolist()
        hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words if w not in ("the", "straße")]
        assert rare.view(np.uint64).tolist() == hashes


def test_counts_of_words_are_those_of_python(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED_WORDS", 20)
    texts = [None, "", "!", *[" ".join(f"W{i % k}, w{i}É (İ{i % 3})" for i in range(60)) for k in (2, 7, 50)]] * 3
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    expected = Counter(w for t in texts for w in lm.words_of(t))
    found = {(r.word, r["class"]): r.n for r in lm.word_counts(docs).collect()}
    assert found == {(w, lm.ending(w)): n for w, n in expected.items()}
    assert lm.word_counts(spark.createDataFrame([(None,), ("..",)], "text string")).count() == 0


def test_a_distinct_chunk_is_looked_up_once_a_batch(monkeypatch):
    seen = []
    learn = lm.Vocabulary.learn
    monkeypatch.setattr(lm.Vocabulary, "learn", lambda self, chunks: seen.append(len(chunks)) or learn(self, chunks))
    lm.Vocabulary(["the"]).read(pa.array(["the end of the day"] * 1000))
    assert seen == [4]


def test_softmax_folds_short_rows_as_numpy_adds_them():
    rng = np.random.default_rng(2)
    for width in (1, 3, 6, 16):
        logits = rng.normal(0, 30, (50, width)).astype(np.float32)
        assert np.array_equal(lm._across(np.maximum, logits), logits.max(axis=1, keepdims=True))
        assert np.allclose(lm._across(np.add, logits), logits.sum(axis=1, keepdims=True), atol=1e-4)
        got, plain = lm._softmax(logits.copy()), np.exp(logits.astype(float) - logits.max(axis=1, keepdims=True))
        assert np.allclose(got, plain / plain.sum(axis=1, keepdims=True), atol=1e-6)
        assert np.array_equal(lm._softmax(logits[::-1].copy())[::-1], got)
    assert np.array_equal(lm._across(np.add, logits), logits.sum(axis=1, keepdims=True))
