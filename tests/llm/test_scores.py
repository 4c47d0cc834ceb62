import numpy as np
import pytest

from parchmint.llm import classifier, language, rules


def test_classifier_separates_held_out_rows(spark):
    rng = np.random.default_rng(3)
    good, bad = [f"good{i} " for i in range(60)], [f"x#{i}% " for i in range(60)]
    rows = [(i, "".join(rng.choice(good if i % 3 else bad, 40)), 1 if i % 3 else 0) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(None, "a"), (900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(0, None), (None, 1), (3, 0)], "doc_id long, quality int")
    got = classifier.op1(docs, labels).collect()
    assert len(got) == 403
    told = {r.doc_id: r for r in got}
    held = [r for r in rows if told[r[0]].held_out]
    assert 50 < len(held) < 200 and np.mean([told[r[0]].predicted == r[2] for r in held]) > 0.95
    assert told[900].score == told[901].score == 0.5 and told[900].predicted == 0
    assert all(0 <= r.score <= 1 for r in got)


def test_classifier_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in classifier.op1(docs, none).collect()} == {0.5}
    assert classifier.op1(empty, none).count() == 0


def test_a_score_does_not_depend_on_neighbours():
    table = np.random.default_rng(0).normal(size=1 << classifier.BITS).astype(np.float32)
    texts = ["some words here", "", "other words", None, "x" * 5000]
    together = classifier.score(table, texts)
    assert np.allclose(together, [classifier.score(table, [t])[0] for t in texts])


def plain_features(text):
    """Words, pairs and character n-grams of a text, as they are defined."""
    import re

    words = re.findall(r"[^\x00\x09-\x0D\x20]+", text or "")
    grams = [f"\0{w}\0"[i : i + n] for w in words for n in classifier.GRAMS for i in range(len(w) + 3 - n)]
    return grams, words, list(zip(words, words[1:]))


def test_features_are_the_words_pairs_and_character_grams():
    rng = np.random.default_rng(1)
    texts = ["", None, "a", " \t", "ab cd\nab", "é😀x ü", "x" * 40] + ["".join(rng.choice(list("abé ü\t\n😀"), 60)) for _ in range(20)]
    counts = [[0] * len(texts) for _ in range(3)]
    hashes: dict = {}
    for kind, (bucket, doc) in enumerate(classifier.features(texts)):
        for d, n in zip(*np.unique(doc, return_counts=True)):
            counts[0 if kind < 3 else kind - 2][d] += n
    for d, t in enumerate(texts):
        assert [c[d] for c in counts] == list(map(len, plain_features(t)))
    # equal features have equal buckets, and different ones (almost all) different buckets, wherever they stand
    vocabulary = sorted({g for t in texts for g in plain_features(t)[0]})
    for g in vocabulary:
        n = len(g)
        word = g.strip("\0")
        if g.count("\0") == 2 and word:
            got = [b for k, (b, _) in enumerate(classifier.features(["q " + word + " q", word])) if k == classifier.GRAMS.index(n)]
            hashes[g] = int(got[0][-1])
    assert len(set(hashes.values())) >= 0.99 * len(hashes)


def test_score_is_that_of_averaged_vectors_and_a_softmax():
    rng = np.random.default_rng(2)
    vectors, layer = rng.normal(size=(1 << classifier.BITS, classifier.DIM)), rng.normal(size=(2, classifier.DIM))
    texts = ["one two three two", "é ü", "", "same same same"]
    folded = (vectors @ (layer[1] - layer[0])).astype(np.float32)
    for t, got in zip(texts, classifier.score(folded, texts)):
        buckets = np.concatenate([b for b, _ in classifier.features([t])]).astype(np.int64) if t else np.zeros(0, np.int64)
        mean = vectors[buckets].mean(axis=0) if len(buckets) else np.zeros(classifier.DIM)
        p = np.exp(layer @ mean)
        assert got == pytest.approx(p[1] / p.sum(), abs=1e-4)


def test_classifier_gradients_match_finite_differences():
    rng = np.random.default_rng(3)
    layer, mean = rng.normal(size=(2, 5)), rng.normal(size=5)

    def loss(layer, mean):
        x = layer @ mean
        return np.log(np.exp(x).sum()) - x[1]

    by_layer, by_mean = classifier.backward(mean, layer, 1)
    for k in range(5):
        step = np.eye(5)[k] * 1e-5
        assert by_mean[k] == pytest.approx((loss(layer, mean + step) - loss(layer, mean - step)) / 2e-5, abs=1e-6)
        for c in range(2):
            move = np.zeros((2, 5))
            move[c] = step
            assert by_layer[c, k] == pytest.approx((loss(layer + move, mean) - loss(layer - move, mean)) / 2e-5, abs=1e-6)


def test_classifier_sample_is_bounded_in_bytes_and_settles_ids_with_several_texts(spark):
    rows = [(i, "good " * 50 if i % 2 else "bad% " * 50) for i in range(60)] + [(1, "bad% " * 50), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    table = classifier.learn(docs, labels)
    assert (classifier.learn(docs.repartition(2), labels) == table).all() and table.any()
    assert classifier.learn(docs, labels, sample_bytes=1).any() and (classifier.learn(docs, labels, sample_bytes=1) != table).any()


def plain_recurrence(p, text, way):
    """The gated recurrent network, position by position."""
    h, out = np.zeros(language.HIDDEN), {}
    s = lambda x: 1 / (1 + np.exp(-x))
    for t in range(len(text)) if way == "f" else reversed(range(len(text))):
        c = text[t]
        z = s(p[f"xz{way}"][c] + h @ p[f"uz{way}"])
        r = s(p[f"xr{way}"][c] + h @ p[f"ur{way}"])
        n = np.tanh(p[f"xn{way}"][c] + r * (h @ p[f"un{way}"]))
        h = z * h + (1 - z) * n
        out[t] = h
    return np.array([out[t] for t in range(len(text))])


def test_the_network_is_that_of_its_definition():
    p = language.initial(3)
    texts = [b"plain words", "über é".encode(), b"x" * 300]
    for text, got in zip(texts, language.pooled(p, texts)):
        probs = []
        for a in range(0, len(text), language.SEGMENT):
            part = text[a : a + language.SEGMENT]
            logits = plain_recurrence(p, part, "f") @ p["of"] + plain_recurrence(p, part, "b") @ p["ob"] + p["bias"]
            e = np.exp(logits)
            probs.append(e / e.sum(axis=1, keepdims=True))
        assert np.allclose(np.concatenate(probs).mean(axis=0), got, atol=1e-4)


def test_every_language_is_learned_and_long_texts_and_other_columns_do_no_harm(spark):
    from pyspark.sql import functions as F

    names = [f"l{k:02d}" for k in range(70)]
    rows = [(i, f"{names[i % 70]} " * 30, names[i % 70]) for i in range(700)] + [(2000, "l05 " * 200_000, None), (5, "l05 " * 30, "l05")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"h": F.lit("x"), "raw": F.lit(1), "share": F.lit("s"), "pieces": F.lit(2)})
    found, net = language.learn(df)
    assert found == names and len(net["bias"]) == 70
    got = language.identify(df, found, net)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and got.count() == 702
    assert language.learn(df.repartition(7))[1]["bias"].tolist() == net["bias"].tolist()


def test_gradients_match_finite_differences():
    rng = np.random.default_rng(0)
    x = rng.integers(1, 256, (6, 4)).astype(np.uint8)
    x[5, 2] = 0
    y = np.array([0, 1, 2, 1])
    _, g = language.gradients(language.initial(3), x, y)
    for k in ("xzf", "unb", "urf", "of", "xrb", "bias"):
        at = tuple(np.unravel_index(np.abs(g[k]).argmax(), g[k].shape))
        ends = []
        for step in (0.01, -0.01):
            p = language.initial(3)
            p[k][at] += step
            ends.append(language.gradients(p, x, y)[0])
        assert g[k][at] == pytest.approx((ends[0] - ends[1]) / 0.02, rel=0.05)


def test_language_of_held_out_rows(spark):
    rng = np.random.default_rng(5)
    vocabulary = {"aa": ["the", "thing", "wh"], "bb": ["über", "sch", "ein"]}
    rows = [(i, " ".join(rng.choice(vocabulary[lang], 40)), lang) for i in range(200) for lang in [("aa", "bb")[i % 2]]]
    rows += [(500, None, "aa"), (501, "123 !!", "bb"), (502, "", None), (None, "the thing wh the", "aa")]
    got = language.op6(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    told = {r.doc_id: r for r in got}
    held = [r for r in rows[:200] if told[r[0]].held_out]
    assert np.mean([told[r[0]].lang_pred == r[2] for r in held]) > 0.95
    assert [told[i].lang_pred for i in (500, 501, 502)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 204


def test_language_of_nothing(empty):
    assert language.op6(empty).count() == 0


def test_pooling_does_not_depend_on_neighbours():
    p = language.initial(3)
    texts = [b"short", b"", b"long text " * 100, b"zero \0 byte"]
    together = language.pooled(p, texts)
    for t, row in zip(texts, together):
        assert np.allclose(language.pooled(p, [t])[0], row, atol=1e-5)


def brute_rules(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    hit = {j for ks in at.values() if len(ks) > 1 for k in ks for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


EXTRA = ["a\nb\na\n \n \nb", "x " * 30, "one two three four five six seven eight " * 3, "a\x1cb\x85c d e", "#| a <b> 5%\n\n\n"]


def test_rule_counts_match_brute_force(rows):
    for text in [r[1] for r in rows] + EXTRA:
        assert rules.measures(text)[:5] == brute_rules(text)


def test_rules_keep_prose_and_reject_junk(spark, docs, rows):
    junk = [(1000 + i, " ".join(f"a{i}b{k}%%%" for k in range(60)), "en", "s") for i in range(8)]
    from tests.llm.conftest import SCHEMA

    df = spark.createDataFrame(rows + junk, SCHEMA)
    got = rules.score_documents(df).collect()
    assert len(got) == len(rows) + 8
    told = {r.doc_id: r for r in got}
    assert not any(told[1000 + i].kept for i in range(8)) and all(told[i].kept for i in range(10, 30))
    assert told[2].base_failed and told[3].base_failed and told[2].n_words == 0
    kept = rules.keep_documents(df)
    assert kept.columns == df.columns
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(map(repr, (r.doc_id for r in got if r.kept)))


def test_rules_of_nothing(empty):
    assert rules.score_documents(empty).count() == 0 and rules.keep_documents(empty).count() == 0


def test_expectation_maximisation_finds_planted_accuracies():
    rng = np.random.default_rng(2)
    k, n = len(rules.RULES), 200_000
    good = rng.random(n) < 0.9
    right = np.linspace(0.75, 0.99, k)
    rates = {True: (right, 1 - right), False: (0.3 * np.ones(k), right - 0.3)}  # shares of g and of b; the rest abstains
    draw = rng.random((n, k))
    votes = np.where(draw < np.where(good[:, None], rates[True][0], rates[False][0]), "g", np.where(draw < np.where(good[:, None], 1.0, rates[False][0] + rates[False][1]), "b", "-"))
    counts: dict = {}
    for v in map("".join, votes):
        counts[v] = counts.get(v, 0) + 1
    model = rules.fit(counts)
    assert model.prior == pytest.approx(0.9, abs=0.03)
    for c, name in enumerate((True, False)):
        assert np.abs(model.rates[c, :, 0] - rates[name][0]).max() < 0.03 and np.abs(model.rates[c, :, 1] - rates[name][1]).max() < 0.03
    assert model.posterior["g" * k] > 0.95 and model.score("b" * k) < 0.05


def plain_fit(patterns, belief=100.0, rounds=200):
    """Expectation-maximisation, document class by document class, in plain Python."""
    k = len(rules.RULES)
    prior = rules.GOOD
    rates = [[dict(zip("gb-", row)) for _ in range(k)] for row in rules.BELIEF.tolist()]
    for step in range(rounds + 1):
        post = {}
        for p in patterns:
            a, b = prior, 1 - prior
            for r, v in enumerate(p):
                a, b = a * rates[0][r][v], b * rates[1][r][v]
            post[p] = a / (a + b)
        if step == rounds:
            return prior, post
        total = sum(patterns.values())
        prior = (sum(n * post[p] for p, n in patterns.items()) + belief * rules.GOOD) / (total + belief)
        for c in (0, 1):
            for r in range(k):
                sums = {v: belief * x for v, x in zip("gb-", rules.BELIEF[c].tolist())}
                for p, n in patterns.items():
                    sums[p[r]] += n * (post[p] if c == 0 else 1 - post[p])
                rates[c][r] = {v: x / sum(sums.values()) for v, x in sums.items()}
        for r in range(k):
            if rates[0][r]["b"] > rates[1][r]["b"]:
                mean = {v: (rates[0][r][v] + rates[1][r][v]) / 2 for v in "gb-"}
                rates[0][r] = rates[1][r] = mean


def test_expectation_maximisation_matches_plain_python():
    rng = np.random.default_rng(4)
    patterns = {"".join(rng.choice(list("ggggb-"), len(rules.RULES))): int(rng.integers(1, 400)) for _ in range(60)}
    prior, post = plain_fit(patterns)
    model = rules.fit(patterns)
    assert model.prior == pytest.approx(prior, abs=1e-3)
    assert all(model.posterior[p] == pytest.approx(post[p], abs=1e-3) for p in patterns)


def test_votes_and_verdicts_follow_from_measures(spark, rows):
    """Votes by their bounds, a verdict by the posterior of the pattern."""
    from tests.llm.conftest import SCHEMA

    got = rules.score_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    counted: dict = {}
    for r in got:
        if not r.base_failed:
            counted[r.votes] = counted.get(r.votes, 0) + 1
    _, post = plain_fit(counted)
    for r in got:
        failed = r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words
        assert r.base_failed == failed and r.kept == (not failed and post.get(r.votes, 0) >= 0.5)


def test_a_rule_votes_whatever_the_length():
    at = list(rules.RULES).index("variety")
    for n in (100, 1999, 2000, 50_000):
        junk = " ".join(f"w{k * k % 7}" for k in range(n))
        assert rules.vote(rules.measures(junk)[5])[at] == "b"
