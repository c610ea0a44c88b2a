"""The learner against plain Python: one weight at a time, dictionaries, no arrays."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import language as lang


def softmax(scores):
    top = max(scores)
    e = [math.exp(s - top) for s in scores]
    return [x / sum(e) for x in e]


def plain_ftrl(rows, classes):
    """FTRL-proximal with elastic net: ``rows`` of (label, {term: value}); gives {(term, class): weight}."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(key):
        if abs(z[key]) <= lang.L1:
            return 0.0
        return -(z[key] - math.copysign(lang.L1, z[key])) / ((lang.BETA + math.sqrt(n[key])) / lang.ALPHA + lang.L2)

    for _ in range(lang.EPOCHS):
        for label, values in rows:
            x = {**values, lang.FEATURES: 1.0}
            w = {(t, c): weight((t, c)) for t in x for c in range(classes)}
            chances = softmax([sum(v * w[t, c] for t, v in x.items()) for c in range(classes)])
            for t, v in x.items():
                for c in range(classes):
                    g = v * (chances[c] - (c == label))
                    sigma = (math.sqrt(n[t, c] + g * g) - math.sqrt(n[t, c])) / lang.ALPHA
                    z[t, c] += g - sigma * w[t, c]
                    n[t, c] += g * g
    return {key: weight(key) for key in list(z)}


@pytest.mark.parametrize("classes", [1, 2, 4])
def test_a_shard_is_plain_ftrl(classes):
    rng = random.Random(classes)
    rows = []
    for _ in range(40):
        label = rng.randrange(classes)
        terms = sorted(rng.sample(range(8 * label, 8 * label + 30), rng.randint(1, 9)))
        rows.append((label, {t: rng.random() for t in terms}))
    arrays = [(np.array(list(x), np.int32), np.array(list(x.values()))) for _, x in rows]
    found = lang.fit_shard(np.array([label for label, _ in rows]), arrays, classes)
    wanted = np.zeros_like(found)
    for (t, c), w in plain_ftrl(rows, classes).items():
        wanted[t, c] = w
    assert np.allclose(found, wanted, rtol=1e-9, atol=1e-12)
    assert classes == 1 or ((wanted == 0).any() and (wanted != 0).any())


def tf_idf(text, idf):
    terms, counts = lang.term_counts(text.encode())
    values = {int(t): (1 + math.log(c)) * idf[t] for t, c in zip(terms, counts)}
    norm = math.sqrt(sum(v * v for v in values.values()))
    return {t: v / norm for t, v in values.items()}


def documents(rng, n):
    said = {"aa": "ba be bi bo bu", "bb": "ba ka ke ki xo", "cc": "öl ül ba äl xo"}
    out = []
    for k in range(n):
        name = rng.choice(list(said))
        out.append((k, " ".join(rng.choice(said[name].split()) for _ in range(rng.randint(1, 12))), name))
    return out


def test_training_is_plain_training(spark, monkeypatch):
    monkeypatch.setattr(lang, "TRAIN_PER_CLASS", 30)  # of about 60 a language, so that the sample is one
    monkeypatch.setattr(lang, "CALIBRATE_PER_CLASS", 20)
    rows = documents(random.Random(8), 240) + [(None, "ba be", "aa"), (900, None, "aa"), (901, "ba", None), (902, "12 !", "bb"), (903, "", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = lang.train(docs)

    deals = {r["doc_id"]: r["deal"] for r in docs.select("doc_id", F.xxhash64(F.lit("language"), "doc_id").alias("deal")).collect()}
    held = {r["doc_id"] for r in docs.where(lang.held_out()).collect()}
    known = [(deals[i], t, g) for i, t, g in rows if i is not None and i not in held and t is not None and g is not None]
    names = sorted({g for *_, g in known})
    lettered = [t for _, t, _ in known if lang.term_counts(t.encode())]
    seen = Counter(int(term) for t in lettered for term in lang.term_counts(t.encode())[0])
    idf = [math.log((1 + len(lettered)) / (1 + seen[t])) + 1 for t in range(lang.FEATURES)]
    per_class, sizes = 50, Counter(g for *_, g in known)
    placed = [(deal, t, g, deal % (1 << 30) / (1 << 30) / min(1.0, per_class / sizes[g])) for deal, t, g in known]
    sample = [p for p in placed if p[3] < 1 and lang.term_counts(p[1].encode())]
    assert model.languages == names and len(sample) < len(known)

    weights = defaultdict(float)
    for shard in range(lang.SHARDS):
        mine = sorted((deal, names.index(g), t) for deal, t, g, place in sample if place < 30 / 50 and deal % lang.SHARDS == shard)
        for key, w in plain_ftrl([(label, tf_idf(t, idf)) for _, label, t in mine], len(names)).items():
            weights[key] += w / lang.SHARDS
    for (t, c), w in weights.items():
        assert model.weights[t, c] == pytest.approx(w, rel=1e-6, abs=1e-9)

    def loss(temperature):
        total = 0.0
        for _, t, g, place in sample:
            if place >= 30 / 50:
                x = {**tf_idf(t, idf), lang.FEATURES: 1.0}
                scores = [sum(v * weights[term, c] for term, v in x.items()) / temperature for c in range(len(names))]
                total -= math.log(max(softmax(scores)[names.index(g)], 1e-12))
        return round(total, 6)

    assert model.temperature == min(lang.TEMPERATURES, key=lambda t: (loss(t), t))


def test_few_documents_ties_and_none(spark):
    one = lang.train(spark.createDataFrame([(1, "ba be", "aa"), (3, "12", "bb")], "doc_id long, text string, lang string"))
    assert one.languages == ["aa", "bb"] and one.predict(b"ba be")[0] == "aa"  # three of four shards are empty, and bb has no letters
    none = lang.train(spark.createDataFrame([(None, "ba", "aa"), (1, None, "aa"), (3, "x", None)], "doc_id long, text string, lang string"))
    assert none.languages == [] and none.predict(b"ba") == ("und", 0.0)
    tied = lang.Model(["aa", "bb"], np.ones(lang.FEATURES), np.zeros((lang.FEATURES + 1, 2)))
    assert tied.predict(b"x") == ("aa", 0.5)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, told string")
    assert empty.select(lang.predicted(one)).collect() == [] and lang.keep_identified(empty).collect() == []
