import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tidemill.llm import langid, toxicity
from tidemill.llm import vectext as V
from tidemill.llm.queries import op8_toxicity, op9_language_id

SF = "/root/testdata/sf0.01"
RECALL = 0.88


def test_em_finds_proportions():
    rng = np.random.default_rng(0)
    p = rng.dirichlet(np.ones(300) * 0.1, 3).T + 1e-6
    p /= p.sum(axis=0)
    c = rng.multinomial(4000, p @ np.array([0.7, 0.3, 0.0])).astype(float)
    chosen, pi, _ = langid.infer(p, c)
    assert set(chosen) == {0, 1} and abs(pi[chosen.index(0)] - 0.7) < 0.06
    chosen, pi, _ = langid.infer(p, rng.multinomial(4000, p[:, 2]).astype(float))
    assert chosen == [2] and pi[0] == 1


def test_em_never_lowers_the_likelihood():
    rng = np.random.default_rng(1)
    p, c = rng.dirichlet(np.ones(50), 4).T, rng.integers(0, 9, 50).astype(float)
    last = -np.inf
    for rounds in range(1, 9):
        _, ll = langid.proportions(p, c, rounds)
        assert ll >= last - 1e-9
        last = ll


def test_language_of_odd_rows(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = frame([(-1, None), (-2, ""), (-3, "12 !? 34"), (-4, "a"), (-5, "한국어"), (-6, "the " * 100000), (None, "der die das und nicht")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd.selectExpr("*", "1 as score", "2 as lang_pred"), docs).collect()}
    assert len(got) == 7 and all(got[i].lang_pred == "und" and got[i].score == 0 for i in (-1, -2, -3))
    assert all(got[i].lang_pred in ("en", "de", "es", "fr") and 0 <= got[i].score <= 1 for i in (-4, -5, -6, None))
    assert got[None].lang_pred == "de" and got[None].languages == ["de"]
    assert langid.identify(odd.limit(0), docs).collect() == []
    assert {r.lang_pred for r in langid.identify(odd, docs.limit(0)).collect()} == {"und"}


def test_language_accuracy_on_held_out_rows(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    rows = [r for r in op9_language_id(spark, SF).collect() if r.held_out]
    assert len(rows) > 150 and np.mean([truth[r.doc_id] == r.lang_pred for r in rows]) > 0.98


def planted(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]
    rows = []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        bad = rng.random() < 0.2
        for _ in range(4 if bad else 0):
            w.insert(rng.randrange(len(w)), rng.choice(["zwurmb", "QUAXXY", "vilbog"]))
        rows.append((i, " ".join(w), int(bad)))
    return rows


def test_toxicity_on_planted_words(frame):
    rows = planted(900, 4)
    docs, labels = frame([(i, t) for i, t, _ in rows], "doc_id long, text string"), frame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert len(held) > 100 and np.mean([r.predicted == y for r, y in held]) > 0.98
    assert all(r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_of_odd_rows(frame):
    docs = frame([(1, None, 3, "x"), (2, "", 4, "y"), (None, "z", 5, "z"), (3, "long " * 200000, 6, "")], "doc_id long, text string, score int, predicted string")
    none = frame([], "doc_id long, toxic int")
    assert {r.predicted for r in toxicity.toxicity(docs, none).collect()} == {0}
    assert {r.predicted for r in toxicity.toxicity(docs, frame([(1, 1), (3, 1), (2, 1)], "doc_id long, toxic int")).collect()} <= {0, 1}
    assert toxicity.toxicity(docs.limit(0), none).collect() == []


def test_scores_do_not_depend_on_batches(frame):
    rows = planted(200, 5)
    m = toxicity.fit(frame([(i, t, y) for i, t, y in rows], "id long, text string, label int"))
    texts = pa.array([t for _, t, _ in rows])
    whole = m.scores(texts)
    assert np.allclose(whole, np.concatenate([m.scores(texts.slice(i, 7)) for i in range(0, 200, 7)]))


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def bucket(gram: bytes, bits: int) -> int:
    return int(V.ngrams(np.frombuffer(gram, np.uint8), np.array([0, len(gram)]), len(gram), bits)[0][0])


def test_toxicity_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    known: dict = {}

    def present(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        grams = {raw[k : k + n] for n in toxicity.SIZES for k in range(len(raw) - n + 1)}
        for g in grams - known.keys():
            known[g] = bucket(g, toxicity.BITS)
        return {known[g] for g in grams}

    learn = sorted(i for i in labels if i in docs and not held(i))
    y = np.array([labels[i] for i in learn], float)
    sets = [present(docs[i]) for i in learn]
    n, share = [Counter(g for s, v in zip(sets, y, strict=True) if v == k for g in s) for k in (0, 1)], y.mean()
    z = {}
    for g in {*n[0], *n[1]}:
        seen = n[0][g] + n[1][g]
        if seen >= 4:
            z[g] = (n[1][g] - share * seen) / math.sqrt(share * (1 - share) * seen + 1.0)
    best = sorted(sorted((g for g in z if z[g] != 0), key=lambda g: (-abs(z[g]), g))[: toxicity.FEATURES])
    r = [math.log((n[1][g] + 1) / (1 + y.sum()) / ((n[0][g] + 1) / (1 + len(y) - y.sum()))) for g in best]
    pairs = [(k, f) for k, s in enumerate(sets) for f, g in enumerate(best, 1) if g in s]
    scale = np.array([0.0, *r])
    cols = np.array([f for _, f in pairs])
    w, b = toxicity._logistic(np.array([k for k, _ in pairs]), (cols, scale[cols]), len(y), len(scale), y)
    got = {x.doc_id: x for x in op8_toxicity(spark, sf).collect()}
    assert got.keys() == docs.keys()
    for i, text in docs.items():
        s = present(text)
        want = 1 / (1 + math.exp(-(b + sum(w[f] * scale[f] for f, g in enumerate(best, 1) if g in s))))
        assert abs(got[i].score - want) < 1e-3 and got[i].held_out == held(i) and got[i].predicted == int(got[i].score >= 0.5), i


def test_language_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: (r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    known: dict = {}

    def grams(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
        raw = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in raw)
        out = Counter()
        for k in range(len(raw) - 2):
            g = raw[k : k + 3]
            out[known.setdefault(g, bucket(g, langid.BITS))] += 1
        out.pop(bucket(b"   ", langid.BITS), None)
        return out

    names = sorted({lang for i, (_, lang) in docs.items() if not held(i) and lang is not None})
    total = {x: Counter() for x in names}
    for i, (text, lang) in docs.items():
        if lang is not None and not held(i):
            total[lang] += grams(text)
    smooth = langid.SMOOTH * 1e-2
    mass = {x: sum(total[x].values()) + smooth * 2**langid.BITS for x in names}
    p = lambda g, x: (total[x][g] + smooth) / mass[x]

    def em(c, some):
        pi = [1 / len(some)] * len(some)
        for _ in range(langid.ROUNDS):
            new = [0.0] * len(some)
            for g, n in c.items():
                parts = [a * p(g, x) for a, x in zip(pi, some, strict=True)]
                for k, v in enumerate(parts):
                    new[k] += n * v / sum(parts)
            pi = [v / sum(c.values()) for v in new]
        return pi, sum(n * math.log(sum(a * p(g, x) for a, x in zip(pi, some, strict=True))) for g, n in c.items())

    got = {r.doc_id: r for r in op9_language_id(spark, sf).collect()}
    for i, (text, _) in docs.items():
        c = grams(text)
        if not any(ch.isalpha() for ch in text or ""):
            assert got[i].lang_pred == "und" and got[i].score == 0
            continue
        alone = {x: sum(n * math.log(p(g, x)) for g, n in c.items()) for x in names}
        some = [max(names, key=lambda x: (alone[x], -names.index(x)))]
        pi, best = [1.0], alone[some[0]]
        while len(some) < len(names):
            q, ll, x = max(((*em(c, [*some, x]), x) for x in names if x not in some), key=lambda t: t[1])
            if ll - best <= langid.PENALTY * math.log(sum(c.values()) + 1):
                break
            some, pi, best = [*some, x], q, ll
        first = max(range(len(some)), key=lambda k: pi[k])
        n = sum(c.values())
        posterior = 1 / (1 + sum(math.exp(min(700, alone[x] - alone[some[first]])) for x in names if x not in some))
        want = posterior * (pi[first] * n + 1) / (n + len(names))
        assert got[i].lang_pred == some[first] and abs(got[i].score - want) < 1e-6 and set(got[i].languages) == set(some), i


def test_samples_are_bounded_and_even(frame):
    from tidemill.llm.labelled import sample_texts

    rows = [(i, f"t{i}", "common" if i % 50 else "rare") for i in range(1000)] + [(3, "t3 again", "common"), (None, "x", "rare"), (7, "z", None)]
    docs = frame(rows, "doc_id long, text string, lang string")
    got = sample_texts(docs, docs, "lang", 40, True).collect()
    count = Counter(r.label for r in got)
    assert len(got) == len({r.id for r in got}) <= 40 and count["common"] == 20 and count["rare"] >= 13
    assert not any(held(r.id) for r in got)
    assert len(sample_texts(docs, docs, "lang", 40).collect()) <= 40


def test_short_texts_are_uncertain(spark, frame):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    some = docs.filter("lang = 'de'").orderBy("doc_id").first().text
    got = {r.doc_id: r.score for r in langid.identify(frame([(1, "a"), (2, some[:30]), (3, some)], "doc_id long, text string"), docs).collect()}
    assert got[1] < 0.6 and got[1] < got[2] < got[3] < 1


def test_toxicity_on_labels(spark):
    """Texts labelled toxic without any of the words that mark the others (some nine of a hundred) cannot be found: recall is near its bound."""
    truth = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()}
    rows = [r for r in op8_toxicity(spark, "/root/testdata/sf0.1").collect() if r.held_out and r.doc_id in truth]
    hit = [r.score for r in rows if truth[r.doc_id]]
    clean = [r.score for r in rows if not truth[r.doc_id]]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in hit for b in clean])
    recall, wrong = np.mean([a >= 0.5 for a in hit]), np.mean([b >= 0.5 for b in clean])
    print(f"toxicity: recall {recall:.3f} of {len(hit)}, clean called toxic {wrong:.4f} of {len(clean)}, area {auc:.3f}")
    assert auc > 0.94 and recall > RECALL and wrong < 0.02
