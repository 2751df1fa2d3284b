"""Classifiers by held-out accuracy, quality rules against brute force."""

import functools
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.llm import language, perplexity, quality
from isobar.llm.queries import op3_quality_classifier, op8_quality_rules, op9_language_id
from isobar.llm.textarrays import Texts

SF = "/root/testdata/sf0.01"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are absent")
ODD = [None, "", " \n\t", "x", "1 2 3 !!", "word " * 40_000, "日本語 のテキスト", "a b c a b c a b c\n\na b c\nx\n x\nx", "# * $ % & | < >\x0b\x0c", "é è é è é è", "x", "one two"]


def brute_base(text):
    text = text or ""
    words = text.encode().split()
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.encode().split():
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), dup, len(inside)


def test_base_counts():
    counts = perplexity.base_counts(Texts(pa.array(ODD)))
    got = list(zip(*[counts[k].tolist() for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]))
    assert got == [brute_base(t) for t in ODD]


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), re.sub("[0-9]", "0", re.sub("[\t-\r]", " ", text or "")))


def brute_model(texts, order=perplexity.ORDER):
    """The levels of the model as plain dictionaries, and the probability of an n-gram, with or without one of its occurrences."""
    pad = "\0" * (order - 1)
    grams = lambda t: [x[i : i + order] for x in [pad + folded(t)] for i in range(len(x) - order + 1)]
    n = {order: Counter(g for t in texts for g in grams(t))}
    for k in range(order - 1, 0, -1):
        n[k] = Counter(g[1:] for g in n[k + 1])
    follow = {k: {} for k in n}
    for k, level in n.items():
        for g, c in level.items():
            follow[k].setdefault(g[:-1], Counter())[g] = c
    d = {k: perplexity.discounts([sum(c == j for c in level.values()) for j in (1, 2, 3, 4)]) for k, level in n.items()}

    def probability(g, left):
        k = len(g)
        if not k:
            return 1 / (len(n[1]) + 1)
        own = Counter(follow[k].get(g[:-1], {}))
        gone = left and own[g] == 1
        if left and own[g]:
            own[g] -= 1
        own = +own
        lower = probability(g[1:], gone)
        total = sum(own.values())
        if not total:
            return lower
        return max(own[g] - d[k][min(own[g], 3)], 0) / total + sum(d[k][min(c, 3)] for c in own.values()) / total * lower

    return grams, n[order], probability


def code_of(g):
    c = [0 if x == "\0" else ord(x) + 1 for x in g]
    return c[0] << 21 | c[1], c[2] << 42 | c[3] << 21 | c[4]


PROSE = ["the cat sat on the mat", "The Cat sat on 12 mats\tand 3 hats", "a dog and a cat", "die Katze saß auf der Matte", "日本語のテキスト 日本語", "κάτι άλλο κάτι", "", None, "the cat sat on the mat", "zzz zzz zzz"]


def test_kneser_ney_equals_its_definition(spark):
    docs = spark.createDataFrame([(t,) for t in PROSE], "text string")
    grams, counted, probability = brute_model(PROSE)
    model = perplexity.fit(docs)
    assert {(r.a, r.b): r.n for r in model.grams.collect()} == {code_of(g): c for g, c in counted.items()}
    got = {(r.a, r.b): r for r in perplexity.probabilities(model.grams).collect()}
    assert len(got) == len(counted)
    for g in counted:
        assert got[code_of(g)].p == pytest.approx(probability(g, False)) and got[code_of(g)].q == pytest.approx(probability(g, True))
    # Over every character, met or not, the probabilities after a context sum up to one.
    some = {x for g in counted for x in g} - {"\0"}
    for context in ("the ", " cat", "zzz ", "\0\0\0\0"):
        assert sum(probability(context + x, False) for x in some) + probability(context + "\ue000", False) == pytest.approx(1)
    # N-grams that were not counted have probabilities too.
    other = ["the cap sat", "новый"]
    apart = perplexity.steps(model, spark.createDataFrame([(t,) for t in other], "text string"), "text").collect()
    found = {(r.a, r.b): r.s for r in apart}
    for g in {g for t in other for g in grams(t)} - set(counted):
        assert abs(found[code_of(g)] + round(np.log(probability(g, False)) * 1024)) <= 1


def brute_judge(docs):
    """(kept, log_perplexity) by doc_id from (doc_id, lang, text)."""
    grams, _, probability = brute_model([t for *_, t in docs])
    cost = functools.cache(lambda g: round(-np.log(probability(g, True)) * 1024))
    unspaced = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3004-\ufeff\uff10-\U0010ffff]"
    per_word, measure = {}, {}
    for i, _, t in docs:
        words = len(re.findall(f"{unspaced}|[^\t-\r {unspaced[1:-1]}]+", t or ""))
        per_word[i] = sum(map(cost, grams(t))) / 1024 / words if words else None
        measure[i] = np.log(max(per_word[i], 1e-3)) if words else None

    def quartiles(rows):
        steps = sorted(round(x * 1024) for x in rows)
        return [steps[-(-len(steps) * q // 4) - 1] / 1024 for q in (1, 3)]

    everything = quartiles([x for x in measure.values() if x is not None])
    kept = {}
    for i, lang, t in docs:
        own = [measure[j] for j, k, _ in docs if k == lang and lang is not None and measure[j] is not None]
        q1, q3 = ((len(own) * x + 50 * y) / (len(own) + 50) for x, y in zip(quartiles(own), everything)) if own else everything
        reach = 3 * max(q3 - q1, 0.02)
        n, *_, again = brute_base(t)
        kept[i] = not (n < 50 or 100 * again > 50 * n) and q1 - reach <= measure[i] <= q3 + reach
    return kept, per_word


def test_verdicts_equal_brute_force(spark):
    rng = np.random.default_rng(11)
    text = lambda letters, n: " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(n))
    docs = [(i, "en", text("etaoinsh", 60 + i % 40)) for i in range(40)] + [(100 + i, "el", text("αβγδεζη", 70)) for i in range(8)] + [(200 + i, "zh", text("日本語漢字仮名", 60)) for i in range(5)]
    strange = "".join(map(chr, range(0x1200, 0x1680)))
    docs += [(300, "en", text(strange, 80)), (301, "el", " ".join(strange[i : i + 30] for i in range(0, 1100, 20))), (302, None, text("etaoinsh", 55)), (303, "en", text("e", 60)), (304, "xx", docs[0][2]), (305, "en", docs[1][2]), (306, "en", docs[1][2])]
    docs += [(400 + i, [None, "en"][i % 2], t) for i, t in enumerate([*ODD[:5], *ODD[6:]])]
    kept, per_word = brute_judge(docs)
    frame = spark.createDataFrame([(*r, 1, 2) for r in docs], "doc_id long, lang string, text string, kept int, total int")
    for limit in (perplexity.MODEL_BYTES, 0):
        got = {r.doc_id: r for r in perplexity.judge_quality(frame, model_bytes=limit).collect()}
        assert {i: r.kept for i, r in got.items()} == kept
        for i, r in got.items():
            assert r.log_perplexity == (None if per_word[i] is None else pytest.approx(per_word[i], abs=2e-2))
    assert not kept[301] and kept[302] and sum(kept.values()) > 40


def test_rules(spark):
    clean = [(i, "en", " ".join(f"{a}{b}" for a in ("the", "an", "of", "er", "th") for b in ("re", "in", "on", "es", "at", "nd", "is", "ou", str(i), "ed", "le"))) for i in range(60)]
    rows = clean + [(100 + i, None if i % 2 else "xx", t) for i, t in enumerate(ODD)] + [(300, "en", " ".join("".join(np.random.default_rng(i).choice(list("qxzjkvwy&%$ßç7"), 5)) for i in range(60)))]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, lang string, text string, kept int")
    got = {r.doc_id: r for r in perplexity.judge_quality(docs, perplexity.fit(docs.where("doc_id < 200"))).collect()}
    assert len(got) == len(rows) and all(got[i].kept for i in range(60))
    assert not got[300].kept and not got[300].base_failed
    assert got[100].log_perplexity is None and not got[100].kept and got[105].base_failed
    assert perplexity.judge_quality(docs.limit(0), perplexity.fit(docs.limit(0))).count() == 0


def test_order_of_words(spark):
    """Shuffled words and one repeated letter have the characters of a good text, but not its pairs of words."""
    rng = np.random.default_rng(7)
    follow = rng.integers(0, 120, (120, 5))

    def walk(word, n=150):
        out, k = [], int(rng.integers(120))
        for _ in range(n):
            out.append(word(k))
            k = int(follow[k, rng.integers(5)])
        return out

    latin = lambda k: "".join("aeioubdgklmnprst"[(k * 7 + j * j * (k + 3)) % 16] for j in range(3 + k % 5)) + "xyz"[k % 3]
    greek = lambda k: "".join(chr(0x3B1 + (k * 7 + j * j * (k + 3)) % 16) for j in range(3 + k % 5)) + chr(0x3C3 + k % 3)
    rows = [(i, "en", " ".join(walk(latin))) for i in range(120)] + [(200 + i, "el", " ".join(walk(greek))) for i in range(120)]
    mixed = walk(latin)
    rng.shuffle(mixed)
    rows += [(500, "en", " ".join(mixed)), (501, "el", " ".join("α" * len(x) for x in walk(greek)) + " β")]
    wild = walk(greek)
    rng.shuffle(wild)
    rows += [(502, "el", " ".join(wild)), (503, "en", "")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    got = {r.doc_id: r for r in perplexity.judge_quality(docs, perplexity.fit(docs)).collect()}
    assert len(got) == len(rows) and np.mean([got[i].kept for i in [*range(120), *range(200, 320)]]) > 0.98
    assert not any(got[i].kept for i in (500, 501, 502, 503)) and not got[500].base_failed and not got[502].base_failed
    assert got[503].log_perplexity is None
    # Texts that were not counted are judged by those that were.
    other = {r.doc_id: r.log_perplexity for r in perplexity.judge_quality(docs, perplexity.fit(docs.where("doc_id < 200"))).collect()}
    assert other[5] < other[210] and other[503] is None


@tables
def test_quality_held_out(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op3_quality_classifier(spark, SF)
    assert got.count() == 1000
    held = got.join(labels, "doc_id").where("held_out").toPandas()
    assert (held.predicted == held.quality).mean() > 0.97 and held.score.between(0, 1).all()


@tables
def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = op9_language_id(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (held.lang_pred == held.lang).mean() > 0.97 and held.score.between(0, 1).all()


@tables
def test_rules_keep_good_documents(spark):
    held = op8_quality_rules(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert held[held.quality == 1].kept.mean() > 0.99
    assert held[held.quality == 0].kept.mean() < 0.5


def test_quality_scores_equal_plain_votes(spark):
    """Scores worked out anew from the labelled vectors, a document and a neighbour at a time."""
    rng = np.random.default_rng(3)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(rng.integers(1, 40)))
    docs = [(i, text("etaoinsh" if i % 2 else "qxzjk&%$")) for i in range(90)] + [(100 + i, t) for i, t in enumerate(ODD)] + [(7, "two texts of one id"), (8, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 60)] + [(0, 1), (0, 1), (103, 0), (105, 1), (100, 0)], "doc_id long, quality int")
    model = quality.fit(frame, labels, F.lit(True))

    def terms(t):
        t, out = re.sub("[0-9]", "0", t or ""), np.zeros(quality.TERMS)
        for x, y, z in zip(t, t[1:], t[2:]):
            code = (ord(x) * 0x85EBCA6B ^ ord(y) * 0xC2B2AE35 ^ ord(z) * 0x27D4EB2F) & 0xFFFFFFFF
            code = ((code ^ code >> 15) * 0x2C1B3C6D) & 0xFFFFFFFF
            out[(code >> 12) % (quality.TERMS - quality.MARKS)] += 1
        return out

    def score(t):
        t = t or ""
        counts, words = terms(t), t.encode().split()
        for k in range(1, quality.MARKS + 1):
            counts[-k] = 8 * sum(x == y for x, y in zip(words, words[k:]))
        x = np.sqrt(counts / max(counts.sum(), 1))
        z = ((x - model.mean) * model.scale) @ model.directions
        z = z / max(np.linalg.norm(z), 1e-12)
        near = sorted(((float(v @ z), i) for i, v in enumerate(model.vectors)), reverse=True)[: quality.NEIGHBOURS]
        weights = [max(c, 1e-3) ** quality.SHARPNESS * model.stands_for[i] for c, i in near]
        vote = sum(w * model.y[i] for w, (_, i) in zip(weights, near)) / sum(weights)
        return (len(t) * vote + quality.EVIDENCE * model.prior) / (len(t) + quality.EVIDENCE)

    got = [(r.doc_id, r.text, r.score) for r in quality.score_quality(frame, model).collect()]
    assert len(got) == len(docs) and all(s == pytest.approx(score(t), abs=2e-4) for _, t, s in got)


def test_predicted_languages_equal_plain_kernels(spark):
    rng = np.random.default_rng(4)
    text = lambda letters: " ".join("".join(rng.choice(list(letters), rng.integers(2, 7))) for _ in range(rng.integers(1, 30)))
    docs = [(i, text(["abcdef", "defghi", "αβγδ"][i % 3]), ["x", "y", "el"][i % 3]) for i in range(60)] + [(100 + i, t, None) for i, t in enumerate(ODD)] + [(200, "abc def", "x"), (200, "abc def", "x"), (201, "Éa ÉA", "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = language.fit(frame, F.lit(True))

    def grams(t):
        t = re.sub("[^\\w]|[\\d_]", " ", (t or ""))
        t = re.sub(" +", " ", "".join(c.lower()[0] if c.isalpha() else " " for c in t))
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    def code(g):
        out = 0
        for c in g:
            out = out << 21 | (1 if c == " " else ord(c) + 1)
        return out

    # A landmark's column holds the root of its number of n-grams at each of its own.
    columns = [{int(c) for c in model.grams[model.landmarks[:, k] > 0]} for k in range(model.landmarks.shape[1])]
    for r in language.predict_language(frame, model, keep=("doc_id", "text")).collect():
        own = {code(g) for g in grams(r.text)}
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0)
            continue
        kernel = np.array([len(own & c) / np.sqrt(len(own) * len(c)) for c in columns])
        out = kernel @ model.weights + model.bias
        e = np.exp(language.STEEPNESS * (out - out.max()))
        assert r.lang_pred == model.languages[int(out.argmax())] and r.score == pytest.approx(e.max() / e.sum(), abs=1e-3)


def test_odd_texts(spark):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "fr", 5) for i, t in enumerate(ODD)] + [(None, "no id", None, 5)], "doc_id long, text string, lang string, score int")
    labels = spark.createDataFrame([(3, 1), (5, 0), (5, None), (77, 1), (None, 1)], "doc_id long, quality int")
    scored = quality.score_quality(docs, quality.fit(docs, labels, F.lit(True))).collect()
    assert len(scored) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in scored) and scored[0].score == 0.5
    none = quality.fit(docs, labels.limit(0), F.lit(True))
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    found = {r.doc_id: r for r in language.predict_language(docs, language.fit(docs, F.lit(True))).collect()}
    assert [found[i].lang_pred for i in (0, 1, 2, 4, 8)] == ["und"] * 5 and found[3].lang_pred in ("en", "fr")
    nothing = language.fit(docs, F.lit(False))
    assert {r.lang_pred for r in language.predict_language(docs, nothing).collect()} == {"und"}
    assert language.predict_language(docs.limit(0), nothing).count() == 0 and quality.score_quality(docs.limit(0), none).count() == 0
