"""The Jaccard join against brute force, and the pipeline's stages against the operators' definitions."""

import random
import re
from collections import defaultdict

import pytest

from isobar.llm.components import components
from isobar.llm.jaccard import jaccard_groups, runs_for, survival

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def shingle_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(docs):
    classes = defaultdict(list)
    for i, (_, t) in enumerate(docs):
        classes[shingle_set(t)].append(i)
    sets = [s for s in classes if s]
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if len(x := sets[a] & sets[b]) * 1.8 >= 0.8 * (len(sets[a]) + len(sets[b])) - 1e-9 and x:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    groups = defaultdict(list)
    for a, s in enumerate(sets):
        groups[find(a)] += [docs[i][0] for i in classes[s]]
    least = {g: min((x for x in ids if x is not None), default=None) for g, ids in groups.items()}
    out = [(i, i, 0) for i, t in docs if not shingle_set(t)]
    return sorted([*out, *((docs[i][0], least[find(a)], links[a]) for a, s in enumerate(sets) for i in classes[s])], key=str)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(500)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs, base, passage = [], text(140), text(40)
    # More near copies than a block has sets, and so many that no splits tell them apart.
    for k in range(620):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        docs.append(" ".join(w))
    for k in range(60):
        docs.append(" ".join([*passage, *text(rng.randint(30, 60))]))
    for k in range(30):
        w = text(80)
        docs += [" ".join(w), " ".join(w), " ".join([*w, "more"]).upper(), " ".join([*w[:-8], *text(8)])]
    docs += ["", None, "...", "one", "one", "two words", "Two, words!", "a b c d e", "a b c d", "same " * 300, "same " * 9]
    rng.shuffle(docs)
    return [*enumerate(docs), (None, "one"), (None, "nothing like it " * 5), (3, docs[3]), (4, "another text with the same id")]


def test_groups(spark):
    docs = corpus()
    frame = spark.createDataFrame([(*r, "k", 1) for r in docs], "doc_id long, text string, key string, n int")
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in jaccard_groups(frame).collect()), key=str)
    assert got == brute(docs)
    assert max(n for *_, n in got) > 100


def test_recall_by_band(spark):
    """Pairs planted at similarities from the threshold on, hundreds in each band."""
    rng = random.Random(17)
    docs, planted = [], defaultdict(list)
    for band, low, high in (("0.80", 0.8, 0.82), ("0.85", 0.84, 0.86), ("0.90", 0.89, 0.92)):
        while len(planted[band]) < 300:
            words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(60, 200))]
            other = list(words)
            for at in rng.sample(range(len(words)), rng.randint(1, 5)):
                other[at] = f"v{rng.randrange(10**6)}"
            a, b = shingle_set(" ".join(words)), shingle_set(" ".join(other))
            if low <= len(a & b) / len(a | b) <= high:
                planted[band].append((len(docs), len(docs) + 1))
                docs += [(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))]
    docs += [(len(docs), "long " + " ".join(f"w{i}" for i in range(150_000))), (len(docs) + 1, "long " + " ".join(f"w{i}" for i in range(149_000)))]
    planted["long"].append((len(docs) - 2, len(docs) - 1))
    got = {r.doc_id: (r.class_id, r.n_links) for r in jaccard_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    recall = {band: sum(got[a] == got[b] == (a, 1) for a, b in pairs) / len(pairs) for band, pairs in planted.items()}
    assert min(recall.values()) >= 0.99, recall


def test_empty(spark):
    assert jaccard_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_runs_reach_the_recall():
    assert survival(0.8, 1, 0.25) == pytest.approx(0.84)
    assert (1 - survival(0.8, 4, 0.25)) ** runs_for(0.8, 0.999) <= 0.001


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 180)] + [(200, 200), (301, 300), (300, 302)]
    found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 180)}, 300: 300, 301: 300, 302: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = corpus()
    bench = " ".join(docs[10][1].split()[:12]) if docs[10][1] else "none of these words occur"
    rows = [(i, t, "en", "src", len(t or "")) for i, t in docs]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, int(i % 7 > 0)) for i in range(50)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = pipeline.join_near_copies(spark, frame, str(tmp_path)).collect()
    groups = brute(docs)
    worded = {c for i, c, _ in groups}
    assert len(kept) == len({(c) for i, c, _ in groups if c is not None}) + 1 and {r.doc_id for r in kept} <= worded
    clean = pipeline.decontaminate(spark, frame, str(tmp_path)).collect()
    grams = {tuple(bench.lower().split()[i : i + 10]) for i in range(3)}
    has = lambda t: any(tuple(w[i : i + 10]) in grams for w in [WORD.findall((t or "").lower())] for i in range(len(w) - 9))
    assert sorted(str(r.doc_id) for r in clean) == sorted(str(i) for i, t in docs if not has(t))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
    assert pipeline.STAGES[-1][1](spark, frame, str(tmp_path)).count() == len(docs)
    assert pipeline.decontaminate(spark, frame.limit(0), str(tmp_path)).count() == 0
