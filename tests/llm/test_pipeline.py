"""Every stage of the pipeline against plain loops, on texts of all kinds and under names that clash."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")

from pyspark.sql import functions as F  # noqa: E402

from isobar.llm import quality  # noqa: E402

CLASHES = ["rows", "n", "own_tie", "tie", "n_lines", "n_dropped", "quality_score", "score", "key", "class_id", "own_id", "host", "dropped", "kept", "c0", "copy", "label", "hot_key", "salt"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES)


def corpus():
    rng = random.Random(9)
    good = lambda n: " ".join("".join(rng.choice("etaoinshrd") for _ in range(rng.randint(2, 8))) for _ in range(n))
    bad = lambda n: " ".join("".join(rng.choice("qxzjk%&$#") for _ in range(rng.randint(2, 8))) for _ in range(n))
    texts = [good(rng.randint(60, 120)) for _ in range(30)] + [bad(80) for _ in range(30)]
    texts = [t + ("\nAll rights reserved\n" if i % 3 == 0 else "\n") + good(9) for i, t in enumerate(texts)]
    texts += [texts[0], texts[1] + " more", None, "", " \n\t", "one", "one", "日本語 のテキスト 👍", "same " * 40_000, "\n" * 500, "x\n  x \nx"]
    rows = [(i, t, "en", "st"[i % 2]) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "t"), (3, "another text under that id", None, None), (None, good(70), "en", "s"), (None, None, "en", "single")]
    return [(*r, 5, *[f"{c}{k}" for c in CLASHES]) for k, r in enumerate(rows)]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    rows = corpus()
    bench = [(1, " ".join(rows[4][1].split()[5:20])), (2, "nowhere to be found at all in any of these texts"), (None, rows[5][1]), (3, None), (1, "x y z")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(7, 0), (999, 1), (8, None)], "doc_id long, quality int").write.parquet(f"{d}/labels.parquet")
    return d, rows, spark.createDataFrame(rows, SCHEMA)


def same(got, rows, columns):
    assert sorted(map(tuple, got), key=str) == sorted(rows, key=str)
    assert got[0].__fields__ == columns if got else True


def test_classifier(spark, given):
    d, rows, docs = given
    kept = pipeline.classify_quality(spark, docs, d)
    model = quality.fit(docs, spark.read.parquet(f"{d}/labels.parquet"), F.lit(True))
    score = {(r.doc_id, r.text): r.score for r in quality.score_quality(docs.select("doc_id", "text"), model).collect()}
    same(kept.collect(), [r for r in rows if score[r[:2]] >= 0.5], docs.columns)
    found = {r.doc_id for r in kept.collect()}
    assert set(range(30)) - found <= {7} and not found & set(range(31, 60))


def test_lines(spark, given):
    d, rows, docs = given
    pages, count = Counter(r[3] for r in rows), defaultdict(Counter)
    for _, t, _, source, *_ in rows:
        count[source].update({x.strip(" ") for x in (t or "").split("\n") if x.strip(" ")})
    want = []
    for i, t, lang, source, _, *rest in rows:
        if t is not None and source is not None:
            t = "\n".join(x for x in t.split("\n") if not x.strip(" ") or count[source][x.strip(" ")] < 2 or count[source][x.strip(" ")] <= 0.08 * pages[source])
        want.append((i, t, lang, source, None if t is None else len(t), *rest))
    got = pipeline.dedup_lines(spark, docs, d).collect()
    same(got, want, docs.columns)
    assert any("All rights" in (r[1] or "") for r in rows) and not any("All rights" in (r.text or "") for r in got)


def test_near_copies(spark, given):
    from test_jaccard import shingle_set

    d, rows, docs = given
    got = pipeline.join_near_copies(spark, docs, d).collect()
    groups = []
    for s in {shingle_set(r[1]) for r in rows} - {frozenset()}:
        near = [g for g in groups if any(len(s & o) >= 0.8 * len(s | o) for o in g)]
        groups = [g for g in groups if g not in near] + [[s, *(o for g in near for o in g)]]
    worded = [r for r in got if shingle_set(r.text)]
    assert len(worded) == len(groups) < len([r for r in rows if shingle_set(r[1])])
    for g in groups:
        own = [r for r in worded if shingle_set(r.text) in g]
        assert [r.doc_id for r in own] == [min((r[0] for r in rows if shingle_set(r[1]) in g), key=lambda i: (i is None, i))]
    assert sorted([tuple(r) for r in got if not shingle_set(r.text)], key=str) == sorted([r for r in rows if not shingle_set(r[1])], key=str)
    assert {tuple(r) for r in got} <= set(rows) and got[0].__fields__ == docs.columns


def test_decontamination(spark, given):
    from test_native import brute

    d, rows, docs = given
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    got = pipeline.decontaminate(spark, docs, d).collect()
    same(got, [r for r in rows if not brute(r[1], items)[1]], docs.columns)
    assert len(got) < len(rows)


def test_encoding(spark, given):
    from tokenizers import Tokenizer

    d, rows, docs = given
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t, *_ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    same(pipeline.encode(spark, docs, d).collect(), want, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def test_empty_tables(spark, given):
    d, _, docs = given
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs.limit(0), d)
        assert out.count() == 0 and out.columns == docs.columns
    assert pipeline.encode(spark, docs.limit(0), d).count() == 0


def test_whole_run(spark, given):
    d, rows, docs = given
    docs.write.mode("overwrite").parquet(f"{d}/documents.parquet")
    found = pipeline.run(spark, d).collect()
    assert 20 < len(found) < len(rows) and not {r.doc_id for r in found} & set(range(31, 60))
    assert not re.search("[A-Z]", "".join(r.ids_sha256 for r in found))
