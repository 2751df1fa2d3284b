"""Line dedup and substring dedup against brute force."""

import os
import random
import re

import pytest

from isobar.llm.lines import drop_boilerplate
from isobar.llm.queries import ORACLES, QUERIES
from isobar.llm.substrings import remove_repeats
from oracle import SF, differences

LONG = "one two three four five six"
DOCS = [
    (1, f"{LONG}\nalpha\n\n{LONG}", "a"), (2, f"  One  TWO three\tfour five six \nbeta beta", "a"), (3, "", "a"), (4, None, "b"), (5, f"{LONG}", None), (6, "\n\n", "b"), (7, f"x{LONG}\r\n{LONG}\r", "b"),
    (8, "same same same same same", "b"), (8, "same same same same same", "b"), (8, "other text under that id\n" + LONG, "a"), (None, LONG + "\nno id here at all ok", "a"), (9, "É é É é É\né É é É é", "a"), (10, "word " * 30_000 + "\n" + "line of five words here\n" * 500, "c"),
]


def frame(spark, rows=DOCS):
    return spark.createDataFrame([(*r, "k", 7) for r in rows], "doc_id long, text string, source string, kept string, n_dropped int")


UNSPACED = "[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u2e80-\u2fff\u3004-\ufeff\uff10-\U0010ffff]"


def units_of(text):
    """(start, end, number of words, normalised words) of each unit, by a plain loop."""
    out, now, line = [], [], None
    lines = [m.start() for m in re.finditer("\n", text)]
    for m in re.finditer(f"{UNSPACED}|[^\t-\r {UNSPACED[1:-1]}]+", text):
        word = re.sub("[A-Z]", lambda x: x[0].lower(), m[0])
        number = sum(x < m.start() for x in lines) if len(lines) < 99 else text.count("\n", 0, m.start())
        if now and (number != line or len(now) == 12):
            out.append(now)
            now = []
        line = number
        now.append((m.start(), m.end(), word))
        if sum(map(ord, word)) % 8 == 0 or word[-1] in ".!?。！？":
            out.append(now)
            now = []
    out += [now] if now else []
    return [(u[0][0], u[-1][1], len(u), " ".join(w for *_, w in u)) for u in out]


def brute_repeats(docs):
    import hashlib

    key = lambda t: hashlib.md5(b"" if t is None else b"t" + t.encode()).digest()
    seen, want = set(), []
    for i, t in sorted(((i, t) for i, t, *_ in docs), key=lambda r: (r[0] is None, r[0] or 0, key(r[1]))):
        units = units_of(t or "")
        again = []
        for *_, norm in units:
            again.append(norm in seen)
            seen.add(norm)
        spans, n, at = [], 0, 0
        while at < len(units):
            stop = at
            while stop < len(units) and again[stop]:
                stop += 1
            if sum(u[2] for u in units[at:stop]) >= 25:
                spans.append((units[at][0], units[stop - 1][1]))
                n += stop - at
            at = stop + 1
        left, since = "", 0
        for x, y in spans:
            left, since = left + t[since:x], y
        want.append((i, len(units), n, spans, t if t is None else left + t[since:]))
    return sorted(want, key=str)


def got_repeats(df):
    return sorted(((a, b, c, [tuple(s) for s in d], e) for a, b, c, d, e in df.collect()), key=str)


def test_repeats(spark):
    assert got_repeats(remove_repeats(frame(spark))) == brute_repeats(DOCS)


def test_passages_within_lines(spark):
    """Passages that begin and end within lines, of 51 words and more, in texts of their own."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) + rng.choice([*[""] * 9, ".", ",", "!"])
    text = lambda n: [word() + (rng.choice("\n\n  \t") if rng.random() < 0.05 else " ") for _ in range(n)]
    docs, planted = [], set()
    for k in range(40):
        passage = text(51 + k)
        for copy in range(2 + k % 3):
            own = text(rng.randint(60, 200))
            at = rng.randrange(len(own))
            docs.append((len(docs), "".join([*own[:at], *passage, *own[at:]]), "s"))
            if copy:
                planted.add(len(docs) - 1)
    docs += [(1000 + k, "".join(text(90)) + "\nAll rights reserved by nobody at all.\nRead on here.", "s") for k in range(60)]
    got = got_repeats(remove_repeats(frame(spark, docs)))
    assert got == brute_repeats(docs)
    caught = {i for i, _, n, *_ in got if n}
    assert len(planted & caught) / len(planted) > 0.97 and not caught - planted


def test_rows_that_repeat_an_id_and_a_text(spark):
    long = " ".join(f"word{i}" for i in range(60))
    docs = [(1, long, "a"), (1, long, "a"), (1, long, "a"), (2, f"own start {long}", "a"), (3, "short", "a"), (3, "short", "a"), (None, long, "b"), (None, long, "b"), (4, None, "b"), (4, None, "b")]
    got = got_repeats(remove_repeats(frame(spark, docs)))
    assert got == brute_repeats(docs)
    assert sorted(t for i, *_, t in got if i == 1) == ["", "", long]


def test_doubling_strings_are_no_repeats(spark):
    def doubled(word, n):
        while len(word) < n:
            word = word.replace("a", "x").replace("b", "ba").replace("x", "ab")
        return word

    docs = [(k, " ".join(doubled(x, 1024) + str(j) for j in range(40)), "a") for k, x in enumerate("ab")]
    assert all(r.n_removed == 0 for r in remove_repeats(frame(spark, docs)).collect())


def test_boilerplate(spark):
    rows = [(i, f"Foot  er\nline {i} of its own\n  shared by few" if i < 2 else f" Foot  er \nown {i}\nown {i}\n", "h") for i in range(20)]
    rows += [(100 + i, "Foot  er", None) for i in range(9)] + [(200 + i, "rare\nrare", "small") for i in range(4)] + [(250, "alone", "single")] + [(300, None, "h"), (301, "", "h")]
    got = {r.doc_id: r for r in drop_boilerplate(frame(spark, rows), max_ratio=0.5).collect()}
    assert got[0].text == "line 0 of its own\n  shared by few" and (got[0].n_lines, got[0].n_dropped) == (3, 1)
    assert got[5].text == "own 5\nown 5\n" and (got[5].n_lines, got[5].n_dropped) == (3, 1)
    assert got[100].text == "Foot  er" and got[200].text == ""
    assert got[250].text == "alone" and got[250].n_dropped == 0
    assert got[300].text is None and got[301].text == "" and got[300].n_lines == got[301].n_lines == 0
    assert len(got) == len(rows) and got[3].kept == "k"
    assert drop_boilerplate(frame(spark, rows), max_ratio=0.5).columns == ["doc_id", "text", "source", "kept", "n_lines", "n_dropped"]


def test_repeats_in_unspaced_scripts(spark):
    lines = ["版权所有翻印必究。未经许可不得转载本页的任何部分", "すべての権利を保有する", "สงวนลิขสิทธิ์ทุกประการ", "全角　空白の行"]
    rows = [(i, "\n".join([f"own words of text {i}", *lines, "再见"]), "h") for i in range(2)]
    got = {r.doc_id: r for r in remove_repeats(frame(spark, rows)).collect()}
    assert got[0].n_removed == 0 and got[1].n_removed > 9 and got[1].text == "own words of text 1\n"
    assert got_repeats(remove_repeats(frame(spark, rows))) == brute_repeats(rows)


def test_small_hosts(spark):
    """The ratio decides for hosts of few pages; a line on one page is never boilerplate."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, f"foot\nown {i}", "four") for i in range(4)] + [(10 + i, f"foot\nown {i}" if i < 2 else f"own {i}", "thirty") for i in range(30)] + [(50, "all\nall", "one")]
    docs = spark.createDataFrame([(*r, "en", 5) for r in rows], "doc_id long, text string, source string, lang string, n_chars long")
    got = {r.doc_id: r.text for r in pipeline.dedup_lines(spark, docs, "").collect()}
    assert [got[i] for i in range(4)] == [f"own {i}" for i in range(4)] and got[10] == "foot\nown 0" and got[50] == "all\nall"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are absent")
def test_oracle_where_lines_are_dropped(spark):
    query = QUERIES["op4_line_dedup"]
    assert query(spark, SF).where("n_dropped > 0").count() > 0
    assert differences(spark, query, ORACLES["op4_line_dedup"]) == []


def test_empty(spark):
    assert remove_repeats(frame(spark, [])).count() == 0
    assert drop_boilerplate(frame(spark, [])).count() == 0
