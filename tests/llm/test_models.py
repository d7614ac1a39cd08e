"""Quality, toxicity, language and rules: odd rows, and accuracy on texts held out."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtext.llm import langid, quality, rules, toxicity

from .conftest import ODD, table

_r = random.Random(5)
_WORDS = ["".join(_r.choice("bdfgklmnprst") + _r.choice("aeiou") for _ in range(_r.randint(1, 4))) for _ in range(600)]


def prose(r, n):
    w = [r.choice(_WORDS) for _ in range(n)]
    return ". ".join(" ".join(w[i : i + 9]).capitalize() for i in range(0, n, 9)) + "."


@pytest.fixture(scope="module")
def corpus(spark):
    r, docs, labels = random.Random(1), [], []
    for i in range(600):
        t = prose(r, r.randint(8, 120))
        bad, toxic = i % 5 == 0, i % 7 == 0
        if bad:
            t = " ".join(x + "***" for x in t.split()) if i % 2 else t.upper().replace(".", "!!")
        if toxic:
            w = t.split()
            for _ in range(2 + len(w) // 40):
                w.insert(r.randrange(len(w)), r.choice(["zorgle", "blarfed"]))
            t = " ".join(w)
        docs.append((i, t, "en"))
        labels.append((i, int(not bad), int(toxic)))
    return table(spark, docs).persist(), spark.createDataFrame(labels, "doc_id LONG, quality INT, toxic INT").persist()


def accuracy(out, labels, column, threshold, held):
    j = out.join(labels, "doc_id").where(held)
    return j.agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col(column)).cast("double"))).first()[0]


def test_quality(spark, corpus, odd, nothing, labels):
    docs, known = corpus
    held = F.col("doc_id") % 4 == 2
    m = quality.fit(docs, known, learn=~held)
    assert accuracy(quality.score(docs, m), known, "quality", 0.7, held) > 0.95
    assert m.weight.tolist() == quality.fit(docs.repartition(5), known, learn=~held).weight.tolist()
    assert quality.score(odd, m).count() == len(ODD)
    assert all(0 <= r.score <= 1 for r in quality.score(odd, m).collect())
    assert quality.score(nothing, m).count() == 0
    assert quality.keep(odd, m).columns == odd.columns
    one = quality.fit(nothing, labels)
    assert {round(r.score, 6) for r in quality.score(odd, one).collect()} == {0.5}


def test_hinge_model_separates():
    import numpy as np

    rows = [(np.array([0]), np.array([1.0])), (np.array([1]), np.array([1.0]))] * 5
    w = quality.dual_coordinate_descent(rows, np.array([1.0, -1.0] * 5), np.full(10, 5.0), 2)
    assert w[0] + w[2] >= 0.99 and w[1] + w[2] <= -0.99


def test_quality_indicators_and_ratios():
    """Indicators by plain sets, log-count ratios by plain counts, and a fit that long gradient descent doesn't better."""
    import numpy as np
    import pyarrow as pa

    from loomtext.llm import _text as T

    r = random.Random(4)
    texts = ["", None, "a", "Ab ab", "x x y", "naïve ☃\t!", *(" ".join(r.choice(["aa", "b", "C", "dd!", "é", "***"][i % 2 :]) for _ in range(r.randint(1, 30))) for i in range(60))]
    raw, off = T.texts(pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"]), "text")
    got = quality.indicators(raw, off)

    def hashed(word):
        b = np.frombuffer(word.encode(), np.uint8)
        return T.word_hashes(b, np.array([0, len(b)]), fold=False)[0]

    bucket = lambda x: int(quality._bucket(np.atleast_1d(np.asarray(x, np.uint64)))[0])
    for t, x in zip(texts, got, strict=True):
        raw_text, w = (t or "").encode(), re.findall(r"[^\x20\x09-\x0D]+", t or "")
        want = {bucket(int.from_bytes(raw_text[i : i + n], "little") + (n << 32)) for n in (1, 2, 3) for i in range(len(raw_text) - n + 1)}
        want |= {bucket(hashed(a)) for a in w} | {bucket(hashed(a) * T._ODD[0] + hashed(b) * T._ODD[1]) for a, b in zip(w, w[1:], strict=False)}
        want |= {quality.SIZE - 1} if any(a == b for a, b in zip(w, w[1:], strict=False)) else set()
        assert set(x.tolist()) == want and len(x) == len(want)
    rows, y = [np.sort(x) for x in got[3:]], [i % 2 for i in range(len(got) - 3)]
    m = quality.fit_rows(rows, y)
    used = [i for i in range(len(rows)) if i % 5 != 4]
    n = {c: collections.Counter(int(k) for i in used if y[i] == c for k in rows[i]) for c in (0, 1)}
    total = {c: sum(n[c].values()) + quality.PRIOR * quality.SIZE for c in (0, 1)}
    for k in {int(k) for i in used for k in rows[i]}:
        ratio = math.log((n[1][k] + quality.PRIOR) / total[1]) - math.log((n[0][k] + quality.PRIOR) / total[0])
        assert m.square[k] == pytest.approx(ratio**2, rel=1e-4, abs=1e-9)
    x = np.random.default_rng(1).normal(size=(80, 5))
    sign = np.where(x[:, 0] + 0.5 * x[:, 1] + 0.3 * np.random.default_rng(2).normal(size=80) > 0, 1.0, -1.0)
    loss = lambda w: 0.5 * w @ w + np.maximum(0, 1 - sign * (x @ w[:-1] + w[-1])).sum()
    w = quality.dual_coordinate_descent([(np.arange(5), v) for v in x], sign, np.ones(80), 5, epochs=300)
    best, v = np.inf, np.zeros(6)
    for i in range(4000):
        wrong = sign * (x @ v[:-1] + v[-1]) < 1
        v = v - (v - np.append((sign[wrong, None] * x[wrong]).sum(0), sign[wrong].sum())) / (i + 10)
        best = min(best, loss(v))
    assert loss(w) <= best + 1e-2


def test_quality_rows_as_steps():
    """Steps lose no bucket, however wide; a fit on them is the fit on plain rows, and holds no further copy of its rows."""
    import tracemalloc

    r = np.random.default_rng(3)
    plain = [np.zeros(0, np.int64), np.array([0]), np.array([0, 1, quality.SIZE - 1]), np.array([65534]), np.array([65535, 131070]), np.array([131071, 2 * 65535 + 65536])]
    for x in plain:
        assert quality.Unfolded([quality.steps(x)])[0].tolist() == x.tolist()
    rows = [np.unique(r.integers(0, quality.SIZE, 20_000)).astype(np.int32) for _ in range(1_000)]
    y = [i % 2 for i in range(len(rows))]
    folded = quality.Unfolded([quality.steps(x) for x in rows])
    assert all((a == b).all() for a, b in zip(rows, folded, strict=True))
    m = quality.fit_rows(plain + rows[:200], [0, 1, 0, 1, 0, 1] + y[:200])
    n = quality.fit_rows(quality.Unfolded([quality.steps(x) for x in plain + rows[:200]]), [0, 1, 0, 1, 0, 1] + y[:200])
    assert (m.weight == n.weight).all() and (m.square == n.square).all() and (m.bias, m.slope, m.shift) == (n.bias, n.slope, n.shift)
    tracemalloc.start()
    quality.fit_rows(folded, y)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * sum(map(len, rows))


def test_driver_gives_memory_back(spark, monkeypatch):
    """After every table that is written out; where the JVM has no such command, nothing fails."""
    from loomtext.llm import _util

    told = []
    assert _util.trim_driver(spark) in (True, False)
    monkeypatch.setattr(_util, "trim_driver", lambda s: told.append(s))
    assert _util.materialize(spark.range(3), "three").count() == 3 and len(told) == 1


def test_toxicity(spark, corpus, odd, nothing, labels):
    docs, known = corpus
    held = F.col("doc_id") % 5 == 0
    m = toxicity.fit(docs, known, learn=~held)
    out = toxicity.score(docs, m)
    assert accuracy(out, known, "toxic", 0.5, held) > 0.95
    assert toxicity.score(odd, m).count() == len(ODD) and toxicity.score(nothing, m).count() == 0
    flat = toxicity.fit(nothing, labels)
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, flat).collect())


def test_languages(spark, odd, nothing):
    texts = {"en": "the quick thing with other words of this kind ", "de": "der schnelle fuchs und die anderen wörter ", "fr": "le chat et les autres mots de cette sorte "}
    r = random.Random(2)
    rows = [(i, " ".join(r.choice(texts[x].split()) for _ in range(30)), x) for i, x in enumerate(["en", "de", "fr"] * 20)]
    docs = table(spark, rows)
    p = langid.fit(docs, learn=F.col("doc_id") % 3 != 1)
    assert p.languages == ["en", "fr"]  # the middle language was held out whole
    p = langid.fit(docs, learn=F.col("doc_id") >= 9)
    got = {r.doc_id: r for r in langid.predict(docs, p).collect()}
    assert sum(got[i].lang_pred == x for i, _, x in rows) >= 59
    found = langid.predict(odd, p).collect()
    assert len(found) == len(ODD)
    assert all(x.lang_pred == "und" and x.score == 0 for x in found if x.doc_id in (1, 2, 3))
    assert langid.predict(nothing, p).count() == 0
    assert langid.predict(odd, langid.fit(nothing)).where("lang_pred <> 'und'").count() == 0


def test_profile_ties_and_codes():
    assert langid.codes("!! 12").tolist() == []
    a = langid.profile("ab")
    assert len(a) == 2 + 3 + 2 and langid.codes("A b").tolist() == langid.codes("a -- B").tolist()


def _base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    c = collections.Counter(zip(w, w[1:], w[2:]))
    cov = {j + d for j in range(len(w) - 2) if c[tuple(w[j : j + 3])] > 1 for d in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(cov)


def test_rules(spark, corpus, odd, nothing, labels):
    texts = ["a b c d\na b c d\n\n# x", "x " * 60, "p q r p q r", "one two\x0bthree", "* | < > & % $ #"]
    d = odd.unionByName(table(spark, [(100 + i, t, "en") for i, t in enumerate(texts)]))
    out = rules.verdicts(d, labels)
    want = collections.Counter((r.doc_id, *_base(r.text)) for r in d.collect())
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect())
    assert got == want
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) for r in out.collect())
    assert rules.verdicts(nothing, labels).count() == 0
    docs, known = corpus
    v = rules.verdicts(docs, known).where("NOT base_failed").join(known, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert dict(map(tuple, v)) == {1: 1.0, 0: 0.0}


def test_fold_is_crc32_of_the_text_of_the_id(spark):
    from loomtext.llm._util import crc_mod

    d = spark.range(50).select("id", crc_mod(F.col("id"), 4).alias("m")).collect()
    assert all(r.m == zlib.crc32(str(r.id).encode()) % 4 for r in d)


def _kneser_ney(texts, share):
    """The models of toxicity.py by dictionaries: a function from a text to its difference."""
    cut = lambda t: re.findall(r"[^\x00-@\[-`{-\x7f]+", "".join(c.lower() if c < "\x80" else c for c in t or ""))
    pairs = lambda t: list(zip(["", *cut(t)], cut(t)))
    triples = lambda t: list(zip(["", "", *cut(t)], ["", *cut(t)], cut(t)))
    k = [collections.Counter(w for _, w in {p for t, y in texts if y == c for p in pairs(t)}) for c in (0, 1)]
    n = [collections.Counter(p for t, y in texts if y == c for p in set(pairs(t))) for c in (0, 1)]
    behind = collections.Counter((h, w) for _, h, w in {x for t, y in texts if y == 1 for x in triples(t)})
    own = {p for p, m in behind.items() if m >= toxicity.LEAST}
    kinds = len(k[0]) + len(k[1])
    d, total = toxicity.DISCOUNT, [sum(k[c].values()) for c in (0, 1)]
    rest = [1 - sum(max(k[c][w] - d, 0) for w in k[1]) / total[c] for c in (0, 1)]
    p = lambda c, w: (max(k[c][w] - d, 0) / total[c] if w in k[1] else 0) + rest[c] * max((w in k[0]) + (w in k[1]), 1) / (kinds + 1)
    follow = [collections.Counter() for _ in range(2)]
    spent = [collections.Counter() for _ in range(2)]
    for c in (0, 1):
        for (h, w), m in n[c].items():
            follow[c][h] += m
            if (h, w) in own:
                spent[c][h] += max(m - d, 0)

    def conditional(c, h, w):
        t = follow[c][h] if h in {x for x, _ in own} else 0
        return (max(n[c][h, w] - d, 0) / t if t and (h, w) in own else 0) + (1 - spent[c][h] / t if t else 1) * p(c, w)

    def excess(tau):
        z = [(p(1, w), p(0, w)) for w in k[1]]
        return sum(a - math.exp(tau) * b for a, b in z if math.floor(math.log(a / b) * toxicity._STEPS) >= round(tau * toxicity._STEPS)) - math.exp(tau) * share / (1 - share)

    tau = next(i / toxicity._STEPS for i in range(10_000) if excess(i / toxicity._STEPS) <= 0)
    vocabulary = [*k[0], *(w for w in k[1] if w not in k[0])]
    for c in (0, 1):  # the models sum to one, the unknown word included
        assert sum(p(c, w) for w in [*vocabulary, "no such word"]) == pytest.approx(1)
        for h in list({x for x, _ in own})[:5]:
            assert sum(conditional(c, h, w) for w in [*vocabulary, "no such word"]) == pytest.approx(1)
    unit = lambda x: round(x * toxicity.UNIT)

    def difference(t):
        x = [max(unit(math.log(conditional(1, h, w) / conditional(0, h, w))) - unit(tau), 0) if w in k[1] else 0 for h, w in pairs(t)]
        return sum(x) / toxicity.UNIT / len(x) + math.log(1 - share) if x else 0.0

    return difference, len(own)


@pytest.mark.parametrize("share, sent", [(0.01, None), (0.01, 5), (0.3, None), (0.9, 5)])
def test_toxicity_equals_its_formulas(spark, monkeypatch, share, sent):
    """Every text's difference against dictionaries, whole and with the tables sent in slices."""
    r = random.Random(9)
    words = [f"{a}{b}" for a in "bdfgk" for b in "aeiou"]
    texts = []
    for i in range(120):
        y = int(i % 4 == 0)
        w = [r.choice(words[: 9 + i % 16]) for _ in range(r.randint(0, 30))]
        for _ in range(3 * y):
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice([["Zorg"], ["you", "blarf"], ["you", "Ünd"]])
        texts.append((" ".join(w) + "." * (i % 3), y))
    docs = table(spark, [(i, t, "en") for i, (t, _) in enumerate(texts)]).repartition(3)
    known = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id LONG, toxic INT")
    m = toxicity.fit(docs, known, share=share)
    if sent:
        monkeypatch.setattr(toxicity, "SENT", sent)
        m = toxicity.fit(docs, known, share=share)
        assert m.slices() > 1
    difference, own = _kneser_ney(texts, share)
    assert own and m.grams.count() == own
    got = {x.k: x.x for x in toxicity._differences(docs.select(F.col("doc_id").alias("k"), "text"), m, "long", False).collect()}
    for i, (t, _) in enumerate(texts):
        assert got[i] == pytest.approx(difference(t), abs=1e-5), t


def _rows_made(plan, node):
    """Rows that the plan's nodes of a name have made, of a plan that has run."""
    name = plan.nodeName()
    below = [plan.executedPlan()] if name == "AdaptiveSparkPlan" else [plan.plan()] if "QueryStage" in name else [plan.children().apply(i) for i in range(plan.children().size())]
    own = [plan.metrics().apply("pythonNumRowsReceived").value()] if name == node else []
    return own + [n for p in below for n in _rows_made(p, node)]


@pytest.mark.parametrize("history", [False, True])
def test_toxicity_counts_in_the_task(spark, history):
    """Every key is in every chunk of the texts; a task sends one block for all, and the counts are those of a dictionary."""
    r = random.Random(4)
    texts = [[f"{chr(97 + r.randrange(20))}{chr(97 + r.randrange(5))}" for _ in range(8000)] + ["zz"] * (i % 3) for i in range(120)]
    rows = [(" ".join(w), i % 4) for i, w in enumerate(texts)]
    docs = spark.createDataFrame(rows, "text STRING, kind BYTE").repartition(2).persist()
    hashes = {}
    for w in sorted({x for t in texts for x in t}):
        off = np.array([0, 2 * len(w) + 1])
        _, before, pair, _ = toxicity.bigrams(np.frombuffer(f"{w} {w}".encode(), np.uint8), off)
        hashes[w] = int(before[1]) if history else int(pair[1])
    want = {}
    for i, t in enumerate(texts):
        for a, b in {(a, b) for a, b in zip(t, t[1:], strict=False) if history or a == b}:
            want.setdefault(hashes[a], [0] * 4)[i % 4] += 1
    out = toxicity._text_counts(docs, spark.createDataFrame([(k,) for k in hashes.values()], "key LONG"), history)
    assert {x.key: [x.n0, x.n1, x.n2, x.n3] for x in out.collect()} == want
    made = _rows_made(out._jdf.queryExecution().executedPlan(), "MapInArrow")
    assert len(hashes) > 90 and min(made) <= 2 and sum(made) <= len(hashes) + 2
    docs.unpersist()


def test_toxicity_keeps_words_apart(spark, corpus, monkeypatch):
    """A word that shares the first 21 hash bits with a toxic one, and slices of the words that are sent."""
    import numpy as np

    from loomtext.llm import _text

    def hashes(words):
        raw = np.frombuffer("".join(words).encode(), np.uint8)
        return _text.word_hashes(raw, np.cumsum([0, *map(len, words)]), gap=_text.NOT_LETTER)[0] >> np.uint64(43)

    twin = "xqbrpbj"
    assert hashes([twin])[0] in hashes(["zorgle", "blarfed"])
    docs, known = corpus
    m = toxicity.fit(docs, known)
    d = table(spark, [(1, " ".join([twin] * 9), "en"), (2, "zorgle " * 9, "en"), (3, "none", "en"), (4, "zorgle " * 9, "de")])
    got = {r.doc_id: r.score for r in toxicity.score(d, m).collect()}
    assert got[1] == got[3] < 0.5 < got[2] == got[4]
    whole = sorted(map(tuple, toxicity.score(docs, m).collect()))
    monkeypatch.setattr(toxicity, "SENT", m.n // 2)
    assert m.slices() > 1 and sorted(map(tuple, toxicity.score(docs, m).collect())) == whole
