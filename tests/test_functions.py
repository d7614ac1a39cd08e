"""Hand-made rows with known results."""

import pytest
from pyspark.sql import functions as F

from loomtext.functions import draws, parse, scores, text
from loomtext.operators import segment


def one(spark, column, *values, names="abcdef", types="string"):
    shape = ", ".join(f"{n} {types}" for n, _ in zip(names, values))
    return spark.createDataFrame([values], shape).select(column.alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw, clean",
    [("a  \nb", "a\nb"), ("a\n \n\t\nb", "a\n\nb"), ("a\n\n\n\nb", "a\n\nb"), ("a \n", "a\n"), ("x \n y", "x\n y")],
)
def test_clean(spark, raw, clean):
    assert one(spark, text.clean_whitespace(F.col("a")), raw) == clean


@pytest.mark.parametrize("orig, new, out", [("Hi.", "Hello", "Hello."), ("Hi", "Hello...", "Hello"), ("Hi?", "Hello.", "Hello?"), ("Hi!", "", ""), ("Why?", "So", "So?")])
def test_punctuation(spark, orig, new, out):
    got = one(spark, text.fix_punctuation(F.col("a"), F.col("b")), orig, new)
    assert got == out


@pytest.mark.parametrize("t, refused", [("I'm sorry, no", True), ("  I AM SORRY", True), ("I’m sorry", False), ("sorry", False), (None, False)])
def test_refusal(spark, t, refused):
    assert one(spark, text.is_refusal(F.col("a")), t) is refused


@pytest.mark.parametrize("t, out", [("<think>x</think> hi", "hi"), ("Assistant hi", "hi"), (None, "")])
def test_completion(spark, t, out):
    assert one(spark, text.clean_completion(F.col("a")), t) == out


@pytest.mark.parametrize(
    "t, items",
    [("1. red\n2. blue\n3. green", ["red", "blue", "green"]), ("1. met in 2019. then left\n2. ok", ["met in", "then left", "ok"]), ("1. multi\nline item\n2. two", ["multi\nline item", "two"]), ('["a", "b"]', ["a", "b"]), ("['a', 'b']", ["a", "b"]), ("a\n\n b ", ["a", "b"])],
)
def test_ordered_list(spark, t, items):
    assert one(spark, parse.ordered_list(F.col("a")), t) == items


def test_list_shapes(spark):
    assert one(spark, parse.unordered_list(F.col("a")), "* x\n* y") == ["x", "y"]
    assert one(spark, parse.markdown_list(F.col("a")), "- x\n- y") == ["x", "y"]
    assert one(spark, parse.choice_numbers(F.col("a")), "**1. A: b**\n2. C: d") == [1, 2]
    assert one(spark, parse.choice_keys(F.col("a")), "1. A: b\n2. C: d") == ["A", "C"]
    assert one(spark, parse.speakers(F.col("a")), "Ann: hi\nBob: yo\n") == ["Ann", "Bob"]


@pytest.mark.parametrize("a, b, d", [("Bob Lee", "bob lee", 0), ("John Smith", "Jon Smith", 3), ("", "x", 0), ("abcdefgh", "zzzzzzzz", 8)])
def test_difference(a, b, d):
    assert scores.text_difference_of(a, b) == d


def test_longest_match_is_difflibs_and_quicker():
    import difflib
    import random
    import time

    r = random.Random(7)
    words = ["the", "of", "a", "quick", "zebra", "\u00e9t\u00e9", "J. Fox", "7,5", "mixt", "while", "\u4e2d\u6587", "and"]
    size = lambda a, b: difflib.SequenceMatcher(None, a, b).find_longest_match(0, len(a), 0, len(b)).size
    for n in range(1500):
        letters = "abcdefghij"[: r.randint(1, 10)] if n % 2 else [w + " " for w in words]
        a, b = ("".join(r.choices(letters, k=r.randint(1, 60))) * (1 + n % 3) for _ in "ab")
        if n % 5 == 0:
            b = "".join(map(chr, r.choices(range(97, 400), k=r.randint(190, 420))))
            a += b[r.randint(0, 99) : r.randint(100, 190)]
        assert scores.longest_match(a, b) == size(a, b), (a, b)
    a, b = " ".join(r.choices(words[:10], k=4000)), " ".join(r.choices(words, k=40))[:199]
    began = time.perf_counter()
    want = size(a, b)
    middle = time.perf_counter()
    assert scores.longest_match(a, b) == want and time.perf_counter() - middle < (middle - began) / 3


@pytest.mark.parametrize("h, r, x", [("a b b c", "b c d", 2 / 3), ("Paris 2019", "paris", 0), ("St. Mary", "Mary St", 1), ("x", "y z", 0), ("", "y", 100)])
def test_rouge(spark, h, r, x):
    assert one(spark, scores.rouge1_recall(F.col("a"), F.col("b")), h, r) == pytest.approx(x)


def test_locate(spark):
    s = F.lit("Dear Dr. Ann Lee, hello")
    at = lambda found, attr="": one(spark, text.locate_span(s, F.lit(found), F.lit(attr)), "x")
    assert tuple(at("ann lee")) == (9, 16, "Ann Lee", 1.0)
    assert tuple(at('"ann lee"')) == (9, 16, "Ann Lee", 0.95)
    assert tuple(at("**Ann Lee**")) == (9, 16, "Ann Lee", 0.9)
    assert tuple(at("None found", "Ann"))[:2] == (9, 12)
    assert at("Bob") is None and at("") is None


def test_masking_round_trip():
    t = "Dr. Lee paid 3.14 at www.a.org, e.g. v1.2.3. U.2020.432V ended. éDr. Ruiz 3.14٣"
    masked = text.mask_text(t)
    assert "Dr_TITLE_DOT_ Lee" in masked and "3_FLOAT_DOT_14" in masked and "ended." in masked
    assert text.unmask_text(masked) == t


@pytest.mark.parametrize("t", ["", "a", "x\n\ny", "one. " * 300, "line of text\n" * 200, "a" * 3000, "p. q " * 200 + "\n\n" + "z\n" * 600, None])
def test_segments_rebuild(spark, t):
    rows = segment.segment_text(t)
    assert "".join(r["seq"] + r["terminator"] for r in rows) == (t or "")
    assert all((t or "")[r["start"] : r["start"] + len(r["seq"])] == r["seq"] for r in rows)
    d = segment.segments(spark.createDataFrame([(t,)], "t string"), "t").select(segment.rebuild(F.col("sequences")), "sequences").first()
    assert d[0] == (t or "").strip()
    assert [(r["seq"], r["start"]) for r in d[1]] == [(r["seq"], r["start"]) for r in rows]


def test_draws_do_not_depend_on_partitions(spark):
    d = spark.range(200)
    a = draws.sample_rows(d, "id", "s", 5).toPandas().id.tolist()
    b = draws.sample_rows(d.repartition(7), "id", "s", 5).toPandas().id.tolist()
    assert a == b and len(a) == 5
    ages = d.select(draws.random_age(F.col("id")).alias("a")).agg(F.min("a"), F.max("a")).first()
    assert ages[0] >= 19 and ages[1] <= 85


def test_vendi():
    import numpy as np

    assert scores.vendi_of(np.eye(4)) == pytest.approx(4)
    assert scores.vendi_of(np.ones((4, 3))) == pytest.approx(1)
    assert scores.vendi_of(np.array([[1, 0], [1, 0], [0, 1], [0, 1]])) == pytest.approx(2)


@pytest.mark.parametrize("llm, novelty, ok", [(1, 0.0, False), (1, 0.01, True), (0, 1.0, False), (0, 1.01, True)])
def test_accepts(spark, llm, novelty, ok):
    assert one(spark, scores.accepts(F.lit(llm), F.lit(novelty)), "x") is ok
