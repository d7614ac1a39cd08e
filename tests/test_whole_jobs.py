"""Registered queries on small tables of their own, against brute force: no row and no part of a text is left out."""

import re


from loomtext import queries as records
from loomtext.functions.scores import text_difference_of

DOCS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG"


def tables(spark, tmp_path, texts, items=()):
    spark.createDataFrame([(i, t, "en", "src0", None if t is None else len(t)) for i, t in texts], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    if items:
        spark.createDataFrame(list(items), "item_id LONG, text STRING").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_text_difference_reads_whole_texts_and_all_items(spark, tmp_path):
    items = [(10 * i, f"passage {i} of words " + chr(97 + i % 26) * 9) for i in range(57)]
    texts = [(i, "filler text, " * 40 + items[i % 57][1]) for i in range(120)] + [(None, "no id"), (500, None), (-3, "below")]
    d = tables(spark, tmp_path, texts, items)
    rows = records.queries()["text_difference"](spark, d).collect()
    want = [(i, items[(i or 0) % 57][0], text_difference_of(t, items[(i or 0) % 57][1])) for i, t in texts]
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)
    assert {r.item_id for r in rows} == {i for i, _ in items}


def _ordered(text):
    found = re.findall(r"(\d+\.\s+.+?)(?=\d+\.\s|$)", text, re.DOTALL)
    return [re.sub(r"^\d+\.\s+", "", x).strip() for x in found] or [x.strip() for x in text.split("\n") if x.strip()]


def test_list_parse_has_every_document(spark, tmp_path):
    texts = ["1. one\n2. two\nand on\n10. ten", "in 2020. Then more", "plain\n\n lines ", "a 1.5 b", "x 1.\ty\n2.", "7. ", "٣. eins ٤. zwei"]
    d = tables(spark, tmp_path, list(enumerate(texts)))
    rows = records.queries()["list_parse"](spark, d).collect()
    want = [(i, len(_ordered(t)), _ordered(t)[0]) for i, t in enumerate(texts)]
    assert sorted(map(tuple, rows)) == want


def test_locate_spans_equals_its_sql_on_short_texts_and_odd_letters(spark, tmp_path):
    import duckdb

    texts = ["", "a", "ab", "  ", "abc", None, "xx\u0130stanbul and more", "\u0130\u0130abcdefghijklmnop", "ab" + "\u039f\u0394\u039f\u03a3" * 4, "xx none", "xx\"'\"", "ab***..."]
    d = tables(spark, tmp_path, list(enumerate(texts)))
    rows = records.queries()["locate_spans"](spark, d).collect()
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet/*.parquet'")
    want = c.sql(records.oracle_sql()["locate_spans"]).fetchall()
    assert sorted(map(tuple, rows)) == sorted(want) and len(want) == len(texts) - 1


def test_sentence_segments_cuts_each_text_once_and_in_runs(spark, tmp_path):
    import pyarrow as pa

    from loomtext.operators import segment

    texts = ["", None, "short", "one. " * 300, "line of text\n" * 200, "x" * 3_000, "p. q " * 200 + "\n\n" + "z\n" * 600, "a\n\nb"] + [f"{i}. " * 400 for i in range(50)]
    d = tables(spark, tmp_path, list(enumerate(texts)))
    df = records.queries()["sentence_segments"](spark, d)
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    want = [(i, r["idx"], r["seq"], r["terminator"], r["start"]) for i, t in enumerate(texts) for r in segment.segment_text(t)]
    assert sorted(map(tuple, df.collect())) == want
    sizes = [[len(t or "") for t in run.to_pylist()] for run in segment.runs(pa.array(texts), 5_000)]
    assert sum(sizes, []) == [len(t or "") for t in texts] and all(sum(x) <= 5_000 or len(x) == 1 for x in sizes)
    assert sum(map(len, segment.runs(pa.array([], pa.string())))) == 0


def test_sanitize_records_can_reach_every_value(spark, tmp_path, monkeypatch):
    from loomtext.plans import sanitize

    texts = [(i, f"Write to a{i}@x.com now.\nOr to b{i}@y.org then.\nAgain a{i}@x.com or +1 (555) 123-45{i:02d} here.") for i in range(40)]
    d, seen, run = tables(spark, tmp_path, texts), [], sanitize.run
    monkeypatch.setattr(sanitize, "run", lambda docs, attrs, model, *a: (seen.append(attrs), run(docs, attrs, model, *a))[1])
    assert records.queries()["sanitize_records"](spark, d).count() > 0
    got = {(r.record_id, r.attr_type, r.attr_value) for r in seen[0].collect()}
    assert got == {x for i in range(40) for x in ((str(i), "email_1", f"a{i}@x.com"), (str(i), "email_2", f"b{i}@y.org"), (str(i), "phone_1", f"+1 (555) 123-45{i:02d}"))}
    chosen = sanitize.choose(seen[0]).where("sanitization <> 'keep'")
    assert chosen.where("attr_type = 'email_1'").count() > 0 and chosen.where("attr_type = 'email_2'").count() > 0


def test_sanitize_cuts_each_text_once(spark, monkeypatch):
    import pytest

    from loomtext.plans import sanitize

    class Seen(Exception):
        pass

    plans = []

    def first(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython")))
        raise Seen

    monkeypatch.setattr(sanitize, "materialized", first)
    docs = spark.createDataFrame([("a", "One. " * 300)], "record_id string, text string")
    with pytest.raises(Seen):
        sanitize.run(docs, docs, None)
    assert plans == [("sequences", 1)]
