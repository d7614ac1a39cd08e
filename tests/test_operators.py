import json

import pytest
from pyspark.sql import functions as F

from loomtext.operators import diversity, reshape, select, spans
from loomtext.plans import generate, sanitize
from loomtext.plans.rule_model import PatternModel
from loomtext.plans.seam import Client, Retryable, Stub, complete, is_reasoning, request_options
from loomtext.sources import readers, sinks
from loomtext.streaming import incremental


def test_islands(spark):
    d = spark.createDataFrame([(1, 0, 5, "a"), (1, 3, 8, "A"), (1, 8, 9, "b"), (1, 20, 22, "a")], "k int, start int, end int, attr_type string")
    rows = [tuple(r) for r in spans.merge_spans(d, "k").select("start", "end", "attr_types").orderBy("start").collect()]
    assert rows == [(0, 8, ["a"]), (8, 9, ["b"]), (20, 22, ["a"])]


def test_replace(spark):
    d = spark.createDataFrame([(1, "abcdef"), (2, "xyz"), (3, None)], "k int, t string")
    s = spark.createDataFrame([(1, 1, 3), (1, 4, 5)], "k int, start int, end int")
    out = {r.k: (r.sanitized, r.n_spans) for r in spans.replace_spans(d, s, "k", "t", F.lit("_")).collect()}
    assert out == {1: ("a_d_f", 2), 2: ("xyz", 0), 3: (None, 0)}


@pytest.mark.parametrize("n, kept", [(1, 1), (3, 3), (4, 2), (5, 3), (6, 4), (9, 6)])
def test_cut(spark, n, kept):
    d = spark.range(n).select(F.lit("r").alias("record_id"), F.col("id").alias("ordinal"))
    r = select.rank_weights(d, "record_id")
    assert select.cut_top(r, "record_id").count() == kept
    if n == 3:
        assert [round(x.weight, 5) for x in r.orderBy("rank").collect()] == [0.47561, 0.29268, 0.23171]


def test_reshape(spark):
    d = spark.sql("SELECT 1 AS k, map('a', '1', 'b', '2') AS m, map('b', '3') AS e, array(named_struct('name', 'destinations', 'value', 'x, ,y'), named_struct('name', 'n', 'value', '1'), named_struct('name', 'n', 'value', '2')) AS l")
    r = d.select(reshape.merge_maps(F.col("m"), F.col("e")).alias("m"), reshape.reformat_event(F.create_map(F.lit("n"), F.lit("0"), F.lit("date"), F.lit("d")), F.col("l")).alias("x")).first()
    assert r.m == {"a": "1", "b": "3"}
    assert r.x == {"date": "d", "n": "2", "destinations": '["x","y"]'}
    z = spark.sql("SELECT array(1, 2, 3) AS a, array('x') AS b").select(reshape.zip_shorter(F.col("a"), F.col("b")).alias("z"), reshape.attach_answers(F.col("a"), F.col("b")).alias("t")).first()
    assert [tuple(x) for x in z.z] == [(1, "x")] and [x.answer for x in z.t] == ["x", None, None]


def test_clusters(spark):
    d = spark.sql("SELECT 1 AS k, map('a', '1', 'b', '2') AS m, array(named_struct('cluster_name', 'g', 'attributes', array(0, 1)), named_struct('cluster_name', 'h', 'attributes', array(1))) AS c UNION ALL SELECT 2, map('a', '1'), array(named_struct('cluster_name', 'g', 'attributes', array(5)))")
    groups, errors = reshape.resolve_clusters(d, "m", "c", "k")
    assert [(r.k, r.grouped) for r in groups.collect()] == [(1, {"g": {"a": "1", "b": "2"}, "h": {"b": "2"}})]
    assert [r.k for r in errors.collect()] == [2]


def test_fuzzy(spark):
    d = spark.createDataFrame([("Medical History", ["Medical history", "x"]), ("qqq", ["Medical history"]), (None, ["x"])], "a string, c array<string>")
    assert [r.m for r in select.resolve_names(d, "a", "c", "m").collect()] == ["Medical history", None, None]


def test_selection_is_reproducible(spark):
    rows = [(f"r{i}", g, f"t{j}", f"v{j}", j) for i in range(8) for j, g in enumerate(["g1", "g1", "g2", None, None, None])]
    a = spark.createDataFrame(rows, "record_id string, group_name string, attr_type string, attr_value string, ordinal int")
    x = sorted(map(tuple, sanitize.choose(a).collect()), key=repr)
    y = sorted(map(tuple, sanitize.choose(a.repartition(5)).collect()), key=repr)
    assert x == y and x


def test_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\nnot json\n{"x": 2}\n')
    (tmp_path / "sub" / "b.jsonl").write_text("")
    good, bad = readers.tolerant_jsonl(spark, str(tmp_path / "a.jsonl"), "x INT")
    assert sorted(r.x for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]
    assert [(r.name, r.n_lines) for r in readers.catalog(spark, str(tmp_path)).collect()] == [("a.jsonl", 4), ("b.jsonl", 0)]
    assert readers.catalog(spark, str(tmp_path / "none")).count() == 0
    assert not readers.inside("/data/run", "../run2/x") and readers.inside("/data/run", "x/y")
    (tmp_path / "d.jsonl").write_text('{"A": {"literal_value": ["x"]}}\n{"A": {"literal_value": ["y"], "city_level": ["z"]}}\n')
    assert {(r.level, tuple(r["values"])) for r in readers.attribute_values(spark, str(tmp_path / "d.jsonl")).collect()} == {("literal_value", ("y",)), ("city_level", ("z",))}
    assert readers.logs(spark, str(tmp_path / "no.jsonl"), "x INT").count() == 0


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, None, False), (2, None, True), (3, "why", True)], "x int, error string, bad boolean")
    sinks.append_split(d, str(tmp_path / "o"), "bad")
    assert {(r.x, r.error) for r in spark.read.json(str(tmp_path / "o/errors")).collect()} == {(2, sinks.UNKNOWN), (3, "why")}
    sinks.write_csv(spark.createDataFrame([('a "q"\nb',)], "t string"), str(tmp_path / "c"))
    back = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(str(tmp_path / "c")).first()
    assert back.t == 'a "q"\nb'


def test_seam(spark):
    calls = []

    def send(p):
        calls.append(p)
        if p == "bad":
            raise ValueError("no")
        if p == "slow" and calls.count("slow") < 3:
            raise Retryable("busy")
        return p.upper()

    assert Client(send, 2, sleep=lambda s: None)(["a", "bad", "slow"]) == ["A", "", "SLOW"]
    assert json.loads(Client(send, json_mode=True)(["bad"])[0]) == {"error": "no"}
    d = spark.createDataFrame([(1, "one"), (2, None), (3, "three")], "k int, p string")
    out = {r.k: r.a for r in complete(d, "p", "a", lambda: Stub(words=(("one", "<think>x</think> 1"),))).collect()}
    assert out[1] == "1" and out[2] is None and out[3].startswith("answer ")
    assert is_reasoning("x/o3-mini") and request_options("o3", 0.0, 10) == {"max_completion_tokens": 4096}


def test_sanitize_plan(spark):
    text = "Ann Lee lives here. Call Ann Lee.\n\nNothing else. Ann Lee."
    docs = spark.createDataFrame([("r1", text), ("r2", "no one")], "record_id string, text string")
    attrs = spark.createDataFrame([("r1", None, "name", "Ann Lee", 0), ("r2", None, "name", "Bob", 0)], "record_id string, group_name string, attr_type string, attr_value string, ordinal int")
    new, mapping, errors = sanitize.run(docs, attrs, PatternModel)
    rows = {r.record_id: r.text for r in new.collect()}
    bad = {r.record_id for r in errors.collect()}
    # every record is in exactly one of both
    assert set(rows) | bad == {"r1", "r2"} and not set(rows) & bad and bad <= {"r2"}
    chosen = sanitize.choose(attrs).where("record_id = 'r1' AND sanitization <> 'keep'").count()
    if chosen:  # every copy of a sequence is rewritten
        assert "Ann Lee" not in rows["r1"] and "Nothing else." in rows["r1"]
        assert mapping.where("record_id = 'r1'").count() == 2
    else:
        assert rows["r1"] == text


def test_no_target_of_a_sequence_is_left(spark):
    """70 targets in one sequence: all are rewritten; a record without targets comes back as it is."""
    from loomtext.operators import segment
    from loomtext.storage import materialized

    names = [f"Name{i:02d}x" for i in range(70)]
    cut = materialized(segment.explode_sequences(segment.segments(spark.createDataFrame([("r", " ".join(names))], "record_id string, text string"), "text", 10_000), "record_id"))
    targets = spark.createDataFrame([("r", None, f"name_{i:02d}", n, i, "drop") for i, n in enumerate(names)], "record_id string, group_name string, attr_type string, attr_value string, ordinal int, sanitization string")
    found, errors = sanitize.find_spans(cut, targets, PatternModel)
    found = materialized(found)
    assert errors.count() == 0 and found.count() == 70
    new = sanitize.rewrite(cut, found, sanitize.strategies(found, cut, PatternModel), PatternModel)
    assert not any(n in new.first().seq for n in names)
    docs = spark.createDataFrame([("p", "no one here")], "record_id string, text string")
    none = spark.createDataFrame([], "record_id string, group_name string, attr_type string, attr_value string, ordinal int")
    assert [tuple(r) for r in sanitize.run(docs, none, PatternModel)[0].collect()] == [("p", "no one here")]


def test_draws_beyond_sixteen(spark):
    d = spark.createDataFrame([("r", f"t{i:03d}", i) for i in range(400)], "record_id string, attr_type string, ordinal int").withColumn("n", F.lit(60))
    assert 40 < select.draw_attributes(d, "n", "record_id").count() <= 60


def test_generate_plan(spark):
    names = spark.createDataFrame([("Ann", 9, 1), ("Bob", 0, 5)], "name string, F int, M int")
    s = generate.seeds(spark, 4, names, ["English"], ["A", "B"], ["X"], True)
    assert all(r.seed["Blood Type"] in "AB" and "2000" <= r.seed["Date"][:4] <= "2023" for r in s.collect())
    model = lambda: Stub(
        words=(
            ("Write a profile", '{"profile": [{"name": "first_name", "value": "Ann"}, {"name": "last_name", "value": "Lee"}], "events": [{"event": "trip", "attributes": [{"name": "place", "value": "Oslo"}]}]}'),
            ("List record types", "1. letter\n2. memo"),
            ("List the attributes", '{"place": "Oslo"}'),
            ("Group these", '[{"cluster_name": "g", "attributes": [0]}]'),
            ("Which record is better", "2"),
            ("Write the record", "Ann Lee wrote home. " * 12),
            ("Rewrite the record", "Ann Lee wrote home from Oslo again. " * 10),
        )
    )
    d = generate.share_attribute(generate.profiles(s, F.lit("trip"), model))
    d = generate.drafts(generate.priors(d, model), model)
    d = generate.refine(d, model, model, lambda x, a, b: x.withColumn("novelty", F.lit(0.1)), steps=1)
    ok, bad = generate.success_and_errors(generate.attributes(d, model))
    assert bad.count() == 0
    row = ok.first()
    assert row.record.grouped_attributes == {"g": {"full_name": "Ann Lee"}} or "g" in row.record.grouped_attributes
    assert len(row.record.accepted_records) + len(row.record.rejected_records) == 1 and len(row.id) == 64


def test_vendi_and_history(spark):
    d = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 1.0], "b")], "seq int, vec array<float>, label string")
    v = {r.label: (r.n, round(r.vendi, 6)) for r in diversity.vendi(d, "vec", "label").collect()}
    assert v == {"a": (2, 2.0), "b": (1, 1.0)}
    assert [r.seq for r in diversity.newest(d, "seq", 2).collect()] == [3, 2]
    p = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0])], "o array<float>, n array<float>")
    assert diversity.novelty(p, d.where("label = 'x'"), "o", "n", "k").first().novelty == pytest.approx(1)
    assert diversity.novelty(p, d.where("seq = 1"), "o", "n", "k").first().novelty == pytest.approx(1)


def test_file_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    run = lambda: incremental.file_stream(spark, str(src), "k INT", str(out), str(tmp_path / "cp"), lambda d: d.withColumn("v", F.col("k") * 2), "k").awaitTermination()
    (src / "1.json").write_text('{"k": 1}\n')
    run()
    (src / "2.json").write_text('{"k": 2}\n{"k": 2}\n')
    run()
    assert sorted(r.v for r in spark.read.json(str(out) + "/*").collect()) == [2, 4]
