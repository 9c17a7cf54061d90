"""Hand cases: quirks of text functions, filters, conversations, tool calls, tokens, sources and sinks."""

import json
import os

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.functions.rules import CHINESE, LATIN
from millrace.operators import chat, dedup, filters, generate, metrics, report, rewards, scoring, select, similarity, tokens, tools
from millrace.sources import readers, sinks


def one(spark, column, **values):
    """The value of a column over one row of strings."""
    schema = ", ".join(f"`{k}` string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("gap", ["　", " ", "\u001c", "\u0085", " \n\t "])
def test_white_space_collapses(spark, gap):
    assert one(spark, T.normalize_text("t"), t=f" a{gap}b{gap}") == "a b"


def test_scalar_functions(spark):
    assert one(spark, T.normalize_text("t"), t=None) == ""
    assert one(spark, T.similarity_key("t"), t="É a_b!　中 文") == "éa_b中文"
    assert one(spark, T.casefold_key("t"), t="Straße") == "strasse"
    assert one(spark, T.padded_id("s_", F.lit(1234567)), t="") == "s_1234567"
    assert one(spark, T.extract_choice("t"), t="the answer is (b)") == "B"
    assert one(spark, T.extract_choice("t"), t="abacus") == "A"
    assert one(spark, T.extract_choice("t"), t="zzz") == ""
    assert one(spark, T.boxed_answer("t"), t=r"so \boxed{\frac{1}{2}}.") == r"\frac{1}{2}"
    assert one(spark, T.boxed_answer("t"), t="none") is None
    assert one(spark, T.cut_at_stops("t", ["\nQ:", "###"]), t="yes### no\nQ: x") == "yes"
    assert one(spark, T.tagged_answer("t"), t="a <answer> 4\n2 </answer>") == "4\n2"
    assert one(spark, T.strip_html("t"), t='<p>a&amp;b<script>var t="</p>";</script><b>c</b>') == "a&b c"
    assert one(spark, T.percent("t"), t=None) == "-"
    assert T.stop_variants(["\nUser", "x"]) == ["\nUser", "x", "User"]
    assert T.parse_bool("Yes") and not T.parse_bool("0")


def complete(text):
    return text + "，" + "；".join(f"{x[0]}内容" for x in CHINESE.sections.values())


def test_rewards_in_order(spark):
    rate = lambda f, t: one(spark, f, t=t)
    full = complete("说明")
    assert rate(scoring.format_reward("t", CHINESE), full) == 1.0
    assert 0 < rate(scoring.format_reward("t", CHINESE), "分析与建议") < 1
    wanted = F.array(F.lit("分析"), F.lit("建议"))
    assert rate(scoring.format_reward("t", CHINESE, wanted), "分析与建议") == 1.0
    assert rate(scoring.format_reward("t", CHINESE, F.array(F.lit("?"))), full) == 1.0
    safe = scoring.safety_reward("t", CHINESE)
    assert rate(safe, "需结合检查，建议就医") > rate(safe, "一定是肺炎，无需检查")
    assert rate(safe, "每次2片，每天3次，自己吃药即可") < 0.7
    worn = scoring.repetition_penalty("t")
    assert rate(worn, "多喝水并注意休息。" * 80) > max(0.2, rate(worn, "先观察体温。" * 1 + "再看医生的意见，按时复查，饮食清淡，避免劳累，保持通风，注意个人卫生，记录症状变化，必要时前往门诊就诊，听从医生安排，不要自行用药，保持心情平稳，早睡早起，适量运动。"))
    assert rate(scoring.risk_penalty("t", CHINESE), "一定是") == pytest.approx(1 / 3)
    assert rate(scoring.keyword_coverage("t", F.lit("儿科学"), CHINESE), "分析 儿童") == pytest.approx(2 / 5)


def test_similarity_fixtures(spark):
    dice = similarity.row_dice("a", "b")
    near = one(spark, dice, a="发热咳嗽建议就医检查", b="发热和咳嗽建议及时就医")
    far = one(spark, dice, a="今天天气很好", b="发热和咳嗽建议及时就医")
    assert near > far and near > 0.25 and 0 <= far <= 1
    assert one(spark, dice, a="", b="x") == 0.0
    assert one(spark, similarity.similarity_grams("a"), a="Hello World é") == ["helloworld"]
    assert one(spark, F.size(similarity.char_ngrams("a")), a="x") == 0
    assert one(spark, similarity.char_ngrams("a"), a="a b c") == ["ab", "bc", "abc"]
    assert one(spark, similarity.sentence_repetition("a"), a="abcdef;abcdef;ghijkl") == pytest.approx(1 / 3)
    chunks = one(spark, similarity.sentence_chunks("a", 20, 5), a="One two three. Four five six! Seven? Eight nine ten eleven twelve.")
    assert chunks[0].startswith("One two three.") and chunks[0].endswith("Four ")
    assert one(spark, similarity.cjk_chunks("a", 4), a="甲乙丙丁。戊己。庚") == ["甲乙丙丁。", "戊己。庚"]


def turns(spark, roles):
    names = {"U": "user", "A": "assistant", "S": "system", "T": "tool"}
    return spark.createDataFrame([(1, i, names[r], f"{r}{i}") for i, r in enumerate(roles)], "c long, o long, r string, t string")


@pytest.mark.parametrize(
    "roles, short, long",
    [
        ("UUA", [("U0\nU1", "A2")], [("U0\nU1", "A2")]),
        ("AUA", [("U1", "A2")], [("U1", "A2")]),
        ("UAAU", [("U0", "A1")], [("U0", "A1"), ("U3", "")]),
        ("U", [], [("U0", "")]),
        ("SUAUA", [("U1", "A2"), ("U3", "A4")], [("U1", "A2"), ("U3", "A4")]),
    ],
)
def test_fold(spark, roles, short, long):
    for keep, want in ((False, short), (True, long)):
        got = chat.fold_pairs(turns(spark, roles), "c", "o", "r", "t", keep).orderBy("pair").collect()
        assert [(r["user"], r["assistant"]) for r in got] == want


@pytest.mark.parametrize("roles, want", [("UAUA", [("U0", "A1"), ("U2", "A3")]), ("SUA", [("U1", "A2")]), ("UATUA", [("U0", "A1")]), ("UAU", []), ("UUA", []), ("UAAA", []), ("UAAAUA", [])])
def test_strict_pairs(spark, roles, want):
    got = chat.strict_pairs(turns(spark, roles), "c", "o", "r", "t").orderBy("pair").collect()
    assert [(r["user"], r["assistant"]) for r in got] == want


def test_prefixes_and_messages(spark):
    got = chat.prefix_samples(turns(spark, "SUAUA"), "c", "o", "r", "t").orderBy("o").collect()
    assert [len(r["messages"]) for r in got] == [3, 5]
    assert chat.first_pair(turns(spark, "SAU"), "c", "o", "r", "t").first()[1:] == ("S0", "A1")
    assert chat.scan_pairs(turns(spark, "AUUA"), "c", "o", "r", "t").first()[2:] == ("U2", "A3")
    pairs = chat.fold_pairs(turns(spark, "UAUA"), "c", "o", "r", "t")
    assert chat.render(pairs, "c", "llama2").first()["prompt"] == "[INST] U0 [/INST]A1</s>[INST] U2 [/INST]A3"
    assert len(chat.TEMPLATES) >= 33
    with pytest.raises(ValueError):
        chat.template("nothing")


TOOLS = [{"name": "get_weather", "description": "Weather", "parameters": {"required": ["city"], "properties": {"city": {"enum": ["a", "b"], "description": "Where", "type": "string"}}}}]


def test_tools(spark):
    for name in tools.DIALECTS:
        assert "get_weather" in tools.list_tools(TOOLS, name, "01 Jan 2025")
        calls = F.array(F.struct(F.lit("f").alias("name"), F.lit('{"x":1}').alias("arguments")))
        back = one(spark, tools.read_calls(tools.call_text(calls, name), name), t="")
        assert [tuple(b) for b in back] == [("f", '{"x":1}')]
        assert one(spark, tools.read_calls("t", name), t="plain text") is None
    two = F.array(*[F.struct(F.lit(n).alias("name"), F.lit('{"x":1}').alias("arguments")) for n in "ab"])
    assert one(spark, tools.call_text(two, "llama3"), t="") is None
    for name in ("default", "mistral", "qwen3"):
        assert len(one(spark, tools.read_calls(tools.call_text(two, name), name), t="")) == 2
    assert one(spark, tools.observation("t"), t='{"c": 1}') == 'Observation: {"c": 1}'
    assert one(spark, tools.function_call_text("t"), t="no json") is None
    assert "city (string, required): Where, should be one of [a, b]" in one(spark, tools.tools_text("t"), t=json.dumps(TOOLS))
    assert one(spark, tools.tools_text("t"), t="{") is None
    with pytest.raises(ValueError):
        tools.dialect("morse")


def test_duplicate_before_advertisement(spark):
    rows = spark.createDataFrame([(1, "q", "call 555 1234"), (2, "q", "clean")], "o long, q string, a string")
    assert filters.without_ads(dedup.keep_first(rows, "q", "o"), "a", ["[0-9]{3} [0-9]{4}"]).count() == 0


@pytest.mark.parametrize("n, at", [(4, 2), (6, 2)])
def test_percentile_rounds_half_to_even(spark, n, at):
    df = spark.range(n)
    assert metrics.percentiles(df, "id", [50]).first()["id"] == at
    assert metrics.percentiles(df.limit(0), "id", [50]).count() == 0


def test_quota():
    assert [select.quota_of(n) for n in (99, 100, 500, 1000)] == [1, 10, 41, 80]


def test_ties_and_ranges(spark):
    df = spark.createDataFrame([("10", 1.0), ("9", 1.0), ("8", 0.5)], "id string, s double")
    assert [r["id"] for r in select.top_k(df, 2, F.col("s").desc(), F.col("id").desc()).collect()] == ["9", "10"]
    big = spark.range(1000).select((999 - F.col("id")).alias("x"))
    got = select.prefix_sums(big, [F.col("x")], F.col("x"), "before", parts=7).orderBy("x").collect()
    assert [r["before"] for r in got] == [sum(range(i)) for i in range(1000)]
    kept = dedup.keep_first(spark.createDataFrame([(1, None), (2, None), (3, "a")], "o long, k string"), "k", "o")
    assert sorted(r["o"] for r in kept.collect()) == [1, 3]


def test_exclusion_keeps_nulls(spark):
    df = spark.createDataFrame([("a",), (None,), ("b",)], "id string")
    other = spark.createDataFrame([("b", "x"), (None, None)], "id string, source_id string")
    assert {r["id"] for r in dedup.exclude_ids(df, [other]).collect()} == {"a", None}
    assert dedup.resume(df, other).count() == 2


def test_gates(spark):
    pool, some = spark.range(10).toDF("id"), spark.range(5).toDF("id")
    assert filters.coverage_gate(pool, some, least=0.5) == 0.5
    with pytest.raises(ValueError):
        filters.coverage_gate(pool, some)
    with pytest.raises(ValueError):
        filters.yield_gate(some, 6)
    with pytest.raises(Exception, match="missing"):
        filters.require_columns(spark.createDataFrame([("",)], "id string"), "id").count()


def test_packing_and_truncation(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, []), (3, [4, 9])], "o long, ids array<int>")
    whole = tokens.pack_blocks(df, "o", "ids", 9, 3).orderBy("block").collect()
    assert [r["input_ids"] for r in whole] == [[1, 2, 3], [9, 9, 4]]
    short = tokens.pack_blocks(df, "o", "ids", 9, 100).collect()
    assert [r["input_ids"] for r in short] == [[1, 2, 3, 9, 9, 4, 9]]
    pairs = spark.createDataFrame([(1, 0, [1, 2], [3, 4]), (1, 1, [5] * 50, [6] * 50)], "k long, pair long, s array<int>, t array<int>")
    got = tokens.truncate_turns(pairs, "k", "s", "t", 10, 0).first()
    assert got["input_ids"] == [1, 2, 3, 4, 0] and got["labels"] == [-100, -100, 3, 4, 0]
    assert one(spark, tokens.token_ids("t", lambda s: [len(s)]), t="abc") == [3]
    p = one(spark, tokens.padded(F.array(F.lit(7)), 3), t="")
    assert (p["input_ids"], p["attention_mask"]) == ([7, 0, 0], [1, 0, 0])


def test_generation_errors_stay_in_rows(spark):
    def bad(prompts):
        raise RuntimeError("no model")

    row = tokens.generate(spark.createDataFrame([("p",)], "q string"), "q", bad).first()
    assert row["prediction"] is None and "no model" in row["error"]


def test_knowledge_prompts_pass_over_empty_answers(spark):
    points = spark.createDataFrame([(1, ""), (2, "x")], "o long, a string")
    got = generate.knowledge_prompts(points, "o", "a", 3, ["{answer_text}-{audience}-{focus}"], ["p", "q"], ["f"]).collect()
    assert [r["question"] for r in got] == ["x-p-f", "x-q-f", "x-p-f"]
    assert generate.knowledge_prompts(points.limit(0), "o", "a", 3, ["t"], ["p"], ["f"]).count() == 0


def write(path, *lines):
    path.write_text("\n".join(lines), encoding="utf-8")
    return str(path)


def test_json_sources(spark, tmp_path):
    p = write(tmp_path / "a.jsonl", '{"x": 1}', "", "{bad", '{"x": 2}}', '{"x": 3}')
    audit = readers.audited_jsonl(spark, p).orderBy("line_no").collect()
    assert [(r["line_no"], r["status"]) for r in audit] == [(1, "ok"), (2, "empty"), (3, "json_error"), (4, "json_error"), (5, "ok")]
    assert readers.capped_jsonl(spark, p, "x long", 1).first()["x"] == 1
    with pytest.raises(Exception):
        readers.strict_jsonl(spark, p, "x long").collect()
    assert {r["x"] for r in readers.lenient_jsonl(spark, p, "x long").collect()} >= {1, 3}
    array = write(tmp_path / "b.json", "[", '{"x": 1},', '{"x": 2}', "]")
    assert readers.sniffed_json(spark, array, "x long").count() == 2
    assert readers.sniffed_json(spark, write(tmp_path / "c.json", "oops"), "x long").first()["status"] == "unknown_format"
    assert readers.sniffed_json(spark, p, "x long").where("status = 'ok'").count() == 2
    assert readers.optional_json(spark, str(tmp_path / "none.json"), "x long").count() == 0


def test_other_sources(spark, tmp_path):
    c = write(tmp_path / "phys_valid.csv", "﻿id,question", "1,what")
    row = readers.csv_with_subject(spark, c).first()
    assert (row["id"], row["subject"]) == ("1", "physid")
    assert readers.tab_separated(spark, write(tmp_path / "t.tsv", "a\tb"), ["x", "y"]).first()[:] == ("a", "b")
    with pytest.raises(ValueError):
        readers.corpus(spark, ["a.txt", "b.jsonl"])
    assert readers.corpus(spark, [write(tmp_path / "x.txt", "l1", "l2")]).count() == 2
    with pytest.raises(ValueError):
        readers.no_test_paths(["/d/my_test.json"])
    assert readers.no_test_paths(["/d/my_test.json", "/d/a.json"], strict=False) == ["/d/a.json"]
    os.makedirs(tmp_path / "docs")
    write(tmp_path / "docs" / "a.txt", "plain")
    write(tmp_path / "docs" / "b.html", "<p>hi</p>")
    assert {r["text"] for r in readers.document_texts(spark, str(tmp_path / "docs")).collect()} == {"plain", "hi"}
    assert readers.prompt_lines(spark, write(tmp_path / "p.txt", "one", " ", "two")).count() == 2
    os.makedirs(tmp_path / "m")
    write(tmp_path / "m" / "a.json", '{"model": "m1", "v": 1}')
    write(tmp_path / "m" / "summary.json", '{"model": "m2"}')
    assert readers.metric_files(spark, str(tmp_path / "m")).count() == 1


def test_schema_alignment(spark):
    plain = spark.createDataFrame([("c",)], "conversations string")
    tool = spark.createDataFrame([("d", "[]")], "conversations string, tools string")
    assert [tuple(r) for r in readers.aligned([plain, tool]).collect()] == [("c", None), ("d", "[]")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, None), ("中", 2, "x")], "id string, rank int, n string")
    out = str(tmp_path / "j")
    sinks.write_jsonl(df, out)
    lines = [line for f in os.listdir(out) if f.endswith(".json") for line in open(f"{out}/{f}", encoding="utf-8")]
    assert '"n":null' in "".join(lines) and "中" in "".join(lines)
    with pytest.raises(Exception):
        sinks.write_jsonl(df, out)
    sinks.write_parquet(df, str(tmp_path / "p"), "id string, rank long")
    assert spark.read.parquet(str(tmp_path / "p")).dtypes == [("id", "string"), ("rank", "bigint")]
    paths = sinks.write_top_ks(df, str(tmp_path / "k"), "rank", [1, 2])
    assert [spark.read.json(paths[k]).count() for k in (1, 2)] == [1, 2]
    assert sinks.append_new(df, str(tmp_path / "r")) == 2
    assert sinks.append_new(df.union(spark.createDataFrame([("b", 3, None)], df.schema)), str(tmp_path / "r")) == 3
    sinks.write_csv(df.fillna(""), str(tmp_path / "c"), "rank")
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).columns == ["rank", "id", "n"]
    sinks.write_stats(df, str(tmp_path / "s"))
    assert spark.read.json(str(tmp_path / "s")).count() == 1


def test_report(spark):
    df = spark.createDataFrame([("a|b", 1)], "name string, n int")
    text = report.report({"training": report.table(df, ["name", "n"])}, "zh")
    assert "## 训练" in text and "| a\\|b | 1 |" in text
    cases = spark.createDataFrame([(1, "q", "x" * 400, "y")], "o long, q string, b string, a string")
    assert "..." in report.case_blocks(cases, "q", "b", "a", "o")


def test_streams(spark, tmp_path):
    from millrace.streaming import streams

    spark.range(10).selectExpr("id % 3 AS k", "timestamp_seconds(id) AS ts").write.json(str(tmp_path / "in"))
    stream = streams.json_stream(spark, str(tmp_path / "in"), "k long, ts timestamp")
    streams.run_to_end(streams.dedup_stream(stream, "ts", "1 hour", "k"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    streams.map_batches(stream, lambda d: d.where("k = 1"), str(tmp_path / "m"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "m")).count() == 3


def test_report_leaves_no_row_out(spark):
    df = spark.range(5).selectExpr("id AS n")
    assert report.table(df, ["n"], F.col("n"), most=5).count("\n") == 6
    with pytest.raises(ValueError):
        report.table(df, ["n"], most=4)


def test_required_sections_of_predictions(spark):
    text = "可能原因：感染。注意用药安全，遵医嘱。"
    arr = lambda *x: F.array(*[F.lit(v) for v in x])
    d = spark.range(1).select(F.lit(text).alias("t"))
    row = d.select(
        scoring.keyword_coverage("t", F.lit("内科学"), CHINESE, arr("用药风险", "儿科就医建议")).alias("two"),
        scoring.keyword_coverage("t", F.lit("内科学"), CHINESE, arr("处理建议")).alias("none"),
        scoring.format_score("t", CHINESE, arr("初步判断", "复诊建议", "急诊")).alias("form"),
    ).first()
    assert row["two"] == pytest.approx((2 + 1 + 0) / 6)  # 分析 and 风险 groups; 药物禁忌 hit, 儿科学 not
    assert row["none"] == pytest.approx(2 / 4)
    assert row["form"] == pytest.approx(1 / 3 + 0.05)  # analysis hit; visit twice, not hit; one heading


def test_rewards_by_name(spark):
    assert rewards.reward_names() == ("accuracy", "thought_format") and rewards.reward_names("MEDICAL", "combined") == ("combined",)
    for bad in (("other", None), ("medical", "third")):
        with pytest.raises(ValueError):
            rewards.reward_names(*bad)
    d = spark.createDataFrame([("<think>a</think><answer>4</answer>", "so\n#### 4"), (None, "5")], "t string, a string")
    got = [tuple(r) for r in d.select(*rewards.rewards("t", "a", rewards.reward_names())).collect()]
    assert got == [(1.0, 1.0), (0.0, 0.0)]
    rewards.register("length", lambda text, answer, rules: F.length(text).cast("double"))
    assert d.select(*rewards.rewards("t", "a", ["length"])).collect()[1][0] == 0.0
    with pytest.raises(ValueError):
        rewards.rewards("t", "a", ["nothing"])
    own = d.select(rewards.by_function(lambda completions, gold: [float(c is not None and g is not None) for c, g in zip(completions, gold)], "t", gold="a").alias("r"))
    assert [r["r"] for r in own.collect()] == [1.0, 0.0]


def test_backend_of_topic_similarity(spark):
    pairs = spark.createDataFrame([(1, "red apples", "grow on trees"), (2, "blue", "whales swim"), (3, None, None)], "id long, q string, a string")
    asked = spark.createDataFrame([(10, "apples on trees"), (11, "whales")], "item long, text string")

    def bags(texts):
        return [[float(w in t) for w in ("apple", "tree", "whale", "swim")] for t in texts]

    def broken(texts):
        raise RuntimeError("no model")

    dense = {r["id"]: r for r in similarity.topic_similarity(pairs, "id", "q", "a", asked, "item", "text", embedder=bags).collect()}
    assert dense[1]["matched_query"] == 10 and dense[2]["matched_query"] == 11 and dense[1]["max_similarity"] == pytest.approx(1.0) and dense[3]["max_similarity"] == 0.0
    grams = similarity.topic_similarity(pairs, "id", "q", "a", asked, "item", "text").orderBy("id").collect()
    with pytest.warns(UserWarning):
        fallen = similarity.topic_similarity(pairs, "id", "q", "a", asked, "item", "text", embedder=broken).orderBy("id").collect()
    assert fallen == grams and grams[0]["matched_query"] == 10 and grams[1]["matched_query"] == 11


def test_cosine_search_in_blocks(spark):
    rows = [(i, [float((i * 7) % 5) - 2, float(i % 3), 1.0]) for i in range(60)] + [(60, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    whole = similarity.cosine_search(df, "id", "v", df.where("id % 4 = 0"))
    parts = similarity.cosine_search(df, "id", "v", df.where("id % 4 = 0"), block=3)
    key = lambda d: sorted((r["id"], r["query"], round(r["cosine"], 9)) for r in d.collect())
    assert key(whole) == key(parts) and whole.count() == 60 * 15
    few = similarity.cosine_search(df.coalesce(1), "id", "v", df.where("id % 4 = 0"), top=3)
    assert few.count() < 60 * 15
    assert similarity.cosine_search(df, "id", "v", df.limit(0)).count() == 0


def test_default_tool_calls_are_read_leniently(spark):
    text = 'Thought\nAction:  get_weather\n\nAction Input:  ```{"city": "x"}```\nAction: two Action Input: "5"'
    d = spark.createDataFrame([(text,), ("no call",), ("Action: a\nAction Input: {bad",)], "t string")
    got = [r["c"] for r in d.select(tools.calls_or_text("t").alias("c")).collect()]
    assert [(c["name"], c["arguments"]) for c in got[0]["calls"]] == [("get_weather", '{"city": "x"}'), ("two", "5")] and got[0]["content"] is None
    assert got[1]["calls"] is None and got[1]["content"] == "no call" and got[2]["content"].startswith("Action: a")


def test_splits_of_fixed_size(spark):
    df = spark.range(20).selectExpr("id")
    tail = select.tail_split(df, 3, F.col("id"))
    assert {r["id"] for r in tail.where("split = 'validation'").collect()} == {17, 18, 19} and tail.count() == 20
    sized = select.sized_split(df, "id", 6)
    assert sized.where("split = 'validation'").count() == 6 and sized.count() == 20
    other = select.sized_split(df, "id", 6, seed=7).where("split = 'validation'").collect()
    assert {r["id"] for r in sized.where("split = 'validation'").collect()} != {r["id"] for r in other}
    assert select.tail_split(df.limit(0), 3, F.col("id")).count() == 0


def test_interleave_takes_null_as_a_source(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "x", "b"), (3, "y", "c"), (4, "x", "d"), (5, None, None), (6, "y", None)], "id long, s string, t string")
    got = select.interleave(df, "s", ["x", "y", None], F.col("id"), "t").orderBy("ord").collect()
    assert [r["id"] for r in got] == [2, 3, 1, 4, 6]  # the second null text is a repetition


def test_word_files_and_optional_csv(spark, tmp_path):
    import zipfile

    os.makedirs(tmp_path / "w")
    with zipfile.ZipFile(tmp_path / "w" / "a.docx", "w") as f:
        f.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>one </w:t></w:r><w:r><w:t>line</w:t></w:r></w:p><w:p><w:r><w:t>two</w:t></w:r></w:p></w:body></w:document>')
    assert [r["text"] for r in readers.document_texts(spark, str(tmp_path / "w")).collect()] == ["one line\ntwo"]
    path = write(tmp_path / "x.csv", "a,b", '1,"q ""r"""')
    assert [tuple(r) for r in readers.optional_json(spark, path, "a int, b string").collect()] == [(1, 'q "r"')]
    assert readers.optional_json(spark, str(tmp_path / "none.csv"), "a int").count() == 0


def test_templates_with_system_prompts():
    t = chat.TEMPLATES
    assert len(t) == 33 and t["qwen3_nothink"] == t["qwen"] and t["qwen"].sep == "\n" and t["qwen"].system.endswith("assistant.<|im_end|>\n")
    assert t["vicuna"].system.startswith("A chat between a curious user") and t["phoenix"].system.endswith("the human's questions.\n\n")
    assert t["llama3"].system.startswith("<|start_header_id|>system") and t["llama2-zh"].system.startswith("[INST] <<SYS>>")



def vectors_in_a_batch(rows):
    import numpy as np
    import pyarrow as pa

    m = np.random.default_rng(1).integers(-2, 3, (rows, 4)).astype("float32")
    return m.astype(float), pa.RecordBatch.from_arrays([pa.array(range(rows)), pa.array(list(m))], ["id", "v"])


def test_cosine_pairs_come_in_tiles():
    m, batch = vectors_in_a_batch(3000)
    sizes = [b.num_rows for b in similarity.cosine_kernel("id", m[:1000], range(1000))([batch])]
    assert sum(sizes) == 3000 * 1000 and max(sizes) <= 1 << 18


def test_best_cosines_of_a_task_are_kept_over_its_batches():
    import numpy as np

    m, batch = vectors_in_a_batch(3000)  # small whole numbers, so there are many ties
    out = list(similarity.cosine_kernel("id", m[:700], range(700), top=3)([batch.slice(0, 1000), batch.slice(1000, 1500), batch.slice(2500)]))
    got = sorted(zip(*[sum((b.column(c).to_pylist() for b in out), []) for c in ("query", "id")]))
    unit = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
    cos = np.round(unit @ unit[:700].T, 6)
    assert got == sorted((q, int(i)) for q in range(700) for i in np.lexsort((np.arange(3000), -cos[:, q]))[:3])


def test_best_of_each_task_is_what_the_whole_table_gives(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * k) % 7}x" for k in range(1, 2 + i % 5)) if i % 9 else None) for i in range(80)], "id long, t string")
    asked = spark.createDataFrame([(7, "w1x w2x w3x"), (8, "w0x w5x"), (9, ""), (6, "w5x w0x w1x")], "item long, t string")
    q = asked.select("item", similarity.char_ngrams("t").alias("g"), similarity.words("t").alias("w"))
    words = docs.select("id", similarity.words("t").alias("w"))
    key = lambda d: sorted((r[0], r[1], round(r[2], 6)) for r in d.collect())
    firsts = lambda d, c: key(select.top_per_group(d, ["item"], 3, F.col(c).desc(), F.col("id")).select("item", "id", c))
    assert key(similarity.bm25_best(words, "id", "w", q, "item", "w", 3)) == firsts(similarity.bm25(words, "id", "w", q, "item", "w").withColumn("bm25", F.round("bm25", 6)), "bm25")
    near = similarity.overlap_scores(docs.select("id", similarity.char_ngrams("t").alias("g")), "id", "g", q, "item", "g").withColumn("score", F.round("score", 9))
    told = similarity.overlap_to_queries(docs.coalesce(1), "id", "t", q, "item", "g", digits=(9,), top=3)
    assert told.count() == 9  # three queries with grams, three of each
    assert firsts(told, "score") == firsts(near, "score")
    wide = similarity.query_summary(near, docs, "id", "item", 4)
    names = ["id", "max_similarity", "mean_top_similarity", "matched_query", "base_score"]
    plain = lambda d: [tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in d.select(*names).orderBy("id").collect()]
    assert plain(similarity.overlap_summary(docs, "id", "t", q, "item", "g")) == plain(wide)


def test_texts_are_normalised_once(spark):
    d = spark.createDataFrame([("q", "a", "the und tion")], "q string, a string, t string")
    times = lambda c: d.select(c.alias("c"))._jdf.queryExecution().analyzed().toString().count("regexp_replace(")
    sections = F.array(F.lit("analysis"), F.lit("risk"))
    assert times(scoring.format_score("t", LATIN, sections)) == 1 and times(scoring.format_score("t", LATIN)) == 1
    assert times(scoring.keyword_coverage(T.normalize_text("t"), F.lit("general"), LATIN, None)) > 1  # callers give a column
    assert times(scoring.complexity_flat("q", "a", F.lit(0.0), ["the", "und"])) == 2 and times(scoring.complexity("q", "a", F.lit(0.0), LATIN)) == 2
    calls = F.array(F.struct(F.lit("f").alias("name"), F.lit("{}").alias("arguments")))
    shown = d.select(tools.read_calls(tools.call_text(calls, "mistral"), "mistral").alias("c"))._jdf.queryExecution().analyzed().toString()
    assert shown.count("from_json(") == 1


def test_funnels_go_over_texts_once(spark):
    from millrace.plans import registry

    for name in ("high_similarity_source", "dedup_then_ads", "selection_rank"):
        left = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_replace(" not in left and "text#" not in left  # what is left to do reads narrow rows only


def test_chunks_of_very_many_sentences(spark):
    text = " ".join(f"Sentence {i} is here." for i in range(20000))
    chunks = one(spark, similarity.sentence_chunks("a", 100, 10), a=text)
    bodies = [c[:-11] for c in chunks[:-1]] + chunks[-1:]
    assert " ".join(bodies) == text and all(len(b) <= 100 for b in bodies) and all(c.endswith(" " + b[:10]) for c, b in zip(chunks, bodies[1:]))
    assert one(spark, similarity.sentence_chunks("a"), a=None) == [] and one(spark, similarity.sentence_chunks("a"), a=" \n") == [" \n"]


def test_narrow_rows_are_spread_by_size(spark, tmp_path):
    spark.range(200000).repartition(1).write.parquet(str(tmp_path / "n"))
    rows = spark.read.parquet(str(tmp_path / "n"))
    assert select.spread(rows, part_bytes=1 << 16).rdd.getNumPartitions() > select.spread(rows).rdd.getNumPartitions()
