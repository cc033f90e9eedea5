import gzip
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright import schema
from casewright.functions import receipts, text
from casewright.operators import audits, editions, facts, joins
from casewright.sources import digests, readers, sinks

ROW = T.StructType([T.StructField("run_id", T.StringType()), T.StructField("catalog_id", T.IntegerType()), T.StructField("group_id", T.StringType())])


def test_json_lines_skip_blank_and_torn_lines(spark, tmp_path):
    good = [{"run_id": f"r{i}", "catalog_id": 1, "group_id": "g"} for i in range(3)]
    body = "\n".join(json.dumps(r) for r in good[:2]) + "\n\n" + json.dumps(good[2]) + "\n" + '{"run_id": "torn", "cat'
    (tmp_path / "a.jsonl").write_text(body)
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(json.dumps({"run_id": "z", "catalog_id": 2, "group_id": "h"}) + "\n")
    rows, torn = readers.json_lines(spark, str(tmp_path / "a.jsonl"), ROW, "rejects")
    assert sorted(r["run_id"] for r in rows.collect()) == ["r0", "r1", "r2"] and torn.count() == 1
    both = [str(tmp_path / "a.jsonl"), str(tmp_path / "b.jsonl.gz")]
    assert readers.suite_rows(spark, both, ROW, "drop").count() == 4
    with pytest.raises(Exception, match="bad JSON line"):
        readers.suite_rows(spark, both, ROW).collect()
    assert readers.json_lines(spark, both, ROW, complete_lines=True).count() == 4


def test_mistyped_lines_fail_and_only_unterminated_tails_go(spark, tmp_path):
    good, mistyped = json.dumps({"run_id": "a", "catalog_id": 1}), json.dumps({"run_id": "b", "catalog_id": "one"})
    (tmp_path / "x.jsonl").write_text(f"{good}\n{good}\n{good}")
    (tmp_path / "y.jsonl").write_text(f"{good}\n{mistyped}\n")
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), ROW, complete_lines=True).count() == 2
    assert readers.json_lines(spark, str(tmp_path / "x.jsonl"), ROW).count() == 3
    for complete in (False, True):
        with pytest.raises(Exception, match="bad JSON line"):
            readers.json_lines(spark, str(tmp_path / "y.jsonl"), ROW, complete_lines=complete).collect()
    with pytest.raises(Exception, match="bad JSON line"):
        readers.predictions(spark, str(tmp_path), ROW).collect()
    assert readers.json_lines(spark, str(tmp_path), ROW, "drop").count() == 4


def test_marked_lines(spark, tmp_path):
    rows = [{"run_id": f"r{i}", "catalog_id": 1, "group_id": "g"} for i in range(3)]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, rows)))
    marked = readers.containing(spark, str(tmp_path / "a.jsonl"), '"run_id": "r1"', ROW)
    assert [r["run_id"] for r in marked.collect()] == ["r1"]


def test_csv_with_mark_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "x.csv").write_bytes('﻿id,text\n1,"a ""quoted""\nline"\n2,b\n'.encode())
    got = {r["id"]: r["text"] for r in readers.csv(spark, str(tmp_path / "x.csv")).collect()}
    assert got == {"1": 'a "quoted"\nline', "2": "b"}


def test_tab_tuples(spark, tmp_path):
    (tmp_path / "x.tsv").write_text("nice place\t0,1 FOOD 2 3,4\t5,6 FOOD 2 7,8\t0,0 ROOM 1 0,0\nplain\nbad\tone two\n")
    good, bad = readers.tab_tuples(spark, str(tmp_path / "x.tsv"))
    assert {r["text"]: sorted(r["pairs"]) for r in good.collect()} == {"nice place": ["FOOD|2", "ROOM|1"], "plain": []}
    assert bad.count() == 1


def test_json_documents_and_list_or_scalar(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps([{"id": "a", "turns": [{"s": "U"}, {"s": "S"}]}, {"id": "b", "turns": []}], indent=1))
    s = T.StructType.fromDDL("id string, turns array<struct<s:string>>")
    docs = readers.json_documents(spark, str(tmp_path / "d.json"), s)
    assert docs.select("id", F.explode("turns")).count() == 2
    df = spark.createDataFrame([('["a","b"]',), ('"c"',), (None,)], "v string")
    assert [r[0] for r in df.select(readers.list_or_scalar("v")).collect()] == [["a", "b"], ["c"], []]


def test_prediction_folder_keeps_file_order(spark, tmp_path):
    from casewright.operators import results

    (tmp_path / "1.jsonl").write_text('{"run_id":"a","pred":"A"}\n{"run_id":"b","pred":"B"}\n')
    (tmp_path / "2.jsonl").write_text('{"run_id":"a","pred":null}\n{"run_id":"b","pred":"C"}\n{"run_id":"c","pred":null}\n')
    s = T.StructType.fromDDL("run_id string, pred string")
    got = results.latest_prediction(readers.predictions(spark, str(tmp_path), s), ["run_id"])
    assert {r["run_id"]: r["pred"] for r in got.collect()} == {"a": "A", "b": "C", "c": None}


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", 1, "g"), ("r2", 2, "h")], ROW)
    sinks.rows(df, str(tmp_path / "rows"))
    assert readers.parquet(spark, str(tmp_path / "rows"), ["run_id"], "catalog_id = 2").first()["run_id"] == "r2"
    sinks.to_parquet(df, str(tmp_path / "laid"))
    assert spark.read.parquet(str(tmp_path / "laid")).count() == 2
    sinks.export_json(df, str(tmp_path / "out"))
    assert readers.json_lines(spark, str(tmp_path / "out"), ROW).count() == 2
    sinks.append_results(df, str(tmp_path / "log"))
    sinks.append_results(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 4
    paths = sinks.export_run(df, df.limit(1), df, str(tmp_path / "runs"), "first")
    assert spark.read.json(paths["index"]).count() == 1
    with pytest.raises(Exception):
        sinks.report(df, str(tmp_path / "runs"), "index", "first")


def test_files_and_pins(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"hello")
    f = readers.files(spark, str(tmp_path), "*.bin").first()
    assert f["sha256"] == hashlib.sha256(b"hello").hexdigest() and f["length"] == 5
    rows = spark.createDataFrame([("b", "r2", "p2"), ("b", "r1", "p1")], "k string, run_id string, p string")
    got = digests.pinned_digests(rows, ["k"], "run_id", "p").first()
    assert got["run_ids_sha256"] == hashlib.sha256(b"r1\nr2\n").hexdigest()
    assert got["payloads_sha256"] == hashlib.sha256(b"r1 p1\nr2 p2\n").hexdigest()
    a = digests.row_set_fingerprint(rows, ["k"], "run_id", "p").first()["fingerprint"]
    b = digests.row_set_fingerprint(rows.orderBy("run_id"), ["k"], "run_id", "p").first()["fingerprint"]
    c = digests.row_set_fingerprint(rows.withColumn("p", F.lit("x")), ["k"], "run_id", "p").first()["fingerprint"]
    assert a == b != c


def test_requests_hide_gold(spark):
    cases = spark.createDataFrame([], schema.CASES)
    seen = facts.requests(cases).columns
    assert not {"expected", "metadata", "split"} & set(seen) and set(seen) == {"run_id", "state", "questions"}


def test_choice_case_checks_options(spark):
    df = spark.createDataFrame([(["x", "y", "z"], 1, "?"), ([str(i) for i in range(30)], 29, "?")], "o array<string>, g int, i string")
    got = facts.choice_case(df, "o", "g", "i").collect()
    assert got[0]["expected"] == {"q1": "B"} and got[1]["expected"] == {"q1": "option_29"}
    for bad in ((["x"], 0), (["x", "y"], 2)):
        with pytest.raises(Exception, match="bad choice case"):
            facts.choice_case(spark.createDataFrame([(*bad, "?")], "o array<string>, g int, i string"), "o", "g", "i").collect()


def test_semantic_labels_merge_equal_descriptions(spark):
    from casewright.functions import scoring

    crit = [("A", "yes"), ("B", "yes"), ("C", "no")]
    df = spark.createDataFrame([("choice", crit, x) for x in "ABCD"], "t string, c array<struct<option:string,descr:string>>, v string")
    got = [r[0] for r in df.select(scoring.semantic_label(F.col("t"), F.col("c"), F.col("v"))).collect()]
    assert got == ["yes", "yes", "no", "D"]


def test_scored_fields_allow_list(spark):
    f = spark.createDataFrame([("r", 56, "verdict"), ("r", 56, "is_phishing"), ("r", 56, "sig"), ("s", 57, "q")], "run_id string, catalog_id int, field string")
    unscored = spark.createDataFrame([("r", "sig")], "run_id string, field string")
    only = spark.createDataFrame([(56, "verdict")], "catalog_id int, field string")
    assert sorted(r["field"] for r in facts.scored_fields(f, unscored, only).collect()) == ["q", "verdict"]


def test_editions(spark):
    rows = spark.createDataFrame([(2, "2:keep"), (2, "2:gone"), (30, "v3:a"), (30, "a"), (48, "x"), (24, "m")], "catalog_id int, run_id string")
    retired = spark.createDataFrame([(48,)], "catalog_id int")
    replaced = spark.createDataFrame([(30, "v3:")], "catalog_id int, prefix string")
    subset = spark.createDataFrame([(2, "2:keep")], "catalog_id int, run_id string")
    got = sorted(r["run_id"] for r in editions.in_edition(rows, retired, replaced, subset).collect())
    assert got == ["2:keep", "m", "v3:a"]
    e = spark.createDataFrame([("1", "v1", False, "d1", None), ("2", "v2", True, "d2", "x"), ("2.1", "v2.1", False, "d2", "x")],
                              "edition string, alias string, is_default boolean, rows string, added string")
    assert editions.resolve_edition("v1", e).first()["edition"] == "1" and editions.resolve_edition(None, e).first()["edition"] == "2"
    with pytest.raises(ValueError):
        editions.resolve_edition("9", e)
    pairs = {(r[0], r[1]) for r in editions.compatible(e, ["rows", "added"]).collect()}
    assert ("2", "2.1") in pairs and ("1", "2") not in pairs


def test_cut_keeps_groups_of_excluded_rows(spark):
    rows = spark.createDataFrame([(2, "a", "r1"), (2, "a", "r2"), (2, "b", "r3"), (2, "c", "r4"), (9, "z", "r5")], "catalog_id int, group_id string, run_id string")
    subset = spark.createDataFrame([(2, "b")], "catalog_id int, group_id string")
    excluded = spark.createDataFrame([("r1",)], "run_id string")
    assert sorted(r["run_id"] for r in editions.cut_groups(rows, subset, excluded).collect()) == ["r1", "r2", "r3", "r5"]


def test_amounts_kinds_and_numbers(spark):
    cases = {"Rp 12.500": 12500.0, "1,234.50": 1234.5, "-300": None, "(45)": None, "12,50": 12.5, "abc": None, "75 z": 75.0, "@3.000": 3000.0, "0": None, "1.2.3": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["a"] for r in df.select("t", text.amount(F.col("t")).alias("a")).collect()} == cases
    kinds = {"12/03/1998": "date", "Jan 5": "date", "No. 4421": "number", "plain words": "text", "": "text"}
    df = spark.createDataFrame([(k,) for k in kinds], "t string")
    assert {r["t"]: r["k"] for r in df.select("t", text.text_kind(F.col("t")).alias("k")).collect()} == kinds
    df = spark.createDataFrame([("18.50",), ("7",), ("100",), ("-3",)], "t string")
    assert [r[0] for r in df.select(text.plain_number(F.col("t").cast("decimal(38,9)"))).collect()] == ["18.5", "7", "100", "-3"]


def test_receipt_shapes(spark):
    docs = [
        ("a", {"menu": {"nm": ["tea", "x"], "price": ["3.000", "9"], "sub": {"price": "500"}}, "total": [{"total_price": "1"}, {"total_price": "4.000"}], "sub_total": {"etc": ["10", "20"], "tax_price": "free"}}),
        ("b", {"menu": [{"nm": "rice", "price": "2.000"}, "junk"], "total": None}),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs], "id string, j string").select("id", F.parse_json("j").alias("r"))
    got = sorted((r["id"], r["kind"], r["amount"]) for r in receipts.receipt_amounts(df, "id", "r").collect())
    assert got == [("a", "menu_price", 9.0), ("a", "menu_price", 3000.0), ("a", "menu_sub_price", 500.0), ("a", "sub_etc", 10.0), ("a", "sub_etc", 20.0), ("a", "total_price", 4000.0), ("b", "menu_price", 2000.0)]
    assert sorted((r["name"], r["price"]) for r in receipts.receipt_items(df, "id", "r").collect()) == [("rice", 2000.0), ("tea", 3000.0)]
    there = {(r["id"], r["field"]): r["gold"] for r in receipts.field_presence(df, "id", "r", ["tax_price", "total_price"]).collect()}
    assert there == {("a", "total_price"): "A", ("b", "total_price"): "B", ("b", "tax_price"): "B"}


def test_receipt_texts_are_parsed_once(spark):
    """Each amount's pattern stands once in the optimized plan, not once for every place that looks at the amount."""
    df = spark.createDataFrame([("a", "{}")], "id string, j string").select("id", F.parse_json("j").alias("r"))
    for out in (receipts.receipt_amounts(df, "id", "r"), receipts.receipt_items(df, "id", "r"), receipts.field_presence(df, "id", "r", ["tax_price"])):
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") == 1 and plan.count("parse_json(") + plan.count("parseJson(") <= 1


def test_close_numbers(spark):
    from casewright.operators import distractors as distractor_numbers

    df = spark.createDataFrame([("12", ["12", "14", "x"]), ("45%", ["30%"]), ("0.50", []), ("-2", [])], "g string, p array<string>")
    for r in df.select("g", distractor_numbers.close_numbers(F.col("g"), F.col("p"), "s", F.col("g")).alias("d")).collect():
        assert len(set(r["d"])) == 3 and r["g"] not in r["d"]
        assert all(x.endswith("%") == r["g"].endswith("%") for x in r["d"])
    first = df.select(distractor_numbers.close_numbers(F.col("g"), F.col("p"), "s", F.col("g")).alias("d")).first()["d"]
    assert first[0] == "14"


def test_titles_match_in_any_normal_form(spark):
    refs = spark.createDataFrame([("q", ["Café", "Zoo", "Gone"])], "id string, t array<string>")
    docs = spark.createDataFrame([("Café", "coffee"), ("Zoo", "animals")], "title string, body string")
    got = joins.titled_documents(refs, docs, "id", "t", "title", "body").first()
    assert got["contents"][:2] == ["coffee", "animals"] and not got["hits_ok"]


def test_composite_key_must_be_unique(spark):
    left = spark.createDataFrame([("s", ["a", "b"]), ("s", ["c"])], "source string, id array<string>")
    right = spark.createDataFrame([("s", ["a", "b"], 1)], "source string, id array<string>, w int")
    assert sorted(r["matched"] for r in joins.by_composite_key(left, right, "source", "id").collect()) == [False, True]
    with pytest.raises(ValueError):
        joins.by_composite_key(left, right.unionByName(right), "source", "id")


def test_audit_failures_name_the_rows(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    audits.require(df, "n > 5", "fine")
    with pytest.raises(ValueError, match="'b'"):
        audits.require(df, "n > 1", "too many")


def test_first_of_identical_and_conflicts(spark):
    df = spark.createDataFrame([("x", 1, "yes"), ("x", 2, "yes"), ("y", 3, "yes"), ("y", 4, "no")], "p string, seq int, o string")
    kept, conflicts = audits.first_of_identical(df, F.col("p"), "seq", "o")
    assert [(r["seq"], r["copies"]) for r in kept.collect()] == [(1, 2)] and conflicts.count() == 1


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_ranges_give_every_line_and_its_place(spark, tmp_path, size):
    from casewright.sources import lines

    bodies = {"a.txt": b"one\ntwo\r\n\nlong line " + b"x" * 100 + b"\nlast", "b.txt": b"", "c.txt": b"\n", "d.txt": "é\nü\n".encode(), "_hidden": b"no\n", "e.txt": b"no end"}
    for name, body in bodies.items():
        (tmp_path / name).write_bytes(body)
    want = []
    for name, body in bodies.items():
        at = 0
        for part in [] if name.startswith("_") else body.splitlines(keepends=True):
            want.append((name, at, part.rstrip(b"\r\n").decode(), not part.endswith(b"\n")))
            at += len(part)
    got = [(r["file"].rsplit("/", 1)[1], r["start"], r["value"], r["torn"]) for r in lines.ranged_lines(spark, str(tmp_path), size=size).collect()]
    assert sorted(got) == sorted(want)


def test_readers_tell_what_does_not_fit(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,n\n1,2\n2,many\n3\n4,5\n")
    s = T.StructType.fromDDL("id int, n int")
    good, bad = readers.csv(spark, str(tmp_path / "x.csv"), s, "rejects")
    assert good.count() == 2 and sorted(r["value"] for r in bad.collect()) == ["2,many", "3"]
    assert readers.csv(spark, str(tmp_path / "x.csv"), s, "drop").select("id").count() == 2
    with pytest.raises(Exception, match="bad CSV row"):
        readers.csv(spark, str(tmp_path / "x.csv"), s).select("id").collect()
    with pytest.raises(Exception, match="bad CSV row"):
        readers.csv(spark, str(tmp_path / "x.csv")).count()
    docs = tmp_path / "docs"
    docs.mkdir()
    (docs / "a.json").write_text('[{"id": 1,\n "n": 2}]')
    (docs / "b.json").write_text('{"id": 3, "n": "many"}')
    (docs / "c.json").write_text('[{"id": 4,')
    good, bad = readers.json_documents(spark, str(docs), s, "rejects")
    assert [r["id"] for r in good.collect()] == [1] and bad.count() == 2
    with pytest.raises(Exception, match="bad JSON document"):
        readers.json_documents(spark, str(docs), s).select("id").collect()
    (tmp_path / "l.jsonl").write_text('{"id": 1, "n": 7}\n{"id": 2, "n": "7"}\n{"id": 3}\n')
    with pytest.raises(Exception, match="bad JSON line"):
        readers.containing(spark, str(tmp_path / "l.jsonl"), "7", s).collect()
    assert [r["id"] for r in readers.containing(spark, str(tmp_path / "l.jsonl"), "7", s, "drop").collect()] == [1]
