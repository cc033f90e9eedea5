import collections
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.operators import inference
from casewright.plans import evaluate
from casewright.plans.predictors import ByLength, Uniform
from casewright.streaming import result_log

ASKED = json.dumps({"q": {"type": "choice", "instructions": "?", "criteria": {"0": "short", "1": "long"}}})


class Flaky(ByLength):
    def __call__(self, state, questions):
        if "boom" in state["text"]:
            raise RuntimeError("broken")
        if "huge" in state["text"]:
            raise RuntimeError("http 400: too many tokens")
        if "liar" in state["text"]:
            return {"answers": {"q": {"type": "choice", "choice": "7", "probabilities": {"0": 1.0}}}}, None
        return super().__call__(state, questions)


class Broken(ByLength):
    def __call__(self, state, questions):
        raise RuntimeError("always")


class OnDevice(ByLength):
    def __call__(self, state, questions):
        raise RuntimeError("device-side assert triggered")


def requests(spark, texts):
    rows = [(f"r{i}", json.dumps({"text": t}), ASKED) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "run_id string, state string, questions string")


def number():
    return F.substring("run_id", 2, 9).cast("int")


def test_every_request_gets_one_row(spark):
    texts = ["a" * 30, "a" * 900, "boom", "huge", "liar", "tiny", "a" * 30_000]
    got = {r["run_id"]: r for r in inference.run(requests(spark, texts), "flaky", lambda: Flaky(shortest=5)).collect()}
    status = [got[f"r{i}"]["status"] for i in range(7)]
    assert status == ["ok", "ok", "error", "unsupported", "error", "abstained", "unsupported"]
    assert got["r2"]["exception"] == "RuntimeError" and "broken" in got["r2"]["traceback"]
    typed = {r["run_id"]: r["answers"] for r in inference.parsed_log(inference.run(requests(spark, texts), "flaky", Flaky)).collect()}
    assert typed["r1"]["q"]["choice"] == "1" and typed["r2"] is None


def test_batches_do_not_mix_keys(spark):
    class Watching(Uniform):
        def batch(self, payloads):
            assert len({p["state"]["k"] for p in payloads}) == 1
            return super().batch(payloads)

    rows = [(f"r{i}", json.dumps({"k": i % 3}), ASKED, i % 3) for i in range(30)]
    df = spark.createDataFrame(rows, "run_id string, state string, questions string, k int").coalesce(1)
    out = inference.run(df, "u", Watching, batch_key="k")
    assert {r["status"] for r in out.collect()} == {"ok"} and out.count() == 30


def test_resume_runs_only_what_is_missing_or_failed(spark, tmp_path):
    log = str(tmp_path / "log")
    rows = requests(spark, ["a" * 30, "boom", "a" * 900, "huge", "a" * 40])
    inference.run_in_waves(rows, "flaky", Flaky, log, waves=2, limit=3)
    assert spark.read.parquet(log).count() == 3
    inference.run_in_waves(rows, "flaky", Flaky, log, waves=2)
    first = spark.read.parquet(log)
    assert first.select("run_id").distinct().count() == 5
    before = first.groupBy("run_id").count().collect()
    inference.run_in_waves(rows, "flaky", ByLength, log, waves=2)
    after = {r["run_id"]: r["count"] for r in spark.read.parquet(log).groupBy("run_id").count().collect()}
    grown = {r["run_id"] for r in before if after[r["run_id"]] > r["count"]}
    assert grown == {"r1"}


def test_breaker_stops_a_run_without_a_success(spark, tmp_path):
    rows = requests(spark, ["x" * 30] * 12)
    with pytest.raises(inference.TooManyFailures, match="without a success"):
        inference.run_in_waves(rows, "broken", Broken, str(tmp_path / "a"), waves=2)
    with pytest.raises(inference.TooManyFailures, match="device"):
        inference.run_in_waves(rows, "device", OnDevice, str(tmp_path / "b"), waves=2)


def test_predictors_load_by_name():
    assert inference.load_predictor("casewright.plans.predictors:Uniform") is Uniform
    with pytest.raises(ValueError):
        inference.load_predictor("Uniform")


def test_budget_merges_with_the_run_before(spark):
    s = "image_pixels long, image_tokens long"
    one = inference.usage_budget(spark.createDataFrame([(10, None), (30, 5)], s))
    two = inference.usage_budget(spark.createDataFrame([(20, 9)], s), one).first()
    assert tuple(two) == (30, 9, 2)


def test_evaluate_end_to_end(spark, tmp_path):
    crit = [("0", "short"), ("1", "long")]
    rows = [(f"r{i}", 1, f"g{i // 2}", "t", json.dumps({"text": "a" * n}), [("q", "choice", "?", crit)], {"q": gold})
            for i, (n, gold) in enumerate([(30, "0"), (900, "1"), (40, "1"), (50, "0"), (30_000, "1"), (60, "0")])]
    cases = spark.createDataFrame(
        rows, "run_id string, catalog_id int, group_id string, track string, state string, "
        "questions array<struct<key:string,type:string,instructions:string,criteria:array<struct<option:string,descr:string>>>>, expected map<string,string>",
    )
    got = evaluate.evaluate(cases, "by-length", ByLength, str(tmp_path / "log"), waves=2).where("track = '*'").first()
    assert (got["requests"], got["answered"], got["unsupported"], got["scored_requests"]) == (6, 5, 1, 4)
    assert got["score"] == pytest.approx(3 / 4)


def test_stream_keeps_the_last_record_per_run(spark, tmp_path):
    s = T.StructType.fromDDL("run_id string, seq long, status string, pred string")
    src, out = tmp_path / "src", str(tmp_path / "out")
    src.mkdir()

    def add(name, rows):
        (src / name).write_text("".join(json.dumps(r) + "\n" for r in rows))

    def drain(pred=None, tag="a"):
        stream = result_log.read_log(spark, str(src), s)
        result_log.keep_latest(stream, ["run_id"], "seq", out + tag, str(tmp_path / ("ck" + tag)), pred).awaitTermination()
        return {r["run_id"]: r["status"] for r in result_log.read_latest(spark, out + tag, ["run_id"], "seq", pred).collect()}

    add("1.json", [{"run_id": "a", "seq": 1, "status": "error"}, {"run_id": "b", "seq": 2, "status": "ok", "pred": "X"}])
    assert drain() == {"a": "error", "b": "ok"}
    add("2.json", [{"run_id": "a", "seq": 3, "status": "ok", "pred": "Y"}, {"run_id": "b", "seq": 4, "status": "error"}])
    assert drain() == {"a": "ok", "b": "error"}
    assert drain("pred", "b") == {"a": "ok", "b": "ok"}
    result_log.fold_batches(spark, out + "a", str(tmp_path / "folded"), ["run_id"], "seq")
    assert spark.read.parquet(str(tmp_path / "folded")).count() == 2


def test_progress_events_are_small_records():
    seen = []
    listener = result_log.ProgressEvents(seen.append)

    class Event:
        id, exception = "q", None

    listener.onQueryStarted(Event)
    listener.onQueryTerminated(Event)
    assert [e["event"] for e in seen] == ["started", "complete"]


def test_run_record(spark):
    row = inference.run_record(spark, "by-length", {"cut": 3}, "abc").first()
    assert row["engine"] == "by-length" and json.loads(row["options"]) == {"cut": 3}


class Slow(Flaky):
    """Fails every call, after a moment."""

    def __call__(self, state, questions):
        import time

        time.sleep(0.02)
        raise ConnectionError("down")


def test_errors_of_all_tasks_stop_a_wave(spark, tmp_path):
    """No task has as many errors as the limit, all together have; the recorded rows stay."""
    rows = requests(spark, ["some text"] * 400).repartition(8)
    out = inference.run(rows, "down", Slow, chunk=1, stop_errors=24, stop_folder=str(tmp_path / "stop")).collect()
    assert 24 <= len(out) <= 24 + 8 and {r["status"] for r in out} == {"error"}
    assert max(collections.Counter(r["run_id"] for r in out).values()) == 1


def test_one_success_keeps_all_tasks_going(spark, tmp_path):
    stop = inference.SharedStop(str(tmp_path / "s"), 3, 0)
    other = inference.SharedStop(str(tmp_path / "s"), 3, 1)
    stop.tell(2, False, False)
    assert not other.stopped()
    again = inference.SharedStop(str(tmp_path / "s"), 3, 0)
    again.tell(2, False, False)  # the same task, tried again
    assert not other.stopped()
    other.tell(1, False, False)
    assert stop.stopped()
    other.tell(0, True, False)
    assert not stop.stopped() and not other.stopped()
    other.tell(0, False, True)
    assert stop.stopped()


def test_requests_without_a_batch_key_get_their_row(spark):
    texts = ["long enough to be answered"] * 30
    df = requests(spark, texts).withColumn("k", F.when(number() % 3 != 0, number() % 2))
    got = inference.run(df, "flaky", Flaky, batch_key="k", chunk=4)
    assert got.count() == 30 == got.select("run_id").distinct().count()


def test_a_call_may_go_on_in_the_next_batch(spark):
    """Arrow batches end anywhere; calls of one key are still whole."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        df = requests(spark, ["text"] * 40).coalesce(1).withColumn("k", F.floor(number() / 10))
        got = inference.run(df, "counted", Counted, batch_key="k")
        assert {r["raw_output"] for r in got.collect()} == {"10"}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


class Counted(inference.Predictor):
    """Says how many requests came with one call."""

    def batch(self, payloads):
        from casewright.plans.predictors import Uniform

        return [(Uniform._answer(p["questions"]), len(payloads)) for p in payloads]


def test_a_batch_writes_only_the_keys_it_changes(spark, tmp_path):
    """Forty keys over nine batches of three; folded every fourth batch, folders of old folds go."""
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType()), T.StructField("seq", T.LongType())])
    src, out, kept = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "counts")
    src.mkdir()
    truth, counts = {}, collections.Counter()
    for batch in range(9):
        lines = []
        for j in range(3):
            key = f"k{(batch * 7 + j * 3) % 40}"
            # Every third record is older than what the key may have.
            record = {"k": key, "v": batch * 10 + j, "seq": 100 + batch if j else batch}
            if record["seq"] >= truth.get(key, record)["seq"]:
                truth[key] = record
            counts[key] += 1
            lines.append(json.dumps(record))
        (src / f"{batch}.json").write_text("\n".join(lines))
        for run, target in ((result_log.keep_latest, out), (result_log.live_counts, kept)):
            stream = result_log.read_log(spark, str(src), schema)
            more = (["k"], "seq", target) if run is result_log.keep_latest else (["k"], target)
            run(stream, *more, str(tmp_path / run.__name__), fold=4).awaitTermination()
        written = spark.read.parquet(f"{out}/changes/log_batch={batch}")
        assert {r["k"] for r in written.collect()} == {json.loads(line)["k"] for line in lines}
    got = {r["k"]: (r["v"], r["seq"]) for r in result_log.read_latest(spark, out, ["k"], "seq").collect()}
    assert got == {k: (r["v"], r["seq"]) for k, r in truth.items()}
    assert {r["k"]: r["n"] for r in result_log.read_counts(spark, kept, ["k"]).collect()} == dict(counts)
    assert result_log._numbers(spark, f"{out}/base", "log_upto") == [3, 7]
    assert min(result_log._numbers(spark, f"{out}/changes", "log_batch")) == 4
