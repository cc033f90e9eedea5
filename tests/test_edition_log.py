"""Values and index of an edition out of a result log, every rule against a plain restatement."""

import json
import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from casewright.operators import inference
from casewright.plans import evaluate

QUESTION = "array<struct<key:string,type:string,instructions:string,criteria:array<struct<option:string,descr:string>>>>"
CASES = (
    f"run_id string, catalog_id int, group_id string, track string, state string, questions {QUESTION}, expected map<string,string>, "
    "accepted map<string,array<string>>, outcomes map<string,double>, event double, documents map<string,string>, cluster string"
)
DIM = "catalog_id int, area_id string, in_index boolean, rule string, gold_weight double, chance double, baseline double, best double, fixed double, metric string"
ABC = [("A", "x"), ("B", "y"), ("C", "z")]


class Stated(inference.Predictor):
    """Answers as the state says, or fails."""

    def __call__(self, state, questions):
        if state.get("fail"):
            raise RuntimeError("down")
        answers = {}
        for key, q in questions.items():
            said = state["say"][key]
            if q["type"] == "noul":
                answers[key] = {"type": "noul", "noul": said}
            else:
                others = [o for o in q["criteria"] if o != said]
                answers[key] = {"type": "choice", "choice": said, "probabilities": {said: 0.8, **{o: 0.2 / len(others) for o in others}}}
        return {"answers": answers}, None


def case(n, i, group, say, gold, kind="choice", fail=False, **more):
    asked = [(k, kind, "?", ABC if kind == "choice" else []) for k in say]
    own = {k: more.get(k) for k in ("accepted", "outcomes", "event", "documents", "cluster")}
    return (f"{n}:{i}", n, group, more.get("track", "t"), json.dumps({"say": say, "fail": fail}), asked, gold, *own.values())


def rows():
    out = []
    for i in range(12):  # 31: accuracy by track, with ties; 45: shown accuracy; 57: added accuracy
        say, gold = "ABC"[i % 3], "ABC"[(i * i) % 3]
        out.append(case(31, i, f"g{i // 2}", {"q": say}, {"q": gold}, accepted={"q": [gold, "C"]}, fail=i == 5))
        out.append(case(45, i, f"g{i}", {"q": say}, {"q": gold}, fail=i == 7))
        out.append(case(57, i, f"g{i}", {"q": say}, {"q": gold}))
        out.append(case(22, i, f"g{i}", {"q": say}, {"q": gold}, cluster=f"song{i % 5 == 0}"))  # by cluster
        out.append(case(1, i, f"g{i // 3}", {"a": say, "b": "A"}, {"a": gold, "b": "A"}, fail=i == 11))  # whole case by track
        out.append(case(11, i, f"g{i}", {"q": say}, {"q": gold}, fail=i == 2))  # conservative F1 by track
        out.append(case(6, i, f"g{i}", {"q": say}, {}, outcomes={"A": 1.0, "B": 0.25, "C": 0.1 * i}, fail=i == 3))  # routing
        out.append(case(48, i, f"g{i}", {"q": (i % 4) / 4}, {}, "noul", event=float(i % 2)))  # forecast
    for g in range(3):  # 36: ranking, five documents in two requests
        for part, docs in enumerate((["d0", "d1", "d2"], ["d3", "d4"])):
            say = {f"doc_{d}": ((g + 2) * (int(d[1]) + 3) % 7) / 7 for d in docs}
            out.append(case(36, f"{g}{part}", f"q{g}", say, {}, "noul", documents={f"doc_{d}": d for d in docs}, fail=g == 2 and part == 1))
    return out


RELEVANT = {("q0", "d1"): 2, ("q0", "d4"): 1, ("q1", "d0"): 1, ("q1", "lost"): 1, ("q2", "d3"): 1}
BENCHMARKS = [
    (31, "a", "track", "accuracy", 0.1, None), (45, "a", "display", "accuracy", 0.3, None), (57, "a", "added", "accuracy", 0.2, None),
    (22, "b", "track", "accuracy", None, None), (1, "b", "track", "case_exact", None, None), (11, "b", "track", "macro_f1", 0.25, None),
    (6, "c", "track", "mean_value", None, None), (48, "c", "loss", "mean_value", None, 0.25), (36, "c", "track", "mean_value", None, None), (9, "c", "display", "case_exact", 0.0, None),
]


@pytest.fixture(scope="module")
def board(spark, tmp_path_factory):
    cases = spark.createDataFrame(rows(), CASES)
    dim = spark.createDataFrame([(n, a, True, r, None, c, b, 0.0 if b else None, None, m) for n, a, r, m, c, b in BENCHMARKS], DIM)
    qrels = spark.createDataFrame([(36, q, d, r) for (q, d), r in RELEVANT.items()], "catalog_id int, group_id string, doc_id string, rel int")
    log = str(tmp_path_factory.mktemp("edition") / "log")
    values, index = evaluate.evaluate_edition(cases, dim, "stated", Stated, log, 2, qrels)
    return cases, dim, log, {r["catalog_id"]: r for r in values.collect()}, index.first()


def skill(raw, chance):
    return max(0.0, min(1.0, (raw - chance) / (1 - chance)))


def ndcg(rel, ranking):
    gain = lambda ds: sum((2 ** rel.get(d, 0) - 1) / math.log2(i + 2) for i, d in enumerate(ds[:10]))
    return gain(ranking) / gain(sorted(rel, key=lambda d: -rel[d]))


def plain():
    by = defaultdict(list)
    for r in rows():
        state = json.loads(r[4])
        by[r[1]].append({"group": r[2], "say": state["say"], "ok": not state["fail"], "gold": r[6], "accepted": r[7], "outcomes": r[8], "event": r[9], "cluster": r[11]})
    for rs in by.values():
        for r in rs:
            r["done"] = all(x["ok"] for x in rs if x["group"] == r["group"])
    mean = lambda xs: sum(xs) / len(xs)
    out = {}
    rs = by[31]
    raw = mean([float(r["done"] and r["say"]["q"] in r["accepted"]["q"]) for r in rs])
    out[31] = (round(raw, 4), round(skill(raw, mean([len(r["accepted"]["q"]) / 3 for r in rs])), 4))
    rs = by[45]
    shown = round(mean([float(r["say"]["q"] == r["gold"]["q"]) for r in rs if r["done"]]), 4) * sum(r["ok"] for r in rs) / len(rs)
    out[45] = (shown, skill(shown, 0.3))
    rs = by[57]
    added = round(mean([float(r["say"]["q"] == r["gold"]["q"]) for r in rs]), 4)
    out[57] = (added, round(skill(added, 0.2), 4))
    rs = by[22]
    raw = mean([mean([float(r["say"]["q"] == r["gold"]["q"]) for r in rs if r["cluster"] == c]) for c in sorted({r["cluster"] for r in rs})])
    out[22] = (round(raw, 4), round(skill(raw, 1 / 3), 4))
    groups = sorted({r["group"] for r in by[1]})
    raw = mean([float(all(r["done"] and r["say"] == r["gold"] for r in by[1] if r["group"] == g)) for g in groups])
    chance = mean([(1 / 3) ** (2 * sum(r["group"] == g for r in by[1])) for g in groups])
    out[1] = (round(raw, 4), round(skill(raw, chance), 4))
    label = dict(ABC)
    pairs = [(label[r["gold"]["q"]], label[r["say"]["q"]] if r["done"] else None) for r in by[11]]
    f1 = []
    for k in "xyz":
        hit = sum(g == p == k for g, p in pairs)
        both = sum(g == k and p is not None for g, p in pairs) + sum(p == k or p is None for _, p in pairs)
        f1.append(2 * hit / both if both else 0.0)
    out[11] = (round(mean(f1), 4), round(skill(mean(f1), 0.25), 4))
    raw = mean([r["outcomes"][r["say"]["q"]] if r["done"] else 0.0 for r in by[6]])
    out[6] = (round(raw, 4), round(skill(raw, mean([mean(list(r["outcomes"].values())) for r in by[6]])), 4))
    loss = mean([(r["say"]["q"] - r["event"]) ** 2 for r in by[48]])
    kept = max(0.0, min(1.0, (0.25 - round(loss, 4)) / 0.25))
    out[48] = (kept, kept)
    found, chances = [], []
    for q in ("q0", "q1", "q2"):
        rel = {d: v for (g, d), v in RELEVANT.items() if g == q}
        probs = {k.split("_")[1]: p for r in by[36] if r["group"] == q for k, p in r["say"].items()}
        found.append(ndcg(rel, sorted(probs, key=lambda d: (-probs[d], d))) if q != "q2" else 0.0)
        reach = sum(1 / math.log2(i + 2) for i in range(len(probs)))
        ideal = sum((2 ** v - 1) / math.log2(i + 2) for i, v in enumerate(sorted(rel.values(), reverse=True)[:10]))
        chances.append(mean([2 ** rel.get(d, 0) - 1 for d in probs]) * reach / ideal)
    out[36] = (round(mean(found), 4), round(skill(mean(found), mean(chances)), 4))
    out[9] = (0.0, 0.0)
    return out


def test_every_rule_out_of_a_log(board):
    *_, values, _ = board
    want = plain()
    assert set(values) == set(want)
    for n, (raw, own) in want.items():
        assert (values[n]["raw"], values[n]["skill"]) == pytest.approx((raw, own), abs=1e-9), n


def test_index_out_of_a_log(board):
    *_, index = board
    want, areas = plain(), defaultdict(list)
    for n, area, *_ in BENCHMARKS:
        areas[area].append(want[n])
    means = [[sum(v[i] for v in vs) / len(vs) for i in (0, 1)] for vs in areas.values()]
    assert index["balanced_raw"] == pytest.approx(100 * sum(m[0] for m in means) / 3)
    assert index["balanced_skill"] == pytest.approx(100 * sum(m[1] for m in means) / 3)


def test_a_rule_without_values_fails(spark, board):
    cases, dim, log, *_ = board
    done = inference.read_log(spark, log)
    with pytest.raises(ValueError, match="48"):
        evaluate.edition_from_log(cases.where("catalog_id <> 36").withColumn("event", F.lit(None).cast("double")), done, dim)
    with pytest.raises(ValueError, match="judgements"):
        evaluate.edition_from_log(cases, done, dim)
