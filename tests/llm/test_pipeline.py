"""Each stage of the pipeline, on what its predecessor kept, against a plain restatement."""

import collections

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from casewright.llm import toxicity
from tests.conftest import SF
from tests.llm.brute import linked, personal

WHITE = str.maketrans("", "", " \t\n\x0b\x0c\r")


def masked(text):
    out, at = "", 0
    for start, _, kind, end in personal(text):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = [{r.doc_id: r.text or "" for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append({r.doc_id: r.text or "" for r in docs.collect()})
    score = model.scorer()
    assert kept[1] == {d: t for d, t in kept[0].items() if score(t) < 0.5} and len(kept[1]) < len(kept[0])

    best = collections.defaultdict(list)
    for d, t in kept[1].items():
        best[t.translate(WHITE)].append((-len(t), d))
    assert set(kept[2]) == {min(v)[1] for v in best.values()} and len(kept[2]) < len(kept[1])

    ids = sorted(kept[2])
    groups = linked([kept[2][d] for d in ids], 5, 80)
    assert set(kept[3]) == {d for i, d in enumerate(ids) if groups[i][1] == i} and len(kept[3]) < len(kept[2])

    assert set(kept[4]) == set(kept[3])
    assert all(t == masked(kept[3][d]) for d, t in kept[4].items() if "[other]" not in t)
    assert sum(t != kept[3][d] for d, t in kept[4].items()) > 0
    assert all(r.n_chars == len(r.text) for r in docs.collect())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    length = collections.Counter()
    for r in packed:
        length[r.doc_id] += r.length
    assert length == {d: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for d, t in kept[4].items()}
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed))
