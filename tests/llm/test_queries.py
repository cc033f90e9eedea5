"""Registered queries over whole tables: against their SQL, the libraries, or brute force."""

import collections
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry
from casewright.llm.registry import ORACLES, QUERIES
from tests.conftest import SF
from tests.llm.brute import licence, linked, personal, sha
from tools.check_oracle import rows_of

entry.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def texts(con):
    return dict(con.execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    cur = con.execute(ORACLES[name])
    names = [c[0] for c in cur.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(names, cur.fetchall())


def test_packing(spark, texts):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in texts.items()}
    pieces, used = collections.defaultdict(list), collections.defaultdict(list)
    for r in QUERIES["op4_packing"](spark, SF).collect():
        part = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        used[r.sequence_id].append((r.offset, r.length))
    for doc, own in ids.items():
        assert sum(n for _, n in pieces[doc]) == len(own) and sorted(pieces[doc])[0][0] == 0
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    total = sum(map(len, ids.values()))
    assert len(used) <= 1.03 * total / 2048 + 1


def test_piece_codec(spark, texts):
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    rows = QUERIES["op5_piece_codec"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_linked_documents(spark, texts):
    ids = sorted(texts)
    expected = {d: (n, ids[c]) for d, (n, c) in zip(ids, linked([texts[d] for d in ids]), strict=True)}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op8_ngram_join"](spark, SF).collect()} == expected


def test_personal_data(spark, texts):
    rows = QUERIES["op9_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = personal(texts[r.doc_id])
        joined = [f"{kind}:{start}:{end}" for start, _, kind, end in spans]
        assert r.base_sha256 == sha(",".join(joined)) and set(joined) <= set(r.spans.split(",")) | {""}
        counts = collections.Counter(kind for _, _, kind, _ in spans)
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in ("email", "ip", "card", "phone"))


def test_licences(spark, texts):
    rows = QUERIES["op10_license_scan"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == licence(texts[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


@pytest.mark.parametrize(("name", "label", "column"), [("op1_toxicity", "toxic", "predicted"), ("op3_site_quality", "quality", "keep")])
def test_held_out_accuracy(spark, name, label, column):
    folder = "/root/testdata/sf0.01"
    known = dict(duckdb.sql(f"SELECT doc_id, {label} FROM '{folder}/labels.parquet'").fetchall())
    rows = QUERIES[name](spark, folder).collect()
    assert len(rows) == 1000 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [(int(r[column]), known[r.doc_id]) for r in rows if r.held_out and r.doc_id in known]
    assert sum(a == b for a, b in held) / len(held) > 0.9
    # Clean documents are left alone.
    assert sum(a != b for a, b in held if b == (label == "quality")) <= 0.05 * len(held)
