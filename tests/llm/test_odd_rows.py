"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from casewright.llm import exact_dedup, license_scan, line_dedup, ngram_join, packing, pii, piece_codec, site_quality, topk_search, toxicity
from casewright.llm.rows import numbered
from tests.conftest import SF
from tests.llm.brute import licence, linked, personal


def labels(spark):
    return spark.createDataFrame([(k, k % 2, k % 3 == 0) for k in range(20)] + [(None, 1, True), (5, None, None)], "doc_id long, quality int, toxic boolean").select(
        "doc_id", "quality", F.col("toxic").cast("int").alias("toxic")
    )


def texts_of(df):
    return sorted((r.text or "") for r in df.collect())


def test_exact_dedup(odd, nothing):
    kept = exact_dedup.dedup(odd)
    assert kept.columns == odd.columns and exact_dedup.dedup(nothing).count() == 0
    plain = collections.defaultdict(list)
    for r in odd.collect():
        key = "".join(c for c in (r.text or "") if c not in " \t\n\x0b\x0c\r")
        plain[key].append((-len(r.text or ""), r.doc_id is None, r.doc_id))
    assert sorted((-len(r.text or ""), r.doc_id is None, r.doc_id) for r in kept.collect()) == sorted(min(v) for v in plain.values())


def test_heavy_digests_do_not_change_the_result(odd):
    rows = exact_dedup.digests(odd)
    results = [sorted(map(str, exact_dedup.mark(rows, s).select("row", "id", "digest", "group_size", "keep_id", "kept").collect())) for s in (0.5, 0.2, 0.01)]
    assert results[0] == results[1] == results[2] and len(results[0]) == odd.count()


def test_packing(odd, nothing):
    rows = packing.pack(odd, capacity=64, group=7).collect()
    assert packing.pack(nothing).count() == 0
    tokens = sum(r.length for r in rows)
    assert sum(r.doc_tokens for r in rows if r.start == 0) == tokens
    assert sum(1 for r in rows if r.start == 0) == odd.count()
    room = collections.Counter()
    for r in rows:
        room[r.sequence_id] += r.length
    assert max(room.values()) <= 64
    assert {r.doc_tokens for r in rows if r.doc_id in (0, 2, 4)} == {1}


def test_first_fit_decreasing_fills_the_first_sequence_with_room():
    import numpy as np

    lengths = np.array([5, 9, 10, 3, 7, 2, 10, 1])
    sequence, offset = packing.first_fit_decreasing(lengths, 10)
    bins: list[list[int]] = []
    expected = {}
    for i in sorted((i for i in range(8) if lengths[i] < 10), key=lambda i: (-lengths[i], i)):
        b = next((b for b, own in enumerate(bins) if sum(own) + lengths[i] <= 10), None)
        if b is None:
            bins.append([])
            b = len(bins) - 1
        expected[i] = (b, sum(bins[b]))
        bins[b].append(int(lengths[i]))
    assert {i: (sequence[i], offset[i]) for i in expected} == expected
    assert len({sequence[2], sequence[6]}) == 2 and min(sequence[2], sequence[6]) == len(bins)


def test_piece_codec(odd, nothing):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = piece_codec.round_trip(odd.withColumn("ids", F.lit(1))).collect()
    expected = [library.encode(r.text or "") for r in odd.collect()]
    assert sorted(map(list, (r.ids for r in got))) == sorted(expected)
    assert sorted(r.decoded for r in got) == sorted(library.decode(i) for i in expected)
    assert piece_codec.round_trip(nothing).count() == 0


def test_piece_codec_on_random_strings():
    import random

    import public_tokenizers

    codec = piece_codec.PieceCodec(public_tokenizers.path("piece_bpe_32k.model"))
    rng = random.Random(9)
    parts = [" ", "  ", "▁", "a", "th", "ing", "\n", "\t", "é", "門", "ñ", "😀", "\x00", ".", "!!", "(", "0", "ß", "́", "　", "<s>", "oo"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert codec.encode(text) == codec.library.encode(text), text
    for n in range(1, 70):
        assert codec.encode(" " * n) == codec.library.encode(" " * n)


@pytest.mark.parametrize(("words", "percent", "limit"), [(3, 90, 3_000_000), (3, 90, 120), (2, 60, 60), (5, 80, 3_000_000)])
def test_linked_groups(odd, nothing, words, percent, limit):
    rows = {r.row: r for r in ngram_join.near_groups(odd, words=words, percent=percent, limit=limit).collect()}
    places = numbered(odd, "place").select("place", "doc_id", "text").collect()
    expected = linked([r.text for r in places], words, percent)
    groups = collections.defaultdict(list)
    for r, (_, c) in zip(places, expected, strict=True):
        groups[c].append((r.doc_id is None, r.doc_id, r.place))
    for r, (n, c) in zip(places, expected, strict=True):
        best = min(groups[c])
        assert (rows[r.place].n_shingles, rows[r.place].component_id, rows[r.place].keep_row) == (n, best[1], best[2])
    kept = ngram_join.keep_one(odd, words=words, percent=percent)
    assert kept.columns == odd.columns and kept.count() == len(groups)
    assert ngram_join.near_groups(nothing).count() == 0


def test_prefix_tree_finds_all_partners():
    import numpy as np

    rng = np.random.default_rng(4)
    base = [rng.choice(200, 40, replace=False) for _ in range(4)]
    grams = [np.unique(np.concatenate([rng.permutation(base[k % 4])[: rng.integers(30, 41)], rng.choice(300, 3)])).astype(np.uint64) for k in range(80)]
    for percent in (60, 80, 90):
        root = list(range(80))

        def find(i, root=root):
            while root[i] != i:
                i = root[i]
            return i

        for i in range(80):
            for j in range(i):
                n = len(np.intersect1d(grams[i], grams[j]))
                if 100 * n >= percent * (len(grams[i]) + len(grams[j]) - n):
                    root[find(i)] = find(j)
        links = ngram_join.tree_links(grams, list(range(80)), np.ones(80, bool), percent)
        own = list(range(80))
        for a, b in links:
            assert find(a) == find(b)
            own[find(a, own)] = find(b, own)
        assert len({find(i, own) for i in range(80)}) == len({find(i) for i in range(80)}) == 80 - len(links)


def test_personal_data(odd, nothing):
    rows = {r.row: r.spans for r in pii.find(odd).collect()}
    for r in numbered(odd, "place").collect():
        assert [(s.start, s.kind, s.end) for s in rows[r.place] if s.base] == [(a, k, e) for a, _, k, e in personal(r.text)]
    masked = pii.mask(odd)
    assert masked.columns == odd.columns and masked.count() == odd.count() and pii.mask(nothing).count() == 0
    assert masked.where("text LIKE '%[email], [ip]; [card] [phone]%'").count() == 1
    assert masked.where("text IS NULL").count() == odd.where("text IS NULL").count()


def test_contexts_of_seeds_find_unseen_identifiers(spark, tmp_path):
    seeds = [f"write to user{k}x@mail.example.com today" for k in range(30)]
    odd_ones = ["write to ACCT7788XKQ9 today", "the price is 99887766A5 euros", "the price is 12345678B9 euros"]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(list(enumerate(seeds + odd_ones)), "doc_id long, text string").write.parquet(path)
    found = {r.doc_id: [s.kind for s in r.spans] for r in pii.find(spark.read.parquet(path)).collect()}
    assert found[30] == ["other"] and found[31] == found[32] == [] and found[3] == ["email"]


def test_accepted_identifiers_bring_in_new_contexts(spark):
    # Seeds know the first context; each further one is known only through identifiers that were found before.
    steps = [("write to", "today", [f"user{k}x@mail.example.com" for k in range(30)] + [f"acct77{k}xkq" for k in range(30)])]
    steps += [("the ticket", "closed", [f"acct77{k}xkq" for k in range(30)] + [f"ordr55{k}zzt" for k in range(30)])]
    steps += [("one parcel", "arrived", [f"ordr55{k}zzt" for k in range(30)] + ["pack3344uvw"]), ("the price", "euros", ["99887766a5", "12345678b9"])]
    rows = [(hit, "@" in hit, f"{left} ", f" {right}") for left, right, hits in steps for hit in hits]
    found = {r.instance for r in pii.bootstrap(spark.createDataFrame(rows, "hit string, base boolean, tail string, head string")).collect()}
    assert found == {f"acct77{k}xkq" for k in range(30)} | {f"ordr55{k}zzt" for k in range(30)} | {"pack3344uvw"}


def test_licences(odd, nothing):
    got = sorted(map(str, ((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan.scan(odd).collect())))
    assert got == sorted(map(str, ((r.doc_id, *licence(r.text)) for r in odd.collect())))
    assert license_scan.scan(nothing).count() == 0


def test_notice_with_a_changed_word_is_still_found(spark):
    notice = dict((label, text) for text, label in license_scan.NOTICES if len(text.split()) > 20)["mit"].split()
    changed = ["lorem"] * 9 + notice[:12] + ["inserted"] + notice[12:30] + notice[31:] + ["ipsum"] * 5
    plain = "this is free software and the documentation of the software is in the files " * 5
    docs = spark.createDataFrame([(1, " ".join(changed)), (2, plain)], "doc_id long, text string")
    rows = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert rows[1].labels == "mit" and rows[1].base_labels == "" and rows[1].score > 0.8 and rows[2].labels == ""
    assert rows[1].spans[0].first == 9


def test_line_dedup(odd, nothing):
    rows = line_dedup.clean(odd)
    by_id = collections.defaultdict(list)
    for r in rows.collect():
        by_id[r.doc_id].append(r)
    assert rows.count() == odd.count() and line_dedup.clean(nothing).count() == 0
    assert by_id[15][0].text == "own two" and by_id[16][0].text == "" and by_id[14][0].n_removed == 0 and by_id[0][0].text is None


@pytest.mark.parametrize("window", [1, 2, 3])
def test_line_dedup_by_brute_force(spark, tmp_path, window):
    import random

    rng = random.Random(window)
    docs = [(k, "\n".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for k in range(60)]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    seen, expected = set(), {}
    for k, text in docs:
        lines = text.split("\n")
        gone = set()
        for i in range(len(lines) - window + 1):
            run = tuple(lines[i : i + window])
            if run in seen:
                gone |= set(range(i, i + window))
            seen.add(run)
        expected[k] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {r.doc_id: r.text for r in line_dedup.clean(spark.read.parquet(path), window=window).collect()} == expected


@pytest.mark.parametrize("window", [2, 3])
def test_one_fingerprint_for_each_position(spark, window):
    docs = spark.createDataFrame([(1, "\n".join(f"line {k}" for k in range(60))), (2, "alone")], "doc_id long, text string")
    rows = line_dedup.hashed(docs, "doc_id", "text", window, None).collect()
    # Each window has one fingerprint, and no fingerprint stands twice where no line does.
    assert sorted(r.at for f in rows for r in f.runs) == list(range(61 - window))
    assert len({f.mark for f in rows}) == len(rows) < 61 - window


def test_long_lines_go_on_their_own(spark, tmp_path):
    words = lambda n, w: " ".join(f"{w}{k}" for k in range(n))
    passage, short = words(51, "a"), words(50, "b")
    docs = [
        (1, f"one\n{passage}\ntwo\n{short}\nthree"), (2, passage), (3, f"four\n  {passage} \nfive\n{short}"), (4, f"{passage}\nsix\n{passage}"), (5, None), (6, ""),
        (7, words(30, "a  ") + "\tx" * 90),
    ]
    path = str(tmp_path / "d.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(path)
    rows = {r.doc_id: r for r in line_dedup.clean(spark.read.parquet(path)).collect()}
    assert rows[2].text == "" and rows[2].n_lines == rows[2].n_removed == 1
    assert rows[3].text == f"four\nfive\n{short}" and rows[4].text == "six" and rows[4].n_removed == 2
    assert all(rows[k].text == dict(docs)[k] for k in (1, 5, 6, 7))
    kept = line_dedup.clean(spark.read.parquet(path), long_words=None).collect()
    assert {r.doc_id: r.text for r in kept} == dict(docs)


def test_long_lines_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen, expected = set(), {}
    for r in docs.select("doc_id", "text").orderBy("doc_id").collect():
        lines = (r.text or "").split("\n")
        bare, gone = [x.strip(" ") for x in lines], set()
        runs = [(i, tuple(bare[i : i + 2])) for i in range(len(bare) - 1)] + [(i, (x,)) for i, x in enumerate(bare) if len(x.split()) > 50]
        for i, run in runs:
            if run in seen:
                gone |= set(range(i, i + len(run)))
            seen.add(run)
        expected[r.doc_id] = r.text and "\n".join(x for i, x in enumerate(lines) if i not in gone)
    assert {r.doc_id: r.text for r in line_dedup.clean(docs).collect()} == expected


def test_toxicity(spark, odd, nothing):
    model = toxicity.fit(odd, labels(spark))
    scored = toxicity.score(odd, model, out="_s")
    assert scored.where("_s BETWEEN 0 AND 1").count() == odd.count()
    kept = toxicity.keep_clean(odd, model)
    assert kept.columns == odd.columns and toxicity.keep_clean(nothing, model).count() == 0
    empty = toxicity.fit(nothing, labels(spark))
    assert empty.weights == {} or all(abs(w) < 1e-6 for w in empty.weights.values())


def test_counterfactual_penalty_frees_neutral_mentions(spark):
    groups = ["muslim", "jewish", "christian", "hindu"]
    rows = []
    for k in range(400):
        term = groups[0] if k % 2 else groups[1 + k % 3]
        bad = k % 2 == 1 and k % 8 != 1
        rows.append((k, f"my {term} neighbour is {'vile filth' if bad and k % 3 else 'a friend'} of note{k % 7}", int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    free = toxicity.fit(docs, docs, counterfactual=0.0)
    held = toxicity.fit(docs, docs, counterfactual=50.0)
    gap = lambda m: abs(m.scorer()("a muslim family") - m.scorer()("a christian family"))
    assert gap(held) < gap(free) / 3
    assert held.scorer()("what vile filth") > held.scorer()("a muslim friend")


def test_every_counterfactual_pair_counts(spark, tmp_path):
    # The first file alone holds more than 20,000 pairs; terms of the second kind occur in the last file only.
    head = [(k, "the american and the german met the polish guest of russian kin. " * 40, k % 2) for k in range(160)]
    tail = [(k, f"a muslim {'vile filth' if k % 2 else 'friend'} of a {'muslim' if k % 2 else 'hindu'} home", k % 2) for k in range(1000, 1100)]
    path = str(tmp_path / "d.parquet")
    for part in (head, tail):
        spark.createDataFrame(part, "doc_id long, text string, toxic int").coalesce(1).write.mode("append").parquet(path)
    docs = spark.read.parquet(path)
    caught = []
    train = toxicity.train
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(toxicity, "train", lambda rows, y, pairs, size, **kw: caught.append((pairs, kw["times"])) or train(rows, y, pairs, size, **kw))
        model = toxicity.fit(docs, docs)
    learned = docs.where(~toxicity.fold(F.col("doc_id"))).collect()
    every = [p for r in learned for p in toxicity.counterfactuals(r.text, toxicity.swaps())]
    assert len(every) > 20_000 and caught[0][1].sum() == len(every) and len(caught[0][0]) < 200
    assert model.weights


def test_weighted_pairs_equal_repeated_pairs():
    import numpy as np

    rows, y = [np.array([0, 1]), np.array([2]), np.array([1, 3])], np.array([1.0, 0.0, 0.0])
    a, b = (np.array([0, 1]), np.array([2])), (np.array([3]), np.array([0, 1]))
    weighted = toxicity.train(rows, y, [a, b], 4, times=np.array([3, 1]))
    assert np.allclose(weighted, toxicity.train(rows, y, [a, a, a, b], 4), atol=1e-6)


def test_site_quality(spark, odd, nothing):
    rows = site_quality.score(odd, labels(spark)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert site_quality.score(nothing, labels(spark)).count() == 0


def test_sparse_sites_shrink_towards_the_mean(spark):
    good, bad = "Plain words in a short clean sentence about nothing.", "### $$$ %%% &&& ### $$$ %%% &&&"
    rows = [(k, good if k % 2 else bad, "big" if k < 300 else f"s{k}", "p", k % 2) for k in range(330)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, quality int")
    got = {r.doc_id: r for r in site_quality.score(docs, docs).collect()}
    mean = sum(r.text_score for r in got.values()) / len(got)
    assert abs(got[301].site_score - mean) < abs(got[301].text_score - mean) and got[301].keep and not got[300].keep


def test_search_by_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [(int(k), [float(x) for x in rng.normal(size=6)]) for k in range(130)]
    rows += [rows[50], rows[7], (131, None), (132, [1.0, None, 2.0]), (150, [float("nan")] * 6), (200, [float("inf")] * 6), (250, []), (None, [1.0] * 6), (300, [1e9, -1e9, 3.0, 0.0, 0.0, 1.0]), (350, [0.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    whole = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    expected = []
    for a, (i, v) in enumerate(whole):
        if i % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, u, strict=False)), j) for b, (j, u) in enumerate(whole) if b != a)[:5]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    assert sorted(tuple(r) for r in topk_search.search(df).collect()) == sorted(expected)
    assert topk_search.search(df.limit(0)).count() == 0 and topk_search.search(df.where("vec_id = 50").limit(1)).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, nothing, tmp_path):
    folder = str(tmp_path)
    labels(spark).write.parquet(f"{folder}/labels.parquet")
    odd.write.parquet(f"{folder}/documents.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        assert stage(spark, nothing, folder).count() == 0, name
        out = stage(spark, docs, folder)
        if k < 4:
            assert out.columns == docs.columns
            out.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            assert docs.count() > 5
        else:
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and corpus_pipeline.run(spark, folder).count() > 0
