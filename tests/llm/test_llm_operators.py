"""The ten operators against brute force, on edge cases and on a small table."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import zstandard
from oracle import against_sql
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
from rallygrid.llm import bpe, line_dedup, near_dedup, oracles, packing, prefix_bpe, quality_classifier, sharding, text_stats, topk, toxicity, warc, weak_quality
from rallygrid.llm.tokens import LONGEST, Memo

JSON = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LINE = "This line is long enough to count as shared by many documents."
SCHEMA = "doc_id long, text string, lang string, score double, id long, n long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, blank, short, long and repeated texts, repeated rows, clashing columns."""
    base = [f"word{k} goes here and there {k * 7 % 11}" for k in range(40)]
    text = " ".join(base)
    texts = [None, "", " \t\n ", "one two", "One  TWO", text, text, text.replace("word39", "other"), "\n".join(base), "x" * 50_000,
             " ".join(f"w{k % 977}" for k in range(30_000)), "é ñ 中文 😀 \x1c tail  \r\n", f"{LINE}\nown"]
    rows = [(i, t, "en", 0.5, 1, 2) for i, t in enumerate(texts)]
    rows += [(100 + i, f"  {LINE.upper() if i % 2 else LINE}\t\nline {i}\n{LINE}", None, None, None, None) for i in range(6)]
    rows += [(5, text, "en", 0.5, 1, 2), (None, text, None, None, None, None), (None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_against_sql(name, spark):
    sf_dir = "/root/testdata/sf0.01"
    got, want = against_sql(__spark_entry__.queries()[name](spark, sf_dir), oracles.oracle_sql()[name], sf_dir)
    assert got == want and sum(got[1].values()) > 0


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def key(line):
    out = line.strip(" \t\n\x0b\x0c\r")
    return re.sub("[A-Z]", lambda m: m[0].lower(), out)


def brute_lines(rows):
    docs = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if r.doc_id is not None and len(key(line)) >= 40:
                docs[key(line)].add(r.doc_id)
    out = Counter()
    for r in rows:
        lines = (r.text or "").split("\n")
        kept = [x for x in lines if r.doc_id is None or len(docs.get(key(x), ())) < 5 or max(docs[key(x)]) == r.doc_id]
        out[r.doc_id, "\n".join(kept), len(lines), len(lines) - len(kept)] += 1
    return out


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
@pytest.mark.parametrize("fanout", [2, 3])
def test_lines(which, fanout, request):
    docs = request.getfixturevalue(which)
    done = line_dedup.dedup_lines(docs, fanout=fanout).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done) == brute_lines(docs.collect())


@pytest.mark.parametrize("batches", [1, 7])
def test_lines_in_any_number_of_batches(small, batches):
    done = line_dedup.dedup_lines(small, batches=batches, fanout=2).collect()
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in done) == brute_lines(small.collect())


def test_lines_carry(odd):
    done = line_dedup.dedup_lines(odd, carry=["lang", "score"])
    assert done.columns == ["doc_id", "text", "n_lines", "n_dropped", "lang", "score"]
    assert done.count() == odd.count()


def test_line_runs_are_compacted(spark):
    runs = line_dedup.LineRuns(spark, fanout=2)
    for batch in range(4):
        runs.add(spark.createDataFrame([(k, 0, 100 - batch) for k in range(batch, 6)], "h1 long, h2 long, doc_id long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    got = {(r.h1, r.holder) for r in runs.repeated(3).collect()}
    assert got == {(2, 100), (3, 100), (4, 100), (5, 100)}


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_packing(which, request):
    docs = request.getfixturevalue(which)
    rows = packing.pack_documents(docs, JSON, with_ids=True, pieces_a_group=100).collect()
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    want = Counter((r.doc_id, tuple([*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0])) for r in docs.collect())
    got, at = Counter(), defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and len(r.ids) == r.length <= 2048
        at[r.sequence_id].append((r.offset, r.length))
    pieces = Counter((r.doc_id, r.piece, r.start, tuple(r.ids)) for r in rows)
    for (doc_id, ids), n in want.items():
        for piece, (start, length) in enumerate(packing.cut(len(ids), 2048)):
            got[doc_id, piece, start, ids[start : start + length]] += n
    assert pieces == got
    for parts in at.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_sum_of_squares_rule():
    rng = np.random.default_rng(5)
    for capacity in (7, 30):
        lengths = rng.integers(1, capacity + 1, 300)
        bins, offsets = packing.pack_sum_of_squares(lengths, capacity)
        fill = Counter()
        for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist(), strict=True):
            gaps = Counter(capacity - f for f in fill.values() if f < capacity)

            def cost(gap, s=s, gaps=gaps):
                after = gaps.copy()
                if gap < capacity:
                    after[gap] -= 1
                if gap > s:
                    after[gap - s] += 1
                return sum(n * n for n in after.values())

            choices = [g for g in {*gaps, capacity} if g >= s and (g == capacity or gaps[g])]
            assert o == fill[b] and cost(capacity - o) == min(map(cost, choices))
            fill[b] += s
        assert max(fill.values()) <= capacity and sum(fill.values()) == lengths.sum()


def test_packing_is_dense():
    rng = np.random.default_rng(2)
    lengths = np.sort(np.minimum(rng.lognormal(6, 1, 20_000).astype(int) + 1, 2048))[::-1]
    bins, _ = packing.pack_sum_of_squares(lengths, 2048)
    assert bins.max() + 1 <= 1.01 * lengths.sum() / 2048 + 1


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_sharding(which, request):
    docs = request.getfixturevalue(which)
    rows = sharding.assign_shards(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < 24 and r.grown_shard in (r.shard, 24)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want


def test_jump_hash():
    keys = np.arange(30_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    before = sharding.jump_hash(keys, 24)
    after = sharding.jump_hash(keys, 25)
    assert set(after[after != before]) == {24} and abs((after == 24).mean() - 1 / 25) < 0.01
    assert abs(np.bincount(before, minlength=24) / len(keys) - 1 / 24).max() < 0.01
    assert sharding.jump_hash(np.array([0, 1, 2**64 - 1], np.uint64), 1).tolist() == [0, 0, 0]

    def plain(k, n):
        b, j = -1, 0
        while j < n:
            b, k = j, (k * 2862933555777941757 + 1) % 2**64
            j = int((b + 1) * (float(1 << 31) / ((k >> 33) + 1)))
        return b

    assert [plain(int(k), 24) for k in keys[:500]] == before[:500].tolist()


def brute_groups(rows):
    def shingles(text):
        words = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORD.findall(text or "")]
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}

    sets = [(r.doc_id, shingles(r.text)) for r in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if a is not None and b is not None and x and y and a < b and 100 * len(x & y) >= 75 * len(x | y):
                lo, hi = sorted((find(a), find(b)))
                parent[hi] = lo
    return Counter((i, len(s), None if i is None else find(i), i is None or find(i) == i) for i, s in sets)


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_near_duplicates(which, request):
    docs = request.getfixturevalue(which)
    rows = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows) == brute_groups(docs.collect())


def test_near_duplicates_in_chains_and_large_groups(spark):
    rng = np.random.default_rng(3)
    rows, word = [], lambda: f"v{rng.integers(10**6)}"
    for group in range(12):
        text = [word() for _ in range(120)]
        for copy in range(30 if group else 150):
            own = list(text)
            for _ in range(int(rng.integers(0, 6))):
                own[rng.integers(len(own))] = word()
            if copy % 5 == 4:
                text = own  # the group drifts
            rows.append((len(rows), " ".join(own)))
    rng.shuffle(rows)
    docs = spark.createDataFrame([(int(i), t) for i, t in rows], "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == brute_groups(docs.collect())


def test_near_duplicates_in_small_blocks(spark, monkeypatch):
    """Clusters of several components, in blocks and slices of a few classes."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "SLICE", 3)
    rng = np.random.default_rng(8)
    base = [f"v{k}" for k in range(150)]
    rows = []
    for n in range(140):
        own = list(base)
        for at in rng.choice(150, int(rng.integers(1, 9)), replace=False):
            own[at] = f"e{rng.integers(10**6)}"
        rows.append((n, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_dedup.near_duplicates(docs).collect()
    want = brute_groups(docs.collect())
    assert Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    assert 3 < sum(r.kept for r in got) < 139


def test_superminhash():
    from rallygrid.llm.superminhash import signatures, splitmix

    off = []
    for seed in range(120):
        x = splitmix(np.arange(1000, dtype=np.uint64) + np.uint64(seed * 5000))
        a, b = signatures([np.unique(x[:875]), np.unique(x[125:])], 160)
        off.append((a == b).mean() - 0.75)
    assert abs(np.mean(off)) < 0.01 and np.std(off) < 0.04
    one = signatures([splitmix(np.arange(3, dtype=np.uint64))], 160)[0]
    assert (one < np.uint64(0xFFFFFFFFFFFFFFFF)).all()  # every register is reached, however small the set


@pytest.mark.parametrize("which", ["odd", "empty"])
def test_classifiers_take_any_text(which, spark, sf_dir, request):
    docs = request.getfixturevalue(which)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    known = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for model in (quality_classifier.fit_quality(known, labels), toxicity.fit_toxicity(known, labels)):
        rows = quality_classifier.score_documents(docs.drop("score"), model).collect()
        assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    for model in (quality_classifier.fit_quality(known, none), toxicity.fit_toxicity(known, none)):
        assert {r.score for r in quality_classifier.score_documents(docs.drop("score"), model).collect()} <= {0.0}


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    s = np.asarray(score)[order]
    for lo in range(len(s)):
        if lo == 0 or s[lo] != s[lo - 1]:
            hi = np.searchsorted(s, s[lo], side="right")
            rank[order[lo:hi]] = (lo + hi + 1) / 2
    ones = y.sum()
    return (rank[y == 1].sum() - ones * (ones + 1) / 2) / (ones * (len(y) - ones))


@pytest.mark.parametrize("name, label, least", [("op4_quality_classifier", "quality", 0.95), ("op6_toxicity", "toxic", 0.85)])
def test_held_out_accuracy(spark, name, label, least):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = __spark_entry__.queries()[name](spark, sf).join(labels, "doc_id").where("held_out").toPandas()
    assert auc(rows.score.to_numpy(), rows[label].to_numpy()) >= least
    assert (rows.predicted == (rows.score >= (0.5 if label == "quality" else 0.3))).all()
    parts, out = (3, 1) if label == "quality" else (4, 2)
    assert all(zlib.crc32(str(i).encode()) % parts == out for i in rows.doc_id)


@pytest.mark.parametrize("toxic_share", [0.05, 0.5, 0.8])
def test_toxic_dictionary_at_any_share_of_labels(toxic_share):
    rng = np.random.default_rng(9)
    y = (rng.uniform(size=600) < toxic_share).astype(int)
    plain = [f"w{k}{'aeiou'[k % 5]}n" for k in range(300)]
    texts = [" ".join([*rng.choice(plain, 30), *([f"vilegrub{rng.integers(90)}"] if label else [])]) for label in y]
    ordinary, toxic = toxicity.train_dictionaries(texts, y)
    assert b"vilegrub" in toxic and b"vilegrub" not in ordinary
    model = toxicity.ToxicityModel(ordinary, toxic)
    assert np.mean([model.gains(t).max() for t in np.array(texts)[y == 1]]) > np.mean([model.gains(t).max() for t in np.array(texts)[y == 0]]) + 2


def test_toxicity_against_brute_force(spark):
    """The registered query's scores, from the fitted model by a plain reading of its docstrings."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit_toxicity(docs, labels)
    assert len(model.contents[0]) == len(model.contents[1])
    sizes = [zstandard.ZstdCompressionParameters(
        window_log=16, hash_log=15, chain_log=16, search_log=6, min_match=4, target_length=64, strategy=zstandard.STRATEGY_LAZY2,
        write_content_size=0, write_checksum=0, write_dict_id=0, format=zstandard.FORMAT_ZSTD1_MAGICLESS)] * 2
    by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(c, dict_type=1), compression_params=p) for c, p in zip(model.contents, sizes)]

    def brute(text):
        words, parts = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split(), [b" "]
        found = []
        for k, w in enumerate(words):
            parts[-1] += w + b" "
            if len(parts[-1]) > toxicity.WINDOW or k == len(words) - 1:
                found.append(len(by[0].compress(parts[-1])) - len(by[1].compress(parts[-1])))
                parts.append(b" ")
        over = [x - model.threshold for x in found if x > model.threshold]
        far = sum(over) / len(found) ** 0.5 if over else 0
        if found and not over:
            top = sorted(found)[-3:]
            far = sum(top) / len(top) - model.threshold
        at = np.searchsorted(model.knots, far)
        rates = np.maximum.accumulate(model.rates)
        if at in (0, len(rates)):
            return rates[min(at, len(rates) - 1)]
        lo, hi = model.knots[at - 1 : at + 1]
        return rates[at - 1] + (rates[at] - rates[at - 1]) * (far - lo) / (hi - lo)

    texts = {r.doc_id: r.text for r in docs.collect()}
    got = __spark_entry__.queries()["op6_toxicity"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert abs(r.score - brute(texts[r.doc_id])) < 1e-9 and r.predicted == (r.score >= 0.3)


def test_quality_against_brute_force(spark):
    """The registered query's scores, from the fitted model, one text at a time."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_classifier.fit_quality(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = __spark_entry__.queries()["op4_quality_classifier"](spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        z = (quality_classifier.statistics(text_stats.counts(texts[r.doc_id])[None])[0] - model.mean) / model.scale
        z = [min(6, max(-6, x)) for x in z]
        features = [np.cos(sum(a * b for a, b in zip(z, w)) + p) * (2 / len(model.phases)) ** 0.5 for w, p in zip(model.frequencies.T, model.phases)]
        raw = sum(a * b for a, b in zip([*features, 1.0], model.weights))
        assert abs(r.score - np.clip(np.interp(raw, model.knots, np.maximum.accumulate(model.rates)), 0, 1)) < 1e-6


@pytest.mark.parametrize("name", ["toxicity", "quality"])
def test_labels_of_long_equal_and_empty_texts(spark, name):
    """Texts of any length train; equal ones, nulls, ties and clashing columns don't matter."""
    long = " ".join(f"plain{k % 50} words go on" for k in range(9_000))
    rows = [(i, [long, "", None, "short text of few words " * 5, f"awfulgrub{i % 3} is here again and again number {i} " * 3][i % 5], 7) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, int(i % 5 == 3), int(i % 5 == 4)) for i in range(100)] * 2, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels) if name == "toxicity" else quality_classifier.fit_quality(docs, labels)
    done = quality_classifier.score_documents(docs, model).collect()
    assert len(done) == 100 and all(0 <= r.score <= 1 for r in done)
    best = [np.mean([r.score for r in done if r.doc_id % 5 == k]) for k in range(5)]
    assert np.argmax(best) == (4 if name == "toxicity" else 3)


def test_isotonic():
    from rallygrid.llm.labelled import calibrated, isotonic

    rng = np.random.default_rng(0)
    x = rng.normal(size=4000)
    y = (rng.uniform(size=4000) < 1 / (1 + np.exp(-2 * x))).astype(float)
    rates = calibrated(np.linspace(-3, 3, 50), *isotonic(x, y))
    assert (np.diff(rates) >= 0).all() and abs(rates - 1 / (1 + np.exp(-2 * np.linspace(-3, 3, 50)))).max() < 0.1


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    eights = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
    covered = {j for k in range(len(words) - 7) if eights[tuple(words[k : k + 8])] > 1 for j in range(k, k + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_weak_quality(which, request):
    docs = request.getfixturevalue(which)
    rows = weak_quality.weak_quality(docs).collect()
    want = Counter((r.doc_id, *(b := brute_base(r.text)), b[0] < 20 or 100 * b[4] > 30 * b[0]) for r in docs.collect())
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows) == want
    assert all(r.kept == (not r.base_failed and r.quality >= 0.5) for r in rows)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(4)
    good = rng.uniform(size=40_000) < 0.7
    truth = np.array([0.95, 0.85, 0.75, 0.65, 0.9])
    right = rng.uniform(size=(40_000, 5)) < truth
    v = np.where(right == good[:, None], 1, -1) * (rng.uniform(size=(40_000, 5)) < 0.6)
    numbers, n = np.unique(weak_quality.pattern(v), return_counts=True)
    model = weak_quality.fit_label_model(weak_quality.unpattern(numbers, 5), n.astype(float), np.full(5, 0.8))
    assert abs(model.accuracy - truth).max() < 0.03


def test_label_model_weighs_votes_by_class():
    """Rules of which one is telling: a bad vote of another alone doesn't decide, and texts go without any."""
    rng = np.random.default_rng(5)
    good = rng.uniform(size=20_000) < 0.8
    p_bad = np.where(good[:, None], [0.001, 0.05, 0.05, 0.02], [0.6, 0.4, 0.5, 0.5])
    p_good = np.where(good[:, None], [0.95, 0.9, 0.9, 0.9], [0.1, 0.2, 0.2, 0.1])
    u = rng.uniform(size=(20_000, 4))
    v = np.where(u < p_bad, -1, np.where(u > 1 - p_good, 1, 0))
    numbers, n = np.unique(weak_quality.pattern(v), return_counts=True)
    model = weak_quality.fit_label_model(weak_quality.unpattern(numbers, 4), n)
    assert abs(model.share - 0.8) < 0.02 and abs(model.outcome[1, :, 0] - [0.001, 0.05, 0.05, 0.02]).max() < 0.02
    kept = model.posterior(v) >= 0.5
    bad_vote = (v == -1).any(axis=1)
    assert (kept & bad_vote).sum() > 100 and (~kept & ~bad_vote).sum() > 100
    # the posterior, by brute force
    for k in range(0, 20_000, 997):
        like = [np.prod([model.outcome[c, r, v[k, r] + 1] for r in range(4)]) for c in (0, 1)]
        want = model.share * like[1] / (model.share * like[1] + (1 - model.share) * like[0])
        assert abs(model.posterior(v[k : k + 1])[0] - (want if v[k].any() else model.share)) < 1e-9


def test_weak_quality_is_not_all_must_pass(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    done = weak_quality.weak_quality(docs).where("NOT base_failed").join(docs, "doc_id").select("kept", "text").toPandas()
    v = weak_quality.votes(text_stats.count_rows(done.text.tolist()))
    bad_vote = (v == -1).any(axis=1)
    assert (done.kept & bad_vote).sum() > 10 and (~done.kept & ~bad_vote).sum() >= 1


def test_weak_quality_agrees_with_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").withColumnRenamed("quality", "label")
    done = weak_quality.weak_quality(spark.read.parquet(f"{sf}/documents.parquet")).where("n_words >= 20").join(labels, "doc_id")
    share = {r.label: r.kept for r in done.groupBy("label").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1] > 0.97 and share[0] < 0.3


def brute_top(rows, k=5):
    vectors = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            vectors.setdefault((i, tuple(np.floor(256 * np.asarray(v, float)).astype(int).tolist())), None)
    out = set()
    for i, q in vectors:
        if i % 50 == 0:
            found = sorted((-int(np.dot(q, c)), j) for j, c in vectors if j != i and len(c) == len(q))[:k]
            out |= {(i, n + 1, j, -s) for n, (s, j) in enumerate(found)}
    return out


def test_top_k(spark, sf_dir):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(2)]) for i in range(300)]
    rows += [(300 + i, rows[7][1]) for i in range(200)] + [(600, None), (650, [1.0, None, 0.0]), (700, [float("nan")] * 6), (None, rows[0][1])]
    rows += [(800, [1.0, 2.0]), (801, [1.0, -2.0]), rows[3], (850, [0.0] * 6), (900, [3e5] * 6)]
    for given in (rows, rows[:1], []):
        vectors = topk.quantise(spark.createDataFrame(given, "vec_id long, embedding array<double>"))
        for blocks in ({}, {"candidates": 64, "queries": 3, "lists": 3}):
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(not blocks).lower())
            got = topk.top_k(vectors, **blocks).collect()
            spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
            assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top(given)
            assert len(got) == len(brute_top(given))


def test_top_k_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(12)
    vector = lambda scale: [float(x) for x in (scale * rng.normal(size=6)).round(2)]
    given = [(i, vector(1)) for i in range(1, 200)]
    given += [(i, vector(3)) for i in (7, 50, 100) for _ in range(20)]  # own rows of 50 and 100 fill the best places
    given += [(8, [9.0 * (n == m) for n in range(6)]) for m in range(6)]  # parts of different vectors of one id
    given += [(150, [float(n == 0) * 5 for n in range(6)]), (250, [5.0, 0.0, 0.0, 0.0, 0.0, 0.0])]  # equal queries of different ids
    given += [(150, [5.0, 0.0, 0.0, 0.0, 0.0, float(m)]) for m in range(1, 9)]
    vectors = topk.quantise(spark.createDataFrame(given, "vec_id long, embedding array<double>"))
    for blocks in ({}, {"candidates": 64, "queries": 3, "lists": 3}):
        got = Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(vectors, **blocks).collect())
        assert set(got) == brute_top(given)


def test_top_k_holds_and_resolves_few_pairs():
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 64)) * 60
    v = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 64)) * 15).astype(np.int64)
    q = v[:100]
    exact = q @ v.T
    floor = np.sort(exact, axis=1)[:, -10]
    i, j, scores, held = topk.Lists(q, v, topk.LISTS).resolved(floor)
    assert {(a, b): s for a, b, s in zip(i.tolist(), j.tolist(), scores.tolist())} == {(a, b): exact[a, b] for a, b in np.argwhere(exact >= floor[:, None]).tolist()}
    assert held < 0.05 * exact.size


@pytest.mark.parametrize("scale", [1, 1e12, 1e18])
@pytest.mark.parametrize("lists", [1, 2, 3, 9])
def test_top_k_lists_at_any_size_of_numbers(scale, lists):
    rng = np.random.default_rng(4)
    v = (rng.normal(size=(60, 5)) * scale * rng.choice([0.01, 1], (60, 1)) * 3).astype(np.int64)
    exact = np.clip(v[:7].astype(object) @ v.T.astype(object), -(1 << 63) + 1, (1 << 63) - 1).astype(np.int64)
    for nth in (1, 20, 60):
        floor = np.sort(exact, axis=1)[:, -nth]
        i, j, scores, _ = topk.Lists(v[:7], v, lists).resolved(floor)
        assert set(zip(i.tolist(), j.tolist(), scores.tolist())) == {(a, b, exact[a, b]) for a, b in np.argwhere(exact >= floor[:, None]).tolist()}


def test_top_k_saturates(spark):
    given = [(i, [float(x), 1.0]) for i, x in enumerate((1e300, -1e300, 3e17, 5e16, 2.0))]
    got = topk.top_k(topk.quantise(spark.createDataFrame(given, "vec_id long, embedding array<double>"))).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got)] == [(0, 1, 2), (0, 2, 3), (0, 3, 4), (0, 4, 1)]
    assert got[0].score == (1 << 63) - 1


def test_top_k_on_embeddings(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()
    got = __spark_entry__.queries()["op8_top_k"](spark, sf_dir).collect()
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == brute_top([tuple(r) for r in rows])


@pytest.mark.parametrize("which", ["odd", "small", "empty"])
def test_bpe(which, request):
    docs = request.getfixturevalue(which)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in docs.collect():
        ids = reference.encode_ordinary(r.text or "")
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()] += 1
    rows = bpe.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()
    assert Counter(tuple(r) for r in rows) == want


def test_memo_is_bounded_and_keeps_frequent_words():
    asked = []
    memo = Memo(lambda word: asked.append(word) or word.upper(), most=10)
    for k in range(1000):
        assert memo["the"] == "THE" and memo[f"rare{k}"] == f"RARE{k}"
        assert len(memo) <= 10 and len(memo.older) <= 10
    assert asked.count("the") == 1
    long = "x" * (LONGEST + 1)
    assert memo[long] == long.upper() and long not in memo


def test_prefix_table_under_edits():
    vocabulary = prefix_bpe.Vocabulary.of_file(RANKS, public_tokenizers.PATTERN)
    rng = np.random.default_rng(8)
    letters = np.array(list("aeiouthnrsdl"))
    for _ in range(60):
        raw = "".join(rng.choice(letters, 400)).encode()
        edited = prefix_bpe.PrefixTable(vocabulary, raw[:150])
        edited.append(raw[150:])
        assert edited.last == prefix_bpe.PrefixTable(vocabulary, raw).last
        lo = int(rng.integers(0, 380))
        before = edited.computed
        edited.replace(lo, lo + int(rng.integers(0, 8)), b"the")
        fresh = prefix_bpe.PrefixTable(vocabulary, edited.raw)
        assert edited.last == fresh.last and vocabulary.decode(edited.encode()) == edited.raw
        assert edited.computed - before <= len(edited.raw) - lo


def test_warc(spark, sf_dir):
    body = "<p>" + "long page " * 200
    rows = [(1, "http://a/ b\r\nX: y", body, 0), (2, None, body, 0), (3, "http://é/", "small", 0), (4, "u", "small", 0), (5, "u", None, 0), (6, "u", "", 0)]
    rows += [(None, "u", body, 0), (2, None, body, 0), (9, "u", "\r\n\r\n" * 900, 0), (10, "u", "é" * 200_000, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = warc.archive_pages(pages, archive_bytes=100_000).collect()
    sha = lambda t: hashlib.sha1((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, html, _ in rows:
        revisit = html == body and i == 1
        want[i, len((html or "").encode()), sha(html), "revisit" if revisit else "response", 2 if revisit else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    assert all(r.payload is None if r.record_type == "revisit" else hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in got)
    assert warc.archive_pages(pages.limit(0)).count() == 0


def test_warc_archive_is_readable_by_any_decoder():
    import io
    import struct

    import zstandard

    out = io.BytesIO()
    raws = [warc.record(i, f"http://x/{i}", "00" * 20, 500, (f"<p>{i} " + "common markup " * 30).encode(), None, "1970-01-01T00:00:00Z") for i in range(200)]
    assert warc.compress(iter(raws), out) == 200
    content = out.getvalue()
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and size > 0 and len(content) < sum(map(len, raws)) / 3
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(content[8 : 8 + size]))
    plain = decoder.stream_reader(io.BytesIO(content[8 + size :]), read_across_frames=True).read()
    assert plain == b"".join(raws) == b"".join(warc.decompress(content))
