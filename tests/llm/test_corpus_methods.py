"""The operators against brute force, exact round trips and held-out accuracy."""

import contextlib
import math
import os
import random
import re
import string
import threading
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from attestor.llm import langid, line_dedup, maxscore, packing, pseudo_likelihood, quality, queries, simhash, token_shards, toxicity
from attestor.llm.common import ALNUM, hashed_words, shared_folder, stored, table

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    some = ["".join(rng.choice("aZ9 é世.\n\x00_\U0001f600") for _ in range(rng.randrange(40))) for _ in range(300)] + [None, ""]
    seen = {}
    for i, j, words, ranges in hashed_words(pa.array(some), ALNUM):
        for k in range(i, j):
            found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (some[k] or "").translate(LOWER))
            mine = words[ranges[k - i] : ranges[k - i + 1]].tolist()
            assert len(found) == len(mine)
            assert all(seen.setdefault(w, h) == h for w, h in zip(found, mine, strict=True))
    assert len(set(seen.values())) == len(seen)


# --- SimHash


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if w]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_groups(prints):
    left, groups = set(prints), []
    while left:
        todo, group = [left.pop()], set()
        while todo:
            x = todo.pop()
            group.add(x)
            near = {y for y in left if (x ^ y).bit_count() <= 2}
            left -= near
            todo += near
        groups.append(group)
    return groups


def test_near_duplicates(docs, texts):
    prints = {i: brute_fingerprint(t) for i, t in texts.items()}
    want = {}
    for group in brute_groups(prints.values()):
        ids = [i for i, p in prints.items() if p in group]
        want |= {i: (f"{prints[i]:016x}", min(ids)) for i in ids}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()}
    assert got == want
    kept = {r["doc_id"] for r in simhash.one_of_each(docs).collect()}
    assert kept == {c for _, c in want.values()}


def test_chains_clusters_and_dense_groups_over_many_shards(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    chain = [int(base[0])]
    for b in rng.permutation(64)[:40].tolist() * 3:
        chain.append(chain[-1] ^ (1 << b) ^ (1 << ((b + 17) % 64)))
    dense = [int(base[1]) ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a, 40)]
    near = [int(x) ^ (1 << int(b)) for x, b in zip(base[100:600], rng.integers(0, 64, 500), strict=True)]
    prints = list({*base.tolist(), *chain, *dense, *near})
    rows = spark.createDataFrame([(i, int(np.uint64(p).astype(np.int64))) for i, p in enumerate(prints)], "doc_id long, fp long").repartition(5)
    got = defaultdict(set)
    for r in simhash.classes(rows, sample=2000, shard=100).collect():
        got[r["component_id"]].add(prints[r["doc_id"]])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, brute_groups(prints)))


def test_dense_group_without_a_split():
    points = np.unique(np.array([(1 << a) ^ (1 << b) for a in range(64) for b in range(a, 64)], np.uint64))
    u, v = simhash.shard_links(points)
    assert len(u) == len(points) - 1 and set(v.tolist()) == {int(points.min())}


# --- lines


def test_perfect_hash():
    keys = np.random.default_rng(3).integers(-(1 << 62), 1 << 62, (5000, 2))
    index = line_dedup.PerfectHash(keys)
    assert sorted(index.numbers(keys).tolist()) == list(range(5000))


def test_equal_halves_do_not_matter():
    keys = np.array([[1, k] for k in range(100)] + [[k, 1] for k in range(2, 100)])
    assert sorted(line_dedup.PerfectHash(keys).numbers(keys).tolist()) == list(range(len(keys)))


def test_joined_lines_equal_probed_ones(spark):
    common = [f"this line number {k} is shared by a number of documents" for k in range(40)]
    rows = [(d, "\n".join([f"own {d}", *(f"  {c.upper()} " if d % 2 else c for k, c in enumerate(common) if (d + k) % 4), "x"])) for d in range(30)]
    rows += [(29, rows[29][1]), (None, rows[5][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, two, three = (sorted(map(repr, line_dedup.deduplicated(docs, **o).collect())) for o in ({}, {"broadcast_bytes": 0}, {"shard_lines": 3}))
    assert one == two == three
    last = {c: max(d for d, t in rows if d is not None and c in t.lower()) for c in common}
    for d, t in rows:
        kept = "\n".join(x for x in t.split("\n") if last.get(x.strip().lower(), d) == d)
        assert any(repr(kept) in r for r in one), d


# --- token shards


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        order = token_shards.Feistel(n, 9)
        slots = order.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n))
        assert order.numbers(slots).tolist() == list(range(n))
    assert token_shards.Feistel(1000, 1).slots(np.arange(1000)).tolist() != token_shards.Feistel(1000, 2).slots(np.arange(1000)).tolist()


def test_texts_come_back_from_the_shards(spark, docs, texts):
    ranks = token_shards.ranks(spark, f"file://{token_shards.VOCABULARY}")
    folder = shared_folder(spark, "round")
    rows = token_shards.materialised(docs.repartition(3, "doc_id"), folder, ranks, key=5, length=128, shard_rows=100).collect()
    read = dict(token_shards.read_from(folder))
    assert list(read) == list(range(len(rows))) == sorted(r["slot"] for r in rows)
    assert [s for s, _ in token_shards.read_from(folder, 250, 7)] == list(range(250, 257))
    order = token_shards.Feistel(len(rows), 5)
    stream = np.concatenate([read[s] for s in order.slots(np.arange(len(rows))).tolist()])
    back = {v: k for k, v in ranks.items()}
    found, now = Counter(), []
    for t in stream.tolist():
        if t == token_shards.END_MARK:
            found[b"".join(now).decode()] += 1
            now = []
        else:
            now.append(back[t])
    assert found == Counter(texts.values()) and not now
    where = defaultdict(set)
    for r in rows:
        for d in r["doc_ids"]:
            where[d].add(r["slot"])
    assert set(where) == set(texts)


# --- packing


def test_every_document_is_in_the_tightest_compatible_bin():
    rng = random.Random(4)
    bins, room, held = packing.Bins(100), [], []
    for _ in range(2000):
        size, source, cluster = rng.randint(1, 100), rng.choice(["hot", "hot", "a", "b", "c", None]), rng.randrange(300)
        free = [(room[b], b) for b in range(len(room)) if room[b] >= size and cluster not in held[b][1] and (source is None or source not in held[b][0])]
        want = min(free)[1] if free else len(room)
        got, _ = bins.put(size, source, cluster)
        assert got == want
        if got == len(room):
            room.append(100)
            held.append((set(), set()))
        room[got] -= size
        held[got][0].add(source)
        held[got][1].add(cluster)


def test_packing_covers_every_word_without_conflict(docs, texts):
    rows = packing.packed_documents(docs, group_tokens=20_000).join(docs.select("doc_id", "source"), "doc_id").collect()
    bins, words = defaultdict(list), Counter()
    for r in rows:
        words[r["doc_id"]] += r["length"]
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    assert words == Counter({d: len(t.split()) for d, t in texts.items()})
    for own in bins.values():
        assert sum(r["length"] for r in own) <= packing.CAPACITY
        assert len({r["source"] for r in own}) == len(own) == len({" ".join(texts[r["doc_id"]].lower().split()) for r in own if r["length"] < packing.CAPACITY} | {r["doc_id"] for r in own if r["length"] == packing.CAPACITY})


def test_near_copies_are_in_different_bins(spark, tmp_path):
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(300)]
    first = " ".join(words)
    near = next(t for k in range(300) if 0 < (simhash.fingerprint(t := " ".join([*words[:k], "other", *words[k + 1 :]])) ^ simhash.fingerprint(first)).bit_count() <= 2)
    far = " ".join(f"v{rng.randrange(5000)}" for _ in range(300))
    rows = [(1, first, "a"), (2, near, "b"), (3, far, "c"), (4, "É " + far, "d"), (5, "é  " + far, "e"), (6, None, "f")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    held = {r["doc_id"]: (r["bin_id"], r["length"]) for r in queries.op5_packing(spark, str(tmp_path)).collect()}
    assert [held[k][1] for k in range(1, 7)] == [300, 300, 300, 301, 301, 0] and held[6][0] is None
    assert held[1][0] != held[2][0] and held[4][0] != held[5][0]
    assert len({held[k][0] for k in range(1, 6)}) < 5


# --- top k


def test_top_k_against_all_products(spark):
    rng = np.random.default_rng(6)
    vectors = np.round(rng.normal(0, 1, (900, 16)), 1).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(900 + i, vectors[0].tolist()) for i in range(20)]
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in maxscore.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4), block=64, queries=10).collect()}
    q = np.array([[math.floor(256 * float(np.float32(x))) for x in v] for _, v in rows], object)
    for i in range(0, len(rows), 50):
        best = sorted(((-int((q[i] * q[j]).sum()), j) for j in range(len(rows)) if j != i))[:5]
        assert [got[i, k + 1] for k in range(5)] == [(j, -s) for s, j in best]


def test_bounds_spare_products():
    rng = np.random.default_rng(7)
    vectors = (rng.normal(0, 60, (5000, 32)) * np.geomspace(4, 0.05, 32)).astype(np.int64)
    best = maxscore.Best(np.arange(5), vectors[:5], 5)
    for at in range(0, 5000, 500):
        best.add(np.arange(at, at + 500), vectors[at : at + 500])
    assert best.probed < 0.5 * 5 * 4500 * 32


# --- language


def test_language_probabilities_add_up_and_beat_held_out(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = langid.trained(docs)
    known = np.unique(np.concatenate([[32], langid.normalised([r["text"] for r in docs.limit(50).collect()])[0]]))
    for head in ("th", " q", "ßß"):
        codes = [1, 1, 32, *map(ord, head)]
        total = sum(np.exp(model.log_probabilities(np.array([*codes, int(c)], np.uint64))[-1].astype(float)) for c in known if c != 1)
        assert (total < 1.0001).all() and (total > 0.95).all()
    found = langid.identified(docs, model).select("row.*", "lang_pred", "rejected").filter(langid.held_out())
    right, n, rejected = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*"), F.sum(F.col("rejected").cast("int"))).first()
    assert n > 200 and right > 0.98 and rejected < 0.01 * n
    noise = "".join(random.Random(1).choice("qxzjkvwçñß") for _ in range(600))
    assert model.judged([noise])[0][3]


# --- toxicity


def test_pairs_count_more_than_their_words(spark):
    rng = random.Random(8)
    rows = []
    for d in range(4000):
        words = [f"w{rng.randrange(50)}" for _ in range(10)]
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        words += ["insult"] * insult + ["group"] * group
        rng.shuffle(words)
        rows.append((d, " ".join(words), int(insult and group)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    machine = toxicity.trained(docs, docs)
    found = toxicity.scored(docs, machine).select("row.*", "score").filter(toxicity.held_out())
    assert found.agg(F.avg(((F.col("score") >= 0.5).cast("int") == F.col("toxic")).cast("int"))).first()[0] > 0.98


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op9_toxicity(spark, sf).filter("held_out").join(table(spark, sf, "labels"), "doc_id")
    row = found.agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert row[0] > 0.8 and row[1] < 0.01


# --- quality


def test_modified_kneser_ney(spark):
    rng = random.Random(9)
    texts = [" ".join(rng.choice("a b c d e f g".split()) for _ in range(rng.randrange(3, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.trained(docs, labels, train_docs=10**6)
    used = {r["doc_id"] for r in docs.filter(quality.chosen(60, 10**6)).collect()}
    grams = Counter()
    for d in used:
        w = ["<", "<", *texts[d].split()]
        grams.update(zip(w, w[1:], w[2:], strict=False))
    levels = {3: grams, 2: Counter(g[1:] for g in grams)}
    levels[1] = Counter(g[1:] for g in levels[2])

    def discounts(counts):
        n = Counter(counts.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        d1 = min(0.95, max(0.05, 1 - 2 * y * n[2] / n[1])) if n[1] else 0.5
        d2 = min(1.9, max(d1, 2 - 3 * y * n[3] / n[2])) if n[2] else d1
        d3 = min(2.9, max(d2, 3 - 4 * y * n[4] / n[3])) if n[3] else d2
        return lambda c: d1 if c == 1 else d2 if c == 2 else d3

    cuts = {m: discounts(c) for m, c in levels.items()}

    def p(gram):
        m = len(gram)
        if not m:
            return 1 / (len(levels[1]) + 1)
        own = {g: c for g, c in levels[m].items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:])
        total, c = sum(own.values()), own.get(gram, 0)
        return (max(0, c - cuts[m](c)) if c else 0) / total + sum(map(cuts[m], own.values())) / total * p(gram[1:])

    for text in ("a b c d", "g g zzz a", "e"):
        w = ["<", "<", *text.split()]
        want = sum(math.log(p(g)) for g in zip(w, w[1:], w[2:], strict=False))
        (_, _, words, ranges), = hashed_words(pa.array([text]), quality.CASED)
        assert model.log_probs(words, ranges)[0] == pytest.approx(want, rel=1e-4)


def test_all_trusted_text_serves_the_models(spark, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 500)
    rng = random.Random(19)
    some = lambda n: " ".join(rng.choice("a b c d e f g".split()) for _ in range(n))
    texts = [some(rng.randrange(3, 30)) for _ in range(80)] + [some(12_000), some(15_000), None, "", "g zzz a"]  # two of over 20,000 characters
    docs = spark.createDataFrame([(d, t, "ab"[d % 2]) for d, t in enumerate(texts)], "doc_id long, text string, lang string")
    trusted = {d for d in range(len(texts) - 1) if d % 3}
    labels = spark.createDataFrame([(d, int(d in trusted)) for d in range(len(texts))], "doc_id long, quality int")
    half = {r[0]: r[1] for r in docs.select("doc_id", quality.half()).collect()}
    assert {half[80], half[81]} <= {0, 1} and len(set(half.values())) == 2

    def model(part):
        grams = Counter()
        for d in trusted:
            if half[d] == part:
                w = ["<", "<", *(texts[d] or "").split()]
                grams.update(zip(w, w[1:], w[2:], strict=False))
        levels = {3: grams, 2: Counter(g[1:] for g in grams)}
        levels[1] = Counter(g[1:] for g in levels[2])
        cuts = {m: quality._cuts(Counter(c.values())) for m, c in levels.items()}
        owns = {m: {} for m in levels}
        for m, c in levels.items():
            for g, n in c.items():
                owns[m].setdefault(g[:-1], {})[g] = n

        def p(gram):
            m = len(gram)
            if not m:
                return 1 / (len(levels[1]) + 1)
            own = owns[m].get(gram[:-1])
            if not own:
                return p(gram[1:])
            cut, total, c = lambda n: cuts[m][min(n, 3) - 1], sum(own.values()), own.get(gram, 0)
            return (max(0, c - cut(c)) if c else 0) / total + sum(map(cut, own.values())) / total * p(gram[1:])

        return p

    models = {part: model(1 - part) for part in (0, 1)}  # each half is scored by the model of the other
    want = {}
    for d, t in enumerate(texts):
        w = ["<", "<", *(t or "").split()]
        logs = [math.log(models[half[d]](g)) for g in zip(w, w[1:], w[2:], strict=False)]
        want[d] = math.exp(-sum(logs) / len(logs)) if logs else None
    found = {r["doc_id"]: r for r in quality.judged(docs, labels).collect()}
    assert len(found) == len(texts)
    for d, r in found.items():
        assert (r["perplexity"] is None) if want[d] is None else r["perplexity"] == pytest.approx(want[d], rel=1e-4)
    for lang in "ab":  # of all trusted documents of the language
        of = [want[d] for d in sorted(trusted) if "ab"[d % 2] == lang and want[d]]
        assert all(r["threshold"] == pytest.approx(max(of) * quality.MARGIN, rel=1e-4) for r in found.values() if r["lang"] == lang)


def test_quality_sends_a_part_at_a_time(spark, monkeypatch):
    """What lies on disk at any time is a part of what is sent in all, and nothing but the result stays."""
    monkeypatch.setattr(quality, "BLOCK", 1 << 18)
    rng = random.Random(23)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 9))) for _ in range(20_000)]
    texts = [" ".join(words[int(20_000 * rng.random() ** 3)] for _ in range(1000)) for _ in range(1200)]
    docs = spark.createDataFrame([(d, t, "a") for d, t in enumerate(texts)], "doc_id long, text string, lang string").repartition(8)
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d in range(len(texts))], "doc_id long, quality int")
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [f.getPath() for f in manager.localDirs()] + [os.path.dirname(shared_folder(spark, "x")).removeprefix("file:")]

    def size():
        total = 0
        for top in tops:
            for at, _, names in os.walk(top):
                for name in names:
                    with contextlib.suppress(OSError):
                        total += os.path.getsize(f"{at}/{name}")
        return total

    seen, over, before = [], threading.Event(), size()

    def watch():
        while not over.wait(0.05):
            seen.append(size() - before)

    watcher = threading.Thread(target=watch)
    watcher.start()
    try:
        found = quality.judged(docs, labels)
    finally:
        over.set()
        watcher.join()
    held = sum(map(len, texts))
    assert found.filter("perplexity is not null").count() == len(texts)
    assert max(seen) < 4 * held
    for _ in range(50):  # shuffle files go in the background
        if (left := size() - before) < 0.1 * held:
            break
        time.sleep(0.1)
    assert left < 0.1 * held


def test_junk_is_told_from_trusted_text(spark):
    sf = "/root/testdata/sf0.1"
    found = queries.op3_quality(spark, sf).join(table(spark, sf, "labels"), "doc_id").groupBy("quality").agg(F.avg(F.col("keep").cast("int"))).collect()
    kept = {r[0]: r[1] for r in found}
    assert kept[1] > 0.98 and kept[0] < 0.5


# --- pseudo-likelihood


def test_network_gradients_and_order(spark):
    rng = random.Random(10)
    after = {f"w{k}": [f"w{(k * 3 + 1) % 40}", f"w{(k * 3 + 2) % 40}"] for k in range(40)}
    rows = []
    for d in range(1500):
        w = [f"w{rng.randrange(40)}"]
        while len(w) < 60:
            w.append(rng.choice(after[w[-1]]))
        rows.append((d, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    words = pseudo_likelihood.vocabulary(docs)
    network = pseudo_likelihood.trained(docs, words, rounds=4, batch=32)
    near = [np.full(pseudo_likelihood.WORDS, k, np.int32) for k in (70, 80, 90, pseudo_likelihood.NOTHING)]
    assert np.exp(network.log_probs(near, np.arange(pseudo_likelihood.WORDS)).astype(float)).sum() == pytest.approx(1, abs=1e-3)
    mixed = [(d, " ".join(rng.sample(t.split(), 60))) for d, t in rows[:200]]
    score = lambda r: pseudo_likelihood.scored(spark.createDataFrame(r, "doc_id long, text string"), words, network).agg(F.sum("log_prob") / F.sum("n_words")).first()[0]
    right, wrong = score(rows[:200]), score(mixed)
    assert right > -2.2 and right > wrong + 1.5


def test_every_word_is_a_target_in_one_round(spark, monkeypatch):
    (_, _, found, ranges) = next(hashed_words(pa.array(["a b a c", None, "", "a b a c d", "e " * 500])))
    for rounds in (1, 2, 5):
        turns = pseudo_likelihood.round_of(found, ranges, rounds)
        assert len(turns) == len(found) and set(turns.tolist()) == set(range(rounds))
    docs = spark.createDataFrame([(0, "a b c d e f g h " * 30)], "doc_id long, text string")
    learned = spark.sparkContext.accumulator(0)
    step = pseudo_likelihood.Network.learn
    network = pseudo_likelihood.Network

    class Counting(network):
        def learn(self, near, target):
            learned.add(len(target))
            step(self, near, target)

    monkeypatch.setattr(pseudo_likelihood, "Network", Counting)
    pseudo_likelihood.trained(docs, pseudo_likelihood.vocabulary(docs), batch=32)
    assert learned.value == 240


def test_row_sums_of_a_batch_are_those_of_its_words_one_by_one():
    rng = np.random.default_rng(4)
    back = rng.normal(size=(300, pseudo_likelihood.HIDDEN)).astype(np.float32)
    groups = np.concatenate([np.zeros(300), rng.integers(1, 9, 300), rng.integers(10, 400, 600)]).astype(np.int16)
    rows, sums = pseudo_likelihood.group_sums(back, groups)
    want = np.zeros((400, pseudo_likelihood.HIDDEN))
    np.add.at(want, groups, back[np.arange(len(groups)) % 300])
    assert sorted(rows.tolist()) == sorted(set(groups.tolist()))
    np.testing.assert_allclose(sums, want[rows], atol=1e-4)


def test_exponentials_of_distant_numbers_neither_overflow_nor_vanish():
    x = np.array([[0, 1, 2], [-500, -501, -500], [500, 0, -500]], np.float32)
    for rows in (x, x[:1]):
        exact = np.exp(rows.astype(float) - rows.max(axis=1, keepdims=True))
        np.testing.assert_allclose(pseudo_likelihood.softmax(rows.copy()), exact / exact.sum(axis=1, keepdims=True), rtol=1e-5, atol=1e-7)
        np.testing.assert_allclose(pseudo_likelihood.log_sums(rows.copy()), rows.max(axis=1) + np.log(exact.sum(axis=1)), rtol=1e-5)


def test_words_hashed_in_steps_have_the_same_hashes(monkeypatch):
    texts = pa.array(["a bb ccc " * 20, None, "d" * 5000 + " e", "", "f"])
    whole = [w.tolist() for _, _, w, _ in hashed_words(texts)]
    monkeypatch.setattr("attestor.llm.common.HASHED", 3)
    assert [w.tolist() for _, _, w, _ in hashed_words(texts)] == whole


def test_words_of_one_bucket_have_their_own_shares(spark):
    frequent = [f"f{k}" for k in range(pseudo_likelihood.WORDS - pseudo_likelihood.RARE)]
    (_, _, found, _) = next(hashed_words(pa.array([" ".join(f"r{k}" for k in range(2000))])))
    one, two, three, new = (f"r{k}" for k in np.flatnonzero(found % np.uint64(pseudo_likelihood.RARE) == found[0] % np.uint64(pseudo_likelihood.RARE))[:4])
    shape = "doc_id long, text string"
    docs = spark.createDataFrame([(0, " ".join(frequent * 9)), (1, f"{one} {one} {one} {one} {two} {two} {three}")], shape)
    words = pseudo_likelihood.vocabulary(docs)
    asked = [*enumerate((one, two, three, new, "f5")), (5, f"{one} f1"), (6, f"{two} f1"), (7, f"{one} f1"), (8, "")]
    found = pseudo_likelihood.scored(spark.createDataFrame(asked, shape), words, pseudo_likelihood.Network()).collect()
    log = {r["row"]["doc_id"]: r["log_prob"] for r in found}
    assert [log[k] - log[2] for k in (0, 1, 3)] == pytest.approx([math.log(4), math.log(2), 0], abs=1e-6)
    near = [np.full(1, pseudo_likelihood.NOTHING)] * 4
    whole = pseudo_likelihood.Network().log_probs(near, words.numbers(next(hashed_words(pa.array([one])))[2]))[0]
    assert sum(math.exp(log[k]) for k in range(4)) == pytest.approx(math.exp(whole), rel=1e-4)  # the shares add up to the bucket
    assert log[5] - log[6] == pytest.approx(math.log(2), abs=1e-6) and log[5] == pytest.approx(log[7]) and log[8] == 0


# --- pipeline


def test_pipeline_stages_against_brute_force(spark, docs):
    held, now = docs, {r["doc_id"]: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    held = stored(steps["language"](spark, held, SF), "t")
    model = langid.trained(docs)
    judged = dict(zip(now, model.judged([r["text"] for r in now.values()]), strict=True))
    texts = {r["doc_id"]: r["text"] for r in held.collect()}
    assert set(texts) == {d for d in now if not judged[d][3]}

    held = stored(steps["lines"](spark, held, SF), "t")
    owners = defaultdict(set)
    key = lambda x: x.strip(" \t\n\r\x0b\x0c").translate(LOWER)
    for d, t in texts.items():
        for x in t.split("\n"):
            if len(key(x)) >= 40:
                owners[key(x)].add(d)
    texts = {d: "\n".join(x for x in t.split("\n") if len(owners[key(x)]) < 5 or max(owners[key(x)]) == d) for d, t in texts.items()}
    assert {r["doc_id"]: (r["text"], r["n_chars"]) for r in held.collect()} == {d: (t, len(t)) for d, t in texts.items()}

    held = stored(steps["near_copies"](spark, held, SF), "t")
    prints = {d: brute_fingerprint(t) for d, t in texts.items()}
    keep = {min(d for d, p in prints.items() if p in g) for g in brute_groups(prints.values())}
    texts = {d: texts[d] for d in keep}
    assert {r["doc_id"]: r["text"] for r in held.collect()} == texts

    held = stored(steps["benchmark_leaks"](spark, held, SF), "t")
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    windows = defaultdict(set)
    for r in table(spark, SF, "benchmark").collect():
        w = words(r["text"])
        k = min(10, len(w))
        windows[k] |= {tuple(w[i : i + k]) for i in range(len(w) - k + 1) if k}
    leak = lambda w: any(tuple(w[i : i + k]) in s for k, s in windows.items() for i in range(len(w) - k + 1))
    texts = {d: t for d, t in texts.items() if not leak(words(t))}
    assert {r["doc_id"] for r in held.collect()} == set(texts)

    rows = steps["sequences"](spark, held, SF).collect()
    total = Counter()
    for r in rows:
        total[r["doc_id"]] += r["length"]
    assert total == Counter({d: len(re.findall("[^ \t\n\x0b\x0c\r]+", t)) for d, t in texts.items()})
    assert sorted(map(repr, rows)) == sorted(map(repr, corpus_pipeline.run(spark, SF).collect()))
