"""The training-data operators against brute force, and on nulls, empty and long texts, ties, repeats and odd columns."""

import collections
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import bagminhash, bytes as kernel, fingerprints, html_text, mixing, near_dedup, packing, quality_classifier, quality_rules, queries, sharding, substring_dedup, toxicity

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty, blank, very long, tied and repeated rows, extra columns with clashing names."""
    prose = " ".join(f"word{i} and more of it." for i in range(80))
    rows = [
        (1, prose, "en", "a", 5), (2, prose, "en", None, None), (2, prose, "en", None, None), (None, prose, None, "b", 1), (None, None, None, None, None), (5, None, "en", "a", 0),
        (6, "", "en", "a", 0), (7, " \n\t ", "en", "a", 4), (8, "x", "en", "b", 1), (9, "tail word " * 60_000, "en", "b", 1), (10, "é" * 300_000, "fr", "b", 1), (11, "ünï cödé 😀 end.", "de", "c", 9),
        (11, "same id, other text", "de", "c", 9), (12, prose + " One more.", "en", "a", 5),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in ("size", "shard", "bin_id", "kept", "words", "hash", "row", "did", "class", "n_removed", "_sl_votes", "skey", "label")})


def windows(words, k):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


def bag(text, k=5):
    w = WORD.findall(text or "")
    return collections.Counter(windows(w, k) if len(w) >= k else [tuple(w)] if w else [])


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_words_and_shingles():
    import pyarrow as pa

    given = ["a b  c\td", "", "x" * 3_000_000, "é ü", "one two three four five six", " lead"]
    data, offsets = kernel.utf8(pa.array(given))
    w = kernel.words(data, offsets)
    assert np.diff(w.bounds).tolist() == [len(WORD.findall(t)) for t in given]
    again = kernel.words(*kernel.utf8(pa.array(["zz", "a b  c\td"])))
    assert (again.hashes[1:] == w.hashes[:4]).all()
    doc, _ = kernel.shingles(w)
    assert np.bincount(doc, minlength=6).tolist() == [1, 0, 1, 1, 2, 1]


def test_rules_counters(docs, texts):
    for r in queries.op1_quality_rules(docs.sparkSession, SF).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        runs = collections.Counter(windows(w, 3))
        cover = {i + j for i, x in enumerate(windows(w, 3)) if runs[x] > 1 for j in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 50 or 100 * len(cover) > 50 * len(w))
        assert not (r.base_failed and r.kept)


def test_rules_find_junk(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rules.judged(docs).join(labels, "doc_id").filter("not base_failed").groupBy("quality", "kept").count().collect()
    n = {(r.quality, r.kept): r["count"] for r in got}
    assert n.get((1, False), 0) <= 0.01 * n[(1, True)] and n.get((0, True), 0) <= 0.1 * n[(0, False)]


def test_em_weighs_rules(spark):
    """Against a plain EM in Python."""
    import math

    patterns = [int("".join(map(str, p)), 3) for p in ([2] * 10, [0] * 4 + [1] * 6, [2] * 5 + [1] * 5, [0, 0] + [2] * 8) for _ in range(7)] + [5, 5, 29]
    table = collections.Counter(patterns)
    digits = {p: [p // 3**j % 3 for j in range(10)] for p in table}
    q = {p: 1 / (1 + math.exp(-(1 + sum({0: -2.5, 1: 0, 2: 0.5}[v] for v in d)))) for p, d in digits.items()}
    for _ in range(quality_rules.ROUNDS):
        good = sum(n * q[p] for p, n in table.items())
        bad = len(patterns) - good
        s = quality_rules.SMOOTHING
        ratio = {(j, v): math.log((sum(n * q[p] for p, n in table.items() if digits[p][j] == v) + s) / (good + 3 * s)) - math.log((sum(n * (1 - q[p]) for p, n in table.items() if digits[p][j] == v) + s) / (bad + 3 * s)) for j in range(10) for v in range(3)}
        q = {p: 1 / (1 + math.exp(-(math.log((good + 1) / (bad + 1)) + sum(ratio[j, v] for j, v in enumerate(d))))) for p, d in digits.items()}
    got = quality_rules.posteriors(spark.createDataFrame([(p,) for p in patterns], "pattern int")).collect()
    assert {r._sl_votes: r._sl_posterior for r in got} == pytest.approx(q, abs=2e-6)


def held_out(spark, classify, column):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = classify(docs, labels).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    return [(r.lang, r.predicted, r[column]) for r in got if r.held_out]


def balanced(rows):
    return (np.mean([p for _, p, y in rows if y]) + np.mean([1 - p for _, p, y in rows if not y])) / 2


def test_quality_holds_out(spark):
    assert balanced(held_out(spark, quality_classifier.classify, "quality")) >= 0.97


def test_toxicity_holds_out(spark):
    """Recall by language of labels the model has not seen, and false alarms; always answering no has a balanced accuracy of a half."""
    rows = held_out(spark, toxicity.classify, "toxic")
    recall = {lang: np.mean([p for x, p, y in rows if y and x == lang]) for lang in ("en", "de", "fr", "es")}
    assert recall["en"] >= 0.9 and recall["de"] >= 0.6 and recall["fr"] >= 0.6 and recall["es"] >= 0.3, recall
    assert np.mean([p for _, p, y in rows if not y]) <= 0.02 and balanced(rows) >= 0.88


def test_ftrl_against_a_plain_loop():
    """The same weights as follow-the-regularised-leader written one coordinate at a time."""
    import math

    rng = np.random.default_rng(4)
    size, rows = 12, []
    for _ in range(40):
        at = np.sort(rng.choice(size, 4, replace=False))
        rows.append((np.append(at, size), np.append(rng.random(4), 1.0)))
    y, weights = rng.integers(0, 2, 40).astype(float), rng.random(40) + 0.5
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)
    q = quality_classifier

    def weight(i):
        return 0.0 if abs(z[i]) <= q.L1 else -(z[i] - math.copysign(q.L1, z[i])) / ((q.BETA + math.sqrt(n[i])) / q.ALPHA + q.L2)

    order = np.arange(40)
    for epoch in range(2):
        np.random.default_rng(epoch).shuffle(order)
        for k in order:
            w = {i: weight(i) for i in rows[k][0]}
            p = 1 / (1 + math.exp(-sum(w[i] * x for i, x in zip(*rows[k], strict=True))))
            for i, x in zip(*rows[k], strict=True):
                g = (p - y[k]) * weights[k] * x
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / q.ALPHA * w[i]
                n[i] += g * g
    assert q.ftrl(rows, y, weights, size, 2) == pytest.approx([weight(i) for i in range(size + 1)])


def test_toxicity_of_a_text_is_its_own():
    """N-grams of a text do not depend on the texts beside it."""
    import pyarrow as pa

    texts = ["one two", "", " x ", "two", "end"]
    doc, code, _ = toxicity.grams(*kernel.utf8(pa.array(texts)))
    for k, t in enumerate(texts):
        assert code[doc == k].tolist() == toxicity.grams(*kernel.utf8(pa.array([t])))[1].tolist()


def test_kneser_ney_against_dictionaries(monkeypatch):
    """Log-ratios of trigrams of bytes from counts in plain dictionaries, lower orders shared by both classes."""
    import math

    import pyarrow as pa

    monkeypatch.setattr(toxicity, "ORDER", 3)
    texts = [["abab cab", "bad bad"], ["ab cd", "dab a", "cabd"]]
    counts = []
    for part in texts:
        c = collections.Counter()
        for word in " ".join(part).split():
            padded = "  " + word + " "
            c.update(padded[i - 2 : i + 1] for i in range(2, len(padded)))
        counts.append(c)
    types, d = set(counts[0]) | set(counts[1]), toxicity.DISCOUNT

    def lower(gram, grams):
        """Probability of the last byte after those before it, from how many grams of one more byte end in it."""
        if not gram:
            return 1 / 256
        ends = collections.Counter(g[1:] for g in grams)
        beside = {g: k for g, k in ends.items() if g[:-1] == gram[:-1]}
        below = lower(gram[1:], set(ends))
        return (max(ends[gram] - d, 0) + d * len(beside) * below) / sum(beside.values()) if beside else below

    def top(gram, c):
        beside = {g: k for g, k in c.items() if g[:-1] == gram[:-1]}
        below = lower(gram[1:], types)
        return (max(c[gram] - d, 0) + d * len(beside) * below) / sum(beside.values()) if beside else below

    (seen, ratio), _ = toxicity.log_ratios(*[toxicity._count(pa.array(part)) for part in texts])
    got = {"".join(chr(int(code) >> 8 * k & 255) for k in range(3)): r for code, r in zip(seen, ratio, strict=True)}
    assert got == pytest.approx({g: math.log(top(g, counts[0])) - math.log(top(g, counts[1])) for g in types})


def test_toxicity_table_loses_nothing():
    codes = np.unique(np.random.default_rng(1).integers(0, 1 << 32, 300_000, np.uint64))
    for n in (0, 1, len(codes) // 2):
        table = toxicity._table(codes[:n], np.arange(n) + 0.5)
        hit, value = toxicity._look(table, codes)
        assert hit[:n].all() and not hit[n:].any() and (value[:n] == np.arange(n) + 0.5).all()


def test_substring_brute(docs, texts):
    import pyarrow as pa

    got = {r.doc_id: r for r in queries.op3_substring_dedup(docs.sparkSession, SF).collect()}
    seen = {}
    for i in sorted(texts):
        t = texts[i]
        w = [(m.start(), m.end()) for m in WORD.finditer(t)]
        hashes = kernel.words(*kernel.utf8(pa.array([t]))).hashes.tolist()
        heads = [k for k, (a, _) in enumerate(w) if k == 0 or t[w[k - 1][1] - 1] in ".!?" or "\n" in t[w[k - 1][1] : a]]
        cuts, span = set(heads), substring_dedup.PIECE // 2
        for one, two in zip(heads, [*heads[1:], len(w)], strict=True):
            if two - one > substring_dedup.PIECE:
                cuts |= {min(range(k, k + span), key=lambda x: (hashes[x], -x)) for k in range(one, two - span + 1)}
        parts = [(w[one][0], two - one) for one, two in zip(sorted(cuts), [*sorted(cuts)[1:], len(w)], strict=True)]
        at = [p[0] for p in parts] + [len(t)]
        gone = set()
        for s in range(len(parts)):
            n, e = 0, s
            while e < len(parts) and (e - s < substring_dedup.SENTENCES or n < substring_dedup.MIN_WORDS):
                n, e = n + parts[e][1], e + 1
            if e - s >= substring_dedup.SENTENCES and n >= substring_dedup.MIN_WORDS and seen.setdefault(tuple(WORD.findall(t[at[s] : at[e]])), (i, s)) != (i, s):
                gone |= set(range(s, e))
        assert got[i].text == t[: at[0]] + "".join(t[at[s] : at[s + 1]] for s in range(len(parts)) if s not in gone)
        assert (got[i].n_sentences, got[i].n_removed) == (len(parts), len(gone))


def test_substring_at_every_offset(spark):
    """A passage of 51 words inside another long sentence, behind any number of words, loses a run."""
    new = iter(range(10_000))
    other = lambda n: " ".join(f"w{next(new)}" for _ in range(n))
    passage = [f"p{i}" for i in range(51)]
    first = " ".join([other(20), *passage, other(20)])
    rows = [(1, first)] + [(2 + k, f"{other(k)} {' '.join(passage)} {other(40 - k)}") for k in range(41)]
    got = {r.doc_id: r for r in substring_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].text == first
    for i, text in rows[1:]:
        lost = set(text.split()) - set(got[i].text.split())
        assert len(lost) >= 20 and lost <= set(passage)


def test_substring_of_equal_and_null_ids(spark):
    """Texts of one id, or of none, are ordered too: all but one lose what they share."""
    prose = " ".join(f"a{i} b{i} c{i} d{i} e{i}." for i in range(20))
    for rows in ([(None, prose)] * 3, [(7, prose)] * 3, [(None, prose), (None, prose + " More."), (None, "Other. " + prose)], [(7, prose), (7, prose + " More."), (8, prose)]):
        got = substring_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r.n_removed for r in got)[0] == 0 and sum(r.n_removed >= 20 for r in got) == 2, rows


def test_substring_floor(spark):
    """Without a floor plain runs of three sentences go, however short."""
    rows = [(1, "Yes. No. Maybe. First text here."), (2, "Other words. Yes. No. Maybe. Second one.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.n_removed for r in substring_dedup.cleaned(docs).orderBy("doc_id").collect()] == [0, 0]
    assert [r.n_removed for r in substring_dedup.cleaned(docs, min_words=0).orderBy("doc_id").collect()] == [0, 3]


def test_fingerprints(docs, texts):
    ids = sorted(texts)
    rows = {r.doc_id: r for r in fingerprints.fingerprinted(docs).collect()}
    for k, i in enumerate(ids):
        t, n = texts[i], texts[ids[(k + 1) % len(ids)]]
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert rows[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one, two = set(bag(t)), set(bag(edited))
        assert rows[i].near_edited == pytest.approx(len(one & two) / len(one | two), abs=0.2)
    a, b = (fingerprints.sketch(F.lit(" ".join(f"w{i}" for i in r)), 64) for r in (range(600), range(300, 900)))
    row = docs.sparkSession.range(1).select(fingerprints.distinct_shingles(a, 64).alias("n"), fingerprints.resemblance(a, b, 64).alias("r"), fingerprints.containment(a, b, 64).alias("c"), (fingerprints.decoded(fingerprints.encoded(a)) == a).alias("same"), (fingerprints.merged(a, b, 64) == fingerprints.sketch(F.lit(" ".join(f"w{i}" for i in range(900))), 64)).alias("whole")).first()
    assert row.same and row.whole and row.n == pytest.approx(596, rel=0.4) and row.r == pytest.approx(1 / 3, abs=0.18) and row.c == pytest.approx(0.5, abs=0.25)


def test_fingerprints_follow_any_ids(spark, monkeypatch):
    """Sparse, repeated and null ids, in many buckets: every row but the last is followed by the next."""
    rows = [(i * 10_000_019 - 4_000_000, f"text of {i}") for i in range(60)] + [(77, f"same id {i}") for i in range(60)] + [(None, f"no id {i}") for i in range(30)]
    whole = fingerprints.buckets
    monkeypatch.setattr(fingerprints, "buckets", lambda ids: whole(ids, 5, 40))
    got = fingerprints.with_next(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    after = {r.text: r.next_text for r in got}
    at, seen = rows[0][1], []
    while at not in seen:
        seen.append(at)
        at = after[at]
    where = {t: (i is None, i or 0) for i, t in rows}
    assert len(seen) == len(rows) == len(got) and at == rows[0][1]
    assert [where[t] for t in seen] == sorted(where.values())


def test_sharding(docs, texts):
    rows = queries.op5_sharding(docs.sparkSession, SF).collect()
    assert all(r.grown_shard in (r.shard, 40) and r.size == len(texts[r.doc_id].encode()) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in rows)
    for s in range(40):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    keys = np.arange(200_000)
    old, new = sharding.jump(keys, 40), sharding.jump(keys, 41)
    assert (old != new).mean() == pytest.approx(1 / 41, rel=0.1) and set(new[old != new]) == {40}
    assert np.bincount(old).min() > 4500 and np.bincount(old).max() < 5500


def test_jump_against_a_plain_loop():
    def plain(key, shards):
        key, at, ahead = int(kernel.mix(np.array([key], np.uint64))[0]), -1, 0
        while ahead < shards:
            at = ahead
            key = (key * 2862933555777941757 + 1) % (1 << 64)
            ahead = int((at + 1) * ((1 << 31) / ((key >> 33) + 1)))
        return at

    keys = np.concatenate([np.arange(500), np.random.default_rng(1).integers(0, 1 << 62, 500)])
    for shards in (1, 2, 40, 1000):
        assert sharding.jump(keys, shards).tolist() == [plain(int(k), shards) for k in keys]


def test_written_shards(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(None, "x")], "doc_id long, text string")
    sharding.write_shards(docs, f"{tmp_path}/shards", 5, 2)
    back = spark.read.parquet(f"{tmp_path}/shards")
    where = {(r.doc_id, r.text): r.shard for r in back.collect()}
    assert where == {(r.doc_id, t): r.shard for r, t in ((r, f"t{r.doc_id}" if r.doc_id is not None else "x") for r in sharding.shard_documents(docs, 5).collect())}


def test_mixing(docs, texts):
    rows = queries.op6_mixing(docs.sparkSession, SF).collect()
    source = {r.doc_id: r.source for r in docs.collect()}
    sizes, largest = collections.Counter(), collections.Counter()
    for i, t in texts.items():
        n = len(WORD.findall(t))
        sizes[source[i]] += n
        largest[source[i]] = max(largest[source[i]], n)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    capped = set()
    while True:  # rounds of resharing
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        free = sum(w for s, w in weight.items() if s not in capped)
        target = {s: 3 * sizes[s] if s in capped else weight[s] * left / free for s in sizes}
        over = {s for s in sizes if s not in capped and target[s] > 3 * sizes[s]}
        if not over:
            break
        capped |= over
    taken = collections.Counter()
    for r in rows:
        s = source[r.doc_id]
        assert (r.size, r.source_size) == (len(WORD.findall(texts[r.doc_id])), sizes[s]) and r.target == pytest.approx(target[s]) and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1 for s in sizes)
    assert sorted(rows) == sorted(queries.op6_mixing(docs.sparkSession, SF).collect())


def test_mixing_caps(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "small" if i < 2 else "zbig") for i in range(200)], "doc_id long, text string, lang string, source string")
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert target == {"small": 60.0, "zbig": 1940.0}


def test_bagminhash_is_unbiased():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    one, two = rng.integers(1, 9, 60), rng.integers(1, 9, 60)
    m = 20_000
    sign = bagminhash.signatures(np.repeat([0, 1], 60), np.concatenate([h, h]), np.concatenate([one, two]), 2, m)
    assert (sign[0] == sign[1]).mean() == pytest.approx(np.minimum(one, two).sum() / np.maximum(one, two).sum(), abs=0.015)


def test_near_dedup_brute(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    bags = {i: bag(t) for i, t in texts.items()}
    where = collections.defaultdict(list)
    for i in sorted(bags):
        for s in bags[i]:
            where[s].append(i)
    parent = {i: i for i in bags}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in {(a, b) for v in where.values() for k, a in enumerate(v) for b in v[k + 1 :]}:
        if jaccard(bags[a], bags[b]) >= 0.8:
            one, two = sorted((top(a), top(b)))
            parent[two] = one
    got = queries.op9_near_dedup(spark, "/root/testdata/sf0.01").collect()
    assert {r.doc_id: r.class_id for r in got} == {i: top(i) for i in bags}
    assert {r.doc_id for r in got if r.kept} == {i for i in bags if top(i) == i}


def test_near_dedup_compares_repeats_once(spark, monkeypatch):
    """Rows of equal id and text are one text, and the same copies under any ids are one class: one pair is checked."""
    one = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, one)] * 60 + [(2, one + " more")] * 60 + [(i, one) for i in range(100, 160)], "doc_id long, text string")
    checked = []
    whole = near_dedup.overlap
    monkeypatch.setattr(near_dedup, "overlap", lambda pairs, texts, k=5: (checked.append((pairs.count(), texts.count())), whole(pairs, texts, k))[1])
    got = near_dedup.near_duplicates(docs).collect()
    assert checked == [(1, 2)] and {r.class_id for r in got} == {1} and len(got) == 180


def test_salted_join(spark, monkeypatch):
    from spanloom.llm import skew
    from spanloom.llm.storage import written

    left = written(spark.range(5000).selectExpr("if(id < 4000, 7, id) k", "id v"), "test")
    right = left.select("k").distinct().withColumn("name", F.concat(F.lit("n"), "k"))
    got = skew.salted_join(left, right, "k", ["v"], left.groupBy("k").agg(F.count("*").alias("n")))
    assert sorted(map(tuple, got.select("k", "v", "name").collect())) == sorted((7 if i < 4000 else i, i, f"n{7 if i < 4000 else i}") for i in range(5000))


def test_near_dedup_of_a_group_without_a_hub(spark):
    """Copies that are near a base, some of them too far from each other: links are those of all pairs."""
    rng = np.random.default_rng(2)
    base = [f"b{i}" for i in range(300)]
    rows = []
    for i in range(300):
        w = list(base)
        for j in rng.choice(300, int(rng.integers(0, 14)), replace=False):
            w[j] = f"n{i}x{j}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bags = {i: bag(t) for i, t in rows}
    parent = list(range(300))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(300):
        for b in range(a):
            if jaccard(bags[a], bags[b]) >= 0.8:
                one, two = sorted((top(a), top(b)))
                parent[two] = one
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {i: top(i) for i in range(300)}


def test_packing(docs, texts):
    rows = queries.op10_packing(docs.sparkSession, SF).collect()
    assert collections.Counter({i: n for i, n in ((i, len(WORD.findall(t))) for i, t in texts.items())}) == sum((collections.Counter({r.doc_id: r.n_tokens}) for r in rows), collections.Counter())
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
    for own in bins.values():
        own.sort(key=lambda r: r.bin_offset)
        assert [r.bin_offset for r in own] == np.cumsum([0, *[r.n_tokens for r in own]])[:-1].tolist()
        used = sum(r.n_tokens for r in own)
        assert {r.bin_size for r in own} == {min(c for c in packing.CAPACITIES if c >= used)}


def test_best_fit_near_the_optimum():
    """Small inputs against every partition into bins; several lengths are in use; never above the largest length alone."""
    rng = np.random.default_rng(3)
    sizes = (512, 1024, 2048, 4096)

    def optimum(lengths):
        best = np.inf

        def go(i, bins):
            nonlocal best
            if i == len(lengths):
                best = min(best, packing.total_cost([min(c for c in sizes if c >= u) for u in bins]))
                return
            for k, u in enumerate(bins):
                if u + lengths[i] <= sizes[-1]:
                    go(i + 1, [*bins[:k], u + lengths[i], *bins[k + 1 :]])
            go(i + 1, [*bins, lengths[i]])

        go(0, [])
        return best

    over, opened = [], set()
    for _ in range(60):
        lengths = [int(x) for x in np.clip(np.exp(rng.normal(6.3, 1, int(rng.integers(1, 8)))), 1, 4096)]
        bins, offsets, final = packing.best_fit(lengths, sizes)
        for b, size in enumerate(final):
            own = sorted((o, n) for k, o, n in zip(bins, offsets, lengths, strict=True) if k == b)
            assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own]])[:-1].tolist() and size == min(c for c in sizes if c >= sum(n for _, n in own))
        largest = packing._pack(sorted(range(len(lengths)), key=lambda i: -lengths[i]), lengths, list(sizes), packing.OVERHEAD, packing.QUADRATIC, False)[2]
        assert packing.total_cost(final) <= packing.total_cost(largest)
        over.append(packing.total_cost(final) / optimum(lengths))
        opened |= set(final)
    assert np.mean(over) < 1.02 and max(over) < 1.25 and opened == set(sizes)


def test_best_fit_weighs_lengths():
    assert packing.best_fit([400, 100], (512, 1024))[2] == [512]
    assert packing.best_fit([1000, 1000, 24, 24], (1024, 4096), 0)[2] == [1024, 1024]
    assert packing.best_fit([1000, 1000, 24, 24], (1024, 4096), 50_000)[2] == [4096]
    assert packing.best_fit([300], (512, 8192)) == ([0], [0], [512]) and packing.best_fit([]) == ([], [], [])


def test_packing_uses_lengths_and_spreads_equal_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = collections.Counter(r.bin_size for r in packing.pack_documents(docs).select("bin_id", "bin_size").distinct().collect() if r.bin_id is not None)
    assert len(sizes) >= 3 and max(sizes.values()) <= 0.9 * sum(sizes.values())
    same = spark.createDataFrame([(None, "a b c")] * 400, "doc_id long, text string")
    blocks = collections.Counter(r.bin_id >> 32 for r in packing.pack_documents(same, block_rows=100).collect())
    assert sum(blocks.values()) == 400 and max(blocks.values()) < 200


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a>Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<{tag}><h1>Head &amp; more</h1><p><b>First  line<br>goes on.<p>Second
line &lt;b&gt; &#233;.</p><aside>Side</aside><ul><li>one<li>two</ul></{tag}><section id="comments"><p>Me too</p></section><footer>&copy; x</footer></body></html>"""


def test_html_lines():
    assert html_text.lines(PAGE.format(tag="article")) == (True, ["Head & more", "First line goes on.", "Second line <b> é.", "one", "two"])
    assert html_text.lines(PAGE.format(tag="div"))[0] is False
    assert html_text.lines(None) == (False, []) and html_text.lines("a < b") == (False, ["a < b"])


def test_html_differencing(spark):
    page = "<body><p>Site name</p><p>{}</p><p>All rights reserved</p></body>"
    rows = [(1, "http://h/a/1", page.format("one")), (2, "http://h/a/2", page.format("two")), (3, "http://other/a/1", page.format("three")), (4, None, None), (5, "http://h/a/2", page.format("two"))]
    got = {r.page_id: r for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)).collect()}
    assert got[1].text == "one" and got[2].text == "two" and got[4].text == "" and got[4].n_chars == 0
    assert got[3].text.split("\n")[1] == "three"
    assert html_text.shared(list("abcdef"), list("axcyef")) == {0, 2, 4, 5}


def test_html_shared_lines_of_any_number():
    """The same places as from the whole table, with moved and repeated lines, and no lines lost beyond 2,000."""

    def whole(a, b):
        table = [[0] * (len(b) + 1)]
        for x in a:
            above, row = table[-1], [0]
            for j, y in enumerate(b):
                row.append(above[j] + 1 if x == y else max(above[j + 1], row[j]))
            table.append(row)
        return table[-1][-1]

    rng = np.random.default_rng(1)
    for n, m, kinds in ((2500, 2300, 40), (30, 50, 3), (60, 20, 500), (0, 5, 2), (2300, 150, 4)):
        a, b = ([str(x) for x in rng.integers(0, kinds, k)] for k in (n, m))
        got = sorted(html_text.shared(a, b))
        assert len(got) == whole(a, b)
        rest = iter(b)
        assert all(a[k] in rest for k in got)
    template = [f"line {k}" for k in range(9000)]
    assert html_text.shared([*template, "own", "tail"], [*[f"new {k}" for k in range(3000)], *(["line 8999"] * 2500), *template, "tail", "x"]) == set(range(9000)) | {9001}


@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_html_repeated_pages(spark, ranges):
    """Copies, and paths of one text, pair with the nearest other text, in whatever ranges they lie."""
    page = "<body><p>Site name</p><p>{}</p><p>All rights reserved</p></body>"
    rows = [(i, f"http://h/a/{i // 10}?q={i}", page.format("ab"[i // 20])) for i in range(40)] + [(90, "http://alone/", page.format("c"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == {i: "ab"[i // 20] for i in range(40)} | {90: "Site name\nc\nAll rights reserved"}


def test_html_articles(spark):
    """Every page against a plain reading of its article element."""
    import html as entities

    got = {r.page_id: r for r in queries.op8_html_extraction(spark, "/root/testdata/sf0.01").collect()}
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    for page in pages:
        body = re.search(r"<article>(.*)</article>", page.html, re.S)[1]
        blocks = [re.sub(r"\s+", " ", entities.unescape(re.sub(r"</?b>", "", x.replace("<br>", " ")))).strip() for x in re.split(r"</?(?:p|h1)>", body)]
        text = "\n".join(x for x in blocks if x)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (text, len(text), page.url)
    assert len(got) == len(pages) == 250


def test_html_keeps_what_only_sounds_like_noise():
    inside = '<p title="the hidden cost">A b.</p><div class="side by side">C d.</div><p>F: <math><mi>E</mi></math> = end.</p><div class="ad">no</div><p hidden>no</p><div class=share>no</div><div class="co-sponsor-tale">T.</div>'
    assert html_text.lines(f"<article>{inside}</article>") == (True, ["A b.", "C d.", "F: E = end.", "T."])
    assert html_text.lines("<p a=b c='x>y' d=\"1>2\" e = \"3>4\">t</p><p>a < b & c</p>") == (False, ["t", "a < b & c"])


@pytest.mark.parametrize("page", ['<a "x ' * 30_000, '<a b="x ' * 30_001, '<a b="> ' * 30_001, "<a " * 60_000, "<div>" * 20_000 + "</span>" * 20_000, "<b>" * 20_000 + "<p>x" * 20_000, "<a b=' c=\" " * 20_001])
def test_html_hostile_pages_take_linear_time(page):
    import time

    began = time.time()
    html_text.lines(page)
    assert time.time() - began < 5


def test_html_odd_rows(spark):
    """Nulls, repeats, a very long page, clashing columns and an empty table."""
    names = ["host", "path", "key", "pair", "marked", "text", "part"]
    rows = [(1, None, None), (1, None, None), (None, "http://h/x", "<article><p>a</p></article>"), (3, "http://h/y", ""), (4, "http://h/z", "<article>" + "<p>word &amp; more</p>" * 40_000 + "</article>"), (5, "not a url", "<p>plain</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in names})
    got = html_text.extract(pages).collect()
    text = sorted((r.page_id or 0, r.text) for r in got)
    assert text == [(0, "a"), (1, ""), (1, ""), (3, ""), (4, "\n".join(["word & more"] * 40_000)), (5, "plain")]
    assert html_text.extract(pages.limit(0)).collect() == []


APPLY = {
    "rules": lambda d, n: quality_rules.judged(d),
    "rules stage": lambda d, n: quality_rules.kept_documents(d),
    "quality": lambda d, n: quality_classifier.classify(d, n),
    "toxic": lambda d, n: toxicity.classify(d, n),
    "substring": lambda d, n: substring_dedup.cleaned(d),
    "substring stage": lambda d, n: substring_dedup.cleaned_documents(d),
    "fingerprints": lambda d, n: fingerprints.fingerprinted(d),
    "shards": lambda d, n: sharding.shard_documents(d),
    "mix": lambda d, n: mixing.mix(d),
    "mix stage": lambda d, n: mixing.mixed_documents(d),
    "near": lambda d, n: near_dedup.near_duplicates(d),
    "near stage": lambda d, n: near_dedup.deduplicated(d),
    "packing": lambda d, n: packing.pack_documents(d),
}


@pytest.mark.parametrize("name", APPLY)
def test_odd_rows(spark, odd, name):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (8, 1, None), (None, 0, 1), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    out = APPLY[name](odd, labels).collect()
    assert APPLY[name](odd.limit(0), labels.limit(0)).collect() == []
    if name in ("rules", "quality", "toxic", "substring", "fingerprints", "shards", "mix", "near"):
        assert len(out) == odd.count()
    if name.endswith("stage"):
        assert APPLY[name](odd, labels).columns == odd.columns
    if name == "near stage":
        assert collections.Counter(r.doc_id for r in out)[2] == 0 and sum((r.text or "").startswith("word0") for r in out) == 1
    if name == "substring":
        assert [r[-1] for r in out if r.doc_id == 1] == [0] and all(r[-1] > 0 for r in out if r.doc_id == 12)
        assert sum(r.text is None for r in out) == 2
    if name == "packing":
        assert sum(r.n_tokens for r in out) == sum(len(WORD.findall(r.text or "")) for r in odd.collect())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF)
        if name != "packing":
            assert docs.columns == names
            docs.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name in ("quality rules", "near-dedup"):
            assert docs.exceptAll(before).isEmpty()
    assert docs.count() > 0
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_oracles_match(spark):
    import duckdb

    c = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    for name, sql in queries.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        columns = sorted(df.columns)
        got = c.execute(sql)
        order = [[d[0] for d in got.description].index(x) for x in columns]
        assert sorted(map(str, (tuple(r[i] for i in order) for r in got.fetchall()))) == sorted(map(str, map(tuple, df.select(*columns).collect()))), name
    assert json.dumps(sorted(queries.oracle_sql()))
