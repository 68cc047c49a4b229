"""Substring dedup, the Merkle manifest and the divergence audit against brute force, on odd inputs, and their SQL."""

import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fourfold.llm import classifier, common, divergence, merkle, mixing, neighbours, sharding, substrings

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("doc", "spans", "n_words", "n_removed", "runs", "group", "rank", "size", "hash", "kids", "load", "block", "place", "term", "n", "p", "q", "value", "item", "part", "tile", "low", "key")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, repeated rows and ids, ties, very long texts and words, and clashing columns."""
    long = " ".join(f"w{i % 97}x{i % 31}" for i in range(30_000))
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [
        (1, f"a b {passage} c", "en", "a", 1), (1, f"a b {passage} c", "en", "a", 1), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n\x0b ", "en", None, 5),
        (None, f"{passage} the id is null", "en", "b", 3), (None, passage, None, "", 1), (5, long, "en", "b", 1), (6, "x" * 300_000, None, "c", 1), (7, "1234 5678 !!!", "de", "c", 1),
        (8, "Ünïcödé 漢字 😀\n\nend ABC abc Äb", "de", "\U0001f600", 9), (9, f"{passage}\n{passage} {passage}", "en", "a", 2), (10, long + " z", "fr", "only", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(7) for c in CLASHING})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def removed(texts, window):
    """Flags of the words that go, texts in order."""
    seen, out = set(), []
    for t in texts:
        words = words_of(t)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        out.append((words, gone))
    return out


def checked(rows, window):
    rows = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    for r, (words, gone) in zip(rows, removed([r["was"] for r in rows], window), strict=True):
        assert (r["n_words"], r["n_removed"]) == (len(words), sum(gone))
        assert (r["text"] or "").encode() == b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        runs = [(k, len(list(g))) for k, g in itertools.groupby(gone)]
        assert len(r["spans"] or []) == sum(k for k, _ in runs) and sum(s["to"] - s["from"] for s in r["spans"] or []) == sum(gone)


@pytest.mark.parametrize(("window", "anchor"), [(4, 2), (5, 5)])
def test_substrings_against_brute_force(spark, window, anchor):
    rng = random.Random(window)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 25))] for _ in range(12)]
    texts = [" ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(pool)[rng.randint(0, 3) :]) for _ in range(150)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("was", F.col("text")).repartition(5)
    rows = substrings.dedup_substrings(frame, window=window, anchor=anchor).collect()
    assert len(rows) == len(texts)
    checked(rows, window)


def test_substrings_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST_KEYS", 0)
    texts = ["a b c d e f g h", "x b c d e y", "a b c d e f g h", "e f g h a b c d"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("was", F.col("text"))
    checked(substrings.dedup_substrings(frame, window=3, anchor=2).collect(), 3)


def test_substrings_odd(spark, odd, none):
    out = substrings.dedup_substrings(odd)
    assert out.columns == [c for c in odd.columns if c not in ("n_words", "n_removed", "spans")] + ["n_words", "n_removed", "spans"]
    rows = out.collect()
    assert len(rows) == odd.count() and all(r["doc"] == 7 and r["runs"] == 7 for r in rows)
    by = collections.defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert sorted(r["n_removed"] for r in by[1]) == [0, 33]  # the first read stays, the other goes as a whole
    assert [by[k][0]["n_removed"] for k in (2, 3, 4, 6, 7, 8)] == [0] * 6 and by[2][0]["text"] is None
    assert by[9][0]["n_removed"] == 90 and sorted(r["n_removed"] for r in by[None]) == [30, 30]
    # The long texts repeat every 97 * 31 words.
    assert by[5][0]["n_words"] - by[5][0]["n_removed"] == 97 * 31 + 0 and by[10][0]["n_removed"] == 30_000
    assert substrings.dedup_substrings(none).count() == 0


def test_rolling_hashes_and_least():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 5, 200).astype(np.uint64)
    for n in (1, 2, 3, 5, 8, 13, 20):
        hashes = substrings.rolling(words, n)
        runs = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
        assert len(hashes) == len(runs) and len(set(hashes.tolist())) == len(set(runs)) == len(set(zip(hashes.tolist(), runs, strict=True)))
        assert substrings.least(words, n).tolist() == [min(r) for r in runs]
        assert len(substrings.rolling(words[: n - 1], n)) == 0
    assert substrings.merged(np.array([5 << 32 | 3, 1 << 32 | 2, 3 << 32 | 1, 20 << 32 | 4])).tolist() == [[1, 4], [5, 8], [20, 24]]


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    values = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return sha("".join("-" if v is None else f"{len(v.encode())}:{v}" for v in values))


def tree(leaves):
    """The root, and the siblings left and right of each leaf by level."""
    proofs, at = [[] for _ in leaves], [[k] for k in range(len(leaves))]
    nodes = list(leaves)
    while len(nodes) > 1:
        for i in range(len(nodes)):
            lo = i - i % 3
            step = ("".join(nodes[lo:i]), "".join(nodes[i + 1 : lo + 3]))
            for k in at[i]:
                proofs[k].append(step)
        at = [[k for own in at[i : i + 3] for k in own] for i in range(0, len(nodes), 3)]
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], proofs


def expected(rows):
    by = collections.defaultdict(list)
    for r in rows:
        by[r["source"]].append((r["doc_id"] is None, r["doc_id"] or 0, leaf_of(r, r["text"]), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: (sorted(by[s], key=lambda x: x[:3]), *tree([x[2] for x in sorted(by[s], key=lambda x: x[:3])])) for s in names}
    root, above = tree([trees[s][1] for s in names])
    out = []
    for s, up in zip(names, above, strict=True):
        own, subroot, proofs = trees[s]
        for (_, _, leaf, r), proof in zip(own, proofs, strict=True):
            even = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
            acc = leaf_of(r, (r["text"] or "").replace("\n", "") if even and r["text"] is not None else r["text"])
            for left, right in proof + up:
                acc = sha(left, acc, right)
            out.append((str(r["doc_id"]), leaf, subroot, root, sha("".join(a + b for a, b in proof + up)), acc, str(acc == root)))
    return sorted(out)


def manifest_rows(spark, frame, tmp_path):
    frame.write.parquet(str(tmp_path / "documents.parquet"))
    got = merkle.op12_merkle_manifest(spark, str(tmp_path)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(tuple(str(v) for v in r) for r in got)


@pytest.mark.parametrize("levels", [1, 6])
def test_manifest_against_brute_force(spark, odd, tmp_path, monkeypatch, levels):
    """levels: small blocks make several tiers."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    monkeypatch.setattr(merkle, "BLOCK", 3**levels)
    rng = random.Random(levels)
    rows = [(i, rng.choice(["a\nb", "c", "", None]), rng.choice(["en", None]), rng.choice(["s0"] * 6 + [f"s{k}" for k in range(12)] + [None, "ü"]), rng.choice([None, 5])) for i in range(130)]
    frame = spark.createDataFrame(rows, SCHEMA).unionByName(odd.select("doc_id", "text", "lang", "source", "n_chars"))
    assert manifest_rows(spark, frame, tmp_path) == expected(frame.collect())


def test_manifest_of_one_and_of_none(spark, none, tmp_path):
    one = spark.createDataFrame([(3, "x", "en", "a", 1)], SCHEMA)
    got = manifest_rows(spark, one, tmp_path / "one")
    assert got == expected(one.collect()) and got[0][1] == got[0][2] == got[0][3]
    assert manifest_rows(spark, none, tmp_path / "none") == []


def audited(rows, least, top):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for r in rows:
        own = term.findall((r["text"] or "").translate(fold))
        counts[r["lang"] or "", r["source"] or ""].update(own)
        docs[r["lang"] or ""].update(set(own))
    out = []
    for lang in docs:
        kept = [t for t, n in docs[lang].items() if n >= least]
        names = [s for x, s in counts if x == lang]
        total = sum((counts[lang, s] for s in names), collections.Counter())

        def share(c, kept=kept):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (n + 5 * len(kept)) for t in kept}

        p, q = {s: share(counts[lang, s]) for s in names}, share(total)
        for s in names:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in names if o != s]
            terms = [(p[s][t] - q[t], t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", sorted(terms, key=lambda x: (-x[0], x[1].encode()))[:top])):
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())))]
    return sorted(out)


@pytest.mark.parametrize(("rows", "columns", "least"), [(2, 4, 1), (4, 1000, 100)])
def test_divergence_against_brute_force(spark, odd, none, monkeypatch, rows, columns, least):
    """Small tiles cut both ways; with `least` 100 no term is kept and pairs are worth nothing."""
    monkeypatch.setattr(divergence, "ROWS", rows)
    monkeypatch.setattr(divergence, "COLUMNS", columns)
    monkeypatch.setattr(divergence, "LEAST_DOCS", least)
    rng = random.Random(rows)
    words = ["Alpha", "beta", "x1y", "é-ß", "漢", "GAMMA", *[f"w{chr(97 + i)}" for i in range(20)]]
    made = [(i, " ".join(rng.choices(words, k=rng.randint(0, 12))), rng.choice(["en", "de"]), f"s{rng.randint(0, 6)}", 1) for i in range(80)]
    frame = odd.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame(made, SCHEMA)).withColumns({c: F.lit(7) for c in CLASHING})
    got = divergence.divergence(frame).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(tuple(r) for r in got) == audited(frame.collect(), least, divergence.TOP)
    assert divergence.divergence(none).count() == 0


def test_pair_sums_against_dense():
    rng = np.random.default_rng(3)
    for rows, columns, share in ((5, 7, 0.3), (33, 70, 0.02), (64, 64, 0.9), (3, 1, 1.0), (4, 0, 0.0)):
        there = rng.random((rows, columns)) < share
        empty = rng.integers(1, 1000, rows)
        dense = np.where(there, rng.integers(1, 10**9, (rows, columns)), empty[:, None])
        row, column = np.nonzero(there)
        want = np.abs(dense[:, None, :] - dense[None, :, :]).sum(axis=2)
        everything, low, high = np.arange(rows), np.arange(rows // 2), np.arange(rows // 2, rows)
        got = divergence.pair_sums(row, column, dense[row, column], empty, everything, everything, columns)
        assert (np.triu(got, 1) == np.triu(want, 1)).all()
        assert (divergence.pair_sums(row, column, dense[row, column], empty, low, high, columns) == want[np.ix_(low, high)]).all()


def test_long_words_hash_alike():
    """Words that lie across several runs of bytes have the hash that they have alone."""
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, n).astype(np.uint8)) for n in (5, 70_000, 3, 200_000, 1, 65_536, 65_535)]
    together = common.Words([b" ".join(words), None, b"", words[3]]).hashes()
    alone = [int(common.Words([w]).hashes()[0]) for w in words]
    assert together.tolist() == [*alone, alone[3]] and len(set(alone)) == len(alone)
    assert common.Words([words[1].upper()]).hashes(fold=True)[0] == common.Words([words[1]]).hashes(fold=True)[0]
    assert all(len(k) <= common.RUN for k in common._powers.values())


def test_callers_columns_keep_their_values(spark):
    rows = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("text no "), F.col("id") % 50).alias("text"), F.lit("s").alias("source"))
    names = ("size", "source_size", "target", "copies", "row", "key", "part", "before")
    frame = rows.withColumns({n: F.col("doc_id") + k for k, n in enumerate(names)})
    for r in mixing.mix(frame).collect():
        assert all(r[n] == r["doc_id"] + k for k, n in enumerate(names))
    for r in sharding.histogram_shards(frame, shards=4).collect():
        assert all(r[n] == r["doc_id"] + k for k, n in enumerate(names) if n != "size")
    assert mixing.mix(frame.withColumnRenamed("source", "origin"), source="origin").columns == ["doc_id", "text", "origin", *names]


def test_pairs_of_copies_stay_together(spark):
    """A boundary near the end of a small group is moved to it rather than cut through."""
    rows = spark.range(600).select(F.col("id").alias("doc_id"), F.repeat(F.concat(F.lit("x"), F.floor(F.col("id") / 2)), 20).alias("text"))
    out = sharding.histogram_shards(rows, shards=10).groupBy("text").agg(F.countDistinct("shard").alias("n")).filter("n > 1").count()
    assert out <= 4


@pytest.mark.parametrize(("scale", "offset"), [(1.0, 1e8), (1e200, 0.0), (1e154, 3e154)])
def test_neighbours_of_shifted_and_huge_vectors(spark, scale, offset):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)) * scale + offset
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = neighbours.nearest_neighbours(frame, frame.filter("vec_id % 20 = 0"), window=60).collect()
    assert len(got) == 20 * 10 and all(np.isfinite(r["score"]) for r in got)
    hit = 0
    for q in range(0, 400, 20):
        far = neighbours.distances(x, x[q])
        true = [i for i in np.lexsort((np.arange(400), far)).tolist() if i != q][:10]
        own = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        hit += len(set(true) & own.keys())
        assert all(own[i] == pytest.approx(far[i], rel=1e-12) for i in own)
    assert hit / 200 >= 0.9


def plain_boosting(x, y):
    """Cyclic boosting as its definition says, row by row: every cut is tried on the rows themselves. Returns the margins of the rows."""
    c = classifier
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, c.BINS) / c.BINS)) for i in range(x.shape[1])]
    at = [[int((e <= v).sum()) for v in x[:, i]] for i, e in enumerate(edges)]
    margin = [math.log(y.mean() / (1 - y.mean()))] * len(y)
    gain = lambda rows, g, h: sum(g[r] for r in rows) ** 2 / (sum(h[r] for r in rows) + c.RIDGE)
    leaf = lambda rows, g, h: -sum(g[r] for r in rows) / (sum(h[r] for r in rows) + c.RIDGE)

    def slopes():
        p = [1 / (1 + math.exp(-m)) for m in margin]
        return [a - b for a, b in zip(p, y, strict=True)], [a * (1 - a) for a in p]

    def tree(rows, bins, lo, hi, g, h, depth):
        best, cut = 1e-9, None
        for k in range(lo + 1, hi):
            left, right = [r for r in rows if bins[r] < k], [r for r in rows if bins[r] >= k]
            if min(len(left), len(right)) >= c.LEAST:
                got = gain(left, g, h) + gain(right, g, h) - gain(rows, g, h)
                if got > best + 1e-12:
                    best, cut = got, k
        if depth == 0 or cut is None:
            return {r: leaf(rows, g, h) for r in rows}
        return tree([r for r in rows if bins[r] < cut], bins, lo, cut, g, h, depth - 1) | tree([r for r in rows if bins[r] >= cut], bins, cut, hi, g, h, depth - 1)

    for _ in range(c.ROUNDS):
        for bins in at:
            g, h = slopes()
            for r, v in tree(range(len(y)), bins, 0, c.BINS, g, h, 2).items():
                margin[r] += c.RATE * v
    coarse = [[b // (c.BINS // c.PAIR_BINS) for b in bins] for bins in at]

    def quarters(i, j, g, h):
        best = None
        for a in range(1, c.PAIR_BINS):
            for b in range(1, c.PAIR_BINS):
                parts = [[r for r in range(len(y)) if (coarse[i][r] < a) == low and (coarse[j][r] < b) == left] for low in (True, False) for left in (True, False)]
                got = sum(gain(p, g, h) for p in parts)
                if best is None or got > best[0] + 1e-12:
                    best = got, parts
        return best

    g, h = slopes()
    pairs = sorted(itertools.combinations(range(x.shape[1]), 2), key=lambda p: -quarters(*p, g, h)[0])[: c.PAIRS]
    for _ in range(c.PAIR_ROUNDS):
        for p in pairs:
            g, h = slopes()
            for rows in quarters(*p, g, h)[1]:
                step = c.RATE * leaf(rows, g, h)
                for r in rows:
                    margin[r] += step
    return pairs, margin


def test_boosting_against_a_direct_fit(monkeypatch):
    """Three features, of which two speak together only: turns, trees, the choice of pairs and their quarters."""
    for name, value in (("ROUNDS", 4), ("PAIR_ROUNDS", 3), ("PAIRS", 2)):
        monkeypatch.setattr(classifier, name, value)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(160, 3))
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(160) < 0.1)).astype(float)
    pairs, margin = plain_boosting(x, y)
    model = classifier.fit(x, y)
    assert model.pairs == pairs and pairs[0] == (0, 1)
    assert model.margin(x) == pytest.approx(margin, abs=1e-9)
