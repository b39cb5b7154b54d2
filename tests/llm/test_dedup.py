"""Removal of repeats and near copies against brute force, and on awkward rows."""

import hashlib
import os
import re

import numpy as np
import pytest

from sparkdetect.llm import near_duplicates, packed, substrings, suffixes
from sparkdetect.llm.common import mix, powers, prefix_hash, rolling_hash, span_hash, words

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")


def in_order(rows):
    """As the operators order rows: null ids last, then a hash of the text."""
    digest = lambda t: int.from_bytes(hashlib.md5((t or "").encode()).digest()[:4], "big")
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, digest(r[1])))


def brute_words(rows, width=20):
    seen, out = set(), []
    for i, text in in_order(rows):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for j in range(len(w) - width + 1):
            key = tuple(w[j : j + width])
            if key in seen:
                gone[j : j + width] = [True] * width
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_bytes(rows, width=100):
    seen, out = set(), []
    for i, text in in_order(rows):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for j in range(len(raw) - width + 1):
            key = raw[j : j + width]
            if key in seen:
                gone[j : j + width] = b"\1" * width
            seen.add(key)
        kept = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("size", [2 << 20, 20_000])
def test_repeated_words(spark, docs, size):
    want = brute_words([tuple(r) for r in docs.collect()])
    got = substrings.without_repeats(docs.repartition(3), False, size)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want


@pytest.mark.parametrize("bits", [64, 24])
def test_words_are_compared(spark, docs, bits):
    """With 24 bits of a hash different windows meet; they are told apart by their words and ask again."""
    want = brute_words([tuple(r) for r in docs.collect()])
    got = substrings.without_repeats(docs.repartition(3), False, 50_000, bits)
    assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want


@pytest.mark.parametrize(("size", "hot", "fan"), [(2 << 20, 1000, 64), (20_000, 1000, 4), (20_000, 3, 64)])
def test_repeated_bytes(spark, docs, size, hot, fan, monkeypatch):
    monkeypatch.setattr(suffixes, "MERGED", 500)  # many ranges
    want = brute_bytes([tuple(r) for r in docs.collect()])
    got = suffixes.without_repeats(docs.repartition(3), False, size, hot, fan)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == want


def test_strings_with_zeros_and_ends(spark):
    """Zero bytes, strings at the ends of documents, runs of one byte and lines that many documents share."""
    rng = np.random.default_rng(5)
    line = "".join(chr(97 + x) for x in rng.integers(0, 26, 180))
    texts = ["\0" * 300, "\0" * 99, "a" * 250, "b\0" * 120, line, line[:100], line[80:], line[:99]]
    texts += ["".join(chr(97 + x) for x in rng.integers(0, 3, rng.integers(0, 150))) + line[rng.integers(0, 60) : rng.integers(120, 181)] + "\0" * int(rng.integers(0, 3)) for _ in range(60)]
    rows = [(int(i), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for hot in (1000, 5):
        assert sorted((tuple(r)[:5] for r in suffixes.without_repeats(df, False, 2000, hot, 3).collect()), key=str) == brute_bytes(rows)


def test_repeats_on_awkward_rows(spark, odd, empty):
    rows = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert sorted((tuple(r)[:4] for r in substrings.without_repeats(odd, False, 50_000).collect()), key=str) == brute_words(rows)
    assert sorted((tuple(r)[:5] for r in suffixes.without_repeats(odd, False, 50_000).collect()), key=str) == brute_bytes(rows)
    assert substrings.without_repeats(empty).count() == suffixes.without_repeats(empty).count() == 0


def test_texts_are_kept_on_demand(spark):
    df = spark.createDataFrame([(1, "x " * 30), (2, "lead " + "x " * 30)], "doc_id long, text string")
    assert {r["doc_id"]: r["kept"] for r in substrings.without_repeats(df).collect()} == {1: "x", 2: "lead"}
    long = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(60))
    df = spark.createDataFrame([(1, long), (2, "ab" + long + "cd")], "doc_id long, text string")
    assert {r["doc_id"]: bytes(r["kept"]) for r in suffixes.without_repeats(df).collect()} == {1: long.encode(), 2: b"abcd"}


def test_loser_tree_merges_in_order():
    rng = np.random.default_rng(3)
    runs = []
    for _ in range(7):
        texts = sorted(bytes(rng.integers(97, 99, rng.integers(0, 9)).astype(np.uint8)) for _ in range(rng.integers(0, 30)))
        shared = [suffixes.shared_length(a, b, 0) for a, b in zip([b"", *texts], texts, strict=False)]
        runs.append((texts, shared))
    out = [(runs[r][0][i], n) for r, i, n in suffixes.merged(runs)]
    assert [t for t, _ in out] == sorted(t for texts, _ in runs for t in texts)
    assert [n for _, n in out[1:]] == [suffixes.shared_length(a[0], b[0], 0) for a, b in zip(out, out[1:], strict=False)]


def test_packed_values_come_back():
    values = np.unique(mix(np.arange(1000, dtype=np.uint64)))
    assert (packed.unpack(packed.pack(values)) == values).all() and len(packed.unpack(packed.pack(values[:0]))) == 0


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"abcdefgh--abcdefgh", np.uint8)
    prefix = prefix_hash(data)
    a, b = span_hash(prefix, np.array([0, 10]), np.array([8, 18]))
    assert a == b and rolling_hash(prefix, 4)[0] == rolling_hash(prefix, 4)[10] and rolling_hash(prefix, 99).size == 0
    assert powers(3)[2] == np.uint64(pow(int(powers(3)[1]), 2, 1 << 64))
    assert [x.tolist() for x in words(np.frombuffer(b"  a bc\n", np.uint8))] == [[2, 4], [3, 6]]


def shingle_set(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    texts = sorted({t for _, t in rows if t is not None})
    sets, root = {t: shingle_set(t) for t in texts}, {t: t for t in texts}

    def find(t):
        while root[t] != t:
            t = root[t]
        return t

    for i, a in enumerate(texts):
        for b in texts[:i]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    low = {}
    for i, t in rows:
        if t is not None and i is not None:
            low[find(t)] = min(i, low.get(find(t), i))
    return sorted(((i, i if t is None else low.get(find(t), i)) for i, t in rows), key=str)


def test_near_copies(spark, docs, odd, empty):
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        got = near_duplicates.near_duplicates(df).select("doc_id", "class_id").collect()
        assert sorted(map(tuple, got), key=str) == brute_classes(rows)
    assert near_duplicates.near_duplicates(empty).count() == 0


def test_a_group_of_near_copies_is_compared_whole(spark):
    """Copies of one text with one to six words changed: some are only linked through others."""
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for p in rng.choice(120, rng.integers(1, 7), replace=False):
            w[p] = f"x{rng.integers(9)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "class_id").collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_signatures_estimate_the_similarity():
    texts = [" ".join(f"a{i}" for i in range(400)).encode(), " ".join(f"a{i}" for i in range(40, 440)).encode(), b"a b a b a b a b a b", b""]
    own, value, count = near_duplicates.shingles(texts)
    sig = near_duplicates.signatures(own, value, np.ones(len(own)), 4, 4096)
    true = 356 / 436
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5
    assert set(count[own == 2]) == {3} and (sig[3] == 0).all()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_queries_return_a_row_for_each_document(spark, docs):
    n = docs.count()
    for f in (substrings.op6_substring_dedup, suffixes.op2_suffix_dedup, near_duplicates.op4_near_dedup):
        assert f(spark, SF).count() == n


def test_texts_that_differ_by_a_repeated_line_meet(spark):
    """The relation is that of sets, however often a shingle occurs."""
    texts = []
    for k in range(16):
        text = " ".join(f"t{k}w{i}" for i in range(100))
        texts += [text, text + f" {' '.join(f'line{k}x{i}' for i in range(12))}" * (20 if k % 2 else 200)]
    rows = list(enumerate(texts))
    got = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    want = sorted(brute_classes(rows))
    assert sorted((r["doc_id"], r["class_id"]) for r in got.collect()) == want and {c for _, c in want} == set(range(0, 32, 2))
    # nor does the bound on agreeing components rule out such pairs
    own, value, count = near_duplicates.shingles([t.encode() for t in texts])
    sets, weighted = near_duplicates._both_signatures(own, value, count, len(texts))
    assert all((sets[i] == sets[i + 1]).sum() >= 87 for i in range(0, 32, 2)) and any((weighted[i] == weighted[i + 1]).sum() < 95 for i in range(0, 32, 2))
    # 400 pairs that differ by how often a line of 24 words stands in them
    pairs = [(" ".join(f"a{k}x{i}" for i in range(24)), " ".join(f"b{k}x{i}" for i in range(24))) for k in range(400)]
    own, value, count = near_duplicates.shingles([t.encode() for a, b in pairs for t in (a + (" " + b) * 50, a + " " + b)])
    keys = near_duplicates._band_keys(near_duplicates._both_signatures(own, value, count, 800)[0])
    assert (keys[::2] == keys[1::2]).any(1).mean() > 0.99
