"""Source divergence, packing and resampling, each against brute force."""

import bisect
import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import packing, queries, resampling, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, n long, term string, rank int, c0 string"
WORDS = ["ba", "Kol", "ri", "the", "été", "Öl", "x1", "42", "日本", "o'clock", "a-b", "zz"]
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def make(spark, rows):
    """rows: doc_id, text, lang, source; the further columns have names that operators use inside."""
    return spark.createDataFrame([(*r, 0, "x", 1, "y", 2, "z") for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def rows():
    r = random.Random(8)
    said = lambda n: " ".join(r.choices(WORDS, [2 ** -(i / 3) for i in range(len(WORDS))], k=n))
    out = [(i, said(r.randint(0, 60)), r.choice(["en", "fr"]), r.choice("abcdefg")) for i in range(150)]
    out += [(200 + i, "copy of " + "ba ri " * 15, "en", "a") for i in range(80)]  # a third of all rows
    out += [(300, None, "en", "only null"), (301, "", "de", "s"), (302, " \n\t", "de", None), (303, said(20_000), "fr", "a"), (304, said(50), None, "b"), (305, said(50), "", None)]
    out += [(306, "<|endoftext|> is text " * 9, "en", "b"), (None, said(30), "en", "a"), (None, said(30), "en", "a"), (7, said(25), "en", "a"), (7, said(25), "en", "a")]
    out += [(400 + i, "rare", "xx", c) for i, c in enumerate("pq")]  # a language that keeps no term
    out += [(500 + i, "日本 ба́ \x00 nul", "yy", f"s{i % 40}") for i in range(80)]  # more groups than a block
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return make(spark, rows).cache()


@pytest.fixture(scope="module")
def nothing(spark):
    return make(spark, []).limit(0)


# ---- divergence


def divergence_of(rows, least=10, top=10):
    count, docs, total = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        count[lang or "", source or ""].update(words)
        docs[lang or ""].update(set(words))
        total[lang or ""].update(words)
    out = []
    for lang in {g[0] for g in count}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c, kept=kept: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        groups = {g[1]: share(c) for g, c in count.items() if g[0] == lang}
        q = share(total[lang])
        apart = lambda a, b: (a - b) ** 2 // (a + b)
        for s, p in groups.items():
            pairs = [(o, sum(apart(p[t], z[t]) for t in kept)) for o, z in groups.items() if o != s]
            terms = [(t, apart(p[t], q[t])) for t in kept if count[lang, s][t] and p[t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(ranked)]
    return sorted(out)


@pytest.mark.parametrize(("chunk", "stripe", "block", "held"), [(4096, 4, 16, 400_000), (2, 1, 3, 5), (3, 2, 1, 1)])
def test_divergence(docs, rows, monkeypatch, chunk, stripe, block, held):
    parts = source_divergence.term_counts
    monkeypatch.setattr(source_divergence, "term_counts", lambda d: parts(d, held))
    got = source_divergence.divergence(docs, chunk=chunk, stripe=stripe, block=block)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == divergence_of(rows)


def test_divergence_keeps_all_terms_of_small_thresholds(docs, rows):
    assert sorted(map(tuple, source_divergence.divergence(docs, least=1, top=3).collect())) == divergence_of(rows, 1, 3)


def test_divergence_of_nothing(nothing):
    assert source_divergence.divergence(nothing).count() == 0


def test_shares_of_large_counts(spark):
    r = random.Random(3)
    each = [(n := r.randrange(10 ** r.randint(1, 15)), n + r.randrange(10 ** r.randint(1, 15)), r.randint(1, 10**6)) for _ in range(300)]
    want = [1 + 10**9 * (n + 2) // (w + 2 * v) for n, w, v in each]
    assert source_divergence.shares(*map(np.array, zip(*each, strict=True))).tolist() == want
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(each)], "i int, n long, w long, v long")
    assert [x[0] for x in rows.select("i", source_divergence.share("n", "w", "v").alias("p")).orderBy("i").select("p").collect()] == want


# ---- packing


def check_packing(got, texts, capacity=1024):
    """got: rows of pack with ids; texts: (doc_id, text) of all documents. Returns the number of sequences."""
    tok = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter()
    for doc, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
        edges = [0, *range(first, len(ids) + 1, capacity)] if len(ids) > capacity else [0, len(ids)]
        for k, (a, z) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            want[doc, k, a, z - a, np.array(ids[a:z], "<u4").tobytes()] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in got) == want
    filled = collections.defaultdict(list)
    for r in got:
        filled[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in filled.values():
        parts.sort()
        assert [o for o, _ in parts] == [0, *np.cumsum([n for _, n in parts])[:-1]] and sum(n for _, n in parts) <= capacity
    return len(filled)


def best_fit(lengths, capacity=1024):
    """Sequences that best fit from the longest down needs, one piece at a time."""
    gaps, used = [], 0
    for n in sorted(lengths, reverse=True):
        i = bisect.bisect_left(gaps, n)
        if i == len(gaps):
            used += 1
            bisect.insort(gaps, capacity - n)
        else:
            bisect.insort(gaps, gaps.pop(i) - n)
    return used


@pytest.mark.parametrize("capacity", [1024, 32, 3, 1])
def test_packing(docs, rows, capacity):
    got = packing.pack(docs, TOKENIZER, public_tokenizers.PATTERN, capacity).collect()
    used = check_packing(got, [r[:2] for r in rows], capacity)
    assert used <= best_fit([r["length"] for r in got], capacity)
    assert sorted({r["sequence_id"] for r in got}) == list(range(used))


def test_packing_query(spark):
    d = "/root/testdata/sf0.001"
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{d}/documents.parquet").collect()]
    got = packing.pack(spark.read.parquet(f"{d}/documents.parquet"), TOKENIZER, public_tokenizers.PATTERN)
    used = check_packing(got.collect(), texts)
    crc = sorted((r["doc_id"], r["piece"], r["start"], r["length"], zlib.crc32(bytes(r["ids"]))) for r in got.collect())
    query = queries.queries()["op12_best_fit_packing"](spark, d)
    assert query.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert sorted(tuple(r)[:5] for r in query.collect()) == crc and query.select("sequence_id").distinct().count() == used


def test_sequences_hold_their_pieces(docs):
    packed = packing.pack(docs, TOKENIZER, public_tokenizers.PATTERN, 64)
    want = collections.defaultdict(list)
    for r in packed.collect():
        want[r["sequence_id"]].append((r["offset"], bytes(r["ids"])))
    got = {r["sequence_id"]: (r["n_pieces"], bytes(r["ids"])) for r in packing.sequences(packed).collect()}
    assert got == {k: (len(v), b"".join(x for _, x in sorted(v))) for k, v in want.items()}


def test_packing_of_nothing(nothing):
    assert packing.pack(nothing, TOKENIZER, public_tokenizers.PATTERN).count() == 0


def test_plans_by_brute_force():
    """Each piece has one place, no sequence overflows, and no more are used than one at a time would need."""
    r = random.Random(4)
    for _ in range(60):
        capacity = r.choice([1, 2, 7, 30, 100])
        counts = {n: r.choice([1, 2, 3, 50]) for n in r.sample(range(1, capacity + 1), r.randint(1, min(capacity, 25)))}
        made, places = packing.plan(counts, capacity), collections.defaultdict(list)
        runs = sorted(made.runs)
        for n, count in counts.items():
            own = [x for x in runs if x[0] == n]
            for i in range(count):
                _, first, sequence, each, offset = own[bisect.bisect_right([x[1] for x in own], i) - 1]
                places[sequence + (i - first) // each].append((offset + (i - first) % each * n, n))
        for parts in places.values():
            parts.sort()
            assert all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and parts[0][0] == 0 and sum(parts[-1]) <= capacity
        assert sorted(places) == list(range(made.sequences))
        assert made.sequences <= best_fit([n for n, c in counts.items() for _ in range(c)], capacity)
        large = sum(c for n, c in counts.items() if 3 * n > capacity)
        assert sum(sum(3 * n > capacity for _, n in p) for p in places.values()) == large and all(sum(3 * n > capacity for _, n in p) <= 2 for p in places.values())


def test_encoder_is_the_library():
    tok, r = Tokenizer.from_file(TOKENIZER), random.Random(1)
    with open(TOKENIZER, encoding="utf-8") as f:
        encode = packing.Encoder(f.read(), public_tokenizers.PATTERN, remembered=50)
    letters = "abcXYZ  \n\t'sll019.,-_ßéÀʰ²½ªµ×÷—…€ \u0085 日ба́\x00\x1c😀ǅ٣"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(3000)] + ["ab 12\n" * 200_000, "<|endoftext|>", " ", "", "I'LL can't'VE"]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


# ---- resampling


def resampled(rows, target, longest=1, buckets=10_000, percent=10, least=20):
    """{(doc_id, n_features, weight, score): how many}, and the scores and doc_ids of those drawn in their order."""

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, longest + 1) for i in range(len(w) - k + 1)], len(w)

    own, goal = (collections.Counter(b for t in texts for b in features(t)[0]) for texts in ([r[1] for r in rows], target))
    s, t = sum(own.values()), sum(goal.values())
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + buckets) / ((own[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out, able = collections.Counter(), []
    for doc, text, *_ in rows:
        f, n = features(text)
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out[doc, len(f), weight, score] += 1
        if n >= least:
            able.append((-score, math.inf if doc is None else doc))
    return out, sorted(able)[: percent * len(able) // 100]


@pytest.mark.parametrize(("longest", "buckets", "percent", "nodes"), [(1, 10_000, 10, 400_000), (2, 50, 100, 5), (3, 1000, 35, 400_000)])
def test_resampling(spark, docs, rows, monkeypatch, longest, buckets, percent, nodes):
    texts = ["the ba ba zz", None, "", "été Öl Öl, 42!"]
    target = spark.createDataFrame([(t, "x") for t in texts], "text string, doc_id string")
    for f in (resampling.bucket_totals, resampling.scored):
        monkeypatch.setattr(f, "__defaults__", (*f.__defaults__[:-1], nodes))
    got = resampling.resample(docs, target, percent, longest=longest, buckets=buckets).collect()
    want, drawn = resampled(rows, texts, longest, buckets, percent)
    assert collections.Counter((r["doc_id"], r["n_features"], r["weight"], r["score"]) for r in got) == want
    ranked = sorted((r["rank"], -r["score"], math.inf if r["doc_id"] is None else r["doc_id"]) for r in got if r["rank"] is not None)
    assert [x[0] for x in ranked] == list(range(1, len(drawn) + 1)) and [x[1:] for x in ranked] == drawn


def test_resampling_of_one_document_many_times(spark):
    rows = [(5, "ba ri " * 20, "en", "a")] * 500 + [(i, "zz " * 30, "en", "a") for i in range(100)]
    got = resampling.resample(make(spark, rows), make(spark, []).limit(0), 60).collect()
    _, drawn = resampled(rows, [], percent=60)
    assert sorted((r["rank"], -r["score"], r["doc_id"]) for r in got if r["rank"]) == [(i + 1, *x) for i, x in enumerate(drawn)]


def test_resampling_of_nothing(spark, nothing, docs):
    assert resampling.resample(nothing, docs).count() == 0
    assert resampling.resample(docs.where("length(text) < 5"), docs).where("rank IS NOT NULL").count() == 0
    none = resampling.resample(docs, docs, percent=0)
    assert none.count() == docs.count() and none.where(F.col("rank").isNotNull()).count() == 0
