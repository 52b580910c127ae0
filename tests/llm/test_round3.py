"""Suffix levels, filter audit and importance resampling against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.llm import filter_audit, resampling, suffix_levels

SF = "/root/testdata/sf0.001"
#: ``id``, ``h1``, ``part``, ``mask`` and ``score`` are names that the operators use.
SCHEMA = "doc_id long, text string, lang string, id string, h1 int, part int, mask string, score int, spans int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (9 - len(r))) for r in rows], SCHEMA)


def brute_spans(texts, least):
    seen = Counter()
    data = [(t or "").encode() for t in texts]
    for d in data:
        seen.update(d[i : i + least] for i in range(len(d) - least + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - least + 1):
            if seen[d[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(d, np.uint8)[~gone])).hexdigest()))
    return out


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def check_removed(spark, texts, least, **options):
    got = suffix_levels.repeats_removed(frame(spark, enumerate(texts)), least, **options).collect()
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got}
    assert [got[i] for i in range(len(texts))] == brute_spans(texts, least)


def test_repeats_of_every_length(spark):
    rng = random.Random(5)
    base, shared = prose(rng, 400), prose(rng, 200)
    texts = [base, base[:700] + prose(rng, 50), prose(rng, 30) + base[300:1000], base, None, "", "short", shared + base[:399], base[:400]]
    texts += [prose(rng, rng.randint(1, 40)) + shared[rng.randint(0, 200) : rng.randint(350, 1000)] + prose(rng, rng.randint(1, 40)) for _ in range(30)]
    # near copies, periodic texts, a text that repeats itself, characters of several bytes
    for _ in range(10):
        words = base.split(" ")
        words[rng.randrange(len(words))] = "edit"
        texts.append(" ".join(words))
    texts += ["a" * 1500, "ab" * 600, "ba" * 450, "x" + "a" * 401, shared[:450] + "|" + shared[:450], ("é" + prose(rng, 90)) * 2, "日本語" * 200]
    check_removed(spark, texts, 400)
    check_removed(spark, texts, 50, batches=3)
    check_removed(spark, texts, 401, batches=1)


def test_repeats_over_parts_of_a_long_text(spark, monkeypatch):
    rng = random.Random(6)
    long = prose(rng, 12_000)
    texts = [long, prose(rng, 300) + long[20_000:23_000] + prose(rng, 10) + long[50_000:50_500], long[1000:1600]]
    for i, s, n, a in suffix_levels._many([t.encode() for t in texts], 400):
        assert 0 < n <= 369 and s + n + 399 <= len(texts[i]) and s <= a
    whole = list(suffix_levels._many([texts[0].encode()], 400))
    monkeypatch.setattr(suffix_levels, "READ", 5000)
    assert list(suffix_levels._many([texts[0].encode()], 400)) == whole
    check_removed(spark, texts, 400)


def test_repeats_of_the_given_texts(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    check_removed(spark, [t for _, t in rows], 400)


def test_levels_double_and_keep_every_head(spark):
    rng = random.Random(7)
    shared = prose(rng, 200)
    texts = frame(spark, [(i, prose(rng, 150) + (shared if i in (0, 6) else "")) for i in range(7)])
    table, buckets = suffix_levels.distinct_texts(texts, 400, 1)
    ids = [r["id"] for r in table.select("id").orderBy("id").collect()]
    family = suffix_levels.SuffixFamily(buckets)
    sizes = []
    for key in ids:
        family.add(table.filter(F.col("id") == F.lit(key)))
        sizes.append([n for n, _ in family.levels])
    assert sizes == [[1], [2], [2, 1], [4], [4, 1], [4, 2], [4, 2, 1]]
    want = defaultdict(int)
    for t in table.collect():
        for head in {t["text"][a : a + 32] for _, _, _, a in suffix_levels._many([bytes(t["text"])], 400)}:
            want[head] += 1
    assert sum(level.count() for _, level in family.levels) >= len(want)
    assert {bytes(r["head"]) for r in family.repeated_heads().collect()} == {bytes(h) for h, n in want.items() if n > 1}
    plan = family._merged(family.levels[0][1], family.levels[1][1])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_no_rows(spark):
    none, labels = frame(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert suffix_levels.repeats_removed(none).count() == 0
    assert filter_audit.audit(none, labels).count() == 0
    assert resampling.resample(none, none).count() == 0
    some = frame(spark, [(1, "one two " * 20)])
    assert [r["rank"] for r in resampling.resample(some, none, percent=100).collect()] == [1]


AWKWARD = [
    (1, "x " * 150, "en"), (2, "x " * 150, "de"), (2, "x " * 150, "de"), (3, None, None), (4, "", "en"), (None, "", "en"), (None, None, ""),
    (5, " ".join(f"word{i}" for i in range(120)), "en"), (6, " ".join(f"WORD{i}" for i in range(120)), "en"), (7, "a&b", "fr"),
    (8, " ".join(f"w{i}" for i in range(99)), "fr"), (9, " ".join(f"w{i}" for i in range(80)) + " w1" * 20, "fr"), (1, "x " * 150, "en"),
    (10, " ".join(f"É{i}|\x1c" for i in range(300)), "fr"), (11, " ".join(f"tail{i}" for i in range(60_000)), "en"),
]


def brute_audit(rows, labels):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    good, toxic = ({i for i, *x in labels if x[k] == 1 and i is not None} for k in (0, 1))
    docs = defaultdict(list)
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {x for x, f in zip("ABCDE", (
            len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            bool(re.search(r"[#$%&*|]", t)), i is not None and i > first[t]), strict=True) if f}
        docs[lang or ""].append((fails, i in good, i in toxic))
    out = {}
    for part, members in docs.items():
        shapley = Counter()
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                before = set(order[:k])
                here = [m for m in members if f in m[0] and not m[0] & before]
                shapley[f] += len(here)
                out[part, "".join(order), k + 1] = [
                    sum(not m[0] & (before | {f}) for m in members), len(here), sum(f in m[0] and bool(m[0] & before) for m in members),
                    sum(m[0] == {f} for m in members), sum(m[1] for m in here), sum(m[2] for m in here)]
        for key, row in out.items():
            if key[0] == part:
                row.append(shapley[key[1][key[2] - 1]])
    return out


@pytest.mark.parametrize("whole", [True, False])
def test_audit(spark, whole):
    if whole:
        docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    else:
        docs = frame(spark, AWKWARD)
        labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (2, 1, None), (5, None, None), (None, 1, 1), (77, 1, 1)], "doc_id long, quality int, toxic int")
    got = filter_audit.audit(docs, labels).collect()
    want = brute_audit([tuple(r) for r in docs.select("doc_id", "text", "lang").collect()], [tuple(r) for r in labels.select("doc_id", "quality", "toxic").collect()])
    assert len(got) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (*filter_audit.COUNTS, "shapley")] for r in got} == want
    # the shares of the filters add up to what all five remove, in every order
    for part in {k[0] for k in want}:
        size = want[part, "ABCDE", 1][0] + want[part, "ABCDE", 1][1]
        assert sum(want[part, "ABCDE", k][6] for k in range(1, 6)) == 120 * (size - want[part, "ABCDE", 5][0])


def brute_resample(rows, target, runs, percent, least=20):
    def features(t):
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)
        return [" ".join(words[i : i + n]) for n in range(1, runs + 1) for i in range(len(words) - n + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in features(x)) for texts in ([r[1] for r in rows], target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for i, text, *_ in rows:
        found = features(text)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    drawn = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(drawn[: len(drawn) * percent // 100]):
        r[4] = place + 1
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.mark.parametrize("runs, percent, piece", [(1, 10, 1 << 20), (1, 60, 50), (3, 50, 37), (2, 100, 1 << 20)])
def test_resample(spark, monkeypatch, runs, percent, piece):
    monkeypatch.setattr(resampling.pieces, "__defaults__", (piece,))
    rows = [*AWKWARD, *[(20 + i, "Target words 12 x" * (i % 4 * 9), "en") for i in range(40)], (50, "y" * 200 + " z" * 30, "en")]
    target = ["target words", None, "z z", "word5 word6"]
    docs, want = frame(spark, rows), brute_resample(rows, target, runs, percent)
    got = resampling.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), runs=runs, percent=percent).collect()
    assert order(map(list, got)) == order(want)


def test_offsets_over_many_windows(spark, monkeypatch):
    monkeypatch.setattr(resampling, "WINDOW_SCORES", 10)
    rng = random.Random(3)
    counts = {rng.randrange(-(10**9), 10**9) if i % 3 else i: rng.randint(1, 9) for i in range(900)}
    got = resampling.rank_offsets(spark.createDataFrame(list(counts.items()), "score long, n long")).collect()
    assert len(got) == len(counts)
    assert all(r["above"] == sum(n for s, n in counts.items() if s > r["score"]) for r in got)
