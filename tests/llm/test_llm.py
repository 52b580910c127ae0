"""The corpus operators on awkward rows, against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaspark.llm import anisotropic, chaining, content_sort, kd_shards, mixing, packing, page_text, partenum, shingles, token_cache, toxicity
from vistaspark.llm import recurrent as rnn
from vistaspark.llm.common import scratch_path
from vistaspark.llm.components import connected_components
from vistaspark.llm.queries import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, salt int, size string, copies long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
PROSE = " ".join(f"word{i}" for i in range(400))
ROWS = [
    (1, "a b  c", "en", "s0", 6, 1, "x", 1),
    (2, "ab\tc", "en", "s0", 4, 1, "x", 1),
    (3, "a b  c", None, None, None, None, None, None),
    (3, "a b  c", None, None, None, None, None, None),
    (4, None, "en", "s1", 0, 1, "x", 1),
    (5, "", "en", "s1", 0, 1, "x", 1),
    (6, " \n", "en", None, 2, 1, "x", 1),
    (None, "lone", "de", "s2", 4, 1, "x", 1),
    (7, PROSE, "en", "s2", 1, 1, "x", 1),
    (8, PROSE.replace("word200", "other"), "en", "s2", 1, 1, "x", 1),
    (9, PROSE + " " + " ".join(f"tail{i}" for i in range(9000)), "en", "", 1, 1, "x", 1),
    (10, "é <|endoftext|> Ünï  code  x\x1cy", "fr", "s0", 1, 1, "x", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def test_empty_tables(spark, none):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert kd_shards.kd_shards(none, 24).count() == 0
    assert content_sort.content_sort(none).count() == 0 and content_sort.one_of_each(none).count() == 0
    assert mixing.mix_plan(none).count() == 0 and mixing.mix(none).count() == 0
    assert partenum.jaccard_components(none).count() == 0
    assert chaining.repeated_passages(none).count() == 0
    assert toxicity.toxicity(none, labels).count() == 0
    assert packing.pack(none, tokenizer_path("byte_bpe_50k.json")).count() == 0
    assert token_cache.cached_counts(none, tokenizer_path("word_bpe_49k.json"), scratch_path(spark, "t")).count() == 0
    assert page_text.page_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert anisotropic.nearest_neighbours(vectors, vectors).count() == 0


def test_shards(docs):
    got = kd_shards.kd_shards(docs, 4).collect()
    assert len(got) == len(ROWS)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    want = sorted(((r[0] or -1), len((r[1] or "").encode()) + 8, zlib.crc32((r[1] or "").encode())) for r in ROWS)
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want


def test_shards_are_near_equal(corpus):
    sums = [r["b"] for r in kd_shards.kd_shards(corpus, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    largest = corpus.agg(F.max(F.octet_length("text"))).first()[0]
    assert len(sums) == 8 and max(sums) - min(sums) <= 3 * largest


def test_content_sort(docs):
    got = content_sort.content_sort(docs).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[re.sub(r"[\x20\x09-\x0D]", "", r[1] or "")].append(r)
    assert len(got) == len(ROWS) and sum(r["kept"] for r in got) == len(groups)
    for r in got:
        norm = next(n for n in groups if hashlib.sha256(n.encode()).hexdigest() == r["text_sha256"])
        best = min(groups[norm], key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))
        assert (r["keep_id"], r["group_size"]) == (best[0], len(groups[norm]))
    kept = content_sort.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def test_hot_group_is_split_and_merged(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("same text")).otherwise(F.col("id").cast("string")).alias("text"))
    got = content_sort.content_sort(rows).filter("group_size > 1").agg(F.count("*"), F.max("keep_id"), F.max("group_size"), F.sum(F.col("kept").cast("int"))).first()
    assert tuple(got) == (1000, 0, 1000, 1)


def test_mix(docs):
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORDS.findall(r[1] or ""))
    left, targets, total = dict(zip(sorted((s for s in sizes if s is not None), key=str) + [None], [5, 2, 1, 5, 2], strict=False)), {}, sum(sizes.values())
    while True:
        level = (total - sum(targets.values())) / sum(left.values())
        over = [s for s in left if level * left[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            targets[s] = 3 * sizes[s]
            del left[s]
    targets |= {s: level * w for s, w in left.items()}
    by_id = {r[0]: r[3] for r in ROWS}
    for r in got:
        assert r["target"] == pytest.approx(targets[by_id[r["doc_id"]]]) and r["taken"] <= 3 * r["size"]
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    assert mixed.agg(F.sum(mixing.word_count())).first()[0] == sum(r["taken"] for r in got)


def shingle_set(text, k):
    words = WORDS.findall(text.translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()


def components(rows, k, num, den):
    sets, root = [(i, shingle_set(t or "", k)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and len(a & b) * den >= num * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize(("k", "num", "den"), [(3, 90, 100), (5, 8, 10)])
def test_jaccard_join(corpus, docs, k, num, den):
    for df in (corpus, docs.filter("doc_id IS NOT NULL")):
        want = components({r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}.items(), k, num, den)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(df, k, num, den).collect()}
        assert got == want


def test_signatures_lose_no_pair():
    rng = np.random.default_rng(0)
    for size in (1, 5, 9, 10, 40, 300, 2000):
        a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64))
        for gone in range(int(size * 0.1 / 1.9) + 1):
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
            if len(np.intersect1d(a, b)) * 10 >= 9 * len(np.union1d(a, b)):
                assert len(np.intersect1d(partenum.signatures(a, 9, 10), partenum.signatures(b, 9, 10)))


def test_parities_of_unlike_length_lose_no_pair(spark):
    words = [f"w{i}" for i in range(600)]
    texts = {1: words[:510], 2: words[:530], 3: words[60:], 4: [f"v{i}" for i in range(520)]}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in partenum.jaccard_components(df).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_words_hash_alike_wherever_they_stand():
    as_bytes = lambda s: np.frombuffer(s.encode(), np.uint8)
    assert shingles.word_hashes(as_bytes("x Ab é"))[1] == shingles.word_hashes(as_bytes("\n aB"))[0]
    old, shingles.PIECE = shingles.PIECE, 16
    try:
        assert (shingles.word_hashes(as_bytes("one two three four fivesixseveneightnineten x y")) == np.concatenate([shingles.word_hashes(as_bytes(w)) for w in "one two three four fivesixseveneightnineten x y".split()])).all()
    finally:
        shingles.PIECE = old


def test_components_of_a_long_path(spark):
    path = spark.range(60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in connected_components(path).collect()} == {0}


def test_page_text(spark):
    frame = lambda body: f"<div>Site frame line</div>{body}<p>About us &amp; more</p>"
    rows = [
        (1, "http://h/a/1", '<head><title>t</title></head><nav>m</nav><article><h1>T</h1><p>A&nbsp;b\n c<br>d<aside>s</aside><div class="comments">no</div></article><footer>f</footer>'),
        (2, "http://h/b/1", frame("<p>first page text</p>")), (3, "http://h/b/2", frame("<p>second page words</p>")),
        (4, None, None), (5, "x", ""), (6, "http://h/c", '<script>"<p>no</p>"</script><p>yes<form><input>no</form>'),
    ]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in page_text.page_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {k: v[0] for k, v in got.items()} == {1: "T\n\nA b c d", 2: "first page text", 3: "second page words", 4: "", 5: "", 6: "yes"}
    assert all(n == len(t) for t, n in got.values())


def test_common_lines():
    assert len(page_text.common_lines(list("abcbdab"), list("bdcaba"))) == 4


def test_repeated_passages(docs, corpus):
    got = chaining.repeated_passages(docs).collect()
    assert {(r["doc_id"], r["other_id"]) for r in got} >= {(7, 8), (8, 7), (7, 9), (9, 7)}
    assert {r["doc_id"] for r in got} == {7, 8, 9}
    texts = {r["doc_id"]: WORDS.findall(r["text"].lower()) for r in corpus.collect()}
    where = defaultdict(set)
    for i, w in texts.items():
        for j in range(len(w) - 49):
            where[tuple(w[j : j + 50])].add(i)
    must = set().union(*[x for x in where.values() if len(x) > 1])
    assert must <= {r["doc_id"] for r in chaining.repeated_passages(corpus).collect()}


@pytest.mark.parametrize(("shared", "gap"), [(60, 50), (60, 100), (60, 200), (200, 200)])
def test_two_passages_of_a_pair(spark, shared, gap):
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(i, " ".join([run("x", shared), run(f"own{i}w", gap), run("y", shared)])) for i in (1, 2)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = [(0, shared), (shared + gap, 2 * shared + gap)]
    assert {(r["doc_id"], r["start_word"], r["end_word"], r["other_id"], r["other_start"], r["other_end"]) for r in got} == {(a, *s, b, *s) for a, b in ((1, 2), (2, 1)) for s in spans}
    assert all(r["matched_words"] == shared and r["identity"] == 1 for r in got)


def test_common_words_and_parts_against_brute_force(monkeypatch):
    rng = np.random.default_rng(3)
    for cells in (1_000_000, 6):
        monkeypatch.setattr(chaining, "CELLS", cells)
        for n, m in rng.integers(0, 30, (60, 2)):
            a, b = rng.integers(0, 6, n), rng.integers(0, 6, m)
            i, j = chaining.common(a, b)
            assert (a[i] == b[j]).all() and (np.diff(i) > 0).all() and (np.diff(j) > 0).all()
            assert len(i) == chaining._last_row(a, b)[-1]
    for _ in range(200):
        i, j = (np.cumsum(rng.choice([1, 1, 1, 1, 1, 1, 2, 9], 40)) for _ in range(2))
        good = {(p, q) for p in range(40) for q in range(p, 40) if min(i[q] - i[p], j[q] - j[p]) >= 11 and q + 1 - p >= 0.8 * (max(i[q] - i[p], j[q] - j[p]) + 1)}
        found = chaining.passages(i, j, 12, 0.8)
        assert all(min(b - a, d - c) >= 12 and n >= 0.8 * max(b - a, d - c) for a, b, c, d, n in found)
        assert bool(found) == bool(good)


def test_hot_seeds_are_dealt_to_blocks(spark, monkeypatch):
    passage = " ".join(f"shared{i}" for i in range(80))
    rows = spark.createDataFrame([(i, f"own{i} {passage} end{i}") for i in range(40)], "doc_id long, text string")
    for name, value in (("TRIED", 1), ("HOT_LEAST", 2), ("SEED_BLOCK", 5)):
        monkeypatch.setattr(chaining, name, value)
    assert {r["blocks"] for r in chaining._hot_seeds(rows).collect()} == {8}
    links = [(r["doc_id"], r["other_id"]) for r in chaining.repeated_passages(rows).collect()]
    reached = {0}
    for _ in rows.columns * 40:
        reached |= {b for a, b in links if a in reached}
    assert reached == set(range(40))


def test_partners_do_not_hang_on_the_dealing(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        words = [f"edit{i}w{k}" if rng.random() < 0.03 else f"shared{k}" for k in range(120)]
        rows.append((i, f"own{i} " + " ".join(words)))
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    whole = set(chaining.repeated_passages(rows).collect())
    for name, value in (("TRIED", 1), ("HOT_LEAST", 2), ("SEED_BLOCK", 9)):
        monkeypatch.setattr(chaining, name, value)
    assert len({r["blocks"] for r in chaining._hot_seeds(rows).collect()}) > 1
    assert whole and set(chaining.repeated_passages(rows).collect()) == whole


def test_chains_skip_what_does_not_rise():
    a, b = np.arange(0, 50, 5), np.arange(100, 150, 5)
    found = chaining.chains(np.append(a, 22), np.append(b, 3))
    assert len(found) == 1 and sorted(found[0]) == list(range(10))


def test_token_counts(spark, docs, corpus):
    from tokenizers import Tokenizer

    path, cache = tokenizer_path("word_bpe_49k.json"), scratch_path(spark, "cache")
    tok = Tokenizer.from_file(path)
    for df in (docs, corpus, corpus):
        want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(tok.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.select("doc_id", "text").collect())
        got = token_cache.cached_counts(df, path, cache).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count()  # the third run only hit


def test_packing(docs, corpus):
    from tokenizers import Tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    for df in (docs, corpus):
        packed = packing.pack(df, path, keep_ids=True)
        got = packed.collect()
        ids = Counter((r["doc_id"], tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [0])) for r in df.select("doc_id", "text").collect())
        assert sum(r["length"] for r in got) == sum(len(x) * n for (_, x), n in ids.items())
        pieces = {(r["doc_id"], r["start"], r["ids_crc32"]) for r in got}
        for doc_id, x in ids:
            first = len(x) - (-(-len(x) // 2048) - 1) * 2048
            for start, end in zip([0, *range(first, len(x), 2048)], range(first, len(x) + 1, 2048), strict=True):
                assert (doc_id, start, zlib.crc32(np.array(x[start:end], "<u4").tobytes())) in pieces
        at = defaultdict(list)
        for r in got:
            at[r["sequence_id"]].append((r["offset"], r["length"]))
        for x in at.values():
            x.sort()
            assert x[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(x, x[1:], strict=False)) and sum(x[-1]) <= 2048
        assert len(at) <= -(-sum(r["length"] for r in got) // 2048) + 1
        assert packing.sequences(packed).count() == len(at)


def test_histogram_is_used_up():
    rng = np.random.default_rng(1)
    counts = np.zeros(101, np.int64)
    np.add.at(counts, rng.integers(1, 101, 5000), 1)
    used = np.zeros(101, np.int64)
    for pattern, times in packing.pack_histogram(counts, 100):
        assert sum(k * n for k, n in pattern.items()) <= 100
        for k, n in pattern.items():
            used[k] += n * times
    assert (used == counts).all()


def test_network_gradients():
    rng = np.random.default_rng(0)
    net = {k: v.astype(np.float64) for k, v in rnn.new_network(5, 5).items()}
    mask = np.ones((6, 3), bool)
    mask[4:, 1] = False
    gates = [rng.normal(size=(6, 3, 3 * rnn.HIDDEN)) for _ in range(2)]
    d = rng.normal(size=3)
    run = lambda: rnn.forward(net, *gates, mask)[0] @ d
    grad, gf, gb = rnn.backward(net, d, mask, rnn.forward(net, *gates, mask, keep=True)[1])
    for values, slopes in [(net[k], grad[k]) for k in ("Uf", "Ub", "A", "v", "w")] + list(zip(gates, (gf, gb), strict=True)):
        i = tuple(int(rng.integers(0, n)) for n in values.shape)
        values[i] += 1e-4
        up = run()
        values[i] -= 2e-4
        down = run()
        values[i] += 1e-4
        assert (up - down) / 2e-4 == pytest.approx(slopes[i], rel=0.05, abs=1e-4)


def test_long_runs_are_read_to_their_end():
    rng = np.random.default_rng(2)
    run = lambda n: "".join(rng.choice(list("bcdfgmnpst"), n))
    long = run(1000)
    pieces = [x.decode() for x in rnn.chunks_of(f"a {long} b".encode())]
    assert pieces[0] == "a" and pieces[-1] == "b" and all(len(x.strip()) <= rnn.LONGEST for x in pieces)
    assert all(any(long[i : i + rnn.SHARED] in x for x in pieces) for i in range(1000 - rnn.SHARED + 1))
    assert not [x for x in pieces[2:-1] if any(r[0] == "<" for r in rnn.letter_runs(x))]
    assert rnn.chunks_of("é".encode() * 64) == ["é".encode() * 64]
    words = [run(5) for _ in range(200)]
    sample = [(" ".join([*rng.choice(words, 20), *["hateful"] * (k % 2)]).encode(), k % 2) for k in range(300)]
    clean, toxic = toxicity.scorer(toxicity.train(sample))(toxicity.pa.array([run(300), run(300) + "hateful"]))
    assert clean < 0.5 < toxic


def test_toxicity_scores_every_row(docs, spark):
    labels = spark.createDataFrame([(i, int(i % 2)) for i in range(1, 11)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got if r["doc_id"]} == {r[0]: zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in ROWS if r[0]}


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(size=(600, 7)))] + [(600 + i, [1.0] * 7) for i in range(20)]
    rows += [(700, None), (701, [0.0] * 7), (702, [float("nan")] * 7), (703, [1.0, None] + [1.0] * 5), (704, [float("inf")] * 7), (None, [1.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = anisotropic.nearest_neighbours(df, df.filter("vec_id % 50 = 0")).collect()
    x = np.array([r[1] for r in rows[:620]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 620, 50):
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(620), -np.round(score, 12)))[:5]
        mine = sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q)
        assert [r for r, _ in mine] == [1, 2, 3, 4, 5]
        hits += len({v for _, v in mine} & set(want.tolist()))
    assert hits >= 0.9 * 13 * 5
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 600] == [601, 602, 603, 604, 605]


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    docs = corpus_pipeline.documents(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 1").collect()}
    rows = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in toxic}
    best = {}
    for i, t in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        best.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), i)
    rows = {i: rows[i] for i in best.values()}
    kept = {i for i, (_, c) in components(rows.items(), 5, 8, 10).items() if i == c}
    mixed = mixing.mix_plan(docs.filter(F.col("doc_id").isin(sorted(kept)))).filter("size > 0").collect()
    want = {r["doc_id"]: r["taken"] // r["size"] for r in mixed if r["taken"]}
    got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, SF).filter("piece = 0").collect())
    assert got == want


def plain_differencing(pages):
    """Page differencing as a plain loop over each host's pages in the order of paths."""
    from urllib.parse import urlsplit

    read = {i: page_text.lines_of(h or "") for i, _, h in pages}
    keys = sorted(((urlsplit(u or "").netloc.lower(), urlsplit(u or "").path, i) for i, u, _ in pages))
    out = {}
    for n, (host, _, i) in enumerate(keys):
        lines, kinds = read[i]
        gone = set()
        for m in (n - 1, n + 1):
            if 0 <= m < len(keys) and keys[m][0] == host:
                other = read[keys[m][2]][0]
                table = [[0] * (len(other) + 1) for _ in range(len(lines) + 1)]
                for a in range(len(lines) - 1, -1, -1):
                    for b in range(len(other) - 1, -1, -1):
                        table[a][b] = table[a + 1][b + 1] + 1 if lines[a] == other[b] else max(table[a + 1][b], table[a][b + 1])
                a = b = 0
                shared = set()
                while a < len(lines) and b < len(other):
                    if lines[a] == other[b]:
                        shared.add(a)
                        a, b = a + 1, b + 1
                    elif table[a + 1][b] >= table[a][b + 1]:
                        a += 1
                    else:
                        b += 1
                if 10 * sum(len(lines[x]) for x in shared) <= 9 * sum(map(len, lines)):
                    gone |= shared
        out[i] = "\n\n".join(x for k, x in enumerate(lines) if kinds[k] == page_text.ARTICLE or kinds[k] == page_text.OPEN and k not in gone)
    return out


def test_page_differencing_against_a_plain_loop(spark):
    rng = np.random.default_rng(4)
    pages = []
    for i in range(120):
        host, article = f"h{i % 5}", i % 4 == 0
        frame = [f"<div>frame {host} {k}</div>" for k in range(4)]
        body = [f"<p>text {i} {k} {rng.integers(1000)}</p>" for k in range(int(rng.integers(1, 6)))] + (["<p>shared licence</p>"] if i % 3 else [])
        inner = "".join(body)
        pages.append((i, f"http://{host}/{int(rng.integers(40)):03d}/{i:03d}?q={i}", "".join(frame[:2]) + (f"<article>{inner}</article>" if article else inner) + "".join(frame[2:])))
    pages += [(200, "http://h0/000/copy", pages[0][2]), (201, None, "<p>no address</p>"), (202, "http://h1/long", "<p>" + "long text " * 50_000 + "</p>")]
    got = page_text.page_text(spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id long, url string, html string, row int, lines string")).collect()
    assert {r["page_id"]: r["text"] for r in got} == plain_differencing(pages)
    assert sum(r["n_shared"] for r in got) > 400 and all(r["n_chars"] == len(r["text"]) for r in got)
    assert any("shared licence" in r["text"] for r in got if r["page_id"] % 4 == 0 and r["page_id"] % 3)


@pytest.mark.parametrize("part", ["<a ", '<a "', "<script ", "<", "<!--", '<p class="', "</", "<nav>", "<b class='x"])
def test_long_broken_pages_are_read_in_one_scan(part):
    import time

    start = time.monotonic()
    page_text.lines_of("<p>a" + part * (1_000_000 // len(part)) + "</p>")
    assert time.monotonic() - start < 20


def test_heading_of_an_article_stays():
    page = '<div class="site-header">S</div><article><div class="entry-header"><h1>Title</h1></div><p>Body</p><div class="share">no</div></article>'
    lines, kinds = page_text.lines_of(page)
    assert [x for x, k in zip(lines, kinds, strict=True) if k == page_text.ARTICLE] == ["Title", "Body"]


def test_neighbours_of_tiny_and_huge_vectors(spark):
    rng = np.random.default_rng(8)
    plain = rng.normal(size=(60, 6))
    rows = [(i, (v * (1e-200 if i % 3 == 1 else 1e200 if i % 3 == 2 else 1.0)).tolist(), i, "x") for i, v in enumerate(plain)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank long, list string")
    got = anisotropic.nearest_neighbours(df, df.filter("vec_id % 50 = 0"), probes=1, lists=12).collect()
    x = plain / np.linalg.norm(plain, axis=1, keepdims=True)
    for q in (0, 50):
        mine = {r["vec_id"]: r["score"] for r in got if r["query_id"] == q}
        assert len(mine) == 5 and all(s == pytest.approx(x[v] @ x[q]) for v, s in mine.items())


def test_neighbours_when_there_are_few(spark):
    rows = [(i, [1.0, float(i)]) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = anisotropic.nearest_neighbours(df, df).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in range(3) for k in (1, 2)]


def plain_kd_tree(rows, leaves):
    """Shards of metadata rows by recursive splits at the weighted quantile of the widest dimension."""
    dims = np.array([r["dims"] for r in rows])
    size, tie = np.array([r["size"] for r in rows]), np.array([r["tie"] for r in rows])
    spread, top, shard = np.maximum(np.ptp(dims, axis=0), 1e-300), (1 << kd_shards.VALUE_BITS) - 1, np.zeros(len(rows), int)

    def split(here, first, n):
        if n == 1 or not len(here):
            return
        wide = np.ptp(dims[here], axis=0) / spread
        d = int(np.argmax(wide))
        low, width = dims[here, d].min(), np.ptp(dims[here, d]) or 1.0
        key = np.floor((dims[here, d] - low) / width * top).astype(np.int64)
        order = here[np.lexsort((tie[here], key))]
        total = np.cumsum(size[order])
        goal = size[here].sum() * (n // 2) / n
        at = min(int(np.searchsorted(total, goal)), len(order) - 1)
        before = total[at] - size[order[at]]
        cut = at + 1 if total[at] - goal < goal - before else at
        shard[order[cut:]] = first + n // 2
        split(order[:cut], first, n // 2)
        split(order[cut:], first + n // 2, n - n // 2)

    split(np.arange(len(rows)), 0, leaves)
    return shard


def test_shards_against_a_plain_tree(corpus):
    from vistaspark.llm.common import materialise

    meta = materialise(kd_shards.metadata(corpus), "t")
    rows = meta.collect()
    want = Counter(zip([r["doc_id"] for r in rows], plain_kd_tree(rows, 7).tolist(), strict=True))
    assert Counter((r["doc_id"], r["shard"]) for r in kd_shards.kd_split(meta, 7).collect()) == want


def test_toxicity_has_skill_on_texts_it_has_not_seen():
    rng = np.random.default_rng(11)
    words = ["".join(rng.choice(list("abcdefghij"), int(rng.integers(3, 9)))) for _ in range(2000)]
    stems = ["zorvak", "mungrel", "quivit", "drubbel"]

    def text(label):
        out = list(rng.choice(words, int(rng.integers(20, 300))))
        for _ in range(3 if label else 0):
            out.insert(int(rng.integers(len(out))), str(rng.choice(stems)) + str(rng.choice(["", "s", "ing", "ed"])))
        return " ".join(out).encode()

    labels = [int(k % 4 == 0) for k in range(800)]
    sample = [(text(y), y) for y in labels]
    score = toxicity.scorer(toxicity.train(sample[:600]))(toxicity.pa.array([t.decode() for t, _ in sample[600:]]))
    truth = np.array(labels[600:])
    over = (score[truth == 1][:, None] > score[truth == 0]).mean()
    assert over > 0.97 and ((score >= 0.5) == truth).mean() > 0.85


@pytest.mark.parametrize("which", ["docs", "none"])
def test_stages_on_awkward_tables(spark, request, tmp_path, which):
    import corpus_pipeline

    df = request.getfixturevalue(which)
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2)) for i in range(1, 11)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = corpus_pipeline.documents(spark, str(tmp_path))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= 3 * docs.count()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed.columns)
    assert packed.count() == 0 if which == "none" else packed.count() > 0


def test_rows_that_share_an_id_keep_their_own_passages(spark):
    run = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    rows = [(1, run("a", 80), 1), (1, run("b", 80), 2), (2, "x " + run("a", 80), 3), (3, "y " + run("b", 80), 4)]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string, words int")).collect()
    assert {(r["doc_id"], r["other_id"], r["start_word"], r["matched_words"]) for r in got} == {(1, 2, 0, 80), (2, 1, 1, 80), (1, 3, 0, 80), (3, 1, 1, 80)}


def edited(rng, words, identity):
    return [w if rng.random() < identity else f"edit{rng.integers(1 << 40)}" for w in words]


def test_recall_of_fuzzy_passages(spark):
    rng = np.random.default_rng(12)
    rows, pairs = [], {}
    for identity in (1.0, 0.95, 0.9):
        for _ in range(40):
            i = len(rows)
            passage = [f"w{rng.integers(1 << 40)}" for _ in range(100)]
            for k in (0, 1):
                own = [f"own{rng.integers(1 << 40)}" for _ in range(30)]
                rows.append((i + k, " ".join(own + (edited(rng, passage, identity) if k else passage) + own[::-1])))
            pairs[i] = identity
    got = {r["doc_id"] for r in chaining.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = {t: np.mean([i in got for i, x in pairs.items() if x == t]) for t in (1.0, 0.95, 0.9)}
    assert found[1.0] == 1 and found[0.95] >= 0.95 and found[0.9] >= 0.6


def test_clusters_of_many_blocks_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(14)
    rows, base = [], [f"w{k}" for k in range(120)]
    for i in range(150):
        words = list(base)
        for _ in range(int(rng.integers(0, 7))):
            words[int(rng.integers(120))] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(words + [f"own{i}"] * int(rng.integers(0, 2)))))
    want = components(rows, 5, 8, 10)
    assert 2 < len({c for _, c in want.values()}) < 140
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for name, value in (("BLOCK_CLASSES", 9), ("PIVOTS", 3)):
        monkeypatch.setattr(partenum, name, value)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.jaccard_components(df).collect()}
    assert got == want


def test_links_grow_with_the_documents_not_their_pairs(spark, monkeypatch):
    counts = []
    merged = partenum._merged
    for copies in (1, 5):
        rng = np.random.default_rng(15)
        rows = []
        for g in range(20 * copies):
            base = [f"g{g}w{k}" for k in range(60)]
            for i in range(6):
                words = list(base)
                words[int(rng.integers(60))] = f"e{rng.integers(1 << 30)}"
                rows.append((len(rows), " ".join(["a common line that all of them share"] + words)))
        seen = []
        monkeypatch.setattr(partenum, "_merged", lambda df, num, den, seen=seen: seen.append(df.count()) or merged(df, num, den))
        partenum.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).count()
        counts.append(sum(seen))
    assert counts[0] > 0 and counts[1] <= 5.5 * counts[0]
