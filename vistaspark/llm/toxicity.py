"""Toxicity of whole texts: the recurrent network over all overlapping windows.

A window has ``LENGTH`` words and starts ``STRIDE`` words after the one before. The network is
trained on the driver from a bounded sample of labelled documents; a document's label says
only that some window is toxic, so after a first pass the windows of toxic documents that
score low count as clean. A document's score is a logistic function, fitted on the sample,
of its highest window's logit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vistaspark.llm import recurrent as rnn
from vistaspark.llm.common import text_of, tidy
from vistaspark.llm.shingles import texts_of

LENGTH, STRIDE = 24, 12
#: Bounds of the training sample: documents of each label, their bytes, windows of each.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, SAMPLE_WINDOWS = {0: 3000, 1: 1000}, 40_000, 40
#: Windows of clean documents in a pass of the training: random ones, and the highest so far.
RANDOM_CLEAN, HARD_CLEAN = 10_000, 8_000
#: Windows scored at a time, in tasks and in the training.
BATCH, SCORED = 768, 256
EMPTY = {"net": None, "inputs": None, "scale": (1.0, -5.0)}


def held_out(id_col: str = "doc_id"):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def windows_of(n: int) -> np.ndarray:
    """Starts of the windows over ``n`` words; the last one reaches the end."""
    return np.arange(max(1, -(-(n - (LENGTH - STRIDE)) // STRIDE))) * STRIDE


def _sample(documents: DataFrame, labels: DataFrame) -> list[tuple[bytes, int]]:
    """At most ``SAMPLE_DOCUMENTS`` texts of each label and of at most ``SAMPLE_BYTES``, chosen by a hash of the id."""
    learnable = labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = None
    for label, most in SAMPLE_DOCUMENTS.items():
        part = learnable.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        chosen = part if chosen is None else chosen.union(part)
    short = documents.filter((F.octet_length(text_of()) <= SAMPLE_BYTES) & (F.octet_length(text_of()) > 0)).select("doc_id", "text")
    rows = short.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sum(SAMPLE_DOCUMENTS.values()))
    return [(r["text"].encode(), r["toxic"]) for r in rows.select("text", "toxic").collect()]


def train(sample: list[tuple[bytes, int]], seed: int = 7) -> dict:
    """The network, its vocabulary and the scale of its logits, from (text, label) rows."""
    if len({y for _, y in sample}) < 2:
        return EMPTY
    rng = np.random.default_rng(seed)
    # each distinct word is held once, the documents as numbers: the driver has little memory
    distinct: dict[str, int] = {}
    number = lambda chunk: distinct.setdefault(rnn.token(chunk.decode("utf-8", "replace")), len(distinct))
    tokens = [np.fromiter(map(number, rnn.chunks_of(text)), np.int32) for text, _ in sample]
    names = list(distinct)
    inputs = rnn.Inputs(({names[i] for i in np.unique(words)} for words in tokens), np.array([y for _, y in sample]))
    word_rows, grams = map(list, zip(*[inputs.rows(w) for w in distinct], (rnn.UNKNOWN, [0]), strict=True))
    word_rows = np.array(word_rows)
    most = max(map(len, grams))
    gram_rows = np.array([g + [0] * (most - len(g)) for g in grams], np.int32)
    gram_share = np.array([[len(g) ** -0.5] * len(g) + [0.0] * (most - len(g)) for g in grams], np.float32)
    pad = len(distinct)
    ids, owner = [], []
    for k, words in enumerate(tokens):
        row = words if len(words) else np.array([pad], np.int32)
        starts = windows_of(len(row))
        if len(starts) > SAMPLE_WINDOWS:
            starts = np.sort(rng.choice(starts, SAMPLE_WINDOWS, replace=False))
        at = starts[:, None] + np.arange(LENGTH)
        ids.append(np.where(at < len(row), row[np.minimum(at, len(row) - 1)], pad))
        owner += [k] * len(starts)
    ids, owner = np.concatenate(ids), np.array(owner)
    label = np.array([y for _, y in sample], np.float32)
    net = rnn.new_network(len(inputs.words), len(inputs.runs), seed)
    adam = rnn.Adam(net)

    def gates(batch: np.ndarray, drop: float):
        rows = word_rows[batch]
        if drop:
            rows = np.where(rng.random(rows.shape) < drop, rnn.UNKNOWN, rows)
        grams, share = gram_rows[batch], gram_share[batch]
        chars = np.einsum("tbgc,tbg->tbc", net["C"][grams], share)
        x = np.concatenate([net["E"][rows], chars], axis=2)
        return rows, grams, share, x, x @ net["Wf"] + net["bf"], x @ net["Wb"] + net["bb"]

    def logits() -> np.ndarray:
        out = []
        for k in range(0, len(ids), SCORED):
            batch = ids[k : k + SCORED].T
            *_, gf, gb = gates(batch, 0.0)
            out.append(rnn.forward(net, gf, gb, batch != pad)[0])
        return np.concatenate(out)

    toxic = label[owner] > 0
    positive, score = toxic.copy(), np.zeros(len(owner))
    passes, size = (4, 256) if toxic.sum() > 12_000 else (8, 96)  # few windows want more and smaller steps
    for turn in range(passes):
        adam.rate = 0.01 if turn < passes - 1 else 0.003
        clean = np.flatnonzero(~toxic)
        hard = clean[np.argsort(-score[clean], kind="stable")[: min(HARD_CLEAN, 2 * int(toxic.sum()))]] if turn else clean[:0]
        some = rng.choice(clean, min(RANDOM_CLEAN, len(clean)), replace=False)
        high = np.flatnonzero(positive)
        if turn == 0:  # of toxic documents, as many windows as of clean ones are enough to begin with
            high = rng.choice(high, min(RANDOM_CLEAN, len(high)), replace=False)
        order = rng.permutation(np.concatenate([high, some, hard]))
        target = positive.astype(np.float32)
        for k in range(0, len(order), size):
            pick = order[k : k + size]
            batch = ids[pick].T
            mask = batch != pad
            rows, grams, share, x, gf, gb = gates(batch, 0.1)
            logit, saved = rnn.forward(net, gf, gb, mask, keep=True)
            y = target[pick]
            weight = np.where(y > 0, 0.5 / max(y.mean(), 0.05), 0.5 / max(1 - y.mean(), 0.05)) / len(y)
            d = ((rnn.sigmoid(logit) - y) * weight).astype(np.float32)
            grad, df, db = rnn.backward(net, d, mask, saved)
            flat = x.reshape(-1, x.shape[2])
            for name, g in (("f", df), ("b", db)):
                grad[f"W{name}"], grad[f"b{name}"] = flat.T @ g.reshape(-1, g.shape[2]), g.sum((0, 1))
            dx = df @ net["Wf"].T + db @ net["Wb"].T
            grad["E"], grad["C"] = np.zeros_like(net["E"]), np.zeros_like(net["C"])
            np.add.at(grad["E"], rows.ravel(), dx[:, :, : rnn.WORDS].reshape(-1, rnn.WORDS))
            np.add.at(grad["C"], grams.ravel(), (share[..., None] * dx[:, :, None, rnn.WORDS :]).reshape(-1, rnn.LETTERS))
            adam.step(net, grad)
        score = logits()
        top = np.full(len(sample), -np.inf)
        np.maximum.at(top, owner, score)
        # in a toxic document only the high windows are toxic, its highest at least; the others are left out
        positive = toxic & ((score > np.quantile(score[~toxic], 0.995)) | (score == top[owner]))
    a, b = 1.0, 0.0
    for _ in range(200):  # logistic regression of the label on the highest logit
        error = rnn.sigmoid(a * top + b) - label
        spread = rnn.sigmoid(a * top + b)
        h = spread * (1 - spread) + 1e-3
        m = np.array([[(h * top * top).sum() + 1e-2, (h * top).sum()], [(h * top).sum(), h.sum()]])
        da, db_ = np.linalg.solve(m, [(error * top).sum() + 1e-2 * a, error.sum()])
        a, b = a - 0.5 * da, b - 0.5 * db_
    return {"net": net, "inputs": inputs, "scale": (float(max(a, 1e-3)), float(b))}


def scorer(model: dict):
    """A function from an Arrow array of texts to their scores; it keeps the words it has met."""
    table = rnn.Table(model["net"], model["inputs"]) if model["net"] is not None else None
    a, b = model["scale"]

    def score(texts: pa.Array) -> np.ndarray:
        top = np.full(len(texts), -30.0)
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if held:
                owner = np.concatenate([np.full(len(at), k) for k, _, at in held])
                rows = np.concatenate([np.where(at < len(r), r[np.minimum(at, len(r) - 1)], 0) for _, r, at in held]).T
                gates = table.gates[rows]
                logit, _ = rnn.forward(model["net"], gates[:, :, : 3 * rnn.HIDDEN], gates[:, :, 3 * rnn.HIDDEN :], rows > 0)
                np.maximum.at(top, owner, logit)
            held.clear()
            waiting = 0

        for k, data in enumerate(texts_of(texts)) if table else ():
            chunks = rnn.chunks_of(data.tobytes())
            if len(table.rows) > table.KEPT:
                flush()
                table.clear()
            rows = table.ids(chunks) if chunks else np.zeros(1, np.int64)
            starts = windows_of(len(rows))
            for first in range(0, len(starts), BATCH):
                at = starts[first : first + BATCH, None] + np.arange(LENGTH)
                held.append((k, rows, at))
                waiting += len(at)
                if waiting >= BATCH:
                    flush()
        if table:
            flush()
        return rnn.sigmoid(a * top + b).astype(np.float64)

    return score


def score_column(model: dict, text_col: str = "text"):
    """The score of a text column, null texts as empty."""

    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = scorer(model)
        for texts in batches:
            yield pa.array(of(texts))

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from tidy(scores)(batches)

    return score(text_of(text_col))


def toxicity(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``df``.

    ``labels`` (doc_id, toxic) of rows with crc32(doc_id) mod 5 = 0 are not read into the
    training. Null and empty texts get the score of a window without words; repeated rows
    score alike; without labels of both kinds every score is that of a clean text. An empty
    table gives an empty result. The score sees the text alone.
    """
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    model = train(_sample(rows, labels))
    scored = rows.select("doc_id", held_out().alias("held_out"), score_column(model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``df`` whose text scores under 0.5, columns unchanged."""
    model = train(_sample(df.select("doc_id", "text"), labels))
    scored = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), score_column(model).alias("score"))
    return scored.filter("score < 0.5").select("row.*")
