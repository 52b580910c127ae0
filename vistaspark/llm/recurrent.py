"""A bidirectional gated recurrent network with attention pooling, in numpy.

Input at a step is a word's embedding beside the summed embeddings of its letters: trigrams,
and longer runs from its start and its end, so that a stem is known with any ending. The last
layer is one logit for the window.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

WORDS, LETTERS = 12, 12  # widths of the embeddings
HIDDEN, ATTENTION = 8, 6
UNKNOWN = 0
#: Letters of a step, and those that the pieces of a longer run share.
LONGEST, SHARED = 64, 16


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30.0, 30.0)))


def token(chunk: str) -> str:
    """A run of non-space as the network reads it: lower case, without marks at its ends; a piece as it is."""
    if " " in chunk:
        return chunk
    low = chunk.lower()
    a, b = 0, len(low)
    while a < b and not low[a].isalnum():
        a += 1
    while b > a and not low[b - 1].isalnum():
        b -= 1
    return low[a:b] or low[:1]


def chunks_of(text: bytes) -> list[bytes]:
    """The steps of a text: its runs of non-space, one of over ``LONGEST`` letters as overlapping pieces.

    A piece has a space at an end where the run goes on, so that a cut isn't read as the
    start or the end of a word.
    """
    chunks = text.split()
    if max(map(len, chunks), default=0) <= LONGEST:
        return chunks
    out = []
    for chunk in chunks:
        word = token(chunk.decode("utf-8", "replace")) if len(chunk) > LONGEST else ""
        if len(word) <= LONGEST:
            out.append(chunk)
            continue
        last = len(word) - LONGEST
        for at in [*range(0, last, LONGEST - SHARED), last]:
            out.append(f"{' ' * (at > 0)}{word[at : at + LONGEST]}{' ' * (at < last)}".encode())
    return out


def letter_runs(word: str) -> list[str]:
    """Trigrams, starts of 4 to 8 letters and ends of 4 to 6, the edges counting as letters; each once."""
    starts, ends = word[:1] != " ", word[-1:] != " "
    padded = f"{'<' * starts}{word.strip(' ')}{'>' * ends}"
    n = len(padded)
    runs = [padded[i : i + 3] for i in range(max(1, n - 2))]
    runs += [padded[:k] for k in range(4, min(9, n)) if starts] + [padded[-k:] for k in range(4, min(7, n)) if ends]
    return list(dict.fromkeys(runs))


class Inputs:
    """Which words and letter runs have an embedding; row 0 of either table is for all others.

    Kept are words and runs that documents of label 1 have far more often than those of
    label 0 (``Z`` standard errors), and the words that are common anywhere. What few
    documents have can't be told from chance, and would only be learned by heart.
    """

    Z, COMMON = 5.0, 0.05

    def __init__(self, documents: Iterable[set[str]], labels: np.ndarray):
        sizes = np.maximum(np.bincount(labels.astype(int), minlength=2), 1)
        words: dict[str, list[int]] = {}
        runs: dict[str, list[int]] = {}
        known: dict[str, list[str]] = {}
        same: dict[str, str] = {}  # each distinct run is held once
        for document, label in zip(documents, labels.astype(int), strict=True):
            here = set()
            for w in document:
                words.setdefault(w, [0, 0])[label] += 1
                here.update(known[w] if w in known else known.setdefault(w, [same.setdefault(r, r) for r in letter_runs(w)]))
            for r in here:
                runs.setdefault(r, [0, 0])[label] += 1
        self.words = self._chosen(words, sizes, self.COMMON * sizes.sum())
        self.runs = self._chosen(runs, sizes, np.inf)
        self.starts = np.unique(_triples("".join(f"{r[:3]:\0<3}" for r in self.runs))[::3])

    def _chosen(self, counts: dict[str, list[int]], sizes: np.ndarray, common: float) -> dict[str, int]:
        names = sorted(counts)
        table = np.array([counts[x] for x in names]).reshape(-1, 2).T
        wanted = np.flatnonzero(self._telling(table, sizes) | (table.sum(0) >= common))
        return {names[i]: k + 1 for k, i in enumerate(wanted)}

    def _telling(self, counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        share = counts.sum(0) / sizes.sum()
        spread = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / sizes).sum())
        return ((counts[1] / sizes[1] - counts[0] / sizes[0]) / spread > self.Z) & (counts[1] >= max(3, 0.015 * sizes[1]))

    def rows(self, word: str) -> tuple[int, list[int]]:
        of = self.runs
        return self.words.get(word, UNKNOWN), [of[r] for r in letter_runs(word) if r in of] or [0]

    def kinds(self, words: list[str]) -> list[tuple[int, tuple[int, ...]]]:
        """``rows`` of each word. Only those are taken apart that have the first three letters of a kept run anywhere."""
        text = "".join(f"<{w}>" for w in words)
        triples = _triples(text)
        hits = np.flatnonzero(self.starts[np.minimum(np.searchsorted(self.starts, triples), len(self.starts) - 1)] == triples) if len(self.starts) else []
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 2)
        out = [(self.words.get(w, UNKNOWN), (0,)) for w in words]
        for k in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
            word, runs = self.rows(words[k])
            out[k] = word, tuple(runs)
        for k in [k for k, w in enumerate(words) if len(w) < 2 or " " in w]:  # short ones, and pieces without edges
            word, runs = self.rows(words[k])
            out[k] = word, tuple(runs)
        return out


def _triples(text: str) -> np.ndarray:
    """Each three letters in a row as one number."""
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return letters[:-2] | letters[1:-1] << np.uint64(21) | letters[2:] << np.uint64(42)


def new_network(n_words: int, n_runs: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    normal = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
    width = WORDS + LETTERS
    net = {"E": normal(n_words + 1, WORDS, s=0.1), "C": normal(n_runs + 1, LETTERS, s=0.1)}
    for d in "fb":
        net[f"W{d}"] = normal(width, 3 * HIDDEN, s=width**-0.5)
        net[f"U{d}"] = normal(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5)
        net[f"b{d}"] = np.zeros(3 * HIDDEN, np.float32)
    net["A"], net["a"] = normal(2 * HIDDEN, ATTENTION, s=0.3), np.zeros(ATTENTION, np.float32)
    net["v"], net["w"], net["c"] = normal(ATTENTION, s=0.3), normal(2 * HIDDEN, s=0.3), np.zeros(1, np.float32)
    return net


def _gate(x: np.ndarray) -> np.ndarray:
    """The logistic function in place; exp may overflow to infinity, which gives 0."""
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _run(gates: np.ndarray, mask: np.ndarray, u: np.ndarray, backwards: bool, keep: bool):
    """States of one direction. ``gates``: time x batch x 3H, already with the input's share."""
    steps, batch, _ = gates.shape
    h, states, kept = np.zeros((batch, HIDDEN), gates.dtype), np.empty((steps, batch, HIDDEN), gates.dtype), []
    full = mask.all()
    with np.errstate(over="ignore"):
        for t in range(steps - 1, -1, -1) if backwards else range(steps):
            past = h @ u
            rz = _gate(gates[t, :, : 2 * HIDDEN] + past[:, : 2 * HIDDEN])
            r, z = rz[:, :HIDDEN], rz[:, HIDDEN:]
            n = np.tanh(gates[t, :, 2 * HIDDEN :] + r * past[:, 2 * HIDDEN :])
            new = h - n
            new *= z
            new += n
            if not full:
                new = np.where(mask[t][:, None], new, h)
            if keep:
                kept.append((t, h, past[:, 2 * HIDDEN :], r, z, n))
            h = states[t] = new
    return states, kept


def forward(net: dict, gates_f: np.ndarray, gates_b: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of the windows; ``mask`` is time x batch. A window without words pools to zero."""
    states_f, kept_f = _run(gates_f, mask, net["Uf"], False, keep)
    states_b, kept_b = _run(gates_b, mask, net["Ub"], True, keep)
    h = np.concatenate([states_f, states_b], axis=2)
    u = np.tanh(h @ net["A"] + net["a"])
    e = np.where(mask, np.exp(np.clip(u @ net["v"], -20, 20)), 0).astype(np.float32)
    total = e.sum(0)
    weight = e / np.maximum(total, 1e-9)
    pooled = (weight[:, :, None] * h).sum(0)
    logit = pooled @ net["w"] + net["c"][0]
    return logit, (h, u, weight, pooled, kept_f, kept_b) if keep else None


def _run_back(d_states: np.ndarray, kept: list, mask: np.ndarray, u: np.ndarray):
    """Gradients of the gates and of ``u`` from those of the states."""
    d_gates, d_u, carry = np.zeros((*d_states.shape[:2], 3 * HIDDEN), np.float32), np.zeros_like(u), 0.0
    for t, h, past_n, r, z, n in reversed(kept):
        total = d_states[t] + carry
        on = mask[t][:, None]
        d = np.where(on, total, 0)
        dn, dz, dh = d * (1 - z), d * (h - n), d * z
        da = dn * (1 - n * n)
        dr = da * past_n
        g = np.concatenate([dr * r * (1 - r), dz * z * (1 - z), da], axis=1)
        d_gates[t] = g
        through = np.concatenate([g[:, : 2 * HIDDEN], da * r], axis=1)
        d_u += h.T @ through
        carry = dh + through @ u.T + np.where(on, 0, total)
    return d_gates, d_u


def backward(net: dict, d_logit: np.ndarray, mask: np.ndarray, saved) -> tuple[dict, np.ndarray, np.ndarray]:
    h, u, weight, pooled, kept_f, kept_b = saved
    grad = {"w": pooled.T @ d_logit, "c": np.array([d_logit.sum()], np.float32)}
    d_pooled = d_logit[:, None] * net["w"]
    dh = weight[:, :, None] * d_pooled
    d_weight = np.einsum("tbh,bh->tb", h, d_pooled)
    d_score = weight * (d_weight - (weight * d_weight).sum(0))
    grad["v"] = np.einsum("tb,tba->a", d_score, u)
    d_pre = d_score[:, :, None] * net["v"] * (1 - u * u)
    grad["A"] = np.einsum("tbh,tba->ha", h, d_pre)
    grad["a"] = d_pre.sum((0, 1))
    dh = dh + d_pre @ net["A"].T
    gf, grad["Uf"] = _run_back(dh[:, :, :HIDDEN], kept_f, mask, net["Uf"])
    gb, grad["Ub"] = _run_back(dh[:, :, HIDDEN:], kept_b, mask, net["Ub"])
    return grad, gf, gb


class Adam:
    def __init__(self, net: dict, rate: float = 0.01):
        self.rate, self.t = rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in net.items()} for _ in range(2))

    def step(self, net: dict, grad: dict) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for k, g in grad.items():
            g = g * scale
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            if k in "EC":  # embeddings shrink where nothing holds them
                net[k] *= 1 - 0.2 * self.rate
            net[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)


class Table:
    """Input shares of the gates, a row for each kind of chunk a worker has met (row 0: none).

    Chunks of the same embeddings are one kind, as all are that have none.
    """

    KEPT = 250_000

    def __init__(self, net: dict, inputs: Inputs):
        self.net, self.inputs = net, inputs
        self.clear()

    def clear(self) -> None:
        self.rows: dict[bytes, int] = {}
        self.kinds: dict[tuple[int, tuple[int, ...]], int] = {}
        self.gates = np.zeros((1024, 6 * HIDDEN), np.float32)
        self.used = 1

    def _add(self, kinds: list[tuple[int, tuple[int, ...]]]) -> None:
        words, grams = zip(*kinds, strict=True)
        starts = np.cumsum([0, *map(len, grams[:-1])])
        sizes = np.sqrt(np.array([len(g) for g in grams], np.float32))[:, None]
        chars = np.add.reduceat(self.net["C"][np.concatenate(grams)], starts, axis=0) / sizes
        x = np.concatenate([self.net["E"][list(words)], chars], axis=1)
        new = np.concatenate([x @ self.net["Wf"] + self.net["bf"], x @ self.net["Wb"] + self.net["bb"]], axis=1)
        while self.used + len(new) > len(self.gates):
            self.gates = np.concatenate([self.gates, np.zeros_like(self.gates)])
        self.gates[self.used : self.used + len(new)] = new
        self.kinds.update(zip(kinds, range(self.used, self.used + len(new)), strict=True))
        self.used += len(new)

    def ids(self, chunks: list[bytes]) -> np.ndarray:
        missing = list(set(chunks).difference(self.rows))
        if missing:
            kinds = self.inputs.kinds([token(c.decode("utf-8", "replace")) for c in missing])
            fresh = [k for k in dict.fromkeys(kinds) if k not in self.kinds]
            if fresh:
                self._add(fresh)
            self.rows.update(zip(missing, map(self.kinds.__getitem__, kinds), strict=True))
        return np.fromiter(map(self.rows.__getitem__, chunks), np.int64, len(chunks))
