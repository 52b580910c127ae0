"""op8: words that hold nothing the network knows cost one row of the table and are not taken apart."""

import numpy as np

from vistaspark.llm import recurrent as rnn


def test_words_of_one_kind_share_a_row(monkeypatch):
    documents = [{"hateful", "the", f"w{k}"} for k in range(20)] + [{"kind", "the", "a"} for _ in range(60)]
    inputs = rnn.Inputs(documents, np.array([1] * 20 + [0] * 60))
    assert inputs.runs and inputs.words
    letters = np.random.default_rng(3).choice(list("abdegijknoqrsxz"), (5000, 9))
    words = ["".join(w) for w in letters]
    odd = ["hateful", "xhate", "fully", "ful", "a", "", "é", "the", f" {'hateful' * 9}", f"{'x' * 60}hate ", "😀hat", "ha", "\ud800"]
    assert inputs.kinds(words + odd) == [(w, tuple(runs)) for w, runs in map(inputs.rows, words + odd)]
    assert rnn.Inputs([{"a"}, {"b"}], np.array([0, 1])).kinds(["a", "b"]) == [(1, (0,)), (2, (0,))]
    taken, apart = [], rnn.letter_runs
    monkeypatch.setattr(rnn, "letter_runs", lambda w: taken.append(w) or apart(w))
    table = rnn.Table(rnn.new_network(len(inputs.words), len(inputs.runs)), inputs)
    ids = table.ids([w.encode() for w in words + ["hateful"]])
    assert len(taken) < 500 and table.used < 100 and len(table.rows) == len({*words, "hateful"})
    x = table.net["E"][0] + 0, table.net["C"][0]
    plain = np.concatenate([np.concatenate(x) @ table.net[f"W{d}"] + table.net[f"b{d}"] for d in "fb"])
    unknown = [i for i, w in zip(ids, words, strict=False) if inputs.rows(w) == (0, [0])]
    assert len(unknown) > 4000 and np.allclose(table.gates[unknown], plain, atol=1e-6)
