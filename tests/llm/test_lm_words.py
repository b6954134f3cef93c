"""Language-model scoring: what goes back to the chunks, and the arithmetic of the network against plain forms."""

from __future__ import annotations

from collections import Counter

import numpy as np

from reamwork.llm import lm_scoring


def test_words_of_one_chunk_do_not_go_back(spark, monkeypatch):
    """Counts go back without a join, and only those of words in several chunks; null and equal rows count as before."""
    texts = [f"common w{i % 7} alone{i} Alone{i} é{i}" for i in range(60)] + [None, "", "common common", "common common"]
    keys = [*range(60), None, 60, 61, 61]
    monkeypatch.setattr(lm_scoring, "CHUNK_BYTES", 300)
    kept, inner = [], lm_scoring.settle
    monkeypatch.setattr(lm_scoring, "settle", lambda df, label: kept.append((label, inner(df, label))) or kept[-1][1])
    got = lm_scoring.lm_score(spark.createDataFrame(list(zip(keys, texts)), "doc_id bigint, text string"))
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
    words = dict(kept)["lm-words"].collect()
    held = lm_scoring.held_out(keys)
    counts = Counter(t for x, out in zip(texts, held) if not out for t in lm_scoring.tokens(x))
    chunks = Counter(bytes(r.word) for r in words)
    assert max(chunks.values()) > 5 and all(r.shared == (chunks[bytes(r.word)] > 1) and r.c == counts[bytes(r.word)] for r in words)
    assert Counter(bytes(r.word) for r in words if r.first) == Counter(chunks.keys())
    n, v = sum(counts.values()), len(counts)

    def want(key, text, out):
        found = lm_scoring.tokens(text)
        return (-1 if key is None else key, bool(out), len(found), sum(counts[t] > 0 for t in found), n,
                round(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in found), 8))

    rows = [(-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 8)) for r in got.collect()]
    assert sorted(rows) == sorted(want(*x) for x in zip(keys, texts, held))


def test_sums_of_rare_and_frequent_entries():
    dice = np.random.default_rng(1)
    values = np.concatenate([np.zeros(500, int), dice.integers(1, 90, 700), np.full(lm_scoring.FEW, 95), np.full(lm_scoring.FEW + 1, 96), [4095]])
    dice.shuffle(values)
    parts = dice.standard_normal((3, len(values), lm_scoring.STATE))
    want = np.zeros((lm_scoring.VOCABULARY, 3 * lm_scoring.STATE))
    np.add.at(want, values, np.concatenate(list(parts), 1))
    present, sums = lm_scoring._sums_by_value(values, parts)
    assert sorted(present) == sorted(set(values.tolist())) and np.abs(sums - want[present]).max() < 1e-12


def test_log_probabilities_of_any_weights():
    """More rows than a slab and a block have; once with weights whose exponentials overflow."""
    dice = np.random.default_rng(2)
    y = np.concatenate([dice.integers(0, 64, 1500), dice.integers(0, lm_scoring.VOCABULARY, 1500)])
    states = np.tanh(dice.standard_normal((3000, lm_scoring.STATE)))
    for reach in (0.3, 300):
        w = {k: dice.standard_normal(s) * reach for k, s in lm_scoring.shapes().items()}

        def log_softmax(logits):
            logits = logits - logits.max(1, keepdims=True)
            return logits - np.log(np.exp(logits).sum(1, keepdims=True))

        c, at = np.divmod(y, lm_scoring.CLASS_SIZE)
        rows = np.arange(len(y))
        want = log_softmax(states @ w["class_w"] + w["class_b"])[rows, c]
        want += log_softmax(np.einsum("ns,nsk->nk", states, w["word_w"][c]) + w["word_b"][c])[rows, at]
        assert np.abs(lm_scoring.log_probs(w, states, y) - want).max() < 1e-9 * max(1, np.abs(want).max())
