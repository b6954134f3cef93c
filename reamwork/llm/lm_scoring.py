"""Language-model scoring with a gated recurrent network in numpy.

Tokens are words of the lower-cased text (A-Z only) and one end per document. The most frequent training
words are the network's vocabulary, with one entry for all others ("rare"); a rare word's share is
its smoothed count among the rare ones, so the scores are log-probabilities of whole texts. The output
softmax is factored: words sorted by frequency make classes of equal size; a token's probability is that of its class
times that within the class. A unit computes update gate, reset gate and candidate state.

Work on Spark:

* Documents are dealt into chunks by a hash of the row, of about ``CHUNK_BYTES`` by the total size.
* Each chunk gives its distinct words with training counts. Counts of all training tokens are sums over the rows of a
  word, a row a chunk at most, and go back to its chunks: (chunk, word) pairs, not tokens, are shuffled. Words that
  stand in one chunk alone do not go back, as that chunk has their counts itself.
* All tokens of the training documents are trained on, as entries of two bytes. A document is one run, whatever its
  length; it begins with an end. Runs are dealt to shards by a hash of document and text, so equal texts spread.
* Training runs in ``ROUNDS``: tasks take shards of runs, run truncated back-propagation with the weights of the
  last round and give their weights; those of a task are added in it, those of all tasks by ``GROUPS`` tasks and then one, packed, and the mean begins the next round.
  The number of shards grows with the tokens.
  Each run is in one round. ``BATCH`` runs go side by side, window after window; each window begins with the state
  the last one of its run ended with, and the next run with the zero state.
* Scoring cogroups a chunk's documents with its words. ``LANES`` documents of a chunk step together, ordered by length;
  the state of each goes on from window to window until its end. Chunks do not share anything else.

Only the vocabulary (``VOCABULARY`` words) and the weights, both of fixed size, reach the driver.

Defined results: a null or empty text is the end token alone; a null id counts as the text "" for the fold; an empty
table gives an empty table; without any training document all words are unseen and the network is its start;
repeated rows are tokens each and are scored each; words of equal count are ordered by their bytes; further columns do not matter.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle
from .common import text_chunks

FOLDS, HELD_OUT = 7, 2
CHUNK_BYTES = 8 << 20
STATE = 16
CLASSES, CLASS_SIZE = 64, 64
VOCABULARY = CLASSES * CLASS_SIZE  # entry 0 is "rare"
WINDOW = 32
BATCH = 256
SHARD_WINDOWS = 65_536
ROUNDS = 2
GROUPS = 32
RATE = 0.2
SEEN = 1e-6
SEED = 11
END = b""  # no word is empty
OUTPUT_ROWS = 16_384
BLOCK_ROWS = 512  # of a product of matrices: what its inputs and outputs take stays in a core's cache
SLAB_ROWS = 2_048
LANES = 512
FEW = 32
FLOAT = np.float32


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words of a text (bytes.split knows exactly the ASCII white space) and the end."""
    return _tokens((text or "").encode())


def _tokens(text: bytes | None) -> list[bytes]:
    found = (text or b"").lower().split()
    found.append(END)
    return found


def _as_bytes(texts) -> list[bytes | None]:
    """The texts of an Arrow column, encoded as they are there."""
    import pyarrow as pa

    return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()


class _Numbers(dict):
    """Words and their numbers; a new word gets the next one."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


# --- the network ------------------------------------------------------------------------------------


def shapes() -> dict[str, tuple[int, ...]]:
    """``inputs``: what a token adds to the gates (update, reset, candidate); ``state``: what the state adds."""
    return {
        "inputs": (VOCABULARY, 3 * STATE), "state": (STATE, 3 * STATE), "candidate": (STATE,),
        "class_w": (STATE, CLASSES), "class_b": (CLASSES,),
        "word_w": (CLASSES, STATE, CLASS_SIZE), "word_b": (CLASSES, CLASS_SIZE),
    }


def start(counts: np.ndarray) -> dict[str, np.ndarray]:
    """Weights whose output is the frequency of each entry (those without a count are impossible)."""
    dice = np.random.default_rng(SEED)
    weights = {k: (dice.standard_normal(s) * 0.1).astype(FLOAT) for k, s in shapes().items()}
    weights["candidate"][:] = 0
    table = np.asarray(counts, dtype=np.float64).reshape(CLASSES, CLASS_SIZE)
    none = -50.0
    with np.errstate(divide="ignore"):
        weights["word_b"] = np.maximum(np.log(table / np.maximum(table.sum(1, keepdims=True), 1)), none).astype(FLOAT)
        weights["class_b"] = np.maximum(np.log(table.sum(1) / max(table.sum(), 1)), none).astype(FLOAT)
    for k in ("class_w", "word_w"):
        weights[k] *= FLOAT(0.1)
    return weights


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in shapes()])


def unflat(values: np.ndarray) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes().items():
        n = int(np.prod(s))
        out[k] = np.ascontiguousarray(values[at:at + n].reshape(s), dtype=FLOAT)
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def step(w: dict[str, np.ndarray], x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
    """The next state, and what the way back needs."""
    own, from_state = w["inputs"][x], h @ w["state"]
    gates = _sigmoid(own[:, :2 * STATE] + from_state[:, :2 * STATE])
    z, r = gates[:, :STATE], gates[:, STATE:]
    inner = from_state[:, 2 * STATE:] + w["candidate"]
    n = np.tanh(own[:, 2 * STATE:] + r * inner)
    return n + z * (h - n), z, r, inner, n


def _tables(w: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """The weights as :func:`_forward` takes them: by gate, and halved for the two logistic ones."""
    halves = np.array([0.5, 0.5, 1], w["state"].dtype)[:, None, None]
    return *(np.multiply(w[k].reshape(-1, 3, STATE).transpose(1, 0, 2), halves, order="C") for k in ("inputs", "state")), w["candidate"]


def _forward(tables: tuple[np.ndarray, ...], x: np.ndarray, h: np.ndarray, way_back: bool) -> tuple[np.ndarray, ...]:
    """States after each of the steps ``x`` (a row of entries a step), as :func:`step` has them one by one; with ``way_back``
    also its gates, inner and new values of every step. A logistic is 1/2 + tanh(half)/2."""
    inputs, state, candidate = tables
    steps, size = x.shape
    kind, kept = inputs.dtype, steps if way_back else 1
    gates, inner, n = np.empty((kept, 2, size, STATE), kind), np.empty((kept, size, STATE), kind), np.empty((kept, size, STATE), kind)
    states, own, from_state = np.empty((steps, size, STATE), kind), np.empty((3, size, STATE), kind), np.empty((3, size, STATE), kind)
    half = kind.type(0.5)
    for t in range(steps):
        k = t if way_back else 0
        gates_t, inner_t, n_t, next_h = gates[k], inner[k], n[k], states[t]
        np.take(inputs, x[t], axis=1, out=own, mode="clip")
        np.matmul(h, state, out=from_state)
        np.add(from_state[:2], own[:2], out=gates_t)
        np.tanh(gates_t, out=gates_t)
        gates_t *= half
        gates_t += half
        np.add(from_state[2], candidate, out=inner_t)
        np.multiply(gates_t[1], inner_t, out=n_t)
        n_t += own[2]
        np.tanh(n_t, out=n_t)
        np.subtract(h, n_t, out=next_h)
        next_h *= gates_t[0]
        next_h += n_t
        h = next_h
    return states, gates, inner, n


def _is_tame(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether exponentials of the logits of any state can neither overflow nor all vanish: a state has no entry beyond 1."""
    reach = np.abs(weights).sum(-2)
    return bool((bias + reach).max() < 80 and (bias - reach).max(-1).min() > -80)


class _Softmax:
    """Softmaxes of several groups of entries. A state is a row with a 1 at its end, for the bias; rows of a group stand together."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        kind = weights.dtype.type
        self.tame, self.kind, self.size = _is_tame(weights, bias), kind, bias.shape[1]
        self.binary = np.concatenate([weights, bias[:, None]], 1) * kind(1 / np.log(2))  # powers of two are faster than those of e
        self.weights, self.ones = weights, np.ones(self.size, kind)

    def log_probs(self, blocks: list[tuple[int, int, int]], s: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the entries ``at`` after the states ``s``; a block is (group, from, to)."""
        exps = np.empty((len(s), self.size), self.kind)
        for k, i, j in blocks:
            np.matmul(s[i:j], self.binary[k], out=exps[i:j])
        if not self.tame:
            exps -= exps.max(1, keepdims=True)
        places = np.arange(0, exps.size, self.size) + at
        picked = np.take(exps, places)
        np.exp2(exps, out=exps)
        total = exps @ self.ones
        self.last = exps, places, total
        return (picked - np.log2(total)) * self.kind(np.log(2))

    def begin(self) -> None:
        self.back = np.ascontiguousarray(self.weights.transpose(0, 2, 1))
        self.grads = np.zeros(self.binary.shape, self.kind)

    def go_back(self, blocks: list[tuple[int, int, int]], s: np.ndarray, scale) -> np.ndarray:
        """Of minus the last log-probabilities times ``scale``: the gradients by the states, and those by the weights and
        biases, which are added to ``grads``."""
        exps, places, total = self.last
        exps.reshape(-1)[places] -= total
        factor = (scale / total)[:, None]
        s, to_states = s * factor, np.empty((len(s), STATE), self.kind)
        for k, i, j in blocks:
            self.grads[k] += s[i:j].T @ exps[i:j]
            np.matmul(exps[i:j], self.back[k], out=to_states[i:j])
        to_states *= factor
        return to_states


class _Outputs:
    """The class of a token and the token within it, after a state."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.by_class, self.within = _Softmax(w["class_w"][None], w["class_b"][None]), _Softmax(w["word_w"], w["word_b"])

    def slabs(self, states: np.ndarray, rows: np.ndarray, targets: np.ndarray) -> Iterator[tuple]:
        """For some of the rows at a time, those of a class together: their places, log-probabilities, and what :meth:`_Softmax.go_back` takes."""
        order, present, begins = _by_value(targets // CLASS_SIZE)
        ends = [*begins[1:], len(rows)]
        for a in range(0, len(rows), SLAB_ROWS):
            own = order[a:a + SLAB_ROWS]
            s, y, b = np.ones((len(own), STATE + 1), states.dtype), targets[own], a + len(own)
            s[:, :STATE] = np.take(states, rows[own], axis=0)
            one = [(0, i, min(i + BLOCK_ROWS, len(own))) for i in range(0, len(own), BLOCK_ROWS)]
            blocks = [(c, i, min(i + BLOCK_ROWS, e - a)) for c, f, t in zip(present, begins, ends) if f < b and t > a
                      for e in (min(t, b),) for i in range(max(f, a) - a, e - a, BLOCK_ROWS)]
            found = self.by_class.log_probs(one, s, y // CLASS_SIZE) + self.within.log_probs(blocks, s, y % CLASS_SIZE)
            yield own, found, s, one, blocks


def log_probs(w: dict[str, np.ndarray] | _Outputs, states: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log-probabilities of the entries ``y`` after the states."""
    out = np.empty(len(y), np.float64)
    for own, found, *_ in (w if isinstance(w, _Outputs) else _Outputs(w)).slabs(states, np.arange(len(y)), y):
        out[own] = found
    return out


def _by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts values, the distinct ones, and where each of them begins in it."""
    order = np.argsort(values.astype(np.uint16), kind="stable")  # entries have two bytes; these are sorted by digits
    values = values[order]
    begins = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else order
    return order, values[begins], begins


def sparse_gradients(
    w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray, carried: np.ndarray | None = None,
) -> tuple[float, dict[str, tuple[np.ndarray | slice, np.ndarray]]]:
    """Loss of a batch of windows (rows), and its gradients by back-propagation truncated to the window.

    Of each kind of weight the gradient comes as (places, values); it is zero elsewhere. The rows begin
    with the states ``carried`` (zero if not given), which become those after the last step. Both are sums over the targets divided
    by the targets of a full batch, so that the last few documents of a shard do not count for more than others.
    """
    size, steps = x.shape
    kind, every = w["state"].dtype, slice(None)
    entries = np.ascontiguousarray(x.T)
    first = np.zeros((size, STATE), kind) if carried is None else carried.copy()
    states, gates, inner, n = _forward(_tables(w), entries, first, True)
    if carried is not None:
        carried[:] = states[-1]
    rows = np.flatnonzero(mask.T.ravel())
    scale, loss = kind.type(1 / max(len(rows), BATCH * WINDOW)), 0.0
    d_states, outputs = np.zeros((steps * size, STATE), kind), _Outputs(w)
    outputs.by_class.begin()
    outputs.within.begin()
    for own, found, s, one, blocks in outputs.slabs(states.reshape(-1, STATE), rows, y.T.ravel()[rows]):
        loss += found.sum()
        to_states = outputs.by_class.go_back(one, s, scale)
        to_states += outputs.within.go_back(blocks, s, scale)
        d_states[rows[own]] = to_states
    by_class, within = outputs.by_class.grads[0], outputs.within.grads
    grads: dict[str, tuple[np.ndarray | slice, np.ndarray]] = {
        "class_w": (every, by_class[:STATE]), "class_b": (every, by_class[STATE]),
        "word_w": (every, within[:, :STATE]), "word_b": (every, within[:, STATE])}
    d_states = d_states.reshape(steps, size, STATE)
    d_own, back = np.empty((3, steps, size, STATE), kind), np.ascontiguousarray(w["state"].reshape(STATE, 3, STATE).transpose(1, 2, 0))
    d_next, some = np.zeros((size, STATE), kind), np.empty((size, STATE), kind)
    all_inner, d_before = np.empty((steps, size, STATE), kind), np.empty((3, size, STATE), kind)
    for t in range(steps - 1, -1, -1):
        before, z, r, n_t = states[t - 1] if t else first, gates[t, 0], gates[t, 1], n[t]
        d, d_z, d_r, d_n, d_inner = d_states[t], d_own[0, t], d_own[1, t], d_own[2, t], all_inner[t]
        d += d_next
        np.multiply(d, z, out=d_next)
        np.subtract(d, d_next, out=d_n)  # d (1 - z)
        np.subtract(before, n_t, out=some)
        some *= d_n
        np.multiply(some, z, out=d_z)  # d (before - n) z (1 - z)
        np.multiply(n_t, n_t, out=some)
        some *= d_n
        d_n -= some  # d (1 - z) (1 - n n)
        np.multiply(d_n, r, out=d_inner)
        np.multiply(d_inner, inner[t], out=d_r)
        np.multiply(d_r, r, out=some)
        d_r -= some  # d_n inner r (1 - r)
        np.matmul(d_own[:2, t], back[:2], out=d_before[:2])
        np.matmul(d_inner, back[2], out=d_before[2])
        for k in range(3):
            d_next += d_before[k]
    d_state, all_inner = np.zeros((3, STATE, STATE), kind), all_inner.reshape(-1, STATE)
    before, d_gates = np.concatenate([first[None], states[:-1]]).reshape(-1, STATE), d_own[:2].reshape(2, -1, STATE)
    for i in range(0, len(before), BLOCK_ROWS):
        own = slice(i, i + BLOCK_ROWS)
        d_state[:2] += before[own].T @ d_gates[:, own]
        d_state[2] += before[own].T @ all_inner[own]
    grads["state"] = every, d_state.transpose(1, 0, 2).reshape(STATE, -1)
    grads["candidate"] = every, all_inner.sum(0)
    grads["inputs"] = _sums_by_value(entries.ravel(), d_own.reshape(3, -1, STATE))
    return float(-loss * scale), grads


def _sums_by_value(values: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the sums of their rows, whose columns come in parts.

    The first ``FEW`` rows of all values are added turn by turn, the further ones of frequent values value by value.
    """
    order, present, begins = _by_value(values)
    counts = np.diff(begins, append=len(values))
    falling = np.argsort(-counts, kind="stable")
    present, begins, counts = present[falling], begins[falling], counts[falling]
    sums = np.take(parts, order[begins], axis=1)
    for k in range(1, min(FEW, int(counts[0]))):
        m = int(np.searchsorted(-counts, -k, side="left"))  # values of more than k rows
        sums[:, :m] += np.take(parts, order[begins[:m] + k], axis=1)
    for i in range(int(np.searchsorted(-counts, -FEW, side="left"))):
        rows = np.take(parts, order[begins[i] + FEW:begins[i] + counts[i]], axis=1)
        sums[:, i] += np.ones(rows.shape[1], rows.dtype) @ rows
    return present, np.concatenate(list(sums), 1)


def gradients(
    w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, mask: np.ndarray, carried: np.ndarray | None = None,
) -> tuple[float, dict[str, np.ndarray]]:
    """:func:`sparse_gradients` with all zeros written out."""
    loss, sparse = sparse_gradients(w, x, y, mask, carried)
    whole = {k: np.zeros(s, w["state"].dtype) for k, s in shapes().items()}
    for k, (places, values) in sparse.items():
        whole[k][places] = values
    return loss, whole


def train(w: dict[str, np.ndarray], runs: list[np.ndarray]) -> dict[str, np.ndarray]:
    """Adaptive gradient descent over all windows of the runs: entry 0 of a run is the token before, the others are targets.

    ``BATCH`` runs go side by side; where one ends, the next begins.
    """
    w = {k: v.copy() for k, v in w.items()}
    seen = {k: np.full(v.shape, SEEN, v.dtype) for k, v in w.items()}
    # the longest first: so lanes end at about the same time
    runs = sorted((r for r in runs if len(r) > 1), key=lambda r: -len(r))
    if not runs:
        return w
    ids = np.concatenate(runs).astype(np.int64)
    ends = np.cumsum([len(r) for r in runs])
    begins = ends - [len(r) for r in runs]
    waiting = min(BATCH, len(runs))  # the next run to begin
    at, end = begins[:waiting].copy(), ends[:waiting].copy()
    states = np.zeros((waiting, STATE), w["state"].dtype)
    while len(at):
        longest = min(WINDOW, int((end - at).max()) - 1)
        places = at[:, None] + np.arange(longest)
        mask = places + 1 < end[:, None]
        places = np.where(mask, places, at[:, None])
        _, grads = sparse_gradients(w, ids[places], ids[places + 1], mask, states)
        for k, (at_k, g) in grads.items():  # where the gradient is zero a step changes nothing
            dense = isinstance(at_k, slice)
            so_far, change = seen[k] if dense else np.take(seen[k], at_k, axis=0), g * g
            so_far += change
            g *= FLOAT(RATE)
            g /= np.sqrt(so_far, out=change)
            if dense:
                w[k] -= g
            else:
                seen[k][at_k], w[k][at_k] = so_far, np.take(w[k], at_k, axis=0) - g
        at += WINDOW
        done = np.flatnonzero(at + 1 >= end)
        new = np.arange(waiting, min(waiting + len(done), len(runs)))
        waiting += len(new)
        filled = done[:len(new)]
        at[filled], end[filled], states[filled] = begins[new], ends[new], 0
        left = done[len(new):]
        if len(left):
            at, end, states = np.delete(at, left), np.delete(end, left), np.delete(states, left, 0)
    return w


def score(w: dict[str, np.ndarray], ids: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """Sums of natural log-probabilities of documents: document i is ``ids[starts[i]:starts[i + 1]]``.

    All documents step together, the longest first, so that those still going are the first rows; each
    window of steps begins with the states the last one ended with.
    """
    lengths = np.diff(starts)
    order = np.argsort(-lengths, kind="stable")
    lengths, begins = lengths[order], starts[:-1][order]
    sums, tables, outputs = np.zeros(len(lengths)), _tables(w), _Outputs(w)
    for first in range(0, len(lengths), LANES):
        own = slice(first, first + LANES)
        sums[own] = _score_lanes(outputs, tables, ids, begins[own], lengths[own], end)
    out = np.empty(len(sums))
    out[order] = sums
    return out


def _score_lanes(
    outputs: _Outputs, tables: tuple[np.ndarray, ...], ids: np.ndarray, begins: np.ndarray, lengths: np.ndarray, end: int,
) -> np.ndarray:
    sums, h = np.zeros(len(lengths)), np.zeros((len(lengths), STATE), FLOAT)
    last = np.full(len(lengths), end, np.int64)  # a text begins after an end
    a = 0
    while a < lengths[0]:
        n = int(np.searchsorted(-lengths, -a, side="left"))  # documents longer than a
        steps = min(-(-OUTPUT_ROWS // n), int(lengths[0]) - a)  # the fewer go on, the longer the window
        at = a + np.arange(steps)[:, None]
        inside = at < lengths[:n]
        y = ids[np.where(inside, begins[:n] + at, begins[:n])]
        states = _forward(tables, np.concatenate([last[None, :n], y[:-1]]), h[:n], False)[0]
        h[:n], last[:n] = states[-1], y[-1]
        rows = np.flatnonzero(inside)
        found = log_probs(outputs, np.take(states.reshape(-1, STATE), rows, axis=0), y.ravel()[rows])
        sums[:n] += np.bincount(rows % n, weights=found, minlength=n)
        a += steps
    return sums


# --- the corpus -------------------------------------------------------------------------------------


def held_out(ids) -> np.ndarray:
    return np.array([zlib.crc32(("" if i is None else str(i)).encode()) % FOLDS == HELD_OUT for i in ids], bool)


def _gather(chunked: DataFrame) -> DataFrame:
    """Per chunk: its distinct words with training counts (``word, n``)."""
    import pyarrow as pa

    def of_chunk(group: pa.Table) -> pa.Table:
        trained, other = Counter(), set()
        for text, out in zip(_as_bytes(group["text"]), held_out(group["doc_key"].to_pylist())):
            (other if out else trained).update(_tokens(text))
        words = [*trained, *(other - trained.keys())]
        return pa.table({
            "chunk": pa.array([group["chunk"][0].as_py()] * len(words), pa.int64()),
            "word": pa.array(words, pa.binary()),
            "n": pa.array([*trained.values(), *[0] * (len(words) - len(trained))], pa.int64()),
        })

    return chunked.groupBy("chunk").applyInArrow(of_chunk, "chunk bigint, word binary, n bigint")


def _runs(rows: DataFrame, entry: dict[bytes, int]) -> DataFrame:
    """``doc_key, n, run`` of the training documents: an end and the text as entries of two bytes, and its windows."""
    import pyarrow as pa

    end = entry.get(END, 0)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            keys = batch.column(0).to_pylist()
            for key, text, out_of_it in zip(keys, _as_bytes(batch.column(1)), held_out(keys)):
                if out_of_it:
                    continue
                found = _tokens(text)
                run = np.empty(len(found) + 1, "<u2")
                run[0] = end
                run[1:] = np.fromiter(map(entry.get, found, repeat(0)), "<u2", len(found))
                out.append((key, -(-len(found) // WINDOW), run.tobytes()))
                held += len(run)
                if held > CHUNK_BYTES:
                    yield _run_batch(out)
                    out, held = [], 0
            yield _run_batch(out)

    def _run_batch(out: list) -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * 3
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.binary()))], ["doc_key", "n", "run"])

    return rows.select("doc_key", "text").mapInArrow(cut, "doc_key string, n bigint, run binary")


def vocabulary(counts: DataFrame, n_tokens: int) -> tuple[dict[bytes, int], np.ndarray]:
    """Entries of the most frequent training words, and the count of each entry; 0 is rare."""
    top = counts.filter("c > 0").orderBy(F.col("word") != F.lit(END), F.desc("c"), "word").limit(VOCABULARY - 1).collect()
    top.sort(key=lambda row: (-row["c"], bytes(row["word"])))
    entry = {bytes(row["word"]): i + 1 for i, row in enumerate(top)}
    sizes = np.zeros(VOCABULARY)
    sizes[1:len(top) + 1] = [row["c"] for row in top]
    sizes[0] = n_tokens - sizes.sum() + 1
    return entry, sizes


def fit(rows: DataFrame, entry: dict[bytes, int], sizes: np.ndarray) -> dict[str, np.ndarray]:
    """Rounds of training on shards of the runs of all training documents, averaged."""
    import pyarrow as pa

    runs = settle(_runs(rows, entry), "lm-runs")
    n = runs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    weights = start(sizes)
    if not n:
        return weights
    shards = max(1, -(-n // (SHARD_WINDOWS * ROUNDS)))
    shape = "part int, n bigint, weights binary"

    def packed(part: int, n: int, values: np.ndarray) -> dict:
        return {"part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "weights": pa.array([values.tobytes()], pa.binary())}

    def added(rows: list[tuple[int, int, bytes]]) -> tuple[int, np.ndarray]:
        """The number of shards and the sum of their weights, in the order of the parts."""
        return sum(n for _, n, _ in rows), sum(np.frombuffer(w) for _, _, w in sorted(rows, key=lambda r: r[0]))

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n, total = 0, 0.0
        for batch in batches:
            for w in batch.column(2):
                n, total = n + 1, total + np.frombuffer(w.as_py())
        if n:
            yield pa.RecordBatch.from_pydict(packed(TaskContext.get().partitionId(), n, total))

    def of_group(group: pa.Table) -> pa.Table:
        rows = list(zip(*(group[c].to_pylist() for c in ("part", "n", "weights"))))
        return pa.table(packed(min(r[0] for r in rows), *added(rows)))

    for k in range(ROUNDS):
        fixed = weights

        def of_shard(group: pa.Table) -> pa.Table:
            order = sorted(zip(group["doc_key"].fill_null("").to_pylist(), group["run"].to_pylist()))
            np.random.default_rng(SEED).shuffle(order)
            return pa.table(packed(0, 1, flat(train(fixed, [np.frombuffer(run, "<u2") for _, run in order])).astype(np.float64)))  # noqa: B023

        hashed = [F.col("doc_key"), F.col("run")]
        dealt = runs.filter(F.pmod(F.xxhash64(*hashed), F.lit(ROUNDS)) == k).withColumn(
            "shard", F.pmod(F.xxhash64(F.lit(k), *hashed), F.lit(shards)))
        sums = dealt.groupBy("shard").applyInArrow(of_shard, shape).mapInArrow(of_task, shape)
        few = sums.groupBy(F.pmod("part", F.lit(GROUPS))).applyInArrow(of_group, shape)
        got = few.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(of_group, shape).collect()
        if got:
            weights = unflat(np.frombuffer(bytes(got[0]["weights"])) / got[0]["n"])
    return weights


def lm_score(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: fold, tokens, known tokens, size of the training set, unigram and network log10 scores."""
    import pyarrow as pa

    rows = df.select(F.col(doc_id).alias("doc_id"), F.col(doc_id).cast("string").alias("doc_key"), F.col(text).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    chunked = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_key", "text"), F.lit(text_chunks(rows, "text", CHUNK_BYTES)).cast("bigint")))
    of_word = Window.partitionBy("word")  # at most a row a chunk
    words = settle(_gather(chunked).select(
        "word", "chunk", F.sum("n").over(of_word).alias("c"), (F.count("*").over(of_word) > 1).alias("shared"),
        (F.col("chunk") == F.min("chunk").over(of_word)).alias("first")), "lm-words")
    counts = words.filter("first").select("word", "c")
    n_tokens, n_types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    entry, sizes = vocabulary(counts, n_tokens)
    weights = flat(fit(rows, entry, sizes))
    rare_tokens = n_tokens - sizes[1:].sum()
    rare_types = n_types - len(entry)
    end = entry.get(END, 0)
    out_names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def of_chunk(docs: pa.Table, known: pa.Table) -> pa.Table:
        local = _Numbers(zip(known["word"].to_pylist(), range(known.num_rows)))
        held, lengths, out_of_it = [], [], held_out(docs["doc_key"].to_pylist())
        for t in _as_bytes(docs["text"]):
            found = _tokens(t)
            held.append(np.fromiter(map(local.__getitem__, found), np.int32, len(found)))
            lengths.append(len(found))
        ids = np.concatenate(held) if held else np.zeros(0, np.int32)
        del held
        starts = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        c = np.bincount(ids[np.repeat(~out_of_it, lengths)], minlength=len(local)).astype(np.float64)
        c[:known.num_rows] = known["c"].to_numpy()  # words of no other chunk have the counts of this one
        base = np.log10((c + 1) / (n_tokens + n_types + 1))
        entries = np.fromiter(map(entry.get, local, repeat(0)), np.int64, len(local))
        rest = np.where(entries == 0, np.log10((c + 1) / (rare_tokens + rare_types + 1)), 0.0)
        per = lambda v: np.add.reduceat(v[ids], starts[:-1]) if len(ids) else np.zeros(0)
        network = score(unflat(weights), entries[ids], starts, end) / np.log(10)
        return pa.table([
            docs["doc_id"], pa.array(out_of_it), pa.array(lengths, pa.int64()),
            pa.array(per((c > 0).astype(np.int64)).astype(np.int64)), pa.array([n_tokens] * len(lengths), pa.int64()),
            pa.array(per(base)), pa.array(network + per(rest)),
        ], names=out_names)

    shared = words.filter("shared").select("chunk", "word", "c")
    return chunked.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(
        of_chunk, f"doc_id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
