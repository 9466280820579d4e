"""A gated recurrent language model with a class-factored softmax, in numpy."""

from __future__ import annotations

import numpy as np

EMBED, HIDDEN = 32, 32
# Places of a class. A class may fill only the first of them, so that frequent words share theirs with few others.
CLASS_WORDS = 64
# Steps of a training window, over which gradients flow; states are carried from window to window. As many lanes
# (within bounds) as give about UPDATES windows a pass: more are cheaper a word, fewer learn more from few words.
TRAIN_STEPS, TRAIN_LANES, UPDATES = 32, (32, 256), 512
# Lanes and steps of a scoring window.
LANES, STEPS = 256, 64
# The rate is that of one lane; it grows with the square root of their number.
RATE, CLIP = 1e-3, 1.0
# Tokens whose softmax is worked out at a time, and the logits whose exponential is taken as they are.
TOKENS, PLAIN = 2_048, 60.0

Weights = dict[str, np.ndarray]


def shapes(classes: int) -> dict[str, tuple[int, ...]]:
    size = classes * CLASS_WORDS
    return {
        "embed": (size, EMBED),
        "input": (EMBED, 3 * HIDDEN),
        "input_bias": (3 * HIDDEN,),
        "state": (HIDDEN, 3 * HIDDEN),
        "state_bias": (HIDDEN,),
        "to_class": (HIDDEN, classes),
        "class_bias": (classes,),
        "to_word": (classes, HIDDEN, CLASS_WORDS),
        "word_bias": (classes, CLASS_WORDS),
    }


def initial(counts: np.ndarray) -> Weights:
    """Small random gates; outputs that say the words' relative frequencies (``counts``, a row for each class; -1 where no word is)."""
    rng = np.random.default_rng(11)
    out: Weights = {}
    for name, shape in shapes(len(counts)).items():
        scale = {"embed": 0.1, "input": EMBED**-0.5, "state": HIDDEN**-0.5}.get(name, 0.0)
        out[name] = (rng.standard_normal(shape) * scale).astype(np.float32)
    # Places behind the last word of a class have no probability, and a bias of minus infinity.
    smooth = np.where(counts < 0, 0, counts + 0.5)
    of_class = smooth.sum(axis=1, keepdims=True)
    with np.errstate(divide="ignore"):
        out["class_bias"] = np.log(of_class[:, 0] / smooth.sum()).astype(np.float32)
        out["word_bias"] = np.log(smooth / np.where(of_class > 0, of_class, 1)).astype(np.float32)
    return out


def class_sizes(weights: Weights) -> np.ndarray:
    return np.isfinite(weights["word_bias"]).sum(axis=1)


def pack(weights: Weights) -> np.ndarray:
    return np.concatenate([weights[name].ravel() for name in shapes(len(weights["class_bias"]))])


def unpack(flat: np.ndarray, classes: int) -> Weights:
    out, at = {}, 0
    for name, shape in shapes(classes).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape).astype(np.float32)
        at += size
    return out


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Documents dealt to lanes, the longest first, always to the shortest lane."""
    import heapq

    out: list[list[int]] = [[] for _ in range(min(lanes, len(lengths)))]
    heap = [(0, lane) for lane in range(len(out))]
    for doc in np.argsort(-lengths, kind="stable").tolist():
        size, lane = heapq.heappop(heap)
        out[lane].append(doc)
        heapq.heappush(heap, (size + int(lengths[doc]), lane))
    return out


def timelines(docs: list[np.ndarray], lanes: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Steps by lanes: the word before, the word, whether a document begins, the document (-1 behind the last)."""
    lengths = np.array([len(d) for d in docs])
    # Fewer lanes beside a very long document: all end at about the same step, and what is held grows with the words.
    dealt = lanes_of(lengths, min(lanes, -(-int(lengths.sum()) // max(1, int(lengths.max())))))
    steps = max(sum(len(docs[d]) for d in own) for own in dealt)
    shape = (steps, len(dealt))
    before, word = np.full(shape, end, np.int32), np.full(shape, end, np.int32)
    begins, doc = np.zeros(shape, bool), np.full(shape, -1, np.int32)
    for lane, own in enumerate(dealt):
        at = 0
        for d in own:
            size = len(docs[d])
            word[at : at + size, lane] = docs[d]
            before[at + 1 : at + size, lane] = docs[d][:-1]
            before[at, lane], begins[at, lane] = end, True
            doc[at : at + size, lane] = d
            at += size
    return before, word, begins, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place where the argument is no longer needed; callers use what is returned. An exponential of infinity gives 0."""
    np.negative(x, out=x)
    with np.errstate(over="ignore"):
        np.exp(x, out=x)
    x += np.float32(1)
    return np.reciprocal(x, out=x)


def _with_bias(matrix: np.ndarray, bias: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
    """The matrices with the bias as a last row, and whether no logit of theirs needs scaling if no state is beyond ``most``.

    Entries without probability (a bias of minus infinity) get a bias whose exponential is 0.
    """
    both = np.concatenate([matrix, np.maximum(bias, -1e30)[..., None, :]], axis=-2)
    reach = np.abs(matrix).sum(axis=-2) * most
    return both, ((bias + reach).max(axis=-1) < PLAIN) & ((bias - reach).max(axis=-1) > -PLAIN)


def _outputs(weights: Weights, hidden: np.ndarray, word: np.ndarray, grads: Weights | None, weight: np.ndarray | None):
    """Log-probability (natural) of each word after each state (a column); with ``grads``, the gradients too.

    The softmax over classes and the softmax over the words of the true class; tokens of one class are
    worked on together. ``weight`` scales a token's loss.
    """
    order = np.argsort((word // CLASS_WORDS).astype(np.uint16), kind="stable")
    most = max(1.0, float(hidden.max()), -float(hidden.min()))
    # A last row of ones, for the bias.
    held = np.ones((HIDDEN + 1, len(word)), hidden.dtype)
    np.take(hidden, order, axis=1, out=held[:HIDDEN], mode="clip")
    word = word[order]
    weight = weight[order] if weight is not None else None
    cls, place = word // CLASS_WORDS, word % CLASS_WORDS
    logp = np.empty(len(word), hidden.dtype)
    d_hidden = np.empty_like(hidden) if grads is not None else None

    def softmax(own: slice, true: np.ndarray, matrix: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Log-probabilities of the true entries, and the gradient of the logits (a row for each entry)."""
        logits = matrix.T @ held[:, own]
        if not plain:
            logits -= logits.max(axis=0)
        at = np.arange(len(true))
        logp = logits[true, at]
        exp = np.exp(logits, out=logits)
        total = exp.sum(axis=0)
        logp -= np.log(total)
        if grads is None:
            return logp, None
        exp *= weight[own] / total
        exp[true, at] -= weight[own]
        return logp, exp

    matrix, plain = _with_bias(weights["to_class"], weights["class_bias"], most)
    for at in range(0, len(word), TOKENS):
        own = slice(at, at + TOKENS)
        logp[own], error = softmax(own, cls[own], matrix, plain)
        if grads is not None:
            grad = held[:, own] @ error.T
            grads["to_class"] += grad[:HIDDEN]
            grads["class_bias"] += grad[HIDDEN]
            np.matmul(weights["to_class"], error, out=d_hidden[:, own])
    sizes = class_sizes(weights)
    bounds = np.searchsorted(cls, np.arange(len(sizes) + 1))
    matrices, plain = _with_bias(weights["to_word"], weights["word_bias"], most)
    for c in np.flatnonzero((np.diff(bounds) > 0) & (sizes > 1)).tolist():
        matrix = matrices[c, :, : sizes[c]]
        for at in range(bounds[c], bounds[c + 1], TOKENS):
            own = slice(at, min(at + TOKENS, bounds[c + 1]))
            more, error = softmax(own, place[own], matrix, plain[c])
            logp[own] += more
            if grads is not None:
                grad = held[:, own] @ error.T
                grads["to_word"][c, :, : sizes[c]] += grad[:HIDDEN]
                grads["word_bias"][c, : sizes[c]] += grad[HIDDEN]
                d_hidden[:, own] += matrix[:HIDDEN] @ error
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return logp[back], d_hidden.take(back, axis=1) if d_hidden is not None else None


def _inputs(weights: Weights, embedded: np.ndarray) -> np.ndarray:
    """What embedded words (steps by lanes) put into the gates, steps by gates by lanes: each gate of a step lies together."""
    x = weights["input"].T @ embedded.swapaxes(1, 2)
    x += weights["input_bias"][:, None]
    return x


def _columns(steps: np.ndarray) -> np.ndarray:
    """Steps by hidden by lanes to hidden by tokens."""
    return np.ascontiguousarray(steps.swapaxes(0, 1)).reshape(steps.shape[1], -1)


def score(weights: Weights, docs: list[np.ndarray], end: int) -> np.ndarray:
    """The natural log-probability of each document (word numbers, the end included), all its words given those before."""
    if not docs:
        return np.zeros(0)
    before, word, begins, doc = timelines(docs, LANES, end)
    gates = np.ascontiguousarray(weights["state"].T)
    # Each word's part of the gates, once for the whole vocabulary.
    of_word = weights["embed"] @ weights["input"] + weights["input_bias"]
    state = np.zeros((HIDDEN, word.shape[1]), np.float32)
    out = np.zeros(len(docs))
    for at in range(0, len(word), STEPS):
        rows = slice(at, at + STEPS)
        # Lanes that are at their end drop out.
        alive = np.flatnonzero(doc[at] >= 0)
        if len(alive) < state.shape[1]:
            before, word, begins, doc = before[:, alive], word[:, alive], begins[:, alive], doc[:, alive]
            state = state[:, alive]
        hidden = np.empty((len(word[rows]), *state.shape), np.float32)
        x = np.empty((len(gates), state.shape[1]), np.float32)
        for t, fresh in enumerate(begins[rows]):
            if fresh.any():
                state = np.where(fresh, np.float32(0), state)
            x[:] = of_word[before[at + t]].T
            _step(weights, gates, x, state, hidden[t])
            state = hidden[t]
        real = doc[rows].ravel() >= 0
        columns, words, docs_at = _columns(hidden), word[rows].ravel(), doc[rows].ravel()
        if not real.all():
            columns, words, docs_at = columns[:, real], words[real], docs_at[real]
        logp, _ = _outputs(weights, columns, words, None, None)
        out += np.bincount(docs_at, logp, len(docs))
    return out


def _step(weights: Weights, gates: np.ndarray, x: np.ndarray, state: np.ndarray, hidden: np.ndarray):
    """A step of all lanes (columns), its state written to ``hidden``; returns what going back needs. ``x`` is used up."""
    own = gates @ state
    both = x[: 2 * HIDDEN]
    both += own[: 2 * HIDDEN]
    both = _sigmoid(both)
    update, reset = both[:HIDDEN], both[HIDDEN:]
    inner = own[2 * HIDDEN :]
    inner += weights["state_bias"][:, None]
    new = reset * inner
    new += x[2 * HIDDEN :]
    np.tanh(new, out=new)
    np.subtract(state, new, out=hidden)
    hidden *= update
    hidden += new
    return update, reset, inner, new


def gradients(weights: Weights, before, word, begins, real, state) -> tuple[float, Weights, np.ndarray]:
    """Mean loss of a window's real tokens, its gradients within the window, and the state (lanes by hidden) after it."""
    grads = {name: np.zeros_like(w) for name, w in weights.items()}
    gates = np.ascontiguousarray(weights["state"].T)
    embedded = weights["embed"][before]
    x = _inputs(weights, embedded)
    olds = np.empty((len(word), HIDDEN, word.shape[1]), x.dtype)
    hidden = np.empty_like(olds)
    state = state.T
    trace = []
    for t, fresh in enumerate(begins):
        olds[t] = state
        if fresh.any():
            olds[t][:, fresh] = 0
        trace.append(_step(weights, gates, x[t], olds[t], hidden[t]))
        state = hidden[t]
    weight = (real.ravel() / max(1, real.sum())).astype(np.float32)
    logp, d_flat = _outputs(weights, _columns(hidden), word.ravel(), grads, weight)
    d_hidden = d_flat.reshape(HIDDEN, *word.shape).swapaxes(0, 1)
    # Of the sums that go into the gates: d_x of those from the words, `through` of the state's part of the new state.
    d_x = np.empty_like(x)
    through = np.empty_like(olds)
    d_state = np.zeros_like(state)
    to_both, to_new = weights["state"][:, : 2 * HIDDEN], weights["state"][:, 2 * HIDDEN :]
    for t in range(len(word) - 1, -1, -1):
        old, (update, reset, inner, new) = olds[t], trace[t]
        d_update, d_reset, d_new = d_x[t, :HIDDEN], d_x[t, HIDDEN : 2 * HIDDEN], d_x[t, 2 * HIDDEN :]
        d_state += d_hidden[t]
        kept = d_state * update
        np.subtract(d_state, kept, out=d_state)
        np.multiply(new, new, out=d_new)
        np.subtract(1, d_new, out=d_new)
        d_new *= d_state
        np.subtract(old, new, out=d_update)
        d_update *= kept
        np.subtract(1, update, out=update)
        d_update *= update
        np.multiply(d_new, reset, out=through[t])
        np.multiply(through[t], inner, out=d_reset)
        np.subtract(1, reset, out=reset)
        d_reset *= reset
        d_state = to_both @ d_x[t, : 2 * HIDDEN]
        d_state += to_new @ through[t]
        d_state += kept
        if begins[t].any():
            d_state[:, begins[t]] = 0
    grads["state"][:, : 2 * HIDDEN] = (olds @ d_x[:, : 2 * HIDDEN].swapaxes(1, 2)).sum(axis=0)
    grads["state"][:, 2 * HIDDEN :] = (olds @ through.swapaxes(1, 2)).sum(axis=0)
    grads["state_bias"] += through.sum(axis=(0, 2))
    back = d_x.swapaxes(1, 2)
    grads["input"] = (embedded.swapaxes(1, 2) @ back).sum(axis=0)
    grads["input_bias"] = d_x.sum(axis=(0, 2))
    # Tokens of one word are added up.
    order = np.argsort(before.ravel().astype(np.uint16), kind="stable")
    words, starts = np.unique(before.ravel()[order], return_index=True)
    grads["embed"][words] = np.add.reduceat((back @ weights["input"].T).reshape(-1, EMBED)[order], starts, axis=0)
    return float(-(logp * weight).sum()), grads, state.T


def train(weights: Weights, docs: list[np.ndarray], end: int) -> Weights:
    """One pass of Adam over the documents by truncated backpropagation through time, at a rate that falls to nothing."""
    if not docs:
        return weights
    weights = {name: w.copy() for name, w in weights.items()}
    first = {name: np.zeros_like(w) for name, w in weights.items()}
    second = {name: np.zeros_like(w) for name, w in weights.items()}
    lanes = int(np.clip(sum(map(len, docs)) // (TRAIN_STEPS * UPDATES), *TRAIN_LANES))
    before, word, begins, doc = timelines(docs, lanes, end)
    full_rate = RATE * word.shape[1] ** 0.5
    state = np.zeros((word.shape[1], HIDDEN), np.float32)
    for step, at in enumerate(range(0, len(word), TRAIN_STEPS), 1):
        rows = slice(at, at + TRAIN_STEPS)
        alive = np.flatnonzero(doc[at] >= 0)
        if len(alive) < state.shape[0]:
            before, word, begins, doc = before[:, alive], word[:, alive], begins[:, alive], doc[:, alive]
            state = state[alive]
        _, grads, state = gradients(weights, before[rows], word[rows], begins[rows], doc[rows] >= 0, state)
        size = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        shrink = np.float32(min(1.0, CLIP / (size + 1e-9)))
        rate = np.float32(full_rate * (1 - at / len(begins)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step))
        for name, grad in grads.items():
            grad *= shrink
            first[name] *= np.float32(0.9)
            first[name] += np.float32(0.1) * grad
            second[name] *= np.float32(0.999)
            grad *= grad
            grad *= np.float32(0.001)
            second[name] += grad
            move = np.sqrt(second[name], out=grad)
            move += np.float32(1e-8)
            np.divide(first[name], move, out=move)
            move *= rate
            weights[name] -= move
    return weights
