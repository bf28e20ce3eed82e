"""Character-level bidirectional LSTM with CRF transitions, in numpy.

`train` learns from windows with one tag per character; `emissions` gives tag scores of many
windows at once; `viterbi` decodes sequences of scores.  Tag 0 is outside; kind k has the
tags 2k+1 (first character) and 2k+2 (further ones).  An inner tag may only follow a tag of
its own kind: all other transitions are ruled out, learnt or not.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 130
OTHER_LETTER, OTHER = 128, 129
NEVER = -1e4


def symbols(text: str) -> np.ndarray:
    """Input symbol of every character: its code in ASCII, else one of two classes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    return np.where(codes < 128, codes, np.where(codes < 0x250, OTHER_LETTER, OTHER))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def start_weights(kinds: int, embed: int = 10, hidden: int = 14, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    tags = 2 * kinds + 1
    w = {"E": rng.normal(0, 0.3, (SYMBOLS, embed))}
    for d in "fb":
        w[f"W{d}"] = rng.normal(0, 0.25, (embed + hidden, 4 * hidden))
        w[f"B{d}"] = np.zeros(4 * hidden)
        w[f"B{d}"][hidden : 2 * hidden] = 1.0
    w["O"] = rng.normal(0, 0.25, (2 * hidden, tags))
    w["C"] = np.zeros(tags)
    w["T"] = np.zeros((tags, tags))
    return w


def allowed(tags: int) -> np.ndarray:
    """0 where a transition may happen, NEVER elsewhere."""
    out = np.zeros((tags, tags))
    for inner in range(2, tags, 2):
        out[:, inner] = NEVER
        out[inner - 1, inner] = out[inner, inner] = 0.0
    return out


def _run(w: dict, d: str, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states of one direction; x is (time, batch) of symbols."""
    steps, size = x.shape
    hidden = w[f"B{d}"].shape[0] // 4
    table = w["E"] @ w[f"W{d}"][: w["E"].shape[1]] + w[f"B{d}"]
    back = w[f"W{d}"][w["E"].shape[1] :]
    h, c = np.zeros((size, hidden)), np.zeros((size, hidden))
    out, memory = np.empty((steps, size, hidden)), []
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        z = table[x[t]] + h @ back
        gates = _sigmoid(z[:, : 3 * hidden])
        i, f, o = gates[:, :hidden], gates[:, hidden : 2 * hidden], gates[:, 2 * hidden :]
        g = np.tanh(z[:, 3 * hidden :])
        before = (h, c)
        c = f * c + i * g
        squashed = np.tanh(c)
        h = o * squashed
        out[t] = h
        if keep:
            memory.append((t, i, f, o, g, squashed, *before))
    return out, memory


def emissions(w: dict, x: np.ndarray) -> np.ndarray:
    """(time, batch, tag) scores of (time, batch) symbols."""
    states = np.concatenate([_run(w, d, x, False)[0] for d in "fb"], axis=2)
    return states @ w["O"] + w["C"]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def loss_and_gradient(w: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Negative log-likelihood per character of the tags y under the CRF, and its gradient."""
    steps, size = x.shape
    embed = w["E"].shape[1]
    runs = {d: _run(w, d, x, True) for d in "fb"}
    states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
    score = states @ w["O"] + w["C"]
    move = w["T"] + allowed(score.shape[2])
    ahead, behind = np.empty_like(score), np.zeros_like(score)
    ahead[0] = score[0]
    for t in range(1, steps):
        ahead[t] = _logsum(ahead[t - 1][:, :, None] + move[None], 1) + score[t]
    for t in range(steps - 2, -1, -1):
        behind[t] = _logsum(move[None] + (score[t + 1] + behind[t + 1])[:, None, :], 2)
    total = _logsum(ahead[-1], 1)
    rows = np.arange(size)
    gold = sum(score[t, rows, y[t]] for t in range(steps)) + sum(move[y[t - 1], y[t]] for t in range(1, steps))
    grad_score = np.exp(ahead + behind - total[None, :, None])
    grad_move = np.zeros_like(w["T"])
    for t in range(1, steps):
        pair = ahead[t - 1][:, :, None] + move[None] + (score[t] + behind[t])[:, None, :] - total[:, None, None]
        grad_move += np.exp(pair).sum(axis=0)
        np.add.at(grad_move, (y[t - 1], y[t]), -1.0)
    for t in range(steps):
        grad_score[t, rows, y[t]] -= 1.0
    scale = 1.0 / (steps * size)
    grad_score *= scale
    flat = grad_score.reshape(-1, score.shape[2])
    grads = {"T": grad_move * scale, "O": states.reshape(len(flat), -1).T @ flat, "C": flat.sum(axis=0),
             "E": np.zeros_like(w["E"])}
    from_out = grad_score @ w["O"].T
    hidden = from_out.shape[2] // 2
    for d, part in (("f", slice(0, hidden)), ("b", slice(hidden, None))):
        weights = w[f"W{d}"]
        grads[f"W{d}"], grads[f"B{d}"] = np.zeros_like(weights), np.zeros_like(w[f"B{d}"])
        dh, dc = np.zeros((size, hidden)), np.zeros((size, hidden))
        for t, i, f, o, g, squashed, h0, c0 in reversed(runs[d][1]):
            dh = dh + from_out[t, :, part]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * g * i * (1 - i), dc * c0 * f * (1 - f), dh * squashed * o * (1 - o),
                                 dc * i * (1 - g**2)], axis=1)
            dc = dc * f
            inputs = np.concatenate([w["E"][x[t]], h0], axis=1)
            grads[f"W{d}"] += inputs.T @ dz
            grads[f"B{d}"] += dz.sum(axis=0)
            back = dz @ weights.T
            np.add.at(grads["E"], x[t], back[:, :embed])
            dh = back[:, embed:]
    return float((total - gold).mean() / steps), grads


def train(x: np.ndarray, y: np.ndarray, kinds: int, epochs: int = 8, batch: int = 64, rate: float = 0.02,
          seed: int = 7) -> dict[str, np.ndarray]:
    """Weights after Adam, its rate falling to 0, over (window, time) symbols and tags; the same input gives the same weights."""
    w = start_weights(kinds, seed=seed)
    mean, square = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    rng, step, steps = np.random.default_rng(seed), 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            _, grads = loss_and_gradient(w, x[own].T, y[own].T)
            step += 1
            for k, g in grads.items():
                g = np.clip(g, -1, 1)
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.99 * square[k] + 0.01 * g * g
                w[k] = w[k] - rate * (1 - (step - 1) / steps) * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-8)
    return w


def viterbi(w: dict, score: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(batch, time) best tags of padded (batch, time, tag) scores."""
    size, steps, tags = score.shape
    move = w["T"] + allowed(tags)
    best = score[:, 0] + np.where(np.arange(tags) % 2 + (np.arange(tags) == 0) > 0, 0, NEVER)
    come = np.zeros((size, steps, tags), np.int64)
    for t in range(1, steps):
        ways = best[:, :, None] + move[None]
        come[:, t] = ways.argmax(axis=1)
        going = t < lengths
        best = np.where(going[:, None], ways.max(axis=1) + score[:, t], best)
        come[:, t] = np.where(going[:, None], come[:, t], np.arange(tags))
    out = np.zeros((size, steps), np.int64)
    out[:, -1] = best.argmax(axis=1)
    rows = np.arange(size)
    for t in range(steps - 1, 0, -1):
        out[:, t - 1] = come[rows, t, out[:, t]]
    return out


def margin(w: dict, score: np.ndarray, tags: np.ndarray, start: int, end: int) -> float:
    """How far the path `tags` over (time, tag) scores exceeds the same path with tag 0 in start..end."""
    first, last = max(start - 1, 0), min(end + 1, len(tags))
    other = tags.copy()
    other[start:end] = 0
    # a span right behind keeps its own first tag, so both paths are allowed
    own, rest = (score[np.arange(start, end), p[start:end]].sum() + w["T"][p[first : last - 1], p[first + 1 : last]].sum() for p in (tags, other))
    return float(own - rest)
