"""Linear-chain conditional random fields over numbered features, in numpy batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def _pad(sequences: list[np.ndarray], fill: int) -> np.ndarray:
    out = np.full((len(sequences), max(map(len, sequences), default=0)), fill, np.int64)
    for row, s in zip(out, sequences):
        row[: len(s)] = s
    return out


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


@dataclass
class Chain:
    """emit[feature, label], step[from, to], start[label], stop[label]: log potentials.

    The last row of ``emit`` stands for no feature and stays zero.
    """

    emit: np.ndarray
    step: np.ndarray
    start: np.ndarray
    stop: np.ndarray

    @classmethod
    def zero(cls, labels: int, features: int) -> Chain:
        return cls(np.zeros((features + 1, labels)), np.zeros((labels, labels)), np.zeros(labels), np.zeros(labels))

    def emissions(self, features: np.ndarray) -> np.ndarray:
        """(types, labels) from (types, features) numbers."""
        return self.emit[features].sum(1)


def train(features: np.ndarray, sequences: list[np.ndarray], truth: list[np.ndarray], labels: int, n_features: int, steps: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> Chain:
    """Maximum likelihood by Adam on exact forward-backward gradients.

    ``features`` are feature numbers of each token type (``n_features``: none), ``sequences`` token types, ``truth`` their labels.
    """
    chain = Chain.zero(labels, n_features)
    if not sequences:
        return chain
    x, y = _pad(sequences, 0), _pad(truth, 0)
    size = np.array([len(s) for s in sequences])
    mask = np.arange(x.shape[1]) < size[:, None]
    n, t = x.shape
    rows = np.arange(n)
    total = mask.sum()
    onehot = np.eye(labels)
    parameters = [chain.emit, chain.step, chain.start, chain.stop]
    m, v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
    for it in range(1, steps + 1):
        e = chain.emissions(features)[x]
        alpha, beta = np.zeros((n, t, labels)), np.zeros((n, t, labels))
        alpha[:, 0] = chain.start + e[:, 0]
        for k in range(1, t):
            step = _logsumexp(alpha[:, k - 1, :, None] + chain.step, 1) + e[:, k]
            alpha[:, k] = np.where(mask[:, k, None], step, alpha[:, k - 1])
        beta[rows, size - 1] = chain.stop
        for k in range(t - 2, -1, -1):
            step = _logsumexp(chain.step + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where((k < size - 1)[:, None], step, beta[:, k])
        z = _logsumexp(alpha[rows, size - 1] + chain.stop, 1)
        p = np.exp(alpha + beta - z[:, None, None]) * mask[:, :, None]
        error = onehot[y] * mask[:, :, None] - p
        grad_e = np.zeros_like(chain.emit)
        by_type = np.stack([np.bincount(x[mask], error[mask][:, c], minlength=len(features)) for c in range(labels)], 1)
        for j in range(features.shape[1]):
            grad_e += np.stack([np.bincount(features[:, j], by_type[:, c], minlength=n_features + 1) for c in range(labels)], 1)
        grad_s = np.zeros_like(chain.step)
        for k in range(1, t):
            on = mask[:, k]
            pair = np.exp(alpha[on, k - 1, :, None] + chain.step + (e[on, k] + beta[on, k])[:, None, :] - z[on, None, None])
            np.add.at(grad_s, (y[on, k - 1], y[on, k]), 1)
            grad_s -= pair.sum(0)
        grad_0 = onehot[y[:, 0]].sum(0) - p[:, 0].sum(0)
        grad_1 = onehot[y[rows, size - 1]].sum(0) - p[rows, size - 1].sum(0)
        for i, (w, g) in enumerate(zip(parameters, (grad_e, grad_s, grad_0, grad_1))):
            g = g / total - penalty * w
            m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.99 * v[i] + 0.01 * g * g
            w += rate * (m[i] / (1 - 0.9**it)) / (np.sqrt(v[i] / (1 - 0.99**it)) + 1e-8)
        chain.emit[-1] = 0
    return chain


def viterbi(chain: Chain, emissions: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Best labels of sequences that lie in one flat array of emissions, in batches of like length."""
    out = np.zeros(len(emissions), np.int64)
    starts = np.cumsum(size) - size
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    # batches end where the padded area would pass a bound; one long sequence is a batch of its own
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b - a + 1) * size[order[b]] <= 400_000:
            b += 1
        own = order[a:b]
        t = int(size[own[-1]])
        n, first = size[own], starts[own]
        live = np.searchsorted(n, np.arange(t + 1), side="right").tolist()  # sequences from there on go on after k tokens
        score = chain.start + emissions[first]
        back = np.zeros((len(own), t, emissions.shape[1]), np.int8)
        for k in range(1, t):
            on = live[k]
            step = score[on:, :, None] + chain.step
            back[on:, k] = step.argmax(1)
            score[on:] = step.max(1) + emissions[first[on:] + k]
        last = (score + chain.stop).argmax(1)
        for k in range(t - 1, -1, -1):
            on = live[k]
            now = last[on:]
            out[first[on:] + k] = now
            last[on:] = back[on:, k][np.arange(len(now)), now]
        a = b
    return out


def two_label_marginals(chain: Chain, d: np.ndarray, offsets: np.ndarray, span: int = 64) -> np.ndarray:
    """Chance of label 1 at every token, exactly, for long sequences in one flat array.

    ``d`` is each token's emission of label 1 less that of label 0. Sequences are cut in
    spans; the 2x2 transfer matrices of all spans are multiplied out side by side, then the
    messages run over spans, then inside all spans side by side: the number of array steps
    follows the longest sequence divided by the span, the work follows the tokens.
    """
    size = np.diff(offsets)
    n_spans = -(-size // span)
    first = np.cumsum(n_spans) - n_spans
    total = int(n_spans.sum())
    if not total:
        return np.zeros(len(d))
    owner = np.repeat(np.arange(len(size)), n_spans)
    begin = offsets[:-1][owner] + (np.arange(total) - first[owner]) * span
    length = np.minimum(begin + span, offsets[1:][owner]) - begin
    at = begin[:, None] + np.arange(span)
    live = np.arange(span) < length[:, None]
    odds = np.where(live, np.exp(np.clip(d, -60, 60))[np.minimum(at, len(d) - 1)], 1.0).T.copy()  # (span, spans)
    a = np.exp(chain.step)

    def enter(k, v0, v1):  # one transition and token k, normalised; spans that have ended keep their message
        n0, n1 = v0 * a[0, 0] + v1 * a[1, 0], (v0 * a[0, 1] + v1 * a[1, 1]) * odds[k]
        z = 1 / (n0 + n1)
        on = live[:, k]
        return np.where(on, n0 * z, v0), np.where(on, n1 * z, v1), np.where(on, z, 1.0)

    def leave(k, w0, w1):
        x1 = w1 * odds[k]
        n0, n1 = a[0, 0] * w0 + a[0, 1] * x1, a[1, 0] * w0 + a[1, 1] * x1
        z = 1 / (n0 + n1)
        on = live[:, k]
        return np.where(on, n0 * z, w0), np.where(on, n1 * z, w1)

    # transfer of each span, from unit messages; log scales keep the two rows comparable
    rows = []
    for unit in ((1.0, 0.0), (0.0, 1.0)):
        v0, v1 = np.full(total, unit[0]), np.full(total, unit[1])
        log = np.zeros(total)
        for k in range(span):
            v0, v1, z = enter(k, v0, v1)
            log -= np.log(z)
        rows.append((v0, v1, log))
    top = np.maximum(rows[0][2], rows[1][2])
    s0, s1 = np.exp(rows[0][2] - top), np.exp(rows[1][2] - top)
    m00, m01, m10, m11 = rows[0][0] * s0, rows[0][1] * s0, rows[1][0] * s1, rows[1][1] * s1
    # messages into spans; before the first token stands a message that one transition turns into exp(start)
    start = np.linalg.solve(a.T, np.exp(chain.start)) if abs(np.linalg.det(a)) > 1e-12 else np.array([1.0, 1.0])
    f0, f1, b0, b1 = (np.empty(total) for _ in range(4))
    stop = np.exp(chain.stop)
    for k in range(int(n_spans.max())):
        on = n_spans > k
        i = first[on] + k
        if k == 0:
            f0[i], f1[i] = start
        else:
            p = i - 1
            x0, x1 = f0[p] * m00[p] + f1[p] * m10[p], f0[p] * m01[p] + f1[p] * m11[p]
            f0[i], f1[i] = x0 / (x0 + x1), x1 / (x0 + x1)
        j = (first + n_spans - 1)[on] - k
        if k == 0:
            b0[j], b1[j] = stop
        else:
            q = j + 1
            x0, x1 = m00[q] * b0[q] + m01[q] * b1[q], m10[q] * b0[q] + m11[q] * b1[q]
            b0[j], b1[j] = x0 / (x0 + x1), x1 / (x0 + x1)
    forward0, forward1 = np.empty((span, total)), np.empty((span, total))
    for k in range(span):
        f0, f1, _ = enter(k, f0, f1)
        forward0[k], forward1[k] = f0, f1
    p = np.empty((span, total))
    for k in range(span - 1, -1, -1):
        x1, x0 = forward1[k] * b1, forward0[k] * b0
        p[k] = x1 / (x0 + x1)
        b0, b1 = leave(k, b0, b1)
    out = np.zeros(len(d))
    out[at[live]] = p.T[live]
    return out
