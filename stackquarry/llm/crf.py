"""A linear-chain conditional random field over many sequences at once.

Sequences lie one after the other in flat arrays; ``starts`` and ``lengths`` say where. At
step t all sequences longer than t are advanced together, the longest first, so nothing
is padded. Scores are sums of log weights: one matrix from features to labels, one from
label to label, and one for the first label.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    weights: np.ndarray  # features x labels
    moves: np.ndarray  # label x next label
    first: np.ndarray  # label

    def scores(self, features: np.ndarray) -> np.ndarray:
        return features @ self.weights


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    most = values.max(axis, keepdims=True)
    return np.log(np.exp(values - most).sum(axis)) + most.squeeze(axis)


def _steps(lengths: np.ndarray):
    """Order of sequences, longest first, and how many are longer than each t."""
    order = np.argsort(-lengths, kind="stable")
    if not len(lengths):
        return order, np.empty(0, int)
    longer = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(lengths.max()), "right")
    return order, longer


def _forward(chain: Chain, scores, starts, longer):
    alpha = np.empty_like(scores)
    for t, n in enumerate(longer):
        at = starts[:n] + t
        alpha[at] = scores[at] + (
            chain.first if t == 0 else _log_sum(alpha[at - 1][:, :, None] + chain.moves, 1)
        )
    return alpha


def _backward(chain: Chain, scores, starts, longer):
    beta = np.zeros_like(scores)
    for t in range(len(longer) - 1, 0, -1):
        at = starts[: longer[t]] + t
        beta[at - 1] = _log_sum(chain.moves + (scores[at] + beta[at])[:, None, :], 2)
    return beta


def marginals(chain: Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Probability of each label at each place, by forward and backward sums."""
    order, longer = _steps(lengths)
    starts = (np.cumsum(lengths) - lengths)[order]
    both = _forward(chain, scores, starts, longer) + _backward(chain, scores, starts, longer)
    return np.exp(both - _log_sum(both, 1)[:, None]) if len(both) else both


def viterbi(chain: Chain, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The labels of the best path of each sequence; ties go to the smaller label."""
    order, longer = _steps(lengths)
    starts = (np.cumsum(lengths) - lengths)[order]
    best = np.empty_like(scores)
    back = np.zeros(scores.shape, np.int8)
    for t, n in enumerate(longer):
        at = starts[:n] + t
        if t == 0:
            best[at] = scores[at] + chain.first
        else:
            paths = best[at - 1][:, :, None] + chain.moves
            back[at] = paths.argmax(1)
            best[at] = scores[at] + paths.max(1)
    labels = np.zeros(len(scores), np.int8)
    for t in range(len(longer) - 1, -1, -1):
        n, here = longer[t], longer[t + 1] if t + 1 < len(longer) else 0
        last = starts[here:n] + t
        labels[last] = best[last].argmax(1)
        if t:
            at = starts[:n] + t
            labels[at - 1] = back[at, labels[at]]
    return labels


def train(
    features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, n_labels: int,
    penalty: float = 1e-3, rounds: int = 150, rate: float = 0.1, gain: float | None = None,
    sequence_weights: np.ndarray | None = None,
) -> Chain:
    """Weights that maximise the penalised mean log-likelihood of whole label sequences:
    full-batch gradient steps with momentum and per-weight scale. Deterministic. With ``gain``
    they end when ten rounds take less than that share off the loss. Sequences weigh alike
    where no weights are given."""
    n_features = features.shape[1]
    sizes = [n_features * n_labels, n_labels * n_labels, n_labels]
    cuts = np.cumsum(sizes)[:-1]
    weights = np.zeros(sum(sizes))
    slow, square = np.zeros_like(weights), np.zeros_like(weights)
    weigh = np.ones(len(labels)) if sequence_weights is None else np.repeat(sequence_weights, lengths)
    total = max(weigh.sum(), 1)
    order, longer = _steps(lengths)
    flat = np.cumsum(lengths) - lengths
    starts = flat[order]
    firsts = flat[lengths > 0]
    follows = np.ones(len(labels), bool)
    follows[firsts] = False
    follows = np.flatnonzero(follows)
    truth = np.eye(n_labels)[labels]
    seen_moves = np.zeros((n_labels, n_labels))
    np.add.at(seen_moves, (labels[follows - 1], labels[follows]), weigh[follows])

    def chain_of(flat_weights: np.ndarray) -> Chain:
        w, m, f = np.split(flat_weights, cuts)
        return Chain(w.reshape(n_features, n_labels), m.reshape(n_labels, n_labels), f)

    losses: list[float] = []
    for turn in range(1, rounds + 1):
        chain = chain_of(weights)
        scores = chain.scores(features)
        alpha, beta = _forward(chain, scores, starts, longer), _backward(chain, scores, starts, longer)
        norm = _log_sum(alpha + beta, 1)[:, None]
        if gain is not None:
            path = (scores[np.arange(len(labels)), labels] * weigh).sum() + (seen_moves * chain.moves).sum()
            path += ((chain.first[labels[firsts]] - norm[firsts, 0]) * weigh[firsts]).sum()
            losses.append(penalty / 2 * (weights**2).sum() - path / total)
            if turn > 10 and losses[-11] - losses[-1] < gain * losses[-11]:
                break
        likely = np.exp(alpha + beta - norm)
        pairs = (
            alpha[follows - 1][:, :, None] + chain.moves
            + (scores[follows] + beta[follows])[:, None, :] - norm[follows][:, :, None]
        )
        uphill = np.concatenate(
            [
                (features.T @ ((truth - likely) * weigh[:, None])).ravel(),
                (seen_moves - np.einsum("n,nab->ab", weigh[follows], np.exp(pairs))).ravel(),
                (weigh[firsts, None] * (truth[firsts] - likely[firsts])).sum(0),
            ]
        ) / total - penalty * weights
        slow = 0.9 * slow + 0.1 * uphill
        square = 0.99 * square + 0.01 * uphill**2
        step = (slow / (1 - 0.9**turn)) / (np.sqrt(square / (1 - 0.99**turn)) + 1e-8)
        weights = weights + rate * step / (1 + 3 * turn / rounds)
    return chain_of(weights)
