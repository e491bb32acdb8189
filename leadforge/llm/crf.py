"""A linear-chain conditional random field over tags begin, inside, outside, in numpy.

A token has one number per feature template; its score for a tag is the sum of
the weights of these numbers. Tags of neighbours score by a 3 x 3 table, the
first tag of a text by a start row. ``inside`` may only follow ``begin`` or ``inside``, and
only where the token stands right behind the one before.

Training maximises the penalised likelihood of tagged windows of equal length
by Adam; a batch's forward and backward passes step over the places of all
windows at once. Decoding multiplies the tokens' 3 x 3 tables in max-plus
algebra, in blocks side by side and then over the blocks' products, so texts of
any number and length decode together and exactly.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BEGIN, INSIDE, OUTSIDE = 0, 1, 2
TAGS = 3
NEVER = -1e9
BLOCK = 32
EPOCHS = 8
BATCH = 256
RATE = 0.05
RIDGE = 1e-4


@dataclass
class Crf:
    weights: np.ndarray      # feature number x tag
    follow: np.ndarray       # tag x next tag
    start: np.ndarray        # first tag

    def scores(self, features: np.ndarray) -> np.ndarray:
        """Tag scores of tokens; ``features`` is template x token."""
        wide = np.zeros((len(self.weights), 4), dtype=self.weights.dtype)  # a row of four is read in one go
        wide[:, :TAGS] = self.weights
        out = np.zeros((features.shape[1], 4), dtype=wide.dtype)
        row = np.empty_like(out)
        for numbers in features:
            out += np.take(wide, numbers, axis=0, out=row, mode="clip")
        return out[:, :TAGS]

    def compact(self) -> Crf:
        """The same field in single precision, as it travels to the tasks."""
        return Crf(*[x.astype(np.float32) for x in (self.weights, self.follow, self.start)])

    def tables(self, features: np.ndarray, first: np.ndarray, glued: np.ndarray) -> np.ndarray:
        """token x tag before x tag: what a token adds to a path."""
        score = self.scores(features)
        table = score[:, None, :] + self.follow
        table[:, OUTSIDE, INSIDE] = NEVER
        table[~glued, :, INSIDE] = NEVER
        table[first] = (score[first] + self.start)[:, None, :]
        table[first, :, INSIDE] = NEVER
        return table

    def decode(self, features: np.ndarray, first: np.ndarray, glued: np.ndarray) -> np.ndarray:
        """The best tags of all texts; ``first`` marks each text's first token."""
        return best_path(self.tables(features, first, glued))


def best_path(tables: np.ndarray) -> np.ndarray:
    """States of the best path through a chain of tables, where a state before the first table costs nothing."""
    n = len(tables)
    if not n:
        return np.zeros(0, dtype=np.int64)
    if n <= BLOCK:
        value, back = tables[0].max(axis=0), []
        for table in tables[1:]:
            reach = value[:, None] + table
            back.append(reach.argmax(axis=0))
            value = reach.max(axis=0)
        state = [int(value.argmax())]
        for b in reversed(back):
            state.append(int(b[state[-1]]))
        return np.array(state[::-1])
    blocks = -(-n // BLOCK)
    whole = np.full((blocks * BLOCK, TAGS, TAGS), NEVER * 4, dtype=tables.dtype)
    whole[:n] = tables
    whole[n:, range(TAGS), range(TAGS)] = 0
    whole = np.ascontiguousarray(whole.reshape(blocks, BLOCK, TAGS, TAGS).transpose(1, 2, 3, 0))  # blocks side by side
    value = whole[0]                                       # state before the block, state now, block
    back = np.zeros((BLOCK, TAGS, TAGS, blocks), dtype=np.int8)
    for t in range(1, BLOCK):
        step = whole[t]
        a, b, c = (value[:, p, None, :] + step[None, p, :, :] for p in range(TAGS))
        later = (b > a).astype(np.int8)
        np.maximum(a, b, out=a)
        later[c > a] = 2
        value = np.maximum(a, c)
        back[t] = later
    ends = best_path(np.ascontiguousarray(value.transpose(2, 0, 1)))
    before = np.concatenate([[int(value[:, ends[0], 0].argmax())], ends[:-1]])
    out = np.empty((blocks, BLOCK), dtype=np.int64)
    at, state = np.arange(blocks), ends
    for t in range(BLOCK - 1, -1, -1):
        out[:, t] = state
        state = back[t, before, state, at]
    return out.reshape(-1)[:n]


def _sum_exp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def gradient(model: Crf, features: np.ndarray, tags: np.ndarray, glued: np.ndarray, used: np.ndarray):
    """(mean negative log-likelihood, its gradients) of windows.

    ``features``: template x window x place; ``tags``, ``glued``, ``used``: window x place. Used places come first.
    """
    templates, windows, places = features.shape
    table = model.tables(features.reshape(templates, -1), np.zeros(windows * places, dtype=bool), glued.reshape(-1))
    table = table.reshape(windows, places, TAGS, TAGS)
    score = model.scores(features.reshape(templates, -1)).reshape(windows, places, TAGS)
    alpha = np.empty((windows, places, TAGS))
    alpha[:, 0] = score[:, 0] + model.start
    alpha[:, 0, INSIDE] = NEVER
    for t in range(1, places):
        alpha[:, t] = np.where(used[:, t, None], _sum_exp(alpha[:, t - 1, :, None] + table[:, t], 1), alpha[:, t - 1])
    total = _sum_exp(alpha[:, -1], 1)
    beta = np.zeros((windows, places, TAGS))
    pairs = np.zeros((TAGS, TAGS))
    truth_pairs = np.zeros((TAGS, TAGS))
    for t in range(places - 2, -1, -1):
        on = used[:, t + 1]
        onward = table[:, t + 1] + beta[:, t + 1, None, :]
        beta[:, t] = np.where(on[:, None], _sum_exp(onward, 2), beta[:, t + 1])
        pairs += np.exp(alpha[on, t, :, None] + onward[on] - total[on, None, None]).sum(axis=0)
        np.add.at(truth_pairs, (tags[on, t], tags[on, t + 1]), 1)
    marginal = np.where(used[:, :, None], np.exp(alpha + beta - total[:, None, None]), 0)
    truth = np.where(used[:, :, None], np.eye(TAGS)[tags], 0)
    path = np.take_along_axis(score, tags[:, :, None], 2)[:, :, 0] * used
    loss = (total - path.sum(axis=1) - model.start[tags[:, 0]]).sum() - (truth_pairs * model.follow).sum()
    error = (marginal - truth).reshape(-1, TAGS) / windows
    size = len(model.weights)
    weights = np.zeros((size, TAGS))
    for numbers in features.reshape(templates, -1):
        for tag in range(TAGS):
            weights[:, tag] += np.bincount(numbers, error[:, tag], minlength=size)
    return loss / windows, weights, (pairs - truth_pairs) / windows, (marginal[:, 0] - truth[:, 0]).sum(axis=0) / windows


def train(features: np.ndarray, tags: np.ndarray, glued: np.ndarray, used: np.ndarray, size: int, seed: int = 11,
          epochs: int = EPOCHS) -> Crf:
    """Fit by Adam over shuffled batches of windows."""
    rng = np.random.default_rng(seed)
    values = [np.zeros((size, TAGS)), np.zeros((TAGS, TAGS)), np.zeros(TAGS)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    turn = 0
    for epoch in range(epochs):
        order = rng.permutation(features.shape[1])
        for lo in range(0, len(order), BATCH):
            at = order[lo:lo + BATCH]
            _, *slopes = gradient(Crf(*values), features[:, at], tags[at], glued[at], used[at])
            turn += 1
            rate = RATE * (1 - epoch / epochs)
            for v, g, m, s in zip(values, slopes, first, second):
                g = g + RIDGE * v
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= rate * (m / (1 - 0.9 ** turn)) / (np.sqrt(s / (1 - 0.99 ** turn)) + 1e-6)
    return Crf(*values)
