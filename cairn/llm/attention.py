"""A causal self-attention model over subword ids, in numpy.

One attention layer over windows of ``WINDOW`` ids; the next id is predicted as
its class (softmax over ``CLASSES``) times its share of the class.  Windows of a
text start every ``STRIDE`` ids: the first ``WINDOW - STRIDE`` places of every
window but the first are context only, so each id is scored exactly once.
"""

from __future__ import annotations

import numpy as np

WINDOW, STRIDE = 32, 16
DIM, CLASSES, OWN = 32, 128, 40
PRIOR = 8.0
START = 49_406  # stands before every text
VOCABULARY = 49_408
#: Buckets of neighbours on either side, by which ids are put into classes.
SPREAD = 48
BUCKET = ((np.arange(VOCABULARY, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(SPREAD)).astype(np.int64)
_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))
_SCALE = np.float32(DIM**-0.5)
#: Windows scored and trained on at once, and where the classes of each of their places start.
AT_ONCE, TRAIN_AT_ONCE = 64, 64
_FIRST = np.arange(AT_ONCE * WINDOW) * CLASSES
_ONES = np.ones(CLASSES, np.float32)
SMALL = ("place", "query", "key", "value", "from_past", "from_last", "bias")


def _product_of_rows(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a.T @ b`` over the rows of all blocks of ``a, b``: (blocks, rows, columns)."""
    return (a.transpose(0, 2, 1) @ b).sum(axis=0)


def _sums_of_exp(z: np.ndarray) -> np.ndarray:
    """Exponentials in place, and their sums by row."""
    with np.errstate(over="ignore"):
        np.exp(z, out=z)
    return z @ _ONES


def _far(sums: np.ndarray) -> bool:
    """Whether sums of exponentials are beyond what single precision holds well; the largest values are then to be taken off first."""
    return not (sums.min() > 1e-30 and sums.max() < 1e30)


def sums_by_id(ids: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that occur, ascending, and the sum of each one's rows (single precision, an even number of columns)."""
    who = np.flatnonzero(np.bincount(ids, minlength=VOCABULARY))
    half = rows.shape[1] // 2
    place = np.zeros(VOCABULARY, np.int64)
    place[who] = np.arange(len(who)) * half
    out = np.zeros(len(who) * half, np.complex64)  # two columns at once
    np.add.at(out, (place[ids][:, None] + np.arange(half)).ravel(), np.ascontiguousarray(rows).view(np.complex64).ravel())
    return who, out.view(np.float32).reshape(len(who), -1)


def cut_windows(counts: np.ndarray, stride: int = STRIDE):
    """For texts of ``counts`` ids: window starts, the text of each, and the windows' numbers in their text."""
    n = 1 + np.maximum(0, -(-(counts - WINDOW) // stride))
    text = np.repeat(np.arange(len(counts)), n)
    number = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    first = (np.cumsum(counts) - counts)[text]
    return first + number * stride, text, number


def inputs_of(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each id's predecessor, ``START`` at the start of a text."""
    x = np.empty_like(ids)
    x[1:] = ids[:-1]
    x[np.cumsum(counts) - counts] = START
    return x


def id_pairs(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each id and the one before it as one 32-bit number."""
    return inputs_of(ids, counts).astype(np.uint32) * np.uint32(VOCABULARY) + ids


def neighbour_cells(pairs: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of a (VOCABULARY, 2 * SPREAD) table that pairs of ids count in, and how often: the bucket of the id before, and of the id after."""
    before, ids = np.divmod(pairs.astype(np.int64), VOCABULARY)
    inner = before != START
    cells = np.concatenate([ids * (2 * SPREAD) + BUCKET[before], before[inner] * (2 * SPREAD) + SPREAD + BUCKET[ids[inner]]])
    return cells, np.concatenate([times, times[inner]])


def learn_classes(seen: np.ndarray, seed: int = 3) -> np.ndarray:
    """A class for every id from the counts of its neighbours: the most frequent have their own, others are grouped."""
    rng = np.random.default_rng(seed)
    uni = seen[:, :SPREAD].sum(axis=1)
    used = np.nonzero(uni)[0]
    order = used[np.argsort(-uni[used], kind="stable")]
    out = np.full(VOCABULARY, CLASSES - 1, np.int64)
    out[order[:OWN]] = np.arange(min(OWN, len(order)))
    rest = order[OWN:]
    k = CLASSES - OWN - 1
    if len(rest) > k:
        points = seen[rest].astype(np.float32)
        points = np.sqrt(points / points.sum(axis=1, keepdims=True))
        weight = np.sqrt(uni[rest])
        centre = points[np.sort(rng.choice(min(len(rest), 8 * k), k, replace=False))]
        for _ in range(8):
            near = np.argmax(points @ centre.T - 0.5 * (centre**2).sum(axis=1), axis=1)
            for c in range(k):
                mine = near == c
                if mine.any():
                    centre[c] = np.average(points[mine], axis=0, weights=weight[mine])
        out[rest] = OWN + near
    else:
        out[rest] = OWN + np.arange(len(rest))
    return out


class Model:
    def __init__(self, classes: np.ndarray, seed: int = 1):
        rng = np.random.default_rng(seed)

        def normal(*shape, scale=0.1):
            return rng.normal(0, scale, shape).astype(np.float32)

        self.classes = classes.astype(np.int64)
        self.embed, self.place = normal(VOCABULARY, DIM, scale=0.3), normal(WINDOW, DIM)
        self.query, self.key, self.value = (normal(DIM, DIM, scale=0.3) for _ in range(3))
        self.from_past, self.from_last, self.bias = normal(DIM, CLASSES), normal(DIM, CLASSES), np.zeros(CLASSES, np.float32)
        # squared gradients so far, by which steps are scaled; they go on where training does
        self.sums = {n: np.full_like(getattr(self, n), 1e-6) for n in SMALL}
        self.row_sums = np.full(VOCABULARY, 1e-6, np.float32)
        self.share = None

    def copy(self) -> Model:
        """A model that can be trained on without changing this one."""
        out = Model.__new__(Model)
        out.classes, out.share = self.classes, self.share
        out.embed, out.row_sums = self.embed.copy(), self.row_sums.copy()
        out.sums = {n: v.copy() for n, v in self.sums.items()}
        for n in SMALL:
            setattr(out, n, getattr(self, n).copy())
        return out

    def set_shares(self, pairs: np.ndarray) -> None:
        """Log10 shares of ids inside their classes, given the class before them, by id and class.

        ``pairs``: counts by class of the id before and id.  A share is smoothed
        towards the id's share of its class in all places, and that by one
        added to every count.
        """
        uni = pairs.sum(axis=0) + 1.0
        alone = uni / np.bincount(self.classes, weights=uni, minlength=CLASSES)[self.classes]
        self.share = np.empty((VOCABULARY, CLASSES), np.float32)  # what one id needs lies together
        for c in range(CLASSES):
            total = np.bincount(self.classes, weights=pairs[c], minlength=CLASSES)
            self.share[:, c] = np.log10((pairs[c] + PRIOR * alone) / (total[self.classes] + PRIOR))

    def gradients(self, x, y, valid, total=None):
        """Mean loss over ``valid`` (or what they add to the mean over ``total`` places) and the gradients of all tables; ``x, y``: (windows, WINDOW)."""
        windows, n = len(x), len(x) * WINDOW
        told = np.empty((windows, WINDOW, 2 * DIM + 1), np.float32)  # what the past tells, the last id, and the bias's one
        last = np.take(self.embed, x, axis=0)
        told[:, :, DIM:-1], told[:, :, -1] = last, 1
        e = np.add(last, self.place, out=last)
        # products go window by window: small ones with untransposed operands are the fast ones
        into = np.concatenate([self.query * _SCALE, self.key, self.value], axis=1)
        qkv = e @ into
        q, k, v = qkv[:, :, :DIM], qkv[:, :, DIM : 2 * DIM], qkv[:, :, 2 * DIM :]
        turned = np.empty((windows, DIM, WINDOW), np.float32)
        turned[:] = k.transpose(0, 2, 1)
        att = q @ turned
        if att.max() > 60:
            np.minimum(att, 60, out=att)
        np.exp(att, out=att)
        att *= _CAUSAL
        att *= 1 / (att @ _ONES[:WINDOW])[:, :, None]
        np.matmul(att, v, out=told[:, :, :DIM])
        out = np.concatenate([self.from_past, self.from_last, self.bias[None]])
        z = told @ out
        flat = z.reshape(n, CLASSES)
        sums = _sums_of_exp(flat)
        if _far(sums):
            np.matmul(told, out, out=z)
            z -= z.max(axis=2, keepdims=True)
            sums = _sums_of_exp(flat)
        at = np.arange(n) * CLASSES + self.classes[y].ravel()
        weight = (valid.ravel() / max(1, valid.sum() if total is None else total)).astype(np.float32)
        scale, cells = 1 / sums, z.reshape(-1)
        loss = -(np.log(np.maximum(cells[at] * scale, 1e-12)) * weight).sum()
        scale *= weight
        flat *= scale[:, None]
        cells[at] -= weight
        pair = 2 * WINDOW if windows % 2 == 0 else WINDOW
        own = _product_of_rows(z.reshape(-1, pair, CLASSES), told.reshape(-1, pair, 2 * DIM + 1)).T
        g = {"from_past": own[:DIM], "from_last": own[DIM:-1], "bias": own[-1]}
        back = z @ np.ascontiguousarray(out[:-1].T)
        da = back[:, :, :DIM]
        dqkv = np.empty_like(qkv)
        np.matmul(att.transpose(0, 2, 1), da, out=dqkv[:, :, 2 * DIM :])
        turned[:] = v.transpose(0, 2, 1)
        ds = da @ turned
        ds -= np.einsum("wij,wij->wi", ds, att)[..., None]
        ds *= att
        np.matmul(ds, k, out=dqkv[:, :, :DIM])
        np.matmul(ds.transpose(0, 2, 1), q, out=dqkv[:, :, DIM : 2 * DIM])
        own = _product_of_rows(dqkv.reshape(-1, pair, 3 * DIM), e.reshape(-1, pair, DIM)).T
        g["query"], g["key"], g["value"] = own[:, :DIM] * _SCALE, own[:, DIM : 2 * DIM], own[:, 2 * DIM :]
        de = dqkv @ np.ascontiguousarray(into.T)
        g["place"] = (np.ones(windows, np.float32) @ de.reshape(windows, -1)).reshape(WINDOW, DIM)
        de += back[:, :, DIM:]
        return loss, g, de

    def _gradients_in_parts(self, x, y, valid):
        """``gradients``, a few windows at a time, so that what lies between stays near the processor."""
        loss, total, n = 0.0, None, max(1, valid.sum())
        rows = np.empty((len(x), WINDOW, DIM), np.float32)
        for w in range(0, len(x), TRAIN_AT_ONCE):
            part = slice(w, w + TRAIN_AT_ONCE)
            own, g, rows[part] = self.gradients(x[part], y[part], valid[part], n)
            loss += float(own)
            total = {k: v + total[k] for k, v in g.items()} if total else g
        return loss, total, rows

    def train(self, ids, counts, rate=0.1, epochs=2, batch=128, seed=2) -> float:
        """Adagrad over windows of some texts, one beside the other; returns the last mean loss (natural log, classes)."""
        if not len(ids):
            return 0.0
        starts, text, number = cut_windows(counts, WINDOW)
        length = np.minimum(WINDOW, counts[text] - number * WINDOW)
        x = inputs_of(ids, counts)
        rng, losses = np.random.default_rng(seed), []
        step = np.arange(WINDOW)
        for epoch in range(epochs):
            now = np.float32(rate * (1 - 0.7 * epoch / max(1, epochs)))
            for b in np.array_split(rng.permutation(len(starts)), max(1, len(starts) // batch)):
                valid = step < length[b][:, None]
                at = np.minimum(starts[b][:, None] + step, len(ids) - 1)
                own = x[at]
                loss, g, de = self._gradients_in_parts(own, ids[at], valid)
                losses.append(loss)
                for n in SMALL:
                    self.sums[n] += g[n] ** 2
                    setattr(self, n, getattr(self, n) - now * g[n] / np.sqrt(self.sums[n]))
                who, grad = sums_by_id(own.ravel(), de.reshape(-1, DIM))
                self.row_sums[who] += (grad**2).mean(axis=1)
                self.embed[who] -= 3 * now * grad / np.sqrt(self.row_sums[who])[:, None]
        return float(np.mean(losses[-100:]))

    def freeze(self):
        """Tables for scoring: projections of every id; the values carry a column of ones for the weights' sum."""
        one = np.ones((VOCABULARY, 1), np.float32)
        self.rows = np.concatenate([self.embed @ self.query * _SCALE, self.embed @ self.key, self.embed @ self.value, one], axis=1)
        self.row_place = np.concatenate([self.place @ self.query * _SCALE, self.place @ self.key, self.place @ self.value, one[:WINDOW] * 0], axis=1)
        self.last = self.embed @ self.from_last + self.bias
        return self

    def _log_classes(self, own: np.ndarray, goal: np.ndarray, skip: int) -> np.ndarray:
        """Natural logs of the goal classes' probabilities after each place of windows ``own`` from ``skip`` on."""
        n, m = len(own), WINDOW - skip
        qkv = np.take(self.rows, own, axis=0)
        qkv += self.row_place
        s = qkv[:, skip:, :DIM] @ qkv[:, :, DIM : 2 * DIM].transpose(0, 2, 1)
        if s.max() > 80:
            np.minimum(s, 80, out=s)
        np.exp(s, out=s)
        s *= _CAUSAL[skip:]  # places before ``skip`` are seen by all
        a = (s @ qkv[:, :, 2 * DIM :]).reshape(n * m, DIM + 1)
        a = a[:, :DIM] / a[:, DIM:]
        z = a @ self.from_past
        z += np.take(self.last, own[:, skip:].ravel(), axis=0)
        hit = z.ravel()[_FIRST[: n * m] + goal.ravel()]
        sums = _sums_of_exp(z)
        if not _far(sums):
            return hit - np.log(sums)
        z = a @ self.from_past + self.last[own[:, skip:].ravel()]
        most = z.max(axis=1)
        return hit - most - np.log(_sums_of_exp(z - most[:, None]))

    def log_probs(self, ids: np.ndarray, counts: np.ndarray, at_once: int = AT_ONCE) -> np.ndarray:
        """Log10 probability of every id of some texts, each scored once in one window."""
        if not hasattr(self, "rows"):
            self.freeze()
        starts, text, number = cut_windows(counts)
        length = np.minimum(WINDOW, counts[text] - number * STRIDE)
        x, goal = inputs_of(ids, counts), self.classes[ids]
        out = self.share.ravel()[ids.astype(np.int64) * CLASSES + self.classes[x]]
        x = np.lib.stride_tricks.sliding_window_view(np.pad(x, (0, WINDOW)), WINDOW)
        goal = np.lib.stride_tricks.sliding_window_view(np.pad(goal, (0, WINDOW)), WINDOW)
        step, scale = np.arange(WINDOW), np.float32(1 / np.log(10))
        for skip, group in ((0, np.nonzero(number == 0)[0]), (WINDOW - STRIDE, np.nonzero(number > 0)[0])):
            for w in range(0, len(group), at_once):
                mine = group[w : w + at_once]
                logs = self._log_classes(x[starts[mine]], goal[starts[mine], skip:], skip).reshape(len(mine), -1)
                inside = step[skip:] < length[mine, None]
                out[(starts[mine, None] + step[skip:])[inside]] += logs[inside] * scale
        return out

    def scores(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log10 probability of every text."""
        sums = np.concatenate([[0.0], np.cumsum(self.log_probs(ids, counts), dtype=np.float64)])
        ends = np.cumsum(counts)
        return sums[ends] - sums[ends - counts]
