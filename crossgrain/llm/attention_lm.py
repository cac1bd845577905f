"""A causal self-attention language model over subword ids, in numpy.

One layer with one head reads windows of WINDOW ids. Windows overlap: each brings CONTEXT ids that were scored in
the window before, and scores the next STRIDE, so that every id is scored once, and all windows of a batch
pass through masked attention together. The output is factored: attention predicts a class of ids (the frequent
ids are classes of their own, the others are clustered by what stands ahead of them); within its class an id's chance is
its smoothed share of what followed the class of the id before (START for a text's first id), over word borders too,
counted over all training documents. The weights start from Adam on windows drawn from all training documents; then many
learners go on from there, each on every window of its own part of the documents, and their weights are averaged.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

VOCABULARY, START, END = 49408, 49406, 49407
WINDOW, CONTEXT = 32, 8
STRIDE = WINDOW - CONTEXT
#: Sizes: of the vectors, of the hidden layer, ids with vectors of their own, ids with classes of their own, classes.
WIDTH, HIDDEN, INPUTS, ALONE, CLASSES = 24, 48, 4096, 128, 192
#: The start of training: windows, drawn evenly from all training documents, steps, windows in a step, step size.
DRAWN, STEPS, BATCH, RATE = 100_000, 2500, 128, 4e-3
#: Then over all windows of all training documents: turns that they are dealt to, after each of which weights are averaged; step size.
ROUNDS, LATER_RATE = 3, 2e-3
#: Rounds of the clustering of ids, and what the ids' common neighbours weigh in a cluster.
CLUSTER_ROUNDS, CLUSTER_PRIOR = 12, 5.0
#: What a class's own shares weigh against those after a class.
PRIOR = 10.0
#: Windows that are scored at once, and learned from (thirds of a step).
AT_ONCE, LEARNT_AT_ONCE = 32, 43
NONE = -1e9


@dataclass
class Model:
    """Weights, the ids' input rows and classes, and log10 chances within classes.

    column: the ids' columns in after, which holds log10 chances by the class before; -1 for ids without counts,
    whose chances are within + missing.
    """

    row: np.ndarray
    cls: np.ndarray
    within: np.ndarray = None
    column: np.ndarray = None
    after: np.ndarray = None
    missing: np.ndarray = None
    w: dict[str, np.ndarray] = field(default_factory=dict)
    fast: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of_counts(cls, counts: np.ndarray, seed: int = 1) -> Model:
        """Untrained, with classes by id counts, and with no counts of what follows a class."""
        order = np.argsort(-counts, kind="stable")
        place = np.empty(VOCABULARY, np.int64)
        place[order] = np.arange(VOCABULARY)
        rest = CLASSES - ALONE
        # the other ids are dealt by rank to classes of about equal counts
        share = np.cumsum(counts[order[ALONE:]] + 1.0)
        later = ALONE + np.minimum(rest - 1, (share / share[-1] * rest).astype(np.int64))
        classes = np.where(place < ALONE, place, 0)
        classes[order[ALONE:]] = later
        total = np.bincount(classes, counts + 1.0, CLASSES)
        row = np.where(place < INPUTS - 256, place, INPUTS - 256 + np.arange(VOCABULARY) % 254)
        row[START], row[END] = INPUTS - 2, INPUTS - 1  # START also stands for no id
        r = np.random.default_rng(seed)
        init = lambda *s: r.normal(0, s[0] ** -0.5, s)
        w = {
            "e": r.normal(0, 0.3, (INPUTS, WIDTH)), "p": r.normal(0, 0.1, (WINDOW, WIDTH)),
            "q": init(WIDTH, WIDTH), "k": init(WIDTH, WIDTH), "v": init(WIDTH, WIDTH), "o": init(WIDTH, WIDTH),
            "a": init(WIDTH, HIDDEN), "ab": np.zeros(HIDDEN), "b": init(HIDDEN, WIDTH),
            "u": init(WIDTH, CLASSES), "ub": np.log(total / total.sum()),
        }
        model = cls(row.astype(np.int32), classes.astype(np.int32), w={n: x.astype(np.float32) for n, x in w.items()})
        model.set_pairs(*(np.zeros(0, np.int64),) * 3)
        return model

    def add_pairs(self, texts: list[np.ndarray], total: np.ndarray) -> None:
        """Adds the counts of (class before, id) in these texts and their ends to total, at class x VOCABULARY + id; START is before a
        text's first id."""
        after = np.concatenate([np.append(t, END) for t in texts])
        before = np.concatenate(([START], after[:-1]))
        before[np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])] = START
        np.add.at(total, self.cls[before].astype(np.int64) * VOCABULARY + after, total.dtype.type(1))  # of one type, which is far faster

    def set_pairs(self, before: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Sets the chances within classes from (class before, id, count) over all training documents."""
        counts = np.bincount(ids, n, VOCABULARY)
        total = np.bincount(self.cls, counts + 1.0, CLASSES)
        self.within = np.log10((counts + 1.0) / total[self.cls])
        used = np.flatnonzero(counts)
        self.column = np.full(VOCABULARY, -1, np.int32)
        self.column[used] = np.arange(len(used))
        table = np.zeros((CLASSES, len(used)))
        np.add.at(table, (before, self.column[ids]), n)
        by_class = np.zeros((CLASSES, CLASSES))
        np.add.at(by_class, (before, self.cls[ids]), n)
        share = table + PRIOR * 10.0 ** self.within[used]
        self.after = np.log10(share / (by_class[:, self.cls[used]] + PRIOR)).astype(np.float32, order="C")
        self.missing = np.log10(PRIOR / (by_class + PRIOR))

    def regroup(self, counts: np.ndarray, before: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Clusters the ids without classes of their own, by the classes ahead of them: (class before, id, count).

        Rounds of assignment to the cluster whose mixture of neighbours gives an id's own the highest likelihood. Ids without counts
        keep their classes. The class bias follows the new classes; chances within classes are to be set anew.
        """
        order = np.argsort(-counts, kind="stable")[ALONE:]
        used = order[counts[order] > 0]
        if not len(used):
            return
        column = np.full(VOCABULARY, -1, np.int64)
        column[used] = np.arange(len(used))
        at = column[ids] >= 0
        table = np.zeros((len(used), CLASSES), np.float32)
        np.add.at(table, (column[ids[at]], before[at]), n[at].astype(np.float32))
        common = table.sum(axis=0, dtype=np.float64) + 1e-9
        common /= common.sum()
        share = (table + CLUSTER_PRIOR * common) / (table.sum(axis=1, keepdims=True) + CLUSTER_PRIOR)
        share = share.astype(np.float32)
        own = (share * np.log(share)).sum(axis=1)
        weight = table.sum(axis=1, dtype=np.float64) ** 0.7
        # starts: the most frequent id, then the one that is farthest from the starts so far for its weight
        starts, far = [0], None
        for _ in range(CLASSES - ALONE - 1):
            d = own - share @ np.log(share[starts[-1]])
            far = d if far is None else np.minimum(far, d)
            starts.append(int(np.argmax(far * weight)))
        center = share[starts].astype(np.float64)
        for _ in range(CLUSTER_ROUNDS):
            cluster = np.argmax(table @ np.log(center).T.astype(np.float32), axis=1)
            center = np.stack([np.bincount(cluster, table[:, k], len(center)) for k in range(CLASSES)], axis=1) + CLUSTER_PRIOR * common
            center /= center.sum(axis=1, keepdims=True)
        self.cls[used] = ALONE + cluster
        total = np.bincount(self.cls, counts + 1.0, CLASSES) + 1.0
        self.w["ub"] = np.log(total / total.sum()).astype(np.float32)

    def in_class(self, before: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """log10 chances of ids within their classes, after ids of the classes before."""
        column, n = self.column.take(ids), self.after.shape[1]
        known = self.after.ravel().take(before.astype(np.int64) * n + column) if n else None  # one index, which is faster
        if n and not (column < 0).any():
            return known
        other = self.within[ids] + self.missing[before, self.cls[ids]]
        return np.where(column < 0, other, known) if n else other

    def forward(self, rows: np.ndarray, dead: np.ndarray) -> dict[str, np.ndarray]:
        """rows: input rows (windows, WINDOW); dead: windows whose CONTEXT holds no id. Scores the last STRIDE of each."""
        w, n = self.w, len(rows)
        x = w["e"][rows] + w["p"]
        y = x[:, CONTEXT:]
        q, k, v = y @ w["q"], x @ w["k"], x @ w["v"]
        s = q @ k.transpose(0, 2, 1) * np.float32(WIDTH**-0.5) + MASK
        s[dead, :, :CONTEXT] = NONE
        s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(axis=2, keepdims=True)
        c = s @ v
        h = y + c @ w["o"]
        z = np.maximum(h @ w["a"] + w["ab"], 0)
        f = (h + z @ w["b"]).reshape(n * STRIDE, WIDTH)
        return {"x": x, "y": y, "q": q, "k": k, "v": v, "s": s, "c": c, "h": h, "z": z, "f": f, "l": f @ w["u"] + w["ub"]}

    def prepare(self) -> None:
        """Makes what scoring needs from the weights: products of the input table, and biases as further columns."""
        w = self.w
        scale, values = np.float32(WIDTH**-0.5), w["v"] @ w["o"]
        column = lambda n, x: np.full((n, 1), x, np.float32)
        self.fast = {
            "kv": np.concatenate([w["e"] @ w["k"], w["e"] @ values, column(INPUTS, 1)], axis=1),
            "kvp": np.concatenate([w["p"] @ w["k"], w["p"] @ values, column(WINDOW, 0)], axis=1),
            "q": w["e"] @ w["q"] * scale, "qp": (w["p"] @ w["q"] * scale)[CONTEXT:],
            "x": np.concatenate([w["e"], column(INPUTS, 1)], axis=1), "xp": np.concatenate([w["p"], column(WINDOW, 0)], axis=1)[CONTEXT:],
            "a": np.concatenate([w["a"], w["ab"][None]]), "b": np.concatenate([w["b"], column(HIDDEN, 0)], axis=1),
            "u": np.concatenate([w["u"], w["ub"][None]]), "ones": np.ones(CLASSES, np.float32),
        }

    def class_chances(self, rows: np.ndarray, dead: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """Natural logs of the chances of classes cls; what forward() says, with fewer passes over memory."""
        t, own = self.fast, rows[:, CONTEXT:]
        kv, q, h = t["kv"].take(rows, 0), t["q"].take(own, 0), t["x"].take(own, 0)
        kv += t["kvp"]
        q += t["qp"]
        h += t["xp"]  # its last column is 1, for biases
        s = q @ kv[:, :, :WIDTH].transpose(0, 2, 1)
        s += MASK
        s[dead, :, :CONTEXT] = NONE
        np.exp(s, out=s)
        c = s @ kv[:, :, WIDTH:]  # its last column is the sum of the weights
        c[:, :, :WIDTH] /= c[:, :, WIDTH:]
        h[:, :, :WIDTH] += c[:, :, :WIDTH]
        h = h.reshape(-1, WIDTH + 1)
        z = h @ t["a"]
        h += np.maximum(z, 0, out=z) @ t["b"]
        l = h @ t["u"]
        hit = l[np.arange(len(l)), cls]
        return hit - np.log(np.exp(l, out=l) @ t["ones"])

    def chances(self, rows: np.ndarray, dead: np.ndarray, target: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log10 chances of target ids (windows, STRIDE); before: the classes of the ids ahead of them."""
        cls = self.cls[target].ravel()
        with np.errstate(all="ignore"):
            got = self.class_chances(rows, dead, cls)
        if not np.isfinite(got).all():  # beyond single precision's range
            l = self.forward(rows, dead)["l"].astype(np.float64)
            l -= l.max(axis=1, keepdims=True)
            got = l[np.arange(len(l)), cls] - np.log(np.exp(l).sum(axis=1))
        return (got.astype(np.float64) / np.log(10)).reshape(target.shape) + self.in_class(before, target)

    def slopes(self, rows: np.ndarray, dead: np.ndarray, target: np.ndarray, live: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """(mean loss of the classes, gradients), some windows at a time, so that what they need stays near the core."""
        count, loss, g, inputs = max(1.0, float(live.sum())), 0.0, {}, []
        for a in range(0, len(rows), LEARNT_AT_ONCE):
            b = a + LEARNT_AT_ONCE
            one, part, dx = self.part_slopes(rows[a:b], dead[a:b], self.cls[target[a:b]].ravel(), live[a:b].ravel(), count)
            loss += one
            g = {n: g[n] + x for n, x in part.items()} if g else part
            inputs.append(dx)
        g["e"] = np.zeros_like(self.w["e"])
        row = rows.ravel().astype(np.uint16)
        order = np.argsort(row, kind="stable")
        row = row[order]
        first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        sums = np.concatenate(inputs).take(order, 0)
        pairs = sums.view(np.result_type(sums, np.complex64))  # two columns in one addition
        g["e"][row[first]] = np.add.reduceat(pairs, first).view(sums.dtype)
        return loss, g

    def part_slopes(self, rows: np.ndarray, dead: np.ndarray, cls: np.ndarray, live: np.ndarray, count: float) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
        """These windows' part of the loss and of the gradients, and the gradients of their input rows; what forward() says, with fewer
        passes: biases are further columns, and sums that chances are divided by scale narrow arrays in place of wide ones."""
        w, n, kind = self.w, len(rows), self.w["e"].dtype
        size, scale = n * STRIDE, kind.type(WIDTH**-0.5)
        kv_w, q_w = np.concatenate([w["k"], w["v"]], axis=1), w["q"] * scale
        a_w, u_w = np.concatenate([w["a"], w["ab"][None]]), np.concatenate([w["u"], w["ub"][None]])
        b_w = np.concatenate([w["b"], np.zeros((HIDDEN, 1), kind)], axis=1)
        x = w["e"].take(rows.ravel(), 0).reshape(n, WINDOW, WIDTH)
        x += w["p"]
        y = x[:, CONTEXT:].reshape(-1, WIDTH)
        x = x.reshape(-1, WIDTH)
        kv = (x @ kv_w).reshape(n, WINDOW, 2 * WIDTH)
        k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH:]
        q = (y @ q_w).reshape(n, STRIDE, WIDTH)
        s = q @ k.transpose(0, 2, 1)
        s += MASK
        s[dead, :, :CONTEXT] = NONE
        if not s.max() < 60:  # beyond which sums leave single precision's range
            s -= s.max(axis=2, keepdims=True)
        np.exp(s, out=s)
        seen = (s @ np.ones(WINDOW, kind)).reshape(-1, 1)
        seen += kind.type(1e-30)
        c = (s @ v).reshape(-1, WIDTH)
        c /= seen
        h = np.ones((size, WIDTH + 1), kind)
        np.add(c @ w["o"], y, out=h[:, :WIDTH])
        z = h @ a_w
        np.maximum(z, 0, out=z)
        f = z @ b_w
        f += h
        p = f @ u_w
        if not p.max() < 60:
            p -= p.max(axis=1, keepdims=True)
        np.exp(p, out=p)
        at, norm = np.arange(size), p @ np.ones(CLASSES, kind) + kind.type(1e-30)
        keep = live.astype(kind) / kind.type(count)
        loss = -float(np.log(p[at, cls] / norm + 1e-12) @ keep)
        p[at, cls] -= norm
        part = keep / norm
        g = {"u": (f[:, :WIDTH] * part[:, None]).T @ p, "ub": part @ p}
        df = p @ w["u"].T
        df *= part[:, None]
        g["b"] = z.T @ df
        dz = df @ w["b"].T
        dz *= z > 0
        both = h.T @ dz
        g["a"], g["ab"] = both[:WIDTH], both[WIDTH]
        df += dz @ w["a"].T
        g["o"] = c.T @ df
        dc = df @ w["o"].T
        dc /= seen
        own = np.einsum("ij,ij->i", dc, c).reshape(n, STRIDE, 1)
        dc = dc.reshape(n, STRIDE, WIDTH)
        ds = dc @ v.transpose(0, 2, 1)
        ds -= own
        ds *= s
        dq = (ds @ k).reshape(-1, WIDTH)
        dkv = np.empty((n, WINDOW, 2 * WIDTH), kind)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[:, :, :WIDTH])
        np.matmul(s.transpose(0, 2, 1), dc, out=dkv[:, :, WIDTH:])
        dkv = dkv.reshape(-1, 2 * WIDTH)
        g["q"] = y.T @ dq * scale
        both = x.T @ dkv
        g["k"], g["v"] = both[:, :WIDTH], both[:, WIDTH:]
        dx = (dkv @ kv_w.T).reshape(n, WINDOW, WIDTH)
        df += dq @ q_w.T
        dx[:, CONTEXT:] += df.reshape(n, STRIDE, WIDTH)
        g["p"] = dx.sum(axis=0)
        return loss, g, dx.reshape(-1, WIDTH)

    def descend(self, shown: tuple[np.ndarray, ...] | np.ndarray, steps: int, seed: int, most: float = RATE, least: float = 0.1, state: dict | None = None) -> list[float]:
        """Adam on these windows, packed or not; the losses by step. Each pass takes every window once, in a random order; the step size
        falls to the share least. state: an empty dict, or what an earlier call left in it to go on from."""
        packed, state = isinstance(shown, np.ndarray), {} if state is None else state
        size, r, losses, order = len(shown if packed else shown[0]), np.random.default_rng(seed), [], np.zeros(0, np.int64)
        mean = state.setdefault("mean", {n: np.zeros_like(x) for n, x in self.w.items()})
        var = state.setdefault("var", {n: np.zeros_like(x) for n, x in self.w.items()})
        for step in range(1, steps + 1):
            t = state["t"] = state.get("t", 0) + 1
            if len(order) < min(BATCH, size):
                order = np.concatenate([order, r.permutation(size)])
            at, order = order[:BATCH], order[BATCH:]
            loss, g = self.slopes(*(unpacked_windows(shown[at]) if packed else (x[at] for x in shown)))
            losses.append(loss)
            rate = most * min(1, t / 30) * (1 - (1 - least) * step / steps)
            for n, x in g.items():
                mean[n] *= 0.9
                mean[n] += 0.1 * x
                var[n] *= 0.99
                x *= x
                x *= 0.01
                var[n] += x
                np.sqrt(var[n], out=x)
                x *= (1 - 0.99**t) ** -0.5
                x += 1e-8
                np.divide(mean[n], x, out=x)
                x *= rate / (1 - 0.9**t)
                self.w[n] -= x
        return losses

    def id_chances(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 chances of each text's ids and its end, text by text."""
        self.prepare()
        rows, dead, target, live, before = windows(texts, self)
        out = [np.zeros(0)]
        for a in range(0, len(rows), AT_ONCE):
            b = a + AT_ONCE
            out.append(self.chances(rows[a:b], dead[a:b], target[a:b], before[a:b])[live[a:b]])
        return np.concatenate(out)

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 chance of each id sequence and its end."""
        size = [len(t) + 1 for t in texts]
        return np.bincount(np.repeat(np.arange(len(texts)), size), self.id_chances(texts), len(texts))


#: Position CONTEXT + i sees positions up to its own.
MASK = np.where(np.arange(WINDOW)[None] <= np.arange(STRIDE)[:, None] + CONTEXT, np.float32(0), np.float32(NONE))


def windows(texts: list[np.ndarray], model: Model, r: np.random.Generator | None = None, share: float = 1.0) -> tuple[np.ndarray, ...]:
    """(input rows, whether the CONTEXT places hold no id, target ids, which targets count, classes before the targets) by
    window; all windows, or an even draw of this share.

    A text's inputs are START and its ids; its targets its ids and END.
    """
    size = np.array([len(t) + 1 for t in texts], np.int64)
    n = -(-size // STRIDE)
    owner = np.repeat(np.arange(len(texts)), n)
    turn = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    room = CONTEXT + n * STRIDE  # CONTEXT dead places ahead, the inputs, then dead places
    begin = np.cumsum(room) - room
    inputs, targets = np.full(int(room.sum()), START, np.int32), np.full(int(room.sum()), END, np.int32)
    joined = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    at = np.arange(len(joined)) + np.repeat(begin + CONTEXT - (np.cumsum(size - 1) - (size - 1)), size - 1)
    inputs[at + 1] = joined
    targets[at] = joined
    if r is not None:
        drawn = np.flatnonzero(r.random(len(owner)) < share)
        owner, turn = owner[drawn], turn[drawn]
    first = begin[owner] + turn * STRIDE
    place = np.minimum(first[:, None] + np.arange(WINDOW), len(inputs) - 1)
    live = (turn[:, None] * STRIDE + np.arange(STRIDE)) < size[owner][:, None]
    own = place[:, CONTEXT:]
    return model.row[inputs[place]], turn == 0, targets[own], live, model.cls[inputs[own]]


def packed_windows(shown: tuple[np.ndarray, ...]) -> np.ndarray:
    """What learning needs of windows, a row of 16-bit numbers for each: input rows, whether CONTEXT is dead, targets, how many count."""
    rows, dead, target, live = shown[:4]
    return np.concatenate([rows, dead[:, None], target, live.sum(axis=1)[:, None]], axis=1).astype("<u2")


def unpacked_windows(packed: np.ndarray) -> tuple[np.ndarray, ...]:
    x = packed.reshape(-1, WINDOW + STRIDE + 2).astype(np.int64)
    live = np.arange(STRIDE) < x[:, -1:]
    return x[:, :WINDOW].astype(np.int32), x[:, WINDOW] > 0, x[:, WINDOW + 1 : -1], live
