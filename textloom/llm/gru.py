"""A bidirectional gated recurrent network with attention pooling, in numpy: forward, backward, Adam.

A word's input is its own vector plus the mean of its character n-gram vectors. Both are folded with the
input weights into one row for each distinct word, so a step is a row lookup and one small product.
"""

from __future__ import annotations

import numpy as np

DIM, HIDDEN, ATTEND, BUCKETS = 12, 8, 8, 1 << 15


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character n-grams of each word between marks, flat, and how many each word has: all of 3 and 4, and the prefixes of 3 to 6."""
    marked = [f"^{w}$\0\0\0\0\0" for w in words]
    sizes = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    codes = np.concatenate([codes, np.zeros(8, np.uint64)])
    n, starts = len(codes) - 8, np.cumsum(sizes) - sizes
    hashed, at = codes[:n].copy(), {}
    for k in range(1, 7):
        hashed = (hashed * np.uint64(0x100000001B3)) ^ codes[k : n + k]
        at[k + 1] = hashed
    place, own = np.arange(n) - np.repeat(starts, sizes), np.repeat(sizes - 5, sizes)
    take = [(place <= own - 3, at[3], 1), (place <= np.maximum(own - 4, 0), at[4], 2)]
    take += [((place == 0), at[k], k + 1) for k in range(4, 8)]
    which = np.concatenate([np.flatnonzero(keep) for keep, _, _ in take])
    values = np.concatenate([(h[keep] ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15) for keep, h, salt in take]) >> np.uint64(64 - 15)
    word = np.repeat(np.arange(len(words)), sizes)[which]
    order = np.argsort(word, kind="stable")
    return values[order].astype(np.int64), np.bincount(word, minlength=len(words))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class Network:
    def __init__(self, words: dict[str, int], seed: int = 1):
        rng = np.random.default_rng(seed)
        small = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        self.words = words
        self.p = {"word": small(len(words) + 1, DIM) * 0.3, "gram": small(BUCKETS, DIM) * 0.3, "attend": small(2 * HIDDEN, ATTEND), "query": small(ATTEND), "out": small(2 * HIDDEN), "bias": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"x{side}": small(DIM, 3 * HIDDEN), f"u{side}": small(HIDDEN, 3 * HIDDEN), f"c{side}": np.zeros(3 * HIDDEN, np.float32)}
        self.moments: dict[str, list] = {}
        self.step = 0

    def start_from(self, word_odds: dict[str, float], gram_odds: np.ndarray) -> None:
        """The first dimension starts at the log-odds of words and n-grams in the training texts."""
        for w, i in self.words.items():
            self.p["word"][i, 0] = word_odds.get(w, 0.0)
        self.p["gram"][:, 0] = gram_odds

    def inputs(self, words: list[str], at_once: int = 10_000) -> np.ndarray:
        if len(words) > at_once:  # n-gram arrays are many times the size of the result
            return np.concatenate([self.inputs(words[i : i + at_once]) for i in range(0, len(words), at_once)])
        ids = np.array([self.words.get(w, len(self.words)) for w in words], np.int64)
        flat, sizes = grams(words)
        starts = np.cumsum(sizes) - sizes
        return self.p["word"][ids] + np.add.reduceat(self.p["gram"][flat], starts) / sizes[:, None].astype(np.float32)

    def project(self, inputs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple((inputs @ self.p[f"x{s}"] + self.p[f"c{s}"]).astype(np.float32) for s in "fb")

    def run(self, rows: np.ndarray, mask: np.ndarray, table: np.ndarray, side: str, keep: list | None = None) -> np.ndarray:
        """States at every step; rows: windows x steps of rows in the table; the backward side goes from the end."""
        n, steps = rows.shape
        across = np.ascontiguousarray(rows.T)
        h, u, out = np.zeros((n, HIDDEN), np.float32), self.p[f"u{side}"], np.empty((steps, n, HIDDEN), np.float32)
        for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
            x, g = table[across[t]], h @ u
            zr = sigmoid(x[:, : 2 * HIDDEN] + g[:, : 2 * HIDDEN])
            z, r, gn = zr[:, :HIDDEN], zr[:, HIDDEN:], g[:, 2 * HIDDEN :]
            new = np.tanh(x[:, 2 * HIDDEN :] + r * gn)
            m = mask[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, gn, new, m))
            h = h + m * (1 - z) * (new - h)
            out[t] = h
        return out

    def logits(self, rows: np.ndarray, mask: np.ndarray, tables: tuple[np.ndarray, np.ndarray], cache: dict | None = None) -> np.ndarray:
        kept = {s: [] if cache is not None else None for s in "fb"}
        h = np.concatenate([self.run(rows, mask, t, s, kept[s]) for s, t in zip("fb", tables, strict=True)], axis=2)
        a = np.tanh(h @ self.p["attend"])
        e = np.where(mask.T > 0, a @ self.p["query"], np.float32(-1e9))
        e = np.exp(e - e.max(0))
        weight = e / e.sum(0)
        pooled = (weight[:, :, None] * h).sum(0)
        if cache is not None:
            cache |= {"kept": kept, "h": h, "a": a, "weight": weight, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def learn(self, words: list[str], rows: np.ndarray, mask: np.ndarray, label: np.ndarray, rate: float = 0.01) -> float:
        """One Adam step on the windows' cross-entropy; rows index `words`."""
        ids = np.array([self.words.get(w, len(self.words)) for w in words], np.int64)
        flat, sizes = grams(words)
        owner = np.repeat(np.arange(len(words)), sizes)
        inputs = self.inputs(words)
        cache: dict = {}
        logit = self.logits(rows, mask, self.project(inputs), cache)
        prob = sigmoid(logit)
        d = ((prob - label) / len(label)).astype(np.float32)
        h, a, w, pooled = cache["h"], cache["a"], cache["weight"], cache["pooled"]
        grad = {"out": pooled.T @ d, "bias": d.sum(keepdims=True)}
        dpooled = d[:, None] * self.p["out"]
        dh = w[:, :, None] * dpooled
        dw = (h * dpooled).sum(2)
        de = w * (dw - (w * dw).sum(0))
        da = de[:, :, None] * self.p["query"] * (1 - a * a)
        grad["query"] = (de[:, :, None] * a).sum((0, 1))
        grad["attend"] = np.tensordot(h, da, ([0, 1], [0, 1]))
        dh = dh + da @ self.p["attend"].T
        dinputs = np.zeros_like(inputs)
        for k, side in enumerate("fb"):
            u, du = self.p[f"u{side}"], np.zeros_like(self.p[f"u{side}"])
            own, carry = dh[:, :, k * HIDDEN : (k + 1) * HIDDEN], np.zeros((len(label), HIDDEN), np.float32)
            dtable = np.zeros((len(words), 3 * HIDDEN), np.float32)
            for t, before, z, r, gn, new, m in reversed(cache["kept"][side]):
                total = carry + own[t]
                dnew = total * m * (1 - z) * (1 - new * new)
                dz = total * m * (before - new) * z * (1 - z)
                dr = dnew * gn * r * (1 - r)
                dx = np.concatenate([dz, dr, dnew], axis=1)
                dg = np.concatenate([dz, dr, dnew * r], axis=1)
                du += before.T @ dg
                carry = total * (1 - m * (1 - z)) + dg @ u.T
                np.add.at(dtable, rows[:, t], dx)
            grad |= {f"u{side}": du, f"x{side}": inputs.T @ dtable, f"c{side}": dtable.sum(0)}
            dinputs += dtable @ self.p[f"x{side}"].T
        self.adam(grad, rate)
        self.adam_rows("word", ids, dinputs, rate)
        self.adam_rows("gram", flat, dinputs[owner] / sizes[owner, None], rate)
        self.step += 1
        return float(-np.mean(label * np.log(prob + 1e-7) + (1 - label) * np.log(1 - prob + 1e-7)))

    def adam(self, grad: dict, rate: float) -> None:
        for k, g in grad.items():
            m, v = self.moments.setdefault(k, [np.zeros_like(self.p[k]), np.zeros_like(self.p[k])])
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.p[k] = (self.p[k] - rate * (m / (1 - 0.9 ** (self.step + 1))) / (np.sqrt(v / (1 - 0.999 ** (self.step + 1))) + 1e-6)).astype(np.float32)

    def adam_rows(self, name: str, rows: np.ndarray, g: np.ndarray, rate: float) -> None:
        """Adagrad on the rows that took part."""
        own, place = np.unique(rows, return_inverse=True)
        total = np.zeros((len(own), g.shape[1]), np.float32)
        np.add.at(total, place, g)
        if name not in self.moments:
            self.moments[name] = [np.full(len(self.p[name]), 1e-6, np.float32)]
        self.moments[name][0][own] += (total * total).mean(1)
        self.p[name][own] -= rate * total / np.sqrt(self.moments[name][0][own])[:, None]
