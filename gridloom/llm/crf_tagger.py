"""Character-level bidirectional LSTM with CRF transitions, in numpy: training, inference, storage.

Texts are cut into overlapping windows, each window is decoded with Viterbi, and the labels of the
windows' centres are joined into one label sequence per text.
"""

from __future__ import annotations

import unicodedata

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
#: Tags: 0 outside, 1 + 2k begins kind k, 2 + 2k continues it.
N_TAGS = 1 + 2 * len(KINDS)
#: Window length and the context on either side that is read but not kept.
WINDOW, CONTEXT = 192, 28
HIDDEN = 32

_ASCII = 128
_VOCAB = _ASCII + 8


def fold_text(text: str) -> str:
    """One code point for each of the text: compatibility forms, accents and odd blanks folded, case kept."""
    if text.isascii():
        return text
    out = []
    for ch in text:
        if ch < "\x80":
            out.append(ch)
            continue
        folded = unicodedata.normalize("NFKD", ch)
        base = folded[0] if folded else ch
        if base.isspace() or ch.isspace():
            out.append(" ")
        elif base < "\x80" and base.isprintable() and (len(folded) == 1 or unicodedata.combining(folded[1])):
            out.append(base)
        elif unicodedata.category(ch) == "Pd":
            out.append("-")
        else:
            out.append(ch)
    return "".join(out)


_CLASS = {"L": 0, "N": 1, "P": 2, "S": 3, "Z": 4, "C": 5, "M": 6}


def encode(folded: str) -> np.ndarray:
    """Character ids of a folded text: ASCII as it is, the rest by general category."""
    codes = np.frombuffer(folded.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int32)
    wide = np.flatnonzero(codes >= _ASCII)
    for i in wide:
        codes[i] = _ASCII + _CLASS.get(unicodedata.category(folded[i])[0], 7)
    return codes.astype(np.int16)


def _sigmoid(x):
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


class Tagger:
    """Weights and the forward and backward passes. All arrays are float32, batch second."""

    NAMES = ("emb_f", "rec_f", "emb_b", "rec_b", "out", "bias", "trans", "start")

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = {k: np.ascontiguousarray(v, dtype=np.float32) for k, v in weights.items()}

    @classmethod
    def fresh(cls, seed: int = 7, hidden: int = HIDDEN) -> "Tagger":
        g = np.random.default_rng(seed)
        w = {}
        for d in "fb":
            w[f"emb_{d}"] = g.normal(0, 0.25, (_VOCAB + 1, 4 * hidden))  # the last row is padding
            w[f"emb_{d}"][:, hidden : 2 * hidden] += 1.0  # forget gates start open
            w[f"rec_{d}"] = g.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        w["out"] = g.normal(0, 0.2, (2 * hidden, N_TAGS))
        w["bias"] = np.zeros(N_TAGS)
        w["bias"][0] = 2.0
        w["trans"] = np.zeros((N_TAGS, N_TAGS))
        w["start"] = np.zeros(N_TAGS)
        return cls(w)

    @classmethod
    def load(cls, source) -> "Tagger":
        """From a path or an open file."""
        with np.load(source) as z:
            return cls({k: z[k] for k in cls.NAMES})

    def save(self, path) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.w.items()})

    # -- forward ---------------------------------------------------------------------------------
    def _run(self, x: np.ndarray, d: str, keep: bool):
        """x: (T, B) ids in reading order of the direction. Returns hidden states (T, B, H) and a tape."""
        emb, rec = self.w[f"emb_{d}"], self.w[f"rec_{d}"]
        t_n, b = x.shape
        h_n = rec.shape[0]
        hs = np.empty((t_n, b, h_n), np.float32)
        h, c, tape = np.zeros((b, h_n), np.float32), np.zeros((b, h_n), np.float32), []
        for t in range(t_n):
            z = emb[x[t]]
            z += h @ rec
            gates = _sigmoid(z[:, : 3 * h_n].copy() if keep else z[:, : 3 * h_n])
            g = np.tanh(z[:, 3 * h_n :])
            i, f, o = gates[:, :h_n], gates[:, h_n : 2 * h_n], gates[:, 2 * h_n : 3 * h_n]
            c_old, h_old = c, h
            c = f * c_old + i * g
            tc = np.tanh(c)
            h = o * tc
            hs[t] = h
            if keep:
                tape.append((i, f, o, g, c_old, tc, h_old))
        return hs, tape

    def _ready(self) -> tuple:
        """Weights for reading: a gate's logistic curve is half of 1 + tanh of half its input, so one tanh serves all gates; the halves are in the weights."""
        if getattr(self, "_fast", None) is None:
            h = self.w["rec_f"].shape[0]
            half = np.full(4 * h, 0.5, np.float32)
            half[3 * h :] = 1.0
            emb = [np.ascontiguousarray(self.w[f"emb_{d}"] * half) for d in "fb"]
            rec = np.stack([self.w[f"rec_{d}"] * half * 0.5 for d in "fb"])  # states are kept doubled
            self._fast = (emb, np.ascontiguousarray(rec, np.float32), (self.w["out"] * 0.5).astype(np.float32))
        return self._fast

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """(T, B) ids to (T, B, tags) scores. Both directions are read in one loop."""
        (emb_f, emb_b), rec, out = self._ready()
        h_n = rec.shape[1]
        t_n, b = x.shape
        states = np.empty((t_n, 2, b, h_n), np.float32)
        h, c, z, part = np.zeros((2, b, h_n), np.float32), np.zeros((2, b, h_n), np.float32), np.empty((2, b, 4 * h_n), np.float32), np.empty((2, b, 4 * h_n), np.float32)
        for t in range(t_n):
            np.take(emb_f, x[t], axis=0, out=z[0], mode="wrap")
            np.take(emb_b, x[t_n - 1 - t], axis=0, out=z[1], mode="wrap")
            np.matmul(h, rec, out=part)
            z += part
            np.tanh(z, out=z)
            z[:, :, : 3 * h_n] += 1
            i, f, o, g = (z[:, :, k * h_n : (k + 1) * h_n] for k in range(4))
            c *= f
            i *= g
            c += i
            c *= 0.5
            h = states[t]
            np.tanh(c, out=h)
            h *= o
        e = states[:, 0].reshape(-1, h_n) @ out[:h_n]
        e += np.ascontiguousarray(states[::-1, 1]).reshape(-1, h_n) @ out[h_n:]
        e += self.w["bias"]
        return e.reshape(t_n, b, N_TAGS)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """Best tags (T, B). A window whose scores leave no other tag than outside any chance is not searched."""
        t_n, b, _ = e.shape
        trans, out = self.w["trans"], np.zeros((t_n, b), np.int8)
        # by how much the best excursion from all-outside can gain: its steps' largest advantages, what transitions within it
        # add at most, and what its beginning and end add; a window without a gain is all outside
        stay = trans[0, 0]
        within = float(trans[1:, 1:].max() - stay)
        ends = max(float(trans[0, 1:].max() - stay), float((self.w["start"][1:] - self.w["start"][0]).max())) + max(0.0, float(trans[1:, 0].max() - stay)) - within
        e = np.ascontiguousarray(e.transpose(0, 2, 1))  # steps, tags, windows
        ahead = e[:, 1:].max(1) + (within - e[:, 0])
        run, best = np.full(b, -np.inf, np.float32), np.full(b, -np.inf, np.float32)
        for step in ahead:
            run = np.maximum(run, 0) + step
            np.maximum(best, run, out=best)
        live = np.flatnonzero(best + ends > -1e-3)
        if not len(live):
            return out
        score = np.ascontiguousarray(e[:, :, live])
        score[0] += self.w["start"][:, None]
        into = trans[:, :, None]
        step = np.empty((N_TAGS, N_TAGS, len(live)), np.float32)
        for t in range(1, t_n):
            np.add(score[t - 1][:, None, :], into, out=step)
            score[t] += step.max(0)
        # the way back asks again which tag was best before
        tag = score[-1].argmax(0)
        for t in range(t_n - 1, -1, -1):
            out[t, live] = tag
            if t:
                tag = (score[t - 1] + trans[:, tag]).argmax(0)
        return out

    # -- training --------------------------------------------------------------------------------
    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """CRF negative log-likelihood of the batch (T, B) and its gradients."""
        w = self.w
        h_n = w["rec_f"].shape[0]
        t_n, b = x.shape
        fwd, tape_f = self._run(x, "f", True)
        bwd, tape_b = self._run(x[::-1], "b", True)
        states = np.concatenate([fwd, bwd[::-1]], 2)
        e = states @ w["out"] + w["bias"]

        def lse(a, axis):
            m = a.max(axis, keepdims=True)
            return np.log(np.exp(a - m).sum(axis)) + m.squeeze(axis)

        alpha = np.empty_like(e)
        alpha[0] = w["start"] + e[0]
        for t in range(1, t_n):
            alpha[t] = lse(alpha[t - 1][:, :, None] + w["trans"][None], 1) + e[t]
        beta = np.zeros_like(e)
        for t in range(t_n - 2, -1, -1):
            beta[t] = lse(w["trans"][None] + (e[t + 1] + beta[t + 1])[:, None, :], 2)
        log_z = lse(alpha[-1], 1)
        rows = np.arange(b)
        gold = w["start"][y[0]] + e[0][rows, y[0]]
        d_e = np.exp(alpha + beta - log_z[None, :, None])
        d_trans = np.zeros_like(w["trans"])
        for t in range(1, t_n):
            gold = gold + w["trans"][y[t - 1], y[t]] + e[t][rows, y[t]]
            d_trans += np.exp(alpha[t - 1][:, :, None] + w["trans"][None] + (e[t] + beta[t])[:, None, :] - log_z[:, None, None]).sum(0)
            np.add.at(d_trans, (y[t - 1], y[t]), -1)
        d_start = d_e[0].sum(0)
        np.add.at(d_start, y[0], -1)
        d_e[np.arange(t_n)[:, None], rows[None], y] -= 1
        scale = 1.0 / (t_n * b)
        d_e *= scale * 8
        grads = {"trans": d_trans * scale * 8, "start": d_start * scale * 8, "bias": d_e.sum((0, 1))}
        grads["out"] = states.reshape(-1, 2 * h_n).T @ d_e.reshape(-1, N_TAGS)
        d_h = d_e @ w["out"].T
        for d, xs, tape, dh_all in (("f", x, tape_f, d_h[:, :, :h_n]), ("b", x[::-1], tape_b, d_h[::-1, :, h_n:])):
            rec = w[f"rec_{d}"]
            d_emb, d_rec = np.zeros_like(w[f"emb_{d}"]), np.zeros_like(rec)
            dh_next, dc_next = np.zeros((b, h_n), np.float32), np.zeros((b, h_n), np.float32)
            dzs = np.empty((t_n, b, 4 * h_n), np.float32)
            for t in range(t_n - 1, -1, -1):
                i, f, o, g, c_old, tc, h_old = tape[t]
                dh = dh_all[t] + dh_next
                dc = dh * o * (1 - tc * tc) + dc_next
                dz = dzs[t]
                dz[:, :h_n] = dc * g * i * (1 - i)
                dz[:, h_n : 2 * h_n] = dc * c_old * f * (1 - f)
                dz[:, 2 * h_n : 3 * h_n] = dh * tc * o * (1 - o)
                dz[:, 3 * h_n :] = dc * i * (1 - g * g)
                d_rec += h_old.T @ dz
                dh_next = dz @ rec.T
                dc_next = dc * f
            np.add.at(d_emb, xs.ravel(), dzs.reshape(-1, 4 * h_n))
            grads[f"emb_{d}"], grads[f"rec_{d}"] = d_emb, d_rec
        return float((log_z - gold).mean() / t_n), grads

    def fit(self, windows: np.ndarray, tags: np.ndarray, epochs: int, batch: int = 256, rate: float = 0.005, seed: int = 11, said=None, workers: int = 1) -> None:
        """Adam over (N, T) windows and tags; the rate falls by a cosine. Workers share the gradient of a batch."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.w.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.w.items()}
        steps, step = epochs * max(1, len(windows) // batch), 0
        pool = None
        if workers > 1:
            from multiprocessing import get_context

            pool = get_context("fork").Pool(workers, _hold, (windows, tags))
        try:
            for epoch in range(epochs):
                order, total = g.permutation(len(windows)), []
                for at in range(0, len(windows) - batch + 1, batch):
                    rows = order[at : at + batch]
                    if pool:
                        done = pool.map(_share, [(self.w, part) for part in np.array_split(rows, workers)])
                        loss = float(np.mean([d[0] for d in done]))
                        grads = {k: sum(d[1][k] for d in done) / workers for k in self.w}
                    else:
                        loss, grads = self.gradients(np.ascontiguousarray(windows[rows].T), np.ascontiguousarray(tags[rows].T))
                    total.append(loss)
                    step += 1
                    norm = np.sqrt(sum(float((x * x).sum()) for x in grads.values()))
                    lr = rate * (0.02 + 0.98 * 0.5 * (1 + np.cos(np.pi * step / steps))) * min(1.0, step / 50)
                    for k, grad in grads.items():
                        grad = grad * min(1.0, 2.0 / (norm + 1e-9))
                        m[k] = 0.9 * m[k] + 0.1 * grad
                        v2[k] = 0.99 * v2[k] + 0.01 * grad * grad
                        self.w[k] -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
                self._fast = None
                if said:
                    said(epoch, float(np.mean(total)))
        finally:
            if pool:
                pool.terminate()

    # -- whole texts -----------------------------------------------------------------------------
    def tag_texts(self, ids: list[np.ndarray], regions: list[list[tuple[int, int]]] | None = None, lean: np.ndarray | None = None, batch: int = 256) -> list[np.ndarray]:
        """The tags of every character of every text: windows overlap, and each character's tag is that of its most central window.

        With regions (start, end), only these and CONTEXT characters on either side are read; what lies outside of them stays outside.
        A lean is added to the scores of the tags before decoding: kinds whose form is checked afterwards can afford more proposals.
        """
        stride, spans = WINDOW - 2 * CONTEXT, []
        for k, x in enumerate(ids):
            for lo, hi in [(0, len(x))] if regions is None else regions[k]:
                for at in range(lo, max(lo + 1, hi), stride):
                    upto = min(at + stride, hi)
                    spans.append((min(len(x), upto + CONTEXT) - at, k, at, upto))
        spans.sort()
        out = [np.zeros(len(x), np.int8) for x in ids]
        for first in range(0, len(spans), batch):
            part = spans[first : first + batch]
            length = CONTEXT + part[-1][0]
            x = np.full((length, len(part)), _VOCAB, np.int16)
            for j, (_, k, at, upto) in enumerate(part):
                lo = max(0, at - CONTEXT)
                piece = ids[k][lo : upto + CONTEXT]
                x[lo - at + CONTEXT : lo - at + CONTEXT + len(piece), j] = piece
            e = self.emissions(x)
            tags = self.viterbi(e if lean is None else e + lean)
            for j, (_, k, at, upto) in enumerate(part):
                out[k][at:upto] = tags[CONTEXT : CONTEXT + upto - at, j]
        return out


_HELD: list = []


def _hold(windows: np.ndarray, tags: np.ndarray) -> None:
    _HELD[:] = [windows, tags]


def _share(job: tuple) -> tuple:
    """Loss and gradients of a worker's part of a batch."""
    weights, rows = job
    return Tagger(weights).gradients(np.ascontiguousarray(_HELD[0][rows].T), np.ascontiguousarray(_HELD[1][rows].T))


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the labelled runs; a run that lost its beginning still counts."""
    out, kind, start = [], -1, 0
    for i in np.flatnonzero(np.diff(tags, prepend=0, append=0) != 0) if len(tags) else []:
        tag = int(tags[i]) if i < len(tags) else 0
        now = (tag - 1) // 2 if tag else -1
        if kind >= 0 and (now != kind or tag % 2 == 1):
            out.append((kind, start, int(i)))
            kind = -1
        if now >= 0 and kind < 0:
            kind, start = now, int(i)
    return out
