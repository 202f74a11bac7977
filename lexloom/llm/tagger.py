"""A character tagger in numpy: a bidirectional LSTM whose emissions meet the transitions of a CRF.

Characters enter as classes (digits, letters, each ASCII sign), so that what is
learnt is a form and not a value.  Both directions run as one stacked product;
training is full backpropagation through time and through the CRF's
forward-backward sums, with Adam.  Everything is seeded.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from lexloom.llm.common import by_value, worker_cache

PAD, DIGIT, LOWER, UPPER, BLANK, LETTER, OTHER, SIGNS = range(8)
N_CLASSES = SIGNS + 128
#: What full-width forms are moved by to meet the ASCII signs.
WIDE = 0xFEE0


def _class_of(code: int) -> int:
    if 0xFF01 <= code <= 0xFF5E:
        code -= WIDE
    c = chr(code)
    if unicodedata.category(c) == "Nd":
        return DIGIT
    if code < 128:
        if c.isalpha():
            return UPPER if c.isupper() else LOWER
        return BLANK if c.isspace() else SIGNS + code
    return BLANK if c.isspace() else LETTER if c.isalpha() else OTHER


def classes(codes: np.ndarray) -> np.ndarray:
    """Character classes of code points."""
    kept = worker_cache()
    if "char_classes" not in kept:
        kept["char_classes"] = np.array([_class_of(c) for c in range(0x10000)], np.uint8)
    return np.where(codes < 0x10000, kept["char_classes"][np.minimum(codes, 0xFFFF)], OTHER).astype(np.uint8)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _lstm(p: dict, x: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
    """Hidden states (2, T, B, H) of both directions over classes (B, T); what backpropagation needs."""
    b, t_max = x.shape
    hidden = p["wh"].shape[1]
    both = np.stack((x.T, x.T[::-1]))  # direction, time, row
    h, c = np.zeros((2, 2, b, hidden), np.float32)
    out, trace = np.empty((2, t_max, b, hidden), np.float32), []
    side = np.arange(2)[:, None]
    for t in range(t_max):
        # One tanh for all gates: the table and weights of i, f and o count half, as sigmoid(z) = (1 + tanh(z / 2)) / 2.
        a = np.tanh(p["wx"][side, both[:, t]] + h @ p["wh"])
        gate = a[..., : 3 * hidden] * 0.5 + 0.5
        i, f, o, g = gate[..., :hidden], gate[..., hidden : 2 * hidden], gate[..., 2 * hidden :], a[..., 3 * hidden :]
        before, c = c, f * c + i * g
        tc = np.tanh(c)
        if keep:
            trace.append((h, before, i, f, o, g, tc))
        h = o * tc
        out[:, t] = h
    out[1] = out[1, ::-1]
    return out, trace


def emissions(p: dict, x: np.ndarray) -> np.ndarray:
    """(T, B, tags)."""
    h = _lstm(p, x, keep=False)[0]
    return h[0] @ p["wo"][0] + h[1] @ p["wo"][1] + p["bo"]


def viterbi(p: dict, e: np.ndarray) -> np.ndarray:
    """The best tag paths, (B, T)."""
    t_max, b, k = e.shape
    score, back = p["start"] + e[0], np.empty((t_max, b, k), np.int8)
    for t in range(1, t_max):
        all_ = score[:, :, None] + p["trans"]
        back[t] = all_.argmax(1)
        score = all_.max(1) + e[t]
    path = np.empty((t_max, b), np.int64)
    path[-1] = score.argmax(1)
    rows = np.arange(b)
    for t in range(t_max - 1, 0, -1):
        path[t - 1] = back[t, rows, path[t]]
    return path.T


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis)) + top.squeeze(axis)


def _crf(p: dict, e: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the paths y (B, T), and its gradients by emissions, transitions and start."""
    t_max, b, k = e.shape
    a, z = np.empty_like(e), np.zeros_like(e)
    a[0] = p["start"] + e[0]
    for t in range(1, t_max):
        a[t] = _log_sum(a[t - 1][:, :, None] + p["trans"], 1) + e[t]
    for t in range(t_max - 2, -1, -1):
        z[t] = _log_sum(p["trans"] + (e[t + 1] + z[t + 1])[:, None, :], 2)
    total = _log_sum(a[-1], 1)
    de = np.exp(a + z - total[:, None])
    pair = np.exp(a[:-1, :, :, None] + p["trans"] + (e[1:] + z[1:])[:, :, None, :] - total[:, None, None]).sum((0, 1))
    rows, gold = np.arange(b), y.T
    real = p["start"][gold[0]] + e[0, rows, gold[0]] + e[np.arange(1, t_max)[:, None], rows, gold[1:]].sum(0) + p["trans"][gold[:-1], gold[1:]].sum(0)
    np.subtract.at(de, (np.arange(t_max)[:, None], rows, gold), 1)
    np.subtract.at(pair, (gold[:-1].ravel(), gold[1:].ravel()), 1)
    return float((total - real).mean()), de / b, pair / b, de[0].sum(0) / b


def _gradients(p: dict, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    h, trace = _lstm(p, x, keep=True)
    e = h[0] @ p["wo"][0] + h[1] @ p["wo"][1] + p["bo"]
    loss, de, trans, start = _crf(p, e, y)
    g = {"trans": trans, "start": start, "bo": de.sum((0, 1)), "wo": np.einsum("dtbh,tbk->dhk", h, de, optimize=True), "wx": np.zeros_like(p["wx"]), "wh": np.zeros_like(p["wh"])}
    dh_all = np.stack((de @ p["wo"][0].T, (de @ p["wo"][1].T)[::-1]))  # in each direction's own order
    both = np.stack((x.T, x.T[::-1]))
    dh, dc = np.zeros((2, *trace[0][0].shape), np.float32)
    dz_all = np.empty((len(trace), *p["wx"][:, :1].shape[:1], x.shape[0], p["wx"].shape[2]), np.float32)
    for t in range(len(trace) - 1, -1, -1):
        h_old, c_old, i, f, o, gg, tc = trace[t]
        dh = dh + dh_all[:, t]
        dc = dc + dh * o * (1 - tc * tc)
        # 2 i (1 - i) is the slope of i by its halved entry.
        dz = np.concatenate((dc * gg * 2 * i * (1 - i), dc * c_old * 2 * f * (1 - f), dh * tc * 2 * o * (1 - o), dc * i * (1 - gg * gg)), -1)
        dz_all[t] = dz
        g["wh"] += h_old.swapaxes(1, 2) @ dz
        dh, dc = dz @ p["wh"].swapaxes(1, 2), dc * f
    for d in range(2):
        at = both[d].ravel()
        flat = dz_all[:, d].reshape(len(at), -1)
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(at[order].astype(int)) != 0)))
        g["wx"][d][at[order][first]] = np.add.reduceat(flat[order], first, 0)
    return loss, g


def train(x: np.ndarray, y: np.ndarray, tags: int, hidden: int = 16, epochs: int = 8, batch: int = 128, rate: float = 0.02, seed: int = 7) -> dict:
    """Parameters fitted on windows of classes x (N, T) and tags y (N, T)."""
    rng = np.random.default_rng(seed)
    small = lambda *s: (rng.standard_normal(s) * 0.2).astype(np.float32)
    p = {"wx": small(2, N_CLASSES, 4 * hidden), "wh": small(2, hidden, 4 * hidden), "wo": small(2, hidden, tags), "bo": np.zeros(tags, np.float32), "trans": small(tags, tags), "start": small(tags)}
    p["wx"][:, :, hidden : 2 * hidden] += 0.5  # remember at first
    m1, m2 = ({n: np.zeros_like(v) for n, v in p.items()} for _ in range(2))
    step, steps = 0, max(1, epochs * -(-len(x) // batch))
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            at = order[lo : lo + batch]
            _, g = _gradients(p, x[at], y[at])
            size = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            pace = rate * (1 - 0.9 * step / steps)
            for n, v in g.items():
                v = v * min(1.0, 5.0 / (size + 1e-9))
                m1[n] = 0.9 * m1[n] + 0.1 * v
                m2[n] = 0.99 * m2[n] + 0.01 * v * v
                p[n] -= (pace * (m1[n] / (1 - 0.9**step)) / (np.sqrt(m2[n] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return p


by_value(__name__)
