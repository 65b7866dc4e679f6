"""Character-level bidirectional LSTM with CRF transitions, in numpy: forward pass, training and decoding.

Arrays are [units, windows] a step, so that gates are whole rows. Gates and cells use softsign, x / (1 + |x|), which numpy computes
several times faster than tanh; a gate is (1 + softsign) / 2.
"""

from __future__ import annotations

import functools
from pathlib import Path

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "person")
#: Tags: 0 outside, 2k - 1 the first character of kind k (from 1), 2k any further one.
N_TAGS = 2 * len(KINDS) + 1
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
_CLASSES, _EMBED = 112, 12
#: Score of a step that tags can't take.
_NEVER = np.float32(-1e4)


def _allowed() -> np.ndarray:
    """Whether tag b may follow tag a: a span goes on only in its own kind."""
    ok = np.ones((N_TAGS, N_TAGS), bool)
    for inside in range(2, N_TAGS, 2):
        ok[:, inside] = False
        ok[inside - 1 : inside + 1, inside] = True
    return ok


ALLOWED = _allowed()


@functools.cache
def char_table() -> np.ndarray:
    """Class of every code point below 65,536: ASCII as it is, wide forms as their plain ones, other characters by kind."""
    import unicodedata

    t = np.full(1 << 16, 111, np.int16)
    for c in range(1 << 16):
        ch = chr(c)
        if c < 128:
            t[c] = 0 if c in (9, 32, 160) else 1 if c in (10, 13) else max(2, c - 30) if c >= 33 else 2
            continue
        plain = unicodedata.normalize("NFKC", ch)
        cat = unicodedata.category(ch)
        if len(plain) == 1 and 33 <= ord(plain) < 127 and (0xFF00 <= c < 0xFFF0):
            t[c] = ord(plain) - 30
        elif cat == "Zs":
            t[c] = 0
        elif cat in ("Lu", "Lt"):
            t[c] = 98
        elif cat == "Ll":
            t[c] = 99
        elif cat[0] == "L":
            t[c] = 100
        elif cat[0] == "M":
            t[c] = 101
        elif cat[0] == "N":
            t[c] = 102
        elif cat == "Pd":
            t[c] = ord("-") - 30
        elif cat[0] == "P":
            t[c] = 103
    for ch, other in (("º", 104), ("ª", 104), ("ß", 99), ("№", 105)):
        t[ord(ch)] = other
    return t


def encode(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return char_table()[np.minimum(points, 0xFFFF)]


def _inputs(p: dict, x: np.ndarray) -> np.ndarray:
    """[steps, units, windows]: the embedding of each character and a constant one."""
    out = np.ones((x.shape[0], _EMBED + 1, x.shape[1]), np.float32)
    out[:, :_EMBED] = p["emb"][x].transpose(0, 2, 1)
    return out


def _live(lengths: np.ndarray, steps: int) -> np.ndarray:
    """Windows longer than t, for t up to ``steps``; windows are sorted by length, longest first."""
    return np.searchsorted(-lengths, -np.arange(steps + 1), "left")


def _states(w: np.ndarray, inputs: np.ndarray, live: np.ndarray, back: bool, out: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Fills ``out`` with the hidden states [steps, units, windows]; ``back`` runs from each window's end. What a window's states are beyond its end has no meaning."""
    steps, wide, batch = inputs.shape
    n = w.shape[0] // 4
    hx, c = np.zeros((n + wide, batch), np.float32), np.zeros((n, batch), np.float32)
    z, a, s = np.empty((4 * n, batch), np.float32), np.empty((4 * n, batch), np.float32), np.empty((n, batch), np.float32)
    for t in range(steps - 1, -1, -1) if back else range(steps):
        if back and live[t + 1] < batch:
            hx[:n, live[t + 1] :] = 0
            c[:, live[t + 1] :] = 0
        hx[n:] = inputs[t]
        np.matmul(w, hx, out=z)
        np.abs(z, out=a)
        a += 1
        z /= a
        if keep is not None:
            saved = (hx.copy(), z.copy(), a.copy(), c.copy())
        gates = z[: 3 * n]  # input, forget, output; each is doubled
        gates += 1
        c *= z[n : 2 * n]
        np.multiply(z[:n], z[3 * n :], out=s)
        c += s
        c *= 0.5
        np.abs(c, out=s)
        s += 1
        np.divide(c, s, out=s)
        np.multiply(z[2 * n : 3 * n], s, out=out[t])
        out[t] *= 0.5
        hx[:n] = out[t]
        if keep is not None:
            keep.append((t, *saved, c.copy(), s.copy()))
    return out


def emissions(p: dict, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Scores [steps, tags, windows] of class indices ``x`` [steps, windows]."""
    inputs, live, n = _inputs(p, x), _live(lengths, len(x)), p["of"].shape[1]
    both = np.empty((len(x), 2 * n + 1, x.shape[1]), np.float32)
    _states(p["f"], inputs, live, False, both[:, :n])
    _states(p["b"], inputs, live, True, both[:, n : 2 * n])
    both[:, 2 * n] = 1
    return np.matmul(np.concatenate([p["of"], p["ob"], p["o"][:, None]], 1), both)


def transitions(p: dict) -> np.ndarray:
    return np.where(ALLOWED, p["trans"], _NEVER).astype(np.float32)


def _first(e: np.ndarray) -> np.ndarray:
    """Scores of the first character: no span goes on there."""
    out = e[0].copy()
    out[2::2] += _NEVER
    return out


def viterbi(e: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags [steps, windows] of emissions [steps, tags, windows] under the transitions."""
    steps, k, batch = e.shape
    score = np.empty_like(e)
    score[0] = _first(e)
    tags_in, opens = np.arange(2, k, 2), trans[1:, 1::2, None]
    on, more, close = trans[tags_in - 1, tags_in][:, None], trans[tags_in, tags_in][:, None], trans[1:, 0, None]
    m = np.empty((k - 1, k // 2, batch), np.float32)
    for t in range(1, steps):
        old, new = score[t - 1], score[t]
        # a span goes on from its own kind only, it opens from any tag, and any tag can end
        np.maximum(old[1::2] + on, old[2::2] + more, out=new[2::2])
        np.add(old[1:, None, :], opens, out=m)
        np.maximum(m.max(0), old[0] + trans[0, 1::2, None], out=new[1::2])
        np.maximum(old[0] + trans[0, 0], (old[1:] + close).max(0), out=new[0])
        new += e[t]
    tags = np.zeros((steps, batch), np.int8)
    now = np.zeros(batch, np.int64)
    for t in range(steps - 1, -1, -1):
        last = t == lengths - 1
        if t < steps - 1:  # the step before the one just tagged
            now = (score[t] + trans[:, now]).argmax(0)
        if last.any():
            now = np.where(last, score[t].argmax(0), now)
        tags[t] = now
        tags[t, t >= lengths] = 0
    return tags


def decode(p: dict, windows: list[np.ndarray], batch: int = 512) -> list[np.ndarray | None]:
    """Tags of each window, or None where all are outside; windows are decoded in batches of similar length."""
    out: list[np.ndarray | None] = [None] * len(windows)
    trans = transitions(p)
    order = sorted(range(len(windows)), key=lambda i: -len(windows[i]))
    for at in range(0, len(order), batch):
        some = order[at : at + batch]
        lengths = np.array([len(windows[i]) for i in some])
        x = np.zeros((lengths[0], len(some)), np.int16)
        for j, i in enumerate(some):
            x[: lengths[j], j] = windows[i]
        tags = viterbi(emissions(p, x, lengths), lengths, trans)
        for j in np.flatnonzero(tags.any(0)):
            out[some[j]] = tags[: lengths[j], j].copy()
    return out


def new_params(hidden: int, seed: int = 3) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    f32 = lambda a: np.asarray(a, np.float32)
    p = {"emb": f32(rng.normal(size=(_CLASSES, _EMBED)) * 0.7)}
    for d in "fb":
        w = rng.normal(size=(4 * hidden, hidden + _EMBED + 1)) / np.sqrt(hidden / 2)
        w[:, -1] = 0
        w[hidden : 2 * hidden, -1] = 1.5  # remember at first
        p[d] = f32(w)
        p["o" + d] = f32(rng.normal(size=(N_TAGS, hidden)) / np.sqrt(hidden))
    p["o"] = np.zeros(N_TAGS, np.float32)
    p["trans"] = np.zeros((N_TAGS, N_TAGS), np.float32)
    return p


def _crf(e: np.ndarray, lengths: np.ndarray, y: np.ndarray, trans: np.ndarray):
    """Negative log likelihood a character and its gradients, by forward and backward sums scaled at each step."""
    steps, k, batch = e.shape
    rows, a = np.arange(batch), np.exp(trans.astype(e.dtype))
    first = e.copy()
    first[0] = _first(e)
    top = first.max(1, keepdims=True)
    q = np.exp(first - top)
    alpha, scale = np.zeros_like(e), np.ones((steps, batch), e.dtype)
    for t in range(steps):
        on = t < lengths
        v = q[t] if t == 0 else (a.T @ alpha[t - 1]) * q[t]
        scale[t] = np.where(on, v.sum(0), 1)
        alpha[t] = np.where(on, v / scale[t], alpha[t - 1] if t else 0)
    beta = np.ones_like(e)
    for t in range(steps - 2, -1, -1):
        b = a @ (q[t + 1] * beta[t + 1] / scale[t + 1])
        beta[t] = np.where(t + 1 < lengths, b, 1)
    inside = np.arange(steps)[:, None] < lengths[None]
    z = (np.log(scale) + top[:, 0] * inside).sum()
    ge = alpha * beta * inside[:, None]
    at, col = np.nonzero(inside)
    gold = first[at, y[at, col], col].sum()
    ge[at, y[at, col], col] -= 1
    right = q[1:] * beta[1:] / scale[1:, None] * inside[1:, None]
    gt = a * np.einsum("tib,tjb->ij", alpha[:-1], right, optimize=True)
    at, col = np.nonzero(inside[1:])
    steps_taken = np.bincount(y[at, col].astype(np.int64) * k + y[at + 1, col], minlength=k * k).reshape(k, k)
    gold += (trans * steps_taken).sum()
    n = lengths.sum()
    return (z - gold) / n, ge / n, np.where(ALLOWED, gt - steps_taken, 0) / n


def _states_back(w: np.ndarray, saved: list, gh_out: np.ndarray, live: np.ndarray, back: bool):
    """Gradients by the weights and by the inputs, from those by the hidden states."""
    n, batch = w.shape[0] // 4, gh_out.shape[2]
    gz, wh = np.empty((len(saved), 4 * n, batch), w.dtype), np.ascontiguousarray(w[:, :n].T)
    gh, gc = np.zeros((n, batch), w.dtype), np.zeros((n, batch), w.dtype)
    for t, _, z, a, old, c, s in reversed(saved):
        half = (1 + z[: 3 * n]) / 2
        i, f, o = half[:n], half[n : 2 * n], half[2 * n :]
        dh = gh_out[t] + gh
        dc = gc + dh * o / (1 + np.abs(c)) ** 2
        dz = gz[t]
        np.multiply(dc, z[3 * n :] / 2, out=dz[:n])
        np.multiply(dc, old / 2, out=dz[n : 2 * n])
        np.multiply(dh, s / 2, out=dz[2 * n : 3 * n])
        np.multiply(dc, i, out=dz[3 * n :])
        dz /= a
        dz /= a
        gh, gc = wh @ dz, dc * f
        if back and live[t + 1] < batch:
            gh[:, live[t + 1] :] = 0
            gc[:, live[t + 1] :] = 0
    hx = np.empty((len(saved), w.shape[1], batch), w.dtype)
    for t, h, *_ in saved:
        hx[t] = h
    gw = np.einsum("tib,tjb->ij", gz, hx, optimize=True)
    return gw, np.matmul(w[:, n:].T, gz)


def loss_and_grad(p: dict, x: np.ndarray, lengths: np.ndarray, y: np.ndarray):
    inputs, live, sf, sb = _inputs(p, x).astype(p["f"].dtype), _live(lengths, len(x)), [], []
    f, b = (np.empty((len(x), p["of"].shape[1], x.shape[1]), np.float32) for _ in range(2))
    _states(p["f"], inputs, live, False, f, sf)
    _states(p["b"], inputs, live, True, b, sb)
    e = np.matmul(p["of"], f) + np.matmul(p["ob"], b) + p["o"][None, :, None]
    loss, ge, gt = _crf(e.astype(np.float64), lengths, y, transitions(p))
    ge = ge.astype(p["f"].dtype)
    g = {"trans": gt.astype(p["f"].dtype), "o": ge.sum((0, 2)), "of": np.einsum("tkb,thb->kh", ge, f, optimize=True), "ob": np.einsum("tkb,thb->kh", ge, b, optimize=True)}
    g["f"], xf = _states_back(p["f"], sf, np.matmul(p["of"].T, ge), live, False)
    g["b"], xb = _states_back(p["b"], sb, np.matmul(p["ob"].T, ge), live, True)
    flat, at = (xf + xb)[:, :_EMBED].transpose(1, 0, 2).reshape(_EMBED, -1), x.ravel()
    g["emb"] = np.stack([np.bincount(at, row, _CLASSES) for row in flat], 1).astype(p["f"].dtype)
    return loss, g


def _batch(codes: list[np.ndarray], labels: list[np.ndarray], some: list[int]):
    some = sorted(some, key=lambda i: -len(codes[i]))
    lengths = np.array([len(codes[i]) for i in some])
    x, y = np.zeros((lengths[0], len(some)), np.int16), np.zeros((lengths[0], len(some)), np.int8)
    for j, i in enumerate(some):
        x[: lengths[j], j], y[: lengths[j], j] = codes[i], labels[i]
    return x, lengths, y


def _worker(pipe, codes, labels) -> None:
    while (job := pipe.recv()) is not None:
        p, some = job
        pipe.send(loss_and_grad(p, *_batch(codes, labels, some)))


def fit(samples: list[tuple[str, np.ndarray]], hidden: int = 32, epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 5, params: dict | None = None, workers: int = 1, log=None) -> dict[str, np.ndarray]:
    """Adam on labelled texts ``(text, tag of each character)``; ``workers`` processes share the batches of a step."""
    import multiprocessing

    p = params or new_params(hidden)
    rng = np.random.default_rng(seed)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    codes, labels = [encode(t) for t, _ in samples], [y for _, y in samples]
    pipes = []
    if workers > 1:
        ctx = multiprocessing.get_context("spawn")  # other threads may run, as those of a session
        for _ in range(workers):
            mine, theirs = ctx.Pipe()
            ctx.Process(target=_worker, args=(theirs, codes, labels), daemon=True).start()
            pipes.append(mine)
    total = epochs * -(-len(samples) // (batch * workers))
    for epoch in range(epochs):
        # texts of like length go together, so that the processes of a step end at the same time
        by_length = sorted(range(len(samples)), key=lambda i: len(codes[i]) + rng.random() * 25)
        groups = [by_length[i : i + batch * workers] for i in range(0, len(by_length), batch * workers)]
        groups = [groups[i] for i in rng.permutation(len(groups))]
        losses = []
        for group in groups:
            now = [group[i : i + batch] for i in range(0, len(group), batch)]
            if pipes:
                for pipe, some in zip(pipes, now, strict=False):
                    pipe.send((p, some))
                got = [pipe.recv() for pipe, _ in zip(pipes, now, strict=False)]
            else:
                got = [loss_and_grad(p, *_batch(codes, labels, some)) for some in now]
            g = {k: sum(d[k] for _, d in got) / len(got) for k in p}
            losses += [loss for loss, _ in got]
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            lr = rate * min(1, step / 100) * (1 - 0.97 * step / (total + 1))
            for k in p:
                d = g[k] * min(1.0, 1.0 / norm)
                m1[k] = 0.9 * m1[k] + 0.1 * d
                m2[k] = 0.99 * m2[k] + 0.01 * d * d
                p[k] = (p[k] - lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        if log:
            log(f"epoch {epoch} loss {np.mean(losses):.5f}")
    for pipe in pipes:
        pipe.send(None)
    return p


def save(p: dict, path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in p.items()})


@functools.cache
def load(path: Path = WEIGHTS) -> dict[str, np.ndarray]:
    with np.load(path) as z:
        return {k: z[k].astype(np.float32) for k in z.files}
