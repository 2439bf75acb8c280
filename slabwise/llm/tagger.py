"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

KINDS = ("email", "phone", "id_number", "address", "name")
TAGS = 1 + 2 * len(KINDS)  # O, then begin and inside of each kind
BATCH = 32
UNKNOWN = 255  # a label that leaves the tag open
_OTHER = {"Lu": 96, "Ll": 97, "L": 98, "N": 99, "P": 100, "Z": 101, "M": 102}
ALPHABET = 105  # 0 pads; printable ASCII; classes of other characters


def _class(cp: int) -> int:
    import unicodedata

    if 32 <= cp < 127:
        return cp - 31
    if cp in (10, 13):
        return 103
    c = unicodedata.category(chr(cp))
    return _OTHER.get(c, _OTHER.get(c[0], 104))


_CODES = np.array([_class(c) if not 0xD800 <= c < 0xE000 else 104 for c in range(0x3000)], np.uint8)


def codes(text: str) -> np.ndarray:
    """The character class of every character of the whole text."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(cp < len(_CODES), _CODES[np.minimum(cp, len(_CODES) - 1)], 98).astype(np.uint8)


def _gates(z: np.ndarray, h: int) -> tuple[np.ndarray, ...]:
    """Input, forget, output gate and candidate of pre-activations; one tanh for all."""
    z[..., : 3 * h] *= 0.5
    np.tanh(z, out=z)
    z[..., : 3 * h] *= 0.5
    z[..., : 3 * h] += 0.5
    return z[..., :h], z[..., h : 2 * h], z[..., 2 * h : 3 * h], z[..., 3 * h :]


class Tagger:
    """Both directions run in one loop: arrays have the direction as their first axis."""

    def __init__(self, hidden: int = 40, seed: int = 7):
        rng = np.random.default_rng(seed)
        h, f = hidden, np.float32
        self.h = h
        self.p = {
            "X": rng.normal(0, 0.3, (2, ALPHABET, 4 * h)).astype(f), "U": (rng.normal(0, 1, (2, h, 4 * h)) / np.sqrt(h)).astype(f),
            "V": (rng.normal(0, 1, (2 * h, TAGS)) / np.sqrt(2 * h)).astype(f), "b": np.zeros(TAGS, f), "A": np.zeros((TAGS, TAGS), f),
        }
        self.p["X"][:, :, h : 2 * h] += 1.0
        self.p["b"][0] = 1.0

    # ---- forward -----------------------------------------------------------

    def _run(self, ids: np.ndarray, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, batch, 2h) of ids (batch, time)."""
        n, t = ids.shape
        h = self.h
        both = np.stack([ids.T, ids.T[::-1]])  # direction, time, batch
        out = np.empty((t, n, 2 * h), np.float32)
        state, cell = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        x, u = self.p["X"], self.p["U"]
        z = np.empty((2, n, 4 * h), np.float32)
        padded = (both == 0).any((0, 2))
        for s in range(t):
            np.matmul(state, u, out=z)
            z[0] += x[0].take(both[0, s], 0)
            z[1] += x[1].take(both[1, s], 0)
            i, f, o, g = _gates(z, h)
            if keep is not None:
                keep.append((z.copy(), cell.copy(), state))
            cell = cell * f
            cell += i * g
            if padded[s]:  # nothing is carried over from behind a text's end
                cell *= (both[:, s] > 0)[:, :, None]
            state = np.tanh(cell)
            state *= o
            out[s, :, :h] = state[0]
            out[t - 1 - s, :, h:] = state[1]
        return out

    def scores(self, ids: np.ndarray) -> np.ndarray:
        """Tag scores (time, batch, tags)."""
        return self._run(ids) @ self.p["V"] + self.p["b"]

    def decode(self, ids: np.ndarray, lean: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """The best tag sequence of each row with `lean` added for every mention that begins, and by how
        much each tag's own score exceeds that of O."""
        e = self.scores(ids)
        v = np.ascontiguousarray(e.transpose(0, 2, 1))  # time, tag, row: vector operations run along rows
        v[:, 1::2] += lean
        a = self._transitions()
        t, k, n = v.shape
        free, inside = np.r_[0, 1:k:2], np.arange(2, k, 2)
        into = np.ascontiguousarray(a[:, free].T)[:, :, None]
        begun, kept = a[inside - 1, inside][:, None], a[inside, inside][:, None]
        for s in range(1, t):
            p = v[s - 1]
            v[s, free] += (p[None] + into).max(1)
            v[s, inside] += np.maximum(p[inside - 1] + begun, p[inside] + kept)
        tags = np.empty((t, n), np.uint8)
        tags[-1] = v[-1].argmax(0)
        for s in range(t - 1, 0, -1):  # the step into the chosen tag only is looked up again
            tags[s - 1] = (v[s - 1] + a[:, tags[s]]).argmax(0)
        margin = np.take_along_axis(e, tags[:, :, None].astype(np.int64), 2)[:, :, 0] - e[:, :, 0]
        return tags.T, margin.T

    def _transitions(self) -> np.ndarray:
        """Learned transitions; an inside tag only follows its own kind."""
        a = self.p["A"].copy()
        for k in range(len(KINDS)):
            inside = 2 + 2 * k
            for f in range(TAGS):
                if f not in (inside - 1, inside):
                    a[f, inside] = -30.0
        return a

    # ---- training ----------------------------------------------------------

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood per character and its gradients. Where a tag is UNKNOWN, every
        tag agrees with the labels: the likelihood sums over all of them."""
        n, t = ids.shape
        h, keep = self.h, []
        hidden = self._run(ids, keep)
        e = hidden @ self.p["V"] + self.p["b"]
        ea = np.exp(self._transitions())
        peak = e.max(2, keepdims=True)
        agrees = (tags.T[:, :, None] == np.arange(TAGS)) | (tags.T == UNKNOWN)[:, :, None]
        ee = np.exp(e - peak)
        ee = np.concatenate([ee, ee * agrees], 1)  # all sequences, then those that agree with the labels
        alpha, scale = np.empty_like(ee), np.empty((t, 2 * n, 1), np.float32)
        cur = ee[0]
        for s in range(t):
            if s:
                cur = (alpha[s - 1] @ ea) * ee[s]
            scale[s] = cur.sum(1, keepdims=True)
            alpha[s] = cur / scale[s]
        beta = np.ones((t, 2 * n, TAGS), np.float32)
        w = ee[1:] / scale[1:]
        for s in range(t - 2, -1, -1):
            w[s] *= beta[s + 1]
            beta[s] = w[s] @ ea.T
        before = alpha[:-1].copy()
        before[:, n:] *= -1
        counts = np.tensordot(before, w, ((0, 1), (0, 1)))
        marginal = alpha * beta
        size = float(n * t)
        ll = float((np.log(scale[:, n:]) - np.log(scale[:, :n])).sum(dtype=np.float64))
        de = ((marginal[:, :n] - marginal[:, n:]) / size).astype(np.float32)
        g = {"A": (counts * ea / size).astype(np.float32), "b": de.sum((0, 1)), "V": hidden.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS)}
        dh = (de.reshape(-1, TAGS) @ self.p["V"].T).reshape(t, n, 2 * h)
        gx = np.zeros_like(self.p["X"])
        both = np.stack([ids.T, ids.T[::-1]])
        ds, dc = np.zeros((2, n, h), np.float32), np.zeros((2, n, h), np.float32)
        ut = np.ascontiguousarray(self.p["U"].transpose(0, 2, 1))
        dzs = np.empty((t, 2, n, 4 * h), np.float32)
        inside = (both > 0)[..., None]
        padded = not inside.all()
        for s in range(t - 1, -1, -1):
            z, old, _ = keep[s]
            i, f, o, c = (z[..., k * h : (k + 1) * h] for k in range(4))
            ds[0] += dh[s, :, :h]
            ds[1] += dh[t - 1 - s, :, h:]
            cell = old * f
            cell += i * c
            if padded:
                cell *= inside[:, s]
            th = np.tanh(cell)
            dc += ds * o * (1 - th * th)
            if padded:
                dc *= inside[:, s]
            dz = dzs[s]
            dz[..., : 3 * h] = z[..., : 3 * h]
            dz[..., : 3 * h] *= 1 - z[..., : 3 * h]
            dz[..., :h] *= dc * c
            dz[..., h : 2 * h] *= dc * old
            dz[..., 2 * h : 3 * h] *= ds * th
            np.multiply(dc * i, 1 - c * c, out=dz[..., 3 * h :])
            ds = dz @ ut
            dc = dc * f
        prev = np.stack([k[2] for k in keep])
        gu = np.stack([prev[:, d].reshape(-1, h).T @ dzs[:, d].reshape(-1, 4 * h) for d in range(2)])
        for d in range(2):  # sums of the steps of each character
            flat = both[d].reshape(-1)
            order = np.argsort(flat, kind="stable")
            first = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
            gx[d, flat[order[first]]] = np.add.reduceat(dzs[:, d].reshape(-1, 4 * h)[order], first)
        g["X"], g["U"] = gx, gu
        return -ll / size, g

    # Adam, a stretch of steps at a time ---------------------------------------

    def advance(self, ids: np.ndarray, tags: np.ndarray, moments: dict[str, np.ndarray], begin: int, steps: int, rate: float, batch: int = BATCH) -> float:
        """Adam steps over the windows in their order; begin of steps have been made before, which sets
        the rate. moments has the running means ('m' + name, 'v' + name) and is brought
        forward. The mean loss."""
        losses = []
        for step, at in enumerate(range(0, len(ids), batch), begin + 1):
            loss, g = self.gradients(ids[at : at + batch], tags[at : at + batch])
            losses.append(loss)
            norm = float(np.sqrt(sum((x.astype(np.float64) ** 2).sum() for x in g.values())))
            shrink = min(1.0, 1.0 / (norm + 1e-9))
            lr = rate * min(1.0, step / 20) * (0.05 + 0.95 * 0.5 * (1 + np.cos(np.pi * min(1.0, step / steps))))
            for k in self.p:
                x = g[k] * shrink
                m = moments["m" + k] = 0.9 * moments.get("m" + k, 0.0) + 0.1 * x
                v = moments["v" + k] = 0.99 * moments.get("v" + k, 0.0) + 0.01 * x * x
                self.p[k] = self.p[k] - (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return float(np.mean(losses))


SHARDS = 6  # of the windows, one per task; the trained model depends on this number, not on the cluster
Job = tuple[dict, dict, int, int, int, float]  # parameters, moments, shard, round, rounds, rate


def shard_round(job: Job, ids: np.ndarray, tags: np.ndarray) -> tuple[dict, dict]:
    """Parameters and moments after one shard's windows of one round. The windows are dealt anew in
    every round, the same way wherever the task runs."""
    params, moments, shard, round_, rounds, rate = job
    model = Tagger()
    model.p, moments = dict(params), dict(moments)
    mine = np.random.default_rng(1000 + round_).permutation(len(ids))[shard::SHARDS]
    each = -(-(-(-len(ids) // SHARDS)) // BATCH)
    model.advance(ids[mine], tags[mine], moments, round_ * each, rounds * each, rate)
    return model.p, moments


def fit(model: Tagger, ids: np.ndarray, tags: np.ndarray, rounds: int, rate: float, runner: Callable[[list[Job], np.ndarray, np.ndarray], list[tuple[dict, dict]]] | None = None) -> Tagger:
    """Trains on windows ids with labels tags: in each round every shard goes through its windows
    from the same start, and the results are averaged. runner carries out the jobs of a round,
    one after the other if none is given."""
    runner = runner or (lambda jobs, ids, tags: [shard_round(j, ids, tags) for j in jobs])
    moments: dict[str, np.ndarray] = {}
    shards = min(SHARDS, len(ids))
    for r in range(rounds):
        got = runner([(model.p, moments, s, r, rounds, rate) for s in range(shards)], ids, tags)
        model.p, moments = ({k: (sum(x[i][k] for x in got) / len(got)).astype(np.float32) for k in got[0][i]} for i in (0, 1))
    return model


WINDOW, OVERLAP = 256, 48


def tag_texts(model: Tagger, texts: list[str], lean: float = 0.0, batch: int = 384) -> list[tuple[np.ndarray, np.ndarray]]:
    """Tag and margin of every character (see Tagger.decode). Long texts are cut into overlapping
    windows; of two windows that hold a character, the one in which it lies further from the
    edge decides."""
    step = WINDOW - OVERLAP
    coded = [codes(t) for t in texts]
    where = [(i, at) for i, c in enumerate(coded) for at in range(0, max(1, len(c) - OVERLAP), step) if len(c)]
    where.sort(key=lambda x: min(WINDOW, len(coded[x[0]]) - x[1]))  # short windows together
    out = [(np.zeros(len(c), np.uint8), np.zeros(len(c), np.float32)) for c in coded]
    for b in range(0, len(where), batch):
        part = where[b : b + batch]
        width = max(min(WINDOW, len(coded[i]) - at) for i, at in part)
        ids = np.zeros((len(part), width), np.uint8)
        for r, (i, at) in enumerate(part):
            piece = coded[i][at : at + width]
            ids[r, : len(piece)] = piece
        tags, margin = model.decode(ids, lean)
        for r, (i, at) in enumerate(part):
            n = len(coded[i])
            lo = at + (OVERLAP // 2 if at else 0)
            hi = min(at + width, n) if at + WINDOW >= n else at + WINDOW - OVERLAP // 2
            out[i][0][lo:hi] = tags[r, lo - at : hi - at]
            out[i][1][lo:hi] = margin[r, lo - at : hi - at]
    return out


def spans(tags: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of every tagged run."""
    if not tags.any():
        return []
    kind = (tags.astype(np.int16) + 1) // 2
    starts = np.flatnonzero((kind > 0) & ((tags % 2 == 1) | np.r_[True, kind[1:] != kind[:-1]]))
    out = []
    for k, s in enumerate(starts):
        limit = starts[k + 1] if k + 1 < len(starts) else len(tags)
        e = s + 1
        while e < limit and kind[e] == kind[s]:
            e += 1
        out.append((int(kind[s]) - 1, int(s), int(e)))
    return out
