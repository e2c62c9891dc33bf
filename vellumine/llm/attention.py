"""A causal self-attention language model over subword ids, in numpy: training, and scoring of whole texts.

A token is a subword id of a public vocabulary with a flag for the last one of its word, so the tokens of a word spell
it and end it. The ``CLASSES - 2`` most frequent tokens, the end of text and "any other token" are classes; other
tokens are equally likely within theirs. The softmax has two levels: groups of classes, and the classes of a group.

Cases: texts come as token numbers, one after the other. A text without words is its END alone; texts of any length are
scored window by window; without any text the weights stay as they were drawn, and every class is then about as likely.
"""

import base64
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken

WIDTH, HIDDEN, WINDOW, OVERLAP = 32, 64, 32, 8
GROUPS, MEMBERS = 32, 32
CLASSES = GROUPS * MEMBERS
END, RARE, START = CLASSES - 2, CLASSES - 1, CLASSES  # START is an input only
STEPS, BATCH, RATE, SEED = 2000, 96, 4e-3, 5
CHUNK = 128  # windows scored at a time: their arrays fit a core's second cache
RUN = 128  # rows multiplied at a time: matrices so small are multiplied where they lie, larger ones are copied into panels first


def pieces_of(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}


def spellings(ranks: bytes) -> pa.Array:
    """Bytes of every subword id."""
    table = {i: piece for piece, i in pieces_of(ranks).items()}
    return pa.array([table.get(i, b"") for i in range(max(table) + 1)], pa.binary())


def joined(pieces: pa.Array, tokens: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The words that tokens spell, ``sizes`` of them a word."""
    flat = pieces.take(pa.array(tokens // 2))
    _, offsets, data = flat.buffers()
    ends = np.frombuffer(offsets, np.int32)[: len(tokens) + 1]
    begin = np.concatenate(([0], np.cumsum(sizes)))
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends[begin].astype(np.int32).tobytes()), data)


class Subwords:
    """Subword ids of single words under a fixed vocabulary of ranks (lines "base64 rank")."""

    def __init__(self, ranks: bytes):
        table = pieces_of(ranks)
        self.size, self.gap = max(table.values()) + 1, table[b" "]
        self.code = tiktoken.Encoding("subwords", pat_str=r"[^ ]+| ", mergeable_ranks=table, special_tokens={})

    def tokens(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens (2 id + 1 if last of its word) of all words, and where each word's begin (with the end)."""
        if not words:
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        ids = np.array(self.code.encode_ordinary(" ".join(words)), np.int64)
        gaps = np.flatnonzero(ids == self.gap)
        last = np.concatenate((gaps, [len(ids)])) - 1
        flags = np.zeros(len(ids), np.int64)
        flags[last] = 1
        kept = np.delete(2 * ids + flags, gaps)
        return kept, np.concatenate(([0], last + 1 - np.arange(len(last))))


class Classes:
    """Class of each token: rank by frequency, in an order that puts classes of like neighbours into one group."""

    def __init__(self, tokens: list[np.ndarray], vocabulary: int):
        counts = np.bincount(np.concatenate(tokens) if tokens else np.empty(0, np.int64), minlength=2 * vocabulary)
        self._rank(np.argsort(-counts, kind="stable"), vocabulary)
        self.arrange(sum((neighbours(np.concatenate((self.of[t], [END]))) for t in tokens), np.zeros((CLASSES, CLASSES), np.int64)))

    @classmethod
    def counted(cls, common: list[int], vocabulary: int) -> "Classes":
        """From the commonest tokens, the most frequent first; ``arrange`` has to follow."""
        self = cls.__new__(cls)
        common = np.array(common, np.int64)
        self._rank(np.concatenate((common, np.setdiff1d(np.arange(min(2 * vocabulary, CLASSES + len(common))), common))), vocabulary)
        return self

    def _rank(self, order: np.ndarray, vocabulary: int) -> None:
        top = order[: CLASSES - 2]
        self.of = np.full(2 * vocabulary, RARE)
        self.of[top] = np.arange(len(top))
        self.log_rare = -float(np.log(max(1, 2 * vocabulary - len(top))))  # all other tokens alike

    def arrange(self, follows: np.ndarray) -> None:
        self.order = self._arranged(np.log1p(follows) - np.log1p(follows.sum(1, keepdims=True)) * 0.5, np.log1p(follows.T))
        self.slot = np.empty(CLASSES, np.int64)  # class -> place in the arrangement: group and member
        self.slot[self.order] = np.arange(CLASSES)

    @staticmethod
    def _arranged(after: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Classes halved again and again along the main direction in which their neighbours differ."""
        both = np.concatenate((after, before), axis=1)

        def split(rows: np.ndarray) -> np.ndarray:
            if len(rows) <= MEMBERS:
                return rows
            x = both[rows] - both[rows].mean(0)
            v = np.ones(x.shape[1]) / np.sqrt(x.shape[1])
            v[::2] *= 0.5
            for _ in range(12):
                v = x.T @ (x @ v)
                v /= np.linalg.norm(v) + 1e-12
            order = rows[np.argsort(x @ v, kind="stable")]
            return np.concatenate((split(order[: len(order) // 2]), split(order[len(order) // 2 :])))

        return split(np.arange(CLASSES))


def neighbours(classes: np.ndarray) -> np.ndarray:
    """How often each class (column) comes after each (row) in texts that stand one after the other, each with its END."""
    before = np.concatenate(([END], classes[:-1]))
    return np.bincount(before * CLASSES + classes, minlength=CLASSES * CLASSES).reshape(CLASSES, CLASSES)


def initial(rng: np.random.Generator) -> dict[str, np.ndarray]:
    def w(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    d, z = WIDTH, np.zeros
    return {
        "embed": w(CLASSES + 1, d, scale=0.3), "place": w(WINDOW, d, scale=0.1), "qkv": w(d, 3 * d, scale=d**-0.5), "out": w(d, d, scale=0.5 * d**-0.5),
        "in": w(d, HIDDEN, scale=d**-0.5), "in_b": z(HIDDEN, np.float32), "up": w(HIDDEN, d, scale=0.5 * HIDDEN**-0.5),
        "group": w(d, GROUPS, scale=0.3 * d**-0.5), "group_b": z(GROUPS, np.float32), "member": w(GROUPS, d, MEMBERS, scale=0.3 * d**-0.5), "member_b": z((GROUPS, MEMBERS), np.float32),
    }


def product(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``x @ w`` of many rows, run by run."""
    n, w = len(x) // RUN * RUN, np.ascontiguousarray(w)
    out = np.empty((len(x), w.shape[1]), x.dtype)
    np.matmul(x[:n].reshape(-1, RUN, w.shape[0]), w, out=out[:n].reshape(-1, RUN, w.shape[1]))
    np.matmul(x[n:], w, out=out[n:])
    return out


def across(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` over many rows, run by run."""
    n, a, b = len(x) // RUN, x.shape[1], y.shape[1]
    parts = np.matmul(x[: n * RUN].reshape(-1, RUN, a).transpose(0, 2, 1), y[: n * RUN].reshape(-1, RUN, b))
    out = x[n * RUN :].T @ y[n * RUN :]
    out += (np.ones(n, y.dtype) @ parts.reshape(n, a * b)).reshape(a, b)
    return out


def scaled(qkv: np.ndarray) -> np.ndarray:
    """With the scale of the scores in the queries."""
    return np.concatenate((qkv[:, :WIDTH] * qkv.dtype.type(WIDTH**-0.5), qkv[:, WIDTH:]), axis=1)


def turned(x: np.ndarray) -> np.ndarray:
    """Each matrix transposed, in memory too: products of many small matrices are faster so."""
    return np.ascontiguousarray(x.transpose(0, 2, 1))


CAUSAL = np.tril(np.ones((WINDOW, WINDOW), np.float32))


def attend(p: dict[str, np.ndarray], inputs: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
    """States of all places, window by window, or of ``rows`` of these, after masked attention and the hidden layer."""
    n, d = len(inputs), WIDTH
    x = p["embed"].take(inputs, axis=0)
    x += p["place"]
    qkv = product(x.reshape(-1, d), scaled(p["qkv"])).reshape(n, WINDOW, 3 * d)
    q, k, v = qkv[:, :, :d], qkv[:, :, d : 2 * d], qkv[:, :, 2 * d :]
    s = np.matmul(q, turned(k))
    np.clip(s, -80, 80, out=s)
    np.exp(s, out=s)
    s *= CAUSAL
    s /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32)).reshape(n, WINDOW, 1)
    a, h = np.matmul(s, v).reshape(-1, d), x.reshape(-1, d)
    if rows is not None:
        a, h = a.take(rows, axis=0), h.take(rows, axis=0)
    h = h + product(a, p["out"])
    r = product(h, p["in"])
    r += p["in_b"]
    np.clip(r, 0, np.inf, out=r)  # takes less than the maximum with 0
    y = product(r, p["up"])
    y += h
    return y, (x, q, k, v, s, a, h, r)


def log_softmax_at(logits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Without the row maxima, which cost more than all the rest: exponents are kept in range by the clip."""
    np.clip(logits, -80, 80, out=logits)
    picked = logits.ravel().take(np.arange(len(at)) * logits.shape[1] + at)
    return picked - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))


def by_group(slots: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, slice]]]:
    """An order of the targets by group, their groups in it, and where each group that occurs stands."""
    group = (slots // MEMBERS).astype(np.int8)
    order = np.argsort(group, kind="stable")
    group = group[order]
    ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return order, group.astype(np.int64), [(c, slice(ends[c], ends[c + 1])) for c in range(GROUPS) if ends[c] < ends[c + 1]]


def both_logits(p: dict[str, np.ndarray], y: np.ndarray, group: np.ndarray, own: list[tuple[int, slice]]) -> np.ndarray:
    """Logits of the groups and, below them, of the members of each target's group, for one softmax over all."""
    n = len(y)
    out = np.empty((2 * n, MEMBERS), y.dtype)
    np.add(product(y, p["group"]), p["group_b"], out=out[:n])
    members = out[n:]
    for c, at in own:
        np.matmul(y[at], p["member"][c], out=members[at])
    members += p["member_b"].take(group, axis=0)
    return out


def token_logs(p: dict[str, np.ndarray], states: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """log P of each target (place in the arrangement), states row by row."""
    n = len(slots)
    order, group, own = by_group(slots)
    logs = log_softmax_at(both_logits(p, states.take(order, axis=0), group, own), np.concatenate((group, slots[order] % MEMBERS)))
    out = np.empty(n, logs.dtype)
    out[order] = logs[:n] + logs[n:]
    return out


def tables(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Queries, keys and values of every class and of every place: both enter linearly, so they are looked up and added."""
    d, scale = WIDTH, np.float32(WIDTH**-0.5)
    out = {}
    for name, weights in (("embed", p["embed"] @ p["qkv"]), ("place", p["place"] @ p["qkv"])):
        out[name] = {"q": weights[:, :d] * scale, "k": np.ascontiguousarray(weights[:, d : 2 * d]), "v": np.ascontiguousarray(weights[:, 2 * d :])}
    return out


def scored_states(p: dict[str, np.ndarray], t: dict[str, dict[str, np.ndarray]], inputs: np.ndarray, since: int, valid: np.ndarray) -> np.ndarray:
    """States of the places from ``since`` on of each window where ``valid``; the places before are context only."""
    n, d = len(inputs), WIDTH
    own = np.ascontiguousarray(inputs[:, since:]).ravel()
    q = t["embed"]["q"].take(own, axis=0).reshape(n, -1, d)
    q += t["place"]["q"][since:]
    k, v = (t["embed"][x].take(inputs.ravel(), axis=0).reshape(n, WINDOW, d) for x in "kv")
    k += t["place"]["k"]
    v += t["place"]["v"]
    s = np.matmul(q, turned(k))
    np.clip(s, -80, 80, out=s)
    np.exp(s, out=s)
    s *= CAUSAL[since:]
    a = np.matmul(s, v).reshape(-1, d)
    a /= (s.reshape(-1, WINDOW) @ np.ones(WINDOW, np.float32))[:, None]
    place = np.arange(len(own)) % (WINDOW - since) + since
    rows = np.flatnonzero(valid.ravel())
    if len(rows) < len(own):
        own, place, a = own[rows], place[rows], a.take(rows, axis=0)
    h = p["embed"].take(own, axis=0)
    h += p["place"].take(place, axis=0)
    h += product(a, p["out"])
    r = product(h, p["in"])
    r += p["in_b"]
    np.clip(r, 0, np.inf, out=r)  # takes less than the maximum with 0
    h += product(r, p["up"])
    return h


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First position of each window over texts of these many tokens, one after the other; and the text of each.

    The first window of a text scores all its tokens, each later one those after the overlap: every token once.
    """
    step = WINDOW - OVERLAP
    n = np.where(lengths > 0, 1 + np.maximum(0, -(-(lengths - WINDOW) // step)), 0)
    text = np.repeat(np.arange(len(lengths)), n)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else lengths
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return first[text] + k * step, text


def sequence_logs(p: dict[str, np.ndarray], slot_of: np.ndarray, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log P of every token of texts that stand one after the other (each with its END)."""
    starts, text = windows(lengths)
    ends = np.cumsum(lengths)
    first = ends - lengths
    inputs = np.concatenate(([START], classes[:-1]))
    inputs[first[lengths > 0]] = START
    t = tables(p)
    slots, out, lane = slot_of[classes], np.zeros(len(classes), np.float32), np.arange(WINDOW)
    for since, own in ((0, starts == first[text]), (OVERLAP, starts != first[text])):
        s, stop = starts[own], ends[text[own]]
        for at in range(0, len(s), CHUNK):
            place = s[at : at + CHUNK, None] + lane
            valid = place[:, since:] < stop[at : at + CHUNK, None]
            where = place[:, since:][valid]
            states = scored_states(p, t, inputs[np.minimum(place, len(classes) - 1)], since, valid)
            out[where] = token_logs(p, states, slots[where])
    return out


def gradients(p: dict[str, np.ndarray], inputs: np.ndarray, slots: np.ndarray, valid: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean loss over valid targets and its gradients, by hand. Places without a valid target are context only."""
    d, n, total = WIDTH, len(inputs), int(valid.sum())
    places = np.flatnonzero(valid.ravel())
    rows = None if total > 0.9 * valid.size else places  # nearly all: the few others cost less than to pick these out
    states, (x, q, k, v, s, a, h, r) = attend(p, inputs, rows)
    target = slots.ravel().take(places)
    order, group, own = by_group(target)
    target, at_state = target[order], order if rows is not None else places[order]
    y = states.take(at_state, axis=0)
    g, ones, one_each = {}, np.ones(len(h), y.dtype), np.ones(MEMBERS, y.dtype)

    logits = both_logits(p, y, group, own)
    np.clip(logits, -80, 80, out=logits)
    np.exp(logits, out=logits)
    sums, picks = logits @ one_each, np.arange(2 * total) * MEMBERS + np.concatenate((group, target % MEMBERS))
    loss = -float(np.log(logits.ravel().take(picks) / sums + 1e-30).sum())
    logits *= (1 / (max(1, total) * sums))[:, None]  # now the gradients of the logits
    logits.ravel()[picks] -= 1 / max(1, total)
    dl, dm = logits[:total], logits[total:]

    g["group"], g["group_b"] = across(y, dl), ones[:total] @ dl
    at_target, back = np.empty_like(y), turned(p["member"])
    g["member"], g["member_b"] = np.zeros_like(p["member"]), np.zeros_like(p["member_b"])
    for c, at in own:
        np.matmul(y[at].T, dm[at], out=g["member"][c])
        np.matmul(ones[at], dm[at], out=g["member_b"][c])
        np.matmul(dm[at], back[c], out=at_target[at])
    at_target += product(dl, p["group"].T)
    dy = np.zeros_like(states)
    dy[at_state] = at_target
    g["up"] = across(r, dy)
    dr = product(dy, p["up"].T)
    dr *= r > 0
    g["in"], g["in_b"] = across(h, dr), ones[: len(h)] @ dr
    dy += product(dr, p["in"].T)
    g["out"] = across(a, dy)
    da = product(dy, p["out"].T)
    along = np.einsum("ij,ij->i", da, a)  # what the softmax takes off all scores of a place
    if rows is not None:
        da, along, dy = (spread(z, rows, n * WINDOW) for z in (da, along, dy))
    da = da.reshape(n, WINDOW, d)
    ds, dqkv = np.matmul(da, turned(v)), np.empty((n, WINDOW, 3 * d), y.dtype)
    ds -= along.reshape(n, WINDOW, 1)
    ds *= s
    for at, (left, right) in enumerate(((ds, k), (ds.transpose(0, 2, 1), q), (s.transpose(0, 2, 1), da))):
        np.matmul(left, right, out=dqkv[:, :, at * d : (at + 1) * d])
    dqkv = dqkv.reshape(-1, 3 * d)
    g["qkv"] = across(x.reshape(-1, d), dqkv)
    g["qkv"][:, :d] *= y.dtype.type(d**-0.5)
    dx = product(dqkv, scaled(p["qkv"]).T)
    dx += dy
    g["place"] = (np.ones(n, y.dtype) @ dx.reshape(n, -1)).reshape(WINDOW, d)
    flat = inputs.ravel()
    order = np.argsort(flat.astype(np.int16), kind="stable")
    sorted_ = flat[order]
    cuts = np.flatnonzero(np.concatenate(([True], sorted_[1:] > sorted_[:-1])))
    g["embed"] = np.zeros_like(p["embed"])
    g["embed"][sorted_[cuts]] = np.add.reduceat(dx.take(order, axis=0), cuts, axis=0)
    return loss / max(1, total), g


def spread(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """``values`` at ``rows`` of ``n``, zero elsewhere."""
    out = np.zeros((n, *values.shape[1:]), values.dtype)
    out[rows] = values
    return out


def training_windows(classes: np.ndarray, starts: np.ndarray, ends: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Rows of WINDOW + 1 classes: what is before the window, and its targets; -1 beyond the text's end."""
    around = np.concatenate(([START], classes, np.full(WINDOW, -1))).astype("<i2")
    rows = np.lib.stride_tricks.sliding_window_view(around, WINDOW + 1)[starts]
    rows[starts == firsts, 0] = START
    short = np.flatnonzero(starts + WINDOW > ends)
    rows[short, 1:] = np.where(starts[short, None] + np.arange(WINDOW) < ends[short, None], rows[short, 1:], -1)
    return rows


def fresh_state(seed: int = SEED) -> tuple[dict[str, np.ndarray], ...]:
    """Weights and the two moments of Adam."""
    p = initial(np.random.default_rng(seed))
    return p, {k: np.zeros_like(w) for k, w in p.items()}, {k: np.zeros_like(w) for k, w in p.items()}


def turns(n: int, times: int, seed: tuple[int, ...]) -> Iterator[np.ndarray]:
    """``times`` batches of numbers under ``n``: shuffled again and again, so that none comes again before all have come."""
    rng, left = np.random.default_rng(seed), np.empty(0, np.int64)
    for _ in range(times):
        while len(left) < min(BATCH, n):
            left = np.concatenate((left, rng.permutation(n)))
        yield left[:BATCH]
        left = left[BATCH:]


def trained_on(rows: np.ndarray, slot_of: np.ndarray, state: tuple[dict[str, np.ndarray], ...], since: int, to: int, steps: int, seed: int = SEED) -> tuple[dict[str, np.ndarray], ...]:
    """The state after steps ``since`` to ``to`` of ``steps`` of Adam with a falling rate, over all windows in shuffled order.

    Where these steps don't meet every window, they are divided until they do.
    """
    (w, m, v), shapes = [np.concatenate([x[k].ravel() for k in state[0]]) for x in state], {k: x.shape for k, x in state[0].items()}
    cuts = np.cumsum([math.prod(x) for x in shapes.values()])[:-1]
    named = lambda flat: {k: x.reshape(shapes[k]) for k, x in zip(shapes, np.split(flat, cuts), strict=True)}
    p, change, root = named(w), np.empty_like(w), np.empty_like(w)
    times = max(to - since, -(-len(rows) // BATCH))
    for k, at in enumerate(turns(len(rows), times, (seed, since)), 1):
        t = since + (to - since) * k / times
        batch = rows[at].astype(np.int64)
        targets, valid = batch[:, 1:], batch[:, 1:] >= 0
        _, g = gradients(p, np.where(batch[:, :-1] >= 0, batch[:, :-1], END), slot_of[targets], valid)
        rate, n = RATE * min(1, t / 100) * 0.5 * (1 + np.cos(np.pi * t / steps)), since + k
        grown = np.concatenate([g[name].ravel() for name in shapes])
        m += np.multiply(np.subtract(grown, m, out=change), 0.1, out=change)
        grown *= grown
        v += np.multiply(np.subtract(grown, v, out=change), 0.002, out=change)
        np.sqrt(np.multiply(v, 1 / (1 - 0.998**n), out=root), out=root)
        root += 1e-8
        w -= np.multiply(np.divide(m, root, out=change), rate / (1 - 0.9**n), out=change)
    return p, named(m), named(v)


def trained(classes: list[np.ndarray], slot_of: np.ndarray, steps: int = STEPS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Weights from all windows of a few texts, each with its END."""
    lengths = np.array([len(c) for c in classes], np.int64)
    if not lengths.sum():
        return initial(np.random.default_rng(seed))
    ends = np.cumsum(lengths)
    starts, text = windows(lengths)
    rows = training_windows(np.concatenate(classes), starts, ends[text], (ends - lengths)[text])
    return trained_on(rows, slot_of, fresh_state(seed), 0, steps, steps, seed)[0]
