"""Text probabilities from a causal self-attention model in numpy.

A word is read through all its subword ids under a public tokenizer: its embedding is
the mean of theirs. Attention over the words before predicts the next word's first id, in two levels over all ids that begin words of
the training text: the most frequent ids are classes of their own, the others are groups
of a class each, with weights of their own for every id. The word itself follows from its
first id by counts over the whole training text:

    P(word | before) = P_model(class | before) * P_model(id | class, before) * (c + 0.5) / (N_id + 0.5 * (V_id + 1))

An id that begins no word of the training text has a class together with all such ids,
as unknown words have one place in the base model.

Texts are cut into blocks of 16 tokens. The window of a block is the block and the
16 tokens before, so windows overlap by half and each token is scored once.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .common import bound_batches, kth_largest, map_batches, set_aside, whole_text

CLASSES = 128
BLOCK, WINDOW = 16, 32
#: Ids of one group, unless the classes would not do for all ids.
GROUP = 512
#: Words that every worker knows by heart; the others are joined. A bound, not a limit.
KNOWN_WORDS = 1 << 17
#: Parts of the training text that are learned one after another, at most; together they are all of it.
ROUNDS = 3
#: Training tokens for one task of a round.
TASK_TOKENS = 500_000
#: Training takes so many steps of 64 blocks at least, over a small text by reading it again.
LEAST_STEPS = 900
#: A word of more subwords is held as its distinct ones with their times.
LONG = 32
#: Weights that travel as one row to be averaged.
TOGETHER = 64
#: Blocks in a row that are shuffled together; what they share is worked out once.
RUN = 4
#: Weights that a training step changes at once.
AT_ONCE = 1 << 16
_SIZE, _HIDDEN = 16, 32
END, NEW = 0, 1


def words_of(text: str) -> list[bytes]:
    """Words of a text, A-Z in lower case; blanks are the six of ASCII."""
    return _split(pa.array([text.encode("utf-8", "replace").decode()]))[0].cast(pa.binary()).to_pylist()


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, one's after another's, and how many each has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0)  # a blank at an end leaves an empty one
    ends = np.append(0, np.cumsum(full.to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(lists.value_lengths().to_numpy()))]
    return words.filter(full), np.diff(ends)


# -- the model ---------------------------------------------------------------------------


def shapes(classes: int = CLASSES, rows: int | None = None, far: int = 0) -> dict[str, tuple[int, ...]]:
    """Weights by name: ``rows`` embeddings, the last that of the beginning of a text, and ``far`` ids in groups.

    Unless said otherwise tokens are classes, and class ``classes`` stands for the beginning.
    """
    d, h = _SIZE, _HIDDEN
    return {
        "embed": (rows or classes + 1, d), "query": (d, d), "key": (d, d), "value": (d, d), "near": (WINDOW,),
        "mix": (2 * d, h), "mix_add": (h,), "out": (h, classes), "out_add": (classes,), "far": (far, h), "far_add": (far,),
    }


def unpack(flat: np.ndarray, classes: int = CLASSES, rows: int | None = None, far: int = 0) -> dict[str, np.ndarray]:
    parts, at = {}, 0
    for name, shape in shapes(classes, rows, far).items():
        n = math.prod(shape)
        parts[name] = flat[at : at + n].reshape(shape)
        at += n
    return parts


def initial(counts: np.ndarray, classes: int = CLASSES, seed: int = 7, rows: int | None = None, far_add: np.ndarray | None = None) -> np.ndarray:
    """Small random weights; the output begins at the shares of the classes, and of the ids in their groups."""
    far_add = np.zeros(0) if far_add is None else far_add
    random = np.random.default_rng(seed)
    n = sum(math.prod(s) for s in shapes(classes, rows, len(far_add)).values())
    flat = (random.standard_normal(n) * 0.2).astype(np.float32)
    parts = unpack(flat, classes, rows, len(far_add))
    parts["near"][:] = 0
    parts["mix_add"][:] = 0
    parts["out"][:] *= 0.25
    parts["out_add"][:] = np.log((counts + 0.5) / (counts.sum() + 0.5 * classes))
    parts["far"][:] = 0
    parts["far_add"][:] = far_add
    return flat


def blocks_of(tokens: np.ndarray, offsets: np.ndarray, classes: int = CLASSES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of all texts: inputs (n, 32), whether each is one, targets (n, 16), and the text of each block.

    A target of -1 lies behind the text's end. ``tokens`` are classes, each text's
    end included, or any numbers below ``classes``; an input is the token before,
    the first that of the beginning, ``classes``.
    """
    length = np.diff(offsets)
    number = -(-length // BLOCK)
    text = np.repeat(np.arange(len(length)), number)
    start = (np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)) * BLOCK
    place = start[:, None] + np.arange(BLOCK)
    inside = place < length[text][:, None]
    padded = np.append(tokens, 0)
    at = np.where(inside, offsets[:-1][text][:, None] + place, len(tokens))
    targets = np.where(inside, padded[at], -1)
    before = start[:, None] + np.arange(-BLOCK, BLOCK) - 1
    real = (before >= -1) & (before < length[text][:, None])
    held = np.where(before >= 0, padded[np.where(real & (before >= 0), offsets[:-1][text][:, None] + before, len(tokens))], classes)
    return np.where(real, held, classes), real, targets, text


_AHEAD = np.arange(WINDOW)[None, :] - BLOCK > np.arange(BLOCK)[:, None]
_FAR = np.clip(np.arange(BLOCK)[:, None] - (np.arange(WINDOW)[None, :] - BLOCK), 0, WINDOW - 1)
_SCALE = np.float32(1 / np.sqrt(_SIZE))
_NEVER = np.float32(-1e9)


def _windows(run: np.ndarray) -> np.ndarray:
    """The overlapping windows (n, blocks, 32, width) of runs of blocks (n, (1 + blocks) * 16, width), as a view."""
    by_run, by_row, by_column = run.strides
    shape = (len(run), run.shape[1] // BLOCK - 1, WINDOW, run.shape[2])
    return np.ndarray(shape, run.dtype, run, 0, (by_run, BLOCK * by_row, by_row, by_column))


def _joint(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Query and key weights in one; the mixing weights behind those of the values, with what is added to them.

    What is linear can be done to the few weights as well as to each row of a window. The
    last column makes the hidden rows' last number 1, since tanh(20) is.
    """
    mix = np.zeros((2 * _SIZE + 1, _HIDDEN + 1), w["mix"].dtype)
    mix[:_SIZE, :_HIDDEN] = w["mix"][:_SIZE]
    mix[_SIZE:-1, :_HIDDEN] = w["value"] @ w["mix"][_SIZE:]
    mix[-1, :_HIDDEN] = w["mix_add"]
    mix[-1, _HIDDEN] = 20
    return (w["query"] * _SCALE) @ w["key"].T, mix


def _attend(w: dict[str, np.ndarray], window: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden rows (n * 16, hidden) of the places of all blocks, and what was made on the way."""
    hidden, made = _attend_joint(w, _joint(w), window, real)
    return hidden[:, :_HIDDEN], made


def _attend_joint(w: dict[str, np.ndarray], joint: tuple[np.ndarray, np.ndarray], window: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, tuple]:
    """Hidden rows (n * 16, hidden + 1), the last number 1, of the places of all blocks.

    ``window`` holds embedded runs of blocks with the block before, (runs, (1 + blocks) * 16, size);
    a run of one block is its window. What a block sees before itself is ``real`` as a whole or not at all.
    """
    runs, blocks = len(window), window.shape[1] // BLOCK - 1
    ask, mix = joint
    own = window[:, BLOCK:].reshape(-1, _SIZE)
    windows = _windows(window)
    query = (own @ ask).reshape(runs, blocks, BLOCK, _SIZE)
    scores = query @ windows.swapaxes(2, 3)
    # Neither what comes later nor what lies before the text is seen.
    scores += np.where(_AHEAD, _NEVER, w["near"].take(_FAR))
    scores.reshape(-1, BLOCK, WINDOW)[~real[:, BLOCK - 1], :, :BLOCK] = _NEVER
    # One maximum for a block is faster, and does unless a place lies far below it.
    scores -= scores.reshape(runs, blocks, -1).max(axis=2)[..., None, None]
    weight = np.exp(scores)
    total = (weight.reshape(-1, WINDOW) @ np.ones(WINDOW, weight.dtype)).reshape(runs, blocks, BLOCK, 1)
    if runs and total.min() < 1e-15:
        weight = np.exp(scores - scores.max(axis=3, keepdims=True))
        total = weight.sum(axis=3, keepdims=True)
    weight /= total
    seen = np.empty((len(own), 2 * _SIZE + 1), own.dtype)
    seen[:, :_SIZE] = own
    seen[:, -1] = 1
    np.matmul(weight, windows, out=seen.reshape(runs, blocks, BLOCK, -1)[..., _SIZE:-1])
    hidden = seen @ mix
    np.tanh(hidden, out=hidden)
    return hidden, (query, windows, weight, seen)


def _logits(out: np.ndarray, add: np.ndarray, hidden: np.ndarray) -> np.ndarray:
    """Logits (classes, n), whose exponentials can be summed."""
    logits = out @ hidden.T
    logits += add[:, None]
    return _bounded(logits)


def _bounded(logits: np.ndarray) -> np.ndarray:
    if logits.size and (logits.max() > 60 or logits.min() < -60):
        logits -= logits.max(axis=0)
    return logits


def forward(w: dict[str, np.ndarray], inputs: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probabilities (n * 16, classes) of the next token of each place of the blocks, and its hidden rows."""
    hidden, _ = _attend(w, w["embed"][inputs], real)
    logits = _logits(w["out"].T, w["out_add"], hidden)
    return (logits - np.log(np.exp(logits).sum(axis=0))).T, hidden


def group_logs(w: dict[str, np.ndarray], hidden: np.ndarray, group: slice) -> np.ndarray:
    """Log probabilities (n, ids) of the ids of one group, given that it is this group."""
    logits = _logits(w["far"][group], w["far_add"][group], hidden)
    return (logits - np.log(np.exp(logits).sum(axis=0))).T


@dataclass
class Tokens:
    """Tokens by their class, their id's place in the groups (-1: none) and the rows of all their subwords.

    The last one is the beginning of a text.
    """

    classes: np.ndarray
    far: np.ndarray
    pieces: np.ndarray
    sizes: np.ndarray
    groups: dict[int, slice]

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes
        # Of a long word each distinct row counts once, with its times.
        self.long = {k: np.unique(self.pieces[self.starts[k] : self.starts[k] + self.sizes[k]], return_counts=True) for k in np.flatnonzero(self.sizes > LONG).tolist()}

    def pieces_of(self, which: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[tuple]]:
        """The numbers in order of falling size, long words last; the rows of all first subwords, all second ones and so on; the long words' rows and times."""
        sizes = self.sizes.take(which)
        if self.long:
            sizes[sizes > LONG] = 0
        order = np.argsort((LONG - sizes).astype(np.uint8), kind="stable")
        many = len(which) - np.cumsum(np.bincount(sizes))[:-1]
        ordered = which.take(order)
        starts = self.starts.take(ordered)
        last = ordered[many[0] if len(many) else 0 :].tolist() if self.long else []
        return order, [self.pieces.take(starts[:m] + j) for j, m in enumerate(many.tolist())], [self.long[k] for k in last]

    def embed(self, table: np.ndarray, which: np.ndarray, pieces: tuple | None = None) -> np.ndarray:
        """Mean of the subwords' embeddings of each of the tokens; ``pieces`` is what ``pieces_of`` says of them."""
        order, rows, long = pieces or self.pieces_of(which)
        found = np.zeros((len(which), table.shape[1]), table.dtype)
        for r in rows:
            found[: len(r)] += table.take(r, axis=0)
        for k, (r, times) in enumerate(long, len(which) - len(long)):
            found[k] = times.astype(table.dtype) @ table.take(r, axis=0)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        found /= self.sizes.take(which.take(order))[:, None].astype(found.dtype)
        return found.take(back, axis=0)

    def spread(self, which: np.ndarray, slopes: np.ndarray, n: int, pieces: tuple | None = None) -> np.ndarray:
        """Sums of the slopes by the rows of their subwords, (n, size)."""
        order, rows, long = pieces or self.pieces_of(which)
        parts = slopes.take(order, axis=0)
        parts /= self.sizes.take(which.take(order))[:, None].astype(slopes.dtype)
        found = np.zeros((n, slopes.shape[1]), slopes.dtype)
        if rows:
            ids = np.concatenate(rows)
            by_id = np.argsort(ids, kind="stable")  # by radix, as long as rows are 16-bit numbers
            ids = ids.take(by_id)
            first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            each = np.arange(len(rows[0]))
            place = np.concatenate([each[: len(r)] for r in rows]).take(by_id)
            found[ids.take(first)] = np.add.reduceat(parts.take(place, axis=0), first, axis=0)
        for k, (r, times) in enumerate(long, len(which) - len(long)):
            found[r] += times[:, None].astype(parts.dtype) * parts[k]
        return found


def plain_tokens(tokens: np.ndarray, classes: int = CLASSES) -> Tokens:
    """Tokens that are classes, each with an embedding of its own."""
    own = np.append(tokens, classes)
    return Tokens(own, np.full(len(own), -1), own, np.ones(len(own), np.int64), {})


def gradient(w: dict[str, np.ndarray], inputs: np.ndarray, real: np.ndarray, targets: np.ndarray, classes: int = CLASSES, tokens: Tokens | None = None) -> tuple[float, np.ndarray]:
    """Mean loss of the targets in nats, and its gradient by all weights.

    Inputs and targets are numbers of ``tokens``, classes if there are none; both may
    be those of runs of blocks, as in ``_attend``.
    """
    tokens = tokens or plain_tokens(np.arange(classes), classes)
    flat = np.zeros(sum(p.size for p in w.values()), np.float32)
    g = unpack(flat, classes, len(w["embed"]), len(w["far"]))
    which = inputs.reshape(-1)
    pieces = tokens.pieces_of(which)
    window = tokens.embed(w["embed"], which, pieces).reshape(*inputs.shape, _SIZE)
    joint = _joint(w)
    hidden, (query, windows, attention, seen) = _attend_joint(w, joint, window, real)
    targets = targets.reshape(-1)
    at = np.flatnonzero(targets >= 0)
    wanted = targets.take(at)
    own, each = tokens.classes.take(wanted), np.float32(1 / len(at))
    # The slope of a logit is its share of the total, less one for the wanted; the totals divide the rows, which are fewer.
    out = np.concatenate([w["out"].T, w["out_add"][:, None]], axis=1)
    d_logits = _bounded(out @ hidden.T)
    loss = -float(d_logits[own, at].sum())
    np.exp(d_logits, out=d_logits)
    total = np.ones(classes, d_logits.dtype) @ d_logits
    loss += float(np.log(total.take(at)).sum())
    d_logits[own, at] -= total.take(at)
    share = np.zeros_like(total)
    share[at] = each / total.take(at)
    by_out = d_logits @ (hidden * share[:, None])
    g["out"][:], g["out_add"][:] = by_out[:, :_HIDDEN].T, by_out[:, _HIDDEN]
    d_hidden = d_logits.T @ out
    d_hidden *= share[:, None]
    far = tokens.far.take(wanted)
    in_groups = np.flatnonzero(far >= 0)
    own_group = own.take(in_groups)
    for k in np.unique(own_group).tolist():
        group, of_group = tokens.groups[k], in_groups[own_group == k]
        rows, place, column = at.take(of_group), far.take(of_group) - group.start, np.arange(len(of_group))
        of_rows = hidden.take(rows, axis=0)
        d = _logits(w["far"][group], w["far_add"][group], of_rows[:, :_HIDDEN])
        loss -= float(d[place, column].sum())
        np.exp(d, out=d)
        total = np.ones(len(d), d.dtype) @ d
        loss += float(np.log(total).sum())
        d[place, column] -= total
        share = each / total
        by_far = d @ (of_rows * share[:, None])
        g["far"][group], g["far_add"][group] = by_far[:, :_HIDDEN], by_far[:, _HIDDEN]
        d_hidden[rows, :_HIDDEN] += (d.T @ w["far"][group]) * share[:, None]
    d_hidden *= 1 - hidden * hidden
    ask, mix = joint
    by_seen = (seen.T @ d_hidden)[:, :_HIDDEN]
    by_value = by_seen[_SIZE : 2 * _SIZE]
    g["mix"][:_SIZE] = by_seen[:_SIZE]
    g["mix"][_SIZE:] = w["value"].T @ by_value
    g["value"][:] = by_value @ w["mix"][_SIZE:].T
    g["mix_add"][:] = by_seen[-1]
    runs, blocks = query.shape[:2]
    d_seen = (d_hidden @ mix[:-1].T).reshape(runs, blocks, BLOCK, 2 * _SIZE)
    # What the rows of a window get through the scores and through the values, in one product.
    by_row, of_row = np.empty((runs, blocks, 2 * BLOCK, WINDOW), attention.dtype), np.empty((runs, blocks, 2 * BLOCK, _SIZE), attention.dtype)
    of_row[:, :, :BLOCK], of_row[:, :, BLOCK:] = query, d_seen[..., _SIZE:]
    by_row[:, :, BLOCK:] = attention
    d_scores = of_row[:, :, BLOCK:] @ windows.swapaxes(2, 3)
    d_scores *= attention
    d_scores -= attention * (d_scores.reshape(-1, WINDOW) @ np.ones(WINDOW, d_scores.dtype)).reshape(runs, blocks, BLOCK, 1)
    by_row[:, :, :BLOCK] = d_scores
    by_place = np.ones(runs * blocks, d_scores.dtype) @ d_scores.reshape(-1, BLOCK * WINDOW)
    g["near"][:] = np.bincount(_FAR.reshape(-1), weights=by_place, minlength=WINDOW)
    d_query = (d_scores @ windows).reshape(-1, _SIZE)
    d_windows = by_row.swapaxes(2, 3) @ of_row
    by_ask = seen[:, :_SIZE].T @ d_query * _SCALE
    g["query"][:] = by_ask @ w["key"]
    g["key"][:] = by_ask.T @ w["query"]
    # A block is its own and, in a run, seen by the next one.
    d_own = d_query @ ask.T
    d_own += d_seen.reshape(-1, 2 * _SIZE)[:, :_SIZE]
    d_window = np.zeros((runs, blocks + 1, BLOCK, _SIZE), d_scores.dtype)
    d_window[:, 1:] = d_own.reshape(runs, blocks, BLOCK, _SIZE)
    d_window[:, 1:] += d_windows[:, :, BLOCK:]
    d_window[:, :-1] += d_windows[:, :, :BLOCK]
    g["embed"][:] = tokens.spread(which, d_window.reshape(-1, _SIZE), len(w["embed"]), pieces)
    return loss * float(each), flat


def runs_of(inputs: np.ndarray, real: np.ndarray, targets: np.ndarray, together: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of ``together`` blocks in a row, whatever their texts: inputs with those of the block before, real and targets by run.

    The last run is filled up with blocks that have no target.
    """
    number = -(-len(inputs) // together)
    more = number * together - len(inputs)
    own = np.concatenate([inputs[:1, :BLOCK], inputs[:, BLOCK:], np.repeat(inputs[:1, :BLOCK], more, axis=0)])
    of_run = own[np.arange(number)[:, None] * together + np.arange(together + 1)].reshape(number, -1)
    real = np.concatenate([real, np.zeros((more, WINDOW), bool)]).reshape(number, together, WINDOW)
    targets = np.concatenate([targets, np.full((more, BLOCK), -1)]).reshape(number, -1)
    return of_run, real, targets


def train(flat: np.ndarray, tokens: np.ndarray | Tokens, offsets: np.ndarray, seed: int, steps: int = 300, size: int = 64, rate: float = 0.01, classes: int = CLASSES, rows: int | None = None, together: int = RUN) -> np.ndarray:
    """Weights after at least ``steps`` steps over shuffled runs of blocks."""
    tokens = tokens if isinstance(tokens, Tokens) else plain_tokens(tokens, classes)
    inputs, real, targets, _ = blocks_of(np.arange(len(tokens.classes) - 1), offsets, len(tokens.classes) - 1)
    if not len(inputs):
        return flat
    total = max(steps, -(-len(inputs) // size))
    inputs, real, targets = runs_of(inputs, real, targets, together)
    size = size // together
    flat = flat.copy()
    random = np.random.default_rng(seed)
    # Moments by 1 / 0.1 and 1 / 0.01 too large, which the pace makes up for.
    mean, square, step = np.zeros_like(flat), np.zeros_like(flat), 0
    w = unpack(flat, classes, rows, sum(g.stop - g.start for g in tokens.groups.values()))
    while step < total:
        order = random.permutation(len(inputs))
        for at in range(0, len(order), size):
            chosen = order[at : at + size]
            _, g = gradient(w, inputs[chosen], real[chosen].reshape(-1, WINDOW), targets[chosen], classes, tokens)
            step += 1
            scale = np.sqrt((1 - 0.99**step) / 0.01)
            pace = np.float32(rate * (1 - 0.9 * step / total) * scale * 0.1 / (1 - 0.9**step))
            least = np.float32(1e-8 * scale)
            for a in range(0, len(flat), AT_ONCE):  # so many stay in a core's cache
                x, m, q = g[a : a + AT_ONCE], mean[a : a + AT_ONCE], square[a : a + AT_ONCE]
                m *= np.float32(0.9)
                m += x
                q *= np.float32(0.99)
                x *= x
                q += x
                np.sqrt(q, out=x)
                x += least
                np.divide(m, x, out=x)
                x *= pace
                flat[a : a + AT_ONCE] -= x
            if step >= total:
                break
    return flat


def text_scores(w: dict[str, np.ndarray], tokens: np.ndarray, offsets: np.ndarray, classes: int = CLASSES, at_once: int = 64, table: np.ndarray | None = None, kinds: Tokens | None = None) -> np.ndarray:
    """log10 probability of the first ids of each text.

    ``tokens`` are numbers of ``kinds``, whose embeddings are the rows of ``table``; classes if there are none.
    """
    kinds = kinds or plain_tokens(np.arange(classes), classes)
    table = w["embed"] if table is None else table
    inputs, real, targets, text = blocks_of(tokens, offsets, len(table) - 1)
    sums = np.zeros(len(offsets) - 1)
    waiting: dict[int, list] = {}
    # All blocks are one run; the block before the first is not seen.
    run = np.concatenate([inputs[:1, :BLOCK], inputs[:, BLOCK:]])
    joint, out = _joint(w), np.concatenate([w["out"].T, w["out_add"][:, None]], axis=1)
    for a in range(0, len(inputs), at_once):
        part = slice(a, a + at_once)
        hidden, _ = _attend_joint(w, joint, table.take(run[a : a + at_once + 1].reshape(1, -1), axis=0), real[part])
        logits = _bounded(out @ hidden.T)
        at = np.flatnonzero(targets[part].reshape(-1) >= 0)
        wanted = targets[part].reshape(-1)[at]
        own, far = kinds.classes.take(wanted), kinds.far.take(wanted)
        found = logits[own, at].astype(np.float64)
        np.exp(logits, out=logits)
        found -= np.log((np.ones(len(logits), logits.dtype) @ logits).take(at))
        in_text = text[part][at // BLOCK]
        sums += np.bincount(in_text, weights=found, minlength=len(sums))
        some = far >= 0
        for k in np.unique(own[some]).tolist():
            rows = np.flatnonzero(own == k)
            waiting.setdefault(k, []).append((hidden[at[rows], :_HIDDEN], far[rows] - kinds.groups[k].start, in_text[rows]))
    for k, parts in waiting.items():
        for a in range(0, len(parts), 64):
            own, place, in_text = (np.concatenate(x) for x in zip(*parts[a : a + 64], strict=True))
            found = group_logs(w, own, kinds.groups[k])[np.arange(len(own)), place]
            sums += np.bincount(in_text, weights=found.astype(np.float64), minlength=len(sums))
    return sums / np.log(10)


# -- words and their subwords ---------------------------------------------------------------


class Subwords:
    """Subword ids of words under a public tokenizer given as ranks, each word with a blank before it."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line)
        own = {base64.b64decode(a): int(b) for a, b in pairs}
        self.coder = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=own, special_tokens={})
        self.begins = np.zeros(max(own.values(), default=0) + 1, bool)
        self.begins[[k for a, k in own.items() if a.startswith(b" ")]] = True

    def ids(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one's after another's, and how many each has."""
        text = b"".join(b" " + w for w in words).decode()
        if text.split() == text[1:].split(" "):
            # One call for all: a pattern splits before the blanks, and only there a subword begins with one.
            found = np.array(self.coder.encode_ordinary(text), np.int64)
            first = np.flatnonzero(self.begins[found])
            if len(first) == len(words):
                return found, np.diff(np.append(first, len(found)))
        elif len(words) > 1:  # some word holds a blank of Unicode, which a pattern sees
            cut = len(words) // 2
            (a, b), (c, d) = self.ids(words[:cut]), self.ids(words[cut:])
            return np.append(a, c), np.append(b, d)
        each = [self.coder.encode_ordinary(" " + w.decode()) for w in words]
        return np.array([k for ids in each for k in ids], np.int64), np.array([len(ids) for ids in each], np.int64)


def _subwords(held: dict) -> Subwords:
    if "subwords" not in held:
        held["subwords"] = Subwords(held["ranks"], held["pattern"])
    return held["subwords"]


def _rows(held: dict, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words' subwords, one word's after another's, and how many each has."""
    ids, sizes = _subwords(held).ids(words)
    return held["row_of"].take(ids), sizes


def _numbered(words: pa.Array, known: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The number of each word, those of ``known`` first, and the distinct other words, whose numbers follow."""
    number = pc.fill_null(pc.index_in(words, value_set=known), -1).to_numpy().astype(np.int64)
    new = np.flatnonzero(number < 0)
    others = words.take(pa.array(new)).dictionary_encode()
    number[new] = len(known) + others.indices.to_numpy()
    return number, others.dictionary


def count_words(docs: DataFrame, text: str = "text", most: int = 200_000) -> DataFrame:
    """Occurrences of every word over all rows: word, n."""
    bound_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = pa.table({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})
        for batch in batches:
            words, n = pc.value_counts(_split(batch.column(0))[0]).flatten()
            seen = pa.concat_tables([seen, pa.table({"word": words, "n": n})])
            if len(seen) >= 2 * most:
                seen = seen.group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])
                if len(seen) >= most:
                    yield from seen.to_batches()
                    seen = seen.slice(0, 0)
        yield from seen.to_batches()

    partial = docs.select(whole_text(text).alias("text")).mapInArrow(count, "word string, n bigint")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Fitted:
    """All that scoring needs: counts of the training text, what is known of its subword ids, model weights.

    Arrays ``kinds``, ``far`` and ``sizes`` go by row: row 0 is a text's end, row 1 all ids that
    aren't in the training text, each other row one id that is; the last is a text's beginning.
    """

    words: DataFrame  # word, n, subwords
    n: int
    v: int
    ends: int
    row_of: np.ndarray  # by subword id
    kinds: np.ndarray  # class
    far: np.ndarray  # place in the groups, or -1
    sizes: np.ndarray  # of an id that begins words: their occurrences and half their number and one
    groups: dict[int, slice]  # by class
    class_words: np.ndarray
    far_add: np.ndarray
    flat: np.ndarray | None
    sent: dict
    heart: dict = field(default_factory=dict)  # by how many

    def base_log(self, c: np.ndarray | Column):
        return (c + 0.5) / (self.n + 0.5 * (self.v + 1))

    def held(self) -> dict:
        return self.sent | {"row_of": self.row_of, "kinds": self.kinds, "far": self.far, "sizes": self.sizes, "groups": self.groups, "flat": self.flat, "ends": self.ends, "classes": len(self.class_words)}

    def by_heart(self, most: int) -> tuple[float, dict]:
        """The most frequent words, at most so many: the count that all of them exceed; words, counts, rows of subwords and how many each has."""
        if most not in self.heart:
            least = kth_largest(self.words, "n", most)
            found = self.words.where(F.col("n") > F.lit(least)).toArrow().combine_chunks()
            word, n, subwords = (found.column(c).combine_chunks() if len(found) else pa.array([], t) for c, t in (("word", pa.string()), ("n", pa.int64()), ("subwords", pa.list_(pa.int32()))))
            rows = self.row_of.take(subwords.flatten().to_numpy())
            self.heart[most] = least, {"words": word.cast(pa.string()), "n": n.to_numpy().astype(float), "rows": rows, "many": subwords.value_lengths().to_numpy().astype(np.int64)}
        return self.heart[most]


def fit_counts(docs: DataFrame, ranks_file: str, pattern: str, text: str = "text", classes: int = CLASSES, group: int = GROUP) -> Fitted:
    """Word counts over all training rows, and a place for every subword id.

    Ids that begin words go by falling occurrences: the first are classes, all others
    are dealt over groups of ``group`` ids at most, each a class; as few as will do.
    """
    with open(ranks_file, "rb") as f:
        sent = {"ranks": f.read(), "pattern": pattern}
    held = docs.sparkSession.sparkContext.broadcast(dict(sent))
    ends = docs.count()
    counted = count_words(docs, text)

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, sizes = _subwords(held.value).ids(batch.column("word").cast(pa.binary()).to_pylist())
        found = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(ids, pa.int32()))
        return pa.RecordBatch.from_arrays([batch.column("word"), batch.column("n"), found], names=["word", "n", "subwords"])

    words = materialise(map_batches(counted, split, "word string, n bigint, subwords array<int>"), "words")
    # One row for each id of the tokenizer at most.
    found = words.groupBy(F.get("subwords", F.lit(0)).alias("id")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).orderBy(F.desc("n"), "id").collect()
    others = words.select(F.explode("subwords").alias("id")).distinct().collect()
    first = [r.id for r in found]
    ids = [*first, *sorted({r.id for r in others} - set(first))]
    row_of = np.full(max([int(line.split()[1]) for line in sent["ranks"].splitlines() if line], default=0) + 1, NEW, np.uint16 if len(ids) < 60_000 else np.int64)
    row_of[ids] = np.arange(2, len(ids) + 2)
    single, groups = _dealt(len(first), classes - 2, group)
    kinds, far = np.full(len(ids) + 3, NEW), np.full(len(ids) + 3, -1)
    kinds[END] = END
    kinds[2 : 2 + single] = np.arange(2, 2 + single)
    for k, part in enumerate(groups):
        kinds[2 + single + part.start : 2 + single + part.stop] = 2 + single + k
    n_of, sizes = np.array([r.n for r in found], float), np.full(len(ids) + 3, 0.5)
    far[2 + single : 2 + len(first)] = np.arange(len(first) - single)
    sizes[2 : 2 + len(first)] = n_of + 0.5 * (np.array([r.v for r in found], float) + 1)
    class_words = np.bincount(kinds[2 : 2 + len(first)], weights=n_of, minlength=classes)
    class_words[END] = ends
    tail = n_of[single:]
    far_add = np.concatenate([np.zeros(0), *(np.log((tail[g] + 0.5) / (tail[g] + 0.5).sum()) for g in groups)])
    n, v = int(n_of.sum()) + ends, sum(r.v for r in found) + min(ends, 1)
    by_class = {2 + single + k: g for k, g in enumerate(groups)}
    return Fitted(words, n, v, ends, row_of, kinds, far, sizes, by_class, class_words, far_add, None, sent)


def _dealt(n: int, classes: int, group: int) -> tuple[int, list[slice]]:
    """How many of n ids, by falling occurrences, are classes of their own, and the groups of all others."""
    if n <= classes:
        return n, []
    group = max(group, -(-n // classes), 2)
    number = -(-(n - classes) // (group - 1))
    single = classes - number
    cuts = np.linspace(0, n - single, number + 1).round().astype(int).tolist()
    return single, [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def _token_batches(docs: DataFrame, fitted: Fitted, text: str, key: str) -> DataFrame:
    """Every row's words and its end, each as its number of subwords (``tokens``) and the rows of these, and a number by which rows are dealt: copies of a text have different ones."""
    held = docs.sparkSession.sparkContext.broadcast(fitted.held() | fitted.by_heart(KNOWN_WORDS)[1])

    def split(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held.value
        words, length = _split(batch.column("text"))
        number, others = _numbered(words, own["words"])
        rows, sizes = _rows(own, others.cast(pa.binary()).to_pylist())
        # The end comes after all kinds; its one subword is row 0.
        rows, sizes = np.concatenate([own["rows"], rows, np.array([END], rows.dtype)]), np.concatenate([own["many"], sizes, [1]])
        offsets = np.append(0, np.cumsum(length + 1))
        tokens = np.full(int(offsets[-1]), len(sizes) - 1)
        tokens[np.arange(len(number)) + np.repeat(np.arange(len(length)), length)] = number
        many = sizes.take(tokens)
        ends = np.cumsum(many)
        pieces = rows.take(np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes).take(tokens) - (ends - many), many))
        cuts = np.append(0, ends)[offsets].tolist()
        listed = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(many, pa.int32()))
        packed = pa.array([pieces[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("deal"), listed, packed], names=["deal", "tokens", "pieces"])

    deal = F.pmod(F.xxhash64(F.col(key), whole_text(text)), F.lit(1 << 30))
    return map_batches(docs.select(deal.alias("deal"), whole_text(text).alias("text")), split, "deal bigint, tokens array<int>, pieces binary")


def fit_model(docs: DataFrame, fitted: Fitted, text: str = "text", rounds: int = ROUNDS, key: str = "doc_id") -> Fitted:
    """Fit the attention model on all training rows.

    The rows are dealt over ``rounds`` parts and their tasks by key and text. In each round every
    task trains the same weights on its share of one part; the next round begins at
    their mean, so the driver holds one set of weights, however much text there is.
    A text too small for several parts is one, and is read several times.
    """
    spark = docs.sparkSession
    learned = materialise(_token_batches(docs, fitted, text, key), "learned")
    tokens = learned.agg(F.sum(F.size("tokens"))).head()[0] or 0
    flat = initial(fitted.class_words, len(fitted.class_words), rows=len(fitted.kinds), far_add=fitted.far_add)
    unpack(flat, len(fitted.class_words), len(fitted.kinds), len(fitted.far_add))["embed"][NEW] = 0  # nothing is known of these
    if tokens:
        rounds = max(1, min(rounds, tokens // TASK_TOKENS))
        tasks = max(1, round(tokens / rounds / TASK_TOKENS))
        passes = max(1, -(-LEAST_STEPS * 64 * BLOCK // tokens))
        for number in range(rounds):
            fitted.flat = flat
            part = learned.where(F.col("deal") % rounds == number).repartition(tasks, "deal").sortWithinPartitions("deal").select("tokens", "pieces")
            flat = _round(part, spark.sparkContext.broadcast(fitted.held()), number, passes)
    fitted.flat = flat
    return fitted


def _round(part: DataFrame, held, number: int, passes: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, lengths, sizes, pieces = held.value, [], [], []
        for b in batches:
            if b.num_rows:
                lengths.append(b.column(0).value_lengths().to_numpy())
                sizes.append(b.column(0).flatten().to_numpy())
                pieces += [np.frombuffer(x, own["row_of"].dtype) for x in b.column(1).to_pylist()]
        if not lengths:
            return
        begin = len(own["kinds"]) - 1
        rows = np.append(np.concatenate(pieces), np.array([begin], own["row_of"].dtype))
        sizes = np.append(np.concatenate(sizes).astype(np.int64), 1)
        first = rows[np.cumsum(sizes) - sizes]
        tokens = Tokens(own["kinds"].take(first), own["far"].take(first), rows, sizes, own["groups"])
        offsets = np.append(0, np.cumsum(np.concatenate(lengths).astype(np.int64)))
        blocks = int((-(-np.diff(offsets) // BLOCK)).sum())
        flat = train(own["flat"], tokens, offsets, seed=number, steps=passes * -(-blocks // 64), classes=own["classes"], rows=begin + 1)
        cut = [flat[a : a + TOGETHER].tobytes() for a in range(0, len(flat), TOGETHER)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(cut)), pa.int64()), pa.array([len(sizes) - 1] * len(cut), pa.int64()), pa.array(cut, pa.binary())], names=["place", "n", "flat"])

    def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for b in batches:
            for place, n, x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held_sum = sums.setdefault(place, [0, 0.0])
                held_sum[0] += n
                held_sum[1] = held_sum[1] + n * np.frombuffer(x, np.float32).astype(np.float64)
        made = [(x / n).astype(np.float32).tobytes() for n, x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(made, pa.binary())], names=["place", "flat"])

    trained = part.mapInArrow(run, "place bigint, n bigint, flat binary")
    each = trained.repartition("place").sortWithinPartitions("place", "n", "flat").mapInArrow(mean, "place bigint, flat binary")
    found = [r.flat for r in sorted(each.collect(), key=lambda r: r.place)]  # one set of weights
    return np.frombuffer(b"".join(found), np.float32) if found else held.value["flat"]


def score_texts(docs: DataFrame, fitted: Fitted, text: str = "text", known_words: int = KNOWN_WORDS) -> DataFrame:
    """Every row, without its text, with n_tokens, n_known, base_score and score.

    A null text counts as empty: it is one token, its end. ``base_score`` is the
    word model without context, ``score`` the attention model's. Without training
    text all words are unknown. Columns of these names are replaced.
    """
    spark = docs.sparkSession
    # The most frequent words go to every worker, fewer than a fixed number; the others are joined.
    least, heart = fitted.by_heart(known_words)
    base = np.log10(fitted.base_log(heart["n"])) if len(heart["n"]) else np.zeros(0)
    end_base = float(np.log10(fitted.base_log(float(fitted.ends))))
    held = spark.sparkContext.broadcast(fitted.held() | heart | {"base": base})
    made = {"n_tokens": "bigint", "n_known": "bigint", "base_score": "double", "score": "double"}
    aside, give_back = set_aside(docs, text)
    kept = aside.select("*", whole_text(text).alias("_whole_text")).drop(text, *made)
    kept = kept.withColumn("_row", F.monotonically_increasing_id())
    fields = [f for f in kept.schema.fields if f.name != "_whole_text"]
    rare = "array<struct<word:string,size:double,times:int>>"
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"{k} {t}" for k, t in made.items()), f"_rare {rare}"])

    def ready(own: dict) -> None:
        """What is computed once for each worker: weights, and the embeddings and counts of the known words."""
        own["weights"] = unpack(own["flat"], own["classes"], len(own["kinds"]), sum(g.stop - g.start for g in own["groups"].values()))
        own["table"], own["first"] = embedded(own, own["rows"], own["many"])
        own["within"] = np.log10((own["n"] + 0.5) / own["sizes"].take(own["first"]))

    def embedded(own: dict, rows: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of words, and the rows of their first subwords."""
        if not len(sizes):
            return np.zeros((0, _SIZE), np.float32), rows
        tokens = Tokens(sizes, sizes, rows, sizes, {})
        return tokens.embed(own["weights"]["embed"], np.arange(len(sizes))), rows.take(tokens.starts)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        own = held.value
        if "table" not in own:
            ready(own)
        words, length = _split(batch.column("_whole_text"))
        texts = len(length)
        text_of = np.repeat(np.arange(texts), length)
        found, others = _numbered(words, own["words"])
        table, first = embedded(own, *_rows(own, others.cast(pa.binary()).to_pylist()))
        known = len(own["words"])
        common, unknown = found < known, np.flatnonzero(found >= known)
        weights = own["weights"]["embed"]
        rows = np.concatenate([own["first"], first, np.array([END, len(weights) - 1], first.dtype)])
        kinds = Tokens(own["kinds"].take(rows), own["far"].take(rows), rows, np.ones(len(rows), np.int64), own["groups"])
        table = np.concatenate([own["table"], table, weights[[END, -1]]])
        offsets = np.append(0, np.cumsum(length + 1))
        tokens = np.full(int(offsets[-1]), len(table) - 2)
        tokens[np.arange(len(found)) + text_of] = found
        met, where = found[common], text_of[common]
        base_sum = np.bincount(where, weights=own["base"].take(met), minlength=texts) + end_base
        score = np.bincount(where, weights=own["within"].take(met), minlength=texts)
        score = score + text_scores(own["weights"], tokens, offsets, own["classes"], table=table, kinds=kinds)
        n_known = np.bincount(where, minlength=texts) + (own["ends"] > 0)
        # Words that aren't known by heart: once for each text, with their number.
        pairs, times = np.unique(text_of[unknown] * max(len(others), 1) + found[unknown] - known, return_counts=True)
        which, cuts = pairs % max(len(others), 1), np.searchsorted(pairs // max(len(others), 1), np.arange(texts + 1))
        named = others.take(pa.array(which))
        parts = pa.StructArray.from_arrays([named, pa.array(own["sizes"].take(first.take(which))), pa.array(times, pa.int32())], names=["word", "size", "times"])
        columns = [batch.column(f.name) for f in fields]
        columns += [pa.array(length + 1), pa.array(n_known.astype(np.int64)), pa.array(base_sum), pa.array(score)]
        columns.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), parts))
        return pa.RecordBatch.from_arrays(columns, names=[*(f.name for f in fields), *made, "_rare"])

    scored = materialise(map_batches(kept, run, schema), "scored")
    counts = fitted.words.where(F.col("n") <= F.lit(least)).select(F.col("word").alias("_word"), F.col("n").alias("_n"))
    met = scored.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", "r.size", "r.times")
    met = met.join(counts, F.col("word") == F.col("_word"), "left").withColumn("_c", F.coalesce("_n", F.lit(0)))
    sums = met.groupBy("_row").agg(
        F.sum(F.when(F.col("_c") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * F.log10(fitted.base_log(F.col("_c")))).alias("_base"),
        F.sum(F.col("times") * F.log10((F.col("_c") + 0.5) / F.col("size"))).alias("_within"),
    )
    sums = sums.withColumnRenamed("_row", "_of")
    joined = scored.drop("_rare").join(sums, F.col("_row") == F.col("_of"), "left")
    more = {"n_known": "_known", "base_score": "_base", "score": "_within"}
    joined = joined.withColumns({k: F.col(k) + F.coalesce(F.col(v), F.lit(0)) for k, v in more.items()})
    return give_back(joined.withColumn("train_tokens", F.lit(fitted.n).cast("bigint")).drop("_row", "_of", "_known", "_base", "_within"))
