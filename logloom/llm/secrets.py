"""Secrets in texts: fixed patterns, and a character network over every candidate."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

# Fixed values of the contract: the kinds in their order, their patterns, and the
# group and the length that a match needs. The letters of `assign` have either case.
KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
# For these two a run below the length fails as a whole, so the patterns ask for it.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RULES = ((_ASSIGN, 2, 6), (_ACCESS, 0, 20), (_HEX, 0, 24))

#: What the network adds goes by this kind, after those above.
ADDED = "network"

# A candidate is a run of characters that keys are written in, as long as this.
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~-]{12,}")
CANDIDATE_LENGTH = 12
# Characters around a candidate that the network sees.
BEFORE, AFTER = 24, 16
# Different findings that one shard learns from, about, and findings of a label that it has
# if there are as many: where a label is rare, several shards have the same ones.
SHARD, SHARD_RARE = 50_000, 200
# Rounds of learning, after each of which the weights of all shards are averaged.
ROUNDS = 3
# Step sizes of the rounds.
RATES = (0.01, 0.005, 0.0025)
# Logits are counted in bins of this width, up to this size, to set the thresholds.
BIN, FAR = 1 / 64, 50
# Of the labelled findings, the share held out for calibration and thresholds.
HELD_OUT = 0.3
# Share of the held-out secrets that every threshold must let through.
RECALL = 0.98
# No candidate less likely than this is added, whatever the recall asks for.
LEAST = 0.5
# Findings per label below which there is no network.
FEW = 8
# Characters convolved at a time.
BLOCK = 1 << 16

# Alphabets that keys are written in, for copies of labelled secrets.
_ALPHABETS = (
    "0123456789abcdef",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-",
)

# Network: taps of the convolution and its filters, pooled as mean and maximum over
# the candidate and as maximum over what stands before and after it; hidden units.
TAPS, FILTERS, HIDDEN = 5, 12, 16

# Character classes. 0 is the outside of a text.
_CLASSES = (
    "aeiou", "bcdf", "ghjklmnpqrstvwxyz", "AEIOU", "BCDF", "GHJKLMNPQRSTVWXYZ",
    "0123456789", "+", "/", "_", ".", "=", "-", "~", " ", "\n\r\t", "\"'`", ":", "@",
    ",;!?", "()[]{}<>", "&%#$*|\\^",
)
OTHER = len(_CLASSES) + 1
N_CLASSES = OTHER + 1


def _class_table() -> np.ndarray:
    table = np.full(128, OTHER, np.uint8)
    for number, members in enumerate(_CLASSES, 1):
        for char in members:
            table[ord(char)] = number
    return table


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Start, number of the kind, and end of all matches of the fixed patterns, in order."""
    found = [
        (m.start(), kind, m.end())
        for kind, (pattern, group, least) in enumerate(_RULES)
        for m in pattern.finditer(text)
        if m.end(group) - m.start(group) >= least
    ]
    return sorted(found)


def _joined(spans: list[tuple[int, int, int]]) -> str:
    kinds = (*KINDS, ADDED)
    return ",".join(f"{kinds[kind]}:{start}:{end}" for start, kind, end in spans)


def candidates(text: str) -> Iterator[tuple[int, int]]:
    """Runs that may be keys; dots at their end belong to the sentence."""
    for m in _CANDIDATE.finditer(text):
        start, end = m.span()
        while end > start and text[end - 1] == ".":
            end -= 1
        if end - start >= CANDIDATE_LENGTH:
            yield start, end


def shape(run: str) -> int:
    """0 digits and marks, 1 digits and a-f, 2 letters and digits, 3 no digits."""
    if not any("0" <= c <= "9" for c in run):
        return 3
    letters = {c for c in run if c.isalpha()}
    return 0 if not letters else 1 if letters <= set("abcdef") else 2


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per text: the fixed matches, and every candidate with its surroundings."""
    for batch in batches:
        counts, digests, bases, runs = [[], [], []], [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            base = base_spans(text)
            for kind in range(3):
                counts[kind].append(sum(k == kind for _, k, _ in base))
            digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            rows, first = [], 0
            reach = np.maximum.accumulate([e for _, _, e in base]).tolist() if base else []
            for start, end in candidates(text):
                while first < len(base) and reach[first] <= start:
                    first += 1
                window = text[max(0, start - BEFORE) : end + AFTER].replace("\0", "\x01")
                # The surroundings have a fixed width; outside of the text they are empty.
                window = "\0" * max(0, BEFORE - start) + window
                window += "\0" * max(0, end + AFTER - len(text))
                rows.append(
                    {
                        "start": start,
                        "end": end,
                        "window": window,
                        "shape": shape(text[start:end]),
                        "secret": first < len(base) and base[first][0] < end,
                        "hash": xxhash.xxh3_64_intdigest(window.encode("utf-8", "surrogatepass"))
                        >> 1,
                    }
                )
            runs.append(rows)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                *[pa.array(c, pa.int64()) for c in counts],
                pa.array(digests, pa.string()),
                pa.array(bases, pa.list_(_SPAN)),
                pa.array(runs, pa.list_(_RUN)),
            ],
            ["id", "n_assign", "n_access", "n_hex", "base_sha256", "base", "runs"],
        )


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_RUN = pa.struct(
    [
        ("start", pa.int64()), ("end", pa.int64()), ("window", pa.string()),
        ("shape", pa.int32()), ("secret", pa.bool_()), ("hash", pa.int64()),
    ]
)
_SCANNED = (
    "n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
    "base array<struct<start:bigint,kind:int,end:bigint>>, "
    "runs array<struct<start:bigint,end:bigint,window:string,shape:int,secret:boolean,hash:bigint>>"
)


@dataclass
class Network:
    """Weights of the network, its calibration, and a threshold per shape of candidate."""

    taps: np.ndarray  # TAPS x N_CLASSES x FILTERS
    bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: float = 1.0
    shift: float = 0.0
    thresholds: tuple[float, ...] = (LEAST,) * 4

    def convolved(self, codes: np.ndarray) -> np.ndarray:
        """Filter outputs at every place; the sequence must have the margin on both sides."""
        n = len(codes) - TAPS + 1
        total = self.taps[0][codes[:n]]
        for t in range(1, TAPS):
            total += self.taps[t][codes[t : t + n]]
        total += self.bias
        return np.maximum(total, 0, out=total)

    def pooled(self, codes: np.ndarray, lengths: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Features of windows laid end to end, each between margins of the outside."""
        margin = TAPS // 2
        cuts = np.empty((len(lengths), 4), np.int64)
        # Places of a window: a margin, what is before, the candidate, what is after, a margin.
        cuts[:, 0] = np.cumsum(lengths + 2 * margin) - lengths - 2 * margin
        cuts[:, 1] = cuts[:, 0] + BEFORE
        cuts[:, 2] = cuts[:, 0] + lengths - AFTER
        cuts[:, 3] = cuts[:, 0] + lengths
        places = self.convolved(codes)
        places = np.vstack([places, np.zeros((margin * 2, FILTERS), places.dtype)])
        flat = cuts.ravel()
        most = np.maximum.reduceat(places, flat, axis=0).reshape(len(lengths), 4, FILTERS)
        total = np.add.reduceat(places, cuts[:, 1:3].ravel(), axis=0)[::2]
        inner = (cuts[:, 2] - cuts[:, 1])[:, None]
        if keep is not None:
            keep.update(places=places, cuts=cuts, most=most, inner=inner)
        return np.hstack([total / inner, most[:, 1], most[:, 0], most[:, 2]])

    def logits(self, features: np.ndarray, keep: dict | None = None) -> np.ndarray:
        layer = np.maximum(features @ self.hidden + self.hidden_bias, 0)
        if keep is not None:
            keep.update(layer=layer)
        return layer @ self.out + self.out_bias

    def raw(self, windows: list[str]) -> np.ndarray:
        """The logit of each window before calibration, in blocks of characters."""
        found = []
        for block in _blocks(windows):
            if len(block) == 1 and len(block[0]) > BLOCK:
                features = self._long(block[0])
            else:
                features = self.pooled(*encoded(block))
            found.append(self.logits(features))
        return np.concatenate(found) if found else np.zeros(0)

    def probabilities(self, windows: list[str]) -> np.ndarray:
        """Calibrated probability that each window holds a secret."""
        logits = self.raw(windows)
        return 1 / (1 + np.exp(-np.clip(self.scale * logits + self.shift, -50, 50)))

    def _long(self, window: str) -> np.ndarray:
        """Features of one very long window, piece by piece, in memory of a piece."""
        codes, _ = encoded([window])
        margin, n = TAPS // 2, len(window)
        parts = {"before": (0, BEFORE), "inner": (BEFORE, n - AFTER), "after": (n - AFTER, n)}
        most, total = {}, np.zeros(FILTERS)
        for name, (start, stop) in parts.items():
            best = np.zeros(FILTERS)
            for at in range(start, stop, BLOCK):
                end = min(at + BLOCK, stop)
                places = self.convolved(codes[at : end + 2 * margin])
                best = np.maximum(best, places.max(axis=0))
                if name == "inner":
                    total += places.sum(axis=0)
            most[name] = best
        mean = total / (n - BEFORE - AFTER)
        return np.hstack([mean, most["inner"], most["before"], most["after"]])[None, :]


def _blocks(windows: list[str]) -> Iterator[list[str]]:
    block, size = [], 0
    for window in windows:
        if block and size + len(window) > BLOCK:
            yield block
            block, size = [], 0
        block.append(window)
        size += len(window)
    if block:
        yield block


def encoded(windows: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Character classes of all windows with margins between them, and their lengths."""
    margin = "\0" * (TAPS // 2)
    text = "".join(f"{margin}{window}{margin}" for window in windows)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = np.full(len(points), OTHER, np.uint8)
    ascii_ = points < 128
    codes[ascii_] = _class_table()[points[ascii_]]
    codes[points == 0] = 0
    return codes, np.fromiter(map(len, windows), np.int64, len(windows))


def _gradients(
    net: Network, codes: np.ndarray, lengths: np.ndarray, labels: np.ndarray, weights: np.ndarray
) -> list[np.ndarray]:
    keep: dict = {}
    features = net.pooled(codes, lengths, keep)
    logits = net.logits(features, keep)
    slope = weights * (1 / (1 + np.exp(-np.clip(logits, -50, 50))) - labels)
    layer, places, cuts, most = (keep[k] for k in ("layer", "places", "cuts", "most"))
    back = np.outer(slope, net.out) * (layer > 0)
    below = back @ net.hidden.T
    d_mean, d_inner, d_before, d_after = np.split(below, 4, axis=1)
    d_places = np.zeros_like(places)
    spans = np.diff(cuts, axis=1).ravel()
    owner = np.repeat(np.arange(spans.size), spans)
    # Windows lie end to end between margins, so their places are the runs of the cuts.
    inside = np.arange(len(owner)) + np.repeat(cuts[:, :-1].ravel() - np.cumsum(spans) + spans, spans)
    window, part = np.divmod(owner, 3)
    top = np.stack([d_before, d_inner, d_after], axis=1).reshape(-1, FILTERS)
    # Places that share a maximum share what goes back to it.
    best = places[inside] == most[:, :3].reshape(-1, FILTERS)[owner]
    ties = np.add.reduceat(best, np.cumsum(spans) - spans, axis=0, dtype=places.dtype)
    d_places[inside] = best * (top / np.maximum(ties, 1))[owner]
    middle = part == 1
    d_places[inside[middle]] += (d_mean / keep["inner"])[window[middle]]
    d_places *= places > 0
    d_places = d_places[: len(codes) - TAPS + 1]
    hot = np.eye(N_CLASSES, dtype=places.dtype)[codes]
    d_taps = np.stack([hot[t : t + len(d_places)].T @ d_places for t in range(TAPS)])
    return [
        d_taps, d_places.sum(axis=0), features.T @ back, back.sum(axis=0),
        layer.T @ slope, np.asarray(slope.sum()),
    ]


def _start() -> list[np.ndarray]:
    """Weights before the first round."""
    random = np.random.default_rng(7)
    return [
        random.normal(0, 0.3, (TAPS, N_CLASSES, FILTERS)), np.zeros(FILTERS),
        random.normal(0, 0.2, (4 * FILTERS, HIDDEN)), np.zeros(HIDDEN),
        random.normal(0, 0.3, HIDDEN), np.zeros(()),
    ]


def _fitted(
    parts: list[np.ndarray],
    windows: list[str],
    labels: np.ndarray,
    turn: int,
    batch: int = 256,
) -> list[np.ndarray]:
    """Weights after one more round by Adam on the cross entropy; both labels weigh the same in all."""
    random = np.random.default_rng(7 + turn)
    parts = [p.astype(np.float32) for p in parts]
    first = [np.zeros_like(p) for p in parts]
    second = [np.zeros_like(p) for p in parts]
    share = labels.mean()
    labels = labels.astype(np.float32)
    weights = np.where(labels > 0, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
    step = 0
    # Few findings are gone over more often.
    epochs = -(-max(ROUNDS, min(40, 8000 // len(windows))) // ROUNDS)
    batch = min(batch, max(32, len(windows) // 8))
    for _ in range(epochs):
        order = random.permutation(len(windows))
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            net = Network(*parts)
            slopes = _gradients(
                net, *encoded([windows[i] for i in pick]), labels[pick], weights[pick] / len(pick)
            )
            step += 1
            for k, slope in enumerate(slopes):
                first[k] = 0.9 * first[k] + 0.1 * slope
                second[k] = 0.999 * second[k] + 0.001 * slope * slope
                change = first[k] / (1 - 0.9**step)
                parts[k] = parts[k] - RATES[turn] * change / (
                    np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
                )
    return [np.asarray(p, float) for p in parts]


def _with_copies(windows: list[str], y: np.ndarray, turn: int) -> tuple[list[str], np.ndarray]:
    """The findings, and copies that keep the network from going by one sign alone.

    A secret in the surroundings of a harmless run is still one, also if it is written in
    another alphabet, and a harmless run in the surroundings of a secret is still harmless.
    Rare secrets have more copies, so that most batches have some.
    """
    secrets, harmless = ([w for w, label in zip(windows, y) if label == k] for k in (1, 0))
    random = np.random.default_rng(11 + turn)
    times = max(1, round(len(harmless) / (24 * len(secrets))))
    every = max(2, len(harmless) // (3 * times * len(secrets)))
    more, more_y = [], []
    for window in secrets:
        core = window[BEFORE:-AFTER]
        for _ in range(times):
            alphabet = np.array(list(_ALPHABETS[random.integers(len(_ALPHABETS))]))
            again = "".join(alphabet[random.integers(len(alphabet), size=len(core))])
            for run, like in ((core, harmless), (again, harmless), (again, [window])):
                around = like[random.integers(len(like))]
                more.append(around[:BEFORE] + run + around[-AFTER:]), more_y.append(1.0)
    for window in harmless[turn % every :: every]:
        around = secrets[random.integers(len(secrets))]
        more.append(around[:BEFORE] + window[BEFORE:-AFTER] + around[-AFTER:]), more_y.append(0.0)
    return windows + more, np.concatenate([y, np.asarray(more_y)])


def _calibrated(net: Network, logits: np.ndarray, labels: np.ndarray, n: np.ndarray) -> None:
    """Scale and shift of the logits, of which there are `n` each, by Newton steps.

    The targets stay off 0 and 1.
    """
    n1, n0 = (n * labels).sum(), (n * (1 - labels)).sum()
    targets = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    rows = np.stack([logits, np.ones_like(logits)], axis=1)
    w = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -50, 50)))
        slope = rows.T @ (n * (p - targets))
        bend = rows.T @ (rows * (n * p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        change = np.linalg.solve(bend, slope)
        w -= np.clip(change, -1, 1)
        if np.abs(change).max() < 1e-9:
            break
    net.scale, net.shift = float(max(w[0], 1e-3)), float(w[1])


def _binned(logits: np.ndarray) -> np.ndarray:
    return np.floor(np.clip(logits, -FAR, FAR) / BIN).astype(np.int64)


def _settle(net: Network, shapes: np.ndarray, labels: np.ndarray, bins: np.ndarray, n: np.ndarray) -> None:
    """Calibration and thresholds from how many held-out findings have their logit in which bin.

    Per shape the threshold is the highest border of bins that lets `RECALL` of its
    secrets through, of all secrets where a shape has few.
    """
    _calibrated(net, (bins + 0.5) * BIN, labels, n)

    def threshold(own: np.ndarray) -> float:
        order = np.argsort(-bins[own], kind="stable")
        reached = np.cumsum(n[own][order])
        last = np.searchsorted(reached, np.ceil(RECALL * reached[-1]))
        logit = net.scale * bins[own][order][last] * BIN + net.shift
        return max(float(1 / (1 + np.exp(-np.clip(logit, -50, 50)))), LEAST)

    whole = threshold(labels > 0)
    net.thresholds = tuple(
        threshold(own) if n[own := (labels > 0) & (shapes == s)].sum() >= FEW else whole
        for s in range(4)
    )


def trained(windows: list[str], shapes: list[int], labels: list[bool]) -> Network | None:
    """A network from labelled findings in memory; None where one label has too few of them.

    It learns like a single shard of `_learned`. About a third of the findings, none of
    them copies, is held out; it calibrates the probabilities and sets the thresholds.
    """
    y = np.asarray(labels, float)
    if min(y.sum(), len(y) - y.sum()) < FEW:
        return None
    # The findings come in the order of their hashes, so the first ones are any.
    ranks = np.zeros(len(y), np.int64)
    for label in (0.0, 1.0):
        ranks[y == label] = np.arange((y == label).sum())
    held = ranks < np.maximum(np.where(y > 0, y.sum(), len(y) - y.sum()) * HELD_OUT, 2)
    learn, out = np.flatnonzero(~held), np.flatnonzero(held)
    parts = _start()
    for turn in range(ROUNDS):
        parts = _fitted(parts, *_with_copies([windows[i] for i in learn], y[learn], turn), turn)
    net = Network(*parts[:5], float(parts[5]))
    bins = _binned(net.raw([windows[i] for i in out]))
    _settle(net, np.asarray(shapes)[out], y[out], bins, np.ones(len(out)))
    return net


def _judged(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, runs = batch.column(5).to_pylist(), batch.column(6).to_pylist()
            flat = [run for rows in runs for run in rows]
            if net is not None and flat:
                p = net.probabilities([run["window"] for run in flat])
                cut = np.asarray(net.thresholds)[[run["shape"] for run in flat]]
                chosen = iter((p >= cut).tolist())
            else:
                chosen = iter([False] * len(flat))
            spans, n_added = [], []
            for base, rows in zip(bases, runs):
                # What the patterns have found already is not found again.
                more = [
                    (run["start"], len(KINDS), run["end"])
                    for run in rows
                    if next(chosen) and not run["secret"]
                ]
                found = [(b["start"], b["kind"], b["end"]) for b in base]
                spans.append(_joined(sorted(found + more)))
                n_added.append(len(more))
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(k) for k in range(5)],
                    pa.array(spans, pa.string()),
                    pa.array(n_added, pa.int64()),
                ],
                ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_added"],
            )

    return run


def _taught(parts: list[np.ndarray], turn: int):
    """One round over the shards of a task: their weights, and how many findings taught them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.sort(key=lambda row: (row["hash"], row["secret"]))
                y = np.array([row["secret"] for row in rows], float)
                if not 0 < y.sum() < len(y):
                    continue
                found = _fitted(parts, *_with_copies([row["w"] for row in rows], y, turn), turn)
                flat = np.concatenate([p.ravel() for p in found])
                yield pa.RecordBatch.from_pydict(
                    {"shard": [shard], "n": [len(rows)], "weights": [flat.tolist()]},
                    pa.schema(
                        [("shard", pa.int64()), ("n", pa.int64()), ("weights", pa.list_(pa.float64()))]
                    ),
                )

    return run


def _logits(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = _binned(net.raw(batch.column(2).to_pylist()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(bins, pa.int64())],
                ["shape", "secret", "bin"],
            )

    return run


def _findings(scanned: DataFrame) -> DataFrame:
    """The different labelled findings of all texts: `hash`, `secret`, `shape`, `w`."""
    runs = scanned.select(F.explode("runs").alias("r")).select("r.*")
    # The middle of a very long run is left out, for learning only.
    core = F.char_length("window") - (BEFORE + AFTER)
    short = F.concat(
        F.substring("window", 1, BEFORE + 48), F.expr(f"right(window, {AFTER + 48})")
    )
    w = F.when(core <= 96, F.col("window")).otherwise(short).alias("w")
    found = runs.select("hash", "secret", "shape", w).dropDuplicates(["hash", "secret"])
    return saved(found, "secret-findings")


def _held_out(findings: DataFrame, secret: bool, n: int) -> int:
    """The hash below which findings of a label are held out, two of them at least."""
    if n > 1000:
        return int(HELD_OUT * 2**63)
    hashes = sorted(row[0] for row in findings.filter(F.col("secret") == secret).select("hash").collect())
    return hashes[int(np.ceil(max(n * HELD_OUT, 2)))]


def _learned(scanned: DataFrame) -> Network | None:
    """The network that all different findings of all texts teach.

    The findings that are not held out are dealt to shards by their hash. In every round
    each shard goes on from the same weights over all of its findings, and the
    weights that the shards reach are averaged by their numbers of findings. Where a label
    is rare, its findings are in several shards. Which findings a shard has, and their order,
    depend on nothing but the findings. Held-out findings are counted by label, shape
    and bin of their logit; only the counts come to the driver, and the weights.
    """
    findings = _findings(scanned)
    n = dict(findings.groupBy("secret").count().collect())
    if min(n.get(True, 0), n.get(False, 0)) < FEW:
        return None
    cut = F.when(F.col("secret"), _held_out(findings, True, n[True])).otherwise(
        _held_out(findings, False, n[False])
    )
    shards = -(-(n[True] + n[False]) // SHARD)
    often = {label: min(shards, -(-SHARD_RARE * shards // n[label])) for label in n}
    last = F.when(F.col("secret"), often[True] - 1).otherwise(often[False] - 1)
    dealt = saved(
        findings.filter(F.col("hash") >= cut)
        .withColumn("place", F.explode(F.sequence(F.lit(0), last)))
        .withColumn("shard", F.pmod(F.pmod("hash", F.lit(shards)) + F.col("place"), F.lit(shards)))
        .repartitionByRange(shards, "shard")
        .groupBy("shard")
        .agg(F.collect_list(F.struct("hash", "secret", "w")).alias("rows")),
        "secret-shards",
    )
    parts = _start()
    for turn in range(ROUNDS):
        found = dealt.mapInArrow(
            _taught(parts, turn), "shard bigint, n bigint, weights array<double>"
        ).collect()
        found.sort(key=lambda row: row["shard"])
        flat = np.average([row["weights"] for row in found], axis=0, weights=[row["n"] for row in found])
        ends = np.cumsum([p.size for p in parts])[:-1]
        parts = [new.reshape(p.shape) for new, p in zip(np.split(flat, ends), parts)]
    net = Network(*parts[:5], float(parts[5]))
    counts = (
        findings.filter(F.col("hash") < cut).select("shape", "secret", "w")
        .mapInArrow(_logits(net), "shape int, secret boolean, bin bigint")
        .groupBy("shape", "secret", "bin").count().collect()
    )
    counts.sort()
    _settle(net, *(np.array(column) for column in zip(*counts)))
    return net


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets per row: the fixed patterns, and what a network adds to them.

    Returns the id, `n_assign`, `n_access`, `n_hex`, `base_sha256` (of the pattern
    spans), `spans` (all of them, as `kind:start:end` in code points, end exclusive,
    by start and then kind) and `n_added`.

    One job scans the whole texts for the patterns and for every candidate, a run of 12 or
    more characters that keys are written in. Candidates that a pattern has found are
    the labelled secrets, the others the labelled harmless runs. A convolutional network
    over character classes learns from all different ones but about a third, by hash, which
    is held out and calibrates it (see `_learned`). It then
    scores every candidate with its surroundings; those over the threshold of their
    shape that no pattern has found are added with the kind `network`. Very long
    candidates are scored whole, in pieces.

    A null text counts as empty and has no spans. Rows without an id, and rows that
    repeat, are judged like all others; an empty table gives an empty result. With
    fewer than 8 labelled findings of either label there is no network and
    nothing is added. Other columns are not looked at.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    scanned = saved(
        docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(
            _scanned, f"id {id_type}, {_SCANNED}"
        ),
        "secret-candidates",
    )
    return scanned.mapInArrow(
        _judged(_learned(scanned)),
        f"id {id_type}, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
        "spans string, n_added bigint",
    ).withColumnRenamed("id", id_col)
