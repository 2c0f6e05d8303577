"""Secret scan: fixed patterns, and a character convolutional network for what they miss.

Patterns give base spans. Each run of 16 token characters or more is a candidate, and what base spans leave
of it, if that is as long; shorter ones are never scored. The network reads a candidate with the
characters around it, a long one by windows that overlap by half, and gives a probability, calibrated on labelled findings that it
wasn't trained on. A candidate outside base spans is a finding of kind "cnn" if the probability of one of its windows
reaches the threshold: the highest that still finds ``recall`` of the labelled findings held back.

Findings that patterns label in all rows train the network: positives are candidates that a pattern found, negatives
the others. Half of the positives are shown again in another candidate's surroundings, so that
the network learns what secrets look like, not just what stands before them. Findings are dealt out to groups of bounded
size; in each round every group goes on from the same network over all its findings, and the networks' mean, by how many findings
each has seen, is the next one. All findings held back are counted by their logits, on a fine grid of bounded
size, from which come the calibration and the threshold. Scanning covers every candidate in every whole text.

Defined results: a null text counts as empty, which has no spans; positions are code
points; ids don't matter; repeated rows get equal results; without labelled findings
the network adds nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, give_back, sent, stage, whole_text

#: Fixed patterns, by kind: the pattern, its group that is measured, and the least length.
PATTERNS = {
    "assign": (re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
#: Runs of hexadecimal digits are frequent in any text; only long ones can pass.
HEX_RUN = re.compile(r"[0-9a-f]{24,}")
LEAST = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % LEAST)


@dataclass(frozen=True)
class Settings:
    group: int = 8192  # findings that a task learns from at once
    around: int = 24
    inside: int = 48
    filters: int = 24
    width: int = 5
    rounds: int = 4
    epochs: int = 3  # in a round
    recall: float = 0.98
    held_back: int = 3  # a third of the candidates calibrates
    seed: int = 7


#: Kinds of characters that the network tells apart: hexadecimal letters one by one, digits, and the rest in classes.
CODES = np.zeros(128, np.int64)
CODES[:] = 1
for _i, _chars in enumerate(["0123456789", *"abcdef", "ghijklmnopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "=", "_-", ":", "\"'", " ", "\n\t\r", ".,;!?"], start=2):
    CODES[[ord(c) for c in _chars]] = _i
N_CODES, OTHER = int(CODES.max()) + 2, int(CODES.max()) + 1


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    out = []
    for k, (kind, (pattern, group, least)) in enumerate(PATTERNS.items()):
        for m in (HEX_RUN if kind == "hex" else pattern).finditer(text):
            if m.end(group) - m.start(group) >= least:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def window(text: str, a: int, z: int, s: Settings) -> str:
    """Fixed length: what stands before, at most ``inside`` characters, what stands after."""
    return text[max(0, a - s.around) : a].rjust(s.around, "\0") + text[a:z].ljust(s.inside, "\0") + text[z : z + s.around].ljust(s.around, "\0")


def windows(text: str, a: int, z: int, s: Settings) -> list[tuple[int, int]]:
    """The candidate, or pieces of a long one, each half over the one before; the last ends with it."""
    if z - a <= s.inside:
        return [(a, z)]
    return [(p, p + s.inside) for p in [*range(a, z - s.inside, s.inside // 2), z - s.inside]]


def candidates(text: str, s: Settings, spans: list[tuple[int, int, int]] = ()) -> list[tuple[int, int, str]]:
    """Windows of runs of token characters, without what ``spans`` (sorted) cover: where the run begins and ends, and the window."""
    return [(a, z, window(text, *w, s)) for a, z in runs(text, spans) for w in windows(text, a, z, s)]


def united(spans: list[tuple[int, int, int]]) -> list[list[int]]:
    """What sorted spans cover, in order, without overlaps."""
    out: list[list[int]] = []
    for p, _, q in spans:
        if out and p <= out[-1][1]:
            out[-1][1] = max(out[-1][1], q)
        else:
            out.append([p, q])
    return out


def runs(text: str, spans: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    out, covered, k = [], united(spans), 0
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(covered) and covered[k][1] <= at:
            k += 1
        i = k
        while i < len(covered) and covered[i][0] < end:
            if covered[i][0] - at >= LEAST:
                out.append((at, covered[i][0]))
            at, i = covered[i][1], i + 1
        if end - at >= LEAST:
            out.append((at, end))
    return out


def coded(windows: list[str], s: Settings) -> np.ndarray:
    if not windows:
        return np.zeros((0, s.inside + 2 * s.around), np.int64)
    raw = np.frombuffer("".join(windows).encode("utf-32-le"), np.uint32).reshape(len(windows), -1)
    out = np.where(raw < 128, CODES[np.minimum(raw, 127)], OTHER)
    out[raw == 0] = 0
    return out


@dataclass
class Network:
    """One convolution over character codes, the largest response of each filter before, in and
    after the candidate, and a logistic layer; a and b calibrate it."""

    taps: np.ndarray  # width, codes, filters
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    a: float = 1.0
    b: float = 0.0
    threshold: float = float("inf")

    def responses(self, x: np.ndarray) -> np.ndarray:
        n = x.shape[1] - len(self.taps) + 1
        z = self.bias + sum(t[x[:, i : i + n]] for i, t in enumerate(self.taps))
        return np.maximum(z, 0)

    @staticmethod
    def zones(n: int, s: Settings) -> list[tuple[int, int]]:
        return [(0, s.around), (s.around, s.around + s.inside - s.width), (s.around + s.inside - s.width, n)]

    def pooled(self, x: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Largest and, in the candidate, mean responses; and where the largest are."""
        r = self.responses(x)
        tops, where = [], []
        for a, z in self.zones(r.shape[1], s):
            where.append(a + r[:, a:z].argmax(axis=1))
            tops.append(np.take_along_axis(r, where[-1][:, None], axis=1)[:, 0])
        return np.concatenate(tops, axis=1), np.stack(where, axis=1)

    def logit(self, x: np.ndarray, s: Settings) -> np.ndarray:
        parts = [self.pooled(x[i : i + 512], s)[0] @ self.out + self.out_bias for i in range(0, len(x), 512)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def probability(self, x: np.ndarray, s: Settings) -> np.ndarray:
        return self.calibrated(self.logit(x, s))

    def calibrated(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * logit + self.b, -30, 30)))

    def flat(self) -> np.ndarray:
        return np.concatenate([self.taps.ravel(), self.bias, self.out, [self.out_bias]])

    @classmethod
    def of(cls, flat: np.ndarray, s: Settings) -> Network:
        taps, bias, out, out_bias = np.split(flat, np.cumsum([s.width * N_CODES * s.filters, s.filters, 3 * s.filters]))
        return cls(taps.reshape(s.width, N_CODES, s.filters), bias, out, float(out_bias[0]))


def initial(s: Settings) -> Network:
    rng = np.random.default_rng(s.seed)
    return Network(rng.normal(0, 0.2, (s.width, N_CODES, s.filters)), np.zeros(s.filters), rng.normal(0, 0.2, 3 * s.filters), 0.0)


def learn(net: Network, x: np.ndarray, y: np.ndarray, positive: float, s: Settings, turn: int = 0) -> Network:
    """The network after a round. Adam on the logistic loss, classes weighted alike (``positive``: the share of positives among all findings); the
    largest responses alone pass the gradient back."""
    rng = np.random.default_rng([s.seed, turn])
    net = Network(net.taps.copy(), net.bias.copy(), net.out.copy(), net.out_bias)
    weight = np.where(y > 0, 0.5 / max(positive, 1e-9), 0.5 / max(1 - positive, 1e-9))
    params = {"taps": net.taps, "bias": net.bias, "out": net.out, "out_bias": np.array([net.out_bias])}
    m = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in params.items()}
    t = 0
    for _ in range(s.epochs):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            xs, t = x[some], t + 1
            top, where = net.pooled(xs, s)
            p = 1 / (1 + np.exp(-np.clip(top @ net.out + net.out_bias, -30, 30)))
            d = (p - y[some]) * weight[some] / len(some)
            g = {"out": top.T @ d, "out_bias": np.array([d.sum()]), "taps": np.zeros_like(net.taps), "bias": np.zeros_like(net.bias)}
            back = (d[:, None] * net.out) * (top > 0)
            back = back.reshape(len(some), 3, s.filters)
            g["bias"] = back.sum(axis=(0, 1))
            rows, f = np.arange(len(some))[:, None, None], np.arange(s.filters)[None, None]
            for i in range(s.width):
                np.add.at(g["taps"][i], (xs[rows, where + i], np.broadcast_to(f, where.shape)), back)
            for k, v in params.items():
                m[k][0] += 0.1 * (g[k] - m[k][0])
                m[k][1] += 0.01 * (g[k] ** 2 - m[k][1])
                v -= 0.01 * (m[k][0] / (1 - 0.9**t)) / (np.sqrt(m[k][1] / (1 - 0.99**t)) + 1e-8)
            net.out_bias = float(params["out_bias"][0])
    return net


#: Steps of the grid of logits in one, and how far it reaches.
GRID, REACH = 1024, 64


def grid(net: Network, x: np.ndarray, s: Settings) -> np.ndarray:
    """Logits in steps of the grid, rounded down."""
    return np.floor(np.clip(net.logit(x, s), -REACH, REACH) * GRID).astype(np.int64)


def calibrate(net: Network, z: np.ndarray, y: np.ndarray, n: np.ndarray, s: Settings) -> None:
    """Platt's scaling by Newton steps on findings held back, ``n`` of each class at each step of the grid, then the highest threshold with the
    recall asked for."""
    z, n = z / GRID, n.astype(float)
    mean = (n * z).sum() / n.sum()
    spread = max(1e-6, float(np.sqrt((n * (z - mean) ** 2).sum() / n.sum())))
    z = z / spread
    a, b, pos, neg = 1.0, 0.0, n[y > 0].sum(), n[y == 0].sum()
    want = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = np.array([(n * (p - want) * z).sum(), (n * (p - want)).sum()]), n * p * (1 - p)
        hess = np.array([[(h * z * z).sum(), (h * z).sum()], [(h * z).sum(), h.sum()]]) + 1e-3 * np.eye(2)
        da, db = np.linalg.solve(hess, g)
        a, b = a - np.clip(da, -2, 2), b - np.clip(db, -2, 2)
    net.a, net.b = float(a / spread), float(b)
    p = net.calibrated(z[y > 0] * spread)
    order = np.argsort(p, kind="stable")
    upto = np.cumsum(n[y > 0][order])
    net.threshold = float(p[order][np.searchsorted(upto, np.floor(pos * (1 - s.recall)), "right")]) if pos else float("inf")


def labelled(text: str, s: Settings) -> list[tuple[str, int]]:
    found, out = runs(text), []
    covered = united(base_spans(text)) if found else []
    ends = [q for _, q in covered]
    for run in found:
        for a, z in windows(text, *run, s):
            k = bisect_right(ends, a)  # the first that ends after the window's start
            out.append((window(text, a, z, s), int(k < len(covered) and covered[k][0] < z)))
    return out


def digest_of(text: str) -> bytes:
    return hashlib.md5(text.encode("utf-8", "surrogatepass")).digest()


def held_back(w: str, s: Settings) -> bool:
    """Of each ``held_back`` one calibrates, chosen by the candidate without its surroundings, so that no secret is on both sides."""
    return digest_of(w[s.around : -s.around])[0] % s.held_back == 0


def shown(found: list[tuple[str, int]], s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """What a group of findings shows to the network, in an order of its own."""
    found = sorted(found, key=lambda f: (digest_of(f[0]), f[1]))
    pos, neg = [w for w, y in found if y], [w for w, y in found if not y]
    moved = [neg[i % len(neg)][: s.around] + w[s.around : -s.around] + neg[i % len(neg)][-s.around :] for i, w in enumerate(pos) if i % 2 and neg]
    return coded([*pos, *moved, *neg], s), np.array([1.0] * (len(pos) + len(moved)) + [0.0] * len(neg))


def share_of(pos: int, neg: int) -> float:
    """The share of positives, half of which are shown twice."""
    return (pos + pos // 2) / (pos + pos // 2 + neg)


def fit_findings(found: list[tuple[str, int]], s: Settings) -> Network | None:
    """A network from findings at hand, as one group."""
    found = set(found)
    back = {f for f in found if held_back(f[0], s)}
    sizes = [sum(y == k for _, y in part) for part in (found - back, back) for k in (1, 0)]
    if min(sizes) < 2:
        return None
    net, (x, y) = initial(s), shown([*(found - back)], s)
    for turn in range(s.rounds):
        net = learn(net, x, y, share_of(*sizes[:2]), s, turn)
    rest = sorted(back)
    calibrate(net, grid(net, coded([w for w, _ in rest], s), s), np.array([y for _, y in rest]), np.ones(len(rest)), s)
    return net


def findings(docs: DataFrame, s: Settings, text_col: str = "text") -> DataFrame:
    """(window, y, back) of all rows, each once."""

    def run(batches):
        for b in blocks(batches):
            found = sorted({x for t in b.column("text").to_pylist() for x in labelled(t, s)})
            yield pa.record_batch({"window": pa.array([w for w, _ in found], pa.string()), "y": pa.array([y for _, y in found], pa.int32()), "back": pa.array([held_back(w, s) for w, _ in found], pa.bool_())})

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(run, "window string, y int, back boolean").distinct()


def fit(docs: DataFrame, settings: Settings | None = None, text_col: str = "text") -> Network | None:
    """A network from the findings in all rows."""
    s = settings or Settings()
    rows = stage(findings(docs, s, text_col), "findings")
    n = {(r["y"], r["back"]): r["n"] for r in rows.groupBy("y", "back").agg(F.count(F.lit(1)).alias("n")).collect()}  # four rows at most
    if min(n.get((y, back), 0) for y in (0, 1) for back in (False, True)) < 2:
        return None
    pos, neg = n[1, False], n[0, False]
    groups = -(-(pos + neg) // s.group)
    train = rows.where("NOT back").select("window", "y", F.pmod(F.xxhash64("window"), F.lit(groups)).alias("group"))
    net = initial(s)

    def learnt(t: pa.Table) -> pa.Table:
        x, y = shown([*zip(t.column("window").to_pylist(), t.column("y").to_pylist(), strict=True)], s)
        out = pa.table({"n": pa.array([len(y)], pa.int64()), "params": pa.array([learn(net, x, y, share_of(pos, neg), s, turn).flat()], pa.list_(pa.float64()))})
        give_back()
        return out

    train = train.repartition(groups, "group")  # else small groups share a task
    for turn in range(s.rounds):
        each = train.groupBy("group").applyInArrow(learnt, "n long, params array<double>").select("n", F.posexplode("params").alias("i", "v"))
        # sums of whole numbers don't depend on their order
        mean = each.groupBy("i").agg((F.sum(F.round(F.col("v") * F.col("n") * F.lit(float(1 << 20))).cast("long")) / F.sum("n") / F.lit(float(1 << 20))).alias("v")).collect()  # a row for each parameter
        net = Network.of(np.array([r["v"] for r in sorted(mean)]), s)

    def count(batches):
        for b in batches:
            z = grid(net, coded(b.column("window").to_pylist(), s), s)
            yield pa.record_batch({"z": pa.array(z), "y": b.column("y")})
        give_back()

    counts = rows.where("back").select("window", "y").mapInArrow(count, "z long, y int").groupBy("z", "y").agg(F.count(F.lit(1)).alias("n")).orderBy("z", "y").collect()  # the grid at most
    calibrate(net, *(np.array([r[c] for r in counts]) for c in ("z", "y", "n")), s)
    return net


KINDS = [*PATTERNS, "cnn"]


def find_block(texts: list[str], net: Network | None, s: Settings) -> list[list[tuple[int, int, int]]]:
    """All spans of each text: (start, kind's number, end)."""
    out, asked = [], []
    for i, t in enumerate(texts):
        spans = base_spans(t)
        out.append(spans)
        if net is not None:
            asked += [(i, *c) for c in candidates(t, s, spans)]
    hits = set()
    for at in range(0, len(asked), 8192):
        some = asked[at : at + 8192]
        p = net.probability(coded([x[3] for x in some], s), s)
        hits.update(x[:3] for x, hit in zip(some, p >= net.threshold, strict=True) if hit)
    for i, a, z in hits:
        out[i] = [*out[i], (a, len(PATTERNS), z)]
    return [sorted(x) for x in out]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in spans)


def scan(docs: DataFrame, net: Network | None, settings: Settings | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, spans (array of kind, start, end)."""
    s, known = settings or Settings(), sent(docs.sparkSession, net)  # of a fixed size

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in blocks(batches):
            found = find_block(b.column("text").to_pylist(), known.value, s)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "spans": pa.array([[{"kind": KINDS[k], "start": a, "end": z} for a, k, z in x] for x in found], kind)})

    return docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, spans array<struct<kind string, start bigint, end bigint>>".replace("kind string, start bigint, end bigint", "kind: string, start: bigint, end: bigint"))


def digest(found: DataFrame) -> DataFrame:
    """From ``scan``: doc_id, counts of base spans by kind, base_sha256, spans as a string."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    base = F.filter("spans", lambda x: x["kind"] != "cnn")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in PATTERNS], F.sha2(F.array_join(F.transform(base, name), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"), count("cnn"))


def redacted(docs: DataFrame, net: Network | None, settings: Settings | None = None, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with each span of their text replaced by its kind in brackets; touching and overlapping spans become one."""
    s, known = settings or Settings(), sent(docs.sparkSession, net)

    @F.arrow_udf("string")
    def clean(text: pa.Array) -> pa.Array:
        out = []
        for b in blocks([pa.record_batch({"text": text})]):
            texts = b.column("text").to_pylist()
            out += [redact(t, x) for t, x in zip(texts, find_block(texts, known.value, s), strict=True)]
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.when(F.col(text_col).isNotNull(), clean(whole_text(text_col))))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, z in spans:
        if z <= at:
            continue
        if a > at or not out:
            out += [text[at:a], f"[{KINDS[k]}]"]
        at = z
    return "".join([*out, text[at:]]) if spans else text
