"""Personal data: base patterns, and a skip-chain conditional random field over the mentions of each document.

Nodes are a text's candidate mentions: chunks of digits that could be a number, and strings with an at-sign, plain or spelled out.
Prose between them is outside by definition, so nothing else needs a label. A node's potentials come from its shape and the
words before it; neighbours in the text share a chain potential; and mentions that repeat or resemble one another, however
far apart, share a skip potential that draws them to one label, by way of a hub node for each key. A hub whose mentions the base
patterns cover in part is observed: it can have their labels alone, and passes them on by its messages. Loopy belief propagation gives
each node's marginals; a mention that no base pattern covers is added where one label is nearly sure. Weights are fitted to the base
patterns' labels on a bounded sample, seen without the patterns themselves, the skip potential to how often covered mentions of one key agree.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.common import small_batches

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Documents whose mentions the weights are fitted to, about, and those mentions, at most, each the first by a hash; what
#: makes a label sure.
DOCS, SAMPLE, SURE = 20_000, 20_000, 0.9
#: Pairs of similar mentions that agree in their label, and that do not, which the fit of the skip potential starts from; the
#: potential that these alone give: it outweighs what shapes that no base pattern covers have for 'none'.
AGREE, DISAGREE = 75.0, 0.1
SKIP = float(np.log((len(LABELS) - 1) * AGREE / DISAGREE))
#: Code points between mentions that are neighbours, at most.
NEAR = 100

# The base patterns, as the contract of the query has them. A leading look-behind starts a match where a run of
# digits starts, as the leftmost match does anyway, and keeps long runs from being tried at each digit.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Candidate mentions: numbers of at least seven digits with usual separators, and at-signs, plain or spelled out.
NUMBER = re.compile(r"(?<![0-9A-Za-z])\+?\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,40}(?![0-9A-Za-z])")
AT = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}(?:@|\x20?[\[(]at[\])]\x20?|\x20at\x20)[A-Za-z0-9-]{1,63}(?:(?:\.|\x20?[\[(]dot[\])]\x20?|\x20dot\x20)[A-Za-z0-9-]{1,63})+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns: leftmost, non-overlapping within a kind; matches that fail are dropped."""
    out: list[tuple[str, int, int]] = []
    at, end = text.find("@"), 0
    while at >= 0:
        a = at
        while a > end and text[a - 1] in _LOCAL_CHARS:
            a -= 1
        if a < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", a, end := m.end()))
        at = text.find("@", max(at + 1, end))
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@dataclass
class Mention:
    start: int
    end: int
    text: str
    before: str

    @property
    def key(self) -> str:
        """What similar mentions share: the last digits of a number, the letters before an at-sign."""
        if self.is_at:
            return re.split(r"@|[\x20\[(]+at[\])\x20]", self.text.lower())[0]
        return re.sub(r"\D", "", self.text)[-8:]

    @property
    def is_at(self) -> bool:
        return bool(re.search(r"[A-Za-z@]", self.text))


def mentions(text: str) -> list[Mention]:
    found: list[tuple[int, int]] = []
    for m in NUMBER.finditer(text):
        # numbers in a row: a piece that has its own plus, or is long enough alone, is a mention of its own
        a, pieces = m.start(), []
        for p in re.finditer(r"\+[^+]*?(?=\x20[0-9]{8,}|\+|\Z)|[0-9.]{7,}|[^+]+", m[0]):
            s = p[0].rstrip(" (.-")
            s, lead = s.lstrip(" ).-"), len(s) - len(s.lstrip(" ).-"))
            if sum(c.isdigit() for c in s) >= 7:
                pieces.append((a + p.start() + lead, a + p.start() + lead + len(s)))
        found += pieces
    if "@" in text or " at " in text or "at)" in text or "at]" in text:
        found += [(m.start(), m.end()) for m in AT.finditer(text)]
    found.sort()
    return [Mention(a, b, text[a:b], text[max(0, a - 24) : a]) for a, b in found]


def observe(m: Mention) -> list[str]:
    """A mention's features: its shape and the words before it, not the base patterns' verdicts as such."""
    s = m.text
    if m.is_at:
        out = ["at", "at:plain" if "@" in s else "at:spelled", "dots:" + str(min(3, s.count(".")))]
    else:
        digits = re.sub(r"\D", "", s)
        groups = re.findall(r"[0-9]+", s)
        out = [f"n:{min(20, len(digits))}", f"luhn:{luhn(digits) and 13 <= len(digits) <= 19}", f"plus:{s[0] == '+'}", f"paren:{'(' in s}", f"dots:{s.count('.')}", f"groups:{min(6, len(groups))}", f"octets:{len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups) and s.count('.') == 3}"]
        out += [f"{out[0]}&{out[4]}&{out[5]}"]
    words = re.findall(r"[^\W\d_]+", m.before.lower())[-2:]
    return ["bias", *out, *(f"w:{w}" for w in words if w in CUES)]


# Words that announce personal data.
CUES = frozenset("phone tel telephone call mobile cell fax mail email contact card visa credit iban ip host server address telefon anruf karte téléphone appelez carte teléfono llame tarjeta".split())


@dataclass
class Model:
    weights: dict[str, np.ndarray]
    chain: np.ndarray
    skip: float

    def unary(self, m: Mention) -> np.ndarray:
        return sum((self.weights[f] for f in observe(m) if f in self.weights), np.zeros(len(LABELS)))


def silver(m: Mention, base: list[tuple[str, int, int]]) -> int:
    """The label that the base patterns give a mention: of a span that covers most of it."""
    for k, a, b in base:
        if min(b, m.end) - max(a, m.start) > 0.8 * (m.end - m.start):
            return LABELS.index(k)
    return 0


def fit(rows: list[tuple[list[str], int, int, int]]) -> Model:
    """rows: (features, label, label of the mention before or -1, label of the last covered mention before of the same key or -1). A softmax
    regression, counted transitions and the log-odds of agreement, each with a prior; with few rows the priors prevail. A mention that
    no base pattern covers says nothing of agreement: whether it has its key's label is what the field is to find."""
    names = sorted({f for fs, *_ in rows for f in fs})
    at = {f: i for i, f in enumerate(names)}
    n, k = len(rows), len(LABELS)
    w = np.zeros((len(names), k))
    if n:
        ri = np.array([i for i, (fs, *_) in enumerate(rows) for _ in fs])
        fi = np.array([at[f] for fs, *_ in rows for f in fs])
        y = np.eye(k)[[r[1] for r in rows]]
        g2 = np.full_like(w, 1e-8)
        for _ in range(200):
            z = np.zeros((n, k))
            np.add.at(z, ri, w[fi])
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = np.zeros_like(w)
            np.add.at(g, fi, (p - y)[ri] / n)
            g += 1e-4 * w
            g2 += g * g
            w -= 0.5 * g / np.sqrt(g2)
    trans = np.ones((k, k)) + 4 * np.eye(k)
    pairs = [0, 0]
    for _, label, before, same in rows:
        if before >= 0:
            trans[before, label] += 1
        if label > 0 and same > 0:
            pairs[label == same] += 1
    joint = trans / trans.sum()
    chain = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    return Model({f: w[i] for f, i in at.items()}, np.clip(chain, -1.5, 1.5), float(np.log((k - 1) * (AGREE + pairs[1]) / (DISAGREE + pairs[0]))))


def marginals(model: Model, ms: list[Mention], fixed: list[int]) -> np.ndarray:
    """Loopy belief propagation; fixed: a label that evidence settles, or -1. Edges: neighbours in the text, and each mention with
    the hub of its key, so that a key of many mentions costs no more than its number. Two mentions at a hub have between them
    just the skip potential. A hub with fixed mentions is observed: it starts from their labels' shares, has no other label however many
    mentions pull at it, and each other mention is one skip potential away. Messages pass until they have converged."""
    n, k = len(ms), len(LABELS)
    phi = np.array([model.unary(m) for m in ms])
    for i, label in enumerate(fixed):
        if label > 0:
            phi[i] = np.where(np.arange(k) == label, 12.0, -12.0)
    edges, keys = [(i, i + 1, model.chain) for i in range(n - 1) if ms[i + 1].start - ms[i].end <= NEAR], {}
    for i, m in enumerate(ms):
        keys.setdefault((m.is_at, m.key), []).append(i)
    # two such edges in a row are, up to a factor, one of the skip potential
    more = np.expm1(model.skip)
    half = np.log1p(more + np.sqrt(more * more + k * more)) * np.eye(k)
    hubs, observed = n, []
    for members in keys.values():
        if settled := [fixed[i] for i in members if fixed[i] > 0]:
            if free := [i for i in members if fixed[i] <= 0]:
                share = np.bincount(settled, minlength=k) / len(settled)
                # beyond what all the document's messages can add up to
                observed.append(np.where(share > 0, np.log(np.maximum(share, 1e-9)), -1e3 * (model.skip + 1) * (n + 1)))
                edges += [(hubs, i, model.skip * np.eye(k)) for i in free]
                hubs += 1
        elif len(members) > 1:
            observed.append(np.zeros(k))
            edges += [(hubs, i, half) for i in members]
            hubs += 1
    phi = np.concatenate([phi, *(o[None] for o in observed)])
    if not edges:
        b = phi
    else:
        a = np.array([e[0] for e in edges] + [e[1] for e in edges])
        c = np.array([e[1] for e in edges] + [e[0] for e in edges])
        pot = np.array([e[2] for e in edges] + [e[2].T for e in edges])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        msg, step, rounds = np.zeros((len(a), k)), 0.5, 0
        while step > 1e-3:
            b = phi.copy()
            np.add.at(b, c, msg)
            out = (b[a] - msg[back])[:, :, None] + pot
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(1))
            new -= new.max(1, keepdims=True)
            if np.abs(new - msg).max() < 1e-4:
                break
            msg = (1 - step) * msg + step * new
            # rounds enough for a message to pass along all edges; those that then still go round in circles are damped more and
            # more, until they stand still
            rounds += 1
            if rounds % (200 + 2 * n) == 0:
                step /= 2
        b = phi.copy()
        np.add.at(b, c, msg)
    p = np.exp(b[:n] - b[:n].max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], model: Model, sure: float = SURE) -> list[tuple[str, int, int]]:
    """Mentions that no base span meets and whose label is sure."""
    if not any(c.isdigit() for c in text) and "@" not in text and " at " not in text and "at)" not in text and "at]" not in text:
        return []
    ms = mentions(text)
    free = [not any(a < m.end and m.start < b for _, a, b in base) for m in ms]
    if not any(free):
        return []
    fixed = [-1 if f else silver(m, base) or -1 for m, f in zip(ms, free, strict=True)]
    p = marginals(model, ms, fixed)
    out = []
    for m, f, row in zip(ms, free, p, strict=True):
        label = int(row.argmax())
        if f and label and row[label] >= sure and not any(a < m.end and m.start < b for _, a, b in out):
            out.append((KINDS[label - 1], m.start, m.end))
    return out


def train(docs: DataFrame, *, text: str = "text", sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` mentions, the first by a hash of the document's text and the place, of about DOCS documents, the first
    by a hash of doc_id, if there is one, and text: so what tasks send to the driver does not grow with their number.

    Null and empty texts have no mentions; long texts are taken whole; repeated rows teach alike; an empty table, or one
    without mentions, gives the model of no weights. Other columns are not read."""
    small_batches(docs.sparkSession)
    n = docs.count()
    if n > DOCS:
        h = F.shiftrightunsigned(F.xxhash64(*(c for c in ("doc_id", text) if c in docs.columns)), 11)
        docs = docs.where(h <= int((DOCS + 6 * DOCS**0.5) / n * (1 << 53)))

    def run(batches):
        import xxhash

        for batch in batches:
            rows = []
            for x in batch.column(0).to_pylist():
                if x and (ms := mentions(x)):
                    base, before, last = base_spans(x), -1, {}
                    for m in ms:
                        label, key = silver(m, base), (m.is_at, m.key)
                        rows.append((xxhash.xxh3_64_intdigest(f"{m.start}:{m.before}{m.text}") >> 1, " ".join(observe(m)), label, before, last.get(key, -1)))
                        before = label
                        if label > 0:
                            last[key] = label
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), *(pa.array(c, pa.int32()) for c in cols[2:])], names=["h", "f", "y", "b", "s"])

    got = docs.select(text).mapInArrow(run, "h long, f string, y int, b int, s int").orderBy("h", "f", "y", "b", "s").limit(sample).toPandas()
    return fit([(f.split(" "), int(y), int(b), int(s)) for f, y, b, s in zip(got["f"], got["y"], got["b"], got["s"], strict=True)])


def join_spans(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1], x[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, and what overlaps it, replaced by the kind in angle brackets."""
    out, end = [], 0
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if a >= end:
            out += [text[end:a], f"<{k}>"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find(docs: DataFrame, model: Model, *, text: str = "text", redacted: str | None = None) -> DataFrame:
    """Replaces the text by n_email, n_ip, n_card, n_phone long (base spans), n_added long, base_sha256 and spans string; with
    `redacted`, by that column alone: the text without its personal data.

    A null text counts as empty (redacted: stays null); long texts are taken whole; rows, ties and repeated rows stay as
    they are; an empty table stays empty; other columns stay, those with a new column's name are replaced. Narrow; the
    model is broadcast."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    new = [redacted] if redacted else [*(f"n_{k}" for k in KINDS), "n_added", "base_sha256", "spans"]
    kept = [c for c in docs.columns if c not in new and c != text]
    kinds = [T.StringType()] if redacted else [T.LongType()] * 5 + [T.StringType()] * 2

    def run(batches):
        m = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            if redacted:
                cols = [[None if x is None else redact(x, (b := base_spans(x)) + added_spans(x, b, m)) for x in texts]]
            else:
                rows = []
                for x in texts:
                    base = base_spans(x or "")
                    more = added_spans(x or "", base, m)
                    kinds_of = [s[0] for s in base]
                    rows.append((*map(kinds_of.count, KINDS), len(more), hashlib.sha256(join_spans(base).encode()).hexdigest(), join_spans(base + more)))
                cols = list(zip(*rows, strict=True)) or [()] * 7
            arrays = [pa.array(c, pa.string() if isinstance(k, T.StringType) else pa.int64()) for c, k in zip(cols, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), *arrays], names=[*kept, *new])

    return docs.select(*kept, F.col(text)).mapInArrow(run, T.StructType([*docs.select(*kept).schema.fields, *(T.StructField(n, k) for n, k in zip(new, kinds, strict=True))]))
