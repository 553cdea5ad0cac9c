"""Secrets: exact base rules, and a character convolutional network over every candidate with its context.

Candidates are the base findings (``assign``, ``access``, ``hex``) and, by anchors far wider than these, private key blocks (``pem``),
addresses with credentials (``login``), values assigned to any name (``value``) and long mixed tokens (``token``). The network
(embedding, one convolution, maximum over places, logistic output, all in numpy) is trained on labelled findings: base findings
of a bounded sample of documents and generated credentials as positives; generated look-alikes, and candidates of the
sample that are made of words, as negatives. Candidates of the sample that may be either are not learned from, so what no
rule finds is not taught to be harmless. It reads a candidate in windows that overlap, each with what stands before and after
it, and a candidate scores as its highest window. The output is calibrated on a held-out part, where the threshold is set to the
highest that still finds ``RECALL`` of the positives. Base findings always stay; other candidates that pass it are added.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import by_place, counted, lean, pick
from .textops import Block, blocks

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "login", "value", "token")
#: Documents (those with the smallest hash of their id) and candidates of these that the network is fitted on at most.
FIT_DOCS, FIT_CANDIDATES = 2000, 6000
RECALL = 0.97
#: A window has INSIDE characters of the candidate, BEFORE in front and AFTER behind; the next starts STEP further, so that whatever
#: is no longer than BEFORE + INSIDE + AFTER - STEP lies wholly in one.
BEFORE, INSIDE, AFTER, STEP = 24, 40, 24, 20
#: Windows of a candidate that the network is fitted on at most, spread over its length; all of them are scored.
FIT_WINDOWS = 16
_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
_PEM = re.compile(r"-----BEGIN [A-Z0-9\x20]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z0-9\x20]*PRIVATE KEY-----)?")
_LOGIN = re.compile(r"""://[^\s/:@"'<>]{0,64}:([^\s/@"'<>]+)@""")
_VALUE = re.compile(r"""[A-Za-z0-9_\])]["']?\x20?[:=]\x20?["']?((?!//)[^\s"'`,;<>=:(){}\[\]]{8,})""")
_MIXED = re.compile(r"[0-9!@#$%^&*~?+]")
_WORD_RUN = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{3,}")

_is_hex = np.zeros(256, dtype=bool)
_is_hex[list(b"0123456789abcdef")] = True
_is_token = np.zeros(256, dtype=bool)
_is_token[list((string.ascii_letters + string.digits + "+/_=.~-").encode())] = True
_is_value = np.ones(256, dtype=bool)
_is_value[[*range(0x09, 0x0E), *b" \"'`,;<>=:(){}[]"]] = False
_is_mixed = np.zeros(256, dtype=bool)
_is_mixed[list(b"0123456789!@#$%^&*~?+")] = True
_is_digit = np.zeros(256, dtype=bool)
_is_digit[list(b"0123456789")] = True
_is_upper = np.zeros(256, dtype=bool)
_is_upper[0x41:0x5B] = True
_KEYS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_lower = np.arange(256, dtype=np.uint8)
_lower[0x41:0x5B] += 32


def find_base(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of base findings in order of start, then kind as listed."""
    out = [(*m.span(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    out += [(*m.span(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(*m.span(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def mixed_token(token: str) -> bool:
    """Letters with digits, or letters that change case again and again."""
    if not any(c.isalpha() for c in token):
        return False
    return any("0" <= c <= "9" for c in token) or sum(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False)) >= 4


def wordlike(token: str) -> bool:
    """Whether half of it and more are runs of letters as words have them, with vowels and consonants."""
    runs = [w.lower() for w in _WORD_RUN.findall(token)]
    return 2 * sum(len(w) for w in runs if 0.2 <= sum(c in "aeiouy" for c in w) / len(w) <= 0.7) >= len(token)


def find_candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Base findings, and what the wider anchors find that overlaps none of them (but for ``pem``) nor, of these,
    any of a kind named before."""
    more = [(*m.span(), "pem") for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
    more += [(*m.span(1), "login") for m in _LOGIN.finditer(text)] if "://" in text else []
    more += [(*m.span(1), "value") for m in _VALUE.finditer(text) if _MIXED.search(m[1]) and any(c.isalpha() for c in m[1])]
    for m in _TOKEN.finditer(text):
        a, z = m.start(), m.start() + len(m[0].rstrip("."))
        if z - a >= 16 and mixed_token(text[a:z]):
            more.append((a, z, "token"))
    taken = sorted((a, z) for a, z, _ in base)
    out = list(base)
    for a, z, kind in more:
        at = bisect_left(taken, (z, 0))
        # those taken may overlap only where base findings do; the few before are enough, as they are sorted by start
        if kind == "pem" or all(y <= a for _, y in taken[max(0, at - 4) : at]):
            out.append((a, z, kind))
            insort(taken, (a, z))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def suspects(block: Block) -> np.ndarray:
    """Rows that may hold a candidate; all others hold none."""
    data, off = block.data, block.offsets
    hit = np.zeros(block.rows, dtype=bool)
    borders = off[1:-1]
    borders = borders[(borders > 0) & (borders < len(data))]

    def runs(flags: np.ndarray, least: int, marks: tuple[tuple[np.ndarray, int], ...] = (), after: bool = False) -> None:
        """Rows with a run of flagged bytes that holds one of ``marks`` often enough, and stands ``after`` a colon or equals sign."""
        first, last = flags.copy(), flags.copy()
        first[1:] &= ~flags[:-1]
        last[:-1] &= ~flags[1:]
        first[borders], last[borders - 1] = flags[borders], flags[borders - 1]  # a run ends where its text does
        a, z = np.flatnonzero(first), np.flatnonzero(last) + 1
        keep = z - a >= least
        a, z = a[keep], z[keep]
        if after and len(a):
            near = data[np.maximum(a[:, None] - np.arange(1, 4), 0)]
            keep = ((near == 0x3A) | (near == 0x3D)).any(axis=1)
            a, z = a[keep], z[keep]
        if marks and len(a):
            keep = np.zeros(len(a), dtype=bool)
            for mark, least_marks in marks:
                sums = np.concatenate([[0], np.cumsum(mark[data])])
                keep |= sums[z] - sums[a] >= least_marks
            a, z = a[keep], z[keep]
        hit[np.searchsorted(off, a, side="right") - 1] = True

    runs(_is_hex[data], 16)
    runs(_is_token[data], 16, ((_is_digit, 1), (_is_upper, 4)))
    runs(_is_value[data], 8, ((_is_mixed, 1),), after=True)
    low = _lower[data].tobytes()
    raw = data.tobytes()
    for key, where in (*((k, low) for k in _KEYS), (b"AKIA", raw), (b"-----BEGIN", raw), (b"://", raw)):
        at = where.find(key)
        while at >= 0:
            row = int(np.searchsorted(off, at, side="right")) - 1
            hit[row] |= at + len(key) <= off[row + 1]  # one that spans rows belongs to no text
            at = where.find(key, int(off[row + 1]))
    return np.flatnonzero(hit & (np.diff(off) > 0))


def windows(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the candidate with its context, a row for each window: 0 none, 1 to 95 printable ASCII, 96 other."""
    c = np.frombuffer(text[max(0, start - BEFORE) : end + AFTER].encode("utf-32-le", "surrogatepass"), dtype="<u4")
    count, width = 1 + -(-max(0, end - start - INSIDE) // STEP), BEFORE + INSIDE + AFTER
    out = np.zeros((count - 1) * STEP + width, dtype=np.uint8)
    at = max(0, BEFORE - start)
    out[at : at + len(c)] = np.where((c >= 32) & (c < 127), c - 31, 96)
    return np.lib.stride_tricks.sliding_window_view(out, width)[::STEP]


def window(text: str, start: int, end: int) -> np.ndarray:
    """The first of ``windows``."""
    return windows(text, start, end)[0]


class Net:
    """Embedding, convolution of width ``w``, ReLU, maximum over places, logistic output; trained by Adam."""

    def __init__(self, seed: int = 11, d: int = 8, filters: int = 24, w: int = 5):
        rng = np.random.default_rng(seed)
        self.w = w
        self.p = {"e": rng.normal(0, 0.5, (97, d)), "k": rng.normal(0, (w * d) ** -0.5, (w * d, filters)), "b": np.zeros(filters), "v": rng.normal(0, filters**-0.5, filters), "c": np.zeros(1)}
        self.scale, self.shift, self.threshold = 1.0, 0.0, 0.5

    def _forward(self, x: np.ndarray):
        e = self.p["e"][x]
        n, t, d = e.shape
        cols = np.lib.stride_tricks.sliding_window_view(e, self.w, axis=1).transpose(0, 1, 3, 2).reshape(n, t - self.w + 1, self.w * d)
        z = cols @ self.p["k"] + self.p["b"]
        top = z.argmax(axis=1)
        best = np.take_along_axis(z, top[:, None, :], axis=1)[:, 0, :]
        return cols, top, best, np.maximum(best, 0) @ self.p["v"] + self.p["c"][0]

    def logits(self, x: np.ndarray, sizes: list[int] | None = None) -> np.ndarray:
        """Of each window, or with ``sizes`` (windows of each candidate, in order) the highest of each candidate."""
        z = np.concatenate([self._forward(x[i : i + 512])[3] for i in range(0, len(x), 512)]) if len(x) else np.zeros(0)
        return z if sizes is None or not len(z) else np.maximum.reduceat(z, np.cumsum([0, *sizes[:-1]]))

    def probability(self, x: np.ndarray, sizes: list[int] | None = None) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * self.logits(x, sizes) + self.shift, -40, 40)))

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 12, rate: float = 0.01, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, d = 0, self.p["e"].shape[1]
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                cols, top, best, out = self._forward(x[part])
                g = weight[part] * (1 / (1 + np.exp(-np.clip(out, -40, 40))) - y[part]) / len(part)
                up = (g[:, None] * self.p["v"]) * (best > 0)
                rows = np.arange(len(part))[:, None]
                used = cols[rows, top]  # the window that each filter was largest at
                grad = {"v": np.maximum(best, 0).T @ g, "c": g.sum(keepdims=True), "b": up.sum(axis=0), "k": np.einsum("nf,nfw->wf", up, used)}
                back = (up[:, :, None] * self.p["k"].T[None]).reshape(len(part), -1, self.w, d)
                ge = np.zeros_like(self.p["e"])
                places = top[:, :, None] + np.arange(self.w)
                np.add.at(ge, x[part][rows[:, :, None], places], back)
                grad["e"] = ge
                step += 1
                for k, v in grad.items():
                    m[k] = 0.9 * m[k] + 0.1 * v
                    s[k] = 0.999 * s[k] + 0.001 * v * v
                    self.p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float = RECALL, sizes: list[int] | None = None) -> None:
        """Fit scale and shift of the logits by gradient descent, then the highest threshold with that recall."""
        z = self.logits(x, sizes)
        a, b = 1.0, 0.0
        spread = max(1.0, float(np.abs(z).max()))
        z = z / spread
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
            a -= 2.0 * float(((p - y) * z).mean() + 1e-4 * a)
            b -= 2.0 * float((p - y).mean())
        self.scale, self.shift = a / spread, b
        positive = np.sort(self.probability(x, sizes)[y == 1])
        if len(positive):
            self.threshold = float(positive[int(np.floor((1 - recall) * len(positive)))])


_ALNUM = string.ascii_letters + string.digits
#: Shapes of credentials: what they begin with, their alphabet, least and largest length of the rest.
SHAPES = (
    ("AKIA", string.ascii_uppercase + string.digits, 16, 16), ("", "0123456789abcdef", 32, 64), ("ghp_", _ALNUM, 36, 36), ("sk-", _ALNUM, 40, 48),
    ("sk-", string.ascii_letters, 24, 40), ("", _ALNUM + "+/", 40, 44), ("xoxb-", _ALNUM + "-", 28, 40), ("AIza", _ALNUM + "-_", 35, 35),
    ("", _ALNUM, 20, 32), ("eyJ", _ALNUM + "-_.", 60, 120),
)
FRONTS = ("key ", "token ", "auth=", "Bearer ", "credential: ", "use ", "id ", "the ", "secret is ", "", "access_key: ", 'client_secret = "', "x-api-key: ", "(", "export KEY=")
#: Names that passwords are assigned to, and that other values are.
SECRET_NAMES = ("pwd=", "db_pass: ", "passphrase = '", "PASS=", "login_pw: ", "pin=", "credential=", "auth: ", "smtp_password2 = ", "userpass=")
PLAIN_NAMES = ("name=", "title: ", "version=", "date: ", "file=", "size: ", "order: ", "serial=", "item: ", "email: ", "page=", "at: ", "see: ", "part=", "ref: ")
_WORDS = ("report", "section", "chapter", "figure", "version", "release", "item", "table", "appendix", "volume", "winter", "garden", "letter", "market", "window", "silver")


def _drawn(rng: np.random.Generator, alphabet: str, n: int) -> str:
    return "".join(alphabet[i] for i in rng.integers(len(alphabet), size=n))


def generated(rng: np.random.Generator, n: int, shapes: tuple = SHAPES) -> list[tuple[str, int, int]]:
    """Credentials of usual shapes in usual contexts: (text, start, end)."""
    out = []
    for _ in range(n):
        head, alphabet, least, most = shapes[rng.integers(len(shapes))]
        body, front = head + _drawn(rng, alphabet, int(rng.integers(least, most + 1))), FRONTS[rng.integers(len(FRONTS))]
        out.append((front + body + _tail(rng), len(front), len(front) + len(body)))
    return out


def passwords(rng: np.random.Generator, n: int) -> list[tuple[str, int, int]]:
    """Passwords in assignments and addresses, and private key blocks: (text, start, end)."""
    out = []
    for _ in range(n):
        k = rng.integers(8)
        if k == 0:
            kind = ("", "RSA ", "EC ", "OPENSSH ")[rng.integers(4)]
            lines = "\n".join(_drawn(rng, _ALNUM + "+/", 64) for _ in range(int(rng.integers(2, 8))))
            front, body, tail = "", f"-----BEGIN {kind}PRIVATE KEY-----\n{lines}\n-----END {kind}PRIVATE KEY-----", "\n"
        else:
            word = _WORDS[rng.integers(len(_WORDS))]
            forms = (word.capitalize() + str(rng.integers(10, 9999)) + _drawn(rng, "!@#$%&*?", 1), _drawn(rng, _ALNUM + "!@#$%^&*", int(rng.integers(8, 20))), word + _drawn(rng, "!@#$%", 1) + _drawn(rng, _ALNUM, 4))
            body = forms[rng.integers(3)].replace("@", "!") if k <= 2 else forms[rng.integers(3)]
            body += "7x!q"[: max(0, 8 - len(body))]
            if not _MIXED.search(body):
                body += "7"
            if k <= 2:
                front, tail = f"{('postgres', 'mysql', 'https', 'redis', 'amqp')[rng.integers(5)]}://{word}:", f"@db{rng.integers(9)}.host.org/x"
            else:
                front, tail = SECRET_NAMES[rng.integers(len(SECRET_NAMES))], _tail(rng)
        out.append((front + body + tail, len(front), len(front) + len(body)))
    return out


def _tail(rng: np.random.Generator) -> str:
    return ("", "", " ", ".", ", and so on", " then the next of these lines", "\nsee the rest of it", '" for all of them')[rng.integers(8)]


def plain(rng: np.random.Generator, n: int) -> list[tuple[str, int, int]]:
    """Long tokens that are no credentials: paths, numbered words, dates, identifiers of parts, hosts, placeholders."""
    out = []
    for _ in range(n):
        w = [_WORDS[i] for i in rng.integers(len(_WORDS), size=3)]
        k = rng.integers(8)
        body = (
            f"{w[0]}/{w[1]}/{w[2]}-{rng.integers(99)}", f"{w[0]}_{w[1]}_{rng.integers(999)}", f"20{rng.integers(10, 30)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}_{w[0]}", f"{w[0]}-{w[1]}-{w[2]}-{rng.integers(10)}",
            f"{w[0]}{w[1]}{w[2]}{rng.integers(100)}", f"www.{w[0]}-{w[1]}.org/{w[2]}{rng.integers(100)}.html", f"{w[0].title()}{w[1].title()}{w[2].title()}V{rng.integers(1, 9)}", f"your_{w[0]}_key_here_{rng.integers(10)}",
        )[k]
        front = ("see ", "in ", "of the ", "at ", "", "token ", "key ")[rng.integers(7)]
        out.append((front + body + _tail(rng), len(front), len(front) + len(body)))
    return out


def plain_values(rng: np.random.Generator, n: int) -> list[tuple[str, int, int]]:
    """Values that are no credentials: numbered names, versions, dates, files, addresses, short serials."""
    out = []
    for _ in range(n):
        w = [_WORDS[i] for i in rng.integers(len(_WORDS), size=2)]
        a, b = rng.integers(1, 999, size=2)
        body = (f"{w[0]}_{a}", f"v{a}.{b}-{w[0]}", f"20{a % 30:02d}-0{1 + b % 9}-1{a % 9}T10", f"{w[0]}{a}.txt", f"{w[0]}@{w[1]}.org", f"{w[0]}-{w[1]}-{a}", f"{w[0]}/{w[1]}{a}", f"{a}x{b}px{w[0]}", f"{w[0][:2].upper()}-{a:05d}-{b:03d}", f"${w[0].upper()}_{a}", f"{w[0]}+{w[1]}")[rng.integers(11)]
        body += "-of-a1"[: max(0, 8 - len(body))]
        front = PLAIN_NAMES[rng.integers(len(PLAIN_NAMES))]
        out.append((front + body + _tail(rng), len(front), len(front) + len(body)))
    return out


def hidden(rng: np.random.Generator, n: int) -> list[tuple[str, int, int, int, int]]:
    """Long paths, every second with a credential in or behind it: (text, start, end, start and end of the credential or -1, -1)."""
    out = []
    for k in range(n):
        parts = []
        while sum(map(len, parts)) < 40 + 60 * rng.random():
            text, a, z = plain(rng, 1)[0]
            parts.append(text[a:z])
        joint, place = "/=_-+"[rng.integers(5)], int(rng.integers(1, len(parts) + 1))
        front, body = f"at {joint.join(parts[:place])}", joint.join(["", *parts[place:]]) if place < len(parts) else ""
        a = z = -1
        if k % 2:
            text, x, y = generated(rng, 1)[0]
            a = len(front) + 1
            z = a + y - x
            front += joint + text[x:y]
        out.append((front + body + _tail(rng), 3, len(front + body), a, z))
    return out


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_candidates: int = FIT_CANDIDATES, seed: int = 3) -> Net:
    """Train and calibrate on a bounded sample of ``docs`` (doc_id, text) and on generated findings."""
    ids = docs.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs).distinct()
    some = docs.join(F.broadcast(ids), "doc_id")  # fit_docs ids at most

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                rows, labels, keys = [], [], []
                for i in suspects(b).tolist():
                    text = b.text(i)
                    for a, z, kind in find_candidates(text, find_base(text)):
                        x = windows(text, a, z)
                        if kind not in BASE_KINDS and not wordlike(text[a:z]):
                            continue  # may be either
                        rows.append(x[np.unique(np.linspace(0, len(x) - 1, FIT_WINDOWS).astype(int))].tobytes())
                        labels.append(int(kind in BASE_KINDS))
                        keys.append(f"{batch.column(0)[b.first_row + i]}:{a}:{kind}")
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(labels, pa.int32()), pa.array(keys, pa.string())], ["codes", "label", "name"])

    got = some.mapInArrow(lean(sample), "codes binary, label int, name string").orderBy(F.xxhash64("name"), "name").limit(fit_candidates).collect()
    rng = np.random.default_rng(seed)
    # candidates: windows, label, and labels of the windows (-1: not trained on); of a finding the first window counts
    x = [np.frombuffer(r.codes, dtype=np.uint8).reshape(-1, BEFORE + INSIDE + AFTER) for r in got]
    y = [r.label for r in got]
    each = [np.array([1] + [-1] * (len(w) - 1)) if label else np.zeros(len(w), dtype=int) for w, label in zip(x, y, strict=True)]
    for source, label in ((generated, 1), (passwords, 1), (plain, 0), (plain_values, 0)):
        for text, a, z in source(rng, 800):
            x.append(windows(text, a, z))
            y.append(label)
            each.append(np.array([1] + [-1] * (len(x[-1]) - 1)) if label else np.zeros(len(x[-1]), dtype=int))
    for text, start, end, a, z in hidden(rng, 800):
        x.append(windows(text, start, end))
        y.append(int(a >= 0))
        from_ = start + STEP * np.arange(len(x[-1])) - BEFORE
        to = from_ + BEFORE + INSIDE + AFTER
        each.append(np.where((from_ <= a) & (to >= z), 1, np.where((to <= a) | (from_ >= z), 0, -1)) if a >= 0 else np.zeros(len(x[-1]), dtype=int))
    order = rng.permutation(len(x)).tolist()
    cut = int(0.7 * len(x))
    net = Net()
    xs, ys = np.concatenate([x[i] for i in order[:cut]]), np.concatenate([each[i] for i in order[:cut]])
    net.train(xs[ys >= 0], ys[ys >= 0].astype(np.float64))
    rest = order[cut:]
    net.calibrate(np.concatenate([x[i] for i in rest]), np.array([y[i] for i in rest], dtype=np.float64), sizes=[len(x[i]) for i in rest])
    return net


def scored(net: Net, b: Block) -> Iterator[tuple[int, int, int, str, float]]:
    """Row, start, end, kind and score of the base findings of a block, and of its other candidates that pass the threshold."""
    found, codes = [], []
    for i in suspects(b).tolist():
        text = b.text(i)
        for a, z, kind in find_candidates(text, find_base(text)):
            found.append((i, a, z, kind))
            codes.append(windows(text, a, z))
    score = net.probability(np.concatenate(codes), [len(x) for x in codes]) if codes else np.zeros(0)
    for (i, a, z, kind), p in zip(found, score.tolist(), strict=True):
        if kind in BASE_KINDS or p >= net.threshold:
            yield i, a, z, kind, p


def find_secrets(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``doc_id`` and ``spans``: an array of (kind, start, end, base, score) by start, then kind in the order of ``KINDS``.

    Null and empty texts have no spans. Null ids and repeated rows are carried through; other columns are ignored; an empty
    table gives none. Starts and ends are in code points, ends exclusive.
    """
    src = pick(docs, doc_id="doc_id", text="text")
    net = fit(src, fit_docs)
    item = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                rows: list[list[dict]] = [[] for _ in range(b.rows)]
                for i, a, z, kind, p in scored(net, b):
                    rows[i].append({"kind": kind, "start": a, "end": z, "base": kind in BASE_KINDS, "score": p})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(b.first_row, b.rows), pa.array(rows, pa.list_(item))], ["doc_id", "spans"])

    return src.mapInArrow(lean(run), f"doc_id {src.schema['doc_id'].dataType.simpleString()}, spans array<struct<kind:string,start:int,end:int,base:boolean,score:double>>")


MASK = "[secret]"


def mask(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` with ``MASK`` in place of each span; overlapping spans count as one."""
    out, at, end = [], 0, 0
    for a, z in sorted(spans):
        if a >= end or not out:
            out += [text[at:a], MASK]
        end = max(end, z)
        at = end
    return "".join([*out, text[at:]])


def without_secrets(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """``docs`` (all columns) with the spans of ``find_secrets`` masked in ``text``, and ``n_chars`` counted again.

    Rows are read once, in place, so null and repeated ids make no difference. Null texts stay null and empty ones empty; texts of
    any length are scanned whole; other columns, whatever their names, are carried through; an empty table gives none.
    """
    net = fit(pick(docs, doc_id="doc_id", text="text"), fit_docs)
    plain_, (text,) = by_place(docs, "text")

    at = plain_.columns.index(text)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans: dict[int, list[tuple[int, int]]] = {}
            for b in blocks(batch.column(at)):
                for i, a, z, _, _ in scored(net, b):
                    spans.setdefault(b.first_row + i, []).append((a, z))
            if spans:
                new = batch.column(at).to_pylist()
                for i, own in spans.items():
                    new[i] = mask(new[i], own)
                batch = batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))
            yield batch

    return counted(plain_.mapInArrow(lean(masked), plain_.schema), text, docs.columns).toDF(*docs.columns)
