"""Secret scan: three fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

Patterns (leftmost, not overlapping within a kind; matches that fail their least length are dropped): assign, access, hex. The
field tags tokens (runs of non-space characters) as begin, inside or outside from shape, neighbouring words and features of the
file; tokens whose shape can't be a secret (SHORTEST characters, two kinds of characters) are outside by the model's
definition, so decoding runs of the others is decoding the whole text. Its spans are added where they overlap no pattern's span.

It is trained on the driver from seeded made-up lines: no text of the corpus is learnt from, every text is scanned whole.
A null text is empty. Every input row gives one output row; ids may be null or repeat; extra columns are not read.
Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import re
import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm import bytekit as bk

#: The patterns, their least lengths and the order of kinds.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
LEAST = {"assign": 12, "access": 18, "hex": 16}
KINDS = ["assign", "access", "hex", "crf"]

SHORTEST = 10
CUE = re.compile(rb"passw(?:or)?d|secret|token|api_?key|bearer|credential|private|auth")
PREFIXES = (b"AKIA", b"ghp_", b"gho_", b"sk-", b"sk_", b"xox", b"eyJ", b"AIza", b"glpat")
STRIP = b"\"'`,;()[]{}<>*#$%&!|"
O, B, I = 0, 1, 2
N_FEATURES = 48


def _shape(tok: bytes) -> list[int]:
    """Indices of the shape features of one token."""
    core = tok.strip(STRIP)
    n = max(len(core), 1)
    digits, upper, lower = (sum(lo <= c <= hi for c in core) for lo, hi in ((48, 57), (65, 90), (97, 122)))
    special = sum(c in b"+/_=-." for c in core)
    wide = sum(c >= 128 for c in core)
    kind = [0 if 48 <= c <= 57 else 1 if 65 <= c <= 90 else 2 if 97 <= c <= 122 else 3 for c in core]
    turns = sum(a != b for a, b in zip(kind, kind[1:])) / n
    out = [int(np.searchsorted([8, 12, 16, 20, 24, 32, 41], len(core), side="right"))]
    out.append(8 + int(np.searchsorted([0.001, 0.15, 0.35, 0.6, 0.999], digits / n, side="right")))
    out.append(14 + int(np.searchsorted([0.001, 0.2, 0.6], upper / n, side="right")))
    out.append(18 + int(np.searchsorted([0.001, 0.1, 0.3], special / n, side="right")))
    out.append(22 + int(np.searchsorted([0.1, 0.2, 0.35, 0.5], turns, side="right")))
    if all(c in b"0123456789abcdefABCDEF" for c in core):
        out.append(27)
    if digits and upper and lower:
        out.append(28)
    if core.startswith(PREFIXES):
        out.append(29)
    if b"@" in core or b"://" in core or core.startswith(b"www."):
        out.append(30)
    if wide:
        out.append(31)
    if len(set(core)) / n < 0.4:
        out.append(32)
    if re.fullmatch(rb"[0-9.,:/+-]+", core):
        out.append(33)
    return out


def _around(prev2: bytes, prev: bytes, tok: bytes, nxt: bytes, key_values: float) -> list[int]:
    out = []
    if CUE.search(prev.lower()):
        out.append(34)
    if prev[-1:] in (b"=", b":"):
        out.append(35)
    if CUE.search(prev2.lower()):
        out.append(36)
    if CUE.search(tok.lower()):
        out.append(37)
    if b"=" in tok[:-2] or b":" in tok[:-2]:
        out.append(38)
    if tok[:1] in (b'"', b"'"):
        out.append(39)
    if nxt[:1] in (b'"', b"'"):
        out.append(40)
    if prev[-1:] in (b"=", b":") and CUE.search((prev2 + prev).lower()):
        out.append(41)
    out.append(42 + int(np.searchsorted([0.001, 0.02, 0.1], key_values, side="right")))
    out.append(46)
    return out


def token_features(toks: list[bytes], i: int, key_values: float) -> list[int]:
    at = lambda j: toks[j] if 0 <= j < len(toks) else b""
    return _shape(toks[i]) + _around(at(i - 2), at(i - 1), toks[i], at(i + 1), key_values)


def possible(tok: bytes) -> bool:
    core = tok.strip(STRIP)
    kinds = [any(48 <= c <= 57 for c in core), any(97 <= c <= 122 for c in core), any(65 <= c <= 90 for c in core[1:]), any(c in b"+/_=-" for c in core)]
    return len(core) >= SHORTEST and sum(kinds) >= 2


def _made_up(rng: np.random.Generator, n: int) -> list[tuple[list[bytes], list[int]]]:
    """Lines with tags: secrets after cues, bare keys, and what only looks alike."""
    pick = lambda chars, k: "".join(rng.choice(list(chars), k))
    word = lambda: pick(string.ascii_lowercase, int(rng.integers(2, 9)))
    mixed = string.ascii_letters + string.digits
    out = []
    for _ in range(n):
        toks, tags = [], []

        def add(text: str, tag=O, toks=toks, tags=tags):
            for k, t in enumerate(text.split()):
                toks.append(t.encode())
                tags.append(tag if k == 0 or tag == O else I)

        for _ in range(int(rng.integers(2, 7))):
            add(word())
        kind = int(rng.integers(0, 12))
        cue = str(rng.choice(["password", "passwd", "secret", "token", "api_key", "apikey", "auth", "credential", "bearer"]))
        value = [pick("0123456789abcdef", int(rng.choice([32, 40, 64]))), pick(mixed, int(rng.integers(16, 44))), pick(mixed + "+/", 40), pick(string.ascii_lowercase + string.digits, int(rng.integers(12, 24)))][int(rng.integers(0, 4))]
        if kind == 0:
            add(f"{cue} {rng.choice(['=', ':'])}")
            add(f'"{value}"', B)
        elif kind == 1:
            add(f"{cue}:")
            add(value, B)
        elif kind == 2:
            add(f"{cue}={value}", B)
        elif kind == 3:
            add(str(rng.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(mixed, 36), "sk-" + pick(mixed, 40), "xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24), "eyJ" + pick(mixed, 30) + "." + pick(mixed, 40)])), B)
        elif kind == 4:
            add("Authorization: Bearer")
            add(pick(mixed + "-_", int(rng.integers(24, 60))), B)
        elif kind == 5:
            add(f"{cue} is")
            add(value, B)
        elif kind == 6:
            add(pick(string.digits, 16))
        elif kind == 7:
            add(f"{word()}.{word()}{rng.integers(1, 99)}@{word()}.com https://{word()}.org/{word()}/{rng.integers(1, 9999)}-{word()}")
        elif kind == 8:
            add(f"{word()}-{word()}-{word()}_{rng.integers(1, 999)} 20{rng.integers(10, 30)}-01-{rng.integers(10, 29)}T{rng.integers(10, 24)}:00:00Z +1-{rng.integers(200, 999)}-555-{rng.integers(1000, 9999)}")
        elif kind == 9:
            add(f"{word().upper()}{word()}{word().capitalize()} {word()}_{word()}_{rng.integers(1, 99)}() {rng.integers(1, 255)}.{rng.integers(1, 255)}.{rng.integers(1, 255)}.1")
        elif kind == 10:
            add(f"{cue} {word()} {word()}{rng.integers(10, 99)}{word()}-{word()}")
        for _ in range(int(rng.integers(1, 7))):
            add(word() + str(rng.choice(["", ".", ",", "***", "$$$"])))
        out.append((toks, tags))
    return out


@functools.lru_cache(1)
def model() -> tuple[np.ndarray, np.ndarray]:
    """(feature weights by tag, transitions): maximum likelihood with ridge by gradient ascent with momentum; seeded."""
    lines = _made_up(np.random.default_rng(5), 700)
    longest = max(len(t) for t, _ in lines)
    x = np.zeros((len(lines), longest, N_FEATURES))
    y = np.zeros((len(lines), longest), np.int64)
    real = np.zeros((len(lines), longest), bool)
    barred = np.zeros((len(lines), longest, 3))
    for i, (toks, tags) in enumerate(lines):
        kv = sum(b"=" in t or b":" in t for t in toks) / len(toks)
        for j, tag in enumerate(tags):
            ok = possible(toks[j])
            x[i, j, token_features(toks, j, kv)] = 1
            y[i, j] = tag if ok else O
            barred[i, j, 1:] = 0 if ok else -1e9
        real[i, : len(toks)] = True
    w, t = np.zeros((3, N_FEATURES)), np.zeros((3, 3))
    mw, mt, vw, vt = np.zeros_like(w), np.zeros_like(t), np.zeros_like(w), np.zeros_like(t)
    no = np.array([0.0, 0.0, -1e9])  # inside can't follow outside, nor start
    eye = np.eye(3)
    for step in range(1, 121):
        e = x @ w.T + barred
        trans = t.copy()
        trans[O, I] = -1e9
        a = np.zeros_like(e)
        a[:, 0] = e[:, 0] + no
        lse = lambda z, axis: (z.max(axis, keepdims=True) + np.log(np.exp(z - z.max(axis, keepdims=True)).sum(axis, keepdims=True))).squeeze(axis)
        for j in range(1, longest):
            a[:, j] = np.where(real[:, j, None], lse(a[:, j - 1, :, None] + trans, 1) + e[:, j], a[:, j - 1])
        b = np.zeros_like(e)
        for j in range(longest - 2, -1, -1):
            b[:, j] = np.where(real[:, j + 1, None], lse(trans[None] + (e[:, j + 1] + b[:, j + 1])[:, None, :], 2), b[:, j + 1])
        z = lse(a[:, -1], 1)
        mark = np.exp(a + b - z[:, None, None]) * real[:, :, None]
        gw = np.einsum("ijk,ijf->kf", eye[y] * real[:, :, None] - mark, x) - 0.5 * w
        pair = np.exp(np.minimum(a[:, :-1, :, None] + trans + (e + b)[:, 1:, None, :] - z[:, None, None, None], 0)) * real[:, 1:, None, None]
        seen = np.einsum("ijk,ijl->kl", eye[y[:, :-1]] * real[:, 1:, None], eye[y[:, 1:]])
        gt = seen - pair.sum((0, 1)) - 0.5 * t
        for p, g, m, v in ((w, gw, mw, vw), (t, gt, mt, vt)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    t[O, I] = -1e9
    return w, t


def viterbi(emission: np.ndarray, trans: np.ndarray) -> list[int]:
    """Best tags of a run of possible tokens between outside tokens."""
    best, back = emission[0] + trans[O], []
    for e in emission[1:]:
        score = best[:, None] + trans
        back.append(score.argmax(0))
        best = score.max(0) + e
    last = int((best + trans[:, O]).argmax())
    out = [last]
    for b in reversed(back):
        out.append(int(b[out[-1]]))
    return out[::-1]


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8))


DIGIT, LOW, UP, SPECIAL = _class(b"0123456789"), _class(string.ascii_lowercase.encode()), _class(string.ascii_uppercase.encode()), _class(b"+/_=-")
COLON = _class(b"=:")


def _some(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    c = np.zeros(len(mask) + 1, np.int32)
    np.cumsum(mask, out=c[1:])
    return c[end] - c[start]


def scan(data: np.ndarray, offs: np.ndarray, w: np.ndarray, trans: np.ndarray) -> dict[int, list[tuple[int, str, int]]]:
    """Spans in bytes, (start, kind, end), of the texts of a slice that have any."""
    out: dict[int, list[tuple[int, str, int]]] = {}
    view = data.tobytes()
    low = bk.LOWER[data].tobytes()
    text = lambda i: view[offs[i] : offs[i + 1]]
    # a match over the border of two texts would hide one that starts in the second, so every text is searched alone
    for i in range(len(offs) - 1):
        if CUE.search(low, int(offs[i]), int(offs[i + 1])):
            for m in ASSIGN.finditer(text(i)):
                if len(m[2]) >= LEAST["assign"]:
                    out.setdefault(i, []).append((m.start(), "assign", m.end()))
        if view.find(b"AKIA", offs[i], offs[i + 1]) >= 0:
            for m in ACCESS.finditer(text(i)):
                if len(m[0]) >= LEAST["access"]:
                    out.setdefault(i, []).append((m.start(), "access", m.end()))
    s, e, d = bk.words(data, offs, HEX)
    for j in np.flatnonzero(e - s >= LEAST["hex"]).tolist():
        i = int(d[j])
        out.setdefault(i, []).append((int(s[j] - offs[i]), "hex", int(e[j] - offs[i])))
    s, e, d = bk.words(data, offs, ~bk.SPACE)
    maybe = np.flatnonzero(e - s >= SHORTEST)
    ms, me = s[maybe], e[maybe]
    kinds = (_some(DIGIT[data], ms, me) > 0).astype(np.int8) + (_some(LOW[data], ms, me) > 0) + (_some(UP[data], ms + 1, me) > 0) + (_some(SPECIAL[data], ms, me) > 0)
    maybe = maybe[kinds >= 2]
    maybe = maybe[[possible(view[s[j] : e[j]]) for j in maybe.tolist()]] if len(maybe) else maybe
    if len(maybe):
        n = len(offs) - 1
        kv = np.bincount(d, _some(COLON[data], s, e) > 0, n) / np.maximum(np.bincount(d, minlength=n), 1)
        new = np.append(True, (maybe[1:] != maybe[:-1] + 1) | (d[maybe[1:]] != d[maybe[:-1]]))
        for run in np.split(maybe, np.flatnonzero(new)[1:]):
            i = int(d[run[0]])
            lo, hi = int(run[0]), int(run[-1])
            around = [view[s[j] : e[j]] if 0 <= j < len(s) and d[j] == i else b"" for j in range(lo - 2, hi + 2)]
            emit = np.array([w[:, token_features(around, k + 2, kv[i])].sum(1) for k in range(len(run))])
            tags = viterbi(emit, trans)
            k = 0
            while k < len(run):
                if tags[k] == O:
                    k += 1
                    continue
                stop = k + 1
                while stop < len(run) and tags[stop] == I:
                    stop += 1
                first, last = view[s[run[k]] : e[run[k]]], view[s[run[stop - 1]] : e[run[stop - 1]]]
                a = int(s[run[k]] - offs[i]) + len(first) - len(first.lstrip(STRIP))
                b = int(e[run[stop - 1]] - offs[i]) - (len(last) - len(last.rstrip(STRIP)))
                if a < b and all(b <= x or a >= y for x, _, y in out.get(i, ())):
                    out.setdefault(i, []).append((a, "crf", b))
                k = stop
    rank = {k: j for j, k in enumerate(KINDS)}
    for i, spans in out.items():
        chars = np.zeros(int(offs[i + 1] - offs[i]) + 1, np.int64)
        np.cumsum((data[offs[i] : offs[i + 1]] & 0xC0) != 0x80, out=chars[1:])
        out[i] = sorted(((int(chars[a]), k, int(chars[b])) for a, k, b in spans), key=lambda x: (x[0], rank[x[1]], x[2]))
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(at, names, redact, weights):
    def run(batches):
        for b in batches:
            for lo, hi, data, offs, _ in bk.slices(b.column(at)):
                found = scan(data, offs, *weights)
                part = b.slice(lo, hi - lo)
                if not redact:
                    spans = pa.array([[{"kind": k, "start": a, "end": e} for a, k, e in found.get(i, ())] for i in range(hi - lo)], SPANS)
                    yield pa.record_batch([part.column(0), spans], names=names)
                    continue
                text = part.column(at).to_pylist()
                for i, spans in found.items():
                    kept, last = [], 0
                    for a, _, e in spans:
                        if a >= last:
                            kept += [text[i][last:a], redact]
                        last = max(last, e)
                    text[i] = "".join([*kept, text[i][last:]])
                cols = [pa.array(text, part.column(c).type) if c == at else part.column(c) for c in range(len(names))]
                if "n_chars" in names and found:
                    k = names.index("n_chars")
                    n = part.column(k).to_pylist()
                    for i in found:
                        n[i] = len(text[i])
                    cols[k] = pa.array(n, part.column(k).type)
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans array<struct<kind,start,end>>) per row, spans by start, then kind."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_scan(1, ["id", "spans"], None, model()), f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every found span replaced by a mark, n_chars (if there) following; all other columns as they are."""
    return docs.mapInArrow(_scan(docs.columns.index(text_col), docs.columns, mark, model()), docs.schema)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
