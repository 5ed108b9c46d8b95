"""Secret scans: a linear-chain conditional random field beside fixed patterns.

A line is a chain of tokens (runs outside space and quotes); each is tagged outside, begin or inside of a secret from
its shape, its neighbours' words and features of its file, and the best tagging of every line is found by Viterbi.
The chain is trained on lines of a bounded sample of texts. Its truth is more than what the patterns find: lines with
a base span are used as they are and again with the name and the value replaced by ones that no pattern matches, and
secrets and look-alikes (mail addresses, numbers, paths, identifiers) are planted into other lines. Base spans are
always part of the result.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import discard, pick, place, staged
from .textbytes import CONTINUATION, LOWER, SPACE, Hasher, blocks, mix, word_spans

KINDS = ("assign", "access", "hex")
_ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs only: the runs of [0-9a-f]+ that are long enough
_CUES = ("passw", "secret", "token", "api")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(c in low for c in _CUES):
        out += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# tokens: runs outside space and quotes
_APART = SPACE.copy()
_APART[[0x22, 0x27]] = True
_NEWLINE = 0x0A


def _class(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars.encode())] = True
    return table


_CLASSES = (
    _class("abcdefghijklmnopqrstuvwxyz"),
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    _class("0123456789"),
    _class("+/_.=-"),
)
_HEXADECIMAL = _class("0123456789abcdef")
_KIND = sum((k + 1) * t for k, t in enumerate(_CLASSES)).astype(np.int8)
N_WORDS = 1 << 12
PIECE = 48
_SHAPES = 5 * 2 * 4 * 4 * 4 * 2
_CHANGES = 6 * 6
#: slots: shape of the token, of the one before, of the one after; hashed words before and two before; file features;
#: changes of character class inside the token
N_FEATURES = 3 * (_SHAPES + 1) + 2 * (N_WORDS + 1) + 16 + _CHANGES + 1
SLOTS = 7
TAGS = 3  # outside, begin, inside
ALLOWED = np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]], bool)
START = np.array([1, 1, 0], bool)


@dataclass
class Chains:
    start: np.ndarray  # bytes
    end: np.ndarray
    row: np.ndarray
    line: np.ndarray  # chain of each token, rising
    features: np.ndarray  # tokens x slots


def chains(data: np.ndarray, offsets: np.ndarray) -> Chains:
    """Tokens of a block with their features; every line of every text is a chain."""
    start, end, row = word_spans(data, offsets, _APART)
    breaks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(data == _NEWLINE, out=breaks[1:])
    line_key = breaks[start] + row
    new = np.ones(len(start), bool)
    new[1:] = line_key[1:] != line_key[:-1]
    line = np.cumsum(new) - 1

    def count(table: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=sums[1:])
        return sums[end] - sums[start]

    size = end - start
    low, up, digit, joint = (count(t) for t in _CLASSES)
    pure = count(_HEXADECIMAL) == size
    length = np.searchsorted([6, 12, 20, 36], size, side="right")

    def level(x: np.ndarray) -> np.ndarray:
        return (x > 0).astype(np.int64) + (4 * x >= size) + (10 * x >= 9 * size)

    shape = (((length * 2 + pure) * 4 + level(low)) * 4 + level(up)) * 4 + level(digit)
    shape = shape * 2 + (low + up + digit + joint == size)
    kind = _KIND[data]
    turns = np.zeros(len(data) + 1, np.int32)
    np.cumsum(kind[1:] != kind[:-1], out=turns[2:])  # turns[i]: changes before byte i
    changes = np.searchsorted([1, 2, 4, 7, 12], turns[end] - turns[start + 1], side="right") * 6 + np.searchsorted([8, 12, 16, 24, 36], size, side="right") if len(start) else size
    words = Hasher(LOWER[data]).spans(start, end)
    word = (mix(words) >> np.uint64(64 - 12)).astype(np.int64)

    def moved(x: np.ndarray, by: int, none: int) -> np.ndarray:
        out = np.full(len(x), none, np.int64)
        if by > 0:
            out[by:] = np.where(line[by:] == line[:-by], x[:-by], none)
        else:
            out[:by] = np.where(line[:by] == line[-by:], x[-by:], none)
        return out

    rows = len(offsets) - 1
    tokens = np.bincount(row, minlength=rows)
    dense = np.bincount(row, digit > 0, minlength=rows) / np.maximum(tokens, 1)
    file = np.searchsorted([20, 100, 500], tokens)[row] * 4 + np.searchsorted([0.01, 0.1, 0.4], dense)[row]
    slots, at = [], 0
    for values, room in ((shape, _SHAPES), (moved(shape, 1, _SHAPES), _SHAPES), (moved(shape, -1, _SHAPES), _SHAPES), (moved(word, 1, N_WORDS), N_WORDS), (moved(word, 2, N_WORDS), N_WORDS), (file, 15), (changes, _CHANGES)):
        slots.append(values + at)
        at += room + 1
    return Chains(start, end, row, line, np.stack(slots, axis=1) if len(start) else np.zeros((0, SLOTS), np.int64))


def _padded(line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of chains by length, their first tokens and lengths."""
    length = np.bincount(line)
    first = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    return order, first, length


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # features x tags
    moves: np.ndarray  # tags x tags

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = self.weights[features[:, 0]].copy()
        for k in range(1, features.shape[1]):
            out += self.weights[features[:, k]]
        return out

    def decode(self, line: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Best tag of every token (Viterbi), all chains of a block step by step."""
        tags = np.zeros(len(line), np.int8)
        if not len(line):
            return tags
        moves = np.where(ALLOWED, self.moves, -1e9)
        order, first, length = _padded(line)
        first, length = first[order], length[order]
        best = np.where(START, scores[first], -1e9)
        back = np.zeros((len(line), TAGS), np.int8)
        alive = len(first)
        final = np.zeros(len(first), np.int8)
        for t in range(1, int(length[0]) + 1):
            still = int(np.searchsorted(-length, -t, side="left"))  # chains longer than t
            final[still:alive] = best[still:alive].argmax(1)
            alive = still
            if not alive:
                break
            at = first[:alive] + t
            through = best[:alive, :, None] + moves[None]
            back[at] = through.argmax(1)
            best[:alive] = through.max(1) + scores[at]
        for t in range(int(length[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-length, -t, side="left"))
            at = first[:alive] + t
            tags[at] = final[:alive]
            final[:alive] = back[at, final[:alive]]
        return tags


def fit(line: np.ndarray, features: np.ndarray, tags: np.ndarray, *, epochs: int = 40, rate: float = 0.1, decay: float = 1e-4) -> Field:
    """Maximum conditional likelihood by full-batch Adam with exact forward-backward sums. No tokens: all outside."""
    weights, moves = np.zeros((N_FEATURES, TAGS)), np.zeros((TAGS, TAGS))
    weights[:, 0] = 0.01
    if not len(line):
        return Field(weights, moves)
    order, first, length = _padded(line)
    first, length = first[order], length[order]
    chains_n, steps = len(first), int(length[0])
    index = np.minimum(first[:, None] + np.arange(steps), len(line) - 1)
    live = np.arange(steps) < length[:, None]
    truth = np.zeros((N_FEATURES, TAGS))
    for k in range(features.shape[1]):
        np.add.at(truth, (features[:, k], tags), 1.0)
    linked = line[1:] == line[:-1]
    truth_moves = np.zeros((TAGS, TAGS))
    np.add.at(truth_moves, (tags[:-1][linked], tags[1:][linked]), 1.0)
    state = [weights, moves]
    m, v = [np.zeros_like(x) for x in state], [np.zeros_like(x) for x in state]
    for step in range(1, epochs + 1):
        field = Field(state[0], state[1])
        score = field.scores(features)[index]
        trans = np.where(ALLOWED, field.moves, -1e9)
        forward, backward = np.empty((steps, chains_n, TAGS)), np.zeros((steps, chains_n, TAGS))
        forward[0] = np.where(START, score[:, 0], -1e9)
        for t in range(1, steps):
            x = forward[t - 1][:, :, None] + trans
            top = x.max(1)
            y = top + np.log(np.exp(x - top[:, None]).sum(1)) + score[:, t]
            forward[t] = np.where(live[:, t, None], y, forward[t - 1])
        top = forward[-1].max(1)
        total = top + np.log(np.exp(forward[-1] - top[:, None]).sum(1))
        expect_moves = np.zeros((TAGS, TAGS))
        for t in range(steps - 2, -1, -1):
            x = trans[None] + (score[:, t + 1] + backward[t + 1])[:, None, :]
            top = x.max(2)
            y = top + np.log(np.exp(x - top[:, :, None]).sum(2))
            on = live[:, t + 1]
            backward[t] = np.where(on[:, None], y, 0.0)
            pair = np.exp(forward[t][on][:, :, None] + x[on] - total[on][:, None, None])
            expect_moves += pair.sum(0)
        shares = np.exp(forward + backward - total[None, :, None]).transpose(1, 0, 2)[live]
        at = index[live]
        expect = np.zeros((N_FEATURES, TAGS))
        for k in range(features.shape[1]):
            for tag in range(TAGS):
                expect[:, tag] += np.bincount(features[at, k], shares[:, tag], N_FEATURES)
        slope = [(expect - truth) / chains_n + decay * state[0], (expect_moves - truth_moves) / chains_n + decay * state[1]]
        for k, g in enumerate(slope):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            state[k] = state[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return Field(state[0], state[1])


def _points(data: np.ndarray, a: int, b: int) -> np.ndarray:
    """Code points before each byte of one text."""
    out = np.zeros(b - a + 1, np.int64)
    np.cumsum(~CONTINUATION[data[a:b]], out=out[1:])
    return out


def _truth(chain: Chains, data: np.ndarray, offsets: np.ndarray, spans: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Tags from base spans: the tokens of a span's value (what follows the separator) begin and continue a secret."""
    tags = np.zeros(len(chain.start), np.int64)
    edges = np.searchsorted(chain.row, np.arange(len(offsets)))
    for r, found in enumerate(spans):
        if not found:
            continue
        a, b = offsets[r], offsets[r + 1]
        points = _points(data, a, b)
        tokens = np.arange(edges[r], edges[r + 1])
        s, e = points[chain.start[tokens] - a], points[chain.end[tokens] - a]
        for start, end, kind in found:
            inside = tokens[(s < end) & (e > start)]
            if kind == "assign" and len(inside) > 1:  # name and separator are outside
                inside = inside[e[inside - edges[r]] >= end]
            if len(inside) and not tags[inside].any():
                tags[inside[0]], tags[inside[1:]] = 1, 2
    return tags


_LETTERS = string.ascii_letters + string.digits
_NAMES = ("credential", "passphrase", "auth", "bearer", "pwd", "login", "private key", "client id", "signature", "session", "pin", "webhook", "license key")
_LINKS = (" = ", ": ", " is ", "=", " -> ", ":", " ")


def planted_secret(rng: random.Random) -> str:
    """A random secret that no base pattern matches."""
    while True:
        kind, n = rng.randrange(6), rng.randrange(14, 44)
        if kind == 0:
            value = "".join(rng.choices(_LETTERS, k=n))
        elif kind == 1:
            value = "".join(rng.choices(string.ascii_uppercase + string.digits, k=n))
        elif kind == 2:
            value = "".join(rng.choices(string.ascii_lowercase + string.digits, k=n))
        elif kind == 3:
            value = "".join(rng.choices(_LETTERS + "+/", k=n)) + rng.choice(["", "=", "=="])
        elif kind == 4:
            value = rng.choice(["sk", "pk", "gh", "xo", "key", "id"]) + rng.choice("_-") + "".join(rng.choices(_LETTERS, k=n))
        else:
            value = "-".join("".join(rng.choices(_LETTERS, k=rng.randrange(4, 9))) for _ in range(rng.randrange(3, 6)))
        if rng.random() < 0.15:
            value += " " + "".join(rng.choices(_LETTERS, k=rng.randrange(16, 40)))
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not base_spans(value):
            return value


def planted_decoy(rng: random.Random) -> str:
    """Something that looks odd and is no secret."""
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randrange(3, 10)))
    number = lambda n: "".join(rng.choices(string.digits, k=n))
    made = [
        lambda: f"{word()}.{rng.randrange(100)}@{word()}{rng.randrange(10)}.example.com",
        lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        lambda: number(rng.randrange(6, 20)),
        lambda: f"{number(3)}-{number(4)}",
        lambda: f"https://{word()}.{word()}.org/{word()}/{word()}-{number(4)}?{word()}={number(2)}",
        lambda: f"/{word()}/{word()}{rng.randrange(10)}/{word()}.py",
        lambda: f"{word()}_{word()}_{word()}_{rng.randrange(100)}",
        lambda: word().title() + word().title() + word().title(),
        lambda: f"20{number(2)}-0{rng.randrange(1, 10)}-1{rng.randrange(10)}T0{rng.randrange(10)}:{number(2)}:{number(2)}Z",
        lambda: f"v{rng.randrange(20)}.{rng.randrange(20)}.{rng.randrange(20)}{rng.choice(['', '-beta1', '-rc2', '+build7'])}",
        lambda: str(uuid.UUID(int=rng.getrandbits(128))),
        lambda: f"{word().title()}.{word().title()}{number(2)}@{word()}.{word()}.com",
        lambda: f"{word().title()}{word().title()}{word().title()}{rng.randrange(10)}",
        lambda: f"{word().upper()}-20{number(2)}-{number(5)}",
        lambda: "".join(rng.choices(string.ascii_lowercase, k=rng.randrange(18, 40))),
        lambda: "".join(rng.choices(string.ascii_uppercase, k=rng.randrange(6, 20))),
        lambda: word() + rng.choice(["!!", "***", "%%%", "##"]) + number(2),
    ]
    return rng.choice(made)()


def _variants(line: str, spans: list[tuple[int, int, str]], rng: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The line as it is, and as the field is to see it beyond the patterns."""
    out = [(line, spans)]

    def put(head: str, value: str, tail: str, secret: bool) -> None:
        text = f"{head}{value}{tail}"
        out.append((text, [(len(head), len(head) + len(value), "field" if secret else "decoy"), *base_spans(text)]))

    if spans:
        start, end = min(x[0] for x in spans), max(x[1] for x in spans)
        for _ in range(2):
            name = rng.choice([*_NAMES, rng.choice(line.split() or ["the"])])
            mark = rng.choice(['"', "'", ""])
            put(f"{line[:start].rstrip(' ')} {name}{rng.choice(_LINKS)}{mark}", planted_secret(rng), f"{mark}{line[end:].lstrip(_QUOTES)}", True)
    elif line.strip():
        words = line.split(" ")
        at = rng.randrange(len(words) + 1)
        head, tail = " ".join(words[:at]), " ".join(words[at:])
        named = rng.choice(["", "", rng.choice(_NAMES) + rng.choice(_LINKS)])
        for secret in (rng.random() < 0.4, False):
            put(f"{head}{' ' if head else ''}{named}", planted_secret(rng) if secret else planted_decoy(rng), f"{' ' if tail else ''}{tail}", secret)
    return out


_QUOTES = "\"'"
LINES, LINE_CHARS, SAMPLED = 16, 1200, 100


def sample_lines(docs: DataFrame, most: int) -> list[str]:
    """At most LINES lines of LINE_CHARS characters of each of 2 * ``most`` texts: ``most`` that may hold base spans
    and as many others, the first by a hash of doc_id among about SAMPLED * ``most`` texts drawn by that hash. Lines
    with base spans come first, then one in eight. This is the documented bound on what the driver gets."""
    rows = pick(docs, "doc_id", "text").where("text is not null and doc_id is not null")
    share = min(1.0, SAMPLED * most / max(1, rows.count()))
    order = F.xxhash64(F.lit("secrets"), "doc_id")
    drawn = rows.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    cue = F.col("text").rlike("(?i)password|passwd|secret|token|api_?key|akia|[0-9a-f]{24}")
    ids = drawn.select("doc_id", cue.alias("cue")).groupBy("doc_id").agg(F.bool_or("cue").alias("cue"))
    ids, path = staged(ids, "secret-sample")
    picked = ids.where("cue").orderBy(order, "doc_id").limit(most).unionByName(ids.where("not cue").orderBy(order, "doc_id").limit(most)).select("doc_id")

    def lines(batches):
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                found, others = [], []
                for line in text.split("\n"):
                    spans = base_spans(line)
                    if spans and len(found) < LINES:
                        at = max(0, spans[0][0] - LINE_CHARS // 3)
                        found.append(line[at : at + LINE_CHARS])
                    elif not spans and len(others) < LINES and zlib.crc32(line.encode()) % 8 == 0:
                        others.append(line[:LINE_CHARS])
                out.append("\n".join([*found, *others][:LINES]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "text"])

    texts = drawn.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))  # 2 * most rows
    sample = texts.mapInArrow(lines, texts.schema).toPandas().sort_values(["doc_id", "text"])
    discard(docs.sparkSession, path)
    return [line for text in sample["text"].tolist() for line in text.split("\n")]


def learn(docs: DataFrame, most: int = 1500, seed: int = 11) -> Field:
    """A field learnt from the lines of a bounded sample (see ``sample_lines``). For training, lines are cut into
    chains of PIECE tokens, and of those without a secret or look-alike one in four is kept. No lines: all outside."""
    return fit_lines(sample_lines(docs, most), seed)


def fit_lines(lines: list[str], seed: int = 11) -> Field:
    rng = random.Random(seed)
    said = [x for one in lines for x in _variants(one, base_spans(one), rng)]
    line, features, tags, base = [], [], [], 0
    texts, spans = [x for x, _ in said], [y for _, y in said]
    for first, last, data, offsets in blocks(pa.array(texts, pa.string())):
        chain = chains(data, offsets)
        truth = _truth(chain, data, offsets, [[x for x in own if x[2] != "decoy"] for own in spans[first:last]])
        decoy = _truth(chain, data, offsets, [[x for x in own if x[2] == "decoy"] for own in spans[first:last]])
        new = np.flatnonzero(np.r_[True, chain.line[1:] != chain.line[:-1]]) if len(chain.line) else np.zeros(0, int)
        inside = np.arange(len(chain.line)) - np.repeat(new, np.diff(np.append(new, len(chain.line))))
        piece = np.cumsum(inside % PIECE == 0) - 1
        held = np.arange(int(piece[-1]) + 1 if len(piece) else 0) % 4 == 0
        held[piece[(truth > 0) | (decoy > 0)]] = True
        kept = held[piece]
        line.append(piece[kept] + base)
        features.append(chain.features[kept])
        tags.append(truth[kept])
        base += len(held)
    if not line or not sum(map(len, line)):
        return fit(np.zeros(0, np.int64), np.zeros((0, SLOTS), np.int64), np.zeros(0, np.int64))
    line = np.unique(np.concatenate(line), return_inverse=True)[1]
    return fit(line, np.concatenate(features), np.concatenate(tags))


_FOUND = T.StructType([*[T.StructField(f"n_{k}", T.LongType()) for k in KINDS], T.StructField("base", T.StringType()), T.StructField("spans", T.StringType())])


def block_secrets(field: Field, data: np.ndarray, offsets: np.ndarray) -> list[tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]]:
    """(base spans, all spans) of each text of a block; the field's spans have kind ``field``."""
    chain = chains(data, offsets)
    tags = field.decode(chain.line, field.scores(chain.features))
    begins = np.flatnonzero(tags == 1)
    stops = np.searchsorted(np.flatnonzero(tags != 2), begins, side="right")
    others = np.append(np.flatnonzero(tags != 2), len(tags))
    last = others[stops] - 1
    edges = np.searchsorted(chain.row[begins], np.arange(len(offsets)))
    raw, out = data.tobytes(), []
    for r in range(len(offsets) - 1):
        a, b = int(offsets[r]), int(offsets[r + 1])
        base = base_spans(raw[a:b].decode("utf-8", "replace"))
        extra = []
        if edges[r + 1] > edges[r]:
            points = _points(data, a, b)
            for k in range(edges[r], edges[r + 1]):
                s, e = int(points[chain.start[begins[k]] - a]), int(points[chain.end[last[k]] - a])
                if not any(x < e and s < y for x, y, _ in base):
                    extra.append((s, e, "field"))
        out.append((base, sorted(base + extra, key=lambda x: (x[0], (*KINDS, "field").index(x[2]), x[1]))))
    return out


def _written(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scanner(field: Field):
    """A column function: text -> struct(n_assign, n_access, n_hex, base, spans)."""
    packed = Field(field.weights.astype(np.float32), field.moves.astype(np.float32))

    @F.arrow_udf(_FOUND)
    def scan(text: pa.Array) -> pa.Array:
        found = [x for _, _, data, offsets in blocks(text) for x in block_secrets(packed, data, offsets)]
        counts = [pa.array([sum(k == kind for _, _, k in base) for base, _ in found], pa.int64()) for kind in KINDS]
        return pa.StructArray.from_arrays([*counts, pa.array([_written(b) for b, _ in found], pa.string()), pa.array([_written(s) for _, s in found], pa.string())], _FOUND.names)

    return scan


def scan_secrets(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row of docs. Null and empty texts: no spans."""
    rows = pick(docs, "doc_id", "text").select("doc_id", scanner(field)("text").alias("f"))
    return rows.select("doc_id", *[f"f.n_{k}" for k in KINDS], F.sha2(F.col("f.base").cast("binary"), 256).alias("base_sha256"), F.col("f.spans").alias("spans"))


def redact(docs: DataFrame, field: Field, mark: str = "<secret>") -> DataFrame:
    """docs with every found span replaced by ``mark`` (overlapping spans by one) and n_chars, if it is a column,
    counted anew for changed texts. Other columns and rows stay; null text stays null."""
    packed = Field(field.weights.astype(np.float32), field.moves.astype(np.float32))

    @F.arrow_udf(T.StringType())
    def clean(text: pa.Array) -> pa.Array:
        out, null = [], np.asarray(text.is_null())
        for _, _, data, offsets in blocks(text):
            raw = data.tobytes()
            for (_, spans), a, b in zip(block_secrets(packed, data, offsets), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                own = raw[a:b].decode("utf-8", "replace")
                if spans:
                    parts, at = [], 0
                    for s, e, _ in spans:
                        if s >= at:
                            parts += [own[at:s], mark]
                        at = max(at, e)
                    own = "".join([*parts, own[at:]])
                out.append(own)
        return pa.array(out, pa.string(), mask=null)

    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    if place(names, "text") is None:
        return docs
    at = f"c{place(names, 'text')}"
    plain = plain.withColumn("new", clean(at))
    if place(names, "n_chars") is not None:
        n = f"c{place(names, 'n_chars')}"
        plain = plain.withColumn(n, F.when(F.col("new") == F.col(at), F.col(n)).otherwise(F.length("new").cast("long")))
    return plain.withColumn(at, F.col("new")).drop("new").toDF(*names)


def sha256(spans: list[tuple[int, int, str]]) -> str:
    return hashlib.sha256(_written(spans).encode()).hexdigest()
