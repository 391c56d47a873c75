"""Secret scan: base patterns, and a linear-chain conditional random field that adds spans.

The field's tokens are maximal runs of characters other than ASCII white space and the marks "'`=:,;<>()[]{}|, all tokens of
a text are one chain, and each is tagged as secret begin, inside or outside. Features: the token's shape (length, kinds of
characters and how they alternate, hexadecimal, its beginning), neighbouring words and marks, how far behind it a hint word
like `password` stands, and its file (share of digits, hint words, many odd tokens). A text's tags are decoded exactly by
Viterbi: a chain is cut into pieces, whose best paths between any two tags are found for all pieces at once, then joined.

The field is trained here, by maximum likelihood, on windows of about SAMPLE documents (those whose doc_id hashes lowest, of
at most SAMPLE_CHARS characters), tagged by the base patterns, and on made-up lines. Windows without anything odd are
represented by one in PLAIN, which counts PLAIN times; windows of documents with a token behind a hint word that has no word's
shape, and that no base pattern matches, are left out, as it may be a secret.

Null and empty texts have no spans. Texts are read whole. Repeated rows each give a row; extra columns, also ones whose names
clash, are ignored, or carried along by redact(). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm._shared import hash_sample, hashed, keeps_names, mix, only, slices, small_batches, table, utf8, words

SAMPLE, SAMPLE_CHARS = 1000, 20_000
#: Tokens of a training window, and how many plain windows one stands for.
WINDOW, PLAIN = 16, 64
#: Kinds of spans, in the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "crf")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
HINTS = "password passwords passwd passphrase passcode pwd pass secret secrets token key keys apikey api access auth authorization bearer credential credentials login private pin".split()
OUT, BEGIN, INSIDE = 0, 1, 2
#: Bytes of text whose tokens are tagged at a time, and tokens of a piece of a chain.
SLICE, PIECE = 1 << 20, 128
_MARKS = b"\"'`=:,;<>()[]{}|"
TOKEN = ~table([0x20, *range(0x09, 0x0E), *_MARKS])
#: Kinds of bytes: digit, small letter, capital, other ASCII, beyond ASCII.
KIND = np.array([0 if 48 <= b < 58 else 1 if 97 <= b < 123 else 2 if 65 <= b < 91 else 3 if b < 128 else 4 for b in range(256)], np.uint8)
HEXADECIMAL = table(b"0123456789abcdef")
SPACE = table([0x20, *range(0x09, 0x0E)])
#: Kinds of neighbouring characters: none, white space, = : quote, opening, closing, other.
BESIDE = np.array([1 if b in b" \t\r\n\x0b\x0c" else 2 if b == 61 else 3 if b == 58 else 4 if b in b"\"'`" else 5 if b in b"([{<" else 6 if b in b")]}>,;|" else 7 for b in range(256)], np.int32)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """kind, start and end of the matches of the base patterns."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    # a run of 16 or more: the same as the long ones of all runs
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _of_words(texts: list[str]) -> np.ndarray:
    raw, offsets = utf8(pa.array(texts, pa.string()))
    return np.sort(hashed(raw, offsets[:-1], offsets[1:]))


HINT_HASHES = _of_words(HINTS)
#: Features and how many values each has; words and beginnings go to buckets by hash.
SIZES = {
    "length": 16, "kinds": 32, "digits": 10, "turns": 10, "inner": 5, "hex": 3, "start": 1 << 12, "before": 1 << 13, "before2": 1 << 13, "after": 1 << 12, "left": 8, "mark": 8, "right": 8, "hint": 6,
    "hint kinds": 6 * 32, "hint length": 6 * 16, "hint turns": 6 * 10, "kinds length": 32 * 16, "mark kinds": 8 * 32, "hint mark": 6 * 8, "file digits": 8, "file hint": 2, "file odd": 6, "kinds turns": 32 * 10, "bias": 1,
}
FIRST = dict(zip(SIZES, np.cumsum([0, *SIZES.values()])[:-1].tolist(), strict=True))
VALUES = sum(SIZES.values())


class Tokens:
    """The tokens of some texts: start, end (bytes) and row of each, and features, a column of value numbers each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.start, self.end, self.row = s, e, row = words(raw, offsets, TOKEN)
        n = len(s)
        self.features = np.zeros((len(SIZES), n), np.int32)
        self.odd, self.doubtful = np.zeros(n, bool), np.zeros(n, bool)
        if not n:
            return
        kind = KIND[raw]
        counts = lambda held: (lambda c: (c[e] - c[s]))(np.concatenate([[0], np.cumsum(held, dtype=np.int32)]))
        size = (e - s).astype(np.int32)
        of_kind = [counts(kind == k) for k in range(5)]
        turn = np.zeros(len(raw), bool)
        turn[1:] = kind[1:] != kind[:-1]
        turns = counts(turn) - turn[s]
        capital_first = kind[s] == 2
        digits, capitals = of_kind[0], of_kind[2]
        kinds = sum((of_kind[k] > 0).astype(np.int32) << k for k in range(5))
        inner = np.minimum(4, capitals - capital_first)
        length = np.minimum(15, np.where(size < 8, size, 6 + size // 4))
        hexadecimal = np.where(counts(HEXADECIMAL[raw]) == size, 1 + (size >= 16), 0)
        names = hashed(raw, s, e)
        begin = np.zeros(n, np.uint64)
        for k in range(4):
            begin = (begin << np.uint64(8)) | np.where(size > k, raw[np.minimum(s + k, len(raw) - 1)], 0).astype(np.uint64)
        bucket = lambda h, bits: (mix(h) >> np.uint64(64 - bits)).astype(np.int32)
        same = lambda k: np.concatenate([np.zeros(min(k, n), bool), row[k:] == row[:-k]])
        moved = lambda x, k: np.where(same(k), np.concatenate([np.zeros(min(k, n), x.dtype), x[:-k]]), 0)
        word = bucket(names, 13)
        follows = np.zeros(n, np.int32)
        follows[:-1] = np.where(row[1:] == row[:-1], bucket(names[1:], 12), 0)
        # tokens since the last hint word of the row, up to 4
        is_hint = np.isin(names, HINT_HASHES)
        last = np.maximum.accumulate(np.where(is_hint, np.arange(n), -1))
        last = np.concatenate([[-1], last[:-1]])
        near = (last >= 0) & (row[np.maximum(last, 0)] == row)
        hint = np.where(near & (np.arange(n) - last <= 4), np.minimum(4, np.arange(n) - last), 0) + 0
        hint = np.where((hint > 0) & (digits == 0) & is_hint, 5, hint)
        first, last_byte = offsets[row], offsets[row + 1]
        left = np.where(s > first, BESIDE[raw[np.maximum(s - 1, 0)]], 0)
        solid = np.maximum.accumulate(np.where(~SPACE[raw], np.arange(len(raw)), -1))
        before = np.where(s > 0, solid[np.maximum(s - 1, 0)], -1)
        mark = np.where((before >= first) & (s > 0), BESIDE[raw[np.maximum(before, 0)]], 0)
        right = np.where(e < last_byte, BESIDE[raw[np.minimum(e, len(raw) - 1)]], 0)
        share = (9 * digits // size).astype(np.int32)
        alternates = np.minimum(9, np.where(size < 16, turns, 16 * turns // size)).astype(np.int32)
        self.odd = (digits > 0) & (size >= 6) | (inner > 0) & (of_kind[1] > 0) & (size >= 8) | (hint > 0) | is_hint
        # behind a hint word, and of no word's shape
        self.doubtful = (hint > 0) & (hint < 5) & ((digits > 0) | (inner > 0) & (of_kind[1] > 0) | (of_kind[3] > 1) | (size >= 16))
        rows = len(offsets) - 1
        bytes_of = np.maximum(1, np.diff(offsets))
        file_digits = np.minimum(7, 40 * np.bincount(row, weights=digits, minlength=rows) / bytes_of).astype(np.int32)
        file_hint = (np.bincount(row, weights=is_hint, minlength=rows) > 0).astype(np.int32)
        strange = np.bincount(row, weights=(digits > 0) & (size >= 8), minlength=rows).astype(np.int64)
        file_odd = np.minimum(5, np.ceil(np.log2(strange + 1))).astype(np.int32)
        values = {
            "length": length, "kinds": kinds, "digits": share, "turns": alternates, "inner": inner, "hex": hexadecimal, "start": np.where(size >= 8, bucket(begin, 12), 0), "before": moved(word, 1), "before2": moved(word, 2),
            "after": follows, "left": left, "mark": mark, "right": right, "hint": hint, "hint kinds": hint * 32 + kinds, "hint length": hint * 16 + length, "hint turns": hint * 10 + alternates, "kinds length": kinds * 16 + length,
            "mark kinds": mark * 32 + kinds, "hint mark": hint * 8 + mark, "file digits": file_digits[row], "file hint": file_hint[row], "file odd": file_odd[row], "kinds turns": kinds * 10 + alternates, "bias": np.zeros(n, np.int32),
        }
        for k, name in enumerate(SIZES):
            self.features[k] = values[name].astype(np.int32) + FIRST[name]


def viterbi(emitted: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best tags of a chain (a row of scores each) that starts after, and ends before, an outside token. Exact: pieces of PIECE tokens are searched at once, for each tag before them, then joined."""
    n = len(emitted)
    pieces = -(-(n + 1) // PIECE)
    # outside tokens after the end change nothing but the score
    e = np.zeros((pieces * PIECE, 3))
    e[:n] = emitted
    e[n:, 1:] = -np.inf
    e = e.reshape(pieces, PIECE, 3)
    best = move[None] + e[:, 0, None, :]
    back = np.zeros((PIECE, pieces, 3, 3), np.int8)
    for t in range(1, PIECE):
        step = best[:, :, :, None] + move[None, None]
        back[t] = step.argmax(axis=2)
        best = step.max(axis=2) + e[:, t, None, :]
    score, came = np.array([0.0, -np.inf, -np.inf]), np.zeros((pieces, 3), np.int64)
    for k in range(pieces):
        through = score[:, None] + best[k]
        came[k] = through.argmax(axis=0)
        score = through.max(axis=0)
    entry, exit_, tag = np.zeros(pieces, np.int64), np.zeros(pieces, np.int64), OUT
    for k in range(pieces - 1, -1, -1):
        exit_[k], tag = tag, int(came[k, tag])
        entry[k] = tag
    tags = np.zeros((pieces, PIECE), np.int64)
    tags[:, -1] = exit_
    every = np.arange(pieces)
    for t in range(PIECE - 1, 0, -1):
        tags[:, t - 1] = back[t, every, entry, tags[:, t]]
    return tags.ravel()[:n]


class Field:
    """A linear-chain conditional random field: scores of begin and inside for each value of a feature (outside has none), and of moves between tags."""

    def __init__(self, emit: np.ndarray, move: np.ndarray) -> None:
        self.emit, self.move = emit, move

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((features.shape[1], 3))
        for values in features:
            out[:, 1:] += self.emit[values]
        return out

    def spans(self, raw: np.ndarray, offsets: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """The secrets (bytes within the row) of some texts, by row: each begin with the insides that follow it, without dots, dashes and question marks at the end."""
        tokens = Tokens(raw, offsets)
        n = len(tokens.start)
        if not n:
            return {}
        scores = self.scores(tokens.features)
        # A run of tokens that aren't outside gains no more than its tokens' scores and the best moves into and out of them, against moves among
        # outside tokens. Texts in which no token's share of that is above 0 are outside as a whole, for certain.
        gain = scores[:, 1:] + self.move[:, 1:].max(axis=0) - self.move[OUT, OUT] + max(0.0, self.move[1:, OUT].max() - self.move[OUT, OUT])
        open_ = np.zeros(len(offsets) - 1, bool)
        open_[tokens.row[(gain > 0).any(axis=1)]] = True
        some = np.flatnonzero(open_[tokens.row])
        if not len(some):
            return {}
        # the others are one chain: between two texts stands a token that can only be outside
        place = np.arange(len(some)) + np.cumsum(open_)[tokens.row[some]]
        emitted = np.full((len(some) + int(open_.sum()) + 1, 3), -np.inf)
        emitted[:, 0] = 0.0
        emitted[place] = scores[some]
        tags = np.zeros(n, np.int64)
        tags[some] = viterbi(emitted, self.move)[place]
        out: dict[int, list[tuple[int, int]]] = {}
        for k in np.flatnonzero(tags != OUT).tolist():
            r = int(tokens.row[k])
            a, b = (int(x[k] - offsets[r]) for x in (tokens.start, tokens.end))
            mine = out.setdefault(r, [])
            if tags[k] == INSIDE and mine:
                mine[-1] = (mine[-1][0], b)
            else:
                mine.append((a, b))
        for r, mine in out.items():
            text = raw[offsets[r] : offsets[r + 1]].tobytes()
            out[r] = [(a, a + len(left)) for a, b in mine if (left := text[a:b].rstrip(b".?-"))]
        return out


#: No tag moves from outside to inside.
FORBIDDEN = -1e4


def marginals(e: np.ndarray, move: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of chains (padded; real says which tokens are): the probability of each tag of each token, the expected moves of each chain (with those from and to the outside tokens around it), and the log of the sum over all tags, by forward and backward sums."""
    add = lambda x, axis: np.log(np.exp(x - x.max(axis=axis, keepdims=True)).sum(axis=axis)) + x.max(axis=axis)
    n, longest, _ = e.shape
    rows, last = np.arange(n), real.sum(axis=1) - 1
    forward, backward = np.zeros((n, longest, 3)), np.zeros((n, longest, 3))
    forward[:, 0] = move[OUT] + e[:, 0]
    for t in range(1, longest):
        forward[:, t] = add(forward[:, t - 1, :, None] + move, 1) + e[:, t]
    backward[rows, last] = move[:, OUT]
    for t in range(longest - 2, -1, -1):
        inner = t < last
        backward[inner, t] = add(move + (e[inner, t + 1] + backward[inner, t + 1])[:, None, :], 2)
    total = add(forward[rows, last] + move[:, OUT], 1)
    p = np.where(real[:, :, None], np.exp(np.minimum(0, forward + backward - total[:, None, None])), 0)
    moves = np.zeros((n, 3, 3))
    moves[:, OUT] += p[:, 0]
    moves[:, :, OUT] += p[rows, last]
    for t in range(1, longest):
        on = real[:, t]
        moves[on] += np.exp(forward[on, t - 1, :, None] + move + (e[on, t] + backward[on, t])[:, None, :] - total[on, None, None])
    return p, moves, total


def train(chains: list[tuple[np.ndarray, np.ndarray, float]], rounds: int = 80, rate: float = 0.3, decay: float = 1e-4) -> Field:
    """Maximum likelihood with a quadratic penalty, by Adam over all chains: the features of a chain's tokens, their tags, and how often the chain counts."""
    longest, n = max(len(tags) for _, tags, _ in chains), len(chains)
    weight = np.array([w for _, _, w in chains])
    real, tag = np.zeros((n, longest), bool), np.zeros((n, longest), np.int64)
    where = np.concatenate([c * longest + np.arange(len(tags)) for c, (_, tags, _) in enumerate(chains)])
    for c, (_, tags, _) in enumerate(chains):
        real[c, : len(tags)], tag[c, : len(tags)] = True, tags
    which = np.concatenate([f for f, _, _ in chains], axis=1)
    used, which = np.unique(which, return_inverse=True)
    which = which.reshape(len(SIZES), -1)
    emit, move = np.zeros((len(used), 2)), np.zeros((3, 3))
    forbidden = np.zeros((3, 3))
    forbidden[OUT, INSIDE] = FORBIDDEN
    seen = np.zeros((n, 3, 3))
    rows, last = np.arange(n), real.sum(axis=1) - 1
    np.add.at(seen, (rows, OUT, tag[:, 0]), 1)
    np.add.at(seen, (rows, tag[rows, last], OUT), 1)
    for t in range(1, longest):
        on = np.flatnonzero(real[:, t])
        np.add.at(seen, (on, tag[on, t - 1], tag[on, t]), 1)
    truth = np.zeros((n, longest, 3))
    truth[rows[:, None], np.arange(longest), tag] = real
    m, v = [np.zeros_like(emit), np.zeros_like(move)], [np.zeros_like(emit), np.zeros_like(move)]
    for k in range(rounds):
        e = np.zeros((n * longest, 3))
        for values in which:
            e[where, 1:] += emit[values]
        p, moves, _ = marginals(e.reshape(n, longest, 3), move + forbidden, real)
        gap = ((p - truth) * weight[:, None, None]).reshape(-1, 3)[where, 1:]
        g_emit = np.stack([sum(np.bincount(values, weights=gap[:, j], minlength=len(used)) for values in which) for j in range(2)], axis=1)
        g_move = ((moves - seen) * weight[:, None, None]).sum(axis=0)
        for i, (x, g) in enumerate(((emit, g_emit), (move, g_move))):
            g = g / weight.sum() + decay * x
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            x -= rate * (m[i] / (1 - 0.9 ** (k + 1))) / (np.sqrt(v[i] / (1 - 0.99 ** (k + 1))) + 1e-8)
    out = np.zeros((VALUES, 2))
    out[used] = emit
    return Field(out, move + forbidden)


def made_up(seed: int = 5, many: int = 60) -> list[tuple[str, list[tuple[int, int]]]]:
    """Lines with a secret that base patterns may miss, and lines with tokens that are none."""
    r = random.Random(seed)
    pick = lambda chars, n: "".join(r.choice(chars) for _ in range(n))
    mixed, lower = string.ascii_letters + string.digits, string.ascii_lowercase
    prose = lambda n: " ".join(pick("aeioustrnlmd", r.randrange(2, 10)) for _ in range(n))
    out = []

    def line(before: str, value: str, after: str, secret: bool) -> None:
        lead = prose(r.randrange(0, 6)) + " " if r.random() < 0.7 else ""
        before, after = lead + before, after + (" " + prose(r.randrange(0, 6)) if r.random() < 0.7 else "")
        out.append((before + value + after, [(len(before), len(before) + len(value))] if secret else []))

    def lead_in() -> str:
        """A hint word, and up to three words or marks between it and what follows."""
        word = r.choice(HINTS)
        if r.random() < 0.3:
            return r.choice(["the password is ", "my secret: ", "Authorization: Bearer ", 'auth = "', "use credential ", "private key: ", "login with ", "pwd ", f"{word}: ", f"{word} = ", f'"{word}": "'])
        between = r.choice(["", "is ", "was ", f"for the {prose(1)} is ", f"for {prose(1)} ", f"to the {prose(1)} ", f"of {prose(2)} ", f"{prose(1)} ", f"{prose(2)} ", f"{prose(3)} "])
        return f"{r.choice(['the ', 'my ', 'a ', 'new ', '', prose(1) + ' '])}{word.capitalize() if r.random() < 0.2 else word} {between}"

    for _ in range(many):
        hint = lead_in()
        long = pick(mixed, r.randrange(20, 46))
        camel = "".join(pick(lower, r.randrange(4, 9)).capitalize() for _ in range(r.randrange(2, 5)))
        short = pick(lower, r.randrange(4, 8)) + str(r.randrange(1, 1000))
        symbols = pick(string.ascii_letters, 2) + r.choice("@!#$%&*") + pick(mixed, r.randrange(4, 8)) + r.choice("@!#$%&*") + pick(mixed, 3)
        letters = pick(string.ascii_letters, r.randrange(16, 40))
        of = r.choice([lower, string.ascii_uppercase, mixed[:26] + mixed[26:52]]) + string.digits * 2
        groups = " ".join(pick(of, size) for size in [r.randrange(3, 7)] * r.randrange(2, 6))
        dashed = "-".join(pick(string.ascii_uppercase + string.digits, 5) for _ in range(r.randrange(3, 6)))
        mangled = pick(lower, r.randrange(3, 7)).capitalize() + pick(string.digits, r.randrange(1, 5)) + r.choice(["!", "$", "#", "", "_x"])
        for value in (long, camel, short, symbols, letters, groups, dashed, mangled, long[:24]):
            hint = lead_in()
            line(hint, value, r.choice(["", '"' if '"' in hint else "", " and so on", "\n", " now", " for the mail", "."]), True)
        line("", r.choice(["ghp_", "gho_", "sk-", "sk_live_", "xoxb-", "glpat-", "npm_", "eyJ", "AIza"]) + pick(mixed, r.randrange(24, 40)), r.choice(["", " there", "\n"]), True)
        line("", f"https://{pick(lower, 5)}:{pick(mixed, 14)}@{pick(lower, 6)}.example.com/", " there", False)
        line(r.choice(["call ", "phone: ", "tel "]), f"{r.randrange(10**9, 10**10)}", " today", False)
        line("from ", f"{r.randrange(1990, 2030)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}", " on", False)
        line("on ", f"{r.randrange(1, 29)}.{r.randrange(1, 13)}.{r.randrange(1990, 2030)}", " it", False)
        line("version ", f"{r.randrange(20)}.{r.randrange(20)}.{r.randrange(100)}-rc{r.randrange(9)}", " is out", False)
        line("write to ", f"{pick(lower, 6)}.{r.randrange(100)}@mail.example.com", "", False)
        line("at ", f"www.{pick(lower, 8)}.com/{pick(lower, 5)}/{r.randrange(1000)}", " now", False)
        line("see ", f"https://{pick(lower, 8)}.org/{pick(lower, 5)}-{pick(lower, 7)}?page={r.randrange(1000)}&id={r.randrange(10**6)}", "", False)
        line("order ", f"{pick(string.ascii_uppercase, 2)}-{r.randrange(10**6, 10**8)}", " came", False)
        line("in ", f"{pick(lower, 7)}_{pick(lower, 5)}{r.randrange(10)}.py", " here", False)
        line("the class ", f"{pick(lower, 5).capitalize()}{pick(lower, 6).capitalize()}", " is old", False)
        for _ in range(6):
            line(lead_in(), prose(r.randrange(1, 7)), r.choice([".", "", " in 2020", " by Anna", ", too"]), False)
        for _ in range(3):
            line(r.choice(["the password is ", "the key to ", "a secret ", "access to the ", "bearer of ", "my token was ", "private ", "a key ", "the secret of the ", "my password and ", "login page of ", "the access "]), prose(r.randrange(1, 6)), r.choice([".", "", " in 2020", " by Anna"]), False)
        line(r.choice(["the private ", "the key ", "password ", "secret "]), pick("aeioustrnlmd", 6).capitalize(), " said", False)
        line("the password is ", r.choice(["required", "needed", "wrong", "invalid", "lost", "empty", "not", "expired", "the same", "too short", "case sensitive", "reset"]), " for all users", False)
        line("", f"{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}.{r.randrange(256)}", " answered", False)
        line("card ", f"{pick(string.digits, 4)}-{pick(string.digits, 4)}", " number", False)
        line("", prose(r.randrange(4, 14)), ".", False)
        line("", " ".join(pick("aeioustrnlmd", r.randrange(2, 8)).upper() + "!!" for _ in range(5)), "", False)
    return out


def windows(texts: list[tuple[str, list[tuple[int, int]]]], sure: bool = True) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """Training chains: features and tags of WINDOW tokens each, and their weight. A token that shares characters with a secret is begin, or inside if the one before shares the same. Unless all secrets are known for sure, windows with doubtful tokens outside of secrets teach nothing."""
    raw, offsets = utf8(pa.array([t for t, _ in texts], pa.string()))
    tokens = Tokens(raw, offsets)
    tags = np.zeros(len(tokens.start), np.int64)
    first = np.searchsorted(tokens.row, np.arange(len(texts) + 1))
    for r, (text, secrets) in enumerate(texts):
        for a, b in secrets:
            a, b = (len(text[:x].encode()) + offsets[r] for x in (a, b))
            mine = first[r] + np.flatnonzero((tokens.start[first[r] : first[r + 1]] < b) & (tokens.end[first[r] : first[r + 1]] > a))
            tags[mine] = INSIDE
            tags[mine[:1]] = BEGIN
    if sure:  # made-up lines shouldn't be told by their words
        drop = np.random.default_rng(7)
        for name in ("start", "before", "before2", "after"):
            tokens.features[list(SIZES).index(name), drop.random(len(tags)) < 0.6] = FIRST[name]
    out, plain = [], 0
    for r in range(len(texts)):
        a = first[r]
        while a < first[r + 1]:
            z = min(a + WINDOW, first[r + 1])
            while z < first[r + 1] and tags[z] == INSIDE:  # a secret isn't cut
                z += 1
            odd = tokens.odd[a:z].any() or tags[a:z].any()
            plain += not odd
            if not sure and (tokens.doubtful[a:z] & (tags[a:z] == OUT)).any():
                a = z
                continue
            if odd or plain % PLAIN == 1:
                out.append((tokens.features[:, a:z], tags[a:z], 1.0 if odd else float(PLAIN)))
            a = z
    return out


def fit(docs: DataFrame) -> Field:
    """Train on a bounded sample of docs and on made-up lines; a document's base spans are its secrets."""
    sample = hash_sample(only(docs, "doc_id", "text").where(F.length("text").between(1, SAMPLE_CHARS)), "doc_id", SAMPLE)
    texts = sorted(r["text"] for r in sample.collect())
    secrets = [(t, sorted([(m.start(2), m.end(2)) for m in ASSIGN.finditer(t) if len(m[2]) >= 12] + [s[1:] for s in base_spans(t) if s[0] != "assign"])) for t in texts]
    return train(windows(made_up()) + windows(secrets, sure=False))


def spans_of(texts: pa.Array, field: Field) -> Iterator[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """Of each text, the base spans, and all: the field's spans come on top where no base span shares a character. In code points."""
    raw, offsets = utf8(texts)
    more = field.spans(raw, offsets)
    for r, text in enumerate(texts.to_pylist()):
        base = base_spans(text) if text else []
        mine = []
        if r in more:
            points = np.concatenate([[0], np.cumsum((raw[offsets[r] : offsets[r + 1]] & 0xC0) != 0x80)])
            mine = [("crf", int(points[a]), int(points[b])) for a, b in more[r]]
        yield base, base + [s for s in mine if not any(s[1] < b and a < s[2] for _, a, b in base)]


def scan(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end in code points, end exclusive) of each row of docs. Without a field it is trained on docs."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(field or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            counts, sha, spans = {k: [] for k in KINDS[:3]}, [], []
            for base, found in spans_of(b.column("text"), model.value):
                for k in counts:
                    counts[k].append(sum(s[0] == k for s in base))
                sha.append(hashlib.sha256(digest(base).encode()).hexdigest())
                spans.append(digest(found))
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), **{f"n_{k}": pa.array(v, pa.int64()) for k, v in counts.items()}, "base_sha256": pa.array(sha, pa.string()), "spans": pa.array(spans, pa.string())})

    return only(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redacted(text: str, spans: list[tuple[str, int, int]], mark: str) -> str:
    """The text with mark in the place of each span (or of several that share characters)."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


@keeps_names
def redact(docs: DataFrame, mark: str = "[SECRET]", field: Field | None = None) -> DataFrame:
    """The rows of docs, with mark in the place of all secrets in text, and n_chars the new length; other rows and columns stay as they are."""
    spark = docs.sparkSession
    small_batches(spark)
    model = spark.sparkContext.broadcast(field or fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=SLICE):
            at, size_at = b.schema.get_field_index("text"), b.schema.get_field_index("n_chars")
            texts, sizes, changed = b.column(at).to_pylist(), b.column(size_at).to_pylist() if size_at >= 0 else [None] * b.num_rows, False
            for k, (_, spans) in enumerate(spans_of(b.column(at), model.value)):
                if spans:
                    texts[k], changed = redacted(texts[k], spans, mark), True
                    sizes[k] = len(texts[k])
            if changed:
                b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
                if size_at >= 0:
                    b = b.set_column(size_at, b.schema.field(size_at), pa.array(sizes, pa.int64()))
            yield b

    return docs.mapInArrow(run, docs.schema)
