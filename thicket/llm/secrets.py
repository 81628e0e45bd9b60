"""Credentials in source code and configuration: a linear-chain conditional random field over lexical tokens.

Every line is cut into tokens (words, literals, quotes, signs, key-block marks). Features of shape and context (kind of the key to the left, quotes, calls, URL parts, place-holders)
score the labels outside, begin and inside; Viterbi paths give the exact characters to redact. The model
is trained on the driver from generated examples, with exact gradients of the likelihood by forward and backward
sums, once per process.
"""

from __future__ import annotations

import functools
import gc
import itertools
import math
import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

O, B, I = 0, 1, 2
DIM, EXAMPLES, STEPS, RATE, L2, SEED = 1 << 16, 6_000, 60, 0.12, 2e-6, 11
#: Generated lines without any name of a secret, as most lines are.
ORDINARY = 2_000

TOKEN = re.compile(
    r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----|-----(?:BEGIN|END) [A-Z0-9 ]+-----"
    r"|\\[nrt]|://|<>|=>|:=|\$\{[^}\s]*\}|\{\{[^}]*\}\}|#\{[^}]*\}|<[A-Za-z][\w \-]*>|\n|\s+|[A-Za-z0-9_+%!$*#~^.\-]+|."
)
#: Names of secrets, and words that make a name of something else: fixed values.
SECRET_WORDS = (
    "password passwd passphrase passcode pass pwd pw secret secrets token tokens apikey credential credentials cred creds kennwort passwort contrasena clave"
    " contraseña auth authorization bearer basic signing hmac webhook private access login pat jwt psk salt pin key keys passe motdepasse schluessel schlüssel"
).split()
OTHER_WORDS = (
    "name count path env file url uri host type kind id ids length len size max min limit ttl expiry expires public pub hash digest checksum integrity sha sum md5 fingerprint"
    " version rotated field column header prefix suffix label index format regex pattern hint policy class model user username uid role scope issuer bits thumb image icon template mask"
).split()
CUE = re.compile(
    r"passw|passphr|passcode|\bpass\b|_pass|pwd|\bpw\b|secret|token|api.?key|\bkey|[_-]key|[a-z]Key|KEY|auth|cred|login|bearer|basic\s|kennwort|passwort|contrase|clave|mot.?de.?passe|schl(?:ue|ü)ssel|"
    r"://[^\s/@]*:[^\s@]*@|AKIA|ASIA|eyJ[A-Za-z0-9]|gh[pousr]_|xox[abprs]-|PRIVATE KEY|identified\s+by|\bsig(?:n|nature)?\b|(?:^|\s)-[pu]\s*\S|--pass|\bpin\b|\bsalt\b|hmac|webhook|sk_live|glpat|npm_|AIza",
    re.IGNORECASE,
)
RUN = re.compile(r"[A-Za-z0-9_+%!$*#~^.\-/=]{12,}")


def dense(run: str) -> bool:
    """A literal of mixed letters and digits that alternate, unlike a name with a number at its end."""
    return not run.islower() and not run.isupper() and len(_DIGITS.findall(run)) > 1


_DIGITS = re.compile(r"\d+")
PREFIX = re.compile(r"(?:AKIA|ASIA|AROA)[A-Z0-9]{12,}$|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|sk_live_|sk_test_|rk_live_|sk-|npm_|pypi-|AIza|ya29\.|eyJ|SG\.|hvs\.|dop_v1_|shpat_|[a-z]{2,5}\d[._-][A-Za-z0-9]{8,}")
PLACEHOLDER = re.compile(
    r"(?i)^(?:your|my|the|some|insert|enter|put|add)?[_\- .]*(?:x{4,}|\*{2,}|\.{3,}|-{3,}|_{3,}|changeme|change[_-]?(?:me|it|this)|replace.*|place.?holder|redacted|masked|dummy|example|sample|todo|tbd|fixme|none|null|nil|unset|empty|undefined|n/?a|true|false)"
    r"(?:[_\- .].*)?$|(?i:your[_-]|_here$|-here$|example|changeme|redacted|placeholder|dummy)|(.)\1{5,}|^<.*>$|\*{3,}"
)
REFERENCE = re.compile(r"^\$|^\{\{|^#\{|^%[sdv]$|^%\w+%$|^\{\w*\}$|^process\.env|^os\.|^ENV\b|^env[.(]|^vault:|^secretKeyRef|^System\.")
TYPES = set("string str bool boolean number int integer any object bytes char float text varchar option result none null nil undefined self this required true false".split())
_SUB = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+|[^\W\d_a-zA-Z]+")
_CALL = re.compile(r"(?i)get|read|fetch|load|lookup|env|vault|from|require|resolve|param|config|find")


def _subwords(s: str) -> list[str]:
    return [w.lower() for w in _SUB.findall(s)]


@functools.lru_cache(maxsize=200_000)
def key_kind(s: str) -> str:
    """What a name to the left of a value says: secret, other (something about it), user, or nothing."""
    words = _subwords(s)
    if not words:
        return ""
    secret = [i for i, w in enumerate(words) if w in _SECRETS or w.startswith(("passw", "secret", "credential"))]
    last = words[-1]
    if last in _OTHERS:
        return "other:" + last if secret else "o"
    if "public" in words or "pub" in words or "count" in words:
        return "other:public"
    if secret:
        strong = any(words[i] not in ("key", "keys", "pass", "pin", "salt", "access", "auth", "login", "basic", "passe", "token", "tokens") for i in secret) or len(words) > 1
        return "S" if strong and secret[-1] == len(words) - 1 else "s" if secret[-1] == len(words) - 1 else "m"
    return ""


_SECRETS, _OTHERS = frozenset(SECRET_WORDS), frozenset(OTHER_WORDS)


def _entropy(s: str) -> float:
    counts = [s.count(c) for c in set(s)]
    return -sum(c / len(s) * math.log2(c / len(s)) for c in counts)


@functools.lru_cache(maxsize=200_000)
def shape(s: str) -> tuple[str, ...]:
    """Features of one token alone; the first is its class."""
    n = len(s)
    if s == "\n" or s.isspace():
        return ("_",)
    if s.startswith("-----"):
        return ("pem" + ("b" if "BEGIN" in s else "e") + ("p" if "PRIVATE" in s else "u"),)
    if not any(c.isalnum() for c in s):
        return ("mask" if n > 2 and set(s) <= set("*.x-_#") else "p" + s[:3],)
    if REFERENCE.search(s):
        return ("ref",)
    if PLACEHOLDER.search(s):
        return ("hold", "hold" + str(min(n, 12)))
    low, up, dig = any(c.islower() for c in s), any(c.isupper() for c in s), any(c.isdigit() for c in s)
    sign = "".join(sorted({c for c in s if not c.isalnum()}))[:3]
    if PREFIX.match(s) and n >= 12:
        return ("known", "known" + str(min(n // 8, 5)))
    kinds = f"{'a' if low else ''}{'A' if up else ''}{'9' if dig else ''}"
    size = "1" if n < 3 else "3" if n < 6 else "6" if n < 9 else "9" if n < 14 else "14" if n < 24 else "24" if n < 48 else "48"
    word = "w:" + s.lower() if s.isalpha() and n < 14 else ""
    if s.isdigit() or re.fullmatch(r"[\d.]+", s):
        c = "num"
    elif re.fullmatch(r"[0-9a-fA-F]{24,}", s) and dig:
        c = "hex" + str(n if n in (32, 40, 64) else 0)
    elif re.fullmatch(r"[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+", s):
        c = "CONST"
    elif s.isalpha():
        c = "word" if low != up or s.istitle() else "mix"
    elif re.fullmatch(r"[a-z]+(?:[._\-][a-z]+)+", s):
        c = "slug"
    elif re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", s) and not (dig and n > 9 and _entropy(s) > 3.3):
        c = "ident9" if dig else "ident"
    elif re.fullmatch(r"[a-z]+(?:[.\-_][a-z]+)+\d{1,4}", s):
        c = "slug9"
    else:
        e = _entropy(s)
        c = "rand" + ("0" if e < 2.6 else "1" if e < 3.3 else "2" if e < 4 else "3")
    return (c, "k" + kinds + size, "g" + sign, *([word] if word else []), "K" + (key_kind(s) or "-"))


class Kind:
    """All that the features can tell of a token; tokens of one kind are alike to the model."""

    __slots__ = ("c", "call", "key", "lean", "own", "sign", "verb")

    def __init__(self, t: str):
        self.own = shape(t)
        self.c = c = self.own[0]
        #: The text of signs, "\n" and " "; empty for words and other space.
        self.sign = (t if t in ("\n", " ") else "") if c == "_" else "" if any(x.isalnum() for x in t) else t
        low = t.lower()
        self.key = key_kind(t) if c not in ("_", "num") and len(t) < 40 and t[0].isalpha() else ""
        self.lean = low if t.isalpha() and len(t) < 12 and (low in _SECRETS or low in _CONTEXT) else ""
        self.call = "get" if _CALL.search(t) else "log" if _LOGIN.search(t) else "f"
        self.verb = low if c == "word" and low in _CONTEXT else ""


#: What the tokens before say: kind of the last name, tokens since, open quote, within a key block, call, verb, within the user part of a URL.
State = tuple[str, int, str, bool, str, str, int]
START: State = ("", 6, "", False, "", "", 0)


def _step(state: State, kind: Kind, called: str) -> State:
    """The state after a token; called: what a bracket here calls. No more than the first six tokens since a name are told apart."""
    key, since, quote, pem, call, verb, scheme_user = state
    c, t = kind.c, kind.sign
    if c == "_":
        return (key, min(6, since + 3), quote, pem, call, verb, scheme_user) if t == "\n" else state
    if c == "pembp":
        pem = True
    elif c.startswith("peme"):
        pem = False
    kk = kind.key
    if kk:
        key, since = (kk, 0) if not (quote and kk == "o" and since < 2) else (key, since + 1)
    else:
        since += 1
    if kind.verb:
        verb = kind.verb
    if t in _QUOTES:
        quote = "" if quote == t else (quote or t)
        scheme_user = 0
    elif t == "(":
        call = called
    elif t == ")":
        call = ""
    elif t == "://":
        scheme_user = 1
    elif t == "@":
        scheme_user = 0
    elif t in (",", ";", "&"):
        if t == ";":
            verb = ""
        if not quote:
            key, since = ("", 9) if since > 1 else (key, since)
        elif t != "," and since > 1:
            key, since = "", 9
    return (key, min(6, since), quote, pem, call, verb, scheme_user)


def ahead_of(kinds: list[Kind] | tuple[Kind, ...]) -> list[bool] | None:
    """For each token whether an @ is ahead within the same literal, as after the password part of a URL; None without any @."""
    signs = [k.sign for k in kinds]
    if "@" not in signs:
        return None
    out, ahead = [False] * len(signs), False
    for i in range(len(signs) - 1, -1, -1):
        if t := signs[i]:
            ahead = t == "@" or (ahead and t not in _URL_ENDS)
        out[i] = ahead
    return out


def _groups(kinds: list[Kind], state: State = START, until: int = -1) -> tuple[list[tuple], State]:
    """The features of each token in groups that repeat across sequences (features_of spells a group out), and the state after the first until tokens."""
    solid = [k for k in kinds if k.c != "_"]
    near = ["#", "#", "#", *(k.c for k in solid), "#", "#", "#", "#"]
    lean = ["", "", *(k.lean for k in solid), ""]
    ahead_at = ahead_of(kinds) or [False] * len(kinds)
    out = []
    k, after = -1, state
    for i, kind in enumerate(kinds):
        if i == until:
            after = state
        key, since, quote, pem, call, verb, scheme_user = state
        c, t = kind.c, kind.sign
        if c == "_":
            out.append((("_", t == "\n", pem),))
            state = _step(state, kind, "f")
            continue
        k += 1
        out.append((
            kind, ("s", c, quote, key, since if since < 6 else 6, call, verb, scheme_user, ahead_at[i], pem),
            ("l", c, near[k], near[k + 1], near[k + 2], lean[k], lean[k + 1], key), ("r", c, near[k + 4], near[k + 5], near[k + 6], near[k + 7], lean[k + 3], key),
        ))
        state = _step(state, kind, solid[k - 1].call if k else "f")
    return out, after


def features_of(group: tuple | Kind) -> list[int]:
    """The hashed features of one group; a kind stands for those of its token alone."""
    if isinstance(group, Kind):
        return [_h(x) for x in ("b", *("0" + x for x in group.own))]
    kind, c = group[0], group[1]
    if kind == "_":
        return [_h("space" + ("n" if c else "") + ("P" if group[2] else ""))]
    if kind == "s":
        _, c, quote, key, since, call, verb, scheme_user, ahead, pem = group
        where, url = f"{key or '-'}{since}", "u" + ("s" if scheme_user else "") + ("a" if ahead else "")
        f = [
            "q" + (quote or "-") + c, "w" + where, "W" + where + c, "K" + (key or "-") + c, "c" + (call or "-") + c, "v" + (verb or "-") + c,
            "U" + url, "U" + url + c, "P" + ("1" if pem else "0") + c, "kq" + where + (quote or "-") + c,
        ]
    elif kind == "l":
        _, c, n3, n2, n1, l2, l1, key = group
        f = ["-1" + n1, "-2" + n2, "-1c" + n1 + c, "-21" + n2 + n1, "-321" + n3 + n2 + n1, "l1" + l1, "l2" + l2, "l1c" + l1 + c, "l2c" + l2 + c, "k1" + (key or "-") + n1 + c]
    else:
        _, c, n1, n2, n3, n4, lean, key = group
        f = ["+1" + n1, "+2" + n2, "+1c" + c + n1, "n" + lean, "j" + n1 + n2 + n3 + c, "J" + n1 + n2 + n3 + n4 + (key or "-")]
    return [_h(x) for x in f]


def token_features(tokens: list[str]) -> list[list[int]]:
    """Hashed features of each token of a sequence."""
    return [[x for g in groups for x in features_of(g)] for groups in _groups([Kind(t) for t in tokens])[0]]


_URL_ENDS = frozenset("\"'`\n /")
_LOGIN = re.compile(r"(?i)login|auth|connect|sign|password|secret|token|cred")
_QUOTES = frozenset("\"'`")
_CONTEXT = frozenset("is was are at by in with identified role user machine login until old new tmp remove curl deploy basic bearer token password pwd key value begin end env vault must have has of du de le la set export run sha data image ssh from for".split())


def _h(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) % DIM


class Crf:
    def __init__(self, emit: np.ndarray, move: np.ndarray):
        self.emit, self.move = emit, move

    def label(self, sequences: list[list[list[int]]]) -> list[np.ndarray]:
        """The best path of each sequence, all sequences at once."""
        if not sequences:
            return []
        lengths = np.array([len(s) for s in sequences])
        order = np.argsort(lengths, kind="stable")
        paths: list = [None] * len(sequences)
        for part in np.array_split(order, max(1, len(order) // 512)):
            own = [sequences[i] for i in part]
            score = _emissions(own, self.emit)
            for i, p in zip(part, _viterbi(score, lengths[part], self.move), strict=True):
                paths[i] = p
        return paths


class Place:
    """A state and the solid tokens before it: what follows each kind of token from here, with the sums of its features but those of what comes after."""

    __slots__ = ("called", "key", "left", "next", "state")

    def __init__(self, state: State, called: str = "f", left: tuple[str, ...] = ("#", "#", "#", "", "")):
        self.state, self.called, self.left, self.key = state, called, left, state[0]
        self.next: dict[Kind, list] = {}


class Tagger:
    """Labels of many lines: exact, but each text, each sequence of kinds and each group of features is worked out once while remembered."""

    def __init__(self, crf: Crf):
        self.crf = crf
        self.kinds: dict[str, Kind] = {}
        self.alike: dict[tuple, Kind] = {}
        self.rows: dict[tuple | Kind, int] = {}
        self.sums = np.zeros((1 << 12, 3))
        self.used = 1  # row 0 is nothing
        self.places: dict[tuple, Place] = {}
        self.paths: dict[tuple[State, tuple[Kind, ...]], bytes] = {}
        self.texts: dict[str, list[tuple[int, int]]] = {}
        self.size = 0

    def kind(self, t: str) -> Kind:
        k = self.kinds.get(t)
        if k is None:
            k = Kind(t)
            own = tuple(self.crf.emit[features_of(k)].sum(0, dtype=float).tolist()) if k.c != "_" else ()
            k = self.kinds[t] = self.alike.setdefault((own, k.c, k.sign, k.key, k.lean, k.call, k.verb), k)
        return k

    def _new(self, sum_: np.ndarray) -> int:
        n = self.used
        if n == len(self.sums):
            self.sums = np.concatenate([self.sums, np.zeros_like(self.sums)])
        self.sums[n] = sum_
        self.used += 1
        return n

    def _row(self, group: tuple | Kind) -> int:
        n = self.rows.get(group)
        if n is None:
            n = self.rows[group] = self._new(self.crf.emit[features_of(group)].sum(0, dtype=float))
        return n

    def _place(self, *at) -> Place:
        p = self.places.get(at)
        if p is None:
            p = self.places[at] = Place(*at)
        return p

    def _hop(self, place: Place, kind: Kind, ahead: bool) -> int:
        """The row of a token at a place; the place after it is kept with it."""
        hop = place.next.get(kind)
        key, since, quote, pem, call, verb, scheme_user = state = place.state
        c = kind.c
        if c == "_":
            hop = place.next[kind] = [self._place(_step(state, kind, "f"), place.called, place.left), self._row(("_", kind.sign == "\n", pem)), 0]
            return hop[1]
        if hop is None:
            _, n2, n1, _, l1 = place.left
            hop = place.next[kind] = [self._place(_step(state, kind, place.called), kind.call, (n2, n1, c, l1, kind.lean)), 0, 0]
        s = ("s", c, quote, key, since, call, verb, scheme_user, ahead, pem)
        own, here, before = (self._row(g) for g in (kind, s, ("l", c, *place.left, key)))
        hop[1 + ahead] = self._new(self.sums[own] + self.sums[here] + self.sums[before])
        return hop[1 + ahead]

    def _rows_of(self, state: State, kinds: tuple[Kind, ...], before: list[int], after: list[int]) -> None:
        """Adds the row of each token up to it, and of each solid one the row of what comes after, as _groups has them."""
        keys, place, row, hold = [], self._place(state), before.append, self._hop
        ahead = ahead_of(kinds)
        for i, kind in enumerate(kinds):
            at = ahead is not None and ahead[i] and kind.c != "_"
            hop = place.next.get(kind)
            row((hop and hop[1 + at]) or hold(place, kind, at))
            if kind.c != "_":
                keys.append(place.key)
            place = hop[0] if hop else place.next[kind][0]
        solid = [k for k in kinds if k.c != "_"]
        c = [k.c for k in solid] + ["#", "#", "#", "#"]
        lean = [k.lean for k in solid[1:]] + [""]
        get = self.rows.get
        after += [get(g) or self._row(g) for g in zip(itertools.repeat("r"), c, c[1:], c[2:], c[3:], c[4:], lean, keys)]

    def label(self, sequences: list[tuple[State, tuple[Kind, ...]]]) -> None:
        """The best paths of sequences that begin in a state, into paths; an empty one is all outside."""
        new = sorted((s for s in set(sequences) if s not in self.paths), key=lambda s: len(s[1]))
        self.size += 9 * sum(len(s[1]) for s in new)
        for lo in range(0, len(new), 512):
            part = new[lo : lo + 512]
            before, after = [], []
            for s in part:
                self._rows_of(*s, before, after)
            flat = self.sums[before]
            flat[[k.c != "_" for s in part for k in s[1]]] += self.sums[after]
            lengths = np.array([len(s[1]) for s in part])
            score = np.zeros((len(part), int(lengths.max()), 3))
            at = np.repeat(np.arange(len(part)), lengths)
            score[at, np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
            for s, p in zip(part, _viterbi(score, lengths, self.crf.move), strict=True):
                p = p.tobytes()
                self.paths[s] = p if p.strip(b"\0") else b""

    def forget(self) -> None:
        """What is remembered is bounded, whatever the input."""
        if len(self.kinds) > 200_000:
            self.kinds.clear()
        if self.used > 600_000 or len(self.places) > 200_000:
            self._forget_rows()
        if self.size > 100_000_000 or len(self.texts) > 300_000:
            self.texts.clear()
            self.paths.clear()
            self.size = 0
        if len(self.alike) > 100_000:
            self.alike.clear()
            self.kinds.clear()
            self.paths.clear()
            self._forget_rows()

    def _forget_rows(self) -> None:
        self.rows.clear()
        self.places.clear()
        self.used = 1


def _flat(sequences: list[list[list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    feats = [f for s in sequences for t in s for f in t]
    counts = [len(t) for s in sequences for t in s]
    return np.array(feats, dtype=np.intp), np.array(counts, dtype=np.intp)


def _emissions(sequences: list, emit: np.ndarray) -> np.ndarray:
    feats, counts = _flat(sequences)
    begin = np.concatenate([[0], np.cumsum(counts)[:-1]])
    flat = np.add.reduceat(emit[feats], begin, axis=0) if len(feats) else np.zeros((0, 3))
    lengths = [len(s) for s in sequences]
    out = np.zeros((len(sequences), max(lengths), 3))
    row = np.repeat(np.arange(len(sequences)), lengths)
    col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, col] = flat
    return out


def _viterbi(score: np.ndarray, lengths: np.ndarray, move: np.ndarray) -> list[np.ndarray]:
    n, t, _ = score.shape
    best, back = score[:, 0] + np.array([0, 0, -1e4]), np.zeros((n, t, 3), dtype=np.int8)
    final = np.where((lengths == 1)[:, None], best, 0)
    for k in range(1, t):
        all_ = best[:, :, None] + move[None]
        back[:, k] = all_.argmax(1)
        best = all_.max(1) + score[:, k]
        final = np.where((lengths == k + 1)[:, None], best, final)
    label = final.argmax(1)
    path = np.zeros((n, t), dtype=np.int8)
    for k in range(t - 1, -1, -1):
        live = lengths > k
        path[live, k] = label[live]
        label = np.where(live & (lengths > k), back[np.arange(n), k, label], label)
    return [path[i, : lengths[i]] for i in range(n)]


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    m = x.max(axis, keepdims=True)
    return (m + np.log(np.exp(x - m).sum(axis, keepdims=True))).squeeze(axis)


def train_crf(examples: list[tuple[list[list[int]], list[int]]]) -> Crf:
    """Maximum likelihood with a small L2 term, by Adam over batches of like length."""
    rng = np.random.default_rng(SEED)
    emit, move = np.zeros((DIM, 3)), np.array([[0.0, 0.0, -1e4], [0.0, 0.0, 0.0], [0.0, 0.0, 0.0]])
    order = sorted(range(len(examples)), key=lambda i: len(examples[i][0]))
    batches = []
    for a in range(0, len(order), 500):
        own = [examples[i] for i in order[a : a + 500]]
        feats, counts = _flat([x for x, _ in own])
        lengths = np.array([len(x) for x, _ in own])
        row = np.repeat(np.arange(len(own)), lengths)
        col = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        gold = np.concatenate([y for _, y in own]).astype(int)
        batches.append((feats, np.repeat(np.arange(len(counts)), counts), np.concatenate([[0], np.cumsum(counts)[:-1]]), row, col, gold, lengths))
    m, v, mm, vm, t = np.zeros_like(emit), np.zeros_like(emit), np.zeros((3, 3)), np.zeros((3, 3)), 0
    for step in range(STEPS):
        for j in rng.permutation(len(batches)):
            feats, token, begin, row, col, gold, lengths = batches[j]
            n, width = len(lengths), int(lengths.max())
            score = np.zeros((n, width, 3))
            score[row, col] = np.add.reduceat(emit[feats], begin, axis=0)
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0] + np.array([0, 0, -1e4])
            for k in range(1, width):
                alpha[:, k] = _logsum(alpha[:, k - 1][:, :, None] + move, 1) + score[:, k]
            for k in range(width - 2, -1, -1):
                nxt = _logsum(move[None] + (score[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
                beta[:, k] = np.where((lengths > k + 1)[:, None], nxt, 0)
            z = _logsum(alpha[np.arange(n), lengths - 1], 1)
            g = np.exp(alpha + beta - z[:, None, None])[row, col]
            g[np.arange(len(gold)), gold] -= 1
            gm = np.zeros((3, 3))
            for k in range(1, width):
                live = lengths > k
                pair = alpha[live, k - 1][:, :, None] + move + (score[live, k] + beta[live, k])[:, None, :] - z[live, None, None]
                gm += np.exp(pair).sum(0)
            same = row[1:] == row[:-1]
            np.subtract.at(gm, (gold[:-1][same], gold[1:][same]), 1)
            ge = np.stack([np.bincount(feats, weights=g[token, y], minlength=DIM) for y in range(3)], 1) / n + L2 * emit
            gm = gm / n
            t += 1
            rate = RATE * math.sqrt(1 - 0.999**t) / (1 - 0.9**t) * (1 - 0.9 * step / STEPS)
            m, v = 0.9 * m + 0.1 * ge, 0.999 * v + 0.001 * ge * ge
            emit -= rate * m / (np.sqrt(v) + 1e-8)
            mm, vm = 0.9 * mm + 0.1 * gm, 0.999 * vm + 0.001 * gm * gm
            move -= 0.3 * rate * mm / (np.sqrt(vm) + 1e-8)
            move[0, 2] = -1e4
    return Crf(emit, move)


def _labelled(parts: list) -> tuple[list[str], list[int]]:
    """Tokens and labels of an example; the marked parts are secret."""
    text, spans = "", []
    for p in parts:
        if isinstance(p, tuple):
            spans.append((len(text), len(text) + len(p[1])))
            text += p[1]
        else:
            text += p
    tokens, labels, at = [], [], 0
    for m in TOKEN.finditer(text):
        inside = next((s for s in spans if s[0] < m.end() and m.start() < s[1] and min(m.end(), s[1]) - max(m.start(), s[0]) > 0), None)
        tokens.append(m[0])
        labels.append(O if inside is None else B if at != inside[0] + 1 else I)
        at = inside[0] + 1 if inside else 0
    return tokens, labels


@functools.cache
def trained(examples: int = EXAMPLES, seed: int = SEED) -> Crf:
    """The tagger, trained on generated examples; the same in every process."""
    from thicket.llm.secret_examples import Maker

    maker, plain, data = Maker(seed), Maker(seed + 1), []
    for parts in (*(maker.example() for _ in range(examples)), *(plain.ordinary() for _ in range(ORDINARY))):
        tokens, labels = _labelled(parts)
        if tokens:
            data.append((token_features(tokens), labels))
    return train_crf(data)


_PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
_KEY_LINE = re.compile(r"[>\s#/*\"'+]*(?:[A-Za-z0-9+/=\\]{16,}|[A-Za-z0-9+/=]+|-----END .*|[A-Z][A-Za-z-]+: .*)?[\s\"'`+;,)]*$")
#: A line longer than this is tagged in parts that overlap and hand on their state, so that no text is cut off and memory stays bounded.
PART_TOKENS, PART_OVERLAP = 400, 60


def _named(line: str) -> bool:
    """Whether an unfinished line names what its next line may hold."""
    return bool(CUE.search(line)) or any(dense(m[0]) for m in RUN.finditer(line)) or any(key_kind(w) for w in _NAME.findall(line) if len(w) < 40)


_NAME = re.compile(r"[^\W\d_][\w\-]*")


def units(text: str) -> list[tuple[int, int]]:
    """Character ranges to tag: every line that is not blank, with the lines a key block or an unfinished assignment goes on in."""
    out: list[tuple[int, int]] = []
    a = 0
    while a < len(text):
        b = text.find("\n", a)
        b = len(text) if b < 0 else b
        line = text[a:b]
        tail = line.rstrip()
        begin = _PEM_BEGIN.search(line) if "-----BEGIN" in line else None
        if begin and "-----END" not in line[begin.end() :]:
            headers = True  # a blank line ends the headers of an armoured key, not the key
            while b < len(text):
                c = text.find("\n", b + 1)
                c = len(text) if c < 0 else c
                nxt = text[b + 1 : c]
                if not nxt.strip() and not headers or not _KEY_LINE.match(nxt):
                    break
                headers = headers and ": " in nxt
                b = c
                if "-----END" in nxt:
                    break
        elif tail and (tail[-1] in "+=:(\\|" or tail.endswith("<>")) and _named(line):
            while b < len(text) and tail and (tail[-1] in "+=:(\\" or tail.endswith(("<>", "|"))):
                c = text.find("\n", b + 1)
                c = len(text) if c < 0 else c
                tail = text[b + 1 : c].rstrip()
                b = c
        if tail or b > a + len(line):
            out.append((a, b))
        a = b + 1
    return out


def _windows(kinds: tuple[Kind, ...]) -> list[tuple[State, tuple[Kind, ...]]]:
    """Overlapping parts of a line, each with the state the tokens before it leave."""
    step, out, state = PART_TOKENS - PART_OVERLAP, [], START
    for k in range(0, max(1, len(kinds) - PART_OVERLAP), step):
        part = kinds[k : k + PART_TOKENS]
        out.append((state, part))
        if k + step < len(kinds) - PART_OVERLAP:
            state = _groups(part, state, step)[1]
    return out


def _unit_spans(tokens: list[str], paths: list[bytes]) -> list[tuple[int, int]]:
    """Spans of a unit from the paths of its windows."""
    begin = [0]
    for t in tokens:
        begin.append(begin[-1] + len(t))
    spans: list[tuple[int, int]] = []
    for w, path in enumerate(paths):
        at = w * (PART_TOKENS - PART_OVERLAP)
        for k, label in enumerate(path, at):
            x, y = begin[k], begin[k + 1]
            if label == O or (tokens[k].isspace() and not (label == I and spans and spans[-1][1] == x)):
                continue
            if label == I and spans and spans[-1][1] == x:
                spans[-1] = (spans[-1][0], y)
            elif not (spans and x < spans[-1][1]):
                spans.append((x, y))
    return _whole_keys(tokens, begin, spans) if any(t.startswith("-----BEGIN") for t in tokens) else spans


def _whole_keys(tokens: list[str], begin: list[int], spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A private-key block of which the model tags any part is one span, from its begin mark to the last character before its end mark."""
    i = 0
    while i < len(tokens):
        if not _PEM_BEGIN.match(tokens[i]):
            i += 1
            continue
        j = i + 1
        while j < len(tokens) and not tokens[j].startswith("-----END"):
            j += 1
        body = [k for k in range(i + 1, j) if not tokens[k].isspace() and tokens[k] not in ("\\n", "\\r")]
        if body:
            a, b = begin[i], begin[body[-1] + 1]
            if any(x < b and a < y for x, y in spans):
                spans = sorted([s for s in spans if s[1] <= a or b <= s[0]] + [(a, b)])
        i = j
    return spans


def find_spans(texts: list[str | None], tagger: Crf | Tagger) -> list[list[tuple[int, int]]]:
    """The secret characters of each text, as ranges."""
    tagger = Tagger(tagger) if isinstance(tagger, Crf) else tagger
    collects = gc.isenabled()
    gc.disable()  # many small tuples and no cycles
    try:
        return _spans(texts, tagger)
    finally:
        if collects:
            gc.enable()


def _spans(texts: list[str | None], tagger: Tagger) -> list[list[tuple[int, int]]]:
    places = [(n, a, text[a:b]) for n, text in enumerate(texts) if text for a, b in units(text)]
    new, windows, known = {}, [], tagger.kinds.get
    for _, _, unit in places:
        if unit in tagger.texts or unit in new:
            continue
        kinds = tuple([known(t) or tagger.kind(t) for t in TOKEN.findall(unit)])
        new[unit] = parts = _windows(kinds)
        windows += parts
    tagger.label(windows)
    for unit, parts in new.items():
        paths = [tagger.paths[p] for p in parts]
        tagger.size += len(unit)
        tagger.texts[unit] = _unit_spans(TOKEN.findall(unit), paths) if any(paths) else []
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for n, a, unit in places:
        for x, y in tagger.texts[unit]:
            y = x + len(unit[x:y].rstrip())
            if y > x and not unit.startswith("-----END", x):
                out[n].append((a + x, a + y))
    tagger.forget()
    return out


def masked(text: str, spans: list[tuple[int, int]], sign: str = "*") -> str:
    """The text with the secret characters masked one by one; line ends, escapes and quotes within stay, so the code around keeps its form."""
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        out.append(re.sub(r"-----[A-Z ]+-----|\\[nrt]|[^\s\"'`\\]", lambda m: m[0] if m[0][0] in "\\" or len(m[0]) > 1 else sign, text[a:b]))
        at = b
    return "".join([*out, text[at:]])


SECRETS = "id string, line_no int, start_char long, end_char long"


def find_secrets(chunks: DataFrame, key: str = "id", text: str = "content", copy: bool = False) -> DataFrame:
    """One row per secret: id, line_no (from 1), start_char, end_char; with copy=True one row per row of chunks: id, secrets, redacted.

    Runs in Arrow batches without any shuffle. Null and empty texts have no secrets (their copy is the text itself);
    rows repeated in the input come out repeated; columns other than key and text are not read.
    """
    crf = trained()
    shared = chunks.sparkSession.sparkContext.broadcast((crf.emit.astype(np.float32), crf.move))
    src = chunks.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t"))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Tagger(Crf(*shared.value))
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = find_spans(texts, own)
                if copy:
                    done = [t if not s else masked(t, s) for t, s in zip(texts, found, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], type=pa.int32()), pa.array(done, type=pa.string())], names=["id", "secrets", "redacted"])
                    continue
                rows = [(i, t.count("\n", 0, a) + 1, a, b) for i, t, s in zip(ids, texts, found, strict=True) for a, b in s]
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, type=k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["id", "line_no", "start_char", "end_char"]
                )

    return src.mapInArrow(tag, "id string, secrets int, redacted string" if copy else SECRETS)
