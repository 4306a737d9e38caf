"""Personal data by a semi-Markov conditional random field.

Base patterns find e-mail addresses, IP addresses, payment cards and telephone numbers; a match that fails its check
(parts up to 255, Luhn and 16 to 19 digits, 8 to 15 digits) is dropped whole. What they miss is mostly a matter of
boundaries: a card right after a telephone number, a number without its +, a spelled-out address. There the model
decides.

It also finds a fifth kind, which has no base pattern: secrets, such as access keys and the values of passwords and tokens.

Model: a region is a chain of atoms (runs of digits, one spelled-out address, or the parts of one opaque word between dashes) with short
separators between. A segmentation covers a region with segments, each an entity of one kind or a single atom of none. Scores are
sums of learned weights of features of whole candidate segments (kind with digit count, group pattern, check digit, separators,
sign, letters and digits, neighbours, the word before) and of neighbouring kinds. An entity has at most ``MOST_ATOMS`` atoms and, but for
secrets, ``MOST_DIGITS`` digits, so dynamic programming finds the best segmentation, boundaries and kinds at once, in time linear in
the region. Weights maximise the conditional log-likelihood of generated examples, by stochastic gradient descent over
exact expectations (forward-backward over segments); they are learned anew from a fixed seed, in seconds.

Base spans stay as they are; atoms inside them are out of every region. Regions are all that the whole text has:
outside of them no candidate exists, so nothing is cut off. Offsets are code points, ends exclusive.

Nulls and edges: a null text is empty and has no spans; null and repeated ids are separate documents; very long
texts are handled in one pass; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import defaultdict
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds with a base pattern, and all kinds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
SECRET = KINDS.index("secret")
MOST_ATOMS, MOST_DIGITS = 8, 19
LEAST_SECRET = 12
SEED, EXAMPLES, EPOCHS, RATE, DECAY = 5, 900, 4, 0.3, 1e-4

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin with a whole run of digits, so longer runs need not be tried from within.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_SPELLED = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}(?:@| ?[\[(] ?at ?[\])] ?| at )[A-Za-z0-9-]{1,63}(?:(?:\.| ?[\[(] ?dot ?[\])] ?| dot )[A-Za-z0-9-]{1,63}){1,4}", re.I)
_BETWEEN = re.compile(r"[ ().\-/+]{1,3}")
# A word of letters and digits, with dashes inside, or of many capitals: only such can hold a secret.
_OPAQUE = re.compile(rf"(?<![A-Za-z0-9_-])(?:(?=[A-Za-z_-]*[0-9])(?=[0-9_-]*[A-Za-z])[A-Za-z0-9_-]{{{LEAST_SECRET},}}|[A-Z]{{16,}}(?![A-Za-z0-9_-]))")
_PART = re.compile("[A-Za-z0-9]+")
#: What every match of _SPELLED has: one of its three ways to say "at".
_HINT = re.compile(r"@|[\[(] ?at ?[\])]| at ", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(_DIGITS.findall(s))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base patterns' spans, by kind, then start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _only_digits(m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_only_digits(m[0])) <= 15]
    return out


class Region:
    """Atoms (start, end) of a chain; in one of digits widened to a sign or bracket before them as segments begin there."""

    def __init__(self, text: str, atoms: list[tuple[int, int]], what: str = "digits"):
        self.text, self.atoms, self.what = text, atoms, what
        self.lead = []
        for s, _ in atoms:
            if what == "digits":
                s -= s > 0 and text[s - 1] == "("
                s -= s > 0 and text[s - 1] == "+"
            self.lead.append(s)

    @property
    def spelled(self) -> bool:
        return self.what == "spelled"

    def span(self, i: int, j: int) -> tuple[int, int]:
        return self.lead[i], self.atoms[j - 1][1]

    def candidates(self, i: int):
        """(end, kind) of the segments that may begin at atom i."""
        if self.spelled:
            yield i + 1, 0
            return
        digits = 0
        for j in range(i + 1, min(len(self.atoms), i + MOST_ATOMS) + 1):
            if self.what == "opaque":
                if self.atoms[j - 1][1] - self.atoms[i][0] >= LEAST_SECRET:
                    yield j, SECRET
                continue
            digits += self.atoms[j - 1][1] - self.atoms[j - 1][0]
            if digits > MOST_DIGITS:
                return
            if j == i + 4:
                yield j, 1
            if digits >= 13:
                yield j, 2
            if 7 <= digits <= 15:
                yield j, 3


def _disjoint(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def _free(found, held: list[tuple[int, int]]):
    """Matches, in order, that touch none of the disjoint spans held. One pass over both."""
    k = 0
    for m in found:
        s, e = m.span()
        while k < len(held) and held[k][1] <= s:
            k += 1
        if k == len(held) or held[k][0] >= e:
            yield m


def regions(text: str, taken: list[tuple[str, int, int]]) -> list[Region]:
    """The regions of a text outside of the spans taken, in time linear in the text."""
    out = []
    held = _disjoint([(s, e) for _, s, e in taken])
    if _HINT.search(text):
        new = [m.span() for m in _free(_SPELLED.finditer(text), held)]
        out += [Region(text, [x], "spelled") for x in new]
        held = _disjoint(held + new)
    opaque = [m.span() for m in _free(_OPAQUE.finditer(text), held)]
    out += [Region(text, [m.span() for m in _PART.finditer(text, *x)], "opaque") for x in opaque]
    held = _disjoint(held + opaque)
    chain: list[tuple[int, int]] = []
    total = k = 0

    def close() -> None:
        if total >= 7 or len(chain) >= 4:
            out.append(Region(text, list(chain)))
        chain.clear()

    for m in _DIGITS.finditer(text):
        s, e = m.span()
        while k < len(held) and held[k][1] <= s:
            k += 1
        if k < len(held) and held[k][0] < e:
            close()
            total = 0
            continue
        if chain and not _BETWEEN.fullmatch(text, chain[-1][1], s):
            close()
            total = 0
        chain.append((s, e))
        total += e - s
    close()
    return out


@lru_cache(200_000)
def _shape(s: str) -> str:
    return _DIGITS.sub(lambda m: str(len(m[0])), s)


def _side(text: str, i: int) -> str:
    if not 0 <= i < len(text):
        return "edge"
    c = text[i]
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c


def segment_features(r: Region, i: int, j: int, kind: int) -> list[str]:
    s, e = r.span(i, j)
    body = r.text[s:e]
    k = KINDS[kind]
    word = re.search(r"([A-Za-z]+)\W{0,3}$", r.text[max(0, s - 14) : s])
    out = [k, f"{k} left {_side(r.text, s - 1)}", f"{k} right {_side(r.text, e)}", f"{k} after {word[1].lower() if word else ''}"]
    if r.spelled:
        tail = re.split(r"[\W_]+", body)[-1].lower()
        return out + [f"{k} sign {'@' in body}", f"{k} bracket {'[' in body or '(' in body}", f"{k} words {'dot' in body.lower()}", f"{k} tail {tail if len(tail) < 5 else len(tail)}", f"{k} digit {bool(_DIGITS.search(body))}"]
    if kind == SECRET:
        classes = "".join(c for c, p in (("a", "[a-z]"), ("A", "[A-Z]"), ("0", "[0-9]"), ("-", "[_-]")) if re.search(p, body))
        switches = len(re.findall("(?<=[A-Za-z])[0-9]|(?<=[0-9])[A-Za-z]", body))
        share = len(_only_digits(body)) * 5 // len(body)
        hexes = bool(re.fullmatch("[0-9a-f]+", body))
        begin = re.match("[A-Za-z]*", body)[0]
        return out + [
            f"secret classes {classes}", f"secret hex {hexes}", f"secret length {min(len(body) // 4, 12)}", f"secret begin {begin if len(begin) < 5 else len(begin)}", f"secret begin {begin[:4]}",
            f"secret switches {min(9, switches)}", f"secret switches {min(9, switches * 20 // len(body))} a length", f"secret share {share}", f"secret groups {j - i} {classes}", f"secret hex {hexes} {len(body) // 4}"]
    digits = _only_digits(body)
    seps = "".join(sorted(set(re.findall(r"[^0-9]", body))))
    out += [f"{k} digits {len(digits)}", f"{k} shape {_shape(body)}", f"{k} separators {seps}", f"{k} groups {j - i}", f"{k} sign {body[0]}" if body[0] in "+(" else f"{k} no sign"]
    if kind == 1:
        parts = body.split(".")
        out.append(f"ip parts {len(parts) == 4 and all(p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)}")
    elif kind == 2:
        good = luhn(digits)
        out += [f"card luhn {good}", f"card luhn {good} digits {len(digits)}", f"card luhn {good} separators {seps}", f"card first {digits[0]} {good}"]
    else:
        out += [f"phone balanced {body.count('(') == body.count(')')}", f"phone digits {len(digits)} sign {body[0] if body[0] in '+(' else ''}"]
    return out


def none_features(r: Region, i: int) -> list[str]:
    s, e = r.atoms[i]
    return ["none", f"none digits {e - s}" if r.what == "digits" else f"none {r.what} {min(e - s, 20) // 4}", f"none before {_side(r.text, s - 1)}", f"none after {_side(r.text, e)}"]


NONE, BEGIN = len(KINDS), len(KINDS) + 1


class Crf:
    def __init__(self, weights: dict[str, float]):
        self.w = weights

    def lattice(self, r: Region) -> list[list[tuple[int, int, float, list[str]]]]:
        """For each atom the segments that begin there: (end, label, score, features)."""
        get, out = self.w.get, []
        for i in range(len(r.atoms)):
            row = [(i + 1, NONE, f) for f in (none_features(r, i),)]
            row += [(j, kind, segment_features(r, i, j, kind)) for j, kind in r.candidates(i)]
            out.append([(j, y, sum(get(x, 0.0) for x in f), f) for j, y, f in row])
        return out

    def step(self, a: int, b: int) -> float:
        return self.w.get(f"{a}>{b}", 0.0)

    def decode(self, r: Region) -> list[tuple[int, int, int]]:
        """Best segmentation: (first atom, end atom, kind) of its entities."""
        lat, n = self.lattice(r), len(r.atoms)
        best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(n + 1)]
        best[0][BEGIN] = (0.0, -1, -1)
        for i in range(n):
            for j, y, s, _ in lat[i]:
                for p, (v, _, _) in best[i].items():
                    score = v + s + self.step(p, y)
                    if y not in best[j] or score > best[j][y][0]:
                        best[j][y] = (score, i, p)
        out, at = [], n
        y = max(best[n], key=lambda k: best[n][k][0])
        while at:
            _, i, p = best[at][y]
            if y != NONE:
                out.append((i, at, y))
            at, y = i, p
        return out[::-1]

    def gradient(self, r: Region, gold: dict[tuple[int, int], int]) -> dict[str, float]:
        """Features of the gold segmentation less their expectation."""
        lat, n = self.lattice(r), len(r.atoms)
        add = lambda a, b: a if b == -math.inf else b if a == -math.inf else max(a, b) + math.log1p(math.exp(-abs(a - b)))
        fwd: list[dict[int, float]] = [{} for _ in range(n + 1)]
        fwd[0][BEGIN] = 0.0
        for i in range(n):
            for j, y, s, _ in lat[i]:
                for p, v in fwd[i].items():
                    fwd[j][y] = add(fwd[j].get(y, -math.inf), v + s + self.step(p, y))
        z = -math.inf
        for v in fwd[n].values():
            z = add(z, v)
        back: list[dict[int, float]] = [{} for _ in range(n + 1)]
        back[n] = dict.fromkeys(fwd[n], 0.0)
        g: dict[str, float] = defaultdict(float)
        for i in range(n - 1, -1, -1):
            for p in fwd[i]:
                for j, y, s, f in lat[i]:
                    t = s + self.step(p, y) + back[j][y]
                    back[i][p] = add(back[i].get(p, -math.inf), t)
                    q = math.exp(fwd[i][p] + t - z)
                    if q > 1e-9:
                        for x in f:
                            g[x] -= q
                        g[f"{p}>{y}"] -= q
        at, p, inside = 0, BEGIN, {i: (j, y) for (i, j), y in gold.items()}
        while at < n:
            j, y = inside.get(at, (at + 1, NONE))
            f = next((f for e, k, _, f in lat[at] if (e, k) == (j, y)), None)
            if f is None:  # no candidate: taken as none
                j, y, f = at + 1, NONE, lat[at][0][3]
            for x in f:
                g[x] += 1
            g[f"{p}>{y}"] += 1
            at, p = j, y
        return g


def _number(rng: random.Random, n: int) -> str:
    return str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))


def _card(rng: random.Random) -> str:
    body = rng.choice("3456") + "".join(str(rng.randint(0, 9)) for _ in range(rng.choice((14, 14, 14, 14, 15, 17))))
    d = body + next(c for c in "0123456789" if luhn(body + c))
    return d if len(d) != 16 or rng.random() < 0.6 else rng.choice((" ", "-", ".")).join(d[i : i + 4] for i in range(0, 16, 4))


def _phone(rng: random.Random) -> str:
    a, b, c = _number(rng, 3), _number(rng, 3), _number(rng, 4)
    cc = rng.choice(("1", "1", "44", "49", "33", "34", "7"))
    return rng.choice((f"+{cc} ({a}) {b}-{c}", f"+{cc} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"{a}-{b}-{c}", f"+{cc}{a}{b}{c}", f"+{cc}.{a}.{b}.{c}"))


def _ip(rng: random.Random) -> str:
    return ".".join(str(rng.randint(1, 255)) for _ in range(4))


def _word(rng: random.Random) -> str:
    return "".join(rng.choice(("an", "th", "er", "on", "sh", "le", "ti", "ou", "re", "in")) for _ in range(rng.randint(1, 4)))


def _spelled(rng: random.Random) -> str:
    at, dot = rng.choice(((" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", ".")))
    return _word(rng) + rng.choice(("", ".12", "7")) + at + rng.choice(("mail", "post", _word(rng))) + dot + rng.choice(("com", "org", "net", "de"))


_HEX, _CAPS = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_MIXED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def _secret(rng: random.Random) -> tuple[str, str, str]:
    """A secret with what stands before and after it."""
    some = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    while True:
        body = rng.choice((
            lambda: "AKIA" + some(_CAPS, 16), lambda: "AKIA" + some(_CAPS, 16), lambda: some(_HEX, rng.choice((16, 18, 20, 24))), lambda: some(_HEX, rng.choice((32, 40, 64))), lambda: some(_HEX, 40),
            lambda: "ghp_" + some(_MIXED, 36), lambda: "sk-" + some(_MIXED, 40), lambda: some(_MIXED, rng.choice((20, 32, 40)))))()
        if _OPAQUE.fullmatch(body):
            break
    before = rng.choice(("", "", "key ", "password=", "password=", 'token = "', 'token = "', "secret: ", "api_key='"))
    return before, body, before[-1] if before.endswith(('"', "'")) else ""


def _identifier(rng: random.Random) -> str:
    """A long word with letters and digits that is no secret."""
    w, n = (lambda: _word(rng) + _word(rng)), (lambda: str(rng.randint(1, 2030)))
    return rng.choice(((w() + w() + w() + w()).upper(), f"{w()}{w()}{n()}", f"{w()}-{w()}-{n()}", f"{w()}_{w()}_{n()}", f"ISO-{rng.randint(1000, 99999)}-{w()}", f"{w()}-{n()}-{w()}", f"x86_64-{w()}-gnu", f"{n()}-{n()}-{w()}{w()}", f"{w().upper()}-{rng.randint(100, 99999)}{w()}"))


def _noise(rng: random.Random) -> str:
    bad = _number(rng, 16)
    while luhn(bad):
        bad = _number(rng, 16)
    return rng.choice((
        f"{rng.randint(1, 9)}.0.", f"{rng.randint(1900, 2030)}", f"{rng.randint(1, 12)}/{rng.randint(1, 28)}/{rng.randint(1990, 2030)}", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
        bad, _number(rng, rng.choice((5, 6, 7, 8, 9, 10, 12, 13, 20, 24))), f"{rng.randint(1, 999)},{_number(rng, 3)}.{_number(rng, 2)}", f"{rng.randint(300, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 999)}.{rng.randint(0, 99)}",
        f"{rng.randint(1, 5)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}", f"pages {rng.randint(1, 99)}-{rng.randint(100, 999)}", " ".join(str(rng.randint(0, 99)) for _ in range(rng.randint(4, 9))),
        f"{rng.randint(1990, 2030)} {rng.randint(1990, 2030)} {rng.randint(1, 99)}", _identifier(rng), _identifier(rng), _identifier(rng), "met at noon dot com was new", f"{_word(rng)} at {_word(rng)} dot {_word(rng)}"))


def examples(n: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Generated texts with their spans, some right beside another."""
    rng, out = random.Random(seed), []
    make = {"ip": _ip, "card": _card, "phone": _phone, "email": _spelled}
    for _ in range(n):
        text, spans = _word(rng), []
        for _ in range(rng.randint(1, 4)):
            if rng.random() < 0.55:
                text += " " + " ".join(_word(rng) for _ in range(rng.randint(1, 4)))
            if rng.random() < 0.15:
                text += rng.choice((" tel:", " phone", " call", " card", " card no.", " ip", " mail"))
            text += " "
            if rng.random() < 0.65:
                kind = rng.choices([*make, "secret"], (2, 4, 5, 1.5, 3))[0]
                before, body, after = _secret(rng) if kind == "secret" else ("", make[kind](rng), "")
                text += before
                spans.append((kind, len(text), len(text) + len(body)))
                text += body + after
            else:
                text += _noise(rng)
        out.append((text + rng.choice((".", " ", " " + _word(rng))), spans))
    return out


@lru_cache(1)
def learn(seed: int = SEED) -> dict[str, float]:
    """Weights of the model, from generated examples."""
    data = []
    for text, spans in examples(seed=seed):
        of = {(s, e): KINDS.index(k) for k, s, e in spans}
        for r in regions(text, []):
            gold = {}
            for i in range(len(r.atoms)):
                for j, k in r.candidates(i):
                    if of.get(r.span(i, j)) == k:
                        gold[i, j] = k
            data.append((r, gold))
    w: dict[str, float] = {}
    square: dict[str, float] = defaultdict(lambda: 1e-6)
    crf, rng = Crf(w), random.Random(seed)
    for _ in range(EPOCHS):
        rng.shuffle(data)
        for r, gold in data:
            for x, d in crf.gradient(r, gold).items():
                d -= DECAY * w.get(x, 0.0)
                square[x] += d * d
                w[x] = w.get(x, 0.0) + RATE * d / math.sqrt(square[x])
    return {x: v for x, v in w.items() if abs(v) > 1e-4}


def all_spans(text: str, crf: Crf) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans, and all spans, both by kind, then start."""
    base = base_spans(text)
    more = []
    for r in regions(text, base):
        more += [(KINDS[y], *r.span(i, j)) for i, j, y in crf.decode(r)]
    order = lambda x: (KINDS.index(x[0]), x[1])
    return base, sorted(base + more, key=order) if more else base


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _find(weights):
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_added", pa.int64()), ("n_secret", pa.int64())])

    def run(batches):
        crf = Crf(weights.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part, rows = b.slice(at, 1000), []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    base, every = all_spans(text or "", crf)
                    n = [sum(k == x[0] for x in base) for k in BASE]
                    rows.append((doc, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every), len(every) - len(base), sum(x[0] == "secret" for x in every)))
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def find(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_added (by the model),
    n_secret (of those, secrets)."""
    weights = spark.sparkContext.broadcast(learn())
    out = "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string, n_added long, n_secret long"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_find(weights), out)
