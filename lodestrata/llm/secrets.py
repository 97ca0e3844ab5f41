"""Secret scans: fixed rules, and probabilistic automata inferred from labelled credentials (ALERGIA).

A prefix tree of labelled strings is merged state by state where the outcome frequencies of two
states agree within Hoeffding bounds (Carrasco and Oncina, 1994). One automaton is inferred for
each labelled format and one for ordinary strings; every candidate run of a text is scored by
the log-likelihood per character of the best format against the ordinary one.
"""

from __future__ import annotations

import math
import random
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, runs

# The base rules' patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = ("assign", "access", "hex")

#: Candidates: runs of at least 16 of these characters that hold a digit and a letter.
RUN = re.compile(r"[A-Za-z0-9_+/=-]{16,}")
#: Nats per character by which a format must be likelier than ordinary strings.
MARGIN = 0.35
_FLOOR = 1e-4
_HEXMAP = bytes(120 if 48 <= c <= 57 or 97 <= c <= 102 else 32 for c in range(256))
_CLASS = {c: k for k, chars in (("0", "0123456789"), ("f", "abcdef"), ("z", "ghijklmnopqrstuvwxyz"), ("A", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")) for c in chars}
#: Literal characters are seen up to this position, classes after it, so that fixed prefixes count.
_LITERAL = 5


def symbols(s: str) -> list[str]:
    return [c if i < _LITERAL and c in "AKIghposxbklveyJz_-" else _CLASS.get(c, c) for i, c in enumerate(s)] + ["$"]


# Words that ordinary identifiers, slugs and paths are made of.
WORDS = (
    "about account action admin album archive article assets author backup blog build cache category chapter client code comment config contact content "
    "data default design detail docs download draft editor entry error event example export feature field file filter forum game group guide handler help "
    "history home html image import index info input item label language layout library link list local login long main manager map media member menu message "
    "model module music name news note number object order output page part path photo player plugin post price product profile project public query question "
    "record report request result review sample schedule school script search section server service session setting short site some source spring start state "
    "static status stock story street string style subject summary support system table target task team template test text thread title topic train travel "
    "update upload user value version video view weather week window winter word work world write year"
).split()


def labelled_credentials(seed: int = 7, each: int = 120) -> list[tuple[str, str]]:
    """(label, string) in the documented shapes of well-known credentials, and of ordinary strings."""
    rng = random.Random(seed)
    up, low, dig, hexa = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
    run = lambda chars, a, b=None: "".join(rng.choice(chars) for _ in range(rng.randint(a, b or a)))
    plain = lambda: rng.choice(WORDS) if rng.random() < 0.6 else "".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(2, 4)))
    word = lambda: plain().capitalize() if rng.random() < 0.3 else plain()
    shapes = {
        "cloud_key": lambda: "AKIA" + run(up + "234567", 16),
        "hex_key": lambda: run(hexa, rng.choice([32, 40, 64])),
        "forge_token": lambda: rng.choice(["ghp_", "gho_", "ghs_"]) + run(up + low + dig, 36),
        "chat_token": lambda: rng.choice(["xoxb-", "xoxp-"]) + run(dig, 10, 12) + "-" + run(dig, 10, 12) + "-" + run(up + low + dig, 24),
        "pay_key": lambda: rng.choice(["sk_live_", "rk_live_"]) + run(up + low + dig, 24),
        "web_token": lambda: "eyJ" + run(up + low + dig + "-_", 60, 120),
        "long_secret": lambda: run(up + low + dig + "+/", 40),
        "": lambda: rng.choice([
            lambda: "-".join(word() for _ in range(rng.randint(3, 6))) + rng.choice(["", "-" + run(dig, 1, 4)]),
            lambda: "_".join(word() for _ in range(rng.randint(3, 6))) + rng.choice(["", run(dig, 1, 3)]),
            lambda: "/".join(word() for _ in range(rng.randint(2, 6))) + rng.choice(["", "/" + run(dig, 1, 6), "-" + run(dig, 1, 4)]),
            lambda: "/".join(rng.choice("abcdt") if rng.random() < 0.2 else word() for _ in range(rng.randint(3, 6))) + "/" + run(dig, 1, 8),
            lambda: "/".join("-".join(word() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 4))) + "/" + run(dig, 4) + "/" + run(dig, 2),
            lambda: rng.choice("/-_").join(rng.choice([word, word, word, lambda: run(dig, 1, 4), lambda: word() + run(dig, 1, 2)])() for _ in range(rng.randint(3, 6))),
            lambda: "/".join(rng.choice("-_").join(word() + rng.choice(["", "", run(dig, 1, 2)]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 5))),
            lambda: "=".join(rng.choice([word(), run(dig, 1, 5)]) for _ in range(rng.randint(2, 5))),
            lambda: "-".join(run(hexa, n) for n in (8, 4, 4, 4, 12)),
            lambda: run(dig, 4) + "-" + run(dig, 2) + "-" + run(dig, 2) + "T" + run(dig, 6) + "Z",
            lambda: "".join(word() for _ in range(rng.randint(3, 6))) + run(dig, 1, 4),
            lambda: run(dig, 16, 24),
            lambda: "=" * rng.randint(8, 40) + run(dig, 0, 2) + "-" * rng.randint(8, 40),
        ])(),
    }
    return [(label, make()) for label, make in shapes.items() for _ in range(each * (8 if not label else 1))]


class Automaton:
    """A probabilistic deterministic automaton inferred by ALERGIA from symbol sequences."""

    def __init__(self, strings: list[list[str]], alpha: float = 0.05):
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for s in strings:
            at = 0
            for c in s:
                self.count[at][c] = self.count[at].get(c, 0) + 1
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                at = self.next[at][c]
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge()
        self.logp = [{c: math.log(k / sum(row.values())) for c, k in row.items()} for row in self.count]

    def _differ(self, a: int, b: int) -> bool:
        """Whether the outcome frequencies of two states, or of states they lead to, differ beyond the bound."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = sum(self.count[a].values()), sum(self.count[b].values())
            if not na or not nb:
                continue
            limit = self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))
            for c in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(c, 0) / na - self.count[b].get(c, 0) / nb) > limit:
                    return True
                if c in self.next[a] and c in self.next[b]:
                    todo.append((self.next[a][c], self.next[b][c]))
        return False

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            for c, k in self.count[b].items():
                self.count[a][c] = self.count[a].get(c, 0) + k
            for c, to in self.next[b].items():
                if c in self.next[a]:
                    todo.append((self.next[a][c], to))
                else:
                    self.next[a][c] = to

    def _merge(self) -> None:
        red, rank = [0], {0}
        while True:
            blue = next(((r, c, to) for r in red for c, to in sorted(self.next[r].items()) if to not in rank), None)
            if blue is None:
                return
            r, c, to = blue
            for known in red:
                if not self._differ(known, to):
                    self.next[r][c] = known
                    self._fold(known, to)
                    break
            else:
                red.append(to)
                rank.add(to)

    def score(self, s: list[str]) -> float:
        """Log-likelihood per symbol; what the automaton has not seen counts as a small probability."""
        at, total = 0, 0.0
        for c in s:
            total += self.logp[at].get(c, math.log(_FLOOR)) if at is not None else math.log(_FLOOR)
            at = self.next[at].get(c) if at is not None else None
        return total / len(s)


    def tails(self, s: str, starts: list[int]) -> list[float]:
        """``score(symbols(s[i:]))`` for each start; walks that meet in a state share the rest, so many starts stay near one pass."""
        rest, n, known, out = [_CLASS.get(c, c) for c in s] + ["$"], len(s) + 1, {}, []
        for i in starts:
            head, at, j, path = symbols(s[i : i + _LITERAL])[:-1], 0, i, []
            while j < n and at is not None and not (j - i >= _LITERAL and (j, at) in known):
                c = head[j - i] if j - i < len(head) else rest[j]
                path.append((j, at, self.logp[at].get(c, math.log(_FLOOR))))
                at, j = self.next[at].get(c), j + 1
            total = 0.0 if j == n else (n - j) * math.log(_FLOOR) if at is None else known[j, at]
            for k, state, p in reversed(path):
                total += p
                if k - i >= _LITERAL:
                    known[k, state] = total
            out.append(total / (n - i))
        return out


def infer(labelled: list[tuple[str, str]]) -> dict[str, Automaton]:
    """One automaton per label; the label '' marks ordinary strings."""
    groups: dict[str, list] = {}
    for label, s in labelled:
        groups.setdefault(label, []).append(symbols(s))
    return {k: Automaton(v) for k, v in sorted(groups.items())}


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base rules, each kind leftmost without overlaps, failing matches dropped."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * 32 in text.encode("utf-8", "surrogatepass").translate(_HEXMAP):
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 32]
    return out


def _parts(s: str) -> list[tuple[int, int]]:
    """The whole run, then what follows each '=' or '/', up to the run's end and up to the next of them; the longest first."""
    marks = [i for i, c in enumerate(s) if c in "=/"]
    ends = {(i, j) for i, j in zip([0, *(i + 1 for i in marks)], [*marks, len(s)], strict=True)} | {(i + 1, len(s)) for i in marks} | {(0, len(s))}
    digit, letter = (max((i for i, c in enumerate(s) if f(c)), default=-1) for f in (str.isdigit, str.isalpha))
    fits = lambda i, j: j - i >= 16 and (digit >= i and letter >= i if j == len(s) else bool(re.search("[0-9]", s[i:j]) and re.search("[A-Za-z]", s[i:j])))
    return sorted((p for p in ends if fits(*p)), key=lambda p: (p[0] - p[1], p))


def inferred_spans(text: str, automata: dict[str, Automaton]) -> list[tuple[int, int, str]]:
    """Candidate runs, or else their longest part after a '=' or '/', that a credential format explains better than ordinary strings do."""
    out, ordinary = [], automata.get("")
    if not any(d in text for d in "0123456789"):
        return out
    for m in RUN.finditer(text):
        s = m[0].strip("=-")
        if len(s) < 16 or s.isalpha() or not re.search("[0-9]", s) or not re.search("[A-Za-z]", s):
            continue
        start = m.start() + m[0].index(s)
        parts = _parts(s)
        tails = {k: iter(a.tails(s, [i for i, j in parts if j == len(s)])) for k, a in automata.items()}
        for i, j in parts:
            x = symbols(s[i:j]) if j < len(s) else None
            score = {k: a.score(x) if x else next(tails[k]) for k, a in automata.items()}
            usual = score.pop("", math.log(_FLOOR))
            label, best = max(score.items(), key=lambda t: t[1], default=("", -math.inf))
            if best - usual >= MARGIN:
                out.append((start + i, start + j, label))
                break
    return out


def spans_of(text: str | None, automata: dict[str, Automaton]) -> list[tuple[int, int, str]]:
    """Base spans, and inferred ones but those that lie within a base span and so tell nothing new."""
    base = base_spans(text) if text else []
    return base + [s for s in inferred_spans(text, automata) if not any(a <= s[0] and s[1] <= b for a, b, _ in base)] if text else []


def scan(df: DataFrame, automata: dict[str, Automaton], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<start, end, kind>>), one row per row.

    Spans are in code points, the end exclusive, ordered by start, then base kinds as listed,
    then inferred labels (of equally likely ones, the first by name); inferred spans within a base
    span are left out. A null or empty text has none; repeated rows and null ids stay; an
    empty table gives no rows; other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(automata)
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        order = {k: i for i, k in enumerate([*BASE, *sorted(shared.value)])}

        def one(t):
            found = spans_of(t, shared.value)
            return [{"start": a, "end": b, "kind": k} for a, b, k in sorted(found, key=lambda s: (s[0], order[s[2]], s[1]))]

        def run(keys, texts):
            return {id_col: keys[0], "spans": list(map(one, texts))}

        return run

    return map_texts(df, [F.col(id_col)], text_col, make, f"`{id_col}` {kind}, spans array<struct<start:long,end:long,kind:string>>")


def redact(df: DataFrame, automata: dict[str, Automaton], text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, each secret span of the text replaced by ``mark``; null stays null."""
    shared = df.sparkSession.sparkContext.broadcast(automata)

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        def one(t):
            if not t:
                return t
            out, done = [], 0
            for a, b, _ in sorted(spans_of(t, shared.value)):
                if a >= done:
                    out += [t[done:a], mark]
                done = max(done, b)
            return "".join(out) + t[done:] if done else t

        return pa.chunked_array([pa.array([one(t) for t in texts.slice(a, n).to_pylist()], pa.string()) for a, n in runs(texts)], pa.string()).combine_chunks()

    return df.withColumn(text_col, clean(F.col(text_col)))
