"""URL filters: all glob rules at once by a bit-parallel automaton over canonical URLs.

The literals of every rule are packed one after another into 64-bit words; a step shifts the
state by one bit across words, masks it by the character, and keeps the bits at which a star
loops. Steps are vectorised over the URLs of a batch, longest first.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

# Rules by host and path.
SITE_RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
# Words that stand at the beginning of a word of a host label or path segment, with categories.
JUNK_WORDS = (
    ("adult", "adult-"), ("adult", "porn"), ("adult", "escort"), ("adult", "sex-chat"),
    ("gambling", "casino"), ("gambling", "free-bets"), ("gambling", "online-poker"), ("gambling", "sports-betting"), ("gambling", "jackpot"),
    ("pharma", "cheap-pills"), ("pharma", "viagra"), ("pharma", "cialis"), ("pharma", "online-pharmacy"),
    ("spam", "spam-farm"), ("spam", "payday-loan"), ("spam", "link-farm"), ("spam", "free-followers"), ("spam", "replica-watch"), ("ads", "ads-track"),
)
# Globs over the whole canonical URL, with categories.
PLACE_GLOBS = (
    ("adult", "*/nsfw/*"), ("ads", "ads.*"), ("ads", "adserver.*"), ("ads", "*/adclick*"), ("ads", "*.doubleclick.*"),
    ("download", "*.exe"), ("download", "*.msi"), ("download", "*.apk"), ("download", "*.iso"), ("download", "*/warez/*"), ("download", "*/keygen*"),
    ("page", "*/wp-login.php*"), ("page", "*/wp-admin*"), ("page", "*/cgi-bin/*"), ("page", "*/signin"), ("page", "*/cart/checkout*"),
)
#: What a word may stand behind: the beginning of the host, a label, a segment, or a part of one.
WORD_EDGES = ("", "*.", "*/", "*-", "*_")
JUNK_GLOBS = tuple((category, f"{edge}{word}*") for category, word in JUNK_WORDS for edge in WORD_EDGES) + PLACE_GLOBS
#: Stands between host and path in the canonical form; no character has this code.
EDGE = 0x110000


def parts(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def canonical(host: str, path: str) -> str:
    """Host without user, port and last dot, then the path, A-Z lower-cased: escapes of printable ASCII
    read, empty and '.' segments dropped, '..' segments resolved; no slash at the end."""
    host = re.sub(r":[0-9]*$", "", host.rpartition("@")[2]).rstrip(".")
    path = re.sub("[A-Z]", lambda c: c[0].lower(), path)
    path = re.sub("%(2[1-9a-f]|[3-6][0-9a-f]|7[0-9a-e])", lambda m: re.sub("[A-Z]", lambda c: c[0].lower(), chr(int(m[1], 16))), path)
    kept: list[str] = []
    for s in path.split("/"):
        if s == "..":
            kept[-1:] = []
        elif s not in ("", "."):
            kept.append(s)
    return "/".join([host, *kept])


def read_globs(spark, path: str, most: int = 100_000) -> tuple[tuple[str, str], ...]:
    """Rules (category, glob) from text lines ``category glob``; blank lines and lines that begin with # are none.

    The list is broadcast, so one of more than ``most`` rules raises ValueError.
    """
    line = F.trim("value")
    rows = spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.split(line, r"\s+", 2).alias("r")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rules")
    return tuple((r[0][0], r[0][1]) for r in rows if len(r[0]) == 2)


class Globs:
    """An anchored automaton for sequences of codes, ``*`` (any run) and ``?`` (any one)."""

    def __init__(self, globs: list[list]):
        self.n = len(globs)
        bits = sum(sum(c != "*" for c in g) + 1 for g in globs)
        self.words = max(1, -(-bits // 64))
        zero = lambda: np.zeros(self.words, np.uint64)
        self.start, self.loop, any_, self.ends, masks = zero(), zero(), zero(), [], {}
        bit = 0

        def put(x, b):
            x[b >> 6] |= np.uint64(1) << np.uint64(b & 63)

        for g in globs:
            put(self.start, bit)
            for c in g:
                if c == "*":
                    put(self.loop, bit)
                    continue
                bit += 1
                put(any_ if c == "?" else masks.setdefault(c, zero()), bit)
            self.ends.append(bit)
            bit += 1
        self.codes = np.array(sorted(masks), np.int64)
        self.masks = np.array([masks[c] | any_ for c in self.codes.tolist()] + [any_], np.uint64).reshape(-1, self.words)

    def match(self, urls: list[np.ndarray]) -> np.ndarray:
        """Boolean matrix (url, glob)."""
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        state = np.tile(self.start, (len(urls), 1))
        flat = np.concatenate([urls[i] for i in order]) if len(urls) else np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.codes, flat), max(len(self.codes) - 1, 0))
        rows = np.where(self.codes[at] == flat, at, len(self.codes)) if len(self.codes) else np.zeros(len(flat), np.int64)
        begin, long = np.concatenate([[0], np.cumsum(size[order])])[:-1], size[order]
        for i in range(int(size.max(initial=0))):
            live = int(np.searchsorted(-long, -i, side="left"))
            s = state[:live]
            up = s << np.uint64(1)
            up[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = (up & self.masks[rows[begin[:live] + i]]) | (s & self.loop)
        out = np.zeros((len(urls), self.n), bool)
        for k, b in enumerate(self.ends):
            out[order, k] = state[:, b >> 6] >> np.uint64(b & 63) & np.uint64(1)
        return out


def _codes(s: str) -> list:
    return [ord(c) for c in s]


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", site_rules=SITE_RULES, junk=JUNK_GLOBS) -> DataFrame:
    """(id_col, host, path, rule, verdict, category) for every row.

    A site rule fits its host and all subdomains where the path starts with the rule's; the
    longest that fits gives rule and verdict (of equally long ones, the first listed). Else the
    verdict is block where a junk glob matches the canonical URL, allow otherwise; category is
    that of the first listed glob that matches, else null. A null URL or one without
    '://' has empty host and path and is allowed. Repeated rows and null ids stay, very long
    URLs are matched whole, an empty table gives no rows, other columns are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()
    order = sorted(range(len(site_rules)), key=lambda i: -len(site_rules[i][1] + site_rules[i][2]))

    def make():
        site = Globs([["*", *_codes("." + host), EDGE, *_codes(path), "*"] for _, host, path in site_rules])
        bad = Globs([[c if c in "*?" else ord(c) for c in g] for _, g in junk])

        def run(keys, texts):
            split = list(map(parts, texts))
            hits = site.match([np.array(_codes("." + h) + [EDGE] + _codes(p), np.int64) for h, p in split])
            worse = bad.match([np.array(_codes(canonical(h, p)), np.int64) for h, p in split])
            first = [next((i for i in order if row[i]), None) for row in hits]
            what = [junk[int(row.argmax())][0] if row.any() else None for row in worse]
            return {
                id_col: keys[0],
                "host": [h for h, _ in split],
                "path": [p for _, p in split],
                "rule": [None if i is None else site_rules[i][1] + site_rules[i][2] for i in first],
                "verdict": [site_rules[i][0] if i is not None else "block" if w else "allow" for i, w in zip(first, what, strict=True)],
                "category": what,
            }

        return run

    return map_texts(df, [F.col(id_col)], url_col, make, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, category string")
