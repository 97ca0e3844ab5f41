"""Personal data: an Aho-Corasick pass finds anchors, local parsers expand and validate around them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "userinfo")
# Cues after which an account identifier may stand.
CUES = ("account", "acct", "iban", "passport", "ssn", "konto", "compte", "cuenta")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_OCTETS = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ACCOUNT = re.compile(r"(?:\x20?(?:no|number|nr)\.?)?\x20?[:#=]\x20?([A-Z]{0,2}[0-9][A-Z0-9]{5,33})(?![A-Za-z0-9])")
_USERINFO = re.compile(r"[^\s/?#@:\"'<>]+:[^\s/?#@\"'<>]+@")


def automaton():
    """Anchors: at-signs, schemes, cues, a digit that a plus precedes, and two digits with at most one mark between."""
    import ahocorasick

    a = ahocorasick.Automaton()
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for d in "0123456789":
        a.add_word("+" + d, ("plus", 2))
        for e in "0123456789":
            a.add_word(f"{d}.{e}", ("dot", 3))
            for between in ("", " ", "-"):
                a.add_word(d + between + e, ("digits", 2 + len(between)))
    for cue in CUES:
        for form in (cue, cue.capitalize(), cue.upper()):
            a.add_word(form, ("cue", len(form)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def spans_of(text: str, anchors) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points. Each base kind is what a leftmost scan without overlaps finds.

    An anchor inside what its parser has consumed is skipped, matched or failed, so each
    parser reads a character at most twice and a failing match is not retried further in.
    """
    out = []
    mail_end = chain_end = octet_end = 0
    for last, (what, size) in anchors.iter(text):
        at = last + 1 - size
        if what == "at":
            start = at
            while start > mail_end and _LOCAL.match(text, start - 1):
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((start, m.end(), "email"))
                mail_end = m.end()
            elif start < at:
                mail_end = max(mail_end, start)
        elif what == "digits":
            if at >= chain_end and (m := _CHAIN.match(text, at)):
                chain_end = m.end()
                digits = re.sub("[^0-9]", "", m[0])
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at, m.end(), "card"))
        elif what == "dot":
            if at < octet_end:
                continue
            start = at
            while start > octet_end and text[start - 1] in "0123456789":
                start -= 1
            m = _OCTETS.match(text, start)
            octet_end = m.end()
            parts, pos = m[0].split("."), start
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = pos + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in four):
                    out.append((pos, end, "ip"))
                pos = end + 1
        elif what == "plus":
            if (m := _PHONE.match(text, at)) and 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
                out.append((at, m.end(), "phone"))
        elif what == "cue":
            if (at == 0 or not text[at - 1].isalnum()) and (m := _ACCOUNT.match(text, last + 1)):
                out.append((m.start(1), m.end(1), "account"))
        elif m := _USERINFO.match(text, last + 1):
            out.append((m.start(), m.end() - 1, "userinfo"))
    order = {k: i for i, k in enumerate((*BASE, *ADDED))}
    return sorted(set(out), key=lambda s: (s[0], order[s[2]], s[1]))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans array<struct<start, end, kind>>), one row per row.

    Kinds email, ip, card and phone follow the base rules; account (an identifier after a cue
    word and a mark) and userinfo (user and password in a URL) are added. A null or empty text
    has no spans; repeated rows and null ids stay; an empty table gives no rows; other columns
    are ignored.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def make():
        anchors = automaton()

        def run(keys, texts):
            found = [spans_of(t, anchors) if t else [] for t in texts]
            return {id_col: keys[0], "spans": [[{"start": a, "end": b, "kind": k} for a, b, k in s] for s in found]}

        return run

    return map_texts(df, [F.col(id_col)], text_col, make, f"`{id_col}` {kind}, spans array<struct<start:long,end:long,kind:string>>")
