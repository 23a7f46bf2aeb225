"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the places where personal data can be: at-signs, schemes,
plus signs, digits, and cues that announce an identifier (names of accounts and credentials,
prefixes of well-known keys). From each anchor a deterministic local parser expands to the
left and right, within the run of characters that its kind allows, and validates what it
found. Every parser's work is linear in the text: a run is looked at once per kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import documents, map_arrow

#: Kinds in the order of ties; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "url", "secret", "key", "account")
BASE = 4

#: Names of credentials; what is assigned to one is a secret if it is 8 characters or more with a digit.
CREDENTIALS = (
    "token", "password", "passwd", "pwd", "secret", "credential", "api_key", "api-key", "apikey", "access_key", "access-key",
    "private_key", "private-key",
)
#: Words before account and document numbers.
ACCOUNTS = ("account", "acct", "konto", "compte", "cuenta", "passport", "ssn")
#: Public prefixes of keys, and what follows them.
KEYS = {
    "AKIA": "[0-9A-Z]{16}", "AIza": "[0-9A-Za-z_-]{35}", "ghp_": "[A-Za-z0-9]{36}", "gho_": "[A-Za-z0-9]{36}", "ghs_": "[A-Za-z0-9]{36}",
    "glpat-": "[0-9A-Za-z_-]{20}", "npm_": "[A-Za-z0-9]{36}", "sk_live_": "[0-9A-Za-z]{16,64}", "xoxb-": "[0-9A-Za-z-]{10,80}",
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP_RUN = re.compile(r"[0-9.]+")
_CARD_RUN, _CARD = re.compile(r"[\x20\-0-9]+"), re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_SECRET = re.compile(r"""["']?[\x20\t]{0,3}[:=][\x20\t]{0,3}["']?([A-Za-z0-9+/_.~-]{8,}={0,2})""")
_ACCOUNT = re.compile(r"(?i:\x20?(?:number|no\.?|nr\.?|\x23))?\x20?[:=\x23]?\x20?([0-9](?:[\x20-]?[0-9]){5,23})(?![A-Za-z0-9])")
_KEY_OF = {cue: re.compile(re.escape(cue) + rest + "(?![A-Za-z0-9])") for cue, rest in KEYS.items()}
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
#: Characters of an IBAN by its country.
_IBAN_LENGTHS = {
    country: int(length)
    for length, countries in (x.split(":") for x in (
        "15:NO 16:BE 18:DK,FI,FO,GL,NL 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
        "23:AE,GI,IL,IQ,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:FR,GR,IT,MC,MR,SM "
        "28:AL,AZ,BY,CY,DO,GT,HU,LB,PL,SV 29:BR,EG,PS,QA,UA 30:JO,KW,MU 31:MT,SC 32:LC"
    ).split())
    for country in countries.split(",")
}
_IBAN_OF = {n: re.compile(rf"[A-Z]{{2}}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Za-z0-9])") for n in set(_IBAN_LENGTHS.values())}
_URL = re.compile(r"://[^\x00-\x20\"'<>()\[\]{}|\\^`]+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME_CHARS = _NAME - frozenset("_%")

_DIGIT = re.compile("[0-9]")
_LETTERS = {65 + i: str(10 + i) for i in range(26)}  # the check number's values of A-Z
_LOWER = {c: c + 32 for c in range(65, 91)}  # A-Z only, so that positions stay

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    """Whether the digits pass the check of payment cards."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int(moved.translate(_LETTERS)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


class Finder:
    """Spans of one text after another."""

    def __init__(self) -> None:
        import ahocorasick

        self.anchors = ahocorasick.Automaton()
        for cue, kind in [("@", "@"), ("://", ":"), ("+", "+"), *((d, "0") for d in "0123456789")]:
            self.anchors.add_word(cue, (kind, len(cue)))
        for cues, kind in ((CREDENTIALS, "secret"), (ACCOUNTS, "account"), (KEYS, "key")):
            for cue in cues:
                self.anchors.add_word(cue.translate(_LOWER), (kind, len(cue)))
        self.anchors.make_automaton()

    def spans(self, text: str) -> list[Span]:
        """All spans by start, then kind; positions in code points, ends exclusive."""
        found: list[Span] = []
        email_end = phone_end = url_end = ip_run = card_run = iban_end = 0
        cued = {"secret": 0, "account": 0, "key": 0}
        for last, (kind, width) in self.anchors.iter(text.translate(_LOWER)):
            at = last - width + 1
            if kind == "0":
                if at >= ip_run:
                    ip_run = _IP_RUN.match(text, at).end()
                    found += self._ips(text, at, ip_run)
                if at >= card_run:
                    card_run = _CARD_RUN.match(text, at).end()
                    found += self._cards(text, at, card_run)
                if at >= max(iban_end, 2) and "A" <= text[at - 1] <= "Z" and (m := self._iban(text, at)):
                    found.append(m)
                    iban_end = m[2]
            elif kind == "@":
                start = at
                while start > email_end and text[start - 1] in _NAME:
                    start -= 1
                if start < at and (m := _DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    found.append(("email", start, email_end))
            elif kind == "+":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 9 <= len(_digits(m[0])) <= 15:
                        found.append(("phone", at, phone_end))
            elif kind in cued:
                if at >= cued[kind] and not (at and text[at - 1].isalnum()) and (m := self._cued(kind, text, at, last + 1)):
                    found.append(m)
                    cued[kind] = m[2]
            elif at >= url_end and (m := _URL.match(text, at)):
                start = at
                while start > url_end and text[start - 1] in _SCHEME_CHARS:
                    start -= 1
                if start < at:
                    url_end = at + len(m[0].rstrip(".,;:!?"))
                    found.append(("url", start, url_end))
        return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))

    @staticmethod
    def _ips(text: str, start: int, end: int) -> list[Span]:
        """Four numbers between dots, from the left; a number belongs to one address at most."""
        found, parts, at, i = [], text[start:end].split("."), start, 0
        while i + 3 < len(parts):
            four = parts[i : i + 4]
            if all(four):
                stop = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                    found.append(("ip", at, stop))
                at, i = stop + 1, i + 4
            else:
                at, i = at + len(parts[i]) + 1, i + 1
        return found

    @staticmethod
    def _cards(text: str, start: int, end: int) -> list[Span]:
        runs = ((m, _digits(m[0])) for m in _CARD.finditer(text, start, end))
        return [("card", *m.span()) for m, d in runs if 12 <= len(d) <= 19 and luhn(d)]

    @staticmethod
    def _cued(kind: str, text: str, at: int, end: int) -> Span | None:
        """The identifier that a cue at ``at`` to ``end`` announces."""
        if kind == "key":
            m = next((m for p in _KEY_OF.values() if (m := p.match(text, at))), None)
            return (kind, at, m.end()) if m else None
        m = (_SECRET if kind == "secret" else _ACCOUNT).match(text, end)
        if m is None:
            return None
        value = m[1].rstrip(".")
        if kind == "secret" and (len(value) < 8 or not _DIGIT.search(value)):
            return None
        return (kind, m.start(1), m.start(1) + len(value))

    @staticmethod
    def _iban(text: str, at: int) -> Span | None:
        if not ("A" <= text[at - 1] <= "Z" and "A" <= text[at - 2] <= "Z") or (at > 2 and text[at - 3].isalnum()):
            return None
        length = _IBAN_LENGTHS.get(text[at - 2 : at])
        m = (_IBAN_OF[length] if length else _IBAN).match(text, at - 2)
        if m is None:
            return None
        if length:
            return ("iban", at - 2, m.end()) if _mod97(m[0].replace(" ", "")) else None
        # Without a known length: the longest end at the edge of a word where the check number holds.
        groups = m[0].split(" ")
        for n in range(len(groups), 0, -1):
            bare = "".join(groups[:n])
            if len(bare) < 15:
                break
            if _mod97(bare):
                return ("iban", at - 2, at - 2 + len(bare) + n - 1)
        return None


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str, spans: list[Span]) -> str:
    """The text with each span (overlapping ones merged) replaced by its kind in brackets."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: bool = True) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, masked_text.

    Spans are ``kind:start:end`` by start, then kind. Base kinds are e-mail and IP addresses,
    cards and phones; the method adds IBANs of a right check number, URLs, values of
    credentials (:data:`CREDENTIALS`), keys by their prefix (:data:`KEYS`) and numbers behind
    words for accounts and documents (:data:`ACCOUNTS`). ``masked_text`` is null for texts
    without spans, and left out if ``mask`` is false.

    Defined cases: null and empty texts have no spans, and the hash is of the empty string.
    Repeated rows are searched each by itself; a null doc_id passes through. An empty table
    gives no rows. Other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder()
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py()
                spans = finder.spans(text)
                base = [s for s in spans if s[0] in KINDS[:BASE]]
                counts = [sum(s[0] == k for s in base) for k in KINDS[:BASE]]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*counts, digest, joined(spans), masked(text, spans) if mask and spans else None))
            names = [*(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", *["masked_text"] * mask]
            kinds = [pa.int64()] * BASE + [pa.string()] * (len(names) - BASE)
            arrays = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", *names])

    base = documents(docs, id_col, text_col)
    counts = ", ".join(f"n_{k} bigint" for k in KINDS[:BASE])
    kind = base.schema["doc_id"].dataType.simpleString()
    return map_arrow(base, run, f"doc_id {kind}, {counts}, base_sha256 string, spans string" + ", masked_text string" * mask)
