"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Kinds: email, ip, card (Luhn) and phone as the base, always returned with their scores; and
where the score reaches LEAST iban (mod 97), national_id, nir (mod 97), tax_id (mod 11, 10),
dni (mod 23), nhs (mod 11), routing (3-7-1) and imei (Luhn). Words that speak for a kind raise its score and
words that speak against personal data (an example, a version, an order) lower it, so most
of these kinds need support nearby, and a version number like an address is not redacted.

Positions are code points, the end exclusive. Every pattern is scanned in time linear in the
whole text, however long. A null or empty text has no spans. Repeated rows each get their
row, an empty table gives an empty one, and columns besides the id and the text play no part.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strata.llm.bpe import slices

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "national_id", "nir", "tax_id", "dni", "nhs", "routing", "imei")
#: Score of a confirmed span, what words nearby add or take, and from which score a span counts.
SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "national_id": 0.3, "nir": 0.6, "tax_id": 0.3, "dni": 0.3, "nhs": 0.3, "routing": 0.3, "imei": 0.3}
SUPPORT, AGAINST, LEAST, NEAR = 0.3, 0.3, 0.5, 48
NEARBY = {
    "email": "mail|e-mail|email|contact|correo|courriel|kontakt",
    "ip": "ip|address|host|server|adresse|direccion",
    "card": "card|visa|mastercard|credit|carte|karte|tarjeta",
    "phone": "phone|tel|call|mobile|telefon|telephone|fax",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "national_id": "ssn|social security|national id|identity|personal number",
    "nir": "nir|insee|sécurité sociale|securite sociale|assuré|numéro de sécu",
    "tax_id": "steuer-id|steuer-idnr|steueridentifikationsnummer|idnr|tax id|tax number",
    "dni": "dni|nif|documento|identidad",
    "nhs": "nhs|patient|health service",
    "routing": "routing|aba|rtn|bank",
    "imei": "imei|handset|device id",
}
#: Words that speak against personal data.
OTHERS = "example|sample|dummy|placeholder|test|version|release|order no|invoice no|part no|sku|isbn|beispiel|exemple|ejemplo|versión"
WORDS = {k: re.compile(rf"(?<![^\W_])(?:{v})(?![^\W_])", re.I) for k, v in (NEARBY | {"": OTHERS}).items()}

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGIT = re.compile("[0-9]")
# A number's first digit is one that no digit precedes: elsewhere in a run no match can begin that did not begin there.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*+(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: The length of an account number by country.
LENGTHS = {
    c: n
    for n, cs in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
        29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in cs.split()
}
NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")


NIR = re.compile(r"(?<![0-9])[12] ?[0-9]{2} ?(?:0[1-9]|1[0-2]) ?(?:[0-9]{2}|2[AB]) ?[0-9]{3} ?[0-9]{3} ?[0-9]{2}(?![0-9])")
TAX_ID = re.compile(r"(?<![0-9])[1-9][0-9](?: ?[0-9]{3}){3}(?![0-9])")
DNI = re.compile(r"(?<![0-9A-Za-z])[0-9]{8}-?[A-Z](?![0-9A-Za-z])")
NHS = re.compile(r"(?<![0-9])[0-9]{3}([ -]?)[0-9]{3}\1[0-9]{4}(?![0-9])")
ROUTING = re.compile(r"(?<![0-9])[0-9]{9}(?![0-9])")
IMEI = re.compile(r"(?<![0-9])[0-9]{15}(?![0-9])")


def nir(s: str) -> bool:
    """The key is 97 less the number's rest; the departments 2A and 2B count as 19 and 18."""
    s = s.replace("2A", "19").replace("2B", "18") if s[5:7] in ("2A", "2B") else s
    return int(s[13:]) == 97 - int(s[:13]) % 97


def tax_id(s: str) -> bool:
    left = 10
    for c in s[:10]:
        left = ((left + int(c)) % 10 or 10) * 2 % 11
    return (11 - left) % 10 == int(s[10])


def dni(s: str) -> bool:
    return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:8]) % 23] == s[8]


def nhs(s: str) -> bool:
    return 11 - sum(int(c) * (10 - k) for k, c in enumerate(s[:9])) % 11 == (int(s[9]) or 11)


def routing(s: str) -> bool:
    return sum(int(c) * (3, 7, 1)[k % 3] for k, c in enumerate(s)) % 10 == 0 and int(s) > 0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) << (k & 1)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def account(text: str, start: int, end: int) -> int | None:
    """The end of the account number in a match, which may run on into the words after it.

    At the blank where its country's length is reached, else at the whole match; of an
    unknown country at the last blank before which the check digits are right.
    """
    ends = [end, *(k for k in range(end - 1, start, -1) if text[k] == " ")]
    length = LENGTHS.get(text[start : start + 2])
    if length:
        ends = [*(e for e in ends if e - start - text.count(" ", start, e) == length), end]
    return next((e for e in ends if mod97(text[start:e].replace(" ", ""))), None)


def accounts(text: str):
    at = 0
    while m := IBAN.search(text, at):
        end = account(text, m.start(), m.end())
        if end:
            yield m.start(), end
        at = end or m.start() + 4  # another number may begin in a group of this one


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


#: Kinds whose matches, without blanks and hyphens, are checked as they are.
CHECKED = (("nir", NIR, nir), ("tax_id", TAX_ID, tax_id), ("dni", DNI, dni), ("nhs", NHS, nhs), ("routing", ROUTING, routing), ("imei", IMEI, luhn))


def proposed(text: str):
    """(kind, start, end) of every span that its checksum or range confirms."""
    if "@" in text:
        yield from (("email", *x) for x in emails(text))
    if not DIGIT.search(text):
        return
    if "." in text:
        for m in IP.finditer(text):
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m[0].split("."))):
                yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield "phone", m.start(), m.end()
    yield from (("iban", *x) for x in accounts(text))
    if "-" in text:
        yield from (("national_id", m.start(), m.end()) for m in NATIONAL.finditer(text))
    for kind, pattern, right in CHECKED:
        yield from ((kind, m.start(), m.end()) for m in pattern.finditer(text) if right(m[0].replace(" ", "").replace("-", "")))


def nearby(words: re.Pattern, text: str, start: int, end: int) -> bool:
    """Whether one of the words stands within NEAR characters of a span; none that goes on beyond them or into the span."""
    sides = ((max(0, start - NEAR), start), (end, min(len(text), end + NEAR)))
    return any(m.end() <= to for at, to in sides for m in words.finditer(text, at, to + 1))


def spans_of(text: str | None) -> list[tuple[str, int, int, float]]:
    """By kind as listed, then by start."""
    found = []
    for kind, start, end in proposed(text or ""):
        score = SCORE[kind] + SUPPORT * nearby(WORDS[kind], text, start, end) - AGAINST * nearby(WORDS[""], text, start, end)
        score = round(min(1.0, max(0.0, score)), 6)
        if kind in BASE or score >= LEAST:
            found.append((kind, start, end, score))
    return sorted(found, key=lambda s: (KINDS.index(s[0]), s[1]))


SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def pii_spans(text: str | Column) -> Column:
    """array<struct<kind,start,end,score>> of a text column."""

    @F.arrow_udf("array<struct<kind:string,start:int,end:int,score:double>>")
    def find(column: pa.Array) -> pa.Array:
        return pa.array([[dict(zip(("kind", "start", "end", "score"), s)) for s in spans_of(t)] for part in slices(column) for t in part], SPAN)

    return find.asNondeterministic()(text)  # so that Spark runs it once


def redacted(text: str | Column) -> Column:
    """The text with [KIND] for each span that scores LEAST or more; overlapping ones become one, named by the first. Null stays null."""

    def blank(t: str | None) -> str | None:
        found = sorted((s[1], -s[2], s[0]) for s in spans_of(t) if s[3] >= LEAST)
        if not found:
            return t
        out, at = [], 0
        for start, end, kind in found:
            if start >= at:
                out += [t[at:start], f"[{kind.upper()}]"]
            at = max(at, -end)
        return "".join([*out, t[at:]])

    @F.arrow_udf("string")
    def redact(column: pa.Array) -> pa.Array:
        return pa.array([blank(t) for part in slices(column) for t in part], pa.string())

    return redact(text)


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def query(spark, sf_dir: str) -> DataFrame:
    """op1: one row per row of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", pii_spans("text").alias("found"))
    counts = [F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return docs.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))
