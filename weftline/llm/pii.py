"""Personal data: regular expressions propose spans, validators confirm them, words nearby adjust the score.

Each kind has patterns, a first score, a validator (Luhn for cards, mod-97 for IBANs, octets for IPv4, ranges for
social-security numbers), and context words that raise or lower the score if one stands within ``CONTEXT`` characters.
A span whose validator fails is dropped. Spans that reach ``threshold`` remain; of two that overlap the higher score
wins, then the longer, then the earlier, then the kind by name. Phone numbers in national form (06 12 34 56 78, 030 1234567, 415 555 0123) reach the threshold only with
a context word.

Cases: a null or empty text has no spans; repeated rows give repeated rows; offsets count characters of the whole text;
a null id is reported as null, and ids that aren't integers raise. A text with many spans costs time in proportion to them.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import chunks, utf8

CONTEXT = 50
_WORD = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    """Whether the decimal digits of a string, 12 at least, pass the Luhn check; all-equal digits don't."""
    own = [int(c) for c in digits if c in "0123456789"]
    if len(own) < 12 or len(set(own)) == 1:
        return False
    return (sum(own[-1::-2]) + sum(sum(divmod(2 * d, 10)) for d in own[-2::-2])) % 10 == 0


#: Lengths of IBANs by country.
_IBAN = dict(p.split("=") for p in "AD=24 AE=23 AL=28 AT=20 AZ=28 BA=20 BE=16 BG=22 BH=22 BR=29 BY=28 CH=21 CR=22 CY=28 CZ=24 DE=22 DK=18 DO=28 EE=20 EG=29 ES=24 FI=18 FO=18 FR=27 GB=22 GE=22 GI=23 GL=18 GR=27 GT=28 HR=21 HU=28 IE=22 IL=23 IQ=23 IS=26 IT=27 JO=30 KW=30 KZ=20 LB=28 LC=32 LI=21 LT=20 LU=20 LV=21 MC=27 MD=24 ME=22 MK=19 MR=27 MT=31 MU=30 NL=18 NO=15 PK=24 PL=28 PS=29 PT=25 QA=29 RO=24 RS=22 SA=24 SC=31 SE=24 SI=19 SK=24 SM=27 ST=25 SV=28 TL=23 TN=24 TR=26 UA=29 VA=22 VG=24 XK=20".split())


def mod97(text: str) -> bool:
    """Whether an IBAN has its country's length, if that is known, and the remainder 1."""
    own = re.sub(r"[ -]", "", text).upper()
    if not 15 <= len(own) <= 34 or not own.isascii() or not own.isalnum() or len(own) != int(_IBAN.get(own[:2], len(own))):
        return False
    return int("".join(str(int(c, 36)) for c in own[4:] + own[:4])) % 97 == 1


def _octets(text: str) -> bool:
    parts = text.split(".")
    return all(int(p) <= 255 and str(int(p)) == p for p in parts) and parts[0] != "0"


def _social(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def _digits(least: int, most: int) -> Callable[[str], bool]:
    return lambda text: least <= sum(c.isdigit() for c in text) <= most


@dataclass(frozen=True)
class Kind:
    """How one kind of personal data is found. needs: a text without any of these characters holds none."""

    name: str
    pattern: re.Pattern
    score: float
    check: Callable[[str], bool] | None = None
    confirmed: float = 0.0
    near: frozenset[str] = frozenset()
    far: frozenset[str] = frozenset()
    needs: re.Pattern = field(default=re.compile("[0-9]"))


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


_NOT = _words("order invoice isbn issn version build ticket sku serial tracking reference bestellung commande pedido")
KINDS = (
    Kind("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"), 0.9, None, 0, _words("email mail contact write correo courriel"), needs=re.compile("@")),
    Kind("card", re.compile(r"(?<![\dA-Za-z])(?<!\d[.-])\d(?:[ -]?\d){12,18}(?![\d])"), 0.25, luhn, 0.4, _words("card credit visa mastercard amex pay payment karte kreditkarte carte tarjeta"), _NOT),
    Kind("iban", re.compile(r"(?<![A-Za-z0-9])(?:[A-Z]{2}\d{2}(?:[ -]?[A-Z0-9]){11,30}|[a-z]{2}\d{2}(?:[ -]?[a-z0-9]){11,30})(?![A-Za-z0-9])"), 0.3, mod97, 0.6, _words("iban account bank konto compte cuenta transfer"), _NOT),
    Kind("ssn", re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"), 0.3, _social, 0.25, _words("ssn social security tax identity"), _NOT),
    Kind("phone", re.compile(r"(?<![\w+.])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d|\.\d)|(?<![\w+.])\+\d{1,3}(?:[ .-]\d{2,5}){2,5}(?!\d|\.\d)|(?<![\w+.])\+\d{9,14}(?!\d)|(?<![\w+.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])"), 0.45, _digits(9, 15), 0.2, _words("phone call tel telephone telefon mobile fax whatsapp teléfono téléphone handy"), _NOT),
    # National forms say little by themselves: a word nearby must confirm them.
    Kind("phone", re.compile(r"(?<![\w+.,/-])(?:0\d(?:[ .]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}|0\d{2,4}(?: \d{2,4}){2,3}|\d{3} \d{3} \d{4}|[689]\d{2}(?: \d{3}){2}|[689]\d{2}(?: \d{2}){3})(?![\d-]|[.,]\d)"), 0.0, _digits(9, 13), 0.35, _words("phone call tel telephone telefon mobile fax whatsapp teléfono llama téléphone appelez handy ruf"), _NOT),
    Kind("ipv4", re.compile(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"), 0.4, _octets, 0.2, _words("ip address host server login client"), _words("version release build section chapter")),
    Kind("secret", re.compile(r"(?i)\b(?:api[_-]?key|secret(?:[_-]?key)?|access[_-]?token|auth[_-]?token|token|passw(?:or)?d|pwd)\b[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9_/+.=-]{8,}[\"']?|\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{30,}\b|-----BEGIN [A-Z ]*PRIVATE KEY-----"), 0.8, None, 0, _words("key secret credential login"), needs=re.compile(r"[=:]|AKIA|gh[pousr]_|-----BEGIN")),
)


def spans(text: str | None, threshold: float = 0.5, kinds: tuple[Kind, ...] = KINDS) -> list[tuple[str, int, int, float, bool]]:
    """(kind, start, end, score, confirmed by a validator) of a text's personal data, by place."""
    if not text:
        return []
    found = []
    for kind in kinds:
        if not kind.needs.search(text):
            continue
        for m in kind.pattern.finditer(text):
            if kind.check and not kind.check(m[0]):
                continue
            score = kind.score + (kind.confirmed if kind.check else 0)
            if kind.near or kind.far:
                around = set(_WORD.findall((text[max(0, m.start() - CONTEXT) : m.start()] + " " + text[m.end() : m.end() + CONTEXT]).lower()))
                score += 0.3 * (not around.isdisjoint(kind.near)) - 0.3 * (not around.isdisjoint(kind.far))
            score = round(min(1.0, score), 4)
            if score >= threshold:
                found.append((kind.name, m.start(), m.end(), score, kind.check is not None))
    return _apart(found)


def _apart(found: list[tuple[str, int, int, float, bool]]) -> list[tuple[str, int, int, float, bool]]:
    """Of the spans those that remain where some overlap, by place. Each is compared with its neighbours among those kept only."""
    first: list[int] = []
    kept: list[tuple[str, int, int, float, bool]] = []
    for run in _runs(found):
        if len(run) == 1:
            kept += run
            continue
        first.clear()
        own: dict[int, tuple[str, int, int, float, bool]] = {}
        for s in sorted(run, key=lambda s: (-s[3], s[1] - s[2], s[1], s[0])):
            at = bisect.bisect_left(first, s[1])
            # Kept spans don't overlap, so the one before and the one after tell.
            if (at == 0 or own[first[at - 1]][2] <= s[1]) and (at == len(first) or first[at] >= s[2]):
                first.insert(at, s[1])
                own[s[1]] = s
        kept += [own[k] for k in first]
    return kept


def _runs(found: list[tuple[str, int, int, float, bool]]) -> Iterator[list[tuple[str, int, int, float, bool]]]:
    """The spans by place, in runs of such as touch each other through overlaps."""
    run, end = [], 0
    for s in sorted(found, key=lambda s: (s[1], s[2])):
        if run and s[1] >= end:
            yield run
            run = []
        run.append(s)
        end = max(end, s[2]) if len(run) > 1 else s[2]
    if run:
        yield run


_SPAN = "struct<kind: string, start: int, end: int, score: double, confirmed: boolean>"


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, kind, start, end, score, confirmed): a row for each span of personal data. Map only: no shuffle."""

    def each(texts: pa.Array) -> pa.Array:
        out = [[dict(zip(("kind", "start", "end", "score", "confirmed"), s, strict=True)) for s in spans(t, threshold)] for _, part in chunks(texts) for t in part]
        return pa.array(out, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("confirmed", pa.bool_())])))

    # Texts that can hold nothing stay in the JVM.
    some = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(text_col).alias("text")).where(F.col("text").rlike("[0-9@=:]|AKIA|gh[pousr]_|-----BEGIN"))
    return some.select("doc_id", F.explode(F.arrow_udf(each, f"array<{_SPAN}>")("text")).alias("s")).select("doc_id", "s.*")


def redact(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents with each span of personal data replaced by its kind in angle brackets; a null text stays null."""

    def each(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in chunks(texts):
            for t in part:
                for kind, start, end, _, _ in reversed(spans(t, threshold)):
                    t = f"{t[:start]}<{kind}>{t[end:]}"
                out.append(t)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, F.arrow_udf(each, "string")(utf8(text_col)))
