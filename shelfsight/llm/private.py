"""Personal data: generators propose spans, boosted trees judge them, thresholds select.

Base spans follow fixed patterns (``base_spans``) and are always redacted. Loose
generators propose further, overlapping spans: numbers written as national
phones or cards, disguised addresses, IPv6 addresses and IBANs. Where numbers
stand side by side, each run of their digit groups is proposed. Boosted trees
judge the spans by their format and by the text around them.

The trees learn from two bounded sets: ``examples`` (written-out formats and
lookalikes, from fixed rules) and the candidates of ``sample_docs`` documents,
where a candidate that equals a base span counts as personal and one that has
the shape of a date, a version or a decimal number as not. One part of both is
held out, and for each kind the lowest threshold is taken at which the held-out
precision reaches ``precision``; a kind that never reaches it adds nothing.
Redaction takes base spans and selected ones alike.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsight.llm.boosting import BoostedTrees
from shelfsight.llm.common import batches, of_least_hash, small_batches, text_of

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
SAMPLE_DOCS = 2000
SAMPLE_CANDIDATES = 20_000
PRECISION = 0.98
JUDGED = 4096

# Fixed patterns of the base spans.
EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_NAME = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Loose generators.
DIGIT = re.compile(r"[0-9]")
NUMBER = re.compile(r"[0-9][0-9\x20()./:-]{5,}[0-9]")
GROUP = re.compile(r"[0-9]+")
LETTER = re.compile(r"[A-Za-z]")
LONGEST = 28
DIGITS_BEFORE = re.compile(r"[0-9][\x20()./:-]{1,3}\Z")
DIGITS_AFTER = re.compile(r"[\x20()./:-]{1,3}[0-9]")
DISGUISED = re.compile(r"\x20?[(\[{<]\x20?at\x20?[)\]}>]\x20?[A-Za-z0-9-]{1,63}(?:\x20?(?:\.|[(\[{<]\x20?dot\x20?[)\]}>])\x20?[A-Za-z0-9-]{2,63}){1,4}", re.I)
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?![0-9A-Za-z:])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
DATE = re.compile(r"\(?(?:[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{2}){1,2}|[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2})\b.*\Z")
VERSION = re.compile(r"[0-9]+(?:[.:][0-9]+)+\Z")

# Words before a span that speak for or against it.
CUES = tuple(
    re.compile(p, re.I)
    for p in (
        r"phone|tel\b|tel\.|call|mobile|fax|cell|telefon|tél|teléfono|llame|anruf",
        r"card|visa|credit|karte|carte|tarjeta|payment",
        r"mail|contact|write|reach|kontakt|correo|courriel",
        r"iban|account|bank|konto|compte|cuenta",
        r"\bip\b|host|server|address|adresse",
        r"order|invoice|isbn|version|serial|ticket|page|total|price|date|year|id\b|no\.|#|\$|€|bestell|facture",
    )
)


def luhn(digits: str) -> bool:
    twice = [2 * int(c) - 9 * (c > "4") for c in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _left(text: str, at: int, stop: int, lead: re.Pattern) -> int:
    while at > stop and lead.match(text, at - 1, at):
        at -= 1
    return at


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, in order."""
    out = []
    if "@" in text:
        done = 0
        for m in EMAIL_HOST.finditer(text):
            start = _left(text, m.start(), done, EMAIL_NAME)
            if start < m.start():
                out.append((start, 0, m.end()))
                done = m.end()
    if DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12 and 12 <= len(digits := digits_of(m[0])) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def numbers(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of each run of whole digit groups of 7 to 19 digits; a letter at a border bars it."""
    for run in NUMBER.finditer(text):
        groups = [m.span() for m in GROUP.finditer(text, run.start(), run.end())]
        for i, (first, _) in enumerate(groups):
            if first and LETTER.match(text, first - 1):
                continue
            opened = text[first - 1 : first] == "(" and not re.match("[0-9A-Za-z]", text[max(first - 2, 0) : first - 1])
            n = 0
            for start, end in groups[i : i + 19]:
                n += end - start
                if n > 19 or end - first > LONGEST:
                    break
                if n >= 7 and not LETTER.match(text, end):
                    yield first - opened, end, n


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) that the loose generators propose; spans may overlap."""
    out = []
    low = text.lower() if "at" in text or "AT" in text or "At" in text else ""
    if any(c + "at" in low or c + " at" in low for c in "([{<"):
        for m in DISGUISED.finditer(text):
            start = _left(text, m.start(), max(0, m.start() - 64), EMAIL_NAME)
            if start < m.start():
                out.append((start, 0, m.end()))
    if DIGIT.search(text):
        for start, end, n in numbers(text):
            if n <= 15:
                out.append((start, 3, end))
            if n >= 12:
                out.append((start, 2, end))
        if text.count(":") > 1:
            out += [(m.start(), 1, m.end()) for m in IPV6.finditer(text)]
        out += [(m.start(), 4, m.end()) for m in IBAN.finditer(text)]
    return out


def features(text: str, start: int, kind: int, end: int) -> list[float]:
    """Format and context of a span; neither the plus sign nor the check digit decides alone."""
    span = text[start:end]
    groups = [len(g) for g in re.findall(r"[0-9A-Za-z]+", span)] or [0]
    digits = digits_of(span)
    before, after = text[max(0, start - 40) : start], text[end : end + 1]
    edge = text[start - 1 : start]
    return [
        kind,
        end - start,
        len(digits),
        sum(c.isalpha() for c in span),
        len(groups),
        groups[0],
        max(groups),
        min(groups),
        groups[-1],
        span.count("."),
        span.count("-"),
        span.count("/"),
        span.count(":"),
        span.count(" "),
        float("(" in span and ")" in span),
        float(bool(DATE.match(span))),
        float(bool(VERSION.match(span))),
        float(len(digits) > 1 and luhn(digits)),
        int(digits[:1] or 0),
        len(set(digits)),
        float(edge == "+"),
        float(edge.isspace() or edge in ("", "\"", "'", "<", "(", ":")),
        float(after == "" or after.isspace() or after in ".,;:)>\"'"),
        float(bool(DIGITS_BEFORE.search(text[max(0, start - 4) : start]))),
        float(bool(DIGITS_AFTER.match(text, end))),
        *(float(bool(c.search(before))) for c in CUES),
    ]


def examples(count: int = 400, seed: int = 5) -> list[tuple[str, int, int, int, int]]:
    """(text, start, kind, end, personal) of written-out formats and lookalikes."""
    rng = np.random.default_rng(seed)
    n = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    some = lambda xs: xs[rng.integers(len(xs))]
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(3, 9)))

    def card() -> str:
        body = "4" + n(14)
        full = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        return some([full, "/".join(full[i : i + 4] for i in range(0, 16, 4)), ".".join(full[i : i + 4] for i in range(0, 16, 4))])

    def national() -> str:
        return some([f"({n(3)}) {n(3)}-{n(4)}", f"{n(3)}-{n(3)}-{n(4)}", f"0{n(3)} {n(7)}", f"0{n(2)}/{n(8)}", f"0{n(1)} {n(2)} {n(2)} {n(2)} {n(2)}", f"{n(3)}.{n(3)}.{n(4)}"])

    def date() -> str:
        y, m, d = rng.integers(1950, 2030), rng.integers(1, 13), rng.integers(1, 29)
        return some([f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{d:02}/{m:02}/{y}", f"{y}-{m:02}-{d:02} {n(2)}:{n(2)}", f"{y}/{m:02}/{d:02}"])

    lead = {
        3: ["call ", "phone: ", "tel. ", "mobile ", "fax ", "reach me on "],
        2: ["card ", "visa ", "credit card: ", "paid by card "],
        0: ["mail ", "contact ", "write to "],
        1: ["host ", "from ip ", "server "],
        4: ["iban ", "account ", "bank "],
    }
    against = ["order ", "invoice ", "version ", "total ", "serial ", "page ", "id ", "isbn "]
    out = []

    def add(kind: int, span: str, before: str, personal: int) -> None:
        before = f"{word()} {before}"
        out.append((f"{before}{span} {word()}", len(before), kind, len(before) + len(span), personal))

    def beside(before: str, *spans: tuple[int, str]) -> None:
        """Numbers side by side: all runs of their groups but the spans themselves are not personal."""
        text, true = f"{word()} {before}", set()
        for i, (kind, span) in enumerate(spans):
            text += some([" ", " / ", " - "]) if i else ""
            true.add((len(text), kind, len(text) + len(span)))
            text += span
        text += f" {word()}"
        out.extend((text, *c, int(c in true)) for c in candidates(text))

    for _ in range(count):
        add(3, national(), some(lead[3]), 1)
        add(2, card(), some(lead[2]), 1)
        add(0, f"{word()}{some([' (at) ', '[at]', ' [at] ', '(at)'])}{word()}{some(['.', ' (dot) ', '[dot]'])}{some(['com', 'org', 'net'])}", some(lead[0] + [""]), 1)
        add(1, ":".join(f"{v:x}" for v in rng.integers(4096, 65536, 8)), some(lead[1] + [""]), 1)
        add(4, f"{some(['DE', 'FR', 'ES', 'GB'])}{n(2)} {n(4)} {n(4)} {n(4)} {n(4)} {n(2)}", some(lead[4] + [""]), 1)
        for kind in (2, 3):
            add(kind, n(rng.integers(12, 16)), some(against + [""]), 0)
            add(kind, f"{n(5)}-{n(4)}-{n(6)}", some(against), 0)
        for kind in (2, 3):
            add(kind, date(), some(["date ", "on ", "", "page "]), 0)
        add(3, f"{n(2)}.{n(2)}.{n(3)}", some(["version ", "v "]), 0)
        add(3, n(rng.integers(7, 12)), some(against + [""]), 0)
        add(3, f"{n(4)} - {n(4)}", some(["year ", "pages "]), 0)
        add(1, f"{n(2)}:{n(2)}:{n(2)}", some(["at ", ""]), 0)
        add(4, f"{some(['AB', 'XY', 'NO', 'ID'])}{n(2)} {n(4)} {n(4)}", some(against), 0)
        beside(some(lead[3]), (3, national()), (3, national()))
        full = digits_of(card())
        full = some([full, *(c.join(full[i : i + 4] for i in range(0, 16, 4)) for c in " -")])
        beside(some(lead[2]), (2, full), (-1, some([f"{n(2)}/{n(2)}", n(3), n(4)])))
        beside(some(lead[3]), (3, national()), (-1, date()))
    return out


class Judge:
    """The trees and the threshold of each kind."""

    def __init__(self, rows: list[tuple[list[float], int]], precision: float = PRECISION):
        x = np.array([r[0] for r in rows], dtype=float)
        y = np.array([r[1] for r in rows], dtype=float)
        held = np.random.default_rng(3).random(len(y)) < 0.4
        self.trees = BoostedTrees().fit(x[~held], y[~held])
        p, kind = self.trees.probability(x[held]), x[held][:, 0]
        self.least = []
        for k in range(len(KINDS)):
            own = np.argsort(-p[kind == k], kind="stable")
            score, true = p[kind == k][own], y[held][kind == k][own]
            good = np.cumsum(true) / np.arange(1, len(true) + 1) >= precision
            last = np.r_[score[1:] != score[:-1], True][: len(score)]
            fit = np.flatnonzero(good & last)
            # Halfway to the next score, so that spans like the last good one pass too.
            below = np.append(score, 0.0)[fit[-1] + 1] if len(fit) else 0.0
            self.least.append(max(0.5, float(score[fit[-1]] + below) / 2) if len(fit) else 2.0)

    def extra(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Selected spans that no base span holds, apart from each other, the likeliest by length in all."""
        starts, reach = [b[0] for b in base], np.maximum.accumulate([b[2] for b in base] or [0]).tolist()

        def held(c: tuple[int, int, int]) -> bool:
            i = bisect_right(starts, c[0])
            return i > 0 and c[2] <= reach[i - 1]

        found = [c for c in candidates(text) if not held(c)]
        good = []
        for i in range(0, len(found), JUDGED):
            some = found[i : i + JUDGED]
            p = self.trees.probability(np.array([features(text, *c) for c in some], dtype=float)).tolist()
            good += [(c, x) for c, x in zip(some, p, strict=True) if x >= self.least[c[1]]]
        return _apart(good)


def _apart(spans: list[tuple[tuple[int, int, int], float]]) -> list[tuple[int, int, int]]:
    """Spans that don't overlap, with the greatest sum of length times probability."""
    spans = sorted(spans, key=lambda s: (s[0][2], s[0]))
    ends, best, taken = [s[0][2] for s in spans], [0.0], []
    for (start, _, end), p in spans:
        before = bisect_right(ends, start, hi=len(taken))
        with_it = best[before] + p * (end - start)
        taken.append(before if with_it > best[-1] else None)
        best.append(max(with_it, best[-1]))
    out, i = [], len(spans)
    while i:
        i -= 1
        if taken[i] is not None:
            out.append(spans[i][0])
            i = taken[i]
    return out[::-1]


def _weak(text: str) -> list[tuple[list[float], int]]:
    """Candidates of a corpus text that are clearly personal or clearly not."""
    base = base_spans(text)
    exact = {(s + (text[s] == "+"), e) for s, _, e in base}
    # A run that shares digits with a base span, but isn't it, has the wrong borders.
    starts, reach = [b[0] for b in base], np.maximum.accumulate([b[2] for b in base] or [0]).tolist()
    out = []
    for s, k, e in candidates(text):
        i = bisect_right(starts, e - 1)
        if (s, e) in exact:
            out.append((features(text, s, k, e), 1))
        elif i and reach[i - 1] > s:
            out.append((features(text, s, k, e), 0))
        elif DATE.match(text[s:e]) or VERSION.match(text[s:e]):
            out.append((features(text, s, k, e), 0))
    return out


def trained(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION) -> Judge:
    """A judge from the examples and from ``documents`` (doc_id, text).

    At most ``sample_docs`` of those that hold a digit or an at sign are taken,
    least hash of the row first, and at most SAMPLE_CANDIDATES candidates of them.
    """

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(frames):
            rows = [r for t in batch.column("text").to_pylist() for r in _weak(t)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.list_(pa.float64())), pa.array([r[1] for r in rows], pa.int32())],
                ["x", "y"],
            )

    # Of many more documents than are kept, so that enough of them hold a digit.
    some = of_least_hash(documents.select("doc_id", "text"), documents.count(), 2 * sample_docs, "doc_id", "text")
    texts = some.where("text rlike '[0-9@]'").orderBy(F.xxhash64("doc_id", "text"), "text").limit(sample_docs)
    rows = texts.select("text").mapInArrow(run, "x array<double>, y int").limit(SAMPLE_CANDIDATES).collect()
    rows = sorted((list(r.x), r.y) for r in rows)
    return Judge([(features(t, s, k, e), y) for t, s, k, e, y in examples()] + rows, precision)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """text with each span, or run of overlapping spans, replaced by the kind that starts first."""
    out, at = [], 0
    for start, kind, end in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def personal_data(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, precision: float = PRECISION) -> DataFrame:
    """``documents`` with a column ``found``: base counts and digest, all spans, the redacted text.

    Fields of ``found``: n_email, n_ip, n_card, n_phone (base spans), base_sha256
    (lower-case hex SHA-256 of the base spans, each kind:start:end in code
    points, end exclusive, by start and then kind, comma-joined), spans (all
    spans, joined likewise) and redacted. A NULL text is an empty one. Every row
    is judged for itself, so repeated rows and ids get equal results; other
    columns pass through, but for one named ``found``, which is replaced. Whole
    texts are read, however long; of numbers spelled over more than LONGEST
    letters only the base spans are found. With no row the trees learn from the
    examples alone. The session's Arrow batches are made smaller for good.
    """
    spark = documents.sparkSession
    small_batches(spark)
    judge = spark.sparkContext.broadcast(trained(documents, sample_docs, precision))

    @F.arrow_udf(FOUND_TYPE)
    def find(texts: pa.Array) -> pa.Array:
        out = []
        for text in texts.to_pylist():
            base = base_spans(text)
            spans = base + judge.value.extra(text, base)
            counts = [sum(k == i for _, k, _ in base) for i in range(4)]
            digest = hashlib.sha256(joined(base).encode()).hexdigest()
            out.append((*counts, digest, joined(spans), redacted(text, spans) if spans else text))
        columns = list(zip(*out, strict=True)) or [()] * 7
        kinds = [pa.int64()] * 4 + [pa.string()] * 3
        return pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in FOUND.split(", ")]
        )

    return documents.withColumn("found", find(text_of("text")))


FOUND_TYPE = f"struct<{FOUND.replace(' long', ':bigint').replace(' string', ':string')}>"
