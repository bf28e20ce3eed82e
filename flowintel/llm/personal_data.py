"""Personal data: fixed patterns, and a trained tagger for what they miss.

Patterns give the base spans.  A character-level BiLSTM-CRF, trained on windows of a bounded
sample in which those spans are the labels, adds spans of its own.  To know more than the
patterns, it also learns from each window with its spans rewritten to forms that they miss,
from the same window with dates, amounts and the like in their place, and from windows whose
digit runs all belong to tokens with letters, the last two without labels.  Every span of a kind below
holds a digit or an @, so only text within CONTEXT characters of one is tagged; this rules
out no possible span.  Such a stretch is read by overlapping windows; their tag scores are
averaged, weighted by the distance to the window's edge, and one Viterbi pass decodes the
whole stretch.  A decoded span is added if it overlaps no base span, is plausible for its kind
(a card needs its check digit, an address four numbers up to 255) and its path exceeds the one
outside of all kinds by MIN_MARGIN.

Spans are [start, end) in code points.  Null text counts as empty: no spans.  Without any
base span to learn from, no span is added.  Repeated rows have equal results; ids may be null.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowintel.llm import lstm_crf
from flowintel.llm.text import slices
from flowintel.session import checkpointed

KINDS = ("email", "ip", "card", "phone")
WINDOW, STRIDE, CONTEXT = 64, 32, 16
TRAIN_WINDOWS = 1200
WINDOWS_PER_TEXT = 4
LEAST_LENGTH, LEAST_DIGITS, MOST_DIGITS = 6, 7, 15
MIN_MARGIN = 4.0

# Runs are possessive: a shorter run never lets a later part match, and long ones stay linear.
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
ANCHOR = re.compile(r"[0-9@]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def pattern_matches(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, accepted) of all matches of the patterns."""
    found = []
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            found.append((start, 0, done, True))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        found.append((m.start(), 1, m.end(), all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.groups())))
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m[0])
        found.append((m.start(), 2, m.end(), 14 <= len(digits) <= 19 and luhn(digits)))
    if "+" in text:
        for m in PHONE.finditer(text):
            found.append((m.start(), 3, m.end(), 10 <= sum(c.isdigit() for c in m[0]) <= 15))
    return sorted(found)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text within CONTEXT characters of a digit or @."""
    out: list[list[int]] = []
    for m in ANCHOR.finditer(text):
        a, b = max(0, m.start() - CONTEXT), min(len(text), m.end() + CONTEXT)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def window_starts(length: int) -> list[int]:
    """Overlapping windows that cover a stretch."""
    return [0] if length <= WINDOW else [*range(0, length - WINDOW, STRIDE), length - WINDOW]


def _anchored(column: pa.Array) -> Iterator[tuple[int, str]]:
    """(row, text) of the texts with a digit or @."""
    for first, data, offsets in slices(column):
        held = ((data >= 48) & (data <= 57)) | (data == 64)
        at = np.unique(np.searchsorted(offsets, np.flatnonzero(held), "right") - 1)
        for i in at.tolist():
            yield first + i, data[offsets[i] : offsets[i + 1]].tobytes().decode()


def _window(text: str, start: int, base: list[tuple[int, int, int, bool]]) -> tuple[str, str]:
    """WINDOW characters from start, and one tag digit per character."""
    marks = np.zeros(WINDOW, np.int64)
    for s, kind, e, _ in base:
        if s < start + WINDOW and e > start:
            marks[max(0, s - start) : e - start] = 2 * kind + 2
            if s >= start:
                marks[s - start] = 2 * kind + 1
    return text[start : start + WINDOW].ljust(WINDOW), "".join(map(str, marks))


def _training_windows(limit: int):
    """Windows around base spans, and, without tags, around digits inside tokens with letters.  A task keeps those that `limit` can choose."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[list, list] = ([], [])

        def keep(part: list, window: tuple[str, str]) -> None:
            part.append((int.from_bytes(hashlib.blake2b(window[0].encode(), digest_size=7).digest()), *window))
            if len(part) >= 4 * limit:
                part.sort()
                del part[limit:]

        for batch in batches:
            for _, text in _anchored(batch.column(0)):
                found = pattern_matches(text)
                base = [m for m in found if m[3]]
                for start, _, end, _ in base[:WINDOWS_PER_TEXT]:
                    keep(held[0], _window(text, max(0, (start + end) // 2 - WINDOW // 2), base))
                # a window that may hold what the patterns miss teaches nothing: each digit run must belong to a token with letters
                free = [m for m in found if not any(c.isalpha() for c in text[max(0, m[0] - 1) : m[0]] + text[m[2] : m[2] + 1])]
                spare = [a for a in (max(0, (m[0] + m[2]) // 2 - WINDOW // 2) for m in found if m not in free)
                         if "@" not in text[a : a + WINDOW] and not any(m[0] < a + WINDOW and m[2] > a for m in free)]
                for a in spare[:WINDOWS_PER_TEXT]:
                    keep(held[1], _window(text, a, []))
        rows = [(*row, bool(i)) for i, part in enumerate(held) for row in sorted(part)[:limit]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.string(), pa.string(), pa.bool_()))],
            names=["hash", "window", "tags", "spare"])

    return run


def reformatted(span: str, kind: int, rng: np.random.Generator) -> str:
    """The span in a form that the patterns miss; numbers of cards and phones are drawn anew."""
    def pick(*ways: str) -> str:
        return ways[int(rng.integers(len(ways)))]

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    if kind == 0:
        return span.replace("@", pick(" @ ", "[@]", "(@)", " @"))
    if kind == 1:
        return span.replace(".", pick("[.]", "(.)", " . ", ". "))
    if kind == 2:
        n = sum(c.isdigit() for c in span)
        sizes = [4, 6, n - 10] if n < 16 else [4] * (n // 4) + ([n % 4] if n % 4 else [])
        return pick(".", ".", "/", "_", " - ", "  ", ". ").join(digits(k) for k in sizes)
    a, b, c = digits(3), digits(3), digits(4)
    return pick(f"({a}) {b}-{c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}",
                f"1-{a}-{b}-{c}", f"1 ({a}) {b}-{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}", f"0{a}-{b}{c}", f"00{a[0]}{b[0]} {a} {b} {c}")


def counterfeit(rng: np.random.Generator) -> str:
    """Digits of none of the kinds."""
    n = [int(x) for x in rng.integers(0, 10**6, 8)]
    year, month, day, hour, minute = 1900 + n[0] % 200, 1 + n[1] % 12, 1 + n[2] % 28, n[3] % 24, n[4] % 60
    ways = (
        f"{year}-{month:02}-{day:02}", f"{day:02}.{month:02}.{year}", f"{month}/{day}/{year}", f"{year}{month:02}{day:02}",
        f"{year}-{month:02}-{day:02} {hour:02}:{minute:02}:{n[5] % 60:02}", f"{hour:02}:{minute:02}", f"{n[5]},{n[6] % 1000:03},{n[7] % 1000:03}",
        f"{n[5]}.{n[6] % 100:02}", f"{n[5]}", f"{n[5]}{n[6]}", f"{n[0] % 10}.{n[1] % 20}.{n[2] % 30}", f"{year}-{year + n[6] % 30}",
        f"{n[5] % 1000} {n[6] % 1000} {n[7] % 1000}", "%016x" % int(rng.integers(1 << 62)), "%08X" % n[5] * 3)
    return ways[int(rng.integers(len(ways)))]


def rewritten(window: str, tags: str, rng: np.random.Generator, fake: bool) -> tuple[str, str]:
    """The window with each of its whole spans reformatted, or with a counterfeit and no tag in its place."""
    text, marks, at = "", "", 0
    while at < len(window):
        end = at + 1
        if tags[at] == "0":
            piece, own = window[at], "0"
        else:
            inner = str(int(tags[at]) + int(tags[at]) % 2)
            while end < len(window) and tags[end] == inner:
                end += 1
            kind, piece = (int(inner) - 2) // 2, window[at:end]
            if at > 0 and end < len(window):
                piece = counterfeit(rng) if fake else reformatted(piece, kind, rng)
                own = "0" * len(piece) if fake else f"{2 * kind + 1}" + inner * (len(piece) - 1)
            else:  # cut by the edge
                own = tags[at:end]
        text, marks, at = text + piece, marks + own, end
    return text[:WINDOW].ljust(WINDOW), marks[:WINDOW].ljust(WINDOW, "0")


def train_tagger(docs: DataFrame, text_col: str = "text", windows: int = TRAIN_WINDOWS) -> dict[str, np.ndarray] | None:
    """Weights learnt from at most `windows` labelled windows and half as many spare ones, chosen by hash; None if none is labelled."""
    found = checkpointed(docs.select(F.col(text_col).cast("string").alias("_text")).mapInArrow(
        _training_windows(windows), "hash bigint, window string, tags string, spare boolean"))
    rows, spare = (
        [(r["window"], r["tags"]) for r in found.where(part).orderBy("hash", "window", "tags").limit(most).collect()]
        for part, most in (("not spare", windows), ("spare", windows // 2)))
    if not rows:
        return None
    rng = np.random.default_rng(11)
    rows = [*rows, *(rewritten(*r, rng, False) for r in rows * 2), *(rewritten(*r, rng, True) for r in rows), *spare]
    x = np.stack([lstm_crf.symbols(window) for window, _ in rows])
    y = np.array([[int(c) for c in tags] for _, tags in rows])
    # a window that begins inside a span begins with that span's first tag
    inner = (y[:, 0] > 0) & (y[:, 0] % 2 == 0)
    y[inner, 0] -= 1
    return lstm_crf.train(x, y, len(KINDS), epochs=12, rate=0.03)


def decode(weights: dict, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
    """(start, kind, end, margin) spans of each stretch of text."""
    codes = [lstm_crf.symbols(t) for t in texts]
    places = [(i, s) for i, c in enumerate(codes) for s in window_starts(len(c))]
    tags = len(weights["C"])
    sums = [np.zeros((len(c), tags)) for c in codes]
    mass = [np.zeros(len(c)) for c in codes]
    tent = np.minimum(np.arange(WINDOW) + 1.0, np.arange(WINDOW)[::-1] + 1.0)
    for at in range(0, len(places), 1024):
        part = places[at : at + 1024]
        x = np.full((len(part), WINDOW), 32, np.int64)
        for row, (i, s) in enumerate(part):
            piece = codes[i][s : s + WINDOW]
            x[row, : len(piece)] = piece
        scores = lstm_crf.emissions(weights, x.T)
        for row, (i, s) in enumerate(part):
            n = min(WINDOW, len(codes[i]) - s)
            sums[i][s : s + n] += scores[:n, row] * tent[:n, None]
            mass[i][s : s + n] += tent[:n]
    out: list[list[tuple[int, int, int, float]]] = [[] for _ in codes]
    order = sorted(range(len(codes)), key=lambda i: len(codes[i]))
    at = 0
    while at < len(order):
        part = [order[at]]
        while at + len(part) < len(order) and (len(part) + 1) * len(codes[order[at + len(part)]]) <= 1 << 15:
            part.append(order[at + len(part)])
        at += len(part)
        lengths = np.array([len(codes[i]) for i in part])
        padded = np.zeros((len(part), lengths.max(), tags))
        for row, i in enumerate(part):
            padded[row, : lengths[row]] = sums[i] / mass[i][:, None]
        best = lstm_crf.viterbi(weights, padded, lengths)
        for row, i in enumerate(part):
            marks = best[row, : lengths[row]]
            for s in np.flatnonzero(marks % 2 == 1).tolist():
                e = s + 1
                while e < lengths[row] and marks[e] == marks[s] + 1:
                    e += 1
                out[i].append((s, int(marks[s] - 1) // 2, e, lstm_crf.margin(weights, padded[row, : lengths[row]], marks, s, e)))
    return out


def plausible(text: str, kind: int) -> bool:
    """Least that a decoded span must hold."""
    if len(text) < LEAST_LENGTH:
        return False
    if kind == 0:
        return "@" in text[1:-1]
    numbers = re.findall("[0-9]+", text)
    digits = "".join(numbers)
    if kind == 1:
        return len(numbers) == 4 and all(len(n.lstrip("0")) <= 3 and int(n.lstrip("0") or 0) <= 255 for n in numbers)
    return 13 <= len(digits) <= 19 and luhn(digits) if kind == 2 else LEAST_DIGITS <= len(digits) <= MOST_DIGITS


def settled_kind(text: str, kind: int) -> int | None:
    """The decoded kind if plausible, else the one of the two kinds with a check of their own that is; None if none is."""
    return next((k for k in ((kind, 2, 1) if kind else (kind,)) if plausible(text, k)), None)


def whole(text: str, start: int, end: int) -> bool:
    """Whether the span is no part of a longer number."""
    return not (text[start - 1 : start + 1].isdecimal() and start > 0 or text[end - 1 : end + 1].isdecimal() and end < len(text))


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, counts of the base kinds, digest of the base spans, all spans, and the number added by the tagger."""
    weights = train_tagger(docs, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts = np.zeros((n, len(KINDS)), np.int64)
            added = np.zeros(n, np.int64)
            base_text, spans_text = [""] * n, [""] * n
            waiting: list[tuple[int, int, str]] = []
            matches: dict[int, tuple[str, list]] = {}

            def flush() -> None:
                more: dict[int, list] = {}
                decoded = decode(weights, [t for *_, t in waiting]) if weights is not None and waiting else []
                for (row, start, _), spans in zip(waiting, decoded):
                    text, found = matches[row]
                    for s, kind, e, margin in spans:
                        a, b = start + s, start + e
                        own = settled_kind(text[a:b], kind)
                        if (margin >= MIN_MARGIN and own is not None and whole(text, a, b)
                                and not any(m[3] and m[0] < b and a < m[2] for m in found)):
                            more.setdefault(row, []).append((a, own, b))
                for row, (_, found) in matches.items():
                    base = [(s, k, e) for s, k, e, ok in found if ok]
                    extra = more.get(row, [])
                    for _, kind, _ in base:
                        counts[row, kind] += 1
                    added[row] = len(extra)
                    base_text[row], spans_text[row] = (
                        ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x) for x in (base, sorted(base + extra)))
                waiting.clear()
                matches.clear()

            for row, text in _anchored(batch.column(1)):
                matches[row] = text, pattern_matches(text)
                waiting.extend((row, a, text[a:b]) for a, b in stretches(text))
                if len(waiting) >= 2000:
                    flush()
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, i]) for i in range(len(KINDS))),
                 pa.array([hashlib.sha256(b.encode()).hexdigest() for b in base_text]), pa.array(spans_text), pa.array(added)],
                names=[id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(
        scan, f"`{id_col}` {kind}, {', '.join(f'n_{k} bigint' for k in KINDS)}, base_sha256 string, spans string, n_added bigint")
