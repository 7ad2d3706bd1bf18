"""Personal data in texts: fixed patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

The patterns find e-mail addresses, IP addresses, card and phone numbers as they are usually written. The tagger learns
from spans these patterns label in a bounded sample of windows, half of them rewritten in ways the patterns miss
(``name [at] host [dot] tld``, ``10[.]0[.]0[.]1``, grouped cards, phones without a plus). A text is read in overlapping
windows; each is decoded by itself, and the spans of a whole text are reconciled: parts that a border cut are joined,
spans must hold as their kind once rewriting is undone, what meets a pattern's span gives way to it, and of the rest the
set of disjoint spans with the largest total score stays.

Every span holds a digit, ``@``, ``(`` or ``[``; windows without any of these cannot hold one and are not decoded, which
changes no result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from fieldtide.llm.lstm_crf import Tagger

KINDS = ("email", "ip", "card", "phone")
WIDTH, STEP = 96, 64

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@(\[]")
_DIGIT = re.compile(r"[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# 0 past the text, 1 letters beyond ASCII, 2 lower case, 3 upper case, 4 digits, 5 white space, 6 on all other ASCII characters.
_CLASSES = np.array([4 if 48 <= c < 58 else 2 if 97 <= c < 123 else 3 if 65 <= c < 91 else 5 if c in (9, 10, 11, 12, 13, 32) else 6 + c
                     for c in range(128)] + [1], np.int16)
_CHARACTERS = 6 + 128

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _is_ip(text: str) -> bool:
    return all(int(part) <= 255 if len(part) < 9 else not part.lstrip("0")[3:] and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each ``@`` outward, so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, host.end()
            free = host.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str, checked: bool = True) -> list[Span]:
    """Spans of the fixed patterns by kind and start, code points, end exclusive; unless ``checked``, also those that fail
    the checks of their numbers."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if not checked or _is_ip(m[0])]
        out += [("card", *m.span()) for m in _CARD.finditer(text) if not checked or _is_card(_digits(m[0]))]
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if not checked or 9 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


_AT = re.compile(r"\s*[\[(]\s*(?:at|@)\s*[\])]\s*", re.IGNORECASE)
_DOT = re.compile(r"\s*[\[(]\s*(?:dot|\.)\s*[\])]\s*", re.IGNORECASE)
_SEPARATED_CARD = re.compile(r"[0-9]{4}(?:[ ./-][0-9]{1,7})+")
_PLAIN_PHONE = re.compile(r"(?:00[0-9]{1,3}|[0-9]{1,3})?[ .-]?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}(?:[ .-][0-9]{2,4})+|\([0-9]{2,4}\) ?[0-9]{3,4}[ .-][0-9]{3,4}")


def holds(kind: str, text: str) -> bool:
    """Whether the span reads as its kind once its rewriting is undone."""
    if not _HINT.search(text):
        return False
    if kind == "email":
        plain = _DOT.sub(".", _AT.sub("@", text))
        return next(_emails(plain), None) == (0, len(plain))
    if kind == "ip":
        plain = _DOT.sub(".", text)
        return bool(_IP.fullmatch(plain)) and _is_ip(plain)
    if kind == "card":
        return bool(_SEPARATED_CARD.fullmatch(text)) and _is_card(_digits(text))
    return 9 <= len(_digits(text)) <= 15 and bool(_PLAIN_PHONE.fullmatch(text))


def rewritten(kind: str, text: str, rng: np.random.Generator) -> str:
    """A labelled span as people also write it."""
    pick = lambda *options: options[int(rng.integers(len(options)))]
    if kind == "email":
        dot = pick(".", "[dot]", " [dot] ", "(dot)", "[.]")
        name, host = text.rsplit("@", 1)
        return name + pick("[at]", " [at] ", "(at)", " (at) ", "[@]") + host.replace(".", dot)
    if kind == "ip":
        return text.replace(".", pick("[.]", "[dot]", "(.)", "[.]"))
    if kind == "card":
        digits, sep = _digits(text), pick(".", "/", " ", "-")
        return sep.join(digits[k : k + 4] for k in range(0, len(digits), 4))
    digits, sep = _digits(text), pick("-", ".", " ")
    area, rest = digits[-10:-7], sep.join((digits[-7:-4], digits[-4:]))
    front = digits[:-10]
    return pick(f"({area}) {rest}", f"{area}{sep}{rest}", f"00{front or 1} {area} {rest}", f"{front or 1}{sep}{area}{sep}{rest}")


def characters(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _CLASSES[np.minimum(points, 128)]


def window_starts(text: str) -> list[int]:
    """Starts of the windows that hold a hint. Every ``WIDTH - STEP`` neighbours lie whole in one window."""
    last, out = max(0, -(-(len(text) - WIDTH) // STEP)), []
    hint = _HINT.search(text)
    while hint:
        at = hint.start()
        for k in range(max(0, -(-(at - WIDTH + 1) // STEP)), min(last, at // STEP) + 1):
            if not out or k * STEP > out[-1]:
                out.append(k * STEP)
        # Later hints in the newest window add the windows after it.
        hint = _HINT.search(text, max(at + 1, min((at // STEP + 1) * STEP, len(text))))
    return out


@dataclass
class Window:
    start: int
    kinds: np.ndarray  # 0 outside, else 1 + 2 * kind, one more inside a span
    leads: np.ndarray  # by how much each tag's score exceeds that of "outside"


def window_spans(found: Window, length: int) -> Iterator[list]:
    """[kind, start, end, score, cut] of one decoded window; cut if its end goes on beyond the window."""
    tags, size = found.kinds, min(WIDTH, length - found.start)
    k = 0
    while k < size:
        if tags[k] == 0:
            k += 1
            continue
        kind, start = (int(tags[k]) - 1) // 2, k
        k += 1
        while k < size and tags[k] == 2 * kind + 2:
            k += 1
        cut = (start == 0 and found.start > 0) or (k == size and found.start + size < length)
        yield [KINDS[kind], found.start + start, found.start + k, float(found.leads[start:k].sum()), cut]


def reconcile(text: str, spans: list[list], fixed: list[Span]) -> list[Span]:
    """Disjoint spans of a whole text with the largest total score, none of which meets a fixed one.

    Parts of one kind that overlap and that a border cut are one span, with the larger score.
    """
    joined: list[list] = []
    for s in sorted(spans, key=lambda s: (s[0], s[1], s[2])):
        before = joined[-1] if joined else None
        if before and before[0] == s[0] and s[1] < before[2] and (before[4] or s[4]):
            before[2], before[3], before[4] = max(before[2], s[2]), max(before[3], s[3]), True
        else:
            joined.append(list(s))
    starts = sorted((a, b) for _, a, b in fixed)
    ends = np.maximum.accumulate([b for _, b in starts]).tolist() if starts else []
    fine: dict[Span, float] = {}
    for kind, a, b, score, _ in joined:
        while b > a and text[b - 1] in " \t\r\n.,;:":
            b -= 1
        while a < b and text[a] in " \t\r\n,;:":
            a += 1
        k = bisect_right(starts, (b - 1, 1 << 60))  # fixed spans that start before this one ends
        if score > 0 and not (k and ends[k - 1] > a) and holds(kind, text[a:b]):
            fine[kind, a, b] = max(score, fine.get((kind, a, b), 0.0))
    order = sorted(fine, key=lambda s: (s[2], s[1], s[0]))
    stops, best, took = [s[2] for s in order], [0.0], []
    for k, s in enumerate(order):
        j = bisect_right(stops, s[1], 0, k)
        with_it = best[j] + fine[s]
        took.append(j if with_it > best[-1] else None)
        best.append(max(best[-1], with_it))
    out, k = [], len(order)
    while k:
        if took[k - 1] is None:
            k -= 1
        else:
            out.append(order[k - 1])
            k = took[k - 1]
    return out


def decode(model: Tagger, texts: list[str], block: int = 512) -> Iterator[tuple[int, list[list]]]:
    """(text, spans of one window), windows of all texts pooled in blocks."""
    at: list[tuple[int, int]] = []
    rows: list[np.ndarray] = []

    def flush() -> Iterator[tuple[int, list[list]]]:
        ids = np.zeros((len(rows), WIDTH), np.int16)
        for k, r in enumerate(rows):
            ids[k, : r.size] = r
        scores = model.score(ids)
        paths = model.best_path(scores)
        for k in np.flatnonzero(paths.any(axis=1)):
            which, start = at[k]
            lead = scores[k, np.arange(WIDTH), paths[k]] - scores[k, :, 0]
            yield which, list(window_spans(Window(start, paths[k], lead), len(texts[which])))

    for which, text in enumerate(texts):
        starts = window_starts(text)
        if starts:
            codes = characters(text)
        for start in starts:
            at.append((which, start))
            rows.append(codes[start : start + WIDTH])
            if len(rows) == block:
                yield from flush()
                at.clear()
                rows.clear()
    if rows:
        yield from flush()


def joined(spans: list[Span]) -> str:
    """``kind:start:end`` by kind as listed, then start, comma-joined."""
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def tags_of(text: str, spans: list[Span]) -> np.ndarray:
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        tags[a:b] = 2 * KINDS.index(kind) + 2
        tags[a] -= 1
    return tags


def _sample(per_class: int) -> Callable:
    """Windows with spans of one kind, or without spans, of the smallest hashes of each such class."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[int, tuple[str, str]]] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                starts = window_starts(text) if text else []
                if not starts:
                    continue
                checked, every = base_spans(text), base_spans(text, checked=False)
                # Digits of any number look like a short card; only those as long as one are in doubt.
                doubtful = [s for s in set(every) - set(checked) if s[0] != "card" or len(_digits(text[s[1] : s[2]])) >= 13]
                for start in starts:
                    end = min(start + WIDTH, len(text))
                    meets = [s for s in checked if s[1] < end and s[2] > start]
                    # Cut or crossing spans and numbers that fail their checks would teach the wrong borders.
                    ordered = sorted(meets, key=lambda s: s[1])
                    if (any(s[1] < start or s[2] > end for s in meets) or any(s[1] < end and s[2] > start for s in doubtful)
                            or any(a[2] > b[1] for a, b in zip(ordered, ordered[1:]))):
                        continue
                    part = text[start:end]
                    name, own = (ordered[0][0], [(k, a - start, b - start) for k, a, b in ordered]) if ordered else ("none", [])
                    best = kept.setdefault(name, {})
                    best[xxhash.xxh3_64_intdigest(part.encode("utf-8", "surrogatepass")) >> 1] = (part, joined(own))
                    if len(best) > 8 * per_class:
                        for h in sorted(best)[per_class:]:
                            del best[h]
        rows = [(n, h, *best[h]) for n, best in kept.items() for h in sorted(best)[:per_class]]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows)], names=["name", "hash", "part", "spans"])

    return sample


def labelled_windows(docs: DataFrame, text: str = "text", per_class: int = 300) -> list:
    """At most ``per_class`` distinct windows for each kind of their first span, and as many without spans, by hash of the
    window: (part, spans). The bound does not grow with the data; the windows are those of the smallest hashes of all."""
    found = docs.select(F.col(text)).mapInArrow(_sample(per_class), "name string, hash bigint, part string, spans string").distinct()
    # Two steps, so that no task sees more than a few times the bound.
    first = F.row_number().over(W.partitionBy("name", F.col("hash") % 61).orderBy("hash", "part"))
    found = found.withColumn("k", first).filter(F.col("k") <= per_class)
    found = found.withColumn("k", F.row_number().over(W.partitionBy("name").orderBy("hash", "part"))).filter(F.col("k") <= per_class)
    return found.select("part", "spans").orderBy("hash", "part").collect()


def fit(windows: list, cells: int = 12, epochs: int = 5, least: int = 2_400, seed: int = 3) -> Tagger | None:
    """A tagger from (text, spans) windows; each window with spans also comes rewritten. Few windows are passed several
    times, rewritten anew, up to ``least`` examples. None without any span."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []
    for part, spans in windows * max(1, -(-least // max(1, 2 * len(windows)))):
        own = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]
        texts.append(part)
        labels.append(tags_of(part, own))
        if own:
            out, moved, done = "", [], 0
            for kind, a, b in sorted(own, key=lambda s: s[1]):
                out += part[done:a]
                new = rewritten(kind, part[a:b], rng)
                moved.append((kind, len(out), len(out) + len(new)))
                out, done = out + new, b
            out += part[done:]
            texts.append(out)
            labels.append(tags_of(out, moved))
    if not any(t.any() for t in labels):
        return None
    ids, tags = np.zeros((len(texts), WIDTH), np.int16), np.zeros((len(texts), WIDTH), np.int64)
    for k, (t, y) in enumerate(zip(texts, labels)):
        size = min(len(t), WIDTH)
        ids[k, :size], tags[k, :size] = characters(t)[:size], y[:size]
    model = Tagger.start(_CHARACTERS, cells, 2 * len(KINDS) + 1, seed)
    model.train(ids, tags, epochs=epochs, seed=seed)
    return model


def find(text: Column, model: Tagger | None) -> Column:
    """Struct (base, spans) of a text, as joined spans; a null text is empty. Without a model the base spans only."""

    @F.pandas_udf("base string, spans string")
    def scan(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts = [t or "" for t in part]
            fixed = [base_spans(t) for t in texts]
            more: dict[int, list[list]] = {}
            if model is not None:
                for which, spans in decode(model, texts):
                    more.setdefault(which, []).extend(spans)
            every = [f + reconcile(texts[k], more[k], f) if k in more else f for k, f in enumerate(fixed)]
            yield pd.DataFrame({"base": [joined(f) for f in fixed], "spans": [joined(s) for s in every]}, dtype="object")

    return scan(text)


def as_spans(text: Column) -> Column:
    """Joined spans as an array of (kind, start, end)."""
    part = lambda s, k: F.element_at(F.split(s, ":"), k)
    return F.transform(F.filter(F.split(text, ","), lambda s: s != ""), lambda s: F.struct(
        part(s, 1).alias("kind"), part(s, 2).cast("int").alias("start"), part(s, 3).cast("int").alias("end")))


def personal_data(docs: DataFrame, text: str = "text", added: str = "pii", **bounds) -> DataFrame:
    """``docs`` with the struct ``added``: base_text and spans_text as joined spans, base and spans as arrays.

    Trained on the documents' own labelled windows. Null and empty texts have no spans; equal texts have equal spans;
    rows repeat as they do in the input. ``added`` must not be among the columns.
    """
    model = fit(labelled_windows(docs, text, **bounds))
    found = docs.withColumn(added, find(F.col(text), model))
    base, spans = F.col(added)["base"], F.col(added)["spans"]
    return found.withColumn(added, F.struct(base.alias("base_text"), spans.alias("spans_text"), as_spans(base).alias("base"),
                                            as_spans(spans).alias("spans")))
