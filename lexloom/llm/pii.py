"""Personal data: rules for four kinds, and a trained character tagger that adds what they don't spell.

The tagger (a bidirectional LSTM with CRF transitions, see tagger.py) reads
overlapping windows.  A span that it may add holds a digit or an at sign by
definition, so windows without either, in any script or bracketed, can add
nothing and aren't decoded; all others are.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.llm.common import by_value
from lexloom.llm.tagger import DIGIT, PAD, SIGNS, classes, code_points, emissions, train, viterbi

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Code points of a window, and from one window to the next; windows decoded at once.
WIDTH, STEP, BATCH = 96, 48, 1024
#: What a span must hold to be added.
TRIGGER = r"[\p{Nd}@＠(\[{（［｛]"
_TRIGGERS = np.array([DIGIT, *(SIGNS + ord(c) for c in "@([{")], np.uint8)

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _small(part: str) -> bool:
    return len(part.lstrip("0")) <= 3 and int(part[-4:] if len(part) > 4 else part) <= 255


def _holds(kind: int, value: str) -> bool:
    """What a match of a kind's form must also satisfy."""
    if kind == IP:
        return all(_small(p) for p in value.split("."))
    if kind == EMAIL:
        return True
    digits = "".join(c for c in value if "0" <= c <= "9")
    return 12 <= len(digits) <= 19 and luhn(digits) if kind == CARD else 9 <= len(digits) <= 15


def forms(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all leftmost non-overlapping matches of each kind's form, in time linear in the text."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        # No part before an at sign holds one, so its start is where the run of its characters begins.
        head = text[end:at]
        start = end + len(head.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, EMAIL, domain.end()))
        end = domain.end() if domain else at + 1
        at = text.find("@", end)
    for kind, form in ((IP, _IP), (CARD, _CARD), (PHONE, _PHONE)):
        found += [(m.start(), kind, m.end()) for m in form.finditer(text)]
    return found


def rule_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the rules find, by start and kind."""
    return sorted((s, k, e) for s, k, e in forms(text) if _holds(k, text[s:e]))


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


# ---- what the tagger learns from ----


def _respelt(kind: int, value: str, rng: np.random.Generator) -> str:
    """The value as the rules don't spell it: spaced, bracketed, in other digits, or in other groups."""
    pick = lambda *of: of[rng.integers(len(of))]
    if kind == EMAIL:
        name, _, host = value.partition("@")
        way = rng.integers(4)
        if way == 0:
            return f"{name}{pick(' @ ', '@ ', ' @')}{host}"
        if way == 1:
            dot = pick(".", " [dot] ", "[dot]", " (dot) ", "(dot)")
            return name + pick(" (at) ", "(at)", " [at] ", "[at]", "{at}") + host.replace(".", dot)
        return f"{name}＠{host}" if way == 2 else f"{name}@{host.replace('.', pick(' . ', '[.]', '(.)', '．'))}"
    if kind == IP:
        spelt = value.replace(".", pick(" . ", "[.]", "(.)", "．", ". "))
        return _other_digits(value, rng) if rng.integers(4) == 0 else spelt
    digits = "".join(c for c in value if c.isdigit())
    if kind == CARD:
        if rng.integers(4) == 0:
            return _other_digits(value, rng)
        return pick(".", "/", "_", "  ", " - ", "·").join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own, area, mid, last = digits[: len(digits) - 10], digits[-10:-7], digits[-7:-4], digits[-4:]
    way = rng.integers(5)
    if way == 0:
        return _other_digits(value, rng)
    sep = pick(" ", "-", ".", "/")
    head = pick(f"({area}) ", f"({area})", area + sep)
    return (pick("", f"{own} ", f"00{own} ", f"({own}) ") if own else "") + head + mid + sep + last


def _other_digits(value: str, rng: np.random.Generator) -> str:
    zero = (0xFF10, 0x0660, 0x0966)[rng.integers(3)]
    return "".join(chr(zero + ord(c) - 48) if "0" <= c <= "9" else c for c in value)


def _distractor(rng: np.random.Generator) -> str:
    """Figures that are no personal data."""
    n = lambda a, b: int(rng.integers(a, b))
    hexa = lambda k: "".join("0123456789abcdef"[i] for i in rng.integers(0, 16, k))
    run = lambda k: "".join(str(i) for i in rng.integers(0, 10, k))
    ways = (
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02}", f"{n(1, 29)}.{n(1, 13)}.{n(1900, 2100)}", f"{n(0, 24):02}:{n(0, 60):02}:{n(0, 60):02}", f"{n(1, 999)},{n(0, 1000):03}.{n(0, 100):02}", f"v{n(0, 20)}.{n(0, 20)}.{n(0, 20)}",
        hexa(n(16, 41)), f"{n(0, 10)}.{run(n(3, 9))}", run(n(1, 9)), f"{n(1, 20)}, {n(1, 20)}, {n(1, 20)}", f"[{n(1, 200)}]", f"({n(1, 200)})", f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", f"{n(1, 40)}({n(1, 9)})", f"{n(1, 100)}/{n(1, 100)}/{n(1, 100)}",
        f"{n(1900, 2100)}-{n(1, 13):02}-{n(1, 29):02} {n(0, 24):02}:{n(0, 60):02}", f"@{hexa(n(3, 9))}", f"{n(1, 99)} {n(1, 99)} {n(1, 99)} {n(1, 99)}", "(at the end)", "[sic]", f"key = \"{hexa(40)}\"", f"{n(100, 999)}-{n(100, 999)}", f"{n(1, 10)}.{n(1, 10)}.{n(1, 10)}.",
    )
    return ways[rng.integers(len(ways))]


def examples(labelled: list[tuple[str, list[tuple[int, int, int]]]], copies: int = 4, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(classes, tags) of windows from labelled texts: as they are, with spans respelt or other figures put in, and two in a row.

    Where a window begins is random, so that spans also lie at its edges and
    are cut by them.
    """
    rng = np.random.default_rng(seed)
    x, y = [], []
    for first, first_spans in labelled:
        for turn in range(copies):
            text, spans = first, first_spans
            if turn == copies - 1 and turn:  # spans also stand close together
                other, more = labelled[rng.integers(len(labelled))]
                cut = int(rng.integers(0, 30))
                start = max(0, min((s for s, _, _ in more), default=0) - cut)
                text, spans = f"{first} {other[start:]}", [*first_spans, *((s + len(first) + 1 - start, k, e + len(first) + 1 - start) for s, k, e in more)]
            parts, own, at = [], [], 0
            for s, k, e in spans:
                value = text[s:e] if turn == 0 or rng.integers(4) == 0 else _respelt(k, text[s:e], rng)
                parts.append(text[at:s])
                start = sum(map(len, parts))
                parts.append(value)
                own.append((start, k, start + len(value)))
                at = e
            parts.append(text[at:])
            new = "".join(parts)
            if not own:
                cut = int(rng.integers(0, len(new) + 1))
                other = f" {_distractor(rng)} " if turn else ""
                new = new[:cut] + other + new[cut:]
                centre = cut + len(other) // 2
            else:
                s, _, e = own[rng.integers(len(own))]
                centre = int(rng.integers(s, e))
            codes = classes(code_points(new))
            tags = np.zeros(len(new), np.int64)
            for s, k, e in own:
                tags[s:e] = 2 + 2 * k
                tags[s] = 1 + 2 * k
            lo = max(0, min(centre - int(rng.integers(0, WIDTH)), max(0, len(new) - WIDTH)))
            row, tag = np.full(WIDTH, PAD, np.uint8), np.zeros(WIDTH, np.int64)
            row[: len(codes[lo : lo + WIDTH])] = codes[lo : lo + WIDTH]
            tag[: len(codes[lo : lo + WIDTH])] = tags[lo : lo + WIDTH]
            x.append(row)
            y.append(tag)
    return np.array(x).reshape(-1, WIDTH), np.array(y).reshape(-1, WIDTH)


def labelled_by_rules(docs: DataFrame, text_col: str = "text", most: int = 400) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """(passage, spans) of at most `most` passages of each kind and of figures that no form covers: those of the least hash.

    Passages come from all documents; each task keeps `most` of a kind, and the
    least of these meet, so that at most 5 x `most` reach the driver.  All
    matches of a form count here, whether their digits add up or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[dict[int, str]] = [{} for _ in range(5)]
        for batch in batches:
            for text in _figured(batch.column(0))[1]:
                found = forms(text)
                marks = [(s, k if k != CARD or e - s >= 12 else 4, e) for s, k, e in found]
                inside = sorted((s, e) for s, _, e in found)
                # The first figure outside all forms.
                at = 0
                for m in re.finditer(r"\d+", text):
                    while at < len(inside) and inside[at][1] <= m.start():
                        at += 1
                    if at == len(inside) or m.end() <= inside[at][0]:
                        marks.append((m.start(), 4, m.end()))
                        break
                for s, k, e in marks:
                    passage = text[max(0, s - WIDTH) : e + WIDTH]
                    mark = int.from_bytes(hashlib.blake2b(passage.encode(errors="replace"), digest_size=7).digest())
                    kept[k][mark] = passage
            for k, own in enumerate(kept):
                if len(own) > 4 * most:
                    kept[k] = {h: own[h] for h in heapq.nsmallest(most, own)}
        rows = [(k, h, own[h]) for k, own in enumerate(kept) for h in heapq.nsmallest(most, own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], ["kind", "mark", "passage"])

    found = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "kind int, mark long, passage string").distinct()
    best = found.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("mark"))).where(F.col("r") <= most)
    rows = sorted((r["kind"], r["mark"], r["passage"]) for r in best.collect())
    return [(p, _disjoint(forms(p))) for _, _, p in rows]


def _disjoint(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of overlapping matches the longest: a phone's digits are no card."""
    taken: list[tuple[int, int, int]] = []
    for s, k, e in sorted(found, key=lambda x: (x[0] - x[2], x)):
        if all(e <= a or z <= s for a, _, z in taken):
            taken.append((s, k, e))
    # A number too short for any kind is a figure like others.
    return sorted(x for x in taken if x[1] != CARD or x[2] - x[0] >= 12)


@dataclass(frozen=True)
class Tagger:
    """The parameters, and the least gain (log-odds against no span) of a span that is added."""

    parameters: dict
    least_gain: float = 4.0


def fit(labelled: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 8, seed: int = 7) -> Tagger | None:
    """A tagger fitted on the labelled passages; none without a span to learn from."""
    if not any(spans for _, spans in labelled):
        return None
    x, y = examples(labelled, seed=seed + 4)
    while len(x) < 512:  # few labels are seen in more places and spellings
        more = examples(labelled, seed=seed + 5 + len(x))
        x, y = np.concatenate((x, more[0])), np.concatenate((y, more[1]))
    return Tagger(train(x, y, 1 + 2 * len(KINDS), epochs=epochs, seed=seed))


# ---- what it adds ----


def _figured(column: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Rows that hold a trigger, and their texts."""
    rows = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, TRIGGER), False).to_numpy(zero_copy_only=False))
    return rows, column.take(pa.array(rows)).to_pylist()


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Starts of the windows, STEP apart from 0, that hold a trigger."""
    at = np.flatnonzero(np.isin(codes, _TRIGGERS)) // STEP
    return np.unique(np.concatenate((at, np.maximum(at - 1, 0)))) * STEP


Found = tuple[int, int, int, float, bool]


def decode(p: dict, x: np.ndarray) -> list[list[Found]]:
    """Of each window (start, kind, end, gain, at an edge) of every span on its best path; gain is against a path without it."""
    e = emissions(p, x)
    paths = viterbi(p, e)
    out: list[list[Found]] = [[] for _ in range(len(x))]
    for w in np.flatnonzero(paths.any(1)):
        path, own = paths[w], e[:, w]
        t = 0
        while t < len(path):
            if not path[t]:
                t += 1
                continue
            kind, s = (int(path[t]) - 1) // 2, t
            t += 1
            while t < len(path) and path[t] == 2 + 2 * kind:
                t += 1
            tags = path[s:t]
            gain = float(own[np.arange(s, t), tags].sum() - own[s:t, 0].sum() + p["trans"][tags[:-1], tags[1:]].sum() - (t - s - 1) * p["trans"][0, 0])
            before, after = (int(path[s - 1]) if s else None), (int(path[t]) if t < len(path) else None)
            gain += float(p["start"][tags[0]] - p["start"][0] if before is None else p["trans"][before, tags[0]] - p["trans"][before, 0])
            gain += 0.0 if after is None else float(p["trans"][tags[-1], after] - p["trans"][0, after])
            out[w].append((s, kind, t, gain, s == 0 or t == len(path)))
    return out


def _plain(value: str) -> str:
    """Spelt as the rules want it: ASCII digits and signs, brackets and blanks of an address taken out."""
    plain = "".join(str(unicodedata.decimal(c)) if unicodedata.decimal(c, None) is not None else chr(ord(c) - 0xFEE0) if 0xFF01 <= ord(c) <= 0xFF5E else c for c in value)
    plain = re.sub(r"\s*[\[({]\s*at\s*[\])}]\s*", "@", plain, flags=re.I)
    return re.sub(r"\s*[\[({]\s*(?:dot|\.)\s*[\])}]\s*", ".", plain, flags=re.I)


def acceptable(kind: int, text: str, start: int, end: int) -> bool:
    """Whether a span that the tagger proposes can be one of its kind: form, digits and what stands beside it."""
    value = text[start:end]
    if value != value.strip() or (start and text[start - 1].isalnum()) or (end < len(text) and text[end].isalnum()):
        return False
    plain = _plain(value)
    if kind in (EMAIL, IP):
        plain = re.sub(r"\s*([@.])\s*", r"\1", plain)
        found = [x for x in forms(plain) if x[1] == kind]
        return found == [(0, kind, len(plain))] and _holds(kind, plain)
    if not re.fullmatch(r"[0-9+()\s./_·-]+", plain) or not _holds(kind, plain):
        return False
    # A phone number without + must be grouped; dates and bare numbers aren't.
    return kind == CARD or len(re.findall(r"[0-9]+", plain)) >= 3 or "+" in plain


def reconcile(text: str, found: list[tuple[int, int, int, float, bool]], base: list[tuple[int, int, int]], least_gain: float) -> list[tuple[int, int, int]]:
    """The spans that are added, from those of all windows of a text.

    A span cut by a window's edge gives way to one that another window sees
    whole, or grows together with what the next window sees of it.  Those that
    overlap no rule's span and are acceptable compete: the disjoint ones of the
    largest total gain stay (ties: those that end first).
    """
    whole: dict[tuple[int, int, int], float] = {}
    for s, k, e, gain, cut in found:
        if not cut:
            whole[s, k, e] = max(gain, whole.get((s, k, e), gain))
    grown: list[list] = []
    for s, k, e, gain, cut in sorted(found, key=lambda x: (x[1], x[0], x[2])):
        if cut and not any(j == k and a <= s and e <= z for a, j, z in whole):
            if grown and grown[-1][1] == k and s <= grown[-1][2]:
                grown[-1][2], grown[-1][3] = max(e, grown[-1][2]), max(gain, grown[-1][3])
            else:
                grown.append([s, k, e, gain])
    for s, k, e, gain in grown:
        whole.setdefault((s, k, e), gain)
    tidy: dict[tuple[int, int, int], float] = {}
    for (s, k, e), g in whole.items():
        s, e = _tidied(text, s, e)
        tidy[s, k, e] = max(g, tidy.get((s, k, e), g))
    whole = tidy
    rest = sorted((e, s, k, g) for (s, k, e), g in whole.items() if g >= least_gain and all(e <= a or z <= s for a, _, z in base) and acceptable(k, text, s, e))
    ends, best, last = [e for e, *_ in rest], [0.0], []
    for i, (e, s, k, g) in enumerate(rest):
        j = _before(ends, s, i)
        last.append(j if best[j] + g > best[i] else None)
        best.append(max(best[i], best[j] + g))
    taken, i = [], len(rest)
    while i:
        j = last[i - 1]
        if j is None:
            i -= 1
        else:
            taken.append((rest[i - 1][1], rest[i - 1][2], rest[i - 1][0]))
            i = j
    return sorted(taken)


def _tidied(text: str, start: int, end: int) -> tuple[int, int]:
    """Without blanks at its ends, and with the bracket that opens or closes one inside it."""
    while start < end and text[start].isspace():
        start += 1
    while start < end and text[end - 1].isspace():
        end -= 1
    for a, z in ("()", "[]"):
        inside = text[start:end]
        if inside.count(z) > inside.count(a) and start and text[start - 1] == a:
            start -= 1
        elif inside.count(a) > inside.count(z) and text[end : end + 1] == z:
            end += 1
    return start, end


def _before(ends: list[int], start: int, most: int) -> int:
    """How many of the first `most` ends are at most `start`."""
    lo, hi = 0, most
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (mid + 1, hi) if ends[mid] <= start else (lo, mid)
    return lo


def added_spans(tagger: Tagger, texts: list[str], base: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """What the tagger adds to each text, its windows decoded a batch at a time."""
    found: list[list[Found]] = [[] for _ in texts]
    held: list[tuple[int, int, int, np.ndarray]] = []

    def flush() -> None:
        x = np.stack([h[3] for h in held])
        for (row, start, size, _), spans in zip(held, decode(tagger.parameters, x)):
            for s, k, e, gain, _ in spans:
                e = min(e, size - start)
                cut = (s == 0 and start > 0) or (e == WIDTH and start + WIDTH < size)
                found[row].append((start + s, k, start + e, gain, cut))
        held.clear()

    for row, text in enumerate(texts):
        codes = classes(code_points(text))
        for start in window_starts(codes).tolist():
            one = np.full(WIDTH, PAD, np.uint8)
            piece = codes[start : start + WIDTH]
            one[: len(piece)] = piece
            held.append((row, start, len(codes), one))
            if len(held) == BATCH:
                flush()
    if held:
        flush()
    return [reconcile(t, f, b, tagger.least_gain) if f else [] for t, f, b in zip(texts, found, base)]


def pii_scan(docs: DataFrame, labelled: list[tuple[str, list[tuple[int, int, int]]]] | None = None, id_col: str = "doc_id", text_col: str = "text", max_labelled: int = 400) -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans and n_added of every row.

    Counts and the hash are those of the rules; spans has these and what the
    tagger adds (n_added).  It is fitted on `labelled` passages, (text, [(start,
    kind, end)]), or else on passages of the documents themselves that the rules
    label, at most `max_labelled` of a kind, which are also respelt; without
    any, nothing is added.  A null or empty text has no spans; repeated rows,
    null ids and other columns are each row's own affair; no rows give none.
    Texts are read whole, in time linear in their length; positions are code
    points.
    """
    tagger = fit(labelled_by_rules(docs, text_col, max_labelled) if labelled is None else labelled)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *T.StructType.fromDDL("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long").fields])
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            counts, digest, spans, added = np.zeros((4, n), np.int64), [none] * n, [""] * n, np.zeros(n, np.int64)
            rows, texts = _figured(batch.column(1))
            base = [rule_spans(t) for t in texts]
            more = added_spans(tagger, texts, base) if tagger else [[]] * len(texts)
            for row, own, other in zip(rows.tolist(), base, more):
                for _, k, _ in own:
                    counts[k, row] += 1
                digest[row] = hashlib.sha256(written(own).encode()).hexdigest()
                spans[row] = written(sorted(own + other))
                added[row] = len(other)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(digest, pa.string()), pa.array(spans, pa.string()), pa.array(added)], schema.names)

    return docs.select(id_col, F.col(text_col).cast("string").alias("_text")).mapInArrow(run, schema)


by_value(__name__)
