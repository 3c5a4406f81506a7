"""Texts decoded with the wrong character encoding: find the places and restore them.

A hidden Markov model labels the non-ASCII runs of a text. One state is clean; each other
state is a chain of (true encoding, wrongly used encoding) pairs, whose inverse turns a
damaged run back. The emission of a character is how often documents of the whole corpus
hold it between its neighbours; a damaged state emits what its inverse gives instead.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Encoding pairs (true, used): bytes of the first were read as the second.
SINGLE_BYTE = ("cp1252", "cp437", "cp850", "cp1250", "cp1251", "mac_roman", "cp866", "koi8_r", "iso8859_15")
MULTI_BYTE = ("gb18030", "shift_jis", "big5", "euc_kr")
PAIRS = (
    *(("utf_8", used) for used in (*SINGLE_BYTE, *MULTI_BYTE)),
    *(("cp1252", used) for used in ("mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r", "cp866")),
    *((true, "cp1252") for true in ("mac_roman", "cp437", "cp850")),
)
#: States: one pair, or pairs undone one after the other (text damaged repeatedly).
TWICE = ("cp1252", "cp437", "cp850", "cp1250", "cp1251", "mac_roman")
STATES = (
    *((p,) for p in PAIRS),
    *((("utf_8", a), ("utf_8", b)) for a in TWICE for b in TWICE),
    (("utf_8", "cp1252"),) * 3,
)
#: Log probabilities of entering and leaving a damaged state, and of a run that should
#: be damaged in a state but is not.
ENTER, LEAVE, UNTOUCHED = -4.5, -0.5, -1.0
SMOOTHING = 0.1
#: Weight of the counts whose neighbouring letters are known by their case only.
CLASS_WEIGHT = 0.01
#: How far around a quoted wrong sequence the sign it stands for may be named.
QUOTE_SPAN = 45
LOST = "�"
#: Signs that may enclose a quoted sequence.
EDGE = " \\t\\n“”‘’\"'«»"

_CHAR = re.compile(r"(?s)(?<![^\x00-\x7f])([\x00-\x7f]?)([^\x00-\x7f]+)(?=([\x00-\x7f]?))")


#: Neighbours of scripts with thousands of signs count as one, so that contexts are at
#: most the signs times some thousand neighbours, however large the corpus.
WIDE = "~w"


def _side(ch: str) -> str:
    """A neighbour as it counts: letters and non-ASCII signs up to Cyrillic and among
    punctuation and symbols stand for themselves."""
    if not ch:
        return "^"
    if ch >= "\u0530" and not "\u2000" <= ch < "\u2c00" and ch != LOST:
        return WIDE
    if ch > "\x7f" or ch.isalpha():
        return ch
    return "0" if ch.isdigit() else " " if ch.isspace() else "."


def _case(side: str) -> str:
    """The class of a neighbour: letters by their case only."""
    if side.isascii() and side.isalpha():
        return "lower" if side.islower() else "upper"
    return side


def _contexts(before: str, run: str, after: str) -> list[tuple[str, str, str]]:
    """Per sign: its neighbours; non-ASCII ones to the right are not told apart."""
    chars = [before, *run, after]
    return [(_side(chars[i - 1]), chars[i], _side(chars[i + 1]) if chars[i + 1] <= "\x7f" else "..") for i in range(1, len(chars) - 1)]


def context_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(before, sign, after, docs): in how many documents a non-ASCII sign stands between
    such neighbours. One small row set per batch is added up; its size follows the
    alphabet, not the documents. The row with an empty sign counts the documents. Pure
    ASCII texts do not leave the JVM."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, list] = {}
        total: Counter = Counter()
        for batch in batches:
            for value in batch[text]:
                if not value:
                    continue
                seen = set()
                for run in set(_CHAR.findall(value)):
                    found = known.get(run)
                    if found is None:
                        found = _contexts(*run)
                        if len(known) < 200_000:
                            known[run] = found
                    seen.update(found)
                total.update(seen)
        if total:
            yield pd.DataFrame([(*k, n) for k, n in total.items()], columns=["before", "sign", "after", "docs"])

    held = docs.select(text).where(F.length(text) > 0)
    parts = held.where(F.octet_length(text) > F.length(text)).mapInPandas(count, "before string, sign string, after string, docs long")
    empty = [F.lit("").alias(c) for c in ("before", "sign", "after")]
    parts = parts.unionByName(held.agg(F.count("*").alias("docs")).select(*empty, "docs"))
    return parts.groupBy("before", "sign", "after").agg(F.sum("docs").alias("docs"))


def _undo(raw: str, true: str, used: str) -> str | None:
    """The text whose bytes in ``true``, read as ``used``, gave ``raw``; None if there is none."""
    if used == "cp1252":
        data = bytearray()
        for ch in raw:
            try:
                data += ch.encode("cp1252")
            except UnicodeEncodeError:
                if ord(ch) > 0xFF:
                    return None
                data.append(ord(ch))  # bytes without a sign in cp1252 are passed through
        data = bytes(data)
    else:
        try:
            data = raw.encode(used)
        except UnicodeEncodeError:
            return None
    try:
        return data.decode(true)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=100_000)
def undo(raw: str, state: tuple) -> str | None:
    for true, used in state:
        undone = _undo(raw, true, used)
        if undone is None or undone == raw:
            return None
        raw = undone
    return raw


@lru_cache(maxsize=200_000)
def pieces(run: str, state: tuple) -> tuple[tuple[int, int, str | None], ...]:
    """The run cut into shortest parts that the state's inverse can turn back, and signs
    that it cannot (None)."""
    out, i, longest = [], 0, 4 if len(state) == 1 else 12 if len(state) == 2 else 27
    if state[0][0] != "utf_8":
        longest = 1
    while i < len(run):
        if longest == 1 and run[i].isspace():  # a no-break space is layout, not a letter
            out.append((i, i + 1, None))
            i += 1
            continue
        for j in range(i + 1, min(len(run), i + longest) + 1):
            back = undo(run[i:j], state)
            if back is not None and (len(back) < j - i or longest == 1 or state[0][1] in MULTI_BYTE) and not any("\x7f" <= c <= "\x9f" for c in back):
                out.append((i, j, back))
                i = j
                break
        else:
            out.append((i, i + 1, None))
            i += 1
    return tuple(out)


class Labeller:
    """The trained model: finds the best path of states over the runs of one text."""

    def __init__(self, counts: dict[tuple[str, str, str], int]):
        self.counts = counts
        self.classes: Counter = Counter()
        for (b, sign, a), n in counts.items():
            self.classes[_case(b), sign, _case(a)] += n
        self.log_docs = math.log(max(counts.get(("", "", ""), 1), 1) + 1.0)
        self.options: dict[tuple[str, str, str], dict[tuple, tuple[float, str]]] = {}

    def emission(self, before: str, text: str, after: str) -> float:
        if not text:
            return 0.0
        total = 0.0
        for b, sign, a in _contexts(before, text, after):
            if sign > "\x7f":
                seen = self.counts.get((b, sign, a), 0) + CLASS_WEIGHT * self.classes.get((_case(b), sign, _case(a)), 0)
                total += math.log(seen + SMOOTHING) - self.log_docs
        return total

    def gains(self, run: tuple[str, str, str]) -> dict[tuple, tuple[float, str]]:
        """For each state that turns part of the run back: its gain over clean and the text."""
        found = self.options.get(run)
        if found is not None:
            return found
        before, raw, after = run
        clean = self.emission(before, raw, after)
        found = {}
        for state in STATES:
            parts = pieces(raw, state)
            if all(back is None for _, _, back in parts):
                continue
            text = "".join(raw[i:j] if back is None else back for i, j, back in parts)
            kept = sum(back is None for _, _, back in parts)
            found[state] = (self.emission(before, text, after) - clean + UNTOUCHED * kept, text)
        if not any(gain > 0 for gain, _ in found.values()):
            found = {}
        if len(self.options) < 500_000:
            self.options[run] = found
        return found

    @staticmethod
    def cited(text: str, start: int, end: int) -> list[int]:
        """Where the sign is named that a run which stands alone is meant for, if it is
        named close by: a sound text that quotes a wrong sequence."""
        if (start > 0 and text[start - 1] not in EDGE) or (end < len(text) and text[end] not in EDGE):
            return []
        meant = {t for s in STATES if s[0][0] == "utf_8" and (t := undo(text[start:end], s)) is not None and len(t) == 1}
        found = []
        for sign in meant:
            for at, stop in ((max(0, start - QUOTE_SPAN), start), (end, min(len(text), end + QUOTE_SPAN))):
                for m in re.finditer(rf"(?<![^{EDGE}]){re.escape(sign)}(?![^{EDGE}])", text[at:stop]):
                    found.append(at + m.start())
        return found

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, state, restored) of each damaged run; restored is the lost sign
        itself where the original cannot be told."""
        if not any(r[1].find(LOST) >= 0 or self.gains(r) for r in set(_CHAR.findall(text))):
            return []
        matches = list(_CHAR.finditer(text))
        skipped: set[int] = set()
        for m in matches:
            raw = m.group(2)
            # quotation marks may enclose the sequence or be its last sign
            for lead in {0, int(raw[0] in EDGE)}:
                for tail in {0, int(raw[-1] in EDGE)}:
                    at, end = m.start(2) + lead, m.end(2) - tail
                    if end - at > 1 and (named := self.cited(text, at, end)):
                        skipped.update((at, *named))
        runs, gains, lost = [], [], []
        for m in matches:
            start, end = m.start(2), m.end(2)
            if any(start <= i < end for i in skipped):
                continue
            run = (m.group(1), m.group(2), m.group(3))
            options = self.gains(run)
            if LOST in run[1]:
                lost.append((start, end))
            runs.append((start, end, run[1]))
            gains.append(options)
        path = self.best_path(gains)
        out = []
        for (start, end, raw), options, state in zip(runs, gains, path, strict=True):
            if state is not None and state in options:
                restored = options[state][1]
                if restored != raw:
                    out.append((start, end, "+".join(f"{t}>{u}" for t, u in state), restored))
                    continue
            if (start, end) in lost:
                out.append((start, end, "lost", raw))
        return out

    def best_path(self, gains: list[dict]) -> list[tuple | None]:
        hopeful = {s for g in gains for s, (gain, _) in g.items() if gain > 0}
        active = [s for s in STATES if s in hopeful]
        score: dict[tuple | None, float] = {None: 0.0, **dict.fromkeys(active, ENTER)}
        back: list[dict] = []
        for g in gains:
            if not g:
                back.append({s: s for s in score})
                continue
            best = max(score, key=lambda s: score[s])
            new, came = {}, {}
            for s in score:
                stay = score[s]
                if s is None:
                    move = score[best] + (LEAVE if best is not None else 0.0)
                    new[s], came[s] = (stay, s) if stay >= move else (move, best)
                else:
                    enter = score[best] + ENTER
                    base, origin = (stay, s) if stay >= enter else (enter, best)
                    new[s], came[s] = base + (g[s][0] if s in g else UNTOUCHED), origin
            score = new
            back.append(came)
        state = max(score, key=lambda s: (score[s], s is None))
        path: list[tuple | None] = []
        for came in reversed(back):
            path.append(state)
            state = came[state]
        return path[::-1]


def damaged_texts(docs: DataFrame, counts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, restored, recovered, spans, states) of the documents with a damaged place.

    ``recovered`` is false if a sign was lost for good. Texts that are null, empty or
    pure ASCII have no damage; copies of a key are labelled each and count once.
    """
    table = {(r["before"], r["sign"], r["after"]): r["docs"] for r in counts.toLocalIterator()}
    shared = docs.sparkSession.sparkContext.broadcast(table)  # as large as the alphabet's contexts

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = Labeller(shared.value)
        for batch in batches:
            rows = []
            for k, value in zip(batch[key], batch[text], strict=True):
                if not value or value.isascii():
                    continue
                spans = model.spans(value)
                if not spans:
                    continue
                restored, at = [], 0
                for start, end, _, back in spans:
                    restored += [value[at:start], back]
                    at = end
                restored.append(value[at:])
                whole = "".join(restored)
                rows.append((k, whole, LOST not in whole, len(spans), ",".join(sorted({s for _, _, s, _ in spans}))))
            yield pd.DataFrame(rows, columns=[key, "restored", "recovered", "spans", "states"])

    found = docs.select(key, text).where(F.octet_length(text) > F.length(text)).mapInPandas(label, f"{key} long, restored string, recovered boolean, spans int, states string")
    return found.dropDuplicates([key])
